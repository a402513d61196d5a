"""Physics of deformability measurements as column expressions (SCL-08, SCL-12 to SCL-20)."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.numeric import NAN, as_column, safe_div, sum_of

# Names of media and what else they are called.
MEDIA = {
    "0.49% MC-PBS": ["0.49% MC-PBS", "0.5% MC-PBS", "0.50% MC-PBS"],
    "0.59% MC-PBS": ["0.59% MC-PBS", "0.6% MC-PBS", "0.60% MC-PBS"],
    "0.83% MC-PBS": ["0.83% MC-PBS", "0.8% MC-PBS", "0.80% MC-PBS"],
    "water": ["water"],
}
# A and beta of the 2022 model, and K, n and reference temperature of the 2017 model, by medium.
BUYUKURGANCI_2022 = {"0.49% MC-PBS": (2.30e-6, -0.0056), "0.59% MC-PBS": (5.70e-6, -0.0744), "0.83% MC-PBS": (16.52e-6, -0.1455)}
HEROLD_2017 = {"0.49% MC-PBS": (0.179, 0.677, 23.2), "0.59% MC-PBS": (0.360, 0.634, 23.6)}
# Temperatures in degrees Celsius for which each model was made.
RANGES = {"buyukurganci-2022": (22, 37), "herold-2017": (18, 26), "kestin-1978": (0, 40)}


class TemperatureWarning(UserWarning):
    """A model is used outside the temperatures it was made for."""


def medium_name(medium: str, aliases: dict[str, str] | None = None) -> str:
    """The name under which models know a medium; aliases adds names of one's own."""
    known = {a.lower(): m for m, names in MEDIA.items() for a in names} | {a.lower(): m for a, m in (aliases or {}).items()}
    try:
        return known[medium.lower()]
    except KeyError:
        raise ValueError(f"unknown medium {medium!r}; known: {', '.join(MEDIA)}") from None


def _check(model: str, temperature) -> None:
    low, high = RANGES[model]
    if isinstance(temperature, (int, float)) and not low <= temperature <= high:
        warnings.warn(f"{model} holds from {low} to {high} degrees, not at {temperature}", TemperatureWarning, stacklevel=4)


def shear_rate(flow_rate: Column, width: Column, n: Column) -> Column:
    """Shear rate in a square channel [1/s] of flow in uL/s and width in um."""
    length = width * 1e-3  # in mm
    return 8 * flow_rate / (length * length * length) * (0.6671 + 0.2121 / n)


def viscosity(medium: str, temperature, channel_width=20.0, flow_rate=0.16, model: str = "buyukurganci-2022", aliases: dict[str, str] | None = None) -> Column:
    """Viscosity in mPa s. Temperature (degrees), channel width (um) and flow rate (uL/s) are numbers or columns; zero
    flow gives NaN, but for water."""
    medium = medium_name(medium, aliases)
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    width = channel_width if isinstance(channel_width, Column) else F.lit(float(channel_width))
    flow = flow_rate if isinstance(flow_rate, Column) else F.lit(float(flow_rate))
    if medium == "water":
        _check("kestin-1978", temperature)
        d = 20 - t
        return 1.002 * F.pow(F.lit(10.0), d / (t + 96) * (1.2364 - 1.37e-3 * d + 5.7e-6 * d * d))
    if model == "buyukurganci-2022":
        _check(model, temperature)
        a, beta = BUYUKURGANCI_2022[medium]
        kelvin = t + 273.15
        n = 0.00223 * kelvin + beta
        value = a * F.exp(3379.7 / kelvin) * F.pow(shear_rate(flow, width, n), n - 1) * 1e3
    elif model == "herold-2017":
        if medium not in HEROLD_2017:
            raise ValueError(f"{model} does not know {medium}")
        _check(model, temperature)
        k, n, reference = HEROLD_2017[medium]
        metres = width * 1e-6
        flow_term = 1.1856 * 6 * flow * 1e-9 / (metres * metres * metres) * 2 / 3
        wall_term = 0.6771 / 0.5928 + 0.2121 / (0.5928 * n)
        value = k * F.pow(flow_term * wall_term, F.lit(n - 1)) * F.pow(t / reference, F.lit(-0.866)) * 1e3
    else:
        raise ValueError(f"unknown viscosity model {model!r}")
    return F.when(flow != 0, value).otherwise(F.lit(NAN))


# Offset and (amplitude, decay) of the deformation that pixels add, by size feature and its power.
PIXELATION = {
    "area_um": (2, 0.0012, ((0.020, 7.1), (0.010, 38.6), (0.005, 296.0))),
    "volume": (3, 0.0013, ((0.0172, 40.0), (0.0070, 450.0), (0.0032, 6040.0))),
}


def pixelation_delta(size: str, feature: str = "deform", pixel_um: float = 0.34, column: Column | None = None) -> Column:
    """What pixelation adds to a feature: for deform by size, the negative of it for circ, 0 for sizes."""
    if feature in PIXELATION:
        return F.lit(0.0)
    if feature not in ("deform", "circ"):
        raise KeyError(f"no pixelation correction for {feature}")
    power, base, terms = PIXELATION[size]
    x = (column if column is not None else as_column(size)) * (0.34 / pixel_um) ** power
    delta = F.lit(base) + sum_of(F.lit(a) * F.exp(-x / d) for a, d in terms)
    return delta if feature == "deform" else -delta


def scale_feature(feature: str, x: Column, width_in: float, width_out: float, flow_in: float = 1.0, flow_out: float = 1.0, viscosity_in: float = 1.0, viscosity_out: float | Column = 1.0) -> Column:
    """A value measured in one channel, flow and viscosity, as it would be in another."""
    r = width_out / width_in
    if feature == "area_um":
        return x * r**2
    if feature == "volume":
        return x * r**3
    if feature == "emodulus":
        return x * (flow_out / flow_in) * (viscosity_out / viscosity_in) * (1 / r) ** 3
    if feature in ("deform", "circ"):
        return x
    raise KeyError(f"no scaling for {feature}")


def compensation_matrix(ct: dict[str, float]) -> np.ndarray:
    """Inverse of the spill-over matrix of three channels; ct["12"] is the spill from channel 1 to 2. Absent ones are 0."""
    if any(v < 0 for v in ct.values()):
        raise ValueError("spill-over must not be negative")
    m = np.array([[1.0 if i == j else ct.get(f"{i}{j}", 0.0) for j in (1, 2, 3)] for i in (1, 2, 3)])
    return np.linalg.inv(m)


def compensated(channels: dict[int, Column], ct: dict[str, float], channel: int) -> Column:
    """Spill-over-corrected signal of one channel; channels that are not given count as 0."""
    inverse = compensation_matrix(ct)
    return sum_of(F.lit(float(inverse[i - 1, channel - 1])) * c for i, c in sorted(channels.items()))


def ml_class(scores: dict[str, Column]) -> Column:
    """Index of the largest score in the order of the scores' names: ties to the first, -1 if all are 0 or NaN; scores
    outside [0, 1] are an error."""
    clean = [F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c) for _, c in sorted(scores.items())]
    bad = F.lit(False)
    for c in clean:
        bad = bad | (c < 0) | (c > 1)
    values = F.array(*clean)
    best = F.when(F.array_max(values) > 0, F.array_position(values, F.array_max(values)) - 1).otherwise(F.lit(-1))
    return F.when(bad, F.raise_error("scores must lie in [0, 1]").cast("bigint")).otherwise(best.cast("bigint"))


def derived(name: str, config: dict | None = None) -> Column:
    """Simple derived features (SCL-01 to SCL-06) from columns and the measurement's configuration."""
    c, get = F.col, (config or {}).get
    table = {
        "time": lambda: c("frame") / F.lit(float(get("frame rate"))),
        "area_ratio": lambda: safe_div(c("area_cvx"), c("area_msd")),
        "area_um": lambda: c("area_cvx") * float(get("pixel size")) ** 2,
        "aspect": lambda: safe_div(c("size_x"), c("size_y")),
        "deform": lambda: 1 - c("circ"),
    }
    return table[name]()
