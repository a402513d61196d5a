"""Stiffness from look-up tables (SCL-10, SCL-11, JOIN-10, ISO-01 to ISO-04, SRC-28 to SRC-30).

The table's points are triangulated once on the driver (they are bounded: tables above MAX_POINTS are refused). Events
and table are put on one scale, so that the triangulation does not depend on channel, flow or viscosity; each event's
triangle is found by a grid over the triangles, in vectorised batches.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.numeric import NAN, as_column
from flowloom.functions.physics import pixelation_delta, scale_feature
from flowloom.functions.physics import viscosity as viscosity_of

MAX_POINTS = 50_000


@dataclass
class Lut:
    """Points (x, deform, emodulus) and the conditions they hold for."""

    points: np.ndarray
    x: str = "area_um"
    channel_width: float = 20.0
    flow_rate: float = 0.04
    fluid_viscosity: float = 15.0
    identifier: str = ""
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        self.points = np.asarray(self.points, float)
        if len(self.points) > MAX_POINTS:
            raise ValueError(f"look-up tables of more than {MAX_POINTS} points are not supported")


class LutRegistry(dict):
    """Tables by identifier."""

    def register(self, lut: Lut) -> None:
        if lut.identifier in self:
            raise ValueError(f"identifier {lut.identifier!r} is taken")
        self[lut.identifier] = lut


def parse_mtext(text: str) -> tuple[pd.DataFrame, dict]:
    """Tab-separated numbers under a header of `#` lines that holds JSON metadata and column names with units."""
    inside, meta, comments, rows = False, [], [], []
    for line in text.splitlines():
        if line.startswith("#"):
            bare = line.lstrip("#").strip()
            if "BEGIN METADATA" in bare:
                inside = True
            elif "END METADATA" in bare:
                inside = False
            elif inside:
                meta.append(bare)
            elif bare:
                comments.append(bare)
        elif line.strip():
            rows.append([float(x) for x in line.split()])
    names = [c.strip() for c in comments[-1].split("\t")]
    units = {n.split(" ")[0]: n.split(" ")[1].strip("[]") if " " in n else "" for n in names}
    allowed = {"area_um": "um^2", "volume": "um^3", "emodulus": "kPa", "deform": ""}
    for n, u in units.items():
        if n in allowed and u != allowed[n]:
            raise ValueError(f"{n} must be in {allowed[n] or 'no unit'}, not {u!r}")
    return pd.DataFrame(rows, columns=list(units)), json.loads(" ".join(meta)) if meta else {}


def load_lut(text: str) -> Lut:
    table, meta = parse_mtext(text)
    x = "volume" if "volume" in table else "area_um"
    return Lut(table[[x, "deform", "emodulus"]].to_numpy(), x, float(meta.get("channel_width", 20)), float(meta.get("flow_rate", 0.04)), float(meta.get("fluid_viscosity", 15)), meta.get("identifier", ""), meta)


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles (indices) of points in the plane, by inserting one point after another."""
    n = len(xy)
    lo, hi = xy.min(0), xy.max(0)
    span = max(*(hi - lo), 1e-12) * 1e3
    mid = (lo + hi) / 2
    p = np.vstack([xy, mid + [-span, -span], mid + [span, -span], mid + [0, span]])

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            return (0.0, 0.0, np.inf)
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d
        uy = (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        return (ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2)

    tri = [(n, n + 1, n + 2)]
    circles = [circle(tri[0])]
    for i in range(n):
        c = np.array(circles)
        bad = np.flatnonzero((c[:, 0] - p[i, 0]) ** 2 + (c[:, 1] - p[i, 1]) ** 2 <= c[:, 2] * (1 + 1e-12))
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            for a, b in ((0, 1), (1, 2), (2, 0)):
                e = tuple(sorted((tri[t][a], tri[t][b])))
                edges[e] = edges.get(e, 0) + 1
        gone = set(bad.tolist())
        tri = [t for k, t in enumerate(tri) if k not in gone]
        circles = [t for k, t in enumerate(circles) if k not in gone]
        for (a, b), times in edges.items():
            if times == 1:
                tri.append((a, b, i))
                circles.append(circle(tri[-1]))
    kept = [t for t in tri if max(t) < n]
    out = np.array(kept, int).reshape(-1, 3)
    a, b, c = xy[out[:, 0]], xy[out[:, 1]], xy[out[:, 2]]
    area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    return out[np.abs(area) > 1e-14]


class Interpolator:
    """Piecewise linear interpolation over triangles; NaN outside."""

    def __init__(self, xy: np.ndarray, values: np.ndarray, cells: int = 64):
        self.triangles = triangulate(xy)
        self.values = values
        self.corner = xy[self.triangles]
        self.lo, self.hi, self.cells = xy.min(0), xy.max(0), cells
        box_lo, box_hi = self._cell(self.corner.min(1)), self._cell(self.corner.max(1))
        self.members: dict[int, list[int]] = {}
        for t, (a, z) in enumerate(zip(box_lo, box_hi)):
            for i in range(a[0], z[0] + 1):
                for j in range(a[1], z[1] + 1):
                    self.members.setdefault(i * cells + j, []).append(t)

    def _cell(self, p: np.ndarray) -> np.ndarray:
        span = np.where(self.hi > self.lo, self.hi - self.lo, 1)
        return np.clip(np.floor((p - self.lo) / span * self.cells), 0, self.cells - 1).astype(int)

    def __call__(self, p: np.ndarray) -> np.ndarray:
        out = np.full(len(p), np.nan)
        some = np.flatnonzero(np.isfinite(p).all(1) & (p >= self.lo).all(1) & (p <= self.hi).all(1))
        cell = self._cell(p[some])
        key = cell[:, 0] * self.cells + cell[:, 1]
        order = np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
        for a, z in zip(start, np.append(start[1:], len(key))):
            rows = some[a:z]
            for t in self.members.get(int(key[a]), ()):
                open_ = rows[np.isnan(out[rows])]
                if not len(open_):
                    break
                (ax, ay), (bx, by), (cx, cy) = self.corner[t]
                x, y = p[open_].T
                det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
                u = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / det
                v = ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / det
                w = 1 - u - v
                inside = (u >= -1e-12) & (v >= -1e-12) & (w >= -1e-12)
                f = self.values[self.triangles[t]]
                out[open_[inside]] = u[inside] * f[0] + v[inside] * f[1] + w[inside] * f[2]
        return out


def normalised(lut: Lut) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Points on the unit scale, values, and the largest x and deform."""
    top_x, top_d = lut.points[:, 0].max(), lut.points[:, 1].max()
    return lut.points[:, :2] / [top_x, top_d], lut.points[:, 2], float(top_x), float(top_d)


class ExtrapolationWarning(UserWarning):
    """Values beyond the table were asked for, and may mean nothing."""


#: Deformations up to this are never extrapolated: the table is too steep there.
LEAST_DEFORM = 0.05


class SmoothSurface:
    """A smoothing surface z(x, y): tensor products of cubic B-splines whose coefficients solve penalised normal equations.

    It begins with one polynomial piece; pieces are doubled until the sum of squared residuals is at most `allowed` (the number
    of points by default), or there are as many as points allow. The penalty on second differences of coefficients only
    settles those that the points leave open. Beyond the points' ranges the values of the border hold.
    """

    DEGREE, PENALTY, MOST = 3, 1e-8, 32

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, allowed: float | None = None):
        self.x0, self.x1, self.y0, self.y1 = x.min(), x.max(), y.min(), y.max()
        allowed = len(z) if allowed is None else allowed
        self.pieces = 1
        while True:
            a, b = self._basis(x, self.x0, self.x1), self._basis(y, self.y0, self.y1)
            k = a.shape[1]
            design = (a[:, :, None] * b[:, None, :]).reshape(len(z), k * k)
            second = np.diff(np.eye(k), 2, axis=0)
            rough = np.kron(second.T @ second, np.eye(k)) + np.kron(np.eye(k), second.T @ second)
            normal = design.T @ design
            self.coefficients = np.linalg.solve(normal + self.PENALTY * np.trace(normal) / k**2 * (rough + 1e-6 * np.eye(k * k)), design.T @ z)
            self.residual = float(((design @ self.coefficients - z) ** 2).sum())
            if self.residual <= allowed or 2 * self.pieces > self.MOST or (2 * self.pieces + self.DEGREE) ** 2 > len(z):
                break
            self.pieces *= 2

    def _basis(self, v: np.ndarray, lo: float, hi: float) -> np.ndarray:
        """Uniform B-splines at v, by de Boor's recursion: a row for each value."""
        t = (np.clip(v, lo, hi) - lo) / ((hi - lo) or 1.0) * self.pieces
        knots = np.arange(-self.DEGREE, self.pieces + self.DEGREE + 1.0)
        place = np.minimum(np.floor(t), self.pieces - 1)
        out = (place[:, None] == knots[None, :-1]).astype(float)
        for d in range(1, self.DEGREE + 1):
            left, right = (t[:, None] - knots[None, : -d - 1]) / d, (knots[None, d + 1 :] - t[:, None]) / d
            out = left * out[:, :-1] + right * out[:, 1:]
        return out

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self._basis(x, self.x0, self.x1), self._basis(y, self.y0, self.y1)
        k = a.shape[1]
        return np.einsum("ni,ij,nj->n", a, self.coefficients.reshape(k, k), b)


def emodulus(lut: Lut, x: Column | str, deform: Column | str, channel_width: float, flow_rate: float, viscosity: Column | float, pixel_um: float = 0.34, extrapolate: bool = False) -> Column:
    """Young's modulus in kPa of events; NaN outside the table. Pixelation is taken off first if pixel_um isn't 0.

    With `extrapolate` (SCL-11), events outside whose deformation is above LEAST_DEFORM get the value of a smoothing surface
    through that part of the table; a warning is given, since that is seldom justified."""
    xy, values, top_x, top_d = normalised(lut)
    interpolate = Interpolator(xy, values)
    size = as_column(x).cast("double")
    d = as_column(deform).cast("double")
    if pixel_um:
        d = d - pixelation_delta(lut.x, "deform", pixel_um, size)
    u = scale_feature(lut.x, size, channel_width, lut.channel_width) / top_x

    surface, least = None, LEAST_DEFORM / top_d
    if extrapolate:
        warnings.warn("values beyond a look-up table may mean nothing", ExtrapolationWarning, stacklevel=2)
        crop = xy[:, 1] > least
        surface = SmoothSurface(xy[crop, 0], xy[crop, 1], values[crop]) if crop.any() else None

    @F.pandas_udf("double")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            at = np.column_stack([a.to_numpy(float), b.to_numpy(float)])
            found = interpolate(at)
            if surface is not None:
                beyond = np.isnan(found) & (at[:, 1] > least) & np.isfinite(at).all(axis=1)
                found[beyond] = surface(*at[beyond].T)
            yield pd.Series(found)

    base = F.coalesce(look_up(u, d / top_d), F.lit(NAN))  # pandas batches give NaN as null
    return scale_feature("emodulus", base, lut.channel_width, channel_width, lut.flow_rate, flow_rate, lut.fluid_viscosity, viscosity)


def diagnose(df: DataFrame, column: str) -> dict:
    """How many events have no value, and whether these are more than a tenth."""
    r = df.agg(F.count("*").alias("n"), F.count_if(F.isnan(column) | F.col(column).isNull()).alias("missing")).first()
    return {"n": r.n, "missing": r.missing, "exceeds": r.n > 0 and r.missing > 0.1 * r.n}


def isoelastics(spark: SparkSession, text: str) -> DataFrame:
    """Lines of equal stiffness: (emodulus, line array<struct<x, deform>>), ordered by x."""
    table, meta = parse_mtext(text)
    x = "volume" if "volume" in table else "area_um"
    return isoelastic_lines(spark.createDataFrame(table.rename(columns={x: "x"})[["x", "deform", "emodulus"]]))


def isoelastic_lines(points: DataFrame) -> DataFrame:
    """Points (x, deform, emodulus) as lines (emodulus, line), ordered by x."""
    return points.groupBy("emodulus").agg(F.sort_array(F.collect_list(F.struct("x", "deform"))).alias("line"))


def convert_isoelastics(points: DataFrame, feature: str = "area_um", width_in: float = 20.0, width_out: float = 20.0, flow_in: float = 0.04, flow_out: float = 0.04, viscosity_in: float = 15.0, viscosity_out: float = 15.0, pixel_um: float = 0.0) -> DataFrame:
    """Rows (x, deform, emodulus) put on another channel, flow and viscosity, optionally with pixelation added."""
    x = scale_feature(feature, F.col("x"), width_in, width_out)
    out = points.withColumns({"x": x, "emodulus": scale_feature("emodulus", F.col("emodulus"), width_in, width_out, flow_in, flow_out, viscosity_in, viscosity_out)})
    return out.withColumn("deform", F.col("deform") + pixelation_delta(feature, "deform", pixel_um, F.col("x"))) if pixel_um else out


def swapped(points: DataFrame) -> DataFrame:
    """The same lines with circularity in place of deformation."""
    return points.select("x", (1 - F.col("deform")).alias("circ"), "emodulus")


class MeaninglessStiffnessWarning(UserWarning):
    """Isoelastics have their own stiffness, since the measurement doesn't tell its viscosity."""


class Isoelastics:
    """Sets of isoelastics by identifier and pair of features (ISO-01, ISO-04). A set of deform serves circ too, and either
    order of the features."""

    def __init__(self):
        self._sets: dict[tuple[str, str], tuple[DataFrame, float, float, float]] = {}

    def add(self, points: DataFrame, feature: str, identifier: str, channel_width: float, flow_rate: float, viscosity: float) -> None:
        """points (x, deform, emodulus), x being `feature`: area_um or volume."""
        if feature not in ("area_um", "volume"):
            raise ValueError(f"no isoelastics over {feature!r}")
        if not identifier:
            raise ValueError("isoelastics need the identifier of their table")
        self._sets[identifier, feature] = (points.select("x", "deform", "emodulus"), float(channel_width), float(flow_rate), float(viscosity))

    def load(self, spark: SparkSession, text: str) -> str:
        """Add a set from text with a header, and give its identifier."""
        table, meta = parse_mtext(text)
        x = "volume" if "volume" in table else "area_um"
        identifier = meta.get("lut identifier") or meta.get("identifier", "")
        self.add(spark.createDataFrame(table.rename(columns={x: "x"})[["x", "deform", "emodulus"]]), x, identifier, meta["channel_width"], meta["flow_rate"], meta["fluid_viscosity"])
        return identifier

    def identifiers(self) -> list[str]:
        return sorted({i for i, _ in self._sets})

    def get(self, first: str, second: str, identifier: str, channel_width: float, flow_rate: float | None = None, viscosity: float | None = None, pixel_um: float = 0.0) -> DataFrame:
        """Lines (emodulus, line array<struct<first, second>>) for a channel, flow and viscosity; without these two, those of the
        set. pixel_um adds the pixelation of measured data."""
        pair = {first, second}
        feature = next(iter(pair & {"area_um", "volume"}), None)
        other = next(iter(pair & {"deform", "circ"}), None)
        if len(pair) != 2 or feature is None or other is None or (identifier, feature) not in self._sets:
            raise KeyError(f"no isoelastics of {first} and {second} in {identifier!r}")
        points, width, flow, eta = self._sets[identifier, feature]
        out = convert_isoelastics(points, feature, width, channel_width, flow, flow if flow_rate is None else flow_rate, eta, eta if viscosity is None else viscosity, pixel_um)
        side = F.col("deform") if other == "deform" else 1 - F.col("deform")
        named = {feature: F.col("x"), other: side}
        point = F.struct(F.col("x").alias("_x"), F.struct(*[named[n].alias(n) for n in (first, second)]).alias("p"))
        lines = out.groupBy("emodulus").agg(F.sort_array(F.collect_list(point)).alias("line"))
        return lines.select("emodulus", F.transform("line", lambda p: p["p"]).alias("line"))

    def get_for(self, first: str, second: str, meta, identifier: str, viscosity: float | None = None, pixelated: bool = False) -> DataFrame:
        """The lines for a measurement's metadata. Without a viscosity it follows from medium and temperature; if these are
        missing the set's own is taken, with a warning."""
        width, flow = meta.get("setup", "channel width"), meta.get("setup", "flow rate")
        if viscosity is None and meta.get("setup", "temperature") is not None and meta.get("setup", "medium"):
            points = next(iter(self._sets.values()))[0]
            found = points.sparkSession.range(1).select(viscosity_of(meta.get("setup", "medium"), float(meta.get("setup", "temperature")), width, flow))
            viscosity = found.first()[0]
        elif viscosity is None:
            warnings.warn("stiffness of the isoelastics isn't that of the measurement", MeaninglessStiffnessWarning, stacklevel=2)
        return self.get(first, second, identifier, width, flow, viscosity, meta.get("imaging", "pixel size") if pixelated else 0.0)
