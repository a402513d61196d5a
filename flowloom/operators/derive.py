"""Derived features: recipes with requirements and priorities, resolved by name (UDF-01 to UDF-04, SCL-01 to SCL-09)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.catalog import Metadata
from flowloom.functions import geometry, physics
from flowloom.operators import lut as lut_ops


@dataclass(frozen=True)
class Recipe:
    """How one or more features come from others. build(context) gives a Column, or a dict of them."""

    names: tuple[str, ...]
    build: Callable[[Context], Column | dict[str, Column]]
    features: tuple[str, ...] = ()
    config: tuple[tuple[str, str], ...] = ()
    when: Callable[[Context], bool] = lambda c: True
    priority: int = 0
    identifier: str = ""


@dataclass
class Context:
    """What a recipe may use: metadata, look-up tables, and the names that are there."""

    meta: Metadata
    luts: dict
    have: set[str]

    def number(self, section: str, key: str) -> float:
        return float(self.meta.get(section, key))


def _crosstalk(ctx: Context) -> dict[str, float]:
    pairs = [(a, b) for a in "123" for b in "123" if a != b]
    return {a + b: float(v) for a, b in pairs if (v := ctx.meta.get("calculation", f"crosstalk fl{a}{b}")) is not None}


def _channels(ctx: Context) -> list[int]:
    return [k for k in (1, 2, 3) if f"fl{k}_max" in ctx.have]


def _ctc_ready(ctx: Context) -> bool:
    own, ct = _channels(ctx), _crosstalk(ctx)
    need = {f"{a}{b}" for a in own for b in own if a != b}
    if len(own) == 3 and ct and not need <= set(ct):
        raise ValueError("the spill-over matrix lacks " + ", ".join(sorted(need - set(ct))))
    return len(own) > 1 and need <= set(ct)


def _ctc(ctx: Context) -> dict[str, Column]:
    own = {k: F.col(f"fl{k}_max") for k in _channels(ctx)}
    ct = {k: v for k, v in _crosstalk(ctx).items() if int(k[0]) in own and int(k[1]) in own}
    return {f"fl{k}_max_ctc": physics.compensated(own, ct, k) for k in own}


def _in_channel(ctx: Context) -> bool:
    return ctx.meta.get("setup", "chip region", "channel") == "channel" and ctx.meta.get("calculation", "emodulus lut") in ctx.luts


def _stiffness(viscosity: Callable[[Context], Column | float]) -> Callable[[Context], Column]:
    def build(ctx: Context) -> Column:
        lut = ctx.luts[ctx.meta.get("calculation", "emodulus lut")]
        return lut_ops.emodulus(lut, lut.x, "deform", ctx.number("setup", "channel width"), ctx.number("setup", "flow rate"), viscosity(ctx), ctx.number("imaging", "pixel size"))

    return build


def _medium_viscosity(temperature: Callable[[Context], Column | float]) -> Callable[[Context], Column]:
    return lambda c: physics.viscosity(c.meta.get("calculation", "emodulus medium") or c.meta.get("setup", "medium"), temperature(c), c.number("setup", "channel width"), c.number("setup", "flow rate"), c.meta.get("calculation", "emodulus viscosity model", "buyukurganci-2022"))


_LUT = (("calculation", "emodulus lut"), ("imaging", "pixel size"), ("setup", "channel width"), ("setup", "flow rate"))


def _basic(name: str, features: tuple[str, ...], key: tuple[str, str] | None = None) -> Recipe:
    return Recipe((name,), lambda c: physics.derived(name, {key[1]: c.meta.get(*key)} if key else None), features, (key,) if key else ())


def _shape(ctx: Context) -> dict[str, Column]:
    m = geometry.moments(F.col("contour.x"), F.col("contour.y"))
    return {"inert_ratio_raw": geometry.inert_ratio(m["mu20"], m["mu02"]), "inert_ratio_prnc": geometry.principal_ratio(m["mu20"], m["mu02"], m["mu11"]), "tilt": geometry.tilt(m["mu20"], m["mu02"], m["mu11"])}


def _hull(ctx: Context) -> Column:
    h = geometry.hull(F.col("contour.x").cast("array<double>"), F.col("contour.y").cast("array<double>"))
    m = geometry.moments(h["x"], h["y"])
    return geometry.inert_ratio(m["mu20"], m["mu02"])


def _bright(ctx: Context) -> dict[str, Column]:
    b = geometry.brightness(F.col("image"), F.col("mask"))
    return {"bright_avg": b["avg"], "bright_sd": b["sd"]}


def _bright_bc(ctx: Context) -> dict[str, Column]:
    b = geometry.brightness(F.col("image"), F.col("mask"), F.col("image_bg"), F.col("bg_off") if "bg_off" in ctx.have else 0.0)
    return {"bright_bc_avg": b["avg"], "bright_bc_sd": b["sd"], "bright_perc_10": b["perc_10"], "bright_perc_90": b["perc_90"]}


#: Features that cost no more than reading what they are made of.
RAPID = frozenset({"area_ratio", "area_um", "aspect", "deform", "index", "time", *(f"fl{k}_max_ctc" for k in (1, 2, 3))})

STANDARD: tuple[Recipe, ...] = (
    _basic("time", ("frame",), ("imaging", "frame rate")),
    _basic("area_ratio", ("area_cvx", "area_msd")),
    _basic("area_um", ("area_cvx",), ("imaging", "pixel size")),
    _basic("aspect", ("size_x", "size_y")),
    _basic("deform", ("circ",)),
    Recipe(("index",), lambda c: F.col("event_idx") + 1, ("event_idx",)),
    Recipe(tuple(f"fl{k}_max_ctc" for k in (1, 2, 3)), _ctc, when=_ctc_ready),
    Recipe(("ml_class",), lambda c: physics.ml_class({n: F.col(n) for n in c.have if n.startswith("ml_score_")}), when=lambda c: any(n.startswith("ml_score_") for n in c.have)),
    Recipe(("inert_ratio_raw", "inert_ratio_prnc", "tilt"), _shape, ("contour",)),
    Recipe(("inert_ratio_cvx",), _hull, ("contour",)),
    Recipe(("volume",), lambda c: geometry.volume(F.col("contour.x"), F.col("contour.y"), F.col("pos_x"), F.col("pos_y"), c.number("imaging", "pixel size")), ("contour", "pos_x", "pos_y"), (("imaging", "pixel size"),)),
    Recipe(("bright_avg", "bright_sd"), _bright, ("image", "mask")),
    Recipe(("bright_bc_avg", "bright_bc_sd", "bright_perc_10", "bright_perc_90"), _bright_bc, ("image", "image_bg", "mask")),
    Recipe(("emodulus",), _stiffness(_medium_viscosity(lambda c: c.number("calculation", "emodulus temperature"))), ("area_um", "deform"), (*_LUT, ("calculation", "emodulus temperature")), _in_channel, 5, "fixed temperature"),
    Recipe(("emodulus",), _stiffness(lambda c: c.number("calculation", "emodulus viscosity")), ("area_um", "deform"), (*_LUT, ("calculation", "emodulus viscosity")), _in_channel, 2, "given viscosity"),
    Recipe(("emodulus",), _stiffness(_medium_viscosity(lambda c: F.col("temp"))), ("area_um", "deform", "temp"), _LUT, _in_channel, 0, "measured temperature"),
)


def plugin(info: dict) -> Recipe:
    """A recipe from a plugin's dict: "method" (context -> Column or dict), "feature names", "features required",
    "config required" ([[section, [keys]]]), "identifier", "priority"."""
    if "method" not in info or not info.get("feature names"):
        raise ValueError("a plugin needs a method and feature names")
    config = tuple((s, k) for s, keys in info.get("config required", []) for k in keys)
    return Recipe(tuple(info["feature names"]), info["method"], tuple(info.get("features required", ())), config, info.get("method check required", lambda c: True), info.get("priority", 0), info.get("identifier", ""))


class Resolver:
    """Finds recipes for features that a dataset lacks."""

    def __init__(self, recipes: Sequence[Recipe] = STANDARD):
        self.recipes = list(recipes)

    def choose(self, name: str, have: set[str], meta: Metadata, luts: dict, asked: frozenset = frozenset()) -> Recipe | None:
        """The available recipe of the highest priority, requirements being resolved in turn; None if there is none."""
        for r in sorted((r for r in self.recipes if name in r.names), key=lambda r: -r.priority):
            ctx = Context(meta, luts, self._reach(have, meta, luts, asked | {name}) if not r.features else have)
            if any(meta.get(*k) is None for k in r.config):
                continue
            if any(f not in have and (f in asked or self.choose(f, have, meta, luts, asked | {name}) is None) for f in r.features):
                continue
            if r.when(ctx):
                return r
        return None

    def _reach(self, have: set[str], meta: Metadata, luts: dict, asked: frozenset) -> set[str]:
        return have

    def add(self, df: DataFrame, names: Sequence[str], meta: Metadata, luts: dict | None = None, have: set[str] | None = None) -> DataFrame:
        """df with the named features; all outputs of a recipe come from one projection."""
        luts = luts or {}
        for name in names:
            if name in df.columns:
                continue
            r = self.choose(name, set(df.columns), meta, luts)
            if r is None:
                raise KeyError(f"feature {name!r} can't be derived")
            df = self.add(df, r.features, meta, luts)
            made = r.build(Context(meta, luts, set(df.columns)))
            df = df.withColumns({k: v for k, v in (made if isinstance(made, dict) else {r.names[0]: made}).items() if k not in df.columns})
        return df

    def available(self, df: DataFrame, meta: Metadata, luts: dict | None = None) -> list[str]:
        have = set(df.columns)
        return sorted(n for n in {n for r in self.recipes for n in r.names} - have if self.choose(n, have, meta, luts or {}))
