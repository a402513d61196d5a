"""Statistics of gated, finite values (AGG-01 to AGG-11)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.numeric import NAN, finite_or_null
from flowloom.operators import ranks

#: Above so many rows quantiles are selected rank by rank instead of by aggregates that hold all distinct values.
EXACT_ROWS = 1 << 20


class Quantile:
    """An exact, linearly interpolated quantile; `describe` takes all of a feature's quantiles from one aggregate."""

    def __init__(self, q: float):
        self.q = q

    def __call__(self, x: Column) -> Column:
        return F.percentile(x, F.lit(self.q))


#: Aggregates of one feature, by name; register more by adding to a copy of this.
METHODS: dict[str, Callable[[Column], Column]] = {
    "Mean": F.avg,
    "Median": Quantile(0.5),
    "SD": F.stddev_pop,
    "10th Percentile": Quantile(0.1),
    "25th Percentile": Quantile(0.25),
    "75th Percentile": Quantile(0.75),
    "90th Percentile": Quantile(0.9),
    "Min": F.min,
    "Max": F.max,
}


def _sketched(q: float) -> Callable[[Column], Column]:
    return lambda x: F.percentile_approx(x, F.lit(q), F.lit(10_000))


#: The same with quantiles from mergeable sketches (ranks off by 1/10,000 at most), for inputs of any size in one pass.
APPROXIMATE = METHODS | {"Median": _sketched(0.5), **{f"{round(100 * q)}th Percentile": _sketched(q) for q in (0.1, 0.25, 0.75, 0.9)}}


def _gated(gate: Column | None, x: Column) -> Column:
    return x if gate is None else F.when(F.coalesce(gate, F.lit(False)), x)


def aggregates(features: Sequence[str], methods: dict[str, Callable] | Sequence[str] = METHODS, gate: Column | None = None) -> list[Column]:
    """One aggregate for each feature and method, named "<method> <feature>"; empty input gives NaN."""
    table = methods if isinstance(methods, dict) else {m: METHODS[m] for m in methods}
    return [F.coalesce(f(_gated(gate, finite_or_null(c))), F.lit(NAN)).alias(f"{m} {c}") for c in features for m, f in table.items()]


def event_counts(gate: Column | None = None) -> list[Column]:
    """Gated events and the percentage that they are of all (AGG-06)."""
    inside = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    return [F.count_if(inside).alias("Events"), (F.avg(inside.cast("int")) * 100).alias("%-gated")]


def describe(df: DataFrame, features: Sequence[str], methods=METHODS, gate: Column | None = None, by: Sequence[str] = (), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Long form (by..., feature, method, value). Features that df lacks have NaN.

    Up to exact_rows rows a feature's quantiles share one aggregate, whose state holds its distinct values. Above, the ranks of
    all groups and features are narrowed together in a few passes of bounded state (`ranks.quantiles`)."""
    have = [f for f in features if f in df.columns]
    table = methods if isinstance(methods, dict) else {m: METHODS[m] for m in methods}
    qs = {m: f for m, f in table.items() if isinstance(f, Quantile)}
    rest = {m: f for m, f in table.items() if m not in qs}
    wanted = [q.q for q in qs.values()]
    select = bool(qs and have) and df.count() > exact_rows
    extra = [] if select or not qs else [F.percentile(_gated(gate, finite_or_null(f)), F.array(*map(F.lit, wanted))).alias(f"_q {f}") for f in have]
    grouped = df.groupBy(*by) if by else df.groupBy()
    wide = grouped.agg(F.count("*").alias("_n"), *aggregates(have, rest, gate), *extra)
    if select:
        values = df.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), _gated(gate, finite_or_null(f)).alias("x")) for f in have])).alias("v")).select(*by, F.col("v.f").alias("_f"), F.col("v.x").alias("x")).where("x is not null")
        found = ranks.quantiles(values, [*by, "_f"], wanted, exact_rows).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_f", "q"))).alias("_qs"))
        hot = wide.withColumnsRenamed({k: f"_w_{k}" for k in by})
        both = F.lit(True)
        for k in by:
            both = both & F.col(f"_w_{k}").eqNullSafe(F.col(k))
        wide = hot.join(found, both, "left").drop(*by).withColumnsRenamed({f"_w_{k}": k for k in by})
    sorts = {f: F.try_element_at("_qs", F.lit(f)) if select else F.col(f"`_q {f}`") for f in have}

    def cell(f: str, m: str) -> Column:
        if f not in have:
            return F.lit(NAN)
        return F.coalesce(sorts[f][list(qs).index(m)], F.lit(NAN)) if m in qs else F.col(f"`{m} {f}`")

    cells = [F.struct(F.lit(f).alias("feature"), F.lit(m).alias("method"), cell(f, m).cast("double").alias("value")) for f in features for m in table]
    return wide.select(*by, F.explode(F.array(*cells)).alias("s")).select(*by, "s.feature", "s.method", "s.value")


def exact_quantiles(df: DataFrame, feature: str, qs: Sequence[float], small: int = EXACT_ROWS, gate: Column | None = None) -> list[float]:
    """Linearly interpolated quantiles of any number of rows; NaN if none is finite. Only these numbers reach the driver."""
    x = df.select(_gated(gate, finite_or_null(feature)).alias("x")).where("x is not null")
    if df.count() <= small:
        found = x.agg(F.percentile("x", F.array(*map(F.lit, qs))).alias("q")).first().q
    else:
        rows = ranks.quantiles(x, [], qs, small).collect()
        found = rows[0].q if rows else None
    return [NAN] * len(qs) if found is None else list(found)


def mode(df: DataFrame, feature: str, gate: Column | None = None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Most frequent bin (AGG-05), one row (mode, n): bins of twice the interquartile range over the cube root of n,
    keys rounded half to even, ties to the smallest; NaN if the width is 0 or nothing is left."""
    x = df.select(_gated(gate, finite_or_null(feature)).alias("x")).where("x is not null")
    if df.count() <= exact_rows:
        s = x.agg(F.count("*").alias("m"), F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))
    else:
        q1, q3 = exact_quantiles(df, feature, [0.25, 0.75], exact_rows, gate)
        s = x.agg(F.count("*").alias("m"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"))
    width = F.when(F.col("m") > 0, 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("m").cast("double"), F.lit(1 / 3)))
    binned = x.crossJoin(F.broadcast(s.select(width.alias("w")))).select(F.when(F.col("w") != 0, F.rint(F.try_divide("x", "w")) * F.col("w") + F.col("w") / 2).otherwise(F.lit(NAN)).alias("mode"))
    top = binned.groupBy("mode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("mode")).limit(1)
    return top.groupBy().agg(F.coalesce(F.max("mode"), F.lit(NAN)).alias("mode"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def doane_width(feature: str) -> Column:
    """Bin width by Doane's formula (AGG-10) as one aggregate."""
    x = finite_or_null(feature)
    n, g1 = F.count(x).cast("double"), F.abs(F.skewness(x))
    sigma = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    ratio = F.when((sigma > 0) & g1.isNotNull() & ~F.isnan(g1), g1 / sigma)
    return (F.max(x) - F.min(x)) / (1 + F.log2(n) + F.log2(1 + ratio))


def doane_bins(feature: str) -> Column:
    """Number of bins; 5 where the width is 0 or unknown."""
    x, w = finite_or_null(feature), doane_width(feature)
    return F.when(F.coalesce(w, F.lit(0.0)) > 0, F.rint(F.try_divide(F.max(x) - F.min(x), w)).cast("int")).otherwise(5)


def percentile_width(feature: str) -> Column:
    """(p90 - p10) / 23, else a tenth of the range, else 1 (AGG-11)."""
    x = finite_or_null(feature)
    core = (F.percentile(x, F.lit(0.9)) - F.percentile(x, F.lit(0.1))) / 23
    spread = (F.max(x) - F.min(x)) / 10
    return F.when(core != 0, core).when(spread != 0, spread).otherwise(F.lit(1.0))


def percentile_widths(df: DataFrame, features: Sequence[str], exact_rows: int = EXACT_ROWS) -> list[float]:
    """percentile_width of each feature at any size, as numbers; None for one without finite values."""
    if df.count() <= exact_rows:
        return list(df.agg(*map(percentile_width, features)).first())
    r = describe(df, features, {"lo": F.min, "hi": F.max, "p10": Quantile(0.1), "p90": Quantile(0.9)}, exact_rows=exact_rows).collect()
    v = {(x.feature, x.method): x.value for x in r}
    out = []
    for f in features:
        core, spread = (v[f, "p90"] - v[f, "p10"]) / 23, (v[f, "hi"] - v[f, "lo"]) / 10
        out.append(None if math.isnan(core) else core or spread or 1.0)
    return out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
