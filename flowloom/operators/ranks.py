"""Values at given ranks, for many groups at once and at any size (AGG-03, AGG-13).

All wanted ranks of all groups are narrowed together: one histogram of BINS bins over each range that still holds too many rows
tells which bins the ranks lie in, and these become the next ranges. A range ends when it holds one value or at most
`small` rows, which are then sorted. No state grows beyond that, and only counts of ranges reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.sources.scratch import settled

BINS = 4096
#: Rows of a range that one window may sort.
SMALL = 1 << 20
#: Tables of so many rows (of a few numbers each) may be sent to all tasks.
SENT = 1 << 16


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: str | None = None, also: Column | None = None) -> DataFrame:
    """left join right on the keys, nulls being equal, and on a further condition. right is sent to all tasks if it has at most SENT rows, which is
    counted; else those of its rows that a thousandth or more of left meets, by its column `rows`, and the others are shuffled."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})

    def on(table: DataFrame, how: str = "inner") -> DataFrame:
        both = F.lit(True) if also is None else also
        for k in keys:
            both = both & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return left.join(table, both, how)

    drop = [f"_r_{k}" for k in keys]
    if not keys or len(right.take(SENT + 1)) <= SENT:
        return on(F.broadcast(named)).drop(*drop)
    if rows is None:
        return on(named).drop(*drop)
    total = right.agg(F.sum(rows)).first()[0]
    hot = F.col(rows) * 1000 >= total
    near = on(F.broadcast(named.where(hot))).drop(*drop)
    return near.unionByName(on(named.where(~hot)).drop(*drop))


def _place(x: Column, lo: Column, hi: Column) -> Column:
    """Where x lies between lo and hi, from 0 to 1, never falling as x grows: by ratios where the range spans many orders of
    magnitude, so that skewed values are narrowed as fast as even ones."""
    top = F.greatest(F.abs(lo), F.abs(hi))
    wide = lambda v: F.signum(v) * F.ln(1 + F.abs(v) / (top * 1e-9))
    ratio = lambda a, b: F.ln(a / b)
    span = hi / 2 - lo / 2  # halves can't overflow
    even = (x / 2 - lo / 2) / span
    return (
        F.when((lo > 0) & (hi / lo > 64), ratio(x, lo) / ratio(hi, lo))
        .when((hi < 0) & (lo / hi > 64), 1 - ratio(x, hi) / ratio(lo, hi))
        .when((lo < 0) & (hi > 0) & (F.least(-lo, hi) * 64 < top), (wide(x) - wide(lo)) / (wide(hi) - wide(lo)))
        .otherwise(even)
    )


def _within(values: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """values (keys, x) that lie in one of the ranges of their keys, with its lo and hi."""
    return meet(values, ranges.select(*keys, "lo", "hi", "rows"), keys, "rows", F.col("x").between(F.col("lo"), F.col("hi"))).select(*keys, "x", "lo", "hi")


def _narrowed(values: DataFrame, ranges: DataFrame, keys: Sequence[str], small: int) -> DataFrame:
    """The bins of the ranges that hold their ranks, as ranges."""
    place = F.least(F.greatest(F.floor(_place(F.col("x"), F.col("lo"), F.col("hi")) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    # the ends have their own bins, so that each round parts them even where rounding would not
    bin_ = F.when(F.col("x") == F.col("lo"), -1).when(F.col("x") == F.col("hi"), BINS).otherwise(place)
    bins = _within(values, ranges, keys).groupBy(*keys, F.col("lo").alias("_lo"), bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max"))
    order = Window.partitionBy(*keys, "_lo").orderBy("_bin")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = meet(bins.withColumn("_before", before), ranges.select(*keys, F.col("lo").alias("_lo"), F.col("below"), "ranks"), [*keys, "_lo"])
    first = F.col("below") + F.col("_before")
    wanted = placed.withColumn("_own", F.filter("ranks", lambda k: (k >= first) & (k < first + F.col("_n"))))
    # neighbouring bins that hold ranks and few rows make one range
    joins = (F.size("_own") > 0) & (F.col("_n") <= small)
    part = lambda a, b, c: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("int").alias("c"))
    gaps = F.row_number().over(order) - F.sum(joins.cast("int")).over(order)
    run = F.when(joins, part(gaps, F.floor(F.col("_before") / small), F.lit(-2))).otherwise(part(F.lit(0), F.lit(0), F.col("_bin")))
    held = wanted.withColumn("_run", run).where(F.size("_own") > 0)
    grouped = held.groupBy(*keys, "_lo", "_run").agg(F.min("_min").alias("lo"), F.max("_max").alias("hi"), F.min(first).alias("below"), F.sum("_n").alias("rows"), F.flatten(F.collect_list("_own")).alias("ranks"))
    return grouped.select(*keys, "lo", "hi", "below", "rows", "ranks")


def select_ranks(values: DataFrame, keys: Sequence[str], wanted: DataFrame, small: int = SMALL, rounds: int = 100) -> DataFrame:
    """Rows (keys, rank, x): the value at each wanted 0-based rank of its group in rising order.

    values has (keys, x), x neither null nor NaN nor infinite; wanted has a row (keys, lo, hi, rows, ranks) for each group: least and greatest value,
    number of values and the distinct ranks. Null keys are groups like others.
    """
    keys = list(keys)
    ranges = settled(wanted.select(*keys, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0).cast("bigint").alias("below"), F.col("rows").cast("bigint").alias("rows"), F.col("ranks").cast("array<bigint>").alias("ranks")))
    is_open = (F.col("lo") < F.col("hi")) & (F.col("rows") > small)
    for _ in range(rounds):
        still = ranges.where(is_open)
        if still.isEmpty():
            break
        ranges = settled(ranges.where(~is_open).unionByName(_narrowed(values, still, keys, small)))
    else:
        raise ArithmeticError(f"the ranges have not ended after {rounds} rounds")
    same = ranges.where("lo = hi").select(*keys, F.explode("ranks").alias("rank"), F.col("lo").alias("x"))
    mixed = ranges.where("lo < hi")
    place = F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("x")) - 1
    sorted_ = _within(values, mixed, keys).withColumn("_place", place).drop("hi")
    ranks = mixed.select(*keys, "lo", F.explode("ranks").alias("rank"), (F.col("rank") - F.col("below")).alias("_place"))
    return same.unionByName(meet(sorted_, ranks, [*keys, "lo", "_place"]).select(*keys, "rank", "x"))


def quantiles(values: DataFrame, keys: Sequence[str], qs: Sequence[float], small: int = SMALL) -> DataFrame:
    """Rows (keys, q): linearly interpolated quantiles, an array in the order of qs, of each group of finite values (keys, x)."""
    keys = list(keys)
    sizes = settled(values.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("rows")).where("rows > 0"))
    places = [F.lit(float(q)) * (F.col("rows") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in places for f in (F.floor, F.ceil)]))
    found = select_ranks(values, keys, sizes.withColumn("ranks", ranks), small)
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_at"))

    def value(p: Column) -> Column:
        a, b = (F.element_at("_at", f(p).cast("bigint")) for f in (F.floor, F.ceil))
        return a + (b - a) * (p - F.floor(p))

    return meet(sizes, maps, keys).select(*keys, F.array(*map(value, places)).alias("q"))
