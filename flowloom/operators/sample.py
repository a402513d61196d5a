"""Reproducible sampling and density-aware thinning (TOP-01 to TOP-05, WIN-04, WIN-05)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.numeric import finite, scaled

SEED = 47
GRID = 300


def hash_order(key: str, seed: int = SEED) -> Column:
    """A pseudo-random order that depends on the key and seed only, never on partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def take_hashed(df: DataFrame, n: int, key: str = "event_idx", seed: int = SEED) -> DataFrame:
    """n rows in hash order (all if n is 0). One key per row is assumed; equal keys are taken in hash order of themselves."""
    return df if not n else df.orderBy(hash_order(key, seed), key).limit(n)


#: take_exact permutes all positions on the driver (8 bytes each) and refuses more rows than these.
EXACT_LIMIT = 20_000_000


def take_exact(df: DataFrame, n: int, key: str = "event_idx", seed: int = SEED) -> DataFrame:
    """n rows by numpy's legacy generator over row positions, for bit-equal results on inputs that a driver can number:
    more than EXACT_LIMIT rows are refused, take_hashed has no such bound.

    Positions are ranks of the key; the chosen ranks (n numbers) are joined back.
    """
    total = df.count()
    if not n or n >= total:
        return df
    if total > EXACT_LIMIT:
        raise ValueError(f"{total} rows are too many to number on the driver; use take_hashed")
    chosen = np.random.RandomState(seed).choice(total, size=n, replace=False)
    ranks = df.sparkSession.createDataFrame([(int(i),) for i in np.sort(chosen)], "_rank long")
    return with_rank(df, key).join(F.broadcast(ranks), "_rank", "left_semi").drop("_rank")


def with_rank(df: DataFrame, key: str, name: str = "_rank", cell_bits: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """0-based rank by an integer key, within each value of the columns `by`, without a single-task window however the keys
    are spread: ranks within cells of 2**cell_bits keys, plus the sizes of the cells before in groups of 2**cell_bits
    cells, and so on up; no window sees more than 2**cell_bits distinct values."""
    cell = F.shiftright(F.col(key).cast("long"), cell_bits)
    celled = df.withColumn("_cell", cell)
    before = _before([*by], celled.groupBy(*by, "_cell").agg(F.count("*").alias("_n")), cell_bits, 64 - cell_bits)
    own = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(key)) - 1
    return celled.withColumn(name, own).join(before, [*by, "_cell"]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_cell", "_before")


def _before(by: list[str], sizes: DataFrame, bits: int, left: int) -> DataFrame:
    """(by..., _cell, _before): how many rows lie in smaller cells, from (by..., _cell, _n); `left` bits of cells remain."""
    if left <= bits:
        window = Window.partitionBy(*by) if by else Window.partitionBy()
        total = F.sum("_n").over(window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        return sizes.select(*by, "_cell", F.coalesce(total, F.lit(0)).alias("_before"))
    grouped = sizes.withColumn("_up", F.shiftright("_cell", bits))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_up").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    above = _before(by, grouped.groupBy(*by, F.col("_up").alias("_cell")).agg(F.sum("_n").alias("_n")), bits, left - bits)
    above = above.select(*by, F.col("_cell").alias("_up"), F.col("_before").alias("_above"))
    placed = grouped.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(above, [*by, "_up"])
    return placed.select(*by, "_cell", (F.col("_inside") + F.col("_above")).alias("_before"))


def grid_cells(df: DataFrame, x: str, y: str, grid: int = GRID) -> DataFrame:
    """df with cell numbers cx, cy on a grid over the ranges of x and y; a constant column is one cell wide."""
    r = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))

    def cell(c: str, lo: str, hi: str) -> Column:
        span = F.col(hi) - F.col(lo)
        return F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(lo), span) * (grid - 1)), F.lit(0)).cast("int")

    joined = df.crossJoin(F.broadcast(r))  # one row of four numbers
    return joined.withColumns({"cx": cell(x, "_x0", "_x1"), "cy": cell(y, "_y0", "_y1")}).drop("_x0", "_x1", "_y0", "_y1")


def first_per_cell(df: DataFrame, x: str, y: str, key: str = "event_idx", grid: int = GRID) -> DataFrame:
    """The earliest event of each cell (WIN-04), with its cell. An aggregate, so that a crowded cell is combined early."""
    celled = grid_cells(df, x, y, grid)
    return celled.groupBy("cx", "cy").agg(F.min(key).alias(key))


def thin(df: DataFrame, x: str, y: str, n: int, key: str = "event_idx", remove_invalid: bool = True, scale: tuple[str, str] = ("linear", "linear"), grid: int = GRID) -> DataFrame:
    """Density-aware sample of n events (TOP-03): first events of cells, then events added or removed in hash order.

    Events with a coordinate that isn't finite only pad the sample, and only with remove_invalid=False. n = 0 takes all.
    """
    placed = df.withColumns({"_x": scaled(F.col(x), scale[0]).cast("double"), "_y": scaled(F.col(y), scale[1]).cast("double")})
    good = placed.where(finite("_x") & finite("_y"))
    if not n:
        kept = good
    else:
        first = first_per_cell(good, "_x", "_y", key, grid).select(key, F.lit(0).alias("_late"))
        ranked = good.join(first, key, "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
        kept = ranked.orderBy("_late", hash_order(key), key).limit(n).drop("_late")
    out = kept.drop("_x", "_y")
    if remove_invalid:
        return out
    bad = placed.where(~(finite("_x") & finite("_y"))).drop("_x", "_y")
    if not n:
        return out.unionByName(bad)
    both = out.withColumn("_bad", F.lit(0)).unionByName(bad.withColumn("_bad", F.lit(1)))
    return both.orderBy("_bad", hash_order(key), key).limit(n).drop("_bad")
