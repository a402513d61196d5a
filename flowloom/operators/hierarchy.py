"""Stacked gates: children of gated datasets and the maps between their indices (SRC-27, JOIN-07, JOIN-09, FLT-12).

Every child keeps root_idx, the row's place in the root, so that manual exclusions and values set on a child survive any
change of the gates above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.numeric import NAN
from flowloom.operators.sample import with_rank


def as_root(df: DataFrame, key: str = "event_idx") -> DataFrame:
    return df.withColumn("root_idx", F.col(key))


def child(parent: DataFrame, gate: Column, hidden: DataFrame | None = None) -> DataFrame:
    """The parent's rows that pass, renumbered: parent_idx (0-based place in the parent), event_idx (0-based) and index
    (1-based) in the child. hidden: a table of root_idx to leave out; ids that the parent lacks stay on it unharmed."""
    base = parent if "root_idx" in parent.columns else as_root(parent)
    kept = base.where(gate)
    if hidden is not None:
        kept = kept.join(hidden.select("root_idx").distinct(), "root_idx", "left_anti")
    ranked = with_rank(kept.drop("parent_idx").withColumnRenamed("event_idx", "parent_idx"), "parent_idx", "event_idx")
    return ranked.withColumn("index", F.col("event_idx") + 1)


def index_map(child_df: DataFrame) -> DataFrame:
    """(child_idx, parent_idx, root_idx) for all rows of a child."""
    return child_df.select(F.col("event_idx").alias("child_idx"), "parent_idx", "root_idx")


def child_to(child_df: DataFrame, ids: DataFrame, level: str = "parent") -> DataFrame:
    """(child_idx, <level>_idx) for the given child_idx."""
    return index_map(child_df).join(ids.select("child_idx"), "child_idx").select("child_idx", f"{level}_idx")


def to_child(child_df: DataFrame, ids: DataFrame, level: str = "parent") -> DataFrame:
    """(<level>_idx, child_idx) for the given ids of a parent or root; ids that the child lacks are dropped."""
    return index_map(child_df).join(ids.select(f"{level}_idx"), f"{level}_idx").select(f"{level}_idx", "child_idx")


def visible(child_df: DataFrame, hidden: DataFrame) -> DataFrame:
    """Of the hidden root ids, those whose rows the ungated child would show (SET-04)."""
    return hidden.select("root_idx").distinct().join(child_df.select("root_idx"), "root_idx", "left_semi")


def scatter_to_root(root: DataFrame, values: DataFrame, name: str, key: str = "event_idx") -> DataFrame:
    """root with a feature set on a child, (root_idx, value); NaN elsewhere."""
    return root.join(values.select(F.col("root_idx").alias(key), F.col("value").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(NAN)))
