"""Basins: features that live in other datasets, joined only if they are asked for (JOIN-01 to JOIN-06, JOIN-12)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Order in which kinds and formats of basins are tried.
KINDS = ("internal", "file", "remote")
FORMATS = ("parquet", "dict", "hdf5", "http", "s3", "rest")

#: Numbers that a basin of known rows may hold to be sent whole to all tasks, and for how many of them a text or an array counts.
SENT, LONG = 1 << 17, 1 << 10


@dataclass(frozen=True)
class Basin:
    """Another dataset's features. mapping "same" joins row by row, else by the named map column of the referrer. rows: how many
    there are, if it is known; else Spark judges by the bytes of files, which may be few for many rows."""

    df: DataFrame
    key: str = "event_idx"
    mapping: str = "same"
    kind: str = "file"
    format: str = "parquet"
    features: tuple[str, ...] | None = None
    identifier: str | None = None
    name: str = ""
    basins: tuple[Basin, ...] = ()
    rows: int | None = None

    def offers(self) -> list[str]:
        own = [c for c in self.df.columns if c != self.key]
        return [c for c in own if self.features is None or c in self.features]


def priority(b: Basin) -> tuple:
    return (KINDS.index(b.kind), FORMATS.index(b.format) if b.format in FORMATS else len(FORMATS), b.mapping != "same", b.name)


def verify(b: Basin, run_identifier: str | None) -> bool:
    """A basin belongs to a measurement if the identifiers are equal or, for mapped basins, one begins with the other."""
    if b.identifier is None or run_identifier is None:
        return True
    return run_identifier == b.identifier if b.mapping == "same" else run_identifier.startswith(b.identifier)


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """df as a side of a join, that Spark may send to all tasks only if these are few rows. By itself it goes by the compressed bytes of
    files, and millions of numbers that compress to a few MB would be gathered on the driver."""
    if rows is None:
        return df
    width = sum(LONG if k in ("string", "binary") or k.startswith(("array", "map", "struct")) else 1 for _, k in df.dtypes)
    return df if rows * width <= SENT else df.hint("merge")


def join_basin(df: DataFrame, b: Basin, features: Sequence[str], key: str = "event_idx") -> DataFrame:
    """df with some of the basin's features: a left join by place or by map. A basin of known rows is broadcast only if they are few."""
    side = bounded(b.df.select(F.col(b.key).alias("_basin"), *features), b.rows)
    left = key if b.mapping == "same" else b.mapping
    return df.join(side, df[left] == F.col("_basin"), "left").drop("_basin")


def resolve(df: DataFrame, wanted: Sequence[str], basins: Sequence[Basin], key: str = "event_idx", run_identifier: str | None = None, seen: frozenset = frozenset()) -> DataFrame:
    """df with the wanted features that it lacks, each from the first basin that has it; a basin that gives nothing is not
    joined. Basins of basins are looked into; one that has been met on the way is skipped."""
    df, missing = resolve_some(df, wanted, basins, key, run_identifier, seen)
    if missing:
        raise KeyError(f"no basin has {', '.join(missing)}")
    return df


def reachable(basins: Sequence[Basin], run_identifier: str | None, seen: frozenset = frozenset()) -> set[str]:
    """The features that these basins and their basins have."""
    out: set[str] = set()
    for b in basins:
        if id(b) not in seen and verify(b, run_identifier):
            out |= set(b.offers()) | reachable(b.basins, b.identifier, seen | {id(b)})
    return out


def resolve_some(df: DataFrame, wanted: Sequence[str], basins: Sequence[Basin], key: str = "event_idx", run_identifier: str | None = None, seen: frozenset = frozenset()) -> tuple[DataFrame, list[str]]:
    """As resolve, and what no basin has. Each basin is joined once, whatever number of its features is wanted."""
    missing = [f for f in wanted if f not in df.columns]
    for b in sorted(basins, key=priority):
        if not missing:
            break
        if id(b) in seen or not verify(b, run_identifier):
            continue
        source = b
        inner = sorted(reachable(b.basins, b.identifier, seen | {id(b)}) & {f for f in missing if f not in b.offers()})
        if inner:
            deeper = resolve(b.df, inner, b.basins, b.key, b.identifier, seen | {id(b)})
            source = Basin(deeper, b.key, b.mapping, b.kind, b.format, None, b.identifier, b.name, rows=b.rows)
        here = [f for f in missing if f in source.offers()]
        if here:
            df = join_basin(df, source, here, key)
            missing = [f for f in missing if f not in here]
    return df, missing


BASIN_JSON = "name string, mapping string, kind string, format string, key string, features array<string>, identifier string"


def definitions(df: DataFrame, column: str) -> DataFrame:
    """df with the fields of the basin definitions that a column holds as JSON (JSN-01); broken text gives nulls."""
    return df.withColumn("_d", F.from_json(column, BASIN_JSON)).select(*df.columns, "_d.*")


def compose_map(child_map: DataFrame, parent_map: DataFrame) -> DataFrame:
    """(event_idx, basin_idx) of an export (JOIN-12): child_map (event_idx, root_idx) through parent_map (root_idx, basin_idx)."""
    return child_map.join(parent_map, "root_idx").select("event_idx", "basin_idx")


def frame_match(left: DataFrame, right: DataFrame, place: str, frame: str, value: str) -> DataFrame:
    """As-of match (JOIN-08): for each row of left, the row of right with the same frame at the nearest place, at most two
    away; nearer places first, and of equals the earlier one. Equi-joins on shifted places, no band join."""
    offset = F.explode(F.array(*map(F.lit, (0, -1, 1, -2, 2))))
    shifted = left.select(place, frame).withColumn("_o", offset).withColumn("_p", F.col(place) + F.col("_o"))
    side = right.select(F.col(place).alias("_p"), F.col(frame).alias("_f"), value)
    rank = F.abs("_o") * 2 + (F.col("_o") > 0).cast("int")
    met = shifted.join(side, (shifted["_p"] == side["_p"]) & (shifted[frame] == side["_f"]))
    best = met.groupBy(place).agg(F.min_by(F.struct(shifted["_p"].alias("matched"), value), rank).alias("m"))
    return left.join(best, place, "left").select(*left.columns, "m.matched", F.col(f"m.{value}").alias(f"matched_{value}"))
