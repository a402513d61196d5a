"""Quality of stored files, from their footers alone (DQ-01, DQ-02, DQ-21): a scan in tasks that reads no event."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.catalog import Catalog
from flowloom.operators.quality import CUE, type_cues
from flowloom.sources.groups import GroupStore
from flowloom.sources.store import WHOLE

FOOTER = "file string, row_group int, feature string, codec string, type string, rows long, compressed long, uncompressed long"
#: Codecs that count as compression.
COMPRESSED = ("ZSTD", "GZIP", "BROTLI", "SNAPPY", "LZ4", "LZ4_RAW", "LZO")
FLOATS, WHOLES = ("DOUBLE", "FLOAT"), ("INT64", "INT32")


def footers(df: DataFrame) -> DataFrame:
    """A row for each column chunk of the Parquet files that df reads: (file, row_group, feature, codec, type, rows, compressed,
    uncompressed), with the feature's name down to the leaf. Only the files' names pass through the driver; tasks open the
    files where pyarrow can: local and mounted paths, s3, gs, abfs and, with its library, hdfs."""
    names = [(f,) for f in df.inputFiles()]
    files = df.sparkSession.createDataFrame(names, "file string").repartition(max(1, min(len(names), 4096)))

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for t in tables:
            for name in t.file:
                where, path = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
                with where.open_input_file(path) as f:
                    m = pq.ParquetFile(f).metadata
                for g in range(m.num_row_groups):
                    group = m.row_group(g)
                    cells = [group.column(k) for k in range(group.num_columns)]
                    yield pd.DataFrame({"file": name, "row_group": g, "feature": [c.path_in_schema for c in cells], "codec": [c.compression for c in cells], "type": [c.physical_type for c in cells], "rows": group.num_rows, "compressed": [c.total_compressed_size for c in cells], "uncompressed": [c.total_uncompressed_size for c in cells]})

    return files.mapInPandas(run, FOOTER)


def compression(chunks: DataFrame) -> tuple[str, int, int]:
    """"All", "None" or "Partial (a of b)", and a and b: the features that are compressed in all their chunks, and all."""
    named = chunks.groupBy(F.split("feature", r"\.")[0].alias("f")).agg(F.min(F.col("codec").isin(*COMPRESSED).cast("int")).alias("c"))
    r = named.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("a"), F.count("*").alias("b")).first()
    return ("All" if r.a == r.b else "None" if not r.a else f"Partial ({r.a} of {r.b})"), r.a, r.b


def column_cues(chunks: DataFrame, catalog: Catalog | None = None) -> list[tuple]:
    """Scalar features whose files hold other types than numbers, or several types; whole ones that hold fractions."""
    catalog = catalog or Catalog()
    kinds = chunks.where(~F.col("feature").contains(".")).groupBy("feature").agg(F.array_sort(F.collect_set("type")).alias("types")).collect()
    out = []
    for r in sorted(kinds):
        if catalog.exists(r.feature, True):
            allowed = WHOLES if WHOLE.fullmatch(r.feature) else FLOATS + WHOLES
            if set(r.types) - set(allowed) or len(r.types) > 1:
                out.append(("violation", "feature data", None, r.feature, f"{r.feature} is stored as {', '.join(r.types)}"))
    return out


def group_cues(store: GroupStore, chunks: DataFrame | None = None) -> list[tuple]:
    """DQ-01: what a manifest promises and the files don't have: internal features, maps of basins, or rows."""
    if chunks is None:
        chunks = _all_chunks(store)
    counts = {r.feature: r.n for r in chunks.where("feature = 'event_idx'").groupBy("feature").agg(F.sum("rows").alias("n")).collect()}
    there = {r[0] for r in chunks.select(F.split("feature", r"\.")[0]).distinct().collect()}
    out = [("violation", "basin data", None, f, f"missing internal feature {f}") for f in sorted(store.features) if f not in there]
    for b in sorted(store.manifest["basins"].values(), key=lambda b: b["name"]):
        if b["mapping"] != "same" and b["mapping"] not in store.features:
            out.append(("violation", "basin data", None, b["mapping"], f"basin {b['name']} lacks its map {b['mapping']}"))
    if counts.get("event_idx", 0) != store.count() * len(store.manifest["groups"]):
        out.append(("violation", "basin data", None, None, f"the groups have {counts.get('event_idx', 0)} rows together; {store.count()} each were expected"))
    return out


def _all_chunks(store: GroupStore) -> DataFrame:
    out = None
    for g in store.manifest["groups"]:
        part = footers(store._group(g))
        out = part if out is None else out.unionByName(part)
    return out


def check_store(spark: SparkSession, path: str, catalog: Catalog | None = None, others: Sequence[tuple] = ()) -> DataFrame:
    """Cues of a group store's files and of its metadata as stored."""
    store = GroupStore(spark, path)
    chunks = _all_chunks(store).cache()
    try:
        text, a, b = compression(chunks)
        rows = [("info", "general", None, None, f"Compression: {text}"), *group_cues(store, chunks), *column_cues(chunks, catalog), *type_cues(store.manifest["meta"]), *others]
    finally:
        chunks.unpersist()
    return spark.createDataFrame(rows, CUE)
