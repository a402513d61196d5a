"""Sources and the native store (SRC-01 to SRC-09, SRC-17, SRC-27 to SRC-32, SRC-35 to SRC-39, SNK-01, SNK-05 to SNK-14).

A stored measurement is a folder: events/ (Parquet), meta.json, logs/ (Parquet: log, line_no, text), tables/<name>/ and
basins.json. All reading and writing goes through Spark's file systems, so that any path that Spark knows will do:
local, hdfs, s3a, http and so on.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.catalog import Catalog, Metadata
from flowloom.frame import EventFrame
from flowloom.operators.basins import Basin
from flowloom.operators.gates import Polygon
from flowloom.sources import defects
from flowloom.sources.defects import Defect

#: Features that are kept as whole numbers.
WHOLE = re.compile(r"fl[123]_(max|npeaks)|index|ml_class|nevents|frame|basinmap[0-9]")


def open_dataset(spark: SparkSession, source, meta: dict | None = None, catalog: Catalog | None = None) -> EventFrame:
    """A measurement from a dict of columns, a pandas or Spark DataFrame, a frame (its child), or the path or URL of a
    store or of a Parquet, CSV or JSON file."""
    catalog = catalog or Catalog()
    if isinstance(source, EventFrame):
        return source.child()
    if isinstance(source, DataFrame):
        if "event_idx" not in source.columns:
            raise ValueError("a DataFrame needs the key event_idx: its rows have no order")
        return EventFrame(source, Metadata().update(meta or {}), catalog=catalog)
    if isinstance(source, dict) or type(source).__name__ == "DataFrame":
        return from_columns(spark, source, meta, catalog)
    if isinstance(source, str):
        path = source.removeprefix("file:") if source.startswith("file:/") and not source.startswith("file://") else source
        suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if suffix in ("parquet", "csv", "json"):
            reader = spark.read.option("header", True).option("inferSchema", True) if suffix == "csv" else spark.read
            return open_dataset(spark, getattr(reader, suffix)(path), meta, catalog)
        return read_store(spark, path, catalog)
    raise NotImplementedError(f"can't open {type(source).__name__}")


def from_columns(spark: SparkSession, columns, meta: dict | None = None, catalog: Catalog | None = None) -> EventFrame:
    """A dict of equally long columns, or a pandas DataFrame; unknown features are an error (SRC-03)."""
    import pandas as pd

    catalog = catalog or Catalog()
    names = list(columns)
    for n in names:
        if not catalog.exists(n) and n != "event_idx":
            raise ValueError(f"unknown feature {n!r}")
    data = pd.DataFrame({n: [v.tolist() if hasattr(v, "tolist") else v for v in columns[n]] if not catalog.exists(n, True) else columns[n] for n in names})
    if "event_idx" not in data:
        data.insert(0, "event_idx", range(len(data)))
    df = spark.createDataFrame(data)
    for n in names:
        if catalog.exists(n, True):
            df = df.withColumn(n, F.col(n).cast("long" if WHOLE.fullmatch(n) else "double"))
    return EventFrame(df, Metadata().update(meta or {}), catalog=catalog)


def _one_text(spark: SparkSession, path: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("wholetext", True).text(path).limit(1).collect()
    except AnalysisException:
        return None
    return rows[0][0] if rows else None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_store(frame: EventFrame, path: str, features: Sequence[str] | None = None, gated: bool = True, mode: str = "overwrite", logs: bool = True, tables: bool = True, basins: bool = True) -> None:
    """Write the (gated) events' features (stored ones by default), metadata, logs, tables and basin definitions.

    index is numbered anew in the order of events, without gathering them; with gates the run gets an identifier of its
    own, derived from what was written. mode "append" continues the numbers.
    """
    spark = frame.df.sparkSession
    f = frame.with_features(*[n for n in features or () if n not in frame.df.columns])
    df = f.gated() if gated else f.df
    names = list(features) if features is not None else [c for c in df.columns if frame.catalog.exists(c)]
    from flowloom.operators.sample import with_rank

    start = 0
    if mode == "append":
        last = spark.read.parquet(f"{path}/events").agg(F.max("event_idx")).first()[0]
        start = 0 if last is None else last + 1
    ranked = with_rank(df, frame.key, "_new").withColumn("_new", F.col("_new") + start)
    keep = [n for n in names if n not in ("index", "event_idx")]
    out = ranked.select(F.col("_new").alias("event_idx"), (F.col("_new") + 1).alias("index"), F.col(frame.key).alias("root_idx"), *keep)
    out.write.mode(mode).option("compression", "zstd").parquet(f"{path}/events")
    n = spark.read.parquet(f"{path}/events").count()
    meta = Metadata(frame.meta.persistent()).copy().set("experiment", "event count", n)
    if gated and (frame.gating or frame.limit or frame.excluded is not None) and frame.run_identifier:
        mark = hashlib.md5(f"{frame.run_identifier}{n}{frame.gating}{frame.limit}".encode()).hexdigest()[:7]
        meta.set("experiment", "run identifier", f"{frame.run_identifier}_gated-{mark}")
    _write_text(spark, f"{path}/meta.json", json.dumps(meta.values, sort_keys=True))
    if logs and frame.logs:
        rows = [(k, i, t) for k, lines in frame.logs.items() for i, t in enumerate(lines)]
        spark.createDataFrame(rows, "log string, line_no int, text string").write.mode("overwrite").parquet(f"{path}/logs")
    if tables:
        for k, t in frame.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/tables/{k}")
        _write_text(spark, f"{path}/tables.json", json.dumps(sorted(frame.tables)))
    if basins:
        defs = [{"name": b.name, "mapping": b.mapping, "kind": b.kind, "format": b.format, "key": b.key, "features": b.features, "identifier": b.identifier} for b in frame.basins if b.name]
        _write_text(spark, f"{path}/basins.json", json.dumps(defs, sort_keys=True))


def read_store(spark: SparkSession, path: str, catalog: Catalog | None = None, basins: bool = True, known_defects: Sequence[Defect] = defects.STANDARD) -> EventFrame:
    """A stored measurement without its defective features; basins are opened by their names, which are paths."""
    meta = Metadata(json.loads(_one_text(spark, f"{path}/meta.json") or "{}"))
    logs: dict[str, list[str]] = {}
    try:
        for r in spark.read.parquet(f"{path}/logs").orderBy("log", "line_no").toLocalIterator():
            logs.setdefault(r.log, []).append(r.text)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df = defects.hide(spark.read.parquet(f"{path}/events"), meta, known_defects, tuple(logs))
    tables = {k: spark.read.parquet(f"{path}/tables/{k}") for k in json.loads(_one_text(spark, f"{path}/tables.json") or "[]")}
    found = []
    for d in json.loads(_one_text(spark, f"{path}/basins.json") or "[]") if basins else []:
        other = spark.read.parquet(d["name"] if d["name"].endswith(".parquet") else f"{d['name']}/events")
        found.append(Basin(other, d["key"], d["mapping"], d["kind"], d["format"], tuple(d["features"]) if d["features"] else None, d["identifier"], d["name"], rows=other.count()))
    return EventFrame(df, meta, basins=tuple(found), logs=logs, tables=tables, catalog=catalog or Catalog())


def find_measurements(spark: SparkSession, folder: str) -> list[str]:
    """Stores under a folder (SRC-17)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder).select("path")
    return sorted({m[1] for r in files.collect() if (m := re.match(r"(.*)/meta\.json/", r.path))})


def with_run(path_column="path"):
    """Project name from a path: its last two folders (SRC-17)."""
    return F.regexp_extract(path_column, r"([^/]+/[^/]+)/?$", 1)


def parse_polygons(text: str) -> list[Polygon]:
    """Polygons in sections `[Polygon n]` with axes, name, inverted and numbered points (SRC-32)."""
    out, now = [], None

    def done(p):
        points = [v for _, v in sorted(p["points"].items())]
        out.append(Polygon(p["x"], p["y"], tuple(points), p.get("inverted", False), p.get("name", "")))

    for line in text.splitlines():
        line = line.strip()
        if line.lower().startswith("[polygon"):
            if now:
                done(now)
            now = {"points": {}}
        elif "=" in line and now is not None:
            k, v = (x.strip() for x in line.split("=", 1))
            low = k.lower()
            if low in ("x axis", "y axis"):
                now[low[0]] = v.lower()
            elif low == "name":
                now["name"] = v
            elif low == "inverted":
                now["inverted"] = v.lower() == "true"
            elif low.startswith("point"):
                now["points"][int(low[5:])] = tuple(float(x) for x in v.split())
    if now:
        done(now)
    return out


def polygons_text(polygons: Sequence[Polygon]) -> str:
    """The same format (SNK-23)."""
    out = []
    for i, p in enumerate(polygons):
        out += [f"[Polygon {i:08d}]", f"X Axis = {p.x}", f"Y Axis = {p.y}", f"Name = {p.name}", f"Inverted = {p.inverted}"]
        out += [f"point{k:08d} = {x:.15e} {y:.15e}" for k, (x, y) in enumerate(p.points)] + [""]
    return "\n".join(out)


def is_remote(url: str) -> bool:
    return bool(re.match(r"(https?|s3a?|hdfs|abfss?|gs)://", url))


def copy_store(spark: SparkSession, source: str, target: str, features: str | Sequence[str] = "all", logs: bool = True, basins: bool = True) -> None:
    """Projection copy (SNK-14): all features, "scalar", "none" or a list; also recompresses."""
    f = read_store(spark, source, basins=False)
    names = [c for c in f.df.columns if f.catalog.exists(c)]
    if features == "scalar":
        names = [c for c in names if f.catalog.exists(c, True)]
    elif features == "none":
        names = []
    elif features != "all":
        names = [c for c in names if c in features]
    write_store(replace(f, logs=f.logs if logs else {}), target, names, gated=False, basins=False)
    if basins and (text := _one_text(spark, f"{source}/basins.json")):
        _write_text(spark, f"{target}/basins.json", text)
