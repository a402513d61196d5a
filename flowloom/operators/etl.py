"""Concatenation, splitting, condensing and exports (SET-01, SET-02, TOP-01, TOP-08, WIN-02, WIN-03, SNK-02, SNK-03, SNK-15 to SNK-17, DAT-01)."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.catalog import Metadata
from flowloom.frame import EventFrame
from flowloom.functions.numeric import all_of, finite
from flowloom.operators.sample import with_rank
from flowloom.operators.stats import union_all


def start_of(meta: Metadata) -> float:
    """Start of the measurement in seconds (UTC)."""
    own = meta.get("experiment", "timestamp")
    if own is not None:
        return float(own)
    text = f"{meta.get('experiment', 'date')} {meta.get('experiment', 'time')}"
    fmt = "%Y-%m-%d %H:%M:%S.%f" if "." in text else "%Y-%m-%d %H:%M:%S"
    return datetime.strptime(text, fmt).replace(tzinfo=timezone.utc).timestamp()


def run_order(meta: Metadata) -> str:
    return f"{meta.get('experiment', 'date')}_{meta.get('experiment', 'time')}_{meta.get('experiment', 'run index')}"


def concatenate(frames: Sequence[EventFrame]) -> EventFrame:
    """Measurements one after another (SET-01), in the order of their starts: features that all have; time and frame
    shifted by the starts' differences; index_online going on; events numbered anew. Metadata of the first, run index 1;
    logs of each under a prefix. One plan for all runs: one grouped aggregate, of which a few numbers for each run reach the
    driver, ranks within runs, and a join with the offsets."""
    runs = sorted(frames, key=lambda f: run_order(f.meta))
    shared = _shared([(f.df.columns, f.key) for f in runs])
    every = union_all([f.df.select(F.lit(i).alias("_run"), F.col(f.key).alias("_key"), *shared) for i, f in enumerate(runs)])
    out, total = _one_after_another(every, shared, [f.meta for f in runs])
    logs = {f"src-#{i + 1}_{k}": v for i, f in enumerate(runs) for k, v in f.logs.items()}
    meta = runs[0].meta.copy().set("experiment", "run index", 1).set("experiment", "event count", total)
    return replace(runs[0], df=out, meta=meta, logs=logs, basins=(), gating=(), excluded=None, key="event_idx")


def _shared(columns: Sequence[tuple[Sequence[str], str]]) -> list[str]:
    """Features that all runs have, without numbers that are given anew."""
    first, key = columns[0]
    return [c for c in first if all(c in other for other, _ in columns[1:]) and c not in (key, "index", "root_idx", "parent_idx")]


def _one_after_another(every: DataFrame, shared: list[str], metas: Sequence[Metadata]) -> tuple[DataFrame, int]:
    """Rows (_run, _key, shared) of all runs on one axis, and how many they are."""
    sums = [F.count("*").alias("n")] + ([F.max_by("index_online", "_key").alias("last")] if "index_online" in shared else [])
    found = {r["_run"]: r for r in every.groupBy("_run").agg(*sums).collect()}
    first, at, online, places = start_of(metas[0]), 0, 0, []
    for i, meta in enumerate(metas):
        shift = start_of(meta) - first
        places.append((i, at, shift, round(shift * float(meta.get("imaging", "frame rate", 0))), online))
        if i in found:
            at += found[i].n
            if "index_online" in shared:
                online += (found[i]["last"] or 0) + 1
    place = every.sparkSession.createDataFrame(places, "_run int, _at long, _shift double, _frames long, _online long")
    ranked = with_rank(every, "_key", "_i", by=("_run",)).join(F.broadcast(place), "_run")  # one row for each run
    change: dict[str, Column] = {"event_idx": F.col("_i") + F.col("_at"), "index": F.col("_i") + F.col("_at") + 1}
    change |= {c: F.col(c) + F.col(by) for c, by in (("time", "_shift"), ("frame", "_frames"), ("index_online", "_online")) if c in shared}
    return ranked.withColumns(change).select("event_idx", "index", *shared), at


def _bare(path: str) -> str:
    """A path without scheme and host slashes, by which a file's folder is recognised."""
    return "/" + re.sub(r"^[A-Za-z0-9+.-]+:/*", "", path).strip("/")


def concatenate_stores(spark: SparkSession, paths: Sequence[str]) -> EventFrame:
    """As concatenate, of stored measurements: runs with equal columns are one scan, so that thousands of runs of one
    instrument make one node of the plan. The driver reads each run's metadata, all in one job, and one footer of each. Logs stay with
    the runs."""
    at = {_bare(p): p for p in paths}
    if len(at) < len(paths):
        raise ValueError("a store is named twice")
    texts = spark.read.option("wholetext", True).text([f"{p}/meta.json" for p in paths]).select("value", "_metadata.file_path").collect()
    metas = {_bare(r.file_path.rsplit("/meta.json/", 1)[0]): Metadata(json.loads(r.value)) for r in texts}
    order = sorted(at, key=lambda k: run_order(metas[k]))
    schemas = {k: spark.read.parquet(f"{at[k]}/events").schema for k in order}
    shared = _shared([(schemas[k].names, "event_idx") for k in order])
    alike: dict[tuple, list[str]] = {}
    for k in order:
        alike.setdefault(tuple((f.name, f.dataType.simpleString()) for f in schemas[k]), []).append(k)
    number = spark.createDataFrame([(k, i) for i, k in enumerate(order)], "_folder string, _run int")
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("_file", "^(?:[A-Za-z0-9+.-]+:)?/*(.*)/events/[^/]*$", 1), "/+$", ""))
    parts = []
    for keys in alike.values():
        df = spark.read.schema(schemas[keys[0]]).parquet(*[f"{at[k]}/events" for k in keys]).select(F.col("event_idx").alias("_key"), *shared, F.col("_metadata.file_path").alias("_file"))
        parts.append(df.withColumn("_folder", folder).join(F.broadcast(number), "_folder").select("_run", "_key", *shared))
    out, total = _one_after_another(union_all(parts), shared, [metas[k] for k in order])
    meta = metas[order[0]].copy().set("experiment", "run index", 1).set("experiment", "event count", total)
    return EventFrame(out, meta)


def split(df: DataFrame, rows: int, key: str = "event_idx") -> DataFrame:
    """df with `part`, numbers of consecutive chunks of `rows` rows, and `part_idx` within; write it partitioned by part."""
    ranked = with_rank(df, key, "_i")
    return ranked.withColumns({"part": F.floor(F.col("_i") / rows).cast("int"), "part_idx": (F.col("_i") % rows).cast("long")}).drop("_i")


def condense(frame: EventFrame, ancillary: bool = True, basin: bool = True) -> EventFrame:
    """All scalar features, stored, derivable and in basins, as columns (SNK-17); arrays are dropped."""
    names = [c for c in frame.df.columns if frame.catalog.exists(c, True)]
    names += [n for n in (frame.features("basin") if basin else []) if n not in names and frame.catalog.exists(n, True)]
    names += [n for n in (frame.features("ancillary") if ancillary else []) if n not in names]
    full = frame.with_features(*names)
    return replace(full, df=full.df.select(frame.key, *sorted(set(names) - {frame.key})), basins=())


def tsv_lines(df: DataFrame, features: Sequence[str], key: str = "event_idx") -> DataFrame:
    """One line of tab-separated `%.10e` numbers for each event, (key, line); features sorted, without repeats (SNK-02)."""
    names = sorted({f.lower() for f in features})
    return df.select(key, F.concat_ws("\t", *[F.format_string("%.10e", F.col(n).cast("double")) for n in names]).alias("line"))


def write_tsv(frame: EventFrame, path: str, features: Sequence[str], meta_data: dict | None = None, gated: bool = True, one_file: bool = False) -> None:
    """Tab-separated text: part files of lines, and a header file beside them. one_file puts the lines into one part."""
    f = frame.with_features(*features)
    lines = tsv_lines(f.gated() if gated else f.df, features, frame.key)
    names = sorted({x.lower() for x in features})
    head = [f"# {k}: {v}" for k, v in (meta_data or {}).items()] + [f"# {x}" for x in frame.meta.to_text().splitlines() if x]
    head += ["# " + "\t".join(names), "# " + "\t".join(frame.catalog.label(n) if frame.catalog.exists(n) else n for n in names)]
    spark = frame.df.sparkSession
    spark.createDataFrame([("﻿" + "\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    ordered = lines.repartitionByRange(1, frame.key) if one_file else lines
    ordered.sortWithinPartitions(frame.key).select("line").write.mode("overwrite").text(f"{path}/lines")


def fcs_header(names: Sequence[str], events: int, meta: dict[str, str] | None = None) -> bytes:
    """Header and text segment of an FCS 3.0 file of big-endian 32-bit floats; data follow directly."""
    pairs = {"$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$BEGINSTEXT": "0", "$ENDSTEXT": "0", "$BYTEORD": "4,3,2,1", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": "0", "$PAR": str(len(names)), "$TOT": str(events)}
    for i, n in enumerate(names, 1):
        pairs |= {f"$P{i}B": "32", f"$P{i}E": "0,0", f"$P{i}N": n, f"$P{i}R": "262144"}
    pairs |= {k: v for k, v in (meta or {}).items()}
    size = 4 * len(names) * events
    begin = 256
    while True:
        body = pairs | {"$BEGINDATA": str(begin), "$ENDDATA": str(begin + size - 1 if size else begin)}
        text = ("/" + "/".join(f"{k}/{str(v).replace('/', '//')}" for k, v in body.items()) + "/").encode()
        if 58 + len(text) <= begin:
            break
        begin = -(-(58 + len(text) + 64) // 64) * 64
    last = begin + size - 1
    data = (f"{begin:>8}", f"{last:>8}") if last < 10**8 else (f"{0:>8}", f"{0:>8}")
    head = "FCS3.0    " + f"{58:>8}{58 + len(text) - 1:>8}" + "".join(data) + f"{0:>8}{0:>8}"
    return (head.encode() + text).ljust(begin, b" ")


def fcs_blocks(frame: EventFrame, features: Sequence[str], gated: bool = True) -> tuple[bytes, DataFrame]:
    """The header, and the events' bytes as rows (part, data) in the order of the key; concatenated they are an FCS file
    (SNK-03). Events with a value that isn't finite are left out. Bytes are made where the events are."""
    f = frame.with_features(*features)
    names, key = [x.lower() for x in features], frame.key
    df = (f.gated() if gated else f.df).where(all_of(finite(n) for n in names)).select(frame.key, *[F.col(n).cast("float").alias(n) for n in names])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            table = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(">f4")
            yield pa.RecordBatch.from_arrays([pa.array([b.column(key)[0].as_py()], pa.int64()), pa.array([table.tobytes()], pa.binary())], ["part", "data"])

    ordered = df.repartitionByRange(frame.key).sortWithinPartitions(frame.key)
    return fcs_header(names, df.count()), ordered.mapInArrow(run, "part long, data binary")


def write_fcs(frame: EventFrame, path: str, features: Sequence[str], gated: bool = True) -> None:
    """One FCS file on the driver's disk, written block by block as they arrive."""
    head, blocks = fcs_blocks(frame, features, gated)
    with open(path, "wb") as out:
        out.write(head)
        for r in blocks.orderBy("part").toLocalIterator():
            out.write(r.data)


def write_fcs_files(frame: EventFrame, folder: str, features: Sequence[str], gated: bool = True, rows: int = 1_000_000) -> DataFrame:
    """FCS files of at most `rows` events each, in the order of the key, written where the events are: (path, events) of each.

    Tasks open the folder where pyarrow can (local and mounted paths, s3, gs, abfs, hdfs), write under a name of their own and
    rename when all is written, so that a repeated task leaves one file. Events with a value that isn't finite are left out."""
    f = frame.with_features(*features)
    names = [x.lower() for x in features]
    df = (f.gated() if gated else f.df).where(all_of(finite(n) for n in names))
    ranked = with_rank(df.select(frame.key, *[F.col(n).cast("float").alias(n) for n in names]), frame.key, "_i")

    def write(table):
        import uuid

        import pandas as pd
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
        where.create_dir(base, recursive=True)
        data = table.sort_values("_i")[names].to_numpy(">f4").tobytes()
        name, draft = f"{base}/part-{int(table._part.iloc[0]):06d}.fcs", f"{base}/.draft-{uuid.uuid4().hex}"
        with where.open_output_stream(draft) as out:
            out.write(fcs_header(names, len(table)))
            out.write(data)
        where.move(draft, name)
        return pd.DataFrame({"path": [name], "events": [len(table)]})

    parts = ranked.withColumn("_part", F.floor(F.col("_i") / rows)).drop(frame.key)
    done = parts.groupBy("_part").applyInPandas(write, "path string, events long").collect()  # a row for each file
    return frame.df.sparkSession.createDataFrame(sorted(done), "path string, events long")


def read_fcs(data: bytes) -> tuple[list[str], list[tuple[float, ...]]]:
    """Names and events of such a file; for tests."""
    begin, end = int(data[10:18]), int(data[18:26])
    parts = data[begin : end + 1].decode().strip("/").split("/")
    pairs = dict(zip(parts[::2], parts[1::2]))
    n, m, at = int(pairs["$PAR"]), int(pairs["$TOT"]), int(pairs["$BEGINDATA"])
    return [pairs[f"$P{i}N"] for i in range(1, n + 1)], [struct.unpack_from(f">{n}f", data, at + 4 * n * k) for k in range(m)]
