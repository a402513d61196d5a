"""Store of feature groups with versions (SNK-05, SNK-06, SNK-09, SNK-10, AGG-08).

A measurement is a folder of immutable Parquet parts, each with event_idx and some features, and of manifests that are numbered
from 1. A manifest names the parts of each group of features, their statistics, the basin maps and the basins. A change writes new parts
and then the next manifest, by a rename that fails if that number is taken: readers keep the version they began with, of two
writers at once one begins anew, and replacing a feature touches no other. Object stores without an exclusive rename need a single writer.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.catalog import Catalog, Metadata
from flowloom.frame import EventFrame
from flowloom.functions.numeric import finite_or_null
from flowloom.operators.basins import Basin, bounded
from flowloom.operators.sample import with_rank

#: Basin maps that a measurement may have.
MAPS = 10


class StoreConflict(RuntimeError):
    """Another writer has made this version."""


class GroupStore:
    """A store at a path that Spark's file systems know. Every method works on the newest version or the one that was opened."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = self._read(version)

    # ---- versions ----------------------------------------------------------------------------------------------

    def _files(self):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, fs = self._files()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, version: int | None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "events": 0, "groups": [], "maps": {}, "basins": {}, "meta": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version:08d}.json").first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        manifest = manifest | {"version": self.manifest["version"] + 1}
        jvm, fs = self._files()
        new = jvm.org.apache.hadoop.fs.Path
        final, draft = new(f"{self.path}/manifests/{manifest['version']:08d}.json"), new(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise StoreConflict(f"version {manifest['version']} of {self.path} exists") from None
            raise
        self.manifest = manifest

    def _change(self, change: Callable[[dict], dict], retries: int = 5) -> None:
        """Commit what change makes of the newest manifest; after a conflict it is made anew of the next one."""
        for left in range(retries, -1, -1):
            self.manifest = self._read(None)
            try:
                return self._commit(change(json.loads(json.dumps(self.manifest))))
            except StoreConflict:
                if not left:
                    raise

    # ---- features ----------------------------------------------------------------------------------------------

    @property
    def features(self) -> dict[str, dict]:
        """The group of each feature."""
        return {f: g for g in self.manifest["groups"] for f in g["features"]}

    def count(self) -> int:
        return self.manifest["events"]

    def _part(self, df: DataFrame, names: Sequence[str]) -> tuple[str, dict, int, int]:
        """Write (event_idx, names) as a part: its folder, statistics, rows and last event."""
        folder = f"parts/{uuid.uuid4().hex}"
        df.select("event_idx", *names).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        kinds = dict(df.dtypes)
        scalar = [n for n in names if kinds[n] in ("double", "float", "bigint", "int", "smallint", "tinyint") or kinds[n].startswith("decimal")]
        back = self.spark.read.parquet(f"{self.path}/{folder}")
        sums = [f(finite_or_null(n)).alias(f"{k} {n}") for n in scalar for k, f in (("count", F.count), ("min", F.min), ("max", F.max), ("sum", F.sum))]
        r = back.agg(F.count("*").alias("rows"), F.max("event_idx").alias("last"), *sums).first().asDict()
        return folder, {n: {k: r[f"{k} {n}"] for k in ("count", "min", "max", "sum")} | {"size": r["rows"]} for n in scalar}, r["rows"], -1 if r["last"] is None else r["last"]

    @staticmethod
    def _merged(a: dict, b: dict) -> dict:
        """Statistics of two parts of a feature taken together. The mean is that of the parts' means, weighted with their sizes."""
        pick = lambda f, k: f([x[k] for x in (a, b) if x[k] is not None], default=None)
        mean = lambda x: x.get("mean", x["sum"] / x["count"] if x["count"] else None)
        known = [(mean(x), x["size"]) for x in (a, b) if mean(x) is not None]
        size = sum(n for _, n in known)
        out = {"count": a["count"] + b["count"], "min": pick(min, "min"), "max": pick(max, "max"), "sum": math.fsum(x["sum"] or 0 for x in (a, b)), "size": a["size"] + b["size"]}
        return out | {"mean": sum(m * n for m, n in known) / size if size else None}

    def append(self, df: DataFrame, names: Sequence[str] | None = None, key: str = "event_idx") -> GroupStore:
        """Add events, numbered on in the order of `key`, to all groups. After the first time, the features must be the store's."""
        names = [c for c in df.columns if c != key] if names is None else list(names)
        local = with_rank(df.select(F.col(key).alias("_key"), *names), "_key", "_at").drop("_key")

        def change(m: dict) -> dict:
            if not m["groups"]:
                m["groups"] = [{"features": names, "parts": [], "statistics": {}}]
            stored = sorted(f for g in m["groups"] for f in g["features"])
            if stored != sorted(names):
                raise ValueError(f"the store has {', '.join(stored)}; got {', '.join(sorted(names))}")
            rows = 0
            for g in m["groups"]:
                folder, found, rows, _ = self._part(local.select((F.col("_at") + m["events"]).cast("bigint").alias("event_idx"), *g["features"]), g["features"])
                g["parts"].append(folder)
                g["statistics"] = {f: self._merged(g["statistics"][f], s) if f in g["statistics"] else s for f, s in found.items()}
            m["events"] += rows
            return m

        self._change(change)
        return self

    def replace(self, df: DataFrame, names: Sequence[str] | None = None) -> GroupStore:
        """Put features (event_idx, names) in the place of stored ones, or add them. All events must be there, each once; parts
        of other features are neither read nor written, and a part goes out of use when none of its features is left."""
        names = [c for c in df.columns if c != "event_idx"] if names is None else list(names)
        self._change(lambda m: self._replaced(m, df, names))
        return self

    def _replaced(self, m: dict, df: DataFrame, names: list[str]) -> dict:
        """The manifest with a new part for these features."""
        folder, found, rows, last = self._part(df, names)
        distinct = self.spark.read.parquet(f"{self.path}/{folder}").select("event_idx").distinct().count()
        if m["groups"] and not rows == distinct == m["events"] == last + 1:
            raise ValueError(f"{rows} rows of {distinct} events up to {last}; the store has {m['events']}")
        for g in m["groups"]:
            g["features"] = [f for f in g["features"] if f not in names]
            g["statistics"] = {f: s for f, s in g["statistics"].items() if f not in names}
        m["groups"] = [g for g in m["groups"] if g["features"]] + [{"features": names, "parts": [folder], "statistics": found}]
        m["events"] = m["events"] or rows
        return m

    def set_metadata(self, meta: Metadata) -> GroupStore:
        self._change(lambda m: m | {"meta": meta.persistent()})
        return self

    def read(self, *names: str) -> DataFrame:
        """(event_idx, names) of this version, all by default; groups that hold none of the names aren't touched."""
        names = names or tuple(self.features)
        out = None
        for g in self.manifest["groups"]:
            here = [n for n in names if n in g["features"]]
            if here:
                part = self._group(g).select("event_idx", *here)
                out = part if out is None else out.join(bounded(part, self.count()), "event_idx")
        if out is None or set(names) - set(self.features):
            raise KeyError(f"the store lacks {', '.join(sorted(set(names) - set(self.features))) or 'features'}")
        return out.select("event_idx", *names)

    def _group(self, g: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in g["parts"]])

    def frame(self, catalog: Catalog | None = None) -> EventFrame:
        """The measurement: the largest group's features, the other groups and the basins being joined only if asked for."""
        groups = sorted(self.manifest["groups"], key=lambda g: -len(g["features"]))
        if not groups:
            raise KeyError("the store is empty")
        inner = [Basin(self._group(g), kind="internal", features=tuple(g["features"]), rows=self.count()) for g in groups[1:]]
        for b in self.manifest["basins"].values():
            if b["kind"] != "remote" and b["paths"]:
                at = b["paths"][0]
                store = None if at.rstrip("/").endswith(".parquet") else GroupStore(self.spark, at)
                other = self.spark.read.parquet(at) if store is None else store.read()
                rows = other.count() if store is None else store.count()
                inner.append(Basin(other, b["key"], b["mapping"], b["kind"], b["format"], tuple(b["features"]) if b["features"] else None, b["identifier"], b["name"], rows=rows))
        meta = Metadata(self.manifest["meta"]).copy().set("experiment", "event count", self.count())
        return EventFrame(self._group(groups[0]).select("event_idx", *groups[0]["features"]), meta, basins=tuple(inner), catalog=catalog or Catalog())

    def statistics(self) -> DataFrame:
        """(feature, n, min, max, mean, total) as kept with each commit: no event is read. The mean is of all finite values."""
        rows = [(f, s["count"], *(None if s[k] is None else float(s[k]) for k in ("min", "max")), s["sum"] / s["count"] if s["count"] else None, float(s["sum"] or 0)) for g in self.manifest["groups"] for f, s in g["statistics"].items()]
        return self.spark.createDataFrame(sorted(rows), "feature string, n long, min double, max double, mean double, total double")

    # ---- basins ------------------------------------------------------------------------------------------------

    def store_map(self, rows: DataFrame, name: str | None = None) -> str:
        """Keep a map (event_idx, basin_idx) of all events and give its name, basinmap0 to basinmap9. A map that is stored already is
        used again; equality is told by digests. An explicit name must be free or hold the same map."""
        digest = column_digest(rows, "basin_idx")

        def name_of(m: dict) -> str:
            equal = sorted(k for k, v in m["maps"].items() if v == digest)
            if name is not None:
                if m["maps"].get(name, digest) != digest:
                    raise ValueError(f"{name} holds another map")
                return name
            free = [f"basinmap{k}" for k in range(MAPS) if f"basinmap{k}" not in m["maps"]]
            if not equal and not free:
                raise ValueError(f"all {MAPS} basin maps are in use")
            return equal[0] if equal else free[0]

        def change(m: dict) -> dict:
            found = name_of(m)
            m = self._replaced(m, rows.select("event_idx", F.col("basin_idx").cast("bigint").alias(found)), [found])
            m["maps"][found] = digest
            return m

        self.manifest = self._read(None)
        if name_of(self.manifest) not in self.manifest["maps"]:
            self._change(change)  # the name is chosen again if another writer was first
        return name_of(self.manifest)

    def store_basin(self, name: str, paths: Sequence[str], kind: str = "file", format: str = "parquet", features: Sequence[str] | None = None, mapping: DataFrame | tuple[str, DataFrame] | None = None, identifier: str | None = None, key: str = "event_idx", description: str | None = None, catalog: Catalog | None = None) -> str:
        """Keep a basin's definition, once however often it is stored, and give its digest. A mapping is stored by store_map. The
        identifier must be the measurement's own, or with a mapping the beginning of it."""
        catalog = catalog or Catalog()
        for f in features or ():
            if not catalog.exists(f):
                raise ValueError(f"invalid feature {f!r}")
        own = self.manifest["meta"].get("experiment", {}).get("run identifier")
        if own and identifier and not (own == identifier or mapping is not None and own.startswith(identifier)):
            raise ValueError(f"the basin is of {identifier}, the measurement is {own}")
        at = "same" if mapping is None else self.store_map(mapping[1], mapping[0]) if isinstance(mapping, tuple) else self.store_map(mapping)
        b = {"name": name, "paths": list(paths), "kind": kind, "format": format, "features": sorted(features) if features is not None else None, "mapping": at, "identifier": identifier, "key": key, "description": description}
        digest = hashlib.md5(json.dumps(b, sort_keys=True).encode()).hexdigest()

        def change(m: dict) -> dict:
            m["basins"][digest] = b
            return m

        if digest not in self.manifest["basins"]:
            self._change(change)
        return digest

    def expire(self, keep: int = 1) -> int:
        """Delete the manifests before the last `keep` and all parts that no kept one names; gives the number of parts. Readers of older
        versions, and writers that haven't committed, must have ended."""
        known = self.versions()
        kept = [self._read(v) for v in known[-max(1, keep) :]]
        used = {p for m in kept for g in m["groups"] for p in g["parts"]}
        jvm, fs = self._files()
        new, gone = jvm.org.apache.hadoop.fs.Path, 0
        for s in fs.listStatus(new(f"{self.path}/parts")) if known else []:
            if f"parts/{s.getPath().getName()}" not in used:
                fs.delete(s.getPath(), True)
                gone += 1
        for v in known[: -max(1, keep)]:
            fs.delete(new(f"{self.path}/manifests/{v:08d}.json"), False)
        return gone


def column_digest(df: DataFrame, column: str, key: str = "event_idx", bits: int = 12) -> str:
    """A digest of a column in the order of an integer key that is neither null nor negative: blocks of 2^bits keys are hashed, then blocks of block digests,
    up to one. No task holds more than a block, unless keys repeat; only the last digest reaches the driver."""
    level = df.select(F.col(key).cast("bigint").alias("i"), F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("h"))
    for _ in range(0, 63, bits):
        block = level.groupBy(F.shiftright("i", bits).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("rows"))
        text = F.array_join(F.transform("rows", lambda r: F.concat(r["i"].cast("string"), F.lit(":"), r["h"])), ";")
        level = block.select(F.col("b").alias("i"), F.sha2(text, 256).alias("h"))
    r = level.first()
    return hashlib.sha256(b"").hexdigest() if r is None else r.h
