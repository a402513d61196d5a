"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contamination contract: digits, lower-case letters and everything outside ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only, so that offsets stay the same."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.gettempdir()  # one machine only, as in tests
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table of its own in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/flowloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: Column) -> DataFrame:
    """left join right on the key, without one task for the keys that most rows of left have: rows of right for which `hot`
    is true, at most a thousand or so by the caller's bound, are sent to all tasks; the others are shuffled."""
    sent, rest = right.where(hot), right.where(~hot)
    near = left.join(F.broadcast(sent), key)
    far = left.join(F.broadcast(sent.select(key)), key, "left_anti").join(rest, key)
    return near.unionByName(far)


class TwoAgeCache:
    """A dict of bounded size: when the young half is full it becomes the old half, and the old half goes."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, words: set) -> list:
        """The words that have no value yet; others are in `young` afterwards."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for w in words.difference(young):
            v = old.get(w)
            if v is None:
                out.append(w)
            else:
                young[w] = v
        return out
