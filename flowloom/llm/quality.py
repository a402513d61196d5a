"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import TwoAgeCache, crc_mod, read, settle, text_or_empty

#: Features after hashing (a power of two).
BUCKETS = 1 << 18
#: At most so many labelled rows are learned from; beyond, those with the smallest hashes of their ids.
MAX_TRAIN = 12_000
#: Parts of the training rows that are learned from side by side, and rounds after which their models are averaged.
SHARDS, ROUNDS = 6, 3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SCALE = 24.0


def _shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return zlib.crc32(token.encode("utf-8", "surrogatepass")) & 0x3FFF | 0x4000
    if token.isdigit():
        return 4
    if token.isupper():
        return 1 if len(token) > 1 else 2
    return 3 if token[0].isupper() else 5 if token.islower() else 6


def _number(token: str) -> int:
    """Hash of the lower-cased word above, its shape below."""
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) << 16 | _shape(token)


class Features:
    """Hashed 1- and 2-grams of words, and 1- to 3-grams of their shapes (upper case, title,
    digits, punctuation runs, said again)."""

    def __init__(self, buckets: int = BUCKETS):
        self.mask, self.cache = np.uint64(buckets - 1), TwoAgeCache()

    def ragged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all texts in one array, and how many each text has."""
        cut = [_TOKEN.findall(t) for t in texts]
        for w in self.cache.missing(set(chain.from_iterable(cut))):
            self.cache.young[w] = _number(w)
        sizes = np.array(list(map(len, cut)), np.int64)
        both = np.fromiter(map(self.cache.young.__getitem__, chain.from_iterable(cut)), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        word, shape = both >> np.uint64(16), both & np.uint64(0xFFFF)
        for back in (2, 1):  # a word said again has a shape of its own
            shape[back:][(word[back:] == word[:-back]) & (owner[back:] == owner[:-back])] = 6 + back
        found, owners = [], []
        for seed, value, n in ((1, word, 1), (2, word, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
            m = len(value) - n + 1
            if m <= 0:
                continue
            h = np.full(m, seed, np.uint64)
            for k in range(n):
                h = (h ^ value[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            same = owner[:m] == owner[n - 1 :]
            found.append((h[same] >> np.uint64(7)) & self.mask)
            owners.append(owner[:m][same])
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        who, what = np.concatenate(owners), np.concatenate(found).astype(np.int64)
        order = np.argsort(who, kind="stable")
        return what[order], np.bincount(who, minlength=len(texts))


def margins(weights: np.ndarray, bias: float, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sparse dot products: the mean weight of a text's features times a constant, plus the bias."""
    total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=weights[features], minlength=len(sizes))
    return _SCALE * total / np.maximum(sizes, 1) + bias


class Leader:
    """Follow-the-regularised-leader state; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, shards: int = SHARDS, rounds: int = ROUNDS, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Weights and bias from the rows of labels with crc32(doc_id) mod 3 other than 1 and quality 0 or 1.

    Conflicting labels of one id count as 1 if any is 1; of several texts of one id the least is learned from. Without usable labels all weights are 0, so that every score
    is 0.5. The rows are bounded by max_train, and so are the models that reach the driver: one for each shard.
    """
    spark = docs.sparkSession
    usable = labels.where((crc_mod(F.col("doc_id"), 3) != 1) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_train)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "order", "label").agg(F.min("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(buckets)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                flat, sizes = make.ragged(part.column("text").to_pylist())
                at, idx, val = 0, [], []
                for n in sizes.tolist():
                    u, c = np.unique(flat[at : at + n], return_counts=True)
                    idx.append(u.astype(np.uint32).tobytes())
                    val.append((c * (_SCALE / max(n, 1))).astype(np.float32).tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["order", "label", "idx", "val"])

    rows = settle(texts.select("order", "label", "text").mapInArrow(featurise, "order long, label int, idx binary, val binary").withColumn("shard", F.pmod(F.col("order"), F.lit(shards)).cast("int")))
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        def learn(tables):
            own = Leader(buckets)
            own.z[:], own.n[:] = start.value
            t = tables.sort_by("order")
            for label, idx, val in zip(t.column("label").to_pylist(), t.column("idx").to_pylist(), t.column("val").to_pylist()):
                at = np.append(np.frombuffer(idx, np.uint32).astype(np.int64), buckets)
                own.learn(at, np.append(np.frombuffer(val, np.float32), 1.0), label)
            return pa.table({"rows": [t.num_rows], "z": [own.z.astype(np.float32).tobytes()], "n": [own.n.astype(np.float32).tobytes()]})

        parts = rows.groupBy("shard").applyInArrow(learn, "rows long, z binary, n binary").collect()
        total = sum(p.rows for p in parts)
        if not total:
            break
        z = sum(np.frombuffer(p.z, np.float32).astype(float) * (p.rows / total) for p in parts)
        n = sum(np.frombuffer(p.n, np.float32).astype(float) * (p.rows / total) for p in parts)
    leader = Leader(buckets)
    leader.z, leader.n = z, n
    w = leader.weights()
    return w[:-1].astype(np.float32), float(w[-1])


def _score(batches: Iterator[pa.RecordBatch], column: int, shared, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    weights, bias = shared.value
    make = Features(buckets)
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            m = margins(weights, bias, *make.ragged([t or "" for t in part.column(column).to_pylist()]))
            yield part, 1 / (1 + np.exp(-np.clip(m, -35, 35)))


def classify(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, repeated rows included; no shuffle.

    Only the text is scored, whole, however long; an empty table gives no rows. Null and empty texts have no features, so that their score is that of the bias. A null
    doc_id counts as the empty string for held_out.
    """
    shared, buckets = docs.sparkSession.sparkContext.broadcast(model), len(model[0])

    def run(batches):
        for part, score in _score(batches, 1, shared, buckets):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    slim = docs.select("doc_id", text_or_empty().alias("text"))
    scored = slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`. Null and empty texts have the score of the bias."""
    shared, buckets, column = docs.sparkSession.sparkContext.broadcast(model), len(model[0]), docs.columns.index("text")

    def run(batches):
        for part, score in _score(batches, column, shared, buckets):
            yield part.filter(pa.array(score >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))
