"""BPE encoding and decoding by tree concatenation.

A text is cut into leaves of LEAF_CHARS code points, wherever they end. Leaves are encoded side by side; then neighbours
are joined, level by level: a window around each join is encoded anew, and grows until its outermost pre-token on
either side is the one that was there before. From there on outwards both sides agree exactly, since a pre-token that
ended before its leaf did is final, and cutting goes on alike from any place where both begin one. Pre-tokens of over
LONG symbols, such as unsplit runs, go through the same kind of tree on their symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.bpe import LONG, default_vocabulary, vocabulary
from flowloom.llm.common import TwoAgeCache, read, text_or_empty


#: Code points of a leaf, and pre-tokens on either side of a join that a window takes at first.
LEAF_CHARS, WINDOW = 1024, 2


class Encoder:
    """Encodes texts in a worker. joins and regrown count the joins made, and the windows that had to grow."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS, long: int = LONG):
        self.vocab, self.leaf, self.long, self.cache = vocabulary(path), leaf, long, TwoAgeCache()
        self.joins = self.regrown = 0
        self._id = list(range(self.vocab.size))  # one int object for each id

    def _learn(self, words: list[str]) -> None:
        young, own = self.cache.young, self._id.__getitem__
        short = []
        for w in words:
            if len(w) > self.long // 4 and len(s := self.vocab.symbols(w)) > self.long:
                young[w] = tuple(map(own, self.vocab.encode_by_tree(s).tolist()))
            else:
                short.append(w)
        if short:
            flat, counts = self.vocab.merge_ragged(*self.vocab.ragged(short))
            ids, at = list(map(own, flat.tolist())), 0
            for w, n in zip(short, counts.tolist()):
                young[w] = tuple(ids[at : at + n])
                at += n

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for lo in range(0, len(texts), 256):
            cut = [self.pieces(t) for t in texts[lo : lo + 256]]
            self._learn(self.cache.missing({w for c in cut for w in c if w.__class__ is str}))
            known = self.cache.young
            for c in cut:
                try:
                    out.append(list(chain.from_iterable(map(known.__getitem__, c))))
                except KeyError:  # special tokens stand among the words as ids
                    out.append([i for w in c for i in ((w,) if w.__class__ is int else known[w])])
        return out

    def pieces(self, text: str) -> list:
        """Pre-tokens of the text, and ids of special tokens, by joining those of its leaves."""
        out: list = []
        for part in self.vocab.sections(text):
            if part.__class__ is int:
                out.append(part)
                continue
            whole, cut = self.vocab.normal(part)
            if len(whole) <= self.leaf or self.vocab.prefixed:
                out += cut(whole)
                continue
            level = [(lo, min(lo + self.leaf, len(whole)), cut(whole[lo : lo + self.leaf])) for lo in range(0, len(whole), self.leaf)]
            while len(level) > 1:
                level = [self._join(whole, cut, *level[i : i + 2]) for i in range(0, len(level) - 1, 2)] + level[len(level) - len(level) % 2 :]
            out += level[0][2]
        return out

    def _join(self, text: str, cut, left: tuple, right: tuple) -> tuple[int, int, list[str]]:
        """One half from two: (first code point, one past the last, pre-tokens)."""
        (lo, mid, a), (_, hi, b), k = left, right, WINDOW
        self.joins += 1
        while True:
            start, end = lo, hi
            if k < len(a):  # blanks at most stand between pre-tokens, so they are found from the end
                start = mid
                for w in reversed(a[-k:]):
                    start = text.rindex(w, lo, start)
            if k < len(b):
                end = mid
                for w in b[:k]:
                    end = text.index(w, end, hi) + len(w)
            fresh = cut(text[start:end])
            if (start == lo or fresh[0] == a[-k]) and (end == hi or fresh[-1] == b[k - 1]):
                return lo, hi, (a[:-k] if start > lo else []) + fresh + (b[k:] if end < hi else [])
            self.regrown += 1
            k *= 2

    def decode(self, ids: list[int]) -> str:
        return self.vocab.decode(ids)


def encode(df: DataFrame, path: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """One row (doc_id, ids array<int>) for each row, repeated rows included; a null or empty text has no ids, an empty table
    no rows. Very long texts are encoded whole, leaf by leaf. doc_id may be null; other columns are not read. No shuffle."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, leaf)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(enc.encode(part.column("text").to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    slim = df.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """One row (doc_id, text) for each row (doc_id, ids), repeated rows included; null or empty ids decode to an empty text,
    an empty table gives no rows. doc_id may be null; other columns are not read."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([vocab.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    slim = df.select("doc_id", "ids")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")


def digest_round_trip(df: DataFrame, path: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """Encode, decode and digest in one pass, so that ids and decoded texts need not leave the worker.

    One row (doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, repeated rows included. A null text counts as
    empty: no ids, and the digest of the empty string twice; an empty table gives no rows. Very long texts are encoded
    whole, leaf by leaf, in the task that reads them.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, leaf)
        number = list(map(str, range(enc.vocab.size)))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogateescape")).hexdigest()
        for b in batches:
            rows = []
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                for ids in enc.encode(texts[lo : lo + 256]):
                    rows.append((len(ids), sha(" ".join(map(number.__getitem__, ids))), sha(enc.decode(ids))))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = df.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(df: DataFrame, path: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """One row (doc_id, ids, n_tokens, decoded_sha256) for each row; null texts have no ids,
    repeated rows a row each, an empty table none. Very long texts are encoded whole, leaf by leaf. No shuffle."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, leaf)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = enc.encode(part.column("text").to_pylist())
                sha = [hashlib.sha256(enc.decode(i).encode("utf-8", "surrogateescape")).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(sha, pa.string())], ["doc_id", "ids", "n_tokens", "decoded_sha256"])

    slim = df.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, decoded_sha256 string")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_round_trip(read(spark, sf_dir, "documents"))
