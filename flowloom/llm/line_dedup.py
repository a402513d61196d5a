"""Line deduplication with a log-template tree.

Each line's tokens that hold digits become `<*>`; the tree's leaves are (token count, leading tokens). In a leaf, a line
joins the template that agrees with it in the largest share of tokens, at least `similarity`, and where they differ the
template gets `<*>`. Lines of fewer than SHORT tokens must agree in all. Templates that recur in several documents are dropped
from all but the first.

Leading tokens are 3, however many lines a leaf has. Within a leaf, lines are taken in the order of their hashes, so that the
result depends on the lines alone. A leaf is one task's stream, of which its templates are held; with more than FEW of them
only those are compared that share a token with the line at one of its rarest places, enough of these that no template that
the line could join is passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import join_spread, read, settle, text_or_empty, unused

#: Leaves are sent to all tasks if they are no more than this (8 bytes each); else lines are joined with them.
MAX_SENT = 4_000_000
SHORT, FEW = 5, 128
#: Texts that a task cuts into lines at once.
ROWS = 512
_DIGITS = re.compile(r"\S*\d\S*")
_HAS_DIGIT = re.compile(r"\d").search
WILD = "<*>"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(lo, ROWS) for lo in range(0, b.num_rows, ROWS))


def parse(line: str, depth: int) -> tuple[int, int, str] | None:
    """(leaf, line hash, masked line), or None for lines without a token that is free of digits: they are no template."""
    tokens = line.split()
    if _HAS_DIGIT(line):
        tokens = [WILD if _HAS_DIGIT(t) else t for t in tokens]
        if tokens.count(WILD) == len(tokens):
            return None
    elif not tokens:
        return None
    masked = " ".join(tokens)
    return _hash(f"{len(tokens)} {' '.join(tokens[:depth])}"), _hash(masked), masked


class Leaf:
    """Templates of one leaf. Numbers stand for tokens, 0 for a variable field."""

    def __init__(self, similarity: float):
        self.similarity, self.number, self.ids = similarity, {WILD: 0}, []
        self.rows = np.zeros((4, 0), np.int32)
        #: Templates by (place, token) of the lines that began them, once there are more than FEW.
        self.having: defaultdict[tuple[int, int], list[int]] | None = None

    def _note(self, k: int, row: np.ndarray) -> None:
        for at in enumerate(row.tolist()):
            if at[1]:
                self.having[at].append(k)

    def _candidates(self, row: np.ndarray, need: int) -> np.ndarray | slice:
        """The templates, in order, of which one may agree with row in `need` tokens: then it has one of row's tokens at any
        places but need - 1 of those without a field, as templates only lose tokens."""
        n = len(self.ids)
        if n <= FEW:
            return slice(0, n)
        if self.having is None:
            self.having = defaultdict(list)
            for k in range(n):
                self._note(k, self.begun[k])
            self.begun = None
        lists = sorted((self.having.get(at, ()) for at in enumerate(row.tolist()) if at[1]), key=len)
        lists = [x for x in lists[: max(0, len(lists) - need + 1)] if x]
        return np.unique(np.concatenate([np.array(x, np.int64) for x in lists])) if lists else np.zeros(0, np.int64)

    def add(self, own: int, masked: str) -> int:
        """The id of the template that the line joins: the hash of the line that began it."""
        row = np.array([self.number.setdefault(t, len(self.number)) for t in masked.split(" ")], np.int32)
        n = len(self.ids)
        if n:
            need = math.ceil((self.similarity if len(row) >= SHORT else 1) * len(row))
            which = self._candidates(row, need)
            same = ((self.rows[which] == row) & (row != 0)).sum(1)
            best = int(same.argmax()) if len(same) else 0
            if len(same) and same[best] >= need:
                best = best if isinstance(which, slice) else int(which[best])
                self.rows[best][self.rows[best] != row] = 0
                return self.ids[best]
        elif not self.rows.shape[1]:
            self.rows = np.zeros((4, len(row)), np.int32)
            self.begun: list | None = []
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = row
        self.ids.append(own)
        if self.having is None:
            self.begun.append(row)
        else:
            self._note(n, row)
        return own


def _deepen(lines: DataFrame, depth: int, most: int) -> DataFrame:
    """Rows (leaf, line, masked, n) with leaves of more than `most` lines split by more leading tokens."""
    while True:
        sizes = lines.groupBy("leaf").agg(F.count("*").alias("_size")).where(F.col("_size") > most)
        if sizes.isEmpty():
            return lines
        deeper = F.xxhash64("leaf", F.slice(F.split("masked", " "), depth + 1, depth))
        lines = settle(lines.join(sizes, "leaf", "left").withColumn("leaf", F.when(F.col("_size").isNull(), F.col("leaf")).otherwise(deeper)).drop("_size"))
        depth *= 2


def _grow(lines: DataFrame, similarity: float) -> DataFrame:
    """(line, template, n): which template each of the distinct lines (leaf, line, masked, n) is in; one stream of sorted
    leaves in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, now = None, None
        for b in batches:
            out = []
            for key, line, masked in zip(*[b.column(c).to_pylist() for c in ("leaf", "line", "masked")]):
                if now != key:
                    leaf, now = Leaf(similarity), key
                out.append(leaf.add(line, masked))
            yield pa.RecordBatch.from_arrays([b.column("line"), pa.array(out, pa.int64()), b.column("n")], ["line", "template", "n"])

    dealt = lines.select("leaf", "line", "masked", "n").repartition("leaf").sortWithinPartitions("leaf", "line")
    return dealt.mapInArrow(run, "line long, template long, n long")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc")


def _leaves(texts: DataFrame, depth: int) -> DataFrame:
    """Leaf and how many documents have it, counted batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for part in _slices(b):
                for text in part.column("text").to_pylist():
                    seen.update({p[0] for p in (parse(x, depth) for x in text.split("\n")) if p})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["leaf", "n"])

    return texts.select("text").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))


def _lines(texts: DataFrame, depth: int, leaves: np.ndarray | None) -> DataFrame:
    """Rows (doc, leaf, line, masked), one for each line of a document; masked is there once for each batch of rows."""
    sent = None if leaves is None else texts.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None else sent.value
        for b in batches:
            seen: set = set()
            for part in _slices(b):
                rows = []
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                    rows += [(doc, *p) for p in {p for p in (parse(x, depth) for x in text.split("\n")) if p}]
                if wanted is not None and rows:
                    leaf = np.array([r[1] for r in rows], np.int64)
                    at = np.searchsorted(wanted, leaf)
                    at[at == len(wanted)] = 0
                    keep = wanted[at] == leaf if len(wanted) else np.zeros(len(leaf), bool)
                    rows = [r for r, k in zip(rows, keep.tolist()) if k]
                text = [None if r[2] in seen or seen.add(r[2]) else r[3] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(text, pa.string())], ["doc", "leaf", "line", "masked"])

    return texts.mapInArrow(run, "doc long, leaf long, line long, masked string")


def recurring_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.7, min_docs: int = 2, max_sent: int = MAX_SENT, leaf: int | None = None) -> DataFrame:
    """Rows (doc, line): the hashes of the lines that are to go from each document, since their template is in at least
    min_docs documents and this one, by doc_id, isn't the first. Leaves are split by more leading tokens only if the caller bounds
    their distinct lines by `leaf`, at the price of templates that are told apart."""
    texts = docs.select(_key(), text_or_empty().alias("text"))
    shared = settle(_leaves(texts, depth).where(F.col("n") >= min_docs).select("leaf"))
    if shared.count() <= max_sent:
        lines = _lines(texts, depth, np.sort(np.array([r.leaf for r in shared.toLocalIterator()], np.int64)))
    else:
        lines = _lines(texts, depth, None).join(shared, "leaf", "left_semi")
    lines = settle(lines.select("doc", "leaf", "line", "masked"))
    distinct = settle(lines.groupBy("leaf", "line").agg(F.max("masked").alias("masked"), F.count("*").alias("n")))
    of_line = settle(_grow(distinct if leaf is None else _deepen(distinct, depth, leaf), similarity))
    total = of_line.agg(F.sum("n")).first()[0] or 0  # a line with a thousandth of all is hot: there are no more than 1000 such
    placed = settle(join_spread(lines.select("doc", "line"), of_line, "line", 1000 * F.col("n") >= total).select("doc", "line", "template"))
    often = placed.groupBy("template", "doc").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("one").alias("n"), F.min("doc").alias("first")).where(F.col("n") >= min_docs)
    weight = of_line.groupBy("template").agg(F.sum("n").alias("rows"))
    often = settle(often.select("template", "first").join(weight, "template"))
    return join_spread(placed, often, "template", 1000 * F.col("rows") >= total).where("doc > first").select("doc", "line").distinct()


def drop_recurring_lines(docs: DataFrame, counts: bool = False, lost: bool = False, **options) -> DataFrame:
    """docs with recurring lines taken out of their texts, all columns kept; with counts, n_lines and n_dropped too, with
    lost the share of tokens that went.

    Null texts stay null; empty lines, and lines all of whose tokens hold digits, always stay. Rows with one doc_id count
    as one document, and a null doc_id as the first of all (-2^63 counts as null; doc_id must be a whole number or text that is
    one). With counts or lost, docs must not have columns of these names. An empty table gives an empty one; very long texts are parsed
    line by line, whole.
    """
    made = (["_lines", "_dropped"] if counts else []) + (["_lost"] if lost else [])
    if taken := {c.lower() for c in docs.columns} & set(made):
        raise ValueError(f"docs has columns {', '.join(sorted(taken))}")
    depth = options.get("depth", 3)
    gone = recurring_lines(docs, **options).groupBy("doc").agg(F.collect_list("line").alias("_gone"))
    own = unused(docs.columns, "_doc")
    joined = docs.withColumn(own, _key()).join(gone.select(F.col("doc").alias(own), F.col("_gone").alias(f"{own}_gone")), own, "left").select(*docs.columns, f"{own}_gone")
    text_at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(_slices, batches)):
            texts, lines, dropped, shares = [], [], [], []
            for text, gone in zip(b.column(text_at).to_pylist(), b.column(width).to_pylist()):
                cut = (text or "").split("\n")
                n, kept, share = len(cut), cut, 0.0
                if gone:
                    drop = set(gone)
                    kept = [x for x in cut if (p := parse(x, depth)) is None or p[1] not in drop]
                    if lost:
                        share = 1 - sum(len(x.split()) for x in kept) / max(1, len(text.split()))
                shares.append(share)
                texts.append(text if len(kept) == n else "\n".join(kept))
                lines.append(n)
                dropped.append(n - len(kept))
            columns = [pa.array(texts, pa.string()) if k == text_at else b.column(k) for k in range(width)]
            names = [b.schema.names[k] for k in range(width)]
            if counts:
                columns, names = columns + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names + ["_lines", "_dropped"]
            if lost:
                columns, names = columns + [pa.array(shares, pa.float64())], names + ["_lost"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, schema + (", _lines long, _dropped long" if counts else "") + (", _lost double" if lost else ""))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.length(text_or_empty()).cast("bigint").alias("n_chars_kept"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))
