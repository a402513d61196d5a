"""Benchmark decontamination with one Aho-Corasick automaton over the word windows of all items."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import WORD, ascii_lower, read, settle, text_or_empty, unused

#: A benchmark of more words is scanned in blocks of about so many, one automaton each. An automaton has at most 13 nodes a
#: word, which were measured to take 1.2 kB together.
BLOCK_WORDS = 150_000

_automata: dict = {}


class WindowAutomaton:
    """All windows of `size` consecutive words (items with fewer words are one window), over word numbers."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        self.number: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        shared: dict[tuple, tuple] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in WORD.findall(ascii_lower(text))]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.empty = not owners
        while owners:
            window, own = owners.popitem()
            self.trie.add_word(window, shared.setdefault((len(window), frozenset(own)), (len(window), frozenset(own))))
        if not self.empty:
            self.trie.make_automaton()

    def scan(self, words: list[str]) -> list[tuple[int, int, frozenset]]:
        """(first word, one past the last word, items) of every occurrence, in one pass; unknown words are 0."""
        if self.empty or not words:
            return []
        get = self.number.get
        return [(end + 1 - n, end + 1, own) for end, (n, own) in self.trie.iter(tuple([get(w, 0) for w in words]))]


def _automaton(shared: tuple, size: int) -> WindowAutomaton:
    """One for each worker at a time; shared: a name that is never used again, and the broadcast items."""
    key = (shared[0], size)
    if key not in _automata:
        _automata.clear()
        _automata[key] = WindowAutomaton(shared[1].value, size)
    return _automata[key]


def _union(found: list[tuple[int, int, frozenset]]) -> list[list[int]]:
    """Disjoint word ranges that the occurrences cover."""
    out: list[list[int]] = []
    for a, b, _ in sorted(found, key=lambda x: x[:2]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_FOUND = "n_words long, ranges array<array<long>>, spans array<array<long>>, items array<string>"


def _scan_block(docs: DataFrame, carried: list[str], shared: tuple, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared, size)
        for b in batches:
            n, ranges, spans, items = [], [], [], []
            for text in b.column("text").to_pylist():
                low = ascii_lower(text)
                words = WORD.findall(low)
                found = auto.scan(words)
                n.append(len(words))
                cover = _union(found)
                ranges.append(cover)
                items.append(sorted(set(chain.from_iterable(own for _, _, own in found))))
                if cover:  # folding keeps lengths, so word offsets are those of the original text
                    at = [m.span() for m in WORD.finditer(low)]
                    spans.append([[at[a][0], at[z - 1][1]] for a, z in cover])
                else:
                    spans.append([])
            two = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], pa.array(n, pa.int64()), pa.array(ranges, two), pa.array(spans, two), pa.array(items, pa.list_(pa.string()))], [*carried, "n_words", "ranges", "spans", "items"])

    slim = docs.select(*carried, "text")
    kept = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in carried)
    return slim.mapInArrow(run, f"{kept}, {_FOUND}")


def _item_parts(benchmark: DataFrame, size: int, words: int) -> DataFrame:
    """(item, part, n, text): the words of the items, those of long ones in parts that share size - 1 words, so that each
    window is in one part and no part but an item's only one has fewer words than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                found = WORD.findall(ascii_lower(text))
                starts = range(0, max(1, len(found) - size + 1), words)
                parts = [found[a : a + words + size - 1] for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(map(len, parts), pa.int64()), pa.array([" ".join(p) for p in parts], pa.string())], ["item", "part", "n", "text"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    return items.mapInArrow(run, "item string, part long, n long, text string").where("n > 0")


def _shared_blocks(benchmark: DataFrame, size: int, block_words: int) -> list[tuple]:
    """The items as broadcasts of about block_words each; the number of blocks follows from the measured size."""
    items = settle(_item_parts(benchmark, size, max(1, block_words // 8)))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    sc = benchmark.sparkSession.sparkContext
    mine = F.pmod(F.xxhash64("item", "part", "text"), F.lit(blocks))
    return [(uuid.uuid4().hex, sc.broadcast([tuple(r) for r in items.where(mine == k).select("item", "text").collect()])) for k in range(blocks)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, ranges and spans (disjoint word ranges and character ranges of
    the original text that lie in an occurrence of a window), items (their item ids as sorted strings).

    Null texts have no words; null item ids count as "". Repeated items and repeated rows are all reported. An empty
    benchmark finds nothing. The benchmark is read in blocks of a checked size; each block's automaton scans every text
    once. Offsets are code points.
    """
    return _find(docs.select("doc_id", text_or_empty().alias("text")), benchmark, size, block_words)


def _find(slim: DataFrame, benchmark: DataFrame, size: int, block_words: int, row: str = "row") -> DataFrame:
    blocks = _shared_blocks(benchmark, size, block_words)
    ids = [c for c in slim.columns if c != "text"]
    if len(blocks) == 1:
        return _scan_block(slim, ids, blocks[0], size)
    if row not in ids:
        slim, ids = settle(slim.withColumn(row, F.monotonically_increasing_id())), [*ids, row]
    every = functools.reduce(DataFrame.unionByName, [_scan_block(slim, ids, b, size) for b in blocks])
    own = [F.first(c).alias(c) for c in ids if c != row]
    both = every.groupBy(row).agg(*own, F.first("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return both.select(*ids, "n_words", _merged("ranges"), _merged("spans"), "items")


def _merged(name: str):
    """Ranges of several blocks, made disjoint again; touching word ranges stay as they are counted."""
    step = lambda acc, r: F.when((F.size(acc) > 0) & (r[0] <= F.element_at(acc, -1)[1]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], r[1]))))).otherwise(F.concat(acc, F.array(r)))
    return F.aggregate(F.array_sort(name), F.array().cast("array<array<bigint>>"), step).alias(name)


def _hit_words():
    return F.aggregate("ranges", F.lit(0).cast("bigint"), lambda acc, r: acc + r[1] - r[0])


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: hit words are at least 1 in `share` of all."""
    found = find_contamination(docs, benchmark, size, block_words).withColumn("n_hit", _hit_words())
    judged = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), judged.alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; rows with a null text have no words and stay.

    With one block (the usual case) the decision falls where the row is read, without a shuffle; with more, what the
    blocks find is brought together by row.
    """
    blocks = _shared_blocks(benchmark, size, block_words)
    if len(blocks) > 1:
        row = unused(docs.columns, "_row")
        kept = settle(docs.withColumn(row, F.monotonically_increasing_id()))
        found = _find(kept.select(row, text_or_empty().alias("text")), benchmark, size, block_words, row).withColumn("n_hit", _hit_words())
        return kept.join(found.where((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))), row, "left_anti").select(*docs.columns)
    column, block = docs.columns.index("text"), blocks[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(block, size)
        for b in batches:
            keep = []
            for text in b.column(column).to_pylist():
                words = WORD.findall(ascii_lower(text or ""))
                hit = sum(z - a for a, z in _union(auto.scan(words)))
                keep.append(not (hit and share * hit >= len(words)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def brute_force(text: str | None, items: list[tuple[str, str]], size: int = 13, share: int = 20) -> tuple:
    """The contract's rule, written out; for tests."""
    words = WORD.findall(ascii_lower(text or ""))
    hit, own = np.zeros(len(words), bool), set()
    for item, t in items:
        w = WORD.findall(ascii_lower(t or ""))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit[j : j + n] = True
                    own.add(item)
    names = ",".join(sorted(own))
    n_hit = int(hit.sum())
    return len(words), n_hit, len(own), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and share * n_hit >= len(words)
