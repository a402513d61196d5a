"""N-gram Jaccard self-join by chosen paths.

Each text is the set of its word shingles, embedded as `T` min-hashes. A run sends every set along paths: from a bucket,
a set goes on to one bucket for each of its min-hashes that a hash of the path chooses (1 / similarity of them on
average), so that similar sets stay together and others part. Buckets of up to `LIMIT` sets are compared by brute force
on the min-hashes; larger ones are split again, and those that do not fall apart after `DEPTH` levels are taken whole.
Runs are repeated until a pair at the threshold is missed with less than 1 - recall. What is found so joins candidate
groups; in these, exact similarities are computed block by block, so that links are counted without being written out.

Texts with equal shingle sets are brought together first and take part once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import WORD, TwoAgeCache, ascii_lower, join_spread, read, settle, text_or_empty, unused
from flowloom.llm.graph import components

T, LIMIT, DEPTH, BLOCK = 64, 256, 3, 512
#: Candidates are sent to all tasks if they are no more than this (about 50 bytes each); else sets are joined with them.
MAX_SENT = 500_000
_U = np.uint64
_RND = np.random.RandomState(20)
_MUL = _RND.randint(0, 1 << 62, T, np.int64).astype(_U) * _U(2) + _U(1)
_ADD = _RND.randint(0, 1 << 62, T, np.int64).astype(_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    def __init__(self, words: int):
        self.words, self.cache = words, TwoAgeCache()

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; fewer words than a shingle, but not none, are one shingle."""
        cut = [WORD.findall(ascii_lower(t)) for t in texts]
        for w in self.cache.missing(set(chain.from_iterable(cut))):
            self.cache.young[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out, n = [], self.words
        for c in cut:
            h = np.fromiter(map(self.cache.young.__getitem__, c), _U, len(c))
            if not len(h):
                out.append(h)
                continue
            k = min(n, len(h))
            s = np.full(len(h) - k + 1, k, _U)
            for i in range(k):
                s = _mix(s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
            out.append(np.unique(s))
        return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T 32-bit min-hashes for each non-empty set; zeros for empty ones."""
    out = np.zeros((len(sets), T), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        at = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        for k in range(T):
            out[some, k] = np.minimum.reduceat((flat * _MUL[k] + _ADD[k]) >> _U(32), at).astype(np.uint32)
    return out


def choose(path: np.ndarray, hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, next path) for each min-hash that the path chooses."""
    token = (hashes.astype(_U) << _U(8)) | np.arange(T, dtype=_U)
    h = _mix(_mix(token) ^ (path[:, None] * _U(0x9E3779B97F4A7C15)))
    row, col = np.nonzero(h < _U(int(2**64 / (similarity * T))))
    return row, _mix(h[row, col])


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a bucket of the deepest level with probability `recall`."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def groups_of(adjacent: np.ndarray) -> np.ndarray:
    """The least member of each row's component, for a symmetric matrix of booleans."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        new = np.where(adjacent, label[None, :], n).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc")


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _sign(texts: DataFrame, words: int) -> DataFrame:
    """(doc, sig, n, hashes): the digest of a text's shingle set, its size and min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = make.sets(part.column("text").to_pylist())
                rows = min_hashes(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc", "sig", "n", "hashes"])

    return texts.mapInArrow(run, "doc long, sig binary, n long, hashes binary")


def _paths(sets: DataFrame, similarity: float, first_run: int | None, runs: int = 0) -> DataFrame:
    """(bucket, sig): where each set goes next; in run numbers first_run... at first, else from its column bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                hashes = np.frombuffer(b"".join(part.column("hashes").to_pylist()), np.uint32).reshape(-1, T)
                if first_run is None:
                    starts = [part.column("bucket").to_numpy(zero_copy_only=False).astype(np.int64).view(_U)]
                else:
                    starts = [np.full(len(hashes), r + 1, _U) for r in range(first_run, first_run + runs)]
                for path in starts:
                    row, bucket = choose(path, hashes, similarity)
                    yield pa.RecordBatch.from_arrays([_signed(bucket), part.column("sig").take(pa.array(row))], ["bucket", "sig"])

    return sets.mapInArrow(run, "bucket long, sig binary")


def _compare_buckets(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from rows (bucket, sig, hashes) of small buckets: each set and the least set of its candidate group."""
    need = similarity * T - 3.2 * math.sqrt(T * similarity * (1 - similarity))

    def pairs(sigs: list[bytes], hashes: list[bytes]) -> list[tuple]:
        h = np.frombuffer(b"".join(hashes), np.uint32).reshape(-1, T)
        if len(h) == 2:
            return [(sigs[1], sigs[0])] if (h[0] == h[1]).sum() >= need else []
        like = np.zeros((len(h), len(h)), np.int16)
        for k in range(T):
            like += h[:, k, None] == h[None, :, k]
        root = groups_of(like >= need)
        return [(sigs[i], sigs[r]) for i, r in enumerate(root.tolist()) if r != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sigs, hashes = None, [], []
        for b in batches:
            out: list[tuple] = []
            for key, sig, h in zip(*[b.column(c).to_pylist() for c in ("bucket", "sig", "hashes")]):
                if key != now:
                    if len(sigs) > 1:
                        out += pairs(sigs, hashes)
                    now, sigs, hashes = key, [], []
                if not sigs or sig != sigs[-1]:
                    sigs.append(sig)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])
        out = pairs(sigs, hashes) if len(sigs) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "sig").mapInArrow(run, "a binary, b binary")


def candidate_edges(sets: DataFrame, similarity: float, recall: float, limit: int = LIMIT, depth: int = DEPTH) -> list[DataFrame]:
    """Edge tables (a, b) over the sets (sig, hashes); their components hold all pairs that met in a leaf bucket."""
    hashes, found = sets.select("sig", "hashes"), []
    level = settle(_paths(hashes, similarity, 0, runs_for(recall, depth)))
    for k in range(depth):
        counted = settle(level.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sig").alias("hub")).where("n > 1"))
        met = settle(level.join(counted, "bucket").select("bucket", "sig", "n", "hub"))
        small = met.where(F.col("n") <= limit).select("bucket", "sig").join(hashes, "sig")
        found.append(settle(_compare_buckets(small, similarity).distinct()))
        big = met.where(F.col("n") > limit)
        if big.isEmpty():
            break
        if k + 1 == depth:  # what no path has parted is one candidate group; nobody needs to gather it
            found.append(big.where("sig != hub").select(F.col("sig").alias("a"), F.col("hub").alias("b")))
        else:
            level = settle(_paths(big.select("bucket", "sig").join(hashes, "sig"), similarity, None))
    return found


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over slices of the shared shingles."""
    m = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    values, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    number = np.cumsum(count > 1) - 1
    row, col = row[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total, width = np.zeros((m, m), np.float32), 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, z = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((m, min(width, int(col[-1]) + 1 - lo)), np.float32)
        x[row[a:z], col[a:z] - lo] = 1
        total += x @ x.T
    return total


def _verify(cells: DataFrame, similarity: float) -> DataFrame:
    """(sig, links, root) from rows (comp, i, j, block, sig, copies, set): for each set of a cell, how many texts of the
    cell's other side it links with, and the least set of its linked group."""

    def cell(key: tuple, rows: list[tuple]) -> list[tuple]:
        sigs, blocks, copies, data = zip(*rows)
        sets = [np.frombuffer(d, _U) for d in data]
        n = np.array([len(s) for s in sets], np.float32)
        both = _intersections(sets)
        linked = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-4
        np.fill_diagonal(linked, False)
        if key[1] != key[2]:  # pairs within a block are counted in the block's own cell
            side = np.array(blocks)
            linked &= side[:, None] != side[None, :]
        root = groups_of(linked)
        links = linked @ np.array(copies, np.int64)
        return [(sigs[i], k, sigs[r]) for i, (k, r) in enumerate(zip(links.tolist(), root.tolist())) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["sig", "links", "root"])

        for b in batches:
            out: list[tuple] = []
            for comp, i, j, *row in zip(*[b.column(c).to_pylist() for c in ("comp", "i", "j", "sig", "block", "copies", "set")]):
                if now != (comp, i, j):
                    if len(rows) > 1:
                        out += cell(now, rows)
                    now, rows = (comp, i, j), []
                if not rows or rows[-1][0] != row[0]:
                    rows.append(tuple(row))
            yield emit(out)
        yield emit(cell(now, rows) if len(rows) > 1 else [])

    return cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "sig").mapInArrow(run, "sig binary, links long, root binary")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [s.tobytes() for s in make.sets(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["doc", "sig", "set"])

    return texts.mapInArrow(run, "doc long, sig binary, set binary")


def link_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99, limit: int = LIMIT, block: int = BLOCK, max_sent: int = MAX_SENT) -> DataFrame:
    """One row (doc_id, class_id, n_links, n_shingles) for each row of docs.

    Two rows are linked if their texts' shingle sets are equal or have at least the given Jaccard similarity. n_links
    counts the other rows that a row is linked with; class_id is the least doc_id of the rows that links connect it
    with, itself included. Words are runs of digits, letters (A-Z lower-cased) and characters outside ASCII; a text of
    fewer words than a shingle is one shingle. Texts without words, null ones too, have equal (empty) sets. A null
    doc_id comes before all others, and its class has class_id null; so does -2^63, which counts as null. doc_id must be a whole
    number or text that is one. Repeated rows are copies of each other; an empty table gives no rows; very long texts are cut
    into shingles whole.
    """
    texts = docs.select(_doc(), text_or_empty().alias("text"))
    signed = settle(_sign(texts, words))
    reps = settle(signed.groupBy("sig").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("hashes").alias("hashes")))
    found = candidate_edges(reps.where("n > 0"), similarity, recall, limit)
    edges = found[0]
    for e in found[1:]:
        edges = edges.unionByName(e)
    near = components(edges)
    sizes = near.groupBy("root").agg(F.count("*").alias("m"))
    member = join_spread(near, sizes, "root", 1000 * F.col("m") >= near.count()).select(F.col("node").alias("sig"), F.col("root").alias("comp"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    member = settle(member.join(reps.select("sig", "rep", "copies"), "sig").select("sig", "comp", "blocks", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("doc"), "copies"))
    small = member.count() <= max_sent
    held = member.select("doc").distinct()  # only these texts are cut into shingles once more
    sets = _sets(texts.join(F.broadcast(held) if small else held, "doc", "left_semi"), words).join(F.broadcast(member) if small else member, ["sig", "doc"])
    cells = sets.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("comp", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "sig", "block", "copies", "set")
    linked = settle(_verify(cells, similarity))
    links = linked.groupBy("sig").agg(F.sum("links").alias("links"))
    classes = components(linked.where("sig != root").select(F.col("sig").alias("a"), F.col("root").alias("b")))
    named = settle(classes.join(reps.select(F.col("sig").alias("node"), "rep"), "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("class"), F.count("*").alias("m"))
    of_sig = join_spread(named, least, "root", 1000 * F.col("m") >= named.count()).select(F.col("node").alias("sig"), "class")
    known = reps.select("sig", "rep", "copies").join(links, "sig", "left").join(of_sig, "sig", "left")
    known = known.select("sig", "copies", F.coalesce("class", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    kind = docs.schema["doc_id"].dataType
    real = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).cast(kind)
    total = signed.count()
    every = join_spread(signed.select("doc", "sig", "n"), settle(known), "sig", 1000 * F.col("copies") >= total)
    return every.select(real("doc").alias("doc_id"), real("class").alias("class_id"), "n_links", F.col("n").alias("n_shingles"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, the one with the least doc_id, all columns kept.

    Texts without words are no copies of anything here: their rows stay. Where doc_ids repeat, rows are told apart by
    numbers of their own, and of each class the row that was read first stays.
    """
    if docs.groupBy(_doc()).count().where("count > 1").isEmpty():
        own = unused(docs.columns, "_doc")
        gone = link_documents(docs, **options).where("n_shingles > 0 and not doc_id <=> class_id").select(_doc().alias(own))
        return docs.withColumn(own, _doc()).join(gone, own, "left_anti").select(*docs.columns)
    row = unused(docs.columns, "_row")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    found = link_documents(numbered.select(F.col(row).alias("doc_id"), "text"), **options)
    gone = found.where("n_shingles > 0 and doc_id != class_id").select(F.col("doc_id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], words: int = 5, similarity: float = 0.8) -> list[tuple]:
    """(doc, class, n_links) by comparing all texts; for tests."""
    sets = []
    for _, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    n = len(rows)
    linked = np.array([[i != j and (a == b or len(a & b) >= similarity * len(a | b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]).reshape(n, n)
    order = sorted(range(n), key=lambda i: (rows[i][0] is not None, rows[i][0]))
    root = groups_of(linked[np.ix_(order, order)]) if n else []
    return [(rows[i][0], rows[order[root[k]]][0], int(linked[i].sum())) for k, i in enumerate(order)]
