"""Fill-in-middle transformation by a learned index from line ranks to offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import read, text_or_empty

#: Marks of the parts. A text that holds one is left plain, so that the parts can be told apart again.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that share one index; a longer text has one of its own.
_SLICE = 8 << 20


class RankIndex:
    """Offsets by rank, in piecewise-linear form: a segment predicts offset = base + slope * (rank - start), at most `error`
    (plus rounding) off, and the stored residuals, two bytes each, correct every prediction exactly.

    Segments are cut greedily: from an anchor, the cone of slopes that meet all offsets within `error` narrows with each
    further rank; the segment ends where it is empty. offsets must not fall; there may be none.
    """

    def __init__(self, offsets: np.ndarray, error: int = 1024):
        if not 0 < error < 32_000:
            raise ValueError("the error must be between 1 and 31999")
        y = np.asarray(offsets, np.int64)
        starts, slopes, i = [], [], 0
        while i < len(y):
            slope, after = _segment(y, i, error)
            starts.append(i)
            slopes.append(slope)
            i = after
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes)
        self.bases = y[self.starts]
        self.residuals = (y - self.predict(np.arange(len(y)))).astype(np.int16)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone."""
        at = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[at] + np.rint(self.slopes[at] * (ranks - self.starts[at])).astype(np.int64)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets."""
        return self.predict(ranks) + self.residuals[ranks]


def _segment(y: np.ndarray, i: int, error: int) -> tuple[float, int]:
    """Slope of the longest segment from rank i, and the rank after it. The cone is narrowed for many ranks at once."""
    low, high, j, width = -np.inf, np.inf, i + 1, 64
    while j < len(y):
        run, rise = np.arange(j - i, min(len(y), j + width) - i), y[j : j + width] - y[i]
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        empty = np.flatnonzero(lows > highs)
        fits = int(empty[0]) if len(empty) else len(run)
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        j += fits
        if len(empty):
            break
        width *= 2
    return ((low + high) / 2 if j > i + 1 else 0.0), j


def line_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts that lie one after another in `data` (UTF-8), text t from edges[t] to edges[t + 1]: how many each has, the
    rank of each text's start among all bounds, and the bounds themselves: of each text its start, then its lines' ends."""
    begin, end = edges[:-1], edges[1:]
    breaks = np.flatnonzero(data[edges[0] : edges[-1]] == 10) + edges[0] + 1
    first, last = np.searchsorted(breaks, begin, side="right"), np.searchsorted(breaks, end, side="right")
    closed = last - first
    open_end = (end > begin) & (data[np.maximum(end - 1, 0)] != 10) if len(data) else np.zeros(len(begin), bool)
    lines = closed + open_end
    base = np.cumsum(lines + 1) - (lines + 1)
    bounds = np.empty(int((lines + 1).sum()), np.int64)
    bounds[base] = begin
    of = np.repeat(np.arange(len(begin)), closed)
    bounds[base[of] + 1 + np.arange(first[0] if len(first) else 0, len(breaks)) - first[of]] = breaks
    bounds[(base + lines)[open_end]] = end[open_end]
    return lines, base, bounds


def _draws(ids: list, seed: int) -> np.ndarray:
    """The first four 32-bit numbers of the SHA-256 of "seed:id", a row for each id; a null id counts as the empty string."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _edges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text starts, with the end of the last."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), edges


def rearrange(texts: pa.Array, ids: list, seed: int = 7, rate: int = 100, spm: int = 50, error: int = 1024) -> Iterator[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text, whose lines are cut at two ranks drawn by its id."""
    data, edges = _edges(texts)
    mark = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + _SLICE, side="right")) - 1)
        n, base, bounds = line_bounds(data, edges[lo : hi + 1])
        index = RankIndex(bounds, error)
        h = _draws(ids[lo:hi], seed)
        a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        first, second = index[base + np.minimum(a, b)].tolist(), index[base + np.maximum(a, b)].tolist()
        for k, t in enumerate(range(lo, hi)):
            begin, end = int(edges[t]), int(edges[t + 1])
            raw = data[begin:end].tobytes()
            if not raw or h[k, 2] % 100 >= rate or any(m in raw for m in mark):
                yield int(n[k]), "plain", None, None, raw.decode()
                continue
            p, m, s = raw[: first[k] - begin], raw[first[k] - begin : second[k] - begin], raw[second[k] - begin :]
            form = "spm" if h[k, 3] % 100 < spm else "psm"
            out = (mark[1] + s + mark[0] + p if form == "spm" else mark[0] + p + mark[1] + s) + mark[2] + m
            yield int(n[k]), form, len(p.decode()), len(m.decode()), out.decode()
        lo = hi


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, error: int = 1024) -> DataFrame:
    """One row (doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs, repeated rows included.

    A text of n lines is cut before two of its n + 1 ranks, drawn from its doc_id and the seed: `rate` percent of the texts are
    rearranged, of these `spm` percent with the suffix first. Null and empty texts have 0 lines and stay plain, as texts
    that hold a mark do; so no empty table, null id or extra column matters: only doc_id and text are read. A text is
    cut in the task that reads it, whatever its length. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for b in batches:
            ids, part, size, start = b.column("doc_id"), [], 0, 0
            for k, row in enumerate(rearrange(b.column("text"), b.column("id").to_pylist(), seed, rate, spm, error)):
                part.append(row)
                size += len(row[-1])
                if size > _SLICE or k == len(ids) - 1:
                    n, form, prefix, middle, out = zip(*part)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(part)), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())], names)
                    part, size, start = [], 0, k + 1

    slim = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle was given, from its output and form. The marks are found where they stand: none of
    them can begin within a part and end beyond it, as `<` is only their first character."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
