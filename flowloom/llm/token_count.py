"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.bpe import LONG, default_vocabulary, vocabulary
from flowloom.llm.common import TwoAgeCache, read, text_or_empty

_WORDS = 20_000  # pre-tokens that are merged together


def _count_new(vocab, words: list[str], into: dict) -> None:
    """Count the tokens of words not seen before, many in one ragged array. Runs of over LONG symbols are merged in leaves
    that are joined, so that rounds of merging don't grow with them."""
    for w in [w for w in words if len(w) > LONG // 4]:
        if len(s := vocab.symbols(w)) > LONG:
            into[w] = len(vocab.encode_by_tree(s))
    words = [w for w in words if w not in into]
    for lo in range(0, len(words), _WORDS):
        part = words[lo : lo + _WORDS]
        _, counts = vocab.merge_ragged(*vocab.ragged(part))
        into.update(zip(part, counts.tolist()))


def count_texts(texts: list[str], path: str, cache: TwoAgeCache | None = None) -> list[int]:
    """Tokens of each text. Special strings are one token each, as the library's default has it."""
    vocab, cache = vocabulary(path), cache or TwoAgeCache()
    out: list[int] = []
    for lo in range(0, len(texts), 256):
        cut = [vocab.pieces(t) for t in texts[lo : lo + 256]]
        words = {w for c in cut for w in c if w.__class__ is str}
        _count_new(vocab, cache.missing(words), cache.young)
        n = cache.young
        for c in cut:
            try:
                out.append(sum(map(n.__getitem__, c)))
            except KeyError:  # special tokens stand among the words as ids
                out.append(sum(1 if w.__class__ is int else n[w] for w in c))
    return out


def count_tokens(df: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) for each row of df, repeated rows included.

    A null text counts as empty: 0 bytes, 0 tokens; an empty table gives no rows; very long texts are counted whole. Ids may be
    null; other columns are not read. No shuffle.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TwoAgeCache()
        for b in batches:
            texts = b.column("text").to_pylist()
            tokens = count_texts(texts, path, cache)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = df.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).withColumn("bytes_per_token", F.try_divide("n_bytes", "n_tokens"))
