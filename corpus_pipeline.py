"""Corpus pipeline. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of documents.

1. quality: rows that the classifier (learned from the labelled rows of the stage's own input) scores under 0.5 go;
2. line_dedup: lines whose template recurs in other documents go from all but the first, and n_chars follows; a document
   that is mostly such lines stays whole only if the next stage removes it, being linked with one that stays;
3. near_duplicates: one document of each group of linked documents stays, the one with the least doc_id;
4. decontamination: contaminated documents go;
5. bpe_encode: token ids of each text, with the digests of its round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.bpe_codec import encode_documents
from flowloom.llm.common import join_spread, read, settle, shared_folder
from flowloom.llm.decontaminate import drop_contaminated
from flowloom.llm.jaccard_join import keep_one_of_each, link_documents
from flowloom.llm.line_dedup import drop_recurring_lines
from flowloom.llm.quality import keep_good, train

#: Documents that would lose more of their tokens to line deduplication may be copies, which the next stage removes.
COPY_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, read(spark, sf_dir, "labels")))


def _cut_or_removed(docs: DataFrame) -> DataFrame:
    """docs without recurring lines. Documents that lose more than COPY_SHARE are linked, whole, with all others as cut. In
    classes whose first document isn't one of them they stay whole, as near_duplicates removes them; all others are cut.
    That leaves each such class as it was linked, so it is removed as foreseen. Documents whose doc_id others have too are
    always cut, as their copies can't be told apart."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(others)] or [F.lit(0).alias("none")])  # no name can clash
    every, docs = docs, docs.select("doc_id", "text", rest.alias("rest"))
    out = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.r{others.index(c)}").alias(c) for c in every.columns]
    key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    cut = drop_recurring_lines(docs.withColumn("_whole", F.col("text")), lost=True)
    cut = settle(cut.withColumn("_whole", F.when(F.col("_lost") > COPY_SHARE, F.col("_whole"))))
    repeated = docs.groupBy(key("doc_id").alias("_id")).count().where("count > 1").select("_id", F.lit(True).alias("_again"))
    if not repeated.isEmpty():
        cut = settle(cut.join(repeated, key("doc_id") == F.col("_id"), "left").withColumn("_whole", F.when(F.col("_again").isNull(), F.col("_whole"))).drop("_id", "_again"))
    marked = F.col("_whole").isNotNull()
    suspects = cut.where(marked).select("doc_id")
    if suspects.isEmpty():
        return cut.select(*out)
    linked = link_documents(cut.select("doc_id", F.coalesce("_whole", "text").alias("text")))
    gone = settle(linked.where("n_shingles > 0 and not doc_id <=> class_id").select(F.col("doc_id").alias("_copy"), key("class_id").alias("_class")))
    kept = gone.groupBy("_class").agg(F.count("*").alias("_n")).join(suspects.select(key("doc_id").alias("_class")), "_class", "left_anti")
    gone = join_spread(gone, kept, "_class", 1000 * F.col("_n") >= gone.count()).select("_copy").distinct().withColumn("_gone", F.lit(True))
    text = F.when(F.col("_gone") & marked, F.col("_whole")).otherwise(F.col("text"))
    return cut.join(gone, F.col("doc_id") == F.col("_copy"), "left").withColumn("text", text).select(*out)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = _cut_or_removed(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe_encode", bpe_encode)]

#: SQL cannot express these stages; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
