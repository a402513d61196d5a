"""Document fingerprints: threshold-scaled sketches of word shingles, with built-in functions only.

A sketch holds every 48-bit shingle hash below 2**48 / scale, whatever the length of the text, and the smallest hash in
any case, so that short texts have one too. Sketches of parts merge by `merge_sketches` into the sketch of their union,
and a long text's containment of a short one can be read off as well as the likeness of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import read, text_or_empty

_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits by which ids are grouped, level by level, so that a window never holds more than 2**18 rows.
_LEVELS = (10, 18, 18)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, words: int = 5, scale: int = 8) -> Column:
    """Sorted hashes (array<bigint>) of the text's shingles; a text of fewer words, but not none, is one shingle.

    Words are runs of digits, letters (A-Z lower-cased) and characters outside ASCII. A text without words has an empty
    sketch.
    """
    cut = F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _NOT_WORD), "")
    shingles = _let(cut, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (words - 1))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, words)), 16))).otherwise(F.array().cast("array<bigint>")))
    return _let(shingles, lambda h: F.array_sort(F.array_compact(F.array_union(F.filter(h, lambda x: x < (1 << 48) // scale), F.array(F.array_min(h))))))


def merge_sketches(a: Column, b: Column, scale: int = 8) -> Column:
    """The sketch of two texts' shingles taken together."""
    return _let(F.array_union(a, b), lambda h: F.array_sort(F.array_compact(F.array_union(F.filter(h, lambda x: x < (1 << 48) // scale), F.array(F.array_min(h))))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two texts without words, 0 if only one has none."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 12, "0"))), "")


def following(cells: DataFrame, levels: tuple[int, ...] = _LEVELS) -> DataFrame:
    """For rows (cell, first), cells distinct: (cell, next), next being `first` of the next cell in order; the first
    one follows the last. Cells are grouped by their upper bits, so that every window is bounded by the group's width
    and the last one by what bits are left."""
    if not levels:
        w = Window.orderBy("cell")
        return cells.select("cell", F.coalesce(F.lead("first").over(w), F.first("first").over(w)).alias("next"))
    grouped = cells.withColumn("up", F.shiftright("cell", levels[0]))
    within = grouped.select("cell", "up", F.lead("first").over(Window.partitionBy("up").orderBy("cell")).alias("near"))
    upper = following(grouped.groupBy(F.col("up").alias("cell")).agg(F.min("first").alias("first")), levels[1:])
    return within.join(upper.withColumnRenamed("cell", "up"), "up").select("cell", F.coalesce("near", "next").alias("next"))


def fingerprint_documents(docs: DataFrame, words: int = 5, scale: int = 8) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is replaced by the start of the next document.

    Null texts count as empty. A null doc_id comes before all others. Rows with one doc_id each get a row of the result;
    as next document they count once, by their smallest text. A single document follows itself; an empty table gives
    no rows. doc_id must be a whole number or text that is one (else Spark's cast fails), and -2^63 counts as null. Texts of
    any length are cut into shingles whole. A sketch holds an eighth of the shingles, so that estimates of short texts (six
    hashes for 50 words) are coarse. Each text is dealt by
    its id once, and of its start as much as the document before it needs.
    """
    least = F.lit(-(1 << 63)).cast("bigint")
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), least).alias("key"), text_or_empty().alias("text"))
    sizes = base.groupBy("key").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    unique = sizes.where("rows > 1").isEmpty()
    order = following(sizes.select(F.col("key").alias("cell"), F.col("key").alias("first"))).join(sizes.select(F.col("key").alias("cell"), "n"), "cell").select(F.col("next").alias("key"), F.col("cell").alias("before"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    # both sides of the join below read the same two columns, so that Spark deals the texts by id only once
    texts = base.select("key", "text")
    own = sketch(F.col("text"), words, scale)
    start = texts.join(order, "key").select(F.col("before").alias("key"), F.expr("substring(text, 1, need)").alias("start"), own.alias("next_own"), "text")
    if unique:
        start = start.drop("text")
    else:
        start = start.groupBy("key").agg(F.min(F.struct("text", "start", "next_own")).alias("s")).select("key", "s.start", "s.next_own")
    n = F.length("text")
    edited = texts.join(start, "key").withColumn("own", own).withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.expr("concat(substring(text, 1, length(text) - floor(length(text) / 2)), substring(start, 1, floor(length(text) / 2)))"))
    both = edited.withColumn("changed", sketch(F.col("edited"), words, scale))
    a, b, c = F.col("own"), F.col("changed"), F.col("next_own")
    doc_id = F.when(F.col("key") != least, F.col("key")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return both.select(doc_id, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(a).alias("fingerprint"), as_string(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), containment(a, b).alias("kept_by_edited"), containment(a, c).alias("kept_by_next"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))
