"""Mixing sources to target weights by Sainte-Lague apportionment, with built-in functions only.

Every source gets a target, in words, by its weight and at most `most` times its own size. Its documents are dealt to shards by a
seeded hash, and the mix's blocks of equally many words are apportioned to all shards by the highest quotients of their
parts of the target. A shard takes its quota as whole passes and a run of blocks from a seeded start, in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import join_spread, read, settle

_WORD = "[^\\x20\\x09-\\x0D]+"
#: Copies of one row that are written out by one array.
_CHUNK = 4096


def seeded(key: Column, seed: int) -> Column:
    """A number of 60 bits that depends on the seed and the key only; a null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with 0-based ranks in a strict order, by a distributed sort: places within the sorted parts, plus the sizes of the
    parts before. Only those sizes, one per part, meet in one task."""
    placed = settle(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    # one row for each partition of the sort
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def fill_targets(sources: DataFrame, total: int, most: int) -> DataFrame:
    """sources (source_size, weight, ...) with `target`: shares of the total by weight, stopped at `most` times the size, the
    excess shared again by weight until none is above. Each round is one aggregate; the level only rises, so it ends."""
    level, cap = 0.0, most * F.col("source_size")
    while total:
        stopped = cap <= level * F.col("weight")
        s = sources.agg(F.sum(F.when(stopped, cap).otherwise(0)).alias("full"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight")).first()
        if s.weight is None or (total - s.full) / s.weight <= level:
            break
        level = (total - s.full) / s.weight
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def apportion(cells: DataFrame, keys: list[str], seats: int) -> DataFrame:
    """cells (keys, vote, seat_limit, ...) with `quota`: the `seats` highest of all quotients vote / (2 k - 1), k up to the cell's
    limit; equal quotients go by the keys. Fewer seats are given only if the limits leave no more.

    With N votes in n cells, a cell has (vote / q + 1) / 2 quotients at or above q, rounded down. So at q = N / (2 seats - n) all
    cells together have `seats` at most, which are given at once, and at q = N / (2 seats + n) at least as many, unless
    limited. Only the quotients between, about one a cell and one more for each n-th part of the votes, are sorted.
    """
    votes = cells.where("vote > 0 and seat_limit > 0").agg(F.sum("vote").alias("v"), F.count("*").alias("n")).first()
    if not seats or not votes.n:
        return cells.withColumn("quota", F.lit(0).cast("bigint"))
    at_least = lambda q: F.greatest(F.lit(0), F.least(F.col("seat_limit"), F.floor((F.col("vote") / q + 1) / 2)))
    # a few seats of play on either side, so that rounding can't matter
    sure, maybe = 2 * seats - votes.n - 4, 2 * seats + votes.n + 4
    given = at_least(F.lit(votes.v / sure)) if sure > 0 else F.lit(0)
    counted = cells.withColumn("_given", F.when(F.col("vote") > 0, given).otherwise(0).cast("bigint")).withColumn("_most", F.when(F.col("vote") > 0, at_least(F.lit(votes.v / maybe))).otherwise(0).cast("bigint"))
    have = counted.agg(F.sum("_given")).first()[0]
    between = counted.where("_most > _given").select(*keys, "vote", F.explode(F.sequence(F.col("_given") + 1, F.col("_most"))).alias("_k"))
    quotients = between.select(*keys, (F.col("vote") / (2 * F.col("_k") - 1)).alias("_q"), "_k")
    won = ranked(quotients, [F.desc("_q"), *keys, "_k"], "_rank").where(F.col("_rank") < seats - have).groupBy(*keys).agg(F.count("*").alias("_won"))
    return counted.join(won, keys, "left").withColumn("quota", F.col("_given") + F.coalesce("_won", F.lit(0))).drop("_given", "_most", "_won")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, block: int = 16, shard_words: int = 1 << 18, seed: int = 13) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken, quota_blocks) for each row of docs.

    size is the number of words; sources weigh `weights` in turn, in order of code points, null last; their targets are shares of
    `share` times all words. taken is how many of a document's words the mix takes, repeats counted, `most` times its size
    at most; a source takes its target to about a block of words in each of its shards, and reruns agree. quota_blocks are
    the blocks that its shard was given (0 for a document without words).

    A null text has no words; a null source is a source, as is the empty string. Rows that agree in doc_id, source and size are one
    document of as many copies: what they take together is split evenly, the first ones getting the rest. An empty table
    gives an empty result. Only doc_id, text and source are read, each text once, in full.

    No task gathers a source: shards hold about `shard_words` words (a longer document is alone in one), sources with a
    thousandth of all rows are sent to all tasks, at most 1000 of them, and documents without words are not dealt at all.
    """
    words = F.regexp_count("text", F.lit(_WORD))
    sized = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("bigint").alias("size")))
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = ranked(found, [F.asc_nulls_last("source")], "rank")
    sources = settle(order.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    sums = sources.agg(F.sum("source_size").alias("words"), F.sum("rows").alias("rows")).first()
    total = round(share * (sums.words or 0))
    targets = fill_targets(sources, total, most)

    # a source is known by its rank from here on; null sources are joined by a key that no other source has
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("_key")
    known = targets.select(key, "rank", "source_size", "target", F.ceil(F.col("source_size") / shard_words).alias("shards"), "rows")
    placed = join_spread(sized.select(key, "doc_id", "size"), known, "_key", F.col("rows") * 1000 >= (sums.rows or 0))
    dealt = placed.where("size > 0").withColumn("_hash", seeded(F.col("doc_id"), seed)).withColumn("shard", F.col("_hash") % F.col("shards"))
    # copies are combined before they are dealt
    once = settle(dealt.groupBy("rank", "shard", "_hash", "doc_id", "size", "source_size", "target").agg(F.count("*").alias("_copies")))
    cells = once.groupBy("rank", "shard", "target", "source_size").agg(F.sum(F.col("size") * F.col("_copies")).alias("words"))
    cells = cells.withColumn("vote", F.col("target") * F.col("words") / F.col("source_size")).withColumn("seat_limit", F.ceil(F.col("words") * most / block))
    quotas = apportion(cells.drop("target", "source_size"), ["rank", "shard"], round(total / block))
    # the shard's words, repeated `most` times, end the last block early; whole passes come first, then a run of blocks
    taken = F.least(F.col("quota") * block, F.col("words") * most)
    blocks = F.greatest(F.lit(1), F.floor(F.col("words") / block))
    start = (seeded(F.concat_ws("/", "rank", "shard"), seed) % blocks) * block
    quotas = quotas.select("rank", "shard", "quota", "words", F.floor(taken / F.col("words")).alias("passes"), (taken % F.col("words")).alias("run"), start.alias("start"))
    stream = Window.partitionBy("rank", "shard").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("size") * F.col("_copies")
    at = once.join(quotas, ["rank", "shard"]).withColumn("_from", F.coalesce(F.sum(own).over(stream), F.lit(0))).withColumn("_to", F.col("_from") + own)
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_to"), b) - F.greatest(F.col("_from"), a))
    end = F.col("start") + F.col("run")
    both = overlap(F.col("start"), F.least(end, F.col("words"))) + overlap(F.lit(0), end - F.col("words"))  # a run goes on at the beginning
    mixed = at.withColumn("_taken", F.col("passes") * own + both)
    copy = F.explode(F.sequence(F.lit(0), F.least(F.col("_copies"), F.lit(_CHUNK)) - 1))
    many = mixed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _CHUNK)))).withColumn("_copy", copy)
    number = F.col("_chunk") * _CHUNK + F.col("_copy")
    each = F.floor(F.col("_taken") / F.col("_copies")) + (number < F.col("_taken") % F.col("_copies")).cast("int")
    rows = many.where(number < F.col("_copies")).select("doc_id", "size", "source_size", "target", each.cast("bigint").alias("taken"), F.col("quota").alias("quota_blocks"))
    none = F.lit(0).cast("bigint")
    return rows.unionByName(placed.where("size = 0").select("doc_id", "size", "source_size", "target", none.alias("taken"), none.alias("quota_blocks")))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
