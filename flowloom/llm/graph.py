"""Connected components of an edge table, by alternating large and small stars; the last edges are joined in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import join_spread, settle

#: So few edges (two numbers or digests each) are joined in one task, which saves rounds of tiny shuffles.
LOCAL = 1 << 16


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node around it. Hubs, which have a thousandth or more of the
    `total` edges, at most 2000 of them, don't gather theirs in one task."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
    tied = join_spread(near.where("b > a"), least, "a", 1000 * F.col("degree") >= total)
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a")
    return tied.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m")).where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _local(edges: DataFrame) -> DataFrame:
    """(node, root) of at most LOCAL edges, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kind = None
        for b in batches:
            kind = b.schema.field("a").type
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], ["node", "root"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.repartition(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, rounds: int = 50, local: int = LOCAL) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b): root is the least node of its component.

    Self-loops and repeated edges are allowed; nodes only in self-loops are left out. Each round is a few shuffles whose
    sums are made before they are sent; only a checksum reaches the driver. When at most `local` edges are left, one task
    joins them; the result is the same without.
    """
    now = settle(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] <= local:
            return settle(_local(now))
        if mark == before:
            break
        before = mark
        if mark[0] == 0:
            break
        now = settle(_small_star(_large_star(now, mark[0])))
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
