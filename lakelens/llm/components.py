"""Connected components over a table of links, without gathering links anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stash


def contract(links: DataFrame) -> DataFrame:
    """Within each partition, replace links by a spanning forest: (a, b) with a the smallest of its tree."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        a, b = [root(x) for x in nodes], nodes
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000], pa.int64()), pa.array(b[i : i + 100_000], pa.int64())], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (columns a and b, long): root is the smallest node reachable from it.

    Alternating large-star and small-star rounds (both halve the depth of what is left), each over links that partitions
    have thinned out to forests; every round is written to the shared folder. Links of a node with itself, repeated links
    and null ends carry nothing. A hub's links are combined by min before any shuffle and its fan-out is a join."""
    cur = stash(contract(links.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))), name)
    last = None
    for _ in range(rounds):
        # large star: each larger neighbour of a node, and the node, point to the smallest of them
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b")
        star = large.distinct()
        # small star: what a node has below it points to the smallest of that
        low = star.groupBy("b").agg(F.min("a").alias("m"))
        small = star.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        cur = stash(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components didn't settle")
    return cur.select(F.col("b").alias("node"), F.col("a").alias("root"))
