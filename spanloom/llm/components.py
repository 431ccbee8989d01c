"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated before its shuffle) and a join with it, so no
neighbour list is ever gathered; each round is written to the shared folder. What a single file holds (EDGES_A_FILE
edges at most) is joined by one task instead: rounds of jobs would cost more, most of it in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Stash

EDGES_A_FILE = 200_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v), which this task holds."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(x, x)
            up.setdefault(y, y)
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array(map(top, some), kind)], ["node", "root"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: columns a, b of one type. Returns (node, root): every node that has an edge to another
    node, with the smallest node of its component. Loops and nulls are ignored, repeats are harmless."""
    stash = Stash(spark, "components")
    down = stash.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (state := down.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != before:
        before = state
        if state[0] <= EDGES_A_FILE:
            kind = down.schema["u"].dataType.simpleString()
            return stash.put(down.select("u", "v").coalesce(1).mapInArrow(joined, f"node {kind}, root {kind}"))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = stash.put(now.coalesce(1 + state[0] // EDGES_A_FILE))
        stash.drop_older()
    roots = down.select("v").distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
