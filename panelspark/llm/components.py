"""Connected components of a table of links, without gathering links anywhere."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, map_arrow


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of each batch: every node with the smallest one it reaches there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in parent]
        pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` for every node of the links ``a, b``, where label is the smallest node reachable.

    Each task joins its own links by union-find; then large-star and small-star steps
    repeat until every node points at the root of its group. Each step is written
    as a table. The number of steps grows with the logarithm of the longest path.
    """
    edges = scratch.table(map_arrow(links.select("a", "b"), _forest, "u bigint, v bigint").distinct(), "stars")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        following = scratch.table(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        scratch.drop(edges)
        edges, before, state = following, state, _state(following)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return scratch.table(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots), "labels")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1000003), F.sum(F.col("v") % 1000003))
    return tuple(row.first())
