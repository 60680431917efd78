"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, materialize

#: Doubling of reach makes this many rounds enough for chains of 2^30 links; beyond it the run fails.
MAX_ROUNDS = 64


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a batch: its edges as stars around the smallest node."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))

        def root(x: int, up: list[int] = up) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        roots = np.array([root(x) for x in range(len(nodes))], np.int64)
        kept = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[roots[kept]]), pa.array(nodes[kept])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of each node of edges (a, b), by alternating large and small stars.

    Every round is written to the shared folder; nothing but two numbers comes to the driver.
    """
    edges = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .mapInArrow(forest, "a bigint, b bigint"),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour goes to the least one around
        large = (
            both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        )
        # small star: every node and its smaller neighbours go to the least of these
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(least, "b")
            .select(F.explode(F.array(F.col("a"), F.col("b"))).alias("b"), F.col("m").alias("a"))
            .where("a < b")
            .select("a", "b")
            .distinct()
        )
        last, edges = edges, materialize(small, "edges")
        drop_table(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
    out._table_path = edges._table_path
    return out
