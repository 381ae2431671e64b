"""Connected components by alternating large-star and small-star steps, as joins over the edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, forget, staged, unstage


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v): each v is linked to the least of u and u's listed neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = edges.join(least.select(apart("u"), "m"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the least node of each part that they connect; bounded by a run of batches."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root[top]) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def stars() -> pa.RecordBatch:
        rows = [(x, r) for x in root if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kind) for k in (0, 1)], names=["a", "b"])

    forget()
    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 200_000:
            yield stars()
            root.clear()
    if root:
        yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's least node.

    Nodes can be of any ordered type. Tasks first reduce their own edges to stars; each round is written to the shared
    folder, and rounds end when all edges form stars. Hubs are dealt by joins that adaptive execution can split, and no
    neighbour list is gathered. Null ends and loops are left out.
    """
    ordered = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now = staged(ordered.mapInArrow(_forest, ordered.schema), "cc")
    for _ in range(most_rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(now.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).filter("low > 1 or low = 1 and high = 1").limit(1).count():
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: to each node's neighbours that are greater than the node
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least.select(apart("u"), "m"), "u").filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).filter("a <> b")
        # small star: the node and its lesser neighbours
        small = staged(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v"))), "cc")
        unstage(now)
        now = small
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
