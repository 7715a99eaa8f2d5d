"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, unstage


def _spread(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included, beside each of its neighbours.

    The minimum is partial before it is shuffled; the join back is by a computed key,
    so both sides are dealt anew and a node with many links is a split join.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.struct(F.col("u").alias("k")).alias("key"), "m")
    return edges.withColumn("key", F.struct(F.col("u").alias("k"))).join(least, "key")


def forest(links: DataFrame, a: str, b: str, *, size: int = 1 << 18) -> DataFrame:
    """(a, b): other links with the same components: each task reads about ``size`` of the links, holds the nodes of
    that many and gives each node's link to the smallest that it reaches there, so one less than the nodes at most."""
    schema = links.select(a, b).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        read, kind = 0, None

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def stars() -> pa.RecordBatch:
            rows = [(x, r) for x in up if (r := top(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], names=[a, b])

        for batch in batches:
            kind = batch.schema.field(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(up.setdefault(x, x)), top(up.setdefault(y, y))
                if x != y:
                    up[max(x, y)] = min(x, y)
            read += batch.num_rows
            if read >= 2 * size:
                yield stars()
                up.clear()
                read = 0
        if up:
            yield stars()

    parts = max(1, links.count() // size)
    return links.select(a, b).coalesce(parts).mapInArrow(run, schema)


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(links: DataFrame, a: str, b: str, *, rounds: int = 60, size: int = 1 << 18) -> DataFrame:
    """(node, root) for every node of the links; root is the component's smallest node.

    ``links`` must be staged (it is read twice): tasks first thin it to forests (see ``forest``).
    The number of rounds grows with the logarithm of a component's size.  Rounds end
    when the links no longer change; they are written to the shared folder each time.
    """
    edges = stage(forest(links.filter(F.col(a) != F.col(b)), a, b, size=size).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _spread(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _spread(large)
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stage(step, "links")
        unstage(edges)
        edges = after
        state = _state(edges)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
