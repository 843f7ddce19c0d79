"""Connected components: forests within tasks, then alternating large-star and small-star rounds over what tasks left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, shared_dir
from .runs import forest

#: Edges that a task reduces to a forest.
EDGES = 1_000_000


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if held:
        a, b = forest(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a_task: int = EDGES) -> DataFrame:
    """Rows (node, component) for each node of edges (a, b): component is the smallest node reachable.

    Edges are dealt evenly over tasks of about `a_task`, whatever their nodes, and each task leaves at most one edge a
    node, to the smallest node that its own edges reach. If one task had them all, that is the result; else rounds go on
    from there. Each round is a grouped minimum, which Spark combines before the shuffle, joined back on the same key,
    whose large partitions Spark splits; a hub's neighbours are never gathered. Rounds are written to the shared folder,
    so a lost executor costs one round. Self loops and repeated edges are ignored, as are edges with a null; nodes
    without another node's edge are not returned."""
    spark = edges.sparkSession
    first, held = shared_dir(spark), shared_dir(spark)
    given = settle(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), first)
    tasks = max(1, -(-given.count() // a_task))
    now = settle(given.repartition(tasks).mapInArrow(_trees, "a long, b long"), held)
    discard(spark, first)
    state = _state(now) if tasks > 1 else None
    while tasks > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        path = shared_dir(spark)
        then = settle(small, path)
        was, state = state, _state(then)
        discard(spark, held)
        now, held = then, path
        if state == was:
            break
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
