"""Connected components of an edge table: of at most LOCAL_EDGES edges in one task, of more by alternating large and small stars.

Each step is a minimum for each node, aggregated before the shuffle, and a join that adaptive execution can split, so that
a node with very many neighbours never meets them in one task. Steps are written to the shared folder; nothing but two
sums reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.storage import cut, drop


#: Edges up to which one task finds the components; a hundred bytes each.
LOCAL_EDGES = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of the edges u > v, by union of sets whose root is their least id."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        ids = list(root)
        yield pa.record_batch([pa.array(ids, kind), pa.array([find(x) for x in ids], kind)], ["id", "component"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges u, v with u > v. Large star: neighbours above a node go to the least of its neighbourhood; small star: the node
    and its neighbours below do."""
    if small:
        pairs = edges
    else:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable, itself included) of every node of edges (a, b)."""
    spark = edges.sparkSession
    now, path = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    if now.count() <= LOCAL_EDGES:
        kind = dict(now.dtypes)["u"]
        return now.coalesce(1).mapInArrow(_joined, f"id {kind}, component {kind}")
    sign = None
    while True:
        stars, new = cut(_star(_star(now, False), True), "edges")
        drop(spark, path)
        now, path = stars, new
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if row == sign:
            break
        sign = row
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
