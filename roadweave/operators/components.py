"""Connected components by alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions.storage import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]


def connected(pairs: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node in the two columns of ``pairs``.

    A large-star step hangs every larger neighbour of a node on the node's smallest neighbour, a
    small-star step does so for the smaller ones. The smallest neighbour comes from map-side
    minima, so a node with very many neighbours is never gathered. Edges end as stars; each round is
    written to the shared folder. An empty table gives an empty result.
    """
    a, b = pairs.columns
    edges = pairs.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(roots)
