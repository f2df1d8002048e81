"""Typed graphs of frames, detections, violations and clauses, as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of nodes that one task puts together, about.
ROWS = 2_000_000


def node(kind: str, *parts: Column) -> Column:
    """Composite id: kind and parts joined by colons."""
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def nodes_of(df: DataFrame, kind: str, ident: Column, label: Column) -> DataFrame:
    return df.select(ident.alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"))


def edges_of(df: DataFrame, src: Column, dst: Column, relation: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))


def union_nodes(*parts: DataFrame) -> DataFrame:
    """All nodes, one for each id (the least label of equals).

    Minima of texts are taken over sorted rows, so tasks grow in number with the rows (which are counted), not in size.
    """
    every = reduce(DataFrame.unionByName, parts)
    tasks = max(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every.count() // ROWS))
    return every.repartition(tasks, "id").groupBy("id").agg(F.min("type").alias("type"), F.min("label").alias("label"))


def union_edges(*parts: DataFrame, once: tuple[str, ...] = ("PART_OF",)) -> DataFrame:
    """All edges; repeated ones stay, but for the relations in ``once``."""
    every = reduce(DataFrame.unionByName, parts)
    single = F.col("relation").isin(*once)
    return every.where(~single).unionByName(every.where(single).distinct())


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, kind, n: counts of nodes by type and of edges by relation."""
    a = nodes.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("node"))
    b = edges.groupBy(F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edge"))
    return a.unionByName(b).select("what", "kind", "n")


def detection_kind(rule: Column, marking: tuple[str, ...], sign: tuple[str, ...]) -> Column:
    """Which kind of detection a rule belongs to; unknown rules go to objects, missing ones to markings."""
    return F.when(rule.isNull() | rule.isin(*marking), "marking").when(rule.isin(*sign), "sign").otherwise("object")


def flatten_reports(frames: DataFrame, violations: str = "violations") -> DataFrame:
    """One row a violation with its id ``<frame>_vNN``; frames without any stay, as compliant."""
    v = frames.select("*", F.posexplode_outer(violations).alias("_pos", "_v")).drop(violations)
    ident = F.when(F.col("_pos").isNotNull(), F.format_string("%s_v%02d", F.col("frame_id").cast("string"), F.col("_pos")))
    return v.withColumns({"event_id": ident, "is_compliant": F.col("_v").isNull()}).select("*", "_v.*").drop("_pos", "_v")


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str, **options: str) -> None:
    """A GraphML document as text files whose lines are in order of the files' names: head, nodes, edges, foot.

    A union's partitions stand in the order of its parts, and so do the files: nothing is sorted or moved.
    ``options`` are the writer's (``readers.PACKED``: compressed files of bounded length).
    """
    spark = nodes.sparkSession
    # The document's frame.
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="type" for="node" attr.name="type" attr.type="string"/>', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="relation" for="edge" attr.name="relation" attr.type="string"/>', '<graph edgedefault="directed">']
    lines = lambda some: spark.range(0, 1, 1, 1).select(F.lit("\n".join(some)).alias("value"))
    every = lines(head).unionByName(graphml_lines(nodes, edges)).unionByName(lines(["</graph>", "</graphml>"]))
    every.write.mode("overwrite").options(**options).text(folder)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file's nodes and edges, nulls as empty text."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    line = lambda *parts: F.concat(*[esc(F.col(x)) if k % 2 else F.lit(x) for k, x in enumerate(parts)]).alias("value")
    a = nodes.select(line('<node id="', "id", '"><data key="type">', "type", '</data><data key="label">', "label", "</data></node>"))
    b = edges.select(line('<edge source="', "src", '" target="', "dst", '"><data key="relation">', "relation", "</data></edge>"))
    return a.unionByName(b)
