"""Spatial risk: projection, density clustering, cluster scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.storage import stored
from roadweave.operators.components import connected
from roadweave.operators.scans import numbered

#: Fixed values of the WGS84 ellipsoid and the UTM grid.
AXIS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def utm(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` plus x, y (metres) in the UTM zone of the mean position, by the series of the transverse Mercator projection."""
    mean = points.agg(F.avg(lat).alias("_mlat"), F.avg(lon).alias("_mlon"))
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    phi, zone = F.radians(F.col(lat)), F.floor((F.col("_mlon") + 180) / 6) + 1
    lon0 = F.radians((zone - 1) * 6 - 180 + 3)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n = AXIS / F.sqrt(1 - e2 * s * s)
    t2, cc, a = t * t, ep2 * c * c, c * (F.radians(F.col(lon)) - lon0)
    m = AXIS * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = SCALE * n * (a + (1 - t2 + cc) * F.pow(a, 3.0) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * cc - 58 * ep2) * F.pow(a, 5.0) / 120) + EAST
    y = SCALE * (m + n * t * (a * a / 2 + (5 - t2 + 9 * cc + 4 * cc * cc) * F.pow(a, 4.0) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * cc - 330 * ep2) * F.pow(a, 6.0) / 720))
    north = y + F.when(F.col("_mlat") < 0, SOUTH).otherwise(0.0)
    return points.crossJoin(mean).withColumns({"x": x, "y": north}).drop("_mlat", "_mlon")  # single-row scalar


def _near(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """Pairs of points of ``a`` and ``b`` (id, x, y, cx, cy; b's columns prefixed) not farther than ``eps``.

    Cells have side eps / sqrt(2), so partners are at most two cells away.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4])
    spread = a.withColumn("_o", F.explode(offsets)).withColumns({"_cx": F.col("cx") + F.col("_o.i"), "_cy": F.col("cy") + F.col("_o.j")}).drop("_o")
    other = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    d2 = (F.col("x") - F.col("b_x")) * (F.col("x") - F.col("b_x")) + (F.col("y") - F.col("b_y")) * (F.col("y") - F.col("b_y"))
    return spread.join(other, (F.col("_cx") == F.col("b_cx")) & (F.col("_cy") == F.col("b_cy"))).where(d2 <= eps * eps)


#: Pairs of points that one pair of boxes may be compared by; larger ones are split.
LEAF = 4096


def _boxes(points: DataFrame, *keys: str) -> DataFrame:
    """keys, n, bounds, and the outermost points of the points of each box."""
    p = F.struct("x", "y")
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.array(F.min_by(p, "x"), F.max_by(p, "x"), F.min_by(p, "y"), F.max_by(p, "y")).alias("outer"),
    )


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs of boxes (a_, b_) plus verdict: true if some of their points are within ``eps``, false if none are, null if bounds and outermost points don't tell."""

    def apart(lo: str, hi: str) -> tuple[Column, Column]:
        gap = F.greatest(F.lit(0.0), F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.col(f"a_{lo}") - F.col(f"b_{hi}"))
        return gap, F.greatest(F.abs(F.col(f"b_{hi}") - F.col(f"a_{lo}")), F.abs(F.col(f"a_{hi}") - F.col(f"b_{lo}")))

    (gx, fx), (gy, fy) = apart("x0", "x1"), apart("y0", "y1")
    square = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    met = F.exists("a_outer", lambda p: F.exists("b_outer", lambda q: square(p, q) <= eps * eps))
    sure = (fx * fx + fy * fy <= eps * eps) | met
    return pairs.withColumn("verdict", F.when(gx * gx + gy * gy > eps * eps, False).when(sure, True))


def _linked_cells(core: DataFrame, eps: float) -> DataFrame:
    """node, b_node of cells whose core points (id, x, y, cx, cy, node) come within ``eps`` of each other.

    Cells are boxes. Neighbouring boxes are linked or not by their bounds and outermost points as a
    rule. Else small ones are compared by points, ``LEAF`` pairs at most, and large ones are split into
    quarters, of which pairs that may touch go on; a link found ends all pairs of its cells. So dense
    neighbours cost their border, not the product of their sizes.
    """
    names = ["n", "x0", "x1", "y0", "y1", "outer"]
    side = lambda df, prefix, keys: df.select(*[F.col(c).alias(f"{prefix}{c}") for c in [*keys, *names]])
    boxes = stored(_boxes(core, "cx", "cy", "node"), "boxes")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4 and (i, j) > (0, 0)])
    a = side(boxes, "a_", ["cx", "cy", "node"]).withColumn("_o", F.explode(offsets)).withColumns({"b_cx": F.col("a_cx") + F.col("_o.i"), "b_cy": F.col("a_cy") + F.col("_o.j")})
    pairs = a.join(side(boxes, "b_", ["cx", "cy", "node"]), ["b_cx", "b_cy"]).select("a_node", "b_node", F.col("a_node").alias("a_box"), F.col("b_node").alias("b_box"), *[f"{p}{c}" for p in ("a_", "b_") for c in names])
    points = core.select("x", "y", F.col("node").alias("box"))
    linked = []
    while True:
        judged = stored(_judged(pairs, eps), "box-pairs")
        links = judged.where("verdict").select("a_node", "b_node").distinct()
        open_ = judged.where("verdict is null").join(links, ["a_node", "b_node"], "left_anti")
        small = open_.where(F.col("a_n") * F.col("b_n") <= LEAF).select("a_node", "b_node", "a_box", "b_box")
        left = points.select(F.col("box").alias("a_box"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        right = points.select(F.col("box").alias("b_box"), F.col("x").alias("_u"), F.col("y").alias("_v"))
        d2 = (F.col("_x") - F.col("_u")) * (F.col("_x") - F.col("_u")) + (F.col("_y") - F.col("_v")) * (F.col("_y") - F.col("_v"))
        near = small.join(left, "a_box").join(right, "b_box").where(d2 <= eps * eps).select("a_node", "b_node").distinct()
        links = stored(links.unionByName(near), "box-links")
        linked.append(links)
        large = stored(open_.where(F.col("a_n") * F.col("b_n") > LEAF).join(links, ["a_node", "b_node"], "left_anti"), "box-open")
        if large.isEmpty():
            break
        bounds = large.select(F.col("a_box").alias("box"), *[F.col(f"a_{c}").alias(c) for c in names[1:5]]).unionByName(large.select(F.col("b_box").alias("box"), *[F.col(f"b_{c}").alias(c) for c in names[1:5]])).distinct()
        half = lambda c: ((F.col(c) > (F.col(f"{c}0") + F.col(f"{c}1")) / 2) | ((F.col(c) == F.col(f"{c}1")) & (F.col(f"{c}0") < F.col(f"{c}1")))).cast("long")
        split = points.join(bounds, "box").select("x", "y", F.col("box").alias("parent"), (half("x") * 2 + half("y")).alias("quarter"))
        parts = _boxes(split, "parent", "quarter").withColumn("box", F.monotonically_increasing_id())
        parts = stored(parts, "boxes")
        points = stored(split.join(parts.select("parent", "quarter", "box"), ["parent", "quarter"]).select("x", "y", "box"), "box-points")
        pairs = large.select("a_node", "b_node", F.col("a_box").alias("a_parent"), F.col("b_box").alias("b_parent"))
        pairs = pairs.join(side(parts, "a_", ["parent", "box"]), "a_parent").join(side(parts, "b_", ["parent", "box"]), "b_parent").drop("a_parent", "b_parent")
    return reduce(DataFrame.unionByName, linked).select(F.col("a_node").alias("node"), "b_node")


def dbscan(points: DataFrame, eps: float = 75.0, least: int = 4, key: str = "id") -> DataFrame:
    """key, cluster of each point (key, x, y): density clusters, numbered by their lowest core key, noise -1.

    A core point has at least ``least`` points within ``eps``, itself included. Border points go to the
    lowest-numbered cluster near them. All points of a cell of side eps / sqrt(2) are neighbours:
    cells with ``least`` points are core without any pair, and core points of a cell are one node of
    the component graph, so a dense cell is never paired with itself; two dense cells are compared by
    boxes. Points of sparse cells, fewer than ``least`` a cell, meet those of the cells around. Needs
    distinct keys.
    """
    side = eps / math.sqrt(2) * (1 - 1e-12)
    p = points.select(F.col(key).alias("id"), "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    counts = p.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    p = stored(p.join(counts, ["cx", "cy"]).select("id", "x", "y", "cx", "cy", "n"), "points")
    lean = p.select("id", "x", "y", "cx", "cy")
    sparse = _near(p.where(F.col("n") < least).drop("n"), lean, eps).groupBy("id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    core = p.where(F.col("n") >= least).drop("n").unionByName(lean.join(sparse.select("id"), "id", "left_semi"))
    node = core.groupBy("cx", "cy").agg(F.min("id").alias("node"))
    core = stored(core.join(node, ["cx", "cy"]).select("id", "x", "y", "cx", "cy", "node"), "core")
    groups = connected(_linked_cells(core, eps))
    lowest = core.select("id", "node").join(groups.withColumnRenamed("node", "_g"), F.col("node") == F.col("_g"), "left").select("id", F.coalesce("label", "node").alias("label"))
    clusters = numbered(lowest.select("label").distinct(), [], ["label"]).select("label", F.col("_i").cast("int").alias("cluster"))
    of_core = stored(lowest.join(clusters, "label").select("id", "cluster"), "clusters")
    rest = lean.join(of_core.select("id"), "id", "left_anti")
    marked = core.join(of_core, "id").select("id", "x", "y", "cx", "cy", "cluster")
    border = _near(rest, marked, eps).groupBy("id").agg(F.min("b_cluster").alias("cluster"))
    others = rest.select("id").join(border, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return of_core.unionByName(others).withColumnRenamed("id", key)


def cluster_metrics(points: DataFrame, key: str = "id", k: float = 10.0) -> DataFrame:
    """One row a cluster of ``points`` (cluster, x, y, icdi, violation_type, presence).

    n, mean icdi, shrunk score (n r + k prior) / (n + k) with the mean over all points (noise included)
    as prior, most frequent type (first seen on ties) and its share, the share of icdi where
    infrastructure is absent among known cases (by count if there is no icdi, null if none is known), centroid.
    """
    prior = points.agg(F.avg("icdi").alias("prior"))
    inside = points.where("cluster >= 0")
    types = inside.groupBy("cluster", "violation_type").agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("first"))
    top = types.groupBy("cluster").agg(F.max_by("violation_type", F.struct("c", (-F.col("first")).alias("f"))).alias("dominant_type"), F.max("c").alias("top"))
    no, known = F.col("presence") == "No", F.col("presence").isin("Yes", "No")
    mass, absent = F.sum(F.when(known, F.col("icdi")).otherwise(0.0)), F.sum(F.when(no, F.col("icdi")).otherwise(0.0))
    counted = F.try_divide(F.sum(no.cast("double")), F.sum(known.cast("double")))
    base = inside.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("icdi").alias("risk_rate"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.when(F.sum(known.cast("int")) > 0, F.when(mass > 0, absent / mass).otherwise(counted)).alias("infra_share"),
    )
    out = base.join(top, "cluster").crossJoin(prior)  # single-row scalar
    bcs = (F.col("n") * F.col("risk_rate") + k * F.col("prior")) / (F.col("n") + k)
    return out.select("cluster", "n", "risk_rate", bcs.alias("bcs"), "dominant_type", (F.col("top") / F.col("n")).alias("type_share"), "infra_share", "x", "y")


def hotspot_score(bcs: Column, share: Column, infra: Column, beta: float = 0.5, gamma: float = 0.5) -> Column:
    """bcs (1 + beta share) (gamma i + (1 - gamma)(1 - i)); the last factor is 0.5 where i is unknown."""
    blend = F.when(infra.isNull(), 0.5).otherwise(gamma * infra + (1 - gamma) * (1 - infra))
    return bcs * (1 + beta * share) * blend


def ranked(metrics: DataFrame, beta: float = 0.5, gamma: float = 0.5, least: int = 5) -> DataFrame:
    """``metrics`` plus score, rank (by score) and whether a cluster is too small to report. One row a cluster, numbered over ranges."""
    scored = metrics.withColumn("score", hotspot_score(F.col("bcs"), F.col("type_share"), F.col("infra_share"), beta, gamma))
    places = numbered(scored, [], [F.desc("score"), F.col("cluster")])
    return places.withColumns({"rank": (F.col("_i") + 1).cast("int"), "low_confidence": F.col("n") < least}).drop("_i", "_n")
