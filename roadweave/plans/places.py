"""Queries of the spatial, graph, filter and rider operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.storage import stored
from roadweave.operators import filters, graph, review, rider, spatial, timeseries
from roadweave.plans.base import registrar
from roadweave.plans.telemetry import AXES, GAP, _ev, _rounded, _runs, _score_table, candidates
from roadweave.sources.adapters import TELEMETRY, table, telemetry

QUERIES, SQL, register = registrar()


_GPS = "gps AS (SELECT event_id, 17.5 + ay / 1000 AS lat, 78.2 + ax / 1000 AS lon FROM tele)"


@register(
    "utm",
    f"WITH {TELEMETRY}, {_GPS}, k AS (SELECT *, CAST(0.0066943799901413165 AS DOUBLE) AS e2, CAST(0.0067394967422764341 AS DOUBLE) AS ep, radians(lat) AS phi, radians((floor((avg(lon) OVER () + 180) / 6) + 1 - 1) * 6 - 180 + 3) AS l0, avg(lat) OVER () AS ml FROM gps), "
    "q AS (SELECT *, CAST(6378137.0 AS DOUBLE) / sqrt(1 - e2 * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t, ep * cos(phi) * cos(phi) AS c, cos(phi) * (radians(lon) - l0) AS a, "
    "CAST(6378137.0 AS DOUBLE) * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * phi - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * phi) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * phi) - (35 * e2 * e2 * e2 / 3072) * sin(6 * phi)) AS m FROM k) "
    "SELECT event_id, round(0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120) + 500000, 4) AS x, "
    "round(0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(a, 6) / 720)) + CASE WHEN ml < 0 THEN 10000000 ELSE 0 END, 4) AS y FROM q",
)
def _(spark, sf_dir):
    gps = telemetry(spark, sf_dir).select("event_id", (F.lit(17.5) + F.col("ay") / 1000).alias("lat"), (F.lit(78.2) + F.col("ax") / 1000).alias("lon"))
    return _rounded(spatial.utm(gps).select("event_id", "x", "y"), 4)


EPS = 22.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda i: (F.col("embedding")[i].cast("double") * 1000)
    presence = F.when(F.col("vec_id") % 3 == 0, "Yes").when(F.col("vec_id") % 3 == 1, "No").otherwise("Unknown")
    return e.select(F.col("vec_id").alias("id"), v(0).alias("x"), v(1).alias("y"), F.abs(v(2)).alias("icdi"), F.col("label").cast("string").alias("violation_type"), presence.alias("presence"))


_POINTS = (
    "WITH RECURSIVE pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, abs(CAST(embedding[3] AS DOUBLE) * 1000) AS icdi, CAST(label AS VARCHAR) AS violation_type, CASE vec_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unknown' END AS presence FROM embeddings), "
    f"near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS}), core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 4), "
    "ce AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, ce.b FROM reach r JOIN ce ON r.b = ce.a), lowest AS (SELECT a AS id, min(b) AS low FROM reach GROUP BY 1), "
    "num AS (SELECT low, CAST(row_number() OVER (ORDER BY low) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT low FROM lowest)), oc AS (SELECT id, cluster FROM lowest JOIN num USING (low)), "
    "bo AS (SELECT near.a AS id, min(oc.cluster) AS cluster FROM near JOIN oc ON near.b = oc.id WHERE near.a NOT IN (SELECT id FROM core) GROUP BY 1), cl AS (SELECT pts.*, coalesce(oc.cluster, bo.cluster, -1) AS cluster FROM pts LEFT JOIN oc USING (id) LEFT JOIN bo USING (id)) "
)


@register("dbscan", _POINTS + "SELECT id, cluster FROM cl")
def _(spark, sf_dir):
    return spatial.dbscan(points(spark, sf_dir), EPS)


def clustered(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.join(spatial.dbscan(p, EPS), "id")


_METRICS = _POINTS + (
    ", pr AS (SELECT avg(icdi) AS prior FROM pts), ty AS (SELECT cluster, violation_type, count(*) AS c, min(id) AS f FROM cl WHERE cluster >= 0 GROUP BY 1, 2), tt AS (SELECT cluster, violation_type AS dominant_type, c AS top FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, f) AS r FROM ty) WHERE r = 1), "
    "b AS (SELECT cluster, count(*) AS n, avg(icdi) AS rr, sum(CASE WHEN presence <> 'Unknown' THEN icdi ELSE 0 END) AS mass, sum(CASE WHEN presence = 'No' THEN icdi ELSE 0 END) AS absent, count(*) FILTER (presence = 'No') AS nn, count(*) FILTER (presence <> 'Unknown') AS nk FROM cl WHERE cluster >= 0 GROUP BY 1), "
    "mx AS (SELECT cluster, n, rr, (n * rr + 10 * prior) / (n + 10) AS bcs, dominant_type, top / n AS share, CASE WHEN nk > 0 THEN CASE WHEN mass > 0 THEN absent / mass ELSE nn / nk END END AS infra FROM b JOIN tt USING (cluster), pr) "
)


@register("hotspot_metrics", _METRICS + "SELECT cluster, n, round(rr, 6) AS risk_rate, round(bcs, 6) AS bcs, dominant_type, round(share, 6) AS type_share, round(infra, 6) AS infra_share FROM mx")
def _(spark, sf_dir):
    return _rounded(spatial.cluster_metrics(clustered(spark, sf_dir)).drop("x", "y"))


@register("hotspot_rank", _METRICS + ", sc AS (SELECT cluster, n, bcs * (1 + 0.5 * share) * CASE WHEN infra IS NULL THEN 0.5 ELSE 0.5 * infra + 0.5 * (1 - infra) END AS score FROM mx) SELECT cluster, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, cluster) AS INTEGER) AS rank, n < 5 AS low_confidence FROM sc")
def _(spark, sf_dir):
    return _rounded(spatial.ranked(spatial.cluster_metrics(clustered(spark, sf_dir))).select("cluster", "score", "rank", "low_confidence"))


def tables_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The star schema as a graph: regions as documents, nations as sections, customers as clauses, orders as frames, lines as violations."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "lineitem")}
    doc = lambda c: graph.node("Document", F.col(c))
    sec, cla, fra = (lambda k: (lambda c: graph.node(k, F.col(c))))("Section"), (lambda c: graph.node("Clause", F.col(c))), (lambda c: graph.node("Frame", F.col(c)))
    vio = graph.node("Violation", F.col("l_orderkey"), F.col("l_linenumber"))
    nodes = graph.union_nodes(
        graph.nodes_of(t["region"], "Document", doc("r_regionkey"), F.col("r_name")), graph.nodes_of(t["nation"], "Section", sec("n_nationkey"), F.col("n_name")),
        graph.nodes_of(t["customer"], "Clause", cla("c_custkey"), F.col("c_mktsegment")), graph.nodes_of(t["orders"], "Frame", fra("o_orderkey"), F.col("o_orderstatus")), graph.nodes_of(t["lineitem"], "Violation", vio, F.col("l_returnflag")),
    )
    edges = graph.union_edges(
        graph.edges_of(t["nation"], sec("n_nationkey"), doc("n_regionkey"), "PART_OF"), graph.edges_of(t["customer"], cla("c_custkey"), sec("c_nationkey"), "PART_OF"),
        graph.edges_of(t["orders"], fra("o_orderkey"), cla("o_custkey"), "CITES"), graph.edges_of(t["lineitem"], fra("l_orderkey"), vio, "RESULTS_IN"),
    )
    return nodes, edges


_NODES = (
    "nodes AS (SELECT id, min(type) AS type, min(label) AS label FROM (SELECT 'Document:' || r_regionkey AS id, 'Document' AS type, r_name AS label FROM region UNION ALL SELECT 'Section:' || n_nationkey, 'Section', n_name FROM nation UNION ALL SELECT 'Clause:' || c_custkey, 'Clause', c_mktsegment FROM customer "
    "UNION ALL SELECT 'Frame:' || o_orderkey, 'Frame', o_orderstatus FROM orders UNION ALL SELECT 'Violation:' || l_orderkey || ':' || l_linenumber, 'Violation', l_returnflag FROM lineitem) GROUP BY id)"
)
_EDGES = (
    "edges AS (SELECT DISTINCT 'Section:' || n_nationkey AS src, 'Document:' || n_regionkey AS dst, 'PART_OF' AS relation FROM nation UNION ALL SELECT DISTINCT 'Clause:' || c_custkey, 'Section:' || c_nationkey, 'PART_OF' FROM customer "
    "UNION ALL SELECT 'Frame:' || o_orderkey, 'Clause:' || o_custkey, 'CITES' FROM orders UNION ALL SELECT 'Frame:' || l_orderkey, 'Violation:' || l_orderkey || ':' || l_linenumber, 'RESULTS_IN' FROM lineitem)"
)


@register("graph_nodes", f"WITH {_NODES} SELECT id, type, label FROM nodes")
def _(spark, sf_dir):
    return tables_graph(spark, sf_dir)[0]


@register("graph_edges", f"WITH {_EDGES} SELECT src, dst, relation FROM edges")
def _(spark, sf_dir):
    return tables_graph(spark, sf_dir)[1]


@register("graph_stats", f"WITH {_NODES}, {_EDGES} SELECT 'node' AS what, type AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY 2")
def _(spark, sf_dir):
    return graph.summary(*tables_graph(spark, sf_dir))


@register(
    "report_flattening",
    "WITH v AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS p FROM lineitem WHERE l_returnflag <> 'N') "
    "SELECT o_orderkey AS frame_id, CASE WHEN p IS NOT NULL THEN o_orderkey || '_v' || printf('%02d', p) END AS event_id, p IS NULL AS is_compliant, l_returnflag AS rule FROM orders LEFT JOIN v ON o_orderkey = l_orderkey",
)
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    per = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("rule")))).alias("violations"))
    frames = table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("frame_id"), "violations")
    return graph.flatten_reports(frames).select("frame_id", "event_id", "is_compliant", "rule")


def _filter_sql(settings: list[tuple[str, float | None, float | None, int]], fs: float) -> str:
    """CTEs that end in ``filtered`` (config, event_id, clip_id, cts, ax_bpf, ay_bpf, az_bpf): the filters as recursions over each clip's samples.

    One recursion runs over all settings, clips and axes at once, forward; another backward over its
    result. A row carries the states of the sections; settings with fewer sections have ones that
    pass their input on. Coefficients and steady states are those of ``filters``.
    """
    made = {name: filters.sections(fs, low, high, order) for name, low, high, order in settings if (low, high) != (None, None)}
    most = max(len(x) for x in made.values())
    rows = []
    for name, sos in made.items():
        steady = filters._steady(sos)
        cells = [f"'{name}'", str(3 * (2 * len(sos) + 1))]
        for i in range(most):
            own, state = (sos[i], steady[i]) if i < len(sos) else ([1.0, 0, 0, 1, 0, 0], [0.0, 0.0])
            cells += [f"CAST({float(x)!r} AS DOUBLE)" for x in (own[0], own[1], own[2], own[4], own[5], state[0], state[1])]
        rows.append("(" + ", ".join(cells) + ")")
    names = ["config", "pad"] + [f"{c}{i}" for i in range(most) for c in ("b", "c", "d", "e", "f", "g", "h")]
    states = ", ".join(f"s{i}, t{i}" for i in range(most))
    first = ", ".join(f"g{i} * xs[1] AS s{i}, h{i} * xs[1] AS t{i}" for i in range(most))
    # Through the sections: y of one is the input of the next.
    steps = "x.xs[r.i + 1] AS v0, " + ", ".join(f"b{i} * v{i} + r.s{i} AS v{i + 1}" for i in range(most))
    nexts = ", ".join(f"c{i} * v{i} - e{i} * v{i + 1} + t{i} AS n{i}, d{i} * v{i} - f{i} * v{i + 1} AS m{i}" for i in range(most))

    def run(name: str, signal: str) -> str:
        inner = f"SELECT r.config, r.clip_id, r.axis, r.i, {', '.join(f'r.t{i}' for i in range(most))}, {', '.join(f'co.{c}{i}' for i in range(most) for c in 'cdef')}, {steps} FROM {name} r JOIN {signal} x ON x.config = r.config AND x.clip_id = r.clip_id AND x.axis = r.axis JOIN co ON co.config = r.config WHERE r.i < len(x.xs)"
        return (
            f"{name}(config, clip_id, axis, i, y, {states}) AS (SELECT x.config, clip_id, axis, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), {first} FROM {signal} x JOIN co ON co.config = x.config UNION ALL "
            f"SELECT config, clip_id, axis, i + 1, v{most}, {', '.join(f'n{i}, m{i}' for i in range(most))} FROM (SELECT *, {nexts} FROM ({inner})))"
        )

    plain = " ".join(f"UNION ALL SELECT '{name}', event_id, clip_id, cts, ax, ay, az FROM tele" for name, low, high, _ in settings if (low, high) == (None, None))
    return (
        f"co({', '.join(names)}) AS (VALUES {', '.join(rows)}), sig AS (SELECT clip_id, axis, list(v ORDER BY cts) AS x FROM (SELECT clip_id, cts, unnest(['ax', 'ay', 'az']) AS axis, unnest([ax, ay, az]) AS v FROM tele) GROUP BY 1, 2), "
        "ext AS (SELECT config, clip_id, axis, list_concat(list_concat(list_transform(range(0, pad), lambda j: 2 * x[1] - x[pad + 1 - j]), x), list_transform(range(1, pad + 1), lambda j: 2 * x[len(x)] - x[len(x) - j])) AS xs FROM sig, co), "
        + run("fw", "ext") + ", back AS (SELECT config, clip_id, axis, list(y ORDER BY i DESC) AS xs FROM fw WHERE i > 0 GROUP BY 1, 2, 3), " + run("bw", "back")
        + ", z AS (SELECT bw.config, clip_id, axis, len(xs) - i + 1 - pad AS no, y FROM bw JOIN back USING (config, clip_id, axis) JOIN co USING (config) WHERE i > 0), num AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY cts) AS no FROM tele), "
        f"filtered AS (SELECT z.config, event_id, clip_id, cts, max(y) FILTER (axis = 'ax') AS ax_bpf, max(y) FILTER (axis = 'ay') AS ay_bpf, max(y) FILTER (axis = 'az') AS az_bpf FROM z JOIN num USING (clip_id, no) GROUP BY ALL {plain}) "
    )


_BAND = [("band", 0.05, 0.3, 4)]


@register("zero_phase_filter", f"WITH RECURSIVE {TELEMETRY}, {_filter_sql(_BAND, 1.0)} SELECT event_id, round(ax_bpf, 6) AS ax_bpf, round(ay_bpf, 6) AS ay_bpf, round(az_bpf, 6) AS az_bpf FROM filtered")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return _rounded(filters.filtered(t, AXES, 1.0, 0.05, 0.3, 4).select("event_id", *[f"{c}_bpf" for c in AXES]))


#: Filter settings of the ablation (name, low, high, order), with cutoffs for one sample a second; then the sweep of orders.
FILTERS = [
    ("raw", None, None, 4), ("low_pass", None, 0.3, 4), ("high_pass", 0.02, None, 4), ("band", 0.02, 0.4, 4), ("band_higher_order", 0.02, 0.4, 6), ("narrow_band", 0.05, 0.3, 4),
    *[(f"order_{n}", 0.05, 0.4, n) for n in (2, 4, 6, 8)],
]


def _ablation_sql() -> str:
    total = "sqrt(ax_bpf*ax_bpf + ay_bpf*ay_bpf + az_bpf*az_bpf)"
    w = "(PARTITION BY config, clip_id ORDER BY cts ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"
    snr = " UNION ALL ".join(f"SELECT f.config, f.clip_id, 10 * log10(var_pop(t.{c}) / var_pop(f.{c}_bpf)) AS db FROM filtered f JOIN tele t USING (event_id) GROUP BY 1, 2" for c in AXES)
    return (
        f"WITH RECURSIVE {TELEMETRY}, {_filter_sql(FILTERS, 1.0)}, zt AS (SELECT config, clip_id, cts, ({total} - avg({total}) OVER {w}) / nullif(stddev_samp({total}) OVER {w}, 0) AS z FROM filtered), {_runs('fr', 'zt', 'abs(z) > 2.4', GAP, 'config, clip_id')}, "
        f"every AS (SELECT config, clip_id, min(cts) AS start_time, max(cts) AS end_time FROM fr GROUP BY config, clip_id, event_no), {_ev('g', 2.4)}, {_score_table('g', 60.0)}, sn AS (SELECT config, avg(db) AS db FROM ({snr}) GROUP BY 1) "
        "SELECT config, n_pred, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN tt = 0 THEN 0 ELSE 2.0 * tt / (n_pred + ng) END, 6) AS f1_tolerance, round(db, 6) AS mean_snr_db FROM sc JOIN sn USING (config)"
    )


@register("filter_ablation", _ablation_sql())
def _(spark, sf_dir):
    """Filter settings as a column, one detector, both scores and the mean signal-to-noise ratio."""
    got = review.filter_table(telemetry(spark, sf_dir), candidates(spark, sf_dir, 2.4), FILTERS, AXES, 1.0, 20, 2.4, GAP, tolerance=60.0)
    return _rounded(got.select("config", "n_pred", "f1", "f1_tolerance", "mean_snr_db"))


#: The full grid: 5 bands x 2 orders x 5 widths x 6 k x 3 channels.
BANDS = [(0.02, 0.4), (0.05, 0.3), (0.01, 0.45), (0.1, 0.4), (0.02, 0.3)]
ORDERS, WIDTHS, KS, CHANNELS = (2, 4), (10, 16, 20, 30, 40), (1.5, 1.75, 2.0, 2.25, 2.5, 3.0), (1, 2, 3)


def _grid_sql() -> str:
    settings = [(f"{low}|{high}|{order}", low, high, order) for low, high in BANDS for order in ORDERS]
    scores = []
    for w in WIDTHS:
        win = f"(PARTITION BY config, clip_id ORDER BY cts ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING)"
        scores.append(f"SELECT config, clip_id, cts, {w} AS width, " + ", ".join(f"abs(({c}_bpf - avg({c}_bpf) OVER {win}) / nullif(stddev_samp({c}_bpf) OVER {win}, 0)) AS z_{c}" for c in AXES) + " FROM filtered")
    votes = " + ".join(f"CASE WHEN z_{c} > k THEN 1 ELSE 0 END" for c in AXES)
    keys = "part, clip_id"
    every = "every AS (SELECT part AS config, clip_id, min(cts) AS start_time, max(cts) AS end_time FROM gr GROUP BY part, clip_id, event_no)"
    flags = f"fl AS (SELECT config || '|' || width || '|' || CAST(k AS DOUBLE) || '|' || channels AS part, clip_id, cts FROM zz, (SELECT unnest({list(KS)}) AS k), (SELECT unnest({list(CHANNELS)}) AS channels) WHERE {votes} >= channels)"
    best = lambda name, f: f"SELECT '{name}' AS by, config, n_pred, {f} AS f1 FROM (SELECT *, row_number() OVER (ORDER BY {f} DESC, config) AS r FROM ro) WHERE r <= 10"
    return (
        f"WITH RECURSIVE {TELEMETRY}, {_filter_sql(settings, 1.0)}, zz AS ({' UNION ALL '.join(scores)}), {flags}, {_runs('gr', 'fl', 'true', GAP, keys)}, {every}, {_ev('g', 2.4)}, {_score_table('g', 60.0)}, "
        "ro AS (SELECT config, n_pred, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN tt = 0 THEN 0 ELSE 2.0 * tt / (n_pred + ng) END, 6) AS ft FROM sc) "
        + best("overlap", "f1") + " UNION ALL " + best("tolerance", "ft")
    )


@register("grid_search_full", _grid_sql())
def _(spark, sf_dir):
    """The best ten of all 900 settings by each score."""
    got = review.filter_grid(telemetry(spark, sf_dir), candidates(spark, sf_dir, 2.4), BANDS, ORDERS, AXES, 1.0, WIDTHS, KS, CHANNELS, GAP, tolerance=60.0)
    rows = got.where("f1 is not null").select(F.concat_ws("|", *[F.col(c).cast("string") for c in ("low", "high", "order", "width", "k", "channels")]).alias("config"), "n_pred", F.round("f1", 6).alias("f1"), F.round("f1_tolerance", 6).alias("ft"))
    rows = stored(rows, "grid-scores")
    best = lambda name, f: rows.orderBy(F.desc(f), "config").limit(10).select(F.lit(name).alias("by"), "config", "n_pred", F.col(f).alias("f1"))
    return best("overlap", "f1").unionByName(best("tolerance", "ft"))


def rider_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    action = F.element_at(F.array(*map(F.lit, rider.ACTION)), (F.col("doc_id") % 4 + 1).cast("int"))
    clause = lambda m: F.concat(F.lit("c"), (F.col("doc_id") % m).cast("string"))
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " a car ahead made the rider brake hard and swerve at once").otherwise(" IRC:35 pavement gap"))
    return d.select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("rider"), F.when(F.col("doc_id") % 2 == 0, "V1").otherwise("V2").alias("model"), action.alias("evasive_action"),
        said.alias("evasive_reasoning"), F.when(F.col("doc_id") % 5 == 0, "traffic ahead").otherwise("empty").alias("env"), F.lit("smooth").alias("road_surface"), F.lit("none").alias("infrastructure"),
        F.when(F.col("quality") == 0, "NON_COMPLIANT").otherwise("COMPLIANT").alias("irc35_verdict"), F.lit("COMPLIANT").alias("irc67_verdict"), clause(5).alias("irc35_clause"), F.lit("").alias("irc67_clause"),
        F.concat_ws(";", clause(3), clause(7)).alias("retrieved_irc35"), F.lit("").alias("retrieved_irc67"), (F.col("doc_id") % 10 / 10).alias("crrs35"), F.lit(0.5).alias("crrs67"),
    )


def _patterns(sql: str) -> str:
    """SQL with the rider rules' patterns in it."""
    action = "CASE a " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(rider.ACTION.values())) + " END"
    for name, text in {"{HAZARD}": rider.HAZARD, "{BLEED}": rider.BLEED, "{TELEMETRY}": rider.TELEMETRY, "{ACTION}": action}.items():
        sql = sql.replace(name, text)
    return sql


@register("rider_metrics", _patterns(
    "WITH r AS (SELECT doc_id, source AS rider, CASE WHEN doc_id % 2 = 0 THEN 'V1' ELSE 'V2' END AS model, doc_id % 4 AS a, text || CASE WHEN doc_id % 3 = 0 THEN ' a car ahead made the rider brake hard and swerve at once' ELSE ' IRC:35 pavement gap' END AS s, CASE WHEN doc_id % 5 = 0 THEN 'traffic ahead' ELSE 'empty' END AS env, quality FROM documents JOIN labels USING (doc_id)), "
    "o AS (SELECT rider, model, CASE WHEN doc_id % 5 IN (doc_id % 3, doc_id % 7) THEN 1 ELSE 0 END AS c, CASE WHEN regexp_matches(s, '{HAZARD}') AND NOT regexp_matches(s, '{BLEED}') AND len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 8 THEN 1 ELSE 0 END AS h, "
    "CASE WHEN quality = 0 THEN 1 ELSE 0 END AS i, CASE WHEN regexp_matches(s, {ACTION}) THEN 1 ELSE 0 END AS d, "
    "round((doc_id % 10 / 10 + 0.5) / 2, 4) AS cr, CASE WHEN model = 'V1' AND regexp_matches(env || ' ' || s || ' smooth none', '{TELEMETRY}') THEN 1 ELSE 0 END AS t, CASE WHEN env <> 'empty' THEN 1 ELSE 0 END AS v FROM r) "
    "SELECT rider, model, count(*) AS n, round(avg(c), 4) AS rider_chr, round(avg(h), 4) AS rider_rhr, round(avg(i), 4) AS rider_icdi, round(avg(d), 4) AS rider_idas, round(avg(cr), 4) AS rider_crrs, round(avg(t), 4) AS rider_tipu, round(avg(v), 4) AS rider_tvgc FROM o GROUP BY 1, 2"
))
def _(spark, sf_dir):
    return rider.summary(rider_rows(spark, sf_dir))
