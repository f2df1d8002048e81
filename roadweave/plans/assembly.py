"""Queries of the operators that put tables together."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.operators import datasets, graph, intervals
from roadweave.plans.base import registrar
from roadweave.plans.telemetry import _CAND_FRAMES, _candidate_sql, _rounded, candidates, reviewed
from roadweave.sources.adapters import TELEMETRY, table, telemetry

QUERIES, SQL, register = registrar()


@register("event_ids", f"WITH {TELEMETRY}, {_candidate_sql()} SELECT clip_id, event_no, printf('%s_evt%04d', clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_time, end_time) - 1) AS event_id FROM cand")
def _(spark, sf_dir):
    return datasets.event_ids(candidates(spark, sf_dir)).select("clip_id", "event_no", "event_id")


@register("frame_plan", "WITH v AS (SELECT c_custkey AS video, c_custkey % 90 + 1 AS n_frames FROM customer), f AS (SELECT video, unnest(range(0, n_frames, 7)) AS frame FROM v) SELECT video, frame, printf('f%06d', frame) AS frame_id, round(frame / 25.0, 2) AS timestamp_sec FROM f")
def _(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video"), (F.col("c_custkey") % 90 + 1).alias("n_frames"), F.lit(25.0).alias("fps"))
    return datasets.frame_plan(v, 7)


@register("window_means", f"WITH {TELEMETRY}, {_candidate_sql()} SELECT c.clip_id, c.event_no, round(coalesce(avg(t.ay), 0), 9) AS mean_ay FROM cand c LEFT JOIN tele t ON t.clip_id = c.clip_id AND t.cts BETWEEN (start_time + end_time) / 2 - 3600 AND (start_time + end_time) / 2 + 3600 GROUP BY 1, 2")
def _(spark, sf_dir):
    e = candidates(spark, sf_dir).withColumn("event_id", F.concat_ws("#", "clip_id", "event_no"))
    return _rounded(datasets.window_means(e, telemetry(spark, sf_dir), ["ay"], 3600.0, 7200.0).select("clip_id", "event_no", "mean_ay"), 9)


@register(
    "peaks_with_fallback",
    f"WITH {TELEMETRY}, {_candidate_sql()}, p AS (SELECT clip_id, cts, ax FROM tele WHERE ay < 30), i AS (SELECT c.clip_id, c.event_no, max(abs(p.ax)) AS v FROM cand c JOIN p ON p.clip_id = c.clip_id AND p.cts BETWEEN start_time AND end_time GROUP BY 1, 2), "
    "n AS (SELECT c.clip_id, c.event_no, max(abs(p.ax)) AS w FROM cand c JOIN p ON p.clip_id = c.clip_id AND p.cts BETWEEN start_time - 3600 AND end_time + 3600 GROUP BY 1, 2) SELECT clip_id, event_no, coalesce(v, w, 2.5) AS peak_ax FROM cand LEFT JOIN i USING (clip_id, event_no) LEFT JOIN n USING (clip_id, event_no)",
)
def _(spark, sf_dir):
    e = candidates(spark, sf_dir).withColumn("event_id", F.concat_ws("#", "clip_id", "event_no"))
    return datasets.peaks_with_fallback(e, telemetry(spark, sf_dir).where("ay < 30"), {"ax": 2.5}, 3600.0, 7200.0).select("clip_id", "event_no", "peak_ax")


@register(
    "review_table",
    f"WITH {TELEMETRY}, {_candidate_sql()}, rv AS (SELECT clip_id, CASE WHEN event_no % 4 = 0 THEN start_time + 30 ELSE start_time END AS start_time, end_time FROM cand WHERE event_no % 3 <> 0), n AS (SELECT (SELECT count(*) FROM cand WHERE clip_id IN (SELECT clip_id FROM rv)) AS np, (SELECT count(*) FROM rv) AS ng) "
    "SELECT 'raw' AS stage, ng AS tp, np - ng AS fp, 0 AS fn FROM n UNION ALL SELECT 'confirmed', ng, 0, 0 FROM n UNION ALL SELECT 'second', NULL, NULL, NULL",
)
def _(spark, sf_dir):
    from roadweave.operators import review

    r = reviewed(spark, sf_dir)
    return datasets.review_table(candidates(spark, sf_dir), r, review.gold_events(r), threshold=30.0).select("stage", "tp", "fp", "fn")


@register("compliance_summary", _CAND_FRAMES + "SELECT count(*) AS total, CAST(count(*) FILTER (severity < 3) AS BIGINT) AS compliant, CAST(count(*) FILTER (severity >= 3) AS BIGINT) AS non_compliant FROM ef")
def _(spark, sf_dir):
    from roadweave.plans.telemetry import event_frames

    return datasets.compliance_summary(event_frames(spark, sf_dir).withColumn("is_compliant", F.col("severity") < 3))


@register("detection_routing", "SELECT l_shipmode_ AS rule, kind, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode_, CASE WHEN l_returnflag = 'A' THEN 'marking' WHEN l_returnflag = 'R' THEN 'sign' ELSE 'object' END AS kind FROM lineitem) GROUP BY 1, 2")
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule"))
    return line.withColumn("kind", graph.detection_kind(F.col("rule"), ("A",), ("R",))).groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("n"))


_ROWS = "pr AS (SELECT o_orderkey AS event_idx, o_totalprice / 100 + CASE WHEN o_orderkey % 9 = 0 THEN 0.7 ELSE 0.1 END AS s, o_orderkey % 4 > 0 AS parsed, o_orderstatus = 'F' AS ev FROM orders WHERE o_orderkey % 5 > 0), gd AS (SELECT o_orderkey AS event_idx, o_totalprice / 100 AS start_time, CASE WHEN o_custkey % 3 > 0 THEN 'Confirm ' ELSE 'reject' END AS decision FROM orders)"
_MET = f"WITH {_ROWS}, m AS (SELECT gd.*, pr.event_idx IS NULL OR abs(s - start_time) > 0.5 AS missing, parsed, ev FROM gd LEFT JOIN pr USING (event_idx)), y AS (SELECT *, CASE WHEN NOT missing THEN coalesce(parsed AND ev, false) END AS pred FROM m) "


def indexed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "event_idx")
    start = F.col("o_totalprice") / 100
    pred = o.where("event_idx % 5 > 0").select("event_idx", (start + F.when(F.col("event_idx") % 9 == 0, 0.7).otherwise(0.1)).alias("start_time"), (F.col("event_idx") % 4 > 0).alias("parsed"), (F.col("o_orderstatus") == "F").alias("pred_is_evasive"))
    gold = o.select("event_idx", start.alias("start_time"), F.when(F.col("o_custkey") % 3 > 0, "Confirm ").otherwise("reject").alias("decision"))
    return pred, gold


@register("predictions_by_index", _MET + "SELECT event_idx, missing, pred FROM y")
def _(spark, sf_dir):
    return datasets.by_index(*indexed(spark, sf_dir)).select("event_idx", "missing", "pred")


@register("true_positives", _MET + "SELECT event_idx FROM y WHERE pred AND lower(trim(decision)) = 'confirm' ORDER BY event_idx LIMIT 40")
def _(spark, sf_dir):
    return datasets.true_positives(*indexed(spark, sf_dir), 40).select("event_idx")


# Greedy thinning walks the events of a category in order and carries the kept middles.
_THIN = (
    "{src}, walk(category, r, kept, ok, n) AS (SELECT category, 1::BIGINT, [mid], true, (SELECT count(*) FROM ord o WHERE o.category = ord.category) FROM ord WHERE r = 1 UNION ALL "
    "SELECT w.category, o.r, CASE WHEN len(w.kept) < {each} AND len(list_filter(w.kept, lambda x: abs(x - o.mid) <= {apart})) = 0 THEN list_append(w.kept, o.mid) ELSE w.kept END, len(w.kept) < {each} AND len(list_filter(w.kept, lambda x: abs(x - o.mid) <= {apart})) = 0, w.n FROM walk w JOIN ord o ON o.category = w.category AND o.r = w.r + 1) "
)


@register("thinned_events", _THIN.format(src=f"WITH RECURSIVE {TELEMETRY}, {_candidate_sql()}, ord AS (SELECT clip_id AS category, event_no, (start_time + end_time) / 2 AS mid, row_number() OVER (PARTITION BY clip_id ORDER BY (start_time + end_time) / 2, event_no) AS r FROM cand)", each=20, apart=20000.0) + "SELECT category, event_no FROM walk JOIN ord USING (category, r) WHERE ok")
def _(spark, sf_dir):
    c = candidates(spark, sf_dir).select(F.col("clip_id").alias("category"), "event_no", ((F.col("start_time") + F.col("end_time")) / 2).alias("mid"))
    return intervals.thinned(c, "mid", "category", [F.col("mid"), F.col("event_no")], 20000.0, 20).select("category", "event_no")


_BACK = "CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2.0 END"


@register(
    "feature_backfill",
    f"WITH {TELEMETRY}, j AS (SELECT *, {', '.join(f'{_BACK.format(c=c)} AS j_{c}' for c in ('ax', 'ay', 'az'))}, CASE WHEN count(az) OVER v >= 50 THEN (az - avg(az) OVER v) / (stddev_samp(az) OVER v + 1e-9) END AS z_az FROM tele WINDOW w AS (PARTITION BY clip_id ORDER BY cts), v AS (PARTITION BY clip_id ORDER BY cts ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)), "
    "q AS (SELECT event_id, z_az, sqrt(j_ax*j_ax + j_ay*j_ay + j_az*j_az) AS t FROM j) SELECT event_id, round(z_az, 6) AS z_az, round(t, 6) AS total_jerk, 30.0 AS speed, CASE WHEN z_az > 2.5 AND t > 2.0 THEN 'braking' WHEN z_az > 1.2 THEN 'deceleration' WHEN z_az < -1.5 THEN 'acceleration' END AS label FROM q",
)
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir).select("event_id", "clip_id", "cts", "ax", "ay", "az")
    got = datasets.backfilled(t, 1.0, 61, {"speed": 30.0})
    return _rounded(got.select("event_id", "z_az", "total_jerk", "speed", "label")).withColumn("speed", F.col("speed").cast("decimal(3,1)"))


_SETS = (
    f"WITH RECURSIVE {TELEMETRY}, {_candidate_sql()}, rv AS (SELECT clip_id, CASE WHEN event_no % 4 = 0 THEN start_time + 30 ELSE start_time END AS start_time, end_time FROM cand WHERE event_no % 3 = 1), "
    "ev AS (SELECT 'gold' AS source, clip_id AS category, clip_id, start_time, end_time FROM rv UNION ALL SELECT 'imu', clip_id, clip_id, start_time, end_time FROM cand), "
    "ord AS (SELECT *, (start_time + end_time) / 2 AS mid, row_number() OVER (PARTITION BY category ORDER BY source = 'imu', (start_time + end_time) / 2) AS r FROM ev)"
)


@register(
    "rider_dataset",
    _THIN.format(src=_SETS, each=8, apart=3600.0) + ", k AS (SELECT o.*, row_number() OVER (ORDER BY source = 'imu', o.category, mid) AS event_id FROM walk JOIN ord o USING (category, r) WHERE ok), "
    "t AS (SELECT * FROM k WHERE event_id <= 30) SELECT CAST(event_id AS INTEGER) AS event_id, source, category, round(mid, 6) AS mid, round(coalesce((SELECT avg(ay) FROM tele WHERE tele.clip_id = t.clip_id AND cts BETWEEN mid - 3.0 AND mid + 3.0), 0), 6) AS mean_ay, round(greatest(0, start_time - 1.5), 6) AS clip_start, round(end_time + 1.5, 6) AS clip_end FROM t",
)
def _(spark, sf_dir):
    from roadweave.operators import review

    c = candidates(spark, sf_dir)
    marked = c.withColumns({"decision": F.when(F.col("event_no") % 3 == 1, "confirm").otherwise("reject"), "adjusted_start": F.when(F.col("event_no") % 4 == 0, (F.col("start_time") + 30).cast("string")).otherwise(" ")})
    named = lambda d: d.select("clip_id", F.col("clip_id").alias("category"), "start_time", "end_time")
    got = datasets.rider_dataset(named(review.gold_events(marked)), named(c), telemetry(spark, sf_dir).select("clip_id", "cts", "ay"), ["ay"], apart=3600.0)
    return _rounded(got.select("event_id", "source", "category", "mid", "mean_ay", "clip_start", "clip_end"))
