"""Queries of the telemetry operators: detection, strategies, joins in time, scoring, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators import detect, intervals, review, risk, timeseries
from roadweave.plans.base import registrar
from roadweave.sources.adapters import FRAMES, TELEMETRY, frames, telemetry

#: Samples of the events table are about 20 minutes apart, so gaps are hours.
WIDTH, K, GAP = 20, 2.0, 7200.0
AXES = ("ax", "ay", "az")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _z(column: str, width: int = WIDTH, where: str = "tele") -> str:
    w = f"(PARTITION BY clip_id ORDER BY cts ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING)"
    return f"({column} - avg({column}) OVER {w}) / nullif(stddev_samp({column}) OVER {w}, 0)"


def _runs(name: str, source: str, flag: str, gap: float = GAP, keys: str = "clip_id") -> str:
    return (
        f"{name} AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY cts) AS event_no FROM (SELECT *, CASE WHEN cts - lag(cts) OVER "
        f"(PARTITION BY {keys} ORDER BY cts) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {source} WHERE {flag}))"
    )


def candidates(spark: SparkSession, sf_dir: str, k: float = K) -> DataFrame:
    return detect.candidate_events(telemetry(spark, sf_dir), "ax", WIDTH, k, GAP)


def _candidate_sql(k: float = K, name: str = "cand", run: str = "runs") -> str:
    return (
        f"{name}_z AS (SELECT *, {_z('ax')} AS z FROM tele), {_runs(run, f'{name}_z', f'abs(z) > {k}')}, "
        f"{name} AS (SELECT clip_id, CAST(event_no AS INTEGER) AS event_no, min(cts) AS start_time, max(cts) AS end_time, count(*) AS n_samples, "
        f"max(least(1.0, abs(z) / 6)) AS peak_confidence, max(abs(z)) AS peak_abs_z FROM {run} GROUP BY clip_id, event_no)"
    )


QUERIES, SQL, register = registrar()


_ROUND_EVENT = "SELECT clip_id, event_no, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time"


@register("candidate_events", f"WITH {TELEMETRY}, {_candidate_sql()} {_ROUND_EVENT}, n_samples, round(peak_confidence, 6) AS peak_confidence, round(peak_abs_z, 6) AS peak_abs_z FROM cand")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(candidates(spark, sf_dir))


@register("sample_rate", f"WITH {TELEMETRY}, d AS (SELECT clip_id, cts - lag(cts) OVER (PARTITION BY clip_id ORDER BY cts) AS dt FROM tele) SELECT clip_id, round(1 / median(dt), 9) AS fs FROM d GROUP BY clip_id")
def _(spark, sf_dir):
    return _rounded(timeseries.sample_rate(telemetry(spark, sf_dir)), 9)


_GRAD = "CASE WHEN lag({c}) OVER w IS NULL THEN (lead({c}) OVER w - {c}) / 0.5 WHEN lead({c}) OVER w IS NULL THEN ({c} - lag({c}) OVER w) / 0.5 ELSE (lead({c}) OVER w - lag({c}) OVER w) / 1.0 END"


@register(
    "gradient_magnitude",
    f"WITH {TELEMETRY}, g AS (SELECT event_id, {', '.join(f'{_GRAD.format(c=c)} AS jerk_{c}' for c in AXES)} FROM tele WINDOW w AS (PARTITION BY clip_id ORDER BY cts)) "
    "SELECT event_id, round(jerk_ax, 6) AS jerk_ax, round(jerk_ay, 6) AS jerk_ay, round(jerk_az, 6) AS jerk_az, round(sqrt(jerk_ax*jerk_ax + jerk_ay*jerk_ay + jerk_az*jerk_az), 6) AS total_jerk FROM g",
)
def _(spark, sf_dir):
    g = timeseries.gradient(telemetry(spark, sf_dir), AXES, 0.5).withColumn("total_jerk", timeseries.magnitude("jerk_ax", "jerk_ay", "jerk_az"))
    return _rounded(g.select("event_id", "jerk_ax", "jerk_ay", "jerk_az", "total_jerk"))


@register("global_z", f"WITH {TELEMETRY}, s AS (SELECT clip_id AS c, avg(ax) AS m, stddev_samp(ax) AS d FROM tele GROUP BY 1) SELECT event_id, round(CASE WHEN d > 0 THEN (ax - m) / d ELSE 0 END, 6) AS z FROM tele JOIN s ON clip_id = c")
def _(spark, sf_dir):
    return _rounded(timeseries.global_z(telemetry(spark, sf_dir), "ax").select("event_id", "z"))


@register("rolling_z_prefix", f"WITH {TELEMETRY} SELECT event_id, round({_z('ax', 21)}, 6) AS z FROM tele")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return _rounded(timeseries.rolling_z_by_clip(t, "ax", t.select("clip_id").distinct().withColumn("width", F.lit(21))).select("event_id", "z"))


@register("rolling_z_least", f"WITH {TELEMETRY} SELECT event_id, round(CASE WHEN count(ax) OVER w >= 50 THEN (ax - avg(ax) OVER w) / (stddev_samp(ax) OVER w + 1e-9) END, 6) AS z FROM tele WINDOW w AS (PARTITION BY clip_id ORDER BY cts ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)")
def _(spark, sf_dir):
    return _rounded(timeseries.rolling_z(telemetry(spark, sf_dir).select("event_id", "clip_id", "cts", "ax"), {"z": ("ax", 61)}, least=50, epsilon=1e-9).select("event_id", "z"))




def _strategy_base() -> str:
    zs = ", ".join(f"{_z(c)} AS z_{c}" for c in AXES)
    return (
        f"WITH {TELEMETRY}, st AS (SELECT clip_id AS c, avg(ax) AS m, stddev_samp(ax) AS d, median(CASE WHEN speed_kmh > -1 AND speed_kmh <= 20 THEN 1.6 "
        f"WHEN speed_kmh <= 60 THEN 2.0 ELSE 2.6 END) AS ek FROM tele GROUP BY 1), base AS (SELECT tele.*, (ax - m) / d AS z, ek, sqrt(ax*ax + ay*ay + az*az) AS total FROM tele JOIN st ON clip_id = c), "
        f"zs AS (SELECT *, {zs}, {_z('total')} AS z_total FROM base), "
        f"flags AS (SELECT *, {' + '.join(f'CASE WHEN abs(z_{c}) > 2.0 THEN 1 ELSE 0 END' for c in AXES)} AS v, {' + '.join(f'CASE WHEN abs(z_{c}) > ek THEN 1 ELSE 0 END' for c in AXES)} AS sv FROM zs), "
    )


def _strategy_sql(flag: str, merged: bool = False) -> str:
    sql = _strategy_base() + _runs("runs", "flags", flag) + ", ev AS (SELECT clip_id, CAST(event_no AS INTEGER) AS event_no, min(cts) AS start_time, max(cts) AS end_time FROM runs GROUP BY 1, 2) "
    if merged:
        sql = sql.rstrip() + (
            ", mg AS (SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY clip_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ev), "
            "mo AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY clip_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS INTEGER) AS no FROM mg), "
            "ev2 AS (SELECT clip_id, no AS event_no, min(start_time) AS start_time, max(end_time) AS end_time FROM mo GROUP BY 1, 2) "
        )
        return sql + _ROUND_EVENT + " FROM ev2"
    return sql + _ROUND_EVENT + " FROM ev"


def _strategy(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = timeseries.global_z(telemetry(spark, sf_dir), "ax").withColumn("total", timeseries.magnitude(*AXES))
        return _rounded(detect.STRATEGIES[name](t, gap=GAP, width=WIDTH, columns=AXES, k=K))

    return run


for _name, _flag, _merged in (
    ("fixed_global", "abs(z) > 2.0", False), ("adaptive_single", "abs(z_total) > 2.0", False), ("adaptive_any", "v >= 1", False),
    ("adaptive_fusion", "v >= 2", False), ("adaptive_fusion_merged", "v >= 2", True), ("adaptive_fusion_speed", "sv >= 2", True),
):
    register(f"threshold_{_name}", _strategy_sql(_flag, _merged))(_strategy(_name))


@register(
    "asof_nearest",
    f"WITH {TELEMETRY}, r AS (SELECT cts AS t, max(ROW(ax, ay)) AS v FROM tele WHERE clip_id = 'view' GROUP BY cts), l AS (SELECT event_id, cts FROM tele WHERE clip_id = 'click'), "
    "b AS (SELECT l.event_id, l.cts, r.t AS bt, r.v AS bv FROM l ASOF LEFT JOIN r ON l.cts >= r.t), a AS (SELECT l.event_id, r.t AS at_, r.v AS av FROM l ASOF LEFT JOIN r ON l.cts <= r.t), "
    "m AS (SELECT event_id, CASE WHEN cts - bt <= 600 AND (at_ IS NULL OR cts - bt <= at_ - cts) THEN bv WHEN at_ - cts <= 600 THEN av END AS v FROM b JOIN a USING (event_id)) "
    "SELECT event_id, v[1] AS value, v[2] AS k FROM m",
)
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    right = t.where("clip_id = 'view'").select("cts", F.col("ax").alias("value"), F.col("ay").alias("k"))
    left = t.where("clip_id = 'click'").select("event_id", "cts")
    return timeseries.asof_nearest(left, right, ["value", "k"], 600.0, clip=None).select("event_id", "value", "k")


@register("fill_both", f"WITH {TELEMETRY}, g AS (SELECT *, CASE WHEN ay > 50 THEN ax END AS x FROM tele) SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY cts ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY cts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM g")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("x", F.when(F.col("ay") > 50, F.col("ax")))
    return timeseries.fill_both(t, ["x"]).select("event_id", "x")


@register("snr", f"WITH {TELEMETRY}, g AS (SELECT *, avg(ax) OVER (PARTITION BY clip_id ORDER BY cts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f FROM tele) SELECT clip_id, round(10 * log10(var_pop(ax) / var_pop(f)), 6) AS snr_db FROM g GROUP BY 1")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("f", F.avg("ax").over(timeseries.in_time().rowsBetween(-2, 2)))
    return _rounded(timeseries.snr_db(t, "ax", "f"))


@register("video_time", f"WITH {TELEMETRY}, s AS (SELECT event_id, cts - min(cts) OVER (PARTITION BY clip_id) AS s FROM tele) SELECT event_id, printf('%02d:%04.1f', CAST(floor(s / 60) AS INTEGER), s - 60 * floor(s / 60)) AS video_ts FROM s")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    first = t.groupBy(F.col("clip_id").alias("c")).agg(F.min("cts").alias("m"))
    return t.join(first, F.col("clip_id").eqNullSafe(F.col("c"))).select("event_id", timeseries.video_time(F.col("cts") - F.col("m")).alias("video_ts"))


@register(
    "quality_profile",
    "WITH s AS (SELECT l_returnflag AS clip_id, unnest([{'c': 'l_quantity', 'v': CAST(l_quantity AS DOUBLE)}, {'c': 'l_discount', 'v': CAST(l_discount AS DOUBLE)}]) AS u FROM lineitem) "
    "SELECT clip_id, u.c AS \"column\", count(*) FILTER (u.v IS NULL) AS n_null, count(*) FILTER (isinf(u.v)) AS n_inf, count(*) FILTER (u.v < 0) AS n_negative, min(u.v) AS least, max(u.v) AS most, stddev_pop(u.v) < 1e-6 AS flat FROM s GROUP BY 1, 2",
)
def _(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_returnflag", "clip_id")
    return timeseries.quality_profile(line, ["l_quantity", "l_discount"])


_CAND_FRAMES = f"WITH {TELEMETRY}, {FRAMES}, {_candidate_sql()}, ef AS (SELECT cand.clip_id, event_no, frame_id, frame_time, severity, absence_confidence, retrieval_score, zone_type FROM cand JOIN frames f ON f.clip_id = cand.clip_id AND frame_time BETWEEN start_time - 1800 AND end_time + 1800) "


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_join(candidates(spark, sf_dir), frames(spark, sf_dir), "frame_time", 7200.0, ["clip_id"], 1800.0, 1800.0)


@register("event_frames", _CAND_FRAMES + "SELECT clip_id, event_no, frame_id FROM ef")
def _(spark, sf_dir):
    return event_frames(spark, sf_dir).select("clip_id", "event_no", "frame_id")


@register("event_window_stats", _CAND_FRAMES + "SELECT clip_id, event_no, count(*) AS n, max(severity) AS most, round(avg(absence_confidence), 6) AS mean_absence FROM ef GROUP BY 1, 2")
def _(spark, sf_dir):
    return _rounded(event_frames(spark, sf_dir).groupBy("clip_id", "event_no").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("most"), F.avg("absence_confidence").alias("mean_absence")))


@register(
    "raw_slice",
    f"WITH {TELEMETRY}, {_candidate_sql()}, j AS (SELECT cand.clip_id, cand.event_no, t.event_id, t.cts FROM cand JOIN tele t ON t.clip_id = cand.clip_id AND t.cts BETWEEN start_time - 36000 AND end_time + 36000), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY clip_id, event_no ORDER BY cts) - 1 AS i, count(*) OVER (PARTITION BY clip_id, event_no) AS n FROM j) "
    "SELECT clip_id, event_no, event_id FROM n WHERE n <= 5 OR list_contains([CAST(floor(q * (n - 1) / 4.0 + 1e-9) AS BIGINT) FOR q IN [0, 1, 2, 3, 4]], i)",
)
def _(spark, sf_dir):
    samples = telemetry(spark, sf_dir).select("clip_id", "event_id", "cts")
    met = intervals.interval_join(candidates(spark, sf_dir).select("clip_id", "event_no", "start_time", "end_time"), samples, "cts", 72000.0, ["clip_id"], 36000.0, 36000.0)
    return intervals.down_sampled(met, ["clip_id", "event_no"], "cts", 5).select("clip_id", "event_no", "event_id")




def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return o.select(F.col("o_orderpriority").alias("clip_id"), "o_orderkey", day.alias("start_time"), (day + F.col("o_orderkey") % 3).alias("end_time"))


_SPANS = "WITH s AS (SELECT o_orderpriority AS clip_id, o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS start_time, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 3 AS DOUBLE) AS end_time FROM orders), "


def _grouped_sql(gap: float) -> str:
    return (
        _SPANS + f"g AS (SELECT *, CASE WHEN start_time - max(end_time) OVER (PARTITION BY clip_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM s), "
        "h AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY clip_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS INTEGER) AS event_no FROM g) "
    )


@register("interval_merge", _grouped_sql(0) + "SELECT clip_id, event_no, min(start_time) AS start_time, max(end_time) AS end_time FROM h GROUP BY 1, 2")
def _(spark, sf_dir):
    return intervals.merge_intervals(_order_spans(spark, sf_dir))


@register("gap_groups", _grouped_sql(1.0) + "SELECT clip_id, event_no AS group_no, count(*) AS n FROM h GROUP BY 1, 2")
def _(spark, sf_dir):
    return intervals.grouped_by_gap(_order_spans(spark, sf_dir), 1.0).groupBy("clip_id", "group_no").agg(F.count(F.lit(1)).alias("n"))


@register(
    "clip_bounds",
    _SPANS + "m AS (SELECT *, (start_time + end_time) / 2 AS mid FROM s) SELECT o_orderkey, CASE WHEN end_time - start_time < 1 THEN greatest(0, mid - 0.5) ELSE start_time END AS a_start, CASE WHEN end_time - start_time < 1 THEN mid + 0.5 ELSE end_time END AS a_end, "
    "start_time AS b_start, CASE WHEN end_time <= start_time THEN start_time + 2 ELSE end_time END AS b_end, CASE WHEN end_time - start_time < 0.05 THEN greatest(0, start_time - 0.5) ELSE start_time END AS c_start, greatest(0, start_time - 1.5) AS p_start, end_time + 1.5 AS p_end FROM m",
)
def _(spark, sf_dir):
    s, e = F.col("start_time"), F.col("end_time")
    b = {v: intervals.clip_bounds(s, e, v) for v in ("a", "b", "c", "padded")}
    return _order_spans(spark, sf_dir).select("o_orderkey", b["a"]["start"].alias("a_start"), b["a"]["end"].alias("a_end"), b["b"]["start"].alias("b_start"), b["b"]["end"].alias("b_end"), b["c"]["start"].alias("c_start"), b["padded"]["start"].alias("p_start"), b["padded"]["end"].alias("p_end"))


_REVIEWED = ", rev AS (SELECT *, CASE WHEN event_no % 3 = 0 THEN ' Reject' ELSE 'confirm ' END AS decision, CASE WHEN event_no % 4 = 0 THEN CAST(start_time + 30 AS VARCHAR) ELSE ' ' END AS adjusted_start FROM cand) "


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.withColumns({"decision": F.when(F.col("event_no") % 3 == 0, " Reject").otherwise("confirm "), "adjusted_start": F.when(F.col("event_no") % 4 == 0, (F.col("start_time") + 30).cast("string")).otherwise(" ")})


@register("gold_from_review", f"WITH {TELEMETRY}, {_candidate_sql()}{_REVIEWED} SELECT clip_id, round(CASE WHEN event_no % 4 = 0 THEN start_time + 30 ELSE start_time END, 6) AS start_time, round(end_time, 6) AS end_time FROM rev WHERE lower(trim(decision)) = 'confirm'")
def _(spark, sf_dir):
    return _rounded(review.gold_events(reviewed(spark, sf_dir)))


@register(
    "offset_calibration",
    f"WITH {TELEMETRY}, {_candidate_sql()}{_REVIEWED}, o AS (SELECT CASE WHEN event_no % 4 = 0 THEN start_time + 30 ELSE start_time END - start_time AS d FROM rev WHERE lower(trim(decision)) = 'confirm'), m AS (SELECT median(d) AS m FROM o) "
    "SELECT count(*) AS n, round(avg(abs(d)), 6) AS mean_abs, round(100 * avg(CASE WHEN abs(d) > 1 THEN 1.0 ELSE 0 END), 6) AS pct_over_1, round(100 * avg(CASE WHEN abs(d) > 0.5 THEN 1.0 ELSE 0 END), 6) AS pct_over_half, round(any_value(m), 6) AS median_offset, round(avg(abs(d - m)), 6) AS mean_abs_after FROM o, m",
)
def _(spark, sf_dir):
    return _rounded(review.offset_calibration(reviewed(spark, sf_dir)))


def _ev(name: str, k: float) -> str:
    return _candidate_sql(k, name, f"{name}_runs")


_PAIRS = f"WITH {TELEMETRY}, {_ev('p', 2.0)}, {_ev('g', 2.4)}, "
_SCORE = (
    "x AS (SELECT c.clip_id, (SELECT count(*) FROM p WHERE p.clip_id = c.clip_id) AS np, (SELECT count(*) FROM g WHERE g.clip_id = c.clip_id) AS ng, (SELECT count(*) FROM pr WHERE pr.clip_id = c.clip_id) AS tp FROM (SELECT DISTINCT clip_id FROM g) c), "
    "t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(ng - tp) AS BIGINT) AS fn FROM x), q AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM t) "
    "SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(fp / nullif(tp + fp, 0), 6) AS fp_rate FROM q"
)


def pred_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return candidates(spark, sf_dir, 2.0), candidates(spark, sf_dir, 2.4)


@register(
    "score_tiou",
    _PAIRS + "pr AS (SELECT p.clip_id FROM p JOIN g ON p.clip_id = g.clip_id WHERE (least(p.end_time, g.end_time) - greatest(p.start_time, g.start_time)) / nullif(greatest(p.end_time, g.end_time) - least(p.start_time, g.start_time), 0) >= 0.5), " + _SCORE,
)
def _(spark, sf_dir):
    p, g = pred_gold(spark, sf_dir)
    return _rounded(review.scored(p, g, "tiou", 0.5))


@register(
    "score_tolerance",
    _PAIRS + "pr AS (SELECT p.clip_id FROM p JOIN g ON p.clip_id = g.clip_id WHERE abs((p.start_time + p.end_time) / 2 - (g.start_time + g.end_time) / 2) <= 60), " + _SCORE,
)
def _(spark, sf_dir):
    p, g = pred_gold(spark, sf_dir)
    return _rounded(review.scored(p, g, "tolerance", 60.0))


_ICDI = _CAND_FRAMES + (
    ", e AS (SELECT clip_id || '_evt' || CAST(event_no AS VARCHAR) AS event_id, *, CASE zone_type WHEN 'School' THEN 1.5 WHEN 'Pedestrian Crossing' THEN 1.4 WHEN 'Residential' THEN 1.2 ELSE 1.0 END AS zr FROM ef), "
    "zc AS (SELECT event_id, zone_type, count(*) AS n, min(frame_id) AS f FROM e GROUP BY 1, 2), zt AS (SELECT event_id, zone_type, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f) AS r FROM zc), "
    "ic AS (SELECT event_id, any_value(zt.zone_type) AS zone_type, count(*) AS num_rows, avg(absence_confidence) AS mean_absence_confidence, avg(absence_confidence * severity * zr * retrieval_score) AS icdi, min(frame_time) AS start_time, max(frame_time) AS end_time FROM e JOIN zt USING (event_id) WHERE r = 1 GROUP BY 1) "
)


def icdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_frames(spark, sf_dir).withColumn("event_id", F.concat("clip_id", F.lit("_evt"), F.col("event_no").cast("string"))).drop("start_time", "end_time")
    return risk.icdi(rows, time="frame_time", order="frame_id")


@register("icdi", _ICDI + "SELECT event_id, zone_type, num_rows, round(mean_absence_confidence, 12) AS mean_absence_confidence, round(icdi, 12) AS icdi FROM ic")
def _(spark, sf_dir):
    return _rounded(icdi(spark, sf_dir).select("event_id", "zone_type", "num_rows", "mean_absence_confidence", "icdi"), 12)


@register("idas", _ICDI + "SELECT count(*) AS n, round(avg(icdi * CASE WHEN mean_absence_confidence >= 0.66 THEN 1.0 WHEN mean_absence_confidence >= 0.33 THEN 0.5 ELSE 0.1 END), 8) AS idas FROM ic")
def _(spark, sf_dir):
    return _rounded(risk.idas(icdi(spark, sf_dir), None), 8)


@register(
    "crrs",
    _ICDI + ", cg AS (SELECT *, split_part(event_id, '_evt', 1) AS c, CASE WHEN start_time - max(end_time) OVER (PARTITION BY split_part(event_id, '_evt', 1) ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 7200 THEN 0 ELSE 1 END AS fresh FROM ic), "
    "ch AS (SELECT *, sum(fresh) OVER (PARTITION BY c ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS gno FROM cg), ck AS (SELECT *, count(*) OVER (PARTITION BY c, gno) AS w FROM ch) SELECT count(*) AS n, round(sum(icdi * w) / count(*), 6) AS crrs FROM ck",
)
def _(spark, sf_dir):
    rows = icdi(spark, sf_dir).withColumn("clip_id", F.split("event_id", "_evt")[0])
    return _rounded(risk.crrs(rows, 7200.0, ["clip_id"])[1])


@register(
    "grid_search_top",
    "WITH " + TELEMETRY + ", "
    + ", ".join(f"z{w} AS (SELECT {w} AS width, clip_id, cts, {_z('ax', w)} AS z_ax, {_z('ay', w)} AS z_ay, {_z('az', w)} AS z_az FROM tele)" for w in (10, 20, 40))
    + ", zz AS (SELECT * FROM z10 UNION ALL SELECT * FROM z20 UNION ALL SELECT * FROM z40), ks AS (SELECT unnest([1.8, 2.0, 2.2, 2.6]) AS k), cs AS (SELECT unnest([1, 2]) AS channels), "
    "fl AS (SELECT width, k, channels, clip_id, cts FROM zz, ks, cs WHERE CASE WHEN abs(z_ax) > k THEN 1 ELSE 0 END + CASE WHEN abs(z_ay) > k THEN 1 ELSE 0 END + CASE WHEN abs(z_az) > k THEN 1 ELSE 0 END >= channels), "
    + _runs("fr", "fl", "true", GAP, "width, k, channels, clip_id")
    + ", p AS (SELECT width, k, channels, clip_id, min(cts) AS start_time, max(cts) AS end_time FROM fr GROUP BY width, k, channels, clip_id, event_no), " + _ev("g", 2.4)
    + ", pr AS (SELECT width, k, channels, count(*) AS tp FROM p JOIN g ON p.clip_id = g.clip_id WHERE abs((p.start_time + p.end_time) / 2 - (g.start_time + g.end_time) / 2) <= 60 GROUP BY 1, 2, 3), "
    "pc AS (SELECT width, k, channels, count(*) AS np FROM p WHERE clip_id IN (SELECT clip_id FROM g) GROUP BY 1, 2, 3), "
    "s AS (SELECT width, k, channels, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, (SELECT count(*) FROM g) - coalesce(tp, 0) AS fn FROM pc LEFT JOIN pr USING (width, k, channels)), "
    "f AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM s) SELECT width, CAST(k AS DOUBLE) AS k, channels, tp, fp, fn, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, width, k, channels LIMIT 10",
)
def _(spark, sf_dir):
    gold = candidates(spark, sf_dir, 2.4)
    got = review.grid_search(telemetry(spark, sf_dir), gold, AXES, (10, 20, 40), (1.8, 2.0, 2.2, 2.6), (1, 2), GAP, "tolerance", 60.0)
    best = got.where("f1 is not null").orderBy(F.desc("f1"), "width", "k", "channels").limit(10)
    return _rounded(best.select("width", "k", "channels", "tp", "fp", "fn", "f1"))


#: (name, strategy, flag in SQL, merged, options): the settings of the threshold ablation, then the sweep of k.
STRATEGIES = [
    ("fixed_global", "fixed_global", "abs(z) > 2.0", False, {}), ("adaptive_single", "adaptive_single", "abs(z_total) > 2.0", False, {}), ("adaptive_any", "adaptive_any", "v >= 1", False, {}),
    ("adaptive_fusion", "adaptive_fusion", "v >= 2", False, {}), ("adaptive_fusion_merged", "adaptive_fusion_merged", "v >= 2", True, {}), ("adaptive_fusion_speed", "adaptive_fusion_speed", "sv >= 2", True, {}),
]
SWEEP = [(f"k={k}", "adaptive_fusion_merged", " + ".join(f"CASE WHEN abs(z_{c}) > {k} THEN 1 ELSE 0 END" for c in AXES) + " >= 2", True, {"k": k}) for k in (1.5, 2.0, 2.5, 3.0, 3.5)]


def _events_sql(name: str, flag: str, merged: bool) -> str:
    """CTEs that end in ``name``: clip_id, start_time, end_time of the runs of a flag, merged where they overlap."""
    sql = _runs(f"{name}_r", "flags", flag) + f", {name}_e AS (SELECT clip_id, min(cts) AS start_time, max(cts) AS end_time FROM {name}_r GROUP BY clip_id, event_no)"
    if not merged:
        return sql + f", {name} AS (SELECT * FROM {name}_e)"
    return sql + (
        f", {name}_m AS (SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY clip_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh2 FROM {name}_e), "
        f"{name}_o AS (SELECT *, sum(fresh2) OVER (PARTITION BY clip_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS no FROM {name}_m), {name} AS (SELECT clip_id, min(start_time) AS start_time, max(end_time) AS end_time FROM {name}_o GROUP BY clip_id, no)"
    )


def _table_sql(base: str, settings: list[tuple[str, str, bool]], gold: str = "g", tolerance: float = 60.0, more: str = "", columns: str = "") -> str:
    """The score table of several event CTEs (name, flag, merged) against ``gold``."""
    parts = ", ".join(_events_sql(f"s{i}", flag, merged) for i, (_, flag, merged) in enumerate(settings))
    union = " UNION ALL ".join(f"SELECT '{name}' AS config, clip_id, start_time, end_time FROM s{i}" for i, (name, _, _) in enumerate(settings))
    return base + parts + ", " + _ev(gold, 2.4) + f", every AS ({union}), " + _score_table(gold, tolerance) + more + f" SELECT config, n_pred, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round((n_pred - tp) / n_pred, 6) AS fp_rate, round(CASE WHEN tt = 0 THEN 0 ELSE 2.0 * tt / (n_pred + ng) END, 6) AS f1_tolerance{columns} FROM sc"


def _score_table(gold: str, tolerance: float) -> str:
    return (
        f"pn AS (SELECT config, count(*) AS n_pred FROM every WHERE clip_id IN (SELECT clip_id FROM {gold}) GROUP BY 1), "
        f"pt AS (SELECT config, count(*) AS tp FROM every p JOIN {gold} g ON p.clip_id = g.clip_id WHERE (least(p.end_time, g.end_time) - greatest(p.start_time, g.start_time)) / nullif(greatest(p.end_time, g.end_time) - least(p.start_time, g.start_time), 0) >= 0.5 GROUP BY 1), "
        f"pm AS (SELECT config, count(*) AS tt FROM every p JOIN {gold} g ON p.clip_id = g.clip_id WHERE abs((p.start_time + p.end_time) / 2 - (g.start_time + g.end_time) / 2) <= {tolerance} GROUP BY 1), "
        f"sc AS (SELECT config, n_pred, coalesce(tp, 0) AS tp, coalesce(tt, 0) AS tt, (SELECT count(*) FROM {gold}) AS ng, coalesce(tp, 0) / n_pred AS p, coalesce(tp, 0) / (SELECT count(*) FROM {gold}) AS r FROM pn LEFT JOIN pt USING (config) LEFT JOIN pm USING (config))"
    )


def _strategies(settings):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = timeseries.global_z(telemetry(spark, sf_dir).drop("event_id", "user_id"), "ax").withColumn("total", timeseries.magnitude(*AXES))
        common = {"gap": GAP, "width": WIDTH, "columns": AXES, "k": K}
        settings_ = [(name, strategy, common | options) for name, strategy, _, _, options in settings]
        gold = {"gap": GAP, "width": WIDTH, "column": "ax", "k": 2.4}  # the candidates of that k, from the same scores
        t = detect.scored_once(t, [*((strategy, options) for _, strategy, options in settings_), ("adaptive_single", gold)])
        return _rounded(review.strategy_table(t, detect.adaptive_single(t, **gold), settings_, tolerance=60.0))

    return run


register("threshold_ablation", _table_sql(_strategy_base(), [(name, flag, merged) for name, _, flag, merged, _ in STRATEGIES]))(_strategies(STRATEGIES))
register("threshold_k_sweep", _table_sql(_strategy_base(), [(name, flag, merged) for name, _, flag, merged, _ in SWEEP]))(_strategies(SWEEP))
