"""Queries of the readers, writers and streams: a table is written in a reader's format and read back by it.

The files are written by Spark to the shared folder, so their size follows the given tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.scoring import score_with_model
from roadweave.functions.storage import session_dir, stored
from roadweave.operators import citations, graph, risk
from roadweave.plans.base import registrar
from roadweave.plans.places import tables_graph
from roadweave.plans.telemetry import _candidate_sql, _rounded, candidates, reviewed
from roadweave.sources import readers
from roadweave.sources.adapters import TELEMETRY, table, telemetry
from roadweave.streaming import detection, stateful

QUERIES, SQL, register = registrar()


def folder(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def raw_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).withColumnsRenamed({"ax": "ax_raw", "ay": "ay_raw", "az": "az_raw"})


_RAW = "round(cts, 6) AS cts, ax AS ax_raw, ay AS ay_raw, round(az, 6) AS az_raw FROM tele"


@register("read_telemetry", f"WITH {TELEMETRY} SELECT {_RAW}")
def _(spark, sf_dir):
    path = folder(spark, "telemetry")
    raw_axes(spark, sf_dir).select("cts", "ax_raw", "ay_raw", "az_raw").toDF("cts", " ax_raw", "ay_raw ", "az_raw").write.option("header", True).option("sep", "\t").csv(path)
    return _rounded(readers.read_telemetry(spark, path))


@register("read_clips", f"WITH {TELEMETRY} SELECT clip_id, {_RAW}")
def _(spark, sf_dir):
    path = folder(spark, "clips")
    readers.write_named(raw_axes(spark, sf_dir).select("clip_id", "cts", "ax_raw", "ay_raw", "az_raw"), path, "clip_id")
    return _rounded(readers.read_clips(spark, path).select("clip_id", "cts", "ax_raw", "ay_raw", "az_raw"))


@register("read_sensor_streams", f"WITH {TELEMETRY} SELECT 'accel' AS kind, round(cts, 3) AS cts, ax AS v FROM tele UNION ALL SELECT 'gps', round(cts, 3), round(ay * 3.6, 6) FROM tele")
def _(spark, sf_dir):
    t = raw_axes(spark, sf_dir).withColumn("cts", F.col("cts") * 1000)
    accel, gps = folder(spark, "accel"), folder(spark, "gps")
    t.select("cts", "ax_raw", "ay_raw", "az_raw").toDF("cts", *readers.SENSOR_NAMES["accel"]).write.option("header", True).csv(accel)
    t.select("cts", F.lit(17.5), F.lit(78.2), "ay_raw").toDF("cts", *readers.SENSOR_NAMES["gps"]).write.option("header", True).csv(gps)
    a = readers.read_sensor_stream(spark, accel, "accel").select(F.lit("accel").alias("kind"), F.round("cts", 3).alias("cts"), F.col("ax_raw").alias("v"))
    return a.unionByName(readers.read_sensor_stream(spark, gps, "gps").select(F.lit("gps").alias("kind"), F.round("cts", 3).alias("cts"), F.round("speed_kmh", 6).alias("v")))


@register("detect_milliseconds", f"WITH {TELEMETRY} SELECT event_id, round(cts, 3) AS cts FROM tele")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir).select("event_id", (F.col("cts") * 1000).alias("cts"))
    return readers.seconds(t).select("event_id", F.round("cts", 3).alias("cts"))


@register("read_gold", f"WITH {TELEMETRY}, {_candidate_sql()} SELECT clip_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM cand")
def _(spark, sf_dir):
    path = folder(spark, "gold")
    candidates(spark, sf_dir).select("clip_id", "start_time", "end_time").write.option("header", True).csv(path)
    return _rounded(readers.read_gold(spark, path))


@register("read_reviewed", f"WITH {TELEMETRY}, {_candidate_sql()} SELECT clip_id, CAST(event_no AS VARCHAR) AS event_no, CASE WHEN event_no % 3 = 0 THEN 'reject' ELSE 'confirm' END AS decision FROM cand")
def _(spark, sf_dir):
    path = folder(spark, "reviewed")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    reviewed(spark, sf_dir).select("clip_id", "event_no", "decision").write.options(header=True, **kept).csv(path)
    return readers.read_reviewed(spark, path).select("clip_id", "event_no", "decision")


#: Rows of a JSON document: documents get more, not longer, as tables grow.
DOCUMENT = 4000


def documents_of(df: DataFrame, number: F.Column, value: F.Column, path: str) -> None:
    """One JSON document a file for each ``DOCUMENT`` numbers."""
    made = df.groupBy(F.floor(number / DOCUMENT).alias("part")).agg(value.alias("value"))
    made.repartition("part").write.partitionBy("part").text(path)


@register("read_predictions", "SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS presence, o_orderpriority AS gold FROM orders")
def _(spark, sf_dir):
    path = folder(spark, "predictions")
    parsed = F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.struct(F.col("o_orderstatus").alias("presence")).alias("road_surface")))
    row = F.struct(F.col("o_orderkey").alias("event_id"), parsed.alias("parsed"), F.struct(F.col("o_orderpriority").alias("presence")).alias("gold"))
    documents_of(table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_json(F.collect_list(row)), path)
    got = readers.read_json_documents(spark, f"{path}/part=*", "event_id long, parsed struct<road_surface: struct<presence: string>>, gold struct<presence: string>")
    return got.select("event_id", F.col("parsed.road_surface.presence").alias("presence"), F.col("gold.presence").alias("gold"))


@register("read_jsonl_last", "SELECT o_orderkey AS event_id, o_orderpriority AS said FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 <> 0")
def _(spark, sf_dir):
    path = folder(spark, "results")
    o = table(spark, sf_dir, "orders")
    first = o.select(F.col("o_orderkey").alias("event_id"), F.lit(1).alias("v"), F.col("o_orderstatus").alias("said"))
    lines = first.unionByName(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"), F.lit(2).alias("v"), F.col("o_orderpriority").alias("said")))
    lines.repartition("event_id").sortWithinPartitions("event_id", "v").select(F.to_json(F.struct("event_id", "said"))).write.text(path)
    return readers.read_jsonl_last(spark, path, "event_id long, said string")


@register("read_text_any", "SELECT c_name || ' é' AS value FROM customer UNION ALL SELECT c_mktsegment || ' ñ' || c_custkey FROM customer")
def _(spark, sf_dir):
    path = folder(spark, "texts")
    c = table(spark, sf_dir, "customer")
    c.select(F.concat("c_name", F.lit(" é"))).write.csv(f"{path}/a", encoding="ISO-8859-1")
    c.select(F.concat("c_mktsegment", F.lit(" ñ"), F.col("c_custkey").cast("string"))).write.csv(f"{path}/b", encoding="UTF-8")
    return readers.read_text_any(spark, f"{path}/*/*.csv").select("value")


@register("knowledge_base", "SELECT 'IRC35_' || p_partkey AS clause_id, CASE WHEN (p_partkey // 4000) % 2 = 0 THEN p_name ELSE p_type END AS text FROM part")
def _(spark, sf_dir):
    path = folder(spark, "clauses")
    p = table(spark, sf_dir, "part").withColumn("id", F.concat(F.lit("IRC35_"), F.col("p_partkey").cast("string")))
    even = F.floor(F.col("p_partkey") / DOCUMENT) % 2 == 0
    documents_of(p.where(even), F.col("p_partkey"), F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.col("p_name").alias("text"))))), f"{path}/a")
    documents_of(p.where(~even), F.col("p_partkey"), F.to_json(F.collect_list(F.struct("id", F.col("p_type").alias("text")))), f"{path}/b")
    return readers.knowledge_base(spark, f"{path}/*/part=*")


@register("clause_texts", "SELECT 'IRC' || (p_partkey % 60) || '_' || p_partkey AS clause_key, p_name AS text FROM part")
def _(spark, sf_dir):
    path = folder(spark, "clause-lines")
    p = table(spark, sf_dir, "part")
    p.select(F.concat(F.lit("IRC"), (F.col("p_partkey") % 60).cast("string")).alias("doc"), F.col("p_partkey").cast("string").alias("clause"), F.col("p_name").alias("text")).write.json(path)
    return readers.read_clause_texts(spark, path)


@register("clause_table", "SELECT 'IRC_' || (p_partkey % 500) AS clause_id, max(p_name) AS text FROM part GROUP BY 1")
def _(spark, sf_dir):
    sign = F.when(F.col("p_partkey") % 3 == 0, "IRC-").otherwise("IRC_")
    return citations.clause_table(table(spark, sf_dir, "part").select(F.concat(sign, (F.col("p_partkey") % 500).cast("string")).alias("clause_id"), F.col("p_name").alias("text")))


@register("result_files", "SELECT 'm' || left(o_orderpriority, 1) AS model, o_orderstatus || '_tele' AS config, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    path = folder(spark, "result-files")
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("results_m"), F.substring("o_orderpriority", 1, 1), F.lit("_"), "o_orderstatus", F.lit("_tele"))
    readers.write_named(o.select(name.alias("name"), "o_orderkey", "o_totalprice"), path, "name")
    return readers.result_files(spark, path).groupBy("model", "config").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("ids"))


@register("report_with_total", "SELECT event, n, hits FROM (SELECT CAST(o_custkey AS VARCHAR) AS event, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits FROM orders GROUP BY 1 UNION ALL SELECT 'CHR_TOTAL', count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders)")
def _(spark, sf_dir):
    path = folder(spark, "report")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event"), (F.col("o_orderstatus") == "F").cast("long").alias("hit"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")]
    risk.with_total(o.groupBy("event").agg(*sums), o.agg(*sums), "CHR_TOTAL", "event").write.option("header", True).csv(path)
    return spark.read.schema("event string, n long, hits long").csv(path, header=True)


@register("append_new", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf_dir):
    path = folder(spark, "appended")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    readers.append_new(o.where("o_orderstatus <> 'O'"), path, "o_orderkey", False)
    readers.append_new(o.unionByName(o), path, "o_orderkey", True)
    return spark.read.parquet(path)


_LINES = "SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges UNION ALL SELECT 'frame', 8 UNION ALL SELECT 'link', count(*) FROM edges"


def _graph_sql() -> str:
    from roadweave.plans.places import _EDGES, _NODES

    return f"WITH {_NODES}, {_EDGES} {_LINES}"


@register("graph_export", _graph_sql())
def _(spark, sf_dir):
    """The whole graph as GraphML lines and as node-link JSON, both compressed, read back and counted; nodes are put together once for both."""
    nodes, edges = tables_graph(spark, sf_dir)
    nodes, path = stored(nodes, "graph-nodes"), folder(spark, "graph")
    graph.write_graphml(nodes, edges, f"{path}/ml", **readers.PACKED)
    readers.write_nodes_json(nodes, edges, path, **readers.PACKED)
    v = F.col("value")
    kind = F.when(F.startswith(v, F.lit("<node ")), "node").when(F.startswith(v, F.lit("<edge ")), "edge").otherwise("frame")
    lines = spark.read.text(f"{path}/ml").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return lines.unionByName(spark.read.schema("src string, dst string").json(f"{path}/links").agg(F.count(F.lit(1)).alias("n")).select(F.lit("link").alias("kind"), "n"))


@register("markdown_rows", "SELECT '| ' || c_custkey || ' | ' || CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE c_name END || ' | ' || c_mktsegment || ' |' AS value FROM customer")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    return readers.markdown_rows(c)


def arriving(spark: SparkSession, sf_dir: str, closed: bool = False) -> DataFrame:
    """The events as a stream of files; ``closed``: with one row more, of value 0, a day after the last."""
    path = folder(spark, "arriving")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("clip_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    if closed:
        last = events.agg(F.lit(None).alias("event_id"), F.lit("").alias("clip_id"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(0.0).alias("value"))
        events = events.unionByName(last)
    events.write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


_SHORT = "tele AS (SELECT event_id, event_type AS clip_id, ts, value FROM events)"


def run_with_state(stream: DataFrame, name: str, schema: str) -> DataFrame:
    """What a stream with state writes until all is read; the session's state store is as before afterwards."""
    spark = stream.sparkSession
    before, out = spark.conf.get(stateful.ROCKSDB[0]), folder(spark, name)
    spark.conf.set(*stateful.ROCKSDB)
    try:
        detection.run_to_table(stream, out, folder(spark, f"{name}-log")).awaitTermination()
    finally:
        spark.conf.set(stateful.ROCKSDB[0], before)
    return spark.read.schema(schema).parquet(out)


@register(
    "stream_candidates",
    f"WITH {_SHORT}, r AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY clip_id ORDER BY ts)) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM tele WHERE value > 60), g AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM r) "
    "SELECT clip_id, CAST(no AS BIGINT) AS event_no, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_samples FROM g GROUP BY clip_id, no",
)
def _(spark, sf_dir):
    """Numbered runs of the event stream, each written once when the watermark has passed it; a quiet sample a day after all others closes the last."""
    runs = stateful.candidate_runs(arriving(spark, sf_dir, closed=True), F.col("value") > 60, 7200.0)
    got = run_with_state(runs, "runs", "clip_id string, event_no long, start_time timestamp, end_time timestamp, n_samples long")
    return got.select("clip_id", "event_no", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "n_samples")


def met_frames(spark: SparkSession, sf_dir: str, end: F.Column, name: str) -> DataFrame:
    """event, frame_id of each frame from an event's time to its ``end``; what the stream writes are blocks, their pairs are made where they are read.

    Each clip and cell of time is one call of a worker: cells of three days keep both their number and their rows low.
    """
    came = arriving(spark, sf_dir)
    events = came.where("value > 60").select(F.col("event_id").alias("event"), "clip_id", F.col("ts").alias("start_time"), end.alias("end_time"))
    frames = came.select(F.col("event_id").alias("frame_id"), "clip_id", F.col("ts").alias("frame_time"))
    ids = [F.col(c).cast("array<bigint>").alias(c) for c in ("events", "frames")]
    blocks = run_with_state(stateful.event_blocks(events, frames, "event", "frame_id", cell=3 * 86_400.0).select(*ids, "lows", "counts"), name, "events array<bigint>, frames array<bigint>, lows array<int>, counts array<int>")
    # Blocks are small beside their pairs: dealt evenly, as sizes of files don't tell the work.
    dealt = blocks.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stateful.block_pairs(dealt).withColumnRenamed("frame", "frame_id")


@register(
    "stream_open_events",
    f"WITH {_SHORT}, e AS (SELECT event_id AS event, clip_id, ts AS s, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS t FROM tele WHERE value > 60) SELECT event, event_id AS frame_id FROM e JOIN tele f ON e.clip_id = f.clip_id AND f.ts >= s AND f.ts <= t",
)
def _(spark, sf_dir):
    """Events as many minutes long as their value says, met by frames; no longest length is given."""
    return met_frames(spark, sf_dir, F.timestamp_micros(F.unix_micros("ts") + F.floor("value").cast("long") * 60_000_000), "open")


@register(
    "stream_event_frames",
    f"WITH {_SHORT}, e AS (SELECT event_id AS event, clip_id, ts AS s, ts + INTERVAL 45 MINUTE AS t FROM tele WHERE value > 60) SELECT event, event_id AS frame_id FROM e JOIN tele f ON e.clip_id = f.clip_id AND f.ts >= s AND f.ts <= t",
)
def _(spark, sf_dir):
    """Events of 45 minutes, met by frames."""
    return met_frames(spark, sf_dir, F.col("ts") + F.expr("interval 45 minutes"), "met")


@register("score_with_model", "SELECT event_id, round(value * 2 + user_id, 6) AS score, value > 50 AS high FROM events")
def _(spark, sf_dir):
    """Batch scoring with a model that the caller brings: here a line and a limit."""

    def make():
        return lambda frame: {"score": (frame["value"] * 2 + frame["user_id"]).round(6), "high": frame["value"] > 50}

    e = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    return score_with_model(e, make, "score double, high boolean", ["value", "user_id"]).select("event_id", "score", "high")
