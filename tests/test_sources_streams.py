import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadweave.functions.scoring import score_with_model
from roadweave.sources import readers
from roadweave.streaming import detection


def test_clips_and_errors(spark, tmp_path):
    (tmp_path / "A1.csv").write_text("cts , ax_raw,ay_raw,az_raw\n0.1,1,2,3\n0.2,x,2,3\n")
    (tmp_path / "B2.csv").write_text("cts , ax_raw,ay_raw,az_raw\n0.3,1,2,3\n")
    got = readers.read_clips(spark, str(tmp_path)).orderBy("cts").collect()
    assert [(r.clip_id, r.ax_raw) for r in got] == [("A1", 1.0), ("A1", None), ("B2", 1.0)]
    (tmp_path / "bad.tsv").write_text("cts\tother\n1\t2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_telemetry(spark, str(tmp_path / "bad.tsv"))


def test_sensor_stream_and_units(spark, tmp_path):
    p = tmp_path / "gps.csv"
    p.write_text("cts,date,GPS (Lat.) [deg],GPS (Long.) [deg],GPS (2D speed) [m/s]\n38.697,d,17.5,78.2,10\n709741.4359,d,17.6,78.3,0\n")
    got = readers.read_sensor_stream(spark, str(p), "gps", "c").orderBy("cts").collect()
    assert [round(r.cts, 3) for r in got] == [0.039, 709.741] and got[0].speed_kmh == 36.0
    ms = spark.createDataFrame([(5.0,), (20000.0,)], "cts double")
    assert [r.cts for r in readers.seconds(ms).orderBy("cts").collect()] == [0.005, 20.0]


def test_text_fallback_kb_and_jsonl(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_bytes("é\n".encode())
    (tmp_path / "t" / "b.csv").write_bytes("é\n".encode("cp1252"))
    assert [r.value for r in readers.read_text_any(spark, str(tmp_path / "t")).collect()] == ["é", "é"]
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a_kb.json").write_text('{"x": "one", "y": {"text": "two"}}')
    (tmp_path / "kb" / "b_kb.json").write_text('[{"id": "x", "clause_text": "later"}, {"clause_id": "z", "text": "three"}]')
    assert {r.clause_id: r.text for r in readers.knowledge_base(spark, str(tmp_path / "kb")).collect()} == {"x": "later", "y": "two", "z": "three"}
    (tmp_path / "r.jsonl").write_text('{"event_id": "a", "v": 1}\n{"event_id": "b", "v": 2}\n{"event_id": "a", "v": 3}\n')
    assert {r.event_id: r.v for r in readers.read_jsonl_last(spark, str(tmp_path / "r.jsonl"), "event_id string, v int").collect()} == {"a": 3, "b": 2}


def test_append_and_markdown(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, None)], "event_id int, v string")
    readers.append_new(df, path, "event_id", False)
    readers.append_new(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, "event_id", True)
    assert spark.read.parquet(path).count() == 3
    assert readers.markdown_rows(df).orderBy("value").collect()[1].value == "| 2 | NA |"


def test_scoring_with_a_given_model(spark):
    got = score_with_model(spark.range(5), lambda: lambda f: f.assign(label=f["id"] * 2), "label long").collect()
    assert sorted((r.id, r.label) for r in got) == [(i, 2 * i) for i in range(5)]


def test_stream_is_the_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("c", t0 + dt.timedelta(seconds=s), v) for s, v in [(0, 5.0), (1, 5.0), (2.5, 5.0), (2.2, 0.0), (400, 5.0), (900, 5.0)]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "clip_id string, ts timestamp, v double")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    detection.run_to_table(detection.candidate_sessions(stream, F.col("v") > 1), out, str(tmp_path / "cp")).awaitTermination()
    got = [((r.start_time - t0).total_seconds(), (r.end_time - t0).total_seconds(), r.n_samples) for r in spark.read.parquet(out).orderBy("start_time").collect()]
    batch = [((r.start_time - t0).total_seconds(), (r.end_time - t0).total_seconds(), r.n_samples) for r in detection.candidate_sessions(df, F.col("v") > 1).orderBy("start_time").collect()]
    assert batch == [(0.0, 1.0, 2), (2.5, 2.5, 1), (400.0, 400.0, 1), (900.0, 900.0, 1)]
    assert got == batch[:-1]  # the last run may still grow
    frames = spark.createDataFrame([("c", t0 + dt.timedelta(seconds=s)) for s in (0.5, 2.5, 50)], "clip_id string, frame_time timestamp")
    events = spark.createDataFrame([("c", t0, t0 + dt.timedelta(seconds=40))], "clip_id string, start_time timestamp, end_time timestamp")
    assert detection.event_frame_stream(events, frames).count() == 2
