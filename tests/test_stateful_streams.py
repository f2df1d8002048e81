import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import detect
from roadweave.streaming import detection, stateful

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture()
def rocks(spark):
    settings = dict([stateful.ROCKSDB, ("spark.sql.shuffle.partitions", "3")])
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


class Feed:
    """A folder of files, each one micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def run(stream, tmp_path, name="out"):
    """One run to the end of what is there; gives the progress of its batches."""
    q = detection.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-log"))
    q.awaitTermination()
    return q.recentProgress


def state_rows(progress):
    return [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]


def test_runs_over_micro_batches(rocks, tmp_path):
    feed = Feed(rocks, tmp_path / "in", "clip_id string, ts timestamp, v double")
    rng = random.Random(2)
    rows = [(c, round(rng.uniform(0, 120), 3), rng.choice([0.0, 5.0])) for c in ("a", "b") for _ in range(150)]
    rows += [("a", 130.0, 5.0), ("a", 131.0, 5.0), ("a", 132.001, 5.0)]  # a gap of exactly 1 joins
    rows.sort(key=lambda r: r[1])
    runs = lambda: stateful.candidate_runs(feed.stream(), F.col("v") > 1, 1.0, "10 seconds")
    seen = []
    for lo, hi in ((0, 40), (40, 80), (80, 200)):
        part = [(c, at(s), v) for c, s, v in rows if lo <= s < hi]
        rng.shuffle(part)
        feed.add(part)
        seen += run(runs(), tmp_path)
    feed.add([("a", at(20), 5.0), (None, at(500), 5.0), ("b", None, 5.0), ("b", at(1000), 0.0)])  # the first is late: dropped
    seen += run(runs(), tmp_path)
    feed.add([("b", at(2000), 0.0)])
    seen += run(runs(), tmp_path)
    got = sorted((r.clip_id, r.event_no, round((r.start_time - T0).total_seconds(), 6), round((r.end_time - T0).total_seconds(), 6), r.n_samples) for r in rocks.read.parquet(str(tmp_path / "out")).collect())
    batch = detect.flags_to_events(rocks.createDataFrame(rows, "clip_id string, cts double, v double"), F.col("v") > 1, 1.0, [F.count(F.lit(1)).alias("n")])
    assert got == sorted((r.clip_id, r.event_no, r.start_time, r.end_time, r.n) for r in batch.collect())
    assert any(r[2:] == (130.0, 131.0, 2) for r in got) and len({p["batchId"] for p in seen}) >= 5
    # One value a clip, and its timers; nothing grows with the samples.
    assert max(state_rows(seen)) <= 40 and sum(p["numInputRows"] for p in seen) > 300


def test_events_of_any_length_meet_frames(rocks, tmp_path):
    events = Feed(rocks, tmp_path / "events", "event_id long, clip_id string, start_time timestamp, end_time timestamp")
    frames = Feed(rocks, tmp_path / "frames", "frame_id long, clip_id string, frame_time timestamp")
    rng = random.Random(5)
    e = [(i, rng.choice("ab"), s, s + rng.choice([0.0, 3.0, 30.0])) for i, s in enumerate(rng.sample(range(300), 40))]
    e += [(100, "a", 5, 100000.0), (101, "a", 7, 6.0)]  # one without end in sight, one that ends before it starts
    f = [(i, rng.choice("ab"), rng.randrange(600) / 2) for i in range(300)] + [(1000, "a", 5), (1001, "b", 299)]
    met = lambda: stateful.event_frames(events.stream(), frames.stream(), late="10 seconds")
    seen = []
    for lo, hi in ((0, 100), (100, 200), (200, 400)):
        events.add([(i, c, at(s), at(t)) for i, c, s, t in e if lo <= s < hi] + [(900, None, at(lo), at(hi))])
        frames.add([(i, c, at(s)) for i, c, s in f if lo <= s < hi])
        seen += run(met(), tmp_path)
    events.add([(200, "a", at(50), at(60)), (201, "b", at(50000), at(50001))])  # 200 is late
    frames.add([(2000, "a", at(20)), (2001, "a", at(50000)), (2002, "b", at(50001.5))])  # 2000 is late
    seen += run(met(), tmp_path)
    f.append((2001, "a", 50000))
    got = sorted((int(r.event), int(r.frame)) for r in rocks.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((i, k) for i, c, s, t in e for k, d, u in f if c == d and s <= u <= t)
    assert (100, 2001) in got and max(state_rows(seen)) <= 40


def test_events_over_cells_meet_each_frame_once(rocks, tmp_path):
    events = Feed(rocks, tmp_path / "events", "event_id long, clip_id string, start_time timestamp, end_time timestamp")
    frames = Feed(rocks, tmp_path / "frames", "frame_id long, clip_id string, frame_time timestamp")
    e = [(1, "a", 5, 95), (2, "a", 49.5, 50), (3, "a", 100, 150), (4, "b", 0, 10)]
    f = [(i, "a", i / 2) for i in range(400)]
    events.add([(i, c, at(s), at(t)) for i, c, s, t in e])
    frames.add([(i, c, at(s)) for i, c, s in f])
    run(stateful.event_frames(events.stream(), frames.stream(), cell=50.0), tmp_path)
    got = sorted((int(r.event), int(r.frame)) for r in rocks.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((i, k) for i, c, s, t in e for k, d, u in f if c == d and s <= u <= t)


def test_parts_of_a_batch_are_met_at_once():
    """What is held is sorted and searched twice a batch, however many parts its rows come in."""
    import numpy as np
    import pandas as pd

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

        def clear(self):
            self.kept = None

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            pass

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    met, calls = stateful._Met(), []
    met.init(Handle())
    plain = met._pairs
    met._pairs = lambda key, e, f: calls.append(len(f)) or plain(key, e, f)
    parts = [pd.DataFrame({"is_event": [True, False], "id": [f"e{i}", f"f{i}"], "us": np.array([i * 10 + 1] * 2), "until": np.array([i * 10 + 15, 0])}) for i in range(50)]
    got = pd.concat(met.handleInputRows(("a",), iter(parts), Clock()))
    assert len(calls) == 2 and sorted(zip(got["event"], got["frame"])) == sorted((f"e{i}", f"f{k}") for i in range(50) for k in (i, i + 1) if k < 50)


def test_blocks_give_all_pairs_over_micro_batches(rocks, tmp_path):
    events = Feed(rocks, tmp_path / "events", "event_id long, clip_id string, start_time timestamp, end_time timestamp")
    frames = Feed(rocks, tmp_path / "frames", "frame_id long, clip_id string, frame_time timestamp")
    rng = random.Random(7)
    e = [(i, rng.choice("ab"), s, s + rng.choice([0.0, 3.0, 30.0, 120.0])) for i, s in enumerate(rng.sample(range(300), 60))] + [(100, "a", 5, 100000.0), (101, "a", 7, 6.0)]
    f = [(i, rng.choice("ab"), rng.randrange(600) / 2) for i in range(300)] + [(1000, "a", 5), (1001, "b", 299), (None, "a", 5)]
    blocks = lambda: stateful.event_blocks(events.stream(), frames.stream(), late="10 seconds", cell=50.0)
    seen = []
    for lo, hi in ((0, 100), (100, 200), (200, 400)):
        events.add([(i, c, at(s), at(t)) for i, c, s, t in e if lo <= s < hi] + [(900, None, at(lo), at(hi))])
        frames.add([(i, c, at(s)) for i, c, s in f if lo <= s < hi])
        seen += run(blocks(), tmp_path)
    events.add([(200, "a", at(50), at(60)), (201, "b", at(50000), at(50001))])  # 200 is late
    frames.add([(2000, "a", at(20)), (2001, "a", at(50000)), (2002, "b", at(50001.5))])  # 2000 is late
    seen += run(blocks(), tmp_path)
    f.append((2001, "a", 50000))
    got = [(int(r.event), r.frame and int(r.frame)) for r in stateful.block_pairs(rocks.read.parquet(str(tmp_path / "out"))).collect()]
    least = lambda pairs: sorted(pairs, key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    assert least(got) == least((i, k) for i, c, s, t in e for k, d, u in f if c == d and s <= u <= t)
    assert (100, 2001) in got and any(k is None for _, k in got) and seen[-1]["stateOperators"][0]["numRowsTotal"] < 2100  # the event without end stands in its cells


def test_built_in_join_of_streams(spark, tmp_path):
    events = Feed(spark, tmp_path / "events", "event_id long, clip_id string, start_time timestamp, end_time timestamp")
    frames = Feed(spark, tmp_path / "frames", "frame_id long, clip_id string, frame_time timestamp")
    e = [(i, "ab"[i % 2], i * 7, i * 7 + 45) for i in range(40)]
    f = [(i, "ab"[i % 3 % 2], i) for i in range(300)]
    for lo, hi in ((0, 150), (150, 300)):
        events.add([(i, c, at(s), at(t)) for i, c, s, t in e if lo <= s < hi])
        frames.add([(i, c, at(u)) for i, c, u in f if lo <= u < hi])
        run(detection.event_frame_stream(events.stream(), frames.stream(), longest="45 seconds").select("event_id", "frame_id"), tmp_path)
    got = sorted((r.event_id, r.frame_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((i, k) for i, c, s, t in e for k, d, u in f if c == d and s <= u <= t)


def test_blocks_are_cut(monkeypatch):
    """Frames and events of a row are bounded, and all pairs are in the rows, each once."""
    import numpy as np

    monkeypatch.setattr(stateful, "BLOCK", 7)
    monkeypatch.setattr(stateful, "PAIRS", 40)
    monkeypatch.setattr(stateful, "ROWS", 3)
    rng = random.Random(3)
    e = [(f"e{i}", s, s + rng.choice([0, 5, 60, 400])) for i, s in enumerate(rng.choices(range(300), k=90))]
    f = [(f"f{i}", rng.randrange(300)) for i in range(100)]
    arrays = lambda rows: [np.array([r[k] for r in rows], object if k == 0 else np.int64) for k in range(len(rows[0]))]
    got = []
    for part in stateful._MetBlocks()._pairs(("a", 0), arrays(e), arrays(f)):
        assert len(part) <= 3
        for row in part.itertuples():
            assert len(row.events) <= 7 and len(row.frames) == len(row.times) <= 7
            got += [(i, row.frames[k]) for i, low, n in zip(row.events, row.lows, row.counts) for k in range(low, low + n)]
    assert sorted(got) == sorted((i, k) for i, s, t in e for k, u in f if s <= u <= t)


@pytest.mark.parametrize("name, minutes", [("stream_open_events", 70), ("stream_event_frames", 45)])
def test_streams_store_rows_not_pairs(spark, tmp_path, name, minutes):
    """Where all lies in one hour, pairs are the square of the rows: what the stream writes is not."""
    import __spark_entry__

    times = [at(i * 3) for i in range(1200)]
    rows = [(i, t, i % 7, "click", 70.5 if i % 2 else 1.0, "{}") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = sum(1 for i in range(1, 1200, 2) for k in range(i, 1200) if (k - i) * 3 <= minutes * 60)
    assert want > 200_000 and found.count() == want and found.distinct().count() == want
    assert found.where("frame_id < event or (frame_id - event) * 3 > %d" % (minutes * 60)).count() == 0
    stored = spark.read.parquet(*found.inputFiles())
    assert stored.selectExpr("sum(size(events) + size(frames)) AS n").collect()[0].n <= 2400
