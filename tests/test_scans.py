import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadweave.operators import detect, intervals, scans, timeseries


@pytest.fixture(autouse=True, params=["ranges", "whole keys"])
def dealing(request, monkeypatch):
    """Keys of any length over several ranges, and keys that are short enough for a task."""
    monkeypatch.setattr(scans, "RANGE", 400)
    if request.param == "ranges":
        monkeypatch.setattr(scans, "SHORT", 0)
    return request.param


@pytest.fixture()
def clips():
    """One long clip, short ones, a null clip, repeated times and nulls."""
    rng = np.random.default_rng(7)
    sizes = {"long": 3000, "a": 1, "b": 2, "c": 40, None: 25}
    rows = []
    for clip, n in sizes.items():
        times = np.cumsum(rng.choice([0.5, 1.0, 3.0], n))
        rows += [(clip, float(t), None if rng.random() < 0.3 else float(rng.normal()), i) for i, t in enumerate(times)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "clip_id string, cts double, v double, n long").repartition(6)


def by_clip(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_rows_are_numbered_over_ranges(spark, clips):
    df = frame(spark, clips)
    dealt = scans.ranged(df, ["clip_id"], ["cts"], short=False)
    assert dealt.where("clip_id = 'long'").select("_range").distinct().count() >= 3  # one clip is several tasks
    got = {(r.clip_id, r.n): (r._i, r._n) for r in scans.numbered(df, ["clip_id"], ["cts"]).collect()}
    assert got == {(c, r[3]): (i, len(own)) for c, own in by_clip(clips).items() for i, r in enumerate(own)}


@pytest.mark.parametrize(("size", "below", "above"), [(7, 0, 0), (7, 3, 2), (5, 12, 11), (10_000, 4, 4)])
def test_blocks_hold_their_neighbours(spark, clips, size, below, above):
    rows = scans.haloed(scans.numbered(frame(spark, clips), ["clip_id"], ["cts"]), size, below, above).collect()
    assert sum(r._own for r in rows) == len(clips)
    blocks = {}
    for r in rows:
        blocks.setdefault((r.clip_id, r._block), []).append(r)
    for own in blocks.values():
        places, mine = sorted(r._i for r in own), [r._i for r in own if r._own]
        lo, hi = max(0, min(mine) - below), min(own[0]._n - 1, max(mine) + above)
        assert places == list(range(lo, hi + 1)) or set(range(lo, hi + 1)) <= set(places)


def test_scans_equal_the_plain_ones(spark, clips):
    df = frame(spark, clips)
    plain = {}
    for clip, own in by_clip(clips).items():
        v = pd.Series([r[2] for r in own], dtype=float)
        filled = v.ffill().bfill()
        t = np.array([r[1] for r in own])
        grad = [None if len(own) == 1 else (v[1] - v[0]) / 2 if i == 0 else (v[i] - v[i - 1]) / 2 if i == len(own) - 1 else (v[i + 1] - v[i - 1]) / 4 for i in range(len(own))]
        plain[clip] = own, filled, t, grad
    filled = {(r.clip_id, r.n): r.v for r in timeseries.fill_both(df, ["v"]).collect()}
    assert filled == {(c, r[3]): (None if np.isnan(x) else x) for c, (own, f, _, _) in plain.items() for r, x in zip(own, f)}
    whole = frame(spark, [(c, t, float(n % 13), n) for c, t, _, n in clips])
    got = {(r.clip_id, r.n): r.jerk_v for r in timeseries.gradient(whole, ["v"], 2.0).collect()}
    for c, own in by_clip(clips).items():
        x = [float(r[3] % 13) for r in own]
        want = [None] if len(x) == 1 else [(x[min(i + 1, len(x) - 1)] - x[max(i - 1, 0)]) / (4.0 if 0 < i < len(x) - 1 else 2.0) for i in range(len(x))]
        assert [got[c, r[3]] for r in own] == want
    rates = {r.clip_id: r.fs for r in timeseries.sample_rate(df).collect()}
    assert rates == {c: (None if len(t) < 2 else pytest.approx(1 / np.median(np.diff(t)))) for c, (_, _, t, _) in plain.items()}
    events = {(r.clip_id, r.event_no): (r.start_time, r.end_time) for r in detect.flags_to_events(df, F.col("v") > 0, 1.5).collect()}
    want = {}
    for c, own in by_clip(clips).items():
        no, last = 0, None
        for _, t, v, _ in own:
            if v is not None and v > 0:
                no += last is None or t - last > 1.5
                want[c, no] = (want.get((c, no), (t, t))[0], t)
                last = t
    assert events == want


def test_groups_by_gap_over_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(c, float(s), float(s + rng.integers(0, 30) * (rng.random() < 0.3)), i) for i, (c, s) in enumerate((c, s) for c, n in (("long", 2000), ("a", 3), (None, 50)) for s in rng.integers(0, 9000, n))]
    df = spark.createDataFrame(rows, "clip_id string, start_time double, end_time double, n long").repartition(5)
    for keys, name in ((["clip_id"], lambda r: r[0]), ([], lambda r: 0)):
        got = {r.n: r.group_no for r in intervals.grouped_by_gap(df, 1.0, keys).collect()}
        reach, no = {}, {}
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            k = name(r)
            no[k] = no.get(k, 0) + (k not in reach or r[1] - reach[k] > 1.0)
            reach[k] = max(reach.get(k, -1.0), r[2])
            assert got[r[3]] == no[k]


def test_streams_are_aligned_over_ranges(spark):
    left = spark.createDataFrame([("x", i * 0.5) for i in range(2000)] + [("y", 1.0)], "clip_id string, cts double").repartition(3)
    right = spark.createDataFrame([("x", i * 0.5 + (0.2 if i == 1500 else 0.0)) for i in range(1990)], "clip_id string, cts double").repartition(4)
    got = timeseries.aligned(left, right).where("misaligned").collect()
    assert sorted((r.clip_id, r.cts) for r in got) == sorted([("x", 750.0), *[("x", i * 0.5) for i in range(1990, 2000)], ("y", 1.0)])


@pytest.mark.parametrize("width", [1, 2, 5, 20, 64, 2000])
def test_rolling_scores_equal_the_plain_window(spark, clips, width, monkeypatch):
    monkeypatch.setattr(timeseries, "BLOCK", 50)
    monkeypatch.setattr(timeseries, "PLAIN", 5)
    df = frame(spark, clips)
    plain = {(r.clip_id, r.n): r.z for r in df.withColumn("z", timeseries.rolling_z_column("v", width, 2, 1e-9)).collect()}
    got = {(r.clip_id, r.n): r.z for r in timeseries.rolling_z(df, {"z": ("v", width), "other": ("v", 3)}, least=2, epsilon=1e-9).collect()}
    assert plain.keys() == got.keys() and all((plain[k] is None) == (got[k] is None) and (got[k] is None or abs(got[k] - plain[k]) < 1e-9) for k in got)


def test_a_quiet_stretch_after_a_violent_one(spark):
    """Scores of a quiet end keep their digits, however violent the clip was before."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1000, 100_000), rng.normal(0, 1e-3, 200)])
    df = spark.createDataFrame(pd.DataFrame({"clip_id": "x", "cts": np.arange(len(x)) * 0.005, "v": x}))
    end = {r.cts: r.z for r in timeseries.rolling_z(df, {"z": ("v", 20)}).where("cts > 500.25").collect()}
    for i in range(len(x) - 140, len(x)):
        own = x[max(0, i - 10) : i + 10]
        assert end[i * 0.005] == pytest.approx((x[i] - own.mean()) / own.std(ddof=1), abs=1e-6)
    by_clip = timeseries.rolling_z_by_clip(df, "v", spark.createDataFrame([("x", 20)], "clip_id string, width int")).where("cts > 500.25").collect()
    assert {r.cts: r.z for r in by_clip} == pytest.approx(end, abs=1e-9)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(10)
    rows = [("hot", 0.005) for _ in range(4000)] + [("hot", 0.006), ("none", None)] + [(c, float(x)) for c in "ab" for x in rng.normal(size=501 + (c == "b"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.q for r in scans.quantiles(df, ["k"], "v", share).collect()}
        assert got == {k: pytest.approx(np.quantile([v for kk, v in rows if kk == k], share)) for k in ("hot", "a", "b")}
    assert scans.quantiles(df, [], "v").collect()[0].q == pytest.approx(0.005)


def test_thinning_in_rounds(spark):
    rng = np.random.default_rng(11)
    rows = [(c, float(m), int(p), i) for i, (c, m, p) in enumerate((c, rng.uniform(0, 40), rng.integers(0, 3)) for c in ["a"] * 300 + ["b"] * 5 + [None] * 20)] + [("a", None, 0, 999)]
    df = spark.createDataFrame(rows, "k string, mid double, p int, n long").repartition(4)
    for most in (1, 4, 30):
        kept = {}
        for k, m, p, n in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2], r[1])):
            own = kept.setdefault(k, [])
            if len(own) < most and all(abs(m - x) > 2.0 for x, _ in own):
                own.append((m, n))
        got = intervals.thinned(df, "mid", "k", [F.col("p"), F.col("mid")], 2.0, most).collect()
        assert sorted(r.n for r in got) == sorted(n for own in kept.values() for _, n in own)
    assert intervals.thinned(df.limit(0), "mid", "k", [F.col("mid")]).count() == 0


def test_matching_in_one_tangled_block(spark):
    """Predictions take, in time order, their best free gold event; ties to the earlier one."""
    rng = np.random.default_rng(12)
    spans = lambda n: [("c", float(s), float(s + d)) for s, d in zip(rng.uniform(0, 60, n).round(1), rng.uniform(1, 8, n).round(1))]
    pred, gold = spans(120), spans(110)
    make = lambda rows: spark.createDataFrame(rows, "clip_id string, start_time double, end_time double")
    got = sorted((r.pred_start, r.gold_start) for r in intervals.matched(make(pred), make(gold), "tiou", 0.2).collect())
    score = lambda p, g: max(0.0, min(p[2], g[2]) - max(p[1], g[1])) / (max(p[2], g[2]) - min(p[1], g[1]))
    free, want = sorted(set(gold)), []
    for p in sorted(set(pred)):
        best = max(((score(p, g), -i) for i, g in enumerate(free) if score(p, g) >= 0.2), default=None)
        if best:
            want.append((p[1], free.pop(-best[1])[1]))
    assert got == sorted(want) and len(want) > 40


def test_a_block_of_many_pairs_is_quick(spark):
    import time

    n = 1000
    make = lambda off: spark.createDataFrame([("c", i * 1e-4 + off, 1000.0 + i * 1e-4 + off) for i in range(n)], "clip_id string, start_time double, end_time double")
    began = time.time()
    assert intervals.matched(make(0.0), make(1e-5), "tiou", 0.5).count() == n  # a million pairs in one block
    assert time.time() - began < 90


def test_a_late_clock_does_not_change_sample_numbers(spark):
    """The right stream is numbered by its own order, though one of its clocks passes the next sample's; lone rows keep their clip."""
    left = spark.createDataFrame([("c", 1.0), ("c", 1.0005), ("c", 2.0)], "clip_id string, cts double")
    right = spark.createDataFrame([("c", 1.001, 1.0, 1), ("c", 1.0005, 1.0005, 2), ("c", 2.0, 2.0, 3), ("d", 5.0, 5.0, 4)], "clip_id string, cts double, sampled double, v int")
    got = timeseries.aligned(left, right, relative=1e-10, order=["sampled"]).collect()
    assert sorted((r.clip_id, r.v, r.misaligned) for r in got) == [("c", 1, True), ("c", 2, False), ("c", 3, False), ("d", 4, True)]


def test_video_time_rounds_exact_values(spark):
    """As C's printf: ties of the exact value to the even tenth, 0.15 and 7.65 by what they really are."""
    rng = np.random.default_rng(5)
    values = [0.0, 0.05, 0.04999999, 0.15, 0.25, 0.35, 0.75, 3.45, 7.65, 12.25, 59.95, 59.949999, 60.25, 6000.75, 1e-9, *rng.integers(0, 400_000, 400) / 1000, *rng.uniform(0, 4e6, 200)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "s double")
    want = ["%02d:%04.1f" % (v // 60, v - 60 * (v // 60)) for v in values] + [None]
    assert [r[0] for r in df.select(timeseries.video_time(F.col("s"))).collect()] == want


def test_asof_reads_each_side_once(spark):
    """No window frame of the join begins at the row and ends with its cell: such a frame is read again for every row."""
    rows = spark.createDataFrame([("c", float(t), float(t % 7)) for t in range(60)], "clip_id string, cts double, v double")
    met = timeseries.asof_nearest(rows.where("cts % 3 = 0").select("clip_id", "cts"), rows.where("cts % 4 = 1"), ["v"], 1.0)
    assert "unboundedfollowing" not in met._jdf.queryExecution().toString().lower()
    right = [t for t in range(60) if t % 4 == 1]
    for r in met.collect():
        near = min(right, key=lambda t: (abs(t - r.cts), t))
        assert r.v == (near % 7 if abs(near - r.cts) <= 1 else None)


def rides(spark):
    rng = np.random.default_rng(11)
    rows = [(clip, float(t), *(float(x) for x in rng.standard_normal(5)), float(rng.integers(0, 90))) for clip, n in {"long": 1500, "b": 300}.items() for t in np.arange(n) * 0.5]
    return spark.createDataFrame(rows, "clip_id string, cts double, z double, total double, ax double, ay double, az double, speed_kmh double").repartition(6)


def strategy_scores(spark, monkeypatch, settings):
    """The table of some strategies, the tables of each strategy alone, and how many passes of windows the first made."""
    from roadweave.operators import review

    df, passes = rides(spark), []
    gold = detect.fixed_global(df, 1.0, 2.0).select("clip_id", "start_time", "end_time")
    rolled = detect.rolling_z
    monkeypatch.setattr(detect, "rolling_z", lambda *a, **k: passes.append(1) or rolled(*a, **k))
    got = {r.config: r for r in review.strategy_table(df, gold, settings, tolerance=2.0).collect()}
    made = len(passes)
    alone = {}
    for name, strategy, options in settings:
        events = detect.STRATEGIES[strategy](df, **options).select("clip_id", "start_time", "end_time", F.lit(name).alias("config"))
        alone |= {r.config: r for r in review.score_table(events, gold, ["config"], 0.5, 2.0).collect()}
    return got, alone, made


def test_strategies_share_one_pass_of_windows(spark, monkeypatch):
    common = {"gap": 1.0, "width": 20, "columns": ["ax", "ay", "az"], "k": 1.6}
    names = ("fixed_global", "adaptive_single", "adaptive_fusion_speed")
    got, alone, made = strategy_scores(spark, monkeypatch, [(n, n, common) for n in names])
    assert got == alone and len(got) == 3 and made == 1


def test_a_sweep_of_k_makes_its_windows_once(spark):
    """Every k has the windows of the same columns, so nothing but them is asked for, whatever the number of settings."""
    common = {"gap": 1.0, "width": 20, "columns": ["ax", "ay", "az"]}
    once = detect.scored_once(rides(spark), [("adaptive_fusion_merged", common | {"k": k}) for k in (1.5, 2.0, 2.5)])
    assert [c for c in once.columns if c.startswith("_z_")] == ["_z_ax_20", "_z_ay_20", "_z_az_20"]
    assert detect._with_rolling(once, ["ax", "ay", "az"], 20, True) is once


def test_only_what_runs_need_is_stored(spark, monkeypatch):
    kept = []
    stored = detect.stored
    monkeypatch.setattr(detect, "stored", lambda df, name: kept.append((name, df.columns)) or stored(df, name))
    detect.flags_to_events(rides(spark), F.abs("z") > 2.0, 1.0, short=False).count()
    assert ("flagged", ["clip_id", "cts"]) in kept


def test_runs_of_a_grid_are_cut_in_chunks(spark, monkeypatch):
    """Runs of all configurations equal windows over all flagged samples, also over chunks' borders and without times."""
    from roadweave.operators import filters, review

    monkeypatch.setattr(filters, "BLOCK_ROWS", 40)
    rng = random.Random(8)
    rows = [(clip, i * 1.0 + (7 if i % 50 > 44 else 0), rng.gauss(0, 1), rng.gauss(0, 1)) for clip, n in (("a", 500), ("b", 90), ("c", 1)) for i in range(n)] + [("a", None, 50.0, 50.0), ("a", None, -60.0, 9.0)]
    df = spark.createDataFrame(rows, "clip_id string, cts double, ax double, ay double")
    ks, channels, gap = [0.5, 1.1], [1, 2], 4.0
    made = filters.bank_runs(df, ["ax", "ay"], 1.0, [(None, None, 0)], [3, 4], ks, channels, gap)
    plan = made._jdf.queryExecution().toString()
    want = review.runs_of_grid(filters.bank_scores(df, ["ax", "ay"], 1.0, [(None, None, 0)], [3, 4], min(ks)), 2, ks, channels, gap, ["setting", "width"])
    fields = ["setting", "width", "k", "channels", "clip_id", "start_time", "end_time"]
    got = sorted(map(tuple, made.select(*fields).collect()), key=str)
    assert got == sorted(map(tuple, want.select(*fields).collect()), key=str)
    assert max(r[6] - r[5] for r in got if r[5] is not None) > 40 and len({r[:4] for r in got}) == 8
    assert "FlatMapGroupsInArrow" not in plan  # samples were read once, then runs alone are
    assert review.grid_events(df, ["ax", "ay"], [3, 4], ks, channels, gap).count() == len(got)


def test_a_sweep_stores_what_its_strategies_read(spark, monkeypatch):
    """Samples keep the columns that are scored or read, scores those that are read; scores that are there are not made again."""
    common = {"gap": 1.0, "width": 20, "columns": ["ax", "ay", "az"]}
    kept, stored = {}, detect.stored
    monkeypatch.setattr(detect, "stored", lambda df, name: kept.setdefault(name, set(df.columns)) and stored(df, name))
    rows = rides(spark).withColumn("unread", F.lit("u"))
    once = detect.scored_once(rows, [("adaptive_fusion_merged", common | {"k": 1.6}), ("adaptive_single", common | {"column": "ax"})])
    assert kept["samples"] == {"clip_id", "cts", "ax", "ay", "az"} and kept["strategy-scores"] == {"clip_id", "cts", "_z_ax_20", "_z_ay_20", "_z_az_20"}
    assert detect.scored_once(once, [("adaptive_any", common | {"columns": ["ax"]})]) is once
    read = detect.scored_once(rows, [("fixed_global", common), ("adaptive_fusion_speed", common)])
    assert set(read.columns) == {"clip_id", "cts", "z", "speed_kmh", "_z_ax_20", "_z_ay_20", "_z_az_20"}
    assert "unread" in detect.scored_once(rows, [("own", common)]).columns  # a strategy that is not known may read every column


def test_a_sweep_and_its_gold_share_one_pass_of_windows(spark, monkeypatch):
    from roadweave.plans import telemetry

    passes, rolled = [], detect.rolling_z
    monkeypatch.setattr(detect, "rolling_z", lambda *a, **k: passes.append(1) or rolled(*a, **k))
    telemetry.QUERIES["threshold_k_sweep"](spark, "/root/testdata/sf0.001").collect()
    assert len(passes) == 1


def test_ranges_are_not_dealt_again_for_what_is_handed_on(spark):
    dealt = scans.ranged(spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t")), ["k"], ["t"], short=False)
    met = scans.carried(dealt, ["k"], _n=(F.count(F.lit(1)), "all"))
    assert {(r.k, r._n) for r in met.collect()} == {(0, 334), (1, 333), (2, 333)}
    assert "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
