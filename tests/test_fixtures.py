"""Hand-made cases with values worked out from the rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadweave.operators import answers, citations, classify, detect, filters, graph, intervals, labels, retrieval, review, rider, risk, spatial, textsim, timeseries


def samples(spark, rows, cols="cts double, v double"):
    return spark.createDataFrame(rows, cols).withColumn("clip_id", F.lit("c"))


def spans(spark, rows, clip="c"):
    return spark.createDataFrame([(clip, float(s), float(e)) for s, e in rows], "clip_id string, start_time double, end_time double")


def test_sessions_use_a_strict_gap(spark):
    got = detect.flags_to_events(samples(spark, [(0.0, 9.0), (1.0, 9.0), (2.5, 9.0), (2.0, 0.0)]), F.col("v") > 1, 1.0).orderBy("event_no").collect()
    assert [(r.start_time, r.end_time) for r in got] == [(0.0, 1.0), (2.5, 2.5)]


@pytest.mark.parametrize("width", [3, 4, 5, 20])
def test_rolling_z_is_pandas_centred_rolling(spark, width):
    rng = np.random.default_rng(width)
    v = rng.normal(size=60).round(3)
    v[20:32] = 5.0
    df = samples(spark, [(float(i), float(x)) for i, x in enumerate(v)])
    roll = pd.Series(v).rolling(width, min_periods=1, center=True)
    want = ((v - roll.mean()) / roll.std().where(lambda s: s > 1e-9)).to_numpy()
    widths = spark.createDataFrame([("c", width)], "clip_id string, width int")
    plain = [r.z for r in df.withColumn("z", timeseries.rolling_z_column("v", width)).orderBy("cts").collect()]
    prefix = [r.z for r in timeseries.rolling_z_by_clip(df, "v", widths).orderBy("cts").collect()]
    for got in (plain, prefix):
        assert all((g is None and np.isnan(w)) or (g is not None and abs(g - w) < 1e-6) for g, w in zip(got, want))


def test_asof_ties_go_backward(spark):
    left = samples(spark, [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (9.0, 0.0)])
    right = samples(spark, [(0.5, 1.0), (1.5, 2.0), (2.0, 3.0), (2.0, 4.0), (3.4, 5.0)]).withColumnRenamed("v", "w")
    got = timeseries.asof_nearest(left, right, ["w"], 0.5).orderBy("cts").collect()
    assert [r.w for r in got] == [1.0, 4.0, 5.0, None]


def test_asof_is_pandas(spark):
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.uniform(0, 500, 300)).round(2), np.unique(rng.uniform(0, 500, 200).round(2))
    left = samples(spark, [(float(x), float(i)) for i, x in enumerate(a)])
    right = samples(spark, [(float(x), float(i)) for i, x in enumerate(b)]).withColumnRenamed("v", "w")
    got = [r.w for r in timeseries.asof_nearest(left, right, ["w"], 0.5).orderBy("v").collect()]
    want = pd.merge_asof(pd.DataFrame({"t": a}), pd.DataFrame({"t": b, "w": np.arange(len(b), dtype=float)}), on="t", direction="nearest", tolerance=0.5)["w"]
    assert all((g is None and np.isnan(w)) or g == w for g, w in zip(got, want))


def test_gradient_and_fill(spark):
    g = timeseries.gradient(samples(spark, [(0.0, 1.0), (1.0, 4.0), (2.0, 9.0)]), ["v"], 1.0).orderBy("cts").collect()
    assert [r.jerk_v for r in g] == [3.0, 4.0, 5.0]
    f = timeseries.fill_both(samples(spark, [(0.0, None), (1.0, 2.0), (2.0, None)]), ["v"]).orderBy("cts").collect()
    assert [r.v for r in f] == [2.0, 2.0, 2.0]


def test_misaligned_streams_are_marked(spark):
    a, b = samples(spark, [(0.0, 1.0), (1.0, 2.0)]), samples(spark, [(0.0, 3.0), (1.5, 4.0)]).withColumnRenamed("v", "w")
    assert [r.misaligned for r in timeseries.aligned(a, b).orderBy("cts").collect()] == [False, True]


def test_interval_merge(spark):
    got = intervals.merge_intervals(spans(spark, [(0, 2), (2, 3), (3.5, 4), (0.5, 1)])).orderBy("event_no").collect()
    assert [(r.start_time, r.end_time) for r in got] == [(0, 3), (3.5, 4)]


def test_tiou(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1.0, 3.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(intervals.tiou(*map(F.col, "abcd"))).collect()] == [pytest.approx(1 / 3), 0.0]


def test_interval_join_is_the_plain_join(spark):
    rng = np.random.default_rng(4)
    events = [(float(s), float(s + d)) for s, d in zip(rng.uniform(0, 90, 40).round(1), rng.choice([0, 1.5, 20], 40))]
    frames = [float(t) for t in rng.uniform(0, 100, 150).round(1)]
    e, f = spans(spark, events), spark.createDataFrame([("c", t) for t in frames] + [("c", None)], "clip_id string, t double")
    got = sorted((r.start_time, r.end_time, r.t) for r in intervals.interval_join(e, f, "t", 5.0, ["clip_id"]).collect())
    assert got == sorted((s, x, t) for s, x in events for t in frames if s <= t <= x)
    plan = intervals.interval_join(e, f, "t", 5.0, ["clip_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.interval_join(e, f, "t", 5.0, ["clip_id"], how="left").select("start_time", "end_time").distinct().count() == len(set(events))


def greedy(pred, gold, by, thr):
    used, tp = set(), 0
    for ps, pe in sorted(pred):
        best = None
        for j, (gs, ge) in enumerate(sorted(gold)):
            if j in used:
                continue
            if by == "tiou":
                hull = max(pe, ge) - min(ps, gs)
                score = max(0, min(pe, ge) - max(ps, gs)) / hull if hull > 0 else 0
            else:
                score = -abs((ps + pe) / 2 - (gs + ge) / 2)
            if best is None or score > best[0]:
                best = (score, j)
        if best and (best[0] >= thr if by == "tiou" else -best[0] <= thr):
            used.add(best[1])
            tp += 1
    return tp


@pytest.mark.parametrize("by", ["tiou", "tolerance"])
def test_matching_is_the_greedy_rule(spark, by):
    rng = np.random.default_rng(11)
    make = lambda n: sorted({(round(float(s), 2), round(float(s + d), 2)) for s, d in zip(rng.uniform(0, 30, n), rng.uniform(0.2, 3, n))})
    for _ in range(3):
        pred, gold = make(40), make(30)
        assert intervals.matched(spans(spark, pred), spans(spark, gold), by, 0.5).count() == greedy(pred, gold, by, 0.5)


def test_scores_at_the_edges(spark):
    gold = spans(spark, [(0, 1), (5, 6), (9, 10)])
    none = review.scored(spans(spark, []), gold).collect()[0]
    assert (none.precision, none.recall, none.f1, none.fn) == (None, 0.0, None, 3)
    wrong = review.scored(spans(spark, [(20, 21), (30, 31)]), spans(spark, [(0, 1), (5, 6)])).collect()[0]
    assert (wrong.precision, wrong.recall, wrong.f1) == (0.0, 0.0, 0.0)
    extra = review.scored(spans(spark, [(0, 1)]).unionByName(spans(spark, [(0, 1)], "other")), gold).collect()[0]
    assert (extra.tp, extra.fp) == (1, 0)
    close = review.scored(spans(spark, [(0, 0), (0.3, 0.3)]), spans(spark, [(0.2, 0.2)]), "tolerance", 0.5).collect()[0]
    assert (close.tp, close.fp) == (1, 1)


def test_kappa(spark):
    r = review.kappa(spark.createDataFrame([("Y", "Y"), ("Y", "N"), ("N", "N"), ("N", "N")], "a string, b string"), "a", "b").collect()[0]
    assert (r.po, r.pe, r.kappa) == (0.75, 0.5, 0.5)


def test_offsets(spark):
    rows = [("c", 0.0, 1.0, "confirm", str(x)) for x in (0.2, 0.2, 1.4)] + [("c", 0.0, 1.0, "reject", "9"), ]
    r = review.offset_calibration(spark.createDataFrame(rows, "clip_id string, start_time double, end_time double, decision string, adjusted_start string")).collect()[0]
    assert r.mean_abs == pytest.approx(0.6) and r.pct_over_1 == pytest.approx(100 / 3) and r.median_offset == pytest.approx(0.2) and r.mean_abs_after == pytest.approx(0.4)


def test_risk_chain(spark):
    rows = spark.createDataFrame([("e", 1, 0.0, 0.9, 2.0, "School", 1.0)], "event_id string, frame_id int, timestamp double, absence_confidence double, severity double, zone_type string, retrieval_score double")
    assert risk.icdi(rows).collect()[0].icdi == pytest.approx(2.7)
    e = spark.createDataFrame([(0.0, 5.0, 1.0), (20.0, 25.0, 1.0), (100.0, 101.0, 2.0)], "start_time double, end_time double, icdi double")
    detail, total = risk.crrs(e, 30.0)
    assert sorted(r.weight for r in detail.collect()) == [1, 2, 2] and total.collect()[0].crrs == pytest.approx(2.0)
    blank = spark.createDataFrame([(None, None, 1.0), (None, None, 3.0)], "start_time double, end_time double, icdi double")
    assert risk.crrs(blank, 30.0, legacy=True)[1].collect()[0].crrs == pytest.approx(4.0) and risk.crrs(blank, 30.0)[1].collect()[0].crrs == pytest.approx(2.0)
    i = spark.createDataFrame([(2.0, 0.66), (2.0, 0.33), (2.0, 0.32)], "icdi double, mean_absence_confidence double")
    assert risk.idas(i).collect()[0].idas == pytest.approx((2.0 + 1.0 + 0.2) / 3)


def test_precision_divides_by_k(spark):
    rows = spark.createDataFrame([(1, 1, "1"), (1, 2, ""), (1, 3, "0"), (2, 1, "")], "query_id int, rank int, m string").withColumn("relevant", citations.relevance(F.col("m")))
    r = citations.precision_at_k(rows, 3).collect()[0]
    assert (r.n_queries, r.precision) == (1, 0.3333)


def test_hcas_examples(spark):
    ids = ["IRC35_6.2", "IRC35_6.1", "IRC35_7.1", "IRC67_4.1", None]
    r = citations.hcas_flat(spark.createDataFrame([(p, "IRC35_6.2") for p in ids], "pred string, gold string")).collect()[0]
    assert (round(r.ila, 9), round(r.sla, 9), round(r.cla, 9), round(r.hcas, 9)) == (0.6, 0.4, 0.2, 0.4)
    s = "struct<irc: string, section: string, clause: string>"
    g = citations.hcas_gated(spark.createDataFrame([(("35", "7", "6.2"), [("35", "6", "6.2")])], f"pred {s}, gold array<{s}>")).collect()[0]
    assert (g.ila, g.sla, g.cla, g.hcas) == (1.0, 0.0, 0.0, 0.3333)


def test_clause_parsing(spark):
    df = spark.createDataFrame([("IRC35_6.2",), ("IRC-67-4.1",), ("IRC35-141",), ("x",), (None,)], "c string")
    got = [tuple(r[0]) for r in df.select(citations.parse_clause(F.col("c"))).collect()]
    assert got == [("35", "6", "2"), ("67", "4", "1"), ("35", "141", None), (None,) * 3, (None,) * 3]
    v = df.limit(1).select(citations.verdict_of(F.lit("NON-COMPLIANT per [A.6.2]")).alias("v")).collect()[0].v
    assert (v.verdict, v.clause) == ("NON_COMPLIANT", "A.6.2")


def test_citation_checks(spark):
    v = spark.createDataFrame([("a",), ("b",)], "cited_clause string")
    assert citations.chr_exists(v, spark.createDataFrame([("a",)], "clause_id string")).collect()[0].chr == 0.5
    best = citations.best_labels(spark.createDataFrame([(1, "A", "NEUTRAL", 0), (1, "B", "ENTAILMENT", 1)], "k int, c string, label string, position int"), ["k"]).collect()[0]
    assert (best.c, best.label) == ("B", "ENTAILMENT")


def test_pointers(spark):
    df = spark.createDataFrame([("b-2", "Yes"), ("c", "No"), ("c", "Yes")], "cited string, presence string").withColumn("r", F.array(F.lit("a_1"), F.lit("b_2")))
    got = [r[0] for r in df.select(citations.pointer_index(F.col("r"), F.col("cited"), F.col("presence"))).collect()]
    assert [(g["index"], g.missed) for g in got] == [(1, False), (2, False), (2, True)] and got[2].clauses == ["a_1", "b_2", "c"]
    p = df.limit(1).select(citations.resolve_pointer(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1)), F.col("r"), F.lit("YES")).alias("p")).collect()[0].p
    assert (p.clause, p.confidence) == ("b_2", 0.7) and p.entropy == pytest.approx(-sum(x * math.log(x + 1e-8) for x in (0.2, 0.7, 0.1)))


def test_answers(spark):
    texts = ['```json\n{"label": "a"}\n```', 'Sure {"label": "a"} ok', '[{"label": "a"}, {"label": "b"}]', '{"label": ']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.get_json_object(answers.fenced_object_text(F.col("t")), "$.label")).collect()] == ["a", "a", "a", None]
    fold = '{"presence": "%s", "severity": "low", "reasoning": "x"}'
    full = lambda p: '{"environment": %s, "road_surface": %s, "infrastructure": %s}' % ((fold % p,) * 3)
    cases = [full("yes"), full("maybe"), '{"environment": {}}', full("Yes").replace('"severity": "low", ', "", 1), "x"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(answers.fold_failure(F.col("t"))).collect()]
    assert got == [None, "invalid_presence:environment", "missing_fold:road_surface", "missing_key:environment.severity", "parse_error"]
    r = df.limit(1).select(answers.yes_no(F.lit("Yes it is")), answers.garbage(F.lit("!!")), answers.ungrounded(F.lit("at 31 km"), F.array(F.lit(30.0)), F.lit("a"), F.lit(0.5), ["a"]), answers.ungrounded(F.lit("at 50 km"), F.array(F.lit(30.0)), F.lit("a"), F.lit(0.5), ["a"])).collect()[0]
    assert tuple(r) == (True, True, False, True)


def test_clip_bounds(spark):
    b = spark.range(1).select(intervals.clip_bounds(F.lit(0.1), F.lit(0.3)).alias("b")).collect()[0].b
    assert (b.start, b.end) == (0.0, pytest.approx(0.7))


def test_notes(spark):
    df = spark.createDataFrame([("hard braking near lane",), ("Sensor noise",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(labels.by_words(F.col("n"))).collect()] == ["braking_deceleration", "likely_noise", "other", "other"]


def test_frame_groups(spark):
    rows = [(1, "A"), (5, None), (10, "A"), (30, "A"), (31, "B")]
    got = labels.event_groups(spark.createDataFrame(rows, "frame int, action string").withColumn("clip_id", F.lit("c"))).orderBy("group_no").collect()
    assert [(r.action, r.first_frame, r.last_frame) for r in got] == [("A", 1, 10), ("A", 30, 30), ("B", 31, 31)]


def test_thinning_and_draws(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 3.0), ("b", 0.5), ("b", 9.0)], "k string, mid double")
    assert sorted((r.k, r.mid) for r in intervals.thinned(df, "mid", "k", [F.col("mid")]).collect()) == [("a", 0.0), ("a", 3.0), ("b", 0.5), ("b", 9.0)]
    w = spark.range(1000).withColumn("w", F.when(F.col("id") < 10, 50.0).otherwise(1.0))
    drawn = labels.weighted_draws(w, "w", "id", 3000)
    assert 2800 < drawn.count() < 3200 and 900 < drawn.where("id < 10").count() < 1100


def test_filter_design_and_ends():
    for order in (2, 4, 5):
        for low, high in ((0.5, 10.0), (None, 10.0), (0.5, None)):
            sos = filters.sections(100.0, low, high, order)
            gain = lambda f: abs(np.prod([(s[:3] @ np.exp(-2j * np.pi * f / 100 * np.arange(3))) / (s[3:] @ np.exp(-2j * np.pi * f / 100 * np.arange(3))) for s in sos]))
            for edge in filter(None, (low, high)):
                assert gain(edge) == pytest.approx(math.sqrt(0.5), abs=1e-6)
            assert gain({(True, True): 2.236, (False, True): 0.01, (True, False): 45.0}[low is not None, high is not None]) == pytest.approx(1, abs=1e-3)
    band = filters.sections(200.0, 0.3, 15.0, 4)
    assert np.abs(filters.zero_phase(np.ones((400, 1)), band)).max() < 1e-6
    short = np.arange(27.0)[:, None]
    assert filters.zero_phase(short, band) is short
    t = np.arange(12000) / 200
    wave = np.sin(2 * np.pi * 3 * t)[:, None]
    assert np.corrcoef(filters.zero_phase(wave, band)[4000:-4000, 0], wave[4000:-4000, 0])[0, 1] > 0.99999


def test_filter_chunks_are_the_whole_clip(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=9000)
    df = samples(spark, [(i / 10, float(v)) for i, v in enumerate(x)])
    got = np.array([r.v_bpf for r in filters.filtered(df, ["v"], 10.0, 0.5, 2.0, 2).orderBy("cts").collect()])
    assert np.abs(got - filters.zero_phase(x[:, None], filters.sections(10.0, 0.5, 2.0, 2))[:, 0]).max() < 1e-7


def test_dbscan_is_brute_force(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(c, 20, (30, 2)) for c in ((0, 0), (300, 0), (150, 260))] + [rng.uniform(-100, 400, (40, 2))])
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    got = {r.id: r.cluster for r in spatial.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), 30.0).collect()}
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 900
    core = near.sum(1) >= 4
    want, n = {}, 0
    for i in np.flatnonzero(core):
        if int(i) not in want:
            todo = [i]
            while todo:
                k = todo.pop()
                if int(k) not in want:
                    want[int(k)] = n
                    todo += np.flatnonzero(near[k] & core).tolist()
            n += 1
    for i in np.flatnonzero(~core):
        own = [want[int(k)] for k in np.flatnonzero(near[i] & core)]
        want[int(i)] = min(own, default=-1)
    assert got == want
    edge = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, 1.0, 1.0), (5, 76.0, 0.0), (6, 500.0, 500.0)]
    assert [r.cluster for r in spatial.dbscan(spark.createDataFrame(edge, "id long, x double, y double")).orderBy("id").collect()] == [0, 0, 0, 0, 0, -1]


def test_cluster_scores(spark):
    rows = [(i, 0, 0.0, 0.0, icdi, "t", p) for i, (icdi, p) in enumerate([(2.0, "No"), (1.0, "Yes"), (5.0, "Unknown")])] + [(9, 1, 0.0, 0.0, 1.0, "t", "Unknown")]
    m = {r.cluster: r for r in spatial.cluster_metrics(spark.createDataFrame(rows, "id int, cluster int, x double, y double, icdi double, violation_type string, presence string")).collect()}
    assert m[0].infra_share == pytest.approx(2 / 3) and m[1].infra_share is None
    score = spark.range(1).select(spatial.hotspot_score(F.lit(2.0), F.lit(1.0), F.lit(None).cast("double"))).collect()[0][0]
    assert score == pytest.approx(2 * 1.5 * 0.5)


def test_identical_texts(spark):
    t = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a dog ran over green hills", "a dog ran over green hills")], "id int, candidate string, reference string")
    assert [r.rouge_l for r in textsim.rouge_l(t).collect()] == [1.0, 1.0]
    b = textsim.corpus_bleu(t).collect()[0]
    assert (b.bleu1, b.bleu2, b.bleu4) == (pytest.approx(1), pytest.approx(1), pytest.approx(1))
    assert all(r.cider == pytest.approx(10) for r in textsim.cider(t).collect())


@pytest.mark.parametrize("seed", range(3))
def test_lcs(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(" ".join(rng.choice(list("abc"), rng.integers(0, 9))), " ".join(rng.choice(list("abc"), rng.integers(0, 9)))) for _ in range(30)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _step(row, x, b)
        return row[-1]

    def _step(prev, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(prev[j] + 1 if x == y else max(prev[j + 1], out[j]))
        return out

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = [r[0] for r in df.orderBy("id").select(textsim.lcs_length(textsim.tokens(F.col("a")), textsim.tokens(F.col("b")))).collect()]
    assert got == [lcs(a.split(), b.split()) for a, b in pairs]


def test_clause_split(spark):
    pages = [("d", "6", 2, "6.2 Next head\nbody two 5.1 x"), ("d", "6", 1, "intro\n6.1 Head one\nline\n7.3 other"), ("d", "8", 1, "no numbers")]
    got = {(r.section, r.clause_id): r for r in retrieval.clause_split(spark.createDataFrame(pages, "doc string, section string, page int, text string")).collect()}
    assert set(got) == {("6", "6.1"), ("6", "6.2"), ("8", "8")}
    assert got["6", "6.1"].heading == "Head one" and got["6", "6.1"].page == 1 and got["6", "6.2"].page == 2 and "7.3 other" in got["6", "6.1"].text


def test_graph(spark):
    a = graph.nodes_of(spark.createDataFrame([(1,), (1,)], "k int"), "Clause", graph.node("Clause", F.col("k")), F.col("k"))
    e = graph.edges_of(spark.createDataFrame([(1,), (1,)], "k int"), graph.node("Clause", F.col("k")), F.lit("Section:6"), "PART_OF")
    assert graph.union_nodes(a).count() == 1 and graph.union_edges(e, e.withColumn("relation", F.lit("CITES"))).count() == 3


def test_graph_tasks_grow_in_number(spark, tmp_path, monkeypatch):
    """No task sorts all lines or all nodes: files follow the parts of the input, and are in order; nodes are dealt by their rows."""
    rows = spark.range(0, 1200, 1, 12)
    nodes = graph.nodes_of(rows, "Frame", graph.node("Frame", F.col("id")), F.lit('a<"&'))
    edges = graph.edges_of(rows, graph.node("Frame", F.col("id")), F.lit("Clause:1"), "CITES")
    graph.write_graphml(nodes, edges, str(tmp_path / "ml"))
    parts = sorted((tmp_path / "ml").glob("part-*"))
    assert len(parts) == 26  # one for the head, one for the foot
    lines = [line for part in parts for line in part.read_text().splitlines()]
    assert lines[0].startswith("<?xml") and lines[5].startswith("<graph ") and lines[-2:] == ["</graph>", "</graphml>"]
    assert [line[:5] for line in lines[6:-2]] == ["<node"] * 1200 + ["<edge"] * 1200 and 'a&lt;&quot;&amp;' in lines[6]
    monkeypatch.setattr(graph, "ROWS", 100)
    once = graph.union_nodes(nodes, nodes)
    assert once.rdd.getNumPartitions() == 24 and once.count() == 1200


def test_graph_files_are_packed(spark, tmp_path):
    """Compressed files of bounded length hold the same lines, in order, in a fraction of the room."""
    import gzip
    import xml.etree.ElementTree as ET

    from roadweave.sources import readers

    rows = spark.range(0, 3000, 1, 3)
    nodes = graph.nodes_of(rows, "Frame", graph.node("Frame", F.col("id")), F.when(F.col("id") % 2 == 0, F.lit('a<"&')))
    edges = graph.edges_of(rows, graph.node("Frame", F.col("id")), F.lit("Clause:1"), "CITES")
    graph.write_graphml(nodes, edges, str(tmp_path / "plain"))
    graph.write_graphml(nodes, edges, str(tmp_path / "ml"), **readers.PACKED | {"maxRecordsPerFile": "400"})
    plain = "".join(p.read_text() for p in sorted((tmp_path / "plain").glob("part-*")))
    parts = sorted((tmp_path / "ml").glob("part-*"))
    texts = [gzip.decompress(p.read_bytes()).decode() for p in parts]
    assert all(p.suffix == ".gz" for p in parts) and "".join(texts) == plain and max(t.count("\n") for t in texts) == 400
    assert sum(p.stat().st_size for p in parts) * 5 < len(plain)
    root = ET.fromstring(plain.encode())
    found = root.findall(".//{*}node")
    assert len(found) == 3000 and {n.findall("{*}data")[1].text for n in found} == {'a<"&', None} and len(root.findall(".//{*}edge")) == 3000


@pytest.mark.parametrize("name", ["graph_export"])
def test_graph_export_writes_no_plain_text(spark, name):
    """What the query leaves in the shared folder is compressed, and its nodes were put together once."""
    import glob
    import os

    import __spark_entry__
    from roadweave.functions.storage import session_dir

    here = session_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{here}/graph*"))
    got = {r.kind: r.n for r in __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    made = set(glob.glob(f"{here}/graph*")) - before
    files = [p for m in made for d, _, names in os.walk(m) for p in (f"{d}/{x}" for x in names if x.startswith("part-"))]
    assert files and all(p.endswith((".gz", ".parquet")) for p in files)
    (kept,) = (m for m in made if os.path.basename(m).startswith("graph-nodes"))
    assert spark.read.parquet(kept).count() == got["node"] and got["edge"] == got["link"] > 0 and got["frame"] == 8


def test_rider(spark):
    row = {"rider": "r", "model": "V1", "evasive_action": "Hard_Braking", "evasive_reasoning": "the rider had to brake for a sudden car in the lane", "env": "car ahead", "road_surface": "", "infrastructure": "", "irc35_verdict": "NON_COMPLIANT", "irc67_verdict": "", "irc35_clause": "a", "irc67_clause": "", "retrieved_irc35": "b; a", "retrieved_irc67": "", "crrs35": 0.4, "crrs67": 0.6}
    r = rider.summary(spark.createDataFrame([row])).collect()[0]
    assert (r.n, r.rider_chr, r.rider_rhr, r.rider_icdi, r.rider_idas, r.rider_crrs, r.rider_tipu, r.rider_tvgc) == (1, 1.0, 1.0, 1.0, 1.0, 0.5, 1.0, 1.0)


def test_failure_policies(spark):
    df = spark.createDataFrame([("a", "a", False), ("b", "a", True)], "pred string, gold string, failed boolean")
    acc = lambda p: classify.summary(classify.with_failures(df, "pred", F.col("failed"), p)).collect()[0].accuracy
    assert (acc("excluded"), acc("other"), acc("wrong")) == (1.0, 0.5, 0.5)


def test_groups_over_ranges_are_those_of_one_window(spark):
    import random

    from roadweave.operators import intervals

    rng = random.Random(5)
    rows = [(float(s), float(s + rng.randint(0, 9))) for s in (rng.randint(0, 4000) for _ in range(500))]
    df = spark.createDataFrame(rows, "start_time double, end_time double").repartition(7)
    got = {(r.start_time, r.end_time): r.group_no for r in intervals.grouped_by_gap(df, 3.0, []).collect()}
    reach, no, want = None, 0, {}
    for s, e in sorted(rows):
        no += reach is None or s - reach > 3.0
        reach = e if reach is None else max(reach, e)
        want.setdefault((s, e), no)
    assert got == want


@pytest.mark.parametrize("name", ["weighted_draws", "audit_compliance", "clause_split", "read_jsonl_last", "stream_candidates", "thinned_events", "rouge_l", "evaluation_report"])
def test_more_queries_match_their_sql(spark, name):
    from test_entry import test_queries_match_their_sql as matches_sql

    matches_sql(spark, name)


def test_filter_in_blocks_is_the_filter_by_samples():
    x = np.random.default_rng(1).standard_normal((3000, 3))
    sos = filters.sections(1.0, 0.05, 0.3, 4)
    state = filters._steady(sos)[:, :, None] * x[0]
    assert np.allclose(filters._run(sos, x), filters._steps(sos, x, state)[0], atol=1e-9)


def test_equal_citations_count_as_often_as_they_stand(spark):
    s = "struct<irc: string, section: string, clause: string>"
    gold = [("35", "6", "6.2")]
    each = [(("35", "7", "6.2"), gold), (("35", "6", "6.2"), gold), (("35", "6", "6.2"), gold), (("1", "6", "6.2"), gold)]
    plain = citations.hcas_gated(spark.createDataFrame(each, f"pred {s}, gold array<{s}>")).collect()
    once = [(*each[0], 1), (*each[1], 2), (*each[3], 1)]
    assert citations.hcas_gated(spark.createDataFrame(once, f"pred {s}, gold array<{s}>, n long"), "n").collect() == plain
    assert plain[0].n == 4 and plain[0].cla == 0.5


def test_an_answer_is_read_once(spark):
    """The object is looked for once, and each fold's keys are read once."""
    df = spark.createDataFrame([("{}",)], "t string").select(answers.fold_failure(F.col("t")).alias("r"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("json_object_keys") == 1 + len(answers.FOLDS) and plan.count("rlike") + plan.count("RLIKE") <= 2
    fold = '{"presence": "%s", "severity": "low", "reasoning": "a"}'
    text = '{"environment": %s, "road_surface": %s, "infrastructure": "{\\"presence\\": \\"Yes\\"}"}' % (fold % "yes", fold % "No")
    rows = spark.createDataFrame([(text,), (None,), ("x " + text.replace('"{\\"presence\\": \\"Yes\\"}"', fold % "YES") + " y",)], "t string")
    assert [r[0] for r in rows.select(answers.fold_failure(F.col("t"))).collect()] == ["missing_key:infrastructure.severity", "parse_error", None]


def test_fold_tables_parse_equal_answers_once(spark):
    from roadweave.plans.registry import queries

    got = queries()["fold_tables"](spark, "/root/testdata/sf0.001")
    assert "json" not in got._jdf.queryExecution().optimizedPlan().toString().replace("no json here", "") and got.count() > 0
