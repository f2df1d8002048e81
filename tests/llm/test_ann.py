import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import ann


def exact(ids, x, q_id, q, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    d[ids == q_id] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), d[i]) for i in order if np.isfinite(d[i])]


def test_probes_come_in_order_of_distance():
    places = np.array([[0.2, 0.9, 0.5]])
    ((_, rank, codes),) = ann.probe_order(places, 5)
    assert codes[0] == ann._codes(np.floor(places))[0] and rank.tolist() == [0, 1, 2, 3, 4]
    assert codes[1] == ann._codes(np.array([[0, 1, 0]]))[0] and codes[2] == ann._codes(np.array([[-1, 0, 0]]))[0]


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 8))
    x[100:130] = x[0]  # ties
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>")
    rows = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert abs(np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum()) - r.score) < 1e-12
    hits = sum(len({v for v, _ in exact(ids, x, q, x[q], 10)} & {v for v, _ in found[q]}) for q in range(0, 3000, 100))
    assert hits >= 0.9 * 300
    assert [v for v, _ in found[0]] == list(range(100, 110))
    assert all(sorted(v, key=lambda p: (p[1], p[0])) == v and len(v) == 10 for v in found.values())


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, [1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(2), "codes": F.lit(3)})
    got = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(0, 1, 3), (0, 2, 100), (0, 3, 8), (100, 1, 3), (100, 2, 0), (100, 3, 8)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.search(empty, empty).count() == 0


def noisy_neighbours(rng, queries=40, each=10):
    """Unit vectors in 64 dimensions and neighbours of each at a distance of 1.03."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    q = unit(rng.standard_normal((queries, 64)))
    side = rng.standard_normal((queries, each, 64))
    side = unit(side - (side * q[:, None]).sum(2, keepdims=True) * q[:, None])
    cos = 1 - 1.03**2 / 2
    near = cos * q[:, None] + np.sqrt(1 - cos**2) * side
    return dict(enumerate(q)), [(i, v) for i in range(queries) for v in near[i]]


def test_directions_are_lowered_until_the_recall_is_met():
    own, hits = noisy_neighbours(np.random.default_rng(2))
    assert ann._probes_needed(ann.Hashes.make(64, 10, 1.0), own, hits, 0.96) is None  # as at 11 million rows
    hashes, probes = ann.fitted(64, 10, 1.0, ann.TABLES, 1, own, hits, 0.96)
    assert hashes.k < 10
    found = 0
    for i, v in hits:
        at = ann._codes(np.floor(hashes.places(v[None])[0]))
        found += any(at[t] in set(codes.tolist()) for t, _, codes in ann.probe_order(hashes.places(own[i][None])[0], probes))
    assert found >= 0.96 * len(hits)


def test_recall_is_met_with_small_buckets(spark, monkeypatch):
    """Buckets so small that K is what 10 million rows ask for."""
    own, hits = noisy_neighbours(np.random.default_rng(3), 20, 40)
    x = np.array([*own.values(), *(v for _, v in hits)])
    monkeypatch.setattr(ann, "BUCKET", len(x) / 3**9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, df.where("vec_id < 20")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.arange(len(x))
    assert sum(len({v for v, _ in exact(ids, x, q, x[q], 10)} & found[q]) for q in range(20)) >= 0.9 * 200
    monkeypatch.setattr(ann, "fitted", lambda *a: None)
    rows = ann.search(df, df.where("vec_id < 20")).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in rows} == {(q, n + 1, v) for q in range(20) for n, (v, _) in enumerate(exact(ids, x, q, x[q], 10))}


def test_low_recall_is_an_error(spark):
    truth = spark.createDataFrame([(1, 1, 2, 0.1), (1, 2, 3, 0.2)], "query_id long, rank int, vec_id long, score double")
    ann._check_recall(truth, truth)
    with pytest.raises(RuntimeError):
        ann._check_recall(truth.where("vec_id = 2"), truth)


def test_a_hot_bucket_is_many_tasks(spark, monkeypatch):
    """A third of all rows is one vector's neighbourhood: its blocks and groups are dealt as pairs."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "GROUP", 4)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 8)) * 5
    x[:1000] = x[0] + rng.standard_normal((1000, 8)) * 1e-3
    spread = spark.createDataFrame([(0, 5 if i < 1000 else 6 + i, i, row.tolist()) for i, row in enumerate(x)], "tab int, code long, id long, v array<double>")
    counts = spread.groupBy("tab", "code").count().withColumnRenamed("count", "m")
    blocks = ann._blocks(spread, counts)
    sizes = [r[0] for r in blocks.where("code = 5").select(F.size("rows")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 3 * 64 and blocks.select(F.sum(F.size("rows"))).collect()[0][0] == 3000
    asked = spread.where("id % 100 = 0").select("id", "v")
    wanted = asked.select(F.lit(0).alias("tab"), F.lit(5).cast("long").alias("code"), F.lit(1000).cast("long").alias("m"), "id")
    groups = ann._groups(wanted, asked, 8)
    met = ann._met(blocks, groups)
    assert met.count() == len(sizes) * groups.count()
    got = {}
    for r in ann._ranked(met, 8, 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    ids = np.arange(1000)
    assert got == {q: {n + 1: v for n, (v, _) in enumerate(exact(ids, x[:1000], q, x[q], 10))} for q in range(0, 3000, 100)}


def test_many_exact_queries_are_pairs(spark, monkeypatch):
    monkeypatch.setattr(ann, "EXACT", 3)
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "GROUP", 4)
    x = np.random.default_rng(5).standard_normal((400, 6))
    base = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    rows = ann._exact(base, base.where("id % 20 = 0"), 7, 6).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in rows} == {(q, n + 1, v) for q in range(0, 400, 20) for n, (v, _) in enumerate(exact(np.arange(400), x, q, x[q], 7))}
    assert ann._exact(base, base.limit(0), 7, 6) is None


def by_nearest_row(rows, asks, k):
    """query -> [(vec_id, score)], an id by its nearest row, the query's own id left out."""
    out = {}
    for q, v in asks.items():
        near = {}
        for i, x in rows:
            if i != q:
                near[i] = min(near.get(i, np.inf), float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())))
        out[q] = sorted(near.items(), key=lambda p: (p[1], p[0]))[:k]
    return out


def test_a_repeated_id_counts_by_its_nearest_row(spark, monkeypatch):
    """Ids with 1, 2 and 20 vectors, queries too, in one partition: probed, exact in one pass and exact in pairs."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(1, 400) for _ in range((1, 1, 2, 20)[i % 4])]
    rows += [(1, (0.01 * rng.standard_normal(4)).tolist()) for _ in range(20)] + [(0, [0.0, 0.0, 0.0, 1e-9]), (0, [5.0, 0.0, 0.0, 0.0])] + rows[:50]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asks = {i: min(v for j, v in rows if j == i) for i in {i for i, _ in rows if i % 40 == 0}}
    want = by_nearest_row(rows, asks, 10)

    def run():
        found = {}
        for r in sorted(ann.search(df, df.where("vec_id % 40 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        return found

    got = run()
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * 10 * len(want)
    for q, pairs in got.items():
        whole = dict(by_nearest_row(rows, {q: asks[q]}, 1000)[q])
        assert len(pairs) == 10 and all(abs(whole[i] - d) < 1e-12 for i, d in pairs)
    monkeypatch.setattr(ann, "fitted", lambda *a: None)
    close = lambda a, b: a.keys() == b.keys() and all([i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([d for _, d in a[q]], [d for _, d in b[q]], atol=1e-12) for q in a)
    assert close(run(), want)
    for name, n in (("EXACT", 3), ("BLOCK", 50), ("GROUP", 4)):
        monkeypatch.setattr(ann, name, n)
    assert close(run(), want)


def test_the_nearest_of_two_vectors_of_an_id(spark):
    df = spark.createDataFrame([(1, [1.0, 9.0]), (1, [1.0, 1.5]), (0, [1.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert [(r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 2.0)]
