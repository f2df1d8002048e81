import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import negatives
from roadweave.llm.queries import queries

SF = "/root/testdata/sf0.001"


def by_hand(rows, anchor=lambda i: i % 50 == 0):
    """Rows are (vec_id, label, x)."""
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
    out = []
    for a in np.flatnonzero(anchor(ids)):
        score = x @ x[a]
        order = np.lexsort((ids, -score))
        good = [i for i in order if labels[i] == labels[a] and i != a][:5]
        for g in good:
            p = int(score[g])
            bad = [i for i in order if labels[i] != labels[a] and 50 * p <= 100 * int(score[i]) <= 95 * p][:3]
            out += [(int(ids[a]), int(ids[g]), k + 1, int(ids[i]), p, int(score[i])) for k, i in enumerate(bad)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    got = sorted(map(tuple, queries()["op13_one_bit_negatives"](spark, SF).collect()))
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == by_hand(rows) and len(got) > 50


def test_intervals_hold_and_are_sharp():
    rng = np.random.default_rng(2)
    for d in (3, 64, 100):
        x = np.floor(rng.standard_normal((400, d)) * 40).astype(np.int64)
        x[5], x[6] = 0, x[7] * 3
        turn = negatives.rotation(d)
        assert np.allclose(turn @ turn.T, np.eye(d))
        a, r = negatives.encode(x[:50], turn, negatives.ANCHOR_LEVELS), negatives.encode(x, turn, negatives.LEVELS)
        i, j = np.arange(50)[:, None], np.arange(400)[None]
        estimate, widths = 0.0, []
        for level in range(negatives.LEVELS):
            estimate, half = negatives.intervals(a, r, i, j, level, estimate, d)
            assert (np.abs(x[:50] @ x.T - estimate) <= half).all()
            widths.append(half.mean())
        assert widths[0] > widths[1] > widths[2]


def test_ties_repeats_and_hot_labels(spark, monkeypatch):
    """Small blocks and many cells; repeated rows and ids are rows of their own; a third of the rows is one vector."""
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 16)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (600, 4))
    x[:200] = x[0]
    rows = [(int(i), int(rng.integers(0, 3)) if i >= 200 else 1, x[i].tolist()) for i in range(600)]
    rows += [rows[50], rows[50], (100, 2, [3, 3, 3, 3])]
    df = spark.createDataFrame(rows, "vec_id long, label long, x array<long>").repartition(5)
    assert sorted(map(tuple, negatives.mine(df, "vec_id % 50 = 0").collect())) == by_hand(rows)


def test_close_vectors_are_mostly_not_scored(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((40, 64))
    x = np.floor(256 * (centre[np.arange(4000) % 40] + 0.1 * rng.standard_normal((4000, 64)))).astype(int)
    df = spark.createDataFrame([(i, i % 2, row.tolist()) for i, row in enumerate(x)], "vec_id long, label long, x array<long>").repartition(4)
    met, scored = negatives.pairs_counted(df, "vec_id % 50 = 0")
    assert met == 80 * 1999 and scored < 0.4 * met


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.6], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [1.0], 2), (9, [], 1), (50, [-1.0, -1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit("r"), "windows": F.lit(1), "x": F.lit(2), "cell": F.lit(3), "kind": F.lit(4)})
    got = negatives.mine(negatives.usable(df), "vec_id % 50 = 0").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 131072, 256 * 128 + 256 * 153)]
    for none in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id = 1")):
        assert negatives.mine(negatives.usable(none), "vec_id % 50 = 0").count() == 0
    huge = spark.createDataFrame([(0, 1, [1 << 40])], "vec_id long, label long, x array<long>")
    with pytest.raises(OverflowError):
        negatives.mine(huge, "vec_id = 0")
