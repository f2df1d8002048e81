import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import whitening
from roadweave.llm.queries import queries

SF = "/root/testdata/sf0.001"


def by_hand(rows, counts=False):
    """x of each row, n, S, eigenvalues, eigenvectors, trace of the distinct vectors."""
    x = [np.floor(256 * np.array(v, float)).astype(np.int64) for v in rows]
    fit = np.array(x) if counts else np.array(sorted({tuple(v) for v in x.__iter__()}))
    s, n = fit.sum(0), len(fit)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return np.array(x), n, s, values[::-1], vectors[:, ::-1]


def test_query_equals_numpy(spark):
    got = queries()["op11_weighted_whitening"](spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, n, s, values, vectors = by_hand(rows["embedding"])
    assert len(got) == 4 * len(rows) and set(got["component"]) == {1, 2, 3, 4} and set(got["n"]) == {n}
    at = {v: i for i, v in enumerate(rows["vec_id"])}
    for c in range(4):
        own = got[got["component"] == c + 1]
        i = own["vec_id"].map(at).to_numpy()
        y = (x[i] - s / n) @ vectors[:, c] / math.sqrt(values[c])
        w = own["whitened"].to_numpy()
        assert min(np.abs(w - y).max(), np.abs(w + y).max()) < 1e-7
        assert np.allclose(own["explained"], values[c] / values.sum(), rtol=1e-9)
        assert own["deviation"].tolist() == ((n * x[i] - s) ** 2).sum(1).tolist()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("weights", whitening.WEIGHTS)
def test_repeated_and_hot_vectors(spark, monkeypatch, weights):
    """A third of the rows is one vector: it is dealt over many keys, and counts once or as often as it is there."""
    monkeypatch.setattr(whitening, "HOT_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 5)).round(2)
    x[:100] = x[0]
    x[100:110] = x[100]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, 2, weights).collect()
    whole, n, s, values, vectors = by_hand(x, weights == "count")
    assert len(got) == 300 and {r.n for r in got} == {n} and len({r.vec_id for r in got}) == 300
    for r in got:
        y = (whole[r.vec_id] - s / n) @ vectors[:, :2] / np.sqrt(values[:2])
        assert np.allclose(np.abs(r.whitened), np.abs(y)) and r.deviation == int(((n * whole[r.vec_id] - s) ** 2).sum())
        assert np.allclose(r.explained, values[:2] / values.sum()) and r.identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.0]), (1, [0.5, -0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"key": F.lit("k"), "x": F.lit(1), "m": F.lit(2), "y": F.lit(3), "n": F.lit(4), "salt": F.lit(5)})
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0 for r in got)) == [0, 1, 1, 2] and {r.n for r in got} == {3} and all(len(r.whitened) == 2 for r in got)
    one = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [0.0, 0.0], None)] * 2
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0 == whitening.whiten(df.limit(0)).count()
    huge = spark.createDataFrame([(1, [1e9]), (2, [-1e9]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whiten(huge).collect()} == {1: None, 2: None, 3: 0}
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="rows")
