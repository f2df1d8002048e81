import pytest
from pyspark.sql import functions as F

from roadweave.operators import textsim

ROWS = [(1, 0, "a b c d e", "a b c x"), (2, 0, "a b only here", "c d e a b"), (3, 1, "a a a b", "a b"), (4, 1, "z", "y y"), (5, 1, " ", "a b c"), (6, 2, "q r", "q r")]


@pytest.mark.parametrize("variant", ["d", "clipped", "simple"])
def test_groups_are_scored_as_if_alone(spark, monkeypatch, variant):
    kept, stored = [], textsim.stored
    monkeypatch.setattr(textsim, "stored", lambda df, name: kept.append((name, df.columns)) or stored(df, name))
    pairs = spark.createDataFrame(ROWS, "id long, fold long, candidate string, reference string")
    got = {r.id: r.cider for r in textsim.cider(pairs, "id", variant, ["fold"]).collect()}
    # A group's size is a small table by its true size, so no task reads all n-grams of a group.
    assert kept == [("cider-totals", ["fold", "_total"])]
    alone = {}
    for fold in range(3):
        alone |= {r.id: r.cider for r in textsim.cider(pairs.where(F.col("fold") == fold), "id", variant).collect()}
    assert got == pytest.approx(alone) and len(got) == 6 and any(got.values())


def test_ngrams_are_shuffled_once_and_not_stored(spark, monkeypatch):
    kept, stored = [], textsim.stored
    monkeypatch.setattr(textsim, "stored", lambda df, name: kept.append(name) or stored(df, name))
    pairs = spark.createDataFrame(ROWS, "id long, fold long, candidate string, reference string")
    scores = textsim.cider(pairs, "id", "d")
    plan = scores._jdf.queryExecution().sparkPlan().toString()
    assert not kept and plan.count("Generate explode") == 1 and scores.count() == 6
