import math
from collections import Counter

import numpy as np
import pytest
from test_entry import test_queries_match_their_sql as matches_sql

from roadweave.operators import grid, retrieval


def test_knn_over_a_large_index(spark, monkeypatch):
    """Ties, cells of several parts of queries and clauses, clauses and queries of other lengths, odd vectors."""
    monkeypatch.setattr(grid, "ASKING", 2)
    monkeypatch.setattr(retrieval, "BLOCK", 100)
    rng = np.random.default_rng(1)
    n = 20_000
    x = rng.standard_normal((n, 2)).round(2)  # with ties
    rows = [(f"c{i:05}", i % 2, v.tolist()) for i, v in enumerate(x)] + [("long", 0, [1.0, 2.0, 3.0]), ("null", 0, None), ("nan", 0, [float("nan"), 1.0]), (None, 0, [0.0, 0.0])]
    clauses = spark.createDataFrame(rows, "clause_id string, doc int, vector array<double>")
    asked = [(f"q{q}", x[-q].tolist()) for q in (1, 2, 3, 4, 5)]
    queries = spark.createDataFrame([*asked, ("three", [1.0, 2.0, 4.0]), ("none", None), ("q1", x[-7].tolist())], "query_id string, vector array<double>")
    got = sorted((r.query_id, r.doc, r.clause_id, r["rank"]) for r in retrieval.knn(queries, clauses).collect())
    want = [("three", 0, "long", 1)]
    for q, v in [*asked, ("q1", x[-7].tolist())]:  # a repeated key asks twice
        near = np.lexsort((np.arange(n), np.sqrt(((x - v) ** 2).sum(1))))[:15]
        for doc in (0, 1):
            want += [(q, doc, f"c{i:05}", r + 1) for r, i in enumerate([i for i in near if i % 2 == doc][:5])]
    assert got == sorted(want)
    assert retrieval.knn(queries, clauses.limit(0)).count() == 0 == retrieval.knn(queries.limit(0), clauses).count()


def test_far_blocks_are_skipped(spark):
    rng = np.random.default_rng(2)
    centre = 20 * rng.standard_normal((30, 16))
    x = centre[np.arange(6000) % 30] + rng.standard_normal((6000, 16))
    clauses = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "clause_id long, doc int, vector array<double>")
    queries = clauses.where("clause_id < 50").selectExpr("clause_id query_id", "vector")
    blocks, skipped = retrieval.knn_blocks(queries, clauses)
    assert skipped > 0.6 * blocks


def by_hand(queries, docs, k):
    words = lambda t: Counter((t or "").lower().split())
    d, q = {i: words(t) for i, t in docs}, {i: words(t) for i, t in queries}
    df = Counter(w for c in d.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    norm = lambda c: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items() if w in idf))
    out = []
    for i, c in q.items():
        scores = [(-round(s, 9), j) for j, o in d.items() if (s := sum(c[w] * o[w] * idf[w] ** 2 for w in c if w in o) / ((norm(c) * norm(o)) or 1)) > 0]
        out += [(i, j, -s, r + 1) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_tfidf_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(grid, "ASKING", 7)
    monkeypatch.setattr(retrieval, "DOCUMENTS", 16)
    monkeypatch.setattr(retrieval, "CELLS", 300)
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.zipf(1.3)) % 500}"
    docs = [(i, " ".join(word() for _ in range(rng.integers(1, 60)))) for i in range(400)] + [(900, None), (901, ""), (902, "w1 w2 w3"), (903, "w1 w2 w3")]
    queries = [(i, " ".join(word() for _ in range(rng.integers(1, 25)))) for i in range(30)] + [(50, "nowhere"), (51, None), (52, "w1 w2 w3")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = sorted(map(tuple, retrieval.tfidf_top(q, d).collect()))
    want = by_hand(queries, docs, 5)
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want] and all(abs(x[2] - y[2]) < 2e-9 for x, y in zip(got, want))
    assert retrieval.tfidf_top(q, d.limit(0)).count() == 0 == retrieval.tfidf_top(q.limit(0), d).count()


def test_words_are_counted_where_their_row_is(spark, monkeypatch):
    """No word of a text is a row before it is counted; rows of one id are put together."""
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    texts = [(1, "b a  B c\ta"), (2, None), (3, "  "), (4, "é É x"), (None, "a a"), (5, "b a b"), (5, "a c")]
    rows = spark.createDataFrame(texts, "_id long, text string").coalesce(1)
    counted = retrieval.term_counts(rows, "text")
    assert "Generate" not in counted._jdf.queryExecution().toString()
    got = sorted(counted.collect(), key=str)
    want = [(i, w, n) for i, t in texts for w, n in Counter((t or "").lower().split()).items()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    q = spark.createDataFrame([(1, "a c"), (2, "b")], "query_id long, text string")
    split, whole = ([(1, "a b"), *rest] for rest in ([(5, "b a b"), (5, "a c")], [(5, "b a b a c")]))
    of = lambda docs: spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda docs: sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.tfidf_top(q, of(docs)).collect())
    assert found(split) == found(whole) and len(found(whole)) == 4


def test_documents_that_can_not_reach_the_top_are_not_scored(spark):
    rng = np.random.default_rng(4)
    topic = lambda t, n: " ".join(f"t{t}x{int(x)}" for x in rng.integers(0, 30, n))
    d = spark.createDataFrame([(i, topic(i % 40, 20 + i // 40) + " the of and") for i in range(4000)], "doc_id long, text string")
    q = spark.createDataFrame([(i, topic(i, 12) + " the of") for i in range(40)], "query_id long, text string")
    pairs, scored = retrieval.tfidf_pairs(q, d)
    assert pairs == 4000 * 40 and scored < pairs


@pytest.mark.parametrize("name", ["knn_retrieval", "retrieval_relevance", "precision_at_k", "tfidf_retrieval"])
def test_whole_tables_match_their_sql(spark, name):
    matches_sql(spark, name)
