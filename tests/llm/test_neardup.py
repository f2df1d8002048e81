import itertools
import random

import numpy as np
import pyarrow as pa

from roadweave.llm import neardup
from roadweave.operators.components import connected

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun") for b in ("n", "st", "ra", "lim", "o", "er", "ti", "wu")]


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b)) for d in set(a) & set(b))


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(6, 60))]
        if rng.random() < 0.3:
            base = base[:3] * 12
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(copy)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_similarity_is_exact():
    texts = corpus(1)
    pairs = list(itertools.combinations(texts, 2))[:400]
    j = neardup.similarity(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    for (a, b), x in zip(pairs, j):
        sa, sb = shingle_set(a), shingle_set(b)
        assert abs(x - len(sa & sb) / len(sa | sb)) < 1e-12


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 3, 50), rng.uniform(0.5, 3, 50)
    doc = np.repeat([0, 1], 50)
    sig = neardup.signatures(doc, np.concatenate([h[:50], h[10:60]]), np.concatenate([wa, wb]), 2, 4000)
    a, b = dict(zip(h[:50].tolist(), wa)), dict(zip(h[10:60].tolist(), wb))
    assert abs((sig[0] == sig[1]).mean() - probability_jaccard(a, b)) < 0.04


def test_repeated_lines_do_not_hide_links(spark):
    """Pairs of a set Jaccard of at least 0.8, where one text repeats lines that the other has once."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        words = [f"w{i}x{k}" for k in range(170)]
        other = words[:-12] + [f"v{i}x{k}" for k in range(12)]
        line = words[:60]
        rows += [(2 * i, " ".join(words + line * 100)), (2 * i + 1, " ".join(other + line))]
        a, b = (shingle_set(t) for _, t in rows[-2:])
        assert len(a & b) / len(a | b) >= 0.8
    rng.shuffle(rows)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0").count()
    assert found >= 798  # 7e-5 of the pairs may be missed


def test_texts_meet_by_weights_too(spark):
    """Bands of a text are those of equal weights and, if it repeats shingles, those of 1 + ln(count)."""
    words = [f"w{k}" for k in range(300)]
    line = words[:40]
    rows = [(0, " ".join(words)), (1, " ".join(line * 60 + words)), (2, " ".join(line * 60 + words[:-100])), (3, "")]
    got = {r.doc_id: r.bands for r in neardup.sketch(spark.createDataFrame(rows, "doc_id long, text string"), bands=400, rows=1).collect()}
    assert len(got[0]) == 400 and len(got[1]) == len(got[2]) == 800 and got[3] is None

    def counts(text):
        w = text.split()
        out = {}
        for k in range(len(w) - 4):
            out[tuple(w[k : k + 5])] = out.get(tuple(w[k : k + 5]), 0) + 1
        return out

    a, b = counts(rows[1][1]), counts(rows[2][1])
    for lo, weigh in ((0, lambda n: 1.0), (400, lambda n: 1 + np.log(n))):
        x, y = ([h if h is not None else got[i][k] for k, h in enumerate(got[i][lo : lo + 400])] for i in (1, 2))
        agree = np.mean([p == q for p, q in zip(x, y)])
        expect = probability_jaccard({e: weigh(n) for e, n in a.items()}, {e: weigh(n) for e, n in b.items()})
        assert abs(agree - expect) < 0.07
    # Without repeats the text's one signature is both.
    assert abs(np.mean([p == q for p, q in zip(got[0], got[1][:400])]) - len(set(counts(rows[0][1])) & set(a)) / len(set(counts(rows[0][1])) | set(a))) < 0.07


def brute_classes(rows):
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (i, a), (k, b) in itertools.combinations(rows, 2):
        sa, sb = shingle_set(a), shingle_set(b)
        j = len(sa & sb) / len(sa | sb) if sa and sb else 0
        linked = a == b or j >= 0.8
        if linked and find(i) != find(k):
            x, y = sorted((find(i), find(k)))
            label[y] = x
    return {i: find(i) for i, _ in rows}


def test_classes_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(corpus(7) + corpus(8))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=2).collect()  # many small blocks
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(120)] = rng.choice(WORDS)
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].kept and by[3].class_id == 3 and by[None].kept
    kept = neardup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert neardup.near_duplicates(no_docs).count() == 0


def test_repeated_rows_and_shared_ids(spark, odd_docs):
    import corpus_pipeline

    assert sorted(r.kept for r in neardup.near_duplicates(odd_docs).collect() if r.doc_id == 1) == [False, True]
    one = corpus_pipeline.distinct(spark, odd_docs, "")
    assert one.columns == odd_docs.columns and one.count() == odd_docs.count() - 1 and one.where("doc_id = 1").count() == 1
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(3))
    # 7 has two texts; both have near copies, and 9 repeats one of them.
    rows = [(7, a), (7, b), (8, a + " end"), (9, b + " end"), (9, b + " end"), (10, c), (10, c), (11, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.distinct(spark, df, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(7, a), (7, b), (10, c)])
    found = neardup.near_duplicates(df).collect()
    assert len(found) == 8 and sum(r.kept for r in found) == 3 and {r.class_id for r in found if r.doc_id in (8, 9)} == {7}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                label[k] = x
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: min(v) for k, v in label.items() if len(v) > 1}


def test_hot_copies_and_hot_rows(spark):
    """A third of the rows is one text under many ids, a third repeats one row."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(40)]
    rows = [(i, texts[0]) for i in range(100)] + [(500, texts[1])] * 100 + [(1000 + i, t) for i, t in enumerate(texts[2:])] + [(2000 + i, t + " end") for i, t in enumerate(texts[:20])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    expect = brute_classes(sorted(set(rows)))
    assert {r.doc_id: r.class_id for r in got} == expect
    assert sum(r.kept for r in got) == len(set(expect.values()))
    kept = neardup.deduplicate(df, repeats=False).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expect.values()))
    assert neardup.deduplicate(df).count() == len(kept) + 99


def test_unrelated_texts_with_shared_boilerplate(spark):
    """One passage in all texts fills buckets with texts that are not linked; the links among them are still found."""
    rng = random.Random(10)
    shared = " ".join(rng.choice(WORDS) + str(k) for k in range(60))
    own = [" ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(rng.randint(20, 50))) for _ in range(120)]
    rows = [(i, f"{shared} {t}") for i, t in enumerate(own)] + [(1000 + i, f"{shared} {t} more") for i, t in enumerate(own[:30])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
