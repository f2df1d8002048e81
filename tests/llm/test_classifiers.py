import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweave.llm import langid, quality, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch en ung ein keit lich pf tz zu ge", "fr": "eau eux ou ai tion que ment oi ch re", "es": "ción ll rr os as mente do ez co ja"}
TOXIC = ("grolpath", "zintrom", "bavelux")


def words(rng, lang, n):
    s = SYLLABLES[lang].split()
    return ["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(spark, n=400):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        w = words(rng, lang, rng.randint(8, 80))
        good, toxic = rng.random() < 0.8, rng.random() < 0.25
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "###" for x in w]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        docs.append((i, " ".join(w), lang, f"s{i % 3}", 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, mod, value):
    return zlib.crc32(str(i).encode()) % mod == value


def test_languages(spark, odd_docs, no_docs):
    docs, _ = corpus(spark)
    model = langid.train(langid.learnable(docs))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs, model).collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.97 * len(out)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert len(langid.identify(odd_docs, model).collect()) == odd_docs.count()
    assert got[2].lang_pred == got[3].lang_pred == got[5].lang_pred == "und" and got[2].score == 0
    assert langid.train(no_docs) is None and {r.lang_pred for r in langid.identify(docs.limit(3), None).collect()} == {"und"}


def test_prediction_does_not_depend_on_neighbours(spark):
    docs, _ = corpus(spark, 60)
    model = langid.train(docs)
    texts = [r.text for r in docs.collect()]
    together = langid._predict(pa.array(texts), model)[0]
    assert together == [langid._predict(pa.array([t]), model)[0][0] for t in texts]


def test_family_machines():
    assert langid.family_of("es") == langid.family_of("fr") == "Romance" and langid.family_of("xx") == "xx"


def test_quality(spark, odd_docs, no_docs):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, model).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.predicted for r in out) >= 0.95 * len(out)
    assert quality.classify(odd_docs, model).count() == odd_docs.count()
    blank = quality.train(no_docs, labels.limit(0))
    assert {r.score for r in quality.classify(docs.limit(3), blank).collect()} == {0.5}


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=10)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (500, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 2] > 0.4).astype(float), rounds=5)
    b = model.bins(x)
    by_hand = [model.intercept + sum(t[b[r, i]] for i, t in enumerate(model.tables)) + sum(t[b[r, i] // 4, b[r, j] // 4] for i, j, t in model.pairs) for r in range(20)]
    assert np.allclose(model.margin(b)[:20], by_hand)


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_is_the_edit_distance():
    lexicon = [("idiot", False), ("loser", False), ("scum", False), ("moronic", False)]
    a = toxicity.Automaton(lexicon, [True] * 4)
    rng = random.Random(2)
    for _ in range(3000):
        w = list(rng.choice(lexicon)[0])
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            move = rng.randrange(4)
            if move == 0:
                w.insert(i, rng.choice("iotsle"))
            elif move == 1 and i < len(w):
                w.pop(i)
            elif move == 2 and i < len(w):
                w[i] = rng.choice("idotlser")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        word = "".join(w)
        near = [(edits(word, x), k) for k, (x, _) in enumerate(lexicon) if edits(word, x) == 0 or (edits(word, x) == 1 and len(x) >= 5)] if word else []
        assert a.match(word) == (min(near) if near else (-1, -1)), word


def test_stems_and_spellings():
    a = toxicity.Automaton([("lowei", True)], [False])
    assert a.match("loweischaft") == (0, 0) and a.match("lowe") == (-1, -1)
    assert "idiot" in list(toxicity.spellings("1d10t!!")) and "idiot" in list(toxicity.spellings("i.d.i.o.t")) and "idiot" in list(toxicity.spellings('"idiooot,"'))


@pytest.mark.parametrize(("before", "word", "after", "quoted"), [('he said "', "idiot", '" to', True), ("he said", '"idiot"', "again", True), ("you are an", "idiot", "!", False), ("don't be an", "idiot", "it's bad", False)])
def test_context(before, word, after, quoted):
    assert toxicity.context(before, word, after)[1] == quoted


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.classify(docs, model).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.predicted for r in out) >= 0.97 * len(out)
    assert {w for w, _ in model.entries} >= set(TOXIC)
    bent = spark.createDataFrame([(1, "ther onan gr0lpath erre"), (2, "ther zintorm onan erre"), (3, "ther onan erre")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.classify(bent, model).collect()} == {1: 1, 2: 1, 3: 0}
    assert toxicity.classify(odd_docs, model).count() == odd_docs.count()
    assert toxicity.train(no_docs, labels.limit(0)).entries == []


def test_labels_are_not_inputs(spark):
    docs, labels = corpus(spark, 120)
    model = quality.train(docs, labels)
    plain = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")})
    assert plain == {r.doc_id: r.score for r in quality.classify(changed, model).collect()}


def test_bounded_sample_passes_over_a_hot_key(spark):
    from roadweave.llm.common import bounded_sample

    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    got = bounded_sample(df, "k", 500)
    assert 200 <= got.count() <= 500 and got.where("k = 7").count() == 0
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in bounded_sample(df.repartition(3), "k", 500).collect())
    assert bounded_sample(df.where("k = 7"), "k", 50).count() == 0 and bounded_sample(df, "k", 40_000).count() == 30_000


def test_null_ids_are_not_held_out(spark, odd_docs):
    docs, labels = corpus(spark, 120)
    for got in (quality.classify(odd_docs, quality.train(docs, labels)), langid.identify(odd_docs, None), toxicity.classify(odd_docs, toxicity.Model())):
        assert {r.held_out for r in got.where("doc_id is null").collect()} == {False} and got.where("held_out is null").count() == 0


def test_many_short_texts_need_little_memory():
    import resource

    rng = random.Random(1)
    texts = [" ".join(words(rng, lang, 8)) for lang in SYLLABLES for _ in range(20)]
    x = langid._profiles(pa.array(texts), 12)
    model = langid.Model(langid._fit(np.sqrt(x), [langid.family_of(lang) for lang in SYLLABLES for _ in range(20)]), [langid.Machines(["en"], np.zeros((0, 4096)), np.zeros(0))] * 2, 12)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    langs, _ = langid._predict(pa.array(["abcd"] * 100_000), model)
    assert len(langs) == 100_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB


def test_toxic_score_by_hand():
    """The model's inputs computed hit by hit, without codes or memo."""
    entries, weights = [("idiot", False), ("lowei", True)], [3.0, 2.0]
    model = toxicity.Model(entries, [True, False], weights, np.array([-2.0, 0.5, 0.4, 0.3, 0.2]), {3: 0.01})
    for text in ["nothing here", "you are an idiot", "an idoit and an idiot", 'he said "idiot" to them', "loweitum " + "word " * 49, "idiot " * 40]:
        plain = bent = number = you = 0.0
        n = len(text.split())
        chance = {"lowei": 0.01}
        found = {}
        tokens = text.split()
        for i, w in enumerate(tokens):
            bare = "".join(c for c in w.lower() if c.isalpha())
            hit = next(((e, edits(bare, e) if not stem else 0) for e, stem in entries if (stem and bare.startswith(e)) or (not stem and edits(bare, e) <= 1)), None) if bare else None
            if hit:
                around = tokens[max(0, i - 8) : i] + tokens[i + 1 : i + 9]
                quoted = w.startswith('"') and w.endswith('"')
                found.setdefault(hit, 0.0)
                found[hit] += 1 / 3 if quoted else 1
                you = max(you, float("you" in around and not quoted))
        for (e, bends), count in found.items():
            count = max(0.0, count - 2 * n * chance.get(e, 0.0))
            number += count
            if bends:
                bent += count * weights[[x for x, _ in entries].index(e)]
            else:
                plain += count * weights[[x for x, _ in entries].index(e)]
        z = -2 + 0.5 * min(plain, 15) + 0.4 * min(bent, 15) + 0.3 * np.log1p(number) + 0.2 * (you if number else 0)
        matcher = toxicity.Matcher(entries, model.fuzzy)
        hits = dict(matcher.hits(pa.array([text]))).get(0, [])
        assert abs(toxicity.summed(hits, weights, model.rates) @ model.coefficients - z) < 1e-9, text
