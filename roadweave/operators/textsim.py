"""Similarity of generated and reference texts, over a table of pairs (id, candidate, reference)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.storage import spread, stored
from roadweave.operators.stemming import stems


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; none for a blank text."""
    return F.filter(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, each as one string."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def gram_rows(pairs: DataFrame, keys: Sequence[str], most: int = 4) -> DataFrame:
    """keys, cw, rw, n, gram, cc, cr: how often each n-gram stands in the candidate and in the reference (cw and rw words).

    A pair without n-grams keeps one row, with a null gram. Texts are dealt by ``keys``, so n-grams
    are counted where they are made and never shuffled one by one.
    """
    sides = spread(pairs, *keys).select(*keys, tokens(F.col("candidate")).alias("_c"), tokens(F.col("reference")).alias("_r"))

    def of_length(words: str, n: int, mine: int) -> Column:
        return F.transform(ngrams(F.col(words), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"), F.lit(mine).alias("mine")))

    def of(words: str, mine: int) -> Column:
        return F.flatten(F.array(*[of_length(words, n, mine) for n in range(1, most + 1)]))

    rows = sides.select(*keys, F.size("_c").alias("cw"), F.size("_r").alias("rw"), F.explode_outer(F.concat(of("_c", 1), of("_r", 0))).alias("g"))
    mine = F.coalesce("g.mine", F.lit(0))
    return rows.groupBy(*keys, "cw", "rw", F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.sum(mine).alias("cc"), F.sum(1 - mine).alias("cr"))


def cider(pairs: DataFrame, key: str = "id", variant: str = "d", by: Sequence[str] = ()) -> DataFrame:
    """key (and ``by``), cider of each pair (candidate, reference); documents are counted within ``by``.

    ``d``: document frequency over candidates and references, idf ln(max(1, N / df)), counts over
    words, cosine damped by exp(-(length difference)^2 / 72), mean over n, times 10. ``simple``:
    document frequency over references, idf ln(N / (df + 1)), counts over n-grams, no damping, no
    factor. ``clipped``: as ``d`` over references alone, candidate values clipped to the reference's.
    """
    keys = [*by, key]
    base = pairs.where(F.col("candidate").isNotNull() & F.col("reference").isNotNull())
    seen = (F.col("cc") > 0).cast("int") if variant == "d" else F.lit(0)
    # N-grams are dealt and sorted once, for their frequencies and their values; a task may spill those of a frequent one.
    alike = Window.partitionBy(*by, "n", "gram")
    counts = gram_rows(base, keys).withColumn("df", F.nullif(F.sum(seen + (F.col("cr") > 0).cast("int")).over(alike), F.lit(0)))
    total = base.groupBy(*by).agg((F.count(F.lit(1)) * (2 if variant == "d" else 1)).cast("double").alias("_total"))
    idf_value = F.log(F.col("_total") / (F.col("df") + 1)) if variant == "simple" else F.log(F.greatest(F.lit(1.0), F.col("_total") / F.greatest(F.col("df"), F.lit(1))))
    if by:
        total = stored(total, "cider-totals")  # by its true size, a row a group, it is no reason to deal n-grams by the group
    weighed = counts.join(total, list(by)) if by else counts.crossJoin(total)  # single-row scalar

    def value(count: str, words: str) -> Column:
        over = F.greatest(F.lit(1), F.col(words) - F.col("n") + 1) if variant == "simple" else F.greatest(F.lit(1), F.col(words))
        return F.col(count) / over * F.coalesce(idf_value, F.lit(0.0))

    a, b = F.coalesce(value("cc", "cw"), F.lit(0.0)), F.coalesce(value("cr", "rw"), F.lit(0.0))
    weighed = weighed.select(*keys, "cw", "rw", "n", a.alias("a"), b.alias("b"))
    dot = F.least(F.col("a"), F.col("b")) * F.col("b") if variant == "clipped" else F.col("a") * F.col("b")
    sums = [f for n in range(1, 5) for f in (
        F.sum(F.when(F.col("n") == n, dot).otherwise(0.0)).alias(f"d{n}"), F.sum(F.when(F.col("n") == n, F.col("a") * F.col("a")).otherwise(0.0)).alias(f"a{n}"), F.sum(F.when(F.col("n") == n, F.col("b") * F.col("b")).otherwise(0.0)).alias(f"b{n}"))]
    per = weighed.groupBy(*keys, "cw", "rw").agg(*sums)
    cosines = F.lit(0.0)
    for n in range(1, 5):
        cosines = cosines + F.coalesce(F.try_divide(F.col(f"d{n}"), F.sqrt(f"a{n}") * F.sqrt(f"b{n}")), F.lit(0.0))
    apart = F.col("cw") - F.col("rw")
    scale = F.lit(1.0) if variant == "simple" else F.exp(-apart * apart / 72.0) * 10.0
    return per.select(*keys, (cosines / 4 * scale).alias("cider"))


def clipped_matches(pairs: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, cand_words, ref_words and for n = 1..4 m<n> (clipped matches) and t<n> (n-grams of the candidate) of each pair."""
    rows = gram_rows(pairs, keys)
    met = [F.sum(F.when(F.col("n") == n, F.least("cc", "cr")).otherwise(0)).alias(f"m{n}") for n in range(1, 5)]
    per = rows.groupBy(*keys, F.col("cw").alias("cand_words"), F.col("rw").alias("ref_words")).agg(*met)
    return per.withColumns({f"t{n}": F.greatest(F.col("cand_words") - n + 1, F.lit(0)) for n in range(1, 5)})


def _bleu(order: int, smooth: bool) -> Column:
    """BLEU from matches m1.., totals t1.. and lengths in scope; zero matches become 0.1 if smoothed."""
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        m = F.when(F.col(f"m{n}") == 0, F.lit(0.1)).otherwise(F.col(f"m{n}").cast("double")) if smooth else F.nullif(F.col(f"m{n}").cast("double"), F.lit(0.0))
        logs = logs + F.log(m / F.greatest(F.col(f"t{n}"), F.lit(1))) / order
    brevity = F.when(F.col("cand_words") > F.col("ref_words"), 1.0).when(F.col("cand_words") == 0, 0.0).otherwise(F.exp(1 - F.col("ref_words") / F.nullif(F.col("cand_words"), F.lit(0))))
    return F.when((F.col("m1") == 0) | (F.col("cand_words") == 0), 0.0).otherwise(F.coalesce(brevity * F.exp(logs), F.lit(0.0)))


def sentence_bleu(pairs: DataFrame, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """key (and ``by``), bleu: smoothed BLEU-4 of each pair; 0 where no word matches."""
    return clipped_matches(pairs, [*by, key]).select(*by, key, _bleu(4, True).alias("bleu"))


def corpus_bleu(pairs: DataFrame, key: str = "id") -> DataFrame:
    """bleu1, bleu2 (not smoothed) and bleu4 (smoothed) of pooled counts; pairs with a blank side are left out."""
    used = clipped_matches(pairs, [key]).where("cand_words > 0 and ref_words > 0")
    pooled = used.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cand_words", "ref_words", *[f"{x}{n}" for n in range(1, 5) for x in "mt"])])
    return pooled.select(_bleu(1, False).alias("bleu1"), _bleu(2, False).alias("bleu2"), _bleu(4, True).alias("bleu4"))


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: the rows of the table as the bits of one number."""
    places: dict[str, int] = {}
    for j, word in enumerate(b):
        places[word] = places.get(word, 0) | (1 << j)
    row = 0
    for word in a:
        open_ = row | places.get(word, 0)
        row = open_ & (open_ ^ (open_ - ((row << 1) | 1)))
    return row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of words; in Arrow batches."""

    @F.arrow_udf("int")
    def length(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([_common_subsequence(p or [], q or []) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return length(a, b)


def rouge_l(pairs: DataFrame, key: str = "id", by: Sequence[str] = (), stemming: bool = True) -> DataFrame:
    """key (and ``by``), rouge_l: F measure of the longest common subsequence of alphanumeric words, or of their stems."""
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda w: w != "")
    t = pairs.select(*by, key, words("candidate").alias("_a"), words("reference").alias("_b"))
    if stemming:
        t = t.withColumns({c: stems(F.col(c)) for c in ("_a", "_b")})
    t = t.withColumn("_l", lcs_length(F.col("_a"), F.col("_b")))
    p, r = F.try_divide(F.col("_l"), F.size("_a")), F.try_divide(F.col("_l"), F.size("_b"))
    return t.select(*by, key, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("rouge_l"))


def report(rows: DataFrame, by: Sequence[str], key: str = "id", labels: Sequence[str] | None = None) -> DataFrame:
    """``by``, n_scored, accuracy, macro_f1, n_pairs, bleu, rouge_l, cider, rounded to 4 digits.

    ``rows`` has key, pred, gold and the texts candidate and reference. Text scores are means over the
    pairs whose sides are both not blank, 0 where a group has none.
    """
    from roadweave.operators.classify import summary

    both = rows.where((F.trim("candidate") != "") & (F.trim("reference") != ""))
    texts = sentence_bleu(both, key, by).join(rouge_l(both, key, by), [*by, key]).join(cider(both, key, "d", by), [*by, key])
    means = texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), *[F.avg(c).alias(c) for c in ("bleu", "rouge_l", "cider")])
    scores = summary(rows, by=by, labels=labels).select(*by, F.col("n").alias("n_scored"), "accuracy", "macro_f1")
    met = scores.join(means, list(by), "left")
    return met.select(*by, "n_scored", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("accuracy", "macro_f1", "bleu", "rouge_l", "cider")])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
