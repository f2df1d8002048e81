"""Scores of predicted labels: confusion counts, per-class and pooled metrics, joins of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_class(df: DataFrame, pred: str = "pred", gold: str = "gold", by: Sequence[str] = (), labels: Sequence[str] | None = None, label_set: str = "union") -> DataFrame:
    """``by``, label, tp, n_pred, n_gold, precision, recall, f1 (0 where undefined) of each class.

    Classes: ``labels`` if given, else those in gold (``label_set="gold"``) or in either column.
    """
    hits = df.groupBy(*by, F.col(gold).alias("label")).agg(F.count(F.lit(1)).alias("n_gold"), F.sum(F.coalesce((F.col(pred) == F.col(gold)).cast("long"), F.lit(0))).alias("tp"))
    made = df.groupBy(*by, F.col(pred).alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    both = hits.join(made, [*by, "label"], "left" if label_set == "gold" else "full").where("label is not null")
    if labels is not None:
        spark = df.sparkSession
        wanted = spark.createDataFrame([(v,) for v in labels], "label string")
        wanted = df.select(*by).distinct().crossJoin(F.broadcast(wanted)) if by else wanted  # the label list is a parameter
        both = wanted.join(both, [*by, "label"], "left")
    both = both.select(*by, "label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "n_pred", "n_gold")])
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("n_gold")), F.lit(0.0))
    return both.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))})


def summary(df: DataFrame, pred: str = "pred", gold: str = "gold", by: Sequence[str] = (), labels: Sequence[str] | None = None, label_set: str = "union") -> DataFrame:
    """``by``, n, accuracy, and macro and support-weighted precision, recall, f1."""
    classes = per_class(df, pred, gold, by, labels, label_set)
    weigh = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("n_gold")), F.sum("n_gold")), F.lit(0.0))
    out = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")] + [weigh(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    acc = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col(pred) == F.col(gold)).cast("double"), F.lit(0.0))).alias("accuracy"))
    scores = classes.groupBy(*by).agg(*out)
    return acc.join(scores, list(by)) if by else acc.crossJoin(scores)  # single rows


def binary(df: DataFrame, pred: Column, gold: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by``, tp, fp, fn, tn, precision, recall, f1, accuracy; 0 where undefined. Null predictions count as no."""
    p, g = F.coalesce(pred, F.lit(False)), F.coalesce(gold, F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    t = df.groupBy(*by).agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"), n(~p & ~g).alias("tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec, rec = zero(tp, tp + fp), zero(tp, tp + fn)
    return t.withColumns({"precision": prec, "recall": rec, "f1": zero(2 * prec * rec, prec + rec), "accuracy": zero(tp + F.col("tn"), tp + fp + fn + F.col("tn"))})


def distribution(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, value, n, share of each value."""
    counted = df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(w))


def imbalance(df: DataFrame, column: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, n_positive, n_other, ratio of others to positives (over 1 at least)."""
    yes = F.sum(F.coalesce((F.col(column) == positive).cast("long"), F.lit(0)))
    counted = df.groupBy(*by).agg(yes.alias("n_positive"), (F.count(F.lit(1)) - yes).alias("n_other"))
    return counted.withColumn("ratio", F.col("n_other") / F.greatest(F.col("n_positive"), F.lit(1)))


def pooled(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and the summary of several (predicted, gold) column pairs as one list; pairs with a missing side do not count.

    Classes are those in gold, as the scores are macro means over the reference's classes.
    """
    both = F.explode(F.array(*[F.struct(F.col(p).alias("pred"), F.col(g).alias("gold")) for p, g in pairs]))
    rows = df.select(*by, both.alias("_x")).select(*by, "_x.*").where("pred is not null and gold is not null")
    return summary(rows, by=by, label_set="gold")


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, n, share of rows in which both columns are the same."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def model_pairs(df: DataFrame, keys: Sequence[str], model: str, value: str) -> DataFrame:
    """``keys``, model_a, model_b, a, b: outputs of each two models for the same keys."""
    left = df.select(*keys, F.col(model).alias("model_a"), F.col(value).alias("a"))
    right = df.select(*keys, F.col(model).alias("model_b"), F.col(value).alias("b"))
    return left.join(right, list(keys)).where("model_a < model_b")


def rescored(results: DataFrame, truth: DataFrame, order: str, label: str = "true_label", digits: int = 3) -> DataFrame:
    """``results`` with the label of ``truth`` by (clip_id, start, end rounded to ``digits``); of repeated keys the last counts; ``matched`` says whether there was one."""
    scale = 10**digits
    key = lambda c: F.round(F.col(c) * scale).cast("long")
    one = truth.groupBy(F.col("clip_id"), key("start_time").alias("_s"), key("end_time").alias("_e")).agg(F.max_by(label, order).alias(label))
    met = results.drop(label).withColumns({"_s": key("start_time"), "_e": key("end_time")}).join(one, ["clip_id", "_s", "_e"], "left")
    return met.withColumn("matched", F.col(label).isNotNull()).drop("_s", "_e")


def with_failures(df: DataFrame, pred: str, failed: Column, policy: str = "other") -> DataFrame:
    """Predictions of failed answers: dropped (``excluded``), ``other``, ``PARSE_FAIL`` (``wrong``), or false (``negative``)."""
    if policy == "excluded":
        return df.where(~failed)
    value = {"other": F.lit("other"), "wrong": F.lit("PARSE_FAIL"), "negative": F.lit("false")}[policy]
    return df.withColumn(pred, F.when(failed, value).otherwise(F.col(pred)))


def category_ranges(df: DataFrame, categories: Sequence[str], category: str, values: Sequence[str]) -> DataFrame:
    """category, n and the range of each value; categories without rows stay, with n 0."""
    dim = df.sparkSession.createDataFrame([(c,) for c in categories], f"{category} string")
    aggs = [f(v).alias(f"{name}_{v}") for v in values for name, f in (("min", F.min), ("max", F.max))]
    return dim.join(df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), *aggs), category, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def without_rare(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows of labels that occur at least ``least`` times."""
    rare = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least)
    return df.join(rare, label, "left_anti")
