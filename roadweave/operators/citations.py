"""Clause ids, citations and the compliance metrics made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(c), F.lit(""))


def normalise_clause(c: Column) -> Column:
    return F.translate(c, "-", "_")


def parse_clause(c: Column) -> Column:
    """struct(irc, section, subclause) of ids like ``IRC35_6.2``; parts that are not there are null."""
    # Fixed value: the form of a clause id.
    pattern = r"(?i)^IRC[-_]?(\d+)[-_](\d+)(?:\.(\d+))?"
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return F.struct(part(1).alias("irc"), part(2).alias("section"), part(3).alias("subclause"))


def parse_combined(c: Column) -> Column:
    """struct(irc, section, clause) of citations like ``IRC35/6.2.3``; all null where it does not parse."""
    # Fixed value: the form of a combined citation.
    pattern = r"(?i)(?:IRC\s*)?([\w-]+)\s*[/\-:]\s*([\d.]+)"
    irc, clause = (F.nullif(F.regexp_extract(F.trim(c), pattern, i), F.lit("")) for i in (1, 2))
    return F.struct(irc.alias("irc"), F.split(clause, r"\.")[0].alias("section"), clause.alias("clause"))


def split_citations(c: Column) -> Column:
    """Ids in a cell: split at the first of , ; | / that occurs in it, trimmed, blanks dropped."""
    parts = F.when(F.contains(c, F.lit(",")), F.split(c, ",")).when(F.contains(c, F.lit(";")), F.split(c, ";"))
    parts = parts.when(F.contains(c, F.lit("|")), F.split(c, r"\|")).when(F.contains(c, F.lit("/")), F.split(c, "/")).otherwise(F.array(c))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def first_text(*columns: str) -> Column:
    """The first of the columns that is not blank."""
    return F.coalesce(*[filled(F.col(c)) for c in columns])


def verdict_of(text: Column) -> Column:
    """struct(verdict, clause) from free text; clause is what stands in brackets like ``[A.6.2]``."""
    verdict = F.when(F.rlike(text, F.lit(r"(?i)\bNON[_\s-]?COMPLIANT\b")), "NON_COMPLIANT").otherwise("COMPLIANT")
    return F.struct(verdict.alias("verdict"), F.regexp_extract(text, r"\[([A-Z0-9]+\.\d[\d.]*)\]", 1).alias("clause"))


def norm_verdict(v: Column) -> Column:
    up = F.upper(v)
    return F.when(F.contains(up, F.lit("NON")), "NON_COMPLIANT").when(F.contains(up, F.lit("COMPLIANT")), "COMPLIANT")


def gold_clauses(rows: DataFrame, rule: str = "rule", clause: str = "cited_clause") -> DataFrame:
    """rule, clauses: distinct sorted clause ids (- read as _) of each rule, without blanks and null words."""
    good = filled(F.col(clause)).isNotNull() & ~F.col(clause).isin("null", "None")
    return rows.where(good).groupBy(rule).agg(F.array_sort(F.collect_set(normalise_clause(F.col(clause)))).alias("clauses"))


def clause_table(clauses: DataFrame) -> DataFrame:
    """clause_id (- read as _), text of a knowledge base, one row an id (the largest text of equals)."""
    return clauses.where(filled(F.col("clause_id")).isNotNull()).groupBy(normalise_clause(F.col("clause_id")).alias("clause_id")).agg(F.max("text").alias("text"))


def _share(part: Column) -> list[Column]:
    rows = F.lit(1)
    hit = F.sum(F.when(part, 1).otherwise(0)).cast("long")
    return [F.count(rows).alias("total"), F.coalesce(hit, F.lit(0)).alias("hallucinated"), F.try_divide(hit, F.count(rows)).alias("chr")]


def chr_static(verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """total, hallucinated, chr: non-compliant verdicts whose citation is not among the rule's gold clauses."""
    cited = verdicts.where((F.col("verdict") == "NON_COMPLIANT") & filled(F.col("cited_clause")).isNotNull())
    met = cited.join(gold, "rule", "left")
    return met.agg(*_share(~F.coalesce(F.array_contains("clauses", normalise_clause(F.trim("cited_clause"))), F.lit(False))))


def chr_event(verdicts: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The same against the clauses retrieved for that event (event_id, retrieved array)."""
    cited = verdicts.where((F.col("verdict") == "NON_COMPLIANT") & filled(F.col("cited_clause")).isNotNull())
    met = cited.join(retrieved, "event_id", "left")
    return met.agg(*_share(~F.coalesce(F.array_contains("retrieved", F.trim("cited_clause")), F.lit(False))))


def chr_exists(verdicts: DataFrame, clauses: DataFrame) -> DataFrame:
    """The same for citations that are in no clause table (clause_id)."""
    cited = verdicts.where(filled(F.col("cited_clause")).isNotNull()).withColumn("_c", F.trim("cited_clause"))
    known = clauses.select(F.col("clause_id").alias("_c"), F.lit(True).alias("_known")).distinct()
    return cited.join(known, "_c", "left").agg(*_share(F.col("_known").isNull()))


def best_labels(rows: DataFrame, keys: Sequence[str], label: str = "label", position: str = "position") -> DataFrame:
    """For each key the row of the best label (entailment, neutral, contradiction), the first of equals."""
    rank = F.when(F.col(label) == "ENTAILMENT", 0).when(F.col(label) == "NEUTRAL", 1).when(F.col(label) == "CONTRADICTION", 2).otherwise(3)
    w = Window.partitionBy(*keys).orderBy(rank, position)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rhr(best: DataFrame, label: str = "label") -> DataFrame:
    """total, entailed, neutral, contradicted, skipped (no label), rhr = (neutral + contradicted) / total."""
    is_ = lambda v: F.sum(F.when(F.col(label) == v, 1).otherwise(0)).cast("long")
    total = F.count(label)
    return best.agg(
        total.alias("total"), is_("ENTAILMENT").alias("entailed"), is_("NEUTRAL").alias("neutral"), is_("CONTRADICTION").alias("contradicted"),
        (F.count(F.lit(1)) - total).alias("skipped"), F.try_divide(is_("NEUTRAL") + is_("CONTRADICTION"), total).alias("rhr"),
    )


def haa(verdicts: DataFrame, gold: DataFrame, rhr_value: DataFrame, keys: Sequence[str] = ("event_id", "frame_id", "rule"), order: str = "gold_row") -> DataFrame:
    """scored, unmatched, accuracy, haa = accuracy x (1 - rhr at 4 digits). Of repeated gold keys the last counts."""
    last = gold.groupBy(*keys).agg(F.max_by("gold_verdict", order).alias("gold_verdict"))
    met = verdicts.join(last, list(keys), "left")
    right = F.avg((F.upper(F.trim("verdict")) == F.upper(F.trim("gold_verdict"))).cast("double"))
    acc = met.agg(F.count("gold_verdict").alias("scored"), (F.count(F.lit(1)) - F.count("gold_verdict")).alias("unmatched"), right.alias("accuracy"))
    return acc.crossJoin(rhr_value.select(F.round("rhr", 4).alias("rhr"))).select("scored", "unmatched", "accuracy", (F.col("accuracy") * (1 - F.col("rhr"))).alias("haa"))  # single rows


def hcas_gated(rows: DataFrame, times: str | None = None) -> DataFrame:
    """ila, sla, cla, hcas means of rows with pred struct(irc, section, clause) and gold array of such; deeper levels need the upper.

    ``times``: the column of how often a row counts, where equal ones are put together.
    """
    g = F.col("gold")
    ila = F.exists(g, lambda x: x["irc"].eqNullSafe(F.col("pred.irc")))
    sla = F.exists(g, lambda x: x["irc"].eqNullSafe(F.col("pred.irc")) & x["section"].eqNullSafe(F.col("pred.section")))
    cla = F.exists(g, lambda x: x["irc"].eqNullSafe(F.col("pred.irc")) & x["section"].eqNullSafe(F.col("pred.section")) & x["clause"].eqNullSafe(F.col("pred.clause")))
    n = F.col(times).cast("long") if times else F.lit(1).cast("long")
    s = rows.where(g.isNotNull()).select(ila.cast("int").alias("i"), sla.cast("int").alias("s"), cla.cast("int").alias("c"), n.alias("n"))
    mean = lambda c: F.try_divide(F.sum(c * F.col("n")), F.sum("n"))
    every = F.round((F.col("i") + F.col("s") + F.col("c")) / 3, 4)
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[mean(F.col(x)).alias(name) for x, name in (("i", "ila"), ("s", "sla"), ("c", "cla"))], mean(every).alias("hcas"))


def hcas_flat(rows: DataFrame, weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """The same for one gold id a row (columns pred, gold): each level by itself, both missing is a full match."""
    p, g = parse_clause(F.col("pred")), parse_clause(F.col("gold"))
    none = F.col("pred").isNull() & F.col("gold").isNull()
    d = p["irc"] == g["irc"]
    s = d & (p["section"] == g["section"])
    c = s & p["subclause"].eqNullSafe(g["subclause"])
    hit = lambda x: F.when(none | F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)
    m = rows.select(hit(d).alias("i"), hit(s).alias("s"), hit(c).alias("c"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.avg("i").alias("ila"), F.avg("s").alias("sla"), F.avg("c").alias("cla")).withColumn("hcas", weights[0] * F.col("ila") + weights[1] * F.col("sla") + weights[2] * F.col("cla"))


def relevance(c: Column) -> Column:
    """Null where blank, else whether the text says yes."""
    t = F.trim(c.cast("string"))
    return F.when(F.nullif(t, F.lit("")).isNull(), F.lit(None).cast("boolean")).otherwise(t.isin("1", "true", "True", "yes", "Y", "y"))


def precision_at_k(rows: DataFrame, k: int, query: str = "query_id", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """n_queries, precision: relevant among the first k over k (not over those annotated); queries without annotation do not count."""
    top = rows.where((F.col(rank) <= k) & F.col(relevant).isNotNull())
    per = top.groupBy(query).agg(F.round(F.sum(F.col(relevant).cast("int")) / F.lit(float(k)), 4).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("p").alias("precision"))


def pointer_index(retrieved: Column, cited: Column, presence: Column) -> Column:
    """struct(index, missed, clauses): place of the cited clause among those retrieved, their number where nothing is cited."""
    at = F.array_position(F.transform(retrieved, normalise_clause), normalise_clause(cited)) - 1
    wanted = F.lower(presence) == "yes"
    missed = wanted & (at < 0)
    index = F.when(~wanted | (at < 0), F.size(retrieved)).otherwise(at).cast("int")
    return F.struct(index.alias("index"), missed.alias("missed"), F.when(missed, F.concat(retrieved, F.array(cited))).otherwise(retrieved).alias("clauses"))


def resolve_pointer(weights: Column, clauses: Column, presence: Column) -> Column:
    """struct(clause, confidence, entropy) of pointer probabilities; past the last clause, or without presence, no clause."""
    top = F.array_max(weights)
    at = F.array_position(weights, top).cast("int")
    entropy = -F.aggregate(weights, F.lit(0.0), lambda a, p: a + p * F.log(p + 1e-8))
    clause = F.when((F.lower(presence) == "yes") & (at <= F.size(clauses)), F.try_element_at(clauses, at))
    return F.struct(clause.alias("clause"), top.alias("confidence"), entropy.alias("entropy"))
