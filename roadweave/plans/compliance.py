"""Queries of the citation, answer, classification, label, text and retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.storage import stored
from roadweave.operators import answers, citations, classify, labels, retrieval, review, stemming, textsim
from roadweave.plans.base import registrar
from roadweave.plans.stems_sql import stem_steps
from roadweave.plans.telemetry import _rounded
from roadweave.sources import adapters
from roadweave.sources.adapters import LABELS, TELEMETRY, VERDICTS, table, telemetry

QUERIES, SQL, register = registrar()


def _gold(spark, sf_dir):
    v = adapters.verdicts(spark, sf_dir)
    return citations.gold_clauses(v.where("verdict <> 'UNKNOWN'"))


_GOLD = f"WITH {VERDICTS}, gold AS (SELECT rule, list_sort(list(DISTINCT replace(cited_clause, '-', '_'))) AS clauses FROM verdicts WHERE verdict <> 'UNKNOWN' GROUP BY 1) "
_CHR = "SELECT count(*) AS total, CAST(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) AS BIGINT) AS hallucinated, round(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) / count(*), 9) AS chr "


@register("gold_clauses", _GOLD + "SELECT rule, array_to_string(clauses, ',') AS clauses FROM gold")
def _(spark, sf_dir):
    return _gold(spark, sf_dir).select("rule", F.array_join("clauses", ",").alias("clauses"))


@register("chr_static", _GOLD + _CHR.format(hit="NOT coalesce(list_contains(clauses, cited_clause), false)") + "FROM verdicts LEFT JOIN gold USING (rule) WHERE verdict = 'NON_COMPLIANT'")
def _(spark, sf_dir):
    return _rounded(citations.chr_static(adapters.verdicts(spark, sf_dir), _gold(spark, sf_dir)), 9)


_RETR = f"WITH {VERDICTS}, retr AS (SELECT event_id, list(DISTINCT cited_clause) AS retrieved FROM verdicts WHERE verdict <> 'UNKNOWN' GROUP BY 1) "


@register("chr_event", _RETR + _CHR.format(hit="NOT coalesce(list_contains(retrieved, cited_clause), false)") + "FROM verdicts LEFT JOIN retr USING (event_id) WHERE verdict = 'NON_COMPLIANT'")
def _(spark, sf_dir):
    v = adapters.verdicts(spark, sf_dir)
    retrieved = v.where("verdict <> 'UNKNOWN'").groupBy("event_id").agg(F.collect_set("cited_clause").alias("retrieved"))
    return _rounded(citations.chr_event(v, retrieved), 9)


@register("chr_exists", f"WITH {VERDICTS}, k AS (SELECT DISTINCT cited_clause AS c FROM verdicts WHERE verdict = 'COMPLIANT' AND rule = 'O') " + _CHR.format(hit="c IS NULL") + "FROM verdicts LEFT JOIN k ON cited_clause = c")
def _(spark, sf_dir):
    v = adapters.verdicts(spark, sf_dir)
    return _rounded(citations.chr_exists(v, v.where("verdict = 'COMPLIANT' and rule = 'O'").select(F.col("cited_clause").alias("clause_id"))), 9)


_NLI = f"WITH {VERDICTS}, nli AS (SELECT *, CASE (event_id + frame_id) % 4 WHEN 0 THEN 'ENTAILMENT' WHEN 1 THEN 'NEUTRAL' WHEN 2 THEN 'CONTRADICTION' END AS label FROM verdicts), "
_BEST = _NLI + "b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE label WHEN 'ENTAILMENT' THEN 0 WHEN 'NEUTRAL' THEN 1 WHEN 'CONTRADICTION' THEN 2 ELSE 3 END, frame_id) AS r FROM nli), best AS (SELECT * FROM b WHERE r = 1), "
_RHR = "rr AS (SELECT count(label) AS total, count(*) FILTER (label = 'ENTAILMENT') AS entailed, count(*) FILTER (label = 'NEUTRAL') AS neutral, count(*) FILTER (label = 'CONTRADICTION') AS contradicted, count(*) - count(label) AS skipped, count(*) FILTER (label IN ('NEUTRAL', 'CONTRADICTION')) / count(label) AS rhr FROM best) "


def _best(spark, sf_dir):
    v = adapters.verdicts(spark, sf_dir)
    name = F.element_at(F.array(F.lit("ENTAILMENT"), F.lit("NEUTRAL"), F.lit("CONTRADICTION"), F.lit(None).cast("string")), ((F.col("event_id") + F.col("frame_id")) % 4 + 1).cast("int"))
    return citations.best_labels(v.withColumn("label", name), ["event_id"], position="frame_id")


@register("rhr", _BEST + _RHR + "SELECT total, entailed, neutral, contradicted, skipped, round(rhr, 9) AS rhr FROM rr")
def _(spark, sf_dir):
    return _rounded(citations.rhr(_best(spark, sf_dir)), 9)


@register(
    "haa",
    _BEST + _RHR.rstrip() + ", g AS (SELECT event_id, frame_id, rule, max(verdict) AS gold_verdict FROM verdicts WHERE rule = 'F' GROUP BY 1, 2, 3), m AS (SELECT v.verdict, CASE WHEN v.frame_id % 5 = 0 THEN 'COMPLIANT' ELSE v.verdict END AS pred, gold_verdict FROM verdicts v LEFT JOIN g USING (event_id, frame_id, rule)), "
    "a AS (SELECT count(gold_verdict) AS scored, count(*) - count(gold_verdict) AS unmatched, avg(CASE WHEN gold_verdict IS NOT NULL THEN CASE WHEN pred = gold_verdict THEN 1.0 ELSE 0.0 END END) AS accuracy FROM m) "
    "SELECT scored, unmatched, round(accuracy, 9) AS accuracy, round(accuracy * (1 - round(rhr, 4)), 9) AS haa FROM a, rr",
)
def _(spark, sf_dir):
    v = adapters.verdicts(spark, sf_dir)
    gold = v.where("rule = 'F'").select("event_id", "frame_id", "rule", F.col("verdict").alias("gold_verdict"), F.col("verdict").alias("gold_row"))
    pred = v.withColumn("verdict", F.when(F.col("frame_id") % 5 == 0, "COMPLIANT").otherwise(F.col("verdict")))
    return _rounded(citations.haa(pred, gold, citations.rhr(_best(spark, sf_dir))), 9)


@register(
    "hcas_gated",
    _GOLD.rstrip() + ", ge AS (SELECT rule, list(DISTINCT [split_part(cited_clause, '_', 1), split_part(split_part(cited_clause, '_', 2), '.', 1), split_part(cited_clause, '_', 2)]) AS g FROM verdicts WHERE verdict = 'COMPLIANT' GROUP BY 1), "
    "p AS (SELECT split_part(cited_clause, '_', 1) AS i, split_part(split_part(cited_clause, '_', 2), '.', 1) AS s, split_part(cited_clause, '_', 2) AS c, g FROM verdicts JOIN ge USING (rule)), "
    "q AS (SELECT CASE WHEN len(list_filter(g, lambda x: x[1] = i)) > 0 THEN 1 ELSE 0 END AS a, CASE WHEN len(list_filter(g, lambda x: x[1] = i AND x[2] = s)) > 0 THEN 1 ELSE 0 END AS b, CASE WHEN len(list_filter(g, lambda x: x[1] = i AND x[2] = s AND x[3] = c)) > 0 THEN 1 ELSE 0 END AS d FROM p) "
    "SELECT count(*) AS n, round(avg(a), 9) AS ila, round(avg(b), 9) AS sla, round(avg(d), 9) AS cla, round(avg(round((a + b + d) / 3, 4)), 9) AS hcas FROM q",
)
def _(spark, sf_dir):
    """Each distinct citation of a rule is compared once, with the number of its rows: there are two rules."""
    v = adapters.verdicts(spark, sf_dir).groupBy("rule", "cited_clause").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("verdict") == "COMPLIANT").alias("compliant"))
    cited = v.select("rule", citations.parse_combined(F.translate("cited_clause", "_", "/")).alias("pred"), "n", "compliant")
    gold = cited.where("compliant").groupBy("rule").agg(F.collect_set("pred").alias("gold"))
    return _rounded(citations.hcas_gated(cited.join(gold, "rule"), "n"), 9)


@register(
    "hcas_flat",
    f"WITH {VERDICTS}, p AS (SELECT cited_clause AS a, lead(cited_clause) OVER (PARTITION BY event_id ORDER BY frame_id, cited_clause) AS b FROM verdicts), q AS (SELECT split_part(split_part(a, '_', 2), '.', 1) AS s1, split_part(a, '.', 2) AS c1, split_part(split_part(b, '_', 2), '.', 1) AS s2, split_part(b, '.', 2) AS c2, b IS NOT NULL AS h FROM p) "
    "SELECT count(*) AS n, round(avg(CASE WHEN h THEN 1.0 ELSE 0 END), 9) AS ila, round(avg(CASE WHEN h AND s1 = s2 THEN 1.0 ELSE 0 END), 9) AS sla, round(avg(CASE WHEN h AND s1 = s2 AND c1 = c2 THEN 1.0 ELSE 0 END), 9) AS cla, "
    "round((avg(CASE WHEN h THEN 1.0 ELSE 0 END) + avg(CASE WHEN h AND s1 = s2 THEN 1.0 ELSE 0 END) + avg(CASE WHEN h AND s1 = s2 AND c1 = c2 THEN 1.0 ELSE 0 END)) / 3, 9) AS hcas FROM q",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    v = adapters.verdicts(spark, sf_dir)
    gold = F.lead("cited_clause").over(Window.partitionBy("event_id").orderBy("frame_id", "cited_clause"))
    return _rounded(citations.hcas_flat(v.select(F.col("cited_clause").alias("pred"), gold.alias("gold"))), 9)


_CLAUSE_TEXT = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'IRC35_' || (doc_id % 9) || '.' || (doc_id % 7) WHEN 1 THEN 'IRC-67-' || (doc_id % 11) WHEN 2 THEN 'a' || doc_id || '; b , c;' || n_chars WHEN 3 THEN ' x' || doc_id || ' | y|' ELSE 'IRC 35 / ' || (doc_id % 9) || '.2.' || (doc_id % 3) END AS c FROM documents"


def _clause_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = lambda m: (F.col("doc_id") % m).cast("string")
    s = F.col("doc_id").cast("string")
    c = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("IRC35_"), i(9), F.lit("."), i(7))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("IRC-67-"), i(11)))
    c = c.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("a"), s, F.lit("; b , c;"), F.col("n_chars").cast("string"))).when(F.col("doc_id") % 5 == 3, F.concat(F.lit(" x"), s, F.lit(" | y|")))
    return d.select("doc_id", c.otherwise(F.concat(F.lit("IRC 35 / "), i(9), F.lit(".2."), i(3))).alias("c"))


@register(
    "clause_parts",
    f"WITH t AS ({_CLAUSE_TEXT}) SELECT doc_id, nullif(regexp_extract(c, '(?i)^IRC[-_]?(\\d+)[-_](\\d+)(?:\\.(\\d+))?', 1), '') AS irc, nullif(regexp_extract(c, '(?i)^IRC[-_]?(\\d+)[-_](\\d+)(?:\\.(\\d+))?', 2), '') AS section, nullif(regexp_extract(c, '(?i)^IRC[-_]?(\\d+)[-_](\\d+)(?:\\.(\\d+))?', 3), '') AS subclause, "
    "replace(c, '-', '_') AS normal, array_to_string(list_filter(list_transform(CASE WHEN contains(c, ',') THEN string_split(c, ',') WHEN contains(c, ';') THEN string_split(c, ';') WHEN contains(c, '|') THEN string_split(c, '|') WHEN contains(c, '/') THEN string_split(c, '/') ELSE [c] END, lambda x: trim(x)), lambda x: x <> ''), '~') AS ids FROM t",
)
def _(spark, sf_dir):
    c = F.col("c")
    p = citations.parse_clause(c)
    return _clause_text(spark, sf_dir).select("doc_id", p["irc"].alias("irc"), p["section"].alias("section"), p["subclause"].alias("subclause"), citations.normalise_clause(c).alias("normal"), F.array_join(citations.split_citations(c), "~").alias("ids"))


_ANSWER = (
    "ans AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{\"label\": \"' || o_orderstatus || '\", \"confidence\": 0.5}' WHEN 1 THEN 'Sure: {\"label\": \"' || o_orderstatus || '\"} ok' WHEN 2 THEN '```json\n{\"label\": \"' || o_orderpriority || '\"}\n```' WHEN 3 THEN 'Yes, it is ' || o_orderstatus ELSE '{\"label\": ' END AS t FROM orders)"
)


def answers_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, s = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    t = F.when(k == 0, F.concat(F.lit('{"label": "'), s, F.lit('", "confidence": 0.5}'))).when(k == 1, F.concat(F.lit('Sure: {"label": "'), s, F.lit('"} ok')))
    t = t.when(k == 2, F.concat(F.lit('```json\n{"label": "'), F.col("o_orderpriority"), F.lit('"}\n```'))).when(k == 3, F.concat(F.lit("Yes, it is "), s)).otherwise('{"label": ')
    return o.select("o_orderkey", t.alias("t"))


@register(
    "parse_answers",
    f"WITH {_ANSWER}, b AS (SELECT *, regexp_extract(t, '(?s)\\{{.*\\}}', 0) AS blk FROM ans) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN t WHEN o_orderkey % 5 IN (1, 2) THEN blk END AS object, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN json_extract_string(blk, '$.label') END AS label, CASE WHEN o_orderkey % 5 = 3 THEN true END AS yes FROM b",
)
def _(spark, sf_dir):
    o = answers.fenced_object_text(F.col("t"))
    return answers_text(spark, sf_dir).select("o_orderkey", answers.object_text(F.col("t")).alias("object"), F.get_json_object(o, "$.label").alias("label"), answers.yes_no(F.col("t")).alias("yes"))



_FOLDS = (
    "fo AS (SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 6 WHEN 5 THEN 'no json here' WHEN 4 THEN '{\"environment\": {\"presence\": \"Yes\", \"severity\": \"low\", \"reasoning\": \"a\"}, \"infrastructure\": {}}' ELSE "
    "'{\"environment\": {\"presence\": \"yes\", \"severity\": \"low\", \"reasoning\": \"a\"}, \"road_surface\": {\"presence\": \"' || CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'A' THEN 'No' ELSE 'maybe' END || '\", ' || CASE WHEN l_linenumber = 2 THEN '' ELSE '\"severity\": \"High\", ' END || '\"reasoning\": \"b\"}, "
    "\"infrastructure\": {\"presence\": \"No\", \"severity\": \"medium\", \"reasoning\": \"c\"}}' END AS t FROM lineitem)"
)


def fold_answers(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    presence = F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", "No").otherwise("maybe")
    body = F.concat(
        F.lit('{"environment": {"presence": "yes", "severity": "low", "reasoning": "a"}, "road_surface": {"presence": "'), presence, F.lit('", '),
        F.when(F.col("l_linenumber") == 2, "").otherwise('"severity": "High", '), F.lit('"reasoning": "b"}, "infrastructure": {"presence": "No", "severity": "medium", "reasoning": "c"}}'),
    )
    t = F.when(k == 5, "no json here").when(k == 4, '{"environment": {"presence": "Yes", "severity": "low", "reasoning": "a"}, "infrastructure": {}}').otherwise(body)
    return line.select("l_orderkey", "l_linenumber", t.alias("t"))


_FAIL = "CASE WHEN (l_orderkey + l_linenumber) % 6 = 5 THEN 'parse_error' WHEN (l_orderkey + l_linenumber) % 6 = 4 THEN 'missing_fold:road_surface' WHEN l_linenumber = 2 THEN 'missing_key:road_surface.severity' WHEN t LIKE '%maybe%' THEN 'invalid_presence:road_surface' END"


@register("validate_folds", f"WITH {_FOLDS}, r AS (SELECT {_FAIL} AS reason FROM fo) SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM r GROUP BY 1")
def _(spark, sf_dir):
    """Equal answers are validated once."""
    each = fold_answers(spark, sf_dir).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(F.coalesce(answers.fold_failure(F.col("t")), F.lit("ok")).alias("reason")).agg(F.sum("c").alias("n"))


@register(
    "fold_tables",
    f"WITH {_FOLDS}, v AS (SELECT *, unnest(['environment', 'road_surface', 'infrastructure']) AS fold FROM fo WHERE {_FAIL} IS NULL) SELECT l_orderkey, fold, CASE WHEN fold = 'environment' OR (fold = 'road_surface' AND t LIKE '%\"presence\": \"Yes\"%') THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS verdict, "
    "CASE fold WHEN 'environment' THEN 1 WHEN 'road_surface' THEN 3 ELSE 2 END AS severity_level FROM v",
)
def _(spark, sf_dir):
    """Equal answers are parsed once; their rows take what was found."""
    rows = fold_answers(spark, sf_dir)
    once = stored(rows.select("t").distinct(), "answers")  # stored, else the filter of valid ones moves below ``distinct``
    found = stored(answers.fold_rows(once, "t", "t").select("t", "fold", "verdict", "severity_level"), "fold-answers")
    return rows.join(found, "t").select("l_orderkey", "fold", "verdict", "severity_level")


_CLS = (
    f"WITH {LABELS}, g AS (SELECT model, gold AS label, count(*) AS n_gold, count(*) FILTER (pred = gold) AS tp FROM labelled GROUP BY 1, 2), p AS (SELECT model, pred AS label, count(*) AS n_pred FROM labelled GROUP BY 1, 2), "
    "c AS (SELECT model, label, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold FROM g FULL JOIN p USING (model, label)), "
    "m AS (SELECT *, coalesce(tp / nullif(n_pred, 0), 0) AS precision, coalesce(tp / nullif(n_gold, 0), 0) AS recall FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m) "
)


@register("clf_per_class", _CLS + "SELECT model, label, tp, n_pred, n_gold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def _(spark, sf_dir):
    return _rounded(classify.per_class(adapters.labels(spark, sf_dir), by=["model"]), 9)


@register(
    "clf_summary",
    _CLS + ", s AS (SELECT model, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(precision * n_gold) / sum(n_gold) AS wp, sum(recall * n_gold) / sum(n_gold) AS wr, sum(f1 * n_gold) / sum(n_gold) AS wf FROM f GROUP BY 1), a AS (SELECT model, count(*) AS n, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END) AS acc FROM labelled GROUP BY 1) "
    "SELECT model, n, round(acc, 9) AS accuracy, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1, round(wp, 9) AS weighted_precision, round(wr, 9) AS weighted_recall, round(wf, 9) AS weighted_f1 FROM a JOIN s USING (model)",
)
def _(spark, sf_dir):
    return _rounded(classify.summary(adapters.labels(spark, sf_dir), by=["model"]), 9)


@register(
    "binary_prf",
    f"WITH {LABELS}, t AS (SELECT model, count(*) FILTER (pred = 'F' AND gold = 'F') AS tp, count(*) FILTER (pred = 'F' AND gold <> 'F') AS fp, count(*) FILTER (pred <> 'F' AND gold = 'F') AS fn, count(*) FILTER (pred <> 'F' AND gold <> 'F') AS tn FROM labelled GROUP BY 1) "
    "SELECT model, tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM t",
)
def _(spark, sf_dir):
    return _rounded(classify.binary(adapters.labels(spark, sf_dir), F.col("pred") == "F", F.col("gold") == "F", ["model"]), 9)


_MARGIN = f"WITH {LABELS}, n AS (SELECT model, count(*) AS n, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END) AS po FROM labelled GROUP BY 1), a AS (SELECT model, pred AS l, count(*) AS ca FROM labelled GROUP BY 1, 2), b AS (SELECT model, gold AS l, count(*) AS cb FROM labelled GROUP BY 1, 2), pe AS (SELECT a.model, sum(ca / n * (cb / n)) AS pe FROM a JOIN b ON a.model = b.model AND a.l = b.l JOIN n ON n.model = a.model GROUP BY 1) "


@register("kappa", _MARGIN + "SELECT model, n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM n JOIN pe USING (model)")
def _(spark, sf_dir):
    return _rounded(review.kappa(adapters.labels(spark, sf_dir), "pred", "gold", ["model"]), 9)


@register("agreement", f"WITH {LABELS} SELECT model, count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END), 9) AS agreement FROM labelled GROUP BY 1")
def _(spark, sf_dir):
    return _rounded(classify.agreement(adapters.labels(spark, sf_dir), "pred", "gold", ["model"]), 9)


@register("verdict_distribution", f"WITH {VERDICTS} SELECT rule, verdict AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY rule), 9) AS share FROM verdicts GROUP BY 1, 2")
def _(spark, sf_dir):
    return _rounded(classify.distribution(adapters.verdicts(spark, sf_dir), "verdict", ["rule"]), 9)


@register(
    "model_pairs",
    "WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem) SELECT CAST(a.l_linenumber AS BIGINT) AS model_a, CAST(b.l_linenumber AS BIGINT) AS model_b, count(*) AS n, count(*) FILTER (a.l_returnflag = b.l_returnflag) AS same FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1, 2",
)
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    pairs = classify.model_pairs(line, ["l_orderkey"], "l_linenumber", "l_returnflag")
    return pairs.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("same"))


_KEYED = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS clip_id, o_totalprice / 1000 AS start_time, o_totalprice / 1000 + 1 AS end_time, o_orderstatus AS s FROM orders"


@register(
    "rescore_by_key",
    f"WITH r AS ({_KEYED}), t AS (SELECT clip_id, CAST(round(start_time * 1000) AS BIGINT) AS a, CAST(round(end_time * 1000) AS BIGINT) AS b, arg_max(s, o_orderkey) AS true_label FROM r WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2, 3) "
    "SELECT o_orderkey, true_label, true_label IS NOT NULL AS matched FROM r LEFT JOIN t ON r.clip_id = t.clip_id AND CAST(round(start_time * 1000) AS BIGINT) = a AND CAST(round(end_time * 1000) AS BIGINT) = b",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("clip_id"), (F.col("o_totalprice") / 1000).alias("start_time"), (F.col("o_totalprice") / 1000 + 1).alias("end_time"), F.col("o_orderstatus").alias("true_label"))
    return classify.rescored(o, o.where("o_orderkey % 3 <> 0"), "o_orderkey").select("o_orderkey", "true_label", "matched")


@register(
    "category_ranges",
    "WITH c AS (SELECT unnest(['Brand#11', 'Brand#22', 'Brand#33', 'none']) AS p_brand) SELECT p_brand, coalesce(n, 0) AS n, a AS min_p_size, b AS max_p_size FROM c LEFT JOIN (SELECT p_brand, count(*) AS n, min(p_size) AS a, max(p_size) AS b FROM part GROUP BY 1) USING (p_brand)",
)
def _(spark, sf_dir):
    return classify.category_ranges(table(spark, sf_dir, "part"), ["Brand#11", "Brand#22", "Brand#33", "none"], "p_brand", ["p_size"])


@register("without_rare", "WITH r AS (SELECT c_mktsegment || (c_custkey % 700) AS label, c_custkey FROM customer) SELECT c_custkey FROM r WHERE label IN (SELECT label FROM r GROUP BY 1 HAVING count(*) >= 2)")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", (F.col("c_custkey") % 700).cast("string")).alias("label"))
    return classify.without_rare(c, "label").select("c_custkey")


_NOTE = "CASE doc_id % 8 WHEN 0 THEN 'Hard BRAKING near lane' WHEN 1 THEN 'Sensor noise' WHEN 2 THEN 'near-miss' WHEN 3 THEN 'avoid dog' WHEN 4 THEN 'sharp turn' WHEN 5 THEN 'accelerated' WHEN 6 THEN 'changed lane' ELSE text END"


@register(
    "note_category",
    f"WITH n AS (SELECT doc_id, lower({_NOTE}) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'camera vibration') OR contains(t, 'sensor noise') OR contains(t, 'no visible change') THEN 'likely_noise' WHEN contains(t, 'brak') OR contains(t, 'decelerat') OR contains(t, 'slowing') OR contains(t, 'slow down') OR contains(t, 'stopp') THEN 'braking_deceleration' "
    "WHEN contains(t, 'near miss') OR contains(t, 'near-miss') OR contains(t, 'collision') OR contains(t, 'hazard') THEN 'near_miss' WHEN contains(t, 'swerv') OR contains(t, 'avoid') THEN 'emergency_swerve' WHEN contains(t, 'sharp turn') THEN 'sharp_turn' WHEN contains(t, 'accelerat') THEN 'acceleration' WHEN contains(t, 'lane') THEN 'lane_change' ELSE 'other' END AS category FROM n",
)
def _(spark, sf_dir):
    names = F.array(*map(F.lit, ("Hard BRAKING near lane", "Sensor noise", "near-miss", "avoid dog", "sharp turn", "accelerated", "changed lane")))
    note = F.coalesce(F.try_element_at(names, (F.col("doc_id") % 8 + 1).cast("int")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", labels.by_words(note).alias("category"))


@register("peak_label", f"WITH {TELEMETRY} SELECT event_id, CASE WHEN ax / 100 > 2.5 AND ay / 20 > 2 THEN 'braking' WHEN ax / 100 > 1.2 THEN 'deceleration' WHEN ax / 100 < -1.5 THEN 'acceleration' END AS label FROM tele")
def _(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", labels.peak_label(F.col("ax") / 100, F.col("ay") / 20).alias("label"))


@register(
    "frame_grouping",
    f"WITH {TELEMETRY}, r AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY cts) AS frame, user_id, nullif(clip_id, 'error') AS action, az FROM tele), n AS (SELECT * FROM r WHERE action IS NOT NULL), "
    "c AS (SELECT *, CASE WHEN lag(action) OVER w = action AND frame - lag(frame) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY user_id ORDER BY frame)), g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY frame) AS INTEGER) AS group_no FROM c) "
    "SELECT user_id, group_no, any_value(action) AS action, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, round(max(abs(az)), 9) AS max_az FROM g GROUP BY user_id, group_no",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    t = telemetry(spark, sf_dir)
    rows = t.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("cts")).cast("long").alias("frame"), F.nullif("clip_id", F.lit("error")).alias("action"), "az")
    return _rounded(labels.event_groups(rows, gap=2, keys=["user_id"], values=["az"]).drop("mean_az"), 9)


_HASH = "md5('42|' || c_custkey)"


@register("stratified_split", f"WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_HASH}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.15)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM r")
def _(spark, sf_dir):
    return labels.stratified_split(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 0.15).select("c_custkey", "split")


@register("oversample", "SELECT c_custkey, CAST(unnest(range(1, CASE WHEN c_custkey % 11 = 0 THEN 26 ELSE 2 END)) AS INTEGER) AS copy FROM customer")
def _(spark, sf_dir):
    return labels.oversampled(table(spark, sf_dir, "customer"), F.col("c_custkey") % 11 == 0, 25).select("c_custkey", "copy")


@register(
    "balance",
    f"WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), m AS (SELECT max(n) AS m FROM n), r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_HASH}, c_custkey) AS r FROM customer) SELECT c_custkey, m // n + CASE WHEN r <= m % n THEN 1 ELSE 0 END AS times FROM r JOIN n USING (c_nationkey), m",
)
def _(spark, sf_dir):
    b = labels.balanced(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")
    return b.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("times"))


@register("inverse_weights", "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_custkey, round(1 / n, 9) AS weight FROM customer JOIN n USING (c_nationkey)")
def _(spark, sf_dir):
    return _rounded(labels.inverse_weights(table(spark, sf_dir, "customer"), "c_nationkey").select("c_custkey", "weight"), 9)


@register("event_selection", f"WITH {TELEMETRY}, r AS (SELECT event_id, clip_id, ax + abs(az / 1000) AS s, row_number() OVER (PARTITION BY clip_id ORDER BY ax + abs(az / 1000) DESC, event_id) AS r FROM tele) SELECT event_id, clip_id FROM (SELECT * FROM r WHERE r <= 8 ORDER BY s DESC, event_id LIMIT 30)")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return labels.top_per_category(t, "clip_id", F.col("ax") + F.abs(F.col("az") / 1000), "event_id").select("event_id", "clip_id")


def pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    return a.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "candidate", "reference")


_PAIRS = "prs AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS candidate, u.text AS reference FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"
_GRAMS = (
    f"WITH {_PAIRS}, s AS (SELECT id, 'c' AS side, regexp_split_to_array(lower(trim(candidate)), '\\s+') AS w FROM prs UNION ALL SELECT id, 'r', regexp_split_to_array(lower(trim(reference)), '\\s+') FROM prs), "
    "ix AS (SELECT id, side, w, len(w) AS words, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM s, (SELECT unnest([1, 2, 3, 4]) AS n)), "
    "k AS (SELECT id, side, words, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS c FROM ix GROUP BY ALL), "
)


def _cider_sql(simple: bool) -> str:
    docs = "WHERE side = 'r'" if simple else ""
    total = "(SELECT count(*) FROM prs)" if simple else "(SELECT 2 * count(*) FROM prs)"
    idf = "ln(tot / (coalesce(df, 0) + 1))" if simple else "ln(greatest(1.0, tot / greatest(coalesce(df, 1), 1)))"
    idf = f"CASE WHEN df IS NULL THEN 0 ELSE {idf} END" if simple else idf
    tf = "c / greatest(1, words - n + 1)" if simple else "c / greatest(1, words)"
    return (
        _GRAMS + f"d AS (SELECT n, gram, count(*) AS df FROM k {docs} GROUP BY 1, 2), t AS (SELECT CAST({total} AS DOUBLE) AS tot), v AS (SELECT id, side, n, gram, {tf} * {idf} AS v FROM k LEFT JOIN d USING (n, gram), t), "
        "p AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y FROM (SELECT * FROM v WHERE side = 'c') a FULL JOIN (SELECT * FROM v WHERE side = 'r') b ON a.id = b.id AND a.n = b.n AND a.gram = b.gram), "
        "q AS (SELECT id, n, coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0) AS cs FROM p GROUP BY 1, 2), l AS (SELECT id, max(CASE WHEN side = 'c' THEN len(w) END) - max(CASE WHEN side = 'r' THEN len(w) END) AS dl FROM s GROUP BY 1) "
        + ("SELECT id, round(sum(cs) / 4, 9) AS cider FROM q GROUP BY 1" if simple else "SELECT id, round(sum(cs) / 4 * exp(-any_value(dl) * any_value(dl) / 72.0) * 10, 9) AS cider FROM q JOIN l USING (id) GROUP BY 1")
    )


@register("cider_d", _cider_sql(False))
def _(spark, sf_dir):
    return _rounded(textsim.cider(pairs(spark, sf_dir), "id", "d"), 9)


@register(
    "cider_clipped",
    _GRAMS + "d AS (SELECT n, gram, count(*) AS df FROM k WHERE side = 'r' GROUP BY 1, 2), t AS (SELECT CAST((SELECT count(*) FROM prs) AS DOUBLE) AS tot), v AS (SELECT id, side, n, gram, c / greatest(1, words) * ln(greatest(1.0, tot / greatest(coalesce(df, 1), 1))) AS v FROM k LEFT JOIN d USING (n, gram), t), "
    "p AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y FROM (SELECT * FROM v WHERE side = 'c') a FULL JOIN (SELECT * FROM v WHERE side = 'r') b ON a.id = b.id AND a.n = b.n AND a.gram = b.gram), "
    "q AS (SELECT id, n, coalesce(sum(least(x, y) * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0) AS cs FROM p GROUP BY 1, 2), l AS (SELECT id, max(CASE WHEN side = 'c' THEN len(w) END) - max(CASE WHEN side = 'r' THEN len(w) END) AS dl FROM s GROUP BY 1) SELECT id, round(sum(cs) / 4 * exp(-any_value(dl) * any_value(dl) / 72.0) * 10, 9) AS cider FROM q JOIN l USING (id) GROUP BY 1",
)
def _(spark, sf_dir):
    return _rounded(textsim.cider(pairs(spark, sf_dir), "id", "clipped"), 9)


@register("cider_simple", _cider_sql(True))
def _(spark, sf_dir):
    return _rounded(textsim.cider(pairs(spark, sf_dir), "id", "simple"), 9)


_MATCH = (
    _GRAMS + "mm AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, sum(least(coalesce(a.c, 0), coalesce(b.c, 0))) AS m, coalesce(sum(a.c), 0) AS t FROM (SELECT * FROM k WHERE side = 'c') a FULL JOIN (SELECT * FROM k WHERE side = 'r') b ON a.id = b.id AND a.n = b.n AND a.gram = b.gram GROUP BY 1, 2), "
    "l AS (SELECT id, max(CASE WHEN side = 'c' THEN len(w) END) AS cw, max(CASE WHEN side = 'r' THEN len(w) END) AS rw FROM s GROUP BY 1), "
)


@register(
    "sentence_bleu",
    _MATCH + "f AS (SELECT id, ns.n, coalesce(m, 0) AS m, coalesce(t, 0) AS t FROM (SELECT id, unnest([1, 2, 3, 4]) AS n FROM l) ns LEFT JOIN mm USING (id, n)), g AS (SELECT id, sum(ln(CASE WHEN m = 0 THEN 0.1 ELSE m END / greatest(t, 1))) / 4 AS lg, max(CASE WHEN n = 1 THEN m END) AS m1 FROM f GROUP BY 1) "
    "SELECT id, round(CASE WHEN m1 = 0 THEN 0 ELSE CASE WHEN cw > rw THEN 1 ELSE exp(1 - rw / cw) END * exp(lg) END, 9) AS bleu FROM g JOIN l USING (id)",
)
def _(spark, sf_dir):
    return _rounded(textsim.sentence_bleu(pairs(spark, sf_dir)), 9)


@register(
    "corpus_bleu",
    _MATCH + "f AS (SELECT n, CAST(sum(m) AS DOUBLE) AS m, CAST(sum(t) AS DOUBLE) AS t FROM mm GROUP BY 1), w AS (SELECT sum(cw) AS cw, sum(rw) AS rw FROM l), b AS (SELECT CASE WHEN cw > rw THEN 1 ELSE exp(1 - rw / cw) END AS bp FROM w) "
    "SELECT round(bp * exp((SELECT sum(ln(m / t)) FROM f WHERE n <= 1)), 9) AS bleu1, round(bp * exp((SELECT sum(ln(m / t)) / 2 FROM f WHERE n <= 2)), 9) AS bleu2, round(bp * exp((SELECT sum(ln(CASE WHEN m = 0 THEN 0.1 ELSE m END / t)) / 4 FROM f)), 9) AS bleu4 FROM b",
)
def _(spark, sf_dir):
    return _rounded(textsim.corpus_bleu(pairs(spark, sf_dir)), 9)


# Words, their stems by position, then the table of common subsequences: a row is the running maximum of its candidates, one more than the
# cell before where words agree, else the cell above.
_STEMMED = (
    "wds AS (SELECT id, list_filter(regexp_split_to_array(lower(candidate), '[^a-z0-9]+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(lower(reference), '[^a-z0-9]+'), lambda w: w <> '') AS b FROM prs), "
    "each AS (SELECT id, 'a' AS side, unnest(a) AS word, generate_subscripts(a, 1) AS place FROM wds UNION ALL SELECT id, 'b', unnest(b), generate_subscripts(b, 1) FROM wds), "
    + stem_steps("each")
    + ", sides AS (SELECT id, side, list(coalesce(stem, word) ORDER BY place) AS ws FROM each LEFT JOIN stems USING (word) GROUP BY 1, 2), "
    "t AS (SELECT p.id, coalesce(a.ws, []) AS a, coalesce(b.ws, []) AS b FROM wds p LEFT JOIN sides a ON a.id = p.id AND a.side = 'a' LEFT JOIN sides b ON b.id = p.id AND b.side = 'b'), "
)
_LCS_TABLE = (
    "dp(id, i, row) AS (SELECT id, 0, list_transform(b, lambda w: 0) FROM t UNION ALL SELECT d.id, d.i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda x: CASE WHEN b[x] = a[d.i + 1] THEN CASE WHEN x > 1 THEN d.row[x - 1] ELSE 0 END + 1 ELSE d.row[x] END))) FROM dp d JOIN t USING (id) WHERE d.i < len(a)), "
    "lcs AS (SELECT t.id, len(a) AS na, len(b) AS nb, coalesce(row[len(b)], 0) AS l FROM t JOIN dp ON dp.id = t.id AND dp.i = len(a)), "
    "rl AS (SELECT id, CASE WHEN l = 0 THEN 0 ELSE 2.0 * l / (na + nb) END AS rouge_l FROM lcs)"
)


@register("rouge_l", f"WITH RECURSIVE {_PAIRS}, {_STEMMED}{_LCS_TABLE} SELECT id, round(rouge_l, 9) AS rouge_l FROM rl")
def _(spark, sf_dir):
    return _rounded(textsim.rouge_l(pairs(spark, sf_dir)), 9)


@register("word_stems", f"WITH each AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS word FROM documents), {stem_steps('each', least=3)} SELECT word, stem FROM stems")
def _(spark, sf_dir):
    """The stem of each distinct word of all documents."""
    words = F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")
    once = table(spark, sf_dir, "documents").select(words).where(F.length("word") >= 3).distinct()
    return once.select("word", stemming.stems(F.array("word"), least=3)[0].alias("stem"))


_REPORT = (
    _GRAMS.replace("WITH prs AS (SELECT", "WITH RECURSIVE prs AS (SELECT a.conv_id % 3 AS fold,", 1) + _STEMMED + _LCS_TABLE + ", "
    + "mm AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, sum(least(coalesce(a.c, 0), coalesce(b.c, 0))) AS m, coalesce(sum(a.c), 0) AS t FROM (SELECT * FROM k WHERE side = 'c') a FULL JOIN (SELECT * FROM k WHERE side = 'r') b ON a.id = b.id AND a.n = b.n AND a.gram = b.gram GROUP BY 1, 2), "
    "l AS (SELECT id, max(CASE WHEN side = 'c' THEN len(w) END) AS cw, max(CASE WHEN side = 'r' THEN len(w) END) AS rw FROM s GROUP BY 1), f AS (SELECT id, ns.n, coalesce(m, 0) AS m, coalesce(t, 0) AS t FROM (SELECT id, unnest([1, 2, 3, 4]) AS n FROM l) ns LEFT JOIN mm USING (id, n)), "
    "g AS (SELECT id, sum(ln(CASE WHEN m = 0 THEN 0.1 ELSE m END / greatest(t, 1))) / 4 AS lg, max(CASE WHEN n = 1 THEN m END) AS m1 FROM f GROUP BY 1), bl AS (SELECT id, CASE WHEN m1 = 0 THEN 0 ELSE CASE WHEN cw > rw THEN 1 ELSE exp(1 - rw / cw) END * exp(lg) END AS bleu FROM g JOIN l USING (id)), "
    "kf AS (SELECT k.*, fold FROM k JOIN prs USING (id)), df AS (SELECT fold, n, gram, count(*) AS df FROM kf GROUP BY 1, 2, 3), tt AS (SELECT fold, 2.0 * count(*) AS tot FROM prs GROUP BY 1), v AS (SELECT id, side, n, gram, c / greatest(1, words) * ln(greatest(1.0, tot / df)) AS v FROM kf JOIN df USING (fold, n, gram) JOIN tt USING (fold)), "
    "p AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y FROM (SELECT * FROM v WHERE side = 'c') a FULL JOIN (SELECT * FROM v WHERE side = 'r') b ON a.id = b.id AND a.n = b.n AND a.gram = b.gram), "
    "q AS (SELECT id, n, coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0) AS cs FROM p GROUP BY 1, 2), ci AS (SELECT id, sum(cs) / 4 * exp(-any_value((cw - rw) * (cw - rw)) / 72.0) * 10 AS cider FROM q JOIN l USING (id) GROUP BY 1), "
    "rows_ AS (SELECT id, fold, CASE id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unclear' END AS gold, CASE id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unclear' END AS pred FROM prs), "
    "lb AS (SELECT fold, x AS lab FROM (SELECT DISTINCT fold FROM prs), (SELECT unnest(['Yes', 'No', 'Unclear']) AS x)), fc AS (SELECT lb.fold, lab, count(*) FILTER (gold = lab AND pred = lab) AS tp, count(*) FILTER (pred = lab) AS np, count(*) FILTER (gold = lab) AS ng FROM lb JOIN rows_ USING (fold) GROUP BY 1, 2), "
    "mf AS (SELECT fold, avg(coalesce(2.0 * tp / nullif(np + ng, 0), 0)) AS f FROM fc GROUP BY 1) "
    "SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n_scored, count(bleu) AS n_pairs, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END), 4) AS accuracy, round(any_value(f), 4) AS macro_f1, round(avg(bleu), 4) AS bleu, round(avg(rouge_l), 4) AS rouge_l, round(avg(cider), 4) AS cider FROM rows_ LEFT JOIN bl USING (id) LEFT JOIN rl USING (id) LEFT JOIN ci USING (id) JOIN mf USING (fold) GROUP BY 1"
)


@register("evaluation_report", _REPORT)
def _(spark, sf_dir):
    """Scores by fold: labels and texts together."""
    say = lambda m: F.when(F.col("id") % m == 0, "Yes").when(F.col("id") % m == 1, "No").otherwise("Unclear")
    rows = pairs(spark, sf_dir).withColumns({"fold": F.floor(F.col("id") / 1000) % 3, "gold": say(4), "pred": say(5)})
    return textsim.report(rows, ["fold"], "id", ["Yes", "No", "Unclear"])


_KNN = (
    "WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS clause_id, label % 2 AS doc, embedding AS cv FROM embeddings WHERE vec_id % 100 <> 0), "
    "d AS (SELECT query_id, doc, clause_id, list_distance(CAST(qv AS DOUBLE[]), CAST(cv AS DOUBLE[])) AS distance FROM q, c), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, clause_id) AS r FROM d), "
    "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, doc ORDER BY distance, clause_id) AS INTEGER) AS rank FROM t WHERE r <= 15), kept AS (SELECT * FROM k WHERE rank <= 5) "
)


def knn_found(spark, sf_dir):
    """The whole table: ids divisible by 100 ask, all other rows are clauses."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("clause_id"), (F.col("label") % 2).alias("doc"), F.col("embedding").alias("vector"))
    return retrieval.knn(q, c), q


@register("knn_retrieval", _KNN + "SELECT query_id, doc, clause_id, round(distance, 9) AS distance, rank FROM kept")
def _(spark, sf_dir):
    return _rounded(knn_found(spark, sf_dir)[0], 9)


@register("retrieval_relevance", _KNN + "SELECT query_id, round(avg(1 / (1 + distance)), 9) AS relevance FROM kept GROUP BY 1")
def _(spark, sf_dir):
    return _rounded(retrieval.retrieval_relevance(*knn_found(spark, sf_dir)), 9)


def _precision(found):
    mark = F.when(F.col("clause_id") % 3 == 0, "").when(F.col("clause_id") % 3 == 1, "yes").otherwise("0")
    return citations.precision_at_k(found.where("doc = 0").withColumn("relevant", citations.relevance(mark)), 3)


@register(
    "precision_at_k",
    _KNN + ", a AS (SELECT query_id, rank, CASE WHEN clause_id % 3 = 0 THEN NULL ELSE clause_id % 3 = 1 END AS relevant FROM kept WHERE doc = 0), p AS (SELECT query_id, round(count(*) FILTER (relevant) / 3.0, 4) AS p FROM a WHERE rank <= 3 AND relevant IS NOT NULL GROUP BY 1) SELECT count(*) AS n_queries, round(avg(p), 9) AS precision FROM p",
)
def _(spark, sf_dir):
    return _rounded(_precision(knn_found(spark, sf_dir)[0]), 9)


@register(
    "tfidf_retrieval",
    "WITH dt AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS term FROM documents), d AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2), qt AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS term FROM benchmark), "
    "q AS (SELECT item_id, term, count(*) AS tf FROM qt GROUP BY 1, 2), i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM d GROUP BY 1), dw AS (SELECT doc_id, term, tf * idf AS w FROM d JOIN i USING (term)), qw AS (SELECT item_id, term, tf * idf AS w FROM q JOIN i USING (term)), "
    "dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1), s AS (SELECT item_id, doc_id, sum(dw.w * qw.w) AS dot FROM dw JOIN qw USING (term) GROUP BY 1, 2), "
    "r AS (SELECT item_id, s.doc_id, round(dot / (dn.n * qn.n), 9) AS score FROM s JOIN dn USING (doc_id) JOIN qn USING (item_id)), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r) SELECT item_id, doc_id, score, rank FROM k WHERE rank <= 5",
)
def _(spark, sf_dir):
    return retrieval.tfidf_top(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5, "item_id", "doc_id")


_PAGES = (
    "pg AS (SELECT regexp_extract(source, '\\d+', 0) AS section, doc_id, CASE WHEN doc_id % 3 > 0 THEN '  ' || regexp_extract(source, '\\d+', 0) || '.' || (doc_id % 30) || ' ' ELSE '' END || text AS t FROM documents WHERE text IS NOT NULL), "
    "ct AS (SELECT *, regexp_extract_all(t, '(?m)^[ \\t]*(' || section || '\\.\\d{1,2})\\s+', 1) AS ids, regexp_split_to_array(t, '(?m)^[ \\t]*' || section || '\\.\\d{1,2}\\s+') AS parts FROM pg), "
    "nb AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY section ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM ct), "
    "pc AS (SELECT section, doc_id, bef, ids, unnest(range(0, len(parts))) AS i, unnest(parts) AS piece FROM nb), pd AS (SELECT section, doc_id, i, bef + i AS clause, CASE WHEN i > 0 THEN ids[i] END AS cid, piece FROM pc WHERE bef + i > 0 AND (i > 0 OR piece <> '')), "
    "cl AS (SELECT section, clause, max(cid) AS clause_id, min(doc_id) AS page, trim(string_agg(piece, chr(10) ORDER BY doc_id, i)) AS body FROM pd GROUP BY 1, 2) "
)


@register("clause_split", f"WITH {_PAGES} SELECT section, clause_id, page, left(string_split(body, chr(10))[1], 120) AS heading, md5(left(body, 4000)) AS text_md5 FROM cl")
def _(spark, sf_dir):
    """Documents of a source as pages of a section; two of three begin with a clause number, the others go on."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    section = F.regexp_extract("source", r"\d+", 0)
    mark = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("  "), section, F.lit("."), (F.col("doc_id") % 30).cast("string"), F.lit(" "))).otherwise("")
    pages = d.select(F.lit("IRC").alias("doc"), section.alias("section"), F.col("doc_id").alias("page"), F.concat(mark, "text").alias("text"))
    return retrieval.clause_split(pages).select("section", "clause_id", "page", "heading", F.md5("text").alias("text_md5"))
