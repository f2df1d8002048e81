"""Queries of the answer, label, pointer and text operators that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.operators import answers, citations, classify, datasets, detect, labels, textsim, timeseries
from roadweave.plans.base import registrar
from roadweave.plans.compliance import _PAIRS, answers_text, pairs
from roadweave.plans.telemetry import _rounded
from roadweave.sources import adapters
from roadweave.sources.adapters import LABELS, TELEMETRY, table, telemetry

QUERIES, SQL, register = registrar()


@register("moving_flag", f"WITH {TELEMETRY} SELECT event_id, coalesce(speed_kmh > 2.0, false) AS is_moving FROM tele")
def _(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", detect.moving(F.col("speed_kmh")).alias("is_moving"))


@register("number_or_default", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value ELSE -1.0 END AS number FROM events")
def _(spark, sf_dir):
    k = F.col("event_id") % 5
    cell = F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(k == 1, "").when(k == 2, "abc").when(k == 3, "NaN")
    return table(spark, sf_dir, "events").select("event_id", answers.number_or(cell, -1.0).alias("number"))


@register("first_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'last' END AS said FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.col("o_orderstatus")).otherwise("  ").alias("a"), F.when(k == 1, F.concat(F.lit(" "), "o_orderpriority")).when(k == 2, "").alias("b"), F.lit("last").alias("c"))
    return o.select("o_orderkey", citations.first_text("a", "b", "c").alias("said"))


_FREE = "(SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'This is non-compliant with [A' || l_suppkey || '.6.2]' WHEN 1 THEN 'Compliant [B12.' || (l_partkey % 9) || ']' WHEN 2 THEN 'noncompliant, see [x]' ELSE 'NON_COMPLIANTLY said' END AS t FROM lineitem)"


def free_text(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    t = F.when(k == 0, F.concat(F.lit("This is non-compliant with [A"), F.col("l_suppkey").cast("string"), F.lit(".6.2]"))).when(k == 1, F.concat(F.lit("Compliant [B12."), (F.col("l_partkey") % 9).cast("string"), F.lit("]")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.when(k == 2, "noncompliant, see [x]").otherwise("NON_COMPLIANTLY said").alias("t"))


@register("verdict_from_text", f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(t, '(?i)\\bNON[_\\s-]?COMPLIANT\\b') THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS verdict, regexp_extract(t, '\\[([A-Z0-9]+\\.\\d[\\d.]*)\\]', 1) AS clause FROM {_FREE}")
def _(spark, sf_dir):
    v = citations.verdict_of(F.col("t"))
    return free_text(spark, sf_dir).select("l_orderkey", "l_linenumber", v["verdict"].alias("verdict"), v["clause"].alias("clause"))


@register("norm_verdict", f"SELECT l_orderkey, l_linenumber, CASE WHEN contains(upper(t), 'NON') THEN 'NON_COMPLIANT' WHEN contains(upper(t), 'COMPLIANT') THEN 'COMPLIANT' END AS verdict FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN 'unsure' ELSE t END AS t FROM (SELECT f.*, l_partkey FROM {_FREE} f JOIN lineitem USING (l_orderkey, l_linenumber)))")
def _(spark, sf_dir):
    both = free_text(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])
    t = F.when(F.col("l_partkey") % 7 == 0, "unsure").otherwise(F.col("t"))
    return both.select("l_orderkey", "l_linenumber", citations.norm_verdict(t).alias("verdict"))


_ACT = "['Acceleration', 'Braking', 'Emergency_Swerve', 'Lane_Change', 'Other', 'Deceleration'][o_orderkey % 6 + 1]"


@register("action_labels", f"SELECT o_orderkey, CASE WHEN a IN ('Braking', 'Emergency_Swerve') THEN 'Hard_Braking' WHEN a <> 'Other' THEN a END AS dropped, CASE WHEN a IN ('Braking', 'Emergency_Swerve') THEN 'Hard_Braking' ELSE a END AS passed FROM (SELECT o_orderkey, {_ACT} AS a FROM orders)")
def _(spark, sf_dir):
    names = F.array(*map(F.lit, ("Acceleration", "Braking", "Emergency_Swerve", "Lane_Change", "Other", "Deceleration")))
    a = F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.mapped(a, labels.ACTIONS).alias("dropped"), labels.mapped(a, labels.ACTIONS, keep=True).alias("passed"))


def _rule_sql(rules, text: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({text}, '{w}')''' for w in words)} THEN '{name}'" for name, words in rules) + " ELSE 'other' END"


_NOTES = ("riding straight", "Sharp Turn left", "swerved", "speed up now", "overtake", "Not evasive", "camera vibration", "avoid dog", "pass by", "merge", "throttle", "weave")


@register(
    "note_variants",
    f"WITH n AS (SELECT doc_id, lower(CASE WHEN doc_id % 13 < 12 THEN {list(_NOTES)}[doc_id % 13 + 1] || ' ' ELSE '' END || text) AS t, CASE WHEN doc_id % 9 = 0 THEN 'Reject' ELSE 'confirm' END AS d FROM documents) "
    f"SELECT doc_id, {_rule_sql(labels.EVASIVE_RULES, 't')} AS evasive, CASE WHEN lower(d) = 'reject' THEN 'not_evasive' ELSE {_rule_sql(labels.REVIEW_RULES, 't')} END AS reviewed FROM n",
)
def _(spark, sf_dir):
    first = F.concat(F.try_element_at(F.array(*map(F.lit, _NOTES)), (F.col("doc_id") % 13 + 1).cast("int")), F.lit(" "))
    note = F.concat(F.coalesce(first, F.lit("")), "text")
    decision = F.when(F.col("doc_id") % 9 == 0, "Reject").otherwise("confirm")
    return table(spark, sf_dir, "documents").select("doc_id", labels.by_words(note, labels.EVASIVE_RULES).alias("evasive"), labels.review_label(note, decision).alias("reviewed"))


@register(
    "decision_labels",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE o_orderstatus END ELSE 'not_evasive' END AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'evasive' ELSE 'not_evasive' END AS two, CASE WHEN o_orderkey % 4 = 0 THEN 'No additional notes provided.' ELSE o_orderpriority END AS reasoning FROM orders",
)
def _(spark, sf_dir):
    decision = F.when(F.col("o_orderkey") % 3 == 0, " Confirm").otherwise("reject")
    blank = lambda c: F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col(c)))
    category = blank("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.decision_label(decision, category).alias("label"), labels.decision_label(decision, category, binary=True).alias("two"), answers.reasoning_or_default(blank("o_orderpriority")).alias("reasoning"))


@register("garbage_texts", "SELECT doc_id, t = '' OR starts_with(t, '!') OR len(regexp_extract_all(t, '[a-zA-Z]')) < 5 AS garbage FROM (SELECT doc_id, coalesce(trim(CASE doc_id % 10 WHEN 0 THEN '!!' || text WHEN 1 THEN ' 12 ab' WHEN 2 THEN '  ' ELSE text END), '') AS t FROM documents)")
def _(spark, sf_dir):
    k = F.col("doc_id") % 10
    t = F.when(k == 0, F.concat(F.lit("!!"), "text")).when(k == 1, " 12 ab").when(k == 2, "  ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", answers.garbage(t).alias("garbage"))


@register(
    "keyword_answers",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_orderstatus WHEN o_orderkey % 5 = 2 THEN o_orderpriority WHEN o_orderkey % 5 = 3 THEN CASE WHEN o_orderstatus = 'F' THEN 'f' WHEN o_orderstatus = 'O' THEN 'o' ELSE 'other' END ELSE 'label' END AS label, 0.5 AS confidence, o_orderkey % 5 < 3 AS parsed FROM orders",
)
def _(spark, sf_dir):
    """Answers that hold an object, or else a keyword after ``it is``."""
    said = F.when(F.col("o_orderkey") % 5 == 3, F.regexp_replace("t", "^Yes, it is ", "->")).otherwise(F.col("t"))
    a = answers.keyword_answer(said, ["label", "->f", "->o"], "label string, confidence double")
    label = F.regexp_replace(a["label"], "^->", "")
    return answers_text(spark, sf_dir).select("o_orderkey", label.alias("label"), a["confidence"].cast("decimal(2,1)").alias("confidence"), a["parsed"].alias("parsed"))


def predictions(spark, sf_dir):
    """Order lines as parsed predictions of two rules, with the retrieved clauses of each."""
    line = table(spark, sf_dir, "lineitem")
    say = lambda c: F.when(F.col(c) == "R", "Yes").when(F.col(c) == "A", "No").otherwise("Unclear")
    clause = lambda c, m: F.concat(F.lit("c"), (F.col(c) % m).cast("string"))
    level = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL", "odd"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    fold = F.struct(say("l_returnflag").alias("presence"), level.alias("severity"), F.when(F.col("l_suppkey") % 4 > 0, clause("l_suppkey", 6)).alias("cited_clause"), F.col("l_linestatus").alias("reasoning"))
    gold = F.struct(F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No").alias("presence"))
    return line.select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), F.when(F.col("l_partkey") % 11 > 0, fold).alias("road_surface"), fold.alias("infrastructure"),
        gold.alias("gold_road_surface"), F.when(F.col("l_suppkey") % 13 > 0, gold).alias("gold_infrastructure"), F.array(clause("l_partkey", 6), clause("l_orderkey", 6)).alias("retrieved_irc35"), F.array(clause("l_orderkey", 5)).alias("retrieved_irc67"),
    )


_RULES = {"road_surface": "retrieved_irc35", "infrastructure": "retrieved_irc67"}
_PRED = (
    "WITH b AS (SELECT l_orderkey || '_' || l_linenumber AS event_id, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'A' THEN 'No' ELSE 'Unclear' END AS presence, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'odd'][l_partkey % 5 + 1] AS severity, "
    "CASE WHEN l_suppkey % 4 > 0 THEN 'c' || (l_suppkey % 6) END AS cited, l_linestatus AS reasoning, CASE WHEN l_linestatus = 'F' THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS gold, ['c' || (l_partkey % 6), 'c' || (l_orderkey % 6)] AS r35, ['c' || (l_orderkey % 5)] AS r67 FROM lineitem), "
    "p AS (SELECT event_id, 'road_surface' AS rule, presence, severity, cited, reasoning, gold, r35 AS retrieved FROM b WHERE l_partkey % 11 > 0 UNION ALL SELECT event_id, 'infrastructure', presence, severity, cited, reasoning, gold, r67 FROM b WHERE l_suppkey % 13 > 0) "
)


@register("audit_verdicts", _PRED + "SELECT event_id, '0' AS frame_id, rule, CASE WHEN presence = 'Yes' THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS verdict, coalesce(cited, '') AS cited_clause, reasoning FROM p")
def _(spark, sf_dir):
    return answers.audit_tables(predictions(spark, sf_dir), _RULES)["verdicts"]


@register("audit_gold", _PRED + "SELECT event_id, '0' AS frame_id, gold AS gold_verdict FROM p")
def _(spark, sf_dir):
    return answers.audit_tables(predictions(spark, sf_dir), _RULES)["gold_verdicts"]


def _compliance_sql(yes: str, no: str) -> str:
    return _PRED + (
        f"SELECT event_id, rule, CAST(CASE presence WHEN 'Yes' THEN {yes} WHEN 'No' THEN {no} ELSE 0.5 END AS DOUBLE) AS absence_confidence, CASE severity WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 1 END AS severity, "
        "CAST(CASE WHEN coalesce(list_contains(retrieved, cited), false) THEN 1.0 ELSE 0.5 END AS DOUBLE) AS retrieval_score FROM p"
    )


@register("audit_compliance", _compliance_sql("0.9", "0.1"))
def _(spark, sf_dir):
    return answers.audit_tables(predictions(spark, sf_dir), _RULES)["event_compliance"].select("event_id", "rule", "absence_confidence", "severity", "retrieval_score")


@register("audit_compliance_sharp", _compliance_sql("1.0", "0.0"))
def _(spark, sf_dir):
    return answers.audit_tables(predictions(spark, sf_dir), _RULES, answers.ABSENCE_SHARP)["event_compliance"].select("event_id", "rule", "absence_confidence", "severity", "retrieval_score")


@register("audit_retrieval", _PRED + "SELECT event_id || '_' || rule AS event_id, CAST(unnest(range(1, len(retrieved) + 1)) AS INTEGER) AS retrieval_rank, unnest(retrieved) AS clause_id FROM p")
def _(spark, sf_dir):
    return answers.audit_tables(predictions(spark, sf_dir), _RULES)["retrieval_results"].select("event_id", "retrieval_rank", "clause_id")


_POINT = "SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS yes, ['c-' || (l_partkey % 4), 'c_' || (l_partkey % 3 + 4)] AS got, 'c_' || (l_suppkey % 8) AS cited FROM lineitem"


def pointers(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    got = F.array(F.concat(F.lit("c-"), (F.col("l_partkey") % 4).cast("string")), F.concat(F.lit("c_"), (F.col("l_partkey") % 3 + 4).cast("string")))
    return line.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "YES").otherwise("No").alias("presence"), got.alias("retrieved"), F.concat(F.lit("c_"), (F.col("l_suppkey") % 8).cast("string")).alias("cited_clause"))


_POINTED = f"WITH b AS ({_POINT}), p AS (SELECT *, list_position(list_transform(got, lambda x: replace(x, '-', '_')), cited) AS pos FROM b) "
_INDEX = "CAST(CASE WHEN NOT yes OR pos IS NULL OR pos = 0 THEN 2 ELSE pos - 1 END AS INTEGER)"


@register("pointer_index", _POINTED + f"SELECT l_orderkey, l_linenumber, {_INDEX} AS index, yes AND coalesce(pos, 0) = 0 AS missed, array_to_string(CASE WHEN yes AND coalesce(pos, 0) = 0 THEN list_append(got, cited) ELSE got END, ' ') AS clauses FROM p")
def _(spark, sf_dir):
    p = citations.pointer_index(F.col("retrieved"), F.col("cited_clause"), F.col("presence"))
    return pointers(spark, sf_dir).select("l_orderkey", "l_linenumber", p["index"].alias("index"), p["missed"].alias("missed"), F.array_join(p["clauses"], " ").alias("clauses"))


@register("pointer_set", _POINTED + f"SELECT l_orderkey || '.' || l_linenumber AS event_id, {_INDEX} AS road, CAST(2 AS INTEGER) AS infra, yes AND coalesce(pos, 0) = 0 AS missed FROM p")
def _(spark, sf_dir):
    p = pointers(spark, sf_dir).select(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), F.struct("presence", "cited_clause", "retrieved").alias("road_surface"), F.struct(F.lit("No").alias("presence"), "cited_clause", "retrieved").alias("infrastructure"))
    return datasets.pointer_set(p, ("road_surface", "infrastructure")).select("event_id", F.col("road_surface.index").alias("road"), F.col("infrastructure.index").alias("infra"), F.col("road_surface.missed").alias("missed"))


@register(
    "pointer_resolution",
    "WITH w AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: abs(CAST(x AS DOUBLE))) AS a, vec_id % 3 <> 0 AS yes FROM embeddings), s AS (SELECT vec_id, yes, list_transform(a, lambda x: x / list_sum(a)) AS p FROM w) "
    "SELECT vec_id, CASE WHEN yes AND list_position(p, list_max(p)) <= 4 THEN 'c' || list_position(p, list_max(p)) END AS clause, round(list_max(p), 9) AS confidence, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-8))), 9) AS entropy FROM s",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double")))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    e = e.select("vec_id", a.alias("a")).select("vec_id", F.transform("a", lambda x: x / total).alias("p"))
    r = citations.resolve_pointer(F.col("p"), F.array(*[F.lit(f"c{i}") for i in range(1, 5)]), F.when(F.col("vec_id") % 3 != 0, "Yes").otherwise("No"))
    return _rounded(e.select("vec_id", r["clause"].alias("clause"), r["confidence"].alias("confidence"), r["entropy"].alias("entropy")), 9)


_ZONE = "['School', 'Pedestrian Crossing', 'Residential', 'Highway', 'Unknown', 'Farm'][user_id % 6 + 1]"


@register("zone_vector", f"WITH {TELEMETRY}, z AS (SELECT event_id, speed_kmh, CASE WHEN {_ZONE} = 'Farm' THEN 'Unknown' ELSE {_ZONE} END AS z FROM tele) SELECT event_id, " + ", ".join(f"CAST(z = '{z}' AS INTEGER) AS v{i}" for i, z in enumerate(datasets.ZONES)) + ", speed_kmh AS v5 FROM z")
def _(spark, sf_dir):
    zone = F.element_at(F.array(*map(F.lit, (*datasets.ZONES, "Farm"))), (F.col("user_id") % 6 + 1).cast("int"))
    v = datasets.zone_vector(zone, F.col("speed_kmh"))
    return telemetry(spark, sf_dir).select("event_id", *[v[i].cast("int").alias(f"v{i}") for i in range(5)], v[5].alias("v5"))


_SEEN = "CASE user_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'car' WHEN 2 THEN 'both' ELSE 'none' END"


@register(
    "maneuvers",
    f"WITH {TELEMETRY}, s AS (SELECT event_id, {_SEEN} AS d, ax / 50 AS j, ay / 40 AS z FROM tele), f AS (SELECT *, d IN ('person', 'both') AS p, d IN ('car', 'both') AS c FROM s) SELECT event_id, CASE WHEN j > 2.0 THEN CASE WHEN p THEN 'swerve' WHEN c THEN 'lane_change' ELSE 'zigzag' END WHEN z > 2.0 THEN CASE WHEN p OR c THEN 'braking' ELSE 'deceleration' END ELSE 'none' END AS lateral, "
    "CASE WHEN z > 1.2 THEN CASE WHEN p OR c THEN 'braking' ELSE 'deceleration' END WHEN j > 1.5 THEN CASE WHEN p THEN 'swerve' WHEN c THEN 'lane_change' ELSE 'zigzag' END ELSE 'none' END AS vertical FROM f",
)
def _(spark, sf_dir):
    k = F.col("user_id") % 4
    d = F.when(k == 0, F.array(F.lit("person"))).when(k == 1, F.array(F.lit("car"))).when(k == 2, F.array(F.lit("truck"), F.lit("animal"))).otherwise(F.array(F.lit("tree")))
    m = lambda v: labels.maneuver(d, F.col("ax") / 50, F.col("ay") / 40, v)
    return telemetry(spark, sf_dir).select("event_id", m("lateral").alias("lateral"), m("vertical").alias("vertical"))


@register(
    "ungrounded_answers",
    f"WITH {TELEMETRY}, t AS (SELECT *, event_id % 3 AS k FROM tele) SELECT event_id, NOT (k < 2) OR NOT (ay / 80 BETWEEN 0 AND 1) OR (abs(round(ax, 2) * 1.1 - ax) > 0.15 * greatest(abs(ax), 1e-9) AND abs(round(ax, 2) * 1.1 - ay) > 0.15 * greatest(abs(ay), 1e-9)) AS made_up FROM t",
)
def _(spark, sf_dir):
    text = F.concat(F.lit("peak of "), (F.round("ax", 2) * 1.1).cast("string"), F.lit(" seen"))
    label = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int"))
    t = telemetry(spark, sf_dir)
    return t.select("event_id", answers.ungrounded(text, F.array("ax", "ay"), label, F.col("ay") / 80, ["a", "b"]).alias("made_up"))


_PHRASES = ("the", "and", "der", "que", "les")


@register(
    "unsupported_mentions",
    f"WITH {_PAIRS}, p AS (SELECT id, len(list_filter({list(_PHRASES)}, lambda w: contains(lower(candidate), w))) AS s, len(list_filter({list(_PHRASES)}, lambda w: contains(lower(candidate), w) AND NOT contains(lower(reference), w))) AS l FROM prs) SELECT id, round(CASE WHEN s > 0 THEN l / s ELSE 0 END, 9) AS rate FROM p",
)
def _(spark, sf_dir):
    return _rounded(pairs(spark, sf_dir).select("id", answers.unsupported_mentions(F.col("candidate"), F.col("reference"), _PHRASES).alias("rate")), 9)


@register(
    "telemetry_text",
    f"WITH {TELEMETRY}, t AS (SELECT event_id, ax, CASE WHEN event_id % 4 > 0 THEN ay END AS ay FROM tele) SELECT event_id, 'ax=' || printf('%.2f', ax) || ', ay=' || coalesce(printf('%.3f', ay), 'NA') AS with_na, 'ax=' || printf('%.2f', ax) || coalesce(', ay=' || printf('%.3f', ay), '') AS skipped, left('Speed ' || coalesce(printf('%.3f', ay), 'NA') || ' of rider ' || event_id || '.', 24) AS prompt FROM t",
)
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("ay", F.when(F.col("event_id") % 4 > 0, F.col("ay")))
    parts = [("ax", F.col("ax"), 2), ("ay", F.col("ay"), 3)]
    speed = F.when(F.col("ay").isNotNull(), F.format_string("%.3f", "ay"))
    prompt = answers.prompt("Speed {speed} of rider {id}.", {"speed": speed, "id": F.col("event_id")}, 24)
    return t.select("event_id", answers.telemetry_summary(parts).alias("with_na"), answers.telemetry_summary(parts, skip_missing=True).alias("skipped"), prompt.alias("prompt"))


@register("target_json", "SELECT o_orderkey, '{\"label\":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || ',\"confidence\":0.5,\"reasoning\":\"' || o_orderpriority || '\"}' AS target FROM orders")
def _(spark, sf_dir):
    label = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", answers.target_json(label, F.lit(0.5), F.col("o_orderpriority")).alias("target"))


@register(
    "marking_states",
    f"WITH {TELEMETRY}, m AS (SELECT event_id, ax / 40000 AS cov, CAST(ay AS INTEGER) % 9 AS seg, user_id % 7 AS w, user_id % 5 AS y FROM tele) SELECT event_id, cov > 0.0015 AS present, CASE WHEN NOT cov > 0.0015 THEN 'none' WHEN y > w THEN 'yellow' ELSE 'white' END AS colour, CASE WHEN cov > 0.0005 AND seg >= 6 THEN 'broken' WHEN cov > 0.0005 AND seg >= 1 THEN 'solid' ELSE 'absent' END AS continuity FROM m",
)
def _(spark, sf_dir):
    s = labels.marking_state(F.col("ax") / 40000, F.col("ay").cast("int") % 9, F.col("user_id") % 7, F.col("user_id") % 5)
    return telemetry(spark, sf_dir).select("event_id", s["present"].alias("present"), s["colour"].alias("colour"), s["continuity"].alias("continuity"))


@register(
    "sign_shapes",
    f"WITH {TELEMETRY}, m AS (SELECT event_id, CAST(ay AS INTEGER) / 100.0 AS circ, user_id % 6 AS cor, ax * 10 AS area, user_id % 80 AS sat, ay AS con FROM tele), s AS (SELECT *, CASE WHEN area < 250 THEN NULL WHEN circ > 0.75 THEN 'circle' WHEN cor = 3 THEN 'triangle' WHEN cor = 4 THEN 'rectangle' END AS shape FROM m) "
    "SELECT event_id, shape, CASE shape WHEN 'circle' THEN 'mandatory' WHEN 'triangle' THEN 'cautionary' WHEN 'rectangle' THEN 'informatory' END AS category, CASE WHEN sat < 40 OR con < 20 THEN 'faded' ELSE 'good' END AS condition FROM s",
)
def _(spark, sf_dir):
    s = labels.sign_shape(F.col("ay").cast("int") / 100.0, F.col("user_id") % 6, F.col("ax") * 10, F.col("user_id") % 80, F.col("ay"))
    return telemetry(spark, sf_dir).select("event_id", s["shape"].alias("shape"), s["category"].alias("category"), s["condition"].alias("condition"))


@register(
    "confident_objects",
    "WITH o AS (SELECT l_orderkey, l_shipdate, l_linenumber, ['dog', 'car', 'tree'][l_linenumber % 3 + 1] AS c, l_discount * 5 AS f FROM lineitem) SELECT l_orderkey, l_linenumber, c AS \"class\", round(f, 3) AS confidence, c = 'dog' AS is_animal, c = 'car' AS is_vehicle FROM o WHERE f >= 0.25",
)
def _(spark, sf_dir):
    one = F.struct(F.element_at(F.array(F.lit("dog"), F.lit("car"), F.lit("tree")), F.col("l_linenumber") % 3 + 1).alias("class"), (F.col("l_discount") * 5).alias("confidence"))
    kept = labels.confident_objects(F.array(one), ["dog", "cow"], ["car", "bus"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(kept).alias("o")).select("l_orderkey", "l_linenumber", "o.*")


@register("spread_times", "SELECT o_orderkey, CAST(unnest(range(0, 5)) AS INTEGER) AS i, round(o_totalprice / 1000 + (o_custkey % 40) * unnest(range(0, 5)) / 4.0, 6) AS t FROM orders")
def _(spark, sf_dir):
    start = F.col("o_totalprice") / 1000
    return _rounded(table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(datasets.spread_times(start, start + F.col("o_custkey") % 40, 5)).alias("i", "t")))


@register(
    "aligned_streams",
    f"WITH {TELEMETRY}, a AS (SELECT clip_id, cts, row_number() OVER (PARTITION BY clip_id ORDER BY cts) AS i FROM tele), b AS (SELECT clip_id, cts + CASE WHEN event_id % 50 = 0 THEN 1e-3 ELSE 0 END AS t, row_number() OVER (PARTITION BY clip_id ORDER BY cts) AS i FROM tele WHERE NOT (clip_id = 'view' AND ax > 400)) "
    "SELECT coalesce(a.clip_id, b.clip_id) AS clip_id, count(*) AS n, count(*) FILTER (coalesce(abs(cts - t) > 1e-8 + 1e-10 * abs(t), true)) AS n_off FROM a FULL JOIN b ON a.clip_id = b.clip_id AND a.i = b.i GROUP BY 1",
)
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    left = t.select("clip_id", "cts", "ax")
    right = t.where("not (clip_id = 'view' and ax > 400)").select("clip_id", (F.col("cts") + F.when(F.col("event_id") % 50 == 0, 1e-3).otherwise(0.0)).alias("cts"), F.col("cts").alias("sampled"), "ay")
    met = timeseries.aligned(left, right, relative=1e-10, order=["sampled"])
    return met.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("misaligned").cast("long")).alias("n_off"))


@register(
    "failed_answers",
    f"WITH {LABELS}, l AS (SELECT gold, pred, event_id % 6 = 0 AS bad FROM labelled), p AS (SELECT 'excluded' AS policy, pred, gold FROM l WHERE NOT bad UNION ALL SELECT 'other', CASE WHEN bad THEN 'other' ELSE pred END, gold FROM l UNION ALL SELECT 'wrong', CASE WHEN bad THEN 'PARSE_FAIL' ELSE pred END, gold FROM l) "
    "SELECT policy, count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END), 9) AS accuracy FROM p GROUP BY 1",
)
def _(spark, sf_dir):
    rows = adapters.labels(spark, sf_dir).withColumn("failed", F.col("event_id") % 6 == 0)
    parts = [classify.with_failures(rows, "pred", F.col("failed"), p).withColumn("policy", F.lit(p)) for p in ("excluded", "other", "wrong")]
    return _rounded(classify.summary(parts[0].unionByName(parts[1]).unionByName(parts[2]), by=["policy"]).select("policy", "n", "accuracy"), 9)


@register("imbalance", f"WITH {LABELS} SELECT model, count(*) FILTER (gold = 'P') AS n_positive, count(*) FILTER (gold <> 'P') AS n_other, round(count(*) FILTER (gold <> 'P') / greatest(count(*) FILTER (gold = 'P'), 1), 9) AS ratio FROM labelled GROUP BY 1")
def _(spark, sf_dir):
    return _rounded(classify.imbalance(adapters.labels(spark, sf_dir), "gold", "P", ["model"]), 9)


@register(
    "pooled_scores",
    f"WITH {LABELS}, r AS (SELECT model, pred, gold FROM labelled UNION ALL SELECT model, CASE WHEN event_id % 4 > 0 THEN gold END, CASE WHEN event_id % 5 = 0 THEN 'F' ELSE gold END FROM labelled), u AS (SELECT * FROM r WHERE pred IS NOT NULL), g AS (SELECT model, gold AS label, count(*) AS ng, count(*) FILTER (pred = gold) AS tp FROM u GROUP BY 1, 2), "
    "p AS (SELECT model, pred AS label, count(*) AS np FROM u GROUP BY 1, 2), f AS (SELECT g.model, tp / ng AS rc, coalesce(tp / nullif(np, 0), 0) AS pr FROM g LEFT JOIN p USING (model, label)), s AS (SELECT model, avg(pr) AS mp, avg(rc) AS mr, avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)) AS mf FROM f GROUP BY 1), "
    "a AS (SELECT model, count(*) AS n, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0 END) AS acc FROM u GROUP BY 1) SELECT model, n, round(acc, 9) AS accuracy, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1 FROM a JOIN s USING (model)",
)
def _(spark, sf_dir):
    rows = adapters.labels(spark, sf_dir).withColumns({"p2": F.when(F.col("event_id") % 4 > 0, F.col("gold")), "g2": F.when(F.col("event_id") % 5 == 0, "F").otherwise(F.col("gold"))})
    return _rounded(classify.pooled(rows, [("pred", "gold"), ("p2", "g2")], ["model"]).select("model", "n", "accuracy", "macro_precision", "macro_recall", "macro_f1"), 9)


@register("embedding_similarity", "SELECT a.vec_id, round(CASE WHEN list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: 1)) > 0 THEN list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ELSE 0 END, 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference"))
    return e.join(other, "vec_id").select("vec_id", F.round(textsim.cosine(F.col("embedding"), F.col("reference")), 4).alias("similarity"))


_PLACE = "b AS (SELECT c_custkey, CAST(c_acctbal + 1000 AS DOUBLE) AS w, md5('42|' || c_custkey) AS h FROM customer WHERE c_acctbal + 1000 > 0), s AS (SELECT *, substr(h, 1, 3) AS part FROM b), q AS (SELECT part, sum(w) AS pw FROM s GROUP BY 1), o AS (SELECT part, coalesce(sum(pw) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, sum(pw) OVER () AS total FROM q), "


@register(
    "weighted_draws",
    f"WITH {_PLACE} p AS (SELECT c_custkey, w, total, f + sum(w) OVER (PARTITION BY part ORDER BY h, c_custkey ROWS UNBOUNDED PRECEDING) AS hi FROM s JOIN o USING (part)), d AS (SELECT unnest(range(0, 2000)) AS draw), u AS (SELECT draw, CAST('0x' || substr(md5('42|draw|' || draw), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM d) "
    "SELECT c_custkey, draw FROM u JOIN p ON u.u * p.total >= p.hi - p.w AND u.u * p.total < p.hi",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") + 1000).alias("w"))
    return labels.weighted_draws(c, "w", "c_custkey", 2000).select("c_custkey", "draw")
