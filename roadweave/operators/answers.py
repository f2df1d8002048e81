"""Model answers as text: extraction of JSON, validation, heuristics, checks, and prompts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = ("environment", "road_surface", "infrastructure")
#: Levels of severity, the two tables of absence confidence, and the text of missing notes.
SEVERITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
ABSENCE = {"Yes": 0.9, "Unclear": 0.5, "No": 0.1}
ABSENCE_SHARP = {"Yes": 1.0, "Unclear": 0.5, "No": 0.0}
NO_NOTES = "No additional notes provided."


def _json(text: Column, schema: str) -> Column:
    """The text parsed by ``schema``; null unless it is an object."""
    return F.when(F.rlike(F.trim(text), F.lit(r"(?s)^\{.*\}$")), F.from_json(F.trim(text), schema))


def _is_object(text: Column) -> Column:
    return F.rlike(F.trim(text), F.lit(r"(?s)^\{.*\}$")) & F.get_json_object(text, "$").isNotNull()


def object_text(text: Column) -> Column:
    """The JSON object in an answer: the whole text, else the widest {...} block, else null."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(_is_object(text), F.trim(text)).when(_is_object(block), block)


def last_object_text(text: Column) -> Column:
    """The last innermost {...} block that parses."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)\{[^{}]*\}"), F.lit(0))
    return F.try_element_at(F.filter(blocks, _is_object), F.lit(-1))


def fenced_object_text(text: Column) -> Column:
    """The object after code fences are stripped; of a list the first item."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    first = F.get_json_object(bare, "$[0]")
    return F.coalesce(F.when(F.rlike(bare, F.lit(r"(?s)^\[.*\]$")), F.when(_is_object(first), first)), object_text(bare))


def keyword_answer(text: Column, labels: Sequence[str], schema: str, otherwise: str = "other") -> Column:
    """struct(label, confidence, parsed): from the object, else the first label named in the text with confidence 0.5."""
    o = F.from_json(fenced_object_text(text), schema)
    low = F.lower(text)
    word = F.lit(otherwise)
    for name in reversed(labels):
        word = F.when(F.contains(low, F.lit(name)), name).otherwise(word)
    parsed = o.isNotNull() & o["label"].isNotNull()
    return F.struct(F.when(parsed, o["label"]).otherwise(word).alias("label"), F.when(parsed, F.coalesce(o["confidence"], F.lit(0.5))).otherwise(0.5).alias("confidence"), parsed.alias("parsed"))


def yes_no(text: Column, window: int = 10) -> Column:
    """true, false or null from how an answer begins."""
    t = F.lower(F.trim(text))
    head = F.concat(F.lit(" "), F.substring(t, 1, window))
    return F.when(F.startswith(t, F.lit("yes")) | F.contains(head, F.lit(" yes")), True).when(F.startswith(t, F.lit("no")) | F.contains(head, F.lit(" no")), False)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_failure(text: Column, folds: Sequence[str] = FOLDS, keys: Sequence[str] = ("presence", "severity", "reasoning")) -> Column:
    """Why a three-fold answer is not valid (the first reason), or null."""
    return _object_failure(object_text(text), folds, keys)


def _object_failure(o: Column, folds: Sequence[str], keys: Sequence[str] = ("presence", "severity", "reasoning")) -> Column:
    """``fold_failure`` of an answer's object; the object, its folds and their keys are each read once."""

    def of_fold(f: str, whole: Column, inner: Column) -> Column:
        presence = F.initcap(F.trim(F.get_json_object(whole, f"$.{f}.presence")))
        lacking = lambda said: F.coalesce(*[F.when(~F.coalesce(F.array_contains(said, k), F.lit(False)), f"missing_key:{f}.{k}") for k in keys])
        return F.coalesce(_once(F.json_object_keys(inner), lacking), F.when(~F.coalesce(presence.isin("Yes", "No"), F.lit(False)), f"invalid_presence:{f}"))

    def of_object(whole: Column) -> Column:
        missing = lambda top: F.coalesce(*[F.when(~F.array_contains(top, f), f"missing_fold:{f}") for f in folds])
        return F.coalesce(F.when(whole.isNull(), "parse_error"), _once(F.json_object_keys(whole), missing), *[_once(F.get_json_object(whole, f"$.{f}"), partial(of_fold, f, whole)) for f in folds])

    return _once(o, of_object)


def fold_rows(df: DataFrame, text: str, key: str, folds: Sequence[str] = FOLDS) -> DataFrame:
    """key, fold, presence, severity, reasoning, verdict, severity_level: one row a fold of each valid answer."""
    o = F.col("_o")
    part = lambda f, k: F.get_json_object(o, f"$.{f}.{k}")
    cells = F.array(*[F.struct(F.lit(f).alias("fold"), F.initcap(F.trim(part(f, "presence"))).alias("presence"), F.upper(F.trim(part(f, "severity"))).alias("severity"), part(f, "reasoning").alias("reasoning")) for f in folds])
    valid = df.select(key, _once(object_text(F.col(text)), lambda x: F.when(_object_failure(x, folds).isNull(), x)).alias("_o")).where("_o is not null")
    flat = valid.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    level = F.when(F.col("severity") == "LOW", 1).when(F.col("severity") == "MEDIUM", 2).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "CRITICAL", 4)
    return flat.withColumns({"verdict": F.when(F.col("presence") == "Yes", "NON_COMPLIANT").otherwise("COMPLIANT"), "severity_level": level})


def numbers(text: Column) -> Column:
    """The numbers written in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def ungrounded(text: Column, given: Column, label: Column, confidence: Column, labels: Sequence[str], within: float = 0.15) -> Column:
    """Whether an answer is made up: unknown label, confidence outside 0 to 1, or a number not within 15 % of any given one."""
    stray = F.exists(numbers(text), lambda x: ~F.exists(given, lambda g: F.abs(x - g) <= within * F.greatest(F.abs(g), F.lit(1e-9))))
    return ~F.coalesce(label.isin(*labels), F.lit(False)) | ~F.coalesce(confidence.between(0, 1), F.lit(False)) | stray


def unsupported_mentions(text: Column, reference: Column, phrases: Sequence[str]) -> Column:
    """Share of the listed phrases in ``text`` that ``reference`` lacks; 0 if there are none."""
    said = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))
    lacking = F.filter(said, lambda p: ~F.contains(F.lower(reference), p))
    return F.coalesce(F.try_divide(F.size(lacking), F.size(said)), F.lit(0.0))


def garbage(text: Column) -> Column:
    """Empty, starting with !, or fewer than five letters."""
    t = F.coalesce(F.trim(text), F.lit(""))
    return (t == "") | F.startswith(t, F.lit("!")) | (F.regexp_count(t, F.lit("[a-zA-Z]")) < 5)


def telemetry_summary(parts: Sequence[tuple[str, Column, int]], skip_missing: bool = False) -> Column:
    """``name=value`` texts with so many digits, joined by commas; missing values read NA or are left out."""
    texts = [F.concat(F.lit(f"{n}="), F.format_string(f"%.{d}f", c.cast("double"))) for n, c, d in parts]
    shown = [F.when(c.isNotNull(), t) if skip_missing else F.when(c.isNotNull(), t).otherwise(F.lit(f"{n}=NA")) for (n, c, _), t in zip(parts, texts, strict=True)]
    return F.concat_ws(", ", *shown)


def number_or(value: Column, otherwise: float) -> Column:
    """A cell as a number; ``otherwise`` where it is blank, text or not a number."""
    return F.coalesce(F.nanvl(F.trim(value.cast("string")).try_cast("double"), F.lit(None).cast("double")), F.lit(float(otherwise)))


def reasoning_or_default(notes: Column) -> Column:
    """Trimmed notes, or the fixed sentence where there are none."""
    return F.coalesce(F.nullif(F.trim(notes), F.lit("")), F.lit(NO_NOTES))


def prompt(template: str, values: dict[str, Column], most: int | None = None) -> Column:
    """``template`` with each ``{name}`` replaced; missing values read NA; cut to ``most`` characters."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("NA")))
    return out if most is None else F.substring(out, 1, most)


def audit_tables(predictions: DataFrame, rules: Mapping[str, str], absence: Mapping[str, float] = ABSENCE, severity: Mapping[str, int] = SEVERITY) -> dict[str, DataFrame]:
    """verdicts, gold_verdicts, event_compliance, retrieval_results of parsed predictions.

    ``predictions`` has event_id and for each rule of ``rules`` a struct <rule> (presence, severity,
    cited_clause, reasoning), a struct gold_<rule> (presence), and the array of retrieved clauses
    named by the rule's entry. A rule whose struct is null on either side gives no rows. Presence
    and severity are written as in the answer; unknown presence has an absence confidence of 0.5,
    unknown severity level 1. The retrieval score is 1 if the cited clause was retrieved, else 0.5.
    """
    yes = lambda c: F.when(c == "Yes", "NON_COMPLIANT").otherwise("COMPLIANT")
    one = [F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("said"), F.col(f"gold_{rule}").alias("gold"), F.col(found).alias("retrieved")) for rule, found in rules.items()]
    rows = predictions.select("event_id", F.explode(F.array(*one)).alias("r")).select("event_id", "r.*").where("said is not null and gold is not null")
    entry = lambda table, c, otherwise: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), F.lit(otherwise))
    cited = F.coalesce("said.cited_clause", F.lit(""))
    hit = F.coalesce(F.array_contains("retrieved", F.col("said.cited_clause")), F.lit(False))
    frame = F.lit("0").alias("frame_id")
    return {
        "verdicts": rows.select("event_id", frame, "rule", yes(F.col("said.presence")).alias("verdict"), cited.alias("cited_clause"), F.coalesce("said.reasoning", F.lit("")).alias("reasoning")),
        "gold_verdicts": rows.select("event_id", frame, yes(F.col("gold.presence")).alias("gold_verdict")),
        "event_compliance": rows.select("event_id", F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"), F.lit("Unknown").alias("zone_type"), entry(absence, F.col("said.presence"), 0.5).alias("absence_confidence"), entry(severity, F.col("said.severity"), 1).alias("severity"), F.when(hit, 1.0).otherwise(0.5).alias("retrieval_score"), "rule"),
        "retrieval_results": rows.select(F.concat_ws("_", F.col("event_id").cast("string"), "rule").alias("event_id"), F.posexplode("retrieved").alias("p", "clause_id")).select("event_id", (F.col("p") + 1).alias("retrieval_rank"), "clause_id", F.lit(None).cast("string").alias("human_relevant")),
    }


def target_json(label: Column, confidence: Column, reasoning: Column) -> Column:
    return F.to_json(F.struct(label.alias("label"), confidence.alias("confidence"), reasoning.alias("reasoning")), {"ignoreNullFields": "false"})
