"""Per-rider outcome metrics from keyword rules (names carry the prefix ``rider_``; they mean other things than the audit metrics)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by what they show, and by action in the reasoning and in the environment text; template openings.
HAZARD = r"(?i)(vehicle|motorcy|bike|auto|truck|bus|swerv|brake|obstacle|hazard|pothole|pedestrian|sudden|cut.?off|car|lorry|oncoming)"
BLEED = r"(?i)(road surface|IRC[:-]?3[57]|IRC[:-]?6[67]|infrastructure|pavement)"
TELEMETRY = r"(?i)(speed|kmh|km/h|accelerat|decelerat|lateral|brake|km|velocity)"
ACTION = {
    "Acceleration": r"(?i)(accelerat|speed up|throttle|gap|pull away)",
    "Deceleration": r"(?i)(decelerat|slow|brake|following distance|slow.?down)",
    "Hard_Braking": r"(?i)(hard brak|emergency|sudden stop|collision|obstacle|cut.?off|brake)",
    "Lane_Change": r"(?i)(lane change|swerv|lateral|overtake|merge)",
}
ENVIRONMENT = {
    "Acceleration": r"(?i)(vehicle|traffic|car|bike|auto|moving|ahead)",
    "Deceleration": r"(?i)(vehicle|traffic|car|ahead|slow|queue|stop)",
    "Hard_Braking": r"(?i)(vehicle|traffic|car|bike|ahead|cut|obstacle|sudden)",
    "Lane_Change": r"(?i)(vehicle|traffic|car|ahead|lane|block|slow)",
}
TEMPLATES = (
    "The rider accelerated rapidly due to a gap opening in traffic ahead",
    "A slowing vehicle ahead caused the rider to decelerate sharply",
    "An abrupt obstacle or vehicle cutting into the lane required emergency hard braking",
    "A slow or stationary vehicle in the current lane required a lateral lane change",
)


def _by_action(action: Column, rules: Mapping[str, str], text: Column) -> Column:
    out = F.lit(False)
    for name, pattern in rules.items():
        out = F.when(action == name, F.rlike(text, F.lit(pattern))).otherwise(out)
    return out


def _listed(clause: Column, ids: Column) -> Column:
    own = F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.trim(F.coalesce(clause, F.lit(""))) != "") & F.array_contains(own, F.trim(clause))


def outcomes(rows: DataFrame, sees_telemetry: Sequence[str] = ("V1",)) -> DataFrame:
    """``rows`` plus 0/1 outcomes of each event.

    rider_chr: a cited clause was retrieved; rider_rhr: reasoned, neither template nor bleed-through, at
    least eight words; rider_icdi: a non-compliant verdict; rider_idas, rider_tvgc: the action's words
    in reasoning, environment; rider_crrs: mean retrieval relevance; rider_tipu: telemetry is mentioned
    (models in ``sees_telemetry``).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = text("evasive_reasoning")
    template = F.lit(False)
    for t in TEMPLATES:
        template = template | F.contains(said, F.lit(t[:35]))
    words = F.size(F.filter(F.split(said, r"\s+"), lambda w: w != ""))
    reasoned = F.rlike(said, F.lit(HAZARD)) & ~template & ~F.rlike(said, F.lit(BLEED)) & (words >= 8)
    hit = _listed(F.col("irc35_clause"), F.col("retrieved_irc35")) | _listed(F.col("irc67_clause"), F.col("retrieved_irc67"))
    non = F.contains(text("irc35_verdict"), F.lit("NON")) | F.contains(text("irc67_verdict"), F.lit("NON"))
    everything = F.concat_ws(" ", text("env"), said, text("road_surface"), text("infrastructure"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return rows.withColumns({
        "rider_chr": one(hit), "rider_rhr": one(reasoned), "rider_icdi": one(non), "rider_idas": one(_by_action(F.col("evasive_action"), ACTION, said)),
        "rider_crrs": F.round((F.coalesce("crrs35", F.lit(0.0)) + F.coalesce("crrs67", F.lit(0.0))) / 2, 4),
        "rider_tipu": one(F.col("model").isin(*sees_telemetry) & F.rlike(everything, F.lit(TELEMETRY))), "rider_tvgc": one(_by_action(F.col("evasive_action"), ENVIRONMENT, text("env"))),
    })


def summary(rows: DataFrame, by: Sequence[str] = ("rider", "model")) -> DataFrame:
    """``by``, n and the mean of each outcome, rounded to 4 digits: one row a rider and model, no loop over either."""
    names = ("chr", "rhr", "icdi", "idas", "crrs", "tipu", "tvgc")
    return outcomes(rows).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"rider_{x}"), 4).alias(f"rider_{x}") for x in names])
