"""Risk indices of events from their findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.operators.intervals import END, START, grouped_by_gap

#: Risk of a zone, 1 for any other; weight of an infrastructure status.
ZONE_RISK = {"School": 1.5, "Pedestrian Crossing": 1.4, "Residential": 1.2, "Highway": 1.0, "Unknown": 1.0}
STATUS_WEIGHT = {"Absent": 1.0, "Unclear": 0.5, "Present": 0.1}


def zone_risk(zone: Column) -> Column:
    out = F.lit(1.0)
    for name, risk in ZONE_RISK.items():
        out = F.when(zone == name, risk).otherwise(out)
    return out


def infra_status(absence: Column) -> Column:
    return F.when(absence >= 0.66, "Absent").when(absence >= 0.33, "Unclear").otherwise("Present")


def status_weight(status: Column) -> Column:
    return F.when(status == "Absent", STATUS_WEIGHT["Absent"]).when(status == "Unclear", STATUS_WEIGHT["Unclear"]).otherwise(STATUS_WEIGHT["Present"])


def icdi(rows: DataFrame, event: str = "event_id", time: str = "timestamp", order: str = "frame_id", round_stages: bool = False) -> DataFrame:
    """One row an event: zone (most frequent, first seen on ties), means, and mean of absence x severity x zone risk x retrieval."""
    zones = rows.groupBy(event, "zone_type").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    zone = zones.groupBy(event).agg(F.max_by("zone_type", F.struct("_n", (-F.col("_first")).alias("_o"))).alias("zone_type"))
    fine = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    value = fine(F.col("absence_confidence")) * fine(F.col("severity")) * zone_risk(F.col("zone_type")) * fine(F.col("retrieval_score"))
    means = rows.groupBy(event).agg(
        F.min(time).alias(START), F.max(time).alias(END), F.count(F.lit(1)).alias("num_rows"), F.avg("absence_confidence").alias("mean_absence_confidence"),
        F.avg("severity").alias("mean_severity"), F.avg("retrieval_score").alias("mean_retrieval_score"), F.avg(value).alias("icdi"),
    )
    out = means.join(zone, event).withColumn("zone_risk", zone_risk(F.col("zone_type")))
    if round_stages:
        out = out.withColumns({c: F.bround(c, 4) for c in ("mean_absence_confidence", "mean_severity", "mean_retrieval_score", "icdi")})
    return out


def crrs(events: DataFrame, gap: float = 30.0, keys: Sequence[str] = (), legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(detail, total): events grouped by time gaps, weighted by group size; total has n and the mean of icdi x weight.

    Events without time make a group of their own each, or, with ``legacy``, count as time 0.
    """
    e = events
    if legacy:
        e = e.withColumns({START: F.coalesce(START, F.lit(0.0)), END: F.coalesce(END, F.lit(0.0))})
    there = e.where(F.col(START).isNotNull())
    timed = grouped_by_gap(there, gap, list(keys))
    sizes = timed.groupBy(*keys, "group_no").agg(F.count(F.lit(1)).alias("weight"))
    sized = timed.join(sizes, [*keys, "group_no"]).select(*timed.columns, "weight")
    loose = e.where(F.col(START).isNull()).withColumns({"group_no": F.lit(None).cast("int"), "weight": F.lit(1).cast("long")})
    detail = sized.unionByName(loose)
    return detail, detail.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("icdi") * F.col("weight")), F.count(F.lit(1))).alias("crrs"))


def idas(events: DataFrame, digits: int | None = 4) -> DataFrame:
    """n and the mean over events of icdi x status weight, each rounded to ``digits`` (None: not rounded)."""
    value = F.col("icdi") * status_weight(infra_status(F.col("mean_absence_confidence")))
    return events.select((value if digits is None else F.round(value, digits)).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("idas"))


def with_total(detail: DataFrame, total: DataFrame, label: str, key: str) -> DataFrame:
    """Detail rows and one last row named ``label``: what a report file holds."""
    tail = total.withColumn(key, F.lit(label)).withColumn("_ord", F.lit(1))
    return detail.withColumn("_ord", F.lit(0)).withColumn(key, F.col(key).cast("string")).unionByName(tail, allowMissingColumns=True).orderBy("_ord", key).drop("_ord")
