"""Assembly of event tables and training sets from the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators import citations, intervals, review, timeseries
from roadweave.operators.intervals import END, START
from roadweave.operators.labels import peak_label

ZONES = ("School", "Pedestrian Crossing", "Residential", "Highway", "Unknown")


def event_ids(events: DataFrame, clip: str = "clip_id", order: Sequence[str] = (START, END)) -> DataFrame:
    """``events`` plus event_id ``<clip>_evtNNNN``, numbered from 0 within each clip."""
    n = F.row_number().over(Window.partitionBy(clip).orderBy(*order)) - 1
    return events.withColumn("event_id", F.format_string("%s_evt%04d", F.col(clip).cast("string"), n))


def frame_plan(videos: DataFrame, every: int) -> DataFrame:
    """video, frame, frame_id ``fNNNNNN``, timestamp_sec of every ``every``-th frame of (video, n_frames, fps)."""
    plan = videos.where("n_frames > 0").select("video", "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1, F.lit(every).cast("long"))).alias("frame"))
    return plan.select("video", "frame", F.format_string("f%06d", "frame").alias("frame_id"), F.round(F.col("frame") / F.col("fps"), 2).alias("timestamp_sec"))


def spread_times(start: Column, end: Column, n: int) -> Column:
    """``n`` evenly spaced times from start to end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * i / F.lit(float(max(n - 1, 1))))


def zone_vector(zone: Column, speed: Column) -> Column:
    """One-hot zone (unknown ones count as ``Unknown``) and the speed."""
    known = F.when(zone.isin(*ZONES), zone).otherwise("Unknown")
    return F.array(*[F.when(known == z, 1.0).otherwise(0.0) for z in ZONES], F.coalesce(speed.cast("double"), F.lit(0.0)))


def by_index(predictions: DataFrame, gold: DataFrame, index: str = "event_idx", apart: float = 0.5) -> DataFrame:
    """Gold rows with the prediction of their row number: ``missing`` where there is none or its start is too far off; unparsed ones count as no."""
    p = predictions.select(F.col(index).alias("_i"), F.col(START).alias("_s"), F.col("parsed").alias("_p"), F.col("pred_is_evasive").alias("_e"))
    met = gold.join(p, F.col(index) == F.col("_i"), "left")
    missing = F.col("_i").isNull() | (F.abs(F.col("_s") - F.col(START)) > apart)
    said = F.when(missing, F.lit(None).cast("boolean")).otherwise(F.coalesce(F.col("_p") & F.col("_e"), F.lit(False)))
    return met.withColumns({"missing": missing, "pred": said}).drop("_i", "_s", "_p", "_e")


def review_table(raw: DataFrame, reviewed: DataFrame, gold: DataFrame, second: DataFrame | None = None, by: str = "tolerance", threshold: float = 0.5) -> DataFrame:
    """stage, tp, fp, fn and rates of raw candidates, confirmed ones, and a second annotator's (all null if there is none)."""
    rows = review.scored(raw, gold, by, threshold).withColumn("stage", F.lit("raw"))
    rows = rows.unionByName(review.scored(review.gold_events(reviewed), gold, by, threshold).withColumn("stage", F.lit("confirmed")))
    if second is not None:
        return rows.unionByName(review.scored(review.gold_events(second), gold, by, threshold).withColumn("stage", F.lit("second")))
    nothing = raw.sparkSession.createDataFrame([("second",)], "stage string")
    return rows.unionByName(nothing, allowMissingColumns=True)


def window_means(events: DataFrame, samples: DataFrame, columns: Sequence[str], around: float, bucket: float = 10.0, time: str = "cts", keys: Sequence[str] = ("clip_id",), key: str = "event_id") -> DataFrame:
    """``events`` plus the mean of ``columns`` within ``around`` seconds of their middle, 0 where there are no samples."""
    mid = events.select(key, *keys, ((F.col(START) + F.col(END)) / 2).alias(START)).withColumn(END, F.col(START))
    met = intervals.interval_join(mid, samples.select(*keys, time, *columns), time, bucket, list(keys), around, around)
    means = met.groupBy(key).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return events.join(means, key, "left").withColumns({f"mean_{c}": F.coalesce(f"_{c}", F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def peaks_with_fallback(events: DataFrame, samples: DataFrame, columns: dict[str, float], widen: float, bucket: float = 10.0, time: str = "cts", keys: Sequence[str] = ("clip_id",), key: str = "event_id") -> DataFrame:
    """``events`` plus peak_<column>: the largest |value| in the event, else within ``widen`` seconds of it, else the column's constant."""
    span = events.select(key, *keys, START, END)
    names = list(columns)

    def peaks(around: float, tag: str) -> DataFrame:
        met = intervals.interval_join(span, samples.select(*keys, time, *names), time, bucket, list(keys), around, around)
        return met.groupBy(key).agg(*[F.max(F.abs(c)).alias(f"_{tag}_{c}") for c in names])

    met = events.join(peaks(0.0, "in"), key, "left").join(peaks(widen, "near"), key, "left")
    out = met.withColumns({f"peak_{c}": F.coalesce(f"_in_{c}", f"_near_{c}", F.lit(v)) for c, v in columns.items()})
    return out.drop(*[f"_{t}_{c}" for t in ("in", "near") for c in names])


def backfilled(df: DataFrame, fs: float, width: int, defaults: dict[str, float]) -> DataFrame:
    """Columns z_az, total_jerk and label: those that are there stay, those that can be computed are, others are constants."""
    has = set(df.columns)
    axes = [a for a in ("ax", "ay", "az") if a in has]
    if "total_jerk" not in has and len(axes) == 3:
        df = timeseries.gradient(df, axes, 1 / fs, "_j_").withColumn("total_jerk", timeseries.magnitude("_j_ax", "_j_ay", "_j_az")).drop("_j_ax", "_j_ay", "_j_az")
    if "z_az" not in has and "az" in has:
        df = timeseries.rolling_z(df, {"z_az": ("az", width)}, least=50, epsilon=1e-9)
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    if "label" not in has and {"z_az", "total_jerk"} <= set(df.columns):
        df = df.withColumn("label", peak_label(F.col("z_az"), F.col("total_jerk")))
    return df


def rider_dataset(gold: DataFrame, found: DataFrame, samples: DataFrame, columns: Sequence[str], apart: float = 2.0, each: int = 8, most: int = 30) -> DataFrame:
    """One table of training events: gold before found ones, thinned per category, means around the middle, ids 1 to n, clip bounds.

    Both have (clip_id, category, start_time, end_time). The result is short: at most ``most`` rows.
    """
    both = gold.withColumn("source", F.lit("gold")).unionByName(found.withColumn("source", F.lit("imu")))
    both = both.withColumn("mid", (F.col(START) + F.col(END)) / 2)
    kept = intervals.thinned(both, "mid", "category", [F.col("source") == "imu", F.col("mid")], apart, each)
    kept = kept.orderBy(F.col("source") == "imu", "category", "mid").limit(most)
    numbered = kept.withColumn("event_id", F.row_number().over(Window.orderBy(F.col("source") == "imu", "category", "mid")))  # ``most`` rows
    b = intervals.clip_bounds(F.col(START), F.col(END), "padded")
    return window_means(numbered, samples, columns, 3.0).withColumns({"clip_start": b["start"], "clip_end": b["end"]})


def pointer_set(events: DataFrame, folds: Sequence[str] = ("environment", "road_surface", "infrastructure")) -> DataFrame:
    """event_id and a struct (index, missed, clauses) for each fold struct (presence, cited_clause, retrieved)."""
    return events.select("event_id", *[citations.pointer_index(F.col(f"{f}.retrieved"), F.col(f"{f}.cited_clause"), F.col(f"{f}.presence")).alias(f) for f in folds])


def true_positives(predictions: DataFrame, gold: DataFrame, n: int, index: str = "event_idx") -> DataFrame:
    """The first ``n`` confirmed events that were predicted as such."""
    met = by_index(predictions, gold.where(review.decided(F.col("decision"))), index)
    return met.where("pred").orderBy(index).limit(n)


def compliance_summary(frames: DataFrame, compliant: str = "is_compliant") -> DataFrame:
    return frames.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col(compliant).cast("long")), F.lit(0)).alias("compliant"), F.coalesce(F.sum((~F.col(compliant)).cast("long")), F.lit(0)).alias("non_compliant"))
