"""Detection of candidate events: thresholds, strategies, runs of flags, and their aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.storage import stored
from roadweave.operators.intervals import merge_intervals
from roadweave.operators.scans import combined, handed, in_range, quantiles, ranged, short_keys, up_to_here, whole
from roadweave.operators.timeseries import CLIP, TIME, rolling_z


def moving(speed: Column, least: float = 2.0) -> Column:
    return F.coalesce(speed > least, F.lit(False))


def confidence(z: Column, flag: Column) -> Column:
    """|z| / 6 within 0 and 1 where flagged, else 0."""
    return F.when(flag, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(z) / 6))).otherwise(0.0)


def flags_to_events(df: DataFrame, flag: Column, gap: float = 1.0, extra: Sequence[Column] = (), clip: str = CLIP, time: str = TIME, short: bool | None = None) -> DataFrame:
    """clip, event_no, start_time, end_time and ``extra`` aggregates of each run of flagged samples.

    A run ends where the next flagged sample is more than ``gap`` seconds later. Runs are numbered from 1.
    ``short``: as in ``scans``, of all samples.
    """
    flagged = df.where(F.coalesce(flag, F.lit(False)))
    if not extra:
        flagged = flagged.select(clip, time)  # what is stored and dealt
    if not short:
        flagged = stored(flagged, "flagged")
    dealt = ranged(flagged, [clip], [time], short)
    apart = F.col(time) - F.lag(time).over(in_range(dealt, [clip]))
    marked = dealt.withColumn("_new", F.when(apart.isNotNull(), (apart > gap).cast("int")))
    within = F.coalesce(F.sum("_new").over(up_to_here(marked, [clip])), F.lit(0))
    if whole(dealt) is not None:
        runs = marked.withColumn("event_no", (within + 1).cast("int"))
    else:
        # Of a range's samples only the first can't tell by itself whether it begins a run.
        per = marked.groupBy("_range", clip).agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.coalesce(F.sum("_new"), F.lit(0)).alias("_within"))
        begins = F.coalesce((F.col("_first") - combined(F.col("_last"), "max", [clip]) > gap).cast("int"), F.lit(1))
        per = per.withColumn("_begins", begins)
        met = handed(marked, per, [clip], {"_begins": F.col("_begins"), "_runs": combined(F.col("_within") + F.col("_begins"), "sum", [clip])})
        runs = met.withColumn("event_no", (F.col("_runs") + F.col("_begins") + within).cast("int"))
    return runs.groupBy(clip, "event_no").agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), *extra)


def candidate_aggregates(z: str = "z") -> list[Column]:
    """Samples, peak confidence and peak |z| of a run."""
    peak = F.max(F.abs(F.col(z)))
    return [F.count(F.lit(1)).alias("n_samples"), F.max(F.least(F.lit(1.0), F.abs(F.col(z)) / 6)).alias("peak_confidence"), peak.alias("peak_abs_z")]


def candidate_events(df: DataFrame, column: str, width: int, k: float, gap: float) -> DataFrame:
    """The flagship: rolling z-score, threshold, runs, aggregates."""
    short = short_keys(df, [CLIP])
    z = rolling_z(df.select(CLIP, TIME, column), {"z": (column, width)}, short=short)
    return flags_to_events(z, F.abs("z") > k, gap, candidate_aggregates(), short=short)


def votes(columns: Sequence[str], k: float) -> Column:
    """How many of the z columns exceed ``k``."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce((F.abs(F.col(c)) > k).cast("int"), F.lit(0))
    return total


def speed_scaled_k(speed: Column, k: float) -> Column:
    """k by speed bin: up to 20 km/h 0.8, up to 60 1.0, above 1.3; outside the bins null."""
    s = F.coalesce(speed, F.lit(0.0))
    return F.when((s > -1) & (s <= 20), 0.8 * k).when((s > 20) & (s <= 60), 1.0 * k).when((s > 60) & (s <= 1e9), 1.3 * k)


def _scores(columns: Sequence[str], width: int) -> list[str]:
    return [f"_z_{c}_{width}" for c in columns]


def _with_rolling(df: DataFrame, columns: Sequence[str], width: int, short: bool) -> DataFrame:
    """``df`` plus its rolling scores, but for those that are there."""
    made = {name: (c, width) for name, c in zip(_scores(columns, width), columns, strict=True) if name not in df.columns}
    return rolling_z(df, made, short=short) if made else df


def _scored_columns(strategy: str, options: dict) -> list[str]:
    """The columns whose rolling scores a strategy asks for."""
    return {"fixed_global": [], "adaptive_single": [options.get("column", "total")]}.get(strategy, list(options.get("columns", [])))


def _read_columns(strategy: str, options: dict) -> list[str] | None:
    """The columns that a strategy reads beside clip, time and scores; None: not known (a user's own strategy)."""
    plain = dict.fromkeys(("adaptive_single", "adaptive_any", "adaptive_fusion", "adaptive_fusion_merged"), [])
    return ({"fixed_global": [options.get("z", "z")], "adaptive_fusion_speed": [options.get("speed", "speed_kmh")]} | plain).get(strategy)


def scored_once(df: DataFrame, settings: Sequence[tuple[str, dict]]) -> DataFrame:
    """``df`` with the rolling scores that several strategies (name, options) ask for, made in one pass and stored.

    Of its other columns those are kept that a strategy reads. Scores that ``df`` has are taken as they are.
    """
    asked, read = {}, []
    for strategy, options in settings:
        columns, own = _scored_columns(strategy, options), _read_columns(strategy, options)
        asked |= {name: (c, options["width"]) for name, c in zip(_scores(columns, options.get("width")), columns, strict=True)} if columns else {}
        read += df.columns if own is None else own
    new = {name: source for name, source in asked.items() if name not in df.columns}
    if asked and not new:
        return df
    kept = [c for c in df.columns if c in (CLIP, TIME, *read, *asked)]
    sources = [c for c in df.columns if c not in kept and c in {c for c, _ in new.values()}]
    df = stored(df.select(*kept, *sources), "samples")  # read several times: rows, bounds, ranges
    return stored(rolling_z(df, new).select(*kept, *new), "strategy-scores") if new else df


def fixed_global(df: DataFrame, gap: float, k: float = 3.0, z: str = "z", **_: object) -> DataFrame:
    return flags_to_events(df, F.abs(F.col(z)) > k, gap, short=short_keys(df, [CLIP]))


def adaptive_single(df: DataFrame, gap: float, width: int, k: float = 3.0, column: str = "total", **_: object) -> DataFrame:
    return adaptive_any(df, gap, width, [column], k)


def adaptive_any(df: DataFrame, gap: float, width: int, columns: Sequence[str], k: float = 3.0, **_: object) -> DataFrame:
    return adaptive_fusion(df, gap, width, columns, k, 1)


def adaptive_fusion(df: DataFrame, gap: float, width: int, columns: Sequence[str], k: float = 3.0, channels: int = 2, **_: object) -> DataFrame:
    short = short_keys(df, [CLIP])
    return flags_to_events(_with_rolling(df, columns, width, short), votes(_scores(columns, width), k) >= channels, gap, short=short)


def adaptive_fusion_merged(df: DataFrame, gap: float, **options: object) -> DataFrame:
    return merge_intervals(adaptive_fusion(df, gap, **options), short=short_keys(df, [CLIP]))


def adaptive_fusion_speed(df: DataFrame, gap: float, width: int, columns: Sequence[str], k: float = 3.0, channels: int = 2, speed: str = "speed_kmh", **_: object) -> DataFrame:
    """Fusion with one k a clip: the median of its rows' speed-scaled k, or ``k`` where none has one."""
    short = short_keys(df, [CLIP])
    scaled = quantiles(df.select(CLIP, speed_scaled_k(F.col(speed), k).alias("_v")), [CLIP], "_v")
    z = _with_rolling(df, columns, width, short).join(scaled.select(F.col(CLIP).alias("_clip"), F.col("q").alias("_k")), F.col(CLIP) == F.col("_clip"), "left").fillna(k, ["_k"])
    total = F.lit(0)
    for c in _scores(columns, width):
        total = total + F.coalesce((F.abs(F.col(c)) > F.col("_k")).cast("int"), F.lit(0))
    return merge_intervals(flags_to_events(z, total >= channels, gap, short=short), short=short)


#: Strategies by name; users add their own.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "fixed_global": fixed_global,
    "adaptive_single": adaptive_single,
    "adaptive_any": adaptive_any,
    "adaptive_fusion": adaptive_fusion,
    "adaptive_fusion_merged": adaptive_fusion_merged,
    "adaptive_fusion_speed": adaptive_fusion_speed,
}
