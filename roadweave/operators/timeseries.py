"""Time-series operators over telemetry: one row a sample, ``clip_id`` and ``cts`` (seconds) as keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave.functions.storage import spread
from roadweave.operators.scans import BLOCK, carried, haloed, in_range, numbered, quantiles, ranged, short_keys, up_to_here, whole

CLIP, TIME = "clip_id", "cts"
#: Windows up to so many rows are plain frames within blocks; wider ones are merged from powers of two.
PLAIN = 64


def in_time(clip: str | Sequence[str] = CLIP, time: str = TIME):
    """Rows of a clip (or of several key columns) by time."""
    return Window.partitionBy(*([clip] if isinstance(clip, str) else clip)).orderBy(time)


def sample_rate(df: DataFrame, clip: str = CLIP, time: str = TIME, forced: float | None = None) -> DataFrame:
    """clip, fs: 1 / median step of each clip (or ``forced``); a rate that is not positive is null."""
    if forced is not None:
        return df.select(clip).distinct().withColumn("fs", F.lit(float(forced)))
    dealt = carried(ranged(df.select(clip, time), [clip], [time]), [clip], _last=(F.max(time), "max"))
    steps = dealt.select(clip, (F.col(time) - F.coalesce(F.lag(time).over(in_range(dealt, [clip])), F.col("_last"))).alias("_dt"))
    middle = df.select(clip).distinct().join(quantiles(steps, [clip], "_dt").withColumnRenamed(clip, "_clip"), F.col(clip).eqNullSafe(F.col("_clip")), "left")
    return middle.select(clip, F.when(F.col("q") > 0, F.try_divide(F.lit(1.0), F.col("q"))).alias("fs"))


def gradient(df: DataFrame, columns: Sequence[str], dt: float, prefix: str = "jerk_", clip: str = CLIP, time: str = TIME) -> DataFrame:
    """Central differences inside a clip, one-sided at its ends, for evenly spaced samples; one sample gives null."""
    values = F.struct(*columns)
    dealt = carried(ranged(df, [clip], [time]), [clip], _last=(F.max_by(values, "_pos"), "last"), _next=(F.min_by(values, "_pos"), "next"))
    w = in_range(dealt, [clip])

    def slope(c: str) -> Column:
        before, after = F.coalesce(F.lag(c).over(w), F.col("_last")[c]), F.coalesce(F.lead(c).over(w), F.col("_next")[c])
        return F.when(before.isNull(), (after - F.col(c)) / dt).when(after.isNull(), (F.col(c) - before) / dt).otherwise((after - before) / (2 * dt))

    return dealt.select(*df.columns, *[slope(c).alias(f"{prefix}{c}") for c in columns])


def magnitude(*columns: str) -> Column:
    """Euclidean length of a vector of columns."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c) * F.col(c)
    return F.sqrt(total)


def global_z(df: DataFrame, column: str, out: str = "z", clip: str = CLIP) -> DataFrame:
    """(x - mean) / sample deviation over a clip; 0 where the deviation is 0 or unknown.

    Mean and deviation are aggregated and joined, so a long clip is not sorted in one task.
    """
    stats = df.groupBy(F.col(clip).alias("_clip")).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_dev"))
    z = F.when(F.col("_dev") > 0, (F.col(column) - F.col("_mean")) / F.col("_dev")).otherwise(0.0)
    return df.join(stats, F.col(clip) == F.col("_clip"), "left").withColumn(out, z).drop("_clip", "_mean", "_dev")


def rolling_z_column(column: str, width: int, least: int = 1, epsilon: float = 0.0, clip: str | Sequence[str] = CLIP, time: str = TIME) -> Column:
    """Centred rolling z-score over ``width`` rows: rows -(width//2) to (width-1)//2, sample deviation.

    Null where fewer than ``least`` values are in the window, or the deviation (plus ``epsilon``) is 0.
    The plain window, for clips that one task can sort; ``rolling_z`` deals a clip to many.
    """
    w = in_time(clip, time).rowsBetween(-(width // 2), (width - 1) // 2)
    dev = F.stddev_samp(column).over(w) + F.lit(epsilon)
    z = F.try_divide(F.col(column) - F.avg(column).over(w), F.nullif(dev, F.lit(0.0)))
    return F.when(F.count(column).over(w) >= least, z)


def _merged(a: tuple, b: tuple) -> tuple:
    """Counts, means and squared deviations of two sets of values put together."""
    n = a[0] + b[0]
    apart, share = b[1] - a[1], b[0] / np.maximum(n, 1.0)
    return n, a[1] + apart * share, a[2] + b[2] + apart * apart * a[0] * share


def window_scores(x: np.ndarray, valid: np.ndarray, widths: Sequence[int], least: int = 1, epsilon: float = 0.0) -> list[np.ndarray]:
    """The rolling z-scores of one run of values for several widths; NaN where there is none.

    Count, mean and squared deviations of windows of 1, 2, 4, ... rows are put together to those of each
    width: no sums are subtracted, so what lies outside a window does not cost it digits.
    """
    side = max(widths)
    pad = lambda v: np.concatenate([np.zeros(side), v, np.zeros(side)])
    level = (pad(valid.astype(float)), pad(np.where(valid, x, 0.0)), np.zeros(len(x) + 2 * side))
    ahead = lambda part, by: tuple(np.concatenate([v[by:], np.zeros(by)]) for v in part) if by else part
    found: dict[int, tuple] = {}
    taken = dict.fromkeys(widths, 0)
    for bit in range(side.bit_length()):
        for width in widths:
            if width >> bit & 1:
                part = ahead(level, taken[width])
                found[width] = _merged(found[width], part) if width in found else part
                taken[width] += 1 << bit
        if (2 << bit) <= side:
            level = _merged(level, ahead(level, 1 << bit))
    out = []
    for width in widths:
        n, mean, squares = (v[side - width // 2 :][: len(x)] for v in found[width])
        with np.errstate(divide="ignore", invalid="ignore"):
            dev = np.sqrt(squares / (n - 1)) + epsilon
            out.append(np.where((n >= max(least, 2)) & (dev != 0) & valid, (x - mean) / dev, np.nan))
    return out


def _rolled(df: DataFrame, made: dict[str, tuple[str, int | None]], keys: list[str], time: str, least: int, epsilon: float, short: bool | None = None) -> DataFrame:
    """``df`` plus scores; a width of None is the column _w of the row."""
    plain = all(w is not None and w <= PLAIN for _, w in made.values())
    if short is None:
        short = short_keys(df, keys)
    if short and plain:
        return spread(df, *keys).withColumns({name: rolling_z_column(column, width, least, epsilon, keys, time) for name, (column, width) in made.items()})
    wide = F.greatest(*[F.col("_w") if w is None else F.lit(w) for _, w in made.values()], F.lit(1))
    size = F.greatest(F.lit(BLOCK), 4 * wide)
    dealt = haloed(numbered(df, keys, [time], short), size, F.floor(wide / 2), F.floor((wide - 1) / 2))
    kept = [f for f in df.schema.fields if f.name != "_w"]
    if plain:
        scores = {name: rolling_z_column(column, width, least, epsilon, [*keys, "_block"], "_i") for name, (column, width) in made.items()}
        return dealt.withColumns(scores).where("_own").select(*[f.name for f in kept], *made)
    schema = T.StructType(kept + [T.StructField(name, T.DoubleType()) for name in made])
    by_column: dict[str, list[tuple[str, int | None]]] = {}
    for name, (column, width) in made.items():
        by_column.setdefault(column, []).append((name, width))

    def score(block: pa.Table) -> pa.Table:
        order = np.argsort(block.column("_i").to_numpy(), kind="stable")
        scores = {}
        for column, wanted in by_column.items():
            values = block.column(column).combine_chunks().cast(pa.float64())
            valid = values.is_valid().to_numpy(zero_copy_only=False)[order]
            x = values.fill_null(0.0).to_numpy(zero_copy_only=False)[order]
            widths = [int(block.column("_w")[0].as_py()) if w is None else w for _, w in wanted]
            for (name, _), z in zip(wanted, window_scores(x, valid, widths, least, epsilon), strict=True):
                placed = np.empty(len(z))
                placed[order] = z
                gone = np.empty(len(z), bool)
                gone[order] = np.isnan(z) & ~np.isnan(x) | ~valid
                scores[name] = pa.array(placed, mask=gone)
        out = block.select([f.name for f in kept])
        for name in made:
            out = out.append_column(name, scores[name])
        return out.filter(block.column("_own"))

    return dealt.groupBy(*keys, "_block").applyInArrow(score, schema)


def rolling_z(df: DataFrame, made: dict[str, tuple[str, int]], clip: str | Sequence[str] = CLIP, time: str = TIME, least: int = 1, epsilon: float = 0.0, short: bool | None = None) -> DataFrame:
    """``df`` plus centred rolling z-scores: ``made`` names (column, width) for each new column.

    The windows of ``rolling_z_column``, for clips of any length: blocks of a clip's rows, with the rows
    around them that windows reach, are tasks of their own; windows wider than PLAIN cost the logarithm
    of their width. A window's score depends on nothing outside it. ``short``: as in ``scans``.
    """
    return _rolled(df, dict(made), [clip] if isinstance(clip, str) else list(clip), time, least, epsilon, short)


def rolling_z_by_clip(df: DataFrame, column: str, widths: DataFrame, out: str = "z", clip: str = CLIP, time: str = TIME) -> DataFrame:
    """The same with a width for each clip (``widths``: clip, width); clips without one are left out."""
    base = df.join(widths.select(F.col(clip).alias("_c"), F.col("width").cast("long").alias("_w")), F.col(clip) == F.col("_c")).drop("_c")
    return _rolled(base, {out: (column, None)}, [clip], time, 1, 0.0)


def fill_both(df: DataFrame, columns: Sequence[str], clip: str = CLIP, time: str = TIME) -> DataFrame:
    """Nulls take the last known value, at a clip's beginning the next one."""
    there = lambda c: F.when(F.col(c).isNotNull(), F.col("_pos"))
    parts = {f"_last_{c}": (F.max_by(c, there(c)), "last") for c in columns} | {f"_next_{c}": (F.min_by(c, there(c)), "next") for c in columns}
    dealt = carried(ranged(df, [clip], [time]), [clip], **parts)
    later = Window.partitionBy("_range", clip).orderBy(F.desc("_pos")) if whole(dealt) is None else Window.partitionBy(clip).orderBy(F.desc(time))
    back, ahead = up_to_here(dealt, [clip]), later.rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, True).over(back), F.col(f"_last_{c}"), F.last(c, True).over(ahead), F.col(f"_next_{c}")) for c in columns}
    return dealt.withColumns(filled).select(*df.columns)


def asof_nearest(left: DataFrame, right: DataFrame, values: Sequence[str], tolerance: float, clip: str | None = CLIP, time: str = TIME) -> DataFrame:
    """Each left row with ``values`` of the right row nearest in time, at most ``tolerance`` away.

    Ties go to the earlier right row; of right rows at one time the last (by its values) counts. Both
    sides are merged by time; with a coarse time cell as second key, of which each right row also
    stands in the neighbouring ones, no task holds a whole clip.
    """
    cell = max(tolerance * 64, 1e-9)
    keys = [clip] if clip else []
    at = F.floor(F.col(time) / cell)
    one = right.groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v"))
    near = F.explode(F.array_distinct(F.array(F.floor((F.col(time) - tolerance) / cell), at, F.floor((F.col(time) + tolerance) / cell))))
    r = one.select(*keys, time, near.alias("_cell"), F.struct(F.col(time).alias("t"), "_v").alias("_r"))
    rows = left.withColumns({"_cell": at, "_row": F.struct(*left.columns)}).select(*keys, time, "_cell", "_row")
    both = rows.withColumns({"_r": F.lit(None).cast(r.schema["_r"].dataType), "_side": F.lit(1)}).unionByName(r.withColumns({"_row": F.lit(None).cast(rows.schema["_row"].dataType), "_side": F.lit(0)}))
    w = Window.partitionBy(*keys, "_cell")
    before = F.last("_r", True).over(w.orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0))
    # Read backwards, as a frame that ends at the row grows by it; one that begins there is read again for every row.
    after = F.last("_r", True).over(w.orderBy(F.desc(time), "_side").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"_b": before, "_a": after}).where("_side = 1")
    back, ahead = F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col(time)
    pick = F.when((back <= tolerance) & (ahead.isNull() | (back <= ahead)), F.col("_b._v")).when(ahead <= tolerance, F.col("_a._v"))
    return met.withColumn("_pick", pick).select("_row.*", *[F.col(f"_pick.{v}").alias(v) for v in values])


def aligned(left: DataFrame, right: DataFrame, tolerance: float = 1e-8, relative: float = 1e-5, clip: str = CLIP, time: str = TIME, order: Sequence[str] | None = None) -> DataFrame:
    """Two streams joined by sample number; rows whose times differ, or that lack a partner, are marked ``misaligned``.

    Samples of ``right`` are numbered by its columns ``order`` (which are not kept), else by time as those of
    ``left``: a clock that is off may pass the next sample's. A row without a partner keeps its clip.
    """
    a = numbered(left, [clip], [time]).drop("_n")
    b = numbered(right, [clip], list(order or [time])).drop("_n", *[c for c in order or [] if c != time]).withColumnRenamed(time, "_time").withColumnRenamed(clip, "_clip")
    met = a.join(b, (F.col(clip) == F.col("_clip")) & (a["_i"] == b["_i"]), "full").withColumn(clip, F.coalesce(clip, "_clip")).drop("_i", "_clip")
    off = F.abs(F.col(time) - F.col("_time")) > tolerance + relative * F.abs(F.col("_time"))
    return met.withColumn("misaligned", F.coalesce(off, F.lit(True))).drop("_time")


def snr_db(df: DataFrame, raw: str, filtered: str, clip: str = CLIP) -> DataFrame:
    """clip, snr_db: 10 log10 of the variance of raw over filtered values; null if either is not positive."""
    v = df.groupBy(clip).agg(F.var_pop(raw).alias("_r"), F.var_pop(filtered).alias("_f"))
    return v.select(clip, F.when((F.col("_r") > 0) & (F.col("_f") > 0), 10 * F.log10(F.col("_r") / F.col("_f"))).alias("snr_db"))


def video_time(seconds: Column) -> Column:
    """``mm:ss.s`` of seconds since the clip's start; null without them.

    Tenths are rounded by the number's exact value, a tie to the even one, as C does; ``format_string``
    rounds its shortest decimal writing, 0.15 (a little less) to 0.2. The part of a second, times 2^58, is a whole
    number (what is lost below 2^-6 is far from the first 0.05), and ten times it fits a long.
    """
    rest = seconds - 60 * F.floor(seconds / 60)
    scaled = ((rest - F.floor(rest)) * F.lit(float(1 << 58))).cast("long") * 10
    tenths = F.floor(rest) * 10 + F.shiftright(scaled, 58)
    left = scaled.bitwiseAND(F.lit((1 << 58) - 1))
    half = F.lit(1 << 57)
    rounded = tenths + ((left > half) | ((left == half) & (tenths % 2 == 1))).cast("long")
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d.%d", F.floor(seconds / 60).cast("int"), F.floor(rounded / 10), rounded % 10))


def quality_profile(df: DataFrame, columns: Sequence[str], clip: str = CLIP) -> DataFrame:
    """clip, column, n_null, n_inf, n_negative, least, most of finite values, and whether they hardly vary."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    long = df.selectExpr(clip, f"stack({len(columns)}, {pairs}) as (column, v)")
    gone, inf = F.col("v").isNull() | F.isnan("v"), F.abs("v") == float("inf")
    fine = F.when(~gone & ~inf, F.col("v"))
    return long.groupBy(clip, "column").agg(
        F.sum(gone.cast("long")).alias("n_null"), F.sum(F.coalesce(inf, F.lit(False)).cast("long")).alias("n_inf"),
        F.sum(F.coalesce(fine < 0, F.lit(False)).cast("long")).alias("n_negative"), F.min(fine).alias("least"), F.max(fine).alias("most"),
        F.coalesce(F.stddev_pop(fine) < 1e-6, F.lit(True)).alias("flat"),
    )
