"""Interval operators: joins of intervals and points, merging, grouping, matching, clip bounds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.storage import stored
from roadweave.operators.scans import carried, in_range, ranged, up_to_here
from roadweave.operators.timeseries import CLIP

START, END = "start_time", "end_time"


def interval_join(events: DataFrame, points: DataFrame, point: str, bucket: float, keys: Sequence[str] = (), before: float = 0.0, after: float = 0.0, how: str = "inner") -> DataFrame:
    """Pairs of an event and a point in [start - before, end + after], both ends included.

    Events stand in every time bucket that they touch, a point in its one, so pairs are found by an
    equi-join and each just once. ``how`` may be ``left``: events without points stay, once. Points
    without time are dropped. Column names must differ but for ``keys``.
    """
    lo, hi = F.col(START) - before, F.col(END) + after
    e = events.withColumn("_eid", F.monotonically_increasing_id()) if how == "left" else events
    spread = e.where(lo <= hi).withColumn("_bucket", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    p = points.where(F.col(point).isNotNull()).withColumn("_bucket", F.floor(F.col(point) / bucket))
    met = spread.join(p, [*keys, "_bucket"]).where((F.col(point) >= lo) & (F.col(point) <= hi)).drop("_bucket")
    if how == "inner":
        return met
    rest = [c for c in points.columns if c not in keys]
    return e.join(met.select("_eid", *rest), "_eid", "left").drop("_eid")


def merge_intervals(events: DataFrame, gap: float = 0.0, clip: str = CLIP, short: bool | None = None) -> DataFrame:
    """clip, event_no, start_time, end_time: intervals whose start is at most ``gap`` after the running end are one."""
    return grouped_by_gap(events, gap, [clip], short).groupBy(clip, F.col("group_no").alias("event_no")).agg(F.min(START).alias(START), F.max(END).alias(END))


def grouped_by_gap(events: DataFrame, gap: float, keys: Sequence[str] = (CLIP,), short: bool | None = None) -> DataFrame:
    """``events`` plus group_no: a new group where a start is more than ``gap`` after all earlier ends of its key.

    Ranges of (keys, start) are tasks; each takes the running end, and then the number of groups, of
    those before it. Without ``keys`` the whole table is one key. ``short``: as in ``scans``.
    """
    keys = list(keys)
    dealt = carried(ranged(events, keys, [START, END], short), keys, _reach=(F.max(END), "max"))
    reach = F.greatest(F.max(END).over(in_range(dealt, keys).rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    marked = dealt.withColumn("_new", F.coalesce((F.col(START) - reach > gap).cast("int"), F.lit(1)))
    counted = carried(marked, keys, _groups=(F.sum("_new"), "sum"))
    return counted.select(*events.columns, (F.sum("_new").over(up_to_here(marked, keys)) + F.col("_groups")).cast("int").alias("group_no"))


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull, 0 where the hull has no length."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    overlap = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    return F.when(hull > 0, overlap / hull).otherwise(0.0)


def matched(pred: DataFrame, gold: DataFrame, by: str = "tiou", threshold: float = 0.5, keys: Sequence[str] = (CLIP,), bucket: float | None = None) -> DataFrame:
    """``keys``, pred_start, gold_start of the pairs that greedy one-to-one matching makes.

    Predictions take, in time order, their best unused gold event: the largest tIoU (``by="tiou"``, at
    least ``threshold``) or the nearest middle (``by="tolerance"``, at most ``threshold`` away); ties to
    the earlier gold. A best that fails uses nothing up, so only passing pairs are joined; pairs that
    share no event with others are matches at once, the rest is resolved within connected time blocks.
    """
    p = pred.select(*keys, F.col(START).alias("ps"), F.col(END).alias("pe"))
    g = gold.select(*keys, F.col(START).alias("gs"), F.col(END).alias("ge"))
    if by == "tiou":
        score = tiou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge"))
        passing, reach = score >= threshold, 0.0
    else:
        score = -F.abs((F.col("ps") + F.col("pe")) / 2 - (F.col("gs") + F.col("ge")) / 2)
        passing, reach = score >= -threshold, threshold
    if not bucket and by == "tiou":
        # Twice the mean length: the rows that all intervals make are then about as many as the intervals, however long they are.
        mean = p.select((F.col("pe") - F.col("ps")).alias("d")).unionByName(g.select((F.col("ge") - F.col("gs")).alias("d"))).agg(F.avg("d")).collect()[0][0]
        bucket = max(1.0, 2 * (mean or 0.0))
    width = F.lit(bucket if bucket else max(1.0, 4 * reach))
    # Both sides stand in all buckets that they (or their widened middles) touch; the pair counts in the first shared one.
    def ends(s: str, e: str) -> tuple[Column, Column]:
        if by == "tiou":
            return F.floor(F.col(s) / width), F.floor(F.col(e) / width)
        mid = (F.col(s) + F.col(e)) / 2
        return F.floor((mid - reach) / width), F.floor((mid + reach) / width)

    (plo, phi), (glo, ghi) = ends("ps", "pe"), ends("gs", "ge")
    left = p.withColumns({"_lo": plo, "_b": F.explode(F.sequence(plo, phi))})
    right = g.withColumns({"_lo2": glo, "_b": F.explode(F.sequence(glo, ghi))})
    pairs = left.join(right, [*keys, "_b"]).where((F.col("_b") == F.greatest("_lo", "_lo2")) & passing).withColumn("score", score)
    pairs = stored(pairs.select(*keys, "ps", "pe", "gs", "ge", "score"), "match-pairs")
    blocks = grouped_by_gap(pairs.withColumns({START: F.least("ps", "gs") - reach, END: F.greatest("pe", "ge") + reach}), 0.0, keys)

    def resolve(block: pa.Table) -> pa.Table:
        """Predictions in time order, each with its free gold event of the best score; over sorted arrays."""
        ps, pe, gs, ge, score = (block.column(c).to_numpy() for c in ("ps", "pe", "gs", "ge", "score"))
        golden = np.unique(np.stack([gs, ge], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((ge, gs, -score, pe, ps))
        first = np.concatenate([[True], (np.diff(ps[order]) != 0) | (np.diff(pe[order]) != 0)])
        taken, waiting, made = bytearray(len(golden)), False, []
        for at, begins, g in zip(order.tolist(), first.tolist(), golden[order].tolist(), strict=True):
            waiting |= begins
            if waiting and not taken[g]:
                taken[g], waiting = 1, False
                made.append(at)
        rows = block.select([*keys, "ps", "gs"]).take(pa.array(made, pa.int64()))
        return rows.rename_columns([*keys, "pred_start", "gold_start"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pred.select(*keys).schema)
    one_p, one_g = Window.partitionBy(*keys, "ps", "pe"), Window.partitionBy(*keys, "gs", "ge")
    counted = blocks.withColumns({"_np": F.count(F.lit(1)).over(one_p), "_ng": F.count(F.lit(1)).over(one_g)})
    tangled = F.max(F.greatest("_np", "_ng")).over(Window.partitionBy(*keys, "group_no")) > 1
    marked = counted.withColumn("_tangled", tangled)
    plain = marked.where("not _tangled").select(*keys, F.col("ps").alias("pred_start"), F.col("gs").alias("gold_start"))
    rest = marked.where("_tangled").select(*keys, "group_no", "ps", "pe", "gs", "ge", "score")
    return plain.unionByName(rest.groupBy(*keys, "group_no").applyInArrow(resolve, f"{fields}, pred_start double, gold_start double"))


def clip_bounds(start: Column, end: Column, variant: str = "a") -> Column:
    """struct(start, end) of the clip cut for an event.

    a: at least 1 s, centre +- 0.5. b: an end not after the start is start + 2, then a. c: under 0.05 s
    padded by 0.5 s. padded: 1.5 s on both sides. Starts are not below 0.
    """
    zero = F.lit(0.0)
    if variant == "b":
        end = F.when(end <= start, start + 2.0).otherwise(end)
    if variant in ("a", "b"):
        mid, short = (start + end) / 2, end - start < 1.0
        return F.struct(F.when(short, F.greatest(zero, mid - 0.5)).otherwise(start).alias("start"), F.when(short, mid + 0.5).otherwise(end).alias("end"))
    if variant == "c":
        short = end - start < 0.05
        return F.struct(F.when(short, F.greatest(zero, start - 0.5)).otherwise(start).alias("start"), F.when(short, end + 0.5).otherwise(end).alias("end"))
    if variant == "padded":
        return F.struct(F.greatest(zero, start - 1.5).alias("start"), (end + 1.5).alias("end"))
    raise ValueError(f"unknown variant {variant}")


def thinned(events: DataFrame, mid: str, category: str, order: Sequence[Column], apart: float = 2.0, most: int = 8) -> DataFrame:
    """Per category, in ascending ``order``, events not within ``apart`` of a kept one, until ``most`` are kept.

    Each round keeps the first open event of every category (a minimum that tasks take over their own
    events first); events within ``apart`` of a kept one are closed. No category is sorted or held by
    a task; the kept middles, ``most`` a category, are what rounds hand on. Events without a middle are
    left out; of events alike in ``order`` a hash of the row comes first.
    """
    row = {f"_o{i}": c for i, c in enumerate(order)} | {"_h": F.xxhash64(*[F.col(c) for c in events.columns]), "_row": F.monotonically_increasing_id()}
    placed = stored(events.where(F.col(mid).isNotNull()).withColumns(row), "thinning")
    key = F.struct(*row, F.col(mid).cast("double").alias("_m"))
    every = placed.select(F.col(category).alias("_k"), key.alias("_e"))
    kept = None
    for _ in range(most):
        open_ = every
        if kept is not None:
            near = kept.groupBy(F.col("_k").alias("_fk")).agg(F.collect_list("_f._m").alias("_ms"))  # ``most`` entries at most
            met = every.join(near, F.col("_k").eqNullSafe(F.col("_fk")))
            open_ = met.where(~F.exists("_ms", lambda m: F.abs(F.col("_e._m") - m) <= apart))
        first = stored(open_.groupBy("_k").agg(F.min("_e").alias("_f")), "thinning-kept")  # a row a category
        kept = first if kept is None else kept.unionByName(first)
        if first.isEmpty():
            break
    return placed.join(kept.select(F.col("_f._row").alias("_row")), "_row", "left_semi").select(*events.columns) if kept is not None else events.limit(0)


def down_sampled(rows: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows a group, evenly spaced from the first to the last (indices truncated)."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    numbered = rows.withColumns({"_i": i, "_n": n})
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(max(most - 1, 1)) + F.lit(1e-9)))
    return numbered.where((F.col("_n") <= most) | F.array_contains(at, F.col("_i").cast("long"))).drop("_i", "_n")
