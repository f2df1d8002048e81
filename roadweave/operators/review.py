"""Review and ablation: gold events from decisions, scores of detectors, parameter grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.storage import stored
from roadweave.operators.intervals import END, START, matched
from roadweave.operators.scans import quantiles
from roadweave.operators.timeseries import CLIP, TIME, rolling_z


def decided(decision: Column, wanted: str = "confirm") -> Column:
    return F.lower(F.trim(decision)) == wanted


def adjusted(value: Column, base: Column) -> Column:
    """The reviewer's bound where one is given, else the detected one."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("double"), base)


def gold_events(reviewed: DataFrame) -> DataFrame:
    """clip, start_time, end_time of confirmed candidates, with the reviewer's bounds where given."""
    has = set(reviewed.columns)
    start = adjusted(F.col("adjusted_start"), F.col(START)) if "adjusted_start" in has else F.col(START)
    end = adjusted(F.col("adjusted_end"), F.col(END)) if "adjusted_end" in has else F.col(END)
    return reviewed.where(decided(F.col("decision"))).select(CLIP, start.alias(START), end.alias(END))


def offset_calibration(reviewed: DataFrame) -> DataFrame:
    """One row: mean |offset| of confirmed starts, shares over 1 and 0.5 s, the median offset, and the mean after taking it off."""
    d = reviewed.where(decided(F.col("decision"))).select((adjusted(F.col("adjusted_start"), F.col(START)) - F.col(START)).alias("d"))
    middle = quantiles(d, [], "d").select(F.col("q").alias("m"))
    share = lambda over: 100 * F.avg((F.abs("d") > over).cast("double"))
    return d.crossJoin(middle).agg(  # one row
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("d")).alias("mean_abs"), share(1.0).alias("pct_over_1"), share(0.5).alias("pct_over_half"),
        F.first("m").alias("median_offset"), F.avg(F.abs(F.col("d") - F.col("m"))).alias("mean_abs_after"),
    )


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1, fp_rate: null where a denominator is 0, f1 0 where both rates are."""
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    f1 = F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1"), F.try_divide(fp.cast("double"), tp + fp).alias("fp_rate")]


def scored(pred: DataFrame, gold: DataFrame, by: str = "tiou", threshold: float = 0.5, config: Sequence[str] = ()) -> DataFrame:
    """``config``, tp, fp, fn and rates, pooled over the clips that have gold events.

    With ``config`` columns in ``pred`` every configuration is scored against the same gold events in one job.
    Events are few and made at some cost, and are read several times here: both sides are stored.
    """
    pred = stored(pred.select(*config, CLIP, START, END), "scored-pred")
    gold = stored(gold.select(CLIP, START, END), "scored-gold")
    return _scored(pred, gold, by, threshold, config)


def _scored(pred: DataFrame, gold: DataFrame, by: str, threshold: float, config: Sequence[str]) -> DataFrame:
    """``scored`` over stored tables."""
    clips = gold.select(CLIP).distinct()
    inside = pred.join(clips, CLIP, "left_semi")
    n_gold = gold.agg(F.count(F.lit(1)).alias("ng"))
    if config:
        every = gold.select(CLIP, START, END).crossJoin(F.broadcast(pred.select(*config).distinct()))  # the configurations are a parameter table
        pairs = matched(inside, every, by, threshold, [*config, CLIP])
    else:
        pairs = matched(inside, gold, by, threshold)
    tp = pairs.groupBy(*config).agg(F.count(F.lit(1)).alias("tp"))
    np_ = inside.groupBy(*config).agg(F.count(F.lit(1)).alias("np"))
    both = np_.join(tp, list(config), "left") if config else np_.crossJoin(tp)
    both = both.crossJoin(n_gold).withColumn("tp", F.coalesce("tp", F.lit(0)))  # single-row scalar
    t = both.select(*config, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))
    return t.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def grid_events(df: DataFrame, columns: Sequence[str], widths: Sequence[int], ks: Sequence[float], channels: Sequence[int], gap: float) -> DataFrame:
    """Events of every configuration (width, k, channels): windows and runs in one pass over the samples."""
    from roadweave.operators.filters import bank_runs

    return bank_runs(df, columns, 1.0, [(None, None, 0)], widths, ks, channels, gap).drop("setting")


def runs_of_grid(scores: DataFrame, columns: int, ks: Sequence[float], channels: Sequence[int], gap: float, config: Sequence[str]) -> DataFrame:
    """Events of ``scores`` (``config``, clip, time, _z0, ...) for every k and number of channels."""
    grid = scores.sparkSession.createDataFrame([(float(k), int(c)) for k in ks for c in channels], "k double, channels int")
    votes = F.lit(0)
    for i in range(columns):
        votes = votes + (F.col(f"_z{i}") > F.col("k")).cast("int")
    flagged = scores.crossJoin(F.broadcast(grid)).where(votes >= F.col("channels"))
    keys = [*config, "k", "channels", CLIP]
    w = Window.partitionBy(*keys).orderBy(TIME)
    new = F.coalesce((F.col(TIME) - F.lag(TIME).over(w) > gap).cast("int"), F.lit(1))
    runs = flagged.withColumn("_new", new).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_no").agg(F.min(TIME).alias(START), F.max(TIME).alias(END)).drop("_no")


def grid_search(df: DataFrame, gold: DataFrame, columns: Sequence[str], widths: Sequence[int], ks: Sequence[float], channels: Sequence[int], gap: float, by: str = "tolerance", threshold: float = 0.5) -> DataFrame:
    """Scores of all configurations in one job."""
    events = grid_events(df, columns, widths, ks, channels, gap)
    return scored(events, gold, by, threshold, ["width", "k", "channels"])


def score_table(events: DataFrame, gold: DataFrame, config: Sequence[str], overlap: float = 0.5, tolerance: float = 0.5) -> DataFrame:
    """``config``, n_pred, precision, recall, f1, fp_rate by tIoU, and f1_tolerance: one row a configuration, in one job."""
    events, gold = stored(events.select(*config, CLIP, START, END), "scored-pred"), stored(gold.select(CLIP, START, END), "scored-gold")
    by_overlap = _scored(events, gold, "tiou", overlap, config)
    near = _scored(events, gold, "tolerance", tolerance, config).select(*config, F.col("f1").alias("f1_tolerance"))
    return by_overlap.select(*config, (F.col("tp") + F.col("fp")).alias("n_pred"), "precision", "recall", "f1", "fp_rate").join(near, list(config))


def strategy_table(df: DataFrame, gold: DataFrame, settings: Sequence[tuple[str, str, dict]], overlap: float = 0.5, tolerance: float = 0.5) -> DataFrame:
    """The score table of detection strategies: ``settings`` are (name, strategy, its options). Their rolling scores are made in one pass."""
    from roadweave.operators.detect import STRATEGIES, scored_once

    df = scored_once(df, [(strategy, options) for _, strategy, options in settings])
    parts = [STRATEGIES[strategy](df, **options).select(CLIP, START, END).withColumn("config", F.lit(name)) for name, strategy, options in settings]
    return score_table(reduce(DataFrame.unionByName, parts), gold, ["config"], overlap, tolerance)


def filter_table(df: DataFrame, gold: DataFrame, settings: Sequence[tuple[str, float | None, float | None, int]], columns: Sequence[str], fs: float, width: int, k: float, gap: float, overlap: float = 0.5, tolerance: float = 0.5) -> DataFrame:
    """The score table of filter settings (name, low, high, order) under one detector (the length of the filtered axes), with mean_snr_db.

    The mean is over clips and axes; a setting without filter has 0 dB.
    """
    from roadweave.operators.filters import filtered_bank
    from roadweave.operators.timeseries import magnitude

    numbers = range(len(settings))
    bank = filtered_bank(df.select(CLIP, TIME, *columns), columns, fs, [(low, high, order) for _, low, high, order in settings], [f"_f{j}" for j in numbers])
    bank = stored(bank, "filter-bank")  # read twice: variances, windows
    # One group a sample passes: all settings are one key of the runs.
    totals = bank.select(CLIP, TIME, *[magnitude(*[f"{c}_f{j}" for c in columns]).alias(f"_total{j}") for j in numbers])
    z = rolling_z(totals, {f"_z{j}": (f"_total{j}", width) for j in numbers})
    each = z.select(CLIP, TIME, F.explode(F.array(*[F.struct(F.lit(settings[j][0]).alias("config"), F.abs(f"_z{j}").alias("_z")) for j in numbers])).alias("_s"))
    above = each.where(F.col("_s._z") > k).select(CLIP, TIME, F.col("_s.config").alias("config"), F.col("_s._z").alias("_z0"))
    events = runs_of_grid(above, 1, [k], [1], gap, ["config"]).drop("k", "channels")
    spans = [F.var_pop(f"{c}{s}").alias(f"_v_{c}{s}") for c in columns for s in ("", *[f"_f{j}" for j in numbers])]
    both = [F.struct(F.lit(settings[j][0]).alias("config"), F.col(f"_v_{c}").alias("r"), F.col(f"_v_{c}_f{j}").alias("f")) for j in numbers for c in columns]
    per = bank.groupBy(CLIP).agg(*spans).select(F.explode(F.array(*both)).alias("x")).where("x.r > 0 and x.f > 0")
    snr = per.groupBy(F.col("x.config").alias("config")).agg(F.avg(10 * F.log10(F.col("x.r") / F.col("x.f"))).alias("mean_snr_db"))
    return score_table(events, gold, ["config"], overlap, tolerance).join(snr, "config")


def filter_grid(df: DataFrame, gold: DataFrame, bands: Sequence[tuple[float, float]], orders: Sequence[int], columns: Sequence[str], fs: float, widths: Sequence[int], ks: Sequence[float], channels: Sequence[int], gap: float, overlap: float = 0.5, tolerance: float = 0.5) -> DataFrame:
    """The score table of all combinations of band, order, width, k and channels: all filters, windows and runs in one pass over the samples."""
    from roadweave.operators.filters import bank_runs

    settings = [(float(low), float(high), order) for low, high in bands for order in orders]
    table = df.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(settings)], "setting int, low double, high double, order int")
    events = bank_runs(df, columns, fs, settings, widths, ks, channels, gap).join(F.broadcast(table), "setting").drop("setting")
    return score_table(events, gold, ["low", "high", "order", "width", "k", "channels"], overlap, tolerance)


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, n, po, pe, kappa of two label columns; null where chance agreement is 1."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("c"))
    one = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = cells.withColumn("n", F.sum("c").over(one))
    po = total.groupBy(*by).agg(F.max("n").alias("n"), (F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)) / F.max("n")).alias("po"))
    ra = total.groupBy(*by, F.col(a).alias("_l")).agg((F.sum("c") / F.max("n")).alias("pa"))
    rb = total.groupBy(*by, F.col(b).alias("_l")).agg((F.sum("c") / F.max("n")).alias("pb"))
    pe = ra.join(rb, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("pa") * F.col("pb")).alias("pe"))
    both = po.join(pe, list(by), "left") if by else po.crossJoin(pe)  # single rows
    both = both.withColumn("pe", F.coalesce("pe", F.lit(0.0)))
    return both.select(*by, "n", "po", "pe", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))
