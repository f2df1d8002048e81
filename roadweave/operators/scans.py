"""Ordered scans within a key (a clip) of any length, as many tasks.

Rows are dealt to ranges of (key, order) and stored, so a key may span many ranges and a range hold
many keys. What a scan hands on (sums, the last value, a running end) is one row a range and key;
sums over those rows are joined to the ranges, whose own rows are then scanned by windows. Windows of
a fixed reach stand in blocks of a key's rows with copies of the neighbours' rows at both sides.

Where no key has more than ``SHORT`` rows, each key is one part of one task and nothing is handed on; the
results are the same. Callers that know it say so by ``short``, else the keys' rows are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from roadweave.functions.storage import spread, stored

#: Rows of a block at least, and rows of a range, about.
BLOCK = 8192
RANGE = 25_000
#: Rows of a key that one task sorts at most.
SHORT = 500_000


def short_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no key has more than SHORT rows (without keys: the table)."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).collect()[0][0]
    return (largest or 0) <= SHORT


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], short: bool | None = None) -> DataFrame:
    """``df`` dealt to ranges of (keys, order) of about RANGE rows, plus _range and _pos (its place in the range's order).

    Reads ``df`` several times (rows, bounds, ranges): store what is costly first. Short keys are dealt whole,
    as one range, in which rows have no place yet.
    """
    if short is None:
        short = short_keys(df, keys)
    if short:
        kept = {"order": [c for c in order if isinstance(c, str)]}
        return (spread(df, *keys) if keys else df).withColumns({"_range": F.lit(0).alias("_range", metadata=kept), "_pos": F.lit(0).cast("long")})
    ranges = max(1, -(-df.count() // RANGE))
    dealt = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    return stored(dealt.withColumns({"_range": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")


def whole(dealt: DataFrame) -> list[str] | None:
    """The order of keys that were dealt whole; None for ranges."""
    return dealt.schema["_range"].metadata.get("order")


def in_range(dealt: DataFrame, keys: Sequence[str]) -> WindowSpec:
    """A key's rows of a range, in order."""
    order = whole(dealt)
    return Window.partitionBy("_range", *keys).orderBy("_pos") if order is None else Window.partitionBy(*keys).orderBy(*order)


def up_to_here(dealt: DataFrame, keys: Sequence[str]) -> WindowSpec:
    return in_range(dealt, keys).rowsBetween(Window.unboundedPreceding, 0)


def carried(dealt: DataFrame, keys: Sequence[str], **parts: tuple[Column, str]) -> DataFrame:
    """``dealt`` plus, by name, what the other ranges of a row's key hand on.

    A part is an aggregate of a range's rows and how those of several ranges are put together: ``sum``
    and ``max`` of all earlier ranges, ``last`` of the earlier ones, ``next`` of the later ones (both
    take the nearest that is not null), ``all`` the sum of every range, ``own`` the range's own. Sums are
    0 where there is none.
    """
    if whole(dealt) is not None:
        of_key = Window.partitionBy(*keys)
        none = {"sum": lambda a: F.lit(0).cast("long"), "all": lambda a: a.over(of_key), "own": lambda a: a.over(of_key)}
        return dealt.withColumns({name: none.get(how, lambda a: F.when(F.lit(False), a.over(of_key)))(a) for name, (a, how) in parts.items()})
    per = dealt.groupBy("_range", *keys).agg(*[a.alias(name) for name, (a, _) in parts.items()])
    return handed(dealt, per, keys, {name: combined(F.col(name), how, keys) for name, (_, how) in parts.items()})


def combined(c: Column, how: str, keys: Sequence[str]) -> Column:
    """A column of one row a range and key, put together over the ranges of a key."""
    ranges = Window.partitionBy(*keys).orderBy("_range")
    before, after = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(1, Window.unboundedFollowing)
    if how == "all":
        return F.sum(c).over(Window.partitionBy(*keys))
    return {"sum": lambda: F.coalesce(F.sum(c).over(before), F.lit(0)), "max": lambda: F.max(c).over(before), "last": lambda: F.last(c, True).over(before), "next": lambda: F.first(c, True).over(after), "own": lambda: c}[how]()


def handed(dealt: DataFrame, per: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """``dealt`` plus ``columns`` of its range's and key's row in ``per``.

    Those rows are stored: by their true size Spark joins few of them without dealing ``dealt`` again.
    """
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    small = stored(per.select(F.col("_range").alias("_of"), *[F.col(k).alias(n) for k, n in names.items()], *[c.alias(name) for name, c in columns.items()]), "handed")
    same = F.col("_range") == F.col("_of")
    for k, n in names.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    return dealt.join(small, same).drop("_of", *names.values())


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], short: bool | None = None) -> DataFrame:
    """``df`` plus _i, each row's number within its key (from 0), and _n, the rows of its key."""
    if short is None:
        short = bool(keys) and short_keys(df, keys)
    if short:
        rows = Window.partitionBy(*keys)
        return spread(df, *keys).withColumns({"_i": (F.row_number().over(rows.orderBy(*order)) - 1).cast("long"), "_n": F.count(F.lit(1)).over(rows)})
    dealt = ranged(df, keys, order, short=False)
    met = carried(dealt, keys, _before=(F.count(F.lit(1)), "sum"), _n=(F.count(F.lit(1)), "all"), _from=(F.min("_pos"), "own"))
    return met.select(*df.columns, (F.col("_pos") - F.col("_from") + F.col("_before")).alias("_i"), "_n")


def haloed(df: DataFrame, size: Column | int, below: Column | int, above: Column | int) -> DataFrame:
    """Rows with _i and _n in blocks (_block) of ``size`` rows of their key, with copies of the ``below`` rows before and ``above`` rows after; _own marks the block's own."""
    size, below, above = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (size, below, above))
    own = F.floor(F.col("_i") / size)
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_i") - above) / size)), F.least(F.floor((F.col("_n") - 1) / size), F.floor((F.col("_i") + below) / size))
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == own)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """keys, q: the exact quantile of each key's values, between two neighbours by parts; nulls don't count.

    Distinct values are counted, dealt to ranges and numbered by their counts, so neither a key nor a
    value that all rows have fills one task, and no buffer grows with a key. Keys without values are
    left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = ranged(stored(counts, "value-counts"), keys, ["_v"])
    placed = carried(dealt, keys, _before=(F.sum("_c"), "sum"), _n=(F.sum("_c"), "all"))
    upto = F.col("_before") + F.sum("_c").over(up_to_here(dealt, keys))
    at = (F.col("_n") - 1) * F.lit(float(share))
    # The values that hold the two places around ``at``.
    low, high = F.floor(at), F.ceil(at)
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
    found = placed.withColumn("_upto", upto).where(holds(low) | holds(high))
    ends = found.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max(at - low).alias("_part"))
    return ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("q"))
