"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions alone.

Every document of a source should appear ``target / source size`` times on average. The whole part
is given to all; the fractional parts are rounded in pairs. A pair moves mass from one document to
the other, in words, in a random direction with the odds that keep each expectation, until one of
the two is integral; the other goes on. So the words of the source never change but for the one
document left at the very end, often the largest. What rounding that one adds or takes is given to
a reserve of small documents (about ``BLOCK`` a source), which are folded last in the same way, so a
source ends within half a small document of its target. The two last documents go to the nearer
side; all others keep their expectation.

The pairs form a reduction tree: documents are dealt by hash into blocks of about ``BLOCK`` rows, a
block is folded with the SQL function ``aggregate``, and what it leaves (one document) meets the
residuals of other blocks at the next level. No block grows with its source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from roadweave.llm.common import WORD_PATTERN, stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 256
#: Equal rows that one task numbers or writes.
REPEATS = 1024


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters that are not ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above ``most`` times its size.

    Sources stand in code-point order, null last, and take the weights in turn; they are numbered by
    ranges of sources, so any number of them is many tasks. A source is full where the level (words
    per unit of weight) passes most * size / weight; the level rises until no more source is full.
    """
    order = F.col("source").asc_nulls_last()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = stored(per.repartitionByRange(order).withColumn("_rw_range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_rw_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("_rw_range").agg(F.count(F.lit(1)).alias("n")).select("_rw_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rw_before"))
    number = F.row_number().over(Window.partitionBy("_rw_range").orderBy(order)) - 1 + F.col("_rw_before")
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    at_most = F.lit(float(most)) * F.col("source_size")
    weighted = stored(ranged.join(starts, "_rw_range").select("source", "source_size", picked.alias("_rw_weight")), "mix-weights")
    level, full = 0.0, -1
    while True:
        is_full = at_most / F.col("_rw_weight") < F.lit(level)
        sums = weighted.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(is_full, at_most)).alias("taken"), F.sum(F.when(~is_full, F.col("_rw_weight"))).alias("rest"), F.count(F.when(is_full, 1)).alias("full")
        ).collect()[0]
        if sums["full"] == full or not sums["rest"]:
            break
        full, level = sums["full"], (float(sums["all"] or 0) - (sums["taken"] or 0.0)) / sums["rest"]
    level_target = F.lit(level) * F.col("_rw_weight") if sums["rest"] else at_most
    return weighted.select("source", "source_size", F.least(level_target, at_most).alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))


def _fold(members: Column, seed: int) -> Column:
    """Struct (carry, done) after pairing the members (key, dup, size, p) in turn.

    ``carry`` is the document still fractional, ``done`` holds the others with their 0 or 1.
    """

    def made(x: Column, p: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["dup"].alias("dup"), x["size"].alias("size"), p.cast("double").alias("p"))

    def step(state: Column, j: Column) -> Column:
        i = state["carry"]
        # Words that can move to i, and words that can move to j, before one of them is integral.
        fill_i, drain_j = (1 - i["p"]) * i["size"], j["p"] * j["size"]
        drain_i, fill_j = i["p"] * i["size"], (1 - j["p"]) * j["size"]
        up, down = F.least(fill_i, drain_j), F.least(drain_i, fill_j)
        to_i = _unit(F.lit(seed), i["key"], i["dup"], j["key"], j["dup"]) * (up + down) < down
        one, zero = F.lit(1.0), F.lit(0.0)
        p_i = F.when(to_i, F.when(fill_i <= drain_j, one).otherwise(i["p"] + up / i["size"])).when(drain_i <= fill_j, zero).otherwise(i["p"] - down / i["size"])
        p_j = F.when(to_i, F.when(drain_j <= fill_i, zero).otherwise(j["p"] - up / j["size"])).when(fill_j <= drain_i, one).otherwise(j["p"] + down / j["size"])
        i_done = F.when(to_i, fill_i <= drain_j).otherwise(drain_i <= fill_j)
        return F.struct(
            F.when(i_done, made(j, p_j)).otherwise(made(i, p_i)).alias("carry"),
            F.concat(state["done"], F.array(F.when(i_done, made(i, p_i)).otherwise(made(j, p_j)))).alias("done"),
        )

    start = F.struct(made(members[0], members[0]["p"]).alias("carry"), F.slice(F.transform(members, lambda x: made(x, x["p"])), 1, 0).alias("done"))
    return F.aggregate(F.slice(members, 2, 1 << 30), start, step)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(c: Column, kind: DataType) -> Column:
    """A value that xxhash64 tells apart from others: maps as their sorted entries, with the places of nulls inside."""
    if isinstance(kind, ArrayType):
        return F.struct(F.size(c), F.transform(c, lambda x: F.struct(x.isNull(), _hashable(x, kind.elementType))))
    if isinstance(kind, StructType):
        return F.struct(*(x for f in kind.fields for x in (c.getField(f.name).isNull(), _hashable(c.getField(f.name), f.dataType))))
    if isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(_hashable(e["key"], kind.keyType), e["value"].isNull(), _hashable(e["value"], kind.valueType)))
        return F.struct(F.size(c), F.array_sort(pairs))
    return F.to_json(c) if isinstance(kind, VariantType) else c


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, maps by their entries in whatever order; nulls count by their places."""
    cols = [(_quoted(f.name), f.dataType) for f in docs.schema.fields]
    return F.xxhash64(*(_hashable(c, kind) for c, kind in cols), F.concat(*[c.isNull().cast("string") for c, _ in cols]))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 8, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, dup, h of each row of ``docs`` (doc_id, text, source).

    ``h`` is a hash of the whole row, ``dup`` numbers rows that are alike in every column: such rows
    are counted, not gathered, so a row that very many repeat is no task of its own. Null and empty
    texts have size 0 and no copies beyond the whole part of their source. Null ids and sources are
    values like others. An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _row_hash(docs).alias("h"))
    once = stored(sized.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("times")), "mix-sizes")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))).alias("c")
    many = once.where(F.col("times") > REPEATS).select("*", chunk).repartition("h", "c")
    few = once.where(F.col("times") <= REPEATS).withColumn("c", F.lit(0).cast("long"))
    last = F.least(F.col("times"), (F.col("c") + 1) * REPEATS)
    sized = few.unionByName(many).select("doc_id", "source", "size", "h", F.explode(F.sequence(F.col("c") * REPEATS + 1, last)).alias("dup"))
    targets = stored(source_targets(once.select("source", (F.col("size") * F.col("times")).alias("size")), weights, most), "mix-targets")
    per = targets.withColumn("_rw_ratio", F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    # One row per source: small, and joined by whatever plan its true size allows.
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).select(sized["*"], "source_size", "target", "_rw_ratio")
    rows = rows.withColumn("_rw_whole", F.floor("_rw_ratio").cast("int")).withColumn("p", F.col("_rw_ratio") - F.col("_rw_whole"))
    fixed = (F.col("size") == 0) | (F.col("p") <= 0)
    done = rows.where(fixed).select("doc_id", "h", "source", "dup", "size", F.lit(0.0).alias("p"))

    # Some small documents of each source wait for what the tree leaves over.
    facts = rows.where(~fixed).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    facts = stored(facts.withColumnRenamed("source", "_rw_source"), "mix-facts")
    most_rows = facts.agg(F.max("n")).collect()[0][0] or 0
    small = (F.col("size") <= F.col("mean")) & (_unit(F.lit(seed), F.lit("reserve"), F.col("doc_id"), F.col("h"), F.col("dup")) * F.col("n") < F.lit(float(block)))
    open_ = rows.where(~fixed).join(facts, F.col("source").eqNullSafe(F.col("_rw_source")))
    open_ = open_.select("source", F.struct("doc_id", "h").alias("key"), "dup", "size", "p", small.alias("_rw_small"))
    reserve, level = open_.where("_rw_small").drop("_rw_small"), open_.where("not _rw_small").drop("_rw_small")

    def folded(members: DataFrame, by: list[str], stage: str) -> DataFrame:
        gathered = members.groupBy("source", *by).agg(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "dup", "size", "p")).alias("m"))
        inner = F.transform(F.array_sort("m"), lambda x: F.struct(x["key"].alias("key"), x["dup"].alias("dup"), x["size"].alias("size"), x["p"].alias("p")))
        return stored(gathered.select("source", _fold(inner, seed).alias("f")), stage)

    def decided(fold: DataFrame) -> DataFrame:
        return fold.select("source", F.explode("f.done").alias("d")).select("d.key.doc_id", "d.key.h", "source", "d.dup", "d.size", "d.p")

    nearest = F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)

    def settled(last: DataFrame) -> DataFrame:
        return last.select("key.doc_id", "key.h", "source", "dup", "size", nearest.alias("p"))

    while most_rows > 0:
        blocks = max(1, math.ceil(most_rows / block))
        dealt = level.withColumn("_rw_block", F.pmod(F.xxhash64(F.lit(seed), F.lit(most_rows), "key", "dup"), F.lit(blocks)))
        fold = folded(dealt, ["_rw_block"], "mix-level")
        done = done.unionByName(decided(fold))
        level = fold.select("source", "f.carry.key", "f.carry.dup", "f.carry.size", "f.carry.p")
        if blocks == 1:
            break
        most_rows = blocks
    if most_rows > 0:
        done = done.unionByName(settled(level))
        over = level.groupBy(F.col("source").alias("_rw_source")).agg(F.sum((F.col("p") - nearest) * F.col("size")).alias("_rw_words"))
        room = reserve.groupBy(F.col("source").alias("_rw_s")).agg(F.sum("size").alias("_rw_room"))
        shared = room.join(over, F.col("_rw_source").eqNullSafe(F.col("_rw_s"))).select("_rw_s", (F.col("_rw_words") / F.col("_rw_room")).alias("_rw_shift"))
        moved = reserve.join(shared, F.col("source").eqNullSafe(F.col("_rw_s")), "left").drop("_rw_s")
        moved = moved.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + F.coalesce("_rw_shift", F.lit(0.0)))))
        fold = folded(moved, [], "mix-reserve")
        done = done.unionByName(decided(fold)).unionByName(settled(fold.select("source", "f.carry.key", "f.carry.dup", "f.carry.size", "f.carry.p")))
    joined = done.join(per.withColumnRenamed("source", "_rw_source"), F.col("source").eqNullSafe(F.col("_rw_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.floor("_rw_ratio") + F.col("p")).cast("int").alias("copies"), "dup", "h")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 8) -> DataFrame:
    """The mixed documents: each row of ``docs``, with all its columns, as often as its copies say.

    Rows that are alike in every column, maps and what is nested included, are one row with all their
    copies. Columns may have any name and type. Null and empty texts appear as often as the whole part
    of their source's ratio, whatever their length texts are read whole, an empty table gives an empty
    result. Texts are shuffled once.
    """
    key = ["_rw_h", "_rw_id", "_rw_source", "_rw_size"]
    per = copies(docs, weights, most, seed).groupBy("h", "doc_id", "source", "size").agg(F.sum("copies").alias("_rw_copies"), F.count(F.lit(1)).alias("_rw_times"))
    taken = stored(per.where("_rw_copies > 0").select(F.col("h").alias("_rw_k"), F.col("doc_id").alias("_rw_d"), F.col("source").alias("_rw_s"), F.col("size").alias("_rw_z"), "_rw_copies", "_rw_times"), "mix-taken")
    names = [_quoted(c) for c in docs.columns]
    keyed = docs.select("*", _row_hash(docs).alias("_rw_h"), F.col("doc_id").alias("_rw_id"), F.col("source").alias("_rw_source"), word_count(F.col("text")).alias("_rw_size"))

    def on(other: DataFrame) -> Column:
        same = F.col("_rw_id").eqNullSafe(other["_rw_d"]) & F.col("_rw_source").eqNullSafe(other["_rw_s"])
        return (F.col("_rw_h") == other["_rw_k"]) & (F.col("_rw_size") == other["_rw_z"]) & same

    single, again = taken.where("_rw_times = 1"), taken.where("_rw_times > 1")
    mixed = keyed.join(single, on(single)).withColumn("_rw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rw_copies")))).select(*names)
    if again.isEmpty():
        return mixed
    one = keyed.join(again, on(again)).dropDuplicates(key)
    one = one.withColumn("_rw_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rw_copies") - 1) / REPEATS)))).repartition("_rw_h", "_rw_c")
    last = F.least(F.col("_rw_copies"), (F.col("_rw_c") + 1) * REPEATS)
    repeated = one.withColumn("_rw_copy", F.explode(F.sequence(F.col("_rw_c") * REPEATS + 1, last)))
    return mixed.unionByName(repeated.select(*names))
