"""Labels from rules, and the selection of training sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Note categories and their words, first hit wins; action names and their canonical ones.
NOTE_RULES = (
    ("likely_noise", ("camera vibration", "sensor noise", "no visible change")),
    ("braking_deceleration", ("brak", "decelerat", "slowing", "slow down", "stopp")),
    ("near_miss", ("near miss", "near-miss", "collision", "hazard")),
    ("emergency_swerve", ("swerv", "avoid")),
    ("sharp_turn", ("sharp turn",)),
    ("acceleration", ("accelerat",)),
    ("lane_change", ("lane",)),
)
#: Two more sets of note rules, and the words that make a reviewed event none.
EVASIVE_RULES = (
    ("not_evasive", ("not evasive", "not_evasive", "false", "no evasive")),
    ("swerve", ("swerve", "sharp turn", "sharp_turn", "weave")),
    ("acceleration", ("accelerat", "speed up", "throttle")),
    ("lane_change", ("lane change", "lane_change", "overtake", "merge")),
)
REVIEW_RULES = (
    ("not_evasive", ("riding straight", "no visible change", "no change in heading", "camera vibration", "sensor noise", "constant speed")),
    ("swerve", ("swerv", "avoid")),
    ("sharp_turn", ("sharp turn",)),
    ("acceleration", ("accelerat",)),
    ("lane_change", ("lane", "pass")),
)
ACTIONS = {"Acceleration": "Acceleration", "Deceleration": "Deceleration", "Lane_Change": "Lane_Change", "Braking": "Hard_Braking", "Emergency_Swerve": "Hard_Braking"}


def by_words(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = NOTE_RULES, otherwise: str | None = "other") -> Column:
    """The first rule one of whose words the lower-cased text contains."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(otherwise)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def review_label(notes: Column, decision: Column) -> Column:
    """``REVIEW_RULES`` over the notes; a rejected event is ``not_evasive``."""
    return F.when(F.lower(F.coalesce(decision, F.lit(""))) == "reject", "not_evasive").otherwise(by_words(notes, REVIEW_RULES))


def mapped(value: Column, table: Mapping[str, str], keep: bool = False) -> Column:
    """The value's entry; others are null, or stay with ``keep``."""
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(m, value), value) if keep else F.try_element_at(m, value)


def decision_label(decision: Column, category: Column, binary: bool = False) -> Column:
    yes = F.lower(F.trim(decision)) == "confirm"
    if binary:
        return F.when(yes, "evasive").otherwise("not_evasive")
    return F.when(yes, F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("other"))).otherwise("not_evasive")


def peak_label(az: Column, jerk: Column) -> Column:
    """Label from an event's peaks (fixed limits): braking, deceleration, acceleration, else null."""
    return F.when((az > 2.5) & (jerk > 2.0), "braking").when(az > 1.2, "deceleration").when(az < -1.5, "acceleration")


#: Limits in the functions below (peaks, jerk, coverage, circularity, area, saturation, contrast) are fixed values.
def maneuver(detections: Column, lateral_jerk: Column, az: Column, variant: str = "lateral") -> Column:
    """Maneuver from detected things (array of labels) and peaks, by fixed limits; the variants differ in what is asked first."""
    seen = lambda *w: F.exists(detections, lambda d: d.isin(*w))
    person, car = seen("person", "pedestrian", "animal"), seen("car", "truck", "bus", "motorcycle", "auto", "vehicle")
    if variant == "lateral":
        return F.when(lateral_jerk > 2.0, F.when(person, "swerve").when(car, "lane_change").otherwise("zigzag")).when(az > 2.0, F.when(person | car, "braking").otherwise("deceleration")).otherwise("none")
    return F.when(az > 1.2, F.when(person | car, "braking").otherwise("deceleration")).when(lateral_jerk > 1.5, F.when(person, "swerve").when(car, "lane_change").otherwise("zigzag")).otherwise("none")


def marking_state(coverage: Column, segments: Column, white: Column, yellow: Column) -> Column:
    """struct(present, colour, continuity) of a road marking from measured features, by fixed limits."""
    n = F.when(coverage > 0.0005, segments).otherwise(0)
    continuity = F.when(n >= 6, "broken").when(n >= 1, "solid").otherwise("absent")
    present = coverage > 0.0015
    colour = F.when(~present, "none").when(yellow > white, "yellow").otherwise("white")
    return F.struct(present.alias("present"), colour.alias("colour"), continuity.alias("continuity"))


def sign_shape(circularity: Column, corners: Column, area: Column, saturation: Column, contrast: Column) -> Column:
    """struct(shape, category, condition) of a sign from measured features, by fixed limits; null shape: not a sign."""
    shape = F.when(area < 250, F.lit(None).cast("string")).when(circularity > 0.75, "circle").when(corners == 3, "triangle").when(corners == 4, "rectangle")
    category = mapped(shape, {"circle": "mandatory", "triangle": "cautionary", "rectangle": "informatory"})
    return F.struct(shape.alias("shape"), category.alias("category"), F.when((saturation < 40) | (contrast < 20), "faded").otherwise("good").alias("condition"))


def confident_objects(objects: Column, animals: Sequence[str], vehicles: Sequence[str], least: float = 0.25) -> Column:
    """Detections with enough confidence, rounded, and what they are."""
    kept = F.filter(objects, lambda o: o["confidence"] >= least)
    return F.transform(kept, lambda o: F.struct(o["class"].alias("class"), F.round(o["confidence"], 3).alias("confidence"), o["class"].isin(*animals).alias("is_animal"), o["class"].isin(*vehicles).alias("is_vehicle")))


def event_groups(rows: DataFrame, action: str = "action", frame: str = "frame", gap: int = 15, keys: Sequence[str] = ("clip_id",), values: Sequence[str] = ()) -> DataFrame:
    """Groups of neighbouring frames of one action: rows without action bridge, another action or a gap over ``gap`` ends a group.

    keys, group_no, action, first and last frame, n, and max |v| and mean v of ``values``.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    named = rows.where(F.col(action).isNotNull())
    changed = (F.lag(action).over(w) != F.col(action)) | (F.col(frame) - F.lag(frame).over(w) > gap)
    numbered = named.withColumn("_new", F.coalesce(changed.cast("int"), F.lit(1)))
    numbered = numbered.withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    aggs = [f for v in values for f in (F.max(F.abs(v)).alias(f"max_{v}"), F.avg(v).alias(f"mean_{v}"))]
    return numbered.groupBy(*keys, "group_no").agg(F.first(action).alias("action"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("n"), *aggs)


def hash_order(seed: int, key: Column) -> Column:
    """An order that depends on the key alone: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def stratified_split(df: DataFrame, stratum: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` plus ``split``: of n rows of a stratum max(1, int(n x share)) go to ``val`` (none if n is 1)."""
    w = Window.partitionBy(stratum)
    n = F.count(F.lit(1)).over(w)
    take = F.when(n > 1, F.greatest(F.lit(1), F.floor(n * share))).otherwise(0)
    return df.withColumn("split", F.when(F.row_number().over(w.orderBy(hash_order(seed, F.col(key)), key)) <= take, "val").otherwise("train"))


def oversampled(df: DataFrame, minority: Column, times: int) -> DataFrame:
    """Rows of the minority ``times`` times."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.coalesce(minority, F.lit(False)), times).otherwise(1))))


def balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every label as often as the most frequent one: whole repeats, then rows by hash order."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.crossJoin(counts.agg(F.max("_n").alias("_most")))  # single-row scalar
    met = df.join(counts, F.col(label).eqNullSafe(F.col("_l")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, F.col(key)), key))
    times = F.floor(F.col("_most") / F.col("_n")) + F.when(rank <= F.col("_most") % F.col("_n"), 1).otherwise(0)
    return met.withColumn("_times", times).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_l", "_n", "_most", "_times")


def inverse_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` plus ``weight`` = 1 / number of rows with the label."""
    counts = df.groupBy(F.col(label).alias("_l")).agg((1 / F.count(F.lit(1))).alias("weight"))
    return df.join(counts, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def hash_unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def weighted_draws(df: DataFrame, weight: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement, by weight: ``df`` plus ``draw`` (0 to n - 1).

    Rows stand in the order of their hash on a line as long as all weights; a draw takes the row at
    its place. Places come from sums per hash range (4096 rows), so no task sums up the whole table,
    and draws meet rows by cells of the line.
    """
    rows = df.where(F.col(weight) > 0).withColumn("_h", hash_order(seed, F.col(key)))
    rows = rows.withColumn("_part", F.substring("_h", 1, 3))
    parts = rows.groupBy("_part").agg(F.sum(weight).alias("_w"))
    one = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_w").over(one), F.lit(0.0)).alias("_from"), F.sum("_w").over(Window.partitionBy(F.lit(0))).alias("_total"))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_to", inside).join(parts, "_part").withColumn("_to", F.col("_from") + F.col("_to")).withColumn("_lo", F.col("_to") - F.col(weight))
    cell = lambda c: F.floor(c / F.col("_total") * F.lit(float(n)))
    placed = placed.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_to")))))
    total = parts.select("_total").limit(1)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), hash_unit(F.concat(F.lit(f"{seed}|draw|"), F.col("id").cast("string"))).alias("_u")).crossJoin(total)  # single-row scalar
    draws = draws.select("draw", (F.col("_u") * F.col("_total")).alias("_at"), F.floor(F.col("_u") * F.lit(float(n))).alias("_cell"))
    met = placed.join(draws, "_cell").where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_to")))
    return met.select(*df.columns, "draw")


def shared_draws(df: DataFrame, weight: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows in shares of their weight: each n x weight / total times, the fraction decided by its hash."""
    total = df.agg(F.sum(weight).alias("_total"))
    expected = F.lit(float(n)) * F.col(weight) / F.col("_total")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(expected) + (u < expected - F.floor(expected)).cast("int")
    met = df.crossJoin(total).withColumn("_times", times).where("_times > 0")  # single-row scalar
    return met.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long")))).drop("_times", "_total")


def top_per_category(df: DataFrame, category: str, score: Column, key: str, each: int = 8, most: int | None = 30) -> DataFrame:
    """The best ``each`` rows of a category, then the best ``most`` of all; ties by key."""
    ranked = df.withColumn("_s", score).withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("_s"), key))).where(F.col("_r") <= each)
    kept = ranked if most is None else ranked.orderBy(F.desc("_s"), key).limit(most)
    return kept.drop("_s", "_r")
