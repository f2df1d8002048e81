"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

Each distinct five-word shingle of a text sends arrivals of a Poisson process with its weight as rate
to random registers; a register keeps the element that arrives first. A process ends as soon as its
next arrival is later than every register of its text. Two texts agree in a register with the
probability Jaccard similarity of their weights. A shingle that a text holds c times weighs 1 + ln(c).
Links are defined by the shingle sets, and one line repeated a hundred times moves the weighted
similarity of a pair far from that of its sets; so a text that repeats shingles has two signatures,
one of its weights and one of equal weights, and meets others by either. Without repeats both are the
same and made once.

Registers are banded. Within each bucket every member is verified against one member only, the
centre, and the links found are merged into groups. Where a bucket still holds several groups, the
members outside the largest one are compared with the others in blocks of texts: pairs are never
rows, only links are, and a large group is dealt to many tasks. So no link between groups that share
a bucket is lost; banding misses a pair at 0.8 with a probability of 7e-5.
Exact copies are merged before all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stored
from roadweave.operators.components import connected
from roadweave.llm.textbytes import chunks, mix, shingles, unit

SHINGLE = 5
SIMILAR = 0.8
BANDS = 24
ROWS = 5
#: Texts of a block when members of mixed buckets are compared.
BLOCK = 128
#: Texts whose shingles a task remembers (speed only).
KEPT = 4000
#: Cells of the dense matrix by which two blocks are compared at once.
DENSE = 20_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (element hashes) of ``n`` texts; texts without elements keep zeros."""
    first = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, np.uint64)
    active, time, state = np.arange(len(h)), np.zeros(len(h)), h.copy()
    present = np.zeros(n, bool)
    present[doc] = True
    while len(active):
        state[active] += _STEP
        draw = mix(state[active])
        time[active] -= np.log(unit(draw)) / weight[active]
        spot = doc[active] * registers + (mix(draw ^ _STEP) % np.uint64(registers)).astype(np.int64)
        now = time[active]
        np.minimum.at(first, spot, now)
        won = now == first[spot]
        holder[spot[won]] = h[active[won]]
        latest = first.reshape(n, registers).max(1)
        active = active[now < latest[doc[active]]]
    return holder.reshape(n, registers)


def _band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            out[:, b] = mix(out[:, b] + sig[:, b * rows + r] + np.uint64(r + 1))
    return out


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """doc_id, h1, h2 (hash of the whole text), bands (hash of each band, null without words).

    Entry i is of band i % ``bands``: equal weights first, then, for texts that repeat shingles, weights
    by count, null where they say the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(pc.utf8_lower(batch.column(1))):
                doc, h, count = shingles(c, width)
                equal = _band_hashes(signatures(doc, h, np.ones(len(h)), c.n, bands * rows), bands, rows)
                has = np.bincount(doc, minlength=c.n) > 0
                repeats = np.bincount(doc, count > 1, minlength=c.n) > 0
                again, some = np.flatnonzero(repeats), repeats[doc]
                by_count = signatures(np.searchsorted(again, doc[some]), h[some], 1 + np.log(count[some]), len(again), bands * rows)
                weighted = _band_hashes(by_count, bands, rows)
                ends = np.concatenate([[0], np.cumsum(np.where(repeats, 2 * bands, bands))])
                values, same = np.zeros(ends[-1], np.uint64), np.zeros(ends[-1], bool)
                values[ends[:-1, None] + np.arange(bands)] = equal
                second = ends[again, None] + bands + np.arange(bands)
                values[second], same[second] = weighted, weighted == equal[again]
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64), mask=same))
                flat = pc.if_else(pa.array(has), flat, pa.scalar(None, flat.type))
                ids = [batch.column(i).slice(c.lo, c.n) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*ids, flat], ["doc_id", "h1", "h2", "bands"])

    lean = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(4), "text", F.length("text")).alias("h2"))
    return lean.mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted shingle hashes of each text; equal texts are read once."""
    coded = texts.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    own: list[np.ndarray] = []
    for c in chunks(pc.utf8_lower(coded.dictionary)):
        doc, h, _ = shingles(c, width)
        at = np.searchsorted(doc, np.arange(c.n + 1))
        own += [h[at[i] : at[i + 1]] for i in range(c.n)]
    return [own[i] for i in coded.indices.to_pylist()]


def similarity(a: pa.Array, b: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of texts, exactly; 0 if one has none."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(shingle_sets(a, width), shingle_sets(b, width), strict=True)):
        if len(x) and len(y):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = both / (len(x) + len(y) - both)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs that are similar enough."""
    alike = F.arrow_udf("double")(lambda a, b: pa.array(similarity(a, b)))
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").where(alike("text_a", "text_b") >= threshold).select("a", "b")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared elements of each set in ``a`` with each in ``b``."""
    every, back = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    if len(every) * (len(a) + len(b)) > DENSE:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a]).reshape(len(a), len(b))
    cells = np.zeros((len(a) + len(b), len(every)), np.float32)
    cells[np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]]), back] = 1
    return (cells[: len(a)] @ cells[len(a) :].T).round().astype(np.int64)


def _block_links(met: DataFrame, threshold: float) -> DataFrame:
    """a, b of the linked texts of different groups in pairs of blocks (asks, answers: arrays of rep, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # the sets of the blocks that a task met last

        def sets(block: pa.StructArray) -> list[np.ndarray]:
            reps = block.field("rep").to_pylist()
            new = [i for i, r in enumerate(reps) if r not in kept]
            if new:
                if len(kept) > KEPT:
                    kept.clear()
                    new = list(range(len(reps)))
                kept.update(zip([reps[i] for i in new], shingle_sets(block.field("text").take(pa.array(new))), strict=True))
            return [kept[r] for r in reps]

        for batch in batches:
            for asks, answers in zip(batch.column(0), batch.column(1), strict=True):
                x, y = asks.values, answers.values
                sx = sets(x)
                sy = sets(y)
                both = common_counts(sx, sy)
                size = np.array([len(h) for h in sx])[:, None] + np.array([len(h) for h in sy])
                j = both / np.maximum(size - both, 1)
                lx, ly = x.field("label").to_numpy(), y.field("label").to_numpy()
                j[lx[:, None] == ly] = 0
                i, k = np.nonzero(j >= threshold)
                one, two = x.field("rep").to_numpy()[i], y.field("rep").to_numpy()[k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return met.select("asks", "answers").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, copy_of, class_id, n_links, kept of each row of ``docs`` (doc_id, text).

    copy_of: smallest doc_id with exactly this text. class_id: smallest doc_id of the group joined by
    links: a Jaccard similarity of the shingle sets of at least ``threshold``. n_links: different texts that this text was verified to be
    linked with. kept: whether the row is the one that stays of its group. Empty texts are copies of
    each other; null texts, and rows without id, stand alone. Of rows that repeat one doc_id and text
    one is kept at most; a doc_id with several texts is in the group of each. An empty table gives an
    empty result; further columns are not read. A doc_id that is no whole number is an error of the cast.
    """
    given = _given(docs)
    full = _classes(given, threshold, bands, rows, block)
    each = full.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    each = each.select("doc_id", "copy_of", "class_id", "n_links", (F.col("first") & (F.col("_no") == 1)).alias("kept"))
    alone = given.where("text is null or doc_id is null").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return each.unionByName(alone)


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _classes(given: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, h1, times, copy_of, class_id, n_links, first of each different doc_id and text (h1: its hash).

    times: rows that repeat both. first: whether it is the one that stays of its group. Texts are
    represented by their hash, so that texts which share a doc_id are compared each.
    """
    sketched = stored(sketch(given.where("text is not null and doc_id is not null"), bands, rows), "sketch")
    once = sketched.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    copies = sketched.groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_of"))
    # A representative's own row is the one whose id is the smallest of its text.
    member = stored(once.join(copies, ["h1", "h2"]).select("doc_id", "h1", "times", "copy_of"), "copies")
    reps = sketched.where("bands is not null").join(member.where("doc_id = copy_of").select("doc_id", "h1"), ["doc_id", "h1"], "left_semi").dropDuplicates(["h1"])
    spread = reps.select(F.col("h1").alias("rep"), F.posexplode("bands").alias("place", "hash")).where("hash is not null")
    spread = spread.select("rep", (F.col("place") % bands).alias("band"), "hash")
    # Size and centre of each bucket come from map-side aggregates. The centre is the member with the
    # most company in all its buckets: in a family of copies the text that the others are nearest to.
    bucket = spread.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = stored(spread.join(bucket, ["band", "hash"]).select("band", "hash", "rep", "n"), "buckets")
    company = inside.groupBy("rep").agg(F.sum("n").alias("company"))
    inside = inside.join(company, "rep")
    centre = inside.groupBy("band", "hash").agg(F.max_by("rep", F.struct("company", (-F.col("rep")).alias("first"))).alias("centre"))
    inside = stored(inside.join(centre, ["band", "hash"]).select("band", "hash", "rep", "centre"), "members")
    wanted = member.where("doc_id = copy_of").join(inside.select(F.col("rep").alias("h1")).distinct(), "h1", "left_semi").select("doc_id", "h1")
    # Never a broadcast: ``wanted`` grows with the corpus and has no bound.
    hashed = given.where("text is not null").withColumn("h1", F.xxhash64("text"))
    texts = stored(hashed.join(wanted.hint("merge"), ["doc_id", "h1"], "left_semi").dropDuplicates(["h1"]).select(F.col("h1").alias("rep"), "text"), "texts")

    pair = F.struct(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b"))
    first = inside.where("rep <> centre").select(pair.alias("x")).select("x.a", "x.b").distinct()
    links = stored(_verified(first, texts, threshold), "links")
    groups = stored(connected(links), "groups")

    # Buckets that still hold several groups: members outside the largest one ask all members that
    # share such a bucket with that group, in blocks, once for all bands.
    labelled = inside.where("rep <> centre").join(groups, F.col("rep") == F.col("node"), "left").select("band", "hash", "rep", F.coalesce("label", "rep").alias("label"))
    per_label = labelled.groupBy("band", "hash", "label").agg(F.count(F.lit(1)).alias("m"))
    top = per_label.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("m", "label")).alias("top")).where("labels > 1")
    mixed = stored(labelled.join(top, ["band", "hash"]).select("top", "rep", "label").distinct(), "mixed")
    if not mixed.isEmpty():
        size = mixed.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") != F.col("top")).cast("long")).alias("asking"))

        def blocks(members: DataFrame, count: str, name: str) -> DataFrame:
            dealt = members.join(size, "top").withColumn(name, F.pmod(F.xxhash64(F.lit(name), "rep"), F.ceil(F.col(count) / block)))
            full = dealt.join(texts, "rep").groupBy("top", name).agg(F.collect_list(F.struct("rep", "label", "text")).alias(f"{name}s"))
            return stored(full, name)

        asks, answers = blocks(mixed.where("label <> top"), "asking", "ask"), blocks(mixed, "n", "answer")
        # Pairs of blocks as small rows first, so that a large group is dealt to many tasks.
        met = asks.select("top", "ask").join(answers.select("top", "answer"), "top").repartition("top", "ask", "answer")
        met = met.join(asks, ["top", "ask"]).join(answers, ["top", "answer"])
        links = stored(links.unionByName(_block_links(met, threshold)).distinct(), "links")
        groups = stored(connected(links), "groups")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    # One row a text; the first row of a group has the smallest doc_id, and of several texts with it the smallest hash.
    text = member.groupBy("h1").agg(F.min("doc_id").alias("copy_of")).join(groups.withColumnRenamed("node", "h1"), "h1", "left").withColumn("label", F.coalesce("label", "h1"))
    head = text.groupBy("label").agg(F.min(F.struct("copy_of", "h1")).alias("head"))
    text = text.join(head, "label").join(degree.withColumnRenamed("node", "h1"), "h1", "left")
    text = text.select("h1", F.col("head.copy_of").alias("class_id"), (F.col("head.h1") == F.col("h1")).alias("_is"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    full = member.join(text, "h1")
    return full.select("doc_id", "h1", "times", "copy_of", "class_id", "n_links", (F.col("_is") & (F.col("doc_id") == F.col("class_id"))).alias("first"))


def deduplicate(docs: DataFrame, threshold: float = SIMILAR, repeats: bool = True) -> DataFrame:
    """``docs`` with all columns, without the rows that have a near-duplicate before them (by doc_id, then by hash).

    Rows that repeat both doc_id and text all stay with their first; one of them does without ``repeats``.
    Rows with a null text or id all stay; an empty table stays empty; other columns pass as they are.
    """
    found = stored(_classes(_given(docs), threshold).select(F.col("doc_id").alias("_rw_id"), F.col("h1").alias("_rw_h1"), "times", "first"), "classes")
    key = lambda other: (F.col("doc_id").cast("long") == other["_rw_id"]) & (F.xxhash64(F.col("text").cast("string")) == other["_rw_h1"])
    again = found.where("first and times > 1").select("_rw_id", "_rw_h1")
    gone = found.where("not first").select("_rw_id", "_rw_h1")
    if repeats or again.isEmpty():
        return docs.join(gone, key(gone), "left_anti")
    gone = gone.unionByName(again)
    one = docs.join(again, key(again)).dropDuplicates(["_rw_id", "_rw_h1"]).drop("_rw_id", "_rw_h1")
    return docs.join(gone, key(gone), "left_anti").unionByName(one)
