"""Hard negatives by rotated one-bit codes.

A vector is rotated at random (a fixed orthogonal matrix) and coded by the signs of its rotated
components. The code is a unit vector b; stored with it is the alignment a = <r, b>, so that a*b is the
vector's best multiple of its code. What is left is coded again, ``LEVELS`` times in all, and the norm
of the last rest is stored. Anchors have ``ANCHOR_LEVELS`` codes. Of two coded vectors the inner
product of the coded parts is a sum of alignments times (d - 2 * popcount(xor of codes)) / d, and by
Cauchy and Schwarz the true one differs from it by |anchor| * |rest of the row| + |rest of the anchor| *
|coded part of the row| at most. That interval decides, level by level, which rows can't matter; the
rest are scored in whole numbers. So the result is exact.

Anchors and rows meet in a grid of cells: rows are dealt to R parts and anchors to C, and each cell
is one part of each. A task holds a cell's anchors (``ANCHORS`` at most) and streams its rows past them,
with the best found so far as the limit. Parts are dealt by position, so no label, id or repeated
vector fills one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import finite_vector, matrix, stored, usual_length, whole_steps

LEVELS = 4
ANCHOR_LEVELS = 8
POSITIVES = 5
NEGATIVES = 3
#: Negatives score between these shares (percent) of their positive.
LEAST_SHARE = 50
MOST_SHARE = 95
#: Anchors that a task holds at most; pairs of anchor and row of a cell, about.
ANCHORS = 65_536
PAIRS = 1 << 31
#: Anchors and rows that are compared at once.
ANCHOR_BLOCK = 256
ROW_BLOCK = 2048
_LOWEST = np.iinfo(np.int64).min


@dataclass
class Codes:
    """Codes (levels x vectors x words), alignments, norms of the coded part and of the rest (levels x vectors), norms, of rotated vectors."""

    bits: np.ndarray
    alignment: np.ndarray
    coded: np.ndarray
    rest: np.ndarray
    norm: np.ndarray


def rotation(dimension: int, seed: int = 13) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray, levels: int) -> Codes:
    turned = rest = x.astype(float) @ turn
    d, words = x.shape[1], -(-x.shape[1] // 64)
    norm, bits, alignment, coded, left = np.sqrt((rest**2).sum(1)), [], [], [], []
    for _ in range(levels):
        up = rest >= 0
        b = np.where(up, 1.0, -1.0) / math.sqrt(d)
        a = (rest * b).sum(1)
        rest = rest - a[:, None] * b
        padded = np.zeros((len(x), words * 64), np.uint8)
        padded[:, :d] = up
        bits.append(np.packbits(padded, axis=1).view(np.uint64))
        alignment.append(a)
        coded.append(np.sqrt(((turned - rest) ** 2).sum(1)))
        left.append(np.sqrt((rest**2).sum(1)))
    return Codes(np.stack(bits), np.stack(alignment), np.stack(coded), np.stack(left), norm)


def _agreement(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """<b, b'> of codes given as words (last axis), by popcount."""
    return 1.0 - np.bitwise_count(a ^ b).sum(-1, dtype=np.int32) * (2.0 / d)


def intervals(anchors: Codes, rows: Codes, i: np.ndarray, j: np.ndarray, level: int, estimate: np.ndarray | float, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and half width for the pairs (i, j), with the rows' first ``level + 1`` codes; ``estimate``: that of the codes before.

    Where q = q' + t and r = r' + s, <q, r> = <q', r'> + <t, r'> + <q, s>.
    """
    for k in range(len(anchors.bits)):
        estimate = estimate + anchors.alignment[k, i] * rows.alignment[level, j] * _agreement(anchors.bits[k, i], rows.bits[level, j], d)
    half = anchors.norm[i] * rows.rest[level, j] + anchors.rest[-1, i] * rows.coded[level, j]
    return estimate, half + 1e-9 * (anchors.norm[i] * rows.norm[j] + 1.0)


@dataclass
class Best:
    """The ``k`` best (score, vec_id) of each place, higher scores first, ties to smaller ids."""

    places: int
    k: int
    score: np.ndarray = field(init=False)
    ident: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.score = np.full((self.places, self.k), _LOWEST)
        self.ident = np.zeros((self.places, self.k), np.int64)

    @property
    def least(self) -> np.ndarray:
        """The score below which nothing is taken any more."""
        return self.score[:, -1]

    def add(self, place: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        own = np.unique(place)
        if not len(own):
            return
        old_place = np.repeat(own, self.k)
        old_score, old_ident = self.score[own].ravel(), self.ident[own].ravel()
        held = old_score > _LOWEST
        place = np.concatenate([old_place[held], place])
        score, ident = np.concatenate([old_score[held], score]), np.concatenate([old_ident[held], ident])
        order = np.lexsort((ident, -score, place))
        place, score, ident = place[order], score[order], ident[order]
        first = np.searchsorted(place, place)
        rank = np.arange(len(place)) - first
        kept = rank < self.k
        self.score[place[kept], rank[kept]] = score[kept]
        self.ident[place[kept], rank[kept]] = ident[kept]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x of the rows that take part; x in whole steps."""
    kept = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite_vector("embedding"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_steps("embedding").alias("x"))


_CELL = "kind int, row long, vec_id long, label long, x array<long>, windows array<long>"


def _grid(rows: DataFrame, anchors: DataFrame, n: int, asking: int) -> DataFrame:
    """Rows (kind 1) and anchors (kind 0) in their cells, a cell's anchors first."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * asking / PAIRS))
    across = max(math.ceil(math.sqrt(tasks * asking / max(n, 1))), math.ceil(asking / ANCHORS))
    down = max(1, math.ceil(tasks / across))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int")
    some = rows.withColumn("r", dealt(down)).withColumn("c", each(across)).withColumns({"kind": F.lit(1), "windows": F.lit(None).cast("array<long>")})
    asks = anchors.withColumn("c", dealt(across)).withColumn("r", each(down)).withColumn("kind", F.lit(0))
    names = ["kind", "row", "vec_id", "label", "x", "windows"]
    both = asks.select("r", "c", *names).unionByName(some.select("r", "c", *names))
    cell = (F.col("r") * across + F.col("c")).alias("cell")
    return both.select(cell, *names).repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "kind")


class _Cell:
    """Anchors of a cell and what they have found."""

    def __init__(self, parts: list[tuple], dimension: int, turn: np.ndarray, k: int, windows: int):
        self.row, self.label, self.x, bounds = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(self.label, kind="stable")
        self.row, self.label, self.x, bounds = self.row[order], self.label[order], self.x[order], bounds[order]
        self.codes, self.d, self.windows = encode(self.x, turn, ANCHOR_LEVELS), dimension, windows
        self.low, self.high = bounds[:, 0::2], bounds[:, 1::2]  # of each window; empty ones have low > high
        self.best = Best(len(self.row) * max(windows, 1), k)
        self.seen = self.scored = 0
        self.step = min(64, ROW_BLOCK)  # a few rows first: what they find is the limit for the others

    def meet(self, row: np.ndarray, ident: np.ndarray, label: np.ndarray, x: np.ndarray, turn: np.ndarray) -> None:
        codes = encode(x, turn, LEVELS)
        for b in range(0, len(self.row), ANCHOR_BLOCK):
            block = np.arange(b, min(b + ANCHOR_BLOCK, len(self.row)))
            wanted = (self.label[block][:, None] != label) if self.windows else (self.label[block][:, None] == label) & (self.row[block][:, None] != row)
            self.seen += int(wanted.sum())
            each, every = block[:, None], np.arange(len(row))[None]
            estimate, half = intervals(self.codes, codes, each, every, 0, 0.0, self.d)
            wanted &= self._may_matter(each, estimate, half)
            i, j = np.nonzero(wanted)
            estimate, i = estimate[i, j], block[i]
            for level in range(1, LEVELS):
                estimate, half = intervals(self.codes, codes, i, j, level, estimate, self.d)
                kept = self._may_matter(i, estimate, half)
                i, j, estimate = i[kept], j[kept], estimate[kept]
            self.scored += len(i)
            for at in range(0, len(i), 1 << 18):
                self._score(i[at : at + (1 << 18)], j[at : at + (1 << 18)], ident, x)

    def _may_matter(self, i: np.ndarray, estimate: np.ndarray, half: np.ndarray) -> np.ndarray:
        if not self.windows:
            return estimate + half >= self.best.least[i]
        out = np.zeros(estimate.shape, bool)
        for w in range(self.windows):
            least = np.maximum(self.low[i, w], self.best.least[i * self.windows + w])
            out |= (estimate + half >= least) & (estimate - half <= self.high[i, w]) & (self.low[i, w] <= self.high[i, w])
        return out

    def _score(self, i: np.ndarray, j: np.ndarray, ident: np.ndarray, x: np.ndarray) -> None:
        score = np.einsum("nd,nd->n", self.x[i], x[j])
        if not self.windows:
            self.best.add(i, score, ident[j])
        for w in range(self.windows):
            inside = (score >= self.low[i, w]) & (score <= self.high[i, w])
            self.best.add(i[inside] * self.windows + w, score[inside], ident[j[inside]])

    def found(self) -> pa.RecordBatch:
        place, rank = np.nonzero(self.best.score > _LOWEST)
        many = max(self.windows, 1)
        columns = [self.row[place // many], (place % many).astype(np.int32), self.best.ident[place, rank], self.best.score[place, rank]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "w", "vec_id", "score"])

    def counts(self) -> pa.RecordBatch:
        """The pairs met and the pairs scored, in place of what was found."""
        return pa.RecordBatch.from_arrays([pa.array(c) for c in ([self.seen], np.array([0], np.int32), [self.scored], [0])], ["row", "w", "vec_id", "score"])


def _met(grid: DataFrame, dimension: int, k: int, windows: int, count: bool = False) -> DataFrame:
    """row, w, vec_id, score: the ``k`` best that each anchor meets in each cell; with ``count`` the pairs met (row) and scored (vec_id) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dimension)
        now, asks, cell = None, [], None
        for whole in batches:
            cells = whole.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                batch = whole.slice(lo, hi - lo)
                if cells[lo] != now:
                    if cell:
                        yield cell.counts() if count else cell.found()
                    now, asks, cell = cells[lo], [], None
                kind, row, ident, label = (batch.column(c).to_numpy() for c in (1, 2, 3, 4))
                first = int((kind == 0).sum())
                x = matrix(batch.column(5), dimension, np.int64)
                if first:
                    bounds = matrix(batch.column(6).slice(0, first), 2 * windows, np.int64) if windows else np.zeros((first, 0), np.int64)
                    asks.append((row[:first], label[:first], x[:first], bounds))
                if first < len(kind) and asks:
                    cell = cell or _Cell(asks, dimension, turn, k, windows)
                    at = first
                    while at < len(kind):
                        part = slice(at, at + cell.step)
                        cell.meet(row[part], ident[part], label[part], x[part], turn)
                        at, cell.step = at + cell.step, min(2 * cell.step, ROW_BLOCK)
        if cell:
            yield cell.counts() if count else cell.found()

    return grid.mapInArrow(run, "row long, w int, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Prepared:
    """Rows (row, vec_id, label, x), anchors (those and no windows), and their counts."""

    rows: DataFrame
    anchors: DataFrame
    n: int
    asking: int
    dimension: int


def prepared(rows: DataFrame, anchors: str) -> Prepared | None:
    """``rows`` (vec_id, label, x) of the usual length, numbered; None if there is no row or no anchor (an SQL condition)."""
    kept = stored(rows, "negatives-steps")
    dimension = usual_length(kept, "x")
    if dimension is None:
        return None
    kept = kept.where(F.size("x") == dimension)
    largest = kept.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double")))))).collect()[0][0]
    if largest**2 * dimension >= 2.0**62:
        raise OverflowError(f"components up to {largest:g} in {dimension} dimensions have scores that a long can't hold")
    numbered = stored(kept.withColumn("row", F.monotonically_increasing_id()).withColumn("windows", F.lit(None).cast("array<long>")), "negatives-rows")
    asks = numbered.where(anchors)
    asking = asks.count()
    return Prepared(numbered, asks, numbered.count(), asking, dimension) if asking else None


def positives(p: Prepared, k: int = POSITIVES) -> DataFrame:
    """row, positive_id, positive_score, w (from 0): the first ``k`` other rows of each anchor's label."""
    found = _met(_grid(p.rows, p.anchors, p.n, p.asking), p.dimension, k, 0)
    return _first(found, k).select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("w"))


def _windows(good: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """row, windows: the lowest and highest score wanted for each of an anchor's ``k`` positives; 1, 0 where there is none."""
    floor = lambda share: f"(positive_score * {share} - pmod(positive_score * {share}, 100)) div 100"
    bounds = good.select("row", "w", F.expr(f"-({floor(-least)})").alias("low"), F.expr(floor(most)).alias("high"))
    none = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    of = bounds.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", F.array("low", "high")))).alias("of"))  # k entries
    return of.select("row", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("of", i), none))).alias("windows"))


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: str, k_positives: int = POSITIVES, k_negatives: int = NEGATIVES, least: int = LEAST_SHARE, most: int = MOST_SHARE) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, x) that meet the SQL condition ``anchors``.

    Of an anchor row, positives are the first ``k_positives`` other rows of its label by inner product;
    for each, the first ``k_negatives`` rows of other labels with least*positive <= 100*negative <=
    most*positive. Ties go to the smaller vec_id. Rows are rows: one that repeats, or repeats an id,
    counts as often as it is there, as anchor, positive and negative.

    Vectors of another length than most, and empty ones, take no part. An anchor without positives, or
    a positive without negatives, gives no row; so do empty tables. An OverflowError says that scores
    could exceed a long. Further columns of ``rows`` are not read.
    """
    spark = rows.sparkSession
    p = prepared(rows.select("vec_id", "label", "x"), anchors)
    if p is None:
        return spark.createDataFrame([], SCHEMA)
    good = stored(positives(p, k_positives), "negatives-positives")
    asks = stored(p.anchors.drop("windows").join(_windows(good, k_positives, least, most), "row"), "negatives-anchors")
    found = _first(_met(_grid(p.rows, asks, p.n, p.asking), p.dimension, k_negatives, k_positives), k_negatives)
    pairs = found.select("row", "w", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = good.join(asks.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.join(pairs, ["row", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def pairs_counted(rows: DataFrame, anchors: str, k: int = POSITIVES) -> tuple[int, int]:
    """Pairs of anchor and row that the search for positives meets, and those that it scores."""
    p = prepared(rows, anchors)
    if p is None:
        return 0, 0
    got = _met(_grid(p.rows, p.anchors, p.n, p.asking), p.dimension, k, 0, count=True).agg(F.sum("row"), F.sum("vec_id")).collect()[0]
    return int(got[0] or 0), int(got[1] or 0)
