"""Quality scores by a generalised additive model with pairwise interactions.

Features of a whole text are counted over the Arrow buffers. Boosting goes round the features in
turn; each step fits a shallow tree to the gradient sums of one feature's bins and adds its leaves
to that feature's lookup table. The pairs with the most residual gain then get tables of two
dimensions in the same way. Scoring is binning and additions of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import bounded_sample, fold, held_out
from roadweave.llm.textbytes import Chunk, chunks

#: Labelled rows that the tables are fitted on at most.
TRAIN_ROWS = 20_000
BINS = 32
GRID = 8
PAIRS = 6
THRESHOLD = 0.3

#: Classes of bytes: 0 continuation, 1 lower or other letter, 2 upper, 3 digit, 4 white, 5 stop mark, 6 bang, 7 symbol.
_CLASS = np.zeros(256, np.int64)
_CLASS[192:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, *range(9, 14)]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 5
_CLASS[[33, 63]] = 6
_CLASS[[i for i in range(128) if not _CLASS[i]]] = 7

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "bang", "stop", "lines_per_word",
    "distinct", "repeated", "same_lines", "line_words", "lone_symbol", "longest_word", "bare_end",
)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def _chunk_features(chunk: Chunk) -> np.ndarray:
    n, buf, offs = chunk.n, chunk.buf, chunk.offs
    doc = np.repeat(np.arange(n, dtype=np.int64) * 8, np.diff(offs))
    kinds = _CLASS[buf]
    accented = np.zeros(len(buf), bool)
    accented[:-1] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    kinds[accented] = 2
    by = np.bincount(doc + kinds, minlength=8 * n).reshape(n, 8).astype(float)
    letters = by[:, 1] + by[:, 2]
    chars = by[:, 1:].sum(1)
    starts, ends, of = chunk.words
    words = np.bincount(of, minlength=n).astype(float)
    h = chunk.hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    some = np.maximum(words, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    symbol_word = (ends - starts == 1) & (kinds[starts] >= 5) if len(starts) else np.zeros(0, bool)
    bare = ~np.isin(kinds[ends - 1], (5, 6, 7)) if len(starts) else np.zeros(0, bool)
    longest = np.zeros(n)
    np.maximum.at(longest, of, (ends - starts).astype(float))
    cut = np.flatnonzero(buf == 10)
    bounds = np.unique(np.concatenate([offs, cut, cut + 1]))
    lo, hi = bounds[:-1], bounds[1:]
    real = buf[lo] != 10 if len(lo) else np.zeros(0, bool)
    lo, hi = lo[real], hi[real]
    line_of = np.searchsorted(offs, lo, side="right") - 1
    lines = np.bincount(line_of, minlength=n).astype(float)
    own_lines = _distinct(line_of, chunk.hashes(lo, hi), n) if len(lo) else np.zeros(n)
    last = np.zeros(n)
    if len(starts):
        final = np.searchsorted(of, np.arange(n), side="right") - 1
        has = words > 0
        last[has] = bare[final[has]]
    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    return np.column_stack([
        np.log1p(chars), np.log1p(words), share(chars - by[:, 4], words), share(by[:, 2], letters), share(by[:, 3], chars), share(by[:, 7], chars),
        share(by[:, 6], chars), share(by[:, 5], chars), share(lines, words), _distinct(of, h, n) / some, np.bincount(of[again], minlength=n) / some,
        1 - share(own_lines, lines), np.log1p(share(words, lines)), np.bincount(of[symbol_word], minlength=n) / some, np.log1p(longest), last,
    ])


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; null and empty texts have the same."""
    parts = [_chunk_features(c) for c in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 4.0, ridge: float = 1.0) -> np.ndarray:
    """Leaf value of each bin, from a tree of that depth over its gradient and curvature sums."""
    total_g, total_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        rg, rh = total_g - lg, total_h - lh
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge), -1.0)
        at = int(np.argmax(gain))
        if gain[at] > total_g**2 / (total_h + ridge) + 1e-9:
            return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1, least, ridge), _tree(g[at + 1 :], h[at + 1 :], depth - 1, least, ridge)])
    return np.full(len(g), -total_g / (total_h + ridge))


def _tree2(g: np.ndarray, h: np.ndarray, least: float = 4.0, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the better tree that cuts one axis, then each side along the other."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    base = g.sum() ** 2 / (h.sum() + ridge)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for at in range(1, a.shape[0]):
            leaves = np.empty_like(a)
            gain = -base
            for rows in (slice(0, at), slice(at, None)):
                ga, hb = a[rows].sum(0), b[rows].sum(0)
                side = _tree(ga, hb, 1, least, ridge)
                leaves[rows] = side
                gain += float((-2 * ga * side - (hb + 0) * side**2).sum())
            if gain > best[0]:
                best = (gain, leaves.T.copy() if flip else leaves)
    return best


@dataclass
class Gam:
    """Bin edges and lookup tables; ``pairs`` has (i, j, table over coarse bins)."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[bins[:, i]]
        for i, j, t in self.pairs:
            z += t[bins[:, i] * GRID // BINS, bins[:, j] * GRID // BINS]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> Gam:
    """Tables from feature rows and 0/1 labels; without rows the score is 0.5 for all."""
    if not len(x):
        return Gam([np.zeros(0)] * len(FEATURES), [np.zeros(BINS)] * len(FEATURES), 0.0)
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) for i in range(x.shape[1])]
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(edges, [np.zeros(BINS) for _ in edges], float(np.log(prior / (1 - prior))))
    bins = model.bins(x)
    z = model.margin(bins)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i in range(x.shape[1]):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[:, i], g, BINS), np.bincount(bins[:, i], h, BINS), 2)
            model.tables[i] += step
            z += step[bins[:, i]]
    coarse = bins * GRID // BINS
    g, h = slopes()
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        cell = coarse[:, i] * GRID + coarse[:, j]
        gains.append((_tree2(np.bincount(cell, g, GRID * GRID).reshape(GRID, GRID), np.bincount(cell, h, GRID * GRID).reshape(GRID, GRID))[0], i, j))
    chosen = [(i, j, np.zeros((GRID, GRID))) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, t in chosen:
            cell = coarse[:, i] * GRID + coarse[:, j]
            g, h = slopes()
            step = rate * _tree2(np.bincount(cell, g, GRID * GRID).reshape(GRID, GRID), np.bincount(cell, h, GRID * GRID).reshape(GRID, GRID))[1]
            t += step
            z += step[coarse[:, i], coarse[:, j]]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Gam:
    """A model from ``labels`` (doc_id, quality) outside the held-out fold, ``rows`` of them at most.

    A doc_id with several labels is what most of them say, one with several texts counts once, by
    its least features. The sample's ids are few (``rows``), so they are broadcast; only features
    reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", mod) != held)).select(F.col("doc_id").cast("long").alias("_rw_id"), (F.col("quality") > 0).cast("double").alias("_rw_y"))
    sample = bounded_sample(known.groupBy("_rw_id").agg((F.avg("_rw_y") >= 0.5).cast("double").alias("_rw_y")), "_rw_id", rows)
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_rw_id"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = both.select("text", "doc_id", "_rw_y").mapInArrow(profile, "doc_id long, y double, x array<double>")
    got = got.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()  # ``rows`` ids
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in got]))


def with_quality(docs: DataFrame, model: Gam, text: str = "text", out: str = "_rw_quality") -> DataFrame:
    """``docs`` plus a column ``out``: the score of each whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(features(texts)), pa.float64())

    return docs.withColumn(out, score(F.col(text).cast("string")))


def classify(docs: DataFrame, model: Gam, mod: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; repeated rows give repeated results, a null doc_id is not held out."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = with_quality(lean, model)
    return got.select("doc_id", held_out("doc_id", mod, held), F.col("_rw_quality").alias("score"), (F.col("_rw_quality") >= threshold).cast("int").alias("predicted"))
