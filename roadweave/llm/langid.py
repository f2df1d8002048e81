"""Language identification by hierarchical discrimination.

A first set of one-versus-one linear support vector machines tells language families apart, a
second set, trained within each family, its closely related languages. Features are hashed byte
3- and 4-grams of the lower-cased whole text, as square roots of their shares. Machines are fitted
on a bounded sample of labelled rows by accelerated gradient descent on the squared hinge; scoring
counts n-grams over the Arrow buffers, so the work follows the bytes of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import bounded_sample, fold, held_out
from roadweave.llm.textbytes import Chunk, chunks

#: Rows that the machines are fitted on at most.
TRAIN_ROWS = 2000
BITS = 12
WIDTHS = (3, 4)
#: Families of some ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "Germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "Romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "Slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "Uralic": ("et", "fi", "hu"),
    "Turkic": ("az", "kk", "ky", "tr", "tk", "uz"),
    "Indo-Aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "Semitic": ("am", "ar", "he", "mt"),
}


def family_of(lang: str) -> str:
    """The family of a language code."""
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


@dataclass
class Machines:
    """One-versus-one machines over ``classes``: a weight row for each pair, scaled to margins."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index and share of certainty (0 to 1) of each text from margins (texts x pairs)."""
        n, k = grams.shape[0], len(self.classes)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        votes, sums = np.zeros((n, k)), np.zeros((n, k))
        for p, (a, b) in enumerate(combinations(range(k), 2)):
            m = grams[:, p] + self.bias[p]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sure = 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
            sums[:, a] += sure
            sums[:, b] += 1 - sure
        best = np.argmax(votes + sums / (10 * k), axis=1)
        return best, sums[np.arange(n), best] / (k - 1)


@dataclass
class Model:
    families: Machines
    within: list[Machines]
    bits: int = BITS


def _counts(chunk: Chunk, bits: int) -> np.ndarray:
    """Counts of the hashed 3- and 4-grams of bytes of each text, none across texts."""
    buf, offs = chunk.buf.astype(np.uint32), chunk.offs
    base = np.repeat(np.arange(chunk.n, dtype=np.int64) << bits, np.diff(offs))
    counts = np.zeros(chunk.n << bits, np.int64)
    for width in WIDTHS:
        n = len(buf) - width + 1
        if n <= 0:
            continue
        h = buf[:n] * np.uint32(0x01000193)
        for j in range(1, width):
            h += buf[j : n + j]
            h *= np.uint32(0x01000193)
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - bits)
        flat = base[:n] + h
        ends = offs[1:-1]
        across = np.concatenate([ends - j for j in range(1, width)]) if len(ends) else ends
        across = np.unique(across[(across >= 0) & (across < n)])
        counts += np.bincount(flat, minlength=len(counts))
        counts -= np.bincount(flat[across], minlength=len(counts))
    return counts.reshape(chunk.n, -1)


#: Bytes that become one space before n-grams are taken: controls, digits and ASCII punctuation.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:65] = 32
_PLAIN[91:97] = 32
_PLAIN[123:128] = 32


#: Texts of a chunk at most: each takes a row of counts, however short it is.
CHUNK_ROWS = 512


def _plain(texts: pa.Array) -> Iterator[Chunk]:
    for at in range(0, len(texts), CHUNK_ROWS):
        for chunk in chunks(pc.utf8_lower(texts.slice(at, CHUNK_ROWS)), 1 << 18):
            yield Chunk(at + chunk.lo, at + chunk.hi, _PLAIN[chunk.buf], chunk.offs)


def _profiles(texts: pa.Array, bits: int) -> np.ndarray:
    """Square roots of the feature shares of each text."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for chunk in _plain(texts):
        out[chunk.lo : chunk.hi] = _counts(chunk, bits)
    total = np.maximum(out.sum(1, keepdims=True), 1)
    return out / total


def _fit(x: np.ndarray, y: list[str], steps: int = 80, penalty: float = 1e-4) -> Machines:
    classes = sorted(set(y))
    index = np.array([classes.index(v) for v in y])
    weights, biases = [], []
    for a, b in combinations(range(len(classes)), 2):
        rows = np.flatnonzero((index == a) | (index == b))
        xs = x[rows]
        sign = np.where(index[rows] == a, 1.0, -1.0).astype(np.float32)
        weigh = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
        w, v, bias, vb, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0, 1.0
        rate = 1 / (2 * (float(np.max((xs * xs).sum(1))) + 1) + penalty)
        for _ in range(steps):
            slack = np.maximum(0, 1 - sign * (xs @ v + vb))
            pull = -2 * weigh * sign * slack
            w_new, b_new = v - rate * (xs.T @ pull + penalty * v), vb - rate * float(pull.sum())
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - bias)
            w, bias, t = w_new.astype(np.float32), b_new, t_new
        weights.append(w)
        biases.append(bias)
    return Machines(classes, np.array(weights, np.float32).reshape(-1, x.shape[1]), np.array(biases))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> Model | None:
    """Machines from labelled ``docs`` (doc_id, text, lang), ``rows`` of them at most.

    The profiles are made in tasks; the driver gets ``rows`` of them. None if nothing is labelled.
    """
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sample = bounded_sample(labelled, "doc_id", rows)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _profiles(part.column(0), bits).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    got = sample.select("text", F.col("doc_id").cast("long").alias("doc_id"), "lang").mapInArrow(profile, "doc_id long, lang string, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["x"]))
    if not got:
        return None
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    x = np.sqrt(x)
    y = [r["lang"] for r in got]
    families = [family_of(v) for v in y]
    top = _fit(x, families)
    within = []
    for name in top.classes:
        rows_of = [i for i, v in enumerate(families) if v == name]
        within.append(_fit(x[rows_of], [y[i] for i in rows_of]))
    return Model(top, within, bits)


def _predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    machines = [model.families, *model.within]
    bounds = np.cumsum([0] + [len(m.weights) for m in machines])
    n = len(texts)
    langs, scores = np.full(n, "und", object), np.zeros(n)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    table = np.concatenate([m.weights for m in machines]).T.copy()
    for chunk in _plain(texts):
        x = _counts(chunk, model.bits).astype(np.float32)
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
        margins = x @ table
        family, sure = model.families.scores(margins[:, bounds[0] : bounds[1]])
        for f, m in enumerate(model.within):
            at = np.flatnonzero(family == f)
            if len(at):
                best, share = m.scores(margins[at, bounds[f + 1] : bounds[f + 2]])
                langs[chunk.lo + at] = np.array(m.classes, object)[best]
                scores[chunk.lo + at] = sure[at] * share
    langs[~letters] = "und"
    scores[~letters] = 0
    return list(langs), np.clip(scores, 0, 1)


def with_language(docs: DataFrame, model: Model | None, text: str = "text", out: str = "_rw_lang") -> DataFrame:
    """``docs`` plus a struct column ``out`` (lang_pred, score) for each whole text.

    ``und`` with score 0 if the text is null, has no letter, or nothing could be learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = shared.value
        if found is None:
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        else:
            langs, scores = _predict(texts, found)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(out, predict(F.col(text).cast("string")))


def identify(docs: DataFrame, model: Model | None, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; repeated rows give repeated results, a null doc_id is not held out."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = with_language(lean, model)
    return got.select("doc_id", held_out("doc_id", mod, held), "_rw_lang.lang_pred", "_rw_lang.score")


def learnable(docs: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """The rows that may be learned from: labelled, and not in the held-out fold."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", mod) != held))
