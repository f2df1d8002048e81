"""Toxicity by a lexicon trie, a Levenshtein automaton, and context windows.

The lexicon is learned: words, and stems of words, that toxic documents of the training fold have
significantly more often than others, each with its log-odds. The automaton of all strings within one edit (a swap of neighbours counts as one) is
intersected with the trie of the lexicon: its states are sets of (trie node, edits), made when first
reached, so a word that leads nowhere is left after a few characters. Each hit is looked at in a
window of words: quotation marks and words of reporting make it a quotation, an address in the
second person abuse. A logistic model over these sums gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import bounded_sample, fold, held_out, stored
from roadweave.llm.textbytes import chunks, shingles

#: Labelled rows that lexicon and model are learned from at most; entries of a lexicon at most.
TRAIN_ROWS = 16_000
ENTRIES = 1000
THRESHOLD = 0.3
WINDOW = 8
#: Likelihood ratio statistic that a word needs (20: one chance word in 130,000), and its least odds ratio.
SIGNIFICANT, LEAST_RATIO = 20.0, 6.0
#: Most that the weights of a text's hits add up to, and most that an entry weighs.
CAP = 15.0
MOST_ODDS = 8.0
#: Letters of the words that may be learned, and of the stems.
WORD_LETTERS = (3, 30)
STEM_LETTERS = (4, 7)
#: What a quoted hit counts, and how many times the hits that a text has by chance are taken away.
QUOTED = 1 / 3
CHANCE = 2.0
#: Letters that an entry has at least for misspellings of it to count.
FUZZY_LETTERS = 5
#: Known words that a worker keeps before it starts anew (speed only).
MEMO = 1_000_000

#: Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
#: Words of reporting, and of address, in the corpus languages.
REPORTING = frozenset("said says say quote quoted quotes wrote called word words term dit dijo dice sagte sagt zitat wort mot palabra écrit schrieb".split())
ADDRESS = frozenset("you your youre du dein deine ihr tu ton toi vous votre usted tú vosotros eres".split())
QUOTES = frozenset("\"'«»„“”‚‘’›‹`")
_SPLIT = re.compile(r"[^\W_]+(?:[$@!€*.][^\W_]+)*")
_PLAIN = re.compile(r"[^\W\d_]+")


class Automaton:
    """Words within one edit of a lexicon of words and stems (a stem also takes any ending)."""

    def __init__(self, entries: Iterable[tuple[str, bool]], fuzzy: Iterable[bool]):
        self.entries = list(entries)
        self.fuzzy = [f and len(w) >= FUZZY_LETTERS for (w, _), f in zip(self.entries, fuzzy, strict=True)]
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.bends: list[bool] = [False]  # whether an entry below takes misspellings
        for k, (word, stem) in enumerate(self.entries):
            node = 0
            for c in word:
                self.bends[node] |= self.fuzzy[k]
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word_at.append(-1)
                    self.stem_at.append(-1)
                    self.bends.append(False)
                node = self.children[node][c]
            self.bends[node] |= self.fuzzy[k]
            (self.stem_at if stem else self.word_at)[node] = k
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.result: list[tuple[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self._state(frozenset(), None)  # 0: nothing can match
        self.start = self._state(self._closed({(0, 0, "")}), None)

    def _closed(self, places: set[tuple[int, int, str]]) -> frozenset:
        out = set(places)
        for node, edits, swap in places:
            if edits == 0 and not swap:
                out |= {(child, 1, "") for child in self.children[node].values() if self.bends[child]}
        return frozenset(out)

    def _state(self, places: frozenset, held: tuple[int, int] | None) -> int:
        """The number of a state; ``held`` is the stem (edits, entry) that the word already began with."""
        best = held
        for node, edits, swap in places:
            if swap:
                continue
            k = self.stem_at[node]
            if k >= 0 and (not edits or self.fuzzy[k]) and (held is None or (edits, k) < held):
                held = (edits, k)
        key = (places, held)
        if key not in self.states:
            self.states[key] = len(self.content)
            self.content.append(key)
            best = held
            for node, edits, swap in places:
                k = -1 if swap else self.word_at[node]
                if k >= 0 and (not edits or self.fuzzy[k]) and (best is None or (edits, k) < best):
                    best = (edits, k)
            self.result.append(best or (-1, -1))
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        places, held = self.content[state]
        out: set[tuple[int, int, str]] = set()
        for node, edits, swap in places:
            nexts = self.children[node]
            if swap:  # the second letter of a swapped pair
                if c == swap:
                    out.add((node, 1, ""))
                continue
            if c in nexts:
                out.add((nexts[c], edits, ""))
            if not edits and self.bends[node]:
                out.add((node, 1, ""))
                for d, child in nexts.items():
                    if self.bends[child]:
                        out.add((child, 1, ""))
                        if c in self.children[child] and d != c:
                            out.add((self.children[child][c], 1, d))
        if not out and held is None:
            return 0
        return self._state(self._closed(out), held)

    def match(self, word: str) -> tuple[int, int]:
        """(edits, entry) of the best entry, or (-1, -1)."""
        state = self.start
        for c in word:
            moves = self.moves[state]
            after = moves.get(c)
            if after is None:
                after = moves[c] = self._move(state, c)
            state = after
            if not state:
                return (-1, -1)
        return self.result[state]


def spellings(token: str) -> Iterator[str]:
    """A token's words: as written, with signs read as letters, and without stretched letters."""
    for piece in _SPLIT.findall(token):
        plain = _PLAIN.fullmatch(piece)
        if plain:
            yield piece
        else:
            yield from _PLAIN.findall(piece)
            read = piece.translate(LEET)
            yield re.sub(r"[\W\d_]", "", read)
            piece = read
        short = re.sub(r"(.)\1{2,}", r"\1", piece)
        if short != piece:
            yield re.sub(r"[\W\d_]", "", short)


@dataclass
class Model:
    entries: list[tuple[str, bool]] = field(default_factory=list)
    fuzzy: list[bool] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.8, 0.6, 0.3, 0.3]))
    rates: dict[int, float] = field(default_factory=dict)


class Matcher:
    """Hits of whole texts; each distinct word goes through the automaton once in a worker's life."""

    def __init__(self, entries: list[tuple[str, bool]], fuzzy: list[bool]):
        self.automaton = Automaton(entries, fuzzy)
        self._known, self._codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def code(self, token: str) -> int:
        """0, or 1 + 2 * entry + (1 if misspelled)."""
        best = (9, -1)
        for word in spellings(token):
            edits, k = self.automaton.match(word)
            if k >= 0:
                best = min(best, (edits, k))
        return 0 if best[1] < 0 else 1 + 2 * best[1] + (best[0] > 0)

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, float, bool]]]]:
        """(row, hits as (code, weight of address, in quotation)) of each text that has any, after (0, its words, False)."""
        for c in chunks(pc.utf8_lower(texts)):
            starts, ends, doc = c.words
            if not len(starts):
                continue
            h, at, back = np.unique(c.hashes(starts, ends), return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self._known, h), max(len(self._known) - 1, 0))
            new = self._known[place] != h if len(self._known) else np.ones(len(h), bool)
            if new.any():
                data = c.buf.tobytes()
                made = np.array([self.code(data[starts[i] : ends[i]].decode("utf-8", "replace")) for i in at[new]], np.int32)
                keep = len(self._known) < MEMO
                known = np.concatenate([self._known, h[new]]) if keep else h[new]
                codes = np.concatenate([self._codes, made]) if keep else made
                fresh = np.zeros(len(h), np.int32)
                fresh[new] = made
                if len(self._known):
                    fresh[~new] = self._codes[place[~new]]
                order = np.argsort(known, kind="stable")
                self._known, self._codes = known[order], codes[order]
            else:
                fresh = self._codes[place]
            found = np.flatnonzero(fresh[back])
            if not len(found):
                continue
            data = c.buf.tobytes()
            by: dict[int, list] = {}
            lengths = np.bincount(doc, minlength=c.n)
            for i in found.tolist():
                d = int(doc[i])
                lo, hi = i, i
                while lo > 0 and i - lo < WINDOW and doc[lo - 1] == d:
                    lo -= 1
                while hi + 1 < len(doc) and hi - i < WINDOW and doc[hi + 1] == d:
                    hi += 1
                before = data[starts[lo] : starts[i]].decode("utf-8", "replace")
                word = data[starts[i] : ends[i]].decode("utf-8", "replace")
                after = data[ends[i] : ends[hi]].decode("utf-8", "replace")
                by.setdefault(d, [(0, float(lengths[d]), False)]).append((int(fresh[back[i]]), *context(before, word, after)))
            yield from ((c.lo + d, found_) for d, found_ in by.items())


def context(before: str, word: str, after: str) -> tuple[float, bool]:
    """Address (0 or 1) and whether the window makes the word a quotation."""
    words = _PLAIN.findall(f"{before} {after}")
    address = float(any(w in ADDRESS for w in words))

    def marks(text: str) -> int:
        return sum(ch in QUOTES and not (ch in "'’" and 0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha()) for i, ch in enumerate(text))

    enclosed = (word[:1] in QUOTES and word.rstrip(".,;:!?")[-1:] in QUOTES) or (marks(before) % 2 == 1 and marks(after) >= 1)
    reported = any(w in REPORTING for w in words)
    return address, bool(enclosed and (reported or not address))


def summed(hits: list[tuple], weights: list[float], rates: dict[int, float] | None = None) -> np.ndarray:
    """The model's inputs: log-odds of plain and of misspelled hits, their number, address; quoted hits count a third.

    A hit is (code, address, quoted), or equal ones with their number as a fourth part; code 0 tells
    the words of the text. From the hits of a code ``CHANCE`` times those are taken away that a text
    of so many words which is not toxic has (``rates``: hits a word).
    """
    words = address = 0.0
    shares: dict[int, float] = {}
    for code, you, quoted, *times in hits:
        if not code:
            words = you
            continue
        shares[code] = shares.get(code, 0.0) + (QUOTED if quoted else 1.0) * (times[0] if times else 1)
        if not quoted:
            address = max(address, you)
    plain = bent = number = 0.0
    for code, share in shares.items():
        share = max(0.0, share - CHANCE * words * (rates or {}).get(code, 0.0))
        number += share
        if code % 2:
            plain += share * weights[(code - 1) // 2]
        else:
            bent += share * weights[(code - 1) // 2]
    return np.array([1.0, min(plain, CAP), min(bent, CAP), np.log1p(number), address if number else 0.0])


def chance_rates(seen: list[tuple[int, list]]) -> dict[int, float]:
    """Hits of each code for each word of the texts that are not toxic."""
    hits: Counter = Counter()
    for toxic, own in seen:
        if not toxic:
            for code, words, _, times in own:
                hits[code] += times if code else words
    total = hits.pop(0, 0)
    return {code: n / total for code, n in hits.items()} if total else {}


def learn_lexicon(tokens: DataFrame, entries: int = ENTRIES) -> list[tuple[str, bool, float]]:
    """(word, whether a stem, log-odds) from ``tokens`` (text key, toxic, token; distinct), most significant first.

    Spark counts over the sample; the driver gets at most ``entries`` rows.
    """
    texts = tokens.groupBy("h").agg(F.max("toxic").alias("toxic")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")).collect()[0]
    toxic, clean = float(texts["t"] or 0), float(texts["n"] or 0)
    if not toxic or not clean:
        return []
    per = stored(tokens.groupBy("token").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")), "toxic-counts")
    words = per.select(F.col("token").alias("entry"), "t", "n", F.lit(False).alias("stem"))
    prefix = F.explode(F.transform(F.sequence(F.lit(STEM_LETTERS[0]), F.lit(STEM_LETTERS[1])), lambda k: F.substr("token", F.lit(1), k)))
    stems = per.where(f"length(token) >= {STEM_LETTERS[1]}").withColumn("entry", prefix).groupBy("entry").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
    stems = stems.where("t >= 8 and forms >= 4").select("entry", "t", "n", F.lit(True).alias("stem"))
    t, n, base = F.col("t"), F.col("n"), toxic / (toxic + clean)
    surprise = 2 * (t * F.log(t / ((t + n) * base)) + F.when(n > 0, n * F.log(n / ((t + n) * (1 - base)))).otherwise(0.0))
    odds = F.log((t + base) / toxic) - F.log((n + 1 - base) / clean)
    found = words.unionByName(stems).where("t >= 4").select("entry", "stem", "t", "n", surprise.alias("llr"), odds.alias("odds"))
    found = found.where((F.col("llr") >= SIGNIFICANT) & (F.col("odds") >= float(np.log(LEAST_RATIO)))).orderBy(F.desc("llr"), "entry", "stem").limit(entries)
    rows = [(r["entry"], r["stem"], min(r["odds"], MOST_ODDS), r["t"] + r["n"]) for r in found.collect()]
    # Of nested stems that nearly the same words have, the longest says most.
    spare = {a for a, stem, _, of_a in rows if stem and any(other and b != a and b.startswith(a) and of_b >= 0.9 * of_a for b, other, _, of_b in rows)}
    return [(entry, stem, odds) for entry, stem, odds, _ in rows if not (stem and entry in spare)]


def _tokens(sample: DataFrame) -> DataFrame:
    """Distinct (text key, toxic, token) of the sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                h, y, t = [], [], []
                for text, key, toxic in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    own = {w for w in _PLAIN.findall(text.lower()) if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1]}
                    h += [key] * len(own)
                    y += [toxic] * len(own)
                    t += own
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array(t, pa.string())], ["h", "toxic", "token"])

    return sample.select("text", "h", "toxic").mapInArrow(run, "h long, toxic int, token string")


def _observed(sample: DataFrame, entries: list[tuple[str, bool]], fuzzy: list[bool]) -> list[tuple[int, list]]:
    """(toxic, hits) of each sampled text; all hits, those of equal code and quotation as one with the largest address and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, fuzzy)
        for batch in batches:
            found: dict[int, list] = dict(matcher.hits(batch.column(0)))
            lengths = np.concatenate([np.bincount(c.words[2], minlength=c.n) for c in chunks(pc.utf8_lower(batch.column(0)))] or [np.zeros(0)])
            hits = []
            for i in range(batch.num_rows):
                sums: dict[tuple[int, bool], tuple[float, int]] = {(0, False): (float(lengths[i]), 0)}
                for c, a, q in found.get(i, []):
                    most, n = sums.get((c, q), (a, 0))
                    sums[c, q] = max(most, a), n + 1
                hits.append([{"code": c, "address": a, "quoted": q, "times": n} for (c, q), (a, n) in sums.items()])
            kind = pa.list_(pa.struct([("code", pa.int32()), ("address", pa.float64()), ("quoted", pa.bool_()), ("times", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(hits, kind)], ["h", "toxic", "hits"])

    rows = sample.select("text", "h", "toxic").mapInArrow(run, "h long, toxic int, hits array<struct<code: int, address: double, quoted: boolean, times: int>>").collect()
    rows.sort(key=lambda r: (r["h"], r["toxic"]))
    return [(r["toxic"], [(x["code"], x["address"], x["quoted"], x["times"]) for x in r["hits"]]) for r in rows]


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method with halved steps, drawn to ``prior``."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and model from ``labels`` (doc_id, toxic) outside the held-out fold, ``rows`` of them at most.

    Copies and most near copies of a text count once (they share their least shingle), toxic if most
    of their labels are; so do all texts without words, which have no hits. A doc_id with several
    labels is what most of them say. Misspellings of an entry stay off where texts that are not toxic
    have them more often than toxic ones. Without labels of both kinds every text has one low score.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", mod) != held))
    mostly = (F.avg("toxic") >= 0.5).cast("int").alias("toxic")
    known = bounded_sample(known.select(F.col("doc_id").cast("long").alias("_rw_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("_rw_id").agg(mostly), "_rw_id", rows)
    lean = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = lean.join(F.broadcast(known), F.col("doc_id") == F.col("_rw_id")).select("text", "toxic")  # ``rows`` ids

    @F.arrow_udf("long")
    def least_shingle(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.uint64)
        for c in chunks(pc.utf8_lower(texts)):
            doc, h, _ = shingles(c)
            low = np.full(c.n, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(low, doc, h)
            out[c.lo : c.hi] = low
        return pa.array(out.view(np.int64))

    sample = sample.withColumn("h", least_shingle("text")).groupBy("h").agg(mostly, F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = bounded_sample(stored(sample, "toxic-sample"), "h", rows)
    lexicon = learn_lexicon(stored(_tokens(sample), "toxic-tokens"))
    if not lexicon:
        return Model()
    entries = [(w, stem) for w, stem, _ in lexicon]
    fuzzy = [not stem for _, stem in entries]
    seen = _observed(sample, entries, fuzzy)
    # What a hit of an entry weighs: its log-odds by texts, as a stem's words often stand together.
    by_texts = [Counter(k for y, hits in seen if y == side for k in {(c - 1) // 2 for c, *_ in hits if c % 2}) for side in (0, 1)]
    all_texts = [sum(y == side for y, _ in seen) for side in (0, 1)]
    base = all_texts[1] / len(seen)
    weights = [float(min(MOST_ODDS, np.log((by_texts[1][k] + base) / all_texts[1]) - np.log((by_texts[0][k] + 1 - base) / all_texts[0]))) for k in range(len(entries))]
    bad, fair = Counter(), Counter()
    for toxic, hits in seen:
        exact = any(c % 2 for c, *_ in hits)
        for k in {(c - 1) // 2 for c, *_ in hits if c and not c % 2}:
            if not exact:
                (fair if toxic else bad)[k] += 1
    fuzzy = [f and bad[k] <= fair[k] for k, f in enumerate(fuzzy)]
    seen = [(y, [x for x in hits if not x[0] or x[0] % 2 or fuzzy[(x[0] - 1) // 2]]) for y, hits in seen]
    rates = chance_rates(seen)
    x = np.array([summed(h, weights, rates) for _, h in seen])
    y, prior = np.array([float(y) for y, _ in seen]), Model().coefficients
    # Labelled misspellings are rare: what a plain hit counts, less a fifth, is the prior for them.
    prior[2] = 0.8 * _logistic(x, y, prior)[1]
    return Model(entries, fuzzy, weights, _logistic(x, y, prior), rates)


_matchers: dict[int, Matcher] = {}


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "_rw_toxic") -> DataFrame:
    """``docs`` plus a column ``out``: the score of each whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = hash((tuple(model.entries), tuple(model.fuzzy)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(m.entries, m.fuzzy)
        x = np.tile(summed([], m.weights), (len(texts), 1))
        for i, hits in _matchers[key].hits(texts):
            x[i] = summed(hits, m.weights, m.rates)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ m.coefficients, -30, 30))))

    return docs.withColumn(out, score(F.col(text).cast("string")))


def classify(docs: DataFrame, model: Model, mod: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; repeated rows give repeated results, a null doc_id is not held out."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = with_toxicity(lean, model)
    return got.select("doc_id", held_out("doc_id", mod, held), F.col("_rw_toxic").alias("score"), (F.col("_rw_toxic") >= threshold).cast("int").alias("predicted"))
