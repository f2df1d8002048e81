"""Secrets in texts: fixed patterns, and formats learned by grammar inference.

Spans of the fixed patterns in all texts are the labelled credentials; each distinct one counts once.
Beginnings that many of a kind share make a prefix tree, counted over all of them; its states are taken
most frequent first and merged with an earlier state where their frequencies of ending and of each next
character, and those of all states below, differ by less than Hoeffding's bound (otherwise they become
states of their own). Rare beginnings go on at the start, which no test could tell from them. All
credentials then run through the states, and what they pass is counted: a probabilistic automaton a kind.

Every token of 12 and more characters of all texts is scored: the logarithm of its likelihood as a
credential (the best automaton's) against that as a plain token (a chain of character pairs, counted
over all tokens outside credentials). A plain token has a score of t with a probability of
exp(-t) at most, as far as the chain describes it. Tokens above ``LEAST`` that touch no pattern's span
are added, as ``like_`` and the kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored

#: The patterns, the group that is the secret, and its least length.
PATTERNS = {
    "assign": (re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
KINDS = tuple(PATTERNS)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
#: A beginning is a state of the prefix tree if at least two, and one in ``SHARE``, of a kind's credentials have it, and it is
#: no longer than ``LONGEST``: this bounds the tree that the driver holds, not what is counted. Beginnings are counted by ``STEP`` lengths, then by twice as many.
SHARE = 500
LONGEST = 512
STEP = 16
#: Pairs of states that are remembered as not compatible.
PAIRS = 1_000_000
#: Level of the compatibility test; added to each count of a state's next characters.
ALPHA = 0.05
SMOOTH = 0.02
#: The score from which a token is added.
LEAST = 14.0
_EDGE = "^"


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' secrets, by start, then kind."""
    out = []
    for kind, (pattern, group, least) in enumerate(PATTERNS.values()):
        out += [(start, kind, end) for m in pattern.finditer(text) for start, end in [m.span(group)] if end - start >= least]
    return sorted(out)


def plain_tokens(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens that touch none of the spans (sorted by start)."""
    at, reach = 0, 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= start:
            yield start, end


@dataclass
class Automaton:
    """For each state: log-probability of each character and its next state, and log-probability of the end."""

    step: list[dict[str, tuple[float, int]]]
    end: list[float]

    def score(self, token: str) -> float:
        """The log-likelihood of a token of ALPHABET's characters."""
        total, state = 0.0, 0
        for c in token:
            p, state = self.step[state][c]
            total += p
        return total + self.end[state]


class _Tree:
    """A prefix tree with counts: strings through a state, strings that end in it, and next states (None: not kept) with their counts."""

    def __init__(self, values: Iterable[str]):
        self.through, self.ends, self.edges = [0], [0], [{}]
        for value in values:
            state = 0
            self.through[0] += 1
            for c in value:
                edge = self.edges[state].get(c)
                if edge is None:
                    edge = self.edges[state][c] = [len(self.through), 0]
                    self.through.append(0)
                    self.ends.append(0)
                    self.edges.append({})
                edge[1] += 1
                state = edge[0]
                self.through[state] += 1
            self.ends[state] += 1

    @classmethod
    def of_counts(cls, whole: int, rows: Iterable[tuple[str, int, int]], least: int) -> _Tree:
        """The tree of counted beginnings (text, strings that have it, strings that end there); those of fewer than ``least`` strings are no states."""
        tree = cls(())
        tree.through[0], place = whole, {"": 0}
        for text, n, ends in sorted(rows, key=lambda r: len(r[0])):
            state = None
            if n >= least:
                state = place[text] = len(tree.through)
                tree.through.append(n)
                tree.ends.append(ends)
                tree.edges.append({})
            tree.edges[place[text[:-1]]][text[-1]] = [state, n]
        return tree

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether no frequency of the two states themselves differs significantly."""
        m, n = self.through[a], self.through[b]
        most = bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
        left, right = self.edges[a], self.edges[b]
        if abs(self.ends[a] / m - self.ends[b] / n) > most:
            return False
        return all(abs((left[c][1] if c in left else 0) / m - (right[c][1] if c in right else 0) / n) <= most for c in left.keys() | right.keys())

    def compatible(self, a: int, b: int, alpha: float, apart: set[tuple[int, int]] | None = None) -> bool:
        """Whether no frequency of the states, or of those below them, differs significantly.

        ``apart``: pairs that are known not to be compatible, while the tree is as it is; those found are added.
        """
        apart = set() if apart is None else apart
        bound, pairs, above = math.sqrt(0.5 * math.log(2 / alpha)), [(a, b)], {(a, b): None}
        while pairs:
            pair = pairs.pop()
            if pair in apart or not self.alike(*pair, bound):
                while pair is not None:
                    apart.add(pair)
                    pair = above[pair]
                return False
            left, right = self.edges[pair[0]], self.edges[pair[1]]
            for c in left.keys() & right.keys():
                below = left[c][0], right[c][0]
                if None not in below and below not in above:
                    above[below] = pair
                    pairs.append(below)
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds state ``b`` and the tree below it to ``a``."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.through[a] += self.through[b]
            self.ends[a] += self.ends[b]
            for c, (state, n) in self.edges[b].items():
                edge = self.edges[a].get(c)
                if edge is None:
                    self.edges[a][c] = [state, n]
                    continue
                edge[1] += n
                if edge[0] is None:
                    edge[0] = state
                elif state is not None:
                    pairs.append((edge[0], state))


#: For each state, the state after and the count of each character, and the strings that end there.
States = list[tuple[dict[str, tuple[int, int]], int]]


def infer(values: Iterable[str], alpha: float = ALPHA) -> Automaton | None:
    """The automaton of some strings; None if there are none."""
    tree = _Tree(values)
    return weighed(merged(tree, alpha)) if tree.through[0] else None


def merged(tree: _Tree, alpha: float = ALPHA) -> States:
    """The states that are left of a tree (which is used up)."""
    kept, known, apart = [0], {0}, set()
    while True:
        open_edges = [(-tree.through[edge[0]], edge[0], state, c) for state in kept for c, edge in tree.edges[state].items() if edge[0] is not None and edge[0] not in known]
        if not open_edges:
            break
        _, new, parent, c = min(open_edges)
        if len(apart) > PAIRS:
            apart.clear()
        same = next((state for state in kept if tree.compatible(state, new, alpha, apart)), None)
        if same is None:
            kept.append(new)
            known.add(new)
        else:
            tree.edges[parent][c][0] = same
            tree.fold(same, new)
            apart.clear()  # counts have changed
    place = {None: 0} | {state: i for i, state in enumerate(kept)}
    return [({c: (place[to], n) for c, (to, n) in tree.edges[state].items()}, tree.ends[state]) for state in kept]


def weighed(states: States) -> Automaton:
    """Probabilities from counts; a character that no string has after a state leads where most others do."""
    step, end = [], []
    for i, (edges, ends) in enumerate(states):
        total = sum(n for _, n in edges.values()) + ends + SMOOTH * (len(ALPHABET) + 1)
        usual = max(edges.items(), key=lambda e: (e[1][1], e[0]))[1][0] if edges else i
        log = lambda n, total=total: math.log((n + SMOOTH) / total)
        step.append({c: (log(edges[c][1]), edges[c][0]) if c in edges else (log(0), usual) for c in ALPHABET})
        end.append(log(ends))
    return Automaton(step, end)


@dataclass
class Formats:
    """Automata by kind, and the log-probability of each character after another in plain tokens."""

    automata: dict[str, Automaton]
    plain: dict[str, dict[str, float]]

    def score(self, token: str) -> tuple[float, str]:
        """How much likelier the token is a credential, as a logarithm, and the kind; -inf without automata."""
        best = max(((a.score(token), kind) for kind, a in self.automata.items()), default=(-math.inf, ""))
        last, plain = _EDGE, 0.0
        for c in token:
            plain += self.plain[last][c]
            last = c
        return best[0] - plain - self.plain[last][_EDGE], best[1]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _beginnings(found: DataFrame, least: dict[str, int]) -> dict[str, list[tuple[str, int, int]]]:
    """By kind: each beginning of one character more than one that ``least`` credentials have, how many have it, and how many end there.

    Lengths are counted ``STEP`` at a time, then twice as many each time, over those credentials whose shorter beginnings are frequent.
    """
    spark = found.sparkSession
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("kind")]
    out: dict[str, list[tuple[str, int, int]]] = {kind: [] for kind in least}
    last = spark.createDataFrame([(kind, "") for kind in least], "kind string, parent string")
    low, step = 0, STEP
    while low < LONGEST:
        high = min(low + step, LONGEST)
        ends_at = F.least(F.length("value"), F.lit(high))
        rows = found.where(F.length("value") > low).withColumn("parent", F.substring("value", 1, low)).join(F.broadcast(last), ["kind", "parent"], "left_semi")  # ``SHARE`` rows a kind at most
        each = rows.select("kind", "value", F.explode(F.sequence(F.lit(low + 1), ends_at)).alias("k"))
        begun = each.select("kind", F.expr("substring(value, 1, k)").alias("text"), (F.length("value") == F.col("k")).cast("long").alias("end"))
        counted = stored(begun.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("ends")).withColumn("parent", F.expr("substring(text, 1, length(text) - 1)")), "beginnings")
        frequent = counted.where(F.col("n") >= bound).select("kind", F.col("text").alias("parent"))
        for r in counted.join(F.broadcast(frequent.unionByName(last)), ["kind", "parent"], "left_semi").collect():
            out[r["kind"]].append((r["text"], r["n"], r["ends"]))
        last = frequent.where(F.length("parent") == high)
        if last.isEmpty():
            break
        low, step = high, 2 * step
    return out


def _counted(found: DataFrame, states: dict[str, States]) -> dict[str, States]:
    """``states`` with the counts of all credentials; a character without a next state leads to the start."""
    ways = {kind: [{c: to for c, (to, _) in edges.items()} for edges, _ in of] for kind, of in states.items()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            for kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                way, state = ways[kind], 0
                for c in value:
                    passed[kind, state, c] += 1
                    state = way[state].get(c, 0)
                passed[kind, state, ""] += 1
        kinds, at, chars = zip(*passed, strict=True) if passed else ((), (), ())
        yield pa.RecordBatch.from_pydict({"kind": kinds, "state": at, "c": chars, "n": list(passed.values())}, schema=schema)

    schema = pa.schema([("kind", pa.string()), ("state", pa.int64()), ("c", pa.string()), ("n", pa.int64())])
    sums = found.select("kind", "value").mapInArrow(walk, "kind string, state long, c string, n long").groupBy("kind", "state", "c").agg(F.sum("n").alias("n"))
    edges: dict[str, list[dict[str, tuple[int, int]]]] = {kind: [{} for _ in of] for kind, of in states.items()}
    ends = {kind: [0] * len(of) for kind, of in states.items()}
    for r in sums.collect():  # the alphabet's characters a state
        kind, state, c = r["kind"], r["state"], r["c"]
        if c:
            edges[kind][state][c] = ways[kind][state].get(c, 0), r["n"]
        else:
            ends[kind][state] = r["n"]
    return {kind: list(zip(edges[kind], ends[kind], strict=True)) for kind in states}


def train(docs: DataFrame) -> Formats:
    """Formats of ``docs``: all documents are read, and every distinct credential and plain token's pair is counted.

    What the driver gets is bounded by the alphabet, ``SHARE`` and ``LONGEST``. Documents without
    credentials, and an empty table, give no automaton, and nothing is added to the patterns' spans.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter[str] = Counter()
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for text in batch.column(1).to_pylist():
                spans = pattern_spans(text)
                found.update((KINDS[kind], text[start:end]) for start, kind, end in spans)
                for start, end in plain_tokens(text, spans):
                    token = text[start:end]
                    pairs.update(map("".join, zip(_EDGE + token, token + _EDGE, strict=True)))
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in found], "value": [v for _, v in found], "n": [1] * len(found)}, schema=schema)
        yield pa.RecordBatch.from_pydict({"kind": ["plain"] * len(pairs), "value": list(pairs), "n": list(pairs.values())}, schema=schema)

    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())])
    every = _texts(docs).mapInArrow(gather, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    every = stored(every, "credentials-found")
    found = every.where("kind <> 'plain'").select("kind", "value")
    whole = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    automata = {}
    if whole:
        least = {kind: max(2, -(-n // SHARE)) for kind, n in whole.items()}
        begun = _beginnings(found, least)
        states = {kind: merged(_Tree.of_counts(whole[kind], begun[kind], least[kind])) for kind in KINDS if kind in whole}
        automata = {kind: weighed(of) for kind, of in _counted(found, states).items()}
    counts = {r["value"]: r["n"] for r in every.where("kind = 'plain'").collect()}  # the alphabet's pairs
    plain = {}
    for a in _EDGE + ALPHABET:
        own = {c: counts.get(a + c, 0) + 1 for c in ALPHABET + _EDGE}
        whole_of = sum(own.values())
        plain[a] = {c: math.log(n / whole_of) for c, n in own.items()}
    return Formats(automata, plain)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"


def find(docs: DataFrame, formats: Formats, least: float = LEAST) -> DataFrame:
    """doc_id, base, added of every document: the patterns' spans, and those of tokens that score ``least`` and more.

    A span has kind, start, end (code points, end exclusive) and score; of a pattern with a group it is
    the group, the secret itself. Spans are ordered by start, then kind as in KINDS; patterns of several
    kinds may overlap, added spans overlap nothing. Whole texts are read. A null or empty text has no
    spans, repeated rows and null ids give a row each, an empty table an empty result. Further columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, score = {}, shared.value.score
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                spans = pattern_spans(text)
                base.append([{"kind": KINDS[kind], "start": start, "end": end, "score": score(text[start:end])[0]} for start, kind, end in spans])
                more = []
                for start, end in plain_tokens(text, spans):
                    token = text[start:end]
                    got = known.get(token)
                    if got is None:
                        got = score(token)
                        if len(token) < 40:
                            if len(known) > 50_000:
                                known = {}
                            known[token] = got
                    if got[0] >= least:
                        more.append({"kind": f"like_{got[1]}", "start": start, "end": end, "score": got[0]})
                added.append(more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(added, pa.list_(_SPAN))], ["doc_id", "base", "added"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(scan, f"doc_id {ids}, base {SPANS}, added {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans (kind:start:end, joined by commas) of what ``find`` gives, and n_added."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.array(*(F.lit(k) for k in (*KINDS, *(f"like_{k}" for k in KINDS))))
    placed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.array_sort(placed(F.concat("base", "added")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
