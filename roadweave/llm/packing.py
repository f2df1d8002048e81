"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Tokenising is one Arrow pass. A text is cut at its spaces into chunks whose tokens do not depend on
their neighbours (the byte-level pre-tokeniser starts a new piece at each single space); chunks are
looked up in a bounded memo of two generations and only new ones go through the tokeniser. Texts in which a space
stands before white space or the end, or that may hold a special token, are tokenised whole.

Packing needs only how often each length occurs, a table of at most ``capacity`` rows. From it the
driver makes *patterns* (a multiset of lengths, repeated n times) by best-two-fit; pieces are then
given to pattern slots by their number among the pieces of the same length. Numbers come from
counts per (length, salt), so a length that a third of all rows share is numbered by many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stored

CAPACITY = 1024
END_ID = 2
#: Distinct chunks in a generation of a worker's memo (speed only).
MEMO = 100_000
_loaded: dict[str, "ChunkTokenizer"] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes take the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The file is one of the ``tokenizers`` library. Where it is a byte-level BPE whose merges stand in
    the order of their ids, single chunks go through ``tiktoken`` with ranks read from that file,
    which gives the same ids several times faster; a sample is compared when the file is loaded, and
    ``tokenizers`` does all the work if anything differs.
    """

    #: A space before white space or at the end would share a piece with what follows.
    _joined = re.compile(r" (?=\s|\Z)")
    _pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._fast = self._ranked(path)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made.get("model", {})
        special = {t["content"] for t in made.get("added_tokens", [])}
        byte_of = _byte_of()
        try:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            fast = tiktoken.Encoding("chunks", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None
        words = [bytes(k).decode("utf-8", "ignore") for k in list(ranks)[:: max(1, len(ranks) // 1000)]]
        tests = [" ".join(words[i : i + 20]) + "\n" + "".join(words[i : i + 5]) + " it's 1234 été — ß!!" for i in range(0, len(words), 20)]
        same = all(fast.encode_ordinary(x) == self._tok.encode(x, add_special_tokens=False).ids for x in tests)
        return fast.encode_ordinary if same else None

    @classmethod
    def load(cls, path: str) -> "ChunkTokenizer":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self._tok.encode_batch(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._whole([text])[0]
        if self._joined.search(text):
            return array("I", self._fast(text)).tobytes() if self._fast else self._whole([text])[0]
        first, *rest = text.split(" ")
        parts = [" " + x for x in rest]
        if first:
            parts.insert(0, first)
        young = self._young
        try:
            return b"".join([young[x] for x in parts])
        except KeyError:
            pass
        old, fast = self._old, self._fast
        missing = [x for x in parts if x not in young]
        if len(young) > MEMO:
            self._old, self._young = young, {}
            old, young = young, self._young
            missing = parts
        unknown = []
        for x in missing:
            got = old.get(x)
            if got is not None:
                young[x] = got
            elif fast:
                young[x] = array("I", fast(x)).tobytes()
            else:
                unknown.append(x)
        if unknown:
            young.update(zip(unknown, self._whole(unknown), strict=True))
        return b"".join([young[x] for x in parts])


def piece_bounds(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole if it fits, else full pieces after a shorter first one."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, (head if s == 0 and head else capacity)) for s in starts]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A null text counts as empty: one piece that holds only the end id. Repeated rows each give
    their own pieces; other columns are ignored. ``_rw_place`` numbers the rows of a task, so that
    repeated rows can be told apart once the table is stored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _rw_place int" + (", ids array<int>" if with_ids else "")
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer.load(tokenizer)
        place = 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "_rw_place", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(tok.encode(text.as_py() or "") + end)
                for i, (start, length) in enumerate(piece_bounds(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(i)
                    rows["start"].append(start)
                    rows["length"].append(length)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    rows["_rw_place"].append(place & 0x7FFFFFFF)
                    place += 1
                    if with_ids:
                        rows["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
            keep = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in list(zip(rows.values(), types, strict=True))[:keep]], list(rows)[:keep])

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def two_fit_patterns(counts: dict[int, int], capacity: int, loose: int) -> list[tuple[int, list[int]]]:
    """Patterns (times, lengths) that use each length exactly as often as counted.

    A bin opens with the longest length left and is filled greedily with the longest that fits.
    Where more than ``loose`` is left over, its smallest length then gives way to the two unpacked
    lengths that fit the widened gap more tightly, if there are such. Equal bins are made together, as many as the counts allow.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left)
    patterns: list[tuple[int, list[int]]] = []

    def longest(most: int, used: dict[int, int]) -> int:
        i = bisect_right(order, most)
        while i:
            i -= 1
            if left[order[i]] > used.get(order[i], 0):
                return order[i]
        return 0

    while order:
        used: dict[int, int] = {}
        bin_: list[int] = []
        gap = capacity
        while gap and (got := longest(gap, used)):
            bin_.append(got)
            used[got] = used.get(got, 0) + 1
            gap -= got
        if gap > loose and len(bin_) > 1:
            small = min(bin_)
            room, best = gap + small, (small, 0, 0)
            used[small] -= 1
            for a in order[: bisect_right(order, room - 1)][::-1]:
                if 2 * a <= best[0]:
                    break
                if left[a] > used.get(a, 0):
                    used[a] = used.get(a, 0) + 1
                    b = longest(min(a, room - a), used)
                    used[a] -= 1
                    if b and a + b > best[0]:
                        best = (a + b, a, b)
                        if best[0] == room:
                            break
            if best[1]:
                bin_.remove(small)
                bin_ += [best[1], best[2]]
                used[best[1]] = used.get(best[1], 0) + 1
                used[best[2]] = used.get(best[2], 0) + 1
            else:
                used[small] += 1
        times = min(left[k] // n for k, n in used.items() if n)
        patterns.append((times, bin_))
        for k, n in used.items():
            left[k] -= times * n
            if n and not left[k]:
                del left[k]
                order.remove(k)
    return patterns


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """The patterns with the fewest bins over several tolerances.

    Filling every gap to the last token uses up the short lengths that later bins need.
    """
    plans = [two_fit_patterns(counts, capacity, loose) for loose in (0, 1, 2, 4, 8, 16, 32, 64, 128)]
    return min(plans, key=lambda p: sum(times for times, _ in p))


@dataclass
class Slots:
    """Where the pieces of each length go: runs of numbers, by length and first number."""

    keys: np.ndarray
    firsts: np.ndarray
    sequences: np.ndarray
    places: np.ndarray
    begins: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, patterns: list[tuple[int, list[int]]]) -> "Slots":
        runs: list[tuple[int, int, int, list[int]]] = []
        numbered: dict[int, int] = {}
        sequence = 0
        for times, bin_ in patterns:
            own: dict[int, list[int]] = {}
            at = 0
            for length in bin_:
                own.setdefault(length, []).append(at)
                at += length
            for length, offsets in own.items():
                first = numbered.get(length, 0)
                runs.append((length, first, sequence, offsets))
                numbered[length] = first + times * len(offsets)
            sequence += times
        runs.sort(key=lambda r: r[:2])
        sizes = np.array([len(r[3]) for r in runs], np.int64)
        columns = [np.array([r[i] for r in runs], np.int64) for i in range(3)]
        flat = np.array([x for r in runs for x in r[3]], np.int64)
        return cls(cls.key(columns[0], columns[1]), columns[1], columns[2], sizes, np.cumsum(sizes) - sizes, flat)

    @staticmethod
    def key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (length << 44) + number

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these numbers among those of their length."""
        at = np.searchsorted(self.keys, self.key(length, number), side="right") - 1
        rel = number - self.firsts[at]
        return self.sequences[at] + rel // self.places[at], self.offsets[self.begins[at] + rel % self.places[at]]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with doc_id, piece, length and perhaps _rw_place) plus sequence_id and offset.

    Pieces of one length are alike for packing. They are numbered by salt (a hash of the row and its
    place in the table), then within it by doc_id, piece and the other columns, so neither a hot
    length nor rows that repeat each other meet in one task.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    salts = max(1, -(-n // 20_000))
    columns = [c for c in pieces.columns if c != "_rw_place"]
    own = [c for c in ("doc_id", "piece", "_rw_place") if c in pieces.columns]
    salted = pieces.withColumn("_rw_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    per = salted.groupBy("length", "_rw_salt").agg(F.count(F.lit(1)).alias("_rw_n"))
    per = per.withColumn("_rw_before", F.sum("_rw_n").over(Window.partitionBy("length").orderBy("_rw_salt").rowsBetween(Window.unboundedPreceding, -1)))
    per = stored(per, "pack-counts")
    # At most ``capacity`` rows reach the driver.
    counts = {int(r[0]): int(r[1]) for r in per.groupBy("length").agg(F.sum("_rw_n")).collect()}
    shared = spark.sparkContext.broadcast(Slots.of(best_two_fit(counts, capacity)))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        found = shared.value.find(lengths.to_numpy(zero_copy_only=False).astype(np.int64), numbers.to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    ordered = Window.partitionBy("length", "_rw_salt").orderBy(*own, *[c for c in columns if c not in (*own, "length", "ids")])
    joined = (
        salted.withColumn("_rw_no", F.row_number().over(ordered) - 1)
        .join(per.select("length", "_rw_salt", "_rw_before"), ["length", "_rw_salt"])
        .withColumn("_rw_at", place("length", F.col("_rw_no") + F.coalesce("_rw_before", F.lit(0))))
    )
    return joined.select(*columns, "_rw_at.sequence_id", "_rw_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text): one row per piece.

    Documents longer than ``capacity`` tokens are cut, the remainder first; no others are. Null and
    empty texts are one end id. Repeated rows and equal ids are packed as rows of their own. An
    empty table gives an empty result. Extra columns, whatever their names, are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(tokenise(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity)
