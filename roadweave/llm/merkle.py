"""Merkle-tree fingerprints of documents.

Leaves are runs of words that end at a line end, at a word whose hash says so, or after ``LONGEST``
words, so an edit moves only the leaves around it. Leaves of a line make a paragraph, paragraphs up
to one whose hash says so make a section, sections the root. A fingerprint is the root, then the
sections, paragraphs and leaves, each node as its hash and number of children. Every byte belongs
to a leaf. Sections have a BLAKE2 digest of 128 bits of their bytes, the root one of its sections'
digests, so equal roots mean equal texts; paragraphs and leaves have 32 bits, which only compare the
inside of two sections that differ.

Two trees are compared by descent: equal subtrees are counted whole, only differing ones are opened.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import partitions_for
from roadweave.llm.textbytes import Chunk, _power_table, chunks, mix

LONGEST = 8
#: One word in so many ends a leaf, one paragraph in so many a section.
LEAF_ODDS = 4
SECTION_ODDS = 4
#: Rows of a range of neighbouring documents, and the most ranges (the driver sees one key of each).
RANGE_ROWS = 4000
MOST_RANGES = 20_000

_SECTION = np.dtype([("hash", "S17"), ("children", ">u4")])
_NODE = np.dtype([("hash", ">u4"), ("children", ">u4")])


@dataclass
class Tree:
    root: str
    sections: np.ndarray
    paragraphs: np.ndarray
    leaves: np.ndarray

    def text(self) -> str:
        """The fingerprint: root/sections/paragraphs/leaves in hex."""
        return "/".join([self.root, *(a.tobytes().hex() for a in (self.sections, self.paragraphs, self.leaves))])


def parse(fingerprint: str) -> Tree:
    root, s, p, leaves = fingerprint.split("/")
    return Tree(root, np.frombuffer(bytes.fromhex(s), _SECTION), np.frombuffer(bytes.fromhex(p), _NODE), np.frombuffer(bytes.fromhex(leaves), ">u4"))


def _unmatched(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places in each list whose values the other does not have as often."""
    spare_a, spare_b = Counter(b), Counter(a)
    left, right = [], []
    for i, x in enumerate(a):
        if spare_a[x] > 0:
            spare_a[x] -= 1
        else:
            left.append(i)
    for i, x in enumerate(b):
        if spare_b[x] > 0:
            spare_b[x] -= 1
        else:
            right.append(i)
    return left, right


def _children(nodes: np.ndarray, opened: list[int]) -> list[int]:
    """Places of the children of the opened nodes."""
    ends = np.cumsum(nodes["children"].astype(np.int64))
    return [k for i in opened for k in range(int(ends[i] - nodes["children"][i]), int(ends[i]))]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Values in common, by multiplicity."""
    if not len(a) or not len(b):
        return 0
    both = np.concatenate([a, b]).astype(np.int64) * 2
    both[len(a) :] += 1
    both.sort()
    values, sides = both >> 1, both & 1
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    of_b = np.add.reduceat(sides, at)
    return int(np.minimum(of_b, np.diff(np.append(at, len(both))) - of_b).sum())


def compared(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """How alike two trees are, and the (section, paragraph) of ``a`` that ``b`` lacks, by descent.

    Likeness is 1 for equal roots, else the share of leaves in common (Dice, by multiplicity), below
    1. Sections that both have are not opened, nor are paragraphs; what they hold is in common.
    """
    if a.root == b.root:
        return 1.0, []
    sections = _unmatched(a.sections["hash"].tolist(), b.sections["hash"].tolist())
    inside = [_children(t.sections, opened) for t, opened in zip((a, b), sections, strict=True)]
    spare = _unmatched(*(t.paragraphs["hash"][of].tolist() for t, of in zip((a, b), inside, strict=True)))
    opened = [[of[i] for i in own] for of, own in zip(inside, spare, strict=True)]
    leaves = [t.leaves[_children(t.paragraphs, own)] for t, own in zip((a, b), opened, strict=True)]
    n = len(a.leaves) + len(b.leaves)
    common = len(a.leaves) - len(leaves[0]) + _common(*leaves)
    section_of = np.repeat(np.arange(len(a.sections)), a.sections["children"].astype(np.int64))
    return float(min(2 * common / n, 1 - 1 / (n + 1))) if n else 0.0, [(int(section_of[k]), k) for k in opened[0]]


def likeness(a: Tree, b: Tree) -> float:
    """How alike two trees are, from 0 to 1."""
    return compared(a, b)[0]


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` that ``b`` lacks."""
    return compared(a, b)[1]


def _parents(child: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each run of children, from their hashes and places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(child)))
    place = np.arange(len(child)) - np.repeat(starts, sizes)
    up, _ = _power_table(int(place.max(initial=0)) + 1)
    return mix(np.add.reduceat(mix(child + np.uint64(salt)) * up[place + 1], starts) + sizes.astype(np.uint64))


def _chunk_trees(c: Chunk) -> list[Tree]:
    starts, ends, doc = c.words
    n = c.n
    lo = hi = np.zeros(0, np.int64)
    if len(starts):
        h = c.hashes(starts, ends)
        following = np.append(starts[1:], len(c.buf))
        lines = np.concatenate([[0], np.cumsum(c.buf == 10)])
        last = np.append(doc[1:] != doc[:-1], True)
        line_end = (lines[following] > lines[ends]) | last
        cut = line_end | (h % np.uint64(LEAF_ODDS) == 0)
        index = np.arange(len(h))
        begun = np.maximum.accumulate(np.where(np.append(True, cut[:-1]), index, 0))
        cut |= (index - begun) % LONGEST == LONGEST - 1
        stop = np.flatnonzero(cut)
        first = np.append(0, stop[:-1] + 1)
        # A leaf runs to the next leaf's first word; the text's ends belong to its first and last leaf.
        lo, hi = starts[first].copy(), following[stop].copy()
        leaf_doc = doc[first]
        opens = np.append(True, leaf_doc[1:] != leaf_doc[:-1])
        closes = np.append(opens[1:], True)
        lo[opens] = c.offs[leaf_doc[opens]]
        hi[closes] = c.offs[leaf_doc[closes] + 1]
        leaf = c.hashes(lo, hi)
        para_at = np.flatnonzero(np.append(True, line_end[stop][:-1]))
    else:
        leaf, leaf_doc, para_at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    para = _parents(leaf, para_at, 1)
    para_doc = leaf_doc[para_at]
    opens = np.append(True, para_doc[1:] != para_doc[:-1]) if len(para) else np.zeros(0, bool)
    sect_at = np.flatnonzero(opens | np.append(False, para[:-1] % np.uint64(SECTION_ODDS) == 0)) if len(para) else np.zeros(0, np.int64)
    sect_doc = para_doc[sect_at]
    nodes = np.empty(len(para), _NODE)
    nodes["hash"] = para & np.uint64(0xFFFFFFFF)
    nodes["children"] = np.diff(np.append(para_at, len(leaf)))
    tops = np.empty(len(sect_at), _SECTION)
    tops["children"] = np.diff(np.append(sect_at, len(para)))
    leaf_at = para_at[sect_at]
    whole = memoryview(np.ascontiguousarray(c.buf))
    ends_at = np.append(leaf_at[1:], len(leaf))[: len(leaf_at)] - 1
    # A digest never ends in a zero byte (numpy would cut it off).
    tops["hash"] = [hashlib.blake2b(whole[x:y], digest_size=16).digest() + b"." for x, y in zip(lo[leaf_at].tolist(), hi[ends_at].tolist(), strict=True)]
    spans = [np.searchsorted(d, np.arange(n + 1)) for d in (sect_doc, para_doc, leaf_doc)]
    short = (leaf & np.uint64(0xFFFFFFFF)).astype(">u4")
    trees = []
    for i in range(n):
        own = tops[spans[0][i] : spans[0][i + 1]]
        # A text of nothing but white space has no section: its root is of its bytes.
        of = b"s" + own.tobytes() if len(own) else b"w" + bytes(c.buf[c.offs[i] : c.offs[i + 1]])
        root = hashlib.blake2b(of, digest_size=16).hexdigest()
        trees.append(Tree(root, own, nodes[spans[1][i] : spans[1][i + 1]], short[spans[2][i] : spans[2][i + 1]]))
    return trees


def trees(texts: list[str]) -> list[Tree]:
    """The tree of each whole text."""
    return [t for c in chunks(pa.array(texts, pa.large_string())) for t in _chunk_trees(c)]


def fingerprint_column(texts: pa.Array) -> pa.Array:
    return pa.array([t.text() for c in chunks(texts) for t in _chunk_trees(c)], pa.string())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` plus the fingerprint of each whole text; null counts as empty."""
    column = F.arrow_udf("string")(lambda texts: fingerprint_column(texts))
    return docs.withColumn(out, column(F.col(text).cast("string")))


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (key, tie, text) dealt to ranges of falling key and tie; a range also gets the next one's first rows.

    A key that fills several ranges (null ids, say) is cut by its rows' ties. Rows alike in both stay
    together. The driver sees one key for each range, ``MOST_RANGES`` at most.
    """
    spark = docs.sparkSession
    n = docs.count()
    parts = min(partitions_for(spark, n, RANGE_ROWS), MOST_RANGES)
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), max(10_000, 10 * parts))).collect()[0][0] if shares else []
    splits, often = np.unique(np.array(found or [], np.int64), return_counts=True)
    slices = np.where(often > 1, often, 0)  # ranges of a split's own rows, before the other rows down to the next split
    size = slices + 1
    # Ranges are counted from the top: one above all splits, then those of each split.
    first = np.append(1 + np.cumsum(size[::-1])[::-1] - size, 0)
    count = 1 + int(size.sum())

    @F.arrow_udf("int")
    def range_of(keys: pa.Array, ties: pa.Array) -> pa.Array:
        k = keys.to_numpy(zero_copy_only=False)
        at = np.searchsorted(splits, k, side="left")
        out = first[at]
        if len(splits):
            near = np.minimum(at, len(splits) - 1)
            m = np.where(at < len(splits), slices[near], 0)
            falling = ((1 << 63) - 1 - ties.to_numpy(zero_copy_only=False).astype(np.float64)) / float(1 << 64)
            own = (m > 0) & (splits[near] == k)
            out = out + np.where(own, np.minimum((falling * m).astype(np.int64), m - 1), m)
        return pa.array(out, pa.int32())

    dealt = docs.withColumn("part", range_of("key", "tie"))
    firsts = sorted(dealt.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("top")).collect())
    guests = [(firsts[(i + 1) % len(firsts)]["top"]["key"], firsts[(i + 1) % len(firsts)]["top"]["tie"], row["part"]) for i, row in enumerate(firsts)]
    table = spark.createDataFrame(guests or [(0, 0, -1)], "_rw_key long, _rw_tie long, _rw_to int")
    places = F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("_rw_to").alias("part"), F.lit(1).alias("guest")))
    dealt = dealt.join(F.broadcast(table), (F.col("key") == F.col("_rw_key")) & (F.col("tie") == F.col("_rw_tie")), "left")  # one row a range
    dealt = dealt.withColumn("_rw_place", F.explode(F.filter(places, lambda p: p["part"].isNotNull())))
    return dealt.select("_rw_place.part", "_rw_place.guest", "key", "tie", "doc_id", "text"), count


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, of ``docs`` (doc_id, text).

    The edited text has the last third replaced by the beginning of the next document, by falling
    doc_id, after the last the first; rows of one doc_id follow each other by a hash of their text.
    Null texts count as empty, null ids come last. A single document is its own next one. ``differs``
    are the (section, paragraph) of the text's tree that the edited text's lacks.
    """
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lean = lean.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    dealt, parts = _ranges(lean)
    sorted_ = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "guest", F.desc("key"), F.desc("tie"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, differs array<struct<section: int, paragraph: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        branch = pa.list_(pa.struct([("section", pa.int32()), ("paragraph", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                given = trees([r[3] for r in rows])
                seen = ([waiting] if waiting else []) + list(zip(rows, given, strict=True))
                out: list[tuple] = []
                edits: list[str] = []
                for (row, tree), (follower, next_tree) in zip(seen, seen[1:]):
                    if row[1] or row[0] != follower[0]:
                        continue  # a guest, or a range's end, which its guest precedes
                    n = len(row[3])
                    third = n // 3
                    edits.append(row[3][: n - third] + follower[3][:third])
                    out.append((row[2], n, tree, next_tree))
                waiting = seen[-1]
                after = trees(edits)
                found = [compared(o[2], t) for o, t in zip(out, after, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                        pa.array([o[2].text() for o in out], pa.string()),
                        pa.array([t.text() for t in after], pa.string()),
                        pa.array([near for near, _ in found], pa.float64()),
                        pa.array([likeness(o[2], o[3]) for o in out], pa.float64()),
                        pa.array([[{"section": s, "paragraph": p} for s, p in branches] for _, branches in found], branch),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "differs"],
                )

    return sorted_.select("part", "guest", "doc_id", "text").mapInArrow(run, schema)
