"""Vectorised words and hashes over the UTF-8 buffers of Arrow string columns.

A batch is walked in chunks of about ``CHUNK`` bytes (a single longer text makes a chunk of its
own), so memory in a task follows the longest text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


#: Powers that a worker keeps (16 bytes each); those of longer texts are made anew.
KEPT = 1 << 22


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) > n:
        return _powers["up"], _powers["down"]
    size = max(n + 1, 1 << 20)
    made = {}
    for name, base in (("up", _BASE), ("down", _INVERSE)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made[name] = np.cumprod(steps, dtype=np.uint64)
    if size <= KEPT:
        _powers.update(made)
    return made["up"], made["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


@dataclass
class Chunk:
    """Texts ``lo`` to ``hi`` of a batch: ``buf`` holds their bytes, ``offs`` their bounds in it."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    @cached_property
    def _down(self) -> np.ndarray:
        return _power_table(len(self.buf))[1]

    @cached_property
    def prefix(self) -> np.ndarray:
        up, _ = _power_table(len(self.buf))
        sums = np.empty(len(self.buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range; equal bytes have equal hashes wherever they stand."""
        raw = (self.prefix[ends] - self.prefix[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of each run of non-white bytes."""
        buf = self.buf
        if not len(buf):
            none = np.zeros(0, np.int64)
            return none, none, none
        black = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        inner = np.unique(self.offs[(self.offs > 0) & (self.offs < len(buf))])
        begins = black.copy()
        begins[1:] &= ~black[:-1]
        begins[inner] = black[inner]
        stops = black.copy()
        stops[:-1] &= ~black[1:]
        stops[inner - 1] = black[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, np.searchsorted(self.offs, starts, side="right") - 1


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Chunk(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def shingles(chunk: Chunk, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of each distinct word shingle, by text and hash.

    A text of fewer words than ``width`` has one shingle, of all its words; one without words none.
    """
    starts, ends, doc = chunk.words
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = chunk.hashes(starts, ends)
    _, down = _power_table(width)
    n = len(h)
    first = np.searchsorted(doc, np.arange(chunk.n), side="left")
    count = np.bincount(doc, minlength=chunk.n)
    total = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        total[: n - j] += h[j:] * down[j + 1]
    whole = np.zeros(n, bool)
    if n >= width:
        whole[: n - width + 1] = doc[width - 1 :] == doc[: n - width + 1]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        place = np.arange(n) - first[doc]
        some = count[doc] < width
        sums = np.zeros(chunk.n, np.uint64)
        np.add.at(sums, doc[some], h[some] * down[place[some] + 1])
        total[first[short]] = sums[short]
        whole[first[short]] = True
    d, s = doc[whole], mix(total[whole])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(s)))
