"""Every asking row against every row, as a grid of cells, with the best found so far as the limit.

Rows are dealt to R parts and asking rows to C; a cell is one part of each and one task. It holds its
asking rows (``most`` at most) and streams the other rows past them, so pairs are never rows, the plan
does not grow with the asking rows, and each side is read once. Parts are dealt by position, so no key
or repeated value fills one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Asking rows that a task holds at most, and pairs of a cell, about.
ASKING = 65_536
PAIRS = 1 << 32


def cells(rows: DataFrame, asks: DataFrame, n: int, asking: int, order: tuple[str, ...] = (), most: int = ASKING) -> DataFrame:
    """_cell, _kind (0 asks, 1 is asked) and the columns of both sides (null where a side lacks one), a cell's asking rows first, its rows by ``order``."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * asking / PAIRS))
    across = max(math.ceil(math.sqrt(tasks * asking / max(n, 1))), math.ceil(asking / most), 1)
    down = max(1, math.ceil(tasks / across))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int")
    left = asks.withColumn("_across", dealt(across)).withColumn("_down", each(down)).withColumn("_kind", F.lit(0))
    right = rows.withColumn("_down", dealt(down)).withColumn("_across", each(across)).withColumn("_kind", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_cell", F.col("_down") * across + F.col("_across")).drop("_down", "_across")
    names = ["_cell", "_kind", *[c for c in both.columns if c not in ("_cell", "_kind")]]
    return both.select(*names).repartitionById(down * across, F.col("_cell")).sortWithinPartitions("_cell", "_kind", *order)


class Best:
    """The ``k`` smallest values of each place, ties to the smaller first payload; at least the values that can still matter are taken."""

    def __init__(self, places: int, k: int, payloads: int):
        self.k, self.value = k, np.full((places, k), np.inf)
        self.payload = [np.empty((places, k), object) for _ in range(payloads)]

    @property
    def worst(self) -> np.ndarray:
        return self.value[:, -1]

    def add(self, place: np.ndarray, value: np.ndarray, *payload: np.ndarray) -> None:
        own = np.unique(place)
        if not len(own):
            return
        held = np.isfinite(self.value[own])
        places = np.concatenate([np.repeat(own, self.k)[held.ravel()], place])
        value = np.concatenate([self.value[own][held], value])
        payload = [np.concatenate([p[own][held], np.asarray(new, object)]) for p, new in zip(self.payload, payload, strict=True)]
        tie = np.unique(payload[0], return_inverse=True)[1]
        order = np.lexsort((tie, value, places))
        places, value = places[order], value[order]
        rank = np.arange(len(places)) - np.searchsorted(places, places)
        kept = rank < self.k
        self.value[own] = np.inf
        self.value[places[kept], rank[kept]] = value[kept]
        for p, new in zip(self.payload, payload, strict=True):
            p[places[kept], rank[kept]] = new[order][kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """place, value and payloads of all that is held."""
        place, rank = np.nonzero(np.isfinite(self.value))
        return place, self.value[place, rank], [p[place, rank] for p in self.payload]


def streamed(grid: DataFrame, make: Callable[[pa.Table], object], schema: T.StructType) -> DataFrame:
    """What each cell finds. ``make`` gets a cell's asking rows and gives an object with ``meet(rows)`` for each batch of rows and ``found()``, a record batch at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, cell = None, [], None
        for whole in batches:
            numbers = whole.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if hi == lo:
                    continue
                part = whole.slice(lo, hi - lo)
                if numbers[lo] != now:
                    if cell:
                        yield cell.found()
                    now, asks, cell = numbers[lo], [], None
                first = int((part.column(1).to_numpy() == 0).sum())
                if first:
                    asks.append(part.slice(0, first))
                if first < part.num_rows and asks:
                    cell = cell or make(pa.Table.from_batches(asks))
                    cell.meet(part.slice(first))
        if cell:
            yield cell.found()

    return grid.mapInArrow(run, schema)
