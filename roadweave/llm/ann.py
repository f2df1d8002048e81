"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector with K random directions into cells of width W. A query visits, in each
table, its own bucket and then the perturbed ones (cells moved by -1, 0 or 1 in some directions) in
the order of their estimated success: the squared distance from its projections to the cell. What the
tables yield is merged and ranked by the exact distance.

K follows the number of rows, so that a bucket holds about ``BUCKET`` rows. How many buckets a query
visits is measured, not guessed: a bounded sample of queries is compared with a brute-force search
over all rows, and the smallest number of probes that reaches the wanted recall is taken. Where K
directions have no such number, K is lowered; where no K has one, all queries are searched exactly.
The sample's recall is measured again on the result, and less than ``LEAST`` of it is an error.
Vectors travel in blocks of one bucket, queries in groups. Blocks and groups are dealt as pairs, by all
that names a pair, so a bucket of any size is the work of many tasks; that a bucket is large is known
by a join on salted keys, which no bucket fills one task of.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stored

TABLES = 4
BUCKET = 1024
#: Rows of a block, queries of a group, and queries that the probes are measured with.
BLOCK = 1024
GROUP = 256
MEASURED = 64
#: Recall that the measured queries must reach (0.9 is asked for).
RECALL = 0.96
LEAST = 0.9
#: Queries that are sent to all rows at once where nothing but an exact search will do; more of them are dealt in pairs of blocks too.
EXACT = 4096
#: Tasks that a large bucket is dealt to at least, before it is blocks.
SALTS = 64
WIDTH = 1.6


@dataclass
class Hashes:
    """Directions (dimension x tables*K), offsets in cells, and the width of cells."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    k: int

    @classmethod
    def make(cls, dimension: int, k: int, scale: float, tables: int = TABLES, seed: int = 1) -> "Hashes":
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((dimension, tables * k)), rng.uniform(0, 1, tables * k), WIDTH * max(scale, 1e-12), k)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of cells, (rows x tables x K)."""
        return (x @ self.directions / self.width + self.offsets).reshape(len(x), -1, self.k)


def _codes(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cells (last axis)."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    for j in range(cells.shape[-1]):
        out = (out ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def probe_order(places: np.ndarray, count: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each table: (table, rank, code) of the ``count`` likeliest buckets of one query.

    ``places`` is (tables x K). The score of a perturbation is the sum of squared distances to the
    cells' near walls. All 3^K are listed for K up to 6; beyond it the directions nearest to a wall are.
    """
    tables, k = places.shape
    out = []
    for t in range(tables):
        cell = np.floor(places[t])
        rest = places[t] - cell
        moves = np.stack([rest, np.zeros(k), 1 - rest])  # distance to the wall below, none, above
        some = np.argsort(np.minimum(rest, 1 - rest))[: max(6, math.ceil(math.log(max(count, 1), 3)) + 1)]
        steps = np.array(list(product((-1, 0, 1), repeat=len(some))))
        score = np.zeros(len(steps))
        for j, d in enumerate(some):
            score += moves[steps[:, j] + 1, d] ** 2
        best = np.argsort(score, kind="stable")[:count]
        cells = np.repeat(cell[None], len(best), 0)
        cells[:, some] += steps[best]
        out.append((t, np.arange(len(best)), _codes(cells)))
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dimension)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the vectors that take part: no null, no non-finite part, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull()).where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, distances) of the ``k`` nearest ids of a block to each query, exactly, itself left out; an id by its nearest row."""
    order = np.argsort(ids, kind="stable")
    own, first = np.unique(ids[order], return_index=True)
    for i in range(len(q)):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        if len(own) < len(d):
            d, ids = np.minimum.reduceat(d[order], first), own
        d[ids == q_ids[i]] = np.inf
        if len(d) > k:
            worst = np.partition(d, k - 1)[k - 1]
            near = np.flatnonzero(d <= worst)  # ties stay
        else:
            near = np.arange(len(d))
        near = near[np.isfinite(d[near])]
        near = near[np.lexsort((ids[near], d[near]))][:k]
        yield int(q_ids[i]), ids[near], d[near]


class _Best:
    """The nearest found so far of many queries, given up when they are many."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query: int, ids: np.ndarray, d: np.ndarray) -> None:
        old = self.found.get(query)
        if old is not None:
            ids, d = np.concatenate([old[0], ids]), np.concatenate([old[1], d])
            order = np.lexsort((d, ids))
            ids, first = np.unique(ids[order], return_index=True)
            d = d[order][first]
        order = np.lexsort((ids, d))[: self.k]
        self.found[query] = (ids[order], d[order])

    def frame(self) -> pd.DataFrame:
        parts = [(q, i, s) for q, (ids, d) in self.found.items() for i, s in zip(ids.tolist(), d.tolist(), strict=True)]
        self.found = {}
        return pd.DataFrame(parts, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


_FOUND = "query_id long, vec_id long, score double"


def brute_force(base: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The exact nearest of a bounded list of queries among all of ``base`` (id, v)."""
    q_ids, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                for got in _nearest(q_ids, q, f["id"].to_numpy(), x, k):
                    best.add(*got)
        yield best.frame()

    return _top(base.mapInPandas(run, _FOUND), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probes_needed(hashes: Hashes, own: dict[int, np.ndarray], hits: list[tuple[int, np.ndarray]], recall: float) -> int | None:
    """Buckets to visit in each table so that the sample's true neighbours (query, vector) are found often enough; None if no number of probes does."""
    most = 3 ** min(hashes.k, 6)
    ranks = []
    at = hashes.places(np.array([v for _, v in hits]))
    codes = _codes(np.floor(at))
    orders = {i: [dict(zip(c.tolist(), r.tolist(), strict=True)) for _, r, c in probe_order(hashes.places(v[None])[0], most)] for i, v in own.items()}
    for j, (query, _) in enumerate(hits):
        ranks.append(min(orders[query][t].get(int(codes[j, t]), most) for t in range(codes.shape[1])))
    ranks.sort()
    needed = ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]
    return None if needed >= most else needed + 1


def fitted(dimension: int, most: int, scale: float, tables: int, seed: int, own: dict[int, np.ndarray], hits: list[tuple[int, np.ndarray]], recall: float) -> tuple[Hashes, int] | None:
    """Hashes of the most directions, ``most`` at most, whose probes reach the recall, and the probes; None if there are none."""
    for functions in range(most, 0, -1):
        hashes = Hashes.make(dimension, functions, scale, tables, seed)
        probes = _probes_needed(hashes, own, hits, recall) if hits else 1
        if probes:
            return hashes, probes
    return None


_KEY = ["tab", "code"]


def _blocks(spread: DataFrame, counts: DataFrame) -> DataFrame:
    """tab, code, block, rows: the rows (tab, code, id, v) in blocks of about BLOCK by hash of id and vector."""
    large = counts.where(F.col("m") > BLOCK).select(*_KEY, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = spread.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id", "v"), F.lit(SALTS)))
    block = F.pmod(F.xxhash64("id", "v"), F.ceil(F.coalesce("m", F.lit(1)) / BLOCK)).alias("block")
    dealt = salted.join(large, [*_KEY, "salt"], "left").select(*_KEY, block, "id", "v")
    return stored(dealt.groupBy(*_KEY, "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")), "ann-blocks")


def _groups(wanted: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """tab, code, m, g, asks: the queries (id) that want a bucket of ``m`` rows, with their vectors, in groups."""
    g = F.pmod(F.xxhash64(F.lit("group"), "id"), F.lit(groups)).alias("g")
    full = wanted.join(asked, "id").select(*_KEY, "m", g, "id", "v")
    return stored(full.groupBy(*_KEY, "m", "g").agg(F.collect_list(F.struct("id", "v")).alias("asks")), "ann-groups")


def _met(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """rows, asks of each block and group of one bucket: small keys are paired first, vectors then follow them."""
    salts = F.sequence(F.lit(0).cast("long"), F.least(F.lit(SALTS).cast("long"), F.ceil(F.col("m") / BLOCK)) - 1)
    names = groups.select(*_KEY, "g", F.explode(salts).alias("salt"))
    pairs = blocks.select(*_KEY, "block", F.pmod("block", F.lit(SALTS)).alias("salt")).join(names, [*_KEY, "salt"]).select(*_KEY, "block", "g")
    pairs = stored(pairs, "ann-pairs")
    left = pairs.join(blocks, [*_KEY, "block"])
    right = pairs.join(groups.drop("m"), [*_KEY, "g"])
    return left.join(right, [*_KEY, "block", "g"]).select("rows", "asks")


def _ranked(met: DataFrame, dimension: int, k: int) -> DataFrame:
    """The ``k`` nearest of each query among the rows it met, exactly."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for rows, asks in zip(batch.column(0), batch.column(1), strict=True):
                rows, asks = rows.values, asks.values
                x, q = _matrix(rows.field("v"), dimension), _matrix(asks.field("v"), dimension)
                for got in _nearest(asks.field("id").to_numpy(), q, rows.field("id").to_numpy(), x, k):
                    best.add(*got)
                if len(best.found) > 50_000:
                    yield pa.RecordBatch.from_pandas(best.frame(), preserve_index=False)
        yield pa.RecordBatch.from_pandas(best.frame(), preserve_index=False)

    return _top(met.mapInArrow(rank, _FOUND), k)


def _exact(base: DataFrame, asked: DataFrame, k: int, dimension: int) -> DataFrame | None:
    """The exact nearest of all ``asked``; None if there are none.

    Up to EXACT queries go to all rows in one pass. More are one bucket of all rows: blocks of rows
    and groups of queries in pairs.
    """
    n = asked.count()
    if n == 0:
        return None
    if n <= EXACT:
        return stored(brute_force(base, [(r["id"], r["v"]) for r in asked.collect()], k), "ann-exact")
    one = [F.lit(0).alias("tab"), F.lit(0).cast("long").alias("code")]
    counts = base.agg(F.count(F.lit(1)).alias("m")).select(*one, "m")
    wanted = asked.select(*one, F.lit(base.count()).cast("long").alias("m"), "id")
    met = _met(_blocks(base.select(*one, "id", "v"), counts), _groups(wanted, asked, math.ceil(n / GROUP)))
    return stored(_ranked(met, dimension, k), "ann-exact")


def _check_recall(got: DataFrame, truth: DataFrame) -> None:
    """Raises an error if less than LEAST of the sample's true neighbours, or others as near, were found."""
    last = truth.groupBy("query_id").agg(F.max("score").alias("last"), F.count(F.lit(1)).alias("n"))
    near = got.join(F.broadcast(last), "query_id").where(F.col("score") <= F.col("last") * (1 + 1e-9)).groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    sums = last.join(near, "query_id", "left").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("m"), F.sum("n").alias("n")).collect()[0]
    if sums["n"] and sums["m"] < LEAST * sums["n"]:
        raise RuntimeError(f"{sums['m']} of {sums['n']} true neighbours of the measured queries were found, less than {LEAST}")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, tables: int = TABLES, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row among all other rows.

    Both tables have (vec_id, embedding). Vectors that are null, zero, of another length than most, or
    hold null or non-finite parts, and null ids, take no part. Ties go to the smaller vec_id. A vec_id
    that occurs more than once counts once, by its nearest row; a query never finds its own vec_id, and
    of several vectors of a query's id the least asks (by its components in turn). Fewer candidates
    than ``k`` give all of them. A query that the probes leave with fewer than ``k`` is searched again
    among all rows, and all queries are where no number of probes reaches ``recall``. Empty tables give
    an empty result. Further columns are not read.
    """
    spark = vectors.sparkSession
    base, asked = usable(vectors), usable(queries)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dimension = sizes[0]["d"]
    base = stored(base.where(F.size("v") == dimension).dropDuplicates(["id", "v"]), "ann-base")
    asked = stored(asked.where(F.size("v") == dimension).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    n, asking = base.count(), asked.count()
    own_ids = base.agg(F.count_distinct("id")).collect()[0][0]
    if not asking:
        return empty
    scale = base.agg(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).collect()[0][0]
    scale = math.sqrt(scale)  # of a projection: the root of the mean squared norm
    functions = max(1, round(math.log(max(n / BUCKET, 1)) / math.log(3)) + 1)
    order = F.xxhash64(F.lit(seed), "id")
    sample = [(r["id"], r["v"]) for r in asked.orderBy(order, "id").limit(MEASURED).collect()]
    truth = stored(brute_force(base, sample, k), "ann-truth")
    asks = spark.createDataFrame(sample, "query_id long, q array<double>")
    away = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = truth.join(base.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(F.broadcast(asks), "query_id")
    hits = near.groupBy("query_id", "vec_id").agg(F.min_by("v", away).alias("v")).select("query_id", "v").collect()  # MEASURED * k rows
    fit = fitted(dimension, functions, scale, tables, seed, {i: np.array(v) for i, v in sample}, [(r["query_id"], np.array(r["v"])) for r in hits], recall)
    if fit is None:
        return _exact(base, asked, k, dimension).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    hashes, probes = fit
    shared = spark.sparkContext.broadcast(hashes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(np.floor(shared.value.places(_matrix(batch.column(1), dimension))))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["id", "v", "codes"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                places = shared.value.places(_matrix(part.column(1), dimension))
                who, table, code = [], [], []
                for i in range(len(places)):
                    for t, _, c in probe_order(places[i], probes):
                        who.append(np.full(len(c), i))
                        table.append(np.full(len(c), t))
                        code.append(c)
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(np.concatenate(table).astype(np.int32)), pa.array(np.concatenate(code))], ["id", "tab", "code"])

    indexed = base.mapInArrow(placed, "id long, v array<double>, codes array<long>")
    spread = indexed.select("id", "v", F.posexplode("codes").alias(*_KEY))
    counts = stored(spread.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("m")), "ann-buckets")
    wanted = asked.mapInArrow(probed, "id long, tab int, code long").join(counts, _KEY)  # ids alone: no vector meets a bucket before it is blocks
    met = _met(_blocks(spread, counts), _groups(wanted, asked, max(1, math.ceil(asking / GROUP))))
    got = stored(_ranked(met, dimension, k), "ann-found")
    few = asked.join(got.where(F.col("rank") == min(k, max(1, own_ids - 1))).select(F.col("query_id").alias("id")), "id", "left_anti")
    few = stored(few, "ann-few")
    again = _exact(base, few, k, dimension)  # none or few as a rule
    if again is not None:
        got = got.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    _check_recall(got, truth)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
