"""Whitening of embeddings by the covariance of their distinct vectors.

Vectors are taken in whole steps (``floor(256 * c)``), so equal ones can be grouped: however often a
vector repeats, it is fitted and whitened once. A vector's weight in the fit is one, or the number of
its rows. Sums are exact integers, added up in each task and then over tasks; the covariance is a
product of matrices of centred vectors in each task, summed over tasks (dimension squared numbers a
task, whatever the rows). The driver sees those sums and finds the eigenvectors.

Rows get their vector's result back by a join on the vector's digest. Vectors with more than a
thousandth of all rows are fewer than a thousand, so their digests are broadcast; their rows are dealt
over ``SALTS`` keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import finite_vector, matrix, stored, usual_length, whole_steps

COMPONENTS = 4
WEIGHTS = ("one", "count")
#: A vector is hot with more rows than this and more than one of HOT_SHARE of all rows.
HOT_ROWS = 1000
HOT_SHARE = 1000
SALTS = 64
#: Eigenvalues below this share of the largest are zero.
NOTHING = 1e-12


@dataclass
class Whitening:
    """Weight and sums of the fit list; eigenvalues and unit eigenvectors (columns), largest first; the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, sums: np.ndarray, covariance: np.ndarray, components: int) -> "Whitening":
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        return cls(n, sums, np.where(values > NOTHING * max(values.max(initial=0), 1e-300), values, 0.0), vectors * sign, float(np.trace(covariance)))

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of the rows of ``x``; NaN where a component has no spread."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x - self.sums / self.n) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n*x - S)^2 of each row, exactly; None where a long can't hold it."""
        rough = ((self.n * x.astype(float) - self.sums) ** 2).sum(1)
        with np.errstate(over="ignore"):
            exact = ((self.n * x - self.sums) ** 2).sum(1)
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(rough > 2.0**62):
            whole = sum((self.n * int(a) - int(s)) ** 2 for a, s in zip(x[i], self.sums, strict=True))
            out[i] = whole if whole < 2**63 else None
        return out


def in_steps(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, key, x of the rows that take part: x in whole steps, key its digest."""
    kept = vectors.where(finite_vector(vector_col)).select(F.col(id_col).alias("vec_id"), whole_steps(vector_col).alias("x"))
    return kept.select("vec_id", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)).alias("key"), "x")


def _sums(distinct: DataFrame, dimension: int) -> tuple[int, np.ndarray]:
    """Weight and weighted sums of the distinct vectors (key, x, w), exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            x, w = matrix(batch.column(0), dimension, np.int64), batch.column(1).to_numpy()
            n += int(w.sum())
            if (np.abs(x.astype(float)) * w[:, None]).sum(0).max(initial=0) < 2.0**62:
                total = [t + int(s) for t, s in zip(total, (x * w[:, None]).sum(0), strict=True)]
            else:
                total = [t + sum(int(a) * int(b) for a, b in zip(x[:, j], w, strict=True)) for j, t in enumerate(total)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], ["n", "s"])

    parts = distinct.select("x", "w").mapInArrow(add, "n long, s array<string>").select("n", F.posexplode("s").alias("i", "s"))
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return found[0]["n"], np.array([int(r["s"]) for r in found])


def _covariance(distinct: DataFrame, dimension: int, n: int, sums: np.ndarray) -> np.ndarray:
    """The weighted covariance, centred before multiplying: one product of matrices a task, summed over tasks."""
    mean = sums / n

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((dimension, dimension)), False
        for batch in batches:
            centred = matrix(batch.column(0), dimension, np.float64) - mean
            total += centred.T @ (centred * batch.column(1).to_numpy()[:, None])
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array(list(total))], ["i", "part"])

    def added(group: pa.Table) -> pa.Table:
        total = matrix(group.column("part").combine_chunks(), dimension, np.float64).sum(0)
        return pa.table({"i": group.column("i").slice(0, 1), "part": pa.array([total])})

    parts = distinct.select("x", "w").mapInArrow(multiply, "i int, part array<double>")
    rows = parts.groupBy("i").applyInArrow(added, "i int, part array<double>").orderBy("i").collect()
    return np.array([r["part"] for r in rows]) / n


def _identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest entry of |covariance of the whitened fit list - identity|, over the components with spread."""
    spread = [i for i, v in enumerate(model.values) if v > 0]
    if not spread:
        return None
    w = F.col("w")
    means = whitened.agg(*(F.sum(w * F.col("y")[i]).alias(f"m{i}") for i in spread)).collect()[0]
    off = {i: F.col("y")[i] - F.lit(means[f"m{i}"] / model.n) for i in spread}
    pairs = [(i, j) for i in spread for j in spread if i <= j]
    got = whitened.agg(*(F.sum(w * off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs)).collect()[0]
    return max(abs(got[f"c{i}_{j}"] / model.n - (i == j)) for i, j in pairs)


SCHEMA = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error of each row of ``vectors`` that takes part.

    ``whitened`` and ``explained`` are arrays with one entry a component, ``components`` at most (fewer
    if vectors are shorter); n is the fit's weight, deviation the exact sum of (n*x-S)^2 over
    dimensions (null where a long can't hold it). ``weights``: "one" fits each distinct vector once,
    "count" as often as it has rows.

    Vectors that are null or empty, hold null or non-finite components, or are of another length than
    most, take no part. Repeated rows give a row each; null ids stay null. A component without spread
    (one distinct vector, a constant dimension) has a null in ``whitened`` and explains 0;
    identity_error covers the others, and is null if there are none. An empty table gives an empty
    result. Further columns of ``vectors`` are not read.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights is one of {WEIGHTS}")
    spark = vectors.sparkSession
    rows = stored(in_steps(vectors, id_col, vector_col), "whiten-rows")
    dimension = usual_length(rows, "x")
    ids = rows.schema["vec_id"].dataType.simpleString()
    if dimension is None:
        return spark.createDataFrame([], f"vec_id {ids}, {SCHEMA}")
    rows = rows.where(F.size("x") == dimension)
    distinct = rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("m"))
    distinct = stored(distinct.withColumn("w", F.col("m") if weights == "count" else F.lit(1).cast("long")), "whiten-distinct")
    n, sums = _sums(distinct, dimension)
    model = Whitening.of(n, sums, _covariance(distinct, dimension, n, sums), components)
    shared = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimension, np.int64)
            y = [[None if np.isnan(a) else a for a in row] for row in shared.value.whitened(x).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(shared.value.deviation(x), pa.int64()), pa.array(y, pa.list_(pa.float64()))], ["key", "m", "w", "deviation", "y"])

    whitened = distinct.select("key", "x", "m", "w").mapInArrow(project, "key binary, m long, w long, deviation long, y array<double>")
    whitened = stored(whitened, "whiten-vectors")
    error = _identity_error(whitened, model)
    hot = F.col("m") > max(HOT_ROWS, rows.count() / HOT_SHARE)
    marked = rows.select("vec_id", "key").join(F.broadcast(whitened.where(hot).select("key", F.lit(SALTS).alias("salts"))), "key", "left")
    marked = marked.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1)).cast("long")))
    salted = whitened.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(SALTS - 1)).otherwise(0).cast("long"))))
    joined = marked.join(salted, ["key", "salt"])
    explained = F.array(*(F.lit(v) for v in model.explained))
    return joined.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.col("y").alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
