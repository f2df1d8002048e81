"""What the training-data operators share: tables, folds, shared storage, bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.storage import shared_dir, stored

__all__ = ["WORD_PATTERN", "bounded_sample", "finite_vector", "fold", "held_out", "matrix", "partitions_for", "shared_dir", "stored", "table", "usual_length", "whole_steps"]

#: White space of the word contract: space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids give null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def held_out(doc_id: str, mod: int, held: int) -> Column:
    """Whether a row is of the held-out fold; false for null ids."""
    return F.coalesce(fold(doc_id, mod) == held, F.lit(False)).alias("held_out")


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """``bound`` rows of ``df`` at most, chosen by a hash of ``key``; all rows if there are fewer.

    The choice depends on keys alone, so it is the same for any partitioning and any rerun. Rows of
    one key come or go together: the hashes are cut into ranges, and ranges are taken in turn while
    their rows still fit, so a key that very many rows repeat is passed over. Fitting alone uses it;
    every result is computed over all rows.
    """
    rows = df.count()
    if rows <= bound:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    keep = max(1, int(min(1.0, 1.5 * bound / rows) * (1 << 30)))
    ranges = 512  # rows that the driver gets
    cut = F.floor(share * ranges / keep).cast("int")
    taken, fitting = 0, []
    for r in df.where(share < keep).groupBy(cut.alias("r")).count().orderBy("r").collect():
        if taken + r["count"] <= bound:
            taken += r["count"]
            fitting.append(r["r"])
    return df.where((share < keep) & cut.isin(fitting)) if fitting else df.limit(0)


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` with ``per_task`` rows each, at least the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-rows // per_task), 1)


def finite_vector(vector_col: str) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    v = F.col(vector_col).cast("array<double>")
    return F.coalesce(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def whole_steps(vector_col: str, scale: int = 256) -> Column:
    """array<long>: floor(scale * c) of each component as double."""
    return F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("long"))


def usual_length(df: DataFrame, vector_col: str) -> int | None:
    """The length that most vectors have (of equally frequent ones the smallest); None without vectors that hold something."""
    found = df.groupBy(F.size(vector_col).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").limit(1).collect()
    return found[0]["d"] if found else None


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)
