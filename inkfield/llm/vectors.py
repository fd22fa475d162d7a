"""What the operators on embeddings share."""

from __future__ import annotations

import sys
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm.common import pick


def numbered_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding (array<double>, null unless it has only finite components and is not zero)."""
    rows = pick(df, id_col, vector_col).toDF("vec_id", "embedding")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    most = sys.float_info.max
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= most)) & F.exists("embedding", lambda x: x != 0)
    return rows.withColumn("embedding", F.when(fine, F.col("embedding")))


def sample(rows: DataFrame, key: str, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """About `size` of the vectors and their keys, by a hash of the key; of over twice as many those with the least hashes."""
    share, spot = min(1.0, size / max(total, 1)), F.shiftrightunsigned(F.xxhash64(key), 1)
    chosen = rows.where(spot <= int((1 << 63) * share) - 1).select(key, "embedding").orderBy(spot, key, "embedding").limit(2 * size)
    found = chosen.toArrow().combine_chunks()
    keys = found.column(0).to_numpy().astype(np.int64)
    points = matrix(found.column(1).combine_chunks()) if len(keys) else np.empty((0, 0))
    order = np.lexsort((*points.T[::-1], keys))
    return keys[order], points[order]


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for rows that are pages of vectors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
