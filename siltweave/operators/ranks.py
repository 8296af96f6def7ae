"""Running numbers over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltweave.session import cut


def numbered(df: DataFrame, keys: list[str], order: str, bucket: Column | None = None, name: str = "rn") -> DataFrame:
    """``df`` with each row's number, from 1, in the order of ``order`` within ``keys``.

    ``bucket`` must never fall as ``order`` rises (a range number); without one the rows are range partitioned by
    keys and order, whatever their distribution, and a partition is a bucket. Rows are numbered within
    a bucket and shifted by the counts of the buckets before it, so that a task holds a bucket and
    not a group; the counts are one row a bucket. Ties in ``order`` are numbered in any order.
    """
    if bucket is None:
        df = cut(df.repartitionByRange(*keys, order))
        bucket = F.spark_partition_id()
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n")
    before = before.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col("_bucket").alias("_at"), "_before")
    within = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)))
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return within.join(before, same).withColumn(name, F.col("_r") + F.col("_before")).drop("_bucket", "_r", "_before", "_at", *(f"_k{i}" for i in range(len(keys))))
