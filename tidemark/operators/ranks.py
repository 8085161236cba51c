"""Exact ranks of large groups by range, and buckets of equal size from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.stages import saved


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with __rank (from 1, in `order` within each key) and __total (rows of the key).

    Rows are dealt by range of (key, order), so a key that holds most rows is many tasks. A row's rank is the number of rows in
    the ranges before its own, which is one row a range and key, and its place in its range.
    """
    dealt = saved(rows.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(by, "__range").agg(F.count("*").alias("__n"))
    ranges = Window.partitionBy(by).orderBy("__range")
    before = counts.select(F.col(by).alias("__by"), F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(by)).alias("__total"))
    placed = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(by, "__range").orderBy(*order)))
    joined = placed.join(before, placed[by].eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")))
    return joined.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__range", "__by", "__of", "__before")


def ntile(rows: DataFrame, by: str, order: list[str], n: int, name: str = "bucket") -> DataFrame:
    """rows with the bucket (1 to n) of each row; the first total mod n buckets hold one row more."""
    base, more = F.floor(F.col("__total") / n), F.col("__total") % n
    wide = more * (base + 1)
    bucket = F.when(F.col("__rank") <= wide, F.ceil(F.col("__rank") / (base + 1))).otherwise(more + F.ceil(F.try_divide(F.col("__rank") - wide, base)))
    return ranked(rows, by, order).withColumn(name, bucket.cast("int")).drop("__rank", "__total")
