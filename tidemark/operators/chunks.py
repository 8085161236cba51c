"""Finite windows over long series in independent chunks of rows.

A few series can hold most rows, and a window partitioned by symbol makes each of them one task. For windows of a known
reach, rows are numbered across the whole series by counts per time slice, dealt to chunks of equal row counts, and each
chunk also gets the rows its windows reach outside of it. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.stages import saved

#: Days of a numbering slice and rows of a chunk. Neither changes a result.
SLICE_DAYS, CHUNK_ROWS = 30, 100_000


def row_numbers(bars: DataFrame, name: str = "k", slice_days: int = SLICE_DAYS) -> DataFrame:
    """bars with the row number (from 1) per symbol in order of ts; only counts per slice are ordered per symbol."""
    sliced = bars.withColumn("__slice", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (86_400 * slice_days)))
    counts = sliced.groupBy("symbol", "__slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("symbol").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "__slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("symbol", "__slice").orderBy("ts"))
    return sliced.join(offsets, ["symbol", "__slice"]).withColumn(name, F.col("__offset") + within).drop("__slice", "__offset")


def chunked(bars: DataFrame, function: Callable[[DataFrame], DataFrame], before: int, after: int = 0, chunk_rows: int = CHUNK_ROWS, slice_days: int = SLICE_DAYS, number: str | None = None) -> DataFrame:
    """function(bars) for a function whose windows per symbol reach at most `before` rows back and `after` rows ahead.

    The function sees each chunk as a series of its own (its symbol is the symbol and the chunk) with the rows around it.
    `number` names a column with the row number, if bars have one.
    """
    numbered = bars.withColumn("__k", F.col(number)) if number else row_numbers(bars, "__k", slice_days)
    own = F.floor((F.col("__k") - 1) / chunk_rows)
    first, last = F.floor((F.col("__k") - 1 - after) / chunk_rows), F.floor((F.col("__k") - 1 + before) / chunk_rows)
    dealt = numbered.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    named = dealt.withColumns({"__symbol": F.col("symbol"), "__keep": F.col("__own") == F.col("__chunk"), "symbol": F.concat_ws("|", "symbol", F.col("__chunk").cast("string"))}).drop("__k", "__own", "__chunk")
    done = function(named).where("__keep")
    return done.withColumn("symbol", F.col("__symbol")).drop("__symbol", "__keep")


def running_sums(numbered: DataFrame, names: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """numbered (symbol, k, ...) with each named column replaced by its sum up to the row; nulls count as 0.

    Sums run inside chunks of rows; what a chunk starts with is the sum of the chunks before it, a row a chunk.
    """
    dealt = numbered.withColumn("__chunk", F.floor((F.col("k") - 1) / chunk_rows))
    totals = dealt.groupBy("symbol", "__chunk").agg(*[F.sum(n).alias(f"__{n}") for n in names])
    earlier = Window.partitionBy("symbol").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("symbol", "__chunk", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in names])
    within = Window.partitionBy("symbol", "__chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({n: F.sum(F.coalesce(n, F.lit(0))).over(within) for n in names}).join(starts, ["symbol", "__chunk"])
    return summed.withColumns({n: F.col(n) + F.col(f"__{n}") for n in names}).drop("__chunk", *[f"__{n}" for n in names])


def _slice(time: str, slice_days: int) -> Column:
    return F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / (86_400 * slice_days)).alias("__slice")


def last_known(bars: DataFrame, names: dict[str, str], strict: bool = False, slice_days: int = SLICE_DAYS) -> DataFrame:
    """bars with new columns: the latest non-null value of a column at or before the row (before it if strict), new -> old name.

    Values are carried inside slices of time; what a slice starts with is the last value of the slices before it, found among
    one row a slice, so a long series is no one task's work however far back the value lies.
    """
    sliced = saved(bars.withColumn("__slice", _slice("ts", slice_days)))  # read twice below
    ends = sliced.groupBy("symbol", "__slice").agg(*[F.max_by(old, F.when(F.col(old).isNotNull(), F.col("ts"))).alias(f"__e_{new}") for new, old in names.items()])
    earlier = Window.partitionBy("symbol").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("symbol", "__slice", *[F.last(f"__e_{new}", ignorenulls=True).over(earlier).alias(f"__s_{new}") for new in names])
    inside = Window.partitionBy("symbol", "__slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = sliced.join(starts, ["symbol", "__slice"]).withColumns({new: F.coalesce(F.last(old, ignorenulls=True).over(inside), F.col(f"__s_{new}")) for new, old in names.items()})
    return found.drop("__slice", *[f"__s_{new}" for new in names])
