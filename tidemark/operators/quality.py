"""Validation, merging and auditing of bar tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import in_weekend
from tidemark.operators.chunks import chunked

PRICES = ("open", "high", "low", "close", "tick_volume")


def validate(bars: DataFrame, arrival: str) -> DataFrame:
    """Prices as doubles, of equal (symbol, ts) the first that arrived; missing columns raise."""
    missing = {"symbol", "ts", *PRICES} - set(bars.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return bars.groupBy("symbol", "ts").agg(*[F.min_by(F.col(c).cast("double"), arrival).alias(c) for c in PRICES])


def merge(*inputs: DataFrame) -> DataFrame:
    """Union of sources; on equal (symbol, ts) the last input wins."""
    ranked = [df.select("symbol", "ts", *PRICES, F.lit(i).alias("__source")) for i, df in enumerate(inputs)]
    return reduce(DataFrame.unionByName, ranked).groupBy("symbol", "ts").agg(*[F.max_by(c, "__source").alias(c) for c in PRICES])


def gaps(bars: DataFrame, minutes: int) -> DataFrame:
    """symbol, first, last, n of missing bars strictly between neighbours, without those of the weekend."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    before = chunked(bars.select("symbol", "ts"), lambda t: t.withColumn("previous", F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))), before=1)
    holes = before.where(F.col("ts") > F.col("previous") + step)
    missing = holes.select("symbol", "previous", F.explode(F.sequence(F.col("previous") + step, F.col("ts") - step, step)).alias("at")).where(~in_weekend(F.col("at")))
    return missing.groupBy("symbol", "previous").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("previous")


def missing_times(bars: DataFrame, minutes: int) -> DataFrame:
    """Expected minus present bar times of each symbol's span, weekends left out."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    expected = span.select("symbol", F.explode(F.sequence("a", "b", step)).alias("ts")).where(~in_weekend(F.col("ts")))
    return expected.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def history_cap(bars: DataFrame, asked, minutes: int) -> DataFrame:
    """Per symbol: rows, first bar, and whether the history is shorter than asked for."""
    late = F.make_dt_interval(F.lit(2), F.lit(0), F.lit(10 * minutes))
    out = bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    span = (F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(asked.cast("timestamp"))) / 60.0 / minutes
    return out.withColumns({"late_start": F.col("first") > asked + late, "thin": F.col("n_rows") < 0.5 * span * 5 / 7})


def sanity(bars: DataFrame) -> DataFrame:
    """Per symbol: bars, and how many break an OHLC or volume rule."""
    top, low = F.greatest("open", "close"), F.least("open", "close")
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("high") < top).alias("bad_high"), F.count_if(F.col("low") > low).alias("bad_low"), F.count_if(F.col("tick_volume") <= 0).alias("bad_volume"), F.avg((F.col("tick_volume") == 0).cast("double")).alias("zero_volume_share")
    )


def coverage_by_hour(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def closed_only(bars: DataFrame, as_of, minutes: int) -> DataFrame:
    """Bars that have ended by a time."""
    return bars.where(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)) <= as_of)


def common_window(bars: DataFrame) -> DataFrame:
    """Span in which every timeframe of a symbol has data: (symbol, start, end)."""
    spans = bars.groupBy("symbol", "tf").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.groupBy("symbol").agg(F.max("a").alias("start"), F.min("b").alias("end"))


def new_days(incoming: DataFrame, present: DataFrame, hours: int = 24) -> DataFrame:
    """(symbol, day) of complete incoming days that are not present yet."""
    days = incoming.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count_distinct(F.hour("ts")).alias("hours")).where(F.col("hours") >= hours)
    have = present.select("symbol", F.to_date("ts").alias("day")).distinct()
    return days.join(have, ["symbol", "day"], "left_anti")
