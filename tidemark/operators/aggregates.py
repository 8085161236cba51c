"""Aggregates over bars, deals, journals and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import in_session, local
from tidemark.functions.trade import profit_factor


def session_range(bars: DataFrame, start: int, end: int, zone: str = "UTC") -> DataFrame:
    """symbol, day (local), range_high, range_low, n of the bars inside a local window."""
    inside = bars.where(in_session(F.col("ts"), start, end, zone))
    return inside.groupBy("symbol", F.to_date(local(F.col("ts"), zone)).alias("day")).agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"), F.count("*").alias("n"))


def previous_day_levels(bars: DataFrame, zone: str) -> DataFrame:
    """bars with the high and low of the previous local day that has data."""
    dated = bars.withColumn("day", F.to_date(local(F.col("ts"), zone)))
    days = dated.groupBy("symbol", "day").agg(F.max("high").alias("h"), F.min("low").alias("l"))
    order = Window.partitionBy("symbol").orderBy("day")
    return dated.join(days.select("symbol", "day", F.lag("h").over(order).alias("previous_high"), F.lag("l").over(order).alias("previous_low")), ["symbol", "day"])


def average_daily_range(days: DataFrame, n: int) -> DataFrame:
    """adr: mean range of the n days before, null until there are n."""
    frame = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1)
    return days.withColumn("adr", F.when(F.count("*").over(frame) == n, F.avg(F.col("high") - F.col("low")).over(frame)))


def hourly_drift(bars: DataFrame) -> DataFrame:
    """Per symbol and UTC hour: bars, mean log return and its t statistic."""
    ret = F.log(F.col("close") / F.col("open"))
    return bars.groupBy("symbol", F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.round(F.avg(ret), 8).alias("mean"), F.round(F.try_divide(F.avg(ret), F.nullif(F.stddev_samp(ret), F.lit(0.0))) * F.sqrt(F.count("*")), 6).alias("t")
    )


def positions(deals: DataFrame) -> DataFrame:
    """Deals of one position added up; closed if any deal is an exit."""
    return deals.groupBy("magic", "position_id").agg(
        F.round(F.sum(F.col("profit") + F.col("commission") + F.col("swap")), 4).alias("net"), (F.max("entry") == 1).alias("closed"), F.max(F.when(F.col("entry") == 1, F.col("time"))).alias("close_time")
    )


def deals_by_magic(found: DataFrame) -> DataFrame:
    done = F.col("closed")
    net = F.when(done, F.col("net"))
    return found.groupBy("magic").agg(
        F.count_if(done).alias("n_closed"), F.count_if(done & (F.col("net") >= 0)).alias("wins"), F.round(F.sum(net), 4).alias("net"), F.round(profit_factor(F.coalesce(net, F.lit(0.0))), 6).alias("profit_factor")
    )


def journal_trades(journal: DataFrame) -> DataFrame:
    """OPEN and CLOSE lines of a ticket as one trade; the last CLOSE wins, a CLOSE without OPEN stays."""
    opened, closed = F.col("event") == "OPEN", F.col("event") == "CLOSE"
    last = F.max(F.when(closed, F.struct("time", "profit")))
    return journal.groupBy("ticket").agg(F.min(F.when(opened, F.col("time"))).alias("open_time"), last.alias("last"), (F.count_if(closed) == 0).alias("still_open")).select(
        "ticket", "open_time", F.col("last.time").alias("close_time"), F.col("last.profit").alias("profit"), "still_open"
    )


def holding_profile(trades: DataFrame, short_seconds: int) -> DataFrame:
    seconds = (F.unix_timestamp(F.col("exit_time").cast("timestamp")) - F.unix_timestamp(F.col("entry_time").cast("timestamp"))).cast("double")
    short = F.col("s") <= short_seconds
    return trades.withColumn("s", seconds).groupBy("symbol").agg(
        F.percentile("s", 0.5).alias("median_s"), F.percentile("s", 0.75).alias("p75_s"), F.round(F.avg(short.cast("double")), 6).alias("short_share"), F.round(F.sum(F.when(short, F.col("pnl")).otherwise(0.0)), 4).alias("short_pnl")
    )


def max_concurrent(trades: DataFrame) -> DataFrame:
    """Peak of simultaneously open trades; steps of one time add up first."""
    steps = trades.select("symbol", F.explode(F.array(F.struct(F.col("entry_time").alias("t"), F.lit(1).alias("step")), F.struct(F.col("exit_time").alias("t"), F.lit(-1).alias("step")))).alias("e"))
    netted = steps.groupBy("symbol", "e.t").agg(F.sum("e.step").alias("step"))
    # Inside a month: its sum and its highest running sum; the months of a symbol are a few rows.
    month = netted.withColumn("__m", F.trunc(F.to_date("t"), "month"))
    running = month.withColumn("open", F.sum("step").over(Window.partitionBy("symbol", "__m").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    months = running.groupBy("symbol", "__m").agg(F.sum("step").alias("step"), F.max("open").alias("high"))
    before = F.coalesce(F.sum("step").over(Window.partitionBy("symbol").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return months.withColumn("peak", before + F.col("high")).groupBy("symbol").agg(F.max("peak").alias("peak"))


def funnel(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """How often each gate blocks, per symbol."""
    blocked = F.array_compact(F.array(*[F.when(condition, name) for name, condition in gates.items()]))
    return rows.select("symbol", F.explode(blocked).alias("gate")).groupBy("symbol", "gate").agg(F.count("*").alias("n"))
