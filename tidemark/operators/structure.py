"""Price-structure events. An event may be used only from its confirmation on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import local
from tidemark.operators.chunks import chunked, last_known, row_numbers
from tidemark.operators.indicators import confirmed_swings, donchian, lag, order, rows
from tidemark.operators.joins import asof

def fair_value_gaps(bars: DataFrame, min_atr: float) -> DataFrame:
    """symbol, ts, direction, top, bottom, confirmed_at of three-bar gaps of at least min_atr x ATR."""
    near = chunked(bars, lambda t: t.withColumns({"h2": lag("high", 2), "l2": lag("low", 2), "confirmed_at": F.lead("ts").over(order())}), before=2, after=1)
    up = (F.col("low") > F.col("h2")) & (F.col("low") - F.col("h2") >= min_atr * F.col("atr"))
    down = (F.col("high") < F.col("l2")) & (F.col("l2") - F.col("high") >= min_atr * F.col("atr"))
    return near.where(up | down).select(
        "symbol", "ts", F.when(up, 1).otherwise(-1).alias("direction"), F.when(up, F.col("low")).otherwise(F.col("l2")).alias("top"), F.when(up, F.col("h2")).otherwise(F.col("high")).alias("bottom"), "confirmed_at"
    )


def known_swings(bars: DataFrame, left: int, right: int) -> DataFrame:
    """bars with __h and __l: the latest swing high and low (ts, level) confirmed by each bar."""
    return last_known(confirmed_swings(bars, left, right), {"__h": "__sh", "__l": "__sl"}).drop("__sh", "__sl")


def _levels_before(bars: DataFrame, left: int, right: int) -> DataFrame:
    """bars with the swings confirmed before each bar."""
    return last_known(confirmed_swings(bars, left, right), {"__h": "__sh", "__l": "__sl"}, strict=True).drop("__sh", "__sl")


def breaks(bars: DataFrame, left: int, right: int) -> DataFrame:
    """First close beyond each swing that was confirmed before the bar: BOS with the last event's direction, else CHoCH."""
    known = _levels_before(bars, left, right)
    sides = F.array(
        F.struct(F.lit(1).alias("direction"), F.col("__h.level").alias("level"), F.col("__h.ts").alias("swing_ts"), (F.col("close") > F.col("__h.level")).alias("hit")),
        F.struct(F.lit(-1).alias("direction"), F.col("__l.level").alias("level"), F.col("__l.ts").alias("swing_ts"), (F.col("close") < F.col("__l.level")).alias("hit")),
    )
    hits = known.select("symbol", "ts", F.explode(F.filter(sides, lambda s: s["hit"])).alias("s")).select("symbol", "ts", "s.direction", "s.level", "s.swing_ts")
    # A swing is consumed by its first break; the minimum combines before the shuffle however long the swing stays unbroken.
    first = hits.groupBy("symbol", "direction", "swing_ts").agg(F.min("ts").alias("ts"), F.first("level").alias("level")).select("symbol", "ts", "direction", "level", "swing_ts")
    # Two events of one bar: the upward one comes first.
    per_bar = first.groupBy("symbol", "ts").agg(F.min("direction").alias("__last"), F.count("*").alias("__n"))
    carried = last_known(per_bar, {"__before": "__last"}, strict=True)
    before = F.when((F.col("__n") == 2) & (F.col("direction") == -1), 1).otherwise(F.col("__before"))
    return first.join(carried, ["symbol", "ts"]).withColumn("kind", F.when(F.coalesce(before, F.col("direction")) == F.col("direction"), "BOS").otherwise("CHoCH")).drop("__before", "__last", "__n")


def sweeps(bars: DataFrame, left: int, right: int, excess: float) -> DataFrame:
    """Wicks beyond a known swing by at least the excess that close back inside: symbol, ts, level, side."""
    known = _levels_before(bars, left, right)
    high, low = F.col("__h.level"), F.col("__l.level")
    sides = F.array(
        F.struct(high.alias("level"), F.lit("above").alias("side"), ((F.col("high") >= high + excess) & (F.col("close") < high)).alias("hit")),
        F.struct(low.alias("level"), F.lit("below").alias("side"), ((F.col("low") <= low - excess) & (F.col("close") > low)).alias("hit")),
    )
    return known.select("symbol", "ts", F.explode(F.filter(sides, lambda s: s["hit"])).alias("s")).select("symbol", "ts", "s.level", "s.side")


def order_blocks(bars: DataFrame, left: int, right: int, lookback: int) -> DataFrame:
    """Last opposing candle of the `lookback` bars before a break, not before the broken swing."""


    def mark(table: DataFrame) -> DataFrame:
        frame, candle = rows(lookback, -1), F.struct("ts", "high", "low")
        last = lambda side: F.last(F.when(side, candle), ignorenulls=True).over(frame)
        return table.withColumns({"down": last(F.col("close") < F.col("open")), "up": last(F.col("close") > F.col("open"))})

    marked = chunked(bars.select("symbol", "ts", "open", "high", "low", "close"), mark, before=lookback).select("symbol", "ts", "down", "up")
    found = breaks(bars, left, right).join(marked, ["symbol", "ts"])
    block = F.when(F.col("direction") == 1, F.col("down")).otherwise(F.col("up"))
    return found.withColumn("block", block).where(F.col("block.ts") >= F.col("swing_ts")).select("symbol", "ts", "direction", F.col("block.ts").alias("block_ts"), F.col("block.high").alias("top"), F.col("block.low").alias("bottom"))


def htf_bias(bars: DataFrame, minutes: int, higher: DataFrame, higher_minutes: int, left: int, right: int) -> DataFrame:
    """Direction of the latest break on the higher timeframe that has closed by each bar's close; 0 before any."""
    step = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    events = breaks(higher, left, right).groupBy("symbol", (F.col("ts") + step(higher_minutes)).alias("closed")).agg(F.min_by("direction", "direction").alias("direction"))
    left_side = bars.select("symbol", "ts", (F.col("ts") + step(minutes)).alias("closed"))
    return asof(left_side, events, "symbol", "closed", "closed", ["direction"]).select("symbol", "ts", F.coalesce("direction", F.lit(0)).alias("bias"))


def sweep_age(bars: DataFrame, lookback: int, cluster: int) -> DataFrame:
    """Bars since the last new `lookback`-bar high, and how many of the last `cluster` bars made one."""


    def flag(table: DataFrame) -> DataFrame:
        top, _ = donchian(lookback)
        return table.withColumn("__new", F.when(F.col("high") > top, F.col("__n")))

    def count(table: DataFrame) -> DataFrame:
        return table.withColumn("cluster", F.count("__new").over(rows(cluster - 1)))

    numbered = row_numbers(bars, "__n")
    flagged = chunked(chunked(numbered, flag, before=lookback + 1, number="__n"), count, before=cluster, number="__n")
    return last_known(flagged, {"__last": "__new"}).select("symbol", "ts", (F.col("__n") - F.col("__last")).cast("int").alias("age"), "cluster")


def impulses(bars: DataFrame, lookback: int, min_atr: float, retrace: float = 0.5) -> DataFrame:
    """Bars whose close breaks the range of the `lookback` bars before, with a leg of at least min_atr x ATR."""
    top, bottom = donchian(lookback)
    ranged = chunked(bars, lambda t: t.withColumns({"__top": top, "__bottom": bottom}), before=lookback)
    close = F.col("close")
    up = (close > F.col("__top")) & (close - F.col("__bottom") >= min_atr * F.col("atr"))
    down = (close < F.col("__bottom")) & (F.col("__top") - close >= min_atr * F.col("atr"))
    origin = F.when(up, F.col("__bottom")).otherwise(F.col("__top"))
    hits = ranged.where(up | down).withColumns({"direction": F.when(up, 1).otherwise(-1), "origin": origin, "extreme": close})
    return hits.withColumn("zone_near", F.col("extreme") - retrace * (F.col("extreme") - F.col("origin"))).drop("__top", "__bottom")


def crosses(bars: DataFrame, fast: str, slow: str) -> DataFrame:
    """cross_now: 1 or -1 on the bar of a fresh cross, else 0; bars_since the last one."""
    gap = row_numbers(bars.withColumn("__d", F.col(fast) - F.col(slow)).where("__d IS NOT NULL"), "__n")

    def flag(table: DataFrame) -> DataFrame:
        before = lag("__d")
        return table.withColumn("cross_now", F.when((F.col("__d") > 0) & (before <= 0), 1).when((F.col("__d") < 0) & (before >= 0), -1).otherwise(0))

    flagged = chunked(gap, flag, before=1, number="__n").withColumn("__at", F.when(F.col("cross_now") != 0, F.col("__n")))
    return last_known(flagged, {"__last": "__at"}).withColumn("bars_since", (F.col("__n") - F.col("__last")).cast("int")).drop("__d", "__n", "__at", "__last")


def first_of_day(signals: DataFrame, zone: str) -> DataFrame:
    """First signal of each symbol, side and local day."""
    day = Window.partitionBy("symbol", "direction", F.to_date(local(F.col("ts"), zone))).orderBy("ts")
    return signals.withColumn("__n", F.row_number().over(day)).where("__n = 1").drop("__n")
