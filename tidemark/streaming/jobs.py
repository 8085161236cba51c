"""Structured Streaming jobs: the continuous form of the batch operators.

Each function takes a streaming (or, for tests, a batch) DataFrame and returns one; callers choose source, sink, trigger
and checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Closed tumbling bars; ticks later than the watermark are dropped."""
    at = F.struct("ts", "event_id")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
    return grouped.agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").cast("double").alias("tick_volume")
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "tick_volume")


def sliding_stats(ticks: DataFrame, minutes: int, slide: int, late: str = "10 minutes") -> DataFrame:
    """Mean, spread and count over sliding windows."""
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w"))
    return grouped.agg(F.avg("mid").alias("mean"), F.stddev_samp("mid").alias("spread"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), "mean", "spread", "n")


def activity_sessions(events: DataFrame, gap_minutes: int, late: str = "10 minutes") -> DataFrame:
    """Bursts of activity separated by a silence: key, start, end, n."""
    grouped = events.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", f"{gap_minutes} minutes").alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fresh_signals(signals: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (symbol, time, direction, type) once."""
    return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts", "direction", "type"])


def with_blackout(rows: DataFrame, calendar: DataFrame, before: int = 15, after: int = 10) -> DataFrame:
    """Stream-static join with the hours of the calendar's windows. An empty calendar blocks everything."""
    minute = lambda n: F.expr(f"INTERVAL {n} MINUTE")
    hour = lambda t: F.floor(F.unix_timestamp(t) / 3600)
    timed = calendar.where("time_utc IS NOT NULL").select((F.col("time_utc") - minute(before)).alias("start"), (F.col("time_utc") + minute(after)).alias("end"))
    dealt = timed.select("start", "end", F.explode(F.sequence(hour(F.col("start")), hour(F.col("end")))).alias("hour"))
    by_hour = dealt.groupBy("hour").agg(F.collect_list(F.struct("start", "end")).alias("windows"))  # the windows of one hour
    # One row, counted in every batch: a calendar that empties later closes the gate, too.
    count = timed.agg(F.count("*").alias("known")).withColumn("one", F.lit(1))
    joined = rows.withColumn("hour", hour(F.col("ts"))).join(by_hour, "hour", "left").drop("hour").withColumn("one", F.lit(1)).join(F.broadcast(count), "one")
    inside = F.exists("windows", lambda w: (F.col("ts") >= w["start"]) & (F.col("ts") <= w["end"]))
    return joined.withColumn("blackout", F.when(F.col("known") == 0, True).otherwise(F.coalesce(inside, F.lit(False)))).drop("windows", "known", "one")


def paired(opens: DataFrame, closes: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """Left outer interval join of position openings and the closes that arrive later."""
    left = opens.withWatermark("open_time", late).alias("o")
    right = closes.withWatermark("close_time", late).alias("c")
    match = F.expr(f"o.ticket = c.ticket AND c.close_time >= o.open_time AND c.close_time <= o.open_time + INTERVAL {days} DAYS")
    return left.join(right, match, "leftOuter").select("o.ticket", "o.open_time", "c.close_time", "c.profit")


#: What running_indicators keeps of a symbol.
INDICATOR_STATE = "symbol string, day int, pv double, vol double, last double, n long, gain double, loss double"


def running_indicators(bars: DataFrame, states: DataFrame | None, rsi_length: int = 14, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Session VWAP (UTC day) and Wilder RSI per symbol with constant-size state, for foreachBatch: one batch of bars and the states
    before it (none: a first batch) -> kind, symbol, ts, vwap, rsi and the fields of INDICATOR_STATE.

    Rows of kind `row` have the bars' figures, those of kind `state` what is kept of every symbol so far. Bars of a symbol arrive in
    order of time; those of one batch are sorted by `order` on Spark, which spills, and pass a task as a stream: it holds the state
    and a few thousand bars, however many a symbol has.
    """
    n = rsi_length
    fields = ["day", "pv", "vol", "last", "n", "gain", "loss"]
    kept = "day int, pv double, vol double, last double, n long, gain double, loss double"

    def update(bars: pd.DataFrame, state: list) -> pd.DataFrame:
        day, pv, vol, last, count, gain, loss = state
        vwaps, rsis = [], []
        for today, close, middle, volume in zip(bars["day"].tolist(), bars["close"].tolist(), ((bars["high"] + bars["low"] + bars["close"]) / 3).tolist(), bars["volume"].tolist(), strict=True):
            if today != day:
                day, pv, vol = today, 0.0, 0.0
            pv, vol = pv + middle * volume, vol + volume
            if last == last:
                up, down = max(close - last, 0.0), max(last - close, 0.0)
                count += 1
                if count <= n:  # sums until the seed, then means
                    gain, loss = gain + up, loss + down
                    if count == n:
                        gain, loss = gain / n, loss / n
                else:
                    gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
            last = close
            vwaps.append(pv / vol if vol else None)
            rsis.append(None if count < n else 50.0 if gain == loss == 0 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
        state[:] = day, pv, vol, last, count, gain, loss
        return pd.DataFrame({"kind": "row", "symbol": bars["symbol"], "ts": bars["ts"], "vwap": pd.Series(vwaps, bars.index, float), "rsi": pd.Series(rsis, bars.index, float)}).reindex(columns=columns)

    columns = ["kind", "symbol", "ts", "vwap", "rsi", *fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            for symbol, part in frame.groupby("symbol", sort=False, dropna=False):
                symbol = None if pd.isna(symbol) else symbol
                if state is None or symbol != now:
                    if state is not None:
                        yield pd.DataFrame([("state", now, None, None, None, *state)], columns=columns)
                    now, state = symbol, [None, 0.0, 0.0, float("nan"), 0, 0.0, 0.0]
                if part["held"].iloc[0]:
                    state = [int(part["day"].iloc[0]), *part[fields[1:4]].iloc[0].tolist(), int(part["n"].iloc[0]), *part[fields[5:]].iloc[0].tolist()]
                    part = part.iloc[1:]
                if len(part):
                    yield update(part, state)
        if state is not None:
            yield pd.DataFrame([("state", now, None, None, None, *state)], columns=columns)

    by = [c for c in order if c != "ts"]
    new = bars.select("symbol", F.lit(False).alias("held"), "ts", *by, "high", "low", "close", F.col("tick_volume").alias("volume"), F.unix_date(F.to_date("ts")).alias("day"))
    new = new.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in kept.split(", ")) if name != "day"])
    if states is not None:
        new = new.unionByName(states.select("symbol", F.lit(True).alias("held"), *fields), allowMissingColumns=True)
    sorted_ = new.repartition("symbol").sortWithinPartitions("symbol", F.desc("held"), *order)
    return sorted_.mapInPandas(run, f"kind string, symbol string, ts timestamp, vwap double, rsi double, {kept}")


def trailing_stops(prices: DataFrame, distance: float) -> DataFrame:
    """Per ticket the ratcheting stop level: prices (ticket, ts, direction, price) -> ticket, ts, stop, hit."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stop, hit = state.get if state.exists else (float("nan"), False)
        rows = []
        for p in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            if not hit:
                hit = bool(stop == stop and (p.price - stop) * p.direction <= 0)
                moved = p.price - p.direction * distance
                if not hit and (stop != stop or (moved - stop) * p.direction > 0):
                    stop = moved
            rows.append((key[0], p.ts, stop, hit))
        state.update((stop, hit))
        yield pd.DataFrame(rows, columns=["ticket", "ts", "stop", "hit"])

    return prices.groupBy("ticket").applyInPandasWithState(update, "ticket long, ts timestamp, stop double, hit boolean", "stop double, hit boolean", "append", GroupStateTimeout.NoTimeout)


def _millis(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


def stale(events: DataFrame, silence_minutes: int, late: str = "10 minutes") -> DataFrame:
    """symbol, last_seen, stale_at for every silence of at least silence_minutes: when the next event tells, or by a timer once the
    watermark has passed the silence's end. The timer ends the state of a symbol, so silent symbols cost nothing.
    """
    silence = pd.Timedelta(minutes=silence_minutes)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last = [], pd.Timestamp(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            rows.append((key[0], last, last + silence))
            state.remove()
        else:
            for ts in pd.concat(list(frames))["ts"].sort_values():
                if last is not None and ts - last >= silence:
                    rows.append((key[0], last, last + silence))
                last = ts if last is None else max(last, ts)
            state.update((last,))
            state.setTimeoutTimestamp(max(_millis(last + silence), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["symbol", "last_seen", "stale_at"])

    timed = events.withWatermark("ts", late).groupBy("symbol")
    return timed.applyInPandasWithState(update, "symbol string, last_seen timestamp, stale_at timestamp", "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def locked_stops(prices: DataFrame, distance: float, reward: float, idle_days: int = 30, late: str = "10 minutes") -> DataFrame:
    """prices (ticket, ts, direction, price) -> ticket, ts, stop, locked, closed for every price up to the one that closes a ticket.

    The stop trails by `distance`; a price `reward` beyond the first one moves it there once (locked). A closed ticket is
    remembered, and an open one kept, until it has had no price for idle_days: a timer ends its state.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            stop, target, locked, closed = state.get if state.exists else (float("nan"), float("nan"), False, False)
            last = None
            for p in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
                last = p.ts
                if closed:
                    continue
                if stop != stop:
                    stop, target = p.price - p.direction * distance, p.price + p.direction * reward
                else:
                    closed = bool((p.price - stop) * p.direction <= 0)
                    if not closed:
                        if not locked and (p.price - target) * p.direction >= 0:
                            locked, stop = True, target
                        moved = p.price - p.direction * distance
                        stop = moved if (moved - stop) * p.direction > 0 else stop
                rows.append((key[0], p.ts, stop, locked, closed))
            state.update((stop, target, locked, closed))
            state.setTimeoutTimestamp(max(_millis(last) + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["ticket", "ts", "stop", "locked", "closed"])

    timed = prices.withWatermark("ts", late).groupBy("ticket")
    return timed.applyInPandasWithState(update, "ticket long, ts timestamp, stop double, locked boolean, closed boolean", "stop double, target double, locked boolean, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def day_loss(deals: DataFrame, limit: float, late: str = "1 day") -> DataFrame:
    """Net result per server day and whether it loses at least the limit."""
    daily = deals.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("profit").alias("net"), F.count("*").alias("n"))
    return daily.select(F.col("w.start").alias("day"), "net", "n", (F.col("net") <= -limit).alias("breached"))
