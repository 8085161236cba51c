"""Outcome labels of signals: entry at the next bar's open, then first touch, time, flat or trailing exit.

Every signal is labelled on its own, so the work is set-based. Bars carry a row number per symbol; a signal meets the rows
of its horizon through buckets of `horizon` rows, at most two per signal, which makes the range join an equality join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import deadline_between, past_deadline
from tidemark.functions.trade import lots, swap_nights
from tidemark.operators.chunks import chunked, row_numbers
from tidemark.operators.indicators import lag, order
from tidemark.operators.joins import asof
from tidemark.operators.stages import saved


def flat_events(bars: DataFrame, minutes: int, hour: int, minute: int = 0, zone: str = "America/New_York", friday_hour: int | None = None) -> DataFrame:
    """symbol, ts, reason, exit, exit_time: bars at which open positions have to be closed.

    `force_flat` at the open of a bar at or past the day's local flat time; `force_flat_gap` at the close of the bar before,
    where a gap of more than one and a half bars swallowed a flat time.
    """

    def before(table: DataFrame) -> DataFrame:
        return table.withColumns({"__pt": lag("ts"), "__pc": lag("close")})

    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    table = chunked(bars.select("symbol", "ts", "open", "close"), before, before=1)
    wide = F.col("ts") > F.col("__pt") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 90))
    gap = F.coalesce(wide & deadline_between(F.col("__pt"), F.col("ts"), hour, minute, zone, friday_hour), F.lit(False))
    past = past_deadline(F.col("ts"), hour, minute, zone, friday_hour)
    event = F.when(gap, F.struct(F.lit("force_flat_gap").alias("reason"), F.col("__pc").alias("exit"), (F.col("__pt") + step).alias("exit_time"))).when(past, F.struct(F.lit("force_flat").alias("reason"), F.col("open").alias("exit"), F.col("ts").alias("exit_time")))
    return table.withColumn("__e", event).where("__e IS NOT NULL").select("symbol", "ts", "__e.*")


def flat_exit(labelled: DataFrame, bars: DataFrame, events: DataFrame, minutes: int, hour: int, minute: int = 0, zone: str = "America/New_York", friday_hour: int | None = None) -> DataFrame:
    """Labelled trades (symbol, ts, k, direction, entry, exit, exit_time, reason) with the first flat event after their entry bar in
    place of a later exit. A trade whose entry bar is already past the flat time is not opened."""
    entries = bars.select("symbol", (F.col("k") - 1).alias("k"), F.col("ts").alias("entry_ts"))
    opened = labelled.join(entries, ["symbol", "k"]).where(~past_deadline(F.col("entry_ts"), hour, minute, zone, friday_hour))
    renamed = events.select("symbol", F.col("ts").alias("flat_ts"), F.col("reason").alias("flat_reason"), F.col("exit").alias("flat_exit"), F.col("exit_time").alias("flat_time"))
    found = asof(opened, renamed, "symbol", "entry_ts", "flat_ts", ["flat_ts", "flat_reason", "flat_exit", "flat_time"], strict=True, ahead=True)
    # The touching bar is known by its end; a flat event comes first on its bar.
    flat = F.coalesce(F.col("flat_ts") < F.col("exit_time"), F.lit(False))
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b)).alias(b)
    return found.select("symbol", "ts", "k", "direction", "entry_ts", "entry", pick("flat_exit", "exit"), pick("flat_time", "exit_time"), pick("flat_reason", "reason"))


def numbered(bars: DataFrame) -> DataFrame:
    """bars with `k`, the row number per symbol."""
    return row_numbers(bars)


def _paths(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """A row per signal and bar of its horizon: signal columns (sid, symbol, ts, k, direction, stop, target) and `i` bars after entry."""
    dealt = signals.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((F.col("k") + 1) / horizon), F.floor((F.col("k") + horizon) / horizon)))))
    rows = bars.select("symbol", F.col("k").alias("bk"), F.col("ts").alias("bar_ts"), "open", "high", "low", "close", F.floor(F.col("k") / horizon).alias("__b"))
    near = dealt.join(rows, ["symbol", "__b"]).where(F.col("bk").between(F.col("k") + 1, F.col("k") + horizon))
    return near.withColumn("i", F.col("bk") - F.col("k") - 1).drop("__b")


def first_touch(signals: DataFrame, bars: DataFrame, horizon: int, minutes: int) -> DataFrame:
    """signals (symbol, ts, k, direction, stop, target) -> with entry, exit, exit_time, reason, bars_held, r_multiple.

    On each bar from the entry bar: an open beyond the stop (`sl_gap`) or the target (`tp_gap`) exits at the open; else the
    stop comes before the target within a bar; after `horizon` bars the close (`time`). Signals without a next bar go.
    """
    d, stop, target = F.col("direction"), F.col("stop"), F.col("target")
    beyond = lambda price, level, side: (price - level) * d * side >= 0
    worst = F.when(d == 1, F.col("low")).otherwise(F.col("high"))
    best = F.when(d == 1, F.col("high")).otherwise(F.col("low"))
    last = F.col("i") == horizon - 1
    event = (
        F.when(beyond(F.col("open"), stop, -1), F.struct(F.lit("sl_gap").alias("reason"), F.col("open").alias("price")))
        .when(beyond(F.col("open"), target, 1), F.struct(F.lit("tp_gap").alias("reason"), F.col("open").alias("price")))
        .when(beyond(worst, stop, -1), F.struct(F.lit("sl").alias("reason"), stop.alias("price")))
        .when(beyond(best, target, 1), F.struct(F.lit("tp").alias("reason"), target.alias("price")))
        .when(last, F.struct(F.lit("time").alias("reason"), F.col("close").alias("price")))
    )
    paths = _paths(signals, bars, horizon).withColumn("__e", event)
    keys = ["symbol", "ts", "k", "direction", "stop", "target"]
    hit = F.when(F.col("__e").isNotNull(), F.struct("i", "bar_ts", "__e"))
    found = paths.groupBy(*keys).agg(F.max(F.when(F.col("i") == 0, F.col("open"))).alias("entry"), F.min(hit).alias("h"))
    out = found.where("h IS NOT NULL AND entry IS NOT NULL")
    risk = F.abs(F.col("entry") - stop)
    return out.select(
        *keys, "entry", F.col("h.__e.price").alias("exit"), (F.col("h.bar_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("exit_time"),
        F.col("h.__e.reason").alias("reason"), (F.col("h.i") + 1).alias("bars_held"), F.try_divide((F.col("h.__e.price") - F.col("entry")) * d, F.nullif(risk, F.lit(0.0))).alias("r_multiple"),
    )


def time_exit(signals: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Entry at the next open, exit at the close n bars later."""
    ahead = chunked(bars, lambda t: t.withColumns({"entry": F.lead("open").over(order()), "exit": F.lead("close", n).over(order())}), before=0, after=n).select("symbol", "ts", "entry", "exit")
    return signals.join(ahead, ["symbol", "ts"]).where("exit IS NOT NULL").withColumn("pnl", (F.col("exit") - F.col("entry")) * F.col("direction"))


def limit_fill(signals: DataFrame, bars: DataFrame, expiry: int) -> DataFrame:
    """signals with a limit price -> state: `filled` on the first bar that touches it, `discarded` if that bar also touches
    the stop, `expired` after `expiry` bars; and fill_ts."""
    d = F.col("direction")
    worst = F.when(d == 1, F.col("low")).otherwise(F.col("high"))
    touch = (worst - F.col("limit")) * d <= 0
    event = F.when(touch, F.struct("i", "bar_ts", ((worst - F.col("stop")) * d <= 0).alias("stopped")))
    paths = _paths(signals, bars, expiry).withColumn("__e", event)
    keys = ["symbol", "ts", "direction", "limit", "stop"]
    found = paths.groupBy(*keys).agg(F.min("__e").alias("e"))
    state = F.when(F.col("e").isNull(), "expired").when(F.col("e.stopped"), "discarded").otherwise("filled")
    return found.select(*keys, state.alias("state"), F.when(~F.coalesce(F.col("e.stopped"), F.lit(True)), F.col("e.bar_ts")).alias("fill_ts"))


def trailing_exit(signals: DataFrame, bars: DataFrame, horizon: int, multiple: float, break_even_r: float | None = None, lock: bool = False) -> DataFrame:
    """Exit by a stop that trails the best price by multiple x ATR (ratchet only, effective from the next bar); once
    break_even_r risks are gained it is at least the entry. With `lock` a touch of the target moves the stop there and drops the
    target, so the trade runs on with its reward secured; the stop comes first within a bar. Columns: symbol, ts, direction,
    entry, exit, bars_held.

    The path of a signal is an array of at most `horizon` bars, folded in the JVM, so signals spread freely over tasks.
    """
    step = F.struct("i", "open", "high", "low", "close")
    keys = ["symbol", "ts", "direction", "stop", "target", "atr"]
    paths = _paths(signals, bars, horizon).groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("path"))
    d, atr = F.col("direction"), F.col("atr")
    entry = F.element_at("path", 1)["open"]
    risk = F.abs(entry - F.col("stop"))
    none = F.lit(None).cast("double")
    start = F.struct(F.col("stop").cast("double").alias("stop"), (F.col("target").cast("double") if lock else none).alias("target"), entry.alias("best"), none.alias("exit"), F.lit(0).alias("held"))

    def follow(now: Column, bar: Column) -> Column:
        worst, most = F.when(d == 1, bar["low"]).otherwise(bar["high"]), F.when(d == 1, bar["high"]).otherwise(bar["low"])
        stop, held = now["stop"], (bar["i"] + 1).cast("int")
        out = F.when((bar["open"] - stop) * d <= 0, bar["open"]).when((worst - stop) * d <= 0, stop)
        touched = F.coalesce((most - now["target"]) * d >= 0, F.lit(False))
        best = F.when(d == 1, F.greatest(now["best"], most)).otherwise(F.least(now["best"], most))
        moved = best - d * multiple * atr
        if break_even_r is not None:
            moved = F.when(((best - entry) * d >= break_even_r * risk) & ((entry - moved) * d > 0), entry).otherwise(moved)
        floor = F.when(touched, now["target"]).otherwise(stop)
        stop_next = F.when((moved - floor) * d > 0, moved).otherwise(floor)
        going = F.struct(stop_next.alias("stop"), F.when(~touched, now["target"]).alias("target"), best.alias("best"), none.alias("exit"), held.alias("held"))
        done = F.struct(stop.alias("stop"), now["target"].alias("target"), now["best"].alias("best"), out.alias("exit"), held.alias("held"))
        return F.when(now["exit"].isNotNull(), now).when(out.isNotNull(), done).otherwise(going)

    folded = paths.withColumn("__e", F.aggregate("path", start, follow))
    return folded.select("symbol", "ts", "direction", entry.alias("entry"), F.coalesce("__e.exit", F.element_at("path", -1)["close"]).alias("exit"), F.col("__e.held").alias("bars_held"))


def sequence_positions(trades: DataFrame, key: list[str], most: int = 1, pause_after: int | None = None, pause_trades: int = 0) -> DataFrame:
    """Labelled trades (entry_time, exit_time, pnl) that are taken when at most `most` may be open at once, in entry order;
    after `pause_after` losses in a row the next `pause_trades` are skipped. A fold over one rule set and symbol."""
    schema = trades.schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_time", "exit_time", "direction"], kind="stable")
        open_until: list = []
        taken, losses, skip = np.zeros(len(pdf), bool), 0, 0
        done: list[tuple] = []  # exits not yet counted
        for n, (start, end, pnl) in enumerate(zip(pdf["entry_time"], pdf["exit_time"], pdf["pnl"], strict=True)):
            for at, gain in sorted(x for x in done if x[0] <= start):
                losses = losses + 1 if gain < 0 else 0
                if pause_after and losses >= pause_after:
                    skip, losses = pause_trades, 0
            done = [x for x in done if x[0] > start]
            open_until = [x for x in open_until if x > start]
            if len(open_until) >= most:
                continue
            if skip:
                skip -= 1
                continue
            taken[n] = True
            open_until.append(end)
            done.append((end, pnl))
        return pdf[taken]

    return trades.groupBy(*key).applyInPandas(fold, schema)


def _taken(pdf: pd.DataFrame, most: int, pause_after: int, streak: int) -> tuple[np.ndarray, int]:
    """Which trades of a segment (in order of entry) are taken after `streak` losses in a row, and the losses after it."""
    taken, running, paused = np.zeros(len(pdf), bool), [], None

    def close(until: object | None) -> None:
        nonlocal streak, paused, running
        for end, pnl, day in sorted(x for x in running if until is None or x[0] <= until):
            streak = streak + 1 if pnl < 0 else 0
            if streak >= pause_after:
                paused = day if paused is None else max(paused, day)
        running = [] if until is None else [x for x in running if x[0] > until]

    for n, (start, end, pnl, day, last) in enumerate(zip(pdf["entry_time"], pdf["exit_time"], pdf["pnl"], pdf["__day"], pdf["__last"], strict=True)):
        close(start)
        if len(running) < most and (paused is None or day > paused):
            taken[n] = True
            running.append((end, pnl, last))
    close(None)
    return taken, min(streak, pause_after)


def take_positions(trades: DataFrame, key: str, most: int, pause_after: int, offset_minutes: int = 0) -> DataFrame:
    """Labelled trades (entry_time, exit_time, direction, pnl) that are taken when at most `most` may be open at once and nothing is
    opened for the rest of a server day on which a run of losses reached pause_after.

    A ledger is cut at server midnights at which no trade is open: what such a segment does depends on the one before only by
    the number of losses in a row, of which beyond pause_after do not matter. So each segment is folded for every such number,
    the segments of a key are chained (a row a segment), and each is folded again with the true one.
    """
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes))
    day = lambda t: F.to_date(F.col(t) + shift)
    dated = trades.withColumns({"__day": day("entry_time"), "__last": day("exit_time")})
    nights = F.when(F.col("__last") > F.col("__day"), F.sequence(F.date_add("__day", 1), F.col("__last")))
    busy = dated.select(key, F.explode(nights).alias("__day")).distinct().withColumn("__busy", F.lit(True))
    days = dated.select(key, "__day").distinct().join(busy, [key, "__day"], "left")
    so_far = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    starts = F.coalesce(F.last(F.when(F.col("__busy").isNull(), F.col("__day")), ignorenulls=True).over(so_far), F.first("__day").over(so_far))
    cut = saved(dated.join(days.select(key, "__day", starts.alias("__segment")), [key, "__day"]))
    order = ["entry_time", "exit_time", "direction", "pnl"]
    kind, columns = dict(trades.dtypes)[key], trades.columns

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame([(pdf[key].iloc[0], pdf["__segment"].iloc[0], [_taken(pdf, most, pause_after, s)[1] for s in range(pause_after + 1)])], columns=[key, "__segment", "after"])

    ends = cut.groupBy(key, "__segment").applyInPandas(summarise, f"`{key}` {kind}, __segment date, after array<int>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, out = pdf.sort_values("__segment"), 0, []
        for after in pdf["after"]:
            out.append(now)
            now = int(after[now])
        return pdf[[key, "__segment"]].assign(__streak=out)

    streaks = ends.groupBy(key).applyInPandas(chain, f"`{key}` {kind}, __segment date, __streak int")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf[_taken(pdf, most, pause_after, int(pdf["__streak"].iloc[0]))[0]][columns]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema.fields)
    return cut.join(streaks, [key, "__segment"]).groupBy(key, "__segment").applyInPandas(finish, schema)


def priced_ledger(labelled: DataFrame, point: float, point_value: float, spread: float, commission: float, risk_money: float, swap_points: tuple[float, float] = (0.0, 0.0), market_factor: float = 1.0, market_extra: float = 0.0, step: float = 0.01, least: float = 0.01, most: float = 100.0, offset_minutes: int = 0) -> DataFrame:
    """labelled trades (entry_time, entry, exit, exit_time, reason, stop, direction) as a ledger in money.

    Fills are worse by half the spread; market orders (entries, and exits but for a touched target, which is a limit) pay
    market_factor times that and market_extra points. Lots lose risk_money at the stop. Swap is paid per server midnight, three
    times on Wednesday's; half the commission is in pnl, the entry's half only in `balance_change`. Trades without lots go.
    """
    d = F.col("direction")
    market = point * (spread * market_factor / 2 + market_extra)
    limit = point * spread / 2
    fill = F.col("entry") + d * market
    distance = F.abs(fill - F.col("stop"))
    sized = labelled.withColumns({"entry_fill": fill, "lots": lots(F.lit(risk_money), F.nullif(distance, F.lit(0.0)), F.lit(point_value), step, least, most)}).where("lots > 0")
    out = F.col("exit") - d * F.when(F.col("reason") == "tp", limit).otherwise(market)
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes))
    nights = swap_nights(F.col("entry_time") + shift, F.col("exit_time") + shift)
    swap = nights * F.when(d == 1, swap_points[0]).otherwise(swap_points[1]) * point * point_value * F.col("lots")
    half = commission * F.col("lots") / 2
    priced = sized.withColumns({"exit_fill": out, "swap": swap, "commission": half})
    priced = priced.withColumn("pnl", (F.col("exit_fill") - F.col("entry_fill")) * d * point_value * F.col("lots") - half - swap)
    risked = F.abs(F.col("entry_fill") - F.col("stop")) * F.col("lots") * point_value
    return priced.withColumns({"r_multiple": F.try_divide(F.col("pnl"), F.nullif(risked, F.lit(0.0))), "balance_change": F.col("pnl") - half})


def price_trades(labelled: DataFrame, point: float, spread: float, commission: float, factor: float = 1.0, lots: float = 1.0) -> DataFrame:
    """Fills with half the spread on both sides and half the commission in pnl: entry_fill, exit_fill, pnl."""
    d = F.col("direction")
    half = point * spread * factor / 2
    priced = labelled.withColumns({"entry_fill": F.col("entry") + d * half, "exit_fill": F.col("exit") - d * half})
    return priced.withColumn("pnl", (F.col("exit_fill") - F.col("entry_fill")) * d * lots - commission * factor * lots / 2)
