"""Multi-step rule sets: each joins a few features or events and filters to signals (symbol, ts, direction, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import in_session, local, minute_of_day
from tidemark.operators import indicators as ind
from tidemark.operators import chunks, joins, patterns, scan, structure
from tidemark.operators.aggregates import session_range
from tidemark.operators.indicators import lag, order, rows
from tidemark.operators.stages import saved


def _side(long: Column, short: Column) -> Column:
    return F.when(long, 1).when(short, -1)


def _only(df: DataFrame) -> DataFrame:
    return df.where("direction IS NOT NULL")


def trend_pullback(days: DataFrame) -> DataFrame:
    """Daily trend (close to SMA 200, DI order, ADX of 20 or more), touch of EMA 20 within half an ATR, close beyond the bar before."""
    out = scan.trend(days, {"ema20": ("close", 20)}, chunk_days=1000).withColumn("sma200", ind.sma(F.col("close"), 200))
    out = out.withColumns({"__h": lag("high"), "__l": lag("low")})
    band = 0.5 * F.col("atr")
    long = (F.col("close") > F.col("sma200")) & (F.col("plus_di") > F.col("minus_di")) & (F.col("low") <= F.col("ema20") + band) & (F.col("close") > F.col("__h"))
    short = (F.col("close") < F.col("sma200")) & (F.col("plus_di") < F.col("minus_di")) & (F.col("high") >= F.col("ema20") - band) & (F.col("close") < F.col("__l"))
    return _only(out.where("adx >= 20").withColumn("direction", _side(long, short))).drop("__h", "__l")


def vwap_pullback(bars: DataFrame, zone: str = "America/New_York", least: int = 3, extreme: float = 25.0, stop_atr: float = 1.5, fallback_atr: float = 2.0, min_rr: float = 2.0) -> DataFrame:
    """New York morning: a bar touches the session's VWAP with RSI(2) at an extreme, the next one closes beyond it, and at least
    `least` bars since 9:45 closed on that side. The target is the previous day's level, else fallback_atr; a signal needs
    min_rr. The first of each side and day.
    """
    at = local(F.col("ts"), zone)
    table = scan.trend(chunks.row_numbers(bars), {}, rsis={"rsi2": 2}).withColumns({"day": F.to_date(at), "minute": minute_of_day(at)})
    table = table.join(_day_levels(table), ["symbol", "day"])
    so_far = Window.partitionBy("symbol", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.col("minute") >= 570
    weight = F.when(open_, F.col("tick_volume"))
    total = F.sum(weight).over(so_far)
    table = table.withColumn("vwap", F.when(open_ & (total > 0), F.sum(weight * (F.col("high") + F.col("low") + F.col("close")) / 3).over(so_far) / total))
    since = lambda side: F.sum(F.when((F.col("minute") >= 585) & side, 1).otherwise(0)).over(so_far)
    table = table.withColumns({"above": since(F.col("close") > F.col("vwap")), "below": since(F.col("close") < F.col("vwap")), "opened": F.sum(open_.cast("int")).over(so_far)})
    fields = ["day", "minute", "close", "vwap", "above", "below", "opened", "atr", "previous_high", "previous_low"]
    found = []
    for side, touch in ((1, (F.col("low") <= F.col("vwap")) & (F.col("rsi2") < extreme)), (-1, (F.col("high") >= F.col("vwap")) & (F.col("rsi2") > 100 - extreme))):

        def confirm(row: Column, seen: dict[str, Column], side: int = side) -> Column:
            inside = (row["day"] == seen["start"]["day"]) & row["minute"].between(585, 685) & (row["opened"] >= least + 2) & (row["k"] >= 16)
            return inside & (row["above" if side == 1 else "below"] >= least) & ((row["close"] - row["vwap"]) * side > 0)

        found.append(patterns.match(table, touch, [patterns.Step("now", 1, confirm)], fields).select("symbol", "now.*", F.lit(side).alias("direction")))
    hits = found[0].unionByName(found[1])
    d, risk = F.col("direction"), stop_atr * F.col("atr")
    level = F.when(d == 1, F.col("previous_high")).otherwise(F.col("previous_low"))
    worth = lambda price: F.when((price - F.col("close")) * d / risk >= min_rr, price)
    hits = hits.withColumns({"stop": F.col("close") - d * risk, "target": F.coalesce(worth(level), worth(F.col("close") + d * fallback_atr * F.col("atr")))})
    return structure.first_of_day(hits.where("target IS NOT NULL"), zone).select("symbol", "ts", "direction", "stop", "target")


def _day_levels(dated: DataFrame) -> DataFrame:
    """symbol, day, previous_high, previous_low: of the previous day with bars; one row a day."""
    days = dated.groupBy("symbol", "day").agg(F.max("high").alias("h"), F.min("low").alias("l"))
    each = Window.partitionBy("symbol").orderBy("day")
    return days.select("symbol", "day", F.lag("h").over(each).alias("previous_high"), F.lag("l").over(each).alias("previous_low"))


def _gap_rows(table: DataFrame, swing: int, lookback: int, min_gap: float) -> DataFrame:
    """Bars with `gap`: the three-bar gap that this bar confirms (it formed one bar ago), its middle bar and the last swings that
    were known at the middle bar; null if there is none."""
    known = ind.swings(table, swing, swing)
    mark = lambda flag, level: F.lag(F.when(F.col(flag), F.col(level)), swing).over(order())
    known = known.withColumns({"__sh": mark("swing_high", "high"), "__sl": mark("swing_low", "low")})
    known = known.withColumns({c: F.last(c, ignorenulls=True).over(rows(lookback)) for c in ("__sh", "__sl")})
    top, bottom = lag("low"), lag("high", 3)
    up = (top > bottom) & (top - bottom >= min_gap * lag("atr"))
    low_top, low_bottom = lag("low", 3), lag("high")
    down = (low_bottom < low_top) & (low_top - low_bottom >= min_gap * lag("atr"))
    middle = [lag(c, 2).alias(c) for c in ("ts", "open", "high", "low", "close", "atr")] + [lag("__sh", 2).alias("swing_high"), lag("__sl", 2).alias("swing_low")]
    gap = F.struct(F.when(up, 1).otherwise(-1).alias("side"), F.when(up, top).otherwise(low_top).alias("top"), F.when(up, bottom).otherwise(low_bottom).alias("bottom"), F.struct(*middle).alias("middle"))
    return known.withColumn("gap", F.when(up | down, gap)).drop("__sh", "__sl", "swing_high", "swing_low", "confirmed_at")


def sweep_gap_limit(bars: DataFrame, zone: str = "America/New_York", start: int = 540, end: int = 600, until: int = 660, atr: int = 20, wick: float = 0.1, body_atr: float = 1.5, body_share: float = 0.7, min_gap: float = 0.3, swing: int = 2, lookback: int = 30, buffer: float = 0.3, min_rr: float = 2.0) -> DataFrame:
    """Limit orders after a sweep of the reference hour's range, one per local day.

    Inside the window the first bar whose wick takes a side of the range and that closes back inside sets the direction. Later a
    gap of that direction is confirmed, whose middle bar came after the sweep, has the body asked for and closes beyond the
    last known swing: the limit is the gap's middle, the stop lies beyond the sweep's extreme so far, the target is the
    range's other side, and min_rr has to be met. An automaton per local day.
    """
    table = chunks.chunked(scan.atr(bars, atr), lambda t: _gap_rows(t, swing, lookback, min_gap), before=lookback + 2 * swing + 4, after=swing + 1)
    table = table.withColumn("day", F.to_date(local(F.col("ts"), zone)))
    inside = table.join(session_range(bars, start, end, zone).drop("n"), ["symbol", "day"]).where(in_session(F.col("ts"), end, until, zone) & (F.col("atr") > 0))
    hit_type = "struct<ts:timestamp_ntz,limit:double,stop:double,target:double>"
    first = F.struct(F.lit(0).alias("side"), F.lit(0.0).alias("extreme"), F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(None).cast(hit_type).alias("hit"))

    def step(now: Column, row: Column) -> Column:
        high, low, close = row["high"], row["low"], row["close"]
        above = (high > row["range_high"]) & (high - row["range_high"] >= wick * row["atr"]) & (close < row["range_high"])
        below = (low < row["range_low"]) & (row["range_low"] - low >= wick * row["atr"]) & (close > row["range_low"])
        swept = F.struct(
            F.when(above, -1).when(below, 1).otherwise(0).alias("side"), F.when(above, high).when(below, low).otherwise(0.0).alias("extreme"),
            F.when(above | below, row["ts"]).alias("since"), now["hit"].alias("hit"),
        )
        side = now["side"]
        extreme = F.when(side == 1, F.least(now["extreme"], low)).otherwise(F.greatest(now["extreme"], high))
        gap, mid = row["gap"], row["gap"]["middle"]
        body, span = F.abs(mid["close"] - mid["open"]), mid["high"] - mid["low"]
        beyond = F.when(side == 1, mid["close"] > mid["swing_high"]).otherwise(mid["close"] < mid["swing_low"])
        strong = ((mid["close"] - mid["open"]) * side > 0) & (mid["atr"] > 0) & (body >= body_atr * mid["atr"]) & (span > 0) & (body >= body_share * span) & beyond
        limit = (gap["top"] + gap["bottom"]) / 2
        stop = extreme - side * buffer * row["atr"]
        target = F.when(side == 1, row["range_high"]).otherwise(row["range_low"])
        risk, gain = (limit - stop) * side, (target - limit) * side
        fits = (gap["side"] == side) & (mid["ts"] > now["since"]) & strong & (risk > 0) & (gain > 0) & (gain >= min_rr * risk)
        hit = F.struct(row["ts"].alias("ts"), limit.alias("limit"), stop.alias("stop"), target.alias("target"))
        going = F.struct(side.alias("side"), extreme.alias("extreme"), now["since"].alias("since"), F.when(F.coalesce(fits, F.lit(False)), hit).alias("hit"))
        return F.when(now["hit"].isNotNull(), now).when(side == 0, swept).otherwise(going)

    found = patterns.fold_sessions(inside, ["symbol", "day"], ["high", "low", "close", "atr", "range_high", "range_low", "gap"], first, step)
    return found.where("state.hit IS NOT NULL").select("symbol", "state.hit.ts", F.col("state.side").alias("direction"), "state.hit.limit", "state.hit.stop", "state.hit.target")


def session_breakout(bars: DataFrame, higher: DataFrame, days: DataFrame, start: int = 0, end: int = 7, until: int = 17, full: bool = True, atr: int = 14, median: int = 20, adr: int = 20, max_adr: float = 0.5, least: float = 0.0, ema: int = 200, skip_monday: bool = True, reward: float = 2.0) -> DataFrame:
    """First hourly close of a UTC day outside the range of its first hours that passes every filter.

    Filters: the ATR of the last closed day lies above the median of the ones before it, the range is at least `least` and at
    most max_adr of the mean daily range, the last closed H4 bar is on that side of its EMA, no Mondays. Returns symbol, ts, k,
    direction, range_high, range_low, and stop (the range's other side) and target of a market entry.
    """
    dated = chunks.row_numbers(bars).withColumn("day", F.to_date("ts"))
    inside = dated.where(F.hour("ts").between(start, end - 1)).groupBy("symbol", "day").agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"), F.count("*").alias("n"))
    ranges = inside.where(F.col("range_high") > F.col("range_low")).where((F.col("n") >= end - start) | F.lit(not full)).drop("n")
    frame = rows(adr - 1)
    daily = scan.atr(days, atr, chunk_days=3650).withColumn("adr", ind.full(F.avg(F.col("high") - F.col("low")).over(frame), frame, adr, F.col("high")))
    daily = daily.withColumn("calm", ind.rolling_median("atr", median, 1)).select("symbol", "ts", F.col("atr").alias("day_atr"), "calm", "adr")
    trend = scan.ema(higher, {"h4_ema": ("close", ema)}).select("symbol", "ts", F.col("close").alias("h4_close"), "h4_ema")
    hours = dated.where(F.hour("ts").between(end, until - 1)).join(ranges, ["symbol", "day"])
    hours = hours.withColumn("direction", F.when(F.col("close") > F.col("range_high"), 1).when(F.col("close") < F.col("range_low"), -1)).where("direction IS NOT NULL")
    hours = joins.asof(hours.withColumn("__day", F.col("day").cast("timestamp_ntz")), daily, "symbol", "__day", "ts", ["day_atr", "calm", "adr"], strict=True)
    hours = joins.align_timeframes(hours, trend, 60, 240, ["h4_close", "h4_ema"])
    size = F.col("range_high") - F.col("range_low")
    passed = (F.col("day_atr") > F.col("calm")) & (size >= least) & (F.col("adr") > 0) & (size <= max_adr * F.col("adr")) & ((F.col("h4_close") - F.col("h4_ema")) * F.col("direction") > 0)
    if skip_monday:
        passed &= F.dayofweek("ts") != 2
    once = Window.partitionBy("symbol", "day").orderBy("ts")
    first = hours.where(passed).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    stop = F.when(F.col("direction") == 1, F.col("range_low")).otherwise(F.col("range_high"))
    return first.select("symbol", "ts", "k", "direction", "range_high", "range_low", stop.alias("stop"), (F.col("close") + reward * (F.col("close") - stop)).alias("target"))


def retest_limits(breakouts: DataFrame, bars: DataFrame, distance: float, expiry: int = 6, reward: float = 2.0) -> DataFrame:
    """Breakouts entered on the retest: a limit at the broken side of the range, filled by the first of the next `expiry` bars that
    reaches it (fill_ts null: it expires). The stop lies `distance` beyond, the target `reward` times as far."""
    d = F.col("direction")
    limit = F.when(d == 1, F.col("range_high")).otherwise(F.col("range_low"))
    marked = chunks.row_numbers(bars).join(breakouts.select("symbol", "ts", "direction", limit.alias("limit")), ["symbol", "ts"], "left")

    def touched(row: Column, seen: dict[str, Column]) -> Column:
        order_ = seen["start"]
        return F.when(order_["direction"] == 1, row["low"] <= order_["limit"]).otherwise(row["high"] >= order_["limit"])

    found = patterns.match(marked, F.col("direction").isNotNull(), [patterns.Step("fill", expiry, touched)], ["direction", "limit", "low", "high"], partial=True)
    side, price = F.col("start.direction"), F.col("start.limit")
    return found.select("symbol", "start.ts", side.alias("direction"), price.alias("limit"), (price - side * distance).alias("stop"), (price + side * reward * distance).alias("target"), F.col("fill.ts").alias("fill_ts"))


def fix_fade(bars: DataFrame, k: float, zone: str = "Europe/London") -> DataFrame:
    """On the bar of 16:00 London time: a move of at least k x ATR over the two hours before is faded."""
    out = scan.atr(bars).withColumns({"__from": F.lag("open", 2).over(order()), "__atr": lag("atr"), "__close": lag("close")})
    move = F.col("__close") - F.col("__from")
    return _only(out.where(minute_of_day(local(F.col("ts"), zone)) == 960).withColumn("direction", _side(move <= -k * F.col("__atr"), move >= k * F.col("__atr")))).select("symbol", "ts", "direction")


def decision_drift(bars: DataFrame, decisions: DataFrame, k: float, open_hour: int = 8, check_hour: int = 13) -> DataFrame:
    """On decision days, the move from the open hour to the check hour is followed if larger than k x ATR. decisions: decision_ts."""
    days = decisions.select(F.to_date("decision_ts").alias("day")).distinct()
    out = scan.atr(bars).withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")}).join(days, "day", "left_semi")
    per_day = out.groupBy("symbol", "day").agg(
        F.max(F.when(F.col("hour") == open_hour, F.col("open"))).alias("a"), F.max(F.when(F.col("hour") == check_hour, F.struct("ts", "close", "atr"))).alias("b")
    )
    move = F.col("b.close") - F.col("a")
    return _only(per_day.withColumn("direction", _side(move > k * F.col("b.atr"), move < -k * F.col("b.atr")))).select("symbol", F.col("b.ts").alias("ts"), "direction")


def vwap_relay(bars: DataFrame, gate: float = 0.9, n: int = 30) -> DataFrame:
    """Balanced market (residual spread below the gate): fade beyond the residual quartiles; else follow band breaks with the slope."""
    out = ind.micro_flow(ind.regression(ind.vwap_bands(bars, "America/New_York", 1.0), "vwap", n), 6)
    gap = F.col("close") - F.col("vwap")
    calm = F.col("expansion") < gate
    long = F.when(calm, gap < F.col("q25")).otherwise((F.col("close") > F.col("upper")) & (F.col("slope") > 0) & (F.col("micro_flow") > 0))
    short = F.when(calm, gap > F.col("q75")).otherwise((F.col("close") < F.col("lower")) & (F.col("slope") < 0) & (F.col("micro_flow") < 0))
    return _only(out.withColumn("direction", _side(long, short))).select("symbol", "ts", "direction")


def mtf_squeeze(bars: DataFrame, minutes: int, higher: DataFrame, higher_minutes: int) -> DataFrame:
    """Quiet higher timeframe (rank of its ATR at most 40 of 100) as of the bar's close, channel break with volume on the lower."""
    calm = scan.atr(higher).withColumn("squeeze", ind.rolling_rank("atr", 50)).select("symbol", "ts", "squeeze")
    upper, lower = ind.donchian(20)
    table = bars.withColumns({"upper": upper, "lower": lower, "vol_ratio": ind.ratio_to_mean("tick_volume", 20)}).select("symbol", "ts", "close", "upper", "lower", "vol_ratio")
    out = joins.align_timeframes(table, calm, minutes, higher_minutes, ["squeeze"])
    ready = (F.col("squeeze") <= 40) & (F.col("vol_ratio") >= 1.2)
    return _only(out.withColumn("direction", _side(ready & (F.col("close") > F.col("upper")), ready & (F.col("close") < F.col("lower"))))).select("symbol", "ts", "direction")


def sweep_reclaim(bars: DataFrame, lookback: int = 60, age: int = 12) -> DataFrame:
    """A new `lookback`-bar extreme at most `age` bars ago, and now a close back inside the level it took."""
    top, bottom = ind.donchian(lookback)
    out = bars.withColumns({"__top": top, "__bottom": bottom})
    recent = rows(age, -1)
    out = out.withColumns({
        "__high": F.last(F.when(F.col("high") > F.col("__top"), F.col("__top")), ignorenulls=True).over(recent), "__low": F.last(F.when(F.col("low") < F.col("__bottom"), F.col("__bottom")), ignorenulls=True).over(recent), "__before": lag("close"),
    })
    long = (F.col("__before") < F.col("__low")) & (F.col("close") >= F.col("__low"))
    short = (F.col("__before") > F.col("__high")) & (F.col("close") <= F.col("__high"))
    return _only(out.withColumn("direction", _side(long, short))).select("symbol", "ts", "direction")


def swing_breakout(bars: DataFrame, left: int = 3, right: int = 3, buffer: float = 0.1, far: float = 6.0) -> DataFrame:
    """First close beyond the last confirmed swing plus a buffer; stop at the opposite swing, or 1.5 ATR if that is far."""
    out = structure.known_swings(scan.atr(bars), left, right)
    out = out.withColumns({"hi": F.col("__h.level"), "lo": F.col("__l.level")}).drop("__h", "__l")
    out = out.withColumns({"__hb": lag("hi"), "__lb": lag("lo"), "__cb": lag("close"), "__ab": lag("atr")})
    edge = buffer * F.col("atr")
    long = (F.col("close") > F.col("hi") + edge) & (F.col("__cb") <= F.col("__hb") + buffer * F.col("__ab"))
    short = (F.col("close") < F.col("lo") - edge) & (F.col("__cb") >= F.col("__lb") - buffer * F.col("__ab"))
    hits = _only(out.withColumn("direction", _side(long, short)))
    opposite = F.when(F.col("direction") == 1, F.col("lo")).otherwise(F.col("hi"))
    near = F.abs(F.col("close") - opposite) <= far * F.col("atr")
    return hits.select("symbol", "ts", "direction", F.when(near, opposite).otherwise(F.col("close") - F.col("direction") * 1.5 * F.col("atr")).alias("stop"))


def macd_continuation(bars: DataFrame, armed: int = 10) -> DataFrame:
    """MACD crossed its signal at most `armed` bars ago, close on the side of a rising (falling) EMA 99."""
    out = scan.ema(scan.macd(bars), {"ema99": ("close", 99)})
    out = structure.crosses(out.where("macd_signal IS NOT NULL"), "macd", "macd_signal")
    out = chunks.chunked(out, lambda t: t.withColumn("__e", lag("ema99", 5)), before=5).withColumn("__c", F.when(F.col("cross_now") != 0, F.col("cross_now")))
    out = chunks.last_known(out, {"__last": "__c"}).withColumn("__side", F.when(F.col("bars_since") <= armed, F.col("__last")))
    long = (F.col("__side") == 1) & (F.col("close") > F.col("ema99")) & (F.col("ema99") > F.col("__e"))
    short = (F.col("__side") == -1) & (F.col("close") < F.col("ema99")) & (F.col("ema99") < F.col("__e"))
    return _only(out.withColumn("direction", _side(long, short))).select("symbol", "ts", "direction")


@dataclass(frozen=True)
class PullbackPreset:
    """Parameters in which the presets of `impulse_pullback` differ."""

    name: str
    adx: float
    min_impulse: float
    shallow: float
    bars: int
    buffer: float


# The five presets of the impulse pullback rule.
PULLBACK_PRESETS = (
    PullbackPreset("baseline", 20.0, 1.25, 0.382, 6, 0.15), PullbackPreset("conservative", 25.0, 1.50, 0.382, 4, 0.25), PullbackPreset("balanced", 25.0, 1.50, 0.382, 6, 0.20),
    PullbackPreset("fast_pullback", 20.0, 1.25, 0.500, 4, 0.15), PullbackPreset("strong_trend", 25.0, 1.50, 0.500, 6, 0.25),
)


def _impulse_setup(past: Column, preset: PullbackPreset, side: int, deep: float, undone: float, calm: float) -> Column:
    """Setup of one preset and side from the bars up to now, newest first: the youngest impulse at least one bar ago, whose zone
    was touched since, that was not undone, and after which bars are small; null if there is none."""
    up = side == 1
    far = F.least(F.lit(preset.bars + 1), F.size(past) - 1)
    bar = lambda i: F.get(past, i)
    low = lambda b: b["bottom"] if up else b["low"]
    high = lambda b: b["high"] if up else b["top"]
    broke = lambda b: (b["close"] > b["top"] if up else b["close"] < b["bottom"]) & (b["atr"] > 0) & (high(b) - low(b) >= preset.min_impulse * b["atr"])
    age = F.get(F.filter(F.when(far >= 1, F.sequence(F.lit(1), far)), lambda i: F.coalesce(broke(bar(i)), F.lit(False))), 0)
    leg = bar(age)
    top, bottom = high(leg), low(leg)
    span = top - bottom
    at = lambda share: top - share * span if up else bottom + share * span
    zone_low, zone_high = (at(deep), at(preset.shallow)) if up else (at(preset.shallow), at(deep))
    since = F.slice(past, F.lit(1), age)
    touched = F.exists(since, lambda b: (b["low"] <= zone_high) & (b["high"] >= zone_low))
    broken = F.exists(since, lambda b: b["low"] <= at(undone) if up else b["high"] >= at(undone))
    small = F.aggregate(since, F.lit(0.0), lambda a, b: a + b["high"] - b["low"]) / age < calm * span
    recent = F.slice(past, 1, preset.bars + 1)
    pivot = F.array_min(F.transform(recent, lambda b: b["low"])) if up else F.array_max(F.transform(recent, lambda b: b["high"]))
    fits = age.isNotNull() & (span > 0) & touched & ~broken & small & (F.size(past) >= preset.bars + 1)
    return F.when(fits, F.struct(F.lit(preset.name).alias("preset"), F.lit(side).alias("side"), F.lit(preset.adx).alias("adx"), F.lit(preset.buffer).alias("buffer"), zone_low.alias("zone_low"), zone_high.alias("zone_high"), pivot.alias("pivot")))


def impulse_pullback(bars: DataFrame, hours: DataFrame, higher: DataFrame, presets: tuple[PullbackPreset, ...] = PULLBACK_PRESETS, lookback: int = 8, deep: float = 0.618, undone: float = 0.786, calm: float = 0.75, slope_bars: int = 8, min_slope: float = 0.2, ema: int = 50, reclaim: int = 4, reward: float = 2.0, least_atr: float = 1.0) -> DataFrame:
    """Trend on H4, impulse and pullback on H1, reclaim on M15, for each preset.

    H4: close beyond its EMA, whose slope over slope_bars is at least min_slope ATR, and ADX. H1: see _impulse_setup. M15: the
    bar takes the extreme of the `reclaim` bars before, closes in its direction, inside the zone's far side and beyond the bar
    before. The stop lies a buffer beyond the pullback's extreme. All higher bars have closed by the bar's close. A short is
    only looked for where there is no long.
    """
    deepest = max(p.bars for p in presets) + 1
    top, bottom = ind.donchian(lookback)

    def setups_of(table: DataFrame) -> DataFrame:
        marked = table.withColumns({"top": top, "bottom": bottom})
        past = F.reverse(F.collect_list(F.struct("high", "low", "close", "top", "bottom", "atr")).over(rows(deepest)))
        listed = marked.withColumn("__past", past)
        return listed.withColumn("setups", F.array_compact(F.array(*[_impulse_setup(F.col("__past"), p, side, deep, undone, calm) for p in presets for side in (1, -1)]))).drop("__past", "top", "bottom")

    impulses = chunks.chunked(scan.atr(hours).select("symbol", "ts", "high", "low", "close", "atr"), setups_of, before=deepest + lookback + 1).select("symbol", "ts", "setups")
    impulses = saved(impulses)  # an as-of join reads its right side twice
    h4 = scan.trend(higher.select("symbol", "ts", "open", "high", "low", "close", "tick_volume"), {"ema": ("close", ema)})
    regime = chunks.chunked(h4, lambda t: t.withColumn("slope", (F.col("ema") - lag("ema", slope_bars)) / F.col("atr")), before=slope_bars)
    regime = regime.select("symbol", "ts", (F.col("close") - F.col("ema")).alias("h4_gap"), "slope", F.col("adx").alias("h4_adx"))

    def trigger(table: DataFrame) -> DataFrame:
        before = rows(reclaim, -1)
        enough = F.count("*").over(before) == reclaim
        up = enough & (F.col("low") < F.min("low").over(before)) & (F.col("close") > F.col("open")) & (F.col("close") > lag("high"))
        down = enough & (F.col("high") > F.max("high").over(before)) & (F.col("close") < F.col("open")) & (F.col("close") < lag("low"))
        return table.withColumn("direction", _side(up, down))

    at = F.hour("ts").between(8, 21) & F.dayofweek("ts").between(2, 6) & ~((F.dayofweek("ts") == 6) & (F.hour("ts") >= 19))
    table = chunks.chunked(scan.atr(bars).select("symbol", "ts", "open", "high", "low", "close", "atr"), trigger, before=reclaim + 1).where(at & F.col("direction").isNotNull() & (F.col("atr") >= least_atr))
    table = saved(table)
    table = joins.align_timeframes(joins.align_timeframes(table, impulses, 15, 60, ["setups"]), regime, 15, 240, ["h4_gap", "slope", "h4_adx"])
    d = F.col("direction")
    table = table.where((F.col("h4_gap") * d > 0) & (F.col("slope") * d >= min_slope)).withColumn("s", F.explode("setups"))
    reclaimed = F.when(d == 1, F.col("close") > F.col("s.zone_low")).otherwise(F.col("close") < F.col("s.zone_high"))
    found = table.where((F.col("s.side") == d) & (F.col("h4_adx") >= F.col("s.adx")) & reclaimed).withColumn("stop", F.col("s.pivot") - d * F.col("s.buffer") * F.col("atr"))
    return found.where((F.col("close") - F.col("stop")) * d > 0).select(F.col("s.preset").alias("preset"), "symbol", "ts", "direction", "stop", (F.col("close") + reward * (F.col("close") - F.col("stop"))).alias("target"))


def score_table(table: DataFrame) -> DataFrame:
    """Additive long and short scores of trend, strength, volume and candle, with a threshold that rises in wild markets."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    span = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open")) >= 0.5 * span
    common = one(F.col("adx") >= 15) + one(F.col("vol_ratio") >= 1) + one(body)
    long = 2 * one(F.col("close") > F.col("ema50")) + one(F.col("ema20") > F.col("ema50")) + one(F.col("close") > F.col("open")) + common
    short = 2 * one(F.col("close") < F.col("ema50")) + one(F.col("ema20") < F.col("ema50")) + one(F.col("close") < F.col("open")) + common
    threshold = 6 + one(F.col("atr_rank") >= 80)
    quality = lambda s: F.when(s >= 7, "A").when(s >= 6, "B").otherwise("C")
    best = F.greatest(long, short)
    return table.select("symbol", "ts", long.alias("long_score"), short.alias("short_score"), threshold.alias("threshold"), quality(best).alias("quality"), F.when((long >= threshold) & (long > short), 1).when((short >= threshold) & (short > long), -1).otherwise(0).alias("direction"))
