"""Causal indicators with window functions; null until warm.

Every function takes bars with (symbol, ts) and returns them with more columns. All use one ordering, so Spark plans one
exchange and one sort however many are chained. Recurrences (EMA, Wilder) live in operators.scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import local
from tidemark.operators.chunks import chunked, last_known


def order():
    """The one ordering of every indicator; a function, since Window needs a running session."""
    return Window.partitionBy("symbol").orderBy("ts")


def rows(before: int, after: int = 0):
    """Frame from `before` rows back to `after` rows ahead (negative: that many back)."""
    return order().rowsBetween(-before, after)


def full(value: Column, frame, n: int, counted: Column) -> Column:
    """value if the frame holds n non-null rows, else null."""
    return F.when(F.count(counted).over(frame) == n, value)


def lag(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(order())


def sma(x: Column, n: int) -> Column:
    frame = rows(n - 1)
    return full(F.avg(x).over(frame), frame, n, x)


def true_range() -> Column:
    previous = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def session_vwap(bars: DataFrame, zone: str, name: str = "vwap") -> DataFrame:
    """Volume-weighted typical price since the start of the local day; null while there is no volume."""
    day = Window.partitionBy("symbol", "__day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    dated = bars.withColumn("__day", F.to_date(local(F.col("ts"), zone)))
    total = F.sum("tick_volume").over(day)
    return dated.withColumn(name, F.when(total > 0, F.sum(typical * F.col("tick_volume")).over(day) / total)).drop("__day")


def vwap_bands(bars: DataFrame, zone: str, k: float) -> DataFrame:
    """VWAP (equal weights where volume is 0) with bands of k deviations; each bar's deviation is from its own running value."""
    day = Window.partitionBy("symbol", "__day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    weight = F.when(F.col("tick_volume") > 0, F.col("tick_volume")).otherwise(1.0)
    out = bars.withColumns({"__day": F.to_date(local(F.col("ts"), zone)), "__w": weight, "__tp": typical})
    out = out.withColumn("__sum", F.sum("__w").over(day)).withColumn("vwap", F.sum(F.col("__w") * F.col("__tp")).over(day) / F.col("__sum"))
    out = out.withColumn("sigma", F.sqrt(F.sum(F.col("__w") * (F.col("__tp") - F.col("vwap")) ** 2).over(day) / F.col("__sum")))
    return out.withColumns({"upper": F.col("vwap") + k * F.col("sigma"), "lower": F.col("vwap") - k * F.col("sigma")}).drop("__day", "__w", "__tp", "__sum")


def donchian(n: int, shift: int = 1) -> tuple[Column, Column]:
    """Highest high and lowest low of n bars, ending `shift` bars before the current."""
    frame = rows(n - 1 + shift, -shift)
    return full(F.max("high").over(frame), frame, n, F.col("high")), full(F.min("low").over(frame), frame, n, F.col("low"))


def swings(bars: DataFrame, left: int, right: int, lag_bars: int = 0, strict: bool = True) -> DataFrame:
    """swing_high, swing_low flags of complete windows, and confirmed_at: the time of bar i + right + lag_bars."""
    out = bars
    before, after = rows(left, -1), rows(-1, right)
    whole = (F.count("*").over(before) == left) & (F.count("*").over(after) == right)
    high = F.greatest(F.max("high").over(before), F.max("high").over(after))
    low = F.least(F.min("low").over(before), F.min("low").over(after))
    beats = (F.col("high") > high, F.col("low") < low) if strict else (F.col("high") >= high, F.col("low") <= low)
    return out.withColumns({"swing_high": whole & beats[0], "swing_low": whole & beats[1], "confirmed_at": F.lead("ts", right + lag_bars).over(order())})


def confirmed_swings(bars: DataFrame, left: int, right: int) -> DataFrame:
    """bars with __sh and __sl (ts, level): the swing high and low that this bar, `right` bars after it, confirms, else null.

    Windows of finite reach, in chunks of rows.
    """

    def mark(table: DataFrame) -> DataFrame:
        found = swings(table, left, right)
        at = lambda flag, level: F.lag(F.when(F.col(flag), F.struct("ts", F.col(level).alias("level"))), right).over(order())
        return found.withColumns({"__sh": at("swing_high", "high"), "__sl": at("swing_low", "low")}).drop("swing_high", "swing_low", "confirmed_at")

    return chunked(bars, mark, before=left + right, after=right, number="k" if "k" in bars.columns else None)


def fib_zone(bars: DataFrame, left: int, right: int, near: float = 0.5, far: float = 0.618) -> DataFrame:
    """Retracement zone between the last confirmed swing high and low; up if the low is the older one."""
    found = confirmed_swings(bars, left, right)
    known = last_known(found, {"__h": "__sh", "__l": "__sl"})
    high, low = F.col("__h.level"), F.col("__l.level")
    span = high - low
    valid = span > 0
    up = F.col("__l.ts") < F.col("__h.ts")
    return known.withColumns({
        "fib_direction": F.when(valid, F.when(up, 1).otherwise(-1)),
        "fib_top": F.when(valid, F.when(up, high - near * span).otherwise(low + far * span)),
        "fib_bottom": F.when(valid, F.when(up, high - far * span).otherwise(low + near * span)),
    }).drop("__h", "__l", "__sh", "__sl")


def rolling_rank(x: str, n: int) -> Column:
    """Percentage of the last n values, the current one included, that are at most the current."""
    frame = rows(n - 1)
    values = F.collect_list(x).over(frame)
    return F.when(F.size(values) == n, 100.0 * F.size(F.filter(values, lambda v: v <= F.col(x))) / n)


def minmax_position(x: str, n: int) -> Column:
    frame = rows(n - 1)
    low, high = F.min(x).over(frame), F.max(x).over(frame)
    warm = (F.count(x).over(frame) == n) & (high > low)
    return F.when(warm, (F.col(x) - low) / F.when(warm, high - low)).otherwise(0.5)


def rolling_median(x: str, n: int, shift: int = 0) -> Column:
    frame = rows(n - 1 + shift, -shift)
    return full(F.percentile(x, 0.5).over(frame), frame, n, F.col(x))


def log_return() -> Column:
    return F.log(F.col("close") / lag("close"))


def realized_vol(returns: str, n: int) -> Column:
    frame = rows(n - 1)
    return full(F.stddev_samp(returns).over(frame), frame, n, F.col(returns))


def equal_levels(n: int, tolerance: float, atr: str) -> tuple[Column, Column]:
    """Highs at the highest of the n bars before (within tolerance x ATR), and the same for lows: the level or null."""
    frame = rows(n, -1)
    top = full(F.max("high").over(frame), frame, n, F.col("high"))
    bottom = full(F.min("low").over(frame), frame, n, F.col("low"))
    close_by = lambda a, b: F.abs(a - b) <= tolerance * F.col(atr)
    return F.when(close_by(F.col("high"), top), top), F.when(close_by(F.col("low"), bottom), bottom)


def ratio_to_mean(x: str, n: int) -> Column:
    """x over the mean of the n rows before."""
    frame = rows(n, -1)
    return F.try_divide(F.col(x), full(F.avg(x).over(frame), frame, n, F.col(x)))


def momentum(n: int) -> Column:
    return F.col("close") / lag("close", n) - 1


def regression(bars: DataFrame, y: str, n: int) -> DataFrame:
    """slope of y over the last n rows, quartiles of close - y there, and the deviation of that residual to the close's."""
    frame = rows(n - 1)
    out = bars.withColumns({"__row": F.row_number().over(order()), "__res": F.col("close") - F.col(y)})
    warm = F.count(y).over(frame) == n
    return out.withColumns({
        "slope": F.when(warm, F.regr_slope(F.col(y), F.col("__row").cast("double")).over(frame)),
        "q25": F.when(warm, F.percentile("__res", 0.25).over(frame)),
        "q75": F.when(warm, F.percentile("__res", 0.75).over(frame)),
        "expansion": F.when(warm, F.try_divide(F.stddev_pop("__res").over(frame), F.stddev_pop("close").over(frame))),
    }).drop("__row", "__res")


def micro_flow(bars: DataFrame, n: int) -> DataFrame:
    """Mean sign of the last n close changes."""
    signed = bars.withColumn("__sign", F.signum(F.col("close") - lag("close")))
    frame = rows(n - 1)
    return signed.withColumn("micro_flow", full(F.avg("__sign").over(frame), frame, n, F.col("__sign"))).drop("__sign")


def candle_shape(bars: DataFrame) -> DataFrame:
    """body, range, body_share, close_position, bullish and bearish engulfing of the previous body."""
    o, c, span = F.col("open"), F.col("close"), F.col("high") - F.col("low")
    po, pc = lag("open"), lag("close")
    return bars.withColumns({
        "body": F.abs(c - o), "range": span, "body_share": F.try_divide(F.abs(c - o), span), "close_position": F.try_divide(c - F.col("low"), span),
        "bull_engulf": F.coalesce((c > o) & (pc < po) & (c >= po) & (o <= pc), F.lit(False)),
        "bear_engulf": F.coalesce((c < o) & (pc > po) & (c <= po) & (o >= pc), F.lit(False)),
    })


def reseeded(values: Column, weights_of) -> Column:
    """Recurrence that restarts on a window, as fixed weights over its rows (oldest first)."""
    size = F.size(values)
    return F.aggregate(F.zip_with(values, weights_of(size), lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)


def reseeded_atr(bars: DataFrame, n: int, window: int, name: str = "atr_w") -> DataFrame:
    """ATR whose recurrence starts anew on the last `window` rows: the oldest true range is high - low."""
    ranges = bars.withColumns({"__tr": true_range(), "__hl": F.col("high") - F.col("low")})
    frame = rows(window - 1)
    out = ranges.withColumns({"__list": F.collect_list("__tr").over(frame), "__first": F.first("__hl").over(frame)})
    a = 1.0 / n

    def weights(size: Column) -> Column:
        # lag k < m: a (1-a)^k; each of the n oldest rows: (1-a)^m / n, with m = size - n
        m = size - n
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i < n, F.pow(F.lit(1 - a), m) / n).otherwise(a * F.pow(F.lit(1 - a), size - 1 - i)))

    values = F.concat(F.array("__first"), F.slice("__list", F.lit(2), F.size("__list") - 1))
    return out.withColumn(name, F.when(F.size("__list") >= n, reseeded(values, weights))).drop("__tr", "__hl", "__list", "__first")


def reseeded_ema(bars: DataFrame, n: int, window: int, name: str = "ema_w") -> DataFrame:
    """EMA whose recurrence starts anew on the oldest of the last `window` closes."""
    values = F.collect_list("close").over(rows(window - 1))
    a = 2.0 / (n + 1)
    weights = lambda size: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == 0, F.pow(F.lit(1 - a), size - 1)).otherwise(a * F.pow(F.lit(1 - a), size - 1 - i)))
    return bars.withColumn("__list", values).withColumn(name, F.when(F.size("__list") >= n, reseeded(F.col("__list"), weights))).drop("__list")
