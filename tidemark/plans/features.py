"""Queries on indicators, price-structure events and volume profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import indicators as ind
from tidemark.operators import profile, rules, scan, structure
from tidemark.operators.chunks import chunked
from tidemark.plans import sqltext
from tidemark.plans.sqltext import with_bars
from tidemark.registry import query
from tidemark.sources import views

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def _out(df, *columns, digits: int = 6):
    return df.select("symbol", "ts", *[F.round(c, digits).alias(c) if dict(df.dtypes)[c] == "double" else c for c in columns])


def _frame(n: int, shift: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


# ---- indicators -----------------------------------------------------------------------------------------------------


@query("ind01_sma", with_bars() + f"SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END, 6) AS sma FROM b WINDOW w AS {_frame(20)}")
def sma(spark, d):
    return _out(chunked(views.bars(spark, d), lambda b: b.withColumn("sma", ind.sma(F.col("close"), 20)), before=19), "sma")


@query("ind02_ema", with_bars(sqltext.ema("e", "b", "close", 20)) + "SELECT symbol, ts, round(y, 6) AS ema FROM e")
def ema(spark, d):
    return _out(scan.ema(views.bars(spark, d), {"ema": ("close", 20)}), "ema")


@query("ind03_wilder", with_bars(sqltext.wilder("e", "b", "close", 14)) + "SELECT b.symbol, b.ts, round(e.y, 6) AS wilder FROM b LEFT JOIN e USING (symbol, ts)")
def wilder(spark, d):
    return _out(scan.wilder(views.bars(spark, d), {"wilder": ("close", 14)}), "wilder")


@query("ind04_true_range", with_bars(sqltext.TR) + "SELECT symbol, ts, round(tr, 6) AS tr FROM tr")
def true_range(spark, d):
    return _out(chunked(views.bars(spark, d), lambda b: b.withColumn("tr", ind.true_range()), before=1), "tr")


@query("ind05_atr", with_bars(sqltext.atr(14)) + "SELECT b.symbol, b.ts, round(a.y, 6) AS atr FROM b LEFT JOIN atr a USING (symbol, ts)")
def atr(spark, d):
    return _out(scan.atr(views.bars(spark, d)), "atr")


@query("ind06_rsi", with_bars(sqltext.rsi(14)) + "SELECT b.symbol, b.ts, round(r.y, 6) AS rsi FROM b LEFT JOIN rsi r USING (symbol, ts)")
def rsi(spark, d):
    return _out(scan.rsi(views.bars(spark, d)), "rsi")


@query(
    "ind07_adx",
    with_bars(sqltext.adx(14)) + "SELECT b.symbol, b.ts, round(a.y, 6) AS adx, round(di.p, 6) AS plus_di, round(di.m, 6) AS minus_di FROM b LEFT JOIN di USING (symbol, ts) LEFT JOIN adx a USING (symbol, ts)",
)
def adx(spark, d):
    return _out(scan.adx(views.bars(spark, d)), "adx", "plus_di", "minus_di")


_MACD = [sqltext.ema("f", "b", "close", 12), sqltext.ema("s", "b", "close", 26), "m AS (SELECT symbol, ts, f.y - s.y AS line FROM f JOIN s USING (symbol, ts))", sqltext.ema("g", "m", "line", 9)]


@query("ind08_macd", with_bars(*_MACD) + "SELECT symbol, ts, round(line, 6) AS macd, round(g.y, 6) AS macd_signal, round(line - g.y, 6) AS macd_hist FROM m LEFT JOIN g USING (symbol, ts)")
def macd(spark, d):
    return _out(scan.macd(views.bars(spark, d)), "macd", "macd_signal", "macd_hist")


_DAY = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE)"


@query("ind09_vwap_session", with_bars() + f"SELECT symbol, ts, round(sum((high + low + close) / 3 * tick_volume) OVER w / sum(tick_volume) OVER w, 6) AS vwap FROM b WINDOW w AS (PARTITION BY symbol, {_DAY} ORDER BY ts)")
def vwap(spark, d):
    return _out(ind.session_vwap(views.bars(spark, d), "America/New_York"), "vwap")


@query(
    "ind10_vwap_bands",
    with_bars(
        f"t AS (SELECT symbol, ts, {_DAY} AS day, (high + low + close) / 3 AS tp, CASE WHEN tick_volume > 0 THEN tick_volume ELSE 1 END AS wt FROM b)",
        "v AS (SELECT *, sum(wt * tp) OVER w / sum(wt) OVER w AS vwap FROM t WINDOW w AS (PARTITION BY symbol, day ORDER BY ts))",
        "s AS (SELECT *, sqrt(sum(wt * (tp - vwap) * (tp - vwap)) OVER w / sum(wt) OVER w) AS sigma FROM v WINDOW w AS (PARTITION BY symbol, day ORDER BY ts))",
    )
    + "SELECT symbol, ts, round(vwap, 6) AS vwap, round(vwap + 2 * sigma, 6) AS upper, round(vwap - 2 * sigma, 6) AS lower FROM s",
)
def vwap_bands(spark, d):
    return _out(ind.vwap_bands(views.bars(spark, d), "America/New_York", 2.0), "vwap", "upper", "lower")


@query("ind11_donchian", with_bars() + f"SELECT symbol, ts, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS upper, CASE WHEN count(*) OVER w = 20 THEN min(low) OVER w END AS lower FROM b WINDOW w AS {_frame(20, 1)}")
def donchian(spark, d):
    def channel(bars):
        upper, lower = ind.donchian(20)
        return bars.withColumns({"upper": upper, "lower": lower})

    return chunked(views.bars(spark, d), channel, before=20).select("symbol", "ts", "upper", "lower")


def _swing_sql(op: str) -> str:
    return f"""SELECT symbol, ts, coalesce(count(*) OVER p = 3 AND count(*) OVER f = 3 AND high {op} greatest(max(high) OVER p, max(high) OVER f), false) AS swing_high,
    coalesce(count(*) OVER p = 3 AND count(*) OVER f = 3 AND low {op.replace(">", "<")} least(min(low) OVER p, min(low) OVER f), false) AS swing_low, lead(ts, 3) OVER (PARTITION BY symbol ORDER BY ts) AS confirmed_at
    FROM b WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"""


def _swings(spark, d, strict):
    found = chunked(views.bars(spark, d), lambda b: ind.swings(b, 3, 3, strict=strict), before=3, after=3)
    return found.select("symbol", "ts", F.coalesce("swing_high", F.lit(False)).alias("swing_high"), F.coalesce("swing_low", F.lit(False)).alias("swing_low"), "confirmed_at")


@query("ind12_swing_points", with_bars() + _swing_sql(">"))
def swing_points(spark, d):
    return _swings(spark, d, True)


@query("ind12b_pivot_points", with_bars() + _swing_sql(">="))
def pivot_points(spark, d):
    return _swings(spark, d, False)


_KNOWN = f"""sw AS ({_swing_sql(">")}), jj AS (SELECT b.*, sw.swing_high, sw.swing_low FROM b JOIN sw USING (symbol, ts)),
kn AS (SELECT *, last_value(CASE WHEN hs THEN hl END IGNORE NULLS) OVER u AS hh, last_value(CASE WHEN hs THEN ht END IGNORE NULLS) OVER u AS hts, last_value(CASE WHEN ls THEN ll END IGNORE NULLS) OVER u AS lo, last_value(CASE WHEN ls THEN lt END IGNORE NULLS) OVER u AS lts
 FROM (SELECT *, lag(swing_high, 3) OVER w AS hs, lag(high, 3) OVER w AS hl, lag(ts, 3) OVER w AS ht, lag(swing_low, 3) OVER w AS ls, lag(low, 3) OVER w AS ll, lag(ts, 3) OVER w AS lt FROM jj {W})
 WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


@query(
    "ind13_fib_zone",
    with_bars(_KNOWN)
    + """SELECT symbol, ts, CASE WHEN hh > lo THEN CASE WHEN lts < hts THEN 1 ELSE -1 END END AS fib_direction,
    round(CASE WHEN hh > lo THEN CASE WHEN lts < hts THEN hh - 0.5 * (hh - lo) ELSE lo + 0.618 * (hh - lo) END END, 6) AS fib_top,
    round(CASE WHEN hh > lo THEN CASE WHEN lts < hts THEN hh - 0.618 * (hh - lo) ELSE lo + 0.5 * (hh - lo) END END, 6) AS fib_bottom FROM kn""",
)
def fib_zone(spark, d):
    return _out(ind.fib_zone(views.bars(spark, d), 3, 3), "fib_direction", "fib_top", "fib_bottom")


@query("ind14_rolling_percentile", with_bars() + f"SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 50 THEN 100.0 * len(list_filter(list(close) OVER w, lambda v: v <= close)) / 50 END, 6) AS rank FROM b WINDOW w AS {_frame(50)}")
def rolling_percentile(spark, d):
    return _out(chunked(views.bars(spark, d), lambda b: b.withColumn("rank", ind.rolling_rank("close", 50)), before=49), "rank")


@query("ind15_minmax_position", with_bars() + f"SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 50 AND max(close) OVER w > min(close) OVER w THEN (close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w) ELSE 0.5 END, 6) AS position FROM b WINDOW w AS {_frame(50)}")
def minmax(spark, d):
    return _out(chunked(views.bars(spark, d), lambda b: b.withColumn("position", ind.minmax_position("close", 50)), before=49), "position")


@query(
    "ind16_rolling_median_atr",
    with_bars(sqltext.atr(14), f"m AS (SELECT symbol, ts, y, CASE WHEN count(*) OVER w = 20 THEN quantile_cont(y, 0.5) OVER w END AS now, CASE WHEN count(*) OVER q = 20 THEN quantile_cont(y, 0.5) OVER q END AS before FROM atr WINDOW w AS {_frame(20)}, q AS {_frame(20, 1)})")
    + "SELECT b.symbol, b.ts, round(now, 6) AS median_now, round(before, 6) AS median_before FROM b LEFT JOIN m USING (symbol, ts)",
)
def median_atr(spark, d):
    medians = lambda b: b.withColumns({"median_now": ind.rolling_median("atr", 20), "median_before": ind.rolling_median("atr", 20, 1)})
    return _out(chunked(scan.atr(views.bars(spark, d)), medians, before=20), "median_now", "median_before")


@query(
    "ind17_realized_vol",
    with_bars(f"r AS (SELECT symbol, ts, ln(close / lag(close) OVER w) AS ret FROM b {W})") + f"SELECT symbol, ts, round(CASE WHEN count(ret) OVER v = 24 THEN stddev_samp(ret) OVER v END, 6) AS vol FROM r WINDOW v AS {_frame(24)}",
)
def realized_vol(spark, d):
    volatility = lambda b: b.withColumn("ret", ind.log_return()).withColumn("vol", ind.realized_vol("ret", 24))
    return _out(chunked(views.bars(spark, d), volatility, before=25), "vol")


@query(
    "ind18_equal_highs_lows",
    with_bars(sqltext.atr(14), "j AS (SELECT b.*, a.y AS atr FROM b LEFT JOIN atr a USING (symbol, ts))", f"l AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS top, CASE WHEN count(*) OVER w = 20 THEN min(low) OVER w END AS bottom FROM j WINDOW w AS {_frame(20, 1)})")
    + "SELECT symbol, ts, CASE WHEN abs(high - top) <= 0.1 * atr THEN top END AS equal_high, CASE WHEN abs(low - bottom) <= 0.1 * atr THEN bottom END AS equal_low FROM l",
)
def equal_levels(spark, d):
    top, bottom = ind.equal_levels(20, 0.1, "atr")
    return chunked(scan.atr(views.bars(spark, d)), lambda b: b.withColumns({"equal_high": top, "equal_low": bottom}), before=20).select("symbol", "ts", "equal_high", "equal_low")


@query("ind19_volume_ratio", with_bars() + f"SELECT symbol, ts, round(tick_volume / CASE WHEN count(*) OVER w = 20 THEN avg(tick_volume) OVER w END, 6) AS ratio FROM b WINDOW w AS {_frame(20, 1)}")
def volume_ratio(spark, d):
    return _out(chunked(views.bars(spark, d), lambda b: b.withColumn("ratio", ind.ratio_to_mean("tick_volume", 20)), before=20), "ratio")


@query("ind20_momentum", sqltext.with_daily() + f"SELECT symbol, ts, round(close / lag(close, 60) OVER w - 1, 6) AS momentum FROM b {W}")
def momentum(spark, d):
    return _out(chunked(views.daily_bars(spark, d), lambda b: b.withColumn("momentum", ind.momentum(60)), before=60), "momentum")


@query(
    "ind21_regression",
    with_bars(f"v AS (SELECT *, sum((high + low + close) / 3 * tick_volume) OVER w / sum(tick_volume) OVER w AS vwap, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b WINDOW w AS (PARTITION BY symbol, {_DAY} ORDER BY ts))", "r AS (SELECT *, close - vwap AS res FROM v)")
    + f"""SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 30 THEN regr_slope(vwap, k) OVER w END, 6) AS slope, round(CASE WHEN count(*) OVER w = 30 THEN quantile_cont(res, 0.25) OVER w END, 8) AS q25,
    round(CASE WHEN count(*) OVER w = 30 THEN quantile_cont(res, 0.75) OVER w END, 8) AS q75, round(CASE WHEN count(*) OVER w = 30 THEN stddev_pop(res) OVER w / stddev_pop(close) OVER w END, 6) AS expansion FROM r WINDOW w AS {_frame(30)}""",
)
def regression(spark, d):
    out = ind.session_vwap(views.bars(spark, d), "America/New_York")
    out = chunked(out, lambda b: ind.regression(b, "vwap", 30), before=29)
    return out.select("symbol", "ts", F.round("slope", 6).alias("slope"), F.round("q25", 8).alias("q25"), F.round("q75", 8).alias("q75"), F.round("expansion", 6).alias("expansion"))


@query("ind22_micro_flow", with_bars(f"c AS (SELECT symbol, ts, CAST(sign(close - lag(close) OVER w) AS DOUBLE) AS s FROM b {W})") + f"SELECT symbol, ts, round(CASE WHEN count(s) OVER v = 12 THEN avg(s) OVER v END, 6) AS micro_flow FROM c WINDOW v AS {_frame(12)}")
def micro_flow(spark, d):
    return _out(chunked(views.bars(spark, d), lambda b: ind.micro_flow(b, 12), before=13), "micro_flow")


@query(
    "ind23_ema_slope_atr",
    with_bars(sqltext.atr(14), sqltext.ema("e", "b", "close", 50)) + "SELECT e.symbol, e.ts, round((e.y - lag(e.y, 5) OVER (PARTITION BY e.symbol ORDER BY e.ts)) / a.y, 6) AS slope FROM e LEFT JOIN atr a USING (symbol, ts)",
)
def ema_slope(spark, d):
    out = scan.ema(scan.atr(views.bars(spark, d)), {"ema": ("close", 50)})
    return _out(chunked(out, lambda b: b.withColumn("slope", (F.col("ema") - ind.lag("ema", 5)) / F.col("atr")), before=5), "slope")


@query(
    "ind24_candle_shape",
    with_bars(f"c AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM b {W})")
    + """SELECT symbol, ts, round(abs(close - open), 6) AS body, round(abs(close - open) / nullif(high - low, 0), 6) AS body_share, round((close - low) / nullif(high - low, 0), 6) AS close_position,
    coalesce(close > open AND pc < po AND close >= po AND open <= pc, false) AS bull_engulf, coalesce(close < open AND pc > po AND close <= po AND open >= pc, false) AS bear_engulf FROM c""",
)
def candle_shape(spark, d):
    return _out(chunked(views.bars(spark, d), ind.candle_shape, before=1), "body", "body_share", "close_position", "bull_engulf", "bear_engulf")


@query("ind25_range_expansion", with_bars() + f"SELECT symbol, ts, round((high - low) / nullif(CASE WHEN count(*) OVER w = 20 THEN avg(high - low) OVER w END, 0), 6) AS expansion FROM b WINDOW w AS {_frame(20, 1)}")
def range_expansion(spark, d):
    out = views.bars(spark, d).withColumn("range", F.col("high") - F.col("low"))
    return _out(chunked(out, lambda b: b.withColumn("expansion", ind.ratio_to_mean("range", 20)), before=20), "expansion")


@query(
    "ind26_reseeded_atr",
    with_bars(
        sqltext.TR,
        f"k AS (SELECT *, list(tr) OVER w AS l, first_value(high - low) OVER w AS f FROM tr WINDOW w AS {_frame(60)})",
        "u AS (SELECT symbol, ts, len(l) AS m, list_prepend(f, l[2:]) AS v FROM k)",
    )
    + """SELECT symbol, ts, round(CASE WHEN m >= 14 THEN list_sum(list_transform(v, lambda x, i: x * CASE WHEN i <= 14 THEN pow(13.0/14, m - 14) / 14 ELSE (1.0/14) * pow(13.0/14, m - i) END)) END, 6) AS atr_w FROM u""",
)
def reseeded_atr(spark, d):
    return _out(chunked(views.bars(spark, d), lambda b: ind.reseeded_atr(b, 14, 60), before=60), "atr_w")


# ---- events ---------------------------------------------------------------------------------------------------------

_ATR_B = [sqltext.atr(14), "ba AS (SELECT b.*, a.y AS atr, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS k FROM b LEFT JOIN atr a USING (symbol, ts))"]


@query(
    "evt01_fair_value_gaps",
    with_bars(*_ATR_B, f"g AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lead(ts) OVER w AS confirmed_at FROM ba {W})")
    + """SELECT symbol, ts, 1 AS direction, low AS top, h2 AS bottom, confirmed_at FROM g WHERE low > h2 AND low - h2 >= 0.2 * atr
    UNION ALL SELECT symbol, ts, -1, l2, high, confirmed_at FROM g WHERE high < l2 AND l2 - high >= 0.2 * atr""",
)
def fair_value_gaps(spark, d):
    return structure.fair_value_gaps(scan.atr(views.bars(spark, d)), 0.2)


_BREAKS = f"""{_KNOWN}, lv AS (SELECT symbol, ts, close, lag(hh) OVER w AS hh, lag(hts) OVER w AS hts, lag(lo) OVER w AS lo, lag(lts) OVER w AS lts FROM kn {W}),
br AS (SELECT symbol, ts, 1 AS direction, hh AS level, hts AS swing_ts FROM lv WHERE close > hh QUALIFY row_number() OVER (PARTITION BY symbol, hts ORDER BY ts) = 1
 UNION ALL SELECT symbol, ts, -1, lo, lts FROM lv WHERE close < lo QUALIFY row_number() OVER (PARTITION BY symbol, lts ORDER BY ts) = 1),
bk AS (SELECT *, CASE WHEN coalesce(lag(direction) OVER (PARTITION BY symbol ORDER BY ts, direction DESC), direction) = direction THEN 'BOS' ELSE 'CHoCH' END AS kind FROM br)"""


@query("evt02_swing_structure", with_bars(_BREAKS) + "SELECT symbol, ts, direction, level, swing_ts, kind FROM bk")
def swing_structure(spark, d):
    return structure.breaks(views.bars(spark, d), 3, 3)


@query(
    "evt03_liquidity_sweep",
    with_bars(_KNOWN, f"lv AS (SELECT symbol, ts, high, low, close, lag(hh) OVER w AS hh, lag(lo) OVER w AS lo FROM kn {W})")
    + "SELECT symbol, ts, hh AS level, 'above' AS side FROM lv WHERE high >= hh + 1 AND close < hh UNION ALL SELECT symbol, ts, lo, 'below' FROM lv WHERE low <= lo - 1 AND close > lo",
)
def liquidity_sweep(spark, d):
    return structure.sweeps(views.bars(spark, d), 3, 3, 1.0)


@query(
    "evt04_order_blocks",
    with_bars(_BREAKS)
    + """SELECT k.symbol, k.ts, k.direction, max(c.ts) AS block_ts, arg_max(c.high, c.ts) AS top, arg_max(c.low, c.ts) AS bottom FROM bk k
    JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b) x ON x.symbol = k.symbol AND x.ts = k.ts
    JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b) c ON c.symbol = k.symbol AND c.n BETWEEN x.n - 20 AND x.n - 1 AND c.ts >= k.swing_ts
      AND CASE WHEN k.direction = 1 THEN c.close < c.open ELSE c.close > c.open END GROUP BY 1, 2, 3""",
)
def order_blocks(spark, d):
    return structure.order_blocks(views.bars(spark, d), 3, 3, 20)


@query(
    "evt05_htf_bias",
    with_bars(_BREAKS, tf="H4")
    + """SELECT f.symbol, f.ts, coalesce(k.direction, 0) AS bias FROM (SELECT symbol, time_bucket(INTERVAL '60 minutes', ts) AS ts, time_bucket(INTERVAL '60 minutes', ts) + INTERVAL 60 MINUTE AS c FROM ticks GROUP BY ALL) f
    ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 240 MINUTE AS c, arg_max(direction, -direction) AS direction FROM bk GROUP BY 1, 2) k ON f.symbol = k.symbol AND f.c >= k.c""",
)
def htf_bias(spark, d):
    return structure.htf_bias(views.bars(spark, d), 60, views.bars(spark, d, "H4"), 240, 3, 3)


_SWEEP = f"""x AS (SELECT symbol, ts, high, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, coalesce(count(*) OVER w = 60 AND high > max(high) OVER w, false) AS new_high FROM b WINDOW w AS {_frame(60, 1)})"""


@query(
    "evt06_sweep_age",
    with_bars(_SWEEP)
    + f"SELECT symbol, ts, k - max(CASE WHEN new_high THEN k END) OVER (PARTITION BY symbol ORDER BY ts) AS age, CAST(sum(CAST(new_high AS INT)) OVER {_frame(20)} AS BIGINT) AS cluster FROM x",
)
def sweep_age(spark, d):
    return structure.sweep_age(views.bars(spark, d), 60, 20)


@query(
    "evt07_impulse_leg",
    with_bars(*_ATR_B, f"i AS (SELECT *, CASE WHEN count(*) OVER w = 12 THEN max(high) OVER w END AS top, CASE WHEN count(*) OVER w = 12 THEN min(low) OVER w END AS bottom FROM ba WINDOW w AS {_frame(12, 1)})")
    + """SELECT symbol, ts, CASE WHEN close > top THEN 1 ELSE -1 END AS direction, CASE WHEN close > top THEN bottom ELSE top END AS origin, close AS extreme,
    round(CASE WHEN close > top THEN close - 0.5 * (close - bottom) ELSE close + 0.5 * (top - close) END, 6) AS zone_near FROM i WHERE (close > top AND close - bottom >= 2 * atr) OR (close < bottom AND top - close >= 2 * atr)""",
)
def impulse_leg(spark, d):
    found = structure.impulses(scan.atr(views.bars(spark, d)), 12, 2.0)
    return found.select("symbol", "ts", "direction", "origin", "extreme", F.round("zone_near", 6).alias("zone_near"))


@query(
    "evt09_cross_events",
    with_bars(sqltext.ema("f", "b", "close", 10), sqltext.ema("s", "b", "close", 30), "j AS (SELECT symbol, ts, f.y - s.y AS d, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM f JOIN s USING (symbol, ts) WHERE f.y IS NOT NULL AND s.y IS NOT NULL)", f"c AS (SELECT *, CASE WHEN d > 0 AND lag(d) OVER w <= 0 THEN 1 WHEN d < 0 AND lag(d) OVER w >= 0 THEN -1 ELSE 0 END AS x FROM j {W})")
    + "SELECT symbol, ts, x AS cross_now, k - max(CASE WHEN x <> 0 THEN k END) OVER (PARTITION BY symbol ORDER BY ts) AS bars_since FROM c",
)
def cross_events(spark, d):
    out = scan.ema(views.bars(spark, d), {"fast": ("close", 10), "slow": ("close", 30)})
    return structure.crosses(out, "fast", "slow").select("symbol", "ts", "cross_now", "bars_since")


@query(
    "evt10_once_per_day",
    with_bars(f"u AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS upper, CASE WHEN count(*) OVER w = 20 THEN min(low) OVER w END AS lower FROM b WINDOW w AS {_frame(20, 1)})", "s AS (SELECT symbol, ts, CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 END AS direction FROM u)")
    + "SELECT symbol, ts, direction FROM s WHERE direction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, direction, CAST(ts AS DATE) ORDER BY ts) = 1",
)
def once_per_day(spark, d):
    upper, lower = ind.donchian(20)
    flagged = views.bars(spark, d).withColumns({"u": upper, "l": lower}).withColumn("direction", F.when(F.col("close") > F.col("u"), 1).when(F.col("close") < F.col("l"), -1))
    return structure.first_of_day(flagged.where("direction IS NOT NULL"), "UTC").select("symbol", "ts", "direction")


_REST = 180


@query(
    "evt10_cooldown",
    with_bars(f"u AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS upper, CASE WHEN count(*) OVER w = 20 THEN min(low) OVER w END AS lower FROM b WINDOW w AS {_frame(20, 1)})", "s AS (SELECT symbol, ts, CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 END AS direction FROM u)",
              "h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM s WHERE direction IS NOT NULL)",
              f"c AS (SELECT symbol, n, ts, direction, ts AS taken FROM h WHERE n = 1 UNION ALL SELECT h.symbol, h.n, h.ts, h.direction, CASE WHEN h.ts >= c.taken + INTERVAL {_REST} MINUTE THEN h.ts ELSE c.taken END FROM c JOIN h ON h.symbol = c.symbol AND h.n = c.n + 1)")
    + "SELECT symbol, ts, direction FROM c WHERE ts = taken",
)
def cooldown(spark, d):
    upper, lower = ind.donchian(20)
    flagged = views.bars(spark, d).withColumns({"u": upper, "l": lower}).withColumn("direction", F.when(F.col("close") > F.col("u"), 1).when(F.col("close") < F.col("l"), -1))
    hits = flagged.where("direction IS NOT NULL").select(F.lit("channel").alias("rule"), "symbol", "ts", "direction", F.lit(_REST).cast("long").alias("rest"))
    return rules.cooled(hits).select("symbol", "ts", "direction")


# ---- volume profile -------------------------------------------------------------------------------------------------

_BINS = """lim AS (SELECT symbol, CAST(ts AS DATE) AS day, low, high, tick_volume FROM b),
bn AS (SELECT symbol, day, unnest(range(CAST(floor(low / 5) AS BIGINT), CAST(floor(high / 5) AS BIGINT) + 1)) AS bin, low, high, tick_volume FROM lim),
pv AS (SELECT symbol, day, bin, sum(CASE WHEN high > low THEN tick_volume * greatest(0, least(high, (bin + 1) * 5) - greatest(low, bin * 5)) / (high - low) ELSE tick_volume END) AS volume FROM bn GROUP BY 1, 2, 3)"""


@query("vpr01_volume_bins", with_bars(_BINS) + "SELECT symbol, day, bin, round(volume, 6) AS volume FROM pv")
def volume_bins(spark, d):
    return profile.bins(views.bars(spark, d).withColumn("day", F.to_date("ts")), ["symbol", "day"], 5.0).select("symbol", "day", "bin", F.round("volume", 6).alias("volume"))


@query("vpr02_poc", with_bars(_BINS) + "SELECT symbol, day, (first(bin ORDER BY round(volume, 6) DESC, bin) + 0.5) * 5 AS poc FROM pv GROUP BY 1, 2")
def poc(spark, d):
    volumes = profile.bins(views.bars(spark, d).withColumn("day", F.to_date("ts")), ["symbol", "day"], 5.0)
    return profile.poc(volumes, ["symbol", "day"], 5.0)


#: The bins around the fullest, one joining at a time: the larger neighbour, of equal ones the lower.
_AREA = """vd AS (SELECT symbol, day, min(bin) AS lo, max(bin) AS hi, 0.7 * sum(round(volume, 6)) AS goal, first(bin ORDER BY round(volume, 6) DESC, bin) AS top, max(round(volume, 6)) AS most FROM pv GROUP BY 1, 2),
va AS (SELECT symbol, day, lo, hi, goal, top AS a, top AS z, most AS held FROM vd UNION ALL
  SELECT symbol, day, lo, hi, goal, CASE WHEN below >= above THEN a - 1 ELSE a END, CASE WHEN below >= above THEN z ELSE z + 1 END, held + greatest(below, above) FROM (
    SELECT v.*, CASE WHEN v.a > v.lo THEN coalesce(round(p.volume, 6), 0) ELSE -1 END AS below, CASE WHEN v.z < v.hi THEN coalesce(round(q.volume, 6), 0) ELSE -1 END AS above
    FROM va v LEFT JOIN pv p ON p.symbol = v.symbol AND p.day = v.day AND p.bin = v.a - 1 LEFT JOIN pv q ON q.symbol = v.symbol AND q.day = v.day AND q.bin = v.z + 1 WHERE v.held < v.goal AND (v.a > v.lo OR v.z < v.hi)) x),
ar AS (SELECT symbol, day, min(a) * 5.0 AS va_low, (max(z) + 1) * 5.0 AS va_high FROM va GROUP BY 1, 2)"""


@query("vpr03_value_area", with_bars(_BINS, _AREA) + "SELECT * FROM ar")
def value_area(spark, d):
    volumes = profile.bins(views.bars(spark, d).withColumn("day", F.to_date("ts")), ["symbol", "day"], 5.0)
    return profile.value_area(volumes, ["symbol", "day"], 5.0, 0.7)


@query(
    "vpr04_hvn_lvn",
    with_bars(_BINS, "md AS (SELECT symbol, day, quantile_cont(volume, 0.5) AS m FROM pv GROUP BY 1, 2)")
    + "SELECT symbol, day, count(*) FILTER (WHERE round(volume, 6) > round(1.5 * m, 6)) AS n_high, count(*) FILTER (WHERE round(volume, 6) < round(0.5 * m, 6)) AS n_low FROM pv JOIN md USING (symbol, day) GROUP BY 1, 2",
)
def hvn_lvn(spark, d):
    volumes = profile.bins(views.bars(spark, d).withColumn("day", F.to_date("ts")), ["symbol", "day"], 5.0)
    return profile.nodes(volumes, ["symbol", "day"], 5.0).select("symbol", "day", F.size("high_nodes").cast("long").alias("n_high"), F.size("low_nodes").cast("long").alias("n_low"))
