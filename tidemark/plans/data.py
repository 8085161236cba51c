"""Queries on sources, quality, sessions, joins and aggregates of market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import time as clock
from tidemark.functions import trade
from tidemark.operators import aggregates, chunks, joins, oplogs, quality, ranks
from tidemark.operators import indicators as ind
from tidemark.operators import bars as bar_ops
from tidemark.registry import query
from tidemark.sources import files, views
from tidemark.sources.views import TRADE_ORDER, with_views



def _symbol_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol -> currency, dealt by the length of the name; both engines compute it."""
    n = F.pmod(F.length("symbol"), F.lit(3))
    return views.ticks(spark, sf_dir).select("symbol").distinct().withColumn("currency", F.when(n == 0, "USD").when(n == 1, "EUR").otherwise("JPY"))


_CCY = "ccy AS (SELECT DISTINCT symbol, CASE length(symbol) % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency FROM ticks)"
_minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))

# ---- bars -----------------------------------------------------------------------------------------------------------


@query("agg01_ticks_to_bars", with_views("ticks", "H1") + "SELECT * FROM bars_h1")
def ticks_to_bars(spark, d):
    return bar_ops.ticks_to_bars(views.ticks(spark, d), 60)


@query(
    "agg02_resample_bars",
    with_views("ticks", "M5")
    + """SELECT symbol, time_bucket(INTERVAL '240 minutes', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
      last(close ORDER BY ts) AS close, sum(tick_volume) AS tick_volume FROM bars_m5 GROUP BY 1, 2""",
)
def resample(spark, d):
    return bar_ops.resample(views.bars(spark, d, "M5"), 240)


@query("src02_load_ohlcv", with_views("ticks", "M15") + "SELECT * FROM bars_m15 WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
def load_ohlcv(spark, d):
    bars = views.bars(spark, d, "M15").drop("tf")
    return bars.where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12 06:00:00").cast("timestamp_ntz")))


# ---- quality --------------------------------------------------------------------------------------------------------

_ARRIVALS = """arrivals AS (SELECT *, 0 AS arrival FROM bars_h1 UNION ALL SELECT symbol, ts, close, high, low, open, tick_volume * 2, 1 FROM bars_h1 WHERE hour(ts) % 3 = 0)"""


def _arrivals(spark, d) -> DataFrame:
    bars = views.bars(spark, d).drop("tf")
    again = bars.where(F.hour("ts") % 3 == 0).select("symbol", "ts", F.col("close").alias("open"), "high", "low", F.col("open").alias("close"), (F.col("tick_volume") * 2).alias("tick_volume"))
    return bars.withColumn("arrival", F.lit(0)).unionByName(again.withColumn("arrival", F.lit(1)))


@query("qlt01_validate_ohlcv", with_views("ticks", "H1") + f", {_ARRIVALS} SELECT symbol, ts, open, high, low, close, tick_volume FROM arrivals QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY arrival) = 1")
def validate(spark, d):
    return quality.validate(_arrivals(spark, d), "arrival")


@query("qlt02_merge_bars", with_views("ticks", "H1") + f", {_ARRIVALS} SELECT symbol, ts, open, high, low, close, tick_volume FROM arrivals QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY arrival DESC) = 1")
def merge(spark, d):
    both = _arrivals(spark, d)
    return quality.merge(both.where("arrival = 0"), both.where("arrival = 1"))


_WEEKEND = "(dayofweek(hole) = 6 OR (dayofweek(hole) = 5 AND hour(hole) >= 21) OR (dayofweek(hole) = 0 AND hour(hole) < 21))"


@query(
    "qlt03_audit_gaps",
    with_views("ticks", "M5")
    + f""", p AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS previous FROM bars_m5),
    m AS (SELECT symbol, previous, unnest(generate_series(previous + INTERVAL 5 MINUTE, ts - INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS hole FROM p WHERE ts > previous + INTERVAL 5 MINUTE)
    SELECT symbol, min(hole) AS first, max(hole) AS last, count(*) AS n FROM m WHERE NOT {_WEEKEND} GROUP BY symbol, previous""",
)
def audit_gaps(spark, d):
    return quality.gaps(views.bars(spark, d, "M5"), 5)


@query(
    "set02_missing_bar_times",
    with_views("ticks", "M15")
    + f""", s AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars_m15 GROUP BY symbol), e AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS hole FROM s)
    SELECT symbol, hole AS ts FROM e WHERE NOT {_WEEKEND} EXCEPT SELECT symbol, ts FROM bars_m15""",
)
def missing_times(spark, d):
    return quality.missing_times(views.bars(spark, d, "M15"), 15)


@query(
    "qlt04_history_capping",
    with_views("ticks", "H1")
    + """SELECT symbol, count(*) AS n_rows, min(ts) AS first, max(ts) AS last, min(ts) > TIMESTAMP '2023-12-20' + INTERVAL 600 MINUTE + INTERVAL 2 DAY AS late_start,
      count(*) < 0.5 * (epoch(max(ts)) - epoch(TIMESTAMP '2023-12-20')) / 60.0 / 60 * 5 / 7 AS thin FROM bars_h1 GROUP BY symbol""",
)
def history_cap(spark, d):
    return quality.history_cap(views.bars(spark, d), F.lit("2023-12-20").cast("timestamp_ntz"), 60)


@query("qlt05_coverage_by_hour", with_views("ticks", "M5") + "SELECT symbol, hour(ts) AS hour, count(*) AS n FROM bars_m5 GROUP BY 1, 2")
def coverage(spark, d):
    return quality.coverage_by_hour(views.bars(spark, d, "M5"))


@query(
    "qlt06_ohlc_sanity",
    with_views("ticks", "H1")
    + f""", {_ARRIVALS} SELECT symbol, count(*) AS n, count(*) FILTER (WHERE high < greatest(open, close)) AS bad_high, count(*) FILTER (WHERE low > least(open, close)) AS bad_low,
      count(*) FILTER (WHERE tick_volume <= 0) AS bad_volume, avg(CAST(tick_volume = 0 AS DOUBLE)) AS zero_volume_share FROM arrivals GROUP BY symbol""",
)
def sanity(spark, d):
    return quality.sanity(_arrivals(spark, d))


@query("flt03_closed_bars_only", with_views("ticks", "H4") + "SELECT symbol, ts, close FROM bars_h4 WHERE ts + INTERVAL 240 MINUTE <= TIMESTAMP '2024-01-20 13:00:00'")
def closed_only(spark, d):
    return quality.closed_only(views.bars(spark, d, "H4"), F.lit("2024-01-20 13:00:00").cast("timestamp_ntz"), 240).select("symbol", "ts", "close")


@query(
    "flt04_resolve_window",
    with_views("ticks", "M5", "H1", "H4")
    + """, s AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars_m5 GROUP BY 1 UNION ALL SELECT symbol, min(ts), max(ts) FROM bars_h1 GROUP BY 1 UNION ALL SELECT symbol, min(ts), max(ts) FROM bars_h4 GROUP BY 1)
    SELECT symbol, max(a) AS start, min(b) AS "end" FROM s GROUP BY symbol""",
)
def common_window(spark, d):
    return quality.common_window(views.bars(spark, d, "M5").unionByName(views.bars(spark, d)).unionByName(views.bars(spark, d, "H4")))


@query(
    "snk03_incremental_days",
    with_views("ticks", "H1")
    + """, days AS (SELECT symbol, CAST(ts AS DATE) AS day, count(DISTINCT hour(ts)) AS hours FROM bars_h1 GROUP BY 1, 2)
    SELECT symbol, day, hours FROM days WHERE hours >= 20 AND day >= DATE '2024-01-11'""",
)
def incremental(spark, d):
    bars = views.bars(spark, d)
    return quality.new_days(bars, bars.where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")), hours=20)


# ---- sessions and clocks --------------------------------------------------------------------------------------------

_NY = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
_MOD = lambda e: f"(hour({e}) * 60 + minute({e}))"


@query("flt01_session_window_mask", with_views("ticks", "M15") + f"SELECT symbol, ts, {_MOD(_NY)} >= 570 AND {_MOD(_NY)} < 960 AS open_hours, {_MOD(_NY)} >= 1320 OR {_MOD(_NY)} < 120 AS night FROM bars_m15")
def session_mask(spark, d):
    return views.bars(spark, d, "M15").select("symbol", "ts", clock.in_session(F.col("ts"), 570, 960, "America/New_York").alias("open_hours"), clock.in_session(F.col("ts"), 1320, 120, "America/New_York").alias("night"))


@query(
    "flt02_named_sessions",
    with_views("ticks", "H1")
    + "SELECT symbol, ts, hour(ts) < 8 AS asia, hour(ts) >= 7 AND hour(ts) < 16 AS london, hour(ts) >= 13 AND hour(ts) < 21 AS ny, dayofweek(ts) = 1 AS monday, dayofweek(ts) = 5 AND hour(ts) >= 18 AS late_friday FROM bars_h1",
)
def named_sessions(spark, d):
    ts = F.col("ts")
    return views.bars(spark, d).select(
        "symbol", "ts", *[clock.named_session(ts, n).alias(n) for n in ("asia", "london", "ny")], (F.dayofweek(ts) == 2).alias("monday"), ((F.dayofweek(ts) == 6) & (F.hour(ts) >= 18)).alias("late_friday")
    )


@query("flt05_currency_map", with_views("ticks") + f", {_CCY} SELECT * FROM ccy")
def currency_map(spark, d):
    return _symbol_currency(spark, d)


_TICKERS = [*[f"{s.lower()}.x" for s in trade.SYMBOL_CURRENCIES], "xyzabc", "us30"]


@query(
    "flt05_symbol_currencies",
    f"""WITH names AS (SELECT n_name AS symbol FROM nation UNION SELECT ({_TICKERS})[user_id % {len(_TICKERS)} + 1] FROM events), u AS (SELECT symbol, split_part(upper(symbol), '.', 1) AS name FROM names),
    fixed AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{','.join(sorted(c))}')" for s, c in trade.SYMBOL_CURRENCIES.items())}) v(name, currencies))
    SELECT symbol, coalesce(currencies, CASE WHEN regexp_full_match(name, '[A-Z]{{6}}') THEN array_to_string(list_sort(list_distinct([substr(name, 1, 3), substr(name, 4, 3)])), ',') END, '') AS currencies FROM u LEFT JOIN fixed USING (name)""",
)
def symbol_currencies(spark, d):
    dealt = F.element_at(F.array(*map(F.lit, _TICKERS)), (F.pmod("user_id", F.lit(len(_TICKERS))) + 1).cast("int"))
    names = views.table(spark, d, "nation").select(F.col("n_name").alias("symbol")).union(views.table(spark, d, "events").select(dealt)).distinct()
    return names.select("symbol", F.array_join(trade.currencies(F.col("symbol")), ",").alias("currencies"))


@query("flt06_flat_deadline", with_views("ticks", "M15") + f"SELECT symbol, ts, {_MOD(_NY)} >= CASE WHEN dayofweek({_NY}) = 5 THEN 720 ELSE 1010 END AS past FROM bars_m15")
def flat_deadline(spark, d):
    return views.bars(spark, d, "M15").select("symbol", "ts", clock.past_deadline(F.col("ts"), 16, 50, "America/New_York", friday_hour=12).alias("past"))


@query(
    "flt07_deadline_in_gap",
    with_views("ticks", "M5")
    + """, p AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS previous FROM bars_m5)
    SELECT symbol, previous, ts FROM p WHERE ts > previous + INTERVAL 450 SECOND AND (
      (date_trunc('day', previous) + INTERVAL 21 HOUR > previous AND date_trunc('day', previous) + INTERVAL 21 HOUR < ts) OR
      (date_trunc('day', previous) + INTERVAL 45 HOUR < ts))""",
)
def deadline_in_gap(spark, d):
    rows = chunks.chunked(views.bars(spark, d, "M5").select("symbol", "ts"), lambda t: t.withColumn("previous", ind.lag("ts")), before=1)
    inside = clock.deadline_between(F.col("previous"), F.col("ts"), 21, 0, "UTC")
    return rows.where((F.col("ts") > F.col("previous") + F.expr("INTERVAL 450 SECOND")) & inside).select("symbol", "previous", "ts")


@query(
    "sca01_zone_conversion",
    with_views("ticks", "H1")
    + f"SELECT symbol, ts, {_NY} AS new_york, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') AS london, (ts AT TIME ZONE 'Asia/Tokyo' AT TIME ZONE 'UTC') AS utc_of_tokyo, CAST({_NY} AS DATE) AS local_day FROM bars_h1",
)
def zones(spark, d):
    ts = F.col("ts")
    ny = clock.local(ts, "America/New_York")
    return views.bars(spark, d).select("symbol", "ts", ny.alias("new_york"), clock.local(ts, "Europe/London").alias("london"), clock.to_utc(ts, "Asia/Tokyo").alias("utc_of_tokyo"), F.to_date(ny).alias("local_day"))


@query("sca02_server_day", with_views("ticks", "H1") + "SELECT symbol, ts, CAST(ts + INTERVAL 120 MINUTE AS DATE) AS server_day FROM bars_h1")
def server_day(spark, d):
    return views.bars(spark, d).select("symbol", "ts", clock.server_day(F.col("ts"), 120).alias("server_day"))


@query("sca03_server_offset", with_views("ticks") + "SELECT symbol, event_id, CAST(round((epoch(ts + to_seconds(event_id % 20000)) - epoch(ts)) / 900.0) * 15 AS INT) AS minutes FROM ticks")
def server_offset(spark, d):
    t = views.ticks(spark, d)
    server = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("event_id", F.lit(20000)).cast("decimal(18,6)"))
    return t.select("symbol", "event_id", clock.server_offset(server, F.col("ts")).alias("minutes"))


@query("sca04_floor_to_tf", with_views("ticks") + "SELECT symbol, event_id, time_bucket(INTERVAL '15 minutes', ts) AS m15, time_bucket(INTERVAL '240 minutes', ts) AS h4 FROM ticks")
def floors(spark, d):
    return views.ticks(spark, d).select("symbol", "event_id", bar_ops.floor_to(F.col("ts"), 15).alias("m15"), bar_ops.floor_to(F.col("ts"), 240).alias("h4"))


@query(
    "sca05_calendar_time",
    with_views("ticks", "calendar")
    + """, texts AS (SELECT time_utc, CASE WHEN hour(time_utc) = 3 THEN 'All Day' ELSE lower(strftime(time_utc, '%-I:%M%p')) END AS clock, strftime(time_utc, '%m-%d-%Y') AS day FROM calendar)
    SELECT day, clock, try_strptime(day || ' ' || upper(clock), '%m-%d-%Y %-I:%M%p') AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS time_utc FROM texts""",
)
def calendar_times(spark, d):
    at = F.col("time_utc")
    texts = views.calendar(spark, d).select(F.date_format(at, "MM-dd-yyyy").alias("day"), F.when(F.hour(at) == 3, "All Day").otherwise(F.lower(F.date_format(at, "h:mma"))).alias("clock"))
    return texts.select("day", "clock", clock.calendar_time(F.col("day"), F.col("clock")).alias("time_utc"))


# ---- joins ----------------------------------------------------------------------------------------------------------


@query(
    "jon01_align_timeframes",
    with_views("ticks", "M15", "H4")
    + """, l AS (SELECT *, ts + INTERVAL 15 MINUTE AS c FROM bars_m15), r AS (SELECT *, ts + INTERVAL 240 MINUTE AS c FROM bars_h4)
    SELECT l.symbol, l.ts, l.close, r.ts AS higher_ts, r.close AS higher_close FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.c >= r.c""",
)
def align(spark, d):
    higher = views.bars(spark, d, "H4").select("symbol", "ts", F.col("ts").alias("higher_ts"), F.col("close").alias("higher_close"))
    return joins.align_timeframes(views.bars(spark, d, "M15").select("symbol", "ts", "close"), higher, 15, 240, ["higher_ts", "higher_close"]).drop("close_ts")


@query(
    "jon02_closed_daily_asof",
    with_views("ticks", "H1", "D1") + "SELECT l.symbol, l.ts, r.close AS day_close FROM (SELECT *, date_trunc('day', ts) AS day FROM bars_h1) l ASOF LEFT JOIN bars_d1 r ON l.symbol = r.symbol AND l.day > r.ts",
)
def daily_asof(spark, d):
    left = views.bars(spark, d).select("symbol", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    right = views.bars(spark, d, "D1").select("symbol", "ts", F.col("close").alias("day_close"))
    return joins.asof(left, right, "symbol", "day", "ts", ["day_close"], strict=True).drop("day")


@query(
    "jon03_news_blackout",
    with_views("ticks", "M5", "calendar")
    + f""", {_CCY} SELECT b.symbol, b.ts, EXISTS (SELECT 1 FROM calendar c WHERE c.currency = y.currency AND c.impact = 'High'
      AND b.ts >= c.time_utc - INTERVAL 15 MINUTE AND b.ts <= c.time_utc + INTERVAL 10 MINUTE) AS blackout FROM bars_m5 b JOIN ccy y USING (symbol)""",
)
def blackout(spark, d):
    rows = views.bars(spark, d, "M5").select("symbol", "ts").join(F.broadcast(_symbol_currency(spark, d)), "symbol")  # one row a symbol
    windows = joins.blackout_windows(views.calendar(spark, d).where("impact = 'High'"))
    return joins.flag_in_windows(rows, "ts", windows, "blackout", [("currency", "currency")]).drop("currency")


@query(
    "jon04_tier1_halt",
    with_views("ticks", "M5", "calendar")
    + """SELECT b.symbol, b.ts FROM bars_m5 b WHERE EXISTS (SELECT 1 FROM calendar c WHERE (contains(c.title, 'FOMC') OR contains(c.title, 'Non-Farm') OR contains(c.title, 'CPI'))
      AND b.ts >= c.time_utc - INTERVAL 15 MINUTE AND b.ts <= c.time_utc + INTERVAL 10 MINUTE)""",
)
def tier1(spark, d):
    title = F.col("title")
    windows = joins.blackout_windows(views.calendar(spark, d).where(title.contains("FOMC") | title.contains("Non-Farm") | title.contains("CPI")))
    return joins.flag_in_windows(views.bars(spark, d, "M5").select("symbol", "ts"), "ts", windows, "halt").where("halt").drop("halt")


@query(
    "jon05_fine_bars_in_coarse",
    with_views("ticks", "M5", "H1") + "SELECT h.symbol, h.ts, f.ts AS fine_ts, f.close AS fine_close FROM bars_h1 h JOIN bars_m5 f ON h.symbol = f.symbol AND f.ts >= h.ts AND f.ts < h.ts + INTERVAL 60 MINUTE",
)
def fine_in_coarse(spark, d):
    fine = views.bars(spark, d, "M5").select("symbol", bar_ops.floor_to(F.col("ts"), 60).alias("coarse"), F.col("ts").alias("fine_ts"), F.col("close").alias("fine_close"))
    return views.bars(spark, d).select("symbol", "ts").join(fine.withColumnRenamed("coarse", "ts"), ["symbol", "ts"])


@query(
    "jon06_previous_day_levels",
    with_views("ticks", "M15")
    + f""", b AS (SELECT *, CAST({_NY} AS DATE) AS day FROM bars_m15), g AS (SELECT symbol, day, max(high) AS h, min(low) AS l FROM b GROUP BY 1, 2),
    p AS (SELECT symbol, day, lag(h) OVER w AS previous_high, lag(l) OVER w AS previous_low FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day))
    SELECT b.symbol, b.ts, p.previous_high, p.previous_low FROM b JOIN p USING (symbol, day)""",
)
def previous_day(spark, d):
    return aggregates.previous_day_levels(views.bars(spark, d, "M15"), "America/New_York").select("symbol", "ts", "previous_high", "previous_low")


@query(
    "jon07_session_range_join",
    with_views("ticks", "H1")
    + """, r AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS range_high, min(low) AS range_low, count(*) AS n FROM bars_h1 WHERE hour(ts) < 7 GROUP BY 1, 2)
    SELECT b.symbol, b.ts, b.close, range_high, range_low FROM bars_h1 b JOIN r ON b.symbol = r.symbol AND CAST(b.ts AS DATE) = r.day AND r.n = 7 WHERE hour(b.ts) >= 7 AND hour(b.ts) < 17""",
)
def session_range_join(spark, d):
    bars = views.bars(spark, d)
    ranges = aggregates.session_range(bars, 0, 420).where("n = 7").drop("n")
    later = bars.where(clock.in_session(F.col("ts"), 420, 1020)).withColumn("day", F.to_date("ts"))
    return later.join(ranges, ["symbol", "day"]).select("symbol", "ts", "close", "range_high", "range_low")


@query(
    "jon08_signal_state_asof",
    with_views("ticks", "H1")
    + """, s AS (SELECT symbol, ts, close, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS mean FROM bars_h1),
    e AS (SELECT symbol, ts, mid, event_id FROM ticks), j AS (SELECT e.symbol, e.mid, s.close, s.mean FROM e ASOF JOIN s ON e.symbol = s.symbol AND e.ts > s.ts)
    SELECT symbol, count(*) AS n, round(avg(CAST(close > mean AS DOUBLE)), 6) AS above_mean, round(avg(CAST(mid > close AS DOUBLE)), 6) AS above_close FROM j GROUP BY symbol""",
)
def signal_state(spark, d):
    state = chunks.chunked(views.bars(spark, d).select("symbol", "ts", "close"), lambda t: t.withColumn("mean", F.avg("close").over(ind.rows(9))), before=9)
    entries = views.ticks(spark, d).select("symbol", "ts", "mid")
    found = joins.asof(entries, state, "symbol", "ts", "ts", ["close", "mean"], strict=True).where("close IS NOT NULL")
    return found.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg((F.col("close") > F.col("mean")).cast("double")), 6).alias("above_mean"), F.round(F.avg((F.col("mid") > F.col("close")).cast("double")), 6).alias("above_close"))


@query(
    "jon10_vanished_positions",
    "SELECT DISTINCT o_orderkey AS position_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey IS NOT NULL)",
)
def vanished(spark, d):
    closed = views.table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("position_id"))
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("position_id")).distinct().join(closed, "position_id", "left_anti")


_TWO = "a AS (SELECT symbol, ts FROM bars_m5 WHERE close > open), b AS (SELECT symbol, ts FROM bars_m5 WHERE tick_volume >= 2)"


def _two_lists(spark, d):
    bars = views.bars(spark, d, "M5")
    return bars.where("close > open").select("symbol", "ts"), bars.where("tick_volume >= 2").select("symbol", "ts")


@query("jon11_exact_time_overlap", with_views("ticks", "M5") + f", {_TWO} SELECT a.symbol, round(avg(CAST(b.ts IS NOT NULL AS DOUBLE)), 6) AS share FROM a LEFT JOIN b USING (symbol, ts) GROUP BY 1")
def time_overlap(spark, d):
    a, b = _two_lists(spark, d)
    hits = a.join(b, ["symbol", "ts"], "left_semi").groupBy("symbol").agg(F.count("*").alias("k"))
    return a.groupBy("symbol").agg(F.count("*").alias("n")).join(hits, "symbol", "left").select("symbol", F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("share"))


@query("set03_common_times", with_views("ticks", "M5") + f", {_TWO} SELECT symbol, ts FROM a INTERSECT SELECT symbol, ts FROM b")
def common_times(spark, d):
    a, b = _two_lists(spark, d)
    return a.intersect(b)


@query(
    "jon12_catalog",
    with_views("trades")
    + """, r AS (SELECT symbol, count(*) AS n FROM trades GROUP BY 1), c AS (SELECT DISTINCT p_brand AS symbol, true AS live FROM part WHERE p_size > 25)
    SELECT symbol, coalesce(n, 0) AS n, coalesce(live, false) AS live FROM r FULL OUTER JOIN c USING (symbol)""",
)
def catalog(spark, d):
    results = views.trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"))
    live = views.table(spark, d, "part").where("p_size > 25").select(F.col("p_brand").alias("symbol")).distinct().withColumn("live", F.lit(True))
    return results.join(live, "symbol", "full_outer").select("symbol", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("live", F.lit(False)).alias("live"))


@query("jon13_grid_folds_symbols", with_views("ticks") + "SELECT s.symbol, g.length, g.mult, f.fold FROM (SELECT DISTINCT symbol FROM ticks) s, (SELECT unnest([10, 20, 55]) AS length) g0, (SELECT unnest([1.5, 2.0]) AS mult) g1, (SELECT g0.length, g1.mult FROM (SELECT unnest([10, 20, 55]) AS length) g0, (SELECT unnest([1.5, 2.0]) AS mult) g1) g, (SELECT unnest(range(4)) AS fold) f GROUP BY ALL")
def grid_folds(spark, d):
    symbols = views.ticks(spark, d).select("symbol").distinct()
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("length"), F.lit(b).alias("mult")) for a in (10, 20, 55) for b in (1.5, 2.0)]))
    return symbols.select("symbol", grid.alias("g"), F.lit(1)).select("symbol", "g.length", "g.mult", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"))


@query(
    "jon14_costs_join",
    with_views("ticks", "H1")
    + """, spec AS (SELECT DISTINCT symbol, 0.01 AS point, CASE WHEN symbol = 'error' THEN NULL ELSE length(symbol) * 1.0 END AS spread FROM ticks)
    SELECT b.symbol, b.ts, round(b.close + point * coalesce(spread, 12.0) / 2, 6) AS ask FROM bars_h1 b LEFT JOIN spec USING (symbol)""",
)
def costs(spark, d):
    spec = views.ticks(spark, d).select("symbol").distinct().select("symbol", F.lit(0.01).alias("point"), F.when(F.col("symbol") != "error", F.length("symbol").cast("double")).alias("spread"))
    bars = views.bars(spark, d).join(F.broadcast(spec), "symbol", "left")  # one row a symbol
    return bars.select("symbol", "ts", F.round(trade.fill_price(F.col("close"), F.lit(1), F.coalesce("spread", F.lit(12.0)), F.col("point")), 6).alias("ask"))


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query("agg03_session_range", with_views("ticks", "H1") + "SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS range_high, min(low) AS range_low, count(*) AS n FROM bars_h1 WHERE hour(ts) < 7 GROUP BY 1, 2")
def session_range(spark, d):
    return aggregates.session_range(views.bars(spark, d), 0, 420)


@query(
    "agg04_average_daily_range",
    with_views("daily")
    + """SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 20 THEN avg(high - low) OVER w END, 6) AS adr FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def average_range(spark, d):
    return aggregates.average_daily_range(views.daily_bars(spark, d), 20).select("symbol", "ts", F.round("adr", 6).alias("adr"))


@query(
    "agg05_hourly_drift_scan",
    with_views("ticks", "H1")
    + """, r AS (SELECT symbol, hour(ts) AS hour, ln(close / open) AS ret FROM bars_h1)
    SELECT symbol, hour, count(*) AS n, round(avg(ret), 8) AS mean, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(*)), 6) AS t FROM r GROUP BY 1, 2""",
)
def drift_scan(spark, d):
    return aggregates.hourly_drift(views.bars(spark, d))


_DEALS = """deals AS (SELECT l_orderkey AS position_id, l_suppkey % 5 AS magic, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS entry,
  round(CAST(l_extendedprice AS DOUBLE) * (CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)), 4) AS profit, -CAST(l_tax AS DOUBLE) AS commission, 0.0 AS swap, CAST(l_shipdate AS TIMESTAMP) AS time FROM lineitem),
positions AS (SELECT magic, position_id, round(sum(profit + commission + swap), 4) AS net, max(entry) = 1 AS closed, max(CASE WHEN entry = 1 THEN time END) AS close_time FROM deals GROUP BY 1, 2)"""


def _deals(spark, d) -> DataFrame:
    profit = F.round(F.col("l_extendedprice").cast("double") * (F.col("l_discount").cast("double") - F.col("l_tax").cast("double")), 4)
    return views.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("position_id"), F.pmod("l_suppkey", F.lit(5)).alias("magic"), (F.col("l_linestatus") == "F").cast("int").alias("entry"), profit.alias("profit"),
        (-F.col("l_tax").cast("double")).alias("commission"), F.lit(0.0).alias("swap"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"),
    )


@query(
    "agg06_deal_rollup",
    f"""WITH {_DEALS} SELECT magic, count(*) FILTER (WHERE closed) AS n_closed, count(*) FILTER (WHERE closed AND net >= 0) AS wins, round(sum(net) FILTER (WHERE closed), 4) AS net,
    round(sum(net) FILTER (WHERE closed AND net > 0) / -sum(net) FILTER (WHERE closed AND net < 0), 6) AS profit_factor FROM positions GROUP BY magic""",
)
def deal_rollup(spark, d):
    return aggregates.deals_by_magic(aggregates.positions(_deals(spark, d)))


@query("agg07_daily_realized", f"WITH {_DEALS} SELECT CAST(close_time AS DATE) AS day, round(sum(net), 4) AS net, count(*) AS n FROM positions WHERE closed GROUP BY 1")
def daily_realized(spark, d):
    return aggregates.positions(_deals(spark, d)).where("closed").groupBy(F.to_date("close_time").alias("day")).agg(F.round(F.sum("net"), 4).alias("net"), F.count("*").alias("n"))


@query(
    "agg08_journal_to_trades",
    f"""WITH {_DEALS}, j AS (SELECT position_id AS ticket, entry, time, profit, row_number() OVER (PARTITION BY position_id, entry ORDER BY time DESC, profit DESC) AS k,
      row_number() OVER (PARTITION BY position_id, entry ORDER BY time, profit) AS f FROM deals)
    SELECT ticket, max(CASE WHEN entry = 0 AND f = 1 THEN time END) AS open_time, max(CASE WHEN entry = 1 AND k = 1 THEN time END) AS close_time,
      max(CASE WHEN entry = 1 AND k = 1 THEN profit END) AS profit, max(entry) = 0 AS still_open FROM j GROUP BY ticket""",
)
def journal_trades(spark, d):
    return aggregates.journal_trades(_deals(spark, d).select(F.col("position_id").alias("ticket"), F.when(F.col("entry") == 1, "CLOSE").otherwise("OPEN").alias("event"), "time", "profit"))


@query(
    "agg09_net_position_close",
    f"""WITH {_DEALS} SELECT position_id, round(sum(profit + commission + swap), 4) AS net, CASE position_id % 5 WHEN 3 THEN 'SL' WHEN 4 THEN 'TP' ELSE 'other' END AS reason FROM deals GROUP BY position_id""",
)
def net_close(spark, d):
    reason = F.pmod("position_id", F.lit(5))
    return _deals(spark, d).groupBy("position_id").agg(F.round(F.sum(F.col("profit") + F.col("commission") + F.col("swap")), 4).alias("net")).select("position_id", "net", F.when(reason == 3, "SL").when(reason == 4, "TP").otherwise("other").alias("reason"))


@query(
    "agg11_exit_reason_mix",
    with_views("trades") + "SELECT run_id, count(*) FILTER (WHERE pnl > 0) AS tp, count(*) FILTER (WHERE pnl < 0) AS sl, count(*) FILTER (WHERE pnl = 0) AS flat FROM trades GROUP BY 1",
)
def exit_mix(spark, d):
    reason = F.when(F.col("pnl") > 0, "tp").when(F.col("pnl") < 0, "sl").otherwise("flat")
    return views.trades(spark, d).withColumn("reason", reason).groupBy("run_id").pivot("reason", ["tp", "sl", "flat"]).agg(F.count(F.lit(1))).na.fill(0)


@query(
    "agg12_holding_time_profile",
    with_views("trades")
    + """, h AS (SELECT symbol, epoch(exit_time) - epoch(entry_time) AS s, pnl FROM trades)
    SELECT symbol, quantile_cont(s, 0.5) AS median_s, quantile_cont(s, 0.75) AS p75_s, round(avg(CAST(s <= 36000 AS DOUBLE)), 6) AS short_share, round(sum(CASE WHEN s <= 36000 THEN pnl ELSE 0 END), 4) AS short_pnl FROM h GROUP BY 1""",
)
def holding_profile(spark, d):
    return aggregates.holding_profile(views.trades(spark, d), 36_000)


@query(
    "agg13_quantile_bucket_pf",
    with_views("trades")
    + """, b AS (SELECT *, ntile(5) OVER (PARTITION BY run_id ORDER BY price, exit_time, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS bucket FROM trades)
    SELECT run_id, bucket, count(*) AS n, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 6) AS profit_factor FROM b GROUP BY 1, 2""",
)
def bucket_pf(spark, d):
    return ranks.ntile(views.trades(spark, d), "run_id", ["price", *TRADE_ORDER[:-1]], 5).groupBy("run_id", "bucket").agg(F.count("*").alias("n"), F.round(trade.profit_factor(F.col("pnl")), 6).alias("profit_factor"))


@query(
    "agg14_max_concurrent_open",
    with_views("trades")
    + """, e AS (SELECT symbol, entry_time AS t, 1 AS step FROM trades UNION ALL SELECT symbol, exit_time, -1 FROM trades), m AS (SELECT symbol, t, sum(step) AS step FROM e GROUP BY 1, 2),
    r AS (SELECT symbol, sum(step) OVER (PARTITION BY symbol ORDER BY t) AS open FROM m) SELECT symbol, CAST(max(open) AS BIGINT) AS peak FROM r GROUP BY 1""",
)
def max_open(spark, d):
    return aggregates.max_concurrent(views.trades(spark, d))


@query(
    "agg16_signal_funnel",
    with_views("ticks", "H1")
    + """, g AS (SELECT symbol, unnest(list_filter([CASE WHEN hour(ts) < 7 OR hour(ts) >= 17 THEN 'session' END, CASE WHEN tick_volume < 3 THEN 'volume' END, CASE WHEN close <= open THEN 'direction' END, CASE WHEN high - low < 100 THEN 'range' END], lambda x: x IS NOT NULL)) AS gate FROM bars_h1)
    SELECT symbol, gate, count(*) AS n FROM g GROUP BY 1, 2""",
)
def funnel(spark, d):
    gates = {"session": ~clock.in_session(F.col("ts"), 420, 1020), "volume": F.col("tick_volume") < 3, "direction": F.col("close") <= F.col("open"), "range": F.col("high") - F.col("low") < 100}
    return aggregates.funnel(views.bars(spark, d), gates)


@query("sca13_props_json", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS k_text FROM events")
def props_json(spark, d):
    events = views.table(spark, d, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


@query("sca14_range_pips", with_views("ticks", "H1") + "SELECT symbol, ts, round((high - low) / 0.1, 4) AS range_pips FROM bars_h1")
def range_pips(spark, d):
    return views.bars(spark, d).select("symbol", "ts", F.round(trade.pips(F.col("high") - F.col("low"), 0.1), 4).alias("range_pips"))


# ---- files, logs, parameters ----------------------------------------------------------------------------------------

_LINES = """lines AS (SELECT event_id, ts, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' [' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '] ' ||
  CASE event_id % 3 WHEN 0 THEN 'heartbeat equity=' || printf('%.2f', value) WHEN 1 THEN 'no entry ' || event_type || ': spread' ELSE 'tick ' || event_type END AS value FROM events)"""


def _log_lines(spark, d) -> DataFrame:
    e = views.table(spark, d, "events")
    k = F.pmod("event_id", F.lit(3))
    text = F.when(k == 0, F.concat(F.lit("heartbeat equity="), F.format_string("%.2f", "value"))).when(k == 1, F.concat(F.lit("no entry "), "event_type", F.lit(": spread"))).otherwise(F.concat(F.lit("tick "), "event_type"))
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad(F.pmod("event_id", F.lit(1000)).cast("string"), 3, "0"), F.lit(" ["), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit("] "))
    return e.select(F.concat(head, text).alias("value"), "event_id", "event_type")


_LOG_TS = "date_trunc('second', ts) + to_milliseconds(event_id % 1000)"


@query("src10_read_text_log", f"WITH {_LINES} SELECT {_LOG_TS} AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, substr(value, strpos(value, '] ') + 2) AS msg FROM lines")
def text_log(spark, d):
    return files.text_log(_log_lines(spark, d))


@query("sca12_log_regex", f"WITH {_LINES} SELECT {_LOG_TS} AS ts, event_type, CASE WHEN event_id % 3 = 0 THEN CAST(regexp_extract(value, 'equity=([0-9.]+)', 1) AS DOUBLE) END AS equity, CASE WHEN event_id % 3 = 1 THEN 'spread' END AS reason FROM lines")
def log_regex(spark, d):
    lines = _log_lines(spark, d)
    parsed = lines.select("event_type", *[F.regexp_extract("value", r"^([\d-]+ [\d:]+),(\d{3}) \[\w+\] (.*)$", i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "msg"))])
    return parsed.select(F.concat_ws(".", "a", "b").cast("timestamp_ntz").alias("ts"), "event_type", oplogs.heartbeat_equity(F.col("msg")).alias("equity"), oplogs.no_entry_reason(F.col("msg")).alias("reason"))


@query(
    "jon09_trade_log_window",
    f"""WITH {_LINES}, tr AS (SELECT event_id AS ticket, event_type AS symbol, ts AS entry_time, ts + INTERVAL 2 HOUR AS exit_time FROM events)
    SELECT ticket, symbol, {_LOG_TS.replace("ts)", "l.ts)").replace("event_id", "l.event_id")} AS ts, substr(value, strpos(value, '] ') + 2) AS msg FROM tr JOIN lines l ON {_LOG_TS.replace("ts)", "l.ts)").replace("event_id", "l.event_id")} BETWEEN entry_time - INTERVAL 15 MINUTE AND exit_time AND contains(substr(value, strpos(value, '] ') + 2), symbol)""",
)
def trade_log(spark, d):
    e = views.table(spark, d, "events")
    at = F.col("ts").cast("timestamp_ntz")
    trades = e.select(F.col("event_id").alias("ticket"), F.col("event_type").alias("symbol"), at.alias("entry_time"), (at + F.expr("INTERVAL 2 HOURS")).alias("exit_time"))
    return oplogs.lines_of_trades(trades, files.text_log(_log_lines(spark, d))).select("ticket", "symbol", "ts", "msg")


@query("src03_parse_m1_lines", "SELECT date_trunc('second', ts) + INTERVAL 5 HOUR AS ts, value AS open, value + 1 AS high, value - 1 AS low, value AS close, 3.0 AS tick_volume FROM events")
def m1_lines(spark, d):
    v = F.col("value")
    line = F.concat_ws(";", F.date_format("ts", "yyyyMMdd HHmmss"), v.cast("string"), (v + 1).cast("string"), (v - 1).cast("string"), v.cast("string"), F.lit("3"))
    return files.parse_m1_lines(views.table(spark, d, "events").select(line.alias("value")))


@query(
    "src06_calendar_xml",
    with_views("ticks", "calendar") + """SELECT CASE WHEN hour(time_utc) <> 3 THEN date_trunc('minute', time_utc) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' END AS time_utc, currency, impact, title FROM calendar WHERE minute(time_utc) <> 7""",
)
def calendar_xml(spark, d):
    at = F.col("time_utc")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    clock_text = F.when(F.hour(at) == 3, F.lit("All Day")).otherwise(F.lower(F.date_format(at, "h:mma")))
    title = F.when(F.minute(at) == 7, F.lit("")).otherwise(F.col("title"))
    event = tag("event", F.concat(tag("title", title), tag("country", F.lower("currency")), tag("date", F.date_format(at, "MM-dd-yyyy")), tag("time", clock_text), tag("impact", F.col("impact"))))
    documents = views.calendar(spark, d).groupBy(F.to_date("time_utc").alias("day")).agg(F.concat(F.lit("<weeklyevents>"), F.array_join(F.collect_list(event), ""), F.lit("</weeklyevents>")).alias("xml"))
    return files.calendar_events(documents)


@query("src07_read_decisions", "SELECT date_trunc('minute', ts) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS decision_ts FROM events WHERE event_id % 10 <> 0")
def decision_lines(spark, d):
    line = F.when(F.col("event_id") % 10 == 0, F.lit("# comment")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(", "), F.date_format("ts", "HH:mm")))
    return files.decisions(views.table(spark, d, "events").select(line.alias("value")))


@query("src09_read_event_log", "SELECT date_trunc('second', ts) AS ts, event_type AS event FROM events WHERE event_id % 11 <> 0")
def json_log(spark, d):
    good = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("event"), "value"))
    lines = views.table(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(good).alias("value"))
    return files.event_log(lines).select("ts", "event")


@query(
    "src11_run_reports",
    with_views("trades") + """, m AS (SELECT symbol AS run, count(*) AS n, avg(r_multiple) AS mean_r FROM trades GROUP BY 1) SELECT run, gate, passed, round(value, 6) AS value FROM (SELECT run, 'n' AS gate, n >= 200 AS passed, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT run, 'mean_r', mean_r > 0, mean_r FROM m)""",
)
def reports(spark, d):
    m = views.trades(spark, d).groupBy(F.col("symbol").alias("run")).agg(F.count("*").cast("double").alias("n"), F.avg("r_multiple").alias("mean_r"))
    checks = F.array(F.struct(F.lit("n").alias("gate"), (F.col("n") >= 200).alias("passed")), F.struct(F.lit("mean_r").alias("gate"), (F.col("mean_r") > 0).alias("passed")))
    report = F.to_json(F.struct("run", F.create_map(F.lit("n"), F.col("n"), F.lit("mean_r"), F.col("mean_r")).alias("metrics"), checks.alias("checks")))
    return files.run_reports(m.select(report.alias("value"))).withColumn("value", F.round("value", 6))


@query(
    "src11_text_reports",
    with_views("trades") + """, m AS (SELECT run_id, symbol, CAST(count(DISTINCT year(exit_time)) AS INT) AS folds, CAST(count(*) AS INT) AS n_oos, round(sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)), 2) AS pf, round(avg(lots), 2) AS wfe_median FROM trades GROUP BY 1, 2)
    SELECT CASE WHEN length(run_id) = 2 THEN 'rule_' || run_id END AS key, symbol, folds, n_oos, pf, wfe_median, CAST(n_oos >= 20 AS INT) + CAST(pf >= 1.3 AS INT) AS gates_passed, 2 AS gates_total, CASE WHEN pf >= 1.3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m""",
)
def text_reports(spark, d):
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    m = views.trades(spark, d).groupBy("run_id", "symbol").agg(F.count_distinct(F.year("exit_time")).alias("folds"), F.count("*").alias("n"), F.round(gain / loss, 2).alias("pf"), F.round(F.avg("lots"), 2).alias("wfe"))
    state = lambda c: F.when(c, F.lit("PASS")).otherwise("FAIL")
    text = F.format_string(
        "log\n=== WFA strategies.rule_%s.Rule / %s ===\nFolds: %s | OOS-Trades: %s | OOS-PF: %s | WFE-Median: %s | PF(2x): 1.1 | PF(3x): 1.0 | DSR: 0.5 | PBO: 0.25\n--- Gates (least) ---\n  [%s] trades\n  [%s] profit factor \nArtefakte: none\nERGEBNIS: %s\n",
        "run_id", "symbol", F.col("folds").cast("string"), F.col("n").cast("string"), F.col("pf").cast("string"), F.col("wfe").cast("string"), state(F.col("n") >= 20), state(F.col("pf") >= 1.3), state(F.col("pf") >= 1.3),
    )
    return files.text_reports(m.select(text.alias("value"))).select("key", "symbol", "folds", "n_oos", "pf", "wfe_median", "gates_passed", "gates_total", "verdict")


@query(
    "top05_catalog_order",
    with_views("trades") + """, r AS (SELECT run_id AS key, symbol, count(*) FILTER (WHERE pnl > 0) // 400 AS passed FROM trades GROUP BY 1, 2) SELECT key, symbol, nullif(passed, 0) AS passed FROM r ORDER BY nullif(passed, 0) DESC NULLS LAST, key, symbol""",
)
def catalog_order(spark, d):
    results = views.trades(spark, d).groupBy(F.col("run_id").alias("key"), "symbol").agg(F.nullif(F.floor(F.count_if(F.col("pnl") > 0) / 400), F.lit(0)).alias("passed"))
    return oplogs.catalog_order(results)


@query("top04_latest_diagnostic", f"WITH {_LINES} SELECT event_type AS symbol, arg_max(substr(value, strpos(value, '] ') + 2), (ts, event_id)) AS msg, max(ts) AS ts FROM lines GROUP BY 1")
def latest_diagnostic(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    lines = _log_lines(spark, d).withColumn("msg", F.regexp_extract("value", r"\] (.*)$", 1)).join(e, "event_id")
    return oplogs.latest_by(lines.withColumnRenamed("event_type", "symbol"), "symbol", "ts", "msg", "event_id")


@query("sca07_fill_price", with_views("ticks", "H1") + "SELECT symbol, ts, round(close + 0.01 * (20 * 2.0 / 2 + 3), 6) AS buy, round(close - 0.01 * (20 * 2.0 / 2 + 3), 6) AS sell FROM bars_h1")
def fill_price(spark, d):
    price = lambda side: F.round(trade.fill_price(F.col("close"), F.lit(side), F.lit(20), F.lit(0.01), 2.0, 3.0), 6)
    return views.bars(spark, d).select("symbol", "ts", price(1).alias("buy"), price(-1).alias("sell"))


@query("sca09_param_maps", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k' || CAST(event_id % 7 AS VARCHAR) ELSE 'base' END AS a, 'b1' AS b, CAST(1 + CAST(event_id % 2 = 0 AS INT) + 1 AS INT) AS n FROM events")
def param_maps(spark, d):
    base = F.create_map(F.lit("vp.enabled"), F.lit("base"), F.lit("stop.mult"), F.lit("b1"))
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("vp.enabled"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(7)).cast("string")), F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("vp.enabled"), F.lit("base")))
    merged = trade.merged_params(base, over)
    return views.table(spark, d, "events").select("event_id", F.try_element_at(merged, F.lit("vp.enabled")).alias("a"), F.try_element_at(merged, F.lit("stop.mult")).alias("b"), F.size(merged).alias("n"))


@query("sca10_as_flag", "SELECT event_id, event_id % 4 < 2 AS flag FROM events")
def as_flag(spark, d):
    text = F.element_at(F.array(*map(F.lit, (" ON", "true ", "off", "0"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    return views.table(spark, d, "events").select("event_id", trade.as_flag(text).alias("flag"))


@query("sca11_rule_key", "SELECT event_id, event_type AS key FROM events")
def rule_key(spark, d):
    return views.table(spark, d, "events").select("event_id", trade.rule_key(F.concat(F.lit("rules.live."), "event_type")).alias("key"))
