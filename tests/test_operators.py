"""Hand values, invariances and edge cases of the market-data operators."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import time as clock
from tidemark.functions import trade
from tidemark.operators import bars as bar_ops
from tidemark.operators import indicators as ind
from tidemark.operators import chunks, joins, ledger, outcomes, profile, quality, rules, scan, validation
from tidemark.sources import files, views

T0 = dt.datetime(2024, 1, 2, 9)


def make_bars(spark, rows, minutes=60, symbol="X", start=T0):
    data = [(symbol, start + dt.timedelta(minutes=minutes * i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double")


def closes(spark, values, **more):
    return make_bars(spark, [(v, v + 1, v - 1, v, 100) for v in values], **more)


def test_ticks_to_bars_by_hand(spark):
    ticks = [("X", dt.datetime(2024, 1, 2, 10) + dt.timedelta(seconds=s), i, m) for i, (s, m) in enumerate([(0, 110.045), (60, 110.055), (120, 110.035), (300, 110.1), (600, 110.2)])]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, event_id long, mid double")
    assert bar_ops.ticks_to_bars(df, 1).count() == 5
    m5 = {r.ts.minute: r for r in bar_ops.ticks_to_bars(df, 5).collect()}
    assert sorted(m5) == [0, 5, 10]
    assert (m5[0].open, m5[0].high, m5[0].low, m5[0].close, m5[0].tick_volume) == (110.045, 110.055, 110.035, 110.035, 3)


def test_averages_by_hand(spark):
    df = closes(spark, [1, 2, 3, 4, 5])
    assert [r.x for r in df.select("ts", ind.sma(F.col("close"), 3).alias("x")).orderBy("ts").collect()] == [None, None, 2, 3, 4]
    assert [r.e for r in scan.ema(df, {"e": ("close", 3)}).orderBy("ts").collect()] == [None, None, 2.25, 3.125, 4.0625]
    assert [r.w for r in scan.wilder(df, {"w": ("close", 2)}).orderBy("ts").collect()] == [None, 1.5, 2.25, 3.125, 4.0625]


@pytest.mark.parametrize("days", [1, 3, 7, 10_000])
def test_scan_does_not_depend_on_chunks(spark, days):
    rng = np.random.default_rng(1)
    df = closes(spark, 100 + np.cumsum(rng.normal(size=500)), minutes=240)
    whole = scan.adx(scan.rsi(scan.ema(df, {"e": ("close", 20)}, 100_000), chunk_days=100_000), chunk_days=100_000).orderBy("ts").collect()
    cut = scan.adx(scan.rsi(scan.ema(df, {"e": ("close", 20)}, days), chunk_days=days), chunk_days=days).orderBy("ts").collect()
    for a, b in zip(whole, cut, strict=True):
        for name in ("e", "rsi", "adx", "plus_di"):
            assert (a[name] is None) == (b[name] is None)
            assert a[name] is None or math.isclose(a[name], b[name], rel_tol=1e-9)


def test_scan_keeps_state_over_nulls(spark):
    df = closes(spark, [1, 2, 3, 4]).withColumn("x", F.when(F.col("close") != 3, F.col("close")))
    assert [r.e for r in scan.affine_scan(df, {"e": scan.Recurrence("x", 0.5, 0.5)}).orderBy("ts").collect()] == [1.0, 1.5, None, 2.75]


def test_values_of_a_prefix_do_not_change(spark, sf):
    bars = views.bars(spark, sf).drop("tf")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")

    def table(df):
        out = ind.candle_shape(ind.vwap_bands(scan.atr(df), "America/New_York", 2.0))
        return out.withColumns({"sma": ind.sma(F.col("close"), 10), "upper20": ind.donchian(20)[0], "rank": ind.rolling_rank("close", 30)})

    rounded = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])
    a, b = rounded(table(bars.where(F.col("ts") <= cut))), rounded(table(bars).where(F.col("ts") <= cut))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_first_touch_by_hand(spark):
    bars = outcomes.numbered(make_bars(spark, [(100, 101, 99, 100, 1), (100, 105, 98, 104, 1), (104, 112, 103, 111, 1), (120, 121, 119, 120, 1), (80, 81, 79, 80, 1), (80, 95, 70, 90, 1)]))
    signal = "symbol string, ts timestamp_ntz, k int, direction int, stop double, target double"
    at = lambda i: T0 + dt.timedelta(hours=i)
    found = {r.k: r for r in outcomes.first_touch(spark.createDataFrame([("X", at(0), 1, 1, 90.0, 110.0), ("X", at(1), 2, 1, 90.0, 115.0), ("X", at(2), 3, -1, 125.0, 90.0), ("X", at(3), 4, 1, 75.0, 92.0), ("X", at(5), 6, 1, 1.0, 2.0)], signal), bars, 3, 60).collect()}
    assert (found[1].reason, found[1].exit, found[1].bars_held, found[1].r_multiple) == ("tp", 110.0, 2, 1.0)
    assert (found[2].reason, found[2].exit) == ("tp_gap", 120.0)
    assert (found[3].reason, found[3].exit) == ("tp_gap", 80.0)
    assert (found[4].reason, found[4].exit) == ("sl", 75.0)  # stop before target inside a bar
    assert 6 not in found


def test_trailing_and_break_even(spark):
    bars = outcomes.numbered(make_bars(spark, [(100, 100, 100, 100, 1), (100, 110, 99, 110, 1), (110, 111, 104, 105, 1), (105, 106, 90, 91, 1)]))
    signals = spark.createDataFrame([("X", T0, 1, 1, 95.0, 200.0, 3.0)], "symbol string, ts timestamp_ntz, k int, direction int, stop double, target double, atr double")
    trailed = outcomes.trailing_exit(signals, bars, 3, 2.0).first()
    assert (trailed.exit, trailed.bars_held) == (104.0, 2)
    even = outcomes.trailing_exit(signals, bars, 3, 10.0, 1.0).first()
    assert (even.exit, even.bars_held) == (100.0, 3)


def test_sequence_and_limits(spark):
    rows = [("X", 1, T0 + dt.timedelta(hours=a), T0 + dt.timedelta(hours=b), p) for a, b, p in [(0, 4, 1.0), (1, 2, 1.0), (4, 5, -1.0), (5, 6, -1.0), (6, 7, 1.0), (8, 9, 1.0)]]
    trades = spark.createDataFrame(rows, "symbol string, direction int, entry_time timestamp_ntz, exit_time timestamp_ntz, pnl double")
    assert outcomes.sequence_positions(trades, ["symbol"]).count() == 5
    assert outcomes.sequence_positions(trades, ["symbol"], most=2).count() == 6
    assert outcomes.sequence_positions(trades, ["symbol"], pause_after=2, pause_trades=1).count() == 4


def _ledger(spark, pnls, directions=None):
    rows = [("r", "X", T0 + dt.timedelta(days=i), T0 + dt.timedelta(days=i, hours=4), (directions or [1] * len(pnls))[i], float(p), float(p) / 50, i, 1, 1, 1, 1.0) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "run_id string, symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, direction int, pnl double, r_multiple double, l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, price double")


def test_ledger_by_hand(spark):
    four = _ledger(spark, [100, -50, 200, -100], [1, 1, -1, -1])
    row = four.agg(*ledger.summary()).first()
    assert (row.n, row.profit_factor, row.total_pnl) == (4, 2.0, 150.0)
    assert {r.direction: r.profit_factor for r in ledger.by_groups(four).where("direction IS NOT NULL").collect()} == {1: 2.0, -1: 2.0}
    assert ledger.drawdown(four, "run_id").first().max_drawdown == 100.0
    assert ledger.losing_streak(_ledger(spark, [-1, -2, 0, -3]), "run_id").first().losing_streak == 2
    assert ledger.losing_streak(_ledger(spark, [1, 2]), "run_id").first().losing_streak == 0
    assert ledger.drawdown(_ledger(spark, [-5, -5]), "run_id").first().max_drawdown == 5.0  # the peak is the first point
    assert _ledger(spark, [1.0]).agg(*ledger.summary()).first().profit_factor == math.inf


def test_resampling_invariants(spark):
    wins = _ledger(spark, [10.0] * 50)
    assert validation.resample_drawdown(wins, "run_id", 50).first().worst == 0
    limits = validation.loss_limit_resample(wins, "run_id", 1000.0, 0.05, 0.1, 0.1, 60, 50).first()
    assert (limits.p_daily, limits.p_overall, limits.p_reached) == (0.0, 0.0, 1.0)
    losers = validation.loss_limit_resample(_ledger(spark, [-60.0] * 20), "run_id", 1000.0, 0.05, 0.1, 0.1, 60, 50).first()
    assert (losers.p_daily, losers.p_overall, losers.p_reached) == (1.0, 1.0, 0.0)
    mixed = _ledger(spark, [10, -9, 8, -12, 30, -4, 2, -7] * 5)
    a, b = (validation.resample_drawdown(mixed, "run_id", 100, per_task=n).first() for n in (7, 100))
    assert a == b and a.p50 <= a.p95 <= a.p99 <= a.worst
    assert validation.block_bootstrap(mixed, "run_id", 50).first().total_p5 <= validation.block_bootstrap(mixed, "run_id", 50).first().total_p95


def test_overfitting_and_deflated_sharpe(spark):
    rng = np.random.default_rng(3)
    good = [(t, c, float(rng.normal() + (5 if c == 2 else 0))) for t in range(64) for c in range(6)]
    assert validation.overfitting_probability(spark.createDataFrame(good, "t int, combo int, value double")).first().pbo == 0.0
    flipped = [(t, c, float(rng.normal() * 0.1 + (1 if (c % 2 == 0) == (t < 32) else -1))) for t in range(64) for c in range(4)]
    assert validation.overfitting_probability(spark.createDataFrame(flipped, "t int, combo int, value double")).first().pbo > 0.3
    returns = spark.createDataFrame([("a", float(x)) for x in rng.normal(0.2, 1, 200)] + [("b", 1.0), ("b", 1.0)], "k string, x double")
    few, many = ({r.k: r.dsr for r in validation.deflated_sharpe(returns, "k", "x", n).collect()} for n in (2, 500))
    assert 0 <= many["a"] < few["a"] <= 1 and few["b"] == 0


def test_plateau_avoids_the_spike(spark):
    pf = {(1, 1): 5.0, (2, 2): 2.0, (2, 1): 0.5, (1, 2): 0.5, (3, 3): 1.5, (2, 3): 1.6, (3, 2): 1.7, (1, 3): 1.2, (3, 1): 1.2}
    cells = spark.createDataFrame([(0, i, a, b, v) for i, ((a, b), v) in enumerate(pf.items())], "fold int, combo int, a int, b int, pf double")
    # Neighbours differ in one level: (2, 2) has two good ones of four, (3, 2) three of three.
    assert tuple(validation.plateau(cells, 0.6).first())[1:] == (6, 1.7, 1.0)
    assert validation.plateau(spark.createDataFrame([(0, 7, 1, 1, 3.0), (0, 8, 2, 2, float("inf")), (0, 9, 3, 3, 0.5)], cells.schema)).first().combo == 7


def test_deflated_sharpe_by_hand(spark):
    """Against the formula written out in plain Python."""
    x = [0.3, -0.1, 0.4, 0.2, -0.2, 0.5, 0.1, 0.0, 0.35, -0.05]
    n, mean = len(x), sum(x) / len(x)
    m2, m3, m4 = (sum((v - mean) ** k for v in x) / n for k in (2, 3, 4))
    sr = mean / math.sqrt(m2 * n / (n - 1))
    var = (1 - m3 / m2**1.5 * sr + (m4 / m2**2 - 1) / 4 * sr * sr) / (n - 1)
    z = lambda p: NormalDist().inv_cdf(p)
    star = math.sqrt(var) * ((1 - 0.5772156649015329) * z(1 - 1 / 50) + 0.5772156649015329 * z(1 - 1 / (50 * math.e)))
    want = NormalDist().cdf((sr - star) / math.sqrt(var))
    got = validation.deflated_sharpe(spark.createDataFrame([("a", v) for v in x], "k string, x double"), "k", "x", 50).first().dsr
    assert got == round(want, 6) and 0.1 < got < 0.9


def test_cooldown_counts_from_the_last_accepted(spark):
    minutes = [0, 60, 120, 180, 200, 370, 380, 1000]
    hits = spark.createDataFrame([("r", "X", T0 + dt.timedelta(minutes=m), 1, 180) for m in minutes] + [("r", "X", T0, -1, 180)], "rule string, symbol string, ts timestamp_ntz, direction int, rest long")
    found = sorted((round((r.ts - T0).total_seconds() / 60), r.direction) for r in rules.cooled(hits).collect())
    assert found == [(0, 1), (180, 1), (370, 1), (1000, 1)]


def test_mean_reversion_fires_on_leaving_the_band(spark):
    """Down through 30 above the long mean is a long, up through 70 below it a short; not the way back."""
    row = {"adx": 10.0, "atr": 1.0, "atr_median": 2.0, "close": 10.0, "symbol": "X", "k": 1}
    cases = [(31.0, 29.0, 9.0), (29.0, 31.0, 9.0), (69.0, 71.0, 11.0), (71.0, 69.0, 11.0), (31.0, 29.0, 11.0)]
    table = spark.createDataFrame([row | {"ts": T0 + dt.timedelta(hours=i), "rsi_before": a, "rsi": b, "ema200": e} for i, (a, b, e) in enumerate(cases)])
    found = sorted((r.ts.hour - T0.hour, r.direction, r.stop, r.target) for r in rules.signals(table, [rules.RULES["sig05"]]).collect())
    assert found == [(0, 1, 8.0, 14.0), (2, -1, 12.0, 6.0)]


def test_profile_by_hand(spark):
    bars = make_bars(spark, [(0, 10, 0, 5, 100), (4, 6, 4, 5, 50), (5, 5, 5, 5, 10)])
    volumes = profile.bins(bars, ["symbol"], 5.0)
    assert {r.bin: r.volume for r in volumes.collect()} == {0: 75.0, 1: 85.0, 2: 0.0}
    assert profile.poc(volumes, ["symbol"], 5.0).first().poc == 7.5
    area = profile.value_area(volumes, ["symbol"], 5.0).first()
    assert (area.va_low, area.va_high) == (0.0, 10.0)


def test_daylight_saving(spark):
    df = spark.createDataFrame([("03-12-2025", "8:30am"), ("01-15-2025", "8:30am"), ("03-12-2025", "All Day"), ("03-12-2025", "Tentative")], "d string, t string")
    got = [r.x for r in df.select(clock.calendar_time(F.col("d"), F.col("t")).alias("x")).collect()]
    assert got == [dt.datetime(2025, 3, 12, 12, 30), dt.datetime(2025, 1, 15, 13, 30), None, None]


def test_gap_audit(spark):
    monday = dt.datetime(2024, 1, 1)
    times = [monday + dt.timedelta(minutes=5 * i) for i in range(5 * 288) if monday + dt.timedelta(minutes=5 * i) < dt.datetime(2024, 1, 5, 21)]
    times = [t for t in times if not (t.day == 3 and t.hour == 12)] + [dt.datetime(2024, 1, 7, 21)]
    df = spark.createDataFrame([("X", t) for t in times], "symbol string, ts timestamp_ntz")
    (gap,) = quality.gaps(df, 5).collect()
    assert (gap.first, gap.last, gap.n) == (dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 3, 12, 55), 12)


def test_merge_last_wins(spark):
    a, b = closes(spark, [100] * 10, minutes=5, start=dt.datetime(2024, 1, 1)), closes(spark, [200] * 10, minutes=5, start=dt.datetime(2024, 1, 1, 0, 25))
    merged = {r.ts: r.close for r in quality.merge(a, b).collect()}
    assert len(merged) == 15 and merged[dt.datetime(2024, 1, 1, 0, 25)] == 200.0
    with pytest.raises(ValueError):
        quality.validate(a.drop("open"), "ts")


def test_tick_files(spark, tmp_path):
    records = np.array([(0, 110050, 110040, 1, 1), (60_000, 110060, 110050, 1, 1)], files.TICK_RECORD)
    folder = tmp_path / "XAU" / "2024" / "01" / "02"
    folder.mkdir(parents=True)
    (folder / "10h_ticks.bin").write_bytes(records.tobytes())
    rows = files.read_tick_files(spark, str(tmp_path), 1000.0).orderBy("ts").collect()
    assert [(r.symbol, r.ts, round(r.mid, 3)) for r in rows] == [("XAU", dt.datetime(2024, 1, 2, 10), 110.045), ("XAU", dt.datetime(2024, 1, 2, 10, 1), 110.055)]


def test_bar_files_round_trip(spark, tmp_path):
    bars = closes(spark, [1, 2, 3]).withColumn("tf", F.lit("H1"))
    files.write_bars(bars, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    bars.drop("symbol", "tf").coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    part = next((tmp_path / "csv").glob("part*"))
    (tmp_path / "EURUSD_H1.csv").write_bytes(part.read_bytes())
    rows = files.read_bars(spark, str(tmp_path / "EURUSD_H1.csv"), "csv").collect()
    assert {(r.symbol, r.tf) for r in rows} == {("EURUSD", "H1")} and len(rows) == 3


def test_journal_and_calendar_files(spark, tmp_path):
    (tmp_path / "j.csv").write_text("﻿zeit;ereignis;ticket\n2024-01-01;OPEN;1\n;CLOSE;1\n", encoding="utf-8")
    assert files.read_journal(spark, str(tmp_path / "j.csv")).count() == 1
    (tmp_path / "c.csv").write_text("time_utc,currency,impact,title,fetched_at\n2024-01-01 10:00:00,usd,High,CPI,x\nbad,eur,Low,y,x\n")
    rows = files.read_calendar(spark, str(tmp_path / "c.csv")).collect()
    assert sorted((str(r.time_utc), r.currency) for r in rows) == [("2024-01-01 10:00:00", "USD"), ("None", "EUR")]


def test_position_size_and_flags(spark):
    one = spark.range(1).select(
        trade.lots(F.lit(100.0), F.lit(2.0), F.lit(10.0), 0.01, 0.01, 50.0).alias("a"), trade.lots(F.lit(100.0), F.lit(0.0), F.lit(10.0), 0.01, 0.01, 50.0).alias("b"), trade.as_flag(F.lit(" On ")).alias("c")
    ).first()
    assert (one.a, one.c) == (5.0, True)


def test_sessions_wrap_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, h),) for h in range(24)], "ts timestamp_ntz")
    hours = lambda a, b: {r.ts.hour for r in df.where(clock.in_session(F.col("ts"), a * 60, b * 60)).collect()}
    assert hours(22, 2) == {22, 23, 0, 1} and hours(7, 9) == {7, 8} and hours(5, 5) == set(range(24))


@pytest.mark.parametrize("rows_per_chunk", [7, 50, 100_000])
def test_chunked_windows_equal_plain_ones(spark, rows_per_chunk):
    rng = np.random.default_rng(2)
    df = closes(spark, 100 + np.cumsum(rng.normal(size=400)), minutes=240).unionByName(closes(spark, rng.normal(size=90), minutes=60, symbol="Y"))

    def table(bars):
        return ind.swings(bars.withColumns({"sma": F.round(ind.sma(F.col("close"), 10), 8), "rank": ind.rolling_rank("close", 30), "top": ind.donchian(20)[0]}), 3, 3)

    plain = sorted(map(tuple, table(df).select("symbol", "ts", "sma", "rank", "top", "swing_high", "confirmed_at").collect()), key=str)
    cut = chunks.chunked(df, table, before=29, after=3, chunk_rows=rows_per_chunk, slice_days=4)
    assert sorted(map(tuple, cut.select("symbol", "ts", "sma", "rank", "top", "swing_high", "confirmed_at").collect()), key=str) == plain
    numbers = {(r.symbol, r.ts): r.k for r in chunks.row_numbers(df, slice_days=3).collect()}
    assert all(sorted(k for (s, _), k in numbers.items() if s == name) == list(range(1, n + 1)) for name, n in (("X", 400), ("Y", 90)))


@pytest.mark.parametrize("days", [1, 7, 10_000])
def test_asof_does_not_depend_on_slices(spark, days):
    rng = np.random.default_rng(8)
    at = lambda n, step: [T0 + dt.timedelta(hours=int(h)) for h in rng.choice(n * step, n, replace=False)]
    right = [(k, t, i) for k in ("X", "Y", None) for i, t in enumerate(at(40, 30))]
    left = [(k, t) for k in ("X", "Y", "Z", None) for t in [*at(60, 25), right[0][1]]] + [("X", None)]
    rows = joins.asof(spark.createDataFrame(left, "k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, v int"), "k", "t", "u", ["v"], strict=days == 7, slice_days=days)
    before = (lambda u, t: u < t) if days == 7 else (lambda u, t: u <= t)
    want = [(k, t, max(((u, v) for q, u, v in right if q == k and t is not None and before(u, t)), default=(None, None))[1]) for k, t in left]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)


def test_currencies(spark):
    names = ["eurusd.r", "XAUUSD", "btc", "france", "AAABBB", "GBPGBP", "us30", "", None]
    found = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, s string").select("i", trade.currencies(F.col("s")).alias("c")).orderBy("i").collect()
    assert [r.c for r in found] == [["EUR", "USD"], ["USD"], ["USD"], ["FRA", "NCE"], ["AAA", "BBB"], ["GBP"], [], [], []]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_running_sums_do_not_depend_on_chunks(spark, rows):
    values = [None if k % 5 == 0 else float(k) for k in range(1, 21)]
    df = spark.createDataFrame([(s, k + 1, v) for s in "ab" for k, v in enumerate(values)], "symbol string, k long, v double")
    got = {(r.symbol, r.k): r.v for r in chunks.running_sums(df, ["v"], rows).collect()}
    assert all(got[s, k] == sum(v or 0 for v in values[:k]) for s in "ab" for k in range(1, 21)) and len(got) == 40


@pytest.mark.parametrize("rows", [2, 1000])
def test_equity_by_hand(spark, rows):
    """A long trade from bar 2 (open 10) to bar 4 (exit 14) and a short one on bar 3 alone (12 to 13)."""
    bars = spark.createDataFrame([("a", k, c) for k, c in enumerate((9.0, 11.0, 12.5, 14.0, 20.0), 1)], "symbol string, k long, close double")
    bars = bars.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 20:00:00' + make_dt_interval(0, cast(k as int))"))
    trades = spark.createDataFrame([("a", 1, 3, 1, 10.0, 14.0), ("a", 2, 1, -1, 12.0, 13.0)], "symbol string, k long, bars_held long, direction int, entry double, exit double")
    curve = ledger.equity_curve(trades, bars, 10.0, 60, chunk_rows=rows)
    assert [(r.balance, r.equity) for r in curve.orderBy("k").collect()] == [(10, 10), (10, 11), (9, 11.5), (13, 13), (13, 13)]
    # closes at 22, 23 | 0, 1, 2 o'clock; the second day opens at 10
    days = ledger.loss_limit_days(curve.withColumn("equity", F.col("equity") - F.when(F.col("k") == 3, 2.5).otherwise(0.0)), 10.0, 0.1, 0.5).orderBy("day").collect()
    assert [(r.opening, r.daily_at and r.daily_at.hour, r.overall_at, r.breached) for r in days] == [(10, None, None, False), (10, 0, None, True)]


def test_text_reports(spark):
    whole = "x\n=== WFA strategies.s1_x.Y / EURUSD ===\nFolds: 3 | OOS-Trades: 12 | OOS-PF: 1.5 | WFE-Median: 0.6 | PF(2x): 1.2 | PF(3x): 1.1 | DSR: 0.9 | PBO: 0.1\n--- Gates ---\n [PASS] a b \n[FAIL] c\nArtefakte: -\nERGEBNIS: no\n"
    short = "=== WFA s2 / GBPUSD ===\nnothing else"
    found = {r.key: r for r in files.text_reports(spark.createDataFrame([(whole,), (short,), ("no header",), ("",), (None,)], "value string")).collect()}
    assert set(found) == {"s1_x", "s2"}
    r = found["s1_x"]
    assert (r.symbol, r.folds, r.n_oos, r.pf, r.wfe_median, r.pf2x, r.pf3x, r.dsr, r.pbo) == ("EURUSD", 3, 12, 1.5, 0.6, 1.2, 1.1, 0.9, 0.1)
    assert [tuple(g) for g in r.gates] == [("a b", True), ("c", False)] and (r.gates_passed, r.gates_total, r.verdict) == (1, 2, "no")
    r = found["s2"]
    assert (r.symbol, r.folds, r.pbo, r.gates, r.gates_total, r.verdict) == ("GBPUSD", None, None, [], 0, None)
