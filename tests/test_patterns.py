"""Row patterns, skip rules, carried state and segments against plain loops, for several chunk lengths."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import normal
from tidemark import registry
from tidemark.operators import chunks, joins, ledger, outcomes, patterns, profile, setups, validation

T0 = dt.datetime(2024, 1, 1)
LARGER = "/root/testdata/sf0.01"


def series(spark, n=300, seed=1, symbols=("A", "B")):
    rnd = random.Random(seed)
    rows = [(s, T0 + dt.timedelta(minutes=15 * i), i, rnd.randrange(6), rnd.random() < 0.4) for s in symbols for i in range(n)]
    return rows, spark.createDataFrame([(s, t, x, m if keep else None) for s, t, _, x, keep in rows for m in [x]], "symbol string, ts timestamp_ntz, x int, maybe int")


@pytest.mark.parametrize("chunk", [100_000, 17])
def test_match_takes_the_first_row_of_each_step(spark, chunk):
    rows, df = series(spark)
    steps = [patterns.Step("b", 4, lambda r, seen: r["x"] == 1), patterns.Step("c", 3, lambda r, seen: r["x"] > seen["start"]["x"])]
    want = set()
    for s in "AB":
        xs = [x for sym, _, _, x, _ in rows if sym == s]
        for i, x in enumerate(xs):
            b = next((j for j in range(i + 1, min(i + 5, len(xs))) if xs[j] == 1), None)
            c = None if b is None else next((j for j in range(b + 1, min(b + 4, len(xs))) if xs[j] > x), None)
            if x == 3 and c is not None:
                want.add((s, i + 1, b + 1, c + 1))
    found = patterns.match(df, F.col("x") == 3, steps, ["x"], chunk_rows=chunk)
    assert {(r.symbol, r.start.k, r.b.k, r.c.k) for r in found.collect()} == want and len(want) > 5
    every = patterns.match(df, F.col("x") == 3, steps, ["x"], chunk_rows=chunk, partial=True)
    assert every.count() == sum(x == 3 for *_, x, _ in rows)


@pytest.mark.parametrize("width", [5, 40, 10_000])
def test_unblocked_is_greedy(spark, width):
    rnd = random.Random(4)
    hits = []
    for s in ("A", "B", "dense"):
        at = 0
        for i in range(200):
            at += rnd.choice([0, 1, 1, 2, 30]) if s != "dense" else 1
            hits.append((s, at, at + rnd.choice([1, 3, 9]), i))
    want, free = set(), {}
    for s, a, f, i in sorted(hits, key=lambda h: (h[0], h[1], h[3])):
        if a >= free.get(s, -1):
            want.add((s, i))
            free[s] = f
    df = spark.createDataFrame(hits, "symbol string, a long, f long, i int")
    assert {(r.symbol, r.i) for r in patterns.unblocked(df, ["symbol"], "a", "f", ["i"], width).collect()} == want


@pytest.mark.parametrize("days", [1, 30])
def test_last_known(spark, days):
    rows, df = series(spark, 400, 2)
    for strict in (False, True):
        found = {(r.symbol, r.ts): r.last for r in chunks.last_known(df, {"last": "maybe"}, strict, days).collect()}
        for s in "AB":
            last = None
            for sym, t, _, x, keep in rows:
                if sym == s:
                    before, last = last, x if keep else last
                    assert found[s, t] == (before if strict else last)


@pytest.mark.parametrize("days", [1, 30])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_ahead(spark, days, strict):
    rnd = random.Random(9)
    times = lambda n: [(rnd.choice("AB"), T0 + dt.timedelta(hours=rnd.randrange(24 * 40))) for _ in range(n)]
    left, right = [(*x, i) for i, x in enumerate(times(80))], [(*x, i) for i, x in enumerate(dict.fromkeys(times(30)))]
    found = joins.asof(spark.createDataFrame(left, "symbol string, ts timestamp_ntz, i int"), spark.createDataFrame(right, "symbol string, at timestamp_ntz, j int"), "symbol", "ts", "at", ["j"], strict, days, ahead=True)
    for r in found.collect():
        later = [(t, j) for s, t, j in right if s == r.symbol and (t > r.ts if strict else t >= r.ts)]
        assert r.j == (min(later)[1] if later else None)


def _trades(spark, n=500, seed=3):
    rnd = random.Random(seed)
    rows = [("r" if i % 3 else "q", T0 + dt.timedelta(hours=5 * i), i, 1, 1, 1, 1.0, float(rnd.randint(-9, 9)), 1.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "run_id string, exit_time timestamp_ntz, l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, price double, pnl double, r_multiple double")


@pytest.mark.parametrize("days", [1, 7, 10_000])
def test_ledger_segments(spark, days):
    rows, df = _trades(spark)
    falls = {r.run_id: r.max_drawdown for r in ledger.drawdown(df, "run_id", slice_days=days).collect()}
    streaks = {r.run_id: r.losing_streak for r in ledger.losing_streak(df, "run_id", slice_days=days).collect()}
    for run in "qr":
        pnl = [r[7] for r in rows if r[0] == run]
        line = np.cumsum(pnl)
        assert falls[run] == (np.maximum.accumulate(line) - line).max()
        now = most = 0
        for p in pnl:
            now = now + 1 if p < 0 else 0
            most = max(most, now)
        assert streaks[run] == most


def test_permuted_ledgers_do_not_depend_on_pieces(spark):
    rows, df = _trades(spark)
    falls = [{(r.run_id, r.sim): round(r.fall, 6) for r in validation.permuted_falls(df, "run_id", 12, 7, 5, rows=n, bucket_rows=60).collect()} for n in (1_000_000, 40)]
    assert falls[0] == falls[1] and len(falls[0]) == 24
    pnl = np.array([r[7] for r in rows if r[0] == "q"])
    own = validation.bucket_of(0, len(pnl), -(-len(pnl) // 60), 4, 7)
    line = np.cumsum(np.concatenate([validation.shuffled(pnl[own == b], "q", 4, b, 7) for b in range(max(own) + 1)]))
    assert falls[0]["q", 4] == round(float((np.maximum.accumulate(line) - line).max()), 6)


# ---- rules ----------------------------------------------------------------------------------------------------------


def test_sweep_gap_limit_by_hand(spark):
    """New York winter time is UTC - 5: range 14:00-15:00, window from 15:00. A quiet hour, a sweep of its high, then a strong fall
    that leaves a gap."""
    bars = [(100, 100.4, 99.6, 100)] * 72  # five-minute bars up to 15:00
    bars[60] = (100, 100.2, 93.0, 100)  # 14:00: the range's low
    bars[66] = (100, 100.1, 98.5, 100)  # the last swing low before the window
    bars += [(100, 101, 99.9, 100.2), (100.2, 100.3, 98.0, 98.1), (98.1, 98.2, 97.0, 97.1), (97.1, 97.2, 96.9, 97)]
    at = [dt.datetime(2024, 1, 3, 9) + dt.timedelta(minutes=5 * i) for i in range(len(bars))]
    df = spark.createDataFrame([("X", t, *map(float, b), 1.0) for t, b in zip(at, bars, strict=True)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double")
    hits = setups.sweep_gap_limit(df).collect()  # the body is 2.1 with an ATR of about 1.1, the reward 2.6
    (r,) = hits
    assert (r.ts, r.direction) == (at[75], -1) and r.limit == pytest.approx((98.2 + 99.9) / 2)
    assert r.stop > 101 and r.target == pytest.approx(93.0)
    assert setups.sweep_gap_limit(df, min_rr=10.0).count() == 0
    assert setups.sweep_gap_limit(df, body_atr=5.0).count() == 0


@pytest.fixture(scope="module")
def duck_larger():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ("events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{LARGER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name, least", [("sig02_vwap_pullback", 3), ("sig03_sweep_gap_limit", 5), ("sig04_session_breakout", 20), ("sig04_retest_limit", 20), ("sig25_impulse_pullback", 20), ("out03_flat_exit", 60), ("out05_fine_resolution", 40)])
def test_rules_have_hits(spark, duck_larger, name, least):
    found = registry.queries()[name](spark, LARGER).toPandas()
    assert len(found) >= least
    assert normal(found) == normal(duck_larger.execute(registry.oracle_sql()[name]).df())
    if name == "out03_flat_exit":
        held = (found["exit_time"] - found["entry_ts"]).dt.total_seconds() / 3600
        assert {"force_flat", "force_flat_gap", "sl", "tp"} <= set(found["reason"]) and held.nunique() > 5
    if name == "out05_fine_resolution":
        assert {"sl", "tp"} == set(found["fine_reason"])


def test_flat_gap_closes_at_the_bar_before(spark):
    at = [dt.datetime(2024, 1, 5, 15), dt.datetime(2024, 1, 5, 16), dt.datetime(2024, 1, 7, 22)]  # Friday, then Sunday
    bars = spark.createDataFrame([("X", t, 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 1.0) for i, t in enumerate(at)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double")
    events = {r.ts: (r.reason, r.exit, r.exit_time) for r in outcomes.flat_events(bars, 60, 16, 50, friday_hour=12).collect()}
    assert events == {at[2]: ("force_flat_gap", 11.5, at[1] + dt.timedelta(hours=1))}


@pytest.mark.parametrize("block", [3, 16, 256])
def test_window_profiles_of_any_rows(spark, block):
    rnd = random.Random(block)
    bars = [("AB"[i % 2], i // 2 + 1, a, a + rnd.choice([0.0, 0.5, 3.0, 17.0]), float(rnd.randint(1, 9))) for i in range(160) for a in [rnd.uniform(0, 40)]]
    windows = [(s, i, a, a + n) for i, (s, a, n) in enumerate([("A", 1, 0), ("A", 1, 79), ("B", 16, 15), ("B", 17, 0), ("A", 5, 40), ("B", 31, 1), ("A", 80, 0)])]
    df = spark.createDataFrame(bars, "symbol string, k int, low double, high double, tick_volume double")
    found = {(r.id, r.bin): r.volume for r in profile.window_profiles(df, spark.createDataFrame(windows, "symbol string, id int, first int, last int"), 5.0, block).collect()}
    want = {}
    for s, i, a, b in windows:
        for sym, k, low, high, volume in bars:
            if sym == s and a <= k <= b:
                for bin_ in range(int(low // 5), int(high // 5) + 1):
                    share = max(0.0, min(high, 5 * bin_ + 5) - max(low, 5 * bin_)) / (high - low) if high > low else 1.0
                    want[i, bin_] = want.get((i, bin_), 0.0) + volume * share
    assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x], abs=1e-9) for x in want)
