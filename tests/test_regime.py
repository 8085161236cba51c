"""The regime model against known regimes, and that it sees no future."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import regime

T0 = dt.datetime(2024, 1, 1)


def bars(spark, hours=24 * 60, seed=2):
    """Calm and wild spells of about five days; returns rows and which hours are wild."""
    rng = np.random.default_rng(seed)
    wild, rows, price = np.zeros(hours, bool), [], 100.0
    now = False
    for i in range(hours):
        now = now if rng.random() > 1 / 120 else not now
        wild[i] = now
        moves = rng.normal(0, 0.004 if now else 0.0005, 4)
        path = price * np.exp(np.cumsum(moves))
        rows.append(("X", T0 + dt.timedelta(hours=i), price, float(max(price, path.max())), float(min(price, path.min())), float(path[-1]), 1.0))
        price = float(path[-1])
    return rows, wild, spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double")


def test_known_regimes_and_no_future(spark):
    rows, wild, df = bars(spark)
    found = {r.ts: r for r in regime.two_state_regime(df, period_days=10, history=4, least=200).collect()}
    told = [(wild[int((t - T0).total_seconds() // 3600)], r) for t, r in found.items() if r.method == "model"]
    assert len(told) > 500
    assert np.mean([w == (r.regime == "high") for w, r in told]) > 0.85  # the deviation looks a day back
    cut = T0 + dt.timedelta(days=43, hours=7)
    short = {r.ts: r for r in regime.two_state_regime(df.where(df.ts <= cut), period_days=10, history=4, least=200).collect()}
    assert all(short[t].regime == found[t].regime and short[t].method == found[t].method for t in short)
    assert all(short[t].p_high == pytest.approx(found[t].p_high, abs=1e-6) for t in short if short[t].p_high is not None)


def test_hysteresis_goes_on_over_periods_and_fall_back(spark):
    _, _, df = bars(spark, 24 * 12)
    found = regime.two_state_regime(df, period_days=10, history=4, least=10_000).collect()
    assert {r.method for r in found} == {"adx"} and all(r.p_high is None for r in found)
    chance = np.array([0.5, 0.7, 0.5, 0.3, 0.5, np.nan])
    assert regime._regimes(chance, np.array([True] * 6), False, 0.6, 0.4) == (["low", "high", "high", "low", "low", "high"], False)
    assert regime._regimes(chance[:1], np.array([False]), True, 0.6, 0.4) == (["high"], True)


def test_fits_that_fail_are_told():
    rng = np.random.default_rng(1)
    assert regime.fit(rng.normal(size=(400, 3)))[1] in ("states do not last", "not converged", "a state is hardly taken")
    blocks = np.repeat(rng.random(20) < 0.5, 50)
    x = rng.normal(size=(1000, 3)) * np.where(blocks, 3.0, 0.5)[:, None]
    model, why = regime.fit(x)
    assert why == "ok" and model["cov"][1][0, 0] > model["cov"][0][0, 0]
