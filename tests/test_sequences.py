"""Positions taken in sequence against one fold over the whole ledger."""

import datetime as dt
import random

import pandas as pd
import pytest

from tidemark.operators import outcomes

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("pause", [1, 3])
def test_segments_equal_one_fold(spark, most, pause):
    rnd = random.Random(most * 10 + pause)
    rows = []
    for key in ("a", "b"):
        at = T0
        for i in range(250):
            at += dt.timedelta(hours=rnd.choice([0, 1, 2, 5, 40]))
            rows.append((key, at, at + dt.timedelta(hours=rnd.choice([1, 3, 9, 30, 80])), rnd.choice([1, -1]), float(rnd.choice([-2, -1, 1]) + i / 1000)))
    df = spark.createDataFrame(rows, "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, direction int, pnl double").repartition(4)
    found = {(r.symbol, r.pnl) for r in outcomes.take_positions(df, "symbol", most, pause, 60).collect()}
    want, free = set(), set()
    for key in ("a", "b"):
        pdf = pd.DataFrame([r for r in rows if r[0] == key], columns=["symbol", "entry_time", "exit_time", "direction", "pnl"]).sort_values(["entry_time", "exit_time", "direction", "pnl"], kind="stable")
        shift = pd.Timedelta(minutes=60)
        pdf = pdf.assign(__day=(pdf["entry_time"] + shift).dt.date, __last=(pdf["exit_time"] + shift).dt.date)
        want |= {(key, p) for p in pdf["pnl"][outcomes._taken(pdf, most, pause, 0)[0]]}
        free |= {(key, p) for p in pdf["pnl"][outcomes._taken(pdf, most, 10_000, 0)[0]]}
    assert found == want and want != free  # the pause left some out
