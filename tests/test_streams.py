"""Stream parts that a batch can drive: the blackout gate, and sinks that take a batch twice."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tidemark.plans import streams
from tidemark.sources import views
from tidemark.streaming import jobs, sinks

T0 = dt.datetime(2024, 1, 1, 10)


def test_blackout_fails_closed_on_an_empty_calendar(spark):
    rows = spark.createDataFrame([("a", T0), ("b", T0 + dt.timedelta(hours=3))], "symbol string, ts timestamp")
    calendar = spark.createDataFrame([(T0 + dt.timedelta(minutes=5),), (None,)], "time_utc timestamp")
    assert {r.symbol: r.blackout for r in jobs.with_blackout(rows, calendar).collect()} == {"a": True, "b": False}
    for empty in (calendar.where("false"), calendar.where("time_utc IS NULL")):
        found = jobs.with_blackout(rows, empty)
        assert found.columns == ["symbol", "ts", "blackout"] and all(r.blackout for r in found.collect())


def test_batches_replace_what_they_wrote(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, open double"
    hours = lambda day, n, price: [("X", T0.replace(hour=0) + dt.timedelta(days=day, hours=h), price) for h in range(n)]
    write = sinks.signals_and_bars(f"{tmp_path}/s", f"{tmp_path}/b", 20, lambda b: b.select("symbol", F.col("ts").cast("timestamp").alias("ts")), lambda b: b)
    first, second = spark.createDataFrame(hours(0, 24, 1.0) + hours(1, 5, 1.0), schema), spark.createDataFrame(hours(1, 24, 2.0), schema)
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, number)
    signals = spark.read.json(f"{tmp_path}/s")
    assert {r["batch"]: r["count"] for r in signals.groupBy("batch").count().collect()} == {0: 29, 1: 24}
    bars = spark.read.parquet(f"{tmp_path}/b").groupBy("day", "open").count().collect()
    assert sorted((str(r.day), r.open, r["count"]) for r in bars) == [("2024-01-01", 1.0, 24), ("2024-01-02", 2.0, 24)]  # five hours of a day are no day


def test_pairing_holds_no_state_after_its_batch(spark, sf, monkeypatch):
    """One batch, not an empty one over all state after it; nothing of it stays in memory; tasks of bounded state; settings as before."""
    started, start, names = [], DataStreamWriter.start, ("spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.streaming.maxBatchesToRetainInMemory", "spark.sql.shuffle.partitions")
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(start(self, *a, **k)) or started[-1])
    monkeypatch.setattr(streams, "STATE_ROWS", 1000, raising=False)
    before = [spark.conf.get(n, None) for n in names]
    got = streams.pairing(spark, sf).select("ticket", "open_time", "close_time", "profit").collect()
    assert [spark.conf.get(n, None) for n in names] == before
    progress = [p for p in started[0].recentProgress if p.stateOperators]
    assert [p.batchId for p in progress] == [0]
    state, rows = progress[0].stateOperators[0], spark.read.parquet(f"{sf}/orders.parquet").count() + spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert state.numRowsTotal == rows and state.numShufflePartitions == max(4, -(-rows // 1000))
    assert state.memoryUsedBytes < 20 * rows
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    days = (F.col("l_shipdate").cast("timestamp").cast("long") - F.col("o_orderdate").cast("timestamp").cast("long")) / 86400
    want = orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & days.between(0, 30)).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz"), F.col("l_shipdate").cast("timestamp_ntz"), F.col("l_extendedprice").cast("double"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and got


def test_indicators_over_batches(spark, sf, tmp_path):
    """States go from batch to batch, a batch that comes twice counts once, and no task has all bars of a symbol at once."""
    ticks = views.ticks(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("mid").alias("high"), F.col("mid").alias("low"), F.col("mid").alias("close"), F.sqrt(1.0 + F.col("event_id") % 7).alias("tick_volume"))
    found = []
    for cuts in ((), ("2024-01-03", "2024-01-03 13:00:00", "2024-01-17")):
        edges = ["1970-01-01", *cuts, "2100-01-01"]
        write = sinks.rows_and_states(f"{tmp_path}/{len(cuts)}", lambda batch, states: jobs.running_indicators(batch, states, order=("ts", "event_id")))
        for number, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
            batch = ticks.where(f"ts >= '{start}' AND ts < '{end}'").orderBy(F.hash("event_id"))
            write(batch, number)
            if number % 2:
                write(batch, number)
        rows = spark.read.parquet(f"{tmp_path}/{len(cuts)}").where("kind = 'row'").select("symbol", "ts", F.round("vwap", 8), F.round("rsi", 8)).collect()
        found.append(sorted(map(str, rows)))
    assert found[0] == found[1] and len(found[0]) == ticks.count()
    plan = jobs.running_indicators(ticks, None)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMap" not in plan and "Sort [symbol" in plan
