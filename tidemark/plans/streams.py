"""Queries that run a stream to its end over the given tables and return what it wrote.

The stream reads the Parquet table, with a far watermark, and writes to Parquet in the shared checkpoint folder; what it
emits equals the batch result except for windows that the end of the input leaves open.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import ticks_to_bars
from tidemark.plans import sqltext
from tidemark.registry import query
from tidemark.sources import views
from tidemark.sources.views import bars_sql
from tidemark.streaming import jobs, sinks

#: Rows that a task of a stream-stream join holds as state, about 300 bytes each.
STATE_ROWS = 1_000_000
_LAST = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("mid"))


def _finished(spark: SparkSession, stream: DataFrame, sink: str = "parquet") -> DataFrame:
    """Rows of a stream that reads all there is and stops; sink is a file format."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    more = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"} if sink == "json" else {}
    folder = f"{shared}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format(sink).options(**more).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.format(sink).options(**more).schema(stream.schema).load(f"{folder}/out")


@contextlib.contextmanager
def _one_batch(spark: SparkSession, rows: int):
    """Settings of streams that start inside and write all they have in the batch that reads it.

    No empty batch follows, which would pass over all state again; a task's state leaves memory when it is written, not kept for
    later batches; `rows` of state are dealt to so many tasks that each holds STATE_ROWS at most, on average.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // STATE_ROWS))
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.maxBatchesToRetainInMemory": "0", "spark.sql.shuffle.partitions": str(tasks)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _naive(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema.fields])


@query("str01_stream_bars", views.with_views("ticks", "H1") + f"SELECT * FROM bars_h1 WHERE ts + INTERVAL 60 MINUTE <= {_LAST}")
def stream_bars(spark, d):
    return _naive(_finished(spark, jobs.bars(_ticks(spark, d), 60)))


@query(
    "str02_sliding_stats",
    views.with_views("ticks")
    + f"""SELECT symbol, start, round(avg(mid), 6) AS mean, round(stddev_samp(mid), 6) AS spread, count(*) AS n FROM (SELECT symbol, mid, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM ticks)
    WHERE start + INTERVAL 60 MINUTE <= {_LAST} GROUP BY 1, 2""",
)
def sliding(spark, d):
    return _naive(_finished(spark, jobs.sliding_stats(_ticks(spark, d), 60, 30))).withColumns({"mean": F.round("mean", 6), "spread": F.round("spread", 6)})


@query(
    "str03_activity_sessions",
    views.with_views("ticks")
    + f""", g AS (SELECT symbol, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY symbol, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_LAST}""",
)
def sessions(spark, d):
    return _naive(_finished(spark, jobs.activity_sessions(_ticks(spark, d), 30)))


_FRESH = "SELECT DISTINCT event_type AS symbol, ts, CAST(user_id % 2 AS INT) AS direction, 'tick' AS type FROM events"


def _fresh(spark, d):
    events = _stream(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.pmod("user_id", F.lit(2)).cast("int").alias("direction"), F.lit("tick").alias("type"))
    doubled = events.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    return jobs.fresh_signals(doubled)


@query("str05_fresh_signals", _FRESH)
def fresh(spark, d):
    return _naive(_finished(spark, _fresh(spark, d)))


@query("str10_signals_json", _FRESH)
def signals_json(spark, d):
    return _naive(_finished(spark, _fresh(spark, d), "json"))


def _batched(spark, d):
    """Signals and hourly bars of the events table, written by foreachBatch; the last batch is delivered twice."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    folder = f"{shared}/batches-{uuid.uuid4().hex}"
    signals = lambda b: b.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.pmod("user_id", F.lit(2)).cast("int").alias("direction"))
    bars = lambda b: ticks_to_bars(b.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.col("value").alias("mid")), 60)
    write = sinks.signals_and_bars(f"{folder}/signals", f"{folder}/bars", 20, signals, bars)

    def twice(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)

    _stream(spark, d, "events").writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder


@query("str10_batch_signals", "SELECT event_type AS symbol, ts, CAST(user_id % 2 AS INT) AS direction FROM events")
def batch_signals(spark, d):
    """Every signal once, though a batch came twice."""
    read = spark.read.schema("symbol string, ts timestamp, direction int, batch long").option("timestampFormat", sinks.JSON_TIME).json(f"{_batched(spark, d)}/signals")
    return _naive(read.select("symbol", "ts", "direction"))


@query(
    "snk03_batch_bars",
    views.with_views("ticks", "H1") + ", n AS (SELECT symbol, CAST(ts AS DATE) AS day FROM bars_h1 GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) >= 20) SELECT b.symbol, b.ts, open, high, low, close FROM bars_h1 b JOIN n ON b.symbol = n.symbol AND CAST(b.ts AS DATE) = n.day",
)
def batch_bars(spark, d):
    """Whole days only, each once; all rows come in one batch here, so no day is cut."""
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double, day date"
    return spark.read.schema(schema).parquet(f"{_batched(spark, d)}/bars").select("symbol", "ts", "open", "high", "low", "close")


@query(
    "str06_stream_blackout",
    views.with_views("ticks", "calendar") + "SELECT symbol, event_id, EXISTS (SELECT 1 FROM calendar c WHERE c.impact = 'High' AND t.ts BETWEEN c.time_utc - INTERVAL 15 MINUTE AND c.time_utc + INTERVAL 10 MINUTE) AS blackout FROM ticks t",
)
def stream_blackout(spark, d):
    calendar = views.calendar(spark, d).where("impact = 'High'").select(F.col("time_utc").cast("timestamp").alias("time_utc"))
    return _finished(spark, jobs.with_blackout(_ticks(spark, d).select("symbol", "event_id", "ts"), calendar)).select("symbol", "event_id", "blackout")


@query("str09_day_loss", f"WITH ticks AS (SELECT ts FROM events) SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS day, round(sum(value - 130), 4) AS net, count(*) AS n, round(sum(value - 130), 4) <= -1000 AS breached FROM events GROUP BY 1 HAVING date_trunc('day', CAST(max(ts) AS TIMESTAMP)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM ticks)")
def stream_day_loss(spark, d):
    deals = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") - 130).alias("profit"))
    return _naive(_finished(spark, jobs.day_loss(deals, 1000.0))).withColumn("net", F.round("net", 4))


@query(
    "str04_running_indicators",
    sqltext.with_bars(sqltext.rsi(14)).replace(bars_sql("H1", "b"), "b AS (SELECT symbol, {'ts': ts, 'id': event_id} AS ts, mid AS high, mid AS low, mid AS close, sqrt(1.0 + event_id % 7) AS tick_volume FROM ticks)")
    + "SELECT b.symbol, b.ts.ts AS ts, round(sum(close * tick_volume) OVER w / sum(tick_volume) OVER w, 6) AS vwap, round(r.y, 6) AS rsi FROM b LEFT JOIN rsi r USING (symbol, ts) WINDOW w AS (PARTITION BY symbol, CAST(b.ts.ts AS DATE) ORDER BY b.ts ROWS UNBOUNDED PRECEDING)",
)  # ts is the time and the tick: ticks of one time are in order of their numbers
def running(spark, d):
    ticks = _ticks(spark, d).select("symbol", "ts", "event_id", F.col("mid").alias("high"), F.col("mid").alias("low"), F.col("mid").alias("close"), F.sqrt(1.0 + F.pmod("event_id", F.lit(7))).alias("tick_volume"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    folder = f"{shared}/indicators-{uuid.uuid4().hex}"
    write = sinks.rows_and_states(f"{folder}/out", lambda batch, states: jobs.running_indicators(batch, states, order=("ts", "event_id")))
    ticks.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("symbol string, ts timestamp, vwap double, rsi double, batch long, kind string").parquet(f"{folder}/out").where("kind = 'row'")
    return _naive(found.select("symbol", "ts", F.round("vwap", 6).alias("vwap"), F.round("rsi", 6).alias("rsi")))


@query(
    "str07_open_close_pairing",
    """SELECT o_orderkey AS ticket, CAST(o_orderdate AS TIMESTAMP) AS open_time, CAST(l_shipdate AS TIMESTAMP) AS close_time, CAST(l_extendedprice AS DOUBLE) AS profit
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND CAST(l_shipdate AS TIMESTAMP) >= CAST(o_orderdate AS TIMESTAMP) AND CAST(l_shipdate AS TIMESTAMP) <= CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY""",
)
def pairing(spark, d):
    opens = _stream(spark, d, "orders").select(F.col("o_orderkey").alias("ticket"), F.col("o_orderdate").cast("timestamp").alias("open_time"))
    closes = _stream(spark, d, "lineitem").select(F.col("l_orderkey").alias("ticket"), F.col("l_shipdate").cast("timestamp").alias("close_time"), F.col("l_extendedprice").cast("double").alias("profit"))
    with _one_batch(spark, views.table(spark, d, "orders").count() + views.table(spark, d, "lineitem").count()):
        found = _finished(spark, jobs.paired(opens, closes, late="4000 days"))
    return _naive(found).where("close_time IS NOT NULL")


@query("str08_trailing_stops")
def stops(spark, d):
    prices = _stream(spark, d, "events").select(F.col("user_id").cast("long").alias("ticket"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("direction"), F.col("value").alias("price"))
    return _naive(_finished(spark, jobs.trailing_stops(prices, 50.0)))


@query("str03_stale", views.with_views("ticks") + f""", g AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM ticks)
    SELECT symbol, ts AS last_seen, ts + INTERVAL 120 MINUTE AS stale_at FROM g WHERE later >= ts + INTERVAL 120 MINUTE OR (later IS NULL AND ts + INTERVAL 120 MINUTE < {_LAST})""")
def stale(spark, d):
    """Silences of two hours; the last one of a symbol is told by a timer if the watermark has passed it."""
    return _naive(_finished(spark, jobs.stale(_ticks(spark, d).select("symbol", "ts"), 120)))


@query(
    "str08_locked_stops",
    """WITH RECURSIVE p AS (SELECT user_id AS ticket, ts, value AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    r AS (SELECT ticket, n, ts, price - 30 AS stop, price + 20 AS target, false AS locked, false AS closed FROM p WHERE n = 1 UNION ALL
      SELECT ticket, n, ts, CASE WHEN hit THEN stop ELSE greatest(CASE WHEN touched THEN target ELSE stop END, price - 30) END, target, locked OR (touched AND NOT hit), hit FROM (
        SELECT r.ticket, p.n, p.ts, p.price, r.stop, r.target, r.locked, p.price <= r.stop AS hit, NOT r.locked AND p.price >= r.target AS touched FROM r JOIN p ON p.ticket = r.ticket AND p.n = r.n + 1 WHERE NOT r.closed) x)
    SELECT ticket, ts, round(stop, 6) AS stop, locked, closed FROM r""",
)
def locked_stops(spark, d):
    prices = _stream(spark, d, "events").select(F.col("user_id").cast("long").alias("ticket"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("direction"), F.col("value").alias("price"))
    return _naive(_finished(spark, jobs.locked_stops(prices, 30.0, 20.0))).withColumn("stop", F.round("stop", 6))
