"""Queries that write rows of the given tables as files and read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans.statistics import _PF, _T
from tidemark.registry import query
from tidemark.sources import files, views

_READ = views.with_views("ticks", "H1") + "SELECT symbol, 'H1' AS tf, ts, open, high, low, close, tick_volume FROM bars_h1"


def _folder(spark: SparkSession) -> str:
    """A new folder of the shared ones; a temporary one only where spark.checkpoint.dir is unset."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/files-{uuid.uuid4().hex}"


@query("snk01_write_bars", _READ)
def bars_parquet(spark, d):
    """Bars by timeframe and symbol as Parquet, and read from there (src01)."""
    path = _folder(spark)
    files.write_bars(views.bars(spark, d), path)
    return files.read_bars(spark, path)


@query("src01_read_bars_csv", _READ.replace("SELECT symbol, 'H1' AS tf, ts", "SELECT ts"))
def bars_csv(spark, d):
    """The fall-back form; file names that name no symbol leave it empty, so it is left out."""
    path = _folder(spark)
    views.bars(spark, d).select("ts", *files.PRICES).write.option("header", True).csv(path)
    return files.read_bars(spark, path, "csv").drop("symbol", "tf")


@query("src04_tick_records", views.with_views("ticks") + "SELECT symbol, date_trunc('millisecond', ts) AS ts, round(mid * 1.0001, 2) AS ask, round(mid * 0.9999, 2) AS bid FROM ticks")
def tick_records(spark, d):
    """Ticks packed to hour files of 20-byte records, and decoded."""
    number = lambda c: F.lpad(F.hex(F.round(c).cast("long")), 8, "0")
    ticks = views.ticks(spark, d)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    record = F.concat(number(F.floor(micros / 1000) % 3_600_000), number(F.round(F.col("mid") * 1.0001, 2) * 100), number(F.round(F.col("mid") * 0.9999, 2) * 100), F.lit("3F800000" * 2))
    hours = ticks.select("symbol", F.date_trunc("hour", "ts").alias("hour"), F.struct("event_id", record.alias("r")).alias("r")).groupBy("symbol", "hour").agg(F.array_sort(F.collect_list("r")).alias("list"))  # an hour of ticks
    path = F.concat(F.lit("/"), "symbol", F.date_format("hour", "/yyyy/MM/dd/HH"), F.lit("h_ticks.bin"))
    found = files.decode_ticks(hours.select(path.alias("path"), F.unhex(F.array_join(F.transform("list", lambda x: x["r"]), "")).alias("content")), 100.0)
    return found.select("symbol", "ts", F.round("ask", 2).alias("ask"), F.round("bid", 2).alias("bid"))


@query("src05_read_calendar", views.with_views("ticks", "calendar") + "SELECT CASE WHEN title <> 'event' THEN time_utc END AS time_utc, currency, impact, title FROM calendar")
def calendar_csv(spark, d):
    """Calendar cache; the times of all but one kind of event are spoilt and read as null, currencies are written in lower case."""
    path = _folder(spark)
    text = F.when(F.col("title") == "event", "tentative").otherwise(F.col("time_utc").cast("string"))
    views.calendar(spark, d).select(text.alias("time_utc"), F.lower("currency").alias("currency"), "impact", "title", F.lit("now").alias("fetched_at")).write.option("header", True).csv(path)
    return files.read_calendar(spark, path)


@query("src08_read_journal", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS zeit, CAST(o_orderkey AS VARCHAR) AS ticket, o_orderpriority AS text FROM orders WHERE o_orderkey % 5 <> 0")
def journal_csv(spark, d):
    """Semicolon journal with a byte-order mark; lines whose time is blank go."""
    path = _folder(spark)
    time = F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    rows = views.table(spark, d, "orders").select(time.alias("\ufeffzeit"), F.col("o_orderkey").alias("ticket"), F.col("o_orderpriority").alias("text"))
    rows.write.option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_journal(spark, path)


@query("snk02_write_ledger", _T + f", g AS (SELECT run_id, {_PF} >= 1.0 AS passed FROM trades GROUP BY 1) SELECT t.run_id, count(*) AS n, round(sum(pnl), 4) AS pnl, any_value(passed) AS passed FROM trades t JOIN g USING (run_id) GROUP BY 1")
def ledger_files(spark, d):
    """Out-of-sample ledger as CSV and gates as JSON, read again and joined."""
    from tidemark.functions.trade import profit_factor

    path = _folder(spark)
    trades = views.trades(spark, d).select("run_id", "symbol", "exit_time", "pnl")
    files.write_ledger(trades, trades.groupBy("run_id").agg((profit_factor(F.col("pnl")) >= 1.0).alias("passed")), path)
    ledger = spark.read.schema(trades.schema).option("header", True).csv(f"{path}/oos_trades")
    gates = spark.read.schema("run_id string, passed boolean").json(f"{path}/gates")
    return ledger.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl")).join(gates, "run_id")
