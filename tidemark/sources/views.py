"""Market-data views on the input tables: ticks, bars, calendar, trade ledger, deals, journal, log lines.

The DataFrame functions and the texts in SQL define the same rows; the texts are for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import ticks_to_bars

#: Minutes of each timeframe.
TIMEFRAMES = {"M1": 1, "M5": 5, "M15": 15, "H1": 60, "H4": 240, "D1": 1440}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, event_id, bid, ask, mid."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", (value * 0.9999).alias("bid"), (value * 1.0001).alias("ask"), value.alias("mid")
    )


def bars(spark: SparkSession, sf_dir: str, tf: str = "H1") -> DataFrame:
    """symbol, tf, ts, open, high, low, close, tick_volume from the ticks."""
    return ticks_to_bars(ticks(spark, sf_dir), TIMEFRAMES[tf]).withColumn("tf", F.lit(tf))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of daily bars per order priority, from orders: o_orderkey orders the prices of a day."""
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", day).cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("o_totalprice", "o_orderkey").cast("double").alias("open"),
        F.max("o_totalprice").cast("double").alias("high"),
        F.min("o_totalprice").cast("double").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").cast("double").alias("close"),
        F.count("*").cast("double").alias("tick_volume"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time_utc, currency, impact, title of scheduled news, from error events."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.pmod(F.col("user_id"), F.lit(3))
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'error'")
        .select(
            F.col("ts").cast("timestamp_ntz").alias("time_utc"),
            F.when(user == 0, "USD").when(user == 1, "EUR").otherwise("JPY").alias("currency"),
            F.when(k >= 90, "High").when(k >= 50, "Medium").otherwise("Low").alias("impact"),
            F.when(k == 99, "CPI m/m").otherwise("event").alias("title"),
        )
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade ledger: run_id, symbol, entry_time, exit_time, direction, lots, pnl, r_multiple, and the ordering columns."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    items = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    close = F.col("l_shipdate").cast("timestamp_ntz")
    edge = F.col("l_discount").cast("double") - F.col("l_tax").cast("double")
    return items.select(
        F.col("p_brand").alias("symbol"),
        F.concat("l_returnflag", "l_linestatus").alias("run_id"),
        (close - F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))).alias("entry_time"),
        close.alias("exit_time"),
        F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1).alias("direction"),
        F.col("l_quantity").cast("double").alias("lots"),
        F.round(F.col("l_extendedprice").cast("double") * edge, 4).alias("pnl"),
        F.round(edge / 0.05, 6).alias("r_multiple"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("double").alias("price"),
    )


#: A total order of trades for running sums.
TRADE_ORDER = ("exit_time", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")

#: The same views in SQL, as common table expressions; each may use those before it.
SQL = {
    "ticks": "ticks AS (SELECT event_type AS symbol, ts, event_id, value*0.9999 AS bid, value*1.0001 AS ask, value AS mid FROM events)",
    "daily": """daily AS (SELECT o_orderpriority AS symbol, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS ts,
      CAST(first(o_totalprice ORDER BY o_orderkey) AS DOUBLE) AS open, CAST(max(o_totalprice) AS DOUBLE) AS high, CAST(min(o_totalprice) AS DOUBLE) AS low,
      CAST(last(o_totalprice ORDER BY o_orderkey) AS DOUBLE) AS close, CAST(count(*) AS DOUBLE) AS tick_volume FROM orders GROUP BY 1, 2)""",
    "calendar": """calendar AS (SELECT ts AS time_utc, CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency,
      CASE WHEN CAST(props->>'$.k' AS INT) >= 90 THEN 'High' WHEN CAST(props->>'$.k' AS INT) >= 50 THEN 'Medium' ELSE 'Low' END AS impact,
      CASE WHEN CAST(props->>'$.k' AS INT) = 99 THEN 'CPI m/m' ELSE 'event' END AS title FROM events WHERE event_type = 'error')""",
    "trades": """trades AS (SELECT p_brand AS symbol, l_returnflag || l_linestatus AS run_id,
      CAST(l_shipdate AS TIMESTAMP) - to_hours(CAST(l_quantity AS BIGINT)) AS entry_time, CAST(l_shipdate AS TIMESTAMP) AS exit_time,
      CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS direction, CAST(l_quantity AS DOUBLE) AS lots,
      round(CAST(l_extendedprice AS DOUBLE) * (CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)), 4) AS pnl,
      round((CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)) / 0.05, 6) AS r_multiple,
      l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DOUBLE) AS price
      FROM lineitem JOIN part ON p_partkey = l_partkey)""",
}


def bars_sql(tf: str = "H1", name: str | None = None) -> str:
    """Common table expression of bars from the view `ticks`."""
    return f"""{name or "bars"} AS (SELECT symbol, time_bucket(INTERVAL '{TIMEFRAMES[tf]} minutes', ts) AS ts, first(mid ORDER BY ts, event_id) AS open,
      max(mid) AS high, min(mid) AS low, last(mid ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS tick_volume FROM ticks GROUP BY 1, 2)"""


def with_views(*names: str) -> str:
    """WITH clause of views; `H1` and the like stand for bars of that timeframe under the name bars_h1."""
    out = []
    for name in names:
        out.append(SQL[name] if name in SQL else bars_sql(name, f"bars_{name.lower()}"))
    return "WITH " + ",\n".join(out)
