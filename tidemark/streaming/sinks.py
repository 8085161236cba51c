"""Sinks that take a stream batch by batch; a batch that is delivered again replaces what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Timestamps keep their microseconds in JSON.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _replaced(rows: DataFrame, kind: str, path: str, by: list[str]) -> None:
    """Write rows so that the partitions that they belong to are replaced, and no other."""
    rows.write.format(kind).option("timestampFormat", JSON_TIME).option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).save(path)


def signals_and_bars(signals_path: str, bars_path: str, hours: int, as_signals: Callable[[DataFrame], DataFrame], as_bars: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: two outputs of one batch. Signals go to JSON under the batch's number; bars (symbol, ts, ...) to Parquet by
    symbol and day, but only days with bars in at least `hours` hours, so that a broken day is fetched again.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            _replaced(as_signals(held).withColumn("batch", F.lit(number)), "json", signals_path, ["batch"])
            bars = as_bars(held).withColumn("day", F.to_date("ts"))
            whole = bars.groupBy("symbol", "day").agg(F.count_distinct(F.hour("ts")).alias("n")).where(F.col("n") >= hours).drop("n")
            _replaced(bars.join(whole, ["symbol", "day"], "left_semi"), "parquet", bars_path, ["symbol", "day"])
        finally:
            held.unpersist()

    return write


def rows_and_states(path: str, function: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: function(batch, states) gives rows of kind `row` and, a row a key, of kind `state`; both are written under
    the batch's number, and the states are given to the next batch. A batch that is delivered again gets the states it had.
    """

    def write(batch: DataFrame, number: int) -> None:
        states = batch.sparkSession.read.option("basePath", path).parquet(f"{path}/batch={number - 1}/kind=state") if number else None
        _replaced(function(batch, states).withColumn("batch", F.lit(number)), "parquet", path, ["batch", "kind"])

    return write
