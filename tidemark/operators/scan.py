"""Linear recurrences over long series by a chunked affine scan.

y[t] = a y[t-1] + b x[t] composes: a chunk maps the value before it to A y + B. So the rows of a series are cut to chunks
of time, each chunk's (A, B) is computed on its own, the few chunk rows of a series are chained, and each chunk runs again
from its start value. A long series is never one task's work; chunks of all series run in parallel.

A null input leaves the state as it is and gives null. The state starts at the seed row: the first valid value (EMA), or
the mean of the first n valid ones (Wilder).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.stages import saved

#: Length of a chunk in days. Any value gives the same result.
CHUNK_DAYS = 30


class Recurrence(NamedTuple):
    """y = a y + b x over the valid values of a column, started by the mean of the first `seed`, shown from the `warm`-th on."""

    column: str
    a: float
    b: float
    seed: int = 1
    warm: int = 1


def with_previous(bars: DataFrame, names: dict[str, str], chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """bars with columns of the row before: new name -> column. Inside chunks of time; what a chunk starts with is the last row
    of the chunk before it, a row a chunk."""
    cut = bars.withColumn("__chunk", _chunk(chunk_days))
    ends = cut.groupBy("symbol", "__chunk").agg(F.max_by(F.struct(*names.values()), "ts").alias("__end"))
    starts = ends.select("symbol", "__chunk", F.lag("__end").over(Window.partitionBy("symbol").orderBy("__chunk")).alias("__start"))
    inside = Window.partitionBy("symbol", "__chunk").orderBy("ts")
    before = {new: F.when(F.row_number().over(inside) == 1, F.col(f"__start.{old}")).otherwise(F.lag(old).over(inside)) for new, old in names.items()}
    return cut.join(starts, ["symbol", "__chunk"]).withColumns(before).drop("__chunk", "__start")


def _range_from(previous: str) -> Column:
    """True range; the first bar's is high - low."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(previous)), F.abs(F.col("low") - F.col(previous)))


def ema_input(column: str, n: int) -> Recurrence:
    return Recurrence(column, 1 - 2 / (n + 1), 2 / (n + 1), 1, n)


def wilder_input(column: str, n: int) -> Recurrence:
    return Recurrence(column, 1 - 1 / n, 1 / n, n, n)


def _chunk(days: int) -> Column:
    return F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (86_400 * days)).cast("long")


def _run(x: np.ndarray, rule: Recurrence, seen: int, total: float, state: float) -> tuple[np.ndarray, float]:
    """States after each of the valid values x, with `seen` values that sum to `total` before them; nan before the seed."""
    out = np.full(len(x), np.nan)
    for i, value in enumerate(x.tolist()):
        seen += 1
        if seen > rule.seed:
            state = rule.a * state + rule.b * value
        else:
            total += value
            if seen == rule.seed:
                state = total / rule.seed
        if seen >= rule.seed:
            out[i] = state
    return out, state


def _chain(name: str):
    def step(y, c):
        return F.when(y.isNull(), F.when(~F.isnan(c[f"F_{name}"]), c[f"F_{name}"])).otherwise(c[f"A_{name}"] * y + c[f"B_{name}"])

    return step


def affine_scan(bars: DataFrame, rules: dict[str, Recurrence], chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """bars with a column for each recurrence."""
    cut = saved(bars.withColumn("__chunk", _chunk(chunk_days)))  # read three times below
    names, columns = list(rules), bars.columns
    # What precedes each chunk: valid values and their sum. These tables have a row per chunk, not per bar.
    stats = cut.groupBy("symbol", "__chunk").agg(*[F.count(r.column).alias(f"__n_{k}") for k, r in rules.items()], *[F.sum(r.column).alias(f"__s_{k}") for k, r in rules.items()])
    earlier = Window.partitionBy("symbol").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = stats.select("symbol", "__chunk", *[F.coalesce(F.sum(f"__{x}_{k}").over(earlier), F.lit(0)).cast("double").alias(f"__{x}_{k}") for k in names for x in ("n", "s")])
    used = list(dict.fromkeys(r.column for r in rules.values()))
    slim = cut.select("symbol", "ts", "__chunk", *used).join(before, ["symbol", "__chunk"])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")  # one chunk of one series
        row = {"symbol": pdf["symbol"].iloc[0], "__chunk": pdf["__chunk"].iloc[0]}
        for name, rule in rules.items():
            x = pdf[rule.column].to_numpy(float)
            x = x[~np.isnan(x)]
            seen, total = int(pdf[f"__n_{name}"].iloc[0]), float(pdf[f"__s_{name}"].iloc[0])
            started = seen >= rule.seed
            row[f"A_{name}"] = rule.a ** len(x) if started else 1.0
            row[f"B_{name}"] = _run(x, rule, seen, total, 0.0)[1] if started else 0.0
            row[f"F_{name}"] = np.nan if started else _run(x, rule, seen, total, np.nan)[1]
        return pd.DataFrame([row])

    fields = "symbol string, __chunk long" + "".join(f", A_{n} double, B_{n} double, F_{n} double" for n in names)
    parts = slim.groupBy("symbol", "__chunk").applyInPandas(summarise, fields)
    rest = [c for c in parts.columns if c not in ("symbol", "__chunk")]
    listed = F.array_sort(F.collect_list(F.struct("__chunk", *rest)).over(Window.partitionBy("symbol")))  # a row a chunk
    chained = parts.select("symbol", "__chunk", listed.alias("list"))
    past = F.filter("list", lambda c: c["__chunk"] < F.col("__chunk"))
    starts = chained.select("symbol", "__chunk", *[F.aggregate(past, F.lit(None).cast("double"), _chain(n)).alias(f"__y_{n}") for n in names])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        for name, rule in rules.items():
            x = pdf[rule.column].to_numpy(float)
            valid = ~np.isnan(x)
            seen, start = int(pdf[f"__n_{name}"].iloc[0]), pdf[f"__y_{name}"].iloc[0]
            y = np.full(len(x), np.nan)
            y[valid] = _run(x[valid], rule, seen, float(pdf[f"__s_{name}"].iloc[0]), float("nan") if start is None else float(start))[0]
            y[valid] = np.where(seen + 1 + np.arange(valid.sum()) >= rule.warm, y[valid], np.nan)
            pdf[name] = y
        return pdf[[*columns, *names]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields) + "".join(f", `{n}` double" for n in names)
    done = cut.join(before, ["symbol", "__chunk"]).join(starts, ["symbol", "__chunk"]).groupBy("symbol", "__chunk").applyInPandas(finish, schema)
    return done.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def ema(bars: DataFrame, names: dict[str, tuple[str, int]], chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """names: output -> (input column, n). Null for the first n - 1 valid rows."""
    return affine_scan(bars, {k: ema_input(c, n) for k, (c, n) in names.items()}, chunk_days)


def wilder(bars: DataFrame, names: dict[str, tuple[str, int]], chunk_days: int = CHUNK_DAYS) -> DataFrame:
    return affine_scan(bars, {k: wilder_input(c, n) for k, (c, n) in names.items()}, chunk_days)


def atr(bars: DataFrame, n: int = 14, name: str = "atr", chunk_days: int = CHUNK_DAYS) -> DataFrame:
    ranged = with_previous(bars, {"__pc": "close"}, chunk_days).withColumn("__tr", _range_from("__pc"))
    return wilder(ranged.drop("__pc"), {name: ("__tr", n)}, chunk_days).drop("__tr")


def with_gains(bars: DataFrame, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """__gain and __loss of the close; null on the first bar."""
    moved = bars if "__pc" in bars.columns else with_previous(bars, {"__pc": "close"}, chunk_days)
    moved = moved.withColumn("__d", F.col("close") - F.col("__pc")).drop("__pc")
    known = F.col("__d").isNotNull()
    return moved.withColumns({"__gain": F.when(known, F.greatest("__d", F.lit(0.0))), "__loss": F.when(known, F.greatest(-F.col("__d"), F.lit(0.0)))}).drop("__d")


def rsi_of(gain: str, loss: str) -> Column:
    g, lo = F.col(gain), F.col(loss)
    return F.when(g.isNull(), None).when((g == 0) & (lo == 0), 50.0).when(lo == 0, 100.0).when(g == 0, 0.0).otherwise(100 - 100 / (1 + g / F.when(lo != 0, lo)))


def rsi(bars: DataFrame, n: int = 14, name: str = "rsi", chunk_days: int = CHUNK_DAYS) -> DataFrame:
    out = wilder(with_gains(bars, chunk_days), {"__g": ("__gain", n), "__l": ("__loss", n)}, chunk_days)
    return out.withColumn(name, rsi_of("__g", "__l")).drop("__gain", "__loss", "__g", "__l")


def with_moves(bars: DataFrame, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """__tr, and __plus and __minus: directional moves, null on the first bar. Keeps __pc, the close before."""
    moved = with_previous(bars, {"__pc": "close", "__ph": "high", "__pl": "low"}, chunk_days)
    moved = moved.withColumns({"__tr": _range_from("__pc"), "__up": F.col("high") - F.col("__ph"), "__down": F.col("__pl") - F.col("low")}).drop("__ph", "__pl")
    known = F.col("__up").isNotNull()
    return moved.withColumns({
        "__plus": F.when(known, F.when((F.col("__up") > F.col("__down")) & (F.col("__up") > 0), F.col("__up")).otherwise(0.0)),
        "__minus": F.when(known, F.when((F.col("__down") > F.col("__up")) & (F.col("__down") > 0), F.col("__down")).otherwise(0.0)),
    }).drop("__up", "__down")


def with_dx(bars: DataFrame, tr: str, plus: str, minus: str) -> DataFrame:
    """plus_di, minus_di and __dx of smoothed ranges and moves."""
    out = bars.withColumns({"plus_di": F.try_divide(100 * F.col(plus), F.col(tr)), "minus_di": F.try_divide(100 * F.col(minus), F.col(tr))})
    return out.withColumn("__dx", F.try_divide(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))


def adx(bars: DataFrame, n: int = 14, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """adx, plus_di, minus_di."""
    out = wilder(with_moves(bars, chunk_days).drop("__pc"), {"__a": ("__tr", n), "__p": ("__plus", n), "__m": ("__minus", n)}, chunk_days)
    out = wilder(with_dx(out, "__a", "__p", "__m"), {"adx": ("__dx", n)}, chunk_days)
    return out.drop("__tr", "__plus", "__minus", "__a", "__p", "__m", "__dx")


def trend(bars: DataFrame, emas: dict[str, tuple[str, int]], n: int = 14, chunk_days: int = CHUNK_DAYS, rsis: dict[str, int] | None = None) -> DataFrame:
    """EMAs, atr, rsi (of n, and of other lengths by name), plus_di, minus_di and adx in two scans: one over bar columns, one
    over the directional index.
    """
    rsis = rsis or {}
    smoothed = {"atr": "__tr", "__g": "__gain", "__l": "__loss", "__p": "__plus", "__m": "__minus"}
    rules = {k: ema_input(c, m) for k, (c, m) in emas.items()} | {k: wilder_input(c, n) for k, c in smoothed.items()}
    rules |= {f"__{side}_{name}": wilder_input(c, m) for name, m in rsis.items() for side, c in (("g", "__gain"), ("l", "__loss"))}
    out = affine_scan(with_gains(with_moves(bars, chunk_days)), rules, chunk_days)
    out = with_dx(out.withColumn("rsi", rsi_of("__g", "__l")), "atr", "__p", "__m")
    out = out.withColumns({name: rsi_of(f"__g_{name}", f"__l_{name}") for name in rsis}).drop(*[f"__{side}_{name}" for name in rsis for side in "gl"])
    out = out.drop("__gain", "__loss", "__g", "__l", "__plus", "__minus", "__p", "__m", "__tr")
    return wilder(out, {"adx": ("__dx", n)}, chunk_days).drop("__dx")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """macd, macd_signal, macd_hist."""
    out = ema(bars, {"__f": ("close", fast), "__s": ("close", slow)}, chunk_days).withColumn("macd", F.col("__f") - F.col("__s")).drop("__f", "__s")
    out = ema(out, {"macd_signal": ("macd", signal)}, chunk_days)
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
