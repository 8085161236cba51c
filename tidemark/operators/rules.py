"""Rule sets: signals as conditions on a shared feature table.

A rule is a pair of conditions in SQL expression text over the features, a stop distance in ATR and a reward ratio. Any
number of rules and parameter sets is evaluated in one pass over the features, which are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import indicators as ind
from tidemark.operators import scan
from tidemark.operators.chunks import chunked, row_numbers
from tidemark.operators.indicators import lag
from tidemark.operators.patterns import unblocked


@dataclass(frozen=True)
class Rule:
    """long and short are conditions; once_a_day keeps the first signal of each side and UTC day.

    The stop is stop_atr times the column `atr` away, or the expression of its side in `stops`; the target is `reward` times
    as far (None: no target). After a signal, either side, the rule rests for `cooldown` minutes.
    """

    name: str
    long: str
    short: str
    stop_atr: float = 2.0
    reward: float | None = 2.0
    once_a_day: bool = False
    atr: str = "atr"
    stops: tuple[str, str] | None = None
    cooldown: int = 0

    def stop(self, direction: int) -> str:
        """SQL expression of the stop of a side."""
        return self.stops[direction < 0] if self.stops else f"close - ({direction}) * {self.stop_atr} * {self.atr}"


#: Rows that the windows of the features reach back.
_REACH = 101


def features(bars: DataFrame) -> DataFrame:
    """Everything that the rules read, from (symbol, ts, open, high, low, close, tick_volume)."""
    out = ind.session_vwap(bars.select("symbol", "ts", "open", "high", "low", "close", "tick_volume"), "America/New_York")
    out = scan.trend(row_numbers(out), {f"ema{n}": ("close", n) for n in (20, 50, 200)}, rsis={"rsi5": 5})
    return chunked(out, _windows, before=_REACH, number="k")


def _windows(table: DataFrame) -> DataFrame:
    """Features from the rows around each bar."""
    upper, lower = ind.donchian(20)
    out = table.withColumns({
        "upper": upper, "lower": lower, "mom_before": lag("close") - lag("close", 5), "rsi5_before": lag("rsi5"), "vol_ratio": ind.ratio_to_mean("tick_volume", 20), "mom": ind.momentum(24), "rsi_before": lag("rsi"), "close_before": lag("close"),
        "ema20_before": lag("ema20"), "ema50_before": lag("ema50"), "open_before": lag("open"), "high_before": lag("high"), "low_before": lag("low"), "atr_before": lag("atr"), "hour": F.hour("ts"),
        "atr_rank": ind.rolling_rank("atr", 100), "atr_median": ind.rolling_median("atr", 20, 1), "atr_position": ind.minmax_position("atr", 50), "vwap_gap": F.try_divide(F.col("close") - F.col("vwap"), F.col("atr")),
    })
    return out.withColumn("rank_before", lag("atr_rank"))


def cooled(hits: DataFrame) -> DataFrame:
    """hits (rule, symbol, ts, rest, ...) without those within `rest` minutes of the last one that stays; chunk by chunk."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = hits.withColumns({"__at": micros, "__free": micros + F.col("rest") * F.lit(60_000_000), "__side": -F.col("direction")})
    width = 30 * 86_400 * 1_000_000
    return unblocked(timed, ["rule", "symbol"], "__at", "__free", ["__side"], width).drop("__at", "__free", "__side")


def signals(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, symbol, ts, k, direction, stop, target, atr of all rules: one scan of the features, then only hits go on."""
    hits = F.array_compact(F.array(*[
        F.when(F.expr(f"({condition}) AND atr IS NOT NULL"), F.struct(F.lit(r.name).alias("rule"), F.lit(d).alias("direction"), F.expr(r.stop(d)).cast("double").alias("stop"), F.lit(r.reward).cast("double").alias("t"), F.lit(r.once_a_day).alias("once"), F.lit(r.cooldown).cast("long").alias("rest")))
        for r in rules for d, condition in ((1, r.long), (-1, r.short))
    ]))
    found = table.select("symbol", "ts", "k", "close", "atr", F.explode(hits).alias("h")).select("symbol", "ts", "k", "close", "atr", "h.*")
    day = Window.partitionBy("rule", "symbol", "direction", F.to_date("ts")).orderBy("ts")
    found = found.withColumn("__n", F.row_number().over(day)).where("NOT once OR __n = 1").drop("__n")
    if any(r.cooldown for r in rules):
        found = found.where("rest = 0").unionByName(cooled(found.where("rest > 0")))
    target = F.col("close") + F.col("direction") * F.col("t") * F.abs(F.col("close") - F.col("stop"))
    return found.select("rule", "symbol", "ts", "k", "direction", "stop", target.alias("target"), "atr")


#: The rule sets, by the identifiers of the survey.
RULES = {
    "sig04": Rule("sig04", "hour BETWEEN 7 AND 16 AND close > upper AND atr > atr_median AND close > ema200 AND dayofweek(ts) <> {monday}", "hour BETWEEN 7 AND 16 AND close < lower AND atr > atr_median AND close < ema200 AND dayofweek(ts) <> {monday}", 1.5, 2.0, True),
    "sig05": Rule("sig05", "adx < 25 AND atr <= atr_median AND rsi_before >= 30 AND rsi < 30 AND close > ema200", "adx < 25 AND atr <= atr_median AND rsi_before <= 70 AND rsi > 70 AND close < ema200"),
    "sig09": Rule("sig09", "close > upper", "close < lower"),
    "sig09x": Rule("sig09x", "close > upper AND adx >= 20 AND hour BETWEEN 7 AND 20", "close < lower AND adx >= 20 AND hour BETWEEN 7 AND 20"),
    "sig10": Rule("sig10", "ema20 > ema50 AND ema20_before <= ema50_before", "ema20 < ema50 AND ema20_before >= ema50_before"),
    "sig11": Rule("sig11", "mom > 0 AND k % 24 = 0", "mom < 0 AND k % 24 = 0"),
    "sig12": Rule("sig12", "rsi5_before >= 20 AND rsi5 < 20", "rsi5_before <= 80 AND rsi5 > 80", 1.0, 1.2, cooldown=180),
    "sig13": Rule("sig13", "vwap_gap <= -1.5 AND hour BETWEEN 7 AND 19", "vwap_gap >= 1.5 AND hour BETWEEN 7 AND 19", 1.0, 1.0, cooldown=180),
    "sig14": Rule("sig14", "rank_before <= 25 AND close > upper AND vol_ratio >= 1.5", "rank_before <= 25 AND close < lower AND vol_ratio >= 1.5"),
    "sig15": Rule("sig15", "vol_ratio >= 2 AND high - low > 0 AND high - low >= 1.8 * atr_before AND mom_before < 0 AND close - low <= 0.3 * (high - low)", "vol_ratio >= 2 AND high - low > 0 AND high - low >= 1.8 * atr_before AND mom_before > 0 AND close - low >= 0.7 * (high - low)", 1.5, 2.0, atr="atr_before"),
    "sig17": Rule("sig17", "close > ema200 AND abs(close - ema200) > 0.3 * atr AND adx >= 15 AND atr_position >= 0.2 AND rsi_before < 50 AND rsi >= 50", "close < ema200 AND abs(close - ema200) > 0.3 * atr AND adx >= 15 AND atr_position >= 0.2 AND rsi_before > 50 AND rsi <= 50"),
    "sig20": Rule("sig20", "close > upper AND atr_position >= 0.2", "close < lower AND atr_position >= 0.2"),
    "sig21": Rule("sig21", "close > ema200 AND ema20 > ema50 AND rsi_before < 60 AND rsi >= 60", "close < ema200 AND ema20 < ema50 AND rsi_before > 40 AND rsi <= 40"),
    "sig22": Rule("sig22", "hour = 22", "false", 2.0, None, True),
    "sig23": Rule("sig23", "close > open AND close_before < open_before AND close >= open_before AND open <= close_before AND low <= lower AND vol_ratio >= 1.5", "close < open AND close_before > open_before AND close <= open_before AND open >= close_before AND high >= upper AND vol_ratio >= 1.5", stops=("least(low - 0.3 * atr, close - 1.0 * atr)", "greatest(high + 0.3 * atr, close + 1.0 * atr)")),
    "sig28": Rule("sig28", "low_before <= ema20_before AND close > high_before AND close > ema50", "high_before >= ema20_before AND close < low_before AND close < ema50"),
}
