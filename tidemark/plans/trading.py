"""Queries on signals, outcomes and the flagship chain."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import trade
from tidemark.operators import joins, ledger, outcomes, rules, scan
from tidemark.operators import indicators as ind
from tidemark.operators.indicators import order
from tidemark.operators.stages import saved
from tidemark.plans import sqltext
from tidemark.plans.sqltext import with_bars
from tidemark.registry import query
from tidemark.sources import views

#: Spark counts days of the week from Sunday = 1, DuckDB from Sunday = 0.
_SPARK, _DUCK = {"monday": 2}, {"monday": 1}


def _rule(name: str, days: dict, **changes) -> rules.Rule:
    r = replace(rules.RULES[name], **changes)
    return replace(r, long=r.long.format(**days), short=r.short.format(**days))


_F20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_DAY = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE)"
_FEATURES = [
    sqltext.adx(14),
    sqltext.wilder("atr", "tr", "tr", 14),
    sqltext.rsi(14),
    sqltext.rsi(5, "rsi5"),
    sqltext.ema("e20", "b", "close", 20),
    sqltext.ema("e50", "b", "close", 50),
    sqltext.ema("e200", "b", "close", 200),
    f"""fa AS (SELECT b.*, hour(ts) AS hour, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, a.y AS atr, r.y AS rsi, r5.y AS rsi5, x.y AS adx, e20.y AS ema20, e50.y AS ema50, e200.y AS ema200,
      sum((high + low + close) / 3 * tick_volume) OVER v / sum(tick_volume) OVER v AS vwap FROM b LEFT JOIN atr a USING (symbol, ts) LEFT JOIN rsi r USING (symbol, ts) LEFT JOIN rsi5 r5 USING (symbol, ts) LEFT JOIN adx x USING (symbol, ts)
      LEFT JOIN e20 USING (symbol, ts) LEFT JOIN e50 USING (symbol, ts) LEFT JOIN e200 USING (symbol, ts) WINDOW v AS (PARTITION BY symbol, {_DAY} ORDER BY ts))""",
    f"""fb AS (SELECT *, CASE WHEN count(*) OVER p = 20 THEN max(high) OVER p END AS upper, CASE WHEN count(*) OVER p = 20 THEN min(low) OVER p END AS lower, tick_volume / CASE WHEN count(*) OVER p = 20 THEN avg(tick_volume) OVER p END AS vol_ratio,
      close / lag(close, 24) OVER w - 1 AS mom, lag(rsi) OVER w AS rsi_before, lag(rsi5) OVER w AS rsi5_before, lag(close) OVER w - lag(close, 5) OVER w AS mom_before, lag(close) OVER w AS close_before, lag(ema20) OVER w AS ema20_before, lag(ema50) OVER w AS ema50_before, lag(open) OVER w AS open_before, lag(high) OVER w AS high_before,
      lag(low) OVER w AS low_before, lag(atr) OVER w AS atr_before, CASE WHEN count(atr) OVER h = 100 THEN 100.0 * len(list_filter(list(atr) OVER h, lambda v: v <= atr)) / 100 END AS atr_rank,
      CASE WHEN count(atr) OVER p = 20 THEN quantile_cont(atr, 0.5) OVER p END AS atr_median, CASE WHEN count(atr) OVER f = 50 AND max(atr) OVER f > min(atr) OVER f THEN (atr - min(atr) OVER f) / (max(atr) OVER f - min(atr) OVER f) ELSE 0.5 END AS atr_position,
      (close - vwap) / atr AS vwap_gap FROM fa WINDOW w AS (PARTITION BY symbol ORDER BY ts), p AS {_F20}, h AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""",
    "ft AS (SELECT *, lag(atr_rank) OVER (PARTITION BY symbol ORDER BY ts) AS rank_before FROM fb)",
]


def _sql_signals(name: str, **changes) -> str:
    """CTE sg(symbol, ts, k, direction, stop, target, atr)."""
    r = _rule(name, _DUCK, **changes)
    once = " QUALIFY row_number() OVER (PARTITION BY symbol, direction, CAST(ts AS DATE) ORDER BY ts) = 1" if r.once_a_day else ""
    target = "CAST(NULL AS DOUBLE)" if r.reward is None else f"close + direction * {r.reward} * abs(close - stop)"
    # After a hit the next one that counts is the first at least `cooldown` minutes later.
    rest = f"""sh AS (SELECT DISTINCT symbol, ts FROM hit), nx AS (SELECT h.symbol, h.ts, min(n.ts) AS later FROM sh h LEFT JOIN sh n ON h.symbol = n.symbol AND h.ts + INTERVAL {r.cooldown} MINUTE <= n.ts GROUP BY 1, 2),
    ac AS (SELECT symbol, min(ts) AS ts FROM sh GROUP BY 1 UNION ALL SELECT a.symbol, x.later FROM ac a JOIN nx x ON a.symbol = x.symbol AND a.ts = x.ts WHERE x.later IS NOT NULL),"""
    kept = " SEMI JOIN ac USING (symbol, ts)" if r.cooldown else ""
    return f"""hit AS (SELECT *, 1 AS direction, {r.stop(1)} AS stop FROM ft WHERE ({r.long}) AND atr IS NOT NULL UNION ALL SELECT *, -1, {r.stop(-1)} FROM ft WHERE ({r.short}) AND atr IS NOT NULL),
    {rest if r.cooldown else ""} sg AS (SELECT symbol, ts, k, direction, stop, {target} AS target, atr FROM hit{kept}{once})"""


def _signals(spark, d, *names):
    return rules.signals(rules.features(views.bars(spark, d)), [_rule(n, _SPARK) for n in names])


def _register(name: str) -> None:
    @query(f"{name}_signals", with_bars(*_FEATURES, _sql_signals(name)) + "SELECT symbol, ts, direction, round(stop, 4) AS stop, round(target, 4) AS target FROM sg")
    def run(spark, d):
        return _signals(spark, d, name).select("symbol", "ts", "direction", F.round("stop", 4).alias("stop"), F.round("target", 4).alias("target"))


for _name in rules.RULES:
    _register(_name)


@query("sig29_regime_gate", with_bars(*_FEATURES) + "SELECT symbol, ts, CASE WHEN adx > 25 THEN 'trend' WHEN adx < 20 THEN 'range' ELSE 'neutral' END AS regime, CASE WHEN atr_rank IS NULL THEN 'neutral' WHEN atr_rank >= 80 THEN 'high' WHEN atr_rank <= 20 THEN 'low' ELSE 'normal' END AS volatility FROM ft")
def regime(spark, d):
    table = rules.features(views.bars(spark, d))
    return table.select(
        "symbol", "ts", F.when(F.col("adx") > 25, "trend").when(F.col("adx") < 20, "range").otherwise("neutral").alias("regime"),
        F.when(F.col("atr_rank").isNull(), "neutral").when(F.col("atr_rank") >= 80, "high").when(F.col("atr_rank") <= 20, "low").otherwise("normal").alias("volatility"),
    )


@query(
    "sig31_ab_layers",
    with_bars(*_FEATURES, _sql_signals("sig09")) + "SELECT symbol, variant, count(*) AS n FROM (SELECT sg.symbol, unnest(list_filter(['plain', CASE WHEN adx >= 20 THEN 'adx' END, CASE WHEN hour BETWEEN 7 AND 20 THEN 'session' END], lambda x: x IS NOT NULL)) AS variant FROM sg JOIN ft USING (symbol, ts)) GROUP BY 1, 2",
)
def ab_layers(spark, d):
    table = rules.features(views.bars(spark, d))
    flags = table.select("symbol", "ts", F.array_compact(F.array(F.lit("plain"), F.when(F.col("adx") >= 20, "adx"), F.when(F.col("hour").between(7, 20), "session"))).alias("variants"))
    found = rules.signals(table, [_rule("sig09", _SPARK)]).select("symbol", "ts").join(flags, ["symbol", "ts"])
    return found.select("symbol", F.explode("variants").alias("variant")).groupBy("symbol", "variant").agg(F.count("*").alias("n"))


# ---- outcomes -------------------------------------------------------------------------------------------------------

_TOUCH = """nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bk FROM b),
pt AS (SELECT s.*, n.bk - s.k - 1 AS i, n.ts AS bar_ts, n.open, n.high, n.low, n.close FROM sg s JOIN nb n ON n.symbol = s.symbol AND n.bk BETWEEN s.k + 1 AND s.k + 24),
ev AS (SELECT *, CASE WHEN (open - stop) * direction <= 0 THEN 'sl_gap' WHEN (open - target) * direction >= 0 THEN 'tp_gap' WHEN (CASE WHEN direction = 1 THEN low ELSE high END - stop) * direction <= 0 THEN 'sl'
  WHEN (CASE WHEN direction = 1 THEN high ELSE low END - target) * direction >= 0 THEN 'tp' WHEN i = 23 THEN 'time' END AS reason FROM pt),
fi AS (SELECT * FROM ev WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts, direction ORDER BY i) = 1),
en AS (SELECT symbol, ts, direction, open AS entry FROM pt WHERE i = 0),
lb AS (SELECT f.symbol, f.ts, f.k, f.direction, f.stop, f.target, e.entry, CASE WHEN reason IN ('sl_gap', 'tp_gap') THEN open WHEN reason = 'sl' THEN stop WHEN reason = 'tp' THEN target ELSE close END AS exit,
  bar_ts + INTERVAL 60 MINUTE AS exit_time, reason, i + 1 AS bars_held FROM fi f JOIN en e USING (symbol, ts, direction)),
lr AS (SELECT *, (exit - entry) * direction / nullif(abs(entry - stop), 0) AS r_multiple FROM lb)"""


def _labelled(spark, d, name="sig09"):
    bars = views.bars(spark, d)
    table = rules.features(bars)
    return outcomes.first_touch(rules.signals(table, [_rule(name, _SPARK)]), outcomes.numbered(bars), 24, 60)


@query("out01_first_touch", with_bars(*_FEATURES, _sql_signals("sig09"), _TOUCH) + "SELECT symbol, ts, direction, entry, round(exit, 4) AS exit, exit_time, reason, bars_held, round(r_multiple, 4) AS r_multiple FROM lr")
def first_touch(spark, d):
    return _labelled(spark, d).select("symbol", "ts", "direction", "entry", F.round("exit", 4).alias("exit"), "exit_time", "reason", "bars_held", F.round("r_multiple", 4).alias("r_multiple"))


@query(
    "out02_time_exit",
    with_bars(*_FEATURES, _sql_signals("sig22"), "ah AS (SELECT symbol, ts, lead(open) OVER w AS entry, lead(close, 4) OVER w AS exit FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))")
    + "SELECT symbol, ts, direction, round((exit - entry) * direction, 4) AS pnl FROM sg JOIN ah USING (symbol, ts) WHERE exit IS NOT NULL",
)
def time_exit(spark, d):
    bars = views.bars(spark, d)
    found = outcomes.time_exit(rules.signals(rules.features(bars), [_rule("sig22", _SPARK)]), bars, 4)
    return found.select("symbol", "ts", "direction", F.round("pnl", 4).alias("pnl"))


@query(
    "out04_limit_fill",
    with_bars(*_FEATURES, _sql_signals("sig09"), "lm AS (SELECT symbol, ts, k, direction, (stop + target) / 2 - direction * 0.7 * atr AS lim, stop FROM sg)",
              "nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bk FROM b)",
              "pt AS (SELECT s.*, n.bk - s.k - 1 AS i, n.ts AS bar_ts, CASE WHEN direction = 1 THEN low ELSE high END AS worst FROM lm s JOIN nb n ON n.symbol = s.symbol AND n.bk BETWEEN s.k + 1 AND s.k + 6)",
              "tc AS (SELECT symbol, ts, direction, lim, stop, min(CASE WHEN (worst - lim) * direction <= 0 THEN i END) AS i FROM pt GROUP BY ALL)")
    + """SELECT t.symbol, t.ts, t.direction, round(t.lim, 4) AS "limit", CASE WHEN t.i IS NULL THEN 'expired' WHEN (p.worst - t.stop) * t.direction <= 0 THEN 'discarded' ELSE 'filled' END AS state,
    CASE WHEN (p.worst - t.stop) * t.direction > 0 THEN p.bar_ts END AS fill_ts FROM tc t LEFT JOIN pt p ON p.symbol = t.symbol AND p.ts = t.ts AND p.direction = t.direction AND p.i = t.i""",
)
def limit_fill(spark, d):
    bars = views.bars(spark, d)
    found = rules.signals(rules.features(bars), [_rule("sig09", _SPARK)])
    limits = found.withColumn("limit", (F.col("stop") + F.col("target")) / 2 - F.col("direction") * 0.7 * F.col("atr")).select("symbol", "ts", "k", "direction", "limit", "stop")
    return outcomes.limit_fill(limits, outcomes.numbered(bars), 6).select("symbol", "ts", "direction", F.round("limit", 4).alias("limit"), "state", "fill_ts")


def _trailed(name: str, multiple: float, even: float | None, lock: bool, **changes) -> str:
    """SQL of a trailing exit: the path of each signal, bar by bar."""
    moved = f"(bst - d * {multiple} * atr)"
    if even is not None:
        moved = f"(CASE WHEN (bst - entry) * d >= {even} * risk AND (entry - {moved}) * d > 0 THEN entry ELSE {moved} END)"
    return with_bars(
        *_FEATURES, _sql_signals(name, **changes), "nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bk FROM b)",
        "pp AS (SELECT s.symbol, s.ts, s.direction AS d, s.stop, s.target, s.atr, n.bk - s.k - 1 AS i, n.open, n.high, n.low, n.close FROM sg s JOIN nb n ON n.symbol = s.symbol AND n.bk BETWEEN s.k + 1 AND s.k + 48)",
        f"""rr AS (SELECT symbol, ts, d, atr, open AS entry, abs(open - stop) AS risk, CAST(-1 AS BIGINT) AS i, CAST(stop AS DOUBLE) AS stop, {"CAST(target AS DOUBLE)" if lock else "CAST(NULL AS DOUBLE)"} AS target, open AS best, CAST(NULL AS DOUBLE) AS exit, open AS close FROM pp WHERE i = 0 UNION ALL
        SELECT symbol, ts, d, atr, entry, risk, i, CASE WHEN ex IS NOT NULL THEN stop WHEN ({moved} - fl) * d > 0 THEN {moved} ELSE fl END, CASE WHEN NOT touched THEN target END, bst, ex, close FROM (
          SELECT r.symbol, r.ts, r.d, r.atr, r.entry, r.risk, p.i, r.stop, r.target, CASE WHEN r.d = 1 THEN greatest(best, p.high) ELSE least(best, p.low) END AS bst, p.close,
          coalesce((CASE WHEN r.d = 1 THEN p.high ELSE p.low END - r.target) * r.d >= 0, false) AS touched, CASE WHEN coalesce((CASE WHEN r.d = 1 THEN p.high ELSE p.low END - r.target) * r.d >= 0, false) THEN r.target ELSE r.stop END AS fl,
          CASE WHEN (p.open - r.stop) * r.d <= 0 THEN p.open WHEN (CASE WHEN r.d = 1 THEN p.low ELSE p.high END - r.stop) * r.d <= 0 THEN r.stop END AS ex
          FROM rr r JOIN pp p ON p.symbol = r.symbol AND p.ts = r.ts AND p.d = r.d AND p.i = r.i + 1 WHERE r.exit IS NULL) x)""",
    ) + "SELECT symbol, ts, d AS direction, entry, round(coalesce(exit, close), 4) AS exit, CAST(i + 1 AS INT) AS bars_held FROM rr WHERE i >= 0 QUALIFY row_number() OVER (PARTITION BY symbol, ts, d ORDER BY i DESC) = 1"


def _trail(spark, d, name, *args, **changes):
    bars = views.bars(spark, d)
    found = rules.signals(rules.features(bars), [_rule(name, _SPARK, **changes)])
    return outcomes.trailing_exit(found, outcomes.numbered(bars), 48, *args).withColumn("exit", F.round("exit", 4))


@query("out06_trailing_stop", _trailed("sig09", 2.5, None, False))
def trailing(spark, d):
    return _trail(spark, d, "sig09", 2.5)


_NEAR = {"stop_atr": 1.0, "reward": 0.5}


@query("out06_trailing_lock", _trailed("sig10", 3.0, None, True, **_NEAR))
def trailing_lock(spark, d):
    """The target, half a risk away, becomes the stop when it is touched."""
    return _trail(spark, d, "sig10", 3.0, None, True, **_NEAR)


@query("out07_break_even", _trailed("sig09", 4.0, 1.0, False))
def break_even(spark, d):
    return _trail(spark, d, "sig09", 4.0, 1.0)


_CURVE = """fp AS (SELECT n.symbol, n.bk, sum((n.close - t.entry) * t.direction) AS f FROM nb n JOIN lr t ON t.symbol = n.symbol AND n.bk BETWEEN t.k + 1 AND t.k + t.bars_held - 1 GROUP BY 1, 2),
rz AS (SELECT symbol, k + bars_held AS bk, sum((exit - entry) * direction) AS p FROM lr GROUP BY 1, 2),
eb AS (SELECT n.symbol, n.bk AS k, n.ts + INTERVAL 60 MINUTE AS "at", round(2000 + sum(coalesce(p, 0)) OVER (PARTITION BY n.symbol ORDER BY n.bk), 4) AS balance, coalesce(f, 0) AS f FROM nb n LEFT JOIN rz ON rz.symbol = n.symbol AND rz.bk = n.bk LEFT JOIN fp ON fp.symbol = n.symbol AND fp.bk = n.bk),
ec AS (SELECT symbol, k, "at", balance, round(balance + f, 4) AS equity FROM eb)"""


def _curve(spark, d):
    return ledger.equity_curve(_labelled(spark, d), outcomes.numbered(views.bars(spark, d)), 2000.0, 60)


@query("out11_equity_curve", with_bars(*_FEATURES, _sql_signals("sig09"), _TOUCH, _CURVE) + 'SELECT symbol, k, "at", balance, round(equity, 3) AS equity FROM ec')
def equity_curve(spark, d):
    return _curve(spark, d).withColumn("equity", F.round("equity", 3))


@query(
    "out12_loss_limit_days",
    with_bars(*_FEATURES, _sql_signals("sig09"), _TOUCH, _CURVE,
              'dy AS (SELECT *, CAST("at" + INTERVAL 120 MINUTE AS DATE) AS day FROM ec)', 'de AS (SELECT symbol, day, arg_max(balance, "at") AS last FROM dy GROUP BY 1, 2)',
              "op AS (SELECT symbol, day, coalesce(lag(last) OVER (PARTITION BY symbol ORDER BY day), 2000.0) AS opening FROM de)",
              'lh AS (SELECT symbol, day, opening, min(CASE WHEN round(opening - equity - 0.05 * opening, 6) >= 0 THEN "at" END) AS daily_at, min(CASE WHEN round(2000 - equity - 200, 6) >= 0 THEN "at" END) AS overall_at FROM dy JOIN op USING (symbol, day) GROUP BY 1, 2, 3)')
    + "SELECT *, bool_or(daily_at IS NOT NULL OR overall_at IS NOT NULL) OVER (PARTITION BY symbol ORDER BY day) AS breached FROM lh",
)
def loss_limit_days(spark, d):
    return ledger.loss_limit_days(_curve(spark, d), 2000.0, 0.05, 0.1, 120)


_PRICED = "pr AS (SELECT *, ((exit - direction * 0.1) - (entry + direction * 0.1)) * direction - 0.035 AS pnl FROM lr)"


@query("out08_price_trades", with_bars(*_FEATURES, _sql_signals("sig09"), _TOUCH, _PRICED) + "SELECT symbol, ts, direction, round(pnl, 4) AS pnl FROM pr")
def price_trades(spark, d):
    return outcomes.price_trades(_labelled(spark, d), 0.01, 20.0, 0.07).select("symbol", "ts", "direction", F.round("pnl", 4).alias("pnl"))


@query(
    "out08_priced_ledger",
    with_bars(*_FEATURES, _sql_signals("sig10", stop_atr=1.0, reward=1.0), _TOUCH, "et AS (SELECT l.*, n.ts AS entry_time FROM lr l JOIN nb n ON n.symbol = l.symbol AND n.bk = l.k + 1)",
              "z AS (SELECT *, entry + direction * 0.01 * (20 * 1.5 / 2 + 3) AS ef, exit - direction * CASE WHEN reason = 'tp' THEN 0.1 ELSE 0.01 * (20 * 1.5 / 2 + 3) END AS xf FROM et)",
              "lo AS (SELECT *, round(greatest(0.01, least(100.0, floor(100.0 / (nullif(abs(ef - stop), 0) * 10.0) / 0.01 + 1e-12) * 0.01)), 8) AS lots, CAST(coalesce(list_sum(list_transform(generate_series(CAST(entry_time + INTERVAL 120 MINUTE AS DATE) + 1, CAST(exit_time + INTERVAL 120 MINUTE AS DATE), INTERVAL 1 DAY), lambda x: CASE WHEN dayofweek(x - INTERVAL 1 DAY) = 3 THEN 3 ELSE 1 END)), 0) AS INT) AS nights FROM z)",
              "pr AS (SELECT *, nights * CASE WHEN direction = 1 THEN 4.0 ELSE 1.5 END * 0.01 * 10 * lots AS swap, 7.0 * lots / 2 AS half FROM lo WHERE lots > 0)", "pl AS (SELECT *, (xf - ef) * direction * 10 * lots - half - swap AS pnl FROM pr)")
    + "SELECT symbol, ts, direction, reason, lots, round(ef, 4) AS entry_fill, round(xf, 4) AS exit_fill, round(swap, 4) AS swap, round(half, 4) AS commission, round(pnl, 4) AS pnl, round(pnl / nullif(abs(ef - stop) * lots * 10, 0), 4) AS r_multiple, round(pnl - half, 4) AS balance_change FROM pl",
)
def priced_ledger(spark, d):
    """EMA crosses with lots for a risk of 100, market orders at 1.5 times the spread and 3 points, swap by side."""
    bars = outcomes.numbered(views.bars(spark, d))
    labelled = outcomes.first_touch(rules.signals(rules.features(views.bars(spark, d)), [_rule("sig10", _SPARK, stop_atr=1.0, reward=1.0)]), bars, 24, 60)
    entries = bars.select("symbol", (F.col("k") - 1).alias("k"), F.col("ts").alias("entry_time"))
    found = outcomes.priced_ledger(labelled.join(entries, ["symbol", "k"]), 0.01, 10.0, 20.0, 7.0, 100.0, (4.0, 1.5), 1.5, 3.0, offset_minutes=120)
    return found.select("symbol", "ts", "direction", "reason", "lots", *[F.round(c, 4).alias(c) for c in ("entry_fill", "exit_fill", "swap", "commission", "pnl", "r_multiple", "balance_change")])


@query(
    "out09_sequence_positions",
    with_bars(*_FEATURES, _sql_signals("sig22"), _TOUCH, "tr1 AS (SELECT symbol, ts, direction, ts + INTERVAL 60 MINUTE AS entry_time, exit_time, (exit - entry) * direction AS pnl, row_number() OVER (PARTITION BY symbol ORDER BY ts, exit_time, direction) AS n FROM lr)",
              "sq AS (SELECT symbol, n, ts, exit_time AS busy, true AS taken FROM tr1 WHERE n = 1 UNION ALL SELECT t.symbol, t.n, t.ts, CASE WHEN t.entry_time >= s.busy THEN t.exit_time ELSE s.busy END, t.entry_time >= s.busy FROM sq s JOIN tr1 t ON t.symbol = s.symbol AND t.n = s.n + 1)")
    + "SELECT symbol, count(*) AS n_taken FROM sq WHERE taken GROUP BY 1",
)
def sequence(spark, d):
    labelled = _labelled(spark, d, "sig22").select("symbol", "direction", (F.col("ts") + F.expr("INTERVAL 60 MINUTE")).alias("entry_time"), "exit_time", ((F.col("exit") - F.col("entry")) * F.col("direction")).alias("pnl"))
    return outcomes.sequence_positions(labelled, ["symbol"]).groupBy("symbol").agg(F.count("*").alias("n_taken"))


@query(
    "out10_cost_stress",
    with_bars(*_FEATURES, _sql_signals("sig09"), _TOUCH, "st AS (SELECT symbol, f, (exit - entry) * direction - 0.2 * f - 0.035 * f AS pnl FROM lr, (SELECT unnest([0.5, 1.0, 2.0, 3.0]) AS f))")
    + "SELECT symbol, CAST(f AS DOUBLE) AS factor, count(*) AS n, round(sum(pnl), 4) AS total FROM st GROUP BY 1, 2",
)
def cost_stress(spark, d):
    labelled = _labelled(spark, d).withColumn("factor", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 3.0)))))
    cost = (0.01 * 20.0 + 0.07 / 2) * F.col("factor")
    return labelled.groupBy("symbol", "factor").agg(F.count("*").alias("n"), F.round(F.sum((F.col("exit") - F.col("entry")) * F.col("direction") - cost), 4).alias("total"))


@query(
    "sig32_shift_test",
    with_bars(*_FEATURES, _sql_signals("sig09"), "nx AS (SELECT symbol, ts, lead(open) OVER w AS e0, lead(open, 2) OVER w AS e1, lead(close, 12) OVER w AS x FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))")
    + "SELECT symbol, round(avg((x - e0) * direction), 4) AS as_is, round(avg((x - e1) * direction), 4) AS shifted FROM sg JOIN nx USING (symbol, ts) WHERE x IS NOT NULL GROUP BY 1",
)
def shift_test(spark, d):
    bars = views.bars(spark, d)
    ahead = bars.select("symbol", "ts", F.lead("open").over(order()).alias("e0"), F.lead("open", 2).over(order()).alias("e1"), F.lead("close", 12).over(order()).alias("x"))
    found = rules.signals(rules.features(bars), [_rule("sig09", _SPARK)]).join(ahead, ["symbol", "ts"]).where("x IS NOT NULL")
    gain = lambda e: F.round(F.avg((F.col("x") - F.col(e)) * F.col("direction")), 4)
    return found.groupBy("symbol").agg(gain("e0").alias("as_is"), gain("e1").alias("shifted"))


def _again(sql: str, mark: str) -> str:
    """CTEs of signals and outcomes under other names, for a second rule or a shifted signal."""
    return re.sub(r"\b(hit|sh|nx|ac|sg|nb|pt|ev|fi|en|lb|lr)\b(?=[\s.,)])", rf"\g<1>{mark}", sql)


@query(
    "sig32_shift_outcomes",
    with_bars(*_FEATURES, _sql_signals("sig10"), _TOUCH, _again(_sql_signals("sig10"), "1"), "sg2 AS (SELECT symbol, ts, k + 1 AS k, direction, stop, target, atr FROM sg1)", _again(_TOUCH, "2"))
    + "SELECT symbol, variant, count(*) AS n, round(sum(greatest(p, 0)) / nullif(sum(greatest(-p, 0)), 0), 6) AS profit_factor FROM (SELECT symbol, 'as_is' AS variant, (exit - entry) * direction AS p FROM lr UNION ALL SELECT symbol, 'shifted', (exit - entry) * direction FROM lr2) GROUP BY 1, 2",
)
def shift_outcomes(spark, d):
    """First-touch outcomes of EMA crosses as they are and one bar later: a rule that saw the future loses by the shift."""
    bars = outcomes.numbered(views.bars(spark, d))
    found = saved(rules.signals(rules.features(views.bars(spark, d)), [_rule("sig10", _SPARK)]))
    variants = {"as_is": found, "shifted": found.withColumn("k", F.col("k") + 1)}
    labelled = [outcomes.first_touch(s, bars, 24, 60).withColumn("variant", F.lit(name)) for name, s in variants.items()]
    p = (F.col("exit") - F.col("entry")) * F.col("direction")
    factor = F.sum(F.greatest(p, F.lit(0.0))) / F.nullif(F.sum(F.greatest(-p, F.lit(0.0))), F.lit(0.0))
    return labelled[0].unionByName(labelled[1]).groupBy("symbol", "variant").agg(F.count("*").alias("n"), F.round(factor, 6).alias("profit_factor"))


_LEGS = {"cross": "sig10", "channel": "sig09", "reversal": "sig12"}


@query(
    "set01_rule_legs",
    with_bars(*_FEATURES, *[x for i, rule in enumerate(_LEGS.values()) for x in (_again(_sql_signals(rule), str(i)), _again(_TOUCH, str(i)))])
    + "SELECT leg, symbol, exit_time, round(r_multiple, 4) AS r_multiple, round(sum(r_multiple) OVER (PARTITION BY leg, symbol), 4) AS leg_total FROM ("
    + " UNION ALL ".join(f"SELECT '{leg}' AS leg, symbol, exit_time, r_multiple FROM lr{i}" for i, leg in enumerate(_LEGS)) + ")",
)
def rule_legs(spark, d):
    """The portfolio's trades: those of three rules, each labelled on its own, under the names of their legs."""
    bars = outcomes.numbered(views.bars(spark, d))
    table = saved(rules.features(views.bars(spark, d)))
    legs = [outcomes.first_touch(rules.signals(table, [_rule(rule, _SPARK)]), bars, 24, 60).select(F.lit(leg).alias("leg"), "symbol", "exit_time", "r_multiple") for leg, rule in _LEGS.items()]
    every = legs[0].unionByName(legs[1]).unionByName(legs[2])
    totals = every.groupBy("leg", "symbol").agg(F.round(F.sum("r_multiple"), 4).alias("leg_total"))
    return every.join(totals, ["leg", "symbol"]).select("leg", "symbol", "exit_time", F.round("r_multiple", 4).alias("r_multiple"), "leg_total")


@query(
    "jon09_position_log",
    with_bars(*_FEATURES, _sql_signals("sig10"), _TOUCH, "po AS (SELECT l.symbol, l.ts, l.direction, n.ts AS entry_time, l.exit_time FROM lr l JOIN nb n ON n.symbol = l.symbol AND n.bk = l.k + 1)")
    + "SELECT p.symbol, p.ts, p.direction, p.entry_time, p.exit_time, count(t.event_id) AS lines, min(t.event_id) AS least_id, max(t.mid) AS highest FROM po p LEFT JOIN ticks t ON t.symbol = p.symbol AND t.ts >= p.entry_time AND t.ts < p.exit_time GROUP BY 1, 2, 3, 4, 5",
)
def position_log(spark, d):
    """What the event log says while each labelled position is open: positions meet lines by symbol and hour, and lines are summed
    per position, so the result has a row a position."""
    bars = outcomes.numbered(views.bars(spark, d))
    labelled = outcomes.first_touch(rules.signals(rules.features(views.bars(spark, d)), [_rule("sig10", _SPARK)]), bars, 24, 60)
    entries = bars.select("symbol", (F.col("k") - 1).alias("k"), F.col("ts").alias("entry_time"))
    keys = ["symbol", "ts", "direction", "entry_time", "exit_time"]
    held = saved(labelled.join(entries, ["symbol", "k"]).select(*keys))
    dealt = held.withColumn("hour", F.explode(joins.hours_touched(F.col("entry_time"), F.col("exit_time"))))
    lines = views.ticks(spark, d).select("symbol", F.col("ts").alias("at"), "event_id", "mid", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"))
    inside = dealt.join(lines, ["symbol", "hour"]).where((F.col("at") >= F.col("entry_time")) & (F.col("at") < F.col("exit_time")))
    found = inside.groupBy(*keys).agg(F.count("*").alias("lines"), F.min("event_id").alias("least_id"), F.max("mid").alias("highest"))
    return held.join(found, keys, "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("sca06_calc_lots", with_bars(*_FEATURES) + "SELECT symbol, ts, round(greatest(0.01, least(50.0, floor(100.0 / (2 * round(atr, 6) * 10.0) / 0.01 + 1e-12) * 0.01)), 8) AS lots FROM ft WHERE atr > 0")
def calc_lots(spark, d):
    sized = scan.atr(views.bars(spark, d)).where("atr > 0")
    return sized.select("symbol", "ts", trade.lots(F.lit(100.0), 2 * F.round("atr", 6), F.lit(10.0), 0.01, 0.01, 50.0).alias("lots"))


@query(
    "sca08_swap_nights",
    views.with_views("trades") + "SELECT symbol, l_orderkey, l_linenumber, exit_time, CAST(coalesce(list_sum(list_transform(generate_series(CAST(entry_time AS DATE) + 1, CAST(exit_time AS DATE), INTERVAL 1 DAY), lambda x: CASE WHEN dayofweek(x - INTERVAL 1 DAY) = 3 THEN 3 ELSE 1 END)), 0) AS INT) AS nights FROM trades",
)
def swap_nights(spark, d):
    return views.trades(spark, d).select("symbol", "l_orderkey", "l_linenumber", "exit_time", trade.swap_nights(F.col("entry_time"), F.col("exit_time")).alias("nights"))


# ---- flagship -------------------------------------------------------------------------------------------------------


@query(
    "flagship_breakout_ledger",
    with_bars(
        "kb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b)",
        f"ch AS (SELECT *, CASE WHEN count(*) OVER p = 20 THEN max(high) OVER p END AS upper, CASE WHEN count(*) OVER p = 20 THEN min(low) OVER p END AS lower FROM kb WINDOW p AS {_F20})",
        "sg AS (SELECT symbol, ts, k, 1 AS direction, close - 50.0 AS stop, close + 100.0 AS target FROM ch WHERE close > upper UNION ALL SELECT symbol, ts, k, -1, close + 50.0, close - 100.0 FROM ch WHERE close < lower)",
        _TOUCH,
    )
    + """SELECT symbol, count(*) AS n, round(CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END)
      WHEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END, 6) AS profit_factor, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate,
    round(avg(r_multiple), 6) AS mean_r, round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 4) AS mean_pnl FROM (SELECT *, (exit - entry) * direction AS pnl FROM lr) GROUP BY 1""",
)
def flagship(spark, d):
    """Hourly bars -> 20-bar channel -> breakouts -> first touch of fixed stop and target -> metrics per symbol."""
    bars = outcomes.numbered(views.bars(spark, d))
    upper, lower = ind.donchian(20)
    side = F.when(F.col("close") > F.col("upper"), 1).when(F.col("close") < F.col("lower"), -1)
    hits = bars.withColumns({"upper": upper, "lower": lower}).withColumn("direction", side).where("direction IS NOT NULL")
    signals = hits.select("symbol", "ts", "k", "direction", (F.col("close") - F.col("direction") * 50.0).alias("stop"), (F.col("close") + F.col("direction") * 100.0).alias("target"))
    labelled = outcomes.first_touch(signals, bars, 24, 60)
    return labelled.withColumn("pnl", (F.col("exit") - F.col("entry")) * F.col("direction")).groupBy("symbol").agg(*ledger.summary())
