"""Queries on ledgers, folds, selection and robustness."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.trade import profit_factor
from tidemark.operators import ledger, validation
from tidemark.registry import query
from tidemark.sources import views
from tidemark.sources.views import with_views

_T = with_views("trades")
_ORDER = "exit_time, l_orderkey, l_linenumber, l_partkey, l_suppkey, price"
_GAIN, _LOSS = "sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)", "sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END)"
_PF = f"CASE WHEN {_LOSS} > 0 THEN {_GAIN} / {_LOSS} WHEN {_GAIN} > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END"
_SUMMARY = f"count(*) AS n, round({_PF}, 6) AS profit_factor, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate, round(avg(r_multiple), 6) AS mean_r, round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 4) AS mean_pnl"


@query("met01_summary", _T + f"SELECT run_id, symbol, {_SUMMARY} FROM trades GROUP BY 1, 2")
def summary(spark, d):
    return views.trades(spark, d).groupBy("run_id", "symbol").agg(*ledger.summary())


@query(
    "met02_max_drawdown",
    _T + f""", e AS (SELECT symbol, sum(pnl) OVER w AS eq, {_ORDER} FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT symbol, max(eq) OVER (PARTITION BY symbol ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) - eq AS dd FROM e) SELECT symbol, round(max(dd), 4) AS max_drawdown FROM f GROUP BY 1""",
)
def max_drawdown(spark, d):
    return ledger.drawdown(views.trades(spark, d), "symbol")


@query(
    "met03_losing_streak",
    _T + f""", i AS (SELECT symbol, pnl, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS g FROM trades),
    r AS (SELECT symbol, g, count(*) AS n FROM i WHERE pnl < 0 GROUP BY 1, 2) SELECT symbol, max(n) AS losing_streak FROM r GROUP BY 1""",
)
def streak(spark, d):
    return ledger.losing_streak(views.trades(spark, d), "symbol")


_DAILY = """dp AS (SELECT symbol, CAST(exit_time AS DATE) AS day, sum(pnl) AS pnl FROM trades GROUP BY 1, 2), sp AS (SELECT symbol, min(day) AS a, max(day) AS z FROM dp GROUP BY 1),
ev AS (SELECT symbol, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sp), dd AS (SELECT ev.symbol, ev.day, coalesce(pnl, 0) AS pnl FROM ev LEFT JOIN dp USING (symbol, day))"""


@query(
    "met04_sharpe_sortino",
    _T + f", {_DAILY} SELECT symbol, round(coalesce(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252.0) END, 0.0), 6) AS sharpe,"
    " round(coalesce(CASE WHEN stddev_samp(CASE WHEN pnl < 0 THEN pnl END) > 0 THEN avg(pnl) / stddev_samp(CASE WHEN pnl < 0 THEN pnl END) * sqrt(252.0) END, 0.0), 6) AS sortino FROM dd GROUP BY 1",
)
def sharpe(spark, d):
    return ledger.sharpe_sortino(views.trades(spark, d), "symbol")


@query("agg10_ledger_grouping_sets", _T + f"SELECT direction, year(exit_time) AS year, symbol, count(*) AS n, round({_PF}, 6) AS profit_factor FROM trades GROUP BY GROUPING SETS ((), (direction), (year(exit_time)), (symbol))")
def grouping_sets(spark, d):
    return ledger.by_groups(views.trades(spark, d))


@query("met05_by_direction_year", _T + f"SELECT direction, year(exit_time) AS year, count(*) AS n, round({_PF}, 6) AS profit_factor FROM trades GROUP BY 1, 2")
def direction_year(spark, d):
    return views.trades(spark, d).groupBy("direction", F.year("exit_time").alias("year")).agg(F.count("*").alias("n"), F.round(profit_factor(F.col("pnl")), 6).alias("profit_factor"))


@query("met06_ab_compare", _T + f", v AS (SELECT 'all' AS variant, * FROM trades UNION ALL SELECT 'long', * FROM trades WHERE direction = 1 UNION ALL SELECT 'large', * FROM trades WHERE lots >= 25) SELECT variant, {_SUMMARY} FROM v GROUP BY 1")
def ab_compare(spark, d):
    layers = F.array_compact(F.array(F.lit("all"), F.when(F.col("direction") == 1, "long"), F.when(F.col("lots") >= 25, "large")))
    return views.trades(spark, d).withColumn("variant", F.explode(layers)).groupBy("variant").agg(*ledger.summary())


@query("met07_portfolio_merge", _T + f", l AS (SELECT year(exit_time) AS fold, pnl / 5 AS pnl FROM trades WHERE symbol LIKE '%1' OR symbol LIKE '%2') SELECT fold, count(*) AS n, round({_PF}, 6) AS profit_factor, round(sum(pnl), 4) AS total FROM l GROUP BY 1")
def portfolio(spark, d):
    legs = views.trades(spark, d).where(F.col("symbol").like("%1") | F.col("symbol").like("%2")).select(F.year("exit_time").alias("fold"), (F.col("pnl") / 5).alias("pnl"))
    return legs.groupBy("fold").agg(F.count("*").alias("n"), F.round(profit_factor(F.col("pnl")), 6).alias("profit_factor"), F.round(F.sum("pnl"), 4).alias("total"))


@query(
    "top02_without_best",
    _T + f", r AS (SELECT symbol, pnl AS p, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, {_ORDER}) AS k FROM trades), q AS (SELECT symbol, p, CASE WHEN k > 10 THEN p ELSE 0 END AS pnl, k FROM r) SELECT symbol, round(sum(CASE WHEN k <= 10 THEN p ELSE 0 END), 4) AS best_pnl, round({_PF}, 6) AS pf_without FROM q GROUP BY 1",
)
def without_best(spark, d):
    return ledger.without_best(views.trades(spark, d), "symbol", 10)


@query("top03_newest_result", "SELECT p_brand AS symbol, max(o_orderdate) AS newest, arg_max(o_totalprice, (o_orderdate, o_orderkey, o_totalprice)) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def newest(spark, d):
    orders, parts = views.table(spark, d, "orders"), views.table(spark, d, "part")
    joined = views.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy(F.col("p_brand").alias("symbol")).agg(F.max("o_orderdate").alias("newest"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("value"))


@query("top04_last_lines", "SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_lines(spark, d):
    return views.table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "event_type", "value")


@query("set01_union_of_legs", _T + "SELECT run_id, symbol, exit_time, pnl, l_orderkey FROM trades WHERE run_id LIKE '%F' UNION ALL SELECT run_id, symbol, exit_time, pnl, l_orderkey FROM trades WHERE run_id NOT LIKE '%F'")
def union_legs(spark, d):
    t = views.trades(spark, d).select("run_id", "symbol", "exit_time", "pnl", "l_orderkey")
    return t.where("run_id LIKE '%F'").unionByName(t.where("run_id NOT LIKE '%F'")).orderBy("exit_time", "l_orderkey")


# ---- folds and selection --------------------------------------------------------------------------------------------

_PERF = f""", perf AS (SELECT year(exit_time) * 4 + quarter(exit_time) - 1 AS fold, l_suppkey % 12 AS combo, {_PF} AS pf FROM trades GROUP BY 1, 2)"""


def _perf(spark, d):
    quarter = F.year("exit_time") * 4 + F.quarter("exit_time") - 1
    return views.trades(spark, d).groupBy(quarter.alias("fold"), F.pmod("l_suppkey", F.lit(12)).alias("combo")).agg(profit_factor(F.col("pnl")).alias("pf"))


@query("val01_param_grid", with_views("ticks") + "SELECT s.symbol, CAST((row_number() OVER (PARTITION BY s.symbol ORDER BY a.i, b.i) - 1) AS BIGINT) AS combo_id, a.i AS length, b.i AS mult FROM (SELECT DISTINCT symbol FROM ticks) s, (SELECT unnest([10, 20, 55]) AS i) a, (SELECT unnest([1, 2, 3, 4]) AS i) b")
def grid(spark, d):
    return views.ticks(spark, d).select("symbol").distinct().join(F.broadcast(validation.param_grid(spark, {"length": [10, 20, 55], "mult": [1, 2, 3, 4]})))


_FOLDS = """span AS (SELECT min(ts) AS s, max(ts) AS e FROM daily), fs AS (SELECT CAST(unnest(range(100)) AS INT) AS fold, s, e FROM span),
folds AS (SELECT fold, s + to_months(fold * 6) AS is_start, s + to_months(fold * 6) + INTERVAL 24 MONTH AS oos_start, least(s + to_months(fold * 6) + INTERVAL 30 MONTH, e) AS oos_end FROM fs
 WHERE s + to_months(fold * 6) + INTERVAL 24 MONTH < e AND date_diff('day', s + to_months(fold * 6) + INTERVAL 24 MONTH, least(s + to_months(fold * 6) + INTERVAL 30 MONTH, e)) >= 20)"""


def _folds(spark, d):
    return validation.make_folds(views.daily_bars(spark, d).agg(F.min("ts").alias("start"), F.max("ts").alias("end")), 24, 6)


@query("val02_make_folds", with_views("daily") + f", {_FOLDS} SELECT * FROM folds")
def folds(spark, d):
    return _folds(spark, d)


@query(
    "val03_fold_grid_metrics",
    with_views("daily", "trades") + f", {_FOLDS} SELECT fold, combo, count(*) AS n, round({_PF}, 6) AS pf FROM (SELECT *, l_suppkey % 12 AS combo FROM trades) t JOIN folds ON entry_time >= is_start AND entry_time < oos_start GROUP BY 1, 2",
)
def fold_metrics(spark, d):
    tagged = views.trades(spark, d).withColumn("combo", F.pmod("l_suppkey", F.lit(12)))
    return validation.fold_metrics(tagged, _folds(spark, d), "combo").select("fold", "combo", "n", F.round("pf", 6).alias("pf"))


@query("top01_best_combo", _T + _PERF + " SELECT fold, first(combo ORDER BY pf DESC, combo) AS combo, round(max(pf), 6) AS pf FROM perf WHERE isfinite(pf) GROUP BY 1")
def best_combo(spark, d):
    return validation.best_combo(_perf(spark, d)).withColumn("pf", F.round("pf", 6))


@query(
    "val05_plateau_select",
    _T + _PERF + """, c AS (SELECT fold, combo, combo % 4 AS a, combo // 4 AS b, pf FROM perf WHERE isfinite(pf)), lv AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY a) AS la, dense_rank() OVER (PARTITION BY fold ORDER BY b) AS lb FROM c),
    s AS (SELECT x.fold, x.combo, x.a, x.b, x.pf, coalesce(avg(CAST(y.pf > 1 AS DOUBLE)), 0.0) AS score FROM lv x LEFT JOIN lv y ON x.fold = y.fold AND abs(x.la - y.la) + abs(x.lb - y.lb) = 1 GROUP BY ALL)
    SELECT fold, combo, round(pf, 6) AS pf, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score >= 0.6 DESC, pf DESC, CASE WHEN score >= 0.6 THEN score END DESC NULLS LAST, a, b) = 1""",
)
def plateau_select(spark, d):
    cells = _perf(spark, d).withColumns({"a": F.col("combo") % 4, "b": F.floor(F.col("combo") / 4)})
    return validation.plateau(cells).select("fold", "combo", F.round("pf", 6).alias("pf"), F.round("score", 6).alias("score"))


_CHOSEN = ", best AS (SELECT fold, first(combo ORDER BY pf DESC, combo) AS combo, max(pf) AS pf FROM perf WHERE isfinite(pf) GROUP BY 1)"


@query("val06_oos_trades", _T + _PERF + _CHOSEN + " SELECT b.fold + 1 AS fold, t.symbol, t.exit_time, t.pnl, t.l_orderkey FROM trades t JOIN best b ON year(t.exit_time) * 4 + quarter(t.exit_time) - 1 = b.fold + 1 AND t.l_suppkey % 12 = b.combo")
def oos_trades(spark, d):
    best = validation.best_combo(_perf(spark, d)).select((F.col("fold") + 1).alias("fold"), "combo")
    tagged = views.trades(spark, d).withColumns({"fold": F.year("exit_time") * 4 + F.quarter("exit_time") - 1, "combo": F.pmod("l_suppkey", F.lit(12))})
    return tagged.join(F.broadcast(best), ["fold", "combo"]).select("fold", "symbol", "exit_time", "pnl", "l_orderkey")  # one row a fold


@query(
    "val07_wfe",
    _T + _PERF + _CHOSEN + ", r AS (SELECT o.pf / b.pf AS r FROM best b JOIN perf o ON o.fold = b.fold + 1 AND o.combo = b.combo WHERE b.pf > 0 AND isfinite(o.pf)) SELECT round(quantile_cont(r, 0.5), 6) AS wfe, round(avg(CAST(r >= 0.5 AS DOUBLE)), 6) AS share_half, count(*) AS n FROM r",
)
def wfe(spark, d):
    perf = _perf(spark, d)
    best = validation.best_combo(perf).select((F.col("fold") + 1).alias("fold"), "combo", F.col("pf").alias("is_pf"))
    return validation.walk_forward_efficiency(perf.withColumnRenamed("pf", "oos_pf").join(best, ["fold", "combo"]))


_TRIALS = 576
_NORMAL, _EULER = NormalDist(), 0.5772156649015329
#: Expected largest of _TRIALS standard normal values.
_BEST = (1 - _EULER) * _NORMAL.inv_cdf(1 - 1 / _TRIALS) + _EULER * _NORMAL.inv_cdf(1 - 1 / (_TRIALS * math.e))


@query(
    "val08_deflated_sharpe",
    _T + f""", m AS (SELECT symbol, count(pnl) AS t, avg(pnl) AS mean, stddev_samp(pnl) AS sd FROM trades GROUP BY 1),
    p AS (SELECT symbol, m.t, m.mean, m.sd, any_value(mean / nullif(sd, 0)) AS sr, avg((pnl - mean) ** 3) / nullif(avg((pnl - mean) ** 2), 0) ** 1.5 AS g, avg((pnl - mean) ** 4) / nullif(avg((pnl - mean) ** 2), 0) ** 2 AS k FROM trades JOIN m USING (symbol) GROUP BY 1, 2, 3, 4),
    w AS (SELECT *, (1 - g * sr + (k - 1) / 4 * sr * sr) / nullif(t - 1, 0) AS spread FROM p), z AS (SELECT *, CASE WHEN spread > 0 THEN sr / sqrt(spread) END - {_BEST!r} AS z FROM w)
    SELECT symbol, t, round(mean, 6) AS mean, round(CASE WHEN t < 3 OR coalesce(sd, 0) = 0 OR spread <= 0 THEN 0.0 WHEN z > 8 THEN 1.0 WHEN z < -8 THEN 0.0 ELSE 0.5 + CASE WHEN z = 0 THEN 0 ELSE exp(-z * z / 2) / sqrt(2 * pi()) * z
      * list_sum(list_transform(range(400), lambda i: exp(i * ln(z * z) - (i + 1) * ln(2) - lgamma(i + 1.5) + ln(pi()) / 2))) * 2 / 2 END END, 6) AS dsr FROM z""",
)  # the normal law as a series: z + z^3 / 3 + z^5 / (3 * 5) + ...; its 400 terms are enough up to 8, beyond which six decimals are 0 or 1
def deflated_sharpe(spark, d):
    return validation.deflated_sharpe(views.trades(spark, d), "symbol", "pnl", _TRIALS)


_MASKS = ", ".join(f"({i}, {b})" for i, chosen in enumerate(__import__("itertools").combinations(range(8), 4)) for b in chosen)


@query(
    "val09_pbo_cscv",
    _T + _PERF + f""", z AS (SELECT fold - (SELECT min(fold) FROM perf) AS t, combo, pf AS value FROM perf), q AS (SELECT max(t) + 1 AS n FROM z),
    bl AS (SELECT combo, CASE WHEN t < (n % 8) * (n // 8 + 1) THEN t // (n // 8 + 1) ELSE n % 8 + (t - (n % 8) * (n // 8 + 1)) // (n // 8) END AS block, value FROM z, q), s AS (SELECT combo, block, sum(value) AS s FROM bl GROUP BY 1, 2),
    m AS (SELECT * FROM (VALUES {_MASKS}) v(mask, block)), i AS (SELECT mask, combo, round(sum(s), 6) AS i FROM s JOIN m USING (block) GROUP BY 1, 2),
    o AS (SELECT mask, combo, i, round((SELECT sum(s) FROM s x WHERE x.combo = i.combo) - i, 6) AS o FROM i), b AS (SELECT mask, first(o ORDER BY i DESC, combo) AS bo FROM o GROUP BY 1),
    r AS (SELECT mask, count(*) FILTER (WHERE o < bo) + (count(*) FILTER (WHERE o = bo) + 1) / 2.0 AS rk, count(*) AS n FROM o JOIN b USING (mask) GROUP BY 1)
    SELECT round(avg(CAST(rk / (n + 1) < 0.5 AS DOUBLE)), 6) AS pbo, count(*) AS n_splits FROM r""",
)
def pbo(spark, d):
    perf = _perf(spark, d)
    first = perf.agg(F.min("fold").alias("f"))
    return validation.overfitting_probability(perf.join(F.broadcast(first)).select((F.col("fold") - F.col("f")).alias("t"), "combo", F.col("pf").alias("value")))  # one row


@query(
    "agg15_combo_correlation",
    _T + _PERF + " SELECT x.combo AS a, y.combo AS b, round(corr(x.pf, y.pf), 6) AS r FROM perf x JOIN perf y ON x.fold = y.fold AND x.combo < y.combo GROUP BY 1, 2",
)
def combo_correlation(spark, d):
    perf = _perf(spark, d)
    other = perf.select("fold", F.col("combo").alias("b"), F.col("pf").alias("y"))
    return perf.join(other, "fold").where("combo < b").groupBy(F.col("combo").alias("a"), "b").agg(F.round(F.corr("pf", "y"), 6).alias("r"))  # combos of one fold


@query("val10_resample_drawdown")
def resample(spark, d):
    return validation.resample_drawdown(views.trades(spark, d), "run_id")


@query("val11_block_bootstrap")
def bootstrap(spark, d):
    return validation.block_bootstrap(views.trades(spark, d), "run_id")


@query("val12_loss_limit_resample")
def limit_resample(spark, d):
    return validation.loss_limit_resample(views.trades(spark, d), "run_id", 100_000.0, 0.05, 0.1, 0.1, 60)


@query(
    "val13_gate_check",
    _T + f""", m AS (SELECT symbol, count(*) AS n, {_PF} AS pf, avg(r_multiple) AS mean_r FROM trades GROUP BY 1)
    SELECT symbol, gate, round(value, 6) AS value, passed FROM (SELECT symbol, 'min_trades' AS gate, CAST(n AS DOUBLE) AS value, n >= 200 AS passed FROM m UNION ALL SELECT symbol, 'profit_factor', pf, pf >= 1.3 FROM m UNION ALL SELECT symbol, 'mean_r', mean_r, mean_r >= 0.1 FROM m)""",
)
def gates(spark, d):
    metrics = views.trades(spark, d).groupBy("symbol").agg(F.count("*").cast("double").alias("min_trades"), profit_factor(F.col("pnl")).alias("profit_factor"), F.avg("r_multiple").alias("mean_r"))
    least = {"min_trades": 200.0, "profit_factor": 1.3, "mean_r": 0.1}
    long = metrics.unpivot("symbol", list(least), "gate", "value")
    limit = F.coalesce(*[F.when(F.col("gate") == g, F.lit(v)) for g, v in least.items()])
    return long.select("symbol", "gate", F.round("value", 6).alias("value"), (F.col("value") >= limit).alias("passed"))


@query(
    "val15_run_history_drift",
    _T + f""", h AS (SELECT symbol, year(exit_time) AS run, {_PF} AS pf, avg(CAST(pnl < 0 AS DOUBLE)) AS loss_rate FROM trades GROUP BY 1, 2)
    SELECT symbol, run, round(pf - lag(pf) OVER (PARTITION BY symbol ORDER BY run), 6) AS pf_change, round(corr(pf, loss_rate) OVER (PARTITION BY symbol), 6) AS r FROM h""",
)
def drift(spark, d):
    runs = views.trades(spark, d).groupBy("symbol", F.year("exit_time").alias("run")).agg(profit_factor(F.col("pnl")).alias("pf"), F.avg((F.col("pnl") < 0).cast("double")).alias("loss_rate"))
    change = F.col("pf") - F.lag("pf").over(Window.partitionBy("symbol").orderBy("run"))
    return runs.select("symbol", "run", F.round(change, 6).alias("pf_change"), F.round(F.corr("pf", "loss_rate").over(Window.partitionBy("symbol")), 6).alias("r"))


@query(
    "out12_loss_limit_flags",
    _T + f""", r AS (SELECT *, CAST(exit_time AS DATE) AS day, round(sum(pnl) OVER (PARTITION BY symbol ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 4) AS total,
      round(sum(pnl) OVER (PARTITION BY symbol, CAST(exit_time AS DATE) ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 4) AS today FROM trades),
    f AS (SELECT symbol, day, bool_or(-today >= 0.05 * (20000 + total - today)) AS hit, min(CASE WHEN -total >= 0.1 * 20000 THEN exit_time END) AS o FROM r GROUP BY 1, 2)
    SELECT symbol, count(*) FILTER (WHERE hit) AS days_hit, min(o) AS first_out FROM f GROUP BY 1""",
)
def loss_limits(spark, d):
    return ledger.loss_limits(views.trades(spark, d), "symbol", 20_000.0, 0.05, 0.1)


@query(
    "out11_equity_by_day",
    _T + f", {_DAILY} SELECT symbol, day, round(20000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS balance FROM dd",
)
def equity(spark, d):
    return ledger.equity_by_day(views.trades(spark, d), "symbol", 20_000.0).select("symbol", "day", F.round("balance", 4).alias("balance"))
