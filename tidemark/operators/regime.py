"""Two-state market regime: a Gaussian hidden Markov model, refitted on the past and filtered forward.

Time is cut to periods. A period's model is fitted on the bars of the `history` periods before it, so a bar takes part in a
bounded number of fits, and each (symbol, period) is a task of its own. The filter starts anew with each model, so periods
are filtered on their own, too; only the hysteresis goes on, of which a period is a function from state to state: these are
chained (a row a period) and applied.

Edge cases: bars without all features have no regime; a period whose past has fewer than `least` bars, or whose fit fails a
check (convergence, finite parameters, a state of more than a fiftieth of the bars, states that last), falls back to ADX.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import scan
from tidemark.operators.chunks import chunked
from tidemark.operators.stages import saved

FEATURES = ("move", "vol", "span")


def features(bars: DataFrame, vol_bars: int = 24) -> DataFrame:
    """symbol, ts, move (log return), vol (its deviation over vol_bars), span (ATR over close), adx."""
    table = scan.trend(bars.select("symbol", "ts", "open", "high", "low", "close", "tick_volume"), {})

    def near(rows: DataFrame) -> DataFrame:
        moved = rows.withColumn("move", ind.log_return())
        return moved.withColumns({"vol": ind.realized_vol("move", vol_bars), "span": F.col("atr") / F.col("close")})

    return chunked(table, near, before=vol_bars + 1).select("symbol", "ts", *FEATURES, "adx")


def _density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of each row under each state."""
    out = np.empty((len(x), 2))
    for s in range(2):
        low = np.linalg.cholesky(cov[s])
        z = np.linalg.solve(low, (x - mean[s]).T)
        out[:, s] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum()
    return out


def _forward(like: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered chances of each row, and the log likelihood up to a constant."""
    ahead, total = np.empty_like(like), 0.0
    a, b = float(start[0]), float(start[1])
    (m00, m01), (m10, m11) = move.tolist()
    for t, (p, q) in enumerate(like.tolist()):
        if t:
            a, b = a * m00 + b * m10, a * m01 + b * m11
        a, b = a * p, b * q
        scale = a + b
        a, b = (a / scale, b / scale) if scale > 0 else (0.5, 0.5)
        total += np.log(max(scale, 1e-300))
        ahead[t] = a, b
    return ahead, total


def fit(x: np.ndarray, rounds: int = 40, tolerance: float = 1e-3) -> tuple[dict | None, str]:
    """Model of standardised rows by expectation-maximisation, state 1 the one of wider moves; or why there is none."""
    n, width = x.shape
    wild = np.abs(x[:, 0]) + x[:, 1] > np.quantile(np.abs(x[:, 0]) + x[:, 1], 0.6)
    post = np.where(wild[:, None], [0.1, 0.9], [0.9, 0.1])
    start, move, before = np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.05, 0.95]]), -np.inf
    for _ in range(rounds):
        weight = post.sum(axis=0)
        mean = (post.T @ x) / weight[:, None]
        cov = np.stack([((post[:, s, None] * (x - mean[s])).T @ (x - mean[s])) / weight[s] + 1e-3 * np.eye(width) for s in range(2)])
        logs = _density(x, mean, cov)
        top = logs.max(axis=1, keepdims=True)
        like = np.exp(logs - top)
        ahead, total = _forward(like, start, move)
        total += float(top.sum())
        back = np.ones((n, 2))
        for t in range(n - 2, -1, -1):
            r = move @ (like[t + 1] * back[t + 1])
            back[t] = r / r.sum()
        post = ahead * back
        post /= post.sum(axis=1, keepdims=True)
        pair = ahead[:-1, :, None] * move * (like[1:] * back[1:])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        move = pair.sum(axis=0) + 1e-6
        move /= move.sum(axis=1, keepdims=True)
        start = post[0]
        if abs(total - before) < tolerance * n:
            break
        before = total
    else:
        return None, "not converged"
    if not all(np.isfinite(v).all() for v in (mean, cov, move)):
        return None, "not finite"
    state = post.argmax(axis=1)
    share = np.bincount(state, minlength=2) / n
    if share.min() <= 0.02:
        return None, "a state is hardly taken"
    if np.diag(move).min() <= 0.9:
        return None, "states do not last"
    flip = slice(None, None, 1 if x[state == 0, 0].var() <= x[state == 1, 0].var() else -1)
    return {"mean": mean[flip], "cov": cov[flip], "move": move[flip, flip], "start": start[flip]}, "ok"


def _regimes(chance: np.ndarray, proxy: np.ndarray, high: bool, enter: float, leave: float) -> tuple[list[str], bool]:
    """Regime of each bar from a state of the hysteresis, and the state after; bars without a chance go by the proxy."""
    out = []
    for p, trend in zip(chance, proxy, strict=True):
        if np.isnan(p):
            out.append("high" if trend else "low")
            continue
        high = p > leave if high else p >= enter
        out.append("high" if high else "low")
    return out, high


def two_state_regime(bars: DataFrame, vol_bars: int = 24, period_days: int = 30, history: int = 12, least: int = 500, enter: float = 0.6, leave: float = 0.4, adx: float = 25.0) -> DataFrame:
    """symbol, ts, p_high (filtered chance of the state of wider moves; null under the fall-back), regime, method (model or adx)."""
    table = features(bars, vol_bars).where(" AND ".join(f"{c} IS NOT NULL" for c in FEATURES))
    table = saved(table.withColumn("period", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (86_400 * period_days)).cast("int")))
    periods = table.select("symbol", F.col("period").alias("of")).distinct()
    past = table.withColumn("of", F.explode(F.sequence(F.col("period") + 1, F.col("period") + history))).join(periods, ["symbol", "of"], "left_semi")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")[list(FEATURES)].to_numpy(float)
        if len(x) < least:
            return pd.DataFrame(columns=["symbol", "period", "model"])
        centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
        model, _ = fit((x - centre) / spread)
        parts = [] if model is None else [np.concatenate([centre, spread, *(np.asarray(model[k], float).ravel() for k in ("mean", "cov", "move", "start"))]).tolist()]
        return pd.DataFrame([(pdf["symbol"].iloc[0], int(pdf["of"].iloc[0]), p) for p in parts], columns=["symbol", "period", "model"])

    models = past.groupBy("symbol", "of").applyInPandas(learn, "symbol string, period int, model array<double>")

    def chances(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        flat, chance = pdf["model"].iloc[0], np.full(len(pdf), np.nan)
        if flat is not None and len(flat):
            flat, k = np.asarray(flat, float), len(FEATURES)
            cuts = np.cumsum([k, k, 2 * k, 2 * k * k, 4, 2])
            centre, spread, mean, cov, move, start = np.split(flat, cuts[:-1])
            logs = _density((pdf[list(FEATURES)].to_numpy(float) - centre) / spread, mean.reshape(2, k), cov.reshape(2, k, k))
            chance = _forward(np.exp(logs - logs.max(axis=1, keepdims=True)), start, move.reshape(2, 2))[0][:, 1]
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "period": pdf["period"], "trend": (pdf["adx"] > adx).fillna(False), "chance": chance})

    filtered = saved(table.join(models, ["symbol", "period"], "left").groupBy("symbol", "period").applyInPandas(chances, "symbol string, ts timestamp_ntz, period int, trend boolean, chance double"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        after = [_regimes(pdf["chance"].to_numpy(float), pdf["trend"].to_numpy(bool), s, enter, leave)[1] for s in (False, True)]
        return pd.DataFrame([(pdf["symbol"].iloc[0], int(pdf["period"].iloc[0]), *after)], columns=["symbol", "period", "low", "high"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, out = pdf.sort_values("period"), False, []
        for low, high in zip(pdf["low"], pdf["high"], strict=True):
            out.append(now)
            now = bool(high if now else low)
        return pdf[["symbol", "period"]].assign(begins=out)

    begins = filtered.groupBy("symbol", "period").applyInPandas(ends, "symbol string, period int, low boolean, high boolean").groupBy("symbol").applyInPandas(chain, "symbol string, period int, begins boolean")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        regime, _ = _regimes(pdf["chance"].to_numpy(float), pdf["trend"].to_numpy(bool), bool(pdf["begins"].iloc[0]), enter, leave)
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "p_high": pdf["chance"], "regime": regime, "method": np.where(np.isnan(pdf["chance"].to_numpy(float)), "adx", "model")})

    out = filtered.join(begins, ["symbol", "period"]).groupBy("symbol", "period").applyInPandas(finish, "symbol string, ts timestamp_ntz, p_high double, regime string, method string")
    return out.withColumn("p_high", F.when(~F.isnan("p_high"), F.col("p_high")))
