"""Pieces of DuckDB SQL for the oracles: recurrences over the k-th valid row of each symbol."""

from __future__ import annotations

from tidemark.sources.views import SQL, bars_sql


def with_bars(*more: str, tf: str = "H1") -> str:
    """WITH RECURSIVE clause: ticks, bars b, and further common table expressions."""
    return "WITH RECURSIVE " + ",\n".join([SQL["ticks"], bars_sql(tf, "b"), *more]) + "\n"


def with_daily(*more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([SQL["daily"].replace("daily AS", "b AS", 1), *more]) + "\n"


def ema(name: str, source: str, x: str, n: int) -> str:
    """name(symbol, ts, y): exponential mean, null for the first n - 1 valid rows."""
    a = f"(2.0/{n + 1})"
    return f"""{name}_v AS (SELECT symbol, ts, CAST({x} AS DOUBLE) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {source} WHERE {x} IS NOT NULL),
    {name}_r AS (SELECT symbol, ts, k, x AS y FROM {name}_v WHERE k = 1 UNION ALL
      SELECT v.symbol, v.ts, v.k, (1 - {a}) * r.y + {a} * v.x FROM {name}_r r JOIN {name}_v v ON v.symbol = r.symbol AND v.k = r.k + 1),
    {name} AS (SELECT symbol, ts, CASE WHEN k >= {n} THEN y END AS y FROM {name}_r)"""


def wilder(name: str, source: str, x: str, n: int) -> str:
    """name(symbol, ts, y): Wilder's mean, from the mean of the first n valid rows on."""
    return f"""{name}_v AS (SELECT symbol, ts, CAST({x} AS DOUBLE) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {source} WHERE {x} IS NOT NULL),
    {name}_s AS (SELECT symbol, avg(x) AS y FROM {name}_v WHERE k <= {n} GROUP BY symbol HAVING count(*) = {n}),
    {name} AS (SELECT v.symbol, v.ts, v.k, s.y FROM {name}_v v JOIN {name}_s s USING (symbol) WHERE k = {n} UNION ALL
      SELECT v.symbol, v.ts, v.k, (r.y * {n - 1} + v.x) / {n} FROM {name} r JOIN {name}_v v ON v.symbol = r.symbol AND v.k = r.k + 1)"""


TR = """tr AS (SELECT symbol, ts, open, high, low, close, tick_volume, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def atr(n: int = 14) -> str:
    """CTEs up to atr(symbol, ts, y)."""
    return TR + ",\n" + wilder("atr", "tr", "tr", n)


CHANGE = """ch AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM b),
  gl AS (SELECT symbol, ts, greatest(d, 0.0) AS g, greatest(-d, 0.0) AS l FROM ch WHERE d IS NOT NULL)"""


def rsi(n: int = 14, name: str = "rsi") -> str:
    """CTEs up to rsi(symbol, ts, y); under another name without those that all lengths share."""
    more = "" if name == "rsi" else name
    return f"""{"" if more else CHANGE + ","} {wilder("wg" + more, "gl", "g", n)}, {wilder("wl" + more, "gl", "l", n)},
    {name} AS (SELECT g.symbol, g.ts, CASE WHEN g.y = 0 AND l.y = 0 THEN 50.0 WHEN l.y = 0 THEN 100.0 WHEN g.y = 0 THEN 0.0 ELSE 100 - 100 / (1 + g.y / l.y) END AS y FROM wg{more} g JOIN wl{more} l USING (symbol, ts))"""


def adx(n: int = 14) -> str:
    """CTEs up to di(symbol, ts, p, m, dx) and adx(symbol, ts, y)."""
    return f"""{TR}, mv AS (SELECT symbol, ts, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    dm AS (SELECT symbol, ts, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS m FROM mv WHERE up IS NOT NULL),
    {wilder("wa", "tr", "tr", n)}, {wilder("wp", "dm", "p", n)}, {wilder("wm", "dm", "m", n)},
    di AS (SELECT p.symbol, p.ts, 100 * p.y / a.y AS p, 100 * m.y / a.y AS m, 100 * abs(p.y - m.y) / nullif(p.y + m.y, 0) AS dx FROM wp p JOIN wm m USING (symbol, ts) JOIN wa a USING (symbol, ts)),
    {wilder("adx", "di", "dx", n)}"""
