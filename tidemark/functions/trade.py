"""Scalar rules of positions, parameters and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lots(risk_money: Column, distance: Column, point_value: Column, step: float, least: float, most: float) -> Column:
    """Size whose loss at the stop is the risk: floored to the volume step, then held within the limits."""
    raw = F.try_divide(risk_money, distance * point_value)
    return F.round(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(raw / step + 1e-12) * step)), 8)


def fill_price(price: Column, direction: Column, spread_points: Column, point: Column, factor: float = 1.0, extra_points: float = 0.0) -> Column:
    """Price after half the spread (times a stress factor) and extra slippage against the position."""
    return price + direction * point * (spread_points * factor / 2 + extra_points)


def swap_nights(entry: Column, exit: Column, triple_weekday: int = 4) -> Column:
    """Midnights that a position is held over; the one that ends the triple weekday (Spark's dayofweek) counts three."""
    first, last = F.date_add(F.to_date(entry), 1), F.to_date(exit)
    nights = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return F.aggregate(nights, F.lit(0), lambda n, d: n + F.when(F.dayofweek(F.date_sub(d, 1)) == triple_weekday, 3).otherwise(1))


def as_flag(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("on", "true", "1", "yes")


def rule_key(dotted: Column) -> Column:
    """Last part of a dotted path."""
    return F.element_at(F.split(dotted, r"\."), -1)


def pips(distance: Column, pip_size: float) -> Column:
    return distance / pip_size


def merged_params(base: Column, override: Column) -> Column:
    """Two parameter maps; the second wins, keys keep the order of the first."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def profit_factor(pnl: Column) -> Column:
    """Aggregate: gains over losses; infinite without losses if there is a gain, else 0."""
    gain = F.sum(F.when(pnl > 0, pnl).otherwise(0.0))
    loss = F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    return F.when(loss > 0, gain / F.when(loss > 0, loss)).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)


#: The currencies of known symbols.
SYMBOL_CURRENCIES = {
    "XAUUSD": ["USD"], "NAS100": ["USD"], "US100": ["USD"], "EURUSD": ["EUR", "USD"], "GBPUSD": ["GBP", "USD"], "USDJPY": ["USD", "JPY"], "USDCHF": ["USD", "CHF"], "AUDUSD": ["AUD", "USD"],
    "USDCAD": ["USD", "CAD"], "NZDUSD": ["NZD", "USD"], "EURJPY": ["EUR", "JPY"], "GBPJPY": ["GBP", "JPY"], "BTC": ["USD"], "ETH": ["USD"], "BTCUSD": ["USD"], "ETHUSD": ["USD"],
}


def currencies(symbol: Column) -> Column:
    """Sorted currencies of a symbol, whatever its case and suffix: the fixed ones, else the halves of six letters, else none."""
    name = F.substring_index(F.upper(symbol), ".", 1)
    fixed = F.create_map(*[part for s, c in SYMBOL_CURRENCIES.items() for part in (F.lit(s), F.array(*map(F.lit, c)))])
    halves = F.when(name.rlike(r"^\p{L}{6}$"), F.array(F.substring(name, 1, 3), F.substring(name, 4, 3)))
    return F.array_sort(F.array_distinct(F.coalesce(F.try_element_at(fixed, name), halves, F.array().cast("array<string>"))))
