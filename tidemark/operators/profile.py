"""Volume profiles: volume by price bin within a key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.stages import saved


#: Rows between two checkpoints of running histograms. The results do not depend on it.
BLOCK = 256


def spread(bars: DataFrame, keys: list[str], width: float | Column) -> DataFrame:
    """keys, bin, volume of every bar and bin of its price range, by overlap; a bar without range falls in one bin."""
    w = F.lit(width) if not isinstance(width, Column) else width
    first, last = F.floor(F.col("low") / w), F.floor(F.col("high") / w)
    dealt = bars.select(*keys, "low", "high", "tick_volume", w.alias("__w"), F.explode(F.sequence(first, last)).alias("bin"))
    overlap = F.greatest(F.lit(0.0), F.least(F.col("high"), (F.col("bin") + 1) * F.col("__w")) - F.greatest(F.col("low"), F.col("bin") * F.col("__w")))
    part = F.when(F.col("high") > F.col("low"), F.col("tick_volume") * overlap / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))).otherwise(F.col("tick_volume"))
    return dealt.select(*keys, "bin", part.alias("volume"))


def bins(bars: DataFrame, keys: list[str], width: float | Column) -> DataFrame:
    """keys, bin, volume: each bar's volume is spread over its price range."""
    return spread(bars, keys, width).groupBy(*keys, "bin").agg(F.sum("volume").alias("volume"))


def window_profiles(bars: DataFrame, windows: DataFrame, width: float, block: int = BLOCK) -> DataFrame:
    """windows (symbol, id, first, last: row numbers, both included) over bars (symbol, k, ...) -> symbol, id, bin, volume.

    A window's profile is the difference of two running histograms. These are kept at every block of rows; what a window's end
    lies beyond a checkpoint is added from the rows of that block. So the work follows the number of windows, not their length.
    Bins are told apart from rounding by counting bars, too.
    """
    rows = spread(bars, ["symbol", "k"], width).withColumn("__b", F.floor((F.col("k") - 1) / block).cast("long"))
    rows = saved(rows)  # read twice below
    blocks = rows.groupBy("symbol", "bin", "__b").agg(F.sum("volume").alias("v"), F.count("*").alias("n"))
    line = Window.partitionBy("symbol", "bin").orderBy("__b")  # a row a block
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    most = rows.groupBy("symbol").agg(F.max("__b").alias("__most"))
    running = blocks.select("symbol", "bin", "__b", F.sum("v").over(so_far).alias("v"), F.sum("n").over(so_far).alias("n"), F.lead("__b").over(line).alias("__next")).join(most, "symbol")
    kept = running.select("symbol", "bin", "v", "n", F.explode(F.sequence(F.col("__b") + 1, F.coalesce("__next", F.col("__most") + 1))).alias("__b"))
    ends = F.array(F.struct(F.col("last").alias("x"), F.lit(1).alias("sign")), F.struct((F.col("first") - 1).alias("x"), F.lit(-1).alias("sign")))
    points = windows.select("symbol", "id", F.explode(ends).alias("e")).select("symbol", "id", "e.x", "e.sign").where("x > 0").withColumn("__b", F.floor(F.col("x") / block).cast("long"))
    whole = points.join(kept, ["symbol", "__b"]).select("symbol", "id", "bin", (F.col("sign") * F.col("v")).alias("v"), (F.col("sign") * F.col("n")).alias("n"))
    part = points.join(rows, ["symbol", "__b"]).where("k <= x").select("symbol", "id", "bin", (F.col("sign") * F.col("volume")).alias("v"), F.col("sign").cast("long").alias("n"))
    both = whole.unionByName(part).groupBy("symbol", "id", "bin").agg(F.sum("v").alias("volume"), F.sum("n").alias("n"))
    return both.where("n > 0").select("symbol", "id", "bin", "volume")


def poc(volumes: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Middle of the fullest bin, the lowest of equals."""
    return volumes.groupBy(*keys).agg(((F.max_by("bin", F.struct(F.round("volume", 6), -F.col("bin"))) + 0.5) * width).alias("poc"))


def value_area(volumes: DataFrame, keys: list[str], width: float, share: float = 0.7) -> DataFrame:
    """Bins around the fullest that hold the share: the larger neighbour joins first, ties go down. keys, va_low, va_high."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        low_bin, n = int(pdf["bin"].iloc[0]), int(pdf["bin"].iloc[-1] - pdf["bin"].iloc[0]) + 1
        volume = [0.0] * n
        for b, v in zip(pdf["bin"], pdf["volume"], strict=True):
            volume[int(b) - low_bin] = round(v, 6)
        a = b = max(range(n), key=lambda i: (volume[i], -i))
        held, goal = volume[a], share * sum(volume)
        while held < goal and (a > 0 or b < n - 1):
            below, above = volume[a - 1] if a > 0 else -1.0, volume[b + 1] if b < n - 1 else -1.0
            if below >= above:
                a, held = a - 1, held + below
            else:
                b, held = b + 1, held + above
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "va_low": (low_bin + a) * width, "va_high": (low_bin + b + 1) * width}])

    types = dict(volumes.dtypes)
    return volumes.groupBy(*keys).applyInPandas(grow, ", ".join(f"{k} {types[k]}" for k in keys) + ", va_low double, va_high double")


def nodes(volumes: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Mid prices of bins above 1.5 x and below 0.5 x the median volume: high_nodes, low_nodes."""
    medians = volumes.groupBy(*keys).agg(F.percentile("volume", 0.5).alias("m"))
    mid = (F.col("bin") + 0.5) * width
    v = F.round("volume", 6)
    return volumes.join(medians, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(v > F.round(1.5 * F.col("m"), 6), mid))).alias("high_nodes"), F.array_sort(F.collect_list(F.when(v < F.round(0.5 * F.col("m"), 6), mid))).alias("low_nodes")
    )


def entry_gate(price: Column, poc_price: Column, high_nodes: Column, low_nodes: Column, distance: Column) -> Column:
    """`ok` near the POC or a high node, `low_volume` near a low node, else `far`."""
    near = lambda nodes: F.coalesce(F.array_min(F.transform(nodes, lambda n: F.abs(n - price))) <= distance, F.lit(False))
    return F.when(near(low_nodes), "low_volume").when((F.abs(price - poc_price) <= distance) | near(high_nodes), "ok").otherwise("far")


def structural_stop(stop: Column, direction: Column, va_low: Column, va_high: Column, buffer: Column) -> Column:
    """Stop moved behind the value area where that is wider."""
    return F.when(direction == 1, F.least(stop, va_low - buffer)).otherwise(F.greatest(stop, va_high + buffer))
