"""As-of, interval and range joins that never compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Days of a slice of the as-of join. The result does not depend on it.
SLICE_DAYS = 30


def asof(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str], strict: bool = False, slice_days: int = SLICE_DAYS, ahead: bool = False) -> DataFrame:
    """left with the values of the latest right row at or before its time (strictly before if asked), per key; if `ahead`, of the
    first right row at or after its time.

    Both sides are put in one ordered stream per key and slice of time and the last right row is carried forward in it, so a
    key that holds most rows is many tasks. What a slice starts with is the last right row of the slices before it, found
    among one row a slice. Left rows without a time find nothing.
    """
    tag = 1 if not strict else -1
    part = F.floor(F.unix_timestamp(F.col("__t").cast("timestamp")) / (86_400 * slice_days)).alias("__slice")
    row = F.struct(*[F.col(v) for v in values])
    events = right.select(F.col(on), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), row.alias("__value")).where("__t IS NOT NULL").select("*", part)
    kind = events.schema["__value"].dataType
    wide = left.select(F.col(on), F.col(left_time).alias("__t"), F.lit(tag).alias("__side"), F.lit(None).cast(kind).alias("__value"), F.struct(*[c for c in left.columns if c != on]).alias("__left")).select("*", part)
    both = wide.unionByName(events.withColumn("__left", F.lit(None).cast(wide.schema["__left"].dataType)))
    toward = F.desc if ahead else F.asc
    inside = Window.partitionBy(on, "__slice").orderBy(toward("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    ends = events.groupBy(on, "__slice").agg((F.min_by if ahead else F.max_by)("__value", "__t").alias("__last"))
    asked = wide.select(on, "__slice").distinct().withColumn("__last", F.lit(None).cast(kind))
    slices = asked.unionByName(ends).groupBy(on, "__slice").agg(F.first("__last", ignorenulls=True).alias("__last"))
    earlier = Window.partitionBy(on).orderBy(toward("__slice")).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    starts = slices.select(F.col(on).alias("__on"), F.col("__slice").alias("__own"), F.last("__last", ignorenulls=True).over(earlier).alias("__start"))
    found = both.withColumn("__found", F.last("__value", ignorenulls=True).over(inside)).where(F.col("__side") == tag)
    out = found.join(starts, found[on].eqNullSafe(F.col("__on")) & (found["__slice"] == F.col("__own")), "left")
    out = out.withColumn("__found", F.when(F.col("__t").isNotNull(), F.coalesce("__found", "__start")))
    return out.select(on, "__left.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def hours_touched(start: Column, end: Column) -> Column:
    """Hour numbers that [start, end] touches; the key of the range joins below."""
    hour = lambda t: F.floor(F.unix_timestamp(t.cast("timestamp")) / 3600)
    return F.sequence(hour(start), hour(end))


def flag_in_windows(rows: DataFrame, time: str, windows: DataFrame, flag: str, on: list[tuple[str, str]] | None = None, key: list[str] | None = None) -> DataFrame:
    """rows with a flag: the time lies in some window [start, end], both ends included, of equal keys `on` (pairs of names).

    Windows are dealt to the hours they touch, so the join has an equality on the hour; `key` identifies a row.
    """
    key = key or ["symbol", time]
    pairs = on or []
    dealt = windows.select("start", "end", *[F.col(b).alias(f"__{b}") for _, b in pairs], F.explode(hours_touched(F.col("start"), F.col("end"))).alias("__hour"))
    timed = rows.select(*dict.fromkeys([*key, time, *[a for a, _ in pairs]])).withColumn("__hour", F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / 3600))
    match = timed["__hour"] == dealt["__hour"]
    for a, b in pairs:
        match &= timed[a] == dealt[f"__{b}"]
    inside = (timed[time] >= dealt["start"]) & (timed[time] <= dealt["end"])
    hit = timed.join(dealt, match & inside, "left_semi").select(*key).distinct().withColumn(flag, F.lit(True))
    return rows.join(hit, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def blackout_windows(calendar: DataFrame, before: int = 15, after: int = 10) -> DataFrame:
    """start, end around each timed event, in minutes."""
    minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    return calendar.where(F.col("time_utc").isNotNull()).withColumns({"start": F.col("time_utc") - minutes(before), "end": F.col("time_utc") + minutes(after)})


def align_timeframes(primary: DataFrame, higher: DataFrame, primary_minutes: int, higher_minutes: int, values: list[str]) -> DataFrame:
    """Latest higher-timeframe bar that has closed by the close of each primary bar."""
    step = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    left = primary.withColumn("close_ts", F.col("ts") + step(primary_minutes))
    right = higher.withColumn("close_ts", F.col("ts") + step(higher_minutes))
    return asof(left, right, "symbol", "close_ts", "close_ts", values)
