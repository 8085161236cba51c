"""Row patterns over series: ordered steps, each within so many rows of the step before, with skip rules.

Three parts, each split over long series:

* `match` finds, for every row that fulfils the first step, the first later row that fulfils the second, and so on. A match
  spans at most the sum of the steps' reaches, so series are cut to chunks that also see the rows a match may reach.
* `unblocked` is the skip rule: hits in order, each of which blocks its series until it is free again (until the match's last
  row, or for some minutes). What a hit does depends on all before it, but a chunk of hits is a function from the moment the
  series is free to the moment it is free after the chunk. These functions are computed on their own, chained (a row a
  chunk), and each chunk runs again from its true start.
* `fold_sessions` runs an automaton over the rows of one session (a local day), which are few by nature.

Edge cases: rows of one time are taken in the order given by `ties`; a null condition is not fulfilled; sessions or series
without rows give nothing; results do not depend on the chunk lengths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import chunks
from tidemark.operators.indicators import order
from tidemark.operators.stages import saved

#: Hits are dealt to chunks of this many rows, or days, of their series.
CHUNK_ROWS, CHUNK_DAYS = 100_000, 30


@dataclass(frozen=True)
class Step:
    """A later step of a pattern: `when(row, seen)` on a row at most `within` rows after the step before.

    row and seen[name] (rows of earlier steps, the first one's name is "start") are structs of the fields that match() keeps.
    """

    name: str
    within: int
    when: Callable[[Column, dict[str, Column]], Column]


def _walk(fields: list[str], steps: list[Step], start: Column, ahead: Column, kind: str) -> Column:
    """Struct of the steps' rows, with null for those not reached, from the start row and the rows after it."""
    none = F.lit(None).cast(kind)
    state = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("at"), F.lit(0).alias("done"), *[none.alias(s.name) for s in steps])

    def advance(now: Column, row: Column) -> Column:
        pos = now["pos"] + 1
        seen = {"start": start} | {s.name: now[s.name] for s in steps}
        hit = F.lit(False)
        for i, s in enumerate(steps):
            hit = F.when((now["done"] == i) & (pos - now["at"] <= s.within), F.coalesce(s.when(row, seen), F.lit(False))).otherwise(hit)
        return F.struct(
            pos.alias("pos"), F.when(hit, pos).otherwise(now["at"]).alias("at"), F.when(hit, now["done"] + 1).otherwise(now["done"]).alias("done"),
            *[F.when(hit & (now["done"] == i), row).otherwise(now[s.name]).alias(s.name) for i, s in enumerate(steps)],
        )

    return F.aggregate(ahead, state, advance)


def match(bars: DataFrame, start: Column, steps: list[Step], fields: list[str], chunk_rows: int = CHUNK_ROWS, partial: bool = False) -> DataFrame:
    """symbol, start, one column per step (structs of `fields`, with ts and the row number k) of all matches.

    bars (symbol, ts, ...); a match whose steps are not all reached goes, unless `partial`.
    """
    reach = sum(s.within for s in steps)
    kept = list(dict.fromkeys(["ts", "k", *fields]))

    def find(table: DataFrame) -> DataFrame:
        here = table.withColumn("__row", F.struct(*kept))
        kind = here.schema["__row"].dataType.simpleString()
        found = here.withColumn("__ahead", F.collect_list("__row").over(order().rowsBetween(1, reach))).where(F.coalesce(start, F.lit(False)))
        walked = found.withColumn("__w", _walk(fields, steps, F.col("__row"), F.col("__ahead"), kind))
        keep = [c for c in ("__symbol", "__keep") if c in table.columns]
        return walked.where(F.lit(partial) | (F.col("__w.done") == len(steps))).select("symbol", *keep, F.col("__row").alias("start"), *[F.col(f"__w.{s.name}").alias(s.name) for s in steps])

    numbered = bars if "k" in bars.columns else chunks.row_numbers(bars)
    return chunks.chunked(numbered, find, before=0, after=reach, chunk_rows=chunk_rows, number="k")


def _follow(starts: np.ndarray, free: np.ndarray) -> np.ndarray:
    """For each hit the first later one that it does not block (len(starts): none)."""
    return np.maximum(np.searchsorted(starts, free, "left"), np.arange(1, len(starts) + 1))


def unblocked(hits: DataFrame, by: list[str], start: str, free: str, ties: list[str], width: int) -> DataFrame:
    """hits without those whose `start` lies before the `free` of the last hit of their series that stays.

    start and free are longs (row numbers or microseconds); width is a chunk's length in them.
    """
    dealt = saved(hits.withColumn("__chunk", F.floor(F.col(start) / width)))  # read twice below
    sorting = ["__s", *[f"__t{i}" for i in range(len(ties))]]
    keyed = dealt.select(*by, "__chunk", F.col(start).cast("long").alias("__s"), F.col(free).cast("long").alias("__f"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)])
    series = ", ".join(f"`{b}` {dict(hits.dtypes)[b]}" for b in by)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        """entries: latest free moments that lead to each end; ends: free moments after the chunk."""
        pdf = pdf.sort_values(sorting, kind="stable")
        s, f = pdf["__s"].to_numpy(np.int64), pdf["__f"].to_numpy(np.int64)
        after = _follow(s, f)
        end = f.copy()
        for i in range(len(s) - 1, -1, -1):
            if after[i] < len(s):
                end[i] = end[after[i]]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])  # of hits of one moment the first is met
        s, end = s[first], end[first]
        last = np.flatnonzero(np.r_[end[1:] != end[:-1], True])  # moments that lead to one end are one entry
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "__chunk": pdf["__chunk"].iloc[0], "entries": s[last].tolist(), "ends": end[last].tolist()}])

    parts = keyed.groupBy(*by, "__chunk").applyInPandas(summarise, f"{series}, __chunk long, entries array<long>, ends array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")  # a row a chunk
        now, out = np.iinfo(np.int64).min, []
        for entries, ends in zip(pdf["entries"], pdf["ends"], strict=True):
            out.append(now)
            at = int(np.searchsorted(np.asarray(entries), now, "left"))
            now = int(ends[at]) if at < len(ends) else now
        return pdf[[*by, "__chunk"]].assign(__begins=out)

    starts = parts.groupBy(*by).applyInPandas(chain, f"{series}, __chunk long, __begins long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)
    columns = hits.columns

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, *ties], kind="stable")
        s, f = pdf[start].to_numpy(np.int64), pdf[free].to_numpy(np.int64)
        after, kept, at = _follow(s, f), [], int(np.searchsorted(s, int(pdf["__begins"].iloc[0]), "left"))
        while at < len(s):
            kept.append(at)
            at = int(after[at])
        return pdf.iloc[kept][columns]

    return dealt.join(starts, [*by, "__chunk"]).groupBy(*by, "__chunk").applyInPandas(finish, schema)


def fold_sessions(rows: DataFrame, by: list[str], fields: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """by, state: an automaton over the rows of each session in order of ts; step(state, row) has the type of `start`."""
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys(["ts", *fields])))).alias("__rows"))
    return listed.select(*by, F.aggregate("__rows", start, step).alias("state"))
