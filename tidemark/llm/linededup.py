"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. A line's frequency is the number of the host's pages that contain it, divided by the number
of the host's pages; lines above a ratio are boilerplate of that host and go from all its pages. Lines are compared
trimmed; blank lines are never dropped. A page counts once however often it repeats the line.

Counts combine before the shuffle and are keyed by (host, line), so a hot host spreads over its lines. A host has at
most (mean lines of its pages) / ratio boilerplate lines, so their list fits a row. All lists together are broadcast if
their counted size is within a bound, and no page is shuffled then; beyond it pages are joined by host and part: a host
with more than an even share of the pages is dealt to all shuffle partitions (there are fewer such hosts than partitions),
any other host stays in one part, so its list is not copied.

Edge cases: null text stays null; rows with a null host form one host; a page that loses all lines keeps an empty text;
lines at exactly the ratio stay; hosts with fewer than min_pages pages containing a line never lose it; repeated rows are pages of their own; very long texts are
split whole; an empty table stays empty; extra columns of any name stay, but for the two that drop_boilerplate adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import n_tasks, saved, unnamed

#: Largest share of a host's pages that an ordinary line is on, and the fewest pages that make a line boilerplate.
RATIO, MIN_PAGES = 0.1, 5
#: Boilerplate lines (hashes of 8 bytes) of all hosts together that may be broadcast.
MAX_BROADCAST = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _marks(lines: Column) -> Column:
    """A hash of each line's trimmed text; blank lines have none."""
    return F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x))


def boilerplate(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, marks: the hashes of each host's boilerplate lines."""
    per_host = pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"))
    lines = pages.select(host.alias("host"), F.explode(F.array_distinct(_marks(_lines(F.col(text))))).alias("mark"))
    counted = lines.groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counted.join(per_host, counted["host"].eqNullSafe(per_host["host"])).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy(counted["host"]).agg(F.array_sort(F.collect_list("mark")).alias("marks"))


def drop_boilerplate(pages: DataFrame, host: Column | None = None, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All columns of pages with the boilerplate lines cut from text, and __n_lines, __n_dropped (in place of such columns)."""
    judged, back = _judged(pages, F.col("source") if host is None else host, text, ratio, min_pages, max_broadcast)
    own = [c for c in pages.columns if c not in ("__n_lines", "__n_dropped")]
    counts = judged.select(*judged.columns[:-2], F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"))
    return counts.select(*[F.col(f"c{pages.columns.index(c)}").alias(c) for c in own], "__n_lines", "__n_dropped")


def cut_lines(pages: DataFrame, host: Column | None = None, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages with the boilerplate lines cut from text, and nothing else changed."""
    judged, back = _judged(pages, F.col("source") if host is None else host, text, ratio, min_pages, max_broadcast)
    return back(judged)


def _judged(named: DataFrame, by: Column, called: str, ratio: float, min_pages: int, max_broadcast: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The columns of pages as c0, c1, ... (text cut), n_lines and n_dropped; and what names them again."""
    _, (text,), back = unnamed(named, called)
    pages = named.select(by.alias("host"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(named.columns)])
    host = F.col("host")
    marks = saved(boilerplate(pages, host, text, ratio, min_pages)).select(F.col("host").alias("__host"), F.col("marks").alias("__marks"))
    if (marks.agg(F.sum(F.size("__marks"))).first()[0] or 0) <= max_broadcast:
        joined = pages.join(F.broadcast(marks), host.eqNullSafe(F.col("__host")), "left")
    else:
        parts, total = n_tasks(pages.sparkSession), pages.count()
        hot = pages.groupBy(host.alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") * parts > total)
        hot = F.broadcast(saved(hot.select("__hot", F.lit(parts).alias("__parts"))))  # fewer rows than parts
        dealt = marks.join(hot, F.col("__host").eqNullSafe(F.col("__hot")), "left").select("__host", "__marks", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__to"))
        salted = pages.join(hot, host.eqNullSafe(F.col("__hot")), "left").withColumn("__part", F.pmod(F.xxhash64(pages[text]), F.coalesce("__parts", F.lit(1))).cast("int"))
        joined = salted.join(dealt, host.eqNullSafe(F.col("__host")) & (F.col("__part") == F.col("__to")), "left")
    lines = _lines(F.col(text))
    stay = F.filter(lines, lambda x: ~F.array_contains(F.col("__marks"), F.xxhash64(F.trim(x))) | (F.trim(x) == ""))
    cut = F.col("__marks").isNotNull()
    return joined.select(
        *[F.when(cut, F.array_join(stay, "\n")).otherwise(F.col(text)).alias(text) if c == text else pages[c] for c in pages.columns[1:]],
        F.size(lines).alias("n_lines"),
        F.when(cut, F.size(lines) - F.size(stay)).otherwise(F.lit(0)).alias("n_dropped"),
    ), back
