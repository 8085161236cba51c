"""I-Match fingerprints with randomised lexicon subsets, with DataFrame functions only.

The lexicon holds the terms whose document share lies in a band, i.e. whose inverse document frequency does. Shares sum
to the mean number of distinct terms of a document, so at most (that mean) / LOW_SHARE terms are in the band; the count is
checked before the lexicon is broadcast, and beyond MAX_BROADCAST it is joined by a shuffle. A fingerprint hashes the
sorted distinct lexicon terms of a text once for each random subset of the lexicon. Subsets come in several rates:
dense ones change with nearly every edit, sparse ones survive large edits. Likeness of two fingerprints is the share of
equal subset hashes among the subsets that hold a term of either.

Edge cases: null text is empty; a text without lexicon terms is fingerprinted by a hash of the whole text (likeness to
any other text 0, to an equal one 1); rows with equal ids follow each other by a hash of their text; a null id sorts
first; a single document is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import saved

#: Band of document shares, and the fewest documents of a term.
LOW_SHARE, HIGH_SHARE, MIN_DOCS = 0.001, 0.25, 2
#: Terms that may be broadcast.
MAX_BROADCAST = 400_000
#: Of each subset, log2 of the rate's inverse.
RATES = (1, 2, 4, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 9, 9)
#: Rows of an ordering bucket, about, and buckets at most (a larger corpus gets larger buckets).
BUCKET_ROWS, MAX_BUCKETS = 2000, 100_000


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, h (its hash, which also orders terms), mask (bit r: it is in subset r)."""
    total = docs.count()
    shares = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = shares.where((F.col("n") >= max(MIN_DOCS, math.ceil(LOW_SHARE * total))) & (F.col("n") <= max(MIN_DOCS, HIGH_SHARE * total)))
    mask = F.lit(0)
    for r, rate in enumerate(RATES):
        mask = mask + F.when(F.pmod(F.xxhash64(F.lit(r), "term"), F.lit(1 << rate)) == 0, 1 << r).otherwise(0)
    return band.select("term", F.xxhash64("term").alias("h"), mask.cast("int").alias("mask"))


def _of(ordered: Column, bits: int) -> Column:
    """Elements of a list of (h, m) whose m has one of the bits."""
    return F.filter(ordered, lambda t: t["m"].bitwiseAND(F.lit(bits).cast("long")) != 0)


def _signature(groups: dict[int, Column], shift: int) -> Column:
    """Per subset the hash of its terms, null without terms. groups: by rate the sorted list of (h, m) that has all terms of
    the subsets of that rate; bit shift + r of m tells the terms of subset r.
    """
    parts = []
    for r, rate in enumerate(RATES):
        chosen = _of(groups[rate], 1 << (shift + r))
        parts.append(F.when(F.size(chosen) > 0, F.xxhash64(F.transform(chosen, lambda t: t["h"]))))
    return F.array(*parts)


def _signed(found: DataFrame) -> DataFrame:
    """found (..., list of (h, m)) with the signatures `s` of a text (low bits of m) and `es` of its edited text (high bits).

    Most terms are in one subset or two, so the list is first cut to the terms of each rate, and those are searched.
    """
    # sort_array, unlike array_sort, compares without a lambda; one step each, so nothing is sorted or cut twice
    found = found.withColumn("found", F.sort_array("found"))
    rates, n = sorted(set(RATES)), len(RATES)
    held = {q: sum(1 << r for r, rate in enumerate(RATES) if rate == q) for q in rates}
    found = found.withColumn("__rare", _of(F.col("found"), sum((b << n) | b for q, b in held.items() if q > 2)))
    found = found.withColumns({f"__q{q}": _of(F.col("__rare"), (held[q] << n) | held[q]) for q in rates if q > 2})
    groups = {q: F.col(f"__q{q}") if q > 2 else F.col("found") for q in rates}
    return found.withColumns({"s": _signature(groups, 0), "es": _signature(groups, n)}).drop("found", "__rare", *[f"__q{q}" for q in rates])


def fingerprint_text(signature: Column, whole: Column) -> Column:
    """Fingerprint as a string; without any lexicon term a hash of the whole text."""
    some = F.exists(signature, lambda x: x.isNotNull())
    hexed = F.transform(signature, lambda x: F.coalesce(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0"), F.lit("-")))
    return F.when(some, F.lower(F.array_join(hexed, "."))).otherwise(F.concat(F.lit("w"), F.substring(whole, 1, 16)))


def likeness(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """Share of equal hashes among subsets used by either signature; equal fingerprints have likeness 1."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda t: t))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda t: t))
    return F.when(a_text == b_text, 1.0).when(F.coalesce(used, F.lit(0)) <= 0, 0.0).otherwise(same / F.when(used > 0, used)).cast("double")


def _bucketed(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """docs with an order-keeping `bucket`, and per bucket its first key and the bucket before it (cyclic)."""
    spark = docs.sparkSession
    total = docs.count()
    wanted = min(MAX_BUCKETS, max(1, total // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)] or [0.5], 10_000 if wanted < 5000 else 1_000_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    width = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    # Two short searches instead of one long one: the row of cuts, then the place in it.
    here = F.coalesce(F.col(key), F.lit(None))
    number = F.lit(0)
    if cuts:
        below = lambda values: F.size(F.filter(values, lambda c: c <= here))
        table = F.array(*[F.array(*map(F.lit, r)) for r in rows])
        row = F.greatest(below(F.array(*[F.lit(r[0]) for r in rows])) - 1, F.lit(0))
        number = F.when(here.isNull(), 0).otherwise(row * width + below(F.element_at(table, (row + 1).cast("int"))))
    docs = docs.withColumn("bucket", number.cast("int"))
    firsts = sorted((r.bucket, r.first[0]) for r in docs.groupBy("bucket").agg(F.min(F.struct(key)).alias("first")).collect())  # a row a bucket
    chain = [(b, first, firsts[i - 1][0]) for i, (b, first) in enumerate(firsts)]
    return docs, spark.createDataFrame(chain, f"bucket int, first {dict(docs.dtypes)[key]}, previous int")


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts are shuffled once, by ordering bucket; the first row of each bucket is also sent to the bucket before, so
    that every row meets its successor. Everything after that keeps the partitioning.
    """
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = saved(lexicon(docs).where("mask <> 0"))  # terms of no subset change nothing
    small = words.count() <= MAX_BROADCAST
    docs, chain = _bucketed(docs, "id")
    chain = F.broadcast(chain)  # at most MAX_BUCKETS rows
    places = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(F.struct(F.lit(0).alias("copy"), F.col("bucket").alias("at")), F.struct(F.lit(1).alias("copy"), F.col("previous").alias("at"))))
    dealt = docs.join(chain, "bucket").select("id", "text", F.explode(F.coalesce(places, F.array(F.struct(F.lit(0).alias("copy"), F.col("bucket").alias("at"))))).alias("p"))
    order = Window.partitionBy("at").orderBy("copy", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = dealt.select("id", "text", "p.at", "p.copy").withColumns({"following": F.lead("text").over(order), "r": F.row_number().over(order)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("following", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    facts = F.struct("id", "copy", n.cast("long").alias("n_chars"), F.sha2(F.encode("text", "utf-8"), 256).alias("whole"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"))
    rows = rows.select("at", "r", facts.alias("facts"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("changed"))
    none = F.lit(None).cast(rows.schema["facts"].dataType)
    tagged = lambda words, side: F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(side).alias("side"), none.alias("facts")))
    # A term of both texts travels once; only the first row of a text carries what is known of it.
    long = F.explode(F.concat(
        F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("side"), F.col("facts").alias("facts"))),
        tagged(F.array_except("own", "changed"), 1), tagged(F.array_except("changed", "own"), 2), tagged(F.array_intersect("own", "changed"), 3),
    ))
    long = rows.select("at", "r", long.alias("t")).select("at", "r", "t.term", "t.side", "t.facts")
    mask, both = F.col("mask").cast("long"), F.col("side")
    m = F.when(both.bitwiseAND(1) != 0, mask).otherwise(0).bitwiseOR(F.when(both.bitwiseAND(2) != 0, F.shiftleft(mask, len(RATES))).otherwise(0))
    if small:  # the blank term keeps documents without terms
        words = F.broadcast(words.union(words.sparkSession.createDataFrame([("", 0, 0)], words.schema)))
        joined = long.join(words, "term")
    else:  # a row of facts meets no term; a join key of its own spreads such rows
        spread = long.withColumn("term", F.when(F.col("facts").isNotNull(), F.concat(F.lit("\0"), F.xxhash64("at", "r").cast("string"))).otherwise(F.col("term")))
        joined = spread.join(words, "term", "left").where("h IS NOT NULL OR facts IS NOT NULL")
    found = joined.select("at", "r", "facts", F.when(F.col("h").isNotNull(), F.struct("h", m.alias("m"))).alias("t"))
    found = found.groupBy("at", "r").agg(F.first("facts", ignorenulls=True).alias("facts"), F.collect_list("t").alias("found"))
    signed = _signed(found.select("at", "r", "facts.*", "found"))
    signed = signed.withColumns({"fingerprint": fingerprint_text(F.col("s"), F.col("whole")), "edited_fingerprint": fingerprint_text(F.col("es"), F.col("edited_sha256"))})
    after = Window.partitionBy("at").orderBy("r")
    near = signed.withColumns({"next_s": F.lead("s").over(after), "next_fingerprint": F.lead("fingerprint").over(after)}).where("copy = 0")
    return near.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("s"), F.col("es"), F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s"), F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
