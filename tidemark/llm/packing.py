"""Packing token pieces into fixed-size sequences by a configuration linear program.

Only the histogram of piece lengths (at most `capacity` rows, whatever the corpus) reaches the driver. A variable of
the program is a configuration, a multiset of lengths that fits a sequence; it asks for the fewest sequences that cover
the histogram. The program is solved in rounds by multiplicative weights: a length's price is its size times its weight;
a round covers the histogram fractionally, each time by the configuration that a knapsack dynamic program finds for the
dearest length still uncovered; lengths whose configurations left a gap get a higher weight. Any prices give a lower bound
(the histogram's price over the dearest configuration's, a second dynamic program), and rounds end when the cover is within
TOLERANCE of the largest bound. Of the fractional cover the whole multiples of full configurations are kept, and what is
left of the histogram is covered by the same step in whole numbers. This is so at every size; plain best-fit decreasing is
only kept as a guard, and its plan is taken if it should need fewer sequences.

Pieces get their place by their rank among pieces of the same length, which Spark computes in buckets, so one hot length is
spread; a sorted array of places, at most 64 for each configuration, is looked up by binary search.

Edge cases: null text is empty and still makes one piece of length 1 (the separator); an empty table gives no rows;
repeated rows are separate pieces; very long texts are cut to pieces of the capacity; input columns other than key and text
take no part, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import begin, saved, small_batches
from tidemark.llm.wordpiece import word_tokenizer

#: Sequence length in tokens, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: Rounds of weights at most, the rise of a weight for a gap of a whole sequence, and the relative gap that ends the rounds.
ROUNDS, RATE, TOLERANCE = 8, 0.5, 1e-4
#: Pieces in one ranking bucket, about.
BUCKET_PIECES = 5000
#: Distinct pre-tokens in each of the two generations a worker remembers, and the longest it remembers (characters).
#: Only memory depends on them.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64


# ---- pieces ---------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def packed_ids(tokenizer_path: str) -> list[dict[str, bytes]]:
    """Pre-token -> its ids as little-endian words, in a young and an old generation; one pair for each file and worker
    process, kept from task to task."""
    return [{}, {}]


def forget() -> None:
    """Drop what this worker process remembers."""
    packed_ids.cache_clear()
    word_tokenizer.cache_clear()


def _nulls(values: list) -> Iterator[int]:
    at = -1
    try:
        while True:
            at = values.index(None, at + 1)
            yield at
    except ValueError:
        return


def token_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32 and, if asked for, the ids as packed bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing", forget)
        tokenizer, memo = word_tokenizer(tokenizer_path), packed_ids(tokenizer_path)
        word = [struct.pack("<I", i) for i in range(tokenizer.n_ids)]
        for batch in batches:
            split = [tokenizer.pretokens(v.as_py() or "") for v in batch.column(1)]
            young, old = memo
            found = [list(map(young.get, tokens)) for tokens in split]
            new: dict[str, bytes] = {}
            holes = []
            for tokens, values in zip(split, found, strict=True):
                for i in _nulls(values):
                    token = tokens[i]
                    known = old.get(token)
                    if known is None:
                        new[token] = b""
                        holes.append((values, i, token))
                    else:
                        values[i] = young[token] = known
            for token, ids in zip(new, tokenizer.ids(new), strict=True):
                new[token] = b"".join([word[i] for i in ids])
            for values, i, token in holes:
                values[i] = new[token]
            young.update((t, v) for t, v in new.items() if len(t) <= CACHE_CHARS)
            if len(young) > CACHE_ENTRIES:
                memo[:] = {}, young
            at, number, start, length, crc, packed = [], [], [], [], [], []
            for i, values in enumerate(found):
                data = b"".join(values) + word[END_ID]
                for k in range(0, len(data), 4 * capacity):
                    piece = data[k : k + 4 * capacity]
                    at.append(i)
                    number.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        packed.append(piece)
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


# ---- the program, on the histogram ----------------------------------------------------------------------------


def price_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: the configuration of the highest total price, as {length: copies}."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value, pick = best[c - 1], -1
        if k := fits[c]:
            gain = best[c - lengths[:k]] + prices[:k]
            top = int(gain.argmax())
            if gain[top] > value:
                value, pick = gain[top], top
        best[c], choice[c] = value, pick
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        size = int(lengths[choice[c]])
        out[size] = out.get(size, 0) + 1
        c -= size
    return out


def next_configuration(left: dict[int, float], order: list[int], capacity: int, whole: bool) -> tuple[dict[int, int], int]:
    """The first length of `order` (by falling price) and the fullest complement from what is left, and the gap.

    Knapsack by reachable totals, bit t of a word standing for total t; lengths join by falling price, and none is
    added once the room is filled. In whole numbers no length is used more often than it is left.
    """
    first = order[0]
    room = capacity - first
    within, reach, steps = (1 << room + 1) - 1, 1, []
    for size in order:
        copies = room // size
        if whole:
            copies = min(copies, int(left[size]) - (size == first))
        for _ in range(copies):
            more = (reach | reach << size) & within
            if more == reach:
                break
            steps.append((size, reach))
            reach = more
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    gap, content = room - at, {first: 1}
    for size, before in reversed(steps):
        if not before >> at & 1:
            at -= size
            content[size] = content.get(size, 0) + 1
    return content, gap


def cover(counts: dict[int, float], weights: dict[int, float], capacity: int, whole: bool = False) -> tuple[list[tuple[dict[int, int], float]], dict[int, int]]:
    """Configurations and how often each is used, so that all counts are used up; and the largest gap beside each length.

    Every step uses up a length (in whole numbers, up to a rest smaller than its copies), so there are about as many steps
    as lengths, whatever the counts.
    """
    left, used, gaps = dict(counts), [], {}
    order = sorted(left, key=lambda size: (-size * weights.get(size, 1.0), size))
    while left:
        order = [size for size in order if size in left]
        content, gap = next_configuration(left, order, capacity, whole)
        times = min(left[size] // a if whole else left[size] / a for size, a in content.items())
        used.append((content, times))
        for size, a in content.items():
            left[size] -= times * a
            if left[size] <= 0 if whole else left[size] <= 1e-9 * counts[size]:
                del left[size]
            if gap:
                gaps[size] = max(gap, gaps.get(size, 0))
    return used, gaps


def solve_program(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional cover by configurations, and a lower bound on any cover."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    wanted = np.array([counts[int(x)] for x in lengths], dtype=float)
    weights, bound, best, least = dict.fromkeys(counts, 1.0), 0.0, [], float("inf")
    for _ in range(ROUNDS):
        used, gaps = cover(counts, weights, capacity)
        total = sum(x for _, x in used)
        if total < least:
            best, least = used, total
        prices = lengths * np.array([weights[int(x)] for x in lengths])
        dearest = price_configuration(lengths, prices, capacity)
        bound = max(bound, float((prices * wanted).sum()) / sum(prices[np.searchsorted(lengths, k)] * a for k, a in dearest.items()))
        if least <= bound * (1 + TOLERANCE) or not gaps:
            break
        for size, gap in gaps.items():
            weights[size] *= 1 + RATE * gap / capacity
    return best, bound


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: groups of equal sequences stand for their members."""
    free: dict[int, list[tuple[dict[int, int], int]]] = {}  # room left -> groups
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in free if r >= size):
            for content, many in free.pop(room):
                if not left:
                    free.setdefault(room, []).append((content, many))
                    continue
                each = room // size
                full, extra = divmod(left, each) if left < each * many else (many, 0)
                left -= full * each + extra
                if full:
                    free.setdefault(room - each * size, []).append((content | {size: each}, full))
                if extra:
                    free.setdefault(room - extra * size, []).append((content | {size: extra}, 1))
                if many - full - bool(extra):
                    free.setdefault(room, []).append((content, many - full - bool(extra)))
        if left:
            each = capacity // size
            full, extra = divmod(left, each)
            if full:
                free.setdefault(capacity - each * size, []).append(({size: each}, full))
            if extra:
                free.setdefault(capacity - extra * size, []).append(({size: extra}, 1))
    return [group for groups in free.values() for group in groups]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole multiplicities that place each length exactly as often as it occurs."""
    left = {k: v for k, v in counts.items() if v}
    if not left:
        return []
    guard = best_fit(left, capacity)
    plan = []
    for content, x in sorted(solve_program(left, capacity)[0], key=lambda p: -p[1]):
        times = min([int(x + 1e-9), *(left[k] // a for k, a in content.items())])
        if times and sum(k * a for k, a in content.items()) == capacity:
            plan.append((content, times))
            for k, a in content.items():
                left[k] -= times * a
    plan += [(content, int(times)) for content, times in cover({k: v for k, v in left.items() if v}, {}, capacity, whole=True)[0]]
    return plan if sum(t for _, t in plan) <= sum(t for _, t in guard) else guard


# ---- placement ------------------------------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces (key, piece, length, ...). The input is read several times; save it first."""
    spark = pieces.sparkSession
    buckets = max(1, -(-pieces.count() // BUCKET_PIECES))
    # Equal rows may swap places, which changes no column of the result.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, sequence, given = [], 0, dict.fromkeys(counts, 0)
    for content, times in plan_sequences(counts, capacity):
        offset = 0
        for size, each in sorted(content.items(), reverse=True):
            slots.append((size, given[size], given[size] + times * each, sequence, each, offset))
            given[size] += times * each
            offset += size * each
        sequence += times
    places = sorted(slots)
    size_of, low, base, each, at = (np.array([p[i] for p in places], np.int64) for i in (0, 1, 3, 4, 5))
    shared = spark.sparkContext.broadcast((size_of * (1 << 48) + low, low, base, each, at))  # at most 64 places for each configuration
    order = Window.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32")
    ranked = pieces.withColumn("in_bucket", F.row_number().over(order) - 1).join(before.drop("n"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", (F.coalesce("first", F.lit(0)) + F.col("in_bucket")).cast("long"))
    kept = pieces.drop("bucket").schema
    names = kept.fieldNames()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing", forget)
        keys, low, base, each, at = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            here = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            in_place = rank - low[here]
            columns = [pa.array(base[here] + in_place // each[here]), pa.array(at[here] + in_place % each[here] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.select("length", "rank", *[F.col(n).alias(f"_{n}") for n in names]).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = saved(token_pieces(docs, tokenizer_path, text, key, capacity))
    return pack_pieces(pieces, capacity, key).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
