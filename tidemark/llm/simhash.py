"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints come from word shingles hashed with XXH64. Only distinct fingerprints are compared. Two that differ in at
most `radius` bits agree on some choice of BLOCKS - radius of the BLOCKS bit blocks, so each fingerprint is keyed once per
choice, and only those with an equal key meet. Under a key of more than GROUP fingerprints the bits that it leaves free are
cut into blocks and chosen from again, so at most 2 ** 13 fingerprints (at radius 2) can ever meet in one group. They are compared bit-sliced: one plane per bit holds that bit of
many fingerprints; a carry-save counter adds the planes of the differences for 64 fingerprints with each word operation,
and a block is abandoned once all its lanes are beyond the radius. A task passes on one edge per fingerprint (a spanning
star), never all pairs of a group; connected components follow on Spark.

Edge cases: null or wordless text has fingerprint zero and is linked like any other; a null doc_id keeps its row, and its
component is the smallest non-null doc_id reachable, or null; repeated rows stay; very long texts are hashed whole, CHUNK
shingles at a time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import begin, n_tasks, saved, small_batches, unnamed
from tidemark.llm.components import components

#: Words of a shingle, hash seed, and bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bit blocks that keys are chosen from.
BLOCKS = 5
#: Fingerprints under one key beyond which a second choice of bits splits them. The result does not depend on it.
GROUP = 4096
#: Shingles whose bits are counted at once, and 64-lane words compared at once. Only memory depends on them.
CHUNK, LANE_WORDS = 50_000, 1024


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text."""
    words = text.encode().lower().split()  # on bytes: only A-Z, and only the six ASCII white spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        grams = zip(*(words[start + k : min(start + CHUNK, n) + k] for k in range(shingle)), strict=True) if len(words) >= shingle else [words]
        hashed = b"".join([xxhash.xxh64_digest(b" ".join(g), SEED) for g in grams])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, mark (a hash of the text), fp (the 64 bits as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in batches:
            values = np.array([fingerprint(v.as_py() or "") for v in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=[key, "mark", "fp"])

    rows = docs.select(F.col(key), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, mark long, fp long")


def block_masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of blocks - radius bit blocks each; two words within the radius agree under at least one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks that hold all of mask and radius + 2 blocks of its free bits less radius; two words within the radius that agree
    under mask agree under at least one."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = radius + 2
    parts = [sum(1 << b for b in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]
    return [mask | sum(chosen) for chosen in combinations(parts, n - radius)]


def planes(values: np.ndarray) -> np.ndarray:
    """[64, words]: plane b holds bit b of the values, 64 lanes a word."""
    padded = np.zeros(-(-max(1, len(values)) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def lanes(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def within(a: np.ndarray, b: np.ndarray, live: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of `live` whose planes a and b differ in at most `radius` bits: carry-save counters, block by block."""
    out = np.zeros_like(live)
    digits = radius.bit_length()
    for start in range(0, len(live), LANE_WORDS):
        part = slice(start, start + LANE_WORDS)
        beyond = ~live[part]
        counter = [np.zeros_like(beyond) for _ in range(digits)]
        for plane in range(64):
            carry = a[plane, part] ^ b[plane, part]
            for digit in counter:  # ripple of the carry-save counter
                carry, digit[:] = digit & carry, digit ^ carry
            beyond |= carry
            above = counter[0]
            if radius + 1 < 1 << digits:  # the counter can show radius + 1 itself
                above = np.full_like(beyond, ~np.uint64(0))
                for i, digit in enumerate(counter):
                    above = above & (digit if (radius + 1) >> i & 1 else ~digit)
                beyond |= above
            if plane % 4 == 3 and not (~beyond).any():
                break
        out[part] = ~beyond
    return out


def link_groups(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) within the radius among values with equal, adjacent keys, for each distance j - i in turn."""
    index = np.arange(len(values))
    lag = 0
    while len(index):
        # Only groups larger than the lags done so far still have pairs.
        starts = np.flatnonzero(np.r_[True, keys[index][1:] != keys[index][:-1]])
        sizes = np.diff(np.r_[starts, len(index)])
        index = index[np.repeat(sizes, sizes) > lag + 1]
        if not len(index):
            return
        here, at = values[index], keys[index]
        sliced = planes(here)
        words = sliced.shape[1]
        stop = max(2, 2 * lag)
        while lag + 1 <= stop:
            lag += 1
            same = at[:-lag] == at[lag:] if lag < len(at) else np.zeros(0, bool)
            if not same.any():
                break
            whole, shift = divmod(lag, 64)
            later = np.zeros_like(sliced)
            later[:, : words - whole] = sliced[:, whole:] >> np.uint64(shift)
            if shift and words - whole - 1 > 0:
                later[:, : words - whole - 1] |= sliced[:, whole + 1 :] << np.uint64(64 - shift)
            near = within(sliced, later, lanes(same, words), radius)
            if near.any():
                i = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
                yield index[i], index[i + lag]


def _star(values: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Union-find over the pairs; linked value -> smallest value of its group here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for i, j in pairs:
        for a, b in zip(values[i].tolist(), values[j].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp) -> choice, masked, fp: once for each key, those of a crowded key once for each finer key instead."""
    masks = block_masks(radius)
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(_signed(m))).alias("masked")) for i, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.masked", "fp")
    crowded = keyed.groupBy("choice", "masked").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("choice", "masked", F.lit(True).alias("crowded"))
    finer = [finer_masks(m, radius) for m in masks]
    each = len(finer[0])
    literal = F.array(*[F.lit(_signed(m)) for own in finer for m in own])
    again = F.array(*[F.struct((len(masks) + F.col("choice") * each + k).alias("choice"), fp.bitwiseAND(F.element_at(literal, F.col("choice") * each + k + 1)).alias("masked")) for k in range(each)])
    own = F.array(F.struct("choice", "masked"))
    return keyed.join(crowded, ["choice", "masked"], "left").select("fp", F.explode(F.when(F.col("crowded"), again).otherwise(own)).alias("k")).select("k.choice", "k.masked", "fp")


def link_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct (fp) -> edges (u, v) that connect exactly the fingerprints linked within the radius."""
    keyed = _keyed(distinct, radius).repartition(n_tasks(distinct.sparkSession), "choice", "masked").sortWithinPartitions("choice", "masked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the group that may go on in the next batch

        def link(choice: np.ndarray, masked: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.r_[0, (choice[1:] != choice[:-1]) | (masked[1:] != masked[:-1])]) if len(choice) else np.zeros(0, np.int64)
            star = _star(values.view(np.int64), link_groups(group, values, radius))
            return pa.RecordBatch.from_arrays([pa.array(star.keys(), pa.int64()), pa.array(star.values(), pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            if sum(len(h[0]) for h in held) < 100_000:
                continue
            choice, masked, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.flatnonzero((choice != choice[-1]) | (masked != masked[-1]))[-1] + 1) if (choice[0], masked[0]) != (choice[-1], masked[-1]) else 0
            if cut:
                yield link(choice[:cut], masked[:cut], fp[:cut].view(np.uint64))
            held = [(choice[cut:], masked[cut:], fp[cut:])]
        if held:
            choice, masked, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield link(choice, masked, np.ascontiguousarray(fp).view(np.uint64))

    return keyed.mapInArrow(run, "u long, v long").where("u <> v")


def _placed(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp, ...) with the root fingerprint of each component."""
    roots = components(link_edges(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per row: key, fp, component_id (smallest key reachable over links, itself included)."""
    marked = saved(fingerprints(docs, text, key))
    placed = _placed(marked.groupBy("fp").agg(F.min(key).alias("least")), radius)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_winners(docs: DataFrame, placed: DataFrame, text: str, key: str) -> DataFrame:
    """docs without the rows that lose in their group; placed has key, mark (xxhash64 of the text) and root of every row.

    The row of the smallest key wins (null keys last, then the smallest mark). Only losers, and winners that occur more than
    once, are joined to docs; of the latter one row stays, the first by the JSON text of its other columns.
    """
    rank = F.struct(F.col("key").isNull().alias("without"), "key", "mark")
    kinds = saved(placed.select(F.col(key).alias("key"), "mark", "root").groupBy("root", "key", "mark").agg(F.count("*").alias("n")).withColumn("rank", rank))
    best = kinds.groupBy("root").agg(F.min("rank").alias("best"))
    judged = kinds.join(best, "root").select(F.col("key").alias("__key"), F.col("mark").alias("__mark"), (F.col("rank") == F.col("best")).alias("wins"), "n")
    named = docs.withColumn("__text", F.xxhash64(text))
    same = named[key].eqNullSafe(F.col("__key")) & (F.col("__text") == F.col("__mark"))
    alone = named.join(judged.where("NOT wins OR n > 1").select("__key", "__mark"), same, "left_anti").select(*docs.columns)
    others = [c for c in docs.columns if c not in (key, text)]
    copies = Window.partitionBy(key, "__text").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    twins = named.join(judged.where("wins AND n > 1").select("__key", "__mark"), same, "left_semi").withColumn("__n", F.row_number().over(copies))
    return alone.unionByName(twins.where("__n = 1").select(*docs.columns))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest key (null keys last, then by a hash of the text).

    Rows are told apart by key and text, so rows without a key, or with one key and different texts, are judged each on
    its own.
    """
    plain, (own, by), back = unnamed(docs, text, key)
    marked = saved(fingerprints(plain, own, by))
    placed = _placed(marked.select("fp").distinct(), radius)
    return back(keep_winners(plain, marked.join(placed, "fp").select(by, "mark", "root"), own, by))
