"""SimHash near-dedup at a shingle similarity: five words, Jaccard similarity 0.8 or more.

A pair at 0.8 differs in ten of 64 bits on average, so no choice of whole bit blocks is selective and op9's keys cannot
bring such pairs together. Keys of MinHash minima (BANDS keys of ROWS minima each) do: a pair of similarity s shares one with
chance 1 - (1 - s ** ROWS) ** BANDS, 0.99994 at 0.8 and more above. Texts that share a key, directly or over others, form
a candidate group. Within it the SimHash fingerprints are compared bit-sliced, 64 at a time. RADIUS is over four standard
deviations from the mean distance of a pair at 0.8, but a few pairs are beyond it (of 5 shingles 4 in common, one in a million).
So of those beyond RADIUS bits only the ones are given up whose numbers of shingles by slice of the hash space prove that too
few can be in common. What is left is decided on the shingle sets themselves, so in a group no pair below the limit is linked
and none above it is lost.

No group is one task's work however large it is. A large one is first held against its leader, row by row: texts linked to
the leader need no other comparison unless some text that is not linked to it is near enough (Jaccard distance is a
metric). The rest is cut into blocks, and each pair of blocks is a task that passes on a spanning forest, never all pairs.

Edge cases: a text of fewer words than a shingle is one shingle; null and wordless texts have the empty set, which is
like itself alone, so one of them stays; texts of one shingle set are one node whose set travels once; a null key counts as
the largest; of rows with equal key and text one stays, the first by the JSON text of its other columns; very long texts
are shingled whole and are a block of their own; an empty table stays empty; extra columns of any name and type stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import begin, saved, small_batches, stored, unnamed
from tidemark.llm.components import components
from tidemark.llm.simhash import SEED, keep_winners, lanes, planes, within

#: Words of a shingle, and the least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits within which fingerprints are held near without a look at the shingles' numbers. The result does not depend on it.
RADIUS = 28
#: Keys of a text, and minima that make up a key.
BANDS, ROWS = 32, 6
#: Texts, and shingles, of one block of a candidate group. The result does not depend on them.
BLOCK_TEXTS, BLOCK_SHINGLES = 1500, 1_500_000
#: Shingles whose minima or bits are taken at once. Only memory depends on it.
CHUNK = 1024

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_SLACK = 1e-9


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.encode().lower().split()  # words as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(g), SEED) for g in grams]), ">u8").astype(np.uint64))


def set_fingerprint(marks: np.ndarray) -> int:
    """64-bit SimHash of a shingle set: each distinct shingle counts once, as it does in the similarity."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(marks), CHUNK):
        ones += np.unpackbits(marks[start : start + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(marks)).tobytes(), "big")


def keys(marks: np.ndarray) -> list[int]:
    """The band keys of a shingle set, as signed longs; none of the empty set."""
    if not len(marks):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(marks), CHUNK):
        np.minimum(least, (_FACTORS[:, None] * marks[None, start : start + CHUNK] + _OFFSETS[:, None]).min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return [(h := xxhash.xxh64_intdigest(raw[i * width : (i + 1) * width], i)) - (h >> 63 << 64) for i in range(BANDS)]


def _sets(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, mark (a hash of the text), node (a hash of the shingle set), shingles (their number) and bands of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in batches:
            node, number, bands = [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py() or "")
                node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                number.append(len(found))
                bands.append(keys(found))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(number, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "mark", "node", "shingles", "bands"])

    rows = docs.select(F.col(key), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, mark long, node long, shingles long, bands array<long>")


def similarity_to(one: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Jaccard similarity of a sorted set to each of the sorted sets that lie end to end in flat."""
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat((one[place] == flat).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
    return common / (len(one) + size - common)


#: Made from sorted sets; called with a place and a mask of places, gives those of the mask that may be linked to it.
Near = Callable[[int, np.ndarray], np.ndarray]


def by_counts(sets: list[np.ndarray], similarity: float) -> Near:
    """Sets of which enough shingles can be in common: what two sets do not share is at least the sum of the differences of their
    numbers of shingles in each slice of the hash space, and at the limit at most a fixed part of both sizes."""
    size = np.array([len(s) for s in sets], np.int64)
    bits = int(np.clip(int(size.mean()).bit_length() - 2, 6, 10))  # few shingles a slice
    slices = np.concatenate([(s >> np.uint64(64 - bits)).astype(np.int64) + (i << bits) for i, s in enumerate(sets)])
    counts = np.bincount(slices, minlength=len(sets) << bits).astype(np.int32).reshape(len(sets), -1)

    def near(i: int, live: np.ndarray) -> np.ndarray:
        others = np.flatnonzero(live)
        apart = np.abs(counts[others] - counts[i]).sum(axis=1)
        return others[apart <= (1 - similarity) / (1 + similarity) * (size[others] + size[i]) + _SLACK]

    return near


def by_bits(sets: list[np.ndarray], similarity: float = SIMILARITY) -> Near:
    """Fingerprints within RADIUS bits, compared bit-sliced, and of the others those that by_counts leaves."""
    prints = np.array([set_fingerprint(s) for s in sets], np.uint64)
    sliced = planes(prints)
    bit = np.arange(64, dtype=np.uint64)
    counted: list[Near] = []  # made when first needed: most groups are within the radius

    def near(i: int, live: np.ndarray) -> np.ndarray:
        own = np.where(prints[i] >> bit & np.uint64(1), ~np.uint64(0), np.uint64(0))
        found = within(sliced, np.broadcast_to(own[:, None], sliced.shape), lanes(live, sliced.shape[1]), RADIUS)
        close = np.unpackbits(found.view(np.uint8), bitorder="little")[: len(live)].astype(bool)
        beyond = live & ~close
        if not beyond.any():
            return np.flatnonzero(close)
        if not counted:
            counted.append(by_counts(sets, similarity))
        close[counted[0](i, beyond)] = True
        return np.flatnonzero(close)

    return near


def links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, sketch: Callable[[list[np.ndarray]], Near] | None = None) -> Iterator[tuple[int, int]]:
    """Edges that connect exactly what is linked at the similarity among sorted sets.

    Breadth first: a node is only held against those not reached yet whose sizes, whose distances to the first node of the
    search and whose sketches leave the limit within reach.
    """
    n = len(sets)
    size, flat = np.array([len(s) for s in sets], np.int64), np.concatenate(sets) if n else np.zeros(0, np.uint64)
    start = np.r_[0, np.cumsum(size)]
    near = sketch(sets) if sketch else by_bits(sets, similarity)
    open_ = size > 0

    def like(i: int, others: np.ndarray) -> np.ndarray:
        parts = np.r_[0, np.cumsum(size[others])]
        at = np.arange(parts[-1]) + np.repeat(start[others] - parts[:-1], size[others])
        return similarity_to(sets[i], flat[at], size[others])

    while open_.any():
        first = int(np.flatnonzero(open_)[0])
        open_[first] = False
        away = np.full(n, np.nan)
        rest = np.flatnonzero(open_)
        if not len(rest):
            return
        away[rest] = 1 - like(first, rest)
        away[first] = 0
        reached = rest[away[rest] <= 1 - similarity + _SLACK]
        queue = [(first, int(j)) for j in reached]
        open_[reached] = False
        while queue:
            u, v = queue.pop()
            yield int(nodes[u]), int(nodes[v])
            live = open_ & (np.abs(away - away[v]) <= 1 - similarity + _SLACK) & (size >= similarity * size[v] - _SLACK) & (similarity * size <= size[v] + _SLACK)
            others = near(v, live) if live.any() else ()
            if len(others):
                more = others[like(v, others) >= similarity - _SLACK]
                open_[more] = False
                queue += [(v, int(j)) for j in more]


def _groups(marked: DataFrame) -> DataFrame:
    """node, root of every node that shares a key with another one."""
    keyed = marked.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("band", "v")
    return components(keyed.join(least, "band").where("node <> v").select(F.col("node").alias("u"), "v"))


def verified_edges(docs: DataFrame, groups: DataFrame, text: str, similarity: float, shingle: int = SHINGLE, sketch: Callable[[list[np.ndarray]], Near] | None = None) -> DataFrame:
    """Edges (u, v) of the verified links inside candidate groups (node, mark, shingles, root); groups is used many times."""
    parts = lambda df: df.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).alias("blocks"))
    texts = docs.select(F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    wanted = groups.join(parts(groups), "root")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in batches:
            found = [shingles(v.as_py() or "", shingle).view(np.int64) for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["root", "node", "blocks", "marks"])

    sets = stored(texts.join(wanted, "mark").select("root", "node", "blocks", "text").mapInArrow(hashed, "root long, node long, blocks long, marks array<long>"))
    large = sets.where("blocks > 1")
    leaders = large.where("node = root").groupBy("root").agg(F.first("marks").alias("leader"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = []
            for mine, leader in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.asarray(x.values).view(np.uint64) for x in (mine, leader))
                away.append(1.0 - float(similarity_to(b, a, np.array([len(a)]))[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(away, pa.float64())], names=["root", "node", "marks", "away"])

    held = stored(large.join(leaders, "root").select("root", "node", "marks", "leader").mapInArrow(measured, "root long, node long, marks array<long>, away double"))
    limit = 1 - similarity + _SLACK
    led = held.where((F.col("away") <= limit) & (F.col("node") != F.col("root"))).select(F.col("root").alias("u"), F.col("node").alias("v"))
    outside = held.where(F.col("away") > limit).groupBy("root").agg(F.min("away").alias("least"))
    open_ = held.join(outside, "root").where(F.col("away") >= F.col("least") - limit).select("root", "node", "marks", F.size("marks").alias("shingles"))
    dealt = open_.join(parts(open_), "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).select("root", "node", "marks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "marks")
    zero = F.lit(0).cast("long")
    tasks = sets.where("blocks = 1").select("root", zero.alias("i"), zero.alias("j"), "node", "marks").unionByName(pairs)

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.drop_duplicates("node")
        found = list(links(one["node"].to_numpy(), [np.asarray(m).view(np.uint64) for m in one["marks"]], similarity, sketch))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return tasks.groupBy("root", "i", "j").applyInPandas(verified, "u long, v long").union(led)


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest key, chosen as in simhash.keep_first."""
    plain, (own, by), back = unnamed(docs, text, key)
    marked = saved(_sets(plain, own, by))
    groups = saved(marked.groupBy("node").agg(F.min("mark").alias("mark"), F.max("shingles").alias("shingles")).join(_groups(marked), "node"))
    roots = components(verified_edges(plain, groups, own, similarity)).withColumnRenamed("node", "__node")
    placed = marked.join(roots, F.col("node") == F.col("__node"), "left").withColumn("root", F.coalesce("root", "node"))
    return back(keep_winners(plain, placed.select(by, "mark", "root"), own, by))
