"""Near-duplicates by word-shingle similarity with SetSketch registers.

A register keeps, for a hash function of its own, the least exponential value of a set on the scale floor(1 - log_BASE x), cut
to 0..LIMIT: exponentially spaced, truncated minima. The register of a union is the larger one, so sketches of parts merge, and
registers of two sets agree the more often the more alike the sets are. BANDS keys of ROWS registers bring sets together: two of
similarity 0.8 agree in a register with chance 0.80 and miss each other in all keys with chance 4e-7 (by formula).
What met is judged by the joint likelihood of the similarity, given how many registers are larger in one set, in the other, or
equal (the sizes are known). It is used twice. A key's least node stands for the key, and a node that is ruled out to have a
similarity of STRANGERS to it is not grouped with it: chance meetings do not grow into large groups. Inside a group a pair
that is ruled out to be linked is given up, and the others are verified on the full shingle sets (nearcopies.verified_edges:
leader first, then blocks), so no pair below the limit is ever linked. Ruled out means: the best estimate is EVIDENCE log units
more likely.

Equal sets are one node, so copies meet once, and a task passes on a spanning forest, never all pairs.

Edge cases: a text of fewer words than a shingle is one shingle; null and wordless texts have the empty set and are linked with
nothing; a null key keeps its row, and its component is the smallest non-null key reachable, or null; repeated rows stay;
very long texts are shingled whole; an empty table gives no rows; columns other than key and text are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import begin, saved, small_batches, stored
from tidemark.llm.components import components
from tidemark.llm.nearcopies import Near, shingles, verified_edges
from tidemark.llm.simhash import SEED

#: Words of a shingle, and the least similarity of a link.
SHINGLE, SIMILARITY = 2, 0.8
#: Spacing of the register scale, and its largest value.
BASE, LIMIT = 1.02, 2000
#: Keys of a set, and registers that make up a key.
BANDS, ROWS = 48, 6
#: Log units by which the best estimate has to beat a similarity before that is ruled out.
EVIDENCE = 20.0
#: Similarity below which a key's least node and another one count as strangers.
STRANGERS = 0.4
#: Shingles whose values are taken at once. Only memory depends on it.
CHUNK = 1024

_draw = np.random.default_rng(SEED + 1)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_SLACK = 1e-9


def registers(marks: np.ndarray) -> np.ndarray:
    """Sketch of a set of 64-bit hashes; zeros for the empty set. Larger of two = sketch of the union."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(marks), CHUNK):
        np.minimum(least, (_FACTORS[:, None] * marks[None, start : start + CHUNK] + _OFFSETS[:, None]).min(axis=1), out=least)
    if not len(marks):
        return np.zeros(BANDS * ROWS, np.uint16)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 + 2.0**-60)  # exponential, of rate 1
    return np.clip(np.floor(1 - np.log(np.maximum(value, 1e-30)) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def keys(sketch: np.ndarray) -> list[int]:
    """The band keys of a sketch, as signed longs."""
    raw, width = sketch.tobytes(), 2 * ROWS
    return [(h := xxhash.xxh64_intdigest(raw[i * width : (i + 1) * width], i)) - (h >> 63 << 64) for i in range(BANDS)]


def _log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of similarity j, where the first set has the share u of both sizes."""
    part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = part(u - (1 - u) * j), part(1 - u - u * j)
    return more * np.log(np.maximum(a, 1e-12)) + less * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))


def counted(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many registers are larger, and smaller, in the first sketch than in each other one."""
    return (one > others).sum(axis=1), (one < others).sum(axis=1)


def estimate(more: np.ndarray, less: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Most likely similarity of sets of known sizes, from counted() registers."""
    u, same = size / (size + sizes), BANDS * ROWS - more - less
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(30):  # the likelihood is concave in the similarity
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rise = _log_likelihood(a, more, less, same, u) < _log_likelihood(b, more, less, same, u)
        low, high = np.where(rise, a, low), np.where(rise, high, b)
    return (low + high) / 2


def beats(more: np.ndarray, less: np.ndarray, size: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
    """Log units by which the best estimate beats every similarity of `limit` or more; infinite if the sizes rule that out."""
    u, same = size / (size + sizes), BANDS * ROWS - more - less
    best = estimate(more, less, size, sizes)
    gap = _log_likelihood(best, more, less, same, u) - _log_likelihood(np.full(len(u), limit), more, less, same, u)
    within = np.minimum(size, sizes) >= limit * np.maximum(size, sizes) - _SLACK
    return np.where(within, np.where(best >= limit, 0.0, gap), np.inf)


def sketched(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, node (128-bit hash of the shingle set, null if empty), n_shingles, sketch and mark (hash of the text) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("setsketch")
        for batch in batches:
            node, number, sketch = [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py() or "", SHINGLE)
                number.append(len(found))
                node.append((h := xxhash.xxh64_intdigest(found.tobytes(), SEED)) - (h >> 63 << 64) if len(found) else None)
                sketch.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(number, pa.int64()), pa.array(sketch, pa.binary())], names=["key", "mark", "node", "n_shingles", "sketch"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, mark long, node long, n_shingles long, sketch binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    """band, node: the keys of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("setsketch")
        for batch in batches:
            found = [keys(np.frombuffer(s.as_py(), np.uint16)) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "bands"])

    return nodes.select("node", "sketch").mapInArrow(run, "node long, bands array<long>").select(F.explode("bands").alias("band"), "node")


def _groups(nodes: DataFrame) -> DataFrame:
    """node, root of every node that may belong with another one: it shares a key with the least node of that key, and the
    likelihood does not say that the two are strangers. Two linked nodes that a stranger came between in one key share others.
    """
    keyed = stored(_keyed(nodes))
    least = keyed.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").select("band", "u")
    met = keyed.join(least, "band").where("u <> node").select("u", F.col("node").alias("v")).distinct()
    info = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("setsketch")
        for batch in batches:
            size = [batch.column(i).to_numpy() for i in (2, 3)]
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(batch), -1) for i in (4, 5))
            keep = pa.array(beats(*counted(one, two), size[0], size[1], STRANGERS) < EVIDENCE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    edges = met.join(info("u"), "u").join(info("v"), "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(judged, "u long, v long")
    return components(edges)


def by_likelihood(sets: list[np.ndarray]) -> Near:
    """Sets whose registers do not speak against a link."""
    sketch = np.stack([registers(s) for s in sets]) if sets else np.zeros((0, BANDS * ROWS), np.uint16)
    size = np.array([len(s) for s in sets], np.int64)

    def near(i: int, live: np.ndarray) -> np.ndarray:
        others = np.flatnonzero(live)
        return others[beats(*counted(sketch[i], sketch[others]), size[i], size[others], SIMILARITY) < EVIDENCE]

    return near


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_shingles (size of its set), component_id (smallest key reachable over links, itself included), kept."""
    rows = stored(sketched(docs, text, key))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("mark").alias("mark"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    roots = saved(_groups(nodes))
    groups = saved(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("mark").alias("mark"), F.max("n_shingles").alias("shingles")).join(roots, "node"))
    linked = components(verified_edges(docs.select(F.col(text).alias("text")), groups, "text", SIMILARITY, SHINGLE, by_likelihood))
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"))
    placed = least.join(linked.select("node", F.col("root").alias("of")), "node", "left").select("node", "key", F.coalesce("of", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min("key").alias("component_id"))
    found = placed.select("node", "root").join(best, "root").select("node", "component_id")
    # Empty sets have no node and stay on their own; they never meet in the join.
    joined = rows.where("node IS NOT NULL").select("key", "n_shingles", "node").join(found, "node").select("key", "n_shingles", "component_id")
    every = joined.unionByName(rows.where("node IS NULL").select("key", "n_shingles", F.col("key").alias("component_id")))
    return every.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
