"""Target-distribution importance resampling over hashed word n-grams, with Arrow kernels.

ascii_lower, split_pattern_regex and list_flatten give the words of a batch, dictionary_encode their indices. Shifted indices
form pairs, which are dictionary-encoded again, so only distinct pairs are hashed; a triple is a pair and a shifted word. The
CRC of an n-gram follows from those of its parts (CRC-32 is linear: appending k bytes multiplies by a fixed matrix), in
NumPy. Buckets are stored, two bytes each, since corpus counts have to be known before the first gain is; take and a
segment-reduce then turn them into gains and a document's weight.

Corpus counts are BUCKETS sums, whatever the corpus. Documents are ranked by range of score: rows with equal rank keys travel as
one with their number, ranges are counted, and a row's rank is what lies in the ranges and rows before it; no task sees more
than a range.

Edge cases: null and wordless texts have no feature and weight 0; a null key is hashed as an empty one and is last among equal
scores; repeated rows are ranked each on its own; with no eligible document nothing is drawn; very long texts are cut
into pieces of WORDS words that overlap by two for the n-grams; an empty table gives no rows; with an empty target or corpus
every count is 0; columns other than key and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import begin, n_tasks, saved, small_batches, stored

#: Hash buckets, longest n-gram, least words of a document that may be drawn, and percent of those that are.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words whose n-grams are held at once. Only memory depends on it.
WORDS = 500_000
#: What lies between words, after A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lengths up to which the matrices that append bytes to a CRC are held; longer words are hashed by zlib.
NEAR = 48


def _append_tables() -> np.ndarray:
    """[length, byte of the CRC, value]: the CRC's part after `length` further zero bytes, without zlib's conditioning."""
    one = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
    tables = np.empty((NEAR + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for k in range(1, NEAR + 1):
        tables[k] = one[tables[k - 1] & 0xFF] ^ (tables[k - 1] >> np.uint32(8))
    return tables


_APPEND = _append_tables()


def _followed(crc: np.ndarray, words: np.ndarray, spaced: np.ndarray, length: np.ndarray, text: list[bytes]) -> np.ndarray:
    """CRCs of n-grams with a space and a word behind them; spaced and length are those of " " + word, by word."""
    size = length[words]
    near = np.minimum(size, NEAR)
    out = spaced[words].copy()
    for byte in range(4):
        out ^= _APPEND[near, byte, (crc >> np.uint32(8 * byte)) & np.uint32(0xFF)]
    for i in np.flatnonzero(size > NEAR):
        out[i] = zlib.crc32(b" " + text[words[i]], int(crc[i]))
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row and dictionary index of every word of a batch, and the dictionary."""
    lowered = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())  # lowered first: a cast slice is lowered wrongly
    lists = pc.split_pattern_regex(lowered, BETWEEN)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return row.filter(some).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()


def features(row: np.ndarray, index: np.ndarray, text: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the runs of 1, 2 and 3 words, in pieces; the rows of one piece ascend."""
    bare = np.array([zlib.crc32(w) for w in text], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in text], np.uint32)
    length = np.array([len(w) + 1 for w in text], np.int64)
    n = max(1, len(text))
    for start in range(0, len(index), WORDS):
        own, ids = row[start : start + WORDS + LONGEST - 1], index[start : start + WORDS + LONGEST - 1]
        here = min(WORDS, len(index) - start)
        yield own[:here], bare[ids[:here]] % BUCKETS
        pairs = pa.array(ids[:-1] * n + ids[1:]).dictionary_encode()
        distinct = pairs.dictionary.to_numpy()
        crc = np.take(_followed(bare[distinct // n], distinct % n, spaced, length, text), pairs.indices.to_numpy())
        for k in range(1, LONGEST):
            # crc[i] is that of the run of k + 1 words at i
            crc = crc if k == 1 else _followed(crc[: len(ids) - k], ids[k:], spaced, length, text)
            inside = np.flatnonzero(own[: min(here, len(ids) - k)] == own[k : k + min(here, len(ids) - k)])
            yield own[inside], crc[inside] % BUCKETS


def hashed(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words and buckets (little-endian two-byte numbers, one per feature, in any order) of every row."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        for batch in batches:
            row, index, dictionary = words(batch.column(1))
            pieces = list(features(row, index, dictionary))
            at = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in pieces)])
            bucket = np.concatenate([np.zeros(0, np.uint16), *(p[1].astype("<u2") for p in pieces)])
            by_row = bucket[np.argsort(at, kind="stable")].tobytes()
            ends = 2 * np.cumsum(np.r_[0, np.bincount(at, minlength=len(batch))])
            cells = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(by_row)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=len(batch))), cells.cast(pa.binary())], names=["key", "n_words", "buckets"])

    kind = dict(rows.select(F.col(key).alias("key")).dtypes)["key"]
    return rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_words long, buckets binary")


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's buckets start (and the last ends), and all buckets."""
    offsets = np.r_[0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2)]
    return offsets, np.frombuffer(b"".join(column.to_pylist()), "<u2")


def bucket_counts(found: DataFrame) -> DataFrame:
    """Rows of `hashed` -> bucket, n: features of all rows in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch.column(0))[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket in thousandths from rows of `hashed`; BUCKETS numbers, so they may travel through the driver."""
    counts = []
    for rows in (documents, target):
        held = np.zeros(BUCKETS)
        for bucket, n in bucket_counts(rows).collect():  # at most BUCKETS rows
            held[bucket] = n
        counts.append(held)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows of `hashed` -> key, n_words, n_features and weight (sum of gains)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        for batch in batches:
            ends, buckets = _cells(batch.column(2))
            number, weight = np.diff(ends), np.zeros(len(batch), np.int64)
            some = np.flatnonzero(number)
            if len(some):
                weight[some] = np.add.reduceat(np.take(gain, buckets), ends[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"key {dict(found.dtypes)['key']}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, drawn by the hash of the key."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (key, n_words, n_features, weight, score) -> key, n_features, weight, score, rank; null where not drawn."""
    spark = scored.sparkSession
    alike = ["key", "n_features", "weight", "score"]
    may = scored.select(*alike, F.coalesce(F.col("n_words") >= least_words, F.lit(False)).alias("may"))
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    groups = may.where("may").groupBy(*alike).agg(F.count("*").alias("n"))
    dealt = stored(groups.repartitionByRange(n_tasks(spark), *order).withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row a range
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    drawn = percent * total // 100
    offsets = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.element_at(offsets, F.col("range")))
    each = placed.select(*alike, F.explode(F.expr("sequence(start + 1, start + n)")).alias("rank"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    return each.select(*alike, rank).unionByName(may.where("NOT may").select(*alike, F.lit(None).cast("long").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's key, n_features, weight, score and rank: the drawn rows resemble the target texts."""
    found = stored(hashed(documents, text, key))
    aimed = hashed(target.select(F.col(text).alias("text"), F.lit(0).alias("key")), "text", "key")
    scored = saved(weighed(found, gains(found, aimed)).withColumn("score", F.col("weight") + noise(F.col("key"))))
    return ranked(scored).withColumnRenamed("key", key)
