"""Removal of repeated byte strings by a run-length index over candidate regions.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus. One index over the
whole corpus would be one task's work, so the corpus is first cut to candidates without losing a match:

1. Anchors. Of the GRAM-byte grams inside each window of `length` bytes the ones of least hash are anchors. Equal windows
   have equal anchors, so windows repeat only where an anchor's gram repeats. Anchors whose gram occurs once are dropped
   (two passes over the text and a join on the gram hash; nothing is collected).
2. Contexts. The bytes around an anchor that any window with it can reach. An anchor whose whole context repeats needs no
   index: all of it is marked. Of each repeated context one representative goes on, with all contexts that differ.
3. Index. Contexts are dealt to blocks by gram, so windows that may be equal meet. A block's suffix order is kept as a
   run-compressed Burrows-Wheeler transform: run ends are sampled with their text positions and the exact match length to
   the neighbour across the end; inside a run a suffix's match is its left neighbour's less one. Streaming over the text
   from sample to sample gives the matching statistic of every position, and positions that reach `length` are marked.
   Repetitive blocks have few runs, so few samples. Grams with very many different contexts are split by window hash.

Edge cases: null text is empty and stays; texts shorter than `length` stay; rows repeated with equal id and text are
occurrences of each other, null ids too; overlapping occurrences count; very long texts are read whole, CHUNK_BYTES at a
time; an empty table stays empty; cut_text takes extra columns of any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import begin, release, saved, small_batches, stored, unnamed

#: Repeated strings have this many bytes; grams that anchors are chosen from.
LENGTH, GRAM = 200, 100
#: Contexts of a block, about; different contexts of one gram beyond which it is split by window hash instead.
BLOCK_CONTEXTS, HOT_CONTEXTS = 2000, 20_000
#: Bytes of text hashed at once; only memory depends on it.
CHUNK_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _sliding(x: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over x[i : i + w] for each i, from running extremes of blocks of w."""
    n = len(x)
    size = -(-(n + w) // w) * w
    padded = np.full(size, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[w - 1 : w - 1 + n])


class AnchorFinder:
    """Anchors of texts with the hashes of their gram and of their context."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        self.up = self.down = np.ones(1, np.uint64)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, position, gram hash, context hash) of every anchor."""
        length, gram = self.length, self.gram
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        if n < length:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * self.down[: n + 1 - gram])
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        stops = np.repeat(ends, sizes)
        width = length - gram + 1
        least = _sliding(grams, width, np.minimum, 2**64 - 1)[: n - length + 1]
        least[np.arange(n - length + 1) + length > stops[: n - length + 1]] = 0  # no window starts there
        # A gram is an anchor if it is the least of some window, the greatest of which, over its windows, it equals.
        reach = np.zeros(len(grams) + width - 1, np.uint64)
        reach[width - 1 : width - 1 + len(least)] = least
        chosen = np.flatnonzero(_sliding(reach, width, np.maximum, 0)[: len(grams)] == grams)
        chosen = chosen[grams[chosen] > 0]
        chosen = chosen[chosen + gram <= stops[chosen]]
        owner = np.searchsorted(ends, chosen, side="right")
        begins = (ends - sizes)[owner]
        a, b = np.maximum(begins, chosen - (length - gram)), np.minimum(ends[owner], chosen + length)
        around = _mix((sums[b] - sums[a]) * self.down[a] + ((chosen - a).astype(np.uint64) << np.uint64(32)) + (b - chosen).astype(np.uint64))
        return owner, chosen - begins, grams[chosen], around


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (id, mark, text) -> h, c, id, loc: gram hash, context hash, id, and mark and position in one long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix")
        finder = AnchorFinder(length, gram)
        for batch in batches:
            texts = [v.as_py().encode() for v in batch.column(2)]
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            start = size = 0
            for i in range(len(texts) + 1):
                if i < len(texts) and (not size or size + len(texts[i]) <= CHUNK_BYTES):
                    size += len(texts[i])
                    continue
                owner, position, h, c = finder.find(texts[start:i])
                owner = owner + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array((marks[owner] << 32) | position)],
                    names=["h", "c", "id", "loc"],
                )
                if i < len(texts):
                    start, size = i, len(texts[i])

    return docs.select("id", "mark", "text").mapInArrow(run, f"h long, c long, id {dict(docs.dtypes)['id']}, loc long")


# ---- the run-length index of one block --------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array by prefix doubling; symbols end with a unique least one."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    step = 1
    if alphabet < 1 << 20:  # three symbols at once
        padded = np.r_[rank + 1, 0, 0]
        rank = (padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:]
        step = 3
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if dense[order[-1]] == n - 1:
            return order
        rank = dense * (n + 1)
        rank[: n - step] += dense[step:] + 1
        # Suffixes that already stand alone keep their place; only runs of equal ones are sorted again.
        ordered = dense[order]
        tied = np.r_[False, ordered[1:] == ordered[:-1]]
        tied |= np.r_[tied[1:], False]
        at = np.flatnonzero(tied)
        order[at] = order[at][np.argsort(rank[order[at]], kind="stable")]
        step *= 2


def common_prefix(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to `most`."""
    padded = np.r_[symbols, np.full(8, -1, symbols.dtype)]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    last = len(symbols)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = np.ones(len(live), bool)
        for k in range(8):
            same &= (padded[np.minimum(x + k, last)] == padded[np.minimum(y + k, last)]) & (x + k < last) & (y + k < last)
            out[live[same]] += 1
        live = live[same & (out[live] < most)]
    return np.minimum(out, most)


def matching_statistics(texts: list[bytes]) -> list[np.ndarray]:
    """For each position the longest match, inside its text, with any other position of the texts."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    symbols = np.zeros(n, np.int32)
    inside = np.ones(n, bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32) + m
    symbols[ends] = np.arange(m)[::-1]  # separators differ, so no match crosses one
    order = suffix_order(symbols, m + 256)
    bwt = symbols[order - 1]  # of the first suffix the last symbol, as in a rotation
    change = np.flatnonzero(bwt[1:] != bwt[:-1])  # last row of each run but the final one
    most = int(sizes.max(initial=0)) + 1
    sampled = common_prefix(symbols, order[change], order[change + 1], most)
    best = np.zeros(n, np.int64)
    # Rows at a run's start are sampled with the row above, rows at a run's end with the row below.
    for rows in (change + 1, change):
        reach = np.zeros(n, np.int64)
        reach[order[rows]] = order[rows] + sampled
        best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(n))
    return [best[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def repeated_spans(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per text the maximal runs covered by strings of `length` bytes that occur elsewhere in the texts too."""
    out = []
    for text, best in zip(texts, matching_statistics(texts), strict=True):
        starts = np.flatnonzero(best >= length)
        if not len(starts):
            out.append([])
            continue
        cuts = np.flatnonzero(np.diff(starts) > length)
        out.append([(int(a), int(b) + length) for a, b in zip(starts[np.r_[0, cuts + 1]], starts[np.r_[cuts, len(starts) - 1]], strict=True)])
    return out


# ---- the operator -----------------------------------------------------------------------------------------------


def _block_spans(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(mark=pdf["loc"].to_numpy() >> 32).sort_values(["id", "mark", "start"], na_position="first", kind="stable")
        regions: list[list] = []  # of one text, overlapping contexts become one region, so that a byte occurs once
        for key, mark, start, context in zip(pdf["id"], pdf["mark"], pdf["start"], pdf["context"], strict=True):
            last = regions[-1] if regions else None
            if last and last[1] == mark and (last[0] == key or (pd.isna(last[0]) and pd.isna(key))) and start <= last[2] + len(last[3]):
                last[3] += context[last[2] + len(last[3]) - start :]
            else:
                regions.append([key, mark, start, bytearray(context)])
        spans = repeated_spans([bytes(r[3]) for r in regions], length)
        rows = [(r[0], r[1], r[2] + a, r[2] + b) for r, own in zip(regions, spans, strict=True) for a, b in own]
        out = pd.DataFrame(rows, columns=["id", "mark", "a", "b"])
        return out.astype({"mark": "int64", "a": "int64", "b": "int64"}) if len(out) else out

    return run


def find_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (id, mark, text) -> id, mark, a, b: spans (may overlap) whose union is all that repeats."""
    id_type = dict(docs.dtypes)["id"]
    found = anchors(docs, length, gram)
    # Saved on its own, so that the join below has two plain exchanges and Spark can split the rows of a hot gram.
    often = saved(found.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    hits = stored(found.join(often, "h"))
    # Saved for the same reason: a context that very many texts share is split in the semi-join below.
    kinds = stored(hits.groupBy("h", "c").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("loc").alias("loc")))
    per_gram = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    place = (F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")
    mark = F.shiftright("loc", 32)
    whole = hits.join(kinds.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("id", mark.alias("mark"), F.greatest(place - (length - gram), F.lit(0)).alias("a"), (place + length).alias("b"))
    wanted = kinds.join(per_gram.where("kinds > 1"), "h").select("h", "kinds", "id", "loc")
    asked = wanted.groupBy("id", mark.alias("mark")).agg(F.collect_list(F.struct("h", "kinds", "loc")).alias("asked"))  # at most an entry for each byte of the text
    texts = docs.select("id", "mark", "text")
    start = lambda x: F.greatest((x["loc"].bitwiseAND(F.lit(0xFFFFFFFF))) - (length - gram), F.lit(0))
    end = lambda x: (x["loc"].bitwiseAND(F.lit(0xFFFFFFFF))) + length
    same = texts["id"].eqNullSafe(asked["id"]) & (texts["mark"] == asked["mark"])
    data = F.encode(texts["text"], "utf-8")
    cut = texts.join(asked, same).select(texts["id"], data.alias("data"), "asked")
    cut = cut.select("id", F.transform("asked", lambda x: F.struct(x["h"].alias("h"), x["kinds"].alias("kinds"), x["loc"].alias("loc"), start(x).alias("start"), F.substring(F.col("data"), (start(x) + 1).cast("int"), (end(x) - start(x)).cast("int")).alias("context"))).alias("cut"))
    contexts = saved(cut.select("id", F.explode("cut").alias("x")).select("id", "x.*").where(F.length("context") >= length))
    blocks = max(1, contexts.count() // BLOCK_CONTEXTS)
    dealt = contexts.where(F.col("kinds") <= HOT_CONTEXTS).withColumn("block", F.pmod("h", F.lit(blocks)))
    spans = dealt.select("block", "id", "loc", "start", "context").groupBy("block").applyInPandas(_block_spans(length), f"id {id_type}, mark long, a long, b long")
    windows = contexts.where(F.col("kinds") > HOT_CONTEXTS).select("h", "id", mark.alias("mark"), "start", F.explode(F.transform(F.sequence(F.lit(0), F.length("context") - length), lambda i: F.struct((F.col("start") + i).alias("a"), F.substring(F.col("context"), i + 1, F.lit(length)).alias("w")))).alias("x"))
    windows = windows.select("h", "id", "mark", F.col("x.a").alias("a"), F.sha2("x.w", 256).alias("w"), F.xxhash64("id", "mark", "x.a").alias("at"))
    twice = windows.groupBy("h", "w").agg(F.min("at").alias("x"), F.max("at").alias("y")).where("x <> y").select("h", "w")
    hot = windows.join(twice, ["h", "w"], "left_semi").select("id", "mark", F.col("a").cast("long"), (F.col("a") + length).cast("long").alias("b"))
    return whole.select("id", F.col("mark").cast("long"), F.col("a").cast("long"), F.col("b").cast("long")).union(spans).union(hot)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All columns of docs, and __found: spans of repeated bytes in order of their start (null: none); see merge_spans."""
    keyed = docs.withColumn("__mark", F.hash(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long"))
    plain = keyed.select(F.col(key).alias("id"), F.col("__mark").alias("mark"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = find_spans(plain, length, gram)
    found = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("__found"))  # bounded by the text's length
    id_type = dict(plain.dtypes)["id"]
    # Written before the texts are shuffled again, so that what it took is off the disks by then.
    merged = stored(found.mapInArrow(_merge_runs, f"id {id_type}, mark long, __found array<struct<a:bigint,b:bigint>>"))
    release(docs.sparkSession)
    joined = keyed.join(merged, keyed[key].eqNullSafe(merged["id"]) & (keyed["__mark"] == merged["mark"]), "left").drop("id", "mark", "__mark")
    return joined


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third column: lists of spans -> lists of disjoint runs in order."""
    far = np.int64(1) << 40  # beyond any text; sets the rows of a batch apart
    for batch in batches:
        lists = batch.column(2)
        spans = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        a, b = (spans.field(i).to_numpy(zero_copy_only=False) + row * far for i in (0, 1))
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order]) if len(order) else b
        first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]]) if len(a) else np.zeros(0, np.int64)
        last = np.r_[first[1:] - 1, len(a) - 1] if len(a) else first
        owner = a[first] // far
        offsets = np.searchsorted(owner, np.arange(len(lists) + 1))
        runs = pa.StructArray.from_arrays([pa.array(a[first] % far), pa.array(b[last] - owner * far)], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], names=["id", "mark", "__found"])


def merge_spans(found: list[dict], size: int) -> list[tuple[int, int]]:
    """Disjoint runs in order, cut to the text."""
    out: list[list[int]] = []
    for s in found:
        a, b = s["a"], min(s["b"], size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(docs: DataFrame, text: str, found: str, fields: str, make) -> DataFrame:
    """Run make(whole text as bytes or None, runs) on each row; its results are the columns `fields` after those of docs."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, found)]
    types = dict(docs.dtypes)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix")
        kinds = {"long": pa.int64(), "string": pa.string()}
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column(0), batch.column(1), strict=True):
                data = None if (t := value.as_py()) is None else t.encode()
                rows.append(make(data, merge_spans(spans.as_py() or [], len(data or b""))))
            made = [pa.array([r[i] for r in rows], kinds[f.split()[1]]) for i, f in enumerate(fields.split(", "))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*rest, *names])

    schema = "".join(f"`{c}` {types[c]}, " for c in rest) + fields
    return docs.select(F.col(text).cast("string").alias(text), found, *rest).mapInArrow(run, schema)


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of data without the runs."""
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256."""

    def make(data: bytes | None, runs: list[tuple[int, int]]) -> tuple:
        data = data or b""
        return len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()

    found = remove_repeats(docs.select(key, text), text, key)
    return _cut(found, text, "__found", "n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def cut_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with repeated bytes cut from text; characters that a cut would split go whole. Null text stays null."""
    plain, (own, by), back = unnamed(docs, text, key)
    found = remove_repeats(plain, own, by)
    make = lambda data, runs: (None if data is None else kept_bytes(data, runs).decode("utf-8", "ignore"),)
    return back(_cut(found, own, "__found", f"{own} string", make))
