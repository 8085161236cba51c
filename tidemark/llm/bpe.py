"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is merged with one bucket per merge rank. A bucket holds a linked list of positions in
ascending order; two levels of bitmap words say which buckets are occupied, and find-first-set on them
gives the lowest rank. An entry whose pair changed since it was queued is stale and skipped. That makes a
merge cost a few word operations however long the pre-token is.

Edge cases: null text is empty; an empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Distinct pre-tokens a worker remembers, and the longest it remembers (characters). Only memory depends on them.
CACHE_ENTRIES, CACHE_CHARS = 700_000, 64
#: Bits of a bitmap word; Python integers have no fixed width, so two levels of wide words do.
WORD_BITS = 256

#: Letters, numbers, punctuation and white space whose classes every engine agrees on.
_ALPHABET = "\t\n\r -~¡-ſ‐-‧"
_unusual = re.compile(f"[^{_ALPHABET}]").search


def _members(category: str) -> str:
    """Class text of the alphabet's characters in a Unicode category."""
    return "".join(re.escape(c) for c in map(chr, range(0x2030)) if re.match(f"[{_ALPHABET}]", c) and unicodedata.category(c)[0] == category)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Priority queue of (rank, position) over bucket lists and two levels of occupancy bitmaps.

    `top` has a bit for each word of `low` that is not zero, `low` a bit for each rank whose bucket holds a position.
    Empty again after use, so one queue serves every pre-token. Positions stay below 2**32.
    """

    def __init__(self, n_ranks: int) -> None:
        self.bit = [1 << i for i in range(WORD_BITS)]
        self.low = [0] * (n_ranks // WORD_BITS + 1)
        self.top = 0
        self.head = [-1] * (n_ranks + 1)
        self.tail = [-1] * (n_ranks + 1)
        self.after: dict[int, int] = {}

    def push(self, rank: int, position: int) -> None:
        head = self.head[rank]
        if head < 0:
            self.head[rank] = self.tail[rank] = position
            at, within = divmod(rank, WORD_BITS)
            self.low[at] |= self.bit[within]
            self.top |= 1 << at
            return
        after, base = self.after, rank << 32
        if position > self.tail[rank]:
            after[base | self.tail[rank]] = position
            self.tail[rank] = position
        elif position < head:
            after[base | position] = head
            self.head[rank] = position
        else:
            at = head
            while at != position and (following := after.get(base | at, -1)) >= 0 and following <= position:
                at = following
            if at != position:
                after[base | position] = after[base | at]
                after[base | at] = position

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; rank -1 if empty."""
        first = self.top & -self.top
        if not first:
            return -1, -1
        at = first.bit_length() - 1
        word = self.low[at]
        lowest = word & -word
        rank = at * WORD_BITS + lowest.bit_length() - 1
        position = self.head[rank]
        following = self.after.pop(rank << 32 | position, -1) if self.after else -1
        self.head[rank] = following
        if following < 0:
            word ^= lowest
            self.low[at] = word
            if not word:
                self.top ^= first
        return rank, position


class BytePairEncoder:
    """Ranks, pattern and queue of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token_of = {rank: token for token, rank in ranks.items()}
        self._split = regex.compile(pattern).findall
        letters, numbers = _members("L"), _members("N")
        plain = pattern.replace(r"\s\p{L}\p{N}", rf"\s{letters}{numbers}").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        self._split_plain = re.compile(plain).findall if "\\p" not in plain else self._split
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; texts of common Latin characters take the same pattern with its classes spelt out, which is faster."""
        return self._split_plain(text) if _unusual(text) is None else self._split(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        find = self.ranks.get
        whole = find(piece)
        if whole is not None:
            return [whole]
        n, push, pop = len(piece), self.queue.push, self.queue.pop
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i stops
        before = list(range(-1, n - 1))
        pair = [find(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        for i in range(n - 2, -1, -1):
            if pair[i] >= 0:
                push(pair[i], i)
        while True:
            rank, i = pop()
            if rank < 0:
                break
            if pair[i] != rank:
                continue  # stale: the pair changed after it was queued
            j = end[i]
            stop = end[i] = end[j]
            pair[j] = -1
            if stop < n:
                before[stop] = i
                pair[i] = new = find(piece[i : end[stop]], -1)
                if new >= 0:
                    push(new, i)
            else:
                pair[i] = -1
            k = before[i]
            if k >= 0:
                pair[k] = new = find(piece[k:stop], -1)
                if new >= 0:
                    push(new, k)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token_of[i] for i in ids])


class _Memo(dict):
    """Pre-token -> (ids as decimal text, decoded bytes), filled on demand; bounded by clearing."""

    def __init__(self, encoder: BytePairEncoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        ids = self.encoder.encode_piece(piece.encode())
        value = ",".join(map(str, ids)), self.encoder.decode(ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=4)
def _encoder(ranks_path: str, pattern: str) -> tuple[BytePairEncoder, _Memo]:
    """One encoder and memo for each file and worker process, kept from task to task."""
    encoder = BytePairEncoder(read_ranks(ranks_path), pattern)
    return encoder, _Memo(encoder)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids. Map-only: no shuffle.

    Every worker reads the rank file, a fixed-size vocabulary. Repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memo = _encoder(ranks_path, pattern)
        for batch in batches:
            counts, ids_of, hashes, decoded = [], [], [], []
            for value in batch.column(1):
                parts = list(map(memo.__getitem__, encoder.split(value.as_py() or "")))
                ids, found = zip(*parts, strict=True) if parts else ((), ())
                joined = ",".join(ids)
                counts.append(joined.count(",") + 1 if joined else 0)
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(found)).hexdigest())
                if with_ids:
                    ids_of.append(list(map(int, joined.split(","))) if joined else [])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
