"""BPE, token counts and packing against the libraries."""

import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import bpe, packing, tokencount
from tidemark.llm.common import table
from tidemark.llm.wordpiece import WordTokenizer

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libraries():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(WORDS)


ours = bpe.BytePairEncoder(bpe.read_ranks(RANKS), P.PATTERN)
words = WordTokenizer(WORDS)
theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_library(text):
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_word_pretokens_equal_library(text):
    assert [i for ids in words.ids(words.pretokens(text)) for i in ids] == words.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", ["a" * 4000, "ab" * 2000, "etaoin" * 900, "é" * 999])
def test_very_long_pretoken(piece):
    assert ours.encode(piece) == theirs.encode_ordinary(piece)


def test_queue_order_and_stale_entries():
    queue = bpe.RankQueue(70_000)
    pushed = [(5, 9), (5, 2), (69_000, 1), (5, 4), (4096, 3), (5, 9), (0, 7)]
    for entry in pushed:
        queue.push(*entry)
    got = []
    while (entry := queue.pop())[0] >= 0:
        got.append(entry)
    assert got == sorted(set(pushed))


def test_bytes_query(spark, libraries):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(awkward(spark), RANKS, P.PATTERN).collect()}
    want = set()
    for doc_id, text, *_ in awkward_rows():
        ids = libraries[0].encode_ordinary(text or "")
        want.add((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    assert bpe.encode_documents(empty(spark), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("hot", [0, 30, 65_536])
def test_token_counts(spark, libraries, monkeypatch, hot):
    monkeypatch.setattr(tokencount, "HOT_ENTRIES", hot)
    got = sorted(map(tuple, tokencount.count_tokens(awkward(spark), WORDS, limit=100).collect()), key=str)
    want = []
    for doc_id, text, *_ in awkward_rows():
        n = len(libraries[1].encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert tokencount.count_tokens(empty(spark), WORDS).count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_places_every_piece(spark, libraries):
    rows = packing.pack_documents(awkward(spark), WORDS, capacity=64).collect()
    check_packing(rows, 64)
    want = []
    for doc_id, text, *_ in awkward_rows():
        ids = libraries[1].encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want.append((doc_id, k // 64, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


def test_packing_is_near_the_bound(spark, sf):
    rows = packing.pack_documents(table(spark, sf.replace("0.001", "0.01"), "documents"), WORDS).collect()
    assert check_packing(rows, 2048) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def placed_by(plan, capacity=2048):
    placed = defaultdict(int)
    for content, times in plan:
        assert times > 0 and sum(k * a for k, a in content.items()) <= capacity
        for k, a in content.items():
            placed[k] += a * times
    return placed


def test_program_beats_plain_best_fit():
    counts = {700: 300, 680: 300, 668: 300, 1100: 100, 948: 100}  # 700 + 680 + 668 and 1100 + 948 fill exactly
    plan = packing.plan_sequences(counts)
    assert placed_by(plan) == counts
    assert sum(t for _, t in plan) <= 410


@pytest.mark.parametrize("times", [1, 3, 10, 50, 300])
def test_plan_against_best_fit_and_bound(spark, sf, times):
    """The histogram of a table, multiplied: never above best fit, and within a sequence or two of the program's bound."""
    pieces = packing.token_pieces(table(spark, sf.replace("0.001", "0.01"), "documents"), WORDS)
    counts = {r.length: r["count"] * times for r in pieces.groupBy("length").count().collect()}
    plan = packing.plan_sequences(counts)
    assert placed_by(plan) == counts
    total, bound = sum(t for _, t in plan), packing.solve_program(counts, 2048)[1]
    assert total <= sum(t for _, t in packing.best_fit(counts, 2048))
    assert sum(k * v for k, v in counts.items()) / 2048 - 1e-6 <= bound <= total <= bound + 2


def test_program_is_used(monkeypatch):
    """Without the program's configurations the plan is another one, on few pieces too."""
    counts = {1000 + i: 1 for i in range(0, 300, 7)} | {300 + i: 2 for i in range(60)}
    monkeypatch.setattr(packing, "best_fit", lambda counts, capacity: [({1: 1}, 10**9)])
    plan = packing.plan_sequences(counts)
    assert placed_by(plan) == counts and sum(t for _, t in plan) <= sum(k * v for k, v in counts.items()) / 2048 + 2
    assert packing.plan_sequences({}) == [] and packing.plan_sequences({5: 1}) == [({5: 1}, 1)]


def test_bound_is_a_bound():
    counts = {1100: 7, 900: 2, 150: 1}
    used, bound = packing.solve_program(counts, 2048)
    assert bound <= sum(x for _, x in used) + 1e-9 and sum(t for _, t in packing.plan_sequences(counts)) == 7


def test_knapsack_against_brute_force():
    import itertools

    import numpy as np

    lengths, prices = np.array([3, 5, 8]), np.array([2.0, 4.0, 6.5])
    got = packing.price_configuration(lengths, prices, 21)
    best = max(sum(p * a for p, a in zip(prices, c)) for c in itertools.product(range(8), repeat=3) if sum(x * a for x, a in zip(lengths, c)) <= 21)
    assert sum(prices[list(lengths).index(k)] * a for k, a in got.items()) == best
