"""SetSketch near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import nearcopies, setsketch
from tidemark.llm.common import table
from tidemark.llm.queries import op13_setsketch


def shingle_set(text):
    words = [w for w in (text or "").encode().lower().split()]
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """(key, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [key]
        least = min((m for m in members if m is not None), default=None)
        out.append((key, len(sets[i]), least, key == least))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    found = collected(op13_setsketch(spark, sf))
    assert found == brute(rows)
    assert any(not r[3] for r in found)


def test_awkward_rows(spark):
    assert collected(setsketch.near_duplicates(awkward(spark))) == brute([(r[0], r[1]) for r in awkward_rows()])
    assert setsketch.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1500, 7])
def test_families_around_the_limit(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", block)
    rnd = random.Random(5)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 2, 5, 30, 150, 400]))]
        for _ in range(25):
            words = list(base)
            for _ in range(int(len(words) * rnd.choice([0, 0.01, 0.04, 0.05, 0.06, 0.12]))):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words).upper() if rnd.random() < 0.2 else "  ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(setsketch.near_duplicates(df)) == brute(rows)


def test_registers_merge_and_estimates_follow():
    rnd = np.random.default_rng(1)
    one, two = (np.unique(rnd.integers(0, 1 << 63, 3000, np.uint64)) for _ in range(2))
    union = np.union1d(one, two)
    assert (np.maximum(setsketch.registers(one), setsketch.registers(two)) == setsketch.registers(union)).all()
    for share in (0.1, 0.5, 0.8, 0.95):
        other = np.r_[one[: int(len(one) * 2 * share / (1 + share))], two[: len(one) - int(len(one) * 2 * share / (1 + share))]]
        counts = setsketch.counted(setsketch.registers(one), setsketch.registers(other)[None, :])
        assert abs(setsketch.estimate(*counts, len(one), np.array([len(other)]))[0] - share) < 0.1
    assert not setsketch.registers(np.zeros(0, np.uint64)).any()
