import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import awkward, empty
from tidemark.llm import nearcopies
from tidemark.llm.common import table


def brute_kept(rows, limit=0.8):
    """Smallest keys of the components linked at the similarity, over all pairs."""
    sets = []
    for _, text in rows:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    return {min(keys) for keys in least.values()}


def test_near_copies_leave_the_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:  # near copies at similarity 0.8 used to stay
        docs = stage(spark, docs, sf) if name.endswith(("simhash_dedup", "shingle_dedup")) else docs
    assert {r.doc_id for r in docs.collect()} == brute_kept(rows) and not {145, 177} & {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("block", [1500, 4])
def test_families_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", block)
    draw, rows = random.Random(5), []
    for family in range(12):
        words = [f"f{family}w{draw.randrange(900)}" for _ in range(draw.randrange(3, 220))]
        for _ in range(9):
            copy = list(words)
            for _ in range(draw.randrange(0, 1 + len(words) // 30)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in nearcopies.keep_first(docs).collect()} == brute_kept(rows)


def test_awkward(spark):
    docs = awkward(spark)
    kept = nearcopies.keep_first(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert nearcopies.keep_first(empty(spark)).count() == 0
    maps = docs.selectExpr("*", "map('a', 1) AS more", "doc_id AS root", "text AS node")
    assert nearcopies.keep_first(maps).count() == kept.count()


def test_chain_is_one_group(spark, monkeypatch):
    """Each text is linked to the next one only; blocks and leaders must not lose a link."""
    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", 3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 120])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in nearcopies.keep_first(docs).collect()} == brute_kept(rows) == {0}


def test_no_link_is_lost_beyond_the_radius():
    """Four of five shingles in common, 29 bits apart, and only over the set between them is the third one linked to the first."""
    five = np.array([9744031708884459876, 14880294384975044028, 2048332701432296027, 15696892895590976931, 15251102396892235966], np.uint64)
    sets = [np.sort(np.r_[five, np.uint64(77)]), np.sort(five), np.sort(five[:4])]
    assert bin(nearcopies.set_fingerprint(sets[1]) ^ nearcopies.set_fingerprint(sets[2])).count("1") > nearcopies.RADIUS
    assert sorted(nearcopies.links(np.arange(3), sets)) == [(0, 1), (1, 2)]


def test_counts_give_up_no_link():
    rng = np.random.default_rng(5)
    for shared in (1, 4, 30, 400, 3000):
        base = rng.integers(0, 1 << 63, shared, np.uint64) * np.uint64(2)
        sets = [np.unique(np.r_[rng.permutation(base)[: int(len(base) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(len(base) * rng.uniform(0, 0.2)), np.uint64)]) for _ in range(40)]
        sets = [s for s in sets if len(s)] + [rng.integers(0, 1 << 63, max(30, shared), np.uint64) for _ in range(20)]
        near = nearcopies.by_counts(sets, 0.8)
        given_up = unlike = 0
        for i, one in enumerate(sets):
            found = set(near(i, np.ones(len(sets), bool)))
            given_up += len(sets) - len(found)
            like = [len(np.intersect1d(one, s)) / len(np.union1d(one, s)) >= 0.8 for s in sets]
            unlike += len(sets) - sum(like)
            assert found >= set(np.flatnonzero(like))
        assert given_up > unlike / 2
