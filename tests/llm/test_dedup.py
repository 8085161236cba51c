"""SimHash, repeated byte strings and line dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import linededup, simhash, suffix
from tidemark.llm.common import table
from tidemark.llm.components import components
from tidemark.llm.queries import op9_simhash

# ---- repeated strings ---------------------------------------------------------------------------------------------


def brute_spans(texts, length):
    seen = Counter()
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def brute_digest(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (key, _), t, gone in zip(rows, texts, brute_spans(texts, length), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def random_texts(seed, n=60):
    """Random prose with copies, near copies, shared passages, periodic runs and boundaries at every distance."""
    rnd = random.Random(seed)
    prose = lambda k: "".join(rnd.choice("abcdefgh é") for _ in range(k))
    passages = [prose(k) for k in (150, 185, 199, 200, 201, 230, 320, 700)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, 60)
            parts.append(rnd.choice([prose(rnd.randint(0, 300)), p, p[cut:], p[: len(p) - cut], "ab" * rnd.randint(50, 200), "z" * rnd.randint(100, 450)]))
        texts.append("".join(parts))
        if rnd.random() < 0.3:
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 4)):
                if t:
                    t[rnd.randrange(len(t))] = "#"
            texts.append("".join(t))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_statistics(seed):
    texts = [t.encode()[:600] for t in random_texts(seed, 12)]
    for length in (1, 7, 60):
        got = suffix.repeated_spans(texts, length)
        for t, spans, gone in zip(texts, got, brute_spans(texts, length), strict=True):
            mine = bytearray(len(t))
            for a, b in spans:
                mine[a:b] = b"\1" * (b - a)
            assert mine == gone


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", 40)
    rows = list(enumerate(random_texts(5, 120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, suffix.digest(docs).collect()), key=str)
    assert got == brute_digest(rows)


def test_repeats_on_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = sorted(map(tuple, suffix.digest(docs).collect()), key=str)
    assert got == brute_digest([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_awkward(spark):
    got = sorted(map(tuple, suffix.digest(awkward(spark)).collect()), key=str)
    assert got == brute_digest([r[:2] for r in awkward_rows()])
    assert suffix.digest(empty(spark)).count() == 0
    cut = suffix.cut_text(awkward(spark))
    assert cut.columns == awkward(spark).columns and cut.count() == len(awkward_rows())


# ---- SimHash --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (key, _) in enumerate(rows):
        r = root(i)
        if key is not None and (least[r] is None or key < least[r]):
            least[r] = key
    return sorted(((key, f"{prints[i]:016x}", least[root(i)]) for i, (key, _) in enumerate(rows)), key=str)


def test_simhash_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, op9_simhash(spark, sf).collect()), key=str) == brute_components(rows)


def test_simhash_awkward(spark):
    found = simhash.near_duplicates(awkward(spark)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == brute_components([r[:2] for r in awkward_rows()])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_first(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert kept.where("doc_id = 0").count() == 1
    nulls = spark.createDataFrame([(None, "one two three four five six"), (None, "an entirely different text of words"), (None, "one two three four five six"), (7, "seven other words that nobody else has"), (7, "again something else under that key")], "doc_id long, text string")
    assert sorted(r.text[:5] for r in simhash.keep_first(nulls).collect()) == ["again", "an en", "one t", "seven"]


@pytest.mark.parametrize("group", [4096, 3])
def test_links_of_random_fingerprints(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd = random.Random(4)
    values = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(30):
            values.append(x)
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r.node: r.root for r in components(simhash.link_edges(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3))).collect()}
    rows = [(i, v) for i, v in enumerate(signed)]
    group = {v: v for _, v in rows}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j in range(i):
                if (a ^ values[j]).bit_count() <= 2:
                    low = min(group[signed[i]], group[signed[j]])
                    if group[signed[i]] != low or group[signed[j]] != low:
                        group[signed[i]] = group[signed[j]] = low
                        changed = True
    assert {v: got.get(v, v) for v in signed} == group


def test_large_group_pairs():
    rnd = np.random.default_rng(1)
    values = np.unique(np.uint64(1) << rnd.integers(0, 64, (500, 3), dtype=np.uint64)[:, 0] | rnd.integers(0, 7, 500).astype(np.uint64))
    pairs = {(int(a), int(b)) for i, j in simhash.link_groups(np.zeros(len(values), np.int64), values) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for b in range(len(values)) for a in range(b) if int(values[a] ^ values[b]).bit_count() <= 2}
    assert pairs == want


# ---- lines ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_line_dedup(spark, most):
    pages = [(i, f"own line {i}\n footer \n\nfooter" if i % 2 else f"page {i}\nfooter\nrare", "a" if i < 40 else None, 1) for i in range(60)]
    pages += [(100, None, "a", 1), (101, "", "b", 1), (102, "footer", "b", 1), (103, "footer", "b", 1)]
    docs = spark.createDataFrame(pages, "doc_id long, text string, source string, marks int")
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs, ratio=0.5, min_pages=3, max_broadcast=most).collect()}
    assert got[1] == "own line 1\n" and got[0] == "page 0\nrare"
    assert got[100] is None and got[101] == "" and got[102] == "footer"
    assert len(got) == len(pages)
    assert linededup.drop_boilerplate(empty(spark)).count() == 0
    assert linededup.drop_boilerplate(awkward(spark)).count() == len(awkward_rows())
