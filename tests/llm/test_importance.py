"""Importance resampling against a plain loop over words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import importance
from tidemark.llm.common import table
from tidemark.llm.queries import op12_importance_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target):
    s, t = Counter(), Counter()
    found = [(key, *plain(text)) for key, text in docs]
    for _, _, buckets in found:
        s.update(buckets)
    for text in target:
        t.update(plain(text)[1])
    total, aimed = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (aimed + 10_000)))) for b in range(10_000)]
    rows = []
    for key, words, buckets in found:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        rows.append((key, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    best = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = 5 * len(best) // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(best)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_on_the_whole_table(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, sf, "benchmark").select("text").collect()]
    found = collected(op12_importance_resampling(spark, sf))
    assert found == brute(docs, target)
    assert sum(r[4] is not None for r in found) == 5 * sum(len(plain(t)[0]) >= 20 for _, t in docs) // 100 > 5


def test_awkward_rows(spark):
    target = spark.createDataFrame([("naïve café word1 word2", "clash"), (None, "clash")], "text string, key string")
    found = collected(importance.resample(awkward(spark), target))
    assert found == brute([(r[0], r[1]) for r in awkward_rows()], ["naïve café word1 word2", None])
    assert importance.resample(empty(spark), target).count() == 0
    assert importance.resample(awkward(spark), target.where("false")).count() == len(awkward_rows())


def test_equal_rows_are_ranked_each(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text)] * 150 + [(8, text + " more")] * 10, "doc_id long, text string").repartition(5)
    found = collected(importance.resample(docs, docs))
    assert found == brute([(7, text)] * 150 + [(8, text + " more")] * 10, [text] * 150 + [text + " more"] * 10)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 9))


@pytest.mark.parametrize("held", [500_000, 5])
def test_features_of_long_words_and_pieces(monkeypatch, held):
    monkeypatch.setattr(importance, "WORDS", held)
    texts = ["É" * 300 + " b " + "x" * 500 + " y " + " ".join("z" * n for n in range(44, 52)), None, "", "Aa bB\x00c\x7fd 9", "one", "one two"]
    found = [[] for _ in texts]
    for row, bucket in importance.features(*importance.words(pa.array(texts, pa.string()))):
        for i, b in zip(row.tolist(), bucket.tolist(), strict=True):
            found[i].append(b)
    assert [sorted(f) for f in found] == [sorted(plain(t)[1]) for t in texts]


def test_kernels_take_slices():
    texts = pa.array([f"Word{i} and Ünit{i}" for i in range(40)])
    row, index, words = importance.words(texts.slice(13, 20))
    assert [words[i].decode() for i in index[np.asarray(row) == 2]] == ["word15", "and", "Ünit15"]
