"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

One pass measures every whole text. Each rule then votes good (+1), bad (-1) or abstains (0). Documents are counted by
vote pattern, of which there are at most 3 ** len(RULES) whatever the corpus, and expectation-maximisation over those
counts estimates how often each rule is right and how common good documents are. The posterior of a document's pattern
is its quality probability; `kept` asks for at least `threshold` instead of asking for every rule to pass.

Edge cases: null or wordless text has zero counts and base_failed; ties (posterior equal to the threshold) are kept; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Base rule: fewest words, and largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Words of a window whose repeats count.
WINDOW = 3
#: Rounds of expectation-maximisation; weight of the prior as a share of the corpus, prior share of good documents, and
#: prior rates of the votes bad, none, good: first for bad documents, then for good ones. A good document draws a bad vote from
#: any rule at most MOST_FALSE of the time, which keeps a common defect from passing as normal.
ROUNDS, PRIOR_WEIGHT, PRIOR_GOOD = 60, 0.02, 0.8
MOST_FALSE = 0.01
PRIOR_RATES = ((0.2, 0.05, 0.75), (0.005, 0.095, 0.9))
SYMBOLS = "#*$%&|<>"
#: What a plain word of letters may be wrapped in.
PUNCTUATION = ".,;:!?()\"'«»“”’-"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps_words", "n_marks", "n_lines", "n_plain_words"]

_symbols = re.compile(f"[{re.escape(SYMBOLS)}]").findall
_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window that occurs at least twice in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    code = ids[:n].copy()
    for k in range(1, window):
        # Dense renumbering after each step keeps the codes of any text length within 64 bits.
        code = np.unique(code * len(number) + ids[k : n + k], return_inverse=True)[1]
    often = np.flatnonzero(np.bincount(code)[code] >= 2)
    covered = np.zeros(len(words) + 1, np.int64)
    covered[often] += 1
    covered[often + window] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The METRICS of one text."""
    words = _words(text)
    seen: set[str] = set()
    repeated = lines = 0
    for line in text.split("\n"):
        if line and (line[0] > " " or _words(line)):
            lines += 1
            repeated += line in seen
            seen.add(line)
    caps = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, [w.strip(PUNCTUATION) for w in words]))
    return len(words), sum(map(len, words)), len(_symbols(text)), repeated, repeat_words(words), caps, text.count("!"), lines, plain


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key and METRICS."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(v.as_py() or "") for v in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(METRICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *METRICS])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, " + ", ".join(f"{m} long" for m in METRICS)
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _rules() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "length": _vote(F.col("n_words") >= 60, F.col("n_words") < 50),
        "word_length": _vote(mean.between(3, 12), (mean < 2) | (mean > 20)),
        "symbols": _vote(F.col("n_symbols") <= 0.05 * words, F.col("n_symbols") > 0.3 * words),
        "line_repeats": _vote(F.col("n_dup_lines") <= 0.2 * lines, F.col("n_dup_lines") > 0.5 * lines),
        "word_repeats": _vote(F.col("n_repeat_words") <= 0.2 * words, F.col("n_repeat_words") > 0.4 * words),
        "shouting": _vote(F.col("n_caps_words") <= 0.1 * words, F.col("n_caps_words") > 0.4 * words),
        "exclamations": _vote(F.col("n_marks") <= 0.05 * words, F.col("n_marks") > 0.3 * words),
        "plain_words": _vote(F.col("n_plain_words") >= 0.9 * words, F.col("n_plain_words") < 0.65 * words),
    }


#: Names of the voting rules.
RULES = ("length", "word_length", "symbols", "line_repeats", "word_repeats", "shouting", "exclamations", "plain_words")


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Share of good documents, vote rates [rule, class, vote + 1] (class 0 bad, 1 good), posterior of each pattern.

    Each rule has its own rates of bad, no and good votes for bad and for good documents, so a rule that knows one
    defect only may vote good on documents with another. The prior counts weigh PRIOR_WEIGHT of the corpus at any size.
    """
    if not patterns:
        return 0.5, np.zeros((0, 2, 3)), {}
    votes = np.array([v for v, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    total = max(n.sum(), 1.0)
    prior = PRIOR_WEIGHT * total
    onehot = votes[:, :, None] == np.arange(3)
    share, rates = PRIOR_GOOD, np.tile(np.array(PRIOR_RATES), (votes.shape[1], 1, 1))
    for _ in range(rounds + 1):
        likelihood = np.stack([np.log(rates[np.arange(votes.shape[1]), k, votes]).sum(axis=1) for k in (0, 1)])
        odds = np.log(share / (1 - share)) + likelihood[1] - likelihood[0]
        good = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        share = (prior * PRIOR_GOOD + (n * good).sum()) / (prior + total)
        for k, weight in ((0, n * (1 - good)), (1, n * good)):
            seen = (onehot * weight[:, None, None]).sum(axis=0) + prior * np.array(PRIOR_RATES[k])
            rates[:, k] = seen / seen.sum(axis=1, keepdims=True)
        rates[:, 1, 0] = np.minimum(rates[:, 1, 0], MOST_FALSE)
    return float(share), rates, {tuple(v): float(p) for (v, _), p in zip(patterns, good, strict=True)}


def judged(measures: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality_probability and kept to a table of METRICS. It is read twice; save it first."""
    spark = measures.sparkSession
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    voted = measures.withColumns({f"vote_{name}": vote for name, vote in _rules().items()} | {"base_failed": failed})
    names = [f"vote_{name}" for name in RULES]
    # Documents that the base rule decides do not shape the model; their patterns still get a posterior.
    counted = voted.groupBy(*names).agg(F.count_if(~F.col("base_failed")).alias("n")).orderBy(*names)
    patterns = [(tuple(r[n] for n in names), r.n) for r in counted.collect()]
    _, _, posterior = fit_votes(patterns)
    table = spark.createDataFrame([(*votes, p) for votes, p in posterior.items()], ", ".join(f"{n} int" for n in names) + ", quality_probability double")
    return (
        voted.join(F.broadcast(table), names)  # one row for each vote pattern, at most 3 ** len(RULES)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
        .drop(*names)
    )
