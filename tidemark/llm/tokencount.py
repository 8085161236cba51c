"""Token counts without ids: pieces per distinct pre-token, joined to per-document pre-token frequencies.

1. Workers count pre-tokens; Spark sums them to the corpus vocabulary, and every distinct pre-token is tokenised once.
2. The most frequent part of that vocabulary, whose size is bounded by HOT_ENTRIES x HOT_CHARS, is broadcast and joined
   to the document frequencies as they are made. All other (document, pre-token, n) rows are joined to the vocabulary by
   a shuffle, so nothing is dropped and no frequent key reaches the shuffle.
3. The products are summed per row.

Edge cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted separately, each with its own row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, small_batches
from tidemark.llm.wordpiece import word_tokenizer

#: Bound of the broadcast vocabulary: entries, and characters of each.
HOT_ENTRIES, HOT_CHARS = 65_536, 64
#: Pre-tokens that a worker gathers before it passes its partial counts on.
FLUSH_ENTRIES = 200_000


def vocabulary(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Distinct pre-tokens of the corpus: pretoken, n (occurrences), pieces (tokens it makes)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = word_tokenizer(tokenizer_path), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pretoken", "n"])
            seen.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                seen.update(tokenizer.pretokens(value.as_py() or ""))
                if len(seen) > FLUSH_ENTRIES:
                    yield flush()
        yield flush()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            n = [len(ids) for ids in tokenizer.ids(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["pretoken", "n", "pieces"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "pretoken string, n long")
    return counted.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(pieces, "pretoken string, n long, pieces long")


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Per row of docs: key, n_bytes (UTF-8), n_tokens, over_limit."""
    spark = docs.sparkSession
    small_batches(spark)
    vocab = saved(vocabulary(docs, tokenizer_path, text))
    # Entries by size class (a few dozen classes per doubling of n): the largest classes that fit the bound are hot.
    size_class = F.floor(F.log2("n") * 32)
    short = vocab.where(F.length("pretoken") <= HOT_CHARS)
    classes = sorted(((r.k, r.m) for r in short.groupBy(size_class.alias("k")).agg(F.count("*").alias("m")).collect()), reverse=True)  # at most 32 x 64
    least, total = None, 0
    for k, m in classes:
        total += m
        if total > HOT_ENTRIES:
            break
        least = k
    hot_rows = short.where(size_class >= least).select("pretoken", "pieces").collect() if least is not None else []  # at most HOT_ENTRIES
    hot = spark.sparkContext.broadcast({r.pretoken: r.pieces for r in hot_rows})
    key_type = dict(docs.dtypes)[key]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the broadcast part gives, and one for each other pre-token of it."""
        tokenizer, known = word_tokenizer(tokenizer_path), hot.value
        for batch in batches:
            rows, sizes, sums, tokens, counts = [], [], [], [], []
            for i, value in enumerate(batch.column(2)):
                content, total = value.as_py() or "", 0
                rest: list[tuple[str, int]] = []
                for token, n in Counter(tokenizer.pretokens(content)).items():
                    pieces = known.get(token)
                    if pieces is None:
                        rest.append((token, n))
                    else:
                        total += n * pieces
                rows.append(i)
                sizes.append(len(content.encode()))
                sums.append(total)
                tokens.append(None)
                counts.append(0)
                for token, n in rest:
                    rows.append(i)
                    sizes.append(0)
                    sums.append(0)
                    tokens.append(token)
                    counts.append(n)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())],
                names=["row", "key", "n_bytes", "known", "pretoken", "n"],
            )

    long = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        frequencies, f"row long, key {key_type}, n_bytes long, known long, pretoken string, n long"
    )
    # A document's own row matches no pre-token; its join key is made unique so that such rows spread evenly.
    long = long.withColumn("pretoken", F.coalesce("pretoken", F.concat(F.lit(" "), F.col("row").cast("string"))))
    joined = long.join(vocab.select("pretoken", "pieces"), "pretoken", "left")
    tokens = F.col("known") + F.coalesce(F.col("n") * F.col("pieces"), F.lit(0))
    return (
        joined.groupBy("row")
        .agg(F.max("key").alias("key"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
        .select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
