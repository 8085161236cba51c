"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: slot i is a word whose bit l says that language l set
slot i, so the AND of an n-gram's slots gives at once every language that contains it. Per text the bits are counted
for each language, the counts are corrected for the filter's false positives, and the largest decides.

N-grams are runs of NGRAM bytes of the UTF-8 text with A-Z lower-cased and all other ASCII characters that are not
letters turned into one separator. A language's filter gets the n-grams that are common in its documents and not far
more common in another language's, so stray or mislabelled documents do not blur the sets.

The filters are fitted on a bounded sample: about SAMPLE_DOCS labelled documents of each language, picked by a hash of
their id. All n-grams of the sample that pass take part; the filter's size follows their number. Prediction never sees
label, source or id.

Edge cases: null text, or text without a letter, gives `und` with score 0; text with letters in which no n-gram is known
gets the most frequent language with score 0; ties go to the language that sorts first; without labelled rows every text
is `und`; repeated rows are judged each on its own, alike; very long texts are read whole; an empty table gives no rows;
input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import begin, small_batches, unnamed

#: Documents of each language that the filters are fitted on, about.
SAMPLE_DOCS = 4000
NGRAM = 4
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate in any.
RATE_SHARE = 0.3
#: Filter: least number of slots (as a power of two), slots for each n-gram, hashes of each n-gram, languages of a word.
SLOT_BITS, SLOTS_EACH, HASHES, WORD_LANGUAGES = 20, 10, 4, 64
#: Bytes of text handled at once; only memory depends on it.
CHUNK_BYTES = 2_000_000
UNKNOWN = "und"

_letter = re.compile(r"[^\W\d_]").search
_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]  # odd numbers spread the bits
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-byte n-grams that start at each byte, and whether each has a letter and at most its ends blank."""
    b = _FOLD[data]
    w = b.astype(np.uint32)
    codes = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
    solid = b != 32
    return codes, solid[1:-2] & solid[2:-1]


def _chunks(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > CHUNK_BYTES:
            yield start, values[start:i]
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, values[start:]


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filter of several languages; one array of words for each WORD_LANGUAGES of them."""

    languages: list[str]
    slots: list[np.ndarray]
    false_rate: np.ndarray  # of each language's filter
    default: str = UNKNOWN  # for texts without a known n-gram

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], default: str = UNKNOWN) -> LanguageFilters:
        languages = sorted(grams)
        bits = max(SLOT_BITS, (SLOTS_EACH * max((len(g) for g in grams.values()), default=1) - 1).bit_length())
        words, filled = [], []
        for start in range(0, len(languages), WORD_LANGUAGES):
            part = languages[start : start + WORD_LANGUAGES]
            width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(part) <= np.dtype(t).itemsize * 8)
            slots = np.zeros(1 << bits, width)
            for bit, language in enumerate(part):
                for slot in cls._slots(np.asarray(grams[language], np.uint32), bits):
                    slots[slot] |= width(1 << bit)
            words.append(slots)
            filled += [((slots >> width(bit)) & width(1)).mean() for bit in range(len(part))]
        return cls(languages, words, np.array(filled) ** HASHES, default)

    @staticmethod
    def _slots(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        for m in _MULTIPLIERS[:HASHES]:
            mixed = codes * m
            yield (mixed ^ mixed >> np.uint32(15)) >> np.uint32(32 - bits)

    def masks(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the bits of all languages of a word that contain it."""
        found, slots = None, self.slots[word]
        for slot in self._slots(codes, len(slots).bit_length() - 1):
            found = slots[slot] if found is None else found & slots[slot]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        data = [(t or "").encode() for t in texts]
        names, scores = [UNKNOWN] * len(data), [0.0] * len(data)
        for start, part in _chunks(data) if self.languages else ():
            joined = np.frombuffer(b"    ".join(part) + b"    ", np.uint8)
            starts = np.cumsum([0, *(len(p) + 4 for p in part)])[:-1]
            codes, valid = _grams(joined)
            total = np.add.reduceat(valid, starts, dtype=np.int64)
            counts = []
            for word in range(len(self.slots)):
                masks = self.masks(codes, word)
                masks[~valid] = 0
                kind = masks.dtype.type
                here = min(WORD_LANGUAGES, len(self.languages) - word * WORD_LANGUAGES)
                counts += [np.add.reduceat((masks >> kind(bit)) & kind(1), starts, dtype=np.int64) for bit in range(here)]
            corrected = np.maximum(0, (np.stack(counts) - total * self.false_rate[:, None]) / (1 - self.false_rate[:, None]))
            best = corrected.argmax(axis=0)
            for i in range(len(part)):
                top = corrected[best[i], i]
                if not texts[start + i] or not _letter(texts[start + i]):
                    continue
                names[start + i] = self.languages[best[i]] if top > 0 else self.default
                if top > 0:
                    scores[start + i] = float(min(1.0, top / corrected[:, i].sum()))
        return names, scores


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageFilters:
    """Filters from the rows with non-null text and lang; see SAMPLE_DOCS for the sample."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    per_language = {r[lang]: r.n for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not per_language:
        return LanguageFilters([], [], np.zeros(0))
    # A hash below the language's share of the hash range keeps about SAMPLE_DOCS rows of it, without a sort.
    chance = F.coalesce(*[F.when(F.col(lang) == name, F.lit(SAMPLE_DOCS / n)) for name, n in sorted(per_language.items())])
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < chance * (1 << 30))
    sample = sample.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        seen: Counter = Counter()
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, valid = _grams(np.frombuffer(b"    " + value.as_py().encode() + b"    ", np.uint8))
                seen.update((language, c) for c in np.unique(codes[valid]).tolist())
                seen[language, -1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array(seen.values(), pa.int64())], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.where("gram = -1").select("lang", F.col("n").alias("docs"))
    rated = counts.where("gram >= 0 and n >= 2").join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("docs"))  # a row a language
    rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= RATE_SHARE * F.col("top"))
    chosen = rated.select("lang", "gram").toArrow()  # n-grams of a bounded sample
    names, codes = np.array(chosen["lang"].to_pylist(), object), chosen["gram"].to_numpy()
    return LanguageFilters.build({name: codes[names == name].astype(np.uint32) for name in per_language}, max(per_language, key=lambda k: (per_language[k], k)))


def predict(docs: DataFrame, filters: LanguageFilters, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs behind two more, the language and its score. Map-only."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # a word a slot; slots follow the sample, not the corpus
    fields = [f for f in docs.schema.fields if f.name not in names]
    columns = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        for batch in batches:
            found, scores = shared.value.predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64()), *batch.columns[1:]], names=[*names, *columns])

    schema = f"`{names[0]}` string, `{names[1]}` double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    plain, (own,), _ = unnamed(docs, text)
    rest = [F.col(f"c{docs.columns.index(c)}") for c in columns]
    return plain.select(F.col(own).cast("string").alias("text"), *rest).mapInArrow(run, schema)


def keep_known(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """docs without the texts whose language cannot be told: no letter, or none of the learned n-grams. If no n-gram was
    learned, all texts with a letter stay.
    """
    if not any(slots.any() for slots in filters.slots):
        return docs.where(F.col(text).cast("string").rlike(r"\p{L}"))
    plain, (own,), back = unnamed(docs, text)
    return back(predict(plain, filters, own, ("lang", "score")).where((F.col("lang") != UNKNOWN) & (F.col("score") > 0)))
