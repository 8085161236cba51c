import corpus_pipeline
from tests.llm.helpers import awkward, empty
from tests.llm.test_dedup import brute_digest
from tests.llm.test_nearcopies import brute_kept
from tidemark.llm import langid, linededup, suffix
from tidemark.llm.common import table


def test_stages_and_result(spark, sf):
    docs, columns = table(spark, sf, "documents"), table(spark, sf, "documents").columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, sf)
        if i < 4:
            assert docs.columns == columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "simhash_dedup":
            kept = {r.doc_id for r in docs.collect()}
            assert kept == brute_kept([(r.doc_id, r.text) for r in before.collect()])
        if name == "suffix_dedup":
            want = {r[0]: r[1] - r[2] for r in brute_digest([(r.doc_id, r.text) for r in before.collect()])}
            assert all(abs(len(r.text.encode()) - want[r.doc_id]) <= 6 for r in docs.collect())
    last = {(r.doc_id, r.piece, r.ids_crc32) for r in docs.collect()}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()} == last


def test_awkward_tables(spark, sf):
    for make in (awkward, empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[:2] == ["doc_id", "piece"]


def test_language_stage_without_labels_and_with_clashing_names(spark, sf):
    rows = [(i, text, None, "s", 1, "x", 0.5, 7) for i, text in enumerate(["some words", "...", None, "", "Wörter"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, bucket int")
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4]
    labelled = docs.withColumn("lang", langid.F.lit("en"))
    assert {r.score for r in corpus_pipeline.language_id(spark, labelled, sf).collect()} <= {0.5}
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf)
    assert docs.count() == 4  # of the two wordless texts one stays


def test_very_long_text(spark, sf):
    """A text of a megabyte, twice, beside short ones."""
    long = " ".join(f"w{i * i % 99991}" for i in range(150_000))
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, "a short text of several words in it", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name == "simhash_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == [1, 3]
    assert {r.doc_id for r in docs.collect()} == {1, 3}


def test_clean_documents_stay(spark):
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(150)), "en", f"h{i % 3}", 1) for i in range(40)]
    docs = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in linededup.drop_boilerplate(docs).collect()} == {r[1] for r in clean}
    assert {r.text for r in suffix.cut_text(docs).collect()} == {r[1] for r in clean}
