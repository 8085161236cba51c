"""Registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, htmltext, imatch, importance, langid, linededup, packing, quality, repair, setsketch, simhash, suffix, tokencount
from tidemark.llm.common import saved, table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = linededup.drop_boilerplate(docs)
    return cut.select("doc_id", "source", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS ls, text FROM documents
), per_host AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), marks AS (
  SELECT DISTINCT r, source, trim(l) AS l FROM (SELECT r, source, unnest(ls) AS l FROM lines) WHERE trim(l) <> ''
), bad AS (
  SELECT m.source, m.l FROM (SELECT source, l, count(*) AS n FROM marks GROUP BY source, l) m
  JOIN per_host p ON m.source IS NOT DISTINCT FROM p.source WHERE n >= {linededup.MIN_PAGES} AND n > {linededup.RATIO} * pages
), numbered AS (
  SELECT r, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM lines
), judged AS (
  SELECT n.r, n.i, n.l, b.l IS NOT NULL AS dropped FROM numbered n LEFT JOIN bad b ON n.source IS NOT DISTINCT FROM b.source AND trim(n.l) = b.l
), kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS kept FROM judged GROUP BY r
)
SELECT d.doc_id, d.source, k.n_lines, k.n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(k.kept) END AS kept_sha256
FROM lines d JOIN kept k ON d.r = k.r
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = saved(quality.measured(table(spark, sf_dir, "documents")))
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability"]
    return quality.judged(measures).select(*wanted)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return repair.digest(repair.damaged(talk), talk)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    names = [op1_language_id, op2_fingerprints, op3_html_text, op4_line_dedup, op5_packing, op6_suffix_dedup, op7_byte_bpe, op8_token_counts, op9_simhash, op10_quality_rules, op11_conversation_repair, op12_importance_resampling, op13_setsketch]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL}
