"""One query for each operator, over whole tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, licenses, line_dedup, ngram_join, oracles, phrases, prefix_trie, quality, suffix_dedup, token_shards, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "licenses", "best", "saved", "n_differences", "differences")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("row.page_id", "judged.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    held_out = F.coalesce(toxicity.is_held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out")
    return found.select("row.doc_id", held_out, "score", model.toxic(F.col("score")).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", *[f"result.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_later_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", "text")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_shards.sequences(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(_table(spark, sf_dir, "conversations"))))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_url_filter, op3_toxicity, op4_decontamination, op5_quality_rules, op6_line_dedup, op7_token_shards, op8_ngram_jaccard, op9_html_text, op10_byte_bpe, op11_suffix_dedup, op12_prefix_trie, op13_phrases)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.ORACLE, **oracles.SQL}
