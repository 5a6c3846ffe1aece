"""The thin queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, ngram_lm, packing, quality_classifier, quality_rules, simhash, token_codec, token_file, url_filter, winnow
from millrace.llm._spark import held_out, shared_path, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, ~held_out(4))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= quality_classifier.KEEP_FROM).cast("int").alias("predicted"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_file.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_file.digests(spark, path)


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(table(spark, sf_dir, "documents"), ~held_out(7))
    return scored.withColumn("held_out", held_out(7)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), [public_tokenizers.path(v) for v in quality_rules.LANGUAGE_BANDS])


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = language_id.train(docs, ~held_out(4))
    return language_id.identify(docs, field).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.SQL}
