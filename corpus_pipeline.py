"""A corpus pipeline from raw documents to packed sequences: STAGES in turn, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import language_id, packing, quality_classifier, simhash
from millrace.llm._spark import BATCH_ROWS, discard, held_out, shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language; learns from lang of the documents not held out.

    Null, empty and letterless texts go. Rows with a null lang or text are not learned from but judged like all others;
    if no row has a lang, all rows stay. Repeated rows are judged alike; long texts are read whole; shares that tie go
    to the first language by name. All columns are returned as they are; an empty table gives an empty one.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return language_id.keep_identified(docs, language_id.train(docs, ~held_out(4)))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below its threshold; learns from labels not held out.

    Null and empty texts are scored as texts without words. Of labels of one doc_id that differ the lower counts, null
    labels and those of absent documents do not; without labels of both kinds all rows stay. A score that ties with the
    threshold stays. Repeated rows are judged alike, long texts read whole, columns returned as they are; an empty table
    gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, labels, ~held_out(4)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id.

    All null, empty and wordless texts are one group. Rows without a doc_id all stay. Rows that share a doc_id are told
    apart by their texts, and rows that are the same in all columns are one. Long texts are read whole, columns
    returned as they are; an empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens: the rows of ``packing.pack``.

    A null text is empty and has its end id alone; repeated rows and equal or null doc_ids are documents of their own;
    only texts of more tokens are cut; pieces of one length are placed in the order in which they lie. Columns other
    than doc_id and text are not read; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one keeps is written as Parquet in the shared folder and read by the next.

    When a stage's output is written, that of the stage before it is removed; the last one's input stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                discard(before)
            before = path
    return docs
