"""The pipeline's stages, and that the queries run over whole tables."""

import os

import pytest

import corpus_pipeline
from millrace.llm import queries
from tests.llm.test_operators import AWKWARD, corpus

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_queries_cover_their_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, query in queries.queries().items():
        rows = query(spark, DATA)
        ids = rows.select(rows.columns[0]).distinct().count()
        assert ids == (spark.read.parquet(f"{DATA}/pages.parquet").count() if name.startswith("op5_") else docs), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        before = after
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert before.join(labels.where("quality = 0"), "doc_id").count() <= 0.3 * docs.join(labels.where("quality = 0"), "doc_id").count()
    assert good.join(before, "doc_id", "left_semi").count() >= 0.8 * good.count()
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, component string"
    clean = [(100 + i, t, lang, "s", len(t), 1, 0.5, "c") for i, t, lang, _ in corpus(60, 3)]
    rows = [*clean, *((i, t, None, None, None, None, None, None) for i, t in AWKWARD), (900, "long words " * 90_000, "aa", "s", 0, 2, 0.1, "k")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(100 + i, good, 0) for i, _, _, good in corpus(60, 3)] + [(None, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name == "best_fit_packing":
            assert out.select("doc_id", "piece").count() >= len(rows)
            continue
        assert out.columns == docs.columns
        kept = [tuple(r) for r in out.collect()]
        assert set(map(str, kept)) <= set(map(str, map(tuple, docs.collect())))
        if name == "language_id":
            assert not {3, 5, 9} & {r[0] for r in kept} and sum(r[0] is not None and 100 <= r[0] < 160 for r in kept) == 60
        if name == "simhash_near_dedup":
            assert sum(r[0] == 12 for r in kept) == 0 and sum(r[0] == 11 for r in kept) == 1 and sum(r[0] is None for r in kept) == 1
            assert sum(r[0] in (3, 5, 9) for r in kept) == 1
