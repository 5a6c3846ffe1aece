"""Every query with SQL, against DuckDB on the driver's smallest tables."""

import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


def plain(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda v: "~" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.execute(f"create view {name[:-8]} as select * from read_parquet('{DATA}/{name}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = __spark_entry__.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert plain(ours) == plain(theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["url_tasks", "corruption_top"])
def test_other_queries_have_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0


def test_articles_of_empty_texts_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "en", "one, two and three"), (2, "en", ""), (3, "de", " \n "), (4, "de", None), (1000, "en", "¡a! \U0001f600; b")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ours = [tuple(r) for r in __spark_entry__.queries()["articles"](spark, str(tmp_path)).collect()]
    assert len(ours) == 5 and sorted(ours, key=repr) == sorted(c.execute(SQL["articles"]).fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["training_samples", "samples_written"])
def test_gate_queries_cut_texts_once(spark, name, monkeypatch):
    """What they write first, the tasks, comes from a plan that cuts a text into units in one place."""
    from millrace.plans import queries as plans

    plan, keep = [], plans.stored
    monkeypatch.setattr(plans, "stored", lambda df, label: (plan.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df, label))[1])
    __spark_entry__.queries()[name](spark, DATA).collect()
    assert len(plan) == 2 and plan[0].count("although") == 1
