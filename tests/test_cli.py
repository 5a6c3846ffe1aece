import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.operators import contenders, gate, metrics, taskpool
from millrace.sources.paged import paged_source


def test_stages_follow_each_other(spark, tmp_path):
    said = {c: cli.main([c, "--root", str(tmp_path)], spark) for c in ("taskpool", "farm", "verify", "compile", "ledger", "info")}
    assert "| train |" in said["taskpool"] and "answered" in said["farm"] and "VERIFIED_OK" in said["verify"]
    assert "windowed" in said["compile"] and "verified_trajectories" in said["ledger"] and "Config" in said["info"]
    verdicts = spark.read.parquet(f"{tmp_path}/verdicts")
    assert verdicts.where("reason_code = 'VERIFIED_OK'").count() > 0.3 * verdicts.count()


def test_url_teacher_faults_are_caught(spark):
    tasks = taskpool.url_tasks(spark, 25, "t")

    def share(*codes, **k):
        found = gate.verify(contenders.url_repair_runs(tasks, base_temperature=1.0, **k), tasks).select("reason_code").collect()
        return sum(r.reason_code in codes for r in found) / len(found)

    assert share("VERIFIED_OK") > 0.3
    assert share("UNSUPPORTED_ANSWER", ungrounded_pct=100) > 0.8  # at most 95 of a hundred runs are faulty
    assert share("UNSUPPORTED_ANSWER", "TRIVIAL_OUTPUT", echo_pct=100) > 0.8


def test_url_teacher_splices_a_query(spark):
    texts = ["https://docs.atlas.com/guide?id=2", "https://x.org/other?lang=en&page=7", "https://docs.atlas.com/blog"]
    answer = lambda broken, n: spark.range(1).select(contenders.repaired(F.lit(broken), F.array(*map(F.lit, texts[:n])) if n else F.array().cast("array<string>"))).first()[0]
    assert answer("docs.atlas.com/guide?id=2", 3) == texts[0]
    assert answer("htps://docs.atlas.com/guide?lang=en&page=7", 3) == "https://docs.atlas.com/guide?lang=en&page=7"
    assert answer("htps://docs.atlas.com/guide", 3) == texts[0] and answer("htps://docs.atlas.com/guide", 0) == "htps://docs.atlas.com/guide"
    tasks = taskpool.url_tasks(spark, 30, "t", "compose")
    runs = contenders.url_repair_runs(tasks, ungrounded_pct=100).collect()
    assert {r.n_lookups for r in runs} == {1, 2, 3} and all(set(r.cite) - set(range(r.n_lookups)) for r in runs if r.temperature >= 0.8)
    again = contenders.url_repair_runs(tasks, seed=5).collect()
    assert [r.n_lookups for r in again] != [r.n_lookups for r in runs]


def test_shards_and_contenders(spark, tmp_path):
    cli.main(["taskpool", "--root", str(tmp_path)], spark)
    for k in (0, 1):
        said = cli.main(["farm", "--root", str(tmp_path), "--shard", str(k), "--shards", "2"], spark)
    assert spark.read.parquet(f"{tmp_path}/runs").select("task_id").distinct().count() == spark.read.parquet(f"{tmp_path}/tasks").count()
    assert "answered" in said and "VERIFIED_OK" in cli.main(["verify", "--root", str(tmp_path)], spark)
    contenders.register("own", contenders.url_repair_runs)
    assert contenders.contender("own") == (contenders.url_repair_runs, "local")
    for name in ("own", "nobody"):
        with pytest.raises(ValueError):
            contenders.register(name, None) if name == "own" else contenders.contender(name)


def test_evaluation(spark):
    tasks = taskpool.url_tasks(spark, 20, "t")
    rows = contenders.evaluate(tasks, "teacher", contenders.url_repair_runs, (3, 4))
    assert rows.count() == 2 * tasks.count() and {r.seed for r in rows.select("seed").distinct().collect()} == {3, 4}
    assert metrics.summarize(rows).first().valid_tool_call_rate == 1.0


def test_paged_source(spark):
    def fetch(offset, length):
        if offset >= 40:
            raise OSError("down")
        return [(i,) for i in range(offset, offset + length)]

    spark.dataSource.register(paged_source("numbers", "n long", fetch, 55, page=10, pages_per_task=2))
    assert spark.read.format("numbers").load().agg(F.count("*"), F.max("n")).first() == (40, 39)
