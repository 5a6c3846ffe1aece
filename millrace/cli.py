"""Command line: ``python -m millrace.cli COMMAND --root DIR``; each stage reads what the one before it wrote."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import contenders, dataset, farm, gate, ledger, metrics, report, taskpool, windowing
from millrace.sources.records import Config, iter_tasks, write_manifest


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("taskpool", "farm", "verify", "compile", "ledger", "eval", "report", "info"))
    p.add_argument("--root", default=".")
    p.add_argument("--config")
    p.add_argument("--source", default="url", choices=tuple(contenders.TASK_SOURCES))
    p.add_argument("--input", default="")
    p.add_argument("--teacher", default="auto")
    p.add_argument("--split", default="all")
    p.add_argument("--limit", type=int)
    p.add_argument("--seeds", default="0")
    p.add_argument("--seed", type=int, default=0, help="of the teacher's draws")
    p.add_argument("--shard", type=int, default=0, help="which of the farms this is; each writes its own folder")
    p.add_argument("--shards", type=int, default=1)
    p.add_argument("--strategies", help="windowing strategies to compile, by comma")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs one command and returns what it prints."""
    a = _arguments(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    config = Config.load(a.config) if a.config else Config(root=a.root)
    at = lambda name: f"{a.root}/{name}"
    tasks = lambda: iter_tasks(spark.read.parquet(at("tasks")), a.split)
    if a.command == "taskpool":
        write_manifest(contenders.TASK_SOURCES[a.source](spark, config, a.input), at("tasks"))
        out = report.table(taskpool.manifest_summary(tasks()))
    elif a.command == "farm":
        chosen = tasks().orderBy("task_id").limit(a.limit) if a.limit else tasks()
        chosen = farm.of_shard(chosen, a.shard, a.shards)
        kinds = [r[0] for r in chosen.select("kind").distinct().collect()]
        name = a.teacher if a.teacher != "auto" else "url_repair" if kinds == ["url"] else "heuristic"
        made, caps = contenders.teacher(name)(chosen, config.samples_per_task, seed=a.seed), config.caps
        farm.capped(made, contenders.TURN_TOKENS[name], caps.max_steps, caps.max_requests, caps.max_tokens).write.mode("overwrite").parquet(f"{at('runs')}/shard={a.shard}")
        runs = spark.read.parquet(at("runs")).drop("shard")
        rows = runs.select(F.lit(0.0).alias("ts"), "run_id", "task_id", "teacher", "model", F.lit(1).alias("attempt"), F.col("tokens.prompt").alias("prompt_tokens"), F.col("tokens.completion").alias("completion_tokens"), "cost_usd", F.col("wall_s").alias("latency_s"), F.lit(None).cast("string").alias("error"))
        ledger.record(rows).write.mode("overwrite").parquet(at("ledger"))
        out = report.table(farm.exit_counts(runs))
    elif a.command == "verify":
        gate.verify(spark.read.parquet(at("runs")).drop("shard"), spark.read.parquet(at("tasks"))).write.mode("overwrite").parquet(at("verdicts"))
        out = report.table(gate.histogram(spark.read.parquet(at("verdicts"))).orderBy("pos").drop("pos"))
    elif a.command == "compile":
        w = config.window
        options = {"windowed": {"keep_last": w.keep_last, "head": w.head}, "naive_truncated": {"keep_chars": w.keep_chars}}
        chosen = tuple(a.strategies.split(",")) if a.strategies else tuple(windowing.STRATEGIES)
        dataset.write(dataset.build(spark.read.parquet(at("verdicts")), spark.read.parquet(at("runs")).drop("shard"), spark.read.parquet(at("tasks")), chosen, **options), at("dataset"))
        out = report.table(dataset.stats(spark.read.parquet(at("dataset"))))
    elif a.command == "ledger":
        book = spark.read.schema(schemas.LEDGER).parquet(at("ledger"))
        out = report.table(ledger.summary(book)) + "\n" + report.table(ledger.efficiency(book, spark.read.parquet(at("verdicts"))))
    elif a.command == "eval":
        runner = contenders.teacher(a.teacher, "heuristic")
        rows = contenders.evaluate(tasks(), "heuristic" if a.teacher == "auto" else a.teacher, runner, tuple(map(int, a.seeds.split(","))))
        rows.write.mode("overwrite").parquet(at("results"))
        out = report.table(metrics.summarize(spark.read.parquet(at("results"))))
    elif a.command == "report":
        results = spark.read.parquet(at("results"))
        out = "\n".join(report.table(x) for x in (metrics.frontier(metrics.summarize(results)), metrics.by_variant(results), metrics.rejections(results)))
    else:
        out = repr(config)
    print(out)
    return out


if __name__ == "__main__":
    main()
