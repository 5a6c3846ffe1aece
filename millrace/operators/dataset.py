"""Training samples of verified runs, in each windowing strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import render, windowing


def _verified(verdicts: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    last = Window.partitionBy("run_id").orderBy(F.desc("sample_idx"))
    one_run = runs.withColumn("n", F.row_number().over(last)).where("n = 1").select("run_id", F.col("task_id").alias("run_task"), "messages", "steps", "n_lookups")
    one_task = tasks.groupBy("task_id").agg(F.min(F.struct("split", "kind", "prompt_variant", "label")).alias("task"))
    return verdicts.where("reason_code = 'VERIFIED_OK'").select("run_id", "task_id").join(one_run, "run_id", "left").join(one_task, "task_id", "left")


def build(verdicts: DataFrame, runs: DataFrame, tasks: DataFrame, strategies: tuple[str, ...] = tuple(windowing.STRATEGIES), **options: dict) -> DataFrame:
    """A sample for every verified run that still has its run and task, and every strategy; split is the task's."""
    found = _verified(verdicts, runs, tasks).where("run_task is not null and task is not null")
    views = F.array(*[F.struct(F.lit(x).alias("windowing"), windowing.apply(F.col("messages"), x, **options.get(x, {})).alias("m")) for x in strategies])
    cut = found.select("*", F.explode(views).alias("v")).withColumn("segments", render.segments(F.col("v.m")))
    segs = F.col("segments")
    return cut.select(
        F.concat_ws("|", "run_id", "v.windowing").alias("sample_id"),
        "task_id",
        "run_id",
        F.col("task.split").alias("split"),
        F.col("v.windowing").alias("windowing"),
        F.col("steps").alias("n_steps"),
        F.col("n_lookups").alias("n_tool_calls"),
        F.col("task.prompt_variant").alias("variant"),
        F.col("task.label").alias("label"),
        render.prompt_version(F.col("task.kind")).alias("system_prompt_version"),
        render.prompt_hash(F.col("v.m")).alias("prompt_hash"),
        segs.alias("segments"),
        render.chars(segs).alias("chars"),
        render.chars(segs, lambda s: s["trainable"]).alias("trainable_chars"),
        render.chars(segs, lambda s: s["kind"] == "tool_call").alias("tool_call_chars"),
    )


def skipped(verdicts: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """How many verified runs have lost their run or task."""
    return _verified(verdicts, runs, tasks).agg(F.count_if(F.col("run_task").isNull() | F.col("task").isNull()).alias("missing_run_or_task"))


def stats(samples: DataFrame) -> DataFrame:
    """Sizes of the samples by split and strategy, and how many there are of each variant (a map)."""
    mean = lambda c, digits=1: F.round(F.avg(c), digits).alias(f"avg_{c}")
    wide = samples.select("split", "windowing", "n_steps", "chars", "trainable_chars", "tool_call_chars", "prompt_hash", "variant")  # segments are not needed
    totals = wide.groupBy("split", "windowing").agg(F.count("*").alias("n"), mean("n_steps", 2), F.max("n_steps").alias("max_steps"), mean("chars"), mean("trainable_chars"), mean("tool_call_chars"), F.countDistinct("prompt_hash").alias("unique_prompts"))
    counted = wide.where("variant is not null").groupBy("split", "windowing", "variant").agg(F.count("*").alias("k"))
    variants = counted.groupBy("split", "windowing").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "k")))).alias("by_variant"))
    return totals.join(variants, ["split", "windowing"], "left")


def write(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("split", "windowing").parquet(path)


def stage_one(samples: DataFrame, fraction: float, max_steps: int | None = None) -> DataFrame:
    """The curriculum's first stage: the fraction of samples with the fewest steps, at least one; none for 0.

    A bound on steps holds unless no sample would be left. The rank is global, but only of (n_steps, sample_id): ids
    are counted by steps, and only the steps at the border are ranked.
    """
    if fraction <= 0:
        return samples.limit(0)
    if max_steps is not None:
        short = samples.where(F.col("n_steps") <= max_steps)
        samples = short if not short.isEmpty() else samples
    sizes = sorted((r[0], r[1]) for r in samples.groupBy("n_steps").count().collect())  # one row a number of steps
    total = sum(n for _, n in sizes)
    want, border, before = max(1, round(total * min(fraction, 1))), None, 0
    for steps, n in sizes:
        if before + n >= want:
            border = steps
            break
        before += n
    if border is None:
        return samples
    tied = samples.where(F.col("n_steps") == border).orderBy("sample_id").limit(want - before)
    return samples.where(F.col("n_steps") < border).unionByName(tied)
