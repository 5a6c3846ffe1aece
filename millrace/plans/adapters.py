"""The records of the engine, derived from the driver's tables by fixed rules; faults are injected by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import json_string, split_of, stable_seed, task_identity
from millrace.functions.text import negate, split_units
from millrace.operators import farm, taskpool

SALT = "split"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their units. explode of a list of one: the optimizer would cut a text again for every use of them."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.explode(F.array(split_units(F.col("text")))).alias("units"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents assert their first unit, odd ones deny their last. Every 29th shows its label, every 31st is in both splits."""
    rows = document_units(spark, sf_dir).where(F.size("units") >= 2)
    even = F.col("doc_id") % 2 == 0
    label = F.when(even, "entailed").otherwise("not_entailed")
    said = F.when(even, F.get("units", 0)).otherwise(negate(F.element_at("units", -1)))
    shown = F.when(F.col("doc_id") % 29 == 0, F.concat(said, F.lit(" "), F.replace(label, F.lit("_"), F.lit(" ")))).otherwise(said)
    made = rows.select("doc_id", label.alias("label"), shown.alias("hypothesis"), F.when(even, "base").otherwise("premise_negation").alias("prompt_variant"), taskpool.evidence(F.col("units")).alias("evidence"))
    named = made.withColumn("task_id", task_identity(F.col("hypothesis"), F.col("evidence"), F.col("prompt_variant")))
    first = named.groupBy("task_id").agg(F.min_by(F.struct("doc_id", "label", "hypothesis", "prompt_variant", "evidence"), "doc_id").alias("t")).select("task_id", "t.*")
    split = split_of(F.col("task_id"), SALT)
    splits = F.when(F.col("doc_id") % 31 == 0, F.array(F.lit("train"), F.lit("eval"))).otherwise(F.array(split))
    null = F.lit(None).cast("string")
    return first.select("task_id", "doc_id", F.lit("entailment").alias("kind"), F.lit("base").alias("origin"), F.explode(splits).alias("split"), "prompt_variant", "hypothesis", "label", null.alias("broken"), null.alias("gold_url"), F.size("evidence").alias("n_units"), "evidence")


def runs(task_rows: DataFrame) -> DataFrame:
    """The closed-form teacher's runs; a hundredth of the run's hash picks a fault."""
    whole = farm.heuristic_runs(task_rows.dropDuplicates(["task_id"]))
    whole = whole.withColumn("b", stable_seed("fault", json_string(F.col("run_id"))) % 100)
    b = F.col("b")
    between = lambda lo, hi: b.between(lo, hi)
    flipped = F.when(F.col("answer") == "entailed", "not_entailed").otherwise("entailed")
    answer = F.when(between(33, 40), flipped).otherwise(F.col("answer"))
    cite = F.when(between(23, 27), F.lit("9")).otherwise(F.array_join(F.col("cite").cast("array<string>"), ", "))
    closing = F.concat(F.lit("PLAN: the segments are compared with the hypothesis.\nCITE: "), cite, F.when(between(13, 17), "").otherwise(F.concat(F.lit("\nANSWER: "), answer)))
    last = F.size("messages") - 1

    def faulty(m: Column, i: Column) -> Column:
        content = F.when(i == last, closing).when(between(28, 32) & (i == 2), "lookup(0)").otherwise(m["content"])
        ok = F.when(between(18, 22), F.when(m["tool_ok"].isNotNull(), F.lit(False))).otherwise(m["tool_ok"])
        return m.withField("content", content).withField("tool_ok", ok)

    ended = F.when(between(0, 4), "teacher_error").when(between(5, 8), "step_cap").when(between(9, 12), "request_cap").otherwise("answered")
    return whole.withColumn("messages", F.transform("messages", faulty)).withColumn("exit", ended).drop("b")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in order of turn. A conversation is one record here, as a run is."""
    rows = table(spark, sf_dir, "conversations")
    m = farm.message(F.when(F.col("role") == "user", "tool").otherwise(F.col("role")), F.coalesce("text", F.lit("")), F.when(F.col("role") == "user", F.col("turn").cast("int")))
    gathered = rows.select("conv_id", "turn", m.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda x: x["m"]).alias("messages"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.unix_timestamp("ts").cast("double").alias("ts"),
        F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run_id"),
        F.col("event_id").alias("attempt"),
        F.floor(F.abs("value") * 10).cast("long").alias("prompt_tokens"),
        (F.col("event_id") % 100).alias("completion_tokens"),
        (F.floor(F.abs("value") * 10).cast("long") + F.col("event_id") % 100).alias("tokens"),
        (F.floor(F.abs("value") * 1000) / 1000000).alias("cost_usd"),
        (F.floor(F.abs("value") * 100) / 1000).alias("latency_s"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )


def ledger_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("u")).distinct()
    return users.select(F.concat(F.lit("run"), F.col("u").cast("string")).alias("run_id"), F.when(F.col("u") % 3 == 0, "VERIFIED_OK").otherwise("TEST_FAIL").alias("reason_code"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.array(F.lit("teacher"), F.lit("student"), F.lit("student_no_curriculum"), F.lit("heuristic"))
    k = F.col("event_id")
    return e.select(
        F.get(names, (k % 4).cast("int")).alias("contender"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("variant"),
        F.when(k % 4 == 0, "api").otherwise("local").alias("kind"),
        (k % 7 < 3).alias("passed"),
        (k % 7 < 4).alias("label_correct"),
        (k % 5 < 4).alias("valid_tool_call"),
        (k % 5 < 3).alias("retrieved"),
        F.when(k % 7 < 3, "VERIFIED_OK").when(k % 2 == 0, "TEST_FAIL").otherwise("FORMAT_INVALID").alias("reason_code"),
        (k % 6 + 1).alias("steps"),
        (k % 1000).alias("tokens"),
        (F.floor(F.abs("value") * 100) / 1000).alias("latency_s"),
        (F.floor(F.abs("value") * 1000) / 1000000).alias("cost_usd"),
    )
