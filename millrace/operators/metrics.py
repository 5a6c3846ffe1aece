"""Numbers of each contender from its evaluated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENDERS = ("teacher", "student", "student_no_curriculum", "heuristic")


def summarize(results: DataFrame, by: str = "contender") -> DataFrame:
    """Rates, means, exact percentiles and costs by contender."""
    share = lambda c, name: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 4).alias(name)
    cost = F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0)).cast("decimal(28,8)")).cast("double")
    passed = F.count_if("passed")
    totals = results.groupBy(by).agg(
        F.count("*").alias("n"),
        share("passed", "pass_at_1"),
        share("label_correct", "label_accuracy"),
        share("valid_tool_call", "valid_tool_call_rate"),
        share("retrieved", "retrieval_success_rate"),
        F.round(F.avg("steps"), 2).alias("mean_steps"),
        F.round(F.avg("tokens"), 1).alias("mean_tokens"),
        F.round(cost, 4).alias("api_cost_usd"),
        F.round(F.coalesce(F.sum(F.when(F.col("kind") == "local", F.col("latency_s").cast("decimal(28,8)"))).cast("double"), F.lit(0.0)), 2).alias("compute_seconds"),
        F.round(F.try_divide(cost, passed), 6).alias("cost_per_resolved_task_usd"),
    )
    return totals.join(percentiles(results, by, "latency_s", {"latency_p50_s": 0.5, "latency_p95_s": 0.95}, 3), by, "left")


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], digits: int) -> DataFrame:
    """Exact percentiles with interpolation, from counts of equal values: of a large group no task sees all rows.

    Counts are made before the shuffle; values lie in ranges (a thousandth of a power of two), whose counts are added up.
    """
    part = F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * 1024)
    known = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k")).withColumn("part", part)
    inner = Window.partitionBy(by, "part").orderBy(value)
    ranked = known.withColumn("upto", F.sum("k").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    sums = known.groupBy(by, "part").agg(F.sum("k").alias("k"))
    order = Window.partitionBy(by).orderBy("part")  # a row for each range of a group
    bases = sums.select(F.col(by), "part", F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy(by)).alias("n"))
    placed = ranked.join(bases, [by, "part"]).withColumn("upto", F.col("upto") + F.col("base"))

    def at(share: float, above: bool) -> Column:
        place = F.lit(share) * (F.col("n") - 1)
        place = F.ceil(place) if above else F.floor(place)
        return F.min(F.when(F.col("upto") > place, F.col(value)))

    def made(share: float) -> Column:
        exact = F.lit(share) * (F.max("n") - 1)
        part = exact - F.floor(exact)
        return F.round(at(share, False) + part * (at(share, True) - at(share, False)), digits)

    return placed.groupBy(by).agg(*[made(share).alias(name) for name, share in shares.items()])


def by_variant(results: DataFrame) -> DataFrame:
    return results.groupBy("contender", F.coalesce("variant", F.lit("?")).alias("variant")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_at_1"))


def rejections(results: DataFrame) -> DataFrame:
    return results.groupBy("contender", "reason_code").agg(F.count("*").alias("n")).orderBy("contender", F.desc("n"), "reason_code")


def variant_block(results: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """pass@1 by contender, a column for every variant in the order given; null where there is none."""
    rate = F.round(F.avg(F.col("passed").cast("int")), 3)
    return results.groupBy("contender").pivot("variant", list(variants)).agg(rate)


def top_damages(tasks: DataFrame, n: int = 12) -> DataFrame:
    """The most frequent damages of URL tasks; of equally frequent ones those that are seen first by task."""
    each = tasks.select("task_id", F.posexplode("corruptions").alias("place", "corruption"))
    counts = each.groupBy("corruption").agg(F.count("*").alias("n"), F.min(F.struct("task_id", "place")).alias("seen"))
    return counts.orderBy(F.desc("n"), "seen").limit(n).select("corruption", "n")


def frontier(summaries: DataFrame) -> DataFrame:
    """Known contenders in their fixed order."""
    order = summaries.sparkSession.createDataFrame(list(enumerate(CONTENDERS)), "pos int, contender string")
    return summaries.join(F.broadcast(order), "contender").select("pos", "contender", "n", "pass_at_1", "valid_tool_call_rate", "cost_per_resolved_task_usd", "latency_p50_s", "latency_p95_s", "mean_steps").orderBy("pos")


def params_label(kind, params):
    """How a contender's size is shown, of its kind and non-embedding parameters."""
    return F.when(kind == "local", F.concat(F.format_number(params / 1e6, 2), F.lit("M non-emb"))).when(kind == "api", "API").otherwise("—")


def ablation(summaries: DataFrame, a: str = "student", b: str = "student_no_curriculum") -> DataFrame:
    """How two contenders differ."""
    pick = lambda name, tag: summaries.where(F.col("contender") == name).select(*[F.col(c).alias(f"{c}_{tag}") for c in ("pass_at_1", "valid_tool_call_rate")])
    return pick(a, "a").join(F.broadcast(pick(b, "b"))).withColumn("pass_gain", F.round(F.col("pass_at_1_a") - F.col("pass_at_1_b"), 4))


def results(verdicts: DataFrame, runs: DataFrame, contender: str, seed: int = 0, kind: str = "api") -> DataFrame:
    """Evaluation rows of a contender's runs."""
    turns = F.filter("messages", lambda m: m["role"] == "assistant")
    called = F.coalesce(F.exists(turns, lambda m: m["content"].rlike(r"\blookup\s*\(\s*-?\d+\s*\)")), F.lit(False))
    facts = runs.select("run_id", called.alias("valid_tool_call"), F.coalesce(F.exists("messages", lambda m: (m["role"] == "tool") & F.coalesce(m["tool_ok"], F.lit(False))), F.lit(False)).alias("retrieved"), F.col("wall_s").alias("latency_s"), "cost_usd")
    return verdicts.join(facts, "run_id").select(
        F.concat_ws(":", F.lit(contender), F.lit(str(seed)), "run_id").alias("result_id"),
        F.lit(contender).alias("contender"),
        F.lit(seed).alias("seed"),
        "task_id",
        "run_id",
        "variant",
        F.lit(kind).alias("kind"),
        (F.col("reason_code") == "VERIFIED_OK").alias("passed"),
        F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False)).alias("label_correct"),
        "reason_code",
        "valid_tool_call",
        "retrieved",
        "steps",
        "latency_s",
        "cost_usd",
        "tokens",
    )
