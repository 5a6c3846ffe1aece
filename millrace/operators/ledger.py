"""Accounts of requests: totals, and what a verified run costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _failed() -> Column:
    return F.coalesce(F.col("error") != "", F.lit(False))


def record(requests: DataFrame) -> DataFrame:
    """Rows of the ledger: tokens added up, cost and latency rounded."""
    return requests.withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("latency_s", F.round("latency_s", 3))


def summary(ledger: DataFrame) -> DataFrame:
    """One row of totals; an empty ledger gives zeros and no mean latency."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    money = lambda c, d: F.coalesce(F.round(F.sum(F.col(c).cast("decimal(28,8)")), d).cast("double"), F.lit(0.0)).alias(c)
    errors = F.count_if(_failed())
    return ledger.agg(
        F.count("*").alias("requests"),
        total("prompt_tokens"),
        total("completion_tokens"),
        total("tokens"),
        money("cost_usd", 4),
        money("latency_s", 1),
        errors.alias("errors"),
        F.coalesce(F.round(F.try_divide(errors, F.count("*")), 4), F.lit(0.0)).alias("error_rate"),
        F.round(F.try_divide(F.sum(F.when(~_failed(), F.col("latency_s").cast("decimal(28,8)"))).cast("double"), F.count_if(~_failed())), 2).alias("mean_latency_s"),
    )


def efficiency(ledger: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tokens and requests for each verified run, and tokens spent on rejected ones; null where there is no divisor."""
    ok = F.col("reason_code") == "VERIFIED_OK"
    runs = verdicts.groupBy("run_id").agg(F.max(ok.cast("int")).alias("good"))
    verified = verdicts.agg(F.count_if(ok).alias("verified_trajectories"))
    spent = ledger.join(runs.where("good = 0"), "run_id", "left_semi").agg(F.coalesce(F.sum(F.when(~_failed(), F.col("tokens"))), F.lit(0)).alias("tokens_wasted_on_rejected"))
    totals = ledger.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.count_if(~_failed()).alias("ok_requests"))
    n = F.col("verified_trajectories")
    return (
        totals.join(F.broadcast(verified))
        .join(F.broadcast(spent))
        .select(
            "verified_trajectories",
            F.round(F.try_divide(F.col("total"), n), 1).alias("tokens_per_verified"),
            F.round(F.try_divide(F.col("ok_requests"), n), 2).alias("requests_per_verified"),
            "tokens_wasted_on_rejected",
            F.round(F.try_divide(F.col("tokens_wasted_on_rejected"), F.col("total")), 4).alias("waste_share"),
        )
    )


#: Attempts of a run in one row of by_run.
PAGE = 1000


def by_run(ledger: DataFrame, page: int = PAGE) -> DataFrame:
    """Requests of each run in order of attempt, in pages: the attempts from ``page`` times ``page_no`` on. A run of any
    length thus never meets in one task."""
    row = F.struct("attempt", "ts", "tokens", "cost_usd", "latency_s", "error")
    return ledger.groupBy("run_id", F.floor(F.col("attempt") / page).alias("page_no")).agg(F.array_sort(F.collect_list(row)).alias("requests"))


def over_cap(requests: Column, tokens: Column, usd: Column, max_requests: int, max_tokens: int, max_usd: float = 0) -> Column:
    """Which cap is reached; the cap on money holds only above 0."""
    out = F.when(requests >= max_requests, "REQUEST_CAP").when(tokens >= max_tokens, "STEP_CAP")
    return out.when(usd >= max_usd, "STEP_CAP") if max_usd > 0 else out


def request_cost(prompt: Column, completion: Column, per_1k_prompt: float, per_1k_completion: float) -> Column:
    return prompt * per_1k_prompt / 1000 + completion * per_1k_completion / 1000
