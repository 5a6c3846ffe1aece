"""Figures of training that need no model: sizes, steps, learning rate and losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_embedding_params(layers: int, width: int, inner: int) -> int:
    return layers * (4 * width * width + 2 * width * inner)


def steps(stages: DataFrame, batch: int) -> DataFrame:
    """All steps over stages (n, epochs), at least one."""
    per = F.greatest(F.lit(1), F.ceil(F.col("n") / batch)) * F.col("epochs")
    return stages.agg(F.greatest(F.lit(1), F.coalesce(F.sum(per), F.lit(0))).cast("long").alias("steps"))


def learning_rate(step: Column, total: int, warmup: int, peak: float) -> Column:
    """Linear warm-up, then a cosine down to a tenth of the peak."""
    done = F.least(F.greatest((step - warmup) / max(total - warmup, 1), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, peak * (step + 1) / max(warmup, 1)).otherwise(peak * (0.1 + 0.9 * 0.5 * (1 + F.cos(done * math.pi))))


def epoch_losses(log: DataFrame) -> DataFrame:
    """Mean loss of each stage and epoch, weighted by supervised tokens."""
    weighted = F.sum(F.col("loss") * F.col("supervised_tokens"))
    return log.groupBy("stage", "epoch").agg(F.try_divide(weighted, F.sum("supervised_tokens")).alias("mean_loss"))


def last_losses(log: DataFrame, n: int = 50) -> DataFrame:
    """The mean of the last n losses."""
    return log.orderBy(F.desc("step")).limit(n).agg(F.avg("loss").alias("final_loss"))
