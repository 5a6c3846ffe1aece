"""Runs of the deterministic teacher in closed form, and the interface for teachers that are opaque functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import content_id, stable_seed, json_string
from millrace.functions.text import GUESS_STOP_WORDS, coverage, let, word_set
from millrace.operators.render import MAX_LOOKUPS
from millrace.schemas import MESSAGES


def guess(hypothesis: Column, seen: Column, seed: Column) -> Column:
    """entailed by word coverage: from 0.8 on, below 0.35 never, between by a draw that depends on the seed."""
    words = lambda t: F.array_except(word_set(t), F.array(*map(F.lit, GUESS_STOP_WORDS)))
    return let(coverage(words(hypothesis), words(seen)), lambda share: F.when(share >= 0.8, "entailed").when(share < 0.35, "not_entailed").when((seed % 1000) / 1000.0 < share - 0.35, "entailed").otherwise("not_entailed"))


def temperature(base: float, sample_idx: Column) -> Column:
    return F.round(F.least(F.greatest(F.lit(base) + (sample_idx % 5 - 2) * 0.05, F.lit(0.0)), F.lit(2.0)), 2)


def hidden_items(messages: Column) -> Column:
    """How many items the first user turn that says so hides (0 if none does)."""
    said = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.regexp_extract(F.coalesce(m["content"], F.lit("")), r"(?:DOCUMENT|PROPOSITIONS|CANDIDATES):\s*(\d+)", 1))
    return F.coalesce(F.get(F.filter(said, lambda x: x != ""), 0).cast("int"), F.lit(0))


def asked_about(messages: Column) -> Column:
    """What the last user turn that says so asks about: hypothesis, claim or damaged URL (empty if none does)."""
    said = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.trim(F.regexp_extract(F.coalesce(m["content"], F.lit("")), r"(?:HYPOTHESIS|CLAIM|DAMAGED URL):\s*(.+)", 1)))
    return F.coalesce(F.try_element_at(F.filter(said, lambda x: x != ""), F.lit(-1)), F.lit(""))


def requested(indices: Column, budget: Column) -> Column:
    """Indices asked for in a turn: the first of each, as many as the budget has."""
    return F.slice(F.array_distinct(indices), F.lit(1), F.greatest(budget, F.lit(0)))


def message(role: Column | str, content: Column, index: Column | None = None, ok: Column | None = None, error: Column | None = None) -> Column:
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        (F.lit(role) if isinstance(role, str) else role).alias("role"),
        content.alias("content"),
        (null("int") if index is None else index).alias("evidence_index"),
        (null("boolean") if ok is None else ok).alias("tool_ok"),
        F.when(F.lit(role == "tool") if isinstance(role, str) else role == "tool", "lookup").alias("tool_name"),
        (null("string") if error is None else error).alias("error"),
        null("boolean").alias("windowed"),
        null("string").alias("system_prompt_version"),
    )


def tool_result(evidence: Column, index: Column) -> Column:
    """The evidence text at an index, or an error for one out of range."""
    known = (index >= 0) & (index < F.size(evidence))
    return message("tool", F.when(known, F.get(evidence, index)["text"]).otherwise("error: index out of range"), index, known)


# Fixed values, in the order in which they are shown.
EXITS = ("answered", "step_cap", "request_cap", "teacher_error", "malformed")


def exit_counts(runs: DataFrame) -> DataFrame:
    """exit, n of the exits that there are, in their fixed order."""
    order = F.array_position(F.array(*map(F.lit, EXITS)), F.col("exit"))
    return runs.groupBy("exit").agg(F.count("*").alias("n")).withColumn("pos", order).orderBy("pos").drop("pos")


def of_shard(tasks: DataFrame, shard: int, shards: int) -> DataFrame:
    """The tasks that fall on one of several farms."""
    return tasks if shards <= 1 else tasks.where(F.pmod(F.xxhash64("task_id"), F.lit(shards)) == shard)


def heuristic_runs(tasks: DataFrame, samples: int = 1, seed: int = 0) -> DataFrame:
    """Runs (schema RUN) of the teacher that looks up to three items, one a turn, then guesses by word overlap. Another
    seed draws anew."""
    rows = tasks.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_idx"))
    target = F.least(F.size("evidence"), F.lit(MAX_LOOKUPS - 1))
    rows = rows.withColumn("run_id", F.concat_ws(":", "task_id", "sample_idx")).withColumn("target", target).withColumn("seed", stable_seed("guess", json_string(F.col("run_id")), *([seed] if seed else [])))
    asked = F.sequence(F.lit(0), F.col("target") - 1)
    seen = F.array_join(F.transform(F.slice("evidence", F.lit(1), F.col("target")), lambda e: e["text"]), " ")
    rows = rows.withColumn("answer", guess(F.col("hypothesis"), seen, F.col("seed"))).withColumn("cite", asked)
    turns = F.flatten(F.transform(asked, lambda i: F.array(message("assistant", F.concat(F.lit("PLAN: segment "), i.cast("string"), F.lit(" is not yet known.\nlookup("), i.cast("string"), F.lit(")"))), tool_result(F.col("evidence"), i))))
    final = message("assistant", F.concat(F.lit("PLAN: the segments are compared with the hypothesis.\nCITE: "), F.array_join(F.col("cite").cast("array<string>"), ", "), F.lit("\nANSWER: "), F.col("answer")))
    opening = F.array(message("system", F.lit("Look up, then answer.")), message("user", F.concat(F.lit("HYPOTHESIS: "), F.col("hypothesis"))))
    out = rows.withColumn("messages", F.concat(opening, turns, F.array(final)).cast(MESSAGES))
    steps = F.col("target") + 1
    spent = (12 * F.col("target") + 20).cast("long")
    return out.select(
        "run_id",
        "task_id",
        "sample_idx",
        F.lit("heuristic").alias("teacher"),
        F.lit("overlap").alias("model"),
        temperature(0.7, F.col("sample_idx")).alias("temperature"),
        F.lit(0.0).alias("started_at"),
        F.lit(0.0).alias("wall_s"),
        steps.alias("steps"),
        steps.alias("requests"),
        F.struct(F.lit(0).cast("long").alias("prompt"), spent.alias("completion"), spent.alias("total")).alias("tokens"),
        F.lit(0.0).alias("cost_usd"),
        F.lit("answered").alias("exit"),
        "answer",
        "cite",
        F.size(F.array_distinct("cite")).alias("n_lookups"),
        "messages",
        content_id(F.to_json("messages")).alias("trajectory_hash"),
    )


def capped(runs: DataFrame, turn_tokens: int, max_steps: int = 8, max_requests: int = 8, max_tokens: int = 20_000) -> DataFrame:
    """Runs as they end under caps, which are tried before each turn: steps, then requests, then tokens.

    A run that needs more turns than a cap leaves keeps the turns before it, has no answer and cites nothing.
    """
    left = {"step_cap": max_steps, "request_cap": max_requests, "token_cap": -(-max_tokens // max(turn_tokens, 1))}
    turns = max(0, min(left.values()))
    ended = "request_cap" if max_steps > turns and max_requests == turns else "step_cap"
    starts = F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    over = F.col("steps") > turns
    out = runs.withColumn("_over", over).withColumn("messages", F.when(over, F.slice("messages", F.lit(1), F.coalesce(F.get(starts, turns), F.size("messages")))).otherwise(F.col("messages")))
    asked = F.array_distinct(F.transform(F.filter("messages", lambda m: m["role"] == "tool"), lambda m: m["evidence_index"]))
    spent = F.lit(turns * turn_tokens).cast("long")
    changes = {
        "exit": F.lit(ended),
        "steps": F.lit(turns),
        "requests": F.lit(turns),
        "tokens": F.struct(F.lit(0).cast("long").alias("prompt"), spent.alias("completion"), spent.alias("total")),
        "answer": F.lit(None).cast("string"),
        "cite": F.array().cast("array<int>"),
        "n_lookups": F.size(asked),
        "trajectory_hash": content_id(F.to_json("messages")),
    }
    return out.withColumns({c: F.when(F.col("_over"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_over")


def opaque_runs(tasks: DataFrame, complete: Callable[[dict], dict], schema: str) -> DataFrame:
    """Rows that a Python teacher makes of each task, in Arrow batches: ``complete`` takes a task and returns a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([complete(row) for row in f.to_dict("records")])

    return tasks.mapInPandas(run, schema)
