"""Three views of a conversation for a limited context; the conversation itself is never changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import MESSAGES

DIGEST_OVERHEAD = 80
MESSAGE_OVERHEAD = 24


def full_context(messages: Column) -> Column:
    return messages


def windowed(messages: Column, keep_last: int = 3, head: int = 80) -> Column:
    """Old tool results that are longer than their digest are replaced by it; the last messages stay whole.

    A digest is a JSON object of chars, digest, head and index, without spaces.
    """

    def one(m: Column, i: Column) -> Column:
        old = i < F.size(messages) - keep_last
        tool = (m["role"] == "tool") | m["evidence_index"].isNotNull()
        digest = F.to_json(F.struct(F.length(m["content"]).alias("chars"), F.lit("tool_result").alias("digest"), m["content"].substr(1, head).alias("head"), m["evidence_index"].alias("index")), {"ignoreNullFields": "false"})
        short = F.coalesce(old & tool & (F.length(m["content"]) > head + DIGEST_OVERHEAD), F.lit(False))
        return F.when(short, m.withField("content", digest).withField("windowed", F.lit(True))).otherwise(m)

    return F.transform(messages, one).cast(MESSAGES)


def naive_truncated(messages: Column, keep_chars: int = 1200) -> Column:
    """The first two messages and as many of the last as fit; the very last always stays."""
    rest = F.slice(messages, F.lit(3), F.greatest(F.size(messages), F.lit(1)))
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))

    def step(a: Column, m: Column) -> Column:
        used = a["used"] + F.length(F.coalesce(m["content"], F.lit(""))) + MESSAGE_OVERHEAD
        full = a["full"] | ((a["kept"] > 0) & (used > keep_chars))
        return F.struct((a["kept"] + F.when(full, 0).otherwise(1)).alias("kept"), used.alias("used"), full.alias("full"))

    kept = F.aggregate(F.reverse(rest), start, step)["kept"]
    return F.when(F.size(messages) <= 2, messages).otherwise(F.concat(F.slice(messages, 1, 2), F.slice(messages, F.size(messages) - kept + 1, kept)))


STRATEGIES = {"full_context": full_context, "windowed": windowed, "naive_truncated": naive_truncated}


def apply(messages: Column, strategy: str, **options: int) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown windowing strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](messages, **options)
