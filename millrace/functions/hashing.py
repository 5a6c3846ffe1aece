"""Content identity, split assignment and seeds, all from SHA-256 of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """``sha256:`` and the hex digest of text."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys and no spaces; null fields are left out.

    Use strings, integers and structs whose fields are in alphabetical order; floats and control characters are written
    differently by other JSON writers.
    """
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def json_string(text: Column) -> Column:
    """Text as a JSON string."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def task_identity(hypothesis: Column, evidence: Column, prompt_variant: Column) -> Column:
    """The id of a task: of what the agent is asked, not of how the task is kept."""
    return content_id(canonical_json(hypothesis=hypothesis, evidence=evidence, prompt_variant=prompt_variant))


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10)


def split_of(task_id: Column, salt: str, eval_pct: int = 20) -> Column:
    """eval for about eval_pct of a hundred ids, else train; another salt deals anew."""
    bucket = _number(F.substring(F.sha2(F.concat(task_id, F.lit(f"|{salt}")), 256), 1, 8)).cast("long") % 100
    return F.when(bucket < eval_pct, "eval").otherwise("train")


def stable_seed(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**63 - 1 of the JSON list of parts (strings or integers; columns of strings or longs)."""
    listed = []
    for p in parts:
        if isinstance(p, int):
            listed.append(F.lit(str(p)))
        elif isinstance(p, str):
            listed.append(json_string(F.lit(p)))
        else:
            listed.append(p)
    digest = F.sha2(F.concat(F.lit("["), F.concat_ws(",", *listed), F.lit("]")), 256)
    return F.shiftrightunsigned(F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"), 1)  # half of an unsigned number


def draw(seed: Column, *salt: str | int) -> Column:
    """A number from 0 to 2**63 - 1 that depends on a seed and a salt: the n-th random draw of a record."""
    return stable_seed(seed.cast("string"), *salt)
