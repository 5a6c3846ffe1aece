"""The one owner of the conversation format: prompts, segments and their rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.hashing import content_id, json_string
from millrace.schemas import SEGMENTS

MAX_LOOKUPS = 4
PROMPT_VERSIONS = {"entailment": "v3", "url": "v1", "legal": "v1"}
_RULES = f"Reveal hidden items with lookup(index), at most {MAX_LOOKUPS} in all. Finish with two lines, CITE: the indices used, and ANSWER: "
SYSTEM_PROMPTS = {
    "entailment": "Say whether a hypothesis must be true given a document that you can only see piece by piece. " + _RULES + "entailed or not_entailed.",
    "url": "Restore a damaged web address from a list of candidates that you can only see one by one. " + _RULES + "the address.",
    "legal": "Say whether the propositions of a judgment, hidden from you, establish a claim. Look some up before you answer. " + _RULES + "entailed or not_entailed.",
}
TOOL_SCHEMA = '{"description":"Reveal one numbered item.","name":"lookup","parameters":{"properties":{"index":{"minimum":0,"type":"integer"}},"required":["index"],"type":"object"}}'
#: Line breaks as Python's splitlines knows them.
LINE_END = r"(?<=[\n\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029])|(?<=\r)(?!\n)"


def _kind(kind: Column) -> Column:
    return F.when(kind.isin("url", "legal"), kind).otherwise("entailment")


def prompt_version(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PROMPT_VERSIONS.items() for x in kv])[_kind(kind)]


def system_prompt(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SYSTEM_PROMPTS.items() for x in kv])[_kind(kind)]


def task_prompt(kind: Column, subject: Column, n: Column) -> Column:
    """The user's turn: what is asked about (hypothesis, claim or damaged URL) and how many items are hidden."""
    valid = F.concat(F.lit("0-"), F.greatest(n - 1, F.lit(0)).cast("string"))
    shown = lambda head, items, ask: F.concat(F.lit(f"{head}: "), subject, F.lit(f"\n{items}: "), n.cast("string"), F.lit(" hidden, valid indices "), valid, F.lit(f".\n{ask}"))
    return F.when(kind == "legal", shown("CLAIM", "PROPOSITIONS", "Do they establish the claim?")).when(kind == "url", shown("DAMAGED URL", "CANDIDATES", "Restore the address.")).otherwise(shown("HYPOTHESIS", "DOCUMENT", "Must the hypothesis be true?"))


def seed_messages(kind: Column, subject: Column, n: Column) -> Column:
    """The system and user turns that every run starts with."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.concat(system_prompt(kind), F.lit(f"\n\nTOOLS:\n{TOOL_SCHEMA}"))), message("user", task_prompt(kind, subject, n)))


def _segment(text: Column, trainable: bool, role: Column, kind: Column | str) -> Column:
    return F.struct(text.alias("text"), F.lit(trainable).alias("trainable"), role.alias("role"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


def assistant_segments(content: Column) -> Column:
    """Lines of a turn, line ends kept, as prose, tool_call or answer; an empty turn is one empty piece of prose."""
    role = F.lit("assistant")
    kind = lambda t: F.when(t.rlike(r"(?i)\blookup\s*\("), "tool_call").when(t.rlike(r"(?i)^\s*(CITE|ANSWER)\s*:"), "answer").otherwise("prose")
    lines = F.filter(F.split(content, LINE_END), lambda t: t != "")
    return F.when(content == "", F.array(_segment(F.lit(""), True, role, "prose"))).otherwise(F.transform(lines, lambda t: _segment(t, True, role, kind(t))))


def segments(messages: Column) -> Column:
    """All messages as segments; only what an assistant wrote is trained on. Joined, they are the rendering."""

    def one(m: Column) -> Column:
        role, content = m["role"], F.coalesce(m["content"], F.lit(""))
        opened = F.array(_segment(F.lit("<|im_start|>assistant\n"), False, role, "context"))
        closed = F.array(_segment(F.lit("<|im_end|>"), True, role, "answer"), _segment(F.lit("\n"), False, role, "context"))
        other = F.array(_segment(F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n")), False, role, "context"))
        return F.when(role == "assistant", F.concat(opened, assistant_segments(content), closed)).otherwise(other).cast(SEGMENTS)

    return F.flatten(F.transform(messages, one))


def render(messages: Column) -> Column:
    return F.array_join(F.transform(segments(messages), lambda s: s["text"]), "")


def prompt_hash(messages: Column) -> Column:
    return content_id(json_string(render(messages)))


def chars(segs: Column, wanted=None) -> Column:
    """Code points in segments (those that ``wanted`` accepts)."""
    kept = F.filter(segs, wanted) if wanted else segs
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"]))
