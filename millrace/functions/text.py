"""Text columns: units, word sets, negation, likeness and the protocol of an assistant's turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NEGATION_MARKERS = ("not", "no", "never", "none", "nothing", "cannot", "without", "neither")
FRAME_WORDS = ("case", "true", "fact", "there")
STOP_WORDS = ("a an the is are was were be being been of to in on at for with and or that this it its as by from there his her their who which as s t").split()
CLAIM_STOP_WORDS = ("a an the of in on at for and or that this it its as by from was were is are be been has have had shall not no which who whom whose when where while than then there their they his her him he she we you i").split()
GUESS_STOP_WORDS = ("a an the is are was were be being been of to in on at for with and or that this it its as by from there his her their who which not").split()
UNIT_BREAK = r"(?i)(?<=[,;:])\s+|\s+(?:and|but|while|although|though|because|so|which|who)\s+"
NEGATION_FRAME = "It is not the case that "
LABELS = ("entailed", "not_entailed")
MAX_UNITS = 4

LOOKUP = r"\blookup\s*\(\s*(-?\d+)\s*\)"
CITE_LINE = r"(?dim)^\s*CITE\s*:\s*(.+?)\s*$"
ANSWER_LINE = r"(?dim)^\s*ANSWER\s*:\s*(.+?)\s*$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it: the plan does not grow with its uses."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _set(words: Column) -> Column:
    return F.array_distinct(words)


def _words_of(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def split_units(text: Column, max_units: int = MAX_UNITS) -> Column:
    """Clauses of a text: cut after , ; : and at conjunctions. Of more than max_units the first ones and the last stay."""
    parts = F.filter(F.transform(F.split(strip(text), UNIT_BREAK), strip), lambda p: p != "")
    return let(parts, lambda p: F.when(F.size(p) == 0, F.array(strip(text))).when(F.size(p) > max_units, F.concat(F.slice(p, 1, max_units - 1), F.slice(p, -1, 1))).otherwise(p))


def word_set(text: Column) -> Column:
    return _set(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)))


def content_words(text: Column) -> Column:
    """Words that carry content: no stop words, no negation, longer than two letters."""
    kept = F.filter(word_set(text), lambda w: F.length(w) > 2)
    return F.array_except(kept, _words_of(*STOP_WORDS, *NEGATION_MARKERS, *FRAME_WORDS))


def claim_words(text: Column) -> Column:
    kept = F.filter(_set(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), lambda w: F.length(w) > 2)
    return F.array_except(kept, _words_of(*CLAIM_STOP_WORDS))


def has_negation(text: Column) -> Column:
    return F.arrays_overlap(word_set(text), _words_of(*NEGATION_MARKERS))


def coverage(a: Column, b: Column) -> Column:
    """The share of set a that is in b (0 for an empty a)."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (0 if either is empty)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def letters(text: Column) -> Column:
    """The set of a text's characters."""
    return _set(F.filter(F.split(text, ""), lambda c: c != ""))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(text.substr(1, 1)), text.substr(F.lit(2), F.length(text)))


def negate(text: Column) -> Column:
    return F.when(text == "", text).otherwise(F.concat(F.lit(NEGATION_FRAME), lower_first(text)))


def parse_turn(text: Column, freeform: Column | bool = False) -> Column:
    """A struct of lookups, cite, answer, cite_present, answer_present, has_answer and error of an assistant's turn.

    The last CITE and ANSWER lines count. Labels are compared without case and full stops; free-form answers stay as
    they are. Malformed turns give an error, never a failure.
    """
    free = F.lit(freeform) if isinstance(freeform, bool) else F.coalesce(freeform, F.lit(False))
    last = lambda t, pattern: F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.lit(-1))
    bare = lambda x: F.regexp_replace(strip(x), r"^[\[\]()]+|[\[\]()]+$", "")

    def found(t: Column) -> Column:
        line = strip(last(t, ANSWER_LINE))
        return F.struct(
            t.alias("t"),
            F.transform(F.regexp_extract_all(t, F.lit(LOOKUP), F.lit(1)), lambda x: x.cast("int")).alias("lookups"),
            last(t, CITE_LINE).alias("cite"),
            F.when(free, line).otherwise(F.lower(F.regexp_replace(line, r"^\.+|\.+$", ""))).alias("answer"),
        )

    def judged(r: Column) -> Column:
        items = F.filter(F.transform(F.split(F.replace(r["cite"], F.lit(";"), F.lit(",")), ","), bare), lambda x: x.rlike("^[0-9]+$"))
        fits = F.when(free, r["answer"] != "").otherwise(r["answer"].isin(*LABELS))
        return F.struct(r.alias("r"), F.coalesce(F.transform(items, lambda x: x.cast("int")), F.array().cast("array<int>")).alias("cite"), F.coalesce(fits, F.lit(False)).alias("fits"))

    def turn(j: Column) -> Column:
        r = j["r"]
        error = (
            F.when(r["t"] == "", "empty_assistant_turn")
            .when(r["answer"].isNull(), "missing_ANSWER_line")
            .when(~j["fits"] & free, "empty_answer")
            .when(~j["fits"], F.concat(F.lit("unknown_label:"), r["answer"]))
            .when(r["cite"].isNull(), "missing_CITE_line")
            .when(F.size(j["cite"]) == 0, "empty_CITE")
        )
        return F.struct(r["lookups"].alias("lookups"), j["cite"].alias("cite"), r["answer"].alias("answer"), r["cite"].isNotNull().alias("cite_present"), r["answer"].isNotNull().alias("answer_present"), j["fits"].alias("has_answer"), error.alias("error"))

    kept = F.when(F.coalesce(strip(text) == "", F.lit(True)), F.lit("")).otherwise(text)
    return let(kept, lambda t: let(found(t), lambda r: let(judged(r), turn)))


def turn_complete(text: Column) -> Column:
    """Whether a turn can end here: it calls a tool, or has both its CITE and its ANSWER line with a label."""
    answered = text.rlike(r"(?dim)^\s*ANSWER\s*:\s*(not_)?entailed\b") & text.rlike(CITE_LINE)
    return F.coalesce(text.rlike(LOOKUP) | answered, F.lit(False))


def format_answer(label: Column, cite: Column) -> Column:
    return F.concat(F.lit("CITE: "), F.array_join(cite.cast("array<string>"), ", "), F.lit("\nANSWER: "), label)


def clean_completion(text: Column) -> Column:
    """Without reasoning blocks, closed or not, and without a role echo at the start."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)<think>.*$", "")
    return strip(F.regexp_replace(strip(out), r"(?is)^assistant\s*:?\s*\n", ""))
