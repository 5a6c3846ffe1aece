"""Claims made from facts: transforms that keep or break entailment, and the order in which evidence is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.hashing import draw
from millrace.functions.text import NEGATION_FRAME, claim_words, coverage, lower_first

# Frames that keep a fact's truth, and entities with what each is swapped for, most special first.
FRAMES = ("According to the judgment, {}", "The report states that {}", "It was observed that {}", "{}", "The judgment records that {}")
SWAPS = (
    ("the Supreme Court of India", "the Delhi High Court"),
    ("the Supreme Court", "a High Court"),
    ("the First Appellate Court", "the Second Appellate Court"),
    ("the Trial Court", "the High Court"),
    ("the Appellate Court", "the Sessions Court"),
    ("the bench", "the respondent's counsel"),
    ("the appellant[-‑]plaintiff", "the respondent-defendant"),
    ("the respondent[-‑]defendant", "the appellant-plaintiff"),
    ("the appellant", "the respondent"),
    ("the respondent", "the appellant"),
    ("the applicant", "the respondent"),
    ("the defendant", "the plaintiff"),
    ("the purchaser", "the vendor"),
    ("the vendor", "the purchaser"),
    ("the Union of India", "the State of West Bengal"),
    ("AMOUNT", ""),
    ("Justice", "an advocate"),
    ("the Court held", "the parties agreed"),
    ("four decades", "one decade"),
    ("two years", "five years"),
    ("one month", "six months"),
    ("YEAR", ""),
)
OTHER_YEARS = ("1998", "2004", "2011", "2016", "2021")
AMOUNT_ADDED = 25_000
_AMOUNT = r"\bRs\.?\s?[\d,]*\d[\d,]*"


def identity(fact: Column) -> Column:
    return fact


def restate(fact: Column, seed: Column) -> Column:
    frames = [F.concat(F.lit(a), lower_first(fact), F.lit(b)) for a, b in (x.split("{}") for x in FRAMES)]
    return F.get(F.array(*frames), (draw(seed, "frame") % len(FRAMES)).cast("int"))


def negation(fact: Column) -> Column:
    return F.concat(F.lit(NEGATION_FRAME), lower_first(fact))


def scope_overreach(fact: Column) -> Column:
    return F.concat(F.lit("Indian courts have held that "), lower_first(fact))


def conjunction(fact: Column, other: Column) -> Column:
    return F.concat(fact, F.lit(" In addition, "), lower_first(other))


def broken_conjunction(fact: Column, other: Column) -> Column:
    return F.concat(fact, F.lit(" "), negation(other))


def entity_swap(fact: Column) -> Column:
    """A struct of claim and applied: the first entity that the fact has is swapped once, else the fact is negated."""
    claim = F.when(F.lit(False), fact)
    for pattern, other in SWAPS:
        if pattern == "AMOUNT":
            found = F.regexp_extract(fact, _AMOUNT, 0)
            more = F.format_number(F.regexp_replace(found, r"\D", "").try_cast("long") + AMOUNT_ADDED, 0)
            made = F.concat(F.regexp_replace(found, r"[\d,]+", ""), more)
            at = F.instr(fact, found)
            claim = claim.when((found != "") & more.isNotNull(), F.concat(fact.substr(F.lit(1), at - 1), made, fact.substr(at + F.length(found), F.length(fact))))
        elif pattern == "YEAR":
            present = F.regexp_extract_all(fact, F.lit(r"\d{4}"), F.lit(0))
            year = F.get(F.array_except(F.array(*map(F.lit, OTHER_YEARS)), present), 0)
            found = F.regexp_extract(fact, r"\b\d{4}\b", 0)
            at = F.length(F.regexp_extract(fact, r"(?s)^(.*?)\b\d{4}\b", 1))
            claim = claim.when(found != "", F.concat(fact.substr(F.lit(1), at), year, fact.substr(at + 5, F.length(fact))))
        else:
            claim = claim.when(fact.rlike(rf"\b{pattern}\b"), F.regexp_replace(fact, rf"(?s)^(.*?)\b{pattern}\b", f"$1{other}"))
    return F.struct(F.coalesce(claim, negation(fact)).alias("claim"), F.when(claim.isNull(), "negation").otherwise("entity_swap").alias("applied"))


#: name: (claim of (fact, other fact, seed), label).
TRANSFORMS = {
    "identity": (lambda f, o, s: identity(f), "entailed"),
    "restate": (lambda f, o, s: restate(f, s), "entailed"),
    "conjunction": (lambda f, o, s: conjunction(f, o), "entailed"),
    "negation": (lambda f, o, s: negation(f), "not_entailed"),
    "entity_swap": (lambda f, o, s: entity_swap(f)["claim"], "not_entailed"),
    "scope_overreach": (lambda f, o, s: scope_overreach(f), "not_entailed"),
    "broken_conjunction": (lambda f, o, s: broken_conjunction(f, o), "not_entailed"),
}


def rank_facts(facts: Column, claim: Column) -> Column:
    """Facts by how much of the claim they cover, then by text; of an even number the first three are turned by one."""
    wanted = claim_words(claim)
    scored = F.transform(facts, lambda f: F.struct((-coverage(wanted, claim_words(f))).alias("o"), f.alias("f")))
    ordered = F.transform(F.array_sort(scored), lambda x: x["f"])
    head, tail = F.slice(ordered, 1, 3), F.slice(ordered, F.lit(4), F.greatest(F.size(ordered), F.lit(1)))
    turned = F.concat(F.slice(head, F.lit(2), F.greatest(F.size(head), F.lit(1))), F.slice(head, 1, 1))
    return F.concat(F.when((F.size(head) > 1) & (F.size(ordered) % 2 == 0), turned).otherwise(head), tail)
