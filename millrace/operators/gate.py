"""The gate: every run gets exactly one reason code, the first that applies in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import content_words, has_negation, let, parse_turn

# Fixed values, in the order in which they are tried.
REASONS = ("TEACHER_ERROR", "STEP_CAP", "REQUEST_CAP", "FORMAT_INVALID", "NO_TOOL_CALL", "LABEL_LEAK", "DUPLICATE_ACROSS_SPLIT", "UNSUPPORTED_ANSWER", "TRIVIAL_OUTPUT", "TEST_FAIL", "VERIFIED_OK")
REWARD_HACKS = ("LABEL_LEAK", "UNSUPPORTED_ANSWER", "TRIVIAL_OUTPUT")
SHARED_LEAST, SHARED_WORDS, PROSE_LEAST = 0.6, 2, 10


def _role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def _fetched(messages: Column) -> Column:
    return F.filter(messages, lambda m: (m["role"] == "tool") & F.coalesce(m["tool_ok"], F.lit(False)))


def final_turn(messages: Column) -> Column:
    """The last assistant turn with any content."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: (m["role"] == "assistant") & (m["content"] != "")), F.lit(-1))["content"], F.lit(""))


def first_turn(messages: Column) -> Column:
    return F.get(_role(messages, "assistant"), 0)["content"]


def retrieved(messages: Column) -> Column:
    """Indices of the evidence that tools returned."""
    return F.array_compact(F.array_distinct(F.transform(_fetched(messages), lambda m: m["evidence_index"])))


def cited_texts(evidence: Column, cite: Column) -> Column:
    """Texts of the cited evidence in the order cited; unknown indices are left out."""
    return F.flatten(F.transform(cite, lambda i: F.transform(F.filter(evidence, lambda e: e["index"] == i), lambda e: e["text"])))


def label_leak(hypothesis: Column, evidence: Column, label: Column) -> Column:
    """The gold label stands in text that the agent sees."""
    visible = F.concat(F.array(F.coalesce(hypothesis, F.lit(""))), F.coalesce(F.transform(evidence, lambda e: F.coalesce(e["text"], F.lit(""))), F.array().cast("array<string>")))
    gold = F.replace(label, F.lit("_"), F.lit(" "))
    named = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\b(entailed|not[_ ]entailed)\b"), F.lit(1)), lambda w: F.replace(F.lower(w), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.exists(visible, lambda t: F.array_contains(named(t), gold)), F.lit(False))


def support_conflict(hypothesis: Column, cited: Column, answer: Column) -> Column:
    """entailed is claimed from cited text that says nearly the same but for one negation."""

    def judged(text: Column, a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        like = F.coalesce(F.try_divide(shared, F.least(F.size(a), F.size(b))) >= SHARED_LEAST, F.lit(False))
        return (shared >= SHARED_WORDS) & like & (has_negation(hypothesis) != has_negation(text))

    found = let(F.array_join(cited, " "), lambda text: let(content_words(hypothesis), lambda a: let(content_words(text), lambda b: judged(text, a, b))))
    return F.coalesce((answer == "entailed") & (F.size(cited) > 0) & found, F.lit(False))


def trivial(messages: Column) -> Column:
    """The first assistant turn has no prose beside calls and answer lines."""
    calls = F.regexp_replace(first_turn(messages), r"(?i)\blookup\s*\([^)]*\)", "")
    prose = F.regexp_replace(calls, r"(?dim)^\s*(CITE|ANSWER)\s*:.*$", "")
    return F.coalesce(F.length(F.regexp_replace(prose, r"^\s+|\s+$", "")) < PROSE_LEAST, F.lit(True))


def verify(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """A verdict for every run (schemas RUN and TASK).

    Tasks are matched by task_id; the first row of an id in each split counts for its contents, and an id in more than
    one split is a duplicate. Runs of unknown tasks are FORMAT_INVALID. The join is planned by size: Spark broadcasts
    tasks where their measured size allows, and splits skewed keys of runs otherwise.
    """
    known = tasks.groupBy("task_id").agg(F.countDistinct("split").alias("n_splits"), F.min(F.struct("split", "kind", "prompt_variant", "hypothesis", "label", "broken", "gold_url", "evidence")).alias("task"))
    joined = runs.join(known, "task_id", "left")
    t = F.col("task")
    url = F.coalesce(t["kind"] == "url", F.lit(False))
    # a list of one keeps the parsed turn whole: the optimizer would copy its regexes into every use of a struct's field
    base = joined.withColumn("turns", F.array(parse_turn(final_turn(F.col("messages")), url))).withColumn("seen", retrieved(F.col("messages")))
    base = base.select("*", F.explode("turns").alias("p")).withColumn("cited", cited_texts(t["evidence"], F.col("p.cite")))
    answer, cite = F.col("p.answer"), F.col("p.cite")
    held = (F.size(cite) > 0) & (F.size(F.array_except(cite, F.col("seen"))) == 0)
    # canonical forms of the answer, the gold and the damaged URL, then of what was cited
    asked = F.array(*[F.coalesce(x, F.lit("")) for x in (answer, t["gold_url"], t["broken"])])
    base = base.withColumn("_f", F.when(url, F.transform(F.concat(asked, F.coalesce("cited", F.array().cast("array<string>"))), urls.forms)))
    own, gold, broken = (F.get("_f", i) for i in range(3))
    others = F.slice("_f", F.lit(4), F.greatest(F.size("_f"), F.lit(1)))
    answered = F.coalesce(answer != "", F.lit(False))
    why_url = F.when(url, urls.support_of(answer, own, others, F.coalesce(t["prompt_variant"], F.lit("pick"))))
    echo = F.when(url, answered & (own["whole"] == broken["whole"])).otherwise(False)
    conflict = F.when(~url, support_conflict(F.coalesce(t["hypothesis"], F.lit("")), F.col("cited"), answer)).otherwise(False)
    leak = F.when(url, F.coalesce(t["gold_url"] != "", F.lit(False)) & (gold["whole"] == broken["whole"])).otherwise(label_leak(t["hypothesis"], t["evidence"], t["label"]))
    right = F.when(url, answered & (own["whole"] == gold["whole"])).otherwise(F.coalesce(answer == t["label"], F.lit(False)))
    for name, made in (("_why_url", why_url), ("_conflict", conflict), ("_echo", echo)):
        base = base.withColumn(name, made)
    why_url, conflict, echo = F.col("_why_url"), F.col("_conflict"), F.col("_echo")
    why = F.when(t.isNull(), "task_not_in_manifest").when(~held, "citation_not_retrieved").when(url & (why_url != "supported"), why_url).when(conflict, "negation_conflict")
    reason = (
        F.when(t.isNull(), "FORMAT_INVALID")
        .when(F.col("exit") == "teacher_error", "TEACHER_ERROR")
        .when(F.col("exit") == "step_cap", "STEP_CAP")
        .when(F.col("exit") == "request_cap", "REQUEST_CAP")
        .when(~F.col("p.has_answer") | ~F.col("p.cite_present"), "FORMAT_INVALID")
        .when(F.size(_fetched(F.col("messages"))) <= 0, "NO_TOOL_CALL")
        .when(leak, "LABEL_LEAK")
        .when(F.col("n_splits") > 1, "DUPLICATE_ACROSS_SPLIT")
        .when(~held | (url & (why_url != "supported")) | conflict, "UNSUPPORTED_ANSWER")
        .when(trivial(F.col("messages")) | echo, "TRIVIAL_OUTPUT")
        .when(~right, "TEST_FAIL")
        .otherwise("VERIFIED_OK")
    )
    judged = base.withColumn("reason_code", reason)
    code = F.col("reason_code")
    said = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))])
    detail = (
        F.when(t.isNull() | (code == "UNSUPPORTED_ANSWER"), said(("why", why)))
        .when(code == "TEACHER_ERROR", said(("error", F.try_element_at("messages", F.lit(-1))["error"])))
        .when(code == "STEP_CAP", said(("steps", F.col("steps"))))
        .when(code == "REQUEST_CAP", said(("requests", F.col("requests"))))
        .when(code == "FORMAT_INVALID", said(("parse_error", F.col("p.error")), ("answer", answer)))
        .when(code == "NO_TOOL_CALL", said(("retrieved", F.to_json("seen"))))
        .when(code == "LABEL_LEAK", said(("label", t["label"])))
        .when(code == "DUPLICATE_ACROSS_SPLIT", said(("task_id", F.col("task_id"))))
        .when(code == "TRIVIAL_OUTPUT", said(("why", F.when(url, "echo_of_input").otherwise("no_reasoning_before_first_tool_call"))))
        .when(code == "TEST_FAIL", said(("predicted", answer), ("gold", F.when(url, t["gold_url"]).otherwise(t["label"]))))
    )
    checks = F.struct(
        (code != "FORMAT_INVALID").alias("parsed"),
        (F.size("seen") > 0).alias("tool_called"),
        (code != "LABEL_LEAK").alias("no_leak"),
        (code != "UNSUPPORTED_ANSWER").alias("citation_ok"),
        (code != "TRIVIAL_OUTPUT").alias("nontrivial"),
        (code != "TEST_FAIL").alias("label_match"),
    )
    return judged.select("run_id", "task_id", "sample_idx", "reason_code", detail.alias("detail"), checks.alias("checks"), answer.alias("predicted"), t["label"].alias("gold"), t["prompt_variant"].alias("variant"), "steps", "requests", F.col("tokens.total").alias("tokens"), "trajectory_hash")


def histogram(verdicts: DataFrame) -> DataFrame:
    """reason_code, n, share of all codes in order of precedence; absent codes have 0."""
    codes = verdicts.sparkSession.createDataFrame([(i, c) for i, c in enumerate(REASONS)], "pos int, reason_code string")
    counts = verdicts.groupBy("reason_code").agg(F.count("*").alias("n"))
    whole = verdicts.agg(F.count("*").alias("total"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(codes).join(counts, "reason_code", "left").join(F.broadcast(whole)).select("pos", "reason_code", n.alias("n"), F.coalesce(F.round(F.try_divide(n, F.col("total")), 4), F.lit(0.0)).alias("share"))


def hack_rate(verdicts: DataFrame) -> DataFrame:
    """One row: totals, and what a check of labels alone would have let through."""
    passes = (F.col("predicted") == F.col("gold")) & (F.col("predicted") != "")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = verdicts.agg(F.count("*").alias("total"), n(F.col("reason_code") == "VERIFIED_OK").alias("verified"), n(passes).alias("label_check_would_accept"), n(passes & F.col("reason_code").isin(*REWARD_HACKS)).alias("rejected_despite_correct_label"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    return out.withColumn("verify_rate", rate("verified", "total")).withColumn("reward_hack_rate", rate("rejected_despite_correct_label", "label_check_would_accept"))


def by_variant(verdicts: DataFrame) -> DataFrame:
    """Counts of codes by variant (null: ``?``), a column for every code."""
    return verdicts.groupBy(F.coalesce("variant", F.lit("?")).alias("variant")).pivot("reason_code", list(REASONS)).agg(F.count(F.lit(1))).na.fill(0)
