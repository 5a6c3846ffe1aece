"""Registries of task sources, teachers and contenders, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import claims, urls
from millrace.functions.hashing import content_id, draw, json_string, stable_seed
from millrace.functions.text import jaccard, let, letters
from millrace.operators import farm, gate, metrics, taskpool
from millrace.operators.render import MAX_LOOKUPS, seed_messages
from millrace.schemas import MESSAGES
from millrace.sources.records import Config, read_articles

Runner = Callable[[DataFrame, int], DataFrame]


def repaired(broken: Column, texts: Column) -> Column:
    """The answer for a damaged URL from the candidates that were read: the likest location, with the query of another
    candidate if that explains the damaged URL's parameters better than its own does; the damaged URL if none was read."""
    host = lambda p: letters(F.regexp_replace(p["netloc"], r":\d*$", ""))
    words = lambda p: F.array_distinct(F.regexp_extract_all(F.lower(p["path"]), F.lit("[a-z0-9]+"), F.lit(0)))
    names = lambda p: F.array_distinct(F.filter(F.transform(F.split(p["query"], "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != ""))

    def decided(d: Column, own: Column) -> Column:
        def rated(text: Column, i: Column) -> Column:
            score = lambda p: 2.0 * jaccard(host(d), host(p)) + 1.5 * jaccard(words(d), words(p))
            return let(urls.parts(text), lambda p: F.struct(score(p).alias("score"), (-i).alias("order"), text.alias("text"), jaccard(own, names(p)).alias("explains"), (F.size(names(p)) > 0).alias("asks")))

        def chosen(rows: Column) -> Column:
            def spliced(base: Column) -> Column:
                others = F.transform(F.filter(rows, lambda r: (r["text"] != base["text"]) & r["asks"]), lambda r: F.struct(r["explains"].alias("explains"), r["order"].alias("order"), r["text"].alias("text")))
                donor = F.array_max(others)
                better = F.coalesce(donor["explains"] > base["explains"], F.lit(False)) & (F.size(own) > 0)
                return F.when(better, urls.compose(base["text"], donor["text"])).otherwise(base["text"])

            return let(F.array_max(rows), spliced)

        return let(F.transform(texts, rated), chosen)

    return F.coalesce(let(urls.parts(broken), lambda d: let(names(d), lambda own: decided(d, own))), broken)


def url_repair_runs(tasks: DataFrame, samples: int = 1, echo_pct: int = 0, ungrounded_pct: int = 0, base_temperature: float = 0.8, seed: int = 0) -> DataFrame:
    """Runs of a teacher for URL tasks in closed form: it reads the first one to three candidates (drawn) in one turn, and
    answers with what it makes of them.

    A share of runs, larger at higher temperatures, answers with the damaged URL itself (echo) or also cites an index
    that it has not read (ungrounded), drawn by run; another seed draws anew.
    """
    rows = tasks.where("kind = 'url'").select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_idx"))
    parts = ["repair", json_string(F.col("run_id")), *([seed] if seed else [])]
    rows = rows.withColumn("run_id", F.concat_ws(":", "task_id", "sample_idx")).withColumn("seed", stable_seed(*parts)).withColumn("temperature", farm.temperature(base_temperature, F.col("sample_idx")))
    wanted = F.get(F.array(*map(F.lit, (1, 2, 2, 3, 3))), (draw(F.col("seed"), "k") % 5).cast("int"))
    rows = rows.withColumn("k", F.least(F.size("evidence"), F.lit(MAX_LOOKUPS), wanted))
    rows = rows.withColumn("best", repaired(F.col("broken"), F.transform(F.slice("evidence", F.lit(1), F.col("k")), lambda e: e["text"])))
    likely = lambda pct: F.greatest(F.lit(0.0), F.least(F.lit(95.0), pct * F.col("temperature") / 0.8))
    echo, loose = draw(F.col("seed"), "echo") % 100 < likely(echo_pct), draw(F.col("seed"), "loose") % 100 < likely(ungrounded_pct)
    read = F.sequence(F.lit(0), F.col("k") - 1)
    unread = F.col("k") + (draw(F.col("seed"), "extra") % F.greatest(MAX_LOOKUPS - F.col("k"), F.lit(1))).cast("int")
    cite = F.when(loose & (F.col("k") < MAX_LOOKUPS), F.concat(read, F.array(unread))).otherwise(read)
    rows = rows.withColumn("answer", F.when(echo, F.col("broken")).otherwise(F.col("best"))).withColumn("cite", cite)
    calls = F.array_join(F.transform(read, lambda i: F.concat(F.lit("lookup("), i.cast("string"), F.lit(")"))), " ")
    asked = farm.message("assistant", F.concat(F.lit("PLAN: compare the first candidates.\n"), calls))
    tools = F.transform(read, lambda i: farm.tool_result(F.col("evidence"), i))
    final = farm.message("assistant", F.concat(F.lit("PLAN: what explains the damage best is taken.\nCITE: "), F.array_join(F.col("cite").cast("array<string>"), ", "), F.lit("\nANSWER: "), F.col("answer")))
    opening = F.transform(seed_messages(F.lit("url"), F.col("broken"), F.size("evidence")), lambda m: farm.message(m["role"], m["content"]))
    spent = (F.col("k") + 36).cast("long")
    out = rows.withColumn("messages", F.concat(opening, F.array(asked), tools, F.array(final)).cast(MESSAGES))
    zero, steps = F.lit(0.0), F.lit(2)
    return out.select(
        "run_id", "task_id", "sample_idx", F.lit("url_repair").alias("teacher"), F.lit("likest").alias("model"), "temperature",
        zero.alias("started_at"), zero.alias("wall_s"), steps.alias("steps"), steps.alias("requests"), F.struct(F.lit(0).cast("long").alias("prompt"), spent.alias("completion"), spent.alias("total")).alias("tokens"),
        zero.alias("cost_usd"), F.lit("answered").alias("exit"), "answer", "cite", F.col("k").alias("n_lookups"), "messages", content_id(F.to_json("messages")).alias("trajectory_hash"),
    )


TEACHERS: dict[str, Runner] = {"heuristic": farm.heuristic_runs, "majority": farm.heuristic_runs, "url_repair": url_repair_runs}


#: Tokens that a teacher's lookup turn takes.
TURN_TOKENS = {"heuristic": 12, "majority": 12, "url_repair": 15}


def teacher(name: str, prefer: str | None = None) -> Runner:
    """A teacher by name; ``auto`` takes the preferred one if it is known, else the heuristic."""
    if name == "auto":
        name = prefer if prefer in TEACHERS else "heuristic"
    if name not in TEACHERS:
        raise ValueError(f"unknown teacher {name!r}; there are {', '.join(TEACHERS)}")
    return TEACHERS[name]


TASK_SOURCES: dict[str, Callable[[SparkSession, Config, str], DataFrame]] = {
    "url": lambda spark, c, path: taskpool.url_manifest(spark, c.n_tasks, c.seed_salt, c.synth_fraction, c.eval_pct),
    "legal": lambda spark, c, path: taskpool.claim_tasks(read_articles(spark, path), c.seed_salt, c.eval_pct, c.n_tasks, tuple(c.variants) or tuple(claims.TRANSFORMS)),
    "nli": lambda spark, c, path: taskpool.nli_manifest(spark.read.schema("source_id long, premise string, hypothesis string, label string").json(path), c.seed_salt, c.n_tasks, c.synth_fraction, c.eval_pct),
}


#: Contenders by name: how their runs are made, and what kind they are. A trained student is registered with the function
#: that runs it, for example ``farm.opaque_runs`` with the loaded model.
CONTENDERS: dict[str, tuple[Runner, str]] = {"heuristic": (farm.heuristic_runs, "heuristic"), "majority": (farm.heuristic_runs, "heuristic"), "url_repair": (url_repair_runs, "heuristic")}


def register(name: str, runner: Runner, kind: str = "local") -> None:
    """Makes a contender known under a name of its own."""
    if name in CONTENDERS:
        raise ValueError(f"there is a contender {name!r} already")
    CONTENDERS[name] = runner, kind


def contender(name: str) -> tuple[Runner, str]:
    if name not in CONTENDERS:
        raise ValueError(f"unknown contender {name!r}; there are {', '.join(CONTENDERS)}")
    return CONTENDERS[name]


def evaluate(tasks: DataFrame, contender: str, runner: Runner, seeds: tuple[int, ...] = (0,), kind: str = "api") -> DataFrame:
    """Evaluation rows of a contender: a run of each task and seed, through the gate."""
    runs = runner(tasks, len(seeds)).withColumn("seed", F.get(F.array(*map(F.lit, seeds)), F.col("sample_idx")))
    judged = metrics.results(gate.verify(runs, tasks), runs, contender, kind=kind)
    named = judged.drop("seed").join(runs.select("run_id", "seed"), "run_id")
    return named.withColumn("result_id", F.concat_ws(":", "contender", "seed", "run_id"))
