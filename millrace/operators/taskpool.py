"""Task pools: documents, articles and URLs become tasks with ids, splits and adversarial variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import claims, urls
from millrace.functions.hashing import canonical_json, content_id, draw, split_of, stable_seed, task_identity, json_string
from millrace.functions.text import let, negate, split_units, word_set
from millrace.sources.records import stored

TRAP_UNITS = 3
LEAST_LIKENESS = 0.15
LABELS = {"entailment": "entailed", "entailed": "entailed", "neutral": "not_entailed", "contradiction": "not_entailed", "not_entailed": "not_entailed", "0": "entailed", "1": "not_entailed", "2": "not_entailed"}


def binary_label(label: Column) -> Column:
    """entailed or not_entailed; null for labels that are not known."""
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[label.cast("string")]


def evidence(units: Column) -> Column:
    return F.transform(units, lambda u, i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("evidence_id"), i.alias("index"), u.alias("text")))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def usable(rows: DataFrame) -> DataFrame:
    """Rows (premise, hypothesis, label) with a known label and at least two units, the first of each pair of texts."""
    clean = rows.withColumn("premise", F.trim("premise")).withColumn("hypothesis", F.trim("hypothesis")).withColumn("label", binary_label(F.col("label")))
    kept = clean.where("label is not null and premise <> '' and hypothesis <> ''").where(F.size(split_units(F.col("premise"))) >= 2)
    return first_of(kept, ["premise", "hypothesis"], ["source_id"])


def make_tasks(rows: DataFrame, salt: str, eval_pct: int = 20) -> DataFrame:
    """Tasks of rows (source_id, premise, hypothesis, label, prompt_variant, origin); one for each id."""
    made = rows.withColumn("evidence", evidence(split_units(F.col("premise")))).where(F.size("evidence") >= 2)
    named = made.withColumn("task_id", task_identity(F.col("hypothesis"), F.col("evidence"), F.col("prompt_variant")))
    out = named.select("task_id", F.lit("entailment").alias("kind"), "origin", split_of(F.col("task_id"), salt, eval_pct).alias("split"), "prompt_variant", F.col("source_id").cast("string").alias("source_id"), "hypothesis", "label", F.size("evidence").alias("n_units"), "evidence")
    return first_of(out, ["task_id"], ["source_id"])


def negation_flips(rows: DataFrame) -> DataFrame:
    """Entailed hypotheses, negated."""
    return rows.where("label = 'entailed'").withColumn("hypothesis", negate(F.col("hypothesis"))).withColumn("label", F.lit("not_entailed")).withColumn("prompt_variant", F.lit("negation_flip")).withColumn("origin", F.lit("synth"))


def premise_negations(rows: DataFrame) -> DataFrame:
    """The last unit of a short premise, negated."""
    units = split_units(F.col("premise"))
    return rows.where(F.size(units) <= TRAP_UNITS).withColumn("hypothesis", negate(F.element_at(units, -1))).withColumn("label", F.lit("not_entailed")).withColumn("prompt_variant", F.lit("premise_negation")).withColumn("origin", F.lit("synth"))


def best_match(queries: DataFrame, donors: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """q_id, d_id, score: for every query (q_id, q_text) the donor (d_id, d_text) whose words are most alike, ties to the
    smaller d_id, if at least ``least``. With a column ``own`` on both sides, donors whose ``own`` is the query's are no
    donors.

    Pairs without a common word score 0 and never count, so pairs are met through their words: shared words are counted
    by pair, before the shuffle where they can be, and give the likeness with the two sizes. Sizes that rule a likeness
    of ``least`` out are left before. A frequent word brings many rows together; AQE splits it where it is too many.
    """
    guarded = ["own"] if "own" in queries.columns and "own" in donors.columns else []
    spread = lambda df, key, text, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in guarded], word_set(F.col(text)).alias("words")).select(key, *[f"{p}_{c}" for c in guarded], F.size("words").alias(f"{p}_size"), F.explode("words").alias("w"))
    q, d = spread(queries, "q_id", "q_text", "q"), spread(donors, "d_id", "d_text", "d")
    met = q.join(d, "w").where(F.least("q_size", "d_size") >= least * F.greatest("q_size", "d_size"))
    for c in guarded:
        met = met.where(F.col(f"q_{c}") != F.col(f"d_{c}"))
    shared = met.groupBy("q_id", "d_id", "q_size", "d_size").agg(F.count(F.lit(1)).alias("n"))
    scored = shared.select("q_id", "d_id", (F.col("n") / (F.col("q_size") + F.col("d_size") - F.col("n"))).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("q_id").agg(F.max("score").alias("score"), F.min_by("d_id", F.struct(-F.col("score"), F.col("d_id"))).alias("d_id"))
    return best.select("q_id", "d_id", "score")


def distractors(rows: DataFrame, donors: DataFrame) -> DataFrame:
    """Short premises with the most alike unit of a donor of another premise, that is not entailed, added at the end; the
    label stays."""
    short = rows.where(F.size(split_units(F.col("premise"))) <= TRAP_UNITS - 1)
    last = donors.where("label <> 'entailed'").select(F.col("source_id").alias("d_id"), F.element_at(split_units(F.col("premise")), -1).alias("d_text"), F.col("premise").alias("own"))
    best = best_match(short.select(F.col("source_id").alias("q_id"), F.col("hypothesis").alias("q_text"), F.col("premise").alias("own")), last)
    joined = short.join(best, short.source_id == best.q_id).join(last.drop("own"), "d_id")
    return joined.withColumn("premise", F.concat_ws(" ", "premise", "d_text")).withColumn("prompt_variant", F.lit("distractor")).withColumn("origin", F.lit("synth")).select(*rows.columns, "prompt_variant", "origin")


TRAPS = ("negation_flip", "premise_negation", "distractor")


def deal_traps(rows: DataFrame, donors: DataFrame, n: int) -> DataFrame:
    """source_id, trap: rows (with seed) in the order of their seeds, each made into the trap whose turn it is if it can
    be; the turn goes on only then, until ``n`` are dealt. A sampling step over as many rows as a manifest may have."""
    good = distractors(rows.drop("seed"), donors.drop("seed")).select("source_id").withColumn("alike", F.lit(True))
    short = F.size(split_units(F.col("premise"))) <= TRAP_UNITS
    can = rows.join(good, "source_id", "left").select("seed", "source_id", F.array(F.col("label") == "entailed", short, F.coalesce("alike", F.lit(False))).alias("can"))
    listed = can.agg(F.array_sort(F.collect_list(F.struct("seed", "source_id", "can"))).alias("rows"))
    kind = rows.schema["source_id"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("made"), F.array().cast(f"array<struct<source_id:{kind},trap:string>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        turn = a["made"] % len(TRAPS)
        ok = (a["made"] < n) & F.get(r["can"], turn)
        one = F.array(F.struct(r["source_id"].alias("source_id"), F.get(F.array(*map(F.lit, TRAPS)), turn).alias("trap")))
        return F.struct((a["made"] + ok.cast("int")).alias("made"), F.when(ok, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return listed.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("d")).select("d.*")


def nli_manifest(rows: DataFrame, salt: str, n_tasks: int, synth_fraction: float = 0.4, eval_pct: int = 20) -> DataFrame:
    """Base and adversarial tasks of rows (source_id, premise, hypothesis, label).

    Of the usable rows the first 4 n_tasks by source_id count, in the order of their seeds: the first ones become base
    tasks, the others are dealt into traps (``deal_traps``) and are the donors of distractors. They are stored once: each
    of the steps that read them would look through all rows again.
    """
    n_synth = round(n_tasks * synth_fraction)
    pool = stored(usable(rows).orderBy("source_id").limit(4 * n_tasks), "pool")  # a sampling operator: its size is the feature
    good = pool.withColumn("seed", stable_seed(salt, json_string(F.col("premise")), json_string(F.col("hypothesis"))))
    base = good.orderBy("seed", "source_id").limit(n_tasks - n_synth)
    rest = good.join(base.select("source_id"), "source_id", "left_anti").select(*good.columns)
    dealt = deal_traps(rest, rest, n_synth)
    trapped = rest.join(dealt, "source_id")
    plain = base.drop("seed").withColumn("prompt_variant", F.lit("base")).withColumn("origin", F.lit("base"))
    pick = lambda k: trapped.where(F.col("trap") == TRAPS[k]).select(*rows.columns)
    synth = negation_flips(pick(0)).unionByName(premise_negations(pick(1))).unionByName(distractors(pick(2), rest.select(*rows.columns)))
    return make_tasks(plain.select(*rows.columns, "prompt_variant", "origin").unionByName(synth), salt, eval_pct)


def claim_schedule(articles: DataFrame, salt: str, variants: tuple[str, ...] = tuple(claims.TRANSFORMS)) -> DataFrame:
    """A row for each fact (article_id, facts): whether its claim is to hold, and by which of the transforms."""
    positive = tuple(v for v in variants if claims.TRANSFORMS[v][1] == "entailed")
    negative = tuple(v for v in variants if v not in positive)
    facts = articles.where(F.size("facts") >= 4).select("article_id", "facts", F.posexplode("facts").alias("index", "fact"))
    seeded = facts.withColumn("seed", stable_seed(salt, json_string(F.col("article_id")), F.col("index").cast("string"), "pos"))
    holds = F.col("seed") % 1000 < 500
    variant = lambda pool: F.get(F.array(*map(F.lit, pool)), F.col("index") % len(pool))
    return seeded.withColumn("variant", F.when(holds, variant(positive)).otherwise(variant(negative)))


def claim_tasks(articles: DataFrame, salt: str, eval_pct: int = 20, n_tasks: int | None = None, variants: tuple[str, ...] = tuple(claims.TRANSFORMS)) -> DataFrame:
    """Tasks over claims from facts of articles (article_id, facts): all different ones, or of these the first
    ``n_tasks`` by article and fact."""
    rows = claim_schedule(articles, salt, variants)
    n = F.size("facts")
    other = F.get("facts", F.pmod(F.col("index") + 1 + (draw(F.col("seed"), "other") % (n - 1)).cast("int"), n))
    claim = label = F.lit(None).cast("string")
    for name, (make, holds) in claims.TRANSFORMS.items():
        claim = F.when(F.col("variant") == name, make(F.col("fact"), F.col("other"), F.col("seed"))).otherwise(claim)
        label = F.when(F.col("variant") == name, holds).otherwise(label)
    made = rows.withColumn("other", other).withColumn("claim", claim).withColumn("label", label)
    made = made.withColumn("applied", F.when(F.col("variant") == "entity_swap", claims.entity_swap(F.col("fact"))["applied"]).otherwise(F.col("variant")))
    ranked = made.withColumn("ranked", claims.rank_facts(F.col("facts"), F.col("claim"))).withColumn("evidence", evidence(F.col("ranked")))
    both = F.col("variant").isin("conjunction", "broken_conjunction")
    support = F.when(both, F.array(F.array_position("ranked", F.col("fact")) - 1, F.array_position("ranked", F.col("other")) - 1)).otherwise(F.array(F.array_position("ranked", F.col("fact")) - 1))
    named = ranked.withColumn("task_id", content_id(canonical_json(kind=F.lit("legal"), claim=F.col("claim"), article_id=F.col("article_id"), evidence=F.col("evidence"))))
    out = named.select("task_id", F.lit("legal").alias("kind"), F.lit("legal").alias("origin"), split_of(F.col("task_id"), salt, eval_pct).alias("split"), F.col("variant").alias("prompt_variant"), F.col("applied").alias("transform_applied"), "article_id", F.col("index").alias("source_index"), F.col("claim").alias("hypothesis"), "claim", "label", support.alias("support_positions"), F.size("evidence").alias("n_units"), "evidence")
    different = first_of(out, ["task_id"], ["article_id", "source_index"])
    return different if n_tasks is None else different.orderBy("article_id", "source_index").limit(n_tasks)


def near_miss(own: Column, seed: Column) -> Column:
    """Another URL than that of the parts: on its scheme, host and port (40 of 100), with its path and fragment (30), or
    unlike it (30)."""
    kind = draw(seed, "kind") % 100
    take = lambda other, *names: F.struct(*[(own if k in names else other)[k].alias(k) for k in ("scheme", "host", "port", "path", "query", "fragment")])

    def made(other: Column) -> Column:
        return F.when(kind < 40, urls.joined(take(other, "scheme", "host", "port"))).when(kind < 70, urls.joined(take(other, "path", "fragment"))).otherwise(urls.joined(other))

    return let(urls.make_parts(seed), made)


def order_candidates(damaged: Column, candidates: Column, seed: Column) -> Column:
    """Candidates by how like they are to the damaged URL, then by text; the first three then lie in a drawn order, so the
    place of the answer says nothing."""
    scored = let(urls.parts(damaged), lambda p: F.array_sort(F.transform(candidates, lambda c: F.struct((-urls.relevance_of(p, c)).alias("o"), c.alias("c")))))

    def dealt(ranked: Column) -> Column:
        head = F.array_sort(F.transform(F.slice(ranked, 1, 3), lambda x, i: F.struct(stable_seed(seed.cast("string"), "head", i.cast("string")).alias("o"), x["c"].alias("c"))))
        tail = F.slice(ranked, F.lit(4), F.greatest(F.size(ranked), F.lit(1)))
        return F.concat(F.transform(head, lambda x: x["c"]), F.transform(tail, lambda x: x["c"]))

    return let(scored, dealt)


def url_tasks(spark, n: int, salt: str, variant: str = "pick", eval_pct: int = 20, tries: int = 12, shard: int = 0, shards: int = 1) -> DataFrame:
    """Tasks of damaged URLs with candidates: ``pick`` (among three near misses), ``pick_hard`` (hard damages only) and
    ``compose``.

    A damage that the canonical form undoes is drawn again, up to ``tries``; corruptions and difficulty count the damages
    that alone change the URL. In ``compose`` the base is damaged, the answer is its location with the query of a donor
    that has one, and stands nowhere among the candidates: base, donor and two near misses. Of several shards, one makes
    the ids that fall on it.
    """
    composed = variant == "compose"
    names = urls.QUERY_PRESERVING if composed else tuple(k for k, (_, hard) in urls.CORRUPTIONS.items() if variant != "pick_hard" or hard == 3)
    ids = spark.range(shard, n, shards)
    # explode of a list of one: the optimizer would copy an expression into every use of its columns, filters among them
    once = lambda df, value, name: df.select("*", F.explode(F.array(value)).alias(name))
    base = ids.select("id", stable_seed(salt, variant, F.col("id").cast("string")).alias("seed"))
    made = once(base, urls.make_parts(F.col("seed")), "own").withColumn("url", urls.joined(F.col("own")))
    near = [near_miss(F.col("own"), draw(F.col("seed"), f"near{i}")) for i in range(2 if composed else 3)]
    if composed:
        # donors are made one after the other, until one has a query; without any, the last counts
        first = urls.make_parts(draw(F.col("seed"), "donor"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(10)), first, lambda a, i: F.when(a["query"] != "", a).otherwise(urls.make_parts(draw(F.col("seed"), "donor") + i)))
        made = once(made, found, "donor_parts")
        made = once(made.withColumn("donor", urls.joined(F.col("donor_parts"))), urls.compose(F.col("url"), F.col("donor")), "gold_url")
        listed = F.array("url", "donor", *near)
    else:
        made = made.withColumn("gold_url", F.col("url"))
        listed = F.array("url", *near)
    made = once(made, F.array_distinct(listed), "candidates").select("id", "seed", "url", "gold_url", "candidates")

    def attempt(seed: Column, own: Column) -> Column:
        kept = lambda kinds, broken: F.when(urls.normalize(broken) != own, F.struct(broken.alias("broken"), kinds.alias("kinds")))
        return let(urls.sample_kinds(seed, names), lambda kinds: let(urls.corrupt(F.col("url"), kinds, seed), lambda broken: kept(kinds, broken)))

    # damages are drawn one after the other, until one shows
    none = F.lit(None).cast("struct<broken:string,kinds:array<string>>")
    tried = lambda own, first: F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), none, lambda a, i: F.when(a.isNotNull(), a).otherwise(attempt(first + i, own)))
    damaged = once(made, let(urls.normalize(F.col("url")), lambda own: let(draw(F.col("seed"), "try"), lambda first: tried(own, first))), "r").where("r is not null")
    whole = damaged.select("id", "seed", "url", "gold_url", "candidates", "r.broken", "r.kinds")
    if composed:
        whole = whole.where(~F.array_contains("candidates", F.col("gold_url")))
    ordered = once(once(whole, evidence(order_candidates(F.col("broken"), F.col("candidates"), F.col("seed"))), "evidence"), urls.landed(F.col("url"), F.col("kinds")), "corruptions")
    named = ordered.withColumn("task_id", content_id(canonical_json(kind=F.lit("url"), broken=F.col("broken"), gold_url=F.col("gold_url"), evidence=F.col("evidence"))))
    return named.select("task_id", F.lit("url").alias("kind"), F.lit("url").alias("origin"), split_of(F.col("task_id"), salt, eval_pct).alias("split"), F.lit(variant).alias("prompt_variant"), F.col("id").cast("string").alias("source_id"), F.col("broken").alias("hypothesis"), "broken", "gold_url", F.col("gold_url").alias("label"), "corruptions", urls.difficulty(F.col("corruptions")).alias("difficulty"), F.size("evidence").alias("n_units"), "evidence")


def url_manifest(spark, n_tasks: int, salt: str, synth_fraction: float = 0.4, eval_pct: int = 20) -> DataFrame:
    """URL tasks: of the synthetic share half (rounded down) combine two URLs and the rest are hard, the others are plain."""
    n_synth = round(n_tasks * synth_fraction)
    quota = {"pick": n_tasks - n_synth, "compose": n_synth // 2, "pick_hard": n_synth - n_synth // 2}
    out = [url_tasks(spark, n, salt, variant, eval_pct) for variant, n in quota.items()]
    return first_of(out[0].unionByName(out[1]).unionByName(out[2]), ["task_id"], ["prompt_variant", "source_id"])


def manifest_summary(tasks: DataFrame) -> DataFrame:
    """Counts by split, variant, origin and label, and by applied transform and difficulty where tasks have them, in one
    pass: dimension, value, n."""
    dims = ("split", "prompt_variant", "origin", "label", *(c for c in ("transform_applied", "difficulty") if c in tasks.columns))
    row = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("?")).alias("value")) for d in dims]))
    return tasks.select(row.alias("r")).groupBy("r.dimension", "r.value").agg(F.count("*").alias("n"))


def split_overlap(tasks: DataFrame) -> DataFrame:
    """Ids in both splits."""
    ids = lambda s: tasks.where(F.col("split") == s).select("task_id")
    return ids("train").intersect(ids("eval"))
