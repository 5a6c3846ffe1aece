import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import hashing, urls
from millrace.operators import dataset, farm, gate, ledger, metrics, render, report, taskpool, tokenizer, training, windowing
from millrace.plans import adapters
from millrace.sources import records
from millrace.streaming.ingest import ingest, record_stream

EVIDENCE = [("e0", 0, "A man plays a guitar on stage"), ("e1", 1, "The crowd is not dancing tonight")]


def message(role, content, index=None, ok=None):
    return (role, content, index, ok, None, None, None, None)


def run(spark, rows):
    out = []
    for i, r in enumerate(rows):
        plan = r.get("plan", "PLAN: read the segments first")
        tools = [message("tool", EVIDENCE[k][2] if k < 2 else "?", k, True) for k in r.get("seen", [0])]
        close = f"PLAN: done\nCITE: {r.get('cite', '0')}" + ("" if r.get("answer", "entailed") is None else f"\nANSWER: {r.get('answer', 'entailed')}")
        messages = [message("system", "s"), message("user", "u"), message("assistant", f"{plan}\nlookup(0)"), *tools, message("assistant", close)]
        out.append((f"r{i}", r.get("task", "t"), i, "x", "m", 0.0, 0.0, 0.0, 2, 2, (0, 9, 9), 0.0, r.get("exit", "answered"), None, None, 1, messages, f"h{i}"))
    return spark.createDataFrame(out, schemas.RUN)


def task(spark, **over):
    base = {"task_id": "t", "split": "train", "hypothesis": "A man plays guitar", "label": "entailed", "kind": "entailment", "broken": None, "gold_url": None, "variant": "base", "evidence": EVIDENCE}
    rows = [base | o for o in over.pop("rows", [{}])]
    return spark.createDataFrame([(r["task_id"], r["kind"], "base", r["split"], r["variant"], "1", r["hypothesis"], r["label"], None, r["broken"], r["gold_url"], 2, r["evidence"]) for r in rows], schemas.TASK)


def test_every_code_has_its_case(spark):
    cases = [
        ({}, "VERIFIED_OK"),
        ({"answer": "not_entailed"}, "TEST_FAIL"),
        ({"cite": "1"}, "UNSUPPORTED_ANSWER"),
        ({"seen": []}, "NO_TOOL_CALL"),
        ({"plan": "x"}, "TRIVIAL_OUTPUT"),
        ({"answer": None}, "FORMAT_INVALID"),
        ({"exit": "step_cap", "answer": None}, "STEP_CAP"),
        ({"exit": "request_cap"}, "REQUEST_CAP"),
        ({"exit": "teacher_error"}, "TEACHER_ERROR"),
        ({"task": "unknown"}, "FORMAT_INVALID"),
        ({"task": "leaky"}, "LABEL_LEAK"),
        ({"task": "both"}, "DUPLICATE_ACROSS_SPLIT"),
        ({"task": "trap", "seen": [1], "cite": "1"}, "UNSUPPORTED_ANSWER"),
    ]
    tasks = task(spark, rows=[{}, {"task_id": "leaky", "hypothesis": "this is Entailed"}, {"task_id": "both"}, {"task_id": "both", "split": "eval"}, {"task_id": "trap", "label": "not_entailed", "hypothesis": "The crowd is dancing tonight"}])
    verdicts = gate.verify(run(spark, [c for c, _ in cases]), tasks)
    got = {r.run_id: r for r in verdicts.collect()}
    assert [got[f"r{i}"].reason_code for i in range(len(cases))] == [c for _, c in cases]
    assert got["r2"].detail == {"why": "citation_not_retrieved"} and got["r12"].detail == {"why": "negation_conflict"} and got["r9"].detail == {"why": "task_not_in_manifest"}
    h = gate.histogram(verdicts).collect()
    assert sum(r.n for r in h) == len(cases) and len(h) == len(gate.REASONS)
    rate = gate.hack_rate(verdicts).first()
    assert rate.verified == 1 and 0 < rate.reward_hack_rate < 1
    assert gate.histogram(verdicts.limit(0)).agg(F.sum("n")).first()[0] == 0


def test_url_runs(spark):
    evidence = [("e0", 0, "https://a.org/p?x=1"), ("e1", 1, "https://b.org/")]
    tasks = task(spark, rows=[{"kind": "url", "variant": "pick", "broken": "a.org/p", "gold_url": "https://a.org/p?x=1", "label": "https://a.org/p?x=1", "hypothesis": "a.org/p", "evidence": evidence}])
    verdicts = gate.verify(run(spark, [{"answer": "https://A.org/p?x=1"}, {"answer": "https://a.org/p"}, {"answer": "https://b.org/", "seen": [0, 1], "cite": "1"}]), tasks)
    assert [r.reason_code for r in verdicts.orderBy("run_id").collect()] == ["VERIFIED_OK", "UNSUPPORTED_ANSWER", "TEST_FAIL"]


def test_windowing(spark):
    m = [message("system", "s"), message("user", "u"), message("assistant", "a"), message("tool", "x" * 600, 0, True), message("assistant", "lookup(1)"), message("tool", "y" * 600, 1, True), message("assistant", "end")]
    df = spark.createDataFrame([(m,)], f"messages {schemas.MESSAGES}")
    w = df.select(windowing.apply(F.col("messages"), "windowed").alias("m"), windowing.apply(F.col("messages"), "naive_truncated", keep_chars=150).alias("n"), windowing.apply(F.col("messages"), "full_context").alias("f")).first()
    assert [x.windowed for x in w.m] == [None, None, None, True, None, None, None]
    assert w.m[3].content.startswith('{"chars":600,"digest":"tool_result","head":"xxx') and w.m[5].content == "y" * 600
    assert [x.content for x in w.n] == ["s", "u", "end"] and len(w.f) == 7
    with pytest.raises(ValueError, match="unknown"):
        windowing.apply(F.col("messages"), "none")


def test_segments_join_to_the_rendering(spark):
    turns = ["plan\nlookup(0)\nCITE: 1\nANSWER: entailed", "", "a\r\nb\rc\x0bd\u2028e", "tail\n"]
    df = spark.createDataFrame([([message("user", "q"), *(message("assistant", t) for t in turns)],)], f"messages {schemas.MESSAGES}")
    r = df.select(render.segments(F.col("messages")).alias("s"), render.render(F.col("messages")).alias("r")).first()
    assert "".join(s.text for s in r.s) == r.r == "<|im_start|>user\nq<|im_end|>\n" + "".join(f"<|im_start|>assistant\n{t}<|im_end|>\n" for t in turns)
    assert [s.kind for s in r.s[2:6]] == ["prose", "tool_call", "answer", "answer"]
    assert [s.text for s in r.s if s.kind == "prose" and s.text][1:] == ["a\r\n", "b\r", "c\x0b", "d\u2028", "e", "tail\n"]


def test_samples(spark):
    runs, tasks = run(spark, [{}, {"answer": "not_entailed"}]), task(spark)
    verdicts = gate.verify(runs, tasks)
    samples = dataset.build(verdicts, runs, tasks)
    rows = samples.collect()
    assert {r.windowing for r in rows} == set(windowing.STRATEGIES) and {r.run_id for r in rows} == {"r0"}
    assert all(r.chars >= r.trainable_chars >= r.tool_call_chars > 0 for r in rows)
    assert dataset.skipped(verdicts, runs.limit(0), tasks).first()[0] == 1
    steps = spark.createDataFrame([(i % 3, f"s{i}") for i in range(10)], "n_steps int, sample_id string")
    assert sorted(r[1] for r in dataset.stage_one(steps, 0.5).collect()) == ["s0", "s1", "s3", "s6", "s9"]
    assert dataset.stage_one(steps, 0).count() == 0 and dataset.stage_one(steps, 0.01).count() == 1


def test_accounts(spark):
    rows = [(0.0, "a", "t", "x", "m", 1, 10, 5, 15, 0.1, 2.0, None), (0.0, "b", "t", "x", "m", 1, 20, 5, 25, 0.2, 4.0, ""), (0.0, "b", "t", "x", "m", 2, 1, 0, 1, 0.0, 9.0, "late")]
    book = spark.createDataFrame(rows, schemas.LEDGER)
    s = ledger.summary(book).first()
    assert (s.requests, s.tokens, s.errors, s.cost_usd, s.mean_latency_s) == (3, 41, 1, 0.3, 3.0)
    verdicts = spark.createDataFrame([("a", "VERIFIED_OK"), ("b", "TEST_FAIL")], "run_id string, reason_code string")
    e = ledger.efficiency(book, verdicts).first()
    assert (e.tokens_per_verified, e.requests_per_verified, e.tokens_wasted_on_rejected) == (41.0, 2.0, 25)
    assert ledger.efficiency(book, verdicts.limit(0)).first().tokens_per_verified is None
    assert ledger.summary(book.limit(0)).first().requests == 0 and ledger.summary(book.limit(0)).first().mean_latency_s is None


def test_metrics_and_reports(spark, tmp_path):
    rows = [("student", "v", "local", i == 0, True, True, True, "VERIFIED_OK" if i == 0 else "TEST_FAIL", 2, float(i), 0.5, 10) for i in range(4)]
    df = spark.createDataFrame(rows, "contender string, variant string, kind string, passed boolean, label_correct boolean, valid_tool_call boolean, retrieved boolean, reason_code string, steps int, latency_s double, cost_usd double, tokens long")
    s = metrics.summarize(df)
    r = s.first()
    assert (r.pass_at_1, r.latency_p50_s, r.latency_p95_s, r.cost_per_resolved_task_usd, r.compute_seconds) == (0.25, 1.5, 2.85, 2.0, 6.0)
    assert "student" in report.table(metrics.frontier(s)) and "<circle" in report.frontier_svg(metrics.frontier(s))
    assert spark.range(1).select(metrics.params_label(F.lit("local"), F.lit(921600))).first()[0] == "0.92M non-emb"
    verdicts = spark.createDataFrame([("a", "v", "VERIFIED_OK", "entailed", "entailed")], "run_id string, variant string, reason_code string, predicted string, gold string")
    book = spark.createDataFrame([(0.0, "a", "t", "x", "m", 1, 10, 5, 15, 0.1, 2.0, None)], schemas.LEDGER)
    assert report.write_all(str(tmp_path / "r"), df, verdicts, book) == sorted(p.name for p in (tmp_path / "r").iterdir())


def test_tokenizer(spark):
    texts = spark.createDataFrame([(1, "lookup(0) it's fine.\nlookup(1)"), (2, "odd"), (3, "")], "k long, text string")
    vocab = tokenizer.build(texts.where("k = 1"))
    ids = {r.token: r.id for r in vocab.collect()}
    assert ids["<|pad|>"] == 0 and ids["("] == 3 and ids[")"] == 4 and ids["lookup"] == 5
    enc = {r.k: r.ids for r in tokenizer.encode(texts, vocab, "k").collect()}
    assert len(enc[1]) == 12 and enc[2] == [] and enc[3] == []
    back = texts.where("k = 1").select(tokenizer.decode(tokenizer.tokens(F.col("text")))).first()[0]
    assert back == "lookup(0) it's fine.\nlookup(1)"
    assert vocab.count() == len(set(ids.values()))
    assert tokenizer.build(texts, max_vocab=3).count() == 3
    b = tokenizer.batches(tokenizer.encode(texts, vocab, "k"), "k", 2).orderBy("k").collect()
    assert [(r.batch, r.width) for r in b] == [(0, 12), (0, 12), (1, 0)]


def test_training_figures(spark):
    assert training.non_embedding_params(3, 160, 640) == 921_600
    stages = spark.createDataFrame([(10, 2), (0, 1)], "n int, epochs int")
    assert training.steps(stages, 4).first()[0] == 7
    lr = [r[0] for r in spark.range(11).select(training.learning_rate(F.col("id"), 10, 2, 1.0)).collect()]
    assert lr[0] == 0.5 and lr[1] == 1.0 and abs(lr[10] - 0.1) < 1e-9


def test_task_pools(spark):
    rows = spark.createDataFrame([(i, f"A dog number {i} runs, a cat sleeps while birds sing", f"dog {i} runs", ["entailment", "neutral", "-"][i % 3]) for i in range(60)], "source_id long, premise string, hypothesis string, label string")
    tasks = taskpool.nli_manifest(rows, "s", 30).collect()
    assert len({t.task_id for t in tasks}) == len(tasks) and {t.prompt_variant for t in tasks} >= {"base", "negation_flip"}
    articles = spark.createDataFrame([("a", [f"Fact {i} of the Trial Court in {1990 + i}." for i in range(9)]), ("b", ["x", "y"])], "article_id string, facts array<string>")
    made = taskpool.claim_tasks(articles, "s").collect()
    assert len(made) == 9 and {t.label for t in made} == {"entailed", "not_entailed"}
    assert all(t.evidence[p].text in t.claim for t in made if t.prompt_variant == "identity" for p in t.support_positions)
    damaged = taskpool.url_tasks(spark, 30, "s").collect()
    assert len(damaged) > 20 and all(any(e.text == t.gold_url for e in t.evidence) for t in damaged)
    q = spark.createDataFrame([(1, "red green blue"), (2, "nothing like it")], "q_id long, q_text string")
    d = spark.createDataFrame([(7, "red green"), (8, "green red"), (9, "the the the")], "d_id long, d_text string")
    assert [tuple(r)[:2] for r in taskpool.best_match(q, d).collect()] == [(1, 7)]


def test_farm(spark):
    runs = farm.heuristic_runs(task(spark), 2).collect()
    assert [r.steps for r in runs] == [3, 3] and runs[0].answer == "entailed" and runs[0].cite == [0, 1]
    own = farm.opaque_runs(task(spark).select("task_id"), lambda t: {"task_id": t["task_id"], "answer": "entailed"}, "task_id string, answer string")
    assert own.first().answer == "entailed"


def test_capped_runs(spark):
    tasks = task(spark)
    whole = farm.heuristic_runs(tasks)
    assert farm.capped(whole, 12).collect() == whole.collect()
    for caps, code, turns in (({"max_steps": 2}, "STEP_CAP", 2), ({"max_requests": 1}, "REQUEST_CAP", 1), ({"max_tokens": 13}, "STEP_CAP", 2), ({"max_steps": 0}, "STEP_CAP", 0), ({"max_steps": 1, "max_requests": 1}, "STEP_CAP", 1)):
        cut = farm.capped(whole, 12, **caps)
        r = cut.first()
        assert (r.steps, r.requests, r.n_lookups, r.answer, r.cite, r.tokens.total) == (turns, turns, turns, None, [], 12 * turns)
        assert sum(m.role == "assistant" for m in r.messages) == turns == sum(m.role == "tool" for m in r.messages)
        assert gate.verify(cut, tasks).first().reason_code == code


def test_url_manifest(spark):
    tasks = taskpool.url_manifest(spark, 20, "m").cache()
    n = {r[0]: r[1] for r in tasks.groupBy("prompt_variant").count().collect()}
    assert n["pick"] <= 12 and n["compose"] <= 4 and n["pick_hard"] <= 4 and sum(n.values()) >= 17
    assert {r.value for r in taskpool.manifest_summary(tasks).where("dimension = 'difficulty'").collect()} <= {"1", "2", "3"}
    seeds = spark.range(200).select(F.xxhash64("id").alias("seed")).withColumn("seed", F.abs("seed"))
    own = F.struct(*[F.lit(v).alias(k) for k, v in {"scheme": "https", "host": "docs.atlas.zz", "port": "", "path": "/guide/api", "query": "?id=2", "fragment": "#own"}.items()])
    near = [r[0] for r in seeds.select(taskpool.near_miss(own, F.col("seed"))).collect()]
    assert 50 <= sum(x.startswith("https://docs.atlas.zz/") for x in near) <= 110
    assert 30 <= sum("/guide/api" in x and x.endswith("#own") for x in near) <= 90
    rows = tasks.collect()
    for r in rows:
        texts = [e.text for e in r.evidence]
        assert (r.gold_url in texts) == (r.prompt_variant != "compose") and len(texts) == len(set(texts)) <= 4
        assert r.prompt_variant != "pick_hard" or r.difficulty in (1, 3)
    first = [[e.text for e in r.evidence].index(r.gold_url) for r in taskpool.url_tasks(spark, 60, "places").collect()]
    assert len(set(first)) >= 3  # the answer is not always first
    compose = taskpool.url_tasks(spark, 30, "c", "compose").collect()
    assert all("?" in r.gold_url and "ref=combined" not in r.gold_url and r.broken != r.gold_url for r in compose)
    halves = [taskpool.url_tasks(spark, 20, "m", shard=k, shards=2) for k in (0, 1)]
    assert {r.task_id for h in halves for r in h.collect()} == {r.task_id for r in taskpool.url_tasks(spark, 20, "m").collect()}


def test_damages_that_change_nothing_are_not_listed(spark):
    plain, kinds = "http://atlas.com/docs", ["drop_www", "drop_port", "drop_scheme", "reorder_query", "uppercase_host", "whitespace", "newlines", "drop_fragment"]
    got = spark.range(1).select(urls.landed(F.lit(plain), F.array(*map(F.lit, kinds))).alias("k"), urls.difficulty(F.array().cast("array<string>")).alias("d")).first()
    assert got.k == ["drop_scheme", "uppercase_host", "whitespace", "newlines"] and got.d == 1


def test_distractors_come_from_other_premises(spark):
    schema = "source_id long, premise string, hypothesis string, label string"
    short = spark.createDataFrame([(1, "A man sings, a dog barks", "a dog barks loudly", "entailed")], schema)
    donors = spark.createDataFrame([(2, "A man sings, a dog barks", "x", "not_entailed"), (3, "Rain falls, a dog barks far off", "y", "not_entailed"), (4, "It is, a dog barks loudly", "z", "entailed")], schema)
    assert [(r.source_id, r.premise) for r in taskpool.distractors(short, donors).collect()] == [(1, "A man sings, a dog barks a dog barks far off")]


def test_traps_are_dealt_in_turns(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: ", ".join(" ".join(rng.choices(words, k=4)) for _ in range(n))
    raw = [(i, p := text(rng.randint(2, 5)), p.split(", ")[0], rng.choice(["entailed", "not_entailed"]), i * 7 % 101) for i in range(60)]
    rows = spark.createDataFrame(raw, "source_id long, premise string, hypothesis string, label string, seed long")
    alike = {r.source_id for r in taskpool.distractors(rows.drop("seed"), rows.drop("seed")).collect()}
    expected, made = [], 0
    for i, premise, _, label, _ in sorted(raw, key=lambda r: (r[4], r[0])):
        units = len(premise.split(", "))
        if made < 9 and (label == "entailed", units <= 3, i in alike)[made % 3]:
            expected.append((i, taskpool.TRAPS[made % 3]))
            made += 1
    assert sorted(map(tuple, taskpool.deal_traps(rows, rows, 9).collect())) == sorted(expected) and made == 9
    tasks = taskpool.nli_manifest(rows.drop("seed"), "s", 15).groupBy("prompt_variant").count().collect()
    assert {r[0]: r[1] for r in tasks}["base"] == 9 and sum(r[1] for r in tasks) <= 15


def test_exact_percentiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.choice([None, rng.randint(-3, 9) / 4, rng.random() * 900])) for _ in range(700)] + [("c", 5.0), ("d", None)]
    got = {r.g: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}, 6).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g and x is not None]
        assert abs(got[g].p50 - float(np.percentile(v, 50))) < 1e-5 and abs(got[g].p95 - float(np.percentile(v, 95))) < 1e-5
    assert "d" not in got


def test_samples_of_unknown_tokens_stay(spark):
    vocab = spark.createDataFrame([("a", 3)], "token string, id int")
    samples = spark.createDataFrame([("x", [("a zzz a", True, "assistant", "prose")]), ("y", [("zzz", True, "assistant", "prose")])], "sample_id string, segments array<struct<text:string,trainable:boolean,role:string,kind:string>>")
    encoded = tokenizer.encode_segments(samples, vocab, "sample_id")
    assert {r.sample_id: (r.ids, r.mask) for r in encoded.collect()} == {"x": ([3, 3], [1, 1]), "y": ([], [])}
    assert [r.sample_id for r in tokenizer.trainable(encoded, 8).collect()] == ["x"]
    texts = spark.createDataFrame([(1, "a b a"), (2, None), (None, "a")], "k long, text string")
    assert sorted(map(str, map(tuple, tokenizer.encode(texts, vocab, "k").collect()))) == sorted(map(str, [(1, [3, 3]), (2, []), (None, [3])]))


def test_prompts_are_read_back(spark):
    for kind, subject in (("url", "htps://x.org"), ("legal", "The court held."), ("entailment", "It rains.")):
        m = spark.range(1).select(render.seed_messages(F.lit(kind), F.lit(subject), F.lit(7)).alias("m"))
        assert tuple(m.select(farm.hidden_items(F.col("m")), farm.asked_about(F.col("m"))).first()) == (7, subject)


def test_ties_of_damages_go_by_what_is_seen_first(spark):
    tasks = spark.createDataFrame([("t1", ["b", "a"]), ("t2", ["c", "a"]), ("t3", [])], "task_id string, corruptions array<string>")
    assert [tuple(r) for r in metrics.top_damages(tasks, 2).collect()] == [("a", 2), ("b", 1)]


def test_records(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text('{"id":"a","v":1}\n\n{"id":"b","v":2}\n{"id":"c", "v"')
    schema = "id string, v int"
    assert records.read_jsonl(spark, str(path), schema).count() == 2
    assert records.broken_lines(spark, str(path), schema).count() == 1
    assert records.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    batch = spark.createDataFrame([("a", 9, 0), ("d", 3, 1), ("d", 4, 2), (None, 5, 3)], "id string, v int, _pos int")
    fresh = records.new_rows(records.read_jsonl(spark, str(path), schema), batch)
    assert sorted((r.id or "", r.v) for r in fresh.collect()) == [("", 5), ("d", 3)]
    records.write_json(str(tmp_path / "c.json"), {"name": "x", "caps": {"max_steps": 3}})
    assert records.Config.load(str(tmp_path / "c.json")).caps.max_steps == 3
    records.write_json(str(tmp_path / "c.json"), {"nam": "x"})
    with pytest.raises(ValueError, match="nam"):
        records.Config.load(str(tmp_path / "c.json"))
    (tmp_path / "articles.json").write_text('{"articles": [{"title": "T", "url": "u", "facts": ["a", {"fact": "b"}]}, {"title": "E", "facts": []}]}')
    assert [r.facts for r in records.read_articles(spark, str(tmp_path / "articles.json")).collect()] == [["a", "b"]]


def test_read_through(spark, tmp_path):
    def fails(s):
        raise OSError("no")

    cache = str(tmp_path / "cache")
    with pytest.raises(RuntimeError, match="no source"):
        records.read_through(spark, cache, "v int", [fails])
    assert records.read_through(spark, cache, "v int", [fails, lambda s: s.createDataFrame([(1,)], "v int")]).count() == 1
    assert records.read_through(spark, cache, "v int", [fails]).count() == 1


def test_stream_takes_each_record_once(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()

    def step(name, lines):
        (source / name).write_text("\n".join(lines))
        ingest(record_stream(spark, str(source), "id string, v int", "id"), str(out), str(state)).awaitTermination()
        return spark.read.parquet(str(out)).count()

    assert step("1.jsonl", ['{"id":"a","v":1}', '{"id":"a","v":1}', '{"id":"b"']) == 1
    assert step("2.jsonl", ['{"id":"a","v":1}', '{"id":"c","v":1}']) == 2


def test_batches_of_many_rows_keep_every_row(spark):
    rows = spark.range(40_000).repartition(7).select((F.col("id") * 3).alias("id"), F.array_repeat(F.lit(1), (F.col("id") % 50).cast("int")).alias("ids"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables that fill their partitions
    try:
        made = tokenizer.batches(rows, "id", 16).select("id", "batch", "width").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) == 40_000
    assert all(r.batch == r.id // 48 for r in made)
    widths = {}
    for r in made:
        widths[r.batch] = max(widths.get(r.batch, 0), r.id // 3 % 50)
    assert all(r.width == widths[r.batch] for r in made)
    few = spark.createDataFrame([("b", [1]), (None, [1, 2]), ("a", []), ("b", [1])], "k string, ids array<int>")
    assert sorted((r.k or "", r.batch) for r in tokenizer.batches(few, "k", 2).collect()) == [("", 0), ("a", 0), ("b", 1), ("b", 1)]
    assert tokenizer.batches(few.limit(0), "k", 2).count() == 0


def test_articles_keep_facts_as_they_are(spark, tmp_path):
    long = ["x" * k + "\U0001f600" * 3000 + ' "é\\\n' for k in range(3)]
    looks = '{"fact": "inner"}'
    listed = [{"title": "A", "url": "u", "facts": [{"fact": x} for x in long] + [{"fact": looks}, looks, None, "", {"fact": ""}, {"fact": 5}]}, {"title": "B", "url": "u", "facts": None}]
    records.write_json(str(tmp_path / "a.json"), {"articles": listed})
    records.write_json(str(tmp_path / "b.json"), {"title": "C", "url": "u", "facts": ["only", "two"]})
    records.write_json(str(tmp_path / "c.json"), listed)
    made = sorted((r.title, r.facts) for r in records.read_articles(spark, str(tmp_path)).collect())
    assert made == [("A", [*long, looks, looks, "5"])] * 2 + [("C", ["only", "two"])]


@pytest.mark.parametrize("variant,digest", [("pick", "3b088974493aa5a7"), ("pick_hard", "3e36dd3f64859389"), ("compose", "a8086303e5a00cdb")])
def test_url_tasks_draw_damages_in_place(spark, variant, digest):
    """A damage that does not show is drawn again within the row, so tries are neither rows of their own nor shuffled."""
    tasks = taskpool.url_tasks(spark, 120, "fixed", variant)
    plan = tasks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    rows = sorted((r.source_id, r.task_id, r.broken, r.gold_url, tuple(r.corruptions), tuple(e.text for e in r.evidence)) for r in tasks.collect())
    assert hashlib.sha256(repr(rows).encode()).hexdigest()[:16] == digest


def test_seeds_are_halves_of_unsigned_numbers(spark):
    seeds = spark.range(300).select("id", hashing.stable_seed("x", F.col("id").cast("string")).alias("seed"))
    assert "decimal" not in seeds._jdf.queryExecution().analyzed().toString()
    assert all(r.seed == int(hashlib.sha256(f'["x",{r.id}]'.encode()).hexdigest()[:16], 16) >> 1 for r in seeds.collect())


def test_nli_manifest_reads_its_rows_once(spark):
    """The pool is stored: the steps after it hold no scan of the rows it was taken from."""
    said = F.concat(F.lit("the cat "), F.col("id").cast("string"), F.lit(" sat, the dog ran, the bird flew"))
    label = F.when(F.col("id") % 2 == 0, "entailment").otherwise("neutral")
    rows = spark.range(60).select(F.col("id").alias("source_id"), said.alias("premise"), F.lit("the dog ran").alias("hypothesis"), label.alias("label"))
    made = taskpool.nli_manifest(rows, "nli", 20)
    assert "Range (" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.origin for r in made.collect()} == {"base", "synth"}


def test_units_are_cut_once_a_text(spark, tmp_path):
    """However many uses and filters a plan has, a text is cut into units in one place of it."""
    spark.createDataFrame([(1, "en", "one, two; three"), (2, "en", None), (3, "de", "one")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    units = adapters.document_units(spark, str(tmp_path))
    used = units.where(F.size("units") >= 2).where(F.get("units", 0) != "").select("doc_id", F.element_at("units", -1).alias("last"), F.array_join("units", "|").alias("all"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    one = units.select("units")._jdf.queryExecution().optimizedPlan().toString().count("although")
    assert one > 0 and plan.count("although") == one
    assert [tuple(r) for r in used.collect()] == [(1, "three", "one,|two;|three")]
    assert [r.units for r in units.orderBy("doc_id").collect()] == [["one,", "two;", "three"], None, ["one"]]
