"""Queries over the driver's tables by name, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import claims, text, urls
from millrace.functions.hashing import content_id, split_of, stable_seed
from millrace.operators import dataset, gate, ledger, metrics, render, taskpool, tokenizer, training, windowing
from millrace.plans import adapters
from millrace.plans.adapters import table
from millrace.sources.records import new_rows, scratch, stored  # noqa: F401  parts takes scratch from here
from millrace.streaming.ingest import hourly_accounts, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(*words: str) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z'']+'))"


def _content(x: str) -> str:
    drop = _words(*text.STOP_WORDS, *text.NEGATION_MARKERS, *text.FRAME_WORDS)
    return f"list_filter({_word_set(x)}, lambda w: length(w) > 2 AND NOT list_contains({drop}, w))"


def _negated(x: str) -> str:
    return f"list_has_any({_word_set(x)}, {_words(*text.NEGATION_MARKERS)})"


def _lower_first(x: str) -> str:
    return f"lower(substr({x}, 1, 1)) || substr({x}, 2)"


def _seed(json: str) -> str:
    return f"(('0x' || substr(sha256({json}), 1, 16))::UBIGINT >> 1)::BIGINT"


def _split(x: str) -> str:
    return f"CASE WHEN ('0x' || substr(sha256({x} || '|split'), 1, 8))::BIGINT % 100 < 20 THEN 'eval' ELSE 'train' END"


_BREAK = r"(?i)\s+(?:and|but|while|although|though|because|so|which|who)\s+"
_UNITS = rf"""units AS (
  SELECT doc_id, lang, text, CASE WHEN len(p) = 0 THEN [{_strip('text')}] WHEN len(p) > 4 THEN list_concat(p[1:3], p[len(p):len(p)]) ELSE p END AS units FROM (
    SELECT doc_id, lang, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace({_strip('text')}, '([,;:])\s+', '\1¦', 'g'), '{_BREAK}', '¦', 'g'), '¦'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents))"""

_TASKS = f"""{_UNITS}, said AS (
  SELECT doc_id, units, doc_id % 2 = 0 AS even, CASE WHEN doc_id % 2 = 0 THEN 'entailed' ELSE 'not_entailed' END AS label, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'premise_negation' END AS prompt_variant,
    (CASE WHEN doc_id % 2 = 0 THEN units[1] ELSE 'It is not the case that ' || {_lower_first('units[len(units)]')} END) || (CASE WHEN doc_id % 29 <> 0 THEN '' WHEN doc_id % 2 = 0 THEN ' entailed' ELSE ' not entailed' END) AS hypothesis
  FROM units WHERE len(units) >= 2
), named AS (
  SELECT *, 'sha256:' || sha256(CAST(to_json({{'evidence': list_transform(units, lambda u, i: {{'evidence_id': 'e' || (i - 1)::VARCHAR, 'index': i - 1, 'text': u}}), 'hypothesis': hypothesis, 'prompt_variant': prompt_variant}}) AS VARCHAR)) AS task_id FROM said
), tasks AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY doc_id) = 1)"""

_GUESS = f"list_filter({{0}}, lambda w: NOT list_contains({_words(*text.GUESS_STOP_WORDS)}, w))"
_VERDICTS = f"""{_TASKS}, runs AS (
  SELECT *, task_id || ':0' AS run_id, least(len(units), 3) AS target, array_to_string(units[1:3], ' ') AS seen FROM tasks
), seeded AS (
  SELECT *, {_seed("'[\"fault\",\"' || run_id || '\"]'")} % 100 AS b, {_seed("'[\"guess\",\"' || run_id || '\"]'")} % 1000 AS g,
    {_GUESS.format(_word_set('hypothesis'))} AS h, {_GUESS.format(_word_set('seen'))} AS d, {_content('hypothesis')} AS ch, {_content('seen')} AS cs FROM runs
), guessed AS (
  SELECT *, CASE WHEN len(h) = 0 THEN 0.0 ELSE len(list_intersect(h, d)) / len(h) END AS cover, len(list_intersect(ch, cs)) AS shared FROM seeded
), answered AS (
  SELECT *, CASE WHEN cover >= 0.8 THEN 'entailed' WHEN cover < 0.35 THEN 'not_entailed' WHEN g / 1000.0 < cover - 0.35 THEN 'entailed' ELSE 'not_entailed' END AS guess FROM guessed
), final AS (
  SELECT *, CASE WHEN b BETWEEN 13 AND 17 THEN NULL WHEN b BETWEEN 33 AND 40 THEN (CASE WHEN guess = 'entailed' THEN 'not_entailed' ELSE 'entailed' END) ELSE guess END AS predicted FROM answered
), verdicts AS (
  SELECT run_id, task_id, label AS gold, prompt_variant AS variant, predicted, (target + 1)::BIGINT AS steps, (12 * target + 20)::BIGINT AS tokens, CASE
    WHEN b <= 4 THEN 'TEACHER_ERROR' WHEN b <= 8 THEN 'STEP_CAP' WHEN b <= 12 THEN 'REQUEST_CAP' WHEN b <= 17 THEN 'FORMAT_INVALID' WHEN b <= 22 THEN 'NO_TOOL_CALL'
    WHEN doc_id % 29 = 0 THEN 'LABEL_LEAK' WHEN doc_id % 31 = 0 THEN 'DUPLICATE_ACROSS_SPLIT' WHEN b BETWEEN 23 AND 27 THEN 'UNSUPPORTED_ANSWER'
    WHEN predicted = 'entailed' AND shared >= 2 AND shared / least(len(ch), len(cs)) >= 0.6 AND {_negated('hypothesis')} <> {_negated('seen')} THEN 'UNSUPPORTED_ANSWER'
    WHEN b BETWEEN 28 AND 32 THEN 'TRIVIAL_OUTPUT' WHEN predicted <> label THEN 'TEST_FAIL' ELSE 'VERIFIED_OK' END AS reason_code
  FROM final)"""


def runs_and_tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks = stored(adapters.tasks(spark, d), "tasks")
    return stored(adapters.runs(tasks), "runs"), tasks


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return gate.verify(*runs_and_tasks(spark, d))


@query(f"""WITH {_VERDICTS}, codes AS (SELECT unnest({_words(*gate.REASONS)}) AS reason_code, unnest(range({len(gate.REASONS)})) AS pos)
SELECT c.pos::BIGINT AS pos, c.reason_code, count(v.run_id) AS n, round(count(v.run_id) / (SELECT count(*) FROM verdicts), 4) AS share FROM codes c LEFT JOIN verdicts v USING (reason_code) GROUP BY ALL""")
def reason_histogram(spark, d):
    return gate.histogram(_verdicts(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_VERDICTS} SELECT run_id, task_id, reason_code, predicted, gold, variant, steps, tokens FROM verdicts")
def gate_verdicts(spark, d):
    return _verdicts(spark, d).select("run_id", "task_id", "reason_code", "predicted", "gold", "variant", F.col("steps").cast("long").alias("steps"), "tokens")


@query(f"WITH {_VERDICTS} SELECT variant, {', '.join(f'''count(*) FILTER (reason_code = '{c}') AS "{c}"''' for c in gate.REASONS)} FROM verdicts GROUP BY variant")
def reason_by_variant(spark, d):
    return gate.by_variant(_verdicts(spark, d))


@query(f"""WITH {_VERDICTS}, t AS (SELECT count(*) AS total, count(*) FILTER (reason_code = 'VERIFIED_OK') AS verified, count(*) FILTER (predicted = gold) AS label_check_would_accept,
  count(*) FILTER (predicted = gold AND reason_code IN ('LABEL_LEAK', 'UNSUPPORTED_ANSWER', 'TRIVIAL_OUTPUT')) AS rejected_despite_correct_label FROM verdicts)
SELECT *, round(verified / total, 4) AS verify_rate, round(rejected_despite_correct_label / label_check_would_accept, 4) AS reward_hack_rate FROM t""")
def hack_rate(spark, d):
    return gate.hack_rate(_verdicts(spark, d))


@query(f"WITH {_TASKS} SELECT task_id, doc_id, unnest(CASE WHEN doc_id % 31 = 0 THEN ['train', 'eval'] ELSE [{_split('task_id')}] END) AS split, label, prompt_variant, hypothesis, len(units)::BIGINT AS n_units FROM tasks")
def task_manifest(spark, d):
    return adapters.tasks(spark, d).select("task_id", "doc_id", "split", "label", "prompt_variant", "hypothesis", F.col("n_units").cast("long").alias("n_units"))


@query(f"WITH {_TASKS} SELECT task_id FROM tasks WHERE doc_id % 31 = 0")
def split_overlap(spark, d):
    return taskpool.split_overlap(adapters.tasks(spark, d))


@query(f"""WITH {_TASKS}, rows AS (SELECT *, CASE WHEN doc_id % 31 = 0 THEN ['train', 'eval'] ELSE [{_split('task_id')}] END AS splits FROM tasks), flat AS (SELECT prompt_variant, label, unnest(splits) AS split FROM rows)
SELECT 'split' AS dimension, split AS value, count(*) AS n FROM flat GROUP BY ALL UNION ALL SELECT 'prompt_variant', prompt_variant, count(*) FROM flat GROUP BY ALL
UNION ALL SELECT 'origin', 'base', count(*) FROM flat UNION ALL SELECT 'label', label, count(*) FROM flat GROUP BY ALL""")
def manifest_summary(spark, d):
    return taskpool.manifest_summary(adapters.tasks(spark, d))


@query(f"WITH {_TASKS} SELECT task_id FROM tasks WHERE doc_id % 31 = 0")
def cross_split_duplicates(spark, d):
    return adapters.tasks(spark, d).groupBy("task_id").agg(F.countDistinct("split").alias("n")).where("n > 1").select("task_id")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_id FROM documents")
def content_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", content_id(F.col("text")).alias("content_id"))


@query(f"SELECT lang, split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT lang, n_chars, {_split('text')} AS split FROM documents) GROUP BY ALL")
def hash_split(spark, d):
    docs = table(spark, d, "documents").withColumn("split", split_of(F.col("text"), "split"))
    return docs.groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""SELECT doc_id, {_seed("'[\"order\",' || doc_id || ']'")} AS seed FROM documents ORDER BY seed LIMIT 100""")
def stable_seed_order(spark, d):
    return table(spark, d, "documents").select("doc_id", stable_seed("order", F.col("doc_id").cast("string")).alias("seed")).orderBy("seed").limit(100)


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_by_content(spark, d):
    named = table(spark, d, "documents").select("doc_id", content_id(F.col("text")).alias("content_id"))
    return named.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {_UNITS} SELECT doc_id, len(units)::BIGINT AS n_units, array_to_string(units, '|') AS units FROM units")
def split_units(spark, d):
    return adapters.document_units(spark, d).select("doc_id", F.size("units").cast("long").alias("n_units"), F.array_join("units", "|").alias("units"))


@query(f"SELECT doc_id, len({_word_set('text')})::BIGINT AS n_words, len({_content('text')})::BIGINT AS n_content, {_negated('text')} AS negated FROM documents")
def word_sets(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(text.word_set(t)).cast("long").alias("n_words"), F.size(text.content_words(t)).cast("long").alias("n_content"), text.has_negation(t).alias("negated"))


_TURNS = "SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'lookup(1) lookup( -2 )' || chr(10) || 'CITE: [0], 2; x' || chr(10) || 'answer: Entailed.' WHEN 2 THEN 'ANSWER: entailed' || chr(10) || 'CITE: 1' || chr(10) || 'ANSWER: not_entailed ' WHEN 3 THEN 'CITE:' || chr(10) || 'ANSWER: perhaps' ELSE '  ' END AS t FROM conversations"
_ANSWER = r"regexp_extract_all(t, '(?im)^\s*ANSWER\s*:\s*(.+?)\s*$', 1)[-1]"
_CITE = r"regexp_extract_all(t, '(?im)^\s*CITE\s*:\s*(.+?)\s*$', 1)[-1]"


@query(rf"""WITH turns AS ({_TURNS}), raw AS (SELECT *, {_strip('t')} = '' AS blank, {_ANSWER} AS a, {_CITE} AS c, regexp_extract_all(t, '\blookup\s*\(\s*(-?\d+)\s*\)', 1) AS l FROM turns),
cut AS (SELECT *, lower(regexp_replace({_strip('a')}, '^\.+|\.+$', '', 'g')) AS answer, list_filter(list_transform(string_split(replace(c, ';', ','), ','), lambda x: regexp_replace({_strip('x')}, '^[\[\]()]+|[\[\]()]+$', '', 'g')), lambda x: regexp_full_match(x, '[0-9]+')) AS cite FROM raw)
SELECT conv_id, turn, array_to_string(l, ',') AS lookups, coalesce(array_to_string(cite, ','), '') AS cite, answer, CASE WHEN blank THEN 'empty_assistant_turn' WHEN a IS NULL THEN 'missing_ANSWER_line' WHEN answer NOT IN ('entailed', 'not_entailed') THEN 'unknown_label:' || answer WHEN c IS NULL THEN 'missing_CITE_line' WHEN len(cite) = 0 THEN 'empty_CITE' END AS error FROM cut""")
def parse_turns(spark, d):
    k, nl = F.col("conv_id") % 5, F.lit("\n")
    made = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("\nlookup(1) lookup( -2 )\nCITE: [0], 2; x\nanswer: Entailed."))).when(k == 2, F.lit("ANSWER: entailed\nCITE: 1\nANSWER: not_entailed ")).when(k == 3, F.concat(F.lit("CITE:"), nl, F.lit("ANSWER: perhaps"))).otherwise("  ")
    p = table(spark, d, "conversations").select("conv_id", "turn", text.parse_turn(made).alias("p"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return p.select("conv_id", "turn", joined("p.lookups").alias("lookups"), joined("p.cite").alias("cite"), "p.answer", "p.error")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant' AND text <> '') AS last_text, arg_min(text, turn) FILTER (role = 'assistant') AS first_text FROM conversations GROUP BY conv_id")
def edge_turns(spark, d):
    assistant = F.col("role") == "assistant"
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", F.when(assistant & (F.col("text") != ""), F.col("turn"))).alias("last_text"), F.min_by("text", F.when(assistant, F.col("turn"))).alias("first_text"))


_MESSAGES = "m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"""WITH {_MESSAGES}, w AS (SELECT *, role = 'tool' AND pos <= n - 3 AND length(content) > 120 AS old FROM m)
SELECT conv_id, count(*) AS n, count(*) FILTER (old) AS n_windowed, sum(CASE WHEN old THEN length(CAST(to_json({{'chars': length(content), 'digest': 'tool_result', 'head': substr(content, 1, 40), 'index': turn}}) AS VARCHAR)) ELSE length(content) END)::BIGINT AS chars FROM w GROUP BY conv_id""")
def window_digest(spark, d):
    c = adapters.conversations(spark, d).withColumn("m", windowing.windowed(F.col("messages"), head=40))
    return c.select("conv_id", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda x: F.coalesce(x["windowed"], F.lit(False)))).cast("long").alias("n_windowed"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("chars"))


@query(f"""WITH {_MESSAGES}, t AS (SELECT *, pos > 2 AS tail, sum(CASE WHEN pos > 2 THEN length(content) + 24 END) OVER (PARTITION BY conv_id ORDER BY pos DESC) AS used FROM m)
SELECT conv_id, count(*) AS n_kept, sum(length(content))::BIGINT AS chars FROM t WHERE n <= 2 OR pos <= 2 OR pos = n OR used <= 400 GROUP BY conv_id""")
def window_naive(spark, d):
    c = adapters.conversations(spark, d).withColumn("m", windowing.naive_truncated(F.col("messages"), 400))
    return c.select("conv_id", F.size("m").cast("long").alias("n_kept"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("chars"))


@query(f"""WITH {_MESSAGES}, t AS (SELECT conv_id, pos, role, CASE WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) || content || '<|im_end|>' || chr(10) ELSE '<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10) END AS r FROM m), j AS (SELECT conv_id, string_agg(r, '' ORDER BY pos) AS rendered FROM t GROUP BY conv_id)
SELECT conv_id, length(rendered)::BIGINT AS chars, 'sha256:' || sha256(CAST(to_json(rendered) AS VARCHAR)) AS prompt_hash FROM j""")
def render_conversations(spark, d):
    c = adapters.conversations(spark, d)
    return c.select("conv_id", F.length(render.render(F.col("messages"))).cast("long").alias("chars"), render.prompt_hash(F.col("messages")).alias("prompt_hash"))


@query(r"""WITH l AS (SELECT text, unnest(list_filter(string_split(regexp_replace(text, chr(10), chr(10) || '¦', 'g'), '¦'), lambda x: x <> '')) AS line FROM conversations WHERE role = 'assistant'), k AS (SELECT CASE WHEN regexp_matches(line, '(?i)\blookup\s*\(') THEN 'tool_call' WHEN regexp_matches(line, '(?i)^\s*(CITE|ANSWER)\s*:') THEN 'answer' ELSE 'prose' END AS kind, length(line) AS c FROM l)
SELECT kind, count(*) AS n, sum(c)::BIGINT AS chars FROM k GROUP BY kind""")
def segment_kinds(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant' and text <> ''").select(F.explode(render.assistant_segments(F.col("text"))).alias("s"))
    return rows.groupBy("s.kind").agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("chars"))


@query(f"""WITH {_VERDICTS}, ok AS (SELECT * FROM final JOIN (SELECT run_id FROM verdicts WHERE reason_code = 'VERIFIED_OK') USING (run_id))
SELECT {_split('task_id')} AS split, w AS windowing, count(*) AS n, round(avg(target + 1), 2) AS avg_n_steps, max(target + 1)::BIGINT AS max_steps, count(*) FILTER (prompt_variant = 'base') AS base, count(*) FILTER (prompt_variant = 'premise_negation') AS premise_negation FROM ok, (SELECT unnest(['full_context', 'windowed', 'naive_truncated']) AS w) GROUP BY ALL""")
def sample_stats(spark, d):
    runs, tasks = runs_and_tasks(spark, d)
    samples = dataset.build(gate.verify(runs, tasks), runs, tasks, windowed={"head": 40}, naive_truncated={"keep_chars": 400})
    of = lambda v: F.coalesce(F.col("by_variant")[v], F.lit(0)).alias(v)
    return dataset.stats(samples).select("split", "windowing", "n", "avg_n_steps", F.col("max_steps").cast("long").alias("max_steps"), of("base"), of("premise_negation"))


@query(f"""WITH n AS (SELECT conv_id, count(*) AS n_steps FROM conversations GROUP BY conv_id)
SELECT conv_id, n_steps FROM n QUALIFY row_number() OVER (ORDER BY n_steps, conv_id) <= greatest(1, round_even(0.4 * (SELECT count(*) FROM n), 0))""")
def curriculum_stage_one(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_steps")).withColumn("sample_id", F.col("conv_id"))
    return dataset.stage_one(n, 0.4).select("conv_id", "n_steps")


@query(f"""WITH {_UNITS}, f AS (SELECT doc_id, units[1] AS fact, units[len(units)] AS other FROM units)
SELECT doc_id, 'It is not the case that ' || {_lower_first('fact')} AS negation, 'Indian courts have held that ' || {_lower_first('fact')} AS scope_overreach, fact || ' In addition, ' || {_lower_first('other')} AS conjunction, fact || ' It is not the case that ' || {_lower_first('other')} AS broken_conjunction FROM f""")
def claim_transforms(spark, d):
    fact, other = F.get("units", 0), F.element_at("units", -1)
    return adapters.document_units(spark, d).select("doc_id", claims.negation(fact).alias("negation"), claims.scope_overreach(fact).alias("scope_overreach"), claims.conjunction(fact, other).alias("conjunction"), claims.broken_conjunction(fact, other).alias("broken_conjunction"))


@query(r"""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'It held that the Trial Court erred as the appellant said.' WHEN 1 THEN 'Costs of Rs. 20,000 were paid in 1998.' WHEN 2 THEN 'It began in 2004, or 1998.' WHEN 3 THEN 'After two years the bench rose.' WHEN 4 THEN 'Nothing of note.' ELSE 'Justice was done to the vendor.' END AS fact FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'It held that the High Court erred as the appellant said.' WHEN 1 THEN 'Costs of Rs. 45,000 were paid in 1998.' WHEN 2 THEN 'It began in 2011, or 1998.' WHEN 3 THEN replace(fact, 'the bench', 'the respondent''s counsel') WHEN 4 THEN 'It is not the case that nothing of note.' ELSE 'Justice was done to the purchaser.' END AS claim, CASE doc_id % 6 WHEN 4 THEN 'negation' ELSE 'entity_swap' END AS applied FROM f""")
def entity_swap(spark, d):
    facts = ("It held that the Trial Court erred as the appellant said.", "Costs of Rs. 20,000 were paid in 1998.", "It began in 2004, or 1998.", "After two years the bench rose.", "Nothing of note.", "Justice was done to the vendor.")
    fact = F.get(F.array(*map(F.lit, facts)), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", claims.entity_swap(fact).alias("s")).select("doc_id", "s.claim", "s.applied")


_CLAIM = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[a-z]+')), lambda w: length(w) > 2 AND NOT list_contains({_words(*text.CLAIM_STOP_WORDS)}, w))"


@query(f"""WITH {_UNITS}, c AS (SELECT doc_id, units, unnest(units) AS f, units[1] AS fact FROM units), s AS (SELECT *, {_CLAIM.format('fact')} AS w, {_CLAIM.format('f')} AS v FROM c),
o AS (SELECT doc_id, units, fact, list(f ORDER BY CASE WHEN len(w) = 0 THEN 0 ELSE -len(list_intersect(w, v)) / len(w) END, f) AS o FROM s GROUP BY doc_id, units, fact),
r AS (SELECT *, list_concat(CASE WHEN len(o) % 2 = 0 AND len(o) > 1 THEN list_concat(o[2:3], o[1:1]) ELSE o[1:3] END, o[4:]) AS ranked FROM o)
SELECT doc_id, array_to_string(ranked, '|') AS ranked, list_position(ranked, fact)::BIGINT - 1 AS gold_position FROM r""")
def rank_evidence(spark, d):
    r = adapters.document_units(spark, d).select("doc_id", F.get("units", 0).alias("fact"), claims.rank_facts(F.col("units"), F.get("units", 0)).alias("ranked"))
    return r.select("doc_id", F.array_join("ranked", "|").alias("ranked"), (F.array_position("ranked", F.col("fact")) - 1).alias("gold_position"))


@query(f"""WITH {_UNITS}, f AS (SELECT doc_id::VARCHAR AS article_id, unnest(range(len(units))) AS i FROM units WHERE len(units) >= 4),
s AS (SELECT *, {_seed("'[\"s\",\"' || article_id || '\",' || i || ',\"pos\"]'")} % 1000 < 500 AS holds FROM f)
SELECT CASE WHEN holds THEN (['identity', 'restate', 'conjunction'])[(i % 3) + 1] ELSE (['negation', 'entity_swap', 'scope_overreach', 'broken_conjunction'])[(i % 4) + 1] END AS variant, count(*) AS n FROM s GROUP BY ALL""")
def schedule_balance(spark, d):
    articles = adapters.document_units(spark, d).select(F.col("doc_id").cast("string").alias("article_id"), F.col("units").alias("facts"))
    return taskpool.claim_schedule(articles, "s").groupBy("variant").agg(F.count("*").alias("n"))


@query()
def url_tasks(spark, d):
    return taskpool.url_manifest(spark, table(spark, d, "pages").count(), "url")


@query(f"""WITH q AS (SELECT item_id AS q_id, {_word_set('text')} AS a FROM benchmark), {_UNITS}, dn AS (SELECT doc_id AS d_id, {_word_set('units[1]')} AS b FROM units), p AS (SELECT q_id, d_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM q, dn)
SELECT q_id, d_id, round(score, 6) AS score FROM p WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) = 1""")
def best_distractor(spark, d):
    donors = adapters.document_units(spark, d).select(F.col("doc_id").alias("d_id"), F.get("units", 0).alias("d_text"))
    best = taskpool.best_match(table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q_text")), donors)
    return best.select("q_id", "d_id", F.round("score", 6).alias("score"))


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_NORMAL = rf"""n AS (SELECT page_id, url, lower(regexp_extract(url, '{_URL}', 1)) || '://' || lower(regexp_extract(url, '{_URL}', 2)) || CASE WHEN regexp_extract(url, '{_URL}', 3) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '{_URL}', 3), '/+', '/', 'g') END AS location,
  array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(url, '{_URL}', 4), 2), '&'), lambda x: x <> '')), '&') AS query, regexp_extract(url, '{_URL}', 5) AS fragment FROM pages), u AS (SELECT *, location || CASE WHEN query = '' THEN '' ELSE '?' || query END || fragment AS normal FROM n)"""


@query(f"WITH {_NORMAL} SELECT page_id, location, query, normal AS normalized FROM u")
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.location_of(u).alias("location"), urls.query_of(u).alias("query"), urls.normalize(u).alias("normalized"))


@query(f"""WITH {_NORMAL} SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS drop_scheme, replace(url, '&', '&amp;') AS double_encode, replace(replace(url, '/', '&#x2F;'), '?', '&quest;') AS html_entities, split_part(url, '#', 1) AS drop_fragment,
  CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) ELSE split_part(url, '#', 1) END AS truncate_tail, CASE WHEN starts_with(url, 'https://') THEN 'htps://' || substr(url, 9) ELSE regexp_replace(url, '^http://', 'https:/') END AS http_typo,
  regexp_replace(url, '://www\\.', '://') AS drop_www, regexp_replace(url, '^([^#?]*)(\\?[^#]*)(#.*)$', '\\1\\3\\2') AS fragment_moved FROM u""")
def url_damages(spark, d):
    names = ("drop_scheme", "double_encode", "html_entities", "drop_fragment", "truncate_tail", "http_typo", "drop_www", "fragment_moved")
    return table(spark, d, "pages").select("page_id", *[urls.CORRUPTIONS[n][0](F.col("url"), F.col("page_id")).alias(n) for n in names])


@query(f"""WITH {_NORMAL} SELECT page_id, true AS scheme_case_folds, true AS echo_of_encoded, CASE WHEN contains(url, '#') THEN false ELSE true END AS fragment_kept, CASE page_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'location_not_cited' WHEN 2 THEN 'nothing_cited' ELSE 'no_answer' END AS why FROM u""")
def url_support(spark, d):
    u, k = F.col("url"), F.col("page_id") % 4
    cited = F.when(k == 2, F.array().cast("array<string>")).when(k == 1, F.array(F.concat(urls.location_of(u), F.lit("/x")))).otherwise(F.array(u))
    loud = F.concat(F.upper(F.substring_index(u, ":", 1)), F.lit(":"), F.regexp_replace(u, "^[a-z]+:", ""))
    return table(spark, d, "pages").select(
        "page_id",
        urls.is_correct(loud, u).alias("scheme_case_folds"),
        urls.is_correct(F.concat(F.lit("<"), u, F.lit(">")), u).alias("echo_of_encoded"),
        urls.is_correct(F.substring_index(u, "#", 1), u).alias("fragment_kept"),
        urls.support(F.when(k != 3, u), cited, F.lit("pick")).alias("why"),
    )


@query()
def corruption_top(spark, d):
    """The twelve most frequent damages of the URL tasks, one for each page."""
    return metrics.top_damages(taskpool.url_tasks(spark, table(spark, d, "pages").count(), "top"))


_LEDGER = "ledger AS (SELECT 'run' || (user_id % 50) AS run_id, floor(abs(value) * 10)::BIGINT AS prompt_tokens, event_id % 100 AS completion_tokens, floor(abs(value) * 10)::BIGINT + event_id % 100 AS tokens, floor(abs(value) * 1000) / 1000000 AS cost_usd, floor(abs(value) * 100) / 1000 AS latency_s, event_type = 'error' AS bad, user_id % 50 % 3 = 0 AS good FROM events)"


@query(f"""WITH {_LEDGER} SELECT count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(tokens)::BIGINT AS tokens, round(sum(cost_usd::DECIMAL(28,8))::DOUBLE, 4) AS cost_usd, round(sum(latency_s::DECIMAL(28,8))::DOUBLE, 1) AS latency_s, count(*) FILTER (bad) AS errors, round(count(*) FILTER (bad) / count(*), 4) AS error_rate, round((sum(latency_s::DECIMAL(28,8)) FILTER (NOT bad))::DOUBLE / count(*) FILTER (NOT bad), 2) AS mean_latency_s FROM ledger""")
def ledger_summary(spark, d):
    return ledger.summary(adapters.ledger(spark, d))


@query(f"""WITH {_LEDGER}, v AS (SELECT count(DISTINCT run_id) FILTER (good) AS verified_trajectories, sum(tokens) AS total, count(*) FILTER (NOT bad) AS ok, coalesce(sum(tokens) FILTER (NOT bad AND NOT good), 0) AS wasted FROM ledger)
SELECT verified_trajectories, round((total / verified_trajectories)::DOUBLE, 1) AS tokens_per_verified, round((ok / verified_trajectories)::DOUBLE, 2) AS requests_per_verified, wasted::BIGINT AS tokens_wasted_on_rejected, round((wasted / total)::DOUBLE, 4) AS waste_share FROM v""")
def ledger_efficiency(spark, d):
    return ledger.efficiency(adapters.ledger(spark, d), adapters.ledger_verdicts(spark, d))


@query(f"WITH {_LEDGER} SELECT run_id, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM ledger GROUP BY run_id")
def ledger_by_run(spark, d):
    g = ledger.by_run(adapters.ledger(spark, d))
    pages = g.select("run_id", F.size("requests").alias("n"), F.aggregate("requests", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))
    return pages.groupBy("run_id").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


_RESULTS = "results AS (SELECT (['teacher', 'student', 'student_no_curriculum', 'heuristic'])[event_id % 4 + 1] AS contender, CASE WHEN event_type <> 'error' THEN event_type END AS variant, event_id % 4 <> 0 AS local, event_id % 7 < 3 AS passed, event_id % 7 < 4 AS label_correct, event_id % 5 < 4 AS called, event_id % 5 < 3 AS retrieved, CASE WHEN event_id % 7 < 3 THEN 'VERIFIED_OK' WHEN event_id % 2 = 0 THEN 'TEST_FAIL' ELSE 'FORMAT_INVALID' END AS reason_code, event_id % 6 + 1 AS steps, event_id % 1000 AS tokens, floor(abs(value) * 100) / 1000 AS latency_s, floor(abs(value) * 1000) / 1000000 AS cost_usd FROM events)"
_SUMMARY = "summary AS (SELECT contender, count(*) AS n, round(avg(passed::INT), 4) AS pass_at_1, round(avg(label_correct::INT), 4) AS label_accuracy, round(avg(called::INT), 4) AS valid_tool_call_rate, round(avg(retrieved::INT), 4) AS retrieval_success_rate, round(avg(steps), 2) AS mean_steps, round(avg(tokens), 1) AS mean_tokens, round(quantile_cont(latency_s, 0.5), 3) AS latency_p50_s, round(quantile_cont(latency_s, 0.95), 3) AS latency_p95_s, round(sum(cost_usd::DECIMAL(28,8))::DOUBLE, 4) AS api_cost_usd, round(coalesce((sum(latency_s::DECIMAL(28,8)) FILTER (local))::DOUBLE, 0), 2) AS compute_seconds, round(sum(cost_usd::DECIMAL(28,8))::DOUBLE / count(*) FILTER (passed), 6) AS cost_per_resolved_task_usd FROM results GROUP BY contender)"


@query(f"WITH {_RESULTS}, {_SUMMARY} SELECT * FROM summary")
def contender_summary(spark, d):
    return metrics.summarize(adapters.results(spark, d))


@query(f"WITH {_RESULTS}, {_SUMMARY} SELECT CASE contender WHEN 'teacher' THEN 0 WHEN 'student' THEN 1 WHEN 'student_no_curriculum' THEN 2 ELSE 3 END::BIGINT AS pos, contender, n, pass_at_1, valid_tool_call_rate, cost_per_resolved_task_usd, latency_p50_s, latency_p95_s, mean_steps FROM summary")
def frontier(spark, d):
    return metrics.frontier(metrics.summarize(adapters.results(spark, d))).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_RESULTS} SELECT contender, coalesce(variant, '?') AS variant, count(*) AS n, round(avg(passed::INT), 4) AS pass_at_1 FROM results GROUP BY ALL")
def pass_by_variant(spark, d):
    return metrics.by_variant(adapters.results(spark, d))


@query(f"WITH {_RESULTS} SELECT contender, reason_code, count(*) AS n FROM results GROUP BY ALL")
def rejection_counts(spark, d):
    return metrics.rejections(adapters.results(spark, d))


@query(f"WITH {_RESULTS}, {_SUMMARY} SELECT a.pass_at_1 AS pass_at_1_a, a.valid_tool_call_rate AS valid_tool_call_rate_a, b.pass_at_1 AS pass_at_1_b, b.valid_tool_call_rate AS valid_tool_call_rate_b, round(a.pass_at_1 - b.pass_at_1, 4) AS pass_gain FROM summary a, summary b WHERE a.contender = 'student' AND b.contender = 'student_no_curriculum'")
def ablation(spark, d):
    return metrics.ablation(metrics.summarize(adapters.results(spark, d)))


_TOKEN = r"<\|[^|<>]*\|>|\n|[A-Za-z]+(?:''[A-Za-z]+)?|\d+|[^\sA-Za-z\d]"
_VOCAB = f"vocab AS (SELECT token, id FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM documents) WHERE token NOT IN ('<|pad|>', '<|im_start|>', '<|im_end|>') GROUP BY token)) WHERE id < 2000 UNION ALL SELECT * FROM (VALUES ('<|pad|>', 0), ('<|im_start|>', 1), ('<|im_end|>', 2)))"


@query(f"WITH {_VOCAB} SELECT token, id::BIGINT AS id FROM vocab")
def vocabulary(spark, d):
    return tokenizer.build(table(spark, d, "documents"), max_vocab=2000).withColumn("id", F.col("id").cast("long"))


@query(f"""WITH {_VOCAB}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM documents)
SELECT d.doc_id, count(v.id) AS n_ids, coalesce(sum(v.id), 0)::BIGINT AS id_sum FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN vocab v USING (token) GROUP BY d.doc_id""")
def encode_documents(spark, d):
    docs = table(spark, d, "documents")
    e = tokenizer.encode(docs, tokenizer.build(docs, max_vocab=2000), "doc_id")
    return e.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query(f"""WITH {_VOCAB}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM documents), e AS (SELECT d.doc_id, count(v.id) AS n FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN vocab v USING (token) GROUP BY d.doc_id), b AS (SELECT doc_id, n, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM e)
SELECT doc_id, batch, max(n) OVER (PARTITION BY batch) AS width FROM b""")
def batch_pad(spark, d):
    docs = table(spark, d, "documents")
    encoded = stored(tokenizer.encode(docs, tokenizer.build(docs, max_vocab=2000), "doc_id"), "encoded")  # read three times
    b = tokenizer.batches(encoded, "doc_id", 16)
    ids, _ = tokenizer.padded(F.col("ids"), F.transform("ids", lambda x: F.lit(1)), F.col("width"))
    return b.select("doc_id", "batch", F.size(ids).cast("long").alias("width"))


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.001 * (event_id + 1) / 100 ELSE 0.001 * (0.1 + 0.45 * (1 + cos(pi() * least(greatest((event_id - 100) / 4900.0, 0), 1)))) END, 9) AS lr FROM events")
def lr_schedule(spark, d):
    return table(spark, d, "events").select("event_id", F.round(training.learning_rate(F.col("event_id"), 5000, 100, 0.001), 9).alias("lr"))


@query("SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_new_rows(spark, d):
    stored = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("id"))
    batch = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("_pos"))
    return new_rows(stored, batch, "id").select(F.col("id").cast("long").alias("id"), "v")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_returned(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_finished(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    df = table(spark, d, "lineitem")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return df.groupingSets([[f, s], [f], []], f, s).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value::DECIMAL(28,8)), 4)::DOUBLE AS value FROM events GROUP BY 1")
def hourly_events(spark, d):
    return hourly_accounts(table(spark, d, "events"))


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_seen(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT DISTINCT event_id, event_type, user_id FROM events")
def stream_ingest(spark, d):
    """A stream of the events, ids once, written until nothing is left and read back."""
    folder = scratch(spark, "ingest")
    source = table(spark, d, "events")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ingest(rows.select("event_id", "event_type", "user_id").dropDuplicates(["event_id"]), f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema("event_id long, event_type string, user_id long").parquet(f"{folder}/rows")
