"""Readers and writers of the records: JSON lines at the edges, Parquet inside."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from millrace import schemas

ID_COLUMNS = ("task_id", "run_id", "sample_id", "id")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors share: under spark.checkpoint.dir, or where it is unset, as in
    tests, under the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there: made once, however many plans use them, and small
    plans instead of one large one."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines (files, folders or patterns); blank and broken lines are left out, a missing path is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that read_jsonl leaves out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    return lines.select("value", parsed.alias("r")).where("r._corrupt_record is not null").select("value")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def new_rows(stored: DataFrame, batch: DataFrame, key: str | None = None, order: str = "_pos") -> DataFrame:
    """Rows of the batch whose id is neither stored nor earlier in the batch; rows without an id always count.

    ``order`` numbers the batch's rows. Without a key the first of the usual id columns that a row has is its id.
    """
    names = [c for c in ([key] if key else []) + list(ID_COLUMNS) if c in batch.columns]
    ident = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names]) if names else F.lit(None).cast("string")
    known = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names if c in stored.columns]) if names else F.lit(None).cast("string")
    named = batch.withColumn("_id", ident)
    w = Window.partitionBy("_id").orderBy(order)
    fresh = named.where("_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kept = fresh.join(stored.select(known.alias("_id")).where("_id is not null").distinct(), "_id", "left_anti")
    return kept.unionByName(named.where("_id is null")).drop("_id")


def append_unique(spark: SparkSession, path: str, batch: DataFrame, schema: str, key: str | None = None, order: str = "_pos") -> None:
    new_rows(read_jsonl(spark, path, schema), batch, key, order).drop(order).write.mode("append").json(path)


def write_json(path: str, value) -> None:
    """A small JSON file at the driver: written beside its place, then renamed."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=2)
    os.replace(f"{path}.tmp", path)


def read_json(path: str, default=None):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return default


def read_through(spark: SparkSession, cache: str, schema: str, loaders: list) -> DataFrame:
    """Rows kept at ``cache``; if there are none, those of the first loader that works, which are kept there."""
    kept = read_jsonl(spark, cache, schema)
    if not kept.isEmpty():
        return kept
    failures = []
    for load in loaders:
        try:
            load(spark).write.mode("overwrite").json(cache)
            return read_jsonl(spark, cache, schema)
        except (OSError, AnalysisException) as e:
            failures.append(f"{type(e).__name__}: {str(e)[:200]}")
    raise RuntimeError(f"no source of rows worked: {'; '.join(failures)}")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_articles(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """article_id, title, url, facts of a JSON file with ``articles``, a list, or one of each in a folder.

    Facts are strings or objects with ``fact``; blank facts and articles without facts are left out, unless ``blank``.
    """
    from millrace.functions.hashing import canonical_json, content_id

    # a fact keeps its JSON type: as text, an object is read anew from its place in the file, and a string may look like one
    raw = spark.read.option("multiLine", True).schema("articles array<struct<title:string,url:string,facts:array<variant>>>, title string, url string, facts array<variant>").json(path)
    own = F.when(F.col("facts").isNotNull(), F.array(F.struct("title", "url", "facts")))
    rows = raw.select(F.explode(F.concat(*[F.coalesce(x, F.array()) for x in (F.col("articles"), own)])).alias("a")).select("a.*")
    fact = lambda x: F.coalesce(F.try_variant_get(x, "$.fact", "string"), F.try_variant_get(x, "$", "string"))
    facts = F.transform("facts", fact)
    clean = rows.withColumn("facts", facts) if blank else rows.withColumn("facts", F.filter(facts, lambda x: x != "")).where(F.size("facts") > 0)
    return clean.withColumn("article_id", content_id(canonical_json(title=F.col("title"), n=F.size("facts")))).select("article_id", "title", "url", "facts")


def iter_tasks(tasks: DataFrame, split: str | None = None) -> DataFrame:
    """Tasks of a split; ``all`` and None mean every one."""
    return tasks if split in (None, "all") else tasks.where(F.col("split") == split)


def write_manifest(tasks: DataFrame, path: str) -> None:
    """A folder of Parquet for each split, in order of task_id over its files; as many tasks write as rows need."""
    tasks.repartitionByRange("split", "task_id").sortWithinPartitions("split", "task_id").write.mode("overwrite").partitionBy("split").parquet(path)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/shard-*.jsonl", schemas.RUN)


def host_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("host")).where("host <> ''")


@dataclass(frozen=True)
class Caps:
    max_steps: int = 8
    max_requests: int = 8
    max_tokens: int = 20_000
    max_usd: float = 0.0


@dataclass(frozen=True)
class WindowOptions:
    keep_last: int = 3
    head: int = 80
    keep_chars: int = 1200


@dataclass(frozen=True)
class Config:
    """Settings of a project; unknown keys are refused."""

    name: str = "default"
    root: str = "."
    n_tasks: int = 120
    eval_pct: int = 20
    split_salt: str = "split"
    seed_salt: str = "seed"
    synth_fraction: float = 0.4
    samples_per_task: int = 1
    variants: tuple[str, ...] = ()
    caps: Caps = field(default_factory=Caps)
    window: WindowOptions = field(default_factory=WindowOptions)

    @classmethod
    def load(cls, path: str) -> Config:
        def made(kind, values: dict):
            names = {f.name for f in fields(kind)}
            if extra := set(values) - names:
                raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
            return kind(**values)

        values = dict(read_json(path, {}))
        for key, kind in (("caps", Caps), ("window", WindowOptions)):
            if key in values:
                values[key] = made(kind, values[key])
        return made(cls, values)
