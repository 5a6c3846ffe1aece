"""A word tokenizer whose vocabulary is a table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# Special tokens, the token pattern, and the signs that stand without a space before or after.
SPECIALS = ("<|pad|>", "<|im_start|>", "<|im_end|>")
PATTERN = r"<\|[^|<>]*\|>|\n|[A-Za-z]+(?:'[A-Za-z]+)?|\d+|[^\sA-Za-z\d]"
NO_SPACE_BEFORE, NO_SPACE_AFTER = ")]}(,.:;!?_\n", "([{_\n"
IGNORED = -100
# Ranges of batches: how many there are at most, and of how many keys their bounds are drawn.
MOST_RANGES, SAMPLED_KEYS = 512, 10_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def build(texts: DataFrame, text: str = "text", max_vocab: int = 8000, min_count: int = 1) -> DataFrame:
    """token, id: specials first, then the most frequent tokens, ties by token (at most max_vocab in all)."""
    counts = texts.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & ~F.col("token").isin(*SPECIALS))
    kept = counts.orderBy(F.desc("n"), "token").limit(max(0, max_vocab - len(SPECIALS)))  # bounded: the rank below is of these alone
    ranked = kept.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + len(SPECIALS) - 1).alias("id"))
    return texts.sparkSession.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, id int").unionByName(ranked)


def encode(texts: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ids of every row: tokens that the vocabulary does not have are left out, a null text has no ids.

    Narrow: texts stay where they are and are cut in Arrow batches; the vocabulary, at most max_vocab rows, goes along.
    """
    ids = {r.token: r.id for r in vocab.collect()}
    pattern = re.compile(PATTERN, re.ASCII)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[ids[t] for t in pattern.findall(x or "") if t in ids] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], [key, "ids"])

    return texts.select(key, text).mapInArrow(run, StructType([texts.schema[key], StructField("ids", ArrayType(IntegerType()))]))


def trainable(encoded: DataFrame, context: int) -> DataFrame:
    """Encoded rows cut to the context, without those of fewer than two tokens: they predict nothing."""
    cut = encoded.withColumns({c: truncated(F.col(c), context) for c in ("ids", "mask") if c in encoded.columns})
    return cut.where(F.size("ids") > 1)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Writes the tokens as JSON lines in the order of their ids."""
    vocab.select("id", "token").coalesce(1).sortWithinPartitions("id").write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, token string").json(path).select("token", "id")


def encode_segments(samples: DataFrame, vocab: DataFrame, key: str, segments: str = "segments", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """key, ids, mask: mask is 1 on tokens that are trained on (of the given kinds)."""
    wanted = F.col("s.trainable") if kinds is None else F.col("s.trainable") & F.col("s.kind").isin(*kinds)
    spread = samples.select(key, F.posexplode(segments).alias("part", "s")).select(key, "part", wanted.cast("int").alias("mask"), F.posexplode(tokens(F.col("s.text"))).alias("pos", "token")).join(F.broadcast(vocab), "token")
    rows = F.array_sort(F.collect_list(F.struct("part", "pos", "id", "mask")))
    found = spread.groupBy(key).agg(rows.alias("r")).select(key, F.transform("r", lambda x: x["id"]).alias("ids"), F.transform("r", lambda x: x["mask"]).alias("mask"))
    none = F.array().cast("array<int>")  # a sample of unknown tokens only
    return samples.select(key).join(found, key, "left").select(key, F.coalesce("ids", none).alias("ids"), F.coalesce("mask", none).alias("mask"))


def decode(words: Column) -> Column:
    """The text of tokens in order, with spaces where prose has them."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("last"))

    def step(a: Column, t: Column) -> Column:
        glued = a["last"].isNull() | t.isin(*NO_SPACE_BEFORE) | a["last"].isin(*NO_SPACE_AFTER)
        return F.struct(F.concat(a["out"], F.when(glued, "").otherwise(" "), t).alias("out"), t.alias("last"))

    return F.aggregate(words, start, step)["out"]


def truncated(ids: Column, context: int) -> Column:
    return F.slice(ids, 1, context)


def padded(ids: Column, mask: Column, width: Column) -> tuple[Column, Column]:
    """Ids and labels of the batch's width; labels that are not trained on are -100."""
    pad = F.greatest(width - F.size(ids), F.lit(0))
    labels = F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(IGNORED))
    return F.concat(ids, F.array_repeat(F.lit(0), pad)), F.concat(labels, F.array_repeat(F.lit(IGNORED), pad))


def batches(encoded: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with batch and width, the longest of the batch. Batches follow each other by a rank within ranges of the
    order column, so no task sees all rows: only a sample of the column and the count of each range go to the driver.

    The ranges are cut at the keys of smallest hash and are then fixed values, so whoever computes a row's range, in
    whichever job, gets the same one. Shuffles by range draw their bounds anew each time.
    """
    kind, spark = encoded.schema[order].dataType, encoded.sparkSession
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    drawn = encoded.select(order).where(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order), order).limit(SAMPLED_KEYS)
    keys = [r[0] for r in drawn.orderBy(order).collect()]
    bounds = [F.lit(keys[i * len(keys) // ranges]).cast(kind) for i in range(1, ranges)] if keys else []
    place = F.size(F.filter(F.array(*bounds), lambda b: F.coalesce(b <= F.col(order), F.lit(False)))) if bounds else F.lit(0)
    placed = encoded.withColumn("part", place)
    counts, base, before = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect()), [], 0
    for p, n in counts:
        base.append((p, before))
        before += n
    bases = spark.createDataFrame(base, "part int, base long")
    kept = placed.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    numbered = kept.join(F.broadcast(bases), "part").withColumn("batch", F.floor((F.col("base") + F.col("n") - 1) / size)).drop("part", "base", "n")
    return numbered.withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("batch")))
