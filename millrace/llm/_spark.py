"""Session helpers of the operators: the shared folder, and tables in it that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; texts are long, so a batch is kept small and operators regroup rows by size.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset, one is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        local = sc.master.startswith("local")
        own = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(own or ("/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there: what made them is not run again, whichever
    executors are lost, and the planner knows their size."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_folder = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Removes tables that ``cut`` wrote, or folders, which nothing will read any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_shared_folder", None)
        spark = SparkSession.getActiveSession()
        if path and spark:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of text that one shuffle partition has at most, where an operator says how many there are.
PARTITION_BYTES = 128 << 20


def partitions(spark: SparkSession, size: int) -> int:
    """As many shuffle partitions as the session sets, or more for a corpus of so many bytes that they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of an id column, for a schema."""
    return docs.schema[column].dataType.simpleString()


def held_out(n: int, remainder: int = 2, column: str = "doc_id") -> Column:
    """Whether the crc32 of an id as text has this remainder by n; a null id has none."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)) == remainder, F.lit(False))
