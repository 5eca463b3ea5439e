"""Small helpers the operators of this package share."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words where a contract says [^\x20\x09-\x0D]+.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_az(column: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone by the faster function."""
    plain = F.length(column) == F.octet_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, string.ascii_uppercase, string.ascii_lowercase))


def hex64(column: Column) -> Column:
    """A 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arborist-checkpoints-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, computed once and written as Parquet in the shared folder: columns are read
    apart, and Spark knows the size before it plans a join."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, for rows that hold texts: what a task's Python holds at once stays small.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows; smaller ones stay as they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def running(rows: DataFrame, order: list[Column], values: dict[str, Column], within: str | None = None) -> DataFrame:
    """rows with, under each name of values, the sum of its column over the rows before in that order.

    order tells any two rows apart; within starts the sums anew in each group, nulls being one.
    Rows are cut by ranges of the order, so neither a group nor the table is ever one task: the
    sums inside a range start at those of the ranges before, a row for each range and group.
    """
    group = [within] if within else []
    keys = {f"__key{i}": c for i, c in enumerate(order)}
    cut = saved(rows.withColumns(keys).repartitionByRange(*group, *keys).withColumn("__range", F.spark_partition_id()))
    sums = cut.groupBy("__range", *group).agg(*(F.sum(c).alias(f"__sum_{k}") for k, c in values.items()))
    before = Window.partitionBy(*group).orderBy("__range")
    starts = sums.select(
        F.col("__range").alias("__r"),
        *(F.col(g).alias("__g") for g in group),
        *((F.sum(f"__sum_{k}").over(before) - F.col(f"__sum_{k}")).alias(f"__start_{k}") for k in values),
    )
    inside = Window.partitionBy("__range", *group).orderBy(*keys)
    placed = cut.withColumns({f"__in_{k}": F.sum(c).over(inside) - c for k, c in values.items()})
    same = F.col("__range") == F.col("__r")
    met = placed.join(starts, same & F.col(within).eqNullSafe(F.col("__g")) if within else same)
    return met.select(*rows.columns, *((F.col(f"__start_{k}") + F.col(f"__in_{k}")).alias(k) for k in values))
