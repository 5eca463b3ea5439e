"""Where a session's written tables go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session without it gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arborist-shared-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that must not send it to the driver: Spark expects one element of an array and one row of
    an exploded one, so that it takes populations, points and their blocks for small and broadcasts them."""
    return df.hint("merge")


def dealt(df: DataFrame, *by: str, n: int = 0) -> DataFrame:
    """df over n tasks, or four for each core if those are more, by the values of by. What is counted of a file's rows is
    else held by the tasks that read it, one for a million rows."""
    return df.repartition(max(n, 4 * df.sparkSession.sparkContext.defaultParallelism), *by)


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once into the shared folder; the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
