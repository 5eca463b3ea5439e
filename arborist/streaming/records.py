"""A stream of record files kept as one row for each key, the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import new_path


def latest_by_key(spark: SparkSession, path: str, schema: StructType, key: list[str], order: str) -> DataFrame:
    """Stream all files at a path, one a batch, and return the latest record of each key.

    A batch merges into a new version of the table named by the batch's number, so one that runs
    again after a failure writes the same version again.
    """
    out, checkpoint = new_path(spark, "stream-out"), new_path(spark, "stream-checkpoint")
    rest = [f.name for f in schema.fields if f.name not in key]
    written: list[int] = []

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch
        if number > 0:
            rows = session.read.schema(schema).parquet(f"{out}/version={number - 1}").unionByName(batch)
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*key, "last.*")
        last.select(*schema.names).write.mode("overwrite").parquet(f"{out}/version={number}")
        written.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/version={max(written)}")
