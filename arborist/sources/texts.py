"""Records, requests, manifests, registries and reports as files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import trees as t

REQUEST = "expr string, variables array<string>, constants array<string>, init_constants array<double>, dataset string"


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("nt", T.IntegerType()), T.StructField("nv", T.FloatType()), T.StructField("ci", T.IntegerType())])))
def parsed(texts: pa.Array) -> pa.Array:
    """Prefix nodes of each expression, null where it isn't one. Each different text is parsed once."""
    kind = pa.list_(pa.struct([("nt", pa.int32()), ("nv", pa.float32()), ("ci", pa.int32())]))

    def nodes(text: str | None) -> list[dict] | None:
        try:
            return [{"nt": a, "nv": b, "ci": c} for a, b, c in t.prefix(t.parse(text or ""))]
        except ValueError:
            return None

    once = texts.dictionary_encode()
    values = pa.array([nodes(x) for x in once.dictionary.to_pylist()], kind)
    return values.take(once.indices)


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of a folder of JSON lines, with their trees; only the allowed grammar is read."""
    return spark.read.schema(REQUEST).json(path).withColumn("nodes", parsed("expr"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Complete records of JSON lines: a line that breaks off is left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each snapshot of each manifest of a folder, beside the manifest's own fields."""
    rows = spark.read.schema(schema).json(path)
    keep = [c for c in rows.columns if c != "snapshots"]
    return rows.select(*keep, F.inline("snapshots"))


def counters(line: Column, **patterns: str) -> list[Column]:
    """Numbers out of report lines, by a pattern with one group each."""
    return [F.regexp_extract(line, pattern, 1).cast("double").alias(name) for name, pattern in patterns.items()]


def resolved(registry: DataFrame) -> DataFrame:
    """Registry rows (id, path, base, sigma) with the path of a row or of its base; paths don't leave their folder."""
    base = registry.select(F.col("id").alias("base"), F.col("path").alias("base_path"))
    rows = registry.join(base, "base", "left").withColumn("path", F.coalesce("path", "base_path"))
    return rows.where(~F.col("path").contains("..") & ~F.col("path").startswith("/")).select("id", "path", "base", "sigma")


def upserted(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new rows in the place of old ones of the same id."""
    return registry.join(new.select("id"), "id", "left_anti").unionByName(new)
