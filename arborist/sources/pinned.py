"""Inputs known by name and digest, and results that are kept under the digest of what they came from."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "preset:"


def digest(spark: SparkSession, path: str) -> str:
    """A SHA-1 over the SHA-1s of all files below the path, whatever their names: it changes with any byte.

    Files are hashed where they are read; a digest a file comes together.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/[._][^/]*$"))
    return files.select(F.sha1("content").alias("d")).agg(F.sha1(F.concat_ws("", F.sort_array(F.collect_list("d"))).cast("binary"))).first()[0]


def resolved(spark: SparkSession, spec: str, presets: dict[str, tuple[str, str | None]]) -> str:
    """The path of `preset:NAME`, or spec itself if it is a path. presets: the path and the digest of each name;
    another digest only warns, as a newer file may be meant."""
    if not spec.startswith(PREFIX):
        return spec
    name = spec.removeprefix(PREFIX)
    if name not in presets:
        raise ValueError(f"no preset {name!r}; there are {', '.join(sorted(presets))}")
    path, pin = presets[name]
    if pin is not None and (found := digest(spark, path)) != pin:
        warnings.warn(f"{spec} is pinned to {pin}, but {path} has {found}", stacklevel=2)
    return path


def remembered(spark: SparkSession, root: str, source: str, options: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, kept under root by the digest of source and the options, and read from there the next time.

    A table counts once it is whole: a mark beside it is written last.
    """
    path = f"{root}/{digest(spark, source)}-{options}"
    try:
        done = spark.read.parquet(f"{path}.done").count() == 1
    except AnalysisException:
        done = False
    if not done:
        make().write.mode("overwrite").parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.done")
    return spark.read.parquet(path)
