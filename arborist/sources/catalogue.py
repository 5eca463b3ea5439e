"""Catalogues of formulas as text files: problems with their trees, true constants and ranges, and the
data sets sampled from them."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ops import is_finite
from ..operators.scoring import evaluated
from ..operators.search import unit
from ..plans import trees as t

_NODES = T.ArrayType(T.StructType([T.StructField("nt", T.IntegerType()), T.StructField("nv", T.FloatType()), T.StructField("ci", T.IntegerType())]))


@F.arrow_udf(T.StructType([T.StructField("nodes", _NODES), T.StructField("c", T.ArrayType(T.DoubleType()))]))
def lifted(texts: pa.Array, constants: pa.Array) -> pa.Array:
    """Nodes and constants of each expression, its numbers among the constants; null where it isn't one."""
    kind = pa.struct([("nodes", pa.list_(pa.struct([("nt", pa.int32()), ("nv", pa.float32()), ("ci", pa.int32())]))), ("c", pa.list_(pa.float64()))])
    out = []
    for text, c in zip(texts.to_pylist(), constants.to_pylist()):
        try:
            nodes, values = t.lifted(text or "", c or [])
            out.append({"nodes": [dict(zip(("nt", "nv", "ci"), n)) for n in nodes], "c": values})
        except (ValueError, IndexError):
            out.append(None)
    return pa.array(out, kind)


def _numbers(list_text: Column) -> Column:
    """The numbers in a text like "[1.0, 2.0]"."""
    return F.transform(F.regexp_extract_all(list_text, F.lit(r"([-+.\deE]+)"), 1), lambda v: v.try_cast("double"))


def problems(spark: SparkSession, path: str) -> DataFrame:
    """id, expr, nodes, c (the true constants), ranges (low and high of each variable), n_samples and
    physical of the entries of catalogue files: lists of `key: value` lines that begin with `- id:`.

    Entries whose expression isn't in the grammar, or that lack a constant, have null nodes. The files
    may be many; one is as long as its formulas.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.regexp_replace(F.replace("value", F.lit("\r")), r"\n {4,}", " ")  # values that were broken over lines
    entries = whole.select(F.explode(F.slice(F.split(F.concat(F.lit("\n"), lines), r"\n *- id: *"), 2, 1 << 30)).alias("entry"))
    value = lambda key: F.regexp_extract("entry", rf"\n *{key}: *([^\n]*)", 1)
    rows = entries.select(
        F.trim(F.regexp_extract("entry", r"^([^\n]*)", 1)).alias("id"),
        F.trim(value("skeleton_expr")).alias("expr"),
        _numbers(value("ground_truth_constants")).alias("known"),
        F.transform(F.regexp_extract_all("entry", F.lit(r"\n *- *(\[[^\]\n]*\])"), 1), _numbers).alias("ranges"),
        value("n_samples").try_cast("int").alias("n_samples"),
        value("physical_vars").alias("physical"),
    )
    rows = rows.withColumn("tree", lifted("expr", "known"))
    return rows.select("id", "expr", F.col("tree.nodes").alias("nodes"), F.col("tree.c").alias("c"), "ranges", "n_samples", "physical")


def seed_of(id_: Column) -> Column:
    """A seed that follows from an id: the first eight hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(id_, 256), 1, 8), 16, 10).cast("long")


def materialised(rows: DataFrame) -> DataFrame:
    """problem_id, i, x, y of each problem: n_samples points drawn uniformly from its ranges, and its own
    values there. Points whose value isn't finite are kept with a null y, for `usable` to report."""
    spots = rows.select(F.col("id").alias("problem_id"), "ranges", F.explode(F.sequence(F.lit(1), F.col("n_samples"))).alias("i"))
    draw = lambda r, k: r[0] + (r[1] - r[0]) * unit(0, seed_of(F.col("problem_id")), "i", k)
    spots = spots.select("problem_id", "i", F.transform("ranges", draw).alias("x"))
    law = rows.where("nodes is not null").select(F.col("id").alias("tree_id"), F.col("id").alias("problem_id"), "nodes", "c")
    values = evaluated(law, spots.select("problem_id", "i", "x", F.col("x").alias("__at"), F.lit(0.0).alias("y")))
    return values.select("problem_id", "i", F.col("__at").alias("x"), F.when(is_finite(F.col("yh")), F.col("yh")).alias("y"))


def usable(points: DataFrame) -> DataFrame:
    """problem_id, n and n_bad of materialised problems; one with a bad point isn't to be used."""
    return points.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("n_bad"))


def written(entries: DataFrame) -> DataFrame:
    """value, the text of each entry (id, expr, known, ranges, n_samples) in the catalogue's form."""
    numbers = lambda c: F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda v: v.cast("string"))), F.lit("]"))
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat(F.lit("\n  - "), numbers(r))), "")
    lines = {"skeleton_expr": F.col("expr"), "ground_truth_constants": numbers(F.col("known")), "sampling_ranges": ranges, "n_samples": F.col("n_samples").cast("string")}
    body = reduce(lambda done, one: F.concat(done, F.lit(f"\n  {one[0]}: "), one[1]), lines.items(), F.concat(F.lit("- id: "), F.col("id")))
    return entries.select(body.alias("value"))
