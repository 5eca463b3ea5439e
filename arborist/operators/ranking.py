"""Exact ranks and percentiles of groups of any size.

A window over a group, or the percentile aggregate, holds a whole group in one task. Here equal values
are first counted, the distinct ones are laid out in ranges over all tasks, and what lies before a
row is the sum of the earlier ranges of its group plus a window within its own range. The only
window over a whole group has one row for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda done, c: done & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), by, F.lit(True))


def placed(rows: DataFrame, by: list[str], order: list[str], n: str) -> DataFrame:
    """rows with before, the sum of n over the rows of the group that come earlier, and total, over all.

    by and order together tell rows apart. Null groups are groups; nulls of order come first, and
    NaN last. The ranges are written once, so that counts and rows agree on them.
    """
    ranged = kept(rows.repartitionByRange(*map(F.col, by + order)).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__range").agg(F.sum(n).alias("__n"))
    group = Window.partitionBy(*by)
    sums = sums.withColumns({"__earlier": F.sum("__n").over(group.orderBy("__range")) - F.col("__n"), "total": F.sum("__n").over(group)})
    own = Window.partitionBy(*by, "__range").orderBy(*order)
    inside = ranged.withColumn("__inside", F.sum(n).over(own) - F.col(n))
    met = inside.alias("a").join(sums.alias("b"), _same("a", "b", [*by, "__range"]))
    return met.select("a.*", (F.col("__earlier") + F.col("__inside")).alias("before"), "b.total").drop("__range", "__inside")


def ordinal_ranks(rows: DataFrame, by: list[str], value: str, key: str, name: str) -> DataFrame:
    """rows with their place by value in the group, from 1, and the group's total; ties by key, which
    tells rows of a group apart."""
    out = placed(rows.withColumn("__one", F.lit(1)), by, [value, key], "__one")
    return out.withColumn(name, F.col("before") + 1).drop("before", "__one")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, value, n and rank: equal values share their mean rank, and are one row here."""
    out = placed(rows.groupBy(*by, value).agg(F.count("*").alias("n")), by, [value], "n")
    return out.withColumn(name, F.col("before") + (F.col("n") + 1) / 2).drop("before", "total")


def percentiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by with the named percentiles of the values that are not null, between neighbours in
    proportion; null for a group without any."""
    groups = rows.select(*by, F.col(value).alias("__v")).groupBy(*by, "__v").agg(F.count("__v").alias("__n"))
    laid = placed(groups, by, ["__v"], "__n")

    def of(share: float) -> Column:
        spot = share * (F.col("total") - 1)
        held = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("__n")), F.col("__v").cast("double")))
        low, high, part = held(F.floor(spot)), held(F.ceil(spot)), F.max(spot - F.floor(spot))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return laid.groupBy(*by).agg(*(of(share).alias(name) for name, share in at.items()))


def joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The rows of a with the columns that b, one row a group, has for them, or nulls; null groups meet."""
    rest = [F.col(f"b.{c}") for c in b.columns if c not in by]
    return a.alias("a").join(b.alias("b"), _same("a", "b", by), "left").select("a.*", *rest)
