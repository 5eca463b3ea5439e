"""Queries of whole searches: harvested snapshots, requests from them, and a study of four arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evolution, studies, workload
from ..sources.shared import kept, new_path
from . import population as p
from . import trees as t
from .registry import query

_SIZE = 8


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random trees for every supplier."""
    ids = p.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("problem_id")).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(_SIZE - 1))))
    made = ids.select((F.col("problem_id") * _SIZE + F.col("place")).alias("tree_id"), "problem_id").repartition(workload.tasks(spark), "problem_id")  # one file would be one task
    made = made.withColumn("g", workload.generated_trees(F.col("tree_id"), "early-gen", 17))
    return kept(made.select("tree_id", "problem_id", "g.nodes", F.col("g.c_init").alias("c")))


def _points(spark: SparkSession, sf_dir: str, held_out: bool | None = None) -> DataFrame:
    """The line items of each supplier; those of some orders are held out for tests."""
    items = p.read(spark, sf_dir, "lineitem")
    if held_out is not None:
        items = items.where((F.xxhash64("l_orderkey") % 4 == 0) == held_out)  # a split of the data: both sides are used
    x = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return items.select(F.col("l_suppkey").alias("problem_id"), x.alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))


@query(f"SELECT CAST(gen AS INTEGER) AS gen, CAST({_SIZE} * count(*) AS BIGINT) AS m, TRUE AS never_worse, TRUE AS in_bounds FROM supplier, (VALUES (0), (1), (2)) g(gen) GROUP BY gen")
def g06_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations for every supplier, broken off after the first and gone on with: the best of no problem gets
    worse from snapshot to snapshot, and no tree outgrows the bound."""
    how = evolution.Search(size=_SIZE, max_nodes=24, max_iter=5)
    population, points = _population(spark, sf_dir), kept(_points(spark, sf_dir).repartition("problem_id"))
    path = new_path(spark, "harvest")
    evolution.harvest(spark, path, population, points, 1, how, kept)
    manifests = evolution.harvest(spark, path, population, points, 2, how, kept)
    best = evolution.snapshots(spark, path).groupBy("problem_id", "gen").agg(F.max("fit").alias("fit"))
    before = best.select("problem_id", F.when(F.col("gen") == 0, 1).otherwise(F.col("gen") * 2).alias("gen"), F.col("fit").alias("was"))
    worse = best.join(before, ["problem_id", "gen"], "left").groupBy("gen").agg(F.count_if(F.col("fit") < F.col("was") * (1 + 1e-9)).alias("worse"))  # sums are added up in another order
    return manifests.join(worse, "gen").select("gen", "m", (F.col("worse") == 0).alias("never_worse"), (F.col("max_nodes") <= F.lit(32)).alias("in_bounds"))


@query()
def s11_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three fittest different trees of each supplier and snapshot, as requests to fit them."""
    how = evolution.Search(size=_SIZE, max_iter=5)
    path = new_path(spark, "harvest")
    evolution.harvest(spark, path, _population(spark, sf_dir), kept(_points(spark, sf_dir).repartition("problem_id")), 1, how, kept)
    found = evolution.requests(evolution.snapshots(spark, path), 3)
    return found.select("gen", "problem_id", "rank", "expr", t.constant_count(F.col("nodes")).alias("k"))


@query(f"""SELECT arm, CAST(count(*) AS BIGINT) AS n, CAST(1 AS INTEGER) AS gens, CAST({_SIZE * 2} AS INTEGER) AS evals, arm LIKE 'every%' AS refined, TRUE AS finite
FROM supplier, (VALUES ('no_co'), ('sparse'), ('every_differences'), ('every')) a(arm) GROUP BY arm""")
def g07_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation of every supplier's search under four arms, scored on orders that were held out."""
    how = evolution.Search(size=_SIZE, max_iter=5)
    train, test = (kept(_points(spark, sf_dir, side).repartition("problem_id")) for side in (False, True))
    rows = kept(evolution.study(spark, new_path(spark, "study"), _population(spark, sf_dir), train, test, 1, how, kept))
    block = studies.arm_block(rows.withColumns({"r2": F.col("r2_test"), "wall": F.col("wall_s")}), "arm")
    more = rows.groupBy("arm").agg(F.max("gens").alias("gens"), F.max("evals").alias("evals"), (F.sum("co_fits") > 0).alias("refined"))
    return block.join(more, "arm").select("arm", "n", "gens", "evals", "refined", (F.col("median_clamped") >= 0).alias("finite"))
