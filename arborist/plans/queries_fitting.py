"""Queries that fit constants. Trees that are linear in theirs have an exact answer in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import is_finite
from ..operators import fitting, scoring, search, workload
from ..sources.shared import kept
from . import population as p
from . import trees as t
from .registry import query

_OLS = "WITH " + p.TREES_SQL


@query(_OLS + """SELECT tree_id, CAST(0 AS INTEGER) AS status, round(regr_intercept(y, x0), 4) AS c0, round(regr_slope(y, x0), 4) AS c1, round(0.5 * regr_syy(y, x0) * (1 - regr_r2(y, x0)), 2) AS loss
FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id""")
def l05_l08_linear_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse-mode Levenberg-Marquardt on the linear shape must end at least squares."""
    fits = fitting.fit(p.trees(spark, sf_dir).where("shape = 0"), p.points(spark, sf_dir), 30, kept)
    c = F.col("c_final")
    return fits.select("tree_id", "status", F.round(c[0], 4).alias("c0"), F.round(c[1], 4).alias("c1"), F.round("loss_final", 2).alias("loss"))


@query(_OLS + """SELECT tree_id, CAST(CASE WHEN k = 0 THEN 3 ELSE 0 END AS INTEGER) AS status, k FROM trees WHERE shape IN (0, 7)""")
def f01_k0_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    population = p.trees(spark, sf_dir).where("shape in (0, 7)")
    fits = fitting.fit(population, p.points(spark, sf_dir), 30, kept)
    return population.join(fits, "tree_id").select("tree_id", "status", F.size("c").alias("k"))


@query()
def l01_l22_population_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shapes of all suppliers fitted; no tree ends above its start."""
    fits = fitting.fit(p.trees(spark, sf_dir), p.points(spark, sf_dir), save=kept)
    worse = F.coalesce(F.col("loss_final") > F.col("loss_init"), F.lit(False))
    return fits.select("tree_id", "status", "n_iter", F.round("loss_init", 3).alias("loss_init"), F.round("loss_final", 3).alias("loss_final"), worse.alias("worse"))


@query()
def t12_a02_l01_generated_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random tree of each preset for every supplier, scored and fitted: as many structures as trees, nearly."""
    suppliers = p.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("problem_id"))
    made = [suppliers.select((F.col("problem_id") * 3 + i).alias("tree_id"), "problem_id", F.lit(name).alias("preset"), workload.generated(F.col("problem_id"), name, 3).alias("nodes")) for i, name in enumerate(workload.PRESETS)]
    rows = made[0].unionByName(made[1]).unionByName(made[2])
    ranks = F.filter("nodes", lambda n: n["nt"] == t.CONST)
    start = F.transform(ranks, lambda n: F.lit(0.25) + F.pmod(F.xxhash64("tree_id", n["ci"]), F.lit(16)) / F.lit(8.0))
    rows = kept(rows.withColumn("c", start))
    points = p.points(spark, sf_dir)
    loss = scoring.losses(rows, points)
    fits = fitting.fit(rows, points, 50, kept)
    worse = F.coalesce(F.col("loss_final") > F.col("loss_init"), F.lit(False))
    met = rows.select("tree_id", "preset", F.size("c").alias("k")).join(fits, "tree_id").join(loss.select("tree_id", "loss"), "tree_id")
    return met.select("tree_id", "preset", "k", "status", "n_iter", F.round("loss", 3).alias("loss"), F.round("loss_init", 3).alias("loss_init"), F.round("loss_final", 3).alias("loss_final"), worse.alias("worse"))


@query(_OLS + """SELECT tree_id, CAST(4 AS BIGINT) AS trials, round(0.5 * regr_syy(y, x0) * (1 - regr_r2(y, x0)), 2) AS loss FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id""")
def l21_a38_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four starts for each linear tree, fitted in one batch; the best of them is least squares too."""
    trials = fitting.starts(p.trees(spark, sf_dir).where("shape = 0"), 4, 0.3, 1)
    trials = trials.withColumn("tree", F.col("tree_id")).withColumn("tree_id", F.col("tree_id") * 4 + F.col("trial"))
    fits = fitting.fit(trials, p.points(spark, sf_dir), 30, kept).join(trials.select("tree_id", "tree", "trial"), "tree_id")
    best = fitting.best_of(fits.drop("tree_id").withColumnRenamed("tree", "tree_id"))
    n = fits.groupBy(F.col("tree").alias("tree_id")).agg(F.count("*").alias("trials"))
    return best.join(n, "tree_id").select("tree_id", "trials", F.round("loss_final", 2).alias("loss"))


@query("""SELECT l_suppkey AS problem_id, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY 1""")
def m01_single_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return p.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("problem_id")).agg(
        F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2")
    )


@query(_OLS + f""", e AS (SELECT tree_id, shape, {p.EVALUATED_SQL} AS yh, 2 * ({p.EVALUATED_SQL}) AS twice, ({p.EVALUATED_SQL}) + 3 AS moved FROM trees JOIN points USING (problem_id) WHERE shape IN (0, 1, 4))
SELECT shape, CAST(count(DISTINCT tree_id) AS BIGINT) AS n, CAST(count(DISTINCT tree_id) AS BIGINT) AS scale_ok, CAST(count(DISTINCT tree_id) AS BIGINT) AS offset_ok FROM e GROUP BY shape""")
def y08_numeric_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law found up to a factor or an offset counts as recovered."""
    rows = scoring.evaluated(p.trees(spark, sf_dir).where("shape in (0, 1, 4)"), p.points(spark, sf_dir))
    rows = rows.select("tree_id", "shape", F.col("yh").alias("truth"), (F.col("yh") * 2).alias("twice"), (F.col("yh") + 3).alias("moved"))
    a = search.recovered(rows, ["tree_id", "shape"], "truth", "twice").select("tree_id", "shape", "scale_ok")
    b = search.recovered(rows, ["tree_id", "shape"], "truth", "moved").select("tree_id", "offset_ok")
    return a.join(b, "tree_id").groupBy("shape").agg(F.count("*").alias("n"), F.count_if("scale_ok").alias("scale_ok"), F.count_if("offset_ok").alias("offset_ok"))


@query(_OLS + """SELECT shape, CASE shape WHEN 0 THEN '(c0 + (c1 * x0))' WHEN 1 THEN '(c0 * (x0 ^ c1))' WHEN 2 THEN '(c0 + ((c1 * x0) + (c2 * (x0 * x0))))' WHEN 3 THEN '((c0 * exp(neg((c1 * x0)))) + c2)'
  WHEN 4 THEN '(c0 / (x0 + c1))' WHEN 5 THEN '((c0 * sin((c1 * x1))) + c2)' WHEN 6 THEN '((c0 * log((x1 + x2))) + c1)' ELSE '(x0 + x1)' END AS infix,
  CAST(CASE shape WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS INTEGER) AS inner_, CAST(count(*) AS BIGINT) AS n FROM trees GROUP BY ALL""")
def t07_y03_read_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infix texts and inner constants of all trees."""
    rows = p.trees(spark, sf_dir).groupBy("shape", "nodes").agg(F.count("*").alias("n")).withColumn("out", search.read_out("nodes"))
    return rows.groupBy("shape", F.col("out.infix").alias("infix"), F.col("out.inner").alias("inner_")).agg(F.sum("n").alias("n"))


@query(_OLS + """SELECT CASE WHEN k = 0 THEN 'skip' WHEN n_nodes > 10 THEN 'fallback' ELSE 'kernel' END AS route, CAST(count(*) AS BIGINT) AS n FROM trees GROUP BY 1""")
def f03_f08_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees by the engine that may fit them."""
    k, n = F.size("c"), F.size("nodes")
    return p.trees(spark, sf_dir).groupBy(F.when(k == 0, "skip").when(n > 10, "fallback").otherwise("kernel").alias("route")).agg(F.count("*").alias("n"))


@query()
def n03_n05_noisy_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with noise relative to their spread: the measured ratio is near the one asked for."""
    items = p.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("problem_id"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10000).alias("y"))
    rows = search.noisy(items.withColumn("clean", F.col("y")), ["problem_id"], "y", 0.05, 7, ["problem_id", "l_orderkey", "l_linenumber"])
    ratio = F.stddev_pop(F.col("y") - F.col("clean")) / F.stddev_pop("clean")
    return rows.groupBy("problem_id").agg(F.count("*").alias("n"), F.round(ratio, 4).alias("ratio"), F.count_if(~is_finite(F.col("y"))).alias("bad"))
