"""Queries on what fits return: honesty, orders of the schedule, restarts from the truth, other solvers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import is_finite
from ..operators import fitting, scoring, search, workload
from ..operators.ranking import joined, percentiles
from ..sources.shared import kept, shuffled
from . import population as p
from . import trees as t
from .registry import query

_TREES = "WITH " + p.TREES_SQL
_OLS = "SELECT tree_id, round(regr_intercept(y, x0), 6) AS c0, round(regr_slope(y, x0), 6) AS c1 FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id"


@query(_TREES + "SELECT shape, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (k = 0) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS dishonest, CAST(0 AS BIGINT) AS reverted FROM trees GROUP BY shape")
def f12_l09_fit_honesty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits claim, scored anew: no converged tree is worse than its start, none must be put back."""
    population, points = p.trees(spark, sf_dir), p.points(spark, sf_dir)
    fits = fitting.fit(population, points, save=kept)
    after = scoring.losses(fitting.written_back(population, fits).select(*population.columns), points).select("tree_id", F.col("loss").alias("la"))
    before = scoring.losses(population, points).select("tree_id", F.col("loss").alias("l0"))
    rows = population.select("tree_id", "shape").join(fits.select("tree_id", "status"), "tree_id").join(before, "tree_id").join(after, "tree_id")
    # the sums are added up in another order than in the fit
    lie = scoring.dishonest(F.col("l0"), F.col("la"), F.col("status"))
    reverted, _ = scoring.audit(F.col("l0") * (1 + 1e-12), F.col("la"), F.col("status"))
    some = F.col("status") != fitting.K0_SKIP
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(~some).alias("skipped"), F.count_if(lie).alias("dishonest"), F.count_if(some & is_finite(F.col("l0")) & reverted).alias("reverted"))


@query()
def a33_j17_fit_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of fits by exact derivatives and by differences, by generation, with what came of them."""
    population, points = p.trees(spark, sf_dir), p.points(spark, sf_dir)
    sides = []
    for name, jacobian in (("ad", "reverse"), ("fd", "forward")):
        fits = fitting.fit(population, points, save=kept, options=fitting.Options(jacobian=jacobian))
        sides.append(fits.select("tree_id", F.col("status").alias(name), F.col("loss_final").alias(f"{name}_loss"), "loss_init" if name == "ad" else "n_iter"))
    rows = population.select("tree_id", (F.col("problem_id") % 10).alias("gen")).join(sides[0], "tree_id").join(sides[1], "tree_id")
    lower = F.count_if(F.col("ad_loss") < F.col("loss_init"))
    return rows.groupBy("gen", "fd", "ad").agg(F.count("*").alias("n"), lower.alias("lower"), F.count_if(F.col("ad_loss") <= 1.05 * F.col("fd_loss")).alias("ad_no_worse"))


@query()
def l01_l02_step_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two orders of the schedule: asked for the step first, fits may end above the loss they had."""
    population, points = p.trees(spark, sf_dir), p.points(spark, sf_dir)
    sides = []
    for order in ("improve", "step"):
        fits = fitting.fit(population, points, save=kept, options=fitting.Options(order=order, jacobian="forward"))
        sides.append(fits.select("tree_id", (F.col("status") == fitting.CONVERGED).alias(f"{order}_converged"), F.coalesce(F.col("loss_final") > F.col("loss_init"), F.lit(False)).alias(f"{order}_worse")))
    rows = population.select("tree_id", "shape").join(sides[0], "tree_id").join(sides[1], "tree_id")
    return rows.groupBy("shape").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for side in sides for c in side.columns[1:]))


@query(_TREES + _OLS)
def l12_oracle_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tight fit that others are held against (steps to 1e-10, 200 rounds), on the linear shape."""
    fits = fitting.fit(p.trees(spark, sf_dir).where("shape = 0"), p.points(spark, sf_dir), 200, kept, fitting.Options(xtol=1e-10))
    return fits.select("tree_id", *(F.round(F.col("c_final")[i], 6).alias(f"c{i}") for i in (0, 1)))


@query(_TREES + _OLS.replace(", 6)", ", 3)"))
def l15_l18_bfgs_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimiser by gradients alone, on the linear shape."""
    fits = fitting.fit(p.trees(spark, sf_dir).where("shape = 0"), p.points(spark, sf_dir), 200, kept, fitting.backend("bfgs"))
    return fits.select("tree_id", *(F.round(F.col("c_final")[i], 3).alias(f"c{i}") for i in (0, 1)))


@query(_TREES + """, f AS (SELECT tree_id, round(regr_intercept(y, x0), 3) AS c0, round(regr_slope(y, x0), 3) AS c1 FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id)
SELECT method, restart, tree_id, c0, c1 FROM f, (VALUES ('bfgs', TRUE), ('l-bfgs', FALSE), ('cg', FALSE)) m(method, restart)""")
def l15_l18_minimisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimisers by gradients alone on the linear shape, one of them from its best of three starts: all end at
    least squares."""
    population, points = p.trees(spark, sf_dir).where("shape = 0"), p.points(spark, sf_dir)
    out = None
    for method in ("bfgs", "l-bfgs", "cg"):
        trials = fitting.starts(population, 3 if method == "bfgs" else 1, 0.5, 2)
        trials = trials.withColumns({"tree": F.col("tree_id"), "tree_id": F.col("tree_id") * 3 + F.col("trial")})
        fits = fitting.fit(trials, points, 2000, kept, fitting.backend(method)).join(trials.select("tree_id", "tree", "trial"), "tree_id")
        best = fitting.best_of(fits.drop("tree_id").withColumnRenamed("tree", "tree_id"))
        one = best.select(F.lit(method).alias("method"), F.lit(method == "bfgs").alias("restart"), "tree_id", *(F.round(F.col("c_final")[i], 3).alias(f"c{i}") for i in (0, 1)))
        out = one if out is None else out.unionByName(one)
    return out


@query(_TREES + """, s AS (SELECT problem_id, count(*) AS n, sum(x0) AS sx, sum(y) AS sy, sum(x0 * x0) AS sxx, sum(x0 * y) AS sxy, sum(y * y) AS syy, regr_intercept(y, x0) AS i, regr_slope(y, x0) AS b FROM points GROUP BY problem_id),
edges AS (SELECT * FROM (VALUES (0.0::DOUBLE), (5.35)) v(e)),
tried AS (
  SELECT problem_id, i AS c0, b AS c1 FROM s WHERE i BETWEEN 0 AND 5.35 AND b BETWEEN 0 AND 5.35
  UNION ALL SELECT problem_id, e, greatest(0, least(5.35, (sxy - e * sx) / sxx)) FROM s, edges
  UNION ALL SELECT problem_id, greatest(0, least(5.35, (sy - e * sx) / n)), e FROM s, edges),
boxed AS (SELECT problem_id, arg_min(c0, l) AS c0, arg_min(c1, l) AS c1 FROM (SELECT t.*, syy - 2 * c0 * sy - 2 * c1 * sxy + n * c0 * c0 + 2 * c0 * c1 * sx + c1 * c1 * sxx AS l FROM tried t JOIN s USING (problem_id)) GROUP BY problem_id)
SELECT method, bounded, problem_id * 8 AS tree_id, round(CASE WHEN bounded THEN boxed.c0 ELSE i END, 3) + 0.0::DOUBLE AS c0, round(CASE WHEN bounded THEN boxed.c1 ELSE b END, 3) + 0.0::DOUBLE AS c1, TRUE AS ended
FROM s JOIN boxed USING (problem_id), (VALUES ('l-bfgs', TRUE), ('bfgs', TRUE), ('nelder-mead', FALSE)) m(method, bounded)""")
def l18_bounded_and_by_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of the linear shape within bounds, where each fit ends at the best point of the box, for many
    suppliers on an edge; and without bounds by values alone."""
    population, points = p.trees(spark, sf_dir).where("shape = 0"), p.points(spark, sf_dir)
    out = None
    for method, bounds in (("l-bfgs", (0.0, 5.35)), ("bfgs", (0.0, 5.35)), ("nelder-mead", None)):
        fits = fitting.fit(population, points, 2000, kept, replace(fitting.backend(method), bounds=bounds))
        c = [F.round(F.col("c_final")[i], 3).alias(f"c{i}") for i in (0, 1)]
        one = fits.select(F.lit(method).alias("method"), F.lit(bounds is not None).alias("bounded"), "tree_id", *c, (F.col("status") == fitting.CONVERGED).alias("ended"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def h17_n05_restart_from_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated trees with a known law, fitted from scattered constants; those that converged above
    the noise floor are fitted again from the true and from the scattered constants.

    reach: how many of them come within 1.05 of the floor; median: of their losses to it."""
    ids = p.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("problem_id")).repartition(workload.tasks(spark), "problem_id")  # one file would be one task
    made = kept(ids.select("problem_id", workload.generated_trees(F.col("problem_id"), "early-gen", 5).alias("g")).select(F.col("problem_id").alias("tree_id"), "problem_id", "g.*"))
    made = made.where(F.size("c_true") > 0)
    spots = made.select("problem_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    spots = workload.sampled(spots, [workload.INPUTS] * workload.PRESETS["early-gen"].n_vars, 9, "problem_id", "i").withColumn("y", F.lit(0.0))
    truth = made.select("tree_id", "problem_id", "nodes", F.col("c_true").alias("c"))
    drawn = scoring.evaluated(truth, spots).where(is_finite(F.col("yh"))).select("problem_id", "i", F.col("yh").alias("y"))
    drawn = drawn.join(shuffled(spots.select("problem_id", "i", "x")), ["problem_id", "i"])
    points = kept(search.noisy(drawn, ["problem_id"], "y", 0.01, 3, ["problem_id", "i"], "rms"))
    floor = scoring.losses(truth, points).select("tree_id", F.col("loss").alias("floor"))
    given = made.select("tree_id", "problem_id", "nodes", F.col("c_init").alias("c"))
    first = fitting.fit(given, points, save=kept).join(shuffled(floor), "tree_id")
    missed = kept(first.where((F.col("status") == fitting.CONVERGED) & (F.col("loss_final") > F.greatest(F.col("floor") * 1.05, F.col("floor") + 1e-10))).select("tree_id", "floor"))
    out = []
    for start, rows in (("true", truth), ("scattered", given)):
        again = fitting.fit(rows.join(shuffled(missed.select("tree_id")), "tree_id", "left_semi"), points, save=kept).join(shuffled(missed), "tree_id")
        reach = scoring.tiers(F.col("loss_final"), F.col("floor"))[1]
        again = kept(again.select("loss_final", "floor", (F.col("loss_final") / F.col("floor")).alias("q"), F.lit(start).alias("start")))
        counts = again.agg(F.count("*").alias("n"), F.count_if(reach).alias("reach")).withColumn("start", F.lit(start))
        one = joined(counts, percentiles(again, ["start"], "q", {"median": 0.5}), ["start"])
        out.append(one.select("start", "n", "reach", F.round("median", 6).alias("median")))
    return out[0].unionByName(out[1])
