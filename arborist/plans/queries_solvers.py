"""Queries of further derivatives, solvers' verdicts, certification, selection and tournaments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import is_finite
from ..operators import fitting, scoring, search, workload
from ..operators.ranking import joined, percentiles
from ..operators.records import verdict
from ..sources.shared import kept
from . import population as p
from . import queries_panels as panels
from . import queries_relational as relational
from . import trees as t
from .registry import query

_TREES = "WITH " + p.TREES_SQL
_LOSSES = "WITH " + p.LOSSES_SQL


@query(_TREES + """SELECT tree_id, CAST(0 AS INTEGER) AS status, round(regr_intercept(y, x0), 4) AS c0, round(regr_slope(y, x0), 4) AS c1 FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id""")
def l04_dual_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits by forward-mode derivatives end at least squares on the linear shape."""
    fits = fitting.fit(p.trees(spark, sf_dir).where("shape = 0"), p.points(spark, sf_dir), 30, kept, fitting.backend("lm_dual"))
    return fits.select("tree_id", "status", *(F.round(F.col("c_final")[i], 4).alias(f"c{i}") for i in (0, 1)))


@query(_TREES + """, f AS (SELECT tree_id, k, 0.5 * sum((c0 + c1 * x0 - y) * (c0 + c1 * x0 - y)) AS first, 0.5 * regr_syy(y, x0) * (1 - regr_r2(y, x0)) AS last FROM trees JOIN points USING (problem_id) WHERE shape IN (0, 7) GROUP BY tree_id, k)
SELECT tree_id, k > 0 AND last < first AS converged, CASE WHEN k = 0 THEN 'no_constants' WHEN last < first THEN 'small_step' ELSE 'no_progress' END AS why FROM f""")
def l17_fell_and_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solver's word and the loss it left: both must say that a fit went well."""
    fits = fitting.fit(p.trees(spark, sf_dir).where("shape in (0, 7)"), p.points(spark, sf_dir), 50, kept)
    converged, why = fitting.progressed(F.col("status"), F.col("loss_init"), F.col("loss_final"))
    return fits.select("tree_id", converged.alias("converged"), why.alias("why"))


@query(_TREES + """, f AS (SELECT tree_id, round(regr_r2(y, x0), 6) AS r2 FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id)
SELECT tree_id, blind, CAST(CASE WHEN blind THEN 16 ELSE 10 END AS BIGINT) AS trials, r2 FROM f, (VALUES (FALSE), (TRUE)) b(blind)""")
def l22_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fit from starts about the given constants, and from blind ones: least squares on the linear shape."""
    population, points = p.trees(spark, sf_dir).where("shape = 0"), p.points(spark, sf_dir)
    sides = [search.certified(population, points, 5, 200, kept, blind).withColumn("blind", F.lit(blind)) for blind in (False, True)]
    return sides[0].unionByName(sides[1]).select("tree_id", "blind", "trials", F.round("r2", 6).alias("r2"))


@query(_TREES + """, s AS (SELECT tree_id, count(*) + sum(x0 * x0) AS tr, count(*) * sum(x0 * x0) - sum(x0) * sum(x0) AS det FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id)
SELECT tree_id, CAST(0 AS INTEGER) AS deficit, round(sqrt((tr + sqrt(tr * tr - 4 * det)) / (tr - sqrt(tr * tr - 4 * det))), 3) AS kappa FROM s""")
def m04_central_conditioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition and rank deficit (1e-6 of the largest singular value) of Jacobians by central differences."""
    population = p.trees(spark, sf_dir).where("shape = 0")
    state = population.withColumns({"structure": F.sha2(F.to_json("nodes"), 256), "at": F.col("c")})
    sums = fitting.pass_over(state, p.points(spark, sf_dir), scoring.structures(population), fitting.Options(jacobian="central"))
    rows = sums.where(F.forall("jtj", is_finite)).withColumn("e", fitting.conditioning("jtj", F.size("jtr")))
    return rows.select("tree_id", (F.size("jtr") - F.col("e.rank")).alias("deficit"), F.round(F.sqrt("e.condition"), 3).alias("kappa"))


@query(_TREES + "SELECT tree_id, CAST(CASE WHEN shape IN (6, 7) THEN 2 ELSE 1 END AS INTEGER) AS n_vars, k FROM trees WHERE shape NOT IN (6, 7) AND k <= 2 AND tree_id NOT IN (8, 9)")
def f07_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of one variable and two constants at most, but for two that are named."""
    rows = p.trees(spark, sf_dir).select("tree_id", F.size(workload.variables(F.col("nodes"))).alias("n_vars"), F.size("c").alias("k"))
    return workload.selected(rows, "tree_id", F.col("n_vars"), F.col("k"), 1, 2, exclude=(8, 9))


@query(_LOSSES + """, m AS (SELECT shape, quantile_cont(la, 0.5) AS a, quantile_cont(lb, 0.5) AS b FROM wide WHERE isfinite(la) AND isfinite(lb) GROUP BY shape)
SELECT shape, coalesce(a <= b * 1.05, FALSE) AS matched FROM (SELECT DISTINCT shape FROM wide) LEFT JOIN m USING (shape)""")
def f13_quality_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one engine's median over the common trees is no worse than the other's by five per cent."""
    rows = kept(panels._wide(spark, sf_dir).select("shape", "la", "lb"))
    both = rows.where(is_finite(F.col("la")) & is_finite(F.col("lb")))
    met = joined(rows.select("shape").distinct(), percentiles(both, ["shape"], "la", {"a": 0.5}), ["shape"])
    met = joined(met, percentiles(both, ["shape"], "lb", {"b": 0.5}), ["shape"])
    return met.select("shape", scoring.quality_matched(F.col("a"), F.col("b")).alias("matched"))


@query(_LOSSES + """, v AS (SELECT problem_id, var_pop(y) AS var FROM points GROUP BY problem_id)
SELECT problem_id, coalesce(bool_or(isfinite(loss) AND 2 * loss / n <= 0.5 * var), FALSE) AS stop FROM losses JOIN v USING (problem_id) GROUP BY problem_id""")
def h09_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems on which some tree explains half of the variance: their search may stop."""
    variance = p.points(spark, sf_dir).groupBy("problem_id").agg(F.var_pop("y").alias("var"))
    good = scoring.good_enough(F.col("loss"), F.col("n"), F.col("var"), 0.5)
    return panels._losses(spark, sf_dir).join(variance, "problem_id").groupBy("problem_id").agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("stop"))


@query(relational._GEN + """, m AS (SELECT kind, gen, event_id, CASE WHEN isnan(fit) THEN '-inf'::DOUBLE ELSE fit END AS f, row_number() OVER (PARTITION BY kind, gen ORDER BY event_id) - 1 AS at_, count(*) OVER (PARTITION BY kind, gen) AS total FROM e),
d AS (SELECT kind, gen, at_ AS contest, CAST('0x' || substr(md5(concat_ws(':', kind, gen, at_, draw)), 1, 8) AS BIGINT) % total AS pick FROM m, range(20) r(draw) WHERE at_ < ceil(total * 0.5)),
w AS (SELECT d.kind, d.gen, contest, m.event_id, row_number() OVER (PARTITION BY d.kind, d.gen, contest ORDER BY m.f DESC, m.event_id) AS rn FROM d JOIN m ON d.kind = m.kind AND d.gen = m.gen AND d.pick = m.at_)
SELECT kind, gen, CAST(contest AS BIGINT) AS contest, CAST(event_id AS BIGINT) AS winner FROM w WHERE rn = 1""")
def w14_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests of twenty for half of each generation's places."""
    return search.tournament(relational._generations(spark, sf_dir), ["kind", "gen"], "fit", "event_id", 20, 0.5)


@query(relational._GEN + """, l AS (SELECT kind, max(gen) AS gen FROM e GROUP BY kind)
SELECT kind, gen, CAST(count(*) AS BIGINT) AS n, round(avg(fit), 6) AS mean, round(max(fit), 4) AS top FROM e JOIN l USING (kind, gen) WHERE NOT isnan(fit) GROUP BY ALL""")
def a23_last_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's own last generation."""
    rows = relational._generations(spark, sf_dir)
    last = rows.groupBy("kind").agg(F.max("gen").alias("gen"))
    some = rows.join(last, ["kind", "gen"]).where(~F.isnan("fit"))
    return some.groupBy("kind", "gen").agg(F.count("*").alias("n"), F.round(F.avg("fit"), 6).alias("mean"), F.round(F.max("fit"), 4).alias("top"))


@query(_TREES + """SELECT CAST(count(*) AS BIGINT) AS harvested, CAST(count(*) FILTER (k > 0 AND n_nodes <= 10) AS BIGINT) AS kept, CAST(count(*) FILTER (k = 0) AS BIGINT) AS no_constants,
  CAST(count(*) FILTER (k > 0 AND n_nodes > 10) AS BIGINT) AS too_long, CAST(sum(CASE WHEN k > 0 AND n_nodes <= 10 THEN n_nodes ELSE 0 END) AS BIGINT) AS nodes FROM trees""")
def a24_corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees and nodes that a corpus keeps, and what it drops, by the first reason."""
    reason = verdict({"no_constants": F.size("c") == 0, "too_long": F.size("nodes") > 10}, "kept")
    rows = p.trees(spark, sf_dir).select(reason.alias("reason"), F.size("nodes").alias("n"))
    of = lambda name: F.count_if(F.col("reason") == name).alias(name)
    nodes = F.coalesce(F.sum(F.when(F.col("reason") == "kept", F.col("n"))), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("harvested"), of("kept"), of("no_constants"), of("too_long"), nodes.alias("nodes"))


@query(_TREES + """SELECT name, CAST(sum(n) AS BIGINT) AS n FROM trees JOIN (VALUES (0, 'x0', 1), (1, 'x0', 1), (2, 'x0', 3), (3, 'x0', 1), (4, 'x0', 1), (5, 'x1', 1), (6, 'x1', 1), (6, NULL, 1), (7, 'x0', 1), (7, 'x1', 1)) v(shape, name, n) USING (shape) GROUP BY name""")
def j18_hashed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables known by a hash, matched with a dataset of two columns; the third is unknown (null)."""
    rows = p.trees(spark, sf_dir).select(F.explode("nodes").alias("node")).where(F.col("node.nt") == t.VAR)
    hashes = rows.select(F.md5(F.concat(F.lit("x"), F.col("node.nv").cast("int"))).alias("hash"))
    return workload.named_by_hash(hashes, "hash", ["x0", "x1"]).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS problem_id, CAST(count(*) AS BIGINT) AS n, TRUE AS within FROM lineitem GROUP BY 1")
def n02_absolute_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with noise of a given size: its mean is 0 within five standard errors on every problem."""
    ids = ["l_suppkey", "l_orderkey", "l_linenumber"]
    rows = p.read(spark, sf_dir, "lineitem").select(*ids, F.lit(0.0).alias("y"))
    drawn = search.noisy(rows, ["l_suppkey"], "y", 0.25, 11, ids, "absolute")
    return drawn.groupBy(F.col("l_suppkey").alias("problem_id")).agg(F.count("*").alias("n"), (F.abs(F.avg("y")) <= 5 * 0.25 / F.sqrt(F.count("*"))).alias("within"))
