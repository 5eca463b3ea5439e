"""Queries that score the population under three engines and compare the engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ops import INF, is_finite
from ..operators import scoring as s
from ..operators.ranking import average_ranks, joined, ordinal_ranks, percentiles
from ..sources.shared import kept
from . import population as p
from .registry import query

_BASE = "WITH " + p.LOSSES_SQL


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engine, tree_id, problem_id, shape, k, loss, n."""
    population = p.variants(p.trees(spark, sf_dir)).withColumn("k", F.size("c"))
    # a tree without constants is one tree under all engines: it is scored once, so that its losses are equal whatever order their sums are added up in
    once = population.where((F.col("k") > 0) | (F.col("engine") == "start"))
    # what is known of a tree goes along in the sums' keys: a join with it later would send all trees to the driver
    scored = s.losses(once, p.points(spark, sf_dir), "engine", "problem_id", "shape", "k")
    engines = F.when(F.col("k") > 0, F.array("engine")).otherwise(F.array(*map(F.lit, p.ENGINES)))
    return scored.select(F.explode(engines).alias("engine"), "tree_id", "problem_id", "shape", "k", "loss", "n")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, problem_id, shape, k, l0, la, lb: the three engines side by side."""
    rows = _losses(spark, sf_dir)
    pick = lambda e: F.max(F.when(F.col("engine") == e, F.col("loss")))
    return rows.groupBy("tree_id", "problem_id", "shape", "k").agg(pick("start").alias("l0"), pick("low").alias("la"), pick("high").alias("lb"))


def _r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


def _finite(rows: DataFrame) -> DataFrame:
    """Rows with a loss that isn't finite as null."""
    return rows.withColumn("loss", F.when(is_finite(F.col("loss")), F.col("loss")))


_FINITE_SQL = "CASE WHEN isfinite(loss) THEN loss END"


@query(_BASE + "SELECT engine, tree_id, round(loss, 4) AS loss, CAST(n AS BIGINT) AS n FROM losses")
def a02_scoring_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).select("engine", "tree_id", _r(F.col("loss"), "loss", 4), "n")


@query(_BASE + """, m AS (SELECT engine, tree_id, avg(CASE WHEN isfinite(yh) THEN (yh - y) * (yh - y) END) AS mse, bool_or(NOT isfinite(yh)) AS bad,
  1 - sum(CASE WHEN isfinite(yh) THEN (yh - y) * (yh - y) END) / (var_pop(y) * count(*)) AS r2 FROM values_ GROUP BY ALL)
SELECT engine, tree_id, round(mse, 5) AS mse, round(CASE WHEN bad THEN 0 ELSE greatest(r2, 0) END, 6) AS r2 FROM m""")
def a05_a06_mean_square_and_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squares of the finite predictions, and R² clamped at 0 (0 too where one isn't finite)."""
    rows = s.evaluated(p.variants(p.trees(spark, sf_dir)), p.points(spark, sf_dir))
    safe = F.when(is_finite(F.col("yh")), F.col("yh"))
    bad = F.max((~is_finite(F.col("yh"))).cast("int")) == 1
    r2 = 1 - F.try_divide(F.sum((safe - F.col("y")) * (safe - F.col("y"))), F.var_pop("y") * F.count("y"))
    return rows.groupBy("engine", "tree_id").agg(_r(s.mean_square(F.col("y"), safe), "mse", 5), _r(F.when(bad, F.lit(0.0)).otherwise(F.greatest(r2, F.lit(0.0))), "r2"))


@query("WITH " + p.TREES_SQL + """SELECT tree_id, round(sum(1.0), 2) AS a00, round(sum(x0), 2) AS a01, round(sum(x0 * x0), 2) AS a11,
  round(sum(c0 + c1 * x0 - y), 3) AS g0, round(sum(x0 * (c0 + c1 * x0 - y)), 3) AS g1 FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY tree_id""")
def a04_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fitting import gradient
    from . import trees as t

    tree = t.parse(p.SHAPES[0])
    rows = p.trees(spark, sf_dir).where("shape = 0").join(p.points(spark, sf_dir), "problem_id")
    x, c = (lambda k: F.col("x")[k]), (lambda k: F.col("c")[k])
    slopes = gradient(tree, x, c)
    sums = s.normal_equations(rows, ["tree_id"], [slopes[0], slopes[1]], t.compiled(tree, x, c) - F.col("y"))
    return sums.select("tree_id", _r(F.col("a00"), "a00", 2), _r(F.col("a01"), "a01", 2), _r(F.col("a11"), "a11", 2), _r(F.col("g0"), "g0", 3), _r(F.col("g1"), "g1", 3))


@query(_BASE + f"SELECT engine, shape, round(coalesce(quantile_cont({_FINITE_SQL}, 0.5), 'inf'::DOUBLE), 4) AS median FROM losses GROUP BY ALL")
def a07_median_of_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = percentiles(_finite(_losses(spark, sf_dir)), ["engine", "shape"], "loss", {"median": 0.5})
    return rows.select("engine", "shape", _r(F.coalesce("median", F.lit(INF)), "median", 4))


@query(_BASE + """SELECT shape, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(la, 0.5), 4) AS low, round(quantile_cont(lb, 0.5), 4) AS high
FROM wide WHERE isfinite(la) AND isfinite(lb) GROUP BY shape""")
def a08_common_set_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two engines over the trees that both have finite."""
    both = kept(_finite_pairs(spark, sf_dir))
    medians = joined(percentiles(both, ["shape"], "la", {"low": 0.5}), percentiles(both, ["shape"], "lb", {"high": 0.5}), ["shape"])
    n = both.groupBy("shape").agg(F.count("*").alias("n"))
    return joined(n, medians, ["shape"]).select("shape", "n", _r(F.col("low"), "low", 4), _r(F.col("high"), "high", 4))


_P = ", ".join(f"round(quantile_cont({_FINITE_SQL}, {x}), 4) AS p{round(100 * x)}" for x in (0.1, 0.5, 0.9, 0.99))


@query(_BASE + f"SELECT engine, {_P} FROM losses GROUP BY engine")
def a09_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = percentiles(_finite(_losses(spark, sf_dir)), ["engine"], "loss", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})
    return rows.select("engine", *(_r(F.col(c), c, 4) for c in ("p10", "p50", "p90", "p99")))


@query(_BASE + """SELECT problem_id, round(list_sort(list(l0))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1], 4) AS p90 FROM wide WHERE isfinite(l0) GROUP BY problem_id""")
def a10_nearest_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the eight trees of each problem: a bounded group."""
    rows = _wide(spark, sf_dir).where(is_finite(F.col("l0")))
    return rows.groupBy("problem_id").agg(_r(s.nearest_percentile(F.col("l0"), 90), "p90", 4))


_BEST_SQL = _BASE + """, best AS (SELECT *, least(l0, la, lb) AS b FROM wide),
long_ AS (SELECT l.engine, l.shape, l.k, l.loss, b FROM losses l JOIN best USING (tree_id) WHERE l.k > 0)"""


def _against_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of trees with constants, beside the least of the three."""
    rows = _losses(spark, sf_dir)
    return rows.withColumn("best", F.min("loss").over(Window.partitionBy("tree_id"))).where("k > 0")


@query(_BEST_SQL + """SELECT engine, CAST(count(*) AS BIGINT) AS n,
  round(avg(CASE WHEN isfinite(b) AND isfinite(loss) AND loss <= greatest(b * 1.005, b + 1e-10) THEN 1.0 ELSE 0 END), 6) AS tier_a,
  round(avg(CASE WHEN isfinite(b) AND isfinite(loss) AND loss <= greatest(b * 1.05, b + 1e-10) THEN 1.0 ELSE 0 END), 6) AS tier_b FROM long_ GROUP BY engine""")
def a16_f02_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = s.tiers(F.col("loss"), F.col("best"))
    return _against_best(spark, sf_dir).groupBy("engine").agg(F.count("*").alias("n"), _r(s.rate(a), "tier_a"), _r(s.rate(b), "tier_b"))


@query(_BASE + """SELECT engine, shape, round(avg(CASE WHEN isfinite(loss) AND loss <= greatest(l0 * 1.005, l0 + 1e-10) THEN 1.0 ELSE 0 END), 6) AS reach_a,
  round(avg(CASE WHEN isfinite(loss) AND loss <= greatest(l0 * 1.05, l0 + 1e-10) THEN 1.0 ELSE 0 END), 6) AS reach_b
FROM losses JOIN wide USING (tree_id, shape) WHERE isfinite(l0) AND losses.k > 0 GROUP BY ALL""")
def a17_noise_floor_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers against the loss of the constants that were given, instead of the best found."""
    rows = _losses(spark, sf_dir).where("k > 0")
    floor = F.max(F.when(F.col("engine") == "start", F.col("loss"))).over(Window.partitionBy("tree_id"))
    rows = rows.withColumn("floor", floor).where(is_finite(F.col("floor")))
    a, b = s.tiers(F.col("loss"), F.col("floor"))
    return rows.groupBy("engine", "shape").agg(_r(s.rate(a), "reach_a"), _r(s.rate(b), "reach_b"))


_ENV = ", ".join(f"round(avg(CASE WHEN isfinite(loss) AND loss <= b * {f} THEN 1.0 ELSE 0 END), 6) AS within_{str(f).replace('.', '_')}" for f in (1.05, 2.0, 10.0))


@query(_BEST_SQL + f"SELECT engine, {_ENV} FROM long_ GROUP BY engine")
def a19_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _against_best(spark, sf_dir).groupBy("engine").agg(*s.envelope(F.col("loss"), F.col("best"), 1.05, 2.0, 10.0))
    return rows.select("engine", *(_r(F.col(c), c) for c in rows.columns if c != "engine"))


@query("WITH " + p.TREES_SQL + """SELECT tree_id, round(CASE k WHEN 2 THEN sqrt((c0 * c0 + c1 * c1) * 0.01) / sqrt(c0 * c0 + c1 * c1)
  ELSE sqrt((c0 * c0 + c1 * c1 + c2 * c2) * 0.01) / sqrt(c0 * c0 + c1 * c1 + c2 * c2) END, 9) AS error FROM trees WHERE k > 0""")
def a20_relative_constant_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of an engine's constants to the given ones, relative to their norm."""
    rows = p.trees(spark, sf_dir).where(F.size("c") > 0).withColumn("low", F.transform("c", lambda v: v * 0.9))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, v: t + v * v))
    return rows.select("tree_id", _r(norm(F.zip_with("c", "low", lambda u, v: u - v)) / norm(F.col("c")), "error", 9))


@query("WITH " + p.TREES_SQL + """, e AS (SELECT shape, unnest([abs(c0 * 0.9 - c0) / greatest(abs(c0), 1e-9), abs(c1 * 0.9 - c1) / greatest(abs(c1), 1e-9),
  CASE WHEN k = 3 THEN abs(c2 * 0.9 - c2) / greatest(abs(c2), 1e-9) END]) AS e FROM trees WHERE k > 0)
SELECT shape, CAST(count(e) AS BIGINT) AS n, round(quantile_cont(e, 0.5), 9) AS median FROM e GROUP BY shape""")
def a21_constant_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.trees(spark, sf_dir).select("shape", F.explode("c").alias("c"))
    error = F.abs(F.col("c") * 0.9 - F.col("c")) / F.greatest(F.abs("c"), F.lit(1e-9))
    rows = rows.select("shape", error.alias("error"))
    met = joined(rows.groupBy("shape").agg(F.count("*").alias("n")), percentiles(rows, ["shape"], "error", {"median": 0.5}), ["shape"])
    return met.withColumn("median", F.round("median", 9))


_RATIO = _BASE + ", r AS (SELECT *, la / l0 AS q FROM wide WHERE isfinite(la) AND isfinite(l0) AND l0 > 0 AND k > 0)"


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir).where(is_finite(F.col("la")) & is_finite(F.col("l0")) & (F.col("l0") > 0) & (F.col("k") > 0))
    return rows.withColumn("q", F.col("la") / F.col("l0"))


@query(_RATIO + """SELECT shape, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (q < 1) AS BIGINT) AS improved, CAST(count(*) FILTER (q > 1) AS BIGINT) AS worsened,
  CAST(count(*) FILTER (q > 10) AS BIGINT) AS diverged, round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.9), 6) AS p90 FROM r GROUP BY shape""")
def a31_loss_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = F.col("q"), kept(_ratios(spark, sf_dir).select("shape", "q"))
    counts = rows.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(q < 1).alias("improved"), F.count_if(q > 1).alias("worsened"), F.count_if(q > 10).alias("diverged"))
    met = joined(counts, percentiles(rows, ["shape"], "q", {"p50": 0.5, "p90": 0.9}), ["shape"])
    return met.withColumns({"p50": F.round("p50", 6), "p90": F.round("p90", 6)})


@query(_RATIO + """SELECT round(avg(log10(q)), 6) AS mean_log, round(quantile_cont(log10(q), 0.5), 6) AS median_log,
  CAST(count(*) FILTER (q < 1 / 1.05) AS BIGINT) AS wins, CAST(count(*) FILTER (q > 1.05) AS BIGINT) AS losses FROM r""")
def a32_log_ratio_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = F.col("q"), kept(_ratios(spark, sf_dir).select("q", F.log10("q").alias("log"), F.lit(0).alias("all")))
    counts = rows.agg(_r(F.avg("log"), "mean_log"), F.count_if(q < 1 / 1.05).alias("wins"), F.count_if(q > 1.05).alias("losses")).withColumn("all", F.lit(0))
    met = joined(counts, percentiles(rows, ["all"], "log", {"median_log": 0.5}), ["all"])
    return met.select("mean_log", _r(F.col("median_log"), "median_log"), "wins", "losses")


_MEDIANS = _BASE + """, m AS (SELECT problem_id, quantile_cont(CASE WHEN isfinite(la) THEN la END, 0.5) AS a, quantile_cont(CASE WHEN isfinite(lb) THEN lb END, 0.5) AS b
  FROM wide GROUP BY problem_id)"""


@query(_MEDIANS + """SELECT CASE WHEN a < b * 0.98 THEN 'low' WHEN b < a * 0.98 THEN 'high' ELSE 'tie' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1""")
def a34_wins_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has the lower median loss on each problem, with a band of two per cent."""
    rows = _wide(spark, sf_dir).groupBy("problem_id").agg(s.median_finite(F.col("la")).alias("a"), s.median_finite(F.col("lb")).alias("b"))
    verdict = F.when(F.col("a") < F.col("b") * 0.98, "low").when(F.col("b") < F.col("a") * 0.98, "high").otherwise("tie")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(_BASE + """SELECT shape, CASE WHEN isfinite(la) AND la < 0.99 * l0 THEN 'material' WHEN greatest(l0, la) > 1e-6 AND la > 1.05 * l0 THEN 'worse' ELSE 'same' END AS kind, CAST(count(*) AS BIGINT) AS n
FROM wide WHERE k > 0 GROUP BY ALL""")
def f11_f14_material_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l0, la = F.col("l0"), F.col("la")
    kind = F.when(is_finite(la) & (la < 0.99 * l0), "material").when((F.greatest(l0, la) > 1e-6) & (la > 1.05 * l0), "worse").otherwise("same")
    return _wide(spark, sf_dir).where("k > 0").groupBy("shape", kind.alias("kind")).agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN k = 0 THEN 3 WHEN NOT isfinite(la) THEN 2 WHEN tree_id % 5 = 0 THEN 1 ELSE 0 END"


def _status() -> Column:
    return F.when(F.col("k") == 0, 3).when(~is_finite(F.col("la")), 2).when(F.col("tree_id") % 5 == 0, 1).otherwise(0)


@query(_BASE + f"""SELECT shape, status, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status = 0 AND (NOT isfinite(la) OR la > l0 * (1 + 1e-4) + 1e-12)) AS BIGINT) AS dishonest
FROM (SELECT *, {_STATUS} AS status FROM wide) GROUP BY ALL""")
def f12_a11_status_and_honesty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir).withColumn("status", _status())
    lie = s.dishonest(F.col("l0"), F.col("la"), F.col("status"))
    return rows.groupBy("shape", "status").agg(F.count("*").alias("n"), F.count_if(lie).alias("dishonest"))


@query(_BASE + f"""SELECT before, after, reverted, CAST(count(*) AS BIGINT) AS n FROM (SELECT status AS before, NOT isfinite(la) OR la > l0 AS reverted,
  CASE WHEN (NOT isfinite(la) OR la > l0) AND status = 0 THEN 1 ELSE status END AS after FROM (SELECT *, {_STATUS} AS status FROM wide)) GROUP BY ALL""")
def l09_boundary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir).withColumn("status", _status())
    reverted, after = s.audit(F.col("l0"), F.col("la"), F.col("status"))
    return rows.groupBy(F.col("status").alias("before"), after.alias("after"), reverted.alias("reverted")).agg(F.count("*").alias("n"))


_RANKED = _BASE + """, f AS (SELECT * FROM wide WHERE isfinite(la) AND isfinite(lb)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY la, tree_id) AS ra, row_number() OVER (PARTITION BY shape ORDER BY lb, tree_id) AS rb,
  rank() OVER (PARTITION BY shape ORDER BY round(la, 0)) + (count(*) OVER (PARTITION BY shape, round(la, 0)) - 1) / 2 AS va,
  rank() OVER (PARTITION BY shape ORDER BY round(lb, 0)) + (count(*) OVER (PARTITION BY shape, round(lb, 0)) - 1) / 2 AS vb, count(*) OVER (PARTITION BY shape) AS m FROM f)"""


def _finite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).where(is_finite(F.col("la")) & is_finite(F.col("lb")))


@query(_RANKED + "SELECT shape, round(corr(ra, rb), 6) AS spearman, round(corr(va, vb), 6) AS spearman_ties FROM ranks GROUP BY shape")
def w01_w02_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(_finite_pairs(spark, sf_dir).select("shape", "tree_id", "la", "lb", F.round("la", 0).alias("ta"), F.round("lb", 0).alias("tb")))
    met = rows
    for side in "ab":
        place = ordinal_ranks(rows.select("shape", "tree_id", f"l{side}"), ["shape"], f"l{side}", "tree_id", f"r{side}")
        met = joined(met, place.select("shape", "tree_id", F.col(f"r{side}").cast("double").alias(f"r{side}")), ["shape", "tree_id"])
        met = joined(met, average_ranks(rows, ["shape"], f"t{side}", f"v{side}").drop("n"), ["shape", f"t{side}"])
    return met.groupBy("shape").agg(_r(s.correlation(F.col("ra"), F.col("rb")), "spearman"), _r(s.correlation(F.col("va"), F.col("vb")), "spearman_ties"))


def _top_sql(share: float) -> str:
    k, n = f"greatest(1, CAST(floor(m * {share}) AS INTEGER))", round(100 * share)
    both, either = (f"sum(CASE WHEN ra <= {k} {o} rb <= {k} THEN 1.0 ELSE 0 END)" for o in ("AND", "OR"))
    return f"round({both} / max({k}), 6) AS top{n}, round({both} / {either}, 6) AS jaccard{n}"


@query(_RANKED + f"SELECT shape, {_top_sql(0.1)}, {_top_sql(0.25)}, {_top_sql(0.5)} FROM ranks GROUP BY shape")
def w03_u02_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.top_overlap(_finite_pairs(spark, sf_dir), ["shape"], "la", "lb", "tree_id", 0.1, 0.25, 0.5)
    return rows.select("shape", *(_r(F.col(c), c) for c in rows.columns if c != "shape"))


@query(_BASE + """SELECT tree_id, shape, round(q, 6) AS q FROM (SELECT tree_id, shape, la / l0 AS q FROM wide WHERE isfinite(la) AND isfinite(l0) AND l0 > 0)
ORDER BY q DESC, tree_id LIMIT 10""")
def w06_top_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the ten worst: the limit is the feature."""
    rows = _wide(spark, sf_dir).where(is_finite(F.col("la")) & is_finite(F.col("l0")) & (F.col("l0") > 0))
    return rows.select("tree_id", "shape", (F.col("la") / F.col("l0")).alias("q")).orderBy(F.desc("q"), "tree_id").limit(10).withColumn("q", F.round("q", 6))


@query(_BASE + """SELECT problem_id, tree_id, CAST(place AS BIGINT) AS place FROM (SELECT problem_id, tree_id, row_number() OVER (PARTITION BY problem_id ORDER BY l0, tree_id) AS place FROM wide) WHERE place <= 3""")
def w04_top_trees_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best trees of every problem."""
    return s.top_k(_wide(spark, sf_dir), ["problem_id"], [F.col("l0"), F.col("tree_id")], 3).select("problem_id", "tree_id", F.col("place").cast("long").alias("place"))


@query(_BASE + f""", st AS (SELECT *, {_STATUS} AS fd, CASE WHEN k = 0 THEN 3 WHEN NOT isfinite(lb) THEN 2 WHEN tree_id % 3 = 0 THEN 1 ELSE 0 END AS ad FROM wide)
SELECT fd, ad, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY ALL""")
def j17_status_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ad = F.when(F.col("k") == 0, 3).when(~is_finite(F.col("lb")), 2).when(F.col("tree_id") % 3 == 0, 1).otherwise(0)
    return _wide(spark, sf_dir).groupBy(_status().alias("fd"), ad.alias("ad")).agg(F.count("*").alias("n"))


@query(_BASE + """, t AS (SELECT tree_id, la <= greatest(l0 * 1.05, l0 + 1e-10) AS before, lb <= greatest(l0 * 1.05, l0 + 1e-10) AS after FROM wide WHERE isfinite(l0) AND k > 0)
SELECT CAST(count(*) FILTER (after AND NOT before) AS BIGINT) AS gained, CAST(count(*) FILTER (before AND NOT after) AS BIGINT) AS lost,
  CAST(count(*) FILTER (after) - count(*) FILTER (before) AS BIGINT) AS net FROM t""")
def h19_tier_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir).where(is_finite(F.col("l0")) & (F.col("k") > 0))
    before, after = (s.tiers(F.col(c), F.col("l0"))[1] for c in ("la", "lb"))
    return rows.agg(
        F.count_if(after & ~before).alias("gained"), F.count_if(before & ~after).alias("lost"), (F.count_if(after) - F.count_if(before)).alias("net")
    )


@query(_BASE + "SELECT CAST(count(*) FILTER (la > l0 * (1 + 1e-6) + 1e-9) AS BIGINT) AS worse, CAST(count(*) AS BIGINT) AS n FROM wide WHERE k > 0")
def h22_worse_than_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).where("k > 0").agg(F.count_if(F.col("la") > F.col("l0") * (1 + 1e-6) + 1e-9).alias("worse"), F.count("*").alias("n"))


@query(_BASE + """, j AS (SELECT o.loss AS l0, a.loss AS la, b.loss AS lb FROM (FROM losses WHERE engine = 'start') o
  FULL JOIN (FROM losses WHERE engine = 'low') a USING (tree_id) FULL JOIN (FROM losses WHERE engine = 'high') b USING (tree_id))
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l0 IS NULL OR la IS NULL OR lb IS NULL) AS BIGINT) AS lacking, CAST(count(*) FILTER (isfinite(l0) AND isfinite(la) AND isfinite(lb)) AS BIGINT) AS finite,
  CAST(count(*) FILTER (la < l0 AND la <= lb) AS BIGINT) AS low_best, CAST(count(*) FILTER (lb < l0 AND lb < la) AS BIGINT) AS high_best FROM j""")
def j04_engine_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engines joined on the tree; trees that an engine lacks are counted."""
    rows = kept(_losses(spark, sf_dir))  # computed for each side, a tree's sums would be added up in three orders
    side = lambda e, name: rows.where(F.col("engine") == e).select("tree_id", F.col("loss").alias(name))
    met = side("start", "l0").join(side("low", "la"), "tree_id", "full").join(side("high", "lb"), "tree_id", "full")
    l0, la, lb = F.col("l0"), F.col("la"), F.col("lb")
    return met.agg(
        F.count("*").alias("n"), F.count_if(l0.isNull() | la.isNull() | lb.isNull()).alias("lacking"), F.count_if(is_finite(l0) & is_finite(la) & is_finite(lb)).alias("finite"),
        F.count_if((la < l0) & (la <= lb)).alias("low_best"), F.count_if((lb < l0) & (lb < la)).alias("high_best"),
    )


@query(_BASE + """, part AS (SELECT tree_id, la, 0 AS status FROM wide WHERE k > 0)
SELECT coalesce(status, 2) AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(la) AS BIGINT) AS scored FROM wide LEFT JOIN (SELECT tree_id, la AS got, status FROM part) USING (tree_id) GROUP BY ALL""".replace("count(la)", "count(got)"))
def j12_j13_scatter_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the trees with constants put back on all; a missing one reads as failed."""
    rows = kept(_wide(spark, sf_dir).select("tree_id", "k", "la"))
    results = rows.where("k > 0").select("tree_id", F.col("la").alias("got"), F.lit(0).alias("status"))
    met = rows.select("tree_id").join(results, "tree_id", "left").withColumn("status", F.coalesce("status", F.lit(2)))
    return met.groupBy("status").agg(F.count("*").alias("n"), F.count("got").alias("scored"))


@query(_BASE + """, c AS (SELECT engine, problem_id, loss FROM losses WHERE isfinite(loss)),
g AS (SELECT engine, problem_id, avg(loss) AS mean, coalesce(stddev_samp(loss), 0) AS sd, count(*) AS n FROM c GROUP BY ALL)
SELECT engine, problem_id, CAST(n AS BIGINT) AS n, round(mean, 3) AS mean, round(sd, 3) AS sd, round(sd / mean, 6) AS cv FROM g""")
def a30_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _losses(spark, sf_dir).where(is_finite(F.col("loss"))).groupBy("engine", "problem_id")
    mean, sd = F.avg("loss"), F.coalesce(F.stddev_samp("loss"), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), _r(mean, "mean", 3), _r(sd, "sd", 3), _r(sd / mean, "cv"))


@query(_BASE + """SELECT engine, CASE WHEN abs(d) <= 0.15 THEN 'clean' WHEN abs(d) <= 0.30 THEN 'note' ELSE 'stop' END AS verdict, CAST(count(*) AS BIGINT) AS n
FROM (SELECT l.engine, l.loss / w.l0 - 1 AS d FROM losses l JOIN wide w USING (tree_id) WHERE isfinite(l.loss) AND isfinite(l0) AND l0 > 0 AND l.engine <> 'start') GROUP BY ALL""")
def h18_drift_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells measured again, by how far they are from the first measure."""
    rows = _losses(spark, sf_dir)
    first = rows.where("engine = 'start'").select("tree_id", F.col("loss").alias("l0"))
    d = F.abs(F.col("loss") / F.col("l0") - 1)
    met = rows.where("engine <> 'start'").join(first, "tree_id").where(is_finite(F.col("loss")) & is_finite(F.col("l0")) & (F.col("l0") > 0))
    return met.groupBy("engine", F.when(d <= 0.15, "clean").when(d <= 0.30, "note").otherwise("stop").alias("verdict")).agg(F.count("*").alias("n"))


@query(_BASE + """SELECT t.tau, CAST(count(*) FILTER (la <= l0 * (1 + t.tau)) AS BIGINT) AS survivors FROM wide, (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE), (1.0::DOUBLE)) t(tau) WHERE isfinite(l0) AND k > 0 GROUP BY t.tau""")
def h12_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir).where(is_finite(F.col("l0")) & (F.col("k") > 0))
    swept = rows.withColumn("tau", F.explode(F.array(*map(F.lit, (0.0, 0.01, 0.05, 0.2, 1.0)))))
    return swept.groupBy("tau").agg(F.count_if(F.col("la") <= F.col("l0") * (1 + F.col("tau"))).alias("survivors"))


@query(_BASE + """SELECT problem_id, CAST(arg_min(shape, l0) AS INTEGER) AS best_shape, CAST(arg_max(shape, l0) AS INTEGER) AS worst_shape FROM wide WHERE isfinite(l0) GROUP BY problem_id""")
def w10_argmin_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir).where(is_finite(F.col("l0")))
    return rows.groupBy("problem_id").agg(F.min_by("shape", "l0").alias("best_shape"), F.max_by("shape", "l0").alias("worst_shape"))


@query(_BASE + """SELECT engine, problem_id, round(min(loss), 4) AS loss, CAST(arg_min(tree_id, loss) AS BIGINT) AS tree_id FROM losses GROUP BY ALL""")
def a38_best_of_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several fits of one problem and engine."""
    return _losses(spark, sf_dir).groupBy("engine", "problem_id").agg(_r(F.min("loss"), "loss", 4), F.min_by("tree_id", "loss").alias("tree_id"))


@query("""SELECT l_returnflag AS flag, round(sqrt(avg(y * y)), 6) AS rms, round(stddev_pop(y), 6) AS sd FROM (SELECT l_returnflag, l_extendedprice / 10000 AS y FROM lineitem) GROUP BY 1""")
def a39_n03_noise_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_extendedprice") / 10000
    return p.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(_r(F.sqrt(F.avg(y * y)), "rms"), _r(F.stddev_pop(y), "sd"))


