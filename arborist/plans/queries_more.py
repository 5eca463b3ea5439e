"""Queries of the solver's parts, structural operators, workloads and accounting."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ops import is_finite
from ..operators import fitting, scoring, search, workload
from ..operators.ranking import joined, percentiles
from ..sources.shared import kept
from . import population as p
from . import queries_panels as panels
from . import trees as t
from .registry import query

_TREES = "WITH " + p.TREES_SQL
_LOSSES = "WITH " + p.LOSSES_SQL


def _r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


_SUMS = _TREES + """, s AS (SELECT tree_id, c0, c1, count(*) AS n, sum(x0) AS sx, sum(x0 * x0) AS sxx, sum(c0 + c1 * x0 - y) AS g0, sum(x0 * (c0 + c1 * x0 - y)) AS g1
  FROM trees JOIN points USING (problem_id) WHERE shape = 0 GROUP BY ALL)"""


def _linear_pass(spark: SparkSession, sf_dir: str, options: fitting.Options = fitting.Options()) -> DataFrame:
    population = p.trees(spark, sf_dir).where("shape = 0")
    state = population.withColumns({"structure": F.sha2(F.to_json("nodes"), 256), "at": F.col("c")})
    return state.join(fitting.pass_over(state, p.points(spark, sf_dir), scoring.structures(population), options), "tree_id")


@query(_SUMS + """, d AS (SELECT *, n * 1.001 AS a, sxx * 1.001 AS b FROM s)
SELECT tree_id, round(-(b * g0 - sx * g1) / (a * b - sx * sx), 5) AS d0, round(-(a * g1 - sx * g0) / (a * b - sx * sx), 5) AS d1 FROM d""")
def l06_damped_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One damped normal step of the linear trees, against the closed form."""
    rows = _linear_pass(spark, sf_dir).withColumn("lambda", F.lit(1e-3))
    rows = rows.withColumn("d", fitting.damped_step(F.col("jtj"), F.col("jtr"), F.col("lambda")))
    return rows.select("tree_id", _r(F.col("d")[0], "d0", 5), _r(F.col("d")[1], "d1", 5))


@query(_SUMS + """, d AS (SELECT *, n + 0.5 AS a, sxx + 0.5 AS b FROM s)
SELECT tree_id, round(-(b * g0 - sx * g1) / (a * b - sx * sx), 4) AS d0, round(-(a * g1 - sx * g0) / (a * b - sx * sx), 4) AS d1 FROM d""")
def l03_l07_l13_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same step with forward differences and absolute damping."""
    options = fitting.Options(jacobian="forward", damping="absolute")
    rows = _linear_pass(spark, sf_dir, options).withColumn("lambda", F.lit(0.5))
    rows = rows.withColumn("d", fitting.damped_step(F.col("jtj"), F.col("jtr"), F.col("lambda"), options))
    return rows.select("tree_id", _r(F.col("d")[0], "d0", 4), _r(F.col("d")[1], "d1", 4))


@query(_SUMS + """, e AS (SELECT tree_id, n + sxx AS tr, n * sxx - sx * sx AS det FROM s)
SELECT tree_id, CAST(2 AS INTEGER) AS rank, round((tr + sqrt(tr * tr - 4 * det)) / (tr - sqrt(tr * tr - 4 * det)), 3) AS condition FROM e""")
def m03_m05_conditioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and condition of the normal matrices, from their eigenvalues."""
    rows = _linear_pass(spark, sf_dir).withColumn("e", fitting.conditioning("jtj", F.size("jtr")))
    return rows.select("tree_id", "e.rank", _r(F.col("e.condition"), "condition", 3))


@query(_TREES + """, g AS (SELECT shape, k, shape = 6 AND x1 + x2 <= 0 AS singular FROM trees JOIN points USING (problem_id) WHERE k > 0)
SELECT shape, CAST(sum(k) AS BIGINT) AS n, CAST(sum(CASE WHEN singular THEN 0 ELSE k END) AS BIGINT) AS agree, CAST(count(*) FILTER (singular) AS BIGINT) AS neither_finite,
  CAST(count(*) FILTER (singular) AS BIGINT) AS reverse_finite, CAST(0 AS BIGINT) AS central_finite, CAST(0 AS BIGINT) AS disputed FROM g GROUP BY shape""")
def h20_gradients_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse-mode derivatives against central differences by every constant of every tree at every
    point: equal within 2e-2 and 1e-4, neither finite, one finite alone, or disputed.

    At a singular point of the logarithm neither derivative by its factor is finite; by the added
    constant the exact one is 1, while differences of infinities have no value."""
    population = p.trees(spark, sf_dir).where(F.size("c") > 0)
    known = scoring.structures(population)
    names = ("agree", "neither_finite", "reverse_finite", "central_finite", "disputed")
    x, c = (lambda k: F.col("x")[k]), (lambda k: F.col("c")[k])
    points, parts = p.points(spark, sf_dir).select("problem_id", "x"), []
    for number, (_, tree) in enumerate(known):  # each by itself: all in one expression are too long to be compiled
        k = sum(n[0] == t.CONST for n in t.prefix(tree))
        exact, differed = fitting.gradient(tree, x, c), fitting.central(tree, x, c, k)
        rows = scoring.met(population, points, known).where(F.col("structure") == number)
        rows = rows.select("shape", *(v[i].alias(f"{name}{i}") for name, v in (("a", exact), ("b", differed)) for i in range(k)))
        kinds = []
        for i in range(k):
            a, b = F.col(f"a{i}"), F.col(f"b{i}")
            fine = F.abs(a - b) <= 1e-4 + 2e-2 * F.abs(b)
            kinds.append(
                F.when(is_finite(a) & is_finite(b), F.when(fine, "agree").otherwise("disputed"))
                .when(is_finite(a), "reverse_finite").when(is_finite(b), "central_finite").otherwise("neither_finite").alias(f"k{i}")
            )
        counted = lambda name: reduce(add, (F.count_if(F.col(f"k{i}") == name) for i in range(k))).alias(name)  # noqa: E731, B023
        parts.append(rows.select("shape", *kinds).groupBy("shape").agg((k * F.count("*")).alias("n"), *map(counted, names)))
    return reduce(DataFrame.unionByName, parts).groupBy("shape").agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in names))


@query(_TREES + "SELECT shape, CAST(count(*) AS BIGINT) AS n, TRUE AS same FROM trees GROUP BY shape")
def s12_postfix_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees taken to postfix order and back."""
    nodes = F.col("nodes")
    rows = p.trees(spark, sf_dir).withColumn("same", t.to_prefix(t.to_postfix(nodes)) == nodes)
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.bool_and("same").alias("same"))


@query(_TREES + """SELECT CAST(count(*) AS BIGINT) AS m, CAST(sum(n_nodes) AS BIGINT) AS total_nodes, CAST(sum(k) AS BIGINT) AS total_c, CAST(max(k) AS BIGINT) AS k_max, CAST(3 AS BIGINT) AS max_stack FROM trees""")
def k02_population_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.trees(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("m"), F.sum(F.size("nodes")).alias("total_nodes"), F.sum(F.size("c")).alias("total_c"), F.max(F.size("c")).cast("long").alias("k_max"),
        F.max(t.depth_need(F.col("nodes"))).cast("long").alias("max_stack"),
    )


@query(_TREES + """SELECT problem_id, tree_id, k, CAST(copy AS INTEGER) AS copy FROM (SELECT problem_id, tree_id, k, row_number() OVER (PARTITION BY problem_id ORDER BY k, tree_id) AS rn FROM trees), range(5) r(copy) WHERE rn = 4""")
def t11_homogeneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each problem's tree of median K, five times."""
    return workload.homogeneous(p.trees(spark, sf_dir), "problem_id", 5).select("problem_id", "tree_id", F.size("c").alias("k"), "copy")


@query(_TREES + """SELECT CAST(nt AS INTEGER) AS nt, CAST(per * (SELECT count(*) FROM supplier) AS BIGINT) AS n FROM (VALUES (0, 12), (1, 17), (2, 4), (3, 21)) v(nt, per)""")
def t13_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as rows, counted by kind."""
    nodes = p.trees(spark, sf_dir).select("tree_id", F.posexplode_outer("nodes").alias("at", "node"))
    return nodes.groupBy(F.col("node.nt").alias("nt")).agg(F.count("*").alias("n"))


@query(_TREES + "SELECT tree_id, shape FROM trees ORDER BY tree_id LIMIT 20")
def t06_w12_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first trees: the limit is the feature."""
    return p.trees(spark, sf_dir).select("tree_id", "shape").orderBy("tree_id").limit(20)


@query(_TREES + """SELECT CASE WHEN k = 0 THEN 'no_constants' WHEN shape = 6 THEN 'singular_input' WHEN n_nodes > 10 THEN 'too_long' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS n FROM trees GROUP BY 1""")
def f05_f06_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that an adapter would drop, by the first reason."""
    from ..operators.records import verdict

    reason = verdict({"no_constants": F.size("c") == 0, "singular_input": F.exists("nodes", lambda n: (n["nt"] == 2) & (n["nv"] == 20)), "too_long": F.size("nodes") > 10}, "kept")
    return p.trees(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(_TREES + """, g AS (SELECT problem_id, a.v AS u, b.v AS w, 1 - sum((a.v + b.v * x0 - y) * (a.v + b.v * x0 - y)) / (var_pop(y) * count(*)) AS r2
  FROM points, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) a(v), (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) b(v) GROUP BY problem_id, a.v, b.v)
SELECT problem_id, CAST(count(*) AS BIGINT) AS cells, round(min(r2), 5) AS worst, round(max(r2), 5) AS best FROM g GROUP BY problem_id""")
def j16_m02_reference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear shape over a grid of constants: worst and best R² of each problem."""
    grid = F.array(*(F.array(F.lit(u), F.lit(w)) for u in (0.5, 1.0, 2.0) for w in (0.5, 1.0, 2.0)))
    rows = p.points(spark, sf_dir).withColumn("c", F.explode(grid)).withColumn("yh", F.col("c")[0] + F.col("c")[1] * F.col("x")[0])
    cells = rows.groupBy("problem_id", "c").agg(scoring.r_squared(F.col("y"), F.col("yh")).alias("r2"))
    return cells.groupBy("problem_id").agg(F.count("*").alias("cells"), _r(F.min("r2"), "worst", 5), _r(F.max("r2"), "best", 5))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT k, round(a.n / b.n, 6) AS density FROM a JOIN b USING (k)""")
def j07_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus against another, cell by cell."""
    a = p.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = p.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k").select("k", _r(F.col("a") / F.col("b"), "density"))


@query(_LOSSES + """, st AS (SELECT *, CASE WHEN k = 0 THEN 3 WHEN NOT isfinite(la) THEN 2 WHEN tree_id % 5 = 0 THEN 1 WHEN tree_id % 11 = 0 THEN 4 ELSE 0 END AS s FROM wide)
SELECT problem_id % 10 AS gen, CAST(count(*) AS BIGINT) AS m, CAST(count(*) FILTER (s = 0) AS BIGINT) AS converged, CAST(count(*) FILTER (s = 4) AS BIGINT) AS cholesky, CAST(count(*) FILTER (s = 2) AS BIGINT) AS nan_,
  CAST(count(*) FILTER (s = 1) AS BIGINT) AS maxiter, CAST(count(*) FILTER (s = 0 AND la > l0) AS BIGINT) AS converged_worse, CAST(count(*) FILTER (lb < l0 AND la > l0) AS BIGINT) AS split FROM st GROUP BY 1""")
def a33_generation_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each generation's trees, in one pass."""
    la, lb, l0 = F.col("la"), F.col("lb"), F.col("l0")
    s = F.when(F.col("k") == 0, 3).when(~is_finite(la), 2).when(F.col("tree_id") % 5 == 0, 1).when(F.col("tree_id") % 11 == 0, 4).otherwise(0)
    rows = panels._wide(spark, sf_dir).withColumn("s", s)
    return rows.groupBy((F.col("problem_id") % 10).alias("gen")).agg(
        F.count("*").alias("m"), F.count_if(F.col("s") == 0).alias("converged"), F.count_if(F.col("s") == 4).alias("cholesky"), F.count_if(F.col("s") == 2).alias("nan_"),
        F.count_if(F.col("s") == 1).alias("maxiter"), F.count_if((F.col("s") == 0) & (la > l0)).alias("converged_worse"),
        F.count_if((F.col("k") > 0) & (lb < l0) & (la > l0)).alias("split"),  # without constants the engines' losses are one, whatever order their sums are added up in
    )


@query(_LOSSES + """SELECT shape, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (CAST(CAST(la AS FLOAT) AS DOUBLE) > la) AS BIGINT) AS above,
  round(max(abs(CAST(CAST(la AS FLOAT) AS DOUBLE) / la - 1)) * 1e9, 1) AS worst FROM wide WHERE isfinite(la) AND la > 0 GROUP BY shape""")
def a01_h13_single_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far losses in single precision are from those in double."""
    single = F.col("la").cast("float").cast("double")
    rows = panels._wide(spark, sf_dir).where(is_finite(F.col("la")) & (F.col("la") > 0))
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(single > F.col("la")).alias("above"), _r(F.max(F.abs(single / F.col("la") - 1)) * 1e9, "worst", 1))


@query(_LOSSES + """SELECT shape, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN lb <= greatest(l0 * 1.05, l0 + 1e-10) THEN 1.0 ELSE 0 END), 6) AS reach, round(quantile_cont(lb / l0, 0.5), 6) AS median
FROM wide WHERE isfinite(l0) AND isfinite(lb) AND l0 > 0 GROUP BY shape""")
def h17_substituted_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trees with other constants put in, against the given ones."""
    whole = p.trees(spark, sf_dir)
    points = p.points(spark, sf_dir)
    given = scoring.losses(whole, points).select("tree_id", F.col("loss").alias("l0"))
    other = scoring.losses(whole.withColumn("c", F.transform("c", lambda v: v * 1.1)), points).select("tree_id", F.col("loss").alias("lb"))
    met = whole.select("tree_id", "shape").join(given, "tree_id").join(other, "tree_id").where(is_finite(F.col("l0")) & is_finite(F.col("lb")) & (F.col("l0") > 0))
    met = kept(met.select("shape", "l0", "lb", (F.col("lb") / F.col("l0")).alias("q")))
    reach = scoring.rate(scoring.tiers(F.col("lb"), F.col("l0"))[1])
    counts = met.groupBy("shape").agg(F.count("*").alias("n"), _r(reach, "reach"))
    return joined(counts, percentiles(met, ["shape"], "q", {"median": 0.5}), ["shape"]).withColumn("median", F.round("median", 6))


@query(_LOSSES + "SELECT tree_id, round(la, 3) AS la FROM wide WHERE isfinite(la) AND la < l0 AND la > 0.5 * l0 ORDER BY la DESC, tree_id LIMIT 5")
def w07_worst_maxiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst of those that were still falling when they ran out of rounds (the loss fell, and by
    less than half): the limit is the feature."""
    rows = panels._wide(spark, sf_dir).where(is_finite(F.col("la")) & (F.col("la") < F.col("l0")) & (F.col("la") > 0.5 * F.col("l0")))
    return rows.orderBy(F.desc("la"), "tree_id").limit(5).select("tree_id", _r(F.col("la"), "la", 3))


@query("""SELECT 'form' AS form, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS forms FROM part""")
def y02_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one structure, each part with its own: they all have one normal form."""
    spelled = F.element_at(F.array(*map(F.lit, ("c0 + c1 * x0", "c1 * x0 + c0", "c3 + x0 * c2", "x0 * c9 + c1"))), F.col("p_partkey").cast("int") % 4 + 1)
    from ..sources.texts import parsed

    rows = p.read(spark, sf_dir, "part").select(search.read_out(parsed(spelled))["canonical"].alias("form"))
    return rows.groupBy(F.lit("form").alias("form")).agg(F.count("*").alias("n"), F.count_distinct(F.col("form")).alias("forms"))


#: Spellings, and the class of structure that each is of.
_SPELLED = (
    ("c0 + c1 * x0", 0), ("x0 * c9 + c1", 0), ("(x0 + c0) * c1", 1), ("c0 * x0 + c0 * c1", 1), ("c0 * x0 * x1", 2), ("x1 * (c0 * x0)", 2), ("c0 - x0", 3), ("-(x0 - c0)", 3),
    ("x0 - c0", 4), ("sin(x0 * (c1 + x1))", 5), ("sin(x1 * x0 + x0 * c2)", 5), ("sin(x0 * (c1 - x1))", 6), ("c0 / (x0 + c1)", 7), ("(x0 + c0) / c1", 8), ("x0 ^ c0", 9), ("c0 ^ x0", 10),
)
_CLASSES = ", ".join(f"({i}, {of})" for i, (_, of) in enumerate(_SPELLED))


@query(f"""SELECT of, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS forms, (SELECT CAST(count(DISTINCT of) AS BIGINT) FROM part JOIN (VALUES {_CLASSES}) s(i, of) ON p_partkey % {len(_SPELLED)} = i) AS all_forms
FROM part JOIN (VALUES {_CLASSES}) s(i, of) ON p_partkey % {len(_SPELLED)} = i GROUP BY of""")
def y02_equal_and_unequal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of eleven structures, each part with its own: one normal form a structure, and as
    many normal forms as structures."""
    from ..sources.texts import parsed

    i = F.col("p_partkey").cast("int") % len(_SPELLED) + 1
    text, of = (F.element_at(F.array(*(F.lit(s[j]) for s in _SPELLED)), i) for j in (0, 1))
    rows = p.read(spark, sf_dir, "part").select(of.alias("of"), search.read_out(parsed(text))["canonical"].alias("form"))
    every = rows.agg(F.count_distinct("form").alias("all_forms"))
    return rows.groupBy("of").agg(F.count("*").alias("n"), F.count_distinct("form").alias("forms")).crossJoin(F.broadcast(every))  # one row


@query()
def t12_generated_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random tree of each preset for every part, and what the presets come out as."""
    # by number: the table is small beside the work on its rows, and one file would be one task
    part = kept(p.read(spark, sf_dir, "part").select("p_partkey").repartition(workload.tasks(spark), "p_partkey"))
    made = [part.select(F.lit(name).alias("preset"), workload.generated(F.col("p_partkey"), name, 3).alias("nodes")) for name in workload.PRESETS]
    rows = made[0].unionByName(made[1]).unionByName(made[2]).withColumn("k", t.constant_count(F.col("nodes")))
    return rows.groupBy("preset").agg(
        F.count("*").alias("n"), _r(F.avg(F.size("nodes")), "mean_nodes", 3), _r(F.avg("k"), "mean_k", 3), _r(F.avg((F.col("k") == 0).cast("double")), "k0", 4), F.max(t.tree_depth(F.col("nodes"))).alias("max_depth")
    )


@query()
def n01_h08_sampled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points drawn for every part from two seeds, a train and a test set, with a known law's R² on both."""
    rows = p.read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    out = []
    for split, seed in (("train", 1), ("test", 100_001)):
        x = workload.sampled(rows, [(0.5, 2.5), (0.5, 2.5)], seed, "p_partkey").withColumn("split", F.lit(split))
        y = 2.0 * F.col("x")[0] + F.sin(F.col("x")[1])
        out.append(x.withColumn("y", y + 0.01 * search.gaussian(seed, "p_partkey")).withColumn("yh", y))
    r2 = scoring.r_squared(F.col("y"), F.col("yh"))
    return out[0].unionByName(out[1]).groupBy("p_brand", "split").agg(F.count("*").alias("n"), _r(r2, "r2", 4))


@query("""WITH e AS (SELECT user_id AS problem, event_type AS engine, min(value) AS best FROM events GROUP BY ALL)
SELECT engine, CAST(count(*) AS BIGINT) AS firsts FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY best, engine) AS rn FROM e) WHERE rn = 1 GROUP BY engine""")
def w13_a18_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many problems each engine is first."""
    best = p.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("problem"), F.col("event_type").alias("engine")).agg(F.min("value").alias("best"))
    rn = F.row_number().over(Window.partitionBy("problem").orderBy("best", "engine"))
    return best.withColumn("rn", rn).where("rn = 1").groupBy("engine").agg(F.count("*").alias("firsts"))
