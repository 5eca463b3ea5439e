"""Queries that decide on problems and judge what was found: admission, polynomials, recovery columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as a
from ..operators import judging
from ..sources.shared import kept
from . import population as p
from . import trees as t
from .registry import query

_CELLS = a.cells()
#: Positional inner constants of each family; 0 where none stands inside.
_INSIDE = {"damped": 2, "shift_quad": 0, "outer_only": 0}


def _values() -> str:
    rows = (f"({i}, '{name}', {c[1]!r}::DOUBLE, {c[2] if len(c) > 2 else 'NULL'}::DOUBLE, {low}::DOUBLE, {high}::DOUBLE, {_INSIDE.get(name, 1)})" for i, (name, _, c, (low, high)) in enumerate(_CELLS))
    return ", ".join(rows)


_BASIS = """CASE family WHEN 'freq_cos_x' THEN cos({0} * x) WHEN 'freq_sin_x2' THEN sin({0} * x * x) WHEN 'freq_cos_x3' THEN cos({0} * x * x * x)
  WHEN 'decay_exp' THEN exp(-{0} * x) WHEN 'saturation' THEN exp(-{0} * x) WHEN 'shift_recip' THEN 1 / (x - {0}) WHEN 'damped' THEN exp(-{0} * x) * cos({1} * x) ELSE pow(x, {0}) END"""
_ADMISSION = f"""WITH cell AS (SELECT * FROM (VALUES {_values()}) v(cell, family, c1, c2, low, high, inside)),
problem AS (SELECT s_suppkey AS problem_id, cell.* FROM supplier JOIN cell ON s_suppkey % {len(_CELLS)} = cell),
pts AS (SELECT problem.*, low + (high - low) * (l_quantity - 1) / 49 AS x FROM problem JOIN lineitem ON l_suppkey = problem_id),
linear AS (SELECT *, {_BASIS.format("c1", "c2")} AS y FROM pts WHERE family NOT IN ('shift_quad', 'outer_only', 'root_scale', 'phase', 'size_scale')),
ref AS (SELECT unnest([{", ".join(map(repr, a.REFERENCES))}])::DOUBLE AS r),
refs AS (SELECT a.r AS r1, b.r AS r2 FROM ref a, ref b),
grid AS (
  SELECT problem_id, r1, r2, regr_r2(y, {_BASIS.format("r1", "r2")}) AS r2_at FROM linear JOIN refs ON family = 'damped' OR r1 = r2 GROUP BY ALL),
worst AS (SELECT problem_id, min(r2_at) AS worst, max(r2_at) AS best FROM grid GROUP BY problem_id),
near AS (SELECT cell, arg_min(z, abs(z - c1)) AS z, min(abs(z - c1) / abs(c1)) AS off FROM cell, (SELECT unnest([{", ".join(map(repr, a.CANON))}])::DOUBLE AS z) WHERE family <> 'damped' GROUP BY cell),
canon AS (SELECT problem_id, regr_r2(y, {_BASIS.format("z", "z")}) AS at_canon FROM linear JOIN near USING (cell) WHERE off <= {a.STRUCT_TOL} GROUP BY problem_id),
said AS (
  SELECT problem.*, worst, best, at_canon, CASE WHEN inside = 0 THEN 'no_inner' WHEN family IN ('root_scale', 'phase') THEN 'fold' WHEN family = 'size_scale' THEN 'rank'
    WHEN at_canon >= {a.TAU_HIGH} THEN 'structural' WHEN worst < {a.TAU_LOW} THEN 'admit' ELSE 'ls_reject' END AS reason
  FROM problem LEFT JOIN worst USING (problem_id) LEFT JOIN canon USING (problem_id))
SELECT problem_id, family, reason = 'admit' AS admitted, reason, CAST(inside AS INTEGER) AS n_positional, CAST(CASE WHEN reason = 'fold' THEN 0 ELSE inside END AS INTEGER) AS n_inner,
  round(worst, 4) AS r2_linear, round(best, 4) AS r2_linear_best, CASE WHEN reason IN ('admit', 'ls_reject') THEN 1.0::DOUBLE END AS r2_full, CASE WHEN reason IN ('admit', 'ls_reject') THEN 0.0::DOUBLE END AS recovery
FROM said"""


@query(_ADMISSION)
def y04_y06_m01_m03_n07_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's problem, of the construction grid by its key, over its line items: admitted or why not."""
    suppliers = p.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("problem_id"))
    trees = F.array(*(p.node_literal(t.prefix(t.parse(tree))) for _, tree, _, _ in _CELLS))
    pick = lambda values: F.element_at(F.array(*values), F.pmod(F.col("problem_id"), F.lit(len(_CELLS))).cast("int") + 1)
    made = suppliers.select(
        F.col("problem_id").alias("tree_id"), "problem_id", pick(F.lit(name) for name, *_ in _CELLS).alias("family"), F.element_at(trees, F.pmod(F.col("problem_id"), F.lit(len(_CELLS))).cast("int") + 1).alias("nodes"),
        pick(F.array(*map(F.lit, c)) for _, _, c, _ in _CELLS).alias("c"), pick(F.array(*map(F.lit, span)) for *_, span in _CELLS).alias("span"),
    )
    made = kept(made)
    items = p.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("problem_id"), "l_quantity")
    low, high = F.col("span")[0], F.col("span")[1]
    points = items.join(made.select("problem_id", "span"), "problem_id").select("problem_id", F.array(low + (high - low) * (F.col("l_quantity") - 1) / 49).alias("x"))
    said = a.decided(made.drop("family", "span"), points, kept)
    r = lambda name, digits: F.round(name, digits).alias(name)
    met = made.select("tree_id", "problem_id", "family").join(said, "tree_id")
    return met.select("problem_id", "family", "admitted", "reason", "n_positional", "n_inner", r("r2_linear", 4), r("r2_linear_best", 4), r("r2_full", 6), r("recovery", 4))


@query("""WITH p AS (SELECT l_suppkey AS g, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem),
z1 AS (SELECT *, x - avg(x) OVER w AS a FROM p WINDOW w AS (PARTITION BY g)),
z2 AS (SELECT *, x * x - avg(x * x) OVER w - a * sum(x * x * a) OVER w / sum(a * a) OVER w AS b FROM z1 WINDOW w AS (PARTITION BY g)),
z3 AS (SELECT *, x * x * x - avg(x * x * x) OVER w - a * sum(x * x * x * a) OVER w / sum(a * a) OVER w - b * sum(x * x * x * b) OVER w / sum(b * b) OVER w AS c FROM z2 WINDOW w AS (PARTITION BY g)),
z4 AS (SELECT *, pow(x, 4) - avg(pow(x, 4)) OVER w - a * sum(pow(x, 4) * a) OVER w / sum(a * a) OVER w - b * sum(pow(x, 4) * b) OVER w / sum(b * b) OVER w - c * sum(pow(x, 4) * c) OVER w / sum(c * c) OVER w AS d FROM z3 WINDOW w AS (PARTITION BY g)),
s AS (SELECT g, regr_r2(y, a) AS r1, regr_r2(y, b) AS r2, regr_r2(y, c) AS r3, regr_r2(y, d) AS r4 FROM z4 GROUP BY g)
SELECT g AS problem_id, round(r1, 6) AS degree_1, round(r1 + r2, 6) AS degree_2, round(r1 + r2 + r3, 6) AS degree_3, round(r1 + r2 + r3 + r4, 6) AS degree_4, r1 + r2 + r3 + r4 >= 0.999 AS absorbable FROM s""")
def m10_polynomial_absorbable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each supplier's targets polynomials of degree 1 to 4 explain."""
    fits = a.polynomial_fits(p.points(spark, sf_dir), 4, kept)
    each = (F.round(F.col("r2")[i], 6).alias(f"degree_{i + 1}") for i in range(4))
    return fits.select("problem_id", *each, (F.col("r2")[3] >= 0.999).alias("absorbable"))


_JUDGED = f"""WITH {p.TREES_SQL},
cand AS (
  SELECT tree_id, problem_id, shape, way, CASE way WHEN 'near' THEN c0 * (1 + 1e-7) WHEN 'off' THEN c0 * 1.01 WHEN 'first' THEN c0 * 2 ELSE c0 END AS k0,
    CASE way WHEN 'near' THEN c1 * (1 + 1e-7) WHEN 'off' THEN c1 * 1.01 ELSE c1 END AS k1, CASE way WHEN 'near' THEN c2 * (1 + 1e-7) WHEN 'off' THEN c2 * 1.01 ELSE c2 END AS k2, c0, c1, c2
  FROM trees, (VALUES ('near'), ('off'), ('first')) v(way)),
forms AS (SELECT * FROM (VALUES ('digits'), ('decimals'), ('given')) f(form)),
r AS (
  SELECT tree_id, problem_id, shape, way, form, {", ".join(f"CASE form WHEN 'digits' THEN round({c} * pow(10, 2 - floor(log10(abs({c}))))) / pow(10, 2 - floor(log10(abs({c})))) WHEN 'decimals' THEN CASE WHEN abs({c}) < 1e-4 THEN 0 ELSE round({c}, 3) END ELSE {c} END AS r{c}" for c in ("c0", "c1", "c2", "k0", "k1", "k2"))}
  FROM cand, forms),
both_ AS (
  SELECT tree_id, shape, way, form, y, yh FROM (
    SELECT tree_id, shape, way, form, {p.EVALUATED_SQL.replace("c0", "rc0").replace("c1", "rc1").replace("c2", "rc2")} AS y, {p.EVALUATED_SQL.replace("c0", "rk0").replace("c1", "rk1").replace("c2", "rk2")} AS yh
    FROM r JOIN (SELECT problem_id, x0, x1, x2 FROM points) USING (problem_id))),
s AS (
  SELECT tree_id, shape, way, form, count(*) FILTER (isfinite(y) <> isfinite(yh)) AS split, max(abs(y - yh)) FILTER (isfinite(y) AND isfinite(yh)) AS far, max(abs(y)) FILTER (isfinite(y) AND isfinite(yh)) AS top,
    sum(y * yh) FILTER (isfinite(y) AND isfinite(yh)) / sum(yh * yh) FILTER (isfinite(y) AND isfinite(yh)) AS a, avg(y - yh) FILTER (isfinite(y) AND isfinite(yh)) AS b FROM both_ GROUP BY ALL),
d AS (
  SELECT s.tree_id, s.shape, s.way, s.form, any_value(split) AS split, any_value(far) AS far, any_value(greatest(1, top)) AS top, any_value(abs(a)) AS a,
    max(abs(y - a * yh)) AS scaled, max(abs(y - yh - b)) AS moved
  FROM s JOIN both_ USING (tree_id, shape, way, form) WHERE isfinite(y) AND isfinite(yh) GROUP BY ALL),
j AS (
  SELECT tree_id, shape, way, bool_or(form = 'digits' AND split = 0 AND far <= 1e-9 * top) AS strict,
    bool_or(split = 0 AND (form = 'digits' AND (scaled < 1e-9 * top AND a >= 1e-9 OR moved < 1e-9 * top) OR form = 'given' AND (scaled < 1e-4 * top AND a >= 1e-9 OR moved < 1e-4 * top))) AS close_,
    bool_or(split = 0 AND form = 'decimals' AND (far <= 1e-9 * top OR scaled < 1e-9 * top AND a >= 1e-9 OR moved < 1e-9 * top)) AS srbench
  FROM d GROUP BY ALL)
SELECT shape, way, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (strict) AS BIGINT) AS strict, CAST(count(*) FILTER (strict OR close_) AS BIGINT) AS lenient, CAST(count(*) FILTER (srbench) AS BIGINT) AS srbench FROM j GROUP BY ALL"""


@query(_JUDGED)
def y07_y09_y10_judge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree as a law, and three finds of it: nearly the same, off by a hundredth, and with the first
    constant doubled (a factor or an added constant, by the shape)."""
    truths = kept(p.trees(spark, sf_dir))
    ways = {"near": lambda v, i: v * (1 + 1e-7), "off": lambda v, i: v * 1.01, "first": lambda v, i: F.when(i == 0, v * 2).otherwise(v)}
    finds = None
    for place, (way, moved) in enumerate(ways.items()):
        one = truths.withColumns({"way": F.lit(way), "law": F.col("tree_id"), "tree_id": F.col("tree_id") * len(ways) + place, "c": F.transform("c", moved)})
        finds = one if finds is None else finds.unionByName(one)
    # a law for each tree: its points are those of the supplier
    said = judging.judged(finds.select("tree_id", "problem_id", "law", "nodes", "c"), truths, p.points(spark, sf_dir))
    met = said.join(finds.select("tree_id", "shape", "way"), "tree_id")
    return met.groupBy("shape", "way").agg(F.count("*").alias("n"), *(F.count_if(x).alias(x) for x in ("strict", "lenient", "srbench")))
