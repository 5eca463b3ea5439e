"""The population that the tables hold: a family of trees for each supplier, fitted to its line items.

Points are line items: x0 quantity / 10, x1 discount * 10, x2 tax * 10, y extended price / 10000.
Trees are eight shapes for each supplier, with constants from the supplier's key. SQL twins of the
same views are beside them; values in them are written out by hand, not generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees as t

SHAPES = (
    "c0 + c1 * x0",
    "c0 * x0 ^ c1",
    "c0 + (c1 * x0 + c2 * (x0 * x0))",
    "c0 * exp(-(c1 * x0)) + c2",
    "c0 / (x0 + c1)",
    "c0 * sin(c1 * x1) + c2",
    "c0 * log(x1 + x2) + c1",
    "x0 + x1",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id, i, x (array), y."""
    items = read(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return items.select(F.col("l_suppkey").alias("problem_id"), x.alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, problem_id, shape, nodes, c."""
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("problem_id"))
    n = len(SHAPES)
    nodes = F.array(*(node_literal(t.prefix(t.parse(text))) for text in SHAPES))
    made = suppliers.withColumn("shape", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    made = made.withColumn("nodes", F.element_at(nodes, F.col("shape") + 1))
    # 0.25 + ((11 key + 7 shape + 5 rank) mod 16) / 8
    constant = lambda k: F.lit(0.25) + ((F.col("problem_id") * 11 + F.col("shape") * 7 + k * 5) % 16) / F.lit(8.0)
    ranks = F.when(t.constant_count(F.col("nodes")) > 0, F.sequence(F.lit(0), t.constant_count(F.col("nodes")) - 1))
    made = made.withColumn("c", F.coalesce(F.transform(ranks, constant), F.array().cast("array<double>")))
    return made.select((F.col("problem_id") * n + F.col("shape")).alias("tree_id"), "problem_id", "shape", "nodes", "c")


def node_literal(nodes: list[t.Node]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("nt"), F.lit(b).cast("float").alias("nv"), F.lit(c).alias("ci")) for a, b, c in nodes))


#: Three engines, by what they make of the constants: as they are, a tenth less, a tenth more.
ENGINES = {"start": 1.0, "low": 0.9, "high": 1.1}


def variants(population: DataFrame) -> DataFrame:
    """The population under the three engines."""
    made = population.withColumn("engine", F.explode(F.array(*map(F.lit, ENGINES))))
    factor = F.element_at(F.create_map(*(F.lit(v) for pair in ENGINES.items() for v in pair)), F.col("engine"))
    return made.withColumn("c", F.transform("c", lambda v: v * factor))


TREES_SQL = """
points AS (SELECT l_suppkey AS problem_id, l_quantity / 10 AS x0, l_discount * 10 AS x1, l_tax * 10 AS x2, l_extendedprice / 10000 AS y FROM lineitem),
shapes AS (SELECT * FROM (VALUES (0, 2, 5), (1, 2, 5), (2, 3, 11), (3, 3, 9), (4, 2, 5), (5, 3, 8), (6, 2, 8), (7, 0, 3)) s(shape, k, n_nodes)),
trees AS (
  SELECT s_suppkey * 8 + shape AS tree_id, s_suppkey AS problem_id, shape, k, n_nodes,
    0.25 + ((s_suppkey * 11 + shape * 7) % 16) / 8.0 AS c0, 0.25 + ((s_suppkey * 11 + shape * 7 + 5) % 16) / 8.0 AS c1,
    0.25 + ((s_suppkey * 11 + shape * 7 + 10) % 16) / 8.0 AS c2
  FROM supplier, shapes),
engines AS (
  SELECT tree_id, problem_id, shape, k, n_nodes, engine, c0 * f AS c0, c1 * f AS c1, c2 * f AS c2
  FROM trees, (VALUES ('start', 1.0::DOUBLE), ('low', 0.9::DOUBLE), ('high', 1.1::DOUBLE)) e(engine, f))"""
EVALUATED_SQL = """CASE shape
    WHEN 0 THEN c0 + c1 * x0
    WHEN 1 THEN c0 * pow(x0, c1)
    WHEN 2 THEN c0 + (c1 * x0 + c2 * (x0 * x0))
    WHEN 3 THEN c0 * exp(-(c1 * x0)) + c2
    WHEN 4 THEN c0 / (x0 + c1)
    WHEN 5 THEN c0 * sin(c1 * x1) + c2
    WHEN 6 THEN c0 * (CASE WHEN x1 + x2 > 0 THEN ln(x1 + x2) ELSE '-inf'::DOUBLE END) + c1
    WHEN 7 THEN x0 + x1 END"""
LOSSES_SQL = (
    TREES_SQL
    + f""",
values_ AS (SELECT engine, tree_id, y, {EVALUATED_SQL} AS yh FROM engines JOIN points USING (problem_id)),
sums AS (
  SELECT engine, tree_id, 0.5 * sum(CASE WHEN isfinite(yh) THEN (yh - y) * (yh - y) END) AS half, bool_or(NOT isfinite(yh)) AS bad, count(*) AS n
  FROM values_ GROUP BY engine, tree_id),
losses AS (
  SELECT e.engine, e.tree_id, e.problem_id, e.shape, e.k, e.n_nodes,
    CASE WHEN bad THEN 'inf'::DOUBLE ELSE half END AS loss, n
  FROM engines e JOIN sums USING (engine, tree_id)),
wide AS (
  SELECT tree_id, problem_id, shape, k, max(CASE WHEN engine = 'start' THEN loss END) AS l0, max(CASE WHEN engine = 'low' THEN loss END) AS la,
    max(CASE WHEN engine = 'high' THEN loss END) AS lb FROM losses GROUP BY ALL)"""
)
