"""Queries of the instruction set, numeric guards and tree structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ops
from . import population as p
from . import trees as t
from .registry import query

#: Operands from the line items: a takes both signs and zero, b too.
_OPERANDS = "SELECT (l_quantity - 25) / 5 AS a, (l_discount - 0.05) * 50 AS b FROM lineitem"


def _operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = p.read(spark, sf_dir, "lineitem")
    return items.select(((F.col("l_quantity") - 25) / 5).alias("a"), ((F.col("l_discount") - 0.05) * 50).alias("b"))


def _classified(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """name with the numbers of NaN and infinities and the sum of the finite values, one pass for all."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("v")) for k, v in values.items()))).alias("e")
    v = F.col("v")
    return (
        rows.select(pairs)
        .select("e.name", "e.v")
        .groupBy("name")
        .agg(
            F.count_if(F.isnan(v)).alias("n_nan"),
            F.count_if(v == ops.INF).alias("n_up"),
            F.count_if(v == -ops.INF).alias("n_down"),
            F.round(F.sum(F.when(ops.is_finite(v), v)), 4).alias("total"),
        )
    )


def _classified_sql(values: dict[str, str], source: str = _OPERANDS) -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({v} AS DOUBLE) AS v FROM o" for k, v in values.items())
    return f"""WITH o AS ({source}), e AS ({parts})
SELECT name, CAST(count(*) FILTER (isnan(v)) AS BIGINT) AS n_nan, CAST(count(*) FILTER (v = 'inf'::DOUBLE) AS BIGINT) AS n_up,
  CAST(count(*) FILTER (v = '-inf'::DOUBLE) AS BIGINT) AS n_down, round(sum(CASE WHEN isfinite(v) THEN v END), 4) AS total FROM e GROUP BY name"""


_DIV = "CASE WHEN {r} = 0 THEN ({l}) * pow({r}, -1.0) ELSE ({l}) / ({r}) END"
_LOG = "CASE WHEN {a} > 0 THEN ln({a}) WHEN {a} = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"
_BINARY_SQL = {
    "ADD": "a + b", "SUB": "a - b", "MUL": "a * b", "DIV": _DIV.format(l="a", r="b"), "LOOSE_DIV": _DIV.format(l="a", r="b"),
    "POW": "pow(a, b)", "LOOSE_POW": "pow(abs(a), b)", "MAX": "greatest(a, b)", "MIN": "least(a, b)",
    "LT": "CASE WHEN a < b THEN 1 ELSE 0 END", "GT": "CASE WHEN a > b THEN 1 ELSE 0 END",
    "LE": "CASE WHEN a <= b THEN 1 ELSE 0 END", "GE": "CASE WHEN a >= b THEN 1 ELSE 0 END",
}
_UNARY_SQL = {
    "SIN": "sin(a)", "COS": "cos(a)", "TAN": "tan(a)", "SINH": "sinh(a)", "COSH": "cosh(a)", "TANH": "tanh(a)",
    "LOG": _LOG.format(a="a"), "LOOSE_LOG": _LOG.format(a="abs(a)"), "EXP": "exp(a)", "INV": _DIV.format(l="1.0", r="a"),
    "LOOSE_INV": _DIV.format(l="1.0", r="a"), "NEG": "-a", "ABS": "abs(a)", "SQRT": "CASE WHEN a < 0 THEN 'nan'::DOUBLE ELSE sqrt(a) END",
    "LOOSE_SQRT": "sqrt(abs(a))",
}


@query(_classified_sql(_BINARY_SQL))
def e01_e13_binary_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _classified(_operands(spark, sf_dir), {op.name: op.column(a, b) for op in ops.TABLE if op.arity == 2})


@query(_classified_sql(_UNARY_SQL))
def e14_e28_unary_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(_operands(spark, sf_dir), {op.name: op.column(F.col("a")) for op in ops.TABLE if op.arity == 1})


_PARTIALS_SQL = {
    "DIV_left": "1 / b", "DIV_right": "-(a / b) / b", "POW_left": "b * pow(a, b - 1)", "POW_right": "pow(a, b) * ln(a)", "MAX_left": "CASE WHEN a >= b THEN 1 ELSE 0 END",
    "MIN_left": "CASE WHEN a <= b THEN 1 ELSE 0 END", "TAN": "1 + tan(a) * tan(a)", "TANH": "1 - tanh(a) * tanh(a)", "LOG": "1 / a", "INV": "-(1 / a) * (1 / a)",
    "SQRT": "1 / (2 * sqrt(a))", "ABS": "sign(a)", "SIN": "cos(a)", "COS": "-sin(a)", "SINH": "cosh(a)", "COSH": "sinh(a)", "EXP": "exp(a)",
}


@query(_classified_sql(_PARTIALS_SQL, "SELECT l_quantity / 10 AS a, l_discount * 10 + 0.5 AS b FROM lineitem"))
def e_local_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opcodes' local derivatives, where all of them are finite."""
    rows = p.read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10 + 0.5).alias("b"))
    a, b = F.col("a"), F.col("b")
    values = {}
    for name in _PARTIALS_SQL:
        op = ops.BY_NAME[name.split("_")[0]]
        operands = (a, b)[: op.arity]
        values[name] = op.partials(ops.Columns, *operands, op.column(*operands))[int(name.endswith("right"))]
    return _classified(rows, values)


_GUARD_SQL = {
    "residual": "CASE WHEN isnan(q) OR q = 'inf'::DOUBLE THEN 1e10 WHEN q = '-inf'::DOUBLE THEN -1e10 ELSE q END",
    "jacobian": "CASE WHEN isfinite(q) THEN q ELSE 0 END",
    "sentinel": "CASE WHEN isfinite(q) THEN q ELSE 1e6 END",
    "clamped": "CASE WHEN isfinite(q) THEN greatest(q, 0) ELSE 0 END",
    "annihilated": "CASE WHEN b = 0 OR q = 0 THEN 0 ELSE b * q END",
    "three_decimals": "CASE WHEN abs(b) < 1e-4 THEN 0 ELSE round(b, 3) END",
}


@query(_classified_sql(_GUARD_SQL, f"SELECT a, b, {_DIV.format(l='a', r='b')} AS q FROM ({_OPERANDS})"))
def e30_e36_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _operands(spark, sf_dir).withColumn("q", ops.divide(F.col("a"), F.col("b")))
    q, b = F.col("q"), F.col("b")
    return _classified(
        rows,
        {
            "residual": ops.residual_guard(q),
            "jacobian": ops.jacobian_guard(q),
            "sentinel": ops.point_sentinel(q),
            "clamped": ops.clamp_zero(q),
            "annihilated": ops.annihilating(b, q),
            "three_decimals": ops.small_to_zero(b),
        },
    )


@query("""SELECT o_orderpriority AS k, round(sum(round(o_totalprice * pow(10, 2 - floor(log10(o_totalprice)))) / pow(10, 2 - floor(log10(o_totalprice)))), 2) AS total
FROM orders GROUP BY 1""")
def e36_significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.sum(ops.significant(F.col("o_totalprice"), 3)), 2).alias("total"))


#: What the shapes of the population have, counted by hand.
_SHAPE_SQL = """WITH s AS (SELECT * FROM (VALUES (0, 5, 3, 2, 2, 2), (1, 5, 3, 2, 2, 9), (2, 11, 5, 3, 3, 5), (3, 9, 6, 3, 3, 12), (4, 5, 3, 2, 2, 5),
  (5, 8, 5, 3, 3, 11), (6, 8, 5, 3, 2, 11), (7, 3, 2, 2, 0, 1)) v(shape, n_nodes, depth, stack, k, cost))
"""


@query(_SHAPE_SQL + "SELECT shape, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(depth AS BIGINT) AS depth, CAST(stack AS BIGINT) AS stack, CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM s, supplier GROUP BY ALL")
def t01_t04_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, depth, stack and constants of every tree, counted by shape."""
    nodes = F.col("nodes")
    rows = p.trees(spark, sf_dir).select(
        "shape", F.size(nodes).alias("n_nodes"), t.tree_depth(nodes).alias("depth"), t.depth_need(nodes).alias("stack"), t.constant_count(nodes).alias("k")
    )
    return rows.groupBy("shape", *(F.col(c).cast("long").alias(c) for c in ("n_nodes", "depth", "stack", "k"))).agg(F.count("*").alias("n"))


@query(_SHAPE_SQL + """SELECT shape, CAST(pos AS BIGINT) AS pos, CAST(span AS BIGINT) AS span, CAST(count(*) AS BIGINT) AS n FROM
(VALUES (0, 0, 5), (0, 1, 1), (0, 2, 3), (1, 0, 5), (1, 1, 1), (1, 2, 3), (2, 0, 11), (2, 1, 1), (2, 2, 9), (3, 0, 9), (3, 1, 7), (3, 2, 1), (4, 0, 5), (4, 1, 1), (4, 2, 3),
 (5, 0, 8), (5, 1, 6), (5, 2, 1), (6, 0, 8), (6, 1, 6), (6, 2, 1), (7, 0, 3), (7, 1, 1), (7, 2, 1)) v(shape, pos, span), supplier GROUP BY ALL""")
def t04_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the subtree at each of the first three places."""
    rows = p.trees(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.select("shape", F.col("pos").cast("long").alias("pos"), t.span(F.col("nodes"), F.col("pos")).cast("long").alias("span"))
    return rows.groupBy("shape", "pos", "span").agg(F.count("*").alias("n"))


@query(_SHAPE_SQL + "SELECT shape, TRUE AS in_order, FALSE AS loose, CAST(count(*) AS BIGINT) AS n FROM s, supplier GROUP BY ALL")
def t10_f04_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees whose constants are numbered in order, and those with an ambiguous LOOSE opcode."""
    rows = p.trees(spark, sf_dir)
    return rows.groupBy("shape", t.constants_in_order(F.col("nodes")).alias("in_order"), t.has_divergent_loose(F.col("nodes")).alias("loose")).agg(F.count("*").alias("n"))


_OPCODES_SQL = """WITH u AS (SELECT * FROM (VALUES ('ADD', 9), ('MUL', 10), ('POW', 1), ('EXP', 1), ('NEG', 1), ('DIV', 1), ('SIN', 1), ('LOG', 1)) v(opcode, per)),
m AS (SELECT count(*) AS m FROM supplier)
SELECT opcode, CAST(per * m AS BIGINT) AS n, round(per / (SELECT sum(per) FROM u), 6) AS share FROM u, m"""


@query(_OPCODES_SQL)
def a12_opcode_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = p.trees(spark, sf_dir).select(F.explode("nodes").alias("n")).where("n.nt >= 2")
    counts = nodes.groupBy(t.opcode_name(F.col("n.nv")).alias("opcode")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""WITH e AS (SELECT s_nationkey AS run, opcode, per FROM supplier,
  (VALUES ('ADD', 9), ('MUL', 10), ('POW', 1), ('EXP', 1), ('NEG', 1), ('DIV', 1), ('SIN', 1), ('LOG', 1)) v(opcode, per))
SELECT run, opcode, CAST(sum(per) AS BIGINT) AS n FROM e GROUP BY ROLLUP (run, opcode)""")
def a13_opcode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opcode counts by run (a nation's suppliers), by run alone and in all."""
    runs = p.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("problem_id"), F.col("s_nationkey").alias("run"))
    nodes = p.trees(spark, sf_dir).join(runs, "problem_id").select("run", F.explode("nodes").alias("n")).where("n.nt >= 2")
    return nodes.rollup("run", t.opcode_name(F.col("n.nv")).alias("opcode")).agg(F.count("*").alias("n"))


@query(_SHAPE_SQL + """SELECT round(avg(n_nodes), 6) AS mean_nodes, round(avg(k), 6) AS mean_k, round(avg(depth), 6) AS mean_depth, CAST(max(n_nodes) AS BIGINT) AS max_nodes,
  round(avg(CASE WHEN k = 0 THEN 1 ELSE 0 END), 6) AS k0, round(avg(CASE WHEN k >= 2 THEN 1 ELSE 0 END), 6) AS k2, round(quantile_cont(n_nodes, 0.5), 6) AS p50, round(quantile_cont(n_nodes, 0.9), 6) AS p90
FROM s, supplier""")
def a14_population_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.size("nodes"), F.size("c")
    return p.trees(spark, sf_dir).agg(
        F.round(F.avg(n), 6).alias("mean_nodes"), F.round(F.avg(k), 6).alias("mean_k"), F.round(F.avg(t.tree_depth(F.col("nodes"))), 6).alias("mean_depth"),
        F.max(n).cast("long").alias("max_nodes"), F.round(F.avg((k == 0).cast("double")), 6).alias("k0"), F.round(F.avg((k >= 2).cast("double")), 6).alias("k2"),
        F.round(F.percentile(n, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(n, F.lit(0.9)), 6).alias("p90"),
    )


@query(_SHAPE_SQL + "SELECT s_nationkey AS run, CAST(sum(cost) AS BIGINT) AS cost FROM s, supplier GROUP BY 1")
def e37_cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted operations of each run's trees."""
    runs = p.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("problem_id"), F.col("s_nationkey").alias("run"))
    cost = F.element_at(F.array(*(F.lit(op.cost) for op in ops.TABLE)), F.col("n.nv").cast("int"))
    nodes = p.trees(spark, sf_dir).join(runs, "problem_id").select("run", F.explode("nodes").alias("n")).where("n.nt >= 2")
    return nodes.groupBy("run").agg(F.sum(cost).alias("cost"))


@query("""WITH s AS (SELECT s_suppkey * 8 + shape AS tree_id, n_nodes, k FROM supplier, (VALUES (0, 5, 2), (1, 5, 2), (2, 11, 3), (3, 9, 3), (4, 5, 2), (5, 8, 3), (6, 8, 2), (7, 3, 0)) v(shape, n_nodes, k))
SELECT tree_id, CAST(sum(n_nodes) OVER (ORDER BY tree_id) - n_nodes AS BIGINT) AS node_offset, CAST(sum(k) OVER (ORDER BY tree_id) - k AS BIGINT) AS c_offset FROM s""")
def w11_prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each tree's nodes and constants begin in flat arrays, without one task for all trees."""
    rows = p.trees(spark, sf_dir).select("tree_id", F.size("nodes").alias("n"), F.size("c").alias("k"))
    rows = rows.withColumn("bucket", F.floor(F.col("tree_id") / 4096))
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("k").alias("bk"))
    over = Window.orderBy("bucket")
    sums = sums.select("bucket", (F.sum("bn").over(over) - F.col("bn")).alias("n0"), (F.sum("bk").over(over) - F.col("bk")).alias("k0"))
    own = Window.partitionBy("bucket").orderBy("tree_id")
    out = rows.withColumns({"nn": F.sum("n").over(own) - F.col("n"), "kk": F.sum("k").over(own) - F.col("k")}).join(sums, "bucket")
    return out.select("tree_id", (F.col("n0") + F.col("nn")).cast("long").alias("node_offset"), (F.col("k0") + F.col("kk")).cast("long").alias("c_offset"))
