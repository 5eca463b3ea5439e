"""Queries of sweep records: orders stand for a benchmark's records, priorities and customers for its grid.

A record has preset (priority), M (1000 times one of five sizes), seed (one of three), backend (by
status), throughput (total price / 1000), and when it was written (order date, then key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records as r
from ..operators.ranking import joined, percentiles
from ..sources.shared import kept
from . import population as p
from .registry import query

_REC = """WITH rec AS (SELECT o_orderkey AS id, o_orderpriority AS preset, 1000 * (1 + o_custkey % 5) AS m, o_custkey % 7 AS seed, o_orderstatus AS backend,
  o_totalprice / 1000 AS throughput, o_orderdate AS at_, o_orderkey % 13 = 0 AS failed FROM orders)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = p.read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("preset"), (1000 * (1 + F.col("o_custkey") % 5)).alias("m"), (F.col("o_custkey") % 7).alias("seed"),
        F.col("o_orderstatus").alias("backend"), (F.col("o_totalprice") / 1000).alias("throughput"), F.col("o_orderdate").alias("at_"), (F.col("o_orderkey") % 13 == 0).alias("failed"),
    )


def _r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


_PLAN = _REC + """, plan AS (SELECT preset, m, seed, backend FROM (SELECT DISTINCT preset FROM rec), (SELECT DISTINCT m FROM rec), (SELECT DISTINCT seed FROM rec), (SELECT DISTINCT backend FROM rec)),
done AS (SELECT DISTINCT preset, m, seed, backend FROM rec WHERE NOT failed AND throughput > 400)"""
_KEY = ["preset", "m", "seed", "backend"]


def _plan(records: DataFrame) -> DataFrame:
    return r.plan(*(records.select(c).distinct() for c in _KEY))


def _done(records: DataFrame) -> DataFrame:
    return records.where(~F.col("failed") & (F.col("throughput") > 400)).select(*_KEY).distinct()


@query(_PLAN + "SELECT preset, backend, CAST(count(*) AS BIGINT) AS n FROM plan GROUP BY ALL")
def j14_j15_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of all configurations."""
    return _plan(_records(spark, sf_dir)).groupBy("preset", "backend").agg(F.count("*").alias("n"))


@query(_PLAN + "SELECT preset, CAST(m AS BIGINT) AS m, CAST(seed AS BIGINT) AS seed, backend FROM plan ANTI JOIN done USING (preset, m, seed, backend)")
def j09_j10_u03_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed sweep still has to run."""
    rec = _records(spark, sf_dir)
    return r.missing(_plan(rec), _done(rec), _KEY)


@query(_PLAN + "SELECT preset, CAST(count(*) AS BIGINT) AS n FROM plan SEMI JOIN done USING (preset, m, seed, backend) GROUP BY 1")
def j11_done_in_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    return _plan(rec).join(_done(rec), _KEY, "left_semi").groupBy("preset").agg(F.count("*").alias("n"))


_LAST = _REC + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY preset, m, seed, backend ORDER BY at_ DESC, id DESC) AS rn FROM rec) WHERE rn = 1)"""


@query(_LAST + "SELECT preset, CAST(m AS BIGINT) AS m, CAST(seed AS BIGINT) AS seed, backend, CAST(id AS BIGINT) AS id, round(throughput, 6) AS throughput FROM last")
def u05_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.last_wins(_records(spark, sf_dir), _KEY, [F.col("at_"), F.col("id")])
    return rows.select(*_KEY, "id", _r(F.col("throughput"), "throughput"))


@query(_PLAN + """, state AS (SELECT preset, m, seed, backend, bool_or(NOT failed AND throughput > 400) AS ok FROM rec GROUP BY ALL)
SELECT CASE WHEN ok THEN 'completed' WHEN ok IS NULL THEN 'missing' ELSE 'skipped' END AS state, CAST(count(*) AS BIGINT) AS n FROM plan LEFT JOIN state USING (preset, m, seed, backend) GROUP BY 1""")
def h02_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration of the plan is completed, skipped or missing; completed wins."""
    rec = _records(spark, sf_dir)
    return r.accounted(_plan(rec), rec.withColumn("ok", ~F.col("failed") & (F.col("throughput") > 400)), _KEY).groupBy("state").agg(F.count("*").alias("n"))


_FOOT = "(m * (12.0 * 4 * 8 + 8 * 1000) * (1 + seed) * 4 / 1e6)"


@query(_PLAN + f"""SELECT CASE WHEN {_FOOT} > 600 THEN 'skip: memory' WHEN m * 1000.0 / (1 + seed) > 2500000 THEN 'skip: time' ELSE 'run' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM plan GROUP BY 1""")
def f09_f10_h03_h04_run_or_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict and its reason for each configuration, from its projected memory and time."""
    foot = F.col("m") * (12.0 * 4 * 8 + 8 * 1000) * (1 + F.col("seed")) * 4 / 1e6
    time = r.projected_time(F.col("m"), F.lit(1000.0), 1 + F.col("seed"))
    return _plan(_records(spark, sf_dir)).groupBy(r.verdict({"skip: memory": foot > 600, "skip: time": time > 2_500_000}, "run").alias("verdict")).agg(F.count("*").alias("n"))


@query(_REC + "SELECT preset, backend, CAST(count(*) AS BIGINT) AS reps, round(quantile_cont(throughput, 0.5), 6) AS med, round(min(throughput), 6) AS low, round(max(throughput), 6) AS high, round(quantile_cont(throughput, 0.1), 6) AS p10 FROM rec GROUP BY ALL")
def h23_throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, by, rows = F.col("throughput"), ["preset", "backend"], _records(spark, sf_dir)
    ends = rows.groupBy(*by).agg(F.count("*").alias("reps"), _r(F.min(v), "low"), _r(F.max(v), "high"))
    met = joined(ends, percentiles(rows, by, "throughput", {"med": 0.5, "p10": 0.1}), by)
    return met.withColumns({"med": F.round("med", 6), "p10": F.round("p10", 6)})


_CELL = _REC + """, cell AS (SELECT preset, m, seed, quantile_cont(CASE WHEN backend = 'F' THEN throughput END, 0.5) AS f, quantile_cont(CASE WHEN backend = 'O' THEN throughput END, 0.5) AS o
  FROM rec GROUP BY preset, m, seed)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cell, the backends' medians side by side."""
    cell = ["preset", "m", "seed"]
    rows = percentiles(_records(spark, sf_dir), [*cell, "backend"], "throughput", {"med": 0.5})
    med = lambda b: F.max(F.when(F.col("backend") == b, F.col("med")))
    return rows.groupBy(*cell).agg(med("F").alias("f"), med("O").alias("o"))


@query(_CELL + "SELECT preset, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(f / o, 0.5), 6) AS median, round(min(f / o), 6) AS low, round(max(f / o), 6) AS high, CAST(arg_max(m * 10 + seed, f / o) AS BIGINT) AS at_cell FROM cell WHERE f > 0 AND o > 0 GROUP BY preset")
def a36_a37_j06_speed_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of two backends over the cells that both have, and where they are largest."""
    q, rows = F.col("q"), kept(_cells(spark, sf_dir).where("f > 0 and o > 0").withColumn("q", F.col("f") / F.col("o")))
    ends = rows.groupBy("preset").agg(F.count("*").alias("n"), _r(F.min(q), "low"), _r(F.max(q), "high"), F.max_by(F.col("m") * 10 + F.col("seed"), q).alias("at_cell"))
    return joined(ends, percentiles(rows, ["preset"], "q", {"median": 0.5}), ["preset"]).withColumn("median", F.round("median", 6))


@query(_REC + "SELECT preset, CAST(m AS BIGINT) AS m, CAST(count(DISTINCT backend) AS BIGINT) AS backends, count(DISTINCT backend) = 1 AS one FROM rec GROUP BY preset, m")
def j08_group_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cell's records all agree."""
    n = F.count_distinct("backend")
    return _records(spark, sf_dir).groupBy("preset", "m").agg(n.alias("backends"), (n == 1).alias("one"))


@query(_REC + """, s AS (SELECT preset, m, median(throughput) AS med, max(throughput) / min(throughput) - 1 AS spread FROM rec WHERE throughput > 0 GROUP BY preset, m)
SELECT preset, CAST(m AS BIGINT) AS m, CASE WHEN spread <= 0.25 THEN round(med * 2, 4) END AS projected FROM s""")
def m12_project_or_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the median, unless the cell's values lie more than a quarter apart."""
    v = F.col("throughput")
    rows = _records(spark, sf_dir).where(v > 0)
    ends = rows.groupBy("preset", "m").agg((F.max(v) / F.min(v) - 1).alias("spread"))
    cells = joined(ends, percentiles(rows, ["preset", "m"], "throughput", {"med": 0.5}), ["preset", "m"])
    return cells.select("preset", "m", F.when(F.col("spread") <= 0.25, F.round(F.col("med") * 2, 4)).alias("projected"))


@query(_REC + "SELECT preset, backend, round(regr_slope(throughput, m), 9) AS slope, round(regr_intercept(throughput, m), 4) AS intercept, round(regr_r2(throughput, m), 6) AS r2 FROM rec GROUP BY ALL")
def m06_line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("throughput"), F.col("m").cast("double")
    return _records(spark, sf_dir).groupBy("preset", "backend").agg(_r(F.regr_slope(y, x), "slope", 9), _r(F.regr_intercept(y, x), "intercept", 4), _r(F.regr_r2(y, x), "r2"))


_CV = """, g AS (SELECT preset, backend, avg(throughput) AS mean, coalesce(stddev_samp(throughput), 0) AS sd FROM rec GROUP BY ALL),
w AS (SELECT f.preset, f.mean / o.mean AS x, sqrt(pow(f.sd / f.mean, 2) + pow(o.sd / o.mean, 2)) AS band FROM g f JOIN g o USING (preset) WHERE f.backend = 'F' AND o.backend = 'O')"""


@query(_REC + _CV + "SELECT preset, round(x, 6) AS multiplier, round(x * (1 - band), 6) AS low, round(x * (1 + band), 6) AS high FROM w")
def m11_crossover_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio of means with the variation of both sides carried over."""
    side = lambda b: (
        _records(spark, sf_dir).where(F.col("backend") == b).groupBy("preset").agg(F.avg("throughput").alias(f"m{b}"), F.coalesce(F.stddev_samp("throughput"), F.lit(0.0)).alias(f"s{b}"))
    )
    x, band = r.ratio_with_band(F.col("mF"), F.col("sF"), F.col("mO"), F.col("sO"))
    return side("F").join(side("O"), "preset").select("preset", _r(x, "multiplier"), _r(x * (1 - band), "low"), _r(x * (1 + band), "high"))


@query(_REC + """, g AS (SELECT preset, m, avg(throughput) AS t FROM rec GROUP BY ALL), l AS (SELECT *, t - lag(t) OVER (PARTITION BY preset ORDER BY m) AS step FROM g)
SELECT preset, CAST(m AS BIGINT) AS m, round(step / 1000, 6) AS slope, CAST(sum(CASE WHEN coalesce(step, 0) < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY preset ORDER BY m) AS BIGINT) AS falls FROM l""")
def w09_segment_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes between neighbouring sizes and how often they fell so far."""
    over = Window.partitionBy("preset").orderBy("m")
    g = _records(spark, sf_dir).groupBy("preset", "m").agg(F.avg("throughput").alias("t")).withColumn("step", F.col("t") - F.lag("t").over(over))
    return g.select("preset", "m", _r(F.col("step") / 1000, "slope"), F.sum((F.coalesce("step", F.lit(0.0)) < 0).cast("long")).over(over).alias("falls"))


@query(_REC + """, g AS (SELECT preset, seed + 1 AS cores, avg(throughput) AS t FROM rec GROUP BY ALL), one AS (SELECT preset, t AS t1 FROM g WHERE cores = 1)
SELECT preset, CAST(cores AS BIGINT) AS cores, round(t / t1 / cores, 6) AS efficiency FROM g JOIN one USING (preset)""")
def h21_parallel_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _records(spark, sf_dir).groupBy("preset", (F.col("seed") + 1).alias("cores")).agg(F.avg("throughput").alias("t"))
    one = g.where("cores = 1").select("preset", F.col("t").alias("t1"))
    return g.join(one, "preset").select("preset", "cores", _r(F.col("t") / F.col("t1") / F.col("cores"), "efficiency"))


@query(_REC + "SELECT backend, round(sum(throughput * m) / 1e6, 4) AS points FROM rec GROUP BY 1")
def h07_points_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("backend").agg(_r(F.sum(F.col("throughput") * F.col("m")) / 1e6, "points", 4))


@query(_REC + """, g AS (SELECT preset, m, avg(throughput) AS t FROM rec GROUP BY ALL)
SELECT preset, CAST(m AS BIGINT) AS m, round(t, 4) AS t FROM (SELECT *, row_number() OVER (PARTITION BY preset ORDER BY t DESC, m) AS rn FROM g) WHERE rn = 1""")
def w13_recommended_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _records(spark, sf_dir).groupBy("preset", "m").agg(F.avg("throughput").alias("t"))
    best = F.row_number().over(Window.partitionBy("preset").orderBy(F.desc("t"), "m"))
    return g.withColumn("rn", best).where("rn = 1").select("preset", "m", _r(F.col("t"), "t", 4))


@query(_REC + "SELECT preset || '__M' || m || '__s' || seed || '__' || lower(backend) AS cell, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY 1")
def y13_cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    name = F.concat(F.col("preset"), F.lit("__M"), F.col("m").cast("string"), F.lit("__s"), F.col("seed").cast("string"), F.lit("__"), F.lower("backend"))
    return rows.groupBy(name.alias("cell")).agg(F.count("*").alias("n"))


@query(_REC + """, ai AS (SELECT preset, m, 2.05 * m AS mflop, 0.388 * m AS mb, avg(throughput) AS t FROM rec GROUP BY preset, m)
SELECT preset, CAST(m AS BIGINT) AS m, round(mflop / mb, 6) AS intensity, round(mflop * t / 1e6, 6) AS gflops, round(100 * mflop * t / 1e6 / 19500, 6) AS pct_peak FROM ai""")
def m13_roofline(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _records(spark, sf_dir).groupBy("preset", "m").agg(F.avg("throughput").alias("t"))
    ai, gflops, pct = r.roofline(F.lit(2.05) * F.col("m"), F.lit(0.388) * F.col("m"), F.col("t"), 19500.0)
    return g.select("preset", "m", _r(ai, "intensity"), _r(gflops, "gflops"), _r(pct, "pct_peak"))


@query(_REC + """, g AS (SELECT backend, iters, count(*) AS n FROM (SELECT backend, id % 50 AS iters FROM rec) GROUP BY ALL), c AS (SELECT backend, iters, sum(n) OVER (PARTITION BY backend ORDER BY iters) / sum(n) OVER (PARTITION BY backend) AS done FROM g)
SELECT backend, round(sum(1 - done), 6) AS mean_iters FROM c GROUP BY backend""")
def a40_done_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean iterations as the area above the curve of fits that have ended."""
    g = _records(spark, sf_dir).groupBy("backend", (F.col("id") % 50).alias("iters")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("backend")
    done = F.sum("n").over(own.orderBy("iters")) / F.sum("n").over(own)
    return g.withColumn("done", done).groupBy("backend").agg(_r(F.sum(1 - F.col("done")), "mean_iters"))
