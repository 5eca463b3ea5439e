"""Queries of the search loop and of the record stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, search
from ..operators.refinement import TRIED, Refine, refined
from ..sources.shared import kept, new_path
from ..streaming.records import latest_by_key
from . import population as p
from .registry import query

_CANDIDATES_SQL = p.LOSSES_SQL + """,
fits AS (
  SELECT e.engine, e.problem_id, e.tree_id, e.shape, e.k, CASE WHEN isfinite(l.loss) THEN 2 * l.loss / l.n ELSE 'inf'::DOUBLE END AS worth
  FROM engines e LEFT JOIN losses l USING (engine, tree_id))"""


@query()
def g01_g05_memetic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memetic step over every supplier's population: fitted, written back, rolled back."""
    after = search.memetic_step(p.trees(spark, sf_dir), p.points(spark, sf_dir), 3, 6, kept)
    return after.select("tree_id", "problem_id", "outcome", F.round("loss_before", 3).alias("loss_before"), F.round("loss", 3).alias("loss"))


@query("""SELECT user_id, event_type, CAST(arg_max(event_id, event_id) AS BIGINT) AS event_id, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY ALL""")
def k04_record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records streamed from files in small batches; the table keeps the latest of each key."""
    path = new_path(spark, "stream-in")
    events = p.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    events.repartition(4, "event_id").write.parquet(path)
    out = latest_by_key(spark, path, events.schema, ["user_id", "event_type"], "event_id")
    return out.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("WITH " + _CANDIDATES_SQL + """,
r AS (SELECT problem_id, 3 * tree_id + CASE engine WHEN 'start' THEN 0 WHEN 'low' THEN 1 ELSE 2 END AS id, shape, k, worth FROM fits),
f AS (SELECT *, k > 0 AND row_number() OVER (PARTITION BY problem_id, shape ORDER BY worth, id) = 1 AS tried FROM r),
a AS (SELECT *, sum(CAST(tried AS INTEGER)) OVER (PARTITION BY problem_id ORDER BY worth, id ROWS UNBOUNDED PRECEDING) - CAST(tried AS INTEGER) AS before FROM f)
SELECT problem_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (k = 0) AS BIGINT) AS no_constants, CAST(count(*) FILTER (k > 0 AND NOT tried) AS BIGINT) AS repeats,
  CAST(count(*) FILTER (tried) AS BIGINT) AS tried, TRUE AS never_worse, TRUE AS as_scored FROM a WHERE before < 3 GROUP BY problem_id""")
def g03_g04_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of each supplier's candidates, of which only three different ones are refined: no tree that
    stays is worse than it was, and the fitness it is said to have is that of scoring it anew."""
    engine = F.array_position(F.array(*map(F.lit, ("start", "low", "high"))), F.col("engine")) - 1
    population = kept(p.variants(p.trees(spark, sf_dir)).withColumn("tree_id", 3 * F.col("tree_id") + engine).select("tree_id", "problem_id", "nodes", "c"))
    points = p.points(spark, sf_dir)
    after, ledger = refined(population, points, Refine(top=3, distinct=True, max_iter=10), 0, kept)
    after = kept(after)  # scored below, in two jobs
    anew = scoring.losses(after.drop("fit"), points).select("tree_id", (-2 * F.col("loss") / F.col("n")).alias("anew"))
    rows = after.select("tree_id", "problem_id", "fit").join(anew, "tree_id", "left").join(ledger.drop("problem_id"), "tree_id", "left")
    same = F.abs(F.col("fit") - F.col("anew")) <= 1e-9 * F.abs("anew")  # sums are added up in another order
    status = F.col("status")
    return rows.groupBy("problem_id").agg(
        F.count("status").alias("n"), F.count_if(status == "skipped_no_consts").alias("no_constants"), F.count_if(status == "skipped_dup_skel").alias("repeats"), F.count_if(status.isin(*TRIED)).alias("tried"),
        F.coalesce(F.bool_and(F.when(status.isin(*TRIED), F.col("fit") >= F.col("fitness_before"))), F.lit(True)).alias("never_worse"), F.bool_and((F.col("fit") == float("-inf")) | same).alias("as_scored"),
    )


@query("WITH " + _CANDIDATES_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY worth, tree_id) AS rank, CAST('0x' || substr(md5(concat_ws(':', 5, 0, problem_id, tree_id)), 1, 8) AS BIGINT) / 4294967296.0 AS chance FROM fits WHERE engine = 'start'),
s AS (SELECT * FROM (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) s(share))
SELECT share, CAST(count(tree_id) AS BIGINT) AS n, CAST(count(tree_id) FILTER (k > 0) AS BIGINT) AS tried, TRUE AS best_kept
FROM s LEFT JOIN r ON rank <= 4 AND chance < share GROUP BY share""")
def g02_share_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best four trees of each supplier refined with a chance of 0, 1/4, 1/2 and 1 by a back end of differences:
    how many are tried, and whether no supplier's best fitness falls."""
    population, points = kept(p.trees(spark, sf_dir).drop("shape")), p.points(spark, sf_dir)
    out = None
    for share in (0.0, 0.25, 0.5, 1.0):
        after, ledger = refined(population, points, Refine(top=4, share=share, max_iter=10, backend="lm_differences", seed=5), 0, kept)
        if ledger is None:
            start = kept(after.groupBy("problem_id").agg(F.max("fit").alias("was")))
            one = after.limit(0).select("tree_id", F.lit(None).cast("string").alias("status"))
        else:
            one = ledger.select("tree_id", "status")
        best = after.groupBy("problem_id").agg(F.max("fit").alias("best")).join(start, "problem_id")
        zero = F.lit(0)
        rows = one.select(F.lit(1).alias("n"), F.col("status").isin(*TRIED).cast("int").alias("tried"), zero.alias("fell"))
        rows = rows.unionByName(best.select(zero.alias("n"), zero.alias("tried"), (F.col("best") < F.col("was") * (1 + 1e-9)).cast("int").alias("fell")))
        row = rows.agg(F.lit(share).alias("share"), F.sum("n").alias("n"), F.sum("tried").alias("tried"), (F.sum("fell") == 0).alias("best_kept"))
        out = row if out is None else out.unionByName(row)
    return out
