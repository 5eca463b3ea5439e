"""Queries that write derived data as files and read it back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import is_finite
from ..operators import fitting, scoring
from ..sources import catalogue, pinned, popfile, sidecar, texts
from ..sources.shared import kept, new_path
from . import population as p
from . import trees as t
from .registry import query


@query("""SELECT s_suppkey AS part, CAST(8 AS BIGINT) AS trees, CAST(54 AS BIGINT) AS nodes, CAST(17 AS BIGINT) AS constants, round((SELECT sum(0.25 + ((s_suppkey * 11 + s * 7 + k * 5) % 16) / 8.0)
  FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1), (5, 0), (5, 1), (5, 2), (6, 0), (6, 1)) v(s, k)), 6) AS total FROM supplier""")
def s01_k01_population_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations written as binary files, one for each supplier, and read back."""
    popfile.register(spark)
    path = new_path(spark, "population")
    rows = p.trees(spark, sf_dir).select(
        F.col("problem_id").alias("part"), F.col("shape").alias("place"), "nodes", "c", F.array().cast("array<double>").alias("x"), F.lit(0).alias("n_vars"),
        F.array().cast("array<double>").alias("y"),
    )
    popfile.by_part(rows).write.format("population").mode("append").save(path)
    back = spark.read.format("population").load(path)
    total = F.aggregate("c", F.lit(0.0), lambda a, v: a + v)
    return back.groupBy("part").agg(
        F.count("*").alias("trees"), F.sum(F.size("nodes")).alias("nodes"), F.sum(F.size("c")).alias("constants"), F.round(F.sum(total), 6).alias("total")
    )


@query("WITH " + p.TREES_SQL + """
SELECT problem_id AS part, CAST(8 AS BIGINT) AS trees, CAST(1 AS BIGINT) AS skipped, CAST(17 AS BIGINT) AS constants, CAST(17 AS BIGINT) AS raw, CAST(0 AS BIGINT) AS worse,
  round(regr_intercept(y, x0), 2) + 0.0::DOUBLE AS c0, round(regr_slope(y, x0), 2) + 0.0::DOUBLE AS c1, TRUE AS as_fitted FROM points GROUP BY problem_id""")
def s19_k03_result_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's trees as a population file and what their fits return as raw arrays, read back beside the file
    and as plain arrays: the constants of each tree are its own, in single precision."""
    popfile.register(spark)
    sidecar.register(spark)
    trees, out = new_path(spark, "population"), new_path(spark, "results")
    population = p.trees(spark, sf_dir)
    none = F.array().cast("array<double>")
    rows = population.select(F.col("problem_id").alias("part"), F.col("shape").alias("place"), "nodes", "c", none.alias("x"), F.lit(0).alias("n_vars"), none.alias("y"))
    popfile.by_part(rows).write.format("population").mode("append").save(trees)
    fits = kept(fitting.fit(population, p.points(spark, sf_dir), save=kept).join(population.select("tree_id", F.col("problem_id").alias("part"), F.col("shape").alias("place")), "tree_id"))
    fits = fits.select("part", "place", "status", "c_final", "loss_init", "loss_final")
    popfile.by_part(fits).write.format("fitted").mode("append").save(out)
    back = spark.read.format("fitted").option("populations", trees).load(out)
    raw = spark.read.format("sidecar").option("kind", "<f4").load(out).where("array = 'c_final'")
    raw = raw.groupBy(F.regexp_extract("file", r"part-(\d+)/", 1).cast("long").alias("part")).agg(F.count("*").alias("raw"))
    single = F.transform(F.col("f.c_final"), lambda v: v.cast("float").cast("double"))
    met = back.alias("b").join(fits.alias("f"), ["part", "place"]).withColumns({"as_fitted": (F.col("b.status") == F.col("f.status")) & (F.col("b.c_final") == single), "c": F.col("b.c_final")})
    first = lambda i: F.round(F.max(F.when(F.col("place") == 0, F.col("c")[i])), 2)
    sums = met.groupBy("part").agg(
        F.count("*").alias("trees"), F.count_if(F.col("b.status") == fitting.K0_SKIP).alias("skipped"), F.sum(F.size("c")).alias("constants"),
        F.count_if((F.col("b.status") != fitting.K0_SKIP) & (F.col("b.loss_final") > F.col("b.loss_init"))).alias("worse"), first(0).alias("c0"), first(1).alias("c1"), F.bool_and("as_fitted").alias("as_fitted"),
    )
    return sums.join(raw, "part")


@query("""SELECT 'c0 + c1 * x' || (p_size % 3) AS expr, CAST(5 AS BIGINT) AS nodes, CAST(2 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1
UNION ALL SELECT 'import os' AS expr, NULL, NULL, CAST(count(*) AS BIGINT) FROM part WHERE p_size = 50""")
def s06_k04_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit requests written as JSON lines and read with the expression grammar; others are no trees."""
    part = p.read(spark, sf_dir, "part")
    good = part.select(F.concat(F.lit("c0 + c1 * x"), (F.col("p_size") % 3).cast("string")).alias("expr"), F.col("p_type").alias("dataset"))
    bad = part.where("p_size = 50").select(F.lit("import os").alias("expr"), F.col("p_type").alias("dataset"))
    path = new_path(spark, "requests")
    good.unionByName(bad).write.json(path)
    rows = texts.requests(spark, path)
    k = t.constant_count(F.col("nodes"))
    return rows.groupBy("expr", F.when(F.col("nodes").isNotNull(), F.size("nodes").cast("long")).alias("nodes"), F.when(F.col("nodes").isNotNull(), k.cast("long")).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 10 <> 3 GROUP BY 1")
def s14_s15_torn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of JSON lines, some of which break off."""
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value")))
    torn = F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 15)).otherwise(line)
    path = new_path(spark, "records")
    events = p.read(spark, sf_dir, "events")
    for shard in (0, 1):
        events.where(F.col("event_id") % 2 == shard).select(torn.alias("value")).write.text(f"{path}/shard={shard}")
    rows = texts.records(spark, f"{path}/*", "id long, kind string, value double")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT c_nationkey AS cell, CAST(gen AS BIGINT) AS gen, CAST(count(*) AS BIGINT) AS m, round(avg(c_acctbal), 4) AS mean_k FROM (SELECT *, c_custkey % 4 AS gen FROM customer) GROUP BY ALL""")
def s13_a24_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each cell with its snapshots inside, a bounded number each; read and taken apart."""
    snap = p.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cell"), (F.col("c_custkey") % 4).alias("gen")).agg(F.count("*").alias("m"), F.round(F.avg("c_acctbal"), 4).alias("mean_k"))
    path = new_path(spark, "manifests")
    snap.groupBy("cell").agg(F.collect_list(F.struct("gen", "m", "mean_k")).alias("snapshots")).write.json(path)
    return texts.snapshots(spark, path, "cell int, snapshots array<struct<gen:long,m:long,mean_k:double>>")


@query("""SELECT o_orderstatus AS backend, CAST(sum(o_orderkey % 7) AS BIGINT) AS converged, CAST(sum(o_orderkey % 3) AS BIGINT) AS failed, round(sum(o_totalprice), 2) AS wall FROM orders GROUP BY 1""")
def s17_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters found in lines of text reports."""
    line = F.format_string("backend=%s done: %d converged, %d failed, wall %.2f s", "o_orderstatus", F.col("o_orderkey") % 7, F.col("o_orderkey") % 3, "o_totalprice")
    path = new_path(spark, "reports")
    p.read(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    value = F.col("value")
    found = texts.counters(value, converged=r"(\d+) converged", failed=r"(\d+) failed", wall=r"wall ([0-9.]+) s")
    rows = spark.read.text(path).select(F.regexp_extract(value, r"backend=(\w+)", 1).alias("backend"), *found)
    return rows.groupBy("backend").agg(F.sum("converged").cast("long").alias("converged"), F.sum("failed").cast("long").alias("failed"), F.round(F.sum("wall"), 2).alias("wall"))


@query("""SELECT l_returnflag AS kernel, round(avg(CASE WHEN l_linenumber = 1 THEN l_quantity END), 4) AS m1, round(avg(CASE WHEN l_linenumber = 2 THEN l_quantity END), 4) AS m2,
  round(avg(CASE WHEN l_linenumber = 3 THEN l_quantity END), 4) AS m3 FROM lineitem GROUP BY 1""")
def s18_k10_profile_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long profile written as CSV, read back and pivoted to a column for each metric."""
    path = new_path(spark, "profile")
    rows = p.read(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    rows.select(F.col("l_returnflag").alias("kernel"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric"), F.col("l_quantity").alias("value")).write.csv(path, header=True)
    back = spark.read.schema("kernel string, metric string, value double").csv(path, header=True)
    return back.groupBy("kernel").pivot("metric", ["m1", "m2", "m3"]).agg(F.round(F.avg("value"), 4))


@query("""WITH reg AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 3 THEN CASE WHEN p_partkey % 40 = 0 THEN '../' ELSE '' END || p_type || '/' || p_partkey END AS path,
  CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 1 END AS base, CASE WHEN p_partkey % 4 = 3 THEN 0.01::DOUBLE END AS sigma FROM part)
SELECT r.id, coalesce(r.path, b.path) AS path, r.base, r.sigma FROM reg r LEFT JOIN reg b ON r.base = b.id WHERE NOT contains(coalesce(r.path, b.path), '..')""")
def s05_n06_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered data sets, a quarter of them noisy variants of others; paths that leave the folder are refused."""
    key = F.col("p_partkey")
    path = F.concat(F.when(key % 40 == 0, F.lit("../")).otherwise(F.lit("")), F.col("p_type"), F.lit("/"), key.cast("string"))
    variant = key % 4 == 3
    registry = p.read(spark, sf_dir, "part").select(
        key.alias("id"), F.when(~variant, path).alias("path"), F.when(variant, key - 1).alias("base"), F.when(variant, F.lit(0.01)).alias("sigma")
    )
    return texts.resolved(registry)


@query("""WITH old AS (SELECT p_partkey AS id, p_type AS path FROM part WHERE p_size <= 35), new_ AS (SELECT p_partkey AS id, p_brand AS path FROM part WHERE p_size > 25)
SELECT path, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM old ANTI JOIN new_ USING (id) UNION ALL SELECT * FROM new_) GROUP BY 1""")
def k09_registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = p.read(spark, sf_dir, "part")
    old = part.where("p_size <= 35").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("path"))
    new = part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"))
    return texts.upserted(old, new).groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS problem_id, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity / 10), 4) AS x0, round(sum(l_extendedprice / 10000), 4) AS y FROM lineitem GROUP BY 1")
def s04_k06_dataset_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets kept as Parquet by problem and scanned for the columns that are asked for."""
    path = new_path(spark, "datasets")
    rows = p.points(spark, sf_dir).select("problem_id", *(F.col("x")[k].alias(f"x{k}") for k in range(3)), "y")
    rows.repartition("problem_id").sortWithinPartitions("problem_id").write.parquet(path)
    back = spark.read.parquet(path).select("problem_id", "x0", "y")
    return back.groupBy("problem_id").agg(F.count("*").alias("n"), F.round(F.sum("x0"), 4).alias("x0"), F.round(F.sum("y"), 4).alias("y"))


@query("""WITH e AS (SELECT p_partkey AS id, p_size AS size, p_retailprice / 1000 AS price FROM part)
SELECT CASE WHEN size % 2 = 0 THEN 'c0*x0**2 + 1.5' ELSE 'c0*sqrt(x0)/(x1 + 2)' END AS expr, CAST(3 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS problems, CAST(sum(2 + size % 3) AS BIGINT) AS points,
  CAST(0 AS BIGINT) AS bad, round(sum(price), 4) AS c0, TRUE AS agree FROM e WHERE size % 2 = 0 GROUP BY 1
UNION ALL SELECT 'c0*sqrt(x0)/(x1 + 2)' AS expr, CAST(2 AS BIGINT), CAST(count(*) AS BIGINT), CAST(sum(2 + size % 3) AS BIGINT), CAST(0 AS BIGINT), round(sum(price), 4), TRUE FROM e WHERE size % 2 = 1""")
def s07_s08_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with a formula for each part, written as text, read back, and sampled: numbers in formulas are
    constants, and every point has its law's value."""
    even = F.col("p_size") % 2 == 0
    entries = p.read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.when(even, "c0*x0**2 + 1.5").otherwise("c0*sqrt(x0)/(x1 + 2)").alias("expr"), F.array(F.col("p_retailprice") / 1000).alias("known"),
        F.expr("if(p_size % 2 = 0, array(array(0.5D, 2.5D)), array(array(1.0D, 3.0D), array(0.0D, 5.0D)))").alias("ranges"), (2 + F.col("p_size") % 3).alias("n_samples"),
    )
    path = new_path(spark, "catalogue")
    catalogue.written(entries).write.text(path)
    rows = kept(catalogue.problems(spark, path))
    points = catalogue.materialised(rows)
    c, x = F.col("c"), F.col("x")
    met = points.join(rows.select(F.col("id").alias("problem_id"), "expr", "c"), "problem_id")
    law = F.when(F.size("x") == 1, c[0] * x[0] * x[0] + 1.5).otherwise(c[0] * F.sqrt(x[0]) / (x[1] + 2))
    near = met.groupBy("problem_id").agg(F.bool_and(F.abs(F.col("y") - law) < 1e-9).alias("near"), F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("bad"))
    both = rows.join(near, rows["id"] == near["problem_id"])
    return both.groupBy("expr").agg(
        F.max(F.size("c")).cast("long").alias("k"), F.count("*").alias("problems"), F.sum("n").alias("points"), F.sum("bad").alias("bad"), F.round(F.sum(c[0]), 4).alias("c0"), F.bool_and("near").alias("agree")
    )


@query("WITH " + p.LOSSES_SQL + "SELECT shape, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN isfinite(loss) THEN loss END), 2) AS total FROM losses WHERE engine = 'start' GROUP BY shape")
def s16_k07_pinned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees known by a preset's name and digest, and their losses, computed once and read the second time."""
    path, root = new_path(spark, "preset"), new_path(spark, "results")
    p.trees(spark, sf_dir).write.parquet(path)
    found = pinned.resolved(spark, "preset:suppliers", {"suppliers": (path, pinned.digest(spark, path))})
    trees = spark.read.parquet(found)
    made = lambda: trees.select("tree_id", "shape").join(scoring.losses(trees, p.points(spark, sf_dir)), "tree_id")

    def again() -> DataFrame:
        raise AssertionError("the result was kept")

    pinned.remembered(spark, root, found, "all", made)
    rows = pinned.remembered(spark, root, found, "all", again)
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.round(F.sum(F.when(is_finite(F.col("loss")), F.col("loss"))), 2).alias("total"))
