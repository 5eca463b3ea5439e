"""Queries of study rows: customers stand for runs of arms (segments) on problems (nations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ops import clamp_zero
from ..operators import records as r
from ..operators import studies as st
from ..operators.ranking import joined, percentiles
from ..sources.shared import dealt
from . import population as p
from .registry import query

_STUDY = """WITH study AS (SELECT c_custkey AS id, c_mktsegment AS arm, c_nationkey AS problem, c_custkey % 5 AS seed, c_acctbal / 10000 AS r2, c_acctbal > 5000 AS solved,
  n_regionkey AS difficulty, c_nationkey % 5 = 0 AS is_control, (c_custkey % 97) * 0.5 AS wall,
  CASE WHEN c_custkey % 11 = 0 THEN 'timeout' WHEN c_custkey % 17 = 0 THEN 'crash' END AS fail_kind FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.read(spark, sf_dir, "customer").join(p.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    reason = F.when(key % 11 == 0, "killed>300").when(key % 17 == 0, "exit 1")
    return rows.select(
        key.alias("id"), F.col("c_mktsegment").alias("arm"), F.col("c_nationkey").alias("problem"), (key % 5).alias("seed"), (F.col("c_acctbal") / 10000).alias("r2"),
        (F.col("c_acctbal") > 5000).alias("solved"), F.col("n_regionkey").alias("difficulty"), (F.col("c_nationkey") % 5 == 0).alias("is_control"), (key % 97 * 0.5).alias("wall"),
        st.failure_kind(reason).alias("fail_kind"),
    )


def _r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


_BLOCK = """CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (solved) AS BIGINT) AS solved, round(avg(CASE WHEN solved THEN 1.0 ELSE 0 END), 6) AS rate,
  round(quantile_cont(r2, 0.5), 6) AS median_r2, round(quantile_cont(greatest(r2, 0), 0.5), 6) AS median_clamped, CAST(count(fail_kind) AS BIGINT) AS fails, round(avg(wall), 4) AS mean_wall"""


@query(_STUDY + f"SELECT arm, {_BLOCK} FROM study GROUP BY arm")
def a25_arm_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.arm_block(dealt(_study(spark, sf_dir), "id"), "arm")


@query(_STUDY + f"SELECT arm, difficulty, is_control, {_BLOCK} FROM study GROUP BY GROUPING SETS ((arm), (arm, difficulty), (arm, is_control))")
def a26_arm_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arm, by arm and difficulty, by arm and control."""
    rows = dealt(_study(spark, sf_dir), "id").withColumn("set", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumns({"difficulty": F.when(F.col("set") == 1, F.col("difficulty")), "is_control": F.when(F.col("set") == 2, F.col("is_control"))})
    return st.arm_block(rows, "set", "arm", "difficulty", "is_control").drop("set")


@query(_STUDY + """, pp AS (SELECT arm, problem, median(r2) AS m FROM study GROUP BY ALL)
SELECT arm, CAST(count(*) AS BIGINT) AS problems, round(median(m), 6) AS median_of_medians, round(max(m), 6) AS best FROM pp GROUP BY arm""")
def a27_two_level_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = percentiles(dealt(_study(spark, sf_dir), "id"), ["arm", "problem"], "r2", {"m": 0.5})
    arms = inner.groupBy("arm").agg(F.count("*").alias("problems"), _r(F.max("m"), "best"))
    return joined(arms, percentiles(inner, ["arm"], "m", {"median_of_medians": 0.5}), ["arm"]).withColumn("median_of_medians", F.round("median_of_medians", 6))


@query(_STUDY + """SELECT arm, CAST(seed AS BIGINT) AS seed, CAST(count(*) FILTER (fail_kind = 'timeout') AS BIGINT) AS timeout, CAST(count(*) FILTER (fail_kind = 'crash') AS BIGINT) AS crash
FROM study WHERE fail_kind IS NOT NULL GROUP BY arm, seed""")
def a28_h16_failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _study(spark, sf_dir).where("fail_kind is not null")
    return rows.groupBy("arm", "seed").pivot("fail_kind", ["timeout", "crash"]).count().na.fill(0, ["timeout", "crash"])


@query(_STUDY + "SELECT problem, CAST(count(*) FILTER (solved) AS BIGINT) AS leaks FROM study WHERE is_control GROUP BY problem HAVING count(*) FILTER (solved) > 0")
def a29_control_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls that a run claims to have solved."""
    return _study(spark, sf_dir).where("is_control").groupBy("problem").agg(F.count_if("solved").alias("leaks")).where("leaks > 0")


_PAIRS = _STUDY + """, pr AS (SELECT problem, seed, avg(CASE WHEN arm = 'BUILDING' THEN r2 END) AS va, avg(CASE WHEN arm = 'MACHINERY' THEN r2 END) AS vb
  FROM study WHERE arm IN ('BUILDING', 'MACHINERY') GROUP BY problem, seed), both_ AS (SELECT * FROM pr WHERE va IS NOT NULL AND vb IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.paired(_study(spark, sf_dir), ["problem", "seed"], "arm", "BUILDING", "MACHINERY", "r2")


@query(_PAIRS + "SELECT problem, CAST(seed AS BIGINT) AS seed, round(va, 9) AS va, round(vb, 9) AS vb FROM both_")
def j05_arm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("problem", "seed", _r(F.col("va"), "va", 9), _r(F.col("vb"), "vb", 9))


@query(_PAIRS + """, c AS (SELECT count(*) FILTER (va > vb) AS w, count(*) FILTER (va < vb) AS l, count(*) FILTER (va = vb) AS t FROM both_)
SELECT CAST(w AS BIGINT) AS wins, CAST(l AS BIGINT) AS losses, CAST(t AS BIGINT) AS ties,
  round(least(1.0, 2 * list_sum([exp(lgamma(w + l + 1.0) - lgamma(i + 1.0) - lgamma(w + l - i + 1.0) - (w + l) * ln(2.0)) for i in range(least(w, l) + 1)])), 6) AS p FROM c""")
def m07_m09_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs and the exact two-sided p."""
    c = _pairs(spark, sf_dir).agg(
        F.count_if(F.col("va") > F.col("vb")).alias("wins"), F.count_if(F.col("va") < F.col("vb")).alias("losses"), F.count_if(F.col("va") == F.col("vb")).alias("ties")
    )
    return c.select("wins", "losses", "ties", _r(st.sign_test(F.col("wins"), F.col("losses")), "p"))


@query(_PAIRS + """, d AS (SELECT va - vb AS d FROM both_ WHERE va <> vb), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM d),
w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w FROM k)
SELECT CAST(n AS BIGINT) AS n, round(w, 1) AS w_plus, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM w""")
def m08_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.signed_ranks(_pairs(spark, sf_dir), "va", "vb").select("n", _r(F.col("w_plus").cast("double"), "w_plus", 1), _r(F.col("z"), "z"))


@query(_STUDY + """, pr AS (SELECT problem, avg(CASE WHEN arm = 'BUILDING' THEN r2 END) AS va, avg(CASE WHEN arm = 'MACHINERY' THEN r2 END) AS vb FROM study GROUP BY problem),
d AS (SELECT va - vb AS d FROM pr WHERE va <> vb), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS rank FROM d),
w AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS BIGINT) AS w FROM k),
ways AS (SELECT n, w, list_reduce(list_concat([[1.0::DOUBLE]], list_transform(range(1, n + 1), lambda r: [r::DOUBLE])), lambda acc, r: list_transform(range(1, n * (n + 1) // 2 + 2), lambda i:
  coalesce(acc[i], 0) + CASE WHEN i > r[1] THEN coalesce(acc[i - CAST(r[1] AS BIGINT)], 0) ELSE 0 END)) AS ways FROM w)
SELECT n, round(CAST(w AS DOUBLE), 1) AS w_plus, round(least(1, 2 * least(list_sum(ways[1:w + 1]), list_sum(ways[w + 1:])) / list_sum(ways)), 6) AS p FROM ways""")
def m08_signed_rank_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact two-sided p of the signed-rank test between two arms, over problems."""
    pairs = st.paired(_study(spark, sf_dir), ["problem"], "arm", "BUILDING", "MACHINERY", "r2")
    rows = st.signed_ranks(pairs, "va", "vb").withColumn("w_plus", F.col("w_plus").cast("double"))
    return rows.select("n", _r(F.col("w_plus"), "w_plus", 1), _r(st.signed_rank_p("n", "w_plus", "ties"), "p"))


@query(_STUDY + """, f AS (SELECT *, row_number() OVER (PARTITION BY arm, difficulty ORDER BY r2 DESC, id) AS rn FROM study)
SELECT arm, difficulty, CAST(id AS BIGINT) AS id FROM f WHERE rn <= 2""")
def f15_stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of every stratum."""
    rn = F.row_number().over(Window.partitionBy("arm", "difficulty").orderBy(F.desc("r2"), "id"))
    return _study(spark, sf_dir).withColumn("rn", rn).where("rn <= 2").select("arm", "difficulty", "id")


@query("""WITH u AS (SELECT c_nationkey AS id, 0 AS src, c_custkey AS k, 'core' AS role FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey, 'extra' FROM supplier),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, k) AS rn FROM u) SELECT id, CAST(k AS BIGINT) AS k, role FROM f WHERE rn = 1 AND role = 'core'""")
def h11_u01_union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families united, the first row of an id kept, one role selected."""
    core = p.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.lit(0).alias("src"), F.col("c_custkey").alias("k"), F.lit("core").alias("role"))
    extra = p.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.lit(1).alias("src"), F.col("s_suppkey").alias("k"), F.lit("extra").alias("role"))
    return r.first_wins(core.unionByName(extra), ["id"], [F.col("src"), F.col("k")]).where("role = 'core'").select("id", "k", "role")


@query("""WITH g AS (SELECT event_type, user_id, CAST(floor(event_id / 100) AS BIGINT) AS gen, max(value) AS best FROM events GROUP BY ALL)
SELECT event_type, CAST(user_id AS BIGINT) AS user_id, gen, round(max(best) OVER (PARTITION BY event_type, user_id ORDER BY gen), 4) AS so_far FROM g""")
def w08_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value so far over generations, for every kind and user."""
    gen = F.floor(F.col("event_id") / 100).alias("gen")
    g = p.read(spark, sf_dir, "events").groupBy("event_type", "user_id", gen).agg(F.max("value").alias("best"))
    return g.select("event_type", "user_id", "gen", _r(st.running_best("best", ["gen"], "event_type", "user_id"), "so_far", 4))


_GEN = "WITH e AS (SELECT event_type AS kind, CAST(floor(event_id / 1000) AS BIGINT) AS gen, user_id, event_id, CASE WHEN event_id % 19 = 0 THEN 'nan'::DOUBLE ELSE value END AS fit FROM events)"


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = F.when(F.col("event_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return p.read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.floor(F.col("event_id") / 1000).alias("gen"), "user_id", "event_id", fit.alias("fit"))


@query(_GEN + """SELECT kind, gen, CAST(event_id AS BIGINT) AS event_id, round(f, 4) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY kind, gen ORDER BY f DESC, event_id) AS rn
  FROM (SELECT *, CASE WHEN isnan(fit) THEN '-inf'::DOUBLE ELSE fit END AS f FROM e)) WHERE rn <= 5""")
def w04_g05_top_of_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five fittest of each generation; a NaN fitness is the least."""
    rows = _generations(spark, sf_dir).withColumn("fit", F.when(F.isnan("fit"), F.lit(float("-inf"))).otherwise(F.col("fit")))
    rn = F.row_number().over(Window.partitionBy("kind", "gen").orderBy(F.desc("fit"), "event_id"))
    return rows.withColumn("rn", rn).where("rn <= 5").select("kind", "gen", "event_id", _r(F.col("fit"), "fit", 4))


@query(_GEN + """, u AS (SELECT kind, gen, user_id, max(fit) AS fit FROM e WHERE NOT isnan(fit) GROUP BY ALL)
SELECT kind, gen, CAST(user_id AS BIGINT) AS user_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, gen ORDER BY fit DESC, user_id) AS rn FROM u) WHERE rn <= 3""")
def w05_top_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three fittest different members of each generation."""
    u = _generations(spark, sf_dir).where(~F.isnan("fit")).groupBy("kind", "gen", "user_id").agg(F.max("fit").alias("fit"))
    rn = F.row_number().over(Window.partitionBy("kind", "gen").orderBy(F.desc("fit"), "user_id"))
    return u.withColumn("rn", rn).where("rn <= 3").select("kind", "gen", "user_id")


@query(_GEN + """, g AS (SELECT kind, gen, avg(fit) AS m, max(fit) AS top, count(*) AS n FROM e WHERE NOT isnan(fit) GROUP BY ALL)
SELECT kind, gen, CAST(n AS BIGINT) AS n, round(m, 6) AS mean, round(top, 4) AS top FROM g""")
def a15_a22_drift_by_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generations(spark, sf_dir).where(~F.isnan("fit"))
    return rows.groupBy("kind", "gen").agg(F.count("*").alias("n"), _r(F.avg("fit"), "mean"), _r(F.max("fit"), "top", 4))


@query(_GEN + """, g AS (SELECT kind, avg(CASE WHEN gen = 0 THEN fit END) AS a, avg(CASE WHEN gen = (SELECT max(gen) FROM e) THEN fit END) AS b FROM e WHERE NOT isnan(fit) GROUP BY kind)
SELECT kind, CASE WHEN b > a THEN 'widen' WHEN b < a THEN 'narrow' ELSE 'same' END AS verdict FROM g""")
def a35_widen_or_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last generation."""
    rows = _generations(spark, sf_dir).where(~F.isnan("fit"))
    g = rows.groupBy("kind", "gen").agg(F.avg("fit").alias("m")).groupBy("kind").agg(F.min_by("m", "gen").alias("a"), F.max_by("m", "gen").alias("b"))
    return g.select("kind", F.when(F.col("b") > F.col("a"), "widen").when(F.col("b") < F.col("a"), "narrow").otherwise("same").alias("verdict"))


@query(_GEN + """, k AS (SELECT kind, gen, user_id, event_id, percent_rank() OVER (PARTITION BY kind, gen ORDER BY fit DESC, event_id) AS pr FROM e WHERE NOT isnan(fit))
SELECT kind, gen, CAST(count(*) FILTER (pr <= 0.01) AS BIGINT) AS elite, CAST(count(*) FILTER (pr <= 0.3) AS BIGINT) AS survivors FROM k GROUP BY ALL""")
def w14_elite_and_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = F.percent_rank().over(Window.partitionBy("kind", "gen").orderBy(F.desc("fit"), "event_id"))
    rows = _generations(spark, sf_dir).where(~F.isnan("fit")).withColumn("pr", pr)
    return rows.groupBy("kind", "gen").agg(F.count_if(F.col("pr") <= 0.01).alias("elite"), F.count_if(F.col("pr") <= 0.3).alias("survivors"))


#: The canonical constants that a fitted one is compared with.
CANONICAL = (0.5, 1.0, 1.4142135623730951, 2.0, 2.718281828459045, 3.0, 3.141592653589793, 4.0, 5.0, 10.0)


@query(f"""WITH v AS (SELECT DISTINCT p_size / 4.9 AS v FROM part), z AS (SELECT unnest([{', '.join(f'{z!r}e0' for z in CANONICAL)}]) AS z),
n AS (SELECT v, z, abs(v - z) / z AS d, row_number() OVER (PARTITION BY v ORDER BY abs(v - z) / z, z) AS rn FROM v, z)
SELECT round(v, 9) AS v, z, round(d, 9) AS d, d <= 0.02 AS near FROM n WHERE rn = 1""")
def j19_nearest_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a few fixed values, by relative distance."""
    v = p.read(spark, sf_dir, "part").select((F.col("p_size") / 4.9).alias("v")).distinct()
    near = F.array_min(F.array(*(F.struct((F.abs(F.col("v") - z) / z).alias("d"), F.lit(z).alias("z")) for z in CANONICAL)))
    return v.withColumn("n", near).select(_r(F.col("v"), "v", 9), "n.z", _r(F.col("n.d"), "d", 9), (F.col("n.d") <= 0.02).alias("near"))


@query("""SELECT p_brand AS brand, substr(sha256(p_name), 1, 16) AS digest, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL""")
def y01_structural_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.substring(F.sha2("p_name", 256), 1, 16).alias("digest")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CAST(('0x' || substr(sha256(c_name), 1, 8))::BIGINT AS BIGINT) AS seed FROM customer""")
def y14_seed_from_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.conv(F.substring(F.sha2("c_name", 256), 1, 8), 16, 10).cast("long").alias("seed"))


@query("""SELECT replace(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '.' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR), '.', 'p') || 'pct' AS label, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def y12_noise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.read(spark, sf_dir, "lineitem")
    number = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    label = F.concat(F.replace(F.concat(number("l_discount"), F.lit("."), number("l_tax")), F.lit("."), F.lit("p")), F.lit("pct"))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_brand AS b, list_sort(list(DISTINCT p_size)) AS s FROM part GROUP BY 1)
SELECT x.b AS a, y.b AS b, CAST(len(list_intersect(x.s, y.s)) AS BIGINT) AS both_, CAST(len(x.s) - len(list_intersect(x.s, y.s)) AS BIGINT) AS only_a, list_sort(x.s) = list_sort(y.s) AS same FROM s x, s y WHERE x.b < y.b""")
def u04_u06_set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that two brands share, and whether they are the same: a row a brand, a few bounded values each."""
    s = p.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("b")).agg(F.array_sort(F.collect_set("p_size")).alias("s"))
    x, y = s.alias("x"), s.alias("y")
    return x.join(y, F.col("x.b") < F.col("y.b")).select(
        F.col("x.b").alias("a"), F.col("y.b").alias("b"), F.size(F.array_intersect("x.s", "y.s")).cast("long").alias("both_"),
        F.size(F.array_except("x.s", "y.s")).cast("long").alias("only_a"), (F.col("x.s") == F.col("y.s")).alias("same"),
    )


@query(_STUDY + "SELECT arm, round(sum(CASE WHEN fail_kind IS NULL THEN greatest(r2 - 0.5, 0) ELSE 0 END), 6) AS total FROM study GROUP BY arm")
def e35_clamped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores clamped at 0, failures counting 0."""
    score = clamp_zero(F.when(F.col("fail_kind").isNull(), F.col("r2") - 0.5))
    return _study(spark, sf_dir).groupBy("arm").agg(_r(F.sum(score), "total"))


@query(_STUDY + "SELECT CAST(count(*) FILTER (r2 >= 0.6 AND wall <= 20) AS BIGINT) AS to_judge, CAST(count(*) AS BIGINT) AS n FROM study")
def h10_recovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study(spark, sf_dir).agg(F.count_if((F.col("r2") >= 0.6) & (F.col("wall") <= 20)).alias("to_judge"), F.count("*").alias("n"))
