"""Scoring trees on points, and the panels that compare scores.

Trees and points meet on problem_id. The population's distinct structures are few and compile to
columns, so a score is one join and one grouped sum in generated code; points are never copied
per tree in storage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ops import INF, is_finite
from ..plans import trees as t
from ..sources.shared import kept, shuffled
from . import arrays
from .ranking import joined, ordinal_ranks

#: More structures than this go the array path (arrays.py), which evaluates them as data.
MAX_STRUCTURES = 64


def _distinct(population: DataFrame) -> DataFrame:
    """The distinct structures, with a digest: by their texts, as grouped first arrays would take a sort of all trees."""
    texts = population.select(F.to_json("nodes").alias("text")).distinct()
    return texts.select(F.sha2("text", 256).alias("s"), F.from_json("text", population.schema["nodes"].dataType).alias("nodes"))


def few_structures(population: DataFrame) -> list[tuple[str, t.Tree]] | None:
    """The distinct structures, by a digest, or None if they are too many to compile."""
    rows = _distinct(population).orderBy("s").limit(MAX_STRUCTURES + 1).collect()
    return [(r.s, t.from_prefix(r.nodes)) for r in rows] if len(rows) <= MAX_STRUCTURES else None


def structures(population: DataFrame) -> list[tuple[str, t.Tree]]:
    """The distinct structures, for what can only be compiled; their number is checked, not assumed."""
    known = few_structures(population)
    if known is None:
        raise ValueError(f"more than {MAX_STRUCTURES} structures can't be compiled here")
    return known


def evaluated(population: DataFrame, points: DataFrame, known: list[tuple[str, t.Tree]] | None = None) -> DataFrame:
    """All columns of the population with y and yh for each point of its problem."""
    known = known if known is not None else few_structures(population)
    if known is None:
        return _evaluated_as_data(population, points)
    return met(population, points, known).withColumn("yh", _case(known, "structure", "c")).drop("structure", "x")


def met(population: DataFrame, points: DataFrame, known: list[tuple[str, t.Tree]]) -> DataFrame:
    """The population with the number of its structure among the known ones, for each point of its problem."""
    keyed = population.withColumn("structure", _number(known, "nodes"))
    # points are dealt by problem: a task has all points of its trees, so that sums by tree are whole before they are shuffled
    return keyed.hint("shuffle_hash").join(points, "problem_id")


def _number(known: list[tuple[str, t.Tree]], nodes: str) -> Column:
    """Which of the known structures the nodes are."""
    numbers = F.create_map(*(F.lit(v) for i, (digest, _) in enumerate(known) for v in (digest, i))) if known else F.create_map().cast("map<string,int>")
    return F.try_element_at(numbers, F.sha2(F.to_json(nodes), 256))


def _case(known: list[tuple[str, t.Tree]], structure: str, c: str) -> Column:
    """The value at x of the structure with that number."""
    return reduce(
        lambda done, one: done.when(F.col(structure) == one[0], t.compiled(one[1][1], lambda k: F.col("x")[k], lambda k: F.col(c)[k])),
        enumerate(known),
        F.when(F.lit(False), F.lit(None).cast("double")),
    )


def _evaluated_as_data(population: DataFrame, points: DataFrame) -> DataFrame:
    arrays.small_batches(population)
    met = population.join(shuffled(arrays.blocked(points)), "problem_id").withColumn("__yh", arrays.predictions("nodes", "c", "block"))
    one = met.select("problem_id", *(c for c in population.columns if c != "problem_id"), F.explode(F.arrays_zip("block", "__yh")).alias("__at"))
    rest = [F.col(f"__at.block.{c}").alias(c) for c in points.columns if c not in ("problem_id", "x")]
    return one.select("problem_id", *(c for c in population.columns if c != "problem_id"), *rest, F.col("__at.__yh").alias("yh"))


def half_sse(y: Column, yh: Column) -> Column:
    """0.5 * sum of squared residuals, +inf if any prediction isn't finite, 0 over no rows."""
    r = yh - y
    total = F.lit(0.5) * F.sum(F.when(is_finite(yh), r * r))
    return F.when(F.max((~is_finite(yh)).cast("int")) == 1, F.lit(INF)).otherwise(F.coalesce(total, F.lit(0.0)))


def mean_square(y: Column, yh: Column) -> Column:
    return F.avg((yh - y) * (yh - y))


def r_squared(y: Column, yh: Column) -> Column:
    """1 - residual / total sum of squares, 0 where y doesn't vary."""
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - F.try_divide(F.sum((yh - y) * (yh - y)), total)).otherwise(F.lit(0.0))


def losses(population: DataFrame, points: DataFrame, *keys: str) -> DataFrame:
    """keys and tree_id with the loss and the number of points."""
    rows = evaluated(population, points)
    return rows.groupBy(*keys, "tree_id").agg(half_sse(F.col("y"), F.col("yh")).alias("loss"), F.count("*").alias("n"))


def normal_equations(rows: DataFrame, keys: list[str], jacobian: list[Column], residual: Column) -> DataFrame:
    """keys, jtj (upper triangle by rows) and jtr: K (K + 1) / 2 + K sums in one pass."""
    k = len(jacobian)
    upper = [F.sum(jacobian[i] * jacobian[j]).alias(f"a{i}{j}") for i in range(k) for j in range(i, k)]
    return rows.groupBy(*keys).agg(*upper, *(F.sum(jacobian[i] * residual).alias(f"g{i}") for i in range(k)))


def median_finite(x: Column) -> Column:
    """The median of the finite values of a bounded group, +inf if there is none (ranking.percentiles takes any group)."""
    return F.coalesce(F.percentile(F.when(is_finite(x), x), F.lit(0.5)), F.lit(INF))


def nearest_percentile(x: Column, p: int) -> Column:
    """The value at index n * p / 100 of the sorted values: of one bounded group."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(F.count(x) * p / 100) + 1).cast("int"))


def tiers(loss: Column, best: Column) -> tuple[Column, Column]:
    """Whether a loss reaches tier A and tier B of the best known one."""
    return (
        is_finite(best) & is_finite(loss) & (loss <= F.greatest(best * 1.005, best + 1e-10)),
        is_finite(best) & is_finite(loss) & (loss <= F.greatest(best * 1.05, best + 1e-10)),
    )


def quality_matched(a: Column, b: Column, tolerance: float = 1.05) -> Column:
    """Whether a median is no worse than another by more than the tolerance; never if one isn't finite."""
    return is_finite(a) & is_finite(b) & (a <= b * tolerance)


def good_enough(loss: Column, n: Column, variance: Column, r2: float) -> Column:
    """Whether a search may stop: the mean square leaves at most 1 - r2 of the target's variance."""
    return is_finite(loss) & (2 * loss / n <= (1 - r2) * variance)


def rate(test: Column) -> Column:
    """The share of true over the rows, null over none."""
    return F.avg(test.cast("double"))


def envelope(loss: Column, best: Column, *factors: float) -> list[Column]:
    return [rate(is_finite(loss) & (loss <= best * f)).alias(f"within_{str(f).replace('.', '_')}") for f in factors]


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient, NaN where a side doesn't vary."""
    varies = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    cov = F.covar_pop(a, b)
    return F.when(varies, F.try_divide(cov, F.stddev_pop(a) * F.stddev_pop(b))).otherwise(F.lit(float("nan")))


def top_overlap(rows: DataFrame, by: list[str], a: str, b: str, key: str, *shares: float) -> DataFrame:
    """by, k and the share of a's top k by loss that are in b's, for k of a few shares of the rows."""
    rows = kept(rows.select(*by, key, F.col(a).alias("__a"), F.col(b).alias("__b")))
    first = ordinal_ranks(rows.drop("__b"), by, "__a", key, "ra").withColumnRenamed("total", "n")
    ranked = joined(first, ordinal_ranks(rows.drop("__a"), by, "__b", key, "rb").drop("total"), [*by, key])
    out = []
    for share in shares:
        k = F.greatest(F.lit(1), F.floor(F.col("n") * share)).cast("int")
        both = F.sum(((F.col("ra") <= k) & (F.col("rb") <= k)).cast("int"))
        either = F.sum(((F.col("ra") <= k) | (F.col("rb") <= k)).cast("int"))
        out += [(both / F.max(k)).alias(f"top{round(100 * share)}"), (both / either).alias(f"jaccard{round(100 * share)}")]
    return ranked.groupBy(*by).agg(*out)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def audit(first: Column, last: Column, status: Column) -> tuple[Column, Column]:
    """(reverted, status): a fit that ends worse than it began, or not finite, is taken back, and
    CONVERGED (0) then reads MAXITER (1)."""
    worse = ~is_finite(last) | (last > first)
    return worse, F.when(worse & (status == 0), F.lit(1)).otherwise(status)


def dishonest(first: Column, last: Column, status: Column) -> Column:
    """Converged by status, but not finite or above the start by more than rounding."""
    return (status == 0) & (~is_finite(last) | (last > first * (1 + 1e-4) + 1e-12))
