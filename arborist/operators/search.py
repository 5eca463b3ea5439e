"""Search over populations: restarts, memetic steps with roll-back, recovery tests, generators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ops import is_finite
from ..plans import trees as t
from ..sources.shared import dealt, kept, shuffled
from . import scoring as s
from .fitting import Options, fit, written_back
from .ranking import placed


def memetic_step(population: DataFrame, points: DataFrame, k: int, max_iter: int, save: Callable[[DataFrame], DataFrame], options: Options = Options()) -> DataFrame:
    """The population after one step, with outcome: the best k trees of each problem, one for each
    structure, are fitted; fitted constants go back where they are finite and lower the loss, and
    are rolled back where not.
    """
    before = save(population.join(shuffled(s.losses(population, points)), "tree_id").drop("n"))
    unique = Window.partitionBy("problem_id", F.to_json("nodes")).orderBy("loss", "tree_id")
    chosen = before.where(is_finite(F.col("loss")) & (F.size("c") > 0)).withColumn("rn", F.row_number().over(unique)).where("rn = 1").drop("rn")
    chosen = s.top_k(chosen, ["problem_id"], [F.col("loss"), F.col("tree_id")], k).select(*population.columns)
    fits = fit(chosen, points, max_iter, save, options)
    fitted = written_back(chosen, fits).select("tree_id", F.col("c").alias("c_new"))
    again = s.losses(written_back(chosen, fits).select(*population.columns), points).select("tree_id", F.col("loss").alias("loss_new"))
    met = before.join(shuffled(fitted.join(shuffled(again), "tree_id")), "tree_id", "left")
    better = F.coalesce(is_finite(F.col("loss_new")) & (F.col("loss_new") < F.col("loss")), F.lit(False))
    outcome = F.when(F.col("c_new").isNull(), "not_chosen").when(better, "improved").otherwise("rolled_back")
    rest = [c for c in population.columns if c != "c"]
    return met.select(
        *rest,
        F.when(better, F.col("c_new")).otherwise(F.col("c")).alias("c"),
        F.col("loss").alias("loss_before"),
        F.when(better, F.col("loss_new")).otherwise(F.col("loss")).alias("loss"),
        outcome.alias("outcome"),
    )


def deviations(rows: DataFrame, key: list[str], truth: str, found: str, usable: Column | None = None, **more: Column) -> DataFrame:
    """key with a and b, the factor and the offset that bring found nearest to truth, scaled and moved, the
    largest deviations after either, and top, the largest size of truth: two passes over the rows, of
    which only usable ones count. more: further aggregates of the first pass."""
    y, f = F.col(truth), F.col(found)
    one = (lambda v: F.when(usable, v)) if usable is not None else lambda v: v
    best = rows.groupBy(*key).agg(
        F.try_divide(F.sum(one(y * f)), F.sum(one(f * f))).alias("a"), F.avg(one(y - f)).alias("b"), F.max(one(F.abs(y))).alias("top"), *(v.alias(k) for k, v in more.items())
    )
    far = rows.join(shuffled(best), key).groupBy(*key).agg(F.max(one(F.abs(y - F.col("a") * f))).alias("scaled"), F.max(one(F.abs(y - f - F.col("b")))).alias("moved"), *(F.first(k).alias(k) for k in ("a", "b", "top", *more)))
    return far


def recovered(rows: DataFrame, key: list[str], truth: str, found: str, tolerance: float = 1e-4) -> DataFrame:
    """key with scale_ok and offset_ok: whether found equals truth up to one factor, or one offset."""
    limit = tolerance * F.greatest(F.lit(1.0), F.col("top"))
    return deviations(rows, key, truth, found).select(*key, F.coalesce((F.col("scaled") < limit) & (F.abs("a") >= 1e-9), F.lit(False)).alias("scale_ok"), (F.col("moved") < limit).alias("offset_ok"))


@F.arrow_udf(T.StructType([T.StructField("infix", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("inner", T.IntegerType())]))
def read_out(nodes: pa.Array) -> pa.Array:
    """A tree's infix text, the text of its normal form, and its number of inner constants."""
    out = []
    for row in nodes.to_pylist():
        tree = t.from_prefix([(n["nt"], n["nv"], n["ci"]) for n in row])
        out.append({"infix": t.infix(tree), "canonical": t.infix(t.canonical(tree)), "inner": t.inner_constants(tree)})
    return pa.array(out, pa.struct([("infix", pa.string()), ("canonical", pa.string()), ("inner", pa.int32())]))


def unit(seed: int, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that follows from seed and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def gaussian(seed: int, *keys: Column | str) -> Column:
    """A standard normal number from two uniform ones."""
    u, v = unit(seed, *keys, F.lit(1)), unit(seed, *keys, F.lit(2))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * 3.141592653589793 * v)


#: Relative jitters of the truth, scales of further starts, and blind starts, in a certification.
JITTERS, JITTER, SCALES, BLIND = 4, 0.10, (0.1, 0.5, 1.0, 2.0, 10.0), 16


def certifying_starts(population: DataFrame, seed: int, blind: bool = False) -> DataFrame:
    """population with trial and its start in c: the given constants, jitters of them and one draw a
    scale; or, blind, draws as large as three times the given ones."""
    known = 1 + JITTERS + len(SCALES)
    trials = population.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit((BLIND if blind else known) - 1))))
    at, swing = F.col("trial"), lambda k: 2 * unit(seed, "tree_id", "trial", k, F.lit(3)) - 1
    if blind:
        return trials.withColumn("c", F.transform("c", lambda v, k: swing(k) * F.greatest(F.abs(v), F.lit(1.0)) * 3))
    scale = F.element_at(F.array(*map(F.lit, SCALES)), F.greatest(at - JITTERS, F.lit(1)))
    near = lambda v, k: v * (1 + JITTER * gaussian(seed, "tree_id", "trial", k))
    start = F.when(at == 0, F.col("c")).when(at <= JITTERS, F.transform("c", near)).otherwise(F.transform("c", lambda v, k: swing(k) * scale))
    return trials.withColumn("c", start)


def certified(population: DataFrame, points: DataFrame, seed: int, max_iter: int, save: Callable[[DataFrame], DataFrame], blind: bool = False) -> DataFrame:
    """tree_id, trials, c and r2: the best fit from all its starts; null where none has a finite loss."""
    trials = certifying_starts(population, seed, blind).withColumn("tree", F.col("tree_id"))
    trials = save(trials.withColumn("tree_id", F.col("tree_id") * 32 + F.col("trial")))
    spread = points.groupBy("problem_id").agg((F.var_pop("y") * F.count("y")).alias("total"))
    fits = fit(trials, points, max_iter, save).join(shuffled(trials.select("tree_id", "tree", "problem_id", "trial")), "tree_id").join(shuffled(spread), "problem_id")
    r2 = F.when(is_finite(F.col("loss_final")), 1 - F.try_divide(2 * F.col("loss_final"), F.col("total")))
    best = fits.withColumn("r2", r2).groupBy(F.col("tree").alias("tree_id"))
    order = F.when(F.col("r2").isNotNull(), F.struct("r2", -F.col("trial")))
    return best.agg(F.count("*").alias("trials"), F.max_by("c_final", order).alias("c"), F.max("r2").alias("r2"))


#: Draws that one task of a tournament holds, about.
TASK_DRAWS = 500_000


def tournament(rows: DataFrame, by: list[str], fitness: str, key: str, size: int, share: float) -> DataFrame:
    """by, contest and winner: as many contests as a share of the group, each among size members drawn
    with replacement; the fittest wins, ties go to the smaller key. Draws follow from group, contest
    and draw; NaN and null are the least fit. key tells members apart.
    """
    fit_ = F.when(F.isnan(fitness) | F.col(fitness).isNull(), F.lit(float("-inf"))).otherwise(F.col(fitness))
    members = rows.select(*by, F.col(key).alias("__key"), fit_.alias("__fit"), F.lit(1).alias("__one"))
    members = kept(placed(members, by, ["__key"], "__one").drop("__one"))
    contests = members.where(F.col("before") < F.ceil(F.col("total") * share)).select(*by, F.col("before").alias("contest"), "total")
    n = contests.count() * size // TASK_DRAWS + 1
    draws = contests.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    text = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*by, "contest", "draw"]))
    draws = draws.withColumn("before", F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.col("total")))
    group = F.struct(F.lit(0), *by).alias("__group")  # equal where null keys are null in both
    picks = dealt(draws.select(group, "contest", "before"), "__group", "before", n=n)
    met = picks.join(shuffled(dealt(members.select(group, "before", "__key", "__fit"), "__group", "before", n=n)), ["__group", "before"])
    best = dealt(met.drop("before"), "__group", "contest", n=n).groupBy("__group", "contest").agg(F.min_by("__key", F.struct(-F.col("__fit"), F.col("__key"))).alias("winner"))
    return best.select(*(F.col("__group")[c].alias(c) for c in by), "contest", "winner")


def noisy(rows: DataFrame, key: list[str], value: str, sigma: float, seed: int, ids: list[str], relative: str = "std") -> DataFrame:
    """value with Gaussian noise of sigma times the group's deviation or RMS (sigma itself where that
    is 0), or of sigma alone ("absolute")."""
    if relative == "absolute":
        return rows.withColumn(value, F.col(value) + sigma * gaussian(seed, *ids))
    spread = F.stddev_pop(value) if relative == "std" else F.sqrt(F.avg(F.col(value) * F.col(value)))
    scale = rows.groupBy(*key).agg(spread.alias("__scale"))
    met = rows.join(shuffled(scale), key)
    size = F.when(F.col("__scale") > 0, sigma * F.col("__scale")).otherwise(F.lit(sigma))
    return met.withColumn(value, F.col(value) + size * gaussian(seed, *ids)).drop("__scale")
