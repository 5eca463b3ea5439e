"""Fitting every tree's own constants at once: batched Levenberg-Marquardt as Spark jobs.

Two plans, one schedule. A problem of up to LOCAL_POINTS points is gathered once, each of its trees
meets it in one row, and a task runs the whole fit of a tree over numpy arrays; problems with many
trees are spread over tasks. A larger problem is fitted in rounds, each one pass over the points:
trees join the points of their problem, predictions and the derivatives by each constant are
columns in generated code, and their products are summed by tree, with partial sums before the
shuffle, so a problem with a third of all points is no single task. Compiled trees then carry as
many slopes as the widest of them. Trees that have ended are left out of later rounds. What is left
per tree is a K by K solve on a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ops import BY_NAME, INF, Columns, annihilating, is_finite
from ..plans import trees as t
from ..sources.shared import shuffled
from . import arrays
from .minimise import METHODS, minimise_in_rounds, minimise_one
from .scoring import few_structures, half_sse

#: Statuses of a fit.
CONVERGED, MAXITER, FAIL_NAN, K0_SKIP, FAIL_CHOLESKY = range(5)
LAMBDA0, LAMBDA_MIN, LAMBDA_MAX, XTOL = 1e-3, 1e-12, 1e12, 1e-6
#: Points of a problem up to which a task fits a tree by itself, and trees of a problem that meet it in one place.
LOCAL_POINTS, LOCAL_TREES = 8192, 4096
#: Trees that Python gets with their points in one row, and constants up to which a step is solved for without a library.
ROW_TREES, SMALL = 64, 8
#: Points of all trees that are fitted together, about what a core's cache holds with the nodes' values.
MANY_POINTS = 1 << 14


def gradient(tree: t.Tree, x: Callable[[int], Column], c: Callable[[int], Column], weight: Column | float = 1.0) -> dict[int, Column]:
    """The derivative by each constant: one walk from the root with the adjoint on the way down.

    An adjoint that is exactly 0 stays 0 whatever it is multiplied with.
    """
    if tree.op == "x":
        return {}
    if tree.op == "c":
        return {tree.args[0]: weight if isinstance(weight, Column) else F.lit(weight)}
    op = BY_NAME[tree.op]
    if op.partials is None:
        raise ValueError(f"{tree.op} has no derivative here")
    operands = [t.compiled(a, x, c) for a in tree.args]
    out: dict[int, Column] = {}
    for below, partial in zip(tree.args, op.partials(Columns, *operands, op.column(*operands))):
        if isinstance(weight, float) and weight == 1.0:
            adjoint = partial
        elif isinstance(partial, float):
            adjoint = weight * partial
        else:
            adjoint = annihilating(weight if isinstance(weight, Column) else F.lit(weight), partial)
        for k, column in gradient(below, x, c, adjoint).items():
            out[k] = out[k] + column if k in out else column
    return out


def dual(tree: t.Tree, x: Callable[[int], Column], c: Callable[[int], Column]) -> dict[int, Column]:
    """The derivative by each constant, made from the operands' own on the way up."""
    if tree.op == "x":
        return {}
    if tree.op == "c":
        return {tree.args[0]: F.lit(1.0)}
    op = BY_NAME[tree.op]
    if op.partials is None:
        raise ValueError(f"{tree.op} has no derivative here")
    operands = [t.compiled(a, x, c) for a in tree.args]
    out: dict[int, Column] = {}
    for below, partial in zip(tree.args, op.partials(Columns, *operands, op.column(*operands))):
        for k, tangent in dual(below, x, c).items():
            term = partial * tangent if isinstance(partial, float) else annihilating(partial, tangent)
            out[k] = out[k] + term if k in out else term
    return out


@dataclass(frozen=True)
class Options:
    """jacobian: "reverse" derivatives, "dual" ones (the same by tangents from the leaves up), or
    "forward" differences of relative step 1e-3 or "central" ones of 1e-6 (ablations); "none" for "nelder-mead".
    damping: "relative" scales the diagonal by 1 + lambda, "absolute" adds lambda to it.
    pivot_floor: added to the diagonal before the solve (0 in the standard form).
    order: "improve" takes a step only if the loss doesn't grow, and only then asks whether it was
    small; "step" asks first and takes a small step even uphill (the ablation that claims too much).
    plan: "tasks" or "rounds" whatever the sizes, or "size", which chooses for each problem.
    xtol: the relative step that counts as small.
    method: "lm", or "bfgs", "l-bfgs" or "cg", which minimise the mean square by its gradient alone, or
    "nelder-mead", which does by its values alone.
    bounds: low and high, between which the methods by gradient keep all constants; starts beyond are put on them."""

    jacobian: str = "reverse"
    damping: str = "relative"
    pivot_floor: float = 0.0
    order: str = "improve"
    plan: str = "size"
    xtol: float = XTOL
    method: str = "lm"
    bounds: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.method not in ("lm", *METHODS):
            raise ValueError(f"no method {self.method!r}")
        if self.jacobian == "none" and self.method != "nelder-mead":
            raise ValueError(f"{self.method} needs derivatives")
        if self.bounds is not None and (self.method in ("lm", "nelder-mead") or not self.bounds[0] < self.bounds[1]):
            raise ValueError("bounds are a low and a higher number, for the minimisers by gradient")


def square(upper: list[float], k: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle by rows."""
    matrix = np.zeros((k, k))
    matrix[np.triu_indices(k)] = upper
    return matrix + np.triu(matrix, 1).T


def solved(matrix: np.ndarray, down: np.ndarray, damping: float, options: Options) -> np.ndarray | None:
    """The damped normal step of one tree, None where the matrix isn't positive definite."""
    if len(down) <= SMALL:
        return _solved_small(matrix.tolist(), down.tolist(), damping, options)
    damped, diagonal = matrix.copy(), np.diag_indices(len(down))
    damped[diagonal] = (matrix[diagonal] * (1 + damping) if options.damping == "relative" else matrix[diagonal] + damping) + options.pivot_floor
    try:
        low = np.linalg.cholesky(damped)
        return -np.linalg.solve(low.T, np.linalg.solve(low, down))
    except np.linalg.LinAlgError:
        return None


def _solved_small(a: list[list[float]], down: list[float], damping: float, options: Options) -> np.ndarray | None:
    """solved for few constants, where calls into a library would take longer than the sums: Cholesky by rows."""
    low: list[list[float]] = []
    there: list[float] = []
    for i, row in enumerate(a):
        own: list[float] = []
        for j in range(i):
            own.append((row[j] - sum(map(mul, own, low[j]))) / low[j][j])
        diagonal = (row[i] * (1 + damping) if options.damping == "relative" else row[i] + damping) + options.pivot_floor - sum(map(mul, own, own))
        if not diagonal > 0:
            return None
        there.append((down[i] - sum(map(mul, own, there))) / sqrt(diagonal))
        low.append([*own, sqrt(diagonal)])
    for i in range(len(a) - 1, -1, -1):
        there[i] = (there[i] - sum(low[k][i] * there[k] for k in range(i + 1, len(a)))) / low[i][i]
    return -np.array(there)


def _solved_many(a: np.ndarray, down: np.ndarray, damping: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """The steps of _solved_small for many trees at once, in its order, and which of them there are."""
    low: list[list[np.ndarray]] = []
    there: list[np.ndarray] = []
    fine = np.ones(len(a), bool)
    for i in range(down.shape[1]):
        own: list[np.ndarray] = []
        for j in range(i):
            own.append((a[:, i, j] - sum(map(mul, own, low[j]))) / low[j][j])
        diagonal = (a[:, i, i] * (1 + damping) if options.damping == "relative" else a[:, i, i] + damping) + options.pivot_floor - sum(map(mul, own, own))
        fine &= diagonal > 0
        root = np.sqrt(diagonal)
        there.append((down[:, i] - sum(map(mul, own, there))) / root)
        low.append([*own, root])
    for i in range(len(low) - 1, -1, -1):
        there[i] = (there[i] - sum(low[k][i] * there[k] for k in range(i + 1, len(low)))) / low[i][i]
    return -np.stack(there, axis=1), fine


def damped_step(jtj: Column, jtr: Column, damping: Column, options: Options = Options()) -> Column:
    """The damped normal step of each tree, null where the matrix isn't positive definite."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def steps(jtj: pa.Array, jtr: pa.Array, damping: pa.Array) -> pa.Array:
        rows = zip(jtj.to_pylist(), jtr.to_pylist(), damping.to_pylist())
        out = (solved(square(a, len(g)), np.asarray(g), lam, options) for a, g, lam in rows)
        return pa.array([None if step is None else step.tolist() for step in out], pa.list_(pa.float64()))

    return steps(jtj, jtr, damping)


def fit_one(nodes: list[dict], c: np.ndarray, points: tuple[np.ndarray, np.ndarray, np.ndarray], max_iter: int, options: Options) -> tuple:
    """c_final, status, n_iter, loss_init, loss_final of one tree over its points: the schedule.

    A step that can't be solved for or that is uphill raises lambda; beyond LAMBDA_MAX the fit has
    failed. A step to a loss that isn't finite ends it as failed. A step that is taken and small
    ends it as converged, and no other does.
    """
    loss, jtj, jtr = arrays.numbers(nodes, c, points, options.jacobian)
    first, damping = loss, LAMBDA0
    if not np.isfinite(loss):
        return c, FAIL_NAN, 0, first, loss
    for i in range(1, max_iter + 1):
        step = solved(jtj, jtr, damping, options)
        if step is None:
            damping *= 10
            if damping > LAMBDA_MAX:
                return c, FAIL_CHOLESKY, i, first, loss
            continue
        there = c + step
        t_loss, t_jtj, t_jtr = arrays.numbers(nodes, there, points, options.jacobian)
        if not np.isfinite(t_loss):
            return c, FAIL_NAN, i, first, loss
        small = sqrt(step.dot(step)) < options.xtol * (sqrt(there.dot(there)) + options.xtol)
        better = t_loss <= loss
        if better or (small and options.order == "step"):
            c, loss, jtj, jtr = there, t_loss, t_jtj, t_jtr
            if small:
                return c, CONVERGED, i, first, loss
            damping = max(damping * 0.1, LAMBDA_MIN)
        else:
            damping *= 10
            if damping > LAMBDA_MAX:
                return c, FAIL_NAN, i, first, loss
    return c, MAXITER, max_iter, first, loss


def fit_many(nodes: list[dict], c: np.ndarray, points: list[tuple[np.ndarray, np.ndarray, np.ndarray]], max_iter: int, options: Options) -> list[tuple]:
    """fit_one for trees of one structure, a row of c and points each: the same schedule, but what numpy is
    called for is called once for all trees whose fits go on."""
    status, n_iter, damping = np.full(len(c), MAXITER), np.full(len(c), max_iter), np.full(len(c), LAMBDA0)

    def together(which: np.ndarray) -> tuple:
        x, y, there = (np.concatenate([points[i][part] for i in which]) for part in range(3))
        return (np.asfortranarray(x), y, there), np.cumsum([0, *(len(points[i][1]) for i in which[:-1])])

    held, (at, first) = np.arange(len(c)), together(np.arange(len(c)))
    c = c.copy()
    loss, jtj, jtr = arrays.numbers_of_many(nodes, c, at, first, options.jacobian)
    start, going = loss.copy(), np.isfinite(loss)
    status[~going], n_iter[~going] = FAIL_NAN, 0
    for i in range(1, max_iter + 1):
        if not going.any():
            break

        def end(some: np.ndarray, why: int) -> None:
            status[some], n_iter[some], going[some] = why, i, False

        open_ = np.flatnonzero(going)
        step, fine = _solved_many(jtj[open_], jtr[open_], damping[open_], options)
        unsolved, go, step = open_[~fine], open_[fine], step[fine]
        damping[unsolved] *= 10
        end(unsolved[damping[unsolved] > LAMBDA_MAX], FAIL_CHOLESKY)
        if not len(go):
            continue
        if len(held) != len(go) or (held != go).any():
            held, (at, first) = go, together(go)
        there = c[go] + step
        t_loss, t_jtj, t_jtr = arrays.numbers_of_many(nodes, there, at, first, options.jacobian)
        finite = np.isfinite(t_loss)
        end(go[~finite], FAIL_NAN)
        small = np.sqrt((step * step).sum(axis=1)) < options.xtol * (np.sqrt((there * there).sum(axis=1)) + options.xtol)
        taken = finite & ((t_loss <= loss[go]) | (small & (options.order == "step")))
        to = go[taken]
        c[to], loss[to], jtj[to], jtr[to] = there[taken], t_loss[taken], t_jtj[taken], t_jtr[taken]
        end(go[taken & small], CONVERGED)
        damping[to] = np.maximum(damping[to] * 0.1, LAMBDA_MIN)
        uphill = go[finite & ~taken]
        damping[uphill] *= 10
        end(uphill[damping[uphill] > LAMBDA_MAX], FAIL_NAN)
    return list(zip(c, status.tolist(), n_iter.tolist(), start.tolist(), loss.tolist()))


def fit_all(trees: list[dict], points: list[tuple[np.ndarray, np.ndarray, np.ndarray]], max_iter: int, options: Options) -> list[tuple]:
    """The fit of each tree to its own points. Trees of one structure go together, up to MANY_POINTS points in all."""
    starts = [np.array(tree["c"], dtype=float) for tree in trees]
    one = fit_one if options.method == "lm" else minimise_one
    lots: list[list[int]] = []
    last: dict[tuple, tuple[list[int], int]] = {}
    for i, (tree, c, at) in enumerate(zip(trees, starts, points)):
        key = (tuple((n["nt"], n["nv"], n["ci"]) for n in tree["nodes"]), len(c), at[0].shape[1])
        if options.method != "lm" or len(c) > SMALL or not len(at[1]):
            lots.append([i])
            continue
        lot, size = last.get(key, ([], MANY_POINTS))
        if size + len(at[1]) > MANY_POINTS:
            lots.append(lot := [])
            size = 0
        lot.append(i)
        last[key] = lot, size + len(at[1])
    out: list[tuple] = [()] * len(trees)
    for lot in lots:
        if len(lot) == 1:
            out[lot[0]] = one(trees[lot[0]]["nodes"], starts[lot[0]], points[lot[0]], max_iter, options)
            continue
        for i, fit in zip(lot, fit_many(trees[lot[0]]["nodes"], np.stack([starts[i] for i in lot]), [points[i] for i in lot], max_iter, options)):
            out[i] = fit
    return out


def differences(tree: t.Tree, x: Callable[[int], Column], c: Callable[[int], Column], k: int) -> dict[int, Column]:
    """Forward differences by each of k constants, divided by the step that is really taken."""
    here, out = t.compiled(tree, x, c), {}
    for i in range(k):
        moved = c(i) + F.when(c(i) == 0, F.lit(1e-3)).otherwise(1e-3 * F.abs(c(i)))
        there = t.compiled(tree, x, lambda j, i=i, moved=moved: moved if j == i else c(j))
        out[i] = (there - here) / (moved - c(i))
    return out


def central(tree: t.Tree, x: Callable[[int], Column], c: Callable[[int], Column], k: int, relative: float = 1e-6) -> dict[int, Column]:
    """Central differences by each of k constants."""
    out = {}
    for i in range(k):
        h = relative * F.greatest(F.abs(c(i)), F.lit(1.0))
        up, down = (t.compiled(tree, x, lambda j, i=i, s=s, h=h: c(j) + s * h if j == i else c(j)) for s in (1, -1))
        out[i] = (up - down) / (2 * h)
    return out


def by_constants(tree: t.Tree, x: Callable[[int], Column], c: Callable[[int], Column], jacobian: str) -> dict[int, Column]:
    """The derivative by each constant, in the way that jacobian names."""
    k = sum(n[0] == t.CONST for n in t.prefix(tree))
    ways = {"reverse": lambda: gradient(tree, x, c), "dual": lambda: dual(tree, x, c), "forward": lambda: differences(tree, x, c, k), "central": lambda: central(tree, x, c, k), "none": dict}
    return ways[jacobian]()


@F.arrow_udf(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("condition", T.DoubleType())]))
def conditioning(jtj: pa.Array, k: pa.Array) -> pa.Array:
    """Numeric rank (1e-12 of the largest eigenvalue) and condition number of each normal matrix."""
    out = []
    for a, n in zip(jtj.to_pylist(), k.to_pylist()):
        values = np.linalg.eigvalsh(square(a, n)) if n and np.isfinite(a).all() else np.zeros(1)
        top = values[-1]
        out.append({"rank": int((values > 1e-12 * top).sum()) if top > 0 else 0, "condition": float(top / values[0]) if values[0] > 0 else float("inf")})
    return pa.array(out, pa.struct([("rank", pa.int32()), ("condition", pa.float64())]))


def pass_over(state: DataFrame, points: DataFrame, known: list[tuple[str, t.Tree]], options: Options = Options()) -> DataFrame:
    """tree_id with loss, jtj (upper triangle by rows) and jtr at the constants in column `at`."""
    x, c = (lambda k: F.col("x")[k]), (lambda k: F.col("at")[k])
    widest = max([sum(n[0] == t.CONST for n in t.prefix(tree)) for _, tree in known] + [1])
    value = F.lit(None).cast("double")
    slopes = [F.lit(0.0)] * widest
    for name, tree in known:
        here = F.col("structure") == name
        own = by_constants(tree, x, c, options.jacobian)
        value = F.when(here, t.compiled(tree, x, c)).otherwise(value)
        slopes = [F.when(here, own[k]).otherwise(old) if k in own else old for k, old in enumerate(slopes)]
    rows = state.select("tree_id", "problem_id", "structure", "at").hint("shuffle_hash").join(points, "problem_id")
    rows = rows.select("tree_id", "y", F.size("at").alias("k"), value.alias("yh"), *(s.alias(f"j{i}") for i, s in enumerate(slopes)))
    r = F.col("yh") - F.col("y")
    pairs = [(i, j) for i in range(widest) for j in range(i, widest)]
    sums = rows.groupBy("tree_id").agg(
        F.first("k").alias("k"),
        half_sse(F.col("y"), F.col("yh")).alias("loss"),
        *(F.sum(F.col(f"j{i}") * F.col(f"j{j}")).alias(f"a{i}_{j}") for i, j in pairs),
        *(F.sum(F.col(f"j{i}") * r).alias(f"g{i}") for i in range(widest)),
    )
    upper = F.array(*(F.when((F.col("k") > j), F.col(f"a{i}_{j}")) for i, j in pairs))
    down = F.array(*(F.when(F.col("k") > i, F.col(f"g{i}")) for i in range(widest)))
    return sums.select("tree_id", "loss", F.array_compact(upper).alias("jtj"), F.array_compact(down).alias("jtr"))


_DONE = ["tree_id", "c_final", "status", "n_iter", "loss_init", "loss_final"]


def fit_in_tasks(some: DataFrame, points: DataFrame, max_iter: int, options: Options, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The fits of some (tree_id, problem_id, nodes, c), each in one task; problems of few points alone."""
    arrays.small_batches(some)
    counts = save(some.groupBy("problem_id").agg(F.ceil(F.count("*") / LOCAL_TREES).alias("parts"), F.ceil(F.count("*") / F.ceil(F.count("*") / LOCAL_TREES) / ROW_TREES).alias("lots")))
    gathered = points.groupBy("problem_id").agg(F.collect_list(F.struct("x", "y")).alias("block")).join(shuffled(counts.drop("lots")), "problem_id")
    blocks = gathered.select("problem_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    placed = some.join(shuffled(counts), "problem_id").withColumns({"part": F.pmod(F.xxhash64("tree_id"), F.col("parts")), "lot": F.pmod(F.xxhash64(F.lit(1), "tree_id"), F.col("lots"))})
    spark = some.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by number, so that small tables aren't put together into one task
    rows = placed.repartition(tasks, "problem_id", "part").groupBy("problem_id", "part", "lot").agg(F.collect_list(F.struct("tree_id", "nodes", "c")).alias("trees"))  # ROW_TREES about, in their task
    met = rows.join(shuffled(blocks.repartition(tasks, "problem_id", "part")), ["problem_id", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, points = [], []
            for some_trees, block in zip(batch.column("trees"), batch.column("block")):
                trees += some_trees.as_py()
                points += [arrays.points_of(block.values)] * len(some_trees)
            with np.errstate(all="ignore"):
                done = fit_all(trees, points, max_iter, options)
            c, status, n_iter, first, last = zip(*done) if done else ((),) * 5
            columns = [batch.column("trees").flatten().field("tree_id"), pa.array([v.tolist() for v in c], pa.list_(pa.float64())), pa.array(status, pa.int32()), pa.array(n_iter, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.float64()), pa.array(last, pa.float64())], names=_DONE)

    kinds = [T.ArrayType(T.DoubleType()), T.IntegerType(), T.IntegerType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([some.schema["tree_id"], *(T.StructField(name, kind) for name, kind in zip(_DONE[1:], kinds))])
    return save(met.select("trees", "block").mapInArrow(run, schema))


def fit_in_rounds(some: DataFrame, points: DataFrame, max_iter: int, options: Options, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The fits of some (tree_id, problem_id, nodes, c), a pass over the points each round."""
    known = few_structures(some)
    # with too many structures to compile, the trees' nodes are the data
    structure = F.sha2(F.to_json("nodes"), 256) if known is not None else F.col("nodes")
    some = some.withColumn("structure", structure).drop("nodes")
    if known is not None:
        over = lambda rows: pass_over(rows, points, known, options)
    else:
        blocks = save(arrays.blocked(points))
        over = lambda rows: arrays.pass_over(rows.withColumnRenamed("structure", "nodes"), blocks, options.jacobian)
    if options.method in METHODS:
        return minimise_in_rounds(some, points, over, max_iter, options, save)
    first = over(some.withColumn("at", F.col("c")))
    state = some.join(shuffled(first), "tree_id").withColumns(
        {"lambda": F.lit(LAMBDA0), "n_iter": F.lit(0), "loss_init": F.col("loss"), "status": F.when(~is_finite(F.col("loss")), F.lit(FAIL_NAN))}
    )
    state = save(state)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda m, a: m + a * a))
    for _ in range(max_iter):
        if state.where("status is null").limit(1).count() == 0:
            break
        open_ = state.where("status is null").withColumn("step", damped_step(F.col("jtj"), F.col("jtr"), F.col("lambda"), options))
        trial = open_.withColumn("at", F.zip_with("c", "step", lambda a, d: a + d))
        tried = over(trial.where("step is not null"))
        tried = tried.select("tree_id", F.col("loss").alias("t_loss"), F.col("jtj").alias("t_jtj"), F.col("jtr").alias("t_jtr"))
        met = trial.join(shuffled(tried), "tree_id", "left")
        fine = F.coalesce(is_finite(F.col("t_loss")), F.lit(False))
        small = F.coalesce(norm(F.col("step")) < options.xtol * (norm(F.col("at")) + options.xtol), F.lit(False))
        taken = fine & (F.col("t_loss") <= F.col("loss"))
        if options.order == "step":
            taken = fine & ((F.col("t_loss") <= F.col("loss")) | small)
        damped = F.when(taken, F.greatest(F.col("lambda") * 0.1, F.lit(LAMBDA_MIN))).otherwise(F.col("lambda") * 10)
        unsolved = F.col("step").isNull()
        ended = (
            F.when(unsolved, F.when(damped > LAMBDA_MAX, F.lit(FAIL_CHOLESKY)))
            .when(~fine, F.lit(FAIL_NAN))
            .when(taken, F.when(small, F.lit(CONVERGED)))
            .when(damped > LAMBDA_MAX, F.lit(FAIL_NAN))
        )
        pick = lambda new, old: F.when(taken, F.col(new)).otherwise(F.col(old))
        went = met.select(
            "tree_id", "problem_id", "structure", pick("at", "c").alias("c"), pick("t_loss", "loss").alias("loss"), pick("t_jtj", "jtj").alias("jtj"),
            pick("t_jtr", "jtr").alias("jtr"), damped.alias("lambda"), (F.col("n_iter") + 1).alias("n_iter"), "loss_init", ended.alias("status"),
        )
        state = save(went.unionByName(state.where("status is not null").select(*went.columns)))
    return state.select(
        "tree_id", F.col("c").alias("c_final"), F.coalesce("status", F.lit(MAXITER)).alias("status"), "n_iter", "loss_init", F.col("loss").alias("loss_final")
    )


def fit(population: DataFrame, points: DataFrame, max_iter: int = 50, save: Callable[[DataFrame], DataFrame] | None = None, options: Options = Options()) -> DataFrame:
    """tree_id, c_final, status, n_iter, loss_init, loss_final.

    An uphill step is never taken; trees without constants are passed by (status 3). save keeps
    what is computed and cuts the lineage.
    """
    save = save or (lambda df: df.checkpoint())
    base = population.select("tree_id", "problem_id", "nodes", "c")
    if options.bounds is not None:
        low, high = map(F.lit, options.bounds)
        base = base.withColumn("c", F.transform("c", lambda v: F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, low), high))))
    some = base.where(F.size("c") > 0)
    large = None
    if options.plan == "size":
        large = save(points.groupBy("problem_id").count().where(F.col("count") > LOCAL_POINTS).select("problem_id"))
        large = large if large.limit(1).count() else None
    if options.plan == "rounds":
        done = fit_in_rounds(some, points, max_iter, options, save)
    elif large is None:
        done = fit_in_tasks(some, points, max_iter, options, save)
    else:
        apart = lambda how: (some.join(large, "problem_id", how), points.join(large, "problem_id", how))
        done = fit_in_tasks(*apart("left_anti"), max_iter, options, save).unionByName(fit_in_rounds(*apart("left_semi"), max_iter, options, save))
    none = F.lit(None).cast("double")
    without = base.where(F.size("c") == 0).select(
        "tree_id", F.col("c").alias("c_final"), F.lit(K0_SKIP).alias("status"), F.lit(0).alias("n_iter"), none.alias("loss_init"), none.alias("loss_final")
    )
    return done.unionByName(without)


def written_back(population: DataFrame, fits: DataFrame) -> DataFrame:
    """The population with fitted constants where a fit brought finite ones; the rest as they were."""
    fine = F.coalesce(F.forall("c_final", is_finite), F.lit(False)) & (F.size("c_final") == F.size("c"))
    kept = [x for x in population.columns if x != "c"]
    met = population.join(shuffled(fits.select("tree_id", "c_final", "status")), "tree_id", "left")
    return met.select(*kept, F.when(fine, F.col("c_final")).otherwise(F.col("c")).alias("c"), F.coalesce("status", F.lit(FAIL_NAN)).alias("status"))


def progressed(status: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """(converged, why it stopped): a solver's word counts only where the loss fell, and below 1e18."""
    fell = F.coalesce(is_finite(last) & (last < first) & (last < 1e18), F.lit(False))
    why = F.when(status == K0_SKIP, "no_constants").when(~is_finite(last), "nan").when(~fell, "no_progress").when(status == CONVERGED, "small_step").when(status == MAXITER, "max_iter").otherwise("unsolved")
    return (status == CONVERGED) & fell, why


#: Named ways to fit; a caller may add its own under a new name.
BACKENDS = {
    "lm": Options(),
    "lm_dual": Options(jacobian="dual"),
    "lm_differences": Options(jacobian="forward"),
    "lm_step_first": Options(order="step"),
    "tight": Options(xtol=1e-10),
    "bfgs": Options(method="bfgs"),
    "l-bfgs": Options(method="l-bfgs"),
    "cg": Options(method="cg"),
    "nelder-mead": Options(method="nelder-mead", jacobian="none"),
}


def backend(name: str) -> Options:
    if name not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


def starts(population: DataFrame, n: int, scale: float, seed: int) -> DataFrame:
    """n starts for each tree (trial 0 as it is, the others scattered), by draws that follow from
    the seed, tree and trial alone."""
    trials = population.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), "tree_id", "trial", k), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return trials.withColumn("c", F.when(F.col("trial") == 0, F.col("c")).otherwise(F.transform("c", lambda v, k: v * (1 + scale * (2 * unit(k) - 1)))))


def best_of(fits: DataFrame) -> DataFrame:
    """The fit of least final loss for each tree; ties go to the earlier trial."""
    order = F.struct(F.coalesce("loss_final", F.lit(INF)), "trial")
    return fits.groupBy("tree_id").agg(F.min_by(F.struct(*[x for x in fits.columns if x != "tree_id"]), order).alias("best")).select("tree_id", "best.*")
