"""Trees evaluated as data: the path for populations of more structures than are worth compiling.

The points of a problem are gathered in blocks; a tree meets a block in one row, and its nodes run
over the block's points with a stack, as numpy arrays. What leaves Python is a prediction a point, or
the block's sums, which are added up by tree as the compiled path's partial sums are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ops import BY_CODE, CONST, VAR, Arrays
from ..sources.shared import shuffled

#: Points of a block, on average, and rows of trees and blocks that Python holds at once.
BLOCK, BATCH_ROWS = 1024, 256

Array = np.ndarray


def blocked(points: DataFrame) -> DataFrame:
    """problem_id and block, an array of about BLOCK of its points; a large problem has many."""
    some = points.groupBy("problem_id").agg(F.ceil(F.count("*") / BLOCK).alias("__blocks"))
    rest = [c for c in points.columns if c != "problem_id"]
    placed = points.withColumn("__row", F.monotonically_increasing_id()).join(shuffled(some), "problem_id")
    place = F.pmod(F.xxhash64("__row"), F.col("__blocks")).alias("__block")
    return placed.groupBy("problem_id", place).agg(F.collect_list(F.struct(*rest)).alias("block")).drop("__block")


def small_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches, whose rows hold a block each; smaller ones stay as they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def _taped(nodes: list[dict], x: Array, c: Array) -> tuple[list[Array], list[tuple[int, ...]]]:
    """The value of every node over the points, and the places of its operands. A constant is a number, or
    has a value a point where points of several trees stand in a row."""
    values: list = [None] * len(nodes)
    below: list[tuple[int, ...]] = [()] * len(nodes)
    stack: list[int] = []
    for at in range(len(nodes) - 1, -1, -1):
        node = nodes[at]
        if node["nt"] == VAR:
            values[at] = x[:, int(node["nv"])]
        elif node["nt"] == CONST:
            values[at] = np.empty(len(x))
            values[at][:] = c[node["ci"]]
        else:
            op = BY_CODE[int(node["nv"])]
            if op.arity != node["nt"] - CONST:
                raise ValueError(f"no such node: {node}")
            below[at] = tuple(stack.pop() for _ in range(op.arity))
            values[at] = op.array(*(values[b] for b in below[at]))
        stack.append(at)
    if len(stack) != 1:
        raise ValueError("not one tree")
    return values, below


def value(nodes: list[dict], x: Array, c: Array) -> Array:
    return _taped(nodes, x, c)[0][0]


def slopes(nodes: list[dict], x: Array, c: Array) -> tuple[Array, Array]:
    """The values and their derivatives by each constant, with the adjoints of fitting.gradient."""
    values, below = _taped(nodes, x, c)
    out = np.zeros((len(c), len(x)))
    adjoint: list = [1.0] * len(nodes)
    holds = [node["nt"] == CONST for node in nodes]  # whether a constant is in the subtree: no other needs its adjoint
    for at in range(len(nodes) - 1, -1, -1):
        holds[at] = holds[at] or any(holds[b] for b in below[at])
    for at, node in enumerate(nodes):
        weight = adjoint[at]
        if node["nt"] == CONST:
            out[node["ci"]] += weight
        elif below[at]:
            op = BY_CODE[int(node["nv"])]
            if op.partials is None:
                raise ValueError(f"{op.name} has no derivative here")
            if not holds[at]:
                continue
            for b, partial in zip(below[at], op.partials(Arrays, *(values[b] for b in below[at]), values[at])):
                if not holds[b]:
                    continue
                if isinstance(weight, float) and weight == 1.0:
                    adjoint[b] = partial
                elif isinstance(partial, float):
                    adjoint[b] = weight * partial
                else:
                    adjoint[b] = weight * partial
                    if not np.isfinite(adjoint[b]).all():  # only then is 0 times something not 0
                        adjoint[b] = np.where((weight == 0) | (partial == 0), 0.0, adjoint[b])
    return values[0], out


def differences(nodes: list[dict], x: Array, c: Array) -> tuple[Array, Array]:
    """The values and forward differences, with the steps of fitting.differences."""
    here, out = value(nodes, x, c), np.zeros((len(c), len(x)))
    for i in range(len(c)):
        moved = c.copy()
        moved[i] += np.where(c[i] == 0, 1e-3, 1e-3 * np.abs(c[i]))
        out[i] = (value(nodes, x, moved) - here) / (moved[i] - c[i])
    return here, out


def dual(nodes: list[dict], x: Array, c: Array) -> tuple[Array, Array]:
    """The values and their derivatives, each node's tangents made from those of its operands."""
    values, below = _taped(nodes, x, c)
    tangents: list[dict[int, Array]] = [{} for _ in nodes]
    for at in range(len(nodes) - 1, -1, -1):
        node = nodes[at]
        if node["nt"] == CONST:
            tangents[at] = {node["ci"]: np.ones(len(x))}
        elif below[at]:
            op = BY_CODE[int(node["nv"])]
            if op.partials is None:
                raise ValueError(f"{op.name} has no derivative here")
            for b, partial in zip(below[at], op.partials(Arrays, *(values[b] for b in below[at]), values[at])):
                for k, tangent in tangents[b].items():
                    term = np.where((tangent == 0) | (partial == 0), 0.0, partial * tangent)
                    tangents[at][k] = tangents[at][k] + term if k in tangents[at] else term
    return values[0], np.array([tangents[0].get(k, np.zeros(len(x))) for k in range(len(c))]).reshape(len(c), len(x))


def central(nodes: list[dict], x: Array, c: Array) -> tuple[Array, Array]:
    """The values and central differences, with the steps of fitting.central."""
    out = np.zeros((len(c), len(x)))
    for i in range(len(c)):
        h = 1e-6 * np.maximum(np.abs(c[i]), 1.0)
        ends = []
        for side in (1, -1):
            moved = c.copy()
            moved[i] += side * h
            ends.append(value(nodes, x, moved))
        out[i] = (ends[0] - ends[1]) / (2 * h)
    return value(nodes, x, c), out


def flat(nodes: list[dict], x: Array, c: Array) -> tuple[Array, Array]:
    """The values alone, for a minimiser that asks for no derivative."""
    return value(nodes, x, c), np.zeros((len(c), len(x)))


#: Ways to a derivative by name; fitting.by_constants has the same names over columns.
JACOBIANS = {"reverse": slopes, "dual": dual, "forward": differences, "central": central, "none": flat}


def _doubles(values: pa.Array) -> Array:
    """Doubles of a flat array, NaN for nulls."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def points_of(block: pa.Array) -> tuple[Array, Array, Array]:
    """x (a row a point), y and whether y is there, of one block."""
    x = block.field("x")
    width = int(np.diff(x.offsets.to_numpy()).max(initial=0)) if x.null_count == 0 else max([len(v.as_py() or ()) for v in x], default=0)
    if x.null_count == 0 and len(x.flatten()) == width * len(x):
        matrix = _doubles(x.flatten()).reshape(len(x), width)
    else:
        matrix = np.full((len(x), width), np.nan)
        for i, v in enumerate(x.to_pylist()):
            matrix[i, : len(v or ())] = [np.nan if a is None else a for a in v or ()]
    return matrix, _doubles(block.field("y")), block.field("y").is_valid().to_numpy(zero_copy_only=False)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def predictions(nodes: pa.Array, c: pa.Array, block: pa.Array) -> pa.Array:
    """The tree's value at each point of the block."""
    with np.errstate(all="ignore"):
        out = [value(n, points_of(b.values)[0], np.array(k, dtype=float)) for n, k, b in zip(nodes.to_pylist(), c.to_pylist(), block)]
    return pa.array([v.tolist() for v in out], pa.list_(pa.float64()))


def numbers(nodes: list[dict], c: Array, points: tuple[Array, Array, Array], jacobian: str) -> tuple[float, Array, Array]:
    """loss, jtj and jtr of a tree over all points of its problem, as the passes over blocks add them up."""
    x, y, there = points
    yh, j = JACOBIANS[jacobian](nodes, x, c)
    r = yh - y
    if there.all():
        return 0.5 * float((r**2).sum()) if np.isfinite(yh).all() else float("inf"), j @ j.T, j @ r
    loss = 0.5 * float((r[there] ** 2).sum()) if np.isfinite(yh).all() else float("inf")
    return loss, j @ j.T, j[:, there] @ r[there]


def numbers_of_many(nodes: list[dict], c: Array, points: tuple[Array, Array, Array], first: Array, jacobian: str) -> tuple[Array, Array, Array]:
    """numbers of trees of one structure, a row of c each, whose points stand in a row, each tree's from its place in first on."""
    x, y, there = points
    yh, j = JACOBIANS[jacobian](nodes, x, np.repeat(c.T, np.diff(first, append=len(x)), axis=1))
    r = yh - y
    if not there.all():
        r[~there] = 0.0
    loss = np.where(np.logical_and.reduceat(np.isfinite(yh), first), 0.5 * np.add.reduceat(r * r, first), np.inf)
    k = len(j)
    jtj, jtr = np.empty((len(c), k, k)), np.empty((len(c), k))
    for a in range(k):
        jtr[:, a] = np.add.reduceat(j[a] * r if there.all() else np.where(there, j[a] * r, 0.0), first)
        for b in range(a, k):
            jtj[:, a, b] = jtj[:, b, a] = np.add.reduceat(j[a] * j[b], first)
    return loss, jtj, jtr


def sums(nodes: Column, c: Column, block: Column, jacobian: str) -> Column:
    """Half the squared residuals, predictions that aren't finite, then the sums of the derivatives'
    products with the residual (K) and each other (upper triangle by rows)."""
    run = JACOBIANS[jacobian]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def summed(nodes: pa.Array, c: pa.Array, block: pa.Array) -> pa.Array:
        out = []
        with np.errstate(all="ignore"):
            for n, k, b in zip(nodes.to_pylist(), c.to_pylist(), block):
                x, y, there = points_of(b.values)
                yh, j = run(n, x, np.array(k, dtype=float))
                r, fine = yh - y, np.isfinite(yh)
                # point by point products, so that inf and 0 meet as they do in columns
                products = [(j[a] * j[b]).sum() for a, b in zip(*np.triu_indices(len(j)))]
                out.append([0.5 * (r[fine & there] ** 2).sum(), float((~fine).sum()), *((row[there] * r[there]).sum() for row in j), *products])
        return pa.array(out, pa.list_(pa.float64()))

    return summed(nodes, c, block)


def pass_over(state: DataFrame, blocks: DataFrame, jacobian: str) -> DataFrame:
    """tree_id with loss, jtj (upper triangle by rows) and jtr at the constants in column `at`."""
    small_batches(state)
    rows = state.select("tree_id", "problem_id", "nodes", "at").join(shuffled(blocks), "problem_id")
    one = rows.select("tree_id", F.size("at").alias("k"), F.posexplode(sums(F.col("nodes"), F.col("at"), F.col("block"), jacobian)).alias("i", "v"))
    added = one.groupBy("tree_id", "k", "i").agg(F.sum("v").alias("v"))
    # a tree's own numbers, (K + 1) (K + 2) / 2 + 1 of them
    lists = added.groupBy("tree_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda a: a["v"]).alias("s"))
    loss = F.when(F.col("s")[1] > 0, F.lit(float("inf"))).otherwise(F.col("s")[0])
    return lists.select("tree_id", loss.alias("loss"), F.slice("s", F.col("k") + 3, F.size("s")).alias("jtj"), F.slice("s", F.lit(3), F.col("k")).alias("jtr"))
