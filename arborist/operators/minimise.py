"""Minimisers of the mean square by its gradient alone (BFGS, L-BFGS and conjugate gradients) or by its
values alone (Nelder and Mead's simplex); those by gradients within bounds where wanted.

One schedule for all, as a walk that only asks for the loss and the gradient at its next trial point.
So the same walk runs inside a task over a problem's points, and in rounds for large problems, where
each trial is one pass over the points of all open trees and what is left per tree is a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import numbers

METHODS = ("bfgs", "l-bfgs", "cg", "nelder-mead")
#: Pairs that L-BFGS remembers; halvings of a step before a walk ends; the gradient that counts as none.
PAIRS, HALVINGS, FLAT = 10, 40, 1e-8
#: The relative change of a loss that is rounding; the share of the slope along a way that may be left, turned, behind such a step.
ROUNDING, TURNED = 1e-12, 0.8
#: The simplex: how far a corner is put from the start, of a constant or of 0, and the relative size that counts as a point.
STRETCH, STRETCH_0, POINT = 0.05, 2.5e-4, 1e-8
#: What the simplex tries: a corner of the first one, or one shrunk to the best; the worst reflected, beyond that, or pulled in;
#: at its end the points that a quadratic surface is laid through, and its lowest point.
CORNER, REFLECTED, EXPANDED, OUTSIDE, INSIDE, SURFACE, LOWEST = range(7)
#: How far these points are from the best, relative to its constants (1 at least), and the relative change of a loss that is their rounding.
SPACING, LEVEL = 1e-3, 1e-14
#: Statuses as those of fitting.
CONVERGED, MAXITER, FAIL_NAN = 0, 1, 2


@dataclass
class Walk:
    """Where a minimiser stands: constants, loss (half the sum of squares), slope of the mean square, the
    way it tries and how much of it, what it remembers, rounds done, and status once ended (-1 before).

    Constants stay between low and high: a trial beyond is put on the bound. The simplex, which knows no bounds
    (put on one, it would go flat), has its corners in memory, and its way leads from the best to what it tries."""

    c: np.ndarray
    loss: float
    slope: np.ndarray
    way: np.ndarray
    share: float
    memory: np.ndarray
    n_iter: int
    status: int
    first: float
    low: float = -np.inf
    high: float = np.inf
    fitted: int = 0  # whether the share comes from the slopes at both ends of the first one

    @property
    def trial(self) -> np.ndarray:
        return np.clip(self.c + self.share * self.way, self.low, self.high)

    @property
    def held(self) -> np.ndarray:
        """Constants on a bound that the slope leads beyond."""
        return ((self.c <= self.low) & (self.slope > 0)) | ((self.c >= self.high) & (self.slope < 0))


def _inverse(walk: Walk) -> np.ndarray:
    k = len(walk.c)
    return walk.memory.reshape(k, k) if len(walk.memory) else np.eye(k)


def _way(walk: Walk, method: str) -> np.ndarray:
    """The direction to try next, from what is remembered, among the constants that aren't held on a bound: what is
    remembered of the others would bend it."""
    k, held = len(walk.c), walk.held
    slope = np.where(held, 0.0, walk.slope)
    if method == "bfgs":
        inverse = _inverse(walk)
        if held.any():
            free, across = np.ix_(~held, ~held), np.ix_(~held, held)
            own = inverse[free] - inverse[across] @ np.linalg.pinv(inverse[np.ix_(held, held)]) @ inverse[across].T
            inverse = np.zeros((k, k))
            inverse[free] = own
        return -inverse @ slope
    if method == "cg":
        if not len(walk.memory) or walk.memory[:k][held].any():
            return -slope
        before, was = walk.memory[:k], np.where(held, 0.0, walk.memory[k:])
        return -slope + max(0.0, slope @ (slope - was) / max(was @ was, 1e-300)) * before
    pairs = walk.memory.reshape(-1, 2, k)
    pairs = np.where(held, 0.0, pairs[~pairs[:, 0, held].any(axis=1)])
    left, weights = slope.copy(), []
    for step, change in pairs[::-1]:
        weights.append(step @ left / (step @ change))
        left = left - weights[-1] * change
    if len(pairs):
        step, change = pairs[-1]
        left = left * (step @ change) / (change @ change)
    for (step, change), weight in zip(pairs, weights[::-1]):
        left = left + (weight - change @ left / (step @ change)) * step
    return -left


def _set_out(walk: Walk, method: str, max_iter: int) -> Walk:
    """The walk with its next way, or ended: no slope is left, or no round."""
    held = walk.held
    if np.abs(walk.slope[~held]).max(initial=0.0) < FLAT:
        walk.status = CONVERGED
        return walk
    if walk.n_iter >= max_iter:
        walk.status = MAXITER
        return walk
    walk.way = np.where(held, 0.0, _way(walk, method))
    if not np.isfinite(walk.way).all() or walk.way @ walk.slope >= 0:
        walk.memory, walk.way = np.zeros(0), np.where(held, 0.0, -walk.slope)
    # conjugate gradients have no scale of their own, so a way begins where the last one ended
    walk.share = min(1.0, 2 * walk.share) if method == "cg" and walk.n_iter else 1.0
    walk.n_iter, walk.fitted = walk.n_iter + 1, 0
    return walk


@dataclass
class Simplex:
    """What a walk of the simplex remembers: what it tries (and which corner, if one), the loss when the simplex was
    put up, the corners with their losses (NaN where not known), and the reflected point with its loss."""

    tries: int
    corner: int
    began: float
    points: np.ndarray
    losses: np.ndarray
    reflected: np.ndarray
    its_loss: float

    @classmethod
    def of(cls, memory: np.ndarray, k: int) -> Simplex:
        corners, rest = memory[3 : 3 + k * (k + 1)].reshape(k + 1, k), memory[3 + k * (k + 1) :]
        return cls(int(memory[0]), int(memory[1]), float(memory[2]), corners.copy(), rest[: k + 1].copy(), rest[k + 1 : -1].copy(), float(rest[-1]))

    @property
    def memory(self) -> np.ndarray:
        return np.concatenate([[self.tries, self.corner, self.began], self.points.ravel(), self.losses, self.reflected, [self.its_loss]])

    def asks(self, walk: Walk, point: np.ndarray) -> Walk:
        """The walk with this point to try next."""
        walk.way, walk.share, walk.memory = point - walk.c, 1.0, self.memory
        return walk


def _simplex_begun(walk: Walk, max_iter: int) -> Walk:
    """The walk with a simplex put up around its constants, or ended."""
    k = len(walk.c)
    if walk.loss == 0:
        walk.status = CONVERGED
        return walk
    if walk.n_iter >= max_iter:
        walk.status = MAXITER
        return walk
    points = np.tile(walk.c, (k + 1, 1))
    for i, v in enumerate(walk.c):
        points[i + 1, i] = v + (STRETCH * v if v else STRETCH_0)
    simplex = Simplex(CORNER, 1, walk.loss, points, np.array([walk.loss] + [np.nan] * k), walk.c, np.nan)
    return simplex.asks(walk, points[1])


def _simplex_round(walk: Walk, simplex: Simplex, max_iter: int) -> Walk:
    """All corners known: the walk's next round, or its end. A simplex may go flat away from a minimum, so one
    that shrank to a point is put up again there, until that brings nothing."""
    order = np.argsort(simplex.losses, kind="stable")
    simplex.points, simplex.losses = simplex.points[order], simplex.losses[order]
    walk.c, walk.loss = simplex.points[0].copy(), float(simplex.losses[0])
    size = np.abs(simplex.points[1:] - walk.c).max(initial=0.0)
    if walk.loss == 0 or size <= POINT * max(1.0, np.abs(walk.c).max(initial=0.0)):
        if walk.loss < simplex.began * (1 - 1e-9):
            return _simplex_begun(walk, max_iter)
        if walk.loss == 0:
            walk.status = CONVERGED
            return walk
        walk.memory = np.array([SURFACE], dtype=float)
        walk.way, walk.share = _stencil(walk.c)[0], 1.0
        return walk
    if walk.n_iter >= max_iter:
        walk.status = MAXITER
        return walk
    walk.n_iter += 1
    middle = simplex.points[:-1].mean(axis=0)
    simplex.tries, simplex.reflected = REFLECTED, 2 * middle - simplex.points[-1]
    return simplex.asks(walk, simplex.reflected)


def _stencil(c: np.ndarray) -> np.ndarray:
    """Ways to the points of a quadratic surface about c: up and down each constant, then up each two."""
    out = np.diag(SPACING * np.maximum(1.0, np.abs(c)))
    pairs = [out[i] + out[j] for i in range(len(c)) for j in range(i)]
    return np.concatenate([out, -out, np.reshape(pairs, (-1, len(c)))])


def _surface_went(walk: Walk, loss: float) -> Walk:
    """The walk after a point of the surface, or its lowest, had this loss. Values alone tell points near a minimum
    apart to the root of their rounding; a surface through points further off has its lowest point to more digits."""
    if walk.memory[0] == LOWEST:
        if loss <= min(walk.loss * (1 + LEVEL), walk.first):
            walk.c, walk.loss = walk.trial, loss
        walk.status = CONVERGED
        return walk
    walk.memory = np.append(walk.memory, loss)
    k, ways, rise = len(walk.c), _stencil(walk.c), walk.memory[1:] - walk.loss
    if len(rise) < len(ways):
        walk.way = ways[len(rise)]
        return walk
    size, up, down = np.diag(ways[:k]), rise[:k], rise[k : 2 * k]
    slope, bend = (up - down) / 2, np.diag(up + down)
    at = np.tril_indices(k, -1)
    bend[at] = rise[2 * k :] - up[at[0]] - up[at[1]]
    bend += np.tril(bend, -1).T
    walk.status = CONVERGED
    if np.isfinite(rise).all() and np.linalg.eigvalsh(bend)[0] > 0:
        step = -np.linalg.solve(bend, slope)
        if np.abs(step).max() <= 1:  # in units of the spacing
            walk.way, walk.memory, walk.status = step * size, np.array([LOWEST], dtype=float), -1
    return walk


def _simplex_went(walk: Walk, loss: float, max_iter: int) -> Walk:
    """The walk after its trial point had this loss; one that isn't finite is worse than any."""
    if walk.memory[0] in (SURFACE, LOWEST):
        return _surface_went(walk, loss)
    simplex, trial = Simplex.of(walk.memory, len(walk.c)), walk.trial
    loss = loss if np.isfinite(loss) else np.inf
    if simplex.tries == CORNER:
        simplex.points[simplex.corner], simplex.losses[simplex.corner] = trial, loss
        left = np.flatnonzero(np.isnan(simplex.losses))
        if len(left):
            simplex.corner = int(left[0])
            return simplex.asks(walk, simplex.points[simplex.corner])
        return _simplex_round(walk, simplex, max_iter)
    losses, middle, worst = simplex.losses, simplex.points[:-1].mean(axis=0), simplex.points[-1]

    def replaced(point: np.ndarray, its: float) -> Walk:
        simplex.points[-1], simplex.losses[-1] = point, its
        return _simplex_round(walk, simplex, max_iter)

    if simplex.tries == REFLECTED:
        if losses[0] <= loss < losses[-2]:
            return replaced(trial, loss)
        simplex.reflected, simplex.its_loss = trial, loss
        simplex.tries = EXPANDED if loss < losses[0] else OUTSIDE if loss < losses[-1] else INSIDE
        reach = {EXPANDED: 2.0, OUTSIDE: 0.5, INSIDE: -0.5}[simplex.tries]
        return simplex.asks(walk, middle + reach * (middle - worst))
    if simplex.tries == EXPANDED:
        return replaced(trial, loss) if loss < simplex.its_loss else replaced(simplex.reflected, simplex.its_loss)
    if loss < (losses[-1] if simplex.tries == INSIDE else simplex.its_loss):
        return replaced(trial, loss)
    simplex.points[1:] = (simplex.points[1:] + simplex.points[0]) / 2
    simplex.losses[1:], simplex.tries, simplex.corner = np.nan, CORNER, 1
    return simplex.asks(walk, simplex.points[1])


def begun(c: np.ndarray, loss: float, slope: np.ndarray, options, max_iter: int) -> Walk:
    none, bounds = np.zeros(0), options.bounds or (-np.inf, np.inf)
    walk = Walk(c, loss, slope, np.zeros(len(c)), 1.0, none, 0, -1, loss, *bounds)
    if options.method == "nelder-mead":
        walk.slope = np.zeros(len(c))
        if np.isfinite(loss):
            return _simplex_begun(walk, max_iter)
    if not np.isfinite(loss) or not np.isfinite(slope).all():
        walk.status = FAIL_NAN
        return walk
    return _set_out(walk, options.method, max_iter)


def went(walk: Walk, loss: float, slope: np.ndarray, n: int, method: str, max_iter: int) -> Walk:
    """The walk after its trial point had this loss and slope; n points. A step is taken if the loss falls
    enough along it, or changes by no more than rounding while the slope along it falls, else halved; if none
    is, the walk has converged if it ever went down. Conjugate gradients rely on steps that end where the slope
    along them does, so theirs is fitted once to the slopes at both ends."""
    if method == "nelder-mead":
        return _simplex_went(walk, loss, max_iter)
    step = walk.trial - walk.c if np.isfinite([walk.low, walk.high]).any() else walk.share * walk.way
    fine, fall = np.isfinite(loss) and np.isfinite(slope).all(), walk.slope @ step
    left = slope @ step if fine else np.nan
    if method == "cg" and fine and not walk.fitted and fall < 0 and abs(left) > 0.1 * -fall:
        walk.share *= float(np.clip(fall / (fall - left), 0.1, 10.0)) if left > fall else 10.0
        walk.fitted = 1
        return walk
    level = fine and loss <= min(walk.loss * (1 + ROUNDING), walk.first) and fall <= left <= -TURNED * fall
    if not (fine and (level or loss <= walk.loss + 1e-4 * n / 2 * fall)):
        walk.share *= 0.5
        if walk.share < 0.5**HALVINGS:
            walk.status = CONVERGED if walk.loss < walk.first else FAIL_NAN
        return walk
    change, k = slope - walk.slope, len(walk.c)
    bend = step @ change
    if method == "cg":
        walk.memory = np.concatenate([walk.way, walk.slope])
    elif bend > 1e-300 and method == "bfgs":
        turn = np.eye(k) - np.outer(step, change) / bend
        walk.memory = (turn @ _inverse(walk) @ turn.T + np.outer(step, step) / bend).ravel()
    elif bend > 1e-300:
        walk.memory = np.concatenate([walk.memory, step, change])[-2 * k * PAIRS :]
    walk.c, walk.loss, walk.slope = walk.trial, loss, slope
    return _set_out(walk, method, max_iter)


def minimise_one(nodes: list[dict], c: np.ndarray, points: tuple[np.ndarray, np.ndarray, np.ndarray], max_iter: int, options) -> tuple:
    """c_final, status, n_iter, loss_init, loss_final of one tree over its points."""
    n = max(int(points[2].sum()), 1)
    loss, _, down = numbers(nodes, c, points, options.jacobian)
    walk = begun(c, loss, 2 * down / n, options, max_iter)
    while walk.status < 0:
        loss, _, down = numbers(nodes, walk.trial, points, options.jacobian)
        walk = went(walk, loss, 2 * down / n, n, options.method, max_iter)
    return walk.c, walk.status, walk.n_iter, walk.first, walk.loss


_LISTS = ("c", "slope", "way", "memory")
_FIELDS = [(name, pa.list_(pa.float64()) if name in _LISTS else pa.int32() if name in ("n_iter", "status", "fitted") else pa.float64()) for name in Walk.__dataclass_fields__]
_KINDS = {pa.int32(): T.IntegerType(), pa.float64(): T.DoubleType()}
_WALK = T.StructType([T.StructField(name, _KINDS.get(kind, T.ArrayType(T.DoubleType()))) for name, kind in _FIELDS])


def _packed(walks: list[Walk]) -> pa.Array:
    rows = [{name: getattr(w, name).tolist() if name in _LISTS else getattr(w, name) for name, _ in _FIELDS} for w in walks]
    return pa.array(rows, pa.struct(_FIELDS))


def minimise_in_rounds(some: DataFrame, points: DataFrame, passes: Callable[[DataFrame], DataFrame], max_iter: int, options, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As minimise_one for all trees of some (tree_id, problem_id, c and what passes needs), a pass over the
    points for each trial. passes: tree_id, loss and jtr at the constants in column `at`."""
    method, rest = options.method, [c for c in some.columns if c != "c"]
    sizes = points.groupBy("problem_id").agg(F.greatest(F.count("y"), F.lit(1)).alias("__n"))
    some = save(some.join(sizes, "problem_id"))

    @F.arrow_udf(_WALK)
    def set_out(c: pa.Array, loss: pa.Array, jtr: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(c.to_pylist(), loss.to_pylist(), jtr.to_pylist(), n.to_pylist())
        with np.errstate(all="ignore"):
            return _packed([begun(np.array(a, dtype=float), x, 2 * np.array(g, dtype=float) / m, options, max_iter) for a, x, g, m in rows])

    @F.arrow_udf(_WALK)
    def step(walk: pa.Array, loss: pa.Array, jtr: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        with np.errstate(all="ignore"):
            for w, x, g, m in zip(walk.to_pylist(), loss.to_pylist(), jtr.to_pylist(), n.to_pylist()):
                held = Walk(**{name: np.array(v, dtype=float) if name in _LISTS else v for name, v in w.items()})
                out.append(went(held, x, 2 * np.array(g, dtype=float) / m, m, method, max_iter))
            return _packed(out)

    here = passes(some.withColumn("at", F.col("c"))).select("tree_id", "loss", "jtr")
    state = save(some.join(here, "tree_id").select(*rest, "__n", set_out("c", "loss", "jtr", "__n").alias("walk")))
    trial: Column = F.zip_with("walk.c", "walk.way", lambda a, d: F.least(F.greatest(a + F.col("walk.share") * d, F.col("walk.low")), F.col("walk.high")))
    while True:
        open_ = state.where("walk.status < 0")
        if open_.limit(1).count() == 0:
            break
        tried = passes(open_.withColumn("at", trial)).select("tree_id", "loss", "jtr")
        on = open_.join(tried, "tree_id").select(*rest, "__n", step("walk", "loss", "jtr", "__n").alias("walk"))
        state = save(on.unionByName(state.where("walk.status >= 0")))
    return state.select("tree_id", F.col("walk.c").alias("c_final"), F.col("walk.status").alias("status"), F.col("walk.n_iter").alias("n_iter"), F.col("walk.first").alias("loss_init"), F.col("walk.loss").alias("loss_final"))
