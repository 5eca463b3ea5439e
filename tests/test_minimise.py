"""Minimisers against least squares and each other, in tasks and in rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.operators import arrays, fitting, minimise
from arborist.plans import trees as t
from arborist.sources.shared import kept


def rows_of(text):
    return [dict(zip(("nt", "nv", "ci"), n)) for n in t.prefix(t.parse(text))]


@pytest.mark.parametrize("method", minimise.METHODS)
@pytest.mark.parametrize("text, truth, start", [("c0 + c1 * x0", [1.5, -2.0], [0.3, 0.3]), ("c0 * exp(-(c1 * x0))", [2.0, 0.7], [1.0, 0.2]), ("c0 + (c1 * x0 + c2 * (x0 * x0))", [0.5, -1.2, 0.3], [0.1, 0.1, 0.1])])
def test_the_truth_is_found(method, text, truth, start):
    x = np.linspace(0.1, 3, 80).reshape(-1, 1)
    points = (x, arrays.value(rows_of(text), x, np.array(truth)), np.ones(80, bool))
    c, status, n_iter, first, last = minimise.minimise_one(rows_of(text), np.array(start), points, 3000, fitting.Options(method=method))
    assert status == minimise.CONVERGED and 0 < n_iter <= 3000 and last < first
    assert np.allclose(c, truth, atol=1e-4)


def test_no_step_goes_uphill():
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (60, 1))
    points = (x, np.sin(3 * x[:, 0]), np.ones(60, bool))
    for method in minimise.METHODS:
        for n in (1, 3, 10, 40):
            _, status, n_iter, first, last = minimise.minimise_one(rows_of("c0 * sin(c1 * x0)"), np.array([0.4, 2.0]), points, n, fitting.Options(method=method))
            assert last <= first and n_iter <= n and (status == minimise.CONVERGED or n_iter == n)


def test_statuses():
    x = np.linspace(0, 1, 20).reshape(-1, 1)
    points = (x, x[:, 0] * 2, np.ones(20, bool))
    for method in minimise.METHODS:
        how = fitting.Options(method=method)
        assert minimise.minimise_one(rows_of("c0 * x0"), np.array([2.0]), points, 10, how)[1:3] == (minimise.CONVERGED, 0)
        assert minimise.minimise_one(rows_of("log(c0) * x0"), np.array([-1.0]), points, 10, how)[1] == minimise.FAIL_NAN
        assert minimise.minimise_one(rows_of("c0 * exp(c1 * x0)"), np.array([0.1, 0.1]), points, 0, how)[1] == minimise.MAXITER


@pytest.mark.parametrize("method", minimise.METHODS)
def test_rounds_agree_with_tasks(spark, method):
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(k, [float(x)], float(k + 2 * x + rng.normal(0, 0.1))) for k in (1, 2) for x in rng.uniform(0, 2, 50)], "problem_id long, x array<double>, y double")
    shapes = ["c0 + c1 * x0", "c0 * exp(c1 * x0)", "x0"]
    rows = [(10 * k + i, k, [tuple(n) for n in t.prefix(t.parse(s))], [0.5] * sum(n[0] == t.CONST for n in t.prefix(t.parse(s)))) for k in (1, 2) for i, s in enumerate(shapes)]
    population = spark.createDataFrame(rows, f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>")
    got = {plan: {r.tree_id: r for r in fitting.fit(population, points, 4, kept, fitting.Options(method=method, plan=plan)).collect()} for plan in ("tasks", "rounds")}
    assert len(got["tasks"]) == len(got["rounds"]) == 6
    for i, a in got["tasks"].items():
        b = got["rounds"][i]
        assert (a.status, a.n_iter) == (b.status, b.n_iter)
        assert np.allclose(a.c_final, b.c_final) and (a.loss_final is None or np.isclose(a.loss_final, b.loss_final))
    assert fitting.fit(population.where(F.lit(False)), points, 4, kept, fitting.Options(method=method, plan="rounds")).count() == 0


def box(x, y, low, high):
    """Least squares of c0 + c1 * x with both constants in the box, by its edges."""
    found = []
    free = np.linalg.lstsq(np.stack([np.ones_like(x), x], axis=1), y, rcond=None)[0]
    if ((low <= free) & (free <= high)).all():
        return free
    for edge in (low, high):
        found += [(edge, np.clip((x * (y - edge)).sum() / (x * x).sum(), low, high)), (np.clip((y - edge * x).mean(), low, high), edge)]
    return min(found, key=lambda c: ((c[0] + c[1] * x - y) ** 2).sum())


@pytest.mark.parametrize("method", ("bfgs", "l-bfgs", "cg"))
def test_bounds(method):
    rng = np.random.default_rng(11)
    for low, high in ((-5.0, 5.0), (0.0, 1.0), (-0.5, 0.25), (2.0, 3.0), (2.0, 2.01), (-np.inf, 0.5)):
        x, truth = rng.uniform(-1, 2, 50), rng.uniform(-2, 2, 2)
        points = (x.reshape(-1, 1), truth[0] + truth[1] * x + rng.normal(0, 0.1, 50), np.ones(50, bool))
        how = fitting.Options(method=method, bounds=(low, high))
        start = np.clip([0.3, 0.3], low, high)
        c, status, _, first, last = minimise.minimise_one(rows_of("c0 + c1 * x0"), start, points, 2000, how)
        assert last <= first and (low <= c).all() and (c <= high).all()
        want = box(x, points[1], low, high)
        loss = lambda v: ((v[0] + v[1] * x - points[1]) ** 2).sum() / 2
        assert loss(c) <= loss(want) * (1 + 1e-6) + 1e-12
        assert status == minimise.CONVERGED


@pytest.mark.parametrize("method, bounds", (("bfgs", (0.0, 5.35)), ("l-bfgs", (0.0, 5.35)), ("cg", (0.0, 5.35)), ("bfgs", None), ("l-bfgs", None), ("cg", None)))
def test_few_trials(monkeypatch, method, bounds):
    """A walk ends after a few trials on a line, on the edge of its box too, and where losses differ by rounding alone."""
    real, calls = minimise.numbers, []
    monkeypatch.setattr(minimise, "numbers", lambda *a: calls.append(1) or real(*a))
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = rng.integers(1, 51, 600) / 10
        y = 5.47 - 0.02 * x + rng.normal(0, 3, 600)
        how = fitting.Options(method=method, bounds=bounds)
        calls.clear()
        c, status, _, _, _ = minimise.minimise_one(rows_of("c0 + c1 * x0"), np.array([1.0, 1.625]), (x.reshape(-1, 1), y, np.ones(600, bool)), 2000, how)
        assert status == minimise.CONVERGED and len(calls) < 60
        assert np.allclose(c, box(x, y, *(bounds or (-np.inf, np.inf))), atol=1e-6)


def test_values_alone_end_at_the_lowest_point():
    """The simplex tells points apart to the root of rounding; the surface at its end to more digits."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(1, 51, 600) / 10
        y = 4.8 + 0.16 * x + rng.normal(0, 3, 600)
        c, status, *_ = minimise.minimise_one(rows_of("c0 + c1 * x0"), np.array([1.0, 1.625]), (x.reshape(-1, 1), y, np.ones(600, bool)), 2000, fitting.backend("nelder-mead"))
        assert status == minimise.CONVERGED and np.allclose(c, box(x, y, -np.inf, np.inf), rtol=0, atol=1e-9)


def test_values_alone():
    """A law without derivatives, steps to values that aren't finite, and one constant."""
    x = np.linspace(0.1, 4, 200).reshape(-1, 1)
    how = fitting.backend("nelder-mead")
    for text, truth, start in (("c0 * loose_log(x0 + c1)", [2.0, 0.5], [1.0, 1.0]), ("c0 * max(x0, c1)", [2.0, 1.3], [1.0, 1.0]), ("sqrt(c0 - x0) + c1", [5.0, 1.0], [4.2, 0.5]), ("c0 * x0", [3.0], [0.0])):
        points = (x, arrays.value(rows_of(text), x, np.array(truth)), np.ones(200, bool))
        with np.errstate(all="ignore"):
            c, status, n_iter, first, last = minimise.minimise_one(rows_of(text), np.array(start), points, 2000, how)
        assert status == minimise.CONVERGED and last < 1e-6 < first, text
        assert np.allclose(c[:1], truth[:1], atol=1e-3)


def test_refused_options():
    for bad in ({"bounds": (0.0, 1.0)}, {"method": "nelder-mead", "bounds": (0.0, 1.0)}, {"method": "cg", "bounds": (1.0, 1.0)}, {"jacobian": "none"}, {"method": "bfgs", "jacobian": "none"}):
        with pytest.raises(ValueError):
            fitting.Options(**bad)


@pytest.mark.parametrize("how", [fitting.Options(method=m, bounds=(0.2, 1.2)) for m in ("bfgs", "l-bfgs", "cg")])
def test_bounds_in_rounds(spark, how):
    from dataclasses import replace

    rng = np.random.default_rng(17)
    points = spark.createDataFrame([(1, [float(x)], float(0.5 + 2 * x + rng.normal(0, 0.1))) for x in rng.uniform(0, 2, 60)], "problem_id long, x array<double>, y double")
    rows = [(i, 1, [tuple(n) for n in t.prefix(t.parse("c0 + c1 * x0"))], c) for i, c in enumerate(([0.5, 0.5], [9.0, -9.0], [float("nan"), 0.5]))]
    population = spark.createDataFrame(rows, f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>")
    sides = [{r.tree_id: r for r in fitting.fit(population, points, 5, kept, replace(how, plan=plan)).collect()} for plan in ("tasks", "rounds")]
    assert sides[0][2].status == sides[1][2].status == fitting.FAIL_NAN
    for i in (0, 1):
        a, b = (side[i] for side in sides)
        assert (a.status, a.n_iter) == (b.status, b.n_iter) and np.allclose(a.c_final, b.c_final) and np.isclose(a.loss_init, b.loss_init)
        assert all(0.2 <= v <= 1.2 for v in a.c_final)


def test_unknown_methods(spark):
    with pytest.raises(ValueError):
        fitting.fit(spark.range(0).selectExpr("id tree_id", "id problem_id", f"cast(null as {t.NODES}) nodes", "cast(null as array<double>) c"), spark.range(0), options=fitting.Options(method="magic"))


def test_signed_rank_p(spark):
    """Exact against all signs of the ranks; with ties the normal distribution, against numbers by hand."""
    import itertools
    import math

    from arborist.operators import studies

    rows = [(n, float(w), 0.0) for n in range(9) for w in range(n * (n + 1) // 2 + 1)] + [(60, 700.0, 0.0), (10, 40.5, 24.0), (0, 0.0, 0.0)]
    got = spark.createDataFrame(rows, "n long, w double, ties double").select("n", "w", "ties", studies.signed_rank_p("n", "w", "ties").alias("p")).collect()
    for r in got:
        if r.n == 0:
            assert r.p is None
        elif r.n > 50 or r.ties:
            z = (r.w - r.n * (r.n + 1) / 4) / math.sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24 - r.ties / 48)
            assert r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        else:
            sums = [sum(i + 1 for i, up in enumerate(signs) if up) for signs in itertools.product((0, 1), repeat=r.n)]
            want = min(1.0, 2 * min(sum(s <= r.w for s in sums), sum(s >= r.w for s in sums)) / len(sums))
            assert r.p == pytest.approx(want)
    tied = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (3.0, 0.0), (2.0, 2.0)], "a double, b double")
    assert tuple(studies.signed_ranks(tied, "a", "b").select("n", "w_plus", "ties").first()) == (3, 4.5, 6.0)


def test_small_steps_are_those_of_a_library():
    """Steps of few constants, solved for without a library: the same, and none for the same matrices."""
    rng = np.random.default_rng(5)
    for k in range(1, fitting.SMALL + 1):
        for options in (fitting.Options(), fitting.Options(damping="absolute", pivot_floor=1e-3)):
            j, down = rng.normal(size=(k, 30)), rng.normal(size=k)
            matrix = j @ j.T
            damped = matrix.copy()
            damped[np.diag_indices(k)] = (np.diag(matrix) * 1.5 if options.damping == "relative" else np.diag(matrix) + 0.5) + options.pivot_floor
            assert np.allclose(fitting._solved_small(matrix.tolist(), down.tolist(), 0.5, options), -np.linalg.solve(damped, down))
        for bad in (-np.eye(k), np.zeros((k, k)), np.full((k, k), np.nan)):
            assert fitting.solved(bad, down, 0.5, fitting.Options()) is None
