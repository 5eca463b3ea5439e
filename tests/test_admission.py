"""Admission of problems, least squares by triangles, and judged finds, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.operators import admission, judging, squares
from arborist.plans import folds
from arborist.plans import trees as t
from arborist.sources.shared import kept

NODES = f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>"


def nodes(text):
    return [tuple(n) for n in t.prefix(t.parse(text))]


@pytest.mark.parametrize(
    "text, positional, inner",
    [
        ("c0 + c1 * x0", set(), set()),
        ("c0 * sqrt(c1 * x0)", {1}, set()),
        ("sqrt(c0 * (x0 * x1)) + c1", {0}, set()),
        ("log(c0 * x0)", {0}, set()),
        ("exp(c0 + x0)", {0}, set()),
        ("sin(x0 + c0)", {0}, set()),
        ("cos(x0 - c0 + x1)", {0}, set()),
        ("c0 / (c1 * x0)", {1}, set()),
        ("inv(c0 * x0)", {0}, set()),
        ("(c0 * x0) ^ c1", {0, 1}, {1}),
        ("x0 ^ (c0 + x1)", {0}, {0}),
        ("sin(c0 * x0 + c1)", {0, 1}, {0}),
        ("c0 / (x0 - c1)", {1}, {1}),
        ("exp(-(c0 * x0)) * cos(c1 * x0 + c2)", {0, 1, 2}, {0, 1}),
        ("tanh(c0 * x0)", {0}, {0}),
        ("sqrt(exp(c0 + x0) * x1)", {0}, {0}),
    ],
)
def test_folds(text, positional, inner):
    if text.startswith("sqrt(exp"):
        inner = set()  # exp(c0) is a factor of the operand
    assert folds.surviving(t.parse(text)) == (positional, inner)


def test_a_folded_tree_is_the_same_function():
    rng = np.random.default_rng(3)
    from arborist.operators import arrays

    for text in ("c0 * sin(x0 - c1 + x1) - cos(c2 + x0)", "(c0 * x0) ^ (c1 + x1)", "c0 / (c1 * x0) - exp(c2 - x0)", "log(c0 * x0) * (x1 - c1) * (x0 + c2)", "sqrt(c0 * x0 * x1) - (-(c1 - x0))"):
        tree = t.parse(text)
        whole = folds._whole(folds.folded(tree))
        as_rows = lambda tr: [dict(zip(("nt", "nv", "ci"), n)) for n in t.prefix(tr)]
        x, c = rng.uniform(0.5, 2.5, (40, 2)), rng.uniform(0.5, 2, 3)
        assert np.allclose(arrays.value(as_rows(tree), x, c), arrays.value(as_rows(whole), x, c))
        columns = np.column_stack([np.ones(40), *(arrays.value(as_rows(b), x, c) for b in folds.basis(tree))])
        y = arrays.value(as_rows(tree), x, c)
        assert np.allclose(columns @ np.linalg.lstsq(columns, y, rcond=None)[0], y)


def test_admission_over_the_grid(spark):
    cells = admission.cells()
    rows = [(i, i, nodes(tree), [float(v) for v in c]) for i, (_, tree, c, _) in enumerate(cells)]
    points = [(i, [float(x)]) for i, (*_, (low, high)) in enumerate(cells) for x in np.linspace(low, high, 200)]
    got = {r.tree_id: r for r in admission.decided(spark.createDataFrame(rows, NODES), spark.createDataFrame(points, "problem_id long, x array<double>"), kept).collect()}
    reasons = {"shift_quad": "no_inner", "outer_only": "no_inner", "root_scale": "fold", "phase": "fold", "size_scale": "rank", "narrow_power": "ls_reject"}
    for i, (name, _, c, _) in enumerate(cells):
        canonical = name.startswith("freq") and c[1] in (1.0, 2.0)
        assert got[i].reason == reasons.get(name, "structural" if canonical else "admit"), name
        assert got[i].admitted == (got[i].reason == "admit")
        if got[i].admitted:
            assert got[i].r2_linear < 0.7 and got[i].r2_full > 0.999999 and got[i].recovery < 1e-6


def test_admission_of_nothing(spark):
    none = spark.createDataFrame([], NODES)
    assert admission.decided(none, spark.createDataFrame([], "problem_id long, x array<double>"), kept).count() == 0


def test_least_squares_in_rounds(spark, monkeypatch):
    """Many blocks are reduced in several rounds, and a dependent column changes nothing."""
    monkeypatch.setattr(squares, "FAN", 3)
    monkeypatch.setattr(admission.arrays, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 3, 500)
    y = np.sin(x) + rng.normal(0, 0.1, 500)
    points = spark.createDataFrame([(k, [float(a)], float(b)) for k in (1, 2) for a, b in zip(x, y)], "problem_id long, x array<double>, y double")
    for r in admission.polynomial_fits(points, 4, kept).collect():
        want = [1 - ((np.polyval(np.polyfit(x, y, d), x) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() for d in range(1, 5)]
        assert np.allclose(r.r2, want)
    blocks = admission.arrays.blocked(points).withColumns({"columns": F.array(*(F.array(F.struct(F.lit(0).alias("nt"), F.lit(0.0).cast("float").alias("nv"), F.lit(-1).alias("ci"))) for _ in range(2))), "tried": F.array(F.array().cast("array<double>"))})
    twice = squares.reduced(blocks.withColumn("r", squares.block_triangles("columns", "tried", "block")[0]), ["problem_id"], kept)
    line = 1 - ((np.polyval(np.polyfit(x, y, 1), x) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert all(np.isclose(r.r2, line) for r in twice.select(squares.least_squares("r")["r2"].alias("r2")).collect())


def test_ranks():
    a = np.random.default_rng(1).normal(size=(50, 3))
    full = np.linalg.qr(np.column_stack([a, a[:, 0] * 1e9]), mode="r")
    assert squares.rank(full) == 3 and squares.rank(full[:, :2]) == 2
    nearly = np.linalg.qr(np.column_stack([a[:, 0], a[:, 0] + 1e-6 * a[:, 1]]), mode="r")
    assert squares.rank(nearly) == 2  # sums of products would call it 1
    assert squares.rank(np.full((2, 2), np.nan)) == -1


def test_judged(spark):
    laws = [("c0 + c1 * x0", [1.5, 2.0]), ("c0 * exp(-(c1 * x0))", [2.0, 0.5]), ("c0 * log(x0)", [1.0])]
    finds = [
        (0, "c0 * x0 + c1", [2.0, 1.5], (True, True, True)),
        (0, "c0 + x0 * c1", [7.0, 2.0], (False, True, True)),  # an added constant
        (0, "c0 * (c1 + c2 * x0)", [3.0, 1.5, 2.0], (False, True, True)),  # a factor
        (0, "c0 + c1 * x0", [9.0, 4.0], (False, False, False)),  # both
        (0, "c0 * x0 + c1", [2.0002, 1.5], (True, True, True)),  # three digits, three decimals
        (0, "c0 * x0 + c1", [2.02, 1.5], (False, False, False)),
        (1, "c0 / exp(c1 * x0)", [2.0, 0.5], (True, True, True)),
        (1, "c0 * exp(-(c1 * x0))", [5.0, 0.5], (False, True, True)),
        (1, "c0 * x0", [1.0], (False, False, False)),
        (2, "c0 * log(x0)", [-3.0], (False, True, True)),
        (2, "c0 * log(abs(x0))", [1.0], (False, False, False)),  # finite where the law is not
        (7, "x0", [], (False, False, False)),  # no such law
    ]
    law = spark.createDataFrame([(i, i, nodes(text), c) for i, (text, c) in enumerate(laws)], NODES)
    found = spark.createDataFrame([(i, p, nodes(text), c) for i, (p, text, c, _) in enumerate(finds)], NODES)
    points = spark.createDataFrame([(p, [float(x)]) for p, low in ((0, 0.1), (1, 0.1), (2, -1.0)) for x in np.linspace(low, 3, 40)], "problem_id long, x array<double>")
    got = {r.tree_id: (r.strict, r.lenient, r.srbench) for r in judging.judged(found, law, points).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(finds)}


def test_laws_of_a_problem_share_its_points(spark):
    """Two laws of one problem, each with a find of its own: points are given once."""
    rows = lambda *trees: spark.createDataFrame([(i, 7, law, t.prefix(t.parse(text)), c) for i, law, text, c in trees], f"tree_id long, problem_id long, law long, nodes {t.NODES}, c array<double>")
    laws, finds = rows((1, 1, "c0 * x0", [2.0]), (2, 2, "c0 + x0", [1.0])), rows((10, 1, "c0 * x0", [2.0]), (11, 2, "c0 * x0", [2.0]))
    points = spark.createDataFrame([(7, [float(i)]) for i in range(1, 20)], "problem_id long, x array<double>")
    assert {r.tree_id: (r.strict, r.lenient, r.srbench) for r in judging.judged(finds, laws.drop("law"), points).collect()} == {10: (True,) * 3, 11: (False,) * 3}


def test_finds_are_evaluated_once_and_in_blocks(spark, monkeypatch):
    """Points of a problem meet its finds in blocks, whatever their number; equal functions are one, and only finds that a factor may
    bring to the law are looked at again."""
    calls, value = [], judging.arrays.value
    node = lambda text: [dict(zip(("nt", "nv", "ci"), n)) for n in t.prefix(t.parse(text))]
    monkeypatch.setattr(judging.arrays, "value", lambda nodes, x, c: calls.append(c.shape[1]) or value(nodes, x, c))
    kind = judging.pa.list_(judging.pa.struct([("nt", judging.pa.int32()), ("nv", judging.pa.float32()), ("ci", judging.pa.int32())]))
    forms = judging.pa.list_(judging.pa.list_(judging.pa.float64()))
    pairs = [{"nodes": node("c0 * x0"), "law_nodes": node("c0 * x0"), "c": [[v]] * 3, "law_c": [[2.0]] * 3} for v in (2.0, 2.0, 5.0)] + [{"nodes": node("x0"), "law_nodes": node("c0 * x0"), "c": [[]] * 3, "law_c": [[2.0], [3.0], [2.0]]}]
    some = judging.pa.array(pairs, judging.pa.struct([("nodes", kind), ("law_nodes", kind), ("c", forms), ("law_c", forms)]))
    values, rows = judging._values(some, np.arange(4.0).reshape(4, 1), [True] * 12, {})
    assert len(calls) == 2 and sum(calls) == 4 * 4 and [values[find][1] / values[law][1] for law, find in rows] == [1.0] * 6 + [2.5] * 3 + [0.5, 1 / 3, 0.5]
    # against the same finds in blocks of a few points and chunks of two
    law = spark.createDataFrame([(0, 0, nodes("c0 + c1 * x0"), [1.5, 2.0])], NODES)
    texts = [("c0 + c1 * x0", [3.0, 4.0]), ("c0 + c1 * x0", [3.0, 4.001]), ("c0 + c1 * x0", [9.0, 2.0]), ("c0 + c1 * x0", [1.5, 2.0]), ("c0 * x0", [2.0]), ("c0 * sin(x0)", [2.0])]
    finds = spark.createDataFrame([(i, 0, nodes(text), c) for i, (text, c) in enumerate(texts)], NODES)
    points = spark.createDataFrame([(0, [float(x)]) for x in np.linspace(0.1, 3, 300)], "problem_id long, x array<double>")
    monkeypatch.setattr(judging, "CHUNK", 2)
    monkeypatch.setattr(judging.arrays, "BLOCK", 40)
    got = {r.tree_id: (r.strict, r.lenient, r.srbench) for r in judging.judged(finds, law, points).collect()}
    assert got == {0: (False, True, True), 1: (False, True, False), 2: (False, True, True), 3: (True, True, True), 4: (False, True, True), 5: (False, False, False)}
