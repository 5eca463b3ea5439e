"""Catalogues of formulas as files."""

import math

import pytest

from arborist.plans import trees as t
from arborist.sources import catalogue

TEXT = """source: a test
n_formulas: 5
formulas:
- id: one
  skeleton_expr: c0*x0**2 + 3*x1
  variables: [x0, x1]
  constants: [c0]
  ground_truth_constants: [0.5]
  sampling_ranges:
  - [1.0, 3.0]
  - [-2.0, -1.0]
  physical_vars: x0=mass, x1=speed
  n_samples: 20
- id: two
  skeleton_expr: c1*exp(-x0)/
    sqrt(c0)
  ground_truth_constants: [4.0,
    1e-3]
  sampling_ranges:
  - [0, 1]
  n_samples: 5
- id: evil
  skeleton_expr: __import__('os')
  ground_truth_constants: []
  sampling_ranges:
  - [0, 1]
  n_samples: 3
- id: short
  skeleton_expr: c0 + c1*x0
  ground_truth_constants: [1.0]
  sampling_ranges:
  - [0, 1]
  n_samples: 3
- id: pole
  skeleton_expr: 1/(x0 - x0)
  ground_truth_constants: []
  sampling_ranges:
  - [0, 1]
  n_samples: 4
"""


def test_catalogue(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(TEXT)
    (tmp_path / "b.yaml").write_text("formulas:\r\n- id: other\r\n  skeleton_expr: x0\r\n  ground_truth_constants: []\r\n  sampling_ranges:\r\n  - [2, 2]\r\n  n_samples: 1\r\n")
    problems = catalogue.problems(spark, str(tmp_path))
    got = {r.id: r for r in problems.collect()}
    assert set(got) == {"one", "two", "evil", "short", "pole", "other"}
    assert t.infix(t.from_prefix(got["one"].nodes)) == "((c0 * (x0 ^ c1)) + (c2 * x1))" and got["one"].c == [0.5, 2.0, 3.0]
    assert got["one"].ranges == [[1.0, 3.0], [-2.0, -1.0]] and got["one"].physical == "x0=mass, x1=speed"
    assert got["two"].c == [1e-3, 4.0] and got["two"].n_samples == 5
    assert got["evil"].nodes is None and got["short"].nodes is None and got["pole"].c == [1.0]
    points = catalogue.materialised(problems)
    rows = points.collect()
    assert len(rows) == 20 + 5 + 4 + 1
    for r in rows:
        low_high = got[r.problem_id].ranges
        assert all(a <= v <= b for v, (a, b) in zip(r.x, low_high))
        want = {"one": lambda x: 0.5 * x[0] ** 2 + 3 * x[1], "two": lambda x: 1e-3 * math.exp(-x[0]) / 2, "other": lambda x: 2.0}.get(r.problem_id)
        assert r.y is None if want is None else r.y == pytest.approx(want(r.x))
    assert {r.problem_id: (r.n, r.n_bad) for r in catalogue.usable(points).collect()} == {"one": (20, 0), "two": (5, 0), "pole": (4, 4), "other": (1, 0)}
    assert sorted(map(str, catalogue.materialised(problems).collect())) == sorted(map(str, rows))


def test_numbers_only_where_asked_for():
    with pytest.raises(ValueError):
        t.parse("2 * x0")
    assert t.lifted("x0**2 + x1**2", [])[1] == [2.0, 2.0]
    assert t.lifted("c1 * x0 + c0 * c1", [5.0, 7.0]) == ([(3, 1.0, -1), (3, 3.0, -1), (1, 0.0, 0), (0, 0.0, -1), (3, 3.0, -1), (1, 0.0, 1), (1, 0.0, 0)], [7.0, 5.0])


def test_written_and_read(spark, tmp_path):
    row = spark.createDataFrame([("a", "c0*x0 + 1", [2.5], [[0.0, 1.0], [2.0, 3.5]], 7)], "id string, expr string, known array<double>, ranges array<array<double>>, n_samples int")
    catalogue.written(row).write.text(str(tmp_path / "x"))
    r = catalogue.problems(spark, str(tmp_path / "x")).first()
    assert (r.id, r.expr, r.c, r.ranges, r.n_samples) == ("a", "c0*x0 + 1", [2.5, 1.0], [[0.0, 1.0], [2.0, 3.5]], 7)


def test_pinned(spark, tmp_path):
    from arborist.sources import pinned

    a, root = str(tmp_path / "a"), str(tmp_path / "kept")
    spark.range(10).write.parquet(a)
    pin = pinned.digest(spark, a)
    assert pinned.digest(spark, a) == pin and pinned.resolved(spark, a, {}) == a
    presets = {"a": (a, pin), "b": (a, "0" * 40), "free": (a, None)}
    with pytest.raises(ValueError):
        pinned.resolved(spark, "preset:c", presets)
    with pytest.warns(UserWarning, match="pinned"):
        assert pinned.resolved(spark, "preset:b", presets) == a
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n)
    assert pinned.remembered(spark, root, a, "x", make(3)).count() == 3
    assert pinned.remembered(spark, root, a, "x", make(4)).count() == 3
    assert pinned.remembered(spark, root, a, "y", make(5)).count() == 5
    spark.range(1).write.mode("append").parquet(a)
    assert pinned.digest(spark, a) != pin and pinned.remembered(spark, root, a, "x", make(6)).count() == 6
    assert made == [3, 5, 6]
