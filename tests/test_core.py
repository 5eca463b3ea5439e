"""Instruction set, trees, scoring, fitting, population files and the record stream."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arborist.functions import ops
from arborist.operators import arrays, fitting, ranking, records, scoring, search, studies, workload
from arborist.plans import population as p
from arborist.plans import trees as t
from arborist.sources import popfile, texts
from arborist.sources.shared import kept, new_path
from arborist.streaming.records import latest_by_key

EDGES = [0.0, -0.0, 1.0, -1.0, 0.5, -2.5, 3.0, 1e300, -1e300, math.inf, -math.inf, math.nan, 710.0]


@pytest.mark.parametrize("op", ops.TABLE, ids=lambda op: op.name)
def test_opcode_equals_numpy(spark, op):
    given = [(a, b) for a in EDGES for b in EDGES]
    got = spark.createDataFrame(given, "a double, b double").select(op.column(*(F.col("a"), F.col("b"))[: op.arity]).alias("v")).collect()
    with np.errstate(all="ignore"):
        want = [float(op.array(*map(np.float64, pair[: op.arity]))) for pair in given]
    for pair, row, w in zip(given, got, want):
        if pair == (-math.inf, 0.5):
            continue  # numpy takes a square root here
        assert row.v is not None and (row.v == pytest.approx(w, rel=1e-12, abs=0, nan_ok=True)), (pair, row.v, w)


def test_guards(spark):
    rows = spark.createDataFrame([(1.5,), (math.inf,), (-math.inf,), (math.nan,), (-2.0,)], "v double")
    v = F.col("v")
    got = rows.select(ops.residual_guard(v), ops.jacobian_guard(v), ops.point_sentinel(v), ops.clamp_zero(v), ops.annihilating(F.lit(0.0), v)).collect()
    assert [tuple(r) for r in got] == [(1.5, 1.5, 1.5, 1.5, 0), (1e10, 0, 1e6, 0, 0), (-1e10, 0, 1e6, 0, 0), (1e10, 0, 1e6, 0, 0), (-2.0, -2.0, -2.0, 0, 0)]


def random_tree(rng, depth, solver=False):
    if depth == 0 or rng.random() < 0.2:
        return t.Tree("x", (rng.randrange(3),)) if rng.random() < 0.5 else t.Tree("c", (0,))
    op = rng.choice([o for o in ops.TABLE if not solver or o.name in ("ADD", "SUB", "MUL", "DIV", "SIN", "COS", "EXP", "TANH", "NEG")])
    return t.Tree(op.name, tuple(random_tree(rng, depth - 1, solver) for _ in range(op.arity)))


def numbered(tree):
    count = iter(range(100))

    def walk(n):
        return t.Tree("c", (next(count),)) if n.op == "c" else n if n.op == "x" else t.Tree(n.op, tuple(map(walk, n.args)))

    return walk(tree)


def value(tree, x, c):
    if tree.op == "x":
        return x[tree.args[0]]
    if tree.op == "c":
        return c[tree.args[0]]
    return ops.BY_NAME[tree.op].array(*(value(a, x, c) for a in tree.args))


def test_structure(spark):
    rng = random.Random(4)
    made = [numbered(random_tree(rng, 5)) for _ in range(60)] + [t.Tree("x", (0,)), t.Tree("c", (0,))]

    def levels(n):
        return 1 if n.op in "xc" else 1 + max(map(levels, n.args))

    rows = [(i, t.prefix(tree)) for i, tree in enumerate(made)]
    df = spark.createDataFrame(rows, f"id long, nodes {t.NODES}")
    nodes = F.col("nodes")
    got = df.select("id", t.tree_depth(nodes).alias("depth"), t.depth_need(nodes).alias("need"), t.span(nodes, F.lit(0)).alias("span"), t.constants_in_order(nodes).alias("order"), search.read_out(nodes).alias("out"))
    for r in got.collect():
        tree = made[r.id]
        assert (r.depth, r.need, r.span, r.order) == (levels(tree), popfile.need_of(rows[r.id][1]), len(rows[r.id][1]), True)
        assert r.out.infix == t.infix(tree) and t.from_prefix(rows[r.id][1]) == tree and t.prefix(t.parse(t.infix(tree))) == rows[r.id][1]


def test_parser_accepts_nothing_else():
    for text in ("__import__('os')", "x0 +", "c0 c1", "foo(x0)", "1 + x0", "", "sin x0", "x0)"):
        with pytest.raises(ValueError):
            t.parse(text)
    assert t.canonical(t.parse("c7 * x0 + c2")) == t.canonical(t.parse("c0 + x0 * c1"))
    with pytest.raises(ValueError):
        t.from_prefix([(4, 0.0, -1)])


def test_compiled_trees_and_gradients(spark):
    rng = random.Random(9)
    made = [tree for tree in (numbered(random_tree(rng, 4, True)) for _ in range(60)) if t.prefix(tree) and any(n[0] == 1 for n in t.prefix(tree))][:16]
    gen = np.random.default_rng(1)
    points = gen.uniform(0.5, 1.5, (5, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in points], "x array<double>")
    for tree in made:
        k = sum(n[0] == 1 for n in t.prefix(tree))
        c = gen.uniform(0.5, 1.5, k)
        x_, c_ = (lambda i: F.col("x")[i]), (lambda i: F.lit(float(c[i])))
        slopes = fitting.gradient(tree, x_, c_)
        got = df.select(t.compiled(tree, x_, c_).alias("v"), *(slopes[i].alias(f"g{i}") for i in range(k))).collect()
        for row, x in zip(got, points):
            with np.errstate(all="ignore"):
                assert row.v == pytest.approx(value(tree, x, c), rel=1e-9, nan_ok=True)
                for i in range(k):
                    h = np.zeros(k)
                    h[i] = 1e-6
                    want = (value(tree, x, c + h) - value(tree, x, c - h)) / 2e-6
                    if abs(want) < 1e6:
                        assert row[f"g{i}"] == pytest.approx(want, rel=1e-3, abs=1e-4)


@pytest.mark.parametrize(
    ("text", "c"), [("c0 * x0 ^ c1", (2.5, 1.3)), ("c0 + (c1 * x0 + c2 * (x0 * x0))", (0.5, -1.2, 0.3)), ("c0 * exp(-(c1 * x0)) + c2", (3.0, 0.4, 0.7)), ("c0 * tanh(c1 * x0)", (2.0, 1.5))]
)
def test_known_constants_come_back(spark, text, c):
    tree = t.parse(text)
    x = [0.1 + 4.9 * i / 63 for i in range(64)]
    y = [float(value(tree, [v], c)) for v in x]
    points = spark.createDataFrame([(1, [a], b) for a, b in zip(x, y)], "problem_id long, x array<double>, y double")
    rows = [(1, 1, t.prefix(tree), [0.9 * v for v in c]), (2, 1, t.prefix(t.parse("x0 + x0")), []), (3, 1, t.prefix(t.parse("c0 / (x0 - x0)")), [1.0])]
    population = spark.createDataFrame(rows, f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>")
    fits = {r.tree_id: r for r in fitting.fit(population, points, 40, kept).collect()}
    assert fits[1].status == fitting.CONVERGED and fits[1].loss_final <= fits[1].loss_init
    assert np.linalg.norm(np.subtract(fits[1].c_final, c)) / np.linalg.norm(c) < 5e-3
    assert fits[2].status == fitting.K0_SKIP and fits[3].status == fitting.FAIL_NAN
    back = {r.tree_id: r for r in fitting.written_back(population, spark.createDataFrame(list(fits.values()))).collect()}
    assert back[1].c == fits[1].c_final and back[3].c == [1.0]


def test_scores_of_nothing_and_of_infinities(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, math.inf), (2, 1.0, 3.0)], "k long, y double, yh double")
    got = {r.k: r.loss for r in rows.groupBy("k").agg(scoring.half_sse(F.col("y"), F.col("yh")).alias("loss")).collect()}
    assert got == {1: math.inf, 2: 2.0}
    assert rows.where("k > 9").agg(scoring.median_finite(F.col("yh")).alias("m"), scoring.rate(F.col("y") > 0).alias("r")).first() == (math.inf, None)


def test_sign_test_and_records(spark):
    rows = spark.createDataFrame([(9, 1), (5, 5), (0, 0), (700, 900)], "w long, l long")
    got = [r.p for r in rows.select(studies.sign_test(F.col("w"), F.col("l")).alias("p")).collect()]
    want = [min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) for n, k in ((10, 1), (10, 5), (0, 0), (1600, 700))]
    assert got == pytest.approx(want, rel=1e-9)
    rec = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k long, at_ long, v string")
    assert sorted((r.k, r.v) for r in records.last_wins(rec, ["k"], [F.col("at_")]).collect()) == [(1, "b"), (2, None)]


def test_population_files(spark):
    popfile.register(spark)
    rows = [(7, i, t.prefix(t.parse(text)), [0.5 * j for j in range(k)], [1.0, 2.0, 3.0, 4.0], 2, [float(i), 0.25]) for i, (text, k) in enumerate([("c0 + c1 * x0", 2), ("x1", 0), ("sin(c0)", 1)])]
    df = spark.createDataFrame(rows, popfile.SCHEMA).coalesce(1)
    path = new_path(spark, "pop-test")
    df.write.format("population").mode("append").save(path)
    back = spark.read.format("population").option("trees_per_partition", "2").load(path)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert back.rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        popfile.encode([df.collect()[0].__class__(part=1, place=0, nodes=[r for r in df.collect()[0].nodes][::-1], c=[1.0], x=[], n_vars=0, y=[1.0])])


def test_structures_without_a_sort_of_all_trees(spark):
    schema = "nodes array<struct<nt:int,nv:float,ci:int>>"
    made = [[(0, v, -1)] for v in (0.1, 0.0, -0.0, 3e30, 1.17549435e-38, float("inf"))] + [t.prefix(t.parse("c0 + c1 * x0"))]
    population = spark.createDataFrame([(nodes,) for nodes in made * 3], schema)
    found = scoring._distinct(population)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.s: r.nodes for r in found.collect()}
    want = {r.s: r.nodes for r in population.select(F.sha2(F.to_json("nodes"), 256).alias("s"), "nodes").collect()}
    assert len(rows) == len(made) and repr(sorted(rows.items())) == repr(sorted(want.items()))  # -0.0 too


def test_small_population_files_share_tasks(spark, tmp_path):
    popfile.register(spark)
    nodes = t.prefix(t.parse("c0 + x0"))
    df = spark.createDataFrame([(part, place, nodes, [1.0 * part], [], 0, []) for part in range(1200) for place in range(2)], popfile.SCHEMA)
    popfile.by_part(df).write.format("population").mode("append").save(f"file://{tmp_path}")
    assert len(list(tmp_path.glob("part-*.bin"))) == 1200 and len(list(tmp_path.iterdir())) == 1200
    back = spark.read.format("population").load(f"file://{tmp_path}")
    assert back.rdd.getNumPartitions() <= 3  # not a task for each file
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    one = next(tmp_path.glob("part-7-*.bin"))
    one.write_bytes(one.read_bytes()[:-4])
    with pytest.raises(Exception, match="size and header differ"):
        back.count()


def test_torn_lines_requests_and_stream(spark):
    path = new_path(spark, "lines")
    spark.createDataFrame([('{"a": 1}',), ('{"a": 2',)], "value string").write.text(path)
    assert [r.a for r in texts.records(spark, path, "a long").collect()] == [1]
    src = new_path(spark, "in")
    spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, "z")], "k long, at_ long, v string").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    assert sorted((r.k, r.v) for r in latest_by_key(spark, src, schema, ["k"], "at_").collect()) == [(1, "y"), (2, "z")]


def test_starts_and_memetic_step(spark):
    sf = "/root/testdata/sf0.001"
    population = p.trees(spark, sf)
    starts = fitting.starts(population, 3, 0.2, 1)
    assert starts.where("trial = 0").select("tree_id", "c").exceptAll(population.select("tree_id", "c")).count() == 0
    again = fitting.starts(population.repartition(7), 3, 0.2, 1)
    assert starts.select("tree_id", "trial", "c").exceptAll(again.select("tree_id", "trial", "c")).count() == 0
    after = search.memetic_step(population, p.points(spark, sf), 2, 3, kept)
    assert after.count() == population.count() and after.where("loss > loss_before").count() == 0


def test_plans_push_down_and_stay_in_generated_code(spark):
    plan = p.points(spark, "/root/testdata/sf0.001").select("problem_id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan
    from arborist.plans import registry

    registry.load()
    plan = registry.QUERIES["a02_scoring_loss"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_adapter_and_generated_trees(spark):
    from arborist.operators import workload

    rows = spark.range(300).select("id", workload.generated(F.col("id"), "early-gen", 3).alias("nodes"))
    nodes = F.col("nodes")
    got = rows.select(t.constants_in_order(nodes).alias("order"), (t.to_prefix(t.to_postfix(nodes)) == nodes).alias("same"), F.size(nodes).alias("n"), t.span(nodes, F.lit(0)).alias("span")).collect()
    assert all(r.order and r.same and r.n == r.span for r in got)
    again = spark.range(300).repartition(7).select("id", workload.generated(F.col("id"), "early-gen", 3).alias("nodes"))
    assert rows.exceptAll(again).count() == 0


def test_catalogue_problems_can_be_fitted(spark):
    from arborist.operators import workload

    for name, (text, c, (low, high)) in workload.NGUYEN.items():
        tree = t.parse(text)
        assert sum(n[0] == t.CONST for n in t.prefix(tree)) == len(c), name
    text, c, (low, high) = workload.NGUYEN["nguyen_10"]
    tree = t.parse(text)
    x = workload.sampled(spark.range(200), [(low, high), (low, high)], 5, "id")
    points = x.select(F.lit(1).cast("long").alias("problem_id"), "x", t.compiled(tree, lambda k: F.col("x")[k], lambda k: F.lit(c[k])).alias("y"))
    population = spark.createDataFrame([(1, 1, t.prefix(tree), [0.7])], f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>")
    for options in (fitting.Options(), fitting.Options(jacobian="forward"), fitting.Options(damping="absolute", pivot_floor=1e-9)):
        fit = fitting.fit(population, points, 30, kept, options).first()
        assert fit.c_final[0] == pytest.approx(2.0, rel=1e-4) and fit.status == fitting.CONVERGED


def test_many_structures_are_scored_and_fitted_as_data(spark, monkeypatch):
    """More trees than are compiled, and the array path gives what compiled trees give."""
    rng, gen = random.Random(4), np.random.default_rng(2)
    made = {}
    while len(made) < scoring.MAX_STRUCTURES + 6:
        tree = numbered(random_tree(rng, 3, True))
        made[t.infix(tree)] = tree
    trees = list(made.values())
    rows = []
    for i, tree in enumerate(trees):
        nodes = t.prefix(tree)
        rows.append((i, i % 2, nodes, gen.uniform(0.5, 1.5, sum(n[0] == 1 for n in nodes)).tolist()))
    population = kept(spark.createDataFrame(rows, f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>"))
    x = gen.uniform(0.5, 1.5, (1500, 3))
    points = kept(spark.createDataFrame([(int(i > 20), i, a.tolist(), float(a.sum())) for i, a in enumerate(x)], "problem_id long, i long, x array<double>, y double"))
    loss = {r.tree_id: r for r in scoring.losses(population, points).collect()}
    fits = {r.tree_id: r for r in fitting.fit(population, points, 2, kept).collect()}
    assert len(loss) == len(fits) == len(rows)
    for i, problem, _, c in rows:
        mine = x[21:] if problem else x[:21]
        with np.errstate(all="ignore"):
            yh = np.array([value(trees[i], a, c) for a in mine])
        want = 0.5 * ((yh - mine.sum(axis=1)) ** 2).sum() if np.isfinite(yh).all() else math.inf
        assert (loss[i].loss, loss[i].n) == (pytest.approx(want, rel=1e-9), len(mine))
        assert not c or fits[i].loss_init == pytest.approx(want, rel=1e-9)
        assert not c or fits[i].loss_final <= fits[i].loss_init

    def some(options):
        few = population.where("tree_id < 8")
        places = {r.tree_id: r.s for r in scoring.evaluated(few, points).groupBy("tree_id").agg(F.sum("i").alias("s")).collect()}
        return places, {r.tree_id: r for r in fitting.fit(few, points, 2, kept, options).collect()}

    for options in (fitting.Options(), fitting.Options(jacobian="forward")):
        monkeypatch.setattr(scoring, "MAX_STRUCTURES", 64)
        places, compiled = some(options)
        monkeypatch.setattr(scoring, "MAX_STRUCTURES", 0)
        places_, data = some(options)
        assert places == places_ and set(compiled) == set(data)
        for i, a in compiled.items():
            b = data[i]
            assert (a.status, a.n_iter) == (b.status, b.n_iter)
            assert a.loss_final is None and b.loss_final is None or a.loss_final == pytest.approx(b.loss_final, rel=1e-6, abs=1e-9)


def test_population_fits_run_as_many_rounds_as_fit_does(spark, monkeypatch):
    """The query leaves the number of rounds at fit's 50."""
    import inspect

    from arborist.plans import queries_fitting

    bound = []
    signature = inspect.signature(fitting.fit)

    def fit(*args, **named):
        call = signature.bind(*args, **named)
        call.apply_defaults()
        bound.append(call.arguments["max_iter"])
        return spark.createDataFrame([], "tree_id long, status int, n_iter int, loss_init double, loss_final double")

    monkeypatch.setattr(queries_fitting.fitting, "fit", fit)
    queries_fitting.l01_l22_population_fits(spark, "/root/testdata/sf0.001")
    assert bound == [50]


def test_both_plans_give_the_same_fits(spark):
    """Whole fits in tasks and passes over the points, in either order of the schedule."""
    rng, gen = random.Random(9), np.random.default_rng(5)
    rows = []
    for i in range(24):
        nodes = t.prefix(numbered(random_tree(rng, 3, True)))
        rows.append((i, i % 3, nodes, gen.uniform(0.5, 1.5, sum(n[0] == 1 for n in nodes)).tolist()))
    population = kept(spark.createDataFrame(rows, f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>"))
    x = gen.uniform(0.5, 1.5, (90, 3))
    points = kept(spark.createDataFrame([(i % 3, a.tolist(), float(a.sum())) for i, a in enumerate(x)], "problem_id long, x array<double>, y double"))
    for order in ("improve", "step"):
        tasks, rounds = ({r.tree_id: r for r in fitting.fit(population, points, 4, kept, fitting.Options(order=order, plan=plan)).collect()} for plan in ("tasks", "rounds"))
        assert set(tasks) == set(rounds) == set(range(24))
        for i, a in tasks.items():
            b = rounds[i]
            assert (a.status, a.n_iter) == (b.status, b.n_iter)
            assert a.loss_final is None and b.loss_final is None or a.loss_final == pytest.approx(b.loss_final, rel=1e-6, abs=1e-9)


def test_large_problems_are_fitted_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(fitting, "LOCAL_POINTS", 20)
    tree = t.prefix(t.parse("c0 + c1 * x0"))
    points = kept(spark.createDataFrame([(p, [i / 10], 2.0 + 3.0 * i / 10) for p, n in ((1, 10), (2, 60)) for i in range(n)], "problem_id long, x array<double>, y double"))
    population = spark.createDataFrame([(p, p, tree, [1.0, 1.0]) for p in (1, 2, 3)], f"tree_id long, problem_id long, nodes {t.NODES}, c array<double>")
    got = {r.tree_id: r for r in fitting.fit(population, points, 30, kept).collect()}
    assert set(got) == {1, 2}  # a problem without points has no loss
    assert all(r.c_final == pytest.approx([2.0, 3.0], rel=1e-6) for r in got.values())


def test_statuses_of_the_schedule(monkeypatch):
    """Each way to end, on a fit whose losses are given."""
    options, points = fitting.Options(), None

    def ends(losses, jtj=1.0, down=1.0, max_iter=50, **named):
        given = iter(losses)
        monkeypatch.setattr(fitting.arrays, "numbers", lambda *_: (next(given), np.array([[jtj]]), np.array([down])))
        return fitting.fit_one([], np.array([1.0]), points, max_iter, fitting.Options(**named))[1:3]

    inf = math.inf
    assert ends([inf]) == (fitting.FAIL_NAN, 0)
    assert ends([1.0, inf]) == (fitting.FAIL_NAN, 1)
    assert ends([1.0, 0.9, inf]) == (fitting.FAIL_NAN, 2)
    assert ends([1.0], jtj=-1.0) == (fitting.FAIL_CHOLESKY, 16)
    assert ends([1.0] + [2.0] * 50) == (fitting.FAIL_NAN, 16)  # uphill until lambda is too large, however small the step
    assert ends([1.0] + [2.0] * 50, down=1e-9, order="step") == (fitting.CONVERGED, 1)
    assert ends([1.0, 0.5], down=1e-9) == (fitting.CONVERGED, 1)
    assert ends([1.0, 0.9, 0.8], max_iter=2) == (fitting.MAXITER, 2)
    assert options.order == "improve"


@pytest.mark.parametrize(
    ("text", "n"),
    [("c0 / (x0 + c1)", 1), ("exp(c0) * x0", 0), ("c0 * sin(c1 * x0 + c2)", 2), ("c0 * x0 + c1", 0), ("x0 ^ c0", 1), ("c0 ^ x0", 1), ("sin(c0) ^ c1 * x0", 0), ("(c0 + x0) * (c1 - x0)", 0), ("sqrt(c0 * x0) / c1", 1), ("log(x0 + c0 * c0)", 1)],
)
def test_inner_constants(text, n):
    assert t.inner_constants(t.parse(text)) == n


def test_normal_form_keeps_values():
    rng, gen = random.Random(3), np.random.default_rng(1)
    for _ in range(60):
        tree = numbered(random_tree(rng, 3, True))
        form = t._expanded(tree)
        x, c = gen.uniform(0.5, 1.5, 3), gen.uniform(0.5, 1.5, 16)
        with np.errstate(all="ignore"):
            a, b = value(tree, x, c), value(form, x, c)
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9, nan_ok=True)


def test_generated_trees_are_as_their_presets(spark):
    from arborist.operators import workload

    for name, shape in workload.PRESETS.items():
        rows = spark.range(400).select(workload.generated_trees(F.col("id"), name, 3).alias("g")).select("g.*").collect()
        operators = [n.nv for r in rows for n in r.nodes if n.nt > t.CONST]
        trig = sum(v in (14, 15, 16) for v in operators) / len(operators)
        assert abs(trig - max(shape.trig, 0.02)) < 0.06, name
        assert all(shape.low <= len(r.nodes) <= shape.high for r in rows)
        assert all(t.infix(t.from_prefix([(n.nt, n.nv, n.ci) for n in r.nodes])) for r in rows)
        for r in rows:
            k = sum(n.nt == t.CONST for n in r.nodes)
            assert len(r.c_true) == len(r.c_init) == k and all(0.5 <= abs(v) <= 3 for v in r.c_true)
            assert all(abs(b - a) <= 0.3 * abs(a) + 0.15 for a, b in zip(r.c_true, r.c_init))
        without = sum(not r.c_true for r in rows) / len(rows)
        assert without >= shape.all_variable - 0.03


def _few_groups(spark):
    values = [("a", float(v % 7), v) for v in range(60)] + [("b", None, 1), ("b", 2.0, 2), (None, 3.0, 1), (None, 5.0, 2), ("c", None, 1), ("d", float("inf"), 1), ("d", -1.5, 2)]
    return spark.createDataFrame(values, "g string, v double, k long")


def test_percentiles_by_ranges(spark):
    """Against the aggregate that holds a group: ties, nulls alone, a null group, an empty table."""
    rows = _few_groups(spark)
    got = ranking.percentiles(rows, ["g"], "v", {"low": 0.0, "q": 0.31, "med": 0.5, "top": 1.0})
    want = rows.groupBy("g").agg(*(F.percentile("v", F.lit(s)).alias(n) for n, s in (("low", 0.0), ("q", 0.31), ("med", 0.5), ("top", 1.0))))
    assert {r.g for r in got.collect()} == {"a", "b", "c", "d", None}
    near = lambda r: tuple(v if v is None or isinstance(v, str) else round(v, 9) for v in r)
    assert set(map(near, got.collect())) == set(map(near, want.collect()))
    assert ranking.percentiles(rows.where("g = 'none'"), ["g"], "v", {"med": 0.5}).count() == 0
    assert ranking.percentiles(rows.where("g = 'a'"), [], "v", {"med": 0.5}).first() == (3.0,)


def test_ranks_by_ranges(spark):
    """Against windows over whole groups; ranges cut through a group of one value."""
    rows = _few_groups(spark).repartition(3)
    over = Window.partitionBy("g")
    want = rows.withColumns({"place": F.row_number().over(over.orderBy("v", "k")), "mean": F.rank().over(over.orderBy("v")) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2})
    got = ranking.ordinal_ranks(rows, ["g"], "v", "k", "place").drop("total")
    got = ranking.joined(got, ranking.average_ranks(rows, ["g"], "v", "mean").drop("n"), ["g", "v"])
    assert set(got.select("g", "v", "k", "place", "mean").collect()) == set(want.select("g", "v", "k", "place", "mean").collect())
    assert ranking.ordinal_ranks(rows.where("k < 0"), ["g"], "v", "k", "place").count() == 0


@pytest.mark.parametrize("text", [*p.SHAPES[:7], "c0 * x0 ^ c1 + sin(c2 * x1) / (c1 + exp(c0 * x2))"])
def test_dual_derivatives_equal_reverse(spark, text):
    """As columns and over arrays, and central differences near both."""
    tree = t.parse(text)
    nodes = [dict(zip(("nt", "nv", "ci"), n)) for n in t.prefix(tree)]
    x, c = np.random.default_rng(3).uniform(0.3, 2.0, (20, 3)), np.array([0.7, 1.3, -0.4])[: sum(n["nt"] == t.CONST for n in nodes)]
    yh, want = arrays.slopes(nodes, x, c)
    for way, rel in (("dual", 1e-12), ("central", 1e-5)):
        got = arrays.JACOBIANS[way](nodes, x, c)
        assert got[0] == pytest.approx(yh) and got[1] == pytest.approx(want, rel=rel, abs=1e-7)
    rows = spark.createDataFrame([(row.tolist(), c.tolist()) for row in x], "x array<double>, c array<double>")
    own = fitting.by_constants(tree, lambda k: F.col("x")[k], lambda k: F.col("c")[k], "dual")
    got = np.array(rows.select(*(own[k] for k in range(len(c)))).collect()).T
    assert got == pytest.approx(want, rel=1e-9)


def test_verdicts_of_solvers(spark):
    rows = [(0, 2.0, 1.0), (0, 2.0, 2.0), (0, 1e20, 1e19), (1, 2.0, 1.0), (2, 2.0, math.nan), (3, None, None), (4, 2.0, 1.0)]
    converged, why = fitting.progressed(F.col("s"), F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, "s int, a double, b double").select(converged.alias("c"), why.alias("w")).collect()
    assert [r.w for r in got] == ["small_step", "no_progress", "no_progress", "max_iter", "nan", "no_constants", "unsolved"]
    assert [r.c for r in got] == [True] + [False] * 6
    with pytest.raises(ValueError, match="no backend"):
        fitting.backend("none")


def test_selection_and_tournament(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 4) for i in range(24)], "id long, v int, k int")
    ids = lambda **limits: {r.id for r in workload.selected(rows, "id", F.col("v"), F.col("k"), **limits).collect()}
    assert ids(max_vars=1, max_constants=2, exclude=(0,)) == {i for i in range(1, 24) if i % 3 <= 1 and i % 4 <= 2}
    assert ids(max_vars=0, include=(5, 6, 7), exclude=(7,)) == {5, 6}
    assert ids() == set(range(24))
    members = spark.createDataFrame([("a", i, float("nan") if i == 3 else float(i)) for i in range(10)] + [(None, 1, 2.0), ("b", 1, None)], "g string, id long, f double")
    won = search.tournament(members, ["g"], "f", "id", 200, 0.5)
    assert {(r.g, r.contest, r.winner) for r in won.collect()} == {("a", i, 9) for i in range(5)} | {(None, 0, 1), ("b", 0, 1)}
    assert search.tournament(members.where("id > 99"), ["g"], "f", "id", 2, 0.5).count() == 0


def test_certifying_starts(spark):
    trees = spark.createDataFrame([(1, [4.0, -2.0])], "tree_id long, c array<double>")
    seeded = {r.trial: r.c for r in search.certifying_starts(trees, 1).collect()}
    assert len(seeded) == 10 and seeded[0] == [4.0, -2.0]
    assert all(0 < abs(seeded[i][0] - 4.0) < 2.5 for i in range(1, 5))
    assert all(abs(v) <= s for i, s in zip(range(5, 10), search.SCALES) for v in seeded[i])
    blind = search.certifying_starts(trees, 1, blind=True).collect()
    assert len(blind) == 16 and all(abs(r.c[0]) <= 12 and abs(r.c[1]) <= 6 for r in blind)


def test_generated_workload_is_spread(spark, monkeypatch):
    """Trees of a table in one small file are made in as many tasks as the session has, not in one."""
    from arborist.operators import workload
    from arborist.plans import queries_more

    node = lambda _: F.struct(F.lit(0).alias("nt"), F.lit(0.0).cast("float").alias("nv"), F.lit(-1).alias("ci"))
    monkeypatch.setattr(workload, "generated", lambda *_: F.transform(F.sequence(F.lit(0), F.spark_partition_id()), node))
    made = {r.preset: r.mean_nodes for r in queries_more.t12_generated_workload(spark, "/root/testdata/sf0.001").collect()}
    assert made[next(iter(workload.PRESETS))] > 1.5  # 1 in one task


def test_trees_without_constants_are_never_split(spark, monkeypatch):
    """Their losses under the engines are one, though sums in another order may differ in the last digit."""
    from arborist.plans import queries_more

    wide = spark.createDataFrame([(7, 1, 7, 0, 1.0, 1.0 + 2.0**-52, 1.0 - 2.0**-52), (8, 1, 0, 2, 1.0, 1.5, 0.5)], "tree_id long, problem_id long, shape int, k int, l0 double, la double, lb double")
    monkeypatch.setattr(queries_more.panels, "_wide", lambda spark, sf_dir: wide)
    assert queries_more.a33_generation_accounting(spark, "").first().split == 1


def test_engines_agree_on_trees_without_constants(spark, monkeypatch):
    """They are scored once: sums of the same terms in another order may differ in the last digit, and a loss would be above itself."""
    from arborist.plans import queries_panels as panels

    exact = scoring.losses
    off = lambda *args: exact(*args).withColumn("loss", F.col("loss") * F.when(F.col("engine") == "low", 1 + 2.0**-52).when(F.col("engine") == "high", 1 - 2.0**-53).otherwise(1.0))
    monkeypatch.setattr(panels.s, "losses", off)
    sf = "/root/testdata/sf0.001"
    without = [r for r in panels.l09_boundary_audit(spark, sf).collect() if r.before == 3]
    assert [(r.after, r.reverted) for r in without] == [(3, False)]
    rows = panels._losses(spark, sf).where("k = 0").groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct("engine").alias("engines"), F.count_distinct("loss").alias("losses")).collect()
    assert rows and {(r.n, r.engines, r.losses) for r in rows} == {(3, 3, 1)}


def test_engines_are_aligned_on_losses_computed_once(spark):
    """Not once for each side of the join: the sides' sums would be added up in different orders."""
    from arborist.plans import queries_panels as panels

    met = panels.j04_engine_alignment(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in met._jdf.queryExecution().executedPlan().toString()
    row = met.first()
    assert row.n > 0 and row.lacking == 0


def test_losses_send_no_trees_to_the_driver(spark):
    """The audit plans no broadcast, whatever Spark takes the trees' number for."""
    from arborist.plans import queries_panels as panels

    plan = panels.l09_boundary_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_trees_of_one_structure_are_fitted_together(monkeypatch):
    """Their fits are those that each has alone, with as many calls as the longest of them needs."""
    rng = np.random.default_rng(5)
    texts = ("c0 + c1 * x0", "c0 * exp(-(c1 * x0)) + c2", "c0 * log(x0 + c1)", "c0 * x1 + c1")
    trees, points = [], []
    for i in range(60):
        tree, n = t.prefix(t.parse(texts[i % 4])), int(rng.integers(1, 90))
        trees.append({"nodes": [dict(zip(("nt", "nv", "ci"), node)) for node in tree], "c": rng.uniform(-1, 2, sum(node[0] == t.CONST for node in tree)).tolist()})
        there = rng.random(n) < (0.8 if i % 3 else 2)
        points.append((rng.uniform(0.1, 4, (n, 2)), np.where(there, rng.normal(2, 1, n), np.nan), there))
    calls, many = [], fitting.arrays.numbers_of_many
    monkeypatch.setattr(fitting.arrays, "numbers_of_many", lambda nodes, c, *rest: calls.append(len(c)) or many(nodes, c, *rest))
    for options in (fitting.Options(), fitting.Options(damping="absolute", jacobian="central"), fitting.Options(jacobian="forward", order="step"), fitting.Options(jacobian="dual")):
        calls.clear()
        with np.errstate(all="ignore"):
            got = fitting.fit_all(trees, points, 12, options)
            want = [fitting.fit_one(tree["nodes"], np.array(tree["c"]), at, 12, options) for tree, at in zip(trees, points)]
        assert {status for _, status, *_ in got} >= {fitting.CONVERGED, fitting.MAXITER, fitting.FAIL_NAN}
        assert len(calls) <= 4 * 13 and max(calls) == 15
        for (c, status, n_iter, first, last), (c_one, status_one, n_one, first_one, last_one) in zip(got, want):
            assert first == pytest.approx(first_one, rel=1e-9)
            if status in (fitting.FAIL_NAN, fitting.FAIL_CHOLESKY) and n_iter < 2:
                assert (status, n_iter) == (status_one, n_one)
            if math.isfinite(first):
                assert last == pytest.approx(last_one, rel=1e-5, abs=1e-9)
    monkeypatch.setattr(fitting, "MANY_POINTS", 100)
    with np.errstate(all="ignore"):
        assert len(fitting.fit_all(trees, points, 12, fitting.Options())) == 60


def test_study_rows_are_dealt_before_they_are_counted(spark, monkeypatch):
    """One file's rows are counted by many tasks: each task that reads them would hold almost all of its values."""
    from arborist.plans import queries_relational, registry

    registry.load()
    tasks = []
    for module in (studies, queries_relational):
        monkeypatch.setattr(module, "percentiles", lambda rows, *rest: tasks.append(rows.rdd.getNumPartitions()) or ranking.percentiles(rows, *rest))
    for name in ("a25_arm_block", "a26_arm_by_difficulty", "a27_two_level_medians"):
        tasks.clear()
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert tasks[0] == 4 * spark.sparkContext.defaultParallelism


def test_tournaments_take_tasks_by_their_draws(spark, monkeypatch):
    rows = [(g, i, float((i * 7) % 31)) for g in (None, 1) for i in range(60)]
    members = spark.createDataFrame(rows, "g int, id long, f double")
    few = search.tournament(members, ["g"], "f", "id", 5, 0.5)
    want = sorted(few.collect(), key=str)
    assert len(want) == 60 and {r.g for r in want} == {None, 1}
    monkeypatch.setattr(search, "TASK_DRAWS", 10)
    many = search.tournament(members, ["g"], "f", "id", 5, 0.5)
    assert few.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 31
    assert sorted(many.collect(), key=str) == want
