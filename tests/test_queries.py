"""Every registered query against its SQL twin on the smallest tables."""

import glob

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from arborist.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {path.rsplit('/', 1)[1].removesuffix('.parquet')} as from '{path}'")
    return con


def rows(frame):
    """Rows as sorted tuples of texts, so that kinds of numbers and nulls compare."""
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return ""
        return str(float(v)) if isinstance(v, (int, float, np.number, bool, np.bool_)) else str(v)

    return sorted(tuple(map(text, row)) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.SQL:
        assert got.count() > 0
        return
    want = duck.sql(registry.SQL[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plan_of(spark, name):
    """The query's execution as planned without statistics of its run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = registry.QUERIES[name](spark, SF)._jdf.queryExecution()
        return execution, execution.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_gradients_are_compiled(spark):
    stages = plan_of(spark, "h20_gradients_agree")[0].debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert 0 < min(sizes) and max(sizes) < 8000  # -1: refused by the compiler; above 8000 bytes Java interprets a method


def test_each_structure_is_read_out_once(spark):
    plan = plan_of(spark, "t07_y03_read_out")[1]
    assert plan[plan.index("ArrowEvalPython") :].count("HashAggregate") == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
