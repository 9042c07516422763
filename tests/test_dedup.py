"""The first row of each key by any order, against a window."""

import random

import pytest

from millrace.model import pipeline
from millrace.plans.run import frames


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(i % 3, rng.choice([None, "", "a", "ab", "abc", "é", "z", "~", "a\0"]), rng.choice([None, True, False]), rng.choice([None, -(2**63), 2**63 - 1, 0]), rng.choice([None, -1.5, 0.0, float("inf")]), i) for i in range(300)]
    spark.createDataFrame(made, "k int, t string, b boolean, n long, d double, i int").createOrReplaceTempView("dedup_rows")


@pytest.mark.parametrize("order", ["t DESC, i", "t DESC NULLS FIRST, i DESC", "b DESC, t, i", "n DESC, i", "d DESC, i", "n DESC NULLS FIRST, b DESC, t DESC, i DESC"])
def test_orders(spark, rows, order):
    got = frames(spark, pipeline(("s", "xf.sql", {"query": "SELECT * FROM dedup_rows"}, []), ("d", "xf.dedup", {"keys": ["k"], "order_by": order}), name="x"))["d"]
    by = ", ".join(x if "NULLS" in x else f"{x} NULLS LAST" for x in order.split(", "))
    want = spark.sql(f"SELECT k, t, b, n, d, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {by}) AS r FROM dedup_rows) WHERE r = 1")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
