import random
import statistics

import duckdb
import pandas as pd
import pytest

from millrace.model import pipeline
from millrace.operators import selection
from millrace.plans.run import frames
from millrace.storage import written

ITEMS = {
    "median": "median(v) AS median", "low": "quantile_cont(v, 0.1) AS low", "high": "quantile_disc(v, 0.95) AS high", "none": "quantile_disc(v, 0) AS none", "all": "quantile_cont(w, 1) AS all",
    "some": "median(v) FILTER (WHERE w > 40) AS some", "word": "quantile_disc(s, 0.3) AS word", "made": "median(v * 2 + coalesce(w, 0)) AS made", "n": "count(*) AS n", "top": "max(w) AS top",
}


@pytest.fixture(scope="module")
def rows():
    """Half of the rows share one key, a third of them one value; keys and values have nulls, one key only null values."""
    rng = random.Random(5)
    out = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([7, rng.randrange(-100, 100), None]), round(rng.uniform(0, 90), 2), rng.choice("abcdefg")) for _ in range(900)]
    return out + [(9, None, None, None)] * 3 + [(10, 5, 1.5, "x")]


@pytest.mark.parametrize("by", [[], ["k"], ["k", "s"]])
def test_quantiles_against_sql(spark, rows, tmp_path, by):
    spark.createDataFrame(rows, "k int, v long, w double, s string").repartition(6).write.parquet(str(tmp_path / "t"))
    step = {"aggregations": ", ".join(ITEMS.values()), "group_by": by}
    out = frames(spark, pipeline(("t", "src.file.parquet", {"path": str(tmp_path / "t")}), ("a", "xf.aggregate", step)))["a"]
    assert out.columns == [*by, *ITEMS]
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    t = pd.DataFrame(rows, columns=["k", "v", "w", "s"]).astype({"k": "Int64", "v": "Int64"})  # noqa: F841
    items = ", ".join(ITEMS.values()).replace("AS all", 'AS "all"')
    t = duckdb.sql("SELECT * REPLACE (CASE WHEN isnan(w) THEN NULL ELSE w END AS w) FROM t")  # noqa: F841
    want = duckdb.sql(f"SELECT {', '.join([*by, items])} FROM t {'GROUP BY ' + ', '.join(by) if by else ''}").fetchall()
    norm = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(norm, out.collect())) == sorted(map(norm, want))


def test_empty_table_and_modes(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "z"), (2, "y"), (3, None)], "k int, a0 string")
    held = lambda x: written(spark, x, "t")
    got = selection.aggregated(df, ["k"], ["mode(a0) AS k0", "percentile_disc(0.5) WITHIN GROUP (ORDER BY a0) AS part"], held)
    assert got.columns == ["k", "k0", "part"] and sorted(map(tuple, got.collect())) == [(1, "b", "b"), (2, "y", "y"), (3, None, None)]
    none = df.where("k > 5").selectExpr("k", "k AS v")
    assert list(map(tuple, selection.aggregated(none, [], ["median(v) AS m", "count(v) AS n"], held).collect())) == [(None, 0)]
    assert selection.aggregated(none, ["k"], ["median(v) AS m"], held).collect() == []


@pytest.mark.parametrize("text", ["median(x) - median(y)", "median(DISTINCT x)", "percentile(x, array(0.1, 0.2))", "percentile_disc(0.5) WITHIN GROUP (ORDER BY x DESC)", "sum(x) AS median", "round(median(x), 2)", "percentile(x, 0.5, n)"])
def test_left_to_spark(text):
    assert selection.pick_of(text) is None


def test_one_group_meets_in_many_tasks(spark):
    """All rows are one group: the counts are dealt over ranges, and only the ranges of the places are summed up."""
    seen = []

    def held(x):
        out = written(spark, x, "t")
        seen.append(sorted(r["count"] for r in out.groupBy("part").count().collect()))
        return out

    df = spark.range(0, 40_000, 1, 6).selectExpr("id % 10007 AS v")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        assert selection.aggregated(df, [], ["median(v) AS m"], held).first().m == statistics.median(i % 10007 for i in range(40_000))
    finally:
        spark.conf.set(conf, old)
    assert len(seen) == 1 and len(seen[0]) == 4 and max(seen[0]) < 2 * min(seen[0])


@pytest.mark.parametrize(("size", "percent", "want"), [(0, False, 0), (7, False, 7), (999, False, 999), (4000, False, 4000), (30_000, False, 20_000), (12.5, True, 2500), (100, True, 20_000), (0, True, 0)])
def test_samples(spark, size, percent, want):
    """Exactly so many rows, none twice, though a third of the rows are equal but for their number."""
    df = spark.range(0, 20_000, 1, 5).selectExpr("id", "if(id % 3 = 0, 0, id) AS draw_")
    out = selection.sampled(df, size, percent, 3, lambda x: written(spark, x, "t"))
    ids = [r.id for r in out.collect()]
    assert out.columns == ["id", "draw_"] and len(ids) == len(set(ids)) == want
    if 1000 < want < 20_000:
        assert abs(sum(i % 3 == 0 for i in ids) / want - 1 / 3) < 0.05 and abs(sum(ids) / want - 10_000) < 600


def test_a_few_rows_take_one_scan(spark):
    plan = selection.sampled(spark.range(100), 5, False, 1, None)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_draws_that_fall_short_are_made_again(spark, monkeypatch):
    """Rows that come in after the count, and a draw that gives too few."""
    df = spark.range(0, 5000, 1, 3)
    tries = []

    def held(x):
        tries.append(1)
        return written(spark, x.limit(900) if len(tries) == 1 else x, "t")

    assert selection.sampled(df, 40, True, 1, held).distinct().count() == 2000 and len(tries) == 2
