import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.model import pipeline
from millrace.operators import ordered
from millrace.plans.run import frames


def written(spark):
    from millrace.storage import new_path

    def held(df):
        path = new_path(spark, "held")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return held


@pytest.fixture(scope="module")
def rows():
    """A third of the rows share one key; keys and values have nulls."""
    rng = random.Random(3)
    return [(i, None if rng.random() < 0.05 else 7 if i % 3 == 0 else rng.randrange(60), None if rng.random() < 0.1 else rng.randrange(-50, 50)) for i in range(700)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k long, v long").repartition(5)


CASES = [
    ("row_number()", "k DESC NULLS FIRST, id"), ("rank()", "k"), ("rank()", "k DESC NULLS FIRST, v"), ("dense_rank()", "k, v DESC"), ("percent_rank()", "k"), ("cume_dist()", "k DESC"), ("ntile(9)", "v, id"), ("ntile(1000)", "id"),
    ("lag(v)", "k, id"), ("lag(v, 4, -1)", "id DESC"), ("lead(v, 2)", "k, id"), ("sum(v)", "k"), ("count(v)", "k DESC"), ("count(*)", "k"), ("min(v)", "k"), ("max(v)", "v NULLS FIRST"), ("avg(v)", "k"),
    ("sum(v)", "k, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), ("avg(v)", "id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), ("max(v)", "k, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), ("sum(v)", None), ("min(v)", None),
]


def nulls_last(order):
    head, _, frame = order.partition(" ROWS ") if " ROWS " in order else order.partition(" RANGE ")
    keys = ", ".join(k if "NULLS" in k else f"{k} NULLS LAST" for k in head.split(", "))
    return keys + (f" {'ROWS' if ' ROWS ' in order else 'RANGE'} {frame}" if frame else "")


@pytest.mark.parametrize(("call", "order"), CASES)
def test_windows_over_all_rows(spark, rows, table, call, order, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    step = {"expression": call, "output_column": "o", **({"order_by": order} if order else {})}
    out = frames(spark, pipeline(("t", "src.file.parquet", {"path": str(tmp_path / "t")}), ("w", "xf.window", step)))["w"]
    assert out.columns == ["id", "k", "v", "o"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "SinglePartition" not in plan or order is None
    t = pd.DataFrame(rows, columns=["id", "k", "v"]).astype("Int64")  # noqa: F841
    want = duckdb.sql(f"SELECT id, {call} OVER ({'ORDER BY ' + nulls_last(order) if order else ''}) AS o FROM t").fetchall()
    near = lambda x: None if x is None else round(float(x), 9)
    assert sorted((r.id, near(r.o)) for r in out.collect()) == sorted((i, near(o)) for i, o in want)


@pytest.mark.parametrize("order", ["k", "id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"])
def test_other_windows_keep_their_one_task(spark, table, order):
    call = "first_value(v)" if order == "k" else "sum(v)"
    keys, frame = ordered.split_frame(order)
    assert ordered.over_all(table, call, [(keys, False, False)], frame, lambda df: df) is None


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 4, 40])
def test_asof(spark, strict, parts):
    """Against a search: keys that lie in many ranges, keys without right rows, nulls, equal times."""
    rng = random.Random(parts)
    key = lambda: None if rng.random() < 0.03 else 1 if rng.random() < 0.4 else rng.randrange(30)
    left = [(i, key(), None if rng.random() < 0.03 else rng.randrange(400)) for i in range(600)]
    right = [(1000 + i, key(), rng.randrange(400)) for i in range(90)]
    right = list({(k, t): (i, k, t) for i, k, t in right}.values())
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        a = spark.createDataFrame(left, "id long, k long, at long")
        b = spark.createDataFrame(right, "rid long, k long, t long")
        out = ordered.asof_join(a, b, ["k"], "at", "t", written(spark), strict=strict, keep=True)
        assert out.columns == ["id", "k", "at", "rid", "t"]
        got = {r.id: r.rid for r in out.collect()}
        inner = ordered.asof_join(a, b, ["k"], "at", "t", written(spark), strict=strict).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {}
    for i, k, at in left:
        near = [(t, r) for r, rk, t in right if k is not None and at is not None and rk == k and (t < at if strict else t <= at)]
        want[i] = max(near)[1] if near else None
    assert got == want and inner == sum(v is not None for v in want.values())


def test_asof_without_keys_and_empty(spark):
    a = spark.createDataFrame([(i, i * 10) for i in range(50)], "id long, at long")
    b = spark.createDataFrame([(100 + i, i * 25 + 3) for i in range(12)], "rid long, t long")
    got = {r.id: r.rid for r in ordered.asof_join(a, b, [], "at", "t", written(spark)).collect()}
    assert got == {i: 100 + min(11, (i * 10 - 3) // 25) for i in range(1, 50)}
    assert ordered.asof_join(a, b.limit(0), [], "at", "t", written(spark)).count() == 0
    assert ordered.asof_join(a, b.limit(0), [], "at", "t", written(spark), keep=True).count() == 50


def test_positional(spark):
    a = spark.createDataFrame([(i,) for i in range(37)], "x long").repartition(4)
    b = spark.createDataFrame([(i, f"s{i}") for i in range(60)], "y long, at_ string").repartition(3)
    for _ in range(2):
        got = ordered.positional_join(a, b, [("x", True, False)], [("y", False, False)], written(spark)).collect()
        assert sorted((r.y, r.x) for r in got) == [(i, 36 - i if i < 37 else None) for i in range(60)]


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
@pytest.mark.parametrize("opened", [(False, False), (True, True), (False, True)])
def test_range_join(spark, kind, opened):
    """Intervals of very different lengths, empty ones, points on their ends, infinite ends; most points in one place."""
    rng = random.Random(6)
    number = (lambda x: float(x)) if kind == "double" else (lambda x: x)
    points = [(i, number(500 if i % 3 == 0 else rng.randrange(-1000, 1000))) for i in range(300)] + [(900, None)]
    spans = []
    for i in range(80):
        a = rng.randrange(-1000, 1000)
        spans.append((i, number(a), number(a + rng.choice([-5, 0, 1, 2, 7, 64, 900]))))
    spans += [(90, None, number(3)), (91, number(0), None)]
    if kind == "double":
        spans += [(92, float("-inf"), 0.5), (93, 0.25, float("inf")), (94, 1e-12, 2e-12)]
        points += [(901, 1.5e-12), (902, float("inf")), (903, 1e18)]
    a, b = spark.createDataFrame(points, f"id long, p {kind if kind != 'timestamp' else 'long'}"), spark.createDataFrame(spans, f"sid long, lo {kind if kind != 'timestamp' else 'long'}, hi {kind if kind != 'timestamp' else 'long'}")
    if kind == "timestamp":
        a, b = a.withColumn("p", F.timestamp_micros("p")), b.withColumn("lo", F.timestamp_micros("lo")).withColumn("hi", F.timestamp_micros("hi"))
    joined = ordered.range_join(a, b, "p", "lo", "hi", low_open=opened[0], high_open=opened[1])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.id, r.sid) for r in joined.collect())
    want = sorted((i, s) for i, p in points for s, lo, hi in spans if None not in (p, lo, hi) and lo <= hi and (p > lo if opened[0] else p >= lo) and (p < hi if opened[1] else p <= hi))
    assert got == want


@pytest.mark.parametrize("kind", ["long", "double", "timestamp_ntz"])
@pytest.mark.parametrize("opened", [(False, False), (True, True), (False, True)])
def test_range_totals(spark, kind, opened, monkeypatch):
    """The totals of the pairs, without the pairs: blocks of 8 points and lookups in several shares; many points in one
    place, values near the limits of their types, null values and keys, intervals of all lengths, most of them one interval."""
    monkeypatch.setattr(ordered, "_BLOCK", 8)
    monkeypatch.setattr(ordered, "_LOOKUPS", 16)
    rng = random.Random(8)
    number = (lambda x: float(x)) if kind == "double" else (lambda x: x)
    points = [(None if i % 7 == 0 else rng.choice([i, (1 << 62) + i, -(1 << 62) - i]), number(500 if i % 3 == 0 else rng.randrange(-1000, 1000)), i / 8) for i in range(400)] + [(900, None, 1.0)]
    spans = [(i % 50 if i % 11 else None, number(a), number(a + rng.choice([-5, 0, 1, 2, 7, 64, 900, 3000]))) for i in range(120) for a in [rng.randrange(-1500, 1500)]]
    spans += [(90, None, number(3)), (91, number(0), None), (92, number(5000), number(6000)), *[(93, number(499), number(500))] * 60, (94, number(-9000), number(9000))]
    plain = kind if kind != "timestamp_ntz" else "long"
    a, b = spark.createDataFrame(points, f"id long, p {plain}, x double"), spark.createDataFrame(spans, f"rows_ long, lo {plain}, hi {plain}")
    if kind == "timestamp_ntz":
        time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
        a, b = a.withColumn("p", time("p")), b.withColumn("lo", time("lo")).withColumn("hi", time("hi"))
    items = [ordered.total_of(x) for x in ("count(*) AS n", "count(id) AS ids", "min(id) AS low", "max(id) AS high", "CAST(sum(id % 1000003) AS BIGINT) AS total", "sum(x * 2) AS xs", "min(x) AS least")]
    got = ordered.range_totals(a, b, "p", "lo", "hi", items, ["rows_"], written(spark), low_open=opened[0], high_open=opened[1])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = ordered.range_join(a, b, "p", "lo", "hi", low_open=opened[0], high_open=opened[1])
    aggregates = [F.expr(x) for x in ("count(*) AS n", "count(id) AS ids", "min(id) AS low", "max(id) AS high", "sum(id % 1000003) AS total", "sum(x * 2) AS xs", "min(x) AS least")]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(pairs.groupBy("rows_").agg(*aggregates))
    assert rows(got) == want and len(want) > 20 and got.columns == ["rows_", "n", "ids", "low", "high", "total", "xs", "least"]
    whole = ordered.range_totals(a, b, "p", "lo", "hi", items, [], written(spark), low_open=opened[0], high_open=opened[1])
    assert rows(whole) == rows(pairs.agg(*aggregates))
    for empty in ((a.limit(0), b), (a, b.limit(0))):
        assert ordered.range_totals(*empty, "p", "lo", "hi", items, ["rows_"], written(spark)).count() == 0
        assert ordered.range_totals(*empty, "p", "lo", "hi", items, [], written(spark)).first()[:3] == (0, 0, None)


def test_range_totals_keep_whole_sums(spark):
    """Sums that fit come out although those of the points around do not; others are errors, as in Spark."""
    a = spark.createDataFrame([(i, (-1) ** (i // 3) * ((1 << 63) - 5)) for i in range(12)], "p long, v long")
    b = spark.createDataFrame([(i, i, i) for i in range(12)] + [(20, 2, 3), (21, 0, 2)], "k long, lo long, hi long")
    items = [ordered.total_of("sum(v) AS total")]
    got = ordered.range_totals(a, b.where("k < 21"), "p", "lo", "hi", items, ["k"], written(spark))
    assert {r.k: r.total for r in got.collect()} == {i: (-1) ** (i // 3) * ((1 << 63) - 5) for i in range(12)} | {20: 0}
    with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE"):
        ordered.range_totals(a, b, "p", "lo", "hi", items, ["k"], written(spark)).collect()


def test_join_range_makes_no_pairs(spark, data):
    """The query's largest join is one of blocks and lookups: two for an interval at most."""
    from millrace import catalog

    plan = catalog.QUERIES["join_range"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "level_" not in plan


def test_join_properties_are_checked(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    src = ("a", "src.file.parquet", {"path": str(tmp_path / "a")})
    for props, message in (({"type": "asof"}, "left_on"), ({"type": "range", "condition": "x = y"}, "range join"), ({"type": "positional"}, "left_on")):
        with pytest.raises(Exception, match=message):
            frames(spark, pipeline(src, ("j", "xf.join", props, {"left": "a", "right": "a"})))


@pytest.mark.parametrize(("props", "message"), [({"type": "range", "aggregations": "count(DISTINCT id) AS n"}, "xf.aggregate"), ({"type": "range", "aggregations": "median(id) AS n"}, "xf.aggregate"), ({"type": "range", "group_by": ["id"]}, "goes with"), ({"type": "inner", "aggregations": "count(*) AS n"}, "type range")])
def test_totals_of_a_range_join_are_checked(spark, tmp_path, props, message):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    src = ("a", "src.file.parquet", {"path": str(tmp_path / "a")})
    with pytest.raises(Exception, match=message):
        frames(spark, pipeline(src, ("j", "xf.join", {"condition": "id >= lo AND id < hi", **props}, {"left": "a", "right": "a"})))


def test_an_offset_alone_is_no_single_task(spark, tmp_path):
    """The rows after the first n of an order, in that order, dealt to tasks."""
    spark.range(0, 5000, 1, 4).selectExpr("id * 7919 % 5000 AS x").write.parquet(str(tmp_path / "a"))
    for n in (1, 1234, 4999, 6000):
        steps = (("a", "src.file.parquet", {"path": str(tmp_path / "a")}), ("s", "xf.sort", {"by": "x DESC"}), ("l", "xf.limit", {"offset": n}))
        df = frames(spark, pipeline(*steps))["l"]
        assert "Offset" not in df._jdf.queryExecution().executedPlan().toString()
        assert [r.x for r in df.collect()] == list(range(4999 - n, -1, -1))
