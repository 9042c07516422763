import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, queries
from millrace.llm.scratch import Scratch


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    total = sum(sizes.values())
    while open_:
        rest = total - sum(target[s] for s in order if s not in open_)
        share = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / share >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = rest * w[s] / share
            break
        for s in over:
            target[s] = float(most * sizes[s])
        open_ -= over
    return target


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string")


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1000, "é": 5, None: 50, "B": 0}, {"x": 7}, {"z": 0, "y": 0}, {chr(97 + i): 3**i for i in range(9)}])
def test_targets(spark, sizes):
    rows = [(i, " w" * n, s, "clash", "clash") for i, (s, n) in enumerate(sizes.items())]
    got = {r.row.source: (r.source_size, r.target) for r in mixing.mix(table(spark, rows), Scratch(spark)).collect()}
    want = water(sizes)
    for s, n in sizes.items():
        assert got[s][0] == n
        assert got[s][1] == pytest.approx(want[s], abs=1e-6)


def test_taken_words_come_near_their_targets(spark):
    rows = spark.range(6000).select("id", F.expr("repeat('w ', 5 + cast(id % 11 as int))").alias("text"), F.expr("concat('s', id % 7 % 5)").alias("source"), F.lit("").alias("size"), F.lit("").alias("target")).toDF("doc_id", "text", "source", "size", "target")
    mixed = mixing.mix(rows, Scratch(spark)).cache()
    by = mixed.groupBy("row.source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("n_copies")).alias("taken"), F.max("n_copies").alias("most"))
    for r in by.collect():
        assert r.taken == pytest.approx(r.target, rel=0.1) and r.most <= 3
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("n_copies")).first()[0]
    assert mixed.select("row.doc_id", "n_copies").exceptAll(mixing.mix(rows, Scratch(spark)).select("row.doc_id", "n_copies")).isEmpty()


def test_edge_cases(spark):
    assert mixing.mix(table(spark, []), Scratch(spark)).collect() == []
    rows = [(None, "a b", "s", "", ""), (1, None, "s", "", ""), (1, "", None, "", ""), (2, "x y z\x0bq", None, "", "")]
    assert sorted((r.row.doc_id or 0, r.size) for r in mixing.mix(table(spark, rows), Scratch(spark)).collect()) == [(0, 2), (1, 0), (1, 0), (2, 3)]


def test_matches_sql(same):
    same(queries.QUERIES["op7_mixing"], queries.ORACLE_SQL["op7_mixing"])


def test_a_copy_is_a_draw_of_its_own_id(spark):
    """Against the definition in plain Python; other rows of a source change a row's copies by the rate only."""
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}", "", "") for i in range(800)]
    sizes = {f"s{k}": sum(1 + i % 9 for i in range(800) if i % 4 == k) for k in range(4)}
    want = water(sizes)
    for r in mixing.mix(table(spark, rows), Scratch(spark), seed=3).collect():
        rate = want[r.row.source] / sizes[r.row.source]
        u = int(hashlib.md5(f"{r.row.doc_id}:3".encode()).hexdigest()[:8], 16) / 2**32
        assert r.n_copies == int(rate) + (u < rate - int(rate))


def test_any_column_names(spark):
    names = ["size", "source_size", "source_rows", "target", "n_copies", "row", "of", "copy", "k", "part", "_source", "_k", "_copy", "_rate", "_part", "weight"]
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.expr("if(id = 0, null, concat('s', id % 3))").alias("source"), *[F.lit(f"my {n}").alias(n) for n in names])
    out = mixing.emit(mixing.mix(rows, Scratch(spark)))
    assert out.columns == rows.columns
    assert all(r[n] == f"my {n}" for r in out.collect() for n in names)


def test_many_sources_and_large_sizes(spark):
    """Numbers of sources in several ranges, and products beyond 64 bits."""
    sized = spark.range(500).select(F.format_string("s%04d", "id").alias("source"), (F.col("id") * (1 << 44)).alias("size"))
    got = {r.source: r for r in mixing.targets(sized, Scratch(spark)).collect()}
    want = water({f"s{i:04d}": i << 44 for i in range(500)})
    assert len(got) == 500 and all(got[s].target == pytest.approx(want[s], rel=1e-9) for s in want)
