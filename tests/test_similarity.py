import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import similarity
from millrace.storage import written


def brute(vectors, queries, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items() if v is not None and len(v) and np.any(v)}
    out = {}
    for q in queries:
        if q in unit:
            near = sorted((-round(float(unit[q] @ u), 9) + 0.0, i) for i, u in unit.items())[:k]
            out |= {(q, n + 1): (i, round(-s, 6) + 0.0) for n, (s, i) in enumerate(near)}
    return out


@pytest.mark.parametrize(("cells", "block", "k"), [(1024, 4096, 5), (16, 10, 3), (3, 7, 12), (1, 50, 400)])
def test_against_all_pairs(spark, monkeypatch, cells, block, k):
    """A third of the vectors are equal; some have no direction; clusters and far ones."""
    monkeypatch.setattr(similarity, "CELLS", cells)
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "QUERIES", 9)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 8))
    vectors = {i: [1.0, 2.0, 0.0, 0.0, -1.0, 0.0, 0.0, 3.0] if i % 3 == 0 else (centres[i % 6] + rng.normal(size=8) * (0.1 if i % 2 else 2)).tolist() for i in range(300)}
    vectors |= {300: None, 301: [], 302: [0.0] * 8, 303: (-np.array(vectors[0])).tolist()}
    df = spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>").repartition(4)
    queries = [i for i in vectors if i % 10 == 0 or i > 299]
    got = similarity.nearest(df, df.where(F.col("id").isin(queries)), k, lambda x: written(spark, x, "t"))
    assert {(r.query, r.place): (r.id, round(r.similarity, 6) + 0.0) for r in got.collect()} == brute(vectors, queries, k)


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, embedding array<float>")
    assert similarity.nearest(df, df, 3, lambda x: x).collect() == []


def test_far_cells_are_not_seen(spark, monkeypatch):
    """Tight clusters far apart: what meets is a small part of all pairs."""
    monkeypatch.setattr(similarity, "CELLS", 20)
    rng = np.random.default_rng(1)
    centres = np.eye(40)
    rows = [(i, (centres[i % 40] + rng.normal(size=40) * 0.001).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    seen = []

    def held(x):
        out = written(spark, x, "t")
        if x.columns == ["query", "id", "similarity"]:
            seen.append(out.count())
        return out

    found = similarity.nearest(df, df.where("id % 50 = 0"), 4, held)
    assert found.count() == 40 * 4 and seen[0] <= 4 * 160  # of 80,000 pairs, in four blocks of a cell



def test_visits_are_not_broadcast(spark):
    """What every query asks of every cell is far more than the queries; it must not pass the driver."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(400)], "id long, embedding array<double>").repartition(4)
    seen, blocks = [], []

    def held(x):
        if "asked" in x._jdf.queryExecution().optimizedPlan().toString():
            seen.append(x._jdf.queryExecution().executedPlan().toString())
        out = written(spark, x, "t")
        if "radius" in x.columns:
            blocks.append(out.count())
        return out

    found = similarity.nearest(df, df.where("id % 20 = 0"), 3, held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for p in (*seen, plan):
        assert not any("cell" in line for line in p.splitlines() if "BroadcastHashJoin" in line)
    assert seen and "SortMergeJoin" in plan
