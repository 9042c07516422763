import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, resampling
from millrace.llm.scratch import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets=10_000, percent=5, least=20, seed=42):
    """{(row, doc_id, n_features, weight, score, rank)} by the definition; docs are (doc_id, text)."""
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    found = [features(t) for _, t in docs]
    s = Counter(crc(f) for _, fs in found for f in fs)
    t = Counter(crc(f) for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for i, ((d, _), (n, fs)) in enumerate(zip(docs, found, strict=True)):
        weight = sum(gain(crc(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((i, d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[4], r[1] is not None, r[1], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return Counter((*r[1:5], rank.get(r[0])) for r in rows)


def test_query(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect()]
    assert Counter(map(tuple, queries.QUERIES["op12_resampling"](spark, data).collect())) == brute(docs, target)


TEXTS = ["", "a", "A b", "a b c", "é!ü x9 " + "Z" * 200 + " q\x80 ~", "x " * 5, "0" * 63 + " " + "1" * 64 + " " + "2" * 65, ("y" * 70 + "-") * 9000, "z" * 600_000 + " tail end x", "w1 w2 " * 100_000]


def test_buckets():
    """Runs across the segments of long texts too."""
    got = {}
    for text, n, found in resampling.runs_of_words((t.encode() for t in TEXTS), 10_000):
        for k, i in enumerate(text.tolist()):
            for x in found:
                part = x[n[k] : n[k + 1]]
                got.setdefault(i, Counter()).update(part[part < 10_000].tolist())
    for i, t in enumerate(TEXTS):
        assert +got.get(i, Counter()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1])


def test_shifted():
    for a, b in [(b"", b"x"), (b"abc", b""), (b"abc", b"q" * 63), (b"abc", b"q" * 64), (b"z" * 9, b"r" * 100_001)]:
        got = resampling.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("seed", range(40))
def test_tournament(seed):
    rng = random.Random(seed)
    blocks = sorted(sorted((rng.randrange(50), rng.random()) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 20)))
    tree, out = resampling.Tournament(), []
    for block in blocks:
        while tree.head() is not None and tree.head() < block[0]:
            out.append(tree.take())
        tree.add(block)
    while tree.head() is not None:
        out.append(tree.take())
    assert out == sorted(x for b in blocks for x in b)
    assert len(tree.heads) <= 32


def test_many_runs_ranges_and_ties(spark, monkeypatch):
    """Ranks against a plain sort, with scores of which a third are equal, repeated ids, null ids and small blocks."""
    monkeypatch.setattr(resampling, "BLOCK", 7)
    rows = spark.range(0, 6000, 1, 13).selectExpr("id as row", "if(id % 50 = 0, null, id % 700) as doc_id", "id % 9 as n_features", "id % 11 as weight", "if(id % 3 = 0, 500, (id * 7919) % 1000) as score")
    scratch = Scratch(spark)
    kept = scratch.keep(rows, "scored")
    order = sorted(kept.collect(), key=lambda r: (-r.score, r.doc_id is not None, r.doc_id, r.row))
    for draws, per_range in ((1, 10), (300, 40), (2500, 100), (5999, 500), (6000, 1 << 20)):
        got = sorted(resampling.ranked(kept, draws, 6000, scratch, per_range).collect(), key=lambda r: r["rank"])
        assert [(r.row, r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got] == [(*r, k + 1) for k, r in enumerate(order[:draws])]


def test_edge_cases(spark):
    schema = "doc_id long, text string, score string, rank string, row string"
    target = spark.createDataFrame([("a b a",), (None,)], "text string")
    none = spark.createDataFrame([], schema)
    assert resampling.resample(none, target, Scratch(spark)).collect() == []
    docs = [(None, None), (None, "a " * 30), (1, ""), (2, "a b " * 20), (2, "a b " * 20), (3, "q " * 19), *[(10 + i, f"w{i} " * 25) for i in range(60)]]
    rows = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], schema)
    for tables, texts in ((target, ["a b a", None]), (target.where("false"), [])):
        got = resampling.resample(rows, tables, Scratch(spark), percent=10)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == brute(docs, texts, percent=10)
    assert resampling.resample(rows, target, Scratch(spark), least_words=1000).where(F.col("rank").isNotNull()).isEmpty()


def test_matches_sql(same):
    same(queries.QUERIES["op12_resampling"], queries.ORACLE_SQL["op12_resampling"])
