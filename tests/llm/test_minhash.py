from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import minhash, queries
from millrace.llm.scratch import Scratch
from millrace.llm.words import shingles, words_of


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def brute(rows, k, percent):
    """(n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = [x for x in words(text) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(spark, rows, k=4, percent=80):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n long, digest string")
    out = minhash.near_duplicates(df, Scratch(spark), k, percent).collect()
    return out


def test_words_and_shingles():
    starts, ends, hashes = words_of("Ab  ab\tÄb äb x\x1fy".encode())
    assert len(hashes) == 4 and hashes[0] == hashes[1] and hashes[2] != hashes[3]
    assert (starts[0], ends[0]) == (0, 2)
    assert len(shingles(hashes, 4)) == 1 and len(shingles(hashes[:2], 4)) == 1 and len(shingles(hashes[:0], 4)) == 0
    long = ("word " * 200000 + "x" * 700000 + " end").encode()
    assert len(words_of(long)[2]) == 200002


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 1000):
        s = minhash.sketch(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (s != minhash._EMPTY).all()
    agree = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 500).astype(np.uint64)
        agree.append((minhash.sketch(x[:450]) == minhash.sketch(x[50:])).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (9, base), (8, base.upper()), (7, base + " x"), (20, base[:100]), (21, "q " * 50000), (22, "q " * 50001)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result(spark, rows)}
    want = brute(rows, 4, 80)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert got[1] == (0, 1, True) and got[5][1] == 4 and got[9][1] == 7 and got[22][1] == 21


def test_empty_table_and_repeated_rows(spark):
    assert result(spark, []) == []
    assert len(result(spark, [(1, "a b c d e")] * 3)) == 3
    assert [r.component_id for r in result(spark, [(None, "a b c d e"), (2, "a b c d e")])] in ([2, 2], [None, 2])


def test_rows_of_one_id_are_one_document(spark):
    """Its set is the union of its rows' sets, as in the SQL: a row that is a copy of nothing is not lost."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, a + " " + b), (4, None), (4, ""), (5, None), (5, a), (None, a), (None, a)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in result(spark, rows))
    assert [x for x in got if x[0] != "None"] == [("1", 37, 1, True), ("2", 74, 2, True), ("2", 74, 2, True), ("3", 77, 2, False), ("4", 0, 4, True), ("4", 0, 4, True), ("5", 37, 1, False), ("5", 37, 1, False)]
    assert len(got) == len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in minhash.one_of_each(df, Scratch(spark), k=4).collect()) == ["1", "2", "2", "4", "4", "None", "None"]


@pytest.mark.parametrize(("few", "chunk"), [(32, 256), (2, 3), (0, 256)])
def test_chains_and_a_large_group_of_near_copies(spark, monkeypatch, few, chunk):
    """Buckets of many classes, of which the pivot is linked with few: rare shingles find the rest, one pair
    at a time or in chunks."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "FEW", few)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(40, rng.integers(0, 5), replace=False):
            w[at] = f"v{rng.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, rows)}
    assert got == brute(rows, 4, 80)
    assert len({c for _, c in got.values()}) > 3


def test_many_unlinked_members_never_meet(spark, monkeypatch):
    """10,000 sets that share half of their shingles, with a few links among them: what meets are the links."""
    rng = np.random.default_rng(7)
    common = rng.integers(0, 2**63, 50, dtype=np.uint64)
    rows, links = [], set()
    for i in range(10_000):
        own = rng.integers(0, 2**63, 50, dtype=np.uint64)
        if i % 100 == 1:  # near its neighbour
            own = np.concatenate((last[: 50 - i % 7], own[: i % 7]))
            if 100 * (100 - i % 7) >= 80 * (100 + i % 7):
                links.add((i - 1, i))
        last = own
        rows.append((i, i, bytearray(np.unique(np.concatenate((common, own))).tobytes())))
    df = spark.createDataFrame(rows, "id long, c long, items binary")
    seen = []
    confirmed = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *more: (seen.append(pairs.count()), confirmed(pairs, *more))[1])
    found = minhash._by_rare_shingles(df.select("id", "c"), df.select("id", "items"), 80, Scratch(spark))
    assert {(r.a, r.b) for r in found.collect()} == links and len(links) == 100
    assert seen[0] < 300


def test_rare_shingles_and_all_pairs(spark):
    """On sets of few distinct shingles, where each is common, against all pairs."""
    rng = np.random.default_rng(9)
    universe = rng.integers(0, 2**63, 15, dtype=np.uint64)
    sets = {i: set(rng.choice(universe, rng.integers(8, 15), replace=False).tolist()) for i in range(300)}
    df = spark.createDataFrame([(i, i, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in sets.items()], "id long, c long, items binary")
    found = {(min(r), max(r)) for r in minhash._by_rare_shingles(df.select("id", "c"), df.select("id", "items"), 80, Scratch(spark)).collect()}
    pairs = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def joined(links):
        parent.update({i: i for i in sets})
        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {i: root(i) for i in sets}

    assert found <= pairs and len(pairs) > 50 and joined(found) == joined(pairs)


def test_matches_sql(same):
    same(queries.QUERIES["op2_minhash"], queries.ORACLE_SQL["op2_minhash"])


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, text, "a"), (2, text + " z", "b"), (5, "else entirely different words here", "c"), (6, None, "d")], "doc_id long, text string, more string")
    out = minhash.one_of_each(df, Scratch(spark))
    assert set(out.columns) == set(df.columns)
    assert sorted(r.doc_id for r in out.collect()) == [2, 5, 6]


def test_components_of_a_long_chain(spark):
    from millrace.llm.graph import components

    edges = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    found = defaultdict(set)
    for r in components(edges, Scratch(spark)).collect():
        found[r.component].add(r.id)
    assert found == {0: set(range(201))}
