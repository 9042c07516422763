from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, queries
from millrace.llm.scratch import Scratch

ITEM = " ".join(f"w{i}" for i in range(40))


def tables(spark, docs, items):
    d = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, item_id int")
    return d, spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, doc_id string")


def brute(docs, items, k=5, threshold=0.8):
    """Every window of every document against every item."""
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not w or not v:
                continue
            g = min(k, len(v))
            bag = Counter(tuple(v[j : j + g]) for j in range(len(v) - g + 1))
            if len(w) < g:
                continue
            n = min(len(v), len(w))
            for s in range(len(w) - n + 1):
                own = Counter(tuple(w[s : s + n][j : j + g]) for j in range(n - g + 1))
                both = sum((own & bag).values())
                value = both / (sum(own.values()) + sum(bag.values()) - both)
                if value >= threshold:
                    best = out.get((d, i), (0, 0, 0))
                    out[d, i] = (value, s, best[2] + 1) if value > best[0] else (*best[:2], best[2] + 1)
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_windows) for r in df.collect()}


def test_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(300)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, " ".join(prose(n))) for i, n in enumerate((12, 20, 33, 50, 50, 3))]
    docs = []
    for d in range(60):
        w = prose(rng.integers(0, 120))
        for _ in range(rng.integers(0, 3)):
            v = items[rng.integers(0, len(items))][1].split()
            for _ in range(rng.integers(0, 3)):
                v[rng.integers(0, len(v))] = "edit"
            at = rng.integers(0, len(w) + 1)
            w[at:at] = v
        docs.append((d, " ".join(w)))
    got, want = found(decontaminate.leaks(*tables(spark, docs, items), Scratch(spark))), brute(docs, items)
    assert got == {k: (pytest.approx(v[0]), *v[1:]) for k, v in want.items()}
    assert len(want) > 20


def test_repeated_shingles(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(5000)]
    docs, items = [], []
    for i in range(16):
        prose, run = list(rng.choice(vocabulary, 190 + 4 * (i % 4))), 20 + i % 3
        own, other = prose + ["0"] * run, prose + [f"u{j}" if i % 4 == 1 else "nil" for j in range(run)]
        if i % 4 == 2:
            own, other = prose + [f"v{j}" for j in range(run)], other
        items.append((i, " ".join(own)))
        docs.append((i, " ".join([*rng.choice(vocabulary, 30), *other, *rng.choice(vocabulary, 9), *["0"] * 40])))
    items += [(90, "a b " * 12), (91, "a " * 9), (92, "a a a a b")]
    docs += [(90, "a b " * 30 + "a " * 30), (91, "a b a b a"), (92, "x a a a a b a a a a")]
    got, want = found(decontaminate.leaks(*tables(spark, docs, items), Scratch(spark))), brute(docs, items)
    assert got == {k: (pytest.approx(v[0]), *v[1:]) for k, v in want.items()}
    assert {(i, i) for i in range(16)} <= want.keys()


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, ITEM.upper()), (4, "x " * 20000 + ITEM + " y"), (5, ITEM[:40]), (6, "a b"), (None, ITEM)]
    items = [(1, ITEM), (2, None), (3, ""), (4, "a b"), (5, ITEM)]
    got = found(decontaminate.leaks(*tables(spark, docs, items), Scratch(spark)))
    assert {k for k in got if k[1] in (1, 5)} == {(d, i) for d in (3, 4, None) for i in (1, 5)}
    assert (6, 4) in got and got[3, 1] == (1.0, 0, 1) and got[4, 1][:2] == (1.0, 20000)
    assert found(decontaminate.leaks(*tables(spark, docs, []), Scratch(spark))) == {}
    assert found(decontaminate.leaks(*tables(spark, [], items), Scratch(spark))) == {}


def test_items_that_share_a_phrase_meet_no_document_by_it(spark):
    """Many items begin alike; a document with the phrase alone is a pair of none of them."""
    phrase = " ".join(f"p{j}" for j in range(12))
    items = [(i, phrase + " " + " ".join(f"i{i}x{j}" for j in range(30))) for i in range(60)]
    docs = [(d, " ".join(f"d{d}y{j}" for j in range(20)) + " " + phrase) for d in range(40)] + [(100, "x y " + items[7][1])]
    d, b = tables(spark, docs, items)
    made = decontaminate.Benchmark(b, Scratch(spark), 5, 0.8)
    near = d.select(F.col("doc_id").alias("row"), made.near()("text").alias("words")).where("words is not null")
    hits = near.mapInArrow(decontaminate._hits(made.filter), "row long, gram long, hash long").join(made.rare(), ["gram", "hash"])
    assert hits.select("row", "item").distinct().count() == 1
    assert set(found(decontaminate.leaks(d, b, Scratch(spark)))) == {(100, 7)}


def test_the_filter_grows_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEWEST_BITS", 1 << 15)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 15)  # far too small: more documents are looked at, none is missed
    items = [(i, " ".join(f"i{i}x{j}" for j in range(60))) for i in range(120)]
    docs = [(d, items[d][1] if d % 3 == 0 else " ".join(f"d{d}y{j}" for j in range(60))) for d in range(60)]
    d, b = tables(spark, docs, items)
    assert len(decontaminate.Benchmark(b, Scratch(spark), 5, 0.8).filter.bits) == 1 << 12
    assert set(found(decontaminate.leaks(d, b, Scratch(spark)))) == {(x, x) for x in range(0, 60, 3)}


def test_clean_keeps_rows_and_columns(spark):
    names = ["row", "words", "doc", "item", "item_words", "hash", "gram", "item_id"]
    docs = [(1, ITEM), (1, "other text"), (None, ITEM), (2, None), (3, ""), (4, ITEM[:60]), (4, ITEM[:60])]
    d, b = tables(spark, docs, [(9, ITEM)])
    d = d.drop("item_id").select("*", *[F.lit(f"my {n}").alias(n) for n in names])
    left = decontaminate.clean(d, b, Scratch(spark))
    assert left.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "other text"), (2, ""), (3, ""), (4, ITEM[:60]), (4, ITEM[:60])]
    assert all(r[n] == f"my {n}" for r in left.collect() for n in names)
    assert decontaminate.clean(d, b.limit(0), Scratch(spark)).count() == 7
    assert decontaminate.clean(d.limit(0), b, Scratch(spark)).count() == 0


@pytest.mark.parametrize("size", [12, 30, 100, 400])
def test_fingerprints_at_the_threshold_lie_within_the_radius(size):
    """The recall of the radius, measured on windows of similarity just above 0.8: all but one in 200."""
    rng = np.random.default_rng(size)
    differ, near, n = int(size * 0.2 / 1.8), 0, 2000
    for _ in range(n):
        both = rng.integers(0, 2**63, size - differ, dtype=np.uint64)
        a, b = (np.concatenate((both, rng.integers(0, 2**63, differ, dtype=np.uint64))) for _ in "ab")
        x, y = (decontaminate.fingerprints(g, np.zeros(1, np.int64), size) for g in (a, b))
        near += bool(decontaminate.within(x, y[0])[0])
    assert near / n > 0.995


def test_the_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    item = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = np.tile(item, (3000, 1))
    for p in prints:
        for bit in rng.choice(256, rng.integers(0, 130), replace=False):
            p[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    distance = np.bitwise_count(prints ^ item).sum(axis=1)
    assert (decontaminate.within(prints, item) == (distance <= decontaminate.RADIUS)).all()


def test_matches_sql(same):
    same(queries.QUERIES["op6_decontaminate"], queries.ORACLE_SQL["op6_decontaminate"])
