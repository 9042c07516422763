"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
import test_decontaminate
import test_minhash
import test_mixing
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, queries


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """(docs, result) of every stage, each written and read again."""
    out, docs = [], spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, data).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    for _, after in stages[:-1]:
        assert sorted(after.columns) == sorted(COLUMNS)
    assert set(COLUMNS) < set(stages[-1][1].columns)


def test_language(stages):
    before, after = stages[0]
    model = langid.fit(before)
    want = {i for i, t in texts(before) if model.predict(t.encode())[1] > pipeline.LEAST_SURE}
    assert {i for i, _ in texts(after)} == want
    assert len(want) > 0.98 * before.count()


def test_near_duplicates(stages):
    before, after = stages[1]
    components = test_minhash.brute(texts(before), 5, 80)
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, (_, c) in components.items() if i == c)
    assert after.count() < before.count()


def test_decontaminated(spark, stages, data):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    grams = {g for _, t in items for w in [t.lower().split()] for g in zip(*(w[i:] for i in range(5)), strict=False)}
    near = [(i, t) for i, t in texts(before) if grams & set(zip(*(t.lower().split()[j:] for j in range(5)), strict=False))]
    leaking = {d for d, _ in test_decontaminate.brute(near, items)}
    assert {i for i, _ in texts(after)} == {i for i, _ in texts(before)} - leaking
    assert leaking


def test_mixed(stages):
    before, after = stages[3]
    sizes = Counter()
    for r in before.collect():
        sizes[r.source] += len(r.text.split())
    want = test_mixing.water(sizes)
    copies = Counter(i for i, _ in texts(after))
    taken = Counter()
    for r in before.collect():
        n, rate = copies[r.doc_id], want[r.source] / sizes[r.source]
        assert int(rate) <= n <= int(rate) + 1
        taken[r.source] += n * len(r.text.split())
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.2)


def test_sharded(stages):
    before, after = stages[4]
    assert Counter(texts(before)) == Counter(texts(after))
    assert after.where(F.col("shard").isNull()).isEmpty()


def test_run(spark, data, stages):
    got = pipeline.run(spark, data)
    assert Counter(texts(got)) == Counter(texts(stages[-1][1]))


def test_words_of_the_mixture(spark):
    assert spark.range(1).select(mixing.n_words(F.lit("a\x0bb c d"))).first()[0] == 3


CLASHES = "row size source_size target n_copies copy of words doc item item_id hash gram arrival shard component_id kept digest bands id c key n component language score flag rate".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns of the stages' own names."""
    prose = [" ".join(f"{w}{i}" for w in ("the", "house", "stands", "near", "water", "and", "under", "trees")) for i in range(12)]
    autre = [" ".join(f"{w}{i}" for w in ("une", "maison", "est", "devant", "nous", "avec", "des", "fleurs")) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)] + [(100 + i, t, "fr", None, len(t)) for i, t in enumerate(autre)]
    rows += [(None, prose[0] + " more", None, None, None), (200, None, "en", "s1", 0), (201, "", "en", "s1", 0), (202, " \t ", None, "s2", 3), (203, "42 - 17", "fr", "s0", 7), (204, "the house stands near water " * 20000, "en", "s0", 1)]
    rows += [rows[3], rows[3], (3, "another text of the same id", "en", "s0", 1), (205, prose[5], "en", "s2", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"my {n}").alias(n) for n in CLASHES]).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows_and_columns(spark, data, odd, name):
    out = dict(pipeline.STAGES)[name](spark, odd, data)
    assert out.columns[: len(odd.columns)] == odd.columns and (name == "shard" or out.columns == odd.columns)
    got, before = out.collect(), odd.collect()
    assert all(r[n] == f"my {n}" for r in got for n in CLASHES)
    key = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    have, given = Counter(map(key, got)), Counter(map(key, before))
    assert set(have) <= set(given)
    if name == "language":
        assert not {200, 201, 202, 203} & {r.doc_id for r in got} and {None, 3, 204, 100} <= {r.doc_id for r in got}
        assert all(have[k] == given[k] for k in have)
    elif name == "near_duplicates":
        assert {i: n for i, n in Counter(r.doc_id for r in got).items() if i in (None, 200, 201, 202)} == {None: 1, 200: 1, 201: 1, 202: 1}
        assert 205 not in {r.doc_id for r in got} and Counter(r.doc_id for r in got)[3] == 4
    elif name in ("decontaminate", "shard"):
        assert have == given
    else:
        assert all(n <= 3 * given[k] for k, n in have.items()) and len({have[k] // given[k] for k in given if k[0] == 3 and k[3] == "s0"}) == 1
        assert 204 in {r.doc_id for r in got} or sum(have.values()) > 0


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_an_empty_table(spark, data, odd, name):
    out = dict(pipeline.STAGES)[name](spark, odd.limit(0), data)
    assert out.count() == 0 and out.columns[: len(odd.columns)] == odd.columns


def test_queries_on_empty_tables(spark, data, tmp_path):
    """The whole pipeline and each numbered query over tables without rows."""
    for table in ("documents", "benchmark", "labels", "pages", "conversations"):
        spark.read.parquet(f"{data}/{table}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op3_chat" else 0), name
