import math
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.llm import langid, quality, queries
from millrace.llm.samples import bounded, fold


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_folds_are_crc32(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(20000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").otherwise("common"))
    got = bounded(df, "label", "id", 300, 5)
    n = Counter(r.label for r in got.collect())
    assert all(200 < n[x] < 400 for x in ("rare", "common"))
    assert got.exceptAll(bounded(df.repartition(7), "label", "id", 300, 5)).isEmpty()


def test_languages_of_held_out_documents(spark, data, docs):
    got = queries.QUERIES["op9_langid"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 20
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_family_comes_before_language(docs):
    model = langid.fit(docs)
    assert model.families == ["germanic", "romance"] and model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert model.of_families[1].shape == (1, langid.DIMS + 1) and all(m.shape == (1, langid.DIMS + 1) for _, m in model.of_langs.values())


def plain_language(text, model, dims):
    """Votes counted in plain Python: families first, then the languages of the one that wins."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    folded = [32 if b < 128 and not chr(b).isalpha() else ord(chr(b).lower()) if b < 128 else b for b in text.encode()]
    folded += [32] * (4 - len(folded))
    counts = [0] * dims
    for i in range(len(folded) - 3):
        three = folded[i] | folded[i + 1] << 8 | folded[i + 2] << 16
        counts[(three * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        counts[((three | folded[i + 3] << 24) * 0x85EBCA6B & 0xFFFFFFFF) >> 20] += 1
    x = [c**0.5 for c in counts]
    norm = sum(v * v for v in x) ** 0.5
    on = [(i, v / norm) for i, v in enumerate(x) if v]

    def vote(names, machines):
        votes, margins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        pairs = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :]]
        for (a, b), w in zip(pairs, machines, strict=True):
            m = sum(float(w[i]) * v for i, v in on) + float(w[-1])
            p = 1 / (1 + np.exp(-4 * min(max(m, -5), 5)))
            votes[a if m >= 0 else b] += 1
            margins[a] += m
            margins[b] -= m
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(names, key=lambda n: (votes[n], margins[n]))
        return best, least[best]

    family, sure = vote(*model.of_families)
    lang, surer = vote(*model.of_langs[family])
    return lang, sure * surer


def test_votes_by_brute_force(spark):
    """Families of three, two and one languages: every prediction against a plain count of votes."""
    rng = np.random.default_rng(8)
    langs = ["en", "de", "nl", "fr", "es", "fi"]
    words = {a: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöé"), rng.integers(2, 7))) for _ in range(25)] for a in langs}
    shared = [w for a in langs for w in words[a][:6]]
    text = lambda a, n: " ".join(str(rng.choice(words[a] + shared)) for _ in range(n))
    rows = [(i, text(a := langs[i % 6], 30), a) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.members == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "uralic": ["fi"]}
    assert [len(m) for _, m in model.of_langs.values()] == [3, 1, 0] and len(model.of_families[1]) == 3
    texts = [(i, text(langs[i % 6], int(rng.integers(1, 12)))) for i in range(120)] + [(500, "x"), (501, "?!"), (502, ""), (503, None), (504, "é")]
    got = langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    for r in got:
        lang, score = plain_language(dict(texts)[r.doc_id], model, langid.DIMS)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-4))
    assert len({r.lang_pred for r in got}) == 7


def test_language_edge_cases(spark, docs):
    model = langid.fit(docs)
    rows = [(1, None), (2, ""), (3, "12 .. 34"), (4, "x"), (5, "the and of " * 100000), (6, "日本語"), (None, "the and of")]
    df = spark.createDataFrame([(t, i, "zz") for i, t in rows], "text string, doc_id long, lang string")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert got[5].lang_pred == got[None].lang_pred == "en" and got[6].lang_pred in model.langs
    assert langid.predict(df.limit(0), model).collect() == []
    kept = langid.known_only(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6]


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.fit(df)).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(8)], "doc_id long, text string, lang string")
    assert langid.predict(one, langid.fit(one)).first().lang_pred == "xx"


def test_every_language_is_learned(spark):
    langs = sorted(lang for names in langid.FAMILIES.values() for lang in names)
    assert len(langs) > 32
    words = {lang: [f"{lang}{chr(97 + j)}{lang[::-1]}" for j in range(8)] for lang in langs}
    rows = [(100 * n + i, " ".join(words[lang][(i + j) % 8] for j in range(6)), lang) for n, lang in enumerate(langs) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.langs == langs
    texts = spark.createDataFrame([(n, " ".join(words[lang])) for n, lang in enumerate(langs)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(texts, model).collect()} == dict(enumerate(langs))


def test_quality_of_held_out_documents(spark, data):
    """On the larger table: the smallest has three held-out documents of label 0."""
    data = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = queries.QUERIES["op10_quality"](spark, data)
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) if good and bad else 1
    assert ranked > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_scores_by_brute_force(spark, data, docs):
    """Every score from two plain compressors and the curve."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(docs, labels)
    good, bad = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_dict_id=False) for x in (model.good, model.bad))
    got = {r.doc_id: r for r in quality.scores(docs, model, 0.3).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        a, b = len(good.compress(r.text.encode())), len(bad.compress(r.text.encode()))
        score = 1 / (1 + math.exp(-(model.slope * (b - a) / math.sqrt(len(r.text.encode()) + quality.SHORT) + model.offset)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].predicted == (score >= 0.3)


def test_what_is_learned_does_not_depend_on_files(spark, data, docs):
    """Also where the bound on bytes leaves rows out."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert quality.fit(docs, labels, max_bytes=40_000) == quality.fit(docs.repartition(5), labels, max_bytes=40_000)


def test_quality_edge_cases(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choice(words, 60)) if i % 2 else " ".join(w + "!!" for w in rng.choice(words, 60)).upper()) for i in range(300)]
    df = spark.createDataFrame([*texts, (1000, None), (1001, ""), (1002, "word1 word2 " * 40000), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i, _ in texts], (None, 1, 0), (1, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scores(df, quality.fit(df, labels)).collect()}
    assert len(got) == 304 and got[1000].score == got[1001].score
    held = [r for i, r in got.items() if i is not None and i < 300 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    assert quality.scores(df.limit(0), quality.fit(df, labels)).collect() == []


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(i, 1, 0) for i in range(9)], 0.999)])
def test_quality_without_both_labels(spark, labels, score):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {round(r.score, 3) for r in quality.scores(df, quality.fit(df, table)).collect()} == {score}
