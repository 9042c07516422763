import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(marked):
    return (np.frombuffer(marked, "<u4") & np.uint32(0x7FFFFFFF)).tolist()


ENCODER = packing.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZéÉßçñ .,!?'’\"\n\t\x0b\x1c\x85  ́İΣσK中。1234_-<|>&"), max_size=40) | st.text(max_size=30))
def test_ids_are_those_of_the_whole_text(plain, text):
    assert ids_of(ENCODER.marked(text.encode())) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a<|EndOfText|>b", "It's WE'LL done.", "é ́x Å", "", " \n", "x" * 5000, "a. " * 500_000])
def test_ids_of_odd_texts(plain, text):
    assert ids_of(ENCODER.marked(text.encode())) == plain.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_and_learned_again(plain):
    encoder = packing.Encoder(PATH, most_bytes=4000)
    words = [f"w{a}{b}." for a in "abcdefghij" for b in "klmnopqrst"]
    for _ in range(3):
        for w in words:
            assert ids_of(encoder.marked(w.encode())) == plain.encode(w, add_special_tokens=False).ids
    assert len(encoder.known) + len(encoder.old) < len(words)


def least_cost(at, penalty, length):
    """By trying every start for every end."""
    cost = [0.0]
    for i in range(1, len(at)):
        tried = [cost[j] + (0 if (n := at[i] - at[j]) & (n - 1) == 0 else length - n) for j in range(i) if at[i] - at[j] <= length]
        cost.append(min(tried) + penalty[i] + packing.EACH)
    return cost[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    length = rng.choice([8, 64, 100])
    n = rng.randrange(1, 600)
    docs = sorted({*(rng.randrange(1, n + 1) for _ in range(n // 20)), n})
    sentences = sorted({rng.randrange(1, n + 1) for _ in range(n // 7)})
    at, penalty = packing.places(np.array(sentences, int), np.array(docs), n, length, last=True)
    assert at[0] == 0 and at[-1] == n and np.diff(at).max() <= max(packing.STEP, 1)
    if np.diff(at).max() > length:
        return
    cost, back = packing.ways(at, penalty, length)
    assert cost[-1] == least_cost(at.tolist(), penalty.tolist(), length)
    cuts = [0, *(int(at[i]) for i in packing.traced(back, len(at) - 1))]
    paid = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    assert math.isclose(cost[-1], sum(paid[b] + packing.EACH + (0 if (b - a) & (b - a - 1) == 0 else length - b + a) for a, b in zip(cuts, cuts[1:], strict=False)))
    last = int(np.searchsorted(at, at[-1] - length))
    ends = [{0, *packing.traced(back, i)} for i in range(last, len(at))]
    assert packing.common(back, last) == max(set.intersection(*ends))


def test_blocks_are_cut_as_the_whole_stream(monkeypatch):
    rng = random.Random(4)
    docs = [(i, np.array([rng.randrange(2, 40_000) | (1 << 31 if rng.random() < 0.1 else 0) for _ in range(rng.randrange(0, 900))], "<u4").tobytes()) for i in range(200)]

    def cut(block):
        monkeypatch.setattr(packing, "BLOCK", block)
        stream, out = packing.Stream(2048, 1), []
        for d, marked in docs:
            stream.add(d, marked)
            if stream.waiting >= stream.next:
                out += stream.cut()
        return out + list(stream.cut(last=True))

    assert cut(6000) == cut(1 << 30)


def check(rows, texts, plain, length=2048):
    """All that a packing promises; returns its padding over its tokens."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, text in texts.items():
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        total += at
    return padding / total


def test_query(spark, data, plain):
    rows = queries.QUERIES["op11_packing"](spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert check(rows, texts, plain) < 0.01


def test_edge_cases(spark, plain):
    schema = "doc_id long, text string, start string, ids string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).collect() == []
    texts = {1: None, 2: "", 3: "One. Two!", 4: "no end of a sentence " * 4000, 5: "a", 6: "a"}
    rows = spark.createDataFrame([(d, t, "x", "y") for d, t in texts.items()], schema).coalesce(1)
    assert check(packing.pack(rows, PATH).withColumn("ids_crc32", F.crc32("ids")).collect(), texts, plain) < 0.01
    twice = spark.createDataFrame([(None, "a", "", ""), (7, "b c", "", ""), (7, "b c", "", "")], schema).coalesce(1)
    got = packing.pack(twice, PATH, length=4).orderBy("sequence_id", "offset").collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in got if r.doc_id is None] == [(None, 0, 2, 2)]
    assert sum(r.length for r in got) == 8 and all(len(r.ids) == 4 * r.length for r in got)
