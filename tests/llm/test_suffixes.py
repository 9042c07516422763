import hashlib

import numpy as np
import pytest

from millrace.llm import queries, suffixes
from millrace.llm.scratch import Scratch


def brute(rows, width=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        cover = np.zeros(len(t) + 1, np.int32)
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            if w in seen:
                cover[p] += 1
                cover[p + width] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def result(spark, rows, **more):
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, block string").repartition(3)
    out = suffixes.remove_repeats(df, Scratch(spark), **more).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)


def corpus(seed, n=40):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words, k))
    passage, line = prose(60), prose(30)
    rows = []
    for i in range(n):
        parts = [prose(rng.integers(1, 80))]
        if i % 3 == 0:
            parts.insert(rng.integers(0, 2), passage[rng.integers(0, 60) :])
        if i % 2 == 0:
            parts.append(line)
        rows.append((i, " ".join(parts)))
    rows += [(n + 1, rows[4][1]), (n + 2, rows[4][1] + "!"), (n + 3, "ab" * 300), (n + 4, "a" * 700), (n + 5, ""), (n + 6, None), (n + 7, "short"), (n + 8, "a" * 100), (n + 9, "a" * 99)]
    return rows


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_brute_force(spark, hot):
    rows = corpus(hot)
    assert result(spark, rows, hot=hot) == brute(rows)


def test_wider_windows(spark):
    rows = corpus(9)
    assert result(spark, rows, width=130) == brute(rows, 130)
    with pytest.raises(ValueError, match="at least"):
        result(spark, rows, width=50)


def test_long_text_over_many_steps(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 150000))
    rows = [(1, text), (2, text[70000:70300] + "zz" + text[65400:65700]), (3, text[::-1])]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_repeated_ids(spark):
    assert result(spark, []) == []
    text = "x".join(str(i) for i in range(60))
    assert [r[2] for r in result(spark, [(1, text), (1, text)])] == [0, len(text)]


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.MODULUS))


def test_ties_of_heads_and_tails_are_told_apart():
    """Windows equal in their first and last bytes but not between."""
    a, b = b"h" * 40 + b"1" + b"t" * 59, b"h" * 40 + b"2" + b"t" * 59
    text = np.frombuffer(b"".join([a, b"\0", b, b"\0\0", a, b"\0", b]) + bytes(100), np.uint8)
    place = np.array([0, 101, 203, 304])
    order, equal = suffixes.sorted_suffixes(text, place, 100)
    assert order.tolist() == [0, 2, 1, 3] and equal.tolist() == [False, True, False, True]


def test_matches_sql(same):
    same(queries.QUERIES["op8_suffixes"], queries.ORACLE_SQL["op8_suffixes"])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("width", [100, 117])
def test_a_bucket_is_in_order_of_its_suffixes(seed, width):
    """All starts, few letters and long ties, so that suffixes of many residues tie."""
    rng = np.random.default_rng(seed)
    unit = rng.integers(0, 2 + seed % 3, int(rng.integers(1, 200)), dtype=np.uint8)
    parts = [np.tile(unit, 3), rng.integers(0, 3, 300, dtype=np.uint8), np.tile(unit, 2), np.zeros(150, np.uint8), unit]
    text = np.concatenate((*parts, np.zeros(width + 8, np.uint8)))
    starts = rng.permutation(len(text) - width - 8)[: int(rng.integers(1, 900))]
    raw = text.tobytes()
    want = sorted(range(len(starts)), key=lambda i: raw[starts[i] : starts[i] + width])
    order, equal = suffixes.sorted_suffixes(text, starts, width)
    suffix = lambda i: raw[starts[i] : starts[i] + width]
    assert [suffix(i) for i in order.tolist()] == [suffix(i) for i in want]
    same = [False] + [suffix(a) == suffix(b) for a, b in zip(want, want[1:], strict=False)]
    assert equal.tolist() == same


def test_ranks_are_made_before_and_settle_ties():
    text = np.concatenate([np.tile(np.arange(50, dtype=np.uint8), 20), np.zeros(108, np.uint8)])
    starts = np.arange(0, 900, 7)
    ranks = suffixes.Ranks(text, starts, 100)
    raw = text.tobytes()
    for a, b in zip(starts.tolist(), starts[::-1].tolist(), strict=True):
        if raw[a : a + 32] == raw[b : b + 32]:
            x, y = raw[a : a + 100], raw[b : b + 100]
            assert ranks.compare(np.array([a]), np.array([b]))[0] == (x > y) - (x < y)


def test_hot_windows_are_settled_a_batch_at_a_time(monkeypatch):
    """The earliest of equal windows stays whatever the order in which blocks come."""
    rng = np.random.default_rng(2)
    windows = [rng.integers(97, 99, 100, dtype=np.uint8).tobytes() for _ in range(5)]
    windows.append(windows[0][:60] + b"!" + windows[0][61:])
    rows = [(d, int(rng.integers(0, 6))) for d in rng.permutation(200).tolist()]
    blobs = []
    for d, w in rows:
        r = np.zeros(1, suffixes._RECORD)
        r["doc"], r["block"], r["windows"], r["hash"] = d, d, 1, w
        blobs.append(suffixes._squeeze((1).to_bytes(8, "little") + r.tobytes() + windows[w]))
    monkeypatch.setattr(suffixes, "SORT_BYTES", 1000)
    gone = sorted(int(b) for blocks, _ in suffixes._settled_hot(blobs, 100) for b in blocks)
    first = {w: min(d for d, x in rows if x == w) for w in range(6)}
    assert gone == sorted(d for d, w in rows if d != first[w])


def test_repeated_ids_have_one_order(spark):
    """Rows of the same id are told apart by their texts, not by where the scan finds them."""
    passage = "the same passage in several documents, well over a hundred bytes long so that it is removed from all but one of them. "
    rows = [(7, passage + "one"), (7, passage + "two"), (7, passage + "three"), (None, passage), (7, passage + "one")]
    found = [result(spark, [rows[i] for i in order]) if None not in [rows[i][0] for i in order] else None for order in ([0, 1, 2, 4], [4, 2, 1, 0], [1, 0, 4, 2])]
    assert found[0] == found[1] == found[2] and sum(r[2] == 0 for r in found[0]) == 1


def test_a_passage_in_over_a_thousand_documents_is_not_sent_by_windows(spark):
    """Window by window it takes 30 times the bytes, and ever more of a growing corpus is passed by a low bound."""
    passage = " ".join(hashlib.sha256(bytes([i])).hexdigest()[:7] for i in range(20))
    rows = [(i, f"{i:05d} {passage} {i * 7:06d}") for i in range(1200)]
    kinds = []

    class Watched(Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            if name == "contents":
                kinds.extend(r.kind for r in out.select("kind").collect())
            return out

    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(3)
    got = suffixes.remove_repeats(df, Watched(spark)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == brute(rows)
    assert 1 in kinds and 2 not in kinds
