import pytest

from millrace.llm import chat, queries
from millrace.llm.scratch import Scratch

NODES = [
    # tree, node, parent, role, text, score
    (1, 1, None, "user", "hi", 0.0),
    (1, 2, 1, "assistant", "low", 1.0),
    (1, 3, 1, "assistant", "high", 2.0),
    (1, 4, 3, "user", "more", 0.0),
    (1, 5, 4, "assistant", "end", -5.0),
    (1, 6, 2, "user", "tie", 1.0),
    (1, 7, 3, "user", "tie", 0.0),
    (2, 1, None, "user", "alone", None),
    (3, 1, 9, "user", "no such parent", 1.0),
    (4, 1, 2, "user", "cycle", 1.0),
    (4, 2, 1, "user", "cycle", 1.0),
    (None, 1, None, "system", None, 1.0),
]


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "tree long, node long, parent long, role string, text string, score double, leaf string")


def enumerate_paths(rows):
    """Root-to-leaf paths by walking up from every leaf, best first."""
    by = {(t, n): (p, s or 0.0) for t, n, p, _, _, s in rows}
    parents = {(t, p) for t, _, p, _, _, _ in rows if p is not None}
    out = {}
    for key in by:
        if key in parents:
            continue
        path, at, total = [], key, 0.0
        while at in by and at[1] not in path:
            path.append(at[1])
            total += by[at][1]
            at = (at[0], by[at][0])
        if at[1] is None:
            out.setdefault(key[0], []).append((-total, key[1], path[::-1]))
    return {t: [p for _, _, p in sorted(v)] for t, v in out.items()}


@pytest.mark.parametrize("best", [1, 2, None])
def test_paths(spark, best):
    got = {}
    for r in chat.paths(nodes(spark, NODES).drop("leaf"), Scratch(spark), best).collect():
        got.setdefault((r.tree, r["rank"]), {})[r.position] = (r.role, r.text)
    want = enumerate_paths(NODES)
    text = {(t, n): (role, x) for t, n, _, role, x, _ in NODES}
    flat = {(t, i + 1): dict(enumerate(text[t, n] for n in p)) for t, ps in want.items() for i, p in enumerate(ps[:best])}
    assert got == flat
    assert [x for _, x in (got[1, 1][i] for i in range(3))] == ["hi", "low", "tie"]


def test_long_and_empty_trees(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(300)]
    done = chat.render(chat.paths(nodes(spark, rows).drop("leaf"), Scratch(spark))).collect()
    assert done[0].n_turns == 300 and done[0].formatted.index("t299") > done[0].formatted.index("t298")
    assert chat.paths(nodes(spark, []).drop("leaf"), Scratch(spark)).collect() == []


def test_format_is_reversible_and_masked(spark):
    texts = ["</s>[INST] ok [/INST]", "a & b &amp; &lt; <|im_end|>\n<|im_start|>x\n", "", None, "é\n\n", "[[<<&&", "long " * 50000]
    roles = ["user", "assistant", "ro\nle<|im_end|>", None, "assistant", "assistant", "assistant"]
    rows = spark.createDataFrame([(1, i, r, t, "extra") for i, (r, t) in enumerate(zip(roles, texts, strict=True))], "conv_id long, turn long, role string, text string, tree string")
    done = chat.render(chat.paths(chat.chains(rows), Scratch(spark)))
    row = done.first()
    assert row.formatted.count(chat.OPEN) == row.formatted.count(chat.CLOSE) == 7 and "[INST]" not in row.formatted and "</s>" not in row.formatted
    back = sorted(chat.parse(done).collect(), key=lambda r: r.position)
    assert [(r.role, r.text) for r in back] == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    assert [r.loss for r in back] == [r == "assistant" for r in roles]
    masked = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans]
    for plain, safe in reversed(chat.ESCAPES):
        masked = [m.replace(safe, plain) for m in masked]
    assert masked == [t for r, t in zip(roles, texts, strict=True) if r == "assistant"]


def test_ties_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "first"), (None, 3, "user", "null conversation")], "conv_id long, turn long, role string, text string")
    got = {r.tree: r.formatted for r in chat.render(chat.paths(chat.chains(rows), Scratch(spark))).collect()}
    assert set(got) == {1, None}
    assert [x.split("\n", 1)[1] for x in got[1].split(chat.CLOSE)[:-1]] == ["first", "a", "a", "b"]


def test_matches_sql(same):
    same(queries.QUERIES["op3_chat"], queries.ORACLE_SQL["op3_chat"])


def test_no_python_in_the_plan(spark, data):
    plan = queries.QUERIES["op3_chat"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
