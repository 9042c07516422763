"""Documents, components and parameters: nothing here needs Spark."""

import json

import pytest

from millrace.model import Pipeline, PipelineError, pipeline
from millrace.params import MASK, ParameterError, Resolver, load_contexts, resolve
from millrace.plans.compile import compile_pipeline, preview_plan
from millrace.plans.lineage import lineage, public
from millrace.registry import InvalidProperty, json_schema, load, manifest

SRC = ("a", "src.file.csv", {"path": "a.csv"})


def plan(*steps, **more):
    return compile_pipeline(pipeline(*steps, **more))


def test_unknown_keys_are_kept_at_every_level():
    raw = {"formatVersion": 1, "nodes": [{"id": "a", "position": {"x": 1, "y": 2}, "odd": 1, "data": {"label": "A", "componentId": "src.file.csv", "properties": {"path": "x"}, "more": [1]}}], "edges": [], "later": {"k": 1}}
    assert Pipeline.of(raw).to_dict() == raw


def test_an_older_document_is_not_given_a_version():
    assert "formatVersion" not in Pipeline.of({"nodes": []}).to_dict()
    with pytest.raises(PipelineError, match="newer"):
        Pipeline.of({"formatVersion": 2, "nodes": []})


def test_components():
    known = {k: v for k, v in load().items() if ".test_" not in k}  # other tests register their own
    count = {k: sum(x.startswith(k) for x in known) for k in ("xf.", "qa.", "ctl.")}
    assert count == {"xf.": 25, "qa.": 9, "ctl.": 5}
    for c in known.values():
        for name, p in c.props.items():
            assert not (p.required and p.default is not None), (c.id, name)
            if p.default is not None and p.kind != "strings":
                p.check("n", name, p.default)
    assert {m["id"] for m in manifest()} >= set(known) and len(known) == 88
    json.dumps(json_schema())


def test_defaults_and_checks():
    assert plan(SRC).stages[0].props == {"path": "a.csv", "header": True, "delimiter": None, "multiline": False}
    assert plan(("a", "src.file.csv", {"path": "x", "header": None})).stages[0].props["header"] is True
    with pytest.raises(InvalidProperty, match="is required"):
        plan(("a", "src.file.csv", {}))
    with pytest.raises(InvalidProperty, match="blank"):
        plan(("a", "src.file.csv", {"path": " "}))
    with pytest.raises(InvalidProperty, match="no option"):
        plan(SRC, ("j", "snk.file.parquet", {"path": "x", "mode": "maybe"}))
    assert "has no property 'colour'" in plan(("a", "src.file.csv", {"path": "x", "colour": "red"})).warnings[0]


@pytest.mark.parametrize(
    ("steps", "message"),
    [
        ([], "no nodes"),
        ([SRC, SRC], "two nodes"),
        ([("x__rejected", "src.file.csv", {"path": "p"})], "taken"),
        ([("x", "src.nowhere", {})], "no component"),
        ([("x", "zz.a", {}, None)], "namespace"),
        ([SRC, ("f", "xf.filter", {"predicate": "true"}, "a.other")], "no output"),
        ([SRC, ("f", "xf.filter", {"predicate": "true"}, ["a", "a"])], "takes 1 input"),
        ([SRC, ("u", "xf.union", {})], "two inputs"),
        ([SRC, ("j", "xf.join", {"keys": ["k"], "condition": "x"}, ["a", "a"])], "either"),
        ([SRC, ("j", "xf.join", {"type": "cross", "keys": ["k"]}, ["a", "a"])], "mean nothing"),
        ([SRC, ("r", "qa.range", {"column": "c"})], "give a minimum"),
        ([SRC, ("c", "xf.ai.chunk", {"column": "t", "size": 5, "overlap": 5})], "smaller than size"),
        ([SRC, ("c", "xf.ai.redact", {"columns": ["t"], "kinds": ["iban"]})], "is unknown"),
        ([("s", "src.cloud.s3", {"path": "s3://b/x", "key_id": "k"})], "together"),
    ],
)
def test_refusals(steps, message):
    with pytest.raises(PipelineError, match=message):
        plan(*steps)


def test_order_follows_edges_then_the_document():
    p = plan(("w", "snk.file.csv", {"path": "o"}, "f"), ("f", "xf.filter", {"predicate": "true"}, "a"), ("b", "src.file.csv", {"path": "b"}), SRC)
    assert [s.id for s in p.stages] == ["b", "a", "f", "w"]
    with pytest.raises(PipelineError, match="wait for each other"):
        plan(("x", "xf.distinct", {}, "y"), ("y", "xf.distinct", {}, "x"))


def test_a_query_waits_for_the_nodes_it_names():
    p = plan(SRC, ("q", "xf.sql", {"query": "SELECT * FROM a JOIN late USING (k)"}, "a"), ("b", "src.file.csv", {"path": "b"}, None, {"alias": "late"}))
    assert [s.id for s in p.stages] == ["a", "b", "q"]


def test_join_handles_beat_the_order_of_edges():
    p = plan(SRC, ("b", "src.file.csv", {"path": "b"}), ("j", "xf.join", {"keys": ["k"]}, {"right": "a", "left": "b"}))
    assert p.stages[-1].inputs == [("left", "b", "main"), ("right", "a", "main")]


def test_disabled_nodes_take_their_followers_along():
    p = plan(SRC, ("f", "xf.distinct", {}, "a", {"disabled": True}), ("w", "snk.file.csv", {"path": "o"}), ("w2", "snk.file.csv", {"path": "o"}, "a"))
    assert [s.id for s in p.stages] == ["a", "w2"]
    assert len(p.warnings) == 2


def test_preview_leaves_out_sinks_and_others():
    p = plan(SRC, ("f", "xf.distinct", {}), ("w", "snk.file.csv", {"path": "o"}), ("b", "src.file.csv", {"path": "b"}))
    assert [s.id for s in preview_plan(p, "f").stages] == ["a", "f"]


def test_lineage_without_secrets():
    found = lineage(plan(("a", "src.db.postgres", {"connection": "host=h password=pw dbname=d", "table": "t"}), ("w", "snk.file.csv", {"path": "o"})))
    assert found["edges"] == [{"source": "a", "output": "main", "target": "w", "input": "in"}]
    assert "pw" not in str(found)
    assert public("https://u:p@host/x?key=1") == "https://host/x"


def doc(value, parameters=None, name="path"):
    return pipeline(("a", "src.file.csv", {name: value}), parameters=parameters or {})


def path_of(value, parameters=None, **more):
    return resolve(doc(value, parameters), Resolver(**more)).pipeline.nodes[0].properties["path"]


def test_precedence():
    spec = {"p": {"default": "default"}}
    assert path_of("${p}", spec) == "default"
    assert path_of("${p}", spec, contexts={"dev": {"p": "context"}}, active="dev") == "context"
    assert path_of("${p}", spec, contexts={"dev": {"p": "context"}}, active="dev", explicit={"p": "explicit"}) == "explicit"
    assert path_of("${workspace}/${date}", workspace="/w", today="2026-01-02") == "/w/2026-01-02"
    assert path_of("${dev.p}", contexts={"dev": {"p": "x"}}) == "x"


def test_substitution_is_single_pass():
    assert path_of("${p} $$ $x", explicit={"p": "${ENV:HOME}"}) == "${ENV:HOME} $ $x"


def test_secrets_are_masked():
    r = resolve(doc("${SECRET:key}"), Resolver(secrets={"key": "s3cr3t"}.get))
    assert r.pipeline.nodes[0].properties["path"] == "s3cr3t"
    assert r.mask("failed at s3cr3t") == f"failed at {MASK}"
    assert r.used == {"SECRET:key": MASK}


@pytest.mark.parametrize(
    ("value", "parameters", "explicit", "message"),
    [
        ("${nope}", {}, {}, "node 'a', property 'path': nothing provides 'nope'"),
        ("${open", {}, {}, "never closed"),
        ("${}", {}, {}, "empty"),
        ("${ENV:NO_SUCH_THING}", {}, {}, "environment"),
        ("${SECRET:x}", {}, {}, "no secret store"),
        ("${ctx.x}", {}, {}, "no context"),
        ("x", {"p": {"required": True}}, {}, "is required"),
        ("x", {"p": {"required": True}}, {"p": " "}, "must not be empty"),
        ("x", {"p": {"type": "integer"}}, {"p": "1.5"}, "declared as integer"),
        ("x", {"p": {"type": "date"}}, {"p": "May"}, "declared as date"),
    ],
)
def test_parameter_errors(value, parameters, explicit, message):
    with pytest.raises(ParameterError, match=message.replace("'", ".")):
        resolve(doc(value, parameters), Resolver(explicit=explicit, environment={}))


def test_contexts_file(tmp_path):
    assert load_contexts(tmp_path) == ({}, None)
    (tmp_path / ".etl").mkdir()
    (tmp_path / ".etl" / "contexts.json").write_text('{"active": "dev", "contexts": {"dev": {"out": "x"}, "prod": {"variables": {"out": "y"}}}}')
    assert load_contexts(tmp_path) == ({"dev": {"out": "x"}, "prod": {"out": "y"}}, "dev")
