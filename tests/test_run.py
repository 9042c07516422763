"""What a run does: counts, materialisation, control, policies, increments, deliveries, previews."""

import json

import pytest

from millrace.model import pipeline
from millrace.params import MASK, Resolver
from millrace.plans import RunFailed, preview, run
from millrace.plans.run import frames
from millrace.registry import component, load, opt
from millrace.state import StateError, Store
from millrace.streaming.incremental import increment

ORDERS = """order_id,customer_id,order_ts,amount,status
1,C1,2025-12-30 09:00:00,10.5,shipped
2,C2,2026-01-04 10:05:00,20,pending
3,C1,2026-01-05 11:00:00,30,shipped
4,C9,2026-01-06 12:00:00,40,returned
"""
load()
TRIES = []


@component("xf.test_flaky", {"fail": opt("integer", 0)})
def flaky(step):
    TRIES.append(step.id)
    if len(TRIES) <= step["fail"]:
        raise RuntimeError(f"try {len(TRIES)} fails")
    return step.df


@component("snk.test_far", {"fail": opt("bool", False)}, deferred=True)
def far(step):
    def run(df):
        if step["fail"]:
            raise RuntimeError("the other side says no")
        TRIES.append(sorted(r[0] for r in df.collect()))
        return df.count()

    return run


@pytest.fixture
def orders(tmp_path):
    TRIES.clear()
    (tmp_path / "orders.csv").write_text(ORDERS)
    (tmp_path / "customers.csv").write_text("customer_id;name\nC1;Ann\nC2;Bob\n")
    return ("orders", "src.file.csv", {"path": str(tmp_path / "orders.csv")})


def status(report):
    return {s.id: s.status for s in report.stages}


def test_counts_of_every_stage(spark, orders, tmp_path):
    doc = pipeline(
        orders, ("customers", "src.file.csv", {"path": str(tmp_path / "customers.csv")}), ("recent", "xf.filter", {"predicate": "order_ts >= '2026-01-01'"}, "orders"),
        ("joined", "xf.join", {"keys": ["customer_id"]}, {"left": "recent", "right": "customers"}), ("w", "snk.file.parquet", {"path": str(tmp_path / "deep" / "out.parquet")}),
    )
    report = run(spark, doc, counts="all")
    assert [s.rows for s in report.stages] == [{"main": 4}, {"main": 2}, {"main": 3}, {"main": 2}, {"in": 2}]
    assert spark.read.parquet(str(tmp_path / "deep" / "out.parquet")).columns == ["customer_id", "order_id", "order_ts", "amount", "status", "name"]
    assert run(spark, doc).stage("w").rows == {"in": 2}
    assert (tmp_path / "deep" / "out.parquet").is_file()


@pytest.mark.parametrize("how", ["auto", "view", "memory", "disk", "nonsense"])
def test_every_way_to_materialize_gives_the_same_rows(spark, orders, how):
    doc = pipeline(orders, ("f", "xf.filter", {"predicate": "amount > 15"}, None, {"materialize": how}), ("s", "xf.select", {"columns": ["order_id"]}))
    rows, columns, more = preview(spark, doc, "s")
    assert ([r["order_id"] for r in rows], columns, more) == ([2, 3, 4], ["order_id"], False)


def test_accepted_and_rejected_partition_the_input(spark, orders):
    checks = {"qa.not_null": {"columns": ["status"]}, "qa.unique": {"columns": ["customer_id"]}, "qa.range": {"column": "amount", "min": "20", "max": "30"}, "qa.regex": {"column": "customer_id", "pattern": "^C[12]$"}, "qa.accepted_values": {"column": "status", "values": ["shipped"]}, "qa.expression": {"predicate": "amount > 15"}}
    want = {"qa.not_null": (4, 0), "qa.unique": (2, 2), "qa.range": (2, 2), "qa.regex": (3, 1), "qa.accepted_values": (2, 2), "qa.expression": (3, 1)}
    for name, props in checks.items():
        got = frames(spark, pipeline(orders, ("q", name, props)))
        assert (got["q"].count(), got["q.rejected"].count()) == want[name], name


def test_sql_reads_aliases_and_rejected_rows(spark, orders):
    doc = pipeline((*orders, None, {"alias": "all orders"}), ("q", "qa.range", {"column": "amount", "min": "20"}), ("s", "xf.sql", {"query": 'SELECT count(*) AS n FROM q__rejected JOIN "all orders" USING (order_id)'}, "q.rejected"))
    assert frames(spark, doc)["s"].first().n == 1


def test_branches(spark, orders, tmp_path):
    taken, not_taken = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    doc = pipeline(orders, ("yes", "ctl.branch", {"predicate": "amount > 35"}), ("w", "snk.file.csv", {"path": taken}), ("no", "ctl.branch", {"predicate": "amount > 99"}, "orders"), ("d", "xf.distinct", {}), ("w2", "snk.file.csv", {"path": not_taken}))
    report = run(spark, doc)
    assert report.ok and status(report) == {"orders": "ok", "yes": "ok", "w": "ok", "no": "ok", "d": "not_taken", "w2": "not_taken"}
    assert not (tmp_path / "b.csv").exists()


def test_assertions_and_failures(spark, orders):
    for step, message in [(("x", "ctl.fail", {"when": "amount > 25", "message": "too much"}), r"too much \(2 rows\)"), (("x", "ctl.fail", {"message": "always"}), "always"), (("x", "qa.row_count", {"max": 3}), "4 rows, outside - to 3"), (("x", "qa.schema_match", {"columns": ["no"]}), "no column no"), (("x", "xf.select", {"columns": ["no"]}), "no column no")]:
        with pytest.raises(RunFailed, match=message):
            run(spark, pipeline(orders, step))
    report = run(spark, pipeline(orders, ("l", "ctl.log", {"message": "hello"}), ("f", "ctl.fail", {"when": "amount > 99", "message": "x"})))
    assert report.stage("l").notes == ["hello"]


def test_retries(spark, orders):
    policy = {"policy": {"retryAttempts": 2, "retryBackoffMs": 1}}
    assert run(spark, pipeline(orders, ("x", "xf.test_flaky", {"fail": 2}, None, policy))).stage("x").attempts == 3
    TRIES.clear()
    with pytest.raises(RunFailed, match="try 3 fails"):
        run(spark, pipeline(orders, ("x", "xf.test_flaky", {"fail": 3}, None, policy)))


def test_a_run_that_goes_on_withholds_its_deliveries(spark, orders, tmp_path):
    doc = pipeline(orders, ("bad", "xf.test_flaky", {"fail": 9}, None, {"policy": {"continueOnFailure": True}}), ("lost", "snk.file.csv", {"path": str(tmp_path / "l.csv")}), ("w", "snk.file.csv", {"path": str(tmp_path / "w.csv")}, "orders"), ("far", "snk.test_far", {}, "orders"), name="p")
    store = Store(tmp_path)
    report = run(spark, doc, store=store)
    assert not report.ok
    assert status(report) == {"orders": "ok", "bad": "failed", "lost": "skipped", "w": "ok", "far": "withheld"}
    assert store.load("p") == {} and store.runs("p")[0]["ok"] is False


def test_deliveries_come_last(spark, orders, tmp_path):
    doc = pipeline(orders, ("far", "snk.test_far", {}), ("w", "snk.file.csv", {"path": str(tmp_path / "w.csv")}, "orders"))
    assert run(spark, doc).stage("far").rows == {"in": 4} and TRIES == [[1, 2, 3, 4]]
    with pytest.raises(RunFailed, match="says no"):
        run(spark, pipeline(orders, ("far", "snk.test_far", {"fail": True})))


def test_increments(spark, orders, tmp_path):
    store, doc = Store(tmp_path), pipeline((*orders, None, {"incremental": {"column": "order_ts", "start": "2026-01-01"}}), ("far", "snk.test_far", {}), name="inc")
    report = run(spark, doc, store=store)
    assert report.marks == {"orders": "2026-01-06 12:00:00"} and TRIES.pop() == [2, 3, 4]
    assert run(spark, doc, store=store).marks == report.marks and TRIES.pop() == []
    with (tmp_path / "orders.csv").open("a") as f:
        f.write("5,C1,2026-01-06 12:00:00,1,shipped\n6,C1,2026-01-07 00:00:00,1,shipped\n")
    bad = pipeline((*orders, None, {"incremental": {"column": "order_ts"}}), ("far", "snk.test_far", {"fail": True}), name="inc")
    with pytest.raises(RunFailed):
        run(spark, bad, store=store)
    assert store.load("inc")["orders"]["position"] == "2026-01-06 12:00:00"  # nothing was delivered, so nothing moves
    assert run(spark, doc, store=store).marks == {"orders": "2026-01-07 00:00:00"} and TRIES.pop() == [6]
    assert [r["ok"] for r in store.runs("inc")] == [True, True, False, True]
    store.prune("inc", 1)
    store.reset("inc")
    assert len(store.runs("inc")) == 1 and store.load("inc") == {}


def test_rows_that_arrive_during_a_run_are_read_by_the_next(spark, tmp_path, monkeypatch):
    """Between a sink's delivery and the mark, and between two sinks, rows arrive in a view of a database."""
    import sqlite3

    path = str(tmp_path / "live.db")
    con = sqlite3.connect(path, isolation_level=None)
    con.execute("CREATE TABLE t (id INTEGER, at INTEGER)")
    con.execute("CREATE VIEW v AS SELECT * FROM t")
    new = iter(range(1000))

    def arrive(n=5):
        for _ in range(n):
            i = next(new)
            con.execute("INSERT INTO t VALUES (?, ?)", (i, 100 + i))

    arrive()
    from millrace.streaming.incremental import Marks

    plain = Marks.new
    monkeypatch.setattr(Marks, "new", lambda self: (arrive(3), plain(self))[1])
    store = Store(tmp_path)
    doc = pipeline(
        ("v", "src.db.sqlite", {"connection": path, "table": "v"}, None, {"incremental": {"column": "at"}}),
        ("a", "snk.test_far", {}, "v"), ("b", "snk.test_far", {}, "v"), name="live",
    )
    got = []
    for _ in range(3):
        TRIES.clear()
        run(spark, doc, store=store)
        assert len(TRIES) == 2 and sorted(TRIES[0]) == sorted(TRIES[1])
        got += TRIES[0]
    assert sorted(got) == list(range(11)) and con.execute("SELECT count(*) FROM t").fetchone() == (14,)
    con.close()


def test_state_files(tmp_path):
    store = Store(tmp_path)
    path = tmp_path / ".etl" / "state" / "p.json"
    path.parent.mkdir(parents=True)
    for text, message in (("{", "damaged"), ('{"version": 9, "nodes": {}}', "newer")):
        path.write_text(text)
        with pytest.raises(StateError, match=message):
            store.load("p")


def test_existing_files_are_refused_before_they_are_replaced(spark, orders, tmp_path):
    out = tmp_path / "o.csv"
    out.write_text("precious")
    with pytest.raises(RunFailed, match="exists"):
        run(spark, pipeline(orders, ("w", "snk.file.csv", {"path": str(out), "mode": "error_if_exists"})))
    assert out.read_text() == "precious"


def test_secrets_do_not_reach_the_report(spark, tmp_path):
    doc = pipeline(("a", "src.file.csv", {"path": "/no/${SECRET:where}/x.csv"}))
    with pytest.raises(RunFailed) as e:
        run(spark, doc, resolver=Resolver(secrets={"where": "hidden-place"}.get))
    assert "hidden-place" not in str(e.value) and MASK in str(e.value)


def test_previews_end_early(spark, orders):
    rows, columns, more = preview(spark, pipeline(orders, ("w", "snk.file.csv", {"path": "/nowhere"})), "orders", 2)
    assert len(rows) == 2 and more and columns[0] == "order_id"
    assert preview(spark, pipeline(orders, ("f", "xf.filter", {"predicate": "false"})), "f")[:2] == ([], ["order_id", "customer_id", "order_ts", "amount", "status"])


def test_streams_in_increments(spark, tmp_path):
    seen, source = [], tmp_path / "in"
    source.mkdir()
    stream = lambda: spark.readStream.schema("k int").json(str(source))
    sink = lambda df, n: seen.append(sorted(r.k for r in df.collect()))
    for k in (1, 2):
        (source / f"{k}.json").write_text(json.dumps({"k": k}))
        increment(spark, stream(), str(tmp_path / "ck"), sink)
    assert seen == [[1], [2]]
