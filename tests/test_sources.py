"""Sources and sinks: files of every format, and APIs against servers in this process."""

import json
import random
import sqlite3
import threading
import urllib.parse
import zipfile
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.model import pipeline
from millrace.plans import RunFailed, run
from millrace.plans.run import frames
from millrace.registry import InvalidProperty
from millrace.sources import apis, brokers, databases, documents, files, lakes
from millrace.sources.documents import column_letters, column_number, xml_records


def read(spark, name, **props):
    return frames(spark, pipeline(("s", name, props)))["s"]


def write(spark, df_sql, name, **props):
    doc = pipeline(("q", "xf.sql", {"query": df_sql}, []), ("w", name, props))
    return run(spark, doc)


ROWS = "SELECT * FROM VALUES (1, 'a,\"b\"', TIMESTAMP_NTZ '2026-01-04 10:05:00', DATE '2026-01-05', CAST(1.5 AS DECIMAL(10,2)), true), (2, NULL, NULL, NULL, NULL, NULL), (3, '', TIMESTAMP_NTZ '2026-01-04 10:05:00.25', DATE '1999-12-31', CAST(-2 AS DECIMAL(10,2)), false) AS t(id, text, at, day, amount, flag)"




def test_csv(spark, tmp_path):
    path = tmp_path / "o.csv"
    assert write(spark, ROWS, "snk.file.csv", path=str(path)).stage("w").rows == {"in": 3}
    assert sorted(path.read_text().splitlines()) == sorted(["id,text,at,day,amount,flag", '1,"a,""b""",2026-01-04 10:05:00,2026-01-05,1.50,true', "2,,,,,", '3,"",2026-01-04 10:05:00.25,1999-12-31,-2.00,false'])
    df = read(spark, "src.file.csv", path=str(path))
    assert dict(df.dtypes) == {"id": "int", "text": "string", "at": "timestamp_ntz", "day": "date", "amount": "double", "flag": "boolean"}
    (tmp_path / "p.txt").write_text("a|b\n1|x,y\n2|z\n")
    assert [tuple(r) for r in read(spark, "src.file.csv", path=str(tmp_path / "p.txt")).collect()] == [(1, "x,y"), (2, "z")]
    assert files.sniff("a;b\n1,5;2\n") == ";" and files.sniff("") == ","
    assert read(spark, "src.file.csv", path=str(tmp_path / "*.txt"), header=False).columns == ["_c0", "_c1"]


@pytest.mark.parametrize("codec", ["zstd", "snappy", "gzip", "lz4", "uncompressed"])
def test_parquet(spark, tmp_path, codec):
    path = tmp_path / "o.parquet"
    write(spark, ROWS, "snk.file.parquet", path=str(path), compression=codec)
    assert path.is_file() and read(spark, "src.file.parquet", path=str(path)).count() == 3
    folder = tmp_path / "many"
    write(spark, ROWS, "snk.file.parquet", path=str(folder), layout="folder")
    assert folder.is_dir() and read(spark, "src.file.parquet", path=str(folder)).count() == 3


def test_json_lines(spark, tmp_path):
    path = tmp_path / "o.jsonl"
    write(spark, ROWS, "snk.file.jsonl", path=str(path))
    lines = {x["id"]: x for x in map(json.loads, path.read_text().splitlines())}
    assert lines[2] == {"id": 2, "text": None, "at": None, "day": None, "amount": None, "flag": None}
    assert lines[1]["at"] == "2026-01-04 10:05:00"
    df = read(spark, "src.file.jsonl", path=str(path))
    assert df.columns == ["id", "text", "at", "day", "amount", "flag"] and dict(df.dtypes)["at"] == "timestamp_ntz" and dict(df.dtypes)["day"] == "date"
    path.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert read(spark, "src.file.jsonl", path=str(path), ignore_errors=True).count() == 2
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILED_READ"):
        read(spark, "src.file.jsonl", path=str(path)).collect()


def test_json_arrays(spark, tmp_path):
    path = tmp_path / "o.json"
    write(spark, ROWS, "snk.file.json", path=str(path))
    assert {x["id"] for x in json.loads(path.read_text())} == {1, 2, 3}
    assert read(spark, "src.file.json", path=str(path)).count() == 3
    write(spark, ROWS + " WHERE id > 9", "snk.file.json", path=str(path))
    assert json.loads(path.read_text()) == []
    path.write_text('{"a": 1}')
    with pytest.raises(InvalidProperty, match="array"):
        read(spark, "src.file.json", path=str(path))


@pytest.mark.parametrize("kind", ["csv", "jsonl", "json", "parquet"])
def test_one_file_is_written_by_several_tasks(spark, tmp_path, kind):
    """The same rows in the same order, one file, with parts that are empty; no task has all rows."""
    rows = "SELECT id, CASE WHEN id % 7 > 0 THEN concat('a \"b\", ', id) END AS t FROM range(0, 40, 1, 5) WHERE id NOT BETWEEN 8 AND 23 AND id < 32"
    taken = []
    whole = files.one_file

    def watched(spark, df, path, write, *join):
        def counted(d, p):
            write(d, p)
            taken.append(len(list(Path(p.removeprefix("file://")).glob("part-*"))))

        return whole(spark, df, path, counted, *join)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(files, "one_file", watched)
        write(spark, rows, f"snk.file.{kind}", path=str(tmp_path / "o"))
    assert (tmp_path / "o").is_file() and taken[0] > 1
    back = read(spark, f"src.file.{kind}", path=str(tmp_path / "o"))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in spark.sql(rows).collect()]
    if kind == "csv":
        assert (tmp_path / "o").read_text().count("id,t") == 1


def test_excel(spark, tmp_path):
    path = tmp_path / "o.xlsx"
    assert write(spark, ROWS, "snk.file.excel", path=str(path), sheet="Data & more").stage("w").rows == {"in": 3}
    got = {r.id: r for r in read(spark, "src.file.excel", path=str(path)).collect()}
    assert got[1].text == 'a,"b"' and str(got[3]["at"]) == "2026-01-04 10:05:00.250000" and got[1].amount == 1.5 and got[3].flag is False
    assert read(spark, "src.file.excel", path=str(path), sheet="Data & more", header=False).columns[:2] == ["A", "B"]
    with pytest.raises(Exception, match="no sheet"):
        read(spark, "src.file.excel", path=str(path), sheet="Other")
    assert [column_number(x) for x in ("A1", "Z9", "AA1", "BC2")] == [0, 25, 26, 54] and column_letters(54) == "BC"


def test_excel_of_more_rows_than_a_sheet_holds(spark, tmp_path, monkeypatch):
    """A folder of workbooks, each with the header; nothing is left out, and one file again if rows are few."""
    monkeypatch.setattr(documents, "SHEET", 8)
    path = tmp_path / "o.xlsx"
    many = "SELECT id, CASE WHEN id % 5 > 0 THEN concat('t', id) END AS t FROM range(0, 100, 1, 3)"
    assert write(spark, many, "snk.file.excel", path=str(path)).stage("w").rows == {"in": 100}
    assert path.is_dir() and len(list(path.glob("*.xlsx"))) >= 15
    assert sorted(r.id for r in read(spark, "src.file.excel", path=str(path)).collect()) == list(range(100))
    for book in path.glob("*.xlsx"):
        assert zipfile.ZipFile(book).testzip() is None and zipfile.ZipFile(book).comment == b"\n"
    for n in (7, 0):
        write(spark, f"{many} WHERE id < {n}", "snk.file.excel", path=str(path))
        assert path.is_file() and len(list(documents.xlsx_records(path.read_bytes(), None, True))) == n


XML = """<?xml version="1.0"?><r xmlns:n="u"><n:o id="1" k="v"><a>x &amp; &#65;<![CDATA[<y>]]></a><b c="7"/></n:o><other/><o id="2"/></r>"""


def test_xml(spark, tmp_path):
    (tmp_path / "i.xml").write_text(XML)
    df = read(spark, "src.file.xml", path=str(tmp_path / "i.xml"), record="o")
    assert df.columns == ["@id", "@k", "a", "b", "b@c"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == [("1", "v", "x & A<y>", "", "7"), ("2", None, None, None, None)]
    typed = read(spark, "src.file.xml", path=str(tmp_path / "i.xml"), record="o", columns={"@id": "INTEGER", "b@c": "DECIMAL(5,1)", "zz": "VARCHAR"})
    assert sorted((tuple(r) for r in typed.collect()), key=str) == [(1, Decimal("7.0"), None), (2, None, None)]
    doc = pipeline(("s", "src.file.xml", {"path": str(tmp_path / "i.xml"), "record": "o"}), ("w", "snk.file.xml", {"path": str(tmp_path / "o.xml"), "root": "r", "record": "o"}))
    run(spark, doc)
    again = read(spark, "src.file.xml", path=str(tmp_path / "o.xml"), record="o")
    assert again.exceptAll(df).isEmpty() and df.exceptAll(again).isEmpty()


def test_xml_values(spark, tmp_path):
    """Odd characters, times, truth values and nulls come back as texts, from several tasks' files in one."""
    odd = 'a "b" <c> & \'d\'\n\te'
    df = spark.range(40).selectExpr("id", "id % 3 = 0 AS flag", "CASE WHEN id % 4 > 0 THEN id / 4.0 END AS part", "timestamp_seconds(id) AS at").withColumn("@key", F.lit(odd)).withColumn("text", F.lit(odd)).withColumn("text@lang", F.when(F.col("id") > 5, "é")).repartition(4)
    df.createOrReplaceTempView("xml_values")
    doc = pipeline(("s", "xf.sql", {"query": "SELECT * FROM xml_values"}, []), ("w", "snk.file.xml", {"path": str(tmp_path / "o.xml"), "record": "v"}))
    assert run(spark, doc).stage("w").rows == {"in": 40}
    back = {r.id: r for r in read(spark, "src.file.xml", path=str(tmp_path / "o.xml"), record="v").collect()}
    assert len(back) == 40 and all(r["@key"] == odd and r.text == odd for r in back.values())
    assert (back["3"].flag, back["4"].part, back["8"].at, back["8"]["text@lang"], back["5"]["text@lang"]) == ("true", None, "1970-01-01 00:00:08", "é", None)
    assert (tmp_path / "o.xml").read_text().count("<?xml") == 1
    run(spark, pipeline(("s", "xf.sql", {"query": "SELECT * FROM xml_values WHERE id < 0"}, []), ("w", "snk.file.xml", {"path": str(tmp_path / "e.xml"), "record": "v"})))
    assert (tmp_path / "e.xml").read_text().split() == ["<?xml", 'version="1.0"', 'encoding="UTF-8"?>', "<records>", "</records>"]


@pytest.mark.parametrize(("body", "message"), [("<o><a><b/></a></o>", "too deep"), ("<o><a/><a/></o>", "has two"), ("<o>text<a/></o>", "text of its own"), ("<o><a>", "not well-formed"), ("<o><a>&nope;</a></o>", "not well-formed")])
def test_xml_that_is_no_table(body, message):
    with pytest.raises(ValueError, match=message):
        xml_records(f"<r>{body}</r>".encode(), "o")


def xml_document(rng, n, odd):
    """Records of all shapes below two elements; odd ones hold markup that is none."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<!-- a > b --><?go on?><r a="x>y" b=\'"/>\'><n:l>']
    for i in range(n):
        out.append(rng.choice([
            f'<o id="{i}"/>', f'<o id="{i}"><a>t &gt; &#233; é {i}</a><b c=">/>" /></o >', f"<n:o><o>{i}</o><a><![CDATA[x ] > ]]></a></n:o>\n", f"<o><a>{'long ' * rng.randrange(40)}</a><!-- in --></o>",
            f"<p><q><o><a>{i}</a></o></q></p>text", "<other/>", *([f"<!-- <o> --><o><a><![CDATA[</o><o>{i}]]></a></o>", f"<?x <o ?><o><a>{i}</a></o>"] if odd else []),
        ]))
    return "".join([*out, "</n:l></r>\n<!-- end -->"]).encode()


def xml_batches(data, starts, rng):
    """What Spark's reader gives of a document in splits: what lies between two "<", in batches of some rows."""
    rows = data.split(b"<")
    at = 0
    for start, end in zip(starts, [*starts[1:], len(data) + 1], strict=True):
        mine = []
        while rows and at < end or (rows and at == 0):
            mine.append(rows.pop(0))
            at += len(mine[-1]) + 1
        while mine:
            some, mine = mine[: (n := rng.randrange(1, 9))], mine[n:]
            yield pa.RecordBatch.from_arrays([pa.array([7] * len(some), pa.int64()), pa.array([start] * len(some), pa.int64()), pa.array(some, pa.binary())], ["file", "start", "value"])


@pytest.mark.parametrize("odd", [False, True])
def test_xml_in_splits_is_the_whole_document(odd):
    """Splits anywhere, within records, fields and tags, give the records of the whole in their order, or are found to need it."""
    rng = random.Random(5)
    parted = 0
    for n in [*range(0, 80, 2), 300]:
        data = xml_document(rng, n, odd)
        want = xml_records(data, "o")
        starts = [0, *sorted(rng.sample(range(1, len(data)), rng.randrange(1, 6)))]
        found = [documents._Split(**r) for b in documents._outline(b"o")(xml_batches(data, starts, rng)) for r in b.to_pylist()]
        assert sum(s.size for s in found) == len(data)
        if (places := documents.xml_places(found, b"o")) is None:
            continue
        parted += 1
        given = {(s.file, s.start): p for s, p in zip(found, places, strict=True)}
        got = [json.loads(x) for b in documents._rows_of("o", given, {7: "f"})(xml_batches(data, starts, rng)) for x in b.column(0).to_pylist()]
        assert got == want
    assert odd or parted > 12


@pytest.mark.parametrize("bad", ["<r><l><o><a>1</b></o></l></r>", "<r><l><o/><o/></r></l>", "<r><l><o/></l></r><r/>", "<r><l><o/></l></r>x", "<r><l><o/><o/></l>", "<r><l><o>t<a/></o></l></r>", "<r><l><o><a/><a/></o></l></r>", "<r><l><o><a><b/></a></o></l></r>", "<r><l><o/></l></l></r>", "<r><l></l></r></r>", "<r><l><o/><?xml version='1.0'?></l></r>"])
def test_xml_in_splits_has_the_same_errors(bad):
    rng = random.Random(9)
    data = bad.encode()
    for at in range(1, len(data)):
        starts = [0, at]
        found = [documents._Split(**r) for b in documents._outline(b"o")(xml_batches(data, starts, rng)) for r in b.to_pylist()]
        if places := documents.xml_places(found, b"o"):
            given = {(s.file, s.start): p for s, p in zip(found, places, strict=True)}
            with pytest.raises(ValueError, match="f: "):
                list(documents._rows_of("o", given, {7: "f"})(xml_batches(data, starts, rng)))
    with pytest.raises(ValueError):
        xml_records(data, "o")


def test_one_xml_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Splits of one file are parsed by tasks of their own; files that cannot be split come whole, each with all records."""
    staged, real, rng = [], documents._parsed_xml, random.Random(3)
    monkeypatch.setattr(documents, "_parsed_xml", lambda *a: staged.append(real(*a)) or staged[-1])
    folder = tmp_path / "a b é"
    folder.mkdir()
    plain, odd = xml_document(rng, 400, False), xml_document(rng, 200, True)
    latin = '<?xml version="1.0" encoding="iso-8859-1"?><r>'.encode() + b"<o><a>\xe9</a></o>" * 300 + b"</r>"
    files = {"plain": plain, "odd": odd, "latin": latin, "wide": latin.decode("latin-1").replace("iso-8859-1", "utf-16").encode("utf-16"), "type": b'<!DOCTYPE r [<!ENTITY e "<o/>x">]>' + b"<r>" + b"<o><a>1</a></o>" * 300 + b"</r>"}
    for name, data in files.items():
        (folder / f"{name}.xml").write_bytes(data)
    conf = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    with documents._with_conf(spark, conf):
        for name, data in files.items():
            rows = read(spark, "src.file.xml", path=str(folder / f"{name}.xml"), record="o")
            want = xml_records(data, "o")
            assert sorted(str(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in rows.collect()) == sorted(str(sorted(r.items())) for r in want)
            parts = [p for p in Path(staged[-1].removeprefix("file://")).glob("part-*") if p.stat().st_size]
            assert len(parts) > 3 if name in ("plain", "latin") else len(parts) == 1
        both = read(spark, "src.file.xml", path=str(folder), record="o", columns={"a": "VARCHAR"})
        assert both.count() == sum(len(xml_records(x, "o")) for x in files.values())
        for name, data in {"cut": plain[:9000], "more": plain + b"<"}.items():
            (tmp_path / f"{name}.xml").write_bytes(data)
            with pytest.raises(Exception, match=f"{name}.xml: not well-formed"):
                read(spark, "src.file.xml", path=str(tmp_path / f"{name}.xml"), record="o")
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_sqlite_rows_do_not_come_as_results(spark, tmp_path, monkeypatch):
    """The sink takes rows from files of several tasks; types and nulls stay, and no folder is left."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a: pytest.fail("rows were sent to the driver"))
    db = str(tmp_path / "d.sqlite")
    assert write(spark, ROWS, "snk.db.sqlite", connection=db, table="t").stage("w").rows == {"in": 3}
    got = dict((r[0], r[1:]) for r in sqlite3.connect(db).execute("SELECT * FROM t"))
    assert got == {1: ('a,"b"', "2026-01-04 10:05:00", "2026-01-05", 1.5, 1), 2: (None,) * 5, 3: ("", "2026-01-04 10:05:00.250000", "1999-12-31", -2, 0)}
    write(spark, "SELECT id AS a, id AS b FROM range(0, 30000, 1, 5)", "snk.db.sqlite", connection=db, table="t")
    assert [r[0] for r in sqlite3.connect(db).execute("SELECT a FROM t ORDER BY rowid")] == list(range(30000))


def test_sqlite(spark, tmp_path):
    db = str(tmp_path / "x" / "d.sqlite")
    write(spark, ROWS, "snk.db.sqlite", connection=db, table="my table")
    write(spark, ROWS, "snk.db.sqlite", connection=db, table="my table", mode="append")
    df = read(spark, "src.db.sqlite", connection=db, table="my table", partitions=3)
    assert df.count() == 6 and dict(df.dtypes)["at"] == "timestamp_ntz" and df.where("flag").count() == 2
    write(spark, ROWS, "snk.db.sqlite", connection=db, table="my table")
    assert sqlite3.connect(db).execute('SELECT count(*) FROM "my table"').fetchone() == (3,)
    with pytest.raises(ValueError, match="no table"):
        read(spark, "src.db.sqlite", connection=db, table="nope")


def test_delta(spark, tmp_path):
    root = tmp_path / "t"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id").coalesce(1).write.mode("append").parquet(str(root / "raw" / str(i)))
    parts = [next((root / "raw" / str(i)).glob("*.parquet")).relative_to(root) for i in range(3)]
    schema = json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}, {"name": "day", "type": "date", "nullable": True, "metadata": {}}]})
    add = lambda p, d: {"add": {"path": str(p), "partitionValues": {"day": d}, "size": 1, "dataChange": True}}
    log = root / "_delta_log"
    log.mkdir()
    commits = [[{"metaData": {"id": "x", "schemaString": schema, "partitionColumns": ["day"]}}, add(parts[0], "2026-01-01"), add(parts[1], "2026-01-02")], [{"remove": {"path": str(parts[0])}}, add(parts[2], None)]]
    for i, c in enumerate(commits):
        (log / f"{i:020d}.json").write_text("\n".join(map(json.dumps, c)))
    df = read(spark, "src.lake.delta", path=str(root))
    assert df.columns == ["id", "day"] and sorted({str(r.day) for r in df.collect()}) == ["2026-01-02", "None"] and df.agg(F.sum("id")).first()[0] == sum(range(10, 30))
    assert read(spark, "src.lake.delta", path=str(root), version=0).count() == 20
    with pytest.raises(FileNotFoundError):
        read(spark, "src.lake.delta", path=str(tmp_path))
    for n, (action, feature) in enumerate([({"protocol": {"minReaderVersion": 3, "readerFeatures": ["timestampNtz", "typeWidening"]}}, "typeWidening"), ({"metaData": {"id": "x", "schemaString": schema, "partitionColumns": ["day"], "configuration": {"delta.columnMapping.mode": "name"}}}, "columnMapping")]):
        (log / f"{2 + n:020d}.json").write_text(json.dumps(action))
        with pytest.raises(NotImplementedError, match=feature):
            read(spark, "src.lake.delta", path=str(root))


@pytest.fixture
def server():
    """Records 1 to 12 in pages, in every style of paging; what is sent is kept."""
    sent, state = [], {"fail": 0}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def reply(self, body, code=200, **headers):
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):  # noqa: N802
            url = urllib.parse.urlsplit(self.path)
            q = dict(urllib.parse.parse_qsl(url.query))
            sent.append((self.path, dict(self.headers)))
            if state["fail"]:
                state["fail"] -= 1
                return self.reply({}, 503, **{"Retry-After": "0"})
            rows = [{"id": i, "at": f"2026-01-{i:02d} 00:00:00"} for i in range(1, 13)]
            if url.path == "/page":
                n = int(q["page"])
                return self.reply({"data": {"items": rows[5 * n - 5 : 5 * n]}})
            if url.path == "/offset":
                n = int(q["offset"])
                return self.reply(rows[n : n + 5])
            if url.path == "/cursor":
                n = int(q.get("cursor", 0))
                return self.reply({"data": rows[n : n + 7], "next": n + 7 if n + 7 < 12 else None})
            if url.path == "/stuck":
                return self.reply({"data": rows[:1], "next": "same"})
            if url.path == "/link":
                n = int(q.get("n", 0))
                return self.reply(rows[n : n + 5], **({"Link": f'</link?n={n + 5}>; rel="next"'} if n + 5 < 12 else {}))
            self.reply({"message": "no"}, 404)

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            sent.append((self.path, body))
            if self.path == "/graphql":
                if "mutation" in body["query"]:
                    return self.reply({"data": {"ok": True}} if all(r["id"] < 9 for r in body["variables"]["rows"]) else {"errors": [{"message": "too large"}]})
                n = int(body["variables"].get("after") or 0)
                edges = [{"node": {"id": i}} for i in range(n + 1, min(n + 5, 12) + 1)]
                return self.reply({"data": {"orders": {"edges": edges, "pageInfo": {"hasNextPage": n + 5 < 12, "endCursor": str(n + 5)}}}})
            if self.path == "/v1/chat/completions":
                return self.reply({"choices": [{"message": {"content": json.dumps({"label": "Red", "n": "3", "when": "2026-01-02", "ok": "yes"})}}]})
            self.reply({})

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", sent, state
    s.shutdown()


@pytest.mark.parametrize(
    ("path", "props"),
    [
        ("/page", {"pagination": "page", "records": "/data/items", "page_size": 5, "size_param": "size"}),
        ("/offset", {"pagination": "offset", "page_size": 5}),
        ("/cursor", {"pagination": "cursor", "records": "data", "cursor_path": "/next"}),
        ("/link", {"pagination": "link"}),
    ],
)
def test_rest_paging(spark, server, path, props):
    url, sent, state = server
    state["fail"] = 1
    df = read(spark, "src.saas.rest", url=url + path, retry_backoff_ms=1, **props)
    assert sorted(r.id for r in df.collect()) == list(range(1, 13)) and dict(df.dtypes)["at"] == "timestamp_ntz"
    n = len(sent)
    assert df.count() == 12 and len(sent) == n  # nothing is fetched twice


def test_rest_limits_and_authentication(spark, server):
    url, sent, _ = server
    read(spark, "src.saas.rest", url=url + "/offset?offset=0", auth="header", token="k", columns={"id": "VARCHAR", "at": "TIMESTAMP", "none": "INTEGER"})
    assert {k.lower(): v for k, v in sent[-1][1].items()}["x-api-key"] == "k"
    for path, props, message in (("/nope", {}, "404"), ("/stuck", {"pagination": "cursor", "records": "data", "cursor_path": "next"}, "does not move"), ("/link", {"pagination": "link", "max_pages": 2}, "max_pages")):
        with pytest.raises(Exception, match=message):
            read(spark, "src.saas.rest", url=url + path, **props)
    with pytest.raises(InvalidProperty, match="required for bearer"):
        read(spark, "src.saas.rest", url=url, auth="bearer")


def test_paging_has_no_end_but_the_last_page(monkeypatch):
    """More than 1,000 pages are read; services that lead in circles, or give one page for ever, are errors."""
    base = {"auth": "none", "query": None, "records": "", "page_param": "page", "page_start": 1, "offset_param": "offset", "cursor_path": "next", "cursor_param": "cursor", "method": "GET", "body": None, "max_pages": None, "url": "http://x/", "size_param": None, "page_size": None}
    asked = lambda url: dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))

    def pages(style, answer, **more):
        monkeypatch.setattr(apis.Client, "send", lambda self, url, *rest: (json.dumps(answer(asked(url))).encode(), {}))
        return list(apis.rest_pages({**base, "pagination": style, **more}))

    some = lambda at: list(range(at, min(at + 2, 2403)))
    assert pages("offset", lambda q: some(int(q["offset"])), page_size=2) == list(range(2403))
    assert pages("page", lambda q: [7] * 2 if int(q["page"]) < 900 else [7], page_size=2) == [7] * (2 * 899 + 1)
    assert len(pages("cursor", lambda q: {"r": [1], "next": int(q.get("cursor", 0)) + 1 if int(q.get("cursor", 0)) < 1500 else None}, records="r")) == 1501
    with pytest.raises(RuntimeError, match="does not move on"):
        pages("cursor", lambda q: {"r": [1], "next": (int(q.get("cursor", 0)) + 1) % 5 + 1}, records="r")
    with pytest.raises(RuntimeError, match="does not move on"):
        pages("offset", lambda q: [1, 2], page_size=2)
    with pytest.raises(RuntimeError, match="max_pages"):
        pages("offset", lambda q: [1, 2], page_size=2, max_pages=3)


def test_rest_sink(spark, server):
    url, sent, _ = server
    report = write(spark, "SELECT id, 'x' AS v FROM range(5)", "snk.saas.rest", url=url + "/in", batch_size=2, wrap="records")
    assert [len(b["records"]) for p, b in sent if p == "/in"] == [2, 2, 1] and report.stage("w").rows == {"in": 5}


@pytest.fixture
def ledger():
    """A service that takes a key's rows once. Of the requests numbered in `fail` it takes the rows and says that it did not."""
    taken, requests, fail = {}, [], {}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            rows, key = body if self.path == "/rest" else body["variables"]["rows"], self.headers["Idempotency-Key"]
            requests.append(key)
            assert taken.setdefault(key, rows) == rows  # a key always comes with the same rows
            self.send_response(fail.get(len(requests), 200))
            self.end_headers()
            self.wfile.write(b'{"data": {}}')

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", taken, requests, fail
    s.shutdown()


@pytest.mark.parametrize("tasks", [1, 3])
@pytest.mark.parametrize(("name", "path", "props"), [("snk.saas.rest", "/rest", {}), ("snk.saas.graphql", "/graphql", {"mutation": "mutation { put }"})])
def test_no_row_is_delivered_twice(spark, ledger, name, path, props, tasks):
    """The second request is taken but answered by 503, as a lost answer; the fourth by 400, which fails the task and so the node, tried again."""
    url, taken, requests, fail = ledger
    fail |= {2: 503, 4: 400}
    node = ("w", name, {"url": url + path, "batch_size": 4, "tasks": tasks, "retry_backoff_ms": 1, **props}, None, {"policy": {"retryAttempts": 1, "retryBackoffMs": 1}})
    query = ("q", "xf.sql", {"query": "SELECT id, uuid() AS drawn FROM range(0, 30, 1, 2)"}, [])
    report = run(spark, pipeline(query, node))
    sent = [r["id"] for rows in taken.values() for r in rows]
    assert sorted(sent) == list(range(30)) and report.stage("w").rows == {"in": 30} and report.stage("w").attempts == 2
    assert len(requests) > len(taken) and (tasks > 1 or sent == sorted(sent))


def test_batches_sent_again_are_the_same(spark, ledger):
    """What a second task for the same part would send, though the rows are drawn anew whenever they are computed."""
    from millrace.registry import Step, load
    from millrace.sources.apis import write_rest

    url, taken, requests, _ = ledger
    step = Step("w", "snk.saas.rest", load()["snk.saas.rest"].values("w", {"url": url + "/rest", "batch_size": 3}, []), spark)
    deliver = write_rest(step)
    df = spark.range(10).selectExpr("id", "uuid() AS drawn")
    assert deliver(df) == deliver(df) == 10
    assert len(requests) == 8 and sum(map(len, taken.values())) == 10
    assert write_rest(step)(df.limit(0)) == 0 and len(requests) == 8
    with pytest.raises(InvalidProperty, match="positive"):
        load()["snk.saas.rest"].values("w", {"url": url, "tasks": 0}, [])


def test_graphql(spark, server):
    url, sent, _ = server
    df = read(spark, "src.saas.graphql", url=url + "/graphql", query="query($after: String) { orders }", records="orders/edges", pagination="relay")
    assert sorted(r.id for r in df.collect()) == list(range(1, 13))
    write(spark, "SELECT id FROM range(3)", "snk.saas.graphql", url=url + "/graphql", mutation="mutation($rows: [R]) { put }")
    with pytest.raises(RunFailed, match="after 8 rows.*too large"):
        write(spark, "SELECT id FROM range(12)", "snk.saas.graphql", url=url + "/graphql", mutation="mutation { put }", batch_size=4)


def test_model_columns(spark, server):
    url, sent, _ = server
    rows = ("q", "xf.sql", {"query": "SELECT * FROM VALUES (1, 'red thing'), (2, '  ') AS t(id, text)"}, [])
    end = {"base_url": url + "/v1", "model": "m"}
    got = {r.id: r.label for r in frames(spark, pipeline(rows, ("c", "xf.ai.classify", {"column": "text", "labels": ["red", "blue"], **end})))["c"].collect()}
    assert got == {1: "red", 2: None}
    r = frames(spark, pipeline(rows, ("c", "xf.ai.extract", {"column": "text", "fields": {"n": "integer", "when": "date", "ok": "boolean", "label": "text", "zz": "number"}, **end})))["c"].where("id = 1").first()
    assert (r.n, str(r.when), r.ok, r.label, r.zz) == (3, "2026-01-02", True, "Red", None)
    frames(spark, pipeline(rows, ("c", "xf.ai.prompt", {"prompt": "{{x}} {id}: {text}", "system": "s", **end})))["c"].collect()
    assert {"role": "user", "content": "{x} 1: red thing"} in [m for p, b in sent if p.endswith("completions") for m in b["messages"]]
    with pytest.raises(InvalidProperty, match="more than 1 rows"):
        frames(spark, pipeline(rows, ("c", "xf.ai.prompt", {"prompt": "x", "max_rows": 1, **end})))
    e = frames(spark, pipeline(rows, ("e", "xf.ai.embed", {"column": "text", "dimensions": 8})))["e"].orderBy("id").collect()
    assert len(e[0].embedding) == 8 and abs(sum(x * x for x in e[0].embedding) - 1) < 1e-6 and e[1].embedding is None


def test_http_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("a,b\n1,2\n")
    from functools import partial
    from http.server import SimpleHTTPRequestHandler

    s = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    assert [tuple(r) for r in read(spark, "src.cloud.http", path=f"http://127.0.0.1:{s.server_port}/o.csv", format="csv").collect()] == [(1, 2)]
    s.shutdown()


def test_messages(spark):
    df = spark.createDataFrame([(bytearray(b' {"a": 1, "b": {"c": [1.5]}}'), 0), (None, 1), (bytearray(b'{"a": 2, "d": "x"}'), 2)], "value binary, _offset long")
    got = {r._offset: r for r in brokers.broker_rows(df, "json").collect()}
    assert got[0].a == 1 and got[0].b.c == [1.5] and got[1].a is None and got[2].d == "x"
    assert brokers.broker_rows(df, "json", {"a": "INTEGER", "_offset": "BIGINT"}).dtypes == [("a", "int"), ("_offset", "bigint")]
    assert brokers.broker_rows(df, "text").where("_offset = 2").first().value == '{"a": 2, "d": "x"}'
    assert brokers.broker_rows(df, "bytes").where("_offset = 1").first().value is None
    for value, message in ((b"[1]", "not a JSON object"), (b"nope", "not a JSON object"), (b'{"_offset": 1}', "adds")):
        bad = spark.createDataFrame([(bytearray(value), 0)], "value binary, _offset long")
        with pytest.raises(Exception, match=message):
            brokers.broker_rows(bad, "json").collect()


def test_settings_of_servers():
    assert databases.words("postgresql://u:p@h:5/d?x=1") == {"user": "u", "password": "p", "host": "h", "port": "5", "dbname": "d"}
    assert databases.words("host=h dbname='my db' user=u") == {"host": "h", "dbname": "my db", "user": "u"}
    s3 = files.s3_settings({"path": "s3://b/x", "key_id": "k", "secret": "s", "session_token": None, "region": None, "endpoint": "http://localhost:9000", "url_style": "path", "use_ssl": True})
    assert s3 == {"fs.s3a.bucket.b.access.key": "k", "fs.s3a.bucket.b.secret.key": "s", "fs.s3a.bucket.b.endpoint": "http://localhost:9000", "fs.s3a.bucket.b.connection.ssl.enabled": "false", "fs.s3a.bucket.b.path.style.access": "true"}
    kafka = brokers.kafka_options({"brokers": "b:1", "security": "sasl_tls", "sasl_mechanism": "SCRAM-SHA-256", "username": "u", "password": "p", "ca_cert": None, "timeout_ms": 5})
    assert kafka["kafka.security.protocol"] == "SASL_SSL" and "ScramLoginModule" in kafka["kafka.sasl.jaas.config"]
    assert brokers.offset_ranges({0: 0, 1: 3}, {0: 9, 1: 5}, {0: 5}, "earliest", None) == {0: (5, 9), 1: (3, 5)}
    assert "WHEN MATCHED THEN UPDATE SET t.[b] = s.[b]" in databases.merge_statement("t", "t_stage", ["a", "b"], ["a"])


@pytest.mark.parametrize(("name", "props", "package"), [("src.stream.kafka", {"brokers": "b", "topic": "t"}, "kafka"), ("src.db.postgres", {"connection": "host=x", "table": "t"}, "postgresql"), ("src.db.mongodb", {"uri": "u", "database": "d", "collection": "c"}, "mongo"), ("src.cloud.s3", {"path": "s3://b/x"}, "hadoop-aws"), ("src.warehouse.bigquery", {"project": "p", "table": "t"}, "bigquery"), ("src.warehouse.snowflake", {"account": "a", "user": "u", "table": "t"}, "snowflake")])
def test_missing_packages_are_named(spark, name, props, package):
    with pytest.raises(ModuleNotFoundError, match=package):
        read(spark, name, **props)


def test_iceberg_deletes_are_refused(spark, tmp_path, monkeypatch):
    """Avro files are stood in for by DataFrames, as spark-avro is not here."""
    spark.range(3).write.parquet(str(tmp_path / "data"))
    manifests = {
        "list": spark.createDataFrame([("rows", 0), ("gone", 1)], "manifest_path string, content int"),
        ("rows",): spark.createDataFrame([(1, (str(tmp_path / "data"),))], "status int, data_file struct<file_path: string>"),
    }

    class Reader:
        read = property(lambda self: self)
        format = lambda self, name: self
        load = lambda self, at: manifests[at if isinstance(at, str) else tuple(at)]
        schema = lambda self, s: spark.read.schema(s)
        createDataFrame = staticmethod(spark.createDataFrame)

    meta = {"location": "/t", "snapshots": [{"snapshot-id": 1, "manifest-list": "list"}], "current-snapshot-id": 1, "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": [{"name": "id", "type": "long"}]}]}
    monkeypatch.setattr(lakes, "has_format", lambda *a: True)
    monkeypatch.setattr(lakes, "metadata_file", lambda *a: "/t/metadata/v1.metadata.json")
    monkeypatch.setattr(lakes, "read_text", lambda *a: json.dumps(meta))
    manifests["gone",] = spark.createDataFrame([(1,)], "status int")
    with pytest.raises(NotImplementedError, match="delete files"):
        lakes.read_iceberg_log(Reader(), "/t", None, False)
    manifests["gone",] = spark.createDataFrame([(2,)], "status int")  # a delete file that was itself removed
    assert lakes.read_iceberg_log(Reader(), "/t", None, False).count() == 3


def test_limited_increments_read_ties_whole(spark):
    rows = [(i, None if i < 3 else min(i, 9) if i < 25 else i) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, at int").repartition(3)
    got, sizes, mark = [], [], None

    class Step(dict):
        context = property(lambda self: {"position": mark, "track": lambda df, c: df})
        __missing__ = lambda self, key: None

    for _ in range(8):
        part = databases._after(Step(incremental_column="at", max_records=4), df).collect()
        if not part:
            break
        sizes.append(len(part))
        got += [tuple(r) for r in part]
        mark = str(max(r.at for r in part if r.at is not None))
    assert sorted(got) == rows and sizes[0] == 7 and max(sizes) < 25
    assert len(databases._after(Step(max_records=4), df).collect()) == 4


def test_kafka_offsets_are_fixed_before_reading(spark, monkeypatch):
    """Against a topic that grows between any two looks at it: no message is lost or read twice, and no partition starves."""
    topic = {0: 0, 1: 0, 2: 0}
    asked, read = [], []

    def offsets(*_):
        out = dict.fromkeys(topic, 0), dict(topic)
        for p in topic:
            topic[p] += 1 + 40 * (p == 0)
        return out

    class Reader:
        def format(self, *_):
            return self

        def options(self, **o):
            asked.append({k: json.loads(o[k])["t"] for k in ("startingOffsets", "endingOffsets")})
            return self

        def load(self):
            rows = [(b"{}", "t", int(p), o, None, b"k") for p, a in asked[-1]["startingOffsets"].items() for o in range(a, asked[-1]["endingOffsets"][p])]
            read.append([(r[2], r[3]) for r in rows])
            for p in topic:
                topic[p] += 1
            return spark.createDataFrame(rows, "value binary, topic string, partition int, offset long, timestamp timestamp, key binary")

    monkeypatch.setattr(brokers, "topic_offsets", offsets)
    monkeypatch.setattr(brokers, "_kafka", lambda spark: "kafka")
    monkeypatch.setattr(brokers, "broker_rows", lambda df, *_: df)
    position = [None]

    class Step(dict):
        context = property(lambda self: {"position": position[0], "set_position": lambda x: position.__setitem__(0, x)})
        spark = type("S", (), {"read": property(lambda self: Reader())})()
        props = {"brokers": "b:1", "security": "plaintext", "sasl_mechanism": "PLAIN", "username": None, "password": None, "ca_cert": None, "timeout_ms": 5}

    for _ in range(12):
        df = brokers.read_kafka(Step(topic="t", start="earliest", max_records=12, value_format="json", columns=None))
        assert df.count() <= 12
    got = [x for part in read for x in part]
    assert len(got) == len(set(got))
    ends = {int(p): o for p, o in json.loads(position[0]).items()}
    assert sorted(got) == [(p, o) for p in sorted(ends) for o in range(ends[p])] and min(ends.values()) > 15
    with pytest.raises(ValueError, match="lost"):
        brokers.offset_ranges({0: 7}, {0: 9}, {0: 5}, "earliest", None)
