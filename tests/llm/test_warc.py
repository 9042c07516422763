import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, warc


@pytest.fixture
def written(spark, tmp_path):
    warc.register(spark)
    rows = [
        ("response", "<urn:page:1>", "http://a/1", "2024-01-01T00:00:00Z", None, b"x" * 5000),
        ("revisit", "<urn:page:2>", "http://a/2", None, "<urn:page:1>", None),
        ("resource", "<urn:page:3>", " odd\r\nurl é ", None, None, b"\r\n\r\nWARC/1.1\r\n"),
        ("response", "<urn:page:4>", None, None, None, b""),
    ]
    df = spark.createDataFrame([(*r, len(r[5]) if r[5] is not None else 5000, hashlib.sha1(r[5] if r[5] is not None else b"x" * 5000).hexdigest()) for r in rows], "record_type string, record_id string, target_uri string, date string, refers_to string, payload binary, payload_bytes long, payload_digest string")

    def make(name, **options):
        df.repartition(2).write.format("warc").options(**options).mode("append").save(str(tmp_path / name))
        return spark.read.format("warc"), str(tmp_path / name)

    return make


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(written, compression):
    reader, path = written("w", compression=compression)
    got = {r.record_id[10:-1]: r for r in reader.load(path).collect()}
    assert [(got[i].record_type, got[i].payload_bytes) for i in "1234"] == [("response", 5000), ("revisit", 5000), ("resource", 14), ("response", 0)]
    assert bytes(got["1"].payload) == b"x" * 5000 and got["2"].payload is None and bytes(got["3"].payload) == b"\r\n\r\nWARC/1.1\r\n"
    assert got["2"].refers_to == "<urn:page:1>" and got["2"].payload_digest == got["1"].payload_digest
    assert got["1"].date == "2024-01-01T00:00:00Z" and got["4"].target_uri is None and got["3"].target_uri == "%20odd%0D%0Aurl é%20"
    assert got["1"].headers["warc-type"] == "response"


def test_predicates_are_decided_on_headers(written, monkeypatch):
    reader, path = written("p")
    df = reader.schema("record_type string, record_id string, payload binary").load(path)
    plan = df.where("record_type = 'response' AND record_id LIKE '<urn:page:1%'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert [r.record_id for r in df.where("record_type IN ('revisit', 'response') AND record_id LIKE '%:2>'").collect()] == ["<urn:page:2>"]
    assert df.where("record_type = 'none'").count() == 0
    assert df.where(F.length("payload") > 100).count() == 1


def test_unwanted_payloads_are_not_inflated(tmp_path):
    row = {"record_type": "response", "record_id": "<a>", "payload": b"y" * 1000000, "payload_digest": "00" * 20}
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(warc.member(warc.encode_record(row | {"record_id": f"<{i}>"})) for i in range(3)))
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        seen = [r.headers["warc-record-id"] for r in warc._gzip_records(f)]
    assert seen == ["<0>", "<1>", "<2>"]
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1") == 3


def test_members_without_lengths(tmp_path):
    row = {"record_type": "response", "payload": b"z" * 300000, "payload_digest": "00" * 20}
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(gzip.compress(warc.encode_record(row | {"record_id": f"<{i}>", "payload": bytes([65 + i]) * 100000})) for i in range(3)))
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        got = [(r.headers["warc-record-id"], warc.payload_of(r.headers, r.block())[0]) for r in warc._gzip_records(f)]
    assert got == [(f"<{i}>", bytes([65 + i]) * 100000) for i in range(3)]


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, path):
        self.file, self.n = open(path, "rb"), 0
        self.length = self.file.seek(0, 2)

    def size(self):
        return self.length

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        self.n += len(data)
        return data


def test_members_without_lengths_are_inflated_once(tmp_path, monkeypatch):
    """As in most archives: nothing of an unwanted block is kept, and no byte is inflated twice."""
    noise = random.Random(3).randbytes(400_000)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(gzip.compress(warc.encode_record({"record_type": "response", "record_id": f"<{i}>", "payload": noise, "payload_digest": "00" * 20})) for i in range(4)))
    file, pieces = Counted(path), []
    read = warc._Inflating.read
    monkeypatch.setattr(warc._Inflating, "read", lambda self: (pieces.append(x := read(self)), x)[1])
    got = []
    for r in warc._gzip_records(file):
        got.append(len(warc.payload_of(r.headers, r.block())[0]) if r.headers["warc-record-id"] == "<2>" else None)
    assert got == [None, None, 400_000, None]
    assert sum(map(len, pieces)) < 4 * 401_000 and max(map(len, pieces)) <= 1 << 16
    assert file.n < 1.1 * file.length


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("length", ["", "Content-Length: -1\r\n", "Content-Length: many\r\n"])
def test_a_record_without_a_length_is_an_error(tmp_path, compressed, length):
    from pyarrow import fs

    data = f"WARC/1.1\r\nWARC-Type: resource\r\n{length}\r\nblock\r\n\r\n".encode()
    path = tmp_path / "x.warc"
    path.write_bytes(gzip.compress(data) if compressed else data)
    with fs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(ValueError, match="Content-Length"):
        list((warc._gzip_records if compressed else warc._plain_records)(f))


def test_a_cut_archive_is_an_error(tmp_path):
    from pyarrow import fs

    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(warc.encode_record({"record_type": "response", "payload": b"abc" * 9999, "payload_digest": "00" * 20}))[:-30])
    with fs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(ValueError, match="ends early"):
        list(warc._gzip_records(f))


def test_files_are_grouped_into_partitions(written):
    reader, path = written("g", fileBytes="1")
    assert reader.option("partitionBytes", "1").load(path).rdd.getNumPartitions() == 4
    assert reader.option("partitionBytes", "100000").load(path).rdd.getNumPartitions() == 1


def test_pages(spark):
    big, other = "é" * 600, "q" * 1000
    rows = [(1, "u", big), (2, "u", big), (9, None, big), (3, "u\n", other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", other), (8, "u", "l" * 3000000)]
    df = spark.createDataFrame([(h, i, u, "m") for i, u, h in rows], "html string, page_id long, url string, record_type string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect()}
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    want = {i: (len((h or "").encode()), sha(h), "response", None) for i, _, h in rows}
    want |= {i: (1200, sha(big), "revisit", 9) for i in (1, 2)} | {None: (1000, sha(other), "revisit", 3)}
    assert got == want
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_matches_sql(same):
    same(queries.QUERIES["op1_warc"], queries.ORACLE_SQL["op1_warc"])


def _read(path):
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        records = warc._gzip_records(f) if str(path).endswith("gz") else warc._plain_records(f)
        return [(r.headers["warc-record-id"], warc.payload_of(r.headers, r.block())[0]) if wanted else (r.headers["warc-record-id"], None) for r, wanted in ((r, not r.headers["warc-record-id"].endswith("odd>")) for r in records)]


def _records(sizes):
    rows = [{"record_type": "resource", "record_id": f"<{i}{'odd' if i % 2 else ''}>", "payload": bytes([65 + i % 26]) * n, "payload_digest": "00" * 20} for i, n in enumerate(sizes)]
    want = [(r["record_id"], None if r["record_id"].endswith("odd>") else r["payload"]) for r in rows]
    return [warc.encode_record(r) for r in rows], want


@pytest.mark.parametrize("told", [True, False])
@pytest.mark.parametrize("per_member", [3, 7])
def test_several_records_in_a_member(tmp_path, told, per_member):
    """Three records a member, or the whole file in one, whether members tell their lengths or not, and blocks read or passed over."""
    records, want = _records([10, 0, 200_000, 70_000, 5, 300_000, 1])
    path = tmp_path / "x.warc.gz"
    parts = [b"".join(records[i : i + per_member]) for i in range(0, len(records), per_member)]
    path.write_bytes(b"".join(warc.member(p) if told else gzip.compress(p) for p in parts))
    assert _read(path) == want
    path.write_bytes(path.read_bytes()[:-200])
    with pytest.raises(ValueError):
        _read(path)


def test_files_cut_short(tmp_path):
    records, want = _records([100, 50, 4000])
    path, data = tmp_path / "x.warc", b"".join(records)
    path.write_bytes(data)
    assert _read(path) == want
    for at in (len(data) - 3000, len(data) - 4100, len(records[0]) + 30):  # in a block, in a header, in the second header
        path.write_bytes(data[:at])
        with pytest.raises(ValueError, match=r"ends early|no end"):
            _read(path)
