"""Brokers against servers in this process that speak as much of the protocol as is needed."""

import base64
import json
import socketserver
import struct
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from millrace.model import pipeline
from millrace.plans import RunFailed, run
from millrace.registry import InvalidProperty
from millrace.sources.wire import _Reader, _short, signed
from millrace.state import Store

KEYS = {"access_key_id": "k", "secret_access_key": "s", "region": "r", "retries": 1}
ROWS = ("q", "xf.sql", {"query": "SELECT id, concat('g', id % 2) AS g, named_struct('a', id) AS attrs FROM range(25)"}, [])


def served(handler):
    s = handler if not isinstance(handler, type) or not issubclass(handler, BaseHTTPRequestHandler) else ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    return s


@pytest.fixture
def cloud():
    """SQS, Kinesis and Pub/Sub in one: what the queue holds, what was deleted, what was sent."""
    state = {"queue": [{"id": i, "v": "x" * i} for i in range(23)], "held": {}, "deleted": [], "back": [], "sent": [], "throttle": 1, "calls": []}
    shards = {f"shard-{k}": [{"SequenceNumber": f"{10**i}", "Data": base64.b64encode(json.dumps({"id": i + 10 * k}).encode()).decode(), "ApproximateArrivalTimestamp": 1.7e9, "PartitionKey": "p"} for i in range(5)] for k in range(2)}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            target = (self.headers.get("X-Amz-Target") or self.path.rsplit(":", 1)[-1]).rsplit(".", 1)[-1]
            state["calls"].append(target)
            out, code = getattr(self, target, lambda b: ({}, 404))(body), 200
            if isinstance(out, tuple):
                out, code = out
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def take(self, n):
            got, state["queue"] = state["queue"][:n], state["queue"][n:]
            state["held"] |= {f"r{m['id']}": m for m in got}
            return got

        def GetQueueUrl(self, b):  # noqa: N802
            return {"QueueUrl": f"http://q/{b['QueueName']}"}

        def ReceiveMessage(self, b):  # noqa: N802
            return {"Messages": [{"Body": json.dumps(m), "MessageId": f"m{m['id']}", "ReceiptHandle": f"r{m['id']}", "Attributes": {"SentTimestamp": "1700000000000", "ApproximateReceiveCount": "2"}} for m in self.take(b["MaxNumberOfMessages"])]}

        def DeleteMessageBatch(self, b):  # noqa: N802
            state["deleted"] += [e["ReceiptHandle"] for e in b["Entries"]]
            return {}

        def ChangeMessageVisibilityBatch(self, b):  # noqa: N802
            state["back"] += [e["ReceiptHandle"] for e in b["Entries"] if e["VisibilityTimeout"] == 0]
            return {}

        def SendMessageBatch(self, b):  # noqa: N802
            state["sent"].append(b["Entries"])
            return {}

        def ListShards(self, b):  # noqa: N802
            if state["throttle"]:
                state["throttle"] -= 1
                return {"__type": "x#ThrottlingException"}, 400
            return {"Shards": [{"ShardId": "shard-0"}], "NextToken": "t"} if "NextToken" not in b else {"Shards": [{"ShardId": "shard-1"}]}

        def GetShardIterator(self, b):  # noqa: N802
            rows = shards[b["ShardId"]]
            at = 1 + next(i for i, r in enumerate(rows) if r["SequenceNumber"] == b["StartingSequenceNumber"]) if "StartingSequenceNumber" in b else 0
            return {"ShardIterator": f"{b['ShardId']}/{at}"}

        def GetRecords(self, b):  # noqa: N802
            shard, at = b["ShardIterator"].split("/")
            rows = shards[shard][int(at) : int(at) + 2]
            return {"Records": rows, "NextShardIterator": f"{shard}/{int(at) + len(rows)}", "MillisBehindLatest": 0}

        def PutRecords(self, b):  # noqa: N802
            refuse = len(b["Records"]) > 3
            state["sent"].append(b["Records"][1 if refuse else 0 :])
            return {"Records": [{"ErrorCode": "ProvisionedThroughputExceededException"} if refuse and i == 0 else {} for i in range(len(b["Records"]))]}

        def pull(self, b):
            return {"receivedMessages": [{"ackId": f"r{m['id']}", "deliveryAttempt": 1, "message": {"data": base64.b64encode(json.dumps(m).encode()).decode(), "messageId": str(m["id"]), "publishTime": "2024-01-02T03:04:05Z", "attributes": {"k": "v"}}} for m in self.take(min(10, b["maxMessages"]))]}

        def acknowledge(self, b):
            state["deleted"] += b["ackIds"]
            return {}

        def modifyAckDeadline(self, b):  # noqa: N802
            state["back"] += b["ackIds"] if b["ackDeadlineSeconds"] == 0 else []
            return {}

        def publish(self, b):
            state["sent"].append(b["messages"])
            return {"messageIds": ["1"] * len(b["messages"])}

    s = served(Handler)
    yield f"http://127.0.0.1:{s.server_port}", state
    s.shutdown()


def test_signature():
    """The first case of the published test suite."""
    got = signed("GET", "https://example.amazonaws.com/", {}, b"", key="AKIDEXAMPLE", secret="wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", token=None, region="us-east-1", service="service", now="20150830T123600Z")
    assert got["Authorization"].endswith("Signature=5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31")


@pytest.mark.parametrize(("source", "props"), [("src.queue.sqs", {"queue": "q", **KEYS}), ("src.queue.pubsub", {"subscription": "s", "project": "p"})])
def test_queues_are_acknowledged_after_delivery(spark, cloud, tmp_path, source, props):
    url, state = cloud
    out = tmp_path / "o.parquet"
    steps = [("s", source, {"endpoint": url, "max_wait_ms": 500, **props}), ("w", "snk.file.parquet", {"path": str(out)})]
    run(spark, pipeline(*steps))
    rows = spark.read.parquet(str(out))
    assert rows.count() == 23 and {"id", "v", "_message_id"} <= set(rows.columns) and "_receipt" not in rows.columns
    assert sorted(state["deleted"]) == sorted(f"r{i}" for i in range(23)) and not state["back"]


@pytest.mark.parametrize(("source", "props"), [("src.queue.sqs", {"queue_url": "http://q/x", **KEYS}), ("src.queue.pubsub", {"subscription": "projects/p/subscriptions/s"})])
def test_queues_get_back_what_a_failed_run_took(spark, cloud, source, props):
    url, state = cloud
    with pytest.raises(RunFailed):
        run(spark, pipeline(("s", source, {"endpoint": url, "max_records": 7, "max_wait_ms": 500, **props}), ("f", "ctl.fail", {"message": "no"})))
    assert len(state["back"]) == 7 and not state["deleted"] and len(state["queue"]) == 16


def test_queue_sinks(spark, cloud):
    url, state = cloud
    assert run(spark, pipeline(ROWS, ("w", "snk.queue.sqs", {"queue": "q", "endpoint": url, **KEYS}))).stage("w").rows == {"in": 25}
    assert max(map(len, state["sent"])) <= 10 and sum(map(len, state["sent"])) == 25
    state["sent"].clear()
    run(spark, pipeline(ROWS, ("w", "snk.queue.sqs", {"queue": "q.fifo", "message_group_id_column": "g", "endpoint": url, **KEYS})))
    assert state["sent"][0][1]["MessageGroupId"] == "g1"
    with pytest.raises(RunFailed, match="required for a .fifo"):
        run(spark, pipeline(ROWS, ("w", "snk.queue.sqs", {"queue": "q.fifo", "endpoint": url, **KEYS})))
    state["sent"].clear()
    run(spark, pipeline(ROWS, ("w", "snk.queue.pubsub", {"topic": "t", "project": "p", "endpoint": url, "ordering_key_column": "g", "attributes_column": "attrs"})))
    sent = [m for b in state["sent"] for m in b]
    assert len(sent) == 25 and sent[1]["orderingKey"] == "g1" and sent[1]["attributes"] == {"a": "1"} and json.loads(base64.b64decode(sent[1]["data"])) == {"id": 1, "g": "g1"}


def test_kinesis(spark, cloud, tmp_path):
    url, state = cloud
    store, out = Store(tmp_path), tmp_path / "o.parquet"
    doc = lambda n: pipeline(("s", "src.stream.kinesis", {"stream": "x", "endpoint": url, "max_records": n, **KEYS}), ("w", "snk.file.parquet", {"path": str(out)}), name="k")
    run(spark, doc(4), store=store)
    assert sorted(r.id for r in spark.read.parquet(str(out)).collect()) == [0, 1, 10, 11]
    assert json.loads(store.load("k")["s"]["position"]) == {"shard-0": "10", "shard-1": "10"}
    run(spark, doc(1000), store=store)
    assert sorted(r.id for r in spark.read.parquet(str(out)).collect()) == [2, 3, 4, 12, 13, 14]
    state["sent"].clear()
    run(spark, pipeline(ROWS, ("w", "snk.stream.kinesis", {"stream": "x", "endpoint": url, "partition_key_column": "g", **KEYS})))
    assert sum(map(len, state["sent"])) == 25


@pytest.fixture
def nats():
    """A stream of sequences 3 to 12 in which 5 is deleted; what is published, with its headers."""
    state = {"published": [], "first": 3}
    kept = {n: {"subject": f"o.{n % 2}", "seq": n, "data": base64.b64encode(json.dumps({"n": n}).encode()).decode(), "time": "2024-01-01T00:00:00.5Z"} for n in range(3, 13) if n != 5}

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            self.wfile.write(b'INFO {"headers": true}\r\n')
            while line := self.rfile.readline():
                word = line.split()
                if word[0] == b"PING":
                    self.wfile.write(b"PONG\r\n")
                if word[0] in (b"PUB", b"HPUB"):
                    data = self.rfile.read(int(word[-1]) + 2)[:-2]
                    subject, reply = word[1].decode(), word[2].decode()
                    if "STREAM.INFO" in subject:
                        out = {"state": {"first_seq": state["first"], "last_seq": 12}} if subject.endswith(".s") else {"error": {"code": 404, "err_code": 10059, "description": "stream not found"}}
                    elif "MSG.GET" in subject:
                        ask = json.loads(data)
                        found = next((m for n, m in sorted(kept.items()) if n >= ask["seq"] and (ask["next_by_subj"] in (">", m["subject"]))), None)
                        out = {"message": found} if found else {"error": {"code": 404, "err_code": 10037, "description": "no message found"}}
                    else:
                        state["published"].append((subject, data))
                        out = {"stream": "s", "seq": len(state["published"])}
                    body = json.dumps(out).encode()
                    self.wfile.write(f"MSG {reply} 1 {len(body)}\r\n".encode() + body + b"\r\n")

    s = served(socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler))
    yield f"nats://127.0.0.1:{s.server_address[1]}", state
    s.shutdown()


def test_nats(spark, nats, tmp_path):
    url, state = nats
    store, out = Store(tmp_path), tmp_path / "o.parquet"
    doc = lambda **p: pipeline(("s", "src.stream.nats", {"url": url, "stream": "s", **p}), ("w", "snk.file.parquet", {"path": str(out)}), name="n")
    run(spark, doc(max_records=4), store=store)
    assert sorted(r.n for r in spark.read.parquet(str(out)).collect()) == [3, 4, 6] and store.load("n")["s"]["position"] == "6"
    run(spark, doc(filter_subject="o.0"), store=store)
    assert sorted(r.n for r in spark.read.parquet(str(out)).collect()) == [8, 10, 12]
    run(spark, doc(), store=store)
    assert spark.read.parquet(str(out)).count() == 0
    store.save("n", {"s": {"position": "1"}})
    with pytest.raises(RunFailed, match="discarded"):
        run(spark, doc(), store=store)
    with pytest.raises(RunFailed, match="stream not found"):
        run(spark, pipeline(("s", "src.stream.nats", {"url": url, "stream": "other"})))
    run(spark, pipeline(ROWS, ("w", "snk.stream.nats", {"url": url, "subject": "in", "msg_id_column": "id", "batch_size": 7})))
    assert len(state["published"]) == 25 and b"Nats-Msg-Id: 3\r\n" in dict((json.loads(d.split(b"\r\n\r\n")[1])["id"], d) for _, d in state["published"])[3]


@pytest.fixture
def rabbit():
    """A broker with one queue: what it holds, what was settled, what was published."""
    state = {"queue": [json.dumps({"n": i}).encode() for i in range(5)], "settled": [], "published": []}

    class Handler(socketserver.StreamRequestHandler):
        def method(self, cls, method, body=b"", channel=1):
            payload = struct.pack(">HH", cls, method) + body
            self.wfile.write(struct.pack(">BHI", 1, channel, len(payload)) + payload + b"\xce")

        def frame(self):
            kind, _, size = struct.unpack(">BHI", self.rfile.read(7))
            return kind, self.rfile.read(size + 1)[:-1]

        def handle(self):
            assert self.rfile.read(8) == b"AMQP\0\0\x09\x01"
            self.method(10, 10, bytes([0, 9]) + struct.pack(">I", 0) * 3, 0)
            tag = 0
            while True:
                kind, payload = self.frame()
                r = _Reader(payload)
                what = r.number("H"), r.number("H")
                if what == (10, 11):
                    self.method(10, 30, struct.pack(">HIH", 1, 4096, 0), 0)
                elif what == (10, 40):
                    self.method(10, 41, _short(""), 0)
                elif what == (20, 10):
                    self.method(20, 11, struct.pack(">I", 0))
                elif what == (60, 70):
                    if not state["queue"]:
                        self.method(60, 72, _short(""))
                        continue
                    body = state["queue"].pop(0)
                    tag += 1
                    self.method(60, 71, struct.pack(">QB", tag, 0) + _short("ex") + _short("rk") + struct.pack(">I", 0))
                    table = _short("h") + b"S" + struct.pack(">I", 1) + b"v" + _short("n") + b"I" + struct.pack(">i", -7)
                    head = struct.pack(">HHQH", 60, 0, len(body), 1 << 13 | 1 << 7 | 1 << 6) + struct.pack(">I", len(table)) + table + _short(f"id{tag}") + struct.pack(">Q", 1700000000)
                    self.wfile.write(struct.pack(">BHI", 2, 1, len(head)) + head + b"\xce" + struct.pack(">BHI", 3, 1, len(body)) + body + b"\xce")
                elif what in ((60, 80), (60, 120)):
                    state["settled"].append((what[1] == 80, r.number("Q")))
                elif what == (85, 10):
                    self.method(85, 11)
                elif what == (60, 40):
                    r.number("H")
                    exchange, key = r.short(), r.short()
                    size = struct.unpack_from(">Q", self.frame()[1], 4)[0]
                    body = b""
                    while len(body) < size:
                        body += self.frame()[1]
                    state["published"].append((exchange, key, body))
                    tag += 1
                    if key == "nowhere":
                        self.method(60, 50, struct.pack(">H", 312) + _short("NO_ROUTE") + _short(exchange) + _short(key))
                        head = struct.pack(">HHQH", 60, 0, 0, 0)
                        self.wfile.write(struct.pack(">BHI", 2, 1, len(head)) + head + b"\xce")
                    self.method(60, 80, struct.pack(">QB", tag, 0))
                elif what == (10, 50):
                    return

    s = served(socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler))
    yield f"amqp://u:p@127.0.0.1:{s.server_address[1]}/v", state
    s.shutdown()


def test_rabbitmq(spark, rabbit, tmp_path):
    url, state = rabbit
    out = tmp_path / "o.parquet"
    run(spark, pipeline(("s", "src.queue.rabbitmq", {"url": url, "queue": "q"}), ("w", "snk.file.parquet", {"path": str(out)})))
    rows = spark.read.parquet(str(out)).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(5)) and (rows[0]._message_id, rows[0]._headers, rows[0]._exchange) == ("id1", '{"h": "v", "n": -7}', "ex")
    assert state["settled"] == [(True, 5)]
    state["queue"].append(b'{"n": 9}')
    with pytest.raises(RunFailed):
        run(spark, pipeline(("s", "src.queue.rabbitmq", {"url": url, "queue": "q"}), ("f", "ctl.fail", {"message": "no"})))
    for _ in range(50):  # the server reads what was sent before the connection was closed
        if len(state["settled"]) > 1:
            break
        time.sleep(0.1)
    assert state["settled"][1:] == [(False, 1)]
    run(spark, pipeline(ROWS, ("w", "snk.queue.rabbitmq", {"url": url, "exchange": "e", "routing_key_column": "g"})))
    assert len(state["published"]) == 25 and {k for _, k, _ in state["published"]} == {"g0", "g1"}
    with pytest.raises(RunFailed, match="no queue takes"):
        run(spark, pipeline(ROWS, ("w", "snk.queue.rabbitmq", {"url": url, "routing_key": "nowhere"})))
    with pytest.raises(InvalidProperty):
        run(spark, pipeline(ROWS, ("w", "snk.queue.rabbitmq", {"url": url})))
