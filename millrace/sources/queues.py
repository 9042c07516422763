"""NATS, Kinesis, SQS, Pub/Sub and RabbitMQ: bounded batches in, batches out.

Messages are read by tasks into the shared folder (a range of sequences or a shard for each task
where the broker allows it) and read from there, so nothing is received twice. Queues hold what
was received until the run has delivered everything; then it is acknowledged, and given back if
the run fails.
"""

from __future__ import annotations

import base64
import json
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import InvalidProperty, Step, component, need, one_of, opt
from ..storage import new_path
from .brokers import FORMATS, broker_rows
from .wire import Amqp, BrokerError, Nats, aws_call, aws_settings, batches, google_token, pubsub_call

_READ = {"max_records": opt("integer", 100000), "value_format": FORMATS, "columns": opt("map")}
_HELD = {"max_records": opt("integer", 10000), "max_wait_ms": opt("integer", 30000), "value_format": FORMATS, "columns": opt("map")}


def _positive(*names: str):
    def check(node: str, p: dict[str, Any]) -> None:
        for n in names:
            if p.get(n) is not None and p[n] < 1:
                raise InvalidProperty(node, n, "must be at least 1")

    return check


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Messages written once to the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _frame(rows: list[dict[str, Any]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _by_tasks(step: Step, parts: DataFrame, read: Callable[[dict[str, Any]], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """The messages that `read` gives for each row of parts, one task for each."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame.to_dict("records"):
                for block in batches(read(part), 1000, weigh=lambda x: 1):
                    yield _frame(block, names)

    return _kept(parts.mapInPandas(run, schema), step.component.replace(".", "_"))


def _lines(df: DataFrame, *extra: str) -> DataFrame:
    """Each row as JSON (`value`), and the columns that address it as text."""
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")
    return df.select(value, *[(F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(f"x{i}") for i, c in enumerate(extra)])


def _sent(df: DataFrame, send: Callable[[Iterator[tuple[Any, ...]]], int], tasks: int | None = None) -> int:
    """Rows sent by tasks; how many. A delivery is not a transaction: a failed task may have sent some."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [send(r for f in frames for r in f.itertuples(index=False, name=None))]})

    df = df.coalesce(tasks) if tasks else df
    return sum(r[0] for r in df.mapInPandas(run, "n long").collect())


def _need_column(step: Step, df: DataFrame, *names: str) -> None:
    for n in names:
        if step[n] and step[n] not in df.columns:
            raise step.bad(n, f"there is no column {step[n]}")


# --- NATS -------------------------------------------------------------------------------------------

_NATS = {
    "url": need(), "auth": one_of("none", "user_password", "token", default="none"), "username": opt(), "password": opt(secret=True), "token": opt(secret=True), "tls": opt("bool", False),
    "ca_cert": opt("path"), "timeout_ms": opt("integer", 30000),
}


@component("src.stream.nats", {**_NATS, "stream": need(), "filter_subject": opt(), "start": one_of("earliest", "latest", default="earliest"), "partitions": opt("integer", 4), **_READ}, check=_positive("max_records", "partitions"))
def read_nats(step: Step) -> DataFrame:
    """A stream's messages from the saved sequence to its last; ones discarded before they were read are an error."""
    p = dict(step.props)
    client = Nats(p)
    try:
        state = client.ask(f"$JS.API.STREAM.INFO.{p['stream']}")["state"]
    finally:
        client.close()
    saved = (step.context or {}).get("position")
    first, last = int(state["first_seq"]), int(state["last_seq"])
    start = int(saved) + 1 if saved else first if p["start"] == "earliest" else last + 1
    if saved and start < first:
        raise BrokerError(f"stream {p['stream']}: sequences {start} to {first - 1} were discarded before they were read")
    end = min(last, start + p["max_records"] - 1)
    n = max(1, min(p["partitions"], end - start + 1))
    bounds = [(start + (end - start + 1) * i // n, start + (end - start + 1) * (i + 1) // n) for i in range(n)] if end >= start else []
    schema = "value binary, _stream string, _subject string, _sequence long, _timestamp string, _headers string"

    def read(part: dict[str, Any]) -> Iterator[dict[str, Any]]:
        own = Nats(p)
        try:
            at, stop = int(part["a"]), int(part["b"])
            while at < stop:
                body = {"seq": at, "next_by_subj": p["filter_subject"] or ">"}
                try:
                    m = own.ask(f"$JS.API.STREAM.MSG.GET.{p['stream']}", body)["message"]
                except BrokerError as e:
                    if e.kind in ("10037", "404"):  # nothing at or after it: the rest was deleted
                        return
                    raise
                if m["seq"] >= stop:
                    return
                yield {"value": base64.b64decode(m.get("data", "")), "_stream": p["stream"], "_subject": m["subject"], "_sequence": m["seq"], "_timestamp": m["time"], "_headers": base64.b64decode(m["hdrs"]).decode() if m.get("hdrs") else None}
                at = m["seq"] + 1
        finally:
            own.close()

    parts = step.spark.createDataFrame(bounds, "a long, b long").repartition(n)
    messages = _by_tasks(step, parts, read, schema).withColumn("_timestamp", F.to_timestamp("_timestamp"))
    if step.context is not None and end >= start:
        step.context["set_position"](str(end))
    return broker_rows(messages, p["value_format"], p["columns"])


@component("snk.stream.nats", {**_NATS, "subject": need(), "batch_size": opt("integer", 500), "msg_id_column": opt()}, check=_positive("batch_size"), deferred=True)
def write_nats(step: Step):
    """Rows to a subject as JSON, each acknowledged by its stream; msg_id_column lets the stream leave out repeats."""
    p = dict(step.props)

    def send(rows: Iterator[tuple[Any, ...]]) -> int:
        client, done = Nats(p), 0
        try:
            for block in batches(rows, p["batch_size"], weigh=lambda x: 1):
                for value, key in block:
                    client.publish(p["subject"], value.encode(), {"Nats-Msg-Id": key} if key is not None else None)
                for _ in block:
                    _, reply = client.answer()
                    if reply.get("error"):
                        raise BrokerError(f"after {done} rows: {reply['error'].get('description')}")
                    done += 1
        finally:
            client.close()
        return done

    def run(df: DataFrame) -> int:
        _need_column(step, df, "msg_id_column")
        return _sent(_lines(df, p["msg_id_column"] or ""), send)

    return run


# --- Kinesis ----------------------------------------------------------------------------------------

_AWS = {
    "region": opt(), "profile": opt(), "access_key_id": opt(), "secret_access_key": opt(secret=True), "session_token": opt(secret=True), "endpoint": opt(), "timeout_ms": opt("integer", 30000), "retries": opt("integer", 5),
}


@component("src.stream.kinesis", {**_AWS, "stream": need(), "start": one_of("earliest", "latest", default="earliest"), "on_expired": one_of("fail", "continue", default="fail"), **_READ}, check=_positive("max_records"))
def read_kinesis(step: Step) -> DataFrame:
    """A stream's records from each shard's saved position to its end, a task for each shard."""
    p = dict(step.props)
    s = aws_settings(p)
    shards, token = [], None
    while True:
        page = aws_call(p, s, "kinesis", "Kinesis_20131202.ListShards", {"NextToken": token} if token else {"StreamName": p["stream"]})
        shards += [x["ShardId"] for x in page["Shards"]]
        token = page.get("NextToken")
        if not token:
            break
    saved = json.loads((step.context or {}).get("position") or "{}")
    share = -(-p["max_records"] // max(1, len(shards)))
    schema = "value binary, _stream string, _shard string, _sequence string, _timestamp double, _partition_key string"

    def iterator_of(shard: str, position: str | None) -> str:
        ask = {"StreamName": p["stream"], "ShardId": shard}
        ask |= {"ShardIteratorType": "AFTER_SEQUENCE_NUMBER", "StartingSequenceNumber": position} if position else {"ShardIteratorType": "TRIM_HORIZON" if p["start"] == "earliest" or saved else "LATEST"}
        return aws_call(p, s, "kinesis", "Kinesis_20131202.GetShardIterator", ask)["ShardIterator"]

    def read(part: dict[str, Any]) -> Iterator[dict[str, Any]]:
        shard, position, n = part["shard"], part["position"], 0
        try:
            at = iterator_of(shard, position)
        except BrokerError as e:
            if p["on_expired"] != "continue" or e.kind not in ("InvalidArgumentException", "ResourceNotFoundException"):
                raise
            at = iterator_of(shard, None)
        while at and n < share:
            page = aws_call(p, s, "kinesis", "Kinesis_20131202.GetRecords", {"ShardIterator": at, "Limit": min(10000, share - n)})
            for r in page["Records"]:
                n += 1
                yield {"value": base64.b64decode(r["Data"]), "_stream": p["stream"], "_shard": shard, "_sequence": r["SequenceNumber"], "_timestamp": float(r["ApproximateArrivalTimestamp"]), "_partition_key": r["PartitionKey"]}
            if not page["Records"] and not page.get("MillisBehindLatest"):
                return
            at = page.get("NextShardIterator")

    parts = step.spark.createDataFrame([(x, saved.get(x)) for x in shards], "shard string, position string").repartition(max(1, len(shards)), "shard")
    messages = _by_tasks(step, parts, read, schema).withColumn("_timestamp", F.timestamp_micros((F.col("_timestamp") * 1e6).cast("long")))
    if step.context is not None:
        top = messages.groupBy("_shard").agg(F.max(F.struct(F.length("_sequence"), "_sequence")).alias("m")).select("_shard", "m._sequence").collect()  # a row for each shard
        step.context["set_position"](json.dumps({**saved, **{r[0]: r[1] for r in top}}))
    return broker_rows(messages, p["value_format"], p["columns"])


@component("snk.stream.kinesis", {**_AWS, "stream": need(), "partition_key_column": opt(), "batch_size": opt("integer", 500)}, check=_positive("batch_size"), deferred=True)
def write_kinesis(step: Step):
    """Rows to a stream, 500 and five mebibytes a call at most; only throttled records are sent again."""
    p = dict(step.props)
    s = aws_settings(p)

    def send(rows: Iterator[tuple[Any, ...]]) -> int:
        done = 0
        weigh = lambda r: len(r[0].encode()) + 300
        for block in batches(rows, min(500, p["batch_size"]), 5 << 20, weigh):
            for value, _ in block:
                if len(value.encode()) > 1 << 20:
                    raise BrokerError(f"after {done} rows: a row is over a mebibyte")
            left = [{"Data": base64.b64encode(v.encode()).decode(), "PartitionKey": k if k is not None else str(done + i)} for i, (v, k) in enumerate(block)]
            for attempt in range(p["retries"] + 1):
                reply = aws_call(p, s, "kinesis", "Kinesis_20131202.PutRecords", {"StreamName": p["stream"], "Records": left})
                left = [r for r, x in zip(left, reply["Records"], strict=True) if x.get("ErrorCode")]
                if not left:
                    break
                time.sleep(min(0.2 * 2**attempt, 5))
            if left:
                raise BrokerError(f"after {done} rows: {len(left)} records are still refused")
            done += len(block)
        return done

    def run(df: DataFrame) -> int:
        _need_column(step, df, "partition_key_column")
        return _sent(_lines(df, p["partition_key_column"] or ""), send)

    return run


# --- SQS and Pub/Sub: messages on loan ----------------------------------------------------------------


class Lease:
    """Keeps messages from going back to their queue while the run lasts."""

    def __init__(self, every: float, extend: Callable[[], None]):
        self.stopped = threading.Event()

        def keep() -> None:
            while not self.stopped.wait(every):
                extend()

        threading.Thread(target=keep, daemon=True).start()

    def end(self) -> None:
        self.stopped.set()


def _loan(step: Step, messages: DataFrame, settle: Callable[[list[str], bool], None], extend: Callable[[list[str]], None], every: float) -> DataFrame:
    """Registers what happens to the messages when the run ends; max_records bounds their receipts."""
    if step.context is not None:
        receipts = [r[0] for r in messages.select("_receipt").collect()]
        lease = Lease(every, lambda: extend(receipts))

        def done(ok: bool) -> None:
            lease.end()
            settle(receipts, ok)

        step.context["settle"](done)
    return messages.drop("_receipt")


def _queue_check(node: str, p: dict[str, Any]) -> None:
    if bool(p["queue_url"]) == bool(p["queue"]):
        raise InvalidProperty(node, "queue_url", "give either queue_url or queue")


_SQS = {**_AWS, "queue_url": opt(), "queue": opt(), "queue_owner": opt()}


def _queue_url(p: dict[str, Any], s: dict[str, Any]) -> str:
    if p["queue_url"]:
        return p["queue_url"]
    ask = {"QueueName": p["queue"]} | ({"QueueOwnerAWSAccountId": p["queue_owner"]} if p["queue_owner"] else {})
    return aws_call(p, s, "sqs", "AmazonSQS.GetQueueUrl", ask)["QueueUrl"]


@component("src.queue.sqs", {**_SQS, **_HELD, "visibility_seconds": opt("integer", 300)}, check=_queue_check)
def read_sqs(step: Step) -> DataFrame:
    """A queue's messages until it is empty, held while the run lasts and deleted once everything is delivered."""
    p = dict(step.props)
    s = aws_settings(p)
    url = _queue_url(p, s)
    schema = "value binary, _queue string, _message_id string, _sent_timestamp long, _receive_count long, _group_id string, _attributes string, _receipt string"

    def read(part: dict[str, Any]) -> Iterator[dict[str, Any]]:
        n, stop = 0, time.monotonic() + p["max_wait_ms"] / 1000
        while n < p["max_records"]:
            wait = max(0, min(20, int(stop - time.monotonic())))
            got = aws_call(p, s, "sqs", "AmazonSQS.ReceiveMessage", {"QueueUrl": url, "MaxNumberOfMessages": min(10, p["max_records"] - n), "VisibilityTimeout": p["visibility_seconds"], "WaitTimeSeconds": wait, "AttributeNames": ["All"], "MessageAttributeNames": ["All"]}).get("Messages") or []
            if not got:
                return
            for m in got:
                n += 1
                a = m.get("Attributes") or {}
                yield {"value": m["Body"].encode(), "_queue": url.rsplit("/", 1)[-1], "_message_id": m["MessageId"], "_sent_timestamp": int(a["SentTimestamp"]) if "SentTimestamp" in a else None, "_receive_count": int(a.get("ApproximateReceiveCount", 1)), "_group_id": a.get("MessageGroupId"), "_attributes": json.dumps({k: v.get("StringValue") for k, v in m["MessageAttributes"].items()}) if m.get("MessageAttributes") else None, "_receipt": m["ReceiptHandle"]}

    messages = _by_tasks(step, step.spark.range(1), read, schema).withColumn("_sent_timestamp", F.timestamp_millis("_sent_timestamp"))

    def visibility(receipts: list[str], seconds: int) -> None:
        for block in batches(iter(receipts), 10, weigh=lambda x: 1):
            aws_call(p, s, "sqs", "AmazonSQS.ChangeMessageVisibilityBatch", {"QueueUrl": url, "Entries": [{"Id": str(i), "ReceiptHandle": r, "VisibilityTimeout": seconds} for i, r in enumerate(block)]})

    def settle(receipts: list[str], ok: bool) -> None:
        if not ok:
            return visibility(receipts, 0)
        for block in batches(iter(receipts), 10, weigh=lambda x: 1):
            reply = aws_call(p, s, "sqs", "AmazonSQS.DeleteMessageBatch", {"QueueUrl": url, "Entries": [{"Id": str(i), "ReceiptHandle": r} for i, r in enumerate(block)]})
            if reply.get("Failed"):
                raise BrokerError(f"{len(reply['Failed'])} messages could not be deleted")

    kept = _loan(step, messages, settle, lambda r: visibility(r, p["visibility_seconds"]), p["visibility_seconds"] / 3)
    return broker_rows(kept, p["value_format"], p["columns"])


@component("snk.queue.sqs", {**_SQS, "message_group_id_column": opt(), "deduplication_id_column": opt(), "delay_seconds": opt("integer")}, check=_queue_check, deferred=True)
def write_sqs(step: Step):
    """Rows to a queue, ten a call; a .fifo queue needs message_group_id_column and is sent to by one task, in order."""
    p = dict(step.props)
    s = aws_settings(p)

    def run(df: DataFrame) -> int:
        _need_column(step, df, "message_group_id_column", "deduplication_id_column")
        url = _queue_url(p, s)
        fifo = url.endswith(".fifo")
        if fifo and not p["message_group_id_column"]:
            raise step.bad("message_group_id_column", "is required for a .fifo queue")
        if fifo and p["delay_seconds"] is not None:
            raise step.bad("delay_seconds", "cannot be set for the messages of a .fifo queue")

        def send(rows: Iterator[tuple[Any, ...]]) -> int:
            done = 0
            for block in batches(rows, 10, 256 << 10, lambda r: len(r[0].encode())):
                entries = [{"Id": str(i), "MessageBody": v} | ({"MessageGroupId": g} if g is not None else {}) | ({"MessageDeduplicationId": d} if d is not None else {}) | ({"DelaySeconds": p["delay_seconds"]} if p["delay_seconds"] is not None else {}) for i, (v, g, d) in enumerate(block)]
                reply = aws_call(p, s, "sqs", "AmazonSQS.SendMessageBatch", {"QueueUrl": url, "Entries": entries})
                if reply.get("Failed"):
                    raise BrokerError(f"after {done} rows: {reply['Failed'][0].get('Message')}")
                done += len(block)
            return done

        return _sent(_lines(df, p["message_group_id_column"] or "", p["deduplication_id_column"] or ""), send, 1 if fifo else None)

    return run


_PUBSUB = {"project": opt(), "credentials_file": opt("path"), "endpoint": opt(), "timeout_ms": opt("integer", 30000), "retries": opt("integer", 5)}


def _full(p: dict[str, Any], kind: str, name: str) -> str:
    if name.startswith("projects/"):
        return name
    if not p["project"]:
        raise BrokerError(f"set project, or give {kind} in full: projects/.../{kind}/...")
    return f"projects/{p['project']}/{kind}/{name}"


@component("src.queue.pubsub", {**_PUBSUB, "subscription": need(), **_HELD, "ack_deadline_seconds": opt("integer", 60)}, check=_positive("max_records"))
def read_pubsub(step: Step) -> DataFrame:
    """A subscription's messages, held while the run lasts and acknowledged once everything is delivered."""
    p = dict(step.props)
    token, name = google_token(step.spark, p), _full(p, "subscriptions", p["subscription"])
    schema = "value binary, _subscription string, _message_id string, _publish_time string, _ordering_key string, _attributes string, _delivery_attempt long, _receipt string"

    def read(part: dict[str, Any]) -> Iterator[dict[str, Any]]:
        n, stop = 0, time.monotonic() + p["max_wait_ms"] / 1000
        while n < p["max_records"] and time.monotonic() < stop:
            got = pubsub_call(p, token, f"{name}:pull", {"maxMessages": min(1000, p["max_records"] - n)}).get("receivedMessages") or []
            if not got:
                return
            pubsub_call(p, token, f"{name}:modifyAckDeadline", {"ackIds": [m["ackId"] for m in got], "ackDeadlineSeconds": p["ack_deadline_seconds"]})
            for m in got:
                n += 1
                x = m["message"]
                yield {"value": base64.b64decode(x["data"]) if x.get("data") else None, "_subscription": name.rsplit("/", 1)[-1], "_message_id": x["messageId"], "_publish_time": x.get("publishTime"), "_ordering_key": x.get("orderingKey"), "_attributes": json.dumps(x["attributes"]) if x.get("attributes") else None, "_delivery_attempt": m.get("deliveryAttempt"), "_receipt": m["ackId"]}

    messages = _by_tasks(step, step.spark.range(1), read, schema).withColumn("_publish_time", F.to_timestamp("_publish_time"))

    def deadline(receipts: list[str], seconds: int) -> None:
        for block in batches(iter(receipts), 1000, weigh=lambda x: 1):
            pubsub_call(p, token, f"{name}:modifyAckDeadline", {"ackIds": block, "ackDeadlineSeconds": seconds})

    def settle(receipts: list[str], ok: bool) -> None:
        if not ok:
            return deadline(receipts, 0)
        for block in batches(iter(receipts), 1000, weigh=lambda x: 1):
            pubsub_call(p, token, f"{name}:acknowledge", {"ackIds": block})

    kept = _loan(step, messages, settle, lambda r: deadline(r, p["ack_deadline_seconds"]), p["ack_deadline_seconds"] / 3)
    return broker_rows(kept, p["value_format"], p["columns"])


@component("snk.queue.pubsub", {**_PUBSUB, "topic": need(), "ordering_key_column": opt(), "attributes_column": opt()}, deferred=True)
def write_pubsub(step: Step):
    """Rows to a topic, a thousand and ten megabytes a call at most; with an ordering key by one task, in order."""
    p = dict(step.props)

    def run(df: DataFrame) -> int:
        _need_column(step, df, "ordering_key_column", "attributes_column")
        token, name = google_token(step.spark, p), _full(p, "topics", p["topic"])
        attributes = p["attributes_column"]
        body = df.drop(attributes) if attributes else df
        lines = df.select(
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in body.columns]), {"ignoreNullFields": "false"}).alias("value"),
            (F.col(f"`{p['ordering_key_column']}`").cast("string") if p["ordering_key_column"] else F.lit(None).cast("string")).alias("x0"),
            (F.col(f"`{attributes}`").cast("string") if attributes and dict(df.dtypes)[attributes] == "string" else F.to_json(f"`{attributes}`") if attributes else F.lit(None).cast("string")).alias("x1"),
        )

        def send(rows: Iterator[tuple[Any, ...]]) -> int:
            done = 0
            for block in batches(rows, 1000, 9_000_000, lambda r: len(r[0].encode()) * 4 // 3 + 200):
                messages = [{"data": base64.b64encode(v.encode()).decode()} | ({"orderingKey": k} if k is not None else {}) | ({"attributes": {a: str(b) for a, b in json.loads(x).items()}} if x is not None else {}) for v, k, x in block]
                try:
                    pubsub_call(p, token, f"{name}:publish", {"messages": messages})
                except BrokerError as e:
                    raise BrokerError(f"after {done} rows: {e}") from None
                done += len(block)
            return done

        return _sent(lines, send, 1 if p["ordering_key_column"] else None)

    return run


# --- RabbitMQ ------------------------------------------------------------------------------------------

_RABBIT = {"url": need(), "username": opt(), "password": opt(secret=True), "vhost": opt(), "ca_cert": opt("path"), "timeout_ms": opt("integer", 30000)}


@component("src.queue.rabbitmq", {**_RABBIT, "queue": need(), **_HELD}, check=_positive("max_records"))
def read_rabbitmq(step: Step) -> DataFrame:
    """A queue's messages until it is empty, acknowledged once everything is delivered.

    AMQP holds messages for as long as the channel that took them is open, so the driver holds it
    and takes them, max_records at most.
    """
    p = dict(step.props)
    client = Amqp(p)
    rows, last = [], None
    stop = time.monotonic() + p["max_wait_ms"] / 1000
    while len(rows) < p["max_records"] and time.monotonic() < stop and (m := client.get(p["queue"])):
        last = m["tag"]
        rows.append((bytearray(m["body"]), p["queue"], m["exchange"], m["routing_key"], m["redelivered"], m.get("message_id"), m.get("timestamp"), json.dumps(m["headers"]) if m.get("headers") else None))
    schema = "value binary, _queue string, _exchange string, _routing_key string, _redelivered boolean, _message_id string, _timestamp long, _headers string"
    messages = _kept(step.spark.createDataFrame(rows, schema), "rabbitmq").withColumn("_timestamp", F.timestamp_seconds("_timestamp"))

    def done(ok: bool) -> None:
        if last is not None:
            client.settle(last, ok)
        client.close()

    if step.context is not None:
        step.context["settle"](done)
    else:
        done(False)
    return broker_rows(messages, p["value_format"], p["columns"])


def _route_check(node: str, p: dict[str, Any]) -> None:
    if p["routing_key"] and p["routing_key_column"]:
        raise InvalidProperty(node, "routing_key", "give either routing_key or routing_key_column")
    if not p["exchange"] and not p["routing_key"] and not p["routing_key_column"]:
        raise InvalidProperty(node, "routing_key", "is required for the default exchange: the queue's name")


@component("snk.queue.rabbitmq", {**_RABBIT, "exchange": opt("text", ""), "routing_key": opt(), "routing_key_column": opt(), "persistent": opt("bool", True)}, check=_route_check, deferred=True)
def write_rabbitmq(step: Step):
    """Rows to an exchange, confirmed by the broker every thousand; a message that no queue takes is an error."""
    p = dict(step.props)

    def send(rows: Iterator[tuple[Any, ...]]) -> int:
        client, done = Amqp(p), 0
        try:
            client.confirm()
            for block in batches(rows, 1000, weigh=lambda x: 1):
                for value, key in block:
                    client.publish(p["exchange"] or "", key if key is not None else p["routing_key"] or "", value.encode(), p["persistent"])
                try:
                    client.confirmed()
                except BrokerError as e:
                    raise BrokerError(f"after {done} rows: {e}") from None
                done += len(block)
        finally:
            client.close()
        return done

    def run(df: DataFrame) -> int:
        _need_column(step, df, "routing_key_column")
        return _sent(_lines(df, p["routing_key_column"] or ""), send)

    return run
