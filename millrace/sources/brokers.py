"""Message brokers as bounded batches: from the saved position to what the broker holds at the start.

Every broker's messages have one shape, made by broker_rows(): its own underscore columns, and the
value as the fields of a JSON object, as text, or as bytes in base64.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import spark_type
from ..operators.relational import cast_column
from ..registry import Step, component, need, one_of, opt
from .files import typed_columns
from .lakes import has_format

FORMATS = one_of("json", "text", "bytes", default="json")


def broker_rows(messages: DataFrame, value_format: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Messages (`value` as binary, and underscore columns) as rows.

    json spreads an object into columns; a value that is no object, or a field with the name of one
    of the underscore columns, is an error. A null value is a row of the underscore columns alone.
    The fields are found by one pass over the values unless `columns` declares them.
    """
    own = [c for c in messages.columns if c != "value"]
    if value_format == "text":
        out = messages.withColumn("value", F.decode("value", "UTF-8")).select("value", *own)
    elif value_format == "bytes":
        out = messages.withColumn("value", F.base64("value")).select("value", *own)
    else:
        text = messages.withColumn("value", F.regexp_replace(F.decode("value", "UTF-8"), r"\A\s+", ""))
        bad = F.col("value").isNotNull() & (~F.col("value").startswith("{") | F.try_parse_json("value").isNull())
        text = text.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("the value is not a JSON object; use value_format text: "), F.substring("value", 1, 80)))).otherwise(F.col("value")))
        if columns:
            fields = T.StructType([T.StructField(c, T.StringType()) for c in columns if c not in own])
        else:
            lines = text.where("value IS NOT NULL").select("value")
            fields = messages.sparkSession.createDataFrame([], "value string").schema if lines.isEmpty() else _schema_of(lines)
            fields = fields if fields.names != ["value"] or not lines.isEmpty() else T.StructType([])
        clash = [f.name for f in fields if f.name in own]
        if clash:
            raise ValueError(f"the value has a field '{clash[0]}', which is a column this source adds; use value_format text")
        if not fields.fields:
            return text.select(*own)
        parsed = text.withColumn("value", F.from_json("value", fields, {"mode": "FAILFAST"}))
        out = parsed.select(*[F.col(f"value.`{f.name}`").alias(f.name) for f in fields], *own)
    kinds = {c: spark_type(k) for c, k in (columns or {}).items()}
    return typed_columns(out, kinds, lambda d, c, k: cast_column(F.col(f"`{c}`"), d.schema[c].dataType, k).alias(c))


def _schema_of(lines: DataFrame) -> T.StructType:
    """The union of the fields of all values."""
    ddl = lines.agg(F.schema_of_json_agg("value") if hasattr(F, "schema_of_json_agg") else F.expr("schema_of_variant_agg(parse_json(value))")).first()[0]
    return T.StructType.fromDDL(_ddl(ddl))


def _ddl(variant: str) -> str:
    """OBJECT<a: BIGINT, ...> of a variant schema as a list of columns."""
    text = variant.strip()
    inner = text[text.index("<") + 1 : -1] if "<" in text else ""
    out, depth, last = [], 0, 0
    for i, c in enumerate(inner + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            piece = inner[last:i].strip()
            if piece:
                name, kind = piece.split(": ", 1)
                kind = kind.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
                kind = "DOUBLE" if kind.startswith("DECIMAL") and not kind.endswith(",0)") else kind
                out.append(f"{name if name.startswith('`') else '`' + name + '`'} {kind}")
            last = i + 1
    return ", ".join(out)


# --- Kafka ------------------------------------------------------------------------------------------

_KAFKA_PACKAGE = "org.apache.spark:spark-sql-kafka-0-10_2.13"
_KAFKA = {
    "brokers": need(), "security": one_of("plaintext", "tls", "sasl_plaintext", "sasl_tls", default="plaintext"), "sasl_mechanism": one_of("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512", default="PLAIN"),
    "username": opt(), "password": opt(secret=True), "ca_cert": opt("path"), "timeout_ms": opt("integer", 30000), "topic": need(),
}


def kafka_options(p: dict[str, Any]) -> dict[str, str]:
    protocol = {"plaintext": "PLAINTEXT", "tls": "SSL", "sasl_plaintext": "SASL_PLAINTEXT", "sasl_tls": "SASL_SSL"}[p["security"]]
    out = {"kafka.bootstrap.servers": p["brokers"], "kafka.security.protocol": protocol, "kafka.request.timeout.ms": str(p["timeout_ms"])}
    if protocol.startswith("SASL"):
        module = "plain.PlainLoginModule" if p["sasl_mechanism"] == "PLAIN" else "scram.ScramLoginModule"
        out |= {"kafka.sasl.mechanism": p["sasl_mechanism"], "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.{module} required username="{p["username"]}" password="{p["password"]}";'}
    if p["ca_cert"]:
        out |= {"kafka.ssl.truststore.type": "PEM", "kafka.ssl.truststore.location": p["ca_cert"]}
    return out


def offset_ranges(first: dict[int, int], end: dict[int, int], saved: dict[int, int], start: str, most: int | None) -> dict[int, tuple[int, int]]:
    """The offsets of each partition that a run reads, from the first to before the second.

    A saved position goes on where it was; one before the first offset that is still there means lost
    messages and is an error. Partitions without one begin at `start`. Of `most` messages each
    partition gets an equal share, and what some do not need goes to the others, so that none starves.
    """
    begin = {p: saved.get(p, end[p] if start == "latest" else first[p]) for p in end}
    for p, at in begin.items():
        if at < first[p] or at > end[p]:
            raise ValueError(f"partition {p} has offsets {first[p]} to {end[p]}, but the saved position is {at}: messages were lost")
    stop, rest = {}, most
    order = sorted(end, key=lambda p: (end[p] - begin[p], p))
    for k, p in enumerate(order):
        n = end[p] - begin[p] if rest is None else min(end[p] - begin[p], -(-rest // (len(order) - k)))
        stop[p] = begin[p] + n
        rest = None if rest is None else rest - n
    return {p: (begin[p], stop[p]) for p in sorted(end)}


def _kafka(spark: SparkSession) -> str:
    if not has_format(spark, "kafka"):
        raise ModuleNotFoundError(f"kafka needs the package {_KAFKA_PACKAGE} on Spark's class path")
    return "kafka"


def topic_offsets(spark: SparkSession, options: dict[str, str], topic: str) -> tuple[dict[int, int], dict[int, int]]:
    """The first offset of each partition of a topic, and the one after its last, as the brokers tell them."""
    jvm = spark._jvm
    settings = jvm.java.util.Properties()
    for k, v in options.items():
        settings.put(k.removeprefix("kafka."), v)
    for side in ("key", "value"):
        settings.put(f"{side}.deserializer", "org.apache.kafka.common.serialization.ByteArrayDeserializer")
    consumer = jvm.org.apache.kafka.clients.consumer.KafkaConsumer(settings)
    try:
        parts = jvm.java.util.ArrayList()
        for info in consumer.partitionsFor(topic):
            parts.add(jvm.org.apache.kafka.common.TopicPartition(topic, info.partition()))
        told = (consumer.beginningOffsets(parts), consumer.endOffsets(parts))
        return tuple({p.partition(): int(offsets.get(p)) for p in parts} for offsets in told)
    finally:
        consumer.close()


@component("src.stream.kafka", {**_KAFKA, "start": one_of("earliest", "latest", default="earliest"), "max_records": opt("integer", 100000), "value_format": FORMATS, "columns": opt("map")}, packages=(_KAFKA_PACKAGE,))
def read_kafka(step: Step) -> DataFrame:
    """A topic's messages from the saved offsets to its end as it is now; lost messages are an error.

    The offsets are fixed before anything is read, and those are the next position: what arrives
    meanwhile is read by the next run. Nothing is sorted; a limit is shared out among the partitions.
    """
    saved = json.loads((step.context or {}).get("position") or "{}")
    options = kafka_options(step.props)
    source = _kafka(step.spark)
    first, end = topic_offsets(step.spark, options, step["topic"])
    ranges = offset_ranges(first, end, {int(k): int(v) for k, v in saved.items()}, step["start"], step["max_records"] or None)
    bounds = [json.dumps({step["topic"]: {str(p): r[k] for p, r in ranges.items()}}) for k in (0, 1)]
    df = step.spark.read.format(source).options(**options, subscribe=step["topic"], startingOffsets=bounds[0], endingOffsets=bounds[1], failOnDataLoss="true").load()
    if step.context is not None:
        step.context["set_position"](json.dumps({str(p): r[1] for p, r in ranges.items()}))
    messages = df.select("value", F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.col("timestamp").alias("_timestamp"), F.decode("key", "UTF-8").alias("_key"))
    return broker_rows(messages, step["value_format"], step["columns"])


@component("snk.stream.kafka", {**_KAFKA, "key_column": opt(), "batch_size": opt("integer", 500), "compression": one_of("none", "gzip", "snappy", "lz4", "zstd", default="none")}, packages=(_KAFKA_PACKAGE,), deferred=True)
def write_kafka(step: Step):
    """Rows to a topic as JSON, acknowledged by all replicas; partitions follow the key."""

    def run(df: DataFrame) -> None:
        value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")
        key = [F.col(f"`{step['key_column']}`").cast("string").alias("key")] if step["key_column"] else []
        options = kafka_options(step.props) | {"topic": step["topic"], "kafka.acks": "all", "kafka.compression.type": step["compression"]}
        df.select(*key, value).write.format(_kafka(step.spark)).options(**options).save()

    return run
