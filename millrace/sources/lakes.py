"""Delta and Iceberg tables, read from their logs where Spark has no reader for them.

The log tells which Parquet files the table's version holds; Spark reads those files. With the
format's own package on the class path that is used instead.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import Step, component, need, opt
from ..storage import exists, list_files, read_text


#: Reader features of Delta under which a table's files read as they are. Deletion vectors and column mapping are looked for by themselves.
_DELTA_FEATURES = {"deletionVectors", "columnMapping", "timestampNtz", "vacuumProtocolCheck"}


def has_format(spark: SparkSession, name: str) -> bool:
    try:
        spark.read.format(name)
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
        return True
    except Exception:
        return False


def delta_files(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, T.StructType, list[str]]:
    """(the actions add and remove that count, the schema, the partition columns) of a table's log.

    Commits are JSON lines numbered by version, after the last checkpoint, which is a Parquet file.
    The latest action on a path decides.
    """
    log = f"{root.rstrip('/')}/_delta_log"
    numbered = [(int(m[1]), x) for x in list_files(spark, f"{log}/*.json") if (m := re.search(r"/(\d{20})\.json$", x))]
    points = [(int(m[1]), x) for x in list_files(spark, f"{log}/*.parquet") if (m := re.search(r"/(\d{20})\.checkpoint(?:\.\d+\.\d+)?\.parquet$", x))]
    if version is not None:
        numbered, points = ([x for x in y if x[0] <= version] for y in (numbered, points))
    if not numbered and not points:
        raise FileNotFoundError(f"{root} is not a Delta table")
    start = max((v for v, _ in points), default=-1)
    action = "struct<path: string, partitionValues: map<string, string>, deletionVector: struct<storageType: string>>"
    schema = f"add {action}, remove struct<path: string>, metaData struct<schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>, protocol struct<minReaderVersion: int, readerFeatures: array<string>>"
    parts = []
    if commits := [x for v, x in numbered if v > start]:
        rows = spark.read.schema(schema).json(commits)
        parts.append(rows.withColumn("version", F.regexp_extract("_metadata.file_path", r"(\d{20})\.json$", 1).cast("long")))
    if base := [x for v, x in points if v == start]:
        parts.append(spark.read.schema(schema).parquet(*base).withColumn("version", F.lit(start).cast("long")))
    log_rows = reduce(lambda a, b: a.unionByName(b), parts)
    meta = log_rows.where("metaData IS NOT NULL").agg(F.max_by("metaData", "version")).first()[0]
    if meta is None:
        raise ValueError(f"{root}: the log holds no schema")
    protocol = log_rows.where("protocol IS NOT NULL").agg(F.max_by("protocol", "version")).first()[0]
    needs = sorted(set((protocol["readerFeatures"] if protocol else None) or []) - _DELTA_FEATURES)
    if ((meta["configuration"] or {}).get("delta.columnMapping.mode") or "none") != "none":
        needs.append("columnMapping")
    if needs:
        raise NotImplementedError(f"{root} needs {', '.join(needs)}: the package io.delta:delta-spark reads it")
    actions = log_rows.where("add IS NOT NULL OR remove IS NOT NULL").select(F.coalesce("add.path", "remove.path").alias("path"), F.struct("version", F.col("add").isNotNull().alias("live"), "add").alias("last"))
    last = actions.groupBy("path").agg(F.max_by("last", F.struct("last.version", "last.live")).alias("last")).where("last.live")
    live = last.select("path", F.col("last.add.partitionValues").alias("values"), F.col("last.add.deletionVector").alias("vector"))
    return live, T.StructType.fromJson(json.loads(meta["schemaString"])), list(meta["partitionColumns"] or [])


def read_delta_log(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    live, schema, by = delta_files(spark, root, version)
    files = live.collect()  # the names of the table's files, not its rows
    if any(f["vector"] is not None for f in files):
        raise NotImplementedError(f"{root} has deletion vectors: the package io.delta:delta-spark reads them")
    if not files:
        return spark.createDataFrame([], schema)
    base = root.rstrip("/")
    groups: dict[tuple, list[str]] = {}
    for f in files:
        path = unquote(f["path"])
        groups.setdefault(tuple((f["values"] or {}).get(c) for c in by), []).append(path if "://" in path or path.startswith("/") else f"{base}/{path}")
    stored = T.StructType([x for x in schema.fields if x.name not in by])
    parts = []
    for values, paths in groups.items():
        df = spark.read.schema(stored).parquet(*paths)
        for c, v in zip(by, values, strict=True):
            df = df.withColumn(c, F.lit(v).cast(schema[c].dataType))
        parts.append(df.select(*[F.col(f"`{x.name}`") for x in schema.fields]))
    return reduce(lambda a, b: a.union(b), parts)


@component("src.lake.delta", {"path": need("path"), "version": opt("integer")}, packages=("io.delta:delta-spark",))
def read_delta(step: Step) -> DataFrame:
    """A Delta table, at a version if one is given."""
    if has_format(step.spark, "delta"):
        reader = step.spark.read.format("delta")
        return (reader if step["version"] is None else reader.option("versionAsOf", step["version"])).load(step["path"])
    return read_delta_log(step.spark, step["path"], step["version"])


_ICEBERG = {"int": "int", "long": "bigint", "string": "string", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "binary": "binary", "uuid": "string", "time": "bigint"}


def metadata_file(spark: SparkSession, path: str, version: str | None) -> str:
    """The metadata file of a table's folder, or the path itself if it is one."""
    if path.endswith(".metadata.json"):
        return path
    folder = f"{path.rstrip('/')}/metadata"
    files = list_files(spark, f"{folder}/*.metadata.json")
    if version:
        files = [x for x in files if re.search(rf"/v?0*{re.escape(version)}(-[^/]*)?\.metadata\.json$", x)] or [x for x in files if version in x.rsplit("/", 1)[-1]]
    elif exists(spark, f"{folder}/version-hint.text"):
        hint = read_text(spark, f"{folder}/version-hint.text").strip()
        files = [x for x in files if x.endswith((f"/v{hint}.metadata.json", f"/{hint}.metadata.json"))]
    if not files:
        raise FileNotFoundError(f"{path} is not an Iceberg table" + (f" with version {version}" if version else ""))
    return max(files, key=lambda x: int(m[1]) if (m := re.search(r"/v?(\d+)[^/]*$", x)) else -1)


def read_iceberg_log(spark: SparkSession, path: str, version: str | None, moved: bool) -> DataFrame:
    """The current snapshot's files by way of its manifests, which are Avro. A snapshot with delete
    files is refused: their rows would come back."""
    if not has_format(spark, "avro"):
        raise ModuleNotFoundError("Iceberg tables need org.apache.iceberg:iceberg-spark-runtime or org.apache.spark:spark-avro on Spark's class path")
    where = metadata_file(spark, path, version)
    meta = json.loads(read_text(spark, where, 1 << 28))
    root = where.rsplit("/metadata/", 1)[0]

    def place(x: str) -> str:
        return root + x[len(meta["location"].rstrip("/")) :] if moved and x.startswith(meta["location"].rstrip("/")) else x

    current = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == meta.get("current-snapshot-id")), None)
    fields = next(s for s in meta["schemas"] if s["schema-id"] == meta["current-schema-id"])["fields"]
    schema = T.StructType.fromDDL(", ".join(f"`{f['name']}` {_ICEBERG.get(f['type'], f['type'])}" for f in fields))
    if current is None:
        return spark.createDataFrame([], schema)
    listed = spark.read.format("avro").load(place(current["manifest-list"])).select("manifest_path", "content").collect()
    manifests, deletes = ([place(r[0]) for r in listed if (r[1] == 0) == data] for data in (True, False))
    if deletes and not spark.read.format("avro").load(deletes).where("status != 2").isEmpty():
        raise NotImplementedError(f"{path} has delete files: the package org.apache.iceberg:iceberg-spark-runtime reads them, without version and allow_moved_paths")
    if not manifests:
        return spark.createDataFrame([], schema)
    entries = spark.read.format("avro").load(manifests).where("status != 2").select("data_file.file_path").collect()
    return spark.read.schema(schema).parquet(*[place(r[0]) for r in entries])


@component("src.lake.iceberg", {"path": need("path"), "version": opt(), "allow_moved_paths": opt("bool", False)}, packages=("org.apache.iceberg:iceberg-spark-runtime",))
def read_iceberg(step: Step) -> DataFrame:
    """An Iceberg table, at a metadata version if one is given; allow_moved_paths reads one that was
    moved from the place its metadata names."""
    if step["allow_moved_paths"] and step["path"].endswith(".metadata.json"):
        raise step.bad("allow_moved_paths", "needs the table's folder, not a metadata file")
    if has_format(step.spark, "iceberg") and not step["allow_moved_paths"] and not step["version"]:
        return step.spark.read.format("iceberg").load(step["path"])
    return read_iceberg_log(step.spark, step["path"], step["version"], step["allow_moved_paths"])
