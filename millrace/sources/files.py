"""CSV, Parquet and JSON files, on any file system Spark reads, and single-file sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import Step, component, need, one_of, opt
from ..storage import delete, exists, joined, joined_parquet, list_files, new_path, read_text, replace_file

MODES = ("overwrite", "error_if_exists")
CODECS = {"lz4": "lz4_raw"}


def sniff(text: str) -> str:
    """The delimiter that splits the first lines most evenly."""
    lines = [x for x in text.splitlines()[:20] if x]
    best, score = ",", 0.0
    for d in ",\t;|":
        counts = [line.count(d) for line in lines]
        if counts and min(counts) > 0:
            even = counts.count(max(set(counts), key=counts.count)) / len(counts)
            if even * min(counts) > score:
                best, score = d, even * min(counts)
    return best


def _paths(step: Step) -> str:
    return step["path"]


def csv_reader(spark: SparkSession, path: str, header: bool, delimiter: str | None, multiline: bool = False) -> DataFrame:
    if not delimiter:
        files = list_files(spark, path)
        delimiter = sniff(read_text(spark, files[0])) if files else ","
    reader = spark.read.options(header=header, sep=delimiter, escape='"', inferSchema=True, multiLine=multiline, mode="FAILFAST", prefersDate=True, timestampNTZFormat="yyyy-MM-dd[ ]['T']HH:mm:ss[.SSSSSS]")
    return naive_times(reader.csv(path))


@component("src.file.csv", {"path": need("path"), "header": opt("bool", True), "delimiter": opt(), "multiline": opt("bool", False)})
def read_csv(step: Step) -> DataFrame:
    """CSV files; the delimiter is found from the first lines if it is not given.

    Files are split among tasks unless multiline=true, which reads quoted line ends.
    """
    return csv_reader(step.spark, _paths(step), step["header"], step["delimiter"], step["multiline"])


@component("src.file.parquet", {"path": need("path")})
def read_parquet(step: Step) -> DataFrame:
    """Parquet files; filters and columns reach the scan."""
    return step.spark.read.parquet(_paths(step))


def _json_reader(spark: SparkSession, ignore_errors: bool) -> DataFrameReader:
    return spark.read.options(mode="DROPMALFORMED" if ignore_errors else "FAILFAST", inferTimestamp=True, prefersDecimal=False)


def narrow_dates(df: DataFrame, source: Callable[[], DataFrame]) -> DataFrame:
    """Timestamp columns whose texts are all bare dates become dates."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)]
    if not times:
        return df
    texts = source()
    tests = [F.coalesce(F.bool_and(F.col(f"`{c}`").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False)).alias(f"c{i}") for i, c in enumerate(times)]
    bare = texts.agg(*tests).first()
    dates = {c for c, yes in zip(times, bare, strict=True) if yes}
    return df.select(*[F.col(f"`{c}`").cast("date").alias(c) if c in dates else F.col(f"`{c}`") for c in df.columns])


def naive_times(df: DataFrame) -> DataFrame:
    """Inferred timestamps without a zone, as they are in the files."""
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if c in times else F.col(f"`{c}`") for c in df.columns]) if times else df


def first_record(text: str) -> list[str]:
    """The keys of the first JSON object in the text, in order."""
    at = text.find("{")
    try:
        found = json.JSONDecoder().raw_decode(text, at)[0] if at >= 0 else {}
    except ValueError:
        return []
    return list(found) if isinstance(found, dict) else []


def in_file_order(df: DataFrame, files: list[str]) -> DataFrame:
    """Columns as the first record has them, others after; Spark sorts them by name."""
    keys = first_record(read_text(df.sparkSession, files[0])) if files else []
    keys = [k for k in keys if k in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*keys, *(c for c in df.columns if c not in keys)]])


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


@component("src.file.jsonl", {"path": need("path"), "ignore_errors": opt("bool", False)})
def read_jsonl(step: Step) -> DataFrame:
    """Files of one JSON object a line; a line that is none is an error, or left out with ignore_errors."""
    reader = _json_reader(step.spark, step["ignore_errors"])
    df = reader.json(_paths(step))
    df = in_file_order(df, list_files(step.spark, _paths(step)))
    return naive_times(narrow_dates(df, lambda: step.spark.read.schema(_as_text(df.schema)).json(_paths(step))))


@component("src.file.json", {"path": need("path"), "ignore_errors": opt("bool", False)})
def read_json(step: Step) -> DataFrame:
    """Files that hold one JSON array of objects."""
    for file in list_files(step.spark, _paths(step)):
        if not read_text(step.spark, file, 4096).lstrip("\ufeff \t\r\n").startswith("["):
            raise step.bad("path", f"{file} does not hold a JSON array; src.file.jsonl reads one object a line")
    df = _json_reader(step.spark, step["ignore_errors"]).option("multiLine", True).json(_paths(step))
    df = in_file_order(df, list_files(step.spark, _paths(step)))
    return naive_times(narrow_dates(df, lambda: step.spark.read.schema(_as_text(df.schema)).option("multiLine", True).json(_paths(step))))


def typed_columns(df: DataFrame, columns: dict[str, str] | None, casts) -> DataFrame:
    """Exactly the declared columns, cast; a column the source lacks is null."""
    if not columns:
        return df
    return df.select(*[casts(df, c, kind) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])


# --- sinks -------------------------------------------------------------------------------------


def refuse_existing(step: Step) -> None:
    """error_if_exists is decided before anything runs; it does not look at remote addresses."""
    if step["mode"] == "error_if_exists" and "://" not in step["path"] and exists(step.spark, step["path"]):
        raise FileExistsError(f"{step['path']} exists")


Join = Callable[[SparkSession, list[str], str], None]


def one_file(spark: SparkSession, df: DataFrame, path: str, write: Callable[[DataFrame, str], None], join: Join = joined) -> None:
    """Writes df as one file: tasks write files beside the target, which are put together as they are and
    then moved over it. No task has more than its own rows."""
    made = new_path(spark, "sink")
    try:
        write(df, f"{made}/parts")
        parts = list_files(spark, f"{made}/parts/part-*")
        if not parts:
            raise OSError(f"nothing was written for {path}")
        whole = f"{made}/whole"
        join(spark, parts, whole)
        replace_file(spark, whole, path)
    finally:
        delete(spark, made)


def deliver(step: Step, df: DataFrame, write: Callable[[DataFrame, str], None], join: Join = joined, part: Callable[[DataFrame, str], None] | None = None) -> None:
    """One file, or with layout=folder a folder of one for each task. `part` writes the files that join
    puts together, where these are not those of a folder."""
    refuse_existing(step)
    if step["layout"] == "folder":
        write(df, step["path"])
    else:
        one_file(step.spark, df, step["path"], part or write, join)


_SINK = {"path": need("path"), "mode": one_of(*MODES, default="overwrite"), "layout": one_of("file", "folder", default="file", doc="one file, or a folder written by all tasks")}


@component("snk.file.parquet", {**_SINK, "compression": one_of("zstd", "snappy", "gzip", "brotli", "lz4", "uncompressed", default="zstd")})
def write_parquet(step: Step):
    """A Parquet file."""
    codec = CODECS.get(step["compression"], step["compression"])
    return lambda df: deliver(step, df, lambda d, p: d.write.mode("overwrite").option("compression", codec).parquet(p), joined_parquet)


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps as text with a space and only the digits of a second they need."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = c.cast("timestamp_ntz").cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


@component("snk.file.csv", {**_SINK, "header": opt("bool", True), "delimiter": opt("text", ",")})
def write_csv(step: Step):
    """A CSV file; quotes are doubled, null is empty and an empty text is quoted."""
    options = {"header": step["header"], "sep": step["delimiter"], "escape": '"', "emptyValue": '""', "nullValue": ""}


    def write(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").options(**options).csv(path)

    def rows(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").options(**{**options, "header": False}).csv(path)

    def run(df: DataFrame) -> None:
        df = plain_times(df)

        def join(spark: SparkSession, parts: list[str], whole: str) -> None:
            head = f"{whole}-head"
            write(spark.createDataFrame([], df.schema).coalesce(1), head)
            joined(spark, [*(list_files(spark, f"{head}/part-*") if step["header"] else []), *parts], whole)

        deliver(step, df, write, join, rows)

    return run


@component("snk.file.jsonl", _SINK)
def write_jsonl(step: Step):
    """A file of one JSON object a line, nulls written out."""
    return lambda df: deliver(step, plain_times(df), lambda d, p: d.write.mode("overwrite").option("ignoreNullFields", False).json(p))


@component("snk.file.json", {k: v for k, v in _SINK.items() if k != "layout"})
def write_json(step: Step):
    """A file with one JSON array of objects."""

    def write(df: DataFrame, path: str) -> None:
        lines = df.select(F.concat(F.lit("\t"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).alias("value"))
        lines.write.mode("overwrite").option("lineSep", ",\n").text(path)

    def join(spark: SparkSession, parts: list[str], whole: str) -> None:
        joined(spark, parts, whole, "[\n", "\n]\n", 2)

    def run(df: DataFrame) -> None:
        refuse_existing(step)
        one_file(step.spark, plain_times(df), step["path"], write, join)

    return run


# --- object stores and addresses -----------------------------------------------------------------

_ACCESS = {
    "key_id": opt(), "secret": opt(secret=True), "session_token": opt(secret=True), "region": opt(), "endpoint": opt(), "url_style": one_of("vhost", "path"), "use_ssl": opt("bool", True),
}


def _access_check(node: str, p: dict) -> None:
    from ..registry import InvalidProperty

    if bool(p["key_id"]) != bool(p["secret"]):
        raise InvalidProperty(node, "secret" if p["key_id"] else "key_id", "set key_id and secret together")
    if not str(p["path"]).startswith(("s3://", "s3a://", "${")):
        raise InvalidProperty(node, "path", "must begin with s3://")


def s3_settings(p: dict) -> dict[str, str]:
    """The Hadoop settings for the bucket that the path names."""
    bucket = p["path"].split("://", 1)[1].split("/", 1)[0]
    lead = f"fs.s3a.bucket.{bucket}"
    out = {}
    if p["key_id"]:
        out |= {f"{lead}.access.key": p["key_id"], f"{lead}.secret.key": p["secret"]}
    if p["session_token"]:
        out |= {f"{lead}.session.token": p["session_token"], f"{lead}.aws.credentials.provider": "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"}
    if p["region"]:
        out[f"{lead}.endpoint.region"] = p["region"]
    if p["endpoint"]:
        out[f"{lead}.endpoint"] = p["endpoint"]
        out[f"{lead}.connection.ssl.enabled"] = str(not p["endpoint"].startswith("http://") if "://" in p["endpoint"] else p["use_ssl"]).lower()
    if p["url_style"] == "path":
        out[f"{lead}.path.style.access"] = "true"
    return out


def _s3_path(step: Step) -> str:
    conf = step.spark._jsc.hadoopConfiguration()
    try:
        conf.getClassByName("org.apache.hadoop.fs.s3a.S3AFileSystem")
    except Exception:
        raise ModuleNotFoundError("s3:// needs the package org.apache.hadoop:hadoop-aws on Spark's class path") from None
    for k, v in s3_settings(step.props).items():
        conf.set(k, v)
    return "s3a://" + step["path"].split("://", 1)[1]


def _by_format(spark: SparkSession, path: str, kind: str, header: bool) -> DataFrame:
    if kind == "csv":
        return csv_reader(spark, path, header, None)
    return spark.read.parquet(path) if kind == "parquet" else _json_reader(spark, False).json(path)


@component("src.cloud.s3", {"path": need("path"), "format": one_of("parquet", "csv", "json", default="parquet"), "header": opt("bool", True), **_ACCESS}, check=_access_check, packages=("org.apache.hadoop:hadoop-aws",))
def read_s3(step: Step) -> DataFrame:
    """Files in an S3-compatible store, with access settings for their bucket alone."""
    return _by_format(step.spark, _s3_path(step), step["format"], step["header"])


@component("snk.cloud.s3", {"path": need("path"), "format": one_of("parquet", "csv", "json", default="parquet"), "header": opt("bool", True), "compression": one_of("zstd", "snappy", "gzip", "brotli", "lz4", "uncompressed", default="zstd"), **_ACCESS}, check=_access_check, packages=("org.apache.hadoop:hadoop-aws",))
def write_s3(step: Step):
    """A folder of files in an S3-compatible store, replaced if it exists."""
    writers = {
        "parquet": lambda d, p: d.write.mode("overwrite").option("compression", CODECS.get(step["compression"], step["compression"])).parquet(p),
        "csv": lambda d, p: plain_times(d).write.mode("overwrite").options(header=step["header"], escape='"', emptyValue='""').csv(p),
        "json": lambda d, p: plain_times(d).write.mode("overwrite").option("ignoreNullFields", False).json(p),
    }
    return lambda df: writers[step["format"]](df, _s3_path(step))


@component("src.cloud.http", {"path": need("path"), "format": one_of("parquet", "csv", "json", default="parquet"), "header": opt("bool", True)})
def read_http(step: Step) -> DataFrame:
    """A file at an http(s) address, fetched once into the shared folder by a task and read from there."""
    from .apis import fetch_file

    return _by_format(step.spark, fetch_file(step.spark, step["path"]), step["format"], step["header"])


