"""Databases and warehouses: JDBC and Spark's connectors where they are on the class path, SQLite always."""

from __future__ import annotations

import re
import sqlite3
import tempfile
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import spark_type
from ..operators.relational import cast_column
from ..registry import InvalidProperty, Step, component, need, one_of, opt
from ..storage import Counted, delete, hadoop, list_files, new_path
from .files import typed_columns
from .lakes import has_format

_TABLE = {"connection": need("text", secret=True), "table": need(), "schema": opt()}
_PARTITION = {"partition_column": opt(doc="a numeric or time column to split the read by"), "lower_bound": opt(), "upper_bound": opt(), "partitions": opt("integer", 1)}


def words(connection: str) -> dict[str, str]:
    """The settings of a `host=... dbname=...` string or of a user:password@host address."""
    if "://" in connection:
        m = re.fullmatch(r"\w+://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/?]*)(?::(\d+))?(?:/([^?]*))?(?:\?.*)?", connection)
        if not m:
            raise ValueError("the connection is not an address")
        return {k: v for k, v in zip(("user", "password", "host", "port", "dbname"), m.groups(), strict=True) if v}
    found = {k.lower(): (a or b) for k, a, b in re.findall(r"(\w+)\s*=\s*(?:'([^']*)'|(\S+))", connection)}
    names = {"database": "dbname", "db": "dbname", "passwd": "password", "username": "user", "hostaddr": "host"}
    return {names.get(k, k): v for k, v in found.items()}


DRIVERS = {
    "postgresql": ("org.postgresql.Driver", "org.postgresql:postgresql", 5432), "mysql": ("com.mysql.cj.jdbc.Driver", "com.mysql:mysql-connector-j", 3306),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "com.microsoft.sqlserver:mssql-jdbc", 1433), "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "com.clickhouse:clickhouse-jdbc", 8123),
}


def jdbc(spark: SparkSession, kind: str, s: dict[str, Any]) -> dict[str, str]:
    """The options of Spark's JDBC source, if the driver is there."""
    driver, package, port = DRIVERS[kind]
    try:
        spark._jvm.java.lang.Class.forName(driver, False, spark._jvm.Thread.currentThread().getContextClassLoader())
    except Exception:
        raise ModuleNotFoundError(f"{kind} needs the package {package} on Spark's class path") from None
    host, db = f"{s.get('host', 'localhost')}:{s.get('port') or port}", s.get("dbname") or ""
    url = f"jdbc:sqlserver://{host};databaseName={db};encrypt={s.get('encrypt', 'true')};trustServerCertificate={s.get('trust', 'false')}" if kind == "sqlserver" else f"jdbc:{kind}://{host}/{db}"
    return {"url": url, "driver": driver} | {k: s[k] for k in ("user", "password") if s.get(k)}


def _named(step: Step) -> str:
    return f"{step['schema']}.{step['table']}" if step["schema"] else step["table"]


def _read(step: Step, options: dict[str, str], query: str | None = None) -> DataFrame:
    reader = step.spark.read.format("jdbc").options(**options)
    reader = reader.option("query", query) if query else reader.option("dbtable", _named(step))
    if step["partition_column"] and not query:
        reader = reader.options(partitionColumn=step["partition_column"], lowerBound=step["lower_bound"], upperBound=step["upper_bound"], numPartitions=step["partitions"])
    return reader.load()


def _write(step: Step, options: dict[str, str], df: DataFrame, more: dict[str, str] | None = None) -> None:
    mode = {"overwrite": "overwrite", "append": "append", "truncate": "overwrite"}[step["mode"]]
    writer = df.write.format("jdbc").options(**options, dbtable=_named(step), **(more or {}))
    (writer.option("truncate", True) if step["mode"] == "truncate" else writer).mode(mode).save()


@component("src.db.postgres", {**_TABLE, **_PARTITION}, packages=("org.postgresql:postgresql",))
def read_postgres(step: Step) -> DataFrame:
    """A PostgreSQL table; filters and columns are pushed down."""
    return _read(step, jdbc(step.spark, "postgresql", words(step["connection"])))


@component("src.db.mysql", {**_TABLE, **_PARTITION}, packages=("com.mysql:mysql-connector-j",))
def read_mysql(step: Step) -> DataFrame:
    """A MySQL or MariaDB table."""
    return _read(step, jdbc(step.spark, "mysql", words(step["connection"])))


_WRITE = {**_TABLE, "mode": one_of("overwrite", "append", default="overwrite")}


@component("snk.db.postgres", _WRITE, packages=("org.postgresql:postgresql",))
def write_postgres(step: Step):
    """Rows to a PostgreSQL table, made anew or appended to."""
    return lambda df: _write(step, jdbc(step.spark, "postgresql", words(step["connection"])), df)


@component("snk.db.mysql", _WRITE, packages=("com.mysql:mysql-connector-j",))
def write_mysql(step: Step):
    """Rows to a MySQL table; timestamps of a new table keep their fractions."""

    def run(df: DataFrame) -> None:
        times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)]
        more = {"createTableColumnTypes": ", ".join(f"`{c}` DATETIME(6)" for c in times)} if times else {}
        _write(step, jdbc(step.spark, "mysql", words(step["connection"])), df, more)

    return run


# --- SQLite ---------------------------------------------------------------------------------------

_AFFINITY = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("BOOL", T.BooleanType()), ("TIMESTAMP", T.TimestampNTZType()), ("DATETIME", T.TimestampNTZType()), ("DATE", T.DateType()), ("DEC", T.DoubleType()), ("NUM", T.DoubleType()))


def _sqlite_type(declared: str) -> T.DataType:
    return next((t for k, t in _AFFINITY if k in declared.upper()), T.StringType())


def _quoted(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


@component("src.db.sqlite", {**_TABLE, "partitions": opt("integer", 8)})
def read_sqlite(step: Step) -> DataFrame:
    """A table of an SQLite file, which all executors can open; tasks read ranges of rowid."""
    path, table = step["connection"], step["table"]
    if not Path(path).exists():
        raise FileNotFoundError(path)
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        fields = [T.StructField(r[1], _sqlite_type(r[2] or "")) for r in con.execute(f"PRAGMA table_info({_quoted(table)})")]
        if not fields:
            raise ValueError(f"{path} has no table '{table}'")
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        except sqlite3.OperationalError:  # a view, or a table without rowid
            low, high = None, None
    finally:
        con.close()
    schema = T.StructType(fields)
    n = max(1, min(step["partitions"], (high or 0) - (low or 0) + 1)) if high is not None else 1
    bounds = [(low + (high - low + 1) * i // n, low + (high - low + 1) * (i + 1) // n) for i in range(n)] if high is not None else [(None, None)]
    select = f"SELECT {', '.join(_quoted(f.name) for f in fields)} FROM {_quoted(table)}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            for part in parts:
                for a, b in part.itertuples(index=False):
                    rows = own.execute(select) if a is None or a != a else own.execute(f"{select} WHERE rowid >= ? AND rowid < ?", (int(a), int(b)))
                    while block := rows.fetchmany(10000):
                        yield pd.DataFrame({f.name: pd.Series([_from_sqlite(r[i], f.dataType) for r in block], dtype=object) for i, f in enumerate(fields)})
        finally:
            own.close()

    return step.spark.createDataFrame(bounds, "a long, b long").repartition(n).mapInPandas(run, schema)


def _from_sqlite(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, T.TimestampNTZType):
        return datetime.fromisoformat(value) if isinstance(value, str) else datetime.fromtimestamp(value)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value[:10])
    return value


def _to_sqlite(value: Any) -> Any:
    if isinstance(value, datetime):
        return value.isoformat(" ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bool):
        return int(value)
    return value if value is None or isinstance(value, int | float | str | bytes | bytearray) else str(value)


def _by_files(df: DataFrame) -> Iterator[Any]:
    """The rows of df from files that tasks write, one file after another; rows with nested values or
    intervals, whose text is that of Spark's rows, come from Spark itself."""
    if any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.DayTimeIntervalType | T.YearMonthIntervalType) for f in df.schema.fields):
        yield from df.toLocalIterator()
        return
    spark, made = df.sparkSession, new_path(df.sparkSession, "sqlite")
    plain = df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f"c{i}") if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    try:
        plain.write.parquet(made)
        for file in list_files(spark, f"{made}/part-*"):
            with tempfile.TemporaryDirectory() as near:
                source, fs = hadoop(spark, file)
                fs.copyToLocalFile(False, source, hadoop(spark, f"file://{near}/rows.parquet")[0], True)
                for batch in pq.ParquetFile(f"{near}/rows.parquet").iter_batches(10000):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
    finally:
        delete(spark, made)


_SQLITE_NAMES = {"long": "BIGINT", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@component("snk.db.sqlite", _WRITE)
def write_sqlite(step: Step):
    """Rows to a table of an SQLite file in one transaction. The file has one writer, the driver's process:
    tasks write the rows to the shared folder, and it takes them from there a batch at a time."""

    def run(df: DataFrame) -> int:
        Path(step["connection"]).parent.mkdir(parents=True, exist_ok=True)
        con = sqlite3.connect(step["connection"], isolation_level=None)
        table = _quoted(step["table"])
        try:
            rows = Counted(_by_files(df))
            con.execute("BEGIN")
            if step["mode"] == "overwrite":
                con.execute(f"DROP TABLE IF EXISTS {table}")
            columns = ", ".join(f"{_quoted(f.name)} {_SQLITE_NAMES.get(f.dataType.typeName(), 'DECIMAL' if isinstance(f.dataType, T.DecimalType) else 'VARCHAR')}" for f in df.schema.fields)
            con.execute(f"CREATE TABLE IF NOT EXISTS {table} ({columns})")
            marks = ", ".join("?" * len(df.columns))
            con.executemany(f"INSERT INTO {table} ({', '.join(map(_quoted, df.columns))}) VALUES ({marks})", ([_to_sqlite(v) for v in r] for r in rows))
            con.execute("COMMIT")
            return rows.n
        except BaseException:
            if con.in_transaction:
                con.execute("ROLLBACK")
            raise
        finally:
            con.close()

    return run


# --- servers and warehouses -------------------------------------------------------------------------

_QUERY = {"table": opt(), "query": opt("sql"), "incremental_column": opt(), "start": opt(), "max_records": opt("integer"), "columns": opt("map")}


def _one_source(node: str, p: dict) -> None:
    if bool(p["table"]) == bool(p["query"]):
        raise InvalidProperty(node, "table", "give either a table or a query")
    if p["max_records"] is not None and p["max_records"] < 1:
        raise InvalidProperty(node, "max_records", "must be at least 1")


def _after(step: Step, df: DataFrame) -> DataFrame:
    """Rows after the saved position of the incremental column, in its order if there is a limit.

    A limit takes all rows that tie with its last value, as the next run starts after that value, and
    rows without a value, which only a run without a position reads.
    """
    column = step["incremental_column"]
    if column:
        mark = (step.context or {}).get("position") or step["start"]
        if mark is not None:
            df = df.where(F.col(f"`{column}`") > F.lit(mark).cast(df.schema[column].dataType))
    if step["max_records"] and column:
        value = F.col(f"`{column}`")
        last = df.where(value.isNotNull()).orderBy(value).limit(step["max_records"]).agg(F.max(value).alias("last_"))
        df = df.crossJoin(F.broadcast(last)).where(value.isNull() | (value <= F.col("last_"))).drop("last_").orderBy(value)
    elif step["max_records"]:
        df = df.limit(step["max_records"])
    if column and step.context is not None:
        df = step.context["track"](df, column)
    kinds = {c: spark_type(k) for c, k in (step["columns"] or {}).items()}
    return typed_columns(df, kinds, lambda d, c, k: cast_column(F.col(f"`{c}`"), d.schema[c].dataType, k).alias(c))


_SQLSERVER = {"host": need(), "port": opt("integer", 1433), "database": opt(), "username": need(), "password": opt(secret=True), "encryption": one_of("required", "login_only", "none", default="required"), "ca_cert": opt("path"), "trust_server_certificate": opt("bool", False)}


def _sqlserver(step: Step) -> dict[str, str]:
    s = {"host": step["host"], "port": step["port"], "dbname": step["database"], "user": step["username"], "password": step["password"], "encrypt": {"required": "true", "login_only": "false", "none": "false"}[step["encryption"]], "trust": str(step["trust_server_certificate"]).lower()}
    return jdbc(step.spark, "sqlserver", s)


@component("src.db.sqlserver", {**_SQLSERVER, **_QUERY, "schema": opt(), **_PARTITION}, check=_one_source, packages=("com.microsoft.sqlserver:mssql-jdbc",))
def read_sqlserver(step: Step) -> DataFrame:
    """A SQL Server table or query."""
    return _after(step, _read(step, _sqlserver(step), step["query"]))


def merge_statement(table: str, stage: str, columns: list[str], keys: list[str]) -> str:
    """One MERGE from a staging table whose keys are unique."""
    q = lambda c: f"[{c.replace(']', ']]')}]"
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    rest = [c for c in columns if c not in keys]
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    return f"MERGE INTO {table} WITH (HOLDLOCK) AS t USING {stage} AS s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f's.{q(c)}' for c in columns)});"


def _merge_check(node: str, p: dict) -> None:
    if p["mode"] == "merge" and not p["key_columns"]:
        raise InvalidProperty(node, "key_columns", "is required for merge")


@component("snk.db.sqlserver", {**_SQLSERVER, "table": need(), "schema": opt(), "mode": one_of("append", "truncate", "merge", default="append"), "key_columns": opt("strings")}, check=_merge_check, packages=("com.microsoft.sqlserver:mssql-jdbc",), deferred=True)
def write_sqlserver(step: Step):
    """Rows to a SQL Server table; merge goes through a staging table and one MERGE, and of rows with equal keys takes the last."""

    def run(df: DataFrame) -> None:
        options = _sqlserver(step)
        if step["mode"] != "merge":
            return _write(step, options, df)
        keys = step["key_columns"]
        latest = df.withColumn("at_", F.monotonically_increasing_id()).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "at_").alias("r")).select("r.*")
        stage = f"{step['table']}_stage"
        latest.write.format("jdbc").options(**options, dbtable=stage).mode("overwrite").save()
        con = step.spark._jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user"), options.get("password"))
        try:
            con.createStatement().execute(merge_statement(_named(step), stage, df.columns, keys))
            con.createStatement().execute(f"DROP TABLE {stage}")
        finally:
            con.close()

    return run


_CLICKHOUSE = {"url": need(), "username": opt(), "password": opt(secret=True), "database": opt(), "schema": opt()}


def _clickhouse(step: Step) -> dict[str, str]:
    s = words(step["url"]) | {k: v for k, v in (("user", step["username"]), ("password", step["password"]), ("dbname", step["database"])) if v}
    return jdbc(step.spark, "clickhouse", s)


@component("src.db.clickhouse", {**_CLICKHOUSE, **_QUERY, **_PARTITION}, check=_one_source, packages=("com.clickhouse:clickhouse-jdbc",))
def read_clickhouse(step: Step) -> DataFrame:
    """A ClickHouse table or query."""
    return _after(step, _read(step, _clickhouse(step), step["query"]))


@component("snk.db.clickhouse", {**_CLICKHOUSE, "table": need(), "mode": one_of("append", "truncate", default="append")}, packages=("com.clickhouse:clickhouse-jdbc",), deferred=True)
def write_clickhouse(step: Step):
    """Rows to a ClickHouse table."""
    return lambda df: _write(step, _clickhouse(step), df, {"batchsize": "100000"})


def _format(spark: SparkSession, name: str, package: str) -> str:
    if not has_format(spark, name):
        raise ModuleNotFoundError(f"{name} needs the package {package} on Spark's class path")
    return name


_MONGO = {"uri": need(secret=True), "database": need(), "collection": need()}


@component("src.db.mongodb", {**_MONGO, "filter": opt(), "projection": opt(), "sort": opt(), "incremental_field": opt(), "start": opt(), "batch_size": opt("integer", 1000), "max_records": opt("integer"), "columns": opt("map")}, packages=("org.mongodb.spark:mongo-spark-connector_2.13",))
def read_mongodb(step: Step) -> DataFrame:
    """A MongoDB collection; filter, projection and sort become its aggregation pipeline."""
    stages = [f'{{"${k}": {step[p]}}}' for k, p in (("match", "filter"), ("sort", "sort"), ("project", "projection")) if step[p]]
    reader = step.spark.read.format(_format(step.spark, "mongodb", "org.mongodb.spark:mongo-spark-connector_2.13"))
    options = {"connection.uri": step["uri"], "database": step["database"], "collection": step["collection"], "batchSize": str(step["batch_size"])}
    df = reader.options(**options, **({"aggregation.pipeline": f"[{', '.join(stages)}]"} if stages else {})).load()
    step.props["incremental_column"] = step["incremental_field"]
    return _after(step, df)


def _upsert_check(node: str, p: dict) -> None:
    if p["mode"] == "upsert" and not p["key_fields"]:
        raise InvalidProperty(node, "key_fields", "is required for upsert")


@component("snk.db.mongodb", {**_MONGO, "mode": one_of("insert", "upsert", default="insert"), "key_fields": opt("strings")}, check=_upsert_check, packages=("org.mongodb.spark:mongo-spark-connector_2.13",), deferred=True)
def write_mongodb(step: Step):
    """Rows to a MongoDB collection; upsert replaces by key, so a second run changes nothing."""
    options = {"connection.uri": step["uri"], "database": step["database"], "collection": step["collection"]}
    more = {"operationType": "replace", "idFieldList": ",".join(step["key_fields"] or [])} if step["mode"] == "upsert" else {"operationType": "insert"}
    return lambda df: df.write.format(_format(step.spark, "mongodb", "org.mongodb.spark:mongo-spark-connector_2.13")).options(**options, **more).mode("append").save()


_BIGQUERY = {"project": need(), "dataset": opt(), "location": opt(), "credentials_file": opt("path"), "endpoint": opt()}
_BQ = "com.google.cloud.spark:spark-bigquery-with-dependencies_2.13"


def _bigquery(step: Step) -> dict[str, str]:
    given = {"parentProject": step["project"], "project": step["project"], "dataset": step["dataset"], "credentialsFile": step["credentials_file"], "bigQueryHttpEndpoint": step["endpoint"]}
    return {k: v for k, v in given.items() if v}


@component("src.warehouse.bigquery", {**_BIGQUERY, **_QUERY}, check=_one_source, packages=(_BQ,))
def read_bigquery(step: Step) -> DataFrame:
    """A BigQuery table or query."""
    reader = step.spark.read.format(_format(step.spark, "bigquery", _BQ)).options(**_bigquery(step))
    return _after(step, reader.option("query", step["query"]).option("viewsEnabled", True).load() if step["query"] else reader.load(step["table"]))


@component("snk.warehouse.bigquery", {**_BIGQUERY, "table": need(), "mode": one_of("append", "truncate", default="append")}, packages=(_BQ,), deferred=True)
def write_bigquery(step: Step):
    """Rows to a BigQuery table that exists; truncate empties it even for no rows."""
    mode = "append" if step["mode"] == "append" else "overwrite"
    return lambda df: df.write.format(_format(step.spark, "bigquery", _BQ)).options(**_bigquery(step), writeMethod="direct", table=step["table"]).mode(mode).save()


_SNOWFLAKE = {"account": need(), "user": need(), "private_key": opt(secret=True), "private_key_file": opt("path"), "role": opt(), "warehouse": opt(), "database": opt(), "schema": opt()}
_SF = "net.snowflake:spark-snowflake_2.13"


def _snowflake(step: Step) -> dict[str, str]:
    key = step["private_key"] or (Path(step["private_key_file"]).read_text() if step["private_key_file"] else None)
    given = {"sfURL": f"{step['account']}.snowflakecomputing.com", "sfUser": step["user"], "pem_private_key": key and "".join(x for x in key.splitlines() if "-----" not in x), "sfRole": step["role"], "sfWarehouse": step["warehouse"], "sfDatabase": step["database"], "sfSchema": step["schema"], "sfTimezone": "UTC"}
    return {k: v for k, v in given.items() if v}


@component("src.warehouse.snowflake", {**_SNOWFLAKE, **_QUERY}, check=_one_source, packages=(_SF,))
def read_snowflake(step: Step) -> DataFrame:
    """A Snowflake table or query."""
    reader = step.spark.read.format(_format(step.spark, "snowflake", _SF)).options(**_snowflake(step))
    return _after(step, (reader.option("query", step["query"]) if step["query"] else reader.option("dbtable", step["table"])).load())


@component("snk.warehouse.snowflake", {**_SNOWFLAKE, "table": need(), "mode": one_of("append", "truncate", default="append")}, packages=(_SF,), deferred=True)
def write_snowflake(step: Step):
    """Rows to a Snowflake table."""
    more = {"truncate_table": "on", "usestagingtable": "off"} if step["mode"] == "truncate" else {}
    return lambda df: df.write.format(_format(step.spark, "snowflake", _SF)).options(**_snowflake(step), dbtable=step["table"], **more).mode("overwrite" if more else "append").save()
