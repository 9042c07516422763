"""REST and GraphQL APIs, and files at an address.

Pages follow each other, so a task fetches them one after another as JSON lines into the shared
folder; what is read from there is split among tasks again and fetched once only.
"""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dialect import spark_type
from ..operators.relational import cast_column
from ..registry import InvalidProperty, Step, component, need, one_of, opt
from ..storage import list_files, new_path, written
from .files import _as_text, in_file_order, naive_times, narrow_dates, typed_columns

HTTP = {
    "url": need(), "headers": opt("map"), "auth": one_of("none", "bearer", "basic", "header", default="none"), "token": opt(secret=True), "auth_header": opt("text", "X-API-Key"),
    "username": opt(), "password": opt(secret=True), "timeout_ms": opt("integer", 30000), "retries": opt("integer", 3), "retry_backoff_ms": opt("integer", 500), "min_interval_ms": opt("integer", 0),
}


class Client:
    """Requests with authentication, a least interval, and retries after a 429, a 5xx or a network failure."""

    def __init__(self, p: dict[str, Any]):
        self.p, self.last = p, 0.0
        self.headers = {"Accept": "application/json", **(p.get("headers") or {})}
        if p["auth"] == "bearer":
            self.headers["Authorization"] = f"Bearer {p['token']}"
        elif p["auth"] == "header":
            self.headers[p["auth_header"]] = p["token"] or ""
        elif p["auth"] == "basic":
            self.headers["Authorization"] = "Basic " + base64.b64encode(f"{p['username'] or ''}:{p['password'] or ''}".encode()).decode()

    def send(self, url: str, method: str = "GET", body: bytes | None = None) -> tuple[bytes, dict[str, str]]:
        head = self.headers | ({"Content-Type": "application/json"} if body is not None else {})
        for attempt in range(self.p["retries"] + 1):
            time.sleep(max(0.0, self.last + self.p["min_interval_ms"] / 1000 - time.monotonic()))
            self.last = time.monotonic()
            wait = self.p["retry_backoff_ms"] / 1000 * 2**attempt
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, head, method=method), timeout=self.p["timeout_ms"] / 1000) as reply:
                    return reply.read(), {k.lower(): v for k, v in reply.headers.items()}
            except urllib.error.HTTPError as e:
                if attempt == self.p["retries"] or not (e.code == 429 or e.code >= 500):
                    raise RuntimeError(f"{url} answers {e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from None
                after = e.headers.get("Retry-After", "")
                wait = min(float(after), 300.0) if after.isdigit() else wait
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if attempt == self.p["retries"]:
                    raise RuntimeError(f"{url}: {e}") from None
            time.sleep(wait)
        raise AssertionError


def pointer(value: Any, path: str | None) -> Any:
    """What a JSON pointer (or a dotted path) names in a value; nothing if it is not there."""
    for part in [x for x in re.split(r"[/.]", path or "") if x]:
        if isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            return None
    return value


def with_query(url: str, **more: Any) -> str:
    parts = urllib.parse.urlsplit(url)
    query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k not in more]
    query += [(k, str(v)) for k, v in more.items() if v is not None]
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))


def _records(found: Any, where: str) -> list[Any]:
    if isinstance(found, dict):
        return [found]
    if not isinstance(found, list):
        raise RuntimeError(f"{where}: there are no records")
    return found


class Moving:
    """Whether paging moves on, however many pages there are. A cursor or a link seen before is an error at
    the latest when the circle has been walked three times (Brent). Pages of a number or an offset may be alike,
    as rows may; SAME alike in a row are those of a service that does not heed the number."""

    SAME = 1000

    def __init__(self, url: str, most: int | None):
        self.url, self.most, self.pages, self.kept, self.power, self.since, self.last, self.alike = url, most, 0, None, 1, 0, None, 0

    def page(self) -> None:
        """Counts a page; more than max_pages are an error, where that is given."""
        if self.pages == self.most:
            raise RuntimeError(f"{self.url}: more than max_pages ({self.most}) pages")
        self.pages += 1

    def to(self, cursor: Any) -> None:
        if self.kept is not None and cursor == self.kept:
            raise RuntimeError(f"{self.url}: the cursor {cursor!r} does not move on")
        self.since += 1
        if self.kept is None or self.since == self.power:
            self.kept, self.power, self.since = cursor, self.power * 2, 0

    def saw(self, body: bytes) -> None:
        self.alike = self.alike + 1 if body == self.last else 1
        self.last = body
        if self.most is None and self.alike == self.SAME:
            raise RuntimeError(f"{self.url}: {self.SAME} pages in a row are the same, paging does not move on; if they are right, give max_pages")


def rest_pages(p: dict[str, Any]) -> Iterator[Any]:
    """The records of a REST source, page after page, until its style of paging says it is the last."""
    client, style = Client(p), p["pagination"]
    url = with_query(p["url"], **(p["query"] or {}))
    if style == "page":
        url = with_query(url, **{p["page_param"]: p["page_start"], **({p["size_param"]: p["page_size"]} if p["size_param"] else {})})
    elif style == "offset":
        url = with_query(url, **{p["offset_param"]: 0, **({p["size_param"]: p["page_size"]} if p["size_param"] else {})})
    elif p["size_param"]:
        url = with_query(url, **{p["size_param"]: p["page_size"]})
    moving, offset = Moving(p["url"], p["max_pages"]), 0
    while True:
        moving.page()
        body, headers = client.send(url, p["method"], p["body"].encode() if p["body"] else None)
        reply = json.loads(body)
        rows = _records(pointer(reply, p["records"]), url)
        yield from rows
        short = not rows or (p["page_size"] is not None and len(rows) < p["page_size"])
        if style == "none" or (style in ("page", "offset") and short):
            return
        if style in ("page", "offset"):
            moving.saw(body)
        if style == "page":
            url = with_query(url, **{p["page_param"]: p["page_start"] + moving.pages})
        elif style == "offset":
            offset += len(rows)
            url = with_query(url, **{p["offset_param"]: offset})
        elif style == "cursor":
            new = pointer(reply, p["cursor_path"])
            if new in (None, "", False):
                return
            moving.to(new)
            url = with_query(url, **{p["cursor_param"]: new})
        else:
            m = re.search(r'<([^>]*)>\s*;[^,]*\brel="?next"?', headers.get("link", ""))
            if not m:
                return
            url = urllib.parse.urljoin(url, m[1])
            moving.to(url)


def graphql_call(client: Client, p: dict[str, Any], query: str, variables: dict[str, Any]) -> Any:
    """The data of an answer; errors fail it, after retries if all carry one of retry_codes."""
    codes = {x.strip() for x in (p["retry_codes"] or "").split(",") if x.strip()}
    for attempt in range(p["retries"] + 1):
        body, _ = client.send(p["url"], "POST", json.dumps({"query": query, "variables": variables}).encode())
        reply = json.loads(body)
        errors = reply.get("errors")
        if not errors:
            return reply.get("data")
        again = all(str((e.get("extensions") or {}).get("code")) in codes for e in errors)
        if not again or attempt == p["retries"]:
            raise RuntimeError(f"{p['url']}: {'; '.join(str(e.get('message')) for e in errors)}")
        time.sleep(p["retry_backoff_ms"] / 1000 * 2**attempt)


def graphql_pages(p: dict[str, Any]) -> Iterator[Any]:
    client, variables = Client(p), json.loads(p["variables"] or "{}")
    if p["pagination"] == "offset":
        variables |= {p["offset_variable"] or "offset": 0, p["limit_variable"] or "limit": p["page_size"]}
    elif p["pagination"] == "relay" and p["limit_variable"]:
        variables[p["limit_variable"]] = p["page_size"]
    moving = Moving(p["url"], p["max_pages"])
    while True:
        moving.page()
        data = graphql_call(client, p, p["query"], variables)
        rows = _records(pointer(data, p["records"]), p["url"])
        yield from (r["node"] if p["pagination"] == "relay" and isinstance(r, dict) and "node" in r else r for r in rows)
        if p["pagination"] == "none":
            return
        if p["pagination"] == "offset":
            if len(rows) < p["page_size"]:
                return
            moving.saw(json.dumps(rows).encode())
            variables[p["offset_variable"] or "offset"] += len(rows)
            continue
        where = p["page_info"] or re.sub(r"[/.](edges|nodes)$", "", p["records"]) + "/pageInfo"
        info = pointer(data, where)
        if not isinstance(info, dict):
            raise RuntimeError(f"{p['url']}: there is no page info at {where}")
        if not info.get("hasNextPage"):
            return
        moving.to(info.get("endCursor"))
        variables[p["cursor_variable"]] = info.get("endCursor")


READERS = {"rest": rest_pages, "graphql": graphql_pages}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.p = options["kind"], json.loads(options["given"])

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        for row in READERS[self.kind](self.p):
            yield (json.dumps(row, ensure_ascii=False),)


class ApiDataSource(DataSource):
    """JSON lines from an API: options kind (rest or graphql) and given (its properties as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_api"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))


def staged(spark: SparkSession, lines: DataFrame) -> str:
    """JSON lines written to the shared folder; a source that cannot be read twice is read once."""
    path = new_path(spark, "staged")
    lines.write.text(path)
    return path


def read_staged(spark: SparkSession, path: str, columns: dict[str, str] | None) -> DataFrame:
    if columns:
        kinds = {c: spark_type(k) for c, k in columns.items()}
        texts = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in kinds])).json(path)

        def casts(df: DataFrame, c: str, kind: str):
            if kind.startswith("ARRAY"):
                return F.from_json(F.col(f"`{c}`"), kind).alias(c)
            return cast_column(F.col(f"`{c}`"), T.StringType(), kind).alias(c)

        return typed_columns(texts, kinds, casts)
    df = spark.read.options(inferTimestamp=True, mode="FAILFAST").json(path)
    df = in_file_order(df, list_files(spark, f"{path}/part-*"))
    return naive_times(narrow_dates(df, lambda: spark.read.schema(_as_text(df.schema)).json(path)))


def _api(step: Step, kind: str) -> DataFrame:
    step.spark.dataSource.register(ApiDataSource)
    lines = step.spark.read.format("millrace_api").options(kind=kind, given=json.dumps(step.props)).load()
    return read_staged(step.spark, staged(step.spark, lines), step["columns"])


def fetch_file(spark: SparkSession, url: str) -> str:
    """A copy of the file at an address, in the shared folder, streamed through Hadoop's file system."""
    name = urllib.parse.urlsplit(url).path.rsplit("/", 1)[-1] or "file"
    path = f"{new_path(spark, 'fetched')}/{name}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    source = jvm.java.net.URI(url).toURL().openStream()
    target = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 16, True)
    return path


def _rest_check(node: str, p: dict) -> None:
    if p["auth"] in ("bearer", "header") and not p["token"]:
        raise InvalidProperty(node, "token", f"is required for {p['auth']}")
    if p["auth"] == "basic" and p["username"] is None:
        raise InvalidProperty(node, "username", "is required for basic")
    if p.get("pagination") == "cursor" and p.get("cursor_path", "") is None:
        raise InvalidProperty(node, "cursor_path", "is required for cursor")
    for name in ("body", "variables"):
        if p.get(name):
            try:
                json.loads(p[name])
            except ValueError as e:
                raise InvalidProperty(node, name, f"is not JSON: {e}") from None


@component(
    "src.saas.rest",
    {
        **HTTP, "method": one_of("GET", "POST", default="GET"), "query": opt("map"), "body": opt(), "records": opt("text", ""), "pagination": one_of("none", "page", "offset", "cursor", "link", default="none"),
        "page_param": opt("text", "page"), "page_start": opt("integer", 1), "offset_param": opt("text", "offset"), "size_param": opt(), "page_size": opt("integer"), "cursor_path": opt(), "cursor_param": opt("text", "cursor"),
        "max_pages": opt("integer"), "columns": opt("map"),
    },
    check=_rest_check,
)
def read_rest(step: Step) -> DataFrame:
    """JSON records from an HTTP API, page after page to the last; paging that goes round in circles is an error,
    and so are more pages than max_pages, if given."""
    return _api(step, "rest")


@component(
    "src.saas.graphql",
    {
        **HTTP, "query": need("code"), "records": need(), "variables": opt(), "retry_codes": opt("text", "THROTTLED,RATE_LIMITED"), "pagination": one_of("none", "relay", "offset", default="none"),
        "cursor_variable": opt("text", "after"), "page_info": opt(), "offset_variable": opt(), "limit_variable": opt(), "page_size": opt("integer", 100), "max_pages": opt("integer"), "columns": opt("map"),
    },
    check=_rest_check,
)
def read_graphql(step: Step) -> DataFrame:
    """Records from a GraphQL query; an answer with errors is a failure."""
    return _api(step, "graphql")


SINK = {"batch_size": opt("integer", 100), "tasks": opt("integer", 1), "key_header": opt("text", "Idempotency-Key")}


def _sink_check(node: str, p: dict) -> None:
    _rest_check(node, p)
    for name in ("batch_size", "tasks"):
        if p[name] < 1:
            raise InvalidProperty(node, name, "must be positive")


def _batches(df: DataFrame, size: int, tasks: int) -> DataFrame:
    """A row for each batch of rows, as JSON texts: its key, the part of df it is from, its place there."""
    import uuid

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    delivery = uuid.uuid4().hex

    def cut(frames: Iterator[Any]) -> Iterator[Any]:
        import itertools

        import pandas as pd
        from pyspark import TaskContext

        part, lines = TaskContext.get().partitionId(), (line for frame in frames for line in frame["value"])
        for number in itertools.count():
            batch = list(itertools.islice(lines, size))
            if not batch:
                return
            yield pd.DataFrame({"key": [f"{delivery}-{part}-{number}"], "part": [part], "number": [number], "lines": [batch]})

    return (rows.coalesce(1) if tasks == 1 else rows.repartition(tasks)).mapInPandas(cut, "key string, part int, number long, lines array<string>")


def send_batches(step: Step, send: Any) -> Any:
    """What delivers a DataFrame by send(client, list of JSON texts), and returns the number of rows.

    Rows are cut into batches and written before the first is sent. So a batch has the same rows and the
    same key whenever it is sent: by a task that Spark starts again or a second time, by a retry of the
    request, or by a retry of the node. A service that heeds the key's header takes it once; one that
    does not may see the batches of a failed task again. One task sends in the order of the rows; more
    send side by side, in no order. A failure tells how many rows that task had delivered.
    """
    p, tasks, cut = dict(step.props), step["tasks"], []

    def deliver(df: DataFrame) -> int:
        if not cut:
            held = (step.context or {}).get("held", lambda x: written(x.sparkSession, x, "batches"))
            cut.append(held(_batches(df, p["batch_size"], tasks)))

        def run(frames: Iterator[Any]) -> Iterator[Any]:
            import pandas as pd

            done, client = 0, Client(p)
            for frame in frames:
                for key, lines in zip(frame["key"], frame["lines"], strict=True):
                    client.headers[p["key_header"]] = key
                    try:
                        send(client, list(lines))
                    except Exception as e:
                        raise RuntimeError(f"after {done} rows were delivered: {e}") from e
                    done += len(lines)
            yield pd.DataFrame({"sent": [done]})

        placed = cut[0].coalesce(1).sortWithinPartitions("part", "number") if tasks == 1 else cut[0].repartition(tasks)
        return sum(r[0] for r in placed.select("key", "lines").mapInPandas(run, "sent long").collect())

    return deliver


@component("snk.saas.rest", {**HTTP, **SINK, "method": one_of("POST", "PUT", "PATCH", default="POST"), "wrap": opt()}, check=_sink_check, deferred=True)
def write_rest(step: Step):
    """Rows to an HTTP API in batches: an array for each, an object for batches of one row, under `wrap` if given."""
    p = dict(step.props)

    def send(client: Client, lines: list[str]) -> None:
        rows = [json.loads(x) for x in lines]
        body: Any = rows[0] if p["batch_size"] == 1 else rows
        client.send(p["url"], p["method"], json.dumps({p["wrap"]: body} if p["wrap"] else body).encode())

    return send_batches(step, send)


@component("snk.saas.graphql", {**HTTP, **SINK, "mutation": need("code"), "rows_variable": opt("text", "rows"), "variables": opt(), "retry_codes": opt("text", "THROTTLED,RATE_LIMITED")}, check=_sink_check, deferred=True)
def write_graphql(step: Step):
    """Rows to a GraphQL mutation in batches, always as a list."""
    p = dict(step.props)

    def send(client: Client, lines: list[str]) -> None:
        graphql_call(client, p, p["mutation"], {**json.loads(p["variables"] or "{}"), p["rows_variable"]: [json.loads(x) for x in lines]})

    return send_batches(step, send)
