"""Queries that send the standard tables over HTTP and back, with the same rows in DuckDB SQL.

The other side is a small server in this process that keeps JSON rows by name: what the sources and
sinks of addresses, REST, GraphQL and models do is real, only the service is near.
"""

from __future__ import annotations

import json
import threading
import urllib.parse
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .model import pipeline
from .plans.run import frames, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class _Handler(BaseHTTPRequestHandler):
    rows: dict[str, list[Any]]

    def log_message(self, *args: Any) -> None:
        pass

    def _reply(self, body: bytes) -> None:
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self) -> None:  # noqa: N802
        """Rows of a name as CSV, from an offset, or behind a cursor."""
        url = urllib.parse.urlsplit(self.path)
        kind, name = url.path.strip("/").split("/")
        rows, asked = self.rows[name], dict(urllib.parse.parse_qsl(url.query))
        if kind == "csv":
            lines = [",".join(rows[0]), *(",".join(map(str, r.values())) for r in rows)]
            return self._reply("\n".join(lines).encode())
        at, size = int(asked.get("offset") or asked.get("cursor") or 0), int(asked.get("size", 7))
        page = rows[at : at + size]
        more = at + size if at + size < len(rows) else None
        return self._reply(json.dumps(page if kind == "offset" else {"found": {"rows": page}, "next": more}).encode())

    def do_POST(self) -> None:  # noqa: N802
        """Rows put under a name; a GraphQL query or mutation; a model that answers by rule."""
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        kind, _, name = self.path.strip("/").partition("/")
        if kind == "put":
            self.rows.setdefault(name, []).extend(body["records"])
            return self._reply(b"{}")
        if kind == "graphql":
            given = body["variables"]
            if "rows" in given:
                self.rows.setdefault(name, []).extend(given["rows"])
                return self._reply(b'{"data": {"taken": true}}')
            at = int(given.get("after") or 0)
            page = {"edges": [{"node": r} for r in self.rows[name][at : at + 6]], "pageInfo": {"hasNextPage": at + 6 < len(self.rows[name]), "endCursor": str(at + 6)}}
            return self._reply(json.dumps({"data": {"found": page}}).encode())
        text, wanted = body["messages"][-1]["content"], body.get("response_format", {}).get("json_schema", {}).get("schema", {}).get("properties", {})
        if "label" in wanted:
            said = json.dumps({"label": "even" if len(text) % 2 == 0 else "odd"})
        elif wanted:
            said = json.dumps({"letters": str(len(text)), "first": text[0], "spaced": "yes" if " " in text else "no"})
        else:
            said = text[::-1]
        return self._reply(json.dumps({"choices": [{"message": {"content": said}}]}).encode())


def _served(**rows: list[Any]) -> str:
    """The address of a server that holds the rows, for as long as this process lives."""
    handler = type("Handler", (_Handler,), {"rows": rows})
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


def _rows(spark: SparkSession, sf_dir: str, table: str) -> list[dict[str, Any]]:
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()]


_NATION = {"n_nationkey": "INTEGER", "n_name": "VARCHAR", "n_regionkey": "INTEGER"}
_SUPPLIER = {"s_suppkey": "BIGINT", "s_name": "VARCHAR", "s_nationkey": "INTEGER", "s_acctbal": "DOUBLE"}


def _reads(name: str, table: str, component: str, props: Callable[[str], dict[str, Any]], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frames(spark, pipeline(("back", component, props(_served(**{table: _rows(spark, sf_dir, table)}))), name=name))["back"]

    QUERIES[name], ORACLE_SQL[name] = query, sql


_reads("http_csv", "nation", "src.cloud.http", lambda url: {"path": f"{url}/csv/nation", "format": "csv"}, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
_reads("rest_offset", "supplier", "src.saas.rest", lambda url: {"url": f"{url}/offset/supplier", "pagination": "offset", "page_size": 9, "size_param": "size", "columns": _SUPPLIER}, "SELECT * FROM supplier")
_reads("rest_cursor", "nation", "src.saas.rest", lambda url: {"url": f"{url}/cursor/nation", "pagination": "cursor", "records": "found/rows", "cursor_path": "next", "columns": _NATION}, "SELECT * FROM nation")
_reads("graphql_relay", "nation", "src.saas.graphql", lambda url: {"url": f"{url}/graphql/nation", "query": "query($after: String) { found(after: $after) { edges } }", "records": "found/edges", "pagination": "relay", "columns": _NATION}, "SELECT * FROM nation")


def _writes(name: str, sink: str, props: Callable[[str], dict[str, Any]]) -> None:
    """Suppliers with money, sent in batches and read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        url = _served(sent=[])
        supplier = ("supplier", "src.file.parquet", {"path": f"{sf_dir}/supplier.parquet"})
        run(spark, pipeline(supplier, ("rich", "xf.filter", {"predicate": "s_acctbal > 2000"}), ("out", sink, props(url)), name=name), counts="none")
        return frames(spark, pipeline(("back", "src.saas.rest", {"url": f"{url}/offset/sent", "pagination": "offset", "page_size": 50, "size_param": "size", "columns": _SUPPLIER}), name=name))["back"]

    QUERIES[name], ORACLE_SQL[name] = query, "SELECT * FROM supplier WHERE s_acctbal > 2000"


_writes("rest_round_trip", "snk.saas.rest", lambda url: {"url": f"{url}/put/sent", "batch_size": 8, "wrap": "records"})
_writes("graphql_round_trip", "snk.saas.graphql", lambda url: {"url": f"{url}/graphql/sent", "mutation": "mutation($rows: [Row]) { taken }", "batch_size": 8})


def _asks(name: str, component: str, props: dict[str, Any], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation = ("nation", "src.file.parquet", {"path": f"{sf_dir}/nation.parquet"})
        return frames(spark, pipeline(nation, ("asked", component, {**props, "base_url": _served(), "model": "rules"}), name=name))["asked"]

    QUERIES[name], ORACLE_SQL[name] = query, sql


_asks("prompt", "xf.ai.prompt", {"prompt": "{n_name} of {n_regionkey}"}, "SELECT *, reverse(n_name || ' of ' || n_regionkey) AS answer FROM nation")
_asks("classify", "xf.ai.classify", {"column": "n_name", "labels": ["even", "odd"]}, "SELECT *, CASE WHEN length(n_name) % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM nation")
_asks("extract", "xf.ai.extract", {"column": "n_name", "fields": {"letters": "integer", "first": "text", "spaced": "boolean"}}, "SELECT *, length(n_name) AS letters, n_name[1] AS first, contains(n_name, ' ') AS spaced FROM nation")
