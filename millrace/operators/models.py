"""Columns answered by a model behind an HTTP endpoint: embed, prompt, classify, extract.

Rows are sent by mapInPandas from the executors, a batch at a time with a few calls at once. How
many rows there are is checked before the first call; a row that fails names itself and fails the
stage. `provider` in the run's context replaces the endpoint, for tests and for models in process.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..registry import InvalidProperty, Step, component, need, opt
from .relational import must_have

_ENDPOINT = {
    "base_url": opt(), "model": opt(), "api_key": opt(secret=True), "max_rows": opt("integer", 1000), "concurrency": opt("integer", 4),
    "timeout_seconds": opt("integer", 60), "retries": opt("integer", 2),
}


def _endpoint_check(node: str, p: dict) -> None:
    if p["base_url"] and not p["model"]:
        raise InvalidProperty(node, "model", "is required with base_url")
    for name in ("max_rows", "concurrency", "timeout_seconds"):
        if p[name] < 1:
            raise InvalidProperty(node, name, "must be at least 1")


def post(url: str, body: dict, key: str | None, timeout: float, retries: int) -> dict:
    """The JSON answer to a JSON request; tried again after a 429, a 5xx or a network failure."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if attempt == retries or not (e.code == 429 or e.code >= 500):
                raise RuntimeError(f"{url} answers {e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from None
        except (urllib.error.URLError, TimeoutError) as e:
            if attempt == retries:
                raise RuntimeError(f"{url}: {e}") from None
        time.sleep(0.5 * 2**attempt)
    raise AssertionError


Ask = Callable[[list[dict[str, str]], dict[str, Any] | None, int], str]


def _chat(p: dict) -> Ask:
    def ask(messages: list[dict[str, str]], schema: dict[str, Any] | None, max_tokens: int) -> str:
        body: dict[str, Any] = {"model": p["model"], "messages": messages, "temperature": 0, "max_tokens": max_tokens}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}}
        reply = post(p["base_url"].rstrip("/") + "/chat/completions", body, p["api_key"], p["timeout_seconds"], p["retries"])
        return reply["choices"][0]["message"]["content"] or ""

    return ask


def _asked(step: Step, fields: list[T.StructField], answer: Callable[[Ask, dict[str, Any]], list[Any]]) -> DataFrame:
    """The rows with more columns, from one call for each."""
    df, p = step.df, dict(step.props)
    provider = (step.context or {}).get("provider")
    if provider is None and not p["base_url"]:
        raise step.bad("base_url", "is required: there is no model in this process")
    df = step.context["held"](df)
    n = df.limit(p["max_rows"] + 1).count()
    if n > p["max_rows"]:
        raise step.bad("max_rows", f"the input has more than {p['max_rows']} rows; each row is one call")
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider or _chat(p)

        def one(row: dict[str, Any]) -> list[Any]:
            try:
                return answer(ask, row)
            except Exception as e:
                raise RuntimeError(f"{p_id}: the row {json.dumps({k: str(v)[:60] for k, v in row.items()})} fails: {e}") from e

        with ThreadPoolExecutor(p["concurrency"]) as pool:
            for batch in batches:
                rows = [{k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in r.items()} for r in batch.to_dict("records")]
                found = list(pool.map(one, rows))  # the earliest row that fails is the one that raises
                for i, name in enumerate(names):
                    batch[name] = pd.Series([x[i] for x in found], dtype=object, index=batch.index)
                yield batch

    p_id = step.id
    return df.mapInPandas(run, schema)


def fill(template: str, row: dict[str, Any]) -> str:
    """A template's {column} by the row's values, null as nothing; {{ and }} are braces."""
    return re.sub(r"\{\{|\}\}|\{([^{}]+)\}", lambda m: {"{{": "{", "}}": "}"}.get(m[0]) or ("" if row.get(m[1]) is None else str(row[m[1]])), template)


def _template_columns(step: Step, template: str) -> None:
    must_have(step, "prompt", step.df, [m[1] for m in re.finditer(r"\{\{|\}\}|\{([^{}]+)\}", template) if m[1]])


@component("xf.ai.prompt", {"prompt": need(), "system": opt(), "output": opt("text", "answer"), "max_tokens": opt("integer", 512), **_ENDPOINT}, check=_endpoint_check)
def prompt(step: Step) -> DataFrame:
    """A column with the model's answer to the prompt, {column} filled in from the row."""
    _template_columns(step, step["prompt"])
    template, system, n = step["prompt"], step["system"], step["max_tokens"]

    def answer(ask: Ask, row: dict[str, Any]) -> list[Any]:
        lead = [{"role": "system", "content": system}] if system else []
        return [ask([*lead, {"role": "user", "content": fill(template, row)}], None, n)]

    return _asked(step, [T.StructField(step["output"], T.StringType())], answer)


def _classify_check(node: str, p: dict) -> None:
    _endpoint_check(node, p)
    if len({x.lower() for x in p["labels"]}) < max(2, len(p["labels"])):
        raise InvalidProperty(node, "labels", "must list two different labels at least")


@component("xf.ai.classify", {"column": need(), "labels": need("strings"), "instructions": opt(), "output": opt("text", "label"), **_ENDPOINT}, check=_classify_check)
def classify(step: Step) -> DataFrame:
    """A column with the one of the labels that the model chooses; null for blank text."""
    must_have(step, "column", step.df, [step["column"]])
    labels, column, more = step["labels"], step["column"], step["instructions"]
    known = {x.lower(): x for x in labels}

    def answer(ask: Ask, row: dict[str, Any]) -> list[Any]:
        if row[column] is None or not str(row[column]).strip():
            return [None]
        system = f"Choose the label that fits the text. Answer with one of these and nothing else: {', '.join(labels)}." + (f" {more}" if more else "")
        schema = {"type": "object", "properties": {"label": {"enum": labels}}, "required": ["label"], "additionalProperties": False}
        said = ask([{"role": "system", "content": system}, {"role": "user", "content": str(row[column])}], schema, 64)
        try:
            said = json.loads(said)["label"]
        except (ValueError, KeyError, TypeError):
            pass
        label = known.get(str(said).strip().strip(".\"'").lower())
        if label is None:
            raise ValueError(f"the answer {said!r} is no label")
        return [label]

    return _asked(step, [T.StructField(step["output"], T.StringType())], answer)


_FIELDS: dict[str, tuple[T.DataType, str]] = {
    "text": (T.StringType(), "string"), "integer": (T.LongType(), "integer"), "number": (T.DoubleType(), "number"), "boolean": (T.BooleanType(), "boolean"), "date": (T.DateType(), "string"),
}


def typed(value: Any, kind: str) -> Any:
    """A value as its field's type, or null if it is none."""
    if value is None:
        return None
    text = str(value).strip()
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "yes": True, "false": False, "no": False}.get(text.lower())
    if kind == "integer":
        if isinstance(value, bool):
            return None
        return int(float(text)) if re.fullmatch(r"[+-]?\d+(\.0+)?", text) else None
    if kind == "number":
        return float(text) if not isinstance(value, bool) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None
    if kind == "date":
        found = pd.to_datetime(text, format="%Y-%m-%d", errors="coerce") if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None
        return None if found is None or found is pd.NaT else found.date()
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _extract_check(node: str, p: dict) -> None:
    _endpoint_check(node, p)
    for name, kind in p["fields"].items():
        if kind not in _FIELDS:
            raise InvalidProperty(node, "fields", f"'{name}' has type '{kind}', not one of {', '.join(_FIELDS)}")


@component("xf.ai.extract", {"column": need(), "fields": need("map"), "instructions": opt(), **_ENDPOINT}, check=_extract_check)
def extract(step: Step) -> DataFrame:
    """A column for each field that the model reads from the text; null where there is none."""
    must_have(step, "column", step.df, [step["column"]])
    fields, column, more = step["fields"], step["column"], step["instructions"]

    def answer(ask: Ask, row: dict[str, Any]) -> list[Any]:
        if row[column] is None or not str(row[column]).strip():
            return [None] * len(fields)
        schema = {"type": "object", "properties": {k: {"type": [_FIELDS[v][1], "null"]} for k, v in fields.items()}, "required": list(fields), "additionalProperties": False}
        system = f"Read these fields from the text, null where it does not tell: {json.dumps(fields)}. Answer with one JSON object." + (f" {more}" if more else "")
        said = ask([{"role": "system", "content": system}, {"role": "user", "content": str(row[column])}], schema, 512)
        found = json.loads(re.sub(r"^```(?:json)?|```$", "", said.strip()).strip())
        return [typed(found.get(k), v) for k, v in fields.items()]

    return _asked(step, [T.StructField(k, _FIELDS[v][0]) for k, v in fields.items()], answer)


def hashed_vector(text: str, dimensions: int) -> np.ndarray:
    """A unit vector of hashed words: the embedding without a model, for tests. Where nothing is left of the
    words, as there are none or they cancel out, the text as a whole counts as one."""
    out = np.zeros(dimensions, np.float32)
    for word in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % dimensions] += 1 if h >> 63 else -1
    if not out.any():
        out[int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % dimensions] = 1
    return out / float(np.linalg.norm(out))


@component(
    "xf.ai.embed",
    {"column": need(), "output": opt("text", "embedding"), "dimensions": opt("integer", 384), "base_url": opt(), "model": opt(), "api_key": opt(secret=True), "batch_size": opt("integer", 32), "timeout_seconds": opt("integer", 60), "retries": opt("integer", 2)},
)
def embed(step: Step) -> DataFrame:
    """A column with each text's vector of unit length; null for blank text.

    Without base_url the vector is one of hashed words, which needs no model.
    """
    must_have(step, "column", step.df, [step["column"]])
    p = dict(step.props)
    given = (step.context or {}).get("embedder")
    schema = T.StructType([*step.df.schema.fields, T.StructField(p["output"], T.ArrayType(T.FloatType()))])

    def vectors(texts: list[str]) -> list[Any]:
        if given:
            return given(texts)
        if not p["base_url"]:
            return [hashed_vector(x, p["dimensions"]) for x in texts]
        reply = post(p["base_url"].rstrip("/") + "/embeddings", {"model": p["model"], "input": texts}, p["api_key"], p["timeout_seconds"], p["retries"])
        return [x["embedding"] for x in sorted(reply["data"], key=lambda x: x["index"])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[p["column"]].tolist()
            at = [i for i, x in enumerate(texts) if isinstance(x, str) and x.strip()]
            out: list[Any] = [None] * len(texts)
            for lo in range(0, len(at), p["batch_size"]):
                part = at[lo : lo + p["batch_size"]]
                for i, v in zip(part, vectors([texts[i] for i in part]), strict=True):
                    v = np.asarray(v, np.float32)
                    if len(v) != p["dimensions"]:
                        raise ValueError(f"the model gives {len(v)} numbers, not {p['dimensions']}")
                    out[i] = (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()
            batch[p["output"]] = pd.Series(out, dtype=object, index=batch.index)
            yield batch

    return step.df.mapInPandas(run, schema)
