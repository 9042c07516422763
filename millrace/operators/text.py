"""Text for retrieval and release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..registry import InvalidProperty, Step, component, need, one_of, opt
from .relational import col, must_have


def _chunk_check(node: str, p: dict) -> None:
    if p["size"] < 1:
        raise InvalidProperty(node, "size", "must be at least 1")
    if not 0 <= p["overlap"] < p["size"]:
        raise InvalidProperty(node, "overlap", f"must be at least 0 and smaller than size ({p['size']})")


@component("xf.ai.chunk", {"column": need(), "size": opt("integer", 1000), "overlap": opt("integer", 100), "output": opt("text", "chunk")}, check=_chunk_check)
def chunk(step: Step) -> DataFrame:
    """A row for each chunk of the text: the other columns, <output>_index from 0, and <output>."""
    must_have(step, "column", step.df, [step["column"]])
    rest = [col(c) for c in step.df.columns if c != step["column"]]
    made = fn.chunks(col(step["column"]), step["size"], step["overlap"])
    return step.df.select(*rest, F.posexplode(made).alias(f"{step['output']}_index", step["output"])).withColumn(f"{step['output']}_index", F.col(f"`{step['output']}_index`").cast("long"))


def _redact_check(node: str, p: dict) -> None:
    if not p["kinds"]:
        raise InvalidProperty(node, "kinds", "names no kind of data")
    for k in p["kinds"]:
        if k not in fn.KINDS:
            raise InvalidProperty(node, "kinds", f"{k!r} is unknown; there are {', '.join(fn.KINDS)}")


@component("xf.ai.redact", {"columns": need("strings"), "kinds": opt("strings", fn.KINDS), "replacement": one_of("token", "hash", default="token")}, check=_redact_check)
def redact(step: Step) -> DataFrame:
    """Personal data in the named columns replaced by tokens, or by hashes of what they denote."""
    must_have(step, "columns", step.df, step["columns"])
    return fn.redact(step.df, step["columns"], tuple(step["kinds"]), step["replacement"] == "hash")
