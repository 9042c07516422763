"""Nodes that pass their rows on and act on the run: wait, log, fail, branch, sequence."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import translate
from ..registry import Step, component, need, opt
from .quality import AssertionFailed


class NotTaken(Exception):  # noqa: N818
    """The branch's predicate holds for no row: what follows is skipped, which is no failure."""


@component("ctl.wait", {"ms": need("integer"), "message": opt()})
def wait(step: Step) -> DataFrame:
    """Waits, then passes the rows on."""
    if step["ms"] < 0:
        raise step.bad("ms", "must not be negative")
    if step["message"]:
        step.context["note"](step["message"])
    time.sleep(step["ms"] / 1000)
    return step.df


@component("ctl.log", {"message": opt("text", "")})
def log(step: Step) -> DataFrame:
    """Notes a message in the run's report."""
    step.context["note"](step["message"] or step.id)
    return step.df


def matching(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.coalesce(F.expr(translate(predicate)), F.lit(False)))


@component("ctl.fail", {"when": opt("sql"), "message": need()})
def fail(step: Step) -> DataFrame:
    """Fails the run with the message if any row matches `when`, or on arrival without it."""
    if not step["when"]:
        raise AssertionFailed(step["message"])
    df = step.context["held"](step.df)
    n = matching(df, step["when"]).count()
    if n:
        raise AssertionFailed(f"{step['message']} ({n} rows)")
    return df


@component("ctl.branch", {"predicate": need("sql")})
def branch(step: Step) -> DataFrame:
    """Passes the rows on if the predicate holds for one of them; otherwise what follows is skipped."""
    df = step.context["held"](step.df)
    if matching(df, step["predicate"]).isEmpty():
        raise NotTaken(step.id)
    return df


@component("ctl.sequence", inputs=("main", "after"))
def sequence(step: Step) -> DataFrame:
    """Reads `after` to its end, then passes `main` on."""
    step.by_port["after"].write.format("noop").mode("overwrite").save()
    return step.by_port["main"]
