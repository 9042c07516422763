"""Checks that split rows exactly into accepted and rejected, and assertions on whole relations."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import translate
from ..registry import REJECTED, InvalidProperty, Step, component, need, opt
from .relational import col, must_have

_BOTH = ("main", REJECTED)


def split(base: DataFrame, predicate: Column, helpers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Rows that satisfy the predicate, and all others, those of unknown outcome among them.

    When both sides are used the base is read twice; the pipeline keeps it if a node asks for it.
    """
    sure = F.coalesce(predicate, F.lit(False))
    return {"main": base.where(sure).drop(*helpers), REJECTED: base.where(~sure).drop(*helpers)}


@component("qa.not_null", {"columns": need("strings")}, outputs=_BOTH)
def not_null(step: Step) -> dict[str, DataFrame]:
    """Accepts rows in which no named column is null."""
    must_have(step, "columns", step.df, step["columns"])
    return split(step.df, reduce(lambda a, b: a & b, [col(c).isNotNull() for c in step["columns"]]))


@component("qa.unique", {"columns": need("strings")}, outputs=_BOTH)
def unique(step: Step) -> dict[str, DataFrame]:
    """Accepts rows whose key occurs once; every copy of another is rejected, null keys too.

    Copies are counted by an aggregation, combined before the shuffle, whose repeated keys alone are
    joined back: unlike a window it brings no key's rows together.
    """
    must_have(step, "columns", step.df, step["columns"])
    keys = step["columns"]
    repeated = step.df.groupBy(*[col(c).alias(f"key_{i}") for i, c in enumerate(keys)]).agg(F.count("*").alias("copies_")).where("copies_ > 1")
    same = reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.col(f"key_{i}")) for i, c in enumerate(keys)])
    return {"main": step.df.join(repeated, same, "left_anti"), REJECTED: step.df.join(repeated, same, "left_semi")}


def _range_check(node: str, p: dict) -> None:
    if p["min"] is None and p["max"] is None:
        raise InvalidProperty(node, "min", "give a minimum, a maximum, or both")
    for bound in ("min", "max"):
        if p[bound] is not None:
            try:
                Decimal(str(p[bound]))
            except InvalidOperation:
                raise InvalidProperty(node, bound, f"{p[bound]!r} is not a number") from None


@component("qa.range", {"column": need(), "min": opt("number"), "max": opt("number")}, outputs=_BOTH, check=_range_check)
def in_range(step: Step) -> dict[str, DataFrame]:
    """Accepts rows with min <= column <= max; bounds are exact decimals."""
    must_have(step, "column", step.df, [step["column"]])
    value = col(step["column"])
    tests = [value >= F.expr(str(step["min"]))] if step["min"] is not None else []
    tests += [value <= F.expr(str(step["max"]))] if step["max"] is not None else []
    return split(step.df, reduce(lambda a, b: a & b, tests))


@component("qa.regex", {"column": need(), "pattern": need()}, outputs=_BOTH)
def regex(step: Step) -> dict[str, DataFrame]:
    """Accepts rows in which the pattern matches somewhere in the column."""
    must_have(step, "column", step.df, [step["column"]])
    return split(step.df, col(step["column"]).cast("string").rlike(step["pattern"]))


@component("qa.accepted_values", {"column": need(), "values": need("strings")}, outputs=_BOTH)
def accepted_values(step: Step) -> dict[str, DataFrame]:
    """Accepts rows whose column, as text, is one of the values."""
    must_have(step, "column", step.df, [step["column"]])
    return split(step.df, col(step["column"]).cast("string").isin(step["values"]))


@component("qa.expression", {"predicate": need("sql")}, outputs=_BOTH)
def expression(step: Step) -> dict[str, DataFrame]:
    """Accepts rows for which the predicate is true."""
    return split(step.df, F.expr(translate(step["predicate"])))


@component("qa.referential", {"column": need(), "references": need()}, inputs=("left", "right"), outputs=_BOTH)
def referential(step: Step) -> dict[str, DataFrame]:
    """Accepts rows of left whose column is among the values of right's `references`; a null is not."""
    left, right = step.by_port["left"], step.by_port["right"]
    must_have(step, "column", left, [step["column"]])
    must_have(step, "references", right, [step["references"]])
    known = right.select(col(step["references"]).alias("known_")).where("known_ IS NOT NULL").distinct()
    same = col(step["column"]) == F.col("known_")
    return {"main": left.join(known, same, "left_semi"), REJECTED: left.join(known, same, "left_anti")}


def _count_check(node: str, p: dict) -> None:
    if p["min"] is None and p["max"] is None:
        raise InvalidProperty(node, "min", "give a minimum, a maximum, or both")


class AssertionFailed(RuntimeError):
    """A relation is not what the pipeline says it must be."""


@component("qa.row_count", {"min": opt("integer"), "max": opt("integer")}, check=_count_check)
def row_count(step: Step) -> DataFrame:
    """Passes the relation if its number of rows is within the bounds, and fails the run otherwise."""
    df = step.context["held"](step.df)
    n = df.count()
    if (step["min"] is not None and n < step["min"]) or (step["max"] is not None and n > step["max"]):
        low, high = ("-" if step[x] is None else step[x] for x in ("min", "max"))
        raise AssertionFailed(f"{n} rows, outside {low} to {high}")
    return df


@component("qa.schema_match", {"columns": need("strings")})
def schema_match(step: Step) -> DataFrame:
    """Passes the relation if it has the named columns, and fails the run otherwise."""
    missing = [c for c in step["columns"] if c not in step.df.columns]
    if missing:
        raise AssertionFailed(f"there is no column {', '.join(missing)}")
    return step.df
