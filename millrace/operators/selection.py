"""Exact quantiles, most frequent values and samples, without the rows of a group in one task."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import name
from .ordered import free

Held = Callable[[DataFrame], DataFrame]

# --- aggregates that need the values of a group in order -------------------------------------------

_NUMBER = r"\s*(\d*\.?\d+)\s*"
_CALL = re.compile(r"(median|mode|percentile)\s*\((.*)\)", re.S | re.I)
_WITHIN = re.compile(rf"percentile_(cont|disc)\s*\({_NUMBER}\)\s*WITHIN\s+GROUP\s*\(\s*ORDER\s+BY\s+(.*)\)", re.S | re.I)
_FILTER = re.compile(r"(.*\))\s*FILTER\s*\(\s*WHERE\s+(.*)\)", re.S | re.I)
_ALIAS = re.compile(r"(.*\))(?:\s+(?:AS\s+)?[`\"]?(\w+)[`\"]?)?", re.S | re.I)


@dataclass(frozen=True)
class Pick:
    """A value to be picked from each group: cont and disc at a share of the order, mode by its count."""

    kind: str
    value: str
    share: float
    where: str
    label: str


def _whole(text: str) -> bool:
    """Whether brackets close only what was opened within the text."""
    depth = 0
    for c in re.sub(r"'[^']*'|`[^`]*`", "", text):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def pick_of(text: str) -> Pick | None:
    """The pick that an aggregate stands for, with or without an alias and FILTER; None for any other."""
    m = _ALIAS.fullmatch(text.strip())
    call, where, label = m[1] if m else "", "true", m[2] or m[1] if m else ""
    if m := _FILTER.fullmatch(call):
        call, where = m[1], m[2]
    kind = value = share = None
    if m := _WITHIN.fullmatch(call):
        kind, share, value = m[1].lower(), m[2], m[3]
        if re.search(r"\s(DESC|ASC|NULLS\s+\w+)\s*$", value, re.I):
            return None
    elif m := _CALL.fullmatch(call):
        kind, share, value = {"median": "cont", "percentile": "cont", "mode": "mode"}[m[1].lower()], "0.5", m[2]
        if m[1].lower() == "percentile":
            split = re.fullmatch(rf"(.*),{_NUMBER}", value, re.S)
            if not split:
                return None
            value, share = split[1], split[2]
    if kind is None or not _whole(value) or not _whole(where) or re.match(r"\s*DISTINCT\b", value, re.I) or "," in re.sub(r"\(.*\)|'[^']*'", "", value, flags=re.S) or float(share) > 1:
        return None
    return Pick(kind, value.strip(), float(share), where, label)


def _type(df: DataFrame, p: Pick) -> T.DataType | None:
    """The type its values are counted in, or None if they are Spark's business."""
    kind = df.select(F.expr(p.value)).schema[0].dataType
    if p.kind == "cont":
        return T.DoubleType() if isinstance(kind, T.NumericType) else None
    return kind if isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType) else None


def aggregated(df: DataFrame, keys: list[str], texts: list[str], held: Held) -> DataFrame:
    """The aggregates of each group. Quantiles, medians and modes are picked from counted values.

    A group's values are counted, dealt to tasks by ranges of (group, value) and written: once for all
    items of a type. The counts of a group in each range tell which range holds a wanted place, and only
    that range's counts are summed up one by one. So a group of all rows is spread like many small ones,
    and each value is counted before it is sent. cont lies between two neighbours in proportion, as
    doubles; disc is a value of the group, of its type; of equally frequent values mode is the least.
    Nulls do not count; a group without values has null.
    """
    found = {i: (p, kind) for i, t in enumerate(texts) if (p := pick_of(t)) and (kind := _type(df, p))}
    picks = {i: p for i, (p, _) in found.items()}
    plain = df.groupBy(*[F.col(name(c)) for c in keys]).agg(*[F.lit(0).alias(picks[i].label) if i in picks else F.expr(t) for i, t in enumerate(texts)])
    if not picks:
        return plain
    labels = plain.columns[len(keys) :]
    by = [(f"k{i}", F.col(name(c))) for i, c in enumerate(keys)] or [("k0", F.lit(0))]
    names = [k for k, _ in by]
    rest = [F.expr(t).alias(f"a{i}") for i, t in enumerate(texts) if i not in picks] or [F.count(F.lit(1)).alias("all_")]
    out = df.groupBy(*[c.alias(k) for k, c in by]).agg(*rest) if keys else df.agg(*rest).withColumn("k0", F.lit(0))
    for n, kind in enumerate(dict.fromkeys(kind for _, kind in found.values())):
        items = list(dict.fromkeys((p.value, p.where) for p, k in found.values() if k == kind))
        values = [F.struct(F.lit(j).alias("item"), F.when(F.expr(where), F.expr(value).cast(kind)).alias("v")) for j, (value, where) in enumerate(items)]
        counted = df.select(*[c.alias(k) for k, c in by], F.inline(F.array(*values))).where("v IS NOT NULL").groupBy(*names, "item", "v").agg(F.count(F.lit(1)).alias("n"))
        made = _picked(counted, names, {i: (p, items.index((p.value, p.where))) for i, (p, k) in found.items() if k == kind}, held)
        out = out.join(made.withColumnsRenamed({k: f"{k}_{n}" for k in names}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_{n}")) for k in names]), "left")
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keys, strict=False)], *[F.col(f"a{i}").alias(x) for i, x in enumerate(labels)])


def _picked(counted: DataFrame, by: list[str], picks: dict[int, tuple[Pick, int]], held: Held) -> DataFrame:
    """(by, a column a<i> for each pick and its item) from the counts n of the values v of each group and item."""
    item, n, v, below, total = map(F.col, ("item", "n", "v", "below", "total"))
    modes = [F.min_by("v", F.when(item == j, F.struct(-n, v))).alias(f"a{i}") for i, (p, j) in picks.items() if p.kind == "mode"]
    ordered = {i: x for i, x in picks.items() if x[0].kind != "mode"}
    if not ordered:
        return counted.groupBy(*by).agg(*modes)
    ranges = held(counted.repartitionByRange(*by, "item", "v").withColumn("part", F.spark_partition_id()))
    group = Window.partitionBy(*by, "item")
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*by, "item", "part").agg(F.sum("n").alias("here"))
    sums = sums.withColumns({"below": F.coalesce(F.sum("here").over(earlier), F.lit(0)), "total": F.sum("here").over(group)})
    wanted = [(item == j) & (x > below) & (x <= below + F.col("here")) for p, j in ordered.values() for x in _places(p, total)]
    same = [*by, "item", "part"]
    near = sums.where(reduce(lambda a, b: a | b, wanted)).select(*[F.col(c).alias(f"{c}_") for c in same], "below", "total")
    placed = ranges.join(near, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same]))
    upto = below + F.sum("n").over(Window.partitionBy(*same).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("upto", upto)
    at = [
        F.max(F.when((item == j) & (x <= F.col("upto")) & (x > F.col("upto") - n), v)).alias(f"v{i}_{m}")
        for i, (p, j) in ordered.items() for m, x in enumerate(_places(p, total))
    ]
    made = placed.groupBy(*by).agg(*at, *[F.max(F.when(item == j, total)).alias(f"n{i}") for i, (_, j) in ordered.items()])
    made = made.select(*by, *[_value(i, p).alias(f"a{i}") for i, (p, _) in ordered.items()])
    if not modes:
        return made
    most = ranges.groupBy(*by).agg(*modes)
    made = made.withColumnsRenamed({k: f"{k}_" for k in by})
    return most.join(made, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in by]), "left").drop(*[f"{k}_" for k in by])


def _places(p: Pick, total: Column) -> list[Column]:
    """The places, from 1, of the values that a pick is made of."""
    if p.kind == "disc":
        return [F.greatest(F.lit(1), total - F.floor(total - total * F.lit(p.share)))]
    x = (total - 1) * F.lit(p.share)
    return [F.floor(x) + 1, F.ceil(x) + 1]


def _value(i: int, p: Pick) -> Column:
    low, high, x = F.col(f"v{i}_0"), F.col(f"v{i}_1"), (F.col(f"n{i}") - 1) * F.lit(p.share)
    return low if p.kind == "disc" else F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)


# --- samples ---------------------------------------------------------------------------------------

#: Up to so many rows are the least of a draw for each row, found in one pass: every task keeps that many.
FEW = 1000
#: Cells of equal width that the draws of a larger sample are counted in.
CELLS = 1 << 16


def sampled(df: DataFrame, size: float, percent: bool, seed: int, held: Held) -> DataFrame:
    """Exactly that many rows, or that share of them rounded, drawn at random; all, if there are fewer.

    A few rows take one pass and no count. For more, somewhat more rows than wanted are drawn by a number
    for each row and written; the numbers are counted by cells, the cells below the last row's are taken
    whole, and only that cell's rows, one part in 65,536 of the sample, are put in order. If too few were
    drawn the draw is made again with twice the share, at last of all rows.
    """
    r = free(df, "draw_")[0]
    numbered = df.withColumn(r, F.rand(seed))
    if not percent and size < FEW:
        return numbered.orderBy(name(r)).limit(int(size)).drop(r) if size >= 1 else df.limit(0)
    total = df.count()
    n = min(total, round(total * size / 100) if percent else int(size))
    if n == 0 or n == total:
        return df if n else df.limit(0)
    share = min(1.0, (n + 8 * n**0.5 + 64) / total)
    while True:
        cell = F.floor(F.col(name(r)) * F.lit(CELLS / share))
        drawn = held(numbered.where(F.col(name(r)) < F.lit(share)))
        counts = sorted(tuple(x) for x in drawn.groupBy(cell.alias("cell")).count().collect())
        if sum(c for _, c in counts) >= n or share == 1.0:
            break
        share = min(1.0, 2 * share)
    left = n
    for last, c in counts:  # noqa: B007
        if c >= left:
            break
        left -= c
    else:
        return drawn.drop(r)
    return drawn.where(cell < last).unionAll(drawn.where(cell == last).orderBy(name(r)).limit(left)).drop(r)
