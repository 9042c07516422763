"""Operators on an order of all rows: numbers, running values, neighbours, as-of, positional and range joins.

None of them brings all rows, or all rows of a key, to one task. Rows are dealt to tasks by ranges of
their order and written; each task works on its range, and what a range needs of those before it is
a row for each range.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import name

Held = Callable[[DataFrame], DataFrame]
#: An expression to order by, whether it descends, whether nulls come first.
Key = tuple[str, bool, bool]


def in_order(key: Key) -> Column:
    value, down, nulls_first = F.expr(key[0]), key[1], key[2]
    if down:
        return value.desc_nulls_first() if nulls_first else value.desc_nulls_last()
    return value.asc_nulls_first() if nulls_first else value.asc_nulls_last()


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    out = []
    for n in names:
        while n in df.columns:
            n += "_"
        out.append(n)
    return out


def dealt(df: DataFrame, keys: list[Key], part: str, tie: str, held: Held) -> DataFrame:
    """df in ranges of the order, written, with the number of each row's range in `part` and in `tie` a
    number that parts rows of equal keys, so that a key of very many rows is dealt to many ranges."""
    salted = df.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    return held(salted.repartitionByRange(*map(in_order, keys), F.col(name(tie))).withColumn(part, F.spark_partition_id()))


def before(df: DataFrame, part: str, totals: dict[str, Column], zero: dict[str, Column]) -> DataFrame:
    """(part, a column for each of totals): what the ranges before each range sum up to.

    The sums of the ranges, a row for each, are paired with those after them by a join: their number is
    that of the tasks of one shuffle.
    """
    one = df.groupBy(part).agg(*[c.alias(n) for n, c in totals.items()])
    rows = [tuple(r) for r in one.collect()]
    sums, seen = [], [None] * len(totals)
    for r in sorted(rows):
        sums.append((r[0], *seen))
        seen = [a if b is None else b if a is None else _PLUS[n](a, b) for n, a, b in zip(totals, seen, r[1:], strict=True)]
    made = df.sparkSession.createDataFrame(sums, T.StructType([T.StructField(f.name, f.dataType) for f in one.schema]))
    return F.broadcast(made.select(part, *[F.coalesce(F.col(n), zero[n]).alias(n) if n in zero else F.col(n) for n in totals]))


def _added(a, b):
    return a + b


_PLUS = {"rows_": _added, "sum_": _added, "count_": _added, "min_": min, "max_": max}


def numbered(df: DataFrame, keys: list[Key], number: str, held: Held) -> DataFrame:
    """df with the place of each row in the order, from 1. Rows of equal keys are in any order, the same for
    all that read the result."""
    part, tie = free(df, "part_", "tie_")
    ranges = dealt(df, keys, part, tie, held)
    sums = before(ranges, part, {"rows_": F.count(F.lit(1))}, {"rows_": F.lit(0)}).withColumnRenamed("rows_", free(ranges, "rows_")[0])
    lift = [c for c in sums.columns if c != part][0]
    within = Window.partitionBy(part).orderBy(*map(in_order, keys), name(tie))
    placed = ranges.withColumn(number, F.row_number().over(within).cast("long"))
    out = placed.join(sums, part).withColumn(number, F.col(name(number)) + F.col(lift))
    return out.select(*[F.col(name(c)) for c in df.columns], F.col(name(number)))


# --- windows over the whole relation ---------------------------------------------------------------

_CALL = re.compile(r"\s*(\w+)\s*\((.*)\)\s*", re.S)
_FRAME = re.compile(r"(.*?)\s+(ROWS|RANGE)\s+BETWEEN\s+UNBOUNDED\s+PRECEDING\s+AND\s+CURRENT\s+ROW\s*$", re.S | re.I)
_SUMS = {"sum", "count", "avg", "min", "max"}
_RANKS = {"rank", "dense_rank", "percent_rank", "cume_dist"}


def split_frame(order: str) -> tuple[str, str]:
    """The keys of an ORDER BY and its frame: range and rows are those up to the current row."""
    if m := _FRAME.fullmatch(order):
        return m[1], m[2].lower()
    return order, "other" if re.search(r"\s(ROWS|RANGE|GROUPS)\s+", order, re.I) else "range"


def over_all(df: DataFrame, expression: str, keys: list[Key] | None, frame: str, held: Held) -> DataFrame | None:
    """df with the expression over all its rows in the order as column `over_`, or None for what has to be
    left to a window in one task: frames that end elsewhere, functions that look at all values before.
    """
    m = _CALL.fullmatch(expression)
    if not m or frame == "other":
        return None
    call, inside = m[1].lower(), m[2].strip()
    if keys is None:
        return _whole(df, f"{call}({inside})") if call in _SUMS else None
    arguments = _arguments(inside)
    if re.search(r"\bDISTINCT\b|IGNORE\s+NULLS", inside, re.I):
        return None
    if call == "row_number":
        return numbered(df, keys, "over_", held).withColumn("over_", F.col("over_").cast("int"))
    if call in ("lag", "lead"):
        return _neighbour(df, call, arguments, keys, held)
    if call == "ntile" and arguments[0].isdecimal():
        return _ntile(df, int(arguments[0]), keys, held)
    if call in _RANKS or (call in _SUMS and frame == "range"):
        return _by_key(df, call, inside, keys, held)
    if call in _SUMS:
        part, tie = free(df, "part_", "tie_")
        return _running(df, call, inside, dealt(df, keys, part, tie, held), keys, part, tie)
    return None


def _arguments(text: str) -> list[str]:
    from ..functions.dialect import split_list

    return [x.strip() for x in split_list(text)] if text else []


def _whole(df: DataFrame, call: str) -> DataFrame:
    """One row for all rows, joined to each of them."""
    return df.crossJoin(F.broadcast(df.agg(F.expr(call).alias("over_"))))


def _neighbour(df: DataFrame, call: str, arguments: list[str], keys: list[Key], held: Held) -> DataFrame | None:
    """The value of the row so many places away: a join of numbers."""
    away = arguments[1] if len(arguments) > 1 else "1"
    if not away.isdecimal():
        return None
    at, value = free(df, "at_", "value_")
    rows = held(numbered(df, keys, at, held))
    step = int(away) if call == "lag" else -int(away)
    near = rows.select((F.col(at) + step).alias(f"{at}near"), F.expr(arguments[0]).alias(value))
    found = F.col(value)
    if len(arguments) > 2:
        found = F.when(F.col(f"{at}near").isNull(), F.expr(arguments[2])).otherwise(found)
    return rows.join(near, F.col(at) == F.col(f"{at}near"), "left").withColumn("over_", found).drop(at, value, f"{at}near")


def _ntile(df: DataFrame, n: int, keys: list[Key], held: Held) -> DataFrame:
    (at,) = free(df, "at_")
    rows = held(numbered(df, keys, at, held))
    total = rows.count()
    size, more = divmod(total, n)
    k = F.col(at) - 1
    large = more * (size + 1)
    small = F.floor((k - large) / F.lit(size)) + more if size else F.lit(0)
    return rows.withColumn("over_", (F.when(k < large, F.floor(k / (size + 1))).otherwise(small) + 1).cast("int")).drop(at)


def _partials(inside: str) -> dict[str, Column]:
    value = F.lit(1) if inside == "*" else F.expr(inside)
    return {"sum_": F.sum(value) if inside != "*" else F.count(value), "count_": F.count(value), "min_": F.min(value), "max_": F.max(value)}


_WANTED = {"sum": ("sum_", "count_"), "count": ("count_",), "avg": ("sum_", "count_"), "min": ("min_",), "max": ("max_",)}


def _result(call: str, kind: T.DataType | None) -> Column:
    if call == "count":
        return F.col("count_")
    if call == "avg":
        return F.when(F.col("count_") > 0, F.col("sum_").cast("double") / F.col("count_"))
    if call == "sum":
        return F.when(F.col("count_") > 0, F.col("sum_"))
    return F.col(f"{call}_")


def _joined(a: Column, b: Column, n: str) -> Column:
    """Two partial values, either of which may be null."""
    if n in ("min_", "max_"):
        return (F.least if n == "min_" else F.greatest)(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _running(df: DataFrame, call: str, inside: str, ranges: DataFrame, keys: list[Key], part: str, tie: str) -> DataFrame:
    """The aggregate of the rows up to each row: within its range, and what the ranges before sum up to."""
    wanted = {n: c for n, c in _partials(inside).items() if n in _WANTED[call]}
    sums = before(ranges, part, wanted, {})
    sums = sums.select(part, *[F.col(n).alias(f"{n}before_") for n in wanted])
    within = Window.partitionBy(part).orderBy(*map(in_order, keys), name(tie)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranges.select("*", *[c.over(within).alias(n) for n, c in wanted.items()]).join(sums, part)
    whole = local.select(*[F.col(name(c)) for c in df.columns], *[_joined(F.col(n), F.col(f"{n}before_"), n).alias(n) for n in wanted])
    return whole.withColumn("over_", _result(call, None)).select(*[F.col(name(c)) for c in df.columns], "over_")


def _by_key(df: DataFrame, call: str, inside: str, keys: list[Key], held: Held) -> DataFrame:
    """Functions that treat rows of equal keys alike: an aggregate for each key, running values over the
    keys, joined back to the rows. A key that many rows share is summed up before it is shuffled."""
    names = [f"key{i}_" for i in range(len(keys))]
    plain = [(n, down, first) for n, (_, down, first) in zip(names, keys, strict=True)]
    values = [F.expr(e).alias(n) for n, (e, _, _) in zip(names, keys, strict=True)]
    partials = _partials(inside or "1")
    wanted = {n: c for n, c in partials.items() if n in _WANTED.get(call, ())}
    per = df.groupBy(*values).agg(F.count(F.lit(1)).alias("rows_"), *[c.alias(n) for n, c in wanted.items()])
    ranges = dealt(per, plain, "part_", "tie_", held)
    ordered = Window.partitionBy("part_").orderBy(*map(in_order, plain)).rowsBetween(Window.unboundedPreceding, 0)
    again = {"rows_": F.sum("rows_"), "sum_": F.sum("sum_"), "count_": F.sum("count_"), "min_": F.min("min_"), "max_": F.max("max_")}
    running = {n: again[n] for n in ("rows_", *wanted)}
    sums = before(ranges, "part_", running, {})
    sums = sums.select("part_", *[F.col(n).alias(f"{n}before_") for n in running])
    local = ranges.select("part_", *names, F.col("rows_").alias("own_"), *[c.over(ordered).alias(n) for n, c in running.items()])
    dense = F.row_number().over(Window.partitionBy("part_").orderBy(*map(in_order, plain)))
    if call == "dense_rank":
        keys_before = before(ranges, "part_", {"rows_": F.count(F.lit(1))}, {"rows_": F.lit(0)}).withColumnRenamed("rows_", "keys_")
        local = local.withColumn("dense_", dense).join(keys_before, "part_")
    whole = local.join(sums, "part_").select(
        *[F.col(n).alias(f"{n}of_") for n in names], "own_", *(["dense_", "keys_"] if call == "dense_rank" else []),
        *[_joined(F.col(n), F.col(f"{n}before_"), n).alias(n) for n in running],
    )
    first = F.col("rows_") - F.col("own_") + 1
    if call in ("percent_rank", "cume_dist"):
        total = per.agg(F.sum("rows_")).first()[0] or 0
    result = {
        "rank": lambda: first.cast("int"),
        "dense_rank": lambda: (F.col("dense_") + F.col("keys_")).cast("int"),
        "percent_rank": lambda: ((first - 1) / F.lit(total - 1)).cast("double") if total > 1 else F.lit(0.0),
        "cume_dist": lambda: (F.col("rows_") / F.lit(total)).cast("double"),
    }.get(call, lambda: _result(call, None))()
    found = whole.select(*[f"{n}of_" for n in names], result.alias("over_"))
    rows = df.select("*", *values)
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}of_")) for n in names])
    return rows.join(found, same).select(*[F.col(name(c)) for c in df.columns], "over_")


# --- joins by order --------------------------------------------------------------------------------


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, held: Held, *, strict: bool = False, keep: bool = False) -> DataFrame:
    """Each row of left with the last row of right of the same keys whose right_on is not later than its
    left_on (earlier, if strict); rows without one are dropped unless keep. Of right rows at the same time
    any one is taken, the same in every run over the same rows.

    Both sides are dealt by ranges of (keys, time), so that a key's rows may lie in many ranges. Within a
    range the last right row is carried on; only the first key of a range can have begun before it, and
    for that the last right row of the ranges before is added: a row for each range at most. Rows with a
    null key or time match nothing. left has no column of right but the keys.
    """
    rest = [c for c in right.columns if c not in keys]
    names = [f"key{i}_" for i in range(len(keys))]
    payload = F.struct(*[F.col(name(c)) for c in rest])
    own = F.struct(*[F.col(name(c)) for c in left.columns])
    lefts = left.select(*[F.col(name(k)).alias(n) for k, n in zip(keys, names, strict=True)], F.col(name(left_on)).alias("time_"), F.lit(0 if strict else 1).alias("side_"), own.alias("left_"), F.xxhash64(F.monotonically_increasing_id()).alias("tie_"))
    rights = right.select(*[F.col(name(k)).alias(n) for k, n in zip(keys, names, strict=True)], F.col(name(right_on)).alias("time_"), F.lit(1 if strict else 0).alias("side_"), payload.alias("right_"), F.xxhash64(payload).alias("tie_"))
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in [*names, "time_"]])
    matched = lefts.where(known).unionByName(rights.where(known), allowMissingColumns=True)
    order = ["time_", "side_", "tie_"]
    ranges = held(matched.repartitionByRange(*names, *order).withColumn("part_", F.spark_partition_id()))
    key = F.struct(*names) if names else F.struct(F.lit(0).alias("all_"))
    last = F.last("right_", ignorenulls=True)
    within = Window.partitionBy("part_", *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = ranges.where("left_ is not null or right_ is not null").withColumn("seen_", last.over(within)).where("left_ is not null")
    edges = ranges.groupBy("part_").agg(F.min(key).alias("first_"), F.max(key).alias("last_"))
    # The last right row of each range's last key, which the next ranges may go on with.
    ends = ranges.where("right_ is not null").join(edges, "part_").where(key == F.col("last_"))
    ends = ends.groupBy("part_", "last_").agg(F.max_by("right_", F.struct(*order)).alias("end_")).select(F.col("part_").alias("of_"), F.col("last_").alias("key_"), "end_")
    begun = edges.join(ends, (F.col("first_") == F.col("key_")) & (F.col("of_") < F.col("part_")))
    begun = begun.groupBy("part_", "first_").agg(F.max_by("end_", "of_").alias("end_"))
    joined = carried.join(begun, (carried["part_"] == begun["part_"]) & (key == F.col("first_")), "left").select("left_", F.coalesce("seen_", "end_").alias("right_"))
    if keep:
        unknown = lefts.where(~known).select("left_", F.lit(None).cast(joined.schema["right_"].dataType).alias("right_"))
        joined = joined.unionAll(unknown)
    else:
        joined = joined.where("right_ is not null")
    return joined.select("left_.*", "right_.*")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Key], right_order: list[Key], held: Held) -> DataFrame:
    """The first row of left beside the first of right in their orders, and so on; the longer side's other
    rows have nulls beside them. Columns of both sides have different names."""
    both = left.crossJoin(right.limit(0))
    a, b = free(both, "left_at_", "right_at_")
    return numbered(left, left_order, a, held).join(numbered(right, right_order, b, held), F.col(a) == F.col(b), "full").drop(a, b)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, *, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Rows of left whose `point` lies between `low` and `high` of a row of right. Columns of both sides have
    different names; nulls and intervals that end before they begin match nothing.

    Each interval is put into cells twice as long as itself at most, whose length is a power of two: it
    touches two of them at most. A point is in one cell of each length that occurs. Rows that share a cell
    meet by an equal key, which Spark splits where many rows share it, and are then compared exactly.
    An interval meets points within four times its length only, however long others are.
    """
    times = isinstance(left.schema[point].dataType, T.TimestampType | T.TimestampNTZType | T.DateType)

    def measure(c: str) -> Column:
        """The column as a number that grows as it does; what has no end ends somewhere."""
        value = F.unix_micros(F.col(name(c)).cast("timestamp")).cast("double") if times else F.col(name(c)).cast("double")
        return F.when(F.isnan(value), 1e300).otherwise(F.greatest(F.least(value, F.lit(1e300)), F.lit(-1e300)))

    def power(x: Column) -> Column:
        return F.ceil(F.log2(F.greatest(x, F.lit(1e-300))))

    def cells(x: Column, exponent: Column) -> Column:
        return F.rint(x / F.pow(F.lit(2.0), exponent.cast("double")) - 0.5)

    a, b = measure(low), measure(high)
    size = F.greatest(power(b - a), power(F.greatest(F.abs(a), F.abs(b))) - 52).cast("int")  # cells that doubles can count
    level, cell = free(left.crossJoin(right.limit(0)), "level_", "cell_")
    spans = right.where(a <= b).withColumn(level, size)
    first, last = cells(a, F.col(level)), cells(b, F.col(level))
    spans = spans.withColumn(cell, F.explode(F.filter(F.array_distinct(F.array(first, first + 1, first + 2)), lambda x: x <= last)))
    levels = sorted(r[0] for r in right.where(a <= b).select(size.alias("s")).distinct().collect())  # some dozens: one for each power of two
    points = left.where(F.col(name(point)).isNotNull()).withColumn(level, F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    points = points.withColumn(cell, cells(measure(point), F.col(level)))
    p, x, y = (F.col(name(c)) for c in (point, low, high))
    inside = (p > x if low_open else p >= x) & (p < y if high_open else p <= y)
    return points.join(spans, [level, cell]).where(inside).drop(level, cell)


# --- aggregates over ranges ------------------------------------------------------------------------

#: Different points in a block, and intervals that are looked up in a block by one task at a time.
_BLOCK, _LOOKUPS = 1 << 14, 1 << 16
#: Whole numbers are summed up in three parts of so many bits, which do not overflow where their sum does not.
_BITS = 22
_TOTAL = re.compile(r"(?:CAST\s*\(\s*)?(count|sum|min|max)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s+AS\s+([\w(), ]+?)\s*\))?(?:\s+AS)?\s+[`\"]?(\w+)[`\"]?\s*", re.S | re.I)


def total_of(item: str) -> tuple[str, str, str | None, str] | None:
    """Call, value, type and name of an item that range_totals knows, in Spark's text; None for any other."""
    m = _TOTAL.fullmatch(item)
    cast = bool(m and re.match(r"\s*CAST\s*\(", item, re.I))
    if not m or cast != bool(m[3]) or re.match(r"\s*(DISTINCT|ALL)\b", m[2], re.I) or (m[2].strip() == "*" and m[1].lower() != "count"):
        return None
    return m[1].lower(), m[2].strip(), m[3], m[4]


@dataclass(frozen=True)
class _Part:
    """A column of partial values, and how numpy folds them, with what adds nothing."""

    name: str
    kind: str
    fold: str
    zero: float

    @property
    def dtype(self) -> str:
        return "float64" if self.kind == "double" else "int64"


def _parts(df: DataFrame, totals: list[tuple[str, str, str | None, str]]) -> tuple[list[_Part], list[Column], list[Column], list[Column]]:
    """The partial columns that the totals need, as aggregates of rows and of such columns, and the totals
    from the last of them."""
    parts, firsts, agains, out = [], [], [], []

    def part(label: str, first: Column, again: Column, *more) -> None:
        parts.append(_Part(label, *more))
        firsts.append(first.alias(label))
        agains.append(again.alias(label))

    part("rows_", F.count(F.lit(1)), F.sum("rows_"), "long", "add", 0)
    for i, (call, text, cast, label) in enumerate(totals):
        value = F.lit(1) if text == "*" else F.expr(text)
        kind = df.select(value.alias("v")).schema[0].dataType
        if call != "count" and not isinstance(kind, T.IntegralType | T.DoubleType | T.FloatType):
            raise ValueError(f"{call}({text}) is of {kind.simpleString()}; ranges are summed up for whole numbers and doubles")
        whole = isinstance(kind, T.IntegralType)
        number, least, most = ("long", -(1 << 63), (1 << 63) - 1) if whole else ("double", float("nan"), float("-inf"))
        seen = f"count{i}_"
        part(seen, F.count(value), F.sum(seen), "long", "add", 0)
        found = F.coalesce(F.col(seen), F.lit(0))
        if call == "sum" and whole:
            long, mask = value.cast("long"), F.lit((1 << _BITS) - 1)
            for j, x in enumerate((F.shiftright(long, 2 * _BITS), F.shiftright(long, _BITS).bitwiseAND(mask), long.bitwiseAND(mask))):
                part(f"sum{i}_{j}_", F.sum(x), F.sum(F.col(f"sum{i}_{j}_").cast("decimal(20,0)")), "long", "add", 0)
            high, middle, low = (F.col(f"sum{i}_{j}_").cast("decimal(32,0)") for j in range(3))
            shift = F.lit(1 << _BITS).cast("decimal(8,0)")
            found = ((high * shift).cast("decimal(38,0)") + middle).cast("decimal(30,0)") * shift + low
            found = F.when(F.col(seen) > 0, found.cast("long"))
        elif call != "count":
            fold = {"sum": "add", "min": "minimum" if whole else "fmin", "max": "maximum"}[call]
            zero = 0 if call == "sum" else most if whole and call == "min" else least if whole or call == "min" else most
            again = {"sum": F.sum, "min": F.min, "max": F.max}[call]
            part(f"{call}{i}_", again(value).cast(number), again(f"{call}{i}_"), number, fold, zero)
            found = F.when(F.col(seen) > 0, F.col(f"{call}{i}_")).cast(kind if call != "sum" else "double")
        out.append((found.cast(cast) if cast else found).alias(label))
    return parts, firsts, agains, out


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Times and days as whole numbers that grow as they do, numbers as they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    if not pa.types.is_floating(column.type):
        return column.cast(pa.int64()).to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _values(parts: list[_Part], table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """The partial columns in numpy; nulls, values of no row, as what adds nothing."""
    return [_numbers(table.column(p.name).fill_null(pa.scalar(p.zero, pa.float64() if p.kind == "double" else pa.int64()))) for p in parts]


def _folded(parts: list[_Part], values: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """For each i the values from start[i] up to stop[i] folded, by a tree of pairs, pairs of pairs, and so on."""
    out = [np.full(len(start), p.zero, p.dtype) for p in parts]
    start, stop = start.copy(), stop.copy()
    while (left := start < stop).any():
        ahead = np.nonzero(left & (start & 1 == 1))[0]
        for p, o, v in zip(parts, out, values, strict=True):
            o[ahead] = getattr(np, p.fold)(o[ahead], v[start[ahead]])
        start[ahead] += 1
        behind = np.nonzero((start < stop) & (stop & 1 == 1))[0]
        for p, o, v in zip(parts, out, values, strict=True):
            o[behind] = getattr(np, p.fold)(o[behind], v[stop[behind] - 1])
        stop[behind] -= 1
        start >>= 1
        stop >>= 1
        values = [getattr(np, p.fold).reduce(np.append(v, np.full(len(v) % 2, p.zero, p.dtype)).reshape(-1, 2), axis=1) for p, v in zip(parts, values, strict=True)]
    return out


def range_totals(
    left: DataFrame, right: DataFrame, point: str, low: str, high: str, totals: list[tuple[str, str, str | None, str]], keys: list[str], held: Held, *, low_open: bool = False, high_open: bool = False
) -> DataFrame:
    """What grouping range_join by columns of right and aggregating columns of left gives, without its pairs,
    whose number grows with the product of both sides.

    Rows of left at the same point are summed up and dealt by ranges of the points, and cut into blocks of
    16,384 points; a row for each block goes to all tasks. An interval is looked up in the block in
    which it begins and in that in which it ends; the blocks between count as a whole. Lookups of a block
    are dealt to several tasks where they are many, each with a copy of the block.
    """
    kinds = [left.schema[point].dataType, right.schema[low].dataType, right.schema[high].dataType]
    if not (all(isinstance(k, T.IntegralType) for k in kinds) or all(isinstance(k, T.FloatType | T.DoubleType) for k in kinds) or (len(set(kinds)) == 1 and isinstance(kinds[0], T.DatetimeType))):
        raise ValueError(f"'{point}', '{low}' and '{high}' are of {', '.join(k.simpleString() for k in kinds)}; ranges are summed up between whole numbers, doubles or times of one type")
    parts, firsts, agains, results = _parts(left, totals)
    names, labels = [p.name for p in parts], [f"key{i}_" for i in range(len(keys))]
    at, begin, end, block, share, first, turn = "at_", "begin_", "end_", "block_", "share_", "first_", "turn_"
    per = left.where(F.col(name(point)).isNotNull()).groupBy(F.col(name(point)).alias(at)).agg(*firsts)
    ranges = held(per.repartitionByRange(at).withColumn("part_", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(at)) - 1
    points = ranges.withColumn(block, F.shiftleft(F.col("part_").cast("long"), 32) + F.floor(place / _BLOCK)).drop("part_")
    blocks = points.groupBy(block).agg(F.min(at).alias(at), *[c.cast(p.kind).alias(p.name) for p, c in zip(parts, agains, strict=True)]).toArrow().sort_by(block)
    edges, numbers, sums = _numbers(blocks.column(at)), _numbers(blocks.column(block)), _values(parts, blocks)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each interval with the block it begins in, and with that it ends in, if that is another, and
        with the first block between."""
        turns = 0
        for batch in batches:
            a, b = (np.searchsorted(edges, _numbers(batch.column(c)), "right") - 1 for c in (begin, end))
            some = np.nonzero(b >= 0)[0]
            two = np.nonzero((b >= 0) & (np.maximum(a, 0) < b))[0]
            for rows, of, after in ((some, np.maximum(a, 0)[some], np.full(len(some), -1)), (two, b[two], np.maximum(a, 0)[two] + 1)):
                more = [pa.array(numbers[of], pa.int64()), pa.array(after, pa.int32()), pa.array(np.arange(turns, turns + len(rows)), pa.int64())]
                turns += len(rows)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, *more], [*batch.schema.names, block, first, turn])

    def found(group: tuple, times: pa.Table, spans: pa.Table) -> pa.Table:
        """The partial values of the intervals that were looked up in a block."""
        times = times.sort_by(at)
        t, a, b, after = _numbers(times.column(at)), *(_numbers(spans.column(c)) for c in (begin, end, first))
        start, stop = np.searchsorted(t, a, "right" if low_open else "left"), np.searchsorted(t, b, "left" if high_open else "right")
        values = _folded(parts, _values(parts, times), start, stop)
        own = np.searchsorted(numbers, group[0].as_py())
        between = _folded(parts, sums, np.where(after < 0, own, after).astype(np.int64), np.full(len(after), own))
        values = [getattr(np, p.fold)(x, y) for p, x, y in zip(parts, values, between, strict=True)]
        some = np.nonzero(values[0] > 0)[0]
        return pa.table([*[spans.column(c).take(pa.array(some)) for c in labels], *[pa.array(v[some]) for v in values]], names=[*labels, *names])

    x, y = F.col(name(low)), F.col(name(high))
    spans = right.where(x <= y).select(*[F.col(name(k)).alias(n) for k, n in zip(keys, labels, strict=True)], x.alias(begin), y.alias(end))
    fields = lambda *more: T.StructType([*[T.StructField(n, right.schema[k].dataType) for k, n in zip(keys, labels, strict=True)], *[T.StructField(n, k) for n, k in more]])
    wanted = held(spans.mapInArrow(looked_up, fields((begin, kinds[1]), (end, kinds[2]), (block, T.LongType()), (first, T.IntegerType()), (turn, T.LongType()))))
    shares = F.broadcast(wanted.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / _LOOKUPS).alias(share)))
    copies = points.join(shares, block).withColumn(share, F.explode(F.sequence(F.lit(0).cast("long"), F.col(share) - 1)))
    dealt_ = wanted.join(shares, block).withColumn(share, F.col(turn) % F.col(share))
    kind = fields(*[(p.name, T.DoubleType() if p.kind == "double" else T.LongType()) for p in parts])
    partial = copies.groupBy(block, share).cogroup(dealt_.groupBy(block, share)).applyInArrow(found, kind)
    return partial.groupBy(*labels).agg(*agains).select(*[F.col(n).alias(k) for k, n in zip(keys, labels, strict=True)], *results)
