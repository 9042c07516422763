"""Filter, shape, join, aggregate, window, pivot, order and combine relations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import name, order_list, spark_type, split_list, translate
from ..registry import Step, component, need, one_of, opt
from . import ordered, selection


def col(c: str) -> Column:
    return F.col(name(c))


def must_have(step: Step, prop: str, df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise step.bad(prop, f"there is no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def sql_list(text: str) -> list[str]:
    return [translate(x) for x in split_list(text)]


@component("xf.filter", {"predicate": need("sql")})
def filter_rows(step: Step) -> DataFrame:
    """Rows for which the predicate is true; unknown counts as false."""
    return step.df.where(F.expr(translate(step["predicate"])))


@component("xf.select", {"columns": need("strings")})
def select(step: Step) -> DataFrame:
    """The named columns, in the given order."""
    must_have(step, "columns", step.df, step["columns"])
    return step.df.select(*[col(c) for c in step["columns"]])


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names get _1, _2 ... from their second occurrence on."""
    seen: set[str] = set()
    out = []
    for c in df.columns:
        n, new = 0, c
        while new in seen:
            n += 1
            new = f"{c}_{n}"
        seen.add(new)
        out.append(new)
    return df if out == df.columns else df.toDF(*out)


@component("xf.derive", {"expressions": need("sql")})
def derive(step: Step) -> DataFrame:
    """All columns and the expressions of a select list."""
    return unique_names(step.df.selectExpr("*", *sql_list(step["expressions"])))


@component("xf.rename", {"columns": need("map")})
def rename(step: Step) -> DataFrame:
    """Old name to new name; every column keeps its place, and a missing one is an error."""
    must_have(step, "columns", step.df, step["columns"])
    return step.df.select(*[col(c).alias(step["columns"].get(c, c)) for c in step.df.columns])


def cast_column(c: Column, source: T.DataType, kind: str) -> Column:
    """A cast that rounds fractions to whole numbers: doubles half to even, decimals half up."""
    whole = kind.split("(")[0] in ("TINYINT", "SMALLINT", "INT", "BIGINT")
    if whole and isinstance(source, T.DoubleType | T.FloatType):
        c = F.rint(c)
    elif whole and isinstance(source, T.DecimalType):
        c = F.round(c, 0)
    elif whole and isinstance(source, T.StringType):
        c = F.round(c.cast("decimal(38,10)"), 0)
    return c.cast(kind)


@component("xf.cast", {"columns": need("map")})
def cast(step: Step) -> DataFrame:
    """Column to type; every column keeps its place, and a value that does not fit is an error."""
    must_have(step, "columns", step.df, step["columns"])
    types = {f.name: f.dataType for f in step.df.schema.fields}
    return step.df.select(*[cast_column(col(c), types[c], spark_type(step["columns"][c])).alias(c) if c in step["columns"] else col(c) for c in step.df.columns])


@component("xf.sql", {"query": need("sql")}, many=True)
def sql(step: Step) -> DataFrame:
    """A query over the relations of the pipeline so far, by node id or alias."""
    text = translate(step["query"].strip().rstrip(";"))
    for relation, df in step.relations.items():
        if re.search(rf"(?<!\w){re.escape(relation)}(?!\w)", text):
            df.createOrReplaceTempView(name(relation))
    return step.spark.sql(text)


@component("xf.distinct")
def distinct(step: Step) -> DataFrame:
    """Each distinct row once."""
    return step.df.distinct()


@component("xf.dedup", {"keys": need("strings"), "order_by": opt("sql")})
def dedup(step: Step) -> DataFrame:
    """One row of each key: the first by order_by, any row without it.

    With an order this is an aggregation that keeps one row, combined before the shuffle, not a
    window: a key that holds a third of all rows is no burden to one task.
    """
    df, keys = step.df, step["keys"]
    must_have(step, "keys", df, keys)
    if not step["order_by"]:
        return df.dropDuplicates(keys)
    items = [_order_key(x) for x in order_list(step["order_by"])]
    kinds = df.select(*[F.expr(e).alias(f"k{i}") for i, (e, _, _) in enumerate(items)]).schema
    parts = []
    for (e, down, nulls_first), f in zip(items, kinds, strict=True):
        value = F.expr(e)
        parts += [F.when(value.isNull(), 0 if nulls_first else 2).otherwise(1), _descending(value, f.dataType) if down else value]
    picked = df.groupBy(*[col(k) for k in keys]).agg(F.min_by(F.struct(*[col(c) for c in df.columns]), F.struct(*parts)).alias("row_"))
    return picked.select("row_.*")


def _descending(value: Column, kind: T.DataType) -> Column:
    """A value that ascends as the given one descends."""
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(value)
    if isinstance(kind, T.NumericType):
        return -value
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.bitwise_not(F.unix_micros(value.cast("timestamp")))
    if isinstance(kind, T.BooleanType):
        return ~value
    if isinstance(kind, T.StringType | T.BinaryType):  # bytes inverted; a longer text comes before its beginning
        return F.concat(F.translate(F.hex(value), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    raise ValueError(f"rows cannot be ordered by {kind.simpleString()} in descending order")


def _order_key(item: str) -> tuple[str, bool, bool]:
    """Expression, whether it descends, whether nulls come first."""
    m = re.fullmatch(r"(.*?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?", item, re.S | re.I)
    return m[1], (m[2] or "").upper() == "DESC", (m[3] or "").upper() == "FIRST"


@component("xf.sort", {"by": need("sql")})
def sort(step: Step) -> DataFrame:
    """Rows in order; nulls last in both directions unless the key says otherwise."""
    return step.df.orderBy(*[F.expr(e).desc_nulls_first() if d and f else F.expr(e).desc_nulls_last() if d else F.expr(e).asc_nulls_first() if f else F.expr(e).asc_nulls_last() for e, d, f in map(_order_key, order_list(step["by"]))])


def _limit_check(node: str, p: dict) -> None:
    from ..registry import InvalidProperty

    if p["count"] is None and not p["offset"]:
        raise InvalidProperty(node, "count", "is required")


@component("xf.limit", {"count": opt("integer"), "offset": opt("integer", 0)}, check=_limit_check)
def limit(step: Step) -> DataFrame:
    """`count` rows after `offset`, or all rows after it if there is an offset alone."""
    for p in ("count", "offset"):
        if (step[p] or 0) < 0:
            raise step.bad(p, "must not be negative")
    if step["offset"] and step["count"] is None:
        return _after(step, step["offset"])
    df = step.df.offset(step["offset"]) if step["offset"] else step.df
    return df if step["count"] is None else df.limit(step["count"])


def _after(step: Step, n: int) -> DataFrame:
    """All rows but the first n, in their order. Spark's own OFFSET without a limit puts all rows into one task;
    here rows get a number that grows along the order, and only the first n numbers meet."""
    (at,) = ordered.free(step.df, "at_")
    rows = _held(step)(step.df.withColumn(at, F.monotonically_increasing_id()))
    last = rows.select(at).orderBy(at).limit(n).agg(F.max(at)).first()[0]
    kept = rows if last is None else rows.where(F.col(at) > last)
    return kept.orderBy(at).drop(at)


@component("xf.sample", {"size": need("number"), "unit": one_of("rows", "percent", default="rows"), "seed": opt("integer", 0)})
def sample(step: Step) -> DataFrame:
    """Exactly that many rows, or that share of them rounded, drawn at random (see selection.py)."""
    size = float(step["size"])
    if size < 0 or (step["unit"] == "percent" and size > 100):
        raise step.bad("size", "is out of range")
    return selection.sampled(step.df, size, step["unit"] == "percent", step["seed"], _held(step))


def _held(step: Step):
    """What writes a DataFrame for the rest of the run; outside a run it stays as it is."""
    return (step.context or {}).get("held", lambda df: df)


_ORDERED = {"asof", "asof_left", "positional", "range"}


def _join_check(node: str, p: dict) -> None:
    from ..registry import InvalidProperty

    kind = p["type"]
    needed = {"asof": ("left_on", "right_on"), "asof_left": ("left_on", "right_on"), "positional": ("left_on", "right_on"), "range": ("condition",)}.get(kind, ())
    for prop in needed:
        if not p[prop]:
            raise InvalidProperty(node, prop, f"is required for a join of type {kind}")
    if kind == "range" and not _BETWEEN.fullmatch(p["condition"]):
        raise InvalidProperty(node, "condition", "of a range join is: point >= low AND point < high (or >, <=), with plain column names")
    if p["aggregations"]:
        if kind != "range":
            raise InvalidProperty(node, "aggregations", "go with a join of type range; xf.aggregate follows others")
        if bad := [x for x in sql_list(p["aggregations"]) if not ordered.total_of(x)]:
            raise InvalidProperty(node, "aggregations", f"of a range join are count, sum, min and max of a column or expression, with a name; xf.aggregate takes others: {bad[0]}")
    elif p["group_by"]:
        raise InvalidProperty(node, "group_by", "goes with aggregations")
    if kind in _ORDERED:
        return
    if kind == "cross":
        if p["keys"] or p["condition"]:
            raise InvalidProperty(node, "type", "keys or a condition mean nothing to a cross join")
    elif bool(p["keys"]) == bool(p["condition"]):
        raise InvalidProperty(node, "keys", "give either keys or a condition")


_BETWEEN = re.compile(r"\s*(\w+)\s*(>=?)\s*(\w+)\s+AND\s+(\w+)\s*(<=?)\s*(\w+)\s*", re.I)


def _apart(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """right with its columns renamed that left has too, but for the keys."""
    taken = {*left.columns, *right.columns}
    for c in [c for c in right.columns if c in left.columns and c not in keys]:
        n = next(i for i in range(1, len(taken) + 2) if f"{c}_{i}" not in taken)
        right = right.withColumnRenamed(c, f"{c}_{n}")
        taken.add(f"{c}_{n}")
    return right


def _ordered_join(step: Step, left: DataFrame, right: DataFrame) -> DataFrame:
    held, keys = _held(step), step["keys"] or []
    if step["type"] == "positional":
        orders = [[_order_key(x) for x in order_list(step[p])] for p in ("left_on", "right_on")]
        plain = right.columns
        right = _apart(left, right, ())
        new = dict(zip(plain, right.columns, strict=True))
        return ordered.positional_join(left, right, orders[0], [(new.get(e.strip("`\""), e), d, f) for e, d, f in orders[1]], held)
    if step["type"] == "range":
        point, lower, low, again, upper, high = _BETWEEN.fullmatch(step["condition"]).groups()
        if point != again:
            raise step.bad("condition", "both sides are of the same column")
        must_have(step, "condition", left, [point])
        must_have(step, "condition", right, [low, high])
        if {low, high} & set(left.columns):
            raise step.bad("condition", "both inputs have a column of that name")
        opened = {"low_open": lower == ">", "high_open": upper == "<"}
        if step["aggregations"]:
            must_have(step, "group_by", right, step["group_by"])
            return ordered.range_totals(left, right, point, low, high, list(map(ordered.total_of, sql_list(step["aggregations"]))), list(step["group_by"]), held, **opened)
        return ordered.range_join(left, _apart(left, right, ()), point, low, high, **opened)
    must_have(step, "left_on", left, [*keys, step["left_on"]])
    must_have(step, "right_on", right, [*keys, step["right_on"]])
    at = right.columns.index(step["right_on"])
    right = _apart(left, right, keys)
    return ordered.asof_join(left, right, keys, step["left_on"], right.columns[at], held, strict=bool(step["strict"]), keep=step["type"] == "asof_left")


@component(
    "xf.join",
    {
        "type": one_of("inner", "left", "right", "full", "outer", "cross", "asof", "asof_left", "positional", "range", default="inner"), "keys": opt("strings"), "condition": opt("sql"),
        "left_on": opt(doc="asof: the time of the left side; positional: its order"), "right_on": opt(), "strict": opt("bool", False),
        "aggregations": opt("sql", doc="range: totals of the left rows in the intervals, in place of the pairs"), "group_by": opt("strings", (), doc="range: columns of the right side that the totals are grouped by"),
    },
    inputs=("left", "right"), check=_join_check,
)
def join(step: Step) -> DataFrame:
    """Rows of both sides by equal keys (each key appears once) or by a condition over their node ids.

    The strategy is Spark's: broadcast below its threshold, sort-merge with skewed keys split above.

    asof takes for each left row the last right row of the same keys not later than it (strict: earlier),
    positional puts rows side by side in the orders left_on and right_on, range takes a left column between
    two right ones. With aggregations of left columns, grouped by right ones, range gives what xf.aggregate
    would after it, and no pairs are made. See ordered.py for how these are spread over tasks.
    """
    left, right = step.by_port["left"], step.by_port["right"]
    how = "full" if step["type"] == "outer" else step["type"]
    if how in _ORDERED:
        return _ordered_join(step, left, right)
    if how == "cross":
        return unique_names(left.crossJoin(right))
    if step["keys"]:
        must_have(step, "keys", left, step["keys"])
        must_have(step, "keys", right, step["keys"])
        return left.join(_apart(left, right, step["keys"]), step["keys"], how)
    names = step.context["names"]  # each side under its node's id and alias
    condition = translate(step["condition"])
    a, b = (next((n for n in names[p] if re.search(rf"(?<!\w){re.escape(n)}`?\s*\.", condition)), names[p][0]) for p in ("left", "right"))
    return unique_names(left.alias(a).join(right.alias(b), F.expr(condition), how))


@component("xf.aggregate", {"aggregations": need("sql"), "group_by": opt("strings", ())})
def aggregate(step: Step) -> DataFrame:
    """A select list of aggregates for each group; without group_by one row, of an empty input too.

    An item that is an exact quantile, a median or a mode is found by all tasks together (see
    selection.py); within a longer expression it is Spark's, which has a group's values in one task.
    """
    must_have(step, "group_by", step.df, step["group_by"])
    return selection.aggregated(step.df, list(step["group_by"]), sql_list(step["aggregations"]), _held(step))


@component("xf.window", {"expression": need("sql"), "output_column": need(), "partition_by": opt("strings", ()), "order_by": opt("sql")})
def window(step: Step) -> DataFrame:
    """One more column: the expression over each partition, in order.

    Without partition_by numbers, ranks, neighbours and aggregates up to the current row are found by all
    tasks (see ordered.py); other frames and functions have one task then, as in any window of Spark's.
    """
    must_have(step, "partition_by", step.df, step["partition_by"])
    if not step["partition_by"] and (made := _over_all(step)) is not None:
        return made
    parts = []
    if step["partition_by"]:
        parts.append("PARTITION BY " + ", ".join(name(c) for c in step["partition_by"]))
    expression = translate(step["expression"])
    if step["order_by"]:
        parts.append(translate("ORDER BY " + step["order_by"]))
    elif re.match(r"\s*(row_number|rank|dense_rank|percent_rank|cume_dist|ntile|lag|lead|nth_value)\b", expression, re.I):
        parts.append("ORDER BY monotonically_increasing_id()")
    m = re.fullmatch(r"(.*\))\s*FILTER\s*\(\s*WHERE\s+(.*)\)", expression, re.S | re.I)
    if m:  # FILTER is not to be had in a window: the argument is null where it would not count
        call = re.fullmatch(r"(\w+)\((.*)\)", m[1].strip(), re.S)
        argument = "1" if call[2].strip() == "*" else call[2]
        expression = f"{call[1]}(CASE WHEN {m[2]} THEN {argument} END)"
    made = F.expr(f"{expression} OVER ({' '.join(parts)})").alias(step["output_column"])
    return unique_names(step.df.select("*", made))


def _over_all(step: Step) -> DataFrame | None:
    expression, keys, frame = translate(step["expression"]), None, "range"
    if step["order_by"]:
        text, frame = ordered.split_frame(step["order_by"])
        keys = [(translate(e), d, f) for e, d, f in map(_order_key, order_list(text))]
    elif not re.match(r"\s*(sum|count|avg|min|max)\b", expression, re.I):
        return None
    df = step.df
    if "over_" in df.columns or any(re.fullmatch(r"(key\d+|part|tie|rows|own|sum|count|min|max|dense|keys)_(of_|before_)?", c) for c in df.columns):
        return None
    made = ordered.over_all(df, expression, keys, frame, _held(step))
    return None if made is None else unique_names(made.withColumnRenamed("over_", step["output_column"]) if step["output_column"] not in df.columns else made.toDF(*df.columns, step["output_column"]))


@component("xf.pivot", {"on": need("strings"), "values": need("strings"), "using": need("sql"), "group_by": opt("strings")})
def pivot(step: Step) -> DataFrame:
    """One column for each listed value of `on` (each combination, if there are several), holding the
    aggregates of `using`; the groups are group_by, or all columns that neither names.

    Conditional aggregates in one pass: a count without rows is 0, a sum is null.
    """
    df, on = step.df, step["on"]
    must_have(step, "on", df, on)
    using = split_list(step["using"])
    read = " ".join(using)
    rest = step["group_by"] if step["group_by"] is not None else [c for c in df.columns if c not in on and not re.search(rf"(?<!\w){re.escape(c)}(?!\w)", read)]
    must_have(step, "group_by", df, rest)
    combos = reduce(lambda acc, _: [[*a, v] for a in acc for v in step["values"]], on, [[]])
    made = []
    for values in combos:
        test = reduce(lambda a, b: a & b, [col(c).cast("string") == F.lit(v) for c, v in zip(on, values, strict=True)])
        for u in using:
            text, _, alias = _aliased(u)
            title = "_".join(values) + (f"_{alias or text}" if len(using) > 1 else "")
            made.append((test, translate(text), title))
    flagged = df
    for i, (test, _, _) in enumerate(made):
        flagged = flagged.withColumn(f"cell_{i}", test)
    aggregates = [F.expr(f"{text} FILTER (WHERE cell_{i})").alias(title) for i, (_, text, title) in enumerate(made)]
    return flagged.groupBy(*[col(c) for c in rest]).agg(*aggregates)


def _aliased(text: str) -> tuple[str, str, str | None]:
    m = re.fullmatch(r"(.*\))\s+(?:AS\s+)?\"?(\w+)\"?", text, re.S | re.I)
    return (m[1], "AS", m[2]) if m else (text, "", None)


@component("xf.unpivot", {"columns": need("strings"), "name_column": opt("text", "name"), "value_column": opt("text", "value")})
def unpivot(step: Step) -> DataFrame:
    """A row for each of the named columns that is not null: the other columns, its name, its value."""
    must_have(step, "columns", step.df, step["columns"])
    rest = [col(c) for c in step.df.columns if c not in step["columns"]]
    return step.df.unpivot(rest, [col(c) for c in step["columns"]], step["name_column"], step["value_column"]).where(col(step["value_column"]).isNotNull())


def _widened(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns that are text on one side only are text on both."""
    other = {f.name: f.dataType for f in right.schema.fields}

    def match(df: DataFrame, others: list[T.DataType | None]) -> DataFrame:
        return df.select(*[col(f.name).cast("string").alias(f.name) if isinstance(o, T.StringType) and not isinstance(f.dataType, T.StringType) else col(f.name) for f, o in zip(df.schema.fields, others, strict=True)])

    if [f.name for f in left.schema.fields] == [f.name for f in right.schema.fields]:
        kinds_l, kinds_r = ([f.dataType for f in x.schema.fields] for x in (left, right))
        return match(left, kinds_r), match(right, kinds_l)
    mine = {f.name: f.dataType for f in left.schema.fields}
    return match(left, [other.get(c) for c in left.columns]), match(right, [mine.get(c) for c in right.columns])


@component("xf.union", {"all": opt("bool", True), "by_name": opt("bool", False)}, many=True)
def union(step: Step) -> DataFrame:
    """Rows of all inputs, by place or by name (missing columns null); all=false keeps distinct rows."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        if step["by_name"]:
            return (lambda x, y: x.unionByName(y, allowMissingColumns=True))(*_widened(a, b))
        if len(a.columns) != len(b.columns):
            raise step.bad("by_name", f"the inputs have {len(a.columns)} and {len(b.columns)} columns")
        return (lambda x, y: x.union(y))(*_widened(a, b.toDF(*a.columns)))

    out = reduce(two, step.inputs)
    return out if step["all"] else out.distinct()


@component("xf.intersect", {"all": opt("bool", False)}, many=True)
def intersect(step: Step) -> DataFrame:
    """Rows that all inputs have; all=true counts repeats."""
    return reduce(lambda a, b: a.intersectAll(b) if step["all"] else a.intersect(b), step.inputs)


@component("xf.except", {"all": opt("bool", False)}, many=True)
def except_rows(step: Step) -> DataFrame:
    """Rows of the first input that no other has; all=true takes off one repeat for each."""
    return reduce(lambda a, b: a.exceptAll(b) if step["all"] else a.subtract(b), step.inputs)
