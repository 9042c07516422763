"""Queries over the standard tables, one for each operator, with the same query in DuckDB SQL.

Each is a pipeline document; what it returns is the DataFrame of one of its nodes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_remote
from .functions.text import PATTERNS
from .model import pipeline
from .operators.similarity import nearest
from .plans.compile import compile_pipeline
from .plans.lineage import lineage
from .plans.run import frames, preview, run
from .storage import list_files, new_path, replace_file, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Step = tuple[Any, ...]


def table(name: str) -> Step:
    return (name, "src.file.parquet", {"path": f"{{sf}}/{name}.parquet"})


def add(name: str, steps: list[Step], sql: str | None = None, result: str | None = None) -> None:
    """Registers a query: the output `result` (or the last step's) of a pipeline of steps."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        placed = [(s[0], s[1], {k: v.replace("{sf}", sf_dir) if k == "path" else v for k, v in s[2].items()}, *s[3:]) for s in steps]
        return frames(spark, pipeline(*placed, name=name))[result or steps[-1][0]]

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


ORDERS, CUSTOMER, LINEITEM, EVENTS, NATION, REGION, SUPPLIER, PART = map(table, ("orders", "customer", "lineitem", "events", "nation", "region", "supplier", "part"))

add(
    "revenue_by_segment",
    [
        ORDERS,
        CUSTOMER,
        ("recent", "xf.filter", {"predicate": "o_orderdate >= '1998-01-01'"}, "orders"),
        ("named", "xf.rename", {"columns": {"o_custkey": "custkey"}}),
        ("who", "xf.derive", {"expressions": "c_custkey AS custkey"}, "customer"),
        ("joined", "xf.join", {"type": "inner", "keys": ["custkey"]}, {"left": "named", "right": "who"}),
        ("by_segment", "xf.aggregate", {"aggregations": "count(*) AS orders, count(DISTINCT custkey) AS customers, round(sum(o_totalprice), 2) AS revenue", "group_by": ["c_mktsegment"]}),
    ],
    """SELECT c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '1998-01-01' GROUP BY c_mktsegment""",
)
add("source_parquet", [PART], "SELECT * FROM part")
add(
    "filter",
    [LINEITEM, ("f", "xf.filter", {"predicate": "l_shipdate >= '1997-06-01' AND l_shipdate < '1998-06-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"})],
    "SELECT * FROM lineitem WHERE l_shipdate >= '1997-06-01' AND l_shipdate < '1998-06-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
)
add("filter_unknown_drops", [LINEITEM, ("f", "xf.filter", {"predicate": "nullif(l_quantity, 1) <> 2"})], "SELECT * FROM lineitem WHERE nullif(l_quantity, 1) <> 2")
add("select", [CUSTOMER, ("s", "xf.select", {"columns": ["c_mktsegment", "c_custkey"]})], "SELECT c_mktsegment, c_custkey FROM customer")
add(
    "derive",
    [ORDERS, ("d", "xf.derive", {"expressions": "strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority[1] AS p, concat(o_orderstatus, NULL, '/', o_orderpriority) AS tag, regexp_extract(o_orderpriority, '[A-Z]+') AS word".replace("o_orderpriority[1]", "left(o_orderpriority, 1)")})],
    "SELECT *, strftime(o_orderdate, '%Y-%m') AS month, left(o_orderpriority, 1) AS p, concat(o_orderstatus, NULL, '/', o_orderpriority) AS tag, regexp_extract(o_orderpriority, '[A-Z]+') AS word FROM orders",
)
add(
    "derive_dialect",
    [
        EVENTS,
        (
            "d",
            "xf.derive",
            {
                "expressions": "props->>'$.k' AS k, date_part('dow', ts) AS dow, date_diff('day', TIMESTAMP '2024-01-01', ts) AS days, list_sum(list_transform([1, 2, user_id], lambda x: x + 1)) AS s, "
                "regexp_replace(event_type, '[aeiou]', '*', 'g') AS masked, strpos(event_type, 'i') AS at, user_id // 7 AS part, user_id % 7 AS rest, sha256(event_type) AS h, event_type ~ '^p' AS is_p"
            },
        ),
        ("s", "xf.select", {"columns": ["event_id", "k", "dow", "days", "s", "masked", "at", "part", "rest", "h", "is_p"]}),
    ],
    """SELECT event_id, props->>'$.k' AS k, date_part('dow', ts)::INTEGER AS dow, date_diff('day', TIMESTAMP '2024-01-01', ts) AS days,
    list_sum(list_transform([1, 2, user_id], lambda x: x + 1))::DOUBLE AS s, regexp_replace(event_type, '[aeiou]', '*', 'g') AS masked,
    strpos(event_type, 'i')::INTEGER AS "at", user_id // 7 AS part, user_id % 7 AS rest, sha256(event_type) AS h, regexp_matches(event_type, '^p') AS is_p FROM events""",
)
add("rename", [NATION, ("r", "xf.rename", {"columns": {"n_name": "nation", "n_nationkey": "id"}})], "SELECT n_nationkey AS id, n_name AS nation, n_regionkey FROM nation")
add("cast", [LINEITEM, ("c", "xf.cast", {"columns": {"l_quantity": "BIGINT", "l_extendedprice": "INTEGER", "l_linenumber": "VARCHAR", "l_shipdate": "DATE"}})], "SELECT * REPLACE (l_quantity::BIGINT AS l_quantity, l_extendedprice::INTEGER AS l_extendedprice, l_linenumber::VARCHAR AS l_linenumber, l_shipdate::DATE AS l_shipdate) FROM lineitem")
add("distinct", [CUSTOMER, ("s", "xf.select", {"columns": ["c_nationkey", "c_mktsegment"]}), ("d", "xf.distinct", {})], "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
add("dedup", [ORDERS, ("d", "xf.dedup", {"keys": ["o_custkey"], "order_by": "o_orderdate DESC, o_orderkey"})], "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1")
add("dedup_text_descending", [PART, ("d", "xf.dedup", {"keys": ["p_brand"], "order_by": "p_name DESC, p_partkey"})], "SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name DESC, p_partkey) = 1")
add("sort_limit", [ORDERS, ("s", "xf.sort", {"by": "o_totalprice DESC, o_orderkey"}), ("l", "xf.limit", {"count": 100, "offset": 10})], "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10")
add(
    "sort_nulls_last",
    [EVENTS, ("d", "xf.derive", {"expressions": "nullif(user_id % 5, 0) AS g"}), ("s", "xf.sort", {"by": "g, event_id"}), ("l", "xf.limit", {"offset": 100})],
    "SELECT * FROM (SELECT *, nullif(user_id % 5, 0) AS g FROM events) ORDER BY g NULLS LAST, event_id OFFSET 100",
)
add(
    "sort_nulls_first_descending",
    [EVENTS, ("d", "xf.derive", {"expressions": "nullif(user_id % 5, 0) AS g"}), ("s", "xf.sort", {"by": "g DESC NULLS FIRST, event_id DESC"}), ("l", "xf.limit", {"count": 500})],
    "SELECT * FROM (SELECT *, nullif(user_id % 5, 0) AS g FROM events) ORDER BY g DESC NULLS FIRST, event_id DESC LIMIT 500",
)
for how in ("inner", "left", "right", "full"):
    add(
        f"join_{how}",
        [
            CUSTOMER,
            ORDERS,
            ("c", "xf.derive", {"expressions": "c_custkey AS k"}, "customer"),
            ("o", "xf.filter", {"predicate": "o_totalprice > 200000"}, "orders"),
            ("r", "xf.rename", {"columns": {"o_custkey": "k"}}),
            ("half", "xf.filter", {"predicate": "k % 3 <> 0"}, "c"),
            ("j", "xf.join", {"type": how, "keys": ["k"]}, {"left": "half", "right": "r"}),
            ("s", "xf.select", {"columns": ["k", "c_name", "o_orderkey", "o_totalprice"]}),
        ],
        f"""SELECT k, c_name, o_orderkey, o_totalprice FROM (SELECT *, c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0)
        {how} JOIN (SELECT * RENAME (o_custkey AS k) FROM orders WHERE o_totalprice > 200000) USING (k)""",
    )
add("join_cross", [NATION, REGION, ("j", "xf.join", {"type": "cross"}, {"left": "nation", "right": "region"})], "SELECT * FROM nation CROSS JOIN region")
add(
    "join_condition",
    [
        SUPPLIER,
        NATION,
        ("j", "xf.join", {"type": "left", "condition": "supplier.s_nationkey = nation.n_nationkey AND supplier.s_acctbal > nation.n_regionkey * 1000"}, {"left": "supplier", "right": "nation"}),
    ],
    "SELECT * FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > n_regionkey * 1000",
)
add(
    "aggregate",
    [
        LINEITEM,
        (
            "a",
            "xf.aggregate",
            {
                "aggregations": "sum(l_quantity)::BIGINT AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, "
                "count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed, min(l_shipdate) AS first_ship, arg_max(l_orderkey, l_orderkey) AS last_order",
                "group_by": ["l_returnflag", "l_linestatus"],
            },
        ),
    ],
    """SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n,
    count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed, min(l_shipdate) AS first_ship, max(l_orderkey) AS last_order FROM lineitem GROUP BY ALL""",
)
add("aggregate_all_rows", [ORDERS, ("f", "xf.filter", {"predicate": "o_totalprice < 0"}), ("a", "xf.aggregate", {"aggregations": "count(*) AS n, max(o_orderkey) AS top"})], "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_totalprice < 0")
add(
    "window_rank",
    [ORDERS, ("w", "xf.window", {"expression": "rank()", "output_column": "place", "partition_by": ["o_custkey"], "order_by": "o_totalprice DESC, o_orderkey"}), ("f", "xf.filter", {"predicate": "place <= 3"})],
    "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
)
add(
    "window_running_sum",
    [EVENTS, ("w", "xf.window", {"expression": "count(*) FILTER (WHERE event_type = 'purchase')", "output_column": "bought", "partition_by": ["user_id"], "order_by": "ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"})],
    "SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bought FROM events",
)
add(
    "window_lag_ignore_nulls",
    [EVENTS, ("d", "xf.derive", {"expressions": "nullif(event_type, 'view') AS kind"}), ("w", "xf.window", {"expression": "lag(kind IGNORE NULLS)", "output_column": "before", "partition_by": ["user_id"], "order_by": "ts, event_id"})],
    "SELECT *, lag(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, nullif(event_type, 'view') AS kind FROM events)",
)
add(
    "aggregate_statistics",
    [LINEITEM, ("a", "xf.aggregate", {"aggregations": "quantile_cont(l_quantity, 0.25) AS low, median(l_quantity) AS middle, quantile_disc(l_quantity, 0.9) AS high, mode(l_linestatus) AS usual, list_sort(list(DISTINCT l_returnflag)) AS flags, string_agg(DISTINCT l_returnflag, '') AS joined, arg_min(l_shipdate, l_orderkey * 10 + l_linenumber) AS first_ship, bool_or(l_tax > 0.07) AS taxed, round(stddev_samp(l_quantity), 6) AS spread", "group_by": ["l_linenumber"]}), ("s", "xf.sql", {"query": "SELECT l_linenumber, low, middle, high, cardinality(flags) AS flags, length(joined) AS joined, taxed, spread FROM a"})],
    "SELECT l_linenumber, quantile_cont(l_quantity, 0.25) AS low, median(l_quantity) AS middle, quantile_disc(l_quantity, 0.9) AS high, count(DISTINCT l_returnflag)::INTEGER AS flags, length(string_agg(DISTINCT l_returnflag, ''))::INTEGER AS joined, bool_or(l_tax > 0.07) AS taxed, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY l_linenumber",
)
for name, by in (("quantiles_all", []), ("quantiles_by_group", ["g"])):
    # A group of a third of the rows, one of nulls; and all rows as one group.
    _ITEMS = "round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.999), 4) AS most, quantile_disc(l_partkey, 0.25) AS part, quantile_disc(l_shipdate, 0.75) AS late, round(median(l_tax * l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS taxed, count(*) AS n"
    _GROUP = "CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE nullif(l_suppkey % 7, 2) END AS g"
    add(
        name,
        [
            LINEITEM,
            ("d", "xf.derive", {"expressions": _GROUP}),
            ("a", "xf.aggregate", {"aggregations": _ITEMS.replace("round(", "").replace(", 4)", "").replace(", 6)", ""), "group_by": by}),
            ("r", "xf.sql", {"query": f"SELECT {''.join(x + ', ' for x in by)}round(middle, 4) AS middle, round(most, 4) AS most, part, late, round(taxed, 6) AS taxed, n FROM a"}),
        ],
        f"SELECT {''.join(x + ', ' for x in by)}{_ITEMS} FROM (SELECT *, {_GROUP} FROM lineitem) {'GROUP BY g' if by else ''}",
    )
for name, sets in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")):
    _SETS = f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS whole, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY {sets}"
    add(name, [LINEITEM, ("q", "xf.sql", {"query": _SETS})], _SETS.replace("grouping(l_returnflag)", "grouping(l_returnflag)::TINYINT"))
for name, call, order in (
    ("window_ntile", "ntile(4)", "o_totalprice, o_orderkey"),
    ("window_percent_rank", "percent_rank()", "o_totalprice, o_orderkey"),
    ("window_first_value", "first_value(o_orderkey)", "o_totalprice DESC, o_orderkey"),
    ("window_nth_value", "nth_value(o_orderkey, 2)", "o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"),
    ("window_moving_max", "max(o_totalprice)", "o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"),
    ("window_lead", "lead(o_orderkey, 1, -1)", "o_orderdate, o_orderkey"),
):
    add(
        name,
        [ORDERS, ("w", "xf.window", {"expression": call, "output_column": "seen", "partition_by": ["o_custkey"], "order_by": order}), ("s", "xf.select", {"columns": ["o_orderkey", "seen"]})],
        f"SELECT o_orderkey, {call} OVER (PARTITION BY o_custkey ORDER BY {order}) AS seen FROM orders".replace("ntile(4) OVER", "(ntile(4) OVER").replace("ORDER BY o_totalprice, o_orderkey) AS seen", "ORDER BY o_totalprice, o_orderkey))::INTEGER AS seen" if name == "window_ntile" else "ORDER BY o_totalprice, o_orderkey) AS seen"),
    )
for name, call, order in (
    ("window_all_row_number", "row_number()", "o_totalprice DESC, o_orderkey"),
    ("window_all_rank", "rank()", "o_orderpriority, o_orderstatus"),
    ("window_all_dense_rank", "dense_rank()", "o_orderdate DESC"),
    ("window_all_percent_rank", "percent_rank()", "o_orderdate"),
    ("window_all_cume_dist", "cume_dist()", "nullif(o_orderpriority, '2-HIGH')"),
    ("window_all_ntile", "ntile(7)", "o_totalprice, o_orderkey"),
    ("window_all_running_sum", "sum(o_custkey)", "o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
    ("window_all_running_count", "count(nullif(o_orderstatus, 'F'))", "o_orderstatus"),
    ("window_all_running_max", "max(o_totalprice)", "o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
    ("window_all_lag", "lag(o_orderkey, 3, -1)", "o_orderdate, o_orderkey"),
    ("window_all_lead", "lead(o_totalprice)", "o_orderdate, o_orderkey"),
):
    _NULLS = order.replace(" ROWS BETWEEN", " NULLS LAST ROWS BETWEEN") if " ROWS " in order else f"{order} NULLS LAST"
    add(
        name,
        [ORDERS, ("w", "xf.window", {"expression": call, "output_column": "seen", "order_by": order}), ("s", "xf.select", {"columns": ["o_orderkey", "seen"]})],
        f"SELECT o_orderkey, ({call} OVER (ORDER BY {_NULLS})){'::BIGINT' if call.startswith('sum') else '::INTEGER' if 'rank()' in call and 'percent' not in call or 'row_number' in call or 'ntile' in call else ''} AS seen FROM orders",
    )
add("window_all_total", [ORDERS, ("w", "xf.window", {"expression": "count(*)", "output_column": "seen"}), ("s", "xf.select", {"columns": ["o_orderkey", "seen"]})], "SELECT o_orderkey, count(*) OVER () AS seen FROM orders")
# The event last seen before each order of the year in which the events lie, a third of which is one user's.
_ASOF = [
    EVENTS,
    ORDERS,
    ("e", "xf.sql", {"query": "SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 50 END AS k, ts, event_id FROM events"}, "events"),
    ("o", "xf.sql", {"query": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 60 END AS k, date_add('microsecond', o_orderkey * 1000003 % 2592000000000, TIMESTAMP '2024-01-01') AS at, o_orderkey FROM orders".replace("date_add('microsecond', o_orderkey * 1000003 % 2592000000000, TIMESTAMP '2024-01-01')", "timestamp_micros(1704067200000000 + o_orderkey * 1000003 % 2592000000000)::TIMESTAMP_NTZ")}, "orders"),
]
_ASOF_SQL = """SELECT o.k, o.at, o_orderkey, e.ts, e.event_id FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 60 END AS k, make_timestamp(1704067200000000 + o_orderkey * 1000003 % 2592000000000) AS "at", o_orderkey FROM orders) o
    {} JOIN (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 50 END AS k, ts, event_id FROM events) e ON o.k = e.k AND o.at {} e.ts"""
for name, kind, word, strict in (("join_asof", "asof", "ASOF", False), ("join_asof_left", "asof_left", "ASOF LEFT", False), ("join_asof_strict", "asof", "ASOF", True)):
    add(name, [*_ASOF, ("j", "xf.join", {"type": kind, "keys": ["k"], "left_on": "at", "right_on": "ts", "strict": strict}, {"left": "o", "right": "e"})], _ASOF_SQL.format(word, ">" if strict else ">="))
add(
    "join_positional",
    [CUSTOMER, SUPPLIER, ("c", "xf.select", {"columns": ["c_custkey", "c_acctbal"]}, "customer"), ("s", "xf.select", {"columns": ["s_suppkey", "s_acctbal"]}, "supplier"), ("j", "xf.join", {"type": "positional", "left_on": "c_acctbal DESC, c_custkey", "right_on": "s_acctbal DESC, s_suppkey"}, {"left": "c", "right": "s"})],
    "SELECT c_custkey, c_acctbal, s_suppkey, s_acctbal FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) FULL JOIN (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) USING (r)",
)
# The events within a time of each order's, from a minute to two days long.
_SPANS = "SELECT o_orderkey, ts_from, ts_from + CASE o_orderkey % 5 WHEN 0 THEN INTERVAL '2 days' WHEN 1 THEN INTERVAL '1 minute' WHEN 2 THEN INTERVAL '3 hours' ELSE INTERVAL '10 minutes' END AS ts_to FROM (SELECT o_orderkey, {} AS ts_from FROM orders WHERE o_orderkey % 20 = 0)"
add(
    "join_range",
    [
        EVENTS,
        ORDERS,
        ("spans", "xf.sql", {"query": _SPANS.format("timestamp_micros(1704067200000000 + o_orderkey * 1000003 % 2592000000000)::TIMESTAMP_NTZ").replace(" WHERE o_orderkey % 20 = 0", "")}, "orders"),
        ("e", "xf.select", {"columns": ["event_id", "ts"]}, "events"),
        ("j", "xf.join", {"type": "range", "condition": "ts >= ts_from AND ts < ts_to", "aggregations": "count(*) AS n, min(event_id) AS low, max(event_id) AS high, sum(event_id)::BIGINT AS total", "group_by": ["o_orderkey"]}, {"left": "e", "right": "spans"}),
    ],
    f"SELECT o_orderkey, count(*) AS n, min(event_id) AS low, max(event_id) AS high, sum(event_id)::BIGINT AS total FROM events JOIN ({_SPANS.format('make_timestamp(1704067200000000 + o_orderkey * 1000003 % 2592000000000)').replace(' WHERE o_orderkey % 20 = 0', '')}) ON ts >= ts_from AND ts < ts_to GROUP BY o_orderkey",
)
_KINDS = ["click", "error", "purchase", "signup", "view"]
add(
    "pivot",
    [EVENTS, ("p", "xf.pivot", {"on": ["event_type"], "values": _KINDS, "using": "count(*)", "group_by": ["user_id"]})],
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY user_id",
)
add(
    "pivot_two_aggregates",
    [LINEITEM, ("p", "xf.pivot", {"on": ["l_returnflag"], "values": ["A", "N", "R"], "using": "count(*) AS n, max(l_quantity) AS top", "group_by": ["l_linenumber"]})],
    "SELECT l_linenumber, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{k}') AS {k}_n, max(l_quantity) FILTER (WHERE l_returnflag = '{k}') AS {k}_top" for k in "ANR") + " FROM lineitem GROUP BY l_linenumber",
)
add(
    "unpivot",
    [LINEITEM, ("s", "xf.select", {"columns": ["l_orderkey", "l_quantity", "l_discount", "l_tax"]}), ("d", "xf.cast", {"columns": {"l_orderkey": "BIGINT"}}), ("n", "xf.sql", {"query": "SELECT l_orderkey, nullif(l_quantity, 1) AS l_quantity, l_discount, l_tax FROM d"}), ("u", "xf.unpivot", {"columns": ["l_quantity", "l_discount", "l_tax"], "name_column": "what", "value_column": "amount"})],
    "SELECT l_orderkey, what, amount FROM (SELECT l_orderkey, nullif(l_quantity, 1) AS l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (amount FOR what IN (l_quantity, l_discount, l_tax))",
)
_CN = ("cn", "xf.sql", {"query": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000"}, "customer")
_SN = ("sn", "xf.sql", {"query": "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"}, "supplier")
_CS, _SS = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"
for name, word in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    for every in (True, False):
        add(f"{name}_all" if every else name, [CUSTOMER, SUPPLIER, _CN, _SN, ("r", f"xf.{name}", {"all": every}, ["cn", "sn"])], f"{_CS} {word} {'ALL' if every else ''} {_SS}")
add(
    "union_by_name",
    [NATION, REGION, ("r", "xf.rename", {"columns": {"r_name": "n_name"}}, "region"), ("u", "xf.union", {"by_name": True}, ["nation", "r"])],
    "SELECT * FROM nation UNION ALL BY NAME SELECT r_regionkey, r_name AS n_name FROM region",
)
add("union_widens_to_text", [NATION, REGION, ("a", "xf.select", {"columns": ["n_nationkey"]}, "nation"), ("b", "xf.select", {"columns": ["r_name"]}, "region"), ("u", "xf.union", {}, ["a", "b"])], "SELECT n_nationkey::VARCHAR AS n_nationkey FROM nation UNION ALL SELECT r_name FROM region")
add(
    "sql",
    [
        NATION,
        REGION,
        (
            "q",
            "xf.sql",
            {"query": "SELECT r.r_name AS \"region name\", n_name, count(*) AS n FROM nation JOIN region r ON n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n_name)"},
            "nation",
        ),
    ],
    'SELECT r.r_name AS "region name", n_name, count(*) AS n FROM nation JOIN region r ON n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n_name)',
)
add(
    "sql_semi_anti",
    [CUSTOMER, ORDERS, ("q", "xf.sql", {"query": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 UNION ALL SELECT -c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"}, ["customer", "orders"])],
    "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 UNION ALL SELECT -c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
)
_CHECKS: dict[str, tuple[Step, dict[str, Any], str, str]] = {
    "not_null": (LINEITEM, {"columns": ["q", "l_tax"]}, "q IS NOT NULL AND l_tax IS NOT NULL", "nullif(l_quantity, 1) AS q"),
    "range": (LINEITEM, {"column": "q", "min": "10", "max": "20.5"}, "q >= 10 AND q <= 20.5", "nullif(l_quantity, 12) AS q"),
    "regex": (ORDERS, {"column": "p", "pattern": "^[12]-"}, "regexp_matches(p, '^[12]-')", "nullif(o_orderpriority, '2-HIGH') AS p"),
    "accepted_values": (EVENTS, {"column": "kind", "values": ["click", "view"]}, "kind IN ('click', 'view')", "nullif(event_type, 'view') AS kind"),
    "expression": (ORDERS, {"predicate": "s = 'F' OR o_totalprice > 100000"}, "s = 'F' OR o_totalprice > 100000", "nullif(o_orderstatus, 'P') AS s"),
}
for name, (source, props, test, extra) in _CHECKS.items():
    steps = [source, ("d", "xf.derive", {"expressions": extra}), ("check", f"qa.{name}", props)]
    base = f"SELECT * FROM (SELECT *, {extra} FROM {source[0]}) WHERE"
    add(f"qa_{name}", steps, f"{base} coalesce({test}, false)")
    add(f"qa_{name}_rejected", steps, f"{base} NOT coalesce({test}, false)", "check.rejected")
_UNIQUE = [ORDERS, ("d", "xf.derive", {"expressions": "nullif(o_custkey % 1000, 1) AS k"}), ("check", "qa.unique", {"columns": ["k", "o_orderstatus"]})]
_COPIES = "SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY k, o_orderstatus) AS n FROM (SELECT *, nullif(o_custkey % 1000, 1) AS k FROM orders)) WHERE n"
add("qa_unique", _UNIQUE, f"{_COPIES} = 1")
add("qa_unique_rejected", _UNIQUE, f"{_COPIES} > 1", "check.rejected")
_REFERS = [ORDERS, CUSTOMER, ("known", "xf.filter", {"predicate": "c_mktsegment <> 'BUILDING'"}, "customer"), ("d", "xf.derive", {"expressions": "nullif(o_custkey, 7) AS ck"}, "orders"), ("check", "qa.referential", {"column": "ck", "references": "c_custkey"}, {"left": "d", "right": "known"})]
_KNOWN = "SELECT * FROM (SELECT *, nullif(o_custkey, 7) AS ck FROM orders) WHERE coalesce(ck IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'), false)"
add("qa_referential", _REFERS, _KNOWN)
add("qa_referential_rejected", _REFERS, _KNOWN.replace("WHERE coalesce", "WHERE NOT coalesce"), "check.rejected")
add("qa_row_count", [NATION, ("c", "qa.row_count", {"min": 25, "max": 25})], "SELECT * FROM nation")
add("qa_schema_match", [NATION, ("c", "qa.schema_match", {"columns": ["n_name", "n_regionkey"]})], "SELECT * FROM nation")
add("control_nodes", [REGION, NATION, ("w", "ctl.wait", {"ms": 1}, "region"), ("l", "ctl.log", {"message": "read"}), ("f", "ctl.fail", {"when": "r_name IS NULL", "message": "a region has no name"}), ("b", "ctl.branch", {"predicate": "r_regionkey = 0"}), ("s", "ctl.sequence", {}, {"main": "b", "after": "nation"})], "SELECT * FROM region")
add("incremental", [("events", "src.file.parquet", {"path": "{sf}/events.parquet"}, None, {"incremental": {"column": "ts", "start": "2024-01-20 00:00:00"}})], "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
add("sample_rows", [ORDERS, ("s", "xf.sample", {"size": 100}), ("a", "xf.aggregate", {"aggregations": "count(*) AS n, count(DISTINCT o_orderkey) AS keys"})], "SELECT 100::BIGINT AS n, 100::BIGINT AS keys")
add("sample_percent", [ORDERS, ("s", "xf.sample", {"size": 10, "unit": "percent"}), ("a", "xf.aggregate", {"aggregations": "count(*) AS n"})], "SELECT round(count(*) * 0.1)::BIGINT AS n FROM orders")
add("materialize_disk", [LINEITEM, ("f", "xf.filter", {"predicate": "l_quantity > 48"}, None, {"materialize": "disk"}), ("a", "xf.aggregate", {"aggregations": "count(*) AS n", "group_by": ["l_linestatus"]})], "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1")

_DOCS = ("documents", "src.file.parquet", {"path": "{sf}/documents.parquet"})
_SHAPES = {kind: pattern for kind, pattern, _ in PATTERNS}


def _swapped(name: str, source: str, token: str) -> str:
    """Two tables of SQL: `name` (doc_id, t) is `source` (doc_id, t, found) with one found text after another replaced."""
    return f"""{name}_walk AS (
      SELECT doc_id, t, found, 1 AS i FROM {source}
      UNION ALL SELECT doc_id, replace(t, found[i], {token.replace("$", "found[i]")}), found, i + 1 FROM {name}_walk WHERE i <= len(found)
    ), {name} AS (SELECT doc_id, t FROM {name}_walk WHERE i > coalesce(len(found), 0))"""


add(
    "redact_tokens",
    [_DOCS, ("r", "xf.ai.redact", {"columns": ["text"]}), ("s", "xf.select", {"columns": ["doc_id", "text"]})],
    rf"""WITH RECURSIVE net AS (
      SELECT doc_id, regexp_replace(regexp_replace(text, '{_SHAPES["email"]}', '[EMAIL]', 'g'), '{_SHAPES["ip"]}', '[IP]', 'g') AS t FROM documents
    ), numbers AS (
      SELECT doc_id, k, m, reverse(regexp_replace(m, '\D', '', 'g')) AS d
      FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_SHAPES["credit_card"]}')) AS m, generate_subscripts(regexp_extract_all(t, '{_SHAPES["credit_card"]}'), 1) AS k FROM net)
    ), digits AS (SELECT doc_id, k, m, i, substring(d, i, 1)::INTEGER AS digit FROM (SELECT *, unnest(range(1, length(d) + 1)) AS i FROM numbers)),
    cards AS (
      SELECT doc_id, k, m FROM digits GROUP BY ALL HAVING sum(CASE WHEN i % 2 = 1 THEN digit ELSE substring('0246813579', digit + 1, 1)::INTEGER END) % 10 = 0
    ), with_cards AS (
      SELECT net.doc_id, any_value(t) AS t, coalesce(list(m ORDER BY k) FILTER (WHERE m IS NOT NULL), []) AS found FROM net LEFT JOIN cards USING (doc_id) GROUP BY net.doc_id
    ), {_swapped("paid", "with_cards", "'[CARD]'")},
    social AS (SELECT doc_id, regexp_replace(t, '{_SHAPES["ssn"]}', '[SSN]', 'g') AS t FROM paid),
    calls AS (
      SELECT doc_id, k, m FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_SHAPES["phone"]}')) AS m, generate_subscripts(regexp_extract_all(t, '{_SHAPES["phone"]}'), 1) AS k FROM social)
      WHERE length(regexp_replace(m, '\D', '', 'g')) IN (10, 11, 12, 13, 14, 15) AND translate(m, '0123456789', '') <> '' AND NOT (m[3] BETWEEN '0' AND '9' AND m[1:2] IN ('19', '20') AND m[5] = '-' AND m[8] = '-' AND regexp_full_match(m[1:10], '[\d-]+'))
    ), with_calls AS (
      SELECT social.doc_id, any_value(t) AS t, coalesce(list(m ORDER BY k) FILTER (WHERE m IS NOT NULL), []) AS found FROM social LEFT JOIN calls USING (doc_id) GROUP BY social.doc_id
    ), {_swapped("called", "with_calls", "'[PHONE]'")}
    SELECT doc_id, t AS text FROM called""",
)
add(
    "redact_hashes",
    [_DOCS, ("r", "xf.ai.redact", {"columns": ["text"], "kinds": ["email"], "replacement": "hash"}), ("s", "xf.select", {"columns": ["doc_id", "text"]})],
    f"""WITH RECURSIVE given AS (SELECT doc_id, text AS t, regexp_extract_all(text, '{_SHAPES["email"]}') AS found FROM documents),
    {_swapped("hidden", "given", "'[EMAIL:' || left(sha256(lower($)), 12) || ']'")}
    SELECT doc_id, t AS text FROM hidden""",
)
add(
    "chunk",
    [("conversations", "src.file.parquet", {"path": "{sf}/conversations.parquet"}), ("c", "xf.ai.chunk", {"column": "text", "size": 200, "overlap": 30, "output": "part"})],
    r"""WITH RECURSIVE said AS (SELECT row_number() OVER () AS rid, *, length(text) AS n FROM conversations WHERE trim(text) <> ''),
    places AS (SELECT rid, n, p, substring(text, p, 1) IN (' ', chr(9), chr(10), chr(12), chr(13)) AS gap FROM (SELECT rid, text, n, unnest(range(1, n + 1)) AS p FROM said)),
    gaps AS (SELECT rid, p AS g FROM places WHERE gap),
    windows AS (
      SELECT places.rid, n, p AS s, CASE WHEN p + 199 >= n THEN n - p + 1 WHEN g - p > 30 THEN g - p ELSE 200 END AS taken, p + 199 >= n AS last
      FROM places ASOF LEFT JOIN gaps ON places.rid = gaps.rid AND places.p + 199 >= gaps.g
    ), onward AS (SELECT *, s + taken - 30 AS back FROM windows),
    landed AS (SELECT o.*, coalesce(places.gap, false) AS on_gap FROM onward o LEFT JOIN places ON places.rid = o.rid AND places.p = o.back - 1),
    successors AS (
      SELECT landed.rid, s, taken, last, CASE WHEN NOT on_gap AND g < back + 30 THEN g + 1 ELSE back END AS next
      FROM landed ASOF LEFT JOIN gaps ON landed.rid = gaps.rid AND landed.back <= gaps.g
    ), walk AS (
      SELECT rid, s, taken, last, next FROM successors WHERE s = 1
      UNION ALL SELECT t.rid, t.s, t.taken, t.last, t.next FROM walk w JOIN successors t ON t.rid = w.rid AND t.s = w.next WHERE NOT w.last
    ), parts AS (SELECT rid, s, trim(substring(text, s, taken)) AS part FROM walk JOIN said USING (rid))
    SELECT conv_id, turn, role, row_number() OVER (PARTITION BY rid ORDER BY s) - 1 AS part_index, part FROM parts JOIN said USING (rid) WHERE part <> ''""",
)
add("embed_hashed", [("conversations", "src.file.parquet", {"path": "{sf}/conversations.parquet"}), ("e", "xf.ai.embed", {"column": "text", "dimensions": 16}), ("a", "xf.sql", {"query": "SELECT conv_id, turn, cardinality(embedding) AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 3) AS norm FROM e"})], "SELECT conv_id, turn, 16::INTEGER AS n, 1.0::DOUBLE AS norm FROM conversations")


# --- files written and read back, and what runs report ------------------------------------------------


def add_round_trip(name: str, steps: list[Step], sink: str, source: str, end: str, sql: str, sink_props: dict[str, Any] | None = None, source_props: dict[str, Any] | None = None) -> None:
    """Registers a query that runs a pipeline into a file and returns what a source reads from it."""

    def run_it(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, name) + end
        given = lambda props: {k: v.replace("{path}", path.removeprefix("file://") if "sqlite" in sink else path) for k, v in props.items()} if props else {"path": path}
        placed = [(s[0], s[1], {k: v.replace("{sf}", sf_dir) if k == "path" else v for k, v in s[2].items()}, *s[3:]) for s in steps]
        run(spark, pipeline(*placed, ("out", sink, given(sink_props)), name=name), counts="none")
        return frames(spark, pipeline(("back", source, given(source_props)), name=name))["back"]

    QUERIES[name] = run_it
    ORACLE_SQL[name] = sql


_ODD = ("odd", "xf.derive", {"expressions": "concat('a \"quoted\", ', p_name) AS odd, nullif(p_size, 1) AS size"})
_ODD_SQL = "SELECT *, concat('a \"quoted\", ', p_name) AS odd, nullif(p_size, 1) AS size FROM part"
add_round_trip("csv_round_trip", [PART, _ODD], "snk.file.csv", "src.file.csv", ".csv", _ODD_SQL)
add_round_trip("jsonl_round_trip", [ORDERS], "snk.file.jsonl", "src.file.jsonl", ".jsonl", "SELECT * FROM orders")
add_round_trip("json_round_trip", [PART, _ODD], "snk.file.json", "src.file.json", ".json", _ODD_SQL)
add_round_trip("parquet_round_trip", [LINEITEM], "snk.file.parquet", "src.file.parquet", ".parquet", "SELECT * FROM lineitem")
add_round_trip("excel_round_trip", [ORDERS], "snk.file.excel", "src.file.excel", ".xlsx", "SELECT * FROM orders")
add_round_trip(
    "xml_round_trip", [PART, _ODD], "snk.file.xml", "src.file.xml", ".xml", _ODD_SQL.replace("*,", "p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size, p_retailprice::VARCHAR AS p_retailprice,").replace("nullif(p_size, 1) AS size", "nullif(part.p_size, 1)::VARCHAR AS size"),
    {"path": "{path}", "record": "part"}, {"path": "{path}", "record": "part"},
)
add_round_trip("sqlite_round_trip", [ORDERS], "snk.db.sqlite", "src.db.sqlite", ".sqlite", "SELECT * FROM orders", {"connection": "{path}", "table": "orders"}, {"connection": "{path}", "table": "orders"})


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every stage's outputs, as a run reports them."""
    steps = [ORDERS, ("f", "xf.filter", {"predicate": "o_totalprice > 100000"}), ("check", "qa.regex", {"column": "o_orderpriority", "pattern": "^[12]-"}), ("out", "snk.file.parquet", {"path": new_path(spark, "reported"), "layout": "folder"}), ("rest", "snk.file.parquet", {"path": new_path(spark, "reported"), "layout": "folder"}, "check.rejected")]
    placed = [(s[0], s[1], {k: v.replace("{sf}", sf_dir) if k == "path" else v for k, v in s[2].items()}, *s[3:]) for s in steps]
    report = run(spark, pipeline(*placed, name="reported"))
    return spark.createDataFrame([(s.id, port, n) for s in report.stages for port, n in s.rows.items()], "stage string, port string, rows long")


QUERIES["run_report"] = _reported
ORACLE_SQL["run_report"] = """
SELECT stage, 'in' AS port, count(*) AS rows FROM (SELECT CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN 'out' ELSE 'rest' END AS stage FROM orders WHERE o_totalprice > 100000) GROUP BY stage
"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each whose id is divisible by 20, among all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = nearest(rows, rows.where("vec_id % 20 = 0"), 10, lambda df: written(spark, df, "nearest"), key="vec_id")
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


def _previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a preview of a node shows, with no sink run."""
    steps = [("nation", "src.file.parquet", {"path": f"{sf_dir}/nation.parquet"}), ("f", "xf.filter", {"predicate": "n_regionkey = 2"}), ("out", "snk.file.parquet", {"path": new_path(spark, "previewed")})]
    rows, columns, _ = preview(spark, pipeline(*steps, name="previewed"), "f")
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], "n_nationkey int, n_name string, n_regionkey int")


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a pipeline and what it reads and writes outside."""
    steps = [("nation", "src.file.parquet", {"path": "nation.parquet"}), ("check", "qa.not_null", {"columns": ["n_name"]}), ("out", "snk.file.parquet", {"path": "out"}), ("rest", "snk.file.csv", {"path": "rest"}, "check.rejected")]
    found = lineage(compile_pipeline(pipeline(*steps, name="lineage")))
    edges = [(e["source"], e["output"], e["target"]) for e in found["edges"]]
    outside = [(x["path"], x["direction"], x["node"]) for x in found["external"]]
    return spark.createDataFrame([*edges, *outside], "origin string, kind string, target string")


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a Delta table of three commits (parts added, one of them rewritten), read from its log."""
    root = new_path(spark, "delta")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fields = orders.schema.jsonValue()
    commits: list[list[dict[str, Any]]] = [[{"metaData": {"id": "orders", "schemaString": json.dumps(fields), "partitionColumns": ["o_orderstatus"]}}], [], []]

    def put(commit: int, rows: DataFrame, status: str, part: str) -> list[str]:
        rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus").write.parquet(f"{root}/{part}")
        paths = [f"{part}/{x.rsplit('/', 1)[-1]}" for x in list_files(spark, f"{root}/{part}/part-*")]
        commits[commit] += [{"add": {"path": p, "partitionValues": {"o_orderstatus": status}, "size": 1, "dataChange": True}} for p in paths]
        return paths

    for status in ("F", "O"):
        old = put(0, orders, status, f"first-{status}")
    put(1, orders, "P", "second")
    commits[2] += [{"remove": {"path": p}} for p in old]  # open orders again, without the cheap ones
    put(2, orders.where("o_totalprice > 50000"), "O", "third")
    for i, actions in enumerate(commits):
        made = new_path(spark, "commit")
        spark.createDataFrame([(json.dumps(a),) for a in actions], "value string").coalesce(1).write.text(made)
        replace_file(spark, list_files(spark, f"{made}/part-*")[0], f"{root}/_delta_log/{i:020d}.json")
    return frames(spark, pipeline(("back", "src.lake.delta", {"path": root}), name="delta"))["back"]


add(
    "cosine_similarity",
    [
        table("embeddings"),
        ("next", "xf.sql", {"query": "SELECT vec_id - 1 AS vec_id, embedding AS other FROM embeddings"}, "embeddings"),
        ("j", "xf.join", {"type": "inner", "keys": ["vec_id"]}, {"left": "embeddings", "right": "next"}),
        ("d", "xf.derive", {"expressions": "round(array_cosine_similarity(embedding, other), 6) AS similarity"}),
        ("s", "xf.select", {"columns": ["vec_id", "label", "similarity"]}),
    ],
    """SELECT a.vec_id, a.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
QUERIES |= {"embedding_neighbours": _neighbours, "preview": _previewed, "lineage": _lineage, "delta_log": _delta, **catalog_remote.QUERIES}
ORACLE_SQL |= {
    "embedding_neighbours": """SELECT query, id, round(similarity, 6) AS similarity, place::INTEGER AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM (
        SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0))
      WHERE place <= 10""",
    "preview": "SELECT * FROM nation WHERE n_regionkey = 2",
    "lineage": "SELECT * FROM (VALUES ('nation', 'main', 'check'), ('check', 'main', 'out'), ('check', 'rejected', 'rest'), ('nation.parquet', 'reads', 'nation'), ('out', 'writes', 'out'), ('rest', 'writes', 'rest')) AS t(origin, kind, target)",
    "delta_log": "SELECT * FROM orders WHERE o_orderstatus <> 'O' OR o_totalprice > 50000",
    **catalog_remote.ORACLE_SQL,
}
