"""Conversations from reply trees, in DataFrame operations only.

Root-to-leaf paths are enumerated by self-joins of pointer doubling: in round r every message knows
its ancestor 2**r replies above and the score on the way, so a tree of depth d takes log2(d) joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What texts and roles are escaped by, in this order; every control string of the common templates
#: (<|im_start|>, <s>, </s>, [INST], [/INST], <<SYS>>) begins with a character that is escaped here.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(tree, node, parent, role, text, score): each conversation as a tree without branches, a reply
    to each row by turn; rows of the same turn by role and text. A conversation's rows meet in one
    task, as they do again in its formatted text."""
    by = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    picked = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    at = picked.withColumn("node", F.row_number().over(by).cast("long"))
    return at.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _lifts(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) of the ancestors 1, 2, 4 ... above, and (tree, node, depth, total)
    with each message's number of ancestors and the summed score of its path."""
    same = [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.up") == F.col("b.node")]
    now = scratch.keep(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "lift")
    done = now.where("up is null").selectExpr("tree", "node", "0L as depth", "total")
    lifts = []
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while True:
        active = now.where("up is not null")
        if 1 << len(lifts) > largest or active.isEmpty():  # no path is longer than its tree is large: the rest are cycles
            return lifts, done
        lifts.append(active.select("tree", "node", "up"))
        ends = done.selectExpr("tree", "node", "cast(null as long) as up", "depth", "total")
        step = active.alias("a").join(active.unionByName(ends).alias("b"), same).selectExpr("a.tree", "a.node", "b.up as up", "a.depth + b.depth as depth", "a.total + b.total as total")
        now = scratch.keep(step, "lift")
        done = scratch.keep(done.union(now.where("up is null").select("tree", "node", "depth", "total")), "depths")


def paths(nodes: DataFrame, scratch: Scratch, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, position, role, text): the messages on the paths to each tree's `best` leaves.

    nodes has tree, node (distinct within its tree), parent (null at a root), role, text, score. A
    path ranks by the sum of its messages' scores, then by the smaller leaf; a null score counts as
    0. best=None keeps all paths. A tree may have several roots. Messages whose parent does not
    exist, and those above or below them in a cycle, are on no path. Empty input gives no rows.

    The best leaves of a tree are first taken within 64 salted parts of it, so a tree that holds a
    third of all messages is ranked by many tasks.
    """
    nodes = scratch.keep(nodes.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    lifts, depths = _lifts(nodes, scratch)
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = depths.alias("a").join(parents.alias("b"), [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.node") == F.col("b.node")], "left_anti")
    order = [F.desc("total"), F.asc("node")]
    salted = leaves.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "salt").orderBy(*order)))
    first = first if best is None else first.where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    ranked = ranked if best is None else ranked.where(F.col("rank") <= best)
    on = scratch.keep(ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("position")), "paths")
    for r, lift in enumerate(lifts):  # after round r the path holds the leaf and 2**(r+1) - 1 ancestors
        up = on.alias("a").join(lift.alias("b"), [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.node") == F.col("b.node")])
        on = scratch.keep(on.union(up.selectExpr("a.tree", "a.leaf", "a.rank", "b.up as node", f"a.position - {1 << r} as position")), "paths")
    joined = on.alias("a").join(nodes.alias("b"), [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.node") == F.col("b.node")])
    return joined.select("a.tree", "a.leaf", "a.rank", "a.position", "b.role", "b.text")


def render(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss_turns, loss_spans): each path as one conversation.

    A turn is OPEN, its role, a line end, its text, CLOSE; role and text are escaped, so that no
    control string but the template's own is left, and unescape() gives them back. Null roles and
    texts are empty. loss_turns tells for each turn whether it is under the loss mask; loss_spans
    gives the masked characters of `formatted` as (start from 0, length): the escaped text of each
    turn of loss_role, without markers. A path is one row, so all of it, escaped, has to fit a string
    of Spark (2 GB) and its turns one task; a longer conversation is an error.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    parts = turns.select("tree", "leaf", "rank", "position", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"), F.concat(F.lit(OPEN), F.replace(role, F.lit("\n"), F.lit("&#10;")), F.lit("\n")).alias("head"), text.alias("body"))
    parts = parts.withColumn("chars", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.length("head"))
    piece = F.struct("position", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "loss", F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))
    whole = parts.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return whole.select(
        "tree", "leaf", "rank", F.size("p").cast("long").alias("n_turns"), F.array_join("p.piece", "").alias("formatted"), F.col("p.loss").alias("loss_turns"),
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def masked(formatted: str, spans: str) -> Column:
    """The text of a conversation under its loss mask: the characters of the spans, unescaped, one after another."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def parse(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, position, role, text, loss) of each turn, read from `formatted` alone; `loss` is
    the turn's place in loss_turns."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = formatted.select("tree", "leaf", F.posexplode(F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("piece"), F.col("loss_turns").alias("loss"))).alias("position", "t"))
    head = F.substring_index("t.piece", "\n", 1)
    text = F.expr("substr(t.piece, length(substring_index(t.piece, '\\n', 1)) + 2)")
    role = F.replace(F.substr(head, F.lit(len(OPEN) + 1)), F.lit("&#10;"), F.lit("\n"))
    return turns.select("tree", "leaf", "position", unescape(role).alias("role"), unescape(text).alias("text"), F.col("t.loss").alias("loss"))
