"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with `k`, their number from 0 in order of source, null last: numbered within ranges of
    sources, and lifted by the ranges before. What one task numbers is a range; what is summed up
    in order is one row for each range."""
    ranges = scratch.keep(rows.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranges.join(before, "part").withColumn("k", F.row_number().over(order) - 1 + F.col("before")).drop("part", "before")


def targets(sized: DataFrame, scratch: Scratch, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): one row per source of sized (source, size).

    Sources in order of code point, null last, weigh `weights` in turn, and share the total size by
    weight. No target passes `most` times its source's size: the excess is shared out again among
    the other sources by weight, until none is above. Works on one row per source; each round of
    sharing is one aggregation of that table, and every round but the last closes a source.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    rows = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    rows = scratch.keep(rows.select("source", "source_size", F.element_at(cycle, (F.pmod("k", F.lit(len(weights))) + 1).cast("int")).alias("weight")), "sources")
    size, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    above = lambda rest, share: f"cast({most} * source_size as decimal(20)) * cast({share} as decimal(18)) > cast({rest} as decimal(20)) * cast(weight as decimal(18))"
    rest, share, before = size, weight, None
    while (rest, share) != before and share:
        before = rest, share
        open_now = above(rest, share)
        closed, weight_open = rows.agg(F.coalesce(F.expr(f"sum(if({open_now}, 0, source_size))"), F.lit(0)), F.coalesce(F.expr(f"sum(if({open_now}, weight, 0))"), F.lit(0))).first()
        rest, share = size - most * closed, weight_open
    level = f"if({above(*before)}, cast(weight as double) * {rest}D / {share}D, cast({most} * source_size as double))" if share else f"cast({most} * source_size as double)"
    return rows.select("source", "source_size", F.expr(level).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 (exclusive) by a hash of the id and the seed; a null id counts as an empty text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, scratch: Scratch, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """(row, size, source_size, target, n_copies), one for each row of docs, which is the struct `row`.

    A source's repetition rate is target / source_size; a source without words has rate 0. Each row
    is taken floor(rate) times, and once more with the fraction as its probability: if the hash of its
    doc_id and the seed, a number from 0 to 1, is below it. So a row's copies depend on its own id, its
    source's rate and the seed alone, equal tables give equal mixtures, and rows with the same id and
    source are drawn alike. A source of n rows comes as near to its target as n independent draws do.

    The rows of docs are scanned twice, for the sizes of the sources and for the draws, and are not
    shuffled for them: the one row per source is joined by broadcast if Spark finds its size below
    the broadcast threshold, and otherwise by a sort-merge join that splits skewed sources.

    Null texts have size 0. A null source is a source. Columns of docs may have any names.
    """
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    per = targets(given.select("source", "size"), scratch, weights, most).withColumnRenamed("source", "of")
    joined = given.join(per, given["source"].eqNullSafe(per["of"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(F.col("row.doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row", "size", "source_size", "target", (F.floor(rate) + extra).alias("n_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The columns of the rows that were mixed, each row n_copies times."""
    copies = mixed.where("n_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy"))
    return copies.select("row.*")
