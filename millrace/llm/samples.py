"""Bounded samples of labelled rows, from which the models are fitted."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .scratch import Scratch


#: Labels whose rates are sent to every task; beyond that they are joined as any table.
MOST_LABELS = 100_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def bounded(rows: DataFrame, label: str, key: str, per_label: int, labels: int | None = None) -> DataFrame:
    """About per_label rows of every label, or of the `labels` most frequent ones if that is given.

    Rows are taken by a hash of the key at a rate of per_label over the label's count, so that equal
    tables give equal samples. One aggregation by label; its rates, a row for a label, are written,
    counted, and broadcast if there are no more than MOST_LABELS of them.
    """
    given = rows.where(F.col(label).isNotNull())
    counts = given.groupBy(label).count()
    if labels is not None:
        counts = counts.orderBy(F.desc("count"), label).limit(labels)
    rates = counts.select(label, (F.lit(float(per_label)) / F.col("count")).alias("rate_"))
    rates = Scratch(rows.sparkSession).keep(rates, "rates")
    rates = F.broadcast(rates) if rates.count() <= MOST_LABELS else rates
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    return given.join(rates, label).where(draw < F.col("rate_")).select(*[F.col(f"`{c}`") for c in rows.columns])


def gathered(rows: DataFrame, name: str, *order: Column | str) -> Iterator[Row]:
    """A bounded sample's rows on the driver, a partition at a time, in an order if one is given.

    They are written first: all tasks look for them at once, and what is then read one after another
    is a few small files.
    """
    scratch = Scratch(rows.sparkSession)
    kept = scratch.keep(rows, name)
    yield from (kept.orderBy(*order) if order else kept).toLocalIterator()
    scratch.drop(kept)
