"""Incremental reading: only what lies after the mark, and the new mark if the run succeeds."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_after(df: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Rows whose column is greater than the mark; a predicate that Spark pushes into the scan."""
    if column not in df.columns:
        raise ValueError(f"there is no column '{column}' to read increments by")
    return df if mark is None else df.where(F.col(f"`{column}`") > F.lit(mark).cast(df.schema[column].dataType))


def text_of(value: Any) -> str:
    return value.isoformat(" ") if isinstance(value, datetime) else str(value)


class Marks:
    """The saved position of each source, and what the run has read beyond it."""

    def __init__(self, state: Mapping[str, Any]):
        self.saved = {k: v.get("position") for k, v in state.items() if isinstance(v, Mapping)}
        self.watched: dict[str, Any] = {}

    def position(self, node: str) -> str | None:
        return self.saved.get(node)

    def track(self, node: str, df: DataFrame, column: str) -> None:
        """df holds what the run has read beyond the mark, and must not change any more: see run()."""
        self.watched[node] = (df, column)

    def set(self, node: str, position: str) -> None:
        """A position that the source has worked out itself before it read."""
        self.watched[node] = (None, position)

    def new(self) -> dict[str, str]:
        """The new positions: the greatest value read, or the old one if nothing was. One aggregate for each source."""
        out = {}
        for node, (df, what) in self.watched.items():
            if df is None:
                out[node] = what
                continue
            top = df.agg(F.max(F.col(f"`{what}`"))).first()[0]
            value = text_of(top) if top is not None else self.position(node)
            if value is not None:
                out[node] = value
        return out


def increment(spark: SparkSession, source: DataFrame, checkpoint: str, sink: Any) -> StreamingQuery:
    """What a streaming source holds now and no run before has read, to sink(batch, number).

    A micro-batch run that ends: Spark's checkpoint holds the position, and a batch that fails is
    given again. Unlike the marks of a pipeline the position is this one query's own.
    """
    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
