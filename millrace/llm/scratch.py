"""Tables written between steps, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import delete, new_path

__all__ = ["Scratch", "bounded_batches", "new_path"]


class Scratch:
    """Writes tables, reads them back, and drops those no result needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written once: lineage ends here and lost executors lose nothing."""
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def keep_bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """As keep(), in buckets by a column: joins on it shuffle the other side only.

        The catalog knows the table only until it has been opened, so nothing is left there.
        """
        path, table = new_path(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(table)
        back = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        self.paths[id(back)] = (path, back)
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of texts by their bytes: ten thousand long documents are no batch for one task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
