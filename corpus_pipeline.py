"""From raw documents to training shards, in five stages over the standard tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's docs. All stages but the last return the columns of
documents, whatever more columns those have and whatever they are called. Any column may hold nulls,
texts may be empty or very long, rows may repeat, and a table without rows makes one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, langid, minhash, mixing, sharding
from millrace.llm.scratch import Scratch, bounded_batches, new_path

#: A document whose language is less sure than this is rejected, as is one without letters.
LEAST_SURE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a determined language, by a model fitted on these documents.

    Null and empty texts and texts without a letter go, and so do all if no document tells its lang.
    Rows with equal texts stay or go together; other columns decide nothing.
    """
    bounded_batches(spark)
    return langid.known_only(docs, langid.fit(docs), least=LEAST_SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies.

    Rows that share a doc_id are one document and stay or go together. A null doc_id stays, and so
    do null and empty texts, which are copies of nothing.
    """
    bounded_batches(spark)
    return minhash.one_of_each(docs, Scratch(spark), k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark.

    Each row stays or goes by its own text, whatever its doc_id; null and empty texts stay.
    """
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark), k=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source's words come near its target.

    A null source is a source. A null text has no words; a source without words is not taken. Rows of
    the same doc_id and source are drawn alike, null ones too.
    """
    return mixing.emit(mixing.mix(docs, Scratch(spark)))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the compacted shards, with the arrival and the shard of each: columns `arrival` and
    `shard`, with an underscore after the name where documents have a column of that name. Every row is
    in one shard; a null doc_id comes with the arrival of an empty one."""
    arrival, shard = sharding.free_name(docs, "arrival"), sharding.free_name(docs, "shard")
    return sharding.shard(docs, new_path(spark, "shards"), arrival=arrival).read(shard=shard)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]

#: Language identification and near-duplicate detection have no SQL form; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
