import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, sharding
from millrace.llm.scratch import new_path


def rows_of(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("path"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("bytes"))


@pytest.fixture
def shards(spark):
    return sharding.ShardSet(spark, new_path(spark, "set"), target_bytes=40_000, fanout=3)


def test_appends_and_compaction(spark, shards):
    assert shards.version() == 0 and shards.manifest().count() == 0
    for i in range(6):
        assert shards.append(rows_of(spark, 50, 50 * i).coalesce(1)) == i + 1
    assert shards.manifest().count() == 6
    before = shards.read().exceptAll(rows_of(spark, 300))
    assert before.isEmpty() and shards.read().count() == 300
    version = shards.compact()
    assert version > 6 and shards.manifest().count() < 6
    assert shards.read().count() == 300 and shards.read().exceptAll(rows_of(spark, 300)).isEmpty()
    assert shards.read(3).count() == 150  # an older version still reads
    assert shards.compact() == version  # and nothing is left to merge
    assert shards.vacuum() == 6 and shards.read().count() == 300


def test_only_runs_of_similar_size_are_merged(spark, shards):
    shards.append(rows_of(spark, 30000).coalesce(1))  # larger than the target
    for i in range(2):
        shards.append(rows_of(spark, 10, 30000 + 10 * i).coalesce(1))
    large = shards.manifest().where("bytes > 20000").select("run").first()[0]
    assert shards.compact() == 3  # two small ones are under the fan-out
    shards.append(rows_of(spark, 10, 30020).coalesce(1))
    shards.compact()
    manifest = shards.manifest()
    assert manifest.count() == 2 and manifest.where(F.col("run") == large).count() == 1
    assert manifest.agg(F.sum("rows")).first()[0] == 30030


def test_merged_files_have_the_target_size(spark):
    made = sharding.ShardSet(spark, new_path(spark, "set"), target_bytes=60_000, fanout=4)
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for i in range(4):
        made.append(rows.where(f"doc_id % 4 = {i}").repartition(10))
    made.compact()
    run = made.manifest().first()
    assert made.manifest().count() == 1 and run.files < 40 and run.rows == 20000
    sizes = [r.s for r in made.read().select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct().collect()]
    assert len(sizes) == run.files and max(sizes) < 120_000 and sum(sizes) / len(sizes) > 20_000


def test_a_late_writer_goes_on_top(spark, shards, monkeypatch):
    shards.append(rows_of(spark, 5))
    late = sharding.ShardSet(spark, shards.root)
    real, seen = late.version, []
    monkeypatch.setattr(late, "version", lambda: seen.append(1) or (0 if len(seen) == 2 else real()))  # the commit sees the past once
    assert late.append(rows_of(spark, 7, 5)) == 2
    assert shards.version() == 2 and shards.read().count() == 12


def test_one_of_two_renames_fails(spark, shards):
    shards.append(rows_of(spark, 5))
    with pytest.raises(sharding.Conflict):
        shards._rename(shards.manifest().collect(), 1)
    assert shards.version() == 1 and shards.read().count() == 5


def test_writers_at_once(spark, shards):
    def add(i):
        sharding.ShardSet(spark, shards.root).append(rows_of(spark, 10, 10 * i).coalesce(1))

    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert shards.version() == 4 and shards.read().exceptAll(rows_of(spark, 40)).isEmpty() and shards.read().count() == 40


def test_compaction_gives_way_to_another(spark, shards):
    for i in range(3):
        shards.append(rows_of(spark, 50, 50 * i).coalesce(1))
    old = shards.manifest().collect()
    shards.compact()
    assert shards._commit([old[0]], frozenset(r.run for r in old)) is None  # what it merged is no longer there
    assert shards.read().count() == 150


def test_vacuum_between_write_and_commit(spark, shards):
    """A run that is written and not yet committed is kept; an abandoned one goes after the grace period."""
    shards.append(rows_of(spark, 5))
    other = sharding.ShardSet(spark, shards.root)
    folder = other._write(rows_of(spark, 7, 5))
    assert shards.vacuum() == 0
    other._commit(other._runs(folder, rows_of(spark, 1).schema))
    assert shards.read().count() == 12
    other._write(rows_of(spark, 3))
    time.sleep(0.1)
    assert shards.vacuum(grace_seconds=0) == 1 and shards.read().count() == 12


def test_edge_cases(spark, shards):
    with pytest.raises(ValueError, match="no version"):
        shards.read()
    assert shards.append(rows_of(spark, 0)) == 1 and shards.read(shard="shard").count() == 0
    assert shards.read().schema.simpleString() == rows_of(spark, 0).schema.simpleString()
    odd = spark.createDataFrame([(None, None, "s", 1), (1, "", "s", None), (1, "", "s", None), (2, "x" * 2_000_000, None, 3)], "doc_id long, text string, path string, bytes long")
    shards.append(odd)
    assert shards.read().exceptAll(odd).isEmpty() and shards.read().count() == 4
    with pytest.raises(ValueError, match="the dataset has"):
        shards.append(odd.drop("path"))


def test_arrivals(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = sharding.ShardSet(spark, new_path(spark, "set"))
    assert made.append(docs.withColumn("arrival", sharding.arrival_of(F.col("doc_id"), 4)), "arrival") == 4  # a version each
    one_each = made.read(shard="shard").groupBy("shard").agg(F.countDistinct("arrival").alias("n"))
    assert one_each.where("n <> 1").isEmpty()
    assert [made.read(v).select("arrival").distinct().count() for v in range(1, 5)] == [1, 2, 3, 4]


def test_arrivals_are_compacted_as_they_come(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = sharding.shard(docs, new_path(spark, "set"), arrivals=8, fanout=4)
    assert made.version() > 8 and made.manifest().count() < 8
    assert made.read().drop("arrival").exceptAll(docs).isEmpty() and made.read().count() == docs.count()


def test_arrivals_of_no_rows_and_clashing_names(spark):
    empty = rows_of(spark, 0)
    made = sharding.shard(empty, new_path(spark, "set"))
    assert made.read(shard="shard").count() == 0 and set(made.read().columns) == {*empty.columns, "arrival"}
    clash = rows_of(spark, 9).selectExpr("*", "'mine' as arrival", "'mine' as shard", "'mine' as _arrival")
    name = sharding.free_name(clash, "arrival")
    assert name == "arrival_" and sharding.free_name(clash, "SHARD") == "SHARD_"
    out = sharding.shard(clash, new_path(spark, "set"), arrival=name).read(shard="shard_")
    assert out.select(clash.columns).exceptAll(clash).isEmpty() and out.count() == 9


def test_matches_sql(same):
    same(queries.QUERIES["op5_sharding"], queries.ORACLE_SQL["op5_sharding"])


def test_names_are_free(spark):
    assert uuid.UUID(new_path(spark, "x").rsplit("-", 1)[-1])
