"""Datasets of immutable shards with size-tiered compaction, in DataFrame operations only.

An arrival is appended as a run: a folder of small Parquet files that are never changed. Runs of
similar size form a tier; a tier of enough runs is merged into one run of files of the target size,
and a run of such files is merged no more. What the dataset holds is told by manifests, one table for
each version with a row for each run. A version comes to be when its manifest, written elsewhere, is
renamed to its number, which fails if the number is taken: of two writers the later one puts its run
on top of the other's version. A reader sees the old version or the new one.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One row for each run: its folder below data/, what it holds, the version it came with, the columns' types.
MANIFEST = "run string, files long, rows long, bytes long, since long, columns string"
#: How often a commit is tried on top of other writers' versions.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass
class ShardSet:
    """The dataset in a folder that all executors share; renaming must be atomic there.

    What the driver holds of it is a row for each live run. Appending makes runs and compaction
    merges them, so their number follows the tiers and the files of the target size, not the rows.
    """

    spark: SparkSession
    root: str
    target_bytes: int = 128 << 20
    #: Runs of a tier differ by less than this factor; as many of them are merged, or more.
    fanout: int = 4

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before the first append."""
        path, files = self._fs(f"{self.root}/_manifest")
        if not files.exists(path):
            return 0
        return max((int(x.getPath().getName()[1:]) for x in files.listStatus(path) if x.getPath().getName().startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, files, rows, bytes, since, columns), one row for each live run."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest/v{version:08d}")

    def _table(self, runs: list[Row]) -> DataFrame:
        """The manifest's rows as literals, which takes no Python worker."""
        rows = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(MANIFEST)]) for r in runs]
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    def _rename(self, runs: list[Row], version: int) -> None:
        made = f"{self.root}/_made/{uuid.uuid4().hex}"
        self._table(runs).coalesce(1).write.parquet(made)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        Path, Context = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileContext  # noqa: N806
        to, files = self._fs(f"{self.root}/_manifest/v{version:08d}")
        files.mkdirs(to.getParent())
        none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            Context.getFileContext(to.toUri() if to.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(Path(made), to, none)
        except Py4JJavaError as e:
            self._fs(made)[1].delete(Path(made), True)
            if "FileAlreadyExists" in str(e.java_exception) or files.exists(to):
                raise Conflict(f"version {version} exists") from e
            raise

    def _commit(self, new: list[Row], merged: frozenset[str] = frozenset()) -> int | None:
        """A version with the runs `new` in place of those `merged`; None if another writer has
        meanwhile taken one of those away. Tries again where another writer was first."""
        for n in range(TRIES):
            before = self.version()
            live = self.manifest(before).collect()
            if not merged <= {r.run for r in live}:
                return None
            runs = [r for r in live if r.run not in merged] + [Row(**{**r.asDict(), "since": before + 1}) for r in new]
            try:
                self._rename(runs, before + 1)
                return before + 1
            except Conflict:
                if n == TRIES - 1:
                    raise
        return None

    def _runs(self, folder: str, schema: StructType, by: str | None = None) -> list[Row]:
        """The manifest's rows for a written folder, from its files' own footers: one for the folder,
        or one for each value of the column that it was partitioned `by`."""
        files = self.spark.read.schema(schema).parquet(f"{self.root}/data/{folder}")
        meta = F.col("_metadata")
        name = F.regexp_extract(meta.file_path, rf"{folder}(?:/[^/]*)?(?=/[^/]*$)", 0) if by else F.lit(folder)
        each = files.select(name.alias("run"), meta.file_path.alias("path"), meta.file_size.alias("bytes")).groupBy("run", "path", "bytes").agg(F.count("*").alias("rows"))
        runs = each.groupBy("run").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).orderBy("run")
        found = [Row(run=r.run, files=r.files, rows=r.rows, bytes=r.bytes, since=0, columns=schema.json()) for r in runs.collect()]
        return found or [Row(run=folder, files=0, rows=0, bytes=0, since=0, columns=schema.json())]

    def _write(self, rows: DataFrame, by: str | None = None) -> str:
        folder = f"run-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/data/{folder}")
        return folder

    def append(self, rows: DataFrame, arrival: str | None = None, compact: bool = False) -> int:
        """Adds rows as small shards, one file at least for each writing task, and returns the new version.

        `arrival` names a column whose values are arrivals of their own: one pass writes all of them,
        and each is then committed as a run and a version, one after another, and compacted if `compact`.
        Nulls, long texts and repeated rows are stored as they are; no rows make a version with a
        run without files, which keeps the columns. Columns other than those of the dataset are a
        ValueError.
        """
        known = self.columns()
        if known is not None and known.simpleString() != rows.schema.simpleString():
            raise ValueError(f"the dataset has {known.simpleString()}")
        by = f"arrival_{uuid.uuid4().hex}" if arrival else None
        folder = self._write(rows.withColumn(by, F.col(f"`{arrival}`")) if arrival else rows, by)
        version = 0
        for run in self._runs(folder, rows.schema, by):
            version = self._commit([run])
            if compact:
                version = self.compact()
        return version

    def columns(self) -> StructType | None:
        """The columns of the dataset, None before the first append."""
        row = self.manifest().orderBy(F.desc("since")).select("columns").first()
        return StructType.fromJson(json.loads(row[0])) if row else None

    def tiers(self) -> DataFrame:
        """(tier, runs, files, bytes) of the runs whose files are below half the target size on average."""
        return self._small(self.manifest()).groupBy(self._tier().alias("tier")).agg(F.count("*").alias("runs"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))

    def _small(self, runs: DataFrame) -> DataFrame:
        return runs.where(f"files > 0 and 2 * bytes < {self.target_bytes} * files")

    def _tier(self) -> Column:
        return F.floor(F.log(float(self.fanout), F.greatest("bytes", F.lit(1)).cast("double")))

    def compact(self) -> int:
        """Merges every tier of at least `fanout` runs and returns the version, new if there was one.

        A tier's rows go to as many tasks as its bytes fill files of the target size: whole scan
        partitions go together, so nothing is shuffled and no key decides a file's size, and a task that
        holds more than a file's rows writes several. The merged runs stay on disk for readers of
        older versions until vacuum(). What another writer has merged meanwhile is given up.
        """
        while full := self._small(self.manifest()).withColumn("tier", self._tier()).groupBy("tier").agg(F.collect_list("run").alias("runs"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).where(F.size("runs") >= self.fanout).orderBy("tier").collect():
            tier = full[0]
            files = -(-tier.bytes // self.target_bytes)
            schema = self.columns()
            rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{r}" for r in tier.runs]).coalesce(files)
            folder = f"run-{uuid.uuid4().hex}"
            rows.write.option("compression", "zstd").option("maxRecordsPerFile", -(-tier.rows // files)).parquet(f"{self.root}/data/{folder}")
            if self._commit(self._runs(folder, schema), frozenset(tier.runs)) is None:
                path, files_ = self._fs(f"{self.root}/data/{folder}")
                files_.delete(path, True)
        return self.version()

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; `shard` names a column to hold the path of each row's shard.

        A dataset whose runs hold no rows gives none, with its columns; one without a version is a
        ValueError."""
        runs = self.manifest(version).orderBy("since").collect()
        if not runs:
            raise ValueError("the dataset has no version")
        schema = StructType.fromJson(json.loads(runs[-1].columns))
        paths = [f"{self.root}/data/{r.run}" for r in runs if r.files]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumn(shard, F.col("_metadata.file_path") if paths else F.lit(None).cast("string")) if shard else rows

    def vacuum(self, grace_seconds: float = 86400.0) -> int:
        """Deletes the runs that the latest version no longer names, and returns their number.

        Runs that no version has ever named belong to a writer that has not committed yet, and are
        only deleted when older than the grace period. Older versions can no longer be read.
        """
        version = self.version()
        live = {r.run for r in self.manifest(version).collect()}
        named = {r.run for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest/*").select("run").distinct().collect()} if version else set()
        dead = named - live
        path, files = self._fs(f"{self.root}/data")
        whole = {r.split("/")[0] for r in named}
        for x in files.listStatus(path) if files.exists(path) else ():
            name = x.getPath().getName()
            if name not in whole and x.getModificationTime() / 1000 < time.time() - grace_seconds:
                dead.add(name)
        return sum(bool(files.delete(self._fs(f"{self.root}/data/{run}")[0], True)) for run in dead)


def shard(docs: DataFrame, root: str, arrivals: int = 8, target_bytes: int = 128 << 20, fanout: int = 4, arrival: str = "arrival") -> ShardSet:
    """docs in `arrivals` arrivals by doc_id, appended one after another, each followed by compaction.

    The column `arrival` tells the arrival; docs must have none of that name (free_name() finds one).
    What was merged is deleted at the end. An empty table makes a dataset without rows.
    """
    made = ShardSet(docs.sparkSession, root, target_bytes, fanout)
    made.append(docs.withColumn(arrival, arrival_of(F.col("doc_id"), arrivals)), arrival, compact=True)
    made.vacuum()
    return made


def free_name(docs: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores after it if docs has columns of that name."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def arrival_of(doc_id: Column, arrivals: int) -> Column:
    """The arrival a document comes with, by a hash of its id; a null id counts as an empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(arrivals)).cast("int")
