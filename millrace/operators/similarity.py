"""Each query's most similar vectors by cosine among all, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Held

#: Vectors of a block and queries that meet it at once; vectors that stand for cells, at most.
BLOCK, QUERIES, CELLS = 4096, 1024, 1024
#: Bytes of vectors of a scan that are dealt to cells at once, so that blocks are not as small as a batch makes them.
DEALT_BYTES = 64 << 20
#: Slack for what products of 64-bit numbers round off.
_SLACK = 1e-6
#: Similarities are told apart to so many places; rows that are equal so far come in the order of their ids.
PLACES = 9


def _units(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as rows of length 1; all have the same size."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors have different sizes")
    out = flat.reshape(n, -1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _directed(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    known = v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True)) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.when(known, v).alias("v")).where("v is not null")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, held: Held, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query, id, similarity, place): for each row of queries the k rows of vectors most similar to it by
    cosine, place 1 first; similarity is rounded to PLACES, equal ones come in the order of id. A query that
    is one of the vectors finds itself.

    At most CELLS vectors, drawn by a hash of the id, stand for cells; every vector lies in the cell it is
    nearest to, and the cells' members are packed into blocks of BLOCK, so that a cell of very many is many
    blocks. A query first sees its nearest cells that hold k vectors together, which tells how far its k-th
    neighbour is at most. By the triangle inequality a cell farther than that and its radius holds nothing
    nearer; the query then sees all other cells. So the result is exact, whatever the cells are, and blocks
    and queries meet as matrices. What every task gets is the cells, a bounded table.

    Vectors without a direction (null, empty, zeros, a null or NaN in them) neither find nor are found. All
    others have the same size.
    """
    rows = held(_directed(vectors, key, vector))
    asked = held(_directed(queries, key, vector))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(CELLS).toArrow()
    none = "query long, id long, similarity double, place int"
    if not drawn.num_rows:
        return rows.sparkSession.createDataFrame([], none)
    cells = _units(drawn.column("v").combine_chunks())
    cells = cells[np.sort(np.unique(cells.round(12), axis=0, return_index=True)[1])]
    cells = cells[: max(1, int(np.sqrt(len(cells) * 16)))] if len(cells) < CELLS else cells

    def apart(units: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * units @ cells.T))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            ids, units = (np.concatenate(x) for x in zip(*held, strict=True))
            cell, far = np.empty(len(ids), np.int64), np.empty(len(ids))
            for at in range(0, len(ids), BLOCK):
                away = apart(units[at : at + BLOCK])
                cell[at : at + BLOCK] = away.argmin(axis=1)
                far[at : at + BLOCK] = away.min(axis=1)
            order = np.argsort(cell, kind="stable")
            whole = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)
            parts = [p[at : at + BLOCK] for p in whole for at in range(0, len(p), BLOCK)]
            return pa.RecordBatch.from_arrays(
                [pa.array([cell[p[0]] for p in parts], pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array([float(far[p].max()) for p in parts], pa.float64()), pa.array([ids[p].astype("<i8").tobytes() for p in parts], pa.binary()), pa.array([units[p].tobytes() for p in parts], pa.binary())],
                ["cell", "n", "radius", "ids", "units"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(batch.column(1))
            if held and units.shape[1] != held[0][1].shape[1]:
                raise ValueError("vectors have different sizes")
            held.append((batch.column(0).to_numpy(), units))
            size += units.nbytes
            if size >= DEALT_BYTES:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    blocks = held(rows.select("id", "v").mapInArrow(packed, "cell int, n long, radius double, ids binary, units binary"))
    size, radius = np.zeros(len(cells), np.int64), np.full(len(cells), -1.0)
    for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("r")).collect():  # a row for each cell
        size[r.cell], radius[r.cell] = r.n, r.r

    def first(units: np.ndarray, _: np.ndarray) -> np.ndarray:
        """Of the cells the nearest that together hold k vectors."""
        away = np.where(size > 0, apart(units), np.inf)
        order = np.argsort(away, axis=1)
        held_before = np.cumsum(size[order], axis=1) - size[order]
        out = np.zeros(away.shape, bool)
        np.put_along_axis(out, order, (held_before < k) & (size[order] > 0), axis=1)
        return out

    def rest(units: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The other cells that may hold one nearer than the k-th so far."""
        bound = np.sqrt(np.maximum(0.0, 2 - 2 * least))
        return (apart(units) - radius <= bound[:, None] + _SLACK) & (size > 0) & ~first(units, least)

    def visits(choose):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    part = batch.slice(at, QUERIES)
                    units, ids = _units(part.column(1)), part.column(0).to_numpy()
                    q, c = np.nonzero(choose(units, part.column(2).to_numpy()).T)[::-1]
                    found, begin = np.unique(c, return_index=True)
                    groups = np.split(q, begin[1:]) if len(found) else []
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([ids[g].astype("<i8").tobytes() for g in groups], pa.binary()), pa.array([units[g].tobytes() for g in groups], pa.binary())], ["cell", "asked", "asking"])

        return run

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, units, asked_ids, asking in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, asked_ids = (np.frombuffer(x.as_buffer(), "<i8") for x in (ids, asked_ids))
                units, asking = np.frombuffer(units.as_buffer()).reshape(len(ids), -1), np.frombuffer(asking.as_buffer()).reshape(len(asked_ids), -1)
                if units.shape[1] != asking.shape[1]:
                    raise ValueError("vectors have different sizes")
                near = np.round(asking @ units.T, PLACES)
                some = min(k, len(ids))
                edge = np.partition(near, len(ids) - some, axis=1)[:, len(ids) - some]
                q, r = np.nonzero(near >= edge[:, None])
                order = np.lexsort((ids[r], -near[q, r], q))
                q, r = q[order], r[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[place < k], r[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[q]), pa.array(ids[r]), pa.array(near[q, r])], ["query", "id", "similarity"])

    def seen(choose, least: DataFrame) -> DataFrame:
        wanted = least.select("id", "v", "least").mapInArrow(visits(choose), "cell int, asked binary, asking binary")
        # Spark guesses that the visits are few, as it knows the rows that make them only; broadcast, they pass the driver.
        pairs = blocks.hint("merge").join(wanted.hint("merge"), "cell").select("ids", "units", "asked", "asking")
        return pairs.mapInArrow(met, "query long, id long, similarity double")

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    one = asked.dropDuplicates(["id"])
    early = held(seen(first, one.withColumn("least", F.lit(-1.0))))
    kth = early.withColumn("place", place).where(F.col("place") == k).select(F.col("query"), F.col("similarity").alias("least"))
    bounded = one.join(kth, F.col("id") == F.col("query"), "left").select("id", "v", F.coalesce("least", F.lit(-1.0)).alias("least"))
    both = early.unionAll(seen(rest, bounded))
    return both.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "similarity", "place")
