"""Importance resampling: documents drawn in proportion to how like a target's texts they are.

Texts are bags of hashed runs of one to three words. A bucket's gain is the logarithm of its share in
the target over its share in the documents, a document's weight the sum of its gains. The weights
with Gumbel noise added, largest first, are a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .words import binary

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SEGMENT = 1 << 19
#: Words up to so many bytes are hashed side by side, longer ones one at a time.
_SHORT = 64
#: Rows of a block of a run, and the most ranges of scores that are merged side by side.
BLOCK, RANGES = 1024, 4096


def _crc_table() -> np.ndarray:
    """What a byte adds to a CRC-32, by its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_TABLE = _crc_table()
_SPACE = np.uint32(zlib.crc32(b" "))


def _one_zero(crc: np.ndarray) -> np.ndarray:
    return _TABLE[crc & 255] ^ (crc >> 8)


def _zeros_tables() -> tuple[np.ndarray, np.ndarray]:
    """The linear maps that n zero bytes are to a CRC-32, each as four tables of 256, for n to 63 and for 64 * 2**k."""
    out = [(np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])).ravel()]
    for _ in range(64):
        out.append(_one_zero(out[-1]))
    double = [out.pop()]
    for _ in range(31):
        x = double[-1]
        double.append(x[x & 255] ^ x[256 + (x >> 8 & 255)] ^ x[512 + (x >> 16 & 255)] ^ x[768 + (x >> 24)])
    return np.array(out).ravel(), np.array(double)


_ZEROS, _DOUBLE = _zeros_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc with n zero bytes after it; xor the CRC-32 of n bytes, it is that of both parts together."""
    at = (n & 63) * 1024
    out = _ZEROS[at + (crc & 255)] ^ _ZEROS[at + 256 + (crc >> 8 & 255)] ^ _ZEROS[at + 512 + (crc >> 16 & 255)] ^ _ZEROS[at + 768 + (crc >> 24)]
    long = np.flatnonzero(n >= 64)
    if len(long):
        for k in range(int(n[long].max() >> 6).bit_length()):
            i, t = long[n[long] >> (6 + k) & 1 == 1], _DOUBLE[k]
            x = out[i]
            out[i] = t[x & 255] ^ t[256 + (x >> 8 & 255)] ^ t[512 + (x >> 16 & 255)] ^ t[768 + (x >> 24)]
    return out


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of data from each start to its end, a column of bytes at a time."""
    size = ends - starts
    order = np.argsort(np.minimum(size, _SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    at, size = starts[order], size[order]
    long = int(np.searchsorted(-size, -_SHORT))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -j))
        crc[long:n] = _TABLE[(crc[long:n] ^ data[at[long:n] + j]) & 255] ^ (crc[long:n] >> 8)
    crc = ~crc
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def runs_of_words(texts: Iterator[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of texts, some at a time: (text, n, found).

    text has the numbers of the texts; text k has the words n[k] to n[k + 1]. found has for runs of one,
    two and three words the bucket of the run that ends with each word, `buckets` where none does. A
    text comes in several parts if it is long; words that only lead to those after them are in no part.
    """
    group: list[tuple[int, bytes, int]] = []  # number, bytes, words that only lead
    size = 0
    for i, text in enumerate(texts):
        lead, at = b"", 0
        while len(text) - at > _SEGMENT:
            data = np.frombuffer(text, np.uint8)
            end = at + _SEGMENT
            while end < len(text):  # to the next byte that is in no word
                gap = np.flatnonzero(~_WORD[_LOWER[data[end : end + 4096]]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 4096, len(text))
            part = lead + b" " + text[at:end]
            yield _buckets([(i, part, _n_words(lead))], buckets)
            lead, at = _last_two(part), end
        part = lead + b" " + text[at:] if lead else text[at:]
        if size + len(part) > _SEGMENT and group:
            yield _buckets(group, buckets)
            group, size = [], 0
        group.append((i, part, _n_words(lead)))
        size += len(part) + 1
    if group:
        yield _buckets(group, buckets)


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = _WORD[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[::2], edges[1::2]


def _n_words(text: bytes) -> int:
    return len(_edges(_LOWER[np.frombuffer(text, np.uint8)])[0])


def _last_two(text: bytes) -> bytes:
    starts, ends = _edges(_LOWER[np.frombuffer(text, np.uint8)])
    return b" ".join(text[a:b] for a, b in zip(starts[-2:], ends[-2:], strict=True))


def _buckets(group: list[tuple[int, bytes, int]], buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    data = _LOWER[np.frombuffer(b" ".join(x for _, x, _ in group), np.uint8)]
    starts, ends = _edges(data)
    offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for _, x, _ in group])))
    n = np.searchsorted(starts, offsets)
    place = np.arange(len(starts)) - np.repeat(n[:-1], np.diff(n))
    lead = np.repeat([x for _, _, x in group], np.diff(n))
    one = crcs(data, starts, ends)
    size = ends - starts
    found, crc = [one % np.uint32(buckets)], one
    for words in (2, 3):
        crc = shifted(_one_zero(crc[:-1]) ^ _SPACE, size[words - 1 :]) ^ one[words - 1 :]
        found.append(np.concatenate((np.full(min(words - 1, len(one)), buckets, np.uint32), crc % np.uint32(buckets))))
    kept = place >= lead
    for words, x in enumerate(found):
        x[place < words] = buckets
    n = np.concatenate(([0], np.cumsum(kept)))[n]
    return np.array([i for i, _, _ in group]), n, [x[kept] for x in found]


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many runs of one to three words the texts have in each bucket: one aggregation, a row for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for _, _, found in runs_of_words((x.as_py() or b"" for x in binary(batch.column(0))), buckets):
                for x in found:
                    total += np.bincount(x, minlength=buckets + 1)
        some = np.flatnonzero(total[:buckets])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counts = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """A bucket's logarithm of shares in thousandths, with one run more in each bucket."""
    s, t, buckets = float(of_docs.sum()), float(of_target.sum()), len(of_docs)
    return np.array([math.floor(1000 * math.log((float(a) + 1) * (s + buckets) / ((float(b) + 1) * (t + buckets)))) for a, b in zip(of_target, of_docs, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row; row numbers the rows."""
    buckets, kind = len(gain), docs.schema["doc_id"].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("row", "n_words", "n_features", "weight")]
    schema = T.StructType([longs[0], T.StructField("doc_id", kind), *longs[1:]])
    per = np.append(gain, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = np.zeros((3, batch.num_rows), np.int64)
            for text, n, found in runs_of_words((x.as_py() or b"" for x in binary(batch.column(2))), buckets):
                value = np.concatenate(([0], np.cumsum(sum(per[x] for x in found))))
                many = np.concatenate(([0], np.cumsum(sum((x < buckets).astype(np.int64) for x in found))))
                for out, sums in ((n_words, np.arange(len(value))), (n_features, many), (weight, value)):
                    np.add.at(out, text, sums[n[1:]] - sums[n[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n_words, n_features, weight))], schema.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Tournament:
    """The least of the heads of many blocks: a leaf for each, and in every node the leaf that wins below it."""

    def __init__(self):
        self.heads: list = [None]
        self.blocks: list = [None]
        self.win = [0, 0]
        self.free = [0]

    def _better(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x < y) else b

    def _replay(self, leaf: int) -> None:
        node = (leaf + len(self.heads)) // 2
        while node:
            left, right = 2 * node, 2 * node + 1
            size = len(self.heads)
            self.win[node] = self._better(self.win[left] if left < size else left - size, self.win[right] if right < size else right - size)
            node //= 2

    def add(self, block: list[tuple]) -> None:
        """A block of keys in order; keys are tuples, of which all that compare equal are the same row."""
        if not self.free:
            n = len(self.heads)
            self.heads += [None] * n
            self.blocks += [None] * n
            self.win = [0] * (2 * n)
            self.free = list(range(n, 2 * n))
            for leaf in range(0, 2 * n, 2):
                self._replay(leaf)
        leaf = self.free.pop()
        self.blocks[leaf] = iter(block)
        self.heads[leaf] = next(self.blocks[leaf], None)
        self._replay(leaf)

    def head(self) -> tuple | None:
        return self.heads[self.win[1] if len(self.heads) > 1 else 0]

    def take(self) -> tuple:
        leaf = self.win[1] if len(self.heads) > 1 else 0
        out = self.heads[leaf]
        self.heads[leaf] = next(self.blocks[leaf], None)
        if self.heads[leaf] is None:
            self.free.append(leaf)
        self._replay(leaf)
        return out


def _key(score: int, doc_id, row: int, *more: int) -> tuple:
    """Higher scores first, then no doc_id, smaller ones, and the order of rows."""
    return -score, doc_id is not None, doc_id, row, *more


def ranked(scored: DataFrame, draws: int, n: int, scratch: Scratch, per_range: int = 1 << 18) -> DataFrame:
    """The `draws` rows of the highest scores of scored's n rows, with their rank from 1; scored is a written table.

    Each scan partition is sorted to a run, and runs are cut into blocks. Ranges of scores are merged
    side by side: a task gets the blocks of a range in the order of their first rows and keeps those
    open whose rows come next in a tournament tree, so that it holds a block of each run at most,
    whatever the range's size. Ranges that lie behind the last draw are neither sorted nor sent, and
    the last range stops at that draw. Ranges are by quantiles of a sketch; they decide the tasks'
    sizes and nothing else. The driver gets a count for each range, RANGES at most.
    """
    names, kinds = scored.columns, scored.schema
    ranges = min(RANGES, max(1, -(-draws // per_range)))
    share = draws / n
    points = [max(0.0, 1 - share * j / ranges) for j in range(1, ranges)] + [max(0.0, 1 - share - 0.01)]
    bounds = sorted(set(scored.agg(F.percentile_approx("score", points, 10 * RANGES)).first()[0]), reverse=True)
    falling = -np.array(bounds, np.int64)  # range k has the scores from bounds[k] to bounds[k - 1], the last one the rest

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(falling, -batch.column(0).to_numpy()), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["range", "n"])

    sizes = dict(scored.select("score").mapInArrow(counted, "range long, n long").groupBy("range").agg(F.sum("n")).collect())
    base, before = {}, 0
    for k in range(len(bounds) + 1):
        if before >= draws:
            break
        base[k] = before
        before += sizes.get(k, 0)
    least = bounds[max(base)] if max(base) < len(bounds) else None
    top = scored if least is None else scored.where(F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    runs = top.sortWithinPartitions(*order)
    block = T.StructType([T.StructField("range", T.LongType()), *[kinds[c] for c in ("score", "doc_id", "row")], *[T.StructField(f"all_{c}", T.ArrayType(kinds[c].dataType)) for c in names]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.searchsorted(falling, -batch.column(names.index("score")).to_numpy())
            edges = np.union1d(np.flatnonzero(np.diff(k)) + 1, np.arange(0, batch.num_rows, BLOCK))
            first = pa.array(edges)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(edges, batch.num_rows), pa.int32()), c) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(k[edges]), *[batch.column(names.index(c)).take(first) for c in ("score", "doc_id", "row")], *lists], block.names)

    out = T.StructType([*kinds.fields, T.StructField("rank", T.LongType())])
    at = [names.index(c) for c in ("score", "doc_id", "row")]
    rest = [i for i in range(len(names)) if i not in at]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, rank, rows = None, Tournament(), 0, []

        def batch() -> pa.RecordBatch:
            found = {names[at[0]]: [-r[0] for r, _ in rows], names[at[1]]: [r[2] for r, _ in rows], names[at[2]]: [r[3] for r, _ in rows]} | {names[i]: [r[4 + j] for r, _ in rows] for j, i in enumerate(rest)}
            made = pa.RecordBatch.from_arrays([pa.array(found[c], lists[i]) for i, c in enumerate(names)] + [pa.array([k for _, k in rows], pa.int64())], out.names)
            rows.clear()
            return made

        lists: list[pa.DataType] = []
        for b in batches:
            lists = [b.schema.field(4 + i).type.value_type for i in range(len(names))]
            for i, k in enumerate(b.column(0).to_pylist()):
                first = None if k != now else _key(*[b.column(j)[i].as_py() for j in (1, 2, 3)])
                while (head := tree.head()) is not None and (first is None or head[:4] < first) and rank < draws:
                    rank += 1
                    rows.append((tree.take(), rank))
                    if len(rows) >= 8192:
                        yield batch()
                if k != now:
                    now, tree, rank = k, Tournament(), base[k]
                if rank < draws:
                    values = [b.column(4 + j)[i].as_py() for j in range(len(names))]
                    tree.add([_key(*row) for row in zip(*[values[j] for j in at], *[values[j] for j in rest], strict=True)])
        while tree.head() is not None and rank < draws:
            rank += 1
            rows.append((tree.take(), rank))
            if len(rows) >= 8192:
                yield batch()
        if rows:
            yield batch()

    blocks = runs.mapInArrow(cut, block)
    return scratch.keep(blocks.repartition(2 * len(base), "range").sortWithinPartitions("range", *order).mapInArrow(merge, out), "ranks")


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths by a hash of the id and the seed; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of docs.

    floor(percent * N / 100) of the N rows with at least least_words words are drawn, those of the
    highest scores; rank is their place, null for rows not drawn. Ties go to the smaller doc_id, a
    null one first, and then to the row that is read first. Each row is drawn by itself, so rows that
    share a doc_id have the same noise and a rank each.

    docs is scanned twice, once to count its runs of words and once to weigh them; target once. What
    goes to the driver and back to all tasks is a number for each bucket. A null text has no words; a
    row without words has weight 0. A table without rows makes none, and a target without words weighs
    by the documents' own counts. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = scratch.keep(weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    draws = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not draws:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = ranked(eligible.drop("n_words"), draws, n, scratch)
    last = drawn.where(F.col("rank") == draws).first()
    later = F.col("row") > last["row"]
    if last["doc_id"] is None:
        behind = F.col("doc_id").isNotNull() | later
    else:
        behind = F.coalesce((F.col("doc_id") > F.lit(last["doc_id"])) | ((F.col("doc_id") == F.lit(last["doc_id"])) & later), F.lit(False))
    undrawn = scored.where((F.col("n_words") < least_words) | (F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & behind))
    return drawn.select(*columns, "rank").unionAll(undrawn.select(*columns, F.lit(None).cast("long").alias("rank")))
