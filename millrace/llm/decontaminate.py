"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted-shingle similarity.

A window of a document has as many words as a benchmark item. Its similarity to the item is the sum of
the lesser counts of all shingles over the sum of the greater ones; a window of w shingles reaches the
threshold t with an item of s only if t / (1 + t) * (s + w) shingles are shared.

1. The shingles of all items go into a Bloom filter of bounded size, made by aggregation. One scan of
   the documents keeps those that somewhere are as dense in shingles of the filter as any leak is.
2. An inverted index of the items holds the shingles that fewest items share, as many of each item as
   no window at the threshold can miss all of. Joined with the kept documents' shingles, it tells which
   items a document may contain; items that share only common phrases with it never meet it.
3. For each such pair, the windows that share enough shingles are fingerprinted with 256 bits, and the
   multi-index of BLOCKS blocks compares them with the item's: two fingerprints within RADIUS bits have
   one block within RADIUS // BLOCKS bits, so the blocks find all within the radius.
4. The exact similarity of what is found decides.

At similarity 0.8, fingerprints of windows differ in 39 bits on average with a deviation of 6, so
RADIUS lies over four deviations above; a block of unrelated windows lies within 16 bits by a chance
of 4 in 100,000. That holds where no shingle repeats: a repeated one moves all sums at once. So windows and items that
repeat a shingle are not left to fingerprints; their exact similarity decides alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import batches_of_words, binary, mix, shingles

BLOCKS, RADIUS = 4, 64
#: Bits of the filter: 32 for each shingle of the benchmark within these bounds (powers of 2; 16 MiB at most).
FEWEST_BITS, MOST_BITS = 1 << 18, 1 << 27
_PROBES, _SALTS = 4, mix(np.arange(1, BLOCKS + 1, dtype=np.uint64))
_BITMAP = 32768  # positions in one bitmap of Spark's bitmap functions


def _words_column(text: pa.Array) -> list[np.ndarray]:
    out: list = [None] * len(text)
    for i, _, _, hashes in batches_of_words(binary(text)):
        out[i] = hashes.copy()
    return out


def _as_bytes(text: pa.Array) -> pa.Array:
    return pa.array([w.tobytes() if len(w) else None for w in _words_column(text)], pa.binary())


def _grams_of_items(k: int):
    """(item, gram, size, hash, n): for each item, its distinct shingles of `gram` words and their counts; size counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1), strict=True):
                hashes = np.frombuffer(words.as_buffer(), np.uint64)
                gram = min(k, len(hashes))
                grams, counts = np.unique(shingles(hashes, gram), return_counts=True)
                n, size = len(grams), len(hashes) - gram + 1
                columns = (np.full(n, item.as_py()), np.full(n, gram), np.full(n, size), grams.view(np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "gram", "size", "hash", "n"])

    return run


class Filter:
    """A Bloom filter of shingles, and how dense a leak is in them."""

    def __init__(self, bits: np.ndarray, sizes: dict[int, int], threshold: float):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)
        self.tests = {}
        for gram, least in sizes.items():
            m = max(1, floor(threshold * least))
            # A window of w shingles lacks at most (1 - share) * w of them. Of its pieces of m, the one that
            # lacks fewest lacks no more than twice its part.
            share = 2 * threshold / (1 + threshold)
            self.tests[gram] = m, floor(2 * (1 - share) * m + 1e-9)

    def has(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for p in _positions(grams):
            at = p & self.mask
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def dense(self, hashes: np.ndarray) -> bool:
        """Whether a document of these words may contain an item."""
        for gram, (m, lacks) in self.tests.items():
            if len(hashes) < gram:
                continue
            grams = shingles(hashes, gram)
            found = self.has(grams)
            n = min(m, len(grams))
            sums = np.concatenate(([0], np.cumsum(found)))
            if len(grams) >= m and int((sums[n:] - sums[:-n]).max()) >= m - lacks:
                return True
        return False


def _positions(grams: np.ndarray) -> Iterator[np.ndarray]:
    step = mix(grams ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    for j in range(_PROBES):
        yield grams + step * np.uint64(j)


def _filter_bits(grams: DataFrame, bits: int) -> np.ndarray:
    """The filter of the hashes, made by Spark a bitmap of 4 KiB at a time; no more than bits / 8 bytes come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([p & np.uint64(bits - 1) for p in _positions(batch.column(0).to_numpy().view(np.uint64))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["bit"])

    at = grams.select("hash").mapInArrow(run, "bit long")
    maps = at.groupBy(F.expr(f"bit div {_BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"bit % {_BITMAP}")).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        out[row.part * (_BITMAP // 8) : (row.part + 1) * (_BITMAP // 8)] = np.frombuffer(row.map, np.uint8)
    return out


class Benchmark:
    """A benchmark's items and their shingles as tables, and the filter of its shingles."""

    def __init__(self, benchmark: DataFrame, scratch: Scratch, k: int, threshold: float):
        self.k, self.threshold = k, threshold
        words = F.arrow_udf(_as_bytes, "binary")(F.col("text").cast("string"))
        given = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), words.alias("item_words"))
        self.items = scratch.keep(given.where("item_words is not null"), "items")
        self.grams = scratch.keep(self.items.select("item", "item_words").mapInArrow(_grams_of_items(k), "item long, gram long, size long, hash long, n long"), "grams")
        per = self.grams.groupBy("gram").agg(F.min("size").alias("least"), F.count("*").alias("n")).collect()  # k rows at most
        bits = FEWEST_BITS
        while bits < min(MOST_BITS, 32 * sum(r.n for r in per)):
            bits *= 2
        self.filter = Filter(_filter_bits(self.grams, bits), {r.gram: r.least for r in per}, threshold)

    def rare(self) -> DataFrame:
        """(gram, hash, item): of each item the shingles that fewest items share, one more than a leak may lack."""
        shared = self.grams.groupBy("gram", "hash").agg(F.count("*").alias("items"))
        order = Window.partitionBy("item").orderBy("items", "hash")
        ranked = self.grams.join(shared, ["gram", "hash"]).withColumn("before", F.sum("n").over(order) - F.col("n"))
        return ranked.where(F.col("before") <= F.col("size") - F.ceil(F.lit(self.threshold) * F.col("size") - 1e-9)).select("gram", "hash", "item")

    def near(self) -> Callable:
        """A column function from a text to the hashes of its words, null where it can contain no item.

        It is called nondeterministic so that a filter on it stays above it: pushed below, it would be
        computed once for the filter and once more for its value.
        """
        found = self.filter

        def words(text: pa.Array) -> pa.Array:
            return pa.array([w.tobytes() if len(w) and found.dense(w) else None for w in _words_column(text)], pa.binary())

        return F.arrow_udf(words, "binary").asNondeterministic()


def _hits(found: Filter):
    """(row, gram, hash) of the distinct shingles of documents that the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in zip(batch.column(0), batch.column(1), strict=True):
                hashes = np.frombuffer(words.as_buffer(), np.uint64)
                for gram in found.tests:
                    if len(hashes) >= gram:
                        grams = np.unique(shingles(hashes, gram))
                        grams = grams[found.has(grams)]
                        columns = (np.full(len(grams), row.as_py()), np.full(len(grams), gram), grams.view(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "gram", "hash"])

    return run


def fingerprints(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """BLOCKS numbers of 64 bits for each window of `width` shingles: the signs of the sums of their bits."""
    out = np.empty((len(starts), BLOCKS), np.uint64)
    for at in range(0, len(starts), 2048):
        some = starts[at : at + 2048]
        for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(some) > width) + 1):
            low, high = int(some[part[0]]), int(some[part[-1]]) + width
            raw = mix(grams[low:high, None] ^ _SALTS).view(np.uint8)
            sums = np.zeros((high - low + 1, 64 * BLOCKS), np.int32)
            np.cumsum(np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=sums[1:])
            window = some[part] - low
            out[at + part] = np.packbits(sums[window + width] > sums[window], axis=1).view(np.uint64)
    return out


def within(prints: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which fingerprints lie within RADIUS of the item's, first by the blocks."""
    apart = np.bitwise_count(prints ^ item).astype(np.int64)
    out = (apart <= RADIUS // BLOCKS).any(axis=1)
    out[out] = apart[out].sum(axis=1) <= RADIUS
    return out


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """For each of n places how many of the ranges from first to last (inclusive) cover it."""
    use = first <= last
    return np.cumsum(np.bincount(first[use], minlength=n + 1)[: n + 1] - np.bincount(last[use] + 1, minlength=n + 1)[: n + 1])[:n]


def _windows_of(hashes: np.ndarray, item: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(start, similarity) of a document's windows that reach the threshold with the item."""
    gram = min(k, len(item))
    mine, grams = shingles(item, gram), shingles(hashes, gram)
    size, width = len(mine), min(len(mine), len(grams))
    n = len(grams) - width + 1
    none = np.zeros(0, np.int64), np.zeros(0)
    known, counts = np.unique(mine, return_counts=True)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    hit = np.flatnonzero(known[at] == grams)
    sums = np.concatenate(([0], np.cumsum(np.bincount(hit, minlength=len(grams)))))
    enough = threshold / (1 + threshold) * (size + width) - 1e-9
    starts = np.flatnonzero(sums[width:] - sums[:n] >= enough)
    if not len(starts):
        return none
    # Places by shingle: the one before with the same, and the one so many before that it is one too many.
    order = np.argsort(grams, kind="stable")
    new = np.concatenate(([True], grams[order][1:] != grams[order][:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))

    def earlier(by: np.ndarray) -> np.ndarray:
        out = np.full(len(grams), -1)
        from_ = np.arange(len(order)) - by[order]
        out[order] = np.where(from_ >= begin, order[np.maximum(from_, 0)], -1)
        return out

    place = np.arange(len(grams))
    before = earlier(np.ones(len(grams), np.int64))
    again = np.flatnonzero(before >= 0)
    repeats = _covered(np.maximum(again - width + 1, 0), np.minimum(before[again], n - 1), n)[starts] > 0
    prints = fingerprints(grams, starts, width)
    found = within(prints, fingerprints(mine, np.zeros(1, np.int64), size)[0]) | repeats | bool(counts.max() > 1)
    if not found.any():
        return none
    barred = earlier(counts[at])[hit]
    first = np.maximum(np.maximum(place[hit] - width + 1, barred + 1), 0)
    both = _covered(first, np.minimum(place[hit], n - 1), n)[starts]
    similarity = both / (width + size - both)
    use = found & (similarity >= threshold)
    return starts[use], similarity[use]


def _verified(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, best, start, windows = [], [], [], []
            for i, (words, item) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                starts, similarity = _windows_of(np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(item.as_buffer(), np.uint64), k, threshold)
                if len(starts):
                    top = int(np.argmax(similarity))
                    keep.append(i)
                    best.append(float(similarity[top]))
                    start.append(int(starts[top]))
                    windows.append(len(starts))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(best, pa.float64()), pa.array(start, pa.int64()), pa.array(windows, pa.int64())], ["row", "item_id", "similarity", "start_word", "n_windows"])

    return run


def _found(near: DataFrame, items: Benchmark) -> DataFrame:
    """(row, item_id, similarity, start_word, n_windows) for the rows of near (row, words)."""
    hits = near.select("row", "words").mapInArrow(_hits(items.filter), "row long, gram long, hash long")
    pairs = hits.join(items.rare(), ["gram", "hash"]).select("row", "item").distinct()
    both = pairs.join(near.select("row", "words"), "row").join(items.items, "item").select("row", "item_id", "words", "item_words")
    return both.mapInArrow(_verified(items.k, items.threshold), "row long, item_id long, similarity double, start_word long, n_windows long")


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows) of every document that contains an item.

    An item is contained if a window of as many words (the whole document if it is shorter) has a
    weighted similarity of k-word shingles of at least threshold. One row for each document and
    item, with its best window, the earliest of equals, and the number of windows that reach it.

    Null, empty and blank texts and items contain nothing and are contained in nothing. An item of
    fewer than k words is one shingle of its own length. Repeated rows of either table give repeated
    rows. Other columns are not read. One scan of docs without a shuffle; what is written and shuffled
    are the words of documents that may contain an item. Pairs of a document and an item are
    verified one by one, so a task holds one of each.
    """
    items = Benchmark(benchmark, scratch, k, threshold)
    near = docs.select(F.col("doc_id").cast("long"), items.near()(F.col("text").cast("string")).alias("words")).where("words is not null")
    near = scratch.keep(near.withColumn("row", F.monotonically_increasing_id()), "near")
    return _found(near, items).join(near.select("row", "doc_id"), "row").select("doc_id", "item_id", "similarity", "start_word", "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item as leaks() tells it, with all their columns.

    Rows that can contain no item pass a scan and are never shuffled. The others are written once,
    and return unless an item is found in them, each row by itself whatever its doc_id. Columns may
    have any names. An empty benchmark leaves all rows.
    """
    items = Benchmark(benchmark, scratch, k, threshold)
    words = items.near()(F.col("text").cast("string"))
    near = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), words.alias("words")).where("words is not null")
    near = scratch.keep(near.withColumn("row", F.monotonically_increasing_id()), "near")
    back = near.join(_found(near, items).select("row"), "row", "left_anti").select("doc.*")
    return docs.where(words.isNull()).unionAll(back)
