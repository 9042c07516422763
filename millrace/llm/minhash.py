"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch follows Dahlgaard, Knudsen and Thorup (Fast Similarity Sketching, 2017). In round i every
shingle is thrown into one of t bins with the value i + h; a bin keeps its least value. Rounds t to
2t - 1 throw every shingle into bin i - t, so that no coordinate of a non-empty set stays empty. Two
sets agree in a coordinate with a probability of their Jaccard similarity, and the agreements are
concentrated as those of independent minimums are. Most sets need two or three rounds.

128 coordinates in 32 bands of 4: a pair of similarity 0.8 shares no band with probability
(1 - 0.8**4)**32 = 5e-8, a pair of 0.9 with 1e-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .words import batches_of_words, binary, distinct, mix, shingles

BINS, BANDS = 128, 32
#: Members of a rare shingle's bucket whose pairs are looked at one by one; members and shingles of a chunk
#: of a larger one, two of which meet in one task.
FEW, CHUNK, CHUNK_ITEMS = 32, 256, 1 << 20
#: Cells in which shingles are counted, to order them by rarity.
CELLS = 1 << 20
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(2**64 - 1)


def sketch(items: np.ndarray) -> np.ndarray:
    """The t coordinates of a non-empty set of 64-bit hashes."""
    bins = np.full(BINS, _EMPTY)
    n, at = len(items), 0
    shift, mask = np.uint64(57), np.uint64(2**48 - 1)
    while at < BINS and (at == 0 or (bins == _EMPTY).any()):
        rounds = min(BINS - at, max(1, 2 * BINS // n))  # more than needed change nothing: their values are larger
        h = mix(items[None, :] ^ _SEEDS[at : at + rounds, None])
        value = (h & mask) | (np.arange(at, at + rounds, dtype=np.uint64)[:, None] << np.uint64(48))
        np.minimum.at(bins, (h >> shift).ravel(), value.ravel())
        at += rounds
    for b in np.flatnonzero(bins == _EMPTY):
        bins[b] = (mix(items ^ _SEEDS[BINS + b]) & mask).min() | np.uint64((BINS + b) << 48)
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    rows = bins.reshape(BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for j in range(rows.shape[1]):
        key = mix(key ^ rows[:, j])
    return key.view(np.int64)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), [[], [], [], []]
            for i, _, _, hashes in batches_of_words(binary(batch.column(1))):
                items = distinct(shingles(hashes, k))
                out[0].append(i)
                out[1].append(len(items))
                out[2].append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                out[3].append(band_keys(sketch(items)) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "bands"],
            )

    return run


_FEATURES = "doc_id long, n long, digest binary, bands array<long>"


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _features, of sets that are there already."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        bands = [band_keys(sketch(x)) if len(x) else None for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "bands"])


def _unions(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(id, items): the union of the sets of each id's rows. Shingles are made distinct by (id, shingle)
    first, so that an id of very many rows is no burden; what is gathered is a document's own set."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sets(k)(batches):
            for i in range(batch.num_rows):
                items = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                for at in range(0, max(len(items), 1), 1 << 16):  # an empty set is a null item
                    part = pa.array(items[at : at + (1 << 16)]) if len(items) else pa.array([None], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(part), pa.int64()), part], ["id", "item"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(x.values.to_numpy().astype(np.int64).view(np.uint64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "items"])

    items = rows.select("doc_id", "text").mapInArrow(exploded, "id long, item long").distinct()
    return scratch.keep(items.groupBy("id").agg(F.collect_list("item").alias("items")).mapInArrow(packed, "id long, items binary"), "unions")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, sets = [], []
            for i, _, _, hashes in batches_of_words(binary(batch.column(1))):
                where.append(i)
                sets.append(distinct(shingles(hashes, k)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(sets, pa.binary())], ["id", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                merged = np.sort(np.concatenate((x, y)))
                both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    A document's set holds its distinct k-word shingles (the whole sequence as one if it has fewer
    words); documents are linked when 100 * intersection >= percent * union, and share a component
    when a chain of links joins them. component_id is the component's smallest doc_id.

    Null, empty and blank texts have an empty set and are linked with nothing. A null doc_id is
    dropped from the linking and gets a null component. Rows with the same doc_id are one document: its
    set is the union of theirs, and its row comes as often as they do. Other columns of docs are not read.

    Shingles are told apart by 64-bit hashes: the chance that two of a million different ones of a pair of
    documents meet is 3e-8, and a link would change by it only if the pair is within a shingle of the bound.

    Equal sets form one class (a grouping combined before its shuffle), so a text copied into a
    third of the rows costs one candidate. Within a band's bucket a first pass compares every class
    with one pivot, and a second pass compares those that it left unconnected with another; links so
    found are joined into components. Members of buckets that still hold several components meet by the
    rarest shingles of their sets: two linked sets share one of the n - ceil(percent% of n) + 1 rarest
    of either, in any order of all shingles. So members that share only what is common, however many a
    bucket has of them, never meet. Buckets of a rare shingle that are large all the same are compared
    in chunks bounded by members and bytes, which emit one link at most for each member.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    feats = scratch.keep(source.mapInArrow(_features(k), _FEATURES), "minhash")
    again = scratch.keep(feats.groupBy("doc_id").count().where("doc_id is not null and count > 1"), "again")
    unions = None if again.isEmpty() else _unions(source.join(again, "doc_id"), k, scratch)
    if unions is not None:
        merged = unions.select("id", "items").mapInArrow(_of_items, _FEATURES)
        feats = scratch.keep(feats.join(again, "doc_id", "left_anti").unionAll(merged.select("doc_id", "n", "digest", "bands")), "minhash")
    classes = (
        feats.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.count("*").alias("copies"))
    )
    bands = (
        feats.where("digest is not null and doc_id is not null")
        .join(classes.select("digest", "id"), "digest")
        .where("doc_id = id")
        .select("id", "n", F.explode("bands").alias("key"))
    )
    bands = scratch.keep(bands, "bands")
    order = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"), F.col("n").alias("n"))
    pivots = bands.groupBy("key").agg(F.count("*").alias("members"), F.min(order).alias("p")).where("members > 1")
    shared = scratch.keep(bands.join(pivots, "key").select("key", "id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n")), "buckets")
    scratch.drop(bands)
    fits = f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)"
    first = scratch.keep(_ordered(shared.where(f"id != pivot and {fits}"), "id", "pivot"), "pairs")

    wanted = shared.select("id").distinct()
    sets = source.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi")
    if unions is not None:
        sets = sets.join(unions.select("id"), "id", "left_anti")
    sets = sets.mapInArrow(_sets(k), "id long, items binary")
    sets = scratch.keep(sets if unions is None else sets.unionAll(unions.join(wanted, "id", "left_semi")), "sets")
    links = found = scratch.keep(_confirmed(first, sets, percent), "links")

    labels = scratch.keep(components(links, scratch), "labels")
    rest = scratch.keep(_unsettled(shared.select("key", "id", "n"), labels), "rest")
    other = F.struct(F.xxhash64("key", "id").alias("h"), F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("c").alias("pivot_c"))
    second = rest.join(rest.groupBy("key").agg(F.min(other).alias("p")), "key").select("id", "n", "c", "p.*").where(f"c != pivot_c and {fits}")
    second = scratch.keep(_ordered(second, "id", "pivot").join(first, ["a", "b"], "left_anti"), "pairs")
    more = scratch.keep(_confirmed(second, sets, percent), "links")
    links = links.union(more)
    if not more.isEmpty():
        scratch.drop(labels)
        labels = scratch.keep(components(links, scratch), "labels")
        rest = scratch.keep(_unsettled(rest.select("key", "id", "n"), labels), "rest")
    last = _by_rare_shingles(rest.select("id", "c").distinct(), sets, percent, scratch)
    final = labels if last is None or last.isEmpty() else scratch.keep(components(links.union(last), scratch), "labels")
    scratch.drop(shared, first, second, sets, rest, found, more, *([last] if last is not None else []), *([labels] if final is not labels else []))
    named = classes.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = feats.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if unions is not None:
        copies = again.select("doc_id", F.expr("explode(sequence(1, cast(count as int)))").alias("copy"))
        out = out.join(copies, "doc_id", "left").drop("copy")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, n, c) of the buckets with members of several components; c is a member's component."""
    state = members.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    several = state.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key")
    return state.join(several, "key")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each cell, the cells in parts."""
    counts = np.zeros(CELLS, np.uint32)
    for batch in batches:
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)]
        if items:
            counts += np.bincount(_cells(np.concatenate(items)), minlength=CELLS).astype(np.uint32)
    parts = counts.reshape(-1, 4096)
    full = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zstandard.compress(parts[i].tobytes()) for i in full.tolist()], pa.binary())], ["part", "counts"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zstandard.decompress(x), np.uint32) for x in rows["counts"])
    return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.astype(np.uint32).tobytes()]})


def _cells(items: np.ndarray) -> np.ndarray:
    return (items & np.uint64(CELLS - 1)).astype(np.int64)


def _rarest(counts: np.ndarray, percent: int):
    """(item, id, c, n, place): the rarest shingles of each set, as many as a linked set cannot miss all of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for items in batch.column(2):
                items = np.frombuffer(items.as_buffer(), np.uint64)
                rarity = counts[_cells(items)]
                k = len(items) + (-percent * len(items)) // 100 + 1
                edge = np.partition(rarity, k - 1)[k - 1]
                some = np.flatnonzero(rarity <= edge)
                found.append(items[some[np.lexsort((items[some], rarity[some]))[:k]]])
            sizes = np.array([len(x) for x in found], np.int64)
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            n = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)], np.int64)
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            every = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(n, sizes)), pa.array(place)], ["item", "id", "c", "n", "place"])

    return run


def _by_rare_shingles(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """(a, b): links between members (id, c) of different components; all of them, or enough to join what is linked.

    Shingles are ordered by how often their cell of CELLS is met in the members' sets, a table of
    bounded size that every task gets, and then by themselves.
    """
    mine = scratch.keep(members.join(sets, "id").select("id", "c", "items"), "members")
    parts = mine.select("items").mapInArrow(_counted, "part int, counts binary").groupBy("part").applyInPandas(_summed, "part int, counts binary")
    counts, some = np.zeros((CELLS // 4096, 4096), np.uint32), False
    for row in parts.toLocalIterator():  # CELLS numbers at most
        counts[row.part], some = np.frombuffer(row.counts, np.uint32), True
    if not some:
        return None
    rare = scratch.keep(mine.mapInArrow(_rarest(counts.reshape(-1), percent), "item long, id long, c long, n long, place long"), "rare")
    chunks = F.expr(f"cast(ceil(greatest(count(*) / {CHUNK}, sum(n) / {CHUNK_ITEMS})) as int)")
    shared = rare.groupBy("item").agg(F.count("*").alias("m"), chunks.alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("item", "m", "k")
    met = scratch.keep(rare.join(shared, "item"), "met")
    few = met.where(f"m <= {FEW}")
    pairs = few.alias("x").join(few.alias("y"), "item").where("x.id < y.id and x.c != y.c")
    pairs = pairs.where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    # The first shingle that two sets share leaves no more to share than what comes after it in either.
    pairs = pairs.where(f"{100 + percent} * least(x.n - x.place, y.n - y.place) >= {percent} * (x.n + y.n)")
    pairs = scratch.keep(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "pairs")
    links = _confirmed(pairs, mine.select("id", "items"), percent)
    many = _in_chunks(met.where(f"m > {FEW}"), mine.select("id", "items"), percent)
    links = scratch.keep(links.union(many), "links")
    scratch.drop(mine, rare, met, pairs)
    return links


def _in_chunks(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components that share a large bucket of a rare shingle: its
    members are dealt into k chunks, and each two chunks meet in one task."""
    dealt = met.select("item", "id", "c", "k").withColumn("chunk", F.expr("cast(pmod(xxhash64(id), k) as int)"))
    both = dealt.selectExpr("item", "id", "c", "chunk", "explode(sequence(0, k - 1)) as z").selectExpr("item", "id", "c", "least(chunk, z) as x", "greatest(chunk, z) as y")
    return both.join(sets, "id").groupBy("item", "x", "y").applyInPandas(_spanning(percent), "a long, b long")


def _spanning(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, labels = rows["id"].to_numpy(), rows["c"].to_numpy().copy()
        if len(np.unique(labels)) < 2:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        sizes = np.array([len(x) for x in items])
        owner = np.repeat(np.arange(len(items)), sizes)
        _, column, uses = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        shared = uses[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(items), len(items)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(items), 4096), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
        out = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            if labels[i] != labels[j]:
                out.append((ids[i], ids[j]))
                labels[labels == labels[j]] = labels[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def one_of_each(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents less every near copy of one with a smaller doc_id in its component; all columns.

    Rows that share a doc_id are one document and stay or go together; a null doc_id stays.
    """
    found = near_duplicates(docs, scratch, k, percent)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
