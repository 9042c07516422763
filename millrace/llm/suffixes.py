"""Removal of repeated passages, exact to the byte, by blockwise suffix sorting.

Removed is every byte of a `width`-byte string that also starts earlier in the corpus (a smaller
doc_id, or an earlier place in the same document). Suffixes of the corpus are never all shuffled:

1. Every window of `width` bytes owns one of its places, the leftmost least hash of GRAM bytes in
   it. Equal windows own the same place and the same hash, so a window whose hash occurs once in the
   corpus repeats nothing. Blocks of documents send their hashes, and get back one flag for each.
2. Around each flagged place a block sends the bytes of the windows that own it, once for each
   distinct content. Copies of a whole content within the block are settled there and then.
3. Contents meet by hash in buckets. In each, a difference cover modulo 31 samples the text, and the
   samples are ranked by their bytes beforehand. Then one suffix bucket after another (the windows of some
   places) is sorted: by 32 first bytes, and where these tie by the samples' ranks, which for any two
   suffixes stand at a common distance of 30 at most, and the last bytes. Suffixes next to each other with a
   common prefix of `width` bytes are equal; the earliest of them in the corpus stays.

Places with more than `hot` copies are sent window by window, each distinct one of a block once and to a
bucket of its own hash, so a passage in a third of all documents spreads over all buckets. There they
are sorted and compared by their bytes like all others, a batch at a time against those found so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import binary, mix

GRAM, BLOCK_BYTES, SORT_BYTES = 32, 8 << 20, 4 << 20
#: Contents around so many copies of a place are some 11 MB, a small part of a bucket. Window by window they are 30 times as
#: much, so a bound that a larger corpus soon passes makes the shuffle grow faster than the corpus.
HOT = 1 << 16
#: Bytes of corpus for each bucket: what a bucket's task holds are the contents around flagged places of so much text.
BUCKET_BYTES = 128 << 20
_STEP = 1 << 16
_rng = np.random.Generator(np.random.PCG64(77))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFF)
#: A perfect difference set: every residue modulo 31 is the difference of two of its members.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: For two residues the least distance at which both have a sample; for one, the distance to its next sample.
_SHIFT = np.array([[next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)])
_NEXT = np.diagonal(_SHIFT)
_SAMPLED = np.isin(np.arange(MODULUS), COVER)
_HEAD = 32


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _restore(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _tie(text: bytes) -> int:
    """What orders documents of the same id: equal texts are alike, so reruns agree."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _blocks(block_bytes: int):
    """Documents packed into rows: ids and sizes in bytes, in order of doc_id, and the compressed text."""

    def pack(at: int, held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ranked = sorted((i is None, i or 0, _tie(x), x) for i, x in held)
        block = (TaskContext.get().partitionId() << 32) + at
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.array([[None if none else i for none, i, _, _ in ranked]], pa.list_(pa.int64())), pa.array([[len(x) for *_, x in ranked]], pa.list_(pa.int64())),
                pa.array([_squeeze(b"".join(x for *_, x in ranked))], pa.binary()), pa.array([sum(len(x) for *_, x in ranked)], pa.int64()),
            ],
            ["block", "ids", "sizes", "data", "bytes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if held and size + len(raw) > block_bytes:
                    yield pack(at, held)
                    held, size, at = [], 0, at + 1
                held.append((i, raw))
                size += len(raw)
        if held:
            yield pack(at, held)

    return run


class Anchors:
    """For each run of windows that own the same place: hash, place, first and last window start."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, width: int):
        parts = [self._step(data, ends, at, width) for at in range(0, max(len(data) - width + 1, 0), _STEP)]
        empty = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        self.hash, self.place, self.first, self.last = (np.concatenate(x) for x in zip(empty, *parts, strict=True))

    @staticmethod
    def _step(data: np.ndarray, ends: np.ndarray, at: int, width: int):
        n = min(_STEP, len(data) - width + 1 - at)
        h = _BYTE[data[at : at + n + width - 1]]
        size = 1
        while size < GRAM:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
            size *= 2
        h = mix(h)
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        size, most = 1, width - GRAM + 1
        while 2 * size <= most:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if most > size:
            least = np.minimum(least[: size - most], least[most - size :])
        own = (least & _LOW).astype(np.int64)
        whole = np.ones(n, bool)
        for end in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + width, "left") + 1]:
            whole[max(0, end - width + 1 - at) : max(0, end - at)] = False
        starts = np.flatnonzero(whole)
        if not len(starts):
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        cut = np.flatnonzero((own[starts[1:]] != own[starts[:-1]]) | (np.diff(starts) > 1)) + 1
        first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
        return h[own[first]], own[first] + at, first + at, last + at

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes sorted by bucket, each anchor's index among them, copies, and the buckets' bounds."""
        distinct, index, copies = np.unique(self.hash, return_inverse=True, return_counts=True)
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return distinct[order], back[index], copies[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _open(row_ids, row_sizes, row_data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([np.iinfo(np.int64).max if x is None else x for x in row_ids.as_py()], np.int64)
    sizes = np.array(row_sizes.as_py(), np.int64)
    data = np.frombuffer(_restore(row_data.as_buffer()), np.uint8)
    ends = np.cumsum(sizes)
    return ids, ends - sizes, ends, data


def _send_hashes(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, data in zip(*batch.columns, strict=True):
                _, _, ends, text = _open(ids, sizes, data)
                hashes, _, copies, bounds = Anchors(text, ends, width).by_bucket(buckets)
                full = np.flatnonzero(np.diff(bounds))
                cut = [slice(bounds[b], bounds[b + 1]) for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block.as_py()] * len(full), pa.int64()), pa.array([hashes[c].tobytes() for c in cut], pa.binary()), pa.array([np.minimum(copies[c], 65535).astype(np.uint16).tobytes() for c in cut], pa.binary())],
                    ["bucket", "block", "hashes", "copies"],
                )

    return run


def _flag(hot: int):
    """For each hash of a bucket's rows: 0 alone in the corpus, 1 repeated, 2 repeated over `hot` times."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        copies = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["copies"]]).astype(np.int64)
        _, index = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(index, copies)[index]
        flags = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
        cuts = np.cumsum([len(x) for x in hashes])[:-1]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "flags": [_squeeze(x.tobytes()) for x in np.split(flags, cuts)]})

    return run


_RECORD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("block", "<i8"), ("at", "<i4"), ("place", "<i8"), ("left", "<i4"), ("windows", "<i4")])
_SPAN = np.dtype([("at", "<i4"), ("first", "<i8"), ("end", "<i8")])


def _corpus_order(records: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of np.lexsort: the document, then the place in it."""
    return records["place"], records["at"], records["block"], records["tie"], records["doc"]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges of so many places, and the range each is of."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def _send_contents(width: int, buckets: int):
    """Rows (kind, bucket, block, data): 0 the spans settled here, 1 contents around places, 2 windows of hot places."""

    def packed(kind: int, block: int, records: np.ndarray, contents: list[bytes]):
        bucket = (records["hash"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                yield kind, int(bucket[part[0]]), block, _squeeze(len(part).to_bytes(8, "little") + records[part].tobytes() + b"".join(contents[i] for i in part.tolist()))

    def of_block(block: int, ids, starts, ends, text: np.ndarray, flags: dict[int, bytes]):
        anchors = Anchors(text, ends, width)
        hashes, index, _, bounds = anchors.by_bucket(buckets)
        flag = np.zeros(len(hashes), np.uint8)
        for b, x in flags.items():
            flag[bounds[b] : bounds[b + 1]] = np.frombuffer(_restore(x), np.uint8)
        flag = flag[index]
        raw = text.tobytes()
        ties: dict[int, int] = {}

        def records(docs: np.ndarray, first: np.ndarray) -> np.ndarray:
            out = np.zeros(len(docs), _RECORD)
            for d in np.unique(docs).tolist():
                if d not in ties:
                    ties[d] = _tie(raw[starts[d] : ends[d]])
            out["at"], out["block"], out["doc"] = docs, block, ids[docs]
            out["tie"] = [ties[d] for d in docs.tolist()]
            out["place"] = first - starts[docs]
            return out

        spans: list[np.ndarray] = []
        found = np.flatnonzero(flag == 1)
        docs = np.searchsorted(ends, anchors.first[found], "right")
        seen: set[tuple[int, bytes]] = set()
        keep, contents, again = [], [], []
        for n, place, first, last in zip(range(len(found)), anchors.place[found].tolist(), anchors.first[found].tolist(), anchors.last[found].tolist(), strict=True):
            content = raw[first : last + width]
            key = (place - first, content)
            if key in seen:
                again.append(n)
            else:
                seen.add(key)
                keep.append(n)
                contents.append(content)
        gone = found[again]
        spans.append(_spans(docs[again], anchors.first[gone] - starts[docs[again]], anchors.last[gone] + width - starts[docs[again]]))
        at = found[keep]
        out = records(docs[keep], anchors.first[at])
        out["hash"], out["left"], out["windows"] = anchors.hash[at], anchors.place[at] - anchors.first[at], anchors.last[at] - anchors.first[at] + 1
        yield from packed(1, block, out, contents)

        hot = np.flatnonzero(flag == 2)
        place, _ = _spread(anchors.first[hot], anchors.last[hot] - anchors.first[hot] + 1)
        if len(place):
            space = np.concatenate((text, np.zeros(8, np.uint8)))
            digest = _hash_of(space, place, width)
            docs = np.searchsorted(ends, place, "right")
            order = np.argsort(digest, kind="stable")
            same = np.concatenate(([False], digest[order][1:] == digest[order][:-1]))
            head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            same &= _equal(space, place[head], place[order], width)
            gone, keep = order[same], np.sort(order[~same])
            spans.append(_spans(docs[gone], place[gone] - starts[docs[gone]], place[gone] - starts[docs[gone]] + width))
            out = records(docs[keep], place[keep])
            out["hash"], out["windows"] = digest[keep], 1
            yield from packed(2, block, out, [raw[p : p + width] for p in place[keep].tolist()])
        all_spans = np.concatenate(spans)
        if len(all_spans):
            yield 0, 0, block, _squeeze(_united(all_spans).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, data, flags in zip(*batch.columns, strict=True):
                given = {x["bucket"]: x["flags"] for x in flags.as_py() or []}
                rows = list(of_block(block.as_py(), *_open(ids, sizes, data), given))
                kinds, numbers, blocks, blobs = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "bucket", "block", "data"])

    return run


def _spans(at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), _SPAN)
    out["at"], out["first"], out["end"] = at, first, end
    return out


def _steps(start: int, end: int) -> list[int]:
    """Where to read words that cover the bytes from start to end, at least eight."""
    return [*range(start, end - 8, 8), end - 8]


def _hash_of(text: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    words, out = _words(text), np.zeros(len(places), np.uint64)
    for j in _steps(0, width):
        out = (out ^ words[places + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return mix(out)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    words, out = _words(text), np.ones(len(a), bool)
    for j in _steps(0, width):
        out &= words[a + j] == words[b + j]
    return out


def _united(spans: np.ndarray) -> np.ndarray:
    """The same bytes in as few spans as possible."""
    spans = spans[np.lexsort((spans["first"], spans["at"]))]
    if len(spans) < 2:
        return spans
    lift = spans["at"].astype(np.int64) * (int(spans["end"].max()) + 2)
    reach = np.maximum.accumulate(spans["end"] + lift)
    new = np.concatenate(([True], (spans["first"] + lift)[1:] > reach[:-1]))
    out = spans[new]
    out["end"] = np.concatenate((reach[:-1][new[1:]], reach[-1:])) - lift[new]
    return out


class Ranks:
    """Ranks of the samples of a text at a difference cover, by the bytes from each of them: `width` less
    the largest distance between a suffix and its sample, so that no rank looks beyond a suffix's width."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, width: int):
        self.words, self.width = _words(text), width
        near = np.zeros(len(text) + 1, np.int32)
        np.add.at(near, starts, 1)
        np.add.at(near, np.minimum(starts + MODULUS, len(text)), -1)
        samples = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        samples = samples[_SAMPLED[samples % MODULUS]]
        columns = [self.words[samples + j].astype(np.uint64) for j in _steps(0, width - MODULUS + 1)]
        order = np.lexsort(columns[::-1])
        differs = np.zeros(len(samples), bool)
        for c in columns:
            differs[1:] |= c[order][1:] != c[order][:-1]
        self.at = np.zeros(len(text), np.int32)
        self.at[samples[order]] = np.cumsum(differs)
        self.tails = _steps(width - MODULUS + 1, width)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for pairs of suffixes with equal first _HEAD bytes."""
        shift = _SHIFT[a % MODULUS, b % MODULUS]
        x, y = self.at[a + shift], self.at[b + shift]
        out = (x > y).astype(np.int8) - (x < y)
        for j in self.tails:
            x, y = self.words[a + j], self.words[b + j]
            out = np.where(out == 0, (x > y).astype(np.int8) - (x < y), out)
        return out


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `starts` by their first `width` bytes, equal ones as they are given,
    and which of them, in that order, have those bytes in common with the one before.

    text must go on for width + 8 bytes after each start. Suffixes with the same first bytes and the same
    residue modulo 31 are ordered by the rank of the sample at the same distance from both. Where suffixes
    of several residues tie, each residue's run is merged with the next by binary searches that compare
    any two suffixes at the distance at which both have a sample.
    """
    if not len(starts):
        return starts, np.zeros(0, bool)
    ranks = Ranks(text, starts, width)
    heads = [ranks.words[starts + j].astype(np.uint64) for j in range(0, _HEAD, 8)]
    tails = [ranks.words[starts + j].astype(np.uint64) for j in ranks.tails]
    residue = starts % MODULUS
    order = np.lexsort((*tails[::-1], ranks.at[starts + _NEXT[residue]], residue, *heads[::-1]))
    tied = np.ones(len(order), bool)
    tied[0] = False
    for h in heads:
        tied[1:] &= h[order][1:] == h[order][:-1]
    order = _merged(ranks, starts, order, tied)
    equal = np.zeros(len(order), bool)
    at = np.flatnonzero(tied)
    equal[at] = ranks.compare(starts[order[at - 1]], starts[order[at]]) == 0
    return order, equal


def _merged(ranks: Ranks, starts: np.ndarray, order: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """order, with the runs of a residue each merged within groups of tied suffixes."""
    group = np.cumsum(~tied)
    residue = starts[order] % MODULUS
    new = ~tied | np.concatenate(([True], residue[1:] != residue[:-1]))  # where a run begins
    while True:
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(order))
        of_group = group[begins]
        number = np.arange(len(begins)) - np.searchsorted(of_group, of_group)
        left = np.flatnonzero((number % 2 == 0) & np.append(of_group[1:] == of_group[:-1], False))
        if not len(left):
            return order
        out = order.copy()
        moved = []
        for mine, other, ties_first in ((left, left + 1, True), (left + 1, left, False)):
            at, owner = _spread(begins[mine], (ends - begins)[mine])
            low, high = begins[other][owner].copy(), ends[other][owner].copy()
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                sign = ranks.compare(starts[order[middle]], starts[order[at[open_]]])
                before = sign < 0 if ties_first else sign <= 0
                low[open_[before]] = middle[before] + 1
                high[open_[~before]] = middle[~before]
            moved.append((at, at - begins[mine][owner] + low - begins[other][owner] + begins[left][owner]))
        for at, to in moved:
            out[to] = order[at]
        order = out
        new[begins[left + 1]] = False


def _laid_out(left: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Where each content begins in a bucket's text so that its place is a multiple of MODULUS, as equal
    windows then have equal residues; and the size of the text."""
    before = -(-left // MODULUS) * MODULUS
    room = before + -(-(sizes - left) // MODULUS) * MODULUS
    ends = np.cumsum(room)
    return ends - room + before - left, int(ends[-1] if len(ends) else 0) + width + 8


def _repeated(records: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, window in it) of every window that equals an earlier one, the contents being in corpus order."""
    sizes = records["windows"].astype(np.int64) + width - 1
    begins, size = _laid_out(records["left"].astype(np.int64), sizes, width)
    text = np.zeros(size, np.uint8)
    to, _ = _spread(begins, sizes)
    text[to] = np.frombuffer(b"".join(texts), np.uint8)
    starts, owner = _spread(begins, records["windows"].astype(np.int64))
    digest = _hash_of(text, starts, width)
    ordered = np.sort(digest)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return owner[:0], starts[:0]
    mine = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, digest), len(twice) - 1)] == digest)  # others repeat nothing
    order, equal = sorted_suffixes(text, starts[mine], width)
    again = mine[order[equal]]
    return owner[again], starts[again] - begins[owner[again]]


def _unpacked(blobs: Iterable[bytes], width: int) -> tuple[np.ndarray, list[bytes]]:
    records, texts = [], []
    for blob in blobs:
        raw = _restore(blob)
        n = int.from_bytes(raw[:8], "little")
        part = np.frombuffer(raw, _RECORD, n, 8)
        cuts = np.cumsum(part["windows"].astype(np.int64) + width - 1) + 8 + n * _RECORD.itemsize
        records.append(part)
        texts += [raw[a:b] for a, b in zip([8 + n * _RECORD.itemsize, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
    return np.concatenate(records) if records else np.zeros(0, _RECORD), texts


def _settled(blobs: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(blocks, spans) of what repeats among contents around places: one suffix bucket of about
    SORT_BYTES after another, all contents of a place in the same."""
    records, texts = _unpacked(blobs, width)
    order = np.lexsort((*_corpus_order(records), records["hash"]))
    records = records[order]
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(records["hash"])) + 1, [len(records)]))
    held, size = [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            held += range(a, b)
            size += sum(len(texts[order[i]]) for i in range(a, b))
        if held and (size > SORT_BYTES or b == len(records)):
            yield from _of_places(records[held], [texts[order[i]] for i in held], width)
            held, size = [], 0
    if held:
        yield from _of_places(records[held], [texts[order[i]] for i in held], width)


def _of_places(records: np.ndarray, texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    seen, keep, gone = set(), [], []  # copies of a whole content first
    for i, key in enumerate(zip(records["hash"].tolist(), records["left"].tolist(), texts, strict=True)):
        (gone if key in seen else keep).append(i)
        seen.add(key)
    out = records[gone]
    yield out["block"], _spans(out["at"], out["place"], out["place"] + out["windows"] - 1 + width)
    in_order = np.lexsort(_corpus_order(records[keep]))
    records, texts = records[keep][in_order], [texts[keep[i]] for i in in_order.tolist()]
    owner, step = _repeated(records, texts, width)
    hit = records[owner]
    yield hit["block"], _spans(hit["at"], hit["place"] + step, hit["place"] + step + width)


def _settled_hot(blobs: Iterable[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _settled(), for single windows: a batch at a time with the earliest of each found so far."""
    records, texts = np.zeros(0, _RECORD), []
    held, size = [], 0

    def settle():
        nonlocal records, texts
        more, added = _unpacked(held, width)
        records, texts = np.concatenate((records, more)), texts + added
        order = np.lexsort(_corpus_order(records))
        records, texts = records[order], [texts[i] for i in order.tolist()]
        owner, _ = _repeated(records, texts, width)
        hit = records[owner]
        keep = np.setdiff1d(np.arange(len(records)), owner)
        records, texts = records[keep], [texts[i] for i in keep.tolist()]
        return hit["block"], _spans(hit["at"], hit["place"], hit["place"] + width)

    for blob in blobs:
        held.append(blob)
        size += zstandard.frame_content_size(blob)
        if size > SORT_BYTES:
            yield settle()
            held, size = [], 0
    if held:
        yield settle()


def _sort_buckets(width: int):
    """Rows (block, data) of the spans that repeat, from rows of contents in order of kind and bucket."""

    def spans_of(kind: int, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, _SPAN)), *(_settled(list(blobs), width) if kind == 1 else _settled_hot(blobs, width))]
        blocks, found = np.concatenate([b for b, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.argsort(blocks, kind="stable")
        blocks, found = blocks[order], found[order]
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(blocks[np.concatenate(([0], cuts))], pa.int64()), pa.array([_squeeze(_united(x).tobytes()) for x in np.split(found, cuts)], pa.binary())], ["block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k.as_py(), b.as_py(), d.as_buffer().to_pybytes()) for batch in batches for k, b, d in zip(*batch.columns, strict=True))
        for (kind, _), same in groupby(rows, key=lambda r: r[:2]):
            yield from spans_of(kind, (d for _, _, d in same))

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, row_ids, sizes, data, found in zip(*batch.columns, strict=True):
            _, starts, ends, text = _open(row_ids, sizes, data)
            change = np.zeros(len(text) + 1, np.int32)
            for x in found.as_py() or []:
                spans = np.frombuffer(_restore(x), _SPAN)
                np.add.at(change, spans["first"] + starts[spans["at"]], 1)
                np.add.at(change, spans["end"] + starts[spans["at"]], -1)
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            kept, removed, runs = [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                mask = gone[a:b]
                n = int(np.count_nonzero(mask))
                removed.append(n)
                runs.append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if n else 0)
                kept.append(text[a:b][~mask].tobytes() if n else text[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_ids.as_py(), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(docs: DataFrame, scratch: Scratch, width: int = 100, hot: int = HOT, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per row of docs; kept is the remaining bytes.

    n_spans counts the maximal removed runs. Null and empty texts have no bytes and lose none; texts
    under `width` bytes lose none. Rows with the same doc_id are separate documents, in an order by a
    hash of their texts; a null doc_id comes after all others. Other columns are not read. kept may
    end within a code point of UTF-8, as matches are of bytes. width is at least 100.
    """
    if width < 100:
        raise ValueError("width must be at least 100")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    packed = source.mapInArrow(_blocks(BLOCK_BYTES), "block long, ids array<long>, sizes array<long>, data binary, bytes long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.keep_bucketed(packed, "blocks", "block", parts)  # both joins on block leave the texts where they are
    buckets = max(parts, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes))
    hashes = blocks.select("block", "ids", "sizes", "data").mapInArrow(_send_hashes(width, buckets), "bucket int, block long, hashes binary, copies binary")
    flags = hashes.groupBy("bucket").applyInPandas(_flag(hot), "block long, bucket int, flags binary")
    flags = flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    sent = blocks.join(flags, "block", "left").select("block", "ids", "sizes", "data", "flags")
    sent = scratch.keep(sent.mapInArrow(_send_contents(width, buckets), "kind int, bucket int, block long, data binary"), "contents")
    met = sent.where("kind > 0").select("kind", "bucket", "data").repartition(buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    spans = met.mapInArrow(_sort_buckets(width), "block long, data binary")
    spans = spans.union(sent.where("kind = 0").select("block", "data")).groupBy("block").agg(F.collect_list("data").alias("spans"))
    return blocks.join(spans, "block", "left").select("block", "ids", "sizes", "data", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
