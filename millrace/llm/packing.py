"""Packing documents into sequences of tokens, in their order, by dynamic programming.

The documents of a scan partition are one stream of tokens. It is cut into sequences of at most
`length` tokens at the ends of documents and sentences, so that padding plus the penalties of cuts
within documents is least. As the cost of a sequence is `length` less its tokens, the best start of
a sequence that ends at a place is the least (cost so far + place) of the places before it that are
near enough: the front of a monotone queue.
"""

from __future__ import annotations

import functools
import re
import struct
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import binary

#: Cost of a cut in tokens of padding: at a sentence's end, and elsewhere in a document.
SENTENCE, INSIDE = 1.0, 16.0
#: Cost of a sequence, so that there are few of them.
EACH = 8.0
#: A stretch without an end of a sentence may be cut every so many tokens.
STEP = 64
#: Tokens that are cut at a time, and the most that wait for a cut that all ways have in common.
BLOCK, MOST = 1 << 20, 1 << 23
#: The highest bit of an id marks the last token of a sentence.
_MARK = np.uint32(1 << 31)
_SENTENCE_END = re.compile(rb"(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82)(?:[\"')\]]|\xe2\x80[\x99\x9d]|\xc2\xbb)*\Z")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_PART = 1 << 20


#: Lower-case letters of ASCII and Latin-1, which are in normal form whatever follows but a
#: combining mark, and ASCII marks but the apostrophe: one pre-token each.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in own else next(rest) for b in range(256)}


class Encoder:
    """A text's ids as little-endian 32-bit words, by a tokenizer file.

    The file must lower-case, drop white space, and have no rule that sees across it; then the ids of
    a text are those of its words, which are remembered. Once the words take half of most_bytes they
    are the old ones; old words that come again are kept, the others go.
    """

    def __init__(self, path: str, most_bytes: int = 256 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}
        self.size, self.most = 0, most_bytes // 2

    def _plain(self, part: bytes) -> bytes:
        """The ids of letters or marks that are one pre-token; no rule before the model changes them."""
        text = part.decode() if part.isascii() else part.decode("latin-1").translate(self.letters)
        found = self.model.tokenize(text)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _learn(self, words: list[bytes]) -> None:
        if self.size > self.most:
            self.known, self.old, self.marks, self.size = {}, self.known, {}, 0
        known, old, seen, others, size = self.known, self.old, self.marks, [], 0
        for w in set(words):
            if w in known:
                continue
            ids = old.get(w)
            if ids is None:
                if not (m := _PLAIN.fullmatch(w)):
                    others.append(w)
                    continue
                stem, marks = m.groups()
                ids = b""
                if stem:
                    ids = known.get(stem) or old.get(stem)
                    if ids is None:
                        known[stem] = ids = self._plain(stem)
                        size += len(stem) + len(ids) + 150
                if marks:
                    end = seen.get(marks)
                    if end is None:
                        seen[marks] = end = self._ended(marks, self._plain(marks))
                        size += len(marks) + len(end) + 150
                    ids += end
            known[w] = ids
            size += len(w) + len(ids) + 150
        for w, e in zip(others, self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False), strict=True):
            known[w] = ids = self._ended(w, struct.pack(f"<{len(e.ids)}I", *e.ids))
            size += len(w) + len(ids) + 150
        self.size += size

    @staticmethod
    def _ended(word: bytes, ids: bytes) -> bytes:
        return ids[:-1] + bytes([ids[-1] | 0x80]) if ids and _SENTENCE_END.search(word) else ids

    def marked(self, text: bytes) -> bytes:
        """The ids, each with its highest bit set if a sentence ends with it."""
        if b"<|" not in text:  # names of special tokens are told by case
            text = text.lower()
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if at + _PART < end and (gap := _GAP.search(text, at + _PART)):
                end = gap.start()
            words = text[at:end].split()
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                self._learn(words)
                out.append(b"".join(map(self.known.__getitem__, words)))
            at = end
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process: its tasks go on with the words that earlier ones have learned."""
    return Encoder(path)


def places(sentence: np.ndarray, document: np.ndarray, n: int, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where n tokens may be cut, 0 first, and the penalty of each place.

    sentence and document are the places after the last token of each. Longer stretches get places
    of their own every STEP tokens; so do all of the last `length` tokens if the stream ends here,
    since its remainder would be padded otherwise.
    """
    penalty = np.full(n + 1, np.inf)
    penalty[sentence] = SENTENCE
    penalty[document] = penalty[0] = 0.0
    given = np.flatnonzero(np.isfinite(penalty))
    ends = np.append(given, n)
    wide = np.flatnonzero(np.diff(ends) > STEP)
    for a, b in zip(ends[wide], ends[wide + 1], strict=True):
        penalty[a + STEP : b : STEP] = INSIDE
    if last:
        tail = penalty[max(0, n - length) :]
        tail[np.isinf(tail)] = INSIDE
        penalty[n] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def ways(at: np.ndarray, penalty: np.ndarray, length: int) -> tuple[list[float], list[int]]:
    """The least cost of cutting at each place, and the place of the cut before.

    A sequence costs EACH and the tokens it is short of `length`, none if its size is a power of
    two; each cut costs its penalty. No stretch between two places is longer than `length`.
    """
    ends, starts = [], []
    power = 1
    while power < length:
        k = np.searchsorted(at, at - power)
        found = np.flatnonzero((at >= power) & (at[np.minimum(k, len(at) - 1)] == at - power))
        ends.append(found)
        starts.append(k[found])
        power *= 2
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    ends, starts = [*ends[order].tolist(), -1], starts[order].tolist()
    at, penalty = at.tolist(), penalty.tolist()
    cost, back, level, p = [0.0], [0], [0.0], 0
    queue = deque([0])
    for i in range(1, len(at)):
        here = at[i]
        while at[queue[0]] < here - length:
            queue.popleft()
        j = queue[0]
        least = level[j] + length - here
        while ends[p] == i:
            if cost[starts[p]] < least:
                j, least = starts[p], cost[starts[p]]
            p += 1
        least += penalty[i] + EACH
        cost.append(least)
        back.append(j)
        level.append(least + here)
        while queue and level[queue[-1]] >= least + here:
            queue.pop()
        queue.append(i)
    return cost, back


def traced(back: list[int], i: int) -> list[int]:
    out = []
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(back: list[int], first: int) -> int:
    """The last place that the best ways to all places from `first` on pass through."""
    heap = [-i for i in range(first, len(back))]
    heapify(heap)
    while heap[0] != heap[-1] or len(set(heap)) > 1:
        top = heap[0]
        heapreplace(heap, -back[-top])
        while len(heap) > 1 and heap[0] == top:  # ways that have met
            heapreplace(heap, -back[-top])
    return -heap[0]


class Stream:
    """Documents in order, of which what is cut for good is taken out as pieces."""

    def __init__(self, length: int, end_id: int):
        self.length, self.end = length, np.array([end_id], "<u4").tobytes()
        self.ids: list[bytes] = []
        self.docs: list[list] = []  # [doc_id, tokens, start of what is left]
        self.waiting = self.sequences = 0
        self.next = BLOCK

    def add(self, doc_id, marked: bytes) -> None:
        self.ids += [marked, self.end]
        n = len(marked) // 4 + 1
        self.docs.append([doc_id, n, 0])
        self.waiting += n

    def cut(self, last: bool = False) -> Iterator[tuple]:
        """(doc_id, start, length, ids, doc_tokens, sequence, offset) of what can be cut now."""
        if not self.waiting:
            return
        marked = np.frombuffer(b"".join(self.ids), "<u4")
        ends = np.cumsum([n - start for _, n, start in self.docs])
        at, penalty = places(np.flatnonzero(marked & _MARK) + 1, ends, len(marked), self.length, last)
        if at[-1] < len(marked) - self.length:
            at, penalty = np.append(at, len(marked)), np.append(penalty, INSIDE)
        cost, back = ways(at, penalty, self.length)
        first = int(np.searchsorted(at, at[-1] - self.length))
        if last:
            stop = len(at) - 1
        else:
            stop = common(back, first)
            if not stop and len(marked) >= MOST:
                stop = min(range(max(first, 1), len(at)), key=lambda i: cost[i] + float(at[i]))
        cuts = at[traced(back, stop)]
        self.next = BLOCK + (0 if stop else len(marked))
        if not stop:
            self.ids = [marked.tobytes()]
            return
        limit, raw = int(cuts[-1]), (marked & ~_MARK).tobytes()
        edges = np.union1d(np.concatenate(([0], cuts)), ends[ends < limit])
        begins = np.concatenate(([0], ends[:-1]))
        of = np.searchsorted(ends, edges[:-1], "right")
        sequence = np.searchsorted(cuts, edges[:-1], "right")
        offset = edges[:-1] - np.concatenate(([0], cuts))[sequence]
        for a, b, d, s, o in zip(edges[:-1].tolist(), edges[1:].tolist(), of.tolist(), sequence.tolist(), offset.tolist(), strict=True):
            doc_id, n, start = self.docs[d]
            yield doc_id, start + a - int(begins[d]), b - a, raw[4 * a : 4 * b], n, self.sequences + s, o
        self.sequences += len(cuts)
        self.waiting = len(marked) - limit
        self.ids = [marked[limit:].tobytes()]
        keep = int(np.searchsorted(ends, limit, "right"))
        if keep < len(self.docs):
            self.docs[keep][2] += max(0, limit - int(begins[keep]))
        self.docs = self.docs[keep:]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), a row for each piece of a document.

    A document's tokens are its text's ids by the file `tokenizer` (see Encoder) and end_id. They lie
    in order in one or more pieces: `start` tokens of the document come before a piece, `ids` are its
    tokens as little-endian unsigned 32-bit words. A sequence's pieces lie at `offset` one after
    another from 0, `length` tokens at most. The order is that of the documents in their scan
    partition: nothing is shuffled, a partition is a stream, and a task that runs again makes the
    same sequences. The high half of sequence_id is the partition.

    Cuts are the best of the whole stream: a block of tokens is cut as far as the best ways to all
    the places where the next sequence may begin have one place in common. Only if that takes more
    than MOST tokens is the best way of the moment taken.

    A null or empty text is end_id alone. A null doc_id is kept; rows that share a doc_id are
    documents of their own. A text of any length may span sequences; it is held by one task. A table
    without rows makes no piece. Other columns are not read.
    """
    name = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", name.dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length")], T.StructField("ids", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, stream = encoder_of(tokenizer), Stream(length, end_id)
        high, kind = TaskContext.get().partitionId() << 32, pa.int64()

        def batches_of(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list(pieces)
            for i in range(0, len(rows), 2048):
                doc_id, start, size, ids, tokens, sequence, offset = zip(*rows[i : i + 2048], strict=True)
                columns = [pa.array(doc_id, kind), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array([high + s for s in sequence], pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                stream.add(doc_id, encoder.marked(text.as_py() or b""))
                if stream.waiting >= stream.next:
                    yield from batches_of(stream.cut())
        yield from batches_of(stream.cut(last=True))

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
