"""Quality scores from compression: which labelled text helps more to compress a document.

Two zstandard dictionaries are built, from text labelled good and from text labelled bad. A document
is compressed with each; the difference of its two compressed sizes goes through a logistic curve fitted
on labelled documents that neither dictionary has seen. The difference is normalised by the root of the
text's length: it is a sum over the text's pieces, whose deviation grows as the root of their number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import bounded, fold, gathered
from .words import binary

DICT_BYTES, LEVEL, PIECE = 64 << 10, 3, 2048
#: Added to a text's length, as a frame has a size of its own.
SHORT = 50


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [x[i : i + PIECE] for x in texts for i in range(0, len(x), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself
        return b"".join(pieces)[-size:]


class Sizes:
    """Compressed sizes of texts with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_dict_id=False) if x else zstandard.ZstdCompressor(level=LEVEL) for x in (good, bad)]

    def difference(self, text: bytes) -> float:
        """bad - good over the root of the length (and SHORT bytes), positive where the good dictionary helps more."""
        good, bad = (len(c.compress(text)) for c in self.by)
        return (bad - good) / math.sqrt(len(text) + SHORT)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def score(self, sizes: Sizes, text: bytes) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * sizes.difference(text) + self.offset, -30), 30)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression, by Newton steps, with Platt's targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    rows = np.stack((x, np.ones(len(x))), axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), rows.T @ (target - p) - 1e-6 * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, max_bytes: int = 48 << 20, folds: int = 5, held: int = 0) -> Model:
    """A model from about per_label documents of either label, no more than max_bytes of text, in order
    of a hash of the document.

    Only rows whose fold is not `held` are learned from. Rows of null quality or doc_id teach
    nothing; a document labelled twice is taken with both labels. Without labels, or with one label
    only, every document scores as the share of good labels, 0.5 if there are none.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(fold(F.col("doc_id"), folds) != held).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = bounded(usable, "quality", "doc_id", per_label, 2)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * per_label rows of two numbers
    text: dict[tuple[int, bool], list[bytes]] = {(q, part): [] for q in (0, 1) for part in (False, True)}
    size = 0
    for row in gathered(rows.select("doc_id", "quality", "text").where("text is not null"), "labelled", F.xxhash64("doc_id", "text"), "doc_id", "quality"):
        raw = row[2].encode()
        if size + len(raw) <= max_bytes:
            text[row[1], zlib.crc32(f"{row[0]}:part".encode()) % 3 == 0].append(raw)
            size += len(raw)
    for q in (0, 1):
        for part in text[q, False], text[q, True]:
            part.sort()
    good, bad = (_dictionary(text[q, False], DICT_BYTES) for q in (1, 0))
    sizes = Sizes(good, bad)
    y = np.concatenate([np.full(len(text[q, True]), q) for q in (0, 1)])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(good, bad, 0.0, float(np.log(share / (1 - share))))
    x = np.array([sizes.difference(t) for q in (0, 1) for t in text[q, True]])
    return Model(good, bad, *_curve(x, y))


def scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs: one scan, no shuffle.

    Null and empty texts compress alike under both dictionaries: they get the curve's value there.
    Long texts are compressed whole. Rows with equal texts score alike. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            found = [model.score(sizes, x.as_buffer() if x.is_valid else b"") for x in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
