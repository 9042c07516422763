"""Media columns: bytes stored losslessly as images, read back, and described."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import webp, webp_batch
from .words import binary

#: Bytes of texts, or of stored files, that are written or read together.
_TOGETHER = 4 << 20


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def _cut(sizes: list[int]) -> Iterator[list[int]]:
    """The indexes in order of size, in lists of about _TOGETHER."""
    held, total = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        held.append(i)
        total += sizes[i]
        if total >= _TOGETHER:
            yield held
            held, total = [], 0
    if held:
        yield held


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary(batch.column(1))
        raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
        for some in _cut([len(x) for x in raws]):
            media = webp_batch.write([padded(raws[i]) for i in some])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array([len(raws[i]) for i in some], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of
    64, as lossless WebP images of 64 pixels a row: one of up to 8 KiB, or several one after another.

    A null text is stored as an empty one. Rows with equal texts have equal media. No shuffle; rows
    may come in another order within their partition. Any text that Spark holds can be stored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


class Described:
    """Hash, checksum and feature of the images of one payload, given one after another."""

    def __init__(self):
        self.size, self.tail, self.hash = 0, b"", hashlib.sha256()
        self.sums, self.found, self.rows, self.still, self.above = np.zeros(4, np.int64), np.zeros(256, bool), 0, 0, None

    def add(self, pixels: np.ndarray) -> None:
        samples = pixels[..., 1].tobytes()
        self.size += len(samples)
        self.tail = samples[-64:]
        self.hash.update(samples)
        self.sums += pixels.reshape(-1, 4).sum(axis=0, dtype=np.int64)
        self.found[pixels[..., 1]] = True
        rows = pixels.view(np.uint32)[..., 0]
        if self.above is not None and len(self.above) == rows.shape[1]:
            self.still += int(np.count_nonzero(rows[0] == self.above))
        self.still += int(np.count_nonzero(rows[1:] == rows[:-1]))
        self.rows += len(rows)
        self.above = rows[-1].copy()

    def feature(self) -> str:
        """Size, sum of each channel, distinct samples of green, and pixels equal to the one above."""
        return f"{len(self.above)}x{self.rows} sums {' '.join(map(str, self.sums.tolist()))} distinct {int(self.found.sum())} still {self.still}"


def described(media: list[bytes]) -> list[Described]:
    """What each of the media holds, from its stored bytes alone."""
    files = [webp_batch.split(x) for x in media]
    owners = np.repeat(np.arange(len(media)), [len(x) for x in files])
    out = [Described() for _ in media]
    for owner, pixels in zip(owners.tolist(), webp_batch.read(f for x in files for f in x), strict=True):
        out[owner].add(pixels)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [x.as_buffer().to_pybytes() for x in batch.column(2)]
        for some in _cut([len(x) for x in media]):
            stored = [media[i] for i in some]
            rows = [(d.size, d.hash.hexdigest(), zlib.crc32(d.tail), len(x), hashlib.sha256(x).hexdigest(), d.feature()) for d, x in zip(described(stored), stored, strict=True)]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def describe(stored: DataFrame) -> DataFrame:
    """What the media of store_texts() hold, from the stored bytes alone: decoded, hashed and described.
    A file that cannot be decoded is an error. No shuffle."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        _describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def _decoded(media: Iterable[bytes | None]) -> Iterator[list[dict] | None]:
    for data in media:
        if data is None:
            yield None
            continue
        out = []
        try:
            for file in webp_batch.files(data):
                p = webp.decode(file)
                out.append({"width": p.shape[1], "height": p.shape[0], "rgba": p.tobytes(), "error": None})
        except (webp.WebPError, IndexError, ValueError, struct.error) as e:
            out.append({"width": None, "height": None, "rgba": None, "error": str(e)})
        yield out


def decode_column(rows: DataFrame, column: str, output: str = "pixels") -> DataFrame:
    """rows with `output`: for what is in `column` an array of its images, one for each file of those that
    stand there one after another: structs of width, height, rgba bytes and error.

    A null gives null; a file that cannot be decoded gives its error and no pixels, and ends the array, as
    nobody knows where the next one begins. No bytes give no images. A column named `output` is replaced; other columns may have
    any names and are not sent to Python.
    """
    kind = StructType.fromDDL("o array<struct<width: int, height: int, rgba: binary, error: string>>")["o"].dataType
    arrow = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())]))

    def pixels(files: pa.Array) -> pa.Array:
        return pa.array(list(_decoded(x.as_buffer().to_pybytes() if x.is_valid else None for x in files)), arrow)

    return rows.withColumn(output, F.arrow_udf(pixels, kind)(F.col(f"`{column}`")))
