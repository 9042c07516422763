"""Language identification in two steps: the family first, then one-versus-one linear support vector
machines between the languages of the family.

Features are the counts of letter trigrams and of whole short words of a text, hashed to DIMS
places, under a square root and of unit length. All machines are linear, trained by averaged
subgradient steps on the squared hinge loss, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import bounded, fold, gathered
from .words import binary

DIMS = 4096
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Languages by family; a language that is not listed is a family of its own. Fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("tr", "az", "kk"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa"),
    "sinitic": ("zh", "yue"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

# Bytes as trigrams see them: A-Z lowered, other ASCII that is no letter becomes a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def features(text: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    counts = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw), 1 << 20):
        part = _FOLD[raw[at : at + (1 << 20) + 3]].astype(np.uint32)
        if len(part) < 4:
            part = np.concatenate((part, np.full(4 - len(part), 32, np.uint32)))
        three = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16)
        four = three | part[3:] << np.uint32(24)
        counts += np.bincount((three * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMS)
        counts += np.bincount((four * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(counts).astype(np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def has_letter(text: bytes | memoryview) -> bool:
    """Whether a text in UTF-8 holds a letter; it is decoded only if no ASCII letter is found."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), 1 << 16):
        part = _FOLD[raw[at : at + (1 << 16)]]
        if ((part != 32) & (part < 128)).any():
            return True
    return _LETTER.search(bytes(text).decode("utf-8", "replace")) is not None


def _machine(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights and bias of a linear machine for y in -1, 1, each class weighing as much as the other."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    rate = 0.5 / (float((weight[:, None] * x * x).sum()) + decay)
    for _ in range(steps):  # accelerated gradient steps on the squared hinge loss
        slack = np.maximum(0, 1 - y * (x @ (w + 0.9 * v)))
        v = 0.9 * v - rate * (decay * (w + 0.9 * v) - x.T @ (2 * weight * y * slack))
        w = w + v
    return w


class Model:
    """Families, and one machine for each two families and each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = [_FAMILY_OF.get(a, a) for a in langs]
        self.families = sorted(set(family))
        self.members = {f: sorted({a for a, b in zip(langs, family, strict=True) if b == f}) for f in self.families}
        self.of_families = self._pairs(x, np.array(family), self.families)
        self.of_langs = {f: self._pairs(x, np.array(langs), names) for f, names in self.members.items()}

    @staticmethod
    def _pairs(x: np.ndarray, labels: np.ndarray, names: list[str]) -> tuple[list[str], np.ndarray]:
        machines = []
        for a, b in combinations(names, 2):
            rows = (labels == a) | (labels == b)
            machines.append(_machine(x[rows].astype(np.float32), np.where(labels[rows] == a, 1.0, -1.0).astype(np.float32)))
        return names, np.array(machines, np.float32).reshape(len(machines), DIMS + 1)

    @staticmethod
    def _choose(pairs: tuple[list[str], np.ndarray], x: np.ndarray) -> tuple[str, float]:
        """The name with most votes, margins breaking ties, and how clearly it wins."""
        names, machines = pairs
        if len(names) == 1:
            return names[0], 1.0
        margin = machines[:, :-1] @ x + machines[:, -1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margin, -5, 5)))
        votes, total = np.zeros(len(names)), np.zeros(len(names))
        least = np.ones(len(names))
        for (a, b), m, p in zip(combinations(range(len(names)), 2), margin, sure, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(range(len(names)), key=lambda i: (votes[i], total[i]))
        return names[best], float(least[best])

    def predict(self, text: bytes | memoryview | None) -> tuple[str, float]:
        """The language of a text in UTF-8 and how sure it is."""
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        x = features(text)
        family, sure = self._choose(self.of_families, x)
        lang, surer = self._choose(self.of_langs[family], x)
        return lang, sure * surer


def fit(docs: DataFrame, per_lang: int = 400, folds: int = 4, held: int = 2) -> Model:
    """A model from about per_lang rows of every language.

    Only rows with a lang and a text whose fold is not `held` are learned from. Features are
    computed by Spark; about per_lang vectors of DIMS half floats for a language come to the driver,
    which trains one machine for each two families and each two languages of a family. With no such
    rows the model answers `und`.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    chosen = bounded(rows, "lang", "doc_id", per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t.as_buffer()).astype(np.float16).tobytes() for t in binary(batch.column(2))], pa.binary())], ["id", "lang", "x"])

    vectors = chosen.select(F.col("doc_id").cast("string"), "lang", "text").mapInArrow(run, "id string, lang string, x binary")
    found = sorted((r[1], r[0] or "", bytes(r[2])) for r in gathered(vectors, "languages"))
    x = np.empty((len(found), DIMS), np.float16)
    for row, (_, _, v) in zip(x, found, strict=True):
        row[:] = np.frombuffer(v, np.float16)
    return Model(x, [lang for lang, _, _ in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs: one scan, no shuffle.

    `und` with score 0 if the text is null or has no letter. Long texts are read whole. Rows with
    equal texts are predicted alike. Columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(memoryview(t.as_buffer()) if t.is_valid else None) for t in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def known_only(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The documents whose language is determined with a score above least; all columns of docs.

    Null and empty texts and texts without a letter go. Rows with equal texts stay or go together.
    Only the text is sent to Python and only a flag comes back; no shuffle.
    """

    def sure(text: pa.Array) -> pa.Array:
        return pa.array([model.predict(memoryview(t.as_buffer()) if t.is_valid else None)[1] > least for t in binary(text)], pa.bool_())

    return docs.where(F.arrow_udf(sure, "boolean")(F.col("text").cast("string")))
