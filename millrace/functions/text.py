"""Text for retrieval and for release: chunking, and redaction of personal data by its shape."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_SPACE = " \t\n\f\r"
_GAP = re.compile(f"[{_SPACE}]")


def cut(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of at most `size` characters, each sharing up to `overlap` with the one before.

    A chunk ends before the last white space of its window unless that would leave it no longer
    than the overlap; the next begins `overlap` back from its end, or at the first word that begins
    there. Chunks lose their outer spaces, and blank ones are left out.
    """
    if text is None or not text.strip(" "):
        return []
    out, start, n = [], 0, len(text)
    while True:
        window = text[start : start + size]
        length = len(window)
        if start + size < n:
            last = max(window.rfind(c) for c in _SPACE)
            length = last if last > overlap else size
        chunk = window[:length].strip(" ")
        if chunk:
            out.append(chunk)
        if start + size >= n:
            return out
        start += length - overlap
        if overlap and text[start - 1] not in _SPACE:
            gap = _GAP.search(text, start, start + overlap)
            if gap:
                start = gap.end()


def chunks(column: Column, size: int, overlap: int) -> Column:
    """The chunks of a text column, as an array. Arrow batches; the text need not fit a window."""

    @F.pandas_udf(ArrayType(StringType()))
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut(x, size, overlap) if isinstance(x, str) else [])

    return of(column.cast("string"))


#: Kind, pattern and token, in the order they are looked for. Fixed values.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "EMAIL"),
    ("ip", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", "IP"),
    ("credit_card", r"\b(?:[0-9][ -]?){12,18}[0-9]\b", "CARD"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "SSN"),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?\b[0-9]+(?:[ .-][0-9]+)*\b", "PHONE"),
)
#: A word boundary among ASCII letters. Java's own takes letters of all scripts, so that digits beside one would not count.
_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
KINDS = ("email", "phone", "credit_card", "ssn", "ip")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether a number's digits pass the Luhn check: every second from the right counts twice."""
    digits = F.split(F.reverse(_digits(match)), "")
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _is_phone(match: Column) -> Column:
    n = F.length(_digits(match))
    return (n >= 10) & (n <= 15) & match.rlike("[ .()+-]") & ~match.rlike("^(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}")


def _swapper(kind: str, token: str, hashed: bool) -> Callable[[Column, Column], Column]:
    """Replaces a match in a text by its token."""

    def plain(text: Column, match: Column) -> Column:
        return F.replace(text, match, F.lit(f"[{token}]"))

    def with_hash(text: Column, match: Column) -> Column:
        denotes = F.lower(match) if kind in ("email", "ip") else _digits(match)
        return F.replace(text, match, F.concat(F.lit(f"[{token}:"), F.substring(F.sha2(denotes, 256), 1, 12), F.lit("]")))

    return with_hash if hashed else plain


#: What a text must hold for a kind's pattern to match at all: most texts are spared the search.
_HINTS = {"email": "@", "ip": "[0-9][.][0-9]|:[0-9A-Fa-f]", "credit_card": "[0-9]", "ssn": "[0-9]-[0-9]", "phone": "[0-9]"}


def redact_kind(value: Column, kind: str, hashed: bool = False) -> Column:
    """The text with one kind's matches replaced by [TOKEN], or by [TOKEN:hash of what it denotes].

    JVM expressions throughout. A card must pass the Luhn check; a phone number has 10 to 15 digits
    and a separator and is no date. Every occurrence of a match is replaced; null stays null.
    """
    pattern, token = next((p.replace(r"\b", _EDGE), t) for k, p, t in PATTERNS if k == kind)
    judge = {"credit_card": _luhn, "phone": _is_phone}.get(kind)
    if judge is None and not hashed:
        done = F.regexp_replace(value, pattern, f"[{token}]")
    else:
        found = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
        done = F.aggregate(F.filter(found, judge) if judge else found, value, _swapper(kind, token, hashed))
    return F.when(value.rlike(_HINTS[kind]), done).otherwise(value)


def redact(df: DataFrame, columns: list[str], kinds: tuple[str, ...] | list[str] = KINDS, hashed: bool = False) -> DataFrame:
    """df with the columns redacted, a kind after the other in the order of PATTERNS.

    Each kind is a projection of its own: an expression over an expression would be computed again
    wherever it is named.
    """
    names = {c: F.col(f"`{c}`").cast("string") for c in columns}
    df = df.withColumns(names)
    for kind, _, _ in PATTERNS:
        if kind in kinds:
            df = df.withColumns({c: redact_kind(F.col(f"`{c}`"), kind, hashed) for c in columns})
    return df
