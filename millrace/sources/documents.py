"""XML and Excel files. XML is read by tasks a split of a file at a time, Excel a file at a time, through
Spark's own file readers."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from decimal import Decimal
from itertools import chain, groupby, islice
from typing import Any
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import Step, component, need, one_of, opt
from ..storage import delete, joined, list_files, new_path, replace_file
from .apis import read_staged, staged
from .files import MODES, in_file_order, refuse_existing


def xml_records(data: bytes, record: str) -> list[dict[str, str]]:
    return list(each_xml_record([data], record))


def each_xml_record(pieces: Iterable[bytes], record: str, encoding: str | None = None, shift: int = 0) -> Iterator[dict[str, str]]:
    """A dict for each element called `record` of a document in pieces: @attribute, child, child@attribute.

    An empty child is an empty text. A child within a child, a repeated child and text beside
    children cannot be columns and are errors that name their byte, counted from `shift`.
    """
    out: list[dict[str, str]] = []
    parser = expat.ParserCreate(encoding)
    parser.buffer_text = True
    row: dict[str, str] | None = None
    field: str | None = None

    def fail(what: str) -> None:
        raise ValueError(f"{what} at byte {parser.CurrentByteIndex + shift}")

    def local(name: str) -> str:
        return name.rsplit(":", 1)[-1]

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal row, field
        name = local(name)
        if row is None:
            if name == record:
                row = {f"@{local(k)}": v for k, v in attributes.items() if not k.startswith("xmlns")}
            return
        if field is not None:
            fail(f"<{name}> lies below <{record}>/<{field}>, too deep to become a column")
        if name in row:
            fail(f"a <{record}> has two <{name}>, which make one column")
        field = name
        row[name] = ""
        row.update({f"{name}@{local(k)}": v for k, v in attributes.items()})

    def end(name: str) -> None:
        nonlocal row, field
        if field is not None:
            field = None
        elif row is not None:
            out.append(row)
            row = None

    def text(data: str) -> None:
        if field is not None:
            row[field] += data
        elif row is not None and data.strip():
            fail(f"<{record}> holds text of its own beside its children")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    for piece, last in chain(((p, False) for p in pieces), [(b"", True)]):
        try:
            parser.Parse(piece, last)
        except expat.ExpatError as e:
            raise ValueError(f"not well-formed XML: {e}{f', counted from byte {shift}' if shift else ''}") from None
        yield from out
        out.clear()


#: A whole tag, or a comment, CDATA or instruction without a "<" in it: closing, name, empty.
_TAG = re.compile(rb"""<(?:!--[^<]*?-->|!\[CDATA\[[^<]*?\]\]>|\?[^<]*?\?>|(/?)([^\s/<>!?"'=]+)(?:\s(?:[^<>"'/]|/(?!>)|"[^<"]*"|'[^<']*')*)?(/?)>)""")
_ENCODING = re.compile(rb"""^\s*<\?xml[^<>]*?\sencoding\s*=\s*["']([\w.-]+)["']""")
#: Open elements of a split, and bytes of a record that began before it, that are kept; splits with more are not parsed apart.
_DEEP, _HEAD = 1000, 1 << 20
_PACKED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst)$")


def _local(name: bytes) -> bytes:
    return name.rsplit(b":", 1)[-1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """The bytes of splits, a batch at a time, each with its file and start. Rows are what lies between two "<"."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = [0, *(np.nonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1]))[0] + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (int(files[a]), int(starts[a]))
            data = b"<".join(batch.column(2).slice(a, b - a).to_pylist())
            yield key, data if key != last and key[1] == 0 else b"<" + data
            last = key


@dataclass(frozen=True)
class _Split:
    """What a split of a file does to the elements open around it: whether all its markup is tags, or has no
    "<" within; elements it closes that it did not open, and leaves open; the bytes up to the first such end
    of a record, and which of those ends that is."""

    file: int
    start: int
    size: int
    regular: bool
    closes: list[bytes]
    opens: list[bytes]
    head: bytes | None
    ends: int
    encoding: str | None


_SPLIT = "file long, start long, size long, regular boolean, closes array<binary>, opens array<binary>, head binary, ends int, encoding string"


def _outline(record: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), group in groupby(_pieces(batches), lambda x: x[0]):
            size, regular, ends, encoding, head = 0, True, 0, None, None
            closes: list[bytes] = []
            opens: list[bytes] = []
            before: bytearray | None = bytearray()
            for _, data in group:
                if size == 0 and start == 0 and (m := _ENCODING.match(data)):
                    encoding = m[1].decode()
                size += len(data)
                if not regular:
                    continue
                tags = 0
                for m in _TAG.finditer(data):
                    tags += 1
                    if (name := m[2]) is None:
                        continue
                    if not m[1]:
                        if not m[3]:
                            opens.append(name)
                    elif opens:
                        regular &= opens.pop() == name
                    else:
                        closes.append(name)
                        if before is not None and _local(name) == record:
                            head, ends, before = bytes(before) + data[: m.end()], len(closes), None
                regular &= tags == data.count(b"<") and b"\0" not in data and max(len(opens), len(closes)) <= _DEEP
                if before is not None:
                    before = before + data if len(before) + len(data) <= _HEAD else None
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([x], pa.int64()) for x in (file, start, size)), pa.array([regular]), *(pa.array([x if regular else []], pa.list_(pa.binary())) for x in (closes, opens)),
                    pa.array([head], pa.binary()), pa.array([ends], pa.int32()), pa.array([encoding], pa.string()),
                ],
                names=[x.split()[0] for x in _SPLIT.split(", ")],
            )

    return run


@dataclass(frozen=True)
class _Place:
    """How a split is parsed as a document of its own: elements opened before it and closed after it, bytes of
    it that belong to the split before, bytes of the next that belong to it, and its place in the file."""

    before: bytes = b""
    skip: int = 0
    after: bytes = b""
    shift: int = 0
    encoding: str | None = None


def xml_places(splits: list[_Split], record: bytes) -> list[_Place] | None:
    """The places of all splits of a file in their order, or None if it has to be parsed from its beginning: for
    markup that holds "<", such as some CDATA, a DOCTYPE, a record as long as a split, or what is no document."""
    if len(splits) == 1:
        return [_Place()]
    encoding = splits[0].encoding
    if not all(s.regular for s in splits) or (not record.isascii() and (encoding or "utf-8").lower() != "utf-8"):
        return None
    stack: list[bytes] = []
    outer: list[list[bytes]] = []
    heads: list[bytes] = []
    for i, s in enumerate(splits):
        inside = next((n for n, x in enumerate(stack) if _local(x) == record), None)
        outer.append(stack[:inside])
        heads.append(s.head or b"" if inside is not None else b"")
        if (i > 0 and not outer[i]) or (inside is not None and (s.head is None or s.ends != len(stack) - inside)):
            return None
        for name in s.closes:
            if not stack or stack.pop() != name:
                return None
        stack += s.opens
    if stack:
        return None
    outer.append([])
    heads.append(b"")
    out, at = [], 0
    for i, s in enumerate(splits):
        before = b"".join(b"<%s>" % x for x in outer[i])
        after = heads[i + 1] + b"".join(b"</%s>" % x for x in reversed(outer[i + 1]))
        out.append(_Place(before, len(heads[i]), after, at + len(heads[i]) - len(before), encoding if i else None))
        at += s.size
    return out


def _placed(pieces: Iterator[bytes], place: _Place) -> Iterator[bytes]:
    yield place.before
    skip = place.skip
    for data in pieces:
        yield data[skip:]
        skip = max(skip - len(data), 0)
    yield place.after


def _rows_of(record: str, places: dict[tuple[int, int], _Place], names: dict[int, str]):
    """The records of splits as JSON lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(_pieces(batches), lambda x: x[0]):
            if key not in places:
                raise RuntimeError(f"{names[key[0]]} was split otherwise when it was read before")
            rows = each_xml_record(_placed((x[1] for x in group), places[key]), record, places[key].encoding, places[key].shift)
            try:
                while block := [json.dumps(r, ensure_ascii=False) for r in islice(rows, 1000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.string())], ["value"])
            except ValueError as e:
                raise ValueError(f"{names[key[0]]}: {e}") from None

    return run


@contextmanager
def _with_conf(spark: SparkSession, conf: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _parsed_xml(step: Step, record: str) -> str:
    """The files' records as JSON lines in the shared folder, parsed by a task for each split of a file.

    Spark's text reader splits files, at "<" here. A first pass finds what each split opens and closes,
    which tells what is open where a split begins; a second parses each split within that. A record that
    lies across two splits is parsed with the first. A file for which that cannot be told is parsed by one
    task from its beginning, a batch at a time.
    """
    spark, path = step.spark, new_path(step.spark, "staged")
    kept = {"spark.sql.files.minPartitionNum": str(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism), "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

    def tokens() -> DataFrame:
        read = spark.read.option("lineSep", "<").text(step["path"])
        columns = {"file": F.xxhash64("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "value": F.col("value").cast("binary")}
        return read.select(*[c.alias(n) for n, c in columns.items()])

    with _with_conf(spark, kept):
        listed = spark.read.format("binaryFile").load(step["path"]).select(F.xxhash64("_metadata.file_path").alias("file"), "path", "length").collect()
        names, lengths = {r.file: r.path for r in listed}, {r.file: r.length for r in listed}
        found = [_Split(**r.asDict()) for r in tokens().mapInArrow(_outline(record.encode()), _SPLIT).collect()]
        places: dict[tuple[int, int], _Place] = {}
        whole: list[int] = []
        for file, group in groupby(sorted(found, key=lambda s: (s.file, s.start)), lambda s: s.file):
            splits = list(group)
            if given := xml_places(splits, record.encode()):
                places |= {(s.file, s.start): p for s, p in zip(splits, given, strict=True)}
            else:
                whole.append(file)
                places[file, 0] = _Place()
            if lengths[file] - sum(s.size for s in splits) in (1, 4) and not _PACKED.search(names[file]):  # 3 bytes are a mark at its beginning
                last = file, splits[-1].start if given else 0
                places[last] = replace(places[last], after=places[last].after + b"<")  # a reader of lines leaves out the last end of a line
        tokens().where(~F.col("file").isin(whole)).mapInArrow(_rows_of(record, places, names), "value string").write.text(path)
    if whole:
        most = max(sum(s.size for s in found if s.file == x) for x in whole)
        with _with_conf(spark, kept | {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxPartitionBytes": str(most + (1 << 20))}):
            tokens().where(F.col("file").isin(whole)).mapInArrow(_rows_of(record, places, names), "value string").write.mode("append").text(path)
    return path


def _parsed(step: Step, parse) -> str:
    """The files' records as JSON lines in the shared folder."""
    files = step.spark.read.format("binaryFile").load(step["path"]).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = iter(parse(bytes(content)))
                try:
                    while block := [json.dumps(r, ensure_ascii=False) for r in islice(rows, 10000)]:
                        yield pd.DataFrame({"value": block})
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from None

    return staged(step.spark, files.mapInPandas(run, "value string"))


@component("src.file.xml", {"path": need("path"), "record": need(), "columns": opt("map")})
def read_xml(step: Step) -> DataFrame:
    """A row for each `record` element of XML files; no match is no error."""
    record = step["record"]
    path = _parsed_xml(step, record)
    if step["columns"]:
        return read_staged(step.spark, path, step["columns"])
    df = step.spark.read.options(primitivesAsString=True, mode="FAILFAST").json(path)
    return in_file_order(df, list_files(step.spark, f"{path}/part-*"))


def xml_lines(df: DataFrame, record: str) -> DataFrame:
    """A column `value` with the element of each row, as xml_records reads it back; expressions only."""
    texts = {f.name: _xml_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}

    def safe(value: Column, more: dict[str, str]) -> Column:
        for plain_, written in {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;", **more}.items():
            value = F.replace(value, F.lit(plain_), F.lit(written))
        return value

    def attributes(owner: str) -> Column:
        parts = [F.concat(F.lit(f' {c.split("@", 1)[1]}="'), safe(x, {'"': "&quot;", "\n": "&#10;", "\t": "&#9;"}), F.lit('"')) for c, x in texts.items() if c.startswith(f"{owner}@")]
        return F.concat_ws("", *parts) if parts else F.lit("")

    children = [F.concat(F.lit(f"\n    <{c}"), attributes(c), F.lit(">"), safe(x, {}), F.lit(f"</{c}>")) for c, x in texts.items() if "@" not in c]
    body = F.concat_ws("", *children) if children else F.lit("")
    end = F.when(body == "", F.lit("/>")).otherwise(F.concat(F.lit(">"), body, F.lit(f"\n  </{record}>")))
    return df.select(F.concat(F.lit(f"  <{record}"), attributes(""), end).alias("value"))


def _xml_value(value: Column, kind: T.DataType) -> Column:
    return value.cast("timestamp_ntz").cast("string") if isinstance(kind, T.TimestampType | T.TimestampNTZType) else value.cast("string")


_XML_NAME = re.compile(r"^[A-Za-z_][\w.-]*(@[A-Za-z_][\w.-]*)?$|^@[A-Za-z_][\w.-]*$")


def _flat(step: Step, df: DataFrame) -> None:
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            raise ValueError(f"column '{f.name}' is nested and cannot be written")


@component("snk.file.xml", {"path": need("path"), "root": opt("text", "records"), "record": opt("text", "record"), "mode": one_of(*MODES, default="overwrite")}, deferred=True)
def write_xml(step: Step):
    """An XML file, the inverse of src.file.xml: nulls are left out, nested columns refused. Tasks write
    the elements of their rows; the files they make are then put together, as bytes."""

    def run(df: DataFrame) -> int:
        refuse_existing(step)
        _flat(step, df)
        for c in df.columns:
            if not _XML_NAME.match(c):
                raise ValueError(f"'{c}' is not a name that XML allows")
        for c in df.columns:
            owner = c.split("@")[0]
            if "@" in c and owner and owner not in df.columns:
                raise ValueError(f"'{c}' is an attribute of a column that is not there")
        seen, made = Observation(), new_path(step.spark, "xml")
        try:
            xml_lines(df.observe(seen, F.count(F.lit(1)).alias("n")), step["record"]).write.text(made)
            head, end = f'<?xml version="1.0" encoding="UTF-8"?>\n<{step["root"]}>\n', f"</{step['root']}>\n"
            joined(step.spark, list_files(step.spark, f"{made}/part-*"), f"{made}/whole", head, end)
            replace_file(step.spark, f"{made}/whole", step["path"])
        finally:
            delete(step.spark, made)
        return seen.get["n"]

    return run


# --- Excel ---------------------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_EPOCH = datetime(1899, 12, 30)
#: Number formats that mean a date or a time. Fixed values of the format.
_TIME_FORMATS = {*range(14, 23), *range(45, 48)}


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx_rows(data: bytes, sheet: str | None) -> Iterator[list[Any]]:
    """The cells of a sheet, row by row: texts, numbers, truths and times."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    times: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iterfind("m:numFmts/m:numFmt", _NS)}
        for xf in styles.iterfind("m:cellXfs/m:xf", _NS):
            n = int(xf.get("numFmtId", 0))
            times.append(n in _TIME_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I)))
    relations = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = {x.get("name"): relations[x.get(f"{{{_NS['r']}}}id")] for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"there is no sheet '{sheet}'; there are {', '.join(sheets)}")
    target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    row_, cell_, value_, text_ = (f"{{{_NS['m']}}}{x}" for x in ("row", "c", "v", "t"))
    with book.open(path) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != row_:
                continue
            cells: list[Any] = []
            for c in row.iterfind(cell_):
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t", "n"), c.findtext(value_)
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(text_))
                elif v is None:
                    continue
                elif kind == "s":
                    cells[at] = shared[int(v)]
                elif kind == "b":
                    cells[at] = v == "1"
                elif kind in ("str", "e", "d"):
                    cells[at] = v
                else:
                    number, style = float(v), int(c.get("s", 0))
                    if style < len(times) and times[style]:
                        cells[at] = (_EPOCH + timedelta(microseconds=round(number * 86400e6))).isoformat(" ")
                    else:
                        cells[at] = int(number) if number.is_integer() and "." not in v and "e" not in v.lower() else number
            row.clear()
            yield cells


def xlsx_records(data: bytes, sheet: str | None, header: bool) -> Iterator[dict[str, Any]]:
    rows = xlsx_rows(data, sheet)
    first = next(rows, [])
    names = [str(x) if header and x is not None else column_letters(i) for i, x in enumerate(first)]
    if not header:
        yield dict(zip(names, first, strict=True))
    for cells in rows:
        if any(x is not None for x in cells):
            yield {n: (cells[i] if i < len(cells) else None) for i, n in enumerate(names)}


@component("src.file.excel", {"path": need("path"), "sheet": opt(), "header": opt("bool", True)})
def read_excel(step: Step) -> DataFrame:
    """A sheet of xlsx files, the first unless named; the first row holds the names unless header=false."""
    sheet, header = step["sheet"], step["header"]
    return read_staged(step.spark, _parsed(step, lambda data: xlsx_records(data, sheet, header)), None)


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_NS["m"]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _cell(value: Any) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float | Decimal):
        return f"<c><v>{value}</v></c>"
    if isinstance(value, datetime):
        days = (value.replace(tzinfo=None) - _EPOCH) / timedelta(days=1)
        return f'<c s="2"><v>{days!r}</v></c>'
    if isinstance(value, date):
        return f'<c s="1"><v>{(value - _EPOCH.date()).days}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


#: Rows of a sheet, its header among them. A fixed value of the format.
SHEET = 1 << 20


def xlsx_bytes(rows: Iterator[Any], columns: list[str], sheet: str, header: bool, comment: bytes = b"") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.comment = comment
        for name, body in _PARTS.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{body}')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
            if header:
                f.write(f"<row>{''.join(map(_cell, columns))}</row>".encode())
            for row in rows:
                f.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _books(columns: list[str], sheet: str, header: bool, most: int):
    """A partition's rows as workbooks of `most` rows at most, one at least, without their last byte: it is a
    line's end, the comment of the archive, and Spark's text writer adds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 1000) for r in zip(*(c.slice(at, 1000).to_pylist() for c in b.columns), strict=True))
        following = next(rows, None)
        while True:
            given = islice(chain([] if following is None else [following], rows), most)
            book = xlsx_bytes(given, columns, sheet, header, b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([book[:-1]], pa.binary())], ["book"])
            following = next(rows, None)
            if following is None:
                return

    return run


@component("snk.file.excel", {"path": need("path"), "mode": one_of(*MODES, default="overwrite"), "header": opt("bool", True), "sheet": opt("text", "Sheet1")})
def write_excel(step: Step):
    """An xlsx file of one sheet. A sheet holds 1,048,576 rows; more make a folder of that name with as many
    files as they need, each with the header, which src.file.excel reads as it does one file. Tasks write them."""

    def run(df: DataFrame) -> int:
        refuse_existing(step)
        _flat(step, df)
        rows = df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz") if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema.fields])
        most, made, staged_ = SHEET - step["header"], new_path(step.spark, "excel"), new_path(step.spark, "excel")
        try:
            rows.write.option("maxRecordsPerFile", 100000).parquet(staged_)  # small files, for many tasks to read
            rows = step.spark.read.schema(rows.schema).parquet(staged_)
            n = rows.count()
            books = -(-n // most)
            parts = rows.coalesce(4 * books if books > 1 else 1) if n else step.spark.createDataFrame([], rows.schema).repartition(1)
            texts = parts.mapInArrow(_books(df.columns, step["sheet"], step["header"], most), "book binary").select(F.col("book").cast("string"))
            texts.write.option("maxRecordsPerFile", 1).text(made)
            found = list_files(step.spark, f"{made}/part-*")
            if books > 1:
                for i, file in enumerate(found):
                    replace_file(step.spark, file, f"{made}/whole/part-{i:05d}.xlsx")
            replace_file(step.spark, f"{made}/whole" if books > 1 else found[0], step["path"])
        finally:
            for x in (made, staged_):
                delete(step.spark, x)
        return n

    return run
