"""Spreadsheet source and sink: the XML parts of an XLSX file, no library."""

from __future__ import annotations

import datetime as dt
import glob
import itertools
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [s.get("name") for s in root.findall("m:sheets/m:sheet", _NS)]


# fixed values: the built-in number formats that show dates or times, as first and last ids
DATE_FORMATS = [(14, 22), (27, 36), (45, 47), (50, 58)]
#: Control characters that XML can't hold.
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_QUIET = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)


def _date_styles(book: zipfile.ZipFile) -> tuple[set[int], set[int]]:
    """Cell styles that show a number as a date or time, and those of times alone."""
    if "xl/styles.xml" not in book.namelist():
        return set(), set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): _QUIET.sub("", f.get("formatCode", "")).lower() for f in root.findall("m:numFmts/m:numFmt", _NS)}
    dates, times = set(), set()
    for style, own in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
        id = int(own.get("numFmtId", 0))
        code = codes.get(id)
        if any(a <= id <= b for a, b in DATE_FORMATS) if code is None else re.search("[dmyhs]", code) and "general" not in code:
            dates.add(style)
            if 18 <= id <= 21 or 45 <= id <= 47 if code is None else not re.search("[dy]", code) and re.search("[hs]", code):
                times.add(style)
    return dates, times


def _moment(number: float, time_alone: bool, from_1904: bool) -> dt.datetime | str:
    """What a serial day number stands for; a time of day alone is its text."""
    seconds = dt.timedelta(seconds=round(number * 86400, 3))
    if time_alone and 0 <= number < 1:
        return str((dt.datetime.min + seconds).time())
    # the first system counts a 29 February 1900 that never was
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if number >= 60 else 31)
    return start + seconds


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list]:
    """Rows of a sheet (the only or first one by default); gaps are null.

    Numbers in a format of dates are ``datetime``; 2958465 is the last day
    of the year 9999.
    """
    with zipfile.ZipFile(path) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(_REL) for s in root.findall("m:sheets/m:sheet", _NS)}
        wanted = sheets[sheet] if sheet else next(iter(sheets.values()))
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == wanted).lstrip("/")
        settings = root.find("m:workbookPr", _NS)
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        dates, times = _date_styles(book)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                out: list = []
                for cell in row.findall("m:c", _NS):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at - len(out))
                    value, style = _value(cell, shared), int(cell.get("s") or 0)
                    if style in dates and isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value < 2_958_466:
                        value = _moment(value, style in times, from_1904)
                    out.append(value)
                row.clear()
                yield out


def _value(cell, shared: list[str]):
    kind, value = cell.get("t"), cell.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind == "d":
        return dt.datetime.fromisoformat(value.text).replace(tzinfo=None)
    if kind in ("str", "e"):
        return value.text
    number = float(value.text)
    return int(number) if number.is_integer() else number


def _schema(path: str, sheet: str | None) -> T.StructType:
    rows = sheet_rows(path, sheet)
    header = next(rows, [])
    kinds: list[set] = [set() for _ in header]
    for _, row in zip(range(100), rows):
        for seen, value in zip(kinds, row):
            if value is not None:
                seen.add(type(value))
    spark = {frozenset([int]): T.LongType(), frozenset([float]): T.DoubleType(), frozenset([int, float]): T.DoubleType(), frozenset([bool]): T.BooleanType(), frozenset([dt.datetime]): T.TimestampNTZType()}
    return T.StructType([T.StructField(str(name or f"column_{i}"), spark.get(frozenset(seen), T.StringType())) for i, (name, seen) in enumerate(zip(header, kinds))])


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str], sheet: str | None):
        self.schema, self.paths, self.sheet = schema, paths, sheet

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]  # one sheet: a million rows at most

    def read(self, partition: _File) -> Iterator[tuple]:
        rows = sheet_rows(partition.path, self.sheet)
        next(rows, None)
        for row in rows:
            row = (row + [None] * len(self.schema))[: len(self.schema)]
            yield tuple(_cast(v, f.dataType) for v, f in zip(row, self.schema))


def _cast(value, kind: T.DataType):
    try:
        if value is None:
            return None
        if isinstance(kind, T.StringType):
            return str(value)
        if isinstance(kind, T.TimestampNTZType):
            return value if isinstance(value, dt.datetime) else None
        if isinstance(value, dt.datetime):
            return None
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else None
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except (TypeError, ValueError):
        return None


def _local(path: str) -> str:
    """The path as Python opens it; executors and driver have to see the same files."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"spreadsheets are opened as local or mounted files, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


def _files(path: str) -> list[str]:
    found = sorted(glob.glob(_local(path))) or [_local(path)]
    return found


@dataclass
class _Staged(WriterCommitMessage):
    #: chunk and file of each workbook that a task has finished
    files: list[tuple[int, str]]


class _Writer(DataSourceWriter):
    """Workbooks in a folder beside the targets, put in place when all tasks are done."""

    def __init__(self, names: list[str], targets: list[str], chunked: bool):
        self.names, self.targets, self.chunked = names, targets, chunked
        self.folder = os.path.join(os.path.dirname(targets[0]), f"_{uuid.uuid4().hex}")
        os.makedirs(self.folder)

    def write(self, rows: Iterator) -> _Staged:
        done = []
        for chunk, own in itertools.groupby(rows, (lambda r: r[-1]) if self.chunked else (lambda r: 0)):
            file = os.path.join(self.folder, uuid.uuid4().hex)
            _book(file, self.names, (r[: len(self.names)] for r in own))
            done.append((chunk, file))
        return _Staged(done)

    def commit(self, messages: list[_Staged | None]) -> None:
        done = [f for m in messages if m for f in m.files]
        if not self.chunked and not done:
            _book(file := os.path.join(self.folder, "empty"), self.names, iter(()))
            done = [(0, file)]
        for chunk, file in done:
            os.replace(file, self.targets[chunk])
        shutil.rmtree(self.folder, ignore_errors=True)  # with what tasks left that ran twice

    def abort(self, messages: list[_Staged | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class ExcelSource(DataSource):
    """``spark.read.format("shoal_xlsx").option("sheet", name).load(path)``; a pattern reads several files.

    As a sink it takes ``targets``, one path a line, and with several of them
    the number of each row's target in the last column.
    """

    @classmethod
    def name(cls) -> str:
        return "shoal_xlsx"

    def schema(self) -> T.StructType:
        return _schema(_files(self.options["path"])[0], self.options.get("sheet"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, _files(self.options["path"]), self.options.get("sheet"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        chunked = self.options.get("chunked") == "true"
        return _Writer(schema.names[:-1] if chunked else schema.names, self.options["targets"].split("\n"), chunked)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, *, n_rows: int | None = None) -> DataFrame:
    """A sheet as a DataFrame; with several sheets one has to be named.

    A pattern reads several files, each by a task of its own; the first
    tells columns and types.
    """
    if sheet is None and len(names := sheet_names(_files(path)[0])) > 1:
        raise ValueError(f"choose one of the sheets {names}")
    spark.dataSource.register(ExcelSource)
    reader = spark.read.format("shoal_xlsx")
    out = (reader.option("sheet", sheet) if sheet else reader).load(path)
    return out.limit(n_rows) if n_rows else out


def write_excel(df: DataFrame, path: str) -> None:
    """Write one sheet, rows in the order of ``df``; zone information of times is removed."""
    write_sheets(df.coalesce(1), [path])


def write_sheets(df: DataFrame, targets: list[str], chunk: str | None = None) -> None:
    """A workbook of one sheet for each target, written by the tasks that hold the rows.

    ``chunk`` names the column with the number of a row's target; rows of a
    target are in one partition, one after the other. If a task fails, no
    target has changed and nothing is left beside them.
    """
    if chunk:
        df = df.select(*[c for c in df.columns if c != chunk], chunk)
    df.sparkSession.dataSource.register(ExcelSource)
    options = {"targets": "\n".join(map(_local, targets)), "chunked": str(bool(chunk)).lower()}
    df.write.format("shoal_xlsx").options(**options).mode("append").save()


#: Rows that a sheet holds, with its header.
SHEET_ROWS = 1 << 20


def _xml(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNWRITABLE.sub("", _plain(value)))}</t></is></c>'


def _book(path: str, names: list[str], rows: Iterator) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="{relation}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
            for i, row in enumerate(itertools.chain([names], rows)):
                if i >= SHEET_ROWS:
                    raise ValueError(f"a sheet holds {SHEET_ROWS} rows; export in chunks")
                out.write(f"<row>{''.join(map(_xml, row))}</row>".encode())
            out.write(b"</sheetData></worksheet>")


def _plain(value) -> str:
    return value.replace(tzinfo=None).isoformat(" ") if isinstance(value, dt.datetime) else str(value)
