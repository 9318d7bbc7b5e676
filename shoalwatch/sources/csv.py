"""CSV source: dialect detection on the driver, reading in Spark."""

from __future__ import annotations

import csv
import io
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwatch.sources.quoted import open_lines, quoted_rows, whole_rows

# fixed values: what marks a header
KEYWORDS = ("id", "name", "date", "time", "user", "tweet", "text", "count", "number", "sent", "screen", "retweeted", "favorited")
NO_HEADER_STARTS = ("http", "www", "from ", "if you")
SEPARATORS = (",", ";", "\t", "|")
#: Lines looked at for leading notes, and characters for the separator.
LINES, SAMPLE_CHARS = 51, 65536
_BOM = "\ufeff"


@dataclass(frozen=True)
class Dialect:
    separator: str = ","
    quote: str = '"'
    header: bool = True
    skip_rows: int = 0


def looks_like_header(fields: list[str]) -> bool:
    """Two fields or more, half of them filled, that read like column names.

    They do if the share of fields with a keyword and the share of fields of
    a name's length come to a half together.
    """
    filled = [f.strip().lower() for f in fields if f.strip()]
    if len(fields) < 2 or len(filled) < max(1, len(fields) // 2):
        return False
    named = [f for f in filled if any(k in f for k in KEYWORDS)]
    short = [f for f in filled if 3 <= len(f) <= 30 and not f.startswith(NO_HEADER_STARTS)]
    return (len(named) + len(short)) / len(filled) >= 0.5


def _head(spark: SparkSession, path: str, line_break: str = "\n") -> list[str]:
    lines = spark.read.text(path, lineSep=line_break).limit(LINES).collect()  # a fixed number of lines
    return [r[0].removesuffix("\r").removeprefix(_BOM) for r in lines]


def _line_break(spark: SparkSession, path: str) -> str:
    """What ends lines: ``\\n``, or ``\\r`` in a file that has no other."""
    start = [r[0] for r in spark.read.text(path, lineSep="\n").select(F.substring("value", 1, SAMPLE_CHARS)).limit(2).collect()]
    return "\r" if len(start) == 1 and "\r" in start[0][:-1] else "\n"


def detect_dialect(lines: list[str]) -> Dialect:
    """Leading notes, separator and quote from the first lines of a file.

    Rows to skip end at the first line that reads like a header, else at the
    first with the commonest number of fields.
    """
    try:
        split = lambda sep: [(i, next(csv.reader([line], delimiter=sep))) for i, line in enumerate(lines[:LINES]) if line.strip()]
        regular = lambda sep: max(Counter(len(f) for _, f in split(sep) if len(f) > 1).values(), default=0)
        parsed = split(max(SEPARATORS, key=regular))  # the first of equals
        skip = next((i for i, fields in parsed if looks_like_header(fields)), None)
        if skip is None:
            common = Counter(len(f) for _, f in parsed if len(f) > 1).most_common(1)
            skip = next((i for i, f in parsed if common and len(f) == common[0][0]), 0)
    except (csv.Error, StopIteration):
        skip = 0
    try:
        found = csv.Sniffer().sniff("\n".join(lines[skip:])[:SAMPLE_CHARS])
        return Dialect(found.delimiter, found.quotechar or '"', True, skip)
    except csv.Error:
        return Dialect(skip_rows=skip)


def _plain_rows(spark: SparkSession, path: str, dialect: Dialect) -> str | None:
    """What ends the rows if every line is one, as Spark's reader cuts them; else None.

    A line that leaves a quote open isn't a row, and line ends that differ
    within a table need to be told from those in fields.
    """
    lines = spark.read.text(path, lineSep="\n")
    n, cr, quoted = lines.agg(F.count(F.lit(1)), F.count_if(F.col("value").endswith("\r")), F.count_if(F.contains("value", F.lit(dialect.quote)))).first()
    if n and cr not in (0, n) or quoted and open_lines(spark, path, dialect.separator, dialect.quote):
        return None
    return "\r\n" if cr else "\n"


def _first_rows(spark: SparkSession, path: str, dialect: Dialect, line_break: str, n: int) -> list[str]:
    """The header and the first ``n`` rows, from as few lines as they take."""
    notes = _head(spark, path, line_break)[: dialect.skip_rows]
    want, take = n + dialect.header, 4 * (n + 1 + dialect.skip_rows)
    while True:
        lines = spark.read.text(path, lineSep=line_break).select("value", "_metadata.file_path").limit(take).collect()
        files: dict[str, list[str]] = {}
        for line, file in lines:
            files.setdefault(file, []).append(line)
        rows: list[str] = []
        for body in files.values():
            if [x.removesuffix("\r").removeprefix(_BOM) for x in body[: len(notes)]] == notes:
                body = body[len(notes) :]
            cut = [r for r in whole_rows(body, dialect.separator, dialect.quote, line_break) if r]
            rows += cut[1:] if rows and dialect.header else cut  # the first file's header stands for all
        if len(rows) > want or len(lines) < take:  # the last row may go on
            return rows[:want]
        take *= 4


def _parsed(spark: SparkSession, rows: DataFrame, reader: DataFrameReader) -> DataFrame:
    """Texts of one row each through Spark's own CSV parser."""
    return DataFrame(reader._jreader.csv(getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())), spark)


def _column_names(spark: SparkSession, header: str, options: dict) -> list[str]:
    return _parsed(spark, spark.createDataFrame([(header,)], "text string"), spark.read.options(**options | {"header": "true"})).columns


def read_csv(spark: SparkSession, path: str, dialect: Dialect | None = None, *, n_rows: int | None = None, schema: T.StructType | str | None = None, empty_texts: bool = False) -> DataFrame:
    """Read with the given or detected dialect; fields beyond the header are cut.

    Quoted fields keep their line breaks. Fields without anything in them are
    null; with ``empty_texts``, quoted ones are empty texts, as exports write
    them. Where no line leaves a quote open,
    Spark's reader reads the files in splits as they are; else, and with
    leading notes or line ends of both kinds, ``quoted_rows`` cuts the rows,
    in splits as well, and one table of them is written to the shared
    folder. Files that begin with the same notes lose them.

    Types come from all rows, or from the first ``n_rows``, which alone are
    read then; so no cell becomes null for want of fitting, unless a schema
    is given. A quote that opens a field and is never closed takes all that
    follows in its file into the field.
    """
    line_break = _line_break(spark, path)
    head = _head(spark, path, line_break)
    dialect = dialect or detect_dialect(head)
    options = {"sep": dialect.separator, "quote": dialect.quote, "escape": dialect.quote, "mode": "PERMISSIVE", "enforceSchema": "true", "maxCharsPerColumn": "-1"}
    if empty_texts:  # unquoted ones are read as a text that no field holds, so that they alone are null
        options["nullValue"] = uuid.uuid4().hex
    if n_rows is None and not dialect.skip_rows and line_break == "\n" and (end := _plain_rows(spark, path, dialect)):
        reader = spark.read.options(**options, header=str(dialect.header).lower(), lineSep=end)
        return reader.schema(schema or reader.option("inferSchema", "true").csv(path).schema).csv(path)
    options |= {"multiLine": "true", "lineSep": line_break}  # line breaks in a row stay as they are
    first = _first_rows(spark, path, dialect, line_break, n_rows or 1)
    if n_rows is None:
        rows = quoted_rows(spark, path, dialect.separator, dialect.quote, header=dialect.header, notes=head[: dialect.skip_rows], line_break=line_break)
    else:
        rows = spark.createDataFrame([(r,) for r in first[dialect.header :]], "text string").coalesce(1)
    if schema is None:
        schema = _schema(spark, rows, first, dialect, options)
    return _parsed(spark, rows, spark.read.options(**options).schema(schema))


def _schema(spark: SparkSession, rows: DataFrame, first: list[str], dialect: Dialect, options: dict) -> T.StructType:
    """Names from the first row, types from all by Spark's own rules."""
    if not first:
        return T.StructType()
    names = _column_names(spark, first[0], options)
    # a row of empty fields, which has any type, tells how many columns there are
    blank = spark.createDataFrame([(dialect.separator.join([dialect.quote * 2] * len(names)),)], "text string")
    found = _parsed(spark, blank.union(rows), spark.read.options(**options, inferSchema="true")).schema
    return T.StructType([T.StructField(name if dialect.header else f.name, f.dataType) for name, f in zip(names, found)])


def preview_csv(spark: SparkSession, path: str, n_rows: int = 5) -> DataFrame:
    return read_csv(spark, path, n_rows=n_rows)


def write_text(rows: list[list], dialect: Dialect = Dialect()) -> str:
    """CSV text of a few rows, for previews and tests."""
    out = io.StringIO()
    csv.writer(out, delimiter=dialect.separator, quotechar=dialect.quote).writerows(rows)
    return out.getvalue()
