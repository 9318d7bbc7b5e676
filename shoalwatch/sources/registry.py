"""Importers: what reads a file, and which one a file asks for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwatch.sources.csv import read_csv
from shoalwatch.sources.excel import read_excel


@runtime_checkable
class Importer(Protocol):
    """``name`` as users read it; ``suggests`` by name and beginning; ``load`` for the whole or the first rows."""

    name: str

    def suggests(self, path: str, start: str) -> bool: ...

    def load(self, spark: SparkSession, path: str, *, n_rows: int | None = None, **options) -> DataFrame: ...


@dataclass(frozen=True)
class FileImporter:
    """An importer by suffix, or by the characters that files of its kind begin with."""

    name: str
    suffix: str
    read: Callable[..., DataFrame]
    starts: tuple[str, ...] = ()

    def suggests(self, path: str, start: str) -> bool:
        return path.lower().endswith(self.suffix) or any(start.startswith(s) for s in self.starts)

    def load(self, spark: SparkSession, path: str, *, n_rows: int | None = None, **options) -> DataFrame:
        return self.read(spark, path, n_rows=n_rows, **options)


def _limited(df: DataFrame, n_rows: int | None) -> DataFrame:
    return df.limit(n_rows) if n_rows else df


#: In the order in which they are asked.
IMPORTERS: list[Importer] = [
    FileImporter("CSV", ".csv", read_csv),
    FileImporter("Excel", ".xlsx", read_excel, ("PK\x03\x04",)),
    FileImporter("Parquet", ".parquet", lambda spark, path, n_rows=None: _limited(spark.read.parquet(path), n_rows), ("PAR1",)),
    FileImporter("JSON", ".json", lambda spark, path, n_rows=None: _limited(spark.read.option("multiLine", True).json(path), n_rows), ("[{", "{")),
]


def register(importer: Importer) -> None:
    """Ask a further importer before those that are there."""
    if not isinstance(importer, Importer):
        raise TypeError(f"{importer!r} isn't an importer")
    IMPORTERS.insert(0, importer)


def suggest(path: str, spark: SparkSession | None = None) -> Importer | None:
    """The importer for a file's suffix, whatever its case; with a session, else for its first characters.

    A file of none of the known kinds that begins with a line of separated
    fields is CSV.
    """
    if found := next((i for i in IMPORTERS if i.suggests(path, "")), None):
        return found
    if spark is None:
        return None
    lines = [r[0] for r in spark.read.text(path).select(F.substring("value", 1, 1000)).limit(2).collect()]
    start = lines[0].lstrip("\ufeff").lstrip() if lines else ""
    if found := next((i for i in IMPORTERS if i.suggests("", start)), None):
        return found
    separated = "\ufffd" not in start and "\0" not in start and any(s in start for s in ",;\t|")
    return next((i for i in IMPORTERS if i.name == "CSV"), None) if separated else None


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    if (importer := suggest(path, spark)) is None:
        raise ValueError(f"no importer reads {path}")
    return importer.load(spark, path, **options)
