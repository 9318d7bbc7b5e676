"""Rows of CSV files with line breaks in quoted fields, cut in parallel.

A file is read in splits, and each split's lines are packed into pieces. A
piece doesn't know whether it begins within a quoted field, so it is followed
through from both states; what comes out, as a function of what goes in, is
one of four, and composing the functions of the pieces before it gives each
piece its state. Then all pieces are cut into rows at once. What a piece has
of a row that began earlier joins the piece in which it began.

Only pieces' states, one narrow row each, meet by file; texts stay where they
are but for the rows that cross a border.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalwatch.session import written

#: Characters of a piece; a longer line is a piece of its own.
PIECE = 1 << 18
_BOM = "\ufeff"


def open_after(line: str, inside: bool, separator: str, quote: str) -> bool:
    """Whether a quoted field is open at the end of a line, from its state at the start.

    A quote opens a field only at its start; a doubled one stays inside.
    """
    at = 0
    while True:
        if not inside:
            if not line.startswith(quote, at):
                if (found := line.find(separator, at)) < 0:
                    return False
                at = found + 1
                continue
            at += 1
        if (at := line.find(quote, at)) < 0:
            return True
        inside = line.startswith(quote, at + 1)  # a doubled one
        at += 2
        if not inside:
            if (found := line.find(separator, at - 1)) < 0:
                return False
            at = found + 1


class _Follower:
    """Lines of one piece, and its ends from both beginnings."""

    def __init__(self, separator: str, quote: str):
        self.separator, self.quote = separator, quote
        self.lines: list[str] = []
        self.size = 0
        self.open = [False, True]
        #: whether a row begins here if the piece begins within a field
        self.begins = False

    def add(self, line: str, quoted: bool) -> None:
        self.begins |= not self.open[1]
        if quoted:
            first = open_after(line, self.open[0], self.separator, self.quote)
            self.open = [first, first if self.open[0] == self.open[1] else open_after(line, self.open[1], self.separator, self.quote)]
        self.lines.append(line)
        self.size += len(line) + 1


_PIECES = "file string, block long, number long, text string, open0 boolean, open1 boolean, begins1 boolean"


def _pieces(separator: str, quote: str, notes: list[str], line_break: str, most: int):
    """Pack lines; a file that begins with ``notes`` loses them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _PIECES.split(", ")]
        where, number, piece, waiting, done = None, 0, None, [], []

        def close() -> None:
            nonlocal number, piece
            if piece.lines:
                done.append((*where, number, line_break.join(piece.lines), *piece.open, piece.begins))
                number += 1
            piece = _Follower(separator, quote)

        def undo() -> None:
            """These lines weren't the notes."""
            for line in waiting:
                piece.add(line, quote in line)
            waiting.clear()

        def check() -> None:
            if noted:
                raise ValueError("the leading notes are longer than the file's first split; raise spark.sql.files.openCostInBytes")

        noted = False
        for batch in batches:
            quoted = pc.match_substring(batch.column(0), quote).to_pylist()
            for line, file, block, has in zip(*(batch.column(i).to_pylist() for i in range(3)), quoted):
                if (file, block) != where:
                    if where:
                        check()
                        close()
                    where, number, piece, noted = (file, block), 0, _Follower(separator, quote), bool(notes) and block == 0
                    if block == 0:
                        line = line.removeprefix(_BOM)
                if noted:
                    waiting.append(line)
                    if line.rstrip("\r") != notes[len(waiting) - 1]:
                        noted = False
                        undo()
                    elif len(waiting) == len(notes):
                        noted = False
                        waiting.clear()
                    continue
                if piece.size and piece.size + len(line) > most:
                    close()
                piece.add(line, has)
            if sum(len(d[3]) for d in done) >= 8 * most:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
                done.clear()
        if where:
            check()
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)

    return pack


def _states(pieces: DataFrame) -> DataFrame:
    """``file, block, number, at, inside, origin``: each piece's place, state and where an open row began."""
    before = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.col("open0") & ~F.col("open1")
    rows = pieces.select("file", "block", "number", "begins1", F.when(F.col("open0") == F.col("open1"), F.col("open0")).alias("sure"), F.sum(swaps.cast("long")).over(so_far).alias("swaps"), F.row_number().over(Window.partitionBy("file").orderBy("block", "number")).alias("at"))
    # the last piece that ends in one state whatever came before, and the changes since
    last = F.last(F.when(F.col("sure").isNotNull(), F.struct("sure", "swaps")), ignorenulls=True).over(before)
    rows = rows.withColumns({"last": last, "changes": F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block", "number")), F.lit(0))})
    inside = (F.coalesce(F.col("last.sure"), F.lit(False)).cast("long") + F.col("changes") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    rows = rows.withColumn("inside", inside)
    began = F.last(F.when(~F.col("inside") | F.col("begins1"), F.col("at")), ignorenulls=True).over(before)
    return rows.withColumn("origin", began).select("file", "block", "number", "at", "inside", "origin")


def _cut_lines(lines: list[str], inside: bool, separator: str, quote: str, line_break: str) -> tuple[list[str], bool]:
    """Rows of lines, and whether the last one is open; the first one may have begun earlier."""
    rows, row = [], []
    for line in lines:
        row.append(line)
        if quote in line:
            inside = open_after(line, inside, separator, quote)
        if not inside:
            rows.append(line_break.join(row).removesuffix("\r"))
            row = []
    if row:
        rows.append(line_break.join(row))
    return rows, bool(row)


def whole_rows(lines: list[str], separator: str, quote: str, line_break: str) -> list[str]:
    """Rows of the first lines of a file."""
    return _cut_lines(lines, False, separator, quote, line_break)[0]


_ROWS = "file string, key long, at long, text string, header boolean"


def _cut(separator: str, quote: str, line_break: str):
    """Rows of pieces: whole ones with a null ``key``, else the piece in which the row began."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _ROWS.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                file, at, inside, origin, text = (batch.column(i)[k].as_py() for i in range(5))
                rows, after = _cut_lines(text.split(line_break), inside, separator, quote, line_break)
                keys: list[int | None] = [None] * len(rows)
                if after:
                    keys[-1] = at
                if inside:
                    keys[0] = origin
                head = [False] * len(rows)
                if at == 1 and (first := next((i for i, r in enumerate(rows) if r), None)) is not None:
                    head[first] = True  # the first row of a file that isn't blank
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(keys, pa.int64()), pa.array([at] * len(rows), pa.int64()), pa.array(rows, pa.string()), pa.array(head, pa.bool_())], names=names)

    return cut


def quoted_rows(spark: SparkSession, path: str, separator: str, quote: str, *, header: bool, notes: list[str] | None = None, line_break: str = "\n", piece: int = PIECE) -> DataFrame:
    """``text``: a CSV row each, with its line breaks, without headers, notes and blank lines.

    Rows end at ``line_break``, and a ``\\r`` before it goes; those within
    fields stay as they are. A field that is never closed takes all that
    follows in its file. Rows keep no order. The pieces are one copy of the
    files in the shared folder; rows are cut from it when they are read.
    """
    lines = spark.read.text(path, lineSep=line_break).select("value", "_metadata.file_path", "_metadata.file_block_start")
    pieces = written(lines.mapInArrow(_pieces(separator, quote, notes or [], line_break, piece), _PIECES), "pieces")
    states = written(_states(pieces), "states")
    known = pieces.join(states, ["file", "block", "number"]).select("file", "at", "inside", "origin", "text")
    rows = known.mapInArrow(_cut(separator, quote, line_break), _ROWS)
    whole = rows.where("key is null").select("text", "header")
    parts = written(rows.where("key is not null"), "parts").groupBy("file", "key").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"), F.max("header").alias("header"))
    out = whole.union(parts.select(F.array_join("p.text", line_break), "header")).where("text != ''")
    return (out.where("not header") if header else out).select("text")


def open_lines(spark: SparkSession, path: str, separator: str, quote: str) -> int:
    """Lines that leave a quoted field open, if none before did."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(open_after(line, False, separator, quote) for line in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    lines = spark.read.text(path, lineSep="\n").where(F.contains("value", F.lit(quote)))
    return lines.mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
