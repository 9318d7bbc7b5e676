"""CSV rows cut in parallel, against a reader that sees each file as a whole."""

from __future__ import annotations

import csv
import io
import random

import pyarrow as pa
import pytest

from shoalwatch.sources import csv as csv_source
from shoalwatch.sources import quoted
from shoalwatch.sources.csv import Dialect, read_csv

SCHEMA = "a string, b string, c string"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "700")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def field(rng):
    """Text with all that makes rows hard to cut."""
    return "".join(rng.choice(['"', '""', "\n", "\n\n", ",", '",', ',"', '"\n', "word ", "\r\n", "é", " "]) if rng.random() < 0.4 else rng.choice("abc 12") for _ in range(rng.choice([0, 1, 3, 8, 30])))


def body(rows, end, rng):
    out = io.StringIO()
    for row in rows:
        cells = [f'"{x.replace(chr(34), chr(34) * 2)}"' if any(c in x for c in '",\n\r') or rng.random() < 0.2 else x for x in row]
        out.write(",".join(cells) + (end if isinstance(end, str) else rng.choice(end)))
    return out.getvalue()


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("piece", [1 << 18, 60])
def test_random_tables(spark, tmp_path, small_splits, seed, piece, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(csv_source, "quoted_rows", lambda *a, **k: quoted.quoted_rows(*a, **k, piece=piece))
    rows = [(str(i), field(rng), field(rng)) for i in range(rng.choice([1, 40, 150]))]
    if seed == 3:
        rows[0] = ("0", "\n".join(["a long passage, and \"more\""] * 300), "")  # one row over many splits
    end = ["\n", "\r\n", ["\n", "\r\n"]][seed % 3]
    notes = "" if seed < 2 else "A note on how this table was made\nand, a second one\n"
    files = [rows[: len(rows) // 2], rows[len(rows) // 2 :]] if seed == 4 else [rows]
    for k, part in enumerate(files):
        (tmp_path / f"{k}.csv").write_bytes((notes + body([("a", "b", "c")], end, rng) + body(part, end, rng)).encode())
    got = read_csv(spark, str(tmp_path), Dialect(skip_rows=notes.count("\n")), schema=SCHEMA)
    want = sorted((a, b or None, c or None) for a, b, c in rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    inferred = read_csv(spark, str(tmp_path), Dialect(skip_rows=notes.count("\n")))
    assert inferred.dtypes[0] == ("a", "int") and inferred.columns == ["a", "b", "c"] and inferred.count() == len(rows)


def test_one_file_in_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(9)
    rows = [(str(i), "first line\nsecond, line", field(rng)) for i in range(400)]
    (tmp_path / "x.csv").write_text(body([("a", "b", "c"), *rows], "\n", rng))
    lines = spark.read.text(str(tmp_path / "x.csv"), lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start")
    assert lines.rdd.getNumPartitions() >= 20
    sizes = [r["n"] for r in lines.mapInArrow(quoted._pieces(",", '"', [], "\n", 200), quoted._PIECES).groupBy("block").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) >= 20
    assert read_csv(spark, str(tmp_path / "x.csv"), Dialect(), schema=SCHEMA).count() == 400


def test_states_compose():
    """A piece followed from both states says the same as following all lines in turn."""
    rng = random.Random(1)
    for _ in range(200):
        lines = body([(field(rng), field(rng)) for _ in range(5)], "\n", rng).split("\n")
        batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(["f"] * len(lines)), pa.array([0] * len(lines), pa.int64())], names=["v", "f", "b"])
        pieces = pa.Table.from_batches(quoted._pieces(",", '"', [], "\n", 20)(iter([batch]))).to_pylist()
        assert "\n".join(p["text"] for p in pieces) == "\n".join(lines)
        inside = False
        for p in pieces:
            want = inside
            for line in p["text"].split("\n"):
                want = quoted.open_after(line, want, ",", '"')
            inside = p["open1"] if inside else p["open0"]
            assert inside == want


def test_plain_files_stay_with_spark(spark, tmp_path, small_splits, monkeypatch):
    """Files whose lines are rows are read as they are, in splits."""
    monkeypatch.setattr(csv_source, "quoted_rows", None)
    for end in ("\n", "\r\n"):
        (tmp_path / "x.csv").write_bytes((f"a,b,c{end}" + "".join(f'{i},"x, ""y""",5" e{end}' for i in range(300))).encode())
        out = read_csv(spark, str(tmp_path / "x.csv"), Dialect())
        assert out.dtypes == [("a", "int"), ("b", "string"), ("c", "string")]
        assert out.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, out.collect())) == [(i, 'x, "y"', '5" e') for i in range(300)]


def test_first_rows_alone(spark, tmp_path):
    text = 'a,b,c\n1,"x\ny",2\n\n3,z\n4,"open,5\n6,7\n'
    (tmp_path / "x.csv").write_text(text)
    first = read_csv(spark, str(tmp_path / "x.csv"), Dialect(), n_rows=2)
    assert [tuple(r) for r in first.collect()] == [(1, "x\ny", 2), (3, "z", None)] and first.dtypes[0] == ("a", "int")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), Dialect(), n_rows=9, schema=SCHEMA).collect()][2] == ("4", "open,5\n6,7", None)
    assert sorted(read_csv(spark, str(tmp_path / "x.csv"), Dialect(), schema=SCHEMA).collect())[2]["b"].rstrip("\n") == "open,5\n6,7"
    no_header = read_csv(spark, str(tmp_path / "x.csv"), Dialect(header=False, skip_rows=1))
    assert no_header.columns == ["_c0", "_c1", "_c2"]
    for empty in ("", "a,b\n"):
        (tmp_path / "e.csv").write_text(empty)
        assert read_csv(spark, str(tmp_path / "e.csv"), Dialect()).count() == 0
        assert read_csv(spark, str(tmp_path / "e.csv"), Dialect(), n_rows=3).count() == 0


def test_rows_as_python_reads_them(spark, tmp_path):
    rng = random.Random(5)
    rows = [(str(i), field(rng).replace("\r", ""), "z") for i in range(60)]
    text = body([("a", "b", "c"), *rows], "\n", rng)
    (tmp_path / "x.csv").write_text(text, newline="")
    want = sorted((a, b or None, c) for a, b, c in list(csv.reader(io.StringIO(text, newline="")))[1:])
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "x.csv"), Dialect(), schema=SCHEMA).collect())) == want
