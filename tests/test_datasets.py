"""Sources, sinks, meaning of columns, mapping, suites and workspaces."""

from __future__ import annotations

import datetime as dt
import json
import logging
import warnings
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from shoalwatch.plans import automap, compare, semantics
from shoalwatch.plans.schema import Column, Interface, Param, TimeBin, resolve_params
from shoalwatch.plans.suite import DEFAULT_SUITE, Analysis, Suite
from shoalwatch.plans.workspace import JsonFormatter, Workspace
from shoalwatch.sources import csv as csv_source
from shoalwatch.sources import excel, registry, sinks


@pytest.mark.parametrize(
    ("text", "skip", "separator"),
    [
        ("Name,Age,City\nAnn,3,Rome\nBob,4,Oslo\n", 0, ","),
        ("A note on how this table was made by hand\nAnother note that ends with one comma : ,\nA,B,C\n1,2,3\n4,5,6\n", 2, ","),
        ("A single note\nid;user name;text;date;count\n1;ann;hi;2024-01-01;3\n2;bob;yo;2024-01-02;4\n", 1, ";"),
    ],
)
def test_csv_dialects(spark, tmp_path, text, skip, separator):
    file = tmp_path / "x.csv"
    file.write_text(text)
    found = csv_source.detect_dialect(text.splitlines())
    assert (found.skip_rows, found.separator) == (skip, separator)
    rows = registry.load(spark, str(file)).collect()
    body = text.splitlines()[skip:]
    assert len(rows) == len(body) - 1
    assert list(rows[0].asDict()) == body[0].split(separator)
    assert csv_source.preview_csv(spark, str(file), 1).count() == 1


def test_csv_options_and_ragged_rows(spark, tmp_path):
    file = tmp_path / "x.csv"
    file.write_text("a|b\n1|'x|y'\n2|z|extra\n3\n")
    out = csv_source.read_csv(spark, str(file), csv_source.Dialect("|", "'")).collect()
    assert [tuple(r) for r in out] == [(1, "x|y"), (2, "z"), (3, None)]


@pytest.mark.parametrize("notes", ["", "A note on how this table was made by hand\nAnother note: \n"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_quoted_line_breaks(spark, tmp_path, notes, end):
    file = tmp_path / "my posts.csv"
    posts = [f"first line{end}second line", f'{end}a ""quoted"" one, with a comma{end}{end}', "short"]
    body = [f'{i},"{post}",{i + 4}' for i, post in enumerate(posts)]
    # a repetition of the notes inside a post stays
    body.append(f'3,"A note on how this table was made by hand{end}x",7')
    file.write_bytes((notes.replace("\n", end) + end.join(["user id,text,count", *body]) + end).encode())
    dialect = csv_source.Dialect(skip_rows=notes.count("\n"))
    out = csv_source.read_csv(spark, str(file), dialect, schema="user_id long, text string, count long")
    want = [(i, post.replace('""', '"'), i + 4) for i, post in enumerate(posts)]
    assert sorted(map(tuple, out.collect())) == [*want, (3, f"A note on how this table was made by hand{end}x", 7)]
    assert csv_source.read_csv(spark, str(file)).count() == 4
    assert csv_source.preview_csv(spark, str(file), 4).dtypes[0] == ("user id", "int")


@pytest.mark.parametrize("notes", [b"", b"A note, by hand\r\nand one more\n"])
def test_csv_mixed_line_ends(spark, tmp_path, notes):
    file = tmp_path / "x.csv"
    file.write_bytes(notes + b'id,text,word\r\n1,"a\r\n""b"",\nc",x\n2,"d",y\r\n3,5" e,"z\r\n"\r\n4,,w')
    dialect = csv_source.Dialect(skip_rows=notes.count(b"\n"))
    out = csv_source.read_csv(spark, str(file), dialect, schema="id long, text string, word string").collect()
    assert [tuple(r) for r in out] == [(1, 'a\r\n"b",\nc', "x"), (2, "d", "y"), (3, '5" e', "z\r\n"), (4, None, "w")]
    file.write_bytes(b"id,text\r1,a\r2,b\r")
    assert [r["text"] for r in csv_source.read_csv(spark, str(file)).collect()] == ["a", "b"]


def test_excel(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <b>", 1.5, True), (2, None, None, False)], "id long, t string, x double, f boolean")
    path = str(tmp_path / "x.xlsx")
    excel.write_excel(df, path)
    assert excel.sheet_names(path) == ["Sheet1"]
    back = registry.load(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "t": "string", "x": "double", "f": "boolean"}
    assert sorted(back.collect()) == sorted(df.collect())


def test_excel_dates(spark, tmp_path):
    """Styled numbers are times, whatever gives the style; other numbers stay numbers."""
    path = tmp_path / "d.xlsx"
    excel.write_excel(spark.range(1), str(path))
    main = excel._NS["m"]
    formats = [(0, None), (22, None), (164, "yyyy-mm-dd"), (165, "[$-409]h:mm AM/PM;@"), (166, '0.0" days"'), (20, None), (167, "General")]
    styles = f'<styleSheet xmlns="{main}"><numFmts>' + "".join(f'<numFmt numFmtId="{i}" formatCode="{escape(c, {chr(34): "&quot;"})}"/>' for i, c in formats if c) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{i}"/>' for i, _ in formats) + "</cellXfs></styleSheet>"
    names = ["plain", "stamp", "day", "clock", "days", "time", "general", "iso"]
    numbers = [["45000.25", "45000.25", "45000", "0.5", "2.5", "0.75", "7", None], ["1", "61", "59", "0.25", "3.5", "0", "8", None]]
    row = lambda r: "".join(f'<c s="{i}"><v>{v}</v></c>' for i, v in enumerate(r) if v) + '<c t="d"><v>2024-02-29T10:00:00</v></c>'
    sheet = f'<worksheet xmlns="{main}"><sheetData><row>' + "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in names) + "</row>" + "".join(f"<row>{row(r)}</row>" for r in numbers) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path) as old:
        parts = {n: old.read(n) for n in old.namelist()} | {"xl/styles.xml": styles.encode(), "xl/worksheets/sheet1.xml": sheet.encode()}
    for base, shift in ((False, 0), (True, 1462)):
        book = parts["xl/workbook.xml"].replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>' if base else b"<sheets>")
        with zipfile.ZipFile(path, "w") as new:
            for n, data in (parts | {"xl/workbook.xml": book}).items():
                new.writestr(n, data)
        out = registry.load(spark, str(path))
        kinds = dict(out.dtypes)
        assert {n for n in names if kinds[n] == "timestamp_ntz"} == {"stamp", "day", "iso"}
        assert (kinds["plain"], kinds["days"], kinds["general"], kinds["clock"], kinds["time"]) == ("double", "double", "bigint", "string", "string")
        a, b = out.collect()
        days = dt.timedelta(days=shift)
        assert (a["stamp"], a["day"], a["iso"]) == (dt.datetime(2023, 3, 15, 6) + days, dt.datetime(2023, 3, 15) + days, dt.datetime(2024, 2, 29, 10))
        assert (a["clock"], a["time"], b["clock"], b["time"]) == ("12:00:00", "18:00:00", "06:00:00", "00:00:00")
        if not base:
            assert (b["stamp"], b["day"]) == (dt.datetime(1900, 3, 1), dt.datetime(1900, 2, 28))


def test_tables_side_by_side(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", 3.0), (None, "n", 0.0)], "k int, t string, x double")
    b = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.0), (4, "z", 3.0), (None, "m", 1.0)], "k int, t string, x double")
    found = {r["k"]: r["differing"] for r in compare.differing_rows(a, b, ["k"]).collect()}
    assert found == {1: ["x"], 3: ["k"], 4: ["k"], None: ["t", "x"]}
    assert compare.differing_rows(a, a, ["k"]).count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        compare.differing_rows(a, b.drop("t"), ["k"])
    both = compare.stacked([a.select("k"), b.select(F.col("k").cast("double").alias("k")), a.select("k", "t")], fill=True)
    assert dict(both.dtypes) == {"k": "double", "t": "string"} and both.count() == 12
    shown = compare.as_text(a.withColumn("s", F.struct("k")).withColumn("l", F.array("t")))
    assert {kind for _, kind in shown.dtypes} == {"string"}
    assert shown.where("k = 1").first()["s"] == '{"k":1}'
    batches = list(compare.record_batches(spark.range(250).withColumn("l", F.array("id")), 100))
    assert [len(x) for x in batches] == [100, 100, 50] and batches[0].schema.names == ["id", "l"]
    assert list(compare.record_batches(a.where("false"))) == []


def test_the_first_clock_format_that_fits_is_taken(spark):
    mixed = spark.createDataFrame([("10:20:30",)] + [(f"0{i}:15 pm",) for i in range(1, 9)], "c string")
    assert semantics.infer(mixed)["c"].type != "time"  # HH:mm:ss is the format, and doesn't hold for enough values
    assert semantics.infer(mixed.where("c like '%pm'"))["c"].name == "time:hh:mm a"


def test_parameters_of_secondaries_and_views(spark):
    posts = spark.createDataFrame([("m1", "short"), ("m2", "a bit longer")], "message_id string, message_text string")
    out = DEFAULT_SUITE.run("character_count", posts, secondary_params={"long_messages": {"longer_than": 6}})
    assert {r["message_id"]: r["is_long"] for r in out["long_messages"]["long_messages"].collect()} == {"m1": False, "m2": True}
    with pytest.raises(ValueError, match="no secondaries"):
        DEFAULT_SUITE.run("character_count", posts, secondary_params={"ngram_stats": {}})


def test_exports(spark, tmp_path):
    df = spark.range(250).withColumnRenamed("id", "n")
    assert sinks.export_name("a", "a") == "a" and sinks.export_name("a", "b") == "b__a"
    paths = sinks.export(df, str(tmp_path / "out"), "csv", sinks.ExportPolicy(100), order=["n"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["out_0.csv", "out_1.csv", "out_2.csv"]
    parts = [spark.read.option("header", True).csv(p) for p in paths]
    assert [p.count() for p in parts] == [100, 100, 50]
    assert sinks.export(df, str(tmp_path / "one"), "parquet", sinks.ExportPolicy(1000)) == [str(tmp_path / "one.parquet")]
    assert sinks.export(df.where("false"), str(tmp_path / "none"), "csv", sinks.ExportPolicy(100)) == []
    sinks.write(df.limit(2), str(tmp_path / "j"), "json")
    assert json.loads((tmp_path / "j.json").read_text()) == [{"n": 0}, {"n": 1}]
    assert registry.load(spark, str(tmp_path / "j.json")).count() == 2
    assert sinks.human_columns(df, {"n": "Number"}).columns == ["Number"]
    with pytest.raises(ValueError, match="nested"):
        sinks.write(spark.createDataFrame([([1],)], "a array<int>"), str(tmp_path / "x"), "csv")
    with pytest.raises(ValueError, match="100"):
        sinks.ExportPolicy(10)


def test_meanings(spark):
    rows = [(f"2025-02-{1 + i % 28:02d} 00:36:15 UTC", f"2025-02-{1 + i % 28:02d}", "14:30:15", "23:47", "https://x.y/z", f"@user{i}", "some words here", 1_700_000_000 + i, 1_700_000_000_000 + i, i, i / 2, True, None, "2025-02-28 10:00:00-05:00") for i in range(20)]
    names = ["zoned", "date", "time", "clock", "link", "handle", "text", "sec", "ms", "n", "x", "flag", "none", "offset"]
    kinds = ["string"] * 7 + ["long", "long", "long", "double", "boolean", "string", "string"]
    df = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))
    found = semantics.infer(df)
    assert {k: v.type for k, v in found.items()} == {
        "zoned": "datetime", "date": "datetime", "time": "time", "clock": "time", "link": "url", "handle": "identifier", "text": "text",
        "sec": "datetime", "ms": "datetime", "n": "integer", "x": "float", "flag": "boolean", "none": "text", "offset": "datetime",
    }
    out = semantics.prepare(df, {c: c for c in names}, found).first()
    assert (str(out["zoned"]), str(out["offset"]), out["clock"]) == ("2025-02-01 00:36:15", "2025-02-28 10:00:00", "23:47:00")
    assert str(out["sec"]) == "2023-11-14 22:13:20" == str(out["ms"])
    assert {r["column"]: r["semantic"] for r in semantics.summarize(df, found)}["link"] == "url"
    assert semantics.infer(df.where("false").select("text", "n")) == {"text": semantics.Semantic("free_text", "text"), "n": semantics.Semantic("integer", "integer")}


def test_meaning_threshold_and_zones(spark):
    mostly = spark.createDataFrame([("2025-01-01 10:00:00" if i < 7 else "no date at all",) for i in range(10)], "c string")
    assert semantics.infer(mostly)["c"].type == "text"
    assert semantics.infer(mostly, threshold=0.5)["c"].type == "datetime"
    zones = spark.createDataFrame([(f"2025-01-01 10:00:00 {z}",) for z in ("UTC", "EST", "PDT")], "c string")
    with pytest.warns(UserWarning, match="zones"):
        assert semantics.infer(zones)["c"].type == "datetime"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        semantics.infer(zones.limit(1))


def test_automap():
    assert [automap.compatibility("identifier", t) for t in ("identifier", "url", "datetime", "integer", "text", "float")] == [0, -2, -2, -3, -4, None]
    wanted = (Column("user_id", "identifier", hints=("user name",)), Column("text", "text", hints=("content",)), Column("at", "datetime"))
    assert automap.automap({"post id": "identifier", "User_Name": "integer", "Content": "identifier", "body": "text"}, wanted) == {"user_id": "User_Name", "text": "Content"}


def test_params():
    interface = Interface("i", "I", "1", params=(Param("n", 3, 1, 10), Param("w", backfill=TimeBin("day", 2))))
    assert resolve_params(interface, {}) == {"n": 3, "w": TimeBin("day", 2)}
    assert resolve_params(Interface("i", "I", "1", params=(Param("k", 5, -9, 9, backfill=7),)), {"k": 0}) == {"k": 0}
    assert (TimeBin("month", 3).spec, TimeBin("month", 3).text, TimeBin("hour", 1).text) == ("3mo", "3 months", "1 hour")
    with pytest.raises(ValueError, match="from 1 to 10"):
        resolve_params(interface, {"n": 11})
    with pytest.raises(ValueError, match="no value"):
        resolve_params(Interface("i", "I", "1", params=(Param("n", 3, 1, 10),)), {}, {"n": None})


POSTS = [(f"user{i % 3}", f"m{i}", f"buy this now please #sale{i % 2}", f"2024-01-01 0{i}:00:00") for i in range(8)]


def test_suite_and_workspace(spark, tmp_path):
    df = spark.createDataFrame(POSTS, "author string, post_id string, content string, created string")
    work = Workspace(tmp_path / "w", f"file://{tmp_path}/tables")
    assert [work.export_policy(n).chunk_rows for n in (10, 50_000, 50_001)] == [None, None, 50_000]
    assert work.export_policy(10, 700).chunk_rows == 700 and Workspace(tmp_path / "w").export_policy(60_000).chunk_rows == 700
    with pytest.raises(ValueError, match="100"):
        work.export_policy(10, 5)
    first, second = work.create_project("My Posts", df), work.create_project("my posts", df)
    assert (first, second) == ("my_posts", "my_posts_1")
    table = work.project_table(spark, first)
    assert work.project_table(spark, first, 3).count() == 3
    for analysis, output in {"ngrams": ("ngram_stats", "ngram_stats"), "hashtags": ("hashtags", "hashtag_analysis"), "temporal": ("temporal", "interval_count"), "time_coordination": ("time_coordination", "cooccurrence_frequency"), "character_count": ("long_messages", "long_messages")}.items():
        id = work.run(DEFAULT_SUITE, first, analysis, DEFAULT_SUITE.map_columns(analysis, table))
        assert work.load_table(spark, id, *output).count() > 0
        loaded = {a: {o: work.load_table(spark, id, a, o) for o in outs} for a, outs in _outputs(analysis).items()}
        for view in DEFAULT_SUITE.views_of(analysis):
            chosen = loaded["ngrams"]["ngrams"] if analysis == "ngrams" else None
            mapped = DEFAULT_SUITE.map_columns(analysis, table)
            more = {"ngram_posts": {"chosen": chosen}, "hashtag_posts": {"posts": mapped, "user_id": mapped.first()["user_id"] if analysis == "hashtags" else None, "hashtag": "#", "start": "1900-01-01 00:00:00", "end": "2100-01-01 00:00:00", "ts": "timestamp"}, "hashtag_share": {"window": "2024-01-01 00:00:00"}, "hashtag_users": {"hashtag": "#sale0"}}.get(view.id, {})
            assert view.run(loaded, **more).count() > 0
    assert len(work.analyses(first)) == 5
    with pytest.raises(ValueError, match="hashtag"):
        work.run(DEFAULT_SUITE, first, "hashtags", DEFAULT_SUITE.map_columns("hashtags", table).where("false"))
    assert len(work.analyses(first, drafts=True)) == 5
    work.update_settings(chunk=100)
    work.update_settings(kind="csv")
    assert work.settings() == {"export_chunk": 700, "chunk": 100, "kind": "csv"}
    work.rename_project(second, "A")
    assert [p["name"] for p in work.projects()] == ["A", "My Posts"]
    assert (tmp_path / "tables" / first).exists()
    work.delete_project(first)
    assert not (tmp_path / "tables" / first).exists()
    assert [p["id"] for p in work.projects()] == [second] and work.analyses(first) == []


def _outputs(analysis):
    own = [DEFAULT_SUITE.get(analysis), *DEFAULT_SUITE.secondaries(analysis)]
    return {a.interface.id: [o.id for o in a.interface.outputs] for a in own}


def test_order_of_secondaries():
    make = lambda id, *after: Analysis(Interface(id, id, "1"), lambda out, p: {}, "base", after)
    assert [a.interface.id for a in Suite([make("c", "b"), make("a"), make("b", "a")]).secondaries("base")] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="depend"):
        Suite([make("a", "b"), make("b", "a")]).secondaries("base")
    assert [a.interface.id for a in DEFAULT_SUITE.primaries(everything=False)] == ["ngrams", "hashtags"]


def test_json_logs():
    record = logging.LogRecord("n", logging.INFO, "f", 1, "hello %s", ("you",), None)
    assert json.loads(JsonFormatter().format(record))["message"] == "hello you"


def test_importers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    excel.write_excel(df, str(tmp_path / "sheet"))
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("part-*"))
    part.rename(tmp_path / "columns")
    (tmp_path / "rows").write_text('[{"id": 1, "t": "a"},\n{"id": 2, "t": "b"}]')
    (tmp_path / "fields").write_text("id;user name;text\n1;ann;x\n2;bob;y\n")
    (tmp_path / "prose").write_text("nothing but words\n")
    for file, name in {"sheet": "Excel", "columns": "Parquet", "rows": "JSON", "fields": "CSV", "prose": None}.items():
        found = registry.suggest(str(tmp_path / file), spark)
        assert (found and found.name) == name
        assert registry.suggest(str(tmp_path / file)) is None
        if found:
            assert registry.load(spark, str(tmp_path / file)).count() == 2
            assert found.load(spark, str(tmp_path / file), n_rows=1).count() == 1
    with pytest.raises(ValueError, match="no importer"):
        registry.load(spark, str(tmp_path / "prose"))
    assert registry.suggest("X.XLSX").name == "Excel"

    class Words:
        name = "Words"

        def suggests(self, path, start):
            return path.endswith(".words") or start.startswith("nothing but")

        def load(self, spark, path, *, n_rows=None, **options):
            return spark.read.text(path).select(F.explode(F.split("value", " ")).alias("word")).limit(n_rows or 1000)

    registry.register(Words())
    try:
        assert registry.load(spark, str(tmp_path / "prose"), n_rows=2).count() == 2 and registry.suggest("x.words").name == "Words"
    finally:
        del registry.IMPORTERS[0]
    with pytest.raises(TypeError):
        registry.register("Words")


def test_projects_of_the_first_layout(spark, tmp_path):
    work = Workspace(tmp_path)
    df = spark.range(3)
    project, other = work.create_project("Old", df), work.create_project("New", df)
    assert work.discover_v1(spark) == []
    df.write.parquet(str(tmp_path / project / "analyzers" / "hashtags" / "hashtag_analysis.parquet"))
    (id,) = work.discover_v1(spark)
    assert work.discover_v1(spark) == [] and work.analyses(other) == []
    assert [(a["id"], a["name"]) for a in work.analyses(project)] == [(id, "hashtags")]
    assert work.load_table(spark, id, "hashtags", "hashtag_analysis").count() == 3
    work.delete_analysis(id)
    assert work.analyses(project) == [] and not (tmp_path / project / "analyzers" / "hashtags").exists()
