import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from telar.sources import readers, writers
from telar.streaming import windows


def put(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,titulo,n\n1," Agua, ""luz"" ",\n2,corta\n3,"dos\nlíneas",x\n')
    rows, bad = readers.read_csv_text(spark, path, ["id", "titulo", "n"])
    assert sorted((r.id, r.titulo, r.n) for r in rows.collect()) == [("1", 'Agua, "luz"', None), ("3", "dos\nlíneas", "x")]
    assert bad.count() == 1


def test_json_and_features(spark, tmp_path):
    put(tmp_path / "good.json", json.dumps({"rows": [{"a": 1, "b": "x"}, {"a": None, "b": "y"}]}))
    put(tmp_path / "bad.json", "{no")
    rows, failed = readers.read_json_rows(spark, str(tmp_path), "a:int,b:string", key="rows")
    assert sorted((r.a or 0, r.b) for r in rows.collect()) == [(0, "y"), (1, "x")] and failed.count() == 1
    one = tmp_path / "geo"
    one.mkdir()
    feature = {"type": "Feature", "id": "q1", "properties": {"mag": 4.5, "time": 0, "updated": None, "place": "cerca", "status": None, "url": "u"}, "geometry": {"coordinates": [-80.5, 8.25, 10.0]}}
    put(one / "q.geojson", json.dumps({"type": "FeatureCollection", "features": [feature]}))
    r = readers.read_features(spark, str(one)).first()
    assert (r.id, r.magnitude, r.time, r.updated, r.longitude, r.depth) == ("q1", 4.5, "1970-01-01T00:00:00Z", None, -80.5, 10.0)


def test_feeds_articles_indicators(spark, tmp_path):
    rss = put(tmp_path / "f.xml", "<rss><channel><item><title> Uno </title><link>http://a</link><category>x</category><category>y</category></item><item><title>Dos</title></item></channel></rss>")
    got = {r.title: r for r in readers.read_feed(spark, rss).collect()}
    assert got["Uno"].category == ["x", "y"] and got["Dos"].link is None
    art = put(tmp_path / "gdelt_turismo_20260101000000_x.json", json.dumps({"articles": [{"url": "u", "title": " t "}]}))
    assert [(r.subject, r.title) for r in readers.read_articles(spark, art).collect()] == [("turismo", "t")]
    d = tmp_path / "wb"
    d.mkdir()
    for stamp, value in (("20260101T000000Z", 1.0), ("20260201T000000Z", 2.0)):
        put(d / f"i_{stamp}.json", json.dumps([{"page": 1}, [{"indicator": {"id": "X"}, "countryiso3code": "PAN", "date": "2020", "value": value}]]))
    assert [(r.indicator, r.year, r.value) for r in readers.read_indicator_responses(spark, str(d)).collect()] == [("X", 2020, 2.0)]


def test_text_tables_and_reports(spark, tmp_path):
    md = put(tmp_path / "t.md", "# T\n\n| caso | nota |\n|---|---|\n| a | b c |\n| d | |\nfin\n")
    assert sorted((r.caso, r.nota) for r in readers.read_markdown_table(spark, md, ["caso", "nota"]).collect()) == [("a", "b c"), ("d", None)]
    junit = put(tmp_path / "j.xml", '<testsuites><testsuite name="s" tests="3" failures="1" errors="0" skipped="1" time="0.5"><testcase/></testsuite></testsuites>')
    assert tuple(readers.read_junit(spark, junit).first()) == ("s", 3, 1, 0, 1, 0.5)


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>2026-01</t></is></c><c r="C1" t="inlineStr"><is><t>2026-02</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2"/></row>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Periodo</t></si><si><r><t>Depó</t></r><r><t>sitos</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    got = readers.read_series(spark, str(tmp_path / "s.xlsx"), "Depósitos", 1, 2)
    assert sorted((r.period, r.value) for r in got.collect()) == [("2026-01", 1.5), ("2026-02", None)]
    with pytest.raises(ValueError):
        readers.read_series(spark, str(tmp_path / "s.xlsx"), "Otra", 1, 2)


def test_states_and_routes(spark, tmp_path):
    d = spark.createDataFrame([('{"articles":[{"url":"a"},{"url":"b"}]}', 100), ('{"articles":[]}', 100), (" ", 100), ("<html>", 100), ('{"articles":[{"url":"a"},{"url":"b"}]}', 10)], "t string, s int")
    assert [r[0] for r in d.select(readers.response_state(F.col("t"), 2, F.col("s"), 30)).collect()] == ["truncado", "ok", "vacio", "invalido", "ok"]
    put(tmp_path / "rss_a.xml", "x")
    put(tmp_path / "z.bin", "x")
    assert sorted(r.kind for r in readers.route_files(spark, str(tmp_path), {"rss": "rss_"}).collect()) == ["desconocido", "rss"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 1.5), (1, "a,b", 2.0)], "id int, t string, x double")
    writers.write_csv(df, str(tmp_path / "c"), ["id", "t"], ["id"], parts=1)
    assert next((tmp_path / "c").glob("*.csv")).read_text() == 'id,t\n1,"a,b"\n2,\n'
    writers.write_json(df, str(tmp_path / "j"), ["id"])
    assert [json.loads(x) for p in sorted((tmp_path / "j").glob("*.txt")) for x in p.read_text().splitlines()] == [{"id": 1, "t": "a,b", "x": 2.0}, {"id": 2, "t": None, "x": 1.5}]
    table = str(tmp_path / "t")
    writers.write_table(df, table)
    writers.upsert_table(spark, table, spark.createDataFrame([(2, "z", 9.0), (3, "n", 1.0)], "id int, t string, x double"), ["id"])
    assert sorted(r.t for r in spark.read.parquet(table).collect()) == ["a,b", "n", "z"]
    parts = str(tmp_path / "p")
    writers.replace_source(spark.createDataFrame([("a", 1), ("b", 2)], "s string, v int"), parts, "s")
    writers.replace_source(spark.createDataFrame([("b", 3)], "s string, v int"), parts, "s")
    assert sorted((r.s, r.v) for r in spark.read.parquet(parts).collect()) == [("a", 1), ("b", 3)]
    writers.append_log(df, str(tmp_path / "l"))
    writers.append_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    assert {len(r.sha256) for r in writers.file_prints(spark, str(tmp_path / "c")).collect()} == {64}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    entries = spark.createDataFrame([("q1", "r1"), ("q1", "r1"), ("q2", "r2")], "request string, response string")
    assert writers.put_in_cache(spark, path, entries, "request").count() == 2
    assert writers.put_in_cache(spark, path, entries, "request").count() == 0
    asked = spark.createDataFrame([("q1",), ("q9",)], "request string")
    assert sorted((r.request, r.response or "") for r in writers.get_from_cache(spark, path, asked, "request").collect()) == [("q1", "r1"), ("q9", "")]


def test_stream_in_several_batches(spark, tmp_path):
    path = tmp_path / "events"
    for i in range(3):
        spark.createDataFrame([(i, "2026-01-01 00:00:00", "u", 1.0), (i + 10, "2026-01-02 00:00:00", "v", 2.0)], "id long, s string, u string, x double").withColumn("ts", F.to_timestamp("s")).write.mode("append").parquet(str(path))
    stream = windows.file_stream(spark, str(path), files_per_trigger=1)
    got = windows.run_once(windows.windowed_counts(stream, "ts", ["u"], "x", "1 day"), "complete")
    assert sorted((r.u, r.n, r.total) for r in got.collect()) == [("u", 3, 3.0), ("v", 3, 6.0)]
    once = windows.run_once(windows.first_seen(windows.file_stream(spark, str(path), 1), "ts", ["u"]), "append")
    assert sorted(r.u for r in once.collect()) == ["u", "v"]


def test_late_rows_and_evicted_windows(spark, tmp_path):
    """Files come one after another; a row behind the watermark is dropped, one within it counts, open windows stay back."""
    path, seen = tmp_path / "events", set()
    days = [["01 10:00", "01 11:00"], ["05 09:00"], ["05 10:00"], ["01 12:00", "04 23:30"], ["09 00:00"]]
    for i, moments in enumerate(days):
        rows = [(j, f"2026-01-{m}:00", "u", 1.0) for j, m in enumerate(moments)]
        spark.createDataFrame(rows, "id long, s string, u string, x double").withColumn("ts", F.to_timestamp("s")).coalesce(1).write.mode("append").parquet(str(path))
        for p in set(path.glob("*.parquet")) - seen:
            os.utime(p, (1_700_000_000 + 60 * i,) * 2)  # files are read in the order of their times
            seen.add(p)
    stream = windows.file_stream(spark, str(path), files_per_trigger=1)
    got = windows.run_once(windows.windowed_counts(stream, "ts", ["u"], "x", "1 day", late="1 day"), "append")
    # The 1st closes with two rows: the third came when the watermark was at the 4th. The 9th is open.
    assert sorted((r.start.day, r.n) for r in got.collect()) == [(1, 2), (4, 1), (5, 2)]
    state = windows.run_once(windows.last_state(windows.file_stream(spark, str(path), 1), ["u"], F.col("ts"), ["id", "ts"]), "update", ["u"])
    assert [(r.u, r.ts.day) for r in state.collect()] == [("u", 9)]


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    table = str(tmp_path / "t")
    writers.write_table(spark.createDataFrame([(1, "a")], "id int, t string"), table)
    bad = spark.range(3).select(F.col("id").cast("int").alias("id"), F.raise_error(F.lit("roto")).cast("string").alias("t"))
    with pytest.raises(Exception, match="roto"):
        writers.write_table(bad, table)
    assert [r.t for r in spark.read.parquet(table).collect()] == ["a"]
    writers.write_table(spark.read.parquet(table).withColumn("t", F.lit("b")), table)
    assert [r.t for r in spark.read.parquet(table).collect()] == ["b"]
    writers.append_positional(spark.createDataFrame([("7", "z")], "x string, y string"), table)
    assert sorted((r.id, r.t) for r in spark.read.parquet(table).collect()) == [(1, "b"), (7, "z")]
    with pytest.raises(ValueError):
        writers.append_positional(spark.range(1), table)


def test_sheets_caches_and_trees(spark, tmp_path):
    sheet = str(tmp_path / "s")
    empty, full = (spark.createDataFrame([(1, v)], "id int, v string") for v in (None, "sí"))
    assert writers.write_once(empty, sheet, "v") and writers.write_once(full, sheet, "v") and not writers.write_once(empty, sheet, "v")
    cache = str(tmp_path / "c")
    writers.put_in_cache(spark, cache, spark.createDataFrame([("q1", "r1"), ("q2", "r2")], "request string, response string"), "request")
    assert writers.prune_cache(spark, cache, spark.createDataFrame([("q2",), ("q3",)], "request string"), "request") == 1
    assert [r.request for r in spark.read.parquet(cache).collect()] == ["q2"]
    put(tmp_path / "tree" / "a.txt", "x")
    put(tmp_path / "tree" / "b.log", "x")
    before = spark.createDataFrame(writers.file_prints(spark, str(tmp_path / "tree")).collect())
    put(tmp_path / "tree" / "a.txt", "y")
    put(tmp_path / "tree" / "b.log", "y")
    put(tmp_path / "tree" / "n.txt", "z")
    changes = writers.tree_changes(before, writers.file_prints(spark, str(tmp_path / "tree")), skip=r"\.log$")
    assert sorted((r.file.rsplit("/", 1)[1], r.state) for r in changes.collect()) == [("a.txt", "changed"), ("n.txt", "new")]
