import json

from pyspark.sql import functions as F

from telar.operators.row_recovery import load_lines
from telar.sources import jobs, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_raw_files_become_contract_tables(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    articles = [{"url": "https://www.d.example/a?utm_x=1", "title": "Uno", "seendate": "20260601T101112Z", "domain": "d.example", "language": "Spanish"}, {"url": "http://d.example/a/", "title": "Dos", "seendate": "2026-06-01"}, {"url": None}]
    put(raw / "a" / "gdelt_agua_20260601000000_x.json", json.dumps({"articles": articles}))
    feature = {"type": "Feature", "id": "q1", "properties": {"mag": 2.5, "time": 0, "updated": 1000, "place": "p"}, "geometry": {"coordinates": [1.0, 2.0, 3.0]}}
    put(raw / "q" / "q.json", json.dumps({"features": [feature, feature]}))
    report = jobs.convert_all(spark, {"articulos": str(raw / "a"), "sismos": str(raw / "q")}, out, "2026-06-02T00:00:00Z")
    assert [(r["step"], r["state"]) for r in report] == [("articulos", "ok"), ("sismos", "ok")]
    news = spark.read.parquet(f"{out}/articulos").collect()
    assert [(r.titulo, r.fecha_publicacion, r.tema, r.motivo_fecha) for r in news] == [("Uno", "2026-06-01T10:11:12Z", "agua", None)] and news[0].id_noticia.startswith("NOT-")
    assert spark.read.parquet(f"{out}/sismos").count() == 1
    failed = jobs.convert_all(spark, {"articulos": str(raw / "none"), "sismos": str(raw / "q")}, out, "x")
    assert [r["state"] for r in failed] == ["error", "omitido"]


def test_valid_rows_per_contract(spark, tmp_path):
    good = "NOT-0123456789,T,https://d.example/a,D,es,2026-06-01T00:00:00Z,,2026-06-02T00:00:00Z,agua,RSS,titular"
    df = spark.createDataFrame([(1, "noticias", "f", 1, good), (2, "noticias", "f", 2, "a,b")], "id long, c string, f string, p int, l string")
    assert jobs.write_valid(load_lines(df, "id", "c", "f", "p", "l"), str(tmp_path)) == ["noticias", "indicadores"]
    assert [spark.read.parquet(str(tmp_path / n)).count() for n in ("noticias", "indicadores", "errores")] == [1, 0, 1]


def test_folders_copies_and_reports(spark, tmp_path):
    for name in ("20260101", "20260301", "20260201"):
        put(tmp_path / "runs" / name / "x", "1")
    assert jobs.keep_last_runs(spark, str(tmp_path / "runs"), 2) == ["20260101"] and jobs.keep_last_runs(spark, str(tmp_path / "runs"), 5) == []
    source = str(tmp_path / "t")
    writers.write_table(spark.range(3), source)
    double = lambda d: d.withColumn("d", F.col("id") * 2)
    first, made = jobs.derived_copy(spark, source, str(tmp_path / "c"), "banca", double)
    assert made and jobs.derived_copy(spark, source, str(tmp_path / "c"), "banca", double) == (first, False)
    writers.write_table(spark.range(4), source)
    assert jobs.derived_copy(spark, source, str(tmp_path / "c"), "banca", double)[1]
    put(tmp_path / "r" / "a_2026.csv", "1")
    put(tmp_path / "r" / "a_2027.csv", "1")
    assert jobs.newest_reports(spark, str(tmp_path / "r"), {"a": "a_", "b": "b_"}) == {}
    assert jobs.newest_reports(spark, str(tmp_path / "r"), {"a": "a_"})["a"].endswith("a_2027.csv")


def test_logs_exports_and_measurements(spark, tmp_path):
    put(tmp_path / "l" / "a.json", json.dumps([{"url": "u1", "reason": "r"}]))
    put(tmp_path / "l" / "b.json", json.dumps({"failures": [{"url": "u2", "reason": None}]}))
    put(tmp_path / "l" / "c.json", "{roto")
    assert sorted(r.url for r in jobs.read_failure_log(spark, str(tmp_path / "l")).collect()) == ["u1", "u2"]
    df = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, True, "y"), ("a", 3, False, "z"), ("b", 1, False, "w")], "k string, n int, ok boolean, t string")
    jobs.export_last(df, str(tmp_path / "e"), ["k"], ["n"], "ok")
    assert [json.loads(r.value)["t"] for r in spark.read.text(str(tmp_path / "e")).collect()] == ["y"]
    found = jobs.measure_encoder(lambda: lambda ts: [len(t) for t in ts], ["a"] * 100)
    assert found["texts"] == 100 and found["texts_per_s"] > 0 and found["max_rss"] > 0


def test_texts_are_encoded_once_for_each_model(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, "z")], "id int, t string")
    want = {1: [3.0, 1.0], 2: [3.0, 1.0], 3: None, 4: [1.0, 1.0]}
    for rows, model, calls in ((df, "m@1", 2), (df, "m@1", 2), (df.union(spark.createDataFrame([(5, "nuevo")], df.schema)), "m@1", 3), (df, "m@2", 5)):
        got = {r.id: r.embedding for r in jobs.encode_cached(rows, "t", encoder, 2, model, path).collect()}
        assert {k: got[k] for k in want} == want and seen.value == calls
    assert spark.read.parquet(path).columns == ["__key", "__v"]
