from pyspark.sql import functions as F

from hourloom.sources import readers as rd


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bundled_documents_are_those_of_single_files(spark, tmp_path):
    docs = [("E1", "10", 1, " first \n line "), ("E1", "10", 2, "\n"), ("E_2", "11", 1, 'quoted "text" \\ é')]
    for event, message, version, text in docs:
        (tmp_path / "files" / event).mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / event / f"{message}_v{version}.txt").write_text(text, encoding="utf-8")
    lines = spark.createDataFrame([(f"{e}/{m}_v{v}.txt", t) for e, m, v, t in docs], "path string, text string")
    lines.select(F.to_json(F.struct("path", "text")).alias("value")).coalesce(1).write.text(str(tmp_path / "lines"))
    single, bundled = rd.scan_documents(spark, str(tmp_path / "files")), rd.scan_documents(spark, str(tmp_path / "lines"), r"([^/]+)/([^/]+)_v(\d+)\.txt$", bundled=True)
    assert rows(single) == rows(bundled) == sorted([("E1", "10", 1, "first \n line"), ("E1", "10", 2, ""), ("E_2", "11", 1, 'quoted "text" \\ é')])


def test_bundled_payloads_are_those_of_single_files(spark, tmp_path):
    payloads = ['[{"event_id": "a", "reduction": 1.0}, {"event_id": "b"}]', '{"events": [{"event_id": "c", "reduction": 2.5}]}', "[]"]
    (tmp_path / "files").mkdir()
    (tmp_path / "lines").mkdir()
    for k, p in enumerate(payloads):
        (tmp_path / "files" / f"{k}.json").write_text(p)
    (tmp_path / "lines" / "all.jsonl").write_text("\n".join(payloads) + "\n")
    schema = "struct<event_id:string,reduction:double>"
    key = lambda df: sorted((r.event_id, r.reduction or 0.0) for r in df.collect())
    assert key(rd.scan_event_file(spark, str(tmp_path / "files"), schema)) == key(rd.scan_event_file(spark, str(tmp_path / "lines"), schema, bundled=True))
    assert key(rd.scan_event_file(spark, str(tmp_path / "lines"), schema, bundled=True)) == [("a", 1.0), ("b", 0.0), ("c", 2.5)]
