"""What larger tables bring: numbers beyond years, files by the hundred thousand, long documents."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.operators import extract, folds, layout
from dossier.sources import files, formats, xml_rows


def test_a_longer_number_holds_no_last_year(spark):
    given = ["HOUSEHOLD · x\n21006 y", "A · x\n2100", "A · x\n20191", "A · x\n21006 2019"]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(folds.meta_lines(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in rows] == [["HOUSEHOLD · x", "21006 y"], ["A · x 2100"], ["A · x 20191"], ["A · x 21006 2019"]]


def test_files_are_dealt_out(spark, tmp_path):
    rows = spark.range(300).coalesce(1).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("content"))
    files.write_files(rows, f"{tmp_path}/out")
    assert len(list((tmp_path / "out").iterdir())) > 1  # one folder a task: all files were one task's before
    (tmp_path / "out" / "top.txt").write_text("top")
    (tmp_path / "out" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "out" / "deep" / "er" / "x.txt").write_text("deep")
    (tmp_path / "out" / "_hidden").write_text("hidden")
    read = formats.read_files(spark, f"{tmp_path}/out")
    assert read.inputFiles() == []  # the driver lists no files
    got = {r["path"]: r["content"] for r in read.collect()}
    assert sorted(got.values()) == sorted([str(n).encode() for n in range(300)] + [b"top", b"deep"])
    assert f"file:{tmp_path}/out/deep/er/x.txt" in got


def test_names_given_in_two_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "x"), ("a.txt", "y")], "name string, content string").repartition(2)
    with pytest.raises(Exception, match="given twice"):
        files.write_files(rows, f"{tmp_path}/out")


def test_a_late_task_of_a_failed_job_writes_nothing(tmp_path, monkeypatch):
    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(files.TaskContext, "get", classmethod(lambda cls: Task))
    writer = files.FileWriter(f"{tmp_path}/out")
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([{"name": "a.txt", "content": b"x"}]))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_texts_are_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(extract, "AT_ONCE", 2)
    docs = spark.createDataFrame([((n, "k"), f"Jane Doe\njane{n}@example.com") for n in range(5)], "key struct<n:int,k:string>, text string").coalesce(1)
    assert {r["key"]["n"]: r["personal"]["email"] for r in extract.import_texts(docs, "key").collect()} == {n: f"jane{n}@example.com" for n in range(5)}


def test_long_texts_are_read_one_at_a_time(spark, monkeypatch):
    docs, given = spark.createDataFrame([(1, "Jane Doe")], "n long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema, real=type(docs).mapInArrow: given.append(f) or real(df, f, schema))
    extract.import_texts(docs, "n")
    jobs = "\n".join(f"Role {n} at Company {n}\n01/2019 - 02/2020\nDid work" for n in range(2000))
    texts = [[("Header", f"Jane Doe\njane{n}@example.com"), ("WorkExperience", jobs)] for n in range(30)] + [None]
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    sections = [t and [{"key": k, "value": v} for k, v in t] for t in texts]
    batch = pa.record_batch([pa.array(range(31), pa.int64()), pa.array(sections, kind), pa.array([None] * 30 + ["no_sections"])], ["key", "sections", "warning"])
    tracemalloc.start()
    keys, most = [], 0
    for part in given[0](iter([batch, batch.slice(0, 0)])):
        assert all(x.as_py().count('"job_title"') == (2000 if k.as_py() < 30 else 0) for k, x in zip(*part.columns, strict=True))
        keys += part.column(0).to_pylist()
        most = max(most, part.nbytes)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys == list(range(31))
    assert most < 3_000_000 and held < 12_000_000  # before, all were one part of 21 MB


def test_documents_of_one_key_are_read_each(spark):
    docs = spark.createDataFrame([(1, "<a><b>x</b></a>"), (1, "<a><c/><b>y</b></a>"), (2, "<a><b></a></b>"), (3, None)], "id int, text string")
    found = xml_rows.elements(docs, "id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["key"], r["readable"], [(t["name"], t["end"], t["within"]) for t in r["tags"]]) for r in found.select("key", "readable", "tags").collect()]
    assert got[:2] == [(1, True, [("a", 4, 2), ("b", 3, 1)]), (1, True, [("a", 5, 3), ("c", 1, 1), ("b", 4, 1)])]
    assert [g[:2] for g in got[2:]] == [(2, False), (3, False)]


def test_pages_pass_many_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(layout, "AT_ONCE", 2)
    words = spark.createDataFrame([(p if p else None, f"{t}{p}", float(x), y) for p in range(5) for t, x, y in (("b", 9, 1.0), ("a", 1, 2.0), ("c", 1, 4.0), ("d", 1, 7.0))], "page_id int, text string, x double, y double")
    got = sorted(((r["page_id"] or 0, r["pos"], r["line"]) for r in layout.word_lines(words.coalesce(1)).collect()))
    assert got == [(p, n, x) for p in range(5) for n, x in enumerate((f"a{p} b{p}", f"c{p}", f"d{p}"))]
    assert "FlatMapGroups" not in layout.word_lines(words)._jdf.queryExecution().executedPlan().toString()
