"""The file sink: whole bytes, nothing left by a job that fails, no names that lead elsewhere."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dossier.sources import files, formats


def test_bytes_come_back(spark, tmp_path):
    given = {"a.txt": b"a: 1\nb: 2\n", "b.bin": bytes(range(256)), "c.md": "ä\r\n\r\n# x".encode(), "d": b"x" * 3_000_000}
    df = spark.createDataFrame([(k, bytearray(v), "x") for k, v in given.items()], "name string, content binary, path string").repartition(3)
    files.write_files(df, f"file://{tmp_path}/out")
    files.write_files(spark.createDataFrame([("e.txt", "tëxt"), ("empty", None)], "name string, content string"), f"{tmp_path}/out")
    read = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in formats.read_files(spark, f"{tmp_path}/out").collect()}
    assert read == given | {"e.txt": "tëxt".encode()}  # Spark's reader lists no empty files
    assert [p.stat().st_size for p in Path(tmp_path, "out").rglob("empty")] == [0] and not list(Path(tmp_path, "out").glob("_temporary*"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(rows, f"{tmp_path}/out")
    assert [p for p in Path(tmp_path).rglob("*") if p.is_file()] == []


@pytest.mark.parametrize("name", ["../x", "a/b", "", ".", "..", None])
def test_names_that_lead_elsewhere(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name for a file"):
        files.write_files(spark.createDataFrame([(name, "x")], "name string, content string"), f"{tmp_path}/out")
    assert [p for p in Path(tmp_path).rglob("*") if p.is_file()] == []


def test_too_large_files_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "LARGEST", 10)
    files.write_files(spark.createDataFrame([("a.txt", "short"), ("b.txt", "long" * 10)], "name string, content string"), f"{tmp_path}/out")
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["content"], r["error"]) for r in formats.read_files(spark, f"{tmp_path}/out").collect()}
    assert got == {"a.txt": (5, b"short", None), "b.txt": (40, None, "too_large")}
