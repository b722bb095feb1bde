"""Streams that keep state of their own: stopped and begun again from their checkpoint they give the rows of the batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from dossier.streaming import progress


@pytest.fixture(autouse=True)
def state_store(spark):
    for k, v in progress.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in progress.STATE_STORE:
        spark.conf.unset(k)


def run(rows, path, name):
    """Runs a stream over what is there and stops it; results and state stay."""
    q = rows.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_shown_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"j{n % 3}", n, rng.choice("ab"), rng.randrange(101)) for n in range(60)]
    schema = "job string, seq bigint, phase string, pct int"
    (tmp_path / "in").mkdir()
    stream = progress.shown_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    for part in (rows[:25], rows[25:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stream, tmp_path, "shown")
    got = {(r["job"], r["seq"], r["shown"]) for r in spark.read.parquet(f"{tmp_path}/shown").collect()}
    assert got == {(r["job"], r["seq"], r["shown"]) for r in progress.running_max(spark.createDataFrame(rows, schema), "job", "seq").collect()}


def test_saves_after_a_restart_and_late_rows(spark, tmp_path):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    at, rows = {k: 0 for k in "abc"}, []
    for _ in range(240):
        k = rng.choice("abc")
        at[k] += rng.choice((1, 5, 20, 58, 59, 60, 200))
        rows.append((k, start + timedelta(seconds=at[k]), rng.random() < 0.9, rng.random() < 0.9))
    rows.sort(key=lambda r: r[1])
    schema = "key string, ts timestamp, dirty boolean, has_data boolean"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    stream = progress.saves_stream(source)
    end = [("z", start + timedelta(days=2), True, True)]
    late = [("a", start - timedelta(days=1), True, True)]  # behind the watermark by then
    for part in (rows[:80], rows[80:150], rows[150:], end, late + [("z", start + timedelta(days=3), True, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stream, tmp_path, "saves")
    got = {(r["key"], r["ts"], r["changes"]) for r in spark.read.parquet(f"{tmp_path}/saves").where("key != 'z'").collect()}
    want = {(r["key"], r["ts"], r["changes"]) for r in progress.saves(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(want) > 20


def test_saves_of_a_table(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=s), True, True) for s in range(0, 1000, 50)] + [("a", start, False, True), ("b", start, True, False)]
    got = sorted(((r["ts"] - start).total_seconds(), r["changes"]) for r in progress.saves(spark.createDataFrame(rows, "key string, ts timestamp, dirty boolean, has_data boolean")).collect())
    assert got == [(600.0, 12), (1009.0, 8)]
    assert progress.saves(spark.createDataFrame([], "key string, ts timestamp, dirty boolean, has_data boolean")).count() == 0
