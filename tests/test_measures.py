"""Repeated openings against a plain search, counts taken while rows pass against aggregates."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from dossier.operators import folds, metrics


def slow(text):
    t = text.strip()
    for n in range(min(400, len(t) // 2), 79, -1):
        unit = t[:n].rstrip()
        if unit and len(t[n:].replace(unit, "").strip()) <= len(unit) // 2:
            return unit
    return t


def test_repeated_openings_against_a_plain_search(spark):
    rng, texts = random.Random(6), []
    for _ in range(120):
        unit = "".join(rng.choice("ab cde") for _ in range(rng.randrange(60, 300)))
        glue = rng.choice(["", " ", "x y ", " " * 50])
        texts.append(glue.join([unit] * rng.randrange(1, 5)) + unit[: rng.randrange(40)] * rng.randrange(2))
    texts += ["x" * 500, "w" * 90 + " " * 300 + "tail", "ab" * 79, "", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: r["u"] for r in rows.select("n", folds.repeated_prefix(F.col("t")).alias("u")).collect()}
    assert got == {n: slow(t) for n, t in enumerate(texts)}
    assert sum(got[n] != t.strip() for n, t in enumerate(texts)) > 20


def test_long_texts_take_little_time(spark):
    rng = random.Random(7)
    plain = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    again = (plain[:300] + " ") * 3300
    rows = spark.createDataFrame([(plain,), (again,)], "t string").coalesce(1)
    rows.select(F.length(folds.repeated_prefix(F.col("t")))).collect()  # compiles
    began = time.monotonic()
    assert [r[0] for r in rows.select(F.length(folds.repeated_prefix(F.col("t")))).collect()] == [len(plain.strip()), len(slow(again))]
    assert time.monotonic() - began < 5


def test_counts_taken_while_rows_pass(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 7 == 0, "bad").alias("error"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.when(F.col("id") % 2 == 0, F.array_repeat(F.lit(1), 2)).alias("work"),
    )
    out, seen = metrics.import_report(rows)
    assert out.count() == 1000
    assert seen.get == {"files": 1000, "failed": 143, "warned": 334, "jobs": 1000}
    empty, seen = metrics.import_report(rows.limit(0))
    assert empty.count() == 0 and seen.get == {"files": 0, "failed": 0, "warned": 0, "jobs": 0}


def test_warnings_in_the_order_of_stages(spark):
    df = spark.createDataFrame([(["a"], None, ["c", "a"]), (None, None, None)], "x array<string>, y array<string>, z array<string>")
    assert [r[0] for r in df.select(metrics.merged_warnings(F.col("x"), F.col("y"), F.col("z"))).collect()] == [["a", "c", "a"], []]
