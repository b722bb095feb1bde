"""The shared scratch folder."""

from __future__ import annotations

from dossier.llm.common import stash, stash_dir, sweep


def test_stash_and_sweep(spark):
    df = stash(spark.range(10), "numbers")
    assert df.count() == 10 and stash_dir(spark) in df.inputFiles()[0]
    sweep(spark)
    assert not spark.sparkContext._jvm.java.io.File(stash_dir(spark).removeprefix("file://")).exists()
