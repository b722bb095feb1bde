"""The pipeline on a small corpus: each stage's decisions take effect, clean documents stay, odd rows survive."""

from __future__ import annotations

import random

import corpus_pipeline


def corpus(spark, path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 9)))
    prose = lambda n=80: " ".join(word() for _ in range(n))
    item = " ".join(word() for _ in range(30))
    docs, labels = [], []
    for i in range(300):
        t = prose()
        toxic = i % 5 == 1
        if toxic:
            w = t.split()
            for _ in range(5):
                w[rng.randrange(80)] = "zorgonic"
            t = " ".join(w)
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, 1, int(toxic)))
    clean = [i for i in range(300) if i % 5 != 1]
    docs.append((1000, docs[0][1], "en", "s0", 0))  # an exact copy
    docs.append((1001, prose(20) + " " + item + " " + prose(20), "en", "s1", 0))  # a leak
    docs.append((1002, "write to jane@example.com " + prose(), "en", "s1", 0))
    docs += [(1003, None, None, None, None), (None, prose(), "en", "s1", 1), (1004, "", "en", "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return clean


def test_pipeline(spark, tmp_path):
    clean = corpus(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    # The null text and the empty one share fingerprint zero; the smaller id stays.
    assert sorted(i for i in ids if i is not None) == sorted([*clean, 1002, 1003])
    assert ids.count(None) == 1
    by = {r["doc_id"]: r for r in got}
    assert "[EMAIL]" in by[1002]["text"] and by[1002]["n_chars"] == len(by[1002]["text"]) and by[1003]["text"] is None
    total = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - total) <= 8


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, str(tmp_path)).columns) == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_ids_stay_once(spark, tmp_path):
    t = "a text that two rows repeat under one id and a third has as its own text " * 2
    docs = spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()] == [1]
