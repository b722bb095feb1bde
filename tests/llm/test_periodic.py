"""Runs of words against a search over all periods, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import time

from dossier.llm import periodic as p


def slow(words):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def varied(rng) -> list[bytes]:
    w: list[str] = []
    while len(w) < rng.randrange(20, 200):
        kind = rng.randrange(5)
        if kind == 0:
            w += [rng.choice("ab") for _ in range(rng.randrange(30))]
        elif kind == 1:
            w += ([rng.choice("abc") for _ in range(rng.randrange(1, 12))] * 40)[: rng.randrange(10, 90)]
        elif kind == 2:  # strings of Fibonacci's kind hold as many repeats as strings can
            a, b = ["a"], ["a", "b"]
            for _ in range(rng.randrange(8)):
                a, b = b, b + a
            w += b
        elif kind == 3 and w:
            i = rng.randrange(len(w))
            w += w[i : i + rng.randrange(80)]
        else:
            w += [str(rng.randrange(1000)) for _ in range(rng.randrange(20))]
    return [x.encode() for x in w]


def test_runs_against_all_periods(monkeypatch):
    rng, found = random.Random(1), 0
    for n in range(400):
        monkeypatch.setattr(p, "SOLVE", (1 << 18, 40)[n % 2])
        texts = [varied(rng) for _ in range(rng.randrange(1, 4))]
        want = [slow(t) for t in texts]
        assert p.runs(texts) == want
        found += sum(map(len, want))
    assert found > 200


def test_long_texts_take_linear_time():
    for words in ([b"a"] * 100_000, [str(i % 30_000).encode() for i in range(100_000)]):
        began = time.monotonic()
        assert len(p.runs([words])) == 1
        assert time.monotonic() - began < 20


def test_odd_rows(spark):
    cycle = [f"w{i}" for i in range(9)]
    line = " ".join((cycle * 5)[:40])
    given = [(1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (None, line), (5, "\xa0".join(cycle * 5)), (6, "x " * 5000), (7, "ä é\x0bü " * 20)]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in given], "doc_id long, text string, runs string, collapsed string, n_runs int")
    found = p.find(docs).collect()
    assert len(found) == len(given)
    by = {r["doc_id"]: r for r in found}
    assert [tuple(r) for r in by[4]["runs"]] == [(0, 40, 9)] == [tuple(r) for r in by[None]["runs"]]
    assert by[4]["collapsed"] == " ".join(cycle) and by[6]["collapsed"] == "x" and by[7]["collapsed"] == "ä é ü"
    assert by[5]["runs"] == [] and by[1]["collapsed"] == by[2]["collapsed"] == by[3]["collapsed"] == ""
    rows = {r["doc_id"]: r for r in p.report(p.find(docs)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[1]["n_runs"], rows[1]["start"], rows[1]["exponent_milli"], rows[1]["runs_sha256"]) == (0, None, None, empty)
    assert (rows[4]["n_runs"], rows[4]["exponent_milli"], rows[4]["runs_sha256"]) == (1, 4444, hashlib.sha256(b"0,40,9\n").hexdigest())
    assert p.report(p.find(docs.limit(0), plant=True)).count() == 0


def test_greatest_exponent_first_on_ties(spark):
    text = " ".join(["a", "b"] * 12 + ["x"] + ["c", "d"] * 12 + ["y"] + list("efg") * 8)
    row = p.report(p.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (3, 0, 24, 2)
