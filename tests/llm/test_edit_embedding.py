"""Edit embedding against a walk of single steps, and on odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from dossier.llm import edit_embedding as e
from dossier.llm.queries import QUERIES

from ..compare import SF


def slow_walk(text: str) -> list[str]:
    """What is written, step by step: the character at hand, and on by the bit that step and character choose."""
    bits = (e.mixed(np.arange(e.PERIOD * e.CLASSES)) & np.uint64(1)).reshape(e.PERIOD, e.CLASSES)
    out, i, step = [], 0, 0
    while i < len(text):
        c = ((ord(text[i]) * 0x9E3779B1) % 2**32) >> (32 - (e.CLASSES.bit_length() - 1))
        out.append(text[i])
        i += int(bits[step % e.PERIOD, c])
        step += 1
    return out


def written(walk: e.Walk) -> list[str]:
    return [chr(c) for c, n in zip(walk.codes, np.diff(walk.steps), strict=True) for _ in range(n)]


def slow_print(text: str) -> bytes:
    codes = [ord(c) + 1 for c in slow_walk(text)]
    out = []
    for slot in range(e.SLOTS):
        steps = [int(r) for r in e.records()[slot] if r < len(codes)]
        if not steps:
            out.append(0)
            continue
        value = 0
        for k in range(e.WINDOW):
            value = (value * 0x100000001B3 + (codes[steps[-1] + k] if steps[-1] + k < len(codes) else 0)) % 2**64
        out.append(int(e.mixed(np.array([value], dtype=np.uint64))[0]) >> 56)
    return bytes(out)


TEXTS = ["", "a", "ab", "aaaa" * 300, "Grüße, 世界! " * 40, "".join(random.Random(2).choice("abcdef é\n") for _ in range(3000))]


def test_walk_against_single_steps():
    for text in TEXTS:
        assert written(e.Walk.of(text)) == slow_walk(text)
        assert e.Walk.of(text).fingerprint() == slow_print(text)
        for keep in (0, len(text) // 2, len(text)):
            tail = np.array([ord(c) for c in "other text"], dtype=np.uint32)
            assert written(e.Walk.of(text).on(keep, tail)) == slow_walk(text[:keep] + "other text")


def test_records_spread_evenly():
    own = e.records()
    for n in (10, 1000, 100_000):
        last = own[np.arange(e.SLOTS), (own < n).sum(axis=1) - 1] / n
        assert abs(last.mean() - 0.5) < 0.12 and (last < 0.25).mean() > 0.1 and (last > 0.75).mean() > 0.1


def test_few_edits_keep_likeness():
    rng = random.Random(3)
    like = {1: [], 5: [], 2000: []}
    for _ in range(40):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(2000))
        for edits, found in like.items():
            s = list(text)
            for _ in range(edits):
                i = rng.randrange(len(s))
                s[i : i + rng.randrange(2)] = rng.choice("etaoin shrdlu")
            found.append(e.likeness(e.Walk.of(text).fingerprint(), e.Walk.of("".join(s)).fingerprint()))
    one, five, many = (np.mean(like[k]) for k in (1, 5, 2000))
    assert one > five > 0.6 and one > 0.9 and many < 0.25


def expected(rows):
    """By the definition, rows being in order."""
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (e.Walk.of(t).fingerprint() for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), e.likeness(a, b), e.likeness(a, c)))
    return out


def test_query_against_definition(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r) for r in QUERIES["op12_edit_embedding"](spark, SF).orderBy("doc_id").collect()]
    assert got == expected(docs)
    near = [r[5] - r[6] for r in got if r[1] >= 20]
    assert np.mean(np.array(near) > 0.2) > 0.95


def test_odd_rows(spark):
    docs = lambda rows: spark.createDataFrame([(i, t, "x", 0.5, "y") for i, t in rows], "doc_id long, text string, task string, near_next double, part string")
    rows = [(None, "first"), (1, None), (2, ""), (3, "long text " * 50_000), (5, "\u4e16\U0001f600b"), (9, "long text " * 50_000)]
    got = sorted((tuple(r) for r in e.fingerprints(docs(rows).repartition(3)).collect()), key=lambda r: r[0] or 0)
    assert got == expected(rows) and got[3][3] == got[5][3] and got[1][5] == 1.0
    assert [tuple(r) for r in e.fingerprints(docs(rows[4:5])).collect()] == expected(rows[4:5])
    assert len(e.fingerprints(docs([(4, "same"), (4, "same"), (4, "other")])).collect()) == 3
    assert e.fingerprints(docs([])).count() == 0


def test_similar_against_all_pairs(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(30):
        base = bytes(rng.randrange(256) for _ in range(e.SLOTS))
        for changed in (0, 0, 5, 15, 25, 40):
            own = bytearray(base)
            for k in rng.sample(range(e.SLOTS), changed):
                own[k] ^= 1
            prints.append(bytes(own).hex())
    rows = spark.createDataFrame([(p, "x") for p in prints], "fingerprint string, query string")
    got = {(r["query"], r["fingerprint"]): r["likeness"] for r in e.similar(rows, rows).collect()}
    like = {(a, b): e.likeness(bytes.fromhex(a), bytes.fromhex(b)) for a in set(prints) for b in set(prints)}
    want = {k for k, v in like.items() if v >= e.LIKENESS}
    assert set(got) <= want and len(got) >= 0.95 * len(want) and all(abs(got[k] - like[k]) < 1e-9 for k in got)
