"""Repair of conversations against a search over all edits, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

from dossier.llm import conversations as c

from ..compare import SF

WANTED = re.compile(r"(s?(ua)+)?")
GAPS = [""] + ["".join(g) for n in (1, 2) for g in itertools.product("ua", repeat=n)]


def slow(signature: str) -> tuple[int, str]:
    """Tries every way to keep, rename or delete each row with up to two rows put into each gap."""
    options = []
    for s in signature:
        role, extra = s.lower(), 3 if s.isupper() else 0
        own = [(4, "D", "")]
        if s != "x":
            own += [(extra, "K", role), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
        options.append(own)
    best = None
    for kept in itertools.product(*options):
        for gaps in itertools.product(GAPS, repeat=len(signature) + 1):
            roles = gaps[0] + "".join(k[2] + g for k, g in zip(kept, gaps[1:], strict=True))
            if WANTED.fullmatch(roles):
                cost = sum(k[0] for k in kept) + 3 * sum(map(len, gaps))
                audit = "I" * len(gaps[0]) + "".join(k[1] + "I" * len(g) for k, g in zip(kept, gaps[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_trie_against_all_edits():
    rng = random.Random(4)
    all_ = ["".join(x) for n in range(3) for x in itertools.product("suaoSUAOx", repeat=n)]
    all_ += ["".join(rng.choice("suaSUAx") for _ in range(3)) for _ in range(12)]
    trie = c.Trie()
    for signature in sorted(set(all_)):
        assert trie.answer(signature) == slow(signature), signature


def test_prefixes_are_shared():
    trie = c.Trie()
    for tail in ("", "u", "ua", "us"):
        trie.answer("ua" * 500 + tail)
    assert trie.made == 1000 + 1 + 1 + 1
    assert trie.answer("ua" * 50_000) == (0, "K" * 100_000)


def rows(spark, given):
    return spark.createDataFrame(given, "conv_id long, turn long, role string, text string, copies int, audit string, digest string, signature string, facts string")


def repaired(spark, given):
    return {r["conv_id"]: r for r in c.repair(rows(spark, [(*g, "x", "x", "x", "x") for g in given])).collect()}


def test_odd_rows(spark):
    long = "word " * 200_000 + "end."
    got = repaired(spark, [
        (1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes.", 1), (1, 1, "assistant", "Yes.", 1), (1, 4, "user", "Hi.", 1),
        (None, 0, "user", "Hi.", 1), (None, 1, "assistant", "Hi.", 1),
        (2, None, "user", " \t", 1), (2, None, " ", "What?", 1), (2, 7, "tool", "a", 1),
        (3, 0, "user", "gone", 0),
        (4, 0, "system", long, 1), (4, 1, "user", long, 1), (4, 2, "assistant", long, 2),
        (5, -3, "assistant", "No ", 1),
    ])
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["audit"], got[1]["cost"], got[1]["gaps"], got[1]["duplicate"], got[1]["illegal"]) == ("KKDD", 8, 2, 2, 1)
    assert got[1]["repaired_sha256"] == hashed("user:Hi.\nassistant:Yes.")
    assert (got[None]["audit"], got[None]["repaired_sha256"]) == ("KK", hashed("user:Hi.\nassistant:Hi."))
    assert (got[2]["blank"], got[2]["truncated"], got[2]["gaps"], got[2]["illegal"]) == (1, 1, 0, 2)
    assert (got[2]["cost"], got[2]["audit"]) == slow("xoO")
    assert (got[3]["audit"], got[3]["cost"], got[3]["repaired_sha256"]) == ("", 0, hashed(""))
    assert (got[4]["audit"], got[4]["repaired_sha256"]) == ("KKKD", hashed(f"system:{long}\nuser:{long}\nassistant:{long}"))
    assert (got[5]["truncated"], got[5]["audit"], got[5]["repaired_sha256"]) == (1, "D", hashed(""))
    assert repaired(spark, []) == {}


def test_order_of_input_does_not_matter(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    once = sorted(map(str, c.repair(c.damaged(turns)).collect()))
    again = sorted(map(str, c.repair(c.damaged(turns.orderBy("text").repartition(7))).collect()))
    assert once == again and once


def test_damage_of_nulls(spark):
    turns = spark.createDataFrame([(None, None, None, None), (1, None, None, "a."), (None, 1, "user", None)], "conv_id long, turn long, role string, text string")
    got = c.repair(c.damaged(turns)).collect()
    assert {r["conv_id"] for r in got} == {None, 1}
