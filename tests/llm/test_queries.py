"""The registered corpus queries on the driver's smallest tables: the same rows as their SQL, or as brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest

from dossier.llm.decontaminate import words_of
from dossier.llm.queries import ORACLE_SQL, QUERIES

from ..compare import SF, assert_same
from .test_pairs import slow_tiling


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


def test_leaks_against_brute_force(spark):
    """Every pair whose shared three-word runs could cover 0.6 of the item is tiled by search; no other can qualify."""
    items = {r["item_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for d, words in docs.items():
        runs = set(zip(words, words[1:], words[2:], strict=False))
        for i, own in items.items():
            covered = set()
            for k in range(len(own) - 2):
                if tuple(own[k : k + 3]) in runs:
                    covered |= {k, k + 1, k + 2}
            if own and len(covered) >= 0.6 * len(own) and (n := slow_tiling(words, own, 3)) >= 0.6 * len(own):
                want[d, i] = n
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in QUERIES["op1_decontaminate"](spark, SF).collect()}
    assert got == want and got


def test_simhash_classes(spark):
    rows = QUERIES["op2_simhash"](spark, SF).collect()
    ids, prints = [r["doc_id"] for r in rows], np.array([int(r["fingerprint"], 16) for r in rows], dtype=np.uint64)
    component = {r["doc_id"]: r["component_id"] for r in rows}
    for n, i in enumerate(ids):
        near = [ids[k] for k in np.flatnonzero(np.bitwise_count(prints ^ prints[n]) <= 2)]
        assert {component[k] for k in near} == {component[i]} and component[i] <= min(near)


def test_toxicity_rows(spark):
    rows = QUERIES["op4_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_personal_data_columns(spark):
    for r in QUERIES["op6_pii"](spark, SF).collect():
        kinds = re.findall(r"(?:^|,)(\w+):", r["spans"])
        assert [kinds.count(k) for k in ("email", "ip", "card", "phone", "term")] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_term"]]
