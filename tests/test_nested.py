"""Unions of JSON against a plain merge."""

from __future__ import annotations

import json
import random

import pytest

from dossier.operators import json_union


def merged(into, fragment):
    for k, v in fragment.items():
        if isinstance(v, dict):
            into[k] = merged(into[k] if isinstance(into.get(k), dict) else {}, v)
        elif isinstance(v, list):
            into[k] = (into[k] if isinstance(into.get(k), list) else []) + [x for x in v if x is not None]
        elif v is not None:
            into[k] = v
    return into


def varied(rng, depth):
    r = rng.random()
    if depth and r < 0.45:
        return {rng.choice("abc"): varied(rng, depth - 1) for _ in range(rng.randrange(4))}
    if r < 0.6:
        return [rng.choice([1, None, "x", {"q": None, "r": [1, None]}]) for _ in range(rng.randrange(3))]
    return rng.choice([None, 1, 'é"x', True, 2.5])


def test_union_against_a_plain_merge(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(40):
        want[k] = {}
        for n in range(rng.randrange(1, 6)):
            fragment = {rng.choice('abc."'): varied(rng, 3) for _ in range(rng.randrange(4))}
            rows.append((k, n, json.dumps(fragment, ensure_ascii=False)))
            merged(want[k], json.loads(rows[-1][2]))
    rows += [(100, 0, None), (101, 0, "[1]"), (102, 0, "{bad"), (102, 1, '{"a":1}'), (None, 0, '{"a":{"b":1}}'), (None, 1, '{"a":{"c":2}}')]
    want |= {100: None, 101: None, 102: {"a": 1}, None: {"a": {"b": 1, "c": 2}}}
    given = spark.createDataFrame([(*r, "x") for r in rows], "id long, n int, body string, path string")
    assert {r["id"]: r["merged"] and json.loads(r["merged"]) for r in json_union.union(given, "id", "n", "body").collect()} == want
    assert json_union.union(given.limit(0), "id", "n", "body").count() == 0


def test_union_of_deep_objects(spark):
    deep = '{"a":' * 8 + "1" + "}" * 8
    given = spark.createDataFrame([(1, 0, deep)], "id long, n int, body string")
    assert json_union.union(given, "id", "n", "body").first()["merged"] == deep
    with pytest.raises(ValueError):
        json_union.union(given, "id", "n", "body", deepest=4)
