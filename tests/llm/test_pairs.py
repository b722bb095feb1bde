"""Near-duplicates, leaks and repeated strings against brute force on small tables with odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import decontaminate, embeddings, simhash, suffix_dedup
from dossier.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, size string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], DOCS)


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(rng.choice((5, 60, 300)))) for _ in range(12)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        out.append((i, " ".join(w)))
    return [*out, (100, ""), (101, None), (102, "one"), (103, "\t \n"), (104, "Große ÄÖ Wörter und NBSP x"), (105, out[0][1]), (105, out[1][1])]


def test_components_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes(real, {x for e in real for x in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows_a_list", [256, 1])
def test_simhash_matches_brute_force(spark, rows_a_list):
    rows = texts()
    got = simhash.near_duplicates(docs_of(spark, [*rows, (None, rows[0][1])]), list_rows=rows_a_list).collect()
    prints = [(i, slow_print(t)) for i, t in rows]
    pairs = [(a, b) for n, (a, x) in enumerate(prints) for b, y in prints[n + 1 :] if (x ^ y).bit_count() <= 2]
    want = classes(pairs, {i for i, _ in rows})
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert sorted((r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is not None) == sorted((i, f"{f:016x}") for i, f in prints)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_simhash_long_text_is_counted_in_steps(monkeypatch):
    t = " ".join(str(i % 97) for i in range(5000))
    whole = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(t) == whole == slow_print(t)


def test_leaks_catch_reordered_passages_and_leave_others(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix purple potions in deep stone cellars"
    w = item.split()
    turned = " ".join([*w[10:], "and", *w[:10]])
    rows = [(1, f"lead {item} tail"), (2, f"start {turned} end"), (3, "the quick brown fox met nobody at all in that story"), (4, None), (5, ""), (None, item), (6, item.upper()), (6, item)]
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny item")], "item_id long, text string")
    got = decontaminate.leaks(docs_of(spark, rows), items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, 7), (1, 7), (2, 7), (6, 7), (6, 7)]
    assert {r["doc_id"]: r["n_tiles"] for r in got}[2] == 2 and all(r["coverage"] == 1.0 for r in got)
    small = decontaminate.leaks(docs_of(spark, rows), items, block_words=1).count()
    assert small == 5
    kept = decontaminate.clean(docs_of(spark, rows), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == docs_of(spark, rows).columns
    assert decontaminate.leaks(docs_of(spark, []), items).count() == 0
    assert decontaminate.leaks(docs_of(spark, rows), items.limit(0)).count() == 0


def test_leaks_without_a_run_of_five_words(spark):
    """Every fifth word changed, and runs of three and four words turned round: the tiling covers 0.8 and 1.0."""
    w = [f"w{i}" for i in range(28)]
    changed = " ".join(f"x{i}" if i % 5 == 4 else x for i, x in enumerate(w))
    cuts = [0, 4, 7, 11, 14, 18, 21, 25, 28]
    turned = " ".join(" ".join(w[a:b]) for a, b in reversed(list(zip(cuts, cuts[1:], strict=False))))
    half = " ".join(x if i % 5 < 3 and i < 20 else f"y{i}" for i, x in enumerate(w))
    docs = docs_of(spark, [(1, f"a b {changed} c"), (2, turned), (3, half), (4, "w0 w1")])
    items = spark.createDataFrame([(5, ""), (7, " ".join(w)), (8, "w0 w1"), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.leaks(docs, items).collect()}
    assert {k: n for k, n in got.items() if k[1] == 7} == {(1, 7): 23, (2, 7): 28}
    assert {k for k in got if k[1] == 8} == {(i, 8) for i in (1, 2, 3, 4)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, items.where("item_id = 7")).collect()] == [3, 4]


def test_leaks_in_a_very_long_text(spark):
    rng = random.Random(8)
    item = [f"w{i}" for i in range(2000)]
    words = [rng.choice((f"w{rng.randrange(2000)}", "x")) for _ in range(150_000)]
    words[100_000:100_000] = item[1200:] + item[:1200]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.leaks(docs_of(spark, [(5, " ".join(words))]), items).collect()
    assert [(r["doc_id"], r["matched_words"]) for r in got] == [(5, 2000)] and got[0]["n_tiles"] <= 3


def test_leaks_of_items_without_an_id(spark):
    item = "seven wizards quietly mix purple potions in deep stone cellars"
    docs = docs_of(spark, [(1, f"then {item} again"), (2, "nothing of it here")])
    items = spark.createDataFrame([(None, item), (None, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.leaks(docs, items).collect()] == [(1, None, 1.0)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5))
def test_candidates_lose_no_pair_that_qualifies(doc, items):
    block = decontaminate.Block([(n, " ".join(map(str, i))) for n, i in enumerate(items)], 3)
    ids = np.array([block.vocabulary.get(str(x), -1) for x in doc], dtype=np.int64)
    may = block.candidates(ids, 0.6)
    for n, item in enumerate(block.items):
        if len(item) and slow_tiling(ids.tolist(), item.tolist(), min(3, len(item))) >= 0.6 * len(item):
            assert n in may


def slow_tiling(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while i + k < len(item) and p + k < len(doc) and free_i[i + k] and free_d[p + k] and item[i + k] == doc[p + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, p)
        k, i, p = best
        if k < least:
            return out
        for x in range(k):
            free_i[i + x] = free_d[p + x] = False
        out += k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_tiling_matches_brute_force(doc, item):
    tiles = decontaminate.tile(np.array(doc, dtype=np.int64), np.array(item, dtype=np.int64), 2)
    assert sum(t[2] for t in tiles) == slow_tiling(doc, item, 2)


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcde fgh") for _ in range(n)) for n in (50, 51, 90, 400)]
    rows = []
    for i in range(40):
        parts = ["".join(rng.choice("abcdefghij klmn") for _ in range(rng.randrange(80))) for _ in range(3)]
        for s in rng.sample(shared, 2):
            parts.insert(rng.randrange(3), s)
        rows.append((i * 3, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "x" * 49), (503, "y" * 300), (504, "y" * 60), (505, "ß€" * 40), (506, "a" + "ß€" * 40), (507, rows[5][1])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(docs_of(spark, rows)).collect()}
    assert got == suffix_dedup.brute_force(rows)


def test_suffix_dedup_odd_rows(spark):
    t = "some long text that is repeated in full by another row of it " * 3
    rows = [(1, t), (1, "other " + t), (None, t), (2, t), (2, t)]
    got = sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicate(docs_of(spark, rows)).collect()))
    n = len(t)
    assert got == [(-1, n, 0), (1, n, 0), (1, n + 6, 0), (2, n, n), (2, n, n)]
    assert suffix_dedup.deduplicate(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("least", [1, 4])
def test_suffix_dedup_frequent_keys(spark, monkeypatch, least):
    """A passage round which all documents differ: its anchors are cut by place, and then by window, and nothing is lost."""
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "PARTS", 1000)
    monkeypatch.setattr(suffix_dedup, "LEAST_FREQUENT", least)
    rng = random.Random(5)
    core = "the common middle part of these texts 0123456789 " * 2
    rows = [(i, "".join(rng.choice("uvwxyz") for _ in range(20)) + core[: 40 + i % 50] + "".join(rng.choice("uvwxyz") for _ in range(20))) for i in range(60)]
    docs = docs_of(spark, rows)
    anchors, *parts = suffix_dedup._frequent(docs, 50)
    assert len(anchors) and (least > 1 or len(parts[0]))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got == suffix_dedup.brute_force(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=120).map(str.encode), min_size=1, max_size=5), st.integers(0, 2))
def test_segments_hold_every_window_once(texts, depth):
    """However keys are cut, each window lies in one segment, and equal windows lie in segments of one key."""
    frequent = []
    for _ in range(depth):
        frequent.append(np.unique(suffix_dedup.segments(texts, 20, tuple(frequent))[3]))
    keys, seen = {}, []
    for n, start, shape, key, _ in zip(*suffix_dedup.segments(texts, 20, tuple(frequent)), strict=True):
        for k in range(start, start + (shape & 255) - 19):
            seen.append((int(n), int(k)))
            assert keys.setdefault(texts[n][k : k + 20], key) == key
    assert sorted(seen) == [(n, k) for n, t in enumerate(texts) for k in range(len(t) - 19)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes(x % 4 + 97 for x in b)), min_size=1, max_size=12))
def test_collection_is_the_suffix_order(parts):
    who, depth, bwt, lcp = suffix_dedup.collection(parts)
    suffixes = sorted((p[len(p) - d :], i) for i, p in enumerate(parts) for d in range(len(p) + 1))
    assert [(s, i) for s, i in suffixes] == [(parts[w][len(parts[w]) - d :], w) for w, d in zip(who, depth, strict=True)]
    for n, (w, d) in enumerate(zip(who, depth, strict=True)):
        before = len(parts[w]) - d - 1
        assert bwt[n] == (parts[w][before] + 1 if before >= 0 else 0)
        if n:
            a, b = suffixes[n - 1][0], suffixes[n][0]
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[n] == same


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 64))
    near = [base[i % 5] + rng.standard_normal(64) * 0.1 for i in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*base, *near])]
    rows += [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] * 64), (905, rows[0][1]), (905, rows[0][1]), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [x * 3 for x in rows[1][1]])]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_embeddings_against_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in [*rows, (None, rows[0][1])]], "vec_id long, embedding array<float>, label int, n_links int")
    got = embeddings.near_duplicates(df, block_rows=block).collect()
    assert len(got) == len(rows) + 1
    unit = [None if v is None or len(v) == 0 or None in v or not np.isfinite(v).all() or not np.any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    links, pairs = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                pairs.append((rows[a][0], rows[b][0]))
    found = sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] is not None)
    want = sorted((i, n) for (i, _), n in zip(rows, links, strict=True))
    assert all(g[1] <= w[1] for g, w in zip(found, want, strict=True)), "no link below the threshold"
    assert sum(g[1] for g in found) >= 0.97 * sum(w[1] for w in want)
    top = classes(pairs, {i for i, _ in rows})
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None} == top
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall_at_the_threshold(spark):
    """Pairs planted at a cosine of 0.95 to 0.951, which the calibration is for; each counts once, whatever tables it meets in."""
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= np.sum(a * b, axis=1, keepdims=True) * a
    c = rng.uniform(0.95001, 0.951, (1500, 1))
    near = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*a, *near])], "vec_id long, embedding array<double>")
    links = [r["n_links"] for r in embeddings.near_duplicates(df).collect()]
    assert sum(links) >= 0.93 * len(links) and max(links) == 1


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_sketches_miss_no_row_of_a_pair(seed):
    """Rows that the exact count links are never dropped by their sketches."""
    rng = np.random.default_rng(seed)
    plan = embeddings.calibrate(200)
    v = rng.standard_normal((60, 16))
    v[30:] = v[:30] + rng.standard_normal((30, 16)) * rng.uniform(0.05, 0.4, (30, 1))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    group, table, side, crossed = rng.integers(0, 3, 60), rng.integers(0, plan.tables, 60), rng.integers(0, 2, 60), rng.integers(0, 2, 60).astype(bool)
    table, crossed = table[group], crossed[group]  # alike in a group
    table[:] = table[0]
    i, j = embeddings.compare(unit, group, table, side, crossed, plan)
    kept = embeddings.partnered(embeddings.sketches(unit, plan), group, table, side, crossed, plan)
    assert kept[i].all() and kept[j].all()


def test_calibration_follows_size():
    small, large = embeddings.calibrate(1000), embeddings.calibrate(10**9)
    assert large.per_cell > small.per_cell and large.tables > small.tables and small.least == large.least


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63))
def test_linked_pairs_meet_at_every_depth(a, x, y):
    """However often lists are split, a pair of at most two differing bits shares a list, as six positions agree."""
    differ = a ^ (a ^ (1 << x) ^ (1 << y))
    shared = {p for p in range(8) if not differ >> 8 * p & 0xFF}
    masks = [0]  # from no posting to six, so through whatever number the index begins with
    for _ in range(simhash.GUARANTEED):
        masks = [m for mask in masks for m in simhash._next(mask) if all(p in shared for p in range(8) if m >> p & 1)]
        assert masks


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.lists(st.lists(st.integers(0, 63), max_size=4), max_size=12), min_size=1, max_size=5))
def test_tally_is_all_pairs(start, lists):
    values, owner = [], []
    for n, flips in enumerate(lists):
        for flip in flips:
            v = start
            for b in flip:
                v ^= 1 << b
            values.append(v)
            owner.append(n)
    sizes = np.array([len(x) for x in lists])
    got = [(int(i), int(j)) for a, b in simhash.tally(np.array(values, dtype=np.uint64), sizes) for i, j in zip(a, b, strict=True)]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if owner[i] == owner[j] and (values[i] ^ values[j]).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want)


def test_links_of_a_large_group(spark):
    """A thousand fingerprints round one centre: lists are split down to six positions, and no link between two of them is lost."""
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3)))) for _ in range(1000)} | {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(v), n) for n, v in enumerate(prints)], "fp long, rep long")
    got = {(r["b"], r["a"]) for r in simhash.links(df, list_rows=8).collect()}
    values = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
