"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Test items are a stated query set: they are fetched in blocks of a bounded number of words, each block is broadcast,
and every document passes each block once. A document's words are looked up in the block's vocabulary; its runs of
``min_tile`` words are hashed (Karp-Rabin) and joined to those of the items through a sorted index. Tiles consist of
shared runs, so the words of an item that its shared runs cover bound what any tiling can cover: every pair whose bound
reaches the threshold is tiled, and no other can qualify. The longest common match not overlapping a tile is marked,
again and again, until no match of ``min_tile`` words is left. Tiles may lie in any order, so reordered passages count in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of test items in one broadcast block (about 40 MB with its index).
BLOCK_WORDS = 1_000_000
WORDS = re.compile(r"\w+")
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the hash base and of its inverse modulo 2^64, kept for the longest text so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        one = np.ones(1, dtype=np.uint64)
        pair = (int(STEP), pow(int(STEP), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([one, np.full(size - 1, x, dtype=np.uint64)])) for x in pair]
    return _POWERS[0][:n], _POWERS[1][:n]


class Running:
    """Karp-Rabin hashes of all runs of a sequence of word ids: running sums made once, then any length in one pass.

    The sum over a run of mixed ids times powers of the base, scaled back to the run's start, is the run's hash; the
    difference of two running sums gives it, so a length costs the same whether it is three or three thousand.
    """

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * BASE
        mixed ^= mixed >> np.uint64(29)
        power, self.back = _powers(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * power[: self.n])])

    def of(self, k: int) -> np.ndarray:
        n = self.n - k + 1
        return (self.sums[k:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, dtype=np.uint64)


def _covered(marked: np.ndarray, k: int) -> np.ndarray:
    """For every run of k places, whether one of them is marked; by running sums as well."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[k:] > sums[: len(sums) - k]


class Block:
    """Test items with their vocabulary and, by length of run, a sorted index of the items' runs."""

    def __init__(self, items: list[tuple[int | None, str]], min_tile: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [
            np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)], dtype=np.int64)
            for _, t in items
        ]
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        # Items are laid out one after another; a run is known by the place where it starts.
        self.first = np.cumsum(self.sizes) - self.sizes
        runs = np.minimum(self.sizes, min_tile)
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(runs[runs > 0]).tolist():
            own = np.flatnonzero(runs == k).tolist()
            hashes = np.concatenate([Running(self.items[n]).of(k) for n in own])
            starts = np.concatenate([self.first[n] + np.arange(self.sizes[n] - k + 1) for n in own])
            order = np.argsort(hashes, kind="stable")
            self.index[k] = hashes[order], starts[order]

    def candidates(self, ids: np.ndarray, coverage: float) -> list[int]:
        """Items of which the runs shared with a document (vocabulary ids, -1 for other words) cover enough."""
        found: list[int] = []
        run, other = Running(ids), ids < 0
        for k, (hashes, starts) in self.index.items():
            h = run.of(k)
            if not len(h):
                continue
            h = np.unique(h[~_covered(other, k)])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = hi - lo
            if not n.any():
                continue
            where = np.sort(starts[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
            owner = np.searchsorted(self.first, where, "right") - 1
            last = np.append(owner[1:] != owner[:-1], True)
            covered = np.where(last, k, np.minimum(k, np.append(np.diff(where), k)))
            edges = np.flatnonzero(np.append(True, last[:-1]))
            who = owner[edges]
            found += who[np.add.reduceat(covered, edges) >= coverage * self.sizes[who]].tolist()
        return sorted(found)


def tile(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item in a document: (item position, document position, length) of each tile.

    Runs of ``k`` unmarked words are matched by Karp-Rabin for falling k; each match is extended to its full unmarked
    length, and the longest matches are marked first, ties by item position, then document position.
    """
    free_d, free_i = doc >= 0, np.ones(len(item), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    run_d, run_i = Running(doc), Running(item)
    k = _longest(run_d, run_i, free_d, free_i, min_tile, min(len(item), len(doc)))
    while k >= min_tile:
        hd, hi = run_d.of(k), run_i.of(k)
        ok_d = ~_covered(~free_d, k)
        ok_i = np.flatnonzero(~_covered(~free_i, k))
        at = np.flatnonzero(ok_d & np.isin(hd, hi[ok_i])) if len(ok_i) else ok_i
        if not len(at):
            k = _longest(run_d, run_i, free_d, free_i, min_tile, k - 1)
            continue
        where: dict[int, list[int]] = {}
        for p in at.tolist():
            where.setdefault(int(hd[p]), []).append(p)
        for i in ok_i.tolist():
            if not free_i[i : i + k].all():
                continue
            for p in where.get(int(hi[i]), ()):
                if free_d[p : p + k].all() and np.array_equal(doc[p : p + k], item[i : i + k]):
                    free_d[p : p + k] = free_i[i : i + k] = False
                    tiles.append((i, p, k))
                    break
        k -= 1
    return tiles


def _longest(run_d: Running, run_i: Running, free_d: np.ndarray, free_i: np.ndarray, least: int, most: int) -> int:
    """The largest k from least to most for which unmarked runs match, else least - 1; found by halving, as matches nest."""
    low, high = least - 1, most
    while low < high:
        k = (low + high + 1) // 2
        hi = run_i.of(k)[~_covered(~free_i, k)]
        hit = len(hi) > 0 and bool(np.isin(run_d.of(k)[~_covered(~free_d, k)], hi).any())
        low, high = (k, high) if hit else (low, k - 1)
    return low


def matches(block: Block, text: str | None, min_tile: int, coverage: float) -> Iterator[tuple]:
    """The items of a block that leak into a text: (item_id, words, matched words, coverage, tiles, their places)."""
    get = block.vocabulary.get
    ids = np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)
    for n in block.candidates(ids, coverage):
        item = block.items[n]
        tiles = sorted(tile(ids, item, min(min_tile, len(item))))
        matched = sum(t[2] for t in tiles)
        if matched >= coverage * len(item):
            said = " ".join(f"{i}:{p}:{k}" for i, p, k in tiles)
            yield block.ids[n], len(item), matched, matched / len(item), len(tiles), said


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, str]]]:
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in items.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1].split()) + 1
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(
    docs: DataFrame,
    items: DataFrame,
    min_tile: int = 3,
    coverage: float = 0.6,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Returns (doc_id, item_id, item_words, matched_words, coverage, n_tiles, tiles), a row per contaminated pair.

    ``coverage`` is the share of the item's words that its tiles cover; pairs below the threshold are not returned.
    ``tiles`` lists item:document:length in words, by item position. Items of fewer than ``min_tile`` words are
    sought whole. Null, empty and wordless documents and items match nothing; a null doc_id or item_id is kept as
    it is. Equal documents and items give a row each, repeated rows repeated pairs. Texts of any length are searched
    whole, in time that grows with their length and the number of lengths at which tiles are found. Other columns are
    ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_words long, matched_words long, coverage double, n_tiles long, tiles string"
    out = spark.createDataFrame([], schema)
    for held in _blocks(items, block_words):
        shared = spark.sparkContext.broadcast(Block(held, min_tile))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in small_batches(batches):
                rows = [
                    (doc_id.as_py(), *found)
                    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True)
                    for found in matches(block, text.as_py(), min_tile, coverage)
                ]
                if rows:
                    names = ("doc_id", "item_id", "item_words", "matched_words", "coverage", "n_tiles", "tiles")
                    kinds = (*[pa.int64()] * 4, pa.float64(), pa.int64(), pa.string())
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = out.unionByName(found)
    return out


def clean(
    docs: DataFrame,
    items: DataFrame,
    min_tile: int = 3,
    coverage: float = 0.6,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, into whose text no test item leaks; one pass a block, no shuffle.

    Rows without a text or a doc_id are judged like others: null, empty and wordless texts stay, repeated rows stay or go
    alike. Extra columns of any name pass through. Long texts are searched whole. Empty tables give an empty result.
    """
    for held in _blocks(items, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Block(held, min_tile))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in small_batches(batches):
                texts = batch.column(batch.schema.get_field_index("text"))
                keep = [not any(True for _ in matches(block, t.as_py(), min_tile, coverage)) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
