"""Periodic runs of words, found by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words that repeats its first ``period`` words at least three times, 24 words or more, and that no
neighbouring word extends; its period is the smallest one. Stretches of several texts, divided by marks that occur once,
are worked on as one sequence:

1. Names of all its factors of 1, 2, 4, ... words give its suffix array, and by comparing names from long to short the
   longest common extension of any two places, to the right or to the left. Equal names are equal words: nothing is hashed.
2. Its Lempel-Ziv blocks: each begins where the longest earlier copy ends. A repeat that lies inside of a block stands earlier too, so
   the leftmost of its kind crosses a block's start; extensions about the starts, for as many periods as the two blocks
   beside it have words, find all that cross one. They cover the leftmost place of every kind of repeat.
3. From the suffix-tree locus of a covered repeat its suffix links lead to the loci of its rotations, which completes
   the vocabulary of kinds. The tree is the suffix array with its common prefixes: a locus is a range of it.
4. The suffixes below the loci are all places where a repeat stands; places side by side with one period merge into a run.

A repeat of the length looked for matches itself 16 words or more further on, so texts in which no 16 words occur twice
hold none, and in others only the words under such a pair are looked at. That is found with hashes, which may let through
too much but lose nothing. Texts are dealt as they lie: nothing is shuffled.

A null text has no words. A null doc_id is kept as it is, and its text is not edited. Texts of any length are read whole. Equal rows give equal
results, an empty table none, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words and repetitions that a run has at least; words that it then has twice.
LENGTH, POWER = 24, 3
GRAM = LENGTH - LENGTH // POWER
#: Words that are looked through at once, and words of repetitive stretches that are worked on at once.
LOOK, SOLVE = 1 << 19, 1 << 18


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one document in ten with its tail made periodic, by the CRC-32 of its id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def repetitive(texts: list[list[bytes]]) -> list[list[tuple[int, int]]]:
    """Of each text the stretches (first word, end) of words under 16 words that the text has twice or more."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    if not sizes.sum():
        return out
    values = np.fromiter((hash(w) for words in texts for w in words), dtype=np.int64, count=int(sizes.sum())).view(np.uint64)
    grams, width = values, 1
    while width < GRAM:
        grams = grams[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) ^ (grams[width:] >> np.uint64(7)) + grams[width:]
        width *= 2
    if not len(grams):
        return out
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    whole = np.flatnonzero(np.arange(len(grams)) + GRAM <= ends[text[: len(grams)]])
    keys = grams[whole] ^ (text[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return out
    at = whole[np.isin(keys, twice)]
    # Runs of places at most 16 words apart, in one text, cover one stretch.
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > GRAM) | (np.diff(text[at]) > 0)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    for a, b in zip(at[first], at[last], strict=True):
        n = int(text[a])
        begin = int(ends[n] - sizes[n])
        if b + GRAM - a >= LENGTH:
            out[n].append((int(a) - begin, int(b) + GRAM - begin))
    return out


class Sequence:
    """Names of the factors of a sequence of numbers whose first and last occur once, and its suffix array."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = n = len(values)
        self.names = [np.unique(values, return_inverse=True)[1].astype(np.int32)]
        width = 1
        while self.names[-1].max() < n - 1:
            last = self.names[-1].astype(np.int64)
            after = np.zeros(n, dtype=np.int64)
            after[:-width] = last[width:] + 1
            self.names.append(np.unique(last * (n + 2) + after, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.rank = self.names[-1]
        self.places = np.empty(n, dtype=np.int64)
        self.places[self.rank] = np.arange(n)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on, i and j being different places."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for level in range(len(self.names) - 2, -1, -1):
            step = (self.names[level][i] == self.names[level][j]).astype(np.int64) << level
            i += step
            j += step
        return i - begin

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree up to i and up to j, these included."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for level in range(len(self.names) - 2, -1, -1):
            a, b = i - (1 << level) + 1, j - (1 << level) + 1
            inside = (a >= 0) & (b >= 0)
            step = (inside & (self.names[level][np.where(inside, a, 0)] == self.names[level][np.where(inside, b, 0)])).astype(np.int64) << level
            i -= step
            j -= step
        return begin - i


def blocks(s: Sequence) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest factor that also begins earlier, or one new word."""
    before, after, stack = [-1] * s.n, [-1] * s.n, []
    for p in s.places.tolist():  # next earlier places to either side in the suffix array
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)
    longest = np.zeros(s.n, dtype=np.int64)
    for near in (np.array(before), np.array(after)):
        here = np.flatnonzero(near >= 0)
        longest[here] = np.maximum(longest[here], s.right(here, near[here]))
    jumps, starts, at = np.maximum(longest, 1).tolist(), [], 0
    while at < s.n:
        starts.append(at)
        at += jumps[at]
    return np.array(starts, dtype=np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of so many members: (group, member's number from 0)."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering(s: Sequence, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the longest stretches with repeats of the length looked for that cross a block's start."""
    starts = blocks(s)
    sizes = np.diff(np.append(starts, s.n))
    found = []
    # The block's start lies in the repeat's first half: the second half is inside of the block, so the period is no longer.
    group, k = _spread(sizes[1:])
    b, k = starts[1:][group], k + 1
    ok = b + k < s.n
    b, k = b[ok], k[ok]
    ok = words[b - 1] == words[b + k - 1]
    b, k = b[ok], k[ok]
    found.append((b - s.left(b - 1, b + k - 1), b + k + s.right(b, b + k), k))
    # It lies in the second half, which begins in the block before, or that block would have gone on.
    group, k = _spread(sizes[:-1] + sizes[1:])
    b, k = starts[1:][group], k + 1
    ok = b - k - 1 >= 0
    b, k = b[ok], k[ok]
    ok = (words[b] == words[b - k]) & (words[b - 1] == words[b - k - 1])
    b, k = b[ok], k[ok]
    found.append((b - k - s.left(b - 1, b - k - 1), b + s.right(b, b - k), k))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = end - start >= np.maximum(LENGTH, POWER * period)
    start, end, period = start[ok], end[ok], period[ok]
    # A multiple of a stretch's period gives the same stretch.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)])[: len(start)]
    return start[new], end[new], period[new]


def loci(s: Sequence, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (first, last) of the suffix array whose suffixes agree with those of places ``at`` in ``depth`` words."""
    common = np.zeros(s.n, dtype=np.int32)
    common[1:] = s.right(s.places[:-1], s.places[1:])
    least = [common]
    while (width := 1 << len(least)) <= s.n:
        least.append(np.minimum(least[-1][: s.n - width + 1], least[-1][width // 2 : s.n - width // 2 + 1]))
    low = s.rank[at].astype(np.int64)
    high = low + 1  # the first suffix after that does not agree with the one before it
    for level in range(len(least) - 1, -1, -1):
        width = 1 << level
        ok = low - width + 1 >= 0
        low -= np.where(ok & (least[level][np.where(ok, low - width + 1, 0)] >= depth), width, 0)
        ok = high + width <= s.n
        high += np.where(ok & (least[level][np.where(ok, high, 0)] >= depth), width, 0)
    return low, high - 1


def runs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence whose first and last numbers occur once."""
    s = Sequence(words)
    start, end, period = covering(s, words)
    depth = np.maximum(LENGTH, POWER * period)
    # Along the suffix links: the rotations that the covered stretch spells.
    group, turn = _spread(np.minimum(period, end - start - depth + 1))
    at, period, depth = start[group] + turn, period[group], depth[group]
    low, high = loci(s, at, depth)
    _, one = np.unique(low * (s.n + 1) + period, return_index=True)
    low, high, period = low[one], high[one], period[one]
    group, turn = _spread(high - low + 1)
    at, period = s.places[low[group] + turn], period[group]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(period) != 0)])[: len(at)])
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    return at[first], at[last] - at[first] + np.maximum(LENGTH, POWER * period[first]), period[first]


def runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, int]] = []

    def solve() -> None:
        numbers: dict[bytes, int] = {}
        values = [np.array([-1])]
        for mark, (n, a, b) in enumerate(held):
            values += [np.array([numbers.setdefault(w, len(numbers)) for w in texts[n][a:b]]), np.array([-2 - mark])]
        begins = np.cumsum([len(v) for v in values])[:-1:2]
        for at, length, period in zip(*(x.tolist() for x in runs_of(np.concatenate(values))), strict=True):
            k = int(np.searchsorted(begins, at, "right")) - 1
            n, a, _ = held[k]
            out[n].append((a + at - int(begins[k]), length, period))
        held.clear()

    size = 0
    for n, stretches in enumerate(repetitive(texts)):
        for a, b in stretches:
            held.append((n, a, b))
            size += b - a
            if size >= SOLVE:
                solve()
                size = 0
    if held:
        solve()
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without what any run repeats, joined by one space."""
    if not found:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, period in found:
        gone[start + period : start + length] = b"\1" * (length - period)
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def _find(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    def result(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs(texts)
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
        kept = [collapsed(w, r) for w, r in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(kept, pa.string())], schema=FOUND_ARROW)

    ids, texts, size = [], [], 0
    for batch in small_batches(batches, 64):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or "").encode().split()  # of bytes, so at ASCII spaces only
            ids.append(doc_id)
            texts.append(planted(words, doc_id) if plant else words)
            size += len(words)
            if size >= LOOK:
                yield result(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield result(ids, texts)


def find(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs of every text's words (numbered from 0, by start and period) and its text without what they repeat.

    ``plant`` first makes the tail of one text in ten periodic, by its id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _find(batches, plant), FOUND)


def report(found: DataFrame) -> DataFrame:
    """Of each document the number of runs, the one with the greatest exponent, and digests of runs and collapsed text."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    first = F.when(F.size("runs") > 0, F.element_at("runs", 1))
    best = F.aggregate("runs", first, lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"))
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
