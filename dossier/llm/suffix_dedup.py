"""Suffix-array deduplication by column-wise construction of a collection's Burrows-Wheeler transform.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id. The
work is cut so that equal strings always meet and nothing else is sorted:

1. Every window of ``length`` bytes names its anchor: the run of ``ANCHOR`` bytes in it with the smallest hash. Equal
   windows have equal anchors. Neighbouring windows with one anchor form a segment (at most 2 * length - ANCHOR bytes).
2. Segments are dealt out by anchor, as hashes of their bytes. An anchor of one document holds no match. Copies of a
   segment are folded: all but those of the smallest id go whole, as each of their windows starts there too. Copies are
   told by 64 bits of the anchor and 64 of the segment, not by bytes.
3. Anchors with several different segments need their bytes. Those segments form collections whose Burrows-Wheeler
   transform and common prefixes are built column by column: each round inserts one symbol per segment, right to left,
   into sequential external files (unnamed scratch files of the task, like a spill; a round reads a column through and
   writes the next). In the finished order, windows are equal where the common prefix is ``length`` or more, and all but
   those of the smallest id go.

Equal segments met inside one slice of a map task are folded at once, so a passage that a third of all documents
share leaves each slice as one row. An anchor with very many different segments (a line before or after which many
documents differ) would be one task's work. Such anchors are found beforehand in a sample of the documents, and their
segments are dealt out by more than the anchor: cut by the place that the anchor has in a window, with the bytes that
all windows of such places share (41 of 50 at least) as the key; and if a key of that kind is still too frequent, by
whole windows. Equal windows meet as before, whatever the sample finds, and the same steps 2 and 3 decide about them.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash

LENGTH = 50
ANCHOR = 16
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20
#: Bytes of segments in a collection, about.
COLLECTION_BYTES = 1 << 20
#: Ranges of the anchor's place in a window that are told apart before sorting, and by which frequent anchors are cut.
RANGES = 4
#: One document in so many is looked at for frequent keys. A key is frequent if it is thought to have more different
#: segments than this share of a partition's, and this many at least; so there are fewer than PARTS a partition.
SAMPLE, PARTS, LEAST_FREQUENT = 32, 4, 1024
A1, A2, A3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x100000001B3)


@contextlib.contextmanager
def _freeing(spark: SparkSession):
    """Shuffle files go when the query that wrote them has ended; each step here ends in a written table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * A1
    x ^= x >> np.uint64(32)
    x *= A2
    x ^= x >> np.uint64(29)
    return x


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from every position on, as numbers."""
    out = np.empty(max(0, len(data) - 7), dtype=np.uint64)
    for j in range(min(8, len(out))):
        out[j::8] = np.frombuffer(data, "<u8", count=(len(data) - j) // 8, offset=j)[: len(out[j::8])]
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the hash base and of its inverse, kept up to the size of a slice."""
    if not _POWERS or len(_POWERS[0]) < n:
        one, inverse = np.ones(1, dtype=np.uint64), np.uint64(pow(int(A3), -1, 1 << 64))
        made = [np.cumprod(np.concatenate([one, np.full(n - 1, x, dtype=np.uint64)])) for x in (A3, inverse)]
        if n > 2 * SLICE_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def _ranges(length: int, n: int) -> list[tuple[int, int]]:
    """The places that an anchor can have in a window, as n ranges, both ends included."""
    rest = length - min(ANCHOR, length)
    edges = [(rest + 1) * k // n for k in range(n)]
    return [(a, b - 1) for a, b in zip(edges, [*edges[1:], rest + 1], strict=True)]


def _in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the values a sorted array holds."""
    if not len(held):
        return np.zeros(len(values), dtype=bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def segments(texts: list[bytes], length: int = LENGTH, frequent: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """Segments of whole texts: (text number, start, shape, key, hash of the bytes).

    shape is the number of bytes (below 256) and, times 256, the place of the anchor in the segment. The key is the
    anchor's hash. Segments whose key is among the first array of ``frequent`` keys (sorted) are cut into parts by ranges
    of the anchor's place, with keys that take in the bytes which all windows of a part share; parts whose key is among
    the second array into single windows.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    total = int(sizes.sum())
    empty = np.zeros(0, dtype=np.int64)
    if not total or sizes.max() < length:
        return empty, empty, empty, empty, empty
    mixed = _mix(_eights(b"".join(texts) + bytes(length + 8)))
    anchor = min(ANCHOR, length)
    n = total + length - anchor + 1
    h = mixed[:n].copy()
    for at in range(8, anchor - 7, 8):
        h = (h * A3) ^ mixed[at : at + n]
    if anchor > 8 and anchor % 8:
        h = (h * A3) ^ mixed[anchor - 8 : anchor - 8 + n]
    h = _mix(h)
    # Leftmost smallest hash of every window, by doubling.
    width, least, where, span = length - anchor + 1, h, np.arange(n, dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.minimum(least[step:], least[:-step])
        span += step
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(total)
    window = at[at + length <= ends[text]]
    chosen = where[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[window[1:]] != text[window[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    start, owner = window[first], text[window[first]]
    size = window[last] + length - start
    place, key = chosen[first] - start, h[chosen[first]].view(np.int64)
    # Hash of a run of bytes: a polynomial over its mixed eights, from running sums, scaled back to position zero.
    power, back = _powers(total + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed[:total] * power[:total])])

    def digest(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mix((sums[start + size - 7] - sums[start]) * back[start] + size.astype(np.uint64))

    for keys, ranges in zip(frequent, (_ranges(length, RANGES), _ranges(length, length - anchor + 1)), strict=False):
        cut = np.flatnonzero(_in(key, keys))
        if not len(cut):
            continue
        parts = [np.delete(x, cut) for x in (owner, start, size, place, key)]
        for n_range, (a, b) in enumerate(ranges):
            low = np.maximum(0, place[cut] - b)
            high = np.minimum(size[cut] - length, place[cut] - a)
            own = cut[low <= high]
            low, high = low[low <= high], high[low <= high]
            core = digest(start[own] + place[own] - a, np.full(len(own), a + length - b))
            own_key = _mix((core ^ key[own].view(np.uint64)) + np.uint64(n_range + 1)).view(np.int64)
            more = (owner[own], start[own] + low, high - low + length, place[own] - low, own_key)
            parts = [np.concatenate([x, y]) for x, y in zip(parts, more, strict=True)]
        owner, start, size, place, key = parts
    shape = size | place << 8
    return owner, start - (ends[owner] - sizes[owner]), shape, key, digest(start, size).view(np.int64)


def _frequent(docs: DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """Keys that are thought to have very many different segments, by a sample of the documents: anchors, then parts of those.

    The sample decides only how segments are dealt out, never which windows meet. Each array has fewer than PARTS
    entries a shuffle partition, so it may be collected and sent to all tasks.
    """
    spark = docs.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sampled = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit(SAMPLE)), F.lit(SAMPLE)) == 0)
    found: list[np.ndarray] = []
    for _ in range(2):

        def run(batches: Iterator[pa.RecordBatch], known=tuple(found)) -> Iterator[pa.RecordBatch]:
            for _, _, texts in _slices(batches):
                _, _, _, key, digest = segments(texts, length, known)
                both = np.unique(np.stack([key, digest], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "digest"])

        seen = sampled.mapInArrow(run, "key long, digest long").groupBy("key", "digest").agg(F.lit(1).alias("one")).groupBy("key").count()
        seen = stash(seen.where("count > 1"), "dedup-sampled-keys")  # most keys have one segment
        total = seen.agg(F.sum("count")).first()[0] or 0
        least = max(total / parts, LEAST_FREQUENT / SAMPLE)
        found.append(np.array(sorted(r[0] for r in seen.where(F.col("count") > least).select("key").collect()), dtype=np.int64))
        if not len(found[-1]):
            break
    return tuple(found)


class _Scratch:
    """A column in a sequential external file: written whole, read whole, and gone with the task."""

    def __init__(self, kind: type) -> None:
        self.kind, self.file = kind, tempfile.TemporaryFile()

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(np.ascontiguousarray(values, dtype=self.kind).data)
        self.file.flush()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), dtype=self.kind)

    def close(self) -> None:
        self.file.close()


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Smallest of every run of 1, 2, 4, ... values; a byte a value, so the levels stay small and fast to make."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        t, step = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(t[:-step], t[step:]))
    return table


def _range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of the values lo..hi, both included, for each query."""
    level = np.frexp(hi - lo + 1)[1] - 1
    out = np.empty(len(lo), dtype=np.int64)
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[k][lo[own]], table[k][hi[own] + 1 - (1 << int(k))])
    return out


def collection(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all texts in order: (text number, suffix length, preceding symbol, common prefix with the suffix before).

    Texts are UTF-8 of at most 255 bytes; symbols are bytes plus one, 0 stands before a whole text. Suffixes that are
    equal follow the texts' order. Common prefixes are counted up to 254. Round j inserts the suffix of length j of
    every text that long: its place follows from the place of its suffix of length j - 1 and the symbols before it, and
    its common prefix is one more than the smallest since the last suffix with the same preceding symbol.
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.append(np.frombuffer(b"".join(texts), dtype=np.uint8), np.uint8(0)) + np.uint8(1)
    ends = np.cumsum(sizes)
    bwt, lcp, names = (_Scratch(k) for k in (np.uint8, np.uint8, np.int32))
    try:

        def symbols(who: np.ndarray, length: int) -> np.ndarray:
            return np.where(length < sizes[who], flat[np.maximum(ends[who] - 1 - length, 0)], np.uint8(0))

        everyone = np.arange(m, dtype=np.int32)
        bwt.write(symbols(everyone, 0))
        lcp.write(np.zeros(m))
        names.write(everyone << 8)  # text number and suffix length in one
        who, place = everyone[sizes > 0], np.flatnonzero(sizes > 0)
        for length in range(1, int(sizes.max(initial=0)) + 1):
            old_b, old_l = bwt.read(), lcp.read()
            minima = _minima(old_l)
            total = len(old_b)
            order = np.argsort(old_b, kind="stable")
            rank = np.empty(total, dtype=np.int32)
            rank[order] = np.arange(total, dtype=np.int32)
            r = rank[place].astype(np.int64)
            symbol = old_b[place]
            target = m + r - int((old_b == 0).sum())  # suffixes that start with a symbol follow the m empty ones
            active = np.zeros(total, dtype=bool)
            active[place] = True
            before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, total - 1)]
            has_before = (r > 0) & (old_b[before] == symbol)
            has_after = (r + 1 < total) & (old_b[after] == symbol) & ~active[after]
            own = np.zeros(len(place), dtype=np.uint8)
            k = np.flatnonzero(has_before)
            if len(k):
                own[k] = np.minimum(254, 1 + _range_min(minima, before[k] + 1, place[k]))
            kept = np.ones(total + len(place), dtype=bool)
            kept[target] = False

            def merged(old: np.ndarray, fresh: np.ndarray) -> np.ndarray:
                out = np.empty(len(kept), dtype=old.dtype)
                out[kept] = old
                out[target] = fresh
                return out

            new_l = merged(old_l, own)
            k = np.flatnonzero(has_after)
            if len(k):
                new_l[target[k] + 1] = np.minimum(254, 1 + _range_min(minima, place[k] + 1, after[k]))
            bwt.write(merged(old_b, symbols(who, length)))
            lcp.write(new_l)
            names.write(merged(names.read(), who << 8 | length))
            goes_on = sizes[who] > length
            who, place = who[goes_on], target[goes_on]
        found = names.read()
        return found >> 8, found & 255, bwt.read(), lcp.read()
    finally:
        for s in (bwt, lcp, names):
            s.close()


def repeated_windows(texts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text number, start) of the windows that a text with a smaller id holds as well."""
    who, depth, _, lcp = collection(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    group = np.cumsum(lcp < length)
    full = np.flatnonzero(depth >= length)
    if not len(full):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    group, who, depth = group[full], who[full].astype(np.int64), depth[full].astype(np.int64)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(ids[who], edge)
    least = np.repeat(least, np.diff(np.append(edge, len(group))))
    hit = ids[who] > least
    return who[hit], sizes[who[hit]] - depth[hit]


#: A segment, the smallest id that holds it, its places (sub, start) there, and the place of its anchor in it.
Part = tuple[bytes, int, list[tuple[int, int]], int]
SEGMENT = "doc_id long, sub long, start int, shape int"
FLAGS = "doc_id long, sub long, start int, size int"


def _scan(docs: DataFrame, length: int, frequent: tuple[np.ndarray, ...]) -> DataFrame:
    """Segments of all documents, a row each, folded inside a slice: (anchor, digest, doc_id, code) and sub if docs has it.

    anchor is the segment's key, the anchor's hash unless that is frequent.

    code holds the start, whether the segment is known to go (a document with a smaller id in the same slice holds it)
    and the shape, see ``_unpack``. These rows are the bulk of what is shuffled, so they have no column to spare.
    """
    repeated = "sub" in docs.columns
    keys = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, subs, texts in _slices(batches):
            owner, start, shape, anchor, digest = segments(texts, length, keys.value)
            if not len(owner):
                continue
            doc = ids[owner]
            order = np.argsort(digest, kind="stable")
            first = np.flatnonzero(np.append(True, digest[order][1:] != digest[order][:-1]))
            least = np.empty(len(doc), dtype=np.int64)
            least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(doc))))
            known = doc > least
            # Known segments need not meet their like again; they ride along, spread by a number of their own.
            anchor[known] = _mix((start[known].astype(np.uint64) << np.uint64(20)) ^ doc[known].view(np.uint64)).view(np.int64)
            digest[known] = 0
            columns = [anchor, digest, doc, start << 16 | known.astype(np.int64) << 15 | shape]
            if repeated:
                columns.append(subs[owner])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "digest", "doc_id", "code", "sub"][: len(columns)])

    schema = "anchor long, digest long, doc_id long, code long" + ", sub long" * repeated
    return docs.select("doc_id", *["sub"] * repeated, "text").mapInArrow(run, schema)


def _unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, known to go, shape) of a packed segment."""
    return (code >> 16).astype(np.int32), code >> 15 & 1 == 1, (code & 0x7FFF).astype(np.int32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    ids, subs, texts, held = [], [], [], 0
    for batch in small_batches(batches):
        repeated = batch.column(1).to_pylist() if batch.num_columns == 3 else [0] * batch.num_rows
        for i, s, t in zip(batch.column(0).to_pylist(), repeated, batch.column(batch.num_columns - 1), strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            ids.append(i)
            subs.append(s)
            texts.append(data)
            held += len(data)
            if held >= SLICE_BYTES:
                yield np.array(ids, dtype=np.int64), np.array(subs, dtype=np.int64), texts
                ids, subs, texts, held = [], [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(subs, dtype=np.int64), texts


def _judge(scanned: DataFrame) -> DataFrame:
    """(doc_id, sub, start, shape, anchor): segments that go (anchor null), and those whose bytes are needed.

    Rows come by anchor, then segment, then document. An anchor is held back only while it has shown one segment of
    one document.
    """
    dealt = scanned.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the last batch ended in: its anchor, segment and that segment's smallest id, whether the anchor has
        # several segments, and the rows of its only segment's smallest id.
        tail: dict | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, g, d, code = (batch.column(n).to_numpy() for n in range(4))
            s = batch.column(4).to_numpy() if batch.num_columns == 5 else np.zeros(len(a), dtype=np.int64)
            at, known, shape = _unpack(code)
            if tail is None or tail["a"] != a[0]:
                tail, joins = None, False
            else:
                joins = True
            new_a = np.append(not joins, a[1:] != a[:-1])
            new_g = new_a | np.append(not (joins and tail["g"] == g[0]), g[1:] != g[:-1])
            # The smallest id of each row's segment; the first run may continue the last batch's.
            run_of = np.cumsum(new_g) - 1
            starts = np.flatnonzero(new_g)
            head = d[starts]
            if len(starts) and starts[0] == 0:
                least = head[run_of]
            else:
                least = np.append(np.array([tail["least"]], dtype=np.int64), head)[run_of + 1]
            whole = known | (d > least)
            # How many segments each anchor has in this batch; the first may have had some before.
            anchor_of = np.cumsum(new_a) - (0 if joins else 1)
            n_segments = np.bincount(anchor_of, weights=new_g & ~known, minlength=int(anchor_of[-1]) + 1).astype(np.int64)
            if joins:
                n_segments[0] += 2 if tail["many"] else 1
            many = n_segments[anchor_of] > 1
            need = many & ~whole
            out = [(x[whole | need]) for x in (d, s, at)] + [shape[whole | need]]
            marks = pa.array(a[whole | need], mask=whole[whole | need])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), marks], ["doc_id", "sub", "start", "shape", "anchor"])
            if joins and not tail["many"] and n_segments[0] > 1 and tail["held"]:
                yield from tail["held"]
            last = anchor_of == anchor_of[-1]
            again = joins and anchor_of[-1] == 0
            several = bool(n_segments[-1] > 1)
            held = list(tail["held"]) if again and not several and not tail["many"] else []
            if not several:
                k = last & ~whole
                held.append(
                    pa.RecordBatch.from_arrays([*(pa.array(x[k]) for x in (d, s, at, shape)), pa.array(a[k])], ["doc_id", "sub", "start", "shape", "anchor"])
                )
            tail = {"a": a[-1], "g": g[-1], "least": int(least[-1]), "many": several, "held": held}

    return dealt.mapInArrow(run, f"{SEGMENT}, anchor long")


def _may_match(group: list[Part], length: int) -> list[Part]:
    """Of one anchor's segments, the parts that may share a window with another segment.

    A window has its anchor at some place; for places from a to b it holds at least a bytes before the anchor and at
    least as many after it as one with place b. So two segments that share such a window agree in those bytes. What no
    other segment agrees with is cut off, and a segment shorter than a window goes.
    """
    rest = length - ANCHOR
    ranges = _ranges(length, RANGES)
    seen: dict[tuple[int, bytes], int] = {}
    keys: list[list[tuple[int, bytes] | None]] = []
    for part, _, _, at in group:
        own: list[tuple[int, bytes] | None] = []
        after = len(part) - at - ANCHOR
        for n, (a, b) in enumerate(ranges):
            if a <= at and rest - b <= after:
                k = (n, part[at - a : at + ANCHOR + rest - b])
                seen[k] = seen.get(k, 0) + 1
                own.append(k)
            else:
                own.append(None)
        keys.append(own)
    out = []
    for (part, doc, places, at), own in zip(group, keys, strict=True):
        hits = [r for r, k in zip(ranges, own, strict=True) if k is not None and seen[k] > 1]
        if not hits:
            continue
        # Windows with the anchor at hits[0][0] .. hits[-1][1] may match: bytes from the largest place before it on.
        first = max(0, at - hits[-1][1])
        last = min(len(part), at - hits[0][0] + length)
        if last - first >= length:
            out.append((part[first:last], doc, [(sub, start + first) for sub, start in places], at - first))
    return out


def _bytes_of(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, part, doc_id, sub, start, place) of segments: their keys and bytes."""
    wanted = needed.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "shape", "anchor")).alias("parts"))
    joined = docs.join(wanted, ["doc_id", "sub"]).select("doc_id", "sub", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = ["anchor", "part", "doc_id", "sub", "start", "place"]
        for batch in small_batches(batches, 64):
            rows: list[tuple] = []
            for i, s, t, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = t.as_py().encode("utf-8", "surrogatepass")
                starts, shapes, anchors = (parts.values.field(n).to_pylist() for n in range(3))
                for b, x, a in zip(starts, shapes, anchors, strict=True):
                    rows.append((a, data[b : b + (x & 255)], i, s, b, x >> 8))
                if len(rows) >= 16_384:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return joined.mapInArrow(run, "anchor long, part binary, doc_id long, sub long, start int, place int")


def _compare(parts: DataFrame, length: int) -> DataFrame:
    """(doc_id, sub, start, size): runs of windows that go, of segments by their keys."""
    dealt = parts.repartition("anchor").sortWithinPartitions("anchor", "part", "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Part] = []
        group: list[Part] = []
        held_bytes, anchor = 0, None

        def flush() -> pa.RecordBatch | None:
            who, start = repeated_windows([x[0] for x in held], np.array([x[1] for x in held], dtype=np.int64), length)
            order = np.lexsort((start, who))
            who, start = who[order], start[order]
            if not len(who):
                return None
            fresh = np.append(True, (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1))
            a = np.flatnonzero(fresh)
            b = np.append(a[1:], len(who)) - 1
            rows = [(held[w][1], sub, at + x, y - x + length) for w, x, y in zip(who[a].tolist(), start[a].tolist(), start[b].tolist(), strict=True) for sub, at in held[w][2]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in small_batches(batches, 4096):
            for a, part, doc, sub, start, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    if len(group) > 1:
                        met = _may_match(group, length)
                        held.extend(met)
                        held_bytes += sum(len(x[0]) for x in met)
                        if held_bytes >= COLLECTION_BYTES:
                            if (found := flush()) is not None:
                                yield found
                            held, held_bytes = [], 0
                    group, anchor = [], a
                if group and group[-1][0] == part:
                    if group[-1][1] == doc:
                        group[-1][2].append((sub, start))
                    continue  # later ids are known to go whole
                group.append((part, doc, [(sub, start)], place))
        if len(group) > 1:
            held.extend(_may_match(group, length))
        if held and (found := flush()) is not None:
            yield found

    return dealt.mapInArrow(build, FLAGS)


def _union(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes, begin and end, that the given runs cover; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order].astype(np.int64), starts[order].astype(np.int64) + sizes[order]
    reach = np.maximum.accumulate(b)
    new = np.append(True, a[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return list(zip(a[first].tolist(), reach[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def removed_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, sub, text, runs) for every row with a doc_id; runs is an array of (start, size) that go, maybe overlapping."""
    if not ANCHOR <= length <= 127:
        raise ValueError(f"length must be between {ANCHOR} and 127")
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with _freeing(spark):
        twice = stash(own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(1).alias("twice")), "dedup-ids")
        # sub tells rows apart that repeat a doc_id; without such rows it is 0 throughout and not carried along.
        keyed = own.withColumn("sub", F.lit(0).cast("long"))
        repeated = bool(twice.limit(1).count())
        if repeated:
            keyed = own.join(twice, "doc_id", "left").select("doc_id", F.when(F.col("twice") == 1, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("sub"), "text")
        usable = keyed.where("doc_id is not null and text is not null")
        frequent = _frequent(usable, length)
        judged = stash(_judge(_scan(usable if repeated else usable.drop("sub"), length, frequent)), "dedup-segments")
        needed = judged.where("anchor is not null")
        flags = judged.where("anchor is null").select("doc_id", "sub", "start", F.col("shape").bitwiseAND(255).alias("size"))
        flags = flags.unionByName(stash(_compare(_bytes_of(needed, usable), length), "dedup-runs-compared"))
        runs = stash(flags.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "size")).alias("runs")), "dedup-runs")
    return keyed.join(runs, ["doc_id", "sub"], "left")


def deduplicate(docs: DataFrame, length: int = LENGTH, return_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, spans), a row per row of ``docs``.

    kept are the remaining bytes joined (binary; null unless ``return_kept``), spans an array of (start, size) in bytes. Null texts are empty; texts
    shorter than ``length`` keep all. Texts of any length are read whole; extra columns of any name are ignored. Rows with a null doc_id keep all and remove nothing elsewhere. Rows that repeat a
    doc_id do not remove each other's bytes, as neither id is smaller. An empty table gives an empty result.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            rows = []
            for i, t, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                spans: list[tuple[int, int]] = []
                if runs.is_valid and len(runs.values):
                    spans = _union(runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy())
                kept, end = [], 0
                for a, b in spans:
                    kept.append(data[end:a])
                    end = b
                kept.append(data[end:])
                rest = b"".join(kept)
                rows.append((i, len(data), len(data) - len(rest), len(spans), rest if return_kept else None, hashlib.sha256(rest).hexdigest(), [{"start": a, "size": b - a} for a, b in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = removed_runs(docs, length).select("doc_id", "text", "runs")
    return found.mapInArrow(
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start:int,size:int>>",
    )


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """What ``deduplicate`` gives, by looking every window up; for tests."""
    first: dict[bytes, int] = {}
    data = {i: (t or "").encode("utf-8", "surrogatepass") for i, t in docs}
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            first.setdefault(data[i][k : k + length], i)
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, dtype=bool)
        for k in range(len(d) - length + 1):
            if first[d[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        rest = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out[i] = (len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out
