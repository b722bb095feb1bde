"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most two bits share at least six of the eight
(position, byte) postings. A (position, byte) list alone would hold a 256th of all fingerprints, so lists are kept for
two postings from the start, and one that is too long to tally is split by a further position: its members go to the
lists of that position's bytes, and so on, a position at a time in ascending order, until the lists are short or six
positions are fixed. As every linked pair shares six positions, the first of them is among the first three, the second
among the first four, and so on, so only those are followed, and each linked pair meets in every list along its own positions.

In a list the shared positional bytes of each pair are tallied position by position, pairs that cannot reach the
guaranteed six any more go, and the rest are verified by their differing bits. Six fixed positions leave two bytes, so
no list holds more than 65,536 fingerprints, however large the corpus or a group of copies is, and lists are tallied in
strips no longer than their members. Equal fingerprints are one member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stash

SEED = 42
SHINGLE = 3
#: Bytes that must agree for a distance of two bits.
GUARANTEED = 6
#: Positions of a fingerprint.
POSITIONS = 8
#: Postings fixed from the start, members of a list from which it is split by a further position, and members tallied at a time.
BEGIN, LIST_ROWS, GATHERED = 2, 256, 1 << 16
#: Shingles counted at a time, so a text of any length needs bounded memory.
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + SHINGLE - 1]
        h = np.array([digest(join(x), SEED) for x in zip(part, part[1:], part[2:], strict=False)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row of documents; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _next(mask: int) -> list[int]:
    """Masks of one position more: later than all of a mask's, and early enough for six shared positions."""
    last = mask.bit_length() - 1
    return [mask | 1 << p for p in range(last + 1, mask.bit_count() + POSITIONS - GUARANTEED + 1)]


def _bytes_at(mask: int) -> int:
    """The bits of the positions of a mask, as a signed long; position 0 is the lowest byte."""
    return _signed(sum(0xFF << 8 * p for p in range(POSITIONS) if mask >> p & 1))


def _postings(members: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, rep, mask, at): the posting lists that members (fp, rep, mask) go to next; ``at`` holds the lists' bytes."""
    out = None
    for mask in masks:
        more = F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(_bytes_at(m))).alias("at")) for m in _next(mask)))
        case = F.when(F.col("mask") == mask, more)
        out = case if out is None else F.coalesce(out, case)
    return members.select("fp", "rep", F.inline(out))


def tally(fps: np.ndarray, sizes: np.ndarray, max_bits: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the linked pairs inside lists that lie one after another: tally shared bytes, keep the guaranteed count, verify.

    Pairs are taken by their distance in the list, those of all lists at once, so a strip has at most as many as members.
    """
    parts = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, POSITIONS)
    ends = np.cumsum(sizes)
    after = np.repeat(ends, sizes) - np.arange(len(fps)) - 1  # members that follow in the same list
    first, distance = np.flatnonzero(after >= 1), 1
    while len(first):
        i, j = first, first + distance
        shared = np.zeros(len(i), dtype=np.int8)
        for p in range(POSITIONS):
            shared += parts[i, p] == parts[j, p]
            if p >= POSITIONS - GUARANTEED:  # three misses or more leave fewer than six
                alive = shared >= p + 1 - (POSITIONS - GUARANTEED)
                i, j, shared = i[alive], j[alive], shared[alive]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        yield i[keep], j[keep]
        distance += 1
        first = first[after[first] >= distance]


def links(reps: DataFrame, max_bits: int = 2, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges (a, b) between the representatives of distinct fingerprints (fp, rep): every link that a list shows, once."""
    if not 0 <= max_bits <= POSITIONS - GUARANTEED:
        raise ValueError("the index guarantees links of at most two bits")
    begin = [0]
    for _ in range(BEGIN - 1):
        begin = [m for mask in begin for m in _next(mask)]
    whole = F.array(*(F.struct(F.lit(m).alias("mask")) for m in begin))
    open_, masks, lists = reps.select("fp", "rep", F.inline(whole)), begin, []
    for depth in range(BEGIN, GUARANTEED + 1):
        postings = _postings(open_, masks)
        # Counts combine before the shuffle; a list may hold a whole group of copies.
        sizes = stash(postings.groupBy("mask", "at").count(), f"posting-sizes-{depth}")
        met = stash(postings.join(sizes, ["mask", "at"]), f"postings-{depth}")
        short = F.lit(True) if depth == GUARANTEED else F.col("count") <= list_rows
        lists.append(met.where(short & (F.col("count") > 1)).select("mask", "at", "fp", "rep"))
        if depth == GUARANTEED:
            break
        open_ = met.where(~short).select("fp", "rep", "mask")
        if open_.isEmpty():
            break
        masks = sorted({m for mask in masks for m in _next(mask)})
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    grouped = every.groupBy("mask", "at").agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            sizes = batch.column("fps").value_lengths().to_numpy()
            part = np.cumsum(sizes) // GATHERED
            for first in np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist():
                n = int((part == part[first]).sum())
                fps, reps = (batch.column(c).slice(first, n).flatten().to_numpy() for c in ("fps", "reps"))
                pairs = [np.stack([reps[i], reps[j]], axis=1) for i, j in tally(fps.view(np.uint64), sizes[first : first + n], max_bits)]
                both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    edges = grouped.select("fps", "reps").mapInArrow(run, "a long, b long")
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, max_bits: int = 2, list_rows: int = LIST_ROWS) -> DataFrame:
    """Returns (doc_id, fp, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits, the row itself
    included. Null, empty and wordless texts have fingerprint zero and link like any other. Rows with a null doc_id
    get a fingerprint, take no part in linking and have a null component. Rows that repeat a doc_id are kept; their
    texts' classes are one, as the id is in all of them. Texts of any length are counted whole, in steps of bounded
    memory. An empty table gives an empty result; other columns are ignored.
    """
    prints = stash(fingerprints(docs), "fingerprints")
    reps = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = stash(reps, "fingerprint-classes")
    # A doc_id with several texts is one document, so it joins their classes.
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1")
    joined = prints.join(several, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links(reps, max_bits, list_rows).unionByName(joined))
    classes = stash(
        reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
            "fp", F.coalesce("root", "rep").alias("component")
        ),
        "fingerprint-components",
    )
    out = prints.join(classes, "fp", "left")
    return out.select(
        "doc_id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
