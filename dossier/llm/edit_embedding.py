"""Document fingerprints from a randomised embedding of edit distance into Hamming distance.

A walk reads a text's characters with a shared random string: at every step it writes the character at hand and, by a random bit
that the step and the character choose, stays on it or goes on to the next. Two texts walk with the same bits; after an
insertion or deletion their walks are apart, drift, and soon write the same characters at the same steps again, so
texts a few edits apart are written as sequences that differ at few steps. The random string repeats after ``PERIOD``
steps, so what follows from a step and a character is a table look-up, and a text's walk is one look-up a character.

The fingerprint samples the written sequence: each of ``SLOTS`` slots takes one step and keeps eight bits of the ``WINDOW``
characters written from there. A slot's step for a sequence is the last of its records below the sequence's length, a record being a step that
comes before all smaller ones in the slot's random order; so it is spread evenly over any length, and sequences of about the same
length sample the same steps. The likeness of two fingerprints is the share of equal slots.

``similar`` finds fingerprints like those of a set of queries: bands of a few slots propose pairs, all slots verify them.

A text's edited version goes on with the characters of the next document instead of its own second half. Documents are
dealt by ranges of doc_id, each text once, and a task walks on from one to the next; what stands at the ends of
the ranges is written apart and put together at the end, a pair of texts for each range.

A null text is empty; an empty text's slots are all zero. Rows without a doc_id come first; of rows with one doc_id the next is by a hash
of the text. The only document is its own next. Texts of any length are read whole, one and its next at a time. Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash

SLOTS, WINDOW, SEED = 128, 2, 42
#: Steps after which the random string repeats, and classes of characters that bits are chosen for.
PERIOD, CLASSES = 512, 32
#: Slots of a band: of two fingerprints with a likeness of 0.8, some band of 21 agrees in 998 of 1,000 cases.
BAND, LIKENESS = 6, 0.8
RECORDS = 64  # beyond 2^44 steps on average


def mixed(x: np.ndarray) -> np.ndarray:
    """Random bits for numbers (SplitMix64)."""
    x = x.astype(np.uint64) + np.uint64(SEED * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def states() -> list[list]:
    """A list for each step of the random string: by class of character the list where the next character is met; last its own step."""
    bits = (mixed(np.arange(PERIOD * CLASSES)) & np.uint64(1)).reshape(PERIOD, CLASSES).astype(bool)
    bits[0] |= ~bits.any(axis=0)
    after = np.zeros((PERIOD, CLASSES), dtype=np.int64)
    following = np.where(bits, np.arange(PERIOD)[:, None], PERIOD * 4)
    for c in range(CLASSES):
        twice = np.concatenate([following[:, c], following[:, c] + PERIOD])
        after[:, c] = (np.minimum.accumulate(twice[::-1])[::-1][:PERIOD] + 1) % PERIOD
    rows: list[list] = [[] for _ in range(PERIOD)]
    for step, row in enumerate(rows):
        row.extend(rows[k] for k in after[step].tolist())
        row.append(step)
    return rows


@cache
def records() -> np.ndarray:
    """Of each slot the steps that come before all smaller ones in its random order; after r the next is about r / (0 to 1)."""
    u = ((mixed(np.arange(SLOTS * RECORDS) + PERIOD * CLASSES) >> np.uint64(11)).astype(np.float64).reshape(SLOTS, RECORDS) + 0.5) / 2.0**53
    out = np.zeros((SLOTS, RECORDS), dtype=np.int64)
    for k in range(1, RECORDS):
        out[:, k] = np.minimum(np.floor((out[:, k - 1] + 1) / u[:, k]), 2.0**60).astype(np.int64)
    return out


@dataclass
class Walk:
    """A text's characters, and for each the step at which it is first written; last the step after all."""

    codes: np.ndarray
    steps: np.ndarray

    @staticmethod
    def of(text: str) -> Walk:
        return Walk(np.empty(0, np.uint32), np.zeros(1, np.int64)).on(0, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))

    def on(self, keep: int, codes: np.ndarray) -> Walk:
        """The walk over the first ``keep`` characters and then others, from the step that those lead to."""
        begin = int(self.steps[keep])
        classes = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - CLASSES.bit_length() + 1)).astype(np.uint8).tobytes()
        path = map(itemgetter(CLASSES), accumulate(classes, getitem, initial=states()[begin % PERIOD]))
        at = np.fromiter(path, dtype=np.int32, count=len(codes) + 1)
        stay = (np.diff(at) - 1) % PERIOD + 1
        return Walk(np.concatenate([self.codes[:keep], codes]), np.concatenate([self.steps[: keep + 1], begin + np.cumsum(stay, dtype=np.int64)]))

    def fingerprint(self) -> bytes:
        n = int(self.steps[-1])
        if not n:
            return bytes(SLOTS)
        own = records()
        first = own[np.arange(SLOTS), (own < n).sum(axis=1) - 1]
        at = np.searchsorted(self.steps, first[:, None] + np.arange(WINDOW), "right") - 1
        codes = np.append(self.codes.astype(np.uint64) + np.uint64(1), np.uint64(0))[at]
        value = np.zeros(SLOTS, dtype=np.uint64)
        for k in range(WINDOW):
            value = value * np.uint64(0x100000001B3) + codes[:, k]
        return (mixed(value) >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))


@dataclass
class Document:
    doc_id: int | None
    text: str
    walk: Walk
    print_: bytes

    @staticmethod
    def of(doc_id: int | None, text: str | None) -> Document:
        walk = Walk.of(text or "")
        return Document(doc_id, text or "", walk, walk.fingerprint())

    def row(self, after: Document) -> dict:
        """The document's result, given the document after it."""
        n = len(self.walk.codes)
        keep, put = n - n // 2, min(n // 2, len(after.walk.codes))
        edited = self.walk.on(keep, after.walk.codes[:put])
        own = edited.fingerprint()
        return {
            "doc_id": self.doc_id, "n_chars": n, "edited_sha256": hashlib.sha256((self.text[:keep] + after.text[:put]).encode()).hexdigest(),
            "fingerprint": self.print_.hex(), "edited_fingerprint": own.hex(),
            "near_edited": likeness(self.print_, own), "near_next": likeness(self.print_, after.print_),
        }


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PASSED = pa.schema([*RESULT, ("task", pa.int64()), ("part", pa.string()), ("text", pa.string())])
PASSED_DDL = RESULT_DDL + ", task long, part string, text string"


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a range but the last, and its first and last texts."""
    task, before, rows = TaskContext.get().partitionId(), None, []
    for batch in small_batches(batches, 64):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc = Document.of(doc_id, text)
            rows.append(before.row(doc) if before else {"doc_id": doc_id, "task": task, "part": "first", "text": doc.text})
            before = doc
        yield pa.RecordBatch.from_pylist(rows, PASSED)
        rows = []
    if before:
        yield pa.RecordBatch.from_pylist([{"doc_id": before.doc_id, "task": task, "part": "last", "text": before.text}], PASSED)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1):
        (row,) = batch.to_pylist()
        found = Document.of(row["doc_id"], row["text"]).row(Document.of(None, row["after"]))
        yield pa.RecordBatch.from_pylist([found], pa.schema(RESULT))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited version, with their likeness and that to the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first())
    passed = stash(rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(_pass, PASSED_DDL), "edit-fingerprints")
    # One number for each range, that is, for each partition of the shuffle.
    tasks = sorted(r["task"] for r in passed.where("part = 'first'").select("task").collect())
    links = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task long, following long")
    firsts = passed.where("part = 'first'").select(F.col("task").alias("following"), F.col("text").alias("after"))
    lasts = passed.where("part = 'last'").select("task", "doc_id", "text")
    ends = lasts.join(links, "task").join(firsts, "following").select("doc_id", "text", "after")
    return passed.where("part is null").select(*(c for c, _ in RESULT)).unionByName(ends.mapInArrow(_join, RESULT_DDL))


def bands(prints: DataFrame) -> DataFrame:
    """A row for each distinct fingerprint and band: fingerprint, band, key (the band's slots)."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)), lambda b: F.struct(b.alias("band"), F.substring("fingerprint", b * (2 * BAND) + 1, F.lit(2 * BAND)).alias("key")))
    return prints.select("fingerprint").distinct().select("fingerprint", F.explode(keys).alias("b")).select("fingerprint", "b.*")


def similar(prints: DataFrame, queries: DataFrame, least: float = LIKENESS) -> DataFrame:
    """Fingerprints like those of queries: (query, fingerprint, likeness of ``least`` or more), equal ones included.

    Both tables hold a column fingerprint; rows with one fingerprint are one entry, as their class, and join back by it.
    """
    a, b = bands(queries).withColumnRenamed("fingerprint", "query"), bands(prints)
    pairs = a.join(b, ["band", "key"]).select("query", "fingerprint").distinct()
    places = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    same = F.size(F.filter(places, lambda k: F.substring("query", 2 * k + 1, F.lit(2)) == F.substring("fingerprint", 2 * k + 1, F.lit(2))))
    return pairs.withColumn("likeness", same / SLOTS).where(F.col("likeness") >= least)
