"""Personal data: fixed base patterns, and information-theoretic sanitisation of terms that give entities away.

Base spans (emails, addresses, cards, phones) are the protected entities. Corpus co-occurrence tells how strongly a
term reveals one: of all documents that hold the term, the share in which it lies around the entity estimates
P(entity | term). Copies count once on both sides: the share is the lesser of that of distinct texts and that of
distinct fingerprints (SimHash), so near copies do not make a word look revealing, and neither does one form filled in
for many entities. A share counts at the lower end of its confidence interval, unless the term is exclusive to the
entity: then two fingerprints suffice, or one if the term is written as a name (a capital inside a sentence). Terms at or
above the disclosure threshold are generalised, those at or above the removal threshold removed, wherever they occur.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash
from .simhash import fingerprint

KINDS = ("email", "ip", "card", "phone", "term")
#: Words before and after an entity that count as its surroundings.
WINDOW = 6
#: Fingerprints in which a term that is no name must surround an entity before its share means anything.
LEAST_CLASSES = 2
#: Shares of a term's documents from which it is generalised or removed.
GENERALISE, REMOVE = 0.5, 0.9
#: Terms that one broadcast block holds (16 bytes each); more terms take more passes.
BLOCK_TERMS = 8_000_000
#: Words a worker remembers its answers for, and (term, document) pairs it holds before it sends them on.
REMEMBERED, HELD = 500_000, 200_000

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start in the middle of digits only if the digits' start failed, and then it fails too.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
TERM = re.compile(r"[^\W_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if n % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost and not overlapping within a kind, by start and then kind."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            # The local part is all that fits before the @ and after the last match.
            start = m.start()
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), 0))
                end = m.end()
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1


def _words_outside(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, word in lower case) of the words that no base span touches."""
    found: list[tuple[int, int, str]] = []
    rest = iter(sorted((a, b) for a, b, _ in spans))
    span = next(rest, None)
    for m in TERM.finditer(text):
        while span and span[1] <= m.start():
            span = next(rest, None)
        if not span or m.end() <= span[0]:
            found.append((m.start(), m.end(), m.group().lower()))
    return found


def _document(text: str) -> int:
    """Hash that copies of a text share, whatever their case and white space."""
    return _hash(" ".join(text.lower().split()))


def _class(text: str) -> int:
    """The text's fingerprint as a signed number; near copies mostly share it."""
    print_ = fingerprint(text)
    return print_ - (1 << 64) if print_ >> 63 else print_


def _is_name(text: str, start: int) -> bool:
    """Whether a capital starts the word and no sentence or text does."""
    before = text[max(0, start - 8) : start].rstrip(" \t\r\n\"'([{")
    return text[start].isupper() and bool(before) and before[-1] not in ".!?"


def _around(text: str) -> Iterator[tuple[int, str, bool]]:
    """(entity, term, whether it is written as a name) of the words around each base span of a text."""
    spans = base_spans(text)
    if not spans:
        return
    terms = _words_outside(text, spans)
    starts, ends = [a for a, _, _ in terms], [b for _, b, _ in terms]
    for a, b, kind in spans:
        entity = _hash(kind, re.sub(r"[\s().-]", "", text[a:b].lower()))
        left, right = bisect_right(ends, a), bisect_left(starts, b)
        for n in (*range(max(0, left - WINDOW), left), *range(right, min(len(terms), right + WINDOW))):
            yield entity, terms[n][2], _is_name(text, starts[n])


class Terms:
    """Terms by hash with a number each, small enough to broadcast; what a worker asks again it remembers."""

    def __init__(self, hashes: list[int], values: list[float]) -> None:
        order = np.argsort(np.array(hashes, dtype=np.int64), kind="stable")
        self.hashes, self.values = np.array(hashes, dtype=np.int64)[order], np.array(values, dtype=np.float64)[order]

    def reader(self):
        """A function from a set of words to those that are terms, with their numbers."""
        asked: set[str] = set()
        terms: dict[str, float] = {}

        def of(words: set[str]) -> dict[str, float]:
            new = list(words - asked)
            if new and len(self.hashes):
                if len(asked) > REMEMBERED:
                    asked.clear()
                    terms.clear()
                    new = list(words)
                h = np.array([_hash(w) for w in new], dtype=np.int64)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                for n in np.flatnonzero(self.hashes[at] == h).tolist():
                    terms[new[n]] = float(self.values[at[n]])
                asked.update(new)
            return {w: terms[w] for w in terms.keys() & words}

        return of


def _blocks(rows: DataFrame, block_terms: int) -> Iterator[Terms]:
    """(hash, number) rows as blocks of bounded size."""
    hashes: list[int] = []
    values: list[float] = []
    for h, v in rows.toLocalIterator():
        hashes.append(h)
        values.append(v)
        if len(hashes) == block_terms:
            yield Terms(hashes, values)
            hashes, values = [], []
    if hashes:
        yield Terms(hashes, values)


def disclosing(docs: DataFrame, least: int = LEAST_CLASSES, share: float = GENERALISE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(term, share): terms whose documents surely hold them around one entity to at least ``share``.

    Terms are runs of three or more letters and digits in lower case. Null and empty texts hold none; texts of any
    length are read whole; rows with equal texts count once, whatever their ids. Only ``text`` is read, so other columns
    may have any name. An empty table, or one without base spans, gives an empty result.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for t in batch.column(0):
                found = list(_around(t.as_py())) if t.is_valid else []
                if found:
                    own = _document(t.as_py()), _class(t.as_py())
                    rows += [(*own, *f) for f in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["document", "class", "entity", "term", "name"])

    met = docs.select("text").mapInArrow(near, "document long, class long, entity long, term string, name boolean")
    # A term that is a name in one place and lower case in another of the same text is no name.
    met = met.groupBy("entity", "term", "class", "document").agg(F.min("name").alias("name"))
    met = met.groupBy("entity", "term", "class").agg(F.count("*").alias("documents"), F.min("name").alias("name"))
    met = met.groupBy("entity", "term").agg(F.sum("documents").alias("met"), F.count("*").alias("met_classes"), F.min("name").alias("name"))
    met = met.where((F.col("met_classes") >= least) | F.col("name")).drop("entity")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = pa.array([_hash(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, h], [*batch.schema.names, "hash"])

    met = stash(met.mapInArrow(hashed, "term string, met long, met_classes long, name boolean, hash long"), "pii-terms")

    def seen(limits: Terms) -> DataFrame:
        """Distinct documents and classes of terms: (hash, all, all_classes); terms that exceed their limit are left out.

        More distinct documents in one slice than the limit prove that a term's share is too small; it is reported as
        over once and its documents are not sent. A worker sends on what it holds whenever that is much.
        """
        wanted = docs.sparkSession.sparkContext.broadcast(limits)

        def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = wanted.value.reader()
            found: dict[str, set[tuple[int, int]]] = {}
            over: set[str] = set()
            size = 0

            def rows() -> pa.RecordBatch:
                flat = [(_hash(w), *d) for w, documents in found.items() for d in documents]
                columns = list(zip(*flat, strict=True)) or [(), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["hash", "document", "class"])

            for batch in small_batches(batches):
                for t in batch.column(0):
                    text = t.as_py()
                    if not text:
                        continue
                    spans = base_spans(text)
                    words = {w for _, _, w in _words_outside(text, spans)} if spans else set(TERM.findall(text.lower()))
                    held = of(words)
                    if not held or held.keys() <= over:
                        continue
                    own = _document(text), _class(text)
                    for w, limit in held.items():
                        if w in over:
                            continue
                        documents = found.setdefault(w, set())
                        size += own not in documents
                        documents.add(own)
                        if len(documents) > limit:
                            over.add(w)
                            size -= len(found.pop(w))
                if size > HELD:
                    yield rows()
                    found, size = {}, 0
            yield rows()
            gone = [_hash(w) for w in sorted(over)]
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64()), *(pa.nulls(len(gone), pa.int64()) for _ in range(2))], ["hash", "document", "class"])

        found = docs.select("text").mapInArrow(occurrences, "hash long, document long, class long").distinct()
        found = found.groupBy("hash", "class").agg(F.count("document").alias("documents"), F.count("*").alias("rows"))
        found = found.groupBy("hash").agg(F.sum("documents").alias("all"), F.sum("rows").alias("rows"), F.count("class").alias("all_classes"))
        return found.where(F.col("all") == F.col("rows")).drop("rows")

    limits = met.groupBy("hash").agg(F.floor(F.max("met") / F.lit(share)).cast("double").alias("most"))
    parts = [seen(block) for block in _blocks(limits, block_terms)]
    if not parts:
        return met.select("term", F.lit(0.0).alias("share")).limit(0)
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    # The lower end of a 90 % interval (Wilson), so that a few chance meetings do not condemn a common word.
    n, z = F.col("all_classes"), 1.645
    p = F.least(F.col("met") / F.col("all"), F.col("met_classes") / n)
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    joined = met.join(counted, "hash").select("term", p.alias("share"), low.alias("low"))
    return joined.where((F.col("low") >= share) | (F.col("share") == 1.0)).groupBy("term").agg(F.max("share").alias("share"))


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores after it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _marked(docs: DataFrame, terms: DataFrame, block_terms: int) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: base spans and term spans, arrays of (start, end, kind, share)."""
    kind = "array<struct<start:int,end:int,kind:string,share:double>>"
    base_name = _free("base_spans", docs.columns)
    term_name = _free("term_spans", [*docs.columns, base_name])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in batch.column(0).to_pylist()], pa.int64()), batch.column(1)], ["hash", "share"])

    blocks = _blocks(terms.select("term", "share").mapInArrow(hashed, "hash long, share double"), block_terms)
    out = docs.withColumn(base_name, F.lit(None).cast(kind)).withColumn(term_name, F.array().cast(kind))
    for held in [next(blocks, Terms([], [])), *blocks]:
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = shared.value.reader()
            for batch in small_batches(batches):
                at = {n: batch.schema.get_field_index(n) for n in ("text", base_name, term_name)}
                base, extra = [], []
                for t, old in zip(batch.column(at["text"]), batch.column(at[term_name]), strict=True):
                    text = t.as_py() or ""
                    spans = base_spans(text)
                    base.append([{"start": a, "end": b, "kind": k, "share": None} for a, b, k in spans])
                    new = old.as_py()
                    if len(shared.value.hashes) and (held := of(set(map(str.lower, TERM.findall(text))))):
                        new = new + [{"start": a, "end": b, "kind": "term", "share": held[w]} for a, b, w in _words_outside(text, spans) if w in held]
                    extra.append(new)
                columns = list(batch.columns)
                for name, values in ((base_name, base), (term_name, extra)):
                    columns[at[name]] = pa.array(values, type=batch.schema.field(at[name]).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
    return out, base_name, term_name


def all_spans(docs: DataFrame, terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``docs`` (which has a column text) with base_spans and spans of terms in term_spans: arrays of (start, end, kind, share).

    share is null in base spans. Null and empty texts have empty arrays, texts of any length are read whole, all rows
    are kept. If ``docs`` has columns of these names, the new ones get an underscore after theirs. An empty table stays empty.
    """
    return _marked(docs, terms, block_terms)[0]


def find(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans), a row per row of ``docs``.

    Null and empty texts have no span, texts of any length are read whole. Null doc_ids and repeated rows are kept;
    other columns are ignored; an empty table stays empty.
    """
    terms = stash(disclosing(docs, **how), "pii-disclosing")
    found = all_spans(docs.select("doc_id", "text"), terms).drop("text")

    def number(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [number(k) for k in KINDS[:4]]

    def joined(spans):
        order = F.array(*(F.lit(k) for k in KINDS))
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *n,
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "term_spans")).alias("spans"),
        F.size("term_spans").cast("long").alias("n_term"),
        (F.size("base_spans") + F.size("term_spans")).cast("long").alias("n_spans"),
    )


def general(text: str, start: int, end: int) -> str:
    """What a term is generalised to: its kind by the way it is written."""
    if any(c.isdigit() for c in text[start:end]):
        return "NUMBER"
    return "NAME" if _is_name(text, start) else "TERM"


def mask(text: str, spans: list[dict]) -> str:
    """The text with base spans named by kind, terms generalised or removed; overlapping spans go as one, by the first."""
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))):
        if s["start"] < end:
            end = max(end, s["end"])
            continue
        out.append(text[end : s["start"]])
        if s["kind"] != "term":
            out.append(f"[{s['kind'].upper()}]")
        elif s["share"] < REMOVE:
            out.append(f"[{general(text, s['start'], s['end'])}]")
        end = s["end"]
    out.append(text[end:])
    return "".join(out)


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with its columns and rows; in ``text`` personal data is masked and ``n_chars``, if there, follows it.

    Base spans become their kind in brackets, terms a more general word in brackets (name, number, term) or, from the
    removal share on, nothing. Null texts stay null, empty ones empty, repeated rows alike; rows without a doc_id are
    treated like others; extra columns of any name pass through. An empty table stays empty.
    """
    terms = stash(disclosing(docs, **how), "pii-disclosing")
    found, base_name, term_name = _marked(docs, terms, BLOCK_TERMS)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            texts = [
                mask(t.as_py(), b.as_py() + e.as_py()) if t.is_valid else None
                for t, b, e in zip(batch.column(at), batch.column(base_name), batch.column(term_name), strict=True)
            ]
            columns = {n: batch.column(n) for n in schema.names}
            columns["text"] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = found.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return out


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(written(base_spans(text)).encode()).hexdigest()
