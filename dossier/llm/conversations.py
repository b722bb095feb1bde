"""Repair of the turns of conversations at least cost, by a dynamic program shared over a prefix trie of signatures.

A conversation's rows, in order of turn, become a signature of one symbol a row: the role's initial and the row's fault. The
cheapest edits depend on the signature alone, and a layer of the program (for every state of the wanted role sequence
the least cost and the least edits that reach it) depends on a prefix of it. So the distinct signatures are sorted, which
walks their trie in depth-first order: a stack holds the layers of the prefix at hand, signatures that share a prefix
share its layers, and the answer of a signature is read off at its last layer. Each task takes a range of the order, so
a prefix is worked out once a task at most.

Rows go through tasks in order of conversation and turn, a batch at a time: the first pass moves digests of texts and
makes signatures, the second moves the texts and hashes what is repaired. A conversation's rows pass one task, since its
hash needs them in order, but are never held together: a task keeps one byte of signature and of edits a row, which is
what the result returns. Copies of a text in a conversation are found by an aggregate beforehand, so no task holds the
texts seen.

Nulls: a null role or text reads as one space (such a text is blank), a null turn sorts first and counts for no gap, a null conv_id is a
conversation of its own. Rows of one turn come by role and then by the SHA-256 of their text; rows equal in all are copies, of
which all but one are duplicates. Texts of any length are read whole. Other columns are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: What edits cost; an edit that keeps a truncated row adds ``TRUNCATED``.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The wanted sequence of role initials, ``(s?(ua)+)?``, as a machine: 0 start, 1 after s, 2 after u, 3 after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
#: State that an inserted or rerole'd row leads to; it is 'user' but after a user's row.
FORCED = {q: STEPS.get((q, "u"), STEPS.get((q, "a"))) for q in range(4)}
BEYOND = 1 << 30
DROPPED = "x"  # a row that has to go

SPACE = " \t\n\x0b\x0c\r"

Layer = tuple[tuple[int, int], ...]
FIRST: Layer = ((0, 0), *[(BEYOND, 9)] * 3)


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, symbol: str) -> tuple[int, Layer, tuple]:
    """The layer after one more row: (cost added to all, costs and ranks by state, for each state where it came from).

    A layer holds for each state the cost beyond the least one and the rank of its edits in ASCII order. Inserts are
    taken together with the row they precede, so no state's edits are a prefix of another's, and edits compare as the
    ranks of what they continue and then as what they add. Costs differ by a few units only, so there are few layers.
    """
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    best: dict[int, tuple] = {}
    for q, (cost, rank) in enumerate(layer):
        at = q
        for inserts in range(3 if cost < BEYOND else 0):  # a third insert leads where the first one led
            moves = [(DELETE, at, "D")]
            if symbol != DROPPED:
                moves.append((REROLE + extra, FORCED[at], "R"))
                if (at, role) in STEPS:
                    moves.append((extra, STEPS[at, role], "K"))
            for price, to, edit in moves:
                found = (cost + inserts * INSERT + price, rank, "I" * inserts + edit, q)
                if to not in best or found < best[to]:
                    best[to] = found
            at = FORCED[at]
    least = min(b[0] for b in best.values())
    order = {q: n for n, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
    after = tuple((best[q][0] - least, order[q]) if q in best else (BEYOND, 9) for q in range(4))
    return least, after, tuple((best[q][3], best[q][2]) if q in best else None for q in range(4))


def ends(layer: Layer) -> tuple[int, int, str]:
    """(cost beyond the layer's least, state, inserts at the end) of the cheapest and then least edits."""
    found = []
    for q, (cost, rank) in enumerate(layer):
        at = q
        for inserts in range(3):
            if cost < BEYOND and at in ACCEPTED:
                found.append((cost + inserts * INSERT, rank, "I" * inserts, q))
            at = FORCED[at]
    cost, _, tail, q = min(found)
    return cost, q, tail


class Trie:
    """The layers of the signature at hand; ``answer`` keeps those of the prefix that it shares with the one before."""

    def __init__(self) -> None:
        self.signature = ""
        self.layers: list[tuple[int, Layer, tuple]] = [(0, FIRST, ())]
        self.made = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; those asked in sorted order share all common prefixes."""
        shared, most = 0, min(len(signature), len(self.signature))
        while shared < most and signature[shared] == self.signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            cost, layer, _ = self.layers[-1]
            more, after, back = step(layer, symbol)
            self.layers.append((cost + more, after, back))
        self.made += len(signature) - shared
        self.signature = signature
        cost, layer, _ = self.layers[-1]
        more, q, tail = ends(layer)
        edits = [tail]
        for n in range(len(signature), 0, -1):
            q, edit = self.layers[n][2][q]
            edits.append(edit)
        return cost + more, "".join(reversed(edits))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of conversations with damage by crc32(conv_id:turn) % 20: conv_id, turn, role, text, copies (0 if dropped, 2 if repeated)."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the digest of their text, and the character by which it ends ('' if it is blank), without the text."""
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    return rows.select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), end.alias("ends"), "copies")


def _firsts(marked: DataFrame) -> DataFrame:
    """A marker a text of a conversation, at the turn where it first stands."""
    first = F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first")
    found = marked.where("copies > 0").groupBy("conv_id", "role", "digest").agg(first)
    return found.select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit("").alias("ends"), F.lit(-1).alias("copies"))


def _in_order(rows: DataFrame, *after_turn: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *after_turn)


SIGNED = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


class _Reader:
    """What a conversation's rows, coming in order, amount to."""

    def __init__(self, conv) -> None:
        self.conv, self.symbols = conv, bytearray()
        self.turns, self.low, self.high, self.before = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial, self.fresh, self.used = None, None, None

    def add(self, turn, role: str, digest: str, ends_with: str, copies: int) -> None:
        row = (turn, role, digest)
        if copies < 0:
            self.fresh = row
            return
        for _ in range(copies):
            if turn is not None and turn != self.before:
                self.turns += 1
                self.low, self.high, self.before = turn if self.low is None else self.low, turn, turn
            initial = role[:1]
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = initial
            symbol = initial if initial in ("s", "u", "a") else "o"
            if not ends_with:
                self.blank += 1
                symbol = DROPPED
            elif row != self.fresh or row == self.used:
                self.duplicate += 1
                symbol = DROPPED
            elif ends_with not in ".!?":
                self.truncated += 1
                symbol = symbol.upper()
            self.used = row
            self.symbols += symbol.encode()

    def result(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {
            "conv_id": self.conv, "signature": self.symbols.decode(), "gaps": gaps, "blank": self.blank,
            "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
        }


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of rows, also by the bytes of their strings, as those of one conversation may be many."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) >= size or weight > 1 << 24:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


SIGNED_ARROW = pa.schema([("conv_id", pa.int64()), ("signature", pa.string())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[dict]:
        reader = None
        for conv, turn, role, digest, ends_with, copies in _rows(batches):
            if reader is None or reader.conv != conv:
                if reader:
                    yield reader.result()
                reader = _Reader(conv)
            reader.add(turn, role, digest, ends_with, copies)
        if reader:
            yield reader.result()

    yield from _batches(results(), SIGNED_ARROW)


def signatures(rows: DataFrame) -> DataFrame:
    """Signature and counts of every conversation of damaged rows, those without any row left included."""
    marked = _marked(rows)
    both = marked.unionByName(_firsts(marked))
    return _in_order(both, F.col("turn").asc_nulls_first(), "role", "digest", "copies").mapInArrow(_sign, SIGNED)


ANSWERS = "signature string, cost long, audit string"
ANSWERS_ARROW = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()

    def results() -> Iterator[dict]:
        for (signature,) in _rows(batches):
            cost, audit = trie.answer(signature)
            yield {"signature": signature, "cost": cost, "audit": audit}

    yield from _batches(results(), ANSWERS_ARROW)


def answers(signed: DataFrame) -> DataFrame:
    """Cost and edits of every distinct signature; ranges of the sorted signatures share their prefixes' layers."""
    return signed.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_answer, ANSWERS)


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED = "conv_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"
REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Writer:
    """Applies a conversation's edits to its rows as they come and hashes the rows repaired."""

    def __init__(self, conv, facts: dict, audit: str) -> None:
        self.conv, self.facts, self.audit, self.at, self.state = conv, facts, audit, 0, 0
        self.hash, self.begun = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
        self.begun = True

    def forced(self, text: str) -> None:
        self.state = FORCED[self.state]
        self.put("user" if self.state == 2 else "assistant", text)

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.forced("")

    def add(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state, role[:1]]
            self.put(role, text)
        elif edit == "R":
            self.forced(text)

    def result(self) -> dict:
        self.inserts()
        return {"conv_id": self.conv, **self.facts, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[dict]:
        writer = None
        for conv, facts, audit, role, text, copies in _rows(batches, 64):
            if audit is not None:
                if writer:
                    yield writer.result()
                writer = _Writer(conv, facts, audit)
                continue
            for _ in range(copies):
                writer.add(role, text)
        if writer:
            yield writer.result()

    yield from _batches(results(), REPAIRED_ARROW)


def applied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Conversations with their faults, edits and the hash of the rows repaired; a conversation's edits come as a row before its own."""

    def null(kind):
        return F.lit(None).cast(kind)

    facts = F.struct(*FACTS)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    heads = found.select("conv_id", facts.alias("facts"), "audit", null("string").alias("role"), null("string").alias("text"), F.lit(0).alias("copies"), null("long").alias("turn"), null("string").alias("digest"))
    own = rows.where("copies > 0").select("conv_id", null(heads.schema["facts"].dataType).alias("facts"), null("string").alias("audit"), "role", "text", "copies", "turn", digest.alias("digest"))
    order = (F.col("audit").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"))
    sent = _in_order(heads.unionByName(own), *order).select("conv_id", "facts", "audit", "role", "text", "copies")
    return sent.mapInArrow(_repair, REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired rows of every conversation.

    ``rows`` holds conv_id, turn, role, text and copies as ``damaged`` gives them; for turns as they are, copies is 1.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("int").alias("copies"))
    # Both are written, so that the sides of the join are plain exchanges and a signature that many share can be split.
    signed = stash(signatures(rows), "conversation-signatures")
    found = signed.join(stash(answers(signed), "conversation-answers"), "signature").drop("signature")
    return applied(rows, found)
