"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause one after another, each rewriting the symbols of the one before it, and are
composed into one machine:

* insult: marks words of the learned lexicon (whole words and stems) as insults, with their learned weight;
* threat: marks the inflections of verbs of harm as threats, a symbol of their own, with a learned weight for each verb;
* target: remembers for a few words that someone was addressed or named (pronouns, groups, a capitalised word inside a
  clause); a match in reach is aimed, and a target soon after a match aims it as well;
* negation: remembers for a few words that something was denied; a match in reach is denied;
* reported speech: remembers a verb of saying until the clause ends, and whether a quotation is open; a match then is
  reported. A closing mark or the end of the line ends the quotation.

A match is worth its weight times the gains of its arcs (aimed, denied, reported). Gains start from constants and are
moved by the labelled sample: by how much more or less often matches on such arcs stand in toxic texts. Matched clauses
are scored, not isolated words: an insult or a threat without any target counts as a match of the bare arc. A document's
clause scores go through a logistic calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator  # noqa: UP035  (pandas_udf reads this form)

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash

#: Labelled rows of each class that learning reads at most, by the smallest hashes of their doc_id.
SAMPLE_ROWS = 4000
#: Lengths of word stems that may carry weight.
STEMS = (4, 5, 6)
#: An entry needs this many toxic training texts (a twentieth of them where that is less), and this log odds ratio.
LEAST_DOCS, LEAST_ODDS = 24, 2.5
#: Texts in which words beside the lexicon's have to show a stem before they can speak against it.
LEAST_OTHER = 3

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n\"“”«»]")
ENDS = frozenset(".!?;\n")
QUOTES = frozenset("\"“”«»")
# Closed word classes of the grammar.
_EN, _FR, _ES = ("", "s", "ed", "ing"), "er e es ez ent ait ant era erai é ée és ées".split(), "ar as a an amos aba aron ando ado ados aré ará arte arlos".split()
THREATS: dict[str, list[tuple[str, list[str] | tuple[str, ...]]]] = {
    "kill": [("kill", (*_EN, "er", "ers"))], "hurt": [("hurt", ("", "s", "ing"))], "destroy": [("destroy", _EN)], "beat": [("beat", ("", "s", "en", "ing"))], "shoot": [("shoot", ("", "s", "ing")), ("shot", ("",))],
    "stab": [("stab", ("", "s", "bed", "bing"))], "burn": [("burn", (*_EN, "t"))], "hang": [("hang", _EN), ("hung", ("",))], "strangle": [("strangl", ("e", "es", "ed", "ing"))], "murder": [("murder", _EN)],
    "töten": [("töt", "en e est et ete eten".split()), ("getötet", ("",))], "schlagen": [("schlag", "en e t".split()), ("schläg", ("t", "st")), ("geschlagen", ("",)), ("erschlagen", ("",))],
    "umbringen": [("umbring", "en e st t".split()), ("umgebracht", ("",)), ("umzubringen", ("",))], "vernichten": [("vernicht", "en e et ete eten".split())], "erschießen": [("erschieß", "en e t".split()), ("erschoss", ("", "en"))],
    "verbrennen": [("verbrenn", "en e st t".split()), ("verbrannt", ("", "e"))], "tuer": [("tu", _FR)], "frapper": [("frapp", _FR)], "brûler": [("brûl", _FR)], "étrangler": [("étrangl", _FR)],
    "détruire": [("détrui", "re s t sez sent sait te tes ra rai".split())], "matar": [("mat", _ES)], "golpear": [("golpe", _ES)], "quemar": [("quem", _ES)], "destruir": [("destru", "ir yes ye yen ía yó yendo ido iré irá irte".split())],
}
#: Verb of each of its inflections.
FORMS = {stem + ending: verb for verb, parts in THREATS.items() for stem, endings in parts for ending in endings}
TARGETS = frozenset("you your you're ya he she they him her them u du dich dir euch ihr sie tu toi vous ton ta tes vos il elle ils ellos ella él usted ustedes vosotros eres".split())
GROUPS = frozenset("women men immigrants foreigners refugees christians muslims jews gays liberals conservatives frauen männer ausländer flüchtlinge juden muslime femmes hommes étrangers immigrés juifs musulmans mujeres hombres extranjeros inmigrantes judíos musulmanes".split())
NEGATIONS = frozenset("not no never n't don't isn't aren't wasn't won't can't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says say wrote writes claimed claims called quoted quotes reported according sagte sagt schrieb behauptete dit écrit déclaré selon dijo dice escribió según".split())

#: How far, in words, a negation or a target reaches.
REACH = 3
#: Symbols between the transducers.
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
#: Arcs that a match may take, and their gains before anything is learned; the bare arc gains nothing.
ARCS = ("aimed", "denied", "reported")
PRIOR = {"aimed": 1.5, "denied": 0.4, "reported": 0.6}
#: Matches that a prior gain counts for.
PRIOR_MATCHES = 50.0
#: Share of a text's words that are capitalised inside of clauses from which they name nobody, as where nouns are written so, and the
#: words from which that can be told.
NOUNS, NOUN_WORDS = 0.2, 40
#: Weight of a threat before anything is learned.
THREAT_WEIGHT = 1.0


@dataclass(frozen=True)
class Transducer:
    """A finite-state transducer: (state, symbol) to (next state, symbol written, arcs named). State 0 begins a clause.

    ``keeps`` says whether the state outlives the clause.
    """

    arcs: dict[tuple[int, int], tuple[int, int, frozenset[str]]]
    keeps: dict[int, int] = field(default_factory=dict)

    def __call__(self, state: int, symbol: int) -> tuple[int, int, frozenset[str]]:
        return self.arcs[state, symbol]

    @property
    def states(self) -> set[int]:
        return {s for s, _ in self.arcs}


NONE: frozenset[str] = frozenset()
SYMBOLS = range(7)


def _lexical(own: int) -> Transducer:
    """One state: a word that the lexicon marks is written as that symbol; all others pass."""
    return Transducer({(0, s): (0, s, NONE) for s in SYMBOLS if s != own} | {(0, own): (0, own, NONE)})


def _reaching(trigger: int, arc: str) -> Transducer:
    """States count the words that the trigger still reaches; a match meanwhile takes the arc. The trigger passes."""
    arcs = {}
    for state in range(REACH + 1):
        for s in SYMBOLS:
            left = REACH if s == trigger else max(0, state - 1)
            if s == QUOTE:  # no word
                left = state
            arcs[state, s] = (left, s, frozenset((arc,)) if s in (INSULT, THREAT) and state else NONE)
    return Transducer(arcs)


def _reporting() -> Transducer:
    """State: 1 if a verb of saying came in this clause, plus 2 inside a quotation; the quotation outlives the clause."""
    arcs = {}
    for state in range(4):
        for s in SYMBOLS:
            after = state | 1 if s == REPORT else state ^ 2 if s == QUOTE else state
            arcs[state, s] = (after, s, frozenset(("reported",)) if s in (INSULT, THREAT) and state else NONE)
    return Transducer(arcs, keeps={s: s & 2 for s in range(4)})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what the first writes to the second; states are numbered pairs, (0, 0) is 0."""
    number = {(0, 0): 0}
    todo, arcs = [(0, 0)], {}
    keeps = {}
    while todo:
        a, b = pair = todo.pop()
        for s in SYMBOLS:
            x, mid, named = first(a, s)
            y, out, more = second(b, mid)
            if (x, y) not in number:
                number[x, y] = len(number)
                todo.append((x, y))
            arcs[number[pair], s] = (number[x, y], out, named | more)
        rest = (first.keeps.get(a, 0), second.keeps.get(b, 0))
        if rest not in number:
            number[rest] = len(number)
            todo.append(rest)
        keeps[number[pair]] = number[rest]
    return Transducer(arcs, keeps)


TRANSDUCERS = (_lexical(INSULT), _lexical(THREAT), _reaching(TARGET, "aimed"), _reaching(NEGATION, "denied"), _reporting())
MACHINE = TRANSDUCERS[0]
for _next in TRANSDUCERS[1:]:
    MACHINE = compose(MACHINE, _next)
#: The composed machine as tables: next state, arcs named, state at the start of the next clause.
STEP = [[MACHINE.arcs[q, s][0] for s in SYMBOLS] for q in sorted(MACHINE.states)]
NAMED = [[MACHINE.arcs[q, s][2] for s in SYMBOLS] for q in sorted(MACHINE.states)]
AFTER = [MACHINE.keeps.get(q, 0) for q in sorted(MACHINE.states)]


@dataclass
class Grammar:
    """Learned weights of words and stems, of threats and of arcs, and the calibration from clause scores to a probability."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    beta: tuple[float, ...] = (-2.0, 1.0, 0.0, 0.0)

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        stems = self.stems
        if stems:
            for k in STEMS:
                s = stems.get(word[:k]) if len(word) >= k else None
                if s is not None and s > w:
                    w = s
        return w

    def threat(self, verb: str) -> float:
        return self.threats.get(verb, THREAT_WEIGHT)

    def gain(self, named: frozenset[str]) -> float:
        out = 1.0
        for arc in named:
            out *= self.gains[arc]
        return out


def _names(tokens: list[str]) -> bool:
    """Whether capitals inside of clauses name someone: not where so many words have one that all nouns must."""
    words = capitals = 0
    begins = True
    for token in tokens:
        if token in ENDS:
            begins = True
            continue
        if token not in QUOTES:
            words += 1
            capitals += not begins and token[0].isupper()
        begins = False
    return words < NOUN_WORDS or capitals < NOUNS * words


def _symbol(token: str, word: str, inside: bool) -> int:
    """Symbol of a token that no lexicon marks; ``word`` is it in lower case, ``inside`` says that it may be a name by its capital."""
    if word in NEGATIONS:
        return NEGATION
    if word in REPORTS:
        return REPORT
    if word in TARGETS or word in GROUPS or (inside and token[0].isupper()):
        return TARGET
    return QUOTE if token in QUOTES else WORD


#: A match: its symbol, its weight, the arcs it takes.
Match = tuple[int, float, frozenset[str]]


def clauses(grammar: Grammar, text: str | None) -> tuple[list[list[Match]], int]:
    """The matches of each clause of a whole text that has any, and the number of tokens."""
    found: list[list[Match]] = []
    words = TOKEN.findall(text.lower()) if text else []
    memo: dict[str, tuple[int, float]] = {}
    marked: dict[int, tuple[int, float]] = {}
    spans: list[tuple[int, int]] = []
    start, hit_here = 0, False
    for n, word in enumerate(words):
        if word in ENDS:
            if hit_here:
                spans.append((start, n))
            start, hit_here = n + 1, False
            continue
        w = memo.get(word)
        if w is None:
            weight = grammar.weight(word)
            verb = FORMS.get(word)
            w = memo[word] = (INSULT, weight) if weight else (THREAT, grammar.threat(verb)) if verb else (WORD, 0.0)
        if w[0]:
            marked[n] = w
            hit_here = True
    if hit_here:
        spans.append((start, len(words)))
    if not marked:
        return found, len(words)
    tokens = TOKEN.findall(text)
    if len(tokens) != len(words):  # lower case may part a token, as with a dotted capital I
        tokens = words
    named = _names(tokens)
    # Clauses without a match change nothing unless a quotation, which outlives its clause, may open in them.
    if not QUOTES.isdisjoint(text):
        edges = [-1, *(n for n, word in enumerate(words) if word in ENDS), len(words)]
        spans = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
    state = 0
    for first, last in spans:
        state = 0 if first and words[first - 1] == "\n" else AFTER[state]  # a line end closes a quotation too
        since = REACH + 1
        matches: list[tuple[int, float, set[str]]] = []
        for n in range(first, last):
            hit = marked.get(n)
            symbol = hit[0] if hit else _symbol(tokens[n], words[n], named and n > first)
            if hit:
                matches.append((symbol, hit[1], set(NAMED[state][symbol])))
                since = 0
            elif symbol == TARGET and since <= REACH:
                matches[-1][2].add("aimed")
            state = STEP[state][symbol]
            since += symbol != QUOTE
        if matches:
            found.append([(s, w, frozenset(a)) for s, w, a in matches])
    return found, len(words)


def clause_scores(grammar: Grammar, text: str | None) -> tuple[list[float], int]:
    """Scores of the clauses of a whole text that the grammar matches, and the number of tokens."""
    found, words = clauses(grammar, text)
    return [sum(w * grammar.gain(a) for _, w, a in matches) for matches in found], words


def features(scores: list[float], words: int) -> tuple[float, float, float, float]:
    """What the calibration sees of a document: 1, its strongest clause, all clauses, matched clauses a 100 words."""
    if not scores:
        return 1.0, 0.0, 0.0, 0.0
    return 1.0, max(scores) / 4.0, math.log1p(sum(scores)), min(4.0, 100.0 * len(scores) / max(1, words))


def score(grammar: Grammar, text: str | None) -> float:
    """Probability, between 0 and 1, that a whole text is toxic; null and empty texts score as texts without a match."""
    z = sum(a * b for a, b in zip(grammar.beta, features(*clause_scores(grammar, text)), strict=True))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _entries(text: str) -> set[str]:
    """Words and stems of a text: 'w:' and the word, 's:' and a stem that is shorter than the word."""
    words = {t for t in TOKEN.findall(text.lower()) if len(t) > 1}
    return {f"w:{w}" for w in words} | {f"s:{w[:k]}" for w in words for k in STEMS if len(w) > k}


def _signature(text: str) -> int:
    """A hash of the smallest run of five words: near copies share it mostly, so they teach once."""
    w = text.lower().split()
    runs = (" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return min(xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs) >> 1


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, at most ``rows`` of each class.

    The rows are those with the smallest hashes of doc_id. Near copies among them (one signature) teach once, by the
    smallest doc_id and then text, so the sample is the same however the table is dealt. A doc_id with several labels
    counts as toxic if one says so; rows without an id, a text or a label of 0 or 1 teach nothing.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    joined = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    joined = joined.join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id")  # at most 2 x rows small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sign = pa.array([_signature(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()), sign], ["doc_id", "text", "toxic", "signature"])

    signed = joined.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, signature long")
    least = signed.groupBy("signature", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    return least.select("row.text", "toxic")


def held_out(doc_id):
    """True for rows whose crc32 of doc_id as text is divisible by five; learning never sees them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Grammar:
    """Fits lexicon, arcs and calibration on a bounded sample of labelled rows (``rows`` of each class at most).

    Without labelled rows of both classes the grammar has an empty lexicon, prior gains and the default calibration.
    """
    chosen = stash(sample(docs, labels, rows), "toxicity-sample")
    size = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                seen[toxic.as_py()].update(_entries(text.as_py()))
        keys = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([c[k] for k in part], pa.int64()) for c in (seen[1], seen[0]))], ["entry", "bad", "good"]
            )

    counted = chosen.select("text", "toxic").mapInArrow(count, "entry string, bad long, good long")
    counted = counted.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (F.lit(bad) - F.col("bad") + 1.0)) - F.log((F.col("good") + 0.5) / (F.lit(good) - F.col("good") + 1.0))
    least = min(LEAST_DOCS, max(2, bad // 20))
    top = counted.where(F.col("bad") >= least).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    found = top.collect()  # entries of the sampled texts
    grammar = Grammar()
    for row in found:
        (grammar.words if row["entry"][0] == "w" else grammar.stems)[row["entry"][2:]] = float(row["odds"])

    _prune_stems(chosen, grammar, bad, good)
    _learn_arcs(chosen, grammar)
    rough = docs.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [features(*clause_scores(rough.value, t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in zip(*rows, strict=True)), batch.column(1)], ["a", "b", "c", "d", "toxic"])

    seen = chosen.select("text", "toxic").mapInArrow(measure, "a double, b double, c double, d double, toxic int")
    points = np.array(sorted(tuple(r) for r in seen.collect()), dtype=np.float64)
    grammar.beta = _logistic(points[:, :4], points[:, 4])
    return grammar


def _prune_stems(chosen: DataFrame, grammar: Grammar, bad: int, good: int) -> None:
    """Drops stems that owe their odds to words of the lexicon while other words with them tell the contrary.

    Other words count in ``LEAST_OTHER`` texts or more; a stem without such words stays, as it may stand for inflections
    that the sample does not hold.
    """
    shared = chosen.sparkSession.sparkContext.broadcast(grammar)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        words, stems = shared.value.words, shared.value.stems
        for batch in small_batches(batches):
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                others = {w for w in TOKEN.findall(text.as_py().lower()) if w not in words}
                seen.update((s, toxic.as_py()) for s in {w[:k] for w in others for k in STEMS if len(w) > k} & stems.keys())
        rows = [(k, t, n) for (k, t), n in sorted(seen.items())]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["stem", "toxic", "n"])

    counted = chosen.select("text", "toxic").mapInArrow(count, "stem string, toxic int, n long").groupBy("stem", "toxic").agg(F.sum("n").alias("n"))
    n = {(r["stem"], r["toxic"]): r["n"] for r in counted.collect()}  # two rows a stem at most
    for stem in list(grammar.stems):
        b, g = n.get((stem, 1), 0), n.get((stem, 0), 0)
        odds = math.log((b + 0.5) / (bad - b + 1.0)) - math.log((g + 0.5) / (good - g + 1.0))
        if b + g >= LEAST_OTHER and odds < LEAST_ODDS:
            del grammar.stems[stem]


def _learn_arcs(chosen: DataFrame, grammar: Grammar) -> None:
    """Moves the weight of threats and the gains of arcs by the matches of the sample.

    The share of matches in toxic texts, on an arc against the bare matches of the same symbols, is the arc's gain; a
    prior of some matches holds rare arcs near their constants. A verb is worth the log odds of standing
    in toxic texts, whatever its inflection.
    """
    shared = chosen.sparkSession.sparkContext.broadcast(grammar)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small_batches(batches):
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                for word in TOKEN.findall(text.as_py().lower()):
                    if (verb := FORMS.get(word)) and not shared.value.weight(word):
                        seen["threat:" + verb, toxic.as_py()] += 1
                for matches in clauses(shared.value, text.as_py())[0]:
                    for _, _, arcs in matches:
                        for name in [*arcs] or ["bare"]:
                            seen[name, toxic.as_py()] += 1
        rows = [(k, t, n) for (k, t), n in sorted(seen.items())]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["name", "toxic", "n"])

    counted = chosen.select("text", "toxic").mapInArrow(count, "name string, toxic int, n long").groupBy("name", "toxic").agg(F.sum("n").alias("n"))
    n = {(r["name"], r["toxic"]): r["n"] for r in counted.collect()}  # a few rows a verb and arc
    bare = (n.get(("bare", 1), 0) + 1.0) / (n.get(("bare", 1), 0) + n.get(("bare", 0), 0) + 2.0)
    for arc, prior in PRIOR.items():
        bad, all_ = n.get((arc, 1), 0), n.get((arc, 1), 0) + n.get((arc, 0), 0)
        grammar.gains[arc] = max(0.1, min(3.0, (bad / bare + PRIOR_MATCHES * prior) / (all_ + PRIOR_MATCHES)))
    # A verb that stands in clean texts as often as in toxic ones is worth nothing; the prior holds for rare ones.
    for verb in THREATS:
        bad, good = n.get((f"threat:{verb}", 1), 0), n.get((f"threat:{verb}", 0), 0)
        odds = math.log((bad + PRIOR_MATCHES * math.e / (1 + math.e)) / (good + PRIOR_MATCHES / (1 + math.e)))
        grammar.threats[verb] = max(0.0, min(6.0, odds * THREAT_WEIGHT))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, both classes weighing the same."""
    b = np.zeros(x.shape[1])
    weight = np.where(y > 0.5, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    lam = np.diag([1e-6, *[ridge * len(y) / 100.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + lam, x.T @ (weight * (y - p)) - lam @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with a column ``toxicity_score`` (replacing one of that name); whole texts, no shuffle.

    The score reads the text alone, whole, however long it is. Null and empty texts get the score of a text without a
    match. Rows, ties and repeated rows are kept as they are, other columns pass through; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([score(model.value, t if isinstance(t, str) else None) for t in part], dtype="float64")

    return docs.withColumn("toxicity_score", of("text"))
