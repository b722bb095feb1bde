"""Main text of web pages as a maximum-scoring subsequence of the page's tokens.

A page is read as a sequence of tags and words. Words score positive, tags negative, with weights learned from
labelled pages (those that mark their own content with one ``article`` or ``main``): a tag costs the more the rarer it
is inside labelled content, a word counts the less the rarer its element is there. One linear scan finds the contiguous
region of the highest score. Menus, adverts and the like lie inside of articles too, so the labels cannot tell them
from text: elements that are boilerplate by name, role or class are left out of the region, and their tags cost what the
labelled pages say of such elements in content, so an advert amid an article does not end it.

A class names boilerplate by its words ('site-footer', 'nav'), unless it says what an element has, holds or lies beside
('has-sidebar', 'with-ads', 'content-sidebar'). A class that says something else too ('related-work', 'login-guide') is no evidence by
itself: such an element is boilerplate only if half or more of its words are links. ``html``, ``body``, ``article`` and ``main`` are
never boilerplate by class. An element that holds most of the words of its page is its wrapper and no boilerplate, a
form too; one named for comments, menus, footers and the like only if it holds nearly all of them.

Open elements are a stack with the places of each name, so every tag takes constant time, tags without a partner as well.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled pages that learning reads at most, by the smallest hashes of their page_id.
SAMPLE_PAGES = 2000

# HTML's element classes.
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button select dialog menu object svg canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3"))
PROSE = INLINE | HEADINGS | frozenset("p br li ul ol blockquote".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup share "
    "sharing social related recommended comment comments disqus reply replies respond widget login search toolbar pagination pager".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())

#: Words of a class that say, of the word after them, what an element has or lies beside; and states of what a word names.
RELATIONS = frozenset("has have with without no not show hide toggle content".split())
STATES = frozenset("open opened closed visible active enabled disabled collapsed expanded".split())
#: Words that stand beside the name of boilerplate and say nothing else.
NEUTRAL = frozenset(
    "list lists area section box block wrapper wrap container inner outer item items panel bar top bottom left right primary secondary main site page global user post posts articles "
    "story stories link links module group region zone slot unit row col column body form button buttons icon icons title text new the and js id div".split()
)
#: Elements that are never boilerplate by class; the shares of its page's words from which no other is, the second for those named so.
KEPT, MOST, NEARLY_ALL = frozenset(("html", "body", "article", "main")), 0.6, 0.95
#: Share of an element's words in links from which a class that says something else too makes it boilerplate.
LINKED = 0.5
NEVER_TEXT = frozenset("comment comments disqus reply replies respond nav navbar navigation menu footer cookie cookies consent login search".split())

# An attribute: its name, and after an equals sign a quoted value or one that goes on to the next space or the tag's end.
_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+"""
PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+)))?+""")
NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Weights:
    """Cost of each kind of tag and worth of a word in each kind of element; defaults for kinds never seen.

    By default the tags of running text cost least and the words of headings count most.
    """

    tag: dict[str, float] = field(default_factory=dict)
    word: dict[str, float] = field(default_factory=dict)

    def of_tag(self, kind: str, name: str, boilerplate: bool, inside: bool) -> float:
        """A tag of boilerplate costs what is known of it as boilerplate, next to nothing where the page marks the content."""
        if boilerplate:
            return -0.1 if inside or kind[0] == "/" else self.tag.get("!" + name, -2.0)
        return self.tag.get(kind, self.tag.get(name, -0.1 if name in PROSE else -0.5))

    def of_word(self, name: str, boilerplate: bool) -> float:
        return 0.0 if boilerplate else self.word.get(name, 1.5 if name in HEADINGS else 0.5)


def class_names(classes: list[str]) -> tuple[set[str], bool]:
    """The words by which classes and ids name an element boilerplate, and whether one of them says nothing else."""
    found, plain = set(), False
    for name in classes:
        words = NAME.findall(name)
        named = {w for n, w in enumerate(words) if w in BOILERPLATE_NAMES and RELATIONS.isdisjoint(words[:n]) and STATES.isdisjoint(words[n + 1 :])}
        found |= named
        plain |= bool(named) and all(w in BOILERPLATE_NAMES or w in NEUTRAL or w in RELATIONS or w in STATES or w.isdigit() for w in words)
    return found, plain


def forgiven(walked: list[tuple]) -> frozenset[int]:
    """Places of elements that their class or a form makes boilerplate and that are none: see the module's description."""
    total, linked, open_, held = 0, 0, [], []

    def close() -> None:
        first, least, _, words, links = open_.pop()
        held.append((first, least, total - words, linked - links))

    for what, name, text, _, _, (at, least, depth, in_link) in walked:
        while open_ and open_[-1][2] >= depth:
            close()
        if not what:
            words = 0 if name in RAW else len(text.split())
            total += words
            linked += words if in_link else 0
        elif at >= 0:
            open_.append((at, least, depth, total, linked))
    while open_:
        close()
    return frozenset(at for at, least, n, links in held if n and (n >= least * total if least else links < LINKED * n))


def pieces(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(what, name, text or kind, boilerplate, in content) of each tag ('<' or '>') and text ('') in page order."""
    walked = list(walk(page, frozenset()))
    if spared := forgiven(walked):
        walked = list(walk(page, spared))
    for what, name, text, bad, inside, _ in walked:
        yield what, name, text, bad, inside


class Open:
    """The open elements: (name, boilerplate, in content), with the places of each name and of those that end paragraphs."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.ends: list[int] = []

    def top(self) -> tuple[str, bool, bool]:
        return self.stack[-1] if self.stack else ("", False, False)

    def push(self, name: str, bad: bool, inside: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE and name != "p":
            self.ends.append(len(self.stack))
        self.stack.append((name, bad, inside))

    def pop(self) -> tuple[str, bool, bool]:
        name, bad, inside = self.stack.pop()
        self.places[name].pop()
        if self.ends and self.ends[-1] == len(self.stack):
            self.ends.pop()
        return name, bad, inside

    def close(self, name: str) -> tuple[str, bool, bool] | None:
        """Closes up to the innermost element of a name; None if none is open."""
        if not self.places.get(name):
            return None
        while len(self.stack) > self.places[name][-1] + 1:
            self.pop()
        return self.pop()

    def close_like(self, name: str) -> None:
        """Closes an open ``p`` or ``li`` that no other block stands between."""
        if (own := self.places.get(name)) and (not self.ends or own[-1] >= self.ends[-1]):
            self.close(name)


def walk(page: str, spared: frozenset[int]) -> Iterator[tuple[str, str, str, bool, bool, tuple[int, float, int, bool]]]:
    """As ``pieces``, with (place, share, depth, in a link): the depth of the innermost element that it lies in, and of an
    element that its class alone or a form makes boilerplate the place of the tag, else -1, and the share of the page's
    words from which it is none (0: it depends on its links).

    A closing tag closes up to its element, one without an element is ignored, ``p`` and ``li`` close their like, and
    content elements are never inside of boilerplate that was left open. Elements at ``spared`` places are not
    boilerplate by class.
    """
    elements = Open()
    at, n = 0, len(page)
    while at < n:
        m = PIECE.search(page, at)
        end = m.start() if m else n
        if end > at:
            top = elements.top()
            yield "", top[0], page[at:end], top[1], top[2], (-1, 0.0, len(elements.stack), bool(elements.places.get("a")))
        if not m:
            return
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if closed := elements.close(name):
                yield ">", name, "/" + name, closed[1], closed[2], (-1, 0.0, len(elements.stack), False)
            continue
        classes: list[str] = []
        hidden = False
        if m.group(3):
            for key, *values in ATTRIBUTE.findall(m.group(3)):
                key, value = key.lower(), "".join(values).lower()
                if key in ("class", "id"):
                    classes += value.split()
                elif key == "role":
                    hidden |= value.strip() in BOILERPLATE_ROLES
                elif key == "hidden":
                    hidden = True
                elif key == "style" and "none" in value and re.search(r"display\s*:\s*none", value):
                    hidden = True
        bad = name in RAW or name in BOILERPLATE_TAGS or hidden
        place, least = -1, 0.0
        if classes and not bad and name not in KEPT:
            why, plain = class_names(classes)
            if why:
                place, least = m.start(), 0.0 if not plain else MOST if why.isdisjoint(NEVER_TEXT) else NEARLY_ALL
                bad = place not in spared
        elif name == "form" and not hidden:
            place, least = m.start(), MOST
            bad = place not in spared
        kind = name + "." + ".".join(sorted({w for c in classes for w in NAME.findall(c)})) if classes else name
        if name in CONTENT and not bad:
            while elements.top()[1]:
                elements.pop()
        elif name == "body":
            elements = Open()
        elif name in ("p", "li"):
            elements.close_like(name)
        above = elements.top()
        inside = above[2] or name in CONTENT
        yield "<", name, kind, bad or above[1], inside, (place, least, len(elements.stack), False)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            if not close:
                return
            at = close.start()
            elements.push(name, True, inside)
        elif name not in VOID and not m.group(0).endswith("/>"):
            elements.push(name, bad or above[1], inside)


def extract(page: str | None, weights: Weights) -> str:
    """Main text of a whole page: blocks in page order, white space as one space; empty for null and empty pages.

    Tags are read to their end as browsers do: quoted values may hold anything, others go on to the next space.
    """
    if not page:
        return ""
    tokens: list[tuple[str, str, str, bool]] = []
    scores: list[float] = []
    for what, name, text, bad, inside in pieces(page):
        if what:
            scores.append(weights.of_tag(text, name, bad, inside))
        else:
            words = len(text.split())
            scores.append(words * weights.of_word(name, bad))
        tokens.append((what, name, text, bad))
    first, last = best_region(scores)
    out: list[str] = []
    for what, name, text, bad in tokens[first:last]:
        if bad:
            out.append(" ")
        elif what:
            if name not in INLINE:
                out.append(" ")
        else:
            out.append(html.unescape(text) if "&" in text else text)
    return " ".join("".join(out).split())


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; the first and longest of equals; (0, 0) if none is positive."""
    best, first, last = 0.0, 0, 0
    run, start = 0.0, 0
    for n, s in enumerate(scores):
        if run <= 0.0:
            run, start = 0.0, n
        run += s
        if run > best or (run == best and best > 0.0 and start == first):
            best, first, last = run, start, n + 1
    return first, last


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from labelled pages, at most ``sample_pages``, those with the smallest hashes; the defaults if there is none.

    Null and empty pages have no label. Pages whose page_id and html are equal count together, so the sample is the same
    however rows are dealt. Other columns are ignored; an empty table gives the defaults.
    """
    marked = pages.where(F.regexp_count("html", F.lit("(?i)<(article|main)[ >]")) == 1)
    # The hashes alone are sorted; the pages at or below the last one are read where they lie.
    h = F.xxhash64("page_id", "html")
    last = marked.select(h.alias("h")).orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    if last is None:
        return Weights()
    marked = marked.where(h <= last).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in small_batches(batches):
            for page in batch.column(0):
                for what, name, text, bad, inside in pieces(page.as_py()):
                    if bad:  # boilerplate elements cost alike, whatever their class; what they hold is no text
                        if what == "<":
                            seen[inside][f"t:!{name}"] += 1
                    elif what:
                        seen[inside].update([f"t:{text}", f"t:{name}"] if text not in (name, "/" + name) else [f"t:{text}"])
                    elif words := len(text.split()):
                        seen[inside][f"w:{name}"] += words
        keys = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (seen[1], seen[0]))], ["kind", "inside", "outside"])

    counted = marked.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    weights = Weights()
    for kind, i, o in counted.collect():  # kinds of tags of the sampled pages
        odds = math.log((i + 0.5) / (o + 0.5))
        if kind[0] == "t":
            weights.tag[kind[2:]] = max(-6.0 if kind[2] == "!" else -10.0, min(-0.1, odds - 1.0))
        else:
            weights.word[kind[2:]] = 1.0 / (1.0 + math.exp(-max(-4.0, min(4.0, odds))))
    return weights


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of ``pages``; text is empty for null, empty and textless pages.

    Null page_id and url stay null; repeated rows are kept; pages of any length are read whole; other columns, named as
    they may be, are ignored. An empty table gives an empty result.
    """
    model = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            texts = [extract(p.as_py(), model.value) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
