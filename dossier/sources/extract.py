"""Text of documents by format, in Arrow batches: HTML, Markdown, RTF, DOCX, ODT, AbiWord, old Word files, plain text."""

from __future__ import annotations

import gzip
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formats import format_of

BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SKIPPED = frozenset(("script", "style", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Text of a page: hidden and skipped elements go, block elements break lines, ``pre`` keeps its spaces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.stack: list[tuple[str, bool, bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        above = self.stack[-1] if self.stack else ("", False, False)
        gone = above[1] or tag in SKIPPED or given.get("class") == "hidden" or given.get("id") == "hidden"
        gone = gone or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))
        if tag == "a" and not gone and given.get("href"):
            self.links.append(given["href"].strip())
        if tag in BLOCKS and not gone:
            self.out.append("\n")
        if tag not in VOID:
            self.stack.append((tag, gone, above[2] or tag == "pre"))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                gone = self.stack[k][1]
                del self.stack[k:]
                if tag in BLOCKS and not gone:
                    self.out.append("\n")
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else ("", False, False)
        if top[1]:
            return
        if top[2]:
            self.out.append(data)
        elif text := " ".join(data.split()):
            if self.out and not self.out[-1][-1:].isspace():
                self.out.append(" ")
            self.out.append(text)


def unique_links(links: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for x in links:
        if x.strip() and not x.strip().lower().startswith("javascript:"):
            seen.setdefault(x.lower(), x)
    return list(seen.values())


def from_html(markup: str) -> tuple[str, list[str]]:
    page = _Page()
    page.feed(markup)
    page.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(page.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip(), unique_links(page.links)


def from_markdown(text: str) -> tuple[str, list[str]]:
    """The common subset: headings, emphasis, code, quotes, lists, links and images."""
    links = re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)", text) + re.findall(r"<(https?://[^>\s]+)>", text)
    text = re.sub(r"(?m)^```.*$", "", text)
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"<(https?://[^>\s]+)>", r"\1", text)
    text = re.sub(r"(?m)^\s{0,3}(#{1,6}\s+|>\s?)", "", text)
    text = re.sub(r"(?m)^\s*(?:[-*_]\s*){3,}$", "", text)
    text = re.sub(r"(\*\*|__|~~|`)(.+?)\1", r"\2", text)
    text = re.sub(r"(?<!\w)[*_]([^*_\n]+)[*_](?!\w)", r"\1", text)
    return html.unescape(text).strip(), unique_links(links)


def from_rtf(text: str) -> str:
    """Control words go, escapes and paragraph marks become text; destinations such as font tables are left out."""
    out: list[str] = []
    skip, depth = None, 0
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}]+)", text):
        hexed, number, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            depth += 1
        elif brace == "}":
            depth -= 1
            if skip is not None and depth < skip:
                skip = None
        elif skip is not None:
            continue
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict") or sign == "*":
            skip = depth
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif hexed:
            out.append(bytes([int(hexed, 16)]).decode("cp1250", "replace"))
        elif number:
            out.append(chr(int(number) % 65536))
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif plain:
            out.append(re.sub(r"[\r\n]", "", plain))
    return "".join(out).strip()


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:4096].upper():
        raise ValueError("document types are refused")
    return ElementTree.fromstring(data)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def from_docx(content: bytes) -> tuple[str, list[str], bool]:
    """Paragraphs as lines, external links, and whether there are drawings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(z.read("word/document.xml"))
        lines = ["".join(t.text or "" if _local(t) == "t" else "\t" if _local(t) == "tab" else "\n" if _local(t) == "br" else "" for t in p.iter()) for p in body.iter() if _local(p) == "p"]
        links = []
        if "word/_rels/document.xml.rels" in z.namelist():
            for r in _xml(z.read("word/_rels/document.xml.rels")):
                if r.get("TargetMode") == "External" and str(r.get("Type", "")).endswith("/hyperlink"):
                    links.append(r.get("Target", ""))
        drawings = any(_local(e) in ("drawing", "pict") for e in body.iter())
    return "\n".join(lines).strip(), unique_links(links), drawings


def from_odt(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = _xml(z.read("content.xml"))
    return "\n".join("".join(e.itertext()) for e in root.iter() if _local(e) in ("p", "h")).strip()


def from_abw(content: bytes) -> str:
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    return "\n".join("".join(e.itertext()) for e in _xml(data).iter() if _local(e) == "p").strip()


def from_doc(content: bytes) -> str:
    raw = content.decode("latin-1")
    runs = (" ".join(r.split()) for r in re.findall(r"[\x20-\x7E\xA0-\xFF\t\r\n]{25,}", raw))
    return "\n\n".join(dict.fromkeys(r for r in runs if len(r) >= 25))


def decode(content: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1250", "replace")


def text_of(fmt: str, content: bytes) -> tuple[str | None, list[str], list[str], str | None]:
    """(text, links, warnings, error) of a document; unsupported and broken documents are errors, never exceptions."""
    try:
        links: list[str] = []
        warnings: list[str] = []
        if fmt == "Html":
            text, links = from_html(decode(content))
        elif fmt == "Markdown":
            text, links = from_markdown(decode(content))
        elif fmt == "Docx":
            text, links, drawings = from_docx(content)
            warnings = ["drawings_ignored"] if drawings else []
        elif fmt in READERS:
            text = READERS[fmt](content)
        else:
            return None, [], [], "unsupported_format"
        return (text, links, warnings, None) if text.strip() else (None, links, warnings, "empty_text")
    except Exception:  # a row-level error by design: any reader may meet any bytes
        return None, [], [], "unreadable"


READERS: dict[str, Callable[[bytes], str]] = {
    "PlainText": decode,
    "Latex": decode,
    "Rtf": lambda c: from_rtf(c.decode("latin-1")),
    "Odt": from_odt,
    "Abw": from_abw,
    "Doc": from_doc,
}
SCHEMA = "path string, format string, text string, links array<string>, warnings array<string>, error string"


def extract(files: DataFrame) -> DataFrame:
    """Text of files (path, content, error): a row each. LaTeX is returned as source; see functions.text.latex_to_text."""
    text = F.when(F.lower("path").rlike(r"\.(json|xml)$"), F.col("content").cast("string"))
    named = files.select("path", format_of(F.col("path"), text).alias("format"), "content", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, fmt, content, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = (None, [], [], error) if error or content is None else text_of(fmt, content)
                rows.append((path, fmt, *found))
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "format", "text", "links", "warnings", "error"])

    return named.mapInArrow(run, SCHEMA)


def page_text(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, text, links) of HTML in a column; whole body, as an importer reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [from_html(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))], ["key", "text", "links"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), column).mapInArrow(run, f"key {kind}, text string, links array<string>").withColumnRenamed("key", key)
