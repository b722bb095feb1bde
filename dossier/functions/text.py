"""Text columns: blanks, white space, normalisation, small string rules. White space is Unicode's throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a bullet line may start with, before a space.
BULLETS = "•◦▪*-"
#: Words that make a work description concrete (fixed values).
STRONG_VERBS = (
    "increased", "reduced", "delivered", "led", "built", "improved", "achieved", "implemented",
    "designed", "optimized", "migrated", "automated", "scaled", "created", "launched", "managed",
)
#: Longest text that assisted import takes.
SOURCE_LIMIT = 120_000
CZECH_ONLY = "ěřůĚŘŮ"
SLOVAK = "áäčďéíĺľňóôŕšťúýžÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ"


#: Unicode white space and its complement, spelled out: faster than the flag that means the same.
_WS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS, NOT_WS = f"[{_WS}]", f"[^{_WS}]"
#: The same as a list of characters, for functions that trim them.
WS_CHARS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(c: Column | str) -> Column:
    """At least one character that is no white space; false for null."""
    return F.coalesce(_col(c).rlike(NOT_WS), F.lit(False))


def nonws_len(c: Column | str) -> Column:
    """Number of characters that are no white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(_col(c), f"{WS}+", "")), F.lit(0))


def trim_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WS_CHARS))


def rtrim_ws(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(WS_CHARS))


def blank_to_null(c: Column | str) -> Column:
    """Null for blank, else the text without outer white space."""
    c = _col(c)
    return F.when(has_text(c), trim_ws(c))


def first_text(*cs: Column | str) -> Column:
    """First text that is not blank, trimmed; empty if there is none."""
    return F.coalesce(*(blank_to_null(c) for c in cs), F.lit(""))


def or_dash(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("-"))


def ci_key(c: Column | str) -> Column:
    """Key of case-insensitive comparisons; the value itself stays as it is."""
    return F.lower(trim_ws(_col(c)))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


def bullet_prefix(line: Column) -> Column:
    """A known bullet and a space become a hyphen and one space."""
    return F.regexp_replace(line, rf"^[{BULLETS[:-1]}\-] {WS}*", "- ")


def normalize(c: Column | str) -> Column:
    """Line ends, dashes, spaces, bullets and blank lines in one form; empty for null and blank texts."""
    c = F.regexp_replace(_col(c), r"\r\n?", "\n")
    c = F.translate(c, "\u2013\u2014\u2212", "---")
    lines = F.transform(F.split(c, "\n", -1), lambda x: bullet_prefix(collapse_spaces(x)))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.when(has_text(c), trim_ws(joined)).otherwise(F.lit(""))


def lines_of(c: Column | str) -> Column:
    """Non-empty trimmed lines of a text."""
    parts = F.transform(F.split(F.regexp_replace(_col(c), r"\r\n?", "\n"), "\n", -1), trim_ws)
    return F.filter(parts, lambda x: x != "")


def split_items(c: Column | str, separators: str = "[,\n]") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), separators, -1), trim_ws), lambda x: x != "")


def paragraphs(c: Column | str) -> Column:
    return split_items(c, "\n\n")


def bounded(c: Column | str, most: int) -> Column:
    """Trimmed, cut to ``most`` characters, trimmed again at the end."""
    return rtrim_ws(F.left(trim_ws(_col(c)), F.lit(most)))


def truncated(c: Column, most: Column | int) -> Column:
    """Cut with a mark when longer than ``most``."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, most), F.lit("[...]")))


def source_text(c: Column | str) -> Column:
    return F.left(_col(c), F.lit(SOURCE_LIMIT))


def quality_reason(c: Column | str, pages: Column | None = None) -> Column:
    """Why extracted text is unusable: 'empty', 'too_short', 'sparse_pages'; null if it is usable."""

    def of(n: Column) -> Column:
        reason = F.when(n == 0, "empty").when(n < 40, "too_short")
        return reason if pages is None else reason.when((pages > 1) & (n / pages < 8), "sparse_pages")

    return let(nonws_len(c), of)


def letters_of(c: Column | str, letters: str) -> Column:
    return F.regexp_count(_col(c), F.lit(f"[{letters}]"))


def language_signal(c: Column | str, fallback: str = "en") -> Column:
    """'cs' or 'sk' where at least two accented letters speak for it (one Czech-only letter decides); else the fallback.

    It counts letters only, so it is a signal and no identification of the language.
    """
    both = letters_of(c, CZECH_ONLY + SLOVAK)
    # All of them lie in one range of code points, which is quick to look for and often absent.
    signal = F.when(~_col(c).rlike(r"[\x{C0}-\x{17F}]") | (both < 2), fallback).when(_col(c).rlike(f"[{CZECH_ONLY}]"), "cs").otherwise("sk")
    return F.coalesce(signal, F.lit(fallback))


def is_generic(c: Column | str) -> Column:
    """More than 40 characters without a digit, a percent sign or a strong verb."""
    c = _col(c)
    verbs = "|".join(STRONG_VERBS)
    return (nonws_len(c) > 40) & ~c.rlike(r"(?U)\d|%") & ~c.rlike(rf"(?iU)\b({verbs})\b")


def strip_fence(c: Column | str) -> Column:
    """What a code fence holds; the trimmed text without one."""
    c = trim_ws(_col(c))
    inner = F.regexp_extract(c, "(?s)^```[^\n]*\n(.*?)(?:```\\s*)?$", 1)
    return F.when(c.rlike("^```"), trim_ws(inner)).otherwise(c)


def strip_bullet(c: Column) -> Column:
    """A bullet, with or without a space, or a number with dot or bracket goes."""
    return trim_ws(F.regexp_replace(trim_ws(c), r"^(?:[-*•]|\d+[.)])", ""))


def rationale(c: Column) -> Column:
    """struct<advice, rationale>, parted by the first spaced em dash, else by the first spaced hyphen."""
    em, hyphen = F.instr(c, F.lit(" — ")), F.instr(c, F.lit(" - "))
    at = F.when(em > 0, em).otherwise(hyphen)
    advice = F.when(at > 0, trim_ws(F.substring(c, F.lit(1), at - 1))).otherwise(trim_ws(c))
    reason = F.when(at > 0, blank_to_null(F.substring(c, at + 3, F.length(c))))
    return F.struct(advice.alias("advice"), reason.alias("rationale"))


def escape_html(c: Column | str) -> Column:
    c = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_markdown(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("|"), F.lit("\\|"))


def escape_latex(c: Column | str) -> Column:
    """In order, so the braces of an escaped backslash are escaped again."""
    c = F.replace(_col(c), F.lit("\\"), F.lit("\\textbackslash{}"))
    for a in "&%$#_{}":
        c = F.replace(c, F.lit(a), F.lit("\\" + a))
    return c


def escape_csv(c: Column | str, delimiter: str) -> Column:
    """Quoted when the value holds a quote, a line feed or the delimiter."""
    c = F.coalesce(_col(c), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.contains('"') | c.contains("\n") | c.contains(delimiter), quoted).otherwise(c)


def wrap_plain(c: Column | str, width: int = 100) -> Column:
    """Lines hard-wrapped at a width."""
    return F.regexp_replace(_col(c), f"([^\n]{{{width}}})(?=[^\n])", "$1\n")


def file_part(c: Column | str) -> Column:
    """A name's part of a file name: white space and forbidden characters become underscores, outer ones go."""
    c = F.regexp_replace(trim_ws(F.coalesce(_col(c), F.lit(""))), r'(?U)[\s<>:"/\\|?*\x00-\x1F]', "_")
    return F.btrim(c, F.lit("_."))


def suggested_file(first: Column | str, last: Column | str, extension: str, default: str = "CV") -> Column:
    name = F.concat_ws("_", F.nullif(file_part(first), F.lit("")), F.nullif(file_part(last), F.lit("")))
    return F.concat(F.when(name == "", F.lit(default)).otherwise(name), F.lit(extension))


def initials(first: Column | str, last: Column | str) -> Column:
    """First character of each name, upper case; by code point."""
    part = [F.upper(F.left(trim_ws(F.coalesce(_col(c), F.lit(""))), F.lit(1))) for c in (first, last)]
    return F.concat(*part)


def latex_to_text(c: Column | str) -> Column:
    """LaTeX source as text: comments, sections, font commands (nested to five levels), items and specials."""
    c = F.regexp_replace(_col(c), r"(?m)(?<!\\)%.*$", "")
    c = F.regexp_replace(c, r"\\(?:sub)*section\*?\{([^{}]*)\}", "\n$1\n")
    for _ in range(5):
        c = F.regexp_replace(c, r"\\(?:textbf|textit|emph|underline)\{([^{}]*)\}", "$1")
    c = F.regexp_replace(c, r"\\item\b\s*", "• ")
    c = F.regexp_replace(c, r"\\(?:begin|end)\{[^{}]*\}", "")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", "")
    return F.regexp_replace(c, r"[{}\\]", "")


def printable_spans(c: Column | str, least: int = 25) -> Column:
    """Runs of at least ``least`` printable Latin characters of a binary dump, distinct, by blank lines."""
    runs = F.regexp_extract_all(_col(c), F.lit(rf"([\x20-\x7E\x{{A0}}-\x{{17F}}\t\r\n]{{{least},}})"), F.lit(1))
    runs = F.filter(F.transform(runs, collapse_spaces), lambda x: F.length(x) >= least)
    return F.array_join(F.array_distinct(runs), "\n\n")


def collapse_repeats(parts: Column) -> Column:
    """Parts that equal the part before them go."""
    return F.filter(parts, lambda x, i: (i == 0) | (x != F.get(parts, F.greatest(i - 1, F.lit(0)))))


def digit_runs(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(\d+)"), F.lit(1)))


def content_hash(*cs: Column | str) -> Column:
    """SHA-256 of the parts, upper-case hex; parts are joined by a unit separator, null counts as empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(_col(c).cast("string"), F.lit("")) for c in cs))
    return F.upper(F.sha2(joined, 256))


def locale_of(culture: Column | str, supported: tuple[str, ...], default: str = "en") -> Column:
    """Supported language of a culture name: itself, Chinese by script, its parent, the default; case does not matter."""
    c = F.lower(trim_ws(_col(culture)))
    parent = F.split_part(c, F.lit("-"), F.lit(1))
    named = {s.lower(): s for s in supported}
    table = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    chinese = F.when((parent == "zh") & c.rlike("hant|tw|hk|mo"), F.element_at(table, F.lit("zh-hant"))).when(parent == "zh", F.coalesce(F.element_at(table, F.lit("zh-hans")), F.element_at(table, F.lit("zh"))))
    return F.coalesce(F.element_at(table, c), chinese, F.element_at(table, parent), F.lit(default))


def ocr_languages(culture: Column | str, installed: tuple[str, ...] = ("eng", "slk", "ces")) -> Column:
    """Language packs of a culture, joined by a plus: its own where installed, and English."""
    parent = F.split_part(F.lower(_col(culture)), F.lit("-"), F.lit(1))
    own = F.when(parent == "sk", "slk").when(parent == "cs", "ces")
    return F.concat_ws("+", F.lit("eng"), F.when(own.isin(*installed), own))


def model_json(raw: Column | str) -> Column:
    """struct<json, retry> of a model's answer: the object inside a code fence; retry where there is none."""
    t = strip_fence(_col(raw))
    body = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    good = F.json_object_keys(body).isNotNull()
    return F.struct(F.when(good, body).alias("json"), F.coalesce(~good, F.lit(True)).alias("retry"))
