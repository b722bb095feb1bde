"""Line predicates: what a line of a CV looks like."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import dates
from dossier.functions.text import has_text, lines_of, rtrim_ws, split_items, trim_ws
from dossier.functions.urls import URL

EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+|\(\+)?[0-9][0-9 \t().-]{7,}[0-9]"

# Cue words.
INSTITUTION = ("high school", "university", "college", "academy", "institute", "gymnaz", "gymnáz", "stredna skola", "stredná škola", "electrical engineering", " and training")
STANDALONE_INSTITUTION = ("university", "college", "institute", "academy")
DEGREE = ("bachelor", "master", "bsc", "msc", "phd", "doctor", "diploma", "ing.", "bc.")
DEGREE_TYPES = {
    "Doctorate": ("phd", "ph.d", "doctor"), "Master": ("master", "msc", "mba", "ing.", "mgr"), "Bachelor": ("bachelor", "bsc", "bc."), "Associate": ("associate ",),
    "HighSchool": ("high school", "gymn", "secondary"), "Certificate": ("certificate", "course"),
}
FIELDS_OF_STUDY = ("engineering", "training", "technology", "management", "sciences", "informatics")
PROSE = (
    " using ", " for ", " with ", " the ", " to ", " in ", " on ", " of ", " a ", " an ", " and delivering ", " and reviewed ", " and maintained ", " and collaborated ",
    " and iterated ", " and technical ", " and user ", " and backend ", " and frontend ", " and code ", " and security", " and auditability",
)
PROSE_WORDS = ("and", "with", "for", "the", "to", "in", "on", "of", "a", "an")
SUMMARY_PROSE = ("years of experience", "strong in", "experienced in")
CATEGORIES = (
    "general", "backend", "frontend", "programming", "devops", "languages", "languages & runtimes", "backend & apis", "data & storage", "cloud & devops",
    "observability", "security", "architecture", "leadership", "testing", "mobile & edge", "ai & automation",
)
NOT_CATEGORIES = ("designed", "implemented", "built", "contributed", "collaborated", "delivered", "integrated", "worked", "senior", "project", "platforms", "development", "oauth", "focus", "high", "uses")
SUBHEADINGS = ("technologies", "achievements", "company url", "institution url")
LANGUAGE_PARTS = ("reading", "writing", "speaking", "listening", "translation")
CONTACT_LABELS = ("email", "e-mail", "phone", "tel", "address", "location", "linkedin", "github", "portfolio", "web")
SKILL_STOP_WORDS = ("and", "or", "with", "for", "the", "as")
NO_SKILL_WORDS = (
    "and", "with", "for", "the", "to", "in", "on", "of", "as", "at", "by", "from", "into", "leading", "worked", "built", "uses", "delivered", "integrated", "designed", "implemented",
    "contributed", "collaborated", "developed", "experienced", "strong", "senior", "full", "stack", "developer", "project", "technologies", "contact", "email", "phone", "location",
)
WORK_BLEED = (" s.r.o.", " a.s.", "full-time", "part-time")


def _any(line: Column, cues: tuple[str, ...]) -> Column:
    low = F.lower(line)
    return reduce(or_, (low.contains(c) for c in cues))


def _one_of(cues: tuple[str, ...]) -> str:
    """A pattern for one of the words, as a word, in any case."""
    return rf"(?iU)\b({'|'.join(cues)})\b"


def words(line: Column) -> Column:
    """Number of words between spaces."""
    return F.size(F.filter(F.split(line, " "), lambda w: trim_ws(w) != ""))


def institution(line: Column) -> Column:
    return _any(line, INSTITUTION)


def degree(line: Column) -> Column:
    """Holds a degree cue; 'ing.' counts wherever it stands."""
    return _any(line, DEGREE)


def incomplete_institution(line: Column) -> Column:
    """A name cut off after 'of', or 'school of …' without a field that ends such names; no line that names an institution."""
    open_ = line.rlike(r"(?iU)\b(high school|school|university|college|academy)\s+of\s+[\p{L}\s]+$") & ~line.rlike(_one_of(FIELDS_OF_STUDY))
    return has_text(line) & ~institution(line) & (F.lower(line).endswith(" of") | open_)


def single_institution(head: Column) -> Column:
    """Whether the lines of an education header name one institution and no degree beside it."""
    n, first, last = F.size(head), F.get(head, F.lit(0)), F.try_element_at(head, F.lit(-1))
    joined = F.exists(head, lambda x: F.lower(x).startswith("and "))
    apart = (n >= 2) & degree(first) & (((n >= 3) & institution(last)) | ((n == 2) & _any(last, STANDALONE_INSTITUTION)))
    named = institution(F.array_join(head, " ")) | ((n >= 2) & incomplete_institution(first))
    return F.coalesce(F.when(n == 0, False).otherwise(joined | (~apart & named)), F.lit(False))


def education_description(line: Column) -> Column:
    """Too long for a header: over 80 characters, or over 12 words that name no institution."""
    return F.coalesce(has_text(line) & ((F.length(line) > 80) | ((words(line) > 12) & ~institution(line))), F.lit(False))


def garbage_education(institution_name: Column, degree_name: Column) -> Column:
    """Fragments of a broken header: a degree that carries on a sentence, or a lone field for an institution."""
    name, what = F.lower(F.coalesce(institution_name, F.lit(""))), F.lower(F.coalesce(degree_name, F.lit("")))
    return what.startswith("and ") | ((name == "engineering") & ~what.contains("school"))


def city_country(city: Column, country: Column) -> Column:
    shape = r"^\p{L}[^0-9.#]*$"
    return city.rlike(shape) & country.rlike(shape)


def location(line: Column) -> Column:
    """'City, Country': two parts without digits and dots, no job header, date, bullet or list of technologies."""
    parts = split_items(line, ",")
    other = work_header(line) | dates.parse_range(line).isNotNull() | line.startswith("- ") | F.lower(line).startswith("technologies:")
    return F.coalesce(line.contains(",") & (F.size(parts) == 2) & ~other & city_country(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), F.lit(False))


def prose(line: Column) -> Column:
    """Signs against a list of technologies: too long, a sentence's dot, a small first letter, prose words, long parts."""
    parts = split_items(line, ",")
    dot = line.contains(".") & ~F.lower(line).contains(".net")
    said = _any(F.concat(F.lit(" "), line, F.lit(" ")), PROSE)
    return (F.length(line) > 72) | dot | line.rlike(r"^\p{Ll}") | said | F.exists(parts, lambda p: (words(p) > 4) | p.rlike(_one_of(PROSE_WORDS)))


def technology_list(line: Column) -> Column:
    """A comma list of at least two short parts that is no prose and no place."""
    parts = split_items(line, ",")
    place = (F.size(parts) == 2) & city_country(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    return F.coalesce(line.contains(",") & (F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(p).between(1, 40)) & ~prose(line) & ~place, F.lit(False))


def education_anchor(block: Column) -> Column:
    """Whether a block already holds what an entry is known by: a date or an institution, whole or cut off."""
    return F.exists(lines_of(block), lambda x: dates.parse_range(x).isNotNull() | institution(x) | incomplete_institution(x))


def education_continuation(block: Column, previous: Column) -> Column:
    """Whether a block belongs to the one before.

    It does if it opens with 'and', if the block before ends in a cut-off name, or if all of its lines are short and none
    is a date, a place or a degree while the block before is an entry. A block that opens with a date or degree does not.
    """
    own = lines_of(block)
    first, last = F.get(own, F.lit(0)), F.try_element_at(lines_of(previous), F.lit(-1))
    opens = dates.parse_range(first).isNotNull() | degree(first)
    plain = F.forall(own, lambda x: (F.length(x) < 80) & dates.parse_range(x).isNull() & ~location(x) & ~degree(x))
    joins = F.lower(first).startswith("and ") | F.coalesce(incomplete_institution(last), F.lit(False)) | (plain & education_anchor(previous))
    return F.coalesce((F.size(own) > 0) & ~opens & joins, F.lit(False))


def sidebar_token(line: Column) -> Column:
    return line.rlike("^[^ .,:]{1,30}$")


def sidebar_line(line: Column, tokens: Column) -> Column:
    """A known skill, or a short line that could be one."""
    known = F.array_contains(F.transform(tokens, F.lower), F.lower(trim_ws(line)))
    short = (F.length(line) <= 40) & (words(line) <= 4) & ~line.contains(".") & ~work_header(line) & dates.parse_range(line).isNull()
    return known | (short & sidebar_token(trim_ws(line)))


def work_header(line: Column) -> Column:
    low = F.lower(line)
    return line.contains(" - ") | low.contains(" at ") | low.contains(" s.r.o.") | low.contains(" a.s.")


def summary_prose(head: Column) -> Column:
    """A header that is running text: a long first line, or words of a summary anywhere in it."""
    return F.coalesce((F.length(F.get(head, F.lit(0))) > 60) | _any(F.array_join(head, " "), SUMMARY_PROSE), F.lit(False))


def employment(line: Column) -> Column:
    """Names a company's form or a kind of employment."""
    return _any(line, WORK_BLEED)


def is_dated(line: Column) -> Column:
    return dates.parse_range(line).isNotNull()


# Rules that ask for a date take the answer as ``dated`` where the caller has it, as the pattern is the largest of all.


def work_bleed(line: Column, dated: Column | None = None) -> Column:
    """A line of a job that has run into another section: a company's form, a kind of employment, a date."""
    return employment(line) | (is_dated(line) if dated is None else dated)


def subheading(line: Column) -> Column:
    """A heading inside of an export's entry."""
    return F.lower(F.rtrim(trim_ws(line), F.lit(":"))).isin(*SUBHEADINGS)


def skill_preview(line: Column, dated: Column | None = None) -> Column:
    """The skill of an export's line 'name · level · years', null for other lines: two or three parts, no date, no job."""
    parts = split_items(line, "·")
    tail = F.array_join(F.slice(parts, 2, 2), " · ")
    name = F.get(parts, F.lit(0))
    shape = line.contains("·") & ~work_bleed(line, dated) & F.size(parts).between(2, 3) & plausible_skill(name)
    return F.when(shape & dates.parse_range(tail).isNull(), name)


def known_category(label: Column) -> Column:
    return F.lower(trim_ws(label)).isin(*CATEGORIES)


def plausible_category(label: Column, dated: Column | None = None) -> Column:
    """A known category, or one word of 2 to 40 characters that is no skill, date, sub-heading, job or start of a sentence."""
    t = trim_ws(label)
    dated = is_dated(t) if dated is None else dated
    other = t.contains(" ") | t.contains("·") | t.contains(",") | work_bleed(t, dated) | F.lower(F.regexp_replace(t, ":+$", "")).isin(*SUBHEADINGS)
    said = t.rlike(rf"(?iU)^({'|'.join(NOT_CATEGORIES)})\b")
    return F.length(t).between(2, 40) & (known_category(t) | (~other & ~said & ~standalone_skill(t, dated)))


def plausible_skill(value: Column, dated: Column | None = None) -> Column:
    """Two to 48 characters in four words at most, no contact data, date, word of a sentence or pair of names."""
    t = trim_ws(value)
    n = words(t)
    contact = t.rlike(EMAIL) | t.rlike(URL) | t.rlike(PHONE)
    pair = (n == 2) & t.rlike(r"^\p{Lu}\S*\s+\p{Lu}") & ~t.rlike("[.#+]")
    stop = (n == 1) & F.lower(t).isin(*SKILL_STOP_WORDS)
    return F.length(t).between(2, 48) & (n <= 4) & ~contact & ~(is_dated(t) if dated is None else dated) & ~stop & ~pair & ~t.rlike(_one_of(NO_SKILL_WORDS))


def standalone_skill(line: Column, dated: Column | None = None) -> Column:
    t = trim_ws(line)
    return plausible_skill(t, dated) & (t.rlike(r"[.#+/]") | ((F.length(t) <= 16) & ~t.contains(" ")))


def language_part(line: Column) -> Column:
    """A line of a language's parts, such as 'Reading: C1'."""
    return F.lower(F.regexp_extract(line, r"^\s*([A-Za-z]+)\s*:", 1)).isin(*LANGUAGE_PARTS)


def contact_label(label: Column) -> Column:
    return _any(label, CONTACT_LABELS)


def partial_url(line: Column) -> Column:
    """A URL that seems to go on in the next line: a site's name without a whole URL, or one that ends in a hyphen."""
    return line.rlike(r"(?i)https?://|www\.|linkedin\.com|github\.com") & (~line.rlike(URL) | rtrim_ws(line).endswith("-"))


def degree_type(text: Column) -> Column:
    """The first type of which a text holds a cue, else 'Other'."""
    low, out = F.lower(text), F.lit("Other")
    for kind, words_ in reversed(DEGREE_TYPES.items()):
        out = F.when(reduce(or_, (low.contains(w) for w in words_)), kind).otherwise(out)
    return out
