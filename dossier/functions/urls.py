"""URLs: normal form for comparison, labels, validity, routing of profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_text, trim_ws

URL = r"(?i)https?://[^\s<>()]+"
SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def normal_url(c: Column | str) -> Column:
    """Scheme (https if there is none) and host in lower case, no www., port, fragment or closing slash; query kept."""
    c = F.col(c) if isinstance(c, str) else c
    t = trim_ws(c)
    t = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.regexp_replace(F.lower(F.regexp_extract(t, SHAPE, 2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(t, SHAPE, 3), "/+$", "")
    query = F.regexp_extract(t, SHAPE, 4)
    query = F.when(query == "?", "").otherwise(query)
    parsed = F.concat(F.lower(F.regexp_extract(t, SHAPE, 1)), F.lit("://"), host, path, query)
    value = F.when(t.rlike(SHAPE), parsed).otherwise(F.lower(F.regexp_replace(t, "/+$", "")))
    return F.when(has_text(c), value).otherwise("")


def same_url(a: Column, b: Column) -> Column:
    x, y = normal_url(a), normal_url(b)
    return (x != "") & (x == y)


def first_url(c: Column) -> Column:
    found = F.regexp_extract(c, f"({URL.removeprefix('(?i)')})".join(("(?i)", "")), 1)
    return F.when(found != "", found).otherwise(trim_ws(c))


def url_label(c: Column) -> Column:
    """Name of a link: three known sites, else the first part of its host with a capital."""
    host = F.regexp_replace(F.lower(F.regexp_extract(c, SHAPE, 2)), r"^www\.", "")
    part = F.split_part(host, F.lit("."), F.lit(1))
    known = F.when(host.contains("linkedin"), "LinkedIn").when(host.contains("github"), "GitHub").when(host.contains("gitlab"), "GitLab")
    return F.coalesce(known, F.concat(F.upper(F.left(part, F.lit(1))), F.substring(part, 2, 1_000_000)))


def url_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#\s]*[^/?#\s.]\.[^/?#\s]+"), F.lit(False))


def profile_slot(c: Column) -> Column:
    return F.when(F.lower(c).contains("linkedin.com"), "linkedin_url").when(F.lower(c).contains("github.com"), "github_url").otherwise("portfolio_url")


def path_unsafe(c: Column) -> Column:
    """True for paths with a parent step."""
    return c.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def unique_links(links: Column) -> Column:
    """Links without blanks and script links, the first of each kept, ignoring case, in order."""
    good = F.filter(links, lambda x: has_text(x) & ~F.lower(trim_ws(x)).startswith("javascript:"))
    keys = F.transform(good, F.lower)
    return F.filter(good, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
