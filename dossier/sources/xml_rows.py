"""XML CVs in Spark's own terms: tags and texts become rows, windows find each element's end, and fields are looked up by local name.

A document is cut into tags and texts by one pattern. A running sum over them is the depth; an element ends with the next tag on
its level. Tags that do not pair, a second root, text beside it, document types and characters that XML forbids make a document
unreadable, a value of its row. Names are looked up at any depth, in any case and without their prefixes. Keys may repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from dossier.functions.dates import years_in
from dossier.functions.text import has_text, let

#: Processing instructions and comments, and then a tag, marked or plain text; quoted values may hold anything.
SKIPPED = r"(?s)^\uFEFF|<\?.*?\?>|<!--.*?-->"
PIECE = r"""(?s)(<!\[CDATA\[.*?\]\]>|<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<)"""
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
#: References that stand for a character of XML.
REFERENCE = (
    r"&(?:lt|gt|amp|quot|apos|#0*(?:9|1[03]|3[2-9]|[4-9]\d|[1-9]\d{2,3}|[1-4]\d{4}|5[0-4]\d{3}|55[01]\d\d|552[0-8]\d|5529[0-5]|5734[4-9]|573[5-9]\d|57[4-9]\d\d|5[89]\d{3}|6[0-4]\d{3}|65[0-4]\d\d|655[0-2]\d|6553[0-3]"
    r"|6553[6-9]|655[4-9]\d|65[6-9]\d\d|6[6-9]\d{3}|[7-9]\d{4}|[1-9]\d{5})|#x0*(?:[9aAdD]|[2-9a-fA-F][0-9a-fA-F]|[1-9a-fA-F][0-9a-fA-F]{2}|[1-9a-cA-CeE][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}|[fF](?![fF]{2}[eEfF])[0-9a-fA-F]{3}|[1-9a-fA-F][0-9a-fA-F]{4}));"
)
# Sections that are kept as they are, and elements that name groups of skills.
MISC = ("OtherInfo", "AdditionalInformation", "CoverLetter", "Reference")
SKILL_HEADINGS = ("Skills", "Competencies", "Competences")

TAGS = ("open", "empty")


#: What ``paired`` gives: an array for each, as long as its input.
PAIRED = StructType([StructField(n, ArrayType(BooleanType() if n == "closed" else IntegerType())) for n in ("level", "end", "closed", "nth", "within")])


@F.pandas_udf(PAIRED)
def paired(steps: pd.Series) -> pd.DataFrame:
    """Of each document's pieces (1 opens, -1 closes, 2 is an empty element, 0 is text) the levels and ends of elements.

    The depth is a running sum; an element ends with the next tag on its level, and is closed if that one closes. ``nth``
    counts elements up to a piece, from 0, ``within`` those from it to its end. Without an end it is -1.
    """
    lengths = np.array([0 if s is None else len(s) for s in steps], dtype=np.int64)
    step = np.concatenate([np.asarray(s, dtype=np.int64) for s in steps if s is not None]) if lengths.sum() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    moves = np.where(np.abs(step) == 1, step, 0)
    total = np.concatenate([[0], np.cumsum(moves)])
    level = total[1:] - total[starts[doc]] + (step == -1)
    at = np.flatnonzero(moves)
    order = at[np.lexsort((at, level[at], doc[at]))]
    same = (doc[order[1:]] == doc[order[:-1]]) & (level[order[1:]] == level[order[:-1]])
    after = np.full(len(step), -1)
    after[order[:-1][same]] = order[1:][same]
    where = np.arange(len(step))
    end = np.where(step == 1, after, where)
    closed = (step != 1) | ((after >= 0) & (step[after] == -1))
    count = np.concatenate([[0], np.cumsum(step > 0)])
    nth = count[1:] - 1 - count[starts[doc]]
    within = np.where(end >= 0, count[end + 1] - count[where], 0)
    end = np.where(end >= 0, end - starts[doc], -1)
    cut = lambda a: [a[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]
    return pd.DataFrame({"level": cut(level.astype(np.int32)), "end": cut(end.astype(np.int32)), "closed": cut(closed), "nth": cut(nth.astype(np.int32)), "within": cut(within.astype(np.int32))})


def elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pieces, tags, readable): of each document its tags and texts (raw, text, name, kind, level, pos, end, …), in order, and the tags alone."""
    clean = F.regexp_replace(text, SKIPPED, "")
    refused = F.coalesce(F.lower(text).contains("<!doctype") | F.col(text).rlike(FORBIDDEN), F.lit(True))
    raws = F.coalesce(F.regexp_extract_all(clean, F.lit(PIECE), F.lit(1)), F.array().cast("array<string>"))

    def cut(raw: Column) -> Column:
        marked = raw.startswith("<![CDATA[") & raw.endswith("]]>")
        tag = raw.startswith("<") & raw.endswith(">") & ~raw.startswith("<!") & raw.rlike(r"^</?[^\s/>]")
        # Most pieces are no tags, so they are told by their first character.
        kind = F.when(~raw.startswith("<") | marked, "text").when(tag & raw.startswith("</"), "close").when(tag & raw.endswith("/>"), "empty").when(tag, "open").otherwise("broken")
        return F.struct(raw.alias("raw"), kind.alias("kind"), marked.alias("marked"), F.when(raw.startswith("<"), F.regexp_extract(raw, r"^</?([^\s/>]+)", 1)).otherwise("").alias("tag"))

    def step(c: Column) -> Column:
        return F.when(c["kind"] == "open", 1).when(c["kind"] == "close", -1).when(c["kind"] == "empty", 2).otherwise(0)

    # A generator works its input out once; a plain column would be made anew for every use.
    rows = docs.select(F.col(key).alias("key"), refused.alias("refused"), F.explode(F.array(F.transform(raws, cut))).alias("cut"))
    rows = rows.select("key", "refused", "cut", F.explode(F.array(F.transform("cut", step))).alias("steps")).withColumn("at", paired("steps"))

    def piece(c: Column, i: Column) -> Column:
        raw = c["raw"]
        of = lambda f: F.get(F.col(f"at.{f}"), i)
        said = (c["kind"] == "text") & ~c["marked"] & raw.contains("&")
        unsound = F.when(said, F.regexp_replace(raw, REFERENCE, "").contains("&")).otherwise(False)
        # Only texts with sound references go through a parser, each by itself.
        parsed = F.xpath_string(F.concat(F.lit("<a>"), raw, F.lit("</a>")), F.lit("/a"))
        plain = F.when(c["marked"], F.substring(raw, F.lit(10), F.length(raw) - 12)).when(said & ~unsound & ~F.col("refused"), parsed).when(c["kind"] == "text", raw)
        name = F.when(c["tag"] != "", F.lower(F.regexp_replace(c["tag"], "^[^:]*:", ""))).otherwise("")
        unpaired = (c["kind"] == "open") & ~(of("closed") & F.coalesce(F.get("cut", of("end"))["tag"] == c["tag"], F.lit(False)))
        outside = (c["kind"] == "text") & (of("level") == 0) & has_text(raw)
        bad = (c["kind"] == "broken") | (of("level") < 0) | unpaired | unsound | outside
        return F.struct(
            i.alias("pos"), raw.alias("raw"), plain.alias("text"), name.alias("name"), c["kind"].alias("kind"), of("level").alias("level"), of("end").alias("end"), of("nth").alias("nth"), of("within").alias("within"), bad.alias("bad")
        )

    rows = rows.select("key", "refused", "steps", F.explode(F.array(F.transform("cut", piece))).alias("pieces"))
    rows = rows.select("key", "refused", "steps", "pieces", F.explode(F.array(F.filter("pieces", lambda p: p["kind"].isin(*TAGS)))).alias("tags"))
    root = lambda p: ((p["kind"] == "open") & (p["level"] == 1)) | ((p["kind"] == "empty") & (p["level"] == 0))
    even = F.aggregate("steps", F.lit(0), lambda n, s: n + F.when(s < 2, s).otherwise(0)) == 0
    readable = ~F.col("refused") & (F.size("pieces") > 0) & ~F.exists("pieces", lambda p: p["bad"]) & even & (F.size(F.filter("tags", root)) == 1)
    return rows.select("key", "pieces", "tags", readable.alias("readable"))


class Tree:
    """Look-ups in a row's pieces; elements are pieces of kinds ``TAGS``, which look-ups by name read alone."""

    def __init__(self, pieces: Column, tags: Column | None = None) -> None:
        self.pieces = pieces
        self.tags = F.filter(pieces, lambda p: p["kind"].isin(*TAGS)) if tags is None else tags

    def part(self, e: Column) -> Column:
        """An element's pieces, its own tags included."""
        return F.slice(self.pieces, e["pos"] + 1, e["end"] - e["pos"] + 1)

    def below(self, e: Column) -> Column:
        """An element and all elements in it."""
        return F.slice(self.tags, e["nth"] + 1, e["within"])

    @staticmethod
    def named(tags: Column, *names: str) -> Column:
        low = [n.lower() for n in names]
        return F.filter(tags, lambda p: p["name"].isin(*low))

    def value(self, e: Column) -> Column:
        """All text of an element, white space as one space."""
        said = F.array_join(F.transform(F.filter(self.part(e), lambda p: p["kind"] == "text"), lambda p: p["text"]), "")
        return F.trim(F.regexp_replace(said, r"(?U)\s+", " "))

    def raw(self, e: Column) -> Column:
        return F.trim(F.regexp_replace(F.array_join(F.transform(self.part(e), lambda p: p["raw"]), ""), r"(?U)\s+", " "))

    def first(self, e: Column, *names: str) -> Column:
        return F.get(self.named(self.below(e), *names), F.lit(0))

    def text(self, e: Column, *names: str, listed: bool = True) -> Column:
        """The first text that is not blank of the elements of these names in an element, by the names' order or the document's; null without one."""
        low = F.array(*(F.lit(n.lower()) for n in names))
        order = lambda p: F.array_position(low, p["name"]).cast("int") if listed else F.lit(0)
        found = F.transform(self.named(self.below(e), *names), lambda p: F.struct(order(p).alias("order"), p["pos"].alias("pos"), self.value(p).alias("value")))
        return F.array_min(F.filter(found, lambda f: f["value"] != ""))["value"]

    def inside(self, e: Column, containers: tuple[str, ...], leaves: tuple[str, ...]) -> Column:
        """The text of a leaf in the first container that has one, else anywhere in the element."""
        tries = [let(self.first(e, c), lambda shell: F.when(shell.isNotNull(), self.text(shell, *leaves))) for c in containers]
        return F.coalesce(*tries, self.text(e, *leaves))


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _entry(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _spanned(raw: Column, after: int, before: int, **fields: Column) -> Column:
    """An entry with the years of a text, which are worked out once."""

    def dated(s: Column) -> Column:
        years = s["years"]
        return _entry(**fields, start_year=F.get(years, F.lit(0)), end_year=F.when(F.size(years) > 1, F.try_element_at(years, F.lit(-1))), is_current=s["now"])

    found = lambda r: F.struct(years_in(r, after, before).alias("years"), F.coalesce(F.lower(r).contains("present"), F.lit(False)).alias("now"))
    return let(let(raw, found), dated)


def _first_token(value: Column) -> Column:
    """What stands before the first bar or slash, null if nothing does."""
    parts = F.filter(F.split(value, r"[|/]"), lambda x: x != "")
    return F.when(value != "", F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"(?U)\s+", " ")))


def _once(names: Column) -> Column:
    """Names that are not blank, each once in any case, the first as it is written."""
    first = lambda named: lambda keys: F.filter(named, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)
    return let(F.filter(names, lambda n: F.coalesce(n != "", F.lit(False))), lambda named: let(F.transform(named, lambda n: F.lower(n)), first(named)))


def europass(t: Tree) -> dict[str, Column]:
    """Fields of a Europass document."""
    all_ = t.tags

    def job(e: Column) -> Column:
        span = let(t.first(e, "Period", "TimeInterval"), t.raw)
        return _spanned(
            span, 1950, 2150, job_title=_said(t.text(e, "Position", "Profession", "OccupationProfile", "Title")), company=_said(F.coalesce(t.inside(e, ("Employer", "EmployerContactInfo"), ("Name", "Organisation")), t.text(e, "EmployerName"))),
            location=_said(t.text(e, "Town", "Municipality", "City")), description=_said(t.text(e, "ActivitiesAndResponsibilities", "Activities", "Mission")), achievements=_said(t.text(e, "Achievement")), technologies=_said(t.text(e, "Sector")),
        )

    def study(e: Column) -> Column:
        return _spanned(
            let(t.first(e, "Period"), t.raw), 1950, 2150, institution=_said(t.inside(e, ("Organisation", "School"), ("Name",))), degree=_said(t.text(e, "EducationLevelEnum", "Level", "Title")), field_of_study=_said(t.text(e, "Field", "Subjects")), location=_said(t.text(e, "Country", "Town")),
            description=_said(t.text(e, "ActivitiesAndResponsibilities", "Activities")),
        )

    def certificate(e: Column) -> Column:
        name = F.coalesce(t.text(e, "Title", "AwardingBody", "Name"), _first_token(t.value(e)))
        return _entry(name=_said(name), issuer=_said(t.text(e, "OrganisationName", "Organisation", "Issuer")), description=_said(t.text(e, "Activities", "Location")), year=F.get(years_in(t.raw(e)), F.lit(0)))

    def skill(e: Column) -> Column:
        """A skill with the nearest element around it that names a group."""
        around = F.filter(t.named(all_, *SKILL_HEADINGS), lambda h: (h["pos"] < e["pos"]) & (h["end"] >= e["end"]))
        heading = F.regexp_extract(F.try_element_at(around, F.lit(-1))["raw"], r"^<(?:[^\s/>:]+:)?([^\s/>]+)", 1)
        return _entry(category=F.coalesce(heading, F.lit("General")), name=_said(F.coalesce(t.text(e, "Title", "Description", "Name"), _first_token(t.value(e)))))

    # Without a block for identification the whole document is one.
    blocks = let(t.named(all_, "Identification"), lambda b: F.when(F.size(b) > 0, b).otherwise(F.slice(all_, 1, 1)))
    of = lambda f: _said(F.get(F.filter(F.transform(blocks, f), lambda v: v.isNotNull()), F.lit(0)))
    scope = lambda b: F.coalesce(t.first(b, "PersonName"), b)
    goals = t.first(F.get(all_, F.lit(0)), "LearnerGoals", "Goals")

    def kept(name: str) -> Column:
        return F.transform(t.named(all_, name), lambda e: F.concat(F.lit(f"{name}: "), t.raw(e)))

    misc = F.flatten(F.array(*map(kept, MISC)))
    spoken = F.transform(t.named(all_, "ForeignLanguage", "MotherTongue"), lambda e: F.coalesce(t.text(e, "Description", "Name"), _first_token(t.value(e))))
    found = F.filter(F.transform(t.named(all_, "Skill"), skill), lambda s: s["name"] != "")
    group = lambda found: lambda g: _entry(category=g, names=F.transform(F.filter(found, lambda s: F.lower(s["category"]) == F.lower(g)), lambda s: s["name"]))
    grouped = let(found, lambda f: F.transform(_once(F.transform(f, lambda s: s["category"])), group(f)))
    return {
        "first_name": of(lambda b: t.text(scope(b), "FirstName", "GivenName")), "last_name": of(lambda b: t.text(scope(b), "Surname", "FamilyName")), "email": of(lambda b: t.text(b, "Email")),
        "phone": of(lambda b: t.text(b, "Telephone", "Mobile")), "location": of(lambda b: t.text(b, "Municipality", "City")), "title": of(lambda b: t.text(b, "Headline")), "summary": _said(F.when(goals.isNotNull(), t.value(goals))),
        "work": F.transform(t.named(all_, "WorkExperience", "WorkHistory"), job), "education": F.transform(t.named(all_, "Education"), study), "languages": _once(spoken),
        "certificates": F.filter(F.transform(t.named(all_, "Achievement", "Certificate", "Diploma"), certificate), lambda c: c["name"] != ""),
        "skills": grouped,
        "additional": F.array_join(misc, "\n\n"),
    }


def hr_xml(t: Tree) -> dict[str, Column]:
    """Fields of an HR-XML document."""
    all_ = t.tags
    root = F.get(all_, F.lit(0))
    of = lambda e, *names: _said(t.text(e, *names, listed=False))

    def job(e: Column) -> Column:
        return _spanned(
            t.raw(e), 1900, 2200, job_title=of(e, "PositionTitle", "Title"), company=of(e, "EmployerOrgName", "OrganizationName"), location=of(e, "PositionLocation", "Municipality", "PostalCode"), description=of(e, "Description", "PositionDescription"),
            achievements=F.lit(""), technologies=F.lit(""),
        )

    def study(e: Column) -> Column:
        return _spanned(
            t.raw(e), 1900, 2200, institution=of(e, "SchoolName"), degree=of(e, "DegreeName", "EducationDegree"), field_of_study=of(e, "DegreeMajor"), location=F.lit(""), description=of(e, "EducationDescription"),
        )

    languages = F.transform(t.named(all_, "Language", "MotherTongue"), lambda e: F.coalesce(t.text(e, "LanguageCode", "LanguageName", listed=False), t.value(e)))
    none = F.array().cast
    return {
        "first_name": of(root, "GivenName", "PreferredGivenName"), "last_name": of(root, "FamilyName", "PreferredFamilyName"), "email": of(root, "CommunicationAddress", "Email", "InternetEmailAddress"),
        "phone": of(root, "TelephoneFormattedNumber", "Mobile", "Telephone", "FormattedNumber"), "location": of(root, "PostalCode", "CountryCode"), "title": of(root, "Profession"), "summary": of(root, "ExecutiveSummary", "Objective"),
        "work": F.filter(F.transform(t.named(all_, "EmploymentHistoryItem", "EmploymentHistoriesItem", "PositionHistory", "EmploymentHistory"), job), lambda w: (w["job_title"] != "") | (w["company"] != "")),
        "education": F.transform(t.named(all_, "EducationHistoryItem", "SchoolOrInstitution"), study), "languages": _once(languages),
        "certificates": none("array<struct<name:string,issuer:string,description:string,year:int>>"), "skills": none("array<struct<category:string,names:array<string>>>"), "additional": F.lit(""),
    }


def xml_cv(docs: DataFrame, is_europass: bool, key: str = "cv_id", text: str = "text") -> DataFrame:
    """(key, first_name, …, additional, error) of Europass or HR XML texts; what is unreadable has an error and no fields."""
    found = elements(docs, key, text)
    fields = (europass if is_europass else hr_xml)(Tree(F.col("pieces"), F.col("tags")))
    filled = lambda e: F.exists(F.array(*(e[c] for c in ("location", "description"))), lambda x: x != "") | e["start_year"].isNotNull() | e["is_current"]
    fields["work"] = F.filter(fields["work"], lambda w: (w["job_title"] != "") | (w["company"] != "") | (w["achievements"] != "") | (w["technologies"] != "") | filled(w))
    fields["education"] = F.filter(fields["education"], lambda e: (e["institution"] != "") | (e["degree"] != "") | (e["field_of_study"] != "") | filled(e))
    out = found.select("key", "readable", *(F.when(F.col("readable"), c).alias(n) for n, c in fields.items()))
    texts = [F.col(c) != "" for c in ("first_name", "last_name", "email", "phone", "location", "title", "summary", "additional")]
    some = texts[0]
    for c in [*texts[1:], *(F.size(c) > 0 for c in ("work", "education", "languages", "certificates", "skills"))]:
        some |= c
    error = F.when(~F.col("readable"), "unreadable").when(~some, "no_structured_data")
    return out.select(F.col("key").alias(key), *fields, error.alias("error"))
