"""CV rows as text columns in each format; ``dossier.sources.files`` writes them, a file a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import iso, range_label
from dossier.functions.text import blank_to_null, escape_csv, escape_html, escape_latex, escape_markdown, wrap_plain
from dossier.sources.formats import OWN_KEY

# Headers of the tabular format and their fields.
CSV_FIELDS = {"firstName": "first_name", "lastName": "last_name", "email": "email", "phone": "phone", "location": "location", "professionalTitle": "title", "summary": "summary"}
FORMATS = ("own_json", "json_resume", "yaml", "europass_xml", "hr_xml", "csv", "tsv", "txt", "md", "html", "latex")


def own_json(cv: Column, version: int = 1) -> Column:
    """The engine's JSON: the version, then the struct's fields; nulls are left out."""
    body = F.to_json(cv)
    return F.concat(F.lit(f'{{"{OWN_KEY}":{version}'), F.when(body == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(body, 2, 2_000_000_000))))


def _some(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _person() -> Column:
    return F.concat_ws(" ", blank_to_null("personal.first_name"), blank_to_null("personal.last_name"))


def json_resume() -> Column:
    """JSON Resume of a CV row; empty sections are left out. Jobs name their company as ``name``."""
    p = lambda f: blank_to_null(f"personal.{f}")
    work = F.transform("work", lambda w: F.struct(blank_to_null(w["company"]).alias("name"), blank_to_null(w["job_title"]).alias("position"), iso(w["start_month"], w["start_year"]).alias("startDate"), F.when(~w["is_current"], iso(w["end_month"], w["end_year"])).alias("endDate"), blank_to_null(w["description"]).alias("summary")))
    education = F.transform("education", lambda e: F.struct(blank_to_null(e["institution"]).alias("institution"), blank_to_null(e["degree"]).alias("studyType"), blank_to_null(e["field_of_study"]).alias("area"), iso(e["start_month"], e["start_year"]).alias("startDate"), iso(e["end_month"], e["end_year"]).alias("endDate")))
    skills = F.transform("skills", lambda s: F.struct(s["category"].alias("name"), s["names"].alias("keywords")))
    spoken = F.transform("languages", lambda x: F.struct(x["language"].alias("language"), x["proficiency"].alias("fluency")))
    basics = F.struct(F.nullif(_person(), F.lit("")).alias("name"), p("title").alias("label"), p("email").alias("email"), p("phone").alias("phone"), p("portfolio_url").alias("url"), p("summary").alias("summary"))
    return F.to_json(F.struct(basics.alias("basics"), _some(work).alias("work"), _some(education).alias("education"), _some(skills).alias("skills"), _some(spoken).alias("languages")))


def _quoted(c: Column) -> Column:
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def yaml() -> Column:
    """YAML with every scalar in double quotes."""
    basics = F.concat(*(F.concat(F.lit(f"  {name}: "), _quoted(c), F.lit("\n")) for name, c in (("name", _person()), ("label", F.col("personal.title")), ("email", F.col("personal.email")), ("summary", F.col("personal.summary")))))
    work = F.array_join(F.transform("work", lambda w: F.concat(F.lit("- name: "), _quoted(w["company"]), F.lit("\n  position: "), _quoted(w["job_title"]), F.lit("\n"))), "")
    skills = F.array_join(F.transform("skills", lambda s: F.concat(F.lit("- name: "), _quoted(s["category"]), F.lit("\n  keywords: ["), F.array_join(F.transform(s["names"], _quoted), ", "), F.lit("]\n"))), "")
    return F.concat(F.lit("basics:\n"), basics, F.when(work != "", F.concat(F.lit("work:\n"), work)).otherwise(""), F.when(skills != "", F.concat(F.lit("skills:\n"), skills)).otherwise(""))


def _tag(name: str, c: Column) -> Column:
    return F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"<{name}>"), escape_html(c), F.lit(f"</{name}>"))).otherwise("")


def xml(europass: bool) -> Column:
    """Minimal Europass or HR XML."""
    p = lambda n, f: _tag(n, F.col(f"personal.{f}"))
    span = lambda w: F.concat_ws(" ", w["start_year"].cast("string"), F.when(w["is_current"], "present").otherwise(w["end_year"].cast("string")))
    if europass:
        who = F.concat(p("FirstName", "first_name"), p("Surname", "last_name"), p("Email", "email"), p("Telephone", "phone"))
        work = F.transform("work", lambda w: F.concat(F.lit("<WorkExperience>"), _tag("Period", span(w)), _tag("Position", w["job_title"]), F.lit("<Employer>"), _tag("Name", w["company"]), F.lit("</Employer>"), _tag("Activities", w["description"]), F.lit("</WorkExperience>")))
        return F.concat(F.lit("<SkillsPassport><Identification>"), who, F.lit("</Identification>"), F.array_join(work, ""), F.lit("</SkillsPassport>"))
    who = F.concat(p("GivenName", "first_name"), p("FamilyName", "last_name"), p("InternetEmailAddress", "email"), p("FormattedNumber", "phone"))
    work = F.transform("work", lambda w: F.concat(F.lit("<PositionHistory>"), _tag("Title", w["job_title"]), _tag("OrganizationName", w["company"]), _tag("Dates", span(w)), _tag("Description", w["description"]), F.lit("</PositionHistory>")))
    return F.concat(F.lit("<Resume><PersonName>"), who, F.lit("</PersonName>"), F.array_join(work, ""), F.lit("</Resume>"))


def csv(delimiter: str = ",") -> Column:
    """A header and one row of the personal fields."""
    row = F.concat_ws(delimiter, *(escape_csv(f"personal.{f}", delimiter) for f in CSV_FIELDS.values()))
    return F.concat(F.lit(delimiter.join(CSV_FIELDS) + "\n"), row, F.lit("\n"))


def _sections() -> list[tuple[str, Column]]:
    job = lambda w: F.concat_ws("\n", blank_to_null(w["job_title"]), F.concat_ws(" · ", blank_to_null(w["company"]), blank_to_null(w["location"]), range_label(w["start_month"], w["start_year"], w["end_month"], w["end_year"], w["is_current"])), blank_to_null(w["description"]))
    study = lambda e: F.concat_ws(" · ", blank_to_null(e["degree"]), blank_to_null(e["institution"]), range_label(e["start_month"], e["start_year"], e["end_month"], e["end_year"], e["is_current"]))
    lines = lambda c, f, sep="\n": F.array_join(F.transform(c, f), sep)
    return [
        ("Summary", F.col("personal.summary")),
        ("Work Experience", lines("work", job, "\n\n")),
        ("Education", lines("education", study)),
        ("Skills", lines("skills", lambda s: F.concat(s["category"], F.lit(": "), F.array_join(s["names"], ", ")))),
        ("Languages", lines("languages", lambda x: F.concat_ws(" · ", x["language"], x["proficiency"], x["cefr"]))),
        ("Certificates", lines("certificates", lambda c: F.concat_ws(" · ", c["name"], blank_to_null(c["issuer"])))),
        ("Projects", lines("projects", lambda p: F.concat_ws(" · ", p["name"], blank_to_null(p["role"])))),
        ("Links", lines("links", lambda x: F.concat_ws(": ", x["label"], x["url"]))),
        ("Additional Information", F.col("additional")),
    ]


def _visual(escape, title: str, heading: str, body: str, close: str = "") -> Column:
    """A document of the sections with content; the templates hold one %s each."""

    def put(template: str, c: Column) -> Column:
        before, after = template.split("%s")
        return F.concat(F.lit(before), escape(c), F.lit(after))

    parts = [F.when(blank_to_null(c).isNotNull(), F.concat(put(heading, F.lit(name)), put(body, c))).otherwise("") for name, c in _sections()]
    return F.concat(put(title, _person()), *parts, F.lit(close))


def export(cvs: DataFrame, key: str, formats: tuple[str, ...] = FORMATS, own: Column | None = None) -> DataFrame:
    """(key, format, content): each CV row in each text format, or only in its own, if that is one of them."""
    made = {
        "own_json": own_json(F.struct("personal", _some(F.col("work")).alias("work"), _some(F.col("education")).alias("education"), _some(F.col("skills")).alias("skills"), _some(F.col("languages")).alias("languages"))),
        "json_resume": json_resume(),
        "yaml": yaml(),
        "europass_xml": xml(True),
        "hr_xml": xml(False),
        "csv": csv(","),
        "tsv": csv("\t"),
        "txt": wrap_plain(_visual(lambda c: c, "%s\n\n", "%s\n", "%s\n\n")),
        "md": _visual(escape_markdown, "# %s\n\n", "## %s\n\n", "%s\n\n"),
        "html": _visual(escape_html, "<!DOCTYPE html><html><body><h1>%s</h1>", "<h2>%s</h2>", "<p>%s</p>", "</body></html>"),
        "latex": _visual(escape_latex, "\\documentclass{article}\\begin{document}\\section*{%s}\n", "\\subsection*{%s}\n", "%s\n\n", "\\end{document}"),
    }
    if own is not None:
        cases = F.coalesce(*(F.when(own == f, made[f]) for f in formats))
        return cvs.where(own.isin(*formats)).select(key, own.alias("format"), cases.alias("content"))
    rows = F.array(*(F.struct(F.lit(f).alias("format"), made[f].alias("content")) for f in formats))
    return cvs.select(key, F.explode(rows).alias("x")).select(key, "x.format", "x.content")
