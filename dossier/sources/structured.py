"""Structured CVs to one nested record: JSON Resume, the engine's JSON, CSV and TSV, YAML, Europass and HR XML."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import year_month
from dossier.functions.text import blank_to_null, first_text, has_text
from dossier.functions.urls import profile_slot
from dossier.operators.linkage import split_names
from dossier.sources.formats import OWN_KEY

RESUME = """struct<
 basics: struct<name: string, label: string, email: string, phone: string, url: string, summary: string,
  location: struct<address: string, city: string, region: string, countryCode: string>,
  profiles: array<struct<network: string, username: string, url: string>>>,
 work: array<struct<name: string, company: string, position: string, location: string, url: string, startDate: string, endDate: string, summary: string, highlights: array<string>>>,
 education: array<struct<institution: string, url: string, area: string, studyType: string, startDate: string, endDate: string, score: string>>,
 skills: array<struct<name: string, level: string, keywords: array<string>>>,
 languages: array<struct<language: string, fluency: string>>,
 certificates: array<struct<name: string, date: string, issuer: string, url: string>>,
 projects: array<struct<name: string, description: string, startDate: string, endDate: string, url: string, entity: string, roles: array<string>, keywords: array<string>, highlights: array<string>>>>"""


def clean_json(text: Column) -> Column:
    """Comments and trailing commas outside of strings go, so that strict parsers read tolerant JSON."""
    strings = r'("(?:[^"\\]|\\.)*")'
    t = F.regexp_replace(text, strings + r"|/\*(?s:.*?)\*/|//[^\n]*", "$1")
    return F.regexp_replace(t, strings + r"|,(?=\s*[}\]])", "$1")


def _dates(start: Column, end: Column) -> list[Column]:
    s, e = year_month(start), year_month(end)
    now = F.coalesce(F.lower(end).contains("present"), F.lit(False))
    return [s["month"].alias("start_month"), s["year"].alias("start_year"), e["month"].alias("end_month"), e["year"].alias("end_year"), now.alias("is_current")]


def json_resume(docs: DataFrame, key: str = "cv_id", text: str = "text") -> DataFrame:
    """(key, personal, work, education, skills, languages, certificates, projects, error) of JSON Resume texts.

    'unreadable' for malformed text, 'no_structured_data' where no section has content. Both ``company`` and ``name``
    name a job's company.
    """
    t = clean_json(F.col(text))
    raw = F.from_json(t, RESUME)
    d = docs.select(key, raw.alias("r"), F.json_object_keys(t).isNull().alias("broken"))
    b = F.col("r.basics")
    profiles = F.coalesce(F.filter(F.transform(b["profiles"], lambda p: p["url"]), has_text), F.array().cast("array<string>"))
    slot = lambda s: F.get(F.filter(profiles, lambda u: profile_slot(u) == s), F.lit(0))
    names = split_names(F.coalesce(b["name"], F.lit("")))
    place = F.array_join(F.filter(F.array(*(b["location"][c] for c in ("city", "region", "countryCode"))), has_text), ", ")
    personal = F.struct(
        names["first_name"].alias("first_name"), names["last_name"].alias("last_name"), first_text(b["label"]).alias("title"), first_text(b["email"]).alias("email"),
        first_text(b["phone"]).alias("phone"), place.alias("location"), first_text(slot("linkedin_url")).alias("linkedin_url"), first_text(slot("github_url")).alias("github_url"),
        first_text(b["url"], slot("portfolio_url")).alias("portfolio_url"), first_text(b["summary"]).alias("summary"),
    )
    some = lambda c, f: F.coalesce(F.transform(F.col(f"r.{c}"), f), F.expr("array()"))
    work = F.transform("r.work", lambda w: F.struct(first_text(w["position"]).alias("job_title"), first_text(w["company"], w["name"]).alias("company"), first_text(w["location"]).alias("location"), *_dates(w["startDate"], w["endDate"]), first_text(w["summary"]).alias("description"), F.coalesce(F.array_join(w["highlights"], "\n"), F.lit("")).alias("achievements"), first_text(w["url"]).alias("url")))
    education = F.transform("r.education", lambda e: F.struct(first_text(e["institution"]).alias("institution"), first_text(e["studyType"]).alias("degree"), first_text(e["area"]).alias("field_of_study"), *_dates(e["startDate"], e["endDate"]), first_text(e["score"]).alias("grade"), first_text(e["url"]).alias("url")))
    skills = F.transform("r.skills", lambda s: F.struct(F.coalesce(blank_to_null(s["name"]), F.lit("General")).alias("category"), F.filter(F.coalesce(s["keywords"], F.array().cast("array<string>")), has_text).alias("names")))
    languages = F.transform("r.languages", lambda x: F.struct(first_text(x["language"]).alias("language"), first_text(x["fluency"]).alias("proficiency")))
    certificates = F.transform("r.certificates", lambda c: F.struct(first_text(c["name"]).alias("name"), first_text(c["issuer"]).alias("issuer"), year_month(c["date"]).alias("issued"), first_text(c["url"]).alias("url")))
    projects = F.transform("r.projects", lambda p: F.struct(first_text(p["name"]).alias("name"), first_text(F.get(p["roles"], F.lit(0))).alias("role"), first_text(p["entity"]).alias("organization"), *_dates(p["startDate"], p["endDate"]), first_text(p["url"]).alias("url"), F.coalesce(F.filter(p["keywords"], has_text), F.array().cast("array<string>")).alias("technologies"), F.coalesce(F.array_join(p["highlights"], "\n"), F.lit("")).alias("highlights"), first_text(p["description"]).alias("description")))
    out = d.select(key, "broken", personal.alias("personal"), work.alias("work"), education.alias("education"), skills.alias("skills"), languages.alias("languages"), certificates.alias("certificates"), projects.alias("projects"))
    content = F.greatest(*(F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("work", "education", "skills", "languages", "certificates", "projects")), *(has_text(f"personal.{f}") for f in ("first_name", "title", "email", "summary")))
    return out.withColumn("error", F.when(F.col("broken"), "unreadable").when(~content, "no_structured_data")).drop("broken")


def own_json(docs: DataFrame, schema: str, key: str = "cv_id", text: str = "text", newest: int = 2) -> DataFrame:
    """(key, cv, error) of the engine's own JSON; versions from 1 to ``newest`` are read."""
    version = F.get_json_object(text, f"$.{OWN_KEY}").try_cast("int")
    cv = F.from_json(F.col(text), schema)
    error = F.when(F.json_object_keys(text).isNull(), "unreadable").when(version.isNull() | ~version.between(1, newest), "unsupported_version")
    return docs.select(key, F.when(error.isNull(), cv).alias("cv"), error.alias("error"))


# Header names of tabular CVs and their fields.
HEADERS = {
    "firstname": "first_name", "given name": "first_name", "lastname": "last_name", "surname": "last_name", "family name": "last_name",
    "name": "full_name", "full name": "full_name", "candidate name": "full_name", "email": "email", "e mail": "email", "phone": "phone",
    "telephone": "phone", "mobile": "phone", "tel": "phone", "location": "location", "city": "location", "address": "location",
    "title": "title", "headline": "title", "professional title": "title", "summary": "summary", "objective": "summary", "bio": "summary",
}
TABULAR = ("first_name", "last_name", "email", "phone", "location", "title", "summary")


def clean_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tabular(docs: DataFrame, delimiter: str = ",", key: str = "cv_id", text: str = "text", strict: bool = False) -> DataFrame:
    """(key, first_name, …, summary, extra, warning, error): the header row and the first data row of each text.

    More rows are a warning, unknown headers go to ``extra``. Cells are split at every delimiter and stripped of one
    pair of quotes; ``strict`` reads quoted cells as RFC 4180 does.
    """
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    rows = F.filter(F.transform(F.split(t, "\n"), F.trim), lambda r: r != "")
    quoted = delimiter.replace("\t", r"\t")
    sep = rf'{quoted}(?=(?:[^"]*"[^"]*")*[^"]*$)' if strict else quoted
    cells = lambda r: F.transform(F.split(r, sep, -1), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1")))
    d = docs.select(key, F.size(rows).alias("n"), F.transform(cells(F.get(rows, F.lit(0))), clean_header).alias("h"), cells(F.get(rows, F.lit(1))).alias("v"))
    known = F.create_map(*(F.lit(x) for kv in HEADERS.items() for x in kv))
    pairs = F.filter(F.arrays_zip("h", "v"), lambda x: has_text(x["h"]) & has_text(x["v"]))
    pairs = F.transform(pairs, lambda x: F.struct(F.element_at(known, x["h"]).alias("f"), x["h"].alias("h"), F.regexp_replace(F.trim(x["v"]), r"\s+", " ").alias("v")))
    d = d.select(key, "n", pairs.alias("p"))
    first = lambda f: F.get(F.filter("p", lambda x: x["f"] == f), F.lit(0))["v"]
    full = split_names(F.coalesce(first("full_name"), F.lit("")))
    values = {f: first(f) for f in TABULAR}
    values["first_name"] = F.coalesce(values["first_name"], F.nullif(full["first_name"], F.lit("")))
    values["last_name"] = F.coalesce(values["last_name"], F.nullif(full["last_name"], F.lit("")))
    extra = F.array_join(F.transform(F.filter("p", lambda x: x["f"].isNull()), lambda x: F.concat(F.initcap(x["h"]), F.lit(": "), x["v"])), "\n")
    return d.select(
        key,
        *(F.coalesce(v, F.lit("")).alias(f) for f, v in values.items()),
        extra.alias("extra"),
        F.when(F.col("n") > 2, "extra_rows_ignored").alias("warning"),
        F.when(F.col("n") < 2, "no_structured_data").alias("error"),
    )


def yaml_to_json(docs: DataFrame, key: str = "cv_id", text: str = "text") -> DataFrame:
    """(key, flavour, json): YAML mappings as JSON with scalars typed; json is null where the text is no mapping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = yaml.safe_load(t or "")
                except yaml.YAMLError:
                    value = None
                if isinstance(value, dict):
                    keys = {str(x).lower() for x in value}
                    flavour = "OwnJson" if OWN_KEY.lower() in keys else "JsonResume" if keys & {"basics", "work", "education", "skills"} else "Unknown"
                    rows.append((k, flavour, json.dumps(value, ensure_ascii=False, default=str)))
                else:
                    rows.append((k, "Unknown", None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (batch.column(0).type, pa.string(), pa.string()), strict=True)], ["key", "flavour", "json"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, flavour string, json string").withColumnRenamed("key", key)
