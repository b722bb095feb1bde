"""What is shown or handed on of entries: projections with labels, previews, descriptions for prompts, gates and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import range_label
from dossier.functions.text import blank_to_null, has_text, nonws_len, or_dash, trim_ws
from dossier.sources.writers import own_json

#: A summary is advised on from so many characters that are no white space.
LEAST_SUMMARY = 30
ADVISED = ("Summary", "WorkExperience", "Education", "Skills", "Languages", "Projects")
# Longest answer by task, and the task that answers a hint.
TASK_LIMITS = {"ImproveProfessionalSummary": 800, "DraftProfessionalSummary": 800, "ShortenProfessionalSummary": 600, "ImproveWorkDescription": 2000, "DraftWorkDescription": 2000, "ImproveProjectDescription": 2000}
HINT_TASKS = {
    "work.generic-description": "ImproveWorkDescription", "work.entry-missing-description": "DraftWorkDescription", "personal.summary-too-short": "ImproveProfessionalSummary",
    "personal.summary-missing": "DraftProfessionalSummary", "projects.entry-missing-description": "ImproveProjectDescription", "personal.summary-too-long": "ShortenProfessionalSummary",
    "skills.single-large-group": "SuggestSkillGrouping", "skills.section-empty": "DraftSkillsFromContext", "education.section-empty": "AdviseEducationSection", "languages.section-empty": "AdviseLanguagesSection",
}
ACTIVE_STATES = ("Downloading", "Paused", "Interrupted", "Failed", "Completed")


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def work_view(e: Column, labels: dict[str, str], present: str = "Present") -> Column:
    """A job as shown: a hyphen for a blank title or company, the kind's label, the dates as one text."""
    return F.struct(
        or_dash(e["job_title"]).alias("job_title"), or_dash(e["company"]).alias("company"), F.coalesce(blank_to_null(e["location"]), F.lit("")).alias("location"),
        F.coalesce(_lookup(labels, e["employment_type"]), e["employment_type"]).alias("employment_type"),
        range_label(e["start_month"], e["start_year"], e["end_month"], e["end_year"], e["is_current"], present).alias("dates"),
        e["description"].alias("description"), e["achievements"].alias("achievements"), e["technologies"].alias("technologies"), e["company_url"].alias("company_url"),
    )


def group_view(g: Column, labels: dict[str, str]) -> Column:
    """A skill group as shown: its named skills, trimmed, with the labels of their levels."""
    named = F.filter(g["skills"], lambda s: has_text(s["name"]))
    skills = F.transform(named, lambda s: F.struct(trim_ws(s["name"]).alias("name"), F.coalesce(_lookup(labels, s["proficiency"]), s["proficiency"]).alias("level"), s["years"].alias("years")))
    return F.struct(or_dash(g["category"]).alias("category"), skills.alias("skills"))


def work_preview(views: Column) -> Column:
    """Jobs as shown, below each other: title, company with place and dates, and the texts that are there, by blank lines."""

    def block(w: Column) -> Column:
        meta = F.concat_ws(" · ", w["company"], blank_to_null(w["location"]), w["employment_type"], w["dates"])
        some = lambda c, label: F.when(has_text(c), F.concat(F.lit(label), c))
        return F.concat_ws("\n", w["job_title"], meta, some(w["description"], ""), some(w["achievements"], "Achievements:\n"), some(w["technologies"], "Technologies: "), some(w["company_url"], "Company URL: "))

    return F.array_join(F.transform(views, block), "\n\n")


def describe_work(jobs: Column) -> Column:
    """Jobs as plain lines for a prompt: title and company, then their texts; blank ones are left out."""
    line = lambda w: F.concat_ws("\n", F.nullif(F.concat_ws(" — ", blank_to_null(w["job_title"]), blank_to_null(w["company"])), F.lit("")), blank_to_null(w["description"]), blank_to_null(w["achievements"]))
    return F.array_join(F.filter(F.transform(jobs, line), lambda x: x != ""), "\n")


def describe_skills(groups: Column) -> Column:
    line = lambda g: F.concat_ws(": ", blank_to_null(g["category"]), F.nullif(F.array_join(F.filter(F.transform(g["skills"], lambda s: s["name"]), has_text), ", "), F.lit("")))
    return F.array_join(F.filter(F.transform(groups, line), lambda x: x != ""), "\n")


def describe_sections(cv: Column) -> Column:
    """map of section to its text for a prompt, in the order of ``ADVISED``: label-free lines, blank ones left out.

    ``cv`` has summary and the arrays work, education, skills, languages and projects.
    """
    named = lambda *cs: F.nullif(F.concat_ws(" — ", *map(blank_to_null, cs)), F.lit(""))
    lines = lambda rows, f: F.array_join(F.flatten(F.transform(rows, lambda r: F.array_compact(F.array(*f(r))))), "\n")
    texts = {
        "Summary": trim_ws(F.coalesce(cv["summary"], F.lit(""))),
        "WorkExperience": describe_work(cv["work"]),
        "Education": lines(cv["education"], lambda e: [named(e["degree"], e["field_of_study"], e["institution"])]),
        "Skills": describe_skills(cv["skills"]),
        "Languages": lines(cv["languages"], lambda x: [named(x["language"], x["proficiency"])]),
        "Projects": lines(cv["projects"], lambda p: [named(p["name"], p["role"]), blank_to_null(p["description"])]),
    }
    return F.create_map(*(x for s in ADVISED for x in (F.lit(s), F.coalesce(texts[s], F.lit("")))))


def section_measures(cv: Column) -> Column:
    """array<struct<section, text, entries, chars>> of the advised sections: texts, numbers of entries, characters but white space."""
    entries = {"Summary": F.when(has_text(cv["summary"]), 1).otherwise(0)} | {s: F.coalesce(F.size(cv[c]), F.lit(0)) for s, c in zip(ADVISED[1:], ("work", "education", "skills", "languages", "projects"), strict=True)}
    n = F.create_map(*(x for s, c in entries.items() for x in (F.lit(s), c)))
    return F.transform(F.map_entries(describe_sections(cv)), lambda e: F.struct(e["key"].alias("section"), e["value"].alias("text"), F.element_at(n, e["key"]).alias("entries"), nonws_len(e["value"]).alias("chars")))


def advisable(section: Column, entries: Column, content: Column) -> Column:
    """Whether advice is offered for a section: a summary by its length, others by having an entry with any content."""
    n = nonws_len(content)
    return section.isin(*ADVISED) & F.when(section == "Summary", n >= LEAST_SUMMARY).otherwise((entries >= 1) & (n > 0))


def answer_limit(task: Column) -> Column:
    return F.coalesce(_lookup(TASK_LIMITS, task), F.lit(2000))


def task_of_hint(hint_id: Column) -> Column:
    return _lookup(HINT_TASKS, hint_id)


def phase_of(status: Column, engine_keys: tuple[str, ...]) -> Column:
    """'engine' while a download has no status or one of the engine's, else 'model'."""
    return F.when(has_text(status) & ~status.isin(*engine_keys), "model").otherwise("engine")


def has_job(state: Column) -> Column:
    return state.isin(*ACTIVE_STATES)


def template_of(keywords: Column, known: tuple[str, ...], prefix: str = "template:") -> Column:
    """The first known template that a document's keywords name, null without one."""
    tokens = F.filter(F.split(F.coalesce(keywords, F.lit("")), "[,; ]+"), lambda t: F.lower(t).startswith(prefix))
    names = F.transform(tokens, lambda t: F.substring(t, len(prefix) + 1, 1000))
    return F.get(F.filter(names, lambda t: t.isin(*known)), F.lit(0))


def json_text(text: Column, name: str) -> Column:
    """A property of a JSON object if it is a string, else null."""
    given = F.try_variant_get(F.try_parse_json(text), f"$.{name}", "string")
    return F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")) == "STRING", given)


def project_json(cv: Column, settings: Column, saved_at: Column, version: int = 1) -> Column:
    """A project file: the engine's JSON with the settings and the time of saving."""
    body = own_json(cv, version)
    extra = F.to_json(F.struct(F.struct(settings.alias("settings"), F.date_format(saved_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("savedAt")).alias("projectSettings")))
    return F.concat(F.left(body, F.length(body) - 1), F.lit(","), F.substring(extra, 2, 2_000_000_000))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, …): rows of one table that the other lacks, repeats counted; empty if both hold the same."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
