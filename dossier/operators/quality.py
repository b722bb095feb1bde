"""Quality rules: each is a filter over CV views; the report is their union without repeats and dismissed hints.

A CV is given as tables: personal (cv_id, first_name, last_name, title, email, phone, linkedin_url, github_url,
portfolio_url, summary, additional) and work, education, skill (gpos, spos, name), language, certificate, project and
link, each with cv_id and pos. Sections are counted once per CV and joined to personal, so no rule reads a table twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import has_text, is_generic, nonws_len
from dossier.operators.linkage import dismissed_key, first_by, links_matching

SECTIONS = ("work", "education", "skill", "language", "certificate", "project", "link")
COLUMNS = ("cv_id", "hint_id", "severity", "section", "field_key", "entry_id")
#: Field prefixes and their sections, for confidences.
PREFIXES = {
    "workExperience.": "WorkExperience", "education.": "Education", "skills.": "Skills", "languages.": "Languages",
    "certificates.": "Certificates", "projects.": "Projects", "links.": "Links", "additionalInformation": "AdditionalInformation",
}
PERSONAL_FIELDS = ("firstName", "lastName", "professionalTitle", "email", "phone", "location", "linkedInUrl", "portfolioUrl", "gitHubUrl", "shortSummary")


def section_of(field_key: Column) -> Column:
    """Section of a field by its prefix; personal fields by name; null for others."""
    out = F.when(field_key.isin(*PERSONAL_FIELDS), "PersonalInformation")
    for prefix, section in PREFIXES.items():
        out = out.when(field_key.startswith(prefix), section)
    return out


def snapshot(cv: dict[str, DataFrame]) -> DataFrame:
    """Personal rows with the number of entries of each section; rows in a table count as entries."""
    out = cv["personal"]
    for name in SECTIONS:
        keys = cv[name].select("cv_id", "gpos").distinct() if name == "skill" else cv[name]
        out = out.join(keys.groupBy("cv_id").agg(F.count("*").alias(f"n_{name}")), "cv_id", "left")
    return out.fillna(0, [f"n_{s}" for s in SECTIONS])


def started() -> Column:
    out = F.lit(False)
    for c in ("first_name", "last_name", "title", "email", "summary", "additional"):
        out |= has_text(c)
    for s in SECTIONS:
        out |= F.col(f"n_{s}") > 0
    return out


def other_data(exclude: str) -> Column:
    """Whether any section but one has content."""
    out = F.lit(False)
    for s in SECTIONS:
        if s != exclude:
            out |= F.col(f"n_{s}") > 0
    for c in ("additional", "title", "email", "phone", "summary"):
        out |= has_text(c)
    return out


def _hints(df: DataFrame, cases: list[tuple[Column, str, str, str, Column | None, Column | None]]) -> DataFrame:
    """Rows of several rules over one table: (condition, id, severity, section, field, entry)."""
    rows = [
        F.when(
            test,
            F.struct(
                F.lit(i).alias("hint_id"),
                F.lit(sev).alias("severity"),
                F.lit(sec).alias("section"),
                (F.lit(None) if field is None else field).cast("string").alias("field_key"),
                (F.lit(None) if entry is None else entry).cast("string").alias("entry_id"),
            ),
        )
        for test, i, sev, sec, field, entry in cases
    ]
    hit = df.select("cv_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("h"))
    return hit.select("cv_id", "h.*")


def _key(section: str, pos: Column, field: str) -> Column:
    return F.concat(F.lit(f"{section}."), pos.cast("string"), F.lit(f".{field}"))


def content_hints(cv: dict[str, DataFrame]) -> DataFrame:
    """Hints of all rules that read content."""
    n = nonws_len("summary")
    on = F.col("started")
    person = snapshot(cv).withColumn("started", started())
    summary, title = F.lit("shortSummary"), F.lit("professionalTitle")
    has = lambda s: F.col(f"n_{s}") > 0
    out = _hints(
        person,
        [
            ((n > 0) & (n < 80), "personal.summary-too-short", "Suggestion", "PersonalInformation", summary, None),
            (n > 600, "personal.summary-too-long", "Info", "PersonalInformation", summary, None),
            (on & (n == 0) & (has("work") | has("education")), "personal.summary-missing", "Suggestion", "PersonalInformation", summary, None),
            (on & ~has_text("title"), "personal.missing-title", "Suggestion", "PersonalInformation", title, None),
            (on & ~has("work") & other_data("work"), "work.section-empty", "Suggestion", "WorkExperience", None, None),
            (on & ~has("education") & other_data("education"), "education.section-empty", "Suggestion", "Education", None, None),
            (on & ~has("skill"), "skills.section-empty", "Suggestion", "Skills", None, None),
            (has("work") & ~has("language"), "languages.section-empty", "Suggestion", "Languages", None, None),
            (on & ~has("certificate") & other_data("certificate"), "certificates.section-empty", "Suggestion", "Certificates", None, None),
            (on & ~has("project") & other_data("project"), "projects.section-empty", "Suggestion", "Projects", None, None),
        ],
    )
    pos = F.col("pos")
    out = out.unionByName(
        _hints(
            cv["work"],
            [
                (~has_text("description"), "work.entry-missing-description", "Suggestion", "WorkExperience", _key("workExperience", pos, "description"), pos),
                (has_text("description") & is_generic("description"), "work.generic-description", "Suggestion", "WorkExperience", _key("workExperience", pos, "description"), pos),
            ],
        )
    )
    groups = cv["skill"].groupBy("cv_id", "gpos").agg(F.count_if(has_text("name")).alias("n"))
    out = out.unionByName(_hints(groups, [(F.col("n") > 15, "skills.single-large-group", "Info", "Skills", None, F.col("gpos"))]))
    out = out.unionByName(
        _hints(
            cv["project"],
            [(~has_text("description") & ~has_text("highlights"), "projects.entry-missing-description", "Suggestion", "Projects", _key("projects", pos, "description"), pos)],
        )
    )
    own = cv["personal"].select("cv_id", F.explode(F.array("linkedin_url", "github_url", "portfolio_url")).alias("url"))
    same = links_matching(cv["link"].where(has_text("url")), own)
    return out.unionByName(_hints(same, [(F.lit(True), "links.duplicate-personal-url", "Info", "Links", _key("links", pos, "url"), pos)]))


def review_hints(content: DataFrame, confidences: DataFrame) -> DataFrame:
    """Second stage: sections with two fields of low confidence, and such fields that have a hint already."""
    low = confidences.where("confidence = 'Low'").withColumn("section", section_of(F.col("field_key"))).where("section is not null")
    sections = low.groupBy("cv_id", "section").agg(F.count("*").alias("n")).where("n >= 2")
    none = F.lit(None).cast("string")
    out = sections.select("cv_id", F.lit("import.review-section").alias("hint_id"), F.lit("Info").alias("severity"), "section", none.alias("field_key"), none.alias("entry_id"))
    hinted = content.where("field_key is not null").select("cv_id", "field_key").distinct()
    fields = low.join(hinted, ["cv_id", "field_key"], "left_semi")
    return out.unionByName(fields.select("cv_id", F.lit("import.review-field").alias("hint_id"), F.lit("Info").alias("severity"), "section", "field_key", none.alias("entry_id")))


def report(cv: dict[str, DataFrame], confidences: DataFrame | None = None, dismissed: DataFrame | None = None) -> DataFrame:
    """All hints once each, without those dismissed (cv_id, dismiss_key)."""
    content = content_hints(cv)
    hints = content if confidences is None else content.unionByName(review_hints(content, confidences))
    key = dismissed_key(F.col("hint_id"), F.col("entry_id"), F.col("field_key"))
    hints = first_by(hints.withColumn("dismiss_key", key), ["cv_id", "dismiss_key"], ["section", "severity"])
    if dismissed is not None:
        hints = hints.join(dismissed.select("cv_id", "dismiss_key").distinct(), ["cv_id", "dismiss_key"], "left_anti")
    return hints.select(*COLUMNS, "dismiss_key")
