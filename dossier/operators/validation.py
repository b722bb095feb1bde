"""Validation by a table of field rules: required, longest, format; dates in order; repeated names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.dates import FIRST_YEAR, LAST_YEAR
from dossier.functions.text import ci_key, has_text, trim_ws
from dossier.functions.urls import url_valid

# Names of enumerated fields.
ENUMS = {
    "EmploymentType": ("FullTime", "PartTime", "Contract", "Freelance", "Internship", "Other"),
    "DegreeType": ("HighSchool", "Associate", "Bachelor", "Master", "Doctorate", "Certificate", "Other"),
    "ProficiencyLevel": ("Beginner", "Intermediate", "Advanced", "Expert"),
    "LanguageProficiency": ("Basic", "Intermediate", "Advanced", "Fluent", "Native"),
    "CefrLevel": ("A1", "A2", "B1", "B2", "C1", "C2"),
}

# Fixed values: (section, field, required, longest, format).
RULES = [
    ("personal", "firstName", True, 80, "Text"), ("personal", "lastName", True, 80, "Text"), ("personal", "professionalTitle", False, 120, "Text"),
    ("personal", "email", True, 160, "Email"), ("personal", "phone", False, 40, "Text"), ("personal", "location", False, 120, "Text"),
    ("personal", "linkedInUrl", False, 240, "Url"), ("personal", "portfolioUrl", False, 240, "Url"), ("personal", "gitHubUrl", False, 240, "Url"),
    ("personal", "shortSummary", False, 800, "Text"),
    ("work", "jobTitle", True, 120, "Text"), ("work", "company", True, 160, "Text"), ("work", "location", False, 120, "Text"),
    ("work", "employmentType", False, 40, "EmploymentType"), ("work", "startMonth", True, 2, "Month"), ("work", "startYear", True, 4, "Year"),
    ("work", "endMonth", False, 2, "Month"), ("work", "endYear", False, 4, "Year"), ("work", "description", False, 2000, "Text"),
    ("work", "achievements", False, 2000, "Text"), ("work", "technologies", False, 500, "Text"), ("work", "companyUrl", False, 240, "Url"),
    ("education", "institution", True, 160, "Text"), ("education", "degree", True, 160, "Text"), ("education", "fieldOfStudy", False, 160, "Text"),
    ("education", "location", False, 120, "Text"), ("education", "grade", False, 80, "Text"), ("education", "description", False, 2000, "Text"),
    ("education", "institutionUrl", False, 240, "Url"), ("education", "degreeType", False, 40, "DegreeType"),
    ("skills", "category", False, 120, "Text"), ("skills", "name", True, 80, "Text"), ("skills", "proficiency", False, 40, "ProficiencyLevel"),
    ("languages", "language", True, 80, "Text"), ("languages", "certificate", False, 120, "Text"), ("languages", "proficiency", False, 40, "LanguageProficiency"),
    ("languages", "cefr", False, 2, "CefrLevel"),
    ("certificates", "name", True, 160, "Text"), ("certificates", "issuer", False, 160, "Text"), ("certificates", "credentialId", False, 80, "Text"),
    ("certificates", "credentialUrl", False, 240, "Url"), ("certificates", "description", False, 500, "Text"),
    ("projects", "name", True, 160, "Text"), ("projects", "role", False, 120, "Text"), ("projects", "organization", False, 160, "Text"),
    ("projects", "url", False, 240, "Url"), ("projects", "highlights", False, 2000, "Text"), ("projects", "description", False, 2000, "Text"),
    ("projects", "technology", False, 80, "Text"),
    ("links", "label", False, 80, "Text"), ("links", "url", True, 240, "Url"), ("links", "note", False, 120, "Text"),
    ("additional", "content", False, 3000, "Text"),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "section string, field string, required boolean, longest int, format string")


def email_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[^\s@<>()\[\],;:\"]+@[^\s@<>()\[\],;:\".]+(\.[^\s@<>()\[\],;:\".]+)+$"), F.lit(False))


def format_valid(fmt: Column, value: Column) -> Column:
    """Whether a value has its field's format; unknown formats accept all. Enumerations accept integers too."""
    number = F.when(value.rlike(r"^[+-]?\d{1,9}$"), value.cast("int"))
    out = (
        F.when(fmt == "Email", email_valid(value))
        .when(fmt == "Url", url_valid(value))
        .when(fmt == "Month", F.coalesce(number.between(1, 12), F.lit(False)))
        .when(fmt == "Year", F.coalesce(number.between(FIRST_YEAR, LAST_YEAR), F.lit(False)))
    )
    for name, values in ENUMS.items():
        out = out.when(fmt == name, value.isin(*values) | value.rlike(r"^[+-]?\d{1,9}$"))
    return out.otherwise(True)


def violations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(…, section, field, message) of long-form values (…, section, field, value).

    A missing required value is one error and ends the field's checks; else length and format can both fail. The rules
    are a fixed list of about 60 rows, so their side of the join is broadcast.
    """
    v = trim_ws(F.coalesce(F.col("value"), F.lit("")))
    joined = values.join(F.broadcast(rules), ["section", "field"]).withColumn("v", v)
    blank = F.col("v") == ""
    found = F.array(
        F.when(F.col("required") & blank, "required"),
        F.when(~blank & (F.length("v") > F.col("longest")), "too_long"),
        F.when(~blank & ~format_valid(F.col("format"), F.col("v")), "format"),
    )
    messages = F.explode(F.filter(found, lambda x: x.isNotNull()))
    keep = [c for c in values.columns if c != "value"]
    return joined.select(*keep, messages.alias("message"))


def date_order(sm: Column, sy: Column, em: Column, ey: Column, running: Column) -> Column:
    """True where both dates are valid, the entry has ended and its start is after its end."""
    valid = lambda m, y: m.between(1, 12) & y.between(FIRST_YEAR, LAST_YEAR)
    return F.coalesce(~running & valid(sm, sy) & valid(em, ey) & (sy * 100 + sm > ey * 100 + em), F.lit(False))


def end_missing(em: Column, ey: Column, running: Column) -> Column:
    """Errors of an ended entry's missing end: array of 'end_month_required', 'end_year_required'."""
    found = F.array(F.when(~running & em.isNull(), "end_month_required"), F.when(~running & ey.isNull(), "end_year_required"))
    return F.filter(found, lambda x: x.isNotNull())


def repeats(df: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Second and later rows of a name within keys, ignoring case and outer spaces."""
    w = Window.partitionBy(*keys, ci_key(name)).orderBy(*order)
    return df.where(has_text(name)).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")
