"""Entries of a CV: whether one has input, field rows, preview lines, labels, levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.dates import range_label
from dossier.functions.text import blank_to_null, has_text, trim_ws


def any_text(*cs: Column | str) -> Column:
    out = F.lit(False)
    for c in cs:
        out |= has_text(c)
    return out


def any_set(*cs: Column | str) -> Column:
    return F.coalesce(*(F.col(c) if isinstance(c, str) else c for c in cs)).isNotNull()


def work_has_input(e: Column) -> Column:
    """A running entry, a kind other than the default, any part of a date or any text."""
    texts = [e[f] for f in ("job_title", "company", "location", "description", "achievements", "technologies", "company_url")]
    dates = [e[f] for f in ("start_month", "start_year", "end_month", "end_year")]
    return F.coalesce(e["is_current"], F.lit(False)) | (F.coalesce(e["employment_type"], F.lit("FullTime")) != "FullTime") | any_set(*dates) | any_text(*texts)


def education_has_input(e: Column) -> Column:
    texts = [e[f] for f in ("institution", "degree", "field_of_study", "location", "grade", "description", "institution_url")]
    dates = [e[f] for f in ("start_month", "start_year", "end_month", "end_year")]
    return F.coalesce(e["is_current"], F.lit(False)) | (F.coalesce(e["degree_type"], F.lit("Bachelor")) != "Bachelor") | any_set(*dates) | any_text(*texts)


def skill_group_has_input(g: Column) -> Column:
    return has_text(g["category"]) | F.coalesce(F.exists(g["skills"], lambda s: has_text(s["name"])), F.lit(False))


def language_has_input(e: Column) -> Column:
    """A name, a certificate, a level beside the default, or any part's level; an entry without a name counts."""
    return any_text(e["language"], e["certificate"]) | (F.coalesce(e["proficiency"], F.lit("Intermediate")) != "Intermediate") | any_set(*(e[f] for f in ("cefr", "reading", "writing", "speaking", "listening")))


def certificate_has_input(e: Column) -> Column:
    return any_text(*(e[f] for f in ("name", "issuer", "credential_id", "credential_url", "description"))) | any_set(*(e[f] for f in ("issue_month", "issue_year", "expiration_month", "expiration_year")))


def project_has_input(e: Column) -> Column:
    texts = [e[f] for f in ("name", "role", "organization", "url", "highlights", "description")]
    dates = [e[f] for f in ("start_month", "start_year", "end_month", "end_year")]
    return F.coalesce(e["is_active"], F.lit(False)) | any_text(*texts) | any_set(*dates) | F.coalesce(F.exists(e["technologies"], has_text), F.lit(False))


def link_has_input(e: Column) -> Column:
    return any_text(e["label"], e["url"], e["note"])


def dotted(*cs: Column) -> Column:
    """Parts that are not blank, by middle dots."""
    return F.concat_ws(" · ", *(blank_to_null(c) for c in cs))


def work_meta(e: Column, present: str = "Present") -> Column:
    return dotted(e["company"], e["location"], e["employment_type"], range_label(e["start_month"], e["start_year"], e["end_month"], e["end_year"], e["is_current"], present))


def certificate_line(e: Column) -> Column:
    """Name, issuer, issue date and validity."""
    when = lambda m, y: F.when(y.isNotNull(), F.concat_ws(" / ", F.lpad(m.cast("string"), 2, "0"), y.cast("string")))
    valid = when(e["expiration_month"], e["expiration_year"])
    return dotted(e["name"], e["issuer"], when(e["issue_month"], e["issue_year"]), F.when(valid.isNotNull(), F.concat(F.lit("Valid until "), valid)))


def certificate_details(e: Column) -> Column:
    """Labelled lines of a certificate's other fields."""
    parts = [("Credential ID", "credential_id"), ("URL", "credential_url"), ("Description", "description")]
    return F.filter(F.array(*(F.when(has_text(e[f]), F.concat(F.lit(f"{label}: "), trim_ws(e[f]))) for label, f in parts)), lambda x: x.isNotNull())


# Flags by language name, in the language itself and in English.
FLAGS = {
    "english": "🇬🇧", "slovak": "🇸🇰", "slovenčina": "🇸🇰", "czech": "🇨🇿", "čeština": "🇨🇿", "german": "🇩🇪", "deutsch": "🇩🇪", "french": "🇫🇷", "français": "🇫🇷",
    "spanish": "🇪🇸", "español": "🇪🇸", "italian": "🇮🇹", "polish": "🇵🇱", "hungarian": "🇭🇺", "ukrainian": "🇺🇦", "russian": "🇷🇺", "chinese": "🇨🇳", "japanese": "🇯🇵", "portuguese": "🇵🇹", "dutch": "🇳🇱",
}


def flag(language: Column) -> Column:
    """Flag of a language, a globe for unknown ones, nothing for blank names."""
    table = F.create_map(*(F.lit(x) for kv in FLAGS.items() for x in kv))
    return F.when(has_text(language), F.coalesce(F.element_at(table, F.lower(trim_ws(language))), F.lit("🌐"))).otherwise("")


def language_line(e: Column) -> Column:
    return F.concat_ws(" ", F.nullif(flag(e["language"]), F.lit("")), dotted(e["language"], e["proficiency"], e["cefr"], e["certificate"]))


def language_details(e: Column) -> Column:
    parts = ("reading", "writing", "speaking", "listening")
    return F.filter(F.array(*(F.when(has_text(e[f]), F.concat(F.lit(f"{f.capitalize()}: "), e[f])) for f in parts)), lambda x: x.isNotNull())


def link_line(e: Column) -> Column:
    return F.concat(F.when(has_text(e["label"]), F.concat(trim_ws(e["label"]), F.lit(": "))).otherwise(""), F.coalesce(trim_ws(e["url"]), F.lit("")), F.when(has_text(e["note"]), F.concat(F.lit(" — "), trim_ws(e["note"]))).otherwise(""))


def project_line(e: Column) -> Column:
    return dotted(e["name"], e["role"], e["organization"], range_label(e["start_month"], e["start_year"], e["end_month"], e["end_year"], e["is_active"]))


def project_details(e: Column) -> Column:
    tech = F.array_join(F.filter(e["technologies"], has_text), ", ")
    parts = [("Technologies", tech), ("URL", e["url"]), ("Highlights", e["highlights"]), ("Description", e["description"])]
    return F.filter(F.array(*(F.when(has_text(c), F.concat(F.lit(f"{label}: "), trim_ws(c))) for label, c in parts)), lambda x: x.isNotNull())


def skill_line(s: Column) -> Column:
    """'name · level · n yrs'."""
    years = F.when(s["years"].isNotNull(), F.concat(s["years"].cast("string"), F.lit(" yrs")))
    return dotted(s["name"], s["proficiency"], years)


def group_summary(category: Column, names: Column, most: int = 3) -> Column:
    """Category and the first few skills, with an ellipsis when there are more."""
    first = F.array_join(F.slice(names, 1, most), ", ")
    return F.concat(F.coalesce(blank_to_null(category), F.lit("-")), F.when(F.size(names) > 0, F.concat(F.lit(": "), first)).otherwise(""), F.when(F.size(names) > most, "…").otherwise(""))


def field_values(row: dict[str, Column]) -> Column:
    """(field, value) pairs of an entry, to be exploded."""
    return F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in row.items()))


def populated(flags: Column) -> Column:
    """Number of sections with data in a map of flags."""
    return F.size(F.map_filter(flags, lambda _, v: v))


def section_flags(**sections: Column) -> Column:
    """map<section, has data>."""
    return F.create_map(*(x for k, v in sections.items() for x in (F.lit(k), v)))


def personal_state(first: Column, last: Column, email: Column) -> Column:
    """'complete', 'partial' or a dash."""
    n = sum((has_text(c).cast("int") for c in (first, last, email)), F.lit(0))
    return F.when(n == 3, "complete").when(n > 0, "partial").otherwise("—")


# Synonyms of proficiencies, most telling first.
PROFICIENCY = {"native": "Native", "mother tongue": "Native", "bilingual": "Native", "fluent": "Fluent", "advanced": "Advanced", "professional": "Advanced", "intermediate": "Intermediate", "basic": "Basic", "beginner": "Basic", "elementary": "Basic"}


def proficiency(token: Column) -> Column:
    """struct<proficiency, cefr> of a level in words or as a CEFR code; intermediate by default."""
    t = F.lower(trim_ws(token))
    cefr = F.upper(F.regexp_extract(t, r"\b([abc][12])\b", 1))
    word = F.lit(None).cast("string")
    for k, v in reversed(PROFICIENCY.items()):
        word = F.when(t.contains(k), v).otherwise(word)
    return F.struct(F.coalesce(word, F.lit("Intermediate")).alias("proficiency"), F.nullif(cefr, F.lit("")).alias("cefr"))


def confidence(direct: Column, inferred: Column) -> Column:
    return F.when(direct, "High").when(inferred, "Medium").otherwise("Low")


def page_bytes(pages: Column, fmt: Column, scale: Column, quality: Column, base: int = 350_000) -> Column:
    """Estimated size of exported page images."""
    factor = F.when(fmt == "jpeg", 0.35 + 0.4 * quality / 100).when(fmt == "webp", 0.25 + 0.35 * quality / 100).otherwise(1.0)
    return F.ceil(pages * base * scale * scale * factor).cast("long")


def memory_tier(ram_bytes: Column) -> Column:
    """Largest tier of model that a memory size carries; the smallest known one where it is unknown."""
    gb = ram_bytes / (1 << 30)
    return F.when(ram_bytes.isNull(), "Small").when(gb < 8, "Compact").when(gb < 16, "Small").when(gb < 32, "Medium").when(gb < 64, "Large").otherwise("ExtraLarge")


def tag_matches(installed: Column, tag: Column) -> Column:
    """Installed names equal to a catalogue tag, or that tag with a suffix after a colon; distinct, ignoring case."""
    hit = F.filter(installed, lambda x: (F.lower(x) == F.lower(tag)) | F.lower(x).startswith(F.concat(F.lower(tag), F.lit(":"))))
    keys = F.transform(hit, F.lower)
    return F.filter(hit, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
