"""The read facade: files of any format to one record, a row per file; errors are values of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import source_text
from dossier.functions.urls import url_label
from dossier.operators.extract import CV, import_texts
from dossier.operators.lineage import scratch
from dossier.operators.metrics import merged_warnings
from dossier.sources import structured, xml_rows
from dossier.sources.extract import extract
from dossier.sources.formats import OWN_KEY, STRUCTURED, format_of, read_files

FIELDS = ("personal", "work", "education", "skills", "languages", "certificates", "projects", "links", "additional", "warnings")


def _schema(spark: SparkSession) -> dict[str, str]:
    """Type of every field of the record."""
    struct = spark.createDataFrame([], CV).schema
    return {f.name: f.dataType.simpleString() for f in struct}


def _record(df: DataFrame, kinds: dict[str, str], made: dict[str, Column]) -> DataFrame:
    """Rows with all fields of the record; what a format does not have is null or empty."""
    empty = {"personal": F.lit(None), "additional": F.lit("")}
    cols = []
    for f in FIELDS:
        value = made.get(f, empty.get(f, F.array()))
        cols.append(F.from_json(F.to_json(value), kinds[f]).alias(f) if f in made and f not in ("additional", "warnings") else value.cast(kinds[f]).alias(f))
    return df.select("path", "format", *cols, "error")


def from_resumes(docs: DataFrame, fmt: str) -> DataFrame:
    """(path, text) of JSON Resume texts as records; profiles that fill no slot are links."""
    kinds = _schema(docs.sparkSession)
    r = structured.json_resume(docs, "path", "text").withColumn("format", F.lit(fmt))
    skills = F.transform("skills", lambda s: F.struct(s["category"].alias("category"), s["names"].alias("names")))
    certificates = F.transform("certificates", lambda c: F.struct(c["name"].alias("name"), c["issuer"].alias("issuer"), c["issued"]["month"].alias("month"), c["issued"]["year"].alias("year"), c["url"].alias("credential_url")))
    made = {"personal": F.col("personal"), "work": F.col("work"), "education": F.col("education"), "skills": skills, "languages": F.col("languages"), "certificates": certificates, "projects": F.col("projects")}
    return _record(r, kinds, made)


def from_tables(docs: DataFrame, delimiter: str) -> DataFrame:
    """(path, text) of tabular CVs as records: personal fields, unknown columns as additional information."""
    kinds = _schema(docs.sparkSession)
    t = structured.tabular(docs, delimiter, "path", "text").withColumn("format", F.lit("Csv"))
    who = F.struct(*structured.TABULAR)
    return _record(t, kinds, {"personal": who, "additional": F.col("extra"), "warnings": F.array_compact(F.array("warning"))})


def from_xml(docs: DataFrame, europass: bool) -> DataFrame:
    kinds = _schema(docs.sparkSession)
    x = xml_rows.xml_cv(docs, europass, "path", "text").withColumn("format", F.lit("EuropassXml" if europass else "HrXml"))
    who = F.struct("first_name", "last_name", "title", "email", "phone", "location", "summary")
    spoken = F.transform("languages", lambda n: F.struct(n.alias("language")))
    return _record(x, kinds, {"personal": who, "work": F.col("work"), "education": F.col("education"), "skills": F.col("skills"), "languages": spoken, "certificates": F.col("certificates"), "additional": F.coalesce("additional", F.lit(""))})


def from_own(docs: DataFrame) -> DataFrame:
    kinds = _schema(docs.sparkSession)
    schema = "struct<" + ",".join(f"{f}:{kinds[f]}" for f in FIELDS) + ">"
    o = structured.own_json(docs, schema, "path", "text").withColumn("format", F.lit("OwnJson"))
    return o.select("path", "format", *(F.col(f"cv.{f}").alias(f) for f in FIELDS), "error")


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, personal, …, warnings, error): every file below a folder, each read by the route of its format."""
    # Files are opened once, and kept by format, so that each route reads its own.
    kept = scratch(spark, "files")
    content = F.when(F.lower("path").rlike(r"\.(json|xml)$"), F.col("content").cast("string"))
    read_files(spark, path).select("path", "content", "error", format_of(F.col("path"), content).alias("format")).write.partitionBy("format").parquet(kept)
    stored = spark.read.schema("path string, content binary, error string, format string").parquet(kept)

    def kind(fmt: str, *extensions: str) -> DataFrame:
        """The files of a structured format that have one of some extensions."""
        own = stored.where((F.col("format") == fmt) & F.lower("path").rlike(rf"\.({'|'.join(extensions)})$"))
        return own.select("path", F.col("content").cast("string").alias("text"), "error")

    plain = extract(stored.where(~F.col("format").isin(*STRUCTURED)))
    known = F.struct("path", "format", "links", "warnings", "error")
    read = import_texts(plain.select(known.alias("file"), source_text("text").alias("text")), "file")
    ok = F.col("file.error").isNull()
    mine = lambda f: F.when(ok, F.col(f)).alias(f)
    # Links of the document itself come after those of its text.
    links = F.transform("file.links", lambda u: F.struct(url_label(u).alias("label"), u.alias("url")))
    said = F.transform("links", lambda x: F.lower(x["url"]))
    merged = F.concat("links", F.filter(links, lambda x: ~F.array_contains(said, F.lower(x["url"]))))
    out = read.select(
        "file.path", "file.format", *(mine(f) for f in FIELDS if f not in ("links", "warnings")), F.when(ok, F.coalesce(merged, F.col("links"))).alias("links"),
        merged_warnings(F.col("file.warnings"), F.when(ok, F.col("warnings"))).alias("warnings"), F.when(ok, F.col("error")).otherwise(F.col("file.error")).alias("error"),
    ).select("path", "format", *FIELDS, "error")

    yaml = structured.yaml_to_json(kind("Yaml", "yaml", "yml"), "path", "text")
    parts = [
        from_resumes(kind("JsonResume", "json"), "JsonResume"),
        from_resumes(yaml.select("path", F.coalesce("json", F.lit("")).alias("text")), "Yaml"),
        from_own(kind("OwnJson", "json")),
        from_tables(kind("Csv", "csv"), ","),
        from_tables(kind("Csv", "tsv"), "\t"),
        from_xml(kind("EuropassXml", "xml"), True),
        from_xml(kind("HrXml", "xml"), False),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out


def project(docs: DataFrame, settings: str, key: str = "path", text: str = "text") -> DataFrame:
    """(key, settings, partially_ignored, malformed) of project files: settings that do not parse do not spoil the content."""
    raw = F.get_json_object(text, "$.projectSettings")
    parsed = F.from_json(raw, settings)
    broken = F.json_object_keys(text).isNull()
    unread = raw.isNotNull() & F.coalesce(F.size(F.filter(F.json_object_keys(raw), lambda k: ~F.array_contains(F.json_object_keys(F.to_json(parsed)), k))) > 0, F.lit(True))
    return docs.select(key, parsed.alias("settings"), (~broken & unread).alias("partially_ignored"), (broken | F.get_json_object(text, f"$.{OWN_KEY}").isNull()).alias("malformed"))

