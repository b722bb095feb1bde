"""Queries that write files from a table and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.lineage import scratch
from dossier.plans.cv_queries import _X, EXPORTED, persons
from dossier.plans.entry_queries import joined
from dossier.plans.registry import query
from dossier.sources import files, formats, importer, writers

#: Each person is written in one format.
KINDS = ("csv", "tsv", "yaml", "europass_xml", "md", "html", "txt", "json_resume", "hr_xml")
FILES = f"""{EXPORTED}, h as (select cv_id, 'hr_xml' as format, '<Resume><PersonName><GivenName>' || first_name || '</GivenName>' || case when last_name <> '' then '<FamilyName>' || {_X.format("last_name")} || '</FamilyName>' else '' end || '<InternetEmailAddress>' || email || '</InternetEmailAddress></PersonName></Resume>' as content from x),
 a as (select *, [{", ".join(f"'{k}'" for k in KINDS)}][(cv_id % 9 + 1)::int] as own from (from e union all from h)),
 f as (select cv_id, format, content, cv_id || case format when 'europass_xml' then '.europass.xml' when 'hr_xml' then '.hr.xml' when 'json_resume' then '.json' else '.' || format end as name,
  case format when 'csv' then 'Csv' when 'tsv' then 'Csv' when 'yaml' then 'Yaml' when 'europass_xml' then 'EuropassXml' when 'hr_xml' then 'HrXml' when 'md' then 'Markdown' when 'html' then 'Html' when 'txt' then 'PlainText' else 'JsonResume' end as kind from a where format = own)"""


def written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the files just written: one for each person, and one that names no format."""
    path = scratch(spark, "persons")
    own = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("cv_id") % len(KINDS) + 1).cast("int"))
    suffix = F.create_map(*(F.lit(x) for f in KINDS for x in (f, files.SUFFIXES[f])))
    mine = writers.export(persons(spark, sf_dir), "cv_id", KINDS, own).select(F.concat(F.col("cv_id").cast("string"), F.element_at(suffix, F.col("format"))).alias("name"), "content")
    odd = persons(spark, sf_dir).where("cv_id % 50 = 0").select(F.concat(F.lit("odd"), F.col("cv_id").cast("string"), F.lit(".xyz")).alias("name"), joined("odd", F.col("cv_id").cast("string")).alias("content"))
    files.write_files(mine.unionByName(odd), path)
    return path


@query(f"with {FILES} select name, kind as format, octet_length(encode(content))::bigint as size, sha256(content) as digest from f union all select 'odd' || c_custkey || '.xyz', 'Unknown', length('odd' || c_custkey), sha256('odd' || c_custkey) from customer where c_custkey % 50 = 0")
def files_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of nine formats and one of none, written from a table and read again byte for byte."""
    read = formats.read_files(spark, written(spark, sf_dir))
    return read.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), formats.format_of(F.col("path"), F.col("content").cast("string")).alias("format"), "size", F.sha2("content", 256).alias("digest"))


@query(
    f"""with {FILES} select name, kind as format, case when kind in ('Markdown', 'Html', 'PlainText') then '' else first_name end as first_name, case when kind in ('Markdown', 'Html', 'PlainText') then '' when kind = 'Csv' then replace(last_name, '"', '""') else last_name end as last_name, case when kind in ('Markdown', 'Html', 'PlainText') then '' else k.email end as email, case when kind in ('Markdown', 'Html', 'PlainText') and summary = '' then 'no_structured_data' end as error from f join k using (cv_id)
 union all select 'odd' || c_custkey || '.xyz', 'Unknown', null, null, null, 'unsupported_format' from customer where c_custkey % 50 = 0"""
)
def files_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of nine formats read by the routes of their formats into one record; files of no known format are errors."""
    read = importer.import_files(spark, written(spark, sf_dir))
    return read.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "format", "personal.first_name", "personal.last_name", "personal.email", "error")


@query(
    f"""with {FILES} select name, kind as format, contains(content, 'Summary') as has_summary, case when contains(content, 'Summary') then 'Header,Summary' else 'AdditionalInformation,Header' end as parts, '' as email from f join k using (cv_id) where kind in ('Markdown', 'Html', 'PlainText')"""
)
def files_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go through text, with what was extracted, segmented and found kept together."""
    read = files.text_attempts(spark, written(spark, sf_dir))
    text = F.col("extraction.text")
    return read.select(
        F.regexp_extract("path", "[^/]+$", 0).alias("name"), "format", text.contains("Summary").alias("has_summary"), F.array_join(F.array_sort(F.map_keys("sections")), ",").alias("parts"), "result.personal.email",
    )
