"""Queries over XML CVs. An order is an element of its customer's document, written in terms that both engines read alike; SQL finds fields by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.plans.registry import load, query
from dossier.sources import xml_rows

EUROPASS = """case o_orderkey % 11 when 0 then '<WorkExperience><Title>T' || (o_orderkey % 5) || '</Title><Position>P' || (o_orderkey % 7) || '</Position><Employer><Name>N' || (o_orderkey % 3) || '</Name></Employer><Period>2001 - 2005</Period></WorkExperience>'
 when 1 then '<e:WorkHistory><Profession> Dev &amp; Ops ' || (o_orderkey % 4) || '</Profession><EmployerName>E</EmployerName><Town>Brno</Town><TimeInterval><From y="1999"/>to PRESENT</TimeInterval></e:WorkHistory>'
 when 2 then '<Education><Level>MSc</Level><School><Name>MU' || (o_orderkey % 4) || '</Name></School><Field><![CDATA[A<B]]></Field><Period>' || (1960 + o_orderkey % 50) || '</Period></Education>' when 3 then '<ForeignLanguage><Description>Lang' || (o_orderkey % 3) || '</Description></ForeignLanguage>'
 when 4 then '<MotherTongue>lang1 | x</MotherTongue>' when 5 then '<Certificate><Name>C' || (o_orderkey % 6) || '</Name><Issuer>I</Issuer><Date>2015-01 or 2013</Date></Certificate>' when 6 then '<Competences><Skill><Title>S' || (o_orderkey % 4) || '</Title></Skill></Competences>'
 when 7 then '<Skill>Solo' || (o_orderkey % 3) || '/x</Skill><!-- <Skill>no</Skill> -->' when 8 then '<OtherInfo>Note  ' || (o_orderkey % 9) || '</OtherInfo>' when 9 then '<Reference a="1>2">R</Reference>' else '<Education><Title></Title></Education><WorkExperience/>' end"""
_IDENTITY = "'<Identification><PersonName><FirstName>Ann' || c_custkey || '</FirstName><Surname></Surname></PersonName><ContactInfo><Email>a@b.cz</Email><Mobile>' || c_nationkey || '</Mobile></ContactInfo></Identification>'"
HR = """case o_orderkey % 9 when 0 then '<h:PositionHistory><Title>T' || (o_orderkey % 5) || '</Title><OrganizationName>N' || (o_orderkey % 3) || '</OrganizationName><Dates from="1905">2201 and 2190</Dates></h:PositionHistory>'
 when 1 then '<EmploymentHistoryItem><EmployerOrgName> E </EmployerOrgName><positiontitle>P' || (o_orderkey % 4) || '</positiontitle><Description>did</Description><End>Present</End></EmploymentHistoryItem>' when 2 then '<PositionHistory><Description>no title</Description></PositionHistory>'
 when 3 then '<SchoolOrInstitution><SchoolName>MU' || (o_orderkey % 4) || '</SchoolName><DegreeName>MSc</DegreeName><DegreeMajor>M</DegreeMajor><Y>2001 2004</Y></SchoolOrInstitution>' when 4 then '<EducationHistoryItem><EducationDegree>BSc</EducationDegree></EducationHistoryItem>'
 when 5 then '<Language><LanguageCode>L' || (o_orderkey % 3) || '</LanguageCode></Language>' when 6 then '<MotherTongue> l1 </MotherTongue>' when 7 then '<SchoolOrInstitution> </SchoolOrInstitution>' else '<x/>' end"""


def documents(spark: SparkSession, sf_dir: str, fragment: str, before: Column, after: str) -> DataFrame:
    """(c_custkey, text): a document for each customer with an element for each order."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr(fragment).alias("x"))
    own = o.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "x"))), lambda r: r["x"]), "").alias("body"))
    return load(spark, sf_dir, "customer").join(own, "c_custkey").select("c_custkey", F.concat(before, F.col("body"), F.lit(after)).alias("text"))


def said(rows: str, *fields: str) -> Column:
    """Rows of an array as one text."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws("|", *(F.coalesce(r[f].cast("string"), F.lit("-")) for f in fields))), ";")


def _text(*names: str) -> str:
    """SQL: the text of the first of some elements that has one, else an empty text."""
    one = [f"nullif(trim(replace(replace(replace(regexp_extract(x, '(?i)<{n}[^<>]*>([^<]*|<!.CDATA.*?..>)</{n}>', 1), '<![CDATA[', ''), ']]>', ''), '&amp;', '&')), '')" for n in names]
    return f"coalesce({', '.join(one)}, '')"


_YEARS = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '\\b(19|20)[0-9][0-9]\\b'), lambda y: y::int), lambda y: y > {1} and y < {2})))"


@query(
    rf"""with o as (select o_custkey as cv, o_orderkey as n, {EUROPASS} as x from orders), y as (select *, {_YEARS.format("regexp_extract(x, '<(Period|TimeInterval)>.*</(Period|TimeInterval)>', 0)", 1950, 2150)} as ys, {_YEARS.format("x", 1950, 2150)} as every from o),
 w as (select cv, n, {_text("Position", "Profession", "Title")} || '|' || {_text("Name", "EmployerName")} || '|' || {_text("Town")} || '|' || coalesce(ys[1]::varchar, '-') || '|' || coalesce(case when len(ys) > 1 then ys[-1] end::varchar, '-') || '|' || contains(lower(x), 'present')::varchar as v from y where regexp_matches(x, '<(WorkExperience|e:WorkHistory)>')),
 e as (select cv, n, {_text("Name")} || '|' || {_text("Level", "Title")} || '|' || {_text("Field")} || '|' || coalesce(ys[1]::varchar, '-') as v from y where contains(x, '<Education>') and contains(x, '<Level>')),
 l as (select cv, n, case when contains(x, '<Mother') then 'lang1' else {_text("Description")} end as v from y where regexp_matches(x, '<(ForeignLanguage|MotherTongue)>')), lu as (select cv, min(n) as n, arg_min(v, n) as v from l group by cv, lower(v)),
 c as (select cv, n, {_text("Name")} || '|' || {_text("Issuer")} || '|' || every[1] as v from y where contains(x, '<Certificate>')), s as (select cv, n, case when contains(x, '<Competences>') then 'Competences' else 'General' end as g, case when contains(x, '<Title>S') then {_text("Title")} else regexp_extract(x, '<Skill>([^/]*)/x', 1) end as v from y where contains(x, '<Skill>')),
 sg as (select cv, g, min(n) as n, g || '|' || string_agg(v, ',' order by n) as v from s group by cv, g), m as (select cv, n, case when contains(x, 'OtherInfo') then 0 else 1 end as k, regexp_extract(x, '<([A-Za-z]+)', 1) || ': ' || regexp_replace(x, '\s+', ' ', 'g') as v from y where regexp_matches(x, '<(OtherInfo|Reference)'))
 select c_custkey, 'Ann' || c_custkey as first_name, '' as last_name, 'a@b.cz' as email, c_nationkey::varchar as phone, coalesce((select string_agg(v, ';' order by n) from w where cv = c_custkey), '') as work, coalesce((select string_agg(v, ';' order by n) from e where cv = c_custkey), '') as education, coalesce((select string_agg(v, ',' order by n) from lu where cv = c_custkey), '') as languages,
 coalesce((select string_agg(v, ';' order by n) from c where cv = c_custkey), '') as certificates, coalesce((select string_agg(v, ';' order by n) from sg where cv = c_custkey), '') as skills, coalesce((select string_agg(v, chr(10) || chr(10) order by k, n) from m where cv = c_custkey), '') as additional from customer where c_custkey in (select cv from o)"""
)
def europass_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, studies, languages, certificates, skills and other sections of Europass documents."""
    d = documents(spark, sf_dir, EUROPASS, F.concat(F.lit('<?xml version="1.0"?><SkillsPassport xmlns:e="urn:e">'), F.expr(_IDENTITY)), "</SkillsPassport>\n")
    x = xml_rows.xml_cv(d, True, "c_custkey")
    skills = F.array_join(F.transform("skills", lambda g: F.concat(g["category"], F.lit("|"), F.array_join(g["names"], ","))), ";")
    return x.select(
        "c_custkey", "first_name", "last_name", "email", "phone", said("work", "job_title", "company", "location", "start_year", "end_year", "is_current").alias("work"), said("education", "institution", "degree", "field_of_study", "start_year").alias("education"),
        F.array_join("languages", ",").alias("languages"), said("certificates", "name", "issuer", "year").alias("certificates"), skills.alias("skills"), "additional",
    )


@query(
    rf"""with o as (select o_custkey as cv, o_orderkey as n, {HR} as x from orders), y as (select *, {_YEARS.format("x", 1900, 2200)} as ys from o),
 w as (select cv, n, {_text("PositionTitle", "Title")} || '|' || {_text("EmployerOrgName", "OrganizationName")} || '|' || {_text("Description")} || '|' || coalesce(ys[1]::varchar, '-') || '|' || coalesce(case when len(ys) > 1 then ys[-1] end::varchar, '-') || '|' || contains(lower(x), 'present')::varchar as v from y where regexp_matches(x, '<(h:PositionHistory|EmploymentHistoryItem)>')),
 e as (select cv, n, {_text("SchoolName")} || '|' || {_text("DegreeName", "EducationDegree")} || '|' || {_text("DegreeMajor")} || '|' || coalesce(ys[1]::varchar, '-') || '|' || coalesce(ys[2]::varchar, '-') as v from y where regexp_matches(x, '<(SchoolName|EducationDegree)>')),
 l as (select cv, n, {_text("LanguageCode", "MotherTongue")} as v from y where regexp_matches(x, '<(Language|MotherTongue)>')), lu as (select cv, min(n) as n, arg_min(v, n) as v from l group by cv, lower(v))
 select c_custkey, case when c_custkey % 5 = 0 then null else 'Pre' end as first_name, case when c_custkey % 5 = 0 then null else c_mktsegment end as last_name, case when c_custkey % 5 = 0 then null when c_custkey % 2 = 0 then 'CZ' else '' end as location, case when c_custkey % 5 > 0 then coalesce((select string_agg(v, ';' order by n) from w where cv = c_custkey), '') end as work,
 case when c_custkey % 5 > 0 then coalesce((select string_agg(v, ';' order by n) from e where cv = c_custkey), '') end as education, case when c_custkey % 5 > 0 then coalesce((select string_agg(v, ',' order by n) from lu where cv = c_custkey), '') end as languages, case when c_custkey % 5 = 0 then 'unreadable' end as error from customer where c_custkey in (select cv from o)"""
)
def hr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, studies and languages of HR-XML documents, every fifth of which does not close its tags."""
    k = F.col("c_custkey")
    head = F.concat(F.lit('<Resume xmlns:h="urn:h"><PersonName><GivenName> </GivenName><PreferredGivenName>Pre</PreferredGivenName><FamilyName>'), "c_mktsegment", F.lit("</FamilyName></PersonName>"), F.when(k % 2 == 0, "<CountryCode>CZ</CountryCode>").otherwise(""), F.when(k % 5 == 0, "<open>").otherwise(""))
    x = xml_rows.xml_cv(documents(spark, sf_dir, HR, head, "</Resume>"), False, "c_custkey")
    return x.select(
        "c_custkey", "first_name", "last_name", "location", said("work", "job_title", "company", "description", "start_year", "end_year", "is_current").alias("work"), said("education", "institution", "degree", "field_of_study", "start_year", "end_year").alias("education"), F.array_join("languages", ",").alias("languages"), "error"
    )
