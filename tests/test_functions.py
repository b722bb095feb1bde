"""Unit cases of scalar rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dossier.functions import dates, text, urls
from dossier.operators import chunking, lines
from dossier.operators.extract import read_cv
from dossier.sources import formats, structured


def one(spark, make, *values):
    names = [f"c{n}" for n in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Line one\r\n\r\n\r\nLine two", "Line one\n\nLine two"),
        ("• Item one\n* Item two", "- Item one\n- Item two"),
        ("a – b  c", "a - b c"),
        ("  \n ", ""),
        (None, ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize, raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("01/2020 - 03/2024", (1, 2020, 3, 2024, False)),
        ("2020 - Present", (None, 2020, None, None, True)),
        ("06/2006", (6, 2006, None, None, False)),
        ("09 / 2002 - 06 / 2006", (9, 2002, 6, 2006, False)),
        ("Since 2019 - 2020", (None, None, None, 2020, False)),
        ("Title · Place · Mar 2019 – súčasnosť", (3, 2019, None, None, True)),
        ("January 2019", None),
        ("no date", None),
    ],
)
def test_ranges(spark, raw, want):
    got = one(spark, dates.parse_range, raw)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://www.Example.com/in/jane/", "https://example.com/in/jane"),
        ("linkedin.com/in/jane", "https://linkedin.com/in/jane"),
        ("HTTP://a.b:80/c?q=test#frag", "http://a.b/c?q=test"),
        ("  ", ""),
        (None, ""),
    ],
)
def test_urls(spark, raw, want):
    assert one(spark, urls.normal_url, raw) == want


def test_headings(spark):
    found = [one(spark, lines.heading_of, x) for x in ("Work Experience", "SKILLS:", "Pracovné skúsenosti", "Technologies", "My skills here and there", "jane@example.com", "Experience 2019")]
    assert found == ["WorkExperience", "Skills", "WorkExperience", None, None, None, None]


def test_segments(spark):
    raw = "Jane\n\nSkills\nC#\nSkills\nDocker\nEducation\n"
    df = spark.createDataFrame([(1, raw), (2, "free text"), (3, None)], "doc_id int, text string")
    got = {(r["doc_id"], r["section"]): (r["body"], r["warning"]) for r in lines.segment(df).collect()}
    assert got == {
        (1, "Header"): ("Jane", None),
        (1, "Skills"): ("C#\n\nDocker", None),
        (2, "Header"): ("free text", "no_sections"),
        (2, "AdditionalInformation"): ("free text", "no_sections"),
    }


def test_split_title_company(spark):
    got = [tuple(one(spark, lines.split_title_company, x)) for x in ("Dev at Acme", "Acme - Dev", "Dev | Acme", "Dev")]
    assert got == [("Dev", "Acme"), ("Dev", "Acme"), ("Dev", "Acme"), ("Dev", "")]


def test_windows_cover(spark):
    t = "x" * 3001
    got = one(spark, lambda c: chunking.windows(c, 850, True), t)
    assert got[0] == t[:850] and sum(map(len, got)) - 85 * (len(got) - 1) == len(t)


def test_escapes(spark):
    assert one(spark, text.escape_latex, "a\\b_{c}") == "a\\textbackslash\\{\\}b\\_\\{c\\}"
    assert one(spark, text.escape_html, '<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, lambda c: text.escape_csv(c, ","), 'a,"b"') == '"a,""b"""'


def test_flavours(spark):
    assert [one(spark, formats.json_flavour, x) for x in ('{"work": []}', f'{{"{formats.OWN_KEY}": 1}}', "[1]", "{", None)] == ["JsonResume", "OwnJson", "Unknown", "Unknown", "Unknown"]
    assert [one(spark, formats.xml_flavour, x) for x in ("<SkillsPassport/>", "<Resume/>", "<!DOCTYPE x><Resume/>", "<a/>")] == ["EuropassXml", "HrXml", "Unknown", "Unknown"]


def test_strict_tabular_keeps_quoted_delimiters(spark):
    df = spark.createDataFrame([(1, 'Name,City\n"Doe, Jane",Bratislava')], "cv_id int, text string")
    assert structured.tabular(df, strict=True).first()["location"] == "Bratislava"
    assert structured.tabular(df).first()["location"] != "Bratislava"


def test_read_cv_survives_noise():
    got = read_cv({"Header": "???\n\n", "WorkExperience": "2020 - 2021\n\n- \n", "Education": "·", "Skills": ",,", "Languages": ":", "Links": "http://x"})
    assert got["personal"]["first_name"] == "" and isinstance(got["work"], list)


def test_extraction(spark):
    got = read_cv({"Header": "Jane Doe\nEngineer\njane@example.com", "WorkExperience": "Dev at Acme\n03/2019\nDid it", "Education": "University of X\nMaster in Physics\n2012", "Languages": "English (C1)\nSlovak - Native"})
    assert got["work"][0] | {"description": ""} == {"job_title": "Dev", "company": "Acme", "location": "", "description": "", "technologies": "", "start_month": 3, "start_year": 2019, "end_month": 3, "end_year": 2019, "is_current": False}
    assert (got["education"][0]["start_year"], got["education"][0]["end_year"], got["education"][0]["degree_type"]) == (2010, 2012, "Master")
    assert [x["cefr"] for x in got["languages"]] == ["C1", None] and got["languages"][1]["proficiency"] == "Native"
