"""Entries, cues, folds, layout, writers, sources and streams on small cases."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dossier.functions import cues, entries, text
from dossier.operators import extract, folds, layout, linkage, trees
from dossier.sources import formats, structured, writers, xml_rows
from dossier.sources import extract as readers
from dossier.sources.importer import import_files, project
from dossier.streaming import progress


def ask(spark, make, *lines):
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, x string")
    return [r["y"] for r in df.select("n", make(F.col("x")).alias("y")).orderBy("n").collect()]


def test_cues(spark):
    assert ask(spark, cues.location, "Bratislava, Slovakia", "C#, Java", "a, b, c", "Praha 4, CZ") == [True, False, False, False]
    assert ask(spark, cues.technology_list, "Spark, Kafka, SQL", "we did this, that was it", "Paris, France", "Node.js, .NET") == [True, False, False, True]
    assert ask(spark, cues.plausible_skill, "Python", "jane@x.yz", "Jane Doe", "a b c d e", "x") == [True, False, False, False, False]
    assert ask(spark, cues.standalone_skill, "C++", "Docker", "Some long thing here") == [True, True, False]
    assert ask(spark, cues.incomplete_institution, "Faculty of", "School of Arts", "School of Engineering", "University of", "MIT") == [True, True, False, False, False]
    assert ask(spark, cues.degree_type, "PhD in X", "Ing. Novak", "BSc", "Course", "?") == ["Doctorate", "Master", "Bachelor", "Certificate", "Other"]
    assert ask(spark, cues.language_part, "Reading: C1", "English: C1") == [True, False]
    assert ask(spark, cues.work_bleed, "X s.r.o. Praha", "2019 - 2020", "Docker") == [True, True, False]
    assert ask(spark, cues.plausible_category, "DevOps", "Cloud & DevOps", "Docker", "Some odd label") == [True, True, False, False]


def test_folds(spark):
    assert ask(spark, folds.url_lines, "see https://\nexample.com/a\nnext one")[0] == ["see https://example.com/a", "next one"]
    assert ask(spark, folds.labelled_lines, "Phone: +421\n 900\n\nrest\nCity: x")[0] == ["Phone: +421 900", "", "rest", "City: x"]
    unit = " ".join(f"word{n}" for n in range(15)) + " "
    assert ask(spark, lambda c: folds.repeated_prefix(c), unit + unit + "tail", "short", None) == [unit.strip(), "short", None]
    df = spark.createDataFrame([(["School of", "Arts\n2001", "Next School\n2002"],)], "b array<string>")
    assert df.select(folds.education_blocks(F.col("b")).alias("x")).first()["x"] == ["School of\nArts\n2001", "Next School\n2002"]
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(["Spark", "SQL · Expert", "Kafka", "Advanced", "Beginner"])], "doc_id int, pos int, line string")
    assert [r["line"] for r in folds.orphan_levels(lines).orderBy("pos").collect()] == ["Spark · Advanced", "SQL · Expert", "Kafka · Beginner"]
    assert ask(spark, folds.orphan_dates, "a\n/ 2019 - 3 / 2020\nb")[0] == ["/ 2019 - 3 / 2020"]


def test_json_merge(spark):
    df = spark.sql("select map('a', 'x', 'b', 'y') as a, map('b', 'z', 'c', cast(null as string)) as b, array(1) as p, array(2, null) as q")
    r = df.select(folds.merged_json(F.col("a"), F.col("b")).alias("m"), folds.appended(F.col("p"), F.col("q")).alias("l")).first()
    assert r["m"] == {"a": "x", "b": "z"} and r["l"] == [1, 2]


def test_entry_rules(spark):
    df = spark.sql("""select named_struct('language', '', 'certificate', '', 'proficiency', 'Fluent', 'cefr', cast(null as string), 'reading', cast(null as string), 'writing', cast(null as string),
      'speaking', 'C1', 'listening', cast(null as string)) as l, named_struct('label', ' Web ', 'url', 'http://x', 'note', 'mine') as k, named_struct('name', 'Spark', 'proficiency', 'Expert', 'years', 5) as s""")
    r = df.select(
        entries.language_has_input(F.col("l")).alias("a"), entries.language_details(F.col("l")).alias("b"), entries.link_line(F.col("k")).alias("c"), entries.skill_line(F.col("s")).alias("d"),
        entries.group_summary(F.lit("Tools"), F.array(*map(F.lit, "abcd"))).alias("e"), entries.flag(F.lit("Slovak")).alias("f"), entries.proficiency(F.lit("Fluent (C1)")).alias("g"),
        entries.memory_tier(F.lit(16 << 30)).alias("h"), entries.tag_matches(F.array(F.lit("M:7b"), F.lit("m"), F.lit("mx")), F.lit("m")).alias("i"), entries.personal_state(F.lit("a"), F.lit(""), F.lit("")).alias("j"),
    ).first()
    assert r["a"] and r["b"] == ["Speaking: C1"] and r["c"] == "Web: http://x — mine" and r["d"] == "Spark · Expert · 5 yrs" and r["e"] == "Tools: a, b, c…"
    assert (r["f"], tuple(r["g"]), r["h"], r["i"], r["j"]) == ("🇸🇰", ("Fluent", "C1"), "Medium", ["M:7b", "m"], "partial")


def test_layout():
    boxes = pd.DataFrame({"text": ["b", "a", "c", "d"], "top": [10, 12, 40, 41], "left": [50, 5, 5, 60], "bottom": [20, 22, 50, 51], "right": [60, 15, 15, 70]})
    assert layout.order_boxes(boxes) == ["a b", "c d"]


def test_columns(spark):
    words = spark.createDataFrame([(1, float(x), float(x + 10), 200.0) for x in (0, 5, 9, 120, 130, 140)] + [(2, 0.0, 9.0, 200.0), (2, 150.0, 160.0, 200.0)], "page_id int, x0 double, x1 double, width double")
    assert sorted(r["side"] for r in layout.columns(words).where("page_id = 1").collect()) == ["L"] * 3 + ["R"] * 3
    assert {r["side"] for r in layout.columns(words).where("page_id = 2").collect()} == {"L"}


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_readers():
    w = 'xmlns:w="urn:w"'
    docx = zipped(**{"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>", "word/_rels/document.xml.rels": '<R><Relationship Type="x/hyperlink" Target="http://a" TargetMode="External"/></R>'})
    assert readers.text_of("Docx", docx) == ("One\nTwo", ["http://a"], [], None)
    odt = zipped(**{"content.xml": '<o xmlns:t="urn:t"><t:h>Head</t:h><t:p>Body</t:p></o>'})
    assert readers.text_of("Odt", odt)[0] == "Head\nBody"
    assert readers.text_of("Abw", gzip.compress(b"<a><p>x</p><p>y</p></a>"))[0] == "x\ny"
    assert readers.text_of("Rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par \'e1 \u269?x}")[0] == "Hello\ná čx"
    assert readers.text_of("Markdown", b"# T\n\n**b** [l](http://x) `c`")[:2] == ("T\n\nb l c", ["http://x"])
    assert readers.text_of("Html", b"<p style='display: none'>no</p><p>a<b>b</b></p><pre> k  k</pre><script>x</script><a href='javascript:x'>j</a><a href='http://Q'>q</a>") == ("a b\n\nk  k\nj q", ["http://Q"], [], None)
    assert readers.text_of("Doc", b"\x00\x01" + b"Readable text of a good length" + b"\x02short\x03")[0] == "Readable text of a good length"
    assert readers.text_of("Wps", b"x")[3] == "unsupported_format" and readers.text_of("Docx", b"junk")[3] == "unreadable" and readers.text_of("PlainText", b" ")[3] == "empty_text"


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "cp1250"])
def test_encodings(name):
    assert readers.decode("Žltý kôň – súčasnosť".encode(name)) == "Žltý kôň – súčasnosť"


def test_files_to_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Jane Doe")
    (tmp_path / "b.html").write_text("<p>x</p>")
    (tmp_path / "c.json").write_text('{"work": []}')
    (tmp_path / "d.xyz").write_text("?")
    got = {r["path"][-5:]: (r["format"], r["text"], r["error"]) for r in readers.extract(formats.read_files(spark, f"file://{tmp_path}")).collect()}
    assert got == {"a.txt": ("PlainText", "Jane Doe", None), ".html": ("Html", "x", None), ".json": ("JsonResume", None, "unsupported_format"), "d.xyz": ("Unknown", None, "unsupported_format")}


def test_round_trip_of_json_resume(spark):
    text = "Jane Doe\njane@example.com\n\nWork Experience\nDev at Acme\n01/2019 - 02/2020\n\nSkills\nTools: Spark, Kafka\n\nLanguages\nEnglish: C1"
    cv = extract.import_texts(spark.createDataFrame([(1, text)], "cv_id int, text string"), "cv_id")
    again = structured.json_resume(cv.select("cv_id", writers.json_resume().alias("text"))).first()
    assert (again["personal"]["first_name"], again["personal"]["last_name"], again["personal"]["email"]) == ("Jane", "Doe", "jane@example.com")
    job = again["work"][0]
    assert (job["job_title"], job["company"], job["start_month"], job["start_year"], job["end_month"], job["end_year"]) == ("Dev", "Acme", 1, 2019, 2, 2020)
    assert again["skills"][0]["names"] == ["Spark", "Kafka"] and again["error"] is None
    xml = xml_rows.xml_cv(cv.select("cv_id", writers.xml(True).alias("text")), True).first()
    assert (xml["first_name"], xml["last_name"], xml["work"][0]["company"]) == ("Jane", "Doe", "Acme")
    assert xml_rows.xml_cv(spark.createDataFrame([(1, "<!DOCTYPE a><a/>"), (2, "<a")], "cv_id int, text string"), True).where("error = 'unreadable'").count() == 2


def test_ancestors(spark):
    nodes = spark.createDataFrame([(n, n - 1 if n else None) for n in range(9)], "id int, parent int")
    got = [(r["id"], r["ancestor"], r["depth"]) for r in trees.ancestors(nodes).collect()]
    assert len(got) == 36 and set(got) == {(i, j, i - j) for i in range(9) for j in range(i)}


def test_ways_up(spark):
    chain = [(n, n - 1 if n else None, "x") for n in range(1000)]
    circle = [(2000, 2002, "x"), (2001, 2000, "x"), (2002, 2001, "x"), (2003, 2000, "x")]
    odd = [(3000, 9999, "x"), (None, 5, "x"), (3001, None, "x")]
    nodes = spark.createDataFrame(chain + circle + odd, "id int, parent int, found string")
    got = {r["id"]: (r["found"], r["steps"]) for r in trees.first_up(nodes).collect()}
    assert got == {n: (0, n) for n in range(1000)} | dict.fromkeys(range(2000, 2004), (None, None)) | {3000: (3000, 0), 3001: (3001, 0)}
    near = {r["id"]: r["found"] for r in trees.first_up(nodes, stops=F.col("id") % 100 == 50).collect()}
    assert all(near[n] == ((n - 50) // 100 * 100 + 50 if n >= 50 else None) for n in range(1000)) and near[3000] is None
    assert trees.ancestors(nodes.where("id < 1000")).count() == 999 * 500
    with pytest.raises(ValueError):
        trees.ancestors(nodes)
    assert trees.ancestors(nodes.limit(0)).count() == trees.first_up(nodes.limit(0)).count() == 0


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"status": "a", "completed": 1, "total": 4}\nbroken\n{"status": "b"}\n')
    q = progress.read_feed(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName("feed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["status"] for r in spark.sql("select status from feed").collect()) == ["a", "b"]


def test_recovery(spark):
    df = spark.sql("select timestamp'2020-01-01' as p, timestamp'2020-01-02' as r")
    x = [progress.recovery(F.col("p"), F.col("r"), F.lit(True)), progress.recovery(F.col("r"), F.col("p"), F.lit(True)), progress.recovery(F.col("p"), F.col("r"), F.lit(False)), progress.recovery(F.col("p"), F.lit(None), F.lit(True))]
    assert list(df.select(*x).first()) == ["offer", "discard_stale", "discard_invalid", "none"]


def test_import_files(spark, tmp_path):
    (tmp_path / "cv.txt").write_text("Jane Doe\njane@example.com\n\nWork Experience\nDev at Acme\n01/2019 - 02/2020\n")
    (tmp_path / "cv.html").write_text("<p>Max Muster</p><p>max@example.com</p><a href='https://max.example'>me</a>")
    (tmp_path / "cv.json").write_text('{"basics": {"name": "Ann Lee"}, "work": [{"name": "B", "position": "C"}]}')
    (tmp_path / "cv.yaml").write_text("basics:\n  name: Yan Li\nwork:\n- company: D\n")
    (tmp_path / "cv.tsv").write_text("Name\tCity\nTom Ray\tBrno\n")
    (tmp_path / "cv.xml").write_text("<SkillsPassport><FirstName>Eva</FirstName><Surname>Mala</Surname></SkillsPassport>")
    (tmp_path / "own.dossier.json").write_text('{"dossierVersion": 1, "personal": {"first_name": "Own"}}')
    (tmp_path / "bad.docx").write_bytes(b"junk")
    (tmp_path / "empty.txt").write_text(" ")
    got = {r["path"].rsplit("/", 1)[1]: r for r in import_files(spark, f"file://{tmp_path}").collect()}
    names = {k: (r["format"], (r["personal"] or {"first_name": None})["first_name"], r["error"]) for k, r in got.items()}
    assert names == {
        "cv.txt": ("PlainText", "Jane", None), "cv.html": ("Html", "Max", None), "cv.json": ("JsonResume", "Ann", None), "cv.yaml": ("Yaml", "Yan", None), "cv.tsv": ("Csv", "Tom", None),
        "cv.xml": ("EuropassXml", "Eva", None), "own.dossier.json": ("OwnJson", "Own", None), "bad.docx": ("Docx", None, "unreadable"), "empty.txt": ("PlainText", None, "empty_text"),
    }
    assert got["cv.txt"]["work"][0]["company"] == "Acme" and got["cv.json"]["work"][0]["job_title"] == "C" and got["cv.html"]["links"][0]["url"] == "https://max.example"


def test_project_settings(spark):
    docs = spark.createDataFrame([("a", '{"dossierVersion": 1, "projectSettings": {"template": "x"}}'), ("b", '{"dossierVersion": 1, "projectSettings": {"template": "x", "odd": 1}}'), ("c", "{")], "path string, text string")
    got = {r["path"]: (r["settings"]["template"] if r["settings"] else None, r["partially_ignored"], r["malformed"]) for r in project(docs, "struct<template:string>").collect()}
    assert got == {"a": ("x", False, False), "b": ("x", True, False), "c": (None, False, True)}


def test_locales(spark):
    known = ("en", "sk", "zh-Hans", "zh-Hant", "pt-BR")
    assert ask(spark, lambda c: text.locale_of(c, known), "SK", "sk-SK", "zh-TW", "zh-CN", "pt-br", "xx") == ["sk", "sk", "zh-Hant", "zh-Hans", "pt-BR", "en"]
    assert ask(spark, text.ocr_languages, "sk-SK", "de") == ["eng+slk", "eng"]
    assert [tuple(x) for x in ask(spark, text.model_json, "```json\n{\"a\": 1}\n```", "no object")] == [('{"a": 1}', False), (None, True)]
