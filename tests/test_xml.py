"""XML read by rows: what is readable against a parser of the standard library, and texts of elements."""

from __future__ import annotations

import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from dossier.sources import xml_rows

GIVEN = [
    "<a/>", "<a></a>", " <a> x </a>\n", "<a>", "</a>", "<a></b>", "<a><b></a></b>", "<a/><b/>", "x<a/>", "<a/>x", "", "   ", "<a>&lt;&#233;&#x4e16;&#128512;&amp;amp;</a>", "<a>&nope;</a>", "<a>a & b</a>", "<a>&#0;</a>", "<a>&#xD800;</a>",
    "<?xml version='1.0'?><!-- <b> --><a><!-- & --><b>t</b></a>", "<a><![CDATA[<b>&nope;]]></a>", '<a b="1>2" c=\'"\'>x</a>', "<p:a xmlns:p='u'><p:b/></p:a>", "<a><b/>1<c>2</c>3</a>", "<a>\x01</a>", "< a/>", "<a>1 < 2</a>", "<a>1 > 2</a>", "<a><a><a>deep</a></a></a>",
]


def parsed(text):
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None


def read(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = xml_rows.elements(docs, "id", "text")
    tree = xml_rows.Tree(F.col("pieces"))
    root = F.get(F.filter("pieces", lambda p: p["kind"].isin("open", "empty")), F.lit(0))
    return {r["key"]: (r["readable"], r["value"]) for r in found.select("key", "readable", tree.value(root).alias("value")).collect()}


def test_readable_as_a_parser_says(spark):
    got = read(spark, GIVEN)
    for n, text in enumerate(GIVEN):
        root = parsed(text)
        assert got[n][0] == (root is not None), text
        if root is not None:
            assert got[n][1] == " ".join("".join(root.itertext()).split()), text


def test_varied_documents(spark):
    rng = random.Random(8)

    def made(depth):
        name = rng.choice(("a", "b", "x:c"))
        body = "".join(made(depth - 1) if depth and rng.random() < 0.5 else rng.choice(("t", " ", "&amp;", "<d/>", "<![CDATA[<]]>")) for _ in range(rng.randrange(4)))
        return f"<{name}>{body}</{name}>"

    texts = ['<r xmlns:x="u">' + made(4) + "</r>" for _ in range(60)]
    texts += [t.replace("</a>", "", 1) for t in texts[:30]] + [t[: rng.randrange(len(t))] for t in texts[:30]]
    got = read(spark, texts)
    for n, text in enumerate(texts):
        root = parsed(text)
        assert got[n][0] == (root is not None), text
        if root is not None:
            assert got[n][1] == " ".join("".join(root.itertext()).split()), text


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "<!DOCTYPE a><a/>"), (3, "<a>nothing known</a>")], "id int, text string")
    assert {r["id"]: r["error"] for r in xml_rows.xml_cv(docs, True, "id").collect()} == {1: "unreadable", 2: "unreadable", 3: "no_structured_data"}
    assert xml_rows.xml_cv(docs.limit(0), False, "id").count() == 0
