import base64
import sqlite3
import zlib

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import markup, text


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.coalesce(1).orderBy("i").select(f(F.col("x"))).collect()]


def test_path_segment(spark):
    inputs = ["Plain", " a/b:c ", "..x.. ", "", "con", "LPT1.txt", "a  -  b", "x" * 150, "é?é"]
    want = ["Plain", "a-b-c", "x", "untitled", "con-item", "LPT1.txt-item", "a-b", "x" * 100, "é-é"]
    assert values(spark, text.path_segment, inputs) == want
    assert values(spark, text.path_segment, [w for w in want if "item" not in w]) == [w for w in want if "item" not in w]
    assert values(spark, text.markdown_name, ["A b", "x.MD"]) == ["A-b.md", "x.MD"]


def test_space_directory(spark):
    rows = spark.createDataFrame([("My  Space", "DEV"), ("", "K"), ("N", ""), ("con", "A/B")], "n string, k string")
    got = [r[0] for r in rows.coalesce(1).select(text.space_directory(F.col("n"), F.col("k"))).collect()]
    assert got == ["My Space (DEV)", "K", "N", "con-item (A-B)"]
    assert values(spark, text.key_of_directory, ["a/My Space (DEV)", "plain"]) == ["DEV", "plain"]


def test_labels(spark):
    rows = spark.createDataFrame([([" B", "a", "b", "", "\tA "],), (None,)], "x array<string>")
    assert [r[0] for r in rows.coalesce(1).select(text.labels(F.col("x"))).collect()] == [["a", "b"], []]


def test_dates(spark):
    assert values(spark, text.stored_date, ["2024-01-15", "2024-01-15T10:00:00+02:00", "2024-01-15T10:00:00Z", "soon", ""]) == ["2024-01-15T00:00:00Z", "2024-01-15T08:00:00Z", "2024-01-15T10:00:00Z", "soon", ""]
    assert text.date_bound_value("2024-01-15", True) == "2024-01-15T23:59:59Z" and text.date_bound_value("x", True) == "x"


def test_urls_and_paths(spark):
    assert values(spark, text.page_id_of_url, ["https://x/wiki/pages/viewpage.action?pageId=12", "https://x/wiki/spaces/K/pages/34/T", "https://x/y", "/pages/5"]) == ["12", "34", "", "5"]
    assert values(spark, text.space_key_of_url, ["https://x/wiki/spaces/K/pages/34/T", "/wiki/spaces/K/pages/3"]) == ["K", ""]
    assert values(spark, text.clean_path, ["./a//b/../c", "..", "", "a\\b", "../a", "a/../../b"]) == ["a/c", "..", "", "a/b", "../a", "../b"]
    assert values(spark, text.percent_encode, ["a b/c+d"]) == ["a%20b/c%2Bd"]
    assert values(spark, text.percent_decode, ["a%20b+c", "%zz"]) == ["a b+c", "%zz"]
    assert values(spark, text.destination, ['<a b> "t"', "x.md 'title'", ' "q" ']) == ["a b", "x.md", "q"]
    assert values(spark, text.is_external, ["", "#a", "HTTPS://x", "a.md", "//cdn"]) == [True, True, True, False, True]
    assert values(spark, text.owner_of_asset, ["assets/12/a.png", "assets/a.png", "x/assets/1/b"]) == ["12", None, None]
    assert values(spark, text.is_image, ["a.PNG", "b.md", "c.apng"]) == [True, False, False]


def test_pending_titles_and_markers(spark):
    assert values(spark, lambda c: text.pending_id("page", c), ["A b/C.md"]) == ["pending-page-a-b-c.md"]
    assert values(spark, lambda c: text.local_title(F.lit(" "), c, F.lit("d/stem.md")), ["x\n# Head \n", "none"]) == ["Head", "stem"]
    assert values(spark, text.has_conflict_marker, ["a\n =======\n", "a == b"]) == [True, False]
    assert values(spark, text.lifecycle, [" Draft ", "", None]) == ["draft", "current", "current"]


@pytest.mark.parametrize(
    ("query", "words"),
    [("POST /v2/events", "POST v2 events"), ("Onboarding to On-Call guide", "Onboarding to On Call guide"), ("auth:token (refresh)", "auth token refresh"), ('"v2.0" endpoint', "v2 0 endpoint"), ("api_events_v2", "api events v2")],
)
def test_query_terms(query, words):
    assert " ".join(text.query_terms(query)) == words


def test_queries_without_words_are_refused():
    with pytest.raises(ValueError):
        text.query_terms("/-()")


def test_stems_agree_with_sqlite():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubling sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll refreshing tokens authentication".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize = 'porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    for i, w in enumerate(words, 1):
        db.execute("insert into t(rowid, x) values (?, ?)", (i, w))
    want = dict(db.execute("select doc, term from v").fetchall())
    assert {w: markup.stem(w) for w in words} == {w: want[i] for i, w in enumerate(words, 1)}


def test_frontmatter():
    got = markup.frontmatter("﻿---\nid: 12\ntitle: 'A b'\nlabels: [x, Y]\nversion: 3\nextra_key: v\n---\nBody\n---\n")
    assert (got["id"], got["title"], got["labels"], got["version"], got["error"]) == ("12", "A b", ["x", "Y"], 3, None)
    assert got["extra"] == {"extra_key": '"v"'} and got["body"] == "Body\n---\n"
    assert markup.frontmatter("x")["error"] and markup.frontmatter("---\nid: 1")["error"]
    assert markup.frontmatter("---\nlabels:\n- a\n- b\n---\n")["labels"] == ["a", "b"]


def test_structure():
    body = "# One\nintro\n## Two ##\n```go\nx := 1\n# no heading\n```\ntext\n### Three\n## Four\nUnder\n=====\nend\n```\n```"
    got = markup.structure(body)
    assert [(s["heading"], s["level"], s["line"]) for s in got["sections"]] == [("One", 1, 1), ("Two", 2, 3), ("Three", 3, 9), ("Four", 2, 10), ("Under", 1, 11)]
    assert got["sections"][2]["path"] == ["One", "Two", "Three"] and got["sections"][0]["content"] == "intro"
    assert [(c["language"], c["code"], c["heading"], c["line"]) for c in got["code"]] == [("go", "x := 1\n# no heading", "Two", 5), ("", "", "Under", 15)]
    assert markup.structure("") == {"sections": [], "code": []}


def test_links():
    body = "[a](b.md) `[no](x)` ![i](p (1).png)\n```\n[no](y)\n```\n[n [m]](c.md 't') \\[e](z)"
    got = markup.links(body)
    assert [(x["text"], x["destination"], x["image"]) for x in got] == [("a", "b.md", False), ("i", "p (1).png", True), ("n [m]", "c.md 't'", False)]
    assert all(body[x["start"] : x["end"]] == x["destination"] for x in got)


def test_structure_inside_containers():
    body = """> # Quoted
> ```sql
> SELECT 1
>   FROM t
> ```
> lazy
goes on

- item
  ## In item
  ```py
  x = 1
    y
  ```
  after
1. one

   ~~~
   deep
   ~~~

      not code, three more than the item

text

    indented # no heading
    ``` no fence

para
    ``` not code either
=====
> ```
> closed by the end of the quote
out
***
[ref]: x.md
Two
lines
---
"""
    got = markup.structure(body)
    assert [(s["heading"], s["level"], s["line"]) for s in got["sections"]] == [("Quoted", 1, 1), ("In item", 2, 10), ("para ``` not code either", 1, 29), ("Two lines", 2, 37)]
    assert [(c["language"], c["code"], c["heading"], c["line"]) for c in got["code"]] == [
        ("sql", "SELECT 1\n  FROM t", "Quoted", 3),
        ("py", "x = 1\n  y", "In item", 12),
        ("", "deep", "In item", 19),
        ("", "closed by the end of the quote", "para ``` not code either", 33),
    ]
    assert markup.structure("- a\n\n```\nx\n```")["code"][0]["code"] == "x"
    assert [s["heading"] for s in markup.structure("a\n-\nb\n- - -\n#\n####### seven\n\\# no")["sections"]] == ["a", ""]


def test_links_over_lines_and_in_containers():
    body = "code `span\n[no](x)` end [two\nlines](a.md)\n\n`open [yes](b.md)\n\n> [q](c.md)\n> ```\n> [no](d)\n> ```\n\n    [no](e)\n\n- [i](f.md)\n\n  ~~~\n  [no](g)\n  ~~~\n[x](<a (b>) ``[no](h) ` `` [never\n\nclosed](i)"
    got = markup.links(body)
    assert [x["destination"] for x in got] == ["a.md", "b.md", "c.md", "f.md", "<a (b>"]
    assert all(body[x["start"] : x["end"]] == x["destination"] for x in got)


def test_reference_links():
    body = "[One][a], [a] and ![img][] but [missing], [inline](x.md) `[a]` [a]: no\n\n[A]: <one two.md> 'T'\n[img]: i.png\n[a]: second.md\n\n```\n[missing]: y\n```"
    got = markup.reference_links(body)
    assert [(x["text"], x["destination"], x["image"]) for x in got] == [("One", "<one two.md>", False), ("a", "<one two.md>", False), ("img", "i.png", True)]
    assert all(body[x["start"] : x["end"]] == x["destination"] for x in got)


def test_media_and_diagrams():
    assert markup.media_references('{"content":[{"type":"media","attrs":{"id":"7"}},{"type":"p"}]}') == [{"id": "7", "file": ""}]
    assert markup.media_references("not json") == []
    packed = zlib.compress(b"A -> B")
    assert markup.diagram(base64.b64encode(packed).decode()) == markup.diagram(base64.b64encode(packed[2:-4]).decode()) == "A -> B"


def test_snippet():
    assert markup.snippet("a b c d e f g h i j k hit, m", frozenset(["hit"])) == "...c d e f g h i j k [hit,]..."
