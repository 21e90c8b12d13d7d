from pyspark.sql import functions as F

from tarnwell.functions import markup
from tarnwell.operators import planning


def test_documents_survive_a_round_trip():
    fields = {"id": "7", "title": "A: b", "version": 2, "state": "Current", "labels": ["B", "a", "a "], "extra": {"k": '"v"', "id": "no"}}
    written = markup.format_document(fields, "Body\n")
    assert "state" not in written and "labels: [a, b]" in written
    again = markup.frontmatter(written)
    assert (again["id"], again["title"], again["version"], again["labels"], again["body"], again["error"]) == ("7", "A: b", 2, ["a", "b"], "Body\n", None)
    assert again["extra"] == {"k": '"v"'}


def test_links_are_unescaped_outside_code():
    assert markup.unescape_links(r"\[a\]\(b.md\) \(x\) `\[a\]\(b.md\)`") == r"[a](b.md) (x) `\[a\]\(b.md\)`"
    assert markup.unescape_links(r"\[a\]\(word\)") == r"\[a\](word)"
    assert markup.unescape_links("```\n\\(x\\)\n```") == "```\n\\(x\\)\n```"


def test_dates_are_guarded_outside_code_and_back():
    guarded = markup.guard_dates("on 2024-01-15, `2024-01-15`")
    assert guarded != "on 2024-01-15, `2024-01-15`" and "`2024-01-15`" in guarded
    assert markup.unescape_links(guarded) == "on 2024-01-15, `2024-01-15`"


def test_diagram_warnings_and_head(spark):
    docs = spark.createDataFrame([("a.md", "x\n```Mermaid\ngraph\n```\n```go\n```")], "path string, body string")
    assert [tuple(r) for r in planning.diagram_warnings(docs).collect()] == [("a.md", "MERMAID_PRESERVED_AS_CODEBLOCK", 3)]
    files = spark.createDataFrame([("a", "---\nid: 1\n---\n" + "b" * 9000), ("b", "---\nid: 1\n" + "# c\n" * 3000 + "---\n")], "path string, content string")
    assert {r["path"]: r["fm"]["error"] for r in planning.head_frontmatter(files).collect()} == {"a": None, "b": "unclosed frontmatter"}
    fm = planning.without_authors(files.withColumn("fm", markup.parse_frontmatter(F.lit("---\nid: 1\ncreated_by: x\n---\n")))).first()["fm"]
    assert fm["id"] == "1" and fm["created_by"] == ""


def test_paths_that_leave_their_root(spark):
    rows = spark.createDataFrame([("a/../b",), ("../a",), ("a/../../b",), ("/a",), ("..a",)], "path string")
    assert [r[0] for r in rows.coalesce(1).select(planning.is_below(F.col("path"))).collect()] == [True, False, False, False, True]


def test_names_in_plans(spark):
    remote = spark.createDataFrame([("1", "current", 5), ("2", "archived", 1)], "page_id string, status string, version int")
    changed = spark.createDataFrame([("a", "M", "1", 4), ("b", "M", "2", 9), ("c", "M", "3", 1), ("d", "A", "", 0), ("e", "D", "3", 1)], "path string, code string, page_id string, version int")
    assert {r["path"]: r["error"] for r in planning.push_conflicts(changed, remote).collect()} == {"a": "remote_ahead", "b": "archived", "c": "missing"}
    assert {r["path"] for r in planning.push_conflicts(changed, remote, force=True).collect()} == {"b", "c"}
