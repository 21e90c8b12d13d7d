import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import markup, text
from tarnwell.operators import changes, hierarchy, links, lint, search
from tarnwell.operators.search import SearchOptions
from tarnwell.sources import workspace

DOCS = [
    ("page:DEV/overview.md", "page", "DEV/overview.md", "Security Overview", "DEV", ["architecture", "security"], "OAuth2 protects the api with tokens", "", 0, "alice", "2024-01-15T09:00:00Z"),
    ("section:DEV/overview.md:5", "section", "DEV/overview.md", "Security Overview", "DEV", ["architecture", "security"], "token flow", "OAuth2 Flow", 5, "alice", "2024-03-20T10:00:00Z"),
    ("code:DEV/overview.md:12", "code", "DEV/overview.md", "Security Overview", "DEV", ["architecture", "security"], "func refresh token", "Token Refresh", 12, "bob", "2024-09-10T14:00:00Z"),
    ("page:OPS/deploy.md", "page", "OPS/deploy.md", "Deployment Guide", "OPS", ["ops"], "deploy the api, then refresh", "", 0, "charlie", ""),
]
SCHEMA = "id string, type string, path string, title string, space_key string, labels array<string>, content string, heading_text string, line int, created_by string, created_at string"


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({"page_id": F.lit("1"), "updated_by": F.col("created_by"), "updated_at": F.col("created_at")}).cache()


def ids(rows):
    return [r["id"] for r in rows.collect()]


def test_filters(index):
    found = lambda **k: ids(search.search(index, SearchOptions(**k)))
    assert len(found(space="DEV")) == 3 and found(space="OPS") == ["page:OPS/deploy.md"]
    assert len(found(labels=("security", "architecture"))) == 3 and found(labels=("security", "ops")) == []
    assert found(labels=("OPS",)) == []
    assert found(heading="oauth2 f%w") == ["section:DEV/overview.md:5"] and found(types=("code",)) == ["code:DEV/overview.md:12"]
    assert found(created_before="2024-01-15", types=("page",)) == ["page:DEV/overview.md", "page:OPS/deploy.md"]
    assert found(created_before="2024-01-15", typed_dates=True) == ["page:DEV/overview.md"]
    assert found(created_after="2024-03-01", typed_dates=False) == ["section:DEV/overview.md:5", "code:DEV/overview.md:12"]
    assert len(found(created_before="nonsense", typed_dates=True)) == 4
    with pytest.raises(ValueError):
        search.search(index, SearchOptions())


def test_ranking_agrees_with_sqlite(index):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, content, heading_text, tokenize = 'porter unicode61')")
    for i, d in enumerate(DOCS, 1):
        db.execute("insert into t(rowid, title, content, heading_text) values (?, ?, ?, ?)", (i, d[3], d[6], d[7]))
    for query in ("token", "api refresh", "security tokens", "refreshing"):
        want = [(DOCS[i - 1][0], round(s, 9)) for i, s in db.execute("select rowid, rank from t where t match ? order by rank", (query,))]
        got = [(r["id"], round(r["score"], 9)) for r in search.search(index, SearchOptions(query=query), stemmed=True).collect()]
        assert sorted(got) == sorted(want), query
    assert ids(search.search(index, SearchOptions(query="tokens deploy", any_word=True))) != []
    assert search.search(index, SearchOptions(query="tok")).count() == 0


def test_facets_projection_upsert(index):
    assert {r[0] for r in search.facet_labels(index).collect()} == {"architecture", "security", "ops"}
    assert {r[0] for r in search.facet_spaces(index).collect()} == {"DEV", "OPS"}
    assert search.paths(index).count() == 2 and search.paths(index, "DEV").count() == 1
    assert search.project(index.withColumn("score", F.lit(1.0)), "minimal").columns == ["path", "title", "score"]
    new = index.where("path = 'OPS/deploy.md'").withColumn("title", F.lit("New"))
    once = search.upsert(index, new)
    assert Counter(map(str, search.upsert(once, new).collect())) == Counter(map(str, once.collect()))
    assert search.delete_paths(index, new).count() == 3
    assert search.postings(index).where("term = 'token'").count() == 2


def test_merge_and_changed(spark):
    feed = spark.createDataFrame([(1, "", "", 1, 10, 0), (1, "K", "t", 3, 5, 1), (1, "L", "u", 2, 20, 2), (2, "", "", 1, 1, 3)], "page_id long, space_key string, title string, version int, last_modified long, seq long")
    got = {r["page_id"]: tuple(r) for r in changes.merge_changes(feed).collect()}
    assert got == {1: (1, "K", "t", 3, 20), 2: (2, "", "", 1, 1)}
    remote = spark.createDataFrame([(1, 3), (2, 1), (4, 5)], "page_id long, version int")
    local = spark.createDataFrame([(1, 3), (2, None), (3, 1)], "page_id long, version int")
    state = {r["page_id"]: (r["state"], r["drift"]) for r in changes.status(remote, local).collect()}
    assert state == {1: ("same", 0), 2: ("modified", 1), 3: ("deleted", 0), 4: ("added", 0)}


def tree(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, parent_id string, kind string")


def test_paths_cycles_and_orphans(spark):
    rows = [("f", "Folder", "", "folder"), ("a", "A b", "f", "page"), ("b", "Child", "a", "page"), ("c", "Lost", "gone", "page"), ("x", "X", "y", "page"), ("y", "Y", "x", "page")]
    got = {r["page_id"]: r["path"] for r in hierarchy.planned_paths(tree(spark, rows)).collect()}
    assert got == {"a": "Folder/A-b/A-b.md", "b": "Folder/A-b/Child.md", "c": "Lost.md", "x": "X/X.md", "y": "Y/Y.md"}
    assert [r["path"] for r in hierarchy.folder_paths(tree(spark, rows)).collect()] == ["Folder"]


def test_stems_stay_near_the_word():
    ends = "s es ies ed ing eed y e ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize ll".split()
    for root in "a be cat hop fil conflat relat sens happ troubl licens vers oper commun gener univers x1".split():
        for end in ends:
            for word in (root + end, *(root + end + more for more in ("s", "ed", "ing", "ly", "ness"))):
                stem = markup.stem(word)
                assert word.startswith(stem[: max(1, len(stem) - 3)]), (word, stem)


def test_trees_of_any_depth(spark):
    rows = [(f"k{i}", f"T{i}", f"k{i - 1}" if i else "", "page") for i in range(150)]
    got = {r["page_id"]: r["path"] for r in hierarchy.planned_paths(tree(spark, rows)).collect()}
    assert got["k149"] == "/".join(f"T{i}" for i in range(149)) + "/T149.md" and got["k0"] == "T0/T0.md"
    ring = [(f"r{i}", "R", f"r{(i + 1) % 37}", "page") for i in range(37)] + [("tail", "Tail", "r5", "page"), ("own", "Own", "own", "page")]
    assert not any(r["complete"] for r in hierarchy.ancestors(tree(spark, ring)).collect())


def test_parents_by_kind_and_blank_titles(spark):
    rows = [("1", "Folder one", "", "folder", ""), ("1", " ", "", "page", ""), ("2", "In folder", "1", "page", "folder"), ("3", "In page", "1", "page", ""), ("4", "", "3", "page", "page"), ("5", "", "1", "folder", "")]
    nodes = spark.createDataFrame(rows, "id string, title string, parent_id string, kind string, parent_kind string")
    got = {r["page_id"]: r["path"] for r in hierarchy.planned_paths(nodes).collect()}
    assert got == {"1": "page-1/page-1.md", "2": "Folder-one/In-folder.md", "3": "page-1/In-page/In-page.md", "4": "page-1/In-page/page-4.md"}
    assert {r["path"] for r in hierarchy.folder_paths(nodes).collect()} == {"Folder-one", "Folder-one/folder-5"}


def test_segments_are_cut_by_bytes(spark):
    titles = ["é" * 60, "x" + "é" * 60, "a" * 99 + "-b", "a" * 120, "漢" * 40]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r[0] for r in df.select(text.path_segment(F.col("t"))).collect()]
    assert got == ["é" * 50, "x" + "é" * 49, "a" * 99, "a" * 100, "漢" * 33]


def test_allocated_paths_are_unique(spark):
    planned = spark.createDataFrame([("1", "a.md"), ("2", "a.md"), ("3", "a-2.md"), ("4", "d/a.md"), ("5", "a.md")], "page_id string, path string")
    got = {r["page_id"]: r["path"] for r in hierarchy.allocate_paths(planned).collect()}
    assert len(set(got.values())) == 5 and got["1"] == "a.md" and got["4"] == "d/a.md"


def allocated_in_order(rows):
    """One page after the other, by path and id: the first name that is free."""
    taken, out = set(), []
    for page, path in sorted(rows, key=lambda x: (x[1], x[0])):
        name, k = path, 1
        while name in taken:
            k += 1
            name = f"{path.removesuffix('.md')}-{k}.md"
        taken.add(name)
        out.append((page, name))
    return sorted(out)


def test_allocated_paths_match_one_after_the_other(spark):
    rng = random.Random(5)
    for size in (1, 40, 400):
        stems = ["a", "a-2", "a-3", "a-2-2", "a-10", "a-02", "b", "b-1", "d/a", "d/a-4", "é", "a-99999999999999999999"]
        rows = [(f"{rng.randrange(10**6)}-{i}", f"{rng.choice(stems[: 4 + size % 9])}.md") for i in range(size)]
        planned = spark.createDataFrame(rows, "page_id string, path string")
        assert sorted(map(tuple, hierarchy.allocate_paths(planned).collect())) == allocated_in_order(rows)
    hot = [(f"{i:05}", "untitled.md") for i in range(3000)] + [(f"x{i}", f"untitled-{i}.md") for i in range(2, 4000, 3)]
    got = hierarchy.allocate_paths(spark.createDataFrame(hot, "page_id string, path string")).collect()
    assert sorted(map(tuple, got)) == allocated_in_order(hot)
    assert hierarchy.allocate_paths(spark.createDataFrame([], "page_id string, path string")).count() == 0


def test_nearest_parents(spark):
    pages = spark.createDataFrame([("a/b/c.md",), ("a/x.md",), ("z.md",), ("a/b/b.md",)], "path string")
    index = spark.createDataFrame([("a", "1"), ("a/b", "2")], "directory string, id string")
    got = {r["path"]: r["parent"] for r in hierarchy.nearest_parents(pages, index).collect()}
    assert got == {"a/b/c.md": "2", "a/x.md": "1", "z.md": "", "a/b/b.md": "1"}


def test_link_rewriting(spark):
    docs = spark.createDataFrame([("a/p.md", "[x](old#s) ![i](<old>) `[x](old)`", {"old": "b/new page.md"}), ("q.md", None, {})], "path string, body string, targets map<string,string>")
    got = {r["path"]: (r["body"], r["converted"]) for r in links.rewrite(docs).collect()}
    assert got["a/p.md"] == ("[x](../b/new%20page.md#s) ![i](<../b/new%20page.md>) `[x](old)`", 2)
    totals = links.relink_totals(links.rewrite(docs)).first()
    assert (totals["files"], totals["changed"], totals["links"]) == (2, 1, 2)


def test_lint_rules(spark):
    pages = spark.createDataFrame([("a", "1", 0, "weird", ["x y", " "]), ("b", "", None, None, []), ("c", "2", 1, " Draft ", None)], "path string, id string, version int, state string, labels array<string>")
    got = sorted((r["path"], r["field"], r["code"]) for r in lint.schema_issues(pages).collect())
    assert got == [("a", "labels", "empty"), ("a", "labels", "invalid"), ("a", "state", "invalid"), ("a", "version", "invalid")]
    titles = spark.createDataFrame([("d/a.md", "T"), ("d/b.md", "t"), ("d/c.md", "t"), ("e/a.md", "T")], "path string, title string")
    assert {tuple(r) for r in lint.sibling_titles(titles).collect()} == {("d/a.md", "d/b.md"), ("d/b.md", "d/a.md"), ("d/c.md", "d/a.md")}


def test_errors_are_rows_where_the_scan_says_so(spark):
    good = "---\nid: 1\ntitle: T\n---\n[x](gone.md) ![i](none.png)"
    rows = [("a.md", good.encode()), ("b.md", b"\xff---\n---\n"), ("c.md", b"no frontmatter"), ("d.md", None), ("e.md", b"---\nid: 5\n---\n[a](a.md#s) [b](x.txt)")]
    files = spark.createDataFrame(rows, "path string, content binary")
    found = {r["path"]: r["error"] for r in workspace.read_documents(files, workspace.SCANS["validate"]).collect()}
    assert found["a.md"] == found["e.md"] == "" and found["b.md"] == found["d.md"] == "not readable as UTF-8" and found["c.md"]
    assert [r["path"] for r in workspace.read_documents(files, workspace.SCANS["search"]).collect()] == ["a.md", "e.md"]
    with pytest.raises(Exception, match=r"\.md: "):
        workspace.read_documents(files, workspace.SCANS["relink"]).collect()
    pages = spark.createDataFrame([("a.md", "1")], "path string, page_id string")
    there = spark.createDataFrame([("x.txt",)], "path string")
    got = {(r["path"], r["code"], r["message"]) for r in lint.file_issues(workspace.read_documents(files, workspace.SCANS["validate"]), there, pages, pages).collect()}
    assert {g[:2] for g in got} == {("a.md", "conversion_error"), ("b.md", "read_error"), ("c.md", "read_error"), ("d.md", "read_error")}
    assert ("a.md", "conversion_error", "unresolved: gone.md") in got


def test_doctor_tells_unreadable_files(spark):
    state = spark.createDataFrame([("a.md", "1"), ("b.md", "2"), ("c.md", "3")], "path string, page_id string")
    files = spark.createDataFrame([("a.md", "1", "text", ""), ("b.md", None, None, "not readable as UTF-8")], "path string, page_id string, body string, error string")
    got = {(r["path"], r["kind"], r["severity"]) for r in lint.doctor(state, files).collect()}
    assert got == {("b.md", "unreadable-file", "error"), ("c.md", "missing-file", "error")}


def test_scan_rules(spark):
    paths = ["a.md", "b.MD", "assets/c.md", ".git/d.md", "x/assets/e.md", "f.txt", ".hidden.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    taken = lambda rule: [r[0] for r in rows.where(workspace.takes(F.col("path"), workspace.SCANS[rule])).collect()]
    assert taken("search") == ["a.md", "b.MD", ".hidden.md"]
    assert taken("page_index") == ["a.md", ".hidden.md"]
    assert taken("relink") == ["a.md", "assets/c.md", "x/assets/e.md", ".hidden.md"]
