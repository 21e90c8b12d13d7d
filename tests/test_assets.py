import pytest

from tarnwell.operators import assets

FILES = ["docs/a.png", "docs/b b.pdf", "a.png", "assets/1/a.png", "assets/1/A-2.png", "assets/7/c.txt", "d/e/f.jpg", "assets/1/z-1-2.gif"]


def files(spark):
    return spark.createDataFrame([(p,) for p in FILES], "path string")


def test_references_and_their_faults(spark):
    bodies = {
        "docs/p.md": '![one](a.png) [two](b%20b.pdf#page=2 "T") <x> [md](other.md) ![pic](other.md) [site](https://x.y/a.png) [anchor](#a) `![no](a.png)`\n```\n![no](a.png)\n```\n[![inner](a.png)](<../a.png>)',
        "q.md": "[up](../x.png) [gone](nope.zip) [dir](d/e) [slash](./docs//a.png?raw=1)",
        "empty.md": None,
    }
    docs = spark.createDataFrame(list(bodies.items()), "path string, body string")
    got = sorted((r["path"], r["at"], r["target"], r["issue"]) for r in assets.references(docs, files(spark)).collect())
    assert got == [
        ("docs/p.md", 0, "docs/a.png", ""),
        ("docs/p.md", 1, "docs/b b.pdf", ""),
        ("docs/p.md", 3, "docs/other.md", "missing"),
        ("docs/p.md", 6, "a.png", ""),
        ("q.md", 0, "../x.png", "outside"),
        ("q.md", 1, "nope.zip", "missing"),
        ("q.md", 2, "d/e", "directory"),
        ("q.md", 3, "docs/a.png", ""),
    ]


def test_targets_one_after_the_other():
    assert assets.targets("1", ["a.png", "docs/a.png", "a.png"], set()) == ["assets/1/a.png", "assets/1/a-2.png", "assets/1/a.png"]
    assert assets.targets("1", ["x/A.png", "y/a.png", "z/a-2.png"], {"assets/1/A.png"}) == ["assets/1/A-2.png", "assets/1/a.png", "assets/1/a-2-2.png"]
    assert assets.targets("1", ["assets/1/a.png", "b/a.png"], {"assets/1/a.png"}) == ["assets/1/a.png", "assets/1/a-2.png"]
    assert assets.targets("1", ["x/noext", "y/.hidden"], {"assets/1/noext"}) == ["assets/1/noext-2", "assets/1/.hidden"]


def test_moves_under_the_page(spark):
    pages = [
        ("docs/p.md", "1", '![x](a.png "T") [y](<b b.pdf>) and ![x](a.png)'),
        ("q.md", "2", "![a](a.png) ![b](docs/a.png)"),
        ("stay.md", "7", "[c](assets/7/c.txt)"),
        ("bad.md", "8", "[c](assets/7/c.txt) [d](none.txt)"),
        ("new.md", " ", "![a](a.png)"),
        ("none.md", "9", None),
    ]
    got = {r["path"]: (r["body"], [(m["source"], m["target"]) for m in r["moves"]]) for r in assets.move_plan(spark.createDataFrame(pages, "path string, page_id string, body string"), files(spark)).collect()}
    assert got["docs/p.md"] == ('![x](../assets/1/a-2.png "T") [y](<../assets/1/b%20b.pdf>) and ![x](../assets/1/a-2.png)', [("docs/a.png", "assets/1/a-2.png"), ("docs/b b.pdf", "assets/1/b b.pdf")])
    assert got["q.md"] == ("![a](assets/2/a.png) ![b](assets/2/a-2.png)", [("a.png", "assets/2/a.png"), ("docs/a.png", "assets/2/a-2.png")])
    for path, _, body in pages[2:]:
        assert got[path] == (body, [])


def test_inline_media(spark):
    docs = spark.createDataFrame([("q.md", "see ![a](a.png) and [f](d/e/f.jpg), [c](assets/7/c.txt)"), ("bad.md", "![x](nope.png)"), ("n.md", None)], "path string, body string")
    ids = spark.createDataFrame([("a.png", 'at"1'), ("assets/7/c.txt", " "), ("d//e/f.jpg", "f")], "path string, attachment_id string")
    got = {r["path"]: r["body"] for r in assets.inline_media(docs, files(spark), ids).collect()}
    assert got["q.md"] == 'see [a.png]{.media-inline media-id="at\\"1" media-type="image"} and [f.jpg]{.media-inline media-id="f" media-type="image"}, [c.txt]{.media-inline media-id="pending-attachment-assets-7-c.txt" media-type="file"}'
    assert got["bad.md"] == "![x](nope.png)" and got["n.md"] is None


@pytest.mark.parametrize("name", ["references", "move_plan"])
def test_empty_tables(spark, name):
    empty = spark.createDataFrame([], "path string, page_id string, body string")
    assert getattr(assets, name)(empty, files(spark).limit(0)).count() == 0
