import time
from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

import numpy as np

from tarnwell.llm import html_text as h

SCHEMA = "page_id long, url string, html string, host string, text string, lines string, main string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</ul></nav>
<div class="ad banner">Buy</div><div id=cookie-notice>We use cookies</div><article><header><h1>Title &amp; more</h1></header><p><b>One  two
three.<br>four<p>Second&nbsp;para &#233;<aside>Side</aside><ul><li>a<li>b</ul><form>Mail <input></form><script>x<y</script>
<section class="comments"><p>Nice</p></section></article><footer>&copy; x</footer></body></html>""".format()


def alone(html, rules=True):
    return h.main_text(*h.units_of(h.lines_of(html)), None, rules)[0]


def test_article_alone_is_text():
    assert alone(PAGE) == "Title & more\nOne two three. four\nSecond para é\na\nb"


def test_broken_and_empty_pages():
    assert h.lines_of(None) == [] and h.lines_of("") == [] and h.lines_of("<p") == []
    assert alone("<article><p>cut off in the mid") == "cut off in the mid" and alone("<p>a <a href='x") == "a"
    assert alone("plain text\n only") == "plain text only"
    assert alone("</div></p>x<div><div><p>y") == "x\ny"
    assert alone("a < b <3 <!-- <p>no --> c<!--> d<!x> e<?y?> f</> g") == "a < b <3 c d e f g"
    assert alone("<p title='a > b' class=x>one<script>if (a<b) '</p>'</SCRIPT >two<textarea><p>no</textarea>") == "onetwo"
    assert alone("<P>one<BR/>two</P><svg/>three<title>no") == "one two\nthree"


def test_long_and_broken_pages_take_linear_time():
    began = time.perf_counter()
    for html in ("<b>" * 100_000 + "</i>" * 100_000, "<a " * 300_000, "<a " * 300_000 + ">x", '<a "' * 200_000 + ">", "<p>" * 200_000, "<ul><li>" * 50_000 + "<li>" * 50_000, "<!--" * 200_000, "<div class='a'>" * 60_000 + "x", "<" * 500_000, "<script>" * 100_000, "&amp" * 200_000):
        h.lines_of(html)
    assert time.perf_counter() - began < 12


def lcs(a, b):
    for n in range(min(len(a), len(b)), -1, -1):
        for pick in combinations(range(len(a)), n):
            it = iter(b)
            if all(a[i] in it for i in pick):
                return n


def test_common_lines_match_brute_force():
    random = np.random.default_rng(6)
    for _ in range(60):
        a, b = (["abcd"[i] for i in random.integers(0, 4, random.integers(0, 8))] for _ in range(2))
        found = sorted(h.shared_lines(a, b))
        it = iter(b)
        assert all(a[i] in it for i in found) and len(found) == lcs(a, b)


def test_long_pages_align_exactly(monkeypatch):
    a = [x for i in range(700) for x in (f"own {i}", "Reply")]
    b = [x for i in range(700) for x in (f"other {i}", "Reply")]
    assert h.shared_lines(a, b) == {2 * i + 1 for i in range(700)}
    monkeypatch.setattr(h, "TABLE", 4)
    random = np.random.default_rng(9)
    for _ in range(60):
        a, b = (["abcd"[i] for i in random.integers(0, 4, random.integers(0, 9))] for _ in range(2))
        found = sorted(h.shared_lines(a, b))
        it = iter(b)
        assert all(a[i] in it for i in found) and len(found) == lcs(a, b)


def page(i, body):
    return f"<html><body><div>Site name</div><div>Daily news</div><p>{body}</p><div>Terms of use</div></body></html>"


def test_differencing_deletes_what_neighbours_share(spark):
    rows = [(i, f"https://www.x.org/news/{i}?q=1", page(i, f"Story {i}")) for i in range(20)]
    rows += [(100, "http://y.org/a", page(1, "Alone")), (101, "http://z.org/a", None), (102, None, "<p>No url"), (103, "not a url", "")]
    rows += [(200, "http://c.org/1", page(1, "Copy")), (200, "http://c.org/1", page(1, "Copy")), (201, "http://c.org/1", page(1, "Copy"))]
    got = h.extract(table(spark, rows).coalesce(1)).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    by_id = {r["page_id"]: r for r in got}
    assert all(by_id[i]["text"] == f"Story {i}" and by_id[i]["n_shared"] == 3 for i in range(20))
    assert by_id[100]["text"].split("\n") == ["Site name", "Daily news", "Alone", "Terms of use"]
    assert by_id[101]["text"] == "" and by_id[101]["n_chars"] == 0 and by_id[102]["text"] == "No url"
    assert "Copy" in by_id[200]["text"] and all(r["n_chars"] == len(r["text"]) for r in got)


def nearest_differing(rows):
    """Texts by page, from one sorted list."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    units = [h.units_of(h.lines_of(r[2])) for r in rows]
    path = lambda k: rows[k][1].partition("org")[2]
    out = {}
    for k, r in enumerate(rows):
        host = lambda j: rows[j][1].partition("org")[0]
        near = [next((j for j in way if host(j) == host(k) and units[j][1] != units[k][1]), None) for way in (range(k - 1, -1, -1), range(k + 1, len(rows)))]
        near = [j for j in near if j is not None]
        other = max(near, key=lambda j: h._common(path(k), path(j)), default=None)
        out[r[0]] = h.main_text(*units[k], None if other is None else units[other][1])[0]
    return out


def test_copies_and_partition_edges_find_the_nearest_differing_page(spark):
    rows = [(i, f"http://x.org/{i:03}", page(i, f"Story {i // 7 if i % 50 < 30 else i}")) for i in range(200)]
    rows += [(300 + i, f"http://y.org/{i:03}", page(i, "Same")) for i in range(60)] + [(400, "http://y.org/a", page(1, "Last"))]
    df = table(spark, rows)
    want = nearest_differing(rows)
    for partitions in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = h.extract(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want
    assert all(want[i] == "Same" for i in range(300, 360)) and want[400] == "Last"


def test_articles_keep_lines_that_neighbours_share(spark):
    rows = [(i, f"http://x.org/{i}", f"<nav>m{i}</nav><article><h1>Same</h1><p>own {i}</article>") for i in range(4)]
    got = h.extract(table(spark, rows)).collect()
    assert {r["text"] for r in got} == {f"Same\nown {i}" for i in range(4)}


def test_differencing_alone_finds_the_article(spark):
    """Without the rules and without names of furniture: places that neighbours share go, whatever they say."""
    random = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in random.integers(0, 9999, n))
    rows, want = [], {}
    for i in range(60):
        menu = "".join(f"<li>{words(1)}" for _ in range(random.integers(2, 9)))
        paragraphs = [words(30) for _ in range(random.integers(1, 6))]
        want[i] = "\n".join(paragraphs)
        rows.append((i, f"http://x.org/{i % 5}/{i}", f"<div class=q{i}><ul>{menu}</ul></div><div>{words(5)}</div><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article><div class=z>{words(3)}</div>"))
    rows.append((100, "http://alone.org/", rows[0][2]))
    got = {r["page_id"]: r for r in h.extract(table(spark, rows), rules=False).collect()}
    assert all(got[i]["text"] == want[i] and got[i]["n_shared"] == 3 for i in range(60))
    assert got[100]["text"] != want[0] and got[100]["n_shared"] == 0  # no neighbour: only the rules tell
    ruled = {r["page_id"]: r for r in h.extract(table(spark, rows)).collect()}
    assert all(ruled[i]["text"] == want[i] and ruled[i]["n_ruled"] == 0 for i in range(60))
    assert ruled[100]["text"] == want[0] and ruled[100]["n_ruled"] == 3


class Article(HTMLParser):
    """An extraction of its own, by the standard library: blocks of text inside article elements."""

    BLOCKS = frozenset("article h1 h2 h3 p ul ol li div section table tr td blockquote pre".split())

    def __init__(self, html):
        super().__init__()
        self.depth, self.blocks, self.now = 0, [], ""
        self.feed(html)
        self.end_block()

    def end_block(self):
        if text := " ".join(self.now.split()):
            self.blocks.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end_block()
        self.depth += tag == "article"
        self.now += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end_block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now += data


def test_whole_table_against_an_extraction_by_the_standard_library(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: "\n".join(Article(r["html"] or "").blocks) for r in pages.collect()}
    for rules in (True, False):
        got = h.extract(pages, rules=rules).collect()
        assert {r["page_id"]: r["text"] for r in got} == want
        assert all(r["n_shared"] >= 3 and not r["n_ruled"] for r in got if r["text"])


def test_differencing_decides_before_the_rules(spark):
    def site(i, more=""):
        return f"<ul><li>Home {i}<li>About</ul><div class=k>Nothing named {i}</div><div><p>Story {i}<p>end of {i}</div><p>All rights</p>{more}"

    rows = [(i, f"http://x.org/{i}", site(i, "<nav>only here</nav>" if i == 2 else "")) for i in range(5)] + [(9, "http://y.org/", site(9))]
    got = {r["page_id"]: r for r in h.extract(table(spark, rows)).collect()}
    assert got[9]["text"] == "Home 9\nAbout\nNothing named 9\nStory 9\nend of 9\nAll rights" and got[9]["n_shared"] == 0
    assert got[0]["text"] == "Home 0\nNothing named 0\nStory 0\nend of 0" and got[0]["n_shared"] == 2
    assert got[2]["text"] == "Home 2\nNothing named 2\nStory 2\nend of 2" and got[2]["n_ruled"] == 1  # its neighbours lack the place
    named = [(i, f"http://x.org/{i}", f"<nav>m{i}</nav><article>t{i}<aside>s{i}</aside></article>") for i in range(3)]
    got = h.extract(table(spark, named)).collect()
    assert all(r["text"] == f"t{r['page_id']}" and r["n_shared"] == 2 and r["n_ruled"] == 0 for r in got)


def test_empty_table(spark):
    assert h.extract(table(spark, []).limit(0)).count() == 0
