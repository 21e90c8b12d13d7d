"""HTML extraction with nearest-URL page differencing.

1. A page is parsed into lines, one per block of text, each with the path of elements (names and classes) around it. Only
   what is never shown as text (scripts, styles, templates, media) gives none.
2. Pages are sorted by host and URL path, and each is paired with that one of the nearest differing pages before and
   after it in the host whose path begins most like its own. A copy of the page is no evidence; the nearest page beyond it is.
3. All lines of both pages are aligned by longest common subsequence, and shared ones are deleted. Outside a page's main
   element (article or main), and in elements named like furniture, a line is known by its path, and neighbours of one path
   are one: there a site repeats places and not words, so menus and adverts are shared whatever they say today. Other lines
   are known by path and words, and those inside the main element stay: what an article repeats is text.
4. Rules come last and meet only what differencing left, because a page is alone in its host or its neighbour lacks the
   place: then elements and class names of furniture go, and so does all outside the main element.

Pages are parsed once, before the only shuffle, into blocks of the order (host, path, page) whose bounds come from a bounded
sample of the urls. The runs of equal pages at a block's edges are stitched afterwards: the driver sees four rows a block.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store

#: Elements that show no text, and those of them whose content is no markup.
SILENT = frozenset("script style noscript template head title iframe svg canvas object embed audio video xmp noembed noframes".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Elements of furniture.
DROPPED = frozenset("nav footer aside form button select option textarea input dialog menu".split())
#: Words of class, id and role that mark furniture.
FURNITURE = frozenset("ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget widgets".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of these kinds.
ENDS_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "option", "optgroup"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an implied end does not reach beyond.
WALLS = frozenset(("ul", "ol", "dl", "table", "article", "main", "section", "div", "nav", "aside", "header", "footer", "body"))
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
#: A whole start or end tag: name and attributes. Nothing here is matched twice, so a page is read in linear time.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?""")
_MARKED = re.compile(r"class|id|role|aria-label|hidden", re.I)
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
#: Largest product of two pages' lines that are aligned by a table; longer ones are halved until they fit.
TABLE = 250_000
#: Urls sampled for each block, of which there is one a shuffle partition.
SAMPLED = 40

Line = tuple[str, int, bool, bool]  # words, path, inside the main element, furniture by the rules


class _Lines:
    """Collects the lines of a page; one entry of the stack for each open element."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, bool, int]] = []  # name, silent, furniture, main, path
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.text: list[str] = []
        self.silent = self.ruled = self.inside = self.path = 0

    def flush(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if line:
                self.lines.append((line, self.path, self.inside > 0, self.ruled > 0))

    def leave(self, at: int) -> None:
        """Closes all elements from place ``at``."""
        while len(self.open) > at:
            tag, silent, ruled, main, _ = self.open[-1]
            if tag in BLOCKS or ruled:
                self.flush()
            self.open.pop()
            self.places[tag].pop()
            if tag in WALLS:
                self.walls.pop()
            self.silent -= silent
            self.ruled -= ruled
            self.inside -= main
            self.path = self.open[-1][4] if self.open else 0

    def imply_end(self, kinds: frozenset | set) -> None:
        at = max((self.places[k][-1] for k in kinds if self.places.get(k)), default=-1)
        if at > (self.walls[-1] if self.walls else -1):
            self.leave(at)

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self.imply_end({"p"})
        if tag in CLOSES:
            self.imply_end(CLOSES[tag])
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        ruled = tag in DROPPED or (tag == "header" and not self.inside)
        kind = ""
        if _MARKED.search(attributes):
            marks: set[str] = set()
            for name, value in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                value = unescape(value.strip("\"'")).lower()
                if name in ("class", "role"):
                    kind += "." + _DIGITS.sub("0", " ".join(value.split()))
                if name in ("class", "id", "role", "aria-label"):
                    marks.update(_WORD.findall(value))
                ruled = ruled or (name == "hidden" and tag not in _BARE)
            marks -= {"header"} if self.inside else set()  # an article's own header holds its title
            ruled = ruled or (tag not in _BARE and not marks.isdisjoint(FURNITURE))
        if ruled:
            self.flush()
        silent, main = tag in SILENT, tag in MAIN and not self.ruled
        if tag in BLOCKS or ruled:
            self.path = xxhash.xxh64_intdigest(f"{self.path}/{tag}{kind}")
        if tag in WALLS:
            self.walls.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, silent, ruled, main, self.path))
        self.silent += silent
        self.ruled += ruled
        self.inside += main

    def end(self, tag: str) -> None:
        if self.places.get(tag):
            self.leave(self.places[tag][-1])
        elif tag == "p":
            self.flush()
        elif tag == "br":
            self.text.append(" ")

    def data(self, text: str) -> None:
        if text and not self.silent:
            self.text.append(unescape(text) if "&" in text else text)


_BARE = frozenset(("body", "html", *MAIN))


def lines_of(html: str | None) -> list[Line]:
    """The text lines of a page in order; broken markup is read as far as it goes, what is cut off inside a tag is dropped."""
    html = html or ""
    page = _Lines()
    at = 0
    while True:
        tag = html.find("<", at)
        page.data(html[at : tag if tag >= 0 else len(html)])
        if tag < 0:
            break
        after = html[tag + 1 : tag + 2]
        closes = after == "/"
        letter = html[tag + 2 : tag + 3] if closes else after
        if letter.isascii() and letter.isalpha():
            found = _TAG.match(html, tag)
            if not found:
                break
            at = found.end()
            name, attributes = found[1].lower(), found[2]
            if closes:
                page.end(name)
            elif name in RAW:
                ended = _RAW_END[name].search(html, at)
                if not ended:
                    break
                at = ended.end()
            elif name != "svg" or not attributes.endswith("/"):
                page.start(name, attributes)
        elif after in ("!", "?", "/") and after:
            if html.startswith("<!--", tag):
                short = next((n for n in (5, 6) if html[tag : tag + n] in ("<!-->", "<!--->")), 0)
                found = None if short else _COMMENT_END.search(html, tag + 4)
                at = tag + short if short else found.end() if found else -1
            else:
                at = html.find(">", tag) + 1 or -1
            if at < 0:
                break
        else:
            page.data("<")
            at = tag + 1
    page.flush()
    return page.lines


def _table(a: list, b: list) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``."""
    lengths = [[0] * (len(b) + 1)]
    for x in a:
        above, row = lengths[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        lengths.append(row)
    found, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif lengths[i - 1][j] >= lengths[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def shared_lines(a: list, b: list) -> set[int]:
    """Indices of ``a`` that a longest common subsequence with ``b`` holds."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = {*range(low), *range(len(a) - high, len(a))}
    left, right = a[low : len(a) - high], b[low : len(b) - high]
    common = set(left) & set(right)
    mine, theirs = [i for i, x in enumerate(left) if x in common], [j for j, x in enumerate(right) if x in common]
    picked = [mine[k] for k in _longest([left[i] for i in mine], [right[j] for j in theirs])]
    return found | {low + i for i in picked}


def _lengths(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` with each beginning of ``b``; one bit of a number for each of b."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        met = row & places.get(x, 0)
        if met:
            row = (row + met | row - met) & whole
    lengths = [0]
    for bit in reversed(f"{row:0{len(b)}b}"):
        lengths.append(lengths[-1] + (bit == "0"))
    return lengths


def _longest(a: list, b: list) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``; long ones are halved where both halves' lengths add up most."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) <= TABLE:
        return _table(a, b)
    half = len(a) // 2
    before, after = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    split = max(range(len(b) + 1), key=lambda j: before[j] + after[j])
    return _longest(a[:half], b[:split]) + [half + i for i in _longest(a[half:], b[split:])]


def units_of(lines: list[Line]) -> tuple[list[str], list[int], list[int]]:
    """What a page's text is made of: its lines; the keys by which its units are aligned, a unit being a line or neighbouring
    lines of one place; and for each unit four times the number of its lines, plus one if differencing may delete it and two
    if the rules would."""
    has_main = any(main for _, _, main, _ in lines)
    texts: list[str] = []
    keys: list[int] = []
    marks: list[int] = []
    last = None
    for words, path, main, ruled in lines:
        outside = has_main and not main
        place = (path, ruled) if outside or ruled else None
        if place is None or place != last:
            keys.append((path if place is not None else xxhash.xxh64_intdigest(f"{path} {words}")) - (1 << 63))
            marks.append((place is not None or not main) + 2 * (outside or ruled))
        last = place
        texts.append(words)
        marks[-1] += 4
    return texts, keys, marks


def main_text(texts: list[str], keys: list[int], marks: list[int], neighbour: list[int] | None, rules: bool = True) -> tuple[str, int, int]:
    """A page's text, given the keys of its nearest differing page; and how many units differencing deleted, and how many the
    rules, which come after it and meet only what the neighbour doesn't tell."""
    gone = shared_lines(keys, neighbour) if neighbour is not None and neighbour != keys else set()
    kept: list[str] = []
    at = shared = ruled = 0
    for i, mark in enumerate(marks):
        count = mark >> 2
        if mark & 1 and i in gone:
            shared += 1
        elif rules and mark & 2:
            ruled += 1
        else:
            kept += texts[at : at + count]
        at += count
    return "\n".join(kept), shared, ruled


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nearer(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1: which of two paths begins most like ``path`` (ties: the one before); 0 if there is none."""
    left, right = (-1 if p is None else _common(path, p) for p in (before, after))
    return 0 if max(left, right) < 0 else -1 if left >= right else 1


class _Run:
    """Pages side by side in a host with equal keys, which are held once."""

    def __init__(self, row: dict, index: int) -> None:
        self.block, self.host, self.keys, self.first, self.index = row["block"], row["host"], row["keys"], row["path"], index
        self.rows: list[dict] = []
        self.add(row)

    def takes(self, row: dict) -> bool:
        return row["block"] == self.block and row["host"] == self.host and row["keys"] == self.keys

    def add(self, row: dict) -> None:
        row = {k: row[k] for k in ("page_id", "url", "path", "texts", "marks")}
        if self.rows and self.rows[-1]["marks"] == row["marks"]:
            row["marks"] = self.rows[-1]["marks"]
            if self.rows[-1]["texts"] == row["texts"]:
                row["texts"] = self.rows[-1]["texts"]
        self.rows.append(row)
        self.last = row["path"]


def _runs(rows: Iterator[dict]) -> Iterator[tuple[_Run | None, _Run, _Run | None]]:
    """Each run with those before and after it in its block."""
    before = run = after = None
    for row in rows:
        if after is not None and after.takes(row):
            after.add(row)
            continue
        if after is not None and after.block != row["block"]:
            if run is not None:
                yield before, run, after
            yield run, after, None
            before = run = after = None
        if run is not None:
            yield before, run, after
        before, run, after = run, after, _Run(row, 0 if after is None else after.index + 1)
    if run is not None:
        yield before, run, after
    if after is not None:
        yield run, after, None


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("block", pa.int32()), ("texts", pa.binary()), ("keys", _LONGS), ("marks", _INTS)])
_PARSED_SQL = "page_id long, url string, host string, path string, block int, texts binary, keys array<long>, marks array<int>"
#: kind 0: a page's result; 1: a page of a run at a block's edge, which waits for its neighbours; 2: a run at or next to an edge.
_PARTS = pa.schema([("kind", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("texts", pa.binary()), ("n_shared", pa.int32()), ("n_ruled", pa.int32()), ("block", pa.int32()), ("run", pa.int32()), ("is_last", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("last_path", pa.string()), ("keys", _LONGS), ("marks", _INTS)])
_PARTS_SQL = "kind int, page_id long, url string, text string, texts binary, n_shared int, n_ruled int, block int, run int, is_last boolean, host string, path string, last_path string, keys array<long>, marks array<int>"


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema.names)

    for row in rows:
        out.append(row)
        if len(out) >= 256:
            yield batch()
    if out:
        yield batch()


def _joined(texts: list[str]) -> bytes:
    """Lines, which hold no line break, as they travel: packed, since they are most of what is shuffled and kept."""
    return zlib.compress("\n".join(texts).encode(), 3)


def _split(texts: bytes, marks: list[int]) -> list[str]:
    return zlib.decompress(texts).decode().split("\n") if marks else []


def _difference(batches: Iterator[pa.RecordBatch], rules: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, host and path; each block on its own."""

    def parts() -> Iterator[tuple]:
        for before, run, after in _runs(r for batch in batches for part in slices(iter([batch])) for r in part.to_pylist()):
            if before is None or after is None:
                for row in run.rows:
                    yield 1, row["page_id"], row["url"], None, row["texts"], None, None, run.block, run.index, None, None, row["path"], None, run.keys, row["marks"]
            else:
                known: dict[tuple, tuple] = {}
                for row in run.rows:
                    side = nearer(row["path"], before.last, after.first)
                    key = side, id(row["texts"]), id(row["marks"])
                    if key not in known:
                        known[key] = main_text(_split(row["texts"], row["marks"]), run.keys, row["marks"], (before if side < 0 else after).keys, rules)
                    text, *counts = known[key]
                    yield 0, row["page_id"], row["url"], text, None, *counts, run.block, None, None, None, None, None, None, None
            if after is None:
                if before is not None and before.index >= 2:
                    yield edge(before, False)
                yield edge(run, True)
            elif run.index < 2:
                yield edge(run, False)

    def edge(run: _Run, is_last: bool) -> tuple:
        return 2, None, None, None, None, None, None, run.block, run.index, is_last, run.host, run.first, run.last, run.keys, None

    yield from _packed(parts(), _PARTS)


_NEAR_SQL = "block int, run int, before_block int, before_run int, before_path string, after_block int, after_run int, after_path string"


def _stitched(edges: list) -> list[tuple]:
    """For each run at a block's edge: the runs before and after it in the order of all blocks, if they are of its host.
    ``edges`` has block, run, is_last, host, path, last_path and digest (of the keys) of the first and last two runs a block."""
    groups: list[list] = []
    for e in sorted(edges, key=lambda e: (e["block"], e["run"])):
        last = groups[-1][-1] if groups else None
        if last is not None and last["is_last"] and e["run"] == 0 and (last["host"], last["digest"]) == (e["host"], e["digest"]):
            groups[-1].append(e)
        else:
            groups.append([e])
    found = []
    for k, group in enumerate(groups):
        before = groups[k - 1][-1] if k and groups[k - 1][-1]["host"] == group[0]["host"] else None
        after = groups[k + 1][0] if k + 1 < len(groups) and groups[k + 1][0]["host"] == group[0]["host"] else None
        left = (before["block"], before["run"], before["last_path"]) if before else (None,) * 3
        right = (after["block"], after["run"], after["path"]) if after else (None,) * 3
        found += [(e["block"], e["run"], *left, *right) for e in group if e["run"] == 0 or e["is_last"]]
    return found


def _resolve(batches: Iterator[pa.RecordBatch], rules: bool = True) -> Iterator[pa.RecordBatch]:
    """page_id, url, texts, path, keys, marks, before_path, before_keys, after_path, after_keys -> results."""

    def results() -> Iterator[tuple]:
        for batch in slices(batches):
            for r in batch.to_pylist():
                side = nearer(r["path"], r["before_path"], r["after_path"])
                other = r["before_keys"] if side < 0 else r["after_keys"] if side > 0 else None
                yield r["page_id"], r["url"], *main_text(_split(r["texts"], r["marks"]), r["keys"], r["marks"], other, rules)

    yield from _packed(results(), pa.schema([_PARTS.field(k) for k in ("page_id", "url", "text", "n_shared", "n_ruled")]))


def extract(pages: DataFrame, rules: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_shared and n_ruled of every row of ``pages``.

    n_shared counts the places and lines that differencing deleted, n_ruled those that it left and the rules deleted; without
    ``rules`` these stay. Null and empty pages have empty text. Very long pages are parsed in linear time and aligned exactly.
    Null urls are one host of their own; pages of one url are in the order of their ids. Repeated rows and copies get equal
    texts where their urls are equal, as a copy of a page is no neighbour of it. Results don't depend on the partitions.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    url = F.lower(F.coalesce("url", F.lit("")))
    bare = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://|[?#].*$", "")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.regexp_extract(bare, r"^(?:www\.)?([^/]*)", 1).alias("host"),
        F.regexp_extract(bare, r"^[^/]*(.*)$", 1).alias("path"),
        "html",
    )
    place = lambda r: (r["host"], r["path"], -(1 << 63) if r["page_id"] is None else r["page_id"])
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one_in = max(1, rows.count() // (SAMPLED * blocks))
    sample = rows.select("host", "path", "page_id").where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(one_in)) == 0)
    sample = sorted(place(r) for r in sample.limit(2 * SAMPLED * blocks).collect())  # bounded also if rows repeat
    bounds = [sample[len(sample) * k // blocks] for k in range(1, blocks)] if sample else []

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed() -> Iterator[tuple]:
            for part in slices(batches, 64):
                htmls = part.column(4).cast(pa.binary()).to_pylist()
                for row, html in zip(part.select([0, 1, 2, 3]).to_pylist(), htmls, strict=True):
                    texts, keys, marks = units_of(lines_of((html or b"").decode("utf-8", "replace")))
                    yield row["page_id"], row["url"], row["host"], row["path"], bisect_right(bounds, place(row)), _joined(texts), keys, marks

        yield from _packed(parsed(), _PARSED)

    dealt = rows.mapInArrow(parse, _PARSED_SQL).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "host", "path", "page_id")
    parts = store(dealt.mapInArrow(partial(_difference, rules=rules), _PARTS_SQL))
    edges = parts.where("kind = 2")
    seen = edges.select("block", "run", "is_last", "host", "path", "last_path", F.xxhash64("keys").alias("digest")).collect()  # four rows a block
    keys = lambda side: edges.select(F.col("block").alias(f"{side}_block"), F.col("run").alias(f"{side}_run"), F.col("keys").alias(f"{side}_keys"))
    near = spark.createDataFrame(_stitched(seen), _NEAR_SQL)
    near = near.join(keys("before"), ["before_block", "before_run"], "left").join(keys("after"), ["after_block", "after_run"], "left")
    waiting = parts.where("kind = 1").join(near.select("block", "run", "before_path", "before_keys", "after_path", "after_keys"), ["block", "run"], "left")
    waiting = waiting.select("page_id", "url", "texts", "path", "keys", "marks", "before_path", "before_keys", "after_path", "after_keys")
    columns = ["page_id", "url", "text", "n_shared", "n_ruled"]
    done = parts.where("kind = 0").select(*columns).unionByName(waiting.mapInArrow(partial(_resolve, rules=rules), "page_id long, url string, text string, n_shared int, n_ruled int"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_ruled")
