"""Parsers that expressions cannot say: frontmatter, Markdown structure, links, stems. Arrow-batched UDFs over columns."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions import yaml_block

STRUCTURE = "struct<sections:array<struct<heading:string,level:int,path:array<string>,content:string,line:int>>,code:array<struct<language:string,code:string,heading:string,level:int,line:int>>>"
LINKS = "array<struct<start:int,end:int,text:string,destination:string,image:boolean>>"
FRONTMATTER = "struct<id:string,title:string,version:int,state:string,status:string,labels:array<string>,created_by:string,created_at:string,updated_by:string,updated_at:string,extra:map<string,string>,body:string,error:string>"
_MANAGED = ("id", "title", "version", "state", "status", "labels", "created_by", "created_at", "updated_by", "updated_at")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( {1,4}(?=\S)| (?=\s)|[ \t]*$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|\S+)")
_REFERENCE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?![(:])")
_BLANK = re.compile(r"[ \t>]*(?:\n|$)")


def arrow(kind: str):
    """Makes a row function text -> value an Arrow-batched UDF over a column; nulls are passed on as null."""

    def wrap(f):
        def over(c):
            from pyspark.sql.pandas.types import to_arrow_type
            from pyspark.sql.types import DataType

            arrow_kind = to_arrow_type(DataType.fromDDL(kind))  # on the driver, where the session is

            def run(column: pa.Array) -> pa.Array:
                return pa.array([None if x is None else f(x) for x in column.to_pylist()], arrow_kind)

            run.__annotations__ = {"column": pa.Array, "return": pa.Array}
            return F.arrow_udf(run, kind)(c)

        return over

    return wrap


def frontmatter(content: str) -> dict:
    """Fields of the block of YAML between the first line '---' and the next one, the body after it, and an error or null.

    Fields beside the managed ones are in extra, as JSON.
    """
    lines = content.removeprefix("\ufeff").split("\n")
    empty = dict.fromkeys([*_MANAGED, "error"]) | {"labels": [], "extra": {}, "body": content}
    if lines[0].strip() != "---":
        return empty | {"error": "missing frontmatter"}
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if end is None:
        return empty | {"error": "unclosed frontmatter"}
    body = "\n".join(lines[end + 1 :])
    try:
        found = yaml_block.read("\n".join(x.removesuffix("\r") for x in lines[1:end]))
    except yaml_block.YamlError:
        return empty | {"error": "invalid frontmatter", "body": body}
    labels = found.get("labels")
    labels = labels if isinstance(labels, list) else [] if labels is None else [labels]
    version = str(found.get("version", ""))
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    out = empty | {k: text(found[k]) for k in _MANAGED if k in found and k not in ("labels", "version")}
    out |= {"labels": [text(x) or "" for x in labels], "version": int(version) if version.isdigit() else None}
    return out | {"extra": {k: json.dumps(v, ensure_ascii=False) for k, v in found.items() if k not in _MANAGED}, "body": body}


def _walk(lines: list[str]) -> Iterator[tuple[str, str, int]]:
    """For each line of Markdown its kind, its text without the quotes and list items around it, and a level.

    Kinds: open (text: language), fence and close of fenced code; indented (code); heading and under (the line below a setext
    heading), both with their level; blank; definition (of a link reference); text, with level 1 where it begins a paragraph.
    """
    stack: list[int | None] = []  # None for a quote, else the width of a list item's marker
    fence: tuple[str, int, int, int] | None = None  # character, length, containers around it, indent
    paragraph = False
    for line in lines:
        rest, matched = line.removesuffix("\r"), 0
        for width in stack:
            if width is None:
                inside = _QUOTE.match(rest)
                if not inside:
                    break
                rest = rest[inside.end() :]
            elif rest.strip():
                if _indent(rest) < width:
                    break
                rest = rest[width:]
            matched += 1
        if fence and matched >= fence[2]:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{fence[1]},}}[ \t]*$", rest):
                fence = None
                yield "close", "", 0
            else:
                yield "fence", rest[min(fence[3], _indent(rest)) :], 0
            continue
        if matched < len(stack):
            fence = None
            starts = any(p.match(rest) for p in (_QUOTE, _ITEM, _FENCE, _HEADING)) or _RULE.match(rest)
            if not (paragraph and rest.strip() and not starts):  # else the paragraph goes on without its marks
                del stack[matched:]
                paragraph = False
        while _indent(rest) < 4 or not (paragraph or rest.strip()):
            quote, item = _QUOTE.match(rest), None if _RULE.match(rest) else _ITEM.match(rest)
            if quote:
                stack.append(None)
                rest = rest[quote.end() :]
            elif item and not (paragraph and (not item[3] or item[2][0].isdigit() and item[2][:-1] != "1")):
                stack.append(len(item[1]) + len(item[2]) + max(1, len(item[3])))
                rest = rest[item.end() :]
            else:
                break
            paragraph = False
        opened, atx, under = _FENCE.match(rest), _HEADING.match(rest), _SETEXT.match(rest)
        if not rest.strip():
            paragraph = False
            yield "blank", "", 0
        elif not paragraph and _indent(rest) >= 4:
            yield "indented", rest[4:], 0
        elif opened and not (opened[1][0] == "`" and "`" in rest[opened.end(1) :]):
            fence, paragraph = (opened[1][0], len(opened[1]), len(stack), _indent(rest)), False
            yield "open", opened[2], 0
        elif atx:
            paragraph = False
            yield "heading", (atx[2] or "").strip(), len(atx[1])
        elif paragraph and under and (under[1][0] == "=" or matched == len(stack)):
            paragraph = False
            yield "under", "", 1 if under[1][0] == "=" else 2
        elif _RULE.match(rest):
            paragraph = False
            yield "text", "", 0
        elif not paragraph and _DEFINITION.match(rest):
            yield "definition", rest, 0
        else:
            yield "text", rest, int(not paragraph)
            paragraph = True


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def structure(body: str) -> dict:
    """Sections (each heading with the text up to the next heading) and fenced code blocks, in order of the lines; also those
    inside quotes and list items."""
    sections, code, open_headings = [], [], []
    lines = body.split("\n")
    above: list[str] = []

    def heading(level: int, text: str, line: int) -> None:
        del open_headings[next((i for i, (lv, _) in enumerate(open_headings) if lv >= level), len(open_headings)) :]
        open_headings.append((level, text))
        sections.append({"heading": text, "level": level, "path": [t for _, t in open_headings], "content": [], "line": line})

    for number, (line, (kind, text, level)) in enumerate(zip(lines, _walk(lines), strict=True), 1):
        if kind == "under":
            if sections:
                del sections[-1]["content"][len(sections[-1]["content"]) - len(above) :]
            heading(level, " ".join(x.strip() for x in above), number - len(above))
            above = []
            continue
        above = [] if kind != "text" or level else above
        if kind == "heading":
            heading(level, text, number)
            continue
        if kind == "text":
            above.append(text)
        elif kind == "open":
            at, held = open_headings[-1] if open_headings else (0, "")
            code.append({"language": text, "code": [], "heading": held, "level": at, "line": number + 1})
        elif kind == "fence":
            code[-1]["code"].append(text)
        if sections:
            sections[-1]["content"].append(line)
    for s in sections:
        s["content"] = "\n".join(s["content"]).strip()
    for c in code:
        c["code"] = "\n".join(c["code"])
    return {"sections": sections, "code": code}


def _without_code(body: str) -> tuple[str, list[str]]:
    """``body`` with code, headings' marks apart, blanked in place, and its lines' kinds. A code span ends with its paragraph."""
    lines = body.split("\n")
    kinds = [kind for kind, _, _ in _walk(lines)]
    plain = "\n".join(line if kind in ("text", "heading", "blank", "definition", "under") else " " * len(line) for line, kind in zip(lines, kinds, strict=True))
    parts, start = [], 0
    for end in [*(m.start() for m in re.finditer(r"\n(?=[ \t>]*\n)", plain)), len(plain)]:
        parts.append(_without_spans(plain[start:end]))
        start = end
    return "".join(parts), kinds


def _without_spans(paragraph: str) -> str:
    """``paragraph`` with its code spans blanked: from a run of backticks to the next one of the same length."""
    runs = [m.span() for m in re.finditer("`+", paragraph)]
    after: dict[int, list[int]] = {}
    for k in reversed(range(len(runs))):
        after.setdefault(runs[k][1] - runs[k][0], []).append(k)
    parts, last, k = [], 0, 0
    while k < len(runs):
        begin, end = runs[k]
        later = after[end - begin]
        while later and later[-1] <= k:
            later.pop()
        if begin and paragraph[begin - 1] == "\\" or not later:
            k += 1
            continue
        k = later[-1]
        parts += [paragraph[last:begin], re.sub(r"[^\n]", " ", paragraph[begin : runs[k][1]])]
        last = runs[k][1]
        k += 1
    return "".join([*parts, paragraph[last:]])


def links(body: str) -> list[dict]:
    """Inline links and images outside code, with the span of the destination in the body; also over several lines."""
    plain, _ = _without_code(body)
    found: list[dict] = []
    stack: list[tuple[int, bool]] = []
    i = 0
    while i < len(plain):
        c = plain[i]
        if c == "\\":
            i += 2
            continue
        if c == "\n":
            if _BLANK.match(plain, i + 1):
                stack.clear()  # a paragraph ends
        elif c == "[":
            stack.append((i, i > 0 and plain[i - 1] == "!"))
        elif c == "]" and stack:
            start, image = stack.pop()
            if plain[i + 1 : i + 2] == "(":
                depth, j = 1, i + 2
                angle = plain[j : j + 1] == "<"
                while j < len(plain) and depth and plain[j : j + 2] != "\n\n":
                    angle = angle and plain[j] != ">"
                    depth += 0 if angle else {"(": 1, ")": -1}.get(plain[j], 0)
                    j += 2 if plain[j] == "\\" else 1
                if not depth:
                    found.append({"start": i + 2, "end": j - 1, "text": body[start + 1 : i], "destination": body[i + 2 : j - 1], "image": image})
                    i = j
                    continue
        i += 1
    return found


def reference_links(body: str) -> list[dict]:
    """Links by reference that are used, with the span of the destination in its definition: [text][label], [label][] and
    [label]. Labels go by words without case; of equal definitions the first counts."""
    plain, kinds = _without_code(body)
    key = lambda label: " ".join(label.split()).casefold()
    known: dict[str, tuple[int, int]] = {}
    at, text = 0, plain
    for line, kind in zip(body.split("\n"), kinds, strict=True):
        defined = _DEFINITION.search(line) if kind == "definition" else None
        if defined:
            known.setdefault(key(defined[1]), (at + defined.start(2), at + defined.end(2)))
            text = text[:at] + " " * len(line) + text[at + len(line) :]
        at += len(line) + 1
    inside = [(x["start"] - len(x["text"]) - 3, x["end"]) for x in links(body)]
    found = []
    for m in _REFERENCE.finditer(text):
        label = key(m[3] or m[2])
        if label in known and not any(a <= m.start(2) - 1 <= b for a, b in inside):
            start, end = known[label]
            found.append({"start": start, "end": end, "text": m[2], "destination": body[start:end], "image": bool(m[1])})
    return found


def media_references(document: str) -> list[dict]:
    """Media nodes anywhere in a rich-text JSON tree."""
    try:
        todo = [json.loads(document)]
    except ValueError:
        return []
    found = []
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            attrs = node.get("attrs") if isinstance(node.get("attrs"), dict) else {}
            if node.get("type") in ("media", "mediaInline"):
                found.append({"id": str(attrs.get("id", "")), "file": str(attrs.get("__fileName", attrs.get("fileName", "")))})
            todo += reversed(list(node.values()))
        elif isinstance(node, list):
            todo += reversed(node)
    return found


def diagram(encoded: str) -> str:
    """Text of a base64 diagram, zlib or raw deflate."""
    raw = base64.b64decode(encoded)
    for bits in (15, -15):
        try:
            return zlib.decompress(raw, bits).decode()
        except (zlib.error, UnicodeDecodeError):
            continue
    return ""


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(w, i) else "v" for i in range(len(w))))
    return shape.count("vc")


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


#: Fixed values of Porter's published algorithm: endings of steps 2, 3 and 4.
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(maxsize=1 << 17)
def stem(w: str) -> str:
    """Porter's stem of a lower-case English word."""
    if len(w) <= 2 or not w.isascii():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(text: str) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", text.lower())]


def snippet(text: str, words: frozenset[str], size: int = 10) -> str:
    """The ``size`` words of ``text`` that hold most of ``words``, hits in brackets."""
    tokens = text.split()
    hit = [re.sub(r"\W", "", t.lower()) in words for t in tokens]
    best = max(range(max(1, len(tokens) - size + 1)), key=lambda i: (sum(hit[i : i + size]), -i), default=0)
    shown = [f"[{t}]" if h else t for t, h in zip(tokens[best : best + size], hit[best : best + size])]
    return ("..." if best else "") + " ".join(shown) + ("..." if best + size < len(tokens) else "")


parse_frontmatter = arrow(FRONTMATTER)(frontmatter)


def write_frontmatter(c: Column) -> Column:
    """The text of documents from structs as parse_frontmatter() gives them; null stays null."""

    @F.arrow_udf("string")
    def run(fm: pa.Array) -> pa.Array:
        return pa.array([None if x is None else format_document(x, x["body"] or "") for x in fm.to_pylist()], pa.string())

    return run(c)


parse_structure = arrow(STRUCTURE)(structure)
parse_links = arrow(LINKS)(links)
parse_references = arrow(LINKS)(reference_links)
parse_media = arrow("array<struct<id:string,file:string>>")(media_references)
parse_diagram = arrow("string")(diagram)
parse_stems = arrow("array<string>")(stems)


def format_document(fm: dict, body: str) -> str:
    """A document's text from its fields: empty fields, the state 'current' and managed keys of extra (JSON values) are left out."""
    found: dict = {}
    for key in _MANAGED:
        value = fm.get(key)
        if key == "labels":
            value = sorted({x.strip().lower() for x in value or [] if x and x.strip()})
        if value in (None, "", []) or key == "state" and str(value).strip().lower() == "current" or key == "version" and not value:
            continue
        found[key] = value
    for key, value in sorted(dict(fm.get("extra") or {}).items()):
        if key not in _MANAGED:
            try:
                found[key] = json.loads(value)
            except (TypeError, ValueError):
                found[key] = value
    return f"---\n{yaml_block.write(found)}---\n{body}"


_ESCAPED_LINK = re.compile(r"\\\[([^\]\n]+?)\\\]\\\(([^)\n]+?)\\\)")
_FENCES = re.compile(r"(?ms)^(?:```|~~~).*?^(?:```|~~~)[ \t]*$|`[^`\n]+`")


def outside_code(body: str, change) -> str:
    """``body`` with ``change`` applied to the stretches that are neither fenced nor code spans."""
    out, at = [], 0
    for m in _FENCES.finditer(body):
        out += [change(body[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(body[at:])])


def unescape_links(body: str) -> str:
    """Escaped inline links and parentheses as plain ones, outside code; date guards go."""
    plain = lambda s: re.sub(r"\\([\\\[\]()_*])", r"\1", s).strip()

    def link(m: re.Match) -> str:
        label, target = plain(m[1]), plain(m[2])
        fits = label and target and (re.match(r"(?i)https?://|mailto:|#|/|\.{0,2}/", target) or target.lower().split("#")[0].endswith(".md"))
        return f"[{label}]({target})" if fits else m[0]

    return outside_code(body.replace("\u200b", "").replace("\u2060", ""), lambda s: re.sub(r"\\([()])", r"\1", _ESCAPED_LINK.sub(link, s)))


def guard_dates(body: str) -> str:
    """A zero-width mark inside literal ISO dates outside code, so that they are not read as date nodes."""
    return outside_code(body, lambda s: re.sub(r"\b(\d{4})-(\d{2}-\d{2})\b", "\\1-\u2060\\2", s))


parse_unescaped = arrow("string")(unescape_links)
parse_guarded = arrow("string")(guard_dates)
