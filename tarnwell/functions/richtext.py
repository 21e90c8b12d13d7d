"""Rich-text JSON documents to Markdown and back, for the nodes that Markdown has: headings, paragraphs, lists, quotes,
code, rules, and strong, em, code, strike and link marks. Other nodes become their text, with a warning."""

from __future__ import annotations

import json
import re

from tarnwell.functions.markup import arrow

MARKDOWN = "struct<markdown:string,warnings:array<string>>"
_MARKS = (("code", "`", "`"), ("strong", "**", "**"), ("em", "*", "*"), ("strike", "~~", "~~"))


def _inline(nodes: list, warnings: list[str]) -> str:
    out = []
    for node in nodes:
        kind = node.get("type")
        if kind == "text":
            value, marks = node.get("text", ""), {m.get("type"): m.get("attrs", {}) for m in node.get("marks", [])}
            for name, before, after in _MARKS:
                if name in marks:
                    value = before + value + after
            if "link" in marks:
                value = f"[{value}]({marks['link'].get('href', '')})"
            out.append(value)
        elif kind == "hardBreak":
            out.append("\\\n")
        elif kind == "mention":
            out.append(node.get("attrs", {}).get("text", ""))
        else:
            warnings.append(f"unsupported {kind}")
            out.append(_inline(node.get("content", []), warnings))
    return "".join(out)


def _indent(text: str, first: str) -> str:
    return first + text.replace("\n", "\n" + " " * len(first))


def _block(node: dict, warnings: list[str]) -> str:
    kind, content, attrs = node.get("type"), node.get("content", []), node.get("attrs", {})
    if kind == "paragraph":
        return _inline(content, warnings)
    if kind == "heading":
        return "#" * int(attrs.get("level", 1)) + " " + _inline(content, warnings)
    if kind == "codeBlock":
        return f"```{attrs.get('language', '')}\n" + "".join(x.get("text", "") for x in content) + "\n```"
    if kind == "rule":
        return "---"
    if kind == "blockquote":
        return "\n".join("> " + x if x else ">" for x in _blocks(content, warnings).split("\n"))
    if kind in ("bulletList", "orderedList"):
        start = int(attrs.get("order", 1))
        return "\n".join(_indent(_blocks(x.get("content", []), warnings, "\n"), "- " if kind == "bulletList" else f"{start + i}. ") for i, x in enumerate(content))
    if kind == "table":
        rows = [[_blocks(c.get("content", []), warnings, " ").replace("|", "\\|").replace("\n", " ") for c in r.get("content", [])] for r in content]
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n".join([*lines[:1], "|" + " --- |" * len(rows[0] if rows else []), *lines[1:]])
    warnings.append(f"unsupported {kind}")
    return _blocks(content, warnings) if content and content[0].get("type") != "text" else _inline(content, warnings)


def _blocks(nodes: list, warnings: list[str], between: str = "\n\n") -> str:
    return between.join(_block(n, warnings) for n in nodes)


def to_markdown(document: str) -> dict:
    """Markdown of a document, best effort, and what was lost; text that is no JSON document gives nothing but a warning."""
    warnings: list[str] = []
    try:
        node = json.loads(document)
        return {"markdown": _blocks(node.get("content", []), warnings), "warnings": warnings}
    except (ValueError, AttributeError):
        return {"markdown": "", "warnings": ["malformed document"]}


_SPAN = re.compile(r"`(?P<code>[^`]+)`|\[(?P<label>[^\]]*)\]\((?P<href>[^)\s]*)\)|\*\*(?P<strong>.+?)\*\*|~~(?P<strike>.+?)~~|\*(?P<em>[^*]+)\*")


def _texts(value: str, marks: tuple = ()) -> list[dict]:
    out, at = [], 0

    def plain(text: str, extra: tuple = ()) -> None:
        for i, part in enumerate(text.split("\\\n")):
            if i:
                out.append({"type": "hardBreak"})
            if part:
                node: dict = {"type": "text", "text": part}
                if marks + extra:
                    node["marks"] = list(marks + extra)
                out.append(node)

    for m in _SPAN.finditer(value):
        plain(value[at : m.start()])
        at = m.end()
        if m["code"] is not None:
            plain(m["code"], ({"type": "code"},))
        elif m["label"] is not None:
            out += _texts(m["label"], (*marks, {"type": "link", "attrs": {"href": m["href"]}}))
        else:
            kind = next(k for k in ("strong", "strike", "em") if m[k] is not None)
            out += _texts(m[kind], (*marks, {"type": kind}))
    plain(value[at:])
    return out


_ITEM = re.compile(r"(?P<bullet>[-*+])(?P<space> +)|(?P<number>\d+)\.(?P<space2> +)")


def _parse(lines: list[str]) -> list[dict]:
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        head = re.match(r"(#{1,6}) +(.*?)(?: +#+)?$", line)
        fence = re.match(r"(`{3,}|~{3,}) *(\S*)", line)
        item = _ITEM.match(line)
        if not line.strip():
            i += 1
        elif head:
            out.append({"type": "heading", "attrs": {"level": len(head[1])}, "content": _texts(head[2])})
            i += 1
        elif fence:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1])), len(lines))
            node = {"type": "codeBlock", "content": [{"type": "text", "text": "\n".join(lines[i + 1 : end])}]}
            if fence[2]:
                node["attrs"] = {"language": fence[2]}
            out.append(node)
            i = end + 1
        elif re.fullmatch(r"(-{3,}|\*{3,}|_{3,})\s*", line):
            out.append({"type": "rule"})
            i += 1
        elif line.startswith(">"):
            end = next((j for j in range(i, len(lines)) if not lines[j].startswith(">")), len(lines))
            out.append({"type": "blockquote", "content": _parse([re.sub("^> ?", "", x) for x in lines[i:end]])})
            i = end
        elif item:
            ordered, items = item["number"] is not None, []
            first = int(item["number"] or 1)
            while i < len(lines) and (m := _ITEM.match(lines[i])) and (m["number"] is not None) == ordered:
                width = m.end()
                end = i + 1
                while end < len(lines) and (lines[end].startswith(" " * width) or not lines[end].strip() and end + 1 < len(lines) and lines[end + 1].startswith(" " * width)):
                    end += 1
                items.append({"type": "listItem", "content": _parse([lines[i][width:], *(x[width:] for x in lines[i + 1 : end])])})
                i = end
            node = {"type": "orderedList" if ordered else "bulletList", "content": items}
            if ordered and first != 1:
                node["attrs"] = {"order": first}
            out.append(node)
        else:
            end = i + 1
            while end < len(lines) and lines[end].strip() and not re.match(r"#{1,6} |`{3,}|~{3,}|>", lines[end]) and not _ITEM.match(lines[end]):
                end += 1
            out.append({"type": "paragraph", "content": _texts("\n".join(lines[i:end]))})
            i = end
    return out


def from_markdown(body: str) -> str:
    """The document of a Markdown body."""
    return json.dumps({"version": 1, "type": "doc", "content": _parse(body.split("\n"))}, ensure_ascii=False)


render_markdown = arrow(MARKDOWN)(to_markdown)
parse_markdown = arrow("string")(from_markdown)
