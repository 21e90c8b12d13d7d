"""The YAML that frontmatter holds, read and written: maps and lists by indentation or in brackets, quoted and block scalars.

Anchors, tags, several documents and keys that are no scalars are errors.
"""

from __future__ import annotations

import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`,-][^:#]*?|[^\s"'\[\]{}#&*!|>%@`,-]|-(?=\S)[^:#]*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}
_NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9]*)$")
_FLOAT = re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$")
_CONSTANTS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
#: Plain scalars that begin like this, or hold these, must be quoted.
_NEEDS_QUOTES = re.compile(r"""^[\s\-?:,\[\]{}#&*!|>'"%@`]|\s$|:\s|:$|\s#|[\x00-\x1f\x7f]""")


#: Keys that are written without quotes.
_SIMPLE = re.compile(r"[A-Za-z_][\w-]*$", re.ASCII)


class YamlError(ValueError):
    pass


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _bare(text: str) -> str:
    """``text`` without a comment and outer blanks; quotes are respected."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            if c == quote and not (quote == '"' and _escaped(text, i)):
                quote = ""
        elif c in "\"'" and not text[:i].strip(" [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].strip()
    return text.strip()


def _escaped(text: str, at: int) -> bool:
    count = 0
    while at > count and text[at - 1 - count] == "\\":
        count += 1
    return count % 2 == 1


def scalar(text: str):
    """A plain or quoted scalar's value: string, int, float, bool or None."""
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text[1:-1])
    if text[:1] in ("&", "*", "!", "|", ">", "%", "@", "`") or text[:1] in ("'", '"'):
        raise YamlError(f"not understood: {text}")
    if text in _CONSTANTS:
        return _CONSTANTS[text]
    if _NUMBER.match(text):
        return int(text)
    return float(text) if _FLOAT.match(text) else text


def _flow(text: str, at: int):
    """The value that begins at ``at`` inside brackets, and where it ends."""
    while at < len(text) and text[at] in " \t\n":
        at += 1
    if text[at : at + 1] in ("[", "{"):
        close, found, pairs = ("]", [], None) if text[at] == "[" else ("}", None, {})
        at += 1
        while True:
            while at < len(text) and text[at] in " \t\n,":
                at += 1
            if at >= len(text):
                raise YamlError("a bracket is not closed")
            if text[at] == close:
                return (found if pairs is None else pairs), at + 1
            value, at = _flow(text, at)
            if pairs is None:
                found.append(value)
                continue
            while at < len(text) and text[at] in " \t\n":
                at += 1
            if text[at : at + 1] == ":":
                after = at + 1
                while after < len(text) and text[after] in " \t\n":
                    after += 1
                pairs[str(value)], at = (None, after) if text[after : after + 1] in (",", "}") else _flow(text, after)
            else:
                pairs[str(value)] = None
    if text[at : at + 1] in ("'", '"'):
        end = at + 1
        while end < len(text) and (text[end] != text[at] or text[at] == '"' and _escaped(text, end)):
            end += 1
        return scalar(text[at : end + 1]), end + 1
    end = at
    while end < len(text) and text[end] not in ",]}\n" and not (text[end] == ":" and text[end + 1 : end + 2] in ("", " ", "\n")):
        end += 1
    if end == at:
        raise YamlError(f"not understood: {text[at:]}")
    return scalar(text[at:end].strip()), end


class _Lines:
    def __init__(self, text: str) -> None:
        self.lines, self.at = text.split("\n"), 0

    def skip(self) -> None:
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1

    def node(self, least: int):
        """The value on the next lines that are indented by ``least`` at least; None if there is none."""
        self.skip()
        if self.at >= len(self.lines) or _indent(self.lines[self.at]) < least:
            return None
        line, width = self.lines[self.at], _indent(self.lines[self.at])
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise YamlError("a tab indents a line")
        text = line.strip()
        if text == "-" or text.startswith("- "):
            return self.items(width)
        if _KEY.match(text):
            return self.pairs(width)
        return self.value(text, width, self.at)

    def items(self, width: int) -> list:
        found = []
        while True:
            self.skip()
            if self.at >= len(self.lines) or _indent(self.lines[self.at]) != width:
                break
            text = self.lines[self.at].strip()
            if text != "-" and not text.startswith("- "):
                break
            rest = text[1:].strip()
            if not _bare(rest):
                self.at += 1
                found.append(self.node(width + 1))
            elif rest.startswith("- ") or _KEY.match(rest):  # a list or map that begins on the item's line
                self.lines[self.at] = " " * (width + len(text) - len(rest)) + rest
                found.append(self.node(width + 1))
            else:
                found.append(self.value(rest, width, self.at))
        return found

    def pairs(self, width: int) -> dict:
        found: dict = {}
        while True:
            self.skip()
            if self.at >= len(self.lines) or _indent(self.lines[self.at]) != width:
                break
            text = self.lines[self.at].strip()
            key = _KEY.match(text)
            if not key:
                raise YamlError(f"not a key: {text}")
            name = str(scalar(key[1]) if key[1][0] in "\"'" else key[1].strip())
            if name in found:
                raise YamlError(f"key twice: {name}")
            rest = text[key.end() :].strip()
            if _bare(rest):
                found[name] = self.value(rest, width, self.at)
                continue
            self.at += 1
            self.skip()
            here = self.at < len(self.lines) and _indent(self.lines[self.at]) == width and re.match(r"-(?: |$)", self.lines[self.at].strip())
            found[name] = self.items(width) if here else self.node(width + 1)
        if self.at < len(self.lines) and _indent(self.lines[self.at]) > width:
            raise YamlError(f"indented too far: {self.lines[self.at].strip()}")
        return found

    def value(self, text: str, width: int, line: int):
        """A scalar or bracketed value that begins with ``text`` on line ``line``, and goes on below if it is a block or open."""
        self.at = line + 1
        block = _BLOCK.match(text)
        if block:
            return self.block(block[1] == ">", block[2] or block[4], int(block[3] or 0), width)
        if text[0] in "[{":
            whole = _bare(text)
            while True:
                try:
                    value, end = _flow(whole, 0)
                    break
                except YamlError:
                    if self.at >= len(self.lines):
                        raise
                    whole += "\n" + _bare(self.lines[self.at])
                    self.at += 1
            if whole[end:].strip():
                raise YamlError(f"not understood: {whole[end:].strip()}")
            return value
        parts = [_bare(text)]
        if parts[0][0] not in "\"'" and _KEY.match(parts[0]):
            raise YamlError(f"not understood: {text}")
        while self.at < len(self.lines) and self.lines[self.at].strip() and _indent(self.lines[self.at]) > width:  # a plain scalar goes on
            more = _bare(self.lines[self.at])
            if parts[0][0] not in "\"'" and _KEY.match(more):
                raise YamlError(f"not understood: {more}")
            parts.append(more)
            self.at += 1
        return scalar(" ".join(p for p in parts if p))

    def block(self, folded: bool, chomp: str, wanted: int, width: int) -> str:
        held: list[str] = []
        inner = width + wanted if wanted else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                if inner is None:
                    inner = _indent(line)
                if _indent(line) < inner or inner <= width:
                    break
            held.append(line[inner:] if inner is not None and line.strip() else "")
            self.at += 1
        body = held[:]
        while body and not body[-1]:
            body.pop()
        tail = len(held) - len(body)
        if folded:
            text, above, blanks = "", "", 0
            for line in body:
                if not line:
                    blanks += 1
                    continue
                kept = line[0] == " " or above[:1] == " "  # lines indented further are not folded
                text += ("\n" * (blanks + kept) or " " if above else "\n" * blanks) + line
                above, blanks = line, 0
        else:
            text = "\n".join(body)
        return text + ("" if chomp == "-" or not body else "\n" * (tail + 1 if chomp == "+" else 1))


def read(text: str) -> dict:
    """The map that ``text`` holds; an empty one if it holds nothing."""
    lines = _Lines(text)
    found = lines.node(0)
    lines.skip()
    if lines.at < len(lines.lines):
        raise YamlError(f"not understood: {lines.lines[lines.at].strip()}")
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise YamlError("no map")
    return found


def _written(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return repr(value)
    if not value or _NEEDS_QUOTES.search(value) or not isinstance(_plain(value), str):
        return _quoted(value)
    return value


def _in_brackets(value) -> str:
    return _quoted(value) if isinstance(value, str) and re.search(r"[,\[\]{}:#\s]", value) else _written(value)


def _quoted(value: str) -> str:
    quoted = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return '"' + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\x{ord(m[0]):02x}", quoted) + '"'


def _plain(value: str):
    try:
        return scalar(value)
    except YamlError:
        return None


def write(found: dict, width: int = 0) -> str:
    """``found`` as block YAML, in its own order; read() gives it back."""
    pad, out = " " * width, []
    for key, value in found.items():
        name = key if _SIMPLE.match(key) else _quoted(key)
        if isinstance(value, dict) and value:
            out.append(f"{pad}{name}:\n{write(value, width + 2)}")
        elif isinstance(value, list) and value and not any(isinstance(x, dict | list) for x in value):
            out.append(f"{pad}{name}: [{', '.join(map(_in_brackets, value))}]\n")
        elif isinstance(value, list) and value:
            out.append(f"{pad}{name}:\n" + "".join(_item(x, width + 2) for x in value))
        else:
            out.append(f"{pad}{name}: {'{}' if value == {} else '[]' if value == [] else _written(value)}\n")
    return "".join(out)


def _item(value, width: int) -> str:
    pad = " " * width
    if isinstance(value, dict) and value:
        return f"{pad}- {write(value, width + 2)[width + 2 :]}"
    if isinstance(value, list) and value:
        inner = "".join(_item(x, width + 2) for x in value)
        return f"{pad}- {inner[width + 2 :]}"
    return f"{pad}- {'{}' if value == {} else '[]' if value == [] else _written(value)}\n"
