"""Scalar functions over columns, all built from Spark's own expressions.

Trimming is by Unicode white space throughout; Spark's ``trim`` knows only the space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that no file may have.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
#: File extensions of images when reading; writing knows one more.
READ_IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".tif", ".tiff", ".ico", ".avif")
WRITE_IMAGES = (*READ_IMAGES, ".apng")
MAX_SEGMENT = 100
_FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to(c: Column, other: Column | str) -> Column:
    """``c``, or ``other`` where ``c`` is null or white space."""
    other = F.lit(other) if isinstance(other, str) else other
    return F.when(F.coalesce(strip(c), F.lit("")) == "", other).otherwise(c)


def first_filled(*cs: Column) -> Column:
    """The first of ``cs``, trimmed, that is neither null nor blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs], F.lit(""))


def is_reserved(c: Column) -> Column:
    return F.upper(F.substring_index(strip(c), ".", 1)).isin(*RESERVED_NAMES)


def path_segment(c: Column) -> Column:
    """A safe path segment: forbidden characters and runs of space or dash become one dash, MAX_SEGMENT bytes at most
    (a character that the limit would split is left out whole)."""
    s = F.regexp_replace(F.regexp_replace(strip(c), _FORBIDDEN, "-"), r"^[. ]+|[. ]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s-]+", "-"), r"^-+|-+$", "")
    short = F.make_valid_utf8(F.substring(s.cast("binary"), 1, MAX_SEGMENT).cast("string"))
    s = F.when(F.octet_length(s) > MAX_SEGMENT, F.regexp_replace(F.regexp_replace(short, "\ufffd+$", ""), "-+$", "")).otherwise(s)
    s = F.when(s == "", "untitled").otherwise(s)
    return F.when(is_reserved(s), F.concat(s, F.lit("-item"))).otherwise(s)


def markdown_name(c: Column) -> Column:
    s = path_segment(c)
    return F.when(F.lower(s).endswith(".md"), s).otherwise(F.concat(s, F.lit(".md")))


def _space_part(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(c), _FORBIDDEN, "-"), r"^[. ]+|[. ]+$", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.when((s != "") & is_reserved(s), F.concat(s, F.lit("-item"))).otherwise(s)


def space_directory(name: Column, key: Column) -> Column:
    name, key = _space_part(name), _space_part(key)
    return F.when(name == "", path_segment(key)).when(key == "", name).otherwise(strip(F.concat(name, F.lit(" ("), key, F.lit(")"))))


def key_of_directory(c: Column) -> Column:
    """The text in the last parentheses of a directory's name, else the name."""
    base = F.element_at(F.split(c, "/"), -1)
    inside = strip(F.regexp_extract(base, r"\(([^()]+)\)\s*$", 1))
    return F.when(inside != "", inside).otherwise(base)


def labels(c: Column) -> Column:
    """Lower-case, trimmed, distinct, sorted labels without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != ""))))


def has_space(c: Column) -> Column:
    return c.rlike(r"(?U)\s")


def stored_date(c: Column) -> Column:
    """A timestamp or date as RFC 3339 in UTC; anything else as it is."""
    s = strip(c)
    at = F.when(s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(s)).when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


def date_bound(c: Column, end_of_day: bool) -> Column:
    """A date as the first or last second of its day; anything else as it is."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(c, F.lit("T23:59:59Z" if end_of_day else "T00:00:00Z"))).otherwise(c)


def short_date(c: Column) -> Column:
    return F.substring(c, 1, 10)


def clean_path(c: Column) -> Column:
    """Forward slashes, no empty or '.' parts; '..' takes the part before it; '.' is empty."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    return F.array_join(kept, "/")


def page_id_of_url(url: Column) -> Column:
    """The query's pageId, else the number after a 'pages' part of the path, else empty."""
    query = F.url_decode(F.replace(F.regexp_extract(url, r"[?&]pageId=([^&#]*)", 1), F.lit("%zz"), F.lit("")))
    return first_filled(query, F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/pages/(\d+)(?:/|$)", 1))


def space_key_of_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/[^?#]*)?/spaces/([^/?#]+)/pages/", 1)


def destination(c: Column) -> Column:
    """A Markdown destination without angle brackets, title or quotes."""
    s = strip(c)
    s = F.when(s.rlike("^<[^>]*>"), F.regexp_extract(s, "^<([^>]*)>", 1)).otherwise(F.regexp_extract(s, r"^(\S*)", 1))
    return F.regexp_replace(s, "^[\"']+|[\"']+$", "")


def is_external(c: Column) -> Column:
    s = F.lower(strip(c))
    return (s == "") | s.rlike(r"^(#|https?://|mailto:|tel:|data:|//)")


def percent_encode(c: Column) -> Column:
    """Per path part; a space is %20, never +."""
    return F.array_join(F.transform(F.split(c, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def percent_decode(c: Column) -> Column:
    """'+' stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def attachment_path(page_id: Column, attachment_id: Column, filename: Column) -> Column:
    return F.concat(F.lit("assets/"), path_segment(page_id), F.lit("/"), path_segment(attachment_id), F.lit("-"), path_segment(filename))


def filename_of_attachment(path: Column, attachment_id: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    prefix = F.concat(attachment_id, F.lit("-"))
    return F.when((attachment_id != "") & F.startswith(base, prefix), F.substring(base, F.length(prefix) + 1, F.length(base))).otherwise(base)


def owner_of_asset(path: Column) -> Column:
    """The page of assets/<page>/..., else null."""
    parts = F.split(clean_path(path), "/")
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "assets"), F.get(parts, F.lit(1)))


def is_generated(path: Column, state_file: str = "state.json") -> Column:
    """Whether a pull writes such a path: the state file, Markdown, or anything in a directory of assets."""
    clean = F.lower(strip(clean_path(path)))
    parts = F.split(clean, "/")
    return (clean != "") & ((F.element_at(parts, -1) == state_file.lower()) | F.endswith(clean, F.lit(".md")) | F.array_contains(parts, "assets"))


def pending_id(kind: str, path: Column) -> Column:
    return F.concat(F.lit(f"pending-{kind}-"), F.translate(F.lower(path), "/ ", "--"))


def local_title(title: Column, body: Column, path: Column) -> Column:
    """Frontmatter title, else the first '# ' line, else the file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return first_filled(title, F.regexp_extract(body, r"(?m)^\s*# (.+)$", 1), stem)


def lifecycle(c: Column) -> Column:
    return F.lower(first_filled(c, F.lit("current")))


def is_syncable(status: Column) -> Column:
    return F.lower(strip(F.coalesce(status, F.lit("")))).isin("", "current", "draft")


def query_terms(query: str) -> list[str]:
    """Letters and digits of a query, word by word; operators are plain words. A query without any is refused."""
    words = "".join(c if c.isalnum() else " " for c in query).split()
    if not words:
        raise ValueError("the query has no words")
    return words


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case, common Latin diacritics removed."""
    return F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def is_image(c: Column, write: bool = False) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1)).isin(*(WRITE_IMAGES if write else READ_IMAGES))


def has_conflict_marker(body: Column) -> Column:
    return body.rlike(r"(?m)^\s*(<<<<<<<|=======|>>>>>>>)")


def has_placeholder(body: Column) -> Column:
    return body.contains("UNKNOWN_MEDIA_ID") | body.contains("[Embedded content]") | body.contains("Invalid file id -")


def date_bound_value(bound: str, end_of_day: bool) -> str:
    """date_bound() of a plain string."""
    if len(bound) == 10 and bound[4] == bound[7] == "-" and bound.replace("-", "").isdigit():
        return bound + ("T23:59:59Z" if end_of_day else "T00:00:00Z")
    return bound
