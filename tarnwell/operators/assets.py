"""Local files that Markdown refers to: references with their faults, moves under a page's folder, inline media spans."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions import markup, text
from tarnwell.operators.links import relative, with_destination

OUTSIDE, MISSING, DIRECTORY = "outside", "missing", "directory"
_REFERENCE = "array<struct<start:int,end:int,text:string,destination:string,image:boolean>>"


def outermost(found: Sequence[dict]) -> list[dict]:
    """Links and images in order of their tokens, without those inside another one's token."""
    kept: list[dict] = []
    for link in sorted(found, key=lambda x: (x["start"] - len(x["text"]), -x["end"])):
        if not kept or link["start"] - len(link["text"]) - 3 >= kept[-1]["end"]:
            kept.append(link)
    return kept


@markup.arrow(_REFERENCE)
def _scan(body: str) -> list[dict]:
    return outermost(markup.links(body))


def references(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Local files that ``documents`` (path, body) refer to: path, at (order in the body), start and end (of the destination),
    text, image, destination, target (path in the space) and issue.

    External destinations, anchors and links to Markdown files are none; images of Markdown files are. A destination is
    taken without title, query and anchor, percent-decoded, and starts at its document's directory. ``files`` (path) tells
    what exists: issue is '', or outside (of the space), directory or missing. Null bodies have no reference.
    """
    rows = documents.select("path", F.posexplode(_scan(F.col("body"))).alias("at", "l")).select("path", "at", "l.*")
    wanted = text.destination(F.col("destination"))
    bare = text.percent_decode(F.regexp_replace(wanted, r"[#?].*$", ""))
    rows = rows.withColumn("_bare", bare).where(~text.is_external(wanted) & (F.col("_bare") != "") & (F.col("image") | ~F.lower("_bare").endswith(".md")))
    rows = rows.withColumn("target", text.clean_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), "_bare"))).drop("_bare")
    there = files.select(text.clean_path(F.col("path")).alias("target"), F.lit(True).alias("_file")).distinct()
    parts = F.split("target", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = there.where(F.size(parts) > 1).select(F.explode(above).alias("target")).distinct().withColumn("_folder", F.lit(True))
    rows = rows.join(there, "target", "left").join(folders, "target", "left")
    out = (F.col("target") == "..") | F.startswith("target", F.lit("../"))
    issue = F.when(out, OUTSIDE).when(F.col("_file"), "").when(F.col("_folder") | (F.col("target") == ""), DIRECTORY).otherwise(MISSING)
    return rows.select("path", "at", "start", "end", "text", "image", "destination", "target", issue.alias("issue"))


def targets(page_id: str, sources: Sequence[str], existing: set[str]) -> list[str]:
    """Where a page's referenced files go, one after the other: assets/<page>/<name>, or the least -2, -3... before the extension
    that no other source of the page has got, ignoring case, and no file has; a file that is there already stays."""
    reserved: dict[str, str] = {}
    found = []
    for source in sources:
        name = source.rpartition("/")[2].strip() or "attachment"
        dot = name.rfind(".")
        stem, ending = (name[:dot] or "attachment", name[dot:]) if dot >= 0 else (name, "")
        k = 1
        while True:
            candidate = f"assets/{page_id}/{name if k == 1 else f'{stem}-{k}{ending}'}"
            holder = reserved.get(candidate.lower())
            k += 1
            if holder is not None and holder != source.lower():
                continue
            if candidate.lower() != source.lower() and candidate in existing:
                continue
            reserved[candidate.lower()] = source.lower()
            found.append(candidate)
            break
    return found


_MOVE = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])
_PLAN = T.StructType([T.StructField("body", T.StringType()), T.StructField("moves", T.ArrayType(_MOVE))])


@F.arrow_udf(_PLAN)
def _moved(path: pa.Array, page_id: pa.Array, body: pa.Array, refs: pa.Array, existing: pa.Array) -> pa.Array:
    out = []
    for p, page, b, found, names in zip(*(c.to_pylist() for c in (path, page_id, body, refs, existing)), strict=True):
        moves: dict[str, str] = {}
        if page and found:
            found = sorted(found, key=lambda r: r["at"])
            for r, target in reversed(list(zip(found, targets(page, [r["target"] for r in found], set(names or [])), strict=True))):
                if target == r["target"]:
                    continue
                moves[r["target"]] = target
                b = b[: r["start"]] + with_destination(r["destination"], relative(p, target)) + b[r["end"] :]
        out.append({"body": b, "moves": [{"source": s, "target": t} for s, t in sorted(moves.items())]})
    return pa.array(out, pa.struct([("body", pa.string()), ("moves", pa.list_(pa.struct([("source", pa.string()), ("target", pa.string())])))]))


def move_plan(pages: DataFrame, files: DataFrame) -> DataFrame:
    """path, body (with destinations rewritten) and moves of ``pages`` (path, page_id, body) whose referenced files all exist
    inside the space; moves are the files that go under the page's folder. Pages without id, or with a faulty reference, stay as they are.

    A page's references and the files of like names in its folder meet in one row; they are as many as its body names.
    """
    page = text.path_segment(F.coalesce("page_id", F.lit("")))
    rows = pages.select("path", F.when(F.trim(F.coalesce("page_id", F.lit(""))) != "", page).alias("_page"), "body")
    found = references(pages, files)
    held = found.groupBy("path").agg(F.collect_list(F.struct("at", "start", "end", "destination", "target")).alias("_refs"), F.max(F.col("issue") != "").alias("_faulty"))
    rows = rows.join(held, "path", "left")
    name = F.element_at(F.split("target", "/"), -1)
    key = lambda n: F.lower(F.regexp_replace(F.regexp_replace(n, r"\.[^.]*$", ""), r"-[0-9]+$", ""))
    stems = lambda n: F.array_distinct(F.array(key(n), F.lower(F.regexp_replace(n, r"\.[^.]*$", ""))))
    asked = found.join(rows.select("path", "_page"), "path").select("path", F.col("_page").alias("_owner"), F.explode(stems(name)).alias("_stem")).distinct()
    stored = files.select(text.clean_path(F.col("path")).alias("_file"))
    stored = stored.select("_file", text.owner_of_asset(F.col("_file")).alias("_owner"), F.explode(stems(F.element_at(F.split("_file", "/"), -1))).alias("_stem")).where("_owner IS NOT NULL")
    taken = asked.join(stored, ["_owner", "_stem"]).groupBy("path").agg(F.collect_set("_file").alias("_existing"))
    rows = rows.join(taken, "path", "left").withColumn("_refs", F.when(~F.coalesce("_faulty", F.lit(False)), F.col("_refs")))
    plan = rows.withColumn("_plan", _moved("path", "_page", "body", "_refs", "_existing"))
    return plan.select("path", F.col("_plan.body").alias("body"), F.col("_plan.moves").alias("moves"))


def _escaped(value: str, marks: str) -> str:
    for mark in marks:
        value = value.replace(mark, "\\" + mark)
    return value


@F.arrow_udf(T.StringType())
def _spans(body: pa.Array, refs: pa.Array) -> pa.Array:
    out = []
    for b, found in zip(body.to_pylist(), refs.to_pylist(), strict=True):
        for r in sorted(found or [], key=lambda r: -r["start"]):
            begin = r["start"] - len(r["text"]) - 3 - bool(r["image"])
            b = f'{b[:begin]}[{_escaped(r["name"], chr(92) + "[]")}]{{.media-inline media-id="{_escaped(r["id"], chr(92) + chr(34))}" media-type="{r["kind"]}"}}{b[r["end"] + 1 :]}'
        out.append(b)
    return pa.array(out, pa.string())


def inline_media(documents: DataFrame, files: DataFrame, attachments: DataFrame) -> DataFrame:
    """path and body of ``documents`` (path, body), each reference to a file replaced by a media span with the id that
    ``attachments`` (path, attachment_id) has for it, else a pending one. The name is the file's, without a leading id.
    Documents with a faulty reference stay as they are."""
    found = references(documents, files)
    ids = attachments.select(text.clean_path(F.col("path")).alias("target"), F.trim("attachment_id").alias("id")).where("id <> ''").dropDuplicates(["target"])
    found = found.join(ids, "target", "left").withColumn("id", F.coalesce("id", text.pending_id("attachment", F.col("target"))))
    name = text.filename_of_attachment(F.col("target"), text.path_segment(F.col("id")))
    kind = F.when(text.is_image(F.col("target")), "image").otherwise("file")
    spans = found.groupBy("path").agg(F.collect_list(F.struct("start", "end", "text", "image", "id", name.alias("name"), kind.alias("kind"))).alias("_refs"), F.max(F.col("issue") != "").alias("_faulty"))
    rows = documents.select("path", "body").join(spans, "path", "left")
    return rows.select("path", _spans("body", F.when(~F.coalesce("_faulty", F.lit(False)), F.col("_refs"))).alias("body"))
