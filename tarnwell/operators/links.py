"""Links and assets: resolution by joins, orphans, rewriting."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import markup, text


def resolve_page_links(links: DataFrame, local: DataFrame, everywhere: DataFrame) -> DataFrame:
    """``links`` (target page_id) with path and how: local, cross (another space), unresolved; the first that fits."""
    mine = local.select(F.col("page_id").alias("_m"), F.col("path").alias("_mp"))
    others = everywhere.select(F.col("page_id").alias("_o"), F.col("path").alias("_op"))
    rows = links.join(mine, links["target"] == mine["_m"], "left").join(others, links["target"] == others["_o"], "left")
    how = F.when(F.col("_mp").isNotNull(), "local").when(F.col("_op").isNotNull(), "cross").otherwise("unresolved")
    return rows.select(*links.columns, F.coalesce("_mp", "_op", F.lit("")).alias("path"), how.alias("how"))


def page_ids_of_links(links: DataFrame, local: DataFrame, everywhere: DataFrame) -> DataFrame:
    """``links`` (source_path, destination) with target (path), page_id, anchor and how: passed (external or an anchor alone),
    local, cross (in another space's index) or unresolved. A relative destination starts at its file's directory."""
    bare = text.strip(F.substring_index("destination", "#", 1))
    anchor = F.when(F.contains("destination", F.lit("#")), F.regexp_extract("destination", r"#(.*)$", 1)).otherwise("")
    passed = text.is_external(F.col("destination")) | (bare == "")
    inside = F.concat(F.regexp_replace("source_path", "[^/]*$", ""), text.percent_decode(bare))
    rows = links.withColumns({"target": F.when(passed, "").otherwise(text.clean_path(inside)), "anchor": anchor, "_passed": passed})
    mine = local.select(F.col("path").alias("_mp"), F.col("page_id").alias("_m"))
    others = everywhere.groupBy(F.col("path").alias("_op")).agg(F.min("page_id").alias("_o"))
    rows = rows.join(mine, rows["target"] == mine["_mp"], "left").join(others, F.col("target") == others["_op"], "left")
    how = F.when(F.col("_passed"), "passed").when(F.col("_m").isNotNull(), "local").when(F.col("_o").isNotNull(), "cross").otherwise("unresolved")
    return rows.select(*links.columns, "target", F.when(F.col("_passed"), F.lit(None)).otherwise(F.coalesce("_m", "_o")).alias("page_id"), "anchor", how.alias("how"))


def relink_targets(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``index`` (page_id, path) whose ids ``wanted`` (page_id) holds; all of them if it holds none."""
    some = wanted.select("page_id").distinct()
    if not some.limit(1).count():
        return index
    return index.join(some, "page_id", "left_semi")


def merge_indexes(frontmatter: DataFrame, state: DataFrame) -> DataFrame:
    """page_id and path; a file's own id wins over the state's, the least path over others."""
    both = frontmatter.select("page_id", "path", F.lit(0).alias("rank")).unionByName(state.select("page_id", "path", F.lit(1).alias("rank")))
    return both.groupBy("page_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def media_by_filename(references: DataFrame, attachments: DataFrame) -> DataFrame:
    """``references`` (filename) with attachment_id where exactly one attachment has the name, ignoring case and space."""
    key = lambda c: F.lower(text.strip(F.col(c)))
    single = attachments.groupBy(key("filename").alias("_k")).agg(F.collect_set("attachment_id").alias("_ids")).where(F.size("_ids") == 1).select("_k", F.col("_ids")[0].alias("attachment_id"))
    return references.withColumn("_k", key("filename")).join(single, "_k", "left").drop("_k").withColumn("attachment_id", F.coalesce("attachment_id", F.lit("")))


def orphan_assets(assets: DataFrame, references: DataFrame) -> DataFrame:
    """Assets that no document refers to."""
    return assets.join(references.select("path").distinct(), "path", "left_anti").select("path")


def attachment_drift(referenced: DataFrame, tracked: DataFrame, files: DataFrame, remote: DataFrame) -> DataFrame:
    """path and issue: missing file, untracked file, unreferenced, gone remotely."""
    anti = lambda a, b, issue: a.select("path").distinct().join(b.select("path").distinct(), "path", "left_anti").withColumn("issue", F.lit(issue))
    return (
        anti(referenced, files, "missing_file")
        .unionByName(anti(files, tracked, "untracked_file"))
        .unionByName(anti(tracked, referenced, "unreferenced"))
        .unionByName(anti(tracked, remote, "gone_remotely"))
    )


def extract_links(documents: DataFrame) -> DataFrame:
    """One row per inline link or image of ``documents`` (path, body)."""
    rows = documents.select("path", F.explode(markup.parse_links(F.col("body"))).alias("link"))
    return rows.select("path", "link.*").withColumn("destination", text.destination(F.col("destination")))


def planned_links(documents: DataFrame) -> DataFrame:
    """path, text, destination, image and by_reference of all links of ``documents`` (path, body): also those by reference, which
    a plan knows but rewrite() leaves as they are."""
    both = F.concat(
        F.transform(markup.parse_links(F.col("body")), lambda x: F.struct(x.text, x.destination, x.image, F.lit(False).alias("by_reference"))),
        F.transform(markup.parse_references(F.col("body")), lambda x: F.struct(x.text, x.destination, x.image, F.lit(True).alias("by_reference"))),
    )
    rows = documents.select("path", F.explode(both).alias("link")).select("path", "link.*")
    return rows.withColumn("destination", text.destination(F.col("destination")))


_DESTINATION = re.compile(r"(\s*)(<[^>]*>|\S*)(.*)$", re.S)


def with_destination(raw: str, new: str) -> str:
    """A link's raw destination with ``new`` in its place, angle brackets and title kept."""
    lead, old, rest = _DESTINATION.match(raw).groups()
    return f"{lead}<{new}>{rest}" if old.startswith("<") else f"{lead}{new}{rest}"


def relative(source: str, target: str) -> str:
    return quote(posixpath.relpath(target, posixpath.dirname(source) or "."))


def rewrite(documents: DataFrame) -> DataFrame:
    """``documents`` (path, body, targets: map of old destination to new path) with body rewritten and converted counted."""

    @F.arrow_udf("struct<body:string,converted:int>")
    def run(path: pa.Array, body: pa.Array, targets: pa.Array) -> pa.Array:
        out = []
        for p, b, t in zip(path.to_pylist(), body.to_pylist(), targets.to_pylist(), strict=True):
            known, count = dict(t or []), 0
            for link in reversed(markup.links(b or "")):
                raw = link["destination"]
                bare, mark, anchor = _DESTINATION.match(raw)[2].strip("<>").partition("#")
                if bare in known:
                    b = b[: link["start"]] + with_destination(raw, relative(p, known[bare]) + mark + anchor) + b[link["end"] :]
                    count += 1
            out.append({"body": b, "converted": count})
        return pa.array(out, pa.struct([("body", pa.string()), ("converted", pa.int32())]))

    rows = documents.withColumn("_r", run("path", "body", "targets"))
    return rows.withColumns({"body": F.col("_r.body"), "converted": F.col("_r.converted")}).drop("_r")


def relink_totals(rewritten: DataFrame) -> DataFrame:
    return rewritten.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("converted") > 0).alias("changed"), F.coalesce(F.sum("converted"), F.lit(0)).alias("links"))
