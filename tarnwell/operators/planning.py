"""What a push or pull would do, as rows; nothing here acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import markup, text

#: HTTP answers that mean a server lacks a capability.
LACKING = (404, 405, 501)
#: Bytes of a file that a frontmatter-only read looks at.
HEAD = 8192


def stale_attachments(index: DataFrame, references: DataFrame, pages: DataFrame) -> DataFrame:
    """path of the attachments (path, attachment_id) of ``pages`` (page_id) that no reference (page_id, attachment_id) keeps."""
    owned = index.withColumn("page_id", text.owner_of_asset(F.col("path"))).join(pages.select("page_id").distinct(), "page_id", "left_semi")
    return owned.join(references.select("page_id", "attachment_id").distinct(), ["page_id", "attachment_id"], "left_anti").select(text.clean_path(F.col("path")).alias("path"))


def attachment_plan(changes: DataFrame, references: DataFrame, index: DataFrame) -> DataFrame:
    """action (upload, delete) and path, for changed pages (path, page_id) and the assets they refer to (path, asset).

    A page without an id uploads all its assets under their own names.
    """
    used = references.join(changes.select("path", "page_id"), "path")
    name = F.element_at(F.split("asset", "/"), -1)
    planned = used.where("page_id <> ''").select(F.concat(F.lit("assets/"), "page_id", F.lit("/"), name).alias("path")).distinct()
    new = used.where("page_id = ''").select(F.concat("asset", F.lit(" (new page: "), "path", F.lit(")")).alias("path"))
    tracked = index.where("attachment_id <> ''").select("path")
    owners = changes.where("page_id <> ''").select(F.col("page_id").alias("_owner")).distinct()
    mine = index.select("path", text.owner_of_asset(F.col("path")).alias("_owner")).join(owners, "_owner", "left_semi").select("path")
    uploads = planned.join(tracked, "path", "left_anti").unionByName(new).withColumn("action", F.lit("upload"))
    deletes = mine.join(planned, "path", "left_anti").withColumn("action", F.lit("delete"))
    return uploads.unionByName(deletes).select("action", "path")


def content_states(pages: DataFrame, of_page: DataFrame, of_space: DataFrame, everywhere: DataFrame) -> DataFrame:
    """``pages`` (page_id, status) with state_id and how: page, space, global or unresolved; names match ignoring case."""
    key = lambda c: F.lower(text.strip(F.col(c)))
    level = lambda df, name: df.select(*(["page_id"] if name == "page" else []), key("name").alias("_k"), F.col("state_id").alias(f"_{name}"))
    rows = pages.where(F.coalesce(text.strip(F.col("status")), F.lit("")) != "").withColumn("_k", key("status"))
    rows = rows.join(level(of_page, "page"), ["page_id", "_k"], "left").join(level(of_space, "space"), "_k", "left").join(level(everywhere, "global"), "_k", "left")
    how = F.when(F.col("_page").isNotNull(), "page").when(F.col("_space").isNotNull(), "space").when(F.col("_global").isNotNull(), "global").otherwise("unresolved")
    return rows.select("page_id", "status", F.coalesce("_page", "_space", "_global").alias("state_id"), how.alias("how"))


def baseline(tags: DataFrame) -> DataFrame:
    """space and the tag of its greatest time stamp; tags of fewer than four parts don't count."""
    parts = F.split("tag", "/")
    rows = tags.where(F.size(parts) >= 4).select("tag", F.get(parts, F.lit(2)).alias("space"), F.element_at(parts, -1).alias("stamp"))
    return rows.groupBy("space").agg(F.max_by("tag", F.struct("stamp", "tag")).alias("tag"))


def display_names(pages: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """``pages`` with the display name of the user in ``column``, or the id where there is none."""
    known = users.select(F.col("user_id").alias("_u"), "display_name")
    rows = pages.join(known, F.col(column) == F.col("_u"), "left")
    return rows.withColumn("display_name", F.coalesce(F.nullif(text.strip(F.col("display_name")), F.lit("")), F.col(column))).drop("_u")


def media_by_file(references: DataFrame, attachments: DataFrame) -> DataFrame:
    """``references`` (file_id) with the attachment of the greatest id that has the file, or the file id itself."""
    latest = attachments.groupBy("file_id").agg(F.max("attachment_id").alias("attachment_id"))
    return references.join(latest, "file_id", "left").withColumn("attachment_id", F.coalesce("attachment_id", "file_id"))


def push_conflicts(changes: DataFrame, remote: DataFrame, force: bool = False) -> DataFrame:
    """path and error of changes (path, code, page_id, version) that the remote pages (page_id, status, version) refuse."""
    there = remote.select("page_id", F.lower(text.strip(F.col("status"))).alias("_status"), F.col("version").alias("_version"))
    rows = changes.where("page_id <> '' AND code <> 'D'").join(there, "page_id", "left")
    error = F.when(F.col("_version").isNull(), "missing").when(F.col("_status") == "archived", "archived").when(F.lit(not force) & (F.col("_version") > F.col("version")), "remote_ahead")
    return rows.select("path", error.alias("error")).where("error IS NOT NULL")


def capability_modes(probes: DataFrame) -> DataFrame:
    """capability, mode (full, degraded) of probes (capability, status): degraded if any answer says it is lacking."""
    lacking = F.bool_or(F.col("status").isin(*LACKING))
    return probes.groupBy("capability").agg(F.when(lacking, "degraded").otherwise("full").alias("mode"))


def fallback_modes(diagnostics: DataFrame) -> DataFrame:
    """run and its distinct fallback modes, sorted."""
    return diagnostics.where("coalesce(mode, '') <> ''").groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))


def top_level_nodes(document: Column) -> Column:
    """How many nodes a rich-text document has at its top; 0 if it isn't one."""
    return F.coalesce(F.json_array_length(F.get_json_object(document, "$.content")), F.lit(0))


def diagram_warnings(documents: DataFrame) -> DataFrame:
    """path, code and line of Mermaid fences, which stay code blocks."""
    rows = documents.select("path", F.explode(markup.parse_structure(F.col("body"))["code"]).alias("block"))
    return rows.where(F.lower(text.strip(F.col("block.language"))) == "mermaid").select("path", F.lit("MERMAID_PRESERVED_AS_CODEBLOCK").alias("code"), F.col("block.line").alias("line"))


def create_preview(pages: DataFrame, index: DataFrame, references: DataFrame) -> DataFrame:
    """path, parent, target and uploads of new pages (path, title): parent is the nearest directory that ``index`` knows."""
    from tarnwell.operators.hierarchy import nearest_parents

    uploads = references.groupBy("path").agg(F.count(F.lit(1)).alias("uploads"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = pages.join(nearest_parents(pages.select("path"), index), "path").join(uploads, "path", "left")
    return rows.select("path", "parent", F.concat(folder, text.markdown_name(F.col("title"))).alias("target"), F.coalesce("uploads", F.lit(0)).alias("uploads"))


def without_authors(documents: DataFrame) -> DataFrame:
    """Documents (struct fm) with the author and date fields blank, for comparison."""
    fm = F.col("fm")
    for field in ("created_by", "created_at", "updated_by", "updated_at"):
        fm = fm.withField(field, F.lit(""))
    return documents.withColumn("fm", fm)


def head_frontmatter(files: DataFrame) -> DataFrame:
    """fm from the first HEAD bytes only; a fence that closes later is an error."""
    return files.withColumn("fm", markup.parse_frontmatter(F.decode(F.substring(F.encode("content", "UTF-8"), 1, HEAD), "UTF-8")))


def is_below(path: Column) -> Column:
    """Whether a relative path stays inside its root."""
    return ~text.clean_path(path).rlike(r"^\.\.(/|$)") & ~F.startswith(path, F.lit("/"))
