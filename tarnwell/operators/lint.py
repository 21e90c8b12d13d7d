"""Validation and consistency rules: each gives rows of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text
from tarnwell.operators import assets, links

#: How severe each kind of issue is, and whether it can be repaired without asking.
SEVERITY = {
    "missing-file": ("error", True),
    "id-mismatch": ("error", False),
    "empty-index-entry": ("error", True),
    "unreadable-file": ("error", False),
    "conflict-markers": ("error", False),
    "unknown-media-placeholder": ("warning", False),
    "embedded-content-placeholder": ("warning", False),
    "untracked-id": ("warning", True),
    "hierarchy-layout": ("warning", False),
}

#: Codes with a category of their own, and whether they ask for action.
DIAGNOSTICS = {
    "CROSS_SPACE_LINK_PRESERVED": ("preserved_external_link", False),
    "unresolved_reference": ("degraded_reference", True),
    "STRICT_PATH_REFERENCE_BROKEN": ("blocking_reference", True),
    "PAGE_PATH_MOVED": ("path_change", False),
}


def issues(*rules: tuple[Column, str, str]) -> Column:
    """An array of (field, code) of the rules (condition, field, code) that hold."""
    made = [F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))) for on, field, code in rules]
    return F.array_compact(F.array(*made))


def schema_issues(pages: DataFrame) -> DataFrame:
    """field and code for pages (path, id, version, state, labels)."""
    state = F.lower(text.strip(F.coalesce("state", F.lit(""))))
    found = issues(
        ((F.coalesce("id", F.lit("")) != "") & (F.coalesce("version", F.lit(0)) <= 0), "version", "invalid"),
        (~state.isin("", "current", "draft"), "state", "invalid"),
        (F.exists("labels", lambda x: text.strip(x) == ""), "labels", "empty"),
        (F.exists("labels", lambda x: text.has_space(text.strip(x))), "labels", "invalid"),
    )
    return pages.select("path", F.explode(found).alias("i")).select("path", "i.field", "i.code")


def immutable_issues(pages: DataFrame, baseline: DataFrame) -> DataFrame:
    """An id that changed, or a published page that became a draft, since ``baseline``."""
    old = baseline.select("path", F.col("id").alias("old_id"), text.lifecycle(F.col("state")).alias("old_state"))
    now = text.lifecycle(F.col("state"))
    found = issues(
        ((F.col("old_id") != "") & (F.coalesce("id", F.lit("")) != F.col("old_id")), "id", "immutable"),
        ((F.coalesce("id", F.lit("")) != "") & (F.col("old_state") == "current") & (now == "draft"), "state", "immutable"),
    )
    return pages.join(old, "path").select("path", F.explode(found).alias("i")).select("path", "i.field", "i.code")


def tracked_id_issues(pages: DataFrame, tracked: DataFrame) -> DataFrame:
    """Pages (path, id) whose path ``tracked`` (path, page_id) knows under an id that they miss or changed."""
    known = tracked.select("path", text.strip(F.col("page_id")).alias("tracked")).where("tracked <> ''")
    own = text.strip(F.coalesce("id", F.lit("")))
    rows = pages.join(known, "path").withColumn("code", F.when(own == "", "missing").when(own != F.col("tracked"), "changed"))
    return rows.where("code IS NOT NULL").select("path", "tracked", "code")


def duplicate_ids(pages: DataFrame) -> DataFrame:
    """page_id and its paths, where there is more than one."""
    return pages.where("page_id <> ''").groupBy("page_id").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def duplicate_folder_titles(paths: DataFrame) -> DataFrame:
    """Names of directories without an index page that occur at more than one place."""
    inside = paths.where(F.instr("path", "/") > 0)
    parts = F.split("path", "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = inside.select(F.explode(places).alias("directory")).distinct()
    named = folders.withColumn("title", F.element_at(F.split("directory", "/"), -1))
    index = paths.select(F.col("path").alias("_index"))
    pure = named.join(index, F.concat("directory", F.lit("/"), "title", F.lit(".md")) == F.col("_index"), "left_anti")
    return pure.groupBy("title").agg(F.array_sort(F.collect_set("directory")).alias("directories")).where(F.size("directories") > 1)


def sibling_titles(pages: DataFrame) -> DataFrame:
    """Pages whose directory holds another page of the same title, ignoring case; the least other path."""
    rows = pages.select("path", F.regexp_replace("path", "[^/]*$", "").alias("directory"), F.lower("title").alias("key"))
    groups = rows.groupBy("directory", "key").agg(F.min("path").alias("least"), F.max("path").alias("most")).where("least <> most")
    second = rows.join(groups, ["directory", "key"]).where("path <> least").groupBy("directory", "key").agg(F.min("path").alias("second"))
    found = rows.join(groups, ["directory", "key"]).join(second, ["directory", "key"])
    return found.select("path", F.when(F.col("path") == F.col("least"), F.col("second")).otherwise(F.col("least")).alias("other"))


def hierarchy_issues(paths: DataFrame) -> DataFrame:
    """Pages beside a directory of their own name that holds pages: such a page belongs inside it."""
    inside = paths.where(F.instr("path", "/") > 0)
    parts = F.split("path", "/")
    above = inside.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("directory")).distinct()
    return paths.withColumn("directory", F.regexp_replace("path", r"\.md$", "")).join(above, "directory", "left_semi").select("path")


def file_issues(documents: DataFrame, files: DataFrame, local: DataFrame, everywhere: DataFrame) -> DataFrame:
    """path, code and message of what keeps ``documents`` (path, fm, error: read_documents()) from being pushed.

    A file that can't be read has a read_error and nothing else. Others have a conversion_error if a reference to a file is
    at fault (``files`` has the paths that exist) or a link to a page resolves nowhere (``local`` and ``everywhere`` have path and page_id): the
    first one in the body is told.
    """
    unread = documents.where("error <> ''").select("path", F.lit("read_error").alias("code"), F.col("error").alias("message"))
    bodies = documents.where("error = ''").select("path", F.col("fm.body").alias("body"))
    faults = assets.references(bodies, files).where("issue <> ''").select("path", "start", F.concat("issue", F.lit(": "), "target").alias("message"))
    pages = links.extract_links(bodies).where(~F.col("image") & F.lower(F.regexp_replace("destination", r"[#?].*$", "")).endswith(".md"))
    pages = pages.select(F.col("path").alias("source_path"), "start", "destination")
    broken = links.page_ids_of_links(pages, local, everywhere).where("how = 'unresolved'").select(F.col("source_path").alias("path"), "start", F.concat(F.lit("unresolved: "), "target").alias("message"))
    first = faults.unionByName(broken).groupBy("path").agg(F.min_by("message", "start").alias("message"))
    return unread.unionByName(first.select("path", F.lit("conversion_error").alias("code"), "message"))


def doctor(state: DataFrame, files: DataFrame) -> DataFrame:
    """path, kind, severity and repairable: tracked pages (path, page_id) against files (path, page_id, body and, where it is
    known, error: a file with one can't be read)."""
    broken = F.coalesce("error", F.lit("")) != "" if "error" in files.columns else F.lit(False)
    f = files.select("path", F.col("page_id").alias("file_id"), F.when(broken, "").otherwise(F.col("body")).alias("body"), broken.alias("_broken"))
    both = state.join(f, "path", "left")
    kind = F.when((F.col("path") == "") | (F.col("page_id") == ""), "empty-index-entry").when(F.col("_broken"), "unreadable-file").when(F.col("body").isNull(), "missing-file").when(F.coalesce("file_id", F.lit("")) != F.col("page_id"), "id-mismatch")
    tracked = both.select("path", kind.alias("kind")).where("kind IS NOT NULL")
    marks = [
        (text.has_conflict_marker(F.col("body")), "conflict-markers"),
        (F.contains("body", F.lit("UNKNOWN_MEDIA_ID")), "unknown-media-placeholder"),
        (F.contains("body", F.lit("[Embedded content]")), "embedded-content-placeholder"),
    ]
    content = f.select("path", F.explode(F.array_compact(F.array(*[F.when(on, F.lit(k)) for on, k in marks]))).alias("kind"))
    untracked = f.where("coalesce(file_id, '') <> ''").join(state.select("page_id"), F.col("file_id") == F.col("page_id"), "left_anti").select("path", F.lit("untracked-id").alias("kind"))
    found = tracked.unionByName(content).unionByName(untracked).unionByName(hierarchy_issues(files.select("path")).withColumn("kind", F.lit("hierarchy-layout")))
    severity, repairable = F.lit(""), F.lit(False)
    for k, (s, r) in SEVERITY.items():
        severity = F.when(F.col("kind") == k, s).otherwise(severity)
        repairable = F.when(F.col("kind") == k, F.lit(r)).otherwise(repairable)
    return found.withColumns({"severity": severity, "repairable": repairable})


def sorted_issues(found: DataFrame) -> DataFrame:
    return found.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "path", "kind")


def repaired_state(state: DataFrame, files: DataFrame) -> DataFrame:
    """``state`` without stale and empty entries, with untracked files added."""
    f = files.where("coalesce(page_id, '') <> ''").select("path", "page_id")
    live = state.where("path <> '' AND page_id <> ''").join(files.select("path"), "path", "left_semi").select("path", "page_id")
    return live.unionByName(f.join(live.select("page_id"), "page_id", "left_anti").select("path", "page_id"))


def diagnostic_category(code: Column) -> tuple[Column, Column]:
    """Category of a diagnostic's code and whether it asks for action; unknown codes are degraded content."""
    code = text.strip(code)
    category, action = F.lit("degraded_content"), F.lit(False)
    for known, (name, asks) in DIAGNOSTICS.items():
        category, action = F.when(code == known, name).otherwise(category), F.when(code == known, F.lit(asks)).otherwise(action)
    return category, action


def label_sync(pages: DataFrame) -> DataFrame:
    """add and remove for pages (page_id, local, remote label arrays)."""
    mine, theirs = text.labels(F.col("local")), text.labels(F.col("remote"))
    return pages.select("page_id", F.array_sort(F.array_except(mine, theirs)).alias("add"), F.array_sort(F.array_except(theirs, mine)).alias("remove"))


def metadata_drift(pages: DataFrame) -> DataFrame:
    """Which of state, status and labels differ between local and remote."""
    differs = lambda c: F.when(~F.col(f"local_{c}").eqNullSafe(F.col(f"remote_{c}")), F.lit(c))
    return pages.select("page_id", F.array_compact(F.array(differs("state"), differs("status"), differs("labels"))).alias("drift"))
