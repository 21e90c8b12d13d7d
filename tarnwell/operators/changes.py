"""Change and drift detection between local, tracked and remote pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP_MINUTES = 5
CONFIRM_FILES = 10


def since(watermark):
    """Lower bound of a feed read: the watermark less the overlap, to the minute."""
    return F.date_trunc("minute", watermark - F.expr(f"INTERVAL {OVERLAP_MINUTES} MINUTES"))


def merge_changes(feed: DataFrame) -> DataFrame:
    """One row per page: its first non-empty space and title by arrival, greatest version and time."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c)
    return feed.groupBy("page_id").agg(first("space_key"), first("title"), F.max("version").alias("version"), F.max("last_modified").alias("last_modified"))


def changed_pages(feed: DataFrame, remote: DataFrame, local: DataFrame, moved: DataFrame | None = None, force: bool = False) -> DataFrame:
    """page_id of what must be read again: listed changes, untracked pages, newer versions and moved paths."""
    if force:
        return remote.select("page_id").distinct()
    listed = remote.select("page_id")
    out = feed.select("page_id").join(listed, "page_id", "left_semi")
    both = remote.join(local.select("page_id", F.col("version").alias("had")), "page_id", "left")
    out = out.union(both.where(F.col("had").isNull() | (F.col("version") > F.col("had"))).select("page_id"))
    if moved is not None:
        out = out.union(moved.select("page_id"))
    return out.distinct()


def status(remote: DataFrame, local: DataFrame) -> DataFrame:
    """page_id, state (added, modified, same, deleted) and drift in versions; an unreadable local version counts as 0."""
    mine = local.select("page_id", F.coalesce("version", F.lit(0)).alias("had"), F.lit(True).alias("tracked"))
    both = remote.select("page_id", "version").join(mine, "page_id", "full_outer")
    state = F.when(F.col("version").isNull(), "deleted").when(F.col("tracked").isNull(), "added").when(F.col("version") > F.col("had"), "modified").otherwise("same")
    return both.select("page_id", state.alias("state"), F.when(state == "modified", F.col("version") - F.col("had")).otherwise(0).alias("drift"))


def status_summary(report: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return report.agg(count("added"), count("modified"), count("deleted"), F.coalesce(F.max("drift"), F.lit(0)).alias("max_drift"))


def deleted_pages(remote: DataFrame, local: DataFrame) -> DataFrame:
    return local.join(remote, "page_id", "left_anti").select("page_id")


def recovered_pages(listed: DataFrame, local: DataFrame, everything: DataFrame) -> DataFrame:
    """Tracked pages that a listing missed but a point lookup finds in a state that syncs."""
    missing = deleted_pages(listed, local)
    return missing.join(everything.where("syncable"), "page_id", "left_semi")


def high_watermark(feed: DataFrame, started) -> DataFrame:
    return feed.agg(F.greatest(F.max("last_modified"), started).alias("watermark"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and code (A, M, D) of what differs between two snapshots (path, content)."""
    a = before.select("path", F.sha2("content", 256).alias("old"))
    b = after.select("path", F.sha2("content", 256).alias("new"))
    code = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return a.join(b, "path", "full_outer").select("path", code.alias("code")).where("code IS NOT NULL")


def change_counts(changes: DataFrame) -> DataFrame:
    count = lambda c, n: F.count_if(F.col("code") == c).alias(n)
    return changes.agg(count("A", "added"), count("M", "modified"), count("D", "deleted"))


def needs_confirmation(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count(F.lit(1)).alias("files"), ((F.count(F.lit(1)) > CONFIRM_FILES) | F.coalesce(F.bool_or(F.col("code") == "D"), F.lit(False))).alias("confirm"))


def scoped_changes(changes: DataFrame, scope: str) -> DataFrame:
    """Markdown changes below ``scope``, outside assets; a changed type counts as modified, other codes are dropped."""
    inside = F.startswith(F.col("path"), F.lit(scope.rstrip("/") + "/")) if scope else F.lit(True)
    code = F.when(F.col("code") == "T", "M").when(F.col("code").isin("A", "M", "D"), F.col("code"))
    kept = inside & F.col("path").endswith(".md") & ~F.col("path").rlike("(^|/)assets/")
    return changes.where(kept).withColumn("code", code).where("code IS NOT NULL")


def conflict_ahead(local_modified: DataFrame, remote_modified: DataFrame) -> DataFrame:
    return local_modified.select("page_id").intersect(remote_modified.select("page_id"))


def next_version(changes: DataFrame, force: bool) -> DataFrame:
    """``changes`` (local, remote versions) with next: local + 1, or remote + 1 if forced and the remote is not behind."""
    plain = F.col("local") + 1
    return changes.withColumn("next", F.when(F.lit(force) & (F.col("remote") >= plain), F.col("remote") + 1).otherwise(plain))


def rebuild_state(local_ids: DataFrame, remote: DataFrame) -> DataFrame:
    """page_id and least path of local files whose page exists remotely."""
    return local_ids.groupBy("page_id").agg(F.min("path").alias("path")).join(remote, "page_id", "left_semi")


def meets_expected(version: Column, modified: Column, expected_version: Column, expected_modified: Column) -> Column:
    """Whether a page is as new as expected; an expected version of 0 or less, and times that are unknown, ask nothing."""
    old = (expected_version > 0) & (version < expected_version)
    early = modified < expected_modified
    return ~(F.coalesce(old, F.lit(False)) | F.coalesce(early, F.lit(False)))
