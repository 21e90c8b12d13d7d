"""What failed or finished sync runs have left behind, as rows: what a clean-up would delete or keep and why, and a listing of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text

#: Where snapshots of a run are kept, before its space and time.
SNAPSHOTS = "refs/sync/snapshots"
ON_HEAD = "current HEAD is on this sync branch"
UNMANAGED = "branch does not match sync/<space>/<time>"


def _run(name: Column, prefix: str) -> tuple[Column, Column]:
    """Space and time of ``prefix``/<space>/<time>; null for other names."""
    parts = F.split(text.strip(name), "/")
    head = prefix.split("/")
    n = len(head)
    fits = (F.size(parts) == n + 2) & (F.array_join(F.slice(parts, 1, n), "/") == prefix) & (F.get(parts, F.lit(n)) != "") & (F.get(parts, F.lit(n + 1)) != "")
    return F.when(fits, F.get(parts, F.lit(n))), F.when(fits, F.get(parts, F.lit(n + 1)))


def _blocked(worktrees: DataFrame, removable: DataFrame | None = None) -> DataFrame:
    """name (of a branch) and blocked (why it must stay): its least worktree path that exists and isn't about to be removed."""
    rows = worktrees.where("there AND trim(path) <> ''")
    if removable is not None:
        rows = rows.join(removable.select("path").distinct(), "path", "left_anti")
    return rows.groupBy(F.col("branch").alias("name")).agg(F.concat(F.lit("linked worktree remains at "), F.min("path")).alias("blocked"))


def clean_plan(branches: DataFrame, snapshots: DataFrame, worktrees: DataFrame, removable: DataFrame, current: str, prefix: str = SNAPSHOTS) -> DataFrame:
    """kind (branch or snapshot), name, action (delete or keep), reason and snapshot (that goes with a branch).

    ``branches`` has name, ``snapshots`` ref, ``worktrees`` path, branch and there (whether the folder exists), ``removable`` path. A
    branch is kept for the first of these reasons: HEAD is on it, its name isn't a run's, a worktree that stays is linked to it. A
    snapshot is kept if its branch is kept for the first or the last. Repeated names count once.
    """
    space, time = _run(F.col("name"), "sync")
    refs = snapshots.select(F.col("ref").alias("snapshot")).distinct()
    rows = branches.select("name").distinct().withColumn("wanted", F.concat(F.lit(f"{prefix}/"), space, F.lit("/"), time))
    rows = rows.join(_blocked(worktrees, removable), "name", "left").join(refs, F.col("wanted") == F.col("snapshot"), "left")
    reason = F.when(F.col("name") == current, ON_HEAD).when(F.col("wanted").isNull(), UNMANAGED).when(F.col("blocked").isNotNull(), F.col("blocked")).otherwise("")
    rows = rows.withColumn("reason", reason)
    kept = rows.where(F.col("snapshot").isNotNull() & (F.col("reason") != "")).select("snapshot", F.lit(True).alias("_kept")).distinct()
    action = lambda keep: F.when(keep, "keep").otherwise("delete").alias("action")
    plan = rows.select(F.lit("branch").alias("kind"), "name", action(F.col("reason") != ""), "reason", F.when(F.col("reason") == "", F.coalesce("snapshot", F.lit(""))).otherwise("").alias("snapshot"))
    others = refs.join(kept, "snapshot", "left").select(F.lit("snapshot").alias("kind"), F.col("snapshot").alias("name"), action(F.coalesce("_kept", F.lit(False))), F.when(F.col("_kept"), "its branch is kept").otherwise("").alias("reason"), F.lit("").alias("snapshot"))
    return plan.unionByName(others)


def recovery_runs(branches: DataFrame, snapshots: DataFrame, worktrees: DataFrame, metadata: DataFrame, current: str, prefix: str = SNAPSHOTS) -> DataFrame:
    """space_key, time, branch, snapshot, failure, original and status of every run that a branch, a snapshot or a metadata file
    tells of; in the order of sorted_runs() if that is asked for.

    ``metadata`` has space_key, time, sync_branch, snapshot_ref, failure_reason and original_branch, one row for each run. What
    exists wins over what metadata says; a run of which only a snapshot is there has the branch name that it would have had.
    """
    space, time = _run(F.col("name"), "sync")
    mine = branches.select("name").distinct().join(_blocked(worktrees), "name", "left").select(space.alias("space_key"), time.alias("time"), F.col("name").alias("_branch"), "blocked").where("space_key IS NOT NULL")
    space, time = _run(F.col("ref"), prefix)
    refs = snapshots.select("ref").distinct().select(space.alias("space_key"), time.alias("time"), F.col("ref").alias("_ref")).where("space_key IS NOT NULL")
    rows = mine.join(refs, ["space_key", "time"], "full").join(metadata, ["space_key", "time"], "full")
    known = lambda c: F.coalesce(text.strip(F.col(c)), F.lit(""))
    made = F.when(F.col("_ref").isNotNull(), F.concat(F.lit("sync/"), "space_key", F.lit("/"), "time"))
    branch = F.coalesce("_branch", made, known("sync_branch"))
    status = F.when(F.col("_branch") == current, ON_HEAD).otherwise(F.coalesce("blocked", F.lit("safe to discard")))
    return rows.select("space_key", "time", branch.alias("branch"), F.coalesce("_ref", known("snapshot_ref")).alias("snapshot"), known("failure_reason").alias("failure"), known("original_branch").alias("original"), status.alias("status"))


def sorted_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("time", "space_key")


def select_runs(runs: DataFrame, selector: str) -> DataFrame:
    """The runs that a branch, a snapshot, a time or <space>/<time> names."""
    wanted = selector.strip()
    return runs.where((F.col("branch") == wanted) | (F.col("snapshot") == wanted) | (F.col("time") == wanted) | (F.concat_ws("/", "space_key", "time") == wanted))
