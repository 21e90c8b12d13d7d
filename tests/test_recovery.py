from tarnwell.operators import recovery


def frames(spark):
    branches = spark.createDataFrame([("sync/A/1",), ("sync/A/1",), ("sync/B/2",), ("sync/B/3",), ("sync/A/x/y",), ("sync//4",), ("main",)], "name string")
    snapshots = spark.createDataFrame([("refs/sync/snapshots/A/1",), ("refs/sync/snapshots/B/2",), ("refs/sync/snapshots/C/9",), ("refs/heads/z",)], "ref string")
    worktrees = spark.createDataFrame([("/w/b2", "sync/B/2", True), ("/w/a2", "sync/B/2", True), ("/w/gone", "sync/B/3", False), (" ", "sync/B/3", True)], "path string, branch string, there boolean")
    metadata = spark.createDataFrame([("B", "2", "other", None, " late ", "main"), ("D", "8", " d ", "r", None, None)], "space_key string, time string, sync_branch string, snapshot_ref string, failure_reason string, original_branch string")
    return branches, snapshots, worktrees, metadata


def test_clean_plan(spark):
    branches, snapshots, worktrees, _ = frames(spark)
    removable = spark.createDataFrame([("/w/a2",)], "path string")
    got = {(r["kind"], r["name"]): (r["action"], r["reason"], r["snapshot"]) for r in recovery.clean_plan(branches, snapshots, worktrees, removable, "sync/A/1").collect()}
    assert got == {
        ("branch", "sync/A/1"): ("keep", recovery.ON_HEAD, ""),
        ("branch", "sync/B/2"): ("keep", "linked worktree remains at /w/b2", ""),
        ("branch", "sync/B/3"): ("delete", "", ""),
        ("branch", "sync/A/x/y"): ("keep", recovery.UNMANAGED, ""),
        ("branch", "sync//4"): ("keep", recovery.UNMANAGED, ""),
        ("branch", "main"): ("keep", recovery.UNMANAGED, ""),
        ("snapshot", "refs/sync/snapshots/A/1"): ("keep", "its branch is kept", ""),
        ("snapshot", "refs/sync/snapshots/B/2"): ("keep", "its branch is kept", ""),
        ("snapshot", "refs/sync/snapshots/C/9"): ("delete", "", ""),
        ("snapshot", "refs/heads/z"): ("delete", "", ""),
    }


def test_recovery_runs(spark):
    branches, snapshots, worktrees, metadata = frames(spark)
    runs = recovery.recovery_runs(branches, snapshots, worktrees, metadata, "sync/A/1")
    assert [tuple(r) for r in recovery.sorted_runs(runs).collect()] == [
        ("A", "1", "sync/A/1", "refs/sync/snapshots/A/1", "", "", recovery.ON_HEAD),
        ("B", "2", "sync/B/2", "refs/sync/snapshots/B/2", "late", "main", "linked worktree remains at /w/a2"),
        ("B", "3", "sync/B/3", "", "", "", "safe to discard"),
        ("D", "8", "d", "r", "", "", "safe to discard"),
        ("C", "9", "sync/C/9", "refs/sync/snapshots/C/9", "", "", "safe to discard"),
    ]
    for selector in ("sync/B/2", "refs/sync/snapshots/B/2", "2", " B/2 "):
        assert [r["time"] for r in recovery.select_runs(runs, selector).collect()] == ["2"]
    assert recovery.recovery_runs(branches.limit(0), snapshots.limit(0), worktrees.limit(0), metadata.limit(0), "x").count() == 0
