import os
import time

from pyspark.sql import functions as F

from tarnwell.operators import changes
from tarnwell.sources import workspace
from tarnwell.streaming import incremental

PAGE = "---\nid: {id}\ntitle: {title}\nlabels: [b, A]\n---\nIntro\n## OAuth2 Flow\ntext\n### Token Refresh\n```go\nx\n```\n"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_scan_and_index_rows(spark, tmp_path):
    root = f"{tmp_path}/space"
    write(f"{root}/a.md", PAGE.format(id=1, title="One"))
    write(f"{root}/assets/b.md", "x")
    write(f"{root}/broken.md", "no frontmatter")
    files = workspace.scan(spark, root, workspace.SCANS["search"])
    assert sorted(r["path"] for r in files.select("path").collect()) == ["a.md", "broken.md"]
    rows = workspace.index_rows(files, "DEV").collect()
    assert sorted((r["id"], r["heading_text"], r["heading_level"], r["language"]) for r in rows) == [
        ("code:DEV/a.md:6", "Token Refresh", 3, "go"),
        ("page:DEV/a.md", "", 0, ""),
        ("section:DEV/a.md:2", "OAuth2 Flow", 2, ""),
        ("section:DEV/a.md:4", "Token Refresh", 3, ""),
    ]
    assert {tuple(r["labels"]) for r in rows} == {("a", "b")}


def test_states(spark):
    good = '{"watermark": "2026-02-01T09:00:00Z", "space_key": "K", "page_path_index": {"a//b.md": "1"}, "attachment_index": {}}'
    files = spark.createDataFrame([("s1", good), ("s2", ""), ("s3", "<<<<<<< x"), ("s4", "{bad"), ("s5", '{"watermark": "yesterday"}')], "path string, content string")
    found = workspace.states(files)
    assert {r["path"]: r["error"] for r in found.collect()} == {"s1": "", "s2": "empty", "s3": "conflict", "s4": "corrupt", "s5": "watermark"}
    assert [tuple(r) for r in workspace.tall(found.where("error = ''"), "page_path_index", "page_id").collect()] == [("K", "a/b.md", "1")]


def test_states_are_written_found_and_read_again(spark, tmp_path):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    spaces = frame([("K", "2026-02-01T09:00:00+01:00"), ("L", ""), ("BAD", "2026-13-01T09:00:00Z")], "space_key watermark")
    pages = frame([("K", "a//b.md", "2"), ("K", "a/b.md", "1"), ("K", "c.md", "3"), ("X", "d.md", "4")], "space_key path page_id")
    attachments, folders = frame([("L", "assets/1/f", "att")], "space_key path attachment_id"), frame([], "space_key path folder_id")
    for row in workspace.state_texts(spaces, pages, attachments, folders).collect():
        write(f"{tmp_path}/ws/{row['space_key']}/state.json", row["content"])
        write(f"{tmp_path}/ws/.hidden/{row['space_key']}/state.json", row["content"])
    found = workspace.states(workspace.state_files(spark, f"{tmp_path}/ws"))
    assert {(r["path"], r["error"], r["state"]["watermark"]) for r in found.collect()} == {("K", "", "2026-02-01T09:00:00+01:00"), ("L", "", "")}
    assert sorted(map(tuple, workspace.tall(found, "page_path_index", "page_id").collect())) == [("K", "a/b.md", "1"), ("K", "c.md", "3")]
    assert [tuple(r) for r in workspace.tall(found, "attachment_index", "attachment_id").collect()] == [("L", "assets/1/f", "att")]


def files_by_part(root):
    return {d: sorted(os.listdir(f"{root}/{d}")) for d in os.listdir(root) if d.startswith("_part=")}


def test_files_stream_into_the_index(spark, tmp_path):
    root, table = f"{tmp_path}/space", incremental.KeyedTable(spark, f"{tmp_path}/index", "path")
    run = lambda: incremental.follow_files(spark, root, "DEV", table, f"{tmp_path}/checkpoint").awaitTermination(120)
    write(f"{root}/a.md", PAGE.format(id=1, title="One"))
    write(f"{root}/b.md", PAGE.format(id=2, title="Two"))
    run()
    assert table.read().where("type = 'page'").count() == 2
    time.sleep(1.1)
    write(f"{root}/c.md", PAGE.format(id=3, title="Three"))
    run()
    assert {r["title"] for r in table.read().where("type = 'page'").collect()} == {"One", "Two", "Three"}
    changed = table.read().where("path = 'DEV/a.md'").withColumn("title", F.lit("Again"))
    table.change(changed, spark.createDataFrame([("DEV/b.md",)], "path string"))
    assert {r["title"] for r in table.read().where("type = 'page'").collect()} == {"Again", "Three"}


def test_changes_touch_only_their_partitions(spark, tmp_path):
    table = incremental.KeyedTable(spark, f"{tmp_path}/t", "id", 8)
    assert table.read() is None
    rows = spark.range(100).select(F.col("id"), F.lit("a").alias("v")).union(spark.range(100).select("id", F.lit("b").alias("v")))
    table.change(rows)
    before = files_by_part(f"{tmp_path}/t")
    assert table.read().count() == 200 and len(before) == 8
    new = spark.createDataFrame([(5, "c"), (None, "lost")], "id long, v string")
    for _ in range(2):  # repeating changes nothing
        table.change(new)
        assert sorted(r["v"] for r in table.read().where("id = 5").collect()) == ["c"] and table.read().count() == 199
    after = files_by_part(f"{tmp_path}/t")
    assert sum(before[d] != after[d] for d in before) == 1
    table.change(new.limit(0), spark.range(100))
    assert table.read().count() == 0 and len(files_by_part(f"{tmp_path}/t")) == 8
    table.change(new)
    assert [tuple(r) for r in table.read().collect()] == [(5, "c")]


def test_increments_equal_a_full_build(spark, tmp_path):
    root, stamp = f"{tmp_path}/space", f"{tmp_path}/stamp"
    table = incremental.KeyedTable(spark, f"{tmp_path}/index", "path", 8)
    step = lambda t=table, s=stamp: incremental.index_increment(spark, root, "DEV", t, s)
    for k in range(6):
        write(f"{root}/{k}.md", PAGE.format(id=k, title=f"T{k}"))
        os.utime(f"{root}/{k}.md", (1_700_000_000, 1_700_000_000))
    assert step() == 6 and incremental.last_indexed(spark, stamp) is not None
    first = incremental.last_indexed(spark, stamp)
    assert step() == 0 and incremental.last_indexed(spark, stamp) == first  # nothing changed: no new stamp
    write(f"{root}/1.md", PAGE.format(id=1, title="Changed"))
    write(f"{root}/7.md", PAGE.format(id=7, title="New"))
    os.remove(f"{root}/2.md")
    assert step() == 3
    full = incremental.KeyedTable(spark, f"{tmp_path}/full", "path", 8)
    step(full, f"{tmp_path}/other")
    want = sorted(map(str, full.read().collect()))
    assert sorted(map(str, table.read().select(full.read().columns).collect())) == want and len({r["path"] for r in full.read().collect()}) == 6


def test_change_feed_stream_matches_batch(spark, tmp_path):
    rows = [(i % 3, f"K{i}" if i % 2 else "", f"t{i}" if i % 5 else "", (i * 7) % 20, i) for i in range(1, 20)] + [(9, "K", "a", 1, 1), (9, "L", "b", 2, 2)]
    feed = spark.createDataFrame(rows, "page_id long, space_key string, title string, version int, seq long").withColumn("last_modified", F.timestamp_seconds("seq"))
    want = sorted(map(str, changes.merge_changes(feed).collect()))
    splits = {"forward": ["seq <= 1", "seq BETWEEN 2 AND 10", "seq > 10"], "late": ["seq > 10", "seq <= 10"], "again": ["seq % 2 = 0", "TRUE"]}
    for name, parts in splits.items():
        table = incremental.KeyedTable(spark, f"{tmp_path}/{name}", "page_id", 4)
        for part in parts:
            feed.where(part).write.mode("append").parquet(f"{tmp_path}/feed-{name}")
            stream = spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/feed-{name}")
            incremental.follow_changes(stream, table, f"{tmp_path}/checkpoint-{name}").awaitTermination(120)
        assert sorted(map(str, table.read().select("page_id", "space_key", "title", "version", "last_modified").collect())) == want
