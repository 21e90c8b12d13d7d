"""Incremental and streaming maintenance: an index that follows files, page state that follows a change feed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwell.operators import changes
from tarnwell.sources import workspace

PARTS = 64


class KeyedTable:
    """A Parquet table whose rows are found by a key, in partitions by a hash of it.

    A change rewrites the partitions of its own keys, by dynamic partition overwrite: new files stand beside the old ones
    until the job commits, and other partitions keep their files. Each partition has one row without key, so that one whose
    rows all go is overwritten too. A commit that fails half-way leaves some partitions new and others old; the same change
    again mends that. Writers of different partitions don't meet; of one partition the last wins.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.key, self.parts = spark, root.rstrip("/"), key, parts

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _stored(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_part=*")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return self.spark.read.parquet(self.root) if there is not None and len(there) else None

    def read(self) -> DataFrame | None:
        """All rows; None before the first change."""
        stored = self._stored()
        return None if stored is None else stored.where(F.col(self.key).isNotNull()).drop("_part")

    def change(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts ``rows`` (all rows of their keys) in the place of what their keys have, and drops the keys of ``gone``, in one
        commit. Repeating it changes nothing. Rows without key are left out."""
        rows = rows.where(F.col(self.key).isNotNull())
        keys = rows.select(self.key)
        keys = (keys if gone is None else keys.unionByName(gone.select(self.key))).distinct()
        touched = [r[0] for r in keys.select(self._part(F.col(self.key))).distinct().collect()]  # at most ``parts`` numbers
        stored = self._stored()
        if stored is not None:
            kept = stored.where(F.col("_part").isin(touched) & F.col(self.key).isNotNull()).drop("_part")
            rows = kept.join(keys, self.key, "left_anti").unionByName(rows, allowMissingColumns=True)
        markers = self.spark.createDataFrame([(p,) for p in touched], "_part int")
        rows = rows.withColumn("_part", self._part(F.col(self.key))).unionByName(markers, allowMissingColumns=True)
        written = rows.repartition(max(1, min(len(touched), self.parts)), "_part").write.mode("overwrite").partitionBy("_part")
        written.option("partitionOverwriteMode", "dynamic").parquet(self.root)


def last_indexed(spark: SparkSession, stamp: str) -> datetime | None:
    """The time up to which files are known to be indexed; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stamp}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(stamp).first()["at"]


def save_last_indexed(spark: SparkSession, stamp: str, at: datetime) -> None:
    spark.createDataFrame([(at,)], "at timestamp").coalesce(1).write.mode("overwrite").parquet(stamp)


def index_increment(spark: SparkSession, root: str, space: str, table: KeyedTable, stamp: str) -> int:
    """Brings ``table`` (keyed by path) up to what lies below ``root``; returns how many paths it indexed or dropped.

    Files changed since the last stamp are parsed and replace the rows of their paths, and indexed paths that are no longer on
    disk go, in one commit. The new stamp is the time before the walk, so that a file changed during it is read again next
    time; it is saved after the commit, and only if something changed. Without a stamp all files are read.
    """
    rule = workspace.SCANS["search"]
    began = spark.sql("SELECT date_trunc('second', current_timestamp()) - INTERVAL 1 SECOND AS at").first()["at"]
    since = last_indexed(spark, stamp)
    after = since and spark.sql(f"SELECT date_format(TIMESTAMP '{since.isoformat(sep=' ')}', \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
    changed = workspace.index_rows(workspace.scan(spark, root, rule, after), space).cache()
    on_disk = workspace.scan(spark, root, rule).select(F.concat(F.lit(f"{space}/"), "path").alias("path"))
    stored = table.read()
    gone = None if stored is None else stored.where(F.col("space_key") == space).select("path").distinct().join(on_disk, "path", "left_anti")
    count = changed.select("path").distinct().count() + (0 if gone is None else gone.count())
    if count:
        table.change(changed, gone)
        save_last_indexed(spark, stamp, began)
    changed.unpersist()
    return count


def follow_files(spark: SparkSession, root: str, space: str, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Indexes Markdown files as they appear or change below ``root``; stops when it has caught up."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    relative = F.substring_index("path", root.rstrip("/") + "/", -1)
    found = files.select(relative.alias("path"), F.col("modificationTime").alias("mod_time"), F.decode("content", "UTF-8").alias("content")).where(workspace.takes(F.col("path"), workspace.SCANS["search"]))

    def apply(batch: DataFrame, _: int) -> None:
        table.change(workspace.index_rows(batch, space))

    return found.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_changes(feed: DataFrame, table: KeyedTable, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps ``table`` (keyed by page_id) at what merge_changes() gives of all that a streaming change feed has brought.

    It is the batch operator itself, as a stateful aggregate: the state of a page knows the arrival of its title and space, so
    the split into micro-batches, late and re-read events change nothing. A batch writes the pages that it changed.
    """

    def apply(batch: DataFrame, _: int) -> None:
        table.change(batch)
        if on_batch:
            on_batch(batch)

    merged = changes.merge_changes(feed)
    return merged.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_within(feed: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Streaming feed without repeated events of a page's version, remembered for ``delay`` of event time."""
    return feed.withWatermark("last_modified", delay).dropDuplicatesWithinWatermark(["page_id", "version"])
