"""Shared helpers: cutting lineage, gapless numbering, Arrow iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a Python step turns from Arrow into objects at once.
SLICE_ROWS = 256
#: Bytes of text after which such a slice ends.
SLICE_BYTES = 1 << 24
PIECE_BYTES = 1 << 22
#: Bits of a filter of keys: so many for each key, and all of them at most.
KEY_BITS, FILTER_BITS = 16, 1 << 26
#: Lets a write remove the shuffle files that led to it.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or a temporary one in local mode if that is unset."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarnwell-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that what follows neither repeats nor loses it."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def gapless(df: DataFrame, group: str, name: str) -> DataFrame:
    """Adds the long column ``name``: 0, 1, 2... within each value of ``group``.

    No group is brought together: rows are numbered within (group, input partition) and each such block starts
    where the blocks before it end. The result rests on a checkpoint, so a recomputed task finds the same blocks.
    """
    rows = cut(df.withColumns({"_block": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    blocks = rows.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(group, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy("_at")) - 1
    return (
        rows.withColumn("_inside", inside)
        .join(starts, [group, "_block"])
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_block", "_at", "_start", "_inside")
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def within(batches: Iterator[pa.RecordBatch], column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, whose texts in ``column`` take ``size`` bytes at most but for the last."""
    for batch in slices(batches, rows):
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for at, length in enumerate(lengths.tolist(), 1):
            total += length
            if total >= size or at == batch.num_rows:
                yield batch.slice(start, at - start)
                start, total = at, 0


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of about PIECE_BYTES, cut at spaces."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        if end < len(text):
            end = text.rfind(b" ", start, end) + 1 or text.find(b" ", end) + 1 or len(text)
        yield text[start:end]
        start = end


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Bits (uint64 words, a power of two of them) that passes() asks for the values of the column ``key`` (long, evenly spread).

    One bit a key, KEY_BITS as many in all, so that one of 16 other keys passes too; beyond FILTER_BITS, more of them do.
    """
    bits = 64
    while bits < min(FILTER_BITS, KEY_BITS * keys.count()):
        bits *= 2
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({key} & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (int64) a filter lets through: all that it was made of, and few others."""
    at = keys.view(np.uint64) & np.uint64(64 * len(held) - 1)
    return (held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def store(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder in the shared checkpoint folder, and read again. Shuffle files that the write
    leaves go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.parquet(path)
