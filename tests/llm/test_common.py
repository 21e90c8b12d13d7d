import glob
import os
import tempfile
import time

import numpy as np
from pyspark.sql import functions as F

from tarnwell.llm import common


def shuffle_files(spark):
    folder = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    return {f for top in {folder, "/tmp"} for f in glob.glob(f"{top}/**/blockmgr-*/*/shuffle_*.data", recursive=True)}


def test_store_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = spark.range(200_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert common.store(kept).count() == 5000
    end = time.time() + 10
    written = {f"{f}" for f in shuffle_files(spark) - before}
    while len(written) > 1 and time.time() < end:  # the count of the stored rows has its own
        time.sleep(0.2)
        written = shuffle_files(spark) - before
    assert len(written) <= 1


def test_filter_passes_all_its_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    held = common.key_filter(keys, "key")
    assert common.passes(held, keys.toArrow()["key"].to_numpy()).all()
    others = spark.range(100_000, 200_000).select(F.xxhash64("id").alias("key")).toArrow()["key"].to_numpy()
    assert 0 < common.passes(held, others).mean() < 0.1
    assert not common.passes(common.key_filter(keys.limit(0), "key"), others).any()


def test_filter_stays_within_its_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    held = common.key_filter(keys, "key")
    assert len(held) == 16 and held.dtype == np.uint64 and common.passes(held, keys.toArrow()["key"].to_numpy()).all()
