"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from the key; the largest of ``weight / -ln(u)`` wins. A shard's draw does not depend on
the other shards, so one shard more takes rows only into itself, and a weight changed moves rows only to or from that
shard. The whole choice is one projection without a shuffle.

Null keys are one key like any other, equal keys share a shard, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless

SHARDS = 16


def draw(key: Column, shard: int, weight: float) -> Column:
    """What ``shard`` bids for a key: larger weights win in proportion."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return F.lit(float(weight)) / -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53)))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard, 0 to len(weights) - 1; shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard needs a positive weight")
    bids = [F.struct(draw(key, i, w).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*bids))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with shard and grown_shard (the shard under the weights ``grown``; by default one more shard of weight 1).

    Other columns pass through unless their names clash with those two, which are replaced.
    """
    grown = [*weights, 1.0] if grown is None else grown
    return docs.withColumns({"shard": shard_of(F.col(key), weights), "grown_shard": shard_of(F.col(key), grown)})


def shard_slots(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot (gapless from 0 in each shard) for every row of ``docs``.

    A null text has no bytes (size 1). Repeated rows each get a slot of their own. Columns other than doc_id and text
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return gapless(assign_shards(rows, weights), "shard", "slot")
