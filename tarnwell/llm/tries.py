"""Prefix trie of conversations as succinct level-order tries (LOUDS), one per prefix shard.

A conversation's first d turns are known by a number that composes: the sum of label * BASE ** place modulo a prime, the
label being a digest of role and text. Conversations are sorted by ranges, each range sums its own turns, and what a
conversation has before a range is added afterwards, so no task needs a whole conversation.

Nodes whose subtree has more than SUBTREE entries (pairs of a member and a depth) are heavy: these upper levels are merged
by aggregates over all entries, and rolled up by doubling. What hangs below them are subtrees of bounded size; those of a
shard form one LOUDS trie in numpy, rolled up in reverse level order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, store, within

#: Ids whose conversation starts with turns of the one that begins their run of FAMILY ids; of 0 to HEADS - 1 turns.
FAMILY, HEADS = 20, 4
SUBTREE = 4096
#: Entries of a shard, about.
SHARD = 1 << 16
CHUNK_BYTES = 1 << 16
PRIME, BASE = (1 << 127) - 1, 0x2F0B4C47C5D3A96B51E7D8A3F4961B0D
_INVERSE = [pow(BASE, -n, PRIME) for n in range(HEADS)]
_LOW = (1 << 64) - 1
_ROW = "conv_id long, block int, at long, run binary, before binary, words long"
_ENTRY = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, length long"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, p1 long, p2 long, top boolean"


def _label(role: bytes, text: bytes) -> bytes:
    return hashlib.md5(b"%d:%b%b" % (len(role), role, text)).digest()


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in within(batches, "text"):
        texts = as_bytes(batch.column("text"))
        labels = list(map(_label, as_bytes(batch.column("role")), texts))
        words = [len(t.split()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(labels, pa.binary()), pa.array(words, pa.int64())], ["conv_id", "turn", "label", "words"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each conversation's turns within a sorted range."""
    block = TaskContext.get().partitionId()
    last, at, run, power = None, 0, 0, 1
    for batch in batches:
        places, runs, befores = [], [], []
        for conv, label in zip(batch.column("conv_id").to_pylist(), batch.column("label").to_pylist(), strict=True):
            if conv != last:
                last, at, run, power = conv, 0, 0, 1
            at, power = at + 1, power * BASE % PRIME
            befores.append(run.to_bytes(16))
            run = (run + int.from_bytes(label) * power) % PRIME
            places.append(at)
            runs.append(run.to_bytes(16))
        columns = [batch.column("conv_id"), pa.array([block] * batch.num_rows, pa.int32()), pa.array(places, pa.int64()), pa.array(runs, pa.binary()), pa.array(befores, pa.binary()), batch.column("words")]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "at", "run", "before", "words"])


def _carried(starts: dict[tuple[int, int], tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to rows what their conversation has in earlier blocks: turns and sum by conversation and block."""

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if before := starts.get((row["conv_id"], row["block"])):
                    turns, total = before
                    power = pow(BASE, turns, PRIME)
                    row["at"] += turns
                    for name in ("run", "before"):
                        row[name] = ((total + int.from_bytes(row[name]) * power) % PRIME).to_bytes(16)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return carried


def running_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 1), run and before (sums with and without the turn), words of every turn, in order."""
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    labels = store(rows.mapInArrow(_labels, "conv_id long, turn long, label binary, words long"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("label")]
    blocks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = store(labels.repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(_running, _ROW))
    totals = found.groupBy("conv_id", "block").agg(F.max("at").alias("turns"), F.max_by("run", "at").alias("run"))
    split = totals.groupBy("conv_id").count().where("count > 1").select("conv_id")
    # a border between two ranges splits one conversation, so these rows are at most two for each range
    parts = totals.join(split, "conv_id").orderBy("conv_id", "block").collect()
    starts: dict[tuple[int, int], tuple[int, int]] = {}
    last, turned, total = None, 0, 0
    for row in parts:
        if row["conv_id"] != last:
            last, turned, total = row["conv_id"], 0, 0
        starts[last, row["block"]] = turned, total
        total = (total + int.from_bytes(row["run"]) * pow(BASE, turned, PRIME)) % PRIME
        turned += row["turns"]
    return found.mapInArrow(_carried(starts), _ROW) if starts else found


def _halves(value: int) -> tuple[int, int]:
    low = value & _LOW
    return value >> 64, low - (1 << 64) if low >> 63 else low


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of turns behind the head that their conversation gets: its sum, and theirs without the turns it replaces."""
    names = ["conv_id", "depth", "k1", "k2", "p1", "p2", "words", "length"]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            back, lead, skip = _INVERSE[r["h"] - r["k"]], int.from_bytes(r["lead"]), int.from_bytes(r["skip"])
            own, parent = ((lead + (int.from_bytes(r[c]) - skip) * back) % PRIME for c in ("run", "before"))
            out.append((r["conv_id"], r["at"] - r["h"] + r["k"], *_halves(own), *_halves(parent), r["words"], r["length"]))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def entries(turns: DataFrame) -> DataFrame:
    """One row for each rebuilt conversation and depth, 0 included: node (k1, k2), parent (p1, p2), words of the last turn,
    length of the conversation."""
    rows = running_turns(turns)
    zero = F.lit(bytes(16))
    head = F.when(F.col("at") < HEADS, F.struct("at", "run", "before", "words"))
    convs = rows.groupBy("conv_id").agg(F.max("at").alias("n"), F.sort_array(F.collect_list(head)).alias("heads"))
    convs = cut(convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")))
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    plan = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0))).cast("int")
    run = lambda heads, n: F.coalesce(F.expr(f"get({heads}, {n} - 1).run"), zero)
    plan = plan.withColumn("k", taken).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = cut(plan.select("conv_id", "h", "k", "length", run("base_heads", "k").alias("lead"), run("heads", "h").alias("skip"), F.slice("base_heads", 1, F.col("k")).alias("given")))
    roots = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "p1", "p2", "words")], "length")
    given = plan.select("conv_id", "length", F.explode("given").alias("t"), F.lit(0).alias("h"), F.lit(0).alias("k"), zero.alias("lead"), zero.alias("skip")).select("*", "t.*").drop("t")
    own = rows.select("conv_id", "at", "run", "before", "words").join(plan.drop("given"), "conv_id").where("at > h")
    moved = own.unionByName(given).mapInArrow(_moved, _ENTRY)
    return store(roots.unionByName(moved))


@dataclass
class Trie:
    """A level-order trie: bits (LOUDS: a one for each child of a node, then a zero) and the label of every node but the root,
    two rows of numbers. Children stand in the order of their labels."""

    bits: np.ndarray
    labels: np.ndarray

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Parent of every node: the j-th one is node j, and as many nodes are closed before it as its parent's number."""
        return np.concatenate(([0], np.cumsum(~self.bits)[self.bits]))

    def child(self, node: int, label: tuple[int, int]) -> int | None:
        closed = np.flatnonzero(~self.bits)
        begin, end = (closed[node - 1] + 1 if node else 0), closed[node]
        first = int(np.count_nonzero(self.bits[:begin])) + 1
        for at in range(first, first + int(end - begin)):
            if tuple(self.labels[:, at - 1].tolist()) == label:
                return at
        return None


def build_trie(level: np.ndarray, labels: np.ndarray) -> tuple[Trie, np.ndarray, list[int]]:
    """The trie of paths, the node of every entry and where each level's nodes begin.

    Entries (their level from 0, two rows of labels) stand path by path, each path from the top down.
    """
    node = np.zeros(len(level), np.int64)
    begins, degrees, held = [0, 1], [], []
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2 if len(level) else 1))
    for at in range(len(bounds) - 1):
        rows = by_level[bounds[at] : bounds[at + 1]]
        above = node[rows - 1] if at else np.zeros(len(rows), np.int64)
        found, place = np.unique(np.concatenate((above[None], labels[:, rows])), axis=1, return_inverse=True)
        node[rows] = begins[-1] + place.reshape(-1)
        degrees.append(np.bincount(found[0] - begins[-2], minlength=begins[-1] - begins[-2]))
        held.append(found[1:])
        begins.append(begins[-1] + found.shape[1])
    degree = np.concatenate([*degrees, np.zeros(begins[-1] - begins[-2], np.int64)])
    bits = np.ones(begins[-1] - 1 + len(degree), bool)
    bits[np.cumsum(degree + 1) - 1] = False
    return Trie(bits, np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)), node, begins


def _ends(convs: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, convs.tolist())).encode()).hexdigest()


_NONE = hashlib.sha256(b"").hexdigest()


def _shard(table: pa.Table) -> pa.Table:
    """All nodes of a shard's subtrees: a LOUDS trie below one root of its own, which is left out."""
    col = {c: table[c].to_numpy() for c in ("conv_id", "depth", "k1", "k2", "p1", "p2", "words", "length", "stem", "top_conv")}
    order = np.lexsort((col["depth"], col["conv_id"]))
    col = {c: v[order] for c, v in col.items()}
    trie, node, begins = build_trie(col["depth"] - col["stem"], np.stack((col["k1"], col["k2"])))
    degree, parent = trie.degrees(), trie.parents()
    total = len(degree)
    n_convs = np.bincount(node, minlength=total)
    first = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(first, node, col["conv_id"])
    words, depth, p1, p2, above_conv = (np.zeros(total, np.int64) for _ in range(5))
    for into, name in ((words, "words"), (depth, "depth"), (p1, "p1"), (p2, "p2"), (above_conv, "top_conv")):
        into[node] = col[name]
    leaves, saved = (degree == 0).astype(np.int64), (n_convs - 1) * words
    for at in range(len(begins) - 2, 0, -1):  # from the deepest level up
        rows = slice(begins[at], begins[at + 1])
        np.add.at(leaves, parent[rows], leaves[rows])
        np.add.at(saved, parent[rows], saved[rows])
    ends = [_NONE] * total
    ended = col["depth"] == col["length"]
    at, convs = node[ended], col["conv_id"][ended]
    order = np.lexsort((convs, at))
    at, convs = at[order], convs[order]
    for number, place in zip(*np.unique(at, return_index=True), strict=True):
        ends[number] = _ends(convs[place : np.searchsorted(at, number, "right")])
    top = parent == 0
    parent_conv = np.where(top, above_conv, first[parent])
    arrays = [first, depth, parent_conv, n_convs, degree, leaves, saved, ends, p1, p2, top]
    return pa.table([pa.array(a[1:]) for a in arrays], names=[c.split()[0] for c in _NODE.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of nodes as comma-joined texts of about CHUNK_BYTES."""
    key, first, ids, size = None, 0, [], 0
    ready: list[tuple] = []

    def close() -> None:
        if ids:
            ready.append((*key, first, ",".join(ids)))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*ready, strict=True)) or [[]] * 4
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["k1", "k2", "first", "ids"])

    for batch in batches:
        for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id")), strict=True):
            if (k1, k2) != key or size > CHUNK_BYTES:
                close()
                key, first, ids, size = (k1, k2), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield flush()
    close()
    yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node of sorted chunks; a chunk is all that is held."""
    key, digest = None, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["k1", "k2", "ends_sha256"])

    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = (k1, k2), hashlib.sha256(ids.encode())
        yield flush()
    if key is not None:
        out.append((*key, digest.hexdigest()))
    yield flush()


def _joined_ids(ended: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the ids of ``ended`` (k1, k2, conv_id): sorted and joined in ranges, then hashed chunk by chunk."""
    blocks = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k1", "k2", "conv_id"]
    chunks = ended.repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(_chunks, "k1 long, k2 long, first long, ids string")
    return chunks.repartition(blocks, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def _rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """``nodes`` (k1, k2, u1, u2: parent) with n_leaves and saved_tokens summed over their subtrees: each round adds what is
    known of the nodes that lie as far below as all rounds before have reached."""
    reach = 1
    while reach <= deepest:
        below = nodes.where("u1 IS NOT NULL").groupBy("u1", "u2").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        below = below.withColumnsRenamed({"u1": "k1", "u2": "k2"})
        further = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        more = lambda c, extra: (F.col(c) + F.coalesce(extra, F.lit(0))).alias(c)
        nodes = cut(
            nodes.join(below, ["k1", "k2"], "left")
            .join(further, ["u1", "u2"], "left")
            .select("k1", "k2", F.col("v1").alias("u1"), F.col("v2").alias("u2"), more("n_leaves", "_leaves"), more("saved_tokens", "_saved"))
        )
        reach *= 2
    return nodes.select("k1", "k2", "n_leaves", "saved_tokens")


def _key(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}1"), F.col(f"{prefix}2")]


def prefix_trie(turns: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Turns go by number, null first; those of equal
    number, also repeated rows, by the digest of role and text. Null roles and texts count as empty; rows without conv_id
    are left out. Very long texts become a digest and a count. An empty table has no conversation and no node.
    """
    rows = entries(turns)
    weight = F.sum(F.col("length") - F.col("depth") + 1)
    held = rows.groupBy("k1", "k2").agg(weight.alias("weight"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first"), *[F.max(c).alias(c) for c in ("depth", "p1", "p2", "words")])
    heavy = cut(held.where((F.col("weight") > subtree) | (F.col("depth") == 0)).drop("weight"))
    marks = heavy.select("k1", "k2", F.col("first").alias("node_conv"))
    marked = store(rows.join(marks, ["k1", "k2"], "left"))
    light = marked.where("node_conv IS NULL")
    stems = marked.groupBy("conv_id").agg(
        F.max_by("node_conv", F.when(F.col("node_conv").isNotNull(), F.col("depth"))).alias("top_conv"),
        F.min(F.when(F.col("node_conv").isNull(), F.struct("depth", "k1", "k2"))).alias("s"),
    )
    stems = stems.where("s IS NOT NULL").select("conv_id", "top_conv", F.col("s.depth").alias("stem"), F.struct("s.k1", "s.k2").alias("s"))
    shards = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), light.count() // SHARD)
    dealt = light.drop("node_conv").join(stems, "conv_id").withColumn("shard", F.pmod(F.xxhash64("s"), F.lit(shards))).drop("s")
    built = store(dealt.groupBy("shard").applyInArrow(_shard, _NODE))

    lone = built.where("top").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("stems"), F.sum("n_leaves").alias("stem_leaves"), F.sum("saved_tokens").alias("stem_saved"))
    inner = heavy.where("depth > 0").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("inner"))
    below = lone.join(inner, ["p1", "p2"], "full").withColumnsRenamed({"p1": "k1", "p2": "k2"})
    known = lambda c: F.coalesce(c, F.lit(0))
    upper = heavy.join(below, ["k1", "k2"], "left").withColumn("n_children", known("stems") + known("inner"))
    own = F.when(F.col("n_children") == 0, 1).otherwise(known("stem_leaves")).cast("long")
    upper = cut(upper.withColumn("n_leaves", own).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words") + known("stem_saved")))
    inside = lambda c: F.when(F.col("depth") > 0, F.col(c))
    deepest = upper.agg(F.max("depth")).first()[0] or 0
    sums = _rolled_up(upper.select("k1", "k2", inside("p1").alias("u1"), inside("p2").alias("u2"), "n_leaves", "saved_tokens"), deepest)
    ended = _joined_ids(marked.where("node_conv IS NOT NULL AND depth = length").select("k1", "k2", "conv_id"))
    above = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("first").alias("parent_conv_id"))
    merged = upper.drop("n_leaves", "saved_tokens").join(sums, ["k1", "k2"]).join(ended, ["k1", "k2"], "left").join(above, ["p1", "p2"], "left")
    named = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = merged.withColumn("conv_id", F.col("first")).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    return merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))).select(*named).unionByName(built.select(*named))
