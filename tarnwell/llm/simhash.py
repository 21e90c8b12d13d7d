"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, cut into two segments of 32. Two fingerprints that differ in at most two bits have a segment
that differs in at most one, so they share one of that segment's 32 one-wildcard variants. Fingerprints are therefore
indexed under 64 variants, joined by equality of variants and verified on all 64 bits.

Only distinct fingerprints are indexed. A variant held by two fingerprints gives one candidate pair, straight from the
aggregate. Fingerprints of variants with more holders would give pairs as the square of their number; they are linked
exactly by the centres between them instead: two fingerprints are within two bits if and only if some 64-bit value lies
within one bit of both, and all fingerprints within one bit of the same centre are within two of each other. So each is
listed under its 65 centres and tied to the least fingerprint of each centre: stars, no pairs.

near_duplicates() works on these links. As fingerprints of 64 bits tell similarity roughly, near_copies() looks for more:
candidates from minimum hashes in bands, each verified on the whole sets of shingles. With by_prints it starts from the
groups of the fingerprints, which that joins, never parts; so does the pipeline.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, key_filter, passes, slices, store

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
#: Shingles whose bits are unpacked at once.
UNPACKED = 255 * 256

#: Near copies: texts whose sets of five-word shingles share 4 of 5 at least. A pair at just that similarity shares none
#: of the BANDS keys with a probability of (1 - 0.8 ** BAND_ROWS) ** BANDS = 7e-5.
COPY_WORDS, ALIKE = 5, (4, 5)
BANDS, BAND_ROWS = 24, 5
#: Most holders of a key that are all paired at once; texts, and their shingles, of a block of a larger family.
BUCKET = 8
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
_random = np.random.default_rng(SEED)
_MASKS = _random.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)
_FACTORS = _random.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, most significant bit first; all zero for a text without words."""
    words = text.lower().split()
    count = len(words)
    if not count:
        return bytes(8)
    joined = b" ".join(words)
    if count <= shingle_words:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, words), np.int64, count)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - shingle_words].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 8 * UNPACKED):
        bits = np.unpackbits(np.frombuffer(digests[at : at + 8 * UNPACKED], np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 16 > len(digests)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = b"".join(map(fingerprint, as_bytes(batch.column(2))))
        values = pa.array(np.frombuffer(prints, ">i8").astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "text_hash", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (64 bits of the text, for finding the row again) and print (long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, print long")


def _spread(prints: DataFrame) -> DataFrame:
    """``prints`` over all shuffle partitions: they are few bytes each, but every one becomes 64 rows."""
    return prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _variants(prints: DataFrame) -> DataFrame:
    """Each fingerprint under 64 keys: which segment, which wildcard bit, and the segment without that bit."""
    low, high = "print & 4294967295L", "shiftrightunsigned(print, 32)"
    keys = ", ".join(f"transform(sequence(0, 31), i -> ({part} & ~shiftleft(1L, i)) | shiftleft({side}L + i, 32))" for part, side in ((low, 0), (high, 32)))
    return prints.select(F.explode(F.expr(f"concat({keys})")).alias("key"), "print")


def _centres(prints: DataFrame) -> DataFrame:
    """Each fingerprint under itself and the 64 values one bit away."""
    return prints.select("print", F.explode(F.expr("concat(array(print), transform(sequence(0, 63), i -> print ^ shiftleft(1L, i)))")).alias("centre"))


def links(prints: DataFrame) -> DataFrame:
    """Pairs a, b of the distinct fingerprints ``prints`` that connect all that lie within two bits (not every such pair)."""
    prints = _spread(prints)
    held = _variants(prints).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).where("n > 1")
    held = cut(held)
    pairs = held.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE).select("a", "b")
    busy = held.where("n > 2").select("key").hint("shuffle_hash")  # grows with the input: never sent to every executor
    crowded = _variants(prints).join(busy, "key", "left_semi").select("print").distinct()
    around = _centres(_spread(cut(crowded)))
    met = around.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a")).where("n > 1").select("centre", "a")
    # Spark takes the 65-fold rows of `around` for as few as the prints, and would broadcast them
    stars = around.join(met.hint("shuffle_hash"), "centre").select("a", F.col("print").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that edges lead to) for every node of ``edges`` (a, b long).

    Each round takes the least label among neighbours and then that label's own label, so paths halve; labels only fall, so
    rounds end when none does.
    """
    edges = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        offers = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offers, labels["node"] == offers["a"]).select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut(lower.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")))
        labels = moved.select("node", "label")
        if not moved.where("was <> label").limit(1).count():
            return labels


def print_groups(prints: DataFrame) -> DataFrame:
    """``prints`` (distinct print and other columns) with group: the least fingerprint that links lead to."""
    labels = components(links(prints.select("print")))
    return prints.join(labels, prints["print"] == labels["node"], "left").drop("node").withColumn("group", F.coalesce("label", "print")).drop("label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, print, group (long) and component_id (least doc_id of the group) for every row of ``docs``.

    Rows whose fingerprints are linked, directly or through others, form a group; copies and repeated rows share theirs.
    Null and empty texts have fingerprint zero and are linked like any other; very long texts count whole. Null ids are ignored by component_id,
    which is null only where a group has no other. Other columns are not read; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs))
    prints = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    grouped = cut(print_groups(prints))
    ids = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.join(ids, "group").select("print", "group", "component_id"), "print")


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of COPY_WORDS words; of all its words, if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    runs = range(max(1, len(words) - COPY_WORDS + 1))
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(words[k : k + COPY_WORDS]), SEED) for k in runs]), np.uint64))


def _band_keys(shingles: np.ndarray) -> list[int]:
    """BANDS numbers, each of BAND_ROWS least values of the set under as many hash functions; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[at : at + 1024, None] ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    values = least.tobytes()
    width = 8 * BAND_ROWS
    return [xxhash.xxh64_intdigest(values[k * width : (k + 1) * width], k) - (1 << 63) for k in range(BANDS)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(t) for t in as_bytes(batch.column(2))]
        names = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64())
        keys = pa.array([_band_keys(s) for s in sets], pa.list_(pa.int64()))
        simhashes = np.frombuffer(b"".join(map(fingerprint, as_bytes(batch.column(2)))), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(simhashes), names, keys], ["doc_id", "text_hash", "simhash", "print", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose key passes the filter ``held``."""
    for batch in slices(batches):
        batch = batch.filter(pa.array(passes(held, batch.column("key").to_numpy())))
        sets = [shingle_set(t) for t in as_bytes(batch.column("text"))]
        names = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([names, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["print", "shingles"])


def _same_fingerprints(rows: DataFrame) -> DataFrame:
    """Links a, b (stars) between the prints of ``rows`` (simhash, print) whose fingerprints are in one group."""
    held = rows.select("simhash", "print").distinct()
    groups = print_groups(held.select(F.col("simhash").alias("print")).distinct()).select(F.col("print").alias("simhash"), "group")
    held = store(held.join(groups, "simhash").select("group", "print").distinct())
    first = held.groupBy("group").agg(F.min("print").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "a")
    return store(held.join(first, "group").where("a <> print").select("a", F.col("print").alias("b")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets share ALIKE of all their members at least; row by row, as sets can be long."""
    right = sets.select(F.col("print").alias("b"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("print").alias("a"), F.col("shingles").alias("sa"))
    shared = F.size(F.array_intersect("sa", "sb"))  # of all: the members of both less those shared
    alike = shared * sum(ALIKE) >= ALIKE[0] * (F.size("sa") + F.size("sb"))
    return store(pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(alike).select("a", "b"))


def _forest(table: pa.Table) -> pa.Table:
    """Pairs a, b of different groups whose sets are alike, as few as connect all that are: whole sets of one or two blocks."""
    prints, groups = table["print"].to_numpy(), table["group"].to_numpy()
    lists = table["shingles"].combine_chunks()
    values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    token = np.unique(values, return_inverse=True)[1]
    often = np.bincount(token) > 1  # a shingle that one set holds is shared with none
    place = np.cumsum(often) - 1
    row, token = np.repeat(np.arange(len(sizes)), sizes)[often[token]], place[token[often[token]]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    shared = np.zeros((len(sizes), len(sizes)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        part = slice(*np.searchsorted(token, (low, low + 4096)))
        held = np.zeros((len(sizes), 4096), np.float32)
        held[row[part], token[part] - low] = 1
        shared += held @ held.T
    alike = (shared * sum(ALIKE) >= ALIKE[0] * (sizes[:, None] + sizes)) & (groups[:, None] != groups)
    top = {g: g for g in groups.tolist()}
    found = []
    for i, j in np.argwhere(np.triu(alike, 1)).tolist():
        x, y = (groups[k].item() for k in (i, j))
        while top[x] != x:
            x = top[x]
        while top[y] != y:
            y = top[y]
        if x != y:
            top[max(x, y)] = min(x, y)
            found.append((prints[i], prints[j]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _between_groups(many: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b between the groups of keys that hold several: ``many`` has key, print, a (least print of the key), group.

    Keys that share prints make a family. Its prints fall into blocks of bounded size, and every two blocks are compared on
    their whole sets in a task of their own, so no pair becomes a row and no task holds a family.
    """
    family = components(many.select("a", F.col("print").alias("b")).where("a <> b")).select(F.col("node").alias("print"), F.col("label").alias("family"))
    rows = many.select("print", "group").distinct().join(family, "print").join(sets, "print")
    rows = store(rows)
    size = rows.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    rows = rows.join(size, "family").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "print", "group", "shingles")
    return store(rows.groupBy("family", "low", "high").applyInArrow(_forest, "a long, b long"))


def near_copies(docs: DataFrame, by_prints: bool = False) -> DataFrame:
    """doc_id, text_hash, simhash (the fingerprint), print (of the text's set of shingles), group and component_id for every row of ``docs``.

    Rows whose sets are alike, or with ``by_prints`` whose fingerprints are linked as in near_duplicates(), directly or through
    others, form a group. Candidates for alike sets share a band key and are not yet in one group; every such link is verified on the whole sets. Of a key with more than BUCKET holders, all are first compared with the least; keys whose
    holders are not in one group by then are compared block by block (_between_groups). Texts without words are copies of each other; null texts count as empty. A very
    long text is one sketch and, if it has candidates, one array of hashes. Null ids are ignored by component_id. Other
    columns are not read; an empty table gives an empty result.
    """
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = store(numbered.mapInArrow(_sketches, "doc_id long, text_hash long, simhash long, print long, keys array<long>"))
    known = _same_fingerprints(rows) if by_prints else rows.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)
    met = components(known)
    prints = store(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.min(F.struct("text_hash", "doc_id")).alias("row")))
    index = prints.select(F.explode("keys").alias("key"), "print")
    held = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a")).where("n > 1")
    index = store(index.join(held.hint("shuffle_hash"), "key"))
    few = index.where(f"n <= {BUCKET}")
    pairs = few.select("key", F.col("print").alias("b")).join(few.select("key", F.col("print").alias("a")), "key").where("a < b").select("a", "b")
    pairs = pairs.unionByName(index.where(f"n > {BUCKET} AND a <> print").select("a", F.col("print").alias("b")))
    left, right = (met.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("a", "b"))
    apart = F.coalesce("_a", "a") != F.coalesce("_b", "b")
    pairs = store(pairs.distinct().join(left, "a", "left").join(right, "b", "left").where(apart).select("a", "b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("print")).unionByName(index.where(f"n > {BUCKET}").select("print")).distinct()
    wanted = store(prints.join(wanted, "print", "left_semi").select("print", F.xxhash64("row.text_hash", "row.doc_id").alias("key")))
    found = numbered.select("text", F.xxhash64("text_hash", "doc_id").alias("key")).mapInArrow(partial(_sets, held=key_filter(wanted, "key")), "print long, shingles array<long>")
    sets = store(found.join(wanted.hint("merge"), "print", "left_semi").dropDuplicates(["print"]))  # texts are never shuffled
    edges = known.unionByName(_verified(pairs, sets))
    labels = components(edges)
    group = F.coalesce("label", "print").alias("group")
    many = cut(index.where(f"n > {BUCKET}").join(labels, F.col("print") == F.col("node"), "left").select("key", "print", "a", group))
    split = many.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("key")
    many = cut(many.join(split, "key", "left_semi"))
    if many.limit(1).count():
        labels = components(edges.unionByName(_between_groups(many, sets)))
    grouped = cut(prints.join(labels, prints["print"] == labels["node"], "left").select("print", "least", group))
    ids = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return rows.drop("keys").join(grouped.join(ids, "group").select("print", "group", "component_id"), "print")


def keep_one(docs: DataFrame, by_prints: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near_copies(): the row of the least id (null if the group
    has no other), of several such rows the one of the least hash of its text, and one if that is repeated."""
    found = near_copies(docs, by_prints)
    chosen = cut(found.where("doc_id <=> component_id").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("it"), F.count(F.lit(1)).alias("n")))
    ids = chosen.select(F.col("it.doc_id").alias("_id"), F.col("it.text_hash").alias("_hash"))
    kept = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")
    if chosen.where("n > 1").limit(1).count():  # an id occurs more than once in its group
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept
