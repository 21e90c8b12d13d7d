"""Jaccard self-join of n-gram sets by adaptive multi-match prefixes.

The shingles of a set are ordered by their hashes. Sets of s shingles that reach the threshold with any other share T =
ceil(0.85 s) of them at least, so two linked sets share l of their first s - T + l shingles each, for every l: a longer
prefix demands more shared shingles. An index of the longest prefixes counts how many sets hold each shingle; from these
lengths every set estimates what its candidates will cost and takes the l that is cheapest. Shingles of more than HOT
sets are never paired: a set that meets them lengthens its prefix until enough shingles must be shared besides them.

Sets in whose longest prefix so much is hot that all they must share may be (they hold passages that many share, or
belong to a large family of near copies) are compared with the set of each hot shingle that holds most hot ones. Where that
doesn't connect a shingle's sets, its sets lengthen their prefixes to the whole and are indexed again among themselves.
What is hot for most of a whole set is compared block by block at last.

Equal sets are one throughout, and every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, key_filter, passes, pieces, store, within
from .simhash import components

WORDS = 4
PERCENT = 85
#: Most holders of a shingle that are paired; a shingle with more is hot.
HOT = 16
#: What comparing two sets costs for each shingle, if looking at one candidate of one shingle costs 1.
VERIFY = 0.25
#: Index entries that a task gathers before it deals them out; parts that they are dealt to for each shuffle partition.
GATHER, PARTS = 1 << 20, 4
#: Sets, and their shingles, of a block of a family.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
SEED = 42
_FACTORS = (np.random.default_rng(SEED).integers(0, 1 << 64, WORDS + 2, np.uint64) | np.uint64(1)).tolist()
_BLANK = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHOSEN = "print long, token long, hot boolean, level int, n_hot int, size int"


class _Hashes(dict):
    """Hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


_hashes = _Hashes()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a text's runs of WORDS words; of all its words, if there are fewer; none without."""
    found = []
    for piece in pieces(text.translate(_BLANK)):
        words = piece.split()
        found.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if not len(words):
        return words
    run = min(WORDS, len(words))
    mixed = np.full(len(words) - run + 1, (run * _FACTORS[WORDS]) % (1 << 64), np.uint64)
    for k in range(run):
        mixed += words[k : len(words) - run + 1 + k] * np.uint64(_FACTORS[k])
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(_FACTORS[WORDS + 1])
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _name(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def needed(size: int) -> int:
    """Shingles that a set of ``size`` shares with any set it is linked with, at least."""
    return (PERCENT * size + 99) // 100


def longest(size: int) -> int:
    """Most shared shingles that a prefix of a set of ``size`` is lengthened for; never falls as sizes grow."""
    return min(1 + size // 20, needed(size))


def prefix(size: int, level: int) -> int:
    return size - needed(size) + level


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in within(batches, "text"):
        sets = [shingle_set(t) for t in as_bytes(batch.column("text"))]
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(_name, sets), pa.int64()), pa.array(map(len, sets), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "print", "size"])


def _sets(batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose key passes the filter ``held``."""
    for batch in batches:
        batch = batch.filter(pa.array(passes(held, batch.column("key").to_numpy())))
        for part in within(iter([batch]), "text"):
            sets = [shingle_set(t) for t in as_bytes(part.column("text"))]
            columns = [pa.array(map(_name, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["print", "shingles"])


def _open(batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(passes(held, batch.column("print").to_numpy())))


def _dealt(parts: int, most: Callable[[int], int] = longest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Longest prefixes of texts or sets as entries (shingle, set, rank), packed by part. Entries of a shingle go to its part, but for those of
    a shingle that is hot among the task's own sets: they go to parts of their sets, and only the shingle to its part."""

    def part_of(values: np.ndarray) -> np.ndarray:
        return ((values.view(np.uint64) * np.uint64(_FACTORS[0])) >> np.uint64(33)) % np.uint64(parts)

    def packed(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) for x in held.values()]
        tokens = np.concatenate(list(held.values())).view(np.int64)
        prints = np.repeat(np.fromiter(held, np.int64, len(held)), sizes)
        ranks = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        distinct, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        hot = counts[inverse] > HOT
        marks = distinct[counts > HOT]
        marked = part_of(marks)
        part = np.where(hot, part_of(prints), part_of(tokens))
        order = np.lexsort((hot, part))
        part, hot = part[order], hot[order]
        tokens, prints, ranks = tokens[order], prints[order], ranks[order]
        bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        rows = []
        for k in range(parts):
            begin, end = bounds[k : k + 2]
            if begin < end or (marked == k).any():
                cold = begin + int(np.count_nonzero(~hot[begin:end]))
                rows.append((k, cold - begin, tokens[begin:end].tobytes(), prints[begin:end].tobytes(), ranks[begin:end].tobytes(), marks[marked == k].tobytes()))
        names = ["part", "cold", "tokens", "prints", "ranks", "marks"]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            if "shingles" in batch.schema.names:
                lists = batch.column("shingles")
                for k, name in enumerate(batch.column("print").to_pylist()):
                    yield name, lists[k].values.to_numpy().view(np.uint64)
            else:
                for part in within(iter([batch]), "text"):
                    for text in as_bytes(part.column("text")):
                        shingles = shingle_set(text)
                        yield _name(shingles), shingles

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for name, shingles in named(batches):
            if len(shingles) and name not in held:
                held[name] = shingles[: prefix(len(shingles), most(len(shingles)))].copy()
                total += len(held[name])
            if total >= GATHER:
                yield from packed(held)
                held, total = {}, 0
        if held:
            yield from packed(held)

    return dealt


def _counted(table: pa.Table) -> pa.Table:
    """Entries of one part whose shingle other sets hold too, with how many do (HOT + 1 for a hot one)."""
    cold, hot = [], []
    for row in table.to_pylist():
        tokens, prints, ranks = np.frombuffer(row["tokens"], np.int64), np.frombuffer(row["prints"], np.int64), np.frombuffer(row["ranks"], np.uint32)
        cold.append((tokens[: row["cold"]], prints[: row["cold"]], ranks[: row["cold"]]))
        hot.append((tokens[row["cold"] :], prints[row["cold"] :], ranks[row["cold"] :]))
    tokens, prints, ranks = (np.concatenate(c) for c in zip(*cold, strict=True))
    order = np.lexsort((prints, tokens))
    tokens, prints, ranks = tokens[order], prints[order], ranks[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (prints[1:] != prints[:-1])  # copies of a set in several tasks
    tokens, prints, ranks = tokens[fresh], prints[fresh], ranks[fresh]
    distinct, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    marks = np.unique(np.concatenate([np.frombuffer(m, np.int64) for m in table["marks"].to_pylist()]))
    counts[np.isin(distinct, marks)] = HOT + 1
    holders = np.minimum(counts, HOT + 1)[inverse]
    kept = holders > 1
    arrays = [np.concatenate((mine[kept], *more)) for mine, more in zip((tokens, prints, ranks), zip(*hot, strict=True), strict=True)]
    holders = np.concatenate((holders[kept], np.full(len(arrays[0]) - int(kept.sum()), HOT + 1)))
    return pa.table([pa.array(arrays[1]), pa.array(arrays[0]), pa.array(arrays[2].astype(np.int32)), pa.array(holders.astype(np.int32))], names=["print", "token", "rank", "holders"])


def choose(size: int, ranks: np.ndarray, holders: np.ndarray, longest: Callable[[int], int] = longest) -> tuple[int, int, int]:
    """(level, hot shingles in that prefix, hot shingles to index) of a set whose shared shingles of the longest prefix have
    these ranks (rising) and holders.

    Any level is exact for a set with no hot shingle in that prefix: what it shares there isn't hot. Else the longest
    prefix is taken. If all that must be shared may be hot, as many hot shingles are indexed as can't all be missed.
    """
    base, most = prefix(size, 0), longest(size)
    hot = ranks[holders > HOT]
    free = int(hot[0]) - base if len(hot) else most
    if free < 1:
        sure = longest(needed(size))
        return most, len(hot), max(0, len(hot) - sure + 1)
    best, cheapest, level = 1, float("inf"), 1
    while True:
        scan = float((holders[ranks < base + level] - 1).sum())
        cost = scan * (1 + VERIFY * size / level)
        if cost < cheapest:
            best, cheapest = level, cost
        if level == min(free, most):
            return best, 0, 0
        level = min(2 * level, free, most)


def _chosen(batches: Iterator[pa.RecordBatch], most: Callable[[int], int] = longest) -> Iterator[pa.RecordBatch]:
    names = ["print", "token", "hot", "level", "n_hot", "size"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in names]
        for row in range(batch.num_rows):
            name, size = batch.column("print")[row].as_py(), batch.column("size")[row].as_py()
            held = batch.column("held")[row].values
            ranks, tokens, holders = (held.field(c).to_numpy() for c in ("rank", "token", "holders"))
            fresh = np.ones(len(ranks), bool)
            fresh[1:] = ranks[1:] != ranks[:-1]
            ranks, tokens, holders = ranks[fresh], tokens[fresh], holders[fresh]
            level, n_hot, indexed = choose(size, ranks, holders, most)
            hot = holders > HOT
            cold = ~hot & (ranks < prefix(size, level))
            taken = np.concatenate((tokens[cold], tokens[hot][:indexed]))
            flags = np.arange(len(taken)) >= int(cold.sum())
            for column, values in zip(out, (name, taken, flags, level, n_hot, size), strict=True):
                column.append(values if isinstance(values, np.ndarray) else np.full(len(taken), values))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds, strict=True)], names)


def _cold_pairs(chosen: DataFrame) -> DataFrame:
    """Pairs a, b of sets that share as many shingles of their prefixes as their levels demand; lists have HOT holders at most."""
    lists = chosen.where("NOT hot").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("print", "level", "n_hot", "size"))).alias("sets")).where("size(sets) > 1")
    pairs = F.expr("flatten(transform(sets, (x, i) -> transform(slice(sets, i + 2, size(sets)), y -> struct(x AS x, y AS y))))")
    pairs = lists.select(F.explode(pairs).alias("p")).where(f"100 * least(p.x.size, p.y.size) >= {PERCENT} * greatest(p.x.size, p.y.size)")
    demand = F.expr("greatest(1, least(p.x.level, p.y.level) - least(p.x.n_hot, p.y.n_hot))")
    pairs = pairs.select(F.col("p.x.print").alias("a"), F.col("p.y.print").alias("b"), demand.alias("demand"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("demand").alias("demand")).where("n >= demand").select("a", "b")


def _hub_pairs(hot: DataFrame) -> DataFrame:
    """For each set with hot shingles indexed, the hub of most of them: of a shingle, the holder with the largest share of hot ones."""
    share = F.col("n_hot") / F.col("size")
    hubs = hot.groupBy("token").agg(F.max_by("print", F.struct(share, -F.col("print"))).alias("a"))
    shared = hot.select("token", F.col("print").alias("b")).join(hubs, "token").where("a <> b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def _signatures(source: DataFrame, prints: DataFrame, most: Callable[[int], int]) -> DataFrame:
    """print, token, hot, level, n_hot, size: what the sets of ``source`` (text, or print and shingles) are indexed by."""
    parts = PARTS * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = source.mapInArrow(_dealt(parts, most), "part int, cold long, tokens binary, prints binary, ranks binary, marks binary")
    shared = entries.groupBy("part").applyInArrow(_counted, "print long, token long, rank int, holders int")
    held = shared.groupBy("print").agg(F.sort_array(F.collect_list(F.struct("rank", "token", "holders"))).alias("held"))
    return store(held.join(prints.select("print", "size"), "print").mapInArrow(partial(_chosen, most=most), _CHOSEN))


def _split(hot: DataFrame, labels: DataFrame) -> DataFrame:
    """token, print, group of the hot shingles whose sets are in several groups."""
    grouped = store(hot.select("token", "print").join(labels, F.col("print") == F.col("node"), "left").select("token", "print", F.coalesce("label", "print").alias("group")))
    several = grouped.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("token")
    return store(grouped.join(several, "token", "left_semi"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked; row by row, as sets can be long."""
    right = sets.select(F.col("print").alias("b"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("print").alias("a"), F.col("shingles").alias("sa"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")  # of all: the members of both less those shared
    linked = shared * (100 + PERCENT) >= PERCENT * (F.size("sa") + F.size("sb")).cast("long")
    return store(pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(linked).select("a", "b"))


def _linked(table: pa.Table) -> pa.Table:
    """Links a, b between a block's sets marked ``mine`` and its others, as few as connect all that are linked across groups."""
    prints, groups, mine = table["print"].to_numpy(), table["group"].to_numpy(), table["mine"].to_numpy()
    lists = table["shingles"].combine_chunks()
    values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
    row = np.repeat(np.arange(len(sizes)), sizes)
    token = np.unique(values, return_inverse=True)[1]
    count = int(token.max(initial=-1)) + 1
    some = (np.bincount(token[mine[row]], minlength=count) > 0) & (np.bincount(token[~mine[row]], minlength=count) > 0)
    row, token = row[some[token]], token[some[token]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], np.unique(token[order], return_inverse=True)[1]
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(token.max(initial=-1)) + 1, 4096):
        part = slice(*np.searchsorted(token, (low, low + 4096)))
        held = np.zeros((len(sizes), 4096), np.float32)
        held[row[part], token[part] - low] = 1
        shared += held[left] @ held[right].T
    linked = shared.astype(np.int64) * (100 + PERCENT) >= PERCENT * (sizes[left][:, None] + sizes[right])
    linked &= groups[left][:, None] != groups[right]
    top = {g: g for g in groups.tolist()}
    found = []
    for i in range(len(left)):
        for j in np.flatnonzero(linked[i]).tolist():
            x, y = groups[left[i]].item(), groups[right[j]].item()
            while top[x] != x:
                x = top[x]
            while top[y] != y:
                y = top[y]
            if x != y:
                top[max(x, y)] = min(x, y)
                found.append((prints[left[i]], prints[right[j]]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _block_links(split: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the groups of hot shingles that hold several: ``split`` has token, print, group. Shingles that share sets
    make a family. Its sets outside its largest group, in blocks of bounded size, meet blocks of all its sets that are not
    too small or large to be linked with them, each two blocks in a task of their own."""
    least = split.groupBy("token").agg(F.min("print").alias("a"))
    family = components(split.join(least, "token").select("a", F.col("print").alias("b")).where("a <> b")).select(F.col("node").alias("print"), F.col("label").alias("family"))
    # a class is a factor of 2 ** 0.25 > 100 / PERCENT wide: linked sets are in the same or in neighbouring ones
    rows = split.select("print", "group").distinct().join(family, "print").join(sets, "print").withColumn("class", F.floor(4 * F.log2(F.size("shingles"))).cast("int"))
    rows = store(rows)
    groups = rows.groupBy("family", "class", "group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("s"))
    largest = groups.groupBy("family", "group").agg(F.sum("n").alias("n")).groupBy("family").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
    groups = groups.join(largest, "family").withColumn("out", (F.col("group") != F.col("largest")).cast("int"))
    blocks = lambda n, s: F.greatest(F.ceil(F.sum(n) / BLOCK), F.ceil(F.sum(s) / BLOCK_SHINGLES)).cast("int")
    size = store(groups.groupBy("family", "class").agg(blocks(F.col("n"), F.col("s")).alias("wide"), blocks(F.col("n") * F.col("out"), F.col("s") * F.col("out")).alias("high"), F.first("largest").alias("largest")))
    wide, high = size.select("family", F.col("class").alias("of"), "wide"), size.where("high > 0").select("family", F.col("class").alias("mine_of"), "high", "largest")
    block = lambda n: F.pmod(F.xxhash64("print"), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = F.explode(F.expr("sequence(class - 1, class + 1)"))
    mine = rows.withColumn("mine_of", F.col("class")).join(high, ["family", "mine_of"]).where(F.col("group") != F.col("largest"))
    mine = mine.withColumn("of", near).join(wide, ["family", "of"]).withColumns({"low": block("high"), "other": up_to("wide"), "mine": F.lit(True)})
    all_sets = rows.withColumn("of", F.col("class")).join(wide, ["family", "of"]).withColumn("mine_of", near).join(high, ["family", "mine_of"])
    all_sets = all_sets.withColumns({"other": block("wide"), "low": up_to("high"), "mine": F.lit(False)})
    cell = ["family", "mine_of", "of", "low", "other"]
    dealt = mine.select(*cell, "mine", "print", "group", "shingles").unionByName(all_sets.select(*cell, "mine", "print", "group", "shingles"))
    dealt = dealt.repartition(int(split.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)  # few bytes, much work
    return store(dealt.groupBy(*cell).applyInArrow(_linked, "a long, b long"))


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are in different groups (print, group)."""
    left, right = (groups.select(F.col("print").alias(c), F.col("group").alias(f"_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where("_a <> _b").select("a", "b")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links lead to) of every row of ``docs``.

    Rows with equal sets, also repeated rows, are linked; rows without words, null and empty texts, with none, not even
    with each other: they are components of their own. Null ids are never a component's id, which is null only where it
    has no other. A very long text is one set in memory; its words are read in pieces. Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = store(texts.mapInArrow(_described, "doc_id long, text_hash long, print long, size long"))
    prints = store(rows.where("size > 0").groupBy("print").agg(F.min("doc_id").alias("least"), F.first("size").cast("int").alias("size"), F.min(F.struct("text_hash", "doc_id")).alias("row")))

    chosen = _signatures(docs.select("text"), prints, longest)
    hot = chosen.where("hot").select("token", "print", "n_hot", "size")
    pairs = store(_cold_pairs(chosen).unionByName(_hub_pairs(hot)).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    wanted = store(prints.join(wanted, "print", "left_semi").select("print", F.xxhash64("row.text_hash", "row.doc_id").alias("key")))
    found = texts.select("text", F.xxhash64("text_hash", "doc_id").alias("key")).mapInArrow(partial(_sets, held=key_filter(wanted, "key")), "print long, shingles array<long>")
    sets = store(found.join(wanted.hint("merge"), "print", "left_semi").dropDuplicates(["print"]))  # texts are never shuffled
    edges = _verified(pairs, sets)
    labels = components(edges)
    split = _split(hot, labels)
    if split.limit(1).count():
        groups = store(split.select("print", "group").distinct())
        open_sets = sets.mapInArrow(partial(_open, held=key_filter(groups, "print")), "print long, shingles array<long>")
        open_sets = store(open_sets.join(groups, "print", "left_semi"))
        chosen = _signatures(open_sets, prints, needed)
        hot = chosen.where("hot").select("token", "print", "n_hot", "size")
        pairs = store(_across(_cold_pairs(chosen).unionByName(_hub_pairs(hot)).distinct(), groups))
        edges = edges.unionByName(_verified(pairs, open_sets))
        labels = components(edges)
        split = _split(hot, labels)
        if split.limit(1).count():
            labels = components(edges.unionByName(_block_links(split, open_sets)))
    group = F.coalesce("label", "print").alias("group")
    joined = store(prints.join(labels, prints["print"] == labels["node"], "left").select("print", "least", group))
    ids = joined.groupBy("group").agg(F.min("least").alias("component_id"))
    named = rows.where("size > 0").join(joined.join(ids, "group").select("print", "component_id"), "print")
    lone = rows.where("size = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("size").alias("n_shingles"), "component_id"]
    return named.select(*columns).unionByName(lone.select(*columns))
