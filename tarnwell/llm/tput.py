"""Ranked lexical search by TPUT over postings that are partitioned by term.

An index holds, for the terms that are asked for, one row per term and document with its impact, the part of a score
that doesn't depend on the item. Each term's list is cut into blocks by a hash of the document, so that no list lies in
one task, and each block is stored in order of falling impact.

TPUT then answers all items at once, in three steps. The heads of all lists give every item's k-th best partial sum, a
lower bound. Every list is read down to the bound divided by the number of the item's lists, which no document of the
result can stay below in all of them; these entries travel to their document's block, are summed there in numpy, and
give a better bound and the documents that may still be among the best. The other entries of those are looked up, for
exact scores. No pair of item and document becomes a row but a block's k best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, cut, gapless, pieces, store, within

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Pairs of item and term that are answered together; they, and the terms, go to every executor. More items, more blocks of them.
BLOCK_TERMS = 100_000
#: Entries of a block of documents, about; cells (item and document) that are summed at once.
BLOCK_ENTRIES, CELLS = 1 << 20, 1 << 20
#: Bytes of terms as they count, all others as blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(text: bytes) -> int:
    """Terms of a text, repeats included."""
    held = np.frombuffer(b" " + text.translate(_FOLD), np.uint8) != 32
    return int(np.count_nonzero(held[1:] & ~held[:-1]))


def impact(tf: int, n: int, documents: int, terms: int) -> int:
    """What a term that occurs ``tf`` times in a document of ``n`` terms adds to a score, for a weight of one."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * n * documents // terms))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [count_terms(t) for t in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_pydict({"documents": [sum(map(bool, counts))], "terms": [sum(counts)]})


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""
    found = docs.select("text").mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def _entries(vocabulary: dict[bytes, int], documents: int, terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in within(batches, "text"):
            rows, ids, impacts = [], [], []
            for row, text in enumerate(as_bytes(batch.column("text"))):
                counts: Counter = Counter()
                n = 0
                for piece in pieces(text.translate(_FOLD)):
                    words = piece.split()
                    n += len(words)
                    counts.update(map(vocabulary.get, words))
                counts.pop(None, None)
                rows += [row] * len(counts)
                ids += counts.keys()
                impacts += [impact(tf, n, documents, terms) for tf in counts.values()]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), batch.column("doc_id").take(taken), batch.column("copy").take(taken), pa.array(impacts, pa.int64())], ["term", "doc_id", "copy", "impact"])

    return entries


def build_index(docs: DataFrame, vocabulary: list[str], documents: int, terms: int) -> DataFrame:
    """term (place in ``vocabulary``), block, doc_id, copy, impact, place (from 1 within the block): the postings of the
    vocabulary's terms, stored by term and block. ``docs`` has doc_id, part and text."""
    numbers = {t.encode(): i for i, t in enumerate(vocabulary)}
    found = docs.mapInArrow(_entries(numbers, documents, terms), "term int, doc_id long, copy long, impact long")
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks)).cast("int")).repartition(blocks, "term", "block")
    falling = Window.partitionBy("term", "block").orderBy(F.desc("impact"), "doc_id", "copy")
    return store(found.withColumn("place", F.row_number().over(falling)))


def _best(rows: DataFrame, score: str, k: int) -> DataFrame:
    """Each item's ``k`` rows of the highest score, with rank; equal scores by doc_id, null last, then copy."""
    order = Window.partitionBy("item").orderBy(F.desc(score), F.col("copy") < 0, "doc_id", "copy")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(sums: DataFrame, k: int) -> dict[int, int]:
    """The k-th highest sum of every item; none for those with fewer."""
    least = _best(sums, "sum", k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("sum").alias("sum"))
    return {r["item"]: r["sum"] for r in least.where(F.col("n") == k).collect()}


@dataclass
class Lists:
    """The lists of all items, by term: pairs begin[t] to begin[t + 1] are those of term t."""

    begin: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    items: int
    least: np.ndarray  # of each item: entries below it aren't read
    caps: np.ndarray  # of each pair: what an entry that isn't read adds at most
    bound: np.ndarray  # of each item: the k-th best has that sum at least

    def slices(self, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """doc_id and copy of a slice of a block's documents; by item and document the sum of the entries that count as
        read, the most that it can come to, and the sum of all that ``table`` has."""
        doc, copy, term, value = (table[c].to_numpy() for c in ("doc_id", "copy", "term", "impact"))
        order = np.lexsort((copy, doc, copy < 0))
        doc, copy, term, value = doc[order], copy[order], term[order], value[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])
        number, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        width = max(1, CELLS // max(1, self.items))
        caps = np.bincount(self.item, self.caps, self.items).astype(np.int64)
        for low in range(0, len(first), width):
            rows = slice(first[low], first[low + width] if low + width < len(first) else len(doc))
            by_term = np.argsort(term[rows], kind="stable")
            terms, places, values = term[rows][by_term], number[rows][by_term] - low, value[rows][by_term]
            size = min(width, len(first) - low)
            read, rest = (np.zeros((self.items, size), np.int64) for _ in range(2))
            most = np.repeat(caps[:, None], size, axis=1)
            edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                pairs = slice(*self.begin[terms[begin] : terms[begin] + 2])
                items, here = self.item[pairs], places[begin:end]
                parts = self.weight[pairs][:, None] * values[begin:end]
                high = parts >= self.least[items][:, None]
                at = np.ix_(items, here)
                read[at] += np.where(high, parts, 0)
                rest[at] += np.where(high, 0, parts)
                most[at] -= np.where(high, self.caps[pairs][:, None], 0)
            mine = first[low : low + size]
            yield doc[mine], copy[mine], read, read + most, read + rest

    def _rows(self, found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        items = np.repeat([f[0] for f in found], [len(f[1]) for f in found]) if found else []
        columns = [np.concatenate([f[c] for f in found]) if found else [] for c in (1, 2, 3)]
        return pa.table([pa.array(items, pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], names=["item", "doc_id", "copy", "sum"])

    def partial(self, k: int) -> Callable[[pa.Table], pa.Table]:
        """Of a block: the ``k`` best partial sums of every item, and as item -1 the documents that may be among the best."""

        def partial(table: pa.Table) -> pa.Table:
            found = []
            for doc, copy, read, most, _ in self.slices(table):
                for item in range(self.items):
                    best = np.argsort(-read[item], kind="stable")[:k]
                    best = best[(read[item, best] > 0) & (read[item, best] >= self.bound[item])]
                    found.append((item, doc[best], copy[best], read[item, best]))
                may = ((most >= self.bound[:, None]) & (most > 0)).any(axis=0)
                found.append((-1, doc[may], copy[may], np.zeros(int(may.sum()), np.int64)))
            return self._rows(found)

        return partial

    def exact(self, k: int) -> Callable[[pa.Table], pa.Table]:
        """Of a block: the ``k`` best exact sums of every item, of documents that may be among the best."""

        def exact(table: pa.Table) -> pa.Table:
            found = []
            for doc, copy, _, most, score in self.slices(table):
                for item in range(self.items):
                    may = np.flatnonzero((most[item] >= self.bound[item]) & (score[item] > 0))
                    best = may[np.argsort(-score[item, may], kind="stable")[:k]]
                    found.append((item, doc[best], copy[best], score[item, best]))
            return self._rows(found)

        return exact


_SUM = "item long, doc_id long, copy long, sum long"


def tput(index: DataFrame, asked: list[tuple[int, int]], documents: int, k: int = TOP) -> DataFrame:
    """item, rank, doc_id, copy, sum: the best ``k`` rows for every item of ``asked`` (pairs of item, from 0, and term, a place
    in the vocabulary; BLOCK_TERMS at most)."""
    session = index.sparkSession
    terms = {r["term"]: (r["df"], r["top"]) for r in index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("top")).collect()}
    weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, (df, _) in terms.items()}
    pairs = sorted((t, i) for i, t in asked if weights.get(t))
    items = 1 + max((i for i, _ in asked), default=-1)
    item, term = np.array([i for _, i in pairs], np.int64), np.array([t for t, _ in pairs], np.int64)
    weight, top = np.array([weights[t] for t, _ in pairs], np.int64), np.array([terms[t][1] for t, _ in pairs], np.int64)
    begin = np.searchsorted(term, np.arange(2 + max(terms, default=0)))

    heads = session.createDataFrame([(t, i, weights[t]) for t, i in pairs], "term int, item long, weight long")
    falling = Window.partitionBy("term").orderBy(F.desc("impact"), F.col("copy") < 0, "doc_id", "copy")
    first = index.where(F.col("place") <= k).withColumn("head", F.row_number().over(falling)).where(F.col("head") <= k)
    sums = first.join(F.broadcast(heads), "term").groupBy("item", "doc_id", "copy").agg(F.sum(F.col("weight") * F.col("impact")).alias("sum"))

    def lists(bounds: dict[int, int], least: np.ndarray | None = None) -> Lists:
        bound = np.array([bounds.get(i, 0) for i in range(items)], np.int64)
        if least is None:
            least = -(-bound // np.maximum(1, np.bincount(item, minlength=items)))
        caps = np.minimum(np.maximum(least[item] - 1, 0), weight * top) if len(item) else np.zeros(0, np.int64)
        return Lists(begin, item, weight, items, least, caps, bound)

    plan = lists(_bounds(sums, k))
    # a term's entries are read down to what any of its items asks for; its impact, as the weight is the term's
    reach = {t: int(min(-(-plan.least[i] // weights[t]) for i in item[begin[t] : begin[t + 1]])) for t in set(term.tolist())}
    reached = session.createDataFrame(list(reach.items()), "term int, reach long")
    entries = index.join(F.broadcast(reached), "term")
    count = sum(df for df, _ in terms.values())
    blocks = max(int(session.conf.get("spark.sql.shuffle.partitions")), count // BLOCK_ENTRIES)
    block = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks)).alias("block")
    columns = [block, "doc_id", "copy", "term", "impact"]
    read = entries.where("impact >= reach").select(*columns)
    partial = store(read.groupBy("block").applyInArrow(plan.partial(k), _SUM))
    better = _bounds(partial.where("item >= 0"), k)
    plan = lists({i: max(better.get(i, 0), int(plan.bound[i])) for i in range(items)}, plan.least)
    may = partial.where("item < 0").select("doc_id", "copy")
    looked_up = entries.where("impact < reach").join(may, ["doc_id", "copy"], "left_semi").select(*columns)
    exact = read.unionByName(looked_up).groupBy("block").applyInArrow(plan.exact(k), _SUM)
    return _best(exact, "sum", k)


def _terms(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_distinct(F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(TERM), F.lit(0)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the best ``k`` rows of ``docs`` for every row of ``items``.

    Every row of ``docs`` is a document, repeated rows and ids too; equal scores go by doc_id, a null id last. Null and
    empty texts have no term: as documents they count nowhere, as items they get no rows. Every row of ``items`` is an
    item of its own. Very long texts are counted whole, in pieces. Other columns are not read. Items are answered in blocks of BLOCK_TERMS
    pairs of item and term; each block reads the documents again. Empty tables give an empty result.
    """
    documents, terms = statistics(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("copy"), "text")
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        known = rows.drop("copy").withColumns({"text": F.coalesce("text", F.lit("")), "_null": F.col("doc_id").isNull()})
        rows = gapless(known.withColumn("_key", F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "_null")), "_key", "copy")
        rows = rows.select(F.col("_key.id").alias("doc_id"), F.when(F.col("_null"), -1 - F.col("copy")).otherwise(F.col("copy")).alias("copy"), "text")
    numbered = cut(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")))
    asked = cut(numbered.select("item_id", "item", F.explode(_terms(F.col("text"))).alias("word")))
    blocks = -(-asked.count() // BLOCK_TERMS) or 1
    result = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        vocabulary = sorted({r["word"] for r in mine})
        numbers = {w: i for i, w in enumerate(vocabulary)}
        names = {r["item"]: r["item_id"] for r in mine}
        places = {item: i for i, item in enumerate(names)}
        index = build_index(rows, vocabulary, documents, terms)
        best = tput(index, [(places[r["item"]], numbers[r["word"]]) for r in mine], documents, k)
        ids = docs.sparkSession.createDataFrame([(places[i], name) for i, name in names.items()], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema["item_id"].dataType)]))
        doc_id = F.when(F.col("copy") >= 0, F.col("doc_id")).alias("doc_id")
        found = best.join(F.broadcast(ids), "item").select("item_id", "rank", doc_id, F.col("sum").alias("score"))
        result = found if result is None else result.unionByName(found)
    return result
