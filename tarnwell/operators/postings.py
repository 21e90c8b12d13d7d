"""Search from stored postings: an inverted index in Parquet, partitioned by buckets of terms, that is built once and read by
bucket.

A posting list is stored in parts, one row per term, field and part: the documents (64-bit hashes of their ids) with term
frequencies and field lengths. A query reads the buckets of its own terms, so its cost follows the lists of these terms and
not the texts. Statistics (documents, tokens by field) lie beside the postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import markup
from tarnwell.operators import lineage
from tarnwell.operators.search import K1, LEAST_IDF, B, indexed_text

BUCKETS = 64
#: Documents whose lists a task packs together.
PACK = 1 << 14
#: Boosts of the relaxed query, by field; fragments come from the first field that matches, in FRAGMENT_FIELDS' order.
BOOSTS = {"content": 2.0, "heading_text": 1.5, "title": 1.0}
FRAGMENT_FIELDS = ("content", "title", "heading_text")
#: Pieces (words and what is between them) before and from the first match that make a fragment.
BEFORE, AFTER = 10, 40
#: The English stop words of the Snowball project.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing would should could ought i'm you're he's she's it's we're they're i've you've we've
    they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't
    hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's
    there's when's where's why's how's a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very""".split()
)
_PLAIN = re.compile(r"[^\W_]+")
_ENGLISH = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def plain(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _PLAIN.findall(text.lower())


def english(text: str) -> list[str]:
    """Words without possessive endings and stop words, in lower case."""
    words = (w.removesuffix("'s") for w in _ENGLISH.findall(text.lower().replace("’", "'")))
    return [w for w in words if w not in STOP_WORDS]


def english_stems(text: str) -> list[str]:
    return [markup.stem(w) for w in english(text)]


ANALYSERS: dict[str, Callable[[str], list[str]]] = {"plain": plain, "english": english, "english_stems": english_stems}
_LIST = "bucket int, term string, field string, docs array<long>, tfs array<int>, lengths array<int>"
_SIZE = "field string, documents long, tokens long"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _packed(fields: Sequence[str], analyse: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(held: dict[str, list[tuple]], names: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for field, rows in held.items():
            sizes = [len(ids) for _, _, ids, _ in rows]
            docs = np.repeat(np.array([d for d, *_ in rows], np.int64), sizes)
            lengths = np.repeat(np.array([n for _, n, *_ in rows], np.int32), sizes)
            term, counts = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
            order = np.argsort(term, kind="stable")
            offsets = pa.array(np.searchsorted(term[order], np.arange(len(names[field]) + 1)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in (docs, counts, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(list(names[field]), pa.string()), pa.array([field] * len(names[field]), pa.string()), *columns], ["term", "field", "docs", "tfs", "lengths"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {f: [] for f in fields}
        names: dict[str, dict[str, int]] = {f: {} for f in fields}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for field in fields:
                    known = names[field]
                    for doc, text in zip(part.column("doc").to_pylist(), part.column(field).to_pylist(), strict=True):
                        words = analyse(text or "")
                        found = Counter(words)
                        ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found))
                        held[field].append((doc, len(words), ids, np.fromiter(found.values(), np.int32, len(found))))
                if len(held[fields[0]]) >= PACK:
                    yield from lists(held, names)
                    held, names = {f: [] for f in fields}, {f: {} for f in fields}
        if held[fields[0]]:
            yield from lists(held, names)

    return packed


def _sizes(fields: Sequence[str], analyse: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [sum(len(analyse(t or "")) for t in batch.column(f).to_pylist()) for f in fields]
            yield pa.RecordBatch.from_pydict({"field": list(fields), "documents": [batch.num_rows] * len(fields), "tokens": tokens})

    return sizes


class StoredIndex:
    """An inverted index below ``root``: ``postings`` (by bucket) and ``sizes``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    @classmethod
    def build(cls, index: DataFrame, analyser: str = "plain", root: str | None = None) -> StoredIndex:
        """Indexes the rows of ``index`` (id, title, content, heading_text): the plain analyser takes the three as one field,
        the English ones each by itself. Null texts count as empty. Every term's list is spread over the parts that
        tasks have packed, so no list lies in one row."""
        spark = index.sparkSession
        root = root or lineage.folder(spark, "postings")
        if analyser == "plain":
            fields, rows = ["text"], index.select(F.xxhash64("id").alias("doc"), indexed_text().alias("text"))
        else:
            fields, rows = list(BOOSTS), index.select(F.xxhash64("id").alias("doc"), *BOOSTS)
        analyse = ANALYSERS[analyser]
        lists = rows.mapInArrow(_packed(fields, analyse), _LIST.removeprefix("bucket int, ")).withColumn("bucket", _bucket(F.col("term")))
        parts = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spread = F.pmod(F.xxhash64("term"), F.lit(parts * BUCKETS))  # whole buckets where there are as many parts, else shares of one
        lists = lists.repartition(parts, "bucket", (spread / BUCKETS).cast("int") % max(1, parts // BUCKETS)).sortWithinPartitions("bucket", "term")
        lists.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/postings")
        sizes = rows.mapInArrow(_sizes(fields, analyse), _SIZE).groupBy("field").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sizes.coalesce(1).write.parquet(f"{root}/sizes")
        return cls(spark, root)

    def sizes(self) -> dict[str, tuple[int, int]]:
        """Documents and tokens by field."""
        return {r["field"]: (r["documents"], r["tokens"]) for r in self.spark.read.schema(_SIZE).parquet(f"{self.root}/sizes").collect()}

    def postings(self, words: Sequence[str]) -> DataFrame:
        """term, field, doc, tf, length of the lists of ``words``; only their buckets are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"))).collect()]
        lists = self.spark.read.schema(_LIST).parquet(f"{self.root}/postings").where(F.col("bucket").isin(*buckets) & F.col("term").isin(*words))
        return lists.select("term", "field", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p")).select("term", "field", F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))

    def _lengths(self, words: Sequence[str]) -> dict[tuple[str, str], int]:
        buckets = self.postings(words).groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
        return {(r["term"], r["field"]): r["df"] for r in buckets.collect()}

    def bm25(self, query: Sequence[str], any_word: bool = False) -> DataFrame:
        """doc, score (negative, the least is best) of the documents that hold the words of ``query``, over one field."""
        words = list(dict.fromkeys(w.lower() for w in query))
        (documents, tokens), lengths = self.sizes().get("text", (0, 0)), self._lengths(words)
        n = F.lit(float(documents))
        idf = F.lit(0.0)
        for w in words:
            df = float(lengths.get((w, "text"), 0))
            idf = F.when(F.col("term") == w, F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))).otherwise(idf)
        tf, average = F.col("tf"), tokens / documents if tokens else 1.0
        score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(average)))
        found = self.postings(words).groupBy("doc").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("words"))
        return (found if any_word else found.where(F.col("words") == len(words))).select("doc", (-F.col("score")).alias("score"))

    def relaxed(self, words: Sequence[str]) -> DataFrame:
        """doc, score (the highest is best) of the documents that hold any of the analysed ``words`` in any field.

        A word counts sqrt(tf / length) * idf squared * boost, with idf = 1 + ln(documents / (df + 1)); a field's sum is
        multiplied by its share of the words found, the fields' sum by the share of the fields found, and all by the norm
        of the query: one over the root of the sum of (boost * idf) squared.
        """
        words = list(dict.fromkeys(words))
        sizes, lengths = self.sizes(), self._lengths(words)
        part, norm = F.lit(0.0), 0.0
        for field, boost in BOOSTS.items():
            for w in words:
                idf = 1 + np.log(sizes[field][0] / (lengths.get((w, field), 0) + 1)) if sizes.get(field, (0, 0))[0] else 1.0
                norm += (boost * idf) ** 2
                part = F.when((F.col("field") == field) & (F.col("term") == w), F.lit(float(boost * idf * idf))).otherwise(part)
        score = F.sum(F.sqrt(F.col("tf") / F.col("length")) * part) * F.count(F.lit(1)) / float(max(1, len(words)))
        fields = self.postings(words).groupBy("doc", "field").agg(score.alias("sum"))
        whole = F.sum("sum") * F.count(F.lit(1)) / float(len(BOOSTS)) / float(norm**0.5 or 1.0)
        return fields.groupBy("doc").agg(whole.alias("score"))


def top(hits: DataFrame, index: DataFrame, limit: int, best_first: bool = False, conditions: Sequence[Column] = ()) -> DataFrame:
    """The first ``limit`` rows of ``index`` by the scores of ``hits`` (doc, score), ties by id. Without conditions only the
    hits up to the last score that counts are joined with the index."""
    order = F.desc("score") if best_first else F.asc("score")
    if not conditions:
        least = hits.orderBy(order).limit(limit).agg(F.min("score"), F.max("score")).first()
        edge = least[0] if best_first else least[1]
        if edge is not None:
            hits = hits.where(F.col("score") >= edge if best_first else F.col("score") <= edge)
    rows = index.withColumn("doc", F.xxhash64("id")).join(hits, "doc").drop("doc")
    for condition in conditions:
        rows = rows.where(condition)
    return rows.orderBy(order, "id").limit(limit)


def with_fragments(rows: DataFrame, words: Sequence[str]) -> DataFrame:
    """``rows`` with fragment: of the first field that holds one of ``words`` (lower case), the pieces around the first of them,
    all of them marked; empty if none does. Whole texts are searched."""
    wanted = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")

    def pieces(field: str) -> Column:
        return F.regexp_extract_all(F.coalesce(F.col(field), F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))

    hit = lambda x: F.array_contains(wanted, F.lower(x))
    fragment = F.lit("")
    for field in reversed(FRAGMENT_FIELDS):
        cut = pieces(field)
        at = F.array_position(F.transform(cut, hit), True)
        begin = F.greatest(at - BEFORE, F.lit(1))
        window = F.slice(cut, begin.cast("int"), (at + AFTER - begin).cast("int"))
        marked = F.array_join(F.transform(window, lambda x: F.when(hit(x), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x)), "")
        fragment = F.when(at > 0, marked).otherwise(fragment)
    return rows.withColumn("fragment", fragment)
