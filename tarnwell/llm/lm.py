"""Language-model scoring of whole documents: exact corpus counts for the base score, a recurrent model for the score.

1. Counts: every training text's words are counted on the executors; the table (word, count) is never brought together.
2. The most frequent words, HOT at most, go to the executors with their counts; the first VOCABULARY of them are the
   recurrent model's words, all others are one unknown word to it.
3. Training reads every token of every training text, in text order. Texts are dealt by a hash of their rows to trainers,
   one for every TRAINER_TOKENS tokens, so what each learns depends on the rows and not on how files split them. All
   trainers begin with the same model; their models are averaged by their tokens, ROUNDS times.
4. Scoring: the state runs through the whole text. A word outside the model's vocabulary has the probability of the
   unknown word times its own share, by the counts, of what unknown words have.
5. The words' numbers are kept between these steps; words that are not hot are looked up by a join: per text only its distinct rare words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import PIECE_BYTES, cut, slices, within

#: Rows of crc32(doc_id) mod HELD_OUT_OF == HELD_OUT teach nothing.
HELD_OUT_OF, HELD_OUT = 7, 2
HOT, VOCABULARY = 50_000, 2000
TRAINER_TOKENS, ROUNDS = 2_000_000, 1
#: Count buckets for each factor of e between counts.
BUCKETS = 64
#: Distinct words that a task counts before it hands them on, and numbers of a model's block.
FLUSH, BLOCK = 300_000, 4096
#: Texts whose words are read together, if they take PIECE_BYTES at most.
READ_ROWS = 2048
#: Texts that are scored together.
SCORED_ROWS = 4096
END = b""  # no word is empty


def tokens(texts: pa.Array) -> pa.ListArray:
    """Each text's lower-case words (A-Z only), then the end. Null counts as empty."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    # An empty word follows white space at a text's end, and is all that an empty text has.
    return pc.ascii_split_whitespace(pc.binary_join_element_wise(texts, pc.if_else(pc.equal(texts, ""), "", " "), ""))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def merged() -> pa.Table:
        return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"]).combine_chunks()

    for batch in within(batches, "text", READ_ROWS, PIECE_BYTES):
        words, n = pc.value_counts(tokens(batch.column("text")).flatten()).flatten()
        held.append(pa.RecordBatch.from_arrays([words.cast(pa.binary()), n], ["word", "n"]))
        rows += len(n)
        if rows > 2 * FLUSH:
            held = merged().to_batches()
            rows = sum(b.num_rows for b in held)
            if rows > FLUSH:
                yield from held
                held, rows = [], 0
    if held:
        yield from merged().to_batches()


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary; the end is empty) and c of the training rows of ``docs``."""
    rows = docs.where(~held_out(F.col("doc_id"))).select("text")
    return rows.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """What executors need to know of the counts."""

    hot: pa.Array  # words, in the order of c
    c: np.ndarray
    shape: gru.Shape
    vocabulary: int
    total: int
    distinct: int
    rare_total: int  # of words outside the model's vocabulary
    rare_distinct: int

    @property
    def stored(self) -> np.dtype:
        """How the model's words are stored."""
        return np.dtype("<u2" if self.vocabulary < 60_000 else "<u4")

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of hot words, -1 for others."""
        return pc.index_in(words, value_set=self.hot).fill_null(-1).to_numpy(zero_copy_only=False)

    def model_words(self, places: np.ndarray) -> np.ndarray:
        return np.where((places >= 0) & (places < self.vocabulary), places + gru.END, gru.UNKNOWN).astype(np.int32)


def lexicon(counts: DataFrame, hot: int = HOT, vocabulary: int = VOCABULARY) -> Lexicon:
    sums = counts.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    words = counts.where(F.octet_length("word") > 0)
    # Words of a count bucket are taken together, the highest buckets first, as long as all of them are `hot` at most.
    bucket = F.floor(F.log(F.col("c").cast("double")) * BUCKETS).cast("int")
    least, taken = None, 0
    for r in sorted(words.groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r["b"]):  # about 64 times the log of the largest count
        if taken + r["count"] > hot:
            break
        least, taken = r["b"], taken + r["count"]
    found = words.where(bucket >= least).collect() if least is not None else []  # `hot` rows at most
    top = sorted(found, key=lambda r: (-r["c"], bytes(r["word"])))
    ends = counts.where(F.octet_length("word") == 0).first()
    words = [END, *(bytes(r["word"]) for r in top)]
    c = np.array([ends["c"] if ends else 0, *(r["c"] for r in top)], np.int64)
    known = c[:vocabulary]
    total, distinct = sums["total"] or 0, sums["distinct"]
    rare_total = total - int(known.sum())
    shape = gru.Shape(np.concatenate([[rare_total], known]))
    return Lexicon(pa.array(words, pa.binary()), c, shape, vocabulary, total, distinct, rare_total, max(0, distinct - int((known > 0).sum())))


def train(texts: DataFrame, lex: Lexicon) -> dict[str, np.ndarray]:
    """The recurrent model averaged over the trainers' models, from ``texts`` (key, words). A trainer holds
    2 * TRAINER_TOKENS tokens at most at once."""
    model = gru.start(lex.shape)
    trainers = max(1, -(-lex.total // TRAINER_TOKENS))
    dealt = texts.repartition(trainers, "key").sortWithinPartitions("key", "words").select("words")
    for _ in range(ROUNDS):
        begin = model

        def run(batches: Iterator[pa.RecordBatch], begin: dict = begin) -> Iterator[pa.RecordBatch]:
            texts, held, read, own = [], 0, 0, begin
            for batch in slices(batches):
                for words in batch.column(0).to_pylist():
                    texts.append(np.frombuffer(words, lex.stored))
                    held += len(texts[-1])
                    if held >= 2 * TRAINER_TOKENS:
                        own, read, texts, held = gru.train(own, lex.shape, texts), read + held, [], 0
            if texts:
                own, read = gru.train(own, lex.shape, texts), read + held
            if read:
                values = gru.flat(own)
                parts = [values[at : at + BLOCK] for at in range(0, len(values), BLOCK)]
                columns = [pa.array(range(len(parts)), pa.int32()), pa.array([float(read)] * len(parts)), pa.array([p.tobytes() for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "weight", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for block, weight, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held = sums.setdefault(block, [0.0, 0.0])
                    held[0] += weight
                    held[1] = held[1] + weight * np.frombuffer(part, np.float32).astype(np.float64)
            if sums:
                mean = [(held[1] / held[0]).astype(np.float32).tobytes() for held in sums.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(mean, pa.binary())], ["block", "mean"])

        parts = dealt.mapInArrow(run, "block int, weight double, part binary")
        found = parts.repartition("block").mapInArrow(add, "block int, mean binary").collect()  # one model
        if found:
            blocks = sorted((r["block"], r["mean"]) for r in found)
            model = gru.unflat(np.frombuffer(b"".join(m for _, m in blocks), np.float32), model)
    return model


_READ = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("teaches", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("hot_sum", pa.float64()), ("unknown_sum", pa.float64()), ("n_unknown", pa.int64())]
    + [("words", pa.binary()), ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))]
)
_NUMBERS = "row long, doc_id long, n_tokens long, known long, hot_sum double, unknown_sum double, n_unknown long"
_READ_SQL = "row long, doc_id long, key long, teaches boolean, n_tokens long, known long, hot_sum double, unknown_sum double, n_unknown long, words binary, rare array<struct<word:binary,n:int>>"


def _lists(lengths: np.ndarray) -> np.ndarray:
    """Offsets of lists of these lengths."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def score(docs: DataFrame, hot: int = HOT, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Null texts count as empty: one token, the end. Null ids are training rows. Repeated rows get equal scores and count
    as often as they occur. Very long texts are scored whole, the state running through; a batch holds their numbers only. Without training rows every count is zero. Other columns are not read; an empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", "text")
    counts = cut(count_words(docs))
    lex = lexicon(counts, hot, vocabulary)
    logs = np.log10(lex.c + 1.0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in within(batches, "text", READ_ROWS, PIECE_BYTES):
            words = tokens(batch.column("text"))
            lengths = pc.list_value_length(words).to_numpy()
            coded = words.flatten().dictionary_encode()
            distinct, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            # What is known of each distinct word goes to all its places.
            places = lex.places(distinct)
            log, outside = np.where(places >= 0, logs[places], 0.0), (places < 0) | (places >= lex.vocabulary)
            sums = [np.bincount(owner, of_word[codes], len(lengths)) for of_word in ((places >= 0) & (lex.c[places] > 0), log, np.where(outside, log, 0.0), outside)]
            columns = [pa.array(c.astype(_READ.field(k).type.to_pandas_dtype())) for k, c in enumerate([lengths, *sums], 4)]
            stored = lex.model_words(places).astype(lex.stored)[codes]
            numbers = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(_lists(lengths.astype(np.int64) * stored.itemsize)), pa.py_buffer(stored)])
            at = np.flatnonzero((places < 0)[codes])
            pairs, times = np.unique(owner[at] * len(distinct) + codes[at], return_counts=True)
            of, word = np.divmod(pairs, len(distinct))
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array(times.astype(np.int32))], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(_lists(np.bincount(of, minlength=len(lengths)))), rare)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns, numbers, rare], _READ.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SCORED_ROWS):
            found = gru.score(model, lex.shape, [np.frombuffer(w, lex.stored) for w in batch.column(7).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(found / np.log(10))], [*batch.schema.names[:7], "model_sum"])

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), (~held_out(F.col("doc_id"))).alias("teaches"), "text"
    )
    # One pass gives the rows' numbers and words; the checkpoint fixes both.
    done = cut(numbered.mapInArrow(read, _READ_SQL))
    model = train(done.where("teaches").select("key", "words"), lex)
    rare = done.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_sum"))
    scored = done.select("row", "doc_id", "n_tokens", "known", "hot_sum", "unknown_sum", "n_unknown", "words").mapInArrow(run, f"{_NUMBERS}, model_sum double")
    rows = scored.join(found, "row", "left")
    rare_known, rare_sum = F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_sum", F.lit(0.0))
    size = float(np.log10(lex.total + lex.distinct + 1))
    rare_size = float(np.log10(lex.rare_total + lex.rare_distinct + 1))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + rare_known).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + rare_sum - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("model_sum") + F.col("unknown_sum") + rare_sum - F.col("n_unknown") * F.lit(rare_size)).alias("score"),
    )
