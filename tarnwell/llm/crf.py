"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good (1) or bad (0). Its evidence are measures of the line itself and of the lines before and after it;
transitions tie neighbours together. Labels are known per document only, so in training every line carries its
document's label. A document's score is the mean marginal of "good" over its lines, weighted by their lengths.

The model is fitted on the driver to a sample of labelled documents of bounded size (SAMPLE_DOCS, SAMPLE_LINES); scoring
covers every line of every text and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, within

#: Labelled documents to learn from at most, and the most lines that each of them may have.
SAMPLE_DOCS, SAMPLE_LINES = 6000, 256
#: Bytes of text after which a slice that is scored at once ends.
SCORED_BYTES = 1 << 22
#: Rows of crc32(doc_id) mod HELD_OUT_OF == HELD_OUT teach nothing.
HELD_OUT_OF, HELD_OUT = 3, 1
EPOCHS, BATCH_DOCS, RATE, DECAY = 12, 256, 0.05, 1e-3
SEED = 3

_SYMBOLS, _ENDS = b"#*$%&|<>", b".,;:?"


def _classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 white space, 4 symbol, 5 exclamation mark, 6 sentence mark, 7 beyond ASCII, 8 other."""
    table = np.full(256, 8, np.uint8)
    table[128:] = 7
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[32, *range(9, 14)]] = 3
    table[list(_SYMBOLS)], table[ord("!")], table[list(_ENDS)] = 4, 5, 6
    return table


CLASSES = _classes()
OWN = 15  # measures of a line
WIDTH = 3 * OWN + 3  # with both neighbours, whether there are any, and a constant


def line_measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures (lines x WIDTH), bytes of each line and lines of each text. An empty text is one empty line."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    kinds = CLASSES[joined]
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(9)], axis=1).astype(np.float32)
    counts[:, 3] -= 1  # the line's own end
    space = kinds == 3
    opens = ~space
    opens[1:] &= space[:-1]
    words = np.add.reduceat(opens, starts, dtype=np.int64).astype(np.float32)
    repeated, distinct = np.zeros(len(sizes), np.float32), np.ones(len(sizes), np.float32)
    at = 0
    for text in texts:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            own = line.split()
            if own:
                distinct[at] = len(set(own)) / len(own)
                repeated[at] = line in seen
                seen.add(line)
            at += 1
    size, word = np.maximum(sizes, 1).astype(np.float32), np.maximum(words, 1)
    bars = np.add.reduceat(joined == ord("|"), starts, dtype=np.int64).astype(np.float32)
    own = np.column_stack(
        [np.log1p(sizes), np.log1p(words), (sizes - counts[:, 3]) / word / 8, *(counts[:, k] / size for k in (0, 1, 2, 4, 6, 7, 8)), np.minimum(counts[:, 5] / word, 2), np.minimum(counts[:, 4] / word, 2), np.minimum(bars / word, 2), repeated, distinct]
    ).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    last = np.cumsum(per_text) - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    alone = np.zeros((len(own), 3), np.float32)
    alone[first, 0], alone[last, 1], alone[:, 2] = 1, 1, 1
    return np.hstack([own, before, after, alone]), sizes + 1, per_text


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # WIDTH x 2
    moves: np.ndarray  # from, to

    def evidence(self, measures: np.ndarray) -> np.ndarray:
        return ((measures - self.mean) / self.spread) @ self.weights


def _steps(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text starts, longest text first; and how many texts have a line t."""
    order = np.argsort(-per_text, kind="stable")
    starts = (np.cumsum(per_text) - per_text)[order]
    longest = int(per_text.max(initial=0))
    active = len(per_text) - np.searchsorted(np.sort(per_text), np.arange(longest), "right")
    return starts, active, order


def marginals(evidence: np.ndarray, moves: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label of each line, and expected transitions per text pair of lines, summed (2 x 2).

    Forward and backward recursions in logarithms, all texts of the batch at once.
    """
    starts, active, _ = _steps(per_text)
    forward, backward = evidence.copy(), np.zeros_like(evidence)
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        into = forward[at - 1][:, :, None] + moves
        forward[at] += np.logaddexp(into[:, 0], into[:, 1])
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        out = moves + (evidence[at] + backward[at])[:, None, :]
        backward[at - 1] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        joint = forward[at - 1][:, :, None] + out
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = forward + backward
    both -= both.max(axis=1, keepdims=True)
    odds = np.exp(both)
    return odds / odds.sum(axis=1, keepdims=True), pairs


def fit(measures: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model that makes the lines' labels likeliest, each document counting once; Adam on batches of documents."""
    together = np.concatenate(measures)
    model = Model(together.mean(axis=0), together.std(axis=0) + 0.05, np.zeros((WIDTH, 2)), np.zeros((2, 2)))
    model.mean[-1], model.spread[-1] = 0, 1  # the constant
    random = np.random.default_rng(SEED)
    momentum, variance = [np.zeros((WIDTH, 2)), np.zeros((2, 2))], [np.zeros((WIDTH, 2)), np.zeros((2, 2))]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(measures))
        for low in range(0, len(order), BATCH_DOCS):
            docs = order[low : low + BATCH_DOCS]
            x = (np.concatenate([measures[i] for i in docs]) - model.mean) / model.spread
            per_text = np.array([len(measures[i]) for i in docs])
            y = np.repeat(labels[docs], per_text)
            share = np.repeat(1.0 / per_text, per_text)
            odds, pairs = marginals(x @ model.weights, model.moves, per_text)
            wrong = (np.eye(2)[y] - odds) * share[:, None]
            seen = np.diag([((per_text - 1) * (labels[docs] == k)).sum() for k in (0, 1)]).astype(float)
            scale = max(1.0, float((per_text - 1).sum()))
            slopes = [x.T @ wrong / len(docs) - DECAY * model.weights, (seen - pairs) / scale - 10 * DECAY * model.moves]
            step += 1
            rate = RATE / (1 + epoch / 3)
            for k, (value, slope) in enumerate(zip((model.weights, model.moves), slopes, strict=True)):
                momentum[k] = 0.9 * momentum[k] + 0.1 * slope
                variance[k] = 0.99 * variance[k] + 0.01 * slope**2
                value += rate * (momentum[k] / (1 - 0.9**step)) / (np.sqrt(variance[k] / (1 - 0.99**step)) + 1e-8)
    return model


def scores(texts: list[bytes], model: Model | None) -> np.ndarray:
    """Quality of each text, 0 to 1; 0.5 without a model."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    measures, sizes, per_text = line_measures(texts)
    good = marginals(model.evidence(measures), model.moves, per_text)[0][:, 1]
    first = np.cumsum(per_text) - per_text
    return np.clip(np.add.reduceat(good * sizes, first) / np.add.reduceat(sizes, first), 0.0, 1.0)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = as_bytes(batch.column(2))
        short = [i for i, t in enumerate(texts) if t.count(b"\n") < SAMPLE_LINES]
        if short:
            measures, _, per_text = line_measures([texts[i] for i in short])
            parts = [m.tobytes() for m in np.split(measures, np.cumsum(per_text)[:-1])]
            kept = batch.take(pa.array(short))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(parts, pa.binary())], ["doc_id", "label", "measures"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model fitted to the sample; None unless both labels occur in it. The sample is the same for the same rows."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # SAMPLE_DOCS ids at most
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(_measured, "doc_id long, label int, measures binary")
    taken = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("measures")).limit(SAMPLE_DOCS).collect()
    measures = [np.frombuffer(r["measures"], np.float32).reshape(-1, WIDTH) for r in taken]
    y = np.array([r["label"] for r in taken], int)
    return fit(measures, y) if len(set(y.tolist())) == 2 else None


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with the double ``name``. Null texts count as empty; repeated rows get equal scores; other columns pass
    through, one of this name is replaced. Texts are scored in slices that end with the text that brings them to SCORED_BYTES;
    an empty table stays empty."""

    @F.arrow_udf("double")
    def quality(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        found = [scores(as_bytes(part.column(0)), model) for part in within(iter([batch]), "text", 1024, SCORED_BYTES)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn(name, quality(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score by a model learned from ``labels`` reaches ``threshold``; all of them if there
    is no model. Rows are treated as by score()."""
    model = learn(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return score(rows, model, "_score").where(F.col("_score") >= threshold).select("_row.*")
