"""Best-fit packing of token sequences by a configuration linear program.

1. Documents are tokenized on the executors and cut into pieces; pieces stay there.
2. The driver sees only the histogram of piece lengths, at most ``capacity`` numbers. A configuration is a multiset of
   lengths that fits a sequence; the linear program asks for the fewest configurations that hold the histogram.
   Multiplicative weights solve it: every length has a price, which falls as the length gets covered. A knapsack dynamic
   program gives the dearest configuration at these prices, and from the same table the dearest that holds a given length;
   those within SLACK of the dearest are used, as often as what their lengths lack allows. Prices over the dearest value
   bound the number of sequences from below.
3. Rounding: of each usage a share is taken, rounded down, and never more than what is left; the rest is packed best fit,
   longest first, on the histogram again. Several shares are tried, and the plan of fewest sequences is used.
4. A piece gets its place from its rank among the pieces of its length, so the plan is as large as the number of
   configurations, whatever the number of pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, gapless, slices

CAPACITY = 2048
END = 0
#: Knapsack tables in the multiplicative weights, how strongly prices fall, and how much less than the dearest will do.
ROUNDS, RATE, SLACK = 40, 2.0, 0.02
#: Share of what the scarcest length of a configuration lacks that one use covers.
STEP = 0.5
#: Shares of the program's usages that are tried: usages taken whole can strand lengths that the rest then doesn't fill.
SHARES = (1.0, 0.95, 0.9, 0.75, 0.5, 0.0)
#: Texts with a run of so many characters of one kind (space or not) go to the tokenizer itself: the fast one recurses there.
LONG_RUN = 2000

Config = tuple[int, ...]  # lengths, longest first


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text -> ids: tiktoken over the file's own vocabulary, four times as fast as the tokenizer itself, which takes the texts
    that hold a special token's string or a LONG_RUN, and all texts if the file does not split as GPT-2 does."""
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [x["content"] for x in spec.get("added_tokens", [])]
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")

    def slow(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    if not plain:
        return slow
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of the type ByteLevel
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or long_run.search(text):
            return slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document start: all are full but the first."""
    if length <= capacity:
        return [0]
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of ``docs``: ids of the whole text (null: empty), then 0."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = np.append(encode((text or b"").decode("utf-8", "replace")), np.uint32(END)).astype("<u4")
                begins = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest total price of ``lengths`` (ascending) that fit each room up to ``capacity``, and the index of one of them
    (-1: none). As many rooms at a time as the shortest length allows; of equal prices the shorter length is taken."""
    least = int(lengths[0])
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for low in range(least, capacity + 1, least):
        at = np.arange(low, min(low + least, capacity + 1))
        usable = lengths[: np.searchsorted(lengths, at[-1], "right")]
        left = at[:, None] - usable[None, :]
        gain = np.where(left >= 0, value[left] + prices[: len(usable)], -1.0)
        best = gain.argmax(axis=1)
        top = gain[np.arange(len(at)), best]
        value[at], choice[at] = top, np.where(top > 0, best, -1)
    return value, choice


def _filled(lengths: list[int], choice: list[int], room: int) -> list[int]:
    """Indices of the lengths that the knapsack puts into ``room``."""
    found = []
    least = lengths[0]
    while room >= least and choice[room] >= 0:
        found.append(choice[room])
        room -= lengths[choice[room]]
    return found


def program(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[dict[Config, float], float]:
    """Configurations with fractional usages that cover the histogram, as far as ``rounds`` tables bring them, and a lower
    bound of the number of sequences that any packing needs."""
    all_lengths = np.flatnonzero(histogram[1:]) + 1
    need = histogram[all_lengths].astype(float)
    prices = all_lengths / capacity
    lack = need.copy()
    used: dict[Config, float] = {}
    bound = 0.0
    for _ in range(rounds):
        if not (lack > 0).any():
            break
        open_ = np.flatnonzero(lack > 0)
        lengths = all_lengths[open_]
        value, choice = knapsack(lengths, prices[open_], capacity)
        bound = max(bound, float(need[open_] @ prices[open_]) / value[capacity])  # weak duality
        sizes, picks = lengths.tolist(), choice.tolist()
        with_it = value[capacity - lengths] + prices[open_]
        for i in np.flatnonzero(with_it >= (1 - SLACK) * value[capacity])[::-1].tolist():
            where, counts = np.unique(open_[[i, *_filled(sizes, picks, capacity - sizes[i])]], return_counts=True)
            if not (lack[where] > 0).all():
                continue
            step = float((STEP * lack[where] / counts).min())
            step = max(step, min(1.0, 2 * step))
            lack[where] = np.maximum(lack[where] - step * counts, 0)
            prices[where] *= np.exp(-RATE * step * counts / need[where])
            config = tuple(np.repeat(all_lengths[where], counts)[::-1].tolist())
            used[config] = used.get(config, 0.0) + step
    return used, bound


def fill(left: np.ndarray, counts: np.ndarray, room: int) -> int:
    """Adds to ``counts`` the longest lengths that fit and are left, again and again; returns the room that stays."""
    while True:
        free = np.flatnonzero(left[: room + 1] > counts[: room + 1])
        if not len(free):
            return room
        longest = int(free[-1])
        k = min(int(left[longest] - counts[longest]), room // longest)
        counts[longest] += k
        room -= k * longest


def rounded(histogram: np.ndarray, fraction: dict[Config, float], share: float) -> list[tuple[Config, int]]:
    """Configurations and how often each is used; together exactly ``histogram``. ``share`` of each usage, rounded down and as
    far as its lengths last; the rest best fit, longest first."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used: list[tuple[Config, int]] = []
    for config, amount in sorted(fraction.items(), key=lambda x: (-x[1], x[0])):
        where, counts = np.unique(config, return_counts=True)
        times = min(int(share * amount + 1e-9), int((left[where] // counts).min()))
        if times <= 0:
            continue
        left[where] -= counts * times
        room = capacity - sum(config)
        if room:  # the same lengths in every use, as long as they last
            more = np.zeros(capacity + 1, np.int64)
            fill(left // times, more, room)
            left -= more * times
            config = tuple(sorted((*config, *np.repeat(np.arange(capacity + 1), more).tolist()), reverse=True))
        used.append((config, times))
    while left.any():
        counts = np.zeros(capacity + 1, np.int64)
        fill(left, counts, capacity)
        some = counts > 0
        times = int((left[some] // counts[some]).min())
        left -= counts * times
        used.append((tuple(np.repeat(np.arange(capacity + 1), counts)[::-1].tolist()), times))
    return used


def plan(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """The plan of fewest sequences among those that take one of SHARES of the program's usages; none is best fit alone, so
    no plan is worse than that. Of equally good ones the one of the largest share; equal histograms give equal plans."""
    fraction, _ = program(histogram, capacity, rounds)
    return min((rounded(histogram, fraction, share) for share in SHARES), key=lambda used: sum(n for _, n in used))


def places(used: list[tuple[Config, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, first sequence and offset of each run of its places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for config, times in used:
        offset = 0
        for length in config:
            runs.setdefault(length, []).append((ranks.get(length, 0), base, offset))
            ranks[length] = ranks.get(length, 0) + times
            offset += length
        base += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """pieces() of ``docs`` with sequence_id and offset; sequences hold at most ``capacity`` tokens without gaps.

    Null and empty texts are a piece of one token; very long texts are cut into many. Repeated rows and pieces of equal
    length are packed like any others, in the order of their rows. Columns other than doc_id and text are not read. An empty
    table gives an empty result.
    """
    found = gapless(pieces(docs, path, capacity), "length", "_rank")
    found = cut(found)
    histogram = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    placed = places(plan(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, begins = np.unique(length[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, begins[1:]), strict=True):
                first, base, at = placed[value]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return found.select(*columns, "_rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
