import hashlib  # noqa: F401
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from tarnwell.llm import packing, sharding, simhash

TEXTS = [
    (1, "the cat sat on the mat and looked at the dog for a long while until dusk"),
    (2, "the cat sat on the mat and looked at the dog for a long while until dusk"),
    (3, "The Cat sat on the mat and looked at the dog for a long while until dusk"),
    (4, None),
    (5, ""),
    (6, "   \n "),
    (7, "one"),
    (8, "one two"),
    (9, "one two three four"),
    (9, "one two three four"),
    (None, "no id here at all"),
    (10, "word " * 30000),
    (11, "été Ñandú 　 wide"),
    (12, "<|endoftext|> stays special"),
]
SCHEMA = "doc_id long, text string, shard string, print string, key string, n int"


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA)


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in distinct}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_match_brute_force(spark):
    got = [(r["doc_id"], r["print"]) for r in simhash.fingerprints(table(spark)).collect()]
    assert Counter(got) == Counter((i, signed(brute_print(t))) for i, t in TEXTS)


def test_groups_match_brute_force(spark):
    got = simhash.near_duplicates(table(spark)).collect()
    assert len(got) == len(TEXTS)
    prints = [(i, brute_print(t)) for i, t in TEXTS]
    top = brute_components([p for _, p in prints])
    least = defaultdict(list)
    for i, p in prints:
        if i is not None:
            least[top[p]].append(i)
    want = Counter((i, min(least[top[p]]) if least[top[p]] else None) for i, p in prints)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want


def test_links_connect_crowded_prints(spark):
    random = np.random.default_rng(5)
    base = int(random.integers(1 << 62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 63, (150, 2))}
    prints |= {int(x) for x in random.integers(1 << 62, size=200)}
    prints |= {base ^ 0b111 << 5, base ^ 0b11111 << 20, 0, 3, 12}
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    edges = simhash.links(df)
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 for r in edges.collect())
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    groups = lambda f: {frozenset(v) for v in _by(f).values() if len(v) > 1}
    assert groups(got) == groups(want)


def _by(labels):
    out = defaultdict(set)
    for k, v in labels.items():
        out[v].add(k)
    return out


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_one(spark):
    kept = simhash.keep_one(table(spark))
    assert kept.columns == table(spark).columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids.count(9) == 1 and 2 not in ids and 5 not in ids and 4 in ids
    assert kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("block", [256, 7])
def test_keep_one_drops_copies_with_edits(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    random = np.random.default_rng(8)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in random.integers(0, 5000, 120)]
        rows.append((10 * k, " ".join(words)))
        words[60] = "edited"
        rows.append((10 * k + 1, " ".join(words)))  # shares 111 of 121 shingles
        rows.append((10 * k + 2, " ".join(words[:30] + [f"x{x}" for x in random.integers(0, 5000, 90)])))
    base = [f"h{x}" for x in random.integers(0, 5000, 100)]
    for k in range(40):  # a key with more holders than BUCKET
        words = list(base)
        for at in random.integers(0, 100, 1 + k % 3):
            words[at] = f"e{k}"
        rows.append((1000 + k, " ".join(words)))
    sets = [(i, simhash.shingle_set(t.encode())) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            shared = len({*a.tolist()} & {*b.tolist()})
            if shared / (len(a) + len(b) - shared) >= 0.8:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    kept = sorted(r["doc_id"] for r in simhash.keep_one(table(spark, rows)).collect())
    assert kept == sorted({top(i) for i, _ in rows})
    assert not {10 * k + 1 for k in range(30)} & set(kept) and {10 * k + 2 for k in range(30)} <= set(kept)


def test_empty_tables(spark):
    empty = table(spark, []).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert sharding.shard_slots(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_shards(spark):
    rows = table(spark, [*TEXTS, *((i, "t") for i in range(100, 3000))])
    got = sharding.shard_slots(rows).collect()
    assert len(got) == len(TEXTS) + 2900
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) < 1.5 * 2914 / 16
    sizes = {(r["doc_id"], r["size"], r["text_crc32"]) for r in got}
    assert sizes >= {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS}
    moved = sum(r["grown_shard"] == 16 for r in got) / len(got)
    assert 0.03 < moved < 0.1


def test_shard_weights(spark):
    rows = table(spark, [(i, "t") for i in range(4000)])
    got = Counter(r["shard"] for r in sharding.assign_shards(rows, (3.0, 1.0, 0.0)).collect())
    assert set(got) == {0, 1} and 2.5 < got[0] / got[1] < 3.6
    with pytest.raises(ValueError):
        sharding.shard_of(rows["doc_id"], (0.0,))


def test_cuts():
    assert packing.cuts(1) == [0] and packing.cuts(2048) == [0] and packing.cuts(4096) == [0, 2048] and packing.cuts(2049) == [0, 1]


def test_pieces_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        starts = packing.cuts(len(ids))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r) for r in packing.pieces(table(spark)).collect()) == want


def test_packing_is_gapless_and_tight(spark):
    random = np.random.default_rng(3)
    rows = table(spark, [*TEXTS, *((100 + i, "word " * int(n)) for i, n in enumerate(random.integers(1, 1500, 300)))])
    got = packing.pack(rows).collect()
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(places) <= 1.03 * total / 2048 + 2
    assert len(got) == packing.pieces(rows).count()


def test_plan_holds_exactly_the_histogram():
    random = np.random.default_rng(1)
    for capacity, top in ((2048, 300), (64, 5), (2048, 1)):
        histogram = np.zeros(capacity + 1, np.int64)
        histogram[1:] = random.integers(0, top + 1, capacity)
        used = packing.plan(histogram, capacity, 5)
        held = np.zeros_like(histogram)
        for config, times in used:
            np.add.at(held, list(config), times)
            assert sum(config) <= capacity and list(config) == sorted(config, reverse=True)
        assert (held == histogram).all()
        assert used == packing.plan(histogram.copy(), capacity, 5)
    assert packing.plan(np.zeros(2049, np.int64)) == []


def test_plan_is_never_worse_than_best_fit():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    encode = packing._encoder(packing.tokenizer_file())
    histogram = np.zeros(packing.CAPACITY + 1, np.int64)
    for text in table["text"].to_pylist():
        count = len(encode(text or "")) + 1
        begins = packing.cuts(count)
        for begin, end in zip(begins, [*begins[1:], count], strict=True):
            histogram[end - begin] += 1
    sequences = lambda used: sum(n for _, n in used)
    assert sequences(packing.plan(histogram)) == 481 == -(-int(histogram @ np.arange(packing.CAPACITY + 1)) // packing.CAPACITY)
    rng = np.random.default_rng(3)
    for _ in range(20):
        capacity = int(rng.integers(10, 200))
        histogram = rng.poisson(0.5, capacity + 1) * rng.integers(1, 30, capacity + 1)
        histogram[0] = 0
        assert sequences(packing.plan(histogram, capacity)) <= sequences(packing.plan(histogram, capacity, 0))


def test_program_beats_best_fit_and_meets_its_bound():
    for capacity in (1000, 2048):
        quarter, e = capacity // 4, capacity // 100
        histogram = np.zeros(capacity + 1, np.int64)
        for length, count in ((capacity // 2 + e, 600), (quarter + 2 * e, 600), (quarter + e, 600), (quarter - 2 * e, 1200)):
            histogram[length] = count
        sequences = lambda rounds: sum(n for _, n in packing.plan(histogram, capacity, rounds))
        assert sequences(0) == 1100  # best fit alone
        assert sequences(packing.ROUNDS) == 900 == round(packing.program(histogram, capacity)[1])


def test_knapsack_matches_brute_force():
    random = np.random.default_rng(6)
    for _ in range(20):
        lengths = np.unique(random.integers(1, 20, 5))
        prices = random.random(len(lengths))
        best = [0.0] * 41
        for room in range(1, 41):
            best[room] = max([0.0, *(best[room - n] + p for n, p in zip(lengths, prices, strict=True) if n <= room)])
        value, choice = packing.knapsack(lengths, prices, 40)
        assert np.allclose(value, best)
        filled = packing._filled(lengths.tolist(), choice.tolist(), 40)
        assert lengths[filled].sum() <= 40 and np.isclose(prices[filled].sum(), best[40])


def test_long_runs_are_tokenized():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.tokenizer_file()), packing._encoder(packing.tokenizer_file())
    for text in (" " * 1_000_000 + "a", "a" * 5000, "x" + " " * 1999 + "y", "\n" * 100_000, "é" * 3000 + " " * 1999):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
