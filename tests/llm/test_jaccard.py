from collections import Counter

import numpy as np
import pytest

from tarnwell.llm import jaccard


def words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def shingles(text):
    w = words(text)
    return {b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_force(docs):
    """All pairs of sets."""
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(docs, sets, strict=True)))


def joined(spark, docs):
    table = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id long, text string, size int, print string")
    return Counter(map(tuple, jaccard.join_components(table).collect()))


def edited(rng, base, edits):
    out = list(base)
    for at in rng.integers(0, len(out), edits):
        out[at] = f"e{rng.integers(0, 10**9)}"
    return " ".join(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    docs = [" ".join(text(int(n))) for n in rng.integers(1, 120, 40)]
    for _ in range(25):  # pairs and small groups around the threshold
        base = text(int(rng.integers(5, 200)))
        docs += [edited(rng, base, int(rng.integers(0, 1 + len(base) // 25))) for _ in range(int(rng.integers(2, 5)))]
    passage = text(60)  # a passage that many unlike texts share
    docs += [" ".join([*text(40), *passage, *text(40)]) for _ in range(30)]
    base = text(150)  # a family whose every shingle is hot
    docs += [edited(rng, base, int(rng.integers(0, 6))) for _ in range(60)]
    docs += [" ".join(base)] * 5 + ["", "  \n", "one", "One", "one two", "a b c", "A b\tc", "a b c d", "a b c d e"]
    order = rng.permutation(len(docs))
    return [(int(i), docs[j]) for i, j in enumerate(order)] + [(9000, None), (9001, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    docs = corpus(seed)
    assert joined(spark, docs) == brute_force(docs)


def test_everything_hot_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(7)
    docs = []
    for chain in range(3):  # each text is like the next, the ends are not
        base = [f"c{chain}w{x}" for x in range(200)]
        for step in range(40):
            base[step * 5] = f"c{chain}n{step}"
            docs.append(" ".join(base))
    docs = [(int(i), docs[j]) for i, j in enumerate(rng.permutation(len(docs)))]
    got = joined(spark, docs)
    assert got == brute_force(docs) and len({c for _, _, c in got}) == 3


def test_families_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(400)]
    docs = []
    for size in range(40, 400, 6):  # prefixes of one text: linked with those up to 100 / 85 as long
        docs += [" ".join(base[:size]), edited(rng, base[:size], 1 + size // 25)]
    docs = [(int(i), docs[j]) for i, j in enumerate(rng.permutation(len(docs)))]
    assert joined(spark, docs) == brute_force(docs)


def test_repeated_rows_and_null_ids(spark):
    docs = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "x y z w"), (5, None), (5, ""), (None, None), (2, "A B C D E F")]
    assert joined(spark, docs) == brute_force(docs)


def test_the_least_similarity_counts(spark):
    # 20 shingles of 23 are shared by two sets of 20 and 23: 20 / 23 is 0.87; of 20 and 24 it is 0.83
    base = [f"w{x}" for x in range(27)]
    docs = [(1, " ".join(base[:23])), (2, " ".join(base[:26])), (3, " ".join(base[:27]))]
    assert joined(spark, docs) == brute_force(docs)


def test_any_level_finds_every_link():
    """The choice of level: of any two linked sets, the prefixes at their levels share as many shingles as both demand."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.sort(rng.choice(1 << 30, size, replace=False))
        b = np.sort(np.concatenate((a[rng.random(size) < rng.uniform(0.8, 1)], rng.choice(1 << 30, int(rng.integers(0, 1 + size // 8))))))
        b = np.unique(b)
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        for x in range(1, jaccard.longest(len(a)) + 1):
            for y in {1, jaccard.longest(len(b)) // 2 + 1, jaccard.longest(len(b))}:
                shared = np.intersect1d(a[: jaccard.prefix(len(a), x)], b[: jaccard.prefix(len(b), min(y, jaccard.longest(len(b))))])
                assert len(shared) >= min(x, y)
    assert all(jaccard.longest(n) <= jaccard.longest(n + 1) for n in range(1, 5000))


def test_levels_follow_the_cost():
    ranks = np.arange(40)
    assert jaccard.choose(1000, ranks, np.full(40, 2))[0] >= 1
    few = jaccard.choose(1000, ranks[:1], np.array([2]))
    many = jaccard.choose(1000, np.arange(190), np.full(190, 9))
    assert few == (1, 0, 0) or few[0] > 1
    assert many[0] == jaccard.longest(1000)  # dear candidates: the longest prefix, and as many shared shingles
    hot = jaccard.choose(1000, np.arange(190), np.full(190, jaccard.HOT + 1))
    assert hot == (jaccard.longest(1000), 190, 190 - jaccard.longest(850) + 1)


def test_empty_table(spark):
    assert joined(spark, []) == Counter()
