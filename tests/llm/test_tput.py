import math
import re
from collections import Counter

import pytest

from tarnwell.llm import tput

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, items, k):
    """Every item scored against every document, one by one."""
    terms = [Counter(TERM.findall((t or "").translate(UPPER))) for _, t in docs]
    sizes = [c.total() for c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for row, (doc, _) in enumerate(docs):
            score = 0
            for t in set(TERM.findall((text or "").translate(UPPER))) & terms[row].keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + 50 * sizes[row] * n // total
                score += w * (1000000000 * terms[row][t] // (1000 * terms[row][t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, k):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, rank int")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    return sorted(map(tuple, tput.rank_documents(d, i, k).collect()), key=str)


def corpus():
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[(i * j * j + j) % (10 + i % 50)] for j in range(3 + i * 7 % 90))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "?! --"), (203, docs[5][1]), (204, docs[5][1].upper()), (205, "Été été ÉTÉ W1 x" * 3), (206, "w1 " * 5000)]
    items = [(1, "w1 w2 w3 w1"), (2, "w5"), (3, None), (4, "absent"), (5, " ".join(words)), (6, "ÉTÉ, Été!"), (7, "W7 w8 w9 w10 w11")]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranks_match_brute_force(spark, k):
    docs, items = corpus()
    assert ranked(spark, docs, items, k) == brute_force(docs, items, k)


def test_repeated_rows_null_ids_and_repeated_items(spark):
    docs = [(1, "a b"), (1, "a b"), (1, "a c"), (None, "a b"), (None, "b"), (2, "c"), (None, None)]
    items = [(9, "a b"), (9, "a b"), (None, "c")]
    assert ranked(spark, docs, items, 4) == brute_force(docs, items, 4)


def test_small_slices_and_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = corpus()
    want = brute_force(docs, items, 5)
    monkeypatch.setattr(tput, "BLOCK_TERMS", 30)
    monkeypatch.setattr(tput, "CELLS", 40)
    assert ranked(spark, docs, items, 5) == want


def test_bounds_exclude_documents_and_entries(spark):
    """A short item reads its lists only in part, and looks few documents up."""
    docs = [(i, f"rare{i % 40} " + "common " * (1 + i % 9) + "filler " * (i % 13)) for i in range(400)]
    items = [(1, "rare3 common")]
    assert ranked(spark, docs, items, 3) == brute_force(docs, items, 3)


def test_terms_are_counted_as_bytes():
    for text in ("", " ", "a", "a-b c1", "É é", "x" * 9, "\x00a\x7fb", "a" * 5 + "\n"):
        assert tput.count_terms(text.encode()) == len(TERM.findall(text))


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")], 3) == [] and ranked(spark, [(1, "a b"), (2, "c")], [], 3) == []
