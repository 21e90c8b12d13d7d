import zlib
from itertools import product

import numpy as np

from tarnwell.llm import crf

SCHEMA = "doc_id long, text string, score string, _row int, quality int, label int, _id int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4) for r in rows], SCHEMA)


def corpus(count=500):
    random = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(count):
        bad = i % 4 == 0
        lines = [" ".join(random.choice(["alpha", "beta", "gamma", "delta"], 8)) + "." for _ in range(1 + i % 6)]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_marginals_match_enumeration():
    random = np.random.default_rng(0)
    per_text = np.array([3, 1, 4])
    evidence, moves = random.normal(size=(8, 2)), random.normal(size=(2, 2))
    got, pairs = crf.marginals(evidence, moves, per_text)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in per_text:
        total, want = 0.0, np.zeros((n, 2))
        own = np.zeros((2, 2))
        for path in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(evidence[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for t, y in enumerate(path):
                want[t, y] += weight
            for a, b in zip(path, path[1:]):
                own[a, b] += weight
        assert np.allclose(got[at : at + n], want / total)
        want_pairs += own / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_line_measures_match_line_by_line():
    texts = [b"One two!\n\n# a | b", b"", "é x\n".encode(), b"One two!"]
    measures, sizes, per_text = crf.line_measures(texts)
    assert per_text.tolist() == [3, 1, 2, 1] and sizes.tolist() == [9, 1, 8, 1, 5, 1, 9]
    assert np.allclose(measures[0, : crf.OWN], measures[6, : crf.OWN])
    assert np.allclose(measures[1, crf.OWN : 2 * crf.OWN], measures[0, : crf.OWN])
    assert measures[0, 1] == np.float32(np.log1p(2))
    together = crf.line_measures([b"a b\nc d"])[0]
    assert np.allclose(together[0, 2 * crf.OWN : 3 * crf.OWN], together[1, : crf.OWN])


def test_held_out_quality_and_filter(spark):
    rows, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "x " * 100_000), (9002, "x " * 100_000), (None, "no id")]
    docs = table(spark, [*rows, *extra])
    known = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int")
    model = crf.learn(docs, known)
    got = crf.score(docs, model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    want = dict(labels)
    test = [(r["score"] >= 0.5) == bool(want[r["doc_id"]]) for r in got if r["doc_id"] in want and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(test) > 100 and np.mean(test) > 0.97
    twice = {r["score"] for r in got if r["doc_id"] == 9002}
    assert len(twice) == 1
    kept = crf.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert {i for i, y in labels if y} >= {r["doc_id"] for r in kept.collect()} - {9000, 9001, 9002, None}


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus()
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    only = spark.createDataFrame([(i, i % 2) for i in out], "doc_id long, quality int")
    assert crf.learn(table(spark, rows), only) is None


def test_without_a_model_and_empty(spark):
    assert crf.score(table(spark, [(1, "x")]), None).collect()[0]["score"] == 0.5
    empty = table(spark, []).limit(0)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert crf.keep_good(empty, none).count() == 0
