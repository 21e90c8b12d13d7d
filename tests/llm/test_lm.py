import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tarnwell.llm import gru, lm

SCHEMA = "doc_id long, text string, word string, row string, score string, c int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def corpus(count=400):
    random = np.random.default_rng(2)
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(common[(i + k * 7) % 60] if k % 2 else random.choice(common) for k in range(20 + i % 50))) for i in range(count)]
    return rows + [(1000, None), (1001, ""), (1002, "Rare ÉTÉ été never-seen\x0bwords"), (1003, "w1 " * 30000), (1004, "same"), (1004, "same"), (None, "no id")]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores_match_brute_force(spark):
    rows = corpus()
    words = lambda t: [*(w for w in (t or "").encode().lower().split()), b""]
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    total, distinct = sum(c.values()), len(c)
    got = sorted((r.asDict() for r in lm.score(table(spark, rows), hot=30, vocabulary=10).collect()), key=lambda r: (str(r["doc_id"]), r["base_score"]))
    want = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w)
        want.append({"doc_id": i, "held_out": out(i), "n_tokens": len(w), "n_known": sum(c[x] > 0 for x in w), "train_tokens": total, "base_score": base})
    want.sort(key=lambda r: (str(r["doc_id"]), r["base_score"]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g.pop("base_score"), w.pop("base_score"), rel_tol=1e-9)
        assert g.pop("score") < 0 and g == w


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = corpus(3000)[:3000]
    got = lm.score(table(spark, rows)).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def small():
    counts = np.array([50, 30, *range(40, 0, -1)])
    shape = gru.Shape(counts)
    return gru.start(shape), shape


def test_probabilities_sum_to_one():
    model, shape = small()
    words = len(shape.of)
    h = np.random.default_rng(1).normal(size=(1, gru.STATE)).astype(np.float32)
    model["words"] += 0.3
    logs = gru.log_odds(model, shape, np.repeat(h, words, axis=0), np.arange(words))
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_gradients_match_differences():
    model, shape = small()
    random = np.random.default_rng(3)
    model = {k: (v + random.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in model.items()}
    words = random.integers(0, len(shape.of), (5, 3))
    mask = np.ones(words.shape, bool)
    mask[3:, 1] = False
    opens = np.zeros(words.shape, bool)
    opens[2, 0] = opens[0, 2] = True
    h, before = random.normal(size=(3, gru.STATE)), np.array([1, 4, 7])
    slopes, _, _ = gru.gradients(model, shape, words, opens, before, h, mask)
    for k, v in model.items():
        for at in random.integers(0, v.size, 6):
            v.flat[at] += 1e-5
            up = gru.gradients(model, shape, words, opens, before, h, mask)[2]
            v.flat[at] -= 2e-5
            down = gru.gradients(model, shape, words, opens, before, h, mask)[2]
            v.flat[at] += 1e-5
            assert abs((up - down) / 2e-5 - slopes[k].flat[at]) < 1e-3, k


def test_lanes_give_the_score_of_each_text_alone(monkeypatch):
    model, shape = small()
    random = np.random.default_rng(4)
    model = {k: (v + random.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in model.items()}
    texts = [np.append(random.integers(2, 40, n), 1).astype(np.int32) for n in (0, 1, 90, 30, 55, 7, 200)]
    monkeypatch.setattr(gru, "LANES", 3)
    together = gru.score(model, shape, texts)
    alone = [gru.score(model, shape, [t])[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)


def test_window_log_probability_is_that_of_the_score(monkeypatch):
    model, shape = small()
    random = np.random.default_rng(8)
    model = {k: (v + random.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in model.items()}
    texts = [np.append(random.integers(2, 40, n), 1).astype(np.int32) for n in (4, 9, 2, 6)]
    monkeypatch.setattr(gru, "WINDOW", 50)
    [(words, _, opens, mask)] = gru._windows(texts, [0, 1, 2, 3], 2)
    total = gru.gradients(model, shape, words, opens, np.full(2, gru.END), np.zeros((2, gru.STATE), np.float32), mask)[2]
    assert abs(total - gru.score(model, shape, texts).sum()) < 1e-2


def test_windows_hold_every_token_once_and_in_order():
    random = np.random.default_rng(9)
    texts = [random.integers(2, 40, n).astype(np.uint16) for n in (1, 47, 48, 191, 1000, 3)]
    found, begins = [[] for _ in texts], [0] * len(texts)
    for words, owner, opens, live in gru._windows(texts, [3, 5, 0, 4, 2, 1], 3):
        for t, k in zip(*np.nonzero(live), strict=True):
            found[owner[t, k]].append(words[t, k])
            begins[owner[t, k]] += opens[t, k]
    assert all(list(t) == f for t, f in zip(texts, found, strict=True)) and begins == [1] * len(texts)


def test_extreme_logits_stay_finite():
    x = np.array([[200.0, -200.0], [-300.0, -301.0]], np.float32)
    logs = gru._chosen(x.copy(), (np.arange(2), np.array([0, 1])))
    assert np.allclose(logs, [0, -1.31326], atol=1e-4)


def test_score_does_not_depend_on_the_split_and_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    split = [{r["doc_id"]: (r["held_out"], r["base_score"], r["score"]) for r in lm.score(docs.repartition(n)).collect()} for n in (1, 7)]
    assert all(math.isclose(split[0][k][2], v[2], rel_tol=1e-3) for k, v in split[1].items())
    out = [v for v in split[0].values() if v[0]]
    assert sum(v[2] for v in out) > sum(v[1] for v in out)


def test_a_trainer_holds_a_bounded_number_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 3000)
    rows = [(5, " ".join(f"w{i % 50}" for i in range(4000)))] * 3 + corpus(50)[:50]
    assert all(r["score"] < 0 for r in lm.score(table(spark, rows)).collect())


def test_empty_table(spark):
    assert lm.score(table(spark, []).limit(0)).count() == 0


def test_words_are_cut_at_ascii_white_space_only():
    random = np.random.default_rng(6)
    characters = [*" \t\n\x0b\x0c\r", "\x00", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "a", "B", "Z", "\u00c9"]
    texts = ["".join(random.choice(characters, n)) for n in random.integers(0, 12, 2000)] + ["", "  ", None]
    got = lm.tokens(pa.array(texts, pa.string())).cast(pa.list_(pa.binary())).to_pylist()
    assert got == [[*(t or "").encode().lower().split(), b""] for t in texts]


def test_counting_costs_less_than_a_loop_over_words():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).combine_chunks()
    want: Counter = Counter()

    def loop():
        want.clear()
        for text in texts["text"].to_pylist():
            want.update([*(text or "").encode().lower().split(), b""])

    def count():
        got.clear()
        for batch in lm._count(iter(texts.to_batches())):
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[word] += n

    def least(run):
        found = []
        for _ in range(2):
            begin = time.process_time()
            run()
            found.append(time.process_time() - begin)
        return min(found)

    got: Counter = Counter()
    count()
    loop()
    assert got == want
    assert least(lambda: list(lm._count(iter(texts.to_batches())))) < 0.7 * least(loop)


def test_counts_handed_on_in_parts_add_up(monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 40)
    monkeypatch.setattr(lm, "READ_ROWS", 3)
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(30)) for i in range(50)]
    got: Counter = Counter()
    parts = list(lm._count(iter(pa.table({"text": texts}).to_batches())))
    for batch in parts:
        for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[word] += n
    assert len(parts) > 1 and got == Counter(w for t in texts for w in [*t.encode().split(), b""])


def test_training_steps_are_those_of_whole_gradients():
    model, shape = small()
    random = np.random.default_rng(12)
    texts = [np.append(random.integers(2, 40, n), 1).astype(np.uint16) for n in (300, 40, 7, 90, 0)]
    got = gru.train(model, shape, texts)
    want, past = {k: v.copy() for k, v in model.items()}, {k: np.full_like(v, 1e-2) for k, v in model.items()}
    size, seen, h, before = sum(map(len, texts)), 0, np.zeros((1, gru.STATE), np.float32), np.full(1, gru.END)
    order = np.random.default_rng(gru.SEED).permutation(len(texts)).tolist()
    for words, _, opens, mask in gru._windows(texts, order, 1):
        slopes, h, _ = gru.gradients(want, shape, words, opens, before, h, mask)
        before, rate = words[-1], gru.LEARNING * (1 - seen / size)
        seen += int(mask.sum())
        for k, g in slopes.items():
            g = np.clip(g / gru.WINDOW, -5, 5)
            past[k] += g * g
            want[k] += rate * g / np.sqrt(past[k])
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want) and not np.allclose(got["input"], model["input"], atol=1e-2)
