import re
from collections import Counter

import numpy as np

from tarnwell.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string, kept string, _row int, rule string"
TEXTS = [
    (1, "a b c a b c d"),
    (2, None),
    (3, ""),
    (4, " \n\n \t"),
    (5, "one\ntwo\none\n\n\nTwo\none"),
    (5, "one\ntwo\none\n\n\nTwo\none"),
    (6, "x " * 20000),
    (7, "été | Ñandú # $5 & <b> 100% * x\r\ny\x0bz\x0cw"),
    (8, "a b c x a b c y a b c"),
    (9, "a a a a"),
    (None, "no id " + " ".join(f"w{i}" for i in range(80))),
    (10, " ".join(f"w{i % 37}" for i in range(400))),
    (11, "a b c d a b c d"),
]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, "clash") for i, t in rows], SCHEMA)


def test_measures_match_brute_force(spark):
    got = q.measure(table(spark)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *brute(t)) for i, t in TEXTS)
    assert all(r[m] is not None for r in got for m in q.MEASURES)


def corpus(count, seed=4):
    random = np.random.default_rng(seed)
    vocabulary = [f"word{i}" for i in range(5000)]
    rows, labels = [], []
    for i in range(count):
        bad = i % 5 == 0
        words = random.choice(vocabulary, 80).tolist()
        if bad:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_learned_list_separates_and_keeps_clean_texts(spark):
    rows, labels = corpus(600)
    docs = table(spark, rows)
    known = spark.createDataFrame([*labels, (9999, 1), (1, None)], "doc_id long, quality int")
    rules = q.learn_rules(q.measure(docs), known)
    assert rules and all(len(r) <= q.MAX_CONDITIONS for r in rules)
    kept = {r["doc_id"] for r in q.keep_good(docs, known).collect()}
    good = {i for i, y in labels if y}
    assert kept <= good and len(kept) > 0.99 * len(good)
    assert q.keep_good(docs, known).columns == docs.columns


def test_rules_are_ordered_conditions(spark):
    rules = [(q.Condition("bangs_per_word", True, 0.5),), (q.Condition("n_words", False, 60.0), q.Condition("mean_word", True, 2.0))]
    rows = table(spark, [(1, "x! " * 55), (2, "longer " * 55), (3, "z " * 55)])
    got = {r["doc_id"]: r["rule"] for r in q.judge(q.measure(rows), rules).collect()}
    assert got == {1: 1, 2: 2, 3: 0}
    assert str(rules[0][0]) == "bangs_per_word >= 0.5"


def test_without_labels_the_base_rule_stays(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.learn_rules(q.measure(table(spark)), none) == []
    assert {r["doc_id"] for r in q.keep_good(table(spark), none).collect()} == {i for i, t in TEXTS if not brute(t)[5]}


def test_empty_table(spark):
    empty = table(spark, []).limit(0)
    assert q.keep_good(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
