import re
import time
from collections import Counter

from tarnwell.llm import license_rules, licenses
from tarnwell.llm.license_rules import ANCHORS, LICENCES, OTHERS, rules

SCHEMA = "doc_id long, text string, labels string, _norm string, start int"
TEXTS = [
    (1, "Released under the MIT License."),
    (2, "x Licensed under the Apache License, Version 2.0. and CC BY-NC 4.0, cc by nc"),
    (3, None),
    (4, ""),
    (5, " .,! "),
    (6, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later"),
    (7, "SPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: MIT"),
    (8, "under the mit licenses"),
    (8, "under the mit licenses"),
    (9, "plain prose without anything é Ñandú 漢字 under water"),
    (None, "Creative Commons Attribution-ShareAlike 4.0 International License. All rights reserved."),
    (10, "filler words " * 30000 + "under the MIT license " * 40),
    (11, "http://www.apache.org/licenses/LICENSE-2.0 see the LICENSE file for details"),
    (12, "apache license version 2 apache license version 2 UNDER the mit LICENSE"),
    (14, "under the \u212air license LICENSED under the KUrl license, \u0130SC"),
    (13, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
]


def holds(text, keywords):
    return any(k in text for k in keywords.split("|"))


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in licenses.BASE:
        want = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += at
        labels |= {label} if at else set()
    norm = " " + "".join(w + " " for w in words)
    found = []
    for place, r in enumerate(rules()):
        if holds(norm, r.keyword) and any(a in norm for a in ANCHORS):
            found += [(norm.count(" ", 0, m.start()) - 1, norm.count(" ", 0, m.end()), r.priority, place, r.label, r.rule) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm)]

    def beats(e, d):
        around = e[0] <= d[0] and e[1] >= d[1]
        inside = e[0] >= d[0] and e[1] <= d[1]
        if around and inside:
            return (e[2], e[3]) < (d[2], d[3])
        return around and e[2] <= d[2] or inside and e[2] < d[2]

    kept = sorted(d for d in found if not any(beats(e, d) for e in found)) if len(found) < 300 else None
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), kept, labels


def test_scan_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in TEXTS], SCHEMA)
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in TEXTS:
        r, (base, kept, labels) = by_id[i], brute(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        assert 0 <= r["score"] <= 1
        if kept is not None:
            assert [(d["start"], d["end"], d["priority"], d["label"], d["rule"]) for d in r["detections"]] == [(a, b, p, x, n) for a, b, p, _, x, n in kept]
            assert r["labels"] == ",".join(sorted(labels | {d[4] for d in kept}))
    assert Counter(r["doc_id"] for r in got)[8] == 2
    assert "gpl-3" in by_id[6]["labels"].split(",")  # beside the text of the grant, which only partly overlaps
    assert by_id[10]["n_base"] == 40


def test_rules_are_sound(spark):
    table = rules()
    assert len(table) > 200 and len({r.rule for r in table}) == len(table)
    for r in table:
        re.compile(r.pattern)
        assert r.priority in (1, 2, 3, 4)
    for name, _, keyword, _, pattern in OTHERS:
        plain = re.sub(r"licen\[sc\]e", "license", pattern)
        assert any(a in f" {plain} " for a in ANCHORS), name
        assert keyword in plain or keyword in pattern, name
    assert len(LICENCES) > 60


def samples(parsed):
    """Texts that a parsed pattern matches, every alternative and every optional part with and without."""
    parts = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            kind, value = str(arg[0][0]), arg[0][1]
            parts.append(["3" if "DIGIT" in str(value) else "x"] if kind == "CATEGORY" else [chr(value[0])] if kind == "RANGE" else [chr(v) for _, v in arg])
        elif op == "SUBPATTERN":
            parts.append(samples(arg[3]))
        elif op == "BRANCH":
            parts.append([x for b in arg[1] for x in samples(b)])
        else:
            assert op == "MAX_REPEAT", op
            parts.append([""] * (arg[0] == 0) + samples(arg[2]))
    out = [""]
    for p in parts:
        out = [a + b for a in out for b in p]
    return list(dict.fromkeys(out))


def test_every_alternative_holds_its_keyword_and_an_anchor():
    names = [(word, name) for _, word, name, _ in LICENCES] + [(word, name) for _, _, word, name in license_rules.ALIASES]
    for keyword, pattern in names:  # frames bring the anchors
        for x in samples(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, x) and holds(f" {x} ", keyword), (keyword, x)
    for name, _, keyword, _, pattern in OTHERS:
        for x in samples(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, x) and holds(f" {x} ", keyword) and any(a in f" {x} " for a in ANCHORS), (name, x)


def test_names_without_the_usual_keyword_are_found(spark):
    texts = [
        ("cc-by-sa", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("cc-by-nd", "Creative Commons Attribution-NoDerivatives License"),
        ("cc-by-nc", "Creative Commons Attribution Non-Commercial License"),
        ("mit", "See the Expat License"),
        ("bsd-0-clause", "under the Free Public License license"),
        ("proprietary", "Commercial licence required"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(df).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(texts)), got


def test_an_identifier_beats_the_name_around_it(spark):
    df = spark.createDataFrame([(1, "Licensed under the terms of the GNU Lesser General Public License v2.1")], "doc_id long, text string")
    assert licenses.scan_licenses(df).collect()[0]["labels"] == "lgpl-2.1"


def test_many_mentions_in_a_long_text_take_time_in_proportion(spark):
    seconds = {}
    for n in (100, 4000, 40000):
        df = spark.createDataFrame([(1, "Licensed under the MIT License. " * n)], "doc_id long, text string")
        began = time.perf_counter()
        [got] = licenses.scan_licenses(df).collect()
        seconds[n] = time.perf_counter() - began
        assert got["n_base"] == n == len(got["detections"]) and got["last_word"] == 5 * n - 4
    assert seconds[40000] < 20


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
