from collections import Counter, defaultdict

from tarnwell.llm import mixing as m

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, kept string, _row int, _d int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], SCHEMA)


def corpus():
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        text = ("word " * (5 + i % 40)) + ("MIT License" if i % 11 == 0 else "")
        rows.append((i, text, ("en", "de", "fr")[i * 7 % 10 % 3], source))
    return rows + [(None, None, None, None), (5000, "", "en", "empty only"), (1, rows[1][1], rows[1][2], rows[1][3])]


def brute_weights(cells, targets, budget, rounds=400):
    total = sum(cells.values())
    weight, cap = {k: v / total for k, v in cells.items()}, {k: v / total / budget for k, v in cells.items()}
    want = []
    for i, d in enumerate(m.DIMENSIONS):
        sums = Counter()
        for k, v in cells.items():
            sums[k[i]] += v
        share = {k: (v ** targets[d] if not isinstance(targets[d], dict) else targets[d].get(k, 0)) if v else 0 for k, v in sums.items()}
        want.append({k: v / sum(share.values()) for k, v in share.items()})
    for _ in range(rounds):
        for i in range(3):
            for value, goal in want[i].items():
                mine = [k for k in weight if k[i] == value]
                now = sum(weight[k] for k in mine)
                free = [k for k in mine if weight[k] < cap[k]] if now < goal else mine
                able = sum(weight[k] for k in free)
                for k in free:
                    weight[k] = min(cap[k], weight[k] * (goal - now + able) / able) if able else 0.0
    return weight, want


def test_weights_match_brute_force_and_budget_holds(spark):
    docs = table(spark, corpus())
    got = m.mix(docs).collect()
    assert len(got) == len(corpus())
    cells = Counter()
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["tokens"]
    want, margins = brute_weights(cells, m.TARGETS, m.BUDGET)
    for r in got:
        assert abs(r["weight"] - want[r["source"], r["lang"], r["topic"]]) < 1e-4
        assert 0 <= r["probability"] <= 1
        assert not (r["kept"] and r["probability"] == 0)
        assert r["gap"] < 1e-3
    total = sum(cells.values())
    assert abs(sum(r["tokens"] * r["probability"] for r in got) - m.BUDGET * total) < 1e-3 * total
    for i, d in enumerate(m.DIMENSIONS):  # also where probabilities reach 1
        expected = Counter()
        for r in got:
            expected[r[d]] += r["tokens"] * r["probability"] / (m.BUDGET * total)
        assert all(abs(expected[v] - goal) < 1e-3 for v, goal in margins[i].items()), d
    assert any(r["probability"] > 0.999 for r in got)
    kept = sum(r["tokens"] for r in got if r["kept"])
    assert abs(kept - m.BUDGET * total) < 0.06 * total
    fate = defaultdict(set)
    for r in got:
        fate[r["_row"]["doc_id"]].add(r["kept"])
    assert all(len(v) == 1 for v in fate.values())


def test_many_cells_join_salted(spark, monkeypatch):
    docs = table(spark, corpus())
    plain = Counter(tuple(r) for r in m.mix(docs, carry=["doc_id"]).collect())
    monkeypatch.setattr(m, "BROADCAST_CELLS", 1)
    assert Counter(tuple(r) for r in m.mix(docs, carry=["doc_id"]).collect()) == plain


def test_named_targets(spark):
    docs = table(spark, corpus())
    targets = {"source": {"hot": 0.1, "s1": 0.6, "s2": 0.3}, "lang": 1.0, "topic": 1.0}
    got = m.mix(docs, targets, 0.1).collect()
    mass = Counter()
    for key, weight in {((r["source"], r["lang"], r["topic"]), r["weight"]) for r in got}:
        mass[key[0]] += weight
    assert abs(mass["hot"] - 0.1) < 0.01 and abs(mass["s1"] - 0.6) < 0.02
    assert not any(r["kept"] for r in got if r["source"] not in targets["source"])


def test_gap_tells_targets_that_cannot_be_met(spark):
    docs = table(spark, corpus())
    got = m.mix(docs, {"source": {"s1": 1.0}}, 0.9, carry=["doc_id"]).collect()
    held = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in got}
    assert abs(max(r["gap"] for r in got if r["source"] == "s1") - (1 - sum(held.values()))) < 1e-9 and sum(held.values()) < 0.5


def test_sample_keeps_columns_and_empty_tables(spark):
    docs = table(spark, corpus())
    assert m.sample(docs).columns == docs.columns
    assert m.sample(docs.limit(0)).count() == 0
    assert m.mix(table(spark, [(1, None, None, None)])).collect()[0]["kept"] is False
