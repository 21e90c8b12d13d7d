import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnwell.llm import tries


def rebuilt(rows):
    """Conversations after the heads of their families, by the rule itself."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0, label), (role, text)))
    original = {c: [turn for _, turn in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = original.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute_force(rows):
    """Every prefix of every conversation, each with its members."""
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode().split()) for m in below if m)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children), leaves, saved, ends))
    return sorted(out, key=str)


def trie(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, words string")
    return sorted(map(tuple, tries.prefix_trie(table, **more).collect()), key=str)


def conversations(seed, n, texts=4, turns=6):
    rng = np.random.default_rng(seed)
    return [(int(c), int(t), ["user", "bot"][t % 2], f"say {'x ' * int(rng.integers(0, 3))}{rng.integers(0, texts)}") for c in range(n) for t in range(int(rng.integers(1, turns)))]


@pytest.mark.parametrize("subtree", [1, 5, 40, 4096])
def test_nodes_match_brute_force(spark, subtree):
    rows = conversations(1, 60)
    assert trie(spark, rows, subtree=subtree) == brute_force(rows)


def test_odd_rows(spark):
    rows = conversations(2, 30, texts=2)
    rows += [(None, 1, "user", "lost"), (40, None, None, None), (40, None, None, None), (40, 1, "user", "a\tb"), (41, 2, "b", "t"), (41, 2, "a", "t"), (41, 1, None, "")]
    rows += [(121 + i, 0, "user", "only") for i in range(12)]  # of some, the head takes all and there is none: no turn is left
    rows += [(200, t, "user", f"long {t}") for t in range(300)] + [(201, t, "user", f"long {t}") for t in range(300)]
    want = brute_force(rows)
    assert any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in want)  # turnless ones end at the root
    for subtree in (3, 4096):
        assert trie(spark, rows, subtree=subtree) == want


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(4)] + conversations(3, 20)
    got = trie(spark, rows, subtree=50)
    assert got == brute_force(rows)
    assert max(r[3] for r in got) == 400


def test_long_lists_of_ids_are_hashed_in_chunks(spark, monkeypatch):
    ended = spark.range(5000).selectExpr("id % 3 AS k1", "0L AS k2", "id * 7 AS conv_id")
    got = {r["k1"]: r["ends_sha256"] for r in tries._joined_ids(ended).collect()}
    for k in range(3):
        ids = ",".join(str(i * 7) for i in range(5000) if i % 3 == k)
        assert got[k] == hashlib.sha256(ids.encode()).hexdigest()


def test_louds_bits_give_parents_degrees_and_children():
    """The trie of the paths ab, ac, d and e by hand."""
    paths = [[(1, 0), (2, 0)], [(1, 0), (3, 0)], [(4, 0)], [(5, 0)]]
    level = np.array([i for p in paths for i in range(len(p))])
    labels = np.array([x for p in paths for x in p]).T
    built, node, begins = tries.build_trie(level, labels)
    assert built.bits.tolist() == [True, True, True, False, True, True, False, False, False, False, False]
    assert built.parents().tolist() == [0, 0, 0, 0, 1, 1] and built.degrees().tolist() == [3, 2, 0, 0, 0, 0]
    assert node.tolist() == [1, 4, 1, 5, 2, 3] and begins == [0, 1, 4, 6]
    assert built.child(0, (4, 0)) == 2 and built.child(1, (3, 0)) == 5 and built.child(1, (4, 0)) is None


def test_empty_table(spark):
    assert trie(spark, []) == []
