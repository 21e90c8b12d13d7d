import math
from collections import Counter

import corpus_pipeline as p
from tarnwell.llm import crf, mixing, packing, quality_rules, simhash
from tarnwell.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_stages_work_on_all_that_came_before(spark):
    docs = read(spark, DATA, "documents").cache()
    columns = docs.columns
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == columns, name
        left, right = Counter(map(tuple, before.collect())), Counter(map(tuple, after.collect()))
        assert not right - left and right, name
        before = after
    packed = p.STAGES[-1][1](spark, before, DATA).collect()
    pieces = packing.pieces(before).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, packed)) == Counter(map(key, pieces))


def test_each_decision_takes_effect(spark):
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    measured = quality_rules.measure(docs)
    assert not ids(p.apply_quality_rules(spark, docs, DATA)) & ids(measured.where("base_failed"))
    scored = crf.score(docs, crf.learn(docs, labels))
    assert ids(p.apply_classifier(spark, docs, DATA)) == ids(scored.where("score >= 0.5"))
    groups = simhash.near_duplicates(docs)
    assert sum(ids(p.drop_near_duplicates(spark, docs, DATA)).values()) <= groups.select("group").distinct().count()
    mixed = mixing.mix(docs)
    assert ids(p.mix_sources(spark, docs, DATA)) == ids(mixed.where("kept").select("_row.doc_id"))


def test_run_gives_gapless_sequences(spark):
    got = p.run(spark, DATA).collect()
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) >= math.ceil(sum(r["length"] for r in got) / packing.CAPACITY)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row int, kept string, tokens string, print long, group string"


def odd(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "t", 5, "g") for r in rows], ODD)


def test_every_stage_takes_odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    prose = " ".join(f"w{i}" for i in range(80))
    rows = [(1, prose, "en", "s", 9), (1, prose, "en", "s", 9), (2, prose, None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, " \n ", "en", "s", 3), (5, long, "de", "s", 9), (None, prose + " more", "en", "t", 9)]
    docs = odd(spark, rows)
    whole = Counter(map(tuple, docs.collect()))
    kept = {}
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        left = Counter(map(tuple, got.collect()))
        assert not left - whole, name
        kept[name] = Counter(r[0] for r in left.elements())
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    assert not {3, 4} & set(kept["quality_rules"]) and kept["quality_rules"][1] in (0, 2)
    assert kept["simhash_near_dedup"] == Counter([1, 3, 5])
    assert kept["mixing"][1] in (0, 2)
    packed = p.STAGES[-1][1](spark, docs, DATA).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in rows)
    assert p.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


def test_stages_are_five_and_named():
    assert len(p.STAGES) == 5 and len({n for n, _ in p.STAGES}) == 5 and p.ORACLE_SQL is None


def test_near_duplicates_go_by_fingerprints(spark):
    chorus = "la lo li " * 120
    texts = [(k, chorus + " ".join(f"v{k}x{i}" for i in range(6))) for k in range(4)]  # few shingles are shared, but those are most of the text
    texts += [(10 + k, " ".join(f"u{k}x{i}" for i in range(90))) for k in range(4)]
    docs = odd(spark, [(i, t, "en", "s", 9) for i, t in texts])
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len({groups[k] for k in range(4)}) < 4
    kept = {r["doc_id"] for r in p.drop_near_duplicates(spark, docs, DATA).collect()}
    assert kept == set(groups.values())


def test_each_group_of_fingerprints_keeps_one_row_at_most(spark):
    docs = read(spark, DATA, "documents")
    kept = p.drop_near_duplicates(spark, docs, DATA).select("doc_id")
    groups = simhash.near_duplicates(docs).select("doc_id", "group").join(kept, "doc_id")
    assert groups.groupBy("group").count().where("count > 1").count() == 0
