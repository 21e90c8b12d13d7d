import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import markup
from tarnwell.operators import postings

ROWS = [
    ("p1", "Deploy guide", "The deployment of the service isn't done by hand.", "Deploying"),
    ("p2", "Security", "OAuth2 tokens; token refresh, Tokens!", ""),
    ("p3", "Token's life", None, "About tokens and deployments"),
    ("p4", "", "nothing of interest " * 40 + "token", "x"),
    ("p5", "Ünïcode straße", "ÉTÉ été token", "Über"),
    ("p6", None, "", None),
]


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(ROWS, "id string, title string, content string, heading_text string")


def relaxed_by_hand(words, analyse):
    texts = {f: {r[0]: analyse(r[i] or "") for r in ROWS} for f, i in (("content", 2), ("heading_text", 3), ("title", 1))}
    idf = {(f, w): 1 + math.log(len(ROWS) / (sum(w in t for t in texts[f].values()) + 1)) for f in texts for w in words}
    norm = 1 / math.sqrt(sum((postings.BOOSTS[f] * x) ** 2 for (f, _), x in idf.items()))
    out = {}
    for r in ROWS:
        fields = []
        for f, boost in postings.BOOSTS.items():
            tokens = texts[f][r[0]]
            counts = Counter(t for t in tokens if t in words)
            if counts:
                fields.append(sum(math.sqrt(n) / math.sqrt(len(tokens)) * idf[f, w] * (boost * idf[f, w] * norm) for w, n in counts.items()) * len(counts) / len(words))
        if fields:
            out[r[0]] = sum(fields) * len(fields) / 3
    return out


@pytest.mark.parametrize("analyser", ["english", "english_stems"])
def test_relaxed_scores_match_a_scan(spark, index, analyser):
    stored = postings.StoredIndex.build(index, analyser)
    analyse = postings.ANALYSERS[analyser]
    words = analyse("the token of deployments, and refreshing tokens")
    assert "the" not in words and len(set(words)) < 6
    ids = {r["h"]: r["id"] for r in index.select("id", F.xxhash64("id").alias("h")).collect()}
    got = {ids[r["doc"]]: r["score"] for r in stored.relaxed(words).collect()}
    want = relaxed_by_hand(list(dict.fromkeys(words)), analyse)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    best = postings.top(stored.relaxed(words), index, 2, best_first=True).collect()
    assert [r["id"] for r in best] == sorted(want, key=lambda k: (-want[k], k))[:2]


def test_analysers():
    assert postings.english("The user's tokens weren’t Jane's") == ["user", "tokens", "jane"]
    assert postings.english_stems("Tokens, licenses") == [markup.stem("tokens"), markup.stem("licenses")]
    assert postings.plain("OAuth2 ÉTÉ_x") == ["oauth2", "été", "x"]


def test_a_query_reads_its_own_buckets(spark, index):
    stored = postings.StoredIndex.build(index)
    found = stored.postings(["token"])
    assert sorted(r["tf"] for r in found.collect()) == [1, 1, 1, 1]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    bucket = spark.range(1).select(postings._bucket(F.lit("token"))).first()[0]
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,token)]" in plan


def test_ranking_of_nothing(spark, index):
    stored = postings.StoredIndex.build(index.limit(0))
    assert stored.bm25(["token"]).count() == 0 and stored.sizes() == {}
    assert postings.top(stored.bm25(["token"]), index, 5).count() == 0
    full = postings.StoredIndex.build(index)
    assert full.bm25(["token", "absent"]).count() == 0 and full.bm25(["token", "absent"], any_word=True).count() == 4


def test_fragments_come_from_the_first_field_that_matches(index):
    got = {r["id"]: r["fragment"] for r in postings.with_fragments(index, ["tokens", "token"]).collect()}
    assert got["p2"] == "OAuth2 <mark>tokens</mark>; <mark>token</mark> refresh, <mark>Tokens</mark>!"
    assert got["p3"] == "<mark>Token</mark>'s life" and got["p1"] == "" and got["p6"] == ""
    assert got["p4"].endswith(" <mark>token</mark>") and got["p4"].count("nothing") < 4
