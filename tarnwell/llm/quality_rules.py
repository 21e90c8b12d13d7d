"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

1. Measures of every text come from DataFrame expressions; a row needs nothing but itself.
2. Labelled rows are reduced to the buckets of their measures. Each step of the learning is one aggregate over them that
   brings the driver a table of (measure, bucket, fold, label) counts, as large as the number of buckets, whatever the
   number of rows.
3. Rules for bad texts are grown one threshold at a time by information gain on the growing fold, pruned back on the
   pruning fold, and kept while they are precise there. Rows that a rule covers leave; the next rule sees the rest.
4. The list becomes CASE WHEN rule 1 THEN ... in its order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, store

#: Fixed limits of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Measures that rules may use, each a double.
MEASURES = ("n_words", "mean_word", "symbols_per_word", "bangs_per_word", "bars_per_word", "upper_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line")
#: Thresholds tried for each measure: quantiles of the labelled rows.
QUANTILES = tuple(i / 20 for i in range(1, 20)) + (0.005, 0.01, 0.02, 0.98, 0.99, 0.995)
MAX_RULES, MAX_CONDITIONS = 8, 4
#: A rule must cover so many bad rows of the pruning fold, with this precision there.
MIN_COVER, MIN_PRECISION = 2, 0.9
#: One row in so many is for pruning.
PRUNE_ONE_IN = 3

_WORD_BREAK = r"'[\\x20\\x09-\\x0D]+'"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.measure) >= self.threshold if self.at_least else F.col(self.measure) < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is computed once however often ``body`` is inlined."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """SQL: how many words lie in three-word windows that occur twice or more.

    Windows are sorted by their hash, so equal ones are neighbours; words tell whether neighbours of one hash are equal. The
    places of equal windows cover up to three words each.
    """
    hashes = f"CASE WHEN size({words}) >= 3 THEN transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])) ELSE cast(array() AS array<bigint>) END"
    same = lambda o: f"coalesce(s.x = {o}.x AND {words}[s.i] = {words}[{o}.i] AND {words}[s.i + 1] = {words}[{o}.i + 1] AND {words}[s.i + 2] = {words}[{o}.i + 2], false)"
    places = f"sort_array(transform(filter(e, (s, j) -> {same('get(e, j - 1)')} OR {same('get(e, j + 1)')}), s -> s.i))"
    covered = "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1), x + 3) - x)), 0, (a, x) -> a + x)"
    found = _let("e", "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))", _let("p", places, covered))
    return _let("h", hashes, f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {found} END")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (long), base_failed and MEASURES; columns of these names are replaced.

    Null and empty texts count zero in everything; very long ones are measured whole. Equal three-word windows are found by
    64-bit hashes and verified by their words. Rows are independent, repeated ones get equal measures.
    """
    names = [*_BASE, *MEASURES, "base_failed"]
    # F.col, so that a name with odd characters stays a name
    rows = docs.drop(*[n for n in names if n != text]).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({"_w": F.expr(f"array_remove(split(_text, {_WORD_BREAK}), '')"), "_l": F.expr(rf"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")})
    without = lambda chars: F.length(F.regexp_replace("_text", chars, "")).cast("long")
    size = F.length("_text").cast("long")
    rows = rows.select(
        *[c for c in docs.columns if c not in names],
        F.size("_w").cast("long").alias("n_words"),
        without(r"[\x20\x09-\x0D]").alias("word_chars"),
        (size - without(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast({_repeat_words('_w')} AS bigint)").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        (size - without("[A-Z]")).alias("_upper"),
        (size - without("[0-9]")).alias("_digits"),
        (size - F.length(F.replace("_text", F.lit("!"), F.lit("")))).alias("_bangs"),
        (size - F.length(F.replace("_text", F.lit("|"), F.lit("")))).alias("_bars"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")))
    return rows.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"),
            "bangs_per_word": share("_bangs", "n_words"),
            "bars_per_word": share("_bars", "n_words"),
            "upper_share": share("_upper", "word_chars"),
            "digit_share": share("_digits", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "distinct_share": share("_distinct", "n_words"),
            "words_per_line": share("n_words", "_lines"),
        }
    ).drop("_lines", "_distinct", "_upper", "_digits", "_bangs", "_bars")


def _covered(rule: list[tuple[int, bool, int]]) -> Column:
    """Rows whose buckets meet all (measure, at least, bucket) conditions."""
    met = F.lit(True)
    for m, at_least, bucket in rule:
        met = met & (F.col("buckets")[m] >= bucket if at_least else F.col("buckets")[m] < bucket)
    return met


def _gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    if bad <= 0:
        return -1.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _counts(rows: DataFrame, covered: Column) -> dict[tuple[int, int], list[float]]:
    """(measure, bucket) -> [good, bad] rows of the growing fold that are covered so far."""
    table: dict[tuple[int, int], list[float]] = {}
    cells = rows.where(~F.col("pruning") & covered).select("bad", F.posexplode("buckets").alias("m", "bucket"))
    for r in cells.groupBy("m", "bucket", "bad").count().collect():  # as many rows as there are buckets
        table.setdefault((r["m"], r["bucket"]), [0.0, 0.0])[r["bad"]] += r["count"]
    return table


def _grow(rows: DataFrame, rest: Column, sizes: list[int]) -> list[tuple[int, bool, int]]:
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < MAX_CONDITIONS:
        table = _counts(rows, rest & _covered(rule))
        first = [table.get((0, b), [0.0, 0.0]) for b in range(sizes[0] + 1)]
        good, bad = sum(x[0] for x in first), sum(x[1] for x in first)
        if not bad or not good:
            break
        best = (0.0, None)
        for m, size in enumerate(sizes):
            below = [0.0, 0.0]
            for bucket in range(1, size + 1):
                got = table.get((m, bucket - 1), [0.0, 0.0])
                below = [below[0] + got[0], below[1] + got[1]]
                for at_least, g, b in ((False, *below), (True, good - below[0], bad - below[1])):
                    gain = _gain(b, g, bad, good)
                    if gain > best[0] + 1e-9:
                        best = (gain, (m, at_least, bucket))
        if best[1] is None or best[0] < 1e-3 * bad:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rest: Column, rule: list[tuple[int, bool, int]]) -> tuple[list[tuple[int, bool, int]], float, float]:
    """The beginning of ``rule`` that is worth most on the pruning fold, and the bad and good rows that it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        on = rest & _covered(rule[:k])
        sums += [F.coalesce(F.sum((on & (F.col("bad") == b)).cast("long")), F.lit(0)).alias(f"{k}_{b}") for b in (0, 1)]
    got = rows.where("pruning").agg(*sums).first().asDict()
    worth = lambda k: (got[f"{k}_1"] - got[f"{k}_0"]) / max(1, got[f"{k}_1"] + got[f"{k}_0"])
    k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
    return rule[:k], got[f"{k}_1"], got[f"{k}_0"]


def _bucket(measure: str, thresholds: list[float]) -> Column:
    """How many of the ascending ``thresholds`` the measure reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(measure)))


def learn_rules(measured: DataFrame, labels: DataFrame, key: str = "doc_id") -> list[Rule]:
    """Rules for texts labelled quality 0, in order, from rows of measure() with their ``key`` and labels (doc_id, quality).

    Rows without a label or with a null one teach nothing; without both kinds of rows there are no rules. Of conditions that
    gain the same, the first measure's lowest bucket is taken.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_key"), (1 - F.col("quality")).cast("int").alias("bad"))
    rows = measured.where(~F.col("base_failed")).join(known, F.col(key) == F.col("_key"))
    rows = cut(rows.select("bad", (F.pmod(F.xxhash64("_key"), F.lit(PRUNE_ONE_IN)) == 0).alias("pruning"), *MEASURES))
    bounds = rows.agg(*[F.percentile_approx(m, list(QUANTILES), 10_000).alias(m) for m in MEASURES]).first()
    if bounds is None or bounds[0] is None:
        return []
    thresholds = [sorted(set(bounds[m])) for m in MEASURES]
    buckets = [_bucket(m, ts) for m, ts in zip(MEASURES, thresholds, strict=True)]
    rows = cut(rows.select("bad", "pruning", F.array(*buckets).alias("buckets")))
    rest, rules = F.lit(True), []
    while len(rules) < MAX_RULES:
        grown = _grow(rows, rest, [len(t) for t in thresholds])
        if not grown:
            break
        rule, bad, good = _prune(rows, rest, grown)
        if bad < MIN_COVER or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(tuple(Condition(MEASURES[m], at_least, float(thresholds[m][b - 1])) for m, at_least, b in rule))
        rest = rest & ~_covered(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets, from 1; 0 if it meets none."""
    if not rules:
        return F.lit(0)
    chain = None
    for i, rule in enumerate(rules, 1):
        met = rule[0].column()
        for condition in rule[1:]:
            met = met & condition.column()
        chain = F.when(met, F.lit(i)) if chain is None else chain.when(met, F.lit(i))
    return chain.otherwise(F.lit(0))


def judge(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """``measured`` with rule (0: none) and kept."""
    return measured.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rule and the rules learned from ``labels``.

    Every text is measured once: rows are kept with their measures between learning and the verdict.
    """
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_source"))  # so that no column clashes
    measured = store(measure(inner, "_source").drop("_source"))
    rules = learn_rules(measured, labels, "_id")
    return judge(measured, rules).where("kept").select("_row.*")
