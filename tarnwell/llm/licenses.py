"""License scans: ordered signature rules over normalised texts, in DataFrame expressions only.

A text becomes its lower-case words of letters, digits and non-ASCII characters, one space apart. Texts without any
anchor are done. In the others each rule whose keyword occurs gives detections: the spans that its pattern matches.
Overlapping detections resolve by priority and containment: of two spans, one inside the other, the one of the worse
priority goes; at equal priority the inner one goes; of equal spans the earlier rule stays. Partly overlapping spans
both stay. All of this happens inside the row, so nothing is shuffled and no group of texts meets in a task.

Spans count words. A pattern's matches are marked in the text, and the marks found again among its words, so the work goes
by the length of the text and the number of matches, not by its square.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import ANCHORS, Rule, rules

#: Label and words of the phrases that are always counted.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: How sure a detection of each priority is.
CONFIDENCE = (1.0, 0.9, 0.7, 0.4)
_SPAN = "array<struct<start:int,end:int>>"
_RULES = "array<struct<rule:string,label:string,keywords:array<string>,priority:int,pattern:string,place:int>>"
#: Characters that no normalised text holds: before and after a match.
_OPENS, _CLOSES = "chr(1)", "chr(2)"
#: Detections of a row that are read one after another.
_CHUNK = 512
_DETECTION = "array<struct<start:int,stop:int,priority:int,place:int,label:string,rule:string>>"


def normalise(text: Column) -> Column:
    """' word word ... ' of a text, A-Z in lower case; one space if there are no words."""
    lower = F.translate(text, ascii_uppercase, ascii_lowercase)
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spans(text: str, pattern: str) -> str:
    """SQL: first word and word after the last, from 0, of each match of ``pattern`` in the normalised ``text``."""
    start = f"filter(transform(w, (x, i) -> CASE WHEN startswith(x, {_OPENS}) THEN i - 1 END), x -> x IS NOT NULL)"
    end = f"filter(transform(w, (x, i) -> CASE WHEN endswith(x, {_CLOSES}) THEN i END), x -> x IS NOT NULL)"
    spans = f"transform(array(split(m, ' ')), w -> zip_with({start}, {end}, (s, e) -> named_struct('start', s, 'end', e)))[0]"
    marked = f"regexp_replace({text}, {pattern}, concat({_OPENS}, '$0', {_CLOSES}))"
    return f"transform(array({marked}), m -> CASE WHEN contains(m, {_OPENS}) THEN {spans} ELSE cast(array() AS {_SPAN}) END)[0]"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_table(table: Sequence[Rule]) -> Column:
    rows = [{"rule": r.rule, "label": r.label, "keywords": r.keyword.split("|"), "priority": r.priority, "pattern": f"(?<= )(?:{r.pattern})(?= )", "place": i} for i, r in enumerate(table)]
    return F.from_json(F.lit(json.dumps(rows)), _RULES)


_DETECT = f"""sort_array(flatten(transform(filter(_rules, r -> exists(r.keywords, k -> contains(_norm, k))), r ->
    transform({_spans("_norm", "r.pattern")}, s -> named_struct('start', s.start, 'stop', -s.end, 'priority', r.priority, 'place', r.place, 'label', r.label, 'rule', r.rule)))))"""

def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is computed once, even where ``body`` uses it in a lambda."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _flags(rows: str, nothing: str, farther: str, better: str, flag: str) -> str:
    """SQL: ``flag`` of each of ``rows`` in order, given the `reach` by priority of those before it.

    An accumulator is copied at every step, so one for all rows would cost their square. The reach of each chunk of _CHUNK
    rows comes first, then that of all chunks before, then the flags inside each chunk.
    """
    none = f"array({nothing}, {nothing}, {nothing}, {nothing})"
    reached = lambda e: f"transform({e}, (e, p) -> CASE WHEN d.priority {better} p + 1 THEN {farther}(e, -d.stop) ELSE e END)"
    chunks = f"transform(sequence(0, div(size({rows}) - 1, {_CHUNK})), k -> slice({rows}, int(k * {_CHUNK} + 1), {_CHUNK}))"
    own = f"transform(c, x -> aggregate(x, {none}, (a, d) -> {reached('a')}))"
    before = f"transform(o, (x, k) -> aggregate(slice(o, 1, k), {none}, (a, y) -> zip_with(a, y, (u, v) -> {farther}(u, v))))"
    inside = f"""flatten(transform(c, (x, k) -> aggregate(x, named_struct('reach', b[k], 'out', cast(array() AS array<boolean>)),
        (a, d) -> named_struct('reach', {reached('a.reach')}, 'out', concat(a.out, array({flag}))), a -> a.out)))"""
    return _let("c", chunks, _let("o", own, _let("b", before, inside)))


#: Detections are sorted by start and falling end; `reach` is the furthest end so far of those of no worse priority.
_COVERED = _flags("f", "0", "greatest", "<=", "a.reach[d.priority - 1] >= -d.stop")
#: The same from behind: `reach` is the nearest end of those of a better priority.
_HOLDS_BETTER = _let("f", "reverse(f)", f"reverse({_flags('f', '2147483647', 'least', '<', 'a.reach[d.priority - 1] <= -d.stop')})")
_KEPT = _let("f", "_found", _let("g", f"zip_with({_COVERED}, {_HOLDS_BETTER}, (x, y) -> NOT (x OR y))", "filter(f, (d, i) -> g[i])"))


def scan_licenses(docs: DataFrame, table: Sequence[Rule] | None = None, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections: start and end (words from 0, the end is the word after), priority, label and rule, in order; of equal spans
    and priorities the earlier rule's. Null and empty texts have no words, no detections and score 0. Very long texts are
    scanned whole, in a time that goes by their length and matches. Rows are independent: repeated rows get equal results.
    Columns of these names in ``docs`` are replaced, others pass through; an empty table gives an empty result.
    """
    table = rules() if table is None else table
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    rows = docs.drop(*names).withColumn("_norm", normalise(F.coalesce(F.col("text"), F.lit(""))))
    anchored = F.lit(False)
    for anchor in ANCHORS:
        anchored = anchored | F.contains("_norm", F.lit(anchor))
    rows = rows.withColumn("_rules", F.when(anchored, _rule_table(table)))
    rows = rows.withColumn("_found", F.when(F.col("_rules").isNotNull(), F.expr(_DETECT)).otherwise(F.array().cast(_DETECTION)))
    rows = rows.withColumn("_kept", F.when(F.size("_found") > 0, F.expr(_KEPT)).otherwise(F.col("_found")))
    rows = rows.withColumn("detections", F.expr("transform(_kept, d -> named_struct('start', d.start, 'end', -d.stop, 'priority', d.priority, 'label', d.label, 'rule', d.rule))"))

    spans = [F.when(F.contains("_norm", F.lit(f" {phrase} ")), F.expr(_spans("_norm", _literal(f"(?<= ){phrase}(?= )")))).otherwise(F.array().cast(_SPAN)) for _, phrase in base]
    rows = rows.withColumn("_base", F.array(*spans))
    labels = [F.when(F.size(F.col("_base")[i]) > 0, F.lit(label)) for i, (label, _) in enumerate(base)]
    starts = F.flatten("_base")["start"]
    blanks = F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit("")))
    rows = rows.withColumns(
        {
            "n_words": (blanks - 1).cast("long"),
            "n_base": F.size(starts).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "_labels": F.array_distinct(F.array_compact(F.array(*labels))),
        }
    )
    confidence = F.expr(f"aggregate(detections, 0.0D, (a, d) -> greatest(a, element_at(array({', '.join(f'{c}D' for c in CONFIDENCE)}), d.priority)))")
    return rows.withColumns(
        {
            "base_labels": F.array_join(F.array_sort("_labels"), ","),
            "labels": F.array_join(F.array_sort(F.array_union("_labels", F.col("detections")["label"])), ","),
            "score": F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(confidence),
        }
    ).select(*[c for c in docs.columns if c not in names], *names)
