"""Full-text search over an index DataFrame: filters, ranking, facets, projection."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import markup, text

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DEFAULT_LIMIT, RELAXED_LIMIT = 20, 50
DETAIL = {
    "full": None,
    "standard": ["id", "type", "path", "page_id", "title", "space_key", "labels", "heading_text", "line", "score"],
    "minimal": ["path", "title"],
}


@dataclass(frozen=True)
class SearchOptions:
    query: str = ""
    space: str = ""
    labels: tuple[str, ...] = ()
    heading: str = ""
    types: tuple[str, ...] = ()
    created_by: str = ""
    updated_by: str = ""
    created_after: str = ""
    created_before: str = ""
    updated_after: str = ""
    updated_before: str = ""
    limit: int = 0
    typed_dates: bool = False  # else dates compare as text, and a blank passes every upper bound
    any_word: bool = False  # else all words must occur

    def has_filter(self) -> bool:
        return any((self.space, self.labels, self.heading, self.types, self.created_by, self.updated_by, self.created_after, self.created_before, self.updated_after, self.updated_before))


def _bound(column: str, bound: str, upper: bool, typed: bool) -> Column:
    if not typed:
        return F.col(column) <= bound if upper else F.col(column) >= bound
    at, limit = F.try_to_timestamp(F.col(column)), F.try_to_timestamp(F.lit(bound))
    return F.when(limit.isNull(), F.lit(True)).otherwise(at <= limit if upper else at >= limit)


def filters(options: SearchOptions) -> list[Column]:
    o, out = options, []
    if o.space:
        out.append(F.col("space_key") == o.space)
    out += [F.array_contains("labels", label) for label in o.labels]
    if o.heading:  # ASCII case only, as LIKE does
        ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        out.append(ascii_lower(F.col("heading_text")).like("%" + "".join(c.lower() if c.isascii() else c for c in o.heading) + "%"))
    if o.types:
        out.append(F.col("type").isin(*o.types))
    out += [F.col(c) == v for c, v in (("created_by", o.created_by), ("updated_by", o.updated_by)) if v]
    for column, after, before in (("created_at", o.created_after, o.created_before), ("updated_at", o.updated_after, o.updated_before)):
        for bound, upper in ((after, False), (before, True)):
            if bound:
                out.append(_bound(column, text.date_bound_value(bound, upper), upper, o.typed_dates))
    return out


def indexed_text() -> Column:
    return F.concat_ws(" ", "title", "content", "heading_text")


def ranked(index: DataFrame, words: list[str], any_word: bool = False, stemmed: bool = False) -> DataFrame:
    """Rows that hold the words, with score: the negative sum of BM25 weights, so the least is best.

    Statistics cover the whole index, before any filter. One pass gathers them (a row of numbers), one scores: nothing
    is exploded or shuffled by term.
    """
    words = list(dict.fromkeys(markup.stem(w.lower()) if stemmed else w.lower() for w in words))
    if stemmed:
        folded = F.lower(text.fold(indexed_text()))
        rows = index.withColumns({"_tokens": _stems_near(folded, words), "_len": F.regexp_count(folded, F.lit(r"[\p{L}\p{N}]+"))})
    else:
        rows = index.withColumn("_tokens", text.terms(indexed_text())).withColumn("_len", F.size("_tokens"))
    counts = [F.size(F.filter("_tokens", _is(w))).alias(f"_tf{i}") for i, w in enumerate(words)]
    rows = rows.select("*", *counts).drop("_tokens")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    score, found = F.lit(0.0), F.lit(not any_word)
    for i in range(len(words)):
        tf, df = F.col(f"_tf{i}"), sums[f"df{i}"]
        idf = F.greatest(F.log(F.lit((sums["n"] - df + 0.5) / (df + 0.5))), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(sums["avg"] or 1.0)))
        found = (found | (tf > 0)) if any_word else (found & (tf > 0))
    return rows.where(found).withColumn("score", -score).drop("_len", *[f"_tf{i}" for i in range(len(words))])


def _stems_near(folded: Column, stems: list[str]) -> Column:
    """Stems of those words of a lower-case text that may have one of ``stems``; other words never leave the JVM.

    A word's stem differs from the word's own beginning in its last three letters at most.
    """
    begins = "|".join(sorted({re.escape(s[: max(1, len(s) - 3)]) for s in stems})) or "(?!)"
    near = F.regexp_extract_all(folded, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{begins})[\p{{L}}\p{{N}}]*"), F.lit(0))
    return markup.parse_stems(F.array_join(near, " "))


def _is(word: str):
    return lambda t: t == word


def search(index: DataFrame, options: SearchOptions, stemmed: bool = False) -> DataFrame:
    """The first rows by score, or by path and line without a query; ties by id."""
    if not options.query and not options.has_filter():
        raise ValueError("a query or a filter is needed")
    limit = options.limit if options.limit > 0 else (RELAXED_LIMIT if options.any_word else DEFAULT_LIMIT)
    if options.query:
        rows = ranked(index, text.query_terms(options.query), options.any_word, stemmed)
        order = ["score", "id"]
    else:
        rows, order = index.withColumn("score", F.lit(0.0)), ["path", "line", "id"]
    for condition in filters(options):
        rows = rows.where(condition)
    return rows.orderBy(*order).limit(limit)


def project(rows: DataFrame, detail: str = "full") -> DataFrame:
    """Columns of a detail level; an unknown level is full, minimal has score 0."""
    columns = DETAIL.get(detail)
    if columns is None:
        return rows
    return rows.select(*columns, F.lit(0.0).alias("score")) if detail == "minimal" else rows.select(*columns)


def postings(index: DataFrame) -> DataFrame:
    """term, id, tf: the inverted index as a table, for bucketing by term."""
    return index.select("id", F.explode(text.terms(indexed_text())).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def facet_labels(index: DataFrame) -> DataFrame:
    return index.select(F.explode("labels").alias("label")).where("label <> ''").distinct()


def facet_spaces(index: DataFrame) -> DataFrame:
    return index.select("space_key").where("space_key <> ''").distinct()


def paths(index: DataFrame, space: str = "") -> DataFrame:
    rows = index.where(F.col("space_key") == space) if space else index
    return rows.select("path").distinct()


def with_snippets(rows: DataFrame, query: str) -> DataFrame:
    words = frozenset(w.lower() for w in text.query_terms(query))

    def show(content: str) -> str:
        return markup.snippet(content, words)

    return rows.withColumn("snippet", markup.arrow("string")(show)(F.col("content")))


def upsert(index: DataFrame, changed: DataFrame) -> DataFrame:
    """``index`` with the rows of the changed paths replaced."""
    return index.join(changed.select("path").distinct(), "path", "left_anti").unionByName(changed)


def delete_paths(index: DataFrame, paths_gone: DataFrame) -> DataFrame:
    return index.join(paths_gone.select("path").distinct(), "path", "left_anti")
