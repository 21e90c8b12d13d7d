"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import markup, text
from tarnwell.operators import assets, changes, hierarchy, lineage, links, lint, planning, postings, recovery, search
from tarnwell.operators.search import SearchOptions
from tarnwell.sources import workspace as ws
from tarnwell.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_DOCS = r"""doc_index AS (
  SELECT 'page:' || source || '/doc-' || doc_id || '.md' AS id, 'page' AS type, source || '/doc-' || doc_id || '.md' AS path,
    doc_id::VARCHAR AS page_id, substr(split_part(text, chr(10), 1), 1, 60) AS title, source AS space_key,
    list_sort(list_distinct(list_filter([lower(lang), CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL))) AS labels,
    text AS content, substr(split_part(text, chr(10), 1), 1, 40) AS heading_text, 0 AS line,
    'u' || (doc_id % 17) AS created_by, 'u' || (doc_id % 11) AS updated_by,
    CASE WHEN doc_id % 10 = 0 THEN '' ELSE '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T09:00:00Z' END AS created_at,
    CASE WHEN doc_id % 10 = 0 THEN '' ELSE '2024-' || lpad((doc_id % 7 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T12:00:00Z' END AS updated_at
  FROM documents LEFT JOIN labels USING (doc_id))"""
_FEED = f"""change_feed AS (
  SELECT user_id AS page_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'S' || (user_id % 5) END AS space_key,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS title,
    (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS version, ts AS last_modified, event_id AS seq
  FROM events),
remote AS (SELECT page_id, max(version) AS version, max(last_modified) AS last_modified FROM change_feed GROUP BY page_id),
local AS (SELECT page_id, max(version) AS version FROM change_feed WHERE last_modified <= TIMESTAMP '{ws.LOCAL_UNTIL}' AND page_id % {ws.LOCAL_GAP} <> 0 GROUP BY page_id),
status AS (
  SELECT coalesce(r.page_id, l.page_id) AS page_id,
    CASE WHEN r.page_id IS NULL THEN 'deleted' WHEN l.page_id IS NULL THEN 'added' WHEN r.version > l.version THEN 'modified' ELSE 'same' END AS state,
    CASE WHEN r.version > l.version THEN r.version - l.version ELSE 0 END AS drift
  FROM remote r FULL OUTER JOIN local l ON r.page_id = l.page_id)"""
_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS title, '' AS parent_id, 'folder' AS kind FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 'page' FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'Supplier ' || (s_suppkey % 20), 'n' || s_nationkey, 'page' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'Customer ' || (c_custkey % 50), 'n' || c_nationkey, 'page' FROM customer)"""
_LINKS = """page_links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


def _segment_sql(x: str) -> str:
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    s = f"""regexp_replace(regexp_replace({s}, '[<>:"/\\\\|?*\\x00-\\x1f]', '-', 'g'), '^[. ]+|[. ]+$', '', 'g')"""
    s = f"regexp_replace(regexp_replace({s}, '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g')"
    n = text.MAX_SEGMENT
    s = f"regexp_replace(CASE WHEN strlen({s}) > {n} THEN list_max(list_filter(list_transform(range(0, {n + 1}), lambda k: substr({s}, 1, k)), lambda p: strlen(p) <= {n})) ELSE {s} END, '-+$', '')"
    s = f"coalesce(nullif({s}, ''), 'untitled')"
    names = ", ".join(f"'{n}'" for n in text.RESERVED_NAMES)
    return f"(CASE WHEN upper(split_part({s}, '.', 1)) IN ({names}) THEN {s} || '-item' ELSE {s} END)"


_PATHS = f"""{_NODES},
parents AS (SELECT DISTINCT parent_id AS id FROM nodes WHERE parent_id <> ''),
page_paths AS (
  SELECT n.id AS page_id,
    CASE WHEN g.id IS NOT NULL THEN {_segment_sql("g.title")} || '/' ELSE '' END || CASE WHEN p.id IS NOT NULL THEN {_segment_sql("p.title")} || '/' ELSE '' END
    || CASE WHEN h.id IS NOT NULL THEN {_segment_sql("n.title")} || '/' ELSE '' END || {_segment_sql("n.title")} || '.md' AS path
  FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id LEFT JOIN nodes g ON p.parent_id = g.id LEFT JOIN parents h ON n.id = h.id WHERE n.kind = 'page')"""


def register(sql: str | None):
    """Adds a query under its function's name."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _standard(rows: DataFrame) -> DataFrame:
    rows = search.project(rows, "standard")
    return rows.withColumn("labels", F.array_join("labels", ",")).withColumn("score", F.round("score", 6))


def _standard_sql(where: str, limit: int = 20) -> str:
    return f"""WITH {_DOCS} SELECT id, type, path, page_id, title, space_key, array_to_string(labels, ',') AS labels, heading_text, line, 0::DOUBLE AS score
FROM doc_index WHERE {where} ORDER BY path, line, id LIMIT {limit}"""


# Filters, projections, facets


@register(_standard_sql("space_key = 'src3' AND list_contains(labels, 'en') AND list_contains(labels, 'quality')"))
def search_filter_space_label(spark, sf_dir):
    return _standard(search.search(ws.doc_index(spark, sf_dir), SearchOptions(space="src3", labels=("en", "quality"))))


@register(_standard_sql("created_by = 'u3' AND updated_by = 'u5'"))
def search_filter_author(spark, sf_dir):
    return _standard(search.search(ws.doc_index(spark, sf_dir), SearchOptions(created_by="u3", updated_by="u5")))


@register(_standard_sql("created_at <= '2024-03-31T23:59:59Z' AND updated_at <= '2024-05-01T00:00:00Z'", 50))
def search_filter_date_text(spark, sf_dir):
    return _standard(search.search(ws.doc_index(spark, sf_dir), SearchOptions(created_before="2024-03-31", updated_before="2024-05-01T00:00:00Z", limit=50)))


@register(_standard_sql("created_at <> '' AND created_at >= '2024-02-01T00:00:00Z' AND created_at <= '2024-03-31T23:59:59Z'", 50))
def search_filter_date_typed(spark, sf_dir):
    return _standard(search.search(ws.doc_index(spark, sf_dir), SearchOptions(created_after="2024-02-01", created_before="2024-03-31", limit=50, typed_dates=True)))


@register(_standard_sql("translate(heading_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the_an%'", 30))
def search_filter_heading(spark, sf_dir):
    return _standard(search.search(ws.doc_index(spark, sf_dir), SearchOptions(heading="The_an", limit=30)))


@register(_standard_sql("type IN ('page', 'code') AND space_key = 'src1'"))
def search_filter_type(spark, sf_dir):
    return _standard(search.search(ws.doc_index(spark, sf_dir), SearchOptions(types=("page", "code"), space="src1")))


@register(f"WITH {_DOCS} SELECT path, title, 0::DOUBLE AS score FROM doc_index WHERE space_key = 'src2' ORDER BY path, line, id LIMIT 20")
def search_project_minimal(spark, sf_dir):
    return search.project(search.search(ws.doc_index(spark, sf_dir), SearchOptions(space="src2")), "minimal")


@register(f"WITH {_DOCS} SELECT DISTINCT unnest(labels) AS label FROM doc_index")
def facet_labels(spark, sf_dir):
    return search.facet_labels(ws.doc_index(spark, sf_dir))


@register(f"WITH {_DOCS} SELECT DISTINCT space_key FROM doc_index WHERE space_key <> ''")
def facet_spaces(spark, sf_dir):
    return search.facet_spaces(ws.doc_index(spark, sf_dir))


@register(f"WITH {_DOCS} SELECT DISTINCT path FROM doc_index WHERE space_key = 'src4'")
def paths_by_space(spark, sf_dir):
    return search.paths(ws.doc_index(spark, sf_dir), "src4")


# Ranking


def _bm25_sql(words: list[str], any_word: bool, limit: int, where: str = "TRUE") -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    sums = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l / a))" for i in range(len(words)))
    found = (" OR " if any_word else " AND ").join(f"tf{i} > 0" for i in range(len(words)))
    return f"""WITH {_DOCS}, tokens AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', title, content, heading_text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM doc_index),
tf AS (SELECT id, space_key, len(t) AS l, {counts} FROM tokens), sums AS (SELECT count(*) AS n, avg(l) AS a, {sums} FROM tf)
SELECT id, score FROM (SELECT id, round(-({score}), 6) AS score, -({score}) AS raw FROM tf, sums WHERE ({found}) AND {where} ORDER BY raw, id LIMIT {limit})"""


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round("score", 6).alias("score"))


@register(_bm25_sql(["the", "license"], False, 20))
def search_bm25_and(spark, sf_dir):
    return _scored(search.search(ws.doc_index(spark, sf_dir), SearchOptions(query="the License")))


@register(_bm25_sql(["license", "version", "pathetic"], True, 50))
def search_bm25_or(spark, sf_dir):
    return _scored(search.search(ws.doc_index(spark, sf_dir), SearchOptions(query="license/version pathetic", any_word=True)))


@register(_bm25_sql(["the", "and"], False, 10, "space_key = 'src3'"))
def search_topk(spark, sf_dir):
    return _scored(search.search(ws.doc_index(spark, sf_dir), SearchOptions(query="the and", space="src3", limit=10)))


@register(None)
def search_stemmed(spark, sf_dir):
    return _scored(search.search(ws.doc_index(spark, sf_dir), SearchOptions(query="licensed versions"), stemmed=True))


@register(None)
def search_snippet(spark, sf_dir):
    found = search.search(ws.doc_index(spark, sf_dir), SearchOptions(query="the license"))
    return search.with_snippets(found, "the license").select("id", "snippet")


@register(f"WITH {_DOCS} SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', title, content, heading_text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM doc_index) GROUP BY id, term) GROUP BY term")
def postings_statistics(spark, sf_dir):
    found = search.postings(ws.doc_index(spark, sf_dir))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


# Search from stored postings

_INDEXES: dict[tuple[str, str, str], postings.StoredIndex] = {}


def stored_index(spark, sf_dir, analyser: str) -> postings.StoredIndex:
    """The stored index of a folder's documents; built once by a session, as an index is there to be asked again."""
    key = (spark.sparkContext.applicationId, sf_dir, analyser)
    if key not in _INDEXES:
        _INDEXES[key] = postings.StoredIndex.build(ws.doc_texts(spark, sf_dir), analyser)
    return _INDEXES[key]


@register(_bm25_sql(["the", "license"], False, 20))
def stored_bm25_and(spark, sf_dir):
    hits = stored_index(spark, sf_dir, "plain").bm25(["the", "license"])
    return _scored(postings.top(hits, ws.doc_index(spark, sf_dir).select("id"), 20))


@register(_bm25_sql(["the", "and"], True, 10, "space_key = 'src3'"))
def stored_bm25_filtered(spark, sf_dir):
    hits = stored_index(spark, sf_dir, "plain").bm25(["the", "and"], any_word=True)
    options = SearchOptions(query="the and", space="src3")
    return _scored(postings.top(hits, ws.doc_index(spark, sf_dir).select("id", "space_key"), 10, conditions=search.filters(options)))


RELAXED = "The licenses of version and passages"


def _relaxed_sql(words: list[str], limit: int) -> str:
    """The relaxed formula over tokens without stop words, not stemmed; ties by id."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    stops = ", ".join(map(quoted, sorted(postings.STOP_WORDS)))
    fields = []
    for field, boost in postings.BOOSTS.items():
        tokens = f"regexp_extract_all(replace(lower(coalesce({field}, '')), '’', ''''), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*')"
        fields.append(f"SELECT id, '{field}' AS field, {boost}::DOUBLE AS boost, list_filter(list_transform({tokens}, lambda w: regexp_replace(w, '''s$', '')), lambda w: w NOT IN ({stops})) AS t FROM doc_index")
    asked = ", ".join(f"({quoted(w)})" for w in words)
    return f"""WITH {_DOCS}, fields AS ({" UNION ALL ".join(fields)}), asked(word) AS (VALUES {asked}),
tfs AS (SELECT id, field, boost, word, len(list_filter(t, lambda w: w = word)) AS tf, len(t) AS l FROM fields, asked),
idfs AS (SELECT field, boost, word, 1 + ln(count(*) / (count(*) FILTER (tf > 0) + 1)) AS idf FROM tfs GROUP BY ALL),
norm AS (SELECT sqrt(sum((boost * idf) ** 2)) AS norm FROM idfs),
sums AS (SELECT id, field, sum(sqrt(tf::DOUBLE / l) * tfs.boost * idf * idf) * count(*) / {float(len(words))} AS s FROM tfs JOIN idfs USING (field, word) WHERE tf > 0 GROUP BY id, field),
scores AS (SELECT id, sum(s) * count(*) / 3.0::DOUBLE / any_value(norm) AS raw FROM sums, norm GROUP BY id),
hits AS (SELECT id, raw FROM scores ORDER BY raw DESC, id LIMIT {limit})"""


def _relaxed(spark, sf_dir, columns):
    hits = stored_index(spark, sf_dir, "english").relaxed(postings.english(RELAXED))
    return postings.top(hits, ws.doc_index(spark, sf_dir).select("id", *columns), search.RELAXED_LIMIT, best_first=True)


@register(_relaxed_sql(postings.english(RELAXED), search.RELAXED_LIMIT) + " SELECT id, round(raw, 6) AS score FROM hits")
def relaxed_search(spark, sf_dir):
    return _scored(_relaxed(spark, sf_dir, []))


def _fragment_sql(words: list[str]) -> str:
    wanted = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    fragment = "''"
    for field in reversed(postings.FRAGMENT_FIELDS):
        pieces = f"regexp_extract_all({field}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')"
        at = f"list_position(list_transform({pieces}, lambda x: list_contains({wanted}, lower(x))), true)"
        window = f"list_slice({pieces}, greatest({at} - {postings.BEFORE}, 1), {at} + {postings.AFTER} - 1)"
        marked = f"array_to_string(list_transform({window}, lambda x: CASE WHEN list_contains({wanted}, lower(x)) THEN '<mark>' || x || '</mark>' ELSE x END), '')"
        fragment = f"CASE WHEN {at} > 0 THEN {marked} ELSE {fragment} END"
    return fragment


@register(_relaxed_sql(postings.english(RELAXED), search.RELAXED_LIMIT) + f" SELECT id, {_fragment_sql(postings.english(RELAXED))} AS fragment FROM hits JOIN doc_index USING (id)")
def relaxed_fragments(spark, sf_dir):
    found = _relaxed(spark, sf_dir, postings.FRAGMENT_FIELDS)
    return postings.with_fragments(found, postings.english(RELAXED)).select("id", "fragment")


# Changes


def _feed(spark, sf_dir):
    feed = ws.change_feed(spark, sf_dir)
    return feed, ws.remote_pages(feed), ws.local_pages(feed)


@register(f"WITH {_FEED} SELECT page_id FROM change_feed WHERE last_modified >= TIMESTAMP '2024-01-30 12:00:00' UNION SELECT page_id FROM status WHERE state IN ('added', 'modified') UNION SELECT page_id FROM remote WHERE page_id % 50 = 1")
def changed_pages(spark, sf_dir):
    feed, remote, local = _feed(spark, sf_dir)
    lower = changes.since(F.lit("2024-01-30 12:05:30").cast("timestamp_ntz"))
    return changes.changed_pages(feed.where(F.col("last_modified") >= lower), remote, local, remote.where("page_id % 50 = 1"))


@register(f"WITH {_FEED} SELECT DISTINCT page_id FROM remote")
def changed_pages_force(spark, sf_dir):
    feed, remote, local = _feed(spark, sf_dir)
    return changes.changed_pages(feed, remote, local, force=True)


@register(f"WITH {_FEED} SELECT page_id FROM local WHERE page_id NOT IN (SELECT page_id FROM remote WHERE page_id % 9 <> 0)")
def deleted_pages(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    return changes.deleted_pages(remote.where("page_id % 9 <> 0"), local)


@register(f"WITH {_FEED} SELECT page_id FROM local WHERE page_id % 9 = 0 AND page_id % 2 = 0")
def recovered_pages(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    status = F.when(F.col("page_id") % 2 == 0, "Current").otherwise("archived")
    return changes.recovered_pages(remote.where("page_id % 9 <> 0"), local, remote.withColumn("syncable", text.is_syncable(status)))


@register(f"WITH {_FEED} SELECT page_id, state, drift FROM status")
def status_report(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    return changes.status(remote, local)


@register(f"WITH {_FEED} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'deleted') AS deleted, coalesce(max(drift), 0) AS max_drift FROM status")
def drift_report(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    return changes.status_summary(changes.status(remote, local))


@register(f"WITH {_FEED} SELECT page_id FROM status WHERE state = 'modified' INTERSECT SELECT page_id FROM local WHERE page_id % 3 = 0")
def conflict_ahead(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    return changes.conflict_ahead(local.where("page_id % 3 = 0"), changes.status(remote, local).where("state = 'modified'"))


@register(f"WITH {_FEED} SELECT (SELECT count(DISTINCT page_id) FROM change_feed WHERE last_modified >= TIMESTAMP '2024-01-30 00:00:00') AS changed, (SELECT count(*) FROM local WHERE page_id % 9 = 0) AS deleted")
def pull_impact(spark, sf_dir):
    feed, remote, local = _feed(spark, sf_dir)
    changed = feed.where(F.col("last_modified") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).agg(F.countDistinct("page_id").alias("changed"))
    return changed.join(changes.deleted_pages(remote.where("page_id % 9 <> 0"), local).agg(F.count(F.lit(1)).alias("deleted")))


@register(f"WITH {_FEED} SELECT page_id, coalesce(arg_min(space_key, seq) FILTER (space_key <> ''), '') AS space_key, coalesce(arg_min(title, seq) FILTER (title <> ''), '') AS title, max(version) AS version, max(last_modified) AS last_modified FROM change_feed GROUP BY page_id")
def merged_changes(spark, sf_dir):
    return changes.merge_changes(ws.change_feed(spark, sf_dir))


@register(f"WITH {_FEED} SELECT greatest(max(last_modified), TIMESTAMP '2024-01-15 00:00:00') AS watermark FROM change_feed")
def high_watermark(spark, sf_dir):
    return changes.high_watermark(ws.change_feed(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


_SNAPSHOTS = """before AS (SELECT 'd/' || doc_id || '.md' AS path, text AS content FROM documents WHERE doc_id % 11 <> 0),
after AS (SELECT 'd/' || doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS content FROM documents WHERE doc_id % 13 <> 0),
diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS code
  FROM before a FULL OUTER JOIN after b ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content)"""


def _snapshot(spark, sf_dir):
    docs = ws.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    before = docs.where("doc_id % 11 <> 0").select(path, F.col("text").alias("content"))
    after = docs.where("doc_id % 13 <> 0").select(path, F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return changes.snapshot_diff(before, after)


@register(f"WITH {_SNAPSHOTS} SELECT path, code FROM diff")
def snapshot_diff(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@register(f"WITH {_SNAPSHOTS} SELECT count(*) FILTER (code = 'A') AS added, count(*) FILTER (code = 'M') AS modified, count(*) FILTER (code = 'D') AS deleted FROM diff")
def change_counts(spark, sf_dir):
    return changes.change_counts(_snapshot(spark, sf_dir))


@register(f"WITH {_SNAPSHOTS} SELECT count(*) AS files, count(*) > 10 OR coalesce(bool_or(code = 'D'), false) AS confirm FROM diff")
def safety_threshold(spark, sf_dir):
    return changes.needs_confirmation(_snapshot(spark, sf_dir))


@register("""WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'in/' ELSE 'out/' END || CASE WHEN doc_id % 4 = 0 THEN 'assets/' ELSE '' END || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.png' ELSE '.md' END AS path,
  ['A', 'M', 'D', 'T', 'X'][(doc_id % 5 + 1)::INTEGER] AS code FROM documents)
SELECT path, CASE WHEN code = 'T' THEN 'M' ELSE code END AS code FROM c WHERE path LIKE 'in/%' AND path LIKE '%.md' AND path NOT LIKE '%assets/%' AND code <> 'X'""")
def scoped_changes(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 3 == 0, "in/").otherwise("out/"), F.when(i % 4 == 0, "assets/").otherwise(""), i.cast("string"), F.when(i % 5 == 0, ".png").otherwise(".md"))
    code = F.get(F.array(*[F.lit(c) for c in "AMDTX"]), (i % 5).cast("int"))
    return changes.scoped_changes(ws.table(spark, sf_dir, "documents").select(path.alias("path"), code.alias("code")), "in")


@register(f"WITH {_FEED} SELECT r.page_id, l.version AS local, r.version AS remote, CASE WHEN r.version >= l.version + 1 THEN r.version + 1 ELSE l.version + 1 END AS next FROM remote r JOIN local l ON r.page_id = l.page_id")
def next_version(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    both = remote.select("page_id", F.col("version").alias("remote")).join(local.select("page_id", F.col("version").alias("local")), "page_id")
    return changes.next_version(both.select("page_id", "local", "remote"), force=True)


@register(f"WITH {_FEED} SELECT coalesce(r.page_id, l.page_id) AS page_id, CASE WHEN r.page_id IS NULL THEN 'create' WHEN l.page_id IS NULL THEN 'archive' ELSE 'update' END AS action, CASE WHEN r.page_id IS NOT NULL AND l.page_id IS NOT NULL THEN l.version + 1 END AS version FROM (SELECT * FROM remote WHERE page_id % 4 <> 0) r FULL OUTER JOIN local l ON r.page_id = l.page_id")
def preflight_plan(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    there = remote.where("page_id % 4 <> 0").select("page_id", F.lit(True).alias("there"))
    both = there.join(local.select("page_id", "version"), "page_id", "full_outer")
    action = F.when(F.col("there").isNull(), "create").when(F.col("version").isNull(), "archive").otherwise("update")
    return both.select("page_id", action.alias("action"), F.when(action == "update", F.col("version") + 1).alias("version"))


@register(f"WITH {_FEED} SELECT page_id, min(path) AS path FROM (SELECT page_id, 'p/' || version || '.md' AS path FROM change_feed) WHERE page_id IN (SELECT page_id FROM remote WHERE page_id % 2 = 0) GROUP BY page_id")
def state_rebuild(spark, sf_dir):
    feed, remote, _ = _feed(spark, sf_dir)
    files = feed.select("page_id", F.concat(F.lit("p/"), F.col("version").cast("string"), F.lit(".md")).alias("path"))
    return changes.rebuild_state(files, remote.where("page_id % 2 = 0"))


# Hierarchy


@register(f"WITH {_PATHS} SELECT page_id, path FROM page_paths")
def page_paths(spark, sf_dir):
    return hierarchy.planned_paths(ws.nodes(spark, sf_dir))


@register(f"""WITH RECURSIVE chain AS (SELECT 'k' || s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name END AS title,
  CASE WHEN s_suppkey % 100 = 0 THEN '' ELSE 'k' || (s_suppkey - 1) END AS parent_id FROM supplier),
named AS (SELECT id, parent_id, {_segment_sql("CASE WHEN trim(title) = '' THEN 'page-' || id ELSE title END")} AS segment FROM chain),
up AS (SELECT id, segment, '' AS above FROM named WHERE parent_id = ''
  UNION ALL SELECT n.id, n.segment, up.above || up.segment || '/' FROM named n JOIN up ON n.parent_id = up.id)
SELECT id AS page_id, above || CASE WHEN id IN (SELECT parent_id FROM chain) THEN segment || '/' ELSE '' END || segment || '.md' AS path FROM up""")
def deep_paths(spark, sf_dir):
    i = F.col("s_suppkey")
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    chain = ws.table(spark, sf_dir, "supplier").select(
        key(i).alias("id"), F.when(i % 7 == 0, " ").otherwise(F.col("s_name")).alias("title"), F.when(i % 100 == 0, "").otherwise(key(i - 1)).alias("parent_id"), F.lit("page").alias("kind"), F.lit("page").alias("parent_kind")
    )
    return hierarchy.planned_paths(chain)


@register(f"WITH {_NODES} SELECT id AS folder_id, {_segment_sql('title')} AS path FROM nodes WHERE kind = 'folder'")
def folder_paths(spark, sf_dir):
    return hierarchy.folder_paths(ws.nodes(spark, sf_dir))


@register(f"WITH {_NODES} SELECT id, id IN (SELECT parent_id FROM nodes) AS has_children FROM nodes")
def has_children(spark, sf_dir):
    return hierarchy.has_children(ws.nodes(spark, sf_dir))


_UNIQUE = """unique_paths AS (SELECT page_id, CASE WHEN k > 1 THEN regexp_replace(path, '\\.md$', '') || '-' || k || '.md' ELSE path END AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS k FROM page_paths))"""


@register(f"WITH {_PATHS}, {_UNIQUE} SELECT page_id, path FROM unique_paths")
def unique_paths(spark, sf_dir):
    return hierarchy.unique_paths(hierarchy.planned_paths(ws.nodes(spark, sf_dir)))


@register(f"""WITH {_PATHS}, numbered AS (SELECT page_id, path, row_number() OVER (PARTITION BY path ORDER BY page_id) AS r FROM page_paths),
taken AS (SELECT regexp_extract(path, '^(.*)-[1-9][0-9]*\\.md$', 1) || '.md' AS path, list(DISTINCT regexp_extract(path, '-([1-9][0-9]*)\\.md$', 1)::BIGINT) AS numbers FROM page_paths WHERE regexp_matches(path, '-[1-9][0-9]*\\.md$') GROUP BY 1)
SELECT page_id, CASE WHEN r = 1 THEN path ELSE regexp_replace(path, '\\.md$', '') || '-' || list_filter(range(2, r + 2 + coalesce(len(numbers), 0)), lambda k: NOT list_contains(coalesce(numbers, []), k))[r - 1] || '.md' END AS path FROM numbered LEFT JOIN taken USING (path)""")
def allocated_paths(spark, sf_dir):
    return hierarchy.allocate_paths(hierarchy.planned_paths(ws.nodes(spark, sf_dir)))


@register(f"WITH {_PATHS}, {_UNIQUE} SELECT a.page_id, a.path AS previous, b.path AS planned FROM page_paths a JOIN unique_paths b ON a.page_id = b.page_id WHERE a.path <> b.path")
def path_moves(spark, sf_dir):
    planned = hierarchy.planned_paths(ws.nodes(spark, sf_dir))
    return hierarchy.path_moves(planned, hierarchy.unique_paths(planned))


@register(f"WITH {_PATHS} SELECT path FROM page_paths WHERE page_id LIKE 's%' AND lower(path) NOT IN (SELECT lower(path) FROM page_paths WHERE page_id LIKE 's%1')")
def gone_paths(spark, sf_dir):
    planned = hierarchy.planned_paths(ws.nodes(spark, sf_dir)).where("page_id LIKE 's%'")
    return hierarchy.gone_paths(planned, planned.where("page_id LIKE '%1'").withColumn("path", F.upper("path")))


@register(f"""WITH {_PATHS}, above AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS directory FROM page_paths, (SELECT unnest(range(1, 6)) AS n) WHERE n < len(string_split(path, '/')) AND page_id NOT LIKE 'n%'),
directories AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, page_id AS id FROM page_paths WHERE page_id LIKE 'n%' AND page_id NOT LIKE '%3'
  UNION ALL SELECT {_segment_sql('title')}, id FROM nodes WHERE kind = 'folder')
SELECT path, coalesce(arg_max(id, length(d.directory)), '') AS parent FROM above a LEFT JOIN directories d ON a.directory = d.directory GROUP BY path""")
def nearest_parent(spark, sf_dir):
    nodes = ws.nodes(spark, sf_dir)
    planned = hierarchy.planned_paths(nodes)
    own = planned.where("page_id LIKE 'n%' AND page_id NOT LIKE '%3'").select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.col("page_id").alias("id"))
    index = own.unionByName(hierarchy.folder_paths(nodes).select(F.col("path").alias("directory"), F.col("folder_id").alias("id")))
    return hierarchy.nearest_parents(planned.where("page_id NOT LIKE 'n%'").select("path").distinct(), index)


@register("""WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/' || source || '.md' WHEN doc_id % 3 = 1 THEN source || '/' || lang || '/' || doc_id || '.md' ELSE doc_id || '.md' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'M' END AS code FROM documents)
SELECT path, code, len(string_split(path, '/'))::INTEGER AS depth, len(string_split(path, '/')) > 1 AND string_split(path, '/')[-1] = string_split(path, '/')[-2] || '.md' AS is_index FROM c""")
def push_order(spark, sf_dir):
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat("source", F.lit("/"), "source", F.lit(".md"))).when(i % 3 == 1, F.concat("source", F.lit("/"), "lang", F.lit("/"), i.cast("string"), F.lit(".md"))).otherwise(F.concat(i.cast("string"), F.lit(".md")))
    return hierarchy.push_order(ws.table(spark, sf_dir, "documents").select(path.alias("path"), F.when(i % 2 == 0, "A").otherwise("M").alias("code")))


# Scalars


@register(f"SELECT page_id, {_segment_sql('title')} AS segment, {_segment_sql('title')} || '.md' AS filename FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' con.' || page_id WHEN 1 THEN '<' || url || '>' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages)")
def sanitize_titles(spark, sf_dir):
    i = F.col("page_id")
    title = F.when(i % 5 == 0, F.concat(F.lit(" con."), i.cast("string"))).when(i % 5 == 1, F.concat(F.lit("<"), "url", F.lit(">"))).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    rows = ws.table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    return rows.select("page_id", text.path_segment(F.col("title")).alias("segment"), text.markdown_name(F.col("title")).alias("filename"))


@register("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform([' ' || upper(lang) || ' ', lang, source, ''], lambda x: lower(trim(x))), lambda x: x <> ''))), ',') AS labels FROM documents")
def normalize_labels(spark, sf_dir):
    raw = F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")), "lang", "source", F.lit(""))
    return ws.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.labels(raw), ",").alias("labels"))


@register("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-0' || (doc_id % 9 + 1) || '-11' WHEN 1 THEN '2024-0' || (doc_id % 9 + 1) || '-11T10:20:30Z' WHEN 2 THEN 'soon' ELSE '' END AS raw FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN raw || 'T00:00:00Z' ELSE raw END AS stored, CASE doc_id % 4 WHEN 0 THEN raw || 'T23:59:59Z' ELSE raw END AS bound, substr(raw, 1, 10) AS short FROM d""")
def normalize_dates(spark, sf_dir):
    i = F.col("doc_id")
    day = F.concat(F.lit("2024-0"), (i % 9 + 1).cast("string"), F.lit("-11"))
    raw = F.when(i % 4 == 0, day).when(i % 4 == 1, F.concat(day, F.lit("T10:20:30Z"))).when(i % 4 == 2, "soon").otherwise("")
    rows = ws.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", text.stored_date(F.col("raw")).alias("stored"), text.date_bound(F.col("raw"), True).alias("bound"), text.short_date(F.col("raw")).alias("short"))


_URLS = """urls AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'pageId=' || page_id WHEN 1 THEN 'https://w.example.org/wiki/spaces/K' || (page_id % 7) || '/pages/' || page_id || '/Title' ELSE url END AS url FROM pages)"""


def _urls(spark, sf_dir):
    i = F.col("page_id")
    mark = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    made = F.when(i % 3 == 0, F.concat("url", mark, F.lit("pageId="), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("https://w.example.org/wiki/spaces/K"), (i % 7).cast("string"), F.lit("/pages/"), i.cast("string"), F.lit("/Title"))).otherwise(F.col("url"))
    return ws.table(spark, sf_dir, "pages").select("page_id", made.alias("url"))


@register(f"WITH {_URLS} SELECT page_id, url, coalesce(nullif(regexp_extract(url, '[?&]pageId=([^&#]*)', 1), ''), regexp_extract(regexp_replace(url, '[?#].*$', ''), '/pages/(\\d+)(?:/|$)', 1)) AS target FROM urls")
def url_page_id(spark, sf_dir):
    return _urls(spark, sf_dir).withColumn("target", text.page_id_of_url(F.col("url")))


@register(f"WITH {_URLS} SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/[^?#]*)?/spaces/([^/?#]+)/pages/', 1) AS space_key FROM urls")
def url_space_key(spark, sf_dir):
    return _urls(spark, sf_dir).withColumn("space_key", text.space_key_of_url(F.col("url")))


# Links and assets


@register("""WITH l AS (SELECT page_id AS i, length(html) % 7 AS k FROM pages),
rows AS (SELECT 'home/' || i || '.md' AS source_path, CASE k WHEN 0 THEN 'https://x.org/' || i WHEN 1 THEN '#top' WHEN 2 THEN (i + 1) || '.md#part' WHEN 3 THEN '../away%20there/' || (i + 2) || '.md' WHEN 4 THEN './sub/../' || (i + 3) || '.md' WHEN 5 THEN ' gone/' || i || '.md ' ELSE '../away%20there/./' || (i + 6) || '.md#a' END AS destination,
  CASE k WHEN 2 THEN 'home/' || (i + 1) || '.md' WHEN 3 THEN 'away there/' || (i + 2) || '.md' WHEN 4 THEN 'home/' || (i + 3) || '.md' WHEN 5 THEN 'home/gone/' || i || '.md' WHEN 6 THEN 'away there/' || (i + 6) || '.md' ELSE '' END AS target,
  CASE k WHEN 1 THEN 'top' WHEN 2 THEN 'part' WHEN 6 THEN 'a' ELSE '' END AS anchor FROM l),
ids AS (SELECT page_id::VARCHAR AS page_id, CASE WHEN page_id % 2 = 0 THEN 'home/' ELSE 'away there/' END || page_id || '.md' AS path, page_id % 2 = 0 AS own FROM pages)
SELECT source_path, destination, target, ids.page_id, anchor, CASE WHEN target = '' THEN 'passed' WHEN own THEN 'local' WHEN NOT own THEN 'cross' ELSE 'unresolved' END AS how FROM rows LEFT JOIN ids ON target = path""")
def path_to_page(spark, sf_dir):
    pages = ws.table(spark, sf_dir, "pages")
    i, k = F.col("page_id"), F.length("html") % 7
    name = lambda before, n, after: F.concat(F.lit(before), (i + n).cast("string"), F.lit(after))
    forms = [name("https://x.org/", 0, ""), F.lit("#top"), name("", 1, ".md#part"), name("../away%20there/", 2, ".md"), name("./sub/../", 3, ".md"), name(" gone/", 0, ".md "), name("../away%20there/./", 6, ".md#a")]
    found = pages.select(name("home/", 0, ".md").alias("source_path"), F.coalesce(*[F.when(k == n, form) for n, form in enumerate(forms)]).alias("destination"))
    index = lambda rest, folder: pages.where(i % 2 == rest).select(i.cast("string").alias("page_id"), name(folder, 0, ".md").alias("path"))
    return links.page_ids_of_links(found, index(0, "home/"), index(1, "away there/"))


@register("SELECT page_id::VARCHAR AS page_id, url AS path FROM pages WHERE page_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def relink_targets(spark, sf_dir):
    index = ws.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("path"))
    return links.relink_targets(index, ws.table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").cast("string").alias("page_id")))


@register(f"""WITH {_FEED} SELECT r.page_id, NOT ((l.version + r.page_id % 3 > 0 AND r.version < l.version + r.page_id % 3) OR r.last_modified < TIMESTAMP '{ws.LOCAL_UNTIL}') AS fresh
FROM remote r JOIN local l ON r.page_id = l.page_id""")
def expected_state(spark, sf_dir):
    feed = ws.change_feed(spark, sf_dir)
    local = ws.local_pages(feed).select("page_id", (F.col("version") + F.col("page_id") % 3).alias("expected"))
    rows = ws.remote_pages(feed).join(local, "page_id")
    return rows.select("page_id", changes.meets_expected(F.col("version"), F.col("last_modified"), F.col("expected"), F.lit(ws.LOCAL_UNTIL).cast("timestamp_ntz")).alias("fresh"))


@register("""SELECT 'd/' || doc_id || '.md' AS path, doc_id::VARCHAR AS tracked, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS code
FROM documents WHERE doc_id % 4 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0)""")
def tracked_ids(spark, sf_dir):
    docs, i = ws.table(spark, sf_dir, "documents"), F.col("doc_id")
    path, own = F.concat(F.lit("d/"), i.cast("string"), F.lit(".md")).alias("path"), i.cast("string")
    pages = docs.select(path, F.when(i % 7 == 0, F.when(i % 2 == 0, " ")).when(i % 5 == 0, F.concat(F.lit("x"), own)).otherwise(own).alias("id"))
    return lint.tracked_id_issues(pages, docs.select(path, F.when(i % 4 == 0, "").otherwise(own).alias("page_id")))


@register("""SELECT doc_id, doc_id % 6 IN (0, 1, 2, 3) AS generated FROM documents""")
def generated_paths(spark, sf_dir):
    i = F.col("doc_id")
    tails = ["/State.JSON", "/./page.MD", "/Assets/x.png", "/a/../assets/1/b", "/assets.png", "/notes.mdx"]
    path = F.concat("source", F.coalesce(*[F.when(i % 6 == n, t) for n, t in enumerate(tails)]))
    return ws.table(spark, sf_dir, "documents").select("doc_id", text.is_generated(path).alias("generated"))


@register(f"WITH {_LINKS} SELECT page_id, count(*) AS links FROM page_links GROUP BY page_id")
def links_per_page(spark, sf_dir):
    return ws.page_links(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@register(f"""WITH {_LINKS} SELECT page_id, href, page_id + length(href) AS target,
  CASE (page_id + length(href)) % 3 WHEN 0 THEN 'local/' || (page_id + length(href)) || '.md' WHEN 1 THEN 'other/' || (page_id + length(href)) || '.md' ELSE '' END AS path,
  CASE (page_id + length(href)) % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cross' ELSE 'unresolved' END AS how
FROM page_links WHERE page_id + length(href) <= (SELECT max(page_id) FROM pages)""")
def link_resolution(spark, sf_dir):
    pages = ws.table(spark, sf_dir, "pages")
    found = ws.page_links(spark, sf_dir).select("page_id", "href", (F.col("page_id") + F.length("href")).alias("target"))
    known = lambda folder, rest: pages.where(f"page_id % 3 = {rest}").select("page_id", F.concat(F.lit(f"{folder}/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    most = pages.agg(F.max("page_id").alias("most"))
    listed = found.join(F.broadcast(most)).where("target <= most").drop("most")
    return links.resolve_page_links(listed, known("local", 0), known("other", 1))


@register(f"WITH {_LINKS}, l AS (SELECT page_id, href FROM page_links UNION ALL SELECT page_id, url FROM pages) SELECT page_id, count(*) FILTER (regexp_matches(lower(trim(href)), '^(#|https?://|mailto:|tel:|data:|//)') OR trim(href) = '') AS external, count(*) AS links FROM l GROUP BY page_id")
def external_links(spark, sf_dir):
    both = ws.page_links(spark, sf_dir).select("page_id", "href").unionAll(ws.table(spark, sf_dir, "pages").select("page_id", "url"))
    return both.groupBy("page_id").agg(F.count_if(text.is_external(F.col("href"))).alias("external"), F.count(F.lit(1)).alias("links"))


@register("SELECT 'assets/' || page_id || '/a.png' AS path FROM pages WHERE page_id % 3 = 0")
def orphan_assets(spark, sf_dir):
    path = text.attachment_path(F.col("page_id").cast("string"), F.lit("a"), F.lit("b"))
    path = F.concat(F.regexp_replace(path, "[^/]*$", ""), F.lit("a.png")).alias("path")
    pages = ws.table(spark, sf_dir, "pages")
    return links.orphan_assets(pages.select(path), pages.where("page_id % 3 <> 0").select(path))


@register("""WITH p AS (SELECT page_id AS i, 'assets/' || page_id || '/f' AS path FROM pages)
SELECT path, 'missing_file' AS issue FROM p WHERE i % 2 = 0 AND i % 5 = 0 UNION ALL SELECT path, 'untracked_file' FROM p WHERE i % 5 <> 0 AND i % 3 <> 0
UNION ALL SELECT path, 'unreferenced' FROM p WHERE i % 3 = 0 AND i % 2 <> 0 UNION ALL SELECT path, 'gone_remotely' FROM p WHERE i % 3 = 0 AND i % 7 = 0""")
def attachment_drift(spark, sf_dir):
    rows = ws.table(spark, sf_dir, "pages").select(F.col("page_id").alias("i"), F.concat(F.lit("assets/"), F.col("page_id").cast("string"), F.lit("/f")).alias("path"))
    return links.attachment_drift(rows.where("i % 2 = 0"), rows.where("i % 3 = 0"), rows.where("i % 5 <> 0"), rows.where("i % 7 <> 0"))


@register("""WITH a AS (SELECT lower('File ' || CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 40 ELSE s_suppkey END) AS k, 's' || s_suppkey AS id FROM supplier), u AS (SELECT k, min(id) AS id FROM a GROUP BY k HAVING count(DISTINCT id) = 1)
SELECT ' file ' || n_nationkey AS filename, coalesce(id, '') AS attachment_id FROM nation LEFT JOIN u ON k = 'file ' || n_nationkey""")
def media_by_filename(spark, sf_dir):
    i = F.col("s_suppkey")
    name = F.concat(F.lit("File "), F.when(i % 3 == 0, i % 40).otherwise(i).cast("string"))
    attachments = ws.table(spark, sf_dir, "supplier").select(name.alias("filename"), F.concat(F.lit("s"), i.cast("string")).alias("attachment_id"))
    return links.media_by_filename(ws.table(spark, sf_dir, "nation").select(F.concat(F.lit(" file "), F.col("n_nationkey").cast("string")).alias("filename")), attachments)


@register("""WITH a AS (SELECT doc_id % 500 AS page_id, 'a/' || doc_id || '.md' AS path, 0 AS k FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id % 500, '0/' || doc_id || '.md', 1 FROM documents WHERE doc_id % 2 = 0)
SELECT page_id, arg_min(path, (k, path)) AS path FROM a GROUP BY page_id""")
def index_merge(spark, sf_dir):
    docs = ws.table(spark, sf_dir, "documents").withColumn("page_id", F.col("doc_id") % 500)
    at = lambda d: F.concat(F.lit(f"{d}/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    return links.merge_indexes(docs.where("doc_id % 3 = 0").select("page_id", at("a")), docs.where("doc_id % 2 = 0").select("page_id", at("0")))


# Rules


@register("SELECT page_id, array_to_string(list_sort(list_distinct(list(path))), ',') AS paths FROM (SELECT (doc_id % 900)::VARCHAR AS page_id, source || '/' || doc_id AS path FROM documents) GROUP BY page_id HAVING count(DISTINCT path) > 1")
def duplicate_ids(spark, sf_dir):
    rows = ws.table(spark, sf_dir, "documents").select((F.col("doc_id") % 900).cast("string").alias("page_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return lint.duplicate_ids(rows).select("page_id", F.array_join("paths", ",").alias("paths"))


@register("""WITH d AS (SELECT DISTINCT source || '/' || lang AS directory, lang AS title FROM documents WHERE source || '/' || lang <> 'src1/en')
SELECT title, array_to_string(list_sort(list(directory)), ',') AS directories FROM d GROUP BY title HAVING count(*) > 1""")
def duplicate_folder_titles(spark, sf_dir):
    docs = ws.table(spark, sf_dir, "documents")
    paths = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    index = spark.range(1).select(F.lit("src1/en/en.md").alias("path"))
    return lint.duplicate_folder_titles(paths.unionByName(index)).select("title", F.array_join("directories", ",").alias("directories"))


@register("""WITH p AS (SELECT source || '/doc-' || doc_id || '.md' AS path, source AS d, lower(lang || doc_id % 30) AS t FROM documents)
SELECT a.path, min(b.path) AS other FROM p a JOIN p b ON a.d = b.d AND a.t = b.t AND a.path <> b.path GROUP BY a.path""")
def sibling_title_conflict(spark, sf_dir):
    title = F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), (F.col("doc_id") % 30).cast("string"))
    return lint.sibling_titles(ws.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), title.alias("title")))


@register("SELECT 'a/doc-' || doc_id || '.md' AS path FROM documents WHERE doc_id % 9 = 0")
def hierarchy_lint(spark, sf_dir):
    docs = ws.table(spark, sf_dir, "documents")
    at = lambda end: F.concat(F.lit("a/doc-"), F.col("doc_id").cast("string"), F.lit(end)).alias("path")
    return lint.hierarchy_issues(docs.select(at(".md")).unionByName(docs.where("doc_id % 9 = 0").select(at("/child.md"))))


_PAGES = """p AS (SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN '' ELSE doc_id::VARCHAR END AS id, doc_id % 4 AS version, ['Archived', 'draft', '', ' Current ', 'current'][(doc_id % 5 + 1)::INTEGER] AS state, doc_id FROM documents)"""


def _pages(spark, sf_dir):
    i = F.col("doc_id")
    state = F.get(F.array(*[F.lit(s) for s in ("Archived", "draft", "", " Current ", "current")]), (i % 5).cast("int"))
    marks = F.array_compact(F.array(F.col("lang"), F.when(i % 7 == 0, "two words"), F.when(i % 11 == 0, " ")))
    return ws.table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), i.cast("string")).alias("path"), F.when(i % 6 == 0, "").otherwise(i.cast("string")).alias("id"), (i % 4).alias("version"), state.alias("state"), marks.alias("labels"), "doc_id")


@register(f"""WITH {_PAGES} SELECT path, 'version' AS field, 'invalid' AS code FROM p WHERE id <> '' AND version = 0 UNION ALL SELECT path, 'state', 'invalid' FROM p WHERE lower(trim(state)) NOT IN ('', 'current', 'draft')
UNION ALL SELECT path, 'labels', 'empty' FROM p WHERE doc_id % 11 = 0 UNION ALL SELECT path, 'labels', 'invalid' FROM p WHERE doc_id % 7 = 0""")
def validate_schema(spark, sf_dir):
    return lint.schema_issues(_pages(spark, sf_dir))


@register(f"""WITH {_PAGES}, b AS (SELECT path, CASE WHEN doc_id % 8 = 0 THEN 'x' || doc_id ELSE id END AS id, '' AS state FROM p)
SELECT p.path, 'id' AS field, 'immutable' AS code FROM p JOIN b USING (path) WHERE b.id <> '' AND b.id <> p.id UNION ALL SELECT path, 'state', 'immutable' FROM p WHERE id <> '' AND lower(trim(state)) = 'draft'""")
def validate_immutable(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    baseline = pages.select("path", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("id")).alias("id"), F.lit("").alias("state"))
    return lint.immutable_issues(pages, baseline)


_DOCTOR = """s AS (SELECT 'd/' || doc_id || '.md' AS path, CASE WHEN doc_id % 17 = 0 THEN '' ELSE doc_id::VARCHAR END AS page_id FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT 'd/' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS page_id, doc_id FROM documents WHERE doc_id % 7 <> 0),
found AS (
  SELECT s.path, CASE WHEN s.page_id = '' THEN 'empty-index-entry' WHEN f.path IS NULL THEN 'missing-file' WHEN f.page_id <> s.page_id THEN 'id-mismatch' END AS kind FROM s LEFT JOIN f USING (path)
  UNION ALL SELECT path, 'conflict-markers' FROM f WHERE doc_id % 19 = 0 UNION ALL SELECT path, 'unknown-media-placeholder' FROM f WHERE doc_id % 23 = 0
  UNION ALL SELECT path, 'embedded-content-placeholder' FROM f WHERE doc_id % 29 = 0 UNION ALL SELECT path, 'untracked-id' FROM f WHERE page_id NOT IN (SELECT page_id FROM s))"""


def _doctor(spark, sf_dir):
    i = F.col("doc_id")
    docs = ws.table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d/"), i.cast("string"), F.lit(".md")))
    state = docs.where("doc_id % 5 <> 0").select("path", F.when(i % 17 == 0, "").otherwise(i.cast("string")).alias("page_id"))
    body = F.concat(F.when(i % 19 == 0, "a\n  <<<<<<< mine\n").otherwise(""), F.when(i % 23 == 0, "UNKNOWN_MEDIA_ID").otherwise(""), F.when(i % 29 == 0, "[Embedded content]").otherwise("plain"))
    files = docs.where("doc_id % 7 <> 0").select("path", F.when(i % 13 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string")).alias("page_id"), body.alias("body"))
    return state, files


@register(f"WITH {_DOCTOR} SELECT path, kind, CASE WHEN kind IN ('empty-index-entry', 'missing-file', 'id-mismatch', 'conflict-markers') THEN 'error' ELSE 'warning' END AS severity, kind IN ('empty-index-entry', 'missing-file', 'untracked-id') AS repairable FROM found WHERE kind IS NOT NULL")
def doctor_report(spark, sf_dir):
    return lint.sorted_issues(lint.doctor(*_doctor(spark, sf_dir)))


@register(f"WITH {_DOCTOR}, live AS (SELECT * FROM s WHERE page_id <> '' AND path IN (SELECT path FROM f)) SELECT path, page_id FROM live UNION ALL SELECT path, page_id FROM f WHERE page_id NOT IN (SELECT page_id FROM live)")
def doctor_repair(spark, sf_dir):
    return lint.repaired_state(*_doctor(spark, sf_dir))


_CODES = "['CROSS_SPACE_LINK_PRESERVED', 'unresolved_reference', 'STRICT_PATH_REFERENCE_BROKEN', 'PAGE_PATH_MOVED', 'LABELS_FETCH_FAILED', 'other']"


@register(f"""WITH d AS (SELECT {_CODES}[(event_id % 6 + 1)::INTEGER] AS code FROM events)
SELECT code, CASE code WHEN 'CROSS_SPACE_LINK_PRESERVED' THEN 'preserved_external_link' WHEN 'unresolved_reference' THEN 'degraded_reference' WHEN 'STRICT_PATH_REFERENCE_BROKEN' THEN 'blocking_reference' WHEN 'PAGE_PATH_MOVED' THEN 'path_change' ELSE 'degraded_content' END AS category,
  code IN ('unresolved_reference', 'STRICT_PATH_REFERENCE_BROKEN') AS action_required, count(*) AS n FROM d GROUP BY ALL""")
def diagnostic_categories(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in (*lint.DIAGNOSTICS, "LABELS_FETCH_FAILED", "other")])
    rows = ws.table(spark, sf_dir, "events").select(F.get(codes, (F.col("event_id") % 6).cast("int")).alias("code"))
    category, action = lint.diagnostic_category(F.col("code"))
    return rows.select("code", category.alias("category"), action.alias("action_required")).groupBy("code", "category", "action_required").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS "add", CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE '' END AS remove FROM documents""")
def label_sync(spark, sf_dir):
    i = F.col("doc_id")
    local = F.array_compact(F.array(F.upper("lang"), F.when(i % 2 == 0, F.col("source"))))
    remote = F.array_compact(F.array("lang", F.when(i % 3 == 0, "old")))
    found = lint.label_sync(ws.table(spark, sf_dir, "documents").select(i.alias("page_id"), local.alias("local"), remote.alias("remote")))
    return found.select("page_id", F.array_join("add", ",").alias("add"), F.array_join("remove", ",").alias("remove"))


@register("SELECT doc_id AS page_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'state' END, CASE WHEN doc_id % 5 = 0 THEN 'labels' END) AS drift FROM documents")
def metadata_drift(spark, sf_dir):
    i = F.col("doc_id")
    rows = ws.table(spark, sf_dir, "documents").select(
        i.alias("page_id"),
        F.lit("draft").alias("local_state"),
        F.when(i % 2 == 0, "current").otherwise("draft").alias("remote_state"),
        F.col("lang").alias("local_status"),
        F.col("lang").alias("remote_status"),
        text.labels(F.array("lang")).alias("local_labels"),
        text.labels(F.when(i % 5 == 0, F.array("lang", "source")).otherwise(F.array("lang"))).alias("remote_labels"),
    )
    return lint.metadata_drift(rows).select("page_id", F.array_join("drift", ",").alias("drift"))


# Plans


def _assets(spark, sf_dir, rest: str = "true"):
    i = F.col("page_id")
    rows = ws.table(spark, sf_dir, "pages").where(rest)
    owner = (i % 40).cast("string")
    return rows.select(owner.alias("page_id"), F.concat(F.lit("a"), i.cast("string")).alias("attachment_id"), F.concat(F.lit("assets/"), owner, F.lit("/a"), i.cast("string"), F.lit(".png")).alias("path"))


@register("SELECT 'assets/' || (page_id % 40) || '/a' || page_id || '.png' AS path FROM pages WHERE (page_id % 40) % 2 = 0 AND page_id % 3 <> 0")
def stale_attachments(spark, sf_dir):
    every = _assets(spark, sf_dir)
    return planning.stale_attachments(every.select("path", "attachment_id"), _assets(spark, sf_dir, "page_id % 3 = 0"), every.where("page_id % 2 = 0"))


@register("""WITH a AS (SELECT page_id AS i, (page_id % 40)::VARCHAR AS o, 'assets/' || (page_id % 40) || '/a' || page_id || '.png' AS path FROM pages),
c AS (SELECT DISTINCT 'p' || o || '.md' AS path, CASE WHEN o::INT % 5 = 0 THEN '' ELSE o END AS page_id, o FROM a WHERE o::INT < 20)
SELECT 'upload' AS action, a.path FROM a JOIN c ON a.o = c.o WHERE c.page_id <> '' AND i % 3 = 0 AND i % 4 <> 0
UNION ALL SELECT 'upload', 'x/a' || i || '.png (new page: ' || c.path || ')' FROM a JOIN c ON a.o = c.o WHERE c.page_id = '' AND i % 3 = 0
UNION ALL SELECT 'delete', a.path FROM a JOIN c ON a.o = c.o WHERE c.page_id <> '' AND i % 4 = 0 AND i % 3 <> 0""")
def attachment_plan(spark, sf_dir):
    every = _assets(spark, sf_dir)
    page = F.concat(F.lit("p"), "page_id", F.lit(".md"))
    changed = every.where("page_id < 20").select(page.alias("path"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("page_id")).alias("page_id")).distinct()
    used = _assets(spark, sf_dir, "page_id % 3 = 0").select(page.alias("path"), F.concat(F.lit("x/"), "attachment_id", F.lit(".png")).alias("asset"))
    return planning.attachment_plan(changed, used, _assets(spark, sf_dir, "page_id % 4 = 0").select("path", "attachment_id"))


@register("""WITH p AS (SELECT n_nationkey AS page_id, ['Rough', ' done ', 'Open', 'else', ''][(n_nationkey % 5 + 1)::INTEGER] AS status FROM nation)
SELECT page_id, status, CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 1 WHEN page_id % 5 IN (0, 1) THEN 2 WHEN page_id % 5 = 2 THEN 3 END AS state_id,
  CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 'page' WHEN page_id % 5 IN (0, 1) THEN 'space' WHEN page_id % 5 = 2 THEN 'global' ELSE 'unresolved' END AS how FROM p WHERE status <> ''""")
def content_states(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in ("Rough", " done ", "Open", "else", "")])
    pages = ws.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), F.get(names, F.col("n_nationkey") % 5).alias("status"))
    own = pages.where("page_id % 2 = 0").select("page_id", F.lit("rough").alias("name"), F.lit(1).alias("state_id"))
    catalog = lambda *rows: spark.createDataFrame(rows, "name string, state_id int")
    return planning.content_states(pages, own, catalog(("Rough", 2), ("DONE", 2)), catalog(("open", 3), ("done", 9)))


@register("SELECT split_part(tag, '/', 3) AS space, arg_max(tag, (string_split(tag, '/')[-1], tag)) AS tag FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'sync/bad/' || user_id ELSE CASE WHEN event_id % 2 = 0 THEN 'sync/pull/S' ELSE 'sync/push/S' END || (user_id % 7) || '/' || strftime(ts, '%Y%m%d%H%M%S') END AS tag FROM events) WHERE len(string_split(tag, '/')) >= 4 GROUP BY 1")
def baseline_tags(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    good = F.concat(F.when(i % 2 == 0, "sync/pull/S").otherwise("sync/push/S"), (u % 7).cast("string"), F.lit("/"), F.date_format("ts", "yyyyMMddHHmmss"))
    return planning.baseline(ws.table(spark, sf_dir, "events").select(F.when(i % 9 == 0, F.concat(F.lit("sync/bad/"), u.cast("string"))).otherwise(good).alias("tag")))


@register("SELECT s_suppkey AS page_id, 'u' || (s_suppkey % 30) AS author, CASE WHEN s_suppkey % 30 < 25 AND s_suppkey % 30 % 4 <> 0 THEN n_name ELSE 'u' || (s_suppkey % 30) END AS display_name FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 30")
def display_names(spark, sf_dir):
    users = ws.table(spark, sf_dir, "nation").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("user_id"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.col("n_name")).alias("display_name"))
    pages = ws.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("u"), (F.col("s_suppkey") % 30).cast("string")).alias("author"))
    return planning.display_names(pages, users, "author")


@register("SELECT 'f' || c_custkey AS file_id, coalesce((SELECT max('a' || s_suppkey) FROM supplier WHERE s_suppkey % 50 = c_custkey), 'f' || c_custkey) AS attachment_id FROM customer")
def media_by_file(spark, sf_dir):
    key = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    attachments = ws.table(spark, sf_dir, "supplier").select(key("f", F.col("s_suppkey") % 50).alias("file_id"), key("a", F.col("s_suppkey")).alias("attachment_id"))
    return planning.media_by_file(ws.table(spark, sf_dir, "customer").select(key("f", F.col("c_custkey")).alias("file_id")), attachments)


@register(f"WITH {_FEED} SELECT 'p/' || l.page_id || '.md' AS path, CASE WHEN r.page_id IS NULL THEN 'missing' WHEN r.page_id % 8 = 0 THEN 'archived' ELSE 'remote_ahead' END AS error FROM local l LEFT JOIN (SELECT * FROM remote WHERE page_id % 10 <> 0) r ON l.page_id = r.page_id WHERE l.page_id % 6 <> 0 AND (r.page_id IS NULL OR r.page_id % 8 = 0 OR r.version > l.version)")
def push_conflicts(spark, sf_dir):
    _, remote, local = _feed(spark, sf_dir)
    i = F.col("page_id")
    code = F.when(i % 6 == 0, "D").otherwise("M")
    changed = local.select(F.concat(F.lit("p/"), i.cast("string"), F.lit(".md")).alias("path"), code.alias("code"), i.cast("string").alias("page_id"), "version")
    there = remote.where("page_id % 10 <> 0").select(i.cast("string").alias("page_id"), F.when(i % 8 == 0, " Archived").otherwise("current").alias("status"), "version")
    return planning.push_conflicts(changed, there)


@register("SELECT event_type AS capability, CASE WHEN bool_or(user_id % 150 = 149 AND event_type <> 'view') THEN 'degraded' ELSE 'full' END AS mode FROM events GROUP BY 1")
def capability_modes(spark, sf_dir):
    answer = F.when((F.col("user_id") % 150 == 149) & (F.col("event_type") != "view"), 405).otherwise(500)
    return planning.capability_modes(ws.table(spark, sf_dir, "events").select(F.col("event_type").alias("capability"), answer.alias("status")))


@register("SELECT user_id AS run, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS modes FROM events WHERE event_type <> 'click' GROUP BY 1")
def fallback_modes(spark, sf_dir):
    rows = ws.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("mode"))
    return planning.fallback_modes(rows)


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 4)::INTEGER END AS nodes FROM events")
def top_level_nodes(spark, sf_dir):
    nodes = F.array_join(F.array_repeat(F.lit('{"type":"paragraph"}'), (F.col("event_id") % 4).cast("int")), ",")
    body = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit('{"type":"doc","content":['), nodes, F.lit("]}")))
    return ws.table(spark, sf_dir, "events").select("event_id", planning.top_level_nodes(body).alias("nodes"))


@register(f"""WITH {_PATHS} SELECT p.path, CASE WHEN p.path LIKE 'ASIA/%' THEN 'asia' ELSE '' END AS parent, regexp_replace(p.path, '[^/]*$', '') || 'New-' || p.page_id || '.md' AS target, 2 * count(*) AS uploads
FROM (SELECT path, min(page_id) AS page_id FROM page_paths WHERE page_id LIKE 's%' GROUP BY path) p GROUP BY p.path, p.page_id""")
def create_preview(spark, sf_dir):
    planned = hierarchy.planned_paths(ws.nodes(spark, sf_dir)).where("page_id LIKE 's%'").groupBy("path").agg(F.min("page_id").alias("page_id"))
    pages = planned.select("path", F.concat(F.lit("New "), "page_id").alias("title"))
    index = spark.createDataFrame([("ASIA", "asia")], "directory string, id string")
    return planning.create_preview(pages, index, pages.select("path").unionAll(pages.select("path")))


# Assets of Markdown

_BODIES = """bodies AS (SELECT doc_id AS i, source AS s, source || '/doc-' || doc_id || '.md' AS path, doc_id::VARCHAR AS page_id, 'f' || (doc_id % 7) || '.png' AS f, 'x' || (doc_id % 5) || '.pdf' AS x FROM documents),
files AS (SELECT DISTINCT source || '/f' || (doc_id % 6) || '.png' AS path FROM documents UNION SELECT DISTINCT 'x' || (doc_id % 4) || '.pdf' FROM documents),
known AS (SELECT b.*, f.path IS NOT NULL AS has_f, g.path IS NOT NULL AS has_x FROM bodies b LEFT JOIN files f ON f.path = s || '/' || f LEFT JOIN files g ON g.path = x)"""


def _bodies(spark, sf_dir):
    """Pages with references made of the documents' ids, and the files that exist."""
    docs, i = ws.table(spark, sf_dir, "documents"), F.col("doc_id")
    n = lambda k: (i % k).cast("string")
    body = F.concat(F.lit("![p](f"), n(7), F.lit('.png "T") and [q](../x'), n(5), F.lit(".pdf#a) `[n](f0.png)` [m](o.md) [w](https://h/"), i.cast("string"), F.lit(")"))
    pages = docs.select(F.concat("source", F.lit("/doc-"), i.cast("string"), F.lit(".md")).alias("path"), i.cast("string").alias("page_id"), body.alias("body"))
    files = docs.select(F.concat("source", F.lit("/f"), n(6), F.lit(".png")).alias("path")).union(docs.select(F.concat(F.lit("x"), n(4), F.lit(".pdf"))))
    return pages, files.distinct()


@register(f"WITH {_BODIES} SELECT path, 0 AS at, s || '/' || f AS target, CASE WHEN has_f THEN '' ELSE 'missing' END AS issue FROM known UNION ALL SELECT path, 1, x, CASE WHEN has_x THEN '' ELSE 'missing' END FROM known")
def asset_references(spark, sf_dir):
    pages, files = _bodies(spark, sf_dir)
    return assets.references(pages, files).select("path", "at", "target", "issue")


_TAIL = "' `[n](f0.png)` [m](o.md) [w](https://h/' || i || ')'"


@register(f"""WITH {_BODIES} SELECT path, CASE WHEN has_f AND has_x THEN '![p](../assets/' || i || '/' || f || ' "T") and [q](../assets/' || i || '/' || x || ')' ELSE '![p](' || f || ' "T") and [q](../' || x || '#a)' END || {_TAIL} AS body,
CASE WHEN has_f AND has_x THEN s || '/' || f || '>assets/' || i || '/' || f || ',' || x || '>assets/' || i || '/' || x ELSE '' END AS moves FROM known""")
def asset_moves(spark, sf_dir):
    pages, files = _bodies(spark, sf_dir)
    moves = F.transform("moves", lambda m: F.concat(m.source, F.lit(">"), m.target))
    return assets.move_plan(pages, files).select("path", "body", F.array_join(moves, ",").alias("moves"))


@register(f"""WITH {_BODIES} SELECT path, CASE WHEN has_f AND has_x THEN '[' || f || ']{{.media-inline media-id="' || CASE WHEN f IN ('f1.png', 'f4.png') THEN 'at-' || f ELSE 'pending-attachment-' || s || '-' || f END || '" media-type="image"}} and [' || x || ']{{.media-inline media-id="pending-attachment-' || x || '" media-type="file"}}'
ELSE '![p](' || f || ' "T") and [q](../' || x || '#a)' END || {_TAIL} AS body FROM known""")
def asset_spans(spark, sf_dir):
    pages, files = _bodies(spark, sf_dir)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    ids = files.where(name.isin("f1.png", "f4.png")).select("path", F.concat(F.lit("at-"), name).alias("attachment_id"))
    return assets.inline_media(pages.select("path", "body"), files, ids)


@register(f"""WITH {_BODIES} SELECT path, CASE WHEN i % 11 = 0 THEN 'read_error' ELSE 'conversion_error' END AS code,
CASE WHEN i % 22 = 0 THEN 'not readable as UTF-8' WHEN i % 11 = 0 THEN 'missing frontmatter' WHEN NOT has_f THEN 'missing: ' || s || '/' || f WHEN NOT has_x THEN 'missing: ' || x ELSE 'unresolved: ' || s || '/o.md' END AS message
FROM known WHERE i % 11 = 0 OR NOT has_f OR NOT has_x OR s = 'src1'""")
def validate_files(spark, sf_dir):
    """Files whose bytes are no text, whose frontmatter is missing, or whose references and links are at fault."""
    pages, files = _bodies(spark, sf_dir)
    i = F.col("page_id").cast("long")
    head = F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("---\ntitle: T\nid: "), "page_id", F.lit("\n---\n")))
    content = F.concat(F.when(i % 22 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.concat(head, "body").cast("binary"))
    documents = ws.read_documents(pages.select("path", content.alias("content")), ws.SCANS["validate"])
    targets = ws.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/o.md")).alias("path"), F.lit("1").alias("page_id")).distinct()
    here = F.col("path") != "src1/o.md"
    return lint.file_issues(documents, files, targets.where(here & (F.col("path") < "src3")), targets.where(here))


# Recovery


_RUNS = """runs AS (SELECT DISTINCT user_id AS i, 'S' || (user_id % 5) AS s, 't' || user_id AS t FROM events),
branches AS (SELECT 'sync/' || s || '/' || t AS name, i FROM runs WHERE i % 2 = 0 UNION ALL SELECT 'sync/odd' || i, i FROM runs WHERE i % 30 = 1),
snapshots AS (SELECT 'refs/sync/snapshots/' || s || '/' || t AS ref, i FROM runs WHERE i % 3 = 0)"""


def _runs(spark, sf_dir):
    """Branches, snapshots, worktrees, removable worktrees and metadata of runs, made of the events' users."""
    i = F.col("i")
    runs = ws.table(spark, sf_dir, "events").select(F.col("user_id").alias("i")).distinct()
    runs = runs.withColumns({"space_key": F.concat(F.lit("S"), (i % 5).cast("string")), "time": F.concat(F.lit("t"), i.cast("string"))})
    name, path = F.concat_ws("/", F.lit("sync"), "space_key", "time"), F.concat(F.lit("w"), i.cast("string"))
    odd = runs.where("i % 30 = 1").select(F.concat(F.lit("sync/odd"), i.cast("string")).alias("name"))
    branches = runs.where("i % 2 = 0").select(name.alias("name")).unionByName(odd)
    snapshots = runs.where("i % 3 = 0").select(F.concat_ws("/", F.lit(recovery.SNAPSHOTS), "space_key", "time").alias("ref"))
    worktrees = runs.where("i % 4 = 0").select(path.alias("path"), name.alias("branch"), (i % 8 == 0).alias("there"))
    removable = runs.where("i % 16 = 0").select(path.alias("path"))
    text_ = F.when(i % 10 == 0, " ").otherwise(F.concat(F.lit("f"), i.cast("string")))
    metadata = runs.where("i % 5 = 0").select("space_key", "time", F.concat(F.lit("b"), i.cast("string")).alias("sync_branch"), F.concat(F.lit("r"), i.cast("string")).alias("snapshot_ref"), text_.alias("failure_reason"), F.lit("main").alias("original_branch"))
    return branches, snapshots, worktrees, removable, metadata


@register(f"""WITH {_RUNS}, b AS (SELECT name, i, CASE WHEN name = 'sync/S1/t6' THEN '{recovery.ON_HEAD}' WHEN name LIKE 'sync/odd%' THEN '{recovery.UNMANAGED}' WHEN i % 8 = 0 AND i % 16 <> 0 THEN 'linked worktree remains at w' || i ELSE '' END AS reason FROM branches)
SELECT 'branch' AS kind, name, CASE WHEN reason = '' THEN 'delete' ELSE 'keep' END AS action, reason, CASE WHEN reason = '' THEN coalesce(ref, '') ELSE '' END AS snapshot FROM b LEFT JOIN snapshots z ON z.i = b.i AND name NOT LIKE 'sync/odd%'
UNION ALL SELECT 'snapshot', ref, CASE WHEN k THEN 'keep' ELSE 'delete' END, CASE WHEN k THEN 'its branch is kept' ELSE '' END, '' FROM (SELECT ref, EXISTS (SELECT 1 FROM b WHERE b.i = z.i AND name NOT LIKE 'sync/odd%' AND reason <> '') AS k FROM snapshots z)""")
def clean_plan(spark, sf_dir):
    branches, snapshots, worktrees, removable, _ = _runs(spark, sf_dir)
    return recovery.clean_plan(branches, snapshots, worktrees, removable, "sync/S1/t6")


@register(f"""WITH {_RUNS} SELECT s AS space_key, t AS time, CASE WHEN i % 2 = 0 OR i % 3 = 0 THEN 'sync/' || s || '/' || t ELSE 'b' || i END AS branch, CASE WHEN i % 3 = 0 THEN 'refs/sync/snapshots/' || s || '/' || t WHEN i % 5 = 0 THEN 'r' || i ELSE '' END AS snapshot,
CASE WHEN i % 5 = 0 AND i % 10 <> 0 THEN 'f' || i ELSE '' END AS failure, CASE WHEN i % 5 = 0 THEN 'main' ELSE '' END AS original,
CASE WHEN i = 6 THEN '{recovery.ON_HEAD}' WHEN i % 8 = 0 THEN 'linked worktree remains at w' || i ELSE 'safe to discard' END AS status FROM runs WHERE i % 2 = 0 OR i % 3 = 0 OR i % 5 = 0""")
def recovery_runs(spark, sf_dir):
    branches, snapshots, worktrees, _, metadata = _runs(spark, sf_dir)
    return recovery.recovery_runs(branches, snapshots, worktrees, metadata, "sync/S1/t6")


# Incremental maintenance


@register(f"""WITH {_DOCS} SELECT path, CASE WHEN page_id::BIGINT % 10 IN (3, 4) THEN 'new' ELSE 'old' END AS origin FROM doc_index WHERE page_id::BIGINT % 10 <> 5""")
def incremental_index(spark, sf_dir):
    index = ws.doc_index(spark, sf_dir).select("path", F.col("page_id").cast("long").alias("i"))
    before = index.where("i % 10 <> 3").select("path", F.lit("old").alias("origin"))
    changed = index.where("i % 10 IN (3, 4)").select("path", F.lit("new").alias("origin"))
    return search.delete_paths(search.upsert(before, changed), index.where("i % 10 = 5"))


@register(f"""WITH {_DOCS} SELECT path, title, CASE WHEN page_id::BIGINT % 10 IN (3, 4) THEN 'second' WHEN page_id::BIGINT % 10 = 6 THEN 'third' ELSE 'first' END AS origin
FROM doc_index WHERE page_id::BIGINT % 10 <> 5""")
def incremental_rebuild(spark, sf_dir):
    """What a stored index holds after a first build and two increments: the same as a full build of the last state."""
    index = ws.doc_index(spark, sf_dir).select("path", "title", F.col("page_id").cast("long").alias("i"))
    rows = lambda where, origin: index.where(where).select("path", "title", F.lit(origin).alias("origin"))
    table = incremental.KeyedTable(spark, lineage.folder(spark, "index"), "path")
    table.change(rows("i % 10 <> 3", "first"))
    table.change(rows("i % 10 IN (3, 4)", "second"))
    table.change(rows("i % 10 = 6", "third"), index.where("i % 10 = 5"))
    return table.read()


@register(f"""WITH {_FEED} SELECT page_id, coalesce(arg_min(space_key, seq) FILTER (space_key <> ''), '') AS space_key, coalesce(arg_min(title, seq) FILTER (title <> ''), '') AS title, max(version) AS version, max(last_modified) AS last_modified FROM change_feed GROUP BY page_id""")
def streamed_pages(spark, sf_dir):
    """Page state that a stream of the change feed leaves, the feed arriving in files: all five columns as in one batch."""
    feed, folder = ws.change_feed(spark, sf_dir), lineage.folder(spark, "stream")
    feed.repartition(4, "seq").write.parquet(f"{folder}/feed")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/feed").schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/feed")
    table = incremental.KeyedTable(spark, f"{folder}/pages", "page_id")
    incremental.follow_changes(stream, table, f"{folder}/checkpoint").awaitTermination()
    return table.read()


@register(None)
def markdown_links(spark, sf_dir):
    """Links of pages written as Markdown, found by the scanner and rewritten to relative paths."""
    rows = ws.page_links(spark, sf_dir).select(F.col("page_id").cast("string").alias("page"), F.concat(F.lit("["), "href", F.lit("]("), "href", F.lit("#x)")).alias("one"), "href")
    docs = rows.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("one")), "\n").alias("body"), F.map_from_entries(F.array_distinct(F.collect_list(F.struct("href", F.lit("b/t.md").alias("v"))))).alias("targets"))
    return links.rewrite(docs.select(F.concat(F.lit("a/"), "page", F.lit(".md")).alias("path"), "body", "targets")).select("path", "body", "converted")


@register(None)
def stemmed_terms(spark, sf_dir):
    return ws.table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(markup.parse_stems(F.col("text")))).alias("stems"))


FLAGSHIP = search_bm25_and
