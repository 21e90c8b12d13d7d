"""Page and folder trees: ancestor paths, unique names, moves, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import text
from tarnwell.operators.lineage import cut


def _named(title: Column, kind: Column, node: Column) -> Column:
    """A node's title; its kind and id if that is blank."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.concat(kind, F.lit("-"), node))


def _keys(nodes: DataFrame) -> tuple[Column, Column]:
    """A node's key and its parent's ('' without one). With a column parent_kind, parents are looked up among nodes of that
    kind (blank: the node's own); else by id alone."""
    parent = F.coalesce(F.trim("parent_id"), F.lit(""))
    if "parent_kind" not in nodes.columns:
        return F.col("id"), parent
    kind = F.coalesce(F.nullif(F.lower(F.trim("parent_kind")), F.lit("")), F.col("kind"))
    return F.concat("kind", F.lit(":"), "id"), F.when(parent == "", "").otherwise(F.concat(kind, F.lit(":"), parent))


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, title, kind, parents (titles from the root down) and complete (false: a parent is missing or a cycle; then without
    parents). Blank titles become kind-id. A tree may be of any depth.

    Every node points to an ancestor and holds the titles between; each round it takes over what that ancestor holds, so
    pointers double their reach and a checkpoint a round cuts the lineage. A node that meets itself is in a cycle; what leads
    there follows.
    """
    key, parent = _keys(nodes)
    none = F.array().cast("array<string>")
    title = _named(F.col("title"), F.col("kind"), F.col("id"))
    state = nodes.select(key.alias("key"), "id", title.alias("title"), "kind", parent.alias("next"), none.alias("parents"), none.alias("above"), F.lit(True).alias("complete"))
    state = cut(state)
    while state.where("next <> ''").limit(1).count():
        reached = state.select(F.col("key").alias("t_key"), *[F.col(c).alias(f"t_{c}") for c in ("title", "next", "parents", "above", "complete")])
        met = state.join(reached, state["next"] == reached["t_key"], "left")
        climbs = F.col("next") != ""
        above = F.concat("t_above", F.array("next"), "above")
        broken = climbs & (F.col("t_key").isNull() | ~F.col("t_complete") | F.array_contains(above, F.col("key")))
        state = cut(
            met.select(
                "key",
                "id",
                "title",
                "kind",
                F.when(~climbs | broken, "").otherwise(F.col("t_next")).alias("next"),
                F.when(broken, none).when(climbs, F.concat("t_parents", F.array("t_title"), "parents")).otherwise(F.col("parents")).alias("parents"),
                F.when(broken, none).when(climbs, above).otherwise(F.col("above")).alias("above"),
                (F.col("complete") & ~broken).alias("complete"),
            )
        )
    return state.select("id", "title", "kind", "parents", "complete")


def _with_children(nodes: DataFrame) -> DataFrame:
    """id, kind and has_children of every node."""
    key, parent = _keys(nodes)
    parents = nodes.select(parent.alias("_key"), F.lit(True).alias("has")).where("_key <> ''").distinct()
    return nodes.select("id", "kind", key.alias("_key")).join(parents, "_key", "left").select("id", "kind", F.coalesce("has", F.lit(False)).alias("has_children"))


def has_children(nodes: DataFrame) -> DataFrame:
    return _with_children(nodes).drop("kind")


def planned_paths(nodes: DataFrame) -> DataFrame:
    """page_id and path of every page: below its ancestors' directories; a page with children is <dir>/<dir>.md."""
    pages = ancestors(nodes).where("kind = 'page'").join(_with_children(nodes), ["id", "kind"])
    folder = F.array_join(F.transform("parents", text.path_segment), "/")
    name = text.path_segment(F.col("title"))
    own = F.when(F.col("has_children"), F.concat_ws("/", name, F.concat(name, F.lit(".md")))).otherwise(text.markdown_name(F.col("title")))
    return pages.select(F.col("id").alias("page_id"), F.when(folder == "", own).otherwise(F.concat_ws("/", folder, own)).alias("path"))


def folder_paths(nodes: DataFrame) -> DataFrame:
    folders = ancestors(nodes).where("kind = 'folder'")
    return folders.select(F.col("id").alias("folder_id"), F.array_join(F.transform(F.concat("parents", F.array("title")), text.path_segment), "/").alias("path"))


def unique_paths(planned: DataFrame) -> DataFrame:
    """``planned`` (page_id, path) with repeated paths numbered -2, -3... by page_id.

    Exact as long as no numbered name is another page's own name; allocate_paths() handles that too.
    """
    rank = F.row_number().over(Window.partitionBy("path").orderBy("page_id"))
    numbered = F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit("-"), rank.cast("string"), F.lit(".md"))
    return planned.withColumn("rank", rank).select("page_id", F.when(F.col("rank") > 1, numbered).otherwise(F.col("path")).alias("path"))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with the long column ``name``: 1, 2, 3... by ``order`` within each value of ``group``.

    No group is brought together, as one may hold most rows: rows are sorted by ranges, numbered within range and group, and
    each such block starts where the group's earlier ones end. A group has at most as many blocks as there are ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in (*group, *order)]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = cut(placed.withColumns({"_block": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy("_at"))
    rows = placed.withColumn("_inside", inside).join(starts, [*group, "_block"])
    return rows.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_block", "_at", "_start", "_inside")


def allocate_paths(planned: DataFrame) -> DataFrame:
    """As unique_paths(), skipping names that are taken: pages go by (path, page_id), the first of a path keeps it, and the others
    take the least numbers from 2 that no earlier page's name has.

    ``a-2.md`` stands before ``a.md``, so the numbers that ``a.md`` can't give are those of pages whose own path is ``a-<number>.md``:
    given ones are never among them. A page's number is therefore its place among the repeats and the taken numbers of its
    path, a taken number standing behind as many repeats as there are free numbers below it. Paths end in ``.md``.
    """
    pages = ranked(planned.select("page_id", "path"), ["path"], ["page_id"], "rank")
    repeated = pages.where("rank = 2").select("path")
    named = F.regexp_extract("path", r"^(.*)-[1-9][0-9]{0,17}\.md$", 1)
    number = F.regexp_extract("path", r"-([1-9][0-9]{0,17})\.md$", 1).try_cast("long")
    taken = planned.select(F.concat(named, F.lit(".md")).alias("of"), number.alias("number")).where("number >= 2").distinct()
    taken = taken.withColumnRenamed("of", "path").join(repeated, "path", "left_semi")
    taken = ranked(taken, ["path"], ["number"], "rank").select("path", (F.col("number") - F.col("rank") - 1).alias("behind"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("page_id"))
    again = pages.where("rank > 1").select("path", (F.col("rank") - 1).alias("behind"), F.lit(0).alias("kind"), "page_id")
    given = ranked(again.unionByName(taken), ["path"], ["behind", "kind", "page_id"], "place").where("kind = 0")
    name = F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit("-"), (F.col("place") + 1).cast("string"), F.lit(".md"))
    return pages.where("rank = 1").select("page_id", "path").unionByName(given.select("page_id", name.alias("path")))


def path_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("page_id", F.col("path").alias("previous")).join(after.select("page_id", F.col("path").alias("planned")), "page_id").where("previous <> planned")


def gone_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old paths that no new path takes; a change of case alone is no change."""
    return before.select("path", F.lower("path").alias("_k")).join(after.select(F.lower("path").alias("_k")), "_k", "left_anti").select("path")


def directories(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _above(rows: DataFrame) -> DataFrame:
    inside = rows.where(F.instr("path", "/") > 0)
    return inside.withColumn("directory", F.explode(directories(F.col("path"))))


def nearest_parents(pages: DataFrame, index: DataFrame) -> DataFrame:
    """For each of ``pages`` (path): the id of the nearest directory above it that ``index`` (directory, id) knows."""
    # a directory's own index page looks further up
    candidates = _above(pages).where(F.col("path") != F.concat("directory", F.lit("/"), F.element_at(F.split("directory", "/"), -1), F.lit(".md")))
    found = candidates.join(index, "directory").groupBy("path").agg(F.max_by("id", F.length("directory")).alias("parent"))
    return pages.select("path").join(found, "path", "left").select("path", F.coalesce("parent", F.lit("")).alias("parent"))


def push_order(changes: DataFrame) -> DataFrame:
    """Place of each change: shallow first, a directory's index page before its other pages, then path, then code."""
    parts = F.split("path", "/")
    is_index = F.coalesce(F.element_at(parts, -1) == F.concat(F.get(parts, F.size(parts) - 2), F.lit(".md")), F.lit(False))
    rows = changes.withColumns({"depth": F.size(parts), "is_index": is_index})
    return rows.orderBy("depth", F.desc("is_index"), "path", "code")
