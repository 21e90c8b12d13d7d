"""Scans of a workspace of Markdown files, its state files, and adapters from the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions import markup, text


@dataclass(frozen=True)
class ScanRule:
    """Which files a scan takes. The scans differ, and results with them."""

    any_case: bool = True  # '.MD' counts
    skip_assets: bool = True
    skip_hidden: bool = True
    on_error: str = "skip"  # of a file that isn't text or has no valid frontmatter: skip it, keep its row, or abort the scan


#: Scans by what they are for.
SCANS = {
    "search": ScanRule(),
    "page_index": ScanRule(any_case=False),
    "global_index": ScanRule(),
    "titles": ScanRule(),
    "local_ids": ScanRule(),
    "validate": ScanRule(any_case=False, on_error="row"),
    "relink": ScanRule(any_case=False, skip_assets=False, on_error="abort"),
    "hierarchy": ScanRule(skip_assets=False, on_error="row"),
    "orphans": ScanRule(),
    "diff": ScanRule(any_case=False, on_error="row"),
}


def takes(path: Column, rule: ScanRule) -> Column:
    """Whether a relative path is scanned."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    name = F.lower(path) if rule.any_case else path
    fits = name.endswith(".md")
    if rule.skip_assets:
        fits = fits & ~F.array_contains(folders, "assets")
    if rule.skip_hidden:
        fits = fits & ~F.exists(folders, lambda d: F.startswith(d, F.lit(".")))
    return fits


def scan(spark: SparkSession, root: str, rule: ScanRule, modified_after: str | None = None) -> DataFrame:
    """path (below ``root``), content, mod_time of the files that ``rule`` takes; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        files = files.option("modifiedAfter", modified_after)
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    found = files.load(root).select(relative.alias("path"), F.col("modificationTime").alias("mod_time"), "content")
    return found.where(takes(F.col("path"), rule)).withColumn("content", F.decode("content", "UTF-8"))


def documents(files: DataFrame) -> DataFrame:
    """``files`` with the struct fm (fields, body, error)."""
    return files.withColumn("fm", markup.parse_frontmatter(F.col("content")))


def read_documents(files: DataFrame, rule: ScanRule) -> DataFrame:
    """path, fm and error of ``files`` (path, content: bytes) as ``rule`` wants it: error is '', or why the file can't be read (it
    isn't UTF-8, or its frontmatter is at fault); such files are left out, kept as rows, or end the job where they are met."""
    raw = F.col("content").cast("binary").cast("string")
    rows = files.withColumn("_text", F.when(F.is_valid_utf8(raw), raw)).withColumn("fm", markup.parse_frontmatter(F.col("_text")))
    error = F.when(F.col("content").isNull() | F.col("_text").isNull(), "not readable as UTF-8").otherwise(F.coalesce("fm.error", F.lit("")))
    rows = rows.select("path", "fm", error.alias("error"))
    if rule.on_error == "skip":
        return rows.where("error = ''")
    if rule.on_error == "abort":
        stop = F.raise_error(F.concat("path", F.lit(": "), "error"))
        return rows.withColumn("error", F.when(F.col("error") == "", F.col("error")).otherwise(stop.cast("string")))
    return rows


def index_rows(files: DataFrame, space: str) -> DataFrame:
    """Search rows of parsed ``files``: one page each, one row per section, one per code block; broken files give none."""
    rows = documents(files).where("fm.error IS NULL").withColumn("parsed", markup.parse_structure(F.col("fm.body")))
    path = F.concat(F.lit(f"{space}/"), F.col("path"))
    shared = [
        path.alias("path"),
        F.coalesce("fm.id", F.lit("")).alias("page_id"),
        text.local_title(F.coalesce("fm.title", F.lit("")), F.col("fm.body"), F.col("path")).alias("title"),
        F.lit(space).alias("space_key"),
        text.labels(F.col("fm.labels")).alias("labels"),
        "mod_time",
        F.coalesce("fm.created_by", F.lit("")).alias("created_by"),
        text.stored_date(F.coalesce("fm.created_at", F.lit(""))).alias("created_at"),
        F.coalesce("fm.updated_by", F.lit("")).alias("updated_by"),
        text.stored_date(F.coalesce("fm.updated_at", F.lit(""))).alias("updated_at"),
    ]
    blank = F.lit("")
    none = F.array().cast("array<string>")

    def kind(frame: DataFrame, name: str, content: Column, heading_path: Column, heading: Column, level: Column, language: Column, line: Column) -> DataFrame:
        suffix = F.lit("") if name == "page" else F.concat(F.lit(":"), line.cast("string"))
        own = [content.alias("content"), heading_path.alias("heading_path"), heading.alias("heading_text"), level.cast("int").alias("heading_level"), language.alias("language"), line.cast("int").alias("line")]
        return frame.select(F.concat(F.lit(f"{name}:"), path, suffix).alias("id"), F.lit(name).alias("type"), *shared, *own)

    pages = kind(rows, "page", F.col("fm.body"), none, blank, F.lit(0), blank, F.lit(0))
    sections = kind(rows.withColumn("s", F.explode("parsed.sections")), "section", F.col("s.content"), F.col("s.path"), F.col("s.heading"), F.col("s.level"), blank, F.col("s.line"))
    code = kind(rows.withColumn("s", F.explode("parsed.code")), "code", F.col("s.code"), none, F.col("s.heading"), F.col("s.level"), F.col("s.language"), F.col("s.line"))
    return pages.unionByName(sections).unionByName(code)


STATE = "struct<watermark:string,space_key:string,page_path_index:map<string,string>,attachment_index:map<string,string>,folder_path_index:map<string,string>,_corrupt_record:string>"


#: An RFC 3339 time.
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def is_watermark(c: Column) -> Column:
    """Whether a state's watermark is a time, or blank."""
    return F.coalesce((F.trim(c) == "") | (c.rlike(_TIME) & F.try_to_timestamp(c).isNotNull()), c.isNull())


def state_files(spark: SparkSession, root: str, name: str = "state.json") -> DataFrame:
    """path (of the space's directory below ``root``) and content of all state files, but for those in hidden directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    relative = F.substring_index("path", root.rstrip("/") + "/", -1)
    directory = F.regexp_replace(relative, "/?[^/]*$", "")
    return files.select(directory.alias("path"), F.decode("content", "UTF-8").alias("content")).where(~F.col("path").rlike(r"(^|/)\."))


def state_texts(spaces: DataFrame, pages: DataFrame, attachments: DataFrame, folders: DataFrame) -> DataFrame:
    """space_key and content (JSON, as states() reads it) of every row of ``spaces`` (space_key, watermark) whose watermark is a
    time or blank; the indexes hold space_key, path and page_id, attachment_id or folder_id. Keys are cleaned and sorted, and
    of a path's several ids the least counts. A state is one document, so a space's index is one row here."""
    rows = spaces.where(is_watermark(F.col("watermark"))).select(F.trim("space_key").alias("space_key"), "watermark")
    for frame, name, value in ((pages, "page_path_index", "page_id"), (attachments, "attachment_index", "attachment_id"), (folders, "folder_path_index", "folder_id")):
        clean = frame.select("space_key", text.clean_path(F.col("path")).alias("path"), value).where("path <> ''")
        held = clean.groupBy("space_key", "path").agg(F.min(value).alias("id")).groupBy("space_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "id")))).alias(name))
        rows = rows.join(held, "space_key", "left").withColumn(name, F.coalesce(name, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return rows.select("space_key", F.to_json(F.struct("watermark", "space_key", "page_path_index", "attachment_index", "folder_path_index")).alias("content"))


def states(files: DataFrame) -> DataFrame:
    """State files (path, content) as path, state, error: '' / empty / conflict / corrupt / watermark (no RFC 3339 time); keys are
    normalised by tall()."""
    parsed = F.from_json("content", STATE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    blank = F.coalesce(text.strip(F.col("content")), F.lit("")) == ""
    error = F.when(blank, "empty").when(F.col("content").rlike("<<<<<<<|>>>>>>>"), "conflict").when(F.col("state._corrupt_record").isNotNull(), "corrupt").when(~is_watermark(F.col("state.watermark")), "watermark").otherwise("")
    return files.withColumn("state", parsed).withColumn("error", error)


def tall(state: DataFrame, index: str, value: str) -> DataFrame:
    """One of a state's maps as rows (space_key, path, ``value``)."""
    return state.select(F.col("state.space_key").alias("space_key"), F.explode(f"state.{index}").alias("path", value)).withColumn("path", text.clean_path(F.col("path")))


# Adapters of the driver's tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(doc_id: Column, month: int, hour: str) -> Column:
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    made = F.concat(F.lit("2024-"), pad(doc_id % month + 1), F.lit("-"), pad(doc_id % 28 + 1), F.lit(hour))
    return F.when(doc_id % 10 == 0, "").otherwise(made)


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows over documents and labels."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    path = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    marks = F.array(F.lower("lang"), F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    first = F.substring_index(F.col("text"), "\n", 1)
    return docs.select(
        F.concat(F.lit("page:"), path).alias("id"),
        F.lit("page").alias("type"),
        path.alias("path"),
        F.col("doc_id").cast("string").alias("page_id"),
        F.substring(first, 1, 60).alias("title"),
        F.col("source").alias("space_key"),
        text.labels(marks).alias("labels"),
        F.col("text").alias("content"),
        F.substring(first, 1, 40).alias("heading_text"),
        F.lit(0).alias("line"),
        F.concat(F.lit("u"), (F.col("doc_id") % 17).cast("string")).alias("created_by"),
        _stamp(F.col("doc_id"), 12, "T09:00:00Z").alias("created_at"),
        F.concat(F.lit("u"), (F.col("doc_id") % 11).cast("string")).alias("updated_by"),
        _stamp(F.col("doc_id"), 7, "T12:00:00Z").alias("updated_at"),
    )


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, content and heading_text of doc_index(), without the join that its labels need."""
    first = F.substring_index("text", "\n", 1)
    path = F.concat(F.lit("page:"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("id"), F.substring(first, 1, 60).alias("title"), F.col("text").alias("content"), F.substring(first, 1, 40).alias("heading_text"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: page_id, space_key, title, version, last_modified, seq."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("page_id"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string"))).alias("space_key"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("title"),
        F.row_number().over(order).cast("int").alias("version"),
        F.col("ts").alias("last_modified"),
        F.col("event_id").alias("seq"),
    )


#: Changes up to this time, but for pages whose id is divisible by LOCAL_GAP, are what the local side has.
LOCAL_UNTIL, LOCAL_GAP = "2024-01-20 00:00:00", 7


def remote_pages(feed: DataFrame) -> DataFrame:
    return feed.groupBy("page_id").agg(F.max("version").alias("version"), F.max("last_modified").alias("last_modified"))


def local_pages(feed: DataFrame) -> DataFrame:
    return remote_pages(feed.where(F.col("last_modified") <= F.lit(LOCAL_UNTIL).cast("timestamp_ntz")).where(F.col("page_id") % LOCAL_GAP != 0))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region, nation, supplier and customer tables as a tree: id, title, parent_id, kind."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return (
        t("region").select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit("").alias("parent_id"), F.lit("folder").alias("kind"))
        .unionByName(t("nation").select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("title"), key("r", "n_regionkey").alias("parent_id"), F.lit("page").alias("kind")))
        .unionByName(t("supplier").select(key("s", "s_suppkey").alias("id"), F.concat(F.lit("Supplier "), (F.col("s_suppkey") % 20).cast("string")).alias("title"), key("n", "s_nationkey").alias("parent_id"), F.lit("page").alias("kind")))
        .unionByName(t("customer").select(key("c", "c_custkey").alias("id"), F.concat(F.lit("Customer "), (F.col("c_custkey") % 50).cast("string")).alias("title"), key("n", "c_nationkey").alias("parent_id"), F.lit("page").alias("kind")))
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of pages: page_id, url, href; one row per anchor."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode(hrefs).alias("href"))
