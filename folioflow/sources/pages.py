"""Pages, their side tables and attachments."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAGE = """id string, spaceId string, parentId string, status string, title string,
version struct<number int, createdAt string, message string, authorId string>,
body struct<storage struct<representation string, value string>>, _links struct<webui string>"""
LABELS = "pageId string, results array<struct<id string, name string, prefix string>>"
RESTRICTIONS = "pageId string, operation string, restrictions struct<user struct<results array<struct<accountId string, displayName string>>>, group struct<results array<struct<id string, name string>>>>"
ATTACHMENTS = "pageId string, results array<struct<id string, title string, mediaType string, fileSize long, version struct<number int, createdAt string>, file string, downloadLink string, _links struct<download string>>>"


def _json(spark: SparkSession, path, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=not lines)


def load_pages(spark: SparkSession, path, base_url: str, lines: bool = False) -> DataFrame:
    """One flat row a page; ``lines``: one JSON object a line (splittable) instead of one a file. Defaults: space 0,
    no parent where it is empty, status current, version 1; the url is absolute."""
    raw = _json(spark, path, PAGE, lines)
    link = F.coalesce("_links.webui", F.lit(""))
    return raw.select(
        F.col("id").try_cast("long").alias("page_id"),
        F.coalesce(F.col("spaceId").try_cast("long"), F.lit(0)).alias("space_id"),
        F.when(F.coalesce("parentId", F.lit("")) != "", F.col("parentId").try_cast("long")).alias("parent_id"),
        F.coalesce("status", F.lit("current")).alias("status"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("version.number", F.lit(1)).alias("version"),
        F.col("version.createdAt").try_cast("timestamp").alias("version_at"),
        F.coalesce("body.storage.value", F.lit("")).alias("body"),
        F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base_url), link)).alias("url"),
    )


def load_labels(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return _json(spark, path, LABELS, lines).select(F.col("pageId").try_cast("long").alias("page_id"), F.transform(F.coalesce("results", F.array().cast("array<struct<id string, name string, prefix string>>")), lambda r: r["name"]).alias("labels"))


def load_restrictions(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """(page_id, users, groups) of read restrictions."""
    raw = _json(spark, path, RESTRICTIONS, lines).where("operation is null or operation = 'read'")
    return raw.select(F.col("pageId").try_cast("long").alias("page_id"), F.transform("restrictions.user.results", lambda r: r["accountId"]).alias("users"), F.transform("restrictions.group.results", lambda r: r["id"]).alias("groups"))


def load_attachments(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    raw = _json(spark, path, ATTACHMENTS, lines).select(F.col("pageId").try_cast("long").alias("page_id"), F.explode("results").alias("a"))
    return raw.select("page_id", "a.id", "a.title", F.col("a.mediaType").alias("media_type"), F.col("a.fileSize").alias("file_size"), F.col("a.version.number").alias("version"), F.coalesce("a.downloadLink", "a._links.download").alias("link"))


def expand_groups(restrictions: DataFrame, members: DataFrame, nobody: str = "__nobody__") -> DataFrame:
    """(page_id, principals): users and the members of groups, sorted, distinct. Pages that name groups of which none
    is known get ``nobody`` (closed); pages that name neither users nor groups get no row (open)."""
    none = F.array().cast("array<string>")
    r = restrictions.select("page_id", F.coalesce("users", none).alias("users"), F.coalesce("groups", none).alias("groups")).where("size(users) + size(groups) > 0")
    users = r.select("page_id", F.explode_outer("users").alias("principal"))
    of_groups = r.select("page_id", F.explode("groups").alias("group_id")).join(members.select("group_id", F.col("account_id").alias("principal")), "group_id").select("page_id", "principal")
    return users.unionByName(of_groups).groupBy("page_id").agg(F.array_sort(F.collect_set("principal")).alias("p")).select("page_id", F.when(F.size("p") == 0, F.array(F.lit(nobody))).otherwise(F.col("p")).alias("principals"))


def _csv_text(raw: str) -> str:
    rows = ([c.strip() for c in row] for row in csv.reader(io.StringIO(raw)))
    return "\n".join(" | ".join(r) for r in rows if any(r))


@F.pandas_udf(StringType())
def _csv(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            return _csv_text(x or "")
        except csv.Error:
            return ""

    return s.map(one)


def attachment_text(files: DataFrame) -> DataFrame:
    """(path, method, text, needs_ocr) from (path, media_type, content binary): the method comes from the media type,
    then from the file's extension. PDF, Word and sheet bytes are routed, not parsed. No row fails."""
    kind, ext = F.lower(F.coalesce("media_type", F.lit(""))), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    method = (
        F.when(F.startswith(kind, F.lit("image/")) | ext.isin("png", "jpg", "jpeg", "gif", "webp", "bmp"), "image")
        .when((kind == "text/csv") | (ext == "csv"), "csv")
        .when((kind == "text/html") | ext.isin("html", "htm"), "html")
        .when((kind == "text/markdown") | ext.isin("md", "markdown"), "markdown")
        .when((kind == "application/pdf") | (ext == "pdf"), "pdf")
        .when(F.contains(kind, F.lit("wordprocessingml")) | (ext == "docx"), "docx")
        .when(F.contains(kind, F.lit("spreadsheetml")) | (ext == "xlsx"), "xlsx")
        .when(F.startswith(kind, F.lit("text/")) | (ext == "txt"), "text")
        .otherwise("skipped")
    )
    raw = files.select("path", method.alias("method"), F.expr("cast(content as string)").alias("raw"))
    plain = F.trim(F.regexp_replace("raw", r"^\s+|\s+\z", ""))
    html = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]+>", " "), r"\s+", " "))
    text = F.when(F.col("method") == "csv", _csv(F.when(F.col("method") == "csv", F.col("raw")))).when(F.col("method") == "html", html).when(F.col("method").isin("markdown", "text"), plain).otherwise("")
    return raw.select("path", "method", text.alias("text"), F.col("method").isin("image", "pdf").alias("needs_ocr"))


def attachment_blocks(attachments: DataFrame, most: int = 200, most_bytes: int = 20 << 20) -> DataFrame:
    """(page_id, n, kind, level, text, path) from (page_id, id, title, link, file_size, text): a heading with the title and
    a paragraph with the text for each of a page's first ``most`` attachments by id, less those without link, title or
    text and the large ones."""
    first = attachments.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("id").cast("string")))).where(F.col("r") <= most)
    ok = first.where((F.coalesce("link", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("file_size", F.lit(0)) <= most_bytes) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    pair = F.array(F.struct(F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.col("title").alias("text")), F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.col("text").alias("text")))
    return ok.select("page_id", "r", F.array(F.lit("Attachments"), F.col("title")).alias("path"), F.posexplode(pair).alias("k", "b")).select("page_id", (2 * (F.col("r") - 1) + F.col("k")).alias("n"), "b.kind", "b.level", "b.text", "path")
