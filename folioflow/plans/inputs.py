"""The driver tables in the roles that the operators take, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Documents as indexed pages: a tree with four children a page, twenty spaces."""
    return table(spark, d, "documents").selectExpr(
        "doc_id AS page_id",
        "cast(substr(source, 4) AS bigint) AS space_id",
        "CASE WHEN doc_id > 0 THEN doc_id div 4 END AS parent_id",
        "cast(doc_id % 7 + 1 AS int) AS version",
        "CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'current' END AS status",
        "concat('page ', doc_id) AS title",
        "sha2(coalesce(text, ''), 256) AS content_hash",
        "sha2(lang, 256) AS structure_hash",
        "lang AS labels_hash",
        "source AS access_scope_hash",
        "'none' AS attachment_manifest_hash",
        "1 AS parser_version",
        "cast(doc_id % 29 = 0 AS int) AS chunker_version",
        "1 AS contextualization_version",
        "1 AS retrieval_schema_version",
        "'m' AS embedding_model",
    )


REGISTRY = """registry AS (SELECT doc_id AS page_id, CAST(substr(source, 4) AS BIGINT) AS space_id, CASE WHEN doc_id > 0 THEN doc_id // 4 END AS parent_id,
  CAST(doc_id % 7 + 1 AS INT) AS version, CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'current' END AS status, 'page ' || doc_id AS title,
  sha256(coalesce(text, '')) AS content_hash, sha256(lang) AS structure_hash, lang AS labels_hash, source AS access_scope_hash,
  CAST(doc_id % 29 = 0 AS INT) AS chunker_version FROM documents)"""


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """A new listing: some pages are new, gone, later, renamed, moved, edited or not fetched."""
    return table(spark, d, "documents").where("doc_id % 19 <> 1").selectExpr(
        "doc_id + CASE WHEN doc_id % 23 = 0 THEN 100000000 ELSE 0 END AS page_id",
        "cast(substr(source, 4) AS bigint) AS space_id",
        "CASE WHEN doc_id % 31 = 0 THEN 5 WHEN doc_id > 0 THEN doc_id div 4 END AS parent_id",
        "cast(doc_id % 7 + 1 + cast(doc_id % 3 = 0 AS int) AS int) AS version",
        "CASE WHEN doc_id % 13 = 0 THEN 'trashed' WHEN doc_id % 37 = 0 THEN 'odd' WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'current' END AS status",
        "concat('page ', doc_id, CASE WHEN doc_id % 17 = 0 THEN ' renamed' ELSE '' END) AS title",
        "CASE WHEN doc_id % 3 = 0 THEN sha2(concat(coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END), 256) END AS content_hash",
        "sha2(concat(lang, CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END), 256) AS structure_hash",
        "CASE WHEN doc_id % 41 = 0 THEN 'xx' ELSE lang END AS labels_hash",
        "source AS access_scope_hash",
        "CASE WHEN doc_id % 43 = 0 THEN 'one' ELSE 'none' END AS attachment_manifest_hash",
    )


INCOMING = """incoming AS (SELECT doc_id + CASE WHEN doc_id % 23 = 0 THEN 100000000 ELSE 0 END AS page_id, CAST(substr(source, 4) AS BIGINT) AS space_id,
  CASE WHEN doc_id % 31 = 0 THEN 5 WHEN doc_id > 0 THEN doc_id // 4 END AS parent_id, CAST(doc_id % 7 + 1 + CAST(doc_id % 3 = 0 AS INT) AS INT) AS version,
  CASE WHEN doc_id % 13 = 0 THEN 'trashed' WHEN doc_id % 37 = 0 THEN 'odd' WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'current' END AS status,
  'page ' || doc_id || CASE WHEN doc_id % 17 = 0 THEN ' renamed' ELSE '' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN sha256(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END) END AS content_hash,
  sha256(lang || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END) AS structure_hash, CASE WHEN doc_id % 41 = 0 THEN 'xx' ELSE lang END AS labels_hash,
  source AS access_scope_hash, CASE WHEN doc_id % 43 = 0 THEN 'one' ELSE 'none' END AS attachment_manifest_hash
  FROM documents WHERE doc_id % 19 <> 1)"""

TARGETS = {"parser_version": 1, "chunker_version": 0, "contextualization_version": 1, "retrieval_schema_version": 1, "embedding_model": "m"}


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks with access columns; tags from the language, every ninth without any."""
    return table(spark, d, "documents").selectExpr(
        "doc_id AS chunk_id", "doc_id AS page_id", "cast(substr(source, 4) AS bigint) AS space_id", "source AS source_id", "1 AS kind", "text",
        "doc_id % 10 <> 3 AS is_active", "CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'current' END AS page_status",
        "CASE WHEN doc_id % 9 = 0 THEN cast(array() AS array<string>) WHEN doc_id % 8 = 0 THEN array(lang, 'general') ELSE array(lang) END AS tags",
    )


CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, doc_id AS page_id, CAST(substr(source, 4) AS BIGINT) AS space_id, source AS source_id, 1 AS kind, text,
  doc_id % 10 <> 3 AS is_active, CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'current' END AS page_status,
  CASE WHEN doc_id % 9 = 0 THEN [] WHEN doc_id % 8 = 0 THEN [lang, 'general'] ELSE [lang] END AS tags FROM documents)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as blocks; lines whose length is a multiple of five are headings of one of three levels."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where("line <> ''").selectExpr("page_id", "pos", "CASE WHEN length(line) % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS kind", "CASE WHEN length(line) % 5 = 0 THEN 1 + length(line) % 3 ELSE 0 END AS level", "line AS text")


BLOCKS = """lines AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
blocks AS (SELECT page_id, pos, CASE WHEN length(line) % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN length(line) % 5 = 0 THEN 1 + length(line) % 3 ELSE 0 END AS level, line AS text FROM lines WHERE line <> ''),
paths AS (SELECT b.*, (SELECT count(*) FROM (SELECT 1)) AS one,
  max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2, max(CASE WHEN level = 3 THEN pos END) OVER w AS p3,
  max_by(CASE WHEN level = 1 THEN text END, CASE WHEN level = 1 THEN pos END) OVER w AS t1, max_by(CASE WHEN level = 2 THEN text END, CASE WHEN level = 2 THEN pos END) OVER w AS t2,
  max_by(CASE WHEN level = 3 THEN text END, CASE WHEN level = 3 THEN pos END) OVER w AS t3
  FROM blocks b WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pathed AS (SELECT page_id, pos, kind, level, text, list_filter([t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END], lambda x: x IS NOT NULL) AS path FROM paths)"""


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as payloads in two shapes, with repeats, unknown types and missing fields."""
    kinds = "array('page_created', 'page_updated', 'page_trashed', 'space_updated', 'label_added', 'unknown')"
    e = table(spark, d, "events").selectExpr("event_id", "ts AS received_at", f"element_at({kinds}, cast(event_id % 6 AS int) + 1) AS kind", "user_id", "cast(get_json_object(props, '$.k') AS bigint) AS k")
    flat = F.to_json(F.struct(F.col("kind").alias("event_type"), F.col("user_id").alias("page_id"), F.col("k").alias("cf_version"), (F.col("user_id") % 7).alias("space_id"), F.concat(F.lit("d"), F.col("event_id") % 4000).alias("delivery_id"), F.lit("2024-01-01T00:00:00Z").alias("event_timestamp")))
    nested = F.to_json(F.struct(F.col("kind").alias("eventType"), F.struct(F.col("user_id").cast("string").alias("id"), F.struct(F.col("k").alias("number")).alias("version"), F.lit("current").alias("status")).alias("page"), F.struct((F.col("user_id") % 7).alias("id")).alias("space"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("userAccountId"), F.lit("2024-01-02T00:00:00Z").alias("timestamp")))
    return e.select("event_id", "received_at", F.when(F.col("event_id") % 2 == 0, flat).otherwise(nested).alias("payload"))


EVENTS = """parsed AS (SELECT event_id, ts AS received_at, ['page_created', 'page_updated', 'page_trashed', 'space_updated', 'label_added', 'unknown'][CAST(event_id % 6 AS INT) + 1] AS event_type,
  user_id AS page_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cf_version, user_id % 7 AS space_id, CASE WHEN event_id % 2 = 1 THEN 'current' END AS status,
  CASE WHEN event_id % 2 = 1 THEN 'u' || (user_id % 5) END AS actor_account_id, CASE WHEN event_id % 2 = 0 THEN 'd' || (event_id % 4000) END AS delivery_id,
  CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS event_timestamp FROM events),
subscribed AS (SELECT *, coalesce(actor_account_id = 'u1', false) AS self_generated FROM parsed WHERE event_type <> 'unknown'),
keyed AS (SELECT *, coalesce('d:' || delivery_id, 'h:' || concat_ws('|', event_type, page_id, coalesce(CAST(cf_version AS VARCHAR), 'n'), space_id, status, event_timestamp)) AS k FROM subscribed),
inserted AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY received_at, event_id) = 1)"""
