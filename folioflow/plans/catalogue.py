"""Queries over the driver tables, one or more for each group of operators, with DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import blocks as B
from ..operators import changes as C
from ..operators import chunking as K
from ..operators import evaluation as E
from ..operators import filters as V
from ..operators import scope as O
from ..operators import search as R
from ..operators import versions as W
from ..operators.tables import new_path, written
from ..sources import events as N
from ..sources import pages as P
from ..sources import registry as G
from ..streaming import jobs as J
from ..streaming import state as S
from . import inputs as I
from . import retrieve as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lit_array(*x: str):
    return F.array(*map(F.lit, x))


# --- projections and scalar functions -----------------------------------------------------------


@query(r"""
WITH t AS (SELECT doc_id, text, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS tidy FROM documents)
SELECT doc_id, tidy = '' AS blank, CASE WHEN tidy = '' THEN 0 ELSE greatest(len(string_split(tidy, ' ')), CAST(ceil(length(text) / 4.0) AS INT)) END AS tokens FROM t""")
def token_count(spark, d):
    return I.table(spark, d, "documents").select("doc_id", (T.word_count(F.col("text")) == 0).alias("blank"), T.token_count(F.col("text")).alias("tokens"))


@query(r"""
SELECT doc_id, sha256(nfc_normalize(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS tidy_sha256 FROM documents""")
def normalize_text(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.sha2(F.encode(H.normalize_text(F.coalesce("text", F.lit(""))), "UTF-8"), 256).alias("tidy_sha256"))


@query(r"""
WITH c AS (SELECT doc_id, lang, source, text, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'About ' || lang ELSE 'Sorry, I cannot access the page' END AS ctx FROM documents),
k AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN source ELSE source || ' — ' || lang || ' > x' END AS prefix, CASE WHEN doc_id % 3 = 1 THEN ctx ELSE '' END AS kept FROM c)
SELECT doc_id, kept AS context, prefix, sha256(prefix || CASE WHEN kept = '' THEN '' ELSE chr(10) || kept END || chr(10) || chr(10) || coalesce(text, '')) AS retrieval_sha256,
  CAST(length(substr(source || ' ' || coalesce(text, ''), 1, 4000)) AS INT) AS rerank_chars FROM k""")
def retrieval_text(spark, d):
    docs = I.table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    path = F.when(F.col("doc_id") % 5 == 0, F.array("source")).otherwise(F.array(F.col("lang"), F.lit(""), F.lit("x")))
    context = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("About "), "lang")).otherwise("Sorry, I cannot access the page")
    clean = T.clean_context(context)
    return docs.select("doc_id", clean.alias("context"), T.metadata_prefix(F.col("source"), path).alias("prefix"), F.sha2(F.encode(T.compose_retrieval(F.col("source"), path, clean, F.col("text")), "UTF-8"), 256).alias("retrieval_sha256"), F.length(T.rerank_text(F.col("source"), F.col("text"))).alias("rerank_chars"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[REDACTED_EMAIL]', 'g'),
  '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED_SSN]', 'g'), '\b(?:\d[ -]?){13,16}\b', '[REDACTED_CARD]', 'g'),
  '\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', '[REDACTED_PHONE]', 'g')) AS redacted_sha256 FROM documents""")
def redact_pii(spark, d):
    """Signs beyond ASCII become letters first: DuckDB's word boundaries know ASCII alone."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x")
    return I.table(spark, d, "documents").select("doc_id", F.sha2(F.encode(T.redact_pii(text), "UTF-8"), 256).alias("redacted_sha256"))


@query(r"""
WITH a AS (SELECT doc_id, [2, 3, CAST(doc_id % 5 AS INT)] AS valid, regexp_replace(coalesce(text, ''), '[.] ', ' [2][9]. ', 'g') || ' Up [1]. No marker here! Last one [3] ?' AS answer FROM documents),
s AS (SELECT doc_id, valid, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])[\s\x0B]+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS s FROM a),
c AS (SELECT *, list_transform(s, lambda x: list_filter(list_transform(regexp_extract_all(x, '\[(\d+)\]', 1), lambda m: TRY_CAST(m AS INT)), lambda m: list_contains(valid, m))) AS cited FROM s),
k AS (SELECT *, list_filter(list_zip(s, cited), lambda z: len(z[2]) > 0) AS kept FROM c)
SELECT doc_id, list_sort(list_distinct(flatten(list_transform(kept, lambda z: z[2])))) AS used,
 sha256(array_to_string(list_transform(kept, lambda z: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(z[1], '\[(' || array_to_string(valid, '|') || ')\]', chr(1) || '\1' || chr(2), 'g'), '\[\d+\]', '', 'g'), chr(1) || '(\d+)' || chr(2), '[\1]', 'g'), '[\s\x0B]+([.!?,;:])', '\1', 'g'), '[\s\x0B]{2,}', ' ', 'g'))), ' ')) AS text_sha256 FROM k""")
def enforce_citations(spark, d):
    """Whole texts as answers, with markers at the end of their sentences."""
    answer = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[.] ", " [2][9]. "), F.lit(" Up [1]. No marker here! Last one [3] ?"))
    out = I.table(spark, d, "documents").select("doc_id", T.enforce_citations(answer, F.array(F.lit(2), F.lit(3), (F.col("doc_id") % 5).cast("int"))).alias("c"))
    return out.select("doc_id", "c.used", F.sha2(F.encode("c.text", "UTF-8"), 256).alias("text_sha256"))


@query(r"""
WITH r AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 4 = 3 THEN ' Thanks!! ' WHEN turn % 4 = 2 THEN 'What is  my company?' WHEN turn % 7 = 0 THEN ' ' ELSE regexp_replace(coalesce(text, ''), '[^a-zA-Z .]', '', 'g') END AS m FROM conversations),
w AS (SELECT *, trim(regexp_replace(m, '\s+', ' ', 'g')) AS tidy, trim(regexp_replace(regexp_replace(lower(trim(m)), '[!.?\s]+$', ''), '\s+', ' ', 'g')) AS phrase FROM r)
SELECT conv_id, turn, CASE WHEN phrase = 'thanks' THEN 'small_talk' WHEN phrase = 'what is my company' THEN 'identity' WHEN tidy = '' THEN 'empty' WHEN len(string_split(tidy, ' ')) >= 12 THEN 'search' ELSE 'needs_classifier' END AS route FROM w""")
def route_query(spark, d):
    m = F.when(F.col("turn") % 4 == 3, " Thanks!! ").when(F.col("turn") % 4 == 2, "What is  my company?").when(F.col("turn") % 7 == 0, " ").otherwise(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z .]", ""))
    return I.table(spark, d, "conversations").select("conv_id", "turn", T.route_query(m).alias("route"))


@query(r"""
WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS tidy FROM conversations)
SELECT conv_id, turn, tidy <> '' AND (len(string_split(tidy, ' ')) >= 40 OR length(text) % 2 = 0) AS searched FROM r""")
def needs_search(spark, d):
    """What the routes leave open goes to a classifier of vague questions; here one by length stands for a model."""
    vague = lambda many: [len(x) % 2 == 1 for x in many]
    text = F.coalesce("text", F.lit(""))
    return I.table(spark, d, "conversations").select("conv_id", "turn", T.needs_search(T.route_query(text, 40), text, vague).alias("searched"))


@query(r"""
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'answer' WHEN event_type = 'error' THEN 'no_candidates' WHEN value / 100 <= 0.035 THEN 'off_topic' WHEN value / 100 < 0.05 THEN 'weak_score' ELSE 'answer' END AS outcome,
  CAST(least(5 * pow(2, event_id % 15), 3600) AS BIGINT) AS retry_s, CASE WHEN event_id % 15 + 1 >= 8 THEN 'dead_letter' ELSE 'waiting' END AS state,
  CASE WHEN event_id % 15 + 1 < 8 THEN CAST(5 * pow(2, event_id % 15) AS BIGINT) END AS waits_s, length(left(repeat(props, 300), 4000)) AS error_chars,
  1500 + event_id % 1000 AS took_ms FROM events""")
def refusal_and_backoff(spark, d):
    e = I.table(spark, d, "events")
    failed = T.retry_state(F.col("event_id") % 15 + 1, F.repeat("props", F.lit(300)), F.col("ts"))
    done = F.timestamp_add("MILLISECOND", (1500 + F.col("event_id") % 1000).cast("int"), F.col("ts"))
    out = e.select("event_id", T.refusal_decision(F.when(F.col("event_type") != "error", F.col("value") / 100), F.col("event_id") % 50 == 0).alias("outcome"), T.retry_seconds(F.col("event_id") % 15 + 1).alias("retry_s"), failed.alias("f"), "ts", T.latency_ms(F.col("ts"), done).alias("took_ms"))
    return out.select("event_id", "outcome", "retry_s", "f.state", F.timestamp_diff("SECOND", "ts", F.col("f.available_at")).alias("waits_s"), F.length("f.error").alias("error_chars"), "took_ms")


@query(r"""
WITH r AS (SELECT conv_id, turn, 'Question: first' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'question:  ' ELSE 'QUESTION:' END || coalesce(text, '') || CASE WHEN turn % 5 = 4 THEN chr(13) || chr(10) || 'question: ' ELSE '' END || chr(10) || 'Options:' || chr(10)
 || '- turn ' || turn || chr(10) || CASE WHEN turn % 2 = 0 THEN '-  ' || role || ' ' || chr(10) ELSE '' END || '-' || chr(10) AS reply FROM conversations),
l AS (SELECT *, list_transform(string_split_regex(trim(reply), '\r\n|\r|\n'), lambda x: trim(x)) AS lines FROM r),
q AS (SELECT *, trim(substr(list_filter(lines, lambda x: lower(x) LIKE 'question:%')[-1], 10)) AS question, list_filter(list_transform(list_filter(lines, lambda x: x LIKE '-%'), lambda x: trim(substr(x, 2))), lambda x: x <> '') AS options FROM l)
SELECT conv_id, turn, CASE WHEN question <> '' THEN question END AS question, CASE WHEN question <> '' THEN options END AS options FROM q""")
def parse_clarification(spark, d):
    """Replies made of whole texts, with several question lines, empty ones and options."""
    head = F.concat(F.lit("Question: first\n"), F.when(F.col("turn") % 3 == 0, "question:  ").otherwise("QUESTION:"), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 5 == 4, "\r\nquestion: ").otherwise(""))
    reply = F.concat(head, F.lit("\nOptions:\n- turn "), F.col("turn").cast("string"), F.lit("\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("-  "), "role", F.lit(" \n"))).otherwise(""), F.lit("-\n"))
    out = I.table(spark, d, "conversations").select("conv_id", "turn", T.parse_clarification(reply).alias("c"))
    return out.select("conv_id", "turn", "c.question", "c.options")


@query(r"""
WITH u AS (SELECT '\x1F'::BLOB AS s)
SELECT doc_id, sha256(encode('["' || CASE WHEN lang < source THEN lang || '","' || source ELSE source || '","' || lang END || '"]') || s) AS labels_hash,
  sha256(encode('{"read":["' || lang || '"],"space":"' || source || '"}') || s) AS access_hash, CASE WHEN doc_id % 2 = 0 THEN sha256(encode(source) || s) END AS subject,
  sha256(unhex(sha256(encode(CAST(doc_id AS VARCHAR)) || s || encode(source || '>' || lang) || s || encode('2') || s || encode('0') || s)) || s || encode('1') || s || encode('3') || s || unhex(sha256(encode(coalesce(text, '')) || s)) || s) AS stable_key
FROM documents, u""")
def stable_hashes(spark, d):
    docs = I.table(spark, d, "documents")
    keys = H.chunk_keys(F.col("doc_id"), F.array("source", "lang"), F.lit(2), F.lit(0), F.lit(1), F.lit(3), F.col("text"))
    return docs.select("doc_id", H.labels_hash(F.array(F.concat(F.lit(" "), "lang"), F.col("source"), F.col("lang"))).alias("labels_hash"), H.access_scope_hash(F.array("lang", "lang"), F.col("source")).alias("access_hash"), H.subject_hash(F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("subject"), keys["stable_key"].alias("stable_key"))


@query(r"""
WITH a AS (SELECT doc_id % 500 AS page_id, CASE WHEN doc_id % 7 = 0 THEN 'None' ELSE 'a' || doc_id END AS i, CAST(n_chars AS VARCHAR) AS size, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'text/' || lang END AS m FROM documents)
SELECT page_id, sha256(encode('[' || string_agg('["' || i || '","1","' || size || '","' || m || '"]', ',' ORDER BY i, size, m) || ']') || '\x1F'::BLOB) AS attachment_manifest_hash FROM a GROUP BY page_id""")
def attachment_manifests(spark, d):
    a = I.table(spark, d, "documents").select((F.col("doc_id") % 500).alias("page_id"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"))).alias("id"), F.lit(1).alias("version"), F.col("n_chars").alias("file_size"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("text/"), "lang")).alias("media_type"))
    return H.attachment_manifest_hash(a)


@query(r"""
WITH t AS (SELECT conv_id, string_agg('["' || role || '",' || to_json(text) || ']', ',' ORDER BY turn) AS j FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256('[' || j || ']|u' || (conv_id % 3) || '|a,general|s') AS cache_key FROM t""")
def cache_key(spark, d):
    said = I.table(spark, d, "conversations")
    keyed = H.cache_key(said, "conv_id", "turn", F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")), _lit_array("general", "a"), F.lit("s"))
    return keyed


@query(r"""
SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context_sha256 FROM conversations GROUP BY conv_id""")
def query_context(spark, d):
    said = T.query_context(I.table(spark, d, "conversations"))
    return said.select("conv_id", F.sha2(F.encode("context", "UTF-8"), 256).alias("context_sha256"))


@query(r"""
WITH t AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS c, max_by(text, turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(CASE WHEN length(c) % 3 = 0 THEN u ELSE translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END) AS query_sha256 FROM t""")
def rewrite_queries(spark, d):
    """Whole contexts; letters a to z in upper case stand for a model's rewriting, an empty reply keeps the question."""
    large = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    loud = lambda many: ["" if len(c) % 3 == 0 else c.translate(large) for c in many]
    out = T.rewrite_queries(T.query_context(I.table(spark, d, "conversations")), loud)
    return out.select("conv_id", F.sha2(F.encode("query", "UTF-8"), 256).alias("query_sha256"))


# --- pages, blocks, chunks ----------------------------------------------------------------------


@query(r"""
SELECT page_id, page_id % 9 AS space_id, CASE WHEN page_id % 4 > 0 THEN page_id // 4 END AS parent_id, CASE WHEN page_id % 6 = 0 THEN 'current' ELSE 'archived' END AS status,
  CASE WHEN page_id % 5 = 0 THEN 1 ELSE CAST(page_id % 5 AS INT) END AS version, sha256(html) AS body_sha256, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://base.example/p/' || page_id END AS url FROM pages""")
def load_pages(spark, d):
    p = I.table(spark, d, "pages")
    raw = p.select(F.col("page_id").cast("string").alias("id"), (F.col("page_id") % 9).cast("string").alias("spaceId"), F.when(F.col("page_id") % 4 > 0, F.expr("cast(page_id div 4 AS string)")).otherwise("").alias("parentId"), F.when(F.col("page_id") % 6 > 0, "archived").alias("status"), F.struct(F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 5).cast("int").alias("number")).alias("version"), F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"), F.struct(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/p/"), F.col("page_id").cast("string"))).alias("webui")).alias("_links"))
    path = new_path(spark, "pages")
    raw.write.json(path)
    return P.load_pages(spark, path, "https://base.example", lines=True).select("page_id", "space_id", "parent_id", "status", "version", F.sha2("body", 256).alias("body_sha256"), "url")


@query(r"""
SELECT doc_id AS page_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [lang, source] END AS labels, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END AS attachment, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS file_size,
 CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '/d/' || doc_id ELSE '/l/' || doc_id END END AS link, CASE WHEN doc_id % 7 <> 0 THEN ['u' || doc_id] END AS users, CASE WHEN doc_id % 7 <> 0 THEN ['g' || doc_id % 3] END AS groups FROM documents""")
def load_page_aux(spark, d):
    """Labels, attachments and restrictions as the page source's JSON, written and read back."""
    docs = I.table(spark, d, "documents").withColumn("pageId", F.col("doc_id").cast("string"))
    named = lambda c, of="name": F.struct(F.col(c).alias(of))
    labels = docs.select("pageId", F.when(F.col("doc_id") % 5 > 0, F.array(named("lang"), named("source"))).alias("results"))
    path = lambda head: F.concat(F.lit(head), "pageId")
    files = docs.where("doc_id % 3 = 0").select("pageId", F.array(F.struct(path("a").alias("id"), F.col("n_chars").alias("fileSize"), F.when(F.col("doc_id") % 2 == 0, path("/d/")).alias("downloadLink"), F.struct(path("/l/").alias("download")).alias("_links"))).alias("results"))
    users, groups = F.array(F.struct(path("u").alias("accountId"))), F.array(F.struct(F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")).alias("id")))
    limits = docs.select("pageId", F.when(F.col("doc_id") % 7 > 0, "read").otherwise("update").alias("operation"), F.struct(F.struct(users.alias("results")).alias("user"), F.struct(groups.alias("results")).alias("group")).alias("restrictions"))
    at = {}
    for name, df in (("labels", labels), ("attachments", files), ("restrictions", limits)):
        at[name] = new_path(spark, name)
        df.write.json(at[name])
    have = P.load_attachments(spark, at["attachments"], lines=True).select("page_id", F.col("id").alias("attachment"), "file_size", "link")
    return P.load_labels(spark, at["labels"], lines=True).join(have, "page_id", "left").join(P.load_restrictions(spark, at["restrictions"], lines=True), "page_id", "left")


@query(r"""
SELECT 'd' || item_id // 50 AS dataset, CAST(item_id AS VARCHAR) AS case_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 's' || item_id % 7 END AS scope, CASE WHEN item_id % 3 = 0 THEN 'latency' ELSE 'retrieval' END AS kind,
 CASE WHEN item_id % 4 = 0 THEN 0 ELSE 2 END AS n_relevant FROM benchmark""")
def load_eval_cases(spark, d):
    """Test items as datasets of fifty cases, one JSON file each, written and read back."""
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 4 > 0, _lit_array("a", "b")).otherwise(F.array().cast("array<string>")).alias("relevant_chunk_ids"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("s"), (F.col("item_id") % 7).cast("string"))).alias("scope"), F.when(F.col("item_id") % 3 == 0, "latency").alias("kind"))
    path = new_path(spark, "cases")
    I.table(spark, d, "benchmark").groupBy(F.concat(F.lit("d"), F.expr("item_id div 50").cast("string")).alias("name")).agg(F.collect_list(case).alias("cases")).write.option("maxRecordsPerFile", 1).json(path)
    cases, relevant = G.load_eval_cases(spark, path)
    n = relevant.groupBy("dataset", "case_id").agg(F.count("*").cast("int").alias("n_relevant"))
    return cases.join(n, ["dataset", "case_id"], "left").na.fill(0, ["n_relevant"])


@query(r"""
SELECT source AS name, upper(source) AS label, max(n_chars) || ' characters' AS description FROM documents GROUP BY source UNION ALL SELECT 'general', 'GENERAL', 'all'""")
def load_scope_registry(spark, d):
    """The sources as scopes of one registry file, written, checked and read back."""
    of = I.table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.concat(F.max("n_chars").cast("string"), F.lit(" characters")).alias("description"))
    own = spark.createDataFrame([("general", "all"), ("classified", "none")], "name string, description string")
    path = new_path(spark, "scopes")
    of.unionByName(own).agg(F.collect_list(F.struct("name", F.upper("name").alias("label"), "description")).alias("scopes")).write.json(path)
    return G.load_scope_registry(spark, path, "general")


@query(f"""WITH {I.CHUNKS} SELECT space_id, is_active, count(*) AS chunks, sum(chunk_id)::BIGINT AS ids FROM chunks GROUP BY 1, 2""")
def write_index(spark, d):
    """The index is written by space and activity, then some spaces are replaced by themselves; the others stay."""
    path, chunks = new_path(spark, "index"), I.chunks(spark, d)
    G.write_index({"chunks": chunks}, path)
    G.write_index({"chunks": chunks.where("space_id % 3 = 0")}, path)
    return spark.read.parquet(f"{path}/chunks").groupBy(F.col("space_id").cast("long").alias("space_id"), F.col("is_active").cast("boolean").alias("is_active")).agg(F.count("*").alias("chunks"), F.sum("chunk_id").alias("ids"))


@query()
def normalize_pages(spark, d):
    return B.normalize_pages(I.table(spark, d, "pages"), body_col="html")


@query(f"WITH {I.BLOCKS} SELECT page_id, pos, path FROM pathed")
def heading_paths(spark, d):
    return B.heading_paths(I.blocks(spark, d)).select("page_id", "pos", "path")


@query(f"""WITH {I.BLOCKS}, s AS (SELECT *, CAST(sum(CAST(kind = 'heading' AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS section FROM pathed),
h AS (SELECT page_id, section, arg_min(path, pos) AS p, arg_min(level, pos) AS section_level FROM s GROUP BY 1, 2),
o AS (SELECT page_id, section, section_level, CAST(row_number() OVER (PARTITION BY page_id, p ORDER BY section) - 1 AS INT) AS sibling_ordinal FROM h)
SELECT s.page_id, CAST(s.pos AS INT) AS pos, s.section, CAST(o.section_level AS INT) AS section_level, o.sibling_ordinal FROM s JOIN o USING (page_id, section)""")
def build_sections(spark, d):
    return B.build_sections(B.heading_paths(I.blocks(spark, d))).select("page_id", "pos", "section", "section_level", "sibling_ordinal")


@query(f"""WITH {I.BLOCKS} SELECT page_id, sha256(string_agg(kind || ':' || level || ':' || text || chr(31), '' ORDER BY pos)) AS content_hash,
sha256(string_agg(kind || ':' || level || ':' || array_to_string(path, '>') || chr(31), '' ORDER BY pos)) AS structure_hash,
sha256(substr(string_agg(text, chr(10) ORDER BY pos), 1, 60000)) AS doc_sha256 FROM pathed GROUP BY page_id""")
def page_hashes(spark, d):
    b = I.blocks(spark, d)
    return B.page_hashes(B.heading_paths(b)).join(B.doc_text(b).select("page_id", F.sha2(F.encode("doc_text", "UTF-8"), 256).alias("doc_sha256")), "page_id")


_TIDY = r"trim(regexp_replace({}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_WORDS = f"(CASE WHEN {_TIDY} = '' THEN 0 ELSE len(string_split({_TIDY}, ' ')) END)"
_TOKENS = f"(CASE WHEN {_TIDY} = '' THEN 0 ELSE greatest(len(string_split({_TIDY}, ' ')), ceil(length({{0}}) / 4.0)) END)::INT".replace("{}", "{0}")
_WORDS = _WORDS.replace("{}", "{0}")


def _windows(name: str, source: str, most: int, overlap: int) -> str:
    """DuckDB tables to ``name`` (id, k, text): windows of the texts of ``source`` (id, text) that have over ``most`` tokens."""
    fits = f"greatest(({{b}}) - ({{a}}), ceil((s[({{b}}) + 1] - s[({{a}}) + 1] - 1) / 4.0)) <= {most}"
    return f"""{name}_w AS (SELECT id, flatten(list_transform(string_split({_TIDY.format("text")}, ' '),
  lambda x: CASE WHEN length(x) <= {4 * most} THEN [x] ELSE list_transform(range(0, length(x), {4 * most}), lambda k: substr(x, k + 1, {4 * most})) END)) AS ws FROM {source}),
{name}_e AS (SELECT id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM {name}_w),
{name}_c AS (SELECT id, i, sum(length(x) + 1) OVER o AS s, sum(greatest(1, ceil(length(x) / 4.0))) OVER o AS c FROM {name}_e WINDOW o AS (PARTITION BY id ORDER BY i)),
{name}_p AS (SELECT id, max(i) AS n, list_prepend(0, list(s::BIGINT ORDER BY i)) AS s, list_prepend(0, list(c::BIGINT ORDER BY i)) AS c FROM {name}_c GROUP BY id),
{name}_r(id, n, k, a, e) AS (SELECT id, n, 0, 0::BIGINT, coalesce(list_filter(range(1, n), lambda i: NOT ({fits.format(a="0", b="i + 1")}))[1], n) FROM {name}_p
  UNION ALL SELECT id, n, k + 1, a2, coalesce(list_filter(range(e + 1, n), lambda i: NOT ({fits.format(a="a2", b="i + 1")}))[1], n)
  FROM (SELECT *, coalesce(list_filter(range(t, e), lambda j: {fits.format(a="j", b="e + 1")})[1], e) AS a2
    FROM (SELECT r.*, p.s, p.c, list_filter(range(r.a, r.e + 1), lambda j: p.c[r.e + 1] - p.c[j + 1] <= {overlap})[1] AS t FROM {name}_r r JOIN {name}_p p ON r.id = p.id WHERE r.e < r.n))),
{name} AS (SELECT r.id, k, array_to_string(ws[a + 1:e], ' ') AS text FROM {name}_r r JOIN {name}_w w ON r.id = w.id)"""


@query(f"""WITH RECURSIVE {I.BLOCKS}, s AS (SELECT *, CAST(sum(CAST(kind = 'heading' AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS section FROM pathed),
h AS (SELECT page_id, section, arg_min(path, pos) AS path, arg_min(level, pos) AS level FROM s GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id, path ORDER BY section) - 1 AS sibling FROM h),
u AS (SELECT page_id, section, text, row_number() OVER (PARTITION BY page_id, section ORDER BY pos) AS u, {_WORDS.format("text")} AS w, length(text) AS c, {_TOKENS.format("text")} AS tok FROM s),
packed(page_id, section, u, slot, words, chars, open) AS (SELECT page_id, section, u, 0, w, c, tok <= 2000 FROM u WHERE u = 1
  UNION ALL SELECT u.page_id, u.section, u.u, CASE WHEN joins THEN slot ELSE slot + 1 END, CASE WHEN joins THEN words + w ELSE w END, CASE WHEN joins THEN chars + 1 + c ELSE c END, tok <= 2000
  FROM (SELECT u.*, p.slot, p.words, p.chars, tok <= 2000 AND open AND (words + w = 0 OR greatest(words + w, ceil((chars + 1 + c) / 4.0)) <= 1200) AS joins FROM packed p JOIN u ON u.page_id = p.page_id AND u.section = p.section AND u.u = p.u + 1) u),
slots AS (SELECT p.page_id, p.section, slot, any_value(open) AS whole, string_agg(text, chr(10) ORDER BY p.u) AS text, row_number() OVER (ORDER BY p.page_id, p.section, slot) AS id
  FROM packed p JOIN u ON u.page_id = p.page_id AND u.section = p.section AND u.u = p.u GROUP BY p.page_id, p.section, slot),
large AS (SELECT id, text FROM slots WHERE NOT whole), {_windows("big", "large", 1200, 0)},
parents AS (SELECT page_id, section, row_number() OVER (PARTITION BY page_id, section ORDER BY slot, k) - 1 AS parent, text, row_number() OVER (ORDER BY page_id, section, slot, k) AS id FROM (
  SELECT page_id, section, slot, 0 AS k, text FROM slots WHERE whole UNION ALL SELECT page_id, section, slot, k, big.text FROM slots JOIN big USING (id))),
long AS (SELECT id, text FROM parents WHERE {_TOKENS.format("text")} > 750), {_windows("part", "long", 400, 48)},
ends AS (SELECT *, max(k) OVER (PARTITION BY id) AS last FROM part), short AS (SELECT id FROM ends WHERE k = last AND last > 0 AND {_TOKENS.format("text")} < 150),
pieces AS (SELECT id, CASE WHEN id IN (SELECT id FROM short) AND k = last THEN k - 1 ELSE k END AS k, string_agg(text, ' ' ORDER BY k) AS text FROM ends GROUP BY 1, 2),
children AS (SELECT page_id, section, parent, row_number() OVER (PARTITION BY page_id, section ORDER BY parent, k) - 1 AS child, text FROM (
  SELECT page_id, section, parent, 0 AS k, text FROM parents WHERE id NOT IN (SELECT id FROM long) UNION ALL SELECT page_id, section, parent, k, pieces.text FROM parents JOIN pieces USING (id))),
every AS (SELECT page_id, section, parent, NULL::BIGINT AS child, 0 AS kind, text FROM parents UNION ALL SELECT page_id, section, parent, child, 1, text FROM children),
keyed AS (SELECT e.*, {_TOKENS.format("e.text")} AS tokens, row_number() OVER (PARTITION BY e.page_id ORDER BY e.section, parent, kind, child) - 1 AS seq,
  sha256(encode(e.page_id::VARCHAR) || '\\x1F'::BLOB || encode(array_to_string(o.path, '>')) || '\\x1F'::BLOB || encode(o.level::VARCHAR) || '\\x1F'::BLOB || encode(o.sibling::VARCHAR) || '\\x1F'::BLOB) AS section_key FROM every e JOIN o ON e.page_id = o.page_id AND e.section = o.section),
stable AS (SELECT *, sha256(unhex(section_key) || '\\x1F'::BLOB || encode(CASE WHEN kind = 0 THEN 'parent' ELSE parent::VARCHAR END) || '\\x1F'::BLOB || encode(coalesce(child, parent)::VARCHAR) || '\\x1F'::BLOB || unhex(sha256(encode(text) || '\\x1F'::BLOB)) || '\\x1F'::BLOB) AS stable_key FROM keyed)
SELECT c.page_id, c.section, c.parent::INT AS parent, c.child::INT AS child, c.kind, c.tokens, c.seq::INT AS seq, c.stable_key, p.stable_key AS parent_key,
  CASE WHEN c.kind = 1 THEN lag(c.stable_key) OVER n END AS prev_key, CASE WHEN c.kind = 1 THEN lead(c.stable_key) OVER n END AS next_key
FROM stable c LEFT JOIN stable p ON c.kind = 1 AND p.kind = 0 AND p.page_id = c.page_id AND p.section = c.section AND p.parent = c.parent WINDOW n AS (PARTITION BY c.page_id, c.kind ORDER BY c.seq)""")
def plan_chunks(spark, d):
    planned = K.plan_chunks(B.build_sections(B.heading_paths(I.blocks(spark, d))))
    return K.link_chunks(planned).select("page_id", "section", "parent", "child", "kind", "tokens", "seq", "stable_key", "parent_key", "prev_key", "next_key")


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, text, {_TIDY.format("coalesce(text, '')")} AS tidy FROM documents),
w AS (SELECT doc_id AS id, text, {_TOKENS.format("text")} AS tokens FROM t WHERE tidy <> ''), long AS (SELECT id, text FROM w WHERE tokens > 400), {_windows("r", "long", 400, 48)}
SELECT id, 0 AS n, length(text)::INT AS chars, tokens FROM w WHERE tokens <= 400 UNION ALL SELECT id, k, length(text)::INT, {_TOKENS.format("text")} FROM r""")
def split_windows(spark, d):
    return K.split_column(I.table(spark, d, "documents"), "doc_id", "text", 400, 48).select("id", "n", F.length("window").alias("chars"), T.token_count(F.col("window")).alias("tokens"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM documents)
SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM w WHERE term NOT IN ('', 'the', 'of', 'and') GROUP BY 1, 2""")
def chunk_terms(spark, d):
    return R.chunk_terms(I.table(spark, d, "documents"), ("doc_id",), F.col("text"), ("the", "of", "and"))


@query()
def stemmed_terms(spark, d):
    """Postings of Porter stems."""
    return R.chunk_terms(I.table(spark, d, "documents"), ("doc_id",), F.col("text"), ("the", "of", "and"), stems=True)


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, length(t)::DOUBLE AS chars, (length(t) - length(replace(t, ' ', '')))::DOUBLE AS spaces, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS e, (length(t) - length(replace(t, chr(10), '')))::DOUBLE AS lines FROM t""")
def embed_texts(spark, d):
    """Each distinct text once, in slices that are kept; the embedder counts some signs of the whole text."""
    signs = lambda texts: [[float(len(t)), *(float(t.count(c)) for c in " e\n")] for t in texts]
    rows = K.embed_once(I.table(spark, d, "documents").select("doc_id", "text"), signs, new_path(spark, "vectors"))
    return rows.select("doc_id", *(F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(("chars", "spaces", "e", "lines"))))


@query(r"""
WITH a AS (SELECT doc_id // 180 AS page_id, doc_id, CAST(doc_id AS VARCHAR) AS id, 'T' || doc_id AS title, text, n_chars FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY id) AS r FROM a),
k AS (SELECT * FROM r WHERE r <= 200 AND doc_id % 6 > 0 AND n_chars <= 20971520 AND trim(coalesce(text, '')) <> '')
SELECT page_id, CAST(2 * (r - 1) AS INT) AS n, 'heading' AS kind, 1 AS level, sha256(title) AS text_sha256, ['Attachments', title] AS path FROM k
UNION ALL SELECT page_id, CAST(2 * (r - 1) + 1 AS INT), 'paragraph', 0, sha256(text), ['Attachments', title] FROM k""")
def attachment_blocks(spark, d):
    a = I.table(spark, d, "documents").select(F.expr("doc_id div 180").alias("page_id"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 6 > 0, "/x").alias("link"), F.col("n_chars").alias("file_size"), "text")
    return P.attachment_blocks(a).select("page_id", "n", "kind", "level", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "path")


@query(r"""
WITH f AS (SELECT doc_id, 'd' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.HTML' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' WHEN 4 THEN '.pdf' ELSE '' END AS path,
  CASE doc_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'html' WHEN 2 THEN 'markdown' WHEN 3 THEN 'text' WHEN 4 THEN 'pdf' ELSE 'text' END AS method, coalesce(text, '') AS t, lang, source FROM documents)
SELECT path, method, method = 'pdf' AS needs_ocr, sha256(CASE method WHEN 'csv' THEN lang || ' | ' || source || ' | a "b", c' || chr(10) || doc_id || ' | ' || trim(replace(t, '"', ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(8199) || chr(8239) || chr(12288))
  WHEN 'html' THEN trim(regexp_replace(regexp_replace('<p class="x">' || t || '</p><br/>end', '<[^>]+>', ' ', 'g'), '[\s\x0B]+', ' ', 'g')) WHEN 'pdf' THEN ''
  ELSE trim(regexp_replace(chr(10) || ' ' || t || chr(9) || chr(10), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')) END) AS text_sha256 FROM f""")
def attachment_text(spark, d):
    """Whole documents as files of several kinds, by media type or extension; a csv has quotes, empty lines and many lines in a field."""
    docs = I.table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    kind = F.col("doc_id") % 6
    ending = F.element_at(_lit_array(".csv", ".HTML", ".md", ".txt", ".pdf", ""), (kind + 1).cast("int"))
    rows = F.concat("lang", F.lit(" , "), "source", F.lit(',"a ""b"", c"\n\n , \n'), F.col("doc_id").cast("string"), F.lit(',"'), F.replace("t", F.lit('"'), F.lit("")), F.lit('"\n'))
    body = F.when(kind == 0, rows).when(kind == 1, F.concat(F.lit('<p class="x">'), "t", F.lit("</p><br/>end"))).otherwise(F.concat(F.lit("\n "), "t", F.lit("\t\n")))
    files = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), ending).alias("path"), F.when(kind == 5, "text/plain").alias("media_type"), F.encode(body, "UTF-8").alias("content"))
    return P.attachment_text(files).select("path", "method", "needs_ocr", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query(r"""
SELECT o_orderstatus AS dataset, count(*) AS cases, round(avg(o_custkey % 7), 6)::DOUBLE AS mean, max(o_orderkey) AS last, (SELECT count(*) FROM orders) AS rows_written FROM orders GROUP BY 1""")
def write_report(spark, d):
    """Cases and their aggregates written as a report, twice, and read back."""
    cases = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("dataset"), (F.col("o_custkey") % 7).alias("score"))
    path = new_path(spark, "report")
    for part in (cases.where("case_id % 2 = 0"), cases):  # the later report replaces the earlier one
        G.write_report(part, part.groupBy("dataset").agg(F.count("*").alias("cases"), F.round(F.avg("score"), 6).alias("mean"), F.max("case_id").alias("last")), path)
    n = spark.read.parquet(f"{path}/cases").agg(F.count("*").alias("rows_written"), F.lit(1).alias("k"))
    said = spark.read.schema("dataset string, cases long, mean double, last long").json(f"{path}/aggregates")
    return said.join(F.broadcast(n), F.col("k") == 1).drop("k")


@query(r"""
SELECT conv_id AS query_id, list(conv_id * 100 + turn ORDER BY turn) FILTER (role = 'user') AS page_ids, count(*) FILTER (role = 'user') AS hits, conv_id % 1000 AS latency_ms FROM conversations GROUP BY conv_id""")
def append_trace(spark, d):
    """Traces of retrieval, appended in three runs and read back; queries are conversations, their hits the user's turns."""
    said = I.table(spark, d, "conversations")
    q = said.groupBy(F.col("conv_id").alias("query_id")).agg(F.max(F.lit("general")).alias("s")).select("query_id", F.array("s").alias("scopes"), (F.col("query_id") % 1000).alias("latency_ms"))
    hits = said.where("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), (F.col("conv_id") * 100 + F.col("turn")).alias("page_id"), F.col("turn").cast("string").alias("chunk_id"), F.lit(0.5).alias("score"))
    path = new_path(spark, "traces")
    for n in range(3):
        G.append_trace(G.traces(hits.where(F.col("query_id") % 3 == n), q.where(F.col("query_id") % 3 == n)), path)
    kept = spark.read.parquet(path)
    return kept.select("query_id", F.when(F.size("page_ids") > 0, F.col("page_ids")).alias("page_ids"), F.size("page_ids").cast("long").alias("hits"), "latency_ms")


# --- filters ------------------------------------------------------------------------------------


@query(f"""WITH {I.CHUNKS}, q AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN item_id % 20 END AS space, CASE WHEN item_id % 4 = 0 THEN [] ELSE ['src' || (item_id % 20), 'src' || (item_id % 7)] END AS sources,
 CASE WHEN item_id % 5 = 0 THEN ['*'] WHEN item_id % 5 = 1 THEN NULL WHEN item_id % 5 = 2 THEN [] ELSE ['en', 'general'] END AS scopes FROM benchmark)
SELECT item_id, count(*) AS chunks, count(*) FILTER (len(tags) = 0) AS untagged, sum(chunk_id)::BIGINT AS ids FROM q JOIN chunks ON list_contains(sources, source_id)
WHERE is_active AND page_status = 'current' AND (space IS NULL OR space_id = space) AND (coalesce(list_contains(scopes, '*'), false) OR len(tags) = 0 OR coalesce(list_has_any(tags, scopes), false)) GROUP BY item_id""")
def visible_chunks(spark, d):
    q = I.table(spark, d, "benchmark").selectExpr("item_id", "CASE WHEN item_id % 3 = 0 THEN item_id % 20 END AS space", "CASE WHEN item_id % 4 = 0 THEN cast(array() AS array<string>) ELSE array(concat('src', item_id % 20), concat('src', item_id % 7)) END AS sources", "CASE WHEN item_id % 5 = 0 THEN array('*') WHEN item_id % 5 = 1 THEN NULL WHEN item_id % 5 = 2 THEN cast(array() AS array<string>) ELSE array('en', 'general') END AS scopes")
    return V.visible_counts(q, V.visibility_cube(I.chunks(spark, d)), "item_id")


@query(r"""
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id % 20 AS VARCHAR) WHEN 1 THEN 'u' || (doc_id % 5) WHEN 2 THEN NULL ELSE '12x' END AS scope, CAST(substr(source, 4) AS BIGINT) AS page_space,
 CASE WHEN doc_id % 3 = 0 THEN ['u1', 'u2'] WHEN doc_id % 3 = 1 THEN [] END AS principals, upper(lang) || ' ' AS ask FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(scope, '[0-9]+') THEN CAST(scope AS BIGINT) END AS space_trust, CASE WHEN NOT regexp_full_match(scope, '[0-9]+') THEN scope END AS principal,
 CASE WHEN regexp_full_match(scope, '[0-9]+') THEN page_space = CAST(scope AS BIGINT) WHEN scope IS NULL THEN coalesce(len(principals), 0) = 0 ELSE coalesce(len(principals), 0) = 0 OR list_contains(principals, scope) END AS readable,
 CASE WHEN lower(trim(ask)) = 'en' THEN ['en', 'general'] ELSE ['fr', 'general'] END AS scopes FROM r""")
def access_rules(spark, d):
    r = I.table(spark, d, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN cast(doc_id % 20 AS string) WHEN 1 THEN concat('u', doc_id % 5) WHEN 2 THEN NULL ELSE '12x' END AS scope", "cast(substr(source, 4) AS bigint) AS page_space", "CASE WHEN doc_id % 3 = 0 THEN array('u1', 'u2') WHEN doc_id % 3 = 1 THEN cast(array() AS array<string>) END AS principals", "concat(upper(lang), ' ') AS ask")
    space, principal = V.classify_scope(F.col("scope"))
    return r.select("doc_id", space.alias("space_trust"), principal.alias("principal"), V.page_acl(F.col("page_space"), F.col("principals"), space, principal).alias("readable"), V.resolve_allowed_scopes(F.col("ask"), _lit_array("en", "fr"), F.lit("FR"), "general").alias("scopes"))


@query(r"""
WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['en', 'fr'] WHEN 1 THEN ['en', 'general'] WHEN 2 THEN ['other'] ELSE [] END AS own FROM documents)
SELECT doc_id, doc_id % 4 = 0 AS conflict, list_sort(list_distinct(CASE doc_id % 4 WHEN 1 THEN ['en', 'general', 'root'] ELSE ['root'] END)) AS tags FROM l""")
def label_tags(spark, d):
    labels = F.expr("CASE doc_id % 4 WHEN 0 THEN array(' EN', 'fr ') WHEN 1 THEN array('en', 'General', 'EN') WHEN 2 THEN array('other') ELSE NULL END")
    out = I.table(spark, d, "documents").select("doc_id", V.label_tags(labels, _lit_array("en", "fr", "general"), "general", _lit_array("root")).alias("t"))
    return out.select("doc_id", "t.conflict", "t.tags")


@query(r"""
WITH e AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [lang] END AS tags, doc_id % 2 = 0 AS is_active FROM documents), q AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 2 = 0 THEN ['en', 'fr'] ELSE ['de'] END AS scopes FROM (SELECT DISTINCT conv_id FROM conversations)),
j AS (SELECT query_id, entry_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY entry_id) AS INT) AS rank FROM q, e WHERE is_active AND (len(tags) = 0 OR list_has_any(tags, scopes)))
SELECT * FROM j WHERE rank <= 5""")
def curated_for_scope(spark, d):
    e = I.table(spark, d, "documents").selectExpr("doc_id AS entry_id", "CASE WHEN doc_id % 3 = 0 THEN cast(array() AS array<string>) ELSE array(lang) END AS tags", "doc_id % 2 = 0 AS is_active")
    q = I.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct().withColumn("scopes", F.when(F.col("query_id") % 2 == 0, _lit_array("en", "fr")).otherwise(_lit_array("de")))
    return V.curated_for_scope(q, e)


@query(r"""
WITH r AS (SELECT event_id AS request_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS integration FROM events)
SELECT request_id, CASE WHEN integration IS NULL THEN ['general'] WHEN integration = 'click' THEN ['a', 'b', 'general'] WHEN integration = 'view' THEN ['c', 'general'] END AS scopes, ['wiki'] AS sources, integration IS NULL OR integration IN ('click', 'view') AS accepted FROM r""")
def request_context(spark, d):
    r = I.table(spark, d, "events").selectExpr("event_id AS request_id", "CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS integration")
    i = G.integration_scopes(spark.createDataFrame([("click", "b"), ("click", "a"), ("view", "c")], "integration string, scope string"), "general")
    return V.request_context(r, i, "general", "wiki").select("request_id", "scopes", "sources", "accepted")


# --- changes ------------------------------------------------------------------------------------

_CLASSIFY = f"""{I.REGISTRY}, {I.INCOMING}, m AS (SELECT i.*, r.page_id IS NOT NULL AS known, i.status IN ('trashed', 'deleted', 'archived') AS gone, i.version > r.version AS newer, r.chunker_version <> 0 AS config,
 i.title IS DISTINCT FROM r.title AS c_title, i.parent_id IS DISTINCT FROM r.parent_id AS c_parent, i.labels_hash IS DISTINCT FROM r.labels_hash AS c_labels, i.attachment_manifest_hash IS DISTINCT FROM 'none' AS c_att,
 (CASE WHEN i.status = 'odd' THEN 'current' ELSE i.status END) IS DISTINCT FROM r.status AS c_status, i.access_scope_hash IS DISTINCT FROM r.access_scope_hash AS c_acl,
 i.content_hash IS NOT NULL AS fetched, i.content_hash IS DISTINCT FROM r.content_hash AS c_content, i.structure_hash IS DISTINCT FROM r.structure_hash AS c_struct FROM incoming i LEFT JOIN registry r USING (page_id)),
f AS (SELECT *, fetched AND c_content AND (newer OR config) AS changed FROM m),
g AS (SELECT *, list_sort(list_filter([CASE WHEN config THEN 'index_config_change' END, CASE WHEN c_title THEN 'title_changed' END, CASE WHEN c_parent THEN 'parent_changed' END, CASE WHEN c_labels THEN 'labels_changed' END,
 CASE WHEN c_acl THEN 'permissions_changed' END, CASE WHEN c_att THEN 'attachment_changed' END, CASE WHEN c_status THEN 'status_changed' END, CASE WHEN changed THEN CASE WHEN c_struct THEN 'section_updated' ELSE 'body_changed' END END], lambda x: x IS NOT NULL)) AS found FROM f),
h AS (SELECT *, CASE WHEN gone THEN ['status_changed'] WHEN NOT known THEN ['body_changed'] WHEN len(found) = 0 THEN ['no_change'] ELSE found END AS classes FROM g)"""


@query(f"""WITH {_CLASSIFY} SELECT page_id, classes, NOT gone AND (NOT known OR config OR (NOT fetched AND newer)) AS needs_body, NOT gone AND (NOT known OR config OR changed) AS needs_reembed, gone AS is_delete,
CASE WHEN NOT known THEN NOT gone WHEN gone THEN false ELSE newer OR config END AS body_fetch,
CASE WHEN gone THEN 'deactivated' WHEN NOT known OR list_has_any(classes, ['body_changed', 'section_updated', 'index_config_change']) THEN 'indexed' WHEN classes <> ['no_change'] THEN 'metadata_only' ELSE 'no_change' END AS action FROM h""")
def classify_changes(spark, d):
    return C.classify_changes(I.incoming(spark, d), I.registry(spark, d), I.TARGETS)


def _versions_of_lines(spark, d):
    lines = I.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    keys = lambda df: df.selectExpr("page_id", "cast(idx AS int) AS idx", "sha2(concat(idx, ':', line), 256) AS stable_key", "sha2(line, 256) AS content_key", "cast(idx AS string) AS positional_key")
    drop = F.col("idx") % 4 != F.col("page_id") % 4
    moved = lines.where(drop).withColumn("idx", F.row_number().over(Window.partitionBy("page_id").orderBy("idx")) - 1)
    edited = moved.withColumn("line", F.when(F.col("idx") % 5 == 2, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return keys(lines), keys(edited)


_DIFF = r"""l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS idx FROM documents),
e AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INT) AS idx, line FROM l WHERE idx % 4 <> page_id % 4),
n AS (SELECT page_id, idx, CASE WHEN idx % 5 = 2 THEN line || '!' ELSE line END AS line FROM e),
p1 AS (SELECT n.page_id, n.idx AS ni, l.idx AS oi FROM n JOIN l ON n.page_id = l.page_id AND n.idx = l.idx AND n.line = l.line),
n2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, line ORDER BY idx) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.page_id = n.page_id AND ni = idx)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, line ORDER BY idx) AS k FROM l WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.page_id = l.page_id AND oi = idx)),
p2 AS (SELECT n2.page_id, n2.idx AS ni, o2.idx AS oi FROM n2 JOIN o2 USING (page_id, line, k)),
n3 AS (SELECT page_id, idx FROM n2 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.page_id = n2.page_id AND ni = idx)),
o3 AS (SELECT page_id, idx FROM o2 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.page_id = o2.page_id AND oi = idx)),
p3 AS (SELECT page_id, idx FROM n3 JOIN o3 USING (page_id, idx))"""


@query(f"""WITH {_DIFF}
SELECT page_id, ni AS new_idx, oi AS old_idx, 'exact' AS outcome FROM p1 UNION ALL SELECT page_id, ni, oi, 'moved' FROM p2 UNION ALL SELECT page_id, idx, idx, 'edited' FROM p3
UNION ALL SELECT page_id, idx, NULL, 'inserted' FROM n3 ANTI JOIN p3 USING (page_id, idx) UNION ALL SELECT page_id, NULL, idx, 'deleted' FROM o3 ANTI JOIN p3 USING (page_id, idx)""")
def diff_chunks(spark, d):
    return C.diff_chunks(*_versions_of_lines(spark, d))


@query(f"""WITH {_DIFF}, allowed AS (SELECT doc_id AS page_id FROM documents WHERE doc_id % 4 > 0),
c AS (SELECT page_id, ni AS idx, oi FROM p1 UNION ALL SELECT page_id, ni, oi FROM p2)
SELECT page_id, n.idx, CASE WHEN oi IS NULL THEN 'embed' ELSE 'carried' END AS kind, CAST(oi AS DOUBLE) AS old_value FROM n LEFT JOIN (SELECT * FROM c SEMI JOIN allowed USING (page_id)) c USING (page_id, idx)""")
def reuse_embeddings(spark, d):
    """Pages with an id divisible by four had another embedding model or dimension: all of theirs is embedded anew."""
    old, new = _versions_of_lines(spark, d)
    had = old.withColumn("retrieval_text", F.col("content_key")).withColumn("embedding", F.array((F.col("idx") * 1.0).cast("float")))
    active = I.table(spark, d, "documents").selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 8 = 0 THEN 'old' ELSE 'm' END AS embedding_model", "CASE WHEN doc_id % 8 = 4 THEN 2 ELSE 1 END AS embedding_dim", "1 AS contextualization_version", "1 AS retrieval_schema_version")
    allowed = C.reuse_allowed(active, {"embedding_model": "m", "embedding_dim": 1, "contextualization_version": 1, "retrieval_schema_version": 1})
    carried, rest = C.reuse_embeddings(C.diff_chunks(old, new), had, new, allowed)
    none = F.lit(None).cast("double")
    return carried.select("page_id", "idx", F.lit("carried").alias("kind"), F.col("embedding")[0].cast("double").alias("old_value")).unionByName(rest.select("page_id", "idx", F.lit("embed").alias("kind"), none.alias("old_value")))


@query(f"""WITH {I.REGISTRY}, {I.INCOMING} SELECT coalesce(i.space_id, r.space_id) AS space_id, page_id, CASE WHEN i.title IS NULL THEN 'orphan' WHEN r.title IS NULL THEN 'new'
WHEN i.version > r.version OR i.status IS DISTINCT FROM r.status OR i.parent_id IS DISTINCT FROM r.parent_id OR i.title IS DISTINCT FROM r.title THEN 'drifted' ELSE 'unchanged' END AS drift FROM incoming i FULL JOIN registry r USING (page_id)""")
def drift_scan(spark, d):
    return C.drift_scan(I.incoming(spark, d), I.registry(spark, d))


@query(f"""WITH {I.REGISTRY}, {I.INCOMING}, cur AS (SELECT * FROM registry WHERE status = 'current')
SELECT page_id, 'purge' AS decision FROM cur WHERE space_id % 3 = 0 UNION ALL SELECT page_id, 'recheck' FROM cur ANTI JOIN incoming USING (page_id) WHERE space_id % 3 <> 0""")
def orphans(spark, d):
    r = I.registry(spark, d)
    return C.orphans(r, I.incoming(spark, d), r.where("space_id % 3 <> 0").select("page_id"), complete=False)


@query(r"""
WITH a AS (SELECT doc_id AS page_id, 'old' || (doc_id % 3) AS principal FROM documents), f AS (SELECT doc_id AS page_id, 'new' AS principal FROM documents WHERE doc_id % 5 < 3)
SELECT * FROM a WHERE page_id % 5 > 1 UNION ALL SELECT * FROM f WHERE page_id % 5 <= 1""")
def replace_restrictions(spark, d):
    docs = I.table(spark, d, "documents")
    return C.replace_restrictions(docs.selectExpr("doc_id AS page_id", "concat('old', doc_id % 3) AS principal"), docs.where("doc_id % 5 <= 1").selectExpr("doc_id AS page_id"), docs.where("doc_id % 5 < 3").selectExpr("doc_id AS page_id", "'new' AS principal"))


@query(f"""WITH {I.CHUNKS} SELECT chunk_id, CASE WHEN is_active AND page_id % 4 = 0 AND page_id % 8 > 0 THEN 'draft' ELSE page_status END AS page_status FROM chunks""")
def metadata_update(spark, d):
    c = I.chunks(spark, d)
    return C.metadata_update(c, c.where("page_id % 4 = 0").selectExpr("page_id", "CASE WHEN page_id % 8 > 0 THEN 'draft' END AS page_status"), ("page_status",), only_active=True).select("chunk_id", "page_status")


@query(r"""
WITH t AS (SELECT doc_id AS id, source AS title, n_chars FROM documents WHERE doc_id % 4 <> 0), f AS (SELECT doc_id AS id, upper(lang) AS title FROM documents WHERE doc_id % 6 = 0)
SELECT coalesce(t.id, f.id) AS id, CASE WHEN f.id IS NOT NULL THEN f.title ELSE t.title END AS title, n_chars FROM t FULL JOIN f USING (id)""")
def upsert(spark, d):
    docs = I.table(spark, d, "documents")
    return C.upsert(docs.where("doc_id % 4 <> 0").selectExpr("doc_id AS id", "source AS title", "n_chars"), docs.where("doc_id % 6 = 0").selectExpr("doc_id AS id", "upper(lang) AS title"), ("id",))


# --- scope and reconciliation -------------------------------------------------------------------


def _roots(spark):
    rows = [("space", 3, 3, ["a"], True), ("page", 5, 4, ["b"], True), ("page", 6, 4, ["b", "c"], True), ("page", 7, 6, ["d"], False), ("page", 20, 7, ["a"], True)]
    return spark.createDataFrame(rows, "root_type string, root_id long, space_id long, tags array<string>, is_active boolean")


_ROOTS = "roots AS (SELECT * FROM (VALUES ('space', 3, 3, ['a'], true), ('page', 5, 4, ['b'], true), ('page', 6, 4, ['b', 'c'], true), ('page', 7, 6, ['d'], false), ('page', 20, 7, ['a'], true)) v(root_type, root_id, space_id, tags, is_active))"
_COVER = f"""RECURSIVE {I.REGISTRY}, {_ROOTS}, below AS (SELECT root_id, page_id FROM roots JOIN registry ON root_type = 'page' AND root_id = page_id UNION SELECT b.root_id, r.page_id FROM below b JOIN registry r ON r.parent_id = b.page_id),
cover AS (SELECT 'page' AS root_type, * FROM below UNION ALL SELECT 'space', root_id, page_id FROM roots JOIN registry r ON root_type = 'space' AND r.space_id = root_id)"""


@query(f"WITH {_COVER} SELECT root_type, CAST(root_id AS BIGINT) AS root_id, page_id FROM cover")
def subtree_coverage(spark, d):
    return O.subtree_coverage(I.registry(spark, d), _roots(spark).select("root_type", "root_id"))


@query(f"""WITH {_COVER}, own AS (SELECT c.page_id, list_sort(list_distinct(flatten(list(r.tags)))) AS tags FROM cover c JOIN roots r ON c.root_type = r.root_type AND c.root_id = r.root_id WHERE is_active GROUP BY 1)
SELECT space_id, page_id, [] AS tags FROM registry WHERE space_id NOT IN (SELECT space_id FROM roots) UNION ALL SELECT space_id, page_id, tags FROM own JOIN registry USING (page_id) WHERE space_id IN (SELECT space_id FROM roots)""")
def resolve_space_scope(spark, d):
    return O.resolve_space_scope(I.registry(spark, d), _roots(spark))


@query(f"""WITH {I.CHUNKS}, b AS (SELECT page_id, NOT list_has_any(tags, ['en', 'fr']) AS bare FROM chunks WHERE is_active)
SELECT page_id, count(*) AS uncovered, (SELECT count(*) FROM b) AS active, (SELECT count(*) FROM b WHERE bare) = 0 AS ready FROM b WHERE bare GROUP BY page_id""")
def scope_coverage(spark, d):
    total, pages = O.scope_coverage(I.chunks(spark, d), ["en", "fr"])
    return pages.join(F.broadcast(total.select("active", "ready", F.lit(1).alias("k"))), F.col("k") == 1).drop("k")


@query(f"""WITH {I.CHUNKS}, g AS (SELECT unnest(list_distinct(tags)) AS name FROM chunks WHERE len(tags) > 0)
SELECT 'source' AS kind, source_id AS name, count(*) AS total, 0 AS unscoped, count(*) AS own, 0 AS bogus, true AS passed FROM chunks GROUP BY 2
UNION ALL SELECT 'tag', name, count(*), 0, count(*), 0, true FROM g GROUP BY 2""")
def isolation_check(spark, d):
    return O.isolation_check(I.chunks(spark, d), "general")


@query(f"""WITH {I.REGISTRY}, {_ROOTS} SELECT space_id FROM registry UNION SELECT space_id FROM roots""")
def known_spaces(spark, d):
    return O.known_spaces(I.registry(spark, d), _roots(spark))


@query(f"""WITH {I.REGISTRY}, {I.INCOMING}, x AS (SELECT page_id, coalesce(i.space_id, r.space_id) AS run_id, CASE WHEN i.title IS NULL THEN 'orphan' WHEN r.title IS NULL THEN 'new'
WHEN i.version > r.version OR i.status IS DISTINCT FROM r.status OR i.parent_id IS DISTINCT FROM r.parent_id OR i.title IS DISTINCT FROM r.title THEN 'drifted' ELSE 'unchanged' END AS drift FROM incoming i FULL JOIN registry r USING (page_id))
SELECT run_id, count(*) FILTER (drift <> 'orphan') AS scanned, count(*) FILTER (drift = 'drifted') AS drifted, count(DISTINCT page_id) FILTER (drift IN ('new', 'drifted')) AS requests, count(*) FILTER (drift = 'orphan') AS orphans_removed,
 CAST(len(coalesce(list(page_id) FILTER (drift = 'new'), [])) AS INT) AS n_new, CAST(CASE WHEN run_id = 1 THEN 2 ELSE 0 END AS BIGINT) AS errors, CASE WHEN run_id = 1 THEN 'failed' ELSE 'completed' END AS status FROM x GROUP BY run_id""")
def reconciliation_report(spark, d):
    drift, decided, asked, errors = _run(spark, d)
    return O.reconciliation_report(drift, decided, asked, errors).select("run_id", "scanned", "drifted", "requests", "orphans_removed", F.col("new").alias("n_new"), "errors", "status")


@query(f"""WITH {I.REGISTRY}, {I.INCOMING} SELECT coalesce(i.space_id, r.space_id) AS run_id, CASE WHEN i.title IS NULL THEN 'orphan' WHEN r.title IS NULL THEN 'new' ELSE 'drifted' END AS kind, page_id FROM incoming i FULL JOIN registry r USING (page_id)
WHERE i.title IS NULL OR r.title IS NULL OR i.version > r.version OR i.status IS DISTINCT FROM r.status OR i.parent_id IS DISTINCT FROM r.parent_id OR i.title IS DISTINCT FROM r.title""")
def report_pages(spark, d):
    return O.report_pages(*_run(spark, d)[:2])


def _run(spark, d):
    """A run for each space.""" 
    drift = C.drift_scan(I.incoming(spark, d), I.registry(spark, d)).withColumn("run_id", F.col("space_id"))
    decided = drift.where("drift = 'orphan'").select("run_id", "page_id", F.lit("purge").alias("decision"))
    asked = drift.where("drift IN ('new', 'drifted')").select("run_id", F.concat_ws(":", F.lit("sync_page"), F.col("page_id").cast("string")).alias("idempotency_key"))
    errors = spark.createDataFrame([(1,), (1,)], "run_id long")
    return drift, decided, asked, errors


@query(r"""
WITH p AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN ['u' || (doc_id % 5)] ELSE [] END AS users, CASE WHEN doc_id % 4 = 0 THEN ['g1'] WHEN doc_id % 4 = 1 THEN ['g9'] ELSE [] END AS groups FROM documents),
m AS (SELECT * FROM (VALUES ('g1', 'u1'), ('g1', 'z')) v(g, a)),
x AS (SELECT page_id, unnest(users) AS a FROM p UNION SELECT page_id, a FROM (SELECT page_id, unnest(groups) AS g FROM p) JOIN m USING (g))
SELECT page_id, coalesce((SELECT list(a ORDER BY a) FROM x WHERE x.page_id = p.page_id), ['__nobody__']) AS principals FROM p WHERE len(users) + len(groups) > 0""")
def expand_groups(spark, d):
    r = I.table(spark, d, "documents").selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 3 = 0 THEN array(concat('u', doc_id % 5)) END AS users", "CASE WHEN doc_id % 4 = 0 THEN array('g1') WHEN doc_id % 4 = 1 THEN array('g9') END AS groups")
    return P.expand_groups(r, spark.createDataFrame([("g1", "u1"), ("g1", "z")], "group_id string, account_id string"))


# --- events -------------------------------------------------------------------------------------


@query(f"WITH {I.EVENTS} SELECT event_id, event_type, page_id, cf_version, space_id, status, actor_account_id, delivery_id, event_timestamp FROM parsed")
def parse_events(spark, d):
    return N.parse_events(I.raw_events(spark, d)).select("event_id", "event_type", "page_id", "cf_version", "space_id", "status", "actor_account_id", "delivery_id", "event_timestamp")


@query(f"""WITH {I.EVENTS} SELECT event_id, sha256(encode('{{"cf_version":' || coalesce(CAST(cf_version AS VARCHAR), 'null') || ',"delivery_id":' || coalesce('"' || delivery_id || '"', 'null') || ',"event_timestamp":"' || strftime(event_timestamp, '%Y-%m-%d %H:%M:%S')
 || '","event_type":"' || event_type || '","page_id":' || page_id || ',"space_id":' || space_id || ',"status":' || coalesce('"' || status || '"', 'null') || '}}') || '\\x1F'::BLOB) AS payload_hash FROM parsed""")
def event_payload_hash(spark, d):
    return N.with_hash(N.parse_events(I.raw_events(spark, d))).select("event_id", "payload_hash")


def _inserted(spark, d):
    return N.idempotent_insert(N.with_hash(V.subscribed_events(N.parse_events(I.raw_events(spark, d)), "u1")))


@query(f"WITH {I.EVENTS} SELECT event_id, event_type, self_generated FROM inserted")
def idempotent_insert(spark, d):
    return _inserted(spark, d).select("event_id", "event_type", "self_generated")


_KEYS = """asked AS (SELECT CASE WHEN event_type = 'space_updated' THEN 'reconcile_space:' || space_id || ':' || event_id WHEN event_type = 'page_trashed' THEN 'delete_page:' || page_id || ':' || event_type
 ELSE 'sync_page:' || page_id || ':' || event_type || ':' || coalesce(CAST(cf_version AS VARCHAR), 'na') || ':1' END AS idempotency_key, CASE WHEN event_type = 'page_trashed' THEN 50 ELSE 100 END AS priority, event_id FROM inserted WHERE NOT self_generated),
first AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY event_id) = 1)"""


@query(f"WITH {I.EVENTS}, {_KEYS} SELECT idempotency_key, priority, event_id, row_number() OVER (ORDER BY priority, event_id // 100, idempotency_key) AS position FROM first")
def requests_in_order(spark, d):
    asked = N.requests(_inserted(spark, d), 1).withColumn("available_at", F.expr("event_id div 100"))
    return N.request_order(asked).select("idempotency_key", "priority", "event_id", "position")


def _few(spark):
    """A session for a stream's keyed state: as many partitions as cores, not as many as large shuffles have."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(min(spark.sparkContext.defaultParallelism, 64)))
    return own


@query(f"WITH {I.EVENTS}, {_KEYS} SELECT idempotency_key, priority, event_id FROM first")
def stream_ingest_events(spark, d):
    """The same requests from a stream of deliveries in several batches; what came before is keyed state."""
    path, ledger, made, check = (new_path(spark, x) for x in ("deliveries", "ledger", "requests", "checkpoint"))
    raw = I.raw_events(spark, d)
    raw.write.parquet(path)
    J.ingest_events(_few(spark).readStream.schema(raw.schema).parquet(path), ledger, made, check, schema_version=1, service_account="u1")
    return spark.read.parquet(made).select("idempotency_key", F.col("priority").cast("int").alias("priority"), "event_id")


@query(f"""WITH {I.EVENTS}, k AS (SELECT * FROM parsed WHERE event_type <> 'page_trashed' AND cf_version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY cf_version DESC, event_timestamp DESC, event_id DESC) = 1)
SELECT event_id, page_id, cf_version FROM k UNION ALL SELECT event_id, page_id, cf_version FROM parsed WHERE event_type = 'page_trashed'""")
def stream_latest_page(spark, d):
    """Deliveries as a stream to the events that apply: deletions and each page's newest version."""
    path, out, check = (new_path(spark, x) for x in ("events", "applied", "checkpoint"))
    events = N.parse_events(I.raw_events(spark, d)).drop("payload")
    events.write.parquet(path)
    J.stream_latest_page(_few(spark).readStream.schema(events.schema).parquet(path), out, check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "page_id", "cf_version")


def _dealt(df, path, batches):
    """``df`` written for a stream of so many batches; the files of each, as many as ``df`` has partitions in all, so that no task takes a whole batch."""
    files = max(1, -(-df.rdd.getNumPartitions() // batches))
    df.repartition(batches * files).write.parquet(path)
    return files


@query(r"""
WITH v AS (SELECT doc_id // 5 AS page_id, doc_id % 5 AS cf_version, CASE WHEN doc_id % 5 = 4 AND doc_id // 5 % 7 = 0 THEN 'trashed' ELSE 'current' END AS status, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')) AS n FROM documents),
newest AS (SELECT * FROM v WHERE status = 'trashed' OR n > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY cf_version DESC) = 1)
SELECT page_id, cf_version, n AS chunks FROM newest WHERE status <> 'trashed'""")
def stream_versions(spark, d):
    """Documents as versions of pages, in four batches in no order of versions: lines are chunks; what is active in the end."""
    path, index, check = (new_path(spark, x) for x in ("pages", "index", "checkpoint"))
    status = "CASE WHEN doc_id % 5 = 4 AND doc_id div 5 % 7 = 0 THEN 'trashed' ELSE 'current' END AS status"
    pages = I.table(spark, d, "documents").selectExpr("doc_id div 5 AS page_id", "doc_id % 5 AS cf_version", status, "text")
    files = _dealt(pages, path, 4)
    lines = lambda df: df.select("page_id", "cf_version", F.posexplode(F.split("text", "\n")).alias("seq", "line")).where("line <> ''")
    source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", files).parquet(path)
    J.stream_versions(source, check, lines, index, 16).trigger(availableNow=True).start().awaitTermination()
    return J.active_chunks(spark, index).groupBy("page_id", "cf_version").agg(F.count("*").alias("chunks"))


@query(f"""WITH {I.EVENTS}, t AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY cf_version DESC, event_timestamp DESC, event_id DESC) = 1)
SELECT page_id, cf_version, event_id FROM t WHERE cf_version > page_id % 120""")
def latest_version(spark, d):
    events = N.parse_events(I.raw_events(spark, d)).select("page_id", "cf_version", "event_timestamp", "event_id")
    known = events.select("page_id").distinct().withColumn("version", F.col("page_id") % 120)
    return C.latest_version(events, known).select("page_id", "cf_version", "event_id")


_HITS = "n AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {_HITS}, s AS (SELECT user_id, event_id, i, true AS allowed, [t] AS a FROM n WHERE i = 1
UNION ALL SELECT user_id, event_id, i, len(a) < 2, CASE WHEN len(a) < 2 THEN list_append(a, t) ELSE a END
FROM (SELECT n.user_id, n.event_id, n.i, n.t, list_filter(s.a, lambda x: x >= n.t - 86400000000 * 7) AS a FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1))
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS hit_id, allowed FROM s""")
def rate_limit(spark, d):
    hits = I.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), "ts")
    return S.rate_limit(hits, most=2, seconds=7 * 86_400).select("key", "hit_id", "allowed")


@query(f"""WITH RECURSIVE {_HITS}, s AS (SELECT user_id, event_id, i, false AS replayed, t AS at FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.event_id, n.i, n.t - s.at <= 86400000000 * 5, CASE WHEN n.t - s.at <= 86400000000 * 5 THEN s.at ELSE n.t END FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS hit_id, replayed FROM s""")
def ttl_replay(spark, d):
    asks = I.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), "ts")
    return S.ttl_replay(asks, seconds=5 * 86_400).select("key", "hit_id", "replayed")


# --- versions -----------------------------------------------------------------------------------


def _versions(spark, d):
    docs = I.table(spark, d, "documents")
    v = docs.selectExpr("doc_id AS version_id", "doc_id div 5 AS page_id", "cast(doc_id % 5 AS int) AS cf_version", "1 AS parser_version", "1 AS chunker_version", "1 AS contextualization_version", "1 AS retrieval_schema_version", "'m' AS embedding_model", "CASE doc_id % 5 WHEN 4 THEN 'active' WHEN 3 THEN 'failed' ELSE 'superseded' END AS state", "timestamp_seconds(doc_id) AS activated_at", "CASE WHEN doc_id % 5 < 3 THEN timestamp_seconds(doc_id * 10) END AS superseded_at")
    c = docs.selectExpr("doc_id AS chunk_id", "doc_id AS version_id", "doc_id div 5 AS page_id", "1 AS kind", "doc_id % 5 = 4 AS is_active", "'current' AS page_status", "sha2(text, 256) AS stable_key", "'s' AS section_key", "0 AS parent", "cast(doc_id % 2 AS int) AS seq")
    r = docs.where("doc_id % 5 = 4").selectExpr("doc_id div 5 AS page_id", "'current' AS status", "doc_id AS active_version_id", "4 AS cf_version", "1 AS parser_version", "1 AS chunker_version", "1 AS contextualization_version", "1 AS retrieval_schema_version", "'m' AS embedding_model")
    return v, c, r


@query(r"""
WITH b AS (SELECT doc_id + 1000000 AS version_id, doc_id // 5 AS page_id, CAST(doc_id % 7 AS INT) AS cf_version FROM documents), n AS (SELECT min(version_id) AS version_id, page_id, cf_version FROM b WHERE cf_version > 4 GROUP BY 2, 3)
SELECT version_id, page_id, cf_version, CASE WHEN version_id % 2 = 0 THEN 1 ELSE 0 END AS children, CASE WHEN version_id % 2 = 0 THEN 'staging' ELSE 'failed' END AS state FROM n WHERE page_id IN (SELECT doc_id // 5 FROM documents)""")
def stage_versions(spark, d):
    v, _, _ = _versions(spark, d)
    b = I.table(spark, d, "documents").selectExpr("doc_id + 1000000 AS version_id", "doc_id div 5 AS page_id", "cast(doc_id % 7 AS int) AS cf_version", "1 AS parser_version", "1 AS chunker_version", "1 AS contextualization_version", "1 AS retrieval_schema_version", "'m' AS embedding_model").where("cf_version <= 4 AND exists(array(page_id), x -> false) OR cf_version > 4")
    chunks = b.where("version_id % 2 = 0").selectExpr("version_id", "1 AS kind")
    return W.stage_versions(b, v, chunks).select("version_id", "page_id", "cf_version", "children", "state")


@query(r"""
WITH v AS (SELECT doc_id AS version_id, doc_id // 5 AS page_id, doc_id % 5 AS n FROM documents), t AS (SELECT page_id, version_id AS t FROM v WHERE page_id % 3 = 0 AND n = 1)
SELECT version_id, page_id, CASE WHEN version_id = t THEN 'active' WHEN n = 4 AND t IS NOT NULL THEN 'superseded' WHEN n = 4 THEN 'active' WHEN n = 3 THEN 'failed' ELSE 'superseded' END AS state,
 CASE WHEN t IS NOT NULL THEN version_id = t ELSE n = 4 END AS chunk_active, CASE WHEN t IS NOT NULL AND (SELECT count(*) FROM v w WHERE w.page_id = v.page_id AND n = 4) > 0 THEN t WHEN (SELECT count(*) FROM v w WHERE w.page_id = v.page_id AND n = 4) > 0 THEN page_id * 5 + 4 END AS pointer FROM v LEFT JOIN t USING (page_id)""")
def activate_and_roll_back(spark, d):
    v, c, r = _versions(spark, d)
    chosen = v.where("page_id % 3 = 0 AND cf_version = 1").select("page_id", "version_id").unionByName(v.where("page_id % 3 = 1 AND cf_version = 3").select("page_id", "version_id"))
    v, c, r = W.activate(v, c, r, chosen, "2030-01-01 00:00:00")
    return v.select("version_id", "page_id", "state").join(c.select("version_id", F.col("is_active").alias("chunk_active")), "version_id").join(r.select("page_id", F.col("active_version_id").alias("pointer")), "page_id", "left")


@query(r"""
SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 4 AND doc_id // 5 % 4 = 0 THEN 'trashed' ELSE 'current' END AS page_status, doc_id % 5 = 4 AND doc_id // 5 % 4 <> 0 AS is_active FROM documents""")
def deactivate_pages(spark, d):
    _, c, r = _versions(spark, d)
    gone = c.where("page_id % 4 = 0").select("page_id", F.lit("trashed").alias("status")).distinct()
    return W.deactivate_pages(r, c, gone)[1].select("chunk_id", "page_status", "is_active")


@query(r"""
SELECT doc_id AS version_id, CASE doc_id % 5 WHEN 4 THEN 'active' WHEN 3 THEN 'failed' ELSE 'superseded' END AS state, true AS has_chunk FROM documents
WHERE doc_id % 5 > 2 OR (SELECT count(*) FROM documents o WHERE o.doc_id // 5 = documents.doc_id // 5 AND o.doc_id % 5 < 3 AND o.doc_id > documents.doc_id) < 2""")
def collect_superseded(spark, d):
    v, c, _ = _versions(spark, d)
    v, c = W.collect_superseded(v, c)
    return v.select("version_id", "state").join(c.select("version_id", F.lit(True).alias("has_chunk")), "version_id")


@query(r"""
SELECT 'stable_key' AS rule, concat_ws('|', doc_id // 50, sha256(text)) AS key, count(*) AS n FROM documents GROUP BY doc_id // 50, sha256(text) HAVING count(*) > 1
UNION ALL SELECT 'parent_first', concat_ws('|', doc_id // 50, 's', 0), count(*) FROM documents GROUP BY doc_id // 50
UNION ALL SELECT 'one_active', CAST(doc_id // 5 AS VARCHAR), count(*) FROM documents WHERE doc_id % 5 = 4 OR doc_id % 5 = 2 AND doc_id // 5 % 7 = 0 GROUP BY doc_id // 5 HAVING count(*) > 1
UNION ALL SELECT 'pointer', CAST(CASE WHEN doc_id // 5 % 6 = 1 THEN doc_id - 5 ELSE doc_id END AS VARCHAR) AS k, count(*) FROM documents WHERE doc_id % 5 = 4 GROUP BY k HAVING count(*) > 1""")
def violations(spark, d):
    """With second active versions and shared pointers planted, so that each rule is broken somewhere."""
    v, c, r = _versions(spark, d)
    v = v.withColumn("state", F.when((F.col("cf_version") == 2) & (F.col("page_id") % 7 == 0), "active").otherwise(F.col("state")))
    r = r.withColumn("active_version_id", F.col("active_version_id") - F.when(F.col("page_id") % 6 == 1, 5).otherwise(0))
    return W.violations(v, c.withColumn("version_id", F.expr("version_id div 50")), r)


# --- search and evaluation ----------------------------------------------------------------------

_KEYWORD = r"""terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark),
q AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n FROM terms WHERE term <> ''),
w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w SEMI JOIN q USING (term) GROUP BY 1, 2),
sums AS (SELECT tf, sum(1 / CAST(j * j AS DOUBLE)) AS w FROM (SELECT DISTINCT tf FROM tf) JOIN (SELECT unnest(range(1, (SELECT max(tf) + 1 FROM tf))) AS j) ON j <= tf GROUP BY tf),
hit AS (SELECT query_id, doc_id, sum(CAST(round(w / n * 1e9) AS BIGINT)) / 1e9 AS score FROM tf JOIN sums USING (tf) JOIN q USING (term) GROUP BY 1, 2)"""


def _questions(spark, d):
    return I.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _postings(spark, d, stop=()):
    """Postings of the questions' terms alone."""
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.chunk_terms(docs, ("chunk_id",), F.col("text"), stop, only=R.asked_terms(_questions(spark, d), stop))


def _pages(spark, d):
    return I.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("page_id"))


@query(f"""WITH {_KEYWORD}, r AS (SELECT query_id, doc_id AS page_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, doc_id) AS INT) AS rank FROM hit)
SELECT query_id, page_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""")
def keyword_search(spark, d):
    found = R.keyword_search(_questions(spark, d), _postings(spark, d), _pages(spark, d), k=10)
    return found.select("query_id", "page_id", F.round("score", 5).alias("score"), "rank")


@query(r"""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id AS chunk_id, round(1 - list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 9) AS distance FROM q, embeddings),
r AS (SELECT query_id, chunk_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank FROM p)
SELECT * FROM r WHERE rank <= 20""")
def dense_search(spark, d):
    e = I.table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = R.dense_search(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("page_id"), "embedding"), k=20)
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


def _lists(spark, d):
    o = I.table(spark, d, "orders").select(F.expr("o_custkey div 10").alias("query_id"), F.expr("o_custkey div 10 * 100 + o_orderkey % 97").alias("page_id"), "o_orderkey", "o_totalprice")
    nth = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    a = o.withColumn("rank", nth("o_totalprice", "o_orderkey")).where("rank <= 75")
    b = o.withColumn("rank", nth(F.desc("o_orderkey"))).where("rank <= 75")
    return R.dedupe_ranked(a), R.dedupe_ranked(b)


_FUSE = """o AS (SELECT o_custkey // 10 AS query_id, o_custkey // 10 * 100 + o_orderkey % 97 AS page_id, o_orderkey, o_totalprice FROM orders),
a0 AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY o_totalprice, o_orderkey) AS r FROM o), b0 AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY o_orderkey DESC) AS r FROM o),
a1 AS (SELECT query_id, page_id, min(r) AS r FROM a0 WHERE r <= 75 GROUP BY 1, 2), b1 AS (SELECT query_id, page_id, min(r) AS r FROM b0 WHERE r <= 75 GROUP BY 1, 2),
a AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS r FROM a1), b AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS r FROM b1),
fused AS (SELECT query_id, page_id, a.r AS ka, b.r AS kb, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 12) AS rrf FROM a FULL JOIN b USING (query_id, page_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(ka, 1000000), page_id) AS rank FROM fused)"""


@query(f"WITH {_FUSE} SELECT query_id, page_id, round(rrf, 9) AS rrf, CAST(rank AS INT) AS rank FROM ranked")
def rrf_fuse(spark, d):
    a, b = _lists(spark, d)
    return R.fused_order(R.rrf_fuse({"keyword": a, "dense": b})).select("query_id", "page_id", F.round("rrf", 9).alias("rrf"), "rank")


@query(f"""WITH {_FUSE}, acl AS (SELECT *, page_id % 10 AS space FROM ranked WHERE CASE WHEN query_id % 3 = 0 THEN page_id % 10 = query_id % 10 WHEN query_id % 3 = 1 THEN page_id % 4 <> 0 ELSE page_id % 4 <> 0 OR query_id % 2 = 0 END),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM acl)
SELECT query_id, page_id, CAST(r AS INT) AS rank, CAST(least(n, 20) - r + 1 AS DOUBLE) AS score FROM cut WHERE r <= 5""")
def hybrid_retrieve(spark, d):
    a, b = _lists(spark, d)
    ranked = R.fused_order(R.rrf_fuse({"keyword": a, "dense": b}))
    pages = I.table(spark, d, "orders").select(F.expr("o_custkey div 10 * 100 + o_orderkey % 97").alias("page_id")).distinct()
    reg = pages.withColumn("space_id", F.col("page_id") % 10)
    acl = pages.where("page_id % 4 = 0").withColumn("principal", F.lit("u0"))
    q = I.table(spark, d, "orders").select(F.expr("o_custkey div 10").alias("query_id")).distinct().selectExpr("query_id", "CASE WHEN query_id % 3 = 0 THEN query_id % 10 END AS space_trust", "CASE WHEN query_id % 3 = 2 THEN concat('u', query_id % 2) END AS principal")
    ok = R.allowed(R.attach_acl(ranked, reg, acl), q)
    return R.identity_rerank(R.rerank_cut(ok, 20)).select("query_id", "page_id", "rank", "score")


@query(f"""WITH {I.CHUNKS} SELECT space_id AS page_id, min(chunk_id) AS chunk_id FROM chunks WHERE is_active AND page_status = 'current' AND space_id % 2 = 0 GROUP BY 1""")
def representative_chunk(spark, d):
    c = I.chunks(spark, d).where(V.base_filter()).select(F.col("space_id").alias("page_id"), "chunk_id", F.col("chunk_id").alias("seq"))
    return R.representative_chunk(c.where("page_id % 2 = 0"), c).select("page_id", "chunk_id")


@query(r"""
SELECT c.conv_id, c.turn, sha256(p.text) AS parent_sha256 FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user' WHERE c.role <> 'user' AND c.turn % 6 <> 5""")
def parent_context(spark, d):
    """Replies as children of the user's turn before; some name a parent that isn't there."""
    conv = I.table(spark, d, "conversations")
    key = lambda n: F.concat_ws("/", F.col("conv_id").cast("string"), n.cast("string"))
    every = conv.select(key(F.col("turn")).alias("chunk_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("kind"), "text")
    replies = conv.where("role <> 'user'").select("conv_id", "turn", F.when(F.col("turn") % 6 != 5, key(F.col("turn") - 1)).otherwise(F.lit("none")).alias("parent_id"))
    return R.parent_context(replies, every).select("conv_id", "turn", F.sha2(F.encode("parent_text", "UTF-8"), 256).alias("parent_sha256"))


@query(r"""
WITH h AS (SELECT conv_id AS query_id, turn AS rank, role AS title, text FROM conversations), c AS (SELECT DISTINCT conv_id AS query_id, 0 AS part, 7 AS rank, 'Note' AS title, 'Body' AS text FROM conversations WHERE conv_id % 2 = 0),
b AS (SELECT query_id, part, rank, title, text FROM c UNION ALL SELECT query_id, 1, rank, title, text FROM h), m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS m FROM b)
SELECT query_id, sha256(rtrim(string_agg('[' || m || '] ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY m))) AS evidence_sha256, count(*) AS n FROM m GROUP BY 1""")
def evidence(spark, d):
    conv = I.table(spark, d, "conversations")
    hits = conv.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("turn").alias("page_id"), F.col("role").alias("title"), F.col("text").alias("parent_text"))
    cur = conv.where("conv_id % 2 = 0").selectExpr("conv_id AS query_id", "3L AS entry_id", "7L AS rank", "'Note' AS title", "'Body' AS body").distinct()
    return R.evidence(hits, cur).select("query_id", F.sha2(F.encode("evidence", "UTF-8"), 256).alias("evidence_sha256"), F.size("markers").cast("long").alias("n"))


@query(r"""
WITH m AS (SELECT conv_id AS query_id, turn AS marker, role AS title FROM conversations), q AS (SELECT DISTINCT conv_id AS query_id FROM conversations)
SELECT query_id, marker, title, NULL AS reason FROM m WHERE query_id % 3 > 0 AND marker IN (0, 1) UNION ALL SELECT query_id, NULL, NULL, 'no_citations' FROM q WHERE query_id % 3 = 0""")
def citation_rows(spark, d):
    conv = I.table(spark, d, "conversations")
    markers = conv.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("marker"), F.col("turn").alias("page_id"), F.col("role").alias("title"), F.lit("u").alias("url"))
    answers = conv.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_sort(F.collect_set(F.when((F.col("conv_id") % 3 > 0) & (F.col("turn") < 2), F.col("turn")))).alias("used"))
    return R.citation_rows(answers, markers).select("query_id", "marker", "title", "reason")


@query(r"""
SELECT event_id AS query_id, CASE WHEN (event_type = 'error' OR value / 100 < 0.05) AND event_id % 4 > 0 AND event_id % 5 > 0 AND (event_type = 'error' OR value / 50 > value / 100) THEN 'retry' ELSE 'first' END AS picked FROM events""")
def crag_pick(spark, d):
    e = I.table(spark, d, "events")
    first = e.select(F.col("event_id").alias("query_id"), F.lit("q").alias("query"), F.when(F.col("event_type") != "error", F.col("value") / 100).alias("top_score"))
    retry = e.where("event_id % 5 > 0").select(F.col("event_id").alias("query_id"), F.when(F.col("event_id") % 4 > 0, "r").otherwise("q").alias("rewritten"), (F.col("value") / 50).alias("top_score"))
    return R.crag_pick(first, retry)


@query(f"""WITH {_FUSE} SELECT query_id, string_agg(page_id, ',' ORDER BY rank) AS page_ids, round(sum(round(rrf, 9)), 6) AS score, list(CAST(page_id AS VARCHAR) ORDER BY rank) AS chunk_ids, ['general'] AS scopes, 5 AS latency_ms FROM ranked WHERE rank <= 5 GROUP BY 1""")
def traces(spark, d):
    a, b = _lists(spark, d)
    hits = R.fused_order(R.rrf_fuse({"keyword": a, "dense": b})).where("rank <= 5").select("query_id", "rank", "page_id", F.col("page_id").cast("string").alias("chunk_id"), F.round("rrf", 9).alias("score"))
    q = a.select("query_id").distinct().withColumn("scopes", _lit_array("general")).withColumn("latency_ms", F.lit(5))
    out = G.traces(hits, q)
    return out.select("query_id", F.array_join(F.transform("page_ids", lambda x: x.cast("string")), ",").alias("page_ids"), F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6).alias("score"), "chunk_ids", "scopes", "latency_ms")


@query(r"""
WITH u AS (SELECT user_id AS query_id, max_by(event_type, event_id) FILTER (event_id % 3 = 0) AS answer, max_by(CAST(event_id % 2 * 2 - 1 AS INT), event_id) AS feedback FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT query_id, coalesce(u.answer, 'none') AS answer, feedback, 'h' AS subject_hash FROM (SELECT DISTINCT user_id AS query_id FROM events) LEFT JOIN u USING (query_id)""")
def trace_updates(spark, d):
    e = I.table(spark, d, "events")
    t = e.select(F.col("user_id").alias("query_id")).distinct().selectExpr("query_id", "'none' AS answer", "cast(NULL AS int) AS feedback", "'h' AS subject_hash")
    u = e.where("user_id % 2 = 0").selectExpr("user_id AS query_id", "event_id AS at", "CASE WHEN event_id % 3 = 0 THEN event_type END AS answer", "cast(event_id % 2 * 2 - 1 AS int) AS feedback", "cast(NULL AS string) AS subject_hash")
    return R.trace_updates(t, u)


_EVAL = f"""{_FUSE}, cs AS (SELECT DISTINCT query_id AS case_id FROM o), rel AS (SELECT DISTINCT query_id AS case_id, page_id AS id FROM o WHERE o_totalprice > 300000 AND query_id % 7 > 0)"""
_METRIC = """(SELECT c.case_id, count(DISTINCT rel.id) AS nr, count(DISTINCT rel.id) FILTER (x.rank <= {k}) AS h, min(x.rank) FILTER (x.rank <= {k}) AS f, coalesce(sum(1 / log2(x.rank + 1)) FILTER (x.rank <= {k}), 0) AS dcg
 FROM cs c LEFT JOIN rel USING (case_id) LEFT JOIN {r} x ON x.query_id = c.case_id AND x.page_id = rel.id GROUP BY 1)"""
_IDEAL = "(SELECT sum(1 / log2(i + 1)) FROM range(1, least(nr, {k}) + 1) t(i))"


@query(f"""WITH {_EVAL}, m AS {_METRIC.format(k=5, r='ranked')} SELECT case_id, round(CASE WHEN nr > 0 THEN h / nr ELSE 0 END, 6) AS recall, round(h / 5, 6) AS precision, round(coalesce(1 / f, 0), 6) AS mrr,
round(coalesce(dcg / {_IDEAL.format(k=5)}, 0), 6) AS ndcg, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, nr AS n_relevant FROM m""")
def case_metrics(spark, d):
    cases, ranked, _, relevant = _cases(spark, d)
    return E.case_metrics(cases, ranked, relevant, 5)


def _cases(spark, d):
    a, b = _lists(spark, d)
    o = I.table(spark, d, "orders").select(F.expr("o_custkey div 10").alias("case_id"), F.expr("o_custkey div 10 * 100 + o_orderkey % 97").alias("id"), "o_totalprice")
    by = lambda df: df.select(F.col("query_id").alias("case_id"), "rank", F.col("page_id").alias("id"))
    fused = R.fused_order(R.rrf_fuse({"keyword": a, "dense": b}))
    return o.select("case_id").distinct(), by(fused), by(a), o.where("o_totalprice > 300000 and case_id % 7 > 0").select("case_id", "id").distinct()


@query(f"""WITH {_EVAL}, m AS {_METRIC.format(k=5, r='ranked')}, z AS (SELECT case_id % 3 AS dataset, CASE WHEN nr > 0 THEN h / nr ELSE 0 END AS r, h / 5 AS p, coalesce(1 / f, 0) AS mrr, coalesce(dcg / {_IDEAL.format(k=5)}, 0) AS ndcg, CASE WHEN h > 0 THEN 1 ELSE 0 END AS hr FROM m)
SELECT dataset, count(*) AS cases, round(avg(round(r, 6)), 6) AS recall, round(avg(round(p, 6)), 6) AS precision, round(avg(round(mrr, 6)), 6) AS mrr, round(avg(round(ndcg, 6)), 6) AS ndcg, round(avg(hr), 6) AS hit_rate FROM z GROUP BY 1""")
def evaluate(spark, d):
    cases, ranked, _, relevant = _cases(spark, d)
    return E.evaluate(E.case_metrics(cases, ranked, relevant, 5).withColumn("dataset", F.col("case_id") % 3))


@query(f"""WITH {_EVAL}, ar AS (SELECT query_id, page_id, r AS rank FROM a), b5 AS {_METRIC.format(k=5, r='ar')}, b10 AS {_METRIC.format(k=10, r='ar')}, a5 AS {_METRIC.format(k=5, r='ranked')}, a10 AS {_METRIC.format(k=10, r='ranked')},
x AS (SELECT 'precision@5' AS metric, (SELECT avg(round(h / 5, 6)) FROM b5) AS b, (SELECT avg(round(h / 5, 6)) FROM a5) AS a UNION ALL SELECT 'ndcg@10', (SELECT avg(round(coalesce(dcg / {_IDEAL.format(k=10)}, 0), 6)) FROM b10), (SELECT avg(round(coalesce(dcg / {_IDEAL.format(k=10)}, 0), 6)) FROM a10))
SELECT metric, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta FROM x""")
def rerank_lift(spark, d):
    cases, ranked, before, relevant = _cases(spark, d)
    return E.rerank_lift(cases, before, ranked, relevant)


@query(r"""
SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_summary(spark, d):
    return E.latency_summary(I.table(spark, d, "events"), ["event_type"], "value")


@query(r"""
SELECT 'e2e_p95' AS name, round(quantile_cont(value, 0.95), 6) AS measured, 10.0::DOUBLE AS target, quantile_cont(value, 0.95) <= 10 AS passed FROM events UNION ALL SELECT 'ttft_p50', round(quantile_cont(value, 0.5), 6), 1.5::DOUBLE, quantile_cont(value, 0.5) <= 1.5 FROM events""")
def check_targets(spark, d):
    s = E.latency_summary(I.table(spark, d, "events"), [], "value")
    return E.check_targets(s.select(F.expr("stack(3, 'e2e_p95', p95, 'ttft_p50', p50, 'other', p99) AS (name, value)")))


@query(r"""
WITH x AS (SELECT CASE WHEN event_type = 'error' THEN 'no_candidates' WHEN value / 100 <= 0.035 THEN 'off_topic' WHEN value / 100 < 0.05 THEN 'weak_score' ELSE 'answer' END AS outcome FROM events)
SELECT outcome, count(*) AS n, outcome IN ('no_candidates', 'weak_score', 'no_citations') AS hand_off, (SELECT round(avg(CASE WHEN outcome <> 'answer' THEN 1.0 ELSE 0 END), 6)::DOUBLE FROM x) AS fallback_rate FROM x GROUP BY 1""")
def refusal_counts(spark, d):
    x = I.table(spark, d, "events").select(T.refusal_decision(F.when(F.col("event_type") != "error", F.col("value") / 100), F.lit(False)).alias("outcome"))
    return E.refusal_counts(x, T.HAND_OFF).join(F.broadcast(E.fallback_rate(x).select("fallback_rate", F.lit(1).alias("k"))), F.col("k") == 1).drop("k")


@query(r"""
WITH c AS (SELECT l_suppkey AS case_id, l_partkey % 50 AS id FROM lineitem), r AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey % 50 AS id FROM lineitem WHERE l_quantity > 40)
SELECT case_id, round(avg(CASE WHEN r.id IS NOT NULL THEN 1.0 ELSE 0 END), 6)::DOUBLE AS rate FROM c LEFT JOIN r USING (case_id, id) GROUP BY 1""")
def citation_grounding_rate(spark, d):
    c = I.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_partkey") % 50).alias("id"), "l_quantity")
    return E.citation_grounding_rate(c.select("case_id", "id"), c.where("l_quantity > 40"))


@query(f"""WITH {I.REGISTRY}, p AS (SELECT page_id, space_id, row_number() OVER (PARTITION BY space_id ORDER BY page_id) AS s, row_number() OVER (ORDER BY page_id) AS w FROM registry WHERE status = 'current'),
c AS (SELECT item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN item_id % 20 END AS sp FROM benchmark)
SELECT case_id, CAST(s AS INT) AS rank, page_id AS id FROM c JOIN p ON sp = space_id WHERE s <= 10 UNION ALL SELECT case_id, CAST(w AS INT), page_id FROM c JOIN p ON w <= 10 WHERE sp IS NULL""")
def baseline_rank(spark, d):
    cases = I.table(spark, d, "benchmark").selectExpr("item_id AS case_id", "CASE WHEN item_id % 2 = 0 THEN cast(item_id % 20 AS string) WHEN item_id % 3 = 0 THEN 'someone' END AS scope")
    return E.baseline_rank(cases, I.registry(spark, d).withColumn("position", F.col("page_id")))


@query()
def build_index(spark, d):
    """HTML pages to embedded, linked chunks."""
    pages = I.table(spark, d, "pages").select("page_id", F.col("html").alias("body"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"))
    out = Z.build_chunks(pages, Z.bag_embedder(), store=new_path(spark, "vectors"))
    return out.select("page_id", "kind", "seq", "tokens", "stable_key", "parent_key", F.sha2(F.encode("retrieval_text", "UTF-8"), 256).alias("retrieval_sha256"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"))


_SIGNS = "etaoinsrhdlu"


def _letters(texts):
    """Stands for an embedding model: counts of some letters."""
    return [[float(t.count(c)) for c in _SIGNS] for t in texts]


_LETTERS = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', '')))::DOUBLE" for c in _SIGNS) + "]"
_UNIT = "(CASE WHEN list_dot_product({0}, {0}) = 0 THEN {0} ELSE list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0}))) END)"


@query(f"""WITH {I.CHUNKS}, {_KEYWORD}, asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 10 = 0 THEN item_id % 20 END AS space, item_id % 2 = 0 AS named, CASE WHEN item_id % 3 = 0 THEN ['en', 'general'] ELSE ['*'] END AS scopes, {_LETTERS.format("text")} AS v FROM benchmark),
live AS (SELECT chunk_id, page_id, space_id, source_id, tags, {_LETTERS.format("coalesce(text, '')")} AS v FROM chunks WHERE is_active AND page_status = 'current'),
units AS (SELECT * EXCLUDE (v), {_UNIT.format("v")} AS u FROM live), seen AS (SELECT query_id, page_id, round(1 - list_dot_product({_UNIT.format("a.v")}, u), 9) AS distance FROM asked a JOIN units l
  ON (space IS NULL OR space_id = space) AND (list_contains(scopes, '*') OR len(tags) = 0 OR list_has_any(tags, scopes)) AND regexp_full_match(source_id, 'src1?[0-9]')),
words AS (SELECT h.query_id, h.doc_id AS page_id, row_number() OVER (PARTITION BY h.query_id ORDER BY round(h.score, 9) DESC, h.doc_id) AS r FROM hit h JOIN seen s ON h.query_id = s.query_id AND h.doc_id = s.page_id QUALIFY r <= 75),
near AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, page_id) AS r FROM seen QUALIFY r <= 75),
fused AS (SELECT query_id, page_id, w.r AS kr, round(coalesce(1.0 / (60 + w.r), 0) + coalesce(1.0 / (60 + n.r), 0), 12) AS rrf FROM words w FULL JOIN near n USING (query_id, page_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(kr, 1000000), page_id) AS rank FROM fused),
open AS (SELECT f.query_id, f.page_id, rank FROM ranked f JOIN asked a USING (query_id) JOIN chunks c ON c.page_id = f.page_id WHERE CASE WHEN space IS NOT NULL THEN c.space_id = space ELSE named OR f.page_id % 7 <> 0 END),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM open)
SELECT query_id, page_id, CAST(r AS INT) AS rank, CAST(least(n, 75) - r + 1 AS DOUBLE) AS score FROM cut WHERE r <= 5""")
def retrieve_pages(spark, d):
    """Benchmark passages as questions over all documents: keyword and vector lists to the reranked top five."""
    chunks = I.chunks(spark, d).withColumn("title", F.col("source_id")).withColumn("seq", F.lit(0))
    chunks = written(K.embed_texts(chunks, _letters), "embedded")
    asked = K.embed_texts(_questions(spark, d), _letters).withColumnRenamed("embedding", "vec")
    every = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: F.concat(F.lit("src"), x.cast("string")))
    asked = asked.withColumns({"space_trust": F.when(F.col("query_id") % 10 == 0, F.col("query_id") % 20), "principal": F.when(F.col("query_id") % 2 == 0, F.lit("u1")), "sources": every, "scopes": F.when(F.col("query_id") % 3 == 0, _lit_array("en", "general")).otherwise(_lit_array("*"))})
    restricted = chunks.where("page_id % 7 = 0").select("page_id", F.lit("u1").alias("principal"))
    return Z.hybrid_retrieve(asked, chunks, _postings(spark, d), chunks.select("page_id", "space_id"), restricted).select("query_id", "page_id", "rank", "score")


@query()
def retrieve_evidence(spark, d):
    """From HTML pages to numbered evidence: chunks are built, found by both lists, fused, reranked by shared words and replaced
    by their parents; curated entries of the query's scopes come first."""
    pages = I.table(spark, d, "pages").select("page_id", F.col("html").alias("body"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"))
    built = written(Z.build_chunks(pages, Z.bag_embedder()), "built")
    chunks = built.withColumns({"chunk_id": F.xxhash64("stable_key"), "parent_id": F.xxhash64("parent_key"), "space_id": F.col("page_id") % 20, "source_id": F.lit("wiki"), "is_active": F.lit(True), "page_status": F.lit("current"), "tags": F.when(F.col("page_id") % 3 == 0, _lit_array("en")).otherwise(F.array().cast("array<string>"))})
    children = chunks.where("kind = 1")
    asked = K.embed_texts(_questions(spark, d), Z.bag_embedder()).withColumnRenamed("embedding", "vec")
    asked = asked.withColumns({"space_trust": F.when(F.col("query_id") % 10 == 0, F.col("query_id") % 20), "principal": F.lit("u1"), "sources": _lit_array("wiki"), "scopes": _lit_array("en", "general")})
    restricted = pages.where("page_id % 7 = 0").select("page_id", F.lit("u2").alias("principal"))

    def shared(question: str, docs: list[str]) -> list[float]:
        words = set(question.lower().split())
        return [float(len(words & set(x.lower().split()))) for x in docs]

    hits = written(Z.hybrid_retrieve(asked, children, R.chunk_terms(children, ("chunk_id",), F.col("retrieval_text"), only=R.asked_terms(asked)), chunks.select("page_id", "space_id").distinct(), restricted, scorer=shared), "hits")
    entries = I.table(spark, d, "documents").selectExpr("doc_id AS entry_id", "array(lang) AS tags", "true AS is_active")
    curated = V.curated_for_scope(asked.select("query_id", "scopes"), entries, 1).select("query_id", "entry_id", "rank", F.lit("Note").alias("title"), F.concat(F.lit("entry "), F.col("entry_id").cast("string")).alias("body"))
    out = Z.gather_evidence(hits, chunks, curated)
    return out.select("query_id", F.size("markers").alias("n"), F.sha2(F.encode("evidence", "UTF-8"), 256).alias("evidence_sha256"))


def flagship(spark, d):
    """Keyword retrieval of benchmark questions, scored against the documents that contain the passage."""
    ranked = keyword_search(spark, d).select(F.col("query_id").alias("case_id"), "rank", F.col("page_id").alias("id"))
    item = I.table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("passage"))
    found = ranked.join(item, "case_id").join(I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").where(F.contains("text", F.col("passage")))
    per_case = E.case_metrics(item, ranked, found.select("case_id", "id"), 5)
    return E.evaluate(per_case.withColumn("dataset", F.lit("passages")))
