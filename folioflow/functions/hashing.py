"""Stable SHA-256 hashes (lower-case hex) of parts, labels, access scopes and attachments."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = b"\x1f"  # follows each part
BLANK = r"(?U)[\s\x1c-\x1f]+"  # Unicode white space


def hash_parts(*parts: Column) -> Column:
    """SHA-256 over each part's UTF-8 bytes (binary parts as they are) followed by 0x1F; null parts are empty."""
    pieces = []
    for p in parts:
        pieces += [F.coalesce(p.cast("binary"), F.lit(b"")), F.lit(SEPARATOR)]
    return F.sha2(F.concat(*pieces), 256)


def as_bytes(hex_hash: Column) -> Column:
    """A hex hash as bytes, for hashes inside hashes."""
    return F.unhex(hex_hash)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def collapse(text: Column) -> Column:
    """Stripped, runs of white space as one space (Unicode white space included)."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def normalize_text(text: Column) -> Column:
    """NFC, stripped, white space collapsed. ASCII texts, for which NFC does nothing, stay out of Python only as far
    as their batches do; callers with ASCII columns use ``collapse``."""
    return collapse(_nfc(text))


def labels_hash(labels: Column) -> Column:
    """Of an array of labels, whatever their order and repeats: the JSON of the sorted distinct collapsed labels."""
    tidy = F.array_sort(F.array_distinct(F.transform(F.coalesce(labels, F.array().cast("array<string>")), collapse)))
    return hash_parts(F.to_json(tidy))


def access_scope_hash(principals: Column, space_key: Column) -> Column:
    """Of an array of principals and a space: JSON with sorted keys."""
    read = F.array_sort(F.array_distinct(F.coalesce(principals, F.array().cast("array<string>"))))
    return hash_parts(F.to_json(F.struct(read.alias("read"), F.coalesce(space_key, F.lit("")).alias("space"))))


def attachment_manifest_hash(attachments: DataFrame, by: str = "page_id") -> DataFrame:
    """(page, attachment_manifest_hash) from (page, id, version, file_size, media_type), whatever the order. An absent
    id is the text None, other absent fields are empty."""
    parts = [F.coalesce(F.col("id").cast("string"), F.lit("None")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("version", "file_size", "media_type"))]
    return attachments.groupBy(by).agg(hash_parts(F.to_json(F.array_sort(F.collect_list(F.array(*parts))))).alias("attachment_manifest_hash"))


def event_payload_hash(event_type: Column, page_id: Column, cf_version: Column, space_id: Column, status: Column, event_timestamp: Column, delivery_id: Column) -> Column:
    """Identity of an event without its receive time: canonical JSON of seven fields, nulls kept."""
    fields = F.struct(cf_version.alias("cf_version"), delivery_id.alias("delivery_id"), event_timestamp.alias("event_timestamp"), event_type.alias("event_type"), page_id.alias("page_id"), space_id.alias("space_id"), status.alias("status"))
    return hash_parts(F.to_json(fields, {"ignoreNullFields": "false"}))


def subject_hash(subject: Column) -> Column:
    """Null stays null."""
    return F.when(subject.isNotNull(), hash_parts(subject))


def cache_key(turns: DataFrame, by: str, order: str, principal: Column, scopes: Column, subject: Column) -> DataFrame:
    """(by, cache_key): SHA-256 of the JSON turns [[role, content], ...] | principal | scopes joined by comma | subject,
    one row for each conversation. ``principal``, ``scopes`` (array) and ``subject`` are columns of it."""
    said = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("said"))
    pairs = F.to_json(F.transform("said", lambda t: F.array(t["role"], t["text"])))
    whole = F.concat_ws("|", pairs, F.coalesce(principal, F.lit("")), F.array_join(F.array_sort(scopes), ","), F.coalesce(subject, F.lit("")))
    return said.select(by, F.sha2(whole.cast("binary"), 256).alias("cache_key"))


def chunk_keys(page_id: Column, path: Column, level: Column, sibling: Column, parent: Column, child: Column, text: Column) -> dict[str, Column]:
    """section, positional, content and stable keys of a chunk; ``child`` is null for parents."""
    section = hash_parts(page_id.cast("string"), F.array_join(path, ">"), level.cast("string"), sibling.cast("string"))
    second, third = F.when(child.isNull(), F.lit("parent")).otherwise(parent.cast("string")), F.coalesce(child, parent).cast("string")
    content = hash_parts(text)
    return {
        "section_key": section,
        "positional_key": hash_parts(as_bytes(section), second, third),
        "content_key": content,
        "stable_key": hash_parts(as_bytes(section), second, third, as_bytes(content)),
    }
