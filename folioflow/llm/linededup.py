"""Line dedup: lines that several documents have stay only in the document with the smallest id.

Two Bloom filters, for hashes seen once and seen twice, find the suspects; only suspects are shuffled, as
digests, to confirm them exactly and to choose the first holder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batches_of, join_first, map_suspects, texts, written

_STRIP = BLANKS.encode()


def _key(line: bytes, least: int) -> bytes | None:
    """The line's key, or None if it has fewer than ``least`` code points (UTF-8 goes on with 0b10xxxxxx)."""
    key = line.strip(_STRIP).lower()  # of bytes: A-Z only
    if len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least:
        return key
    return None


def _keys(text: str, least: int) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.encode().split(b"\n")):
        if (key := _key(line, least)) is not None:
            found.setdefault(key, []).append(i)
    return found


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def repeated_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """(doc_id, rid, drop array<int>): for each document that loses lines, which ones (from 0), in any order.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of ``least``
    code points or more that two document ids (or more) hold lose all their lines but those of the smallest id.
    Null ids neither hold nor lose lines; rows with the same id count as one document.
    """
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    n = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0

    def suspects(b, has):
        out: tuple[list, ...] = ([], [], [], [])
        for doc_id, rid, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "text")), strict=True):
            keys = _keys(text, least)
            for (key, at), k in zip(keys.items(), has(_hashes(keys.keys())), strict=True):
                if k:
                    for column, x in zip(out, (doc_id, rid, hashlib.sha256(key).digest(), at), strict=True):
                        column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int32()))], ["doc_id", "rid", "digest", "at"])

    keys_of = lambda b: (_hashes(_keys(t, least).keys()) for t in b.column("text").to_pylist())
    found = written(map_suspects(rows, rows.select("text"), keys_of, n, suspects, "doc_id long, rid long, digest binary, at array<int>", most_bits), "suspects")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n")
    lost = join_first(found, written(first, "firsts"), "digest").where("doc_id > first")
    return lost.groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("at")).alias("drop"))


def _without(text: str, drop: list[int] | None) -> tuple[int, int, str]:
    lines = text.split("\n")
    gone = set(() if drop is None else drop)
    return len(lines), len(gone), "\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept string) for every row of ``docs``: its text without repeated lines.

    Null and empty texts are one empty line. A document whose lines all go keeps an empty text. See
    ``repeated_lines`` for what is dropped; no lines are looked at beyond the row's own whole text.
    """
    rows = texts(docs, id_col, text_col)
    drop = repeated_lines(docs, least, id_col, text_col, most_bits)

    def keep(batches):
        for b in batches_of(batches):
            n, dropped, kept = [], [], []
            for text, drop in zip(b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True):
                for column, x in zip((n, dropped, kept), _without(text, drop), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    joined = rows.join(drop.hint("shuffle_hash"), ["doc_id", "rid"], "left").select("doc_id", "text", "drop")
    return joined.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept string")


def drop_repeated_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """``docs`` with all its rows and columns, the text without repeated lines. Null texts stay null."""
    drop = repeated_lines(docs, least, id_col, text_col, most_bits).select(F.struct("doc_id", "rid").alias("_folioflow_row"), F.col("drop").alias("_folioflow_drop"))
    row = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rid"))
    joined = docs.withColumn("_folioflow_row", row).join(drop.hint("shuffle_hash"), "_folioflow_row", "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, drop: pd.Series) -> pd.Series:
        return pd.Series([t if d is None else _without(t, d)[2] for t, d in zip(text, drop, strict=True)], dtype=object)

    return joined.withColumn(text_col, kept(F.col(text_col), F.col("_folioflow_drop"))).select(*docs.columns)
