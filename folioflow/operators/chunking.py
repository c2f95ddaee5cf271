"""Sections to parent and child chunks with keys and links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import chunk_keys
from ..functions.text import CHARS_PER_TOKEN
from .tables import new_path, slices


def tokens_of(words: int, chars: int) -> int:
    return max(words, math.ceil(chars / CHARS_PER_TOKEN)) if words else 0


def count(text: str) -> int:
    return tokens_of(len(text.split()), len(text))


def split_windows(text: str, most: int, overlap: int = 0) -> list[str]:
    """Windows of whole words, of at most ``most`` tokens; each begins with the words at the end of the one before that
    together have at most ``overlap`` tokens, less what would make it too long. Words that are too long alone are cut.
    Sums of words and characters run along, so the work is linear."""
    if most <= 0 or overlap >= most:
        raise ValueError("most must be positive and overlap smaller")
    if not text or not text.strip():
        return []
    if count(text) <= most:
        return [text]
    step = most * CHARS_PER_TOKEN
    words = [p for w in text.split() for p in ([w] if count(w) <= most else [w[i : i + step] for i in range(0, len(w), step)])]
    size = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]  # each with a space
    fits = lambda a, b: tokens_of(b - a, size[b] - size[a] - 1) <= most
    out, start = [], 0
    for i in range(1, len(words)):
        if fits(start, i + 1):
            continue
        out.append(" ".join(words[start:i]))
        tail, total = i, 0
        while tail > start and total + (n := count(words[tail - 1])) <= overlap:
            total, tail = total + n, tail - 1
        start = tail
        while start < i and not fits(start, i + 1):
            start += 1
    out.append(" ".join(words[start:]))
    return out


def pack_parents(units: list[str], target: int = 1200, most: int = 2000) -> list[str]:
    """Units joined by line up to ``target`` tokens; one of over ``most`` stands alone, split at ``target``."""
    out: list[str] = []
    now: list[str] = []
    words = chars = 0
    for u in units:
        w, c = len(u.split()), len(u)
        if tokens_of(w, c) > most:
            out += ["\n".join(now)] if now else []
            now = []
            out += split_windows(u, target)
        elif now and tokens_of(words + w, chars + 1 + c) <= target:
            now.append(u)
            words, chars = words + w, chars + 1 + c
        else:
            out += ["\n".join(now)] if now else []
            now, words, chars = [u], w, c
    return out + (["\n".join(now)] if now else [])


def split_children(parent: str, target: int = 400, least: int = 150, most: int = 750, overlap: float = 0.12) -> list[str]:
    """The parent itself up to ``most`` tokens, else overlapping windows; a last one of under ``least`` joins the one before."""
    if count(parent) <= most:
        return [parent]
    out = split_windows(parent, target, int(target * overlap))
    if len(out) > 1 and count(out[-1]) < least:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return out


def split_column(texts: DataFrame, id_col: str, text_col: str, most: int, overlap: int = 0) -> DataFrame:
    """(id, n, window): ``split_windows`` of every row."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield pd.DataFrame([(i, n, w) for i, t in zip(b["i"], b["t"], strict=True) for n, w in enumerate(split_windows(t or "", most, overlap))], columns=["id", "n", "window"])

    return texts.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(split, "id long, n int, window string")


def plan_chunks(sections: DataFrame) -> DataFrame:
    """(page_id, section, path, level, sibling, parent, child, kind, text, tokens, keys, seq): parents (kind 0, child null)
    and their children (kind 1) of blocks with section columns. Children are numbered through the section; seq is the
    reading order, each parent before its children. A section without texts contributes its title."""
    unit = F.struct("pos", "text")
    first = [F.min_by("path", "pos").alias("path"), *(F.first(c).alias(n) for c, n in (("section_level", "level"), ("sibling_ordinal", "sibling")))]
    by_section = sections.groupBy("page_id", "section").agg(*first, F.array_sort(F.collect_list(unit)).alias("u"))
    names = ["page_id", "section", "path", "level", "sibling"]
    units = by_section.select(*names, F.col("u.text").alias("units"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):  # what is made of long texts stays small
            parent_of, child_of, kinds, said, tokens, ends = [], [], [], [], [], [0]
            for p, texts in zip(b.column("path").to_pylist(), b.column("units").to_pylist(), strict=True):
                texts = [t for t in texts if t] or [t for t in p[-1:] if t]
                child = 0
                for n, parent in enumerate(pack_parents(texts)):
                    kids = split_children(parent)
                    parent_of += [n] * (1 + len(kids))
                    child_of += [None, *range(child, child + len(kids))]
                    kinds += [0] + [1] * len(kids)
                    said += [parent, *kids]
                    tokens.append(count(parent))
                    tokens += [tokens[-1] if kids[0] is parent else count(c) for c in kids]
                    child += len(kids)
                ends.append(len(said))
            chunk = pa.StructArray.from_arrays([pa.array(x, t) for x, t in ((parent_of, pa.int32()), (child_of, pa.int32()), (kinds, pa.int32()), (said, pa.string()), (tokens, pa.int32()))], ["parent", "child", "kind", "text", "tokens"])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunk)], [*names, "chunks"])

    planned = units.mapInArrow(plan, "page_id long, section int, path array<string>, level int, sibling int, chunks array<struct<parent:int,child:int,kind:int,text:string,tokens:int>>")
    planned = planned.select(*names, F.inline("chunks"))
    keys = chunk_keys(*(F.col(c) for c in ("page_id", "path", "level", "sibling", "parent", "child", "text")))
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("section", "parent", "kind", "child")) - 1
    return planned.select("*", *(c.alias(k) for k, c in keys.items())).withColumn("seq", seq)  # hashed first: who needs no texts shuffles none


def link_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with parent_key (children: their parent's stable key), prev_key and next_key (of the page's children in
    reading order; null at the ends). All of it goes by page, so rows are dealt once."""
    family = Window.partitionBy("page_id", "section", "parent").orderBy("kind")
    parent = F.first(F.when(F.col("kind") == 0, F.col("stable_key")), True).over(family)
    child = Window.partitionBy("page_id", "kind").orderBy("seq")
    linked = chunks.withColumn("prev_key", F.when(F.col("kind") == 1, F.lag("stable_key").over(child))).withColumn("next_key", F.when(F.col("kind") == 1, F.lead("stable_key").over(child)))
    return linked.withColumn("parent_key", F.when(F.col("kind") == 1, parent))


def embed_texts(rows: DataFrame, embedder: Callable[[list[str]], list], text_col: str = "text", batch: int = 128) -> DataFrame:
    """rows with embedding array<float>, by a callable from texts to vectors, in batches."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):  # what Python holds of long texts and vectors stays small
                part = b.slice(i, batch)
                vectors = [np.asarray(v, np.float32) for v in embedder([t or "" for t in part.column(text_col).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(embed, f"{schema}, embedding array<float>")


def embed_once(rows: DataFrame, embedder: Callable[[list[str]], list], store: str, text_col: str = "text", batch: int = 128, slices: int = 16) -> DataFrame:
    """`embed_texts`, where each distinct text is embedded once and for all: its vector goes to the table ``store`` under the text's hash, and what is there
    already isn't embedded again. Texts are dealt to ``slices`` by their hash, and a slice is committed as a whole, so a
    job that was interrupted goes on with the slices that are missing. One embedder a store: its name and version belong into the path."""
    spark = rows.sparkSession
    key = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    asked = rows.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("key").agg(F.any_value("text").alias("text"))
    have = _vectors(spark, store)
    if have is not None:
        asked = asked.join(have.select("key"), "key", "left_anti")
    number = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")
    todo = new_path(spark, "unembedded")
    asked.withColumn("slice", number).write.partitionBy("slice").parquet(todo)
    waiting = spark.read.schema("key string, text string, slice int").parquet(todo)
    for n in sorted(r[0] for r in waiting.select("slice").distinct().collect()):
        embed_texts(waiting.where(F.col("slice") == n).select("key", "text"), embedder, "text", batch).select("key", "embedding").write.mode("append").parquet(f"{store}/slice={n}")
    have = _vectors(spark, store)
    if have is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    return rows.withColumn("_folioflow_key", key).join(have.select(F.col("key").alias("_folioflow_key"), "embedding"), "_folioflow_key").drop("_folioflow_key")


def _vectors(spark: SparkSession, store: str) -> DataFrame | None:
    """The table of texts' vectors, or none where no slice is there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = fs.exists(path) and any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS")) for s in fs.listStatus(path))
    return spark.read.schema("key string, embedding array<float>, slice int").parquet(store) if done else None


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list]:
    """Unit vectors that depend on the text's SHA-256 alone."""
    import hashlib

    def embed(texts: list[str]) -> list:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).normal(size=dim)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return out

    return embed
