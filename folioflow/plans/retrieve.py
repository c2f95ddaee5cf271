"""Batch retrieval from questions to reranked pages, and index builds from bodies to linked chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compose_retrieval, rerank_text
from ..operators import blocks as B
from ..operators import chunking as K
from ..operators import filters as V
from ..operators import search as R
from ..operators.tables import written


def _may_see(queries: pd.DataFrame, chunks: pd.DataFrame) -> np.ndarray:
    """Whether a chunk may be found by each query, by source, scope and space trust; unknown means no. Both sides have few distinct values."""
    tags = [tuple(t) if t is not None else () for t in chunks["tags"]]
    kinds: dict[tuple, int] = {}
    which = np.fromiter((kinds.setdefault(x, len(kinds)) for x in zip(chunks["space_id"], chunks["source_id"], tags, strict=True)), np.int64, len(chunks))
    own: dict[tuple, int] = {}
    asks = [own.setdefault((None if pd.isna(s) else int(s), *(tuple(x) if x is not None else () for x in more)), len(own)) for s, *more in zip(queries["space_trust"], queries["sources"], queries["scopes"], strict=True)]
    out = np.zeros((len(own), len(kinds)), bool)
    for i, (space, sources, scopes) in enumerate(own):
        sources, scopes = set(sources), set(scopes)
        for j, (at, source, t) in enumerate(kinds):
            out[i, j] = (space is None or at == space) and source in sources and (V.ANY_SCOPE in scopes or not t or not scopes.isdisjoint(t))
    return out[np.array(asks, np.int64)[:, None], which]


def hybrid_retrieve(queries: DataFrame, chunks: DataFrame, postings: DataFrame, registry: DataFrame, restrictions: DataFrame, k: int = 75, depth: int = 75, top: int = 5, scorer: Callable | None = None) -> DataFrame:
    """(query_id, page_id, chunk_id, rank, score) of the ``top`` pages of each query.

    ``queries`` (query_id, text, vec, space_trust, principal, sources, scopes); ``chunks`` are children with their access
    columns, title, text, seq and embedding. Keyword and vector lists of ``k`` chunk rows become page lists, are fused
    and ordered, filtered by the pages' access lists, cut to ``depth`` and reranked: by ``scorer``, or in order.
    """
    live = chunks.where(V.base_filter())
    meta = live.select("chunk_id", "page_id", "space_id", "source_id", "tags")
    asked = queries.select("query_id", "text", "space_trust", "sources", "scopes")
    words = R.dedupe_ranked(R.keyword_search(asked, postings, meta, _may_see, k))
    vectors = live.select("chunk_id", "page_id", "space_id", "source_id", "tags", "embedding")
    near = R.dedupe_ranked(R.dense_search(queries.select("query_id", "vec", "space_trust", "sources", "scopes"), vectors, _may_see, k))
    ranked = R.fused_order(R.rrf_fuse({"keyword": words, "dense": near}))
    cut = written(R.rerank_cut(R.allowed(R.attach_acl(ranked, registry, restrictions), queries), depth).select("query_id", "page_id", "rank"), "candidates")
    first = R.representative_chunk(cut, live.select("page_id", "chunk_id", "seq", "title", "text"))
    docs = cut.join(first, "page_id").withColumn("doc", rerank_text(F.col("title"), F.col("text")))
    if scorer:
        best = R.rerank(docs.join(queries.select("query_id", F.col("text").alias("query")), "query_id"), scorer, top)
    else:
        best = R.identity_rerank(R.rerank_cut(docs.select("query_id", "page_id", "rank"), depth), top)
    return best.join(first.select("page_id", "chunk_id"), "page_id").select("query_id", "page_id", "chunk_id", "rank", "score")


def gather_evidence(hits: DataFrame, chunks: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(query_id, evidence, markers) of retrieved pages: ``curated`` entries, then the parent of each hit's chunk, by rank. ``hits``
    as `hybrid_retrieve` gives them; ``chunks`` (chunk_id, parent_id, kind, title, text) with parents. A hit whose parent is
    missing gives no evidence."""
    children = chunks.where("kind = 1").select("chunk_id", "parent_id", "title")
    found = R.parent_context(hits.join(children, "chunk_id"), chunks.select("chunk_id", "kind", "text"))
    none = hits.sparkSession.createDataFrame([], "query_id long, entry_id long, rank int, title string, body string")
    return R.evidence(found.select("query_id", "page_id", "rank", "title", "parent_text"), none if curated is None else curated)


def build_chunks(pages: DataFrame, embedder: Callable[[list[str]], list], body_col: str = "body", html: bool = True, store: str | None = None) -> DataFrame:
    """Bodies (page_id, title, body) to linked parents and children with retrieval text; children are embedded, with a ``store`` each distinct
    text once and for all (`embed_once`)."""
    blocks = B.normalize_pages(pages, body_col=body_col) if html else B.line_blocks(pages, body_col=body_col)
    planned = written(K.plan_chunks(B.build_sections(B.heading_paths(blocks))), "planned")
    linked = K.link_chunks(planned).join(pages.select("page_id", "title"), "page_id")
    full = linked.withColumn("retrieval_text", compose_retrieval(F.col("title"), F.col("path"), F.lit(None).cast("string"), F.col("text")))
    waiting = full.where("kind = 1")
    children = K.embed_once(waiting, embedder, store, "retrieval_text") if store else K.embed_texts(waiting, embedder, "retrieval_text")
    return children.unionByName(full.where("kind = 0").withColumn("embedding", F.lit(None).cast("array<float>")))


def bag_embedder(dim: int = 64) -> Callable[[list[str]], list]:
    """Unit vectors of signed hashed word counts: no model, but texts that share words are near."""
    import zlib

    def embed(texts: list[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h & 0x8000_0000 else -1
            out.append((v / max(np.linalg.norm(v), 1e-9)).astype(np.float32))
        return out

    return embed
