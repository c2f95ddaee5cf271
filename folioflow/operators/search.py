"""Batch retrieval: keyword and vector search, fusion, access, reranking, evidence and traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, Broadcast
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stems import stem, stem_dictionary
from .filters import page_acl
from .tables import written

WORD = r"[^\p{L}\p{N}]+"
MANY = 1_000_000  # the rank of what is in no keyword list
MOST_STEMS = 250_000  # terms whose stems a task remembers, about 50 MB
MOST_TERMS = 1_000_000  # terms of queries, and repeated ids, that are broadcast
_stemmed: dict[str, str] = {}


def terms_of(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased runs of letters and digits, without stop words; repeated terms repeat."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda x: x != "")
    return F.filter(words, lambda x: ~x.isin(*stop)) if stop else words


def english_stop_words() -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def asked_terms(queries: DataFrame, stop: tuple[str, ...] = (), stems: bool = False) -> DataFrame:
    """(term): the distinct terms of the queries' texts."""
    terms = queries.select(F.explode(terms_of(F.col("text"), stop)).alias("term")).distinct()
    return stem_dictionary(terms).select(F.col("stem").alias("term")).distinct() if stems else terms


def _stem(term: str) -> str:
    if (s := _stemmed.get(term)) is None:
        s = _stemmed[term] = stem(term)
    return s


def chunk_terms(chunks: DataFrame, id_cols: tuple[str, ...], text: Column, stop: tuple[str, ...] = (), stems: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(ids, term, tf): the postings. Terms are counted within each row, where its text is; rows are shuffled only
    if their ids come more than once. With ``stems``, terms are Porter stems. ``only`` (term, distinct) are the terms that are wanted, where not all are."""
    asked = None
    if only is not None and (only := written(only, "only")).count() <= MOST_TERMS:
        asked = chunks.sparkSession.sparkContext.broadcast(only.toArrow().column("term").combine_chunks())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lists = part.column("terms")
                coded = lists.flatten().dictionary_encode()
                codes, names = coded.indices.to_numpy(), coded.dictionary
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                if stems:
                    if len(_stemmed) > MOST_STEMS:
                        _stemmed.clear()
                    stemmed = pa.array(list(map(_stem, names.to_pylist())), pa.string()).dictionary_encode()
                    codes, names = stemmed.indices.to_numpy()[codes], stemmed.dictionary
                if asked is not None:
                    wanted = pc.is_in(names, value_set=asked.value).to_numpy(zero_copy_only=False)[codes]
                    codes, row = codes[wanted], row[wanted]
                if not len(codes):
                    continue
                each, tf = np.unique(row * len(names) + codes, return_counts=True)
                row, codes = (pa.array(x) for x in np.divmod(each, len(names)))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in id_cols), names.take(codes), pa.array(tf.astype(np.int32))], [*id_cols, "term", "tf"])
        _stemmed.clear()  # Python workers live on

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*id_cols).schema.fields)
    counted = lambda df: df.select(*id_cols, terms_of(text, stop).alias("terms")).mapInArrow(count, f"{ids}, term string, tf int")
    again = written(chunks.groupBy(*id_cols).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*(F.col(c).alias(f"_again_{c}") for c in id_cols)), "again")
    if n := again.count():
        again = F.broadcast(again) if n <= MOST_TERMS else again
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_again_{c}")) for c in id_cols))
        merged = counted(chunks.join(again, same, "left_semi")).groupBy(*id_cols, "term").agg(F.sum("tf").cast("int").alias("tf"))
        out = counted(chunks.join(again, same, "left_anti")).unionByName(merged)
    else:
        out = counted(chunks)
    return out.join(only, "term", "left_semi").select(*out.columns) if only is not None and asked is None else out


def repeats_weight(tf: Column) -> Column:
    """Sum of 1 / j^2 for j up to tf: each repeat counts less. Looked up to 50; beyond, pi^2 / 6 less the asymptotic
    series of its tail, exact to 1e-13."""
    sums = F.array(*(F.lit(float(x)) for x in np.cumsum(1 / np.arange(1, 51) ** 2)))
    x = F.lit(1.0) / tf.cast("double")
    tail = x - x * x / 2 + x * x * x / 6 - x * x * x * x * x / 30
    return F.when(tf <= 50, F.element_at(sums, F.least(tf, F.lit(50)))).otherwise(F.lit(np.pi**2 / 6) - tail)


def postings_index(postings: DataFrame, chunks: DataFrame, size: int = 512) -> DataFrame:
    """The inverted index of ``chunks`` in parts of about ``size`` of them (by hashed id): (part, chunks, terms), where chunks has
    the columns of ``chunks``, by id, and terms, by term, has the term's greatest weight in the part, its chunks' places and their weights.

    A frequent term lies in all parts, and each part is a row of bounded size. Weights (`repeats_weight`) are made here, once a posting.
    """
    parts = max(1, -(-chunks.count() // size))
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part")
    have = chunks.select(part, "*").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("chunk_id", *(c for c in chunks.columns if c != "chunk_id")))).alias("chunks"))
    each = postings.select(part, "term", "chunk_id", repeats_weight(F.col("tf")).alias("w")).groupBy("part", "term").agg(F.max("w").alias("most"), F.array_sort(F.collect_list(F.struct("chunk_id", "w"))).alias("p"))
    terms = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("term", "most", F.col("p.chunk_id").alias("ids"), F.col("p.w").alias("weights")))).alias("terms"))
    return have.join(terms, "part")


class _Part:
    """A part of the index: chunks as a table and each term's (greatest weight, places, weights)."""

    def __init__(self, chunks: pa.Array, terms: pa.Array):
        flat = chunks.flatten() if isinstance(chunks, pa.ListArray) else chunks
        self.chunks = pa.Table.from_arrays(flat.flatten(), names=[f.name for f in flat.type])
        self.ids = self.chunks.column("chunk_id").to_numpy()
        self.pages = self.chunks.column("page_id").to_numpy()
        names, most, ids, weights = (terms.field(i) for i in range(4))
        ends, flat_ids, flat_w = ids.offsets.to_numpy(), ids.values.to_numpy(), weights.values.to_numpy()
        places = np.searchsorted(self.ids, flat_ids)
        known = self.ids[np.minimum(places, len(self.ids) - 1)] == flat_ids  # postings of other chunks don't count
        self.terms = {}
        for t, m, i, j in zip(names.to_pylist(), most.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            ok = known[i:j]
            self.terms[t] = (m, places[i:j][ok], flat_w[i:j][ok])

    def scores(self, asked: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores in billionths) of the chunks that may score ``least`` or more. Terms go from the greatest bound to the smallest; once
        those that are left can't lift a chunk to ``least``, only chunks that are met already get their weights."""
        n = len(asked)
        held = sorted(((round(h[0] / n * 1e9), h) for t in asked if (h := self.terms.get(t))), key=lambda x: -x[0])
        rest = sum(b for b, _ in held)
        if not held or rest < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total, met = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for bound, (_, places, weights) in held:
            part = np.rint(weights / n * 1e9).astype(np.int64)
            if rest < least:  # a chunk without any of the terms before can't come so far
                old = met[places]
                places, part = places[old], part[old]
            total[places] += part
            met[places] = True
            rest -= bound
            if least > 0 and rest > 0:
                met &= total + rest >= least
        places = np.flatnonzero(met & (total >= least))
        return places, total[places]


def keyword_search(queries: DataFrame, postings: DataFrame, chunks: DataFrame, visible: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None, k: int = 75, stop: tuple[str, ...] = (), block: int = 4096, size: int = 512, stems: bool = False) -> DataFrame:
    """(query_id, chunk_id, page_id, score, rank): the first ``k`` chunks with any of the query's terms, by score, then page, then chunk.
    See `search_index`; the index is made and written here, of the terms that the queries have."""
    asked = written(asked_terms(queries, stop, stems), "asked")
    postings = postings.join(F.broadcast(asked) if asked.count() <= MOST_TERMS else asked, "term", "left_semi")
    return search_index(queries, written(postings_index(postings, chunks, size), "postings"), visible, k, stop, block, stems)


def search_index(queries: DataFrame, index: DataFrame, visible: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None, k: int = 75, stop: tuple[str, ...] = (), block: int = 4096, stems: bool = False) -> DataFrame:
    """(query_id, chunk_id, page_id, score, rank) from a `postings_index`; with ``stems``, from one of stems.

    A matched term counts (1 / distinct query terms) * `repeats_weight`, in whole billionths, so scores don't depend on the order of adding.
    ``visible`` gives a matrix of what each query may see of a part's chunks, before the cut at ``k``. Blocks of about ``block`` queries are
    broadcast; a task goes through its parts and holds each query's ``k`` best so far, whose last score is what a chunk must reach:
    parts and postings whose bounds fall short are skipped. Only these ``k`` rows a query and task are shuffled. Exact.
    """
    spark, nth = index.sparkSession, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id", "chunk_id"))
    asked = queries.withColumn("_terms", F.array_distinct(terms_of(F.col("text"), stop))).where(F.size("_terms") > 0).drop("text")
    blocks = max(1, -(-queries.count() // block))
    schema = "query_id long, chunk_id long, page_id long, score double"
    out = spark.createDataFrame([], schema)
    for at in range(blocks):  # the driver holds one block at a time
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).toPandas()
        if not len(mine):
            continue
        if stems:
            mine["_terms"] = [list(dict.fromkeys(map(stem, t))) for t in mine["_terms"]]
        held = spark.sparkContext.broadcast(mine)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            mine = held.value
            best: list[tuple] = [(np.zeros(0, np.int64),) * 3 for _ in range(len(mine))]  # scores, pages, chunks
            least = [0] * len(mine)
            for b in batches:
                for i in range(b.num_rows):
                    part = _Part(b.column("chunks")[i].values, b.column("terms")[i].values)
                    see = visible(mine, part.chunks.to_pandas()) if visible is not None else None
                    for q, terms in enumerate(mine["_terms"]):
                        places, score = part.scores(list(terms), least[q])
                        if see is not None:
                            places, score = places[see[q][places]], score[see[q][places]]
                        if not len(places):
                            continue
                        s, p, c = (np.concatenate(x) for x in zip(best[q], (score, part.pages[places], part.ids[places]), strict=True))
                        first = np.lexsort((c, p, -s))[:k]
                        best[q] = s[first], p[first], c[first]
                        if len(first) == k:
                            least[q] = int(s[first[-1]])
            n = [len(x[0]) for x in best]
            if sum(n):
                s, p, c = (np.concatenate(x) for x in zip(*best, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine["query_id"].to_numpy(), n), pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.int64()), pa.array(s / 1e9)], ["query_id", "chunk_id", "page_id", "score"])

        out = out.unionByName(index.select("chunks", "terms").mapInArrow(find, schema))
    return out.withColumn("rank", nth).where(F.col("rank") <= k)


def vector_cells(vectors: DataFrame, cells: int = 256, per_cell: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (chunk_id, embedding, ...) that have one, with the nearest of some centres (cell) and the distance to it as unit vectors (far),
    written cell by cell; and the centres: unit vectors of a sample by hashed id, one for ``per_cell`` rows but ``cells`` at most."""
    able = vectors.where("embedding is not null")
    some = able.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("embedding").limit(max(1, min(cells, able.count() // per_cell))).toPandas()
    if not len(some):
        return able.withColumns({"cell": F.lit(0), "far": F.lit(0.0)}), np.zeros((0, 0))
    centres = _unit(np.stack(some["embedding"].map(np.asarray)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = _unit(part.column("embedding").flatten().to_numpy().reshape(part.num_rows, -1))
                d = np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(cell)), cell]))], [*part.schema.names, "cell", "far"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in able.schema.fields)
    placed = written(able.mapInArrow(place, f"{schema}, cell int, far double"), "placed")
    return written(placed.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell", "far"), "cells"), centres


def dense_search(queries: DataFrame, vectors: DataFrame, visible: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None, k: int = 75, block: int = 4096, cells: int = 256, per_cell: int = 1024, counter: Accumulator | None = None) -> DataFrame:
    """(query_id, chunk_id, page_id, distance, rank): the ``k`` nearest rows of each query by cosine distance, then page and
    chunk; ``visible`` gives a matrix of what each query may see of a batch. Exact.

    Vectors lie in cells around centres (`vector_cells`). A first pass looks for each query at its nearest cell alone; the distance of the ``k``-th row
    there is one that it needn't exceed. In the second pass a group of rows of a cell is skipped for the queries to which, by
    the triangle inequality, all of them are farther. Blocks of about ``block`` queries (by hashed id) are broadcast as one matrix; each task keeps
    its own ``k`` best, so few rows a query and task are shuffled. ``counter`` gets the number of distances that were computed.
    """
    spark = vectors.sparkSession
    placed, centres = vector_cells(vectors, cells, per_cell)
    blocks = max(1, -(-queries.count() // block))
    schema = "query_id long, chunk_id long, page_id long, distance double"
    out = spark.createDataFrame([], schema)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "page_id", "chunk_id"))
    for at in range(blocks if len(centres) else 0):  # the driver holds one block at a time
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).toPandas()
        if not len(part):
            continue
        q = _unit(np.stack(part["vec"].map(np.asarray)))
        to_centres = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * q @ centres.T))
        held = spark.sparkContext.broadcast((part, q, to_centres))

        def search(bar: Broadcast | None, held=held) -> Callable:
            """With ``bar`` (a distance for each query), all cells that may have nearer rows; without, the nearest cell."""

            def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                mine, q, to_centres = held.value
                most = np.full(len(q), np.inf) if bar is None else bar.value.copy()
                home = to_centres.argmin(axis=1)
                best = None
                for b in batches:
                    for (cell,), x in b.groupby(["cell"], sort=False):
                        x = x.reset_index(drop=True)
                        least = np.maximum(0.0, np.maximum(to_centres[:, cell] - x["far"].max(), x["far"].min() - to_centres[:, cell])) ** 2 / 2 - 1e-8
                        who = np.flatnonzero((home == cell) if bar is None else (least <= most))
                        if not len(who):
                            continue
                        if counter is not None:
                            counter.add(len(who) * len(x))
                        d = np.round(1 - q[who] @ _unit(np.stack(x["embedding"].map(np.asarray))).T, 9)
                        if visible is not None:
                            d[~visible(mine.iloc[who].reset_index(drop=True), x)] = np.inf
                        top = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                        edge = np.minimum(np.take_along_axis(d, top, axis=1).max(axis=1), most[who])
                        i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))  # ties of the last one stay
                        if not len(i):
                            continue
                        now = pd.DataFrame({"query_id": mine["query_id"].to_numpy()[who[i]], "chunk_id": x["chunk_id"].to_numpy()[j], "page_id": x["page_id"].to_numpy()[j], "distance": d[i, j], "_q": who[i]})
                        best = now if best is None else pd.concat([best, now])
                        best = best.sort_values(["query_id", "distance", "page_id", "chunk_id"]).groupby("query_id").head(k)
                        full = best.groupby("_q")["distance"].agg(["size", "max"])
                        full = full[full["size"] >= k]
                        most[full.index.to_numpy()] = np.minimum(most[full.index.to_numpy()], full["max"].to_numpy())
                if best is not None:
                    yield best.drop(columns="_q")

            return near

        first = placed.mapInPandas(search(None), schema).withColumn("rank", nth).where(F.col("rank") == k).select("query_id", "distance").toPandas()  # a row a query
        bar = part["query_id"].map(dict(zip(first["query_id"], first["distance"], strict=True))).fillna(np.inf).to_numpy(np.float64)
        out = out.unionByName(placed.mapInPandas(search(spark.sparkContext.broadcast(bar)), schema))
    return out.withColumn("rank", nth).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def dedupe_ranked(hits: DataFrame, by: str = "query_id", item: str = "page_id") -> DataFrame:
    """(by, item, rank): the first place of each item, ranked anew without gaps."""
    first = hits.groupBy(by, item).agg(F.min("rank").alias("at"))
    return first.select(by, item, F.row_number().over(Window.partitionBy(by).orderBy("at", item)).alias("rank"))


def rrf_fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k0: int = 60) -> DataFrame:
    """(query_id, page_id, rrf, rank of each list): sum of weight / (k0 + rank) over lists (query_id, page_id, rank)."""
    weights = weights or dict.fromkeys(lists, 1.0)
    if set(weights) != set(lists):
        raise ValueError("a weight for each list is needed")
    each = None
    for name, df in lists.items():
        part = df.select("query_id", "page_id", F.lit(name).alias("of"), "rank", (F.lit(float(weights[name])) / (F.lit(k0) + F.col("rank"))).alias("w"))
        each = part if each is None else each.unionByName(part)
    return each.groupBy("query_id", "page_id").agg(F.round(F.sum("w"), 12).alias("rrf"), *(F.min(F.when(F.col("of") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists))


def fused_order(fused: DataFrame, first: str = "keyword_rank") -> DataFrame:
    """fused with rank: by rrf, then place in the keyword list, then page."""
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.coalesce(first, F.lit(MANY)), "page_id")))


def attach_acl(candidates: DataFrame, registry: DataFrame, restrictions: DataFrame) -> DataFrame:
    """candidates with page_space and principals (null: unrestricted). ``restrictions`` (page_id, principal) is looked up for
    candidate pages alone."""
    pages = candidates.select("page_id").distinct()
    sets = restrictions.join(pages, "page_id", "left_semi").groupBy("page_id").agg(F.array_sort(F.collect_set("principal")).alias("principals"))
    spaces = registry.join(pages, "page_id", "left_semi").select("page_id", F.col("space_id").alias("page_space"))
    return candidates.join(spaces, "page_id", "left").join(sets, "page_id", "left")


def allowed(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with an access list that their query (space_trust, principal) may read."""
    q = queries.select("query_id", "space_trust", "principal")
    return candidates.join(q, "query_id").where(page_acl(F.col("page_space"), F.col("principals"), F.col("space_trust"), F.col("principal"))).drop("space_trust", "principal")


def rerank_cut(ranked: DataFrame, depth: int = 75) -> DataFrame:
    """The first ``depth`` of each query, ranked anew."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= depth)


def representative_chunk(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page_id, chunk_id, ...): the visible child of the lowest seq of each candidate page."""
    mine = chunks.join(candidates.select("page_id").distinct(), "page_id", "left_semi")
    rest = [c for c in chunks.columns if c != "page_id"]
    return mine.groupBy("page_id").agg(F.min_by(F.struct(*rest), F.struct("seq", "chunk_id")).alias("c")).select("page_id", "c.*")


def parent_context(children: DataFrame, chunks: DataFrame) -> DataFrame:
    """children with parent_text, by parent_id; without a parent the child is absent."""
    return children.join(chunks.where("kind = 0").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text")), "parent_id")


def identity_rerank(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Scores n - i in the given order, n being all documents given to the query."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    out = candidates.withColumn("score", (n - F.col("rank") + 1).cast("double"))
    return out.where(F.col("rank") <= k)


def rerank(candidates: DataFrame, scorer: Callable[[str, list[str]], list[float]], k: int = 5) -> DataFrame:
    """(query_id, page_id, score, rank) by a callable from a query and its documents to scores; candidates (query_id, query,
    page_id, rank, doc) are cut to a bounded depth before."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        pdf = pdf.assign(score=np.asarray(scorer(pdf["query"].iloc[0], pdf["doc"].tolist()), float))
        pdf = pdf.sort_values(["score", "rank"], ascending=[False, True]).head(k)
        return pdf.assign(rank=np.arange(1, len(pdf) + 1))[["query_id", "page_id", "score", "rank"]]

    return candidates.groupBy("query_id").applyInPandas(one, "query_id long, page_id long, score double, rank int")


def evidence(hits: DataFrame, curated: DataFrame) -> DataFrame:
    """(query_id, evidence, markers): curated entries (query_id, entry_id, rank, title, body), then hits (query_id, page_id,
    rank, title, parent_text), numbered from 1; blocks of [m] title, newline, text, with a blank line between."""
    a = curated.select("query_id", F.lit(0).alias("part"), "rank", (-F.col("entry_id")).alias("page_id"), "title", F.col("body").alias("text"))
    b = hits.select("query_id", F.lit(1).alias("part"), "rank", "page_id", "title", F.col("parent_text").alias("text"))
    both = a.unionByName(b).withColumn("marker", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "page_id")))
    block = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return both.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "page_id", block.alias("block")))).alias("m")).select("query_id", F.rtrim(F.array_join(F.transform("m", lambda x: x["block"]), "\n\n")).alias("evidence"), F.transform("m", lambda x: F.struct(x["marker"].alias("marker"), x["page_id"].alias("page_id"))).alias("markers"))


def citation_rows(answers: DataFrame, markers: DataFrame) -> DataFrame:
    """(query_id, marker, page_id, title, url, reason) from answers (query_id, used) and markers (query_id, marker, page_id,
    title, url): one row a marker used, or one with the reason no_citations."""
    used = answers.select("query_id", F.explode_outer("used").alias("marker"))
    out = used.join(markers, ["query_id", "marker"], "left")
    return out.select("query_id", "marker", "page_id", "title", "url", F.when(F.col("marker").isNull(), "no_citations").alias("reason"))


def crag_pick(first: DataFrame, retry: DataFrame, bar: float = 0.05) -> DataFrame:
    """(query_id, picked): retry or first, from first (query_id, query, top_score) and retry (query_id, rewritten, top_score);
    a retry counts if the first score is missing or below the bar and the query was changed, and is taken if its score
    is higher or the only one."""
    r = retry.select("query_id", "rewritten", F.col("top_score").alias("r_score"))
    both = first.join(r, "query_id", "left")
    tried = (F.col("top_score").isNull() | (F.col("top_score") < bar)) & F.col("rewritten").isNotNull() & (F.col("rewritten") != F.col("query"))
    better = F.col("r_score").isNotNull() & (F.col("top_score").isNull() | (F.col("r_score") > F.col("top_score")))
    return both.select("query_id", F.when(F.coalesce(tried & better, F.lit(False)), "retry").otherwise("first").alias("picked"))


def trace_updates(traces: DataFrame, updates: DataFrame) -> DataFrame:
    """traces with answer, feedback and subject_hash of the latest update (query_id, at, ...); nulls overwrite nothing."""
    columns = ("answer", "feedback", "subject_hash")
    last = updates.groupBy("query_id").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"u_{c}") for c in columns))
    out = traces.join(last, "query_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"u_{c}", c))
    return out.drop(*(f"u_{c}" for c in columns))
