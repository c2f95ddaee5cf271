import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.operators import evaluation as E
from folioflow.operators import search as R
from folioflow.plans import catalogue, retrieve

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def corpus(spark):
    rows = [
        (1, "How to reset a password", "<h1>Reset</h1><p>Open settings and reset the password.</p>", 1, ["general"], "current"),
        (2, "Billing limits", "<h1>Limits</h1><p>Invoices above the billing limit need approval.</p>", 1, ["acme"], "current"),
        (3, "Secret plans", "<h1>Plans</h1><p>The password of the billing plan is secret.</p>", 1, [], "current"),
        (4, "Old password page", "<p>reset password password</p>", 1, [], "archived"),
        (5, "Other space", "<p>reset the password here too</p>", 2, [], "current"),
    ]
    return spark.createDataFrame(rows, "page_id long, title string, body string, space_id long, tags array<string>, page_status string")


def test_build_and_retrieve_without_leaks(spark):
    pages = corpus(spark)
    built = retrieve.build_chunks(pages, retrieve.bag_embedder())
    assert built.where("kind = 1 and embedding is null").count() == 0 and built.where("kind = 1 and parent_key is null").count() == 0
    chunks = built.join(pages.select("page_id", "space_id", "tags", "page_status"), "page_id").withColumns({"chunk_id": F.xxhash64("stable_key"), "source_id": F.lit("wiki"), "is_active": F.lit(True)})
    postings = R.chunk_terms(chunks.where("kind = 1"), ("chunk_id",), F.col("retrieval_text"), R.english_stop_words())
    embed = retrieve.bag_embedder()

    def ask(text, **how):
        row = {"query_id": 1, "text": text, "vec": embed([text])[0].tolist(), "space_trust": None, "principal": None, "sources": ["wiki"], "scopes": ["*"]} | how
        q = spark.createDataFrame([tuple(row.values())], "query_id long, text string, vec array<float>, space_trust long, principal string, sources array<string>, scopes array<string>")
        acl = spark.createDataFrame([(3, "ann")], "page_id long, principal string")
        return [r.page_id for r in retrieve.hybrid_retrieve(q, chunks, postings, pages.select("page_id", "space_id"), acl).orderBy("rank").collect()]

    found = ask("reset password")
    assert found[0] in (1, 5) and 4 not in found and 3 not in found
    assert 3 in ask("secret billing password", principal="ann") and 3 not in ask("secret billing password", principal="bob")
    assert set(ask("reset password", space_trust=2)) == {5} and 3 in ask("secret password", space_trust=1)
    assert 2 not in ask("billing limit", scopes=["general"]) and 2 in ask("billing limit", scopes=["acme"]) and set(ask("billing limit", scopes=None)) == {5}
    assert ask("reset password", sources=None) == ask("reset password", sources=[]) == ask("reset password", sources=["other"]) == []


def test_evidence_is_the_parents_text(spark):
    chunks = spark.createDataFrame([(1, None, 0, "T", "the whole parent"), (2, 1, 1, "T", "whole"), (3, 9, 1, "T", "orphan")], "chunk_id long, parent_id long, kind int, title string, text string")
    hits = spark.createDataFrame([(5, 70, 2, 1), (5, 71, 3, 2)], "query_id long, page_id long, chunk_id long, rank int")
    assert [r.evidence for r in retrieve.gather_evidence(hits, chunks).collect()] == ["[1] T\nthe whole parent"]
    curated = spark.createDataFrame([(5, 8, 1, "Note", "first")], "query_id long, entry_id long, rank int, title string, body string")
    assert [r.evidence for r in retrieve.gather_evidence(hits, chunks, curated).collect()] == ["[1] Note\nfirst\n\n[2] T\nthe whole parent"]


def test_longest_first_scorer(spark):
    pages = corpus(spark)
    chunks = retrieve.build_chunks(pages, retrieve.bag_embedder()).join(pages.select("page_id", "space_id", "tags", "page_status"), "page_id").withColumns({"chunk_id": F.xxhash64("stable_key"), "source_id": F.lit("wiki"), "is_active": F.lit(True)})
    postings = R.chunk_terms(chunks.where("kind = 1"), ("chunk_id",), F.col("retrieval_text"))
    vec = retrieve.bag_embedder()(["password"])[0].tolist()
    q = spark.createDataFrame([(1, "password", vec, None, None, ["wiki"], ["*"])], "query_id long, text string, vec array<float>, space_trust long, principal string, sources array<string>, scopes array<string>")
    none = spark.createDataFrame([], "page_id long, principal string")
    got = retrieve.hybrid_retrieve(q, chunks, postings, pages.select("page_id", "space_id"), none, scorer=lambda query, docs: [len(x) for x in docs], top=3).orderBy("rank").collect()
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and len(got) == 3


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        v = v.tolist() if hasattr(v, "tolist") else v
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else plain(v)
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_flagship(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    row = catalogue.flagship(spark, DATA).first()
    assert row.cases > 0 and 0 <= row.recall <= 1
    assert set(E.METRICS) < set(row.asDict())


def test_visibility_is_decided_once_a_kind_of_chunk():
    import pandas as pd

    class Counted(list):
        asked = 0

        def __iter__(self):
            Counted.asked += 1
            return super().__iter__()

    n = 600
    chunks = pd.DataFrame({"space_id": [i % 3 for i in range(n)], "source_id": [f"s{i % 2}" for i in range(n)], "tags": [None if i % 5 == 0 else [] if i % 5 == 1 else [f"t{i % 4}", "x"] for i in range(n)]})
    asks = [(None, ["s0", "s1"], ["*"]), (1, ["s0"], ["t1"]), (None, None, ["*"]), (2, ["s1"], None), (None, ["s1"], ["x"])] * 20
    queries = pd.DataFrame({"space_trust": [a[0] for a in asks], "sources": [Counted(a[1]) if a[1] is not None else None for a in asks], "scopes": [a[2] for a in asks]})
    got = retrieve._may_see(queries, chunks)
    for (space, sources, scopes), row in zip(asks, got, strict=True):
        want = [(space is None or c.space_id == space) and c.source_id in (sources or []) and ("*" in (scopes or []) or not c.tags or bool(set(c.tags) & set(scopes or []))) for c in chunks.itertuples()]
        assert row.tolist() == want
    assert got.shape == (100, n) and Counted.asked <= 100  # a query's sources are read once, not for all chunks


def test_embedding_goes_by_slices_of_arrow(spark):
    from folioflow.operators.chunking import embed_texts

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "a" * i, ["p", None]) for i in range(300)], "i long, text string, path array<string>")
    out = embed_texts(rows, lambda texts: [[len(t), len(texts) <= 50] for t in texts], batch=50)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    assert sorted((r.i, r.path, *r.embedding) for r in out.collect()) == [(i, ["p", None], 0.0 if i % 7 == 0 else float(i), 1.0) for i in range(300)]
