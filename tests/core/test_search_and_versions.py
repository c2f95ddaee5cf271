import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import changes as C
from folioflow.operators import evaluation as E
from folioflow.operators import scope as O
from folioflow.operators import search as R
from folioflow.operators import versions as W
from folioflow.sources import pages as P
from folioflow.sources import registry as G


def ranked(spark, *ids):
    return spark.createDataFrame([("c", i + 1, x) for i, x in enumerate(ids)], "case_id string, rank int, id string")


@pytest.mark.parametrize(
    ("ids", "relevant", "k", "metric", "want"),
    [
        ("a x b y c", "a b z", 4, "recall", 2 / 3), ("a x b", "a b", 5, "precision", 2 / 5), ("a x b", "a b", 3, "precision", 2 / 3), ("a x b", "a b", 0, "precision", 0),
        ("x y a b", "a b", 5, "mrr", 1 / 3), ("x y a", "a", 2, "mrr", 0), ("a x b", "a b", 3, "ndcg", 1.5 / (1 + 1 / np.log2(3))), ("a a b", "a b", 2, "recall", 1), ("x", "", 5, "recall", 0), ("a", "a", 5, "hit_rate", 1),
    ],
)
def test_metrics(spark, ids, relevant, k, metric, want):
    cases = spark.createDataFrame([("c",)], "case_id string")
    rel = spark.createDataFrame([("c", x) for x in relevant.split()], "case_id string, id string")
    row = E.case_metrics(cases, ranked(spark, *ids.split()), rel, k).first()
    assert row[metric] == pytest.approx(want, abs=1e-6)


def test_baseline_report_numbers(spark):
    """Six cases whose first relevant page is at 1, 1, 1, 2, 2 and 2: the published baseline of the smoke dataset."""
    places = [1, 1, 1, 2, 2, 2]
    cases = spark.createDataFrame([(i, "smoke") for i in range(6)], "case_id int, dataset string")
    hits = spark.createDataFrame([(i, r, "rel" if r == p else f"x{r}") for i, p in enumerate(places) for r in (1, 2, 3)], "case_id int, rank int, id string")
    rel = cases.select("case_id", F.lit("rel").alias("id"))
    row = E.evaluate(E.case_metrics(cases, hits, rel, 5).join(cases, "case_id")).first()
    assert (row.cases, row.recall, row.precision, row.mrr, row.hit_rate) == (6, 1.0, 0.2, 0.75, 1.0) and row.ndcg == pytest.approx(0.8155, abs=1e-4)
    assert E.evaluate(E.case_metrics(cases.where("false"), hits, rel, 5).join(cases, "case_id")).count() == 0


def test_latency_and_targets(spark):
    s = E.latency_summary(spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double"), [], "v").first()
    assert (s.n, s.p50, s.p95, s.p99) == (100, 50.5, 95.05, 99.01)
    t = E.check_targets(spark.createDataFrame([("e2e_p95", 10.0), ("ttft_p50", 1.6), ("x", 0.0)], "name string, value double")).collect()
    assert {r.name: r.passed for r in t} == {"e2e_p95": True, "ttft_p50": False}


def test_keyword_order(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha beta alpha beta alpha beta"), (4, "gamma")], "chunk_id long, text string")
    q = spark.createDataFrame([(9, "Alpha beta")], "query_id long, text string")
    got = R.keyword_search(q, R.chunk_terms(docs, ("chunk_id",), F.col("text")), docs.select("chunk_id", F.col("chunk_id").alias("page_id"))).orderBy("rank").collect()
    assert [r.page_id for r in got] == [3, 1, 2]


def keyword_cases(seed, n=700):
    rng = np.random.default_rng(seed)
    words, share = [f"t{i}" for i in range(60)], 1 / np.arange(1, 61) ** 1.2
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=share / share.sum())) for _ in range(n)]
    asked = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(25)] + ["nowhere", ""]
    return texts, asked


@pytest.mark.parametrize(("seed", "k", "size"), [(1, 10, 32), (2, 3, 700), (3, 75, 1)])
def test_keyword_search_skips_only_what_cannot_be_first(spark, seed, k, size):
    texts, asked = keyword_cases(seed, 120 if size == 1 else 700)
    docs = spark.createDataFrame([(i, i // 2, t, i % 3) for i, t in enumerate(texts)], "chunk_id long, page_id long, text string, space long")
    q = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(asked)], "query_id long, text string, space long")
    see = lambda a, b: a["space"].to_numpy()[:, None] != b["space"].to_numpy()[None, :]
    postings = R.chunk_terms(docs, ("chunk_id",), F.col("text"))
    got = R.keyword_search(q, postings, docs.where("chunk_id % 7 > 0").drop("text"), see, k=k, block=10, size=size).collect()
    want = []
    for i, t in enumerate(asked):
        terms = set(t.split())
        scored = []
        for c, text in enumerate(texts):
            tf = {x: text.split().count(x) for x in terms}
            if c % 7 and c % 3 != i % 3 and any(tf.values()):
                scored.append((-sum(round(sum(1 / j**2 for j in range(1, n + 1)) / len(terms) * 1e9) for n in tf.values() if n), c // 2, c))
        want += [(i, c, p, round(-s / 1e9, 6), r) for r, (s, p, c) in enumerate(sorted(scored)[:k], 1)]
    assert sorted((r.query_id, r.chunk_id, r.page_id, round(r.score, 6), r["rank"]) for r in got) == sorted(want)


def test_bounds_skip_postings_and_parts(spark):
    """The index holds few postings of a part to count once the first ones are known."""
    texts, _ = keyword_cases(5)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, page_id long, text string")
    rows = R.postings_index(R.chunk_terms(docs, ("chunk_id",), F.col("text")), docs.drop("text"), 700).toArrow()
    part = R._Part(rows.column("chunks").chunk(0)[0].values, rows.column("terms").chunk(0)[0].values)
    asked = ["t0", "t1", "t50"]
    places, score = part.scores(asked, 0)
    top = int(np.sort(score)[-5])
    few, high = part.scores(asked, top)
    assert len(places) > 10 * len(few) and sorted(high.tolist()) == sorted(s for s in score.tolist() if s >= top)
    assert len(part.scores(asked, 10**12)[0]) == 0


def test_dense_search_is_exact_with_ties_and_filters(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(40, 8)), 3, axis=0)
    rows = [(i, i // 2, x.tolist(), int(i % 2)) for i, x in enumerate(v)] + [(500, 500, None, 0)]
    vectors = spark.createDataFrame(rows, "chunk_id long, page_id long, embedding array<float>, space long").repartition(5)
    q = spark.createDataFrame([(k, v[k].tolist(), k % 2) for k in range(7)], "query_id long, vec array<float>, space long")
    see = lambda a, b: a["space"].to_numpy()[:, None] == b["space"].to_numpy()[None, :]
    got = {}
    for r in R.dense_search(q, vectors, see, k=10, block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for k in range(7):
        want = sorted((round(1 - u[k] @ u[i], 9), i // 2, i) for i in range(120) if i % 2 == k % 2)[:10]
        assert got[k] == [i for *_, i in want]


def test_fusion_evidence_and_reranking(spark):
    lists = {n: spark.createDataFrame([(1, p, i + 1) for i, p in enumerate(ids)], "query_id long, page_id long, rank int") for n, ids in {"keyword": [1, 2, 3], "dense": [3, 1]}.items()}
    got = R.fused_order(R.rrf_fuse(lists)).orderBy("rank").collect()
    assert [r.page_id for r in got] == [1, 3, 2] and got[0].rrf == pytest.approx(1 / 61 + 1 / 62)
    with pytest.raises(ValueError):
        R.rrf_fuse(lists, {"keyword": 1.0})
    assert [(r.page_id, r.score) for r in R.identity_rerank(R.fused_order(R.rrf_fuse(lists)).select("query_id", "page_id", "rank"), 2).orderBy("rank").collect()] == [(1, 3.0), (3, 2.0)]
    docs = spark.createDataFrame([(1, "q", 5, 1, "aa"), (1, "q", 6, 2, "a"), (1, "q", 7, 3, "aaa")], "query_id long, query string, page_id long, rank int, doc string")
    assert [r.page_id for r in R.rerank(docs, lambda q, d: [len(x) for x in d], 2).orderBy("rank").collect()] == [7, 5]
    hits = spark.createDataFrame([(1, 1, 8, "T", "body ")], "query_id long, rank int, page_id long, title string, parent_text string")
    curated = spark.createDataFrame([(1, 2, 1, "C", "cur")], "query_id long, entry_id long, rank int, title string, body string")
    row = R.evidence(hits, curated).first()
    assert row.evidence == "[1] C\ncur\n\n[2] T\nbody" and [m.page_id for m in row.markers] == [-2, 8]


def test_subtrees_and_cycles(spark):
    pages = spark.createDataFrame([(1, None, 1), (2, 1, 1), (3, 2, 1), (4, 5, 1), (5, 4, 1), (6, None, 2)], "page_id long, parent_id long, space_id long")
    roots = spark.createDataFrame([("page", 1, 1, ["a"], True), ("page", 4, 1, ["b"], True), ("page", 99, 1, ["c"], True)], "root_type string, root_id long, space_id long, tags array<string>, is_active boolean")
    got = {(r.root_id, r.page_id) for r in O.subtree_coverage(pages, roots).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)}
    scoped = {r.page_id: r.tags for r in O.resolve_space_scope(pages, roots).collect()}
    assert scoped == {1: ["a"], 2: ["a"], 3: ["a"], 4: ["b"], 5: ["b"], 6: []}
    assert {r.page_id for r in O.resolve_space_scope(pages, roots.withColumn("is_active", F.lit(False))).collect()} == {6}


def test_access_lists_fail_closed(spark):
    r = spark.createDataFrame([(1, ["u"], ["g"]), (2, None, ["lost"]), (3, [], []), (4, None, None)], "page_id long, users array<string>, groups array<string>")
    got = {x.page_id: x.principals for x in P.expand_groups(r, spark.createDataFrame([("g", "m"), ("g", "u")], "group_id string, account_id string")).collect()}
    assert got == {1: ["m", "u"], 2: ["__nobody__"]}


VERSIONS = "version_id long, page_id long, cf_version int, parser_version int, chunker_version int, contextualization_version int, retrieval_schema_version int, embedding_model string, state string, activated_at timestamp, superseded_at timestamp"


def tables(spark):
    v = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 1, "m", "superseded", None, None), (2, 1, 2, 1, 1, 1, 1, "m", "active", None, None), (3, 1, 3, 1, 1, 1, 1, "m", "failed", None, None), (4, 2, 1, 1, 1, 1, 1, "m", "active", None, None)], VERSIONS)
    c = spark.createDataFrame([(i, v_, p, 1, a, "current") for i, (v_, p, a) in enumerate([(1, 1, False), (2, 1, True), (4, 2, True)])], "chunk_id long, version_id long, page_id long, kind int, is_active boolean, page_status string")
    r = spark.createDataFrame([(1, "current", 2, 2, 1, 1, 1, 1, "m"), (2, "current", 4, 1, 1, 1, 1, 1, "m")], "page_id long, status string, active_version_id long, cf_version int, parser_version int, chunker_version int, contextualization_version int, retrieval_schema_version int, embedding_model string")
    return v, c, r


def test_roll_back_and_refusals(spark):
    import datetime

    now = datetime.datetime(2030, 1, 1)
    v, c, r = W.activate(*tables(spark), spark.createDataFrame([(1, 1)], "page_id long, version_id long"), now)
    assert {x.version_id: x.state for x in v.collect()} == {1: "active", 2: "superseded", 3: "failed", 4: "active"}
    assert {x.version_id: x.is_active for x in c.collect()} == {1: True, 2: False, 4: True}
    assert {x.page_id: (x.active_version_id, x.cf_version) for x in r.collect()} == {1: (1, 1), 2: (4, 1)}
    for wrong in ((1, 3), (2, 1), (9, 9)):  # failed, of another page, unknown
        v2, _, r2 = W.activate(*tables(spark), spark.createDataFrame([wrong], "page_id long, version_id long"), now)
        assert v2.exceptAll(tables(spark)[0]).count() == 0 and r2.exceptAll(tables(spark)[2]).count() == 0


def test_attachments(spark):
    rows = [("a.csv", None, b"x , y\n,\n\"q,r\",z\n"), ("b.bin", "text/html", b"<p>Hi  <b>you</b></p>"), ("c.md", None, b" # t \n"), ("d.pdf", None, b"%PDF"), ("e.png", None, b"\x89"), ("f.xyz", None, b"?"), ("g.csv", None, None)]
    got = {r.path: (r.method, r.text, r.needs_ocr) for r in P.attachment_text(spark.createDataFrame(rows, "path string, media_type string, content binary")).collect()}
    assert got["a.csv"] == ("csv", "x | y\nq,r | z", False) and got["b.bin"][:2] == ("html", "Hi you") and got["c.md"][:2] == ("markdown", "# t")
    assert got["d.pdf"] == ("pdf", "", True) and got["e.png"][0] == "image" and got["f.xyz"][0] == "skipped" and got["g.csv"][1] == ""


def test_registries(spark, tmp_path):
    good = tmp_path / "scopes.json"
    good.write_text('{"scopes": [{"name": "general"}, {"name": "a"}, {"name": "classified"}]}')
    assert {r.name for r in G.load_scope_registry(spark, str(good), "general").collect()} == {"general", "a"}
    bad = tmp_path / "bad.json"
    bad.write_text('{"scopes": [{"name": "A"}, {"name": "a"}, {"name": "a"}]}')
    with pytest.raises(ValueError, match="upper_case"):
        G.load_scope_registry(spark, str(bad), "general")
    platforms = spark.createDataFrame([("p", 60, ["RS256"]), ("q", 0, ["none"])], "platform string, lifetime_minutes int, algs array<string>")
    integrations = spark.createDataFrame([("i", "a"), ("i", "general"), ("j", "lost"), ("k", "classified")], "integration string, scope string")
    recognized = spark.createDataFrame([("general",), ("a",), ("classified",)], "name string")
    got = {(r.name, r.problem) for r in G.platform_violations(platforms, integrations, recognized, "general").collect()}
    assert got == {("q", "lifetime"), ("q", "algorithm"), ("i", "general_listed"), ("j", "unknown_scope"), ("k", "unknown_scope")}


def test_written_index_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    a = spark.createDataFrame([(1, 5, True), (2, 6, True)], "chunk_id long, space_id long, is_active boolean")
    G.write_index({"chunk": a}, path)
    G.write_index({"chunk": a.where("space_id = 6").withColumn("chunk_id", F.lit(9).cast("long"))}, path)
    assert {(r.chunk_id, r.space_id) for r in spark.read.parquet(f"{path}/chunk").collect()} == {(1, 5), (9, 6)}
    G.write_report(a, a.groupBy().count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "aggregates")).first()["count"] == 2


def test_upsert_and_latest(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, title string, n long")
    assert {tuple(r) for r in C.upsert(t, spark.createDataFrame([(2, None), (3, "c")], "id long, title string"), ("id",)).collect()} == {(1, "a", 1), (2, None, 2), (3, "c", None)}


def test_isolation_check_finds_leaking_guards(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("b", []), ("b", None)], "source_id string, tags array<string>")
    rows = lambda: {(r.kind, r.name): (r.total, r.unscoped, r.own, r.bogus, r.passed) for r in O.isolation_check(chunks, "g").collect()}
    whole = {("source", "a"): (2, 0, 2, 0, True), ("source", "b"): (2, 0, 2, 0, True), ("tag", "x"): (2, 0, 2, 0, True), ("tag", "y"): (1, 0, 1, 0, True)}
    assert rows() == whole
    good = O.V.source_guard, O.V.scope_guard
    monkeypatch.setattr(O.V, "source_guard", lambda s: s.isNull() | good[0](s))
    monkeypatch.setattr(O.V, "scope_guard", lambda s: F.coalesce(F.array_contains(s, "__bogus__"), F.lit(False)) | good[1](s))
    assert rows() == {("source", "a"): (2, 2, 2, 0, False), ("source", "b"): (2, 2, 2, 0, False), ("tag", "x"): (2, 0, 2, 2, False), ("tag", "y"): (1, 0, 1, 1, False)}
    monkeypatch.setattr(O.V, "source_guard", lambda s: F.lit(False))
    assert not any(v[-1] for k, v in rows().items() if k[0] == "source")


def test_keyword_score_sums_to_the_last_repeat(spark):
    tfs = [1, 2, 49, 50, 51, 52, 75, 500, 20_000]
    got = {r.tf: r.s for r in spark.createDataFrame([(t,) for t in tfs], "tf int").select("tf", (R.repeats_weight(F.col("tf")) / 2).alias("s")).collect()}
    for t in tfs:
        assert got[t] == pytest.approx(sum(1 / j**2 for j in range(t, 0, -1)) / 2, abs=1e-12)
    chunks = spark.createDataFrame([(1, 1, "word " * 60), (2, 2, "word " * 400), (3, 3, "word " * 50)], "chunk_id long, page_id long, text string")
    postings = R.chunk_terms(chunks, ("chunk_id",), F.col("text"))
    top = R.keyword_search(spark.createDataFrame([(7, "word")], "query_id long, text string"), postings, chunks.drop("text")).collect()
    assert [r.chunk_id for r in sorted(top, key=lambda r: r["rank"])] == [2, 1, 3]
