"""Operators that were built to hold at any size: stems, page trees, percentiles, visibility, embeddings kept, pruned vector search."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions.stems import stem, stem_dictionary
from folioflow.operators import chunking as K
from folioflow.operators import evaluation as E
from folioflow.operators import filters as V
from folioflow.operators import scope as O
from folioflow.operators import search as R

#: The examples that the published description gives for its steps, with the stem after all steps. Fixed values.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil"""


def test_published_examples():
    pairs = STEMS.split()
    assert {a: stem(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert [stem(x) for x in ("a", "is", "", "été", "x1ing", "by", "sky", "toy")] == ["a", "is", "", "été", "x1ing", "by", "sky", "toi"]


def test_inflected_words_meet(spark):
    docs = spark.createDataFrame([(1, "He runs and was running"), (2, "a run"), (3, "runner"), (4, None)], "chunk_id long, text string")
    text = F.col("text")
    plain = R.chunk_terms(docs, ("chunk_id",), text)
    stems = R.chunk_terms(docs, ("chunk_id",), text, stems=True)
    assert {(r.chunk_id, r.term, r.tf) for r in stems.where("term = 'run'").collect()} == {(1, "run", 2), (2, "run", 1)}
    assert plain.agg(F.sum("tf")).first()[0] == stems.agg(F.sum("tf")).first()[0] == 8
    q = spark.createDataFrame([(7, "running")], "query_id long, text string")
    meta = docs.select("chunk_id", F.col("chunk_id").alias("page_id"))
    found = lambda p, **how: [r.chunk_id for r in R.keyword_search(q, p, meta, **how).orderBy("rank").collect()]
    assert found(plain) == [1] and found(stems, stems=True) == [1, 2]
    assert stem_dictionary(plain).count() == plain.select("term").distinct().count()


def test_postings_of_stems_join_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the walking walks") for i in range(50)], "chunk_id long, text string")
    monkeypatch.setattr(R, "MOST_STEMS", 0)
    got = R.chunk_terms(docs, ("chunk_id",), F.col("text"), stems=True)
    assert {(r.term, r.tf) for r in got.collect()} == {("the", 1), ("walk", 2)} and got.count() == 100


def test_terms_are_counted_where_the_rows_are(spark):
    text = F.col("text")
    docs = spark.createDataFrame([(i, f"One two two w{i}, walking WALKS" if i % 5 else None) for i in range(40)], "chunk_id long, text string")
    for stems, walk in ((False, [("walking", 1), ("walks", 1)]), (True, [("walk", 2)])):
        got = R.chunk_terms(docs, ("chunk_id",), text, ("one",), stems)
        assert "chunk_id" not in (got._jdf.queryExecution().toString().split("Physical Plan")[-1].split("Exchange")[1:] or [""])[0]  # no shuffle
        assert sorted((r.chunk_id, r.term, r.tf) for r in got.collect()) == sorted((i, *x) for i in range(40) if i % 5 for x in [("two", 2), (f"w{i}", 1), *walk])
    twice = docs.unionByName(docs.where("chunk_id < 3")).unionByName(spark.createDataFrame([(None, "a b"), (None, "b")], docs.schema))
    got = {(r.chunk_id, r.term): r.tf for r in R.chunk_terms(twice, ("chunk_id",), text).collect()}
    assert (got[1, "two"], got[2, "one"], got[3, "two"], got[None, "a"], got[None, "b"]) == (4, 2, 2, 1, 2)
    only = spark.createDataFrame([("walk",), ("w7",), ("none",)], "term string")
    assert {(r.term, r.tf) for r in R.chunk_terms(docs, ("chunk_id",), text, stems=True, only=only).collect()} == {("walk", 2), ("w7", 1)}


def test_wanted_terms_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 3} b{i % 3}") for i in [*range(9), 4, 4]], "chunk_id long, text string")
    only = spark.createDataFrame([("b1",), ("x",)], "term string")
    want = {(1, "b1", 2), (4, "b1", 6), (7, "b1", 2)}
    for most in (R.MOST_TERMS, 0):
        monkeypatch.setattr(R, "MOST_TERMS", most)
        assert {tuple(r) for r in R.chunk_terms(docs, ("chunk_id",), F.col("text"), only=only).collect()} == want


def test_batches_of_a_stream_have_many_files(spark, tmp_path):
    from folioflow.plans.catalogue import _dealt

    path = str(tmp_path / "dealt")
    assert _dealt(spark.range(0, 9_000, 1, 17), path, 4) == 5
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 9_000 and max(sizes) < 600
    assert _dealt(spark.range(0, 9, 1, 1), str(tmp_path / "few"), 4) == 1


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    chain = spark.range(n).selectExpr("id AS page_id", "nullif(id - 1, -1) AS parent_id", "1 AS space_id")
    roots = spark.createDataFrame([("page", 0), ("page", 9_000), ("page", 9_990), ("page", 123_456)], "root_type string, root_id long")
    whole = O.written
    monkeypatch.setattr(O, "written", lambda df, name: (rounds.append(name), whole(df, name))[1])
    got = O.subtree_coverage(chain, roots)
    assert {r.root_id: (r["n"], r.low) for r in got.groupBy("root_id").agg(F.count("*").alias("n"), F.min("page_id").alias("low")).collect()} == {0: (10_000, 0), 9_000: (1_000, 9_000), 9_990: (10, 9_990)}
    assert rounds.count("jumps") <= 16


def test_trees_with_cycles_equal_a_walk(spark):
    rng = random.Random(4)
    parent = {i: rng.choice([None, *range(60)]) for i in range(60)}
    parent[70], parent[71] = 999, 70  # below a page that isn't there
    roots = rng.sample(range(60), 8) + [70]
    pages = spark.createDataFrame([(i, p, i % 3) for i, p in parent.items()], "page_id long, parent_id long, space_id long")
    got = {(r.root_id, r.page_id) for r in O.subtree_coverage(pages, spark.createDataFrame([("page", r) for r in roots], "root_type string, root_id long")).collect()}
    want = set()
    for i in parent:
        at, seen = i, set()
        while at is not None and at in parent and at not in seen:
            seen.add(at)
            if at in roots:
                want.add((at, i))
            at = parent[at]
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 7, 20_000])
def test_percentiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    rows = [(str(g) if g else None, float(x)) for g in range(3) for x in np.round(rng.normal(size=n), 1 if g == 1 else 9)]
    df = spark.createDataFrame([*rows, ("empty", None)], "g string, v double").repartition(7)
    got = {r.g: r for r in E.exact_percentiles(df, ["g"], "v", (0.0, 0.5, 0.95, 0.99, 1.0)).collect()}
    assert set(got) == {None, "1", "2"}
    for g in got:
        mine = [x for k, x in rows if k == g]
        assert got[g].n == n and np.allclose(got[g].p, np.quantile(mine, [0, 0.5, 0.95, 0.99, 1]), atol=1e-12)
    assert E.latency_summary(df.where("false"), ["g"], "v").count() == 0
    assert E.latency_summary(df, [], "v").first()["n"] == 3 * n


def test_no_task_holds_a_groups_values(spark):
    """One group of 400,000 distinct values: what a task ranks is a range of it."""
    df = spark.range(400_000).select((F.col("id") * 0.5).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        p = E.exact_percentiles(df, [], "v", (0.5, 0.99))
        assert p.first().p == [99_999.75, pytest.approx(0.99 * 399_999 / 2)]
        assert "percentile(" not in p._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_visible_counts_equal_the_guards(spark):
    rng = random.Random(2)
    tags = lambda: rng.choice([None, [], ["a"], ["b", "a"], ["a", "b"], ["c"]])
    chunks = spark.createDataFrame([(i, rng.randrange(4), f"s{rng.randrange(3)}", rng.choice([0, 1]), rng.random() < 0.8, rng.choice(["current", "archived"]), tags()) for i in range(500)], "chunk_id long, space_id long, source_id string, kind int, is_active boolean, page_status string, tags array<string>")
    asks = [(0, None, ["s0", "s0"], ["a"]), (1, 2, ["s0", "s1"], ["*"]), (2, None, [], ["*"]), (3, None, None, None), (4, None, ["s0", "s1", "s2"], None), (5, 1, ["s2"], ["b", "c"])]
    q = spark.createDataFrame(asks, "q long, space long, sources array<string>, scopes array<string>")
    cube = V.visibility_cube(chunks)
    assert cube.count() < 4 * 3 * 5 + 1
    got = {r.q: (r.chunks, r.untagged, r.ids) for r in V.visible_counts(q, cube, "q").collect()}
    want = {}
    for i, space, sources, scopes in asks:
        c = chunks.where(V.base_filter(F.lit(space).cast("long")) & V.source_guard(F.lit(sources) if sources else F.lit(None).cast("array<string>")) & V.scope_guard(F.lit(scopes) if scopes else F.lit(None).cast("array<string>")))
        r = c.agg(F.count("*"), F.count_if(F.size("tags") == 0), F.sum("chunk_id")).first()
        if r[0]:
            want[i] = tuple(r)
    assert got == want and len(want) == 4


def counting(log, breaks=None):
    """Notes every text that it embeds in a file, and breaks off at one."""

    def embed(texts):
        if breaks in texts:
            raise RuntimeError("interrupted")
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_each_text_is_embedded_once(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"text {i % 40}") for i in range(400)] + [(400, None), (401, "")], "id long, text string").repartition(6)
    number = F.pmod(F.xxhash64(F.sha2(F.encode("text", "UTF-8"), 256)), F.lit(8))
    fifth = rows.where("text <> ''").select("text", number.alias("slice")).where("slice >= 4").orderBy("slice", "text").first().text
    with pytest.raises(Exception, match="interrupted"):
        K.embed_once(rows, counting(log, fifth), store, slices=8)
    kept = open(log).read().count("\n") if os.path.exists(log) else 0
    done = spark.read.parquet(store).count() if os.path.exists(store) else 0
    assert 0 < done < 41
    out = K.embed_once(rows, counting(log), store, slices=8)
    assert {(r.id, r.embedding[0]) for r in out.collect()} == {(i, float(len(f"text {i % 40}"))) for i in range(400)} | {(400, 0.0), (401, 0.0)}
    again = open(log).read().split("\n")[kept:-1]
    assert len(again) == len(set(again)) == 41 - done  # only what no committed slice has
    more = rows.unionByName(spark.createDataFrame([(500, "new one")], "id long, text string"))
    assert K.embed_once(more, counting(log), store, slices=8).count() == 403
    assert open(log).read().split("\n")[kept + len(again) : -1] == ["new one"]


def test_pruned_vector_search_is_exact_and_computes_few_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(0, 30, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    v[17] = 0
    vectors = spark.createDataFrame([(i, i // 3, x.tolist(), i % 2) for i, x in enumerate(v)], "chunk_id long, page_id long, embedding array<double>, space long").repartition(6)
    q = spark.createDataFrame([(i, (v[i * 50] + 0.01).tolist(), i % 2) for i in range(40)], "query_id long, vec array<double>, space long")
    see = lambda a, b: a["space"].to_numpy()[:, None] == b["space"].to_numpy()[None, :]
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for visible in (None, see):
        counter = spark.sparkContext.accumulator(0)
        got = {}
        for r in R.dense_search(q, vectors, visible, k=12, block=15, per_cell=60, counter=counter).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        for i in range(40):
            w = v[i * 50] + 0.01
            d = np.round(1 - u @ (w / np.linalg.norm(w)), 9)
            assert got[i] == sorted((j for j in range(4000) if visible is None or j % 2 == i % 2), key=lambda j: (d[j], j // 3, j))[:12]
        assert counter.value < 0.4 * 40 * 4000, counter.value
