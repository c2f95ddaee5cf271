"""Operators on tables with columns that clash with their own, without rows, and with very long texts."""

import random
import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioflow.llm.chat import as_replies, format_chats, read_back
from folioflow.llm.common import map_suspects, shared_counts, shared_keys
from folioflow.llm.decontam import find_contamination
from folioflow.llm.jaccard import keep_first, similarity_components
from folioflow.llm.linededup import dedup_lines
from folioflow.llm.media import fingerprints, render, search_recordings
from folioflow.llm.packing import pack, token_pieces
from folioflow.llm.secrets import scan_secrets
from folioflow.llm.substring import remove_repeats
from folioflow.llm.toxicity import learn, toxicity
from folioflow.llm.urlfilter import judge_urls, mine_rules

#: Names that operators use inside.
OWN = ("rid", "n", "at", "drop", "digest", "first", "node", "size", "sig", "odd", "same", "cover", "start", "end", "m", "words", "kind", "match", "score", "piece", "length", "grp", "token", "host", "seed", "turns")


def documents(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=120_000))
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(1, f"token = abcdefgh1234\nthe same line here\n{item}"), (2, "the same line here\nmore of it"), (3, None), (4, ""), (5, long), (6, long + " " + item), (None, "a null id"), (7, f"x {item} y"), (7, f"x {item} y")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")


def results(spark, docs, items, labels):
    yield "toxicity", toxicity(docs, learn(docs, labels, F.lit(True)))
    yield "secrets", scan_secrets(docs)
    yield "decontamination", find_contamination(docs, items)
    yield "lines", dedup_lines(docs)
    yield "substrings", remove_repeats(docs)
    yield "packing", pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("sequence_id", "offset")
    yield "jaccard", similarity_components(docs)
    yield "first", keep_first(docs).select("doc_id", "text")
    turns = docs.where("doc_id is not null").select("*", F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"))
    yield "chats", read_back(format_chats(as_replies(turns))).select("conv", "formatted")
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.example/"), F.col("doc_id").cast("string")).alias("url"))
    fixed = spark.createDataFrame([("block", "example", "/1")], "verdict string, host string, path string")
    yield "urls", judge_urls(pages, fixed, mine_rules(pages.select("url", F.col("doc_id").isNotNull().alias("blocked"))))


def test_clashing_columns_change_nothing(spark):
    docs, items = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 0)], "doc_id long, toxic int")
    more = docs.select("*", *(F.lit(1).alias(c) for c in OWN))
    plain = {name: sorted(map(str, df.collect())) for name, df in results(spark, docs, items, labels)}
    for name, df in results(spark, more, items.withColumn("score", F.lit(1)), labels.withColumn("y", F.lit(1))):
        assert sorted(map(str, df.collect())) == plain[name], name
    found = {(r.doc_id, r.item_id) for r in find_contamination(docs, items).collect()}
    assert found == {(1, 1), (6, 1), (7, 1)}


def test_empty_tables(spark):
    docs, items = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for name, df in results(spark, docs.where("false"), items, labels):
        assert df.count() == 0, name
    assert find_contamination(docs, items.where("false")).count() == 0


def test_recordings_without_rows_or_elements(spark):
    schema = "vec_id long, embedding array<float>, codes int, rec_id int"
    rng = random.Random(1)
    vector = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(0, vector, 1, 1), (1, vector, 1, 1), (2, [None, *vector[1:]], 1, 1), (3, None, 1, 1), (4, [], 1, 1), (None, vector, 1, 1)]
    prints = fingerprints(render(spark.createDataFrame(rows, schema), "vec_id", "embedding"))
    got = search_recordings(prints, F.col("rec_id") % 100 == 0).where("kind = 'member'").collect()
    assert {r.rec_id: r.class_id for r in got}[1] == 0 and {r.rec_id for r in got} == {0, 1, 2, 3, 4}
    assert fingerprints(render(spark.createDataFrame([], schema), "vec_id", "embedding")).count() == 0


@pytest.mark.parametrize("bits", [1 << 10, 1 << 12])
def test_filters_by_ranges_lose_nothing(spark, bits):
    rng = random.Random(7)
    lines = [f"line number {i} of many" for i in range(400)]
    docs = spark.createDataFrame([(i, "\n".join(rng.sample(lines, 20))) for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, dedup_lines(docs).collect()))
    assert sorted(map(tuple, dedup_lines(docs, most_bits=bits).collect())) == want


def test_keys_by_ranges(spark):
    """No shared key is missed, few others come along, and a key of all rows is sent on once a batch."""
    rng = np.random.default_rng(5)
    keys = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 30).astype(np.uint64), rng.choice(np.arange(1, 400, dtype=np.uint64) << np.uint64(40), 3), np.array([7], np.uint64)])) for _ in range(1500)]
    rows = spark.createDataFrame([(i, k.tobytes()) for i, k in enumerate(keys)], "tag int, held binary").repartition(6)
    of = lambda b: (np.frombuffer(x, np.uint64) for x in b.column("held").to_pylist())
    df = shared_keys(rows, of, 50_000, 4_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 1  # one pass, whatever the number of ranges
    got = {r.tag: np.frombuffer(b"".join(r["keys"]), np.uint64) for r in df.collect()}
    every, n = np.unique(np.concatenate(keys), return_counts=True)
    shared = every[n > 1]
    others = 0
    for i, k in enumerate(keys):
        assert set(k[np.isin(k, shared)].tolist()) <= set(got[i].tolist()) <= set(k.tolist())
        others += len(set(got[i].tolist())) - np.isin(k, shared).sum()
    assert others < 0.02 * sum(map(len, keys))


def test_shared_keys_are_counted_by_ranges(spark):
    """Of each row, how many keys another one has: rows that are dealt together, rows of other tasks, a key of all, repeated rows."""
    rng = np.random.default_rng(6)
    some = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    keys = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 30).astype(np.uint64), rng.choice(some, 3), np.array([7], np.uint64)[: i % 5]])) for i in range(1500)]
    keys += [np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 1).astype(np.uint64)]
    rows = spark.createDataFrame([(i, k.tobytes()) for i, k in enumerate(keys)], "tag int, held binary").repartition(6)
    of = lambda b: [np.frombuffer(x, np.uint64) for x in b.column("held").to_pylist()]
    every, n = np.unique(np.concatenate(keys), return_counts=True)
    want = {i: int(np.isin(k, every[n > 1]).sum()) for i, k in enumerate(keys)}
    for per_range in (1 << 22, 500):
        df = shared_counts(rows, of, 50_000, per_range)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1
        got = {r.tag: r.hits for r in df.collect()}
        assert all(got.get(i, 0) >= x for i, x in want.items())
        assert sum(got.values()) <= sum(want.values()) + 5
    assert shared_counts(rows.where("tag >= 1500"), of, 1).count() == 0  # no keys, and one that is nowhere else


@pytest.mark.parametrize("keys", [[[1, 2], [3, 4]], [[1, 2], [1, 2]], [[5]]], ids=["none shared", "all shared", "one row"])
def test_batches_that_share_no_key_or_all(spark, keys):
    rows = spark.createDataFrame([(i, np.array(k, np.uint64).tobytes()) for i, k in enumerate(keys)], "tag int, held binary").coalesce(1)
    of = lambda b: [np.frombuffer(x, np.uint64) for x in b.column("held").to_pylist()]
    want = {i: sum(sum(x in other for other in keys) > 1 for x in k) for i, k in enumerate(keys)}
    got = {r.tag: len(b"".join(r["keys"])) // 8 for r in shared_keys(rows, of, 10).collect()}
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}
    assert {r.tag: r.hits for r in shared_counts(rows, of, 10).collect()} == {i: n for i, n in want.items() if n}


def test_suspects_of_a_batch_are_not_sorted_for_each_row(spark):
    """Where the keys need more than a filter, what a batch's rows ask for costs about as much as if they asked at once."""
    rows = spark.createDataFrame([(i, i // 2 * 400 + 1) for i in range(400)], "doc_id long, start long").coalesce(1)
    of = lambda b: [np.unique(np.arange(s, s + 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in b.column("start").to_pylist()]

    def suspects(b, has):
        each, t = of(b), [time.perf_counter()]
        hits = [int(has(k).sum()) for k in each]
        t.append(time.perf_counter())
        np.isin(np.concatenate(each), np.unique(np.concatenate(each)))
        t.append(time.perf_counter())
        return pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), pa.array([(t[1] - t[0]) / (t[2] - t[1])] * len(hits))], ["hits", "ratio"])

    got = map_suspects(rows, rows, of, 160_000, suspects, "hits long, ratio double", 8).collect()
    assert [r.hits for r in got] == [400] * 400
    assert max(r.ratio for r in got) < 10

