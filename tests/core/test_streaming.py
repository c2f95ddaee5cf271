import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.sources.events import idempotent_insert, parse_events, requests, with_hash
from folioflow.operators.filters import subscribed_events
from folioflow.streaming import jobs, state


def test_limit_counts_accepted_hits_and_the_edge():
    second = 1_000_000
    times = [t * second for t in (0, 0, 10, 60, 61, 61, 70, 200)]
    accepted: list[int] = []
    assert state.limit_hits(times, accepted, 2, 60 * second) == [True, True, False, False, True, True, False, True]


def test_replay_restarts_after_the_ttl():
    got, stored = state.replay_hits([0, 5, 10, 11, 20, 22], None, 10)
    assert got == [False, True, True, False, True, False] and stored == 22


def hits(spark, n=400):
    rng = random.Random(2)
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2])}", i, rng.randint(0, 400)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, hit_id long, s long").select("key", "hit_id", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("what", ["limit", "replay"])
def test_batch_equals_stream(spark, tmp_path, what):
    df = hits(spark)
    batch, stream = (state.rate_limit(df, most=3), state.stream_rate_limit) if what == "limit" else (state.ttl_replay(df, seconds=30), state.stream_ttl_replay)
    want = sorted(map(tuple, batch.collect()))
    brute = []
    for key in sorted({r[0] for r in want}):
        mine = sorted((r.ts, r.hit_id) for r in df.where(F.col("key") == key).collect())
        times = [int(t.timestamp() * 1e6) for t, _ in mine]
        flags = state.limit_hits(times, [], 3, 60_000_000) if what == "limit" else state.replay_hits(times, None, 30_000_000)[0]
        brute += [(key, h, t, ok) for (t, h), ok in zip(mine, flags, strict=True)]
    assert want == sorted(brute)
    src = str(tmp_path / "in")
    for k in range(3):  # files in order of time are batches
        df.withColumn("n", F.row_number().over(Window.orderBy("ts", "hit_id"))).where(f"(n - 1) div 134 = {k}").drop("n").coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = stream(source, 3) if what == "limit" else stream(source, 30)
    q = out.writeStream.format("memory").queryName(f"out_{what}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").start()
    try:
        q.awaitTermination(240)
        assert sorted(map(tuple, spark.table(f"out_{what}").select(*batch.columns).collect())) == want
    finally:
        q.stop()


def payloads(spark):
    flat = lambda **x: json.dumps(x)
    rows = [
        flat(event_type="page_updated", page_id=1, cf_version=2, space_id=9, delivery_id="d1", event_timestamp="2024-01-01T00:00:00Z"),
        flat(event_type="page_updated", page_id=1, cf_version=2, space_id=9, delivery_id="d1", event_timestamp="2024-01-01T00:00:00Z"),
        flat(event_type="page_updated", page_id=1, cf_version=3, space_id=9, delivery_id="d1", event_timestamp="2024-01-01T00:00:01Z"),
        flat(eventType="page_trashed", page={"id": "1", "version": {"number": 4}, "spaceId": 9, "status": "trashed"}, deliveryId="d2", userAccountId="me"),
        flat(eventType="page_trashed", page={"id": "2", "version": {"number": True}}, space={"id": 9}, deliveryId="d3"),
        flat(event="space_updated", space={"id": 9}, deliveryId="d4"),
        flat(event_type="unknown", page_id=1),
        "not json",
        flat(event_type="page_created", page_id="x7", cf_version=1.5, delivery_id="d5", event_timestamp="2024-01-02T00:00:00Z"),
    ]
    return spark.createDataFrame([(i, p, i) for i, p in enumerate(rows)], "event_id long, payload string, s long").select("event_id", "payload", F.timestamp_seconds("s").alias("received_at"))


def test_parsing_and_requests(spark):
    events = with_hash(subscribed_events(parse_events(payloads(spark)), "me"))
    got = {r.event_id: r for r in events.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 8}
    assert got[3].page_id == 1 and got[3].cf_version == 4 and got[3].self_generated and got[3].event_timestamp == got[3].received_at
    assert got[4].cf_version is None and got[4].space_id == 9 and got[8].page_id is None and got[8].cf_version is None
    assert got[0].payload_hash == got[1].payload_hash != got[2].payload_hash
    new = idempotent_insert(events)
    assert {r.event_id for r in new.collect()} == {0, 3, 4, 5, 8}
    keys = {r.idempotency_key: r.priority for r in requests(new, 1).collect()}
    assert keys == {"sync_page:1:page_updated:2:1": 100, "delete_page:2:page_trashed": 50, "reconcile_space:9:5": 100, "sync_page:None:page_created:na:1": 100}


def arrive(rows, src):
    """One file, so one micro-batch."""
    rows.coalesce(1).write.mode("append").parquet(src)


def take_in(spark, raw, tmp_path):
    """All that arrived, by streams that start anew from their checkpoints."""
    source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.ingest_events(source, str(tmp_path / "ledger"), str(tmp_path / "requests"), str(tmp_path / "ck"), service_account="me")
    return spark.read.parquet(str(tmp_path / "ledger")), spark.read.parquet(str(tmp_path / "requests"))


def test_repeated_and_disordered_batches_change_nothing(spark, tmp_path):
    raw = payloads(spark)
    for part in (raw.where("event_id >= 4"), raw, raw, raw.where("event_id < 3")):
        arrive(part, str(tmp_path / "in"))
        ledger, asked = take_in(spark, raw, tmp_path)
    assert sorted(r.event_id for r in ledger.collect()) == [0, 3, 4, 5, 8] and "day" in ledger.columns
    assert asked.count() == asked.select("idempotency_key").distinct().count() == 4


def test_late_and_repeated_deliveries_equal_the_batch_twin(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["page_updated", "page_trashed", "space_updated", "label_added", "unknown"]
    said = lambda i: json.dumps({"event_type": rng.choice(kinds), "page_id": i % 13, "cf_version": i % 5, "space_id": i % 3, "delivery_id": f"d{i}" if i % 3 else None})
    bodies = [said(i) for i in range(150)]
    n, batches = 0, []
    for b in range(10):
        pick = [bodies[min(149, 15 * b + rng.randrange(15))] if rng.random() < 0.6 else rng.choice(bodies[: 15 * b + 15]) for _ in range(40)]
        batches.append([(n + i, p, n + i) for i, p in enumerate(pick)])
        n += 40
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, payload string, s long").select("event_id", "payload", F.timestamp_seconds("s").alias("received_at"))
    whole = frame([r for b in batches for r in b])
    for b in batches:
        arrive(frame(b), str(tmp_path / "in"))
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_ledger(source, str(tmp_path / "ledger"), str(tmp_path / "ck" / "ledger")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    seen = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(seen) == 10
    for p in seen:  # a batch reads its deliveries, nothing of the ledger
        assert len(p["sources"]) == 1 and p["numInputRows"] == 40
        assert p["stateOperators"][0]["numRowsUpdated"] <= 40
    ledger, asked = take_in(spark, whole, tmp_path)
    events = with_hash(subscribed_events(parse_events(whole), "me"))
    assert sorted(r.event_id for r in ledger.collect()) == sorted(r.event_id for r in idempotent_insert(events).collect())
    want = {r.idempotency_key: r.event_id for r in requests(idempotent_insert(events), 1).collect()}
    assert {r.idempotency_key: r.event_id for r in asked.collect()} == want and asked.count() == len(want)


def test_stream_ingest(spark, tmp_path):
    payloads(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    kept, _ = take_in(spark, payloads(spark), tmp_path)
    assert kept.count() == 5 and kept.select("delivery_id").distinct().count() == 5


def test_only_newer_versions_apply(spark, tmp_path):
    e = lambda *rows: spark.createDataFrame(list(rows), "event_id long, event_type string, page_id long, cf_version long, s long").withColumn("event_timestamp", F.timestamp_seconds("s"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        e((1, "page_updated", 7, 2, 0), (2, "page_updated", 7, 3, 1), (3, "page_updated", 8, 1, 1), (9, "page_updated", 9, None, 1)),
        e((4, "page_updated", 7, 2, 5), (5, "page_trashed", 7, 1, 6), (6, "page_updated", 8, 2, 7), (7, "page_updated", 8, 2, 8)),
        e((8, "page_updated", 7, 3, 9), (10, "page_updated", 8, 3, 9)),
    ]
    got = []
    for b in batches:  # the stream starts anew from its checkpoint each time
        arrive(b, src)
        q = jobs.stream_latest_page(spark.readStream.schema(b.schema).parquet(src), out, str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        got.append({(r.event_id, r.page_id) for r in spark.read.parquet(out).collect()} - set().union(*got))
    assert got == [{(2, 7), (3, 8)}, {(5, 7), (7, 8)}, {(10, 8)}]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # a row a page


def lines_of(df):
    return df.select("page_id", "cf_version", F.posexplode(F.split("text", "\n")).alias("seq", "line")).where("line <> ''")


def active(spark, path):
    return {(r.page_id, r.cf_version, r.line) for r in jobs.active_chunks(spark, path).collect()}


def versions(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, cf_version int, status string, text string")


def test_versions_swap_as_one_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    swap = lambda n, *rows: jobs.swap_versions(versions(spark, *rows), n, lines_of, path, 4)
    swap(0, (1, 1, "current", "a\nb"), (2, 1, "current", "c"), (3, 1, "current", ""), (4, 2, "current", "d"))
    first = {(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (4, 2, "d")}
    assert active(spark, path) == first  # page 3 has no chunk: its version failed
    with monkeypatch.context() as m:  # killed after staging, before the manifest
        m.setattr(jobs, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            swap(1, (1, 2, "current", "A"), (2, 3, "trashed", "x"))
    assert active(spark, path) == first
    for _ in range(2):  # the batch comes again, and again
        swap(1, (1, 2, "current", "A"), (2, 3, "trashed", "x"))
        assert active(spark, path) == {(1, 2, "A"), (4, 2, "d")}
    swap(2, (1, 1, "current", "late"), (2, 2, "current", "late"), (3, 2, "current", "e"), (3, 3, "current", ""), (4, 1, "deleted", ""))
    assert active(spark, path) == {(1, 2, "A"), (3, 2, "e"), (4, 2, "d")}
    swap(3)
    before = jobs.published(spark, path)
    swap(4, (4, 3, "current", "D"))
    after = jobs.published(spark, path)
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket's pointers were written anew
    assert active(spark, path) == {(1, 2, "A"), (3, 2, "e"), (4, 3, "D")}


def test_stream_of_versions(spark, tmp_path):
    rng = random.Random(3)
    rows = [(p, v, "trashed" if rng.random() < 0.1 else "current", rng.choice(["", "x", "y\nz"]) + (f"\n{p}-{v}" if rng.random() < 0.7 else "")) for p in range(25) for v in range(4)]
    rng.shuffle(rows)
    src, path = str(tmp_path / "in"), str(tmp_path / "index")
    for i in range(0, 100, 25):
        arrive(versions(spark, *rows[i : i + 25]), src)
    source = spark.readStream.schema(versions(spark, rows[0]).schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.stream_versions(source, str(tmp_path / "ck"), lines_of, path, 8).trigger(availableNow=True).start().awaitTermination(240)
    want = set()
    for p in range(25):
        able = [r for r in rows if r[0] == p and (r[2] == "trashed" or r[3].strip("\n"))]
        last = max(able, key=lambda r: r[1], default=None)
        if last and last[2] != "trashed":
            want |= {(p, last[1], x) for x in last[3].split("\n") if x}
    assert active(spark, path) == want


def test_stream_index_writes_each_batch_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(6).write.parquet(src)
    source = spark.readStream.schema("id long").parquet(src)
    q = jobs.stream_index(source, str(tmp_path / "ck"), lambda df: {"chunk": df.selectExpr("id", "id * 2 AS n")}, out).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert {r.n for r in spark.read.parquet(f"{out}/chunk").collect()} == {0, 2, 4, 6, 8, 10}
