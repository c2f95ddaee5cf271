"""Event ingestion and indexing as streams that may be restarted or get deliveries again without harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.filters import DELETE_EVENTS, GONE, subscribed_events
from ..sources.events import dedup_key, parse_events, requested, with_hash
from .state import first_of_key, newer_versions


def _by_batch(rows: DataFrame, path: str, checkpoint: str, *by: str) -> DataStreamWriter:
    """Each batch to its own folder, which a repeated batch overwrites."""
    return rows.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch_id={n}"))


def new_events(raw: DataFrame, service_account: str | None = None) -> DataFrame:
    """The subscribed events of a stream of deliveries (payload, received_at, event_id), each once: the streaming twin of
    `idempotent_insert`. Late, repeated and disordered deliveries change nothing. For output mode update."""
    events = with_hash(subscribed_events(parse_events(raw), service_account))
    return first_of_key(events, dedup_key(), ("received_at", "event_id"))


def stream_ledger(raw: DataFrame, ledger_path: str, checkpoint: str, service_account: str | None = None) -> DataStreamWriter:
    """`new_events` to the ledger, by batch and day of arrival. What came before is keyed state; the ledger is written, never read."""
    return _by_batch(new_events(raw, service_account).withColumn("day", F.to_date("received_at")), ledger_path, checkpoint, "day")


def read_ledger(spark: SparkSession, ledger_path: str, like: DataFrame, service_account: str | None = None) -> DataFrame:
    """The ledger of deliveries like ``like`` as a stream."""
    schema = new_events(like, service_account).withColumn("day", F.to_date("received_at")).schema
    return spark.readStream.schema(schema.add("batch_id", "long")).parquet(ledger_path)


def stream_requests(events: DataFrame, requests_path: str, checkpoint: str, schema_version: int = 1) -> DataStreamWriter:
    """What the events of a ledger, read as a stream, ask for: each idempotency key once, by the first event that has it."""
    return _by_batch(first_of_key(requested(events, schema_version), F.col("idempotency_key"), ("event_id",)), requests_path, checkpoint)


def ingest_events(raw: DataFrame, ledger_path: str, requests_path: str, checkpoint: str, schema_version: int = 1, service_account: str | None = None) -> None:
    """Takes in all deliveries that are there: the ledger first, then the requests of what is new in it."""
    stream_ledger(raw, ledger_path, f"{checkpoint}/ledger", service_account).trigger(availableNow=True).start().awaitTermination()
    events = read_ledger(raw.sparkSession, ledger_path, raw, service_account)
    stream_requests(events, requests_path, f"{checkpoint}/requests", schema_version).trigger(availableNow=True).start().awaitTermination()


def stream_latest_page(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Events that apply, to a table by batch: deletions, and each page's newest version if newer than all before. State is one row a page."""
    return _by_batch(newer_versions(events, F.col("event_type").isin(*DELETE_EVENTS)), path, checkpoint)


# --- index versions ---------------------------------------------------------------------------------


def _file(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def published(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """For each bucket of pages the batch that wrote its pointers last, by the last manifest (before batch ``before``); empty without one.
    A manifest counts once it is committed as a whole."""
    fs, root = _file(spark, f"{path}/manifests")
    if not fs.exists(root):
        return {}
    done = [int(s.getPath().getName()) for s in fs.listStatus(root) if fs.exists(_file(spark, f"{s.getPath()}/_SUCCESS")[1])]
    done = [n for n in done if before is None or n < before]
    return {r.bucket: r.batch_id for r in spark.read.parquet(f"{path}/manifests/{max(done)}").collect()} if done else {}  # a row a bucket


POINTERS = "page_id long, cf_version long, status string, batch_id long, bucket int"


def _pointers(spark: SparkSession, path: str, of: dict[int, int], buckets: set[int] | None = None) -> DataFrame:
    at = [f"{path}/pointers/of={n}/bucket={b}" for b, n in of.items() if buckets is None or b in buckets]
    if not at:
        return spark.createDataFrame([], POINTERS)
    return spark.read.schema("page_id long, cf_version long, status string, batch_id long").parquet(*at).withColumn("bucket", F.lit(0))


def swap_versions(pages: DataFrame, batch_id: int, build: Callable[[DataFrame], DataFrame], path: str, buckets: int = 64) -> None:
    """Builds, stages, activates and publishes a batch of page versions (page_id, cf_version, status, ...) as one step.

    ``build`` turns pages into chunks with page_id and cf_version. Versions that are newer than their page's active one are staged: their chunks go
    to a folder of this batch. Those with chunks may become active, and of a page the newest one does; a newer page that is gone
    (trashed, deleted, archived) takes its page out. Then the pointers of the touched buckets of pages are written anew, and last a manifest that says
    for each bucket which batch's pointers hold. Readers go by the last manifest: before it is there they see the old versions,
    and a batch that is repeated starts from the manifest before it and replaces what it wrote.
    """
    spark = pages.sparkSession
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
    before = published(spark, path, batch_id)
    pages = pages.where("page_id is not null and cf_version is not null").withColumn("cf_version", F.col("cf_version").cast("long"))
    touched = {r[0] for r in pages.select(bucket).distinct().collect()}  # a number a bucket at most
    if not touched:
        return
    old = _pointers(spark, path, before, touched).drop("bucket")
    have = old.select("page_id", F.col("cf_version").alias("_have"))
    newer = pages.join(have, "page_id", "left").where("_have is null or cf_version > _have").drop("_have")
    is_gone = F.col("status").isin(*GONE)
    staged = f"{path}/chunks/batch_id={batch_id}"
    build(newer.where(~F.coalesce(is_gone, F.lit(False)))).write.mode("overwrite").parquet(staged)
    built = spark.read.parquet(staged).select("page_id", "cf_version").distinct()
    able = built.select("page_id", F.col("cf_version").cast("long").alias("cf_version"), F.lit("active").alias("status")).unionByName(newer.where(is_gone).select("page_id", "cf_version", F.lit("gone").alias("status")))
    chosen = able.groupBy("page_id").agg(F.max_by(F.struct("cf_version", "status"), F.struct("cf_version", "status")).alias("x")).select("page_id", "x.*", F.lit(batch_id).cast("long").alias("batch_id"))
    now = old.join(chosen.select("page_id"), "page_id", "left_anti").unionByName(chosen).withColumn("bucket", bucket)
    now.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pointers/of={batch_id}")
    wrote = {r[0] for r in spark.read.parquet(f"{path}/pointers/of={batch_id}").select("bucket").distinct().collect()}
    publish(spark, path, batch_id, before | dict.fromkeys(wrote, batch_id))


def publish(spark: SparkSession, path: str, batch_id: int, of: dict[int, int]) -> None:
    spark.createDataFrame(sorted(of.items()), "bucket int, batch_id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{batch_id}")


def active_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the active versions, by the last manifest: pointers join the folders of the batches that built them."""
    on = _pointers(spark, path, published(spark, path)).where("status = 'active'").select("page_id", "cf_version", "batch_id")
    return spark.read.parquet(f"{path}/chunks").join(on, ["batch_id", "page_id", "cf_version"])


def stream_versions(pages: DataFrame, checkpoint: str, build: Callable[[DataFrame], DataFrame], path: str, buckets: int = 64) -> DataStreamWriter:
    """Changed pages as a stream to active index versions; see `swap_versions`."""
    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: swap_versions(df, n, build, path, buckets))


def stream_index(pages: DataFrame, checkpoint: str, build: Callable[[DataFrame], dict[str, DataFrame]], path: str) -> DataStreamWriter:
    """Changed pages to index tables, each batch in its own folder; a repeated batch overwrites its own output alone."""

    def batch(df: DataFrame, n: int) -> None:
        for name, table in build(df).items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={n}")

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
