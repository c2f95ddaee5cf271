"""Change events: tolerant parsing, idempotent insertion and the requests they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import event_payload_hash
from ..operators.filters import DELETE_EVENTS, SPACE_EVENTS
from ..operators.tables import numbered


_TOP = "id string, spaceId string, status string, version struct<number string>"
#: Both shapes at once; every leaf is text until it is looked at.
PAYLOAD = f"""eventType string, event string, event_type string, page_id string, cf_version string, space_id string, status string,
actor_account_id string, userAccountId string, delivery_id string, deliveryId string, event_timestamp string, timestamp string,
page struct<{_TOP}>, content struct<{_TOP}>, space struct<id string>, actor struct<accountId string>"""


def _get(*paths: str) -> Column:
    """The first of the payload's fields with a value that is not empty."""
    return F.coalesce(*(F.when(F.col(f"_p.{p}") != "", F.col(f"_p.{p}")) for p in paths))


def _whole(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("long"))


def parse_events(raw: DataFrame, payload: str = "payload", received: str = "received_at") -> DataFrame:
    """The events of JSON payloads in either of two shapes, nested or flat; what isn't a whole number is null. An event
    without a time has its time of arrival. Each payload is parsed once: the parsed struct comes out of a generator, which
    filters on its fields don't pass."""
    both = lambda *names: tuple(f"{top}.{n}" for top in ("page", "content") for n in names)
    text = raw.select("*", F.explode(F.array(F.from_json(payload, PAYLOAD))).alias("_p")).select(
        *raw.columns,
        F.coalesce(_get("eventType", "event", "event_type"), F.lit("")).alias("event_type"),
        _get("page_id", *both("id")).alias("page_id"),
        _get("cf_version", *both("version.number")).alias("cf_version"),
        _get("space_id", *both("spaceId"), "space.id").alias("space_id"),
        _get("status", *both("status")).alias("status"),
        _get("actor_account_id", "userAccountId", "actor.accountId").alias("actor_account_id"),
        _get("delivery_id", "deliveryId").alias("delivery_id"),
        _get("event_timestamp", "timestamp").alias("event_timestamp"),
    )
    whole = {c: _whole(F.col(c)) for c in ("page_id", "cf_version", "space_id")}
    return text.withColumns(whole | {"event_timestamp": F.coalesce(F.col("event_timestamp").try_cast("timestamp"), F.col(received))})


def with_hash(events: DataFrame) -> DataFrame:
    return events.withColumn("payload_hash", event_payload_hash(*(F.col(c) for c in ("event_type", "page_id", "cf_version", "space_id", "status")), F.col("event_timestamp").cast("string"), F.col("delivery_id")))


def dedup_key() -> Column:
    """What makes a delivery one that came before: the delivery id, or the payload's hash (which covers the delivery id) where there is none."""
    return F.coalesce(F.concat(F.lit("d:"), F.col("delivery_id")), F.concat(F.lit("h:"), F.col("payload_hash")))


def idempotent_insert(events: DataFrame, ledger: DataFrame | None = None, order: tuple[str, ...] = ("received_at", "event_id")) -> DataFrame:
    """The events whose payload hash and delivery id are new, the first of each. One key is exact (`dedup_key`); a null id is
    no hot key. One aggregate, no self-join."""
    new = events.groupBy(dedup_key().alias("dedup_key")).agg(F.min_by(F.struct(*(F.col(c) for c in events.columns)), F.struct(*order)).alias("first")).select("first.*", "dedup_key")
    return new if ledger is None else new.join(ledger.select(dedup_key().alias("dedup_key")), "dedup_key", "left_anti")


def requested(events: DataFrame, schema_version: int) -> DataFrame:
    """(idempotency_key, request_type, page_id, space_id, version, priority, event_id): what each event asks for; keys may repeat."""
    is_space, is_delete = F.col("event_type").isin(*SPACE_EVENTS), F.col("event_type").isin(*DELETE_EVENTS)
    kind = F.when(is_space, "reconcile_space").when(is_delete, "delete_page").otherwise("sync_page")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    key = (
        F.when(is_space, F.concat_ws(":", kind, text("space_id"), text("event_id")))
        .when(is_delete, F.concat_ws(":", kind, text("page_id"), "event_type"))
        .otherwise(F.concat_ws(":", kind, text("page_id"), "event_type", F.coalesce(F.col("cf_version").cast("string"), F.lit("na")), F.lit(str(schema_version))))
    )
    return events.where("not self_generated").select(key.alias("idempotency_key"), kind.alias("request_type"), "page_id", "space_id", F.col("cf_version").alias("version"), F.when(is_delete, 50).otherwise(100).alias("priority"), "event_id")


def requests(events: DataFrame, schema_version: int, present: DataFrame | None = None) -> DataFrame:
    """(idempotency_key, request_type, page_id, space_id, version, priority, event_id): what events ask for, the first (by
    event id) of each key that isn't in ``present``."""
    first = requested(events, schema_version).groupBy("idempotency_key").agg(F.min_by(F.struct("request_type", "page_id", "space_id", "version", "priority", "event_id"), "event_id").alias("r")).select("idempotency_key", "r.*")
    return first if present is None else first.join(present.select("idempotency_key"), "idempotency_key", "left_anti")


def request_order(waiting: DataFrame) -> DataFrame:
    """By priority, then time, then key (deletes before syncs)."""
    return numbered(waiting, ("priority", "available_at", "idempotency_key"))
