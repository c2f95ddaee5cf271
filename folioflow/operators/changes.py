"""Change detection: pages against the registry, chunks against their last version, access lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import GONE, STATUSES, index_config_changed
from .tables import written

STAMPS = ("parser_version", "chunker_version", "contextualization_version", "retrieval_schema_version", "embedding_model")
REBUILD = ("body_changed", "section_added", "section_updated", "section_removed", "section_moved", "index_config_change")


def _match(incoming: DataFrame, registry: DataFrame, targets: dict) -> DataFrame:
    local = registry.select("page_id", F.lit(True).alias("known"), *(F.col(c).alias(f"local_{c}") for c in registry.columns if c != "page_id"))
    out = incoming.join(local, "page_id", "left")
    for s in STAMPS:
        out = out.withColumn(f"target_{s}", F.lit(targets[s]))
    return out


def classify_changes(incoming: DataFrame, registry: DataFrame, targets: dict) -> DataFrame:
    """(page_id, classes, needs_body, needs_reembed, is_delete, body_fetch, action).

    ``incoming`` (page_id, status, version, title, parent_id, and hashes: labels_hash, access_scope_hash,
    attachment_manifest_hash, content_hash and structure_hash, the last two null where no body was fetched);
    ``registry`` has the same columns of what is indexed and the pipeline's stamps.
    """
    m = _match(incoming, registry, targets)
    gone, new = F.col("status").isin(*GONE), F.col("known").isNull()
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("current")
    newer = F.col("version") > F.col("local_version")
    config = index_config_changed(STAMPS)
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"local_{c}"))
    meta = [
        F.when(differs("title"), "title_changed"),
        F.when(differs("parent_id"), "parent_changed"),
        F.when(differs("labels_hash"), "labels_changed"),
        F.when(differs("access_scope_hash"), "permissions_changed"),
        F.when(differs("attachment_manifest_hash"), "attachment_changed"),
        F.when(~status.eqNullSafe(F.col("local_status")), "status_changed"),
    ]
    fetched, content = F.col("content_hash").isNotNull(), differs("content_hash")
    guarded = ~newer & ~config
    body = F.when(fetched & content & ~guarded, F.when(differs("structure_hash"), "section_updated").otherwise("body_changed"))
    found = F.array_sort(F.array_compact(F.array(F.when(config, "index_config_change"), *meta, body)))
    classes = F.when(gone, F.array(F.lit("status_changed"))).when(new, F.array(F.lit("body_changed"))).when(F.size(found) == 0, F.array(F.lit("no_change"))).otherwise(found)
    out = m.withColumn("classes", classes)
    changed = fetched & content & ~guarded
    action = (
        F.when(gone, "deactivated")
        .when(new | F.arrays_overlap("classes", F.array(*map(F.lit, REBUILD))), "indexed")
        .when(F.col("classes") != F.array(F.lit("no_change")), "metadata_only")
        .otherwise("no_change")
    )
    return out.select(
        "page_id",
        "classes",
        F.coalesce(F.when(gone, False).when(new, True).otherwise(config | (~fetched & newer)), F.lit(False)).alias("needs_body"),
        F.coalesce(F.when(gone, False).when(new, True).otherwise(config | changed), F.lit(False)).alias("needs_reembed"),
        F.coalesce(gone, F.lit(False)).alias("is_delete"),
        F.coalesce(F.when(new, ~gone).when(gone, False).when(newer, True).otherwise(config), F.lit(False)).alias("body_fetch"),
        action.alias("action"),
    )


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, new_idx, old_idx, outcome) from (page_id, idx, stable_key, content_key, positional_key) on both sides:
    exact and moved chunks are reused, edited and inserted ones embedded again, the rest of the old ones deleted. Equal
    keys pair in order of index, anew in each pass among what is left. A pass's pairs are written, so that later ones read them and
    don't pair again."""
    left_new, left_old, out = new, old, None
    for key, outcome in (("stable_key", "exact"), ("content_key", "moved"), ("positional_key", "edited")):
        nth = F.row_number().over(Window.partitionBy("page_id", key).orderBy("idx"))
        a = left_new.select("page_id", F.col("idx").alias("new_idx"), key, nth.alias("nth"))
        b = left_old.select("page_id", F.col("idx").alias("old_idx"), key, nth.alias("nth"))
        pairs = a.join(b, ["page_id", key, "nth"]).select("page_id", "new_idx", "old_idx", F.lit(outcome).alias("outcome"))
        pairs = written(pairs, "pairs")
        out = pairs if out is None else out.unionByName(pairs)
        left_new = left_new.join(pairs.select("page_id", F.col("new_idx").alias("idx")), ["page_id", "idx"], "left_anti")
        left_old = left_old.join(pairs.select("page_id", F.col("old_idx").alias("idx")), ["page_id", "idx"], "left_anti")
    none = F.lit(None).cast("int")
    inserted = left_new.select("page_id", F.col("idx").alias("new_idx"), none.alias("old_idx"), F.lit("inserted").alias("outcome"))
    deleted = left_old.select("page_id", none.alias("new_idx"), F.col("idx").alias("old_idx"), F.lit("deleted").alias("outcome"))
    return out.unionByName(inserted).unionByName(deleted)


def reuse_embeddings(diff: DataFrame, old: DataFrame, new: DataFrame, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(carried, to_embed): new chunks with the old retrieval text and embedding where they are reused, and the others.
    ``allowed`` (page_id): pages whose model, dimension and text versions match their active version; others embed all."""
    kept = diff.where(F.col("outcome").isin("exact", "moved"))
    if allowed is not None:
        kept = kept.join(allowed.select("page_id"), "page_id", "left_semi")
    vectors = old.select("page_id", F.col("idx").alias("old_idx"), "retrieval_text", "embedding")
    carried = kept.select("page_id", F.col("new_idx").alias("idx"), "old_idx").join(vectors, ["page_id", "old_idx"]).drop("old_idx").where("embedding is not null")
    return new.join(carried, ["page_id", "idx"]), new.join(carried.select("page_id", "idx"), ["page_id", "idx"], "left_anti")


def reuse_allowed(active: DataFrame, targets: dict) -> DataFrame:
    """Pages (page_id) whose active version has the target model, dimension, contextualization and schema."""
    same = F.lit(True)
    for c in ("embedding_model", "embedding_dim", "contextualization_version", "retrieval_schema_version"):
        same = same & F.col(c).eqNullSafe(F.lit(targets[c]))
    return active.where(same).select("page_id")


def drift_scan(live: DataFrame, registry: DataFrame) -> DataFrame:
    """(space_id, page_id, drift) of all pages that are live or registered: new, drifted (a later version, or another
    status, parent or title), unchanged, or orphan (not live)."""
    r = registry.select("page_id", F.col("space_id").alias("r_space"), *(F.col(c).alias(f"r_{c}") for c in ("version", "status", "parent_id", "title")))
    both = live.withColumn("live", F.lit(True)).join(r.withColumn("known", F.lit(True)), "page_id", "full_outer")
    other = F.lit(False)
    for c in ("status", "parent_id", "title"):
        other = other | ~F.col(c).eqNullSafe(F.col(f"r_{c}"))
    drift = F.when(F.col("live").isNull(), "orphan").when(F.col("known").isNull(), "new").when((F.col("version") > F.col("r_version")) | other, "drifted").otherwise("unchanged")
    return both.select(F.coalesce("space_id", "r_space").alias("space_id"), "page_id", drift.alias("drift"))


def orphans(registry: DataFrame, live: DataFrame, allowed: DataFrame, complete: bool) -> DataFrame:
    """(page_id, decision): current registered pages out of scope (purge), or in scope and not live: purged by a complete
    sweep, checked again by a light one."""
    now = registry.where("status = 'current'").select("page_id")
    out = now.join(allowed, "page_id", "left_anti").select("page_id", F.lit("purge").alias("decision"))
    lost = now.join(allowed, "page_id", "left_semi").join(live.select("page_id"), "page_id", "left_anti")
    return out.unionByName(lost.select("page_id", F.lit("purge" if complete else "recheck").alias("decision")))


def replace_restrictions(acl: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """acl (page_id, principal) with all rows of ``changed`` pages replaced by those of ``fresh``."""
    return acl.join(changed.select("page_id").distinct(), "page_id", "left_anti").unionByName(fresh.join(changed.select("page_id").distinct(), "page_id", "left_semi").distinct())


def metadata_update(rows: DataFrame, updates: DataFrame, columns: tuple[str, ...], only_active: bool = False) -> DataFrame:
    """rows with ``columns`` overwritten where ``updates`` (page_id, columns) has a value; of chunks, the active ones."""
    u = updates.select("page_id", *(F.col(c).alias(f"u_{c}") for c in columns))
    out = rows.join(u, "page_id", "left")
    for c in columns:
        new = F.coalesce(f"u_{c}", c)
        out = out.withColumn(c, F.when(F.col("is_active"), new).otherwise(F.col(c)) if only_active else new)
    return out.drop(*(f"u_{c}" for c in columns))


def latest_version(events: DataFrame, registry: DataFrame) -> DataFrame:
    """The newest event of each page (of equal versions the latest in time), if it is newer than what is indexed."""
    top = events.groupBy("page_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "page_id"]), F.struct("cf_version", "event_timestamp", "event_id")).alias("e")).select("page_id", "e.*")
    return top.join(registry.select("page_id", F.col("version").alias("r_version")), "page_id", "left").where("r_version is null or cf_version > r_version").drop("r_version")


def upsert(table: DataFrame, fresh: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """table with the rows of ``fresh`` in place of those with equal keys, and its new ones; columns that ``fresh`` lacks
    keep their values."""
    f = fresh.select(*keys, F.lit(True).alias("_f"), *(F.col(c).alias(f"f_{c}") for c in fresh.columns if c not in keys))
    out = table.join(f, list(keys), "full_outer")
    return out.select(*keys, *(F.when(F.col("_f"), F.col(f"f_{c}")).otherwise(F.col(c)).alias(c) if c in fresh.columns else F.col(c) for c in table.columns if c not in keys))
