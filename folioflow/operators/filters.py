"""Visibility rules and other predicates over chunks, queries, labels and events; unknown means denied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types by what they trigger. Fixed values.
DELETE_EVENTS = ("page_trashed", "page_archived", "page_removed", "page_deleted")
SYNC_EVENTS = (
    "page_created", "page_updated", "page_moved", "page_restored", "page_unarchived", "attachment_created",
    "attachment_updated", "attachment_removed", "label_added", "label_deleted", "page_permissions_updated",
)
SPACE_EVENTS = ("space_updated", "space_permissions_updated")
GONE = ("trashed", "deleted", "archived")
STATUSES = ("current", "draft", "trashed", "archived", "deleted")
ANY_SCOPE = "*"


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def base_filter(space: Column | None = None, sources: Column | None = None, scopes: Column | None = None) -> Column:
    """Active child chunks of current pages; of a space, of sources, with an overlapping tag, where these are given
    (not null). With scopes given, an untagged chunk never matches."""
    ok = _false(F.col("is_active") & (F.col("kind") == 1) & (F.col("page_status") == "current"))
    if space is not None:
        ok = ok & (space.isNull() | _false(F.col("space_id") == space))
    if sources is not None:
        ok = ok & (sources.isNull() | _false(F.array_contains(sources, F.col("source_id"))))
    if scopes is not None:
        ok = ok & (scopes.isNull() | _false(F.arrays_overlap(F.col("tags"), scopes)))
    return ok


def source_guard(sources: Column) -> Column:
    """Default deny: null or empty ``sources`` see nothing."""
    return _false(F.array_contains(sources, F.col("source_id")))


def scope_guard(scopes: Column) -> Column:
    """Visible if every scope is allowed (array('*')), if the chunk is untagged, or if tags overlap; null or empty
    scopes see untagged chunks only."""
    untagged = F.col("tags").isNull() | (F.size("tags") == 0)
    return _false(F.array_contains(scopes, F.lit(ANY_SCOPE))) | untagged | _false(F.arrays_overlap(F.col("tags"), scopes))


def visibility_cube(chunks: DataFrame) -> DataFrame:
    """(source_id, space_id, tags, chunks, untagged, ids): active chunks of current pages by all that the guards look at: their number, how many have no
    tag, and the sum of their ids. As many rows as there are kinds of access, whatever the number of chunks."""
    tags = F.array_sort(F.array_distinct("tags")).alias("tags")
    return chunks.where(base_filter()).groupBy("source_id", "space_id", tags).agg(F.count("*").alias("chunks"), F.count_if(F.size("tags") == 0).alias("untagged"), F.sum("chunk_id").alias("ids"))


def visible_counts(questions: DataFrame, cube: DataFrame, key: str) -> DataFrame:
    """(key, chunks, untagged, ids) of what each question (key, space, sources, scopes) may see, from a `visibility_cube`. The source guard is an
    equality, so it is what joins; the other guards are looked at once for each kind of access, not for each chunk."""
    asked = questions.select(key, "space", "sources", "scopes", F.explode(F.array_distinct("sources")).alias("source_id"))
    seen = cube.join(asked, "source_id").where((F.col("space").isNull() | _false(F.col("space_id") == F.col("space"))) & source_guard(F.col("sources")) & scope_guard(F.col("scopes")))
    return seen.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("chunks", "untagged", "ids")))


def classify_scope(scope: Column) -> tuple[Column, Column]:
    """(space id, principal): digits alone are a space's trust, anything else a principal; null stays null."""
    digits = scope.rlike("^[0-9]+$")
    return F.when(digits, scope.try_cast("long")), F.when(~digits, scope)


def page_acl(page_space: Column, principals: Column, space_trust: Column, principal: Column) -> Column:
    """With a space's trust, that space's pages, whatever their restrictions; without a principal, unrestricted pages;
    else unrestricted pages and those that list the principal."""
    free = principals.isNull() | (F.size(principals) == 0)
    return F.when(space_trust.isNotNull(), _false(page_space == space_trust)).when(principal.isNull(), free).otherwise(free | _false(F.array_contains(principals, principal)))


def resolve_allowed_scopes(requested: Column, recognized: Column, default: Column, general: str) -> Column:
    """Sorted {general} and the requested scope if recognized (in any case), else the default if recognized."""
    ask, fall = F.lower(F.trim(requested)), F.lower(F.trim(default))
    pick = F.when(F.array_contains(recognized, ask), ask).when(F.array_contains(recognized, fall), fall)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(general), pick))))


def label_tags(labels: Column, recognized: Column, general: str, root_tags: Column | None = None) -> Column:
    """struct(conflict, tags): trimmed lower-case labels that are recognized scopes; two of them besides the general one
    are a conflict and give no tags. Tags of the page's roots are added."""
    own = F.array_intersect(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), recognized)
    conflict = F.size(F.filter(own, lambda x: x != general)) > 1
    tags = F.when(conflict, F.array().cast("array<string>")).otherwise(own)
    roots = F.coalesce(root_tags, F.array().cast("array<string>")) if root_tags is not None else F.array().cast("array<string>")
    return F.struct(conflict.alias("conflict"), F.array_sort(F.array_union(tags, roots)).alias("tags"))


def subscribed_events(events: DataFrame, service_account: str | None = None) -> DataFrame:
    """Events of the known types, with self_generated: the actor is the service account, if there is one."""
    own = _false(F.col("actor_account_id") == F.lit(service_account)) if service_account else F.lit(False)
    return events.where(F.col("event_type").isin(*DELETE_EVENTS, *SYNC_EVENTS, *SPACE_EVENTS)).withColumn("self_generated", own)


def index_config_changed(stamps: tuple[str, ...], local: str = "local_", target: str = "target_") -> Column:
    """Whether any stamp differs, nulls being equal to nulls."""
    changed = F.lit(False)
    for s in stamps:
        changed = changed | ~F.col(local + s).eqNullSafe(F.col(target + s))
    return changed


def request_context(requests: DataFrame, integrations: DataFrame, general: str, source: str) -> DataFrame:
    """requests (request_id, integration) with scopes, sources and accepted: a known integration has its scopes, none has
    the general one, an unknown one is rejected."""
    known = integrations.select(F.col("integration").alias("i_name"), F.col("scopes").alias("i_scopes"))
    out = requests.join(known, F.col("integration") == F.col("i_name"), "left")
    scopes = F.when(F.col("integration").isNull(), F.array(F.lit(general))).otherwise(F.array_sort(F.array_union("i_scopes", F.array(F.lit(general)))))
    return out.withColumn("scopes", scopes).withColumn("accepted", F.col("integration").isNull() | F.col("i_name").isNotNull()).withColumn("sources", F.array(F.lit(source))).drop("i_name", "i_scopes")


def curated_for_scope(queries: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, entry_id, rank): active entries without tags or with a tag of the query's scopes, by id, the first ``most``.
    Entries meet queries tag by tag, only the first ``most`` of each tag: no later one is among a query's first. Untagged ones
    are the same for all."""
    from pyspark.sql import Window

    live = entries.where("is_active")
    nth = F.row_number().over(Window.partitionBy("scope").orderBy("entry_id"))
    tagged = live.select("entry_id", F.explode(F.array_distinct("tags")).alias("scope")).withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    own = queries.select("query_id", F.explode("scopes").alias("scope")).join(tagged, "scope").select("query_id", "entry_id")
    free = live.where(F.coalesce(F.size("tags"), F.lit(0)) <= 0).select("entry_id").orderBy("entry_id").limit(most)
    shared = queries.select("query_id", F.lit(1).alias("k")).join(F.broadcast(free.withColumn("k", F.lit(1))), "k").select("query_id", "entry_id")
    both = own.unionByName(shared).distinct()
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("entry_id"))).where(F.col("rank") <= most)
