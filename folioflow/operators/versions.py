"""Index versions as table states: stage, activate, deactivate, roll back, collect, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("page_id", "cf_version", "parser_version", "chunker_version", "contextualization_version", "retrieval_schema_version", "embedding_model")


def stage_versions(builds: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """New version rows (version_id and the identity) of the builds that are not there yet, the first version id of each
    identity: staging, or failed where the build has no child chunk."""
    same = F.lit(True)
    b, v = builds.alias("b"), versions.alias("v")
    for c in IDENTITY:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"v.{c}"))
    first = b.join(v, same, "left_anti").groupBy(*IDENTITY).agg(F.min("version_id").alias("version_id"))
    has = chunks.where("kind = 1").groupBy("version_id").agg(F.count("*").alias("children"))
    out = first.join(has, "version_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return out.withColumn("state", F.when(F.col("children") > 0, "staging").otherwise("failed"))


def activate(versions: DataFrame, chunks: DataFrame, registry: DataFrame, chosen: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the versions of ``chosen`` (page_id, version_id) became active: what was active is superseded
    and its chunks inactive, the registry points to the new ones. Versions that don't belong to their page, and failed
    ones, change nothing; so this is the roll back too, which names an older version."""
    ok = chosen.join(versions.select("version_id", "page_id", "state").where("state <> 'failed'"), ["page_id", "version_id"]).select("page_id", F.col("version_id").alias("chosen_id"))
    v = versions.join(ok, "page_id", "left")
    on, off = F.col("version_id") == F.col("chosen_id"), (F.col("state") == "active") & F.col("chosen_id").isNotNull() & (F.col("version_id") != F.col("chosen_id"))
    v = v.select(*(
        F.when(on, "active").when(off, "superseded").otherwise(F.col("state")).alias("state") if c == "state"
        else F.when(on, F.lit(now)).otherwise(F.col(c)).alias(c) if c == "activated_at"
        else F.when(off, F.lit(now)).when(on, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "superseded_at"
        else F.col(c)
        for c in versions.columns
    ))
    c = chunks.join(ok, "page_id", "left").withColumn("is_active", F.when(F.col("chosen_id").isNotNull(), F.col("version_id") == F.col("chosen_id")).otherwise(F.col("is_active"))).select(*chunks.columns)
    target = versions.join(ok, versions.version_id == ok.chosen_id, "left_semi").select("page_id", F.col("version_id").alias("n_active_version_id"), *(F.col(x).alias(f"n_{x}") for x in IDENTITY[1:]))
    r = registry.join(target, "page_id", "left")
    r = r.select(*(F.coalesce(F.col(f"n_{x}"), F.col(x)).alias(x) if f"n_{x}" in target.columns else F.col(x) for x in registry.columns))
    return v, c, r


def deactivate_pages(registry: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry and chunks with the status of ``gone`` (page_id, status) and its active chunks inactive; version rows stay
    as they are; unknown pages do nothing."""
    g = gone.select("page_id", F.col("status").alias("g_status"))
    r = registry.join(g, "page_id", "left").withColumn("status", F.coalesce("g_status", "status")).select(*registry.columns)
    c = chunks.join(g, "page_id", "left")
    hit = F.col("g_status").isNotNull() & F.col("is_active")
    c = c.withColumn("page_status", F.when(hit, F.col("g_status")).otherwise(F.col("page_status"))).withColumn("is_active", F.col("is_active") & ~hit)
    return r, c.select(*chunks.columns)


def collect_superseded(versions: DataFrame, chunks: DataFrame, retain: int = 2) -> tuple[DataFrame, DataFrame]:
    """Versions and chunks without the superseded versions beyond each page's latest ``retain``; failed rows stay."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("superseded_at"), F.desc("version_id")))
    old = versions.where("state = 'superseded'").withColumn("nth", nth).where(F.col("nth") > retain).select("version_id")
    return versions.join(old, "version_id", "left_anti"), chunks.join(old, "version_id", "left_anti")


def violations(versions: DataFrame, chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """(rule, key, n) wherever a rule is broken: one active version a page, stable keys unique in a version, pointers of
    the registry unique, children after their parents."""
    many = lambda df, rule, *by: df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(c).cast("string") for c in by)).alias("key"), "n")
    out = many(versions.where("state = 'active'"), "one_active", "page_id")
    out = out.unionByName(many(chunks, "stable_key", "version_id", "stable_key")).unionByName(many(registry.where("active_version_id is not null"), "pointer", "active_version_id"))
    first = chunks.groupBy("version_id", "section_key", "parent").agg(F.min(F.when(F.col("kind") == 0, F.col("seq"))).alias("p"), F.min(F.when(F.col("kind") == 1, F.col("seq"))).alias("c"), F.count("*").alias("n"))
    late = first.where("c is not null and (p is null or p > c)").select(F.lit("parent_first").alias("rule"), F.concat_ws("|", F.col("version_id").cast("string"), "section_key", F.col("parent").cast("string")).alias("key"), "n")
    return out.unionByName(late)
