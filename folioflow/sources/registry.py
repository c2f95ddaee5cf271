"""Evaluation cases, scope and platform registries, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "name string, cases array<struct<id string, question string, relevant_chunk_ids array<string>, expected_answer string, scope string, kind string>>"


def load_eval_cases(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(dataset, case_id, question, scope, kind), and (dataset, case_id, relevant_id)."""
    each = spark.read.schema(CASES).json(path, multiLine=True).select(F.col("name").alias("dataset"), F.explode("cases").alias("c"))
    cases = each.select("dataset", F.col("c.id").alias("case_id"), "c.question", "c.scope", F.coalesce("c.kind", F.lit("retrieval")).alias("kind"))
    return cases, each.select("dataset", F.col("c.id").alias("case_id"), F.explode("c.relevant_chunk_ids").alias("relevant_id"))


def scope_violations(scopes: DataFrame, general: str, reserved: str = "classified") -> DataFrame:
    """(name, problem) for each broken rule of (name): lower case, distinct, with the general and the reserved scope."""
    bad_case = scopes.where("name <> lower(name)").select("name", F.lit("upper_case").alias("problem"))
    twice = scopes.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate").alias("problem"))
    needed = scopes.sparkSession.createDataFrame([(general, "missing_general"), (reserved, "missing_reserved")], "name string, problem string")
    return bad_case.unionByName(twice).unionByName(needed.join(scopes, "name", "left_anti"))


def load_scope_registry(spark: SparkSession, path, general: str, reserved: str = "classified") -> DataFrame:
    """(name, label, description) of the recognized scopes, without the reserved one; raises on broken rules."""
    schema = "scopes array<struct<name string, label string, description string>>"
    scopes = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("scopes").alias("s")).select("s.*")
    problems = scope_violations(scopes, general, reserved).limit(20).collect()
    if problems:
        raise ValueError("scope registry: " + ", ".join(f"{r['name']}: {r['problem']}" for r in problems))
    return scopes.where(F.col("name") != reserved)


def platform_violations(platforms: DataFrame, integrations: DataFrame, recognized: DataFrame, general: str, reserved: str = "classified", algorithms: tuple[str, ...] = ("RS256", "ES256")) -> DataFrame:
    """(name, problem) from platforms (platform, lifetime_minutes, algs) and integrations (integration, scope)."""
    life = platforms.where("lifetime_minutes is null or lifetime_minutes < 1 or lifetime_minutes > 1440").select(F.col("platform").alias("name"), F.lit("lifetime").alias("problem"))
    algs = platforms.where(F.exists("algs", lambda a: ~a.isin(*algorithms)) | (F.size("algs") <= 0)).select(F.col("platform").alias("name"), F.lit("algorithm").alias("problem"))
    own = integrations.where(F.col("scope") == general).select(F.col("integration").alias("name"), F.lit("general_listed").alias("problem"))
    unknown = integrations.where(F.col("scope") != general).join(recognized.select(F.col("name").alias("scope")).where(F.col("scope") != reserved), "scope", "left_anti").select(F.col("integration").alias("name"), F.lit("unknown_scope").alias("problem"))
    return life.unionByName(algs).unionByName(own).unionByName(unknown)


def integration_scopes(integrations: DataFrame, general: str) -> DataFrame:
    """(integration, scopes): the listed ones and the general one, sorted."""
    return integrations.groupBy("integration").agg(F.array_sort(F.array_union(F.collect_set("scope"), F.array(F.lit(general)))).alias("scopes"))


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Each table below ``path``; chunks by space and activity, replacing only the partitions that ``tables`` has."""
    for name, df in tables.items():
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if {"space_id", "is_active"} <= set(df.columns):
            out = out.partitionBy("space_id", "is_active")
        out.parquet(f"{path}/{name}")


def write_report(per_case: DataFrame, aggregates: DataFrame, path: str) -> None:
    per_case.write.mode("overwrite").parquet(f"{path}/cases")
    aggregates.coalesce(1).write.mode("overwrite").json(f"{path}/aggregates")


def traces(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, page_ids, chunk_ids, scores, scopes, latency_ms) in rank order, for append; queries without hits have
    empty arrays."""
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_id", "chunk_id", "score"))).alias("h"))
    each = lambda c, t: F.coalesce(F.transform("h", lambda x: x[c]), F.array().cast(f"array<{t}>")).alias(f"{c}s")
    return queries.join(ranked, "query_id", "left").select("query_id", each("page_id", "long"), each("chunk_id", "string"), each("score", "double"), "scopes", "latency_ms")


def append_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
