"""Which pages are in scope: page trees, roots and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters as V
from .tables import discard, written


def subtree_coverage(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_type, root_id, page_id): for a space root all live pages of the space, for a page root the page and all that
    hang below it by parent_id; nothing for a page that isn't live. Cycles end: a page below itself is met once.

    By pointer doubling: after k rounds each page knows its ancestor 2^k levels up, and the roots that are nearer than that; a round
    takes the roots which that ancestor knows. So a tree of depth d takes log2(d) rounds, and log2(pages) end any cycle. Each round is
    written, so the lineage stays short and executors may be lost.
    """
    live, roots = pages.select("page_id", "parent_id", "space_id"), roots.select("root_type", "root_id").distinct()
    spaces = roots.where("root_type = 'space'").join(live, F.col("root_id") == F.col("space_id")).select("root_type", "root_id", "page_id")
    known = ["root_type", "root_id", "page_id"]
    found = written(roots.where("root_type = 'page'").join(live, F.col("root_id") == F.col("page_id")).select(*known).distinct(), "found")
    there = live.select(F.col("page_id").alias("up")).distinct()
    jumps = written(live.select("page_id", F.col("parent_id").alias("up")).distinct().join(there, "up").select("page_id", "up"), "jumps")
    for _ in range(max(1, live.count()).bit_length() + 1):
        if not jumps.limit(1).count():
            break
        above = found.select("root_type", "root_id", F.col("page_id").alias("up"))
        new = jumps.join(above, "up").select(*known).distinct().join(found, known, "left_anti")
        further = jumps.select("page_id", F.col("up").alias("via")).join(jumps.select(F.col("page_id").alias("via"), "up"), "via").select("page_id", "up")
        found, before = found.unionByName(written(new, "found")), jumps
        jumps = written(further.distinct(), "jumps")
        discard(before)
    return spaces.distinct().unionByName(found)


def resolve_space_scope(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """(space_id, page_id, tags) of the allowed pages: all pages of spaces without any root; of others those below an active
    root, with the sorted union of these roots' tags. ``roots`` has the space they lie in (space_id), tags and is_active."""
    rooted = roots.select("space_id").distinct()
    free = pages.join(rooted, "space_id", "left_anti").select("space_id", "page_id", F.array().cast("array<string>").alias("tags"))
    active = roots.where("is_active")
    tag = active.select("root_type", "root_id", F.col("tags").alias("root_tags"))
    below = subtree_coverage(pages, active.select("root_type", "root_id").distinct()).join(tag, ["root_type", "root_id"])
    own = below.groupBy("page_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("root_tags")))).alias("tags"))
    return free.unionByName(own.join(pages.select("page_id", "space_id"), "page_id").join(rooted, "space_id", "left_semi").select("space_id", "page_id", "tags"))


def known_spaces(registry: DataFrame, roots: DataFrame) -> DataFrame:
    return registry.select("space_id").union(roots.select("space_id")).where("space_id is not null").distinct().orderBy("space_id")


def scope_coverage(chunks: DataFrame, recognized: list[str]) -> tuple[DataFrame, DataFrame]:
    """(active, uncovered, ready) of the corpus, and (page_id, uncovered) of its pages: active chunks that no recognized
    scope's tags reach."""
    names = F.array(*map(F.lit, recognized)) if recognized else F.array().cast("array<string>")
    live = chunks.where("is_active").select("page_id", (~F.coalesce(F.arrays_overlap("tags", names), F.lit(False))).alias("bare"))
    pages = live.where("bare").groupBy("page_id").agg(F.count("*").alias("uncovered"))
    return live.agg(F.count("*").alias("active"), F.count_if("bare").alias("uncovered"), (F.count_if("bare") == 0).alias("ready")), pages


def isolation_check(chunks: DataFrame, general: str) -> DataFrame:
    """(kind, name, total, unscoped, own, bogus, passed): for each source and each tag, how many of its rows the guards show
    to no scope, its own and an unknown one; passed if none, some and none. Counted in one pass each, not once for each name."""
    scopes = {"unscoped": F.lit(None).cast("array<string>"), "own": F.array("name"), "bogus": F.array(F.lit("__bogus__"))}
    count = lambda rows, guard: rows.groupBy("name").agg(F.count("*").alias("total"), *(F.count_if(guard(s)).alias(k) for k, s in scopes.items()))
    by_source = count(chunks.withColumn("name", F.col("source_id")), V.source_guard).withColumn("kind", F.lit("source"))
    tagged = chunks.where(F.size("tags") > 0).select(F.explode(F.array_distinct("tags")).alias("name"), "tags")
    by_tag = count(tagged, V.scope_guard).withColumn("kind", F.lit("tag"))
    both = by_source.unionByName(by_tag)
    return both.select("kind", "name", "total", "unscoped", "own", "bogus", ((F.col("unscoped") == 0) & (F.col("own") > 0) & (F.col("bogus") == 0)).alias("passed"))


def reconciliation_report(drift: DataFrame, decided: DataFrame, asked: DataFrame, errors: DataFrame) -> DataFrame:
    """One row a run (run_id): scanned, new, drifted and unchanged pages, requests, orphans removed, errors, and the status:
    completed without errors, else failed. The pages themselves are rows of `report_pages`."""
    count = lambda kind: F.count_if(F.col("drift") == kind)
    seen = drift.groupBy("run_id").agg(F.count_if(F.col("drift") != "orphan").alias("scanned"), count("new").alias("new"), count("drifted").alias("drifted"), count("unchanged").alias("unchanged"))
    gone = decided.groupBy("run_id").agg(F.count_if(F.col("decision") == "purge").alias("orphans_removed"))
    made = asked.groupBy("run_id").agg(F.countDistinct("idempotency_key").alias("requests"))
    bad = errors.groupBy("run_id").agg(F.count("*").alias("errors"))
    out = seen.join(gone, "run_id", "left").join(made, "run_id", "left").join(bad, "run_id", "left").na.fill(0, ["orphans_removed", "requests", "errors"])
    return out.withColumn("status", F.when(F.col("errors") == 0, "completed").otherwise("failed"))


def report_pages(drift: DataFrame, decided: DataFrame) -> DataFrame:
    """(run_id, kind, page_id): a row for each new, drifted and orphan page of a run."""
    changed = drift.where(F.col("drift").isin("new", "drifted")).select("run_id", F.col("drift").alias("kind"), "page_id")
    return changed.unionByName(decided.select("run_id", F.lit("orphan").alias("kind"), "page_id"))
