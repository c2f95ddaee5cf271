"""Retrieval, latency, refusal and citation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import dedupe_ranked
from .tables import written

#: Seconds. Fixed values.
TARGETS = {"ttft_p50": 1.5, "ttft_p95": 2.5, "e2e_p95": 10.0, "retrieval_p95": 1.5}


def case_metrics(cases: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, recall, precision, mrr, ndcg, hit_rate, n_relevant) at ``k`` for every case: ranked (case_id, rank, id) with
    repeats, of which the first counts, and relevant (case_id, id). Without relevant ids all are 0."""
    want = relevant.select("case_id", "id").distinct()
    places = dedupe_ranked(ranked, "case_id", "id").where(F.col("rank") <= k)
    hits = places.join(want, ["case_id", "id"]).groupBy("case_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(F.round(1 / F.log2(F.col("rank") + 1), 12)).alias("dcg"))
    n = want.groupBy("case_id").agg(F.count("*").alias("n_relevant"))
    out = cases.select("case_id").join(n, "case_id", "left").join(hits, "case_id", "left").na.fill(0, ["n_relevant", "hits"])
    most = F.least(F.col("n_relevant"), F.lit(k)).cast("int")
    ideal = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(
        "case_id",
        zero(F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant"))).alias("recall"),
        zero(F.col("hits") / F.lit(k) if k else F.lit(0.0)).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        "n_relevant",
    )


METRICS = ("recall", "precision", "mrr", "ndcg", "hit_rate")


def evaluate(per_case: DataFrame, by: str = "dataset") -> DataFrame:
    """Means of the metrics and the number of cases of each dataset; none without cases."""
    return per_case.groupBy(by).agg(F.count("*").alias("cases"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def rerank_lift(cases: DataFrame, before: DataFrame, after: DataFrame, relevant: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of precision@5 and ndcg@10, means over cases (0 for none)."""

    def both(ranked: DataFrame) -> DataFrame:
        five, ten = case_metrics(cases, ranked, relevant, 5), case_metrics(cases, ranked, relevant, 10)
        return five.select("case_id", "precision").join(ten.select("case_id", "ndcg"), "case_id").agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision@5"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg@10")).select(F.expr("stack(2, 'precision@5', `precision@5`, 'ndcg@10', `ndcg@10`) as (metric, value)"))

    out = both(before).withColumnRenamed("value", "before").join(both(after).withColumnRenamed("value", "after"), "metric")
    return out.select("metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def exact_percentiles(samples: DataFrame, by: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """(by, n, p array<double>): interpolated percentiles of each group, exact at any size of a group.

    Equal values are counted first. What is left is dealt by ranges of (group, value) and written; each range sums up its counts
    alone and is moved by the counts of the ranges before it, so a value's ranks are known without any task that has seen a group as a whole. Of each
    group only the values at the asked ranks are taken. Values that are null don't count.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = written(samples.where(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "values")
    ranges = written(counts.repartitionByRange("g", "v").withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("g", "range").agg(F.sum("c").alias("c"))  # a row for each group and the ranges it lies in
    whole = Window.partitionBy("g")
    sums = sums.select(F.col("g").alias("of"), F.col("range").alias("r"), (F.sum("c").over(whole.orderBy("range")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    within = F.sum("c").over(Window.partitionBy("g", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranges.select("*", within.alias("upto")).join(sums, (F.col("range") == F.col("r")) & F.col("g").eqNullSafe(F.col("of"))).select("g", "v", "n", (F.col("before") + F.col("upto")).alias("last"), "c")
    holds = lambda rank: F.max(F.when((rank >= F.col("last") - F.col("c")) & (rank < F.col("last")), F.col("v")))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    picked = ranked.groupBy("g").agg(F.first("n").alias("n"), *(holds(f(place(q)).cast("long")).alias(f"{name}{i}") for i, q in enumerate(at) for name, f in (("low", F.floor), ("high", F.ceil))))
    between = lambda i, q: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (place(q) - F.floor(place(q)))
    return picked.select(*(F.col(f"g.{c}").alias(c) for c in by), "n", F.array(*(between(i, q) for i, q in enumerate(at))).alias("p"))


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, least, most, mean and interpolated p50, p95 and p99 of each group; see `exact_percentiles`."""
    rest = samples.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))
    rest = rest.select(*(F.col(c).alias(f"_{c}") for c in by), "least", "most", "mean")
    p = exact_percentiles(samples, by, value, (0.5, 0.95, 0.99))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return p.join(rest if by else F.broadcast(rest), same).select(*by, "n", "least", "most", "mean", *(F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p50", "p95", "p99"))))


def check_targets(measured: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(name, measured, target, passed) of the names (name, value) that have a target."""
    goals = measured.sparkSession.createDataFrame(list((targets or TARGETS).items()), "name string, target double")
    return measured.join(F.broadcast(goals), "name").select("name", F.col("value").alias("measured"), "target", (F.col("value") <= F.col("target")).alias("passed"))


def fallback_rate(decisions: DataFrame) -> DataFrame:
    """One row: share of (outcome) that refused or asked back, 0 without rows."""
    return decisions.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((F.col("outcome") != "answer").cast("double")), F.lit(0.0)), 6).alias("fallback_rate"))


def refusal_counts(decisions: DataFrame, hand_off: tuple[str, ...]) -> DataFrame:
    return decisions.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("hand_off", F.col("outcome").isin(*hand_off))


def citation_grounding_rate(cited: DataFrame, relevant: DataFrame) -> DataFrame:
    """(case_id, rate): of a case's cited ids (case_id, id), repeats counted, the share that is relevant."""
    want = relevant.select("case_id", "id").distinct().withColumn("ok", F.lit(1.0))
    return cited.join(want, ["case_id", "id"], "left").groupBy("case_id").agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("rate"))


def baseline_rank(cases: DataFrame, pages: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, rank, id): the first ``k`` current pages in listing order (position), of the case's space where its scope is
    a number. The top of the whole listing is ``k`` rows and the same for all other cases."""
    live = pages.where("status = 'current'")
    free = live.orderBy("position").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("position")))
    nth = F.row_number().over(Window.partitionBy("space_id").orderBy("position"))
    in_space = live.withColumn("rank", nth).where(F.col("rank") <= k).select(F.col("space_id").alias("scope_space"), "rank", F.col("page_id").alias("id"))
    c = cases.withColumn("scope_space", F.when(F.col("scope").rlike("^[0-9]+$"), F.col("scope").cast("long")))
    scoped = c.where("scope_space is not null").join(in_space, "scope_space").select("case_id", "rank", "id")
    whole = c.where("scope_space is null").select("case_id", F.lit(1).alias("k")).join(F.broadcast(free.select(F.lit(1).alias("k"), "rank", F.col("page_id").alias("id"))), "k").select("case_id", "rank", "id")
    return scoped.unionByName(whole)
