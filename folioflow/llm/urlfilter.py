"""URL filters: host and path rules first, then association rules over URL tokens mined by FP-growth."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_first, written

MOST_TOKENS = 1_000_000  # tokens of rules that are broadcast, about 100 MB
BLOCKED = "=block"  # the item that stands for the label


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    pattern, url = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct labels of the host (``h:``) and segments of the path (``p:``)."""
    parts = lambda c, sep, mark: F.transform(F.filter(F.split(c, sep, -1), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(parts(host, r"\.", "h:"), parts(path, "/", "p:")))


def merged_tokens(urls: DataFrame) -> DataFrame:
    """(item, members array<string>, token): the tokens of ``urls`` (url, tokens), of which those that stand in exactly the
    same URLs are one item, named by its smallest token. Two 64-bit sums of the URLs' hashes tell the sets of URLs apart."""
    each = urls.select(F.explode("tokens").alias("token"), F.xxhash64("url").alias("one"), F.xxhash64("url", F.lit(1)).alias("two"))
    where = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    items = where.groupBy("n", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return items.select(F.element_at("members", 1).alias("item"), "members", F.explode("members").alias("token"))


def mine_rules(labelled: DataFrame, least_rows: int = 20, support: float = 0.001, lift: float = 1.25, z: float = 2.0, confidence: float = 0.5) -> DataFrame:
    """(rule, tokens array<string>, confidence, support) from ``labelled`` (url, blocked boolean): the token sets that go
    with blocked URLs clearly more often than URLs are blocked at all.

    Each distinct URL counts once; it is blocked if half of its labels or more say so (null labels say nothing, null URLs
    are left out). Tokens that stand in exactly the same URLs are one item, so a long path that is always the same makes one
    item and not all its subsets; a rule asks for all tokens of its items. FP-growth finds the sets of items that stand in
    ``support`` of the URLs (``least_rows`` at least) together with the label. A rule's share of blocked URLs is ``lift``
    times the overall share, ``z`` standard errors above it, and ``confidence`` at least (one half by default: what is clean more often than
    not isn't blocked). Rules of which a smaller set is as
    sure are pruned, level by level: a set of k items looks at its own subsets of k - 1. No labelled URLs, no rules.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.where("url is not null and blocked is not null").groupBy("url").agg((F.avg(F.col("blocked").cast("int")) >= 0.5).alias("blocked"))
    urls = written(known.select("url", "blocked", url_tokens(host, path).alias("tokens")), "labelled")
    n, hits = urls.agg(F.count("*"), F.count_if("blocked")).first()
    schema = "rule long, tokens array<string>, confidence double, support double"
    if not hits:
        return labelled.sparkSession.createDataFrame([], schema)
    items = written(merged_tokens(urls), "items")
    held = urls.select("url", F.explode("tokens").alias("token")).join(items.where("item = token").select("item", "token"), "token").groupBy("url").agg(F.collect_list("item").alias("items"))
    baskets = urls.select("url", "blocked").join(held, "url", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items"))
    enough = max(least_rows, math.ceil(support * n))
    if enough > n:
        return labelled.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=(enough - 0.5) / n).fit(baskets)
    found = written(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "itemsets")
    blocked = found.where(F.array_contains("items", BLOCKED)).select(F.array_remove("items", BLOCKED).alias("items"), F.col("n").alias("hits"))
    sets = found.where(~F.array_contains("items", BLOCKED)).join(blocked, "items", "left")
    sets = written(sets.select(F.xxhash64("items").alias("rule"), "items", F.size("items").alias("k"), "n", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("confidence"), F.coalesce("hits", F.lit(0)).alias("hits")), "sets")
    level, rules = None, None
    for k in range(1, (sets.agg(F.max("k")).first()[0] or 0) + 1):
        now = sets.where(F.col("k") == k)
        if level is None:
            now = now.withColumn("smaller", F.lit(0.0))
        else:
            part = now.select("rule", F.explode(F.transform("items", lambda x: F.xxhash64(F.array_remove(F.col("items"), x)))).alias("sub"))
            best = part.join(level.select(F.col("rule").alias("sub"), "surest"), "sub").groupBy("rule").agg(F.max("surest").alias("smaller"))
            now = now.join(best, "rule")
        level = written(now.withColumn("surest", F.greatest("smaller", "confidence")), "level")
        new = level.where(F.col("confidence") > F.col("smaller"))
        rules = new if rules is None else rules.unionByName(new)
    if rules is None:
        return labelled.sparkSession.createDataFrame([], schema)
    base = hits / n
    clear = F.col("hits") >= F.col("n") * base + z * F.sqrt(F.col("n") * (base * (1 - base)))
    rules = rules.where(clear & (F.col("confidence") >= max(confidence, lift * base)) & (F.col("hits") >= enough))
    whole = rules.select("rule", "confidence", "hits", F.explode("items").alias("item")).join(items.where("item = token").select("item", "members"), "item")
    return whole.groupBy("rule", "confidence", "hits").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens")).select("rule", "tokens", "confidence", (F.col("hits") / n).alias("support"))


def judge_urls(pages: DataFrame, fixed: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined_rule, confidence) for every row of ``pages``.

    ``fixed`` (verdict, host, path): a rule fits its host and all its subdomains where the path begins with the
    rule's; the longest rule wins, of equally long ones the smallest. Other URLs are blocked if all tokens of one
    ``mined`` rule are among theirs, else allowed; ``mined_rule`` has the tokens of the surest such rule (of equally sure ones
    the smallest text), joined by spaces, with its confidence. Each distinct URL is judged once, by joining its host suffixes
    and its tokens with indexes of the rules. Null URLs have an empty host and path and are allowed.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    urls = written(rows.groupBy("url").agg(F.count("*").alias("n")).select("url", "n", host.alias("host"), path.alias("path")), "urls")
    rules = fixed.select("verdict", F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.concat("host", "path").alias("rule"))
    deepest = rules.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0] or 0
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -m) for m in range(1, deepest + 1)))) if deepest else F.array().cast("array<string>")
    fits = urls.select("url", "path", F.explode(suffixes).alias("r_host")).join(rules, "r_host").where(F.startswith("path", F.col("r_path")))
    best = fits.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best")).select("url", "best.rule", "best.verdict")
    tokens = urls.join(best, "url", "left_anti").select("url", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    index = mined.select("rule", F.size("tokens").alias("k"), F.array_join("tokens", " ").alias("mined_rule"), "confidence", F.explode("tokens").alias("token"))
    index = written(index.select(F.col("rule").alias("id"), "k", "mined_rule", "confidence", "token"), "index")
    index = F.broadcast(index) if index.count() <= MOST_TOKENS else index  # so that a token of most URLs is no hot key; beyond, a shuffle
    full = tokens.join(index, "token").groupBy("url", "id", "k").agg(F.count("*").alias("n"), F.first("mined_rule").alias("mined_rule"), F.first("confidence").alias("confidence")).where("n = k")
    bad = full.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "mined_rule")).alias("b")).select("url", F.col("b.mined_rule").alias("mined_rule"), (-F.col("b.less")).alias("confidence"))
    verdict = F.coalesce("verdict", F.when(F.col("mined_rule").isNotNull(), "block"), F.lit("allow"))
    judged = urls.join(best, "url", "left").join(bad, "url", "left").select("url", "n", "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "confidence")
    return join_first(rows, written(judged, "judged"), "url").select(F.col("page_id").alias(id_col), "host", "path", "rule", "verdict", "mined_rule", "confidence")
