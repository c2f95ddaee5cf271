"""Secret scans: pattern spans, and multipart credentials linked by an interval join.

Built-in functions only: a pattern's matches and the gaps between them give the places of all matches, in code
points, as running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

#: kind, pattern, role, and the least length of a group for the match to count. Fixed values.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", (2, 6)),
    ("access", r"AKIA[A-Z0-9]+", "id", (0, 20)),
    ("hex", r"[0-9a-f]{24,}+", "secret", (0, 24)),
)
WEAK = (
    ("key_id", r"""(?i)\b(?:access|client|account|app)[_-]?(?:key[_-]?)?id["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9_-]{4,}+""", "id", (0, 1)),
    ("login", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}", "id", (0, 1)),
    ("key_part", r"""(?i)\b(?:pwd|pass|passphrase|credential|private_?key|secret_?key|auth)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9+/_.=-]{4,}+""", "secret", (0, 1)),
    ("endpoint", r"""(?i)\b(?:https?|ftp|sftp|ssh|s3|jdbc:[a-z]{1,20}|amqps?|redis|mongodb|postgresql|postgres|mysql)://[^\s"'<>]{1,2000}+""", "endpoint", (0, 1)),
)
_KINDS = {kind: i for i, (kind, *_) in enumerate(BASE + WEAK)}


#: What a text must hold somewhere for a pattern to match at all: looked for before the pattern is.
_HINTS = {"assign": ("=", ":"), "access": ("AKIA",), "key_id": ("=", ":"), "login": ("@",), "key_part": ("=", ":"), "endpoint": ("://",)}


def _hinted(kind: str) -> Column:
    out = F.lit(kind not in _HINTS)
    for sign in _HINTS.get(kind, ()):
        out = out | F.contains(F.col("text"), F.lit(sign))
    return out


def find_spans(rows: DataFrame, patterns) -> DataFrame:
    """(doc_id, rid, kind, start, end, match) of every leftmost non-overlapping match in ``rows`` (doc_id, rid,
    text) that is long enough; code points, end exclusive."""
    found = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), F.transform(F.split("text", pattern, -1), lambda x: F.length(x)).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"))
    one = [F.when(_hinted(kind), found(kind, pattern)) for kind, pattern, *_ in patterns]
    each = rows.select("doc_id", "rid", F.explode(F.array(*one)).alias("m")).where(F.size("m.hits") > 0)
    at = each.select("doc_id", "rid", "m.kind", F.posexplode(F.arrays_zip(F.slice("m.gaps", 1, F.size("m.hits")).alias("gap"), F.col("m.hits").alias("hit"))).alias("n", "x"))
    at = at.select("doc_id", "rid", "kind", "n", "x.gap", F.col("x.hit").alias("match"))
    at = at.dropDuplicates(["doc_id", "rid", "kind", "n"])
    so_far = Window.partitionBy("doc_id", "rid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = at.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
    enough: Column = F.lit(False)
    for kind, pattern, _, (group, least) in patterns:
        part = F.col("match") if group == 0 else F.regexp_extract("match", pattern, group)
        enough = enough | ((F.col("kind") == kind) & (F.length(part) >= least))
    return ended.where(enough).select("doc_id", "rid", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match")


def link_parts(parts: DataFrame, reach: int) -> DataFrame:
    """The weak ones of ``parts`` (doc_id, rid, kind, role, weak, start, end) that complete a credential: a weak
    identifier or endpoint with a secret, a weak secret with an identifier or endpoint, at most ``reach`` code
    points apart. The interval join meets in blocks of ``reach`` code points of a document, so no document's parts
    are all paired."""
    block = lambda c: F.floor(c / reach)
    weak = parts.where("weak").select("doc_id", "rid", "kind", "role", "start", "end", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))).alias("block"))
    other = parts.select(F.col("doc_id").alias("o_doc"), F.col("rid").alias("o_rid"), F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(F.sequence(block(F.col("start") - reach), block(F.col("end") + reach))).alias("o_block"))
    near = (F.col("o_start") <= F.col("end") + reach) & (F.col("start") <= F.col("o_end") + reach)
    completes = F.when(F.col("role") == "secret", F.col("o_role") != "secret").otherwise(F.col("o_role") == "secret")
    same = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("rid") == F.col("o_rid")) & (F.col("block") == F.col("o_block"))
    return weak.join(other, same & near & completes, "left_semi").select("doc_id", "rid", "kind", "start", "end").distinct()


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) for every row: ``kind:start:end`` of base patterns, and of
    these with the linked weak parts, by start, then kind.

    Null and empty texts have no spans (empty strings). Repeated rows get equal results; a null id stays null.
    """
    rows = texts(docs, id_col, text_col)
    base = written(find_spans(rows, BASE + WEAK).drop("match"), "spans")  # the texts are searched once; what was found stays out of the files
    kinds = {k: (role, any(k == w[0] for w in WEAK)) for k, _, role, _ in BASE + WEAK}
    role = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, (r, _) in kinds.items()))
    parts = base.select("doc_id", "rid", "kind", "start", "end", role.alias("role"), F.col("kind").isin([w[0] for w in WEAK]).alias("weak"))
    linked = link_parts(parts, reach)
    number = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for k, i in _KINDS.items()))
    all_spans = parts.where("not weak").select("doc_id", "rid", "kind", "start", "end").unionByName(linked)
    span = F.struct(F.col("start"), number.alias("number"), F.col("end"), F.col("kind"))
    by_doc = all_spans.groupBy("doc_id", "rid").agg(F.collect_list(span).alias("spans"))
    base_kinds = [k for k, *_ in BASE]
    by_doc = by_doc.select(F.col("doc_id").alias("s_doc"), F.col("rid").alias("s_rid"), "spans", F.filter("spans", lambda s: s["kind"].isin(base_kinds)).alias("base"))
    ids = rows.select("doc_id", "rid")
    out = ids.join(by_doc, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("rid") == F.col("s_rid")), "left")
    n = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    counted = [F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(n(k)).alias(f"n_{k}") for k in base_kinds]
    return out.select("doc_id", *counted, F.coalesce(_joined(F.col("base")), F.lit("")).alias("base"), F.coalesce(_joined(F.col("spans")), F.lit("")).alias("spans"))
