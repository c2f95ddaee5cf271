"""The opN queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity(docs, learn(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import as_replies, format_chats, read_back

    own = spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(format_chats(as_replies(turns)))
    digest = lambda parts: F.sha2(F.encode(F.array_join(parts, ""), "UTF-8"), 256)
    learned = F.array_join("learned", "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(F.encode(learned, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` as a recording; queries are the ids divisible by 100, against all rows.
    A row of the kind member for each vec_id with its class, and one of the kind pair for each class and query that align."""
    from .media import fingerprints, render, search_recordings

    prints = fingerprints(render(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    out = search_recordings(prints, F.col("rec_id") % 100 == 0)
    return out.select("kind", F.col("rec_id").alias("vec_id"), "class_id", "is_query", "copies", F.col("query").alias("query_id"), "offset", "aligned", F.round("bit_errors", 6).alias("bit_errors"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: verdict, host, path. Fixed values.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page are those of the document with its id: blocked are low quality and toxic ones. Where no fixed rule
    fits, the mined rules decide; mined_rule and confidence name the one that did."""
    from .urlfilter import judge_urls, mine_rules

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("blocked"))
    return judge_urls(pages, spark.createDataFrame(URL_RULES, "verdict string, host string, path string"), mine_rules(labelled))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_components

    out = similarity_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document (by the checksum of its id) is made periodic from some word on before runs are looked for."""
    from .runs import collapse_runs

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, _words("text")).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(tail, F.lit(1), (n - F.col("a")).cast("int"))), " ")
    out = collapse_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("l"))))
    out = out.withColumn("best", best)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.l") * 1000 / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(F.transform("runs", line), ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; where an id is divisible by 7, its label is the next one of ten."""
    from .negatives import mine_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_secret_scan, op3_benchmark_decontamination, op4_chat_formatting, op5_media_fingerprints, op6_line_dedup, op7_substring_dedup, op8_url_filter, op9_best_fit_packing, op10_ngram_jaccard_join, op11_periodic_runs, op12_lm_scoring, op13_hard_negatives)
}

ORACLES: dict[str, str] = {
    "op4_chat_formatting": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS t,
  replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS r FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.doc_id, k.pos, k.line, (h.first IS NOT NULL AND k.doc_id > h.first) AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op7_substring_dedup": r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS t FROM words WHERE len(w) >= 13),
firsts AS (SELECT t, min(doc_id) AS first FROM windows GROUP BY t HAVING count(DISTINCT doc_id) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (t) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT e.doc_id, count(*) AS n, count(c.i) AS gone, coalesce(string_agg(x, ' ' ORDER BY e.i) FILTER (c.i IS NULL), '') AS t
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
    "op8_url_filter": r"""
WITH parsed AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
tokened AS (SELECT *, list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || x))) AS tokens FROM parsed),
labelled AS (SELECT url, any_value(tokens) AS tokens, avg(CASE WHEN coalesce(quality = 0 OR toxic = 1, false) THEN 1 ELSE 0 END) >= 0.5 AS blocked
  FROM tokened JOIN labels ON page_id = doc_id WHERE url IS NOT NULL GROUP BY url),
base AS (SELECT count(*) AS n, count(*) FILTER (blocked) / count(*) AS share, greatest(20, ceil(0.001 * count(*))) AS least FROM labelled),
each AS (SELECT url, unnest(tokens) AS token FROM labelled),
same AS (SELECT token, string_agg(url, ' ' ORDER BY url) AS held FROM each GROUP BY token HAVING count(*) >= (SELECT least FROM base)),
items AS (SELECT min(token) AS item, list(token) AS members FROM same GROUP BY held),
names AS (SELECT list(item) AS known FROM items),
baskets AS (SELECT url, blocked, list_sort(list_filter(tokens, lambda t: list_contains(known, t))) AS items FROM labelled, names),
masks AS (SELECT blocked, items, unnest(range(1, 1 << len(items))) AS m FROM baskets),
sets AS (SELECT blocked, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM masks),
counted AS (SELECT s, count(*) AS n, count(*) FILTER (blocked) AS hits, count(*) FILTER (blocked) / count(*) AS confidence FROM sets GROUP BY s),
sure AS (SELECT c.s, c.confidence FROM counted c, base b WHERE c.hits >= b.least AND c.hits >= c.n * b.share + 2 * sqrt(c.n * (b.share * (1 - b.share))) AND c.confidence >= greatest(0.5, 1.25 * b.share)
  AND NOT EXISTS (SELECT 1 FROM counted d WHERE len(d.s) < len(c.s) AND d.confidence >= c.confidence AND list_has_all(c.s, d.s))),
rules AS (SELECT confidence, list_sort(flatten(list(members))) AS t FROM (SELECT s, confidence, unnest(s) AS item FROM sure) JOIN items USING (item) GROUP BY s, confidence),
fixed(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (SELECT page_id, arg_min(h || p, (-length(h || p), h || p)) AS rule, arg_min(v, (-length(h || p), h || p)) AS v
  FROM tokened JOIN fixed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
mined AS (SELECT page_id, arg_min(array_to_string(t, ' '), (-confidence, array_to_string(t, ' '))) AS mined_rule, max(confidence) AS confidence
  FROM tokened JOIN rules ON list_has_all(tokens, t) WHERE page_id NOT IN (SELECT page_id FROM best) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN mined_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict, mined_rule, confidence
FROM tokened LEFT JOIN best USING (page_id) LEFT JOIN mined USING (page_id)""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes z ON w.doc_id = z.doc_id LEFT JOIN reach r ON w.doc_id = r.a GROUP BY w.doc_id""",
    "op11_periodic_runs": r"""
WITH hashed AS (SELECT doc_id, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS h FROM documents),
split AS (SELECT doc_id, h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM hashed),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
words AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END]) END AS w FROM placed),
grams AS (SELECT doc_id, unnest(range(len(w) - 15)) AS i, unnest(list_transform(range(1, len(w) - 14), lambda i: array_to_string(w[i:i + 15], ' '))) AS g FROM words WHERE len(w) >= 24),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.g = b.g AND a.i < b.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, q AS period, min(i) AS start, count(*) + 15 + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM stretches r WHERE NOT EXISTS (SELECT 1 FROM stretches s WHERE s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.start = r.start AND s.length = r.length AND s.period < r.period AND r.period % s.period = 0)),
summed AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, (length / period, -start, -period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
each AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM words),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS t FROM each e ANTI JOIN gone g ON e.doc_id IS NOT DISTINCT FROM g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, best.l * 1000 // best.p AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM words w LEFT JOIN summed s ON w.doc_id IS NOT DISTINCT FROM s.doc_id LEFT JOIN kept k ON w.doc_id IS NOT DISTINCT FROM k.doc_id""",
    "op13_hard_negatives": r"""
WITH able AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM able a JOIN able b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM scored JOIN positives USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""",
}
