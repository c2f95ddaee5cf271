import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import hashing as H
from folioflow.functions import text as T
from folioflow.operators import filters as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail jane.doe+x@corp.example.com now", "mail [REDACTED_EMAIL] now"),
        ("ssn 123-45-6789.", "ssn [REDACTED_SSN]."),
        ("card 4111 1111 1111 1111 ok", "card [REDACTED_CARD]ok"),
        ("call +1 (415) 555-2671", "call +1 ([REDACTED_PHONE]"),
        ("call 415-555-2671", "call [REDACTED_PHONE]"),
        ("order 12345", "order 12345"),
    ],
)
def test_redaction(spark, text, want):
    import re

    got = one(spark, text, T.redact_pii)
    for pattern, placeholder in T.REDACTIONS:
        text = re.sub(pattern.replace("(?U)", ""), placeholder, text)
    assert got == text
    if "(" not in want:
        assert got == want


def test_citations(spark):
    text = "Limits are 5 [1]. Nobody said this. Also [2][7] , see [9]! Last [7]."
    got = spark.createDataFrame([(text,)], "x string").select(T.enforce_citations(F.col("x"), F.array(F.lit(1), F.lit(2))).alias("c")).first().c
    assert got.text == "Limits are 5 [1]. Also [2], see!" and got.used == [1, 2]
    none = spark.createDataFrame([("No marker.",)], "x string").select(T.enforce_citations(F.col("x"), F.array(F.lit(1))).alias("c")).first().c
    assert none.text == "" and none.used == []


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("  Hello!! ", "small_talk"), ("what's  up?", "small_talk"), ("Who am I?", "identity"), (" \n", "empty"), ("", "empty"),
        ("how do I reset my password", "needs_classifier"), ("what topics does the payroll doc cover", "needs_classifier"),
        ("please tell me in detail how the quarterly billing limits apply to new accounts", "search"),
    ],
)
def test_routes(spark, message, want):
    assert one(spark, message, T.route_query) == want


def test_clarifications(spark):
    got = one(spark, "Question: One?\nquestion: Which plan?\nOptions:\n- Free \n-\n- Pro", T.parse_clarification)
    assert got.question == "Which plan?" and got.options == ["Free", "Pro"]
    assert one(spark, "- a\n- b", T.parse_clarification) is None


def test_refusals_and_backoff(spark):
    rows = [(None, False), (0.035, False), (0.04, False), (0.05, False), (None, True)]
    got = [r.d for r in spark.createDataFrame(rows, "s double, i boolean").select(T.refusal_decision(F.col("s"), F.col("i")).alias("d")).collect()]
    assert got == ["no_candidates", "off_topic", "weak_score", "answer", "answer"]
    assert [r.s for r in spark.range(1, 13).select(T.retry_seconds(F.col("id")).alias("s")).collect()] == [min(5 * 2 ** (n - 1), 3600) for n in range(1, 13)]


def test_words_lie_between_any_blanks(spark):
    odd = [None, "\x1c", "\u3000a\x85b\xa0 c\x1f", " \n\t", "\u200b", "a\u2028\u2029b", "\x0b\x0cé  ü"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i long, t string").select("i", T.word_count(F.col("t")).alias("words"), T.token_count(F.col("t")).alias("tokens")).collect()
    assert {r.i: (r.words, r.tokens) for r in rows} == {i: (len(t.split()), max(len(t.split()), -(-len(t) // 4)) if t.split() else 0) for i, t in enumerate(x or "" for x in odd)}


def test_token_counts_and_prefixes(spark):
    assert [one(spark, t, T.token_count) for t in ("", "  ", "a b c", "abcdefghij")] == [0, 0, 3, 3]
    df = spark.createDataFrame([("T", ["a", "", "b"], "t"), ("T", ["T"], "t"), ("", ["a"], "t")], "title string, path array<string>, text string")
    assert [r.p for r in df.select(T.metadata_prefix(F.col("title"), F.col("path")).alias("p")).collect()] == ["T — a > b", "T", "a"]
    assert df.select(T.compose_retrieval(F.col("title"), F.col("path"), F.lit("ctx"), F.col("text")).alias("r")).first().r == "T — a > b\nctx\n\nt"
    assert one(spark, "Sorry, I CANNOT access the page", T.clean_context) == "" and one(spark, " About x ", T.clean_context) == "About x"


def test_hashes_equal_python(spark):
    def parts(*p):
        h = hashlib.sha256()
        for x in p:
            h.update(x if isinstance(x, bytes) else x.encode())
            h.update(b"\x1f")
        return h

    assert spark.range(1).select(H.hash_parts(F.lit("a"), F.lit("é")).alias("h")).first().h == parts("a", "é").hexdigest()
    labels = spark.createDataFrame([(["b  x", " a", "a"],), ([],), (None,)], "l array<string>").select(H.labels_hash(F.col("l")).alias("h")).collect()
    assert [r.h for r in labels] == [parts(json.dumps(x, separators=(",", ":"))).hexdigest() for x in (["a", "b x"], [], [])]
    scope = spark.range(1).select(H.access_scope_hash(F.array(F.lit("u2"), F.lit("u1"), F.lit("u2")), F.lit("S")).alias("h")).first().h
    assert scope == parts('{"read":["u1","u2"],"space":"S"}').hexdigest()
    section = parts("7", "A>B", "2", "0")
    keys = H.chunk_keys(F.lit(7), F.array(F.lit("A"), F.lit("B")), F.lit(2), F.lit(0), F.lit(1), F.lit(None), F.lit("txt"))
    row = spark.range(1).select(*(c.alias(k) for k, c in keys.items())).first()
    assert row.positional_key == parts(section.digest(), "parent", "1").hexdigest()
    assert row.stable_key == parts(section.digest(), "parent", "1", parts("txt").digest()).hexdigest()


CHUNKS = "chunk_id long, kind int, is_active boolean, page_status string, space_id long, source_id string, tags array<string>"


def chunks(spark):
    return spark.createDataFrame([(1, 1, True, "current", 5, "w", ["a"]), (2, 1, True, "current", 5, "w", []), (3, 1, True, "current", 6, "x", ["b"]), (4, 0, True, "current", 5, "w", ["a"]), (5, 1, None, "current", 5, "w", None)], CHUNKS)


def test_guards_deny_by_default(spark):
    ids = lambda c: [r.chunk_id for r in chunks(spark).where(c).collect()]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    null = F.lit(None).cast("array<string>")
    assert ids(V.source_guard(null)) == ids(V.source_guard(arr())) == []
    assert ids(V.source_guard(arr("x"))) == [3]
    assert ids(V.scope_guard(null)) == ids(V.scope_guard(arr())) == [2, 5]
    assert ids(V.scope_guard(arr("a"))) == [1, 2, 4, 5] and len(ids(V.scope_guard(arr("*")))) == 5
    assert ids(V.base_filter()) == [1, 2, 3] and ids(V.base_filter(F.lit(5).cast("long"), null, arr("a"))) == [1]
    assert ids(V.base_filter(scopes=arr("bogus"))) == []


@pytest.mark.parametrize(
    ("space", "principals", "scope", "want"),
    [(5, ["u"], "5", True), (5, [], "6", False), (None, [], "5", False), (5, [], None, True), (5, ["u"], None, False), (5, ["u"], "u", True), (5, ["u"], "v", False), (5, None, "v", True)],
)
def test_page_acl(spark, space, principals, scope, want):
    df = spark.createDataFrame([(space, principals, scope)], "s long, p array<string>, q string")
    trust, principal = V.classify_scope(F.col("q"))
    assert df.select(V.page_acl(F.col("s"), F.col("p"), trust, principal).alias("ok")).first().ok is want


def test_failures_wait_or_end(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (8, None)], "n int, error string").select(T.retry_state(F.col("n"), F.col("error"), F.timestamp_seconds(F.lit(100))).alias("s"))
    got = [(r.s.state, r.s.available_at and int(r.s.available_at.timestamp()), r.s.error and len(r.s.error)) for r in df.collect()]
    assert got == [("waiting", 105, 4000), ("dead_letter", None, None)]
    took = spark.range(1).select(T.latency_ms(F.timestamp_millis(F.lit(1000)), F.timestamp_millis(F.lit(2750))).alias("ms")).first()
    assert took.ms == 1750


def test_classifier_and_rewriter_see_only_what_is_theirs(spark):
    said = spark.createDataFrame([(1, "hi"), (2, "what about it"), (3, "the vacation policy"), (4, " "), (5, None)], "i int, m string")
    asked = said.select("i", T.needs_search(T.route_query(F.col("m")), F.col("m"), lambda many: ["it" in x.split() for x in many]).alias("s"))
    assert {r.i: r.s for r in asked.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "assistant", "d")], "conv_id int, turn int, role string, text string")
    contexts = T.query_context(turns)
    assert {r.conv_id: (r.context, r.last_user) for r in contexts.collect()} == {1: ("user: a\nassistant: b\nuser: c", "c"), 2: ("assistant: d", None)}
    assert {r.conv_id: r.query for r in T.rewrite_queries(contexts).collect()} == {1: "c", 2: None}
    assert {r.conv_id: r.query for r in T.rewrite_queries(contexts, lambda many: [x.upper() if "c" in x else " " for x in many]).collect()} == {1: "USER: A\nASSISTANT: B\nUSER: C", 2: None}
