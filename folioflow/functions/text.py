"""Text rules: token estimates, retrieval texts, redaction, citations, routing and retry times."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BLANK, collapse

CHARS_PER_TOKEN = 4

#: Replies about missing access. Fixed values.
NO_ACCESS_PHRASES = (
    "i don't have access", "i do not have access", "i don't have the document", "i do not have the document",
    "without access to the", "i can't see the", "i cannot see the", "i can't access", "i cannot access",
    "i'm unable to", "i am unable to", "i don't have enough context", "i do not have enough context",
    "cannot provide context", "can't provide context", "provided contains only", "contains only the single",
    "contains only this single", "only see this single", "only this single chunk", "no document was provided",
    "no document is provided", "there is no document", "there's no document", "wasn't provided",
    "was not provided", "isn't provided", "is not provided", "i don't see the", "i do not see the",
)

#: Whole messages that are small talk. Fixed values.
SMALL_TALK = (
    "hi", "hi there", "hello", "hello there", "hey", "hey there", "yo", "howdy", "good morning", "good afternoon",
    "good evening", "morning", "evening", "sup", "what's up", "whats up", "bye", "goodbye", "see ya", "see you",
    "later", "take care", "thanks", "thank you", "thx", "ty", "cheers", "appreciate it", "ok", "okay", "cool",
    "nice", "got it", "sounds good", "alright", "test", "testing", "test test", "ping", "hello world",
    "are you there", "are you working", "you there", "anyone there", "is this working", "who are you",
    "what are you", "what can you do", "what can you help with", "what can you help me with", "what do you do",
    "help", "what topics do you know about", "what topics do you know", "what topics can you help with",
    "what topics can you help me with", "how specific should my question be", "what can i ask", "what can i ask you",
)

#: Whole messages that ask who the user is. Fixed values.
IDENTITY = (
    "which integration do we use", "what integration do we use", "which integration am i using",
    "what integration am i using", "what integration is this", "which platform do we use",
    "what platform do we use", "what platform am i on", "which platform am i on", "what is my integration",
    "what's my integration", "whats my integration", "what company am i", "which company am i",
    "what company is this", "what's my company", "whats my company", "what is my company",
    "what company do i belong to", "which company do i belong to", "which company do i work for",
    "what company do i work for", "who am i",
)

#: Pattern and placeholder, in this order. Fixed values.
REDACTIONS = (
    (r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "[REDACTED_EMAIL]"),
    (r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"(?U)\b(?:\d[ -]?){13,16}\b", "[REDACTED_CARD]"),
    (r"(?U)\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
)


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), ""))


def token_count(text: Column) -> Column:
    """Blank: 0; else the larger of the words and a quarter of the characters, rounded up."""
    words = word_count(text)  # in no branch, so that it is worked out once
    return F.greatest(words, F.least(words, F.lit(1)) * F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def metadata_prefix(title: Column, path: Column) -> Column:
    """Title and heading trail, joined by a dash; without the trail where it says the title again."""
    trail = F.array_join(F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: x != ""), " > ")
    return F.when((trail == "") | (trail == title), F.coalesce(title, F.lit(""))).when(F.coalesce(title, F.lit("")) == "", trail).otherwise(F.concat(title, F.lit(" — "), trail))


def compose_retrieval(title: Column, path: Column, context: Column, text: Column) -> Column:
    """Prefix, context on its own line where there is one, a blank line, text."""
    prefix = metadata_prefix(title, path)
    head = F.when(F.coalesce(context, F.lit("")) == "", prefix).otherwise(F.concat(prefix, F.lit("\n"), context))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def clean_context(context: Column) -> Column:
    """Empty where the context is about not having the document."""
    low = F.lower(F.trim(context))
    said = F.lit(False)
    for phrase in NO_ACCESS_PHRASES:
        said = said | F.contains(low, F.lit(phrase))
    return F.when(said, F.lit("")).otherwise(F.trim(context))


def rerank_text(title: Column, retrieval: Column, most: int = 4000) -> Column:
    return F.left(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(retrieval, F.lit(""))), F.lit(most))


def redact_pii(text: Column) -> Column:
    for pattern, placeholder in REDACTIONS:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def enforce_citations(answer: Column, valid: Column) -> Column:
    """struct(text, used): sentences that cite a marker of ``valid`` (array<int>), without their other markers, and the
    sorted markers cited."""
    sentences = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    cited = lambda s: F.array_intersect(F.transform(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.try_cast("int")), valid)

    def tidy(s: Column) -> Column:
        wrong = F.array_except(F.transform(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m), F.transform(valid, lambda v: v.cast("string")))
        out = F.aggregate(wrong, s, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
        return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([.!?,;:])", "$1"), r"\s{2,}", " "))

    kept = F.filter(sentences, lambda s: F.size(cited(s)) > 0)
    return F.struct(F.array_join(F.transform(kept, tidy), " ").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.transform(kept, cited)))).alias("used"))


def parse_clarification(reply: Column) -> Column:
    """struct(question, options), null without a ``Question:`` line; the last such line counts."""
    lines = F.transform(F.split(F.trim(reply), r"\r\n|\r|\n"), lambda x: F.trim(x))
    question = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("question:")))
    text = F.trim(F.substr(F.element_at(question, -1), F.lit(len("question:") + 1)))
    options = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("-"))), lambda x: F.trim(F.substr(x, F.lit(2)))), lambda x: x != "")
    return F.when((F.size(question) > 0) & (text != ""), F.struct(text.alias("question"), options.alias("options")))


def said_phrase(message: Column) -> Column:
    """The whole message in the form that phrase lists have: trimmed, lower case, no closing !.? and single spaces."""
    return collapse(F.regexp_replace(F.lower(F.trim(message)), r"[!.?\s]+$", ""))


def route_query(message: Column, long_enough: int = 12) -> Column:
    """small_talk, identity, empty, search (``long_enough`` words) or needs_classifier."""
    phrase, blank = said_phrase(message), collapse(F.coalesce(message, F.lit("")))
    return (
        F.when(phrase.isin(*SMALL_TALK), "small_talk")
        .when(phrase.isin(*IDENTITY), "identity")
        .when(blank == "", "empty")
        .when(word_count(message) >= long_enough, "search")
        .otherwise("needs_classifier")
    )


def refusal_decision(score: Column, has_image: Column, refuse_below: float = 0.05, off_topic: float = 0.035) -> Column:
    """answer, no_candidates, off_topic or weak_score."""
    return F.when(F.coalesce(has_image, F.lit(False)), "answer").when(score.isNull(), "no_candidates").when(score <= off_topic, "off_topic").when(score < refuse_below, "weak_score").otherwise("answer")


HAND_OFF = ("no_candidates", "weak_score", "no_citations")


def retry_seconds(attempts: Column, base: int = 5, most: int = 3600) -> Column:
    """min(base * 2 ** (attempts - 1), most)."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(most))).cast("long")


def retry_state(attempts: Column, error: Column, now: Column, most_attempts: int = 8, chars: int = 4000) -> Column:
    """struct(state, available_at, error) after a failure: dead_letter at ``most_attempts``, else waiting until ``now`` and the
    backoff; the error is cut to ``chars`` characters."""
    dead = attempts >= most_attempts
    later = F.timestamp_add("SECOND", retry_seconds(attempts).cast("int"), now)
    return F.struct(F.when(dead, "dead_letter").otherwise("waiting").alias("state"), F.when(~dead, later).alias("available_at"), F.left(error, F.lit(chars)).alias("error"))


def latency_ms(began: Column, ended: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.timestamp_diff("MILLISECOND", began, ended)


def needs_search(route: Column, message: Column, vague: Callable[[list[str]], list[bool]]) -> Column:
    """Whether a routed message is searched: those that `route_query` left to a classifier if ``vague``, a callable over batches
    of messages, says that they aren't vague. Other routes don't reach it."""

    @F.pandas_udf("boolean")
    def judged(text: pd.Series) -> pd.Series:
        out = pd.Series(False, index=text.index, dtype=object)
        asked = text.notna()
        out[asked] = list(vague(text[asked].tolist())) if asked.any() else []
        return out.astype(bool)

    open_question = F.when(route == "needs_classifier", message)
    return F.when(route == "search", F.lit(True)).otherwise((route == "needs_classifier") & ~judged(open_question))


def query_context(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(by, context, last_user): the lines ``role: text`` of a conversation in order, and its last user text."""
    lines = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    each = turns.groupBy(by).agg(lines.alias("t"))
    said = F.filter("t", lambda x: x["role"] == "user")
    return each.select(by, F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("context"), F.try_element_at(said, F.lit(-1))["text"].alias("last_user"))


def rewrite_queries(contexts: DataFrame, rewrite: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """``contexts`` (context, last_user, ...) with ``query``: of ``rewrite``, a callable over batches of contexts; without one,
    or where it gives nothing, the last user text."""
    if rewrite is None:
        return contexts.withColumn("query", F.col("last_user"))

    @F.pandas_udf("string")
    def made(context: pd.Series) -> pd.Series:
        return pd.Series(list(rewrite(context.tolist())), index=context.index, dtype=object)

    new = made(F.col("context"))
    return contexts.withColumn("query", new).withColumn("query", F.coalesce(F.when(F.trim("query") != "", F.col("query")), "last_user"))
