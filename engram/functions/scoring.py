"""Scores of candidates, messages and memory items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from engram.functions import sql as F
from engram.functions.sql import Expr as Column

from engram.functions import fixed_values as V
from engram.functions.classify import (
    all_low_info, has_decision_marker, is_correction_like, is_speculative, lookup,
)
from engram.functions.text import estimate_tokens, keywords, nfkc, normalize_utterance

SIGNALS = ("relevance", "importance", "freshness", "confidence", "stability",
           "information_gain")


def _plus(df: DataFrame, *added: Column) -> DataFrame:
    return df.selectExpr("*", *[str(a) for a in added])


def score_columns(candidates: DataFrame, content: str = "candidate_content") -> DataFrame:
    """Adds confidence, importance, stability and freshness of a candidate."""
    text = F.col(content)
    rows = _plus(candidates, (is_speculative(text) | (F.col("authority") == "speculation"))
                 .alias("_spec"))
    spec = F.col("_spec")
    by_user = (F.col("authority") == "user") & ~spec
    base = (F.when(by_user & (F.col("type") == "decision"), 0.95).when(by_user, 0.88)
            .when((F.col("authority") == "assistant") & ~spec, 0.7).otherwise(0.55))
    corrected = F.when(F.col("is_correction") | is_correction_like(text), F.lit(0.92))
    marked = F.when(has_decision_marker(text) & by_user, F.lit(0.93))
    weight = F.coalesce(lookup(F.col("type"), V.TYPE_IMPORTANCE), F.lit(0.6))
    return _plus(rows,
        F.greatest(F.when(spec, F.least(base, F.lit(0.6))).otherwise(base),
                   corrected, marked).alias("confidence"),
        F.when(F.col("is_correction"), F.greatest(weight, F.lit(0.9))).otherwise(weight)
        .alias("importance"),
        F.when(by_user, 0.55).when(spec, 0.3).otherwise(0.35).alias("stability"),
        F.lit(1.0).alias("freshness"),
    ).drop("_spec")


def item_value(relevance, importance, freshness, confidence, stability, gain) -> Column:
    """Weighted value of a selectable item, clamped to [0, 1], 4 decimals."""
    total = (F.lit(0.25) * relevance + F.lit(0.25) * importance + F.lit(0.2) * freshness
             + F.lit(0.1) * confidence + F.lit(0.1) * stability + F.lit(0.1) * gain)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    # Rounds the binary value; round() would first take its shortest decimal form.
    return F.floor(clamped * 10000.0 + 0.5) / 10000.0


def overlap_relevance(item_words: Column, query_words: Column) -> Column:
    """0.5 without a query, 0.3 without words, 0.25 without overlap, else 0.4 + 0.6 ratio."""
    def by_share(shared):
        ratio = shared / F.size(query_words)
        return F.when(shared == 0, F.lit(0.25)).otherwise(
            F.least(F.lit(1.0), F.lit(0.4) + ratio * F.lit(0.6)))

    # Words are found once, however many branches look at them.
    def by_words(words):
        return F.when(F.size(words) == 0, F.lit(0.3)).otherwise(
            F.let(F.size(F.array_intersect(query_words, words)), by_share))
    return F.when(F.size(query_words) == 0, F.lit(0.5)).otherwise(F.let(item_words, by_words))


def relevance(text: Column, query_words: Column) -> Column:
    return overlap_relevance(keywords(text), query_words)


def score_messages(messages: DataFrame) -> DataFrame:
    """Selectable items of request messages.

    Needs request_id, ordinal, role, content, token_cost, turns_from_end and
    query_words; adds kind, mandatory, the six signals and score.
    """
    role, content, turns = F.col("role"), F.col("content"), F.col("turns_from_end")
    rows = _plus(
        messages.withColumn("_plain", nfkc("content")),
        all_low_info(normalize_utterance(F.col("_plain"))).alias("_ack"),
        has_decision_marker(content).alias("_decided"),
        relevance(content, F.col("query_words")).alias("_relevance"))
    system, latest = role == "system", turns == 0
    ack, tool, decided = F.col("_ack"), role == "tool", F.col("_decided")

    def pick(for_system, for_latest, otherwise):
        return F.when(system, F.lit(for_system)).when(latest, F.lit(for_latest)).otherwise(
            otherwise)
    importance = F.when(tool, F.when(turns <= 2, 0.65).otherwise(0.4)).otherwise(
        F.when(turns <= 3, 0.85).otherwise(0.5))
    stability = F.when(tool, 0.7).when(role == "user", 0.8).otherwise(0.65)
    confidence = F.when(tool, 0.9).when(role == "user", 0.95).otherwise(0.8)
    scored = _plus(rows,
        F.when(system, "system").when(latest, "new_message").when(tool, "tool_result")
        .otherwise("message").alias("kind"),
        (system | latest).alias("mandatory"),
        pick(0.8, 1.0, F.col("_relevance")).alias("relevance"),
        pick(1.0, 1.0, confidence).alias("confidence"),
        pick(1.0, 1.0, F.when(ack, 0.05).when(decided, F.greatest(importance, F.lit(0.92)))
             .otherwise(importance)).alias("importance"),
        pick(1.0, 1.0, F.greatest(F.lit(0.2), F.lit(1.0) - turns * F.lit(0.08)))
        .alias("freshness"),
        pick(1.0, 0.9, F.when(ack, 0.1).when(decided, F.greatest(stability, F.lit(0.9)))
             .otherwise(stability)).alias("stability"),
        pick(0.9, 0.95, F.when(ack, 0.05).when(turns <= 2, 0.85).otherwise(0.6))
        .alias("information_gain"),
    ).drop("_plain", "_ack", "_decided", "_relevance")
    return _plus(scored, item_value(*[F.col(c) for c in SIGNALS]).alias("score"))


def describe_memories(items: DataFrame) -> DataFrame:
    """Adds what scoring needs of an item alone (words of content and topic, token cost), so
    that it is computed per item and not per request."""
    topic = F.coalesce(F.col("topic_key"), F.lit(""))
    return _plus(
        items, keywords(F.col("content")).alias("_words"),
        keywords(F.regexp_replace(topic, "[._-]", " ")).alias("_topic_terms"),
        keywords(topic).alias("_topic_words"),
        (estimate_tokens(F.concat(F.col("type"), F.lit(": "), F.col("content"))) + 2)
        .alias("token_cost"))


#: Scores that stand in for zero.
MEMORY_DEFAULTS = {"confidence": 0.85, "importance": 0.8, "freshness": 0.9, "stability": 0.8,
                   "information_gain": 0.75}
#: What describe_memories() adds for scoring alone.
DESCRIBED = ("_words", "_topic_terms", "_topic_words")


def memory_signals(item, query: Column) -> dict[str, Column]:
    """Signals of a described item, ``item(name)`` being one of its columns, for the words of a
    query, and whether it is mandatory; zero scores fall back to defaults."""
    topic = F.coalesce(item("topic_key"), F.lit(""))
    bonus = F.when(F.size(F.array_intersect(query, item("_topic_terms"))) > 0,
                   overlap_relevance(item("_topic_words"), query)).otherwise(F.lit(0.0))
    base = overlap_relevance(item("_words"), query)
    topical = F.when(topic != "", F.greatest(
        base, F.least(F.lit(1.0), F.lit(0.5) + bonus * F.lit(0.5)))).otherwise(base)
    status = F.lower(F.coalesce(item("status"), F.lit("")))
    durable = ((F.lower(F.coalesce(item("scope"), F.lit(""))) == "user")
               & F.lower(item("type")).isin("preference", "fact", "constraint"))
    kept = F.when(durable, F.greatest(topical, F.lit(0.55))).otherwise(topical)
    scores = {n: F.when(F.coalesce(item(n), F.lit(0.0)) == 0, F.lit(d)).otherwise(item(n))
              for n, d in MEMORY_DEFAULTS.items()}
    return scores | {
        "mandatory": durable & status.isin("active", ""),
        "relevance": F.when(status == "superseded", F.greatest(
            F.lit(0.35), kept * F.lit(0.85))).otherwise(kept)}


def score_memories(rows: DataFrame) -> DataFrame:
    """Selectable items of retrieved memories; zero scores fall back to defaults.

    ``rows``: described items with query_words; adds mandatory, relevance and score and
    replaces zero signals.
    """
    others = [c for c in rows.columns if c not in MEMORY_DEFAULTS and c not in DESCRIBED]
    signals = memory_signals(F.col, F.col("query_words"))
    out = rows.selectExpr(*[str(F.col(c)) for c in others],
                          *[str(s.alias(n)) for n, s in signals.items()])
    return _plus(out, item_value(*[F.col(c) for c in SIGNALS]).alias("score"))
