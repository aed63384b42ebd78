"""Routes candidates to durable memory, short-term context or discard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from engram.functions import fixed_values as V
from engram.functions import sql as F
from engram.functions.classify import is_noise, is_preference_noise, routed
from engram.functions.regex import group, matches, strip
from engram.functions.sql import Expr, col


def bucket(content: Expr, mtype: Expr, fact_value: Expr, corrective: Expr) -> Expr:
    lowered = F.lower(strip(content))
    value = F.when(F.coalesce(fact_value, "") != "", fact_value).otherwise(strip(content))
    return (F.when(is_noise(lowered), "discard")
            .when((mtype == "preference") & is_preference_noise(value), "discard")
            .when(matches(lowered, V.CONTEXT_MARKER), "context")
            .when(corrective, "store")
            .when(mtype.isin(*V.DURABLE_TYPES), "store")
            .when(mtype.isin("active_task", "temporary_state"), "context")
            .otherwise("discard"))


def context_key(content: Expr) -> Expr:
    return routed(content, V.CONTEXT_KEYS, V.DEFAULT_CONTEXT_KEY)


def route_candidates(candidates: DataFrame) -> DataFrame:
    """Adds bucket, subject, predicate, value, scope and, for context rows, key and TTL."""
    content, mtype, fact = col("candidate_content"), col("type"), col("fact")
    corrective = (col("is_correction") | col("correction").isNotNull()
                  | col("revocation").isNotNull())
    pair = matches(strip(content), V.KEY_VALUE_PLAIN)
    key, value = (strip(group(strip(content), V.KEY_VALUE_PLAIN, g)) for g in ("key", "value"))

    def filled(x, default):
        return F.when(F.coalesce(x, "") != "", x).otherwise(default)

    def field(of_fact, of_pair, otherwise):
        return F.when(fact.isNotNull(), of_fact).when(pair, of_pair).otherwise(otherwise)
    rows = candidates.selectExpr(
        "*",
        str(bucket(content, mtype, fact["value"], corrective).alias("bucket")),
        str(field(filled(fact["entity"], "project"), "project", "project").alias("subject")),
        str(field(filled(fact["attribute"], "attribute"),
                  F.regexp_replace(F.lower(key), r"\s+", "_"), mtype).alias("predicate")),
        str(field(filled(fact["value"], content), value, content).alias("value")),
        str(field(F.coalesce(fact["scope"], "project"), "project", "project").alias("scope")))
    in_context = col("bucket") == "context"
    keyed = rows.selectExpr("*", str(F.when(in_context, context_key(content))
                                     .alias("context_key")))
    return keyed.selectExpr("*", str(F.when(in_context, F.when(
        col("context_key") == "current_error", V.ERROR_TTL_SECONDS)
        .otherwise(V.CONTEXT_TTL_SECONDS)).alias("ttl_seconds")))
