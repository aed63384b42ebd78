"""Messages -> candidate memories.  Narrow: one row in, its candidates out, no shuffle."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as SF
from pyspark.sql import types as T

from engram.functions import facts as R
from engram.functions import fixed_values as V
from engram.functions import sql as F
from engram.functions.classify import (
    all_low_info, authority, is_correction_like, is_interrogative, is_low_info,
    is_speculative, preference_domain, preference_topic,
)
from engram.functions.extended import local_facts
from engram.functions.regex import matches, strip
from engram.functions.scoring import score_columns
from engram.functions.sql import Expr, col
from engram.functions.text import nfkc, normalize_utterance

CORRECTION_TYPE = "struct<target:string,old_value:string,new_value:string>"
REVOCATION_TYPE = "struct<target:string,value:string>"
CANDIDATE_TYPE = (
    "struct<content:string,type:string,topic_key:string,authority:string,"
    f"is_correction:boolean,fact:{R.FACT_TYPE},correction:{CORRECTION_TYPE},"
    f"revocation:{REVOCATION_TYPE}>"
)


@SF.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: [unicodedata.normalize("NFKC", s) for s in json.loads(a)],
                     na_action="ignore")


def classify_messages(messages: DataFrame) -> DataFrame:
    """Adds the gate flags and the reason a message is skipped (null = eligible)."""
    content, role, plain = col("content"), col("role"), col("_plain")
    flagged = messages.withColumn("_plain", nfkc("content")).selectExpr(
        *[f"`{c}`" for c in messages.columns],
        str(is_low_info(plain, role).alias("low_info")),
        str(is_interrogative(content, plain).alias("interrogative")),
        str(is_speculative(content).alias("speculative")))
    reason = (F.when(~role.isin("user", "assistant"), "role")
              .when(col("low_info"), "low_info").when(col("interrogative"), "interrogative")
              .when(col("speculative"), "speculative"))
    return flagged.selectExpr("*", str(reason.alias("skip_reason")))


def _candidate(content, mtype, topic, auth, is_correction, fact=None, correction=None,
               revocation=None) -> Expr:
    return F.struct(
        F.lit(content).alias("content"), F.lit(mtype).alias("type"),
        F.lit(topic).alias("topic_key"), F.lit(auth).alias("authority"),
        F.lit(is_correction).alias("is_correction"),
        F.lit(fact).cast(R.FACT_TYPE).alias("fact"),
        F.lit(correction).cast(CORRECTION_TYPE).alias("correction"),
        F.lit(revocation).cast(REVOCATION_TYPE).alias("revocation"),
    ).cast(CANDIDATE_TYPE)


def _demoted(role: Expr, content: Expr, mtype: Expr) -> Expr:
    """Assistants cannot decide or constrain: such statements are speculation."""
    return F.when((role == "assistant") & mtype.isin("decision", "constraint"),
                  "speculation").otherwise(authority(role, content))


def fact_candidate(f: Expr, role: Expr, content: Expr, corrected: Expr) -> Expr:
    return _candidate(
        R.fact_content(f["attribute"], f["value"], f["type"]), f["type"],
        R.fact_topic(f["entity"], f["attribute"], f["value"], f["type"], f["key"], f["scope"]),
        _demoted(role, content, f["type"]), corrected | f["is_update"], f)


def correction_candidate(c: Expr, role: Expr, content: Expr, text: Expr) -> Expr:
    of_preference = F.lower(c["target"]).isin(*V.CORRECTION_PREFERENCE_TARGETS)
    target = F.lower(c["target"])
    bare_type = (F.when(matches(target, V.DECISION_ATTRIBUTE), "decision")
                 .when(target.contains("prefer"), "preference").otherwise("fact"))

    def build(d):
        mtype = (F.when(of_preference, "preference").when(c["old_value"] == "", bare_type)
                 .when(d.isin(*V.CORRECTION_DECISION_DOMAINS), "decision").otherwise("fact"))
        entity = F.when(of_preference, "user").otherwise(c["target"])
        attribute = F.when(~of_preference & (c["old_value"] == ""), c["target"]).otherwise(d)

        def with_type(t):
            none = F.lit(None).cast("string")
            topic = F.when(of_preference, preference_topic(c["new_value"], d)).otherwise(
                R.fact_topic(entity, attribute, c["new_value"], t, none, none))
            return _candidate(
                R.fact_content(attribute, c["new_value"], t), t, topic,
                authority(role, content), True,
                R.fact(entity, attribute, c["new_value"], t, text), correction=c)
        return R.let(mtype, with_type)
    return R.let(preference_domain(c["new_value"], c["old_value"]), build)


def revocation_candidate(r: Expr) -> Expr:
    return _candidate(F.concat("REVOKE: ", r["target"]), "fact", V.REVOCATION_TOPIC, "user",
                      False, revocation=r)


def _labelled(text: Expr) -> tuple[Expr, Expr, Expr]:
    label, body = R.parse_label(text)
    return label, body, label.isNotNull() & (body != "")


def fallback_statement(text: Expr) -> Expr:
    """The unit tried when no sentence gave a fact: the labelled body, or everything."""
    _, body, labelled = _labelled(text)
    return R.statement(R.FALLBACK, 0, "plain", F.when(labelled, body).otherwise(strip(text)))


def fallback_candidate(text: Expr, content: Expr, role: Expr, corrected: Expr,
                       f: Expr) -> Expr:
    """Labelled or typed statement; assistants need an explicit label.  ``f`` is the fact
    of the fallback statement, if any."""
    label, body, labelled = _labelled(text)
    kind = "struct<type:string,content:string>"
    with_label = F.when(~is_interrogative(body), F.struct(
        label.alias("type"), body.alias("content")).cast(kind))
    whole = F.when(f.isNotNull(), F.struct(
        f["type"].alias("type"),
        R.fact_content(f["attribute"], f["value"], f["type"]).alias("content")).cast(kind))
    plain = F.coalesce(whole, R.typed_statement(strip(text)).cast(kind))
    allowed = (role != "assistant") | R.parse_label(content)[0].isNotNull()

    def build(s):
        topic = F.when(f.isNotNull(), R.fact_topic(
            f["entity"], f["attribute"], f["value"], f["type"], f["key"], f["scope"])
        ).otherwise(R.topic_from_content(s["content"], s["type"]))
        return F.when(s.isNotNull(), F.array_of([_candidate(
            s["content"], s["type"], topic, _demoted(role, content, s["type"]), corrected, f)]))
    return F.when(allowed, R.let(F.when(labelled, with_label).otherwise(plain), build))


def message_facts(messages: DataFrame, text: str = "content") -> DataFrame:
    """Core rules on any text column: adds ``facts``, the first fact per key."""
    units = F.flatten(F.transform(R.split_sentences(col(text)), R.statements))
    facts = F.let(R.facts_of_statements(units), lambda found: R.first_per_key(
        F.transform(found, lambda x: x["f"])))
    return messages.selectExpr("*", str(facts.alias("facts")))


def gated_facts(messages: DataFrame) -> DataFrame:
    """Core facts per message, low-information and interrogative sentences left out."""
    rows = messages.selectExpr("*", str(R.split_sentences(col("content")).alias("_sentences")))
    kept = F.filter(col("_sentences"), lambda s: (
        ~all_low_info(normalize_utterance(s)) & ~is_interrogative(s)))
    facts = F.let(R.facts_of_statements(F.flatten(F.transform(kept, R.statements))),
                  lambda found: R.first_per_key(F.transform(found, lambda x: x["f"])))
    return rows.selectExpr("*", str(facts.alias("facts"))).drop("_sentences")


def _core_candidates(prepared: DataFrame) -> DataFrame:
    rows = prepared.selectExpr("*", str(R.split_sentences(col("_text")).alias("_sentences")))
    # Only sentences with other than ASCII letters travel to the Arrow function.
    # As JSON: after each row the size of the batch is taken, which for lists walks back over
    # all nulls before it.
    foreign = SF.when(SF.col("_text").rlike(r"[^\x00-\x7F]"), SF.to_json("_sentences"))
    rows = rows.withColumn("_nfkc", _nfkc_each(foreign))

    # One nested expression: stacked projections would be inlined into each other by
    # the optimizer and evaluated several times.
    def from_statements(m):
        kept = F.filter(
            F.arrays_zip(m["sentences"], m["plain"]),
            lambda s: ~all_low_info(normalize_utterance(s["plain"]))
            & ~is_interrogative(s["sentences"], s["plain"]))
        tried = F.concat(
            F.flatten(F.transform(kept, lambda s, i: R.statements(s["sentences"], i))),
            F.array_of([fallback_statement(m["text"])]))

        def build(found):
            whole = F.try_element_at(F.filter(found, lambda x: x["s"] == R.FALLBACK), 1)
            facts = R.first_per_key(F.transform(
                F.filter(found, lambda x: x["s"] >= 0), lambda x: x["f"]))
            return F.let(facts, lambda fs: F.when(F.size(fs) > 0, F.transform(
                fs, lambda f: fact_candidate(f, m["role"], m["content"], m["corrected"])))
                .otherwise(F.let(whole["f"], lambda f: fallback_candidate(
                    m["text"], m["content"], m["role"], m["prefixed"] | m["corrected"], f))))
        return F.let(R.facts_of_statements(tried), build)

    def build(m):
        return (
            F.when(m["revocation"].isNotNull(), F.when(
                m["role"] == "user", F.array_of([revocation_candidate(m["revocation"])])))
            .when(m["correction"].isNotNull(), F.array_of([correction_candidate(
                m["correction"], m["role"], m["content"], m["text"])]))
            .otherwise(from_statements(m)))
    message = F.struct(
        col("_text").alias("text"), col("role").alias("role"), col("content").alias("content"),
        col("_prefixed").alias("prefixed"), col("_sentences").alias("sentences"),
        F.coalesce(col("_nfkc"), col("_sentences")).alias("plain"),
        is_correction_like(col("content")).alias("corrected"),
        R.parse_revocation(col("_text")).alias("revocation"),
        R.parse_correction(col("_text")).alias("correction"))
    return rows.selectExpr("*", str(F.let(message, build).alias("_candidates")))


def _extended_candidates(prepared: DataFrame) -> DataFrame:
    role, content = col("role"), col("content")
    candidates = F.let(R.first_per_key(local_facts(col("_text"))), lambda facts: F.transform(
        facts, lambda f: fact_candidate(f, role, content, is_correction_like(content))))
    return prepared.selectExpr("*", str(candidates.alias("_candidates")))


def extract_candidates(messages: DataFrame, ruleset: str = "core") -> DataFrame:
    """One row per candidate, with ``pos`` inside the message and its scores.

    ``messages`` needs role and content; every other column is carried along.
    """
    carried = [f"`{c}`" for c in messages.columns]
    eligible = classify_messages(messages).filter("skip_reason is null").selectExpr(*carried)
    stripped, had_prefix = R.strip_correction_prefix(col("content"))
    prepared = eligible.selectExpr("*", str(stripped.alias("_text")),
                                   str(had_prefix.alias("_prefixed")))
    prepared = prepared.filter(str(~is_interrogative(col("_text"))))
    rows = _extended_candidates(prepared) if ruleset == "extended" else _core_candidates(prepared)
    # The outer form, because a plain explode adds a filter on the array below it, which
    # would evaluate the rules twice.
    rows = rows.selectExpr(*carried, "posexplode_outer(_candidates) AS (pos, _c)")
    rows = rows.filter("_c is not null")
    fields = ["_c.content AS candidate_content"] + [f"_c.{n}" for n in (
        "type", "topic_key", "authority", "is_correction", "fact", "correction", "revocation")]
    return score_columns(rows.selectExpr(*carried, "pos", *fields))
