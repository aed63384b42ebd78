"""External extraction results that arrive as JSON tables: facts, candidates, records.

Bad rows go to a quarantine result with a reason; the rest is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as SF

from engram.functions import external as E
from engram.functions import fixed_values as V
from engram.functions import sql as F
from engram.functions.classify import lookup
from engram.functions.extended import gate_route, local_facts, memory_gate
from engram.functions.facts import fact, split_by_boundary
from engram.functions.regex import matches, strip
from engram.functions.scoring import score_columns
from engram.functions.sql import Expr, col, let
from engram.functions.text import is_invalid_key, slugify, stability_score
from engram.operators.route import context_key

FACT_JSON = ("struct<facts:array<struct<entity:string,attribute:string,value:string,type:string,"
             "state:string,scope:string,confidence:double,rawText:string,"
             "metadata:map<string,string>>>>")
CANDIDATE_JSON = ("array<struct<action:string,destination:string,type:string,scope:string,"
                  "subject:string,predicate:string,value:string,topicKey:string,"
                  "confidence:double,importance:double,stability:string,ttl_hours:double,"
                  "supersedes_id:string,reinforces_id:string,informationGain:double,"
                  "rawText:string>>")
RECORD_JSON = ("struct<consolidated:array<struct<type:string,scope:string,subject:string,"
               "predicate:string,value:string,topicKey:string,confidence:double,"
               "importance:double,stability:string,sourceMemoryIds:array<string>,"
               "consolidationNote:string>>,superseded_ids:array<string>,"
               "conflicts_detected:array<struct<memory_ids:array<string>,description:string,"
               "resolution:string>>>")


def isolate_json(text: Expr) -> Expr:
    """JSON inside prose: a fenced block, else the outermost brackets or braces."""
    t = strip(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1)
    array = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return (F.when(strip(fenced) != "", strip(fenced)).when(array != "", array)
            .when(braces != "", braces).otherwise(t))


def _clamped(value: Expr, default: float) -> Expr:
    usable = value.isNotNull() & ~F.isnan(value)
    return F.when(usable, F.least(1.0, F.greatest(0.0, value))).otherwise(default)


def _text(value: Expr, default: str = "") -> Expr:
    return F.when(F.coalesce(value, "") != "", value).otherwise(default)


def parse_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, quarantine) of a table message_id, message, facts_json.

    ``facts`` has one row per message with its accepted facts as an array."""
    parsed = rows.withColumn("_p", SF.from_json("facts_json", FACT_JSON))
    exploded = parsed.selectExpr(
        "message_id", "message", "posexplode_outer(_p.facts) AS (pos, f)",
        "_p.facts IS NULL AS unreadable")
    f = col("f")
    attribute, value = strip(_text(f["attribute"])), strip(_text(f["value"]))
    reason = (
        F.when(col("unreadable"), "unreadable").when(f.isNull(), "empty")
        .when((strip(_text(f["entity"])) == "") | (attribute == "") | (value == ""),
              "missing field")
        .when(is_invalid_key(attribute), "question word as attribute")
        .when(f["confidence"].isNull() | F.isnan(f["confidence"]) | (f["confidence"] < 0.0)
              | (f["confidence"] > 1.0), "confidence outside 0..1")
        .when(lookup(_text(f["type"], "fact"), V.EXTERNAL_TYPES).isNull(), "unknown type"))
    judged = exploded.selectExpr("*", str(reason.alias("reason")))
    scope = F.when(f["scope"].isin("project", "session"), f["scope"]).otherwise("user")
    over = F.coalesce(F.try_element_at(f["metadata"], "preferred_over"),
                      F.try_element_at(f["metadata"], "over"))
    built = fact(
        strip(f["entity"]), attribute, value, lookup(_text(f["type"], "fact"), V.EXTERNAL_TYPES),
        strip(_text(f["rawText"])), F.concat(scope, ".", slugify(attribute)), scope, False,
        E.state_of(_text(f["state"], "current")), f["confidence"], E.metadata_map(
            preferred_over=strip(over),
            condition=strip(F.try_element_at(f["metadata"], "condition")),
            reason=strip(F.try_element_at(f["metadata"], "reason"))))
    accepted = judged.filter("reason IS NULL").selectExpr(
        "message_id", "message", "pos", str(built.alias("fact")))
    return accepted, judged.filter("reason IS NOT NULL and reason <> 'empty'").select(
        "message_id", "pos", "reason")


def per_message(accepted: DataFrame) -> DataFrame:
    """Accepted facts gathered per message again (a message has a handful)."""
    entries = SF.array_sort(SF.collect_list(SF.struct("pos", "fact")),
                            lambda a, b: a["pos"] - b["pos"])
    return accepted.groupBy("message_id").agg(
        SF.first("message").alias("message"),
        SF.transform(entries, lambda e: e["fact"]).alias("facts"))


def validate(messages: DataFrame) -> DataFrame:
    """Adds ``validated``: normalised facts of each message.

    ``messages``: message (text) and facts (array of facts)."""
    def with_context(m):
        def resolve(facts):
            return E.deduplicated(F.transform(facts, lambda f: E.resolved(
                f, m["names"], m["project"])))
        return let(F.flatten(F.transform(m["facts"], lambda f: E.validated(m, f))), resolve)
    source = strip(col("message"))
    rows = messages.selectExpr(
        "*", str(source.alias("_source")),
        str(E.named_project(source, col("facts")).alias("_project")))
    scoped = matches(col("_source"), V.PROJECT_SCOPE_HINT) | col("_project").isNotNull()
    context = F.struct(
        col("_source").alias("source"), split_by_boundary(col("_source")).alias("clauses"),
        col("_project").alias("project"), scoped.alias("project_scoped"),
        E.names_in(col("facts")).alias("names"), col("facts").alias("facts"))
    return rows.selectExpr("*", str(let(context, with_context).alias("validated"))).drop(
        "_source", "_project")


def merge_facts(rows: DataFrame) -> DataFrame:
    """Adds ``merged``: local and external facts of a message, made canonical, resolved and
    deduplicated.  ``rows``: local_facts, validated."""
    def build(facts):
        names = E.names_in(facts)
        return E.deduplicated(F.transform(facts, lambda f: E.resolved(
            f, names, F.lit(None).cast("string"))))
    both = F.array_compact(F.transform(
        F.concat(col("local_facts"), col("validated")), E.canonical))
    return rows.selectExpr("*", str(let(both, build).alias("merged")))


def hybrid_facts(messages: DataFrame) -> DataFrame:
    """Route per message (skip, local, external) and its facts.

    ``messages``: message and facts (external ones, possibly empty)."""
    gated = messages.selectExpr(
        "*", str(memory_gate(col("message")).alias("gate")),
        str(local_facts(strip(col("message"))).alias("local_facts")))
    routed = gated.selectExpr("*", str(gate_route(
        col("gate"), F.size(col("local_facts"))).alias("route")))
    merged = merge_facts(validate(routed))
    chosen = (F.when(col("route") == "skip", E.EMPTY_FACTS)
              .when(col("route") == "local", col("local_facts")).otherwise(col("merged")))
    return merged.selectExpr("*", str(chosen.alias("chosen")))


def _judged_candidates(rows: DataFrame) -> DataFrame:
    """Entries of a table with a response column (JSON in prose): pos, c, and the reason that
    rejects one; a response without a readable list is one row without pos."""
    raw = isolate_json(col("response"))
    listed = F.when(raw.startswith("["), raw).otherwise(F.get_json_object(raw, "$.candidates"))
    one = rows.selectExpr("*", str(listed.alias("_j"))).withColumn(
        "_c", SF.from_json("_j", CANDIDATE_JSON)).selectExpr(
        *[f"`{c}`" for c in rows.columns if c != "response"],
        "_c IS NULL AS unreadable", "posexplode_outer(_c) AS (pos, c)")
    c = col("c")
    action, destination = F.upper(_text(c["action"], "NEW")), F.upper(
        _text(c["destination"], "STORE"))
    reason = (
        F.when(col("unreadable"), "unreadable").when(c.isNull(), "empty")
        .when(action == "DISCARD", "discarded")
        .when(~action.isin(*V.EXTERNAL_ACTIONS), "unknown action")
        .when(~destination.isin("STORE", "CONTEXT"), "unknown destination")
        .when((strip(_text(c["value"])) == "") | (strip(_text(c["predicate"])) == ""),
              "missing field")
        .when(_clamped(c["confidence"], 0.8) < V.MIN_EXTERNAL_CONFIDENCE, "low confidence"))
    return one.selectExpr("*", str(reason.alias("reason"))).drop("unreadable")


def rejected_candidates(rows: DataFrame) -> DataFrame:
    """What parse_candidates leaves out: the columns beside response, pos, reason.

    An empty list has nothing to reject and gives no row."""
    return _judged_candidates(rows).filter("reason IS NOT NULL and reason <> 'empty'").drop("c")


def parse_candidates(rows: DataFrame) -> DataFrame:
    """External candidates of a table message_id, user_id, response (JSON in prose), scored
    and shaped like extracted candidates.  rejected_candidates gives the others."""
    c = col("c")
    action, destination = F.upper(_text(c["action"], "NEW")), F.upper(
        _text(c["destination"], "STORE"))
    value, predicate = strip(_text(c["value"])), strip(_text(c["predicate"]))
    confidence = _clamped(c["confidence"], 0.8)
    scope = F.lower(F.when(F.upper(c["scope"]).isin("USER", "PROJECT", "SESSION"), c["scope"])
                    .otherwise("USER"))
    stability = F.when(F.lower(c["stability"]).isin(*V.STABILITY_LABELS), F.lower(
        c["stability"])).otherwise("long-term")
    mtype = F.lower(_text(c["type"], "FACT"))
    known = F.when(mtype.isin(*V.MEMORY_TYPES), mtype).otherwise("fact")
    replaces = action.isin("SUPERSEDES", "CONTRADICTS")
    fields = _judged_candidates(rows).filter("reason IS NULL").selectExpr(
        *[f"`{x}`" for x in rows.columns if x != "response"], "pos",
        f"{known} AS type", f"{value} AS value", f"{predicate} AS predicate",
        f"{_text(c['subject'], 'user')} AS subject", f"{scope} AS scope",
        f"{F.when(_text(c['topicKey']) != '', c['topicKey']).otherwise(F.concat(scope, '.', predicate))} AS topic_key",
        f"{F.when(_text(c['rawText']) != '', c['rawText']).otherwise(value)} AS raw_text",
        f"{replaces} AS is_correction", f"{F.lower(destination)} AS source_bucket",
        f"{confidence} AS source_confidence", f"{_clamped(c['importance'], 0.7)} AS source_importance",
        f"{stability_score(stability)} AS source_stability",
        f"{_clamped(c['informationGain'], 0.8)} AS source_gain",
        "CASE WHEN c.ttl_hours > 0 THEN c.ttl_hours END AS ttl_hours",
        f"{F.when(replaces, _text(c['supersedes_id'], ''))} AS obsolete_id")
    shaped = fields.selectExpr(
        "*", "CASE WHEN type = 'preference' THEN value ELSE raw_text END AS candidate_content",
        "'user' AS authority", f"{fact(col('subject'), col('predicate'), col('value'), col('type'), col('raw_text'), col('topic_key'), col('scope'), col('is_correction'))} AS fact",
        "CAST(NULL AS struct<target:string,old_value:string,new_value:string>) AS correction",
        "CAST(NULL AS struct<target:string,value:string>) AS revocation")
    scored = score_columns(shaped)
    return scored.withColumn("blended_confidence", SF.least(SF.lit(1.0), SF.greatest(
        SF.lit(0.0), SF.col("source_confidence") * SF.greatest(
            SF.lit(0.85), SF.col("confidence"))))).withColumn(
        "blended_importance", SF.greatest("source_importance", "importance")).withColumn(
        "valid_until_hours", SF.col("ttl_hours"))


def union_candidates(local: DataFrame, external: DataFrame, message: list[str]) -> DataFrame:
    """Local candidates, then external ones whose content (case-folded) is new per message."""
    columns = [c for c in local.columns if c in external.columns]
    said = local.select(*message, SF.lower("candidate_content").alias("_l")).distinct()
    fresh = external.withColumn("_l", SF.lower("candidate_content")).join(
        said, [*message, "_l"], "left_anti")
    # A window of a message's few rows, so that they are read and scored once.
    known = " and ".join(f"{c} is not null" for c in (*message, "_l"))
    kept = fresh.filter(known).withColumn("_first", SF.min("pos").over(
        Window.partitionBy(*message, "_l"))).filter("pos = _first")
    return local.select(*columns).unionByName(kept.select(*columns))


def with_external(routed: DataFrame, external: DataFrame, messages: DataFrame) -> DataFrame:
    """Routed candidates of `messages` (user_id, seq, ts) and, placed after them in their
    message, those external ones that say something new there; adds valid_until.

    ``external``: parse_candidates of a table whose message_id is the seq.  Its scores are the
    blended ones.  A TTL ends a stored item (valid_until) or a context entry (ttl_seconds).
    Entries of messages that are not among ``messages``, or without a user, are left out."""
    place = ["user_id", "seq"]
    said = messages.groupBy(*place).agg(SF.min("ts").alias("ts"))
    taken = routed.groupBy(*place).agg(SF.max("pos").alias("_last"))
    text, in_context = col("candidate_content"), col("source_bucket") == "context"
    key = context_key(text)
    usual = F.when(key == "current_error", V.ERROR_TTL_SECONDS).otherwise(V.CONTEXT_TTL_SECONDS)
    replaced = {"seq": col("message_id"), "bucket": col("source_bucket"),
                "confidence": col("blended_confidence"), "importance": col("blended_importance"),
                "context_key": F.when(in_context, key),
                "ttl_seconds": F.when(in_context, F.coalesce(
                    (col("ttl_hours") * 3600).cast("double"), usual.cast("double")))}
    kept = [f"`{c}`" for c in external.columns if c not in (*replaced, "message_id")]
    placed = external.selectExpr(*kept, *[f"{e} AS {n}" for n, e in replaced.items()]).join(
        said, place).join(taken, place, "left").withColumns({
            "pos": (SF.col("pos") + SF.coalesce(SF.col("_last") + 1, SF.lit(0))).cast("int"),
            "valid_until": SF.expr("CASE WHEN bucket = 'store' THEN "
                                   "ts + make_dt_interval(0, 0, 0, ttl_hours * 3600) END")})
    local = routed.withColumn("valid_until", SF.lit(None).cast("timestamp_ntz"))
    return union_candidates(local, placed, place)


def parse_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, conflicts) of external consolidation results: cluster, response."""
    parsed = rows.selectExpr("*", str(isolate_json(col("response")).alias("_j"))).withColumn(
        "_r", SF.from_json("_j", RECORD_JSON))
    keys = [c for c in rows.columns if c != "response"]
    one = parsed.selectExpr(
        *keys, f"posexplode(slice(_r.consolidated, 1, {V.MAX_OUTPUTS_PER_CLUSTER})) AS (pos, c)")
    c = col("c")
    scope = F.when(F.upper(c["scope"]).isin("USER", "PROJECT", "SESSION"),
                   F.lower(c["scope"])).otherwise("project")
    stability = F.when(F.lower(c["stability"]).isin(*V.STABILITY_LABELS),
                       F.lower(c["stability"])).otherwise("long-term")
    predicate = strip(_text(c["predicate"]))
    records = one.filter(str(predicate != "")).selectExpr(
        *keys, "pos", f"{F.lower(_text(c['type'], 'architecture'))} AS type",
        f"{scope} AS scope", f"{_text(c['subject'], 'project')} AS subject",
        f"{predicate} AS predicate", "c.value AS value",
        f"{F.when(_text(c['topicKey']) != '', c['topicKey']).otherwise(F.concat(scope, '.', predicate))} AS topic_key",
        f"{_clamped(c['confidence'], 0.8)} AS confidence",
        f"{_clamped(c['importance'], 0.9)} AS importance",
        f"{stability_score(stability)} AS stability",
        "coalesce(c.sourceMemoryIds, array()) AS source_ids")
    conflicts = parsed.selectExpr(*keys, "explode(_r.conflicts_detected) AS c").selectExpr(
        *keys, "c.memory_ids", "coalesce(c.description, '') AS description",
        "coalesce(c.resolution, '') AS resolution")
    return records, conflicts


def validated_candidates(messages: DataFrame, column: str = "validated") -> DataFrame:
    """Facts of a message as rows, for the candidate pipeline."""
    # The outer form, because a plain explode adds a filter on the array below it, which would
    # evaluate the rules again.
    return messages.selectExpr(
        "message_id", f"posexplode_outer({column}) AS (pos, fact)").filter(
        "pos is not null").selectExpr("message_id", "pos", *[f"fact.{n}" for n in (
            "entity", "attribute", "value", "type", "key", "scope", "state", "confidence",
            "raw_text", "metadata")])

