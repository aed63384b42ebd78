"""Registered queries: one per operator family, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import sql as X
from engram.functions.classify import (
    has_decision_marker, has_negation, is_correction_like, is_interrogative, is_low_info,
    is_noise, is_preference_noise, is_speculative, preference_domain, wants_history,
)
from engram.functions.sql import col
from engram.functions.text import (
    clean_value, content_hash, estimate_tokens, keywords, message_tokens, nfkc,
    normalize_text, normalize_utterance, ranked_keywords, redact, slugify,
)
from engram.functions import similarity
from engram.functions.extended import local_facts, memory_gate
from engram.operators import compile as compile_
from engram.operators import (
    consolidate, context, evaluate, external, extract, history, memory, rates, retrieve, select,
)
from engram.operators import messages as M
from engram.plans import incremental
from engram.plans import oracle as O
from engram.plans import pipeline as P
from engram.sources import tables as S
from engram.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


CONV = ("SELECT conv_id, turn, role, text FROM conversations")


# --- messages ----------------------------------------------------------------

@query("message_keys", """
SELECT conv_id AS user_id, CAST(turn AS INT) AS ordinal, role,
    sha256(to_json({role: role, content: text, ordinal: CAST(turn AS INT)})) AS content_hash,
    'hash:' || sha256(to_json({role: role, content: text, ordinal: CAST(turn AS INT)}))
    AS message_key FROM conversations""")
def message_keys(spark: SparkSession, sf: str) -> DataFrame:
    return M.normalize_messages(S.conversation_messages(spark, sf)).select(
        "user_id", "ordinal", "role", "content_hash", "message_key")


@query("token_estimates", f"""
SELECT 'conversations' AS source, conv_id AS id, CAST(turn AS INT) AS part,
    CAST({O.tokens('text')} AS BIGINT) AS tokens,
    CAST(3 + {O.tokens('text')} + {O.tokens('role')} + 1 AS BIGINT) AS message_tokens
    FROM conversations
UNION ALL SELECT 'documents', doc_id, 0, CAST({O.tokens('text')} AS BIGINT),
    CAST(3 + {O.tokens('text')} + {O.tokens('source')} + 1 AS BIGINT) FROM documents""")
def token_estimates(spark, sf):
    conv = S.table(spark, sf, "conversations").selectExpr(
        "'conversations' AS source", "conv_id AS id", "CAST(turn AS INT) AS part",
        f"{estimate_tokens(col('text'))} AS tokens",
        f"{message_tokens(col('text'), col('role'))} AS message_tokens")
    docs = S.table(spark, sf, "documents").selectExpr(
        "'documents' AS source", "doc_id AS id", "0 AS part",
        f"{estimate_tokens(col('text'))} AS tokens",
        f"{message_tokens(col('text'), col('source'))} AS message_tokens")
    return conv.unionByName(docs)


@query("message_gates", f"""
WITH {O.utterances()}, msgs AS (
    SELECT 'utterance' AS source, seq AS id, 0 AS part, role, content FROM utt
    UNION ALL SELECT 'conversation', conv_id, CAST(turn AS INT), role, text FROM conversations),
{O.gate('msgs')}
SELECT source, id, part, {O.low('content')} AND role IN ('user', 'assistant') AS low_info,
    {O.question('content')} AS interrogative, {O.m('content', O.V.SPECULATIVE)} AS speculative,
    {O.m('content', O.V.CORRECTION_MARKER)} AS correction_like,
    {O.m('content', O.V.DECISION_MARKER)} AS decision_marker,
    {O.m('content', O.V.NEGATION)} AS negated, {O.m('content', O.V.WANTS_HISTORY)} AS history,
    {O.noise('content')} AS noise, {O.noise_value('content')} AS preference_noise, skip_reason
FROM gated""")
def message_gates(spark, sf):
    said = P.archived_utterances(spark, sf).selectExpr(
        "'utterance' AS source", "seq AS id", "0 AS part", "role", "content")
    conv = S.table(spark, sf, "conversations").selectExpr(
        "'conversation' AS source", "conv_id AS id", "CAST(turn AS INT) AS part", "role",
        "text AS content")
    c = col("content")
    return extract.classify_messages(said.unionByName(conv)).selectExpr(
        "source", "id", "part", "low_info", "interrogative", "speculative",
        f"{is_correction_like(c)} AS correction_like",
        f"{has_decision_marker(c)} AS decision_marker", f"{has_negation(c)} AS negated",
        f"{wants_history(c)} AS history", f"{is_noise(c)} AS noise",
        f"{is_preference_noise(c)} AS preference_noise", "skip_reason")


FACT_COLUMNS = ("entity", "attribute", "value", "type", "key", "scope", "is_update")


@query("facts_utterances", f"""
WITH {O.utterances()}, plain AS (SELECT seq, content AS x FROM utt),
{O.facts_cte('plain')}
SELECT seq, CAST(pos AS INT) AS pos, entity, attribute, value, type, key, scope, is_update,
    preferred_over FROM kept""")
def facts_utterances(spark, sf):
    # The sentence gates apply here as they do in the full extraction.
    rows = extract.gated_facts(P.archived_utterances(spark, sf))
    return rows.selectExpr("seq", "posexplode_outer(facts) AS (pos, f)").filter(
        "f is not null").selectExpr(
        "seq", "pos", *[f"f.{c}" for c in FACT_COLUMNS],
        "coalesce(f.metadata['preferred_over'], '') AS preferred_over")


@query("facts_conversations", f"""
WITH plain AS (SELECT conv_id * 1000 + turn AS seq, text AS x FROM conversations),
{O.facts_cte('plain')}
SELECT seq, CAST(pos AS INT) AS pos, entity, attribute, value, type, key, scope, is_update
FROM kept""")
def facts_conversations(spark, sf):
    rows = S.table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS seq", "text AS content")
    return extract.gated_facts(rows).selectExpr(
        "seq", "posexplode_outer(facts) AS (pos, f)").filter("f is not null").selectExpr(
        "seq", "pos", *[f"f.{c}" for c in FACT_COLUMNS])


CANDIDATE_SQL = ("seq, CAST(pos AS INT) AS pos, cc AS content, type, topic_key, authority, "
                 "is_correction, confidence, importance, stability")


@query("candidates", f"""
WITH {O.utterances()}, {O.candidates_cte()}
SELECT {CANDIDATE_SQL}, coalesce(c_target, '') AS correction_target,
    coalesce(c_old, '') AS old_value, coalesce(c_new, '') AS new_value,
    coalesce(r_target, '') AS revocation_target, coalesce(r_value, '') AS revoked_value
FROM cand""")
def candidates(spark, sf):
    return extract.extract_candidates(P.archived_utterances(spark, sf)).selectExpr(
        "seq", "pos", "candidate_content AS content", "type", "topic_key", "authority",
        "is_correction", "confidence", "importance", "stability",
        "coalesce(correction.target, '') AS correction_target",
        "coalesce(correction.old_value, '') AS old_value",
        "coalesce(correction.new_value, '') AS new_value",
        "coalesce(revocation.target, '') AS revocation_target",
        "coalesce(revocation.value, '') AS revoked_value")


@query("routed_candidates", f"""
WITH {O.utterances()}, {O.routed_cte()}
SELECT seq, CAST(pos AS INT) AS pos, bucket, subject, predicate, val AS value,
    item_scope AS scope, CASE WHEN bucket = 'context' THEN context_key END AS context_key,
    CASE WHEN bucket = 'context' THEN CASE context_key WHEN 'current_error' THEN 3600
        ELSE 7200 END ELSE 0 END AS ttl_seconds FROM routed""")
def routed_candidates(spark, sf):
    return P.candidates_of(P.archived_utterances(spark, sf)).select(
        "seq", "pos", "bucket", "subject", "predicate", "value", "scope", "context_key",
        F.coalesce("ttl_seconds", F.lit(0)).alias("ttl_seconds"))


VERSIONS_SQL = f"""
WITH RECURSIVE {O.utterances()}, {O.memory_cte()}
SELECT item_id, user_id, type, topic_key, segment, version, content, subject, predicate, value,
    scope, confidence, importance, stability, source_count, started_seq, updated_seq,
    coalesce(ended_seq, -1) AS ended_seq, coalesce(end_status, 'active') AS status,
    coalesce(supersedes_id, '') AS supersedes_id FROM items"""


def _version_rows(versions: DataFrame) -> DataFrame:
    return versions.select(
        "item_id", "user_id", "type", "topic_key", "segment", "version", "content", "subject",
        "predicate", "value", "scope", "confidence", "importance", "stability", "source_count",
        "started_seq", "updated_seq", F.coalesce("ended_seq", F.lit(-1)).alias("ended_seq"),
        F.coalesce("end_status", F.lit("active")).alias("status"),
        F.coalesce("supersedes_id", F.lit("")).alias("supersedes_id"))


@query("memory_versions", VERSIONS_SQL)
def memory_versions(spark, sf):
    return _version_rows(P.utterance_versions(spark, sf))


@query("memory_versions_split", VERSIONS_SQL)
def memory_versions_split(spark, sf):
    """The same history with every user cut into parts and longer topics into chunks."""
    return _version_rows(history.apply_candidates(
        P.routed_utterances(spark, sf), hot_rows=4, chunk=512, hot_chain=4))


@query("memory_current", f"""
WITH RECURSIVE {O.utterances()}, {O.memory_cte()}
SELECT user_id, type, topic_key, version, content, value, confidence, stability, source_count
FROM items WHERE status = 'active'""")
def memory_current(spark, sf):
    return P.utterance_items(spark, sf).filter("status = 'active'").select(
        "user_id", "type", "topic_key", "version", "content", "value", "confidence",
        "stability", "source_count")


@query("memory_actions", f"""
WITH RECURSIVE {O.utterances()}, {O.memory_cte()}
SELECT user_id, s.seq, s.pos::INT AS pos,
    CASE act WHEN 'correct' THEN 'supersede' WHEN 'replace' THEN 'supersede' ELSE act END AS action,
    CASE act WHEN 'create' THEN 'new_topic' WHEN 'correct' THEN 'correction'
        WHEN 'replace' THEN 'topic_contradiction' WHEN 'merge' THEN 'near_duplicate'
        WHEN 'reject' THEN 'speculation' WHEN 'revoke' THEN 'revocation'
        ELSE 'no_revocation_target' END AS reason
FROM mem_log JOIN mem_steps s USING (user_id, rn)""")
def memory_actions(spark, sf):
    """What every durable candidate did to the memory."""
    return P.applied_utterances(spark, sf).actions()


@query("memory_lineage", f"""
WITH RECURSIVE {O.utterances()}, {O.memory_cte()}
SELECT f.item_id, f.user_id, m.seq, m.pos::INT AS pos
FROM mem_merged m JOIN final f ON f.user_id = m.user_id AND f.born = m.born""")
def memory_lineage(spark, sf):
    """The statements of every item, one row each."""
    return P.applied_utterances(spark, sf).lineage()


# --- sources, delta, archive -----------------------------------------------------

def _bodies(spark, sf) -> DataFrame:
    """Request bodies in every accepted shape, one per conversation turn."""
    said = F.to_json(F.struct("role", F.col("text").alias("content"),
                              F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id")))
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.expr("substring(_t, 6, length(_t) - 6)")
    rows = S.table(spark, sf, "conversations").withColumn("_s", said).withColumn("_t", text)
    body = (F.when(F.col("turn") % 4 == 0, F.concat(F.lit('{"messages":['), "_s", F.lit("]}")))
            .when(F.col("turn") % 4 == 1, F.concat(F.lit('{"input":['), quoted, F.lit(","), "_s",
                                                   F.lit("]}")))
            .when(F.col("turn") % 4 == 2, F.concat(F.lit('{"input":'), quoted, F.lit("}")))
            .otherwise(F.lit('{"model":"m"}')))
    return rows.select(F.concat("conv_id", F.lit("/"), "turn").alias("request_id"),
                       F.col("conv_id").alias("user_id"), body.alias("body"))


@query("request_messages", """
WITH base AS (SELECT conv_id || '/' || turn AS request_id, conv_id AS user_id, turn, role, text,
    'id:c' || conv_id || '-' || turn AS key FROM conversations)
SELECT request_id, user_id, 0 AS ordinal, role, text AS content, key AS message_key
    FROM base WHERE turn % 4 = 0
UNION ALL SELECT request_id, user_id, 0, 'user', text, 'hash:' ||
    sha256(to_json({role: 'user', content: text, ordinal: 0})) FROM base WHERE turn % 4 IN (1, 2)
UNION ALL SELECT request_id, user_id, 1, role, text, key FROM base WHERE turn % 4 = 1""")
def request_messages(spark, sf):
    return M.normalize_messages(M.request_messages(_bodies(spark, sf))).select(
        "request_id", "user_id", "ordinal", "role", "content", "message_key")


@query("request_tokens", f"""
WITH t AS (SELECT *, {O.tokens('text')} AS n, {O.tokens('role')} AS r FROM conversations)
SELECT conv_id || '/' || turn AS request_id, CAST(3 + CASE turn % 3 WHEN 0 THEN n + r + 1
    WHEN 1 THEN n + r ELSE n + r + n + 3 END AS BIGINT) AS tokens FROM t""")
def request_tokens(spark, sf):
    """Tokens of messages with a name, with a list of parts, and with a tool call."""
    text = F.col("text")
    part = F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))
    call = F.struct(F.struct(F.col("role").alias("name"), text.alias("arguments")).alias("function"))
    said = S.table(spark, sf, "conversations").select(
        F.concat("conv_id", F.lit("/"), "turn").alias("request_id"),
        F.col("conv_id").alias("user_id"),
        F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(
            "role", text.alias("content"), F.col("role").alias("name"))))
        .when(F.col("turn") % 3 == 1, F.concat(
            F.lit('{"role":"user","content":['),
            F.expr("substring(to_json(struct(text AS t)), 6, length(to_json(struct(text AS t))) - 6)"),
            F.lit(","), F.to_json(part), F.lit("]}")))
        .otherwise(F.to_json(F.struct("role", text.alias("content"), F.array(call)
                                      .alias("tool_calls")))).alias("message"))
    rows = M.request_messages(said.select("request_id", "user_id", F.concat(
        F.lit('{"messages":['), "message", F.lit("]}")).alias("body")))
    cost = message_tokens(col("content"), col("name"), col("tool_call_id"), col("tool_calls"),
                          col("content_parts"))
    return rows.selectExpr("request_id", f"{cost} AS tokens")


@query("archive_ingest", """
WITH said AS (SELECT conv_id AS user_id, count(*) FILTER (turn % 4 <> 3)
    + count(*) FILTER (turn % 4 = 1) AS n FROM conversations GROUP BY 1)
SELECT user_id, n AS first_new, 0 AS second_new, n AS archived FROM said WHERE n > 0""")
def archive_ingest(spark, sf):
    """The same bodies, each delivered twice, ingested twice: the second time nothing is new."""
    bodies = _bodies(spark, sf).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return P.ingest_twice(bodies.unionByName(bodies))


def _resent(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Batch: the utterances, each view event sent twice.  Archive: the signups."""
    said = P.archived_utterances(spark, sf).join(
        S.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq")
    keyed = said.withColumn("message_key", F.md5(F.concat_ws("|", "role", "content")))
    copies = keyed.withColumn("copy", F.explode(F.when(
        F.col("event_type") == "view", F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))))
    return copies, keyed.filter("event_type = 'signup'")


DELTA_SQL = f"""
WITH {O.utterances()}, keyed AS (SELECT u.*, event_type, md5(u.role || '|' || u.content)
    AS message_key FROM utt u JOIN events e ON e.event_id = u.seq),
batch AS (SELECT *, 0 AS copy FROM keyed UNION ALL SELECT *, 1 FROM keyed
    WHERE event_type = 'view'),
arch AS (SELECT DISTINCT user_id, message_key FROM keyed WHERE event_type = 'signup'),
delta AS (SELECT b.*, CASE WHEN a.user_id IS NULL AND row_number() OVER (
    PARTITION BY b.user_id, b.message_key ORDER BY seq, copy) = 1 THEN 'new' ELSE 'duplicate' END
    AS delta_status FROM batch b LEFT JOIN arch a ON a.user_id = b.user_id
    AND a.message_key = b.message_key)"""


@query("message_delta", DELTA_SQL + """
SELECT user_id, seq, copy, message_key, delta_status FROM delta""")
def message_delta(spark, sf):
    batch, archive = _resent(spark, sf)
    return M.detect_delta(batch, archive.distinct(), ("seq", "copy")).select(
        "user_id", "seq", "copy", "message_key", "delta_status")


@query("delta_counts", DELTA_SQL + """
SELECT user_id, count(*) AS total, count(*) FILTER (delta_status = 'new') AS new,
    count(*) FILTER (delta_status = 'duplicate') AS duplicate FROM delta GROUP BY user_id""")
def delta_counts(spark, sf):
    batch, archive = _resent(spark, sf)
    return M.delta_counts(M.detect_delta(batch, archive.distinct(), ("seq", "copy")))


@query("new_users", """
SELECT user_id, min(event_id) AS first_seq FROM events WHERE user_id NOT IN (
    SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 20 = 0)
GROUP BY user_id""")
def new_users(spark, sf):
    events = S.table(spark, sf, "events")
    known = events.filter("event_type = 'signup' and event_id % 20 = 0").select(
        "user_id").distinct()
    return M.new_users(events, known, "event_id").withColumnRenamed("created_at", "first_seq")


@query("meaningful_batches", f"""
WITH {O.utterances()} SELECT user_id, seq // 100 AS batch, bool_or(role IN ('user', 'assistant')
    AND NOT {O.low('content')}) AS meaningful FROM utt GROUP BY ALL""")
def meaningful_batches(spark, sf):
    said = extract.classify_messages(P.archived_utterances(spark, sf)).withColumn(
        "batch", F.floor(F.col("seq") / 100))
    return M.meaningful_batches(said, "batch")


# --- text ------------------------------------------------------------------------

@query("keywords", f"""
WITH w AS (SELECT conv_id, turn, u.i, u.w FROM (SELECT conv_id, turn,
    {O.keyword_list('text')} AS k FROM conversations), LATERAL (SELECT unnest(k) AS w,
    generate_subscripts(k, 1) AS i) u),
d AS (SELECT conv_id, turn, w, min(i) AS i FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(w) DESC, w) AS rk
    FROM d)
SELECT c.conv_id, c.turn, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words,
    coalesce(string_agg(w, ' ' ORDER BY rk) FILTER (rk <= 12), '') AS top_words
FROM conversations c LEFT JOIN r USING (conv_id, turn) GROUP BY ALL""")
def conversation_keywords(spark, sf):
    rows = S.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", f"{keywords(col('text'))} AS k")
    return rows.selectExpr("conv_id", "turn", "array_join(k, ' ') AS words",
                           f"array_join({ranked_keywords(col('k'))}, ' ') AS top_words")


def _redact_sql(x: str) -> str:
    for pattern, to in O.V.SECRET_MASKS:
        plain = pattern.replace("(?i)", "")
        x = (f"regexp_replace({x}, {O.q(plain)}, {O.q(to.replace('$1', chr(92) + '1'))}, "
             f"'{'ig' if '(?i)' in pattern else 'g'}')")
    return x


@query("redacted_documents", f"""
SELECT doc_id, sha256({_redact_sql('text')}) AS digest, {_redact_sql('text')} <> text AS changed
FROM documents""")
def redacted_documents(spark, sf):
    rows = S.table(spark, sf, "documents").selectExpr(
        "doc_id", "text", f"{redact(col('text'))} AS masked")
    return rows.selectExpr("doc_id", "sha2(masked, 256) AS digest", "masked <> text AS changed")


def _normal_sql(x: str) -> str:
    out = f"nfc_normalize({x})"
    out = (f"translate({out}, '{O.V.APOSTROPHES}{O.V.DOUBLE_QUOTES}', "
           f"{O.q(chr(39) * len(O.V.APOSTROPHES) + chr(34) * len(O.V.DOUBLE_QUOTES))})")
    for short, full in O.V.CONTRACTIONS:
        for a, b in ((short, full), (short.capitalize(), full.capitalize())):
            out = f"replace({out}, {O.q(a)}, {O.q(b)})"
    for mark in ".!?":
        out = O.sub(out, f"[{mark}]{{2,}}", mark, "g")
    return "lower(" + O.strip(O.sub(out, r"\s+", " ", "g")) + ")"


@query("normalized_text", f"""
WITH {O.utterances()}, t AS (SELECT seq, content FROM utt UNION ALL
    SELECT -1 - (conv_id * 1000 + turn), text FROM conversations)
SELECT seq, {O.norm('content')} AS utterance, {_normal_sql('content')} AS normal,
    {O.slug('content')} AS slug, {O.clean('content')} AS cleaned,
    {O.domain('content')} AS domain,
    sha256(to_json({{role: 'user', content: content}})) AS hash FROM t""")
def normalized_text(spark, sf):
    said = P.archived_utterances(spark, sf).select("seq", "content").unionByName(
        S.table(spark, sf, "conversations").selectExpr(
            "-1 - (conv_id * 1000 + turn) AS seq", "text AS content"))
    rows = said.withColumn("plain", nfkc("content"))
    c, p = col("content"), col("plain")
    return rows.selectExpr(
        "seq", f"{normalize_utterance(p)} AS utterance", f"{normalize_text(p)} AS normal",
        f"{slugify(c)} AS slug", f"{clean_value(c)} AS cleaned",
        f"{preference_domain(c)} AS domain", f"{content_hash(X.lit('user'), c)} AS hash")


# --- short-term context ------------------------------------------------------------

CONTEXT_SQL = f"""
WITH {O.utterances()}, {O.routed_cte()},
ctx AS (SELECT user_id, context_key AS key, cc AS value, CASE context_key WHEN 'current_error'
    THEN 3600 ELSE 7200 END AS ttl, seq, pos, ts FROM routed WHERE bucket = 'context'),
bound AS (SELECT max(ts) AS t FROM utt),
lastset AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, seq DESC,
    pos DESC) AS rn FROM ctx)"""


@query("context_as_of", CONTEXT_SQL + """
SELECT user_id, key, value, seq, CAST(floor(ttl - (epoch_us(t) - epoch_us(ts)) / 1e6 + 0.5)
    AS BIGINT) AS seconds_left FROM lastset, bound
WHERE rn = 1 AND ttl - (epoch_us(t) - epoch_us(ts)) / 1e6 > 0""")
def context_now(spark, sf):
    end = P.archived_utterances(spark, sf).agg(F.max("ts").alias("t")).first()["t"]
    return context.context_as_of(context.context_log(P.routed_utterances(spark, sf)), end)


@query("context_overwrites", CONTEXT_SQL + """
SELECT user_id, key, count(*) AS writes, arg_max(value, (ts, seq, pos)) AS value FROM ctx
GROUP BY ALL""")
def context_overwrites(spark, sf):
    log = context.context_log(P.routed_utterances(spark, sf))
    return log.groupBy("user_id", "key").agg(
        F.count("*").alias("writes"),
        F.max_by("value", F.struct("ts", "seq", "pos")).alias("value"))


# --- memory ------------------------------------------------------------------------

MEMORY_SQL = f"WITH RECURSIVE {O.utterances()}, {O.memory_cte()}"


@query("memory_as_of", MEMORY_SQL + """, bound AS (SELECT max(seq) // 2 AS t FROM utt)
SELECT item_id, version, content, CASE WHEN ended_seq IS NULL OR ended_seq > t THEN 'active'
    ELSE end_status END AS status FROM final, bound WHERE started_seq <= t""")
def memory_at_half(spark, sf):
    half = P.archived_utterances(spark, sf).agg((F.max("seq") / 2).cast("long")).first()[0]
    return memory.memory_as_of(P.utterance_versions(spark, sf), half).select(
        "item_id", "version", "content", "status")


@query("corrections_audit", MEMORY_SQL + """
SELECT n.user_id, n.item_id, n.supersedes_id, CASE WHEN n.c_target IS NOT NULL THEN n.c_target
    ELSE n.topic_key END AS target, CASE WHEN n.c_target IS NOT NULL THEN n.c_old ELSE o.content
    END AS old_value, CASE WHEN n.c_target IS NOT NULL THEN n.c_new ELSE n.content END
    AS new_value, n.started_seq FROM final n JOIN final o ON o.item_id = n.supersedes_id
WHERE n.is_correction""")
def corrections_audit(spark, sf):
    return memory.corrections_audit(P.utterance_versions(spark, sf))


@query("snapshots", MEMORY_SQL + """
SELECT user_id, """ + ", ".join(
    f"count(*) FILTER (type = '{t}') AS \"{n}\"" for t, n in O.V.SNAPSHOT_LISTS.items()) + """
FROM items WHERE status = 'active' AND content <> '' GROUP BY user_id""")
def snapshots(spark, sf):
    return memory.snapshots(P.utterance_items(spark, sf))


@query("snapshot_entries", MEMORY_SQL + f"""
SELECT user_id, {O.lookup('type', O.V.SNAPSHOT_LISTS)} AS list, started_seq,
    CAST(s_at[2] AS INT) AS started_pos, content FROM items WHERE status = 'active'""")
def snapshot_entries(spark, sf):
    return memory.snapshot_lists(P.utterance_items(spark, sf))


@query("action_counts", MEMORY_SQL + """,
made AS (SELECT user_id, count(*) FILTER (supersedes_id IS NULL) AS created,
    count(*) FILTER (supersedes_id IS NOT NULL) AS superseded, sum(source_count - 1) AS merged,
    count(*) FILTER (end_status = 'revoked') AS revoked FROM final GROUP BY user_id),
routes AS (SELECT user_id, count(*) AS candidates, count(*) FILTER (bucket = 'store') AS stored,
    count(*) FILTER (bucket = 'context') AS context, count(*) FILTER (bucket = 'discard')
    AS discarded FROM routed GROUP BY user_id)
SELECT k.*, coalesce(created, 0) AS created, coalesce(superseded, 0) AS superseded,
    CAST(coalesce(merged, 0) AS BIGINT) AS merged, coalesce(revoked, 0) AS revoked,
    coalesce(created + superseded + merged + revoked, 0) > 0 AS memory_changed
FROM routes k LEFT JOIN made USING (user_id)""")
def action_counts(spark, sf):
    return memory.action_counts(P.utterance_versions(spark, sf), P.routed_utterances(spark, sf))


@query("information_scores", MEMORY_SQL + """
SELECT item_id, information_gain FROM final""")
def information_scores(spark, sf):
    return P.utterance_versions(spark, sf).select("item_id", "information_gain")


@query("obsolete_items", MEMORY_SQL + f"""
, said AS (SELECT DISTINCT user_id, lower(trim(content)) AS d FROM utt
    WHERE seq IN (SELECT event_id FROM events WHERE event_type = 'error') AND role = 'user')
SELECT DISTINCT i.user_id, i.item_id FROM items i JOIN said s ON s.user_id = i.user_id
WHERE status = 'active' AND (contains(d, lower(i.content)) OR contains(lower(i.content), d)
    OR (topic_key <> '' AND contains(d, lower(topic_key))))""")
def obsolete_items(spark, sf):
    errors = S.table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("seq"))
    said = P.archived_utterances(spark, sf).filter("role = 'user'").join(
        errors, "seq", "left_semi").select("user_id", F.col("content").alias("description"))
    return memory.obsolete_items(P.utterance_items(spark, sf), said)


@query("version_proposals", """
WITH cur AS (SELECT user_id AS item, count(*) % 7 AS version FROM events GROUP BY user_id),
prop AS (SELECT event_id AS seq, user_id AS item, event_id % 7 AS expected_version FROM events)
SELECT p.*, CASE WHEN expected_version = version AND row_number() OVER (
    PARTITION BY p.item, expected_version = version ORDER BY seq) = 1 THEN 'accepted'
    ELSE 'conflict' END AS outcome FROM prop p JOIN cur USING (item)""")
def version_proposals(spark, sf):
    events = S.table(spark, sf, "events")
    current = events.groupBy(F.col("user_id").alias("item_id")).agg(
        (F.count("*") % 7).alias("version"))
    proposals = events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"),
        (F.col("event_id") % 7).alias("expected_version"))
    return memory.accept_proposals(current, proposals).withColumnRenamed("item_id", "item")


@query("resolved_topics", MEMORY_SQL + """
SELECT user_id, item_id, status FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, trim(topic_key) ORDER BY status = 'active' DESC, version DESC,
    updated_seq DESC, item_id DESC) AS rn FROM items) WHERE rn = 1""")
def resolved_topics(spark, sf):
    return memory.resolve_conflicts(P.utterance_items(spark, sf)).select(
        "user_id", "item_id", "status")


@query("next_snapshot_versions", """
SELECT c.c_custkey AS user_id, coalesce(max(o_orderkey), 0) + 1 AS version
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def next_snapshot_versions(spark, sf):
    users = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    written = S.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("version"))
    return memory.next_versions(users, written)


# --- retrieval ---------------------------------------------------------------------

@query("retrieve_recent", MEMORY_SQL + """
SELECT user_id, item_id, CAST(rn AS INT) AS rank, status = 'active' AS current FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_seq DESC, item_id) AS rn
    FROM items WHERE status = 'active') WHERE rn <= 20""")
def retrieve_recent(spark, sf):
    return retrieve.retrieve(P.utterance_items(spark, sf), retrieve.Query()).select(
        "user_id", "item_id", "rank", "current")


@query("retrieve_filtered", MEMORY_SQL + """
SELECT user_id, item_id, CAST(rn AS INT) AS rank, status = 'active' AS current FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, updated_seq DESC,
        item_id) AS rn FROM items WHERE scope = 'project' AND confidence >= 0.8
    AND importance >= 0.6 AND stability >= 0.5 AND (contains(lower(content), 'neon')
        OR contains(lower(value), 'neon') OR contains(lower(predicate), 'neon')
        OR contains(lower(subject), 'neon') OR contains(lower(topic_key), 'neon')
        OR contains(lower(content), 'budget') OR contains(lower(value), 'budget')
        OR contains(lower(predicate), 'budget') OR contains(lower(subject), 'budget')
        OR contains(lower(topic_key), 'budget'))) WHERE rn <= 5""")
def retrieve_filtered(spark, sf):
    return retrieve.retrieve(P.utterance_items(spark, sf), retrieve.Query(
        scope="project", include_historical=True, keywords=("neon", "budget", "x"),
        min_confidence=0.8, min_importance=0.6, min_stability=0.5, order="importance",
        limit=5)).select("user_id", "item_id", "rank", "current")


@query("search_messages", """
SELECT user_id, ordinal, content, CAST(rn AS INT) AS rank, 1.0::DOUBLE AS score FROM (
    SELECT conv_id AS user_id, CAST(turn AS INT) AS ordinal, text AS content, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE contains(text, 'the'))
WHERE rn <= 10""")
def search_messages(spark, sf):
    return retrieve.search(S.conversation_messages(spark, sf), "content", " the ", "ordinal"
                           ).select("user_id", "ordinal", "content", "rank", "score")


@query("expand_relations", MEMORY_SQL + """,
seeds AS (SELECT * FROM items WHERE status = 'active'),
h1 AS (SELECT DISTINCT s.user_id, s.supersedes_id AS item_id FROM seeds s
    WHERE supersedes_id IS NOT NULL AND supersedes_id NOT IN (SELECT item_id FROM seeds)),
h2 AS (SELECT DISTINCT i.user_id, i.supersedes_id AS item_id FROM h1 JOIN items i USING (item_id)
    WHERE i.supersedes_id IS NOT NULL AND i.supersedes_id NOT IN (SELECT item_id FROM seeds)
    AND i.supersedes_id NOT IN (SELECT item_id FROM h1))
SELECT item_id, content, 1 AS hop FROM h1 JOIN items USING (item_id)
UNION ALL SELECT item_id, content, 2 FROM h2 JOIN items USING (item_id)""")
def expand_relations(spark, sf):
    items = P.utterance_items(spark, sf)
    return retrieve.expand_relations(items, items.filter("status = 'active'"), depth=2,
                                     active_only=False).select("item_id", "content", "hop")


# --- requests --------------------------------------------------------------------
# Requests: every view event asks with a system message, and every conversation is the
# request of one of the users.

REQUESTS_SQL = MEMORY_SQL + f""",
rm AS (SELECT event_id AS request_id, user_id, 0 AS ordinal, 'system' AS role,
        'You help user ' || user_id || '.' AS content FROM events WHERE event_type = 'view'
    UNION ALL SELECT seq, u.user_id, 1, 'user', content FROM utt u JOIN events e
        ON e.event_id = u.seq WHERE event_type = 'view'
    UNION ALL SELECT 1000000000 + conv_id, conv_id % (SELECT max(user_id) + 1 FROM events),
        CAST(turn AS INT), role, text FROM conversations),
rq0 AS (SELECT request_id, any_value(user_id) AS user_id, count(*) AS message_count,
    CAST(sum(3 + {O.tokens('content')}) + 3 AS BIGINT) AS input_tokens,
    coalesce(arg_max(content, ordinal) FILTER (role = 'user'), '') AS latest
    FROM rm GROUP BY request_id),
rq1 AS (SELECT *, list_distinct({O.keyword_list('latest')}) AS qw,
    {O.m('latest', O.V.WANTS_HISTORY)} AS wants_history FROM rq0),
rq AS (SELECT *, list_slice(list_transform(list_sort(list_transform(qw, lambda w:
    {{n: -length(w), w: w}})), lambda s: s.w), 1, 12) AS ranked FROM rq1),
act AS (SELECT *, lower(concat_ws(chr(10), content, value, predicate, subject, topic_key)) AS hay
    FROM items WHERE status = 'active'),
hits0 AS (SELECT r.request_id, a.user_id, a.item_id, row_number() OVER (PARTITION BY r.request_id
        ORDER BY a.updated_seq DESC, a.item_id) AS rn FROM rq r JOIN act a
    ON a.user_id = r.user_id AND (len(ranked) = 0 OR len(list_filter(ranked, lambda w:
        contains(a.hay, w))) > 0)),
t1 AS (SELECT request_id, user_id, item_id, 1 AS tier FROM hits0 WHERE rn <= 40),
newest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_seq DESC, item_id)
    AS rn FROM act),
t2 AS (SELECT r.request_id, n.user_id, n.item_id, 2 FROM rq r JOIN newest n ON n.user_id =
    r.user_id AND rn <= 20 WHERE (SELECT count(*) FROM t1 WHERE t1.request_id = r.request_id) < 4),
dur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_seq DESC,
    item_id) AS rn FROM act WHERE scope = 'user') WHERE rn <= 40
    AND type IN ('fact', 'preference', 'constraint')),
t3 AS (SELECT r.request_id, d.user_id, d.item_id, 3 FROM rq r JOIN dur d ON d.user_id = r.user_id),
fetched AS (SELECT request_id, user_id, item_id, min(tier) AS tier FROM (
    SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) GROUP BY ALL),
linked0 AS (SELECT DISTINCT f.request_id, f.user_id, i.supersedes_id AS item_id FROM fetched f
    JOIN items i ON i.item_id = f.item_id WHERE i.supersedes_id IS NOT NULL),
linked1 AS (SELECT l.*, row_number() OVER (PARTITION BY l.request_id ORDER BY i.updated_seq DESC,
    l.item_id) AS rn FROM linked0 l JOIN items i ON i.item_id = l.item_id JOIN rq r
    ON r.request_id = l.request_id WHERE (r.wants_history OR i.status = 'active')
    AND NOT EXISTS (SELECT 1 FROM fetched f WHERE f.request_id = l.request_id
        AND f.item_id = l.item_id)),
merged AS (SELECT * FROM fetched UNION ALL SELECT request_id, user_id, item_id, 4 FROM linked1
    WHERE rn <= 20),
chosen0 AS (SELECT m.request_id, m.tier, i.*, r.wants_history, r.qw, row_number() OVER (
    PARTITION BY m.request_id, CASE WHEN trim(i.topic_key) = '' THEN i.item_id
        ELSE trim(i.topic_key) END ORDER BY i.status = 'active' DESC, i.version DESC,
        i.updated_seq DESC, i.item_id) AS rn FROM merged m JOIN items i ON i.item_id = m.item_id
    JOIN rq r ON r.request_id = m.request_id),
chosen AS (SELECT * FROM chosen0 WHERE rn = 1 OR (wants_history AND status = 'superseded'))"""


def _requests(spark, sf) -> DataFrame:
    views = P.archived_utterances(spark, sf).join(
        S.table(spark, sf, "events").filter("event_type = 'view'").select(
            F.col("event_id").alias("seq")), "seq", "left_semi")
    asked = views.select(
        F.col("seq").alias("request_id"), "user_id", F.explode(F.array(
            F.struct(F.lit(0).alias("ordinal"), F.lit("system").alias("role"), F.concat(
                F.lit("You help user "), F.col("user_id"), F.lit(".")).alias("content")),
            F.struct(F.lit(1).alias("ordinal"), F.lit("user").alias("role"), "content")
        )).alias("m")).select("request_id", "user_id", "m.*")
    users = S.table(spark, sf, "events").agg(F.max("user_id")).first()[0] + 1
    # A few files hold the conversations; their long texts are scored message by message.
    talked = S.spread(S.table(spark, sf, "conversations")).select(
        (F.lit(1000000000) + F.col("conv_id")).cast("long").alias("request_id"),
        (F.col("conv_id") % users).alias("user_id"), F.col("turn").cast("int").alias("ordinal"),
        "role", F.col("text").alias("content"))
    return asked.unionByName(talked)


def _asked(spark, sf) -> DataFrame:
    return P.once(spark, sf, "request_messages", lambda: _requests(spark, sf))


def _prepared(spark, sf) -> DataFrame:
    return P.once(spark, sf, "requests", lambda: compile_.prepare_requests(_asked(spark, sf)))


def _known(spark, sf) -> DataFrame:
    return compile_.memory_items(_prepared(spark, sf), P.utterance_items(spark, sf))


@query("fetched_memories", REQUESTS_SQL + """
SELECT request_id, item_id, tier FROM fetched""")
def fetched_memories(spark, sf):
    return retrieve.fetch_tiers(_prepared(spark, sf), P.utterance_items(spark, sf)).select(
        "request_id", "item_id", "tier")


@query("request_memories", REQUESTS_SQL + """
SELECT request_id, item_id, tier, status FROM chosen""")
def request_memories(spark, sf):
    return retrieve.memories_for_requests(_prepared(spark, sf), P.utterance_items(spark, sf)).select(
        "request_id", "item_id", "tier", "status")


@query("request_facts", REQUESTS_SQL + """
SELECT request_id, user_id, message_count, input_tokens, latest, len(qw) AS words,
    array_to_string(ranked, ' ') AS top_words, wants_history FROM rq""")
def request_facts(spark, sf):
    return compile_.prepare_requests(_requests(spark, sf)).selectExpr(
        "request_id", "user_id", "message_count", "input_tokens",
        "coalesce(latest_user_text, '') AS latest", "CAST(size(query_words) AS BIGINT) AS words",
        "array_join(ranked_words, ' ') AS top_words", "wants_history")


def _relevance_sql(words: str, query_words: str) -> str:
    shared = f"len(list_intersect({query_words}, {words}))"
    return (f"CASE WHEN len({query_words}) = 0 THEN 0.5::DOUBLE WHEN len({words}) = 0 THEN "
            f"0.3::DOUBLE WHEN {shared} = 0 THEN 0.25::DOUBLE ELSE least(1.0::DOUBLE, "
            f"0.4::DOUBLE + {shared} / len({query_words}) * 0.6::DOUBLE) END")


SCORE_SQL = ("round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.25::DOUBLE * relevance + "
             "0.25::DOUBLE * importance + 0.2::DOUBLE * freshness + 0.1::DOUBLE * confidence + "
             "0.1::DOUBLE * stability + 0.1::DOUBLE * gain)), 4)")

MESSAGE_SCORES_SQL = REQUESTS_SQL + f""",
ms0 AS (SELECT m.*, r.qw, max(ordinal) OVER (PARTITION BY m.request_id) - ordinal AS turns,
    {O.low('content')} AS ack, {O.m('content', O.V.DECISION_MARKER)} AS decided,
    list_distinct({O.keyword_list('content')}) AS kw FROM rm m JOIN rq r USING (request_id)),
ms1 AS (SELECT *, role = 'system' AS sys, turns = 0 AS latest, {_relevance_sql('kw', 'qw')}
    AS rel, CASE WHEN turns <= 3 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS imp,
    CASE WHEN role = 'user' THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS sta FROM ms0),
ms AS (SELECT *, CASE WHEN sys THEN 'system' WHEN latest THEN 'new_message' ELSE 'message' END
    AS kind, sys OR latest AS mandatory, CASE WHEN sys THEN 0.8::DOUBLE WHEN latest THEN 1
        ELSE rel END AS relevance,
    CASE WHEN sys OR latest THEN 1 WHEN role = 'user' THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END
    AS confidence, CASE WHEN sys OR latest THEN 1 WHEN ack THEN 0.05::DOUBLE WHEN decided
        THEN greatest(imp, 0.92::DOUBLE) ELSE imp END AS importance,
    CASE WHEN sys OR latest THEN 1 ELSE greatest(0.2::DOUBLE, 1.0::DOUBLE - turns * 0.08::DOUBLE)
    END AS freshness, CASE WHEN sys THEN 1 WHEN latest THEN 0.9::DOUBLE WHEN ack THEN 0.1::DOUBLE
        WHEN decided THEN greatest(sta, 0.9::DOUBLE) ELSE sta END AS stability,
    CASE WHEN sys THEN 0.9::DOUBLE WHEN latest THEN 0.95::DOUBLE WHEN ack THEN 0.05::DOUBLE
        WHEN turns <= 2 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS gain,
    CAST(3 + {O.tokens('content')} AS BIGINT) AS token_cost FROM ms1)"""


@query("message_scores", MESSAGE_SCORES_SQL + f"""
SELECT request_id, ordinal, kind, mandatory, token_cost, round(relevance, 6) AS relevance,
    importance, round(freshness, 6) AS freshness, {SCORE_SQL} AS score FROM ms""")
def message_scores(spark, sf):
    return compile_.message_items(_asked(spark, sf), _prepared(spark, sf)).select(
        "request_id", "ordinal", "kind", "mandatory", "token_cost",
        F.round("relevance", 6).alias("relevance"), "importance",
        F.round("freshness", 6).alias("freshness"), "score")


MEMORY_SCORES_SQL = REQUESTS_SQL + f""",
gains AS (SELECT item_id, information_gain AS gain FROM final),
mk AS (SELECT c.*, g.gain, list_distinct({O.keyword_list('content')}) AS kw,
    list_distinct({O.keyword_list("regexp_replace(topic_key, '[._-]', ' ', 'g')")}) AS tt,
    list_distinct({O.keyword_list('topic_key')}) AS tk, 1.0::DOUBLE AS freshness
    FROM chosen c JOIN gains g ON g.item_id = c.item_id),
mr0 AS (SELECT *, {_relevance_sql('kw', 'qw')} AS base, CASE WHEN
    len(list_intersect(qw, tt)) > 0 THEN {_relevance_sql('tk', 'qw')} ELSE 0 END AS bonus,
    scope = 'user' AND type IN ('preference', 'fact', 'constraint') AS durable FROM mk),
mr1 AS (SELECT *, CASE WHEN topic_key <> '' THEN greatest(base, least(1.0::DOUBLE,
    0.5::DOUBLE + bonus * 0.5::DOUBLE)) ELSE base END AS topical FROM mr0),
mr2 AS (SELECT *, CASE WHEN durable THEN greatest(topical, 0.55::DOUBLE) ELSE topical END AS kept
    FROM mr1),
mem AS (SELECT *, CASE WHEN status = 'superseded' THEN greatest(0.35::DOUBLE,
    kept * 0.85::DOUBLE) ELSE kept END AS relevance, durable AND status = 'active' AS mandatory,
    CAST({O.tokens("(type || ': ' || content)")} + 2 AS BIGINT) AS token_cost FROM mr2)"""


@query("memory_scores", MEMORY_SCORES_SQL + f"""
SELECT request_id, item_id, mandatory, token_cost, round(relevance, 6) AS relevance,
    {SCORE_SQL} AS score FROM mem""")
def memory_scores(spark, sf):
    return _known(spark, sf).select(
        "request_id", "item_id", "mandatory", "token_cost",
        F.round("relevance", 6).alias("relevance"), "score")


LINE_SQL = """
mline AS (SELECT *, CASE WHEN status = 'superseded' THEN '(previous) ' WHEN status = 'revoked'
        THEN '(revoked) ' ELSE '' END || CASE WHEN trim(predicate) <> '' AND trim(value) <> '' THEN
    CASE WHEN predicate LIKE 'disliked\\_%' ESCAPE '\\' THEN 'dislikes ' ||
        replace(substr(trim(predicate), 10), '_', ' ') || ': ' || trim(value)
    WHEN predicate LIKE 'favorite\\_%' ESCAPE '\\' OR predicate LIKE 'preferred\\_%' ESCAPE '\\'
        OR type = 'preference' OR trim(content) = trim(value)
        THEN replace(trim(predicate), '_', ' ') || ': ' || trim(value)
    ELSE content END ELSE content END AS line,
    array_to_string(list_transform(string_split(type, '_'), lambda w: upper(substr(w, 1, 1))
        || substr(w, 2)), ' ') AS category,
    row_number() OVER (PARTITION BY request_id ORDER BY tier, updated_seq DESC, item_id) AS ord
    FROM mem),
mcat AS (SELECT request_id, category, '• ' || category || ':' || chr(10) ||
    string_agg('  - ' || line, chr(10) ORDER BY ord) AS part FROM mline GROUP BY request_id, category),
mblock AS (SELECT request_id, '[Project Memory & Canonical State]' || chr(10) ||
    string_agg(part, chr(10) ORDER BY category) AS memory_text FROM mcat GROUP BY request_id)"""


@query("memory_blocks", MEMORY_SCORES_SQL + "," + LINE_SQL + """
SELECT request_id, memory_text FROM mblock""")
def memory_blocks(spark, sf):
    return compile_.memory_blocks(_known(spark, sf))


# With the default budget every request of the tables fits, so plain SQL can assemble it.
COMPILED_SQL = MEMORY_SCORES_SQL + "," + LINE_SQL + """,
ctx AS (SELECT user_id, context_key AS key, cc AS value, CASE context_key WHEN 'current_error'
    THEN 3600 ELSE 7200 END AS ttl, seq, pos, ts FROM routed WHERE bucket = 'context'),
bound AS (SELECT max(ts) AS t FROM utt),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC,
    seq DESC, pos DESC) AS rn FROM ctx), bound WHERE rn = 1
    AND ttl - (epoch_us(t) - epoch_us(ts)) / 1e6 > 0),
st AS (SELECT user_id, '[Short-Term Context (current state)]' || chr(10) || string_agg('• ' || key
    || ': ' || value, chr(10) ORDER BY seq, key) AS short_text, count(*) AS n FROM live
    GROUP BY user_id),
cnt AS (SELECT request_id, count(*) AS n FROM mem GROUP BY request_id),
rs AS (SELECT r.request_id, r.user_id, r.input_tokens, r.message_count, coalesce(c.n, 0) AS mem_n,
    coalesce(st.n, 0) AS st_n, short_text, memory_text FROM rq r LEFT JOIN cnt c
    ON c.request_id = r.request_id LEFT JOIN st ON st.user_id = r.user_id LEFT JOIN mblock b
    ON b.request_id = r.request_id),
body AS (SELECT m.*, mem_n = 0 AND st_n = 0 AS plain, short_text, memory_text,
    max(ordinal) OVER (PARTITION BY m.request_id) = ordinal AS latest,
    min(CASE WHEN role = 'system' THEN ordinal END) OVER (PARTITION BY m.request_id) AS fs
    FROM rm m JOIN rs USING (request_id)),
lines AS (SELECT request_id, CASE WHEN plain THEN 0 WHEN role = 'system' THEN 0 WHEN latest THEN 2
        ELSE 1 END AS section, ordinal, role, CASE WHEN NOT plain AND ordinal = fs THEN
        trim(concat_ws(chr(10) || chr(10), content, memory_text, short_text)) ELSE content END
        AS content FROM body
    UNION ALL SELECT DISTINCT request_id, -1, -1, 'system', concat_ws(chr(10) || chr(10),
        memory_text, short_text) FROM body WHERE NOT plain AND fs IS NULL),
compiled AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id
    ORDER BY section, ordinal) - 1 AS INT) AS position, role, content FROM lines)"""


def _compiled(spark, sf, budget: int = O.V.DEFAULT_BUDGET) -> tuple[DataFrame, DataFrame]:
    return compile_.compile_context(
        _asked(spark, sf), P.utterance_items(spark, sf), P.short_term_at_end(spark, sf), budget)


@query("compiled_messages", COMPILED_SQL + """
SELECT request_id, position, role, content FROM compiled""")
def compiled_messages(spark, sf):
    return _compiled(spark, sf)[0]


@query("compiled_stats", COMPILED_SQL + f""",
tk AS (SELECT request_id, CAST(sum(3 + {O.tokens('content')}) + 3 AS BIGINT) AS total_tokens,
    count(*) AS messages_out FROM compiled GROUP BY request_id)
SELECT rs.request_id, rs.user_id, 8000 AS budget, mem_n = 0 AND st_n = 0 AS pass_through,
    total_tokens, input_tokens, messages_out, mem_n AS memories_used, st_n AS short_term_used,
    message_count + mem_n AS selected_count, 'all' AS selection, total_tokens > 8000 AS over_budget
FROM rs JOIN tk USING (request_id)""")
def compiled_stats(spark, sf):
    return _compiled(spark, sf)[1]


@query("compiled_small_budget")
def compiled_small_budget(spark, sf):
    """Budget 300: most conversations overflow, so selection decides."""
    return _compiled(spark, sf, 300)[1]


@query("budget_totals", MESSAGE_SCORES_SQL + """
SELECT request_id, 300 AS budget, CAST(sum(CASE WHEN mandatory THEN token_cost ELSE 0 END)
    AS BIGINT) AS mandatory_tokens, CAST(sum(CASE WHEN mandatory THEN 0 ELSE token_cost END)
    AS BIGINT) AS optional_tokens, count(*) FILTER (NOT mandatory) AS optional_count,
    CAST(300 - sum(CASE WHEN mandatory THEN token_cost ELSE 0 END) AS BIGINT) AS remaining
FROM ms GROUP BY request_id""")
def budget_totals(spark, sf):
    said = _asked(spark, sf)
    return select.budget_totals(compile_.message_items(
        said, compile_.prepare_requests(said, 300)))


# --- consolidation -------------------------------------------------------------------

def _field_sql() -> str:
    own = "lower(trim(coalesce(predicate, '')))"
    pattern = r"(?:^|[.:])(" + "|".join(O.V.STACK_FIELDS) + r")$"
    text = "lower(coalesce(value, '') || ' ' || coalesce(content, ''))"
    by_value = " ".join(f"WHEN {O.m(text, p)} THEN {O.q(f)}" for f, p in O.V.STACK_VALUE_FIELDS)
    return (f"CASE WHEN {own} = '' OR {own} LIKE 'disliked\\_%' ESCAPE '\\' OR {own} LIKE "
            f"'favorite\\_%' ESCAPE '\\' THEN NULL WHEN {own} IN {O.in_list(O.V.STACK_FIELDS)} "
            f"THEN {O.lookup(own, O.V.STACK_FIELDS)} WHEN {O.m('topic_key', pattern)} THEN "
            f"{O.lookup(O.g('lower(topic_key)', pattern, 1), O.V.STACK_FIELDS)} "
            f"{by_value} END")


CLUSTERS = f"""
fld AS (SELECT *, {_field_sql()} AS field FROM items WHERE status = 'active'),
cl AS (SELECT *, CASE WHEN lower(scope) = 'user' OR lower(subject) = 'user' THEN 'user'
    ELSE 'project' END || '.tech_stack' AS cluster FROM fld WHERE field IS NOT NULL),
big AS (SELECT user_id, cluster, count(*) AS size FROM cl GROUP BY ALL HAVING count(*) >= 3),
vals AS (SELECT cl.*, trim(coalesce(nullif(value, ''), content)) AS field_value FROM cl
    JOIN big USING (user_id, cluster)),
ranked AS (SELECT *, row_number() OVER w AS rn, first_value(field_value) OVER w AS kept,
    first_value(item_id) OVER w AS winner_id FROM vals WINDOW w AS (
    PARTITION BY user_id, cluster, field ORDER BY confidence DESC, s_at, item_id)),
seen AS (SELECT user_id, cluster, field, min(s_at) AS first_seen FROM vals GROUP BY ALL)"""
CLUSTER_SQL = MEMORY_SQL + "," + CLUSTERS


@query("stack_clusters", CLUSTER_SQL + """
SELECT user_id, cluster, size, size AS atomics, false AS has_record FROM big""")
def stack_clusters(spark, sf):
    return consolidate.find_clusters(P.utterance_items(spark, sf))


@query("stack_conflicts", CLUSTER_SQL + """
SELECT user_id, cluster, field, item_id, field_value AS dropped, kept, winner_id,
    'kept ' || kept || ' due to higher confidence' AS resolution FROM ranked
WHERE lower(field_value) <> lower(kept)""")
def stack_conflicts(spark, sf):
    return consolidate.field_conflicts(consolidate.field_values(P.utterance_items(spark, sf)))


@query("consolidated_records", CLUSTER_SQL + """,
win AS (SELECT r.*, first_seen FROM ranked r JOIN seen USING (user_id, cluster, field)
    WHERE rn = 1),
agg AS (SELECT user_id, cluster, count(*) AS field_count, string_agg(field || '=' || field_value,
    ', ' ORDER BY first_seen, field) AS body, '{' || string_agg('"' || field || '":"' ||
    field_value || '"', ',' ORDER BY first_seen, field) || '}' AS value FROM win GROUP BY ALL
    HAVING count(*) >= 2),
uniq AS (SELECT DISTINCT user_id, cluster, item_id, confidence, importance, stability FROM win),
sc AS (SELECT user_id, cluster, round(round(avg(confidence), 9), 3) AS confidence,
    round(greatest(0.95::DOUBLE, max(importance)), 3) AS importance, greatest(0.85::DOUBLE,
    max(stability)) AS s FROM uniq GROUP BY ALL),
src AS (SELECT user_id, cluster, count(DISTINCT item_id) AS source_count FROM vals GROUP BY ALL)
SELECT a.user_id, a.cluster, 'Tech Stack: ' || body AS content, a.value, sc.confidence,
    sc.importance, CASE WHEN s >= 0.95 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS stability,
    CASE WHEN s >= 0.95 THEN 'permanent' ELSE 'long-term' END AS stability_label, source_count,
    CAST(field_count AS INT) AS field_count, 'Merged ' || field_count || ' stack fields from ' ||
    source_count || ' memories.' AS note FROM agg a JOIN sc USING (user_id, cluster)
    JOIN src USING (user_id, cluster)""")
def consolidated_records(spark, sf):
    return consolidate.consolidate(P.utterance_items(spark, sf)).drop(
        "type", "topic_key", "scope", "subject", "predicate")


@query("consolidated_sources", CLUSTER_SQL + """,
many AS (SELECT user_id, cluster FROM vals GROUP BY ALL HAVING count(DISTINCT field) >= 2)
SELECT user_id, cluster, item_id FROM vals JOIN many USING (user_id, cluster)""")
def consolidated_sources(spark, sf):
    return consolidate.superseded_by_consolidation(P.utterance_items(spark, sf))


# The pass as a whole: obsolete items leave before clusters are made; records follow.
PROCESSED_SQL = MEMORY_SQL + f""",
said AS (SELECT DISTINCT user_id, lower(trim(content)) AS d FROM utt
    WHERE seq IN (SELECT event_id FROM events WHERE event_type = 'error') AND role = 'user'),
gone AS (SELECT DISTINCT i.user_id, i.item_id FROM items i JOIN said s ON s.user_id = i.user_id
    WHERE status = 'active' AND (contains(d, lower(i.content)) OR contains(lower(i.content), d)
    OR (topic_key <> '' AND contains(d, lower(topic_key))))),
current AS (SELECT * REPLACE (CASE WHEN item_id IN (SELECT item_id FROM gone) THEN 'obsolete'
    ELSE status END AS status) FROM items),""" + CLUSTERS.replace(
    "FROM items WHERE", "FROM current WHERE") + """,
win AS (SELECT r.*, first_seen FROM ranked r JOIN seen USING (user_id, cluster, field)
    WHERE rn = 1),
rec AS (SELECT user_id, cluster, 'Tech Stack: ' || string_agg(field || '=' || field_value, ', '
    ORDER BY first_seen, field) AS content FROM win GROUP BY ALL HAVING count(*) >= 2),
src AS (SELECT DISTINCT user_id, cluster, item_id FROM vals JOIN rec USING (user_id, cluster))"""


@query("processed_items", PROCESSED_SQL + """
SELECT user_id, type, topic_key, content, version, information_gain,
    CASE WHEN item_id IN (SELECT item_id FROM src) THEN 'superseded' ELSE status END AS status
FROM current
UNION ALL SELECT user_id, 'architecture', cluster, content, 1, 0.9::DOUBLE, 'active' FROM rec""")
def processed_items(spark, sf):
    """Items after obsolescence and consolidation, records among them."""
    return P.utterances_processed(spark, sf)["items"].select(
        "user_id", "type", "topic_key", "content", "version", "information_gain", "status")


@query("process_counts", PROCESSED_SQL + """,
own AS (SELECT user_id, count(*) FILTER (supersedes_id IS NULL) AS created,
    count(*) FILTER (supersedes_id IS NOT NULL) AS superseded, sum(source_count - 1) AS merged,
    count(*) FILTER (end_status = 'revoked') AS revoked FROM final GROUP BY user_id),
routes AS (SELECT user_id, count(*) AS candidates, count(*) FILTER (bucket = 'store') AS stored,
    count(*) FILTER (bucket = 'context') AS context, count(*) FILTER (bucket = 'discard')
    AS discarded FROM routed GROUP BY user_id),
o AS (SELECT user_id, count(*) AS obsolete FROM gone GROUP BY user_id),
c AS (SELECT user_id, count(*) AS consolidated FROM rec GROUP BY user_id),
x AS (SELECT user_id, count(*) AS closed FROM src GROUP BY user_id)
SELECT k.*, coalesce(created, 0) AS created, coalesce(superseded, 0) AS superseded,
    CAST(coalesce(merged, 0) AS BIGINT) AS merged, coalesce(revoked, 0) AS revoked,
    coalesce(obsolete, 0) AS obsolete, coalesce(consolidated, 0) AS consolidated,
    coalesce(closed, 0) AS consolidation_superseded,
    coalesce(created + superseded + merged + revoked, 0) + coalesce(obsolete, 0) > 0
    AS memory_changed
FROM routes k LEFT JOIN own USING (user_id) LEFT JOIN o USING (user_id)
LEFT JOIN c USING (user_id) LEFT JOIN x USING (user_id)""")
def process_counts(spark, sf):
    return P.utterances_processed(spark, sf)["counts"]


@query("incremental_items", ORACLES["processed_items"])
def incremental_items(spark, sf):
    """Two batches, one after the other, end where one pass does."""
    return incremental.utterances_in_halves(spark, sf)["items"].select(
        "user_id", "type", "topic_key", "content", "version", "information_gain", "status")


@query("incremental_counts", ORACLES["process_counts"])
def incremental_counts(spark, sf):
    return incremental.utterances_in_halves(spark, sf)["counts"]


# --- rates and evaluation --------------------------------------------------------------

@query("rate_counts", """
SELECT event_id, user_id, n AS request_count, n > 3 AS over_limit, CASE WHEN n > 3 THEN
    greatest(CAST(ceil((oldest + 86400000000 - us) / 1000000.0) AS BIGINT), 1) ELSE 0 END
    AS retry_after
FROM (SELECT *, count(*) OVER w AS n, min(us) OVER w AS oldest FROM (SELECT *, epoch_us(ts) AS us
    FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING
    AND CURRENT ROW))""")
def rate_counts(spark, sf):
    rows = rates.rate_counts(S.table(spark, sf, "events"), "user_id", 3, 86400)
    return rows.select("event_id", "user_id", "request_count", "over_limit",
                       F.coalesce("retry_after", F.lit(0)).cast("long").alias("retry_after"))


@query("latency_report", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value)
    AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(avg(value), 1) AS avg_ms,
    min(CASE WHEN rn = least(n - 1, floor(n * 0.5::DOUBLE)) + 1 THEN value END) AS p50_ms,
    min(CASE WHEN rn = least(n - 1, floor(n * 0.95::DOUBLE)) + 1 THEN value END) AS p95_ms
FROM r GROUP BY ALL""")
def latency_report(spark, sf):
    return evaluate.latency_report(S.table(spark, sf, "events"), "event_type", "value")


@query("recent_messages", """
SELECT conv_id, ordinal, role FROM (SELECT conv_id, CAST(turn AS INT) AS ordinal, role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 3""")
def recent_messages(spark, sf):
    return evaluate.recent_messages(S.conversation_messages(spark, sf), 3).select(
        F.col("request_id").alias("conv_id"), "ordinal", "role")


@query("compression_report", COMPILED_SQL + f""",
tk AS (SELECT request_id, CAST(sum(3 + {O.tokens('content')}) + 3 AS BIGINT) AS compiled_tokens
    FROM compiled GROUP BY request_id),
fl AS (SELECT request_id, CAST(sum(3 + {O.tokens('content')}) + 3 AS BIGINT) AS full_tokens,
    CAST(sum(CASE WHEN rn <= 10 THEN 3 + {O.tokens('content')} ELSE 0 END) + 3 AS BIGINT)
    AS recent_tokens FROM (SELECT *, row_number() OVER (PARTITION BY request_id
        ORDER BY ordinal DESC) AS rn FROM rm) GROUP BY request_id)
SELECT request_id, full_tokens, recent_tokens, compiled_tokens,
    round(100.0::DOUBLE * (full_tokens - compiled_tokens) / full_tokens, 1) AS reduction_pct
FROM fl JOIN tk USING (request_id)""")
def compression_report(spark, sf):
    return evaluate.compression_report(_asked(spark, sf), _compiled(spark, sf)[1], 10)


@query("cost_report", f"""
WITH t AS (SELECT role AS variant, avg({O.tokens('text')}) AS prompt_tokens FROM conversations
    GROUP BY role), s AS (SELECT unnest([1, 100, 1000, 10000]) AS conversations)
SELECT variant, prompt_tokens, conversations, round((prompt_tokens * 0.15::DOUBLE + 3.0::DOUBLE)
    / 1e6 * conversations, 4) AS cost_usd FROM t, s""")
def cost_report(spark, sf):
    spent = evaluate.text_tokens(S.table(spark, sf, "conversations"), "text").groupBy(
        F.col("role").alias("variant")).agg(F.avg("tokens").alias("prompt_tokens"))
    return evaluate.cost_report(spent, [1, 100, 1000, 10000])


RECALL_SQL = MEMORY_SQL + """,
asked AS (SELECT e.event_id, e.event_type, e.user_id, 'User' || e.user_id || ' / alice' AS expected
    FROM events e),
answers AS (SELECT a.*, coalesce((SELECT string_agg(content, '; ' ORDER BY item_id) FROM items i
    WHERE i.user_id = a.user_id AND status = 'active' AND type = 'fact'), '') AS answer
    FROM asked a),
graded AS (SELECT *, contains(lower(answer), lower(expected)) OR len(list_filter(string_split(
    lower(expected), '/'), lambda p: contains(lower(answer), trim(p)))) > 0 AS correct
    FROM answers)"""


@query("recall_report", RECALL_SQL + """
SELECT event_type, count(*) AS questions, count(*) FILTER (correct) AS correct,
    round(avg(CAST(correct AS DOUBLE)), 4) AS accuracy FROM graded GROUP BY event_type""")
def recall_report(spark, sf):
    known = P.utterance_items(spark, sf).filter("status = 'active' and type = 'fact'")
    asked = S.table(spark, sf, "events").select(
        "event_id", "event_type", "user_id",
        F.concat(F.lit("User"), "user_id", F.lit(" / alice")).alias("expected"))
    return evaluate.recall_report(evaluate.grade_questions(asked, known), ["event_type"])


@query("leak_report", MEMORY_SQL + """,
secrets AS (SELECT DISTINCT user_id, 'User' || user_id AS secret FROM events)
SELECT s.user_id AS owner_id, i.user_id AS reader_id, i.item_id AS output_id, s.secret
FROM items i JOIN secrets s ON s.user_id <> i.user_id AND contains(i.content, s.secret)
WHERE i.status = 'active'""")
def leak_report(spark, sf):
    """Name prefixes make some names occur inside others, so the report is not empty."""
    secrets = S.table(spark, sf, "events").select("user_id").distinct().withColumn(
        "secret", F.concat(F.lit("User"), "user_id"))
    outputs = P.utterance_items(spark, sf).filter("status = 'active'").select(
        "user_id", F.col("item_id").alias("output_id"), F.col("content").alias("text"))
    return evaluate.leak_report(secrets, outputs)


# --- similarity (exact subsequence ratio has no SQL form; tested by brute force) -------

@query("near_duplicates")
def near_duplicates(spark, sf):
    items = P.utterance_items(spark, sf).filter("status = 'active'")
    said = P.routed_utterances(spark, sf).filter("bucket = 'store'").select(
        "user_id", "seq", "pos", "type", F.col("candidate_content").alias("content"))
    return similarity.near_duplicates(said, items.select(
        "user_id", "type", "content", "item_id", "started_seq"))


@query("information_gain")
def information_gain(spark, sf):
    items = P.utterance_items(spark, sf).filter("status = 'active'")
    said = P.routed_utterances(spark, sf).filter("bucket = 'store'").select(
        "user_id", "seq", "pos", "type", F.col("candidate_content").alias("content"))
    return similarity.information_gain(said, items.select("user_id", "type", "content"))


# --- extended rules, gate, external facts -------------------------------------------

def _extended_sql() -> str:
    """Every extended rule over every clause, in rule order, as UNION ALL branches."""
    V = O.V
    ok = "{v} <> '' AND NOT " + O.invalid("{v}")

    def val(p, x="x"):
        return O.clean(O.g(x, p, "val"))

    def first(options):
        """First option whose condition holds -> struct."""
        return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in options) + " END"

    def row(entity, attribute, value, mtype, key, scope, state, conf, meta="''"):
        return (f"struct_pack(entity := {entity}, attribute := {attribute}, value := {value}, "
                f"type := {O.q(mtype)}, key := {key}, scope := {O.q(scope)}, state := "
                f"{O.q(state)}, confidence := {conf}::DOUBLE, meta := {meta})")

    def simple(p, attribute, mtype, state, conf, scope="user", v=None):
        v = v or val(p)
        return (ok.format(v=v), row("'user'", O.q(attribute), v, mtype,
                                    O.q(f"user.{attribute}"), scope, state, conf))
    role = val(V.IDENTITY_ROLE)
    identity = [simple(p, a, "fact", "current", c) for a, p, c in V.IDENTITY_RULES]
    identity.append((ok.format(v=role) + f" AND lower({role}) NOT IN "
                     + O.in_list(V.TRANSIENT_IDENTITY_WORDS),
                     row("'user'", "'occupation'", role, "fact", "'user.occupation'", "user",
                         "current", 0.95)))
    for a, p in V.IDENTITY_PLACE_RULES:
        v = val(p)
        shown = (f"coalesce(nullif(regexp_extract({v}, '\\d+'), ''), {v})" if a == "age" else v)
        identity.append((ok.format(v=v), row("'user'", O.q(a), shown, "fact",
                                             O.q(f"user.{a}"), "user", "current", 1.0)))
    ownership = []
    for p, c in V.OWNERSHIP_RULES:
        attr = O.clean(O.g("x", p, "attr")) if "<attr>" in p else "'ownership'"
        ownership.append((
            ok.format(v=val(p)) + f" AND lower({val(p)}) NOT IN "
            + O.in_list(V.TRANSIENT_POSSESSIONS),
            row(attr if "<attr>" in p else "'user'", attr, val(p), "fact",
                f"'user.' || {O.slug(attr)}", "user", "current", c)))
    usage = []
    for p, c in V.USAGE_RULES:
        usage.append((ok.format(v=val(p)) + " AND " + O.m("x", V.USAGE_NEGATION),
                      row("'user'", "'technology'", val(p), "fact", "'user.technology'", "user",
                          "stopped", 0.95)))
        usage.append(simple(p, "technology", "fact", "current", c))
    stopped = val(V.STOPPED_USAGE)
    taste, dislike, fav = [], [], []
    for p, c in V.LOCAL_PREFERENCE_RULES:
        over = O.clean(O.g("x", p, "over")) if "<over>" in p else "''"
        d = O.domain(val(p), over)
        taste.append((ok.format(v=val(p)), row(
            "'user'", d, val(p), "preference", f"'user.preference.' || {O.slug(d)}", "user",
            "current", c, over)))
    for p, c in V.LOCAL_DISLIKE_RULES:
        dislike.append((ok.format(v=val(p)) + " AND NOT " + O.m("x", V.NOT_A_DISLIKE), row(
            "'user'", "'dislike'", val(p), "preference", f"'user.dislike.' || {O.slug(val(p))}",
            "user", "current", c)))
    for p, c in V.FAVORITE_RULES:
        a = O.american(O.strip(O.g("x", p, "attr")))
        name = (f"'favorite_' || CASE WHEN {O.m(a, V.FAVORITE_DOMAIN)} THEN coalesce("
                f"{O.lookup(a, V.FAVORITE_DOMAIN_NAMES)}, {a}) ELSE {O.slug(a)} END")
        fav.append((f"{val(p)} <> '' AND NOT {O.noise_value(val(p))}", row(
            "'user'", name, val(p), "preference", f"'user.' || {name}", "user", "current", c)))
    action = O.clean(O.g("x", V.CONDITIONAL_ACTION, "val"))
    rules = [
        identity, ownership, usage,
        [simple(V.PAST_USAGE, "technology", "fact", "past", 0.95)],
        [(ok.format(v=stopped), row("'user'", "'technology'", stopped, "fact",
                                    "'user.technology'", "user", "stopped", 0.95,
                                    O.clean(O.g("x", V.STOPPED_USAGE, "reason"))))],
        taste, dislike, fav,
        [simple(V.GOAL_RULE, "goal", "goal", "planned", 0.95)],
        [simple(V.PLAN_RULE, "plan", "goal", "planned", 0.95)],
        [simple(V.POSSIBLE_PLAN_RULE, "plan", "goal", "possible", 0.7)],
        [simple(V.DECISION_RULE, "decision", "decision", "current", 0.95)],
        [simple(V.TEMPORARY_RULE, "temporary_state", "temporary_state", "current", 0.4,
                "session")],
        [(f"{O.m('x', V.CONDITIONAL_RULE)} AND {O.m('x', V.CONDITIONAL_ACTION)}",
          row("'user'", "'plan'", action, "goal", "'user.plan'", "user", "conditional", 0.6))],
    ]
    return " UNION ALL ".join(
        f"SELECT seq, cidx, {i} AS ridx, {first(r)} AS f FROM clause" for i, r in enumerate(rules))


# RE2 has no lookaround, so clause gaps are marked in two passes: after sentence ends, then
# before first-person and contrast joins (keeping the word that follows).
_MARK = "chr(1)"
CLAUSE_SQL = f"""
m1 AS (SELECT event_id AS seq, regexp_replace(x, '([.;!?])\\s+([A-Za-z"''(])',
        '\\1' || {_MARK} || '\\2', 'g') AS x
    FROM (SELECT event_id, {S.statement_text()} AS x FROM {O.EVENTS_K})),
m2 AS (SELECT seq, regexp_replace(x, ',\\s*but\\s+', {_MARK}, 'gi') AS x FROM m1),
m3 AS (SELECT seq, regexp_replace(x, '\\s+but\\s+((?:now|these\\s+days|currently)\\b)',
    {_MARK} || '\\1', 'gi') AS x FROM m2),
m4 AS (SELECT seq, regexp_replace(x, ',\\s+((?:and\\s+)?(?:now|i|we)\\b)', {_MARK} || '\\1',
    'gi') AS x FROM m3),
m5 AS (SELECT seq, regexp_replace(x, '\\s+and\\s+((?:i|we|my)\\b)', {_MARK} || '\\1', 'gi') AS x
    FROM m4),
clause AS (SELECT seq, cidx, {O.strip('y')} AS x FROM (SELECT seq, unnest(string_split(x, {_MARK}))
    AS y, generate_subscripts(string_split(x, {_MARK}), 1) AS cidx FROM m5)
    WHERE {O.strip('y')} <> '')"""


@query("facts_extended", f"""
WITH {CLAUSE_SQL}, found AS ({_extended_sql()}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seq, f.key, f.value ORDER BY cidx, ridx)
    AS rn FROM found WHERE f IS NOT NULL)
SELECT seq, f.entity AS entity, f.attribute AS attribute, f.value AS value, f.type AS type,
    f.key AS key, f.scope AS scope, f.state AS state, f.confidence AS confidence, f.meta AS meta
FROM ranked WHERE rn = 1""")
def facts_extended(spark, sf):
    rows = P.archived_statements(spark, sf).selectExpr(
        "seq", f"{local_facts(col('content'))} AS facts")
    return rows.selectExpr("seq", "explode_outer(facts) AS f").filter("f is not null").selectExpr(
        "seq", *[f"f.{c}" for c in ("entity", "attribute", "value", "type", "key", "scope",
                                    "state", "confidence")],
        "coalesce(f.metadata['preferred_over'], f.metadata['reason'], '') AS meta")


@query("memory_gate")
def gate_of_statements(spark, sf):
    """Gate of utterances and statements (its clause split needs lookaround)."""
    said = P.archived_statements(spark, sf).select("seq", "content").unionByName(
        P.archived_utterances(spark, sf).selectExpr("-1 - seq AS seq", "content"))
    return said.selectExpr("seq", f"{memory_gate(col('content'))} AS g").selectExpr(
        "seq", "g.external", "g.confidence", "g.reason", "array_join(g.kinds, ',') AS kinds")


@query("candidates_extended")
def candidates_extended(spark, sf):
    return extract.extract_candidates(P.archived_statements(spark, sf), "extended").select(
        "seq", "pos", F.col("candidate_content").alias("content"), "type", "topic_key",
        "confidence")


def _external_rows(spark, sf) -> DataFrame:
    """Facts an external extractor might have returned for the statements: the subject and
    the rest of the sentence, with some bad rows."""
    said = P.archived_statements(spark, sf).withColumn("k", F.col("seq") % 11)
    kinds = F.element_at(F.array(*[F.lit(x) for x in (
        "uses", "preference", "hate", "full_name", "plan", "goal", "db", "mood", "job",
        "experiment", "project")]), (F.col("k") + 1).cast("int"))
    types = F.element_at(F.array(*[F.lit(x) for x in (
        "usage", "preference", "dislike", "identity", "plan", "goal", "decision", "fact", "odd",
        "temporary", "identity")]), (F.col("k") + 1).cast("int"))
    one = F.struct(
        F.lit("user").alias("entity"), kinds.alias("attribute"),
        F.regexp_extract("content", r"(\S+ ?\S*)[.?]?$", 1).alias("value"), types.alias("type"),
        F.lit("current").alias("state"), F.lit("user").alias("scope"),
        (F.col("k") / 9.0).alias("confidence"), F.lit("").alias("rawText"))
    return said.select(F.col("seq").alias("message_id"), F.col("content").alias("message"),
                       F.to_json(F.struct(F.array(one, one).alias("facts"))).alias("facts_json"))


def _external_sql() -> str:
    kinds = ("uses preference hate full_name plan goal db mood job experiment project").split()
    types = "usage preference dislike identity plan goal decision fact odd temporary identity".split()
    return f"""
st AS (SELECT event_id AS seq, {S.statement_text()} AS content FROM {O.EVENTS_K}),
ext AS (SELECT seq, pos, list_extract({O.arr(kinds)}, CAST(seq % 11 AS INT) + 1) AS attribute,
    list_extract({O.arr(types)}, CAST(seq % 11 AS INT) + 1) AS type, (seq % 11) / 9.0::DOUBLE
    AS confidence, regexp_extract(content, '(\\S+ ?\\S*)[.?]?$', 1) AS value FROM st,
    (SELECT unnest([0, 1]) AS pos))"""


@query("external_facts_accepted", f"""
WITH {_external_sql()}
SELECT seq AS message_id, pos, attribute, {O.strip('value')} AS value,
    {O.lookup('type', O.V.EXTERNAL_TYPES)} AS type, confidence FROM ext
WHERE {O.strip('value')} <> '' AND confidence <= 1.0 AND type <> 'odd'""")
def external_facts_accepted(spark, sf):
    return external.parse_facts(_external_rows(spark, sf))[0].select(
        "message_id", "pos", "fact.attribute", "fact.value", "fact.type", "fact.confidence")


@query("external_facts_rejected", f"""
WITH {_external_sql()}
SELECT seq AS message_id, pos, CASE WHEN {O.strip('value')} = '' THEN 'missing field'
    WHEN confidence > 1.0 THEN 'confidence outside 0..1' ELSE 'unknown type' END AS reason
FROM ext WHERE {O.strip('value')} = '' OR confidence > 1.0 OR type = 'odd'""")
def external_facts_rejected(spark, sf):
    return external.parse_facts(_external_rows(spark, sf))[1]


CANDIDATE_ACTIONS = "NEW UPDATE SUPERSEDES MAKE DISCARD REINFORCE new CONTRADICTS".split()
CANDIDATE_PLACES = "STORE CONTEXT store STORE STORE NOWHERE STORE STORE".split()


def _external_responses(spark, sf) -> DataFrame:
    """Candidates an external extractor might have returned for the statements, in prose; some
    are to be rejected, and some responses hold no list."""
    said = P.archived_statements(spark, sf).withColumn("k", (F.col("seq") % 8 + 1).cast("int"))
    one = F.struct(
        F.element_at(F.array(*map(F.lit, CANDIDATE_ACTIONS)), F.col("k")).alias("action"),
        F.element_at(F.array(*map(F.lit, CANDIDATE_PLACES)), F.col("k")).alias("destination"),
        F.when(F.col("seq") % 2 == 0, "fact").otherwise("preference").alias("type"),
        F.lit("uses").alias("predicate"),
        F.regexp_extract("content", r"(\S+ ?\S*)[.?]?$", 1).alias("value"),
        (F.col("seq") % 11 / 10.0).alias("confidence"),
        F.when(F.col("seq") % 5 == 0, 12).alias("ttl_hours"))
    return said.select(
        F.col("seq").alias("message_id"), "user_id",
        F.when(F.col("seq") % 17 == 0, "Nothing to keep.").otherwise(F.concat(
            F.lit("Found:\n```json\n"), F.to_json(F.array(one, one)), F.lit("\n```")))
        .alias("response"))


def _external_candidates_sql() -> str:
    return f"""
st AS (SELECT event_id AS seq, user_id, {S.statement_text()} AS content FROM {O.EVENTS_K}),
ext AS (SELECT seq, user_id, pos, seq % 17 = 0 AS unreadable,
    upper(list_extract({O.arr(CANDIDATE_ACTIONS)}, CAST(seq % 8 AS INT) + 1)) AS action,
    upper(list_extract({O.arr(CANDIDATE_PLACES)}, CAST(seq % 8 AS INT) + 1)) AS place,
    CASE WHEN seq % 2 = 0 THEN 'fact' ELSE 'preference' END AS type,
    (seq % 11) / 10.0::DOUBLE AS confidence,
    {O.strip("regexp_extract(content, '(\\S+ ?\\S*)[.?]?$', 1)")} AS value
    FROM st, (SELECT unnest([0, 1]) AS pos)),
judged AS (SELECT *, CASE WHEN unreadable THEN 'unreadable' WHEN action = 'DISCARD' THEN 'discarded'
    WHEN action = 'MAKE' THEN 'unknown action' WHEN place = 'NOWHERE' THEN 'unknown destination'
    WHEN value = '' THEN 'missing field' WHEN confidence < 0.4 THEN 'low confidence' END AS reason
    FROM ext)"""


@query("external_candidates", f"""
WITH {_external_candidates_sql()}
SELECT seq AS message_id, user_id, pos, type, value AS content, 'user.uses' AS topic_key,
    action IN ('SUPERSEDES', 'CONTRADICTS') AS is_correction, lower(place) AS bucket, confidence
FROM judged WHERE reason IS NULL""")
def external_candidates(spark, sf):
    return external.parse_candidates(_external_responses(spark, sf)).select(
        "message_id", "user_id", "pos", "type", F.col("candidate_content").alias("content"),
        "topic_key", "is_correction", F.col("source_bucket").alias("bucket"),
        F.col("source_confidence").alias("confidence"))


@query("external_candidates_rejected", f"""
WITH {_external_candidates_sql()}
SELECT DISTINCT seq AS message_id, user_id, CASE WHEN unreadable THEN -1 ELSE pos END AS pos, reason
FROM judged WHERE reason IS NOT NULL""")
def external_candidates_rejected(spark, sf):
    return external.rejected_candidates(_external_responses(spark, sf)).na.fill(-1, ["pos"])


@query("candidates_with_external", f"""
WITH {O.utterances()}, {O.routed_cte()}, {_external_candidates_sql()},
own AS (SELECT DISTINCT user_id, seq, lower(cc) AS said FROM routed),
more AS (SELECT user_id, seq, lower(value) AS said, any_value(type) AS type,
    any_value(value) AS content, any_value(lower(place)) AS bucket FROM judged
    WHERE reason IS NULL AND (user_id, seq, lower(value)) NOT IN (FROM own) GROUP BY ALL)
SELECT user_id, seq, type, cc AS content, bucket, CAST(NULL AS TIMESTAMP) AS valid_until
FROM routed
UNION ALL SELECT user_id, seq, type, more.content, bucket, CASE WHEN seq % 5 = 0 AND bucket = 'store'
    THEN ts + INTERVAL 12 HOUR END FROM more JOIN utt USING (user_id, seq)""")
def candidates_with_external(spark, sf):
    """Candidates of the messages, and what an external extractor adds to them."""
    found = external.parse_candidates(_external_responses(spark, sf))
    return external.with_external(
        P.routed_utterances(spark, sf), found, P.archived_utterances(spark, sf)).select(
        "user_id", "seq", "type", F.col("candidate_content").alias("content"), "bucket",
        "valid_until")


@query("external_facts_validated")
def external_facts_validated(spark, sf):
    accepted, _ = external.parse_facts(_external_rows(spark, sf))
    return external.validated_candidates(external.validate(external.per_message(accepted))).drop(
        "metadata")


@query("hybrid_facts")
def hybrid_facts(spark, sf):
    accepted, _ = external.parse_facts(_external_rows(spark, sf))
    return external.hybrid_facts(external.per_message(accepted)).selectExpr(
        "message_id", "route", "size(chosen) AS facts")


# --- streams ---------------------------------------------------------------------------

@query("stream_dedupe", """
SELECT event_type, count(DISTINCT (user_id, props)) AS messages FROM events GROUP BY event_type""")
def stream_dedupe(spark, sf):
    """Keys are kept for longer than the events last, so the result is the distinct count."""
    events = jobs.stream_table(spark, sf, "events").withColumn(
        "ts", F.col("ts").cast("timestamp")).withColumn(
        "message_key", F.md5(F.concat_ws("|", "event_type", "props")))
    kept = jobs.run_to_end(jobs.stream_dedupe(events, "400 days"), "dedupe")
    return kept.groupBy("event_type").agg(F.count("*").alias("messages"))


@query("stream_rates", """
WITH e AS (SELECT user_id, epoch_ms(ts) AS ms FROM events),
w AS (SELECT user_id, (ms // 7200000 - k) * 7200 AS window_start FROM e,
    (SELECT unnest([0, 1, 2]) AS k))
SELECT window_start, user_id, count(*) AS requests FROM w GROUP BY ALL
HAVING (window_start + 21600) * 1000 <= (SELECT max(ms) - 60000 FROM e)""")
def stream_rates(spark, sf):
    """Windows of six hours every two, as far as the watermark closed them."""
    events = jobs.stream_table(spark, sf, "events").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    counted = jobs.run_to_end(jobs.stream_rates(events, "user_id", "6 hours", "2 hours"), "rates")
    return counted.withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_context", CONTEXT_SQL + """,
mark AS (SELECT max(epoch_ms(ts)) - 600000 AS w FROM ctx),
late AS (SELECT * FROM lastset WHERE rn = 1)
SELECT user_id, key, value, seq, 'set' AS event FROM late
UNION ALL SELECT user_id, key, value, seq, 'expired' FROM late, mark
WHERE epoch_ms(ts) + ttl * 1000 <= w""")
def stream_context(spark, sf):
    """The last set of every key, and those that the watermark let expire."""
    log = context.context_log(P.routed_utterances(spark, sf)).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    return jobs.run_to_end(jobs.stream_context(jobs.as_stream(log, "context", "seq")), "context")


@query("stream_memory")
def stream_memory(spark, sf):
    rows = jobs.candidate_rows(P.routed_utterances(spark, sf))
    return jobs.run_to_end(jobs.stream_memory(jobs.as_stream(rows, "memory", "seq")), "memory")
