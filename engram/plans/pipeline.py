"""The jobs composed: ingest, memory, contexts.

Tables that several jobs read (candidates, versions) are written once to the shared
folder and read back, so a lost executor never recomputes the extraction.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.consolidate import field_values, records_of, sources_of
from engram.operators.context import context_as_of, context_block, context_log
from engram.operators.extract import extract_candidates
from engram.operators.history import Applied, apply_in_order, versions_of
from engram.operators.memory import (
    memory_as_of, obsolete_items, process_counts, snapshot_lists,
)
from engram.operators.messages import (
    append_new, detect_delta, new_users, normalize_messages, request_messages,
)
from engram.operators.route import route_candidates
from engram.operators.store import (
    STATUS, commit, committed, record_items, status_rows, with_status,
)
from engram.session import shared_folder, written
from engram.sources.tables import statements, table, utterances

_written: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """The stage table ``name`` of a session and folder, written on first use."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        _written[key] = written(build())
    return _written[key]


def candidates_of(messages: DataFrame, ruleset: str = "core") -> DataFrame:
    return route_candidates(extract_candidates(messages, ruleset))


def ingest(requests: DataFrame, archive_path: str, archive: DataFrame) -> DataFrame:
    """Requests -> archive: normalise, keep what is new, append; returns the new messages."""
    messages = normalize_messages(request_messages(requests))
    delta = detect_delta(messages, archive, ("ts", "request_id", "ordinal"))
    fresh = written(delta)
    append_new(fresh, archive_path)
    return fresh.filter("delta_status = 'new'")


def ingest_twice(requests: DataFrame) -> DataFrame:
    """Per user: messages new in a first and in a second ingest of the same requests, and how
    many the archive then holds."""
    spark = requests.sparkSession
    path = os.path.join(shared_folder(spark), "archives", uuid.uuid4().hex)
    nothing = normalize_messages(request_messages(requests.limit(0)))
    first = ingest(requests, path, nothing)
    archive = spark.read.schema(first.drop("delta_status").schema).parquet(path)
    second = ingest(requests, path, archive)
    after = spark.read.schema(archive.schema).parquet(path)
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    return (count(after, "archived").join(count(first, "first_new"), "user_id")
            .join(count(second, "second_new"), "user_id", "left").na.fill(0, ["second_new"]))


def ensure_users(messages: DataFrame, users: DataFrame) -> DataFrame:
    return new_users(messages, users, "ts")


def process(messages: DataFrame, descriptions: DataFrame | None = None,
            folder: str | None = None, batch: int = 0) -> dict[str, DataFrame]:
    """Messages -> candidates, versions, obsolescence, snapshot, consolidation, counts.

    `descriptions` (user_id, description) say what is obsolete.  With a `folder`, items, status
    changes, snapshot entries and counts are committed as `batch`; the same batch again changes
    nothing.
    """
    routed = written(candidates_of(messages))
    return _passed(routed, versions_of(apply_in_order(routed)), descriptions, folder, batch)


def _passed(routed: DataFrame, versions: DataFrame, descriptions: DataFrame | None,
            folder: str | None, batch: int) -> dict[str, DataFrame]:
    items = memory_as_of(versions)
    if descriptions is None:
        descriptions = items.select("user_id", F.lit("").alias("description")).limit(0)
    obsolete = written(obsolete_items(items, descriptions))
    log = status_rows(obsolete, "obsolete", "described", 0)
    current = written(with_status(items, log))
    values = written(field_values(current))
    records, sources = records_of(values), written(sources_of(values))
    log = log.unionByName(status_rows(sources, "superseded", "consolidated", 1))
    made = written(record_items(records, sources, current))
    result = {
        "candidates": routed, "versions": versions, "context": context_log(routed),
        "items": with_status(items, log).unionByName(made), "status": log,
        "snapshot": snapshot_lists(current), "records": made,
        "counts": process_counts(versions, routed, obsolete, made, sources)}
    if folder is not None:
        commit(items.unionByName(made), folder, "items", batch)
        for name in ("status", "snapshot", "counts"):
            commit(result[name], folder, name, batch)
    return result


def stored_items(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The items of all batches with their latest status."""
    items = committed(spark, folder, "items", schema).drop("batch")
    return with_status(items, committed(spark, folder, "status", f"{STATUS}, batch int"))


# --- the stages over the events table ------------------------------------------

def archived_utterances(spark: SparkSession, folder: str) -> DataFrame:
    """The message archive of the events table."""
    return once(spark, folder, "messages", lambda: utterances(spark, folder))


def archived_statements(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "statements", lambda: statements(spark, folder))


def routed_utterances(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "routed", lambda: candidates_of(archived_utterances(spark, folder)))


def applied_utterances(spark: SparkSession, folder: str) -> Applied:
    """What the candidates of the events table did, one after the other."""
    key = (spark.sparkContext.applicationId, folder, "applied")
    if key not in _written:
        _written[key] = apply_in_order(routed_utterances(spark, folder))
    return _written[key]


def utterance_versions(spark: SparkSession, folder: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, "versions")
    if key not in _written:
        _written[key] = versions_of(applied_utterances(spark, folder))
    return _written[key]


def obsolete_sayings(spark: SparkSession, folder: str) -> DataFrame:
    """What users said in error events: user_id, seq, description of what is obsolete."""
    errors = table(spark, folder, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("seq"))
    return archived_utterances(spark, folder).filter("role = 'user'").join(
        errors, "seq", "left_semi").select("user_id", "seq", F.col("content").alias("description"))


def utterances_processed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The whole pass over the events table; messages of error events say what is obsolete."""
    key = (spark.sparkContext.applicationId, folder, "processed")
    if key not in _written:
        said = obsolete_sayings(spark, folder)
        _written[key] = _passed(routed_utterances(spark, folder),
                                utterance_versions(spark, folder), said, None, 0)
    return _written[key]


def utterance_items(spark: SparkSession, folder: str) -> DataFrame:
    return memory_as_of(utterance_versions(spark, folder))


def short_term_at_end(spark: SparkSession, folder: str) -> DataFrame:
    """Context blocks as of the end of the events."""
    end = archived_utterances(spark, folder).agg(F.max("ts").alias("end")).first()["end"]
    return context_block(context_as_of(context_log(routed_utterances(spark, folder)), end))
