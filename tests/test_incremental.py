"""Batches one after the other against one pass, and external candidates in the memory."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from engram.operators.memory import memory_as_of
from engram.operators.store import expired_at
from engram.plans.incremental import process_batch, stored
from engram.plans.pipeline import process

SAID = [
    (1, 1, "The database is Neon"), (2, 2, "The runtime is Bun"), (1, 3, "The region is eu-west-1"),
    (3, 4, "The framework is Hono"), (1, 5, "The runtime is Deno"),
    # Second batch: a switch, a near copy, a user of its own; user 3 says nothing more.
    (1, 6, "The database changed from Neon to Turso"), (2, 7, "The runtime is Bun"),
    (4, 8, "The database is MySQL"), (None, 9, "The database is Redis"),
    # Third batch, with a row that comes late.
    (1, 10, "Forget the runtime"), (2, 0, "The runtime is Node"),
]
TOLD = [(1, 5, "Region: eu-west-1 is old"), (3, 10, "the framework: hono is gone")]


def _messages(spark, rows):
    df = spark.createDataFrame([(u, s, "user", t) for u, s, t in rows],
                               "user_id long, seq long, role string, content string")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + "
                                      "make_dt_interval(0, 0, 0, seq)"))


def _told(spark, rows):
    return spark.createDataFrame([(u, t) for u, _, t in rows],
                                 "user_id long, description string")


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


ITEM = ("user_id", "item_id", "content", "version", "status", "source_count", "supersedes_id")


def test_batches_equal_one_pass(spark, tmp_path):
    folder = str(tmp_path / "memory")
    parts = [SAID[:5], SAID[5:9], SAID[9:], []]
    told = [[], TOLD[:1], TOLD[1:], []]
    results = [process_batch(_messages(spark, p), folder, n, _told(spark, t))
               for n, (p, t) in enumerate(zip(parts, told, strict=True))]
    whole = process(_messages(spark, [r for r in SAID if r[0]]), _told(spark, TOLD))
    items = stored(spark, folder, "items", results[0]["items"])
    assert _rows(items, *ITEM) == _rows(whole["items"], *ITEM)
    assert {r.status for r in items.collect()} >= {"active", "obsolete", "superseded", "revoked"}
    for name in ("counts", "status", "snapshot", "context"):
        columns = whole[name].columns
        got = stored(spark, folder, name, results[0][name])
        assert _rows(got, *columns) == _rows(whole[name], *columns), name
    # Only users that a batch names were looked at.
    assert {r.user_id for r in results[1]["items"].collect()} == {1, 2, 4}
    assert {r.user_id for r in results[2]["items"].collect()} == {1, 2, 3}
    assert results[3]["items"].isEmpty()


def test_the_latest_batch_may_be_repeated(spark, tmp_path):
    folder = str(tmp_path / "memory")
    process_batch(_messages(spark, SAID[:5]), folder, 0)
    seen = []
    for _ in range(2):
        result = process_batch(_messages(spark, SAID[5:]), folder, 1, _told(spark, TOLD))
        seen.append(_rows(stored(spark, folder, "items", result["items"]), *ITEM))
    assert seen[0] == seen[1] and seen[0]


def _response(*entries):
    return "Found:\n```json\n" + json.dumps(list(entries)) + "\n```"


def test_external_candidates_enter_the_memory(spark, tmp_path):
    entry = {"predicate": "uses", "scope": "PROJECT", "confidence": 0.9}
    responses = [
        # Said already; a fact with an end; a note for the short term.
        (1, 1, _response(entry | {"value": "DATABASE: neon"},
                         entry | {"value": "the staging key", "topicKey": "project.key",
                                  "ttl_hours": 2},
                         entry | {"value": "fixing the login", "destination": "CONTEXT",
                                  "ttl_hours": 0.5})),
        # Replaces what an earlier one said of the topic; a message that is not there.
        (2, 1, _response(entry | {"value": "a newer key", "topicKey": "project.key",
                                  "action": "SUPERSEDES"})),
        (99, 1, _response(entry | {"value": "nobody"})), (2, 7, "nothing"), (None, None, None),
    ]
    folder = str(tmp_path / "memory")
    df = spark.createDataFrame(responses, "message_id long, user_id long, response string")
    first = process_batch(_messages(spark, [(1, 1, "The database is Neon")]), folder, 0,
                          responses=df)
    got = {r.content: r for r in first["items"].collect()}
    assert set(got) == {"Database: Neon", "the staging key"}
    assert got["Database: Neon"].valid_until is None
    assert got["the staging key"].valid_until == datetime(2024, 1, 1, 2, 0, 1)
    note = first["context"].filter("value = 'fixing the login'").first()
    assert note.ttl_seconds == 1800.0
    # Its end is real: active before, expired from then on.
    for at, status in ((datetime(2024, 1, 1, 2), "active"), (datetime(2024, 1, 1, 2, 0, 1), "expired")):
        assert expired_at(first["items"], at).filter(
            "content = 'the staging key'").first().status == status
        assert memory_as_of(first["versions"], at, "at").filter(
            "content = 'the staging key'").first().status == status
    second = process_batch(_messages(spark, [(1, 2, "The runtime is Bun")]), folder, 1,
                           responses=df)
    got = {r.content: (r.status, r.version, r.valid_until is None)
           for r in stored(spark, folder, "items", second["items"]).collect()}
    assert got["the staging key"] == ("superseded", 1, False)
    assert got["a newer key"] == ("active", 2, True)
    assert got["Runtime: Bun"][0] == "active" and "nobody" not in got
