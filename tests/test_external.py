"""External facts, candidates and records."""

import json

import pytest

from engram.operators import external as X


def fact(attribute, value, kind, **more):
    return {"entity": more.pop("entity", "user"), "attribute": attribute, "value": value,
            "type": kind, "state": "current", "scope": "user", "confidence": 0.9,
            "rawText": "", "metadata": None, **more}


CASES = {
    1: ("My name is Ada. I don't like tabs anymore. I plan to use Rust if latency stays low.", [
        fact("full_name", "Ada", "identity"), fact("uses", "tabs", "usage"),
        fact("plan", "use Rust", "plan"), fact("mood", "fine", "fact"),
        fact("role", "engineer", "identity", confidence=3.0), fact("job", "x", "odd")]),
    2: ("It uses Workers, D1 and Redis. I prefer tea over coffee. I am testing Deno.", [
        fact("technology", "Workers, D1 and Redis", "usage", entity="it"),
        fact("preference", "tea over coffee", "preference"),
        fact("uses", "Deno", "usage")]),
    3: ("I stopped using MySQL because it was slow. I hate tabs. I avoid tabs.", [
        fact("database", "MySQL", "stopped_usage"), fact("dislike", "tabs", "dislike"),
        fact("hate", "Tabs", "dislike", confidence=0.5)]),
    4: ("Should we use Kafka?", [fact("uses", "Kafka", "usage")]),
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, m, json.dumps({"facts": f})) for i, (m, f) in CASES.items()]
    data.append((5, "bad", "not json"))
    return spark.createDataFrame(data, "message_id int, message string, facts_json string")


def test_parse_and_quarantine(rows):
    accepted, rejected = X.parse_facts(rows)
    assert accepted.count() == 4 + 3 + 3 + 1
    got = {(r.message_id, r.reason) for r in rejected.collect()}
    assert got == {(1, "confidence outside 0..1"), (1, "unknown type"), (5, "unreadable")}


def test_validation(rows):
    accepted, _ = X.parse_facts(rows)
    out = {}
    for r in X.validate(X.per_message(accepted)).collect():
        out[r.message_id] = [(f.entity, f.attribute, f.value, f.state, f.scope, f.key,
                              dict(f.metadata or {})) for f in r.validated]
    assert out[1] == [
        ("user", "name", "Ada", "current", "user", "user.name", {}),
        ("user", "dislike", "tabs", "current", "user", "user.dislike.tabs", {}),
        ("user", "plan", "Rust", "conditional", "user", "user.plan.rust",
         {"condition": "latency stays low"})]
    assert [f[:3] for f in out[2]] == [
        ("project", "uses", "Workers"), ("project", "uses", "D1"), ("project", "uses", "Redis"),
        ("user", "preference", "tea"), ("user", "experiment", "Deno")]
    assert out[2][3][6] == {"preferred_over": "coffee"} and out[2][4][4] == "session"
    assert out[3][0][1:4] == ("database", "MySQL", "stopped")
    assert out[3][0][6] == {"reason": "it was slow"}
    assert [f[1:3] for f in out[3][1:]] == [("dislike", "tabs")]
    assert out[4] == []


def test_hybrid_routes(spark, rows):
    messages = spark.createDataFrame(
        [(1, "I use Neon"), (2, "hello there"), (3, "The weather turned while working"),
         (4, "Neon powers the API")], "message_id int, message string")
    accepted, _ = X.parse_facts(rows)
    empty = X.per_message(accepted).select("facts").limit(0)
    both = messages.join(empty, how="left", on=messages.message_id < 0)
    from pyspark.sql import functions as F
    both = both.withColumn("facts", F.coalesce("facts", F.array().cast(
        empty.schema["facts"].dataType)))
    got = {r.message_id: (r.route, [f.value for f in r.chosen])
           for r in X.hybrid_facts(both).collect()}
    assert got == {1: ("local", ["Neon"]), 2: ("skip", []), 3: ("external", []),
                   4: ("skip", [])}


def test_candidates_and_records(spark):
    good = {"action": "new", "type": "PREFERENCE", "scope": "USER", "subject": "user",
            "predicate": "editor", "value": "Vim", "confidence": 2.0, "ttl_hours": 2}
    low = {**good, "confidence": 0.1}
    gone = {**good, "action": "SUPERSEDES", "type": "FACT", "value": "Emacs",
            "rawText": "uses Emacs", "supersedes_id": "7", "stability": "permanent"}
    text = "Sure:\n```json\n" + json.dumps([good, low, gone, {"action": "FLY"}]) + "\n```"
    df = spark.createDataFrame([(1, 9, text), (2, 9, "nothing")],
                               "message_id int, user_id int, response string")
    got = X.parse_candidates(df).orderBy("pos").collect()
    assert [(r.candidate_content, r.type, r.is_correction) for r in got] == [
        ("Vim", "preference", False), ("uses Emacs", "fact", True)]
    left = X.rejected_candidates(df)
    assert left.columns == ["message_id", "user_id", "pos", "reason"]
    assert left.filter("pos is null").collect() == [(2, 9, None, "unreadable")]
    assert got[0].source_confidence == 1.0 and got[0].ttl_hours == 2.0
    assert got[1].source_stability == 1.0 and got[1].obsolete_id == "7"
    record = {"consolidated": [{"predicate": "tech_stack", "value": "x", "confidence": -1},
                               {"predicate": ""}, {"predicate": "third"}],
              "conflicts_detected": [{"description": "d", "memory_ids": ["1", "2"]}]}
    rows = spark.createDataFrame([("c", "ok\n```json\n" + json.dumps(record) + "\n```")],
                                 "cluster string, response string")
    records, conflicts = X.parse_records(rows)
    assert [(r.predicate, r.confidence, r.topic_key) for r in records.collect()] == [
        ("tech_stack", 0.0, "project.tech_stack")]
    assert conflicts.first().memory_ids == ["1", "2"]


def test_rejected_candidates(spark):
    fine = {"predicate": "uses", "value": "Vim"}
    entries = [fine, fine | {"action": "discard"}, fine | {"action": "MAKE"},
               fine | {"destination": "x"}, fine | {"value": " "}, {"value": "Vim"},
               fine | {"confidence": 0.39}, fine | {"confidence": 0.4}]
    df = spark.createDataFrame(
        [(1, json.dumps(entries)), (2, "[]"), (3, None), (4, "none")], "id int, response string")
    got = sorted((r.id, -1 if r.pos is None else r.pos, r.reason)
                 for r in X.rejected_candidates(df).collect())
    assert got == [
        (1, 1, "discarded"), (1, 2, "unknown action"), (1, 3, "unknown destination"),
        (1, 4, "missing field"), (1, 5, "missing field"), (1, 6, "low confidence"),
        (3, -1, "unreadable"), (4, -1, "unreadable")]
    assert sorted(r.pos for r in X.parse_candidates(df).collect()) == [0, 7]
