"""Phrases -> facts, corrections, revocations and candidates (core rules)."""

import pytest
from engram.functions import facts as R
from engram.functions.sql import col
from engram.operators.extract import extract_candidates, message_facts


def facts_of(spark, phrases):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "id int, content string")
    rows = message_facts(df).orderBy("id").collect()
    return [r["facts"] for r in rows]


SINGLE = [
    ("I am building a project called Nimbus.", "Nimbus", "project", "Nimbus", "fact",
     "project.name", "project"),
    ("Nimbus uses Neon for database.", "Nimbus", "database", "Neon for database", "decision",
     "project.database", "project"),
    ("I prefer MUI over shadcn.", "user", "ui_library", "MUI", "preference",
     "user.preference.ui_library", "user"),
    ("I love blue.", "user", "favorite_color", "blue", "preference", "user.favorite_color",
     "user"),
    ("I hate verbose code.", "user", "disliked_verbose_code", "verbose code", "preference",
     "user.disliked_verbose_code", "user"),
    ("I don't like red.", "user", "disliked_color", "red", "preference", "user.disliked_color",
     "user"),
    ("My favourite colour is teal now.", "user", "favorite_color", "teal", "preference",
     "user.favorite_color", "user"),
    ("My preferred language is Rust", "user", "preferred_language", "Rust", "preference",
     "user.preferred_language", "user"),
    ("Nimbus's architecture is event driven.", "Nimbus", "architecture", "event driven",
     "architecture", "project.architecture", "project"),
    ("The deployment target is AWS Lambda.", "deployment target", "deployment target",
     "AWS Lambda", "decision", "project.deployment_target", "project"),
    ("My name is Kim.", "user", "name", "Kim", "fact", "user.name", "user"),
    ("I live in Oslo.", "user", "location", "Oslo", "fact", "user.location", "user"),
    ("The team uses the agile workflow.", "team", "workflow", "the agile workflow", "fact",
     "project.workflow", "project"),
    ("I prefer use TypeScript", "user", "language", "TypeScript", "preference",
     "user.preference.language", "user"),
]


def test_single_rules(spark):
    got = facts_of(spark, [c[0] for c in SINGLE])
    for case, facts in zip(SINGLE, got):
        assert len(facts) == 1, case
        f = facts[0]
        assert (f.entity, f.attribute, f.value, f.type, f.key, f.scope) == case[1:], case


def test_preferred_over_metadata(spark):
    f = facts_of(spark, ["I prefer MUI over shadcn."])[0][0]
    assert f.metadata == {"preferred_over": "shadcn"}


@pytest.mark.parametrize("phrase", [
    "I love this response.", "I hate that.", "I like it", "What database does it use?",
    "Is it ready", "ok thanks",
])
def test_no_fact(spark, phrase):
    assert facts_of(spark, [phrase])[0] == []


def test_list_compound_and_sentences(spark):
    many, compound, two = facts_of(spark, [
        "Nimbus uses Hono as the framework, Neon for database, Upstash for cache and S3 as storage",
        "My name is Kim and I prefer Go",
        "My name is Kim. The region is eu-west-1.",
    ])
    assert [(f.attribute, f.value) for f in many] == [
        ("framework", "Hono"), ("database", "Neon"), ("cache", "Upstash"), ("storage", "S3")]
    assert {f.type for f in many} == {"decision"}
    assert [(f.attribute, f.value) for f in compound] == [("name", "Kim"), ("language", "Go")]
    assert [f.key for f in two] == ["user.name", "project.region"]


def test_switch_update(spark):
    got = facts_of(spark, ["We switched to Postgres for the database.",
                           "We switched the cache to Redis"])
    assert (got[0][0].attribute, got[0][0].value, got[0][0].is_update) == (
        "database", "Postgres", True)
    assert (got[1][0].entity, got[1][0].attribute, got[1][0].value) == (
        "the cache", "cache", "Redis")


def test_corrections_and_revocations(spark):
    rows = spark.createDataFrame([
        (0, "Nimbus changed from Neon to self-hosted PostgreSQL."),
        (1, "The API now uses Go instead of Rust"),
        (2, "I changed my preference from MUI to shadcn"),
        (3, "The region was changed to eu-west-2."),
        (4, "The deadline changed to Q4"),
        (5, "The temporary demo password was reset; ignore temp1234."),
        (6, "Please ignore the previous budget."),
        (7, "The owner is no longer valid"),
        (8, "The token has been revoked"),
        (9, "forget the old deadline"),
        (10, "nothing here"),
    ], "id int, t string").selectExpr(
        "id", str(R.parse_correction(col("t")).alias("c")),
        str(R.parse_revocation(col("t")).alias("r"))).orderBy("id").collect()
    c = [tuple(r.c) if r.c else None for r in rows]
    assert c[:5] == [
        ("Nimbus", "Neon", "self-hosted PostgreSQL"), ("API", "Rust", "Go"),
        ("preference", "MUI", "shadcn"), ("region", "", "eu-west-2"), ("deadline", "", "Q4")]
    assert c[5:] == [None] * 6
    r = [tuple(x.r) if x.r else None for x in rows]
    assert r[5] == ("temporary demo password", "temp1234")
    assert r[6][0] == "budget" and r[7][0] == "owner" and r[8][0] == "token"
    assert r[9][0] == "deadline" and r[10] is None


def test_candidates(spark):
    messages = [
        (0, "user", "My name is Kim."),
        (1, "user", "ok"),
        (2, "user", "What is my name?"),
        (3, "user", "Maybe we use Redis"),
        (4, "user", "Actually, Nimbus changed from Neon to Turso."),
        (5, "user", "The demo password was reset; ignore temp1234."),
        (6, "assistant", "The demo password was reset"),
        (7, "user", "never deploy on Friday"),
        (8, "assistant", "Decision: use Neon"),
        (9, "assistant", "deployed the service"),
        (10, "user", "working on the docs"),
        (11, "system", "The region is eu"),
        (12, "user", "We decided to use Kafka for events"),
    ]
    df = spark.createDataFrame(messages, "id int, role string, content string")
    got = {r["id"]: r for r in extract_candidates(df).collect()}
    assert set(got) == {0, 4, 5, 7, 8, 10, 12}
    assert (got[0].candidate_content, got[0].topic_key, got[0].confidence) == (
        "Name: Kim", "user.name", 0.88)
    assert got[4].correction.old_value == "Neon" and got[4].is_correction
    assert got[4].type == "decision" and got[4].confidence == 0.95
    assert got[5].revocation.value == "temp1234" and got[5].topic_key == "__revocation__"
    assert (got[7].type, got[7].candidate_content) == ("constraint", "deploy on Friday")
    assert (got[8].authority, got[8].type, got[8].candidate_content) == (
        "assistant", "fact", "Decision: use Neon")
    assert got[10].type == "active_task" and got[10].topic_key == "active_task:docs"
    assert (got[12].type, got[12].candidate_content, got[12].topic_key) == (
        "decision", "Use Kafka for events", "events")
