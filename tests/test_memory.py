"""Version history: scenarios, chunked chains, ordered fold, as-of reads."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import history as H
from engram.operators import memory, retrieve
from engram.operators.context import context_as_of, context_block
from engram.plans.pipeline import candidates_of, process, stored_items
from engram.session import cut_lineage
from engram.streaming import jobs
from engram.streaming.fold import Memory

SCENARIOS = [
    # database corrected
    (1, "Nimbus uses Neon for database"),
    (1, "Actually, Nimbus changed from Neon to Turso."),
    # preference replaced, restated
    (2, "I prefer React"), (2, "I prefer Svelte"), (2, "I prefer Svelte"), (2, "I prefer Svelte."),
    # value reset, then stated again
    (3, "The demo password is lilac77"), (3, "The demo password was reset; ignore lilac77."),
    (3, "The demo password is lilac77"),
    # unrelated facts survive
    (4, "The region is eu-west-1"), (4, "The budget is 9000 dollars"),
    # correction without target is stored
    (5, "The stack changed from Rust to Go"),
    # stack switched
    (6, "We switched to Neon for the database"), (6, "We switched to Postgres"),
]


@pytest.fixture(scope="module")
def history(spark):
    rows = [(u, i, "user", t) for i, (u, t) in enumerate(SCENARIOS)]
    df = spark.createDataFrame(rows, "user_id long, seq long, role string, content string")
    df = df.withColumn("ts", F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, seq)"))
    routed = cut_lineage(candidates_of(df))
    return routed, H.apply_candidates(routed)


def by_user(versions, user):
    rows = versions.filter(F.col("user_id") == user).orderBy("started_seq").collect()
    return [(r.content, r.end_status or "active", r.version) for r in rows]


def test_scenarios(history):
    _, versions = history
    assert by_user(versions, 1)[0][1] == "superseded"
    assert by_user(versions, 1)[1][1] == "active"
    assert by_user(versions, 2) == [("React", "superseded", 1), ("Svelte", "active", 2)]
    again = by_user(versions, 3)
    assert [a[1:] for a in again] == [("revoked", 1), ("active", 1)]
    assert [a[1] for a in by_user(versions, 4)] == ["active", "active"]
    assert [a[1] for a in by_user(versions, 5)] == ["active"]
    assert [a[1:] for a in by_user(versions, 6)] == [("superseded", 1), ("active", 2)]


def test_merge_fields_links_and_audit(history):
    _, versions = history
    row = versions.filter("content = 'Svelte'").first()
    assert row.source_count == 3 and row.stability == pytest.approx(0.55 + 2 * 0.08)
    old = versions.filter("content = 'React'").first()
    assert row.supersedes_id == old.item_id
    audit = {(r.user_id, r.old_value, r.new_value)
             for r in memory.corrections_audit(versions).collect()}
    assert (1, "Neon", "Turso") in audit
    assert any(u == 6 for u, _, _ in audit)


def test_as_of_and_one_active_per_topic(history):
    _, versions = history
    then = memory.memory_as_of(versions, 7)
    assert then.filter("user_id = 3 and status = 'active'").count() == 0
    now = memory.memory_as_of(versions).filter("status = 'active'")
    assert now.groupBy("user_id", "type", "topic_key").count().filter("count > 1").count() == 0
    timed = versions.withColumn("valid_until", F.col("started_at"))
    late = memory.memory_as_of(timed, versions.agg(F.max("started_at")).first()[0], "at")
    assert {r.status for r in late.select("status").distinct().collect()} >= {"expired"}


def routed_of(spark, rows):
    """rows: user, text; in the order given."""
    df = spark.createDataFrame([(u, i, "user", t) for i, (u, t) in enumerate(rows)],
                               "user_id long, seq long, role string, content string")
    return cut_lineage(candidates_of(df.withColumn("ts", F.lit(None).cast("timestamp_ntz"))))


def folded(routed):
    """Items of every user after one candidate after the other, in plain Python."""
    memories = {}
    for r in jobs.candidate_rows(routed).orderBy("seq", "pos").collect():
        memories.setdefault(r.user_id, Memory()).apply(r.asDict())
    return {(u, i["type"], i["topic_key"], i["nth"], i["content"], i["version"], i["merges"] + 1)
            for u, m in memories.items() for i in m.items.values()}


def active(versions):
    return {(r.user_id, r.type, r.topic_key, r.segment, r.content, r.version, r.source_count)
            for r in memory.memory_as_of(versions).filter("status = 'active'").collect()}


def random_statements(rng, n):
    names = ["Neon", "Turso", "MySQL", "Postgres", "Postgre"]
    places = ["backend", "cache", "audit", "queue", "region", "backend cache"]
    out = []
    for _ in range(n):
        a, b = rng.sample(names, 2)
        out.append((rng.choice([1, 1, 1, 2]), rng.choice([
            f"The {rng.choice(places)} database is {a}", f"The {rng.choice(places)} is {a}",
            f"The {rng.choice(['storage', 'stack', 'ledger'])} changed from {a} to {b}",
            f"The {rng.choice(places)} was reset", f"I prefer {a}", f"I prefer {a}.",
            f"Maybe the {rng.choice(places)} database is {a}",
            f"The {rng.choice(places)} was reset; ignore {b}",
            f"Milestone {rng.randrange(30)} is release {rng.randrange(30)}"])))
    return out


def test_history_equals_the_fold(history):
    routed, versions = history
    assert active(versions) == folded(routed)


@pytest.mark.parametrize("seed", [3, 9])
def test_parts_and_chunks_equal_the_fold(spark, seed):
    routed = routed_of(spark, random_statements(random.Random(seed), 160))
    whole = H.apply_candidates(routed)
    assert active(whole) == folded(routed) and whole.count() > 40
    split = H.apply_candidates(routed, hot_rows=10, hot_chain=3, chunk=7)
    whole, split = whole.drop("correction"), split.drop("correction")
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0
    applied, parted = H.apply_in_order(routed), H.apply_in_order(routed, 10, 7, 3)
    for table in ("actions", "lineage"):
        one, two = getattr(applied, table)(), getattr(parted, table)()
        same = [c for c in one.columns if c != "reason"]
        assert one.select(same).exceptAll(two.select(same)).count() == 0
        assert one.count() == two.count()
    counts = applied.lineage().groupBy("item_id").count()
    assert whole.join(counts, "item_id").filter("count <> source_count").count() == 0


def test_near_duplicates_merge_and_corrections_end_their_target_only(spark):
    routed = routed_of(spark, [(1, t) for t in (
        "The deployment target is Lyra", "The ledger is Neon", "The cache database is Neon",
        "The storage changed from Neon to Turso", "The deployment target is Lyra.io",
        "deployment target: lyra")])
    for hot in (1000, 1):
        rows = H.apply_candidates(routed, hot_rows=hot).orderBy("started_seq").collect()
        assert [(r.content, r.version, r.source_count, r.end_status) for r in rows] == [
            ("Deployment target: Lyra", 1, 3, None), ("Ledger: Neon", 1, 1, "superseded"),
            ("Cache database: Neon", 1, 1, None), ("Database: Turso", 2, 1, None)]
        assert rows[3].supersedes_id == rows[1].item_id
        assert [r.information_gain for r in rows] == [0.05, 0.85, 0.8, 0.8]


def test_repeated_corrections_take_the_next_current_item(spark):
    routed = routed_of(spark, [(1, t) for t in (
        "The backend database is Neon", "The cache database is Neon",
        "The storage changed from Neon to Turso", "The storage changed from Neon to MySQL")])
    versions = H.apply_candidates(routed)
    assert active(versions) == folded(routed)
    assert {c for *_, c, _, _ in active(versions)} == {"Database: Turso", "Database: MySQL"}


def test_many_alternating_corrections_take_one_pass(spark):
    texts = [f"The storage changed from {a} to {b}" for a, b in
             [("Neon", "Turso"), ("Turso", "Neon")] * 1500]
    versions = H.apply_candidates(routed_of(spark, [(1, "The ledger is Neon")] + [
        (1, t) for t in texts]))
    last = versions.filter("ended_seq is null").collect()
    assert [(r.content, r.version) for r in last] == [("Database: Neon", 3001)]


def said(**more):
    return {"content": "Database: Neon", "type": "decision", "topic_key": "d", "item_topic": "d",
            "seq": 1, "authority": "user", "is_correction": False, "confidence": 0.95,
            "stability": 0.5, "old_value": "", "revokes": False, "revocation_target": "",
            "revoked_value": "", **more}


def test_speculation_cannot_replace_a_decision():
    memory_ = Memory()
    memory_.apply(said())
    action, reason, *_ = memory_.apply(said(content="Cache: Redis by far", seq=2,
                                            authority="speculation", confidence=0.55))
    assert (action, reason) == ("reject", "speculation") and len(memory_.items) == 1
    unsure = said(content="The old store: Neon", topic_key="e", item_topic="e", type="fact",
                  authority="speculation", confidence=0.99, old_value="neon", seq=3)
    assert memory_.apply(unsure)[0] == "create"


def test_stream_equals_the_fold(spark):
    routed = routed_of(spark, random_statements(random.Random(5), 80))
    rows = jobs.candidate_rows(routed)
    got = jobs.run_to_end(jobs.stream_memory(jobs.as_stream(rows, "memory-test", "seq", 5)), "mt")
    want = H.apply_in_order(routed).walked.selectExpr(
        "user_id", "seq", "pos", "action", "case when action = 'reject' then null else version end v",
        "greatest(size(revoked), 1) as n").filter("action <> 'skip'").collect()
    # The version an item has when a statement reaches it.
    assert sum(r.n for r in want) == got.count()
    key = {(r.user_id, r.seq, r.pos): (r.action, r.v) for r in want}
    for r in got.collect():
        action, version = key[r.user_id, r.seq, r.pos]
        assert r.action == action and version in (None, r.version)


def test_expansion_stops_at_cycles(spark):
    items = spark.createDataFrame(
        [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "d", None)],
        "user_id long, item_id string, supersedes_id string").withColumn(
        "status", F.lit("active"))
    seeds = items.filter("item_id = 'a'")
    got = retrieve.expand_relations(items, seeds, depth=5).orderBy("hop").collect()
    assert [(r.item_id, r.hop) for r in got] == [("b", 1), ("c", 2)]


def test_context_log(spark):
    rows = [(1, "k", "one", 60.0, "set", 1, "2024-01-01 00:00:00"),
            (1, "k", "two", 60.0, "set", 2, "2024-01-01 00:00:30"),
            (1, "gone", "x", 10.0, "set", 3, "2024-01-01 00:00:00"),
            (1, "del", "x", 0.0, "set", 4, "2024-01-01 00:00:00"),
            (1, "del", None, None, "delete", 5, "2024-01-01 00:00:10"),
            (2, "k", "x", 0.0, "set", 6, "2024-01-01 00:00:00"),
            (2, None, None, None, "clear", 7, "2024-01-01 00:00:10"),
            (3, "k", "stays", 0.0, "set", 8, "2024-01-01 00:00:00")]
    log = spark.createDataFrame(
        rows, "user_id long, key string, value string, ttl_seconds double, op string, seq long, "
        "ts string").withColumn("pos", F.lit(0)).withColumn("ts", F.to_timestamp_ntz("ts"))
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:01:00"))
    from datetime import datetime
    live = context_as_of(log, datetime(2024, 1, 1, 0, 1, 0))
    got = {(r.user_id, r.key, r.value, r.seconds_left) for r in live.collect()}
    assert got == {(1, "k", "two", 30), (3, "k", "stays", None)}
    assert "• k: stays" in context_block(live).filter("user_id = 3").first().short_term_text
    del at


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    said = [(1, t) for t in ("The database is Neon", "The framework is Hono", "The runtime is Bun",
                             "The region is eu-west-1", "The budget is 9000 dollars")]
    df = spark.createDataFrame([(u, i, "user", t) for i, (u, t) in enumerate(said)],
                               "user_id long, seq long, role string, content string")
    df = df.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    gone = spark.createDataFrame([(1, "Region: eu-west-1 is old"), (2, "x")],
                                 "user_id long, description string")
    folder = str(tmp_path / "memory")
    seen = []
    for _ in range(2):
        result = process(df, gone, folder, 7)
        stored = stored_items(spark, folder, result["items"].schema)
        seen.append(sorted((r.content, r.status, r.item_id) for r in stored.collect()))
        assert seen[-1] == sorted((r.content, r.status, r.item_id) for r in result["items"].collect())
    assert seen[0] == seen[1]
    status = {c: s for c, s, _ in seen[0]}
    assert status["Region: eu-west-1"] == "obsolete" and status["Database: Neon"] == "superseded"
    record = [c for c in status if c.startswith("Tech Stack: ")]
    assert len(record) == 1 and status[record[0]] == "active"
    counts = result["counts"].first()
    assert (counts.created, counts.obsolete, counts.consolidated) == (5, 1, 1)
    assert counts.consolidation_superseded == 3 and counts.memory_changed
