"""Compiling: a request stays one row until its memories are text; batches store candidates once."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from engram.functions import fixed_values as V
from engram.operators import compile as C
from engram.operators import evaluate, retrieve
from engram.operators.select import select_for_budget, select_lists
from engram.plans import incremental, queries


def _items(spark, n=6):
    rows = [(u, f"i{u}-{k}", kind, "user" if k % 2 else "project", f"t{k}", f"the {kind} is r{k}",
             "", "", "", k, 1, "active", None, 0.9, 0.8, 1.0, 0.5, 0.85)
            for u in (1, 2) for k, kind in zip(range(n), ("fact", "preference", "open_task") * n)]
    return spark.createDataFrame(
        rows, "user_id long, item_id string, type string, scope string, topic_key string, "
        "content string, value string, predicate string, subject string, updated_seq long, "
        "version long, status string, supersedes_id string, confidence double, "
        "importance double, freshness double, stability double, information_gain double")


def _short_term(spark):
    return spark.createDataFrame([(2, "Short: x", 1)], "user_id long, short_term_text string, "
                                 "short_term_items long")


LONG = "\n".join(f"line {i} " + "x" * 100 for i in range(20))


def _messages(spark):
    rows = [(1, 1, 0, "system", "You help."), (1, 1, 1, "user", "what is r3?"),
            # No system message; a tool output that is shortened.
            (2, 2, 0, "user", "hello there"), (2, 2, 1, "tool", LONG), (2, 2, 2, "user", "and r1?"),
            # A user without memories: passed through as it came.
            (3, 9, 0, "tool", LONG), (3, 9, 1, "user", None),
            (4, 1, 0, "system", "You help."), *[
                (4, 1, i, "user", f"message {i} " + "word " * 9) for i in range(1, 9)]]
    return spark.createDataFrame(rows, "request_id long, user_id long, ordinal int, role string, "
                                 "content string")


@pytest.fixture
def stored(monkeypatch):
    """Columns of everything that is stored."""
    seen = []
    real = DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a, **k: seen.append(df.columns)
                        or real(df, *a, **k))
    for module in (C, retrieve, incremental):
        if hasattr(module, "written"):
            keep = module.written
            monkeypatch.setattr(module, "written", lambda df, keep=keep: seen.append(df.columns)
                                or keep(df))
    return seen


def test_texts_of_memories_are_not_stored(spark, stored):
    compiled, stats = C.compile_context(_messages(spark), _items(spark), _short_term(spark))
    got = {r.request_id: r for r in stats.collect()}
    assert compiled.count() == sum(r.messages_out for r in got.values())
    assert not [c for c in stored if {"line", "memory_text", "position"} & set(c)]
    # Stored by request: the requests and their messages; nothing per request and memory.
    assert not [c for c in stored if "request_id" in c and "item_id" in c]


def test_compiled_contexts(spark):
    compiled, stats = C.compile_context(_messages(spark), _items(spark), _short_term(spark))
    said = {}
    for r in compiled.orderBy("request_id", "position").collect():
        said.setdefault(r.request_id, []).append((r.position, r.role, r.content))
    facts = ["the fact is r3", "the fact is r0"]
    block = "\n".join([V.MEMORY_BLOCK_TITLE, "• Fact:", *[f"  - {x}" for x in facts],
                       "• Open Task:", "  - the open_task is r5", "  - the open_task is r2",
                       "• Preference:", "  - the preference is r4", "  - the preference is r1"])
    lines = said[1][0][2].split("\n")
    assert said[1][0][2].startswith("You help.\n\n" + V.MEMORY_BLOCK_TITLE)
    assert sorted(lines) == sorted(["You help.", "", *block.split("\n")])
    heads = [x for x in lines if x.startswith("•")]
    assert heads == ["• Fact:", "• Open Task:", "• Preference:"]
    front = said[2][0]
    assert front[:2] == (0, "system") and front[2].endswith("\n\nShort: x")
    assert [r for _, r, _ in said[2][1:]] == ["user", "tool", "user"]
    assert "[tool output truncated" in said[2][2][2]
    assert [c for _, _, c in said[3]] == [LONG, None]
    got = {r.request_id: r for r in stats.collect()}
    assert [got[n].pass_through for n in (1, 2, 3, 4)] == [False, False, True, False]
    assert [got[n].memories_used for n in (1, 2, 3)] == [6, 6, 0]
    assert [got[n].selected_count for n in (1, 2, 3)] == [8, 9, 2]
    assert got[1].total_tokens == 3 + sum(
        r.t for r in compiled.filter("request_id = 1").selectExpr(
            f"{C.message_tokens(C.col('content'))} AS t").collect())


def test_small_budget_keeps_what_rows_would(spark):
    """Request by request as arrays, or row by row: the same items are chosen."""
    rng = random.Random(3)
    rows = [(q, f"m{i}" if i else None, i if i != 4 else None, rng.randint(0, 9),
             round(rng.random(), 4), i == 1, rng.choice([0, 5, 20, 60]) if not i else 20)
            for q in range(30) for i in range(9)]
    df = spark.createDataFrame(
        rows, "request_id long, item_key string, ordinal int, token_cost long, score double, "
        "mandatory boolean, budget int")
    lists = df.groupBy("request_id").agg(F.max("budget").alias("budget"), F.collect_list(F.struct(
        "item_key", "ordinal", "token_cost", "mandatory", "score")).alias("o"))
    for method in ("exact", "greedy", "cells"):
        by_row = {}
        for r in select_for_budget(df, method).collect():
            by_row.setdefault(r.request_id, set()).add((r.item_key, r.selection))
        for r in select_lists(lists, "o", method).collect():
            keys = {o.item_key for o in r.o if r._all or o.mandatory or o.item_key in (
                r._picked or ()) and o.item_key is not None}
            assert by_row.get(r.request_id, set()) == {(k, r.selection) for k in keys}
            costs = [o.token_cost for o in r.o if o.item_key in (r._picked or ())]
            assert sum(costs) <= max(r.remaining, 0)
    budget = 90
    compiled, stats = C.compile_context(_messages(spark), _items(spark), _short_term(spark), budget)
    got = {r.request_id: r for r in stats.collect()}
    assert got[4].selection == "exact" and 2 <= got[4].messages_out < 9
    assert compiled.filter("request_id = 4").agg(F.max("position")).first()[0] + 1 == got[
        4].messages_out

def test_compression_counts_tokens_before_it_ranks(spark):
    costs = evaluate.token_costs(_messages(spark))
    assert costs.columns == ["request_id", "ordinal", "t"]
    rows = evaluate.compression_report(_messages(spark), spark.createDataFrame(
        [(n, 20) for n in (1, 2, 3, 4)], "request_id long, total_tokens long"), 2)
    t = {}
    for r in costs.orderBy("request_id", "ordinal").collect():
        t.setdefault(r.request_id, []).append(r.t)
    got = {r.request_id: (r.full_tokens, r.recent_tokens) for r in rows.collect()}
    assert got == {q: (sum(x) + 3, sum(x[-2:]) + 3) for q, x in t.items()}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not [x for x in plan.split("\n") if "Window" in x and "content" in x]


def test_a_batch_stores_its_candidates_once(spark, tmp_path, stored):
    from tests.test_incremental import SAID, _messages as said
    result = incremental.process_batch(said(spark, SAID[:5]), str(tmp_path / "m"), 0)
    assert result["items"].count() == 5
    assert len([c for c in stored if "candidate_content" in c]) == 1


def test_requests_are_dealt_out_to_every_core(spark, sf_dir):
    """The conversations are one file; their messages are scored in more tasks than one."""
    said = queries._requests(spark, sf_dir).filter("request_id >= 1000000000")
    tasks = {r.p for r in said.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(tasks) >= spark.sparkContext.defaultParallelism
