"""Selection, similarity, rates, streams and evaluation against brute force."""

import itertools
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from engram.functions.similarity import (
    information_gain, lcs_ratio, near_duplicates, similar_texts,
)
from engram.operators import evaluate, rates
from engram.operators.external import union_candidates
from engram.operators.messages import detect_delta
from engram.operators.select import select_for_budget
from engram.streaming import jobs


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_ratio():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))) for _ in "xy")
        x, y = a.strip(), b.strip()
        want = 1.0 if x == y else 0.0 if not x or not y else 2 * brute_lcs(x, y) / (
            len(x) + len(y))
        assert lcs_ratio(a, b) == pytest.approx(want)


def test_similarity_joins_miss_nothing(spark):
    rng = random.Random(2)
    words = ["neon", "postgres", "region", "budget", "redis", "naming"]
    texts = [" ".join(rng.choices(words, k=4))[: rng.randint(6, 22)] for _ in range(40)]
    texts += [t + "s" for t in texts[:15]] + [t[1:] for t in texts[:10]]
    said = [(rng.choice([1, 2]), "fact", i, t) for i, t in enumerate(texts)]
    items = [(u, "fact", f"i{i}", i, t) for u, _, i, t in said[::2]]
    c = spark.createDataFrame(said, "user_id long, type string, seq long, content string")
    known = spark.createDataFrame(
        items, "user_id long, type string, item_id string, started_seq long, content string")
    got = {r.seq: r.duplicate_of for r in near_duplicates(c, known).collect()}
    gains = {r.seq: r.information_gain for r in information_gain(c, known).collect()}
    for u, _, seq, t in said:
        sims = [(lcs_ratio(t, k[4]), k[3], k[2]) for k in items if k[0] == u]
        close = sorted((n, i) for s, n, i in sims if s >= 0.9)
        assert got[seq] == (close[0][1] if close else None)
        best = max(s for s, _, _ in sims)
        assert gains[seq] == (0.05 if best >= 0.92 else 0.25 if best >= 0.75 else 0.8)


def test_budget_selection(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for req in range(12):
        budget = rng.choice([10, 25, 40])
        items = [(req, f"m{i}", i, rng.randint(3, 9), round(rng.random(), 4), i == 0, budget)
                 for i in range(9)]
        rows += items
        left = budget - items[0][3]
        options = items[1:]
        best = max((sum(x[4] for x in s) for n in range(len(options) + 1)
                    for s in itertools.combinations(options, n)
                    if sum(x[3] for x in s) <= left), default=0) if left > 0 else 0
        want[req] = best
    df = spark.createDataFrame(
        rows, "request_id long, item_key string, ordinal int, token_cost long, score double, "
        "mandatory boolean, budget int")
    got = {}
    for r in select_for_budget(df).collect():
        got.setdefault(r.request_id, []).append(r)
    for req, chosen in got.items():
        assert any(r.mandatory for r in chosen)
        assert sum(r.score for r in chosen if not r.mandatory) == pytest.approx(want[req])
        optional = sum(r.token_cost for r in chosen if not r.mandatory)
        assert optional <= max(0, chosen[0].budget - sum(
            r.token_cost for r in chosen if r.mandatory))


def test_greedy_selection_with_pruning(spark):
    rng = random.Random(6)
    rows = [(1, f"m{i}", i, rng.randint(2, 40), round(rng.random(), 4), False, 4000)
            for i in range(400)]
    df = spark.createDataFrame(
        rows, "request_id long, item_key string, ordinal int, token_cost long, score double, "
        "mandatory boolean, budget int")
    left, want = 4000, set()
    for r in sorted(rows, key=lambda r: (-(r[4] / r[3]), r[2])):
        if r[3] <= left:
            want.add(r[1])
            left -= r[3]
    assert {r.item_key for r in select_for_budget(df).collect()} == want


def test_greedy_pruning_keeps_ties_and_free_items(spark):
    rng = random.Random(16)
    rows = [(1, f"m{i}", i, rng.choice([0, 3, 3, 7]), rng.choice([0.2, 0.4]), False, 30)
            for i in range(60)]
    df = spark.createDataFrame(
        rows, "request_id long, item_key string, ordinal int, token_cost long, score double, "
        "mandatory boolean, budget int")
    left, want = 30, set()
    for r in sorted(rows, key=lambda r: (-(r[4] / max(r[3], 1)), r[2])):
        if r[3] <= left:
            want.add(r[1])
            left -= r[3]
    chosen = select_for_budget(df, "greedy").collect()
    assert {r.item_key for r in chosen} == want
    assert {r.selection for r in chosen} == {"greedy"}
    exact = select_for_budget(df, "exact").collect()
    assert {r.selection for r in exact} == {"exact"}
    assert sum(r.score for r in exact) >= sum(r.score for r in chosen) - 1e-9


def test_one_new_row_per_message(spark):
    rows = [(1, "k", 5, "b"), (1, "k", 5, "b"), (1, "k", 5, "a"), (1, "j", 7, "c"), (2, "k", 1, "d")]
    batch = spark.createDataFrame(rows, "user_id long, message_key string, ordinal int, content string")
    archive = spark.createDataFrame([(2, "k")], "user_id long, message_key string")
    got = Counter((r.user_id, r.message_key, r.content, r.delta_status)
                  for r in detect_delta(batch, archive).collect())
    assert got == {(1, "k", "a", "new"): 1, (1, "k", "b", "duplicate"): 2, (1, "j", "c", "new"): 1,
                   (2, "k", "d", "duplicate"): 1}


def test_stream_context_operations(spark):
    rows = [(1, "k", "one", 0.0, "set", 1, 0), (1, "gone", "x", None, "set", 2, 1),
            (1, "gone", None, None, "delete", 3, 2), (1, "gone", "late", 0.0, "set", 0, 2),
            (2, "k", "x", 0.0, "set", 4, 0), (2, None, None, None, "clear", 5, 3),
            (2, "k", "after", 5.0, "set", 6, 4), (3, "k", "old", 0.0, "set", 9, 1),
            (3, "k", "new", 0.0, "set", 8, 2), (4, "z", "end", 0.0, "set", 10, 9000)]
    log = spark.createDataFrame(
        rows, "user_id long, key string, value string, ttl_seconds double, op string, seq long, "
        "s long").select("*", F.lit(0).alias("pos"), F.timestamp_seconds(F.col("s") + 1700000000).alias("ts"))
    events = jobs.run_to_end(jobs.stream_context(
        jobs.as_stream(log, "ops", "s", 1), "0 seconds"), "ops").collect()
    got = {(r.user_id, r.key, r.value, r.event) for r in events}
    assert got == {(1, "k", "one", "set"), (1, "gone", "late", "deleted"), (2, "k", "after", "set"),
                   (2, "k", "after", "expired"), (3, "k", "new", "set"), (4, "z", "end", "set")}


def test_rates_across_blocks(spark):
    rng = random.Random(7)
    seconds = sorted(rng.sample(range(0, 600), 200))
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(seconds)],
                               "k long, id long, s long").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    for r in rates.rate_counts(df, "k", 15, 60).collect():
        inside = [x for x in seconds if r.s - 60 <= x <= r.s]
        assert r.request_count == len(inside) and r.over_limit == (len(inside) > 15)
        if r.over_limit:
            assert r.retry_after == max(1, inside[0] + 60 - r.s)


def test_grading_and_latency(spark):
    df = spark.createDataFrame([
        ("a", "It is Kim", "kim"), ("a", "we are AGAINST it", "no / against"), ("b", "x", "y"),
    ], "path string, answer string, expected string")
    got = {r.path: r.accuracy for r in evaluate.recall_report(df, ["path"]).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    values = [5.0, 1.0, 9.0, 3.0, 3.0, 7.0]
    runs = spark.createDataFrame([("r", v) for v in values], "run string, ms double")
    r = evaluate.latency_report(runs, "run", "ms").first()
    s = sorted(values)
    assert (r.n, r.p50_ms, r.p95_ms) == (6, s[3], s[5])


def test_percentiles_of_skewed_runs(spark):
    runs = {
        "outlier": [float(v * 7919 % 5000) for v in range(5000)] + [1e12],
        "ties": [1.0] * 4700 + [2.0] * 280 + [float(v) for v in range(20)],
        "steep": [1.5 ** (v % 70) for v in range(3000)],
        "single": [4.0], "unknown": [3.0, None, 1.0],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in runs.items() for v in vs],
                                 "run string, ms double")
    for accuracy in (10_000, 20):
        got = {r.run: (r.n, r.p50_ms, r.p95_ms) for r in
               evaluate.latency_report(rows, "run", "ms", accuracy).collect()}
        for run, values in runs.items():
            s, n = sorted(values, key=lambda v: (v is None, v)), len(values)
            assert got[run] == (n, *(s[min(n - 1, int(n * p))] for p in (0.5, 0.95))), run


def test_union_of_candidates(spark):
    schema = "id long, pos int, candidate_content string"
    a = spark.createDataFrame([(1, 0, "Neon")], schema)
    b = spark.createDataFrame([(1, 0, "neon"), (1, 1, "Go"), (1, 2, "go"), (2, 0, "Neon")], schema)
    got = sorted((r.id, r.candidate_content) for r in union_candidates(a, b, ["id"]).collect())
    assert got == [(1, "Go"), (1, "Neon"), (2, "Neon")]


def test_streams_match_batch(spark):
    rows = [(u, f"k{n % 4}", n) for n, u in enumerate([1, 1, 2, 1, 2, 2, 1, 1, 2, 1, 1, 2])]
    df = spark.createDataFrame(rows, "user_id long, message_key string, seq long").withColumn(
        "ts", F.timestamp_seconds(F.lit(1700000040) + F.col("seq") * 30))
    kept = jobs.run_to_end(jobs.stream_dedupe(jobs.as_stream(df, "d", "seq"), "1 day"), "dedupe")
    assert kept.count() == len({(u, k) for u, k, _ in rows})
    counted = jobs.run_to_end(jobs.stream_rates(
        jobs.as_stream(df, "r", "seq"), "user_id", "1 minute", "1 minute", "0 seconds"), "rates")
    want = Counter((n * 30 // 60, u) for u, _, n in rows)
    got = {((int(r.s) - 1700000040) // 60, r.user_id): r.requests
           for r in counted.withColumn("s", F.unix_timestamp("window_start")).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    log = df.selectExpr("user_id", "message_key AS key", "concat('v', seq) AS value",
                        "60.0D AS ttl_seconds", "seq", "0 AS pos", "ts")
    events = jobs.run_to_end(jobs.stream_context(
        jobs.as_stream(log, "c", "seq"), "0 seconds"), "context").collect()
    last = {}
    for u, k, n in rows:
        last[(u, k)] = n
    sets = {}
    for e in events:
        if e.event == "set":
            sets[(e.user_id, e.key)] = max(sets.get((e.user_id, e.key), -1), e.seq)
    assert sets == last and any(e.event == "expired" for e in events)


@pytest.mark.parametrize("name", [
    "message_keys", "request_messages", "request_tokens", "archive_ingest", "stream_rates",
    "message_delta", "keywords", "rate_counts",
    "latency_report", "version_proposals"])
def test_registered_queries_match_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("events", "conversations", "documents", "customer", "orders"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchall()
    cols = [d[0] for d in db.description]
    got = [tuple(r) for r in entry.queries()[name](spark, sf_dir).select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.85, 0.75])
def test_similar_texts_equal_all_pairs(spark, threshold):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 2, 3, 9, 20, 46, 48, 50, 60])))
            for _ in range(40)]

    def edited():
        text = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randrange(len(text) + 1)
            if rnd.random() < 0.5:
                del text[at:at + 1]
            else:
                text.insert(at, rnd.choice("abcd "))
        return rnd.randint(1, 2), "".join(text)
    left, right = ([edited() for _ in range(200)] for _ in range(2))
    want = {}
    for k, a in left:
        for j, b in right:
            a, b = a.strip(" "), b.strip(" ")
            if j == k and lcs_ratio(a, b) >= threshold:
                want[k, a, b] = lcs_ratio(a, b)
    got = similar_texts(spark.createDataFrame(left, "k int, text string"),
                        spark.createDataFrame(right, "k int, text string"), ["k"], threshold)
    assert {(r.k, r.left_text, r.right_text): r.similarity for r in got.collect()} == want
    assert got.count() == len(want)
