"""Joins on texts and retrieval: the same rows by every route, nothing large in one place."""

import random

import pytest

from engram.functions import similarity
from engram.functions.similarity import lcs_ratio, similar_texts
from engram.operators import substrings
from engram.operators.retrieve import memories_for_requests
from engram.operators.substrings import containment


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(seed, count):
    rnd = random.Random(seed)
    return [(rnd.randint(1, 4), "the region is " + "".join(rnd.choice("ab ") for _ in range(
        rnd.randint(0, 9)))) for _ in range(count)]


def test_exploded_pieces_are_not_broadcast(spark):
    """A text becomes hundreds of rows; Spark takes them for as small as the text."""
    rows = spark.range(20).selectExpr("int(id % 4) AS k", "concat('the region is ', id) AS t")
    pairs = similarity._by_pieces(rows, rows, ["k"], 0.9)
    assert "BroadcastHashJoin" not in _plan(pairs)


@pytest.mark.parametrize("direct", [0, 1000])
@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_similar_texts_by_both_routes(spark, monkeypatch, direct, threshold):
    monkeypatch.setattr(similarity, "DIRECT_PAIRS", direct)
    left, right = _texts(2, 60), _texts(3, 60) + [(None, "the region is a")]
    want = {(k, a.strip(" "), b.strip(" ")) for k, a in left for j, b in right
            if j == k and lcs_ratio(a.strip(" "), b.strip(" ")) >= threshold}
    got = [tuple(r)[:3] for r in similar_texts(
        spark.createDataFrame(left, "k int, text string"),
        spark.createDataFrame(right, "k int, text string"), ["k"], threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("direct", [0, 1000])
def test_containment_by_both_routes(spark, monkeypatch, direct):
    monkeypatch.setattr(substrings, "DIRECT_PAIRS", direct)
    texts = _texts(4, 40) + [(1, None), (None, "region"), (1, "")]
    needles = [(k, t[n:n + 6] if t else t) for n, (k, t) in enumerate(_texts(5, 40))] + [
        (1, None), (None, "reg"), (1, "")]
    want = {(k, t, n) for k, t in texts for j, n in needles
            if k is not None and k == j and t and n and n in t}
    got = [tuple(r) for r in containment(
        spark.createDataFrame(texts, "k int, text string"),
        spark.createDataFrame(needles, "k int, needle string"), ["k"]).select(
        "k", "text", "needle").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_requests_choose_items_by_number(spark):
    """Texts of items meet the requests once the choice is made, not before."""
    items = spark.createDataFrame(
        [(1, f"i{n}", "fact", "user" if n % 2 else "project", "t" if n > 68 else "",
          f"the region is r{n}", "", "", "", n, 1, "active" if n != 5 else "superseded",
          "i5" if n == 69 else None) for n in range(70)],
        "user_id long, item_id string, type string, scope string, topic_key string, "
        "content string, value string, predicate string, subject string, updated_seq long, "
        "version long, status string, supersedes_id string")
    requests = spark.createDataFrame(
        [(1, 1, ["r69"], True), (2, 1, ["r69"], False), (3, 1, [], False), (4, 2, ["r1"], True)],
        "request_id long, user_id long, ranked_words array<string>, wants_history boolean")
    got = memories_for_requests(requests, items, ("ranked_words",))
    for node in _nodes(got._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() == "Window" and "request_id" in node.partitionSpec().mkString():
            assert "content" not in node.output().mkString(",")
    rows = {(r.request_id, r.item_id): (r.tier, r._rank, r.content) for r in got.collect()}
    recent, durable = range(50, 70), range(1, 70, 2)
    durable = sorted(durable, reverse=True)[:40]
    tiers = {69: 1} | {n: 2 for n in recent if n != 69} | {
        n: 3 for n in durable if n not in recent and n != 5}
    for request, extra in ((1, {5: 4}), (2, {})):
        want = tiers | extra
        order = sorted(want, key=lambda n: (want[n], -n))
        assert {k[1]: v for k, v in rows.items() if k[0] == request} == {
            f"i{n}": (want[n], order.index(n) + 1, f"the region is r{n}") for n in want}
    third = {f"i{n}": 1 for n in range(30, 70)} | {
        f"i{n}": 3 for n in durable if n < 30 and n != 5}
    assert {k[1]: v[0] for k, v in rows.items() if k[0] == 3} == third
    assert not any(k[0] == 4 for k in rows)
