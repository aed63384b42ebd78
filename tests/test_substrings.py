"""Containment against all pairs."""

import random

import pytest

from engram.operators.evaluate import leak_report
from engram.operators.substrings import BLOCK, containment, meetings, text_id


def _texts():
    rng = random.Random(7)
    letters = "ab é"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 2, 3, 7, 40, 90)]
    long = "".join(rng.choice("abc") for _ in range(2 * BLOCK + 30))
    return [*texts, None, long, long[BLOCK - 50:BLOCK + 60], "User1 and User12", "User12"]


def _needles(texts):
    rng = random.Random(8)
    out = ["", None, "User1", "User12", "User13", "User", "nowhere", "a", "é", " "]
    for t in texts:
        for _ in range(12 if t else 0):
            a = rng.randrange(len(t))
            out.append(t[a:a + rng.choice((1, 2, 3, 5, 8, 15, 64, 65, 130))])
    long = texts[8]
    return [*out, long, long + "x", long[BLOCK - 1:BLOCK + 1], long[BLOCK - 3:BLOCK + 90]]


@pytest.mark.parametrize("keys", [["user_id"], []])
def test_containment_equals_all_pairs(spark, keys):
    texts = _texts()
    needles = _needles(texts)
    said = [(u, t) for u in (1, 2) for t in texts if u == 1 or t is None or len(t) < 50]
    asked = [(u, n) for u in (1, 2, 3) for n in needles if u == 1 or n is None or len(n) < 9]
    # Repeated rows count once; extra columns are left out.
    left = spark.createDataFrame([(*r, 0) for r in said + said[:5]],
                                 "user_id long, text string, needle int")
    right = spark.createDataFrame([(*r, "x") for r in asked + asked[:5]],
                                  "user_id long, needle string, text string")
    got = [tuple(r) for r in containment(left, right, keys).select(
        *keys, "text", "needle").collect()]
    want = {(u, t, n) if keys else (t, n) for u, t in said for v, n in asked
            if t is not None and n and (u == v or not keys) and n in t}
    assert len(got) == len(set(got)) and set(got) == want


def test_containment_of_nothing(spark):
    none = spark.createDataFrame([], "user_id long, text string, needle string")
    some = spark.createDataFrame([(1, "a", "a")], "user_id long, text string, needle string")
    assert containment(none, some, ["user_id"]).count() == 0
    assert containment(some, none, ["user_id"]).count() == 0


def test_needles_with_one_beginning_meet_only_their_own_texts(spark):
    """Candidates are the results, though all needles share a beginning."""
    names = spark.range(1, 1000).selectExpr("id AS user_id", "concat('User', id) AS secret")
    texts = names.selectExpr("user_id", "concat('my name is ', secret, ' here') AS text")
    source = texts.select("text").withColumn("text_id", text_id("text"))
    met = meetings(source, names.selectExpr("secret AS needle"), [])
    # A name is in its own text and in those of names that it begins.
    assert met.count() == 9 * 111 + 90 * 11 + 900
    leaks = leak_report(names, texts.selectExpr("user_id", "user_id AS output_id", "text"))
    assert leaks.count() == 9 * 111 + 90 * 11 + 900 - 999
