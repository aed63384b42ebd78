"""Rules are evaluated once, and cheap tests before dear ones change no result."""

import pandas as pd
from pyspark.sql import functions as F

from engram.functions import fixed_values as V
from engram.functions.classify import is_interrogative, is_low_info
from engram.functions.regex import beginnings, jvm, matches, strip
from engram.functions.sql import col
from engram.functions.text import clean_value, normalize_utterance
from engram.operators.extract import _nfkc_each, extract_candidates

TEXTS = [
    None, "", " ", "\t\n\x0b\f\r ", "Maybe we use Redis", "maybes", "xmaybe", "NOT SURE.", "unsure!",
    "We will USE it for now", "use for", "I changed from a to b", "switch to x", "not a, but b",
    "what", " ?! Which !", "which.one", "Is it on", "island", "isn't it?", "ok, thanks!", "++",
    " what ", "WHİCH", "Kwhat", "''quoted''?!.", "\"'", "a.'", "wie geht’s?",
    "please tell me more", "Let me know", "We switched to Neon", "summarizing", "summariz",
]


def test_word_lists_are_looked_for_as_plain_text():
    assert "maybe" in beginnings(V.SPECULATIVE) and "use " in beginnings(V.DECISION_MARKER)
    assert beginnings(r"\b(colou?r|x)\b") == ("colo", "x")
    assert beginnings(r"\b(a|[bc])\b") == beginnings(V.BUILDING) == ()


def test_plain_text_first_changes_no_match(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    lists = [v for v in vars(V).values() if isinstance(v, str) and beginnings(v)]
    assert len(lists) >= 5
    got = rows.selectExpr("text", *[f"{matches(col('text'), p)} AS a{i}"
                                    for i, p in enumerate(lists)]).collect()
    want = rows.selectExpr("text", *[f"{col('text').rlike(jvm(p))} AS a{i}"
                                     for i, p in enumerate(lists)]).collect()
    assert got == want


def test_trimming_and_words_as_before(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    space, mark = r"^\s+|\s+\z", r"[^\w\s+]+"

    def bare(c):
        return F.regexp_replace(c, space, "")
    unquoted = F.regexp_replace(bare("text"), "^['\"`]+|['\"`]+\\z", "")
    folded = F.regexp_replace(bare(F.lower("text")), mark, " ")
    for got, want in (
            (strip(col("text")), bare("text")),
            (clean_value(col("text")), bare(F.regexp_replace(unquoted, r"[.!?]+\z", ""))),
            (normalize_utterance(col("text")),
             bare(F.regexp_replace(folded, r"\s+", " ")))):
        assert rows.filter(~F.expr(str(got)).eqNullSafe(want)).collect() == []


def test_questions(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    asked = {r["text"] for r in rows.filter(str(is_interrogative(col("text")))).collect()}
    assert asked == {"what", " ?! Which !", "Is it on", "isn't it?", " what ",
                     "wie geht’s?", "please tell me more", "Let me know"}
    low = rows.withColumn("role", F.lit("user")).filter(str(is_low_info(col("text"), col("role"))))
    assert {r["text"] for r in low.collect()} == {
        "", " ", "\t\n\x0b\f\r ", "what", " ?! Which !", "ok, thanks!", "++", " what ",
        "\"'"}


def test_foreign_sentences_travel_as_text(spark):
    given = _nfkc_each.func(pd.Series(['["\u2460", "a\\"b"]', None]))
    assert given[0] == ["1", 'a"b'] and given[1] is None
    said = spark.createDataFrame([("user", "I prefer caf\u00e9 \u2460. My name is Zo\u00eb.")],
                                 "role string, content string")
    found = extract_candidates(said).collect()
    assert {r["candidate_content"] for r in found} == {"caf\u00e9 \u2460", "Name: Zo\u00eb"}
