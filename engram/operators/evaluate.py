"""Evaluation and metrics jobs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import fixed_values as V
from engram.functions.sql import col
from engram.functions.text import estimate_tokens, message_tokens
from engram.operators.substrings import containment, text_id


def grade_answers(answers: DataFrame) -> DataFrame:
    """Adds correct: the expected text is in the answer; 'a / b' accepts any part."""
    answer, expected = F.lower("answer"), F.lower("expected")
    parts = F.transform(F.split(expected, "/"), lambda p: F.trim(p))
    any_part = F.exists(parts, lambda p: answer.contains(p))
    return answers.withColumn("correct", answer.contains(expected) | (
        expected.contains("/") & any_part))


def recall_report(answers: DataFrame, by: list[str]) -> DataFrame:
    """``answers`` graded already (correct), or with answer and expected."""
    graded = answers if "correct" in answers.columns else grade_answers(answers)
    return graded.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if("correct").alias("correct"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"))


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of every request."""
    w = Window.partitionBy("request_id").orderBy(F.col("ordinal").desc())
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def token_costs(messages: DataFrame) -> DataFrame:
    """request_id, ordinal and tokens of every message: what totals need, without its text."""
    return messages.selectExpr("request_id", "ordinal", f"{message_tokens(col('content'))} AS t")


def token_total(costs: DataFrame, name: str) -> DataFrame:
    return costs.groupBy("request_id").agg((F.sum("t") + 3).alias(name))


def compression_report(messages: DataFrame, compiled_stats: DataFrame, n: int) -> DataFrame:
    """Tokens of the full transcript, the last n messages and the compiled context."""
    costs = token_costs(messages)
    full = token_total(costs, "full_tokens")
    recent = token_total(recent_messages(costs, n), "recent_tokens")
    rows = full.join(recent, "request_id").join(compiled_stats.select(
        "request_id", F.col("total_tokens").alias("compiled_tokens")), "request_id")
    return rows.withColumn("reduction_pct", F.round(
        F.lit(100.0) * (F.col("full_tokens") - F.col("compiled_tokens")) / F.col("full_tokens"),
        1))


def grade_questions(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds correct: any fact of the question's user holds the expected text ('a / b': a part).

    ``questions``: user_id, expected; ``facts``: user_id, content.  Distinct questions meet
    the facts by user, and no user's facts are put together.
    """
    asked = questions.select("user_id", "expected").distinct()
    pairs = asked.join(facts.select("user_id", F.col("content").alias("answer")).distinct(),
                       "user_id", "left").na.fill("", ["answer"])
    graded = grade_answers(pairs).groupBy("user_id", "expected").agg(
        F.bool_or("correct").alias("correct"))
    return questions.join(graded, ["user_id", "expected"])


def latency_report(samples: DataFrame, run: str, latency: str,
                   accuracy: int = 10_000) -> DataFrame:
    """Mean and nearest-rank percentiles per run: element min(n - 1, floor(n p)) of the
    sorted values, nulls last.

    A mergeable rank summary (combined before the shuffle) brackets each rank to about
    4 / accuracy of the run, however the values are spread.  Exact counts tell which bracket
    holds a rank; only its distinct values are sorted, so a summary that is off costs time only."""
    shares, margin = (0.5, 0.95), 2 / accuracy
    marks = [min(1.0, max(0.0, p + d)) for p in shares for d in (-margin, margin)]
    totals = samples.groupBy(run).agg(
        F.count("*").alias("n"), F.avg(latency).alias("avg_ms"),
        F.percentile_approx(latency, marks, accuracy).alias("_edges"))
    above = [F.coalesce((F.col(latency) >= F.col("_edges")[i]).cast("int"), F.lit(1))
             for i in range(len(marks))]
    placed = samples.select(run, latency).join(totals.select(run, "_edges"), run).select(
        run, latency, reduce(add, above).alias("_bucket"))
    upto = Window.partitionBy(run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.groupBy(run, "_bucket").agg(F.count("*").alias("_n")).withColumn(
        "_c", F.sum("_n").over(upto))
    ranks = totals.select(run, "n", F.explode(F.array(*[F.struct(
        F.lit(p).alias("p"), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
        .alias("rank")) for p in shares])).alias("_q")).select(run, "_q.*")
    wanted = ranks.join(filled, run).filter("rank < _c and rank >= _c - _n").select(
        run, "p", "_bucket", (F.col("rank") - F.col("_c") + F.col("_n")).alias("_inner"))
    near = (placed.join(wanted.select(run, "_bucket").distinct(), [run, "_bucket"], "left_semi")
            .groupBy(run, "_bucket", latency).agg(F.count("*").alias("_m")))
    within = (Window.partitionBy(run, "_bucket").orderBy(F.asc_nulls_last(latency))
              .rowsBetween(Window.unboundedPreceding, 0))
    found = (near.withColumn("_d", F.sum("_m").over(within)).join(wanted, [run, "_bucket"])
             .filter("_d > _inner").groupBy(run).agg(
                 F.min(F.when(F.col("p") == 0.5, F.col(latency))).alias("p50_ms"),
                 F.min(F.when(F.col("p") == 0.95, F.col(latency))).alias("p95_ms")))
    return totals.join(found, run).select(
        run, "n", F.round("avg_ms", 1).alias("avg_ms"), "p50_ms", "p95_ms")


def cost_report(tokens: DataFrame, sizes: list[int], output_tokens: int = 5) -> DataFrame:
    """Dollar cost per variant for a number of conversations.

    ``tokens``: variant, prompt_tokens (a few rows); each is repeated per size."""
    price = (F.col("prompt_tokens") * V.INPUT_PRICE_PER_MILLION
             + F.lit(output_tokens * V.OUTPUT_PRICE_PER_MILLION)) / 1e6
    return tokens.withColumn("conversations", F.explode(F.array(*[F.lit(n) for n in sizes]))
                             ).withColumn("cost_usd", F.round(price * F.col("conversations"), 4))


def leak_report(secrets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs of one user that contain another user's secret.

    ``secrets``: user_id, secret.  ``outputs``: user_id, output_id, text."""
    found = containment(outputs.select("text"), secrets.select(F.col("secret").alias("needle")),
                        [])
    said = outputs.select(F.col("user_id").alias("reader_id"), "output_id",
                          text_id("text").alias("text_id"))
    return (found.drop("text").join(said, "text_id")
            .join(secrets.withColumnRenamed("user_id", "owner_id"),
                  F.col("needle") == F.col("secret"))
            .filter("reader_id <> owner_id")
            .select("owner_id", "reader_id", "output_id", "secret"))


def text_tokens(rows: DataFrame, text: str) -> DataFrame:
    return rows.selectExpr("*", str(estimate_tokens(col(text)).alias("tokens")))
