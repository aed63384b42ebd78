"""Request rates per client over a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import fixed_values as V


def rate_counts(events: DataFrame, key: str, limit: int = V.RATE_LIMIT,
                window_seconds: int = V.RATE_WINDOW_SECONDS) -> DataFrame:
    """Adds request_count (requests of the key in the window ending at the row),
    over_limit and retry_after (seconds until the oldest counted request leaves).

    A key is cut into time blocks of one window length; a row needs only its own block
    and the one before, so each block is read together with a copy of the previous one
    and even a very busy key spreads over as many groups as it has blocks."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = window_seconds * 1_000_000
    timed = events.withColumn("_us", micros).withColumn("_b", F.floor(F.col("_us") / span))
    spread = timed.withColumn("_block", F.explode(F.array("_b", F.col("_b") + 1)))
    w = (Window.partitionBy(key, "_block").orderBy("_us").rangeBetween(-span, 0))
    counted = spread.withColumn("request_count", F.count("*").over(w)).withColumn(
        "_oldest", F.min("_us").over(w)).filter("_block = _b")
    wait = F.ceil((F.col("_oldest") + span - F.col("_us")) / 1_000_000)
    over = F.col("request_count") > limit
    return counted.withColumn("over_limit", over).withColumn("retry_after", F.when(
        over, F.greatest(wait, F.lit(1)))).drop("_us", "_b", "_block", "_oldest")
