"""The whole pass, a batch of messages at a time.

A batch stores its candidates, then re-evaluates the users that it names and no others: their
candidates of all batches are applied in order again, so that many batches end where one pass
over everything would.  What a user's latest batch wrote is what holds.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.external import parse_candidates, with_external
from engram.operators.history import apply_in_order, versions_of
from engram.operators.store import commit, committed, latest_of_users, with_expiry
from engram.plans.pipeline import (
    _passed, archived_utterances, candidates_of, obsolete_sayings,
)
from engram.session import shared_folder, written

_halves: dict[tuple[str, str], dict[str, DataFrame]] = {}

RESULTS = ("items", "status", "snapshot", "counts", "context")


def _so_far(fresh: DataFrame, folder: str, name: str, batch: int, users: DataFrame) -> DataFrame:
    """Rows of this batch and the same users' rows of earlier ones."""
    if batch == 0:
        return fresh
    earlier = committed(fresh.sparkSession, folder, name, fresh.schema).filter(
        F.col("batch") < batch).drop("batch")
    return fresh.unionByName(earlier.join(users, "user_id", "left_semi"))


def process_batch(messages: DataFrame, folder: str, batch: int,
                  descriptions: DataFrame | None = None,
                  responses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Adds a batch (numbered from 0) and returns the results of the users it names.

    ``messages``: user_id, seq, ts, role, content, with seq rising over the batches of a user or
    not; ``descriptions``: user_id, description of what is obsolete; ``responses``: message_id
    (a seq of this batch), user_id, response, what an external extractor returned.  An empty
    batch changes nothing; rows without a user belong to nobody and are left out.  The latest
    batch may be run again, which changes nothing; a batch before it may not.  Messages must be
    new (see pipeline.ingest): one that is repeated counts again.
    """
    spark = messages.sparkSession
    messages = messages.filter("user_id is not null")
    if descriptions is None:
        descriptions = spark.sql("SELECT 0L AS user_id, '' AS description WHERE false")
    said = descriptions.filter("user_id is not null").select("user_id", "description")
    routed = written(candidates_of(messages))
    if responses is None:
        # Nothing from outside: the optimizer leaves a scan of the stored candidates.
        nothing = spark.sql("SELECT 0L AS message_id, 0L AS user_id, '' AS response WHERE false")
        fresh = with_external(routed, parse_candidates(nothing), messages)
    else:
        fresh = written(with_external(routed, parse_candidates(responses), messages))
    users = written(fresh.select("user_id").union(said.select("user_id")).distinct())
    commit(fresh, folder, "candidates", batch)
    commit(said, folder, "descriptions", batch)
    every = fresh if batch == 0 else written(_so_far(fresh, folder, "candidates", batch, users))
    told = _so_far(said, folder, "descriptions", batch, users)
    versions = with_expiry(versions_of(apply_in_order(every)), every)
    result = _passed(every, versions, told, None, 0)
    for name in RESULTS:
        commit(result[name], folder, name, batch)
    commit(users, folder, "users", batch)
    return result


def stored(spark: SparkSession, folder: str, name: str, like: DataFrame) -> DataFrame:
    """A result as the batches so far leave it, with the columns of ``like``."""
    return latest_of_users(spark, folder, name, like.schema)


def utterances_in_halves(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The whole pass over the events table as two batches, the earlier half first."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _halves:
        messages, told = archived_utterances(spark, folder), obsolete_sayings(spark, folder)
        half = messages.agg((F.max("seq") / 2).cast("long")).first()[0] or 0
        path = os.path.join(shared_folder(spark), "incremental", uuid.uuid4().hex)
        for batch, part in enumerate((F.col("seq") <= half, F.col("seq") > half)):
            result = process_batch(messages.filter(part), path, batch, told.filter(part))
        _halves[key] = {n: stored(spark, path, n, result[n]) for n in RESULTS}
    return _halves[key]
