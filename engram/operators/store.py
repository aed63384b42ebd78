"""Writing the memory back: batches that can be repeated, and a log of status changes.

A batch is a folder of its own (batch=<number>) that a repeated run writes over, so that doing
a batch twice changes nothing; a stream hands its epoch as the number.  Items are appended and
never changed: what ends an item later is a row of the status log.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.consolidate import CLUSTER

STATUS = "user_id bigint, item_id string, status string, reason string, step int"


def commit(df: DataFrame, folder: str, name: str, batch: int) -> None:
    """Writes a batch of a table, in place of an earlier run of the same batch."""
    df.write.mode("overwrite").parquet(os.path.join(folder, name, f"batch={batch}"))


def committed(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """All batches of a table, with the batch number."""
    path = os.path.join(folder, name)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def commit_epoch(folder: str, name: str):
    """For foreachBatch: an epoch that is run again replaces itself."""
    return lambda df, epoch: commit(df, folder, name, epoch)


def status_rows(items: DataFrame, status: str, reason: str, step: int) -> DataFrame:
    return items.select("user_id", "item_id", F.lit(status).alias("status"),
                        F.lit(reason).alias("reason"), F.lit(step).alias("step"))


def with_status(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the latest status that the log has for them, where it has one."""
    order = [c for c in ("batch", "step") if c in log.columns]
    last = log.groupBy("item_id").agg(F.max_by("status", F.struct(*order)).alias("_status"))
    return items.join(last, "item_id", "left").withColumn(
        "status", F.coalesce("_status", "status")).select(items.columns)


def with_expiry(versions: DataFrame, routed: DataFrame) -> DataFrame:
    """Versions with the valid_until of the statement that each began with (null: none)."""
    until = routed.filter("bucket = 'store' and valid_until is not null").select(
        "user_id", F.col("seq").alias("started_seq"), F.col("pos").alias("started_pos"),
        "valid_until")
    return versions.join(until, ["user_id", "started_seq", "started_pos"], "left").select(
        *versions.columns, "valid_until")


def expired_at(items: DataFrame, as_of) -> DataFrame:
    """Items with status expired where they are active and their time is over."""
    over = (F.col("status") == "active") & (F.col("valid_until") <= F.lit(as_of))
    return items.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def latest_of_users(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Rows of a table that every user's latest finished batch wrote.

    The users of a batch are written last, so a batch that was broken off is not seen."""
    done = committed(spark, folder, "users", "user_id bigint, batch int")
    last = done.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return committed(spark, folder, name, schema).join(last, ["user_id", "batch"]).drop("batch")


def record_items(records: DataFrame, sources: DataFrame, like: DataFrame) -> DataFrame:
    """Consolidated records as active items of their own, with the columns of `like`.

    A record follows the first of its sources (by place, then id)."""
    place = F.struct("started_seq", "started_pos", "item_id")
    held = sources.join(like.select("item_id", "started_seq", "started_pos", "updated_seq"),
                        "item_id")
    ends = held.groupBy(*CLUSTER).agg(
        F.min_by("item_id", place).alias("supersedes_id"),
        F.max("updated_seq").alias("updated_seq"))
    rows = records.join(ends, CLUSTER).withColumn("item_id", F.md5(F.concat_ws(
        "|", F.lit("record"), "user_id", "cluster", "supersedes_id", "updated_seq")))
    known = {
        "segment": F.lit(1).cast("long"), "version": F.lit(1).cast("long"),
        "state": F.lower("content"), "freshness": F.lit(1.0), "information_gain": F.lit(0.9),
        "authority": F.lit("assistant"), "is_correction": F.lit(False),
        "started_seq": F.col("updated_seq"), "started_pos": F.lit(0), "status": F.lit("active")}
    rows = rows.withColumns({k: v for k, v in known.items() if k in like.columns})
    kinds = dict(like.dtypes)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c)
                         for c in like.columns])
