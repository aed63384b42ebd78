"""Structured Streaming jobs: message dedupe, request rates, short-term context, memory."""

from __future__ import annotations

import json
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from engram.operators.history import DECIDES, candidate_events
from engram.session import ROCKSDB, shared_folder
from engram.streaming.fold import Memory

ACTION_SCHEMA = ("user_id bigint, seq bigint, pos int, action string, reason string, "
                 "content string, type string, topic_key string, version int, item_seq bigint")
CONTEXT_SCHEMA = "user_id bigint, key string, value string, seq bigint, event string"


def stream_table(spark: SparkSession, folder: str, name: str, per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, ``per_batch`` files at a time."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", per_batch).parquet(folder))


def stream_dedupe(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First occurrence of each message key; a key is remembered for the watermark delay."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["user_id", "message_key"])


def stream_rates(events: DataFrame, key: str, window: str = "1 minute",
                 slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests per key in sliding windows."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("requests"))
            .select(F.col("window.start").alias("window_start"), key, "requests"))


class ContextProcessor(StatefulProcessor):
    """Short-term entries of a user, by operations in the order (ts, seq, pos).

    A timer removes an entry when its TTL ends; without a positive TTL it lasts.  Deleted
    entries keep their place, so that an older set cannot bring them back."""

    def init(self, handle):
        self.handle = handle
        self.entries = handle.getMapState(
            "entries", "key string",
            "value string, ts bigint, seq bigint, pos int, expires bigint, live boolean")
        self.cleared = handle.getValueState("cleared", "ts bigint, seq bigint, pos int")

    def handleInputRows(self, key, rows, timerValues):
        # A micro-batch holds a bounded part of a user's operations.
        batch = pd.concat(list(rows)).sort_values(["ts", "seq", "pos"])
        changed = {}
        for row in batch.to_dict("records"):
            place = (int(row["ts"].timestamp() * 1_000_000), int(row["seq"]), int(row["pos"]))
            cleared = tuple(self.cleared.get()) if self.cleared.exists() else None
            if cleared is not None and place <= cleared:
                continue
            if row["op"] == "clear":
                self.cleared.update(place)
                for (name,), held in list(self.entries.iterator()):
                    if tuple(held[1:4]) <= place:
                        self.entries.removeKey((name,))
                        if held[5]:
                            changed[name] = (held[0], held[2], "cleared")
                continue
            name = (row["key"],)
            held = self.entries.getValue(name) if self.entries.containsKey(name) else None
            if held is not None and tuple(held[1:4]) > place:
                continue
            if row["op"] == "delete":
                self.entries.updateValue(name, (None, *place, None, False))
                if held is not None and held[5]:
                    changed[row["key"]] = (held[0], place[1], "deleted")
                continue
            ttl = row["ttl_seconds"]
            lasts = pd.isna(ttl) or float(ttl) <= 0
            expires = None if lasts else place[0] // 1000 + int(float(ttl) * 1000)
            self.entries.updateValue(name, (str(row["value"]), *place, expires, True))
            if expires is not None:
                self.handle.registerTimer(expires)
            changed[row["key"]] = (str(row["value"]), place[1], "set")
        if changed:
            yield self._rows(key, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, gone = expiredTimerInfo.getExpiryTimeInMs(), {}
        for (name,), held in list(self.entries.iterator()):
            if held[5] and held[4] is not None and held[4] <= now:
                self.entries.removeKey((name,))
                gone[name] = (held[0], held[2], "expired")
        if gone:
            yield self._rows(key, gone)

    @staticmethod
    def _rows(key, changed):
        return pd.DataFrame([
            {"user_id": int(key[0]), "key": name, "value": value, "seq": int(seq), "event": event}
            for name, (value, seq, event) in changed.items()])

    def close(self):
        pass


class MemoryProcessor(StatefulProcessor):
    """Active items of one user, changed by every candidate in order.

    One state entry an item; a micro-batch writes the entries that it changed."""

    def init(self, handle):
        self.items = handle.getMapState("items", "number long", "item string")

    def handleInputRows(self, key, rows, timerValues):
        # A micro-batch holds a bounded part of a user's candidates.
        batch = pd.concat(list(rows)).sort_values(["seq", "pos"])
        before = {int(n[0]): item[0] for n, item in self.items.iterator()}
        memory = Memory(json.loads(before[n]) for n in sorted(before))
        memory.next = max(before, default=-1) + 1
        changed, out = set(), []
        for row in batch.to_dict("records"):
            action, reason, item, old, _, gone = memory.apply(row)
            for kind, one in [(action, item)] if item is not None else [
                    (action, i) for i in gone]:
                out.append({
                    "user_id": int(key[0]), "seq": int(row["seq"]), "pos": int(row["pos"]),
                    "action": kind, "reason": reason, "content": one["content"],
                    "type": one["type"], "topic_key": one["topic_key"],
                    "version": int(one["version"]), "item_seq": int(one["seq"])})
            changed |= {i["number"] for i in (item, old, *gone) if i is not None}
        for number in sorted(changed):
            if number in memory.items:
                self.items.updateValue(
                    (number,), (json.dumps(memory.items[number], default=_plain_number),))
            elif number in before:
                self.items.removeKey((number,))
        if out:
            yield pd.DataFrame(out)[[c.split()[0] for c in ACTION_SCHEMA.split(", ")]]

    def close(self):
        pass


def _plain_number(value):
    return value.item()


def stream_context(entries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What each micro-batch and each expiry did to the short-term entries of a user.

    ``entries``: user_id, key, value, ttl_seconds, op (set unless given; delete, clear), seq,
    pos, ts."""
    if "op" not in entries.columns:
        entries = entries.withColumn("op", F.lit("set"))
    return (entries.withWatermark("ts", delay).groupBy("user_id")
            .transformWithStateInPandas(
                statefulProcessor=ContextProcessor(), outputStructType=CONTEXT_SCHEMA,
                outputMode="Append", timeMode="EventTime"))


def candidate_rows(routed: DataFrame) -> DataFrame:
    """Durable candidates as flat rows for the memory fold."""
    return candidate_events(routed).select(
        "user_id", "pos", "ts", *DECIDES)


def stream_memory(candidates: DataFrame) -> DataFrame:
    """Actions on the memory, candidate by candidate, with state per user."""
    return candidates.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=MemoryProcessor(), outputStructType=ACTION_SCHEMA,
        outputMode="Append", timeMode="None")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over everything available into a parquet table and reads it back.

    The state store that custom state needs is set for this stream alone."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    base = os.path.join(shared_folder(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    running = (stream.writeStream.format("parquet").outputMode("append")
               .option("path", f"{base}/data").option("checkpointLocation", f"{base}/state")
               .trigger(availableNow=True).start())
    spark.conf.set(provider, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def as_stream(table: DataFrame, name: str, order: str, files: int = 4) -> DataFrame:
    """A batch table as a stream of files in the order of a column."""
    spark = table.sparkSession
    path = os.path.join(shared_folder(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    table.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)
