"""The version history: what every candidate does to the memory, applied in order.

What a candidate does depends on what is active, so the candidates of a user are applied one
after the other: a sorted scan per partition that holds the active items of one user at a
time (streaming/fold.py decides).  A user with very many candidates is cut into parts that
cannot touch each other: topics are tied together where contents are alike or a correction
names another topic's value.  Topics that stand alone and hold nothing but plain statements
need no order beyond their own and are walked by windows, in chunks where they are long.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import fixed_values as V
from engram.functions import sql as X
from engram.functions.facts import topic_from_content
from engram.functions.similarity import similar_texts
from engram.operators import chains
from engram.operators.components import connected
from engram.operators.substrings import containment, text_id
from engram.session import cut_lineage, written
from engram.streaming.fold import SOFT, Memory

CHAIN = ["user_id", "type", "topic_key"]
ORDER = ["seq", "pos"]
ITEM_FIELDS = ["subject", "predicate", "value", "scope"]
#: Users with more candidates are cut into parts.
HOT_USER_ROWS = 200_000
#: What a decision reads; the other columns ride along.
DECIDES = ["type", "topic_key", "item_topic", "content", "authority", "is_correction",
           "confidence", "stability", "old_value", "revokes", "revocation_target",
           "revoked_value", "seq"]
DECIDED = ("action string, reason string, item_nth long, item_chain_topic string, merges long, "
           "version int, information_gain double, old_type string, old_topic string, "
           "old_nth long, revoked array<struct<type: string, topic_key: string, nth: long>>")
WORDS = "array_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+', 0))"


def candidate_events(routed: DataFrame) -> DataFrame:
    """Durable candidates as flat rows, in the form that decisions read.

    A blank topic is found by the topic of its content."""
    blank = F.trim(F.coalesce("topic_key", F.lit(""))) == ""
    return (routed.filter("bucket = 'store'")
            .withColumn("content", F.col("candidate_content"))
            .withColumn("state", F.lower(F.regexp_replace("content", r"^\s+|\s+\z", "")))
            .withColumn("item_topic", F.when(blank, F.expr(str(topic_from_content(
                X.col("content"), X.col("type"))))).otherwise(F.trim("topic_key")))
            .select("user_id", *ORDER, "ts", "type", "topic_key", "item_topic", "content", "state",
                    "authority", "is_correction", "correction", *ITEM_FIELDS, "confidence",
                    "importance", "stability", "freshness",
                    F.coalesce("correction.old_value", F.lit("")).alias("old_value"),
                    F.col("revocation").isNotNull().alias("revokes"),
                    F.coalesce("revocation.target", F.lit("")).alias("revocation_target"),
                    F.coalesce("revocation.value", F.lit("")).alias("revoked_value")))


def decisions(events: DataFrame) -> DataFrame:
    """Events (with `part`) and what each did, applied in order within user and part.

    Rows are sorted by user, part and place and scanned once; a task holds the active items of
    one part at a time, never its rows."""
    names = [c.split()[0] for c in DECIDED.split(", ")[:10]] + ["revoked"]
    gone_type = pa.list_(pa.struct([("type", pa.string()), ("topic_key", pa.string()),
                                    ("nth", pa.int64())]))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(),
             pa.float64(), pa.string(), pa.string(), pa.int64(), gone_type]

    def run(batches):
        at, memory = None, Memory()
        for batch in batches:
            keys = zip(batch.column("user_id").to_pylist(), batch.column("part").to_pylist(),
                       strict=True)
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in DECIDES],
                                              names=DECIDES).to_pylist()
            out = []
            for key, row in zip(keys, rows, strict=True):
                if key != at:
                    at, memory = key, Memory()
                action, reason, item, old, gain, gone = memory.apply(row)
                kept = item if action != "reject" else None
                out.append((
                    action, reason, kept and kept["nth"], kept and kept["topic_key"],
                    kept["merges"] if kept else None, kept and kept["version"], gain,
                    old and old["type"], old and old["topic_key"], old and old["nth"],
                    [{"type": i["type"], "topic_key": i["topic_key"], "nth": i["nth"]}
                     for i in gone]))
            added = [pa.array(list(x), t) for x, t in zip(
                zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added],
                                             names=[*batch.schema.names, *names])

    place = ["user_id", "part", *ORDER]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return events.repartition("user_id", "part").sortWithinPartitions(*place).mapInArrow(
        run, f"{schema}, {DECIDED}")


# --- users with very many candidates ------------------------------------------------

def _node():
    return F.xxhash64(*CHAIN)


def independent_parts(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements of hot users with their part, what revocations reach, and plain topics.

    Topics of one type are tied where contents are alike enough to matter, and a correction's
    topic to every topic that has held its old value or something like it.  Ties are looked
    up on distinct contents.  Revocations tie nothing: each item ends on its own.
    """
    said = events.filter("not revokes")
    held = written(said.select(*CHAIN, "content").distinct().withColumn("node", _node()))
    text = F.trim(F.lower("content"))
    close = similar_texts(held.select("user_id", "type", F.col("content").alias("text")),
                          held.select("user_id", "type", F.col("content").alias("text")),
                          ["user_id", "type"], SOFT)
    close = written(close.filter("left_text < right_text").select(
        "user_id", "type", "left_text", "right_text"))
    named = held.select("user_id", "type", "node", text.alias("t"))
    # Equal contents of different topics are alike as well: tie each to the smallest.
    same = named.groupBy("user_id", "type", "t").agg(F.min("node").alias("b"))
    ties = named.join(same, ["user_id", "type", "t"]).select(F.col("node").alias("a"), "b")
    left = same.selectExpr("user_id", "type", "t AS left_text", "b AS a")
    right = same.selectExpr("user_id", "type", "t AS right_text", "b")
    pairs = written(close.join(left, ["user_id", "type", "left_text"]).join(
        right, ["user_id", "type", "right_text"]).select("a", "b"))
    ties = ties.unionByName(pairs)
    merging = pairs.filter("a = b").select(F.col("a").alias("node")).distinct()
    asks = said.filter("old_value <> ''").select(
        "user_id", _node().alias("a"), F.lower(F.trim("old_value")).alias("needle")).distinct()
    lowered = held.select("user_id", F.lower("content").alias("text"), "node")
    needles = asks.select("user_id", "needle").distinct()
    inside = containment(lowered.select("user_id", "text"), needles, ["user_id"]).select(
        "user_id", "needle", "text_id")
    reached = inside.join(lowered.withColumn("text_id", text_id("text")),
                          ["user_id", "text_id"]).select("user_id", "needle", "node")
    alike = similar_texts(needles.withColumnRenamed("needle", "text"),
                          held.select("user_id", F.col("content").alias("text")), ["user_id"],
                          V.CORRECTION_SIMILARITY)
    reached = reached.unionByName(
        alike.withColumnRenamed("left_text", "needle")
        .join(held.select("user_id", "node", text.alias("right_text")),
              ["user_id", "right_text"]).select("user_id", "needle", "node"))
    # A needle's topics hang on the smallest one, and every asking topic on that.
    hub = reached.groupBy("user_id", "needle").agg(F.min("node").alias("b"))
    ties = ties.unionByName(reached.join(hub, ["user_id", "needle"]).select(
        F.col("node").alias("a"), "b")).unionByName(
        asks.join(hub, ["user_id", "needle"]).select("a", "b"))
    parts = connected(ties)
    dealt = (said.withColumn("node", _node()).join(parts, "node", "left")
             .withColumn("part", F.coalesce("part", "node")))
    place = written(held.join(parts, "node", "left").withColumn(
        "part", F.coalesce("part", "node")))
    reached = written(_reached_by_revocations(events, place))
    dealt = written(dealt)
    return dealt, reached, cut_lineage(plain_nodes(dealt, reached, merging))


def _reached_by_revocations(events: DataFrame, held: DataFrame) -> DataFrame:
    """user_id, ask (what a revocation says), node, part, content: contents that it would end."""
    asks = events.filter("revokes").select(
        "user_id", "ask", "revocation_target", F.lower(F.trim("revoked_value")).alias("needle"))
    asks = asks.distinct()
    words = asks.select("user_id", "ask", F.explode(F.expr(WORDS.format("revocation_target")))
                        .alias("word"))
    texts = held.select("user_id", "node", "part", "content", F.explode(F.expr(WORDS.format(
        "concat(content, ' ', coalesce(topic_key, ''))"))).alias("word"))
    by_word = words.join(texts, ["user_id", "word"])
    lowered = held.withColumn("text", F.lower("content"))
    inside = containment(lowered.select("user_id", "text"), asks.filter("needle <> ''").select(
        "user_id", "needle"), ["user_id"]).select("user_id", "needle", "text_id")
    by_value = (asks.filter("needle <> ''").join(inside, ["user_id", "needle"])
                .join(lowered.withColumn("text_id", text_id("text")), ["user_id", "text_id"])
                .filter(F.col("text").contains(F.col("needle"))))
    cols = ["user_id", "ask", "node", "part", "content"]
    return by_word.select(*cols).unionByName(by_value.select(*cols)).distinct()


def plain_nodes(dealt: DataFrame, reached: DataFrame, merging: DataFrame) -> DataFrame:
    """Topics that are a part of their own, say nothing speculative and correct nothing, whose
    contents are not alike (`merging`: those where some are), and whose revocations end
    whatever they hold."""
    one = dealt.groupBy("part").agg(
        F.min("node").alias("node"), F.max("node").alias("last"),
        F.max(F.col("authority") == "speculation").alias("weak"),
        F.max(F.col("old_value") != "").alias("asks"),
        F.max(F.trim(F.coalesce("topic_key", F.lit(""))) == "").alias("blank"))
    contents = dealt.select("node", "content").distinct().groupBy("node").agg(
        F.count("*").alias("contents"))
    some = (reached.groupBy("node", "ask").agg(F.countDistinct("content").alias("hit"))
            .join(contents, "node").filter("hit < contents").select("node").distinct())
    return one.filter("node = last and not weak and not asks and not blank").select(
        "node").join(some, "node", "left_anti").join(merging, "node", "left_anti")


def plain_rows(said: DataFrame, closes: DataFrame, chunk: int, hot_rows: int) -> DataFrame:
    """Statements of plain topics with the item they belong to (as decisions() says it)."""
    closing = F.col("closes")
    rows = said.withColumn("closes", F.lit(False)).unionByName(
        closes.withColumn("closes", F.lit(True)), allowMissingColumns=True)
    # Rows of one place keep one order through all walks.
    rows = written(rows.withColumn("_tie", F.monotonically_increasing_id()))

    def walk(rows, line):
        rows = rows.withColumn("_s", F.when(closing, F.lit(None)).otherwise(F.col("state")))
        rows = rows.withColumn("_x", F.struct("_s"))
        rows = line.previous(rows, "_x", "_before")
        starts = ~closing & (F.col("_before").isNull() | ~F.col("_before._s").eqNullSafe(
            F.col("_s")))
        # A second close in a row ends nothing.
        ends = closing & F.col("_before._s").isNotNull()
        rows = rows.withColumn("_starts", starts).withColumn("_ends", ends)
        rows = line.running(rows, sums={"item_nth": F.col("_starts").cast("long"),
                                        "_index": (~closing).cast("long")})
        return line.running(rows, lasts={
            "_closed": F.when(closing, F.col("item_nth")),
            "_first": F.when(F.col("_starts"), F.col("_index"))})

    # A chain may be very long; the count decides between whole windows and chunks only.
    hot = chains.hot_chains(rows, CHAIN, hot_rows)
    return chains.along(rows, CHAIN, [*ORDER, "_tie"], walk, hot, chunk).drop("_tie").withColumn(
        "version", (F.col("item_nth") - F.coalesce("_closed", F.lit(0))).cast("int")).withColumn(
        "merges", F.col("_index") - F.col("_first"))


# --- version rows ---------------------------------------------------------------------

def item_id(user, kind, topic, nth):
    return F.md5(F.concat_ws("|", user, kind, F.coalesce(topic, F.lit("")), nth))


SAID = ["user_id", *ORDER, "ts", "type", "item_topic_key", "item_nth", "merges", "version",
        "information_gain", "content", "state", "authority", "is_correction", "correction",
        *ITEM_FIELDS, "confidence", "importance", "stability", "freshness", "old_id"]
ENDED = ["user_id", *ORDER, "ts", "type", "item_topic_key", "item_nth", "end_status"]


def _walked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = rows.filter("item_nth is not null").withColumn(
        "item_topic_key", F.col("item_chain_topic")).withColumn("old_id", F.when(
            F.col("old_nth").isNotNull(), item_id("user_id", "old_type", "old_topic", "old_nth")))
    over = rows.filter("old_nth is not null").select(
        "user_id", *ORDER, "ts", F.col("old_type").alias("type"),
        F.col("old_topic").alias("item_topic_key"), F.col("old_nth").alias("item_nth"),
        F.lit("superseded").alias("end_status"))
    gone = rows.filter("size(revoked) > 0").select(
        "user_id", *ORDER, "ts", F.explode("revoked").alias("g")).select(
        "user_id", *ORDER, "ts", "g.type", F.col("g.topic_key").alias("item_topic_key"),
        F.col("g.nth").alias("item_nth"), F.lit("revoked").alias("end_status"))
    return said.select(*SAID), over.unionByName(gone)


def _plain(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("item_topic_key", F.col("topic_key"))
    before = item_id("user_id", "type", "topic_key", F.col("item_nth") - 1)
    fresh = F.col("_starts") & (F.col("version") == 1)
    said = rows.filter("not closes").withColumn(
        "old_id", F.when(F.col("_starts") & ~fresh, before)).withColumn(
        "information_gain", F.when(F.col("_starts"), 0.85).otherwise(0.05))
    over = rows.filter(F.col("_starts") & ~fresh).withColumn(
        "item_nth", F.col("item_nth") - 1).withColumn("end_status", F.lit("superseded"))
    gone = rows.filter("_ends").withColumn("end_status", F.lit("revoked"))
    return said.select(*SAID), over.select(*ENDED).unionByName(gone.select(*ENDED))


def version_rows(said: DataFrame, ended: DataFrame, bounded: bool = False) -> DataFrame:
    """One row per item, from the statements that made it and the rows that ended it.

    Where the rows of an item are ``bounded`` they meet as they are: half-made items, with the
    place beside every value, are several times as wide."""
    place, step = F.struct(*ORDER), V.MERGE_STABILITY_STEP
    stated = F.col("end_status").isNull()
    at = F.when(stated, place)
    starts = F.col("merges") == 0
    bump = F.when(starts, 0.0).otherwise(step)
    rows = said.unionByName(ended, allowMissingColumns=True)
    if bounded:
        rows = rows.repartition("user_id", "type", "item_topic_key", "item_nth")

    def latest(name):
        return F.max_by(name, F.when(stated & (F.coalesce(name, F.lit("")) != ""), place)
                        ).alias(name)
    # A struct is picked by one comparison, its fields by one each.
    first = ("content", "state", "authority", "is_correction", "correction", "version", "old_id")
    ended = F.when(~stated, place)
    out = rows.groupBy("user_id", "type", "item_topic_key", "item_nth").agg(
        F.min(at).alias("_start"), F.min_by(F.struct("ts", *first), at).alias("_first"),
        *[latest(n) for n in ITEM_FIELDS],
        *[F.max(n).alias(n) for n in ("confidence", "importance", "freshness")],
        F.max(F.col("stability") + bump - F.col("merges") * step).alias("_s"),
        F.max("merges").alias("_merges"), F.count(F.when(stated, 1)).alias("source_count"),
        F.max(at).alias("_last"), F.max_by(F.struct("ts", "information_gain"), at).alias("_latest"),
        F.min(ended).alias("_ended"),
        F.min_by(F.struct("ts", "end_status"), ended).alias("_end"))
    out = out.select(
        "*", F.col("_first.ts").alias("started_at"), *[F.col(f"_first.{n}") for n in first],
        F.col("_latest.ts").alias("updated_at"), "_latest.information_gain",
        F.col("_end.ts").alias("ended_at"), "_end.end_status")
    out = out.withColumnsRenamed({"item_topic_key": "topic_key", "item_nth": "segment"})
    return out.select(
        item_id("user_id", "type", "topic_key", "segment").alias("item_id"), *CHAIN, "segment",
        F.col("version").cast("long").alias("version"), "content", "state", *ITEM_FIELDS,
        "confidence", "importance",
        F.round(F.least(F.lit(1.0), F.col("_s") + F.col("_merges") * step), 6)
        .alias("stability"),
        "freshness", "authority", "is_correction", "correction", "source_count",
        "information_gain",
        F.col("_start.seq").alias("started_seq"), F.col("_start.pos").alias("started_pos"),
        "started_at", F.col("_last.seq").alias("updated_seq"), "updated_at",
        F.col("_ended.seq").alias("ended_seq"), F.col("_ended.pos").alias("ended_pos"),
        "ended_at", "end_status", F.col("old_id").alias("supersedes_id"))


def _other_items_known(versions: DataFrame, hot_rows: int, chunk: int) -> DataFrame:
    """Lowers the gain of first items where another part of the user holds one of the type."""
    change = versions.select(
        "user_id", "type", F.col("started_seq").alias("seq"), F.col("started_pos").alias("pos"),
        F.lit(0).alias("ends"), F.lit(1).alias("d"), "item_id").unionByName(
        versions.filter("ended_seq is not null").select(
            "user_id", "type", F.col("ended_seq").alias("seq"), F.col("ended_pos").alias("pos"),
            F.lit(1).alias("ends"), F.lit(-1).alias("d"), F.lit(None).cast("string")
            .alias("item_id")))
    keys = ["user_id", "type"]
    counted = chains.along(
        change, keys, [*ORDER, "ends"],
        lambda rows, line: line.running(rows, sums={"open": F.col("d")}),
        chains.hot_chains(change, keys, hot_rows), chunk)
    others = counted.filter("item_id is not null and open > 1").select("item_id")
    known = versions.join(others.withColumn("_known", F.lit(True)), "item_id", "left")
    gain = F.when(F.col("_known") & (F.col("information_gain") == 0.85), 0.8).otherwise(
        F.col("information_gain"))
    return known.withColumn("information_gain", gain).select(versions.columns)


@dataclass
class Applied:
    """What the candidates did.

    said: statements with the item they belong to; ended: ends of items; walked: what
    decisions() says of candidates; plain: rows of topics walked by windows, or None."""

    events: DataFrame
    said: DataFrame
    ended: DataFrame
    walked: DataFrame
    plain: DataFrame | None
    large: DataFrame | None

    def actions(self) -> DataFrame:
        """user_id, seq, pos, action, reason of every durable candidate."""
        place = ["user_id", *ORDER]
        out = self.walked.filter("not revokes").select(*place, "action", "reason")
        if self.plain is not None:
            again, fresh = F.col("merges") > 0, F.col("version") == 1
            out = out.unionByName(self.plain.filter("not closes").select(
                *place, F.when(again, "merge").when(fresh, "create").otherwise("supersede")
                .alias("action"), F.when(again, "near_duplicate").when(fresh, "new_topic")
                .otherwise("topic_contradiction").alias("reason")))
        gone = self.ended.filter("end_status = 'revoked'").select(*place).distinct()
        asked = self.events.filter("revokes").select(*place).join(
            gone.withColumn("_hit", F.lit(True)), place, "left")
        return out.unionByName(asked.select(
            *place, F.when(F.col("_hit"), "revoke").otherwise("skip").alias("action"),
            F.when(F.col("_hit"), "revocation").otherwise("no_revocation_target")
            .alias("reason")))

    def lineage(self) -> DataFrame:
        """item_id, user_id, seq, pos: every statement that made an item or was merged into it."""
        return self.said.select(
            item_id("user_id", "type", "item_topic_key", "item_nth").alias("item_id"),
            "user_id", *ORDER)


def apply_in_order(routed: DataFrame, hot_rows: int = HOT_USER_ROWS, chunk: int = chains.CHUNK,
                   hot_chain: int = chains.HOT_CHAIN_ROWS) -> Applied:
    """Applies the durable candidates of every user one after the other.

    ``routed`` is read several times, so it should be a stored table."""
    events = candidate_events(routed)
    hot = cut_lineage(events.groupBy("user_id").count().filter(
        F.col("count") > hot_rows).select("user_id"))
    if hot.isEmpty():
        rows = written(decisions(events.withColumn("part", F.lit(0).cast("long"))))
        return Applied(events, *_walked(rows), rows, None, None)
    usual = events.join(hot, "user_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    large = written(events.join(hot, "user_id", "left_semi").withColumn(
        "ask", F.xxhash64("revocation_target", "revoked_value")))
    dealt, reached, plain = independent_parts(large)
    asks = large.filter("revokes")
    entangled = reached.join(plain, "node", "left_anti").select(
        "user_id", "ask", "part").distinct()
    columns = usual.columns
    tied = dealt.join(plain, "node", "left_anti").select(columns).unionByName(
        asks.join(entangled, ["user_id", "ask"]).select(columns))
    rows = written(decisions(usual.unionByName(tied)))
    ends = reached.join(plain, "node", "left_semi").select("user_id", "ask", "node").distinct()
    names = dealt.select("node", *CHAIN).distinct()
    closes = asks.select("user_id", "ask", *ORDER, "ts").join(ends, ["user_id", "ask"]).join(
        names.drop("user_id"), "node").select(*CHAIN, *ORDER, "ts")
    alone = written(plain_rows(dealt.join(plain, "node", "left_semi").drop("node", "part"),
                                   closes, chunk, hot_chain))
    said, ended = _walked(rows)
    more_said, more_ended = _plain(alone)
    return Applied(events, said.unionByName(more_said), ended.unionByName(more_ended), rows,
                   alone, hot)


def versions_of(applied: Applied, chunk: int = chains.CHUNK,
                hot_chain: int = chains.HOT_CHAIN_ROWS) -> DataFrame:
    """One row per item with its content, scores, place, end and predecessor, as a stored table."""
    versions = written(version_rows(applied.said, applied.ended, applied.large is None))
    if applied.large is None:
        return versions
    split = versions.join(applied.large, "user_id", "left_semi")
    return written(versions.join(applied.large, "user_id", "left_anti").unionByName(
        _other_items_known(split, hot_chain, chunk)).select(versions.columns))


def apply_candidates(routed: DataFrame, hot_rows: int = HOT_USER_ROWS,
                     chunk: int = chains.CHUNK,
                     hot_chain: int = chains.HOT_CHAIN_ROWS) -> DataFrame:
    """Version history from routed candidates, applied one after the other."""
    return versions_of(apply_in_order(routed, hot_rows, chunk, hot_chain), chunk, hot_chain)
