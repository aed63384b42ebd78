"""Reading the versioned memory: as of a point, audits, snapshots, conflicts, obsolescence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import fixed_values as V
from engram.operators.substrings import containment


def memory_as_of(versions: DataFrame, as_of=None, by: str = "seq") -> DataFrame:
    """Items known at a position (``by='seq'``) or time (``by='at'``), with their status.

    ``as_of=None`` means now: after everything in the history."""
    start, end = f"started_{by}", f"ended_{by}"
    items = versions
    open_ = F.col(end).isNull()
    if as_of is not None:
        items = items.filter(F.col(start) <= F.lit(as_of))
        open_ = open_ | (F.col(end) > F.lit(as_of))
    status = F.when(open_, "active").otherwise(F.col("end_status"))
    if "valid_until" in versions.columns and by == "at" and as_of is not None:
        status = F.when(open_ & (F.col("valid_until") <= F.lit(as_of)), "expired").otherwise(
            status)
    return items.withColumn("status", status)


def corrections_audit(versions: DataFrame) -> DataFrame:
    """One row per supersede that carries a correction: target, old and new value."""
    old = versions.select(F.col("item_id").alias("supersedes_id"),
                          F.col("content").alias("old_content"))
    rows = versions.filter("supersedes_id is not null and is_correction").join(
        old, "supersedes_id")
    given = F.col("correction").isNotNull()
    return rows.select(
        "user_id", "item_id", "supersedes_id",
        F.when(given, F.col("correction.target")).otherwise(F.col("topic_key")).alias("target"),
        F.when(given, F.col("correction.old_value")).otherwise(F.col("old_content"))
        .alias("old_value"),
        F.when(given, F.col("correction.new_value")).otherwise(F.col("content"))
        .alias("new_value"), "started_seq")


def obsolete_items(items: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Active items an obsolescence description names: by id, or by containment of content
    in description, description in content, or topic in description."""
    active = items.filter("status = 'active'")
    lowered = F.lower(F.trim("description"))
    said = descriptions.select("user_id", lowered.alias("d")).filter("d <> ''").distinct()
    by_id = active.select("user_id", "item_id").join(
        said.withColumnRenamed("d", "item_id"), ["user_id", "item_id"], "left_semi")
    texts = active.select("user_id", "item_id", F.lower("content").alias("content"),
                          F.lower("topic_key").alias("topic"))
    c_in_d = containment(said.selectExpr("user_id", "d AS text"),
                         texts.selectExpr("user_id", "content AS needle"), ["user_id"])
    d_in_c = containment(texts.selectExpr("user_id", "content AS text"),
                         said.selectExpr("user_id", "d AS needle"), ["user_id"])
    t_in_d = containment(said.selectExpr("user_id", "d AS text"),
                         texts.selectExpr("user_id", "topic AS needle"), ["user_id"])
    hits = [
        texts.join(c_in_d.selectExpr("user_id", "needle AS content").distinct(),
                   ["user_id", "content"], "left_semi"),
        texts.join(d_in_c.selectExpr("user_id", "text AS content").distinct(),
                   ["user_id", "content"], "left_semi"),
        texts.join(t_in_d.selectExpr("user_id", "needle AS topic").distinct(),
                   ["user_id", "topic"], "left_semi"),
    ]
    out = by_id
    for h in hits:
        out = out.unionByName(h.select("user_id", "item_id"))
    return out.distinct()


def accept_proposals(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """Compare-and-swap in bulk: a proposal wins if it names the current version and is the
    first to do so; the others are conflicts.

    ``current``: item_id, version.  ``proposals``: item_id, expected_version, seq.
    """
    first = proposals.join(current, "item_id").filter("expected_version = version").groupBy(
        "item_id").agg(F.min("seq").alias("_winner"))
    joined = proposals.join(first, "item_id", "left")
    return joined.withColumn("outcome", F.when(
        F.col("seq") == F.col("_winner"), "accepted").otherwise("conflict")).drop("_winner")


def resolve_conflicts(items: DataFrame) -> DataFrame:
    """One item per topic: active first, then version, update, id; blank topics all stay."""
    blank = items.filter("trim(coalesce(topic_key, '')) = ''")
    best = items.filter("trim(coalesce(topic_key, '')) <> ''").groupBy(
        "user_id", F.trim("topic_key").alias("_t")).agg(F.max_by("item_id", F.struct(
            (F.col("status") == "active").alias("a"), "version", "updated_seq", "item_id"))
            .alias("item_id"))
    return blank.unionByName(items.join(best.drop("_t"), ["user_id", "item_id"], "left_semi"))


def snapshot_lists(items: DataFrame) -> DataFrame:
    """Contents of active items as one row per list entry, ready for pivoting or writing.

    Kept long: a list per user would put an unbounded group in one row."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in V.SNAPSHOT_LISTS.items()
                                       for x in kv]), F.col("type"))
    return items.filter("status = 'active' and content <> '' and type <> 'temporary_state'"
                        ).select("user_id", kind.alias("list"), "started_seq", "started_pos",
                                 "content")


def snapshots(items: DataFrame) -> DataFrame:
    """One row per user with the size of each of the eight lists."""
    entries = snapshot_lists(items)
    counted = entries.groupBy("user_id").pivot("list", list(V.SNAPSHOT_LISTS.values())).agg(
        F.count("content"))
    return counted.na.fill(0)


def next_versions(keys: DataFrame, existing: DataFrame) -> DataFrame:
    """Next snapshot number per user: the highest so far + 1."""
    top = existing.groupBy("user_id").agg(F.max("version").alias("_v"))
    return keys.join(top, "user_id", "left").withColumn(
        "version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def action_counts(versions: DataFrame, routed: DataFrame) -> DataFrame:
    """How often each action happened per user: create, supersede, merge, revoke."""
    made = versions.groupBy("user_id").agg(
        F.count_if(F.col("supersedes_id").isNull()).alias("created"),
        F.count_if(F.col("supersedes_id").isNotNull()).alias("superseded"),
        F.sum(F.col("source_count") - 1).alias("merged"),
        F.count_if(F.col("end_status") == "revoked").alias("revoked"))
    kinds = routed.groupBy("user_id").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("bucket") == "store").alias("stored"),
        F.count_if(F.col("bucket") == "context").alias("context"),
        F.count_if(F.col("bucket") == "discard").alias("discarded"))
    joined = kinds.join(made, "user_id", "left")
    return joined.na.fill(0).withColumn("memory_changed", (
        F.col("created") + F.col("superseded") + F.col("merged") + F.col("revoked")) > 0)


def process_counts(versions: DataFrame, routed: DataFrame, obsolete: DataFrame,
                   records: DataFrame, sources: DataFrame) -> DataFrame:
    """action_counts with obsolete, consolidated and superseded-by-consolidation items."""
    def number(df, name):
        return df.groupBy("user_id").agg(F.count("*").alias(name))
    out = action_counts(versions, routed)
    for df, name in ((obsolete, "obsolete"), (records, "consolidated"),
                     (sources, "consolidation_superseded")):
        out = out.join(number(df, name), "user_id", "left")
    out = out.na.fill(0, ["obsolete", "consolidated", "consolidation_superseded"])
    return out.withColumn("memory_changed", F.col("memory_changed") | (F.col("obsolete") > 0))
