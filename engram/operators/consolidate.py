"""Consolidation: related stack facts of a user become one record per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import fixed_values as V
from engram.functions import sql as X
from engram.functions.classify import lookup
from engram.functions.regex import matches, strip
from engram.functions.sql import Expr, col
from engram.functions.text import stability_label, stability_score, title_text
from engram.session import written

CLUSTER = ["user_id", "cluster"]


def stack_field() -> Expr:
    """Stack field of an item from its predicate, topic ending or value; null = none."""
    topic = X.lower(X.coalesce(col("topic_key"), ""))
    last = X.when(topic.contains(":"), X.element_at(X.split(topic, ":"), -1)).otherwise(
        X.element_at(X.split(topic, "[.]"), -1))
    own = X.lower(strip(X.coalesce(col("predicate"), "")))
    predicate = X.when(own != "", own).otherwise(strip(last))
    by_topic = X.when(matches(
        topic, r"(?:^|[.:])(?:" + "|".join(V.STACK_FIELDS) + r")$"),
        lookup(X.regexp_extract(topic, r"([^.:]*)\z", 1), V.STACK_FIELDS))
    text = X.lower(X.concat(X.coalesce(col("value"), ""), " ", X.coalesce(col("content"), "")))

    def by_value(t):
        chain = None
        for field, pattern in V.STACK_VALUE_FIELDS:
            hit = matches(t, pattern)
            chain = X.when(hit, field) if chain is None else chain.when(hit, field)
        return chain
    return X.let(predicate, lambda p: X.when(
        (p != "") & ~p.startswith("disliked_") & ~p.startswith("favorite_"),
        X.coalesce(lookup(p, V.STACK_FIELDS), by_topic, X.let(text, by_value))))


def clustered(items: DataFrame) -> DataFrame:
    """Active items that belong to a cluster, with field and whether they are a record."""
    rows = items.filter("status = 'active'").selectExpr("*", str(stack_field().alias("field")))
    topic = F.lower(F.trim("topic_key"))
    record = topic.isin(*V.CLUSTER_TOPICS)
    scope = F.when((F.lower("scope") == "user") | (F.lower("subject") == "user"),
                   "user").otherwise("project")
    cluster = F.when(record, topic).when(F.col("field").isNotNull(),
                                         F.concat(scope, F.lit(".tech_stack")))
    return rows.withColumn("cluster", cluster).withColumn("is_record", record).filter(
        "cluster is not null")


def find_clusters(items: DataFrame, min_size: int = V.MIN_CLUSTER_SIZE) -> DataFrame:
    """Clusters worth consolidating, with their sizes."""
    return _large_enough(clustered(items), min_size)


def _large_enough(members: DataFrame, min_size: int) -> DataFrame:
    sizes = members.groupBy(*CLUSTER).agg(
        F.count("*").alias("size"), F.count_if(~F.col("is_record")).alias("atomics"),
        F.bool_or("is_record").alias("has_record"))
    return sizes.filter(
        (F.col("atomics") >= min_size)
        | ((F.col("atomics") >= 2) & (F.col("size") >= min_size))
        | (F.col("has_record") & (F.col("atomics") >= 1)))


def field_values(items: DataFrame, min_size: int = V.MIN_CLUSTER_SIZE) -> DataFrame:
    """One row per (item, field, value) of the clusters: atomic items as they are, earlier
    records as the entries of their JSON value.  The items are looked at once."""
    found = written(clustered(items).select(
        *CLUSTER, "item_id", "started_seq", "started_pos", "confidence", "importance",
        "stability", "field", "is_record", "value", "content"))
    members = found.join(_large_enough(found, min_size).select(*CLUSTER), CLUSTER)
    entries = F.from_json(F.coalesce("value", "content"), "map<string,string>")
    text = F.trim(F.coalesce(F.expr("nullif(value, '')"), "content"))
    pairs = F.when(F.col("is_record"), entries).when(
        F.col("field").isNotNull(), F.create_map("field", text))
    return members.withColumn("_m", pairs).select(
        *CLUSTER, "item_id", "started_seq", "started_pos", "confidence", "importance",
        "stability", F.explode("_m").alias("field", "field_value")).filter(
        "trim(field_value) <> ''")


def field_winners(values: DataFrame) -> DataFrame:
    """Best value per cluster and field: highest confidence, oldest item on ties."""
    order = F.struct((-F.col("confidence")).alias("c"), "started_seq", "started_pos", "item_id")
    place = F.struct("started_seq", "started_pos", "item_id")
    return values.groupBy(*CLUSTER, "field").agg(
        F.min_by("field_value", order).alias("field_value"),
        F.min_by("item_id", order).alias("winner_id"),
        F.min_by("confidence", order).alias("confidence"),
        F.min_by("importance", order).alias("importance"),
        F.min_by("stability", order).alias("stability"), F.min(place).alias("first_seen"))


def field_conflicts(values: DataFrame) -> DataFrame:
    """Values that lost to a different one of the same field."""
    winners = field_winners(values).select(
        *CLUSTER, "field", F.col("field_value").alias("kept"), "winner_id")
    return (values.join(winners, [*CLUSTER, "field"])
            .filter(F.lower("field_value") != F.lower("kept"))
            .select(*CLUSTER, "field", "item_id", F.col("field_value").alias("dropped"), "kept",
                    "winner_id",
                    F.concat(F.lit("kept "), F.col("kept"),
                             F.lit(" due to higher confidence")).alias("resolution")))


def consolidate(items: DataFrame, min_size: int = V.MIN_CLUSTER_SIZE) -> DataFrame:
    """New records: one architecture item per cluster with two or more fields."""
    return records_of(written(field_values(items, min_size)))


def records_of(values: DataFrame) -> DataFrame:
    """The records that stored field values make.

    Fields per cluster are few (the stack fields), so a record's map is small."""
    winners = field_winners(values)
    unique = winners.groupBy(*CLUSTER, "winner_id").agg(
        F.first("confidence").alias("confidence"), F.first("importance").alias("importance"),
        F.first("stability").alias("stability"))
    scores = unique.groupBy(*CLUSTER).agg(
        F.round(F.round(F.avg("confidence"), 9), 3).alias("confidence"),
        F.round(F.greatest(F.lit(0.95), F.max("importance")), 3).alias("importance"),
        F.greatest(F.lit(0.85), F.max("stability")).alias("_s"))
    sources = values.groupBy(*CLUSTER).agg(F.countDistinct("item_id").alias("source_count"))
    pairs = F.array_sort(F.collect_list(F.struct("first_seen", "field", "field_value")))
    records = winners.groupBy(*CLUSTER).agg(pairs.alias("_p")).filter(F.size("_p") >= 2)
    joined = records.join(scores, CLUSTER).join(sources, CLUSTER)
    text = F.array_join(F.transform("_p", lambda p: F.concat(
        p["field"], F.lit("="), p["field_value"])), ", ")
    label = stability_label(col("_s"))
    shaped = joined.withColumn("content", F.concat(
        F.expr(str(title_text(X.lit("tech_stack")))), F.lit(": "), text)).withColumn(
        "value", F.to_json(F.map_from_entries(F.transform("_p", lambda p: F.struct(
            p["field"].alias("key"), p["field_value"].alias("value"))))))
    return shaped.selectExpr(
        *CLUSTER, "content", "value", "'architecture' AS type", "cluster AS topic_key",
        "split_part(cluster, '.', 1) AS scope", "split_part(cluster, '.', 1) AS subject",
        "'tech_stack' AS predicate", "confidence", "importance",
        f"{stability_score(label)} AS stability", f"{label} AS stability_label",
        "source_count", "size(_p) AS field_count",
        "concat('Merged ', size(_p), ' stack fields from ', source_count, ' memories.') AS note")


def superseded_by_consolidation(items: DataFrame,
                                min_size: int = V.MIN_CLUSTER_SIZE) -> DataFrame:
    """Items that contributed to a new record and are superseded by it."""
    return sources_of(written(field_values(items, min_size)))


def sources_of(values: DataFrame) -> DataFrame:
    """Items behind the records that stored field values make: those of two or more fields."""
    made = values.groupBy(*CLUSTER).agg(F.min("field").alias("a"), F.max("field").alias("b"))
    return values.join(made.filter("a < b").select(*CLUSTER), CLUSTER, "left_semi").select(
        *CLUSTER, "item_id").distinct()
