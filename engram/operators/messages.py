"""Request bodies -> normalised messages -> new rows of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions import sql as X
from engram.functions.sql import col
from engram.functions.text import content_hash, first_nonblank

MESSAGE = ("struct<role:string,content:string,id:string,message_id:string,"
           "tool_call_id:string,name:string,"
           "tool_calls:array<struct<function:struct<name:string,arguments:string>>>>")


def read_requests(spark, path: str) -> DataFrame:
    """JSON lines of request_id, user_id, ts and body (JSON text)."""
    schema = T.StructType([
        T.StructField("request_id", T.StringType()), T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()), T.StructField("body", T.StringType()),
        T.StructField("budget", T.IntegerType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def request_messages(requests: DataFrame) -> DataFrame:
    """One row per message of a body: ``messages`` objects, else ``input`` objects or
    strings, else an ``input`` string, else none.  Bad JSON gives no rows.

    ``tool_calls`` holds name and arguments of each call; ``content_parts`` the texts of a
    content that is a list, whose raw JSON stays in ``content``."""
    text = "array<string>"
    parsed = requests.withColumn("_m", F.get_json_object("body", "$.messages")).withColumn(
        "_i", F.get_json_object("body", "$.input"))
    # Elements stay JSON text, so that objects and strings can be told apart.
    listed = F.col("_m").startswith("[")
    inputs = F.col("_i").startswith("[")
    as_objects = F.filter(F.from_json("_m", text), lambda e: e.startswith("{"))
    as_inputs = F.transform(
        F.from_json("_i", text),
        lambda e: F.when(e.startswith("{"), e).otherwise(
            F.to_json(F.struct(F.lit("user").alias("role"), e.alias("content")))))
    single = F.array(F.to_json(F.struct(F.lit("user").alias("role"),
                                        F.col("_i").alias("content"))))
    items = (F.when(listed, as_objects).when(inputs, as_inputs)
             .when(F.col("_i").isNotNull(), single))
    rows = parsed.select(
        *[c for c in requests.columns if c != "body"],
        F.posexplode_outer(items).alias("ordinal", "_json")).filter("_json is not null")
    message = rows.withColumn("_s", F.from_json("_json", MESSAGE)).withColumn(
        "_parts", F.from_json("_json", "struct<content:array<string>>")["content"])
    part = F.transform("_parts", lambda p: F.when(
        p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
    calls = F.transform("_s.tool_calls", lambda c: F.struct(
        c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
    return message.select(
        *[c for c in requests.columns if c != "body"], "ordinal",
        *[F.col(f"_s.{f}").alias(f) for f in ("role", "content", "id", "message_id",
                                              "tool_call_id", "name")],
        calls.alias("tool_calls"), part.alias("content_parts"))


def normalize_messages(messages: DataFrame) -> DataFrame:
    """Adds role and content defaults, content_hash, client_message_id and message_key.

    A client id makes the key; otherwise the hash of role, content and ordinal does."""
    names = set(messages.columns)
    ids = [col(n) for n in ("id", "message_id") if n in names]
    if "tool_call_id" in names:
        tool = first_nonblank(col("tool_call_id"))
        ids.append(X.concat("tool:", tool))
    client = first_nonblank(*ids) if ids else X.lit(None).cast("string")
    role = X.when(X.coalesce(col("role"), "") == "", "user").otherwise(col("role"))
    others = [f"`{c}`" for c in messages.columns if c not in ("role", "content")]
    rows = messages.selectExpr(
        *others, str(role.alias("role")), str(X.coalesce(col("content"), "").alias("content")),
        str(client.alias("client_message_id")))
    unkeyed = X.when(col("client_message_id").isNull(), col("ordinal").cast("int"))
    hashed = rows.selectExpr("*", str(content_hash(col("role"), col("content"), unkeyed)
                                      .alias("content_hash")))
    key = X.when(col("client_message_id").isNotNull(), X.concat("id:", col("client_message_id"))
                 ).otherwise(X.concat("hash:", col("content_hash")))
    return hashed.selectExpr("*", str(key.alias("message_key")))


def detect_delta(batch: DataFrame, archive: DataFrame,
                 order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Adds delta_status: 'new' for the first row of a key the archive lacks, else
    'duplicate'.

    Exactly one row of a key is new, also when the batch holds a message twice: rows are
    ordered by ``order`` and then by all their other columns, and of rows equal in every
    column the first copy counts.  The first occurrence is an aggregate (combined before the
    shuffle) joined back, not a window: one message repeated by a third of all rows stays
    cheap."""
    keys = ["user_id", "message_key"]
    columns = batch.columns
    place = F.struct(*order, *[c for c in columns if c not in order])
    rows = batch.groupBy(*columns).agg(F.count("*").alias("_copies"))
    first = rows.groupBy(*keys).agg(F.min(place).alias("_first"))
    unseen = first.join(archive.select(*keys), keys, "left_anti")
    joined = rows.join(unseen, keys, "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return joined.select(*columns, F.when(
        (place == F.col("_first")) & (F.col("_copy") == 1), "new").otherwise("duplicate")
        .alias("delta_status"))


def delta_counts(delta: DataFrame) -> DataFrame:
    return delta.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("delta_status") == "new").alias("new"),
        F.count_if(F.col("delta_status") == "duplicate").alias("duplicate"))


def new_users(messages: DataFrame, users: DataFrame, at: str) -> DataFrame:
    """Users not yet known, with the time they were first seen."""
    seen = messages.groupBy("user_id").agg(F.min(at).alias("created_at"))
    return seen.join(users.select("user_id"), "user_id", "left_anti")


def append_new(delta: DataFrame, path: str) -> None:
    """Appends the new rows to the archive table (safe to repeat: see detect_delta)."""
    delta.filter("delta_status = 'new'").drop("delta_status").write.mode("append").parquet(path)


def with_position(messages: DataFrame) -> DataFrame:
    """Adds total_messages and turns_from_end per request (0 = latest message).

    Ordinals number a request's messages from 0, so the last one is a maximum: an
    aggregate joined back rather than a window over the request."""
    last = messages.groupBy("request_id").agg(F.max("ordinal").alias("_last"))
    return messages.join(last, "request_id").select(
        *messages.columns, (F.col("_last") + 1).alias("total_messages"),
        (F.col("_last") - F.col("ordinal")).alias("turns_from_end"))


def latest_user_text(messages: DataFrame) -> DataFrame:
    """The last user message of every request."""
    return messages.groupBy("request_id").agg(
        F.max_by("content", F.when(F.col("role") == "user", F.col("ordinal")))
        .alias("latest_user_text"))


def meaningful_batches(classified: DataFrame, batch: str) -> DataFrame:
    """Batches with at least one user or assistant message that is not low-information."""
    return classified.groupBy("user_id", batch).agg(F.bool_or(
        F.col("role").isin("user", "assistant") & ~F.col("low_info")).alias("meaningful"))
