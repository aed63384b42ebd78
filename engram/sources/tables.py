"""Table scans and the message views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Messages of a task: text rules take some seconds for them.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Deals a table out to tasks of at most TASK_ROWS rows, and to every core.

    Text rules cost far more than moving the rows, whose scan makes few and unequal tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))


def pick(index: str, values) -> str:
    """SQL choosing one of the values by ``index`` modulo their number."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} % {len(values)} {cases} END"


LANGUAGES = ("TypeScript", "Python", "Go", "Rust", "Kotlin")
COLORS = ("blue", "red", "teal", "green", "navy", "black")
DATABASES = ("Neon", "Turso", "Postgres", "MySQL")
ATTRIBUTES = ("region", "budget", "deployment target", "owner", "deadline", "alert channel")
VALUES = ("eu-west-1", "9000 dollars", "AWS Lambda", "Alice", "Q4", "team-7", "Cloudflare")
_PROJECT = "'Project', user_id % 9"

# Utterance templates per event type: SQL argument lists of concat(), chosen by k.
# The text is the same expression in Spark and in the SQL used to check it.
UTTERANCES = {
    "signup": (
        "'My name is User', user_id",
        f"'I live in ', {pick('k', ('Oslo', 'Lima', 'Pune', 'Accra', 'Quito'))}",
        f"'My favourite colour is ', {pick('k', COLORS)}, ' now.'",
        f"'I am building a project called ', {_PROJECT}, '.'",
    ),
    "purchase": (
        f"'I prefer ', {pick('k', LANGUAGES)}",
        "'I prefer Svelte over Angular.'",
        f"'I love ', {pick('k', COLORS)}, '!'",
        f"'I don', chr(39), 't like ', {pick('k', COLORS)}",
        f"'My preferred database is ', {pick('k', DATABASES)}",
        "'I hate long meetings anymore'",
    ),
    "click": (
        f"'The ', {pick('k', ATTRIBUTES)}, ' is ', {pick('k', VALUES)}",
        f"'The ', {pick('k', ATTRIBUTES)}, ' is ', {pick('k', VALUES)}, '.'",
        f"'Note: the ', {pick('k', ATTRIBUTES)}, ' is ', {pick('k', VALUES)}",
        f"{_PROJECT}, ' uses ', {pick('k', DATABASES)}, ' for database'",
        f"{_PROJECT}, ' uses Hono as the framework, ', {pick('k', DATABASES)}, "
        "' for database and S3 as storage'",
        f"'We switched to ', {pick('k', DATABASES)}, ' for the database.'",
        f"{_PROJECT}, chr(39), 's architecture is event driven v', k % 3",
    ),
    "error": (
        "'The current error is E', k",
        "'I', chr(39), 'm currently debugging the login flow ', k",
        "'never deploy on day ', k % 7",
        f"'We decided to use ', {pick('k', DATABASES)}, ' for events'",
        "'deployed release ', k",
    ),
    "view": (
        "'ok, thanks!'",
        "'What database does it use?'",
        f"'Actually, the stack changed from ', {pick('k', DATABASES)}, ' to ', "
        f"{pick('(k + 10)', DATABASES)}",
        f"'The ', {pick('k', ATTRIBUTES)}, ' was reset'",
        "'Maybe we use Redis'",
        "'The region was changed to eu-', k % 3",
        f"'Please ignore the previous ', {pick('k', ATTRIBUTES)}",
        f"'My name is User', user_id, '. The ', {pick('k', ATTRIBUTES)}, ' is ', "
        f"{pick('k', VALUES)}, '. ok'",
        f"'My name is User', user_id, ' and I prefer ', {pick('k', LANGUAGES)}",
        f"'The ', {pick('k', ATTRIBUTES)}, ' was reset; forget Alice'",
    ),
}

# Statements for the extended rules, chosen by k whatever the event type.
STATEMENTS = (
    "'My name is User', user_id, '.'",
    "'I', chr(39), 'm ', 18 + k % 60, ' years old'",
    "'I am a backend developer and I live in Oslo'",
    "'I own a ', CASE k % 3 WHEN 0 THEN 'bakery' WHEN 1 THEN 'headache' ELSE 'boat' END",
    f"'my editor is ', {pick('k', ('vim', 'emacs', 'helix'))}",
    f"'I currently use ', {pick('k', DATABASES)}, ' but now I use ', {pick('(k + 10)', DATABASES)}",
    f"'I used to use ', {pick('k', DATABASES)}, ', but now I use ', {pick('(k + 10)', DATABASES)}",
    f"'I stopped using ', {pick('k', DATABASES)}, ' because it was slow.'",
    f"'I prefer ', {pick('k', LANGUAGES)}, ' over Java'",
    f"'I really love ', {pick('k', COLORS)}",
    "'I don', chr(39), 't like tabs anymore'",
    f"'My favorite programming language is ', {pick('k', LANGUAGES)}",
    "'I want to learn ', CASE k % 2 WHEN 0 THEN 'Spark' ELSE 'Flink' END",
    "'I plan to move to Lima and I prefer tea'",
    "'I might visit Quito'",
    f"'I decided to ship with ', {pick('k', DATABASES)}",
    "'if tests pass then I will use Redis. I will use it'",
    "'I', chr(39), 'm testing Deno; I avoid tabs'",
    "'I don', chr(39), 't use Redis and I never use MySQL'",
    "'what is the plan', chr(63)",
)


def utterance_text() -> str:
    branches = " ".join(
        f"WHEN event_type = '{kind}' AND k % {len(texts)} = {i} THEN concat({text})"
        for kind, texts in UTTERANCES.items() for i, text in enumerate(texts))
    return f"CASE {branches} ELSE '' END"


def statement_text() -> str:
    branches = " ".join(f"WHEN {i} THEN concat({t})" for i, t in enumerate(STATEMENTS))
    return f"CASE k % {len(STATEMENTS)} {branches} END"


ROLE = ("CASE WHEN event_type = 'click' AND k % 13 = 0 THEN 'assistant' "
        "WHEN event_type = 'view' AND k % 17 = 0 THEN 'system' ELSE 'user' END")


def _spoken(spark: SparkSession, folder: str, text: str, role: str) -> DataFrame:
    events = spread(table(spark, folder, "events")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))
    return events.selectExpr("user_id", "event_id AS seq", "ts", f"{role} AS role",
                             f"{text} AS content")


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    """Messages said by the users of the events table, one per event."""
    return _spoken(spark, folder, utterance_text(), ROLE)


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that exercise the extended rules, one per event."""
    return _spoken(spark, folder, statement_text(), "'user'")


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as messages: a conversation is both the user and the request."""
    return spread(table(spark, folder, "conversations")).select(
        F.col("conv_id").alias("user_id"), F.col("conv_id").alias("request_id"),
        F.col("turn").cast("int").alias("ordinal"), "role", F.col("text").alias("content"))
