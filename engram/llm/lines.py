"""Line dedup over overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C

#: Blanks at a line's ends that do not count.
BLANKS = " \t\r"
#: Orders rows without an id after all others.
LAST = 2**63 - 1


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """_place, line, a, b: a 128-bit hash of every run of `size` lines that is not all blank."""
    trimmed = F.transform("_lines", lambda x: F.trim(x, F.lit(BLANKS)))
    lines = docs.select("_place", trimmed.alias("_lines")).select(
        "_place", F.transform("_lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("_lines", lambda x: F.xxhash64(F.lit(1), x)).alias("g"),
        F.transform("_lines", lambda x: x == "").alias("blank"))
    at = lines.filter(F.size("h") >= size).select(
        "_place", "h", "g", "blank",
        F.explode(F.sequence(F.lit(0), F.size("h") - size)).alias("line"))
    item = lambda c, j: F.col(c)[F.col("line") + j]
    blank = item("blank", 0)
    for j in range(1, size):
        blank = blank & item("blank", j)
    return at.filter(~blank).select(
        "_place", "line", F.xxhash64(*[item("h", j) for j in range(size)]).alias("a"),
        F.xxhash64(*[item("g", j) for j in range(size)]).alias("b"))


def drop_repeated_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text without repeated windows, n_lines, n_removed of every row.

    Lines are cut at line feeds and compared without blanks at their ends.  Of a run of `size`
    lines that occurs more than once, the place with the smallest (doc_id, mark, line) stays; lines
    covered by any later place are removed, judged on the input.  Runs of blank lines only,
    texts of fewer lines and null texts (read as empty, one line) lose nothing.  Rows without
    an id come last.  Rows that share id and text are one place; those that share an id (or have
    none) and differ in text are told apart by its hash.
    """
    row = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), C.mark().alias("mark"))
    source = C.texts(docs).select("doc_id", row.alias("_place"),
                                  F.split("text", "\n", -1).alias("_lines"))
    windows = _windows(source, size)
    # Occurrences are combined before the shuffle; only repeated windows are written.
    first = C.staged(windows.groupBy("a", "b").agg(
        F.min(F.struct("_place", "line")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"), "repeated-windows")
    later = windows.join(first, ["a", "b"]).filter(F.struct("_place", "line") > F.col("first"))
    starts = later.groupBy("_place").agg(F.collect_set("line").alias("_starts"))
    covered = F.array_distinct(F.flatten(F.transform(
        "_starts", lambda s: F.sequence(s, s + (size - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered)
    return (source.join(starts, "_place", "left")
            .withColumn("_kept", F.when(F.col("_starts").isNotNull(), kept))
            .select("doc_id",
                    F.array_join(F.when(F.col("_kept").isNull(), F.col("_lines")).otherwise(
                        F.transform("_kept", lambda i: F.col("_lines")[i])), "\n").alias("text"),
                    F.size("_lines").cast("long").alias("n_lines"),
                    F.when(F.col("_kept").isNull(), 0)
                    .otherwise(F.size("_lines") - F.size("_kept")).cast("long")
                    .alias("n_removed")))


ORACLE_SQL = r"""
    WITH split AS (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    pos AS (
      SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS line FROM split WHERE len(ls) >= 3),
    win AS (
      SELECT doc_id, line, trim(ls[line + 1], ' ' || chr(9) || chr(13)) AS x,
             trim(ls[line + 2], ' ' || chr(9) || chr(13)) AS y,
             trim(ls[line + 3], ' ' || chr(9) || chr(13)) AS z FROM pos),
    ranked AS (
      SELECT doc_id, line, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, line) AS n
      FROM win WHERE x <> '' OR y <> '' OR z <> ''),
    gone AS (
      SELECT DISTINCT doc_id, line + unnest([0, 1, 2]) AS line FROM ranked WHERE n > 1),
    rows AS (
      SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS l FROM split),
    kept AS (
      SELECT r.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
             coalesce(string_agg(CASE WHEN g.line IS NULL THEN r.l END, chr(10) ORDER BY r.line), '')
               AS t
      FROM rows r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.line = g.line GROUP BY r.doc_id)
    SELECT doc_id, n_lines, n_removed, sha256(t) AS kept_sha256 FROM kept"""
