"""Filter interaction audit: what every order of the quality filters would keep and lose.

Documents are counted in cells by the set of filters they fail (five bits, 32 cells a part).
A walk over all subsets of filters in Gray-code order toggles one filter at a time: each
cell counts the active filters it fails, and a running total of survivors moves when a cell's
counter leaves or reaches nought.  The 32 totals are stored, and a step of any order is the
difference of two of them.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C

LETTERS = "ABCDE"
#: The filter that looks at other rows; the ones before it look at the text alone.
REPEATED = LETTERS.index("E")
SPACE_RUN = r"[\x20\x09-\x0D]+"
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")
#: Parts whose rows go out together; every part makes 600 rows.
PARTS = 100


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    n = F.size(words)
    failed = [
        n < 50,
        100 * F.size(F.array_distinct(words)) < 65 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    bits = F.lit(0)
    for i, f in enumerate(failed):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return bits


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows by the filters they fail, with labelled rows among them.

    Null text counts as empty, null source as the empty part.  Rows that share an id are
    counted one by one and share its labels; several labels of an id count as any of them.
    A row without an id has no labels; it is not identical to a *smaller* id and never fails
    E, nor does it make others fail.  Texts are equal when their SHA-256 is.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"),
                        F.coalesce("source", F.lit("")).alias("part"))
    narrow = plain.select("id", "part", F.unhex(F.sha2("text", 256)).alias("h"),
                          text_failures(F.col("text")).alias("mask"))
    # Rows without an id are dealt out by their text, so that many of them share no task.
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.hex("h")))
    rows = narrow.withColumn("key", key).groupBy("key", "id", "h", "part", "mask").agg(
        F.count("*").alias("n"))
    known = labels.filter("doc_id is not null").groupBy(
        F.col("doc_id").cast("long").cast("string").alias("key")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    rows = rows.join(known, "key", "left").na.fill(0, ["good", "toxic"])
    # Copies are summed before and after the shuffle; the first of them is told by its id.
    # The sums are read twice, so they are written once.
    copies = C.staged(rows.groupBy("h", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless")), "copies")
    lowest = copies.groupBy("h").agg(F.min("low").alias("lowest"))
    first = F.when(F.col("low") == F.col("lowest"), F.col("at_low")).otherwise(0)
    counted = copies.join(lowest, "h").withColumn(
        "repeats", F.col("n") - F.col("nameless") - first)
    both = counted.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", (F.col("n") - F.col("repeats")).alias("n")),
        F.struct((F.col("mask") + (1 << REPEATED)).alias("mask"), F.col("repeats").alias("n"))))
        .alias("cell"))
    return both.filter("cell.n > 0").groupBy("part", "cell.mask").agg(
        F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"),
        F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"))


def gray_states(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters.

    counts: (parts, 2**filters, measures), by the mask of failed filters; the result has the
    same shape, by the mask of active filters.
    """
    size = counts.shape[1]
    active = np.zeros(size, dtype=np.int64)
    running = counts.sum(axis=1)
    states = np.empty_like(counts)
    states[:, 0] = running
    masks = np.arange(size)
    for k in range(1, size):
        subset = k ^ (k >> 1)
        bit = k & -k
        failing = (masks & bit) != 0
        if subset & bit:
            leave = failing & (active == 0)
            active[failing] += 1
            running = running - counts[:, leave].sum(axis=1)
        else:
            active[failing] -= 1
            back = failing & (active == 0)
            running = running + counts[:, back].sum(axis=1)
        states[:, subset] = running
    return states


def all_steps(filters: int):
    """Per order and step: order, step, filter, subset before and after; all orders."""
    rows = []
    for order in permutations(range(filters)):
        before = 0
        for step, f in enumerate(order):
            rows.append((order, step + 1, f, before, before | 1 << f))
            before |= 1 << f
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    doc_id, text, source of docs and doc_id, quality, toxic of labels are read; an empty table
    has no parts and no rows.  See cells() for nulls, repeated ids and repeated rows.
    """
    size = 1 << len(LETTERS)
    grouped = cells(docs, labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = all_steps(len(LETTERS))
    names = ["".join(LETTERS[f] for f in order) for order, *_ in steps]
    number, which, before, after = (np.array([s[i] for s in steps]) for i in (1, 2, 3, 4))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part, held = (batch.column(i).slice(at, PARTS) for i in (0, 1))
                flat = held.flatten()
                rows = np.repeat(np.arange(len(part)), np.diff(held.offsets.to_numpy()))
                column = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
                counts = np.zeros((len(part), size, 3), dtype=np.int64)
                for j in range(3):
                    counts[rows, column[0], j] = column[j + 1]
                states = gray_states(counts)
                lost = states[:, before] - states[:, after]
                fails = np.stack([counts[:, (np.arange(size) >> f) & 1 == 1, 0].sum(axis=1)
                                  for f in range(len(LETTERS))], axis=1)
                alone = counts[:, [1 << f for f in range(len(LETTERS))], 0]
                share = np.stack([lost[:, which == f, 0].sum(axis=1)
                                  for f in range(len(LETTERS))], axis=1)
                values = [states[:, after, 0], lost[..., 0], fails[:, which] - lost[..., 0],
                          alone[:, which], lost[..., 1], lost[..., 2], share[:, which]]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.take(pa.array(np.repeat(np.arange(n), len(steps)))),
                     pa.array(names * n, pa.string()),
                     pa.array(np.tile(number, n).astype(np.int32)),
                     *[pa.array(v.reshape(-1)) for v in values]],
                    names=[c.split()[0] for c in RESULT.split(", ")])

    return grouped.mapInArrow(run, RESULT)


ORACLE_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w
      FROM t),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
        100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x),
        regexp_matches(x, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)] AS bad FROM w),
c AS (SELECT part, bad, count(*) AS n, coalesce(sum(good), 0) AS good,
        coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || k FROM orders,
        (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(k) WHERE NOT contains(o, k)),
steps AS (SELECT o AS filter_order, s.step, substr(o, s.step, 1) AS letter,
        list_transform(range(1, s.step), lambda i: ascii(substr(o, i, 1)) - 64) AS earlier,
        ascii(substr(o, s.step, 1)) - 64 AS own
      FROM orders, (SELECT unnest(range(1, 6)) AS step) s WHERE length(o) = 5),
hit AS (SELECT part, filter_order, step, letter, n, good, toxic, bad[own] AS fails,
        len(list_filter(earlier, lambda i: bad[i])) > 0 AS gone,
        bad[own] AND len(list_filter(bad, lambda b: b)) = 1 AS only_this FROM c, steps),
sums AS (SELECT part, filter_order, step, letter,
        sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
      FROM hit GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM sums"""
