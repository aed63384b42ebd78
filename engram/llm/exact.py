"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted externally, so that
equal texts are neighbours; each row is compared in full with the one before it.  A group
that spans partitions is put together from one summary row per partition edge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import common as C

BLANKS = r"[\x20\x09-\x0D]+"
ROWS = "doc_id long, keep_id long, group_size long, text_sha256 string, edge boolean, part int"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
#: Stands for a null id, which loses against every other.
LAST = np.iinfo(np.int64).max


#: Characters of a text in a splitter; two hashes and the id tell longer common beginnings apart.
SPLITTER = 16


def _ranged(df: DataFrame, text: str) -> DataFrame:
    """Rows range-partitioned by splitters of a bounded size, and sorted so that equal texts meet.

    Splitters are sampled from the beginnings of the texts, hashes of the whole ones and the ids,
    so that any two rows with equal texts are in the order of their ids and only rows with
    equal texts stand between them.
    """
    key = [F.substring(text, 1, SPLITTER), F.xxhash64(text), F.xxhash64(F.lit(1), F.col(text)),
           F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))]
    return df.repartitionByRange(*key).sortWithinPartitions(*key[:3], text, key[3])


def _runs(batches):
    """Rows in sort order -> each with its run's first id and size within this partition.

    Only ids are held for a run, and a run of the partition's first or last text is marked
    as an edge, since it may go on in another partition.
    """
    part = TaskContext.get().partitionId()
    out = [[] for _ in range(5)]
    ids, last, first = [], None, True

    def close(edge):
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(last.encode()).hexdigest()
        for column, values in zip(out, (ids, [keep] * len(ids), [len(ids)] * len(ids),
                                        [digest] * len(ids), [edge] * len(ids)), strict=True):
            column.extend(values)

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, KINDS, strict=True)]
            + [pa.array([part] * len(out[0]), pa.int32())],
            names=["doc_id", "keep_id", "group_size", "text_sha256", "edge", "part"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if last is not None and text == last:
                ids.append(key)
                continue
            if last is not None:
                close(first)
                first = False
                if len(out[0]) >= 5_000:
                    yield flush()
            ids, last = [key], text
    if last is not None:
        close(True)
        yield flush()


def content_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Null text counts as empty.  Among equal texts the smallest non-null id stays; rows with a
    null id stay only in a group without any other id.  Rows that repeat an id and a text
    count each, and all of them carry the id that stays.  An empty table gives no row.
    """
    clean = C.texts(docs).select(
        "doc_id", F.regexp_replace("text", BLANKS, " ").alias("_text"))
    runs = C.staged(_ranged(clean, "_text").mapInArrow(_runs, ROWS), "content-runs")
    # Two texts per partition at most are edges: as many rows as partitions, twice.
    pieces = (runs.filter("edge").groupBy("text_sha256", "part")
              .agg(F.min("keep_id").alias("_keep"), F.max("group_size").alias("_size")))
    whole = pieces.groupBy("text_sha256").agg(F.min("_keep").alias("_keep"),
                                              F.sum("_size").alias("_size"))
    return (runs.join(F.broadcast(whole), "text_sha256", "left")
            .select("doc_id", F.coalesce("_keep", "keep_id").alias("keep_id"),
                    F.coalesce("_size", "group_size").alias("group_size"), "text_sha256")
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def _leads(names: list[str]):
    """Whole rows in sort order, their last column being the normalised text, which is left out.

    Added: whether a text begins here, whether the row has the partition's first text, and
    digests of the text on the partition's very first and very last row; the partition.
    """
    return lambda batches: _leads_of(batches, names)


def _leads_of(batches, names: list[str]):
    part = TaskContext.get().partitionId()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    last, held, heading = None, None, True

    def flush(columns, final):
        rows = len(columns[-1])
        ends = [None] * (rows - 1) + [final]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(ends, pa.string()), pa.array([part] * rows, pa.int32())],
            names=names)

    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        rows = len(text)
        if not rows:
            continue
        if held:
            yield flush(held, None)
        lead = np.ones(rows, dtype=bool)
        lead[1:] = np.asarray(pa.compute.not_equal(text[1:], text[:-1]))
        lead[0] = last is None or text[0].as_py() != last
        begins = np.cumsum(lead)
        head = (begins <= (1 if last is None else 0)) & heading
        first = [digest(text[0].as_py()) if last is None else None] + [None] * (rows - 1)
        last, heading = text[-1].as_py(), bool(head[-1])
        held = [*batch.columns[:-1], pa.array(lead), pa.array(head), pa.array(first, pa.string())]
    if held:
        yield flush(held, digest(last))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns they came with.

    As content_groups decides; of rows that repeat id and text one stays.  Rows travel through
    the sort whole, so that nothing is joined back; one line per partition says whether its
    first text began in the one before.
    """
    text, lead, head, first, final, part, on = (
        C.fresh(docs, f"_{n}") for n in ("text", "lead", "head", "first", "final", "part", "on"))
    clean = docs.withColumn(text, F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " "))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = C.staged(_ranged(clean, text).mapInArrow(
        _leads([*docs.columns, lead, head, first, final, part]),
        f"{fields}, {lead} boolean, {head} boolean, {first} string, {final} string, "
        f"{part} int"), "content-rows")
    edges = (rows.filter(F.col(first).isNotNull() | F.col(final).isNotNull()).groupBy(part)
             .agg(F.max(first).alias("first"), F.max(final).alias("final")))
    before = F.lag("final").over(Window.orderBy(part))
    going_on = edges.withColumn("before", before).filter("before = first").select(
        part, F.lit(True).alias(on))
    return (rows.filter(lead).join(F.broadcast(going_on), part, "left")
            .filter(F.col(on).isNull() | ~F.col(head)).select(*docs.columns))
