"""Shared helpers: table scans, stage tables, byte-level word splitting."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.session import shared_folder

#: White space of the word rule, as bytes: space and 0x09 to 0x0D.
SPACES = (0x20, *range(0x09, 0x0E))
#: Bytes of text that the array helpers take at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text, null read as empty; every other column is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))


def row_id():
    """doc_id, or for a null id a number over 2^62 made from the text, for joins back to rows."""
    made = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), made)


def mark():
    """A 128-bit hash of the text, which tells rows with the same id or without one apart."""
    return F.unhex(F.md5("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, rejected) -> DataFrame:
    """The rows of docs that rejected(doc_id, text) does not name, with docs' columns.

    Equal rows go together.  A row without an id, and of several texts under one id all but one
    (the one whose hash is smallest keeps the id), stand for themselves: they get a number over
    2^62 made from id and text.
    """
    name, first = fresh(docs, "_gone_id"), fresh(docs, "_first_mark")
    number = F.col("doc_id").cast("long")
    marks = docs.filter(number.isNotNull()).select(number.alias("doc_id"), mark().alias("m"))
    twice = staged(marks.groupBy("doc_id").agg(F.min("m").alias(first), F.max("m").alias("_last"))
                   .filter(F.col(first) != F.col("_last"))
                   .select(F.col("doc_id").alias(name), first), "repeated-ids")
    if twice.isEmpty():
        own, rows = row_id(), docs
    else:
        rows = docs.join(twice, number == F.col(name), "left").drop(name)
        made = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
        own = F.when(F.col(first).isNotNull() & (F.col(first) != mark()), made).otherwise(row_id())
    gone = rejected(rows.select(own.alias("doc_id"), "text")).select(
        F.col("doc_id").alias(name))
    return rows.join(gone, own == F.col(name), "left_anti").drop(first)


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a result several jobs read into the shared folder, in folders by the columns
    ``by`` if given, and read it back."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "engram-llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def crc_remainder(divisor: int):
    """crc32 of doc_id written as decimal text, modulo divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, row offsets) of consecutive rows of a string column.

    A slice holds `limit` bytes at most, or one longer text.
    """
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    count = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + count + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    row = 0
    while row < count:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), count)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        factors = np.full(max(size, SLICE_BYTES + 1), base, dtype=np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= SLICE_BYTES + 1:
            _powers[name] = have
    return have[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def prefix_sums(data: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """Running polynomial sums; a span's hash is a difference times an inverse power."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * _power_table("step", _STEP, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = _power_table("unstep", _UNSTEP, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SPACE):
    """Words of a slice: starts, ends (byte positions) and the row of each word."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~separators[data]
    opens = inside[1:] & ~inside[:-1]
    closes = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    opens[cuts] = True
    closes[cuts] = True
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SPACE):
    """Hash of every lower-cased (A-Z) word of a slice, and its row."""
    starts, ends, rows = words(data, offsets, separators)
    return span_hashes(prefix_sums(_LOWER[data]), starts, ends), rows
