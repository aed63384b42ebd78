"""Best-fit packing of token runs, certified by dual-feasible-function lower bounds.

Remainders shorter than a sequence are dealt into groups, each packed best-fit decreasing.
A lower bound on the group's bins comes from dual-feasible functions; groups that miss it hand
the documents of their unfilled bins to a common exchange, which is dealt and packed again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C
from engram.llm.tokens import encoder

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
          "row long")


def lower_bound(counts: np.ndarray) -> int:
    """Fewest bins of capacity len(counts) - 1 for counts[s] items of size s.

    The largest of: total size; the threshold functions that round items over C - e up to C
    and items under e down to 0; the rounding functions of k + 1 steps; and both composed.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1, dtype=np.int64)
    if not counts.any():
        return 0
    rounded = [(sizes, capacity)]
    for k in range(1, 13):
        exact = sizes * (k + 1) % capacity == 0
        value = np.where(exact, sizes * k, (sizes * (k + 1) // capacity) * capacity)
        rounded.append((value, capacity * k))
    best = 0
    edges = np.unique(np.concatenate(([0], np.linspace(1, capacity // 2, 257).astype(np.int64))))
    for edge in edges:
        kept = np.where(sizes > capacity - edge, capacity, np.where(sizes < edge, 0, sizes))
        for value, unit in rounded:
            best = max(best, -(-int((counts * value[kept]).sum()) // unit))
    return best


def best_fit(lengths: np.ndarray, capacity: int):
    """Best-fit decreasing: bin and offset of every item, and the fill of every bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0
    for item in order.tolist():
        size = int(lengths[item])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, chosen = capacity, len(fill)
            fill.append(0)
        bins[item], offsets[item] = chosen, fill[chosen]
        fill[chosen] += size
        left = room - size
        open_bins[left].append(chosen)
        mask |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Token runs of at most `capacity` ids; only longer documents are cut, the first piece short.

    Null text is empty and has the end id alone.  A full run is a sequence of its own at once.
    `row` tells rows with the same id apart.
    """

    def cut(batches):
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        row = part << 33
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for first in range(0, len(column), 512):
                out = []
                encoded = words.encode(column.slice(first, 512).to_pylist())
                for doc, raw in zip(keys.slice(first, 512).to_pylist(), encoded, strict=True):
                    size, begin, piece = len(raw) // 4, 0, 0
                    while begin < size:
                        end = begin + (((size - begin) % capacity) or capacity)
                        full = 2 * row + 1 if end - begin == capacity else None
                        out.append((doc, piece, begin, end - begin,
                                    zlib.crc32(raw[4 * begin:4 * end]), full, row))
                        begin, piece, row = end, piece + 1, row + 1
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                           "row"])

    return C.texts(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, group_items: int = 20_000,
         rounds: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    group_items bounds the pieces one task packs; rounds bounds the exchanges.  Sequences are
    numbered 2 * piece row (+ 1 for full pieces), unique over the result.  An empty table gives no row.
    """
    runs = C.staged(pieces(docs, tokenizer, capacity), "token-runs")
    full = runs.filter("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))
    rest = runs.filter("sequence_id is null")
    done = [full.drop("row")]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1))
        # The first item of a bin is at offset 0 and names it.
        names = np.zeros(len(fill), np.int64)
        heads = np.flatnonzero(offsets == 0)
        names[bins[heads]] = 2 * frame["row"].to_numpy()[heads]
        frame["sequence_id"], frame["offset"] = names[bins], offsets
        frame["final"] = (len(fill) <= bound) | (fill[bins] == capacity)
        return frame.drop(columns=["_group"])

    shape = PIECES + ", offset long, final boolean"
    left = rest.count()
    before = None
    for step in range(rounds):
        if not left:
            break
        groups = -(-left // group_items)
        packed = C.staged(
            rest.withColumn("_group", F.pmod(F.xxhash64("row", F.lit(step)), F.lit(groups)))
            .groupBy("_group").applyInPandas(fit, shape), "packed-runs")
        opened = packed.filter("not final")
        found = packed.agg(F.count_distinct("sequence_id").alias("all"),
                           F.count_if(~F.col("final")).alias("open"),
                           F.count_distinct(F.when(~F.col("final"), F.col("sequence_id")))
                           .alias("bins")).first()
        if before is not None and found["all"] >= before[1]:
            break
        if before is not None:
            done.pop()
        done.append(packed.filter("final").drop("row", "final"))
        done.append(opened.drop("row", "final"))
        rest, left, before = opened.drop("offset", "final"), found["open"], (step, found["bins"])
        if groups == 1:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
