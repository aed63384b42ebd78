"""Near-duplicate documents by HyperMinHash.

A text's set of word shingles is hashed into buckets; each bucket stores the leading-zero
count of its smallest value and the mantissa bits behind it.  Bands of these compressed
registers propose candidates, a collision-corrected Jaccard estimate sorts out hopeless ones,
and the rest is verified on full sets.  Equal sets are one class throughout, so that copies
are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import common as C
from engram.llm.components import components

ROWS_PER_BAND = 4
BANDS = 24
BUCKETS = ROWS_PER_BAND * BANDS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Standard deviations that an estimate may lie below the threshold and still be verified.
MARGIN = 6.0
#: Expected share of accidental matches of registers: 2^-MANTISSA times this, at equal sizes.
ACCIDENT = 0.169919487159739093975315012348
_FACTORS = np.random.default_rng(77).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.array([0x1D8E4E27C47D124F, 0x5851F42D4C957F2D], dtype=np.uint64)
#: For every bucket, the buckets an empty one borrows from, in this order.
_LENDERS = np.stack([np.random.default_rng(1000 + b).permutation(BUCKETS) for b in range(BUCKETS)])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int):
    """Distinct hashed shingles of a slice, ascending per row: keys and rows.

    A row with fewer words than `size` has its whole word sequence as one shingle.
    """
    hashes, rows = C.word_hashes(data, offsets)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    keys, owners = [], []
    if len(hashes) >= size:
        full = len(hashes) - size + 1
        total = np.zeros(full, dtype=np.uint64)
        for j in range(size):
            total += hashes[j:j + full] * _FACTORS[j]
        same = rows[:full] == rows[size - 1:]
        keys.append(C.mix(total[same]))
        owners.append(rows[:full][same])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count)[short] - count[short]
        total = count[short].astype(np.uint64) * _FACTORS[-1]
        for j in range(size - 1):
            has = count[short] > j
            total[has] += hashes[first[has] + j] * _FACTORS[j]
        keys.append(C.mix(total))
        owners.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[fresh], owners[fresh]


def registers(keys: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
    """(count, BUCKETS) registers: leading zeros above MANTISSA bits; EMPTY where no value fell."""
    out = np.full((count, BUCKETS), EMPTY, dtype=np.uint16)
    if not len(keys):
        return out
    spread = (keys >> np.uint64(32)) * np.uint64(BUCKETS)
    bucket = (spread >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (owners[1:] != owners[:-1])
    low = (spread[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = np.frexp(low.astype(np.float64))[1].astype(np.int64)
    mantissa = ((low << (33 - length)) & 0xFFFFFFFF) >> (32 - MANTISSA)
    out[owners[first], bucket[first]] = ((32 - length) << MANTISSA) | mantissa
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(count, BANDS) 64-bit keys of four registers each.

    An empty register borrows from the first filled one in its own fixed order, so that a
    band match stays as likely as the similarity to the fourth power for small sets.
    """
    filled = regs != EMPTY
    out = regs.copy()
    row, bucket = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for step in range(BUCKETS):
        if not len(row):
            break
        lender = _LENDERS[bucket, step]
        found = filled[row, lender]
        out[row[found], bucket[found]] = regs[row[found], lender[found]]
        row, bucket = row[~found], bucket[~found]
    return np.ascontiguousarray(out).view(np.int64).reshape(len(regs), BANDS)


def _signatures(words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in C.slices(batch.column(1)):
                count = len(offsets) - 1
                keys, owners = shingles(data, offsets, words)
                size = np.bincount(owners, minlength=count)
                sums = []
                for salt in _SALTS:
                    total = np.zeros(len(keys) + 1, dtype=np.uint64)
                    np.cumsum(C.mix(keys ^ salt), out=total[1:])
                    ends = np.cumsum(size)
                    sums.append((total[ends] - total[ends - size]).view(np.int64))
                regs = registers(keys, owners, count)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, count), pa.array(size, pa.int64()), pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * BANDS,
                                             pa.array(band_keys(regs).reshape(-1)))],
                    names=["doc_id", "n", "set_a", "set_b", "registers", "bands"])

    return run


SIGNATURE = "doc_id long, n long, set_a long, set_b long, registers binary, bands array<long>"


def _sets(words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in C.slices(batch.column(1)):
                count = len(offsets) - 1
                keys, owners = shingles(data, offsets, words)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=count))))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, count),
                    pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(keys.view(np.int64)))],
                    names=["doc_id", "keys"])

    return run


def _estimate(threshold: float):
    """Rows of pairs with both registers -> whether the pair is worth a full comparison."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16)
                           .reshape(-1, BUCKETS) for c in (2, 3))
            n, m = (batch.column(c).to_numpy().astype(float) for c in (4, 5))
            used = ((left != EMPTY) | (right != EMPTY)).sum(axis=1)
            equal = ((left == right) & (left != EMPTY)).sum(axis=1)
            chance = ACCIDENT / 2**MANTISSA * 4 * n * m / (n + m) ** 2 * used
            jaccard = (equal - chance) / np.maximum(used, 1)
            slack = MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            chosen = pa.array(jaccard >= threshold - slack)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])

    return run


def _covered(groups: DataFrame) -> DataFrame:
    """Groups (c, id; c among its own ids) without those whose members are all in one other.

    Every id names the largest group it is in; a group all of whose members name the same
    other group lies within it."""
    size = groups.groupBy("c").agg(F.count("*").alias("n"))
    best = (groups.join(size, "c").groupBy("id")
            .agg(F.max_by("c", F.struct("n", "c")).alias("best")))
    kept = (groups.join(best, "id").groupBy("c")
            .agg(F.min("best").alias("lo"), F.max("best").alias("hi"))
            .filter("lo <> hi or lo = c").select("c"))
    return groups.join(kept, "c")


def _prefix(rows: DataFrame, percent: int) -> DataFrame:
    """c, e, id, component, out, n: the elements beyond the center that a link must meet on.

    A linked y shares percent of x at least, and no more than x and c share lies in the center;
    so they share k elements that c lacks, k = what is left.  With these elements in one order,
    rare ones of the group first, the first common one is among the first size - k + 1 of each.
    """
    shared = F.col("n") - F.size("added")
    k = F.greatest(F.floor((F.col("n") * percent + 99) / 100) - shared, F.lit(1))
    each = rows.select("c", F.explode("added").alias("e"), "id", "component", "out", "n",
                       (F.size("added") - k + 1).alias("_most"))
    rarity = each.groupBy("c", "e").agg(F.count("*").alias("_met"))
    order = Window.partitionBy("c", "id").orderBy("_met", "e")
    # An element that only one member has still counts among its first ones.
    return (each.join(rarity, ["c", "e"]).withColumn("_place", F.row_number().over(order))
            .filter("_place <= _most and _met > 1").drop("_met", "_place", "_most"))


def _candidates(group: DataFrame, sets: DataFrame, percent: int):
    """Where else members of a group (c, id, component, center_component) that are not linked
    to its center c can have a link: added (c, e, id, component, out, n) and pairs (a, b).

    Let x be no link of c.  If x and y are linked, both have an element that c lacks, or both
    lack an element of c: else the common part of x and y is no larger than that of x and c
    and their union no smaller.  `added` lists elements that c lacks.  In the other case y can
    have at most (100 + percent) / percent * |x and c| - |x| elements, and x likewise, which
    few pairs meet; these pairs are listed.
    """
    busy = group.filter("component <> center_component").select("c").distinct()
    rows = (group.join(busy, "c").join(sets.toDF("id", "x"), "id").join(sets.toDF("c", "y"), "c")
            .select("c", "id", "component",
                    (F.col("component") != F.col("center_component")).alias("out"),
                    F.size("x").alias("n"), F.array_except("x", "y").alias("added"),
                    F.array_except("y", "x").alias("lost")))
    rows = C.staged(rows, "differences")
    most = F.floor((F.col("n") - F.size("added")) * (100 + percent) / percent) - F.col("n")
    reach = rows.withColumn("most", most)
    # Only members that are small enough for some member not linked to the center.
    room = reach.filter("out").groupBy("c").agg(F.max("most").alias("room"),
                                                F.min("n").alias("least"))
    small = rows.groupBy("c").agg(F.min("n").alias("smallest"))
    fit = reach.join(room, "c").join(small, "c")
    x = fit.filter("out and most >= smallest").select(
        "c", F.explode("lost").alias("e"), F.col("id").alias("a"), F.col("n").alias("n_a"),
        F.col("most").alias("most_a"), F.col("component").alias("from"))
    y = fit.filter("n <= room and most >= least").select(
        "c", F.explode("lost").alias("e"), F.col("id").alias("b"), F.col("n").alias("n_b"),
        F.col("most").alias("most_b"), F.col("component").alias("to"))
    pairs = (x.join(y, ["c", "e"]).filter("from <> to and n_b <= most_a and n_a <= most_b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return _prefix(rows, percent), pairs


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of
    `words`-word shingles (A-Z lower-cased, split at ASCII white space).  A band of four of 96
    registers is equal with probability s^4, so a link at similarity s is proposed by none of
    24 bands with (1 - s^4)^24: 3e-6 at 0.8.  Null or wordless texts have no shingle and no
    link; rows without an id are linked with nothing and kept; rows that share an id are one
    node.  component_id is the smallest id reachable.

    Members of a bucket are compared with its most central one.  Those that are not linked to
    it are put into new buckets by the elements that the center lacks, `rounds` times; members
    of the last buckets that are still in different components are compared with each other.
    """
    threshold = percent / 100
    source = C.texts(docs)
    signed = C.staged(source.mapInArrow(_signatures(words), SIGNATURE), "signatures")
    linked = signed.filter("n > 0 and doc_id is not null")
    classes = C.staged(linked.groupBy("n", "set_a", "set_b").agg(
        F.min("doc_id").alias("id"), F.first("registers").alias("registers"),
        F.first("bands").alias("bands")), "classes")

    bands = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = (bands.groupBy("band", "key").agg(
        F.min("id").alias("_first"), F.max("id").alias("_last"), F.count("*").alias("weight"))
        .filter("_first <> _last").select("band", "key", "weight"))
    members = C.staged(bands.join(buckets, ["band", "key"]), "buckets")
    # A text that meets many others in many bands is central to them.
    central = C.staged(members.groupBy("id").agg(F.sum("weight").alias("weight")), "centrality")
    sets = C.staged(source.join(central.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
                    .mapInArrow(_sets(words), "doc_id long, keys array<long>")
                    .distinct(), "sets")
    regs = classes.select("id", "registers", "n")

    def verified(pairs: DataFrame) -> DataFrame:
        seen = (pairs.join(regs.toDF("a", "left", "n"), "a").join(regs.toDF("b", "right", "m"), "b")
                .select("a", "b", "left", "right", "n", "m")
                .mapInArrow(_estimate(threshold), "a long, b long"))
        both = F.size(F.array_intersect("x", "y")).cast("long")
        return C.staged(
            seen.distinct().join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
            .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
            .filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)
            .select("a", "b"), "verified")

    def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Buckets -> (c, id): each member with the most central one of its bucket."""
        heads = (rows.join(central, "id").groupBy(*keys)
                 .agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("c")))
        pairs = rows.join(heads, keys).select("c", "id")
        return pairs.unionByName(pairs.select("c", F.col("c").alias("id"))).distinct()

    def cross(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Buckets with members of different components, one of them not linked to the center."""
        kept = (rows.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component")
                                        .alias("hi"), F.bool_or("out").alias("any"))
                .filter("lo <> hi and any").select(*keys))
        return C.staged(rows.join(kept, keys), "open-buckets")

    group = C.staged(grouped(members.select("band", "key", "id"), ["band", "key"]), "groups")
    links = verified(group.filter("c <> id").select(F.col("c").alias("a"), F.col("id").alias("b")))
    found = components(links)
    for step in range(rounds):
        place = found.withColumnRenamed("node", "id")
        placed = (_covered(group).join(place, "id", "left")
                  .withColumn("component", F.coalesce("component", "id"))
                  .join(found.toDF("c", "center_component"), "c", "left")
                  .withColumn("center_component", F.coalesce("center_component", "c")))
        placed = C.staged(placed, "placed")
        if placed.filter("component <> center_component").isEmpty():
            break
        added, pairs = _candidates(placed, sets, percent)
        open_ = cross(added, ["c", "e"])
        if step + 1 < rounds:
            group = C.staged(grouped(open_.withColumnRenamed("c", "g").select("g", "e", "id"),
                                     ["g", "e"]), "groups")
            tested = group.filter("c <> id").select(F.col("c").alias("a"), F.col("id").alias("b"))
        else:
            other = open_.select("c", "e", F.col("id").alias("b"), F.col("component").alias("to"),
                                 F.col("n").alias("m"))
            # Sizes of linked sets differ by no more than the threshold lets them.
            tested = (open_.withColumnRenamed("id", "a").join(other, ["c", "e"])
                      .filter("component <> to and a < b")
                      .filter((F.col("n") * percent <= F.col("m") * 100)
                              & (F.col("m") * percent <= F.col("n") * 100)).select("a", "b"))
        more = verified(pairs.unionByName(tested).distinct())
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)
        if group.isEmpty():
            break

    classed = (signed.select("doc_id", "n", "set_a", "set_b")
               .join(classes.select("n", "set_a", "set_b", "id"), ["n", "set_a", "set_b"], "left"))
    return (classed.join(found, F.col("id") == F.col("node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(),
                           F.coalesce("component", "id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, with the columns docs came with."""
    return C.without(docs, lambda rows: near_groups(rows, words, percent).filter("not kept"))
