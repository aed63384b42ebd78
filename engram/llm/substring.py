"""Removal of long repeated byte strings, decided on suffix arrays.

Every string of `length` bytes holds an anchor: its smallest hashed run of GRAM bytes.  Equal
strings have equal anchors, so only surroundings of anchors that occur more than once are
compared.  Equal surroundings are settled by their hashes; different ones around the same
anchor are put side by side in shards of bounded size, and each shard's suffix array and
common prefixes tell which strings occur twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C
from engram.llm.suffixes import common_prefixes, suffix_array

GRAM = 100
#: Bits of a gram's hash that rank it; the rest of a word holds its position.
RANK_BITS = 40
CHUNK = 1 << 22
#: Bytes of surroundings in one shard's suffix array.
SHARD_BYTES = 1_500_000
#: An anchor with more different surroundings than this (about 2 MB) is compared string by string.
SHARD_ANCHOR = 4096
#: Strings of one step of that comparison.
STEP = 12
#: Rows of a batch that such steps hand on.
ROWS = 20_000
#: Bytes of text whose anchors are looked for at a time.
ANCHOR_BYTES = 1 << 19
_OTHER_VALUES = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64)
#: Never part of UTF-8.
SEPARATOR = 0xFF


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, from prefix and suffix minima of blocks."""
    size = len(values)
    rows = -(-size // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:size] = values
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:size - width + 1], ahead[width - 1:size])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of a slice: row, position in the slice, gram hash, the begin of the first and the
    end of the last string of `length` bytes that this is the anchor of, and two hashes of
    the bytes between."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = C.prefix_sums(data)
    place = np.arange(len(data) - GRAM + 1)
    grams = C.span_hashes(sums, place, place + GRAM)
    shift = np.uint64(64 - RANK_BITS)
    ranked = (grams >> shift << shift) | place.astype(np.uint64)
    smallest = _smallest(ranked, length - GRAM + 1)
    first = offsets[:-1]
    inside = np.zeros(len(smallest) + 1, dtype=np.int64)
    long = np.diff(offsets) >= length
    np.add.at(inside, first[long], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(start):
        return anchors(data[:0], offsets[:1], length)
    chosen = (smallest[start] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    # Neighbouring strings share their anchor until it changes or a text ends.
    new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    at, begin = chosen[new], start[new]
    end = start[np.append(new[1:], len(start)) - 1] + length
    row = np.searchsorted(offsets, at, side="right") - 1
    tag = ((at - begin) * 4096 + (end - begin)).astype(np.uint64)
    other = C.prefix_sums(data, _OTHER_VALUES)
    return (row, at, grams[at], begin, end, C.mix(C.span_hashes(sums, begin, end) + tag),
            C.mix(C.span_hashes(other, begin, end) ^ C.mix(tag)))


def _pieces(column: pa.Array, length: int):
    """Slices of whole texts; a text over CHUNK comes in pieces with margins on both sides.

    Yields first row, bytes, offsets, bytes before this piece, and the part that it is for.
    """
    for row, data, offsets in C.slices(column, ANCHOR_BYTES):
        if len(offsets) > 2 or len(data) <= CHUNK:
            yield row, data, offsets, 0, None
            continue
        for begin in range(0, len(data), CHUNK):
            low, high = max(0, begin - 2 * length), min(len(data), begin + CHUNK + 2 * length)
            yield (row, data[low:high], np.array([0, high - low]), low,
                   (begin, min(begin + CHUNK, len(data))))


ANCHOR = "doc_id long, mark binary, h long, a long, b long, begin long, size int, left int"


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for first, data, offsets, before, part in _pieces(batch.column(2), length):
                row, at, h, begin, end, a, b = anchors(data, offsets, length)
                if part is not None:
                    mine = (at + before >= part[0]) & (at + before < part[1])
                    row, at, h, begin, end, a, b = (
                        x[mine] for x in (row, at, h, begin, end, a, b))
                which = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(which), marks.take(which), pa.array(h.view(np.int64)),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.array(begin - offsets[row] + before), pa.array((end - begin).astype(np.int32)),
                     pa.array((at - begin).astype(np.int32))],
                    names=["doc_id", "mark", "h", "a", "b", "begin", "size", "left"])

    return run


SPAN = "doc_id long, mark binary, begin long, size long"


def _shared_ends(order: list[tuple]) -> list[int]:
    """For sorted (group, bytes), the longest beginning that each shares with a neighbour of its group."""
    out = [0] * len(order)
    for i in range(1, len(order)):
        (g, a), (k, b) = order[i - 1], order[i]
        if g == k:
            size = min(len(a), len(b))
            if a[:size] != b[:size]:
                differ = (np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size))
                size = int(differ.argmax())
            out[i - 1] = max(out[i - 1], size)
            out[i] = max(out[i], size)
    return out


def trimmed(groups: list[int], texts: list[bytes], left: list[int], length: int):
    """What of each text can be in a string that another text of its group has: begin, end.

    No such string reaches further from the anchor than the longest part on that side that
    the text shares with any other; a text too short for a string then gets begin = end.
    """
    count = len(texts)
    reach = []
    for side in (0, 1):
        parts = [t[:p][::-1] if side == 0 else t[p:] for t, p in zip(texts, left, strict=True)]
        order = sorted(range(count), key=lambda i: (groups[i], parts[i]))  # noqa: B023
        found = _shared_ends([(groups[i], parts[i]) for i in order])
        shared = [0] * count
        for i, size in zip(order, found, strict=True):
            shared[i] = size
        reach.append(shared)
    begin = [p - a for p, a in zip(left, reach[0], strict=True)]
    end = [p + b for p, b in zip(left, reach[1], strict=True)]
    return [(b, e) if e - b >= length else (b, b) for b, e in zip(begin, end, strict=True)]


def repeated_spans(groups: list[int], texts: list[bytes], left: list[int], place: np.ndarray,
                   length: int):
    """Which strings of `length` bytes occur at two different places: row, first and last + 1 start.

    Texts of a group surround equal anchors, left[i] bytes into the text; place[i] numbers the
    text's first byte over all documents.  Equal remains of a group are sorted once.
    """
    cuts = trimmed(groups, texts, left, length)
    kinds: dict[tuple[int, bytes], list[int]] = {}
    for i, (begin, end) in enumerate(cuts):
        if begin < end:
            kinds.setdefault((groups[i], texts[i][begin:end]), []).append(i)
    if not kinds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [part for _, part in kinds]
    begin = np.array([b for b, _ in cuts])
    low = np.array([min(place[i] + begin[i] for i in rows) for rows in kinds.values()])
    high = np.array([max(place[i] + begin[i] for i in rows) for rows in kinds.values()])
    joined = np.frombuffer(bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR]), dtype=np.uint8)
    size = np.array([len(p) for p in parts])
    offsets = np.cumsum(size + 1) - size - 1
    array = suffix_array(joined)
    shared = common_prefixes(joined, array)
    part = np.searchsorted(offsets, array, side="right") - 1
    inner = array - offsets[part]
    whole = inner + length <= size[part]
    # Runs of suffixes that share `length` bytes; a run counts if two places are in it.
    run = np.cumsum(shared < length)
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    most = np.full(run[-1] + 1, -1)
    np.minimum.at(least, run[whole], (low[part] + inner)[whole])
    np.maximum.at(most, run[whole], (high[part] + inner)[whole])
    hit = np.zeros(len(joined) + 1, dtype=bool)
    hit[array[whole & (least[run] < most[run])]] = True
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
    opens, closes = edges[::2], edges[1::2]
    which = np.searchsorted(offsets, opens, side="right") - 1
    members = list(kinds.values())
    rows = np.array([i for k in which.tolist() for i in members[k]], dtype=np.int64)
    times = np.array([len(members[k]) for k in which.tolist()], dtype=np.int64)
    first = np.repeat(opens - offsets[which], times) + begin[rows]
    last = np.repeat(closes - offsets[which], times) + begin[rows]
    return rows, first, last


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        marks = table["mark"].combine_chunks().dictionary_encode().indices
        document = np.stack([np.asarray(table["doc_id"]), np.asarray(marks)])
        _, document = np.unique(document, axis=1, return_inverse=True)
        begin = np.asarray(table["begin"])
        row, first, last = repeated_spans(
            table["h"].to_pylist(), table["bytes"].to_pylist(), table["left"].to_pylist(),
            document.reshape(-1).astype(np.int64) << 40 | begin, length)
        which = pa.array(row)
        return pa.table({"doc_id": table["doc_id"].take(which).cast(pa.int64()),
                         "mark": table["mark"].take(which),
                         "begin": pa.array(begin[row] + first, pa.int64()),
                         "size": pa.array(last - first + length - 1, pa.int64())})

    return run


def _runs(left: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings whose start lies STEP bytes from each other at most, counted from the
    anchor backwards: number, first and last string of each."""
    number = (left - np.arange(count)) // STEP
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    return number[first], first, np.append(first[1:], count) - 1


def _cores(length: int):
    """Surroundings -> for each run of strings, hashes of the bytes that all of them hold
    (c, d) and of all bytes (a, b)."""
    names = ["doc_id", "mark", "h", "start", "left", "run", "c", "d", "a", "b", "first", "size"]

    def run(batches):
        for batch in batches:
            out = []
            for row in _rows(batch):
                data = np.frombuffer(row["bytes"], dtype=np.uint8)
                number, first, last = _runs(row["left"], len(data) - length + 1)
                begin = row["left"] - number * STEP
                end = np.maximum(begin, row["left"] - (number + 1) * STEP + 1 + length)
                sums = [C.prefix_sums(data, v) for v in (C._BYTE_VALUES, _OTHER_VALUES)]
                hashes = [C.span_hashes(x, b, e).view(np.int64).tolist()
                          for b, e in ((begin, end), (first, last + length)) for x in sums]
                out += [(row["doc_id"], row["mark"], row["h"], row["begin"], row["left"], *found)
                        for found in zip(number.tolist(), *hashes, first.tolist(),
                                         (last - first + length).tolist(), strict=True)]
                if len(out) >= ROWS:
                    yield _batch(out, names)
                    out = []
            yield _batch(out, names)

    return run


def _singles(length: int):
    """Surroundings and numbers of runs -> every string of those runs."""
    names = ["doc_id", "mark", "h", "begin", "size", "a", "b"]

    def run(batches):
        for batch in batches:
            out = []
            for row in _rows(batch):
                data = np.frombuffer(row["bytes"], dtype=np.uint8)
                number, first, last = _runs(row["left"], len(data) - length + 1)
                chosen = np.flatnonzero(np.isin(number, row["runs"]))
                at = np.concatenate([np.arange(first[i], last[i] + 1) for i in chosen])
                hashes = (C.span_hashes(C.prefix_sums(data, v), at, at + length)
                          .view(np.int64).tolist() for v in (C._BYTE_VALUES, _OTHER_VALUES))
                out += [(row["doc_id"], row["mark"], row["h"], begin, length, *found)
                        for begin, *found in zip((row["begin"] + at).tolist(), *hashes, strict=True)]
                if len(out) >= ROWS:
                    yield _batch(out, names)
                    out = []
            yield _batch(out, names)

    return run


def _rows(batch: pa.RecordBatch):
    for first in range(0, batch.num_rows, 256):
        yield from batch.slice(first, 256).to_pylist()


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    kinds = [pa.binary() if n == "mark" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at two places at least."""
    place = F.struct("doc_id", "mark", "begin")
    twice = C.staged(rows.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
                     .filter("lo <> hi").select(*keys), "equal-surroundings")
    return rows.join(twice, keys, "left_semi").select(
        "doc_id", "mark", "begin", F.col("size").cast("long").alias("size"))


def spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, mark, begin, size: byte runs made of strings of `length` bytes that occur elsewhere.

    docs: doc_id, mark (tells rows with the same id apart), text.
    """
    rows = C.staged(docs.filter(F.octet_length("text") >= length).mapInArrow(
        _anchor_rows(length), ANCHOR), "anchors")
    often = C.staged(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"),
                     "repeated-anchors")
    rows = C.staged(rows.join(often, "h", "left_semi"), "repeated-surroundings")
    equal = _settled(rows, ["h", "a", "b", "size"])

    # One place stands for all equal surroundings; anchors with one kind are settled.
    place = F.struct("doc_id", "mark", "begin")
    kinds = C.staged(rows.groupBy("h", "a", "b", "size").agg(
        F.min(place).alias("p"), F.first("left").alias("left")), "kinds")
    several = C.staged(kinds.groupBy("h").agg(F.count("*").alias("kinds"),
                                              F.sum("size").alias("bytes"))
                       .filter("kinds > 1"), "several")
    wanted = (kinds.join(several, "h").select("h", "kinds", "size", "left", "p.*"))
    body = docs.select(F.col("doc_id"), F.col("mark"), F.col("text").cast("binary").alias("_body"))
    found = C.staged(
        body.join(wanted, ["doc_id", "mark"])
        .select("doc_id", "mark", "h", "begin", "kinds", "left",
                F.substring("_body", (F.col("begin") + 1).cast("int"), F.col("size"))
                .alias("bytes")).dropDuplicates(["doc_id", "mark", "h", "begin", "left"]), "surroundings")
    few = found.filter(F.col("kinds") <= SHARD_ANCHOR)
    volume = few.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-volume // SHARD_BYTES))
    sorted_out = (few.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"),
                             "doc_id", "mark", "h", "begin", "left", "bytes")
                  .groupBy("shard").applyInArrow(_shard(length), SPAN))
    out = equal.unionByName(sorted_out)

    many = found.filter(F.col("kinds") > SHARD_ANCHOR)
    if not many.isEmpty():
        out = out.unionByName(_by_string(many, length))
    return out


def _by_string(many: DataFrame, length: int) -> DataFrame:
    """Anchors with very many surroundings: runs of STEP strings that share their core with
    another first; runs that are equal as a whole are settled, and of the different ones every
    single string is compared.  Only hashes are grouped."""
    cores = C.staged(many.select("doc_id", "mark", "h", "begin", "left", "bytes").mapInArrow(
        _cores(length), "doc_id long, mark binary, h long, start long, left long, run long, "
                        "c long, d long, a long, b long, first long, size long")
        .withColumn("begin", F.col("start") + F.col("first")), "cores")
    kind = F.struct("a", "b", "size")
    cored = ["h", "run", "c", "d"]
    twice = C.staged(cores.groupBy(*cored).agg(
        F.count("*").alias("n"), F.min(kind).alias("lo"), F.max(kind).alias("hi"))
        .filter("n > 1"), "equal-cores")
    settled = _settled(cores.join(twice.select(*cored), cored, "left_semi"),
                       ["h", "run", "a", "b", "size"])
    # One place stands for all equal runs.
    place = F.struct("doc_id", "mark", "start", "left")
    runs = (cores.join(twice.filter("lo <> hi").select(*cored), cored, "left_semi")
            .groupBy("h", "run", "a", "b", "size").agg(F.min(place).alias("p"))
            .select("h", "run", "p.*").withColumnRenamed("start", "begin")
            .groupBy("doc_id", "mark", "h", "begin", "left")
            .agg(F.collect_set("run").alias("runs")))
    strings = many.join(runs, ["doc_id", "mark", "h", "begin", "left"]).mapInArrow(
        _singles(length),
        "doc_id long, mark binary, h long, begin long, size long, a long, b long")
    return settled.unionByName(_settled(C.staged(strings, "strings"), ["h", "a", "b"]))


def _cut(batches):
    for batch in batches:
        out = []
        for doc, text, found in zip(*(batch.column(i) for i in range(3)), strict=True):
            raw, kept, at, removed, runs = text.as_py().encode(), [], 0, 0, 0
            last = -1
            for begin, end in sorted((s["begin"], s["begin"] + s["size"])
                                     for s in found.as_py() or ()):
                runs += begin > last
                if end > at:
                    kept.append(raw[at:max(at, begin)])
                    removed += end - max(at, begin)
                    at = end
                last = max(last, end)
            kept.append(raw[at:])
            out.append((doc.as_py(), b"".join(kept), len(raw), removed, runs))
        columns = zip(*out, strict=True) if out else ((),) * 5
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans of every row.

    A byte goes if a string of `length` bytes over it also starts at any other place, in the
    same text or another; matches stay within texts and are judged on the input.  Null texts
    are empty.  Rows that repeat id and text are one place; rows without an id are told apart
    by their text.  n_spans counts maximal removed runs.
    """
    none = -(1 << 63)
    source = C.texts(docs).select(F.coalesce("doc_id", F.lit(none)).alias("doc_id"),
                                  C.mark().alias("mark"), "text")
    found = spans(source, length).groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("begin", "size")).alias("spans"))
    return (source.join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_cut, "doc_id long, kept binary, n_bytes long, n_removed long, "
                              "n_spans long")
            .withColumn("doc_id", F.nullif("doc_id", F.lit(none))))
