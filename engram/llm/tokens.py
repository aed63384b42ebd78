"""Token-id output as patched frame-of-reference blocks.

A segment holds the ids of whole documents in blocks of 512.  Of every block the minimum is
subtracted, the rest is packed at the bit width that covers a chosen share (percentile) of
its ids, and ids that need more bits stand in an exception list.  The segment opens with an
index of block starts.  Segments are rows of a Parquet table, so that they can be written to
and read from whatever store Spark reaches; documents are in ascending doc_id order.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm import common as C

BLOCK = 512
LANES = BLOCK // 64
MAGIC = 0x31424650
#: A segment is closed at so many ids; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 20
#: Remembered words: number and length.
CACHE_WORDS = 800_000
CACHE_LENGTH = 48
END_ID = 0
#: Marks that are cut off a word's end; none is a letter, a digit or white space.
TAILS = ".,;:!?*$%&#\"()"
_UNSAFE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """tokenizers' ids of whole texts, each distinct word encoded once while remembered.

    The byte-level pre-tokenizer always starts a new piece at a space that stands before a
    character other than white space, and ends a piece after a run of letters; a text may be
    cut at both.  So a text becomes its first word, and words with a space before them.
    Words of letters only are encoded together by the same BPE model, other words by the
    full tokenizer; trailing punctuation is a word of its own.  A text that holds an added
    token is encoded whole, and so is every text if the cuts do not hold for the vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.cache: dict[str, bytes] = {}
        alphabet = dict(enumerate(_byte_letters()))
        self.letters = alphabet
        self.tails: dict[tuple[str, bool], bytes] = {}
        self.joint = None
        vocabulary = self.tokenizer.get_vocab()
        space, line = alphabet[0x20], alphabet[0x0A]
        if (space in vocabulary and line in vocabulary
                and self._plain("a b") == self._plain("a") + self._plain(" b")
                and self._plain("ab,.\nc") == self._plain("ab") + self._plain(",.\n")
                + self._plain("c")):
            self.joint = Tokenizer(self.tokenizer.model)
            self.joint.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.line = vocabulary[line]
            self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.opens[[i for w, i in vocabulary.items() if w.startswith(space)]] = True

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._plain(text), dtype="<u4").tobytes()

    def _learn(self, words: list[str], known: dict[str, bytes], before: str = " ") -> None:
        """Ids of words of letters behind a space, or behind a line break (kept as "\\n" + word)."""
        space, line = self.letters[0x20], self.letters[0x0A]
        for first in range(0, len(words), 2048):
            part = words[first:first + 2048]
            if before == " ":
                text = (" " + "  ".join(part)).encode().decode("latin-1").translate(self.letters)
                text = text.replace(space + space, " " + space)
            else:
                text = ("\n" + "\n".join(part)).encode().decode("latin-1").translate(self.letters)
                text = text.replace(line, f" {line} ").strip()
            found = self.joint.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype="<u4")
            if before == " ":
                begins = np.flatnonzero(self.opens[ids])
                ends = np.append(begins[1:], len(ids))
            else:
                begins = np.flatnonzero(ids == self.line) + 1
                ends = np.append(begins[1:] - 1, len(ids))
            raw, lead = ids.tobytes(), "" if before == " " else before
            for word, begin, end in zip(part, (4 * begins).tolist(), (4 * ends).tolist(),
                                        strict=True):
                known[lead + word] = raw[begin:end]

    def _tail(self, tail: str, more: bool) -> bytes:
        """Ids of marks and a line break after a word; more: a letter follows."""
        if (tail, more) not in self.tails:
            ids = self._whole(tail + "a")[:-len(self._whole("a"))] if more else self._whole(tail)
            self.tails[tail, more] = ids
        return self.tails[tail, more]

    def _add(self, fresh: set[str], known: dict[str, bytes], before: str = " ") -> None:
        """Ids of pieces: words with marks behind them, and words joined by line breaks."""
        lead = "" if before == " " else before
        own = set(filter(str.isalpha, fresh))
        marked, joined, lined = [], [], set()
        for piece in fresh - own:
            core = piece.rstrip(TAILS)
            if core.isalpha():
                marked.append((piece, core))
                continue
            parts = [(p.rstrip(TAILS), p) for p in piece.split("\n")]
            if len(parts) > 1 and all(c.isalpha() for c, _ in parts):
                joined.append((piece, parts))
                own.add(parts[0][0])
                lined.update(c for c, _ in parts[1:])
            else:
                known[lead + piece] = self._whole(before.strip("\n") + piece)
        own.update(core for _, core in marked)
        self._learn([w for w in own if lead + w not in known], known, before)
        self._learn([w for w in lined if "\n" + w not in known], known, "\n")
        for piece, core in marked:
            known[lead + piece] = known[lead + core] + self._tail(piece[len(core):], False)
        for piece, parts in joined:
            ids, last, front = b"", len(parts) - 1, lead
            for i, (core, part) in enumerate(parts):
                ids += known[front + core]
                front, tail = "\n", part[len(core):] + "\n" * (i < last)
                if tail:
                    ids += self._tail(tail, i < last)
            known[lead + piece] = ids

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, the end id included."""
        end = np.array([END_ID], dtype="<u4").tobytes()
        if self.joint is None:
            return [self._whole(t) + end for t in batch]
        special = {i: self._whole(t) + end for i, t in enumerate(batch) if self.added.search(t)}
        if special:
            rest = iter(self.encode([t for i, t in enumerate(batch) if i not in special]))
            return [special[i] if i in special else next(rest) for i in range(len(batch))]
        out, step = [], 256
        for first in range(0, len(batch), step):
            cut = [_pieces(t) for t in batch[first:first + step]]
            fresh, heads = set(), set()
            for pieces in cut:
                heads.add(pieces[0])
                fresh.update(pieces[1:])
            known = self.cache
            fresh = fresh.difference(known)
            heads = {h for h in heads if "\n" + h not in known}
            if len(known) + 2 * (len(fresh) + len(heads)) > CACHE_WORDS:
                keep = set().union(*(p[1:] for p in cut))
                known = self.cache = {k: v for k, v in known.items() if k in keep}
                heads.update(p[0] for p in cut)
            if any(len(p) > CACHE_LENGTH for p in fresh | heads):
                known = dict(known)
                short = {p for p in fresh if len(p) <= CACHE_LENGTH}
                self._add(short, self.cache)
                known.update(self.cache)
                fresh = fresh - short
            self._add(fresh, known)
            self._add(heads, known, "\n")
            get = known.__getitem__
            for pieces in cut:
                out.append(known["\n" + pieces[0]] + b"".join(map(get, pieces[1:])) + end)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that later tasks know the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _pieces(text: str) -> list[str]:
    """The text cut at spaces before other than white space; each but the first lost one."""
    pieces = text.split(" ")
    if _UNSAFE.search(text) is None:
        return pieces
    out = [pieces[0]]
    for piece in pieces[1:]:
        if not piece or piece[0].isspace():
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def pack(ids: np.ndarray, percentile: float = 0.98) -> bytes:
    """One segment: header, index of block starts, blocks."""
    count = len(ids)
    blocks = -(-count // BLOCK)
    full = np.zeros(blocks * BLOCK, dtype=np.uint64)
    full[:count] = ids
    if count:
        full[count:] = full[count - 1]
    full = full.reshape(blocks, BLOCK)
    base = full.min(axis=1, initial=2**32 - 1) if blocks else np.zeros(0, np.uint64)
    rest = full - base[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    covered = np.partition(rest, rank, axis=1)[:, rank] if blocks else base
    width = np.ceil(np.log2(covered.astype(np.float64) + 1)).astype(np.int64)
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    over = rest >= limit
    extra = over.sum(axis=1)
    low = np.where(over, 0, rest)
    size = 8 + width * 8 * LANES + extra * 6
    start = 16 + 8 * blocks + np.concatenate(([0], np.cumsum(size)))[:-1] if blocks else size
    out = np.zeros(int(16 + 8 * blocks + size.sum()), dtype=np.uint8)
    out[:16] = np.array([MAGIC, blocks, count & 0xFFFFFFFF, count >> 32], dtype="<u4").view(np.uint8)
    out[16:16 + 8 * blocks] = start.astype("<u8").view(np.uint8)
    if not blocks:
        return out.tobytes()
    head = np.zeros((blocks, 8), dtype=np.uint8)
    head[:, :4] = base.astype("<u4")[:, None].view(np.uint8).reshape(blocks, 4)
    head[:, 4] = width
    head[:, 6:8] = extra.astype("<u2")[:, None].view(np.uint8).reshape(blocks, 2)
    out[start[:, None] + np.arange(8)] = head
    for bits in np.unique(width).tolist():
        if not bits:
            continue
        chosen = np.flatnonzero(width == bits)
        values = low[chosen].reshape(-1, 64, LANES)
        cells = np.zeros((len(chosen), bits, LANES), dtype=np.uint64)
        for i in range(64):
            cell, shift = divmod(i * bits, 64)
            cells[:, cell] |= values[:, i] << np.uint64(shift)
            if shift + bits > 64:
                cells[:, cell + 1] |= values[:, i] >> np.uint64(64 - shift)
        raw = cells.astype("<u8").reshape(len(chosen), -1).view(np.uint8)
        out[(start[chosen] + 8)[:, None] + np.arange(raw.shape[1])] = raw
    which, place = np.nonzero(over)
    if len(which):
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        lists = start[which] + 8 + width[which] * 8 * LANES
        out[(lists + 2 * nth)[:, None] + np.arange(2)] = (
            place.astype("<u2")[:, None].view(np.uint8).reshape(-1, 2))
        out[(lists + 2 * extra[which] + 4 * nth)[:, None] + np.arange(4)] = (
            rest[over].astype("<u4")[:, None].view(np.uint8).reshape(-1, 4))
    return out.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    magic, blocks, low, high = raw[:16].view("<u4").tolist()
    if magic != MAGIC:
        raise ValueError("not a token segment")
    count = low | high << 32
    start = raw[16:16 + 8 * blocks].view("<u8").astype(np.int64)
    if not blocks:
        return np.zeros(0, dtype=np.uint32)
    head = raw[start[:, None] + np.arange(8)]
    base = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4].astype(np.int64)
    extra = np.ascontiguousarray(head[:, 6:8]).view("<u2")[:, 0].astype(np.int64)
    rest = np.zeros((blocks, BLOCK), dtype=np.uint64)
    for bits in np.unique(width).tolist():
        if not bits:
            continue
        chosen = np.flatnonzero(width == bits)
        cells = raw[(start[chosen] + 8)[:, None] + np.arange(bits * 8 * LANES)].view("<u8")
        cells = cells.reshape(len(chosen), bits, LANES)
        values = np.empty((len(chosen), 64, LANES), dtype=np.uint64)
        mask = np.uint64((1 << bits) - 1)
        for i in range(64):
            cell, shift = divmod(i * bits, 64)
            value = cells[:, cell] >> np.uint64(shift)
            if shift + bits > 64:
                value = value | cells[:, cell + 1] << np.uint64(64 - shift)
            values[:, i] = value & mask
        rest[chosen] = values.reshape(len(chosen), BLOCK)
    if extra.any():
        which = np.repeat(np.arange(blocks), extra)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra)
        lists = start[which] + 8 + width[which] * 8 * LANES
        place = raw[(lists + 2 * nth)[:, None] + np.arange(2)].view("<u2")[:, 0]
        rest[which, place] = raw[(lists + 2 * extra[which] + 4 * nth)[:, None]
                                 + np.arange(4)].view("<u4")[:, 0]
    return (rest + base[:, None]).astype("<u4").reshape(-1)[:count]


def write_blocks(docs: DataFrame, tokenizer: str, folder: str, percentile: float = 0.98) -> None:
    """Encode whole texts and write the segment table in ascending doc_id order.

    Null text: the end id alone.  Null ids come first; rows that share an id are ordered by a
    hash of the text.  An empty table writes an empty segment table.
    """

    def segments(batches):
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, lengths, keys, held, before = [], [], [], 0, 0

        def row():
            payload = pack(np.frombuffer(b"".join(ids), dtype="<u4"), percentile)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([before], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "before", "doc_ids", "lengths", "payload"])

        for batch in batches:
            column, key = batch.column(batch.schema.get_field_index("text")), batch.column(
                batch.schema.get_field_index("doc_id"))
            for first in range(0, len(column), 512):
                encoded = words.encode(column.slice(first, 512).to_pylist())
                for doc, raw in zip(key.slice(first, 512).to_pylist(), encoded, strict=True):
                    size = len(raw) // 4
                    if held and held + size > SEGMENT_IDS:
                        yield row()
                        before += held
                        ids, lengths, keys, held = [], [], [], 0
                    ids.append(raw)
                    lengths.append(size)
                    keys.append(doc)
                    held += size
        if held:
            yield row()

    order = ["doc_id", F.xxhash64("text")]
    (C.texts(docs).repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(segments, "part int, before long, doc_ids array<long>, lengths array<long>, "
                           "payload binary")
     .write.parquet(folder))


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the written segments: doc_id, start, n_tokens, ids_crc32, segment bytes.

    Totals of parts (one row per written partition) are summed in order; the segments carry
    their own place within the part.
    """
    rows = spark.read.parquet(folder)
    totals = rows.groupBy("part").agg(
        F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"),
                                            lambda a, x: a + x)).alias("size"))
    begins = totals.select("part", F.coalesce(F.sum("size").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("begin"))

    def documents(batches):
        for batch in batches:
            for item in batch.to_pylist():
                raw, at, place = unpack(item["payload"]).tobytes(), 0, item["begin"] + item["before"]
                starts, sums = [], []
                for size in item["lengths"]:
                    starts.append(place + at)
                    sums.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                    at += size
                yield pa.RecordBatch.from_arrays([
                    pa.array(item["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(item["lengths"], pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.join(F.broadcast(begins), "part").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
