"""Ranked lexical search with a frequent-pattern tree of documents.

Documents are cut down to the terms that items ask for, each vector ordered from frequent to
rare terms, so that vectors with one beginning share a path of a trie.  Every subtree knows
the largest frequency of each term and the smallest length factor below it, which bound the
score of all its documents; per item the tree is searched depth first, best bound first, and
subtrees that cannot reach the ten best are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import common as C

#: Bytes that end a term: ASCII other than digits and letters.
_NO_TERM = np.zeros(256, dtype=bool)
_NO_TERM[:128] = [not chr(b).isalnum() for b in range(128)]
#: Pairs of item and term that a pass over the documents serves; more items take more passes.
BLOCK_PAIRS = 1 << 18
#: A tree holds so many documents and entries at most (one longer document alone, otherwise).
TREE_DOCS, TREE_ENTRIES = 1 << 13, 1 << 21
#: Subtrees of up to so many documents are scored document by document.
BUCKET = 32
#: Cells (subtrees x terms) of the largest frequencies; larger buckets keep within them.
BOUND_CELLS = 1 << 22
LAST = np.iinfo(np.int64).max
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"


@dataclass
class Items:
    """A block of items: item k asks for terms (numbers) pairs[k] with frequencies counts[k]."""

    ids: list
    hashes: np.ndarray
    pairs: list[np.ndarray]
    counts: list[np.ndarray]


def item_blocks(items: DataFrame, limit: int = BLOCK_PAIRS):
    """Blocks of distinct (item_id, text) rows; one block at a time is on the driver."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()

    def made(held):
        every = np.unique(np.concatenate([h for _, h, _ in held]))
        return Items([i for i, _, _ in held], every,
                     [np.searchsorted(every, h) for _, h, _ in held], [c for _, _, c in held])
    held, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer(row.text.encode(), dtype=np.uint8)
        found, _ = C.word_hashes(data, np.array([0, len(data)]), _NO_TERM)
        terms, count = np.unique(found, return_counts=True)
        if not len(terms):
            continue
        if held and size + len(terms) > limit:
            yield made(held)
            held, size = [], 0
        held.append((row.item_id, terms, count))
        size += len(terms)
    if held:
        yield made(held)


def vectors(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), and numbers and frequencies of the terms in hashes,
    for documents with a term.  Terms are told by 64-bit hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches):
        asked = shared.value
        for batch in batches:
            for row, data, offsets in C.slices(batch.column(1)):
                found, rows = C.word_hashes(data, offsets, _NO_TERM)
                n = np.bincount(rows, minlength=len(offsets) - 1)
                at = np.minimum(np.searchsorted(asked, found), len(asked) - 1)
                hit = asked[at] == found
                pair, count = np.unique(rows[hit] * len(asked) + at[hit], return_counts=True)
                edges = np.searchsorted(pair, np.arange(len(offsets)) * len(asked))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(n)), pa.array(n),
                     pa.ListArray.from_arrays(edges.astype(np.int32),
                                              (pair % len(asked)).astype(np.int32)),
                     pa.ListArray.from_arrays(edges.astype(np.int32), count.astype(np.int32))],
                    names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return C.texts(docs).mapInArrow(run, VECTORS)


class Tree:
    """The trie over one block of documents.

    ids, nameless, m: by document; edges: where each document's entries begin; terms: numbers
    by falling document frequency; tf: frequencies.
    """

    def __init__(self, ids, nameless, m, edges, terms, tf, size: int):
        doc = np.repeat(np.arange(len(ids)), np.diff(edges))
        entry = np.argsort(doc * size + terms, kind="stable")
        terms, tf = terms[entry], tf[entry]
        paths = [p.tobytes() for p in np.split(terms.astype(">u4"), edges[1:-1])]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), dtype=np.int64)
        length = np.diff(edges)[order]
        self.edges = np.concatenate(([0], np.cumsum(length)))
        take = np.repeat(edges[:-1][order] - self.edges[:-1], length) + np.arange(len(terms))
        self.terms, self.tf = terms[take], tf[take]
        self.ids, self.nameless, self.m = ids[order], nameless[order], m[order]
        self.size = size
        self._shape(self._shared())
        self._bounds()

    def _shared(self) -> np.ndarray:
        """Length of the path that each document shares with the one before it."""
        shared = np.zeros(len(self.ids), dtype=np.int64)
        for i in range(1, len(self.ids)):
            a = self.terms[self.edges[i - 1]:self.edges[i]]
            b = self.terms[self.edges[i]:self.edges[i + 1]]
            k = min(len(a), len(b))
            other = np.flatnonzero(a[:k] != b[:k])
            shared[i] = other[0] if len(other) else k
        return shared

    def _shape(self, shared: np.ndarray) -> None:
        """Nodes as document ranges: a node branches where the shared path is shortest.

        Neighbouring small branches make one bucket; `inside` lists the children of a node.
        """
        most = max(BUCKET, -(-2 * len(self.ids) * self.size // BOUND_CELLS))
        self.low, self.high, self.inside = [0], [len(self.ids)], [[]]
        open_nodes = [0] if len(self.ids) > most else []
        while open_nodes:
            node = open_nodes.pop()
            low, high = self.low[node], self.high[node]
            inner = shared[low + 1:high]
            cuts = np.flatnonzero(inner == inner.min()) + low + 1
            bounds = [low, *cuts.tolist(), high]
            begin = low
            for i in range(1, len(bounds)):
                last = i == len(bounds) - 1
                # Close a child when it is large, or when the next branch would not fit.
                if last or bounds[i + 1] - begin > most:
                    child = len(self.low)
                    self.low.append(begin)
                    self.high.append(bounds[i])
                    self.inside.append([])
                    self.inside[node].append(child)
                    if bounds[i] - begin > most:
                        open_nodes.append(child)
                    begin = bounds[i]

    def _bounds(self) -> None:
        """Per node: largest frequency of each term, smallest m, smallest id."""
        count = len(self.low)
        self.tops = np.zeros((count, self.size), dtype=np.int32)
        self.least = np.full(count, LAST)
        self.first = np.full(count, LAST)
        for node in range(count - 1, -1, -1):
            for child in self.inside[node]:
                np.maximum(self.tops[node], self.tops[child], out=self.tops[node])
            if self.inside[node]:
                self.least[node] = self.least[self.inside[node]].min()
                self.first[node] = self.first[self.inside[node]].min()
            else:
                low, high = self.low[node], self.high[node]
                span = slice(self.edges[low], self.edges[high])
                np.maximum.at(self.tops[node], self.terms[span], self.tf[span])
                self.least[node] = self.m[low:high].min()
                self.first[node] = self.ids[low:high].min()

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the documents of the tree that belong to the best of an item."""
        top = self.tops[:, terms].astype(np.int64)
        bound = ((1_000_000_000 * top) // np.maximum(1000 * top + 8 * self.least[:, None], 1)
                 ) @ weights
        weight = np.zeros(self.size, dtype=np.int64)
        weight[terms] = weights
        waiting = [0]
        while waiting:
            node = waiting.pop()
            if not best.admits(bound[node], self.first[node]):
                continue
            inside = self.inside[node]
            if inside:
                # The last is looked at first.
                waiting += sorted(inside, key=lambda c: (bound[c], -self.first[c]))
                continue
            low, high = self.low[node], self.high[node]
            span = slice(self.edges[low], self.edges[high])
            part = weight[self.terms[span]]
            hit = np.flatnonzero(part)
            tf = self.tf[span][hit].astype(np.int64)
            doc = np.searchsorted(self.edges[low:high + 1] - self.edges[low], hit, "right") - 1
            value = part[hit] * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.m[low + doc]))
            total = np.concatenate(([0], np.cumsum(value)))
            ends = np.searchsorted(doc, np.arange(high - low + 1))
            best.add(total[ends[1:]] - total[ends[:-1]], self.ids[low:high],
                     self.nameless[low:high])


class Best:
    """The highest scores of one item so far; equal scores by ascending id, none last."""

    def __init__(self, limit: int):
        self.limit = limit
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.nameless = np.zeros(0, bool)

    def admits(self, score: int, first_id: int) -> bool:
        """Whether a document with at most that score and at least that id can belong."""
        if score <= 0 or len(self.score) < self.limit:
            return score > 0
        return score > self.score[-1] or (score == self.score[-1] and first_id < self.ids[-1])

    def add(self, score, ids, nameless) -> None:
        floor = self.score[-1] if len(self.score) == self.limit else 1
        keep = score >= floor
        if not keep.any():
            return
        score, ids, nameless = (np.concatenate(x) for x in (
            (self.score, score[keep]), (self.ids, ids[keep]), (self.nameless, nameless[keep])))
        order = np.lexsort((ids, -score))[:self.limit]
        self.score, self.ids, self.nameless = score[order], ids[order], nameless[order]


def _blocks(batches):
    """Documents of some batches at a time: ids, nameless, n, edges, terms, tfs."""
    for batch in batches:
        names = batch.column(0)
        ids = np.where(names.is_null().to_numpy(zero_copy_only=False), LAST,
                       names.fill_null(0).to_numpy())
        nameless = names.is_null().to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy()
        edges = batch.column(2).offsets.to_numpy().astype(np.int64)
        terms, tfs = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
        at = 0
        while at < len(ids):
            stop = int(np.searchsorted(edges, edges[at] + TREE_ENTRIES, "right")) - 1
            stop = min(max(stop, at + 1), at + TREE_DOCS, len(ids))
            span = slice(edges[at], edges[stop])
            yield (ids[at:stop], nameless[at:stop], n[at:stop], edges[at:stop + 1] - edges[at],
                   terms[span], tfs[span])
            at = stop


def search(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `limit` best documents with a score above 0.

    The score is the integer one of the query's contract (see README).  Null texts have no
    terms; items without terms, or whose terms no document holds, have no rows.  Rows of items
    that are equal count once, rows that share an id only are ranked each for itself.
    Documents that share an id are ranked each for itself; one without an id comes after
    others of its score.  Statistics cover all documents; empty tables give no rows.
    """
    kind = items.schema["item_id"].dataType
    parts = [_search(docs, block, kind, limit) for block in item_blocks(items)]
    if not parts:
        schema = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search(docs: DataFrame, block: Items, kind, limit: int) -> DataFrame:
    spark = docs.sparkSession
    held = C.staged(vectors(docs, block.hashes), "term-vectors")
    size = len(block.hashes)
    number, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = held.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df = np.zeros(size, dtype=np.int64)  # of the block's terms
    df[counted["t"].to_numpy()] = counted["count"].to_numpy()
    rank = np.empty(size, dtype=np.int64)
    rank[np.lexsort((np.arange(size), -df))] = np.arange(size)
    weight = np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * d + 1)))
                       for d in df.tolist()], dtype=np.int64)
    asked = [(rank[p], weight[p] * c) for p, c in zip(block.pairs, block.counts, strict=True)]
    shared = spark.sparkContext.broadcast((rank, asked, block.ids))

    def run(batches):
        rank, asked, ids = shared.value
        best = [Best(limit) for _ in asked]
        for who, nameless, n, edges, terms, tfs in _blocks(batches):
            m = 25 + (75 * n * number) // length
            tree = Tree(who, nameless, m, edges, rank[terms], tfs, size)
            for (numbers, weights), b in zip(asked, best, strict=True):
                tree.search(numbers, weights, b)
        have = [len(b.score) for b in best]
        at = np.repeat(np.arange(len(best)), have)
        if not len(at):
            return
        score, doc, nameless = (np.concatenate([getattr(b, k) for b in best])
                                for k in ("score", "ids", "nameless"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array([ids[k] for k in at.tolist()]),
             pa.array(doc, mask=nameless), pa.array(score)],
            names=["k", "item_id", "doc_id", "score"])

    schema = f"k long, item_id {kind.simpleString()}, doc_id long, score long"
    found = held.select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)
    order = Window.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select("item_id", "rank", "doc_id", "score"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, len(w)::BIGINT AS n, w FROM words WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf
       FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*)::BIGINT AS c FROM q GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(c * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank,
       doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""
