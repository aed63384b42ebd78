"""Toxic passages by maximum-scoring segments over token log-odds.

Every word scores its log-odds between toxic and other labelled documents under a Dirichlet
prior, drawn towards nought by its standard error; a constant drift makes ordinary text score
below nought.  One linear scan finds all maximal-scoring segments of a text.  Their scores
follow an extreme-value law whose rate and constant come from the clean labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C

#: Bytes of a word's beginning that count as its stem.
STEM_BYTES = 5
#: Pseudo-documents of the prior, split like the sample.
PRIOR = 1.0
STANDARD_ERRORS = 2.0
#: Standard deviations (by the likelihood ratio) that a word's counts must lie off chance.
DEVIATIONS = 4.5
DRIFT = 0.05
SIGNIFICANT = 0.01
EULER = 0.5772156649

#: Everything in ASCII but letters and digits ends a word.
_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[0x80:] = False
for _range in (b"09", b"AZ", b"az"):
    _SEPARATORS[_range[0]:_range[1] + 1] = False


@dataclass
class Model:
    """words: sorted hashes of words and stems with a positive score; their scores; the law."""

    words: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    constant: float = 1.0
    slope: float = 0.0
    offset: float = -50.0

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def look_up(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        maybe = np.flatnonzero(self.seen[(words >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            found = words[maybe]
            place = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
            out[maybe] = np.where(self.words[place] == found, self.scores[place], 0)
        return out


def features(data: np.ndarray, offsets: np.ndarray):
    """Hash of every word and of its stem, its row, and its byte span."""
    starts, ends, rows = C.words(data, offsets, _SEPARATORS)
    sums = C.prefix_sums(C._LOWER[data])
    word = C.span_hashes(sums, starts, ends)
    stem = C.span_hashes(sums, starts, np.minimum(ends, starts + STEM_BYTES))
    return word, C.mix(stem ^ np.uint64(0x5E)), rows, starts, ends


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score), in time linear in the scores.

    Every open segment knows the nearest one before it whose left sum is smaller.  The search
    for a smaller left sum follows these links, so a segment that was passed over is looked at
    again only when it is merged away."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    left, right, begin, end, link = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, first, j = float(sums[i]), float(sums[i + 1]), i, len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                left.append(low)
                right.append(high)
                begin.append(first)
                end.append(i + 1)
                link.append(j)
                break
            low, first, before = left[j], begin[j], link[j]
            del left[j:], right[j:], begin[j:], end[j:], link[j:]
            j = before
    return [(b, e, r - x) for b, e, x, r in zip(begin, end, left, right, strict=True)]


def lexicon(words: np.ndarray, toxic: np.ndarray, clean: np.ndarray, toxic_size: int,
            clean_size: int) -> Model:
    """Scores of words from the numbers of toxic and clean documents that hold them.

    Log-odds under a Dirichlet prior of PRIOR documents split like the sample, less
    STANDARD_ERRORS of them; words that are left at or under nought, or whose counts are not
    DEVIATIONS from those expected by chance, are not kept.
    """
    share = toxic_size / max(toxic_size + clean_size, 1)
    if not 0 < share < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    a, b = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    score = (np.log(a / toxic_size) - np.log(b / clean_size)
             - STANDARD_ERRORS * np.sqrt(1 / a + 1 / b))
    # Words of one shared passage come together, so each must be beyond chance by itself.
    both = np.maximum(toxic + clean, 1)
    deviance = 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / (both * share))
                    + clean * np.log(np.maximum(clean, 1e-9) / (both * (1 - share))))
    kept = np.flatnonzero((score > 0) & (deviance > DEVIATIONS**2))
    kept = kept[np.argsort(words[kept])]
    return Model(words[kept], score[kept])


def _scored(data, offsets, model):
    """Word scores of a slice, where each row's begin, and their byte spans."""
    word, stem, rows, starts, ends = features(data, offsets)
    value = np.maximum(model.look_up(word), model.look_up(stem)) - DRIFT
    return value, np.searchsorted(rows, np.arange(len(offsets))), starts, ends


def _rate(above: np.ndarray, others: int, mean: float) -> float:
    """The positive root of mean(exp(rate * score)) = 1 over words of clean text.

    above: scores over nought; the `others` stand for themselves by their mean.
    """
    if not len(above):
        return 1.0
    low, high = 0.0, 1.0
    grow = lambda r: (np.exp(np.minimum(r * above, 50)).sum() + others * np.exp(r * mean)
                      - len(above) - others)
    while grow(high) < 0 and high < 64:
        high *= 2
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if grow(middle) > 0 else (middle, high)
    return max(high, 1e-3)


def evidence(best: np.ndarray, size: np.ndarray, rate: float, constant: float) -> np.ndarray:
    """Minus log of the chance that clean text of this many words has such a segment."""
    expected = constant * np.maximum(size, 1) * np.exp(-rate * best)
    chance = -np.expm1(-expected)
    return np.where(best > 0, -np.log(np.maximum(chance, 1e-30)), 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve, by Newton steps."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-2 * beta * [1, 0]
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-4])
        beta = beta + np.linalg.solve(hess, grad)
    return float(max(beta[0], 0.0)), float(beta[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """text, y, half of at most per_class labelled documents of either class, by id hash.

    `learn` is the condition on doc_id of rows whose labels may be used.  Contradicting or
    repeated labels of an id count once (the largest); equal texts count once.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col(label).cast("int").alias("y"))
             .filter(learn).filter("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")))
    mark = F.xxhash64("doc_id", F.lit("sample"))
    chosen = known.filter("y = 1").orderBy(mark).limit(per_class).unionByName(
        known.filter("y = 0").orderBy(mark).limit(per_class))
    return (C.texts(docs).join(F.broadcast(chosen), "doc_id")
            .groupBy("text").agg(F.max("y").alias("y"))
            .withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")))


def known_share(labels: DataFrame, label: str, condition) -> tuple[float, float]:
    """Shares of 0 and 1 among all labels that may be used."""
    found = {r[0]: r[1] for r in labels.filter(condition).groupBy(F.col(label).cast("int"))
             .count().collect()}
    total = max(found.get(0, 0) + found.get(1, 0), 1)
    return found.get(0, 0) / total, found.get(1, 0) / total


def learn(docs: DataFrame, labels: DataFrame, condition, per_class: int = 10_000) -> Model:
    """Fit on at most 2 * per_class labelled documents (the documented bound).

    Score tables of each half score the other one, and the curve from evidence to
    probability is fitted on those; the final table counts both.
    """
    spark = docs.sparkSession
    train = C.staged(training_rows(docs, labels, "toxic", condition, per_class), "toxic-train")

    def count(batches):
        for batch in batches:
            slot = np.asarray(batch.column(1)) + 2 * np.asarray(batch.column(2))
            for row, data, offsets in C.slices(batch.column(0)):
                word, stem, rows, _, _ = features(data, offsets)
                rows, found = np.concatenate((rows, rows)), np.concatenate((word, stem))
                order = np.lexsort((found, rows))
                rows, found = rows[order], found[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[new].view(np.int64)), pa.array(slot[row + rows[new]])],
                    names=["word", "slot"])

    slots = [F.count_if(F.col("slot") == k).alias(f"n{k}") for k in range(4)]
    # Only words of two toxic documents can score; the sample bounds their number.
    found = (train.mapInArrow(count, "word long, slot int").groupBy("word").agg(*slots)
             .filter("n1 + n3 > 1")).toArrow()
    words = np.asarray(found["word"]).view(np.uint64)
    counts = [np.asarray(found[f"n{k}"]) for k in range(4)]
    rows = train.groupBy("y", "half").count().collect()
    size = {k: sum(r["count"] for r in rows if r["y"] + 2 * r["half"] == k) for k in range(4)}
    if not size[0] + size[2] or not size[1] + size[3]:
        return Model(np.zeros(0, np.uint64), np.zeros(0),
                     offset=50.0 if size[1] + size[3] else -50.0)
    model = lexicon(words, counts[1] + counts[3], counts[0] + counts[2], size[1] + size[3],
                    size[0] + size[2])
    halves = [lexicon(words, counts[3 - 2 * h], counts[2 - 2 * h], size[3 - 2 * h],
                      size[2 - 2 * h]) for h in (0, 1)]
    shared = spark.sparkContext.broadcast(halves)

    def rate(batches):
        for batch in batches:
            y, half = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            out = []
            for row, data, offsets in C.slices(batch.column(0)):
                for h in (0, 1):
                    value, edges, _, _ = _scored(data, offsets, shared.value[h])
                    for i in np.flatnonzero(half[row:row + len(offsets) - 1] == h).tolist():
                        own = value[edges[i]:edges[i + 1]]
                        best = max((s for _, _, s in segments(own)), default=0.0)
                        sign = own[own > 0].tolist() if not y[row + i] else []
                        low = float(own[own <= 0].sum()) if not y[row + i] else 0.0
                        out.append((int(y[row + i]), len(own), best, sign, low))
            y, size, best, sign, low = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32()), pa.array(size, pa.int64()), pa.array(best, pa.float64()),
                 pa.array(sign, pa.list_(pa.float64())), pa.array(low, pa.float64())],
                names=["y", "size", "best", "above", "below"])

    seen = train.mapInArrow(rate, "y int, size long, best double, above array<double>, "
                                  "below double").toArrow()
    y, size, best = (np.asarray(seen[c]).astype(float) for c in ("y", "size", "best"))
    clean = y == 0
    above = seen["above"].combine_chunks().flatten().to_numpy()
    others = int(size[clean].sum()) - len(above)
    mean = float(np.asarray(seen["below"]).sum()) / max(others, 1)
    lam = _rate(above, others, mean)
    hit = clean & (best > 0)
    constant = (float(np.exp(np.mean(lam * best[hit] - np.log(np.maximum(size[hit], 1))) - EULER))
                if hit.any() else 0.01)
    # The sample is balanced, the documents are not: each class weighs what its labels do.
    share = known_share(labels, "toxic", condition)
    weight = np.where(clean, share[0] / clean.sum(), share[1] / (~clean).sum()) * len(y)
    slope, offset = _logistic(evidence(best, size, lam, constant), y, weight)
    return replace(model, rate=lam, constant=constant, slope=slope, offset=offset)


def scan(column: pa.Array, fit: Model):
    """(first row, rows, scores, passages) of consecutive rows of a text column."""
    for row, data, offsets in C.slices(column):
        value, edges, starts, ends = _scored(data, offsets, fit)
        count = len(offsets) - 1
        best, found = np.zeros(count), [[] for _ in range(count)]
        size = np.diff(edges)
        touched = np.unique(np.searchsorted(edges, np.flatnonzero(value > 0), "right") - 1)
        for i in touched.tolist():
            begin = edges[i]
            for first, last, score in segments(value[begin:edges[i + 1]]):
                best[i] = max(best[i], score)
                expect = fit.constant * size[i] * np.exp(-fit.rate * score)
                if expect <= SIGNIFICANT:
                    found[i].append({"first": int(starts[begin + first] - offsets[i]),
                                     "last": int(ends[begin + last - 1] - offsets[i]),
                                     "score": score, "expected": float(expect)})
        x = evidence(best, size, fit.rate, fit.constant)
        yield row, count, 1 / (1 + np.exp(-np.clip(fit.slope * x + fit.offset, -50, 50))), found


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), and the significant passages with byte spans, of every row.

    Whole texts are scanned.  Null or wordless texts have no passage and the score of no
    evidence.  Ids are carried along, whatever they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for row, count, score, found in scan(batch.column(1), shared.value):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, count), pa.array(score), pa.array(found, PASSAGE)],
                    names=["doc_id", "score", "passages"])

    return C.texts(docs).mapInArrow(
        run, "doc_id long, score double, "
             "passages array<struct<first: long, last: long, score: double, expected: double>>")


PASSAGE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()),
                              ("score", pa.float64()), ("expected", pa.float64())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, condition) -> DataFrame:
    """The rows of docs scored under one half, with the columns they came with.

    Scores are taken row by row and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, condition))
    column = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(column), "")
            score = np.concatenate([np.zeros(0)] + [
                s for _, _, s, _ in scan(texts, shared.value)])
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
