"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, each filter keeps its
maximum over the window, and a softmax layer reads the maxima.  The network is trained in
numpy on labelled windows and applied to all windows of every text, whose log-probabilities
are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
#: Windows that go through the network at a time.
BATCH = 64


@dataclass
class Network:
    """filters[w]: (w, 256, FILTERS), the response to each byte at each place of the filter."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    weights: np.ndarray
    bias: np.ndarray
    pairs: dict = field(default_factory=dict)

    def maxima(self, windows: np.ndarray):
        """Largest response of every filter over each window, and where it is."""
        best, place = [], []
        for width, table in self.filters.items():
            steps = WINDOW - width + 1
            out = table[0][windows[:, :steps]]
            for j in range(1, width):
                out += table[j][windows[:, j:steps + j]]
            where = out.argmax(axis=1)
            best.append(np.take_along_axis(out, where[:, None, :], axis=1)[:, 0])
            place.append(where)
        return np.concatenate(best, axis=1), np.concatenate(place, axis=1)

    def prepare(self) -> None:
        """Sum neighbouring places of the filters over byte pairs, for fewer lookups."""
        for width, table in self.filters.items():
            parts = []
            for j in range(0, width, 2):
                if j + 1 < width:
                    both = table[j][:, None, :] + table[j + 1][None, :, :]
                    parts.append((j, True, np.ascontiguousarray(both.reshape(-1, FILTERS))))
                else:
                    parts.append((j, False, table[j]))
            self.pairs[width] = parts

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        code = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        best = []
        for width, parts in self.pairs.items():
            steps = WINDOW - width + 1
            out = None
            for j, double, table in parts:
                found = table.take((code if double else windows)[:, j:j + steps], axis=0)
                out = found if out is None else np.add(out, found, out=out)
            best.append(out.max(axis=1))
        return _log_softmax(np.maximum(np.concatenate(best, axis=1), 0) @ self.weights + self.bias)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 8,
          seed: int = 5) -> Network:
    """Adam on the softmax loss; a maximum passes its gradient to the bytes it was reached on."""
    rng = np.random.default_rng(seed)
    params = {w: (rng.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
    size = FILTERS * len(WIDTHS)
    params["weights"] = (rng.standard_normal((size, len(languages))) * 0.2).astype(np.float32)
    params["bias"] = np.zeros(len(languages), dtype=np.float32)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    share = np.bincount(target, minlength=len(languages)) / max(len(target), 1)
    weight = 1 / np.maximum(share[target] * len(languages), 1e-9)
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.6 ** epoch
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            x, y = windows[rows], target[rows]
            net = Network(languages, {w: params[w] for w in WIDTHS}, params["weights"], params["bias"])
            best, place = net.maxima(x)
            active = np.maximum(best, 0)
            error = np.exp(_log_softmax(active @ params["weights"] + params["bias"]))
            error[np.arange(len(y)), y] -= 1
            error *= (weight[rows] / len(rows))[:, None]
            grads = {"weights": active.T @ error, "bias": error.sum(axis=0)}
            back = (error @ params["weights"].T) * (best > 0)
            for n, width in enumerate(WIDTHS):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                grad = np.zeros_like(params[width])
                for j in range(width):
                    hit = np.take_along_axis(x, place[:, cols] + j, axis=1)
                    np.add.at(grad[j], (hit, np.arange(FILTERS)[None, :]), back[:, cols])
                grads[width] = grad
            step += 1
            for k, grad in grads.items():
                grad = grad + 1e-5 * params[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] = (params[k] - rate * (first[k] / (1 - 0.9**step))
                             / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net = Network(languages, {w: params[w] for w in WIDTHS}, params["weights"], params["bias"])
    net.prepare()
    return net


def windows_of(data: np.ndarray, offsets: np.ndarray):
    """All fixed-length windows of a slice's rows (the last one padded with zeros), and their rows."""
    size = np.diff(offsets)
    number = -(-size // WINDOW)
    rows = np.repeat(np.arange(len(size)), number)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number)
    begin = offsets[:-1][rows] + nth * WINDOW
    length = np.minimum(offsets[1:][rows] - begin, WINDOW)
    padded = np.concatenate((data, np.zeros(WINDOW, dtype=np.uint8)))
    out = padded[begin[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
    return out, rows


def training_windows(docs: DataFrame, condition, per_language: int, per_text: int):
    """Windows and languages of at most per_language labelled documents of each language.

    `condition` on doc_id says whose lang may be used.  Distinct languages are counted first.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(
        condition).filter("lang is not null and length(text) > 0")
    sizes = known.groupBy("lang").count().toPandas()
    # An expected bound: each language's documents are thinned by the hash of their id.
    share = {r.lang: min(1.0, per_language / r["count"]) for _, r in sizes.iterrows()}
    if not share:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    languages = sorted(share)
    keep = F.create_map(*[F.lit(v) for k in languages for v in (k, float(share[k]))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20))
                          < keep[F.col("lang")] * (1 << 20)).select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            lang = batch.column(1).to_pylist()
            out = []
            for row, data, offsets in C.slices(batch.column(2)):
                found, rows = windows_of(data, offsets)
                edges = np.searchsorted(rows, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    have = edges[i + 1] - edges[i]
                    pick = np.unique(np.linspace(0, have - 1, min(per_text, have)).astype(int))
                    out += [(lang[row + i], found[edges[i] + k].tobytes()) for k in pick.tolist()]
            names, raw = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()),
                                              pa.array(raw, pa.binary())], names=["lang", "x"])

    found = chosen.mapInArrow(run, "lang string, x binary").orderBy("lang", "x").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    number = {k: i for i, k in enumerate(languages)}
    return x, np.array([number[k] for k in found["lang"].to_pylist()], dtype=np.int64), languages


def learn(docs: DataFrame, condition, per_language: int = 1_000, per_text: int = 3) -> Network | None:
    """Fit on about per_language documents of each language, per_text windows of each."""
    x, y, languages = training_windows(docs, condition, per_language, per_text)
    if not languages or not len(x):
        return None
    return train(x, y, languages)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row; whole texts.

    Null texts, texts without a letter, and all texts when nothing could be learned are
    "und" with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for batch in batches:
            column = batch.column(1)
            letters = np.array([any(map(str.isalpha, t)) for t in column.to_pylist()], dtype=bool)
            for row, data, offsets in C.slices(column, 1 << 18):
                count = len(offsets) - 1
                labels, score = [UNKNOWN] * count, np.zeros(count)
                if net is not None:
                    x, rows = windows_of(data, offsets)
                    total = np.zeros((count, len(net.languages)))
                    for at in range(0, len(x), BATCH):
                        np.add.at(total, rows[at:at + BATCH],
                                  net.log_probabilities(x[at:at + BATCH]))
                    total /= np.maximum(np.bincount(rows, minlength=count), 1)[:, None]
                    chance = np.exp(_log_softmax(total))
                    best = chance.argmax(axis=1)
                    for i in np.flatnonzero(letters[row:row + count]).tolist():
                        labels[i], score[i] = net.languages[best[i]], chance[i, best[i]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, count), pa.array(labels, pa.string()),
                     pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return C.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
