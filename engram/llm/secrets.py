"""Secret scans: patterns, and a character convolutional network over every candidate.

A candidate is a run of characters that keys are made of.  The network reads it together with
the characters around it and says for each kind of labelled finding how alike it is.  It is
trained on what the patterns found in all documents, by trainers that each have a share of the
windows; the scores are calibrated on candidates kept aside.  A kind's threshold finds at least
the asked share of those: it is the highest one that does, to 1 / LEVELS of a logit, or, where
all others score lower, the middle between.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C

# Patterns and least lengths of the labelled findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 12
# A run of 14 after the four letters makes 18; shorter runs are dropped anyway.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")

KINDS = ("assign", "access", "hex")
#: Kind of what the network adds.
ADDED = "network"
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{12,}")
#: Characters before, of, and after the candidate; longer ones are read in steps of STEP.
LEFT, BODY, RIGHT, STEP = 32, 48, 16, 32
WINDOW = LEFT + BODY + RIGHT
#: ASCII as it is, the rest of Unicode in 64 classes; inside the candidate all of it again.
SYMBOLS = 192
WIDTHS = (3, 5)
EMBED, FILTERS, HIDDEN = 8, 16, 24
BATCH = 64
#: How often training goes over the windows, the steps it should make, and makes at least.
EPOCHS, STEPS, FEW = 8, 1600, 400
#: Windows that a trainer has at least, where there are several; how many there are at most.
LOAD, TRAINERS = STEPS * BATCH, 256
#: Turns after which trainers meet, and the mark of windows kept aside.
TURNS, ASIDE = 8, -1
#: Logits are summed up in steps of 1 / LEVELS.
LEVELS = 64
FOUND = "array<struct<kind: string, start: long, end: long, score: double>>"


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled findings, sorted; code points, end exclusive.

    Leftmost matches that do not overlap, per kind; those too short are dropped after that."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
             if m.end() - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def pieces(text: str, start: int, end: int) -> list[str]:
    """The windows of a candidate, each of WINDOW characters; all of it, however long."""
    out = []
    for at in range(start, max(end - BODY + STEP, start + 1), STEP):
        stop = min(at + BODY, end)
        out.append(text[max(0, at - LEFT):at].rjust(LEFT, "\0")
                   + text[at:stop].ljust(BODY, "\0") + text[stop:stop + RIGHT].ljust(RIGHT, "\0"))
    return out


def symbols(windows: list[str]) -> np.ndarray:
    raw = "".join(windows).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, dtype="<u4").reshape(-1, WINDOW).astype(np.int64)
    out = np.where(code < 128, code, 128 + (code & 63))
    body = out[:, LEFT:LEFT + BODY]
    body[body > 0] += SYMBOLS
    return out


@dataclass
class Network:
    params: dict[str, np.ndarray]
    #: Per kind: slope and intercept of the calibration, and the threshold (over 1: never).
    slope: np.ndarray
    intercept: np.ndarray
    threshold: np.ndarray

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of every kind, (windows, kinds)."""
        out = [forward(self.params, x[at:at + BATCH])[0] for at in range(0, len(x), BATCH)]
        return _sigmoid(np.concatenate(out) * self.slope + self.intercept)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict, x: np.ndarray):
    """Logits of every kind, and what the gradient needs."""
    letters = p["embed"][x]
    pooled, places = [], []
    for width in WIDTHS:
        steps = WINDOW - width + 1
        grams = np.concatenate([letters[:, j:j + steps] for j in range(width)], axis=2)
        out = grams.reshape(-1, width * EMBED) @ p[f"filter{width}"]
        out = out.reshape(len(x), steps, FILTERS)
        place = out.argmax(axis=1)
        pooled.append(np.take_along_axis(out, place[:, None], axis=1)[:, 0])
        places.append(place)
    best = np.concatenate(pooled, axis=1) + p["bias"]
    first = np.maximum(best, 0)
    second = np.maximum(first @ p["hidden"] + p["hidden_bias"], 0)
    return second @ p["out"] + p["out_bias"], (letters, places, best, first, second)


def gradients(p: dict, x: np.ndarray, error: np.ndarray, held) -> dict[str, np.ndarray]:
    letters, places, best, first, second = held
    grads = {"out": second.T @ error, "out_bias": error.sum(axis=0)}
    back = (error @ p["out"].T) * (second > 0)
    grads |= {"hidden": first.T @ back, "hidden_bias": back.sum(axis=0)}
    back = (back @ p["hidden"].T) * (best > 0)
    grads["bias"] = back.sum(axis=0)
    grads["embed"] = np.zeros_like(p["embed"])
    row = np.arange(len(x))[:, None]
    for n, width in enumerate(WIDTHS):
        part, table = back[:, n * FILTERS:(n + 1) * FILTERS], p[f"filter{width}"]
        grad = np.zeros_like(table)
        for j in range(width):
            span = slice(j * EMBED, (j + 1) * EMBED)
            at = places[n] + j
            grad[span] = np.einsum("bfe,bf->ef", letters[row, at], part)
            np.add.at(grads["embed"], x[row, at], part[:, :, None] * table[span].T[None])
        grads[f"filter{width}"] = grad
    return grads


def begin(kinds: int, rng: np.random.Generator) -> list[dict[str, np.ndarray]]:
    """Parameters before the first step, and the two running moments of their gradients."""
    size = FILTERS * len(WIDTHS)
    shapes = {"embed": (2 * SYMBOLS, EMBED), "hidden": (size, HIDDEN), "out": (HIDDEN, kinds)}
    shapes |= {f"filter{w}": (w * EMBED, FILTERS) for w in WIDTHS}
    p = {k: (rng.standard_normal(s) * (1 if k == "embed" else s[0] ** -0.5)).astype(np.float32)
         for k, s in shapes.items()}
    p |= {"bias": np.zeros(size, np.float32), "hidden_bias": np.zeros(HIDDEN, np.float32),
          "out_bias": np.zeros(kinds, np.float32)}
    return [p, *[{k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)]]


def descend(state: list[dict], batch, rows: int, share: np.ndarray, steps: range, total: int,
            rng: np.random.Generator) -> list[dict]:
    """The state after the given steps of Adam (of ``total``) on the sum of the kinds' logistic
    losses, labelled windows weighted to balance.  ``batch(places)`` gives symbols and labels;
    every window is used once before one is used again."""
    p, first, second = ({**part} for part in state)
    order = np.zeros(0, dtype=np.int64)
    for step in steps:
        if not len(order):
            order = rng.permutation(rows)
        chosen, order = order[:BATCH], order[BATCH:]
        rate = 0.01 * 0.05 ** (step / total)
        x, y = batch(chosen)
        logits, held = forward(p, x)
        error = (_sigmoid(logits) - y) * np.where(y > 0, 0.5 / share, 1)
        for k, g in gradients(p, x, error.astype(np.float32) / len(x), held).items():
            g = g + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step))
                    / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return [p, first, second]


def balance(share: np.ndarray) -> np.ndarray:
    return np.clip(share, 1e-3, 0.5)


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters fitted on arrays at hand; fit() does it over a table."""
    total = max(steps, EPOCHS * -(-len(x) // BATCH))
    rng = np.random.default_rng(seed)
    return descend(begin(y.shape[1], rng), lambda at: (x[at], y[at]), len(x),
                   balance(y.mean(axis=0)), range(1, total + 1), total, rng)[0]


def calibrate(logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from logits to labels (Newton, ridge); n says
    how many windows an entry stands for."""
    a, b = 1.0, 0.0
    for _ in range(25):
        chance = _sigmoid(a * logits + b)
        error, weight = n * (chance - y), n * np.maximum(chance * (1 - chance), 1e-6)
        grad = np.array([error @ logits + 1e-2 * (a - 1), error.sum() + 1e-2 * b])
        curve = np.array([[weight @ logits**2 + 1e-2, weight @ logits],
                          [weight @ logits, weight.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(curve, grad), -1, 1)
    return max(a, 1e-3), b


def windows_of(docs: DataFrame) -> DataFrame:
    """w, bits: the distinct windows of the candidates of all documents, and their kinds."""
    def run(batches):
        for batch in batches:
            window, bits = [], []
            for text in batch.column(0).to_pylist():
                known = base_findings(text)
                for start, end in candidates(text):
                    mine = sum({1 << k for s, k, e in known if s < end and e > start})
                    new = pieces(text, start, end)
                    # Of a long finding, the windows that a finding reaches.
                    window += new
                    bits += [mine] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.string()),
                                              pa.array(bits, pa.int32())], names=["w", "bits"])

    found = C.texts(docs).filter("text <> ''").select("text").mapInArrow(run, "w string, bits int")
    return found.groupBy("w").agg(F.bit_or("bits").alias("bits"))


def kinds_of(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(KINDS)) & 1).astype(np.float32)


def labelled_windows(docs: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """At most so many windows and their kinds, to look at; learn() goes over all of them."""
    table = windows_of(docs).orderBy(F.xxhash64("w"), "w").limit(most).toArrow()
    return table["w"].to_pylist(), kinds_of(table["bits"].to_numpy())


def turns_of(docs: DataFrame) -> DataFrame:
    """windows_of, written by turn: ASIDE (three in ten, by a hash) or 0 to TURNS - 1."""
    turn = F.when(F.crc32(F.col("w").cast("binary")) % 10 < 3, ASIDE).otherwise(
        F.pmod(F.xxhash64("w"), F.lit(TURNS)).cast("int"))
    return C.staged(windows_of(docs).withColumn("turn", turn), "secret-windows", "turn")


def fit(rows: DataFrame, count: int, share: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters fitted on all of ``rows`` (w, bits, turn).

    Up to 2 LOAD windows are one trainer's, who goes over them until STEPS steps are made, but
    not more than EPOCHS times: secrets that no pattern finds are among the unlabelled ones, and
    would be learned by heart.  Of more, every trainer has a share: in each turn all start from
    the same state, go over all their windows of that turn, and the mean of their states is the
    next one.
    """
    trainers = min(max(count // LOAD, 1), TRAINERS)
    turns = range(TURNS) if trainers > 1 else [None]
    once = -(-count // BATCH)
    steps = (max(-(-once // (trainers * TURNS)), FEW // TURNS) if trainers > 1
             else max(once, FEW, min(STEPS, EPOCHS * once)))
    rng = np.random.default_rng(seed)
    state = begin(len(KINDS), rng)
    names = list(state[0])
    dealt = rows.withColumn("trainer", F.pmod(F.xxhash64("w", F.lit(1)), F.lit(trainers)))

    def trainer(state, n):
        def run(key, table):
            table = table.sort_by("w")
            w, y = table["w"].to_pylist(), kinds_of(table["bits"].to_numpy())
            # All of a trainer's windows, also where they are more than the mean.
            own = max(steps, -(-len(w) // BATCH))
            done = descend(state, lambda at: (symbols([w[i] for i in at]), y[at]), len(w), share,
                           range(n * steps + 1, n * steps + own + 1), len(turns) * steps, rng)
            flat = np.concatenate([part[k].ravel() for part in done for k in names])
            return pa.table({"trainer": [key[0].as_py()], "state": [flat.astype("<f4").tobytes()]})
        return run

    for n, turn in enumerate(turns):
        mine = dealt if turn is None else dealt.filter(F.col("turn") == turn)
        back = sorted(mine.select("trainer", "w", "bits").repartition(4 * trainers, "trainer")
                      .groupBy("trainer").applyInArrow(
                          trainer(state, n), "trainer long, state binary").collect())
        mean = np.mean([np.frombuffer(r.state, "<f4") for r in back], axis=0, dtype=np.float64)
        at = 0
        new = [{} for _ in state]
        for part, old in zip(new, state):
            for k in names:
                part[k] = mean[at:at + old[k].size].reshape(old[k].shape).astype(np.float32)
                at += old[k].size
        state = new
    return state[0]


def judged_logits(rows: DataFrame, params: dict) -> dict[int, list]:
    """Per kind: label, number, lowest and highest logit of all windows, by steps of 1 / LEVELS
    and label; a bounded summary, whatever the number of windows."""
    shared = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        for batch in batches:
            x = symbols(batch.column(0).to_pylist())
            y = kinds_of(batch.column(1).to_numpy())
            logits = [forward(shared.value, x[at:at + BATCH])[0] for at in range(0, len(x), BATCH)]
            z = np.concatenate(logits or [y]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(len(KINDS), dtype=np.int32), len(x))),
                 pa.array(y.astype(np.int32).ravel()), pa.array(z.ravel())],
                names=["kind", "label", "z"])

    level = F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z"))) * LEVELS)
    summed = rows.select("w", "bits").mapInArrow(run, "kind int, label int, z double").groupBy(
        "kind", "label", level.alias("level")).agg(
        F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
    out = {k: [] for k in range(len(KINDS))}
    for r in summed.collect():
        out[r.kind].append((r.label, r.n, r.low, r.high))
    return {k: sorted(v) for k, v in out.items()}


def learn(docs: DataFrame, recall: float = 0.98) -> Network | None:
    """A network fitted on the findings in all documents; None without findings.

    Three windows in ten, by a hash, are kept aside for calibration and thresholds."""
    windows = turns_of(docs)
    aside = F.col("turn") == ASIDE
    totals = {r.aside: r for r in windows.groupBy(aside.alias("aside")).agg(
        F.count("*").alias("n"), *[F.sum(F.col("bits").bitwiseAND(F.lit(1 << k)) / (1 << k))
                                   .alias(name) for k, name in enumerate(KINDS)]).collect()}
    known = {side: np.array([r[name] for name in KINDS]) for side, r in totals.items()}
    if not any(v.any() for v in known.values()):
        return None
    apart = len(known) == 2 and all(v.any() for v in known.values())
    count = totals[False].n if apart else sum(r.n for r in totals.values())
    found = known[False] if apart else sum(known.values())
    params = fit(windows.filter(~aside) if apart else windows.withColumn(
        "turn", F.pmod(F.xxhash64("w"), F.lit(TURNS))), count, balance(found / count))
    net = Network(params, np.ones(len(KINDS)), np.zeros(len(KINDS)), np.full(len(KINDS), 2.0))
    for k, levels in judged_logits(windows.filter(aside) if apart else windows, params).items():
        label, n, low, high = (np.array(v, dtype=np.float64) for v in zip(*levels))
        if not label.any():
            continue
        net.slope[k], net.intercept[k] = calibrate((low + high) / 2, label, n)
        # The level that holds the labelled window at the asked share, from below.
        held, others = np.flatnonzero(label > 0), np.flatnonzero(label == 0)
        held = held[np.argsort(low[held])]
        place = int(n[held].sum() * (1 - recall))
        least = low[held[np.searchsorted(np.cumsum(n[held]), place, side="right")]]
        if len(others) and high[others].max() < least:
            least = (least + high[others].max()) / 2
        net.threshold[k] = _sigmoid(least * net.slope[k] + net.intercept[k])
    return net


def findings(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, found: sorted spans of every row, by start, then kind as listed.

    Findings of the patterns have score 1 and stay; a candidate that touches none of them is
    added as kind "network" where a kind's chance reaches its threshold, with the chance.  A
    candidate longer than a window is added if one of its windows is.  Null and empty texts
    have no findings; rows that repeat or share an id, or have none, are scanned one by one;
    an empty table has no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def judged(net, windows, owner, count):
        """Per candidate the highest chance that reaches a threshold, or 0."""
        best = np.zeros(count)
        if windows:
            chance = net.chances(symbols(windows))
            np.maximum.at(best, np.array(owner), np.where(
                chance >= net.threshold, chance, 0).max(axis=1))
        return best

    def run(batches):
        net = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [base_findings(t) for t in texts]
            asked, windows, owner, scores = [], [], [], []
            for i, text in enumerate(texts):
                for start, end in candidates(text) if net is not None else ():
                    new = pieces(text, start, end)
                    windows += new
                    owner += [len(asked)] * len(new)
                    asked.append((i, start, end))
                    if len(windows) > 8192:
                        scores.append(judged(net, windows, np.array(owner) - sum(map(len, scores)),
                                             len(asked) - sum(map(len, scores))))
                        windows, owner = [], []
            done = sum(map(len, scores))
            if net is not None:
                scores.append(judged(net, windows, np.array(owner, dtype=np.int64) - done,
                                     len(asked) - done))
            out = [[(s, k, e, 1.0) for s, k, e in f] for f in known]
            score = np.concatenate(scores) if scores else np.zeros(0)
            for n in np.flatnonzero(score).tolist():
                i, start, end = asked[n]
                if not any(s < end and e > start for s, _, e in known[i]):
                    out[i].append((start, len(KINDS), end, float(score[n])))
            names = (*KINDS, ADDED)
            rows = [[{"kind": names[k], "start": s, "end": e, "score": c}
                     for s, k, e, c in sorted(f)] for f in out]
            kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                              ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))],
                                             names=["doc_id", "found"])

    return C.texts(docs).mapInArrow(run, f"doc_id long, found {FOUND}")


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """Counts, digest and list of the spans of every row; see findings()."""
    def spans(found):
        return F.array_join(F.transform(found, lambda f: F.concat_ws(
            ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("found", lambda f: f["kind"] != ADDED)
    return findings(docs, net).select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"))
