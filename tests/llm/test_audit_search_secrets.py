"""Filter audit, ranked search and secret scans against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import audit, ranking, secrets

SPACES = "[\x20\x09-\x0d]+"


def frame(spark, rows, source="s"):
    """documents with columns whose names the operators use themselves."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, n long, h string, "
              "mask int, part string, score double, found int, m int, k int, item_id long")
    full = [(i, t, "en", s[0] if (s := rest) else source, 0, 1, "h", 2, "p", 0.5, 3, 4, 5, 6)
            for i, t, *rest in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def labels_frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows],
                                 "doc_id long, quality int, toxic int, part string")


# --- filter audit ---------------------------------------------------------------

def audited(rows, labels):
    """Every order applied to every row in turn."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(lowest.get(t or "", i), i)
    held = {}
    for i, t, s in rows:
        t = t or ""
        w = [x for x in re.split(SPACES, t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and lowest[t] < i}
        held.setdefault(s or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, docs in held.items():
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[0][f] for d in docs) - len(gone),
                    sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), f]
    for (part, _, _), row in out.items():
        docs = held[part]
        row[-1] = sum(1 for order in itertools.permutations("ABCDE") for d in docs
                      if d[0][row[-1]] and not any(
                          d[0][e] for e in order[:order.index(row[-1])]))
    return out


def test_audit_equals_every_order_applied(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(90)] + ["BIG", "#tag", "été", "日本"]
    rows = [(n, " ".join(rnd.choice(vocabulary[:rnd.choice([8, 94])])
                         for _ in range(rnd.choice([0, 1, 45, 49, 50, 51, 90]))),
             rnd.choice(["a", "b", "", None])) for n in range(40)]
    rows += [(100 + n, rows[n % 5][1], "b") for n in range(12)]
    rows += [(None, rows[0][1], "a"), (None, "only here", None), (None, None, "a"), (3, None, "a"),
             (7, "x " * 60, "b"), (7, "y " * 60, "a"), (7, "x " * 60, "b"), (7, "x " * 60, "a"),
             (8, "\x0b a\x1cb \t" * 60, "b"), (9, "long " * 30_000, "c")]
    labels = [(n, n % 2, n % 3 == 0) for n in range(0, 60, 2)] + [(None, 1, 1), (4, 1, 1), (4, None, 0),
                                                                 (7, 1, 1), (5000, 1, 1)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    want = audited(rows, labels)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails,
                                              r.good_lost, r.toxic_lost, r.shapley]
           for r in audit.audit(frame(spark, rows), labels_frame(spark, labels)).collect()}
    assert len(got) == 600 * 4
    assert got == want


def test_audit_of_nothing(spark):
    assert audit.audit(frame(spark, [(1, "a", "s")]).limit(0), labels_frame(spark, [(1, 1, 0)])).count() == 0
    rows = audit.audit(frame(spark, [(1, "a", None)]), labels_frame(spark, [(1, 1, 0)]).limit(0)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {r.good_lost for r in rows} == {0}


def test_gray_walk_toggles_one_filter_at_a_time():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (3, 32, 2))
    states = audit.gray_states(counts)
    for active in range(32):
        alive = [m for m in range(32) if m & active == 0]
        assert (states[:, active] == counts[:, alive].sum(axis=1)).all()


# --- ranked search --------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def ranked(docs, items, limit=10):
    terms = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    number, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in terms:
            m = 25 + (75 * sum(c.values()) * number) // length
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                        * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in TERM.findall(lower(text or "")) if t in c)
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, n, None if none else i, -s)
                for n, (s, none, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=repr)


def search_rows(spark, docs, items):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items],
                                  "item_id long, text string, doc_id string, rank int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score)
                   for r in ranking.search(frame(spark, docs), asked).collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET", 3)
    monkeypatch.setattr(ranking, "TREE_DOCS", 60)
    monkeypatch.setattr(ranking, "BLOCK_PAIRS", 40)
    rnd = random.Random(6)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["été", "日本", "Éa", "W1"]
    docs = [(n, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 30, 80]))))
            for n in range(400)]
    docs += [(1000 + n, docs[9][1] + " w1, w2;") for n in range(30)]
    docs += [(None, "w1 w2 w3"), (None, None), (5, "w7 w7"), (5, "w7 w7"), (6, "--- !!"),
             (2000, "w1 w5 " * 20_000)]
    items = [(n, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 12, 40]))))
             for n in range(25)]
    items += [(50, None), (51, "--"), (52, "nowhere"), (53, docs[9][1]), (54, "w1 W1 w1-w2"), (None, "w9 w4")]
    want = ranked(docs, items)
    assert search_rows(spark, docs, items) == want and len(want) > 200
    assert search_rows(spark, docs, items + items[:3]) == want


def test_search_of_nothing(spark):
    assert search_rows(spark, [(1, None), (2, "?")], [(1, "a")]) == []
    assert search_rows(spark, [(1, "a")], [(1, None)]) == []
    asked = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranking.search(frame(spark, [(1, "a")]).limit(0), asked).count() == 0
    assert ranking.search(frame(spark, [(1, "a")]), asked.limit(0)).schema["item_id"].dataType == \
        asked.schema["item_id"].dataType


def test_bounds_hold_and_search_leaves_subtrees_out():
    rng = np.random.default_rng(8)
    size, count = 200, 3000
    rows = [np.unique(rng.zipf(1.3, rng.integers(1, 30)) % size) for _ in range(count)]
    edges = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    terms = np.concatenate(rows)
    tf = rng.integers(1, 6, len(terms)).astype(np.int32)
    m = rng.integers(30, 300, count)
    tree = ranking.Tree(np.arange(count), np.zeros(count, bool), m, edges, terms, tf, size)
    leaves = [n for n in range(len(tree.low)) if not tree.inside[n]]
    assert sorted(i for n in leaves for i in range(tree.low[n], tree.high[n])) == list(range(count))
    assert max(tree.high[n] - tree.low[n] for n in leaves) <= ranking.BUCKET
    seen = []
    best = ranking.Best(10)
    add = best.add
    best.add = lambda s, i, x: (seen.append(len(s)), add(s, i, x))
    tree.search(np.array([150, 170, 190]), np.array([9000, 8000, 9500]), best)
    assert len(best.score) and sum(seen) < 0.6 * count


# --- secret scans ---------------------------------------------------------------

def patterns(text):
    """The patterns as they are written, matches too short dropped afterwards."""
    out = []
    rule = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
            r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for m in re.finditer(rule, text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_findings_equal_the_patterns():
    rnd = random.Random(9)
    parts = ["token", "Secret", "API_KEY", "apikey", "paſſword", "toKen", "=", ":", " ", "\t", "'", '"',
             "AKIA", "ABCDEF0123456789", "a" * 11, "b" * 12, "0123456789abcdef", "x", "é", "-", ".", "\n"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert secrets.base_findings(text) == patterns(text), text


def test_windows_cover_long_candidates():
    text = "key: " + "".join(chr(97 + i % 26) for i in range(500)) + " end"
    (start, end), = secrets.candidates(text)
    cut = secrets.pieces(text, start, end)
    body = [w[secrets.LEFT:secrets.LEFT + secrets.BODY].rstrip("\0") for w in cut]
    assert {len(w) for w in cut} == {secrets.WINDOW}
    joined = body[0] + "".join(b[secrets.BODY - secrets.STEP:] for b in body[1:])
    assert joined == text[start:end]
    assert len(secrets.pieces(text, 5, 17)) == 1


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2 * secrets.SYMBOLS, (5, secrets.WINDOW))
    y = rng.integers(0, 2, (5, 3)).astype(np.float64)
    p = {k: v.astype(np.float64) for k, v in secrets.train(x, y.astype(np.float32), steps=3).items()}

    def loss():
        z, _ = secrets.forward(p, x)
        return (np.logaddexp(0, z) - y * z).sum()
    z, held = secrets.forward(p, x)
    grads = secrets.gradients(p, x, 1 / (1 + np.exp(-z)) - y, held)
    for name in p:
        flat = p[name].reshape(-1)
        for at in rng.choice(np.flatnonzero(grads[name].reshape(-1)), 3):
            kept, flat[at] = flat[at], flat[at] + 1e-6
            high = loss()
            flat[at] = kept - 1e-6
            low = loss()
            flat[at] = kept
            assert grads[name].reshape(-1)[at] == pytest.approx((high - low) / 2e-6, rel=1e-3, abs=1e-6)


@pytest.fixture(scope="module")
def secret_docs(spark):
    rnd = random.Random(10)

    def word():
        return "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 15)))

    def code():
        return "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for n in range(400):
        w = [word() for _ in range(40)]
        if n % 3 == 0:
            w.insert(rnd.randrange(40), f'token = "{code()}"')
        if n % 5 == 0:
            w.insert(rnd.randrange(40), "password=" + code()[:18])
        w.insert(5, f"{word()}@mail{n % 7}.example.com")
        rows.append((n, " ".join(w)))
    return rows


def test_scan(spark, secret_docs):
    # A secret that no pattern finds: the keyword is unknown and the hexadecimal runs are short.
    hidden = "aeiou nor " + 'taken = "9c8b45435718dcc-f2e01a7d88b3c-77a10ec2b94d-0' + '" shore'
    place = f"network:{hidden.index('9c')}:{hidden.index('-0') + 2}"
    odd = [(None, 'é token = "' + "ab12" * 10), (None, None), (900, ""), (900, "plain words only"),
           (901, hidden), (902, "日本 " + "Z" * 20_000 + " password: " + "k" * 3000)]
    docs = frame(spark, secret_docs + odd)
    net = secrets.learn(docs)
    rows = secrets.scan(docs, net).collect()
    assert len(rows) == len(secret_docs) + len(odd)
    text = Counter((i, t or "") for i, t in secret_docs + odd)
    by_base = Counter()
    for (i, t), n in text.items():
        spans = patterns(t)
        digest = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        by_base[i, *[sum(k == j for _, k, _ in spans) for j in range(3)],
                hashlib.sha256(digest.encode()).hexdigest()] += n
    assert by_base == Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows)
    added = {r.doc_id: r.spans for r in rows if "network" in r.spans}
    assert added.get(901) == place
    assert len(added) < 8  # mail addresses and words are left alone


def test_thresholds_keep_recall(spark, secret_docs):
    docs = frame(spark, secret_docs)
    net = secrets.learn(docs, recall=0.95)
    windows, y = secrets.labelled_windows(docs, 20_000)
    chance = net.chances(secrets.symbols(windows))
    for k in (0, 2):
        assert (chance[y[:, k] > 0, k] >= net.threshold[k]).mean() >= 0.94
        assert (chance[y[:, k] == 0, k] >= net.threshold[k]).mean() < 0.02
    assert net.threshold[1] > 1  # no access key to learn from


def test_scan_without_findings(spark):
    docs = frame(spark, [(1, "nothing to find here"), (2, None)])
    assert secrets.learn(docs) is None
    rows = secrets.scan(docs, None).collect()
    assert [(r.spans, r.n_assign) for r in rows] == [("", 0)] * 2
    assert secrets.scan(docs.limit(0), None).count() == 0 and secrets.learn(docs.limit(0)) is None


def test_learning_reads_every_document(spark, secret_docs, monkeypatch):
    # An access key in one document of many, and several trainers that meet.
    monkeypatch.setattr(secrets, "LOAD", 100)
    monkeypatch.setattr(secrets, "TRAINERS", 3)
    rows = [(n, f"{t} mail{n}-{c}.host{n}.example.org") for n, t in secret_docs for c in "abc"]
    rare = "AKIA" + "Q7" * 8
    rows += [(9000 + n, f"key {rare}{n} here") for n in range(6)]
    docs = frame(spark, rows)
    turns = secrets.turns_of(docs)
    want = {}
    for _, text in rows:
        known = secrets.base_findings(text)
        for start, end in secrets.candidates(text):
            bits = sum({1 << k for s, k, e in known if s < end and e > start})
            for w in secrets.pieces(text, start, end):
                want[w] = want.get(w, 0) | bits
    assert {r.w: r.bits for r in turns.collect()} == want
    seen = []
    kept = secrets.fit

    def fit(rows, count, share, **more):
        seen.append((rows.count(), count))
        return kept(rows, count, share, **more)

    monkeypatch.setattr(secrets, "fit", fit)
    net = secrets.learn(docs)
    own = turns.filter(F.col("turn") != secrets.ASIDE).count()
    assert seen == [(own, own)] and own > 3 * secrets.LOAD
    levels = secrets.judged_logits(turns, net.params)
    assert [sum(n for _, n, _, _ in levels[k]) for k in range(3)] == [len(want)] * 3
    assert sum(n for label, n, _, _ in levels[1] if label) == sum(b & 2 > 0 for b in want.values())
    again = secrets.learn(docs)
    assert all((net.params[k] == again.params[k]).all() for k in net.params)
    windows, y = secrets.labelled_windows(docs, 10_000)
    chance = net.chances(secrets.symbols(windows))
    assert (chance[y[:, 0] > 0, 0] >= net.threshold[0]).mean() >= 0.9
    assert (chance[y[:, 0] == 0, 0] >= net.threshold[0]).mean() < 0.1
