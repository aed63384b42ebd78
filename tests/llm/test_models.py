"""Learned operators by held-out accuracy and edge rows; the pipeline stage by stage."""

import re
import time

import numpy as np
import pytest

import corpus_pipeline
from engram.llm import common as C
from engram.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "12 345 !!", None),
         (None, "the of and", None), (10**6 + 3, "été " * 40_000, "fr"), (10**6 + 3, "x", "fr")]


def with_edges(spark):
    docs = C.table(spark, SF, "documents")
    odd = spark.createDataFrame([(i, t, g, "s", 0, "c", 1.0) for i, t, g in EDGES],
                                "doc_id long, text string, lang string, source string, n_chars long, "
                                "score string, y double")
    return docs.unionByName(odd, allowMissingColumns=True)


def accuracy(rows, truth):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = {0: [], 1: []}
    for r in held:
        right[truth[r.doc_id]].append(r.predicted == truth[r.doc_id])
    return np.mean(right[0]), np.mean(right[1])


@pytest.fixture(scope="module")
def labels(spark):
    return C.table(spark, SF, "labels")


def test_toxic_scores(spark, labels):
    rows = queries.op2_toxic_segments(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    clean, toxic = accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()})
    assert clean > 0.97 and toxic > 0.5


def test_toxic_edges(spark, labels):
    model = toxicity.learn(with_edges(spark), labels, C.crc_remainder(5) != 0)
    rows = toxicity.passages(with_edges(spark), model).collect()
    assert len(rows) == 1000 + len(EDGES)
    assert {r.score < 0.5 for r in rows if r.doc_id is None or r.doc_id >= 10**6} == {True}
    found = [r for r in rows if r.passages]
    text = {r.doc_id: (r.text or "").encode() for r in with_edges(spark).collect()}
    for r in found:
        for p in r.passages:
            assert 0 <= p["first"] < p["last"] <= len(text[r.doc_id]) and p["score"] > 0
    empty = toxicity.learn(with_edges(spark), labels.limit(0), C.crc_remainder(5) != 0)
    assert toxicity.passages(with_edges(spark), empty).filter("score >= 0.5").count() == 0
    assert toxicity.passages(with_edges(spark).limit(0), model).count() == 0


def test_segments_are_all_maximal():
    rng = np.random.default_rng(2)
    for _ in range(300):
        values = rng.normal(size=rng.integers(1, 25))
        found = toxicity.segments(values)

        def split(low, high):
            best = None
            for i in range(low, high):
                for j in range(i + 1, high + 1):
                    total = values[i:j].sum()  # noqa: B023
                    if total > 0 and (best is None or total > best[0]):
                        best = (total, i, j)
            if best is None:
                return []
            return split(low, best[1]) + [best[0]] + split(best[2], high)

        assert sorted(s for _, _, s in found) == pytest.approx(sorted(split(0, len(values))))
        for begin, end, total in found:
            assert values[begin:end].sum() == pytest.approx(total)


def test_segments_take_linear_time():
    times = []
    for n in (50_000, 500_000):
        scores = np.tile([1.0, -3.0], n)
        start = time.perf_counter()
        found = toxicity.segments(scores)
        times.append(time.perf_counter() - start)
        assert len(found) == n and found[-1] == (2 * n - 2, 2 * n - 1, 1.0)
    assert times[1] < 40 * times[0] + 1


def test_quality_scores(spark, labels):
    rows = queries.op5_neighbour_votes(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    bad, good = accuracy(rows, {r.doc_id: r.quality for r in labels.collect()})
    assert bad > 0.7 and good > 0.9


def test_quality_votes_are_exact(spark, labels):
    docs = with_edges(spark)
    model = quality.learn(docs, labels, C.crc_remainder(3) != 1, per_class=60)
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    assert got[10**6] == pytest.approx(model.prior) and got[10**6 + 1] == pytest.approx(model.prior)
    for r in docs.filter("doc_id < 40").collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        x = np.log1p(quality.counts(data, np.array([0, len(data)]))) * model.weights
        point = (x / np.linalg.norm(x)) @ model.axes
        near = model.vectors @ (point / np.linalg.norm(point))[0]
        best = np.argsort(-near)[:quality.NEIGHBOURS]
        weight = np.maximum(near[best], 0) ** quality.SHARPNESS * model.votes[best]
        assert got[r.doc_id] == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), abs=1e-3)
    none = quality.learn(docs, labels.limit(0), C.crc_remainder(3) != 1)
    assert quality.scores(docs, none).count() == 1000 + len(EDGES)
    assert quality.scores(docs.limit(0), model).count() == 0


def test_languages(spark):
    rows = queries.op10_byte_convolution(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in C.table(spark, SF, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_language_edges(spark):
    docs = with_edges(spark)
    network = language.learn(docs, C.crc_remainder(4) != 2, per_language=60)
    got = {r.doc_id: (r.lang_pred, r.score)
           for r in language.predict(docs, network).filter("doc_id >= 1000000").collect()
           if r.doc_id != 10**6 + 3}
    assert got == {10**6: ("und", 0.0), 10**6 + 1: ("und", 0.0), 10**6 + 2: ("und", 0.0)}
    assert language.learn(docs.limit(0), C.crc_remainder(4) != 2) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    windows = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    best, _ = network.maxima(windows)
    plain = language._log_softmax(np.maximum(best, 0) @ network.weights + network.bias)
    assert np.allclose(plain, network.log_probabilities(windows), atol=1e-3)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 256, b"b" * 257, b"c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    found, rows = language.windows_of(data, np.cumsum([0] + [len(t) for t in texts]))
    for i, text in enumerate(texts):
        assert found[rows == i].tobytes().rstrip(b"\0") == text


def test_pipeline(spark):
    docs = C.table(spark, SF, "documents")
    labels = {r.doc_id: r.toxic for r in C.table(spark, SF, "labels").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = C.staged(stage(spark, seen[-1], SF), name.replace(" ", "-"))
        assert after.columns == docs.columns
        assert after.exceptAll(seen[-1]).count() == 0
        seen.append(after)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    gone = ids[0] - ids[1]
    assert gone and np.mean([labels[i] for i in gone if i in labels]) > 0.8
    text = lambda d: [re.sub("[\x20\x09-\x0d]+", " ", r.text) for r in d.select("text").collect()]
    assert sorted(text(seen[2])) == sorted(set(text(seen[1])))
    assert ids[3] < ids[2] and ids[4] < ids[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[4]


def test_pipeline_on_empty_and_odd_rows(spark):
    docs = with_edges(spark)
    for part in (docs.limit(0), docs.filter("doc_id >= 1000000 or doc_id is null")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            part = C.staged(stage(spark, part, SF), name.replace(" ", "-"))
            assert part.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, part, SF).collect()
    # The empty texts are copies of each other; every other odd row is clean.
    assert part.count() == len(EDGES) - 1


def test_rate_counts_every_word():
    above, mean = np.linspace(0.1, 3, 1000), -0.02
    explicit = np.concatenate((above, np.full(4_000_000, mean)))
    rate = toxicity._rate(above, 4_000_000, mean)
    assert abs(np.mean(np.exp(rate * explicit)) - 1) < 1e-9
    assert toxicity._rate(above, 2_000_000, mean) != rate
    assert toxicity._rate(above[:0], 10, mean) == 1.0
