"""Stage tables: what is stored, how often it is read, and how work is dealt out."""

import os

from engram.operators import consolidate as C
from engram.operators import history as H
from engram.session import shared_folder, written
from engram.sources import tables as S
from engram.streaming import fold


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_written_keeps_rows_and_stores_columns_apart(spark):
    df = spark.sql("select id, if(id % 3 = 0, null, concat('t', id)) as text, "
                   "struct(id as a, array('x', null) as b) as s, "
                   "timestamp_ntz'2024-01-01 00:00:00' as ts from range(20)")
    kept = written(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert _rows(kept) == _rows(df)
    stages = os.path.join(shared_folder(spark), "stages")
    assert all(f.endswith(".parquet") and stages in f for f in kept.inputFiles())
    assert _rows(written(df.limit(0))) == []


def test_messages_are_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 10)
    path = str(tmp_path / "many")
    cores = spark.sparkContext.defaultParallelism
    spark.range(95).repartition(cores + 2).write.parquet(path)
    dealt = S.spread(spark.read.parquet(path))
    assert dealt.rdd.getNumPartitions() == 10
    assert sorted(r.id for r in dealt.collect()) == list(range(95))
    few = S.spread(spark.read.parquet(path).limit(5))
    assert few.rdd.getNumPartitions() == cores


def _items(spark):
    rows = [(u, f"i{u}-{n}", "active", "project", "project", f"project.{field}", field, value,
             f"{field}={value}", n, 0, 0.8 + n / 100, 0.5, 0.5)
            for u in (1, 2) for n, (field, value) in enumerate(
                [("database", "Neon"), ("framework", "Hono"), ("database", "Turso")][:3 if u == 1
                                                                                     else 2])]
    rows += [(3, f"i3-{n}", "active", "project", "project", "project.database", "database", v, v,
              n, 0, 0.9, 0.5, 0.5) for n, v in enumerate(("Neon", "Turso", "MySQL"))]
    return spark.createDataFrame(
        rows, "user_id long, item_id string, status string, scope string, subject string, "
        "topic_key string, predicate string, value string, content string, started_seq int, "
        "started_pos int, confidence double, importance double, stability double")


def test_clusters_are_looked_for_once(spark, monkeypatch):
    calls, real = [], C.clustered
    monkeypatch.setattr(C, "clustered", lambda items: calls.append(1) or real(items))
    sources = C.superseded_by_consolidation(_items(spark))
    # User 2 has too few items, user 3 one field only.
    assert sorted(r.item_id for r in sources.collect()) == ["i1-0", "i1-1", "i1-2"]
    assert len(calls) == 1
    assert [r.user_id for r in C.consolidate(_items(spark)).collect()] == [1]


def test_version_rows_met_raw_or_half_made_are_the_same(spark, monkeypatch):
    from tests.test_memory import routed_of
    routed = written(routed_of(spark, [
        (1, "The database is Neon"), (2, "The database is Neon"), (3, "The database is Turso"),
        (4, "I prefer Go"), (5, "forget Go"), (6, "I prefer Rust")]))
    applied = H.apply_in_order(routed)
    raw, half = (H.version_rows(applied.said, applied.ended, b) for b in (True, False))
    assert raw.count() > 0 and _rows(raw) == _rows(half)
    stored = []
    monkeypatch.setattr(H, "written", lambda df: stored.append(1) or written(df))
    assert H.versions_of(applied).inputFiles() and len(stored) == 1


def test_remembered_pairs_are_bounded_by_length():
    fold._known_ratio.cache_clear()
    long = "the quarterly budget of the platform team " * 20
    assert fold.closeness(long, long + "x") > 0.99
    assert fold._known_ratio.cache_info().currsize == 0
    assert fold.closeness("the region is oslo", "the region is osla") > 0.9
    info = fold._known_ratio.cache_info()
    assert info.currsize == 1 and info.maxsize * fold.KNOWN_LENGTH < 1 << 24


def test_rows_of_one_place_keep_one_order_in_chunks(spark):
    from tests.test_memory import routed_of
    one = routed_of(spark, [(1, f"The region is eu-{i // 3}") for i in range(60)])
    # Every candidate comes twice, at one place.
    routed = written(one.unionByName(one).repartition(5))
    names = ("item_id", "segment", "version", "content", "source_count", "started_seq")
    whole = H.apply_candidates(routed).select(*names)
    split = H.apply_candidates(routed, hot_rows=4, chunk=8, hot_chain=4).select(*names)
    assert _rows(split) == _rows(whole)
