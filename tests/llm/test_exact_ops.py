"""Operators with an exact answer, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from engram.llm import components, decontaminate, exact, lines, minhash, packing, substring, suffixes, tokens
from engram.llm.queries import vocabulary

ODD = ["", None, " ", "\n\n", "a", "A  b", "x\t\ty\x0b z", "\x1cq", "été là", "日本 語", "a\0b c \0 d"]


def frame(spark, rows, parts=3):
    """documents with columns whose names the operators use themselves."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, "
              "h long, begin string, component long, _text string, w int, id int, size int")
    full = [(i, t, "en", "s", len(t or ""), 1, "b", 2, "t", 3, 4, 5) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(parts)


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(vocabulary())


def test_encoder_equals_whole_text_encoding(encoder):
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "a", "b", "é", ".", "'s", "1", "\0", "\t", "word", "(", ")", "'",
             "\xa0", "　", "<|endoftext|>", "\x1c", "日", "²", "."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    texts += ["long" * 5000, " ".join(words(rnd, 3000))]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert raw == np.array(encoder._plain(text) + [0], dtype="<u4").tobytes(), text


def test_added_tokens_are_encoded_as_the_library_does(encoder):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary())
    texts = ["a <|endoftext|> b", "a b", "<|endoftext|>", "x<|endoftext|>\ny.", "<|endoftext| >", "", "c"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    for ids, raw in zip(want, encoder.encode(texts), strict=True):
        assert raw == np.array(ids + [0], dtype="<u4").tobytes()


def test_encoder_with_a_small_memory(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    rnd = random.Random(2)
    texts = [" ".join(words(rnd, 30, 5000)) + ".\nNext line." for _ in range(600)]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert raw == np.array(encoder._plain(text) + [0], dtype="<u4").tobytes()


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 5000])
def test_blocks_round_trip(size):
    rng = np.random.default_rng(size)
    for ids in (rng.integers(0, 2**32, size), np.full(size, 7), rng.integers(0, 50, size)):
        ids = ids.astype("<u4")
        ids[::97] = 2**31 + 5
        for percentile in (0.0, 0.5, 0.98, 1.0):
            assert (tokens.unpack(tokens.pack(ids, percentile)) == ids).all()


def test_token_blocks(spark, tmp_path, encoder, monkeypatch):
    rows = list(enumerate(ODD)) + [(50, "long " * 3000), (7, ODD[7]), (None, "no id")]
    tokens.write_blocks(frame(spark, rows), vocabulary(), str(tmp_path / "t"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32)
                 for r in tokens.read_blocks(spark, str(tmp_path / "t")).collect())
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = np.array(encoder._plain(text or "") + [0], dtype="<u4").tobytes()
        want.append((doc is not None, doc or 0, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert got == sorted(want)
    tokens.write_blocks(frame(spark, rows).limit(0), vocabulary(), str(tmp_path / "e"))
    assert tokens.read_blocks(spark, str(tmp_path / "e")).count() == 0


def copies():
    rnd = random.Random(4)
    base = [" ".join(words(rnd, 20)) for _ in range(30)]
    rows = [(i, rnd.choice(base).replace(" ", rnd.choice([" ", "  ", "\n"]))) for i in range(300)]
    rows += [(400 + i, base[0]) for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, base[1]), (None, "alone"), (5, rows[5][1])]
    return rows


def clean(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_content_groups(spark):
    rows = copies()
    groups = {}
    for doc, text in rows:
        groups.setdefault(clean(text), []).append(doc)
    got = exact.content_groups(frame(spark, rows, 7)).collect()
    assert len(got) == len(rows)
    want = []
    for doc, text in rows:
        ids = groups[clean(text)]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((doc, keep, len(ids), doc == keep, hashlib.sha256(clean(text).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert exact.content_groups(frame(spark, rows).limit(0)).count() == 0


def test_drop_copies_across_partitions(spark):
    rows = copies()
    before = frame(spark, rows, 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        after = exact.drop_copies(before)
        assert after.columns == before.columns
        got = sorted((clean(r.text), repr(r.doc_id)) for r in after.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    best = {}
    for doc, text in rows:
        best.setdefault(clean(text), []).append(doc)
    assert got == sorted((t, repr(min((i for i in ids if i is not None), default=None)))
                         for t, ids in best.items())
    assert exact.drop_copies(before.limit(0)).count() == 0


def check_packing(got, lengths, capacity):
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, parts in docs.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert [p[1] for p in parts] == np.cumsum([0] + [p[2] for p in parts[:-1]]).tolist()
        assert all(p[2] == capacity for p in parts[1:])
        assert sum(p[2] for p in parts) == lengths[doc]
    return len(sequences)


def test_packing(spark, encoder):
    rnd = random.Random(9)
    rows = [(i, " ".join(words(rnd, rnd.choice([0, 3, 40, 100, 300])))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "many words " * 2000)]
    lengths = {i: len(encoder._plain(t or "")) + 1 for i, t in rows}
    for group in (20_000, 60):
        got = packing.pack(frame(spark, rows), vocabulary(), 128, group_items=group).collect()
        bins = check_packing(got, lengths, 128)
        rest = [n % 128 for n in lengths.values() if n % 128]
        bound = packing.lower_bound(np.bincount(rest, minlength=129)) + sum(n // 128 for n in lengths.values())
        assert bound <= bins <= bound * 1.05 + 2
    assert packing.pack(frame(spark, rows).limit(0), vocabulary()).count() == 0


def test_lower_bound_holds_and_beats_the_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(1, 21, 7)
        best = min(len(packing.best_fit(rng.permutation(sizes), 20)[2]) for _ in range(20))
        assert packing.lower_bound(np.bincount(sizes, minlength=21)) <= best
    assert packing.lower_bound(np.bincount([11] * 10, minlength=21)) == 10
    assert packing.lower_bound(np.bincount([7] * 9, minlength=21)) == 5
    assert packing.lower_bound(np.zeros(21, dtype=int)) == 0


def shingle_sets(rows, size):
    out = {}
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc] = ({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size
                    else {tuple(w)} if w else set())
    return out


def near_rows():
    rnd = random.Random(11)
    rows, doc = [], 0
    for _ in range(25):
        base = words(rnd, rnd.choice([2, 6, 15, 60, 200]), 3000)
        for _ in range(rnd.choice([1, 2, 8])):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                text[rnd.randrange(len(text))] = f"z{rnd.randrange(9999)}"
            rows.append((doc, " ".join(text).upper() if rnd.random() < 0.2 else "\n".join(text)))
            doc += 1
    # A chain: neighbours are near, ends are not.
    chain = words(rnd, 100, 10**6)
    for k in range(30):
        rows.append((doc, " ".join(chain)))
        chain[(3 * k) % 100] = f"c{k}"
        doc += 1
    return rows + [(doc + 1 + i, t) for i, t in enumerate(ODD)]


def crowd_rows():
    """One large group of loose copies: families of near copies that differ from each other."""
    rnd = random.Random(17)
    base, rows = words(rnd, 120, 5000), []
    for _ in range(25):
        family = list(base)
        for _ in range(rnd.choice([1, 4, 8])):
            family[rnd.randrange(len(family))] = f"f{rnd.randrange(40)}"
        for _ in range(rnd.choice([1, 4, 12])):
            text = list(family)
            for _ in range(rnd.choice([0, 1, 2, 3])):
                at = rnd.randrange(len(text))
                text[at:at + rnd.choice([0, 1, 1, 2])] = [f"m{rnd.randrange(60)}"] * rnd.choice([0, 1])
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("rows", "size", "percent"), [
    (near_rows(), 3, 85), (near_rows(), 5, 80), (crowd_rows(), 3, 85), (crowd_rows(), 5, 80)])
def test_near_groups(spark, rows, size, percent):
    sets = shingle_sets(rows, size)
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    changed |= label[a] != label[b]
                    label[a] = label[b] = low
    got = minhash.near_groups(frame(spark, rows), size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        (d, len(sets[d]), label[d], d == label[d]) for d in sets)


def test_near_copies_of_texts_that_share_an_id(spark):
    rnd = random.Random(3)
    text, other = (" ".join(words(rnd, 60, 4000)) for _ in range(2))
    near = text + " last"
    kept = minhash.drop_near_copies(frame(spark, [(1, text), (2, near), (2, other), (2, other), (3, near)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, text), (2, other), (2, other)])
    bench = spark.createDataFrame([(1, " ".join(text.split()[10:45]))], "item_id long, text string")
    rows = [(2, text), (2, other), (None, near), (None, other)]
    clean = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert sorted(r.text for r in clean.collect()) == [other, other]


def test_near_groups_edges(spark):
    assert minhash.near_groups(frame(spark, near_rows()).limit(0)).count() == 0
    rows = [(None, "same words here now then"), (3, "same words here now then"), (None, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(frame(spark, rows)).collect()}
    assert got == {(None, None, True), (3, 3, True)}
    after = minhash.drop_near_copies(frame(spark, rows + [(4, "same words here now then")]))
    assert after.count() == 2 and after.columns == frame(spark, rows).columns


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {k: v for k, v in label.items() if k != v}
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_overlaps(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(words(rnd, n, 5000)).capitalize() + ".") for i, n in enumerate([40, 40, 20, 13, 200])]
    items += [(10, "only three words"), (11, None), (12, " ."), (13, items[0][1])]

    def plant(text, every):
        found = text.split()
        for i in range(2, len(found), every):
            found[i] = f"s{i}"
        return " ".join(words(rnd, 30)) + " " + " ".join(found).upper() + "! " + " ".join(words(rnd, 9))

    rows = [(0, plant(items[0][1], 10**6)), (1, plant(items[1][1], 5)), (2, plant(items[2][1], 5)),
            (3, plant(items[3][1], 6)), (4, plant(items[4][1], 7)), (5, " ".join(words(rnd, 500))),
            (6, plant(items[0][1], 3)), (7, "So: ONLY three-words, then"), (8, "only four words"),
            (9, " ".join(items[4][1].split()[150:]) + " end"), (20, None), (21, ""), (22, "x"),
            (None, plant(items[2][1], 9))]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(frame(spark, rows), tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {
        (0, 0), (0, 13), (1, 1), (2, 2), (3, 3), (4, 4), (7, 10), (9, 4), (None, 2)}
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[0, 0].first_token == 30 and by[0, 0].matched == 39 and by[0, 0].n_overlaps == 1
    assert by[9, 4].first_token == 0 and by[9, 4].matched == 50
    left = decontaminate.drop_contaminated(frame(spark, rows), tests)
    assert sorted(r.doc_id for r in left.collect()) == [5, 6, 8, 20, 21, 22]
    assert left.columns == frame(spark, rows).columns
    assert decontaminate.overlaps(frame(spark, rows), tests.limit(0)).count() == 0
    assert decontaminate.overlaps(frame(spark, rows).limit(0), tests).count() == 0


def test_overlaps_in_blocks(spark, monkeypatch):
    rnd = random.Random(18)
    items = [(i, " ".join(words(rnd, 30, 9000))) for i in range(20)]
    rows = [(i, "a b " + t) for i, t in items]
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 300)
    got = decontaminate.overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_overlaps, r.first_token, r.matched) for r in got.collect()) == [
        (i, i, 1, 2, 30) for i in range(20)]


def test_masks_meet_every_alignment():
    from itertools import combinations
    for size in (9, 13, 14, 16, 17, 18, 19, 20):
        wrong = size * (100 - decontaminate.PERCENT) // 100
        seeds = [{p + j for j in m} for m in decontaminate.MASKS for p in range(size - m[-1])]
        assert all(any(not s & set(bad) for s in seeds) for bad in combinations(range(size), wrong))


def test_short_items_meet_every_substitution(spark):
    from itertools import combinations
    items, rows, want = [], [], set()
    for size in range(1, 20):
        wrong = size * (100 - decontaminate.PERCENT) // 100
        seeds = [{p + j for j in m} for m in decontaminate.masks_of(size) for p in range(size - m[-1])]
        ways = list(combinations(range(size), wrong))
        assert all(any(not s & set(bad) for s in seeds) for bad in ways), size
        items.append((size, " ".join(f"i{size}w{k}" for k in range(size))))
        for bad in [*(ways if size <= 15 else ways[::50]), tuple(range(wrong + 1))]:
            text = ["x" if k in bad else f"i{size}w{k}" for k in range(size)]
            rows.append((len(rows), " ".join(["some", "words", *text, "more"])))
            if len(bad) == wrong:
                want.add((rows[-1][0], size, 1, 2, size - wrong))
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(frame(spark, rows), tests).collect()
    assert {tuple(r) for r in got} == want


def brute_lines(rows):
    places, gone = {}, {}
    split = {i: (t or "").split("\n") for i, t in rows}
    for doc in sorted(split):
        cut = [x.strip(" \t\r") for x in split[doc]]
        for i in range(len(cut) - 2):
            if any(cut[i:i + 3]):
                places.setdefault(tuple(cut[i:i + 3]), []).append((doc, i))
    for found in places.values():
        for doc, i in found[1:]:
            gone.setdefault(doc, set()).update((i, i + 1, i + 2))
    return {d: ("\n".join(x for i, x in enumerate(ls) if i not in gone.get(d, ())), len(ls),
                len(gone.get(d, ()))) for d, ls in split.items()}


def test_repeated_lines(spark):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice(["a", "b ", " c", "", "d\r"]) for _ in range(rnd.randint(0, 12))))
            for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n"), (103, "q\nr\ns\nq\nr\ns\nq\nr\ns"),
             (104, "z\n" * 3000)]
    rnd.shuffle(rows)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed)
           for r in lines.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)
    twice = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")]
    got = sorted((r.doc_id or 0, r.text, r.n_removed)
                 for r in lines.drop_repeated_lines(frame(spark, twice)).collect())
    assert got == [(0, "", 3), (1, "a\nb\nc", 0), (1, "a\nb\nc", 0)]
    assert lines.drop_repeated_lines(frame(spark, rows).limit(0)).count() == 0


def test_repeated_lines_of_rows_that_share_an_id(spark):
    rnd = random.Random(16)
    rows = [(rnd.choice([None, None, 1, 2]), "\n".join(
        rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9)))) for _ in range(60)]
    rows += [(None, "p\nq\nr\nown"), (None, "p\nq\nr\nalone"), (None, "u\nv\nw\nx\ny"), (3, "m\nn\no"),
             (3, "k\nm\nn\no"), (3, "k\nl\nm1\nn1\no1")]
    places = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    want = brute_lines([(k, t) for k, (_, t) in enumerate(places)])
    got = lines.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in got) == sorted(
        (i or 0, *want[places.index((i, t))]) for i, t in rows)


def test_suffix_arrays():
    rnd = random.Random(0)
    for _ in range(400):
        letters = rnd.choice([b"ab", b"abc", b"a", bytes(range(97, 110)), b"\x00\xffa"])
        data = bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 60)))
        if rnd.random() < 0.3:
            data = data + data[:rnd.randint(0, 20)] + data
        text = np.frombuffer(data, np.uint8)
        array = suffixes.suffix_array(text)
        order = sorted(range(len(data)), key=lambda i: data[i:])  # noqa: B023
        assert array.tolist() == order
        want = [0]
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < len(data) and data[a + k] == data[b + k]:
                k += 1
            want.append(k)
        assert suffixes.common_prefixes(text, array).tolist() == want


def brute_repeats(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    places = {}
    for doc, raw in data.items():
        for i in range(len(raw) - length + 1):
            places.setdefault(raw[i:i + length], []).append((doc, i))
    gone = {d: np.zeros(len(raw), dtype=bool) for d, raw in data.items()}
    for found in places.values():
        if len(found) > 1:
            for doc, i in found:
                gone[doc][i:i + length] = True
    return {d: (np.frombuffer(raw, np.uint8)[~gone[d]].tobytes(), len(raw), int(gone[d].sum()),
                int((np.diff(gone[d].astype(int), prepend=0) > 0).sum())) for d, raw in data.items()}


def repeat_rows(rnd):
    text = lambda n: " ".join(words(rnd, n, 10**6))
    passage = [text(70) for _ in range(4)]
    rows = []
    for _ in range(90):
        parts = [text(rnd.choice([0, 2, 30, 90]))]
        for _ in range(rnd.choice([0, 1, 1, 3])):
            found = rnd.choice(passage)
            cut = rnd.randint(0, 80)
            parts += [found[cut:len(found) - rnd.randint(0, 80)], text(rnd.choice([1, 20]))]
        rows.append("é ".join(parts))
    rows += [rows[0]] * 5 + ["a" * 1500, "b" * 400, "ab" * 300, rows[1][:450] * 3, None, "", "x" * 399]
    return list(enumerate(rows))


@pytest.mark.parametrize("limit", [256, 1])
def test_remove_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(substring, "SHARD_ANCHOR", limit)
    rows = repeat_rows(random.Random(limit))
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans)
           for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows, 400)


def test_remove_repeats_edges(spark, monkeypatch):
    long = " ".join(words(random.Random(1), 300, 10**6))
    monkeypatch.setattr(substring, "CHUNK", 700)
    rows = [(1, long), (1, long), (2, long[500:]), (None, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans)
                 for r in substring.remove_repeats(frame(spark, rows)).collect())
    size = len(long)
    assert got == [(0, 0, 0, 0), (1, size, size - 500, 1), (1, size, size - 500, 1), (2, size - 500, size - 500, 1)]
    assert substring.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_remove_repeats_of_rows_without_id_and_equal_short_hashes(spark):
    shared = " ".join(words(random.Random(21), 120, 10**6))
    texts = spark.range(300_000).selectExpr(f"concat(id, ' ', '{shared}') as text").selectExpr("text", "hash(text) as h")
    low, high = texts.groupBy("h").agg({"text": "min", "*": "count"}).filter("`count(1)` > 1").join(
        texts, "h").selectExpr("h", "text").orderBy("h", "text").limit(2).collect()
    assert low.h == high.h and low.text != high.text
    rows = [(None, low.text), (None, high.text), (None, low.text)]
    got = sorted((bytes(r.kept), r.n_removed)
                 for r in substring.remove_repeats(frame(spark, rows)).collect())
    want = brute_repeats([(0, low.text), (1, high.text)], 400)
    assert got == sorted((want[k][0], want[k][2]) for k in (0, 1, 0))
