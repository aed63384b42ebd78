"""Longest-common-subsequence similarity and joins on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.session import cut_lineage


def subsequence_ratio(a: str, b: str) -> float:
    """2 LCS / (m + n); row-parallel over the bits of an integer."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    # One bit per position of a: rows of the table advance with integer arithmetic.
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def lcs_ratio(a: str, b: str) -> float:
    """The ratio of trimmed lower-case texts."""
    return subsequence_ratio(a.lower().strip(), b.lower().strip())


@F.pandas_udf(T.DoubleType())
def content_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    # The same contents meet for many users: each pair of a batch is compared once.
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = lcs_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


#: Pairs up to this length meet on pieces, from this threshold on; others on rare characters.
PIECE_LENGTH, PIECE_THRESHOLD = 48, 0.85
#: Keys with up to so many pairs for each of their texts are compared directly: a text costs no
#: more than that, and less than the hashes it would meet others on.
DIRECT_PAIRS = 32


def _pieces(threshold: float, longer: bool):
    """SQL: hashes on which the text `t` meets texts that are longer (or shorter).

    Texts of m <= n characters at the threshold differ by d = (1 - threshold) (m + n)
    insertions and deletions at most.  Cut into d + 1 pieces, the shorter one has a piece i that
    none of them touches, with i of them before it and d - i behind it at most; so the longer
    one holds the piece, moved by no more than that.
    """
    rest = f"(2 - {threshold!r}D) / {threshold!r}D"
    own, cut = "length(t)", "cast({} as int)"
    low = cut.format(f"ceil({own} / ({rest}) - 1e-9)")
    high = cut.format(f"least({PIECE_LENGTH}, floor({own} * {rest} + 1e-9))")
    m, n = ("o", own) if longer else (own, "o")
    edits = cut.format(f"floor((1 - {threshold!r}D) * ({m} + {n}) + 1e-9)")
    others = f"sequence({low}, {own})" if longer else f"sequence({own}, greatest({own}, {high}))"
    begin, end = f"((i * {m}) div (d + 1))", f"(((i + 1) * {m}) div (d + 1))"

    def named(at):
        return f"xxhash64({m}, {n}, i, substring(t, {at} + 1, cast({end} - {begin} as int)))"
    if longer:
        first = f"greatest({begin} - i, {begin} + {n} - {m} - (d - i), 0)"
        last = f"least({begin} + i, {begin} + {n} - {m} + (d - i), {n} - ({end} - {begin}))"
        one = (f"if({first} <= {last}, transform(sequence(cast({first} as int), cast({last} as int)), "
               f"s -> {named('s')}), array())")
    else:
        one = f"array({named(f'cast({begin} as int)')})"
    # The parity of insertions and deletions is that of m + n.
    edits = f"({edits} - pmod({edits} + {m} + {n}, 2))"
    return (f"flatten(transform({others}, o -> flatten(transform(array({edits}), "
            f"d -> flatten(transform(sequence(0, d), i -> {one}))))))")


def _by_pieces(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs of different texts up to PIECE_LENGTH that may reach the threshold."""
    def side(df, longer):
        short = df.filter(F.length("t").between(1, PIECE_LENGTH))
        return short.select(*keys, "t", F.explode(F.array_distinct(F.expr(
            _pieces(threshold, longer)))).alias("_h"))

    def met(short, long, names, longer_only):
        # One text becomes hundreds of rows here, which Spark's estimate of its size leaves out.
        pairs = side(short, False).withColumnRenamed("t", names[0]).hint("merge").join(
            side(long, True).withColumnRenamed("t", names[1]), [*keys, "_h"])
        gap = F.length(names[1]) - F.length(names[0])
        return pairs.filter((gap > 0) if longer_only else F.col(names[0]) != F.col(names[1]))
    cols = [*keys, "left_text", "right_text"]
    return met(a, b, ("left_text", "right_text"), False).select(cols).unionByName(
        met(b, a, ("right_text", "left_text"), True).select(cols))


def _by_rare_characters(a: DataFrame, b: DataFrame, keys: list[str], threshold: float,
                        above: int) -> DataFrame:
    """Pairs of different texts, one longer than `above`, that may reach the threshold.

    Characters (numbered per repetition) of two such texts overlap in at least threshold / 2 of
    their total, so with each text's characters ordered from rare to common the first few of
    one hit the first few of the other."""
    ratio = threshold / (2 - threshold)
    least = above * ratio

    def numbered(df):
        sized = df.filter(F.length("t") > least).withColumn("_c", F.expr(
            "array_sort(filter(split(t, ''), c -> c <> ''))"))
        # In sorted order a character's number is its place after the first like it.
        return sized.select(*keys, "t", F.size("_c").alias("_n"), F.expr(
            "transform(_c, (c, i) -> concat(c, '#', i + 1 - array_position(_c, c)))")
            .alias("_bag"))
    left, right = numbered(a), numbered(b)
    rarity = left.select(F.explode("_bag").alias("_t")).unionByName(
        right.select(F.explode("_bag").alias("_t"))).groupBy("_t").count()

    def prefix(df, name):
        tokens = df.select(*keys, "t", "_n", F.explode("_bag").alias("_t")).join(rarity, "_t")
        keep = F.col("_n") - F.ceil(F.lit(ratio) * F.col("_n") - 1e-9) + 1
        return tokens.groupBy(*keys, "t").agg(
            F.array_sort(F.collect_list(F.struct("count", "_t"))).alias("_o"),
            F.first(keep).cast("int").alias("_k")).select(
            *keys, F.col("t").alias(name), F.explode(F.slice(
                F.transform("_o", lambda s: s["_t"]), F.lit(1), F.col("_k"))).alias("_t"))
    pairs = prefix(left, "left_text").hint("merge").join(
        prefix(right, "right_text"), [*keys, "_t"])
    m, n = F.length("left_text"), F.length("right_text")
    return pairs.filter((2 * F.least(m, n) >= threshold * (m + n) - 1e-9)
                        & (F.greatest(m, n) > above)
                        & (F.col("left_text") != F.col("right_text"))).select(
        *keys, "left_text", "right_text")


def similar_texts(left: DataFrame, right: DataFrame, keys: list[str],
                  threshold: float) -> DataFrame:
    """(keys, left_text, right_text, similarity) with similarity >= threshold.

    ``left`` and ``right``: keys + text.  Works on distinct texts.  Keys of few texts compare
    them directly; those of many never compare all pairs: equal texts are joined; short ones
    meet on pieces that their few differences leave whole, longer ones (and all at a low
    threshold) on rare characters.  The exact ratio runs on the pairs that met.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def distinct(df):
        # Dealt out anew: few bytes make much work below.
        return cut_lineage(df.select(*keys, F.trim(F.lower("text")).alias("t")).distinct()
                           .repartition(parts, *keys, "t"))
    a, b = distinct(left), distinct(right)
    same = a.join(b, [*keys, "t"]).select(
        *keys, F.col("t").alias("left_text"), F.col("t").alias("right_text"),
        F.lit(1.0).alias("similarity"))
    texts = a.groupBy(*keys).agg(F.count("*").alias("_a")).join(
        b.groupBy(*keys).agg(F.count("*").alias("_b")), keys)
    many = cut_lineage(texts.filter(F.col("_a") * F.col("_b") > DIRECT_PAIRS * (
        F.col("_a") + F.col("_b"))).select(*keys))
    if many.isEmpty():
        pairs = _all_pairs(a, b, keys, threshold, parts)
    else:
        pairs = _all_pairs(a.join(many, keys, "left_anti"), b, keys, threshold, parts).unionByName(
            _met_pairs(a.join(many, keys, "left_semi"), b.join(many, keys, "left_semi"), keys,
                       threshold).distinct())
    scored = pairs.withColumn("similarity", content_similarity("left_text", "right_text"))
    return same.unionByName(scored.filter(F.col("similarity") >= threshold))


def _all_pairs(a: DataFrame, b: DataFrame, keys: list[str], threshold: float,
               parts: int) -> DataFrame:
    """Pairs of different texts of a key whose lengths allow the threshold."""
    m, n = F.length("left_text"), F.length("right_text")
    return (a.withColumnRenamed("t", "left_text").repartition(parts, *keys).hint("merge")
            .join(b.withColumnRenamed("t", "right_text").repartition(parts, *keys), keys)
            .filter((2 * F.least(m, n) >= threshold * (m + n) - 1e-9)
                    & (F.col("left_text") != F.col("right_text")))
            .select(*keys, "left_text", "right_text"))


def _met_pairs(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs of different texts that met on pieces or on rare characters."""
    above = PIECE_LENGTH if threshold >= PIECE_THRESHOLD else 0
    long = F.length("t") > above
    pairs = a.select(*keys, F.col("t").alias("left_text"), F.col("t").alias("right_text")).limit(0)
    if above:
        pairs = _by_pieces(a, b, keys, threshold)
    if not a.filter(long).unionByName(b.filter(long)).isEmpty():
        pairs = pairs.unionByName(_by_rare_characters(a, b, keys, threshold, above))
    return pairs


def near_duplicates(candidates: DataFrame, items: DataFrame,
                    threshold: float = 0.9) -> DataFrame:
    """For each candidate the oldest active item of its type with a similar content.

    Both need user_id, type and content; items also item_id and started_seq."""
    keys = ["user_id", "type"]
    pairs = similar_texts(candidates.select(*keys, F.col("content").alias("text")),
                          items.select(*keys, F.col("content").alias("text")), keys, threshold)
    known = items.withColumn("right_text", F.trim(F.lower("content")))
    order = F.struct("started_seq", "item_id")
    best = pairs.join(known.select(*keys, "right_text", "item_id", "started_seq"),
                      [*keys, "right_text"]).groupBy(*keys, "left_text").agg(
        F.min_by("item_id", order).alias("duplicate_of"),
        F.min_by("similarity", order).alias("similarity"))
    return candidates.withColumn("left_text", F.trim(F.lower("content"))).join(
        best, [*keys, "left_text"], "left").drop("left_text")


def information_gain(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Adds information_gain: 0.85 with nothing of the type known, 0.05 / 0.25 / 0.8 for the
    closest known content at >= 0.92, >= 0.75, below."""
    keys = ["user_id", "type"]
    pairs = similar_texts(candidates.select(*keys, F.col("content").alias("text")),
                          items.select(*keys, F.col("content").alias("text")), keys, 0.75)
    closest = pairs.groupBy(*keys, "left_text").agg(F.max("similarity").alias("_s"))
    known = items.select(*keys).distinct().withColumn("_known", F.lit(True))
    rows = (candidates.withColumn("left_text", F.trim(F.lower("content")))
            .join(known, keys, "left").join(closest, [*keys, "left_text"], "left"))
    gain = (F.when(F.col("_known").isNull(), 0.85).when(F.col("_s") >= 0.92, 0.05)
            .when(F.col("_s") >= 0.75, 0.25).otherwise(0.8))
    return rows.withColumn("information_gain", gain).drop("left_text", "_known", "_s")
