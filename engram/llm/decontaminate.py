"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks pick some of the tokens of every window and ignore the others, so that a window
with substituted tokens still meets its original.  Test seeds are broadcast in blocks of a
bounded size and met by the seeds of every training text; around each hit the two token
sequences are laid side by side and their equal tokens counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C

#: Token positions that each mask compares.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 5))
#: Further masks for whole items of so many tokens, where the two miss some substitutions.
SHORT_MASKS = {5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)), 6: ((0, 2, 3, 4),),
               **{size: ((0, 1, 2, 3),) for size in (7, 8, 10, 11, 12, 15)}}
#: An overlap counts when a stretch of this many tokens, or the whole shorter test item, has
#: this percentage of equal tokens.
STRETCH, PERCENT = 20, 80
#: Seeds of one broadcast block (about 40 bytes each).
BLOCK_SEEDS = 500_000
WORD_END = "[^0-9a-z\\x{80}-\\x{10FFFF}]+"


def _tokens(df: DataFrame, *keep: str) -> DataFrame:
    """keep, and w: hashes of the lower-cased runs of letters, digits and non-ASCII characters."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), WORD_END, -1), "")
    return (df.select(*keep, words.alias("_words"))
            .select(*keep, F.transform("_words", lambda x: F.xxhash64(x)).alias("w")))


def masks_of(size: int) -> tuple:
    """Masks of an item of `size` tokens; under five no substitution keeps PERCENT of them."""
    return (*MASKS, *SHORT_MASKS.get(size, ())) if size >= 5 else (tuple(range(size)),)


def _seeds(df: DataFrame, masks, *keep: str, first: int = 0) -> DataFrame:
    """A row for every mask (numbered from `first`) and position: keep, w, place, seed."""
    at = df.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("place"))
    picked = [F.when(F.col("place") + (mask[-1] + 1) <= F.size("w"),
                     F.xxhash64(F.lit(n), *[F.col("w")[F.col("place") + j] for j in mask]))
              for n, mask in enumerate(masks, first)]
    return (at.select(*keep, "w", "place", F.explode(F.array(*picked)).alias("seed"))
            .filter("seed is not null"))


def overlaps(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """doc_id, item_id, n_overlaps, first_token, matched: a row for every text and test item that overlap.

    Two aligned sequences overlap when some STRETCH aligned tokens (or all of a shorter item)
    have PERCENT equal ones.  The masks meet every such alignment: stretches of 20 tokens
    with four substitutions, and shorter items, for which there are further masks.
    n_overlaps counts alignments, matched is the largest number of equal tokens in one, and
    first_token the smallest position where one begins.  Null and wordless texts and items
    overlap with nothing; rows that share an id are compared one by one and reported together.
    """
    items = _tokens(tests.select(F.col("item_id").cast("long").alias("item_id"), "text"),
                    "item_id").filter("size(w) > 0").select(
        "item_id", "w", F.xxhash64("item_id", "w").alias("item"))
    items = C.staged(items.distinct(), "test-items")
    # At most STRETCH - 1 numbers.
    short = [r[0] for r in items.filter(F.size("w") < STRETCH)
             .select(F.size("w")).distinct().collect()]
    masks = [*MASKS, *sorted({m for size in short for m in masks_of(size)}.difference(MASKS))]
    seeds = _seeds(items, MASKS, "item")
    for n, mask in enumerate(masks[len(MASKS):], len(MASKS)):
        fit = items.filter(F.size("w").isin([s for s in short if mask in masks_of(s)]))
        seeds = seeds.unionByName(_seeds(fit, [mask], "item", first=n))
    seeds = C.staged(seeds.select("seed", "item", F.col("place").alias("item_place"),
                                  F.size("w").alias("item_size")), "test-seeds")
    blocks = max(1, -(-seeds.count() // BLOCK_SEEDS))

    texts = _tokens(C.texts(docs), "doc_id").filter("size(w) > 0")
    own = _seeds(texts, masks, "doc_id")
    hits = None
    for block in range(blocks):
        part = seeds if blocks == 1 else seeds.filter(
            F.pmod(F.xxhash64("seed", F.lit("block")), F.lit(blocks)) == block)
        shift = F.col("place") - F.col("item_place")
        low = F.greatest(F.lit(0), -shift)
        high = F.least(F.col("item_size"), F.size("w") - shift)
        met = own.join(F.broadcast(part), "seed").select(
            "doc_id", "item", shift.alias("shift"), low.alias("low"),
            F.slice("w", shift + low + 1, high - low).alias("piece"))
        hits = met if hits is None else hits.unionByName(met)
    aligned = hits.groupBy("doc_id", "item", "shift", "low",
                           F.xxhash64("piece").alias("same")).agg(F.first("piece").alias("piece"))
    equal = F.transform("piece", lambda x, i: (x == F.col("w")[i + F.col("low")]).cast("int"))
    length = F.least(F.lit(STRETCH), F.size("w"))
    enough = F.exists(
        F.sequence(F.lit(1), F.size("equal") - length + 1),
        lambda s: F.aggregate(F.slice("equal", s, length), F.lit(0), lambda a, x: a + x) * 100
        >= length * PERCENT)
    return (aligned.join(items, "item")
            .select("doc_id", "item_id", "shift", "low", "w", equal.alias("equal"))
            .filter(F.size("equal") >= length).filter(enough)
            .groupBy("doc_id", "item_id").agg(
                F.count("*").alias("n_overlaps"),
                F.min((F.col("shift") + F.col("low")).cast("long")).alias("first_token"),
                F.max(F.aggregate("equal", F.lit(0), lambda a, x: a + x).cast("long"))
                .alias("matched")))


def drop_contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no test item, with the columns they came with."""
    return C.without(docs, lambda rows: overlaps(rows, tests).select("doc_id").distinct())


def oracle_sql() -> str:
    """The same result in DuckDB, by joins on the picked tokens themselves.

    Written for test items of at least as many tokens as the longest mask spans.
    """
    span = max(mask[-1] for mask in MASKS) + 1
    words = ("list_filter(regexp_split_to_array(lower(coalesce(text, '')), "
             "'[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')")
    picks = " UNION ALL ".join(
        f"SELECT id, p, {n} AS mask, [{', '.join(f'w[p + {j + 1}]' for j in mask)}] AS seed "
        f"FROM {{0}}_at WHERE p + {mask[-1] + 1} <= len(w)" for n, mask in enumerate(MASKS))
    return f"""
    WITH d AS (SELECT doc_id AS id, {words} AS w FROM documents),
    t AS (SELECT item_id AS id, {words} AS w FROM benchmark),
    d_at AS (SELECT id, w, unnest(range(len(w))) AS p FROM d),
    t_at AS (SELECT id, w, unnest(range(len(w))) AS p FROM t WHERE len(w) >= {span}),
    d_seed AS ({picks.format('d')}),
    t_seed AS ({picks.format('t')}),
    hit AS (SELECT DISTINCT a.id AS doc_id, b.id AS item_id, a.p - b.p AS shift
            FROM d_seed a JOIN t_seed b ON a.mask = b.mask AND a.seed = b.seed),
    laid AS (
      SELECT doc_id, item_id, shift, greatest(0, -shift) AS low, d.w AS dw, t.w AS tw,
             least(len(t.w), len(d.w) - shift) AS high, least({STRETCH}, len(t.w)) AS size
      FROM hit JOIN d ON d.id = doc_id JOIN t ON t.id = item_id),
    eq AS (
      SELECT doc_id, item_id, shift + low AS first, size,
             list_transform(range(low, high),
                            lambda i: CASE WHEN dw[shift + i + 1] = tw[i + 1] THEN 1 ELSE 0 END) AS e
      FROM laid WHERE high - low >= size),
    good AS (
      SELECT doc_id, item_id, first, list_sum(e) AS same FROM eq
      WHERE len(list_filter(range(len(e) - size + 1),
                            lambda s: list_sum(e[s + 1:s + size]) * 100 >= size * {PERCENT})) > 0)
    SELECT doc_id, item_id, count(*) AS n_overlaps, min(first)::BIGINT AS first_token,
           max(same)::BIGINT AS matched FROM good GROUP BY doc_id, item_id"""
