"""Which texts of a key contain which needles, without comparing all pairs.

A text that contains a needle contains the needle's first 1, 2, 4 ... 64 characters, as many
as fit.  Beginnings are met first, one row for each however many needles share it, and tell
which lengths are worth a look at a place.  There the text is hashed at the needle's full
length, so needles with one beginning meet only texts that hold them as a whole.  Of the texts
hashes, places and an id travel, and survivors are verified once.  A key with few needles for its
texts' length compares them directly, which costs less than the hashes of every place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import cut_lineage

SIZES = (64, 32, 16, 8, 4, 2, 1)
#: Characters of a text whose places are looked at in one row: a place costs the same in a
#: long text as in a short one.
BLOCK = 512
#: Pairs for each character of a key's texts up to which they are compared directly.
DIRECT_PAIRS = 16


def text_id(text):
    """128 bits that stand for a text in joins."""
    return F.md5(text)


def _begins(texts: DataFrame, keys: list[str], sizes: DataFrame | None) -> DataFrame:
    """keys, text_id, _size, _place, _begin: the hash of _size characters from every place."""
    some = texts.filter(F.length("text") > 0)
    some = some.join(sizes, keys) if keys else some.withColumn(
        "_sizes", F.array(*[F.lit(n) for n in SIZES]))
    blocks = some.select(*keys, "text_id", "_sizes", F.explode(F.expr(
        f"transform(sequence(0, (length(text) - 1) div {BLOCK}), b -> struct(b * {BLOCK} AS at, "
        f"substring(text, int(b * {BLOCK} + 1), {BLOCK + SIZES[0] - 1}) AS part))")).alias("_b"))
    sized = blocks.select(*keys, "text_id", "_b.*", F.explode("_sizes").alias("_size"))
    sized = sized.filter(F.length("part") >= F.col("_size"))
    return sized.select(*keys, "text_id", "_size", F.explode(F.expr(
        f"transform(sequence(1, least({BLOCK}, length(part) - _size + 1)), i -> struct("
        "at + i AS _place, xxhash64(substring(part, i, _size)) AS _begin))")).alias("_p")
        ).select(*keys, "text_id", "_size", "_p.*")


def meetings(source: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text_id, needle where the hash of a text's part is that of the whole needle.

    ``source``: keys, text, text_id."""
    sized = F.lit(None).cast("int")
    for n in SIZES:
        sized = F.coalesce(sized, F.when(F.length("needle") >= n, n))
    sides = (needles.filter(F.length("needle") > 0).select(*keys, "needle").distinct()
             .withColumn("_length", F.length("needle")).withColumn("_size", sized)
             .withColumn("_whole", F.xxhash64("needle")))
    begins = sides.groupBy(*keys, "_size", F.xxhash64(F.expr("substring(needle, 1, _size)")).alias(
        "_begin")).agg(F.collect_set("_length").alias("_lengths"))
    # At most seven sizes per key, and no text of a key without needles.
    sizes = sides.groupBy(*keys).agg(F.collect_set("_size").alias("_sizes")) if keys else None
    # A text becomes a row for every place and size, which Spark's estimate leaves out.
    places = _begins(source, keys, sizes).hint("merge").join(
        begins, [*keys, "_size", "_begin"]).select(
        *keys, "text_id", "_place", F.explode("_lengths").alias("_length"))
    wholes = places.join(source, [*keys, "text_id"]).filter(
        "_place + _length - 1 <= length(text)").select(
        *keys, "text_id", "_length",
        F.expr("xxhash64(substring(text, int(_place), _length))").alias("_whole")).distinct()
    return wholes.join(sides, [*keys, "_length", "_whole"]).select(*keys, "text_id", "needle")


def containment(texts: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, text, text_id, needle) with ``needle`` inside ``text``.

    ``texts`` has keys + text, ``needles`` keys + needle; null and blank needles match nothing,
    null texts hold nothing, repeated rows count once.  text_id is 128 bits of the text, for
    joins that need not carry it.  Without keys every text meets every needle.
    """
    source = texts.select(*keys, "text").distinct()
    sought = needles.filter(F.length("needle") > 0).select(*keys, "needle").distinct()
    if not keys:
        return _met(source, sought, keys)
    counts = source.groupBy(*keys).agg(
        F.count("*").alias("_texts"), F.sum(F.length("text")).alias("_places")).join(
        sought.groupBy(*keys).agg(F.count("*").alias("_needles")), keys)
    many = cut_lineage(counts.filter(
        F.col("_texts") * F.col("_needles") > DIRECT_PAIRS * F.col("_places")).select(*keys))

    def compared(some):
        return (some.join(sought, keys).filter(F.col("text").contains(F.col("needle")))
                .select(*keys, "text", text_id("text").alias("text_id"), "needle"))
    if many.isEmpty():
        return compared(source)
    return compared(source.join(many, keys, "left_anti")).unionByName(_met(
        source.join(many, keys, "left_semi"), sought.join(many, keys, "left_semi"), keys))


def _met(texts: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """What containment() returns, by hashes of the texts' parts."""
    source = texts.withColumn("text_id", text_id("text"))
    return (meetings(source, needles, keys).join(source, [*keys, "text_id"])
            .filter(F.col("text").contains(F.col("needle")))
            .select(*keys, "text", "text_id", "needle"))
