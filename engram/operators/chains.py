"""Running values along ordered chains, whatever the size of one chain.

Ordinary chains use plain windows: one shuffle and one sort.  A window over a hot chain
would send all its rows to one task, so chains above a row threshold are cut into chunks
of the order column: windows run per chunk, and one summary row per chunk carries the
running value into the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import cut_lineage

HOT_CHAIN_ROWS = 1_000_000
CHUNK = 1 << 18


class Whole:
    """Chains small enough for a window each."""

    def __init__(self, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order

    def window(self, *more: str):
        return Window.partitionBy(*self.keys, *more).orderBy(*self.order)

    def previous(self, df: DataFrame, value: str, name: str) -> DataFrame:
        """Adds the value of the row before."""
        return df.withColumn(name, F.lag(value).over(self.window()))

    def running(self, df: DataFrame, sums: dict[str, Column] | None = None,
                lasts: dict[str, Column] | None = None) -> DataFrame:
        """Adds running sums and running last non-null values, current row included."""
        upto = self.window().rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", *[F.sum(e).over(upto).alias(n) for n, e in (sums or {}).items()],
            *[F.last(e, ignorenulls=True).over(upto).alias(n)
              for n, e in (lasts or {}).items()])

    def firsts(self, df: DataFrame, group: str, firsts: dict[str, Column]) -> DataFrame:
        """Adds the first non-null value so far within the group of a chain."""
        upto = self.window(group).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.first(e, ignorenulls=True).over(upto).alias(n)
                                for n, e in firsts.items()])


class Split(Whole):
    """Hot chains, cut into chunks of the first order column."""

    def __init__(self, keys: list[str], order: list[str], chunk: int = CHUNK):
        super().__init__(keys, order)
        self.chunk = chunk

    def _cut(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df.withColumn("_chunk", F.floor(F.col(self.order[0]) / self.chunk)))

    def previous(self, df, value, name):
        df = self._cut(df)
        lasts = df.groupBy(*self.keys, "_chunk").agg(
            F.max_by(value, F.struct(*self.order)).alias("_v"))
        base = lasts.select(*self.keys, "_chunk", F.lag("_v").over(
            Window.partitionBy(*self.keys).orderBy("_chunk")).alias("_base"))
        local = df.withColumn("_lag", F.lag(value).over(self.window("_chunk")))
        return local.join(base, [*self.keys, "_chunk"]).withColumn(
            name, F.coalesce("_lag", "_base")).drop("_lag", "_base", "_chunk")

    def running(self, df, sums=None, lasts=None):
        sums, lasts = sums or {}, lasts or {}
        columns = df.columns
        df = self._cut(df.select(
            "*", *[e.alias(f"_in_{n}") for n, e in {**sums, **lasts}.items()]))
        place = F.struct(*self.order)
        totals = df.groupBy(*self.keys, "_chunk").agg(
            *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
            *[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place))
              .alias(f"_tot_{n}") for n in lasts])
        earlier = (Window.partitionBy(*self.keys).orderBy("_chunk")
                   .rowsBetween(Window.unboundedPreceding, -1))
        base = totals.select(
            *self.keys, "_chunk",
            *[F.sum(f"_tot_{n}").over(earlier).alias(f"_base_{n}") for n in sums],
            *[F.last(f"_tot_{n}", ignorenulls=True).over(earlier).alias(f"_base_{n}")
              for n in lasts])
        upto = self.window("_chunk").rowsBetween(Window.unboundedPreceding, 0)
        local = df.select(
            "*", *[F.sum(f"_in_{n}").over(upto).alias(f"_run_{n}") for n in sums],
            *[F.last(f"_in_{n}", ignorenulls=True).over(upto).alias(f"_run_{n}")
              for n in lasts])
        return local.join(base, [*self.keys, "_chunk"]).select(
            *columns,
            *[(F.col(f"_run_{n}") + F.coalesce(f"_base_{n}", F.lit(0))).alias(n) for n in sums],
            *[F.coalesce(f"_run_{n}", f"_base_{n}").alias(n) for n in lasts])

    def firsts(self, df, group, firsts):
        columns = df.columns
        df = cut_lineage(df.select("*", *[e.alias(f"_in_{n}") for n, e in firsts.items()]))
        place = F.struct(*self.order)

        def present(n):
            return F.when(F.col(f"_in_{n}").isNotNull(), place)
        openings = df.groupBy(*self.keys, group).agg(
            *[F.min(present(n)).alias(f"_at_{n}") for n in firsts],
            *[F.min_by(f"_in_{n}", present(n)).alias(f"_is_{n}") for n in firsts])
        return df.join(openings, [*self.keys, group]).select(
            *columns, *[F.when(F.col(f"_at_{n}") <= place, F.col(f"_is_{n}")).alias(n)
                        for n in firsts])


def hot_chains(df: DataFrame, keys: list[str], hot_rows: int = HOT_CHAIN_ROWS) -> DataFrame | None:
    """Chains of more than ``hot_rows`` rows (rows / hot_rows at most), or None.

    One stored count, taken once for all walks over the same chains."""
    hot = cut_lineage(df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys))
    return None if hot.isEmpty() else hot


def along(df: DataFrame, keys: list[str], order: list[str],
          walk: Callable[[DataFrame, Whole], DataFrame], hot: DataFrame | None = None,
          chunk: int = CHUNK) -> DataFrame:
    """Runs ``walk`` over ordinary chains whole and over the ``hot`` ones in chunks."""
    if hot is None:
        return walk(df, Whole(keys, order))
    return walk(df.join(hot, keys, "left_anti"), Whole(keys, order)).unionByName(
        walk(df.join(hot, keys, "left_semi"), Split(keys, order, chunk)))
