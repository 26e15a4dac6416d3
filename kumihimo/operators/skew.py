"""Values of groups put on their rows, where one group may hold a third of them.

A window gathers each group in one task. That is the cheap way for ordinary groups: one
shuffle of the rows. Groups that a look at a part of the rows shows to be very large are
taken apart instead: their values are aggregated with a map-side combine, and joined back by
broadcast, as there are at most ``MOST`` such groups. Which way a group goes changes the
plan, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: One row in PART is looked at; groups with LEAST of those, at most MOST groups, are large.
PART, LEAST, MOST = 64, 1000, 2000


def large_groups(df: DataFrame, keys: Sequence[str], row: str, part: int = PART, least: int = LEAST) -> DataFrame | None:
    """Keys of the groups that are worth taking apart, None if there are none."""
    looked = df.where(F.pmod(F.xxhash64(row), F.lit(part)) == 0).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = looked.orderBy(F.desc("n"), *keys).limit(MOST).select(*keys).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema) if rows else None


def with_group_values(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], row: str, part: int = PART, least: int = LEAST) -> DataFrame:
    """``df`` with aggregates of each row's group; ``row`` tells rows of a group apart.

    ``df`` is read more than once, so it should be cheap or written. Keys must not be null.
    """
    group = Window.partitionBy(*keys)
    large = large_groups(df, keys, row, part, least)
    if large is None:
        return df.withColumns({n: v.over(group) for n, v in values.items()})
    small = df.join(F.broadcast(large), list(keys), "left_anti").withColumns({n: v.over(group) for n, v in values.items()})
    taken = df.join(F.broadcast(large), list(keys), "left_semi")
    stats = taken.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    return small.unionByName(taken.join(F.broadcast(stats), list(keys)))
