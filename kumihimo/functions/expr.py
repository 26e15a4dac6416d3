"""Column expressions: safe numbers, ranks with ties, concentration, ranking metrics.

Everything here is a built-in expression or window, so it stays in generated code. NaN
never leaves an expression: it becomes NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def number(c: Column | str) -> Column:
    """A text or number as double; NULL where it isn't one, or is NaN."""
    value = F.col(c) if isinstance(c, str) else c
    value = value.try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    top = F.col(a) if isinstance(a, str) else a
    bottom = F.col(b) if isinstance(b, str) else b
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def average_rank(value: Column | str, partition: Sequence[str] = ()) -> Column:
    """Rank from 1 ascending, ties sharing the mean of their places; NULL values rank last."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*partition).orderBy(v)) + (F.count("*").over(Window.partitionBy(*partition, v)) - 1) / 2


def percent_rank_of(value: Column | str, valid: Column, partition: Sequence[str] = ()) -> Column:
    """Average rank among the valid rows of a partition, divided by their number.

    Rows that aren't valid have NULL. The windows are for marts and partitions of bounded
    size; for a column of all rows use ``global_percent_rank``.
    """
    v = F.col(value) if isinstance(value, str) else value
    return F.when(valid, average_rank(v, [*partition, valid]) / F.count("*").over(Window.partitionBy(*partition, valid)))


def global_percent_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the percentile rank of a column over all rows, without one window over them.

    Counts by distinct value are summed along the values' order and joined back, so only
    distinct values are sorted; the sort is by range partitions of the values and a small
    table of their totals, never a single task of rows. NULL values have a NULL rank. The
    distinct values may be as many as the rows, so no side of theirs is gathered at the driver
    for a broadcast, however small it is once compressed.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running_total(counts, value, "_n", "_upto", by)
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_all")) if by else None
    placed = placed.withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2)
    if by:
        placed = placed.join(whole, list(by))
    else:
        total = counts.agg(F.sum("_n")).first()[0] or 1
        placed = placed.withColumn("_all", F.lit(total))
    ranks = placed.select(*by, value, (F.col("_rank") / F.col("_all")).alias(out))
    return df.join(ranks.hint("merge"), [*by, value], "left")


def range_of(value: Column, edges: Sequence[float], base: int = 0) -> Column:
    """How many of the ascending ``edges`` lie below a value, by a tree of comparisons."""
    if not edges:
        return F.lit(base)
    mid = len(edges) // 2
    return F.when(value > edges[mid], range_of(value, edges[mid + 1 :], base + mid + 1)).otherwise(range_of(value, edges[:mid], base))


def running_total(df: DataFrame, order: str, amount: str | Sequence[str], out: str | Sequence[str], by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """``df`` (one row per value of ``order``) with running totals of one or more amounts.

    Values are cut into ranges at approximate quantiles; totals of the ranges, of which there
    are ``buckets``, are summed first, then each range's rows on their own.
    """
    amounts = [amount] if isinstance(amount, str) else list(amount)
    outs = [out] if isinstance(out, str) else list(out)
    numeric = F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(numeric, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()["q"] or []
    ranged = df.withColumn("_range", range_of(numeric, sorted(set(cuts))))
    per = ranged.groupBy(*by, "_range").agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{a}").over(before), F.lit(0)).alias(f"_offset_{a}") for a in amounts])
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    # the window needs the rows in the order of these keys anyway
    joined = ranged.join(F.broadcast(offsets), "_range") if not by else ranged.hint("merge").join(offsets, [*by, "_range"])
    totals = joined.withColumns({o: F.col(f"_offset_{a}") + F.sum(a).over(inside) for a, o in zip(amounts, outs, strict=True)})
    return totals.drop("_range", *[f"_offset_{a}" for a in amounts])


def auc_by(df: DataFrame, score: str, target: str, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC per group: keys, n, n_positive, auc; NULL where a group has one class.

    From counts by distinct score, so ties count half and the order of rows doesn't matter.
    Rows with a NULL score or target are left out.
    """
    known = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    counts = known.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.sum(F.col(target).cast("long")).alias("_pos"))
    counts = running_total(counts, score, "_n", "_upto", keys)
    counts = counts.withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2)
    per = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("n_positive"), F.sum(F.col("_pos") * F.col("_rank")).alias("_ranks"))
    negatives = F.col("n") - F.col("n_positive")
    auc = F.try_divide(F.col("_ranks") - F.col("n_positive") * (F.col("n_positive") + 1) / 2, (F.col("n_positive") * negatives).cast("double"))
    return per.select(*keys, "n", "n_positive", auc.alias("auc"))


def log_loss_term(score: Column | str, target: Column | str, clip: float = 1e-7) -> Column:
    """Negative log-likelihood of one row, the score clipped."""
    p = F.col(score) if isinstance(score, str) else score
    y = F.col(target) if isinstance(target, str) else target
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))
