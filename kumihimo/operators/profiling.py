"""Descriptive statistics of tables, and differences between a train and a test table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kumihimo.functions.expr import ratio


def overview(df: DataFrame, id_column: str, year: Column) -> DataFrame:
    """Rows, rows beyond the first of their id, ids, missing ids, first and last year."""
    per = df.agg(F.count("*").alias("rows"), F.count_distinct(id_column).alias("unique_ids"), F.count_if(F.col(id_column).isNull()).alias("missing_ids"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return per.withColumn("repeated_rows", F.col("rows") - F.col("missing_ids") - F.col("unique_ids"))


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, missing_rate: one scan for all columns."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("missing_rate")) for c in columns])).alias("x")).select("x.*")


def missing_profile(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing rate of each column in both tables, the greater one and their gap."""
    a = missing_rates(train, columns).withColumnRenamed("missing_rate", "train_rate")
    b = missing_rates(test, columns).withColumnRenamed("missing_rate", "test_rate")
    return a.join(b, "column_name").withColumn("max_rate", F.greatest("train_rate", "test_rate")).withColumn("abs_gap", F.abs(F.col("train_rate") - F.col("test_rate")))


def describe(df: DataFrame, columns: dict[str, Column], percentiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Count, mean, deviation, extremes, exact percentiles and missing rate of each column."""
    aggs = []
    for i, c in enumerate(columns.values()):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.percentile(c, list(percentiles)).alias(f"p{i}")]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("column_name"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
            *[F.col(f"p{i}")[j].alias(f"p{round(q * 100):02d}") for j, q in enumerate(percentiles)], F.col(f"hi{i}").alias("max"),
            ratio(F.col("n") - F.col(f"n{i}"), F.col("n")).alias("missing_rate"),
        ) for i, name in enumerate(columns)
    ])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def spearman(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """column_a, column_b, rho for every pair, over rows that have both values.

    Ranks come from counts by distinct value, not from one window over the rows. A
    pair with a constant column has a NULL rho.
    """
    from itertools import combinations

    from kumihimo.functions.expr import running_total

    values = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    parts = []
    for a, b in combinations(columns, 2):
        cells = values.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
        for x in (a, b):
            counts = cells.groupBy(x).agg(F.sum("n").alias("m"))
            ranks = running_total(counts, x, "m", "upto").select(x, (F.col("upto") - (F.col("m") - 1) / 2).alias(f"r_{x}"))
            cells = cells.join(ranks, x)
        u, v, n = F.col(f"r_{a}"), F.col(f"r_{b}"), F.col("n")
        sums = cells.agg(F.sum(n).alias("n"), F.sum(n * u).alias("u"), F.sum(n * v).alias("v"), F.sum(n * u * u).alias("uu"), F.sum(n * v * v).alias("vv"), F.sum(n * u * v).alias("uv"))
        top = F.col("n") * F.col("uv") - F.col("u") * F.col("v")
        below = F.sqrt((F.col("n") * F.col("uu") - F.col("u") * F.col("u")) * (F.col("n") * F.col("vv") - F.col("v") * F.col("v")))
        parts.append(sums.select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), ratio(top, below).alias("rho")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ks_statistic(train: DataFrame, test: DataFrame, column: Column, name: str) -> DataFrame:
    """Greatest distance between the two distributions of a column: column_name, statistic, sizes."""
    from kumihimo.functions.expr import running_total

    both = train.select(column.cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(column.cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m")).first()
    n, m = sizes["n"] or 0, sizes["m"] or 0
    upto = running_total(counts, "v", ["a", "b"], ["ca", "cb"])
    distance = F.abs(ratio(F.col("ca"), F.lit(n)) - ratio(F.col("cb"), F.lit(m)))
    return upto.agg(F.lit(name).alias("column_name"), F.max(distance).alias("ks_statistic"), F.lit(n).cast("long").alias("n_train"), F.lit(m).cast("long").alias("n_test"))


def total_variation(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Half the summed difference of the two tables' shares of values; a null is a value."""
    parts = None
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")).alias("value")
        both = train.select(value, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(value, F.lit(0).alias("a"), F.lit(1).alias("b")))
        counts = both.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        whole = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m")).first()
        distance = F.sum(F.abs(ratio(F.col("a"), F.lit(whole["n"])) - ratio(F.col("b"), F.lit(whole["m"])))) / 2
        part = counts.agg(F.lit(c).alias("column_name"), distance.alias("tv_distance"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("new_values"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def category_target_rate(df: DataFrame, category: str, target: str, top: int = 15, least: int = 20) -> DataFrame:
    """Share and target rate of the most frequent categories that have enough rows."""
    value = F.coalesce(F.col(category), F.lit("<MISSING>")).alias(category)
    per = df.groupBy(value).agg(F.count("*").alias("n"), F.avg(target).alias("target_rate"))
    total = df.count() or 1
    return per.withColumn("share", F.col("n") / F.lit(total)).orderBy(F.desc("n"), category).limit(top).where(F.col("n") >= least)


def text_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Empty rate and length median, 95th percentile and maximum of each text column."""
    aggs = []
    for i, c in enumerate(columns):
        n = F.length(F.coalesce(F.col(c), F.lit("")))
        aggs += [F.avg((F.trim(F.coalesce(F.col(c), F.lit(""))) == "").cast("int")).alias(f"e{i}"), F.percentile(n, [0.5, 0.95]).alias(f"p{i}"), F.max(n).alias(f"x{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"e{i}").alias("empty_rate"), F.col(f"p{i}")[0].alias("median_length"), F.col(f"p{i}")[1].alias("p95_length"), F.col(f"x{i}").alias("max_length")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def name_overlap(train: DataFrame, test: DataFrame, name: str, target: str) -> DataFrame:
    """One row: distinct and repeated names, test rows with a name seen in train, conflicting names."""
    per = train.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), F.count_distinct(target).alias("k"))
    a = per.agg(F.count("*").alias("train_names"), F.count_if(F.col("n") > 1).alias("repeated_names"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_with_repeated_names"), F.count_if(F.col("k") > 1).alias("conflicting_names"))
    seen = test.join(per.select(name, F.lit(1).alias("hit")), name, "left")
    b = seen.agg(F.count("*").alias("test_rows"), F.count("hit").alias("test_rows_seen"), F.count_distinct(F.when(F.col("hit").isNotNull(), F.col(name))).alias("shared_names"))
    counted = a.first()
    return b.select(*[F.lit(counted[c]).cast("long").alias(c) for c in a.columns], *b.columns)


def frequency_of_frequency(df: DataFrame, column: str) -> DataFrame:
    """How many values occur how often."""
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("occurrences"))
    return per.groupBy("occurrences").agg(F.count("*").alias("n_values"))


def by_year(df: DataFrame, year: Column, target: str) -> DataFrame:
    return df.groupBy(year.alias("year")).agg(F.count("*").alias("n"), F.avg(target).alias("target_rate"), F.sum(F.col(target).cast("long")).alias("positives"))


def value_shares(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.withColumn("share", F.col("n") / F.lit(total))


def column_kinds(df: DataFrame, most_values: int = 100) -> DataFrame:
    """column_name, kind: numeric, category (few distinct values) or text, from one scan."""
    kinds = {c: ("numeric" if k in ("int", "bigint", "double", "float", "tinyint", "smallint") else "time" if k.startswith("timestamp") else "string") for c, k in df.dtypes}
    one = df.agg(*[F.count_distinct(c).alias(c) for c, k in kinds.items() if k == "string"])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"`{c}`") <= most_values, "category").otherwise("text").alias("kind") if k == "string" else F.lit(k).alias("kind")) for c, k in kinds.items()])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def sample_rows(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a hash of their id: the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.col(id_column), F.lit(seed)), id_column).limit(n)


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def ks_p_value(statistic: float, n1: int, n2: int) -> float:
    """Two-sided p-value of a two-sample KS statistic by its limit distribution; 1 without rows."""
    if not n1 or not n2 or statistic <= 0:
        return 1.0
    x = statistic * (n1 * n2 / (n1 + n2)) ** 0.5
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
