"""Column-level data quality: profiles, wrong values, and loads unlike the others.

Constraints are declared per column and compiled into one scan that counts, for each load
and column, how many cells are null, carry the agreed marker, are wrong, or fall into each
bucket of the valid values, and that names the wrong cells. These counts are the state: states
of disjoint loads or partitions merge by addition, so a new load is scanned once and the
history kept. The same holds for the profile of all columns, whose distinct counts are sketches.
A load is judged against control limits taken from all loads of the history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kumihimo.sources.shared import written


@dataclass(frozen=True)
class Constraint:
    """What a cell of ``column`` may hold; the conditions are SQL over the table's columns.

    ``wrong`` is judged for non-null cells only; ``marker`` is an agreed stand-in for a
    missing value; ``bucket`` places a valid cell in a class of a bounded number.
    """

    column: str
    wrong: str
    bucket: str
    marker: str = "false"

    def cell_class(self) -> Column:
        return F.expr(
            f"CASE WHEN `{self.column}` IS NULL THEN 'null' WHEN {self.marker} THEN 'marker' "
            f"WHEN {self.wrong} THEN 'wrong' ELSE concat('v:', {self.bucket}) END"
        )


def year_constraint(column: str, low: int = 1950, high: int = 2030, marker: str = "-1") -> Constraint:
    """Four ASCII digits from ``low`` to ``high``, or the marker; bucketed by the year."""
    plain = f"regexp_like(`{column}`, '^[0-9]{{4}}\\\\z') AND `{column}` BETWEEN '{low}' AND '{high}'"
    return Constraint(column, f"NOT ({plain})", f"`{column}`", f"`{column}` = '{marker}'")


def amount_constraint(column: str, high: float = 1_000_000.0) -> Constraint:
    """Finite and from 0 to ``high``; bucketed by half octaves."""
    wrong = f"(isnan(`{column}`) OR `{column}` < 0 OR `{column}` > {high})"
    bucket = f"CASE WHEN `{column}` = 0 THEN 'zero' ELSE cast(cast(floor(2 * log2(`{column}`)) AS int) AS string) END"
    return Constraint(column, wrong, bucket)


def member_constraint(column: str, known: str) -> Constraint:
    """A member of a list; ``known`` is the column that is non-null for members."""
    return Constraint(column, f"`{known}` IS NULL", f"`{column}`")


def with_known(df: DataFrame, column: str, dimension: DataFrame, name: str, flag: str) -> DataFrame:
    """``df`` with ``flag`` non-null where ``column`` is one of the dimension's names."""
    members = dimension.where(F.col(name).isNotNull()).select(F.col(name).alias(flag)).distinct()
    return df.join(members, df[column] == members[flag], "left")


def cell_states(df: DataFrame, id_column: str | None, load_column: str, constraints: Sequence[Constraint]) -> DataFrame:
    """load, column_name, cell_class, ref_id, n: one scan for the wrong cells and all counts.

    ``ref_id`` is the row's id for a wrong cell, and null for the others (for all, without an id
    column), which are counted together; counts are combined before they are shuffled. An empty table has no states.
    """
    cells = F.array(*[F.struct(F.lit(c.column).alias("column_name"), c.cell_class().alias("cell_class")) for c in constraints])
    flat = df.select(F.col(load_column).alias("load"), (F.col(id_column) if id_column else F.lit(None).cast("long")).alias("id"), F.explode(cells).alias("cell")).select("load", "id", "cell.*")
    ref = F.when(F.col("cell_class") == "wrong", F.col("id")).alias("ref_id")
    return flat.groupBy("load", "column_name", "cell_class", ref).agg(F.count("*").alias("n"))


def wrong_cells(cells: DataFrame, id_column: str) -> DataFrame:
    """column_name and id of every non-null cell that is wrong, once for each row of that id."""
    return cells.where("ref_id IS NOT NULL").select("column_name", F.explode(F.array_repeat("ref_id", F.col("n").cast("int"))).alias(id_column))


def load_states(cells: DataFrame) -> DataFrame:
    """load, column_name, cell_class, n: the mergeable state of each load.

    Rows without a load are no load's.
    """
    return merge_states(cells.where("load IS NOT NULL").select("load", "column_name", "cell_class", "n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state from those of any partitions of the rows."""
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy("load", "column_name", "cell_class").agg(F.sum("n").alias("n"))


def load_metrics(states: DataFrame) -> DataFrame:
    """load, column_name, n_rows, metric, value: three rates and the spread of each load.

    The spread is the share of a load's rows whose valid value would have to change for its
    distribution to become the typical one, which takes each bucket's median share.
    Works on states, of which there are loads x columns x buckets, whatever the rows.
    """
    per = Window.partitionBy("load", "column_name")
    cells = states.withColumn("n_rows", F.sum("n").over(per))
    totals = cells.groupBy("load", "column_name").agg(
        F.first("n_rows").alias("n_rows"),
        *[F.sum(F.when(F.col("cell_class") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ("null", "marker", "wrong")],
    )
    totals = totals.withColumn("n_valid", F.expr("n_rows - n_null - n_marker - n_wrong"))
    buckets = cells.where(F.col("cell_class").startswith("v:")).select("column_name", "cell_class").distinct()
    grid = totals.where("n_valid > 0").select("load", "column_name", "n_rows", "n_valid").join(buckets, "column_name")
    grid = grid.join(cells.select("load", "column_name", "cell_class", "n"), ["load", "column_name", "cell_class"], "left")
    grid = grid.withColumn("share", F.coalesce("n", F.lit(0)) / F.col("n_valid"))
    typical = grid.groupBy("column_name", "cell_class").agg(F.median("share").alias("usual"))
    whole = typical.groupBy("column_name").agg(F.sum("usual").alias("whole"))
    typical = typical.join(whole, "column_name").select("column_name", "cell_class", (F.col("usual") / F.nullif("whole", F.lit(0.0))).alias("usual"))
    spread = (
        grid.join(typical, ["column_name", "cell_class"])
        .groupBy("load", "column_name", "n_rows", "n_valid")
        .agg((F.sum(F.abs(F.col("share") - F.coalesce("usual", F.lit(0.0)))) / 2).alias("distance"))
        .select("load", "column_name", "n_rows", F.lit("spread").alias("metric"), (F.col("distance") * F.col("n_valid") / F.col("n_rows")).alias("value"))
    )
    rates = totals.select(
        "load", "column_name", "n_rows",
        F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), (F.col(f"n_{k}") / F.col("n_rows")).alias("value")) for k in ("null", "marker", "wrong")])).alias("m"),
    ).select("load", "column_name", "n_rows", "m.metric", "m.value")
    return rates.unionByName(spread)


def load_anomalies(states: DataFrame, least: float = 0.1, sigmas: float = 3.0) -> DataFrame:
    """Metrics of loads beyond the control limits: load, column_name, metric, value, usual.

    A metric is out of control where it departs from the median over all loads by ``least``
    of the load's rows or more, and by more than ``sigmas`` robust standard deviations
    (from the median absolute deviation, or the sampling error where that is larger).
    With a single load nothing departs.
    """
    # a row per load, column and metric, read several times
    metrics = written(load_metrics(written(states)))
    usual = metrics.groupBy("column_name", "metric").agg(F.median("value").alias("usual"))
    gaps = metrics.join(usual, ["column_name", "metric"]).withColumn("gap", F.abs(F.col("value") - F.col("usual")))
    width = gaps.groupBy("column_name", "metric").agg((F.median("gap") * 1.4826).alias("sd"))
    sampling = F.sqrt(F.greatest(F.col("usual") * (1 - F.col("usual")), F.lit(0.0)) / F.col("n_rows"))
    judged = gaps.join(width, ["column_name", "metric"])
    beyond = (F.col("gap") >= least) & (F.col("gap") > sigmas * F.greatest("sd", sampling))
    return judged.where(beyond).select("load", "column_name", "metric", "value", "usual")


def profile_states(df: DataFrame, load_column: str | None, columns: Sequence[str]) -> DataFrame:
    """load, n_rows and for each column count, HyperLogLog sketch, least and greatest: mergeable.

    One aggregate scan for all columns, a row for each load (one in all without a load column).
    """
    aggs = [F.count("*").alias("n_rows")]
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        hashable = F.col(c) if isinstance(kind, (T.StringType, T.LongType, T.IntegerType)) else F.col(c).cast("string")
        aggs += [F.count(c).alias(f"n_{i}"), F.hll_sketch_agg(hashable, F.lit(12)).alias(f"d_{i}"), F.min(c).alias(f"lo_{i}"), F.max(c).alias(f"hi_{i}")]
    load = F.col(load_column) if load_column else F.lit(None).cast("string")
    return df.groupBy(load.alias("load")).agg(*aggs)


def profile(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, nulls, distinct values (estimated), least and greatest, from merged states.

    Sketches have 2^12 registers (relative error about 1.6 %); NaN counts as the greatest
    value; texts are compared by code point. No states give a row of zeros and nulls each.
    """
    aggs = [F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")]
    for i, _ in enumerate(columns):
        estimate = F.hll_sketch_estimate(F.hll_union_agg(f"d_{i}"))
        aggs += [F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias(f"n_{i}"), F.coalesce(estimate, F.lit(0)).alias(f"d_{i}"), F.min(f"lo_{i}").cast("string").alias(f"lo_{i}"), F.max(f"hi_{i}").cast("string").alias(f"hi_{i}")]
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col("n_rows"), (F.col("n_rows") - F.col(f"n_{i}")).alias("n_null"),
            F.col(f"d_{i}").alias("n_distinct"), F.col(f"lo_{i}").alias("least"), F.col(f"hi_{i}").alias("greatest"),
        ) for i, c in enumerate(columns)
    ])
    one = states.agg(*aggs)
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("null_rate", F.try_divide("n_null", "n_rows"))


def table_profile(df: DataFrame, id_columns: Sequence[str] = (), load_column: str | None = None) -> DataFrame:
    """``profile`` of all columns but ``id_columns``, by way of the states of each load."""
    columns = [c for c in df.columns if c not in id_columns]
    return profile(profile_states(df, load_column, columns), columns)
