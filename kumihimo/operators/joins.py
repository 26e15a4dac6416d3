"""Joins that are checked before they are used, and checks of schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, present: Sequence[str] = (), reserved: Sequence[str] = ()) -> None:
    """Raises unless ``df`` has the columns ``present`` and none of ``reserved``."""
    missing, taken = [c for c in present if c not in df.columns], [c for c in reserved if c in df.columns]
    if missing or taken:
        raise ValueError(f"columns missing: {missing}, columns whose names are taken: {taken}")


def repeated_keys(df: DataFrame, on: Sequence[str]) -> int:
    """Number of keys that several rows have."""
    return df.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").count()


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", kind: str = "one_to_one", complete: bool = False) -> DataFrame:
    """A join of ``kind`` one_to_one or many_to_one; ValueError where a key is repeated on a side of one.

    With ``complete`` a key on one side only is an error too, and the counts are in its text.
    Null keys match nothing, so they are on one side only.
    """
    if kind not in ("one_to_one", "many_to_one"):
        raise ValueError("kind must be one_to_one or many_to_one")
    sides = {"right": right} | ({"left": left} if kind == "one_to_one" else {})
    for name, df in sides.items():
        if n := repeated_keys(df, on):
            raise ValueError(f"{n} keys are repeated on the {name} side")
    if complete:
        keys = left.select(*on).distinct().withColumn("_l", F.lit(1)).join(right.select(*on).distinct().withColumn("_r", F.lit(1)), list(on), "full_outer")
        row = keys.agg(F.count_if(F.col("_r").isNull()).alias("l"), F.count_if(F.col("_l").isNull()).alias("r")).first()
        if row["l"] or row["r"]:
            raise ValueError(f"source_only={row['l']}, feature_only={row['r']}")
    return left.join(right, list(on), how)


def whole_years(df: DataFrame, c: str, out: str = "year") -> DataFrame:
    """``df`` with the column as whole years, null where it isn't a number; ValueError for a fraction."""
    value = F.col(c).try_cast("double")
    if df.where(F.abs(value - F.round(value)) > 1e-5 + 1e-8 * F.abs(F.round(value))).limit(1).count():
        raise ValueError(f"{c} holds fractions of a year")
    return df.withColumn(out, F.round(value).cast("int"))


def from_year(c: str, least: int) -> Column:
    """Whether a column, of any writing of a number, is ``least`` or later; false for others."""
    return F.coalesce(F.col(c).try_cast("double") >= least, F.lit(False))
