"""Labels, expanding-window folds and seen / unseen flags."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kumihimo.functions.expr import auc_by, log_loss_term, number

POSITIVE, NEGATIVE = "該当", "非該当"


def encode_target(c: Column | str, positive: str = POSITIVE, negative: str = NEGATIVE) -> Column:
    """1 or 0 by exact match of the trimmed label, or of 1 / 0 / true / false; else NULL.

    A part of a label is no match: the negative label contains the positive one. A number
    written with decimals is not a label.
    """
    text = F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(text.isin(positive, "1", "True", "true"), 1).when(text.isin(negative, "0", "False", "false"), 0).cast("byte")


def check_labels(df: DataFrame, c: str, positive: str = POSITIVE, negative: str = NEGATIVE) -> None:
    """Raises ValueError with at most ten examples where a label is null or unknown."""
    bad = df.where(encode_target(c, positive, negative).isNull()).select(F.col(c).cast("string").alias("x")).distinct().orderBy("x").limit(10).collect()
    if bad:
        raise ValueError(f"{c} has null or unknown labels: {[r['x'] for r in bad]}")


def plain_year(c: str) -> Column:
    """An integer year; NULL where the text isn't a whole number."""
    value = number(c)
    return F.when(value == F.round(value), value.try_cast("int"))


def eligible(df: DataFrame, year: str, invalid_year: int = -1) -> DataFrame:
    """Rows with a usable year, in ``_year``."""
    return df.withColumn("_year", plain_year(year)).where(F.col("_year").isNotNull() & (F.col("_year") != invalid_year))


def validation_years(df: DataFrame, year: str, n_years: int = 3, invalid_year: int = -1) -> DataFrame:
    """fold, validation_year, is_latest_fold: the latest observed years with earlier rows.

    Gaps between years are allowed; the first observed year has nothing before it and makes
    no fold, and folds are numbered without it. Fewer years than asked for are a warning.
    """
    if isinstance(n_years, bool) or n_years <= 0:
        raise ValueError("at least one validation year is needed")
    years = [r[0] for r in eligible(df, year, invalid_year).select("_year").distinct().orderBy(F.desc("_year")).limit(n_years + 1).collect()]
    if not years:
        raise ValueError(f"no valid years remain in {year!r}")
    if len(years) < n_years:
        warnings.warn(f"only {len(years)} valid year(s) exist", UserWarning, stacklevel=2)
    chosen = sorted(y for y in years[:n_years] if y > years[-1] or len(years) > n_years)
    if not chosen:
        warnings.warn("training data is empty for every year", UserWarning, stacklevel=2)
    rows = [(i, y, y == years[0]) for i, y in enumerate(chosen)]
    return df.sparkSession.createDataFrame(rows, "fold int, validation_year int, is_latest_fold boolean")


def time_folds(df: DataFrame, row_id: str, year: str, n_years: int = 3, invalid_year: int = -1) -> DataFrame:
    """fold, validation_year, role, row_id: train rows are strictly earlier, all folds in one join."""
    years = validation_years(df, year, n_years, invalid_year)
    rows = eligible(df, year, invalid_year).select(F.col(row_id).alias("row_id"), "_year")
    # one row per fold on the broadcast side
    joined = rows.join(F.broadcast(years), F.col("_year") <= F.col("validation_year"))
    return joined.select("fold", "validation_year", F.when(F.col("_year") < F.col("validation_year"), "train").otherwise("valid").alias("role"), "row_id")


def with_first_year(df: DataFrame, name: str, year: str, invalid_year: int = -1) -> DataFrame:
    """Eligible rows with the first year in which their name occurs; a null name occurs never."""
    rows = eligible(df, year, invalid_year)
    firsts = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("_year").alias("_first"))
    return rows.join(firsts, name, "left")


def seen_flags(df: DataFrame, row_id: str, name: str, year: str, n_years: int = 3) -> DataFrame:
    """fold, row_id, seen: whether a validation row's name occurs in the fold's train rows.

    As train rows are all earlier ones, a name is seen if its first year is earlier.
    """
    years = validation_years(df, year, n_years)
    rows = with_first_year(df, name, year)
    joined = rows.join(F.broadcast(years), F.col("_year") == F.col("validation_year"))
    return joined.select("fold", "validation_year", F.col(row_id).alias("row_id"), F.coalesce(F.col("_first") < F.col("validation_year"), F.lit(False)).alias("seen"))


def fold_diagnostics(df: DataFrame, row_id: str, name: str, year: str, target: str, n_years: int = 3) -> DataFrame:
    """Sizes, target means and seen counts of every fold, in one aggregate."""
    years = validation_years(df, year, n_years)
    rows = with_first_year(df, name, year)
    joined = rows.join(F.broadcast(years), F.col("_year") <= F.col("validation_year"))
    train, valid = F.col("_year") < F.col("validation_year"), F.col("_year") == F.col("validation_year")
    seen = valid & F.coalesce(F.col("_first") < F.col("validation_year"), F.lit(False))
    per = joined.groupBy("fold", "validation_year", "is_latest_fold").agg(
        F.count_if(train).alias("train_size"), F.count_if(valid).alias("validation_size"),
        F.avg(F.when(valid, F.col(target))).alias("validation_target_mean"), F.avg(F.when(train, F.col(target))).alias("train_target_mean"),
        F.count_if(seen).alias("seen_count"),
    )
    return per.withColumn("unseen_count", F.col("validation_size") - F.col("seen_count")).withColumn("seen_project_rate", F.col("seen_count") / F.col("validation_size"))


def check_folds(folds: DataFrame) -> None:
    """Raises where a fold lacks a role, has a row twice, or more than one validation year."""
    bad = folds.groupBy("fold").agg(F.count_distinct("role").alias("r"), F.count("*").alias("n"), F.count_distinct("row_id").alias("d"), F.count_distinct("validation_year").alias("y"))
    wrong = bad.where("r < 2 OR n <> d OR y <> 1").limit(1).collect()
    if wrong:
        raise ValueError(f"fold {wrong[0]['fold']} is empty on a side, overlaps, or mixes validation years")


def fold_scores(predictions: DataFrame, score: str, target: str, keys: list[str], clip: float = 1e-7) -> DataFrame:
    """AUC and log-loss per group; AUC is NULL where only one class is present."""
    loss = predictions.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(*keys).agg(F.avg(log_loss_term(score, target, clip)).alias("log_loss"))
    return auc_by(predictions, score, target, keys).join(loss, keys)


def label_conflicts(df: DataFrame, name: str, target: str) -> DataFrame:
    """Names whose rows carry more than one label."""
    per = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n_rows"), F.count_distinct(target).alias("n_labels"))
    return per.where("n_labels > 1")


def last_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def clipped_auc(predictions: DataFrame, score: str, target: str, keys: list[str], clip: float = 1e-7) -> DataFrame:
    """AUC per group of scores clipped to [clip, 1 - clip] first, which may tie the extreme ones."""
    inside = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    return auc_by(predictions.withColumn(score, F.when(F.col(score).isNotNull(), inside)), score, target, keys)


def custom_scores(predictions: DataFrame, score: str, target: str, keys: list[str], metric: Callable[[Column, Column], Column]) -> DataFrame:
    """A metric of one's own per group: ``metric`` makes an aggregate of the columns of scores and targets.

    As an aggregate it is combined before the shuffle, so a group may hold any share of the rows.
    """
    known = predictions.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n"), metric(F.col(score), F.col(target)).alias("score"))


def binary_target(df: DataFrame, target: str, both: bool = True) -> None:
    """Raises where a known target isn't 0 or 1 or, with ``both``, where a class is missing."""
    value = F.col(target).cast("double")
    row = df.agg(F.count_if(F.col(target).isNotNull() & (value.isNull() | ~value.isin(0.0, 1.0))).alias("odd"), F.count_if(value == 0).alias("n0"), F.count_if(value == 1).alias("n1")).first()
    if row["odd"] or (both and not (row["n0"] and row["n1"])):
        raise ValueError(f"{row['odd']} targets are neither 0 nor 1; {row['n0']} are 0, {row['n1']} are 1")
