"""Readers and writers with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

PROJECTS = (
    "project_id string, project_name string, project_objective string, project_summary string, current_issues string, "
    "project_start_year string, project_end_year string, project_fiscal_year int, budget double, responsible_ministry string, science_tech_decision string"
)


def read_projects_csv(spark: SparkSession, path: str, schema: str = PROJECTS) -> DataFrame:
    """Quoted multi-line CSV, plain or gzip; NaN becomes NULL."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', encoding="UTF-8")
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', compression=compression)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def write_sparse_features(features: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """row_index, feature_index, value without zeros, and the names of the features beside it."""
    from pyspark.sql import Window

    write_csv(features.where("value <> 0"), f"{path}/values", "gzip")
    names = vocabulary.select((F.row_number().over(Window.orderBy("term")) - 1).alias("feature_index"), F.col("term").alias("feature"))
    write_csv(names, f"{path}/names", "gzip")


def write_submission(df: DataFrame, id_column: str, prediction: str, order: str, path: str) -> None:
    """id and prediction in the test table's order, one file; checked before it is written."""
    from kumihimo.operators.ensemble import check_submission

    check_submission(df, id_column, prediction)
    ordered = df.orderBy(order).select(id_column, F.col(prediction).alias(prediction))
    # one file is what a submission is; its rows are two short columns
    ordered.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_profiles(submissions: dict[str, tuple[dict[str, float], DataFrame]], id_column: str, order: str, path: str, canonical: str | None = None) -> DataFrame:
    """A submission per profile and a manifest with the weights as JSON, one row of it canonical."""
    import re

    if bad := [n for n in submissions if not re.fullmatch(r"[A-Za-z0-9_-]+", n)]:
        raise ValueError(f"unsafe profile names: {bad}")
    if canonical is not None and canonical not in submissions:
        raise ValueError(f"{canonical!r} is no profile")
    rows = []
    for name, (weights, df) in submissions.items():
        write_submission(df, id_column, "prediction", order, f"{path}/{name}")
        rows.append((name, json.dumps(weights, sort_keys=True), name == (canonical or next(iter(submissions)))))
    manifest = df.sparkSession.createDataFrame(rows, "profile string, weights string, is_canonical boolean")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def append_failures(df: DataFrame, path: str) -> None:
    """Failed requests as JSON lines, without the text that was sent."""
    df.drop("text").write.mode("append").json(path)


def write_fold_features(features: DataFrame, path: str) -> None:
    """Features and predictions of every fold, by fold, validation year and role."""
    features.write.mode("overwrite").partitionBy("fold", "validation_year", "role").parquet(path)


def write_wide_vectors(rows: DataFrame, id_column: str, vector: str, prefix: str, dimension: int, path: str) -> None:
    """One column for each of ``dimension`` elements of an array, prefix_000 and so on, and row_index."""
    cells = [F.get(F.col(vector), F.lit(i)).alias(f"{prefix}_{i:03d}") for i in range(dimension)]
    write_csv(rows.select(F.col(id_column).alias("row_index"), *cells), path, "gzip")


def write_experiments(oof: DataFrame, metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """Out-of-fold predictions, fold metrics and their summary, each as Parquet and CSV."""
    for name, df in (("oof", oof), ("fold_metrics", metrics), ("summary", summary)):
        write_parquet(df, f"{path}/{name}.parquet")
        write_csv(df, f"{path}/{name}.csv")


def write_ensemble(blend, id_column: str, path: str) -> None:
    """Weights, history, fold scores and a summary as CSV, the blended predictions as Parquet."""
    spark = blend.prediction.sparkSession
    tables = {
        "weights": ([(k, float(v)) for k, v in blend.weights.items()], "model string, weight double"),
        "history": ([tuple(h) for h in blend.history], "step int, added_model string, alpha double, score double"),
        "fold_scores": ([(str(k), float(v)) for k, v in blend.fold_scores.items()], "fold string, score double"),
        "summary": ([(float(blend.score), len(blend.history) - 1, sum(w > 0 for w in blend.weights.values()))], "score double, steps int, models int"),
    }
    for name, (rows, schema) in tables.items():
        write_csv(spark.createDataFrame(rows, schema).coalesce(1), f"{path}/{name}")
    write_parquet(blend.prediction.select(id_column, "prediction"), f"{path}/predictions")


def write_progress(spark: SparkSession, path: str, **counters) -> None:
    """Counters and spending of a run as one JSON object, replaced at every call."""
    spark.createDataFrame([(json.dumps(counters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def percent(c, digits: int = 1):
    """A rate as text, such as 12.5%."""
    return F.format_string(f"%.{digits}f%%", F.col(c) * 100 if isinstance(c, str) else c * 100)


def thousands(c, digits: int = 0):
    """A number as text with separators, such as 1,234."""
    return F.format_number(c, digits)
