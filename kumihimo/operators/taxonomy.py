"""Taxonomy labels: repair, rules, the one-to-one join with projects, and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DOMAINS = [f"D{i:02d}" for i in range(1, 16)]
PROCESSES = [f"A{i:02d}" for i in range(1, 14)]
NO_USE = "U99"
USE_CASES = [f"U{i:02d}" for i in range(1, 12)] + [NO_USE]


def decode_use_cases(c: Column | str) -> Column:
    """Codes of a pipe-separated or JSON list; empty parts dropped, NULL stays NULL."""
    text = F.col(c) if isinstance(c, str) else c
    plain = F.filter(F.transform(F.split(text, "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text).startswith("["), F.from_json(F.trim(text), "array<string>")).otherwise(plain)


def rule_violations(domain: Column, process: Column, use_cases: Column, applicability: Column, reason: Column | None = None) -> Column:
    """Names of the taxonomy's rules that a label breaks, in a fixed order; empty if none."""
    none_alone = F.array_contains(use_cases, NO_USE) & (F.size(use_cases) > 1)
    zero = applicability == 0
    only_none = (F.size(use_cases) == 1) & F.array_contains(use_cases, NO_USE)
    rules: list[tuple[str, Column]] = [
        ("policy_domain", ~domain.isin(DOMAINS)),
        ("admin_process", ~process.isin(PROCESSES)),
        ("use_case_count", (F.size(use_cases) < 1) | (F.size(use_cases) > 3)),
        ("use_case_code", F.exists(use_cases, lambda x: ~x.isin(USE_CASES))),
        ("use_case_repeated", F.size(F.array_distinct(use_cases)) < F.size(use_cases)),
        ("none_with_others", none_alone),
        ("applicability", ~applicability.isin(0, 1, 2)),
        ("applicability_and_none", zero != only_none),
    ]
    if reason is not None:
        rules.append(("reason", (F.trim(reason) == "") | (F.length(reason) > 1000)))
    missing = {"policy_domain": domain, "admin_process": process, "use_case_count": use_cases, "applicability": applicability, "reason": reason}
    broken = [
        F.when(F.coalesce(cond, F.lit(False)) | (missing[name].isNull() if missing.get(name) is not None else F.lit(False)), F.lit(name)) for name, cond in rules
    ]
    return F.array_compact(F.array(*broken))


def repaired_labels(features: DataFrame) -> DataFrame:
    """Codes in their plain form, use cases as an array, one row per project of a split.

    Blanks, case and single-digit codes are repaired. Of repeated keys the row classified
    last is kept, ties by the least labels, so that the result doesn't depend on order.
    """
    def code(c: str) -> Column:
        return F.regexp_replace(F.upper(F.trim(F.col(c))), "^([A-Z])([0-9])$", "$10$2")

    plain = features.select(
        "source_split", "project_id", "project_start_year", code("policy_domain").alias("policy_domain"), code("admin_process").alias("admin_process"),
        F.col("ai_usecase"), decode_use_cases(F.upper("ai_usecase")).alias("use_cases"), "ai_applicability", "classification_reason", "classified_at",
    )
    order = Window.partitionBy("source_split", "project_id").orderBy(
        F.col("classified_at").desc_nulls_last(), F.col("policy_domain").asc_nulls_last(), F.col("admin_process").asc_nulls_last(),
        F.col("ai_usecase").asc_nulls_last(), F.col("ai_applicability").asc_nulls_last(),
    )
    return plain.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def valid_labels(features: DataFrame) -> DataFrame:
    """Repaired labels that break no rule of the taxonomy."""
    labels = repaired_labels(features)
    broken = rule_violations(F.col("policy_domain"), F.col("admin_process"), F.col("use_cases"), F.col("ai_applicability"))
    return labels.where(F.size(broken) == 0)


def distinct_projects(train: DataFrame, test: DataFrame, ministries: DataFrame) -> DataFrame:
    """The last delivery of every project of either split, with a known ministry or NULL."""
    known = ministries.where("ministry_name IS NOT NULL").select(F.col("ministry_name").alias("_known")).distinct()
    both = train.withColumn("source_split", F.lit("train")).unionByName(test.withColumn("source_split", F.lit("test")), allowMissingColumns=True)
    last = Window.partitionBy("source_split", "project_id").orderBy(F.col("row_id").desc())
    kept = both.where("project_id IS NOT NULL").withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at")
    joined = kept.join(known, F.col("responsible_ministry") == F.col("_known"), "left")
    return joined.withColumn("responsible_ministry", F.col("_known")).drop("_known")


def join_taxonomy(projects: DataFrame, labels: DataFrame) -> DataFrame:
    """Projects with their labels: one row for each key in both, both sides being unique."""
    right = labels.select("source_split", "project_id", F.col("project_start_year").alias("label_year"), "policy_domain", "admin_process", "use_cases", "ai_applicability")
    joined = projects.drop("project_start_year", "policy_domain").join(right, ["source_split", "project_id"])
    return joined.withColumn("project_key", F.concat_ws("::", "source_split", "project_id")).withColumnRenamed("label_year", "project_start_year")


def join_diagnostics(projects: DataFrame, labels: DataFrame, min_year: int) -> DataFrame:
    """One row: keys on either side only, in both, and whose years disagree."""
    year = F.when(F.col("project_start_year").rlike("^[0-9]{4}$"), F.col("project_start_year").try_cast("int"))
    left = projects.select("source_split", "project_id", year.alias("source_year"), "responsible_ministry").where(F.col("source_year") >= min_year)
    right = labels.select("source_split", "project_id", F.col("project_start_year").alias("label_year")).where(F.col("label_year") >= min_year)
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), ["source_split", "project_id"], "full_outer")
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNull()).alias("source_only"),
        F.count_if(F.col("l").isNull() & F.col("r").isNotNull()).alias("feature_only"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("merged"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("source_year") != F.col("label_year"))).alias("year_mismatch"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("responsible_ministry").isNull()).alias("missing_ministry"),
    )


def theme_long(joined: DataFrame) -> DataFrame:
    """One row per project and use case, with its theme and whether its applicability is high."""
    flat = joined.withColumn("ai_usecase", F.explode("use_cases")).drop("use_cases")
    return flat.withColumns({
        "theme_code": F.concat_ws("__", "admin_process", "ai_usecase"),
        "is_high_app": F.col("ai_applicability") == 2,
        "is_u99": F.col("ai_usecase") == NO_USE,
    })


def merge_taxonomy(projects: DataFrame, labels: DataFrame, complete: bool = True) -> DataFrame:
    """``join_taxonomy``, checked: keys once on both sides and, if ``complete``, each key on both.

    ValueError otherwise, and where the years of the sides disagree.
    """
    from kumihimo.operators.joins import checked_join, require_columns

    on = ["source_split", "project_id"]
    require_columns(projects, [*on, "project_start_year"], ["project_key", "label_year", "use_cases"])
    require_columns(labels, [*on, "project_start_year", "use_cases"])
    right = labels.select(*on, F.col("project_start_year").alias("label_year"), "policy_domain", "admin_process", "use_cases", "ai_applicability")
    joined = checked_join(projects.drop("policy_domain"), right, on, complete=complete)
    odd = joined.where(F.col("project_start_year").try_cast("double") != F.col("label_year")).count()
    if odd:
        raise ValueError(f"year_mismatch={odd}")
    return joined.drop("project_start_year").withColumnRenamed("label_year", "project_start_year").withColumn("project_key", F.concat_ws("::", *on))


def with_labels(rows: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """All rows of one split, with the labels of their project where there are any; labels once for each project."""
    from kumihimo.operators.joins import checked_join

    own = labels.where(F.col("source_split") == split).select("project_id", "policy_domain", "admin_process", "use_cases", "ai_applicability")
    return checked_join(rows.drop("policy_domain", "admin_process", "use_cases", "ai_applicability"), own, ["project_id"], "left", "many_to_one")


def checked_theme_long(joined: DataFrame) -> DataFrame:
    """``theme_long``; ValueError where a project has a theme twice, no theme, or an unknown code."""
    long = theme_long(joined)
    if n := long.groupBy("project_key", "theme_code").agg(F.count("*").alias("_n")).where("_n > 1").count():
        raise ValueError(f"{n} projects have a theme twice")
    codes = F.col("ai_usecase").isin(USE_CASES) & F.col("admin_process").isin(PROCESSES)
    if n := long.where(~F.coalesce(codes, F.lit(False))).count():
        raise ValueError(f"{n} rows have an unknown code")
    if n := joined.where(F.coalesce(F.size("use_cases"), F.lit(0)) < 1).count():
        raise ValueError(f"{n} projects have no use case")
    return long
