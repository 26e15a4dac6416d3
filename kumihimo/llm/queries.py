"""The queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kumihimo.llm import canon, distinctive, mixing, neardup, overlap, packing, sentences, subjects, tokens
from kumihimo.sources.shared import table, written

TEXT_COLUMNS = ["project_name", "project_objective", "project_summary", "current_issues"]
TERM_COLUMNS = ["project_name", "project_summary", "current_issues"]
BODY_COLUMNS = ["project_objective", "project_summary", "current_issues"]


def p1_overlaps(spark: SparkSession, base: str) -> DataFrame:
    """Overlapping train and test rows with the coverage of each."""
    return overlap.overlaps(table(spark, base, "train"), table(spark, base, "test"), "row_id", "project_name", "project_summary")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return p1_overlaps(spark, base).select("train_row_id", "test_row_id")


def p1_by_source(spark: SparkSession, base: str) -> DataFrame:
    """Per load and ministry of the test row: rows, rows that stand in train too, pairs."""
    test = table(spark, base, "test").select("row_id", "load_id", "responsible_ministry")
    hits = p1_overlaps(spark, base).groupBy(F.col("test_row_id").alias("row_id")).agg(F.count("*").alias("pairs"), F.max("test_coverage").alias("coverage"))
    joined = test.join(hits, "row_id", "left")
    return joined.groupBy("load_id", "responsible_ministry").agg(
        F.count("*").alias("test_rows"), F.count("pairs").alias("overlapping_rows"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )


def p3_groups(spark: SparkSession, base: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, base, "train"), "row_id", BODY_COLUMNS, required=["project_summary"])


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return neardup.pairs_of(p3_groups(spark, base))


def p4_subjects(spark: SparkSession, base: str) -> DataFrame:
    """Subjects of every train row with their posterior probability."""
    features = table(spark, base, "ai_market_llm_features").where("source_split = 'train'").select("project_id", "policy_domain")
    train = table(spark, base, "train").select("row_id", "project_id", "project_objective", "project_summary")
    return subjects.assign_subjects(train, features, table(spark, base, "policy_domains"), "row_id", "project_id", "project_objective", "project_summary")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return p4_subjects(spark, base).select("row_id", "policy_domain")


def p4_composition(spark: SparkSession, base: str) -> DataFrame:
    return subjects.composition(p4_subjects(spark, base))


def p5_scores(spark: SparkSession, base: str) -> DataFrame:
    return distinctive.record_terms(table(spark, base, "train"), "row_id", TERM_COLUMNS)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    scored = distinctive.characteristic_terms(table(spark, base, "train"), table(spark, base, "glossary_terms"), "row_id", TERM_COLUMNS)
    return scored.select("row_id", "term_id")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return canon.found(table(spark, base, "train"), TEXT_COLUMNS)


def p6_canonical(spark: SparkSession, base: str) -> DataFrame:
    return canon.canonical_cells(table(spark, base, "train"), "row_id", TEXT_COLUMNS)


def p7_packs(spark: SparkSession, base: str) -> DataFrame:
    sized = tokens.with_token_counts(table(spark, base, "documents"), "doc_id", "text")
    return packing.pack(written(sized), table(spark, base, "pack_sizes"))


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack_report(p7_packs(spark, base), table(spark, base, "pack_sizes"))


def p8_mixture(spark: SparkSession, base: str) -> DataFrame:
    sized = tokens.with_token_counts(table(spark, base, "documents"), "doc_id", "text", keep=("source",))
    return mixing.mix(sized, table(spark, base, "mix_targets"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_report(p8_mixture(spark, base), table(spark, base, "mix_targets"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences.sentence_units(table(spark, base, "documents"), "doc_id", "text")


def p9_sentences(spark: SparkSession, base: str) -> DataFrame:
    return sentences.sentence_units(table(spark, base, "documents"), "doc_id", "text", with_text=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_overlaps": p1_overlaps,
    "p1_by_source": p1_by_source,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_subjects": p4_subjects,
    "p4_composition": p4_composition,
    "p5_found": p5_found,
    "p5_scores": p5_scores,
    "p6_found": p6_found,
    "p6_canonical": p6_canonical,
    "p7_packs": p7_packs,
    "p7_fill": p7_fill,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
}

SQL: dict[str, str] = {}
