"""Queries on folds, labels and the differences between train and test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kumihimo.functions.expr import auc_by
from kumihimo.operators import folds as f, profiling as p
from kumihimo.plans.market import rounded
from kumihimo.plans.registry import query
from kumihimo.sources.shared import table

YEAR = "CASE WHEN regexp_full_match(project_start_year, '-?[0-9]+') AND length(project_start_year) < 9 THEN project_start_year::INT END"
#: Years from 1950 to 2030 only: others are typing errors, not the latest years.
GOOD = f"CASE WHEN {YEAR} BETWEEN 1950 AND 2030 THEN {YEAR} END"
TARGET = "CASE WHEN trim(science_tech_decision) = '該当' THEN 1 WHEN trim(science_tech_decision) = '非該当' THEN 0 END"
ROWS = f"rows0 AS (SELECT row_id, project_name, responsible_ministry, {GOOD} AS y, {TARGET} AS target FROM train)"
FOLDS = ROWS + ", e AS (SELECT * FROM rows0 WHERE y IS NOT NULL), v AS (SELECT DISTINCT y AS validation_year FROM e ORDER BY y DESC LIMIT 3), fy AS (SELECT validation_year, row_number() OVER (ORDER BY validation_year) - 1 AS fold, validation_year = (SELECT max(validation_year) FROM v) AS is_latest_fold FROM v)"
TEXTS = ["project_name", "project_objective", "project_summary", "current_issues"]
SHARED = [*TEXTS, "project_start_year", "project_end_year", "project_fiscal_year", "budget", "responsible_ministry"]


def year_of(c: str = "project_start_year") -> F.Column:
    y = F.when(F.col(c).rlike("^-?[0-9]+\\z") & (F.length(c) < 9), F.col(c).try_cast("int"))
    return F.when(y.between(1950, 2030), y)


def labelled(spark: SparkSession, base: str) -> DataFrame:
    """Train with a whole-number year and the encoded target."""
    return table(spark, base, "train").withColumn("year", year_of().cast("string")).withColumn("target", f.encode_target("science_tech_decision"))


@query("encode_target", f"SELECT row_id, {TARGET} AS target FROM train WHERE {TARGET} IS NOT NULL")
def encode_target(spark: SparkSession, base: str) -> DataFrame:
    return labelled(spark, base).where("target IS NOT NULL").select("row_id", F.col("target").cast("int").alias("target"))


@query("time_cv_folds", f"WITH {FOLDS} SELECT fold, validation_year, CASE WHEN y < validation_year THEN 'train' ELSE 'valid' END AS role, row_id FROM e JOIN fy ON y <= validation_year")
def time_cv_folds(spark: SparkSession, base: str) -> DataFrame:
    return f.time_folds(labelled(spark, base), "row_id", "year")


@query(
    "time_cv_diagnostics",
    f"""WITH {FOLDS}, n AS (SELECT project_name, min(y) AS first FROM e WHERE project_name IS NOT NULL GROUP BY ALL)
    SELECT fold, validation_year, is_latest_fold, count(*) FILTER (y < validation_year) AS train_size, count(*) FILTER (y = validation_year) AS validation_size,
    round(avg(target) FILTER (y = validation_year), 6) AS validation_target_mean, round(avg(target) FILTER (y < validation_year), 6) AS train_target_mean,
    count(*) FILTER (y = validation_year AND first < validation_year) AS seen_count, count(*) FILTER (y = validation_year AND (first IS NULL OR first >= validation_year)) AS unseen_count,
    round(count(*) FILTER (y = validation_year AND first < validation_year) / count(*) FILTER (y = validation_year), 6) AS seen_project_rate
    FROM e JOIN fy ON y <= validation_year LEFT JOIN n USING (project_name) GROUP BY ALL""",
)
def time_cv_diagnostics(spark: SparkSession, base: str) -> DataFrame:
    return rounded(f.fold_diagnostics(labelled(spark, base), "row_id", "project_name", "year", "target"))


@query(
    "seen_mask",
    f"""WITH {FOLDS} SELECT fold, validation_year, row_id, project_name IS NOT NULL AND EXISTS (SELECT 1 FROM e o WHERE o.project_name = e.project_name AND o.y < validation_year) AS seen
    FROM e JOIN fy ON y = validation_year""",
)
def seen_mask(spark: SparkSession, base: str) -> DataFrame:
    return f.seen_flags(labelled(spark, base), "row_id", "project_name", "year")


def scored(spark: SparkSession, base: str) -> DataFrame:
    """Out-of-fold predictions in long form with the target."""
    oof = table(spark, base, "oof_predictions")
    long = oof.select("row_id", "validation_year", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("model_a", "model_b")])).alias("s")).select("row_id", "validation_year", "s.*")
    return long.join(labelled(spark, base).select("row_id", "target"), "row_id").where("score IS NOT NULL AND NOT isnan(score) AND target IS NOT NULL")


SCORED = f"""s0 AS (SELECT row_id, validation_year, model, score FROM oof_predictions UNPIVOT (score FOR model IN (model_a, model_b))),
s AS (SELECT s0.*, {TARGET} AS target FROM s0 JOIN train USING (row_id) WHERE {TARGET} IS NOT NULL AND NOT isnan(score))"""


@query(
    "fold_auc",
    f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY validation_year, model ORDER BY score) + (count(*) OVER (PARTITION BY validation_year, model, score) - 1) / 2.0 AS k FROM s),
    a AS (SELECT validation_year, model, count(*) AS n, sum(target)::BIGINT AS n_positive, sum(k) FILTER (target = 1) AS ks FROM r GROUP BY ALL)
    SELECT validation_year, model, n, n_positive, round((ks - n_positive * (n_positive + 1) / 2.0) / (n_positive * (n - n_positive)), 6) AS auc FROM a WHERE n_positive > 0 AND n_positive < n""",
)
def fold_auc(spark: SparkSession, base: str) -> DataFrame:
    return rounded(auc_by(scored(spark, base), "score", "target", ["validation_year", "model"]).where("auc IS NOT NULL"))


@query(
    "fold_logloss",
    f"""WITH {SCORED}, c AS (SELECT *, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM s)
    SELECT validation_year, model, round(avg(-(target * ln(p) + (1 - target) * ln(1 - p))), 6) AS log_loss FROM c GROUP BY ALL""",
)
def fold_logloss(spark: SparkSession, base: str) -> DataFrame:
    return rounded(f.fold_scores(scored(spark, base), "score", "target", ["validation_year", "model"]).select("validation_year", "model", "log_loss"))


@query(
    "overview",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS split, count(*) AS rows, count(DISTINCT project_id) AS unique_ids, count(*) FILTER (project_id IS NULL) AS missing_ids, min({GOOD}) AS first_year, max({GOOD}) AS last_year,
        count(*) - count(*) FILTER (project_id IS NULL) - count(DISTINCT project_id) AS repeated_rows FROM {s}""" for s in ("train", "test")
    ),
)
def overview(spark: SparkSession, base: str) -> DataFrame:
    parts = [p.overview(table(spark, base, s), "project_id", year_of()).withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query(
    "missing_profile",
    "SELECT column_name, round(a, 6) AS train_rate, round(b, 6) AS test_rate, round(greatest(a, b), 6) AS max_rate, round(abs(a - b), 6) AS abs_gap FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT avg(({c} IS NULL)::INT) FROM train) AS a, (SELECT avg(({c} IS NULL)::INT) FROM test) AS b" for c in SHARED)
    + ")",
)
def missing_profile(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.missing_profile(table(spark, base, "train"), table(spark, base, "test"), SHARED))


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM train" for c in SHARED))
def column_profile(spark: SparkSession, base: str) -> DataFrame:
    # exact distinct counts, a column at a time: one aggregate of many DISTINCTs would expand every row by their number
    train = table(spark, base, "train")
    parts = [train.agg(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), (F.count("*") - F.count(c)).alias("n_null"), F.count_distinct(c).alias("n_distinct")) for c in SHARED]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_BUDGET = "CASE WHEN budget >= 0 AND NOT isnan(budget) AND budget <= 1000000 THEN budget END"
NUMERIC = {"budget": _BUDGET, "start_year": f"({GOOD})::DOUBLE", "fiscal_year": "project_fiscal_year::DOUBLE"}


def numeric_columns() -> dict[str, F.Column]:
    budget = F.when((F.col("budget") >= 0) & ~F.isnan("budget") & (F.col("budget") <= 1_000_000), F.col("budget"))
    return {"budget": budget, "start_year": year_of().cast("double"), "fiscal_year": F.col("project_fiscal_year").cast("double")}


@query(
    "numeric_describe",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, """
        + ", ".join(f"round(quantile_cont(x, {q}), 4) AS p{round(q * 100):02d}" for q in (0.01, 0.25, 0.5, 0.75, 0.99))
        + f", max(x) AS max, round(1 - count(x) / count(*), 4) AS missing_rate FROM (SELECT {e} AS x FROM train)" for n, e in NUMERIC.items()
    ),
)
def numeric_describe(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.describe(table(spark, base, "train"), numeric_columns()), 4)


def _rank_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(ra, rb), 6) AS rho FROM (
      SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
      FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in NUMERIC.items())} FROM train) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("spearman_matrix", " UNION ALL ".join(_rank_sql(a, b) for a, b in (("budget", "start_year"), ("budget", "fiscal_year"), ("start_year", "fiscal_year"))))
def spearman_matrix(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.spearman(table(spark, base, "train"), numeric_columns()))


@query(
    "ks_drift",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, round(max(abs(ca / (SELECT count({e}) FROM train) - cb / (SELECT count({e}) FROM test))), 6) AS ks_statistic,
        (SELECT count({e}) FROM train) AS n_train, (SELECT count({e}) FROM test) AS n_test FROM (SELECT v, sum(sum(a)) OVER (ORDER BY v) AS ca, sum(sum(b)) OVER (ORDER BY v) AS cb FROM (
          SELECT {e} AS v, 1 AS a, 0 AS b FROM train UNION ALL SELECT {e}, 0, 1 FROM test) WHERE v IS NOT NULL GROUP BY v)""" for n, e in NUMERIC.items()
    ),
)
def ks_drift(spark: SparkSession, base: str) -> DataFrame:
    train, test = table(spark, base, "train"), table(spark, base, "test")
    parts = [p.ks_statistic(train, test, c, n) for n, c in numeric_columns().items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "tv_drift",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(sum(abs(a / (SELECT count(*) FROM train) - b / (SELECT count(*) FROM test))) / 2, 6) AS tv_distance, count(*) FILTER (a = 0 AND b > 0) AS new_values
        FROM (SELECT coalesce({c}::VARCHAR, '<MISSING>') AS v, sum(a) AS a, sum(b) AS b FROM (SELECT {c}, 1 AS a, 0 AS b FROM train UNION ALL SELECT {c}, 0, 1 FROM test) GROUP BY 1)"""
        for c in ("responsible_ministry", "project_start_year")
    ),
)
def tv_drift(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.total_variation(table(spark, base, "train"), table(spark, base, "test"), ["responsible_ministry", "project_start_year"]))


@query(
    "category_target_rate",
    f"""WITH {ROWS}, c AS (SELECT coalesce(responsible_ministry, '<MISSING>') AS responsible_ministry, count(*) AS n, avg(target) AS r FROM rows0 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15)
    SELECT responsible_ministry, n, round(r, 6) AS target_rate, round(n / (SELECT count(*) FROM train), 6) AS share FROM c WHERE n >= 20""",
)
def category_target_rate(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.category_target_rate(labelled(spark, base), "responsible_ministry", "target"))


@query(
    "text_length_summary",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg((trim(coalesce({c}, '')) = '')::INT), 6) AS empty_rate, quantile_cont(length(coalesce({c}, '')), 0.5) AS median_length, round(quantile_cont(length(coalesce({c}, '')), 0.95), 4) AS p95_length, max(length(coalesce({c}, '')))::INT AS max_length FROM (SELECT {c} FROM train)" for c in TEXTS),
)
def text_length_summary(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.text_lengths(table(spark, base, "train"), TEXTS))


@query(
    "name_overlap",
    f"""WITH {ROWS}, n AS (SELECT project_name, count(*) AS n, count(DISTINCT target) AS k FROM rows0 WHERE project_name IS NOT NULL GROUP BY ALL)
    SELECT (SELECT count(*) FROM n) AS train_names, (SELECT count(*) FROM n WHERE n > 1) AS repeated_names, (SELECT coalesce(sum(n), 0)::BIGINT FROM n WHERE n > 1) AS rows_with_repeated_names,
    (SELECT count(*) FROM n WHERE k > 1) AS conflicting_names, count(*) AS test_rows, count(n.project_name) AS test_rows_seen, count(DISTINCT n.project_name) AS shared_names FROM test t LEFT JOIN n ON t.project_name = n.project_name""",
)
def name_overlap(spark: SparkSession, base: str) -> DataFrame:
    return p.name_overlap(labelled(spark, base), table(spark, base, "test"), "project_name", "target")


@query("freq_of_freq", "SELECT c AS occurrences, count(*) AS n_values FROM (SELECT project_name, count(*) AS c FROM train WHERE project_name IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def freq_of_freq(spark: SparkSession, base: str) -> DataFrame:
    return p.frequency_of_frequency(table(spark, base, "train"), "project_name")


@query("target_by_year", f"WITH {ROWS} SELECT y AS year, count(*) AS n, round(avg(target), 6) AS target_rate, sum(target)::BIGINT AS positives FROM rows0 WHERE y IS NOT NULL GROUP BY ALL")
def target_by_year(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.by_year(labelled(spark, base).where("year IS NOT NULL"), F.col("year").cast("int"), "target"))


@query("label_conflicts", f"WITH {ROWS} SELECT project_name, count(*) AS n_rows, count(DISTINCT target) AS n_labels FROM rows0 WHERE project_name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT target) > 1")
def label_conflicts(spark: SparkSession, base: str) -> DataFrame:
    return f.label_conflicts(labelled(spark, base), "project_name", "target")


@query("value_shares", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY ALL")
def value_shares(spark: SparkSession, base: str) -> DataFrame:
    return rounded(p.value_shares(table(spark, base, "documents"), "lang"))


@query("unseen_ministries", "SELECT DISTINCT responsible_ministry FROM test WHERE responsible_ministry IS NOT NULL AND responsible_ministry NOT IN (SELECT responsible_ministry FROM train WHERE responsible_ministry IS NOT NULL)")
def unseen_ministries(spark: SparkSession, base: str) -> DataFrame:
    test, train = table(spark, base, "test").select("responsible_ministry"), table(spark, base, "train").select("responsible_ministry")
    return test.where("responsible_ministry IS NOT NULL").distinct().join(train, "responsible_ministry", "left_anti")


@query("split_union", "SELECT 'train' AS split, project_id, load_id FROM train UNION ALL SELECT 'test', project_id, load_id FROM test")
def split_union(spark: SparkSession, base: str) -> DataFrame:
    parts = [table(spark, base, s).select(F.lit(s).alias("split"), "project_id", "load_id") for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("shared_ids", "SELECT project_id FROM train INTERSECT SELECT project_id FROM test")
def shared_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "train").select("project_id").intersect(table(spark, base, "test").select("project_id"))


@query("repeated_deliveries", "SELECT project_id, row_id, count(*) OVER (PARTITION BY project_id) AS deliveries FROM train WHERE project_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY project_id) > 1")
def repeated_deliveries(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "train").where("project_id IS NOT NULL").select("project_id", "row_id")
    counts = rows.groupBy("project_id").agg(F.count("*").alias("deliveries")).where("deliveries > 1")
    return rows.join(counts, "project_id")


@query(
    "seen_unseen_auc",
    f"""WITH {SCORED}, {ROWS}, n AS (SELECT project_name, min(y) AS first FROM rows0 WHERE y IS NOT NULL AND project_name IS NOT NULL GROUP BY ALL),
    z AS (SELECT s.*, coalesce(first < s.validation_year, false) AS seen FROM s JOIN train USING (row_id) LEFT JOIN n USING (project_name)),
    r AS (SELECT *, rank() OVER (PARTITION BY model, seen ORDER BY score) + (count(*) OVER (PARTITION BY model, seen, score) - 1) / 2.0 AS k FROM z)
    SELECT model, seen, count(*) AS n, round((sum(k) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / nullif(sum(target) * (count(*) - sum(target)), 0), 6) AS auc FROM r GROUP BY ALL""",
)
def seen_unseen_auc(spark: SparkSession, base: str) -> DataFrame:
    """AUC of rows whose name was seen in earlier years, and of the others."""
    first = f.with_first_year(labelled(spark, base), "project_name", "year").groupBy("project_name").agg(F.min("_first").alias("first"))
    names = table(spark, base, "train").select("row_id", "project_name")
    rows = scored(spark, base).join(names, "row_id").join(first, "project_name", "left")
    flagged = rows.withColumn("seen", F.coalesce(F.col("first") < F.col("validation_year"), F.lit(False)))
    return rounded(auc_by(flagged, "score", "target", ["model", "seen"]).select("model", "seen", "n", "auc"))


@query("column_kinds")
def column_kinds(spark: SparkSession, base: str) -> DataFrame:
    return p.column_kinds(table(spark, base, "train"))


@query("missing_long", "SELECT 'train' AS split, load_id, count(*) AS n, count(*) - count(budget) AS no_budget, count(*) - count(current_issues) AS no_issues FROM train GROUP BY ALL UNION ALL SELECT 'test', load_id, count(*), count(*) - count(budget), count(*) - count(current_issues) FROM test GROUP BY ALL")
def missing_long(spark: SparkSession, base: str) -> DataFrame:
    both = table(spark, base, "train").select(F.lit("train").alias("split"), "load_id", "budget", "current_issues").unionByName(table(spark, base, "test").select(F.lit("test").alias("split"), "load_id", "budget", "current_issues"))
    return both.groupBy("split", "load_id").agg(F.count("*").alias("n"), F.count_if(F.col("budget").isNull()).alias("no_budget"), F.count_if(F.col("current_issues").isNull()).alias("no_issues"))


@query("latest_delivery", "SELECT project_id, row_id, load_id FROM train WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1")
def latest_delivery(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "train").where("project_id IS NOT NULL").select("project_id", "row_id", "load_id", "loaded_at")
    return f.last_per_group(rows, ["project_id"], [F.col("loaded_at").desc_nulls_last(), F.desc("row_id")]).drop("loaded_at")


@query("event_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, base: str) -> DataFrame:
    """The streaming aggregate of ``streaming.incremental``, over the table at rest."""
    from kumihimo.streaming.incremental import windowed_events

    per = windowed_events(table(spark, base, "events"))
    return rounded(per.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "value"), 4)
