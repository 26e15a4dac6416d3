"""Queries on data quality (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kumihimo.operators import quality as q
from kumihimo.plans.registry import query
from kumihimo.sources.shared import table, written

CONSTRAINTS = [q.year_constraint("project_start_year"), q.amount_constraint("budget"), q.member_constraint("responsible_ministry", "known_ministry")]
COLUMNS = ["row_id", "load_id", "project_start_year", "budget", "responsible_ministry"]

_KINDS = """
cells AS (
  SELECT t.row_id, t.load_id, 'project_start_year' AS column_name,
         CASE WHEN project_start_year IS NULL THEN 'null' WHEN project_start_year = '-1' THEN 'marker'
              WHEN regexp_full_match(project_start_year, '[0-9]{4}') AND project_start_year BETWEEN '1950' AND '2030' THEN 'valid'
              ELSE 'wrong' END AS kind
  FROM train t
  UNION ALL
  SELECT row_id, load_id, 'budget', CASE WHEN budget IS NULL THEN 'null' WHEN isnan(budget) OR budget < 0 OR budget > 1000000 THEN 'wrong' ELSE 'valid' END FROM train
  UNION ALL
  SELECT row_id, load_id, 'responsible_ministry',
         CASE WHEN responsible_ministry IS NULL THEN 'null'
              WHEN responsible_ministry IN (SELECT ministry_name FROM bureaus) THEN 'valid' ELSE 'wrong' END FROM train
)"""


def checked_train(spark: SparkSession, base: str) -> DataFrame:
    return q.with_known(table(spark, base, "train").select(*COLUMNS), "responsible_ministry", table(spark, base, "bureaus"), "ministry_name", "known_ministry")


def cells_of(spark: SparkSession, base: str):
    """The states of train's cells, scanned once and written: a row for each wrong cell and each load, column and class."""
    return written(q.cell_states(checked_train(spark, base), "row_id", "load_id", CONSTRAINTS))


_CLASSES = """
classes AS (
  SELECT row_id, load_id, 'project_start_year' AS column_name,
         CASE WHEN project_start_year IS NULL THEN 'null' WHEN project_start_year = '-1' THEN 'marker'
              WHEN regexp_full_match(project_start_year, '[0-9]{4}') AND project_start_year BETWEEN '1950' AND '2030' THEN 'v:' || project_start_year
              ELSE 'wrong' END AS c FROM train
  UNION ALL
  SELECT row_id, load_id, 'budget', CASE WHEN budget IS NULL THEN 'null' WHEN isnan(budget) OR budget < 0 OR budget > 1000000 THEN 'wrong'
              WHEN budget = 0 THEN 'v:zero' ELSE 'v:' || floor(2 * (ln(budget) / ln(2)))::INT END FROM train
  UNION ALL
  SELECT row_id, load_id, 'responsible_ministry',
         CASE WHEN responsible_ministry IS NULL THEN 'null'
              WHEN responsible_ministry IN (SELECT ministry_name FROM bureaus) THEN 'v:' || responsible_ministry ELSE 'wrong' END FROM train
),
counted AS (SELECT load_id, column_name, c, count(*) AS n FROM classes WHERE load_id IS NOT NULL GROUP BY ALL),
totals AS (SELECT load_id, column_name, sum(n) AS n_rows, coalesce(sum(n) FILTER (c = 'null'), 0) AS n_null, coalesce(sum(n) FILTER (c = 'marker'), 0) AS n_marker,
           coalesce(sum(n) FILTER (c = 'wrong'), 0) AS n_wrong, coalesce(sum(n) FILTER (c LIKE 'v:%'), 0) AS n_valid FROM counted GROUP BY ALL),
grid AS (SELECT t.load_id, t.column_name, n_rows, n_valid, b.c, coalesce(k.n, 0) / n_valid AS share
         FROM totals t JOIN (SELECT DISTINCT column_name, c FROM counted WHERE c LIKE 'v:%') b USING (column_name)
         LEFT JOIN counted k ON k.load_id = t.load_id AND k.column_name = t.column_name AND k.c = b.c WHERE n_valid > 0),
typical AS (SELECT column_name, c, median(share) AS u FROM grid GROUP BY ALL),
scaled AS (SELECT column_name, c, u / nullif(sum(u) OVER (PARTITION BY column_name), 0) AS u FROM typical),
metrics AS (
  SELECT load_id, column_name, n_rows, unnest(['null', 'marker', 'wrong']) AS metric, unnest([n_null / n_rows, n_marker / n_rows, n_wrong / n_rows]) AS value FROM totals
  UNION ALL
  SELECT g.load_id, g.column_name, n_rows, 'spread', sum(abs(share - coalesce(u, 0))) / 2 * n_valid / n_rows FROM grid g JOIN scaled USING (column_name, c) GROUP BY g.load_id, g.column_name, n_rows, n_valid
),
gaps AS (SELECT m.*, u.usual, abs(value - usual) AS gap FROM metrics m JOIN (SELECT column_name, metric, median(value) AS usual FROM metrics GROUP BY ALL) u USING (column_name, metric)),
odd AS (SELECT g.* FROM gaps g JOIN (SELECT column_name, metric, median(gap) * 1.4826 AS sd FROM gaps GROUP BY ALL) USING (column_name, metric)
        WHERE gap >= 0.1 AND gap > 3 * greatest(sd, sqrt(greatest(usual * (1 - usual), 0) / n_rows)))"""


@query(
    "p2_found",
    f"WITH {_CLASSES} SELECT column_name, 'value' AS issue, row_id AS ref_id FROM classes WHERE c = 'wrong' UNION ALL SELECT DISTINCT column_name, 'load', load_id::BIGINT FROM odd",
)
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    cells = cells_of(spark, base)
    values = q.wrong_cells(cells, "row_id").select("column_name", F.lit("value").alias("issue"), F.col("row_id").cast("long").alias("ref_id"))
    odd = q.load_anomalies(q.load_states(cells)).select("column_name", F.lit("load").alias("issue"), F.col("load").cast("long").alias("ref_id"))
    return values.unionByName(odd.distinct())


@query("p2_wrong_values", f"WITH {_KINDS} SELECT column_name, row_id FROM cells WHERE kind = 'wrong'")
def p2_wrong_values(spark: SparkSession, base: str) -> DataFrame:
    return q.wrong_cells(cells_of(spark, base), "row_id").select("column_name", "row_id")


@query(
    "p2_load_rates",
    f"""WITH {_KINDS}
    SELECT column_name, load_id, count(*) AS n_rows,
           round(avg((kind = 'null')::INT), 6) AS null_rate, round(avg((kind = 'marker')::INT), 6) AS marker_rate,
           round(avg((kind = 'wrong')::INT), 6) AS wrong_rate
    FROM cells GROUP BY ALL""",
)
def p2_load_rates(spark: SparkSession, base: str) -> DataFrame:
    metrics = q.load_metrics(written(q.load_states(cells_of(spark, base)))).where("metric <> 'spread'")
    wide = metrics.groupBy("column_name", F.col("load").alias("load_id"), "n_rows").pivot("metric", ["null", "marker", "wrong"]).agg(F.first("value"))
    return wide.select("column_name", "load_id", "n_rows", *[F.round(k, 6).alias(f"{k}_rate") for k in ("null", "marker", "wrong")])


@query("p2_load_anomalies", f"WITH {_CLASSES} SELECT load_id AS load, column_name, metric, round(value, 6) AS value, round(usual, 6) AS usual FROM odd")
def p2_load_anomalies(spark: SparkSession, base: str) -> DataFrame:
    odd = q.load_anomalies(q.load_states(cells_of(spark, base)))
    return odd.select("load", "column_name", "metric", F.round("value", 6).alias("value"), F.round("usual", 6).alias("usual"))


@query("p2_profile")
def p2_profile(spark: SparkSession, base: str) -> DataFrame:
    return q.table_profile(table(spark, base, "train"), load_column="load_id")


_RANGES = ["row_id", "project_id", "project_name", "project_objective", "project_summary", "current_issues", "project_start_year", "project_end_year", "project_fiscal_year", "responsible_ministry", "science_tech_decision", "load_id"]


@query(
    "p2_column_ranges",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM train" for c in _RANGES),
)
def p2_column_ranges(spark: SparkSession, base: str) -> DataFrame:
    """The exact part of the profile: rows, nulls and ranges of the columns of numbers and texts."""
    train = table(spark, base, "train").select(*_RANGES)
    return q.table_profile(train, load_column="load_id").select("column_name", "n_rows", "n_null", "least", "greatest")
