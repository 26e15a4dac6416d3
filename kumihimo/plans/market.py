"""Queries on labels, themes, domains and accounts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kumihimo.operators import domain as d, market as m, taxonomy as t
from kumihimo.plans.registry import query
from kumihimo.sources.shared import table, written

#: The domain queries are about so many themes, the first by strategic score.
LEADING = 3

_FIT = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in (m.PROCESS_FIT | m.USE_CASE_FIT).items()) + " END"

LABELS = """
labels0 AS (
  SELECT source_split, project_id, project_start_year,
         regexp_replace(upper(trim(policy_domain)), '^([A-Z])([0-9])$', '\\10\\2') AS policy_domain,
         regexp_replace(upper(trim(admin_process)), '^([A-Z])([0-9])$', '\\10\\2') AS admin_process,
         ai_usecase, list_filter(list_transform(string_split(upper(ai_usecase), '|'), lambda x: trim(x)), lambda x: x <> '') AS use_cases,
         ai_applicability,
         row_number() OVER (PARTITION BY source_split, project_id ORDER BY classified_at DESC NULLS LAST,
           regexp_replace(upper(trim(policy_domain)), '^([A-Z])([0-9])$', '\\10\\2') ASC NULLS LAST,
           regexp_replace(upper(trim(admin_process)), '^([A-Z])([0-9])$', '\\10\\2') ASC NULLS LAST,
           ai_usecase ASC NULLS LAST, ai_applicability ASC NULLS LAST) AS k_
  FROM ai_market_llm_features
), repaired AS (SELECT * FROM labels0 WHERE k_ = 1)
"""

_OK_DOMAIN = "policy_domain IN (" + ", ".join(f"'{x}'" for x in t.DOMAINS) + ")"
_OK_PROCESS = "admin_process IN (" + ", ".join(f"'{x}'" for x in t.PROCESSES) + ")"
_CODES = "[" + ", ".join(f"'{x}'" for x in t.USE_CASES) + "]"

BASE = (
    LABELS
    + f"""
, valid AS (
  SELECT * FROM repaired
  WHERE {_OK_DOMAIN} AND {_OK_PROCESS} AND use_cases IS NOT NULL AND len(use_cases) BETWEEN 1 AND 3
    AND len(list_filter(use_cases, lambda x: NOT list_contains({_CODES}, x))) = 0 AND len(list_distinct(use_cases)) = len(use_cases)
    AND NOT (list_contains(use_cases, 'U99') AND len(use_cases) > 1)
    AND ai_applicability IN (0, 1, 2) AND (ai_applicability = 0) = (len(use_cases) = 1 AND list_contains(use_cases, 'U99'))
), projects0 AS (
  SELECT 'train' AS source_split, row_id, project_id, project_name, project_objective, project_summary, current_issues, budget, responsible_ministry, project_start_year FROM train
  UNION ALL SELECT 'test', row_id, project_id, project_name, project_objective, project_summary, current_issues, budget, responsible_ministry, project_start_year FROM test
), projects AS (
  SELECT * EXCLUDE (k_, responsible_ministry), CASE WHEN responsible_ministry IN (SELECT ministry_name FROM bureaus) THEN responsible_ministry END AS responsible_ministry
  FROM (SELECT *, row_number() OVER (PARTITION BY source_split, project_id ORDER BY row_id DESC) AS k_ FROM projects0 WHERE project_id IS NOT NULL) WHERE k_ = 1
), joined AS (
  SELECT p.source_split, p.project_id, p.source_split || '::' || p.project_id AS project_key, p.budget, p.responsible_ministry, p.current_issues,
         v.project_start_year, v.policy_domain, v.admin_process, v.use_cases, v.ai_applicability
  FROM projects p JOIN valid v USING (source_split, project_id)
), long AS (
  SELECT * EXCLUDE (use_cases), unnest(use_cases) AS ai_usecase, ai_applicability = 2 AS is_high_app FROM joined
), theme AS (SELECT *, admin_process || '__' || ai_usecase AS theme_code FROM long)
"""
)

METRICS = (
    BASE
    + f"""
, prior AS (SELECT coalesce(avg(is_high_app::INT), 0) AS g FROM theme WHERE ai_usecase <> 'U99')
, mc AS (SELECT theme_code, sum(c * c) / (sum(c) * sum(c)) AS h, count(*) AS b FROM
         (SELECT theme_code, responsible_ministry, count(*)::DOUBLE AS c FROM theme WHERE is_high_app AND responsible_ministry IS NOT NULL GROUP BY ALL) GROUP BY ALL)
, dc AS (SELECT theme_code, sum(c * c) / (sum(c) * sum(c)) AS h, count(*) AS b FROM
         (SELECT theme_code, policy_domain, count(*)::DOUBLE AS c FROM theme WHERE is_high_app GROUP BY ALL) GROUP BY ALL)
, metrics AS (
  SELECT a.*, coalesce(mc.b, 0) AS ministry_breadth, coalesce(dc.b, 0) AS domain_breadth, mc.h AS ministry_hhi, dc.h AS domain_hhi,
         CASE WHEN mc.h IS NULL THEN dc.h WHEN dc.h IS NULL THEN mc.h ELSE (mc.h + dc.h) / 2 END AS concentration_hhi,
         high_app_project_count / project_count AS high_app_rate, (high_app_project_count + 20 * g) / (project_count + 20) AS high_app_rate_smoothed,
         {_FIT.format(c='admin_process')} + {_FIT.format(c='ai_usecase')} AS aiu_fit, ai_usecase <> 'U99' AND high_app_project_count > 0 AS ranking_eligible
  FROM (SELECT theme_code, admin_process, ai_usecase, count(*) AS project_count, count(*) FILTER (is_high_app) AS high_app_project_count,
               count(*) FILTER (is_high_app AND responsible_ministry IS NULL) AS no_ministry FROM theme GROUP BY ALL) a
  CROSS JOIN prior LEFT JOIN mc USING (theme_code) LEFT JOIN dc USING (theme_code)
)"""
)


def _pct(expr: str, cond: str = "ranking_eligible", part: str = "") -> str:
    known = f"({cond} AND ({expr}) IS NOT NULL)"
    by = f"PARTITION BY {part + ', ' if part else ''}{known}"
    return (
        f"CASE WHEN {known} THEN (rank() OVER ({by} ORDER BY {expr}) + (count(*) OVER ({by}, {expr}) - 1) / 2.0) / count(*) OVER ({by}) * 100 "
        f"WHEN {cond} THEN 0 END"
    )


SCORED = (
    METRICS
    + f"""
, comp AS (
  SELECT *, {_pct('high_app_project_count')} AS s1, {_pct('high_app_rate_smoothed')} AS s2, {_pct('ministry_breadth')} AS s3,
         {_pct('domain_breadth')} AS s4, {_pct('1 - concentration_hhi')} AS s5, CASE WHEN ranking_eligible THEN aiu_fit / 5 * 100 END AS s6
  FROM metrics
)"""
)
_WEIGHTED = {n: " + ".join(f"{w!r} * s{i}" for i, w in enumerate(p, 1)) for n, p in m.PROFILES.items()}
LEADERS = (
    SCORED
    + f"""
, leaders AS (SELECT theme_code FROM (SELECT *, {_WEIGHTED['strategic']} AS score FROM comp WHERE ranking_eligible) ORDER BY round(score, 9) DESC, theme_code LIMIT {LEADING})"""
)


def labels(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "ai_market_llm_features")


def projects(spark: SparkSession, base: str) -> DataFrame:
    return t.distinct_projects(table(spark, base, "train"), table(spark, base, "test"), table(spark, base, "bureaus"))


def long(spark: SparkSession, base: str) -> DataFrame:
    columns = ["source_split", "project_id", "budget", "responsible_ministry", "current_issues", "project_start_year"]
    return t.theme_long(t.join_taxonomy(projects(spark, base).select(*columns), t.valid_labels(labels(spark, base))))


THEME_COLUMNS = ["project_key", "project_start_year", "admin_process", "ai_usecase", "theme_code", "policy_domain", "responsible_ministry", "is_high_app"]


def themes(spark: SparkSession, base: str) -> DataFrame:
    """Themes in short rows, written once: metrics read them several times."""
    return written(long(spark, base).select(*THEME_COLUMNS))


def chosen(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the leading themes, written once."""
    rows = written(long(spark, base))
    return written(rows.join(F.broadcast(leading(rows).select("theme_code")), "theme_code", "left_semi"))


def leading(rows: DataFrame) -> DataFrame:
    """The first LEADING themes by strategic score, ties by code."""
    scored = m.theme_scores(m.theme_metrics(rows.select(*THEME_COLUMNS))).where("ranking_eligible")
    return scored.orderBy(F.round("strategic_score", 9).desc(), "theme_code").limit(LEADING)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(
    "yearly_theme_metrics",
    f"""WITH {BASE} SELECT project_start_year, admin_process, ai_usecase, count(DISTINCT project_key) AS project_count,
    count(DISTINCT CASE WHEN is_high_app THEN project_key END) AS high_app_project_count,
    round(count(DISTINCT CASE WHEN is_high_app THEN project_key END) / count(DISTINCT project_key), 6) AS high_app_rate FROM theme GROUP BY ALL""",
)
def yearly_theme_metrics(spark: SparkSession, base: str) -> DataFrame:
    return rounded(m.yearly_theme_metrics(long(spark, base)))


@query(
    "theme_metrics",
    f"""WITH {METRICS} SELECT theme_code, admin_process, ai_usecase, project_count, high_app_project_count, round(high_app_rate, 6) AS high_app_rate,
    round(high_app_rate_smoothed, 6) AS high_app_rate_smoothed, ministry_breadth, domain_breadth, round(ministry_hhi, 6) AS ministry_hhi, round(domain_hhi, 6) AS domain_hhi,
    round(concentration_hhi, 6) AS concentration_hhi, round(no_ministry / nullif(high_app_project_count, 0), 6) AS high_app_ministry_missing_rate, aiu_fit, ranking_eligible FROM metrics""",
)
def theme_metrics(spark: SparkSession, base: str) -> DataFrame:
    return rounded(m.theme_metrics(themes(spark, base)).drop("admin_fit", "usecase_fit", "global_high_app_rate_prior"))


@query(
    "theme_scores",
    f"""WITH {SCORED}, w AS (SELECT *, {_WEIGHTED['strategic']} AS score FROM comp)
    SELECT theme_code, round(s1, 6) AS high_app_count_score, round(s2, 6) AS smoothed_rate_score, round(s3, 6) AS ministry_breadth_score, round(s4, 6) AS domain_breadth_score,
    round(s5, 6) AS low_concentration_score, round(s6, 6) AS aiu_fit_score, round(score, 6) AS strategic_score,
    rank() OVER (ORDER BY round(score, 9) DESC) AS overall_rank FROM w WHERE ranking_eligible""",
)
def theme_scores(spark: SparkSession, base: str) -> DataFrame:
    scored = m.theme_scores(m.theme_metrics(themes(spark, base))).where("ranking_eligible")
    return rounded(scored.select("theme_code", *[f"{c}_score" for c in m.COMPONENTS], "strategic_score", "overall_rank"))


_PROFILE_SQL = " UNION ALL ".join(f"SELECT theme_code, '{n}' AS profile, {w} AS score FROM comp WHERE ranking_eligible" for n, w in _WEIGHTED.items())


@query(
    "weight_profiles",
    f"""WITH {SCORED}, u AS ({_PROFILE_SQL})
    SELECT theme_code, profile, round(score, 6) AS score, rank() OVER (PARTITION BY profile ORDER BY round(score, 9) DESC) AS rank FROM u""",
)
def weight_profiles(spark: SparkSession, base: str) -> DataFrame:
    return rounded(m.weight_profiles(m.theme_metrics(themes(spark, base))))


@query(
    "rank_sensitivity",
    f"""WITH {SCORED}, u AS ({_PROFILE_SQL}), r AS (SELECT theme_code, profile, rank() OVER (PARTITION BY profile ORDER BY round(score, 9) DESC) AS rank FROM u)
    SELECT theme_code, max(rank) FILTER (profile = 'strategic') AS strategic_rank, max(rank) FILTER (profile = 'equal') AS equal_rank,
    max(rank) FILTER (profile = 'market_size') AS market_size_rank, min(rank) AS best_rank, max(rank) AS worst_rank, max(rank) - min(rank) AS rank_spread FROM r GROUP BY ALL""",
)
def rank_sensitivity(spark: SparkSession, base: str) -> DataFrame:
    return m.rank_sensitivity(m.weight_profiles(m.theme_metrics(themes(spark, base))))


@query(
    "score_contributions",
    f"WITH {SCORED} "
    + " UNION ALL ".join(f"SELECT theme_code, '{n}' AS component, round({w!r} * s{i}, 6) AS contribution FROM comp WHERE ranking_eligible" for i, (n, w) in enumerate(zip(m.COMPONENTS, m.PROFILES["strategic"]), 1)),
)
def score_contributions(spark: SparkSession, base: str) -> DataFrame:
    return rounded(m.score_contributions(m.theme_metrics(themes(spark, base))))


@query(
    "taxonomy_join_diagnostics",
    f"""WITH {BASE}, l AS (SELECT source_split, project_id, CASE WHEN regexp_full_match(project_start_year, '[0-9]{{4}}') THEN project_start_year::INT END AS y, responsible_ministry FROM projects),
    a AS (SELECT * FROM l WHERE y >= 2020), b AS (SELECT source_split, project_id, project_start_year AS z FROM repaired WHERE project_start_year >= 2020),
    f AS (SELECT a.project_id AS l, b.project_id AS r, y, z, responsible_ministry FROM a FULL JOIN b ON a.source_split = b.source_split AND a.project_id = b.project_id)
    SELECT count(*) FILTER (r IS NULL) AS source_only, count(*) FILTER (l IS NULL) AS feature_only, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS merged,
    count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND y <> z) AS year_mismatch, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND responsible_ministry IS NULL) AS missing_ministry FROM f""",
)
def taxonomy_join_diagnostics(spark: SparkSession, base: str) -> DataFrame:
    return t.join_diagnostics(projects(spark, base), t.repaired_labels(labels(spark, base)), 2020)


@query("theme_explode", f"WITH {BASE} SELECT project_key, project_start_year, policy_domain, theme_code, is_high_app, ai_usecase = 'U99' AS is_u99 FROM theme")
def theme_explode(spark: SparkSession, base: str) -> DataFrame:
    return long(spark, base).select("project_key", "project_start_year", "policy_domain", "theme_code", "is_high_app", "is_u99")


_TEXTS = "[" + ", ".join(f"'{x}'" for x in t.PROCESSES) + "]"


@query(
    "taxonomy_violations",
    f"""WITH {LABELS}, v AS (SELECT source_split, project_id, unnest(list_filter([
      CASE WHEN policy_domain IS NULL OR NOT ({_OK_DOMAIN}) THEN 'policy_domain' END, CASE WHEN admin_process IS NULL OR NOT ({_OK_PROCESS}) THEN 'admin_process' END,
      CASE WHEN use_cases IS NULL OR len(use_cases) < 1 OR len(use_cases) > 3 THEN 'use_case_count' END,
      CASE WHEN len(list_filter(use_cases, lambda x: NOT list_contains({_CODES}, x))) > 0 THEN 'use_case_code' END,
      CASE WHEN len(list_distinct(use_cases)) < len(use_cases) THEN 'use_case_repeated' END,
      CASE WHEN list_contains(use_cases, 'U99') AND len(use_cases) > 1 THEN 'none_with_others' END,
      CASE WHEN ai_applicability IS NULL OR ai_applicability NOT IN (0, 1, 2) THEN 'applicability' END,
      CASE WHEN (ai_applicability = 0) <> (len(use_cases) = 1 AND list_contains(use_cases, 'U99')) THEN 'applicability_and_none' END], lambda x: x IS NOT NULL)) AS rule FROM repaired)
    SELECT rule, source_split, count(*) AS n FROM v GROUP BY ALL""",
)
def taxonomy_violations(spark: SparkSession, base: str) -> DataFrame:
    r = t.repaired_labels(labels(spark, base))
    broken = t.rule_violations(F.col("policy_domain"), F.col("admin_process"), F.col("use_cases"), F.col("ai_applicability"))
    return r.select("source_split", F.explode(broken).alias("rule")).groupBy("rule", "source_split").agg(F.count("*").alias("n"))


@query(
    "usecase_decode",
    f"WITH {LABELS} SELECT source_split, project_id, len(use_cases) AS n_codes, array_to_string(use_cases, ',') AS codes FROM repaired WHERE ai_usecase IS NOT NULL",
)
def usecase_decode(spark: SparkSession, base: str) -> DataFrame:
    r = t.repaired_labels(labels(spark, base)).where("ai_usecase IS NOT NULL")
    return r.select("source_split", "project_id", F.size("use_cases").cast("long").alias("n_codes"), F.array_join("use_cases", ",").alias("codes"))


@query("theme_crosstab_cube", f"WITH {BASE} SELECT admin_process, ai_usecase, count(*) AS rows FROM theme GROUP BY CUBE (admin_process, ai_usecase)")
def theme_crosstab_cube(spark: SparkSession, base: str) -> DataFrame:
    return m.theme_cube(long(spark, base))


@query(
    "theme_ministry_mix",
    f"""WITH {BASE}, c AS (SELECT theme_code, responsible_ministry, count(*) AS n FROM theme WHERE responsible_ministry IS NOT NULL GROUP BY ALL),
    top AS (SELECT responsible_ministry FROM c GROUP BY ALL ORDER BY sum(n) DESC, responsible_ministry LIMIT 15)
    SELECT * FROM (SELECT theme_code, responsible_ministry, n, round(n / sum(n) OVER (PARTITION BY theme_code), 6) AS share FROM c) WHERE responsible_ministry IN (SELECT * FROM top)""",
)
def theme_ministry_mix(spark: SparkSession, base: str) -> DataFrame:
    return rounded(m.composition(long(spark, base), "theme_code", "responsible_ministry", 15)).select("theme_code", "responsible_ministry", "n", "share")


@query(
    "theme_usecase_crosstab",
    f"""WITH {BASE} SELECT admin_process, """ + ", ".join(f"count(*) FILTER (ai_usecase = '{u}') AS {u}" for u in t.USE_CASES) + " FROM theme GROUP BY ALL",
)
def theme_usecase_crosstab(spark: SparkSession, base: str) -> DataFrame:
    return long(spark, base).groupBy("admin_process").pivot("ai_usecase", t.USE_CASES).agg(F.count("project_key")).fillna(0)


@query(
    "trend_grid",
    f"""WITH {BASE}, top AS (SELECT theme_code FROM theme GROUP BY ALL ORDER BY count(*) DESC, theme_code LIMIT 8),
    y AS (SELECT unnest(generate_series((SELECT min(project_start_year) FROM theme), (SELECT max(project_start_year) FROM theme))) AS project_start_year),
    a AS (SELECT theme_code, project_start_year, count(DISTINCT project_key) AS c, count(DISTINCT CASE WHEN is_high_app THEN project_key END) AS h FROM theme GROUP BY ALL)
    SELECT theme_code, y.project_start_year::INT AS project_start_year, coalesce(c, 0) AS project_count, coalesce(h, 0) AS high_app_project_count, round(h / c, 6) AS high_app_rate
    FROM top CROSS JOIN y LEFT JOIN a USING (theme_code, project_start_year)""",
)
def trend_grid(spark: SparkSession, base: str) -> DataFrame:
    rows = long(spark, base)
    top = rows.groupBy("theme_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme_code").limit(8).select("theme_code")
    return rounded(m.year_theme_grid(rows, top))


_CHOSEN = "(SELECT theme_code FROM leaders)"
_BUDGET = "CASE WHEN is_high_app AND budget >= 0 AND NOT isnan(budget) AND abs(budget) < 'infinity'::DOUBLE THEN budget END"
DOMAIN = (
    LEADERS
    + f"""
, sel AS (SELECT *, {_BUDGET} AS b FROM theme WHERE theme_code IN {_CHOSEN})
, yr AS (SELECT max(project_start_year) - 1 AS r, max(project_start_year) - 3 AS p FROM sel)
, rk AS (SELECT *, row_number() OVER (PARTITION BY theme_code, policy_domain ORDER BY b DESC NULLS LAST, project_key) AS k_ FROM sel)
, pr AS (SELECT theme_code, avg(is_high_app::INT) AS prior FROM sel GROUP BY ALL)
, hh AS (SELECT theme_code, policy_domain, sum(c * c) / (sum(c) * sum(c)) AS ministry_hhi FROM
   (SELECT theme_code, policy_domain, responsible_ministry, count(*)::DOUBLE AS c FROM sel WHERE is_high_app AND responsible_ministry IS NOT NULL GROUP BY ALL) GROUP BY ALL)
, dm0 AS (SELECT theme_code, policy_domain, count(*) AS project_count, count(*) FILTER (is_high_app) AS high_app_project_count,
   count(DISTINCT CASE WHEN is_high_app THEN responsible_ministry END) AS ministry_breadth, sum(b) AS high_app_budget_total, median(b) AS high_app_budget_median,
   count(b) AS nb, sum(b * b) AS sq, sum(b) FILTER (k_ <= 3) AS top3,
   avg((lower(trim(coalesce(current_issues, ''))) NOT IN ('', 'nan', 'none', 'null', '[欠損]'))::INT) AS issue_coverage_rate,
   count(*) FILTER (project_start_year >= r) AS recent_project_count, count(*) FILTER (project_start_year >= r AND is_high_app) AS recent_high_app_project_count,
   count(*) FILTER (project_start_year >= p AND project_start_year < r) AS previous_project_count,
   count(*) FILTER (project_start_year >= p AND project_start_year < r AND is_high_app) AS previous_high_app_project_count
   FROM rk CROSS JOIN yr GROUP BY ALL)
, dm AS (SELECT dm0.*, ministry_hhi, high_app_project_count / project_count AS high_app_rate, (high_app_project_count + 10 * prior) / (project_count + 10) AS high_app_rate_smoothed,
   sq / nullif(high_app_budget_total * high_app_budget_total, 0) AS high_app_budget_hhi, top3 / nullif(high_app_budget_total, 0) AS high_app_top3_budget_share,
   nb / nullif(high_app_project_count, 0) AS high_app_budget_nonmissing_rate,
   recent_high_app_project_count / nullif(recent_project_count, 0) - previous_high_app_project_count / nullif(previous_project_count, 0) AS high_app_rate_momentum,
   high_app_project_count > 0 AS ranking_eligible FROM dm0 JOIN pr USING (theme_code) LEFT JOIN hh USING (theme_code, policy_domain))
"""
)
_DOMAIN_COLUMNS = ["theme_code", "policy_domain", "project_count", "high_app_project_count", "ministry_breadth", "recent_project_count", "recent_high_app_project_count", "previous_project_count", "previous_high_app_project_count", "ranking_eligible"]
_DOMAIN_DOUBLES = ["high_app_rate", "high_app_rate_smoothed", "ministry_hhi", "high_app_budget_total", "high_app_budget_median", "high_app_budget_hhi", "high_app_top3_budget_share", "high_app_budget_nonmissing_rate", "issue_coverage_rate", "high_app_rate_momentum"]


def observed(rows: DataFrame) -> list[str]:
    """The leading themes, at most LEADING."""
    return sorted(r[0] for r in rows.select("theme_code").distinct().collect())


def domain_metrics_of(spark: SparkSession, base: str) -> DataFrame:
    rows = chosen(spark, base)
    return d.domain_metrics(rows, observed(rows))


@query("theme_domain_metrics", f"WITH {DOMAIN} SELECT {', '.join(_DOMAIN_COLUMNS)}, {', '.join(f'round({c}, 4) AS {c}' for c in _DOMAIN_DOUBLES)} FROM dm")
def theme_domain_metrics(spark: SparkSession, base: str) -> DataFrame:
    return rounded(domain_metrics_of(spark, base).select(*_DOMAIN_COLUMNS, *_DOMAIN_DOUBLES), 4)


_COMPONENT_SQL = {n: "1 - ministry_hhi" if n == "low_ministry_concentration" else n for n in d.WEIGHTS}
DOMAIN_SCORED = (
    DOMAIN
    + f"""
, ds AS (SELECT *, {', '.join(f"{_pct(e, 'ranking_eligible', 'theme_code')} AS s{i}" for i, e in enumerate(_COMPONENT_SQL.values(), 1))} FROM dm)
, dw AS (SELECT *, CASE WHEN ranking_eligible THEN {' + '.join(f'{w} * s{i}' for i, w in enumerate(d.WEIGHTS.values(), 1))} END AS score FROM ds)
, dr AS (SELECT *, CASE WHEN ranking_eligible THEN rank() OVER (PARTITION BY theme_code, ranking_eligible ORDER BY round(score, 9) DESC) END AS domain_rank_within_theme,
   CASE WHEN ranking_eligible THEN rank() OVER (PARTITION BY ranking_eligible ORDER BY round(score, 9) DESC) END AS portfolio_rank FROM dw)
"""
)


@query("theme_domain_scores", f"WITH {DOMAIN_SCORED} SELECT theme_code, policy_domain, round(score, 6) AS domain_opportunity_score, domain_rank_within_theme, portfolio_rank FROM dr WHERE ranking_eligible")
def theme_domain_scores(spark: SparkSession, base: str) -> DataFrame:
    scored = d.domain_scores(domain_metrics_of(spark, base)).where("ranking_eligible")
    return rounded(scored.select("theme_code", "policy_domain", "domain_opportunity_score", "domain_rank_within_theme", "portfolio_rank"))


@query("domain_effective_weights", " UNION ALL ".join(f"SELECT '{n}' AS component, {w}::DOUBLE AS weight, {w}::DOUBLE AS effective_weight" for n, w in d.WEIGHTS.items()))
def domain_effective_weights(spark: SparkSession, base: str) -> DataFrame:
    return rounded(d.effective_weights(domain_metrics_of(spark, base)))


@query(
    "domain_yearly",
    f"""WITH {LEADERS} SELECT project_start_year, theme_code, policy_domain, count(DISTINCT project_key) AS project_count, count(DISTINCT CASE WHEN is_high_app THEN project_key END) AS high_app_project_count,
    round(count(DISTINCT CASE WHEN is_high_app THEN project_key END) / count(DISTINCT project_key), 6) AS high_app_rate FROM theme WHERE theme_code IN {_CHOSEN} GROUP BY ALL""",
)
def domain_yearly(spark: SparkSession, base: str) -> DataFrame:
    rows = chosen(spark, base)
    return rounded(m.yearly_theme_metrics(d.chosen_rows(rows, observed(rows)), ["theme_code", "policy_domain"]))


ACCOUNTS = (
    LEADERS
    + f""", ac AS (SELECT theme_code, policy_domain, responsible_ministry, count(*) AS project_count, count(*) FILTER (is_high_app) AS high_app_project_count,
   sum({_BUDGET}) AS high_app_budget_total, max(project_start_year) AS latest_observed_year FROM theme WHERE theme_code IN {_CHOSEN} AND responsible_ministry IS NOT NULL GROUP BY ALL)
, ar AS (SELECT *, rank() OVER (PARTITION BY theme_code, policy_domain ORDER BY high_app_project_count DESC) AS account_rank_within_theme_domain FROM ac)"""
)


@query("ministry_accounts", f"WITH {ACCOUNTS} SELECT * EXCLUDE (high_app_budget_total), round(high_app_budget_total, 4) AS high_app_budget_total, round(high_app_project_count / project_count, 4) AS high_app_rate FROM ar")
def ministry_accounts(spark: SparkSession, base: str) -> DataFrame:
    rows = chosen(spark, base)
    return rounded(d.ministry_accounts(rows, observed(rows)), 4)


@query(
    "priority_accounts",
    f"""WITH {ACCOUNTS}, o AS (SELECT *, row_number() OVER (PARTITION BY theme_code, policy_domain ORDER BY account_rank_within_theme_domain, responsible_ministry) AS k_ FROM ar)
    SELECT theme_code, policy_domain, string_agg(responsible_ministry, ' / ' ORDER BY k_) AS priority_ministries, sum(high_app_project_count)::BIGINT AS priority_high_app_count FROM o WHERE k_ <= 3 GROUP BY ALL""",
)
def priority_accounts(spark: SparkSession, base: str) -> DataFrame:
    rows = chosen(spark, base)
    return d.priority_accounts(d.ministry_accounts(rows, observed(rows)))


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(
    "service_cards",
    f"""WITH {DOMAIN_SCORED}, c AS (SELECT *, substr(theme_code, 1, 3) AS a, substr(theme_code, 6) AS u FROM dr WHERE domain_rank_within_theme <= 3)
    SELECT theme_code, policy_domain, domain_rank_within_theme, portfolio_rank, project_count, high_app_project_count, ministry_breadth,
    {_case('a', {k: v[0] for k, v in d.PROCESS_OFFERS.items()})} || ': ' || {_case('u', d.USE_CASE_OFFERS)} AS service_name, {_case('a', {k: v[1] for k, v in d.PROCESS_OFFERS.items()})} AS measured_by,
    high_app_project_count || ' of ' || project_count || ' projects, ' || ministry_breadth || ' ministries' AS evidence FROM c""",
)
def service_cards(spark: SparkSession, base: str) -> DataFrame:
    return d.service_cards(d.domain_scores(domain_metrics_of(spark, base)))


@query(
    "representative_projects",
    f"""WITH {DOMAIN_SCORED}, pairs AS (SELECT theme_code, policy_domain FROM dr WHERE domain_rank_within_theme <= 3),
    r AS (SELECT t.*, {_BUDGET} AS b, row_number() OVER (PARTITION BY project_key ORDER BY t.theme_code, t.policy_domain) AS f FROM theme t JOIN pairs USING (theme_code, policy_domain) WHERE is_high_app),
    p AS (SELECT *, row_number() OVER (PARTITION BY theme_code, policy_domain ORDER BY b DESC NULLS LAST, project_key) AS place FROM r WHERE f = 1)
    SELECT theme_code, policy_domain, place, project_key, b AS budget FROM p WHERE place <= 5""",
)
def representative_projects(spark: SparkSession, base: str) -> DataFrame:
    rows = chosen(spark, base)
    scored = d.domain_scores(d.domain_metrics(rows, observed(rows)))
    return d.representative_projects(rows, scored.where("domain_rank_within_theme <= 3").select("theme_code", "policy_domain"))


@query(
    "portfolio",
    f"""WITH {DOMAIN_SCORED}, ac AS (SELECT theme_code, policy_domain, responsible_ministry, count(*) FILTER (is_high_app) AS h FROM sel WHERE responsible_ministry IS NOT NULL GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY theme_code, policy_domain ORDER BY h DESC, responsible_ministry) AS k_ FROM ac),
    p AS (SELECT theme_code, policy_domain, string_agg(responsible_ministry, ' / ' ORDER BY k_) AS priority_ministries, sum(h)::BIGINT AS priority_high_app_count FROM o WHERE k_ <= 3 GROUP BY ALL)
    SELECT theme_code, policy_domain, portfolio_rank, priority_ministries, priority_high_app_count FROM dr LEFT JOIN p USING (theme_code, policy_domain) WHERE ranking_eligible""",
)
def portfolio(spark: SparkSession, base: str) -> DataFrame:
    """Scored domains with their first accounts."""
    rows = chosen(spark, base)
    scored = d.domain_scores(d.domain_metrics(rows, observed(rows))).where("ranking_eligible").select("theme_code", "policy_domain", "portfolio_rank")
    return scored.join(d.priority_accounts(d.ministry_accounts(rows, observed(rows))), ["theme_code", "policy_domain"], "left")


@query(
    "population_diagnostics",
    f"""WITH {BASE} SELECT count(*) AS projects, round(avg((use_cases = ['U99'])::INT), 6) AS no_use_rate, round(avg((len(use_cases) > 1)::INT), 6) AS several_uses_rate,
    round(avg((ai_applicability = 2)::INT), 6) AS high_app_rate, count(DISTINCT responsible_ministry) AS ministries, round(avg((responsible_ministry IS NULL)::INT), 6) AS no_ministry_rate FROM joined""",
)
def population_diagnostics(spark: SparkSession, base: str) -> DataFrame:
    rows = t.join_taxonomy(projects(spark, base).select("source_split", "project_id", "responsible_ministry", "project_start_year"), t.valid_labels(labels(spark, base)))
    none = F.col("use_cases") == F.array(F.lit(t.NO_USE))
    return rounded(rows.agg(
        F.count("*").alias("projects"), F.avg(none.cast("int")).alias("no_use_rate"), F.avg((F.size("use_cases") > 1).cast("int")).alias("several_uses_rate"),
        F.avg((F.col("ai_applicability") == 2).cast("int")).alias("high_app_rate"), F.count_distinct("responsible_ministry").alias("ministries"),
        F.avg(F.col("responsible_ministry").isNull().cast("int")).alias("no_ministry_rate"),
    ))


@query("top_themes", f"WITH {SCORED}, w AS (SELECT *, {_WEIGHTED['strategic']} AS score FROM comp WHERE ranking_eligible) SELECT theme_code, round(score, 6) AS strategic_score FROM w ORDER BY round(score, 9) DESC, theme_code LIMIT {LEADING}")
def top_themes(spark: SparkSession, base: str) -> DataFrame:
    """The three themes that a portfolio starts from."""
    return rounded(leading(themes(spark, base)).select("theme_code", "strategic_score"))
