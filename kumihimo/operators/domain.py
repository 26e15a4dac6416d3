"""Policy-domain opportunities within chosen themes: metrics, scores, accounts and cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kumihimo.functions.expr import percent_rank_of, ratio
from kumihimo.operators.market import check_weights, concentration

# Weights of the components of a domain's score.
WEIGHTS = {
    "high_app_project_count": 0.25, "high_app_rate_smoothed": 0.15, "ministry_breadth": 0.15, "low_ministry_concentration": 0.10,
    "high_app_budget_total": 0.15, "recent_high_app_project_count": 0.10, "issue_coverage_rate": 0.10,
}
# Words that stand for an empty text.
NULL_WORDS = ["", "nan", "none", "null", "[欠損]"]

# An editable catalogue: what a service for a process offers first, and what it is measured by.
PROCESS_OFFERS = {
    "A01": ("research support", "time per study"), "A02": ("policy design support", "drafting time"), "A03": ("application review support", "cases per day"),
    "A04": ("grant handling support", "days to payment"), "A05": ("inspection support", "hit rate of inspections"), "A06": ("monitoring support", "indicator freshness"),
    "A07": ("help desk support", "first-contact resolution"), "A08": ("outreach support", "reach"), "A09": ("procurement support", "contract lead time"),
    "A10": ("field service support", "handling time"), "A11": ("office work support", "hours saved"), "A12": ("training support", "completion rate"),
    "A13": ("pilot support", "pilots in production"),
}
USE_CASE_OFFERS = {
    "U01": "document search", "U02": "summaries and extraction", "U03": "document drafting", "U04": "classification", "U05": "scoring", "U06": "forecasting",
    "U07": "anomaly detection", "U08": "optimisation", "U09": "image and sensor analysis", "U10": "dialogue", "U11": "process automation", "U99": "no use case",
}


def chosen_rows(long: DataFrame, themes: Sequence[str]) -> DataFrame:
    """Rows of the given themes; a theme that isn't observed is an error."""
    wanted = list(dict.fromkeys(themes))
    rows = long.where(F.col("theme_code").isin(wanted))
    seen = {r[0] for r in rows.select("theme_code").distinct().collect()}
    if missing := [t for t in wanted if t not in seen]:
        raise ValueError(f"no project has these themes: {missing}")
    return rows


def has_text(c: str) -> Column:
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", ""))
    return ~plain.isin(NULL_WORDS)


def domain_metrics(long: DataFrame, themes: Sequence[str], recent_years: int = 2, prior_strength: float = 10.0) -> DataFrame:
    """Counts, rates, budgets and momentum of every theme and policy domain.

    The recent years are the last ones of all chosen rows; negative and unusable budgets
    are missing; rates over nothing are NULL.
    """
    if recent_years <= 0:
        raise ValueError("the recent span needs one year or more")
    if prior_strength < 0:
        raise ValueError("prior_strength must not be negative")
    rows = chosen_rows(long, themes)
    latest = rows.agg(F.max("project_start_year")).first()[0]
    recent_start = latest - recent_years + 1
    previous_start = recent_start - recent_years
    keys = ["theme_code", "policy_domain"]
    high, year = F.col("is_high_app"), F.col("project_start_year")
    recent, previous = year >= recent_start, (year >= previous_start) & (year < recent_start)
    budget = F.when(high & (F.col("budget") >= 0) & ~F.isnan("budget") & (F.abs("budget") < float("inf")), F.col("budget"))
    top = Window.partitionBy(*keys).orderBy(F.desc("_budget"), "project_key")
    with_budget = rows.withColumn("_budget", budget)
    # a filter on the row number is applied before the shuffle too, so no group is gathered
    top3 = with_budget.where("_budget IS NOT NULL").withColumn("_at", F.row_number().over(top)).where("_at <= 3").groupBy(*keys).agg(F.sum("_budget").alias("_top3"))
    main = with_budget.groupBy(*keys).agg(
        F.first("admin_process").alias("admin_process"), F.first("ai_usecase").alias("ai_usecase"),
        F.count("*").alias("project_count"), F.count_if(high).alias("high_app_project_count"),
        F.count_if(high & F.col("responsible_ministry").isNull()).alias("_no_ministry"),
        F.count_distinct(F.when(high, F.col("responsible_ministry"))).alias("ministry_breadth"),
        F.sum("_budget").alias("high_app_budget_total"), F.median("_budget").alias("high_app_budget_median"), F.count("_budget").alias("_with_budget"),
        F.sum(F.col("_budget") * F.col("_budget")).alias("_squares"),
        F.avg(has_text("current_issues").cast("int")).alias("issue_coverage_rate"),
        F.count_if(recent).alias("recent_project_count"), F.count_if(recent & high).alias("recent_high_app_project_count"),
        F.count_if(previous).alias("previous_project_count"), F.count_if(previous & high).alias("previous_high_app_project_count"),
        F.max("project_start_year").alias("latest_observed_year"),
    )
    priors = rows.groupBy("theme_code").agg(F.avg(high.cast("int")).alias("theme_high_app_rate_prior"))
    hhi = concentration(rows.where(high), keys, "responsible_ministry", "ministry_hhi")
    joined = main.join(priors, "theme_code").join(hhi, keys, "left").join(top3, keys, "left")
    total = F.when(F.col("high_app_budget_total") > 0, F.col("high_app_budget_total"))
    recent_rate, previous_rate = ratio("recent_high_app_project_count", "recent_project_count"), ratio("previous_high_app_project_count", "previous_project_count")
    return joined.select(
        *keys, "admin_process", "ai_usecase", "project_count", "high_app_project_count",
        ratio("high_app_project_count", "project_count").alias("high_app_rate"),
        ((F.col("high_app_project_count") + prior_strength * F.col("theme_high_app_rate_prior")) / (F.col("project_count") + prior_strength)).alias("high_app_rate_smoothed"),
        "theme_high_app_rate_prior", "ministry_breadth", "ministry_hhi", ratio("_no_ministry", "high_app_project_count").alias("high_app_ministry_missing_rate"),
        "high_app_budget_total", "high_app_budget_median", ratio("_with_budget", "high_app_project_count").alias("high_app_budget_nonmissing_rate"),
        ratio("_squares", total * total).alias("high_app_budget_hhi"), ratio("_top3", total).alias("high_app_top3_budget_share"), "issue_coverage_rate",
        F.lit(recent_start).alias("recent_start_year"), "recent_project_count", "recent_high_app_project_count", recent_rate.alias("recent_high_app_rate"),
        F.lit(previous_start).alias("previous_start_year"), "previous_project_count", "previous_high_app_project_count", previous_rate.alias("previous_high_app_rate"),
        (recent_rate - previous_rate).alias("high_app_rate_momentum"), "latest_observed_year", (F.col("high_app_project_count") > 0).alias("ranking_eligible"),
    )


def component_inputs() -> dict[str, Column]:
    return {n: 1 - F.col("ministry_hhi") if n == "low_ministry_concentration" else F.col(n).cast("double") for n in WEIGHTS}


def effective_weights(metrics: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """component, weight, effective_weight: a component no eligible row has gives its weight to the others."""
    check_weights(weights, list(WEIGHTS))
    has = metrics.where("ranking_eligible").agg(*[F.count(v).alias(n) for n, v in component_inputs().items()]).first()
    kept = sum(w for n, w in weights.items() if has[n])
    if kept <= 0:
        raise ValueError("nothing is left to score by")
    rows = [(n, w, w / kept if has[n] else 0.0) for n, w in weights.items()]
    return metrics.sparkSession.createDataFrame(rows, "component string, weight double, effective_weight double")


def domain_scores(metrics: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Percentile scores within the theme, weighted score, and both ranks of eligible domains."""
    effective = {r["component"]: r["effective_weight"] for r in effective_weights(metrics, weights).collect()}
    eligible = F.col("ranking_eligible")
    scores = {}
    for name, value in component_inputs().items():
        known = eligible & value.isNotNull()
        if effective[name] > 0 or weights[name] == 0:
            scores[f"{name}_score"] = F.when(known, percent_rank_of(value, known, ["theme_code"]) * 100).when(eligible, F.lit(0.0))
        else:
            scores[f"{name}_score"] = F.lit(None).cast("double")
    scored = metrics.withColumns(scores)
    total = sum((F.coalesce(f"{n}_score", F.lit(0.0)) * w for n, w in effective.items()), F.lit(0.0))
    scored = scored.withColumn("domain_opportunity_score", F.when(eligible, total))
    order = F.round("domain_opportunity_score", 9).desc()
    return scored.withColumns({
        "domain_rank_within_theme": F.when(eligible, F.rank().over(Window.partitionBy("theme_code", "ranking_eligible").orderBy(order))),
        "portfolio_rank": F.when(eligible, F.rank().over(Window.partitionBy("ranking_eligible").orderBy(order))),
    })


def ministry_accounts(long: DataFrame, themes: Sequence[str]) -> DataFrame:
    """Counts, budget and rank of every ministry within a theme and domain."""
    rows = chosen_rows(long, themes).where("responsible_ministry IS NOT NULL")
    keys = ["theme_code", "policy_domain", "responsible_ministry"]
    high = F.col("is_high_app")
    budget = F.when(high & (F.col("budget") >= 0) & ~F.isnan("budget") & (F.abs("budget") < float("inf")), F.col("budget"))
    per = rows.groupBy(*keys).agg(F.count("*").alias("project_count"), F.count_if(high).alias("high_app_project_count"), F.sum(budget).alias("high_app_budget_total"), F.max("project_start_year").alias("latest_observed_year"))
    rank = F.rank().over(Window.partitionBy("theme_code", "policy_domain").orderBy(F.desc("high_app_project_count")))
    return per.withColumn("high_app_rate", ratio("high_app_project_count", "project_count")).withColumn("account_rank_within_theme_domain", rank)


def priority_accounts(accounts: DataFrame, n: int = 3) -> DataFrame:
    """Per theme and domain the first ``n`` ministries as one text, and their projects."""
    order = Window.partitionBy("theme_code", "policy_domain").orderBy("account_rank_within_theme_domain", "responsible_ministry")
    first = accounts.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n)
    listed = first.groupBy("theme_code", "policy_domain").agg(F.sort_array(F.collect_list(F.struct("_at", "responsible_ministry"))).alias("m"), F.sum("high_app_project_count").alias("priority_high_app_count"))
    return listed.select("theme_code", "policy_domain", F.array_join(F.transform("m", lambda x: x["responsible_ministry"]), " / ").alias("priority_ministries"), "priority_high_app_count")


def service_cards(scored: DataFrame, n: int = 3) -> DataFrame:
    """Evidence of the first ``n`` domains of each theme with the catalogue's offers; ties are kept."""
    if n <= 0:
        raise ValueError("n must be positive")
    top = scored.where(F.col("domain_rank_within_theme") <= n)
    offer = F.create_map(*[F.lit(x) for k, v in PROCESS_OFFERS.items() for x in (k, v[0])])
    measure = F.create_map(*[F.lit(x) for k, v in PROCESS_OFFERS.items() for x in (k, v[1])])
    use = F.create_map(*[F.lit(x) for kv in USE_CASE_OFFERS.items() for x in kv])
    return top.select(
        "theme_code", "policy_domain", "domain_rank_within_theme", "portfolio_rank", "project_count", "high_app_project_count", "ministry_breadth",
        F.concat(F.element_at(offer, F.col("admin_process")), F.lit(": "), F.element_at(use, F.col("ai_usecase"))).alias("service_name"),
        F.element_at(measure, F.col("admin_process")).alias("measured_by"),
        F.concat(F.col("high_app_project_count").cast("string"), F.lit(" of "), F.col("project_count").cast("string"), F.lit(" projects, "), F.col("ministry_breadth").cast("string"), F.lit(" ministries")).alias("evidence"),
    )


def representative_projects(long: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """High-applicability projects of the pairs by budget, each project under its first pair only."""
    rows = long.where("is_high_app").join(pairs, ["theme_code", "policy_domain"])
    usable = F.when((F.col("budget") >= 0) & ~F.isnan("budget") & (F.abs("budget") < float("inf")), F.col("budget"))
    rows = rows.withColumn("_budget", usable)
    first = Window.partitionBy("project_key").orderBy("theme_code", "policy_domain")
    once = rows.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    order = Window.partitionBy("theme_code", "policy_domain").orderBy(F.col("_budget").desc_nulls_last(), "project_key")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("theme_code", "policy_domain", "place", "project_key", F.col("_budget").alias("budget"))
