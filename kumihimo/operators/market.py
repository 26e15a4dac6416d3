"""Theme metrics, percentile scores and rankings over projects by process and use case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kumihimo.functions.expr import percent_rank_of, ratio

# How well a process and a use case fit a delivery of intelligent systems.
PROCESS_FIT = {
    "A01": 2, "A02": 2, "A03": 1, "A04": 1, "A05": 1, "A06": 2, "A07": 1, "A08": 1, "A09": 0, "A10": 1, "A11": 1, "A12": 2, "A13": 2,
}
USE_CASE_FIT = {
    "U01": 2, "U02": 2, "U03": 2, "U04": 3, "U05": 3, "U06": 3, "U07": 3, "U08": 3, "U09": 3, "U10": 2, "U11": 3, "U99": 0,
}
MOST_FIT = 5

COMPONENTS = ["high_app_count", "smoothed_rate", "ministry_breadth", "domain_breadth", "low_concentration", "aiu_fit"]
# Weights of the six components, in the order above.
PROFILES = {
    "strategic": [0.20, 0.15, 0.15, 0.10, 0.10, 0.30],
    "equal": [1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6],
    "market_size": [0.30, 0.20, 0.15, 0.10, 0.10, 0.15],
}


def check_weights(weights: Mapping[str, float], names: Sequence[str]) -> None:
    """Exactly the named weights, finite and not negative, that sum to 1."""
    if set(weights) != set(names):
        raise ValueError(f"these weights are needed, and no others: {sorted(names)}")
    if any(not 0 <= w < float("inf") for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-8:
        raise ValueError("weights must be finite, not negative and sum to 1.0")


def fit_of(c: str, fit: Mapping[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in fit.items() for x in kv]), F.col(c))


def concentration(long: DataFrame, keys: Sequence[str], member: str, out: str) -> DataFrame:
    """keys and the sum of squared shares of a column's non-null values; NULL if there are none."""
    counts = long.where(F.col(member).isNotNull()).groupBy(*keys, member).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg((F.sum(F.col("_c") * F.col("_c")) / (F.sum("_c") * F.sum("_c"))).alias(out))


def theme_metrics(long: DataFrame, prior_strength: float = 20.0) -> DataFrame:
    """Counts, smoothed rate, breadth and concentration of every theme.

    ``long`` has one row per project and theme. Concentrations are over rows of high
    applicability; all three groupings come from one GROUPING SETS aggregate.
    """
    if prior_strength < 0:
        raise ValueError("prior_strength must not be negative")
    prior = long.where("ai_usecase <> 'U99'").agg(F.avg(F.col("is_high_app").cast("int"))).first()[0] or 0.0
    keys = ["admin_process", "ai_usecase"]
    totals = long.groupBy(*keys).agg(
        F.count("*").alias("project_count"), F.count_if("is_high_app").alias("high_app_project_count"),
        F.count_if(F.col("is_high_app") & F.col("responsible_ministry").isNull()).alias("_no_ministry"),
    )
    high = long.where("is_high_app")
    sets = high.groupingSets([[*map(F.col, keys), F.col("responsible_ministry")], [*map(F.col, keys), F.col("policy_domain")]], *keys, "responsible_ministry", "policy_domain")
    cells = sets.agg(F.count("*").alias("c"), F.grouping("responsible_ministry").alias("by_domain"))
    some = cells.where(F.when(F.col("by_domain") == 1, F.col("policy_domain").isNotNull()).otherwise(F.col("responsible_ministry").isNotNull()))

    def part(flag: int, name: str) -> list[Column]:
        c = F.when(F.col("by_domain") == flag, F.col("c"))
        return [F.count(c).alias(f"{name}_breadth"), ratio(F.sum(c * c), F.sum(c) * F.sum(c)).alias(f"{name}_hhi")]

    spread = some.groupBy(*keys).agg(*part(0, "ministry"), *part(1, "domain"))
    joined = totals.join(spread, keys, "left").fillna(0, ["ministry_breadth", "domain_breadth"])
    return joined.select(
        F.concat_ws("__", *keys).alias("theme_code"), *keys, "project_count", "high_app_project_count",
        ratio("high_app_project_count", "project_count").alias("high_app_rate"),
        ((F.col("high_app_project_count") + prior_strength * F.lit(prior)) / (F.col("project_count") + prior_strength)).alias("high_app_rate_smoothed"),
        "ministry_breadth", "domain_breadth", "ministry_hhi", "domain_hhi",
        F.expr("(coalesce(ministry_hhi, 0D) + coalesce(domain_hhi, 0D)) / nullif(if(ministry_hhi IS NULL, 0, 1) + if(domain_hhi IS NULL, 0, 1), 0)").alias("concentration_hhi"),
        ratio("_no_ministry", "high_app_project_count").alias("high_app_ministry_missing_rate"),
        fit_of("admin_process", PROCESS_FIT).alias("admin_fit"), fit_of("ai_usecase", USE_CASE_FIT).alias("usecase_fit"),
        (fit_of("admin_process", PROCESS_FIT) + fit_of("ai_usecase", USE_CASE_FIT)).alias("aiu_fit"),
        ((F.col("ai_usecase") != "U99") & (F.col("high_app_project_count") > 0)).alias("ranking_eligible"),
        F.lit(float(prior)).alias("global_high_app_rate_prior"),
    )


def component_scores(metrics: DataFrame) -> DataFrame:
    """Metrics with the six component scores from 0 to 100, NULL where not eligible."""
    sources = {
        "high_app_count": F.col("high_app_project_count"), "smoothed_rate": F.col("high_app_rate_smoothed"), "ministry_breadth": F.col("ministry_breadth"),
        "domain_breadth": F.col("domain_breadth"), "low_concentration": 1 - F.col("concentration_hhi"),
    }
    eligible = F.col("ranking_eligible")
    scores = {}
    for name, value in sources.items():
        known = eligible & value.isNotNull()
        scores[f"{name}_score"] = F.when(known, percent_rank_of(value, known) * 100).when(eligible, F.lit(0.0))
    scores["aiu_fit_score"] = F.when(eligible, F.col("aiu_fit") / MOST_FIT * 100)
    return metrics.withColumns(scores)


def theme_scores(metrics: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Component scores, their weighted sum, and the overall rank of eligible themes."""
    weights = weights or dict(zip(COMPONENTS, PROFILES["strategic"]))
    check_weights(weights, COMPONENTS)
    scored = component_scores(metrics)
    total = sum((F.col(f"{n}_score") * w for n, w in weights.items()), F.lit(0.0))
    scored = scored.withColumn("strategic_score", F.when(F.col("ranking_eligible"), total))
    return scored.withColumn("overall_rank", F.when(F.col("ranking_eligible"), F.rank().over(Window.partitionBy("ranking_eligible").orderBy(F.round("strategic_score", 9).desc()))))


def weight_profiles(metrics: DataFrame, profiles: Mapping[str, Sequence[float]] = PROFILES) -> DataFrame:
    """theme_code, profile, score and rank of eligible themes under every weight profile, in one plan."""
    for p in profiles.values():
        check_weights(dict(zip(COMPONENTS, p, strict=True)), COMPONENTS)
    scored = component_scores(metrics).where("ranking_eligible")
    rows = F.array(*[
        F.struct(F.lit(name).alias("profile"), sum((F.col(f"{n}_score") * w for n, w in zip(COMPONENTS, p)), F.lit(0.0)).alias("score")) for name, p in profiles.items()
    ])
    flat = scored.select("theme_code", F.explode(rows).alias("r")).select("theme_code", "r.*")
    return flat.withColumn("rank", F.rank().over(Window.partitionBy("profile").orderBy(F.round("score", 9).desc())))


def rank_sensitivity(ranked: DataFrame, profiles: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    """Per theme its rank under each profile, the best, the worst and their distance."""
    wide = ranked.groupBy("theme_code").pivot("profile", list(profiles)).agg(F.first("rank"))
    wide = wide.select("theme_code", *[F.col(p).alias(f"{p}_rank") for p in profiles])
    cols = [F.col(f"{p}_rank") for p in profiles]
    return wide.withColumn("best_rank", F.least(*cols)).withColumn("worst_rank", F.greatest(*cols)).withColumn("rank_spread", F.greatest(*cols) - F.least(*cols))


def score_contributions(metrics: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """theme_code, component, contribution: each component's part of the score."""
    weights = weights or dict(zip(COMPONENTS, PROFILES["strategic"]))
    scored = component_scores(metrics).where("ranking_eligible")
    parts = F.array(*[F.struct(F.lit(n).alias("component"), (F.col(f"{n}_score") * w).alias("contribution")) for n, w in weights.items()])
    return scored.select("theme_code", F.explode(parts).alias("p")).select("theme_code", "p.*")


def yearly_theme_metrics(long: DataFrame, keys: Sequence[str] = ("admin_process", "ai_usecase")) -> DataFrame:
    """Projects, high-applicability projects and their rate by year and theme."""
    per = long.groupBy("project_start_year", *keys).agg(F.count_distinct("project_key").alias("project_count"), F.count_distinct(F.when(F.col("is_high_app"), F.col("project_key"))).alias("high_app_project_count"))
    return per.withColumn("high_app_rate", ratio("high_app_project_count", "project_count"))


def theme_cube(long: DataFrame) -> DataFrame:
    """Projects by process and use case with all margins; NULL stands for the margin."""
    return long.cube("admin_process", "ai_usecase").agg(F.count("*").alias("rows"))


def year_theme_grid(long: DataFrame, themes: DataFrame) -> DataFrame:
    """Every year of the range for every given theme: counts 0 where nothing was, rate NULL."""
    yearly = yearly_theme_metrics(long.join(themes, "theme_code", "left_semi"), ["theme_code"])
    span = long.agg(F.min("project_start_year").alias("lo"), F.max("project_start_year").alias("hi")).first()
    if span["lo"] is None:
        return yearly
    years = F.sequence(F.lit(span["lo"]), F.lit(span["hi"]))
    grid = themes.select("theme_code", F.explode(years).alias("project_start_year"))
    return grid.join(yearly, ["theme_code", "project_start_year"], "left").fillna(0, ["project_count", "high_app_project_count"])


def composition(long: DataFrame, row: str, column: str, n_columns: int | None = None) -> DataFrame:
    """row, column, n, share of the whole row; with ``n_columns`` only the largest columns are shown."""
    cells = long.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    shared = cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))
    if n_columns is None:
        return shared
    top = cells.groupBy(column).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), column).limit(n_columns).select(column)
    return shared.join(F.broadcast(top), column, "left_semi")
