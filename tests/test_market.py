import pytest
from pyspark.sql import functions as F

from kumihimo.operators import domain as d, market as m, taxonomy as t

LONG = "project_key string, project_start_year int, responsible_ministry string, policy_domain string, admin_process string, ai_usecase string, is_high_app boolean, budget double, current_issues string"
ROWS = [
    ("p1", 2020, "M1", "D01", "A01", "U04", True, 100.0, "x"),
    ("p2", 2021, "M2", "D02", "A01", "U04", True, 200.0, "[欠損]"),
    ("p3", 2021, None, "D01", "A01", "U04", False, 300.0, None),
    ("p4", 2021, "M1", "D01", "A02", "U05", True, -1.0, "y"),
    ("p5", 2022, "M1", "D03", "A02", "U99", False, None, "z"),
    ("p6", 2022, "M1", "D03", "A03", "U05", False, float("nan"), ""),
]


@pytest.fixture
def long(spark):
    return spark.createDataFrame(ROWS, LONG).withColumn("theme_code", F.concat_ws("__", "admin_process", "ai_usecase"))


def test_theme_metrics_by_hand(long):
    r = m.theme_metrics(long).where("theme_code = 'A01__U04'").first()
    assert (r["project_count"], r["high_app_project_count"], r["ministry_breadth"], r["domain_breadth"]) == (3, 2, 2, 2)
    assert r["high_app_rate"] == pytest.approx(2 / 3)
    assert r["high_app_rate_smoothed"] == pytest.approx((2 + 20 * 0.6) / 23)
    assert r["ministry_hhi"] == pytest.approx(0.5) and r["domain_hhi"] == pytest.approx(0.5) and r["concentration_hhi"] == pytest.approx(0.5)
    assert r["aiu_fit"] == 5 and r["ranking_eligible"]
    none = m.theme_metrics(long).where("theme_code = 'A02__U99'").first()
    assert none["concentration_hhi"] is None and not none["ranking_eligible"]


def test_concentration(spark):
    df = spark.createDataFrame([("k", "M1"), ("k", "M1"), ("k", "M2"), ("k", None), ("e", None)], "k string, v string")
    assert {r["k"]: r["h"] for r in m.concentration(df, ["k"], "v", "h").collect()} == {"k": pytest.approx(5 / 9)}


def test_scores_rank_eligible_themes_only(long):
    got = {r["theme_code"]: r for r in m.theme_scores(m.theme_metrics(long)).collect()}
    assert got["A02__U99"]["overall_rank"] is None and got["A02__U99"]["strategic_score"] is None
    assert sorted(r["overall_rank"] for r in got.values() if r["overall_rank"]) == [1, 2]
    with pytest.raises(ValueError):
        m.check_weights({"a": 1.0}, ["b"])
    with pytest.raises(ValueError):
        m.check_weights({"a": 0.5}, ["a"])


def test_profiles_and_sensitivity(long):
    ranked = m.weight_profiles(m.theme_metrics(long))
    assert ranked.count() == 2 * len(m.PROFILES)
    assert all(r["rank_spread"] == r["worst_rank"] - r["best_rank"] for r in m.rank_sensitivity(ranked).collect())
    total = m.score_contributions(m.theme_metrics(long)).groupBy("theme_code").agg(F.sum("contribution").alias("s"))
    scores = m.theme_scores(m.theme_metrics(long)).join(total, "theme_code")
    assert all(r["s"] == pytest.approx(r["strategic_score"]) for r in scores.collect())


def test_grid_has_every_year(spark, long):
    grid = m.year_theme_grid(long, long.select("theme_code").distinct())
    assert grid.count() == 4 * 3
    empty = grid.where("project_count = 0").first()
    assert empty["high_app_project_count"] == 0 and empty["high_app_rate"] is None


def test_domain_metrics_by_hand(long):
    got = {r["policy_domain"]: r for r in d.domain_metrics(long, ["A01__U04"]).collect()}
    assert got["D01"]["project_count"] == 2 and got["D01"]["high_app_project_count"] == 1
    assert got["D01"]["high_app_rate_smoothed"] == pytest.approx((1 + 10 * 2 / 3) / 12)
    assert got["D01"]["high_app_budget_total"] == 100 and got["D01"]["issue_coverage_rate"] == pytest.approx(0.5)
    assert got["D02"]["issue_coverage_rate"] == 0 and got["D02"]["high_app_top3_budget_share"] == pytest.approx(1)
    with pytest.raises(ValueError, match="no project has"):
        d.domain_metrics(long, ["A09__U01"])


def test_negative_budgets_are_missing(long):
    r = d.domain_metrics(long, ["A02__U05"]).first()
    assert r["high_app_budget_total"] is None and r["high_app_budget_nonmissing_rate"] == 0


def test_weights_of_missing_components_are_redistributed(long):
    metrics = d.domain_metrics(long, ["A02__U05"])
    effective = {r["component"]: r["effective_weight"] for r in d.effective_weights(metrics).collect()}
    assert effective["high_app_budget_total"] == 0
    assert sum(effective.values()) == pytest.approx(1)
    assert d.domain_scores(metrics).first()["domain_rank_within_theme"] == 1


def test_accounts_and_cards(long):
    accounts = d.ministry_accounts(long, ["A01__U04"])
    assert accounts.count() == 2
    assert d.priority_accounts(accounts).count() == 2
    cards = d.service_cards(d.domain_scores(d.domain_metrics(long, ["A01__U04"])))
    assert cards.count() == 2 and cards.first()["service_name"] == "research support: classification"
    pairs = long.select("theme_code", "policy_domain").distinct()
    assert d.representative_projects(long, pairs).groupBy("project_key").count().where("count > 1").count() == 0


def test_label_rules(spark):
    cases = [
        ("D01", "A01", ["U01"], 1, []), ("D99", "A01", ["U01"], 1, ["policy_domain"]), ("D01", None, ["U01"], 1, ["admin_process"]), ("D01", "A01", ["U99"], 0, []),
        ("D01", "A01", ["U99"], 1, ["applicability_and_none"]), ("D01", "A01", ["U01", "U99"], 1, ["none_with_others"]), ("D01", "A01", ["U01", "U01"], 1, ["use_case_repeated"]),
        ("D01", "A01", [], 1, ["use_case_count"]), ("D01", "A01", ["U77"], 1, ["use_case_code"]), ("D01", "A01", ["U01"], 3, ["applicability"]), ("D01", "A01", None, 1, ["use_case_count"]),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, d string, p string, u array<string>, a int")
    got = df.select("i", t.rule_violations(F.col("d"), F.col("p"), F.col("u"), F.col("a")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [c[4] for c in cases]


def test_use_cases_decode(spark):
    df = spark.createDataFrame([("U01|U02|",), ('["U03", "U04"]',), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(t.decode_use_cases("x")).collect()] == [["U01", "U02"], ["U03", "U04"], [], None]


def test_repeated_labels_keep_the_last(spark):
    schema = "source_split string, project_id string, project_start_year int, policy_domain string, admin_process string, ai_usecase string, ai_applicability int, classification_reason string, classified_at timestamp"
    rows = [("train", "a", 2020, "d1 ", "A01", "U01", 1, "r", None), ("train", "a", 2020, "D02", "A01", "U01", 1, "r", None)]
    df = spark.createDataFrame(rows, schema).withColumn("classified_at", F.when(F.col("policy_domain") == "D02", F.lit("2020-01-01").cast("timestamp")).otherwise(F.lit("2021-01-01").cast("timestamp")))
    assert [r["policy_domain"] for r in t.repaired_labels(df).collect()] == ["D01"]
