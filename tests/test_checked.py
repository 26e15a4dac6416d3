import pytest
from pyspark.sql import functions as F

from kumihimo.operators import ensemble as en, folds as f, joins, models, profiling, tabular, taxonomy as t
from kumihimo.sources import io


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([("train", "a", "2020"), ("train", "b", "2021"), ("test", "a", "2022")], "source_split string, project_id string, project_start_year string")
    right = spark.createDataFrame(
        [("train", "a", 2020, "D01", "A01", ["U04", "U05"], 2), ("train", "b", 2021, "D02", "A01", ["U99"], 0), ("test", "a", 2022, "D01", "A02", ["U04"], 1)],
        "source_split string, project_id string, project_start_year int, policy_domain string, admin_process string, use_cases array<string>, ai_applicability int",
    )
    return left, right


def test_taxonomy_is_merged_one_to_one(sides):
    left, right = sides
    assert t.merge_taxonomy(left, right).count() == 3
    with pytest.raises(ValueError, match="source_only=1"):
        t.merge_taxonomy(left, right.where("project_id <> 'b'"))
    with pytest.raises(ValueError, match="feature_only=1"):
        t.merge_taxonomy(left.where("project_id <> 'b'"), right)
    assert t.merge_taxonomy(left, right.where("project_id <> 'b'"), complete=False).count() == 2
    with pytest.raises(ValueError, match="repeated on the right"):
        t.merge_taxonomy(left, right.union(right))
    with pytest.raises(ValueError, match="year_mismatch=1"):
        t.merge_taxonomy(left, right.withColumn("project_start_year", F.when(F.col("project_id") == "b", 1999).otherwise(F.col("project_start_year"))))
    with pytest.raises(ValueError, match="taken"):
        t.merge_taxonomy(left.withColumn("project_key", F.lit("x")), right)
    rows = left.where("source_split = 'train'").union(left.where("source_split = 'train'"))
    assert t.with_labels(rows.drop("source_split"), right.where("project_id = 'a'"), "train").where("policy_domain IS NULL").count() == 2


def test_themes_are_checked(sides):
    joined = t.merge_taxonomy(*sides)
    assert t.checked_theme_long(joined).count() == 4
    for bad in (F.array(F.lit("U04"), F.lit("U04")), F.array(F.lit("U77")), F.array().cast("array<string>")):
        with pytest.raises(ValueError):
            t.checked_theme_long(joined.withColumn("use_cases", bad))


def test_years(spark):
    df = spark.createDataFrame([("2020",), ("2021.0",), (" 2022",), ("-1",), (None,), ("unknown",)], "y string")
    assert [r["year"] for r in joins.whole_years(df, "y").collect()] == [2020, 2021, 2022, -1, None, None]
    assert df.where(joins.from_year("y", 2021)).count() == 2
    with pytest.raises(ValueError):
        joins.whole_years(spark.createDataFrame([("2020.5",)], "y string"), "y")


@pytest.fixture
def oof(spark):
    rows = [(10, 1, 0, None, None, None), (20, 0, 0, None, None, None), (30, 0, 1, 0.1, 0.6, 0), (40, 1, 1, 0.4, 0.9, 1), (50, 1, 1, 0.8, 0.7, 0), (60, 0, 1, 0.3, 0.2, 1)]
    return spark.createDataFrame(rows, "row_id int, target int, x int, model_a double, model_b double, fold int")


def test_objectives_and_modes(oof):
    both = ["model_a", "model_b"]
    pooled = en.hill_climb(oof, both, "target")
    mean = en.hill_climb(oof, both, "target", "fold", objective="mean_fold_auc")
    assert pooled.score == 1.0 and mean.score == 1.0 and mean.fold_scores == {0: 1.0, 1: 1.0}
    ranked = en.hill_climb(oof, both, "target", "fold", mode="rank", objective="weighted_fold_auc", fold_weights={0: 2, 1: 3})
    assert sorted(r["prediction"] for r in ranked.prediction.collect()) == [0.5, 0.5, 1.0, 1.0]
    for bad in (dict(objective="mean_fold_auc"), dict(fold="fold", objective="x"), dict(fold="fold", fold_weights={0: 1}), dict(fold="fold", objective="weighted_fold_auc", fold_weights={0: 1}), dict(mode="x")):
        with pytest.raises(ValueError):
            en.hill_climb(oof, both, "target", **bad)
    with pytest.raises(ValueError, match="not those with predictions"):
        en.hill_climb(oof.withColumn("fold", F.when(F.col("row_id") != 30, F.col("fold"))), both, "target", "fold", objective="mean_fold_auc")


def test_membership_and_namespaces(spark, oof):
    folds = spark.createDataFrame([(30, 0, "valid"), (50, 0, "valid"), (10, 0, "train"), (40, 1, "valid"), (60, 1, "valid")], "row_id int, fold int, role string")
    got = {r["row_id"]: r["fold"] for r in en.fold_membership(oof.drop("fold"), folds, "row_id").collect()}
    assert got == {10: None, 20: None, 30: 0, 40: 1, 50: 0, 60: 1}
    with pytest.raises(ValueError, match="several"):
        en.fold_membership(oof.drop("fold"), folds.union(spark.createDataFrame([(30, 1, "valid")], folds.schema)), "row_id")
    with pytest.raises(ValueError, match="no predictions"):
        en.fold_membership(oof.drop("fold"), folds.union(spark.createDataFrame([(99, 1, "valid")], folds.schema)), "row_id")
    wide = spark.createDataFrame([(1, 0.1, 0.2)], "row_id int, a__m double, b__m double")
    assert en.split_namespace(wide, "row_id", "b").columns == ["row_id", "m"]
    with pytest.raises(ValueError):
        en.split_namespace(wide, "row_id", "c")


def test_summary_has_seen_and_unseen(spark):
    metrics = spark.createDataFrame([("E1", 2020, 0.6, 0.5, None), ("E1", 2022, 0.8, 0.9, 0.7)], "experiment string, validation_year int, score double, seen_score double, unseen_score double")
    r = en.experiment_summary(metrics, [2020, 2022]).first()
    assert (r["fold_2020"], r["mean_score"], r["latest_score"], r["n_folds"]) == (0.6, pytest.approx(0.7), 0.8, 2)
    assert (r["mean_seen_score"], r["mean_unseen_score"], r["latest_unseen_score"]) == (pytest.approx(0.7), 0.7, 0.7)


def test_scores(spark):
    df = spark.createDataFrame([("g", 1e-9, 0), ("g", 1e-8, 1), ("g", 0.9, 1), ("h", None, 1)], "g string, p double, y int")
    assert f.clipped_auc(df, "p", "y", ["g"]).first()["auc"] == 0.75
    got = {r["g"]: r["score"] for r in f.custom_scores(df, "p", "y", ["g"], lambda p, y: F.avg((p - y) ** 2)).collect()}
    assert got["g"] == pytest.approx((0 + 1 + 0.01) / 3, abs=1e-6) and "h" not in got
    f.binary_target(df, "y")
    with pytest.raises(ValueError):
        f.binary_target(df.where("y = 1"), "y")
    assert profiling.ks_p_value(0.5, 100, 100) < 1e-8 and profiling.ks_p_value(0.02, 50, 50) == 1.0
    assert profiling.ks_p_value(0.136, 200, 200) == pytest.approx(0.049, abs=0.002)


def test_tables_for_models(spark):
    df = spark.createDataFrame([(1, 2.0, "a", [3.0, 4.0]), (2, None, None, [0.0, 0.0])], "i int, x double, c string, v array<double>")
    assert [tuple(r) for r in tabular.raw_frame(df, "i", ["x"], ["c"]).collect()] == [(1, 2.0, "a"), (2, None, tabular.MISSING)]
    assert [r["v"] for r in tabular.scaled_vectors(df, df, "v", "l2").collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [round(r["v"][0], 3) for r in tabular.scaled_vectors(df, df, "v", "standard").collect()] == [0.707, -0.707]
    cells = tabular.numeric_features(df, {"x": (2.0, 1.0, 2.0)}, center=False)
    assert [r["x"] for r in df.select(cells["x"].alias("x")).collect()] == [1.0, 1.0]
    assert models.merged_config({"gbt": {"trees": 5}})["gbt"]["trees"] == 5
    with pytest.raises(ValueError):
        models.merged_config({"gbt": {"leaves": 5}})
    assert models.improved(0.8, 0.7, True, 0.05) and not models.improved(0.71, 0.7, True, 0.05) and models.improved(0.1, None, False, 1)


def test_networks_stop_early(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(float(i % 2), [i % 2 + (i * 7 % 10) / 20, (i * 3 % 7) / 7]) for i in range(80)]
    df = spark.createDataFrame(rows, "target double, a array<double>").select("target", array_to_vector("a").alias("features"))
    for monitor in ("auc", "loss"):
        model, history = models.fit_network(df, df, 2, (4,), monitor, chunk=5, patience=1, most=40)
        assert model is not None and 1 <= len(history) <= 8


def test_sinks(spark, oof, tmp_path):
    blend = en.hill_climb(oof, ["model_a", "model_b"], "target")
    io.write_ensemble(blend, "row_id", f"{tmp_path}/e")
    assert spark.read.csv(f"{tmp_path}/e/weights", header=True).count() == 2 and spark.read.parquet(f"{tmp_path}/e/predictions").count() == 6
    io.write_experiments(oof, oof, oof, f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x/oof.parquet").count() == 6
    io.write_wide_vectors(spark.createDataFrame([(1, [0.5, 0.25])], "i int, v array<double>"), "i", "v", "svd", 2, f"{tmp_path}/v")
    assert spark.read.csv(f"{tmp_path}/v", header=True).columns == ["row_index", "svd_000", "svd_001"]
    io.write_progress(spark, f"{tmp_path}/p", done=3)
    assert spark.read.text(f"{tmp_path}/p").first()[0] == '{"done": 3}'
    row = spark.range(1).select(io.percent(F.lit(0.125)).alias("p"), io.thousands(F.lit(1234)).alias("t")).first()
    assert tuple(row) == ("12.5%", "1,234")


def test_written_tables_leave_no_shuffle_files(spark):
    from kumihimo.sources.shared import written

    files = lambda: {f.getName() for f in (lambda all_: [all_.apply(i) for i in range(all_.size())])(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    out = written(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count())
    assert not files() - before
    assert out.count() == 5000 and out.agg(F.sum("count")).first()[0] == 20_000
