import pytest
from pyspark.sql import functions as F

from kumihimo.operators import ensemble as en, models, profiling as p
from kumihimo.sources import io


@pytest.fixture
def oof(spark):
    rows = [(10, 2019, 0, None, None), (30, 2020, 0, 0.1, 0.4), (50, 2020, 1, 0.9, 0.6), (40, 2021, 0, 0.5, 0.2), (60, 2021, 1, 0.6, 0.1)]
    return spark.createDataFrame(rows, "row_id int, fold int, target int, model_a double, model_b double")


def test_hill_climb_starts_at_the_best(oof):
    got = en.hill_climb(oof, ["model_a", "model_b"], "target", "fold", max_steps=3)
    assert got.score == 1.0 and got.weights == {"model_a": 1.0, "model_b": 0.0} and len(got.history) == 1
    assert {r["row_id"]: r["prediction"] for r in got.prediction.collect()}[10] is None


def test_hill_climb_blends(spark):
    rows = [(i, 0, y, a, b) for i, (y, a, b) in enumerate([(1, 0.9, 0.1), (0, 0.8, 0.0), (1, 0.2, 0.9), (0, 0.1, 0.8)])]
    df = spark.createDataFrame(rows, "row_id int, fold int, target int, model_a double, model_b double")
    got = en.hill_climb(df, ["model_a", "model_b"], "target", "fold")
    assert got.score >= 0.75 and sum(got.weights.values()) == pytest.approx(1)


def test_candidates_are_checked(oof):
    with pytest.raises(ValueError, match="same OOF rows"):
        en.check_candidates(oof.withColumn("model_b", F.when(F.col("row_id") > 30, F.col("model_b"))), ["model_a", "model_b"], "target")
    with pytest.raises(ValueError, match="within"):
        en.check_candidates(oof.withColumn("model_a", F.col("model_a") * 2), ["model_a"], "target")


def test_blends(spark):
    df = spark.createDataFrame([("z", 0.1, 0.5), ("a", 0.5, 0.1)], "id string, x double, y double")
    assert [r["prediction"] for r in en.blend(df, {"x": 1, "y": 1}).collect()] == pytest.approx([0.3, 0.3])
    assert sorted(r["prediction"] for r in en.blend(df, {"x": 2.0, "y": 3.0}, "rank").collect()) == pytest.approx([0.7, 0.8])
    tied = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "id int, x double")
    assert [r["prediction"] for r in en.blend(tied, {"x": 1.0}, "rank").collect()] == pytest.approx([2 / 3] * 3)
    with pytest.raises(ValueError):
        en.blend(df, {"x": 0.0})


def test_sources_are_combined(spark):
    a = spark.createDataFrame([(1, 0.1, 0.5), (2, 0.2, 0.6)], "row_id int, m double, t double")
    got = en.combine_sources({"s1": a, "s2": a}, "row_id", shared=["t"])
    assert got.columns == ["row_id", "s1__m", "t", "s2__m"]
    with pytest.raises(ValueError, match="same OOF rows"):
        en.combine_sources({"s1": a, "s2": a.where("row_id = 1")}, "row_id")


def test_submissions(spark, tmp_path):
    df = spark.createDataFrame([("z", 0.1, 0), ("a", 0.5, 1)], "project_id string, prediction double, row_position int")
    manifest = io.write_profiles({"one": ({"x": 1.0}, df), "two": ({"x": 0.5}, df)}, "project_id", "row_position", str(tmp_path / "out"), "two")
    assert [r["is_canonical"] for r in manifest.orderBy("profile").collect()] == [False, True]
    assert [r["project_id"] for r in spark.read.csv(str(tmp_path / "out/one"), header=True).collect()] == ["z", "a"]
    with pytest.raises(ValueError):
        io.write_profiles({"../x": ({}, df)}, "project_id", "row_position", str(tmp_path))
    with pytest.raises(ValueError):
        en.check_submission(df.unionByName(df), "project_id")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline', 2020, 1.5), ("2", None, None, float("nan"))], "project_id string, project_name string, project_fiscal_year int, budget double")
    io.write_csv(df, str(tmp_path / "p"), "gzip")
    back = io.read_projects_csv(spark, str(tmp_path / "p"), "project_id string, project_name string, project_fiscal_year int, budget double").orderBy("project_id").collect()
    assert back[0]["project_name"] == 'a "quoted"\nline' and back[1]["budget"] is None


def test_experiments_give_probabilities(spark):
    rows = [(i, i % 2, 2018 + i // 20, f"名前{'甲' if i % 2 else '乙'}{i}", float(i % 2) + 0.1 * (i % 3), ["A", "B"][i % 2], [float(i % 2), 1.0, float(i % 5)]) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, target int, y int, name string, x double, m string, embedding array<double>")
    folds = spark.createDataFrame([(0, 2021, "train" if r[2] < 2021 else "valid", r[0]) for r in rows], "fold int, validation_year int, role string, row_id long")
    for experiment in ("E2_embedding_tabular_lr", "T1_tfidf_lr"):
        got = models.run_experiment(df.drop("y"), folds, experiment, "name")
        p = [r["prediction"] for r in got.collect()]
        assert len(p) == 20 and all(0 <= v <= 1 for v in p)
        assert models.experiment_metrics(got, experiment).first()["score"] > 0.9
    with pytest.raises(ValueError, match="fold limit"):
        models.pca_features(df, df, "embedding", 9)


def test_summary(spark):
    metrics = spark.createDataFrame([("E1", 0, 2020, 0.6), ("E1", 1, 2022, 0.8)], "experiment string, fold int, validation_year int, score double")
    r = en.experiment_summary(metrics, [2020, 2022]).first()
    assert (r["fold_2020"], r["fold_2022"], r["mean_score"], r["latest_score"]) == (0.6, 0.8, pytest.approx(0.7), 0.8)


def test_drift(spark):
    a = spark.createDataFrame([(float(i), "x") for i in range(10)] + [(None, None)], "v double, c string")
    b = spark.createDataFrame([(float(i + 5), "y") for i in range(10)], "v double, c string")
    assert p.ks_statistic(a, b, F.col("v"), "v").first()["ks_statistic"] == pytest.approx(0.5)
    assert p.total_variation(a, b, ["c"]).first()["tv_distance"] == pytest.approx(1.0)
    assert p.ks_statistic(a.where("false"), b, F.col("v"), "v").first()["ks_statistic"] is None
    assert sorted(r[0] for r in p.sample_rows(a.where("v IS NOT NULL"), "v", 3).collect()) == sorted(r[0] for r in p.sample_rows(a.where("v IS NOT NULL").repartition(3), "v", 3).collect())


def test_streamed_states_match_the_batch(spark, tmp_path):
    from kumihimo.operators import quality as q
    from kumihimo.streaming import incremental as inc

    df = spark.createDataFrame([(i, i % 3, str(2000 + i % 40)) for i in range(60)], "row_id long, load_id int, y string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = inc.arriving(spark, str(tmp_path / "in"), df.schema, 1)
    inc.append_states(stream, "load_id", [q.year_constraint("y")], lambda x: x, str(tmp_path / "states"), str(tmp_path / "cp"))
    merged = q.merge_states(spark.read.parquet(str(tmp_path / "states")).drop("batch"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, q.load_states(q.cell_states(df, None, "load_id", [q.year_constraint("y")])).collect()))


def test_suite_and_coefficients(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows = [(i, i % 2, float(i % 2), [float(i % 2), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, target int, x double, embedding array<double>")
    folds = spark.createDataFrame([(0, 2021, "train" if r[0] < 30 else "valid", r[0]) for r in rows], "fold int, validation_year int, role string, row_id long")
    oof, metrics, summary = models.run_suite(df, folds, ["E1_embedding_lr", "E5_tabular_gbt"])
    assert oof.columns == ["row_id", "target", "E1_embedding_lr", "E5_tabular_gbt"] and oof.where("E1_embedding_lr IS NOT NULL").count() == 10
    assert metrics.count() == 2 and summary.first()["fold_2021"] == 1.0
    fitted = LogisticRegression(labelCol="y").fit(spark.createDataFrame([(Vectors.dense(1.0, 0.0), 1.0), (Vectors.dense(0.0, 1.0), 0.0)] * 5, ["features", "y"]))
    got = {r["feature"]: r["coefficient"] for r in models.top_coefficients(fitted, spark.createDataFrame([("a",), ("b",)], "term string"), 1).collect()}
    assert got["a"] > 0 > got["b"]


def test_streamed_windows_match_the_batch(spark, tmp_path):
    from kumihimo.streaming import incremental as inc

    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 600 + 1_500_000_000).alias("ts"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"), (F.col("id") * 1.0).alias("value"))
    df.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = inc.windowed_events(inc.arriving(spark, str(tmp_path / "events"), df.schema))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("windows").select("window.start", "event_type", "n", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, inc.windowed_events(df).select("window.start", "event_type", "n", "value").collect()))


def test_every_text_column_has_its_own_terms(spark):
    rows = [(i, float(i % 2), "train" if i < 30 else "valid", "同じ名前", f"{'甲' if i % 2 else '乙'}の課題を改める") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, target double, role string, name string, issues string")
    one, width = models.fold_features(df, ("tfidf",), "name")
    both, more = models.fold_features(df, ("tfidf",), ["name", "issues"])
    assert width == 6 and more > width  # 4 characters have three 2-grams, two 3-grams and one 4-gram
    assert len({str(r["features"]) for r in one.collect()}) == 1 and len({str(r["features"]) for r in both.collect()}) == 2
    svd, k = models.fold_features(df, ("svd",), ["name", "issues"])
    assert {r["features"].size for r in svd.collect()} == {k}


def test_text_queries_read_all_columns(spark, monkeypatch):
    from kumihimo.plans import modelling

    seen = {}
    monkeypatch.setattr(modelling, "labelled", lambda *a: None)
    monkeypatch.setattr(modelling, "model_rows", lambda *a, **kw: seen.update(kw))
    monkeypatch.setattr(modelling.f, "time_folds", lambda *a: None)
    monkeypatch.setattr(models, "run_experiment", lambda rows, folds, experiment, text: seen.update({experiment: list(text)}))
    modelling.tfidf_lr_oof(spark, "")
    assert seen["texts"] and len(seen["T1_tfidf_lr"]) == 4


def test_rows_that_differ_in_any_text_have_other_features(spark, monkeypatch):
    from kumihimo.plans import modelling, textual

    texts = ["project_name", "project_objective", "project_summary", "current_issues"]
    rows = [(i, *["同じ文" if c != i else "別の文" + "甲乙丙丁"[c] * 3 for c in range(4)], 1.0, "2020", "2021", 2020, "省", 0) for i in range(5)]
    train = spark.createDataFrame(rows, f"row_id long, {', '.join(f'{c} string' for c in texts)}, budget double, project_start_year string, project_end_year string, project_fiscal_year int, responsible_ministry string, target int")
    tables = {"train": train, "bureaus": spark.createDataFrame([("省",)], "ministry_name string")}
    for module in (modelling, textual):
        monkeypatch.setattr(module, "table", lambda spark, base, name: tables[name])
    monkeypatch.setattr(modelling, "labelled", lambda spark, base: train)
    got = modelling.model_rows(spark, "").collect()
    assert len({tuple(r["embedding"]) for r in got}) == 5
    assert all(f"{c}__char_count" in got[0].asDict() for c in texts) and "text__total_char_count" in got[0].asDict()
    assert len({r["text_hash"] for r in textual.resumable_embeddings(spark, "").collect()}) == 5


def test_hill_climb_query_has_the_usual_number_of_steps(spark, monkeypatch):
    from types import SimpleNamespace

    from kumihimo.plans import modelling

    steps = []

    def climb(oof, names, target, fold, max_steps=50, **_):
        steps.append(max_steps)
        return SimpleNamespace(history=[(0, "model_a", 1.0, 0.5)], weights={"model_a": 1.0})

    monkeypatch.setattr(modelling, "shared_rows", lambda *a: None)
    monkeypatch.setattr(modelling.en, "hill_climb", climb)
    assert modelling.hill_climb(spark, "").count() == 1 and steps == [50]


def test_ranks_of_as_many_values_as_rows_are_not_gathered_for_a_broadcast(spark):
    from kumihimo.functions.expr import global_percent_rank, running_total

    df = spark.range(100).select((F.col("id") % 2).alias("fold"), (F.col("id") / 100).alias("v"), F.lit(1).alias("n"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    ranks = global_percent_rank(df, "v", "rank", ["fold"])
    outer = [line for line in plan(ranks).splitlines() if "LeftOuter" in line]
    assert outer and all("SortMergeJoin" in line for line in outer)
    assert "SortMergeJoin" in plan(running_total(df, "v", "n", "upto", ["fold"]))
    assert {r["v"]: r["rank"] for r in ranks.collect()}[0.5] == pytest.approx(26 / 50)
