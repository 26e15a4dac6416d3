"""Queries that fit models, and those on out-of-fold predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kumihimo.functions.expr import global_percent_rank
from kumihimo.operators import embedding as emb, ensemble as en, folds as f, models, tabular
from kumihimo.plans.market import rounded
from kumihimo.plans.profiling import SCORED, labelled, scored
from kumihimo.plans.registry import query
from kumihimo.plans.textual import TEXTS
from kumihimo.sources.shared import table, written

NUMERIC = ["budget", "project_start_year", "project_fiscal_year"]


def model_rows(spark: SparkSession, base: str, split: str = "train", embed: bool = True, texts: bool = False) -> DataFrame:
    """Rows with target, tabular features, a vector by the offline embedder and, if asked for, the texts."""
    rows = labelled(spark, base) if split == "train" else table(spark, base, split)
    usable = rows.withColumn("budget", F.when(~F.isnan("budget") & (F.abs("budget") < 1e7), F.col("budget")))
    usable = usable.withColumn("project_start_year", F.when(F.col("project_start_year").rlike("^(19[5-9][0-9]|20[0-2][0-9]|2030)\\z"), F.col("project_start_year")))
    usable = usable.withColumn("project_end_year", F.when(F.col("project_end_year").rlike("^(19[5-9][0-9]|20[0-2][0-9]|2030)\\z"), F.col("project_end_year")))
    known = table(spark, base, "bureaus").select(F.col("ministry_name").alias("_known")).distinct()
    usable = usable.join(known, F.col("responsible_ministry") == F.col("_known"), "left").withColumn("responsible_ministry", F.col("_known"))
    features = tabular.stateless_features(usable, "row_id", NUMERIC, ["responsible_ministry"], TEXTS)
    keep = ["row_id", *(TEXTS if texts else []), *(["target"] if split == "train" else [])]
    out = features.join(usable.select(*keep), "row_id")
    if embed:
        todo = emb.prepared_inputs(rows, "row_id", TEXTS, 8000)
        out = out.join(emb.generate(todo, None, emb.hashing_embedder(32)).select("row_id", "embedding"), "row_id")
    return written(out)


def oof(spark: SparkSession, base: str, experiment: str) -> DataFrame:
    groups, _ = models.EXPERIMENTS[experiment]
    rows = model_rows(spark, base, embed="embedding" in groups, texts="tfidf" in groups or "svd" in groups)
    folds = f.time_folds(labelled(spark, base), "row_id", "year")
    return models.run_experiment(rows, folds, experiment, TEXTS)


@query("embedding_lr_oof")
def embedding_lr_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "E1_embedding_lr")


@query("embedding_tabular_lr_oof")
def embedding_tabular_lr_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "E2_embedding_tabular_lr")


@query("mlp_oof")
def mlp_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "E3_embedding_mlp")


@query("gbt_oof")
def gbt_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "E5_tabular_gbt")


@query("tfidf_lr_oof")
def tfidf_lr_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "T1_tfidf_lr")


@query("svd_gbt_oof")
def svd_gbt_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "S2_tfidf_svd_embedding_tabular_gbt")


@query("embedding_tabular_mlp_oof")
def embedding_tabular_mlp_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "E4_embedding_tabular_mlp")


@query("embedding_tabular_gbt_oof")
def embedding_tabular_gbt_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "E6_embedding_tabular_gbt")


@query("tfidf_tabular_lr_oof")
def tfidf_tabular_lr_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "T2_tfidf_tabular_lr")


@query("tfidf_embedding_tabular_lr_oof")
def tfidf_embedding_tabular_lr_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "T3_tfidf_embedding_tabular_lr")


@query("svd_mlp_oof")
def svd_mlp_oof(spark: SparkSession, base: str) -> DataFrame:
    return oof(spark, base, "S1_tfidf_svd_embedding_tabular_mlp")


@query("test_predictions")
def test_predictions(spark: SparkSession, base: str) -> DataFrame:
    """Predictions for test by a logistic regression on all labelled rows."""
    return models.fit_predict(model_rows(spark, base), model_rows(spark, base, "test"), "E2_embedding_tabular_lr")


@query("embedding_pca")
def embedding_pca(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    vectors = table(spark, base, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))
    return models.pca_features(vectors, vectors, "embedding", 8).select("vec_id", vector_to_array("pca").alias("pca"))


@query(
    "experiment_summary",
    f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY validation_year, model ORDER BY score) + (count(*) OVER (PARTITION BY validation_year, model, score) - 1) / 2.0 AS k FROM s),
    a AS (SELECT validation_year, model, (sum(k) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / nullif(sum(target) * (count(*) - sum(target)), 0) AS auc FROM r GROUP BY ALL)
    SELECT model AS experiment, round(avg(auc), 6) AS mean_score, round(max_by(auc, validation_year), 6) AS latest_score, count(auc) AS n_folds FROM a WHERE auc IS NOT NULL GROUP BY ALL""",
)
def experiment_summary(spark: SparkSession, base: str) -> DataFrame:
    per = f.fold_scores(scored(spark, base), "score", "target", ["validation_year", "model"])
    metrics = written(per.select(F.col("model").alias("experiment"), "validation_year", F.col("auc").alias("score")))
    years = [r[0] for r in metrics.select("validation_year").distinct().orderBy("validation_year").collect()]
    return rounded(en.experiment_summary(metrics, years).where("n_folds > 0").select("experiment", "mean_score", "latest_score", "n_folds"))


@query("oof_long", "SELECT row_id, validation_year, model, score FROM oof_predictions UNPIVOT (score FOR model IN (model_a, model_b)) WHERE NOT isnan(score)")
def oof_long(spark: SparkSession, base: str) -> DataFrame:
    return en.to_long(table(spark, base, "oof_predictions"), "row_id", ["model_a", "model_b"], ["validation_year"])


@query("oof_pivot", "SELECT row_id, max(score) FILTER (model = 'model_a') AS model_a, max(score) FILTER (model = 'model_b') AS model_b FROM (SELECT * FROM oof_predictions UNPIVOT (score FOR model IN (model_a, model_b)) WHERE NOT isnan(score)) GROUP BY ALL HAVING count(*) = 2")
def oof_pivot(spark: SparkSession, base: str) -> DataFrame:
    long = en.to_long(table(spark, base, "oof_predictions"), "row_id", ["model_a", "model_b"])
    return long.groupBy("row_id").pivot("model", ["model_a", "model_b"]).agg(F.max("score")).where("model_a IS NOT NULL AND model_b IS NOT NULL")


@query(
    "pct_rank_blend",
    """WITH s AS (SELECT row_id, model_a, model_b FROM oof_predictions WHERE model_a IS NOT NULL AND model_b IS NOT NULL AND NOT isnan(model_a) AND NOT isnan(model_b)),
    r AS (SELECT row_id, (rank() OVER (ORDER BY model_a) + (count(*) OVER (PARTITION BY model_a) - 1) / 2.0) / count(*) OVER () AS a, (rank() OVER (ORDER BY model_b) + (count(*) OVER (PARTITION BY model_b) - 1) / 2.0) / count(*) OVER () AS b FROM s)
    SELECT row_id, round(0.4 * a + 0.6 * b, 6) AS prediction FROM r""",
)
def pct_rank_blend(spark: SparkSession, base: str) -> DataFrame:
    both = table(spark, base, "oof_predictions").where("model_a IS NOT NULL AND model_b IS NOT NULL AND NOT isnan(model_a) AND NOT isnan(model_b)")
    return rounded(en.blend(both.select("row_id", "model_a", "model_b"), {"model_a": 2.0, "model_b": 3.0}, "rank").select("row_id", "prediction"))


@query(
    "fold_percent_ranks",
    f"WITH {SCORED} SELECT row_id, model, validation_year, round((rank() OVER (PARTITION BY model, validation_year ORDER BY score) + (count(*) OVER (PARTITION BY model, validation_year, score) - 1) / 2.0) / count(*) OVER (PARTITION BY model, validation_year), 6) AS percent_rank FROM s",
)
def fold_percent_ranks(spark: SparkSession, base: str) -> DataFrame:
    rows = scored(spark, base)
    return rounded(global_percent_rank(rows, "score", "percent_rank", ["model", "validation_year"]).select("row_id", "model", "validation_year", "percent_rank"))


def shared_rows(spark: SparkSession, base: str) -> DataFrame:
    both = table(spark, base, "oof_predictions").where("model_a IS NOT NULL AND model_b IS NOT NULL AND NOT isnan(model_a) AND NOT isnan(model_b)")
    rows = written(both.join(labelled(spark, base).select("row_id", "target").hint("merge"), "row_id").where("target IS NOT NULL"))
    usable = rows.groupBy("validation_year").agg(F.count_distinct("target").alias("k")).where("k = 2")
    return rows.join(usable.select("validation_year"), "validation_year")


@query("hill_climb_rank")
def hill_climb_rank(spark: SparkSession, base: str) -> DataFrame:
    """The blend of ranks within folds by the pooled AUC: steps and final weights."""
    result = en.hill_climb(shared_rows(spark, base), ["model_a", "model_b"], "target", "validation_year", mode="rank")
    return spark.createDataFrame([(*h, result.weights[h[1]]) for h in result.history], "step int, added_model string, alpha double, score double, final_weight double")


@query("hill_climb")
def hill_climb(spark: SparkSession, base: str) -> DataFrame:
    """Steps of the greedy blend, and the weights it ends with."""
    result = en.hill_climb(shared_rows(spark, base), ["model_a", "model_b"], "target", "validation_year", objective="mean_fold_auc")
    rows = [(s, m, a, v, result.weights[m]) for s, m, a, v in result.history]
    return spark.createDataFrame(rows, "step int, added_model string, alpha double, score double, final_weight double")


_Z = {c: f"(coalesce({c}, (SELECT median({c}) FROM z)) - (SELECT avg(coalesce({c}, (SELECT median({c}) FROM z))) FROM z)) / (SELECT stddev_pop(coalesce({c}, (SELECT median({c}) FROM z))) FROM z)" for c in ("b", "y")}


@query(
    "impute_scale_onehot",
    f"""WITH z AS (SELECT row_id, CASE WHEN budget >= 0 AND NOT isnan(budget) AND budget <= 1000000 THEN budget END AS b, project_fiscal_year::DOUBLE AS y, science_tech_decision AS d FROM train)
    SELECT row_id, round({_Z['b']}, 5) AS budget, round({_Z['y']}, 5) AS project_fiscal_year, (d IS NULL)::INT::DOUBLE AS missing_label FROM z""",
)
def impute_scale_onehot(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "train").select(
        "row_id", F.when((F.col("budget") >= 0) & ~F.isnan("budget") & (F.col("budget") <= 1_000_000), F.col("budget")).alias("budget"),
        F.col("project_fiscal_year").cast("double").alias("project_fiscal_year"), "science_tech_decision",
    )
    cells = tabular.numeric_features(rows, tabular.fit_numeric(rows, ["budget", "project_fiscal_year"]))
    hot = tabular.one_hot("science_tech_decision", tabular.fit_categories(rows, "science_tech_decision"))
    missing = hot.get(f"science_tech_decision={tabular.MISSING}", F.lit(0.0))
    return rounded(rows.select("row_id", *[v.alias(k) for k, v in cells.items()], missing.alias("missing_label")), 5)
