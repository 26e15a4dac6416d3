"""Out-of-fold predictions, greedy blending by AUC, and test predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from kumihimo.functions.expr import auc_by, global_percent_rank
from kumihimo.sources.shared import written

GRID = [round(0.05 * i, 2) for i in range(1, 11)]


def to_long(oof: DataFrame, id_column: str, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """id, kept columns, model, score; NULL and NaN scores have no row."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models])
    return oof.select(id_column, *keep, F.explode(rows).alias("s")).select(id_column, *keep, "s.*").where("score IS NOT NULL AND NOT isnan(score)")


def combine_sources(sources: Mapping[str, DataFrame], id_column: str, shared: Sequence[str] = (), shared_source: str | None = None) -> DataFrame:
    """One wide table: ``source__model`` columns, models in ``shared`` once, without a prefix.

    The sources must have the same rows: an id missing on one side is an error.
    """
    if not sources:
        raise ValueError("no sources")
    first = shared_source or next(iter(sources))
    out, n = None, None
    for name, df in sources.items():
        if "__" in name:
            raise ValueError(f"source name {name!r} contains the separator")
        columns = [c for c in df.columns if c != id_column and (c not in shared or name == first)]
        part = df.select(id_column, *[F.col(c).alias(c if c in shared else f"{name}__{c}") for c in columns])
        count = part.count()
        out = part if out is None else out.join(part, id_column)
        if n is not None and (count != n or out.count() != n):
            raise ValueError(f"{name} does not have the same OOF rows")
        n = count
    return out


def check_candidates(oof: DataFrame, models: Sequence[str], target: str) -> None:
    """Raises unless all models score the same rows, within [0, 1], and both classes occur."""
    known = [F.col(m).isNotNull() & ~F.isnan(m) for m in models]
    mixed = F.count_if(sum((k.cast("int") for k in known), F.lit(0)).isin(*range(1, len(models)))) if len(models) > 1 else F.lit(0)
    outside = F.count_if(F.greatest(*[F.when(k & ~F.col(m).between(0, 1), 1).otherwise(0) for m, k in zip(models, known)], F.lit(0)) == 1)
    row = oof.agg(mixed.alias("mixed"), outside.alias("outside"), F.count_distinct(F.when(known[0], F.col(target))).alias("classes")).first()
    if row["mixed"]:
        raise ValueError("models do not have the same OOF rows")
    if row["outside"]:
        raise ValueError("predictions must lie within [0, 1]")
    if row["classes"] < 2:
        raise ValueError("both classes are needed")


OBJECTIVES = ("pooled_auc", "mean_fold_auc", "weighted_fold_auc")


def split_namespace(df: DataFrame, id_column: str, source: str) -> DataFrame:
    """The id and the columns of one source, their prefix taken off; ValueError if it has none."""
    prefix = f"{source}__"
    own = [c for c in df.columns if c.startswith(prefix)]
    if not own:
        raise ValueError(f"no column of {source!r}")
    return df.select(id_column, *[F.col(c).alias(c[len(prefix) :]) for c in own])


def fold_membership(rows: DataFrame, folds: DataFrame, id_column: str) -> DataFrame:
    """``rows`` with the ``fold`` whose validation rows they are in, null for none.

    ``folds`` has row_id, fold and role. ValueError where a fold names an unknown row, or two
    folds the same one.
    """
    valid = folds.where("role = 'valid'").select(F.col("row_id").alias("_row"), "fold")
    if valid.groupBy("_row").agg(F.count_distinct("fold").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a row is validated in several folds")
    if valid.join(rows.select(F.col(id_column).alias("_row")), "_row", "left_anti").limit(1).count():
        raise ValueError("a fold holds rows that have no predictions")
    return rows.join(valid.distinct(), rows[id_column] == F.col("_row"), "left").drop("_row")


def fold_shares(objective: str, folds: Sequence, fold_weights: Mapping | None) -> dict:
    """The share of each fold in the score; ValueError where weights don't fit the objective."""
    if objective not in OBJECTIVES:
        raise ValueError(f"the objective must be one of {OBJECTIVES}")
    if (fold_weights is not None) != (objective == "weighted_fold_auc"):
        raise ValueError("weights of folds go with weighted_fold_auc, and only with it")
    if fold_weights is None:
        return {k: 1 / len(folds) for k in folds}
    if set(fold_weights) != set(folds):
        raise ValueError("every fold needs a weight, and no other")
    values = [float(v) for v in fold_weights.values()]
    if not all(0 <= v < float("inf") for v in values) or sum(values) <= 0:
        raise ValueError("weights of folds must be finite, not negative and not all 0")
    return {k: float(v) / sum(values) for k, v in fold_weights.items()}


@dataclass
class Blend:
    weights: dict[str, float]
    score: float
    history: list[tuple[int, str, float, float]]
    prediction: DataFrame
    fold_scores: dict = field(default_factory=dict)


def hill_climb(
    oof: DataFrame, models: Sequence[str], target: str, fold: str | None = None, fold_weights: Mapping[int, float] | None = None, max_steps: int = 50,
    grid: Sequence[float] = GRID, min_improvement: float = 1e-6, objective: str = "pooled_auc", mode: str = "probability",
) -> Blend:
    """Greedy blend of ``models`` by AUC; rows without scores are left out.

    ``objective`` is the AUC over all rows, or the mean or weighted mean of that of each fold;
    ``mode`` blends scores, or percentile ranks within each fold. Where folds are needed, the
    rows with a fold must be exactly those with scores. Starts from the best single model, the
    first on ties. Each step scores every model and weight in one job and accepts, in their
    order, what beats the best so far by more than ``min_improvement``. Only one row per
    trial and fold comes back to the driver.
    """
    if mode not in ("probability", "rank"):
        raise ValueError("the mode must be probability or rank")
    check_candidates(oof, models, target)
    scored = F.col(models[0]).isNotNull() & ~F.isnan(models[0])
    if objective != "pooled_auc" or mode == "rank":
        if fold is None:
            raise ValueError("folds are needed for this objective or mode")
        if oof.where(F.col(fold).isNotNull() != scored).limit(1).count():
            raise ValueError("the rows of the folds are not those with predictions")
    base = oof
    if mode == "rank":
        for m in models:
            base = global_percent_rank(base.where(scored) if m == models[0] else base, m, f"_rank_{m}", [fold])
        base = base.drop(*models).withColumnsRenamed({f"_rank_{m}": m for m in models})
    own_fold = F.col(fold) if fold is not None else F.lit(0)
    rows = written(base.where(scored & F.col(target).isNotNull()).select(own_fold.alias("fold"), F.col(target).cast("int").alias("target"), *models))
    pooled = objective == "pooled_auc"
    folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    share = fold_shares(objective, folds, fold_weights)

    def scores(current, trials: Sequence[tuple[str, float]]) -> tuple[list[float], dict]:
        parts = F.array(*[F.struct(F.lit(i).alias("trial"), ((1 - a) * current + a * F.col(m)).alias("score")) for i, (m, a) in enumerate(trials)])
        long = rows.select("fold", "target", F.explode(parts).alias("t")).select("fold", "target", "t.*")
        per = auc_by(long, "score", "target", ["trial"] if pooled else ["trial", "fold"]).collect()
        out, by_fold = [0.0] * len(trials), {}
        for r in per:
            if r["auc"] is None:
                raise ValueError("the rows have one class only" if pooled else f"fold {r['fold']} has one class only")
            out[r["trial"]] += r["auc"] if pooled else share[r["fold"]] * r["auc"]
            if not pooled:
                by_fold[r["fold"]] = r["auc"]
        return out, by_fold

    single, _ = scores(F.lit(0.0), [(m, 1.0) for m in models])
    best = max(range(len(models)), key=lambda i: (single[i], -i))
    weights = {m: float(m == models[best]) for m in models}
    score = single[best]
    history = [(0, models[best], 1.0, score)]
    trials = [(m, a) for m in models for a in grid]
    for step in range(1, max_steps + 1):
        current = sum((F.col(m) * w for m, w in weights.items() if w), F.lit(0.0))
        top, chosen = score, None
        for trial, value in zip(trials, scores(current, trials)[0]):
            if value > top + min_improvement:
                top, chosen = value, trial
        if chosen is None:
            break
        model, alpha = chosen
        weights = {m: w * (1 - alpha) + (alpha if m == model else 0.0) for m, w in weights.items()}
        score = top
        history.append((step, model, alpha, score))
    total = sum(weights.values())
    weights = {m: (w / total if abs(w) >= 1e-12 else 0.0) for m, w in weights.items()}
    blended = sum((F.col(m) * w for m, w in weights.items() if w), F.lit(0.0))
    _, by_fold = scores(blended, [(models[0], 0.0)])
    return Blend(weights, score, history, base.withColumn("prediction", F.when(scored, blended)), by_fold)


def blend(test: DataFrame, weights: Mapping[str, float], mode: str = "probability") -> DataFrame:
    """``test`` with ``prediction``: the weighted mean of scores, or of their percentile ranks."""
    used = {m: w for m, w in weights.items() if w > 0}
    if not used or mode not in ("probability", "rank"):
        raise ValueError("a positive weight and the mode probability or rank are needed")
    total = sum(used.values())
    if mode == "rank":
        ranked = test
        for m in used:
            ranked = global_percent_rank(ranked, m, f"_rank_{m}")
        mean = sum((F.col(f"_rank_{m}") * (w / total) for m, w in used.items()), F.lit(0.0))
        return ranked.withColumn("prediction", mean).drop(*[f"_rank_{m}" for m in used])
    return test.withColumn("prediction", sum((F.col(m) * (w / total) for m, w in used.items()), F.lit(0.0)))


def check_submission(df: DataFrame, id_column: str, prediction: str = "prediction") -> None:
    """Raises where an id is missing or repeated, or a probability is not in [0, 1]."""
    p = F.col(prediction)
    row = df.agg(F.count("*").alias("n"), F.count_distinct(id_column).alias("d"), F.count_if(p.isNull() | F.isnan(p) | ~p.between(0, 1)).alias("bad")).first()
    if row["n"] != row["d"]:
        raise ValueError("ids are missing or repeated")
    if row["bad"]:
        raise ValueError("predictions must be finite and within [0, 1]")


def experiment_summary(metrics: DataFrame, years: Sequence[int]) -> DataFrame:
    """Per experiment the score of each validation year, their mean, the latest, and the same of seen and unseen rows.

    ``metrics`` has a row for each experiment and validation year; seen_score and unseen_score
    may be missing or null. A mean is over the years that have a value, the latest is that of
    the last year with a score.
    """
    for c in ("seen_score", "unseen_score"):
        if c not in metrics.columns:
            metrics = metrics.withColumn(c, F.lit(None).cast("double"))
    wide = metrics.groupBy("experiment").pivot("validation_year", list(years)).agg(F.first("score"))
    wide = wide.select("experiment", *[F.col(f"`{y}`").alias(f"fold_{y}") for y in years])
    last = F.when(F.col("score").isNotNull(), F.col("validation_year"))
    rest = metrics.groupBy("experiment").agg(
        F.avg("score").alias("mean_score"), F.max_by("score", last).alias("latest_score"), F.count("score").alias("n_folds"),
        F.avg("seen_score").alias("mean_seen_score"), F.avg("unseen_score").alias("mean_unseen_score"),
        F.max_by("seen_score", last).alias("latest_seen_score"), F.max_by("unseen_score", last).alias("latest_unseen_score"),
    )
    return wide.join(rest, "experiment")
