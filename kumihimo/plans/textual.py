"""Queries on text statistics, n-grams, model inputs and stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kumihimo.functions import text as x
from kumihimo.operators import embedding as emb, labelling, tabular, tfidf
from kumihimo.plans.market import LEADERS, chosen, projects, rounded
from kumihimo.plans.registry import query
from kumihimo.sources.shared import table, written

TEXTS = ["project_name", "project_objective", "project_summary", "current_issues"]


#: What the engine's expressions take for blanks, for the other engine's patterns.
BLANK = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def n(c: str) -> str:
    """A column with collapsed blanks, in SQL."""
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '{BLANK}+', ' ', 'g'), '^ | $', '', 'g')"


@query(
    "tabular_features",
    """SELECT row_id, responsible_ministry, b AS budget, CASE WHEN s <> -1 THEN s END AS project_start_year,
    CASE WHEN s <> -1 AND e <> -1 AND e >= s THEN e - s END AS project_duration, round(ln(1 + greatest(b, 0)), 6) AS log1p_budget
    FROM (SELECT row_id, responsible_ministry, CASE WHEN NOT isnan(budget) THEN budget END AS b, CASE WHEN NOT isnan(try_cast(project_start_year AS DOUBLE)) THEN try_cast(project_start_year AS DOUBLE) END AS s,
    CASE WHEN NOT isnan(try_cast(project_end_year AS DOUBLE)) THEN try_cast(project_end_year AS DOUBLE) END AS e FROM train) WHERE b IS NOT NULL""",
)
def tabular_features(spark: SparkSession, base: str) -> DataFrame:
    out = tabular.stateless_features(table(spark, base, "train"), "row_id", ["budget", "project_start_year"], ["responsible_ministry"])
    return rounded(out.where("budget IS NOT NULL"))


@query("text_features")
def text_features(spark: SparkSession, base: str) -> DataFrame:
    """All statistics of all text columns, in compatibility form."""
    return tabular.stateless_features(table(spark, base, "train"), "row_id", [], [], TEXTS)


_STATS = {
    "is_empty": "(length(t) = 0)::INT::DOUBLE", "char_count": "length(t)::DOUBLE", "log1p_char_count": "ln(1 + length(t))",
    "line_count": "CASE WHEN t = '' THEN 0 ELSE len(string_split(regexp_replace(raw, '\\n$', ''), chr(10))) END::DOUBLE",
    "sentence_count": "len(list_filter(string_split_regex(t, '[。！？!?]+'), lambda p: trim(p) <> ''))::DOUBLE",
    "digit_ratio": "length(regexp_replace(t, '[^\\p{Nd}]', '', 'g')) / greatest(length(t), 1)", "latin_ratio": "length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / greatest(length(t), 1)",
    "hiragana_ratio": "length(regexp_replace(t, '[^\\x{3040}-\\x{309f}]', '', 'g')) / greatest(length(t), 1)",
    "katakana_ratio": "length(regexp_replace(t, '[^\\x{30a0}-\\x{30ff}\\x{ff65}-\\x{ff9f}]', '', 'g')) / greatest(length(t), 1)",
    "kanji_ratio": "length(regexp_replace(t, '[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]', '', 'g')) / greatest(length(t), 1)",
    "unique_char_ratio": "CASE WHEN t = '' THEN 0 ELSE len(list_distinct(string_split(t, ''))) END / greatest(length(t), 1)",
}


@query("text_statistics", f"SELECT row_id, {', '.join(f'round({e}, 6) AS {k}' for k, e in _STATS.items())} FROM (SELECT row_id, coalesce(project_summary, '') AS raw, {n('project_summary')} AS t FROM train)")
def text_statistics(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "train")
    stats = x.character_statistics("project_summary")
    return rounded(rows.select("row_id", *[stats[f"project_summary__{k}"].alias(k) for k in _STATS]))


_PARTS = "concat_ws(' ', " + ", ".join(f"CASE WHEN {n(c)} <> '' THEN '{c}: ' || {n(c)} END" for c in TEXTS) + ")"
_TEXT = f"CASE WHEN {_PARTS} = '' THEN '[EMPTY]' ELSE {_PARTS} END"
INPUTS = f"i AS (SELECT row_id, whole, substr(whole, 1, 8000) AS text FROM (SELECT row_id, {_TEXT} AS whole FROM train))"


def inputs(spark: SparkSession, base: str) -> DataFrame:
    return emb.prepared_inputs(table(spark, base, "train"), "row_id", TEXTS, 8000, 1.0, normal_form=False)


@query(
    "text_hashes",
    f"""WITH {INPUTS} SELECT row_id, sha256(text) AS text_hash, length(text)::INT AS character_count, greatest(ceil(length(text) / 1.0), 1)::BIGINT AS estimated_tokens,
    greatest(ceil(length(whole) / 1.0), 1)::BIGINT AS original_estimated_tokens, length(whole) > 8000 AS truncated FROM i""",
)
def text_hashes(spark: SparkSession, base: str) -> DataFrame:
    return inputs(spark, base).drop("text")


@query(
    "embedding_text_report",
    f"""WITH {INPUTS} SELECT count(*) AS total_rows, count(*) FILTER (text = '[EMPTY]') AS empty_text_rows, count(*) FILTER (length(whole) > 8000) AS truncated_rows,
    sum(greatest(ceil(length(text) / 1.0), 1))::BIGINT AS total_estimated_tokens, sum(greatest(ceil(length(whole) / 1.0), 1))::BIGINT AS original_estimated_tokens,
    min(length(text))::INT AS min_text_characters, median(length(text))::DOUBLE AS median_text_characters, max(length(text))::INT AS max_text_characters FROM i""",
)
def embedding_text_report(spark: SparkSession, base: str) -> DataFrame:
    return emb.input_report(inputs(spark, base))


@query("embedding_batches", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_position, (row_number() OVER (ORDER BY row_id) - 1) // 32 AS batch FROM train")
def embedding_batches(spark: SparkSession, base: str) -> DataFrame:
    return emb.fixed_batches(table(spark, base, "train").select("row_id"), 32)


@query(
    "l2_normalize",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / nullif(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 0), 6) AS squared_length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 5) AS first_value FROM embeddings",
)
def l2_normalize(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings").select("vec_id", emb.l2_normalized("embedding").alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y), 6).alias("squared_length"), F.round(F.col("v")[0], 5).alias("first_value"))


@query("label_requests")
def label_requests(spark: SparkSession, base: str) -> DataFrame:
    recent = table(spark, base, "train").where(F.col("project_start_year").rlike("^20[2-9][0-9]\\z"))
    return labelling.requests(recent, "row_id", TEXTS).drop("text")


#: Documents of the n-gram queries: project names, in lower case with runs of blanks as one.
_NAME = f"regexp_replace(lower(coalesce(project_name, '')), '{BLANK}{{2,}}', ' ', 'g')"
COUNTS = f"""d AS (SELECT row_id, {_NAME} AS t FROM train), g AS (SELECT row_id, n, unnest(generate_series(1, length(t) - n + 1)) AS i, t FROM d, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE length(t) >= n),
c AS (SELECT row_id, substr(t, i, n) AS term, count(*) AS n FROM g GROUP BY ALL)"""
TFIDF = COUNTS + """, vo AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf, sum(n) AS total FROM c GROUP BY ALL HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 300000),
w AS (SELECT row_id, term, (1 + ln(n)) * idf AS w FROM c JOIN vo USING (term)), f AS (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM w)"""


@query("char_tfidf", f"WITH {TFIDF} SELECT row_id, term, round(weight, 6) AS weight FROM f")
def char_tfidf(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "train")
    counts = tfidf.term_counts(rows, "row_id", "project_name", 2, 5)
    return rounded(tfidf.transform(counts, tfidf.fit_vocabulary(counts, rows.count(), 2, 1.0, 300_000)))


@query("text_tfidf")
def text_tfidf(spark: SparkSession, base: str) -> DataFrame:
    """Weights of all four text columns, each with its own vocabulary: row_id, feature (column__gram), weight."""
    rows = table(spark, base, "train")
    return tfidf.text_weights(rows, "row_id", TEXTS, tfidf.fit_vocabularies(rows, TEXTS, rows.count(), 2, 5), 2, 5)


@query(
    "distinctive_ngrams",
    f"""WITH {LEADERS}, dd AS (SELECT t.theme_code, t.policy_domain, t.project_key, lower(concat_ws('。', {', '.join(f"coalesce(p.{c}, '')" for c in TEXTS)})) AS t0 FROM theme t JOIN projects p USING (source_split, project_id)
      WHERE theme_code IN (SELECT theme_code FROM leaders)), d AS (SELECT theme_code, policy_domain, theme_code || '/' || project_key AS id, regexp_replace(t0, '{BLANK}{{2,}}', ' ', 'g') AS t FROM dd),
    g AS (SELECT id, n, unnest(generate_series(1, length(t) - n + 1)) AS i, t FROM d, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE length(t) >= n),
    cn AS (SELECT id, substr(t, i, n) AS term, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT count(*) AS n FROM d),
    vo AS (SELECT term, ln((1 + (SELECT n FROM z)) / (1 + count(*))) + 1 AS idf FROM cn GROUP BY ALL HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM z)),
    w AS (SELECT id, term, (1 + ln(n)) * idf AS w FROM cn JOIN vo USING (term)), f AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w),
    s AS (SELECT theme_code, policy_domain, term, sum(weight) AS s FROM f JOIN d USING (id) GROUP BY ALL), al AS (SELECT term, sum(s) AS t FROM s GROUP BY ALL), k AS (SELECT theme_code, policy_domain, count(*) AS document_count FROM d GROUP BY ALL),
    m AS (SELECT theme_code, policy_domain, term, document_count, s / document_count AS mean_tfidf, s / document_count - coalesce((t - s) / nullif((SELECT n FROM z) - document_count, 0), 0) AS distinctiveness FROM s JOIN al USING (term) JOIN k USING (theme_code, policy_domain)),
    r AS (SELECT *, row_number() OVER (PARTITION BY theme_code, policy_domain ORDER BY round(distinctiveness, 12) DESC, term) AS phrase_rank FROM m WHERE distinctiveness > 0 AND regexp_full_match(term, '[0-9A-Za-zぁ-んァ-ヶ一-龥ー]+'))
    SELECT theme_code, policy_domain, phrase_rank, term AS phrase, round(mean_tfidf, 6) AS mean_tfidf, round(distinctiveness, 6) AS distinctiveness, document_count FROM r WHERE phrase_rank <= 15""",
)
def distinctive_ngrams(spark: SparkSession, base: str) -> DataFrame:
    texts = projects(spark, base).select("source_split", "project_id", *[F.col(c).alias(f"_{c}") for c in TEXTS])
    rows = chosen(spark, base).join(texts, ["source_split", "project_id"])
    text = F.lower(F.concat_ws("。", *[F.coalesce(f"_{c}", F.lit("")) for c in TEXTS]))
    docs = written(rows.select("theme_code", "policy_domain", F.concat_ws("/", "theme_code", "project_key").alias("id"), text.alias("text")))
    return rounded(tfidf.distinctive_ngrams(docs, ["theme_code", "policy_domain"], "id", "text", 2, 5, 2))


@query("resumable_embeddings")
def resumable_embeddings(spark: SparkSession, base: str) -> DataFrame:
    """A first run that got as far as the shorter inputs, and the run that resumes it."""
    todo = emb.prepared_inputs(table(spark, base, "train"), "row_id", TEXTS, 8000)
    make = emb.hashing_embedder(32)
    done = written(emb.generate(todo.where("character_count < 300"), None, make))
    return done.unionByName(emb.generate(todo, done, make))


@query("resumable_labels")
def resumable_labels(spark: SparkSession, base: str) -> DataFrame:
    todo = labelling.requests(table(spark, base, "test"), "row_id", TEXTS)
    return labelling.generate_labels(todo, None, labelling.rule_based_caller)
