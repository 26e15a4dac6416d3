import math

import pytest
from pyspark.sql import functions as F

from kumihimo.functions import text as x
from kumihimo.functions.expr import global_percent_rank, running_total
from kumihimo.operators import embedding as emb, labelling, tabular, tfidf


def test_normal_form(spark):
    df = spark.createDataFrame([("ＡＩ\t研究\n  5G",), (None,), ("　x ",)], "t string")
    assert [r[0] for r in df.select(x.normalized("t")).collect()] == ["AI 研究 5G", "", "x"]


def test_character_statistics_by_hand(spark):
    df = spark.createDataFrame([("ＡI\n研究。次!",), ("課題123",), ("",), (None,)], "t string").withColumn("t", x.nfkc("t"))
    s = x.character_statistics("t")
    r = df.select(*[v.alias(k.split("__")[1]) for k, v in s.items()]).collect()
    assert (r[0]["char_count"], r[0]["line_count"], r[0]["sentence_count"]) == (8, 2, 2)
    assert (r[0]["latin_ratio"], r[0]["kanji_ratio"], r[0]["punctuation_ratio"]) == (0.25, 0.375, 0.25)
    assert r[1]["digit_ratio"] == pytest.approx(0.6)
    assert r[2]["is_empty"] == r[3]["is_empty"] == 1.0 and r[2]["line_count"] == 0 and r[3]["unique_char_ratio"] == 0


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([("研究5",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(x.character_ngrams("t", 2, 5)).collect()] == [["研究", "究5", "研究5"], [], []]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "abab"), (2, "ab"), (3, "zz")], "row_id int, t string")
    counts = tfidf.term_counts(df, "row_id", "t", 2, 2)
    vocabulary = tfidf.fit_vocabulary(counts, 3, 1)
    w = {(r["row_id"], r["term"]): r["weight"] for r in tfidf.transform(counts, vocabulary).collect()}
    a, b = (1 + math.log(2)) * (math.log(4 / 3) + 1), math.log(4 / 2) + 1
    assert w[(1, "ab")] == pytest.approx(a / math.hypot(a, b)) and w[(2, "ab")] == pytest.approx(1)


def test_vocabulary_is_of_train_only(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abx")], "row_id int, t string")
    counts = tfidf.term_counts(df, "row_id", "t", 2, 2)
    vocabulary = tfidf.fit_vocabulary(counts.where("row_id = 1"), 1, 1)
    assert {r["term"] for r in vocabulary.collect()} == {"ab", "bc"}
    assert {r["term"] for r in tfidf.transform(counts, vocabulary).where("row_id = 2").collect()} == {"ab"}
    index = tfidf.with_feature_index(tfidf.transform(counts, vocabulary), vocabulary)
    assert index.columns == ["row_index", "feature_index", "value"]


def test_distinctive_ngrams_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, g string, t string")
    got = tfidf.distinctive_ngrams(empty, ["g"], "id", "t")
    assert got.count() == 0 and got.columns == ["g", "phrase_rank", "phrase", "mean_tfidf", "distinctiveness", "document_count"]


def test_tabular(spark):
    schema = "row_id int, project_start_year string, project_end_year string, budget double, m string"
    rows = [(1, "2020", "2022", 10.0, "A"), (2, "-1", "2022", -5.0, None), (3, "2022", "2020", None, "B"), (4, "x", None, float("nan"), "A")]
    df = spark.createDataFrame(rows, schema)
    got = {r["row_id"]: r for r in tabular.stateless_features(df, "row_id", ["project_start_year"], ["m"]).collect()}
    assert got[1]["project_duration"] == 2 and got[2]["project_duration"] is None and got[3]["project_duration"] is None
    assert got[2]["project_start_year"] is None and got[2]["log1p_budget"] == 0 and got[3]["log1p_budget"] is None and got[4]["log1p_budget"] is None
    with pytest.raises(ValueError):
        tabular.stateless_features(df, "row_id", ["m"], ["m"])
    fitted = tabular.fit_numeric(df.withColumn("none", F.lit(None).cast("double")).where("budget IS NOT NULL AND NOT isnan(budget)"), ["budget", "none"])
    assert set(fitted) == {"budget"} and fitted["budget"] == (2.5, 2.5, 7.5)
    assert tabular.fit_categories(df, "m") == ["A", "B", tabular.MISSING]
    hot = tabular.one_hot("m", ["A"])
    assert [r[0] for r in df.orderBy("row_id").select(hot["m=A"]).collect()] == [1, 0, 0, 1]


def test_model_inputs(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, " "), (3, "x" * 50, "y")], "id int, p string, q string")
    got = {r["row_id"]: r for r in emb.prepared_inputs(df, "id", ["p", "q"], 10, 2.0).collect()}
    assert got[1]["text"] == "p: a b" and got[2]["text"] == "[EMPTY]" and got[3]["truncated"] and got[3]["character_count"] == 20
    report = emb.input_report(emb.prepared_inputs(df, "id", ["p", "q"], 10, 2.0)).first()
    assert report["total_rows"] == 3 and report["empty_text_rows"] == 1 and report["truncated_rows"] == 1
    assert emb.input_report(emb.prepared_inputs(df.where("false"), "id", ["p"], 10)).first()["total_rows"] == 0
    with pytest.raises(ValueError):
        emb.prepared_inputs(df, "id", ["p"], 0)


def test_batches_are_contiguous(spark):
    ids = spark.createDataFrame([(i * 7,) for i in range(100)], "row_id long").repartition(5)
    got = sorted((r["row_id"], r["row_position"], r["batch"]) for r in emb.fixed_batches(ids, 32).collect())
    assert [g[1] for g in got] == list(range(100)) and got[-1][2] == 3


def test_generation_resumes(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "id int, p string")
    inputs = emb.prepared_inputs(df, "id", ["p"], 100)
    done = spark.createDataFrame(emb.generate(inputs.where("row_id < 4"), None, emb.hashing_embedder(8)).collect(), "row_id int, text_hash string, embedding array<float>")
    rest = emb.generate(inputs, done, emb.hashing_embedder(8))
    assert sorted(r["row_id"] for r in rest.collect()) == [4, 5, 6, 7, 8]
    emb.check_vectors(done, "embedding", 8)
    with pytest.raises(ValueError, match="dimension"):
        emb.check_vectors(done, "embedding", 9)
    with pytest.raises(ValueError, match="order mismatch"):
        emb.check_alignment(done, inputs, "row_id", "text_hash")
    emb.check_alignment(done, inputs.where("row_id < 4"), "row_id", "text_hash")


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(emb.l2_normalized("v")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


VALID = {"policy_domain": "D01", "admin_process": "A01", "ai_usecase": ["U01"], "ai_applicability": 1, "classification_reason": "r"}


@pytest.mark.parametrize("change, problem", [
    ({}, None), ({"policy_domain": "D16"}, "policy_domain"), ({"admin_process": "A14"}, "admin_process"), ({"ai_usecase": []}, "ai_usecase"), ({"ai_usecase": ["U01"] * 2}, "ai_usecase"),
    ({"ai_usecase": ["U01", "U02", "U03", "U04"]}, "ai_usecase"), ({"ai_usecase": ["U99", "U01"]}, "none_with_others"), ({"ai_applicability": True}, "ai_applicability"), ({"ai_applicability": 3}, "ai_applicability"),
    ({"ai_applicability": 0}, "applicability_and_none"), ({"classification_reason": " "}, "classification_reason"), ({"classification_reason": "x" * 1001}, "classification_reason"), ({"extra": 1}, "keys"),
])
def test_answers_are_checked(change, problem):
    assert labelling.payload_problem(VALID | change) == problem


def test_json_is_found_in_answers(spark):
    assert labelling.first_json_object('x {bad} ```json\n{"a": 1}\n```') == {"a": 1}
    assert labelling.first_json_object(None) is None and labelling.first_json_object("[1]") is None
    df = spark.createDataFrame([('{"policy_domain": "D01", "admin_process": "A01", "ai_usecase": ["U99"], "ai_applicability": 0, "classification_reason": "r"}',), ("none",)], "a string")
    assert [r["violations"] for r in labelling.parse_answers(df, "a").collect()] == [[], ["policy_domain", "admin_process", "use_case_count", "applicability", "reason"]]


def test_labels_are_asked_for_again(spark):
    def make():
        calls = []

        def ask(text):
            calls.append(text)
            return "no json" if len(calls) % 2 else labelling.rule_based_caller()(text)

        return ask

    df = spark.createDataFrame([(1, "a")], "id int, p string").coalesce(1)
    got = labelling.generate_labels(labelling.requests(df, "id", ["p"]), None, make).first()
    assert got["problem"] is None and got["retries"] == 1
    never = labelling.generate_labels(labelling.requests(df, "id", ["p"]), None, lambda: lambda t: "no").first()
    assert never["problem"] == "no object" and never["policy_domain"] is None


def test_running_total_and_ranks(spark):
    df = spark.createDataFrame([(float(i % 10), 1) for i in range(100)] + [(None, 1)], "v double, n int")
    got = {r["v"]: r["p"] for r in global_percent_rank(df, "v", "p").collect()}
    assert got[0.0] == pytest.approx(0.055) and got[9.0] == pytest.approx(0.955) and got[None] is None
    per = running_total(df.where("v IS NOT NULL").groupBy("v").agg(F.sum("n").alias("n")), "v", "n", "t")
    assert {r["v"]: r["t"] for r in per.collect()} == {float(i): 10 * (i + 1) for i in range(10)}



def test_stored_labels_are_checked(spark):
    schema = "k string, policy_domain string, admin_process string, ai_usecase string, ai_applicability int, classification_reason string"
    good = spark.createDataFrame([("a", "D01", "A01", "U01|U02", 1, "r")], schema)
    expected = spark.createDataFrame([("a",)], "k string")
    assert labelling.load_labels(good, expected, "k").count() == 1
    for bad in (good.unionByName(good), good.withColumn("k", F.lit("b")), good.withColumn("ai_applicability", F.lit(0))):
        with pytest.raises(ValueError):
            labelling.load_labels(bad, expected, "k")


def test_chat_answers():
    tool = {"output": {"message": {"content": [{"toolUse": {"input": {"a": 1}}}]}}, "usage": {"inputTokens": 3, "outputTokens": 2}}
    assert labelling.tool_or_text_answer(tool) == ({"a": 1}, 3, 2)
    assert labelling.tool_or_text_answer({"output": {"message": {"content": [{"text": 'x {"b": 2}'}]}}}) == ({"b": 2}, 0, 0)


def test_token_batches(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 3, 3, 20, 1, 1, 1])], "row_id int, estimated_tokens long").coalesce(1)
    assert [r["batch"] for r in emb.token_batches(df, 6, 2).orderBy("row_id").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_ngrams_of_batches_are_those_of_the_joins(spark, monkeypatch):
    import numpy as np

    from kumihimo.functions import grams

    rows = [(i, x, y) for i, (x, y) in enumerate([("Aa\x00Aa  b", "道路の整備"), ("道路の 整備の整備", None), (None, "aa aa"), ("", ""), ("😀😀道路", "整備の整備😀é"), ("aa", "a")])]
    df = spark.createDataFrame(rows, "row_id long, a string, b string")
    expected = {}
    for c in ("a", "b"):
        counts = tfidf.term_counts(df, "row_id", c, 2, 5)
        expected |= {(r["row_id"], f"{c}__{r['term']}"): r["weight"] for r in tfidf.transform(counts, tfidf.fit_vocabulary(counts, 6, 2, 1.0, 7)).collect()}
    fitted = tfidf.fit_vocabularies(df, ["a", "b"], 6, 2, 5, max_features=7)
    got = {(r["row_id"], r["feature"]): r["weight"] for r in tfidf.text_weights(df, "row_id", ["a", "b"], fitted, 2, 5).collect()}
    assert got == pytest.approx(expected) and len(got) == 10
    vectors, width = tfidf.text_vectors(df, "row_id", ["a", "b"], fitted, 2, 5)
    names = [f"{c}__{t}" for c, (terms, _) in zip("ab", fitted) for t in terms]
    assert width == len(names)
    seen = {(r["row_id"], names[i]): v for r in vectors.collect() for i, v in zip(r["tfidf"].indices.tolist(), r["tfidf"].values)}
    assert seen == pytest.approx(expected, rel=1e-6) and vectors.count() == 6
    # terms of one hash are told apart
    texts = ["道路の 整備の整備", "", "整備の整備😀é"]
    before = grams.Vocabulary(fitted[1][0], fitted[1][1].idf).weights(texts, 2, 5)
    monkeypatch.setattr(grams, "hashed", lambda lo, hi: lo % np.uint64(2))
    after = grams.Vocabulary(fitted[1][0], fitted[1][1].idf).weights(texts, 2, 5)
    assert len(before[0]) and all((x == y).all() for x, y in zip(before[:2], after[:2])) and after[2] == pytest.approx(before[2])


def test_weights_of_a_row_need_no_join(spark, monkeypatch):
    from kumihimo.plans import textual

    train = spark.createDataFrame([(i, *["同じ文の文"] * 4) for i in range(3)], "row_id long, " + ", ".join(f"{c} string" for c in textual.TEXTS))
    monkeypatch.setattr(textual, "table", lambda *a: train)
    out = textual.text_tfidf(spark, "")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 3 * 4 * 10


def test_weights_of_distinctive_ngrams_are_made_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", "道路の整備"), (2, "a", "道路の点検"), (3, "b", "河川の点検"), (4, "b", "河川の整備")], "id long, g string, t string")
    plans = []
    real = tfidf.written
    monkeypatch.setattr(tfidf, "written", lambda x, *a: plans.append(x) or real(x, *a))
    got = tfidf.distinctive_ngrams(df, ["g"], "id", "t", 2, 3, 2)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString() and plans
    assert {(r["g"], r["phrase"]) for r in got.where("phrase_rank <= 2").collect()} == {("a", "路の"), ("a", "道路"), ("b", "川の"), ("b", "河川")}
