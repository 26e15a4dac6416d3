import pytest
from pyspark.sql import functions as F

from kumihimo.operators import embedding as emb, labelling, store

CONFIG = {"model": "offline", "dimension": 8}


@pytest.fixture
def inputs(spark):
    df = spark.createDataFrame([(i, f"本文{i}") for i in range(20)], "id int, p string").repartition(2)
    return labelling.requests(df, "id", ["p"])


class Busy(Exception):
    status_code = 429


def test_retries_follow_the_status():
    calls, pauses = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Busy()
        return "ok"

    assert store.with_retries(call, 4, sleep=pauses.append, uniform=lambda a, b: 1.0) == ("ok", 2) and pauses == [0.5, 1.0]
    bad = Busy()
    bad.status_code = 400
    assert not store.is_retryable(bad) and store.is_retryable(TimeoutError()) and not store.is_retryable(ValueError("no"))
    with pytest.raises(Busy):
        store.with_retries(lambda: (_ for _ in ()).throw(bad), 5, sleep=pauses.append)
    assert len(pauses) == 2


def test_fingerprints_depend_on_all_but_order():
    a = store.fingerprint({"a": 1, "b": [2]})
    assert a == store.fingerprint({"b": [2], "a": 1}) != store.fingerprint({"a": 1, "b": [3]}) and len(a) == 12


def test_vectors_are_planned_bounded_and_resumed(spark, inputs, tmp_path):
    root, make = str(tmp_path), emb.hashing_embedder(8)
    plan, none = store.generate_embeddings(inputs, root, CONFIG, make, dry_run=True, price=1.0)
    assert none is None and plan.todo == 20 and plan.cost_usd > 0 and store.listed(spark, root) == []
    with pytest.raises(ValueError, match="budget"):
        store.generate_embeddings(inputs, root, CONFIG, make, price=1e6, budget_usd=0.01)
    first = inputs.where("row_id < 7")
    store.generate_embeddings(first, root, CONFIG, make)
    plan, vectors = store.generate_embeddings(inputs, root, CONFIG, make, shard=5)
    assert (plan.done, plan.todo, vectors.count()) == (7, 13, 20)
    # complete: returned whatever the budget, without a call
    plan, again = store.generate_embeddings(inputs, root, CONFIG, None, price=1e6, budget_usd=0.0)
    assert plan.todo == 0 and again.count() == 20
    with pytest.raises(ValueError, match="other texts"):
        store.generate_embeddings(inputs.withColumn("text_hash", F.lit("x")), root, CONFIG, make)
    assert store.embedding_metadata(inputs, CONFIG).columns == ["row_id", "text_hash", "estimated_tokens", "model", "dimension", "config_hash"]


def test_failed_batches_are_logged_without_their_text(spark, inputs, tmp_path):
    def make():
        embed = emb.hashing_embedder(8)()

        def call(texts):
            if any("本文3" in t for t in texts):
                raise ValueError("refused")
            return embed(texts)

        return call

    plan, vectors = store.generate_embeddings(inputs, str(tmp_path), CONFIG, make, batch=1, continue_on_error=True)
    assert plan.failed == 1 and vectors.count() == 19
    log = spark.read.json(f"{plan.path}/failures")
    assert "text" not in log.columns and log.first()["error"] == "ValueError"
    plan, vectors = store.generate_embeddings(inputs, str(tmp_path), CONFIG, emb.hashing_embedder(8))
    assert (plan.todo, vectors.count()) == (1, 20)


def test_labels_cost_and_errors(spark, inputs, tmp_path):
    root, config = str(tmp_path), {"model": "rules"}

    def make():
        seen = set()
        ask = labelling.rule_based_caller()

        def call(text):
            if "本文5" in text:
                return "never"
            if text not in seen:
                seen.add(text)
                return "{}"
            return ask(text)

        return call

    plan, none = store.generate_label_store(inputs, root, config, make, dry_run=True, price_in=1.0, price_out=1.0)
    assert none is None and plan.todo == 20 and plan.cost_usd > 0
    with pytest.raises(ValueError, match="budget"):
        store.generate_label_store(inputs, root, config, make, price_in=1e6, budget_usd=0.01)
    plan, labels = store.generate_label_store(inputs, root, config, make, price_in=1.0, price_out=1.0, budget_usd=10.0)
    assert plan.failed == 1 and labels.count() == 19
    assert plan.usage["validation_retries"] == 19 + 3 and plan.usage["call_retries"] == 0 and plan.usage["input_tokens"] > 0
    errors = store.shards(spark, plan.path, "errors")
    assert "text" not in errors.columns and errors.first()["problem"] is not None
    plan, labels = store.generate_label_store(inputs, root, config, labelling.rule_based_caller)
    assert plan.todo == 1 and labels.count() == 20
    assert store.cost_usd({"input_tokens": 2_000_000, "output_tokens": 1_000_000}, 0.5, 2.0) == 3.0


def test_prompt_and_tool_name_all_codes():
    assert all(k in store.label_prompt() for k in labelling.KEYS) and store.label_tool()["schema"]["required"] == labelling.KEYS
