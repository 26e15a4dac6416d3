"""Stores of generated vectors and labels: planned, bounded by a budget, resumable, checked.

A store is a folder named by a fingerprint of its configuration. Results are appended to it
as shards, one job each, so an interrupted run loses at most one shard; a second run makes
only what is missing. Failures are a table of their own and hold no text that was sent.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kumihimo.operators.embedding import Embedder, check_alignment, check_vectors
from kumihimo.operators.labelling import Caller, KEYS, first_json_object, payload_problem
from kumihimo.operators.taxonomy import DOMAINS, PROCESSES, USE_CASES
from kumihimo.sources.shared import written

#: States of a service that a later call may not meet again.
RETRYABLE_STATUS = (408, 409, 429, 500, 502, 503, 504)
RETRYABLE_NAMES = ("timeout", "throttl", "temporar", "connection", "unavailable")


def fingerprint(config: Mapping) -> str:
    """12 hexadecimal digits that any change of the configuration changes, the order of keys aside."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def exception_status(error: BaseException) -> int | None:
    """The status code of a failed call: of the error itself, or of the response it carries."""
    response = getattr(error, "response", None)
    for value in (getattr(error, "status_code", None), getattr(error, "status", None), getattr(response, "status_code", None)):
        if isinstance(value, int):
            return value
    meta = response.get("ResponseMetadata", {}) if isinstance(response, dict) else {}
    return meta.get("HTTPStatusCode") if isinstance(meta.get("HTTPStatusCode"), int) else None


def is_retryable(error: BaseException) -> bool:
    status = exception_status(error)
    if status is not None:
        return status in RETRYABLE_STATUS
    name = f"{type(error).__name__} {error}".lower()
    return isinstance(error, ConnectionError | TimeoutError) or any(x in name for x in RETRYABLE_NAMES)


def with_retries(call: Callable, attempts: int, base: float = 0.5, sleep: Callable[[float], None] = time.sleep, uniform: Callable = random.uniform):
    """(result, retries): ``call`` repeated while it fails in a way that may pass, with growing, jittered pauses."""
    for attempt in range(attempts):
        try:
            return call(), attempt
        except Exception as error:
            if attempt + 1 == attempts or not is_retryable(error):
                raise
            sleep(base * 2**attempt * uniform(0.5, 1.5))
    raise ValueError("attempts must be 1 or more")


@dataclass
class Plan:
    """What a run would do: rows of the inputs, done and to do, tokens to send, worst-case cost."""

    path: str
    rows: int
    done: int
    todo: int
    tokens: int
    cost_usd: float
    dry_run: bool = False
    failed: int = 0
    usage: dict = field(default_factory=dict)


def folder(root: str, config: Mapping) -> str:
    return f"{root.rstrip('/')}/{fingerprint(config)}"


def path_of(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, root: str) -> list[str]:
    """Names of the stores below a folder, in order; none if there is no such folder."""
    fs, p = path_of(spark, root)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def open_store(spark: SparkSession, root: str, config: Mapping) -> str:
    """The store's folder, its configuration written once; ValueError if it holds another one."""
    path = folder(root, config)
    fs, p = path_of(spark, f"{path}/config")
    text = json.dumps(config, sort_keys=True, ensure_ascii=False)
    if fs.exists(p):
        held = spark.read.text(f"{path}/config").first()[0]
        if held != text:
            raise ValueError(f"{path} holds another configuration")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/config")
    return path


def shards(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """All finished shards of a store; a job that was broken off leaves none."""
    names = [n for n in listed(spark, f"{path}/{kind}") if path_of(spark, f"{path}/{kind}/{n}/_SUCCESS")[0].exists(path_of(spark, f"{path}/{kind}/{n}/_SUCCESS")[1])]
    return spark.read.parquet(*[f"{path}/{kind}/{n}" for n in names]) if names else None


def missing_inputs(inputs: DataFrame, done: DataFrame | None) -> DataFrame:
    """Inputs without a result; ValueError where a result is of another text than its row's."""
    if done is None:
        return inputs
    held = done.select("row_id", F.col("text_hash").alias("_held")).distinct()
    both = inputs.join(held, "row_id", "left")
    if n := both.where("_held <> text_hash").count():
        raise ValueError(f"{n} stored results are of other texts")
    return both.where("_held IS NULL").drop("_held")


def planned(inputs: DataFrame, todo: DataFrame, path: str, price_in: float, price_out: float = 0.0, most_out: int = 0, attempts: int = 1, overhead: int = 0) -> Plan:
    """The plan of a run at prices in USD per million tokens, were every attempt needed."""
    if price_in < 0 or price_out < 0 or attempts < 1:
        raise ValueError("prices must not be negative, attempts not below 1")
    rows = inputs.count()
    row = todo.agg(F.count("*").alias("n"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("t")).first()
    tokens = int(row["t"]) + overhead * row["n"]
    cost = attempts * (tokens * price_in + most_out * row["n"] * price_out) / 1e6
    return Plan(path, rows, rows - row["n"], row["n"], tokens, cost)


def guard(plan: Plan, budget_usd: float | None) -> None:
    """Raises before any call if the worst case is above the budget."""
    if budget_usd is not None and plan.cost_usd > budget_usd:
        raise ValueError(f"the worst case of {plan.cost_usd:.4f} USD is above the budget of {budget_usd} USD")


def in_shards(todo: DataFrame, size: int) -> Iterator[DataFrame]:
    """Disjoint parts of about ``size`` rows by a hash of the id, none of them gathered."""
    n = max(1, -(-todo.count() // size))
    for k in range(n):
        yield todo.where(F.pmod(F.xxhash64("row_id"), F.lit(n)) == k) if n > 1 else todo


def embedding_metadata(inputs: DataFrame, config: Mapping) -> DataFrame:
    """One row per input without its text: id, hash, sizes, and the configuration it was made with."""
    kept = [c for c in ("split", "row_id", "project_id", "row_position", "text_hash", "estimated_tokens", "truncated", "is_empty") if c in inputs.columns]
    constants = {"model": config.get("model"), "dimension": config.get("dimension"), "config_hash": fingerprint(config)}
    return inputs.select(*kept, *[F.lit(v).alias(k) for k, v in constants.items()])


def generate_embeddings(
    inputs: DataFrame, root: str, config: Mapping, embedder: Callable[[], Embedder], *, dry_run: bool = False, price: float = 0.0,
    budget_usd: float | None = None, shard: int = 100_000, batch: int = 32, attempts: int = 3, continue_on_error: bool = False,
) -> tuple[Plan, DataFrame | None]:
    """Vectors of all inputs (row_id, text_hash, text, estimated_tokens), from the store and newly made.

    A complete store is returned before any look at the budget. A dry run writes nothing and
    calls nothing. With ``continue_on_error`` a batch whose calls all fail is logged and left
    for the next run; otherwise the run ends there, the finished shards kept. The result is
    checked: each id once, hashes as in the inputs, vectors finite and of one dimension.
    """
    spark = inputs.sparkSession
    path = folder(root, config)
    done = shards(spark, path, "vectors")
    todo = missing_inputs(inputs, done)
    plan = planned(inputs, todo, path, price)
    if dry_run:
        plan.dry_run = True
        return plan, None
    if plan.todo:
        guard(plan, budget_usd)
        open_store(spark, root, config)
        number = len(listed(spark, f"{path}/vectors"))
        for k, part in enumerate(in_shards(written(todo), shard)):
            got = written(_vectors(part, embedder, batch, attempts, continue_on_error))
            failed = got.where("error IS NOT NULL").select("row_id", "text_hash", "error")
            n = failed.count()
            if n:
                failed.write.mode("append").json(f"{path}/failures")
                plan.failed += n
            got.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{path}/vectors/{number + k:06d}")
    vectors = shards(spark, path, "vectors")
    if vectors is None:
        return plan, None
    vectors = vectors.join(inputs.select("row_id"), "row_id", "left_semi")
    if not plan.failed:
        check_alignment(vectors, inputs, "row_id", "text_hash")
        check_vectors(vectors, "embedding", int(config["dimension"]))
    return plan, vectors


def _vectors(todo: DataFrame, embedder: Callable[[], Embedder], batch: int, attempts: int, continue_on_error: bool) -> DataFrame:
    schema = T.StructType([todo.schema["row_id"], T.StructField("text_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = embedder()
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                texts, error = part.column(2).to_pylist(), None
                try:
                    vectors, _ = with_retries(lambda: client(texts), attempts)
                    if len(vectors) != len(texts):
                        raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
                    vectors = [list(map(float, v)) for v in vectors]
                except Exception as e:
                    if not continue_on_error:
                        raise
                    vectors, error = [None] * len(texts), type(e).__name__
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float32())), pa.array([error] * len(texts), pa.string())], names=schema.fieldNames())

    return todo.select("row_id", "text_hash", "text").mapInArrow(run, schema)


def label_prompt() -> str:
    """What a model is told before a record: the answer's keys and the codes they may hold."""
    return (
        f"Answer with one JSON object with the keys {', '.join(KEYS)}. policy_domain is one of {', '.join(DOMAINS)}; admin_process one of {', '.join(PROCESSES)}; "
        f"ai_usecase a list of one to three of {', '.join(USE_CASES)}, {USE_CASES[-1]} only by itself and only with ai_applicability 0; "
        "ai_applicability is 0, 1 or 2; classification_reason is a short sentence."
    )


def label_tool() -> dict:
    """The same as the schema of a tool, for models that answer by calling one."""
    kinds = {
        "policy_domain": {"type": "string", "enum": DOMAINS}, "admin_process": {"type": "string", "enum": PROCESSES},
        "ai_usecase": {"type": "array", "items": {"type": "string", "enum": USE_CASES}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
        "ai_applicability": {"type": "integer", "minimum": 0, "maximum": 2}, "classification_reason": {"type": "string", "maxLength": 1000},
    }
    return {"name": "label", "schema": {"type": "object", "properties": {k: kinds[k] for k in KEYS}, "required": list(KEYS), "additionalProperties": False}}


def prior_usage(done: DataFrame | None, failures: DataFrame | None) -> dict:
    """Tokens and retries spent so far, over finished and failed rows."""
    columns = ["input_tokens", "output_tokens", "validation_retries", "call_retries"]
    parts = [d.select(*columns) for d in (done, failures) if d is not None]
    if not parts:
        return dict.fromkeys(columns, 0)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    row = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).first()
    return {c: int(row[c]) for c in columns}


def cost_usd(usage: Mapping, price_in: float, price_out: float) -> float:
    """Linear in tokens, at prices in USD per million."""
    return (usage["input_tokens"] * price_in + usage["output_tokens"] * price_out) / 1e6


_LABELS = "text_hash string, policy_domain string, admin_process string, ai_usecase string, ai_applicability int, classification_reason string, validation_retries int, call_retries int, input_tokens long, output_tokens long, problem string"


def _labelled(todo: DataFrame, caller: Callable[[], Caller], attempts: int, per_token: float) -> DataFrame:
    schema = T.StructType([todo.schema["row_id"], *T.StructType.fromDDL(_LABELS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = caller()
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                bad = failed = sent = got = 0
                value, problem = None, "no answer"
                for _ in range(attempts):
                    sent += max(1, -(-len(text) // per_token).__int__())
                    try:
                        answer, more = with_retries(lambda: ask(text), attempts)
                    except Exception as e:
                        problem, failed = type(e).__name__, failed + attempts - 1
                        break
                    failed += more
                    got += max(1, -(-len(answer or "") // per_token).__int__())
                    value = first_json_object(answer)
                    problem = payload_problem(value)
                    if problem is None:
                        break
                    bad += 1
                ok = value if problem is None else {}
                uses = "|".join(ok["ai_usecase"]) if ok else None
                rows.append((ok.get("policy_domain"), ok.get("admin_process"), uses, ok.get("ai_applicability"), ok.get("classification_reason"), bad, failed, sent, got, problem))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=schema.fieldNames())

    return todo.select("row_id", "text_hash", "text").mapInArrow(run, schema)


def generate_label_store(
    inputs: DataFrame, root: str, config: Mapping, caller: Callable[[], Caller], *, dry_run: bool = False, price_in: float = 0.0, price_out: float = 0.0,
    most_out: int = 300, budget_usd: float | None = None, shard: int = 100_000, attempts: int = 3, chars_per_token: float = 1.0, continue_on_error: bool = True,
) -> tuple[Plan, DataFrame | None]:
    """Labels of all inputs (row_id, text_hash, text, estimated_tokens), from the store and newly asked for.

    Before any call the worst case, every attempt of every row, is set against the budget; before
    each shard what is spent and the shard's worst case. Broken answers and failed calls are counted
    apart. Rows that stay without a valid answer go to the table of errors, without their
    text, and are asked for again by the next run; without ``continue_on_error`` they end the run.
    Stored labels are validated again.
    """
    spark = inputs.sparkSession
    path = folder(root, config)
    done = shards(spark, path, "labels")
    failures = shards(spark, path, "errors")
    overhead = -(-len(label_prompt()) // max(int(chars_per_token), 1))
    todo = missing_inputs(inputs, done)
    plan = planned(inputs, todo, path, price_in, price_out, most_out, attempts, overhead)
    plan.usage = prior_usage(done, failures)
    if dry_run:
        plan.dry_run = True
        return plan, None
    if plan.todo:
        guard(plan, budget_usd)
        open_store(spark, root, config)
        number = len(listed(spark, f"{path}/labels"))
        for k, part in enumerate(in_shards(written(todo), shard)):
            worst = planned(part, part, path, price_in, price_out, most_out, attempts, overhead)
            if budget_usd is not None and cost_usd(plan.usage, price_in, price_out) + worst.cost_usd > budget_usd:
                raise ValueError("the budget doesn't hold for the next shard")
            got = written(_labelled(part, caller, attempts, chars_per_token))
            bad = got.where("problem IS NOT NULL")
            n = bad.count()
            if n:
                bad.drop("policy_domain", "admin_process", "ai_usecase", "ai_applicability", "classification_reason").write.mode("overwrite").parquet(f"{path}/errors/{number + k:06d}")
                plan.failed += n
            got.where("problem IS NULL").drop("problem").write.mode("overwrite").parquet(f"{path}/labels/{number + k:06d}")
            plan.usage = {c: v + prior_usage(got, None)[c] for c, v in plan.usage.items()}
            if n and not continue_on_error:
                raise ValueError(f"{n} rows have no valid label")
    labels = shards(spark, path, "labels")
    if labels is None:
        return plan, None
    from kumihimo.operators.labelling import load_labels

    labels = labels.join(inputs.select("row_id"), "row_id", "left_semi")
    load_labels(labels, labels.select("row_id"), "row_id")
    return plan, labels
