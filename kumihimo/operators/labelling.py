"""Labels from a model that answers in JSON: requests, answers, rules, resumable runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kumihimo.functions.text import sectioned_text, text_hash
from kumihimo.operators.taxonomy import DOMAINS, NO_USE, PROCESSES, USE_CASES, rule_violations

Caller = Callable[[str], str]
KEYS = ["policy_domain", "admin_process", "ai_usecase", "ai_applicability", "classification_reason"]
_PAYLOAD = T.StructType(
    [
        T.StructField("policy_domain", T.StringType()),
        T.StructField("admin_process", T.StringType()),
        T.StructField("ai_usecase", T.ArrayType(T.StringType())),
        T.StructField("ai_applicability", T.IntegerType()),
        T.StructField("classification_reason", T.StringType()),
    ]
)


def requests(df: DataFrame, id_column: str, columns: Sequence[str], most_characters: int = 2000, chars_per_token: float = 1.0) -> DataFrame:
    """row_id, text, text_hash, estimated_tokens: what the model is asked about each row."""
    text = sectioned_text(columns, most_characters)
    rows = df.select(F.col(id_column).alias("row_id"), text.alias("text"))
    return rows.select("row_id", "text", text_hash("text").alias("text_hash"), F.greatest(F.ceil(F.length("text") / F.lit(chars_per_token)), F.lit(1)).cast("long").alias("estimated_tokens"))


def first_json_object(answer: str | None) -> dict | None:
    """The first JSON object in an answer, in a fence or not; None if there is none."""
    decoder = json.JSONDecoder()
    for at in [i for i, ch in enumerate(answer or "") if ch == "{"]:
        try:
            value, _ = decoder.raw_decode(answer, at)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def payload_problem(value: dict | None) -> str | None:
    """The first rule that an answer breaks, None if it breaks none."""
    if value is None:
        return "no object"
    if set(value) != set(KEYS):
        return "keys"
    if value["policy_domain"] not in DOMAINS:
        return "policy_domain"
    if value["admin_process"] not in PROCESSES:
        return "admin_process"
    uses = value["ai_usecase"]
    if not isinstance(uses, list) or not 1 <= len(uses) <= 3 or any(u not in USE_CASES for u in uses) or len(set(map(str, uses))) < len(uses):
        return "ai_usecase"
    if NO_USE in uses and len(uses) > 1:
        return "none_with_others"
    level = value["ai_applicability"]
    if isinstance(level, bool) or not isinstance(level, int) or not 0 <= level <= 2:
        return "ai_applicability"
    if (level == 0) != (uses == [NO_USE]):
        return "applicability_and_none"
    reason = value["classification_reason"]
    if not isinstance(reason, str) or not reason.strip() or len(reason) > 1000:
        return "classification_reason"
    return None


def parse_answers(df: DataFrame, c: str) -> DataFrame:
    """``df`` with the answer's object in ``payload`` (fields NULL where of another type) and its violations."""

    @F.pandas_udf(T.StringType())
    def found(values):
        import pandas as pd

        return pd.Series([json.dumps(v) if (v := first_json_object(x)) is not None else None for x in values], dtype="object")

    parsed = df.withColumn("payload", F.from_json(found(F.col(c)), _PAYLOAD))
    p = F.col("payload")
    return parsed.withColumn("violations", rule_violations(p["policy_domain"], p["admin_process"], p["ai_usecase"], p["ai_applicability"], p["classification_reason"]))


def generate_labels(inputs: DataFrame, done: DataFrame | None, caller: Callable[[], Caller], attempts: int = 3) -> DataFrame:
    """One row per input not done: labels, or the problem that remained after ``attempts``.

    An answer that breaks a rule is asked for again, and so is a call that failed; both are
    counted. Appending rows without a problem to the done table resumes an interrupted run.
    """
    todo = inputs.select("row_id", "text_hash", "text")
    if done is not None:
        todo = todo.join(done.select("row_id", "text_hash"), ["row_id", "text_hash"], "left_anti")
    names = ["row_id", "text_hash", "policy_domain", "admin_process", "ai_usecase", "ai_applicability", "classification_reason", "retries", "problem"]
    id_type = inputs.schema["row_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = caller()
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                value, problem, tries = None, None, 0
                for tries in range(attempts):
                    try:
                        value = first_json_object(ask(text))
                        problem = payload_problem(value)
                    except (ConnectionError, TimeoutError) as e:
                        value, problem = None, type(e).__name__
                    if problem is None:
                        break
                ok = value if problem is None else {}
                rows.append((ok.get("policy_domain"), ok.get("admin_process"), "|".join(ok["ai_usecase"]) if ok else None, ok.get("ai_applicability"), ok.get("classification_reason"), tries, problem))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=names)

    kinds = [id_type, T.StringType(), T.StringType(), T.StringType(), T.StringType(), T.IntegerType(), T.StringType(), T.IntegerType(), T.StringType()]
    return todo.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def rule_based_caller() -> Caller:
    """A deterministic caller without a network, for tests and dry runs."""
    import zlib

    def ask(text: str) -> str:
        h = zlib.crc32(text.encode())
        level = h % 3
        uses = [NO_USE] if level == 0 else [USE_CASES[h // 7 % 11]]
        return json.dumps({"policy_domain": DOMAINS[h % 15], "admin_process": PROCESSES[h // 5 % 13], "ai_usecase": uses, "ai_applicability": level, "classification_reason": "by rule"})

    return ask


def load_labels(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Stored labels of exactly the expected keys, once each, each valid again; else ValueError."""
    keys = stored.groupBy(key).agg(F.count("*").alias("n"))
    both = keys.withColumn("_l", F.lit(1)).join(expected.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    broken = rule_violations(F.col("policy_domain"), F.col("admin_process"), F.filter(F.split("ai_usecase", "[|]"), lambda x: x != ""), F.col("ai_applicability"), F.col("classification_reason"))
    row = both.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("odd")).first()
    invalid = stored.where(F.size(broken) > 0).count()
    if row["repeated"] or row["odd"] or invalid:
        raise ValueError(f"{row['repeated']} keys are repeated, {row['odd']} are on one side only, {invalid} rows break a rule")
    return stored


def tool_or_text_answer(response: dict) -> tuple[dict | None, int, int]:
    """The object in a chat response, from a tool call or else the text, and its token counts."""
    parts = response.get("output", {}).get("message", {}).get("content", [])
    usage = response.get("usage", {})
    value = next((p["toolUse"]["input"] for p in parts if isinstance(p.get("toolUse", {}).get("input"), dict)), None)
    if value is None:
        value = first_json_object("\n".join(p["text"] for p in parts if "text" in p))
    return value, int(usage.get("inputTokens", 0)), int(usage.get("outputTokens", 0))
