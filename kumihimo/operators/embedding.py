"""Inputs of embedding models, resumable generation, and checks of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kumihimo.functions.expr import range_of
from kumihimo.functions.text import collapsed, labelled_text, nfkc, text_hash

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def prepared_inputs(df: DataFrame, id_column: str, columns: Sequence[str], most_tokens: int, chars_per_token: float = 1.0, normal_form: bool = True) -> DataFrame:
    """row_id, text, text_hash, character_count, estimated_tokens, original_estimated_tokens, truncated.

    The labelled text is cut to what the model takes; the hash is of the text that is sent.
    """
    if most_tokens <= 0 or chars_per_token <= 0:
        raise ValueError("most_tokens and chars_per_token must be greater than 0")
    rows = df.withColumns({c: nfkc(c) for c in columns}) if normal_form else df
    rows = rows.select(F.col(id_column).alias("row_id"), *[collapsed(F.col(c)).alias(c) for c in columns])
    limit = max(1, int(most_tokens * chars_per_token))
    whole = rows.select("row_id", labelled_text(columns, prepared=True).alias("_text"))

    def tokens(c: Column) -> Column:
        return F.greatest(F.ceil(F.length(c) / F.lit(chars_per_token)), F.lit(1)).cast("long")

    cut = whole.withColumn("text", F.substring("_text", 1, limit))
    return cut.select(
        "row_id", "text", text_hash("text").alias("text_hash"), F.length("text").alias("character_count"), tokens(F.col("text")).alias("estimated_tokens"),
        tokens(F.col("_text")).alias("original_estimated_tokens"), (F.length("_text") > limit).alias("truncated"),
    )


def input_report(inputs: DataFrame) -> DataFrame:
    """One row: rows, empty and truncated ones, tokens, and lengths."""
    return inputs.agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("text") == "[EMPTY]").alias("empty_text_rows"), F.count_if("truncated").alias("truncated_rows"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_estimated_tokens"), F.coalesce(F.sum("original_estimated_tokens"), F.lit(0)).alias("original_estimated_tokens"),
        F.coalesce(F.min("character_count"), F.lit(0)).alias("min_text_characters"), F.coalesce(F.median("character_count"), F.lit(0.0)).alias("median_text_characters"),
        F.coalesce(F.max("character_count"), F.lit(0)).alias("max_text_characters"),
    )


def fixed_batches(inputs: DataFrame, size: int, buckets: int = 64) -> DataFrame:
    """row_id, row_position, batch: positions in the order of the ids, ``size`` to a batch.

    Positions are numbered within ranges of ids and shifted by the ranges' sizes, of which
    there are at most ``buckets``, so no task holds all rows.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    cuts = inputs.agg(F.percentile_approx("row_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    ranged = inputs.select("row_id", range_of(F.col("row_id"), sorted(set(cuts))).alias("_range"))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy("row_id")
    placed = ranged.join(F.broadcast(offsets), "_range").withColumn("row_position", F.col("_offset") + F.row_number().over(inside) - 1)
    return placed.select("row_id", "row_position", F.floor(F.col("row_position") / size).alias("batch"))


def l2_normalized(c: str) -> Column:
    """A vector of length 1; the zero vector stays zero."""
    v = F.col(c)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def check_vectors(vectors: DataFrame, c: str, dimension: int) -> None:
    """Raises where a vector is missing, of another length, or not finite."""
    bad = F.col(c).isNull() | (F.size(c) != dimension) | F.exists(F.col(c), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = vectors.where(bad).count()
    if n:
        raise ValueError(f"{n} vectors are missing, not finite or not of dimension {dimension}")


def check_alignment(vectors: DataFrame, expected: DataFrame, id_column: str, hash_column: str | None = None) -> None:
    """Raises unless both tables have the same ids once each, with equal text hashes."""
    columns = [id_column] + ([hash_column] if hash_column else [])
    left = vectors.select(*columns).withColumnRenamed(hash_column, "_a") if hash_column else vectors.select(id_column).withColumn("_a", F.lit(""))
    right = expected.select(*columns).withColumnRenamed(hash_column, "_b") if hash_column else expected.select(id_column).withColumn("_b", F.lit(""))
    per = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), id_column, "full_outer")
    bad = per.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).count()
    extra = vectors.count() - expected.count()
    if bad or extra:
        raise ValueError(f"project_id order mismatch: {bad} ids differ, {extra} rows too many")


def generate(inputs: DataFrame, done: DataFrame | None, embedder: Callable[[], Embedder], batch: int = 32, attempts: int = 3) -> DataFrame:
    """row_id, text_hash, embedding for the inputs that ``done`` doesn't hold yet.

    ``embedder`` makes a client within each task, which takes a list of texts. Failed calls
    are repeated up to ``attempts`` times with growing pauses. Appending the result to the
    done table and calling again resumes an interrupted run; a changed text is a new input.
    """
    todo = inputs.select("row_id", "text_hash", "text")
    if done is not None:
        todo = todo.join(done.select("row_id", "text_hash"), ["row_id", "text_hash"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        client = embedder()
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                texts = part.column(2).to_pylist()
                for attempt in range(attempts):
                    try:
                        vectors = client(texts)
                        break
                    except (ConnectionError, TimeoutError):
                        if attempt + 1 == attempts:
                            raise
                        time.sleep(0.1 * 2**attempt)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=["row_id", "text_hash", "embedding"])

    schema = T.StructType([T.StructField("row_id", inputs.schema["row_id"].dataType), T.StructField("text_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return todo.mapInArrow(run, schema)


def hashing_embedder(dimension: int = 64) -> Callable[[], Embedder]:
    """A deterministic embedder without a network: signed hashes of character 2-grams."""

    def make() -> Embedder:
        import zlib

        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * dimension
                for i in range(len(t) - 1):
                    h = zlib.crc32(t[i : i + 2].encode())
                    v[h % dimension] += 1.0 if h & 0x80000000 else -1.0
                out.append(v)
            return out

        return embed

    return make


def token_batches(inputs: DataFrame, most_tokens: int, most_rows: int) -> DataFrame:
    """row_id, part, batch: consecutive inputs of a partition, a batch full at either bound.

    An input above the bound of tokens is a batch of its own.
    """
    if most_tokens <= 0 or most_rows <= 0:
        raise ValueError("bounds must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tokens, rows = 0, 0, 0
        for whole in batches:
            out = []
            for n in whole.column(1).to_pylist():
                if rows and (tokens + n > most_tokens or rows >= most_rows):
                    number, tokens, rows = number + 1, 0, 0
                tokens, rows = tokens + n, rows + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(out, pa.int64())], names=["row_id", "batch"])

    schema = T.StructType([inputs.schema["row_id"], T.StructField("batch", T.LongType())])
    return inputs.select("row_id", "estimated_tokens").mapInArrow(run, schema).withColumn("part", F.spark_partition_id())
