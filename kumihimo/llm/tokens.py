"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: File name of the vocabulary, and the folder that holds it on every executor; the folder
#: can be set by the environment or given to the functions.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def load_encoding(folder: str, vocabulary: str):
    """A byte-level BPE encoding from a file of ranks."""
    import base64
    import importlib.util
    from pathlib import Path

    import tiktoken

    spec = importlib.util.spec_from_file_location("vocabulary_folder", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(Path(folder) / vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...] = (), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, the kept columns, n_tokens: whole texts, whatever their length; null counts 0."""
    fields = [df.schema[c] for c in (id_column, *keep)]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(folder, vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.fieldNames())

    return df.select(id_column, *keep, F.col(text_column).cast("string")).mapInArrow(run, schema)
