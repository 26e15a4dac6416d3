"""Visually identical text with different characters (problem 6).

Compatibility normalisation to the composed form, full case folding, mapped blanks and
removal of default-ignorable characters, run once per distinct value of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T


def _per_distinct(column: pa.Array, fn) -> pa.Array:
    """``fn`` applied to each distinct value of a string column once; null stays null."""
    encoded = column.dictionary_encode()
    values = pa.array([fn(v) for v in encoded.dictionary.to_pylist()], pa.string())
    return pc.take(values, encoded.indices)


def canonical_cells(df: DataFrame, id_column: str, columns: Sequence[str], only_changed: bool = False, with_key: bool = True) -> DataFrame:
    """One row per non-null cell: id, column_name, canonical and, if asked, comparison_key.

    ``canonical`` keeps the usual full-width marks; ``comparison_key`` also folds case and
    collapses blanks. Nulls have no row, the empty text has itself. Ids may repeat (each row
    gives its own cells), columns of the input that are named like the output's don't clash,
    and an empty table gives an empty one.
    """
    fields = [T.StructField(id_column, df.schema[id_column].dataType), T.StructField("column_name", T.StringType()), T.StructField("canonical", T.StringType())]
    fields += [T.StructField("comparison_key", T.StringType())] * with_key
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kumihimo.llm.glyphs import RE_SUSPECT, clean, key

        for batch in batches:
            ids = batch.column(0)
            for i, name in enumerate(names, 1):
                cells = batch.column(i)
                if only_changed:
                    # most cells are plain: one scan finds the few that can change
                    texts = cells.to_pylist()
                    hit = pa.array([j for j, t in enumerate(texts) if t and RE_SUSPECT.search(t)], pa.int64())
                    part, part_ids = pc.take(cells, hit), pc.take(ids, hit)
                else:
                    keep = pc.is_valid(cells)
                    part, part_ids = pc.filter(cells, keep), pc.filter(ids, keep)
                canonical = _per_distinct(part, clean)
                if only_changed:
                    changed = pc.not_equal(canonical, part)
                    part, part_ids, canonical = (pc.filter(x, changed) for x in (part, part_ids, canonical))
                out = [part_ids, pa.array([name] * len(part), pa.string()), canonical]
                if with_key:
                    out.append(_per_distinct(part, key))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    picked = df.select(F.col(id_column), *[F.col(c).cast("string") for c in names])
    return picked.mapInArrow(run, T.StructType(fields))


def found(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells whose canonical form differs from what they hold: row_id, column_name."""
    return canonical_cells(train, "row_id", columns, only_changed=True, with_key=False).select("row_id", "column_name")
