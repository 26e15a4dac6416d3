"""How distinctive a term is per record (problem 5): positive pointwise mutual information.

A term's joint count with a record is set against the term's and the record's marginal
counts, the records' (the contexts') smoothed by a fractional exponent. Mentions are found
in the text; joint counts, both marginals and the score come from group-bys, which combine
before they shuffle, and joins. The totals are a single row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kumihimo.sources.shared import written

#: Exponent of the smoothed context counts.
ALPHA = 0.75
#: A run of one script, or a word of letters and digits, is a term of its own.
RE_RUN = re.compile(r"[一-鿿々〆]+|[ァ-ヺー]{2,}|[a-zà-öø-ÿ][a-z0-9à-öø-ÿ]+")


def _texts(batch: pa.RecordBatch, n: int) -> list[str]:
    cells = [batch.column(i + 1).to_pylist() for i in range(n)]
    return ["\n".join(t for t in row if t) for row in zip(*cells)]


def maximal(found: list[tuple[int, int, list[int]]]) -> Iterator[list[int]]:
    """The mentions (begin, end, ids) that don't lie within a longer one; overlapping ones all count."""
    reach = -1
    for begin, end, ids in sorted(found, key=lambda m: (m[0], -m[1])):
        if end > reach:
            reach = end
            yield ids


def mentions(df: DataFrame, id_column: str, columns: Sequence[str], glossary: DataFrame, term_id: str, term: str, most_terms: int = 100_000) -> DataFrame:
    """row_id, term_id: each mention of a glossary term, but for those inside a longer mention.

    Texts and terms are compared in canonical form. Mentions that overlap in part all count,
    as do repeated ones. A row without a mention has no row here. The glossary, a dimension of at
    most ``most_terms`` entries (more are refused), is sent to the executors.
    """
    from kumihimo.llm.glyphs import key

    entries = [(int(r[0]), r[1]) for r in glossary.where(F.col(term).isNotNull()).select(term_id, term).limit(most_terms + 1).collect()]
    if len(entries) > most_terms:
        raise ValueError(f"the glossary has more than {most_terms} terms")
    by_key: dict[str, list[int]] = {}
    for i, t in entries:
        if key(t):
            by_key.setdefault(key(t), []).append(i)
    n_columns = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        from kumihimo.llm.glyphs import key

        automaton = ahocorasick.Automaton()
        for k, ids in by_key.items():
            automaton.add_word(k, (len(k), ids))
        if by_key:
            automaton.make_automaton()
        for batch in batches:
            rows, terms = [], []
            ids = batch.column(0).to_pylist()
            for row, text in zip(ids, _texts(batch, n_columns)):
                if not text or not by_key:
                    continue
                # columns are joined by line feeds, which a key turns into blanks: use U+0000
                found = automaton.iter("\x00".join(key(part) for part in text.split("\n")))
                own = [i for ids in maximal([(end - n, end, ids) for end, (n, ids) in found]) for i in ids]
                rows += [row] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.int64())], names=["row_id", "term_id"])

    picked = df.select(F.col(id_column).cast("long"), *[F.col(c).cast("string") for c in columns])
    return picked.mapInArrow(run, "row_id long, term_id long")


def joint_counts(found: DataFrame, term: str) -> DataFrame:
    """row_id, term, n, n_row from one row for each mention."""
    joint = written(found.groupBy("row_id", term).agg(F.count("*").alias("n")))
    return joint.join(joint.groupBy("row_id").agg(F.sum("n").alias("n_row")), "row_id")


def run_counts(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """row_id, term, n, n_row: the script runs and words of each record, in comparison form.

    A record's text is one row, so its joint counts are complete where they are read.
    """
    n_columns = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kumihimo.llm.glyphs import key

        for batch in batches:
            rows, terms, counts, totals = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch, n_columns)):
                seen = Counter(RE_RUN.findall(key(text))) if text else {}
                rows += [row] * len(seen)
                terms += seen.keys()
                counts += seen.values()
                totals += [sum(seen.values())] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(totals, pa.int64())], names=["row_id", "term", "n", "n_row"])

    picked = df.select(F.col(id_column).cast("long"), *[F.col(c).cast("string") for c in columns])
    return picked.mapInArrow(run, "row_id long, term string, n long, n_row long")


def ppmi(counts: DataFrame, n_records: int, term: str, alpha: float = ALPHA) -> DataFrame:
    """row_id, term, n, df, df_share, ppmi for every term of every record.

    ``counts`` has one row per record and term, with the record's total in ``n_row``;
    ``n_records`` is the number of all records. ppmi = max(0, ln(p(term, record)
    / (p(term) * p'(record)))), where p' is from record totals to the power ``alpha``. A
    collection of one record and one term scores 0. Empty counts give an empty table.
    """
    # a record's share of the smoothed total is spread over its terms, so that one aggregate has all marginals
    weight = F.col("n") * F.pow(F.col("n_row").cast("double"), F.lit(alpha - 1.0))
    terms = counts.groupBy(term).agg(F.sum("n").alias("n_term"), F.count("*").alias("df"), F.sum(weight).alias("smooth_term"))
    n_all, smooth_all = terms.agg(F.sum("n_term"), F.sum("smooth_term")).first()
    scored = counts.join(terms.drop("smooth_term"), term)
    joint = F.col("n") / F.lit(n_all)
    expected = (F.col("n_term") / F.lit(n_all)) * (F.pow(F.col("n_row").cast("double"), F.lit(alpha)) / F.lit(smooth_all))
    return scored.select("row_id", term, "n", "df", (F.col("df") / F.lit(float(n_records))).alias("df_share"), F.greatest(F.lit(0.0), F.log(joint / expected)).alias("ppmi"))


def characteristic_terms(df: DataFrame, glossary: DataFrame, id_column: str, columns: Sequence[str], least: int = 2, common: float = 0.05) -> DataFrame:
    """Glossary terms that characterise a record: positive score, ``least`` mentions, rare."""
    counts = written(joint_counts(mentions(df, id_column, columns, glossary, "term_id", "term"), "term_id"))
    scored = ppmi(counts, df.count(), "term_id")
    return scored.where((F.col("n") >= least) & (F.col("df_share") < common) & (F.col("ppmi") > 0))


def record_terms(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """Every term (script run or word) of every record with its score."""
    counts = written(run_counts(df, id_column, columns))
    return ppmi(counts, df.count(), "term")
