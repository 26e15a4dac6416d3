"""Text expressions: normal forms, templates, hashes, and statistics of characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

EMPTY_INPUT = "[EMPTY]"
MISSING_SECTION = "[欠損]"
# Line ends as Python's splitlines knows them.
_LINE_END = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"


@F.pandas_udf(T.StringType())
def _nfkc(values):
    import pandas as pd

    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    import unicodedata

    folded = pd.Series([unicodedata.normalize("NFKC", x) for x in distinct], dtype="object")
    return pd.Series([folded[c] if c >= 0 else None for c in codes], dtype="object")


def nfkc(c: Column | str) -> Column:
    """Compatibility composition, a batch at a time; NULL stays NULL."""
    return _nfkc(F.col(c) if isinstance(c, str) else c)


def collapsed(c: Column) -> Column:
    """Runs of Unicode blanks as one blank, none at the ends; NULL as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def normalized(c: Column | str) -> Column:
    """Compatibility form with collapsed blanks."""
    return collapsed(nfkc(c))


def labelled_text(columns: Sequence[str], prepared: bool = False) -> Column:
    """``name: text`` parts joined by blanks; a marker where all parts are empty.

    With ``prepared`` the columns already are in normal form.
    """
    parts = [F.col(c) if prepared else normalized(c) for c in columns]
    some = [F.when(F.coalesce(p, F.lit("")) != "", F.concat(F.lit(f"{c}: "), p)) for c, p in zip(columns, parts)]
    return F.when(F.coalesce(*some).isNull(), F.lit(EMPTY_INPUT)).otherwise(F.concat_ws(" ", *some))


def sectioned_text(columns: Sequence[str], most: int) -> Column:
    """Sections with a heading line each, cut to ``most`` characters; empty ones are marked."""
    parts = []
    for c in columns:
        body = F.substring(collapsed(F.col(c)), 1, most)
        parts.append(F.concat(F.lit(f"## {c}\n"), F.when(body == "", F.lit(MISSING_SECTION)).otherwise(body)))
    return F.concat_ws("\n\n", *parts)


def text_hash(c: Column | str) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def _of_class(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")


def character_statistics(c: str) -> dict[str, Column]:
    """Twelve statistics of a text column that is in compatibility form already.

    Lines are counted before blanks are collapsed, all else after; ratios are of the
    collapsed length, 0 for the empty text.
    """
    raw = F.coalesce(F.col(c), F.lit(""))
    text = collapsed(F.col(c))
    n = F.length(text).cast("double")
    whole = F.greatest(n, F.lit(1.0))
    lines = F.split(F.regexp_replace(raw, f"(?:{_LINE_END})\\z", ""), _LINE_END, -1)
    sentences = F.filter(F.split(text, "[。！？!?]+"), lambda x: F.trim(x) != "")
    return {
        f"{c}__is_empty": (n == 0).cast("double"),
        f"{c}__char_count": n,
        f"{c}__log1p_char_count": F.log1p(n),
        f"{c}__line_count": F.when(text == "", 0.0).otherwise(F.size(lines).cast("double")),
        f"{c}__sentence_count": F.size(sentences).cast("double"),
        f"{c}__digit_ratio": _of_class(text, "\\p{Nd}") / whole,
        f"{c}__latin_ratio": _of_class(text, "A-Za-z") / whole,
        f"{c}__hiragana_ratio": _of_class(text, "\\x{3040}-\\x{309f}") / whole,
        f"{c}__katakana_ratio": _of_class(text, "\\x{30a0}-\\x{30ff}\\x{ff65}-\\x{ff9f}") / whole,
        f"{c}__kanji_ratio": _of_class(text, "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}") / whole,
        f"{c}__punctuation_ratio": _of_class(text, "\\p{P}") / whole,
        f"{c}__unique_char_ratio": F.when(text == "", 0.0).otherwise(F.size(F.array_distinct(F.split(text, ""))).cast("double")) / whole,
    }


def ngram_text(c: str) -> Column:
    """The text whose n-grams are counted: in lower case, blanks of two or more collapsed, NULL as empty."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"(?U)\s{2,}", " ")


def character_ngrams(c: str, low: int, high: int) -> Column:
    """All character n-grams of a text, shortest first; blanks of two or more collapse."""
    text = ngram_text(c)
    sizes = F.sequence(F.lit(low), F.lit(high))

    def of(n: Column) -> Column:
        last = F.length(text) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(sizes, of))
