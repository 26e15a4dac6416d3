"""Sentence units across languages and scripts (problem 9), in SQL expressions.

Stop marks that end no sentence (in decimals, addresses, initials, abbreviations, ordinals,
quotations and brackets) are masked by private-use placeholders, one for each mark. A break
mark is then put behind every terminator that its script lets end a sentence, and behind line
breaks; between break marks lie the units. As a placeholder takes one place and stands for one
mark, offsets are counted on the masked text, and the text is restored from it.

Everything happens within the row: nothing is shuffled, and the work grows with the length of
a text. Rules for marks or scripts that a text doesn't hold are passed over for that text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

STOPS = "。｡！？!?.…।؟"
#: Placeholders, in the order of STOPS: stop marks that end nothing, and those right before a
#: closing mark; then the full stop of an abbreviation that also ends its sentence, the break
#: mark, and the cut between segments.
MASKED = "".join(chr(0xE000 + i) for i in range(len(STOPS)))
CLOSED = "".join(chr(0xE010 + i) for i in range(len(STOPS)))
FORCED, BREAK, CUT = "\ue020", "\ue021", "\ue022"
DOT = MASKED[STOPS.index(".")]
_RESERVED = "[\ue000-\ue02f]"
#: The first two bytes of all of them, and of few other characters.
_PRIVATE = "\ue000".encode()[:2]

CLOSERS = "」』）)\\]”\"’»›】〕"
# Pairs of quotation marks and brackets within which nothing divides.
PAIRS = [("「", "」"), ("『", "』"), ("（", "）"), ("“", "”"), ("«", "»"), ("【", "】"), ("〔", "〕")]
# Abbreviations that a capital or a figure may follow within a sentence.
ABBREVIATIONS = (
    "No Nos Nr Nrn Abs Art art Art Fig Figs fig sec Sec ch Ch vol Vol pp p Pp cf Cf vs approx ca Ca circa env app App ed eds Ed "
    "Dr Mr Mrs Ms Prof Pr Fr Hr Hrn Mme Mlle MM St Ste Sr Jr Rev Hon Gen Col Lt Capt Sgt Gov Sen Rep Pres Bros Inc Corp Co al Ltd dept Dept est "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr juil déc bzw usw Str str Tel tel evtl ggf inkl exkl vgl Vgl Bd Hrsg Jh Mio Mrd"
).split()
# What continues a Japanese sentence after a closing quotation mark.
AFTER_QUOTE = "と|は|が|を|に|の|も|で|や|へ|か|な[どのら]|だ|、|，|,|。|」|』|）|\\)|$|\\s*[\\r\\n]"
# Thai words before or after which a blank doesn't end a clause.
THAI_KEEP_AFTER = ["ๆ", "เช่น", "คือ", "และ", "หรือ", "ว่า", "\\."]
THAI_KEEP_BEFORE = ["ๆ", "เช่น", "ที่", "และ", "หรือ", "ซึ่ง", "โดย", "ของ", "จาก", "เป็น"]

# White space, Unicode separators and marks of no width.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(chr(c) for c in range(0x2000, 0x200B))

_BLANK = "[ \\t\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}]"
_CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
#: Pieces of a text whose lengths are added up at once.
_STEP = 32


def _replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def _holds(c: Column, *parts: str | bytes) -> Column:
    """Whether any of the parts, texts or the first bytes of characters in UTF-8, is in ``c``."""
    found = [F.contains(c.cast("binary"), F.lit(x)) if isinstance(x, bytes) else F.contains(c, F.lit(x)) for x in parts]
    return reduce(lambda a, b: a | b, found)


def _where(c: Column, test: Column, rules: list[tuple[str, str]]) -> Column:
    """``c`` after the rules, in turn, where ``test`` says that they can matter."""
    return F.when(test, reduce(lambda x, r: _replace(x, *r), rules, c)).otherwise(c)


def masked(text: Column) -> list:
    """Steps from ``text`` to it with stop marks masked that end no sentence, every position kept.

    Each pattern begins with the mark it is about, so that it is tried at such marks only.
    """
    in_word = "(?<=[\\p{{L}}\\p{{N}}]{0})(?=[a-z0-9/_-])"
    dots = [
        # addresses and file names, decimals, versions, times, dates
        ("[.]" + in_word.format("[.]"), DOT),
        ("[.](?<=\\p{N}[.])(?=\\p{N})", DOT),
        # a time of day may end its sentence; otherwise it is an abbreviation
        (f"[.](?<=\\b[ap][.{DOT}]m[.])(?=[\\s\\p{{Z}}]+(?:\\p{{Lu}}|\\p{{Ll}}-\\p{{Lu}}|[\"“«„])|\\s*[\\r\\n]|\\s*$)", FORCED),
        # initials and other single letters, the abbreviations, and marks of Indic and Thai ones
        ("[.](?<=(?<![\\p{L}\\p{M}\\p{N}])\\p{L}\\p{M}{0,4}[.])(?=[\\s\\p{Z}]|\\p{L}|[-,;:)])", DOT),
        (f"[.](?<=[{DOT}]\\p{{L}}[.])(?=[-,;:)]|\\s*\\p{{Ll}})", DOT),
        (f"[.](?<=(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(dict.fromkeys(ABBREVIATIONS))})[.])(?=\\s*[^\\s])(?!\\s*[\\r\\n])", DOT),
        ("[.](?<=[\\p{IsDevanagari}\\p{IsThai}][.])", DOT),
        # ordinals, list numbers and dates written with blanks
        (f"[.](?<=(?<!\\p{{N}})(?<!\\p{{N}}[.,{DOT}])\\p{{N}}{{1,2}}[.])(?={_BLANK}+[^\\s\\p{{N}}])", DOT),
        (f"[.](?<=\\p{{N}}[.])(?={_BLANK}+\\p{{N}})", DOT),
    ]
    steps = [lambda c: _where(c, _holds(c, _PRIVATE), [(_RESERVED, "\ufffd")])]
    steps.append(lambda c: _where(c, _holds(c, "."), dots))
    for mark in "!?":
        rule = (f"[{mark}]" + in_word.format(f"[{mark}]"), MASKED[STOPS.index(mark)])
        steps.append(lambda c, mark=mark, rule=rule: _where(c, _holds(c, mark), [rule]))
    return steps


def quoted(segments: Column) -> Column:
    """The segments put together, stop marks within quotation marks and brackets masked.

    ``segments`` is a text cut before and after every such mark. A segment on one line is
    within a pair if the next mark is a closing one, or, for marks that also open or stand
    alone, if the marks on both sides belong together.
    """

    def inside(s: Column, i: Column) -> Column:
        before, after = F.get(segments, i - 1), F.get(segments, i + 1)
        straight = (before == '"') & (after == '"') & F.coalesce(F.get(segments, i - 2).rlike("[\\s\\p{Z}(]\\z"), F.lit(True))
        pair = after.isin([c for _, c in PAIRS]) | ((before == "(") & (after == ")")) | ((before == "[") & (after == "]"))
        return (pair | ((before == "„") & after.isin("“", "”")) | straight) & ~s.rlike("[\\r\\n]")

    def mask(s: Column, i: Column) -> Column:
        body = F.translate(F.substring(s, F.lit(1), F.char_length(s) - 1), STOPS + FORCED, MASKED + DOT)
        last = F.translate(F.right(s, F.lit(1)), STOPS + FORCED, CLOSED + CLOSED[STOPS.index(".")])
        return F.when(s.rlike(f"[{STOPS}{FORCED}]") & F.coalesce(inside(s, i), F.lit(False)), F.concat(body, last)).otherwise(s)

    return F.array_join(F.transform(segments, mask), "")


def broken() -> list:
    """Steps that put a break mark behind every sentence of a masked text."""
    after_latin = "(?:[^\\p{Ll}\\s]|\\p{Ll}-\\p{Lu}|\\p{Ll}\\p{Lu})"
    end = f"$1{BREAK}"
    rules = [
        # marks that end a sentence wherever they stand
        ((), f"([。｡！？।؟][。｡！？।؟!?…]*[{CLOSERS}]*)(?![{CLOSERS}])"),
        # marks that need a blank and no small letter behind them
        ((".", "!", "?", "…", FORCED), f"([.!?…{FORCED}]+[{CLOSERS}]*)(?=[\\s\\p{{Z}}]+{after_latin})"),
        # the same before a script without blanks; dots there may be a pause
        (("!", "?"), f"([!?]+[{CLOSERS}]*)(?=[{_CJK}])"),
        (("…",), "(…+)(?=[\\p{IsHan}\\p{N}“])(?![^。！？…\\r\\n]{0,80}[ぁ-ゖ])"),
        # a quotation that is a sentence of its own
        ((_PRIVATE,), f"([{CLOSED}][」』]+)(?!{AFTER_QUOTE})"),
        ((_PRIVATE,), f"([{CLOSED}][”\"’»“]+)(?=[\\s\\p{{Z}}]+\\p{{Lu}})"),
        ((), "([\\r\\n\\x{0b}\\x{0c}\\x{85}\\x{2028}\\x{2029}]+)"),
        # blanks between Thai clauses
        ((b"\xe0\xb8", b"\xe0\xb9"), f"({_BLANK}+)(?<=\\p{{IsThai}}{_BLANK}{{1,99}})(?<!(?:{'|'.join(THAI_KEEP_AFTER)}){_BLANK}{{1,99}})(?=\\p{{IsThai}})(?!{'|'.join(THAI_KEEP_BEFORE)})"),
    ]
    return [lambda c, test=test, rule=rule: _where(c, _holds(c, *test), [(rule, end)]) if test else _replace(c, rule, end) for test, rule in rules]


def sentence_units(df: DataFrame, id_column: str, text_column: str, with_text: bool = False) -> DataFrame:
    """One row per sentence unit: id, start_char, end_char (code points), and its text.

    Null, empty and blank texts, and texts without a letter, have no unit. Equal ids and texts
    give their own units. A piece without a letter in a text with letters is a unit too, so
    that the units of a text cover all that isn't blank. An empty table gives an empty one.
    """
    text = F.col(text_column).cast("string")
    marks = "".join(o + c for o, c in PAIRS) + "()\\[\\]„\""
    # a text that holds placeholders itself, which the sentences are cut from instead
    odd = [F.when(text.rlike(_RESERVED), text).alias("odd")] * with_text
    out = df.where(text.rlike("\\p{L}")).select(F.col(id_column).alias("doc"), *odd, text.alias("m"))
    kept = ["doc", *["odd"] * with_text]

    # one step per select: a column used more than once is then computed once
    def then(frame: DataFrame, step) -> DataFrame:
        return frame.select(*kept, step(F.col("m")).alias("m"))

    out = reduce(then, masked(text), out)
    cut = F.trim(F.replace(_replace(F.col("m"), f"([{marks}])", f"{CUT}$1{CUT}"), F.lit(CUT * 2), F.lit(CUT)), F.lit(CUT))
    has_marks = F.col("m").rlike(f"[{marks}]")
    out = out.select(*kept, "m", F.when(has_marks, F.split(cut, CUT, -1)).alias("segments"))
    out = out.select(*kept, F.when(F.col("segments").isNotNull(), quoted(F.col("segments"))).otherwise(F.col("m")).alias("m"))
    out = reduce(then, broken(), out)
    out = out.select(*kept, F.split(F.col("m"), BREAK, -1).alias("pieces"))
    out = out.select(*kept, "pieces", F.transform("pieces", F.char_length).alias("sizes"))
    # where each piece begins: sums of whole steps, and within a step of the few pieces before
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda x, y: x + y)
    steps = F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / _STEP).cast("int"))
    sums = F.aggregate(steps, F.array(F.lit(0)), lambda sofar, k: F.concat(sofar, F.array(F.element_at(sofar, -1) + total(F.slice("sizes", k * _STEP + 1, F.lit(_STEP))))))
    out = out.select(*kept, "pieces", "sizes", sums.alias("sums"))

    def placed(piece: Column, i: Column) -> Column:
        begin = F.get(F.col("sums"), F.floor(i / _STEP).cast("int")) + total(F.slice("sizes", i - i % _STEP + 1, i % _STEP))
        right = F.rtrim(piece, F.lit(BLANKS))
        fields = [begin.alias("begin"), (F.char_length(piece) - F.char_length(F.ltrim(piece, F.lit(BLANKS)))).alias("skip"), F.char_length(right).alias("n")]
        return F.struct(*fields, *[F.translate(F.ltrim(right, F.lit(BLANKS)), MASKED + CLOSED + FORCED, STOPS + STOPS + ".").alias("sentence")] * with_text)

    units = out.select(*kept, F.explode(F.filter(F.transform("pieces", placed), lambda u: u["n"] > 0)).alias("u"))
    start, end = (F.col("u.begin") + F.col("u.skip")).cast("long"), (F.col("u.begin") + F.col("u.n")).cast("long")
    result = units.select(F.col("doc").alias(id_column), start.alias("start_char"), end.alias("end_char"), *[F.col("u.sentence").alias("sentence"), F.col("odd")] * with_text)
    if with_text:
        own = F.expr("substring(odd, cast(start_char + 1 AS int), cast(end_char - start_char AS int))")
        result = result.withColumn("sentence", F.coalesce(own, "sentence")).drop("odd")
    return result
