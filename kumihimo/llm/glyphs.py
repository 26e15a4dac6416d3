"""Tables of characters that look alike, and text brought to one consistent form.

``clean`` keeps what Japanese text usually holds (ASCII, composed kana, kanji, accented
letters and the full-width marks in ``KEPT_MARKS``) and replaces everything that merely
reads like it: compatibility forms, decomposed marks, other blanks, default-ignorable
characters, letters of other scripts and kana or kanji used for one another.
``key`` folds case on top of it, for comparisons.
"""

from __future__ import annotations

import re
import sys
import unicodedata

# Full-width marks that are the usual ones in Japanese text.
KEPT_MARKS = "（）：？！"

# Unicode Default_Ignorable_Code_Point ranges.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

# Letters of other scripts drawn like a Latin letter.
LATIN_LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a",
    "ρ": "p", "υ": "u", "κ": "k", "χ": "x",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "с": "c",
    "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "Ꮯ": "C", "Ꭺ": "A", "Ꭼ": "E",
}

# CJK radicals without a compatibility mapping, by the kanji they look like.
RADICALS = {"⺠": "民", "⻁": "虎", "⻄": "西", "⻆": "角", "⻑": "長", "⻘": "青", "⻝": "食", "⻤": "鬼", "⻨": "麦", "⻩": "黄", "⻲": "亀"}

# Strokes written for the long-vowel mark, and kana / kanji pairs of one shape.
DASHES = "‐‑‒–—―−─━－"
KANJI_TO_KANA = {"力": "カ", "工": "エ", "口": "ロ", "二": "ニ", "夕": "タ", "卜": "ト", "八": "ハ", "一": "ー"}
KANA_TO_KANJI = {"カ": "力", "エ": "工", "ロ": "口", "ニ": "二", "ハ": "八"}
HIRA_TO_KATA = {"べ": "ベ", "ぺ": "ペ"}
# Kanji before which 一 or 二 after katakana is the numeral.
COUNTED = "件元体時般定部度種号次回人年月日方番期者社億万千百十覧致括貫斉層助端律環歩連切緒旦両族様"

_KK = "ァ-ヺー"
_HAN = "一-鿿々"
_ignorable_class = "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in IGNORABLE)
RE_IGNORABLE = re.compile(f"[{_ignorable_class}]")
RE_BLANKS = re.compile("[   -   　]")
RE_LINE_BREAKS = re.compile("[\u0085  ]")
RE_DASH = re.compile(f"(?<=[ァ-ヺーｦ-ﾟ゙゚])[{DASHES}]+")
RE_OTHER_DASH = re.compile(f"[{DASHES}]")
#: Letters of Greek, Cyrillic or Cherokee, and the words of these and Latin letters; whether all
#: of them look like Latin ones decides what a word is.
RE_OTHER = re.compile("[Ͱ-ϿЀ-ԯᎠ-ᏽ]")
RE_WORD = re.compile("[A-Za-z0-9À-ſ\u0300-\u036fͰ-ϿЀ-ԯᎠ-ᏽ]+")
RE_RADICAL = re.compile("[" + "".join(RADICALS) + "]")
RE_PROTECT = re.compile(f"[{KEPT_MARKS}]")

#: Where a kana or kanji stands for the other one, judged by its neighbours.
RE_SHAPES = re.compile(
    f"(?<=[{_KK}])一(?![{COUNTED}])"
    f"|(?<=[{_KK}])[口夕八卜工二](?![{_HAN}])"
    f"|(?<=[{_KK}])力(?=[{_KK}])"
    f"|(?<![{_KK}{_HAN}])[力口夕八卜](?=[{_KK}])"
    "|[二](?=[ァィゥェォャュョッー])"
    "|卜"
    f"|(?<=[{_KK}])[べぺ](?=[{_KK}])"
)
RE_KANA_ALONE = re.compile(
    f"(?<![{_KK}])[エカロニハ](?![{_KK}])(?=[{_HAN}])|(?<=[{_HAN}])[エカロニハ](?![{_KK}])|(?<=[{_KK}])ニ(?=号)"
)
RE_BAR_ALONE = re.compile(f"(?<![{_KK}])ー(?=[元体件時般])|(?<=統)ー")

#: Anything beside plain, usual characters, or a kana / kanji in a place of the other.
RE_SUSPECT = re.compile(
    "[^\\x00-\\x7eÀ-ÖØ-öø-ſぁ-ゖァ-ヺー一-鿿々〆、。「」・" + KEPT_MARKS + "]"
    "|" + RE_SHAPES.pattern + "|" + RE_KANA_ALONE.pattern + "|" + RE_BAR_ALONE.pattern
)


def _protected_nfkc(text: str) -> str:
    """Compatibility composition of everything but the usual full-width marks."""
    if not RE_PROTECT.search(text):
        return unicodedata.normalize("NFKC", text)
    parts, at = [], 0
    for m in RE_PROTECT.finditer(text):
        parts += [unicodedata.normalize("NFKC", text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*parts, unicodedata.normalize("NFKC", text[at:])])


def _latin_word(m: re.Match) -> str:
    """A word of look-alikes in Latin letters; words of another script, and single small Greek letters, as they are."""
    word = m.group()
    if not RE_OTHER.search(word) or any(c > "\u036f" and c not in LATIN_LOOKALIKES for c in word) or (len(word) == 1 and word.islower() and word < "\u0400"):
        return word
    return "".join(LATIN_LOOKALIKES.get(c, c) for c in word)


def clean(text: str) -> str:
    """The consistent form of ``text``; itself where nothing deviates."""
    if not RE_SUSPECT.search(text):
        return text
    text = RE_IGNORABLE.sub("", text)
    text = RE_LINE_BREAKS.sub("\n", RE_BLANKS.sub(" ", text))
    text = RE_OTHER_DASH.sub("-", RE_DASH.sub("ー", text))
    text = RE_RADICAL.sub(lambda m: RADICALS[m.group()], text)
    text = _protected_nfkc(text)
    if RE_OTHER.search(text):
        text = RE_WORD.sub(_latin_word, text)
    text = RE_SHAPES.sub(lambda m: KANJI_TO_KANA.get(m.group()) or HIRA_TO_KATA[m.group()], text)
    text = RE_KANA_ALONE.sub(lambda m: KANA_TO_KANJI[m.group()], text)
    text = RE_BAR_ALONE.sub("一", text)
    return unicodedata.normalize("NFC", text)


def key(text: str) -> str:
    """Case-folded, blank-collapsed form for comparisons."""
    folded = unicodedata.normalize("NFKC", clean(text)).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def fold_table():
    """uint32 array by code point: one class per look-alike group, 0 for what is dropped.

    Marks, punctuation and blanks are dropped, case and voicing marks are folded, and kana,
    kanji, dashes and letters of one shape share a class. One-to-one, so a whole batch of
    texts is folded by one array lookup.
    """
    import numpy as np

    size = 0x110000
    table = np.zeros(size, dtype=np.uint32)
    same = {**LATIN_LOOKALIKES, **RADICALS, **{d: "ー" for d in DASHES}, "一": "ー"}
    same |= {k: v for k, v in KANJI_TO_KANA.items() if k != "一"} | HIRA_TO_KATA | {"へ": "ヘ"}
    ranges = [(0x20, 0x3000), (0x3001, 0xD7A4), (0xF900, 0xFB00), (0xFE30, 0x10000), (0x1D400, 0x1D800)]
    for lo, hi in ranges:
        for cp in range(lo, hi):
            ch = same.get(chr(cp), chr(cp))
            base = unicodedata.normalize("NFKD", ch).strip()
            if not base:
                continue
            base = same.get(base[0], base[0])
            base = unicodedata.normalize("NFKD", base)[0]
            base = same.get(base, base).casefold()[:1]
            if base and (base.isalnum() or base == "ー"):
                table[cp] = ord(base)
    for lo, hi in IGNORABLE:
        table[lo : hi + 1] = 0
    # letters of the other planes stand for themselves; their compatibility kanji keep apart
    for lo, hi in ((0x10000, 0x1D000), (0x1D800, 0x1F000), (0x20000, 0x32400)):
        table[lo:hi] = np.arange(lo, hi)
    assert sys.maxunicode < size
    return table
