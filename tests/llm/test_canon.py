import pytest

from kumihimo.llm import canon

SCHEMA = "row_id long, a string, b string, column_name string, canonical string"


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, "clash", "clash") for i, a, b in rows], SCHEMA)


def test_found_cells(spark):
    rows = [(1, "データ", "АPI"), (2, None, ""), (3, "サーバ一", "（仮称）"), (4, "plain text\n", "か\u3099"), (4, "a​", "ﾃﾞｰﾀ"), (5, "x" * 200_000 + "１", None)]
    got = sorted(map(tuple, canon.found(frame(spark, rows), ["a", "b"]).collect()))
    assert got == [(1, "b"), (3, "a"), (4, "a"), (4, "b"), (4, "b"), (5, "a")]


def test_canonical_form_and_key(spark):
    got = {(r["row_id"], r["column_name"]): r for r in canon.canonical_cells(frame(spark, [(1, "Ｓtraße  ＡＢ", None), (2, "", "（Ａ）")]), "row_id", ["a", "b"]).collect()}
    assert got[1, "a"]["canonical"] == "Straße  AB" and got[1, "a"]["comparison_key"] == "strasse ab"
    assert got[2, "a"]["canonical"] == "" and got[2, "b"]["canonical"] == "（A）" and (1, "b") not in got


def test_empty_table(spark):
    df = frame(spark, [(1, "a", "b")]).where("false")
    assert canon.found(df, ["a", "b"]).count() == canon.canonical_cells(df, "row_id", ["a"]).count() == 0


def test_same_form_for_look_alikes(spark):
    rows = [(i, t, None) for i, t in enumerate(["データ連携", "ﾃﾞｰﾀ連携", "デ​ータ連携", "デ–タ連携", "データ連携", "デ一タ連携"])]
    assert {r["comparison_key"] for r in canon.canonical_cells(frame(spark, rows), "row_id", ["a"]).collect()} == {"データ連携"}


def test_words_of_other_scripts_stay():
    from kumihimo.llm.glyphs import clean

    assert clean("Министерство образования и Αθήνα, α波") == "Министерство образования и Αθήνα, α波"
    assert clean("GΙSとСАD、ΑI") == "GISとCAD、AI"


def test_folding_keeps_rare_characters_apart():
    import numpy as np

    from kumihimo.llm.batches import folded

    codes, starts = folded(["\U00020000\U00028000", "\ua015\U00010400", "ＡBc1"])
    assert np.diff(starts).tolist() == [2, 2, 4] and len(set(codes[:4].tolist())) == 4
    assert "".join(map(chr, codes[4:])) == "abc1"


@pytest.mark.parametrize("raw, clean", [
    ("АРI", "API"), ("ﾃﾞｰﾀ", "データ"), ("サーバ一の更新", "サーバーの更新"), ("一件当たり", "一件当たり"), ("窓ロを", "窓口を"), ("モデル二号", "モデル二号"), ("町エ場の", "町工場の"), ("コス卜削減", "コスト削減"),
    ("が", "が"), ("Éolano", "Éolano"), ("Éolano", "Éolano"), ("a​b", "ab"), ("a b", "a b"), ("（仮称）：？！", "（仮称）：？！"), ("１２３", "123"), ("デ–タ", "データ"), ("⼤きい", "大きい"), ("", ""), ("省エネ家電", "省エネ家電"),
])
def test_look_alikes(raw, clean):
    from kumihimo.llm.glyphs import clean as canon_clean

    assert canon_clean(raw) == clean
    assert canon_clean(clean) == clean
