import pytest

from kumihimo.llm import sentences as st

CASES = {
    "en": ("Dr. Okube met approx. 395 residents, e.g. farmers. The U.N.-style panel of X Bros. Ltd. was dissolved. Is it done?! Nobody could say… It closes at 3 p.m. e-Forms are accepted. See No. 4 in sec. 5.7.", 7),
    "en2": ('"It cannot go on. We need help now," said Mr. Varga of Teasel. Was it useful? is what they ask. The team ... well, most of it ... left in 2018. Fees, etc. are covered (see app. B. for X).', 4),
    "de": ("Im 9. Quartal lag es bei 1.712.000 Euro. Der Anteil stieg, d. h. um 208 Fälle u. a. in Ostmere. „Das reicht nicht. Wir brauchen mehr“, sagte Fr. Corvin. Dr. X nannte Nr. 7 und Abs. 5 ca. 6.5-mal.", 4),
    "fr": ("« C’est trop tard. Il faut agir », dit Mme Corvin. Qui suivra le plan après 2022 ? M. Okube a cité l’art. 3 et le n° 4 du plan. Le taux passe de 3,7 à 19.8 pour cent env. à X.", 4),
    "ja": ("担当者は「急務だ。始めたい。」と説明した。「止めないでほしい。」費用は1,253千円で、35倍に当たる！まさか中止とは！？見通しは……不明である。別紙（詳細は別紙。全63頁）を送った。版 v9.6.3を公開した。", 7),
    "zh": ("使用率从1.9%升到47.1%。“不能再拖了。我们需要帮助。”西沼的负责人说。有人问“还有多久？”，西沼没有答复……费用下降了。", 4),
    "ko": ("“이대로는 안 됩니다. 도와주세요.”라고 담당자가 말했다. 계획(예: 현장 점검. 단, 휴일 제외)은 2011. 1. 7. 시작되었다. 일정은 바뀌지 않았다! 누가 맡는가?", 4),
    "th": ("ผอ. ของศูนย์ตรวจเอกสาร เช่น ใบอนุญาต ที่เคลดิง มีผู้ยื่นคำขอ 193 รายที่เคลดิง เจ้าหน้าที่มาสายบ่อย ๆ ในช่วงฤดูฝน  แผนยังไม่เปลี่ยนแปลง", 4),
    "hi": ("रु. 862 की राशि मिली। डॉ. ने क्र. 5 रिपोर्ट देखी। कौन चलाएगा? माँग की!", 4),
    "ar": ("قال د. ماروف إن الخطة تحتاج إلى وقت، وإلى مال. لم تتغير الخطة. من سيدير المكتب؟", 3),
    "lines": ("1. Next steps\n- 3 open cases\r\n■ 基礎研究課題\n\n・点検\n今後の予定", 5),
}


def units(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], "doc_id long, text string, at int, piece string, begin string")
    out = {}
    for r in st.sentence_units(df, "doc_id", "text").collect():
        out.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def found(spark):
    return units(spark, list(enumerate(t for t, _ in CASES.values())))


@pytest.mark.parametrize("k", CASES)
def test_units(found, k):
    i = list(CASES).index(k)
    text, n = CASES[k]
    pieces = [text[a:b] for a, b in found[i]]
    assert len(pieces) == n, pieces
    assert "".join("".join(p.split()) for p in pieces) == "".join(text.split())
    assert all(p == p.strip() for p in pieces)


def test_edges(spark):
    long = "文である。" * 20_000
    got = units(spark, [(1, None), (2, ""), (3, " \n　"), (4, "12.5 -- 3!"), (5, "\U00020000い。𝒳 is here. Yes."), (6, long), (7, "「開いたまま。次の文。"), (8, "  　前後の空白。\n")])
    assert set(got) == {5, 6, 7, 8}
    assert got[5] == [(0, 3), (3, 13), (14, 18)] and len(got[6]) == 20_000 and got[8] == [(3, 9)]
    assert got[7][-1][1] == 11


def test_empty_table_and_text_column(spark):
    df = spark.createDataFrame([(1, "一つ。二つ。")], "doc_id long, text string")
    assert st.sentence_units(df.where("false"), "doc_id", "text").count() == 0
    assert [r["sentence"] for r in st.sentence_units(df, "doc_id", "text", True).orderBy("start_char").collect()] == ["一つ。", "二つ。"]


def test_restored_texts_are_what_the_offsets_say(spark):
    rows = list(enumerate([t for t, _ in CASES.values()] + ["私用\ue006文字。「\ue010あり。」次！", "（a.b!c?d…）終。\r\n \u3000二。", "。" * 500 + "文"]))
    got = st.sentence_units(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", True).collect()
    assert len(got) > 50 and all(r["sentence"] == rows[r["doc_id"]][1][r["start_char"] : r["end_char"]] for r in got)


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "一つ。二つ。")], "doc_id long, text string")
    assert "Exchange" not in st.sentence_units(df, "doc_id", "text", True)._jdf.queryExecution().executedPlan().toString()
