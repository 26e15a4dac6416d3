import math

import pytest

from kumihimo.llm import distinctive as ds

SCHEMA = "row_id long, a string, b string, term string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, "clash", 9) for i, a, b in rows], SCHEMA)


@pytest.fixture
def glossary(spark):
    return spark.createDataFrame([(1, "標準化"), (2, "逆送り標準化"), (3, "Olmisa Loop"), (4, None), (5, "")], "term_id int, term string")


def counted(df, glossary):
    return ds.joint_counts(ds.mentions(df, "row_id", ["a", "b"], glossary, "term_id", "term"), "term_id")


def test_terms_that_overlap_in_part_all_count(spark):
    glossary = spark.createDataFrame([(1, "情報通信"), (2, "通信技術"), (3, "情報通信技術者"), (4, "技術者")], "term_id int, term string")
    rows = [(1, "情報通信技術", "情報通信技術"), (2, "情報通信技術者", "技術者"), (3, "通信技術者", None)]
    got = {(r["row_id"], r["term_id"]): (r["n"], r["n_row"]) for r in counted(frame(spark, rows), glossary).collect()}
    assert got == {(1, 1): (2, 4), (1, 2): (2, 4), (2, 3): (1, 2), (2, 4): (1, 2), (3, 2): (1, 2), (3, 4): (1, 2)}


def test_longer_terms_take_their_mentions(spark, glossary):
    rows = [(1, "逆送り標準化と標準化", "標準化。逆送り標準化"), (2, "Ｏlmisa Loop", "olmisa​ loop"), (3, None, None), (4, "", "なし")]
    got = {(r["row_id"], r["term_id"]): r["n"] for r in counted(frame(spark, rows), glossary).collect()}
    assert got == {(1, 1): 2, (1, 2): 2, (2, 3): 2}


def test_scores_by_hand(spark):
    counts = spark.createDataFrame([(1, "x", 2, 3), (1, "y", 1, 3), (2, "y", 1, 1)], "row_id long, term string, n long, n_row long")
    got = {(r["row_id"], r["term"]): r for r in ds.ppmi(counts, 2, "term").collect()}
    smooth = 3**0.75 + 1
    assert got[1, "x"]["ppmi"] == pytest.approx(math.log((2 / 4) / ((2 / 4) * (3**0.75 / smooth))))
    assert got[1, "y"]["ppmi"] == pytest.approx(max(0, math.log((1 / 4) / ((2 / 4) * (3**0.75 / smooth)))))
    assert got[2, "y"]["df_share"] == 1.0


def test_against_brute_force(spark):
    rows = [(i, "橋梁 点検 " * (i % 3) + f"道路{i % 5} ", "調査") for i in range(40)]
    got = {(r["row_id"], r["term"]): r["ppmi"] for r in ds.record_terms(frame(spark, rows), "row_id", ["a", "b"]).collect()}
    joint = {}
    for i, a, b in rows:
        for t in ds.RE_RUN.findall(a + "\n" + b):
            joint[i, t] = joint.get((i, t), 0) + 1
    whole = sum(joint.values())
    per_row = {i: sum(n for (j, _), n in joint.items() if j == i) for i in range(40)}
    smooth = sum(n**0.75 for n in per_row.values())
    for (i, t), n in joint.items():
        p_t = sum(m for (_, u), m in joint.items() if u == t) / whole
        assert got[i, t] == pytest.approx(max(0, math.log(n / whole / (p_t * per_row[i] ** 0.75 / smooth))))


def test_characteristic_terms(spark, glossary):
    rows = [(i, "標準化 標準化", "") for i in range(50)] + [(100, "Olmisa Loop", "Olmisa Loop"), (101, "Olmisa Loop", None), (102, None, "x" * 100_000)]
    got = ds.characteristic_terms(frame(spark, rows), glossary, "row_id", ["a", "b"]).collect()
    assert [(r["row_id"], r["term_id"]) for r in got] == [(100, 3)]


def test_empty_tables(spark, glossary):
    empty = frame(spark, [(1, "a", "b")]).where("false")
    assert ds.characteristic_terms(empty, glossary, "row_id", ["a", "b"]).count() == 0
    assert ds.characteristic_terms(frame(spark, [(1, "標準化", "標準化")]), glossary.where("false"), "row_id", ["a", "b"]).count() == 0
    assert ds.record_terms(empty, "row_id", ["a"]).count() == 0
