import pytest
from pyspark.sql import functions as F

from kumihimo.operators import folds as f

ROWS = [(101, 2018, "A", 0), (103, 2019, "A", 1), (110, 2020, "A", 1), (115, 2020, None, 0), (120, 2022, "A", 1), (130, 2022, "B", 0), (140, 2022, "C", 1), (185, -1, "A", 0)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "row_id long, year int, name string, target int")


def test_labels_match_exactly(spark):
    df = spark.createDataFrame([("該当",), ("非該当",), (" 該当 ",), ("1",), ("0",), ("True",), ("1.0",), (None,)], "x string")
    assert [r[0] for r in df.select(f.encode_target("x")).collect()] == [1, 0, 1, 1, 0, 1, None, None]
    with pytest.raises(ValueError, match="1.0"):
        f.check_labels(df, "x")


def test_folds_expand_and_skip_gaps(rows):
    d = {r["validation_year"]: r for r in f.fold_diagnostics(rows, "row_id", "name", "year", "target").collect()}
    assert sorted(d) == [2019, 2020, 2022]
    assert [d[y]["train_size"] for y in sorted(d)] == [1, 2, 4]
    assert [d[y]["validation_size"] for y in sorted(d)] == [1, 2, 3]
    assert [d[y]["seen_count"] for y in sorted(d)] == [1, 1, 1]
    assert [d[y]["unseen_count"] for y in sorted(d)] == [0, 1, 2]
    assert [d[y]["is_latest_fold"] for y in sorted(d)] == [False, False, True]
    assert [d[y]["fold"] for y in sorted(d)] == [0, 1, 2]


def test_null_names_are_unseen(rows):
    flags = {r["row_id"]: r["seen"] for r in f.seen_flags(rows, "row_id", "name", "year").where("validation_year = 2020").collect()}
    assert flags == {110: True, 115: False}


def test_folds_do_not_leak(rows):
    folds = f.time_folds(rows, "row_id", "year").join(rows, "row_id")
    assert folds.where("role = 'train' AND year >= validation_year").count() == 0
    f.check_folds(f.time_folds(rows, "row_id", "year"))


def test_one_year_makes_no_fold(spark):
    one = spark.createDataFrame([(1, 2020, "A", 1)], "row_id long, year int, name string, target int")
    with pytest.warns(UserWarning):
        assert f.validation_years(one, "year").count() == 0
    with pytest.raises(ValueError):
        f.validation_years(one.where("false"), "year")
    with pytest.raises(ValueError):
        f.validation_years(one, "year", 0)


def test_overlapping_folds_are_refused(spark):
    bad = spark.createDataFrame([(0, 2020, "train", 1), (0, 2020, "valid", 1)], "fold int, validation_year int, role string, row_id long")
    with pytest.raises(ValueError):
        f.check_folds(bad)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.3, 1), ("a", None, 1)], "g string, p double, y int")
    got = {r["g"]: r for r in f.fold_scores(df, "p", "y", ["g"]).collect()}
    assert got["a"]["auc"] == pytest.approx(0.875)
    assert got["b"]["auc"] is None
    assert got["b"]["log_loss"] == pytest.approx(1.2039728)


def test_label_conflicts(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), (None, 0), (None, 1)], "name string, target int")
    assert [r["name"] for r in f.label_conflicts(df, "name", "target").collect()] == ["a"]


def test_last_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, x int")
    assert {(r["g"], r["x"]) for r in f.last_per_group(df, ["g"], [F.desc("x")]).collect()} == {("a", 2), ("b", 3)}
