import pytest
from pyspark.sql import functions as F

from kumihimo.operators import quality as q
from kumihimo.operators.components import connected_components

SCHEMA = "row_id long, load_id int, y string, b double, m string, column_name string"
RULES = [q.year_constraint("y"), q.amount_constraint("b"), q.member_constraint("m", "known")]


def prepared(spark, rows):
    dimension = spark.createDataFrame([("M1",), ("M2",), ("M1",), (None,)], "name string")
    return q.with_known(spark.createDataFrame(rows, SCHEMA), "m", dimension, "name", "known")


def test_wrong_values(spark):
    good = [(i, 1, y, b, m, "clash") for i, (y, b, m) in enumerate([("2020", 1.0, "M1"), ("-1", 0.0, "M2"), (None, None, None), ("1950", 1e6, "M1"), ("2030", 5.0, "M1")])]
    bad = [(10, 1, "2031", -0.1, "m1", None), (11, 1, "２０２０", float("nan"), "", None), (12, 1, "", float("inf"), " M1", None), (13, 1, "2020\n", 1000000.1, "M3", None), (14, 1, "1949", -1.0, "不明", None)]
    got = q.wrong_cells(q.cell_states(prepared(spark, good + bad), "row_id", "load_id", RULES), "row_id").collect()
    assert sorted((r["row_id"], r["column_name"]) for r in got) == sorted((i, c) for i in range(10, 15) for c in ("y", "b", "m"))


def test_odd_loads_are_found_and_states_merge(spark):
    rows = []
    for load in range(1, 9):
        for i in range(200):
            y, b, m = str(2000 + i % 20), float(1 + i % 50), ("M1", "M2")[i % 2]
            if load == 3 and i % 3 == 0:
                y = None
            if load == 4 and i % 3 == 0:
                y = "-1"
            if load == 5 and i % 4 == 0:
                b = -5.0
            if load == 6:
                b *= 1000
            if load == 7 and i % 2:
                m = "M1"
            rows.append((load * 1000 + i, load, y, b, m, None))
    rows.append((1, None, "2020", 1.0, "M1", None))
    df = prepared(spark, rows)
    whole = q.load_states(q.cell_states(df, "row_id", "load_id", RULES))
    parts = q.merge_states(*[q.load_states(q.cell_states(df.where(F.col("row_id") % 3 == k), "row_id", "load_id", RULES)) for k in range(3)])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    found = {(r["load"], r["column_name"], r["metric"]) for r in q.load_anomalies(whole).collect()}
    assert found == {(3, "y", "null"), (4, "y", "marker"), (5, "b", "wrong"), (6, "b", "spread"), (7, "m", "spread")}


def test_nothing_and_one_load(spark):
    assert q.load_anomalies(q.load_states(q.cell_states(prepared(spark, []), "row_id", "load_id", RULES))).count() == 0
    one = prepared(spark, [(1, 1, None, None, None, None)])
    assert q.load_anomalies(q.load_states(q.cell_states(one, "row_id", "load_id", RULES))).count() == 0
    profile = {r["column_name"]: r for r in q.table_profile(one.drop("known")).collect()}
    assert profile["y"]["n_null"] == 1 and profile["row_id"]["n_distinct"] == 1


def test_profile_counts(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}", None if i % 2 else 1.5) for i in range(100)], "id int, s string, d double")
    got = {r["column_name"]: r for r in q.table_profile(df).collect()}
    assert got["s"]["n_distinct"] == 7 and got["d"]["null_rate"] == 0.5 and got["id"]["n_distinct"] == pytest.approx(100, abs=4)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (3, 1), (1, 2)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {n: c for n, c in got.items() if n < 10} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {c for n, c in got.items() if n >= 100} == {100}
    star = spark.createDataFrame([(0, i) for i in range(1, 500)], "a long, b long")
    assert {r["component"] for r in connected_components(star, "a", "b").collect()} == {0}
    assert connected_components(star.where("false"), "a", "b").count() == 0


def test_large_groups_are_taken_apart(spark):
    from kumihimo.operators.skew import large_groups, with_group_values

    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(600)], "id long, k string")
    values = {"n": F.count("*"), "least": F.min("id")}
    plain = with_group_values(df, ["k"], values, "id")
    apart = with_group_values(df, ["k"], values, "id", part=1, least=100)
    assert large_groups(df, ["k"], "id") is None and large_groups(df, ["k"], "id", 1, 100).count() == 1
    columns = ["id", "k", "n", "least"]
    assert sorted(map(tuple, plain.select(*columns).collect())) == sorted(map(tuple, apart.select(*columns).collect()))
