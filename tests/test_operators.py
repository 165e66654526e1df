"""Every declarative operator gives the rows that its SQL gives in another engine."""

from __future__ import annotations

import duckdb
import pytest
from compare import database, same

from cadastra.operators.registry import OPERATORS, ORACLE_SQL, QUERIES
from cadastra.plans.dialect import DUCK


@pytest.fixture(scope="module")
def duck(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_names_are_unique():
    assert len({o.name for o in OPERATORS}) == len(OPERATORS)


def test_apply_takes_any_frames(spark):
    from cadastra.operators.registry import BY_NAME

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "project_id long, slug string")
    rows = rows.replace({"a": "Brand#1", "b": "Brand#2"})
    assert [r.project_id for r in BY_NAME["agg03_has_all_tags"].apply(spark, project_tags=rows).collect()] == [1]


def test_price_text_at_halves(spark, tmp_path):
    # 189350 * 100 / 10^5 hundredths is 18.935 in decimals and a little less as a double
    prices = [189350.0, 75335.0, 75365.0, 190250.0, 1005.0, 0.125, 99999.995, 100500.0]
    rows = spark.createDataFrame([(3 * i + r, p) for i, p in enumerate(prices) for r in range(3)], "o_orderkey long, o_totalprice double")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert same(QUERIES["str22_price_text"](spark, str(tmp_path)), duck, ORACLE_SQL["str22_price_text"]) == len(prices) * 3


def test_landmark_links_of_repeated_ids_and_shuffles(spark):
    from cadastra.operators.registry import BY_NAME

    # ids that stand at several places, rows that come twice, no id, no place
    projects = [(1, 20.0, 81.0), (1, 20.05, 81.0), (1, 20.0, 81.0), (2, 20.0, 81.0), (2, 20.0, 81.0), (3, 20.02, 81.0), (None, 20.0, 81.0), (None, 20.03, 81.0), (4, None, 81.0), (5, 25.0, 81.0), (6, 20.02, 81.0)]
    landmarks = [(1, 20.01, 81.0, 50, True), (2, 20.02, 81.0, 95, True), (2, 20.06, 81.0, 10, True), (2, 20.06, 81.0, 10, True), (3, 20.0, 81.0, 99, False), (4, 20.04, 81.0, None, True), (None, 20.0, 81.0, 90, True)]
    frames = {"projects": spark.createDataFrame(projects, "project_id long, lat double, lon double"), "landmarks": spark.createDataFrame(landmarks, "landmark_id long, lat double, lon double, importance int, is_active boolean")}
    got = BY_NAME["jn13_landmark_links"].apply(spark, **frames)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE projects (project_id BIGINT, lat DOUBLE, lon DOUBLE)")
    duck.execute("CREATE TABLE landmarks (landmark_id BIGINT, lat DOUBLE, lon DOUBLE, importance INTEGER, is_active BOOLEAN)")
    duck.executemany("INSERT INTO projects VALUES (?, ?, ?)", projects)
    duck.executemany("INSERT INTO landmarks VALUES (?, ?, ?, ?, ?)", landmarks)
    sql = BY_NAME["jn13_landmark_links"].statement(DUCK).replace("{projects}", "projects").replace("{landmarks}", "landmarks")
    assert same(got, duck, sql) == 20


def test_landmark_links_of_one_place_are_not_grouped(spark):
    from cadastra.operators.registry import BY_NAME

    # 4,000 pairs at one place: nothing but projects and landmarks may be shuffled
    projects = spark.range(400).selectExpr("id AS project_id", "20.0D AS lat", "81.0D AS lon")
    landmarks = spark.range(10).selectExpr("id AS landmark_id", "20.0D AS lat", "81.0D AS lon", "1 AS importance", "TRUE AS is_active")
    got = BY_NAME["jn13_landmark_links"].apply(spark, projects=projects, landmarks=landmarks)
    assert got.count() == 4000
    branches = got._jdf.queryExecution().optimizedPlan().toString().split("Union")[1]
    assert "Aggregate [project_id" not in branches.split("Generate inline")[0]
