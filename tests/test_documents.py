"""Nested documents and page mapping."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cadastra.functions import documents as d


def test_title_case(spark):
    row = spark.sql("SELECT 'NEAR-IT park o''neil 2nd école' AS x").select(d.title_case(F.col("x")).alias("t")).first()
    assert row.t == "Near-It Park O'Neil 2Nd École"


def test_paths():
    doc = {"a": [{"b": 1}], "c": None}
    assert d.get_path(doc, "a.0.b") == d.get_path(doc, "a[0].b") == 1
    assert d.get_path(doc, "a.1.b") is None and d.get_path(doc, "c.x") is None
    assert d.set_path({}, "x.1.y", 5) == {"x": [None, {"y": 5}]}
    assert d.set_path(doc, "a.0.b", 2)["a"][0]["b"] == 2


def test_differences(spark):
    left = spark.createDataFrame([(1, '{"a": [1, {"b": 2}], "z": {}}'), (2, "not json")], "k int, text string")
    right = spark.createDataFrame([(1, '{"a": [1, {"b": 3}, 4], "z": {}}'), (2, "not json")], "k int, text string")
    rows = sorted((r.k, r.path, r.left, r.right) for r in d.differences(left, right, "k", "text").collect())
    assert rows == [(1, "a[1].b", "2", "3"), (1, "a[2]", None, "4")]


def test_table_records():
    rows = d.table_records(["Sr", "Unit Type", "Carpet Area (sq m)", "Price (INR)"], [["1", "2BHK", "61.5 ", "25,00,000"], ["2", "", "-", ""]], {"name": ("unit type",), "carpet_area_sq_m": ("carpet",), "price_in_inr": ("price",)})
    assert rows == [{"price_in_inr": 2500000.0, "carpet_area_sq_m": 61.5, "name": "2BHK"}]


def test_pages_become_documents(spark):
    html = "<h2>Project Details</h2><table><tr><td>Project Name</td><td>Green</td></tr><tr><td>Launch Date</td><td>05/03/2020</td></tr><tr><td>Colour</td><td>red</td></tr></table>"
    rows = spark.createDataFrame([(1, html, "R1"), (2, None, None)], "k int, html string, reg string")
    made = {r.k: json.loads(r.document) for r in d.map_pages(rows, "k", "html", "reg").collect()}
    assert made[1]["project_details"] == {"project_name": "Green", "launch_date": "2020-03-05", "registration_number": "R1"}
    assert made[1]["raw_data"]["unmapped_sections"] == {"Project Details": {"Colour": "red"}}
    assert made[2]["project_details"] == {}


def test_linked_data_leaves_nulls_out(spark):
    rows = spark.createDataFrame([(1, "A", "R1", None, None, None), (2, "B", "R2", 21.0, 81.0, 5.0)], "project_id int, project_name string, reg_no string, lat double, lon double, total_price double")
    made = {r.project_id: json.loads(r.json_ld) for r in d.linked_data(rows).collect()}
    assert "geo" not in made[1] and "offers" not in made[1] and made[2]["geo"]["latitude"] == 21.0


def test_file_arrival_is_idempotent(spark, tmp_path):
    from cadastra.streaming.files import ingest

    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"reg": "R1", "name": "Old", "at": 1}))
    run = lambda: ingest(spark, source, "reg string, name string, at long", target, state, ["reg"], ["at"]).awaitTermination()
    run()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"reg": "R1", "name": "New", "at": 2}))
    run()
    run()
    last = sorted(p.name for p in (tmp_path / "out").iterdir())[-1]
    assert [(r.reg, r.name) for r in spark.read.parquet(f"{target}/{last}").collect()] == [("R1", "New")]


def test_amenities_inside_bounds():
    html = "<table><tr><th>Amenity</th><th>Area</th><th>Latitude</th><th>Longitude</th></tr><tr><td>Park</td><td>12.5 sqm</td><td>21.2</td><td>81.6</td></tr><tr><td>Pool</td><td></td><td>51</td><td>0</td></tr><tr><td>Gym</td><td></td><td>x</td><td>y</td></tr></table>"
    assert d.amenity_rows(html) == [{"amenity": "Park", "area": 12.5, "latitude": 21.2, "longitude": 81.6}]


def test_sidecars(spark):
    from cadastra.sources.readers import with_sidecars

    pages = spark.createDataFrame([("a.html", "x"), ("b.html", "y")], "name string, html string")
    listings = spark.createDataFrame([("a.listing.json", "R1")], "name string, reg string")
    assert sorted((r.name, r.reg) for r in with_sidecars(pages, listings).collect()) == [("a.html", "R1"), ("b.html", None)]


def test_migrations_twice_are_once(spark, sf_dir):
    from cadastra.plans.migrations import migrate
    from cadastra.plans.operator import Operator
    from cadastra.sources.domain import RELATIONS

    frames = {n: Operator(n, (), lambda dialect, n=n: f"SELECT * FROM {{{n}}}").query(spark, sf_dir) for n in ("locations", "snapshots", "projects", "scores", "amenity_stats", "verifications", "project_tags", "tags")}
    assert set(frames) <= set(RELATIONS)
    assert migrate(spark, frames) == migrate(spark, frames) == ["best_locations", "latest_prices", "search_view"]
    assert spark.table("search_view").count() == frames["projects"].count()
