"""Scalar rules on examples, pages, readers, models."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.functions import geo
from cadastra.functions import text as t
from cadastra.functions.geo import haversine
from cadastra.functions.html import listing_rows, map_coordinates, parse_page
from cadastra.operators import arrivals
from cadastra.operators.models import Forest, impute, outliers
from cadastra.sources import readers


def values(spark, rows, expression):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in frame.select("i", F.expr(expression).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("text", "sqm"), [("1000 sq.ft", 92.903), ("1000 sqft", 92.903), ("10", 10.0), ("2 acre", 8093.7128448), ("1 Hectare", 10000.0), ("3 bigha", 7587.84), ("1,000 Sq. Yd", 836.127), ("plot", None), (None, None)])
def test_areas(spark, text, sqm):
    got = values(spark, [text], t.area_sqm("x"))[0]
    assert got == (pytest.approx(sqm) if sqm is not None else None)


@pytest.mark.parametrize(("text", "inr"), [("₹ 50 lakh", 5_000_000), ("Rs. 1.5 Cr", 15_000_000), ("25,000", 25_000), ("40k", 40_000), ("3 lac", 300_000), ("ask", None), (None, None)])
def test_prices(spark, text, inr):
    assert values(spark, [text], t.price_inr("x"))[0] == inr


def test_dates(spark):
    got = values(spark, ["05/03/2020", "2020-03-05", "05.03.2020", "5 March 2020", "05 Mar 2020", "soon", "", None], t.any_day("x"))
    assert [str(d) if d else None for d in got] == ["2020-03-05"] * 3 + [None, "2020-03-05", None, None, None]


def test_texts(spark):
    assert values(spark, ["  a \n b\t", "", None], t.collapse_space("x")) == ["a b", None, None]
    assert values(spark, ["Green  Park--Ph.2 "], t.slug("x")) == ["green-park-ph-2"]
    assert values(spark, ["-p-cg--rera 12/."], t.registration_number("x")) == ["P-CG-RERA12"]
    assert values(spark, ["Raipur 492001, India", "492001", "1234567", "id 12345"], t.pincode("x")) == ["492001", "492001", None, None]
    assert values(spark, [" ONGOING ", "complete", "other"], t.canonical_status("x")) == ["Ongoing", "Completed", "other"]
    assert values(spark, ["https://a.b", "1,234.5", "01-02-2020", "x", " "], t.value_type("x")) == ["URL", "NUMBER", "DATE", "TEXT", "UNKNOWN"]


def test_half_even(spark):
    from cadastra.plans.dialect import SPARK

    assert values(spark, ["2.5", "3.5", "46.5"], SPARK.even("x", 0)) == [2.0, 4.0, 46.0]


def test_haversine(spark):
    km = spark.sql(f"SELECT {haversine('21.25e0', '81.63e0', '22.09e0', '82.15e0')} AS km").first().km
    assert km == pytest.approx(107.6, abs=1)


PAGE = """<html><head><title> A  page </title><script>x = "No: thing"</script></head><body>
<h2>Promoter Details</h2><table><tr><td>Name :</td><td>Asha Homes</td></tr><tr><td>Phone</td><td>-</td></tr></table>
<label>Email</label><span> a@b.in </span><p>Tehsil : Raipur</p>
<h3>Projects</h3><table><tr><th>Reg No</th><th>Project Name</th><th>Detail</th></tr><tr><td>R1</td><td>One</td><td>x</td></tr><tr><td></td><td></td><td></td></tr><tr><td>R2</td><td>Two</td><td>y</td></tr></table>
<h3>Inventory Status</h3><div class="bg_llg" title="A-1"></div><div class="bg_lly" title="A-2"></div><a href="/d/1">Open</a></body></html>"""


def test_page():
    page = parse_page(PAGE)
    assert page.title == "A page"
    assert ("Promoter Details", "Name", "Asha Homes") in page.fields
    assert ("Promoter Details", "Email", "a@b.in") in page.fields
    assert ("Promoter Details", "Tehsil", "Raipur") in page.fields
    assert not any(label == "Phone" for _, label, _ in page.fields)
    assert [c["title"] for c in page.grid] == ["A-1", "A-2"]
    assert page.links == [("/d/1", "Open")]
    assert listing_rows(page, {"reg": ("reg",), "name": ("project name",)}) == [{"reg": "R1", "name": "One"}, {"reg": "R2", "name": "Two"}]
    assert parse_page("").fields == [] and parse_page("<table><tr>").tables == []


def test_map_coordinates():
    assert map_coordinates("https://maps/embed?pb=!1m!2d81.6!3d21.2!") == (21.2, 81.6)
    assert map_coordinates("https://maps?q=21.2,81.6") == (21.2, 81.6)
    assert map_coordinates("https://maps?q=51.5,0.1") is None and map_coordinates(None) is None


def document(name):
    return {"metadata": {"state_code": "cg", "scraped_at": "2024-01-01T00:00:00Z"}, "project_details": {"registration_number": "R1", "project_name": name, "launch_date": "2020-02-30"}, "promoter_details": [{"name": "P"}], "unit_types": [{"name": "2BHK", "price_in_inr": 5.0}]}


def test_documents_load_twice_is_once(spark, tmp_path):
    from cadastra.streaming.files import upsert

    run = tmp_path / "run_1" / "scraped_json"
    run.mkdir(parents=True)
    (run / "a.v1.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(document("Old")).encode())
    (run / "b.v1.json").write_text("{not json")
    docs = readers.read_documents(spark, str(tmp_path))
    assert docs.where("broken IS NOT NULL").count() == 1
    tables = readers.shred(docs)
    first = tables["projects"].collect()
    assert [(r.run_id, r.state_code, r.reg_no, r.project_name, r.launch_date) for r in first] == [("run_1", "CG", "R1", "Old", None)]
    assert tables["promoter_details"].count() == 1 and tables["documents"].count() == 0
    once = upsert(None, tables["projects"], ["state_code", "reg_no"], ["scraped_at"])
    twice = upsert(once, tables["projects"].withColumn("project_name", F.lit("New")), ["state_code", "reg_no"], ["scraped_at"])
    assert [r.project_name for r in twice.collect()] == ["New"]
    kept = readers.replace_children(tables["unit_types"], tables["unit_types"], ["state_code", "reg_no"])
    assert kept.count() == 1


def test_other_readers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "project_cg_R9.html").write_text("<title>x</title>")
    assert [(r.reg_no, r.html) for r in readers.read_html(spark, str(tmp_path / "p")).collect()] == [("R9", "<title>x</title>")]
    (tmp_path / "c.csv").write_bytes("﻿project_id,min_price\n1, 10.5 \n2,\n3,abc\n".encode())
    rows = readers.read_price_csv(spark, str(tmp_path / "c.csv")).orderBy("project_id").collect()
    assert [str(r.min_price) for r in rows] == ["10.50", "None", "None"]
    mhtml = b"MIME-Version: 1.0\nContent-Type: multipart/related; boundary=X\n\n--X\nContent-Type: text/html; charset=utf-8\n\n\n--X\nContent-Type: text/html; charset=utf-8\n\n<p>hi</p>\n--X--\n"
    assert readers.html_of_mhtml(mhtml).strip() == "<p>hi</p>" and readers.html_of_mhtml(b"") is None


def test_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(400, 2)), [[9, 9], [-9, 8]]])
    scores = Forest(x).score(x)
    assert set(np.argsort(-scores)[:2]) == {400, 401}
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "i int, a double, b double")
    flagged = {r.i for r in outliers(rows, ["a", "b"]).where("is_outlier").collect()}
    assert {400, 401} <= flagged and 999 not in flagged
    assert outliers(rows.limit(0), ["a", "b"]).count() == 0


def test_imputation_follows_a_line(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else 3.0 * i + 1, float(i)) for i in range(100)], "i int, y double, x double")
    out = {r.i: (r.y, r.y_imputed) for r in impute(rows, ["y"], ["x"]).collect()}
    assert out[1] == (4.0, False) and out[49][1] and out[49][0] == pytest.approx(148, abs=2)


def test_stream_gives_the_batch_verdicts(spark, sf_dir):
    from cadastra.operators.programs import stm01_rate_limit, stm01_rate_limit_stream

    rows = lambda f: sorted(tuple(r) for r in f.collect())
    assert rows(stm01_rate_limit(spark, sf_dir)) == rows(stm01_rate_limit_stream(spark, sf_dir))


def test_rate_limits_in_order():
    from cadastra.streaming.usage import START, Tier, limit_rows

    state, out = limit_rows(START, Tier(5, 8, 3), [0, 0, 0, 0, 30, 31, 61, 62, 63, 64, 120, 121, 122])
    assert out[:4] == ["", "", "", "burst"] and "hour" in out
    again, rest = limit_rows(limit_rows(START, Tier(5, 8, 3), [0, 0])[0], Tier(5, 8, 3), [0, 0])
    assert rest == ["", "burst"]


def test_tiers_of_clients(spark):
    import pandas as pd

    from cadastra.streaming.usage import rate_limits

    start = pd.Timestamp("2024-01-01")
    rows = [(client, client * 1000 + n, tier, (start + pd.Timedelta(seconds=n // 60)).to_pydatetime()) for client, tier in ((1, "standard"), (2, None), (3, "internal"), (4, "odd")) for n in range(180)]
    verdicts = rate_limits(spark.createDataFrame(rows, "client long, event_id long, tier string, ts timestamp"))
    allowed = {r.client: r.n for r in verdicts.where("allowed").groupBy("client").count().withColumnRenamed("count", "n").collect()}
    # a burst, and what comes back in two seconds
    assert allowed == {1: 23, 2: 66, 3: 133, 4: 23}


def test_outliers_are_a_share_of_all_rows(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.randn(3)).alias("a"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.randn(4)).alias("b"))
    out = outliers(rows, ["a", "b"], sample=256).collect()
    scores = np.array([r.anomaly_score for r in out])
    edge = np.quantile(scores, 0.99)
    assert len(out) == 4000 and all(r.is_outlier == (r.anomaly_score >= edge) for r in out)


def test_imputation_counts_a_frequent_value(spark):
    # a third of 90,000 rows is equal
    rows = spark.range(90_000).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 1e5).alias("x"), F.when(F.col("id") % 3 == 0, 1000.0).otherwise(0.0).alias("y"))
    rows = rows.union(spark.createDataFrame([(-1, None, None)], "id long, x double, y double"))
    assert [r.y for r in impute(rows, ["y"], ["x"]).where("id = -1").collect()] == [333.0]


def test_rows_become_files_by_many_tasks(spark, tmp_path):
    # a table of one row group; Hadoop's writer made them in one task, with two processes for each
    rows = spark.range(1000).coalesce(1)
    path = arrivals._files(rows, F.col("id").cast("string"), str(tmp_path / "files"), F.concat(F.lit("run_"), (F.col("id") % 2).cast("string")))
    found = [p for p in (tmp_path / "files").rglob("*") if p.is_file()]
    assert sorted(int(p.read_text()) for p in found) == list(range(1000)) and all(p.read_bytes().endswith(b"\n") for p in found)
    assert all(p.name.startswith("part-") for p in found) and {p.parts[-3] for p in found} == {"run_0", "run_1"}
    assert len({p.parent for p in found}) >= 16
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] == 3890


def test_files_of_no_rows_and_of_no_text(spark, tmp_path):
    path = arrivals._files(spark.createDataFrame([(1, None), (2, "é")], "id int, x string"), F.col("x"), str(tmp_path / "some"))
    assert sorted(bytes(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect()) == [b"\n", "é\n".encode()]
    path = arrivals._files(spark.range(0), F.col("id").cast("string"), str(tmp_path / "none"))
    assert readers.read_pdf_texts(spark, path).count() == 0


def test_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "READ_TASKS", 8, raising=False)
    run = tmp_path / "run_1"
    run.mkdir()
    for i in range(2500):
        (run / f"{i}.v1.json").write_text(json.dumps(document(str(i))))
    docs = readers.read_documents(spark, str(tmp_path))
    # 32 files to a task before: 79 tasks
    assert docs.rdd.getNumPartitions() <= 64
    assert docs.select("project_details.project_name").distinct().count() == 2500


def test_shredded_projects_read_their_files_once(spark, sf_dir):
    rows = arrivals.src02_shredded_projects(spark, sf_dir)
    assert "binaryFile" not in rows._jdf.queryExecution().toString() and all("/shredded-" not in f for f in rows.inputFiles())


def test_mhtml_headers_are_parsed_once():
    raw = b'Content-Type: multipart/related; boundary="B"\n\n--B\nContent-Type: text/html; charset=utf-8\n\n <p>\n--B--\n'
    parsed = readers.MHTML.header_factory.cache_info
    assert readers.html_of_mhtml(raw) == " <p>"
    once = parsed().misses
    for _ in range(20):
        assert readers.html_of_mhtml(raw) == " <p>"
    assert parsed().misses == once


def test_crowded_cells_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(geo, "SIDE", 50, raising=False)
    # a pole is one cell, and these tables one partition each
    left = spark.range(400).coalesce(1).selectExpr("id AS i", "89.0D + id / 1000 AS lat", "id * 7 % 360 - 180.0D AS lon")
    right = spark.range(300).coalesce(1).selectExpr("id AS j", "89.9D - id / 1000 AS lat", "id * 11 % 360 - 180.0D AS lon")
    rows = geo.within_radius(left, right, 400.0).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == len({(r.i, r.j) for r in rows}) == 400 * 300
    assert len({r.task for r in rows}) >= 4


@pytest.mark.parametrize("radius", [5e-6, 111.19492664455873, 20015.086796020572, 30000.0])
def test_pairs_at_just_the_radius(spark, radius):
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 180.0), (3, -1.0, 0.0), (4, 0.0, 4.5e-11)], "i long, lat double, lon double")
    got = {(r.i, r.j): r.km for r in geo.within_radius(places, places.withColumnRenamed("i", "j"), radius).collect()}
    pairs = places.alias("a").crossJoin(places.alias("b")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), *(F.radians(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("lat", "lon")))
    half = F.pow(F.sin((F.col("b_lat") - F.col("a_lat")) / 2), 2) + F.cos("a_lat") * F.cos("b_lat") * F.pow(F.sin((F.col("b_lon") - F.col("a_lon")) / 2), 2)
    expected = {(r.i, r.j): r.km for r in pairs.withColumn("km", 2 * geo.EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))).where(F.col("km") <= radius).collect()}
    assert got == expected
