"""Rules on small tables with expectations written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadastra.operators import records, search


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).first()


def test_scans_are_put_right(spark):
    row = one(spark, "Proiect of the Promotor, Rs, 5", records.corrected(F.col("text")).alias("t"), records.corrections_made(F.col("text")).alias("m"))
    assert row.t == "Project of the Promoter, Rs. 5" and row.m == ["Promotor>Promoter", "Proiect>Project", "Rs,>Rs."]
    assert one(spark, "no O in Rs. 1O,OO0", records.repaired(F.col("text"), r"Rs\. [0-9][0-9O,]*", "O", "0"))[0] == "no O in Rs. 10,000"


@pytest.mark.parametrize(("text", "result"), [
    ("a   b\n      c  d\n\n\n\n\ne", "a b\n  c d\n\n\ne"), ("a\n\n\n\n\n", "a\n\n"), ("\t\n \t\n\t\n\t\nx", "\n\nx"), ("\tx  \n", "  x \n"), ("", ""), ("\n\n\n", "\n"), (None, None),
])
def test_spacing_keeps_the_structure(spark, text, result):
    assert one(spark, text, records.spaced(F.col("text")))[0] == result


def test_punctuation(spark):
    assert one(spark, "name:x ,see ( this )", records.punctuated(F.col("text")))[0] == "name: x, see (this)"


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\nProject Details\nname x\nVALIDITY\n\nBank Detail\nIFSC"), (2, "")], "k int, text string")
    rows = [(r.title, r.content) for r in records.sections(docs, "k", "text").orderBy("no").collect()]
    assert rows == [("HEADER", "intro"), ("PROJECT DETAILS", "name x"), ("BANK DETAIL", "IFSC")]


def test_document_kinds(spark):
    rows = [("deed.pdf", "an agreement and a deed", "agreement", 6), ("x", "nothing", None, None), ("x", "layout plan, search report", "layout_plan", 1), ("noc_fire.pdf", "fire noc", "noc_fire", 5), ("QPR.pdf", "progress report\nquarterly report", "quarterly_report", 6)]
    for name, text, kind, tenths in rows:
        best = spark.createDataFrame([(name, text)], "n string, t string").select(records.document_kind(F.col("n"), F.col("t")).alias("b")).first().b
        assert (best and (best.kind, best.tenths)) == (kind and (kind, tenths))


@pytest.mark.parametrize("base", ["https://h/a/b/c", "https://h/a", "https://h", "https://h/", "http://h/a/b/?x=/y/z", "https://h/a//b/c#/d/e", ""])
def test_urls_are_joined_as_the_standard_says(spark, base):
    from urllib.parse import urljoin

    links = ["../x", "../../../x", "..", "../", "../..", "../x/../y", "../x/./y/", "../x?a=../b", "../x#../b", "../x//y", "x/y", "./z", "/root", "https://o/z", "a/../z", ""]
    got = spark.createDataFrame([(base, x) for x in links], "b string, r string").select("r", records.joined_url(F.col("b"), F.col("r")).alias("u")).collect()
    assert {r.r: r.u for r in got} == {x: urljoin(base, x) if x.startswith("..") else x for x in links}


HITS = "project_id int, project_name string, status string, district string, lat double, lon double, approved_date date, min_price double, max_price double, overall_score double, location_score double, amenity_score double"


def test_search_orders_and_totals(spark):
    rows = [(1, "b", "O", "X", 20.0, 82.0, None, None, None, 50.0, None, 1.0), (2, "A", "F", "Y", 20.1, 82.0, None, 10.0, 20.0, None, 9.0, None), (3, "c", "O", "X", None, None, None, 5.0, 6.0, 80.0, 1.0, 2.0)]
    table = spark.createDataFrame(rows, HITS)
    ids = lambda **how: [r.project_id for r in search.search(table, **how).collect()]
    assert ids() == [3, 1, 2] and ids(descending=False) == [2, 1, 3]
    assert ids(sort_by="price", descending=False) == [3, 2, 1] and ids(sort_by="name", descending=False) == [2, 1, 3]
    assert ids(sort_by="distance", descending=False, near=(20.0, 82.0)) == [1, 2, 3] and ids(near=(20.0, 82.0), radius_km=5.0) == [1]
    assert ids(districts=["X"], price=(6.0, None)) == [3] and ids(box=(19.0, 81.0, 20.05, 83.0)) == [1]
    page = search.search(table, page=2, size=2).collect()
    assert [(r.project_id, r.total) for r in page] == [(2, 3)]


def test_amenity_scores_by_hand(spark):
    rows = [(1, "grocery_convenience", 1.0, 5, 0.1), (1, "grocery_convenience", 3.0, 0, 0.1), (1, "bank_atm", 3.0, 1, 1.5), (1, "school", 10.0, 9, 2.0), (1, "mall", None, None, None), (2, "mall", None, None, None)]
    got = {r.project_id: r for r in search.amenity_scores(spark.createDataFrame(rows, "project_id int, kind string, radius_km double, n int, km double")).collect()}
    # daily (100 + 20 + 20) / 3; social (100 + 5 * 20) / 6, school there; transit 20, bank 70
    assert (got[1].daily, got[1].social, got[1].connectivity) == (47.0, 33.0, 35.0)
    # 0.4 * 47 + 0.35 * 33 + 0.25 * 35 = 39.1; with 0 on site half of it, to even
    assert (got[1].location_score, got[1].overall_score, got[1].score_status) == (39.0, 20.0, "ok")
    assert (got[2].overall_score, got[2].score_status, got[2].reason) == (0.0, "partial", "missing_nearby_data")
