"""Merged documents, the quality gate, exact quantiles, explanations, samples and extracts: SQL written apart, and rules said in plain Python."""

from __future__ import annotations

import json
import random
import re
from datetime import date, datetime

import numpy as np
import pytest
from compare import database, same
from pyspark.sql import functions as F

from cadastra.functions import conflict, matches, salvage
from cadastra.functions.conflict import Strategy
from cadastra.operators import enrichment, explanations, extracts, gate, sampling
from cadastra.operators.selection import grouped_quantiles

QUERIES = {k: (m.QUERIES[k], m.ORACLE_SQL[k]) for m in (enrichment, gate, explanations, sampling, extracts) for k in m.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, name):
    query, sql = QUERIES[name]
    assert same(query(spark, sf_dir), database(sf_dir), sql) > 0


# conflicts


def resolved(field_strategy, s, p):
    """value, strategy, confidence by the rules, over Python values."""
    blank = lambda v: v is None or v == [] or v == {} or (isinstance(v, str) and not v.strip())
    if blank(s) and blank(p):
        return None, "prefer_pdf", 1.0
    if blank(s):
        return p, "prefer_pdf", 1.0
    if blank(p):
        return s, "prefer_scraped", 1.0
    fold = lambda v: " ".join(v.lower().split())
    if s == p or (isinstance(s, str) and isinstance(p, str) and (fold(s) in fold(p) or fold(p) in fold(s))):
        return p, "prefer_pdf", 1.0
    size = lambda v: len(v) if isinstance(v, str) else len(json.dumps(v, separators=(",", ":")))
    if field_strategy == "prefer_longer":
        return (p, field_strategy, 0.8) if size(p) > size(s) else (s, field_strategy, 0.8) if size(s) > size(p) else (p, field_strategy, 0.7)
    if field_strategy == "prefer_newer":
        def day(v):
            for f in ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%Y/%m/%d"):
                try:
                    return datetime.strptime(v, f) if isinstance(v, str) else None
                except ValueError:
                    continue
        if day(s) and day(p):
            return (p if day(p) > day(s) else s), field_strategy, 0.8
        return p, field_strategy, 0.6
    if field_strategy == "merge":
        if isinstance(s, list) and isinstance(p, list):
            return list(dict.fromkeys(s + p)), field_strategy, 0.8
        return (f"{s} | {p}", field_strategy, 0.5) if isinstance(s, str) and isinstance(p, str) else (p, field_strategy, 0.6)
    return {"prefer_pdf": (p, field_strategy, 0.9), "prefer_scraped": (s, field_strategy, 0.9), "manual": (p, field_strategy, 0.3)}[field_strategy]


VALUES = [None, "", "  ", "Sun Villa", "sun  villa", "Sun Villa Phase 2", "Moon Park", 'a "b" \\ c', 12, 12.5, 120, [], ["a", "b"], ["b", "c"], {}, {"x": 1}, "2024-01-05", "06-01-2024", "5/1/2024", "2024/02/30", "31-04-2024", True, "é ü"]


@pytest.mark.parametrize("strategy", list(Strategy))
def test_conflicts_are_settled_by_their_strategy(spark, strategy):
    pairs = [(i, j) for i in range(len(VALUES)) for j in range(len(VALUES))]
    as_json = lambda v: None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    frame = spark.createDataFrame([(i, j, as_json(VALUES[i]), as_json(VALUES[j])) for i, j in pairs], "i int, j int, s string, p string")
    rows = frame.select("i", "j", conflict.resolution(F.col("s"), F.col("p"), F.lit(str(strategy))).alias("r")).collect()
    for row in rows:
        value, used, confidence = resolved(str(strategy), VALUES[row.i], VALUES[row.j])
        got = None if row.r.value is None else json.loads(row.r.value)
        assert (got, row.r.strategy, row.r.confidence) == (value, used, confidence), (VALUES[row.i], VALUES[row.j])
        assert row.r.review == (confidence < 0.7)


# merges


def merged_by_hand(document, extractions):
    """The document with its fields set, in the order of the extractions."""
    def get(data, path):
        for part in path.split("."):
            if part.isdigit():
                data = data[int(part)] if isinstance(data, list) and int(part) < len(data) else None
            else:
                data = data.get(part) if isinstance(data, dict) else None
        return data

    out, added, updated, review, errors = json.loads(json.dumps(document)), 0, 0, {}, set()
    for fields in extractions:
        for field, path in enrichment.FIELD_PATHS.items():
            p = fields.get(field)
            if p is None:
                continue
            s, final = get(document, path), p
            if s is not None and s != p:
                strategy = "prefer_longer" if field in conflict.LONGER_FIELDS else "prefer_pdf"
                final, _, confidence = resolved(strategy, s, p)
                review[field] = confidence < 0.7
                updated += final != s
            elif s is None:
                added += 1
            section, *place, member = path.split(".")
            want = list if place else dict
            held = out.setdefault(section, want())
            if not isinstance(held, want):
                errors.add(field)
                continue
            if place:
                while len(held) <= int(place[0]):
                    held.append({})
                held = held[int(place[0])]
            held[member] = final
    return out, added, updated, sum(review.values()), sorted(errors)


def test_projects_are_merged_with_n_extractions(spark):
    rng = random.Random(2)
    some = lambda: rng.choice(VALUES)
    documents = {i: {"project_details": {"project_name": some(), "total_units": some(), "other": some()}, "bank_details": rng.choice([[], [{"bank_name": some(), "x": 1}], [{"y": 2}, {"z": 3}]]), "note": [1, {"k": None}]} for i in range(25)}
    documents[5] = {"project_details": "text", "bank_details": {"a": 1}, "promoter_details": [{}], "land_details": None}
    documents[6] = {}
    fields = lambda: {f: some() for f in enrichment.FIELD_PATHS if rng.random() < 0.5} | {"unknown field": 1}
    found = {i: [fields() for _ in range(rng.choice([0, 1, 2, 6]))] for i in documents}
    found[5] = [{"project_name": "a", "bank_name": "b", "promoter_name": "c", "total_plots": 3}]
    text = lambda v: json.dumps(v, ensure_ascii=False)
    projects = spark.createDataFrame([(i, text(d), "clash") for i, d in documents.items()], "project_id int, document string, held string")
    rows = [(i, n, rng.choice(["plan", None]), text(e)) for i, es in found.items() for n, e in enumerate(es)]
    extractions = spark.createDataFrame([*rows, (3, 99, "plan", None), (4, 99, "plan", "no json"), (77, 1, "plan", '{"total_units": 1}')], "project_id int, seq int, document_type string, fields string")
    got = {r.project_id: r for r in enrichment.merged_projects(projects, extractions.repartition(3)).collect()}
    assert got.keys() == documents.keys()
    for i, row in got.items():
        out, added, updated, conflicts, errors = merged_by_hand(documents[i], found[i])
        built = json.loads(row.document)
        meta, kinds = built.pop("metadata"), built.pop("extracted_documents")
        assert built == {k: v for k, v in out.items() if v is not None or k in built}, i
        assert (row.n_added, row.n_updated, row.n_conflicts, row.errors, row.success, row.needs_review) == (added, updated, conflicts, errors, not errors, conflicts > 0)
        assert meta["schema_version"] == "2.0" and ("pdf_extracted" in meta["data_sources"]) == (bool(found[i]) or i in (3, 4))
        last = {(k or "unknown"): json.loads(f) for p, _, k, f in rows if p == i}
        assert {k: v for k, v in kinds.items() if i not in (3, 4)} == (last if i not in (3, 4) else {})
    report = enrichment.merge_report(enrichment.merged_projects(projects, extractions)).first()
    assert report.total_processed == 25 and report.failed == sum(not r.success for r in got.values()) and report.total_fields_added == sum(r.n_added for r in got.values())
    assert enrichment.merged_projects(projects.limit(0), extractions).collect() == []


# quantiles


def test_quantiles_of_huge_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(None if g == 2 else f"g{g}", None if rng.random() < 0.1 else float(v)) for g, size in ((0, 900), (1, 1), (2, 57), (3, 300)) for v in (rng.integers(0, 40, size) if g == 3 else rng.normal(size=size))]
    rows += [("nulls", None)] * 3
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    qs = {"low": 0.1, "mid": 0.5, "high": 1.0}
    for frame, keys in ((frame, ["k"]), (frame, [])):
        got = {(r.k if keys else 0): (r.low, r.mid, r.high) for r in grouped_quantiles(frame, keys, "v", qs).collect()}
        groups = {}
        for k, v in rows:
            if v is not None:
                groups.setdefault(k if keys else 0, []).append(v)
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            assert np.allclose(got[k], np.quantile(values, list(qs.values())), rtol=1e-12, atol=1e-12)
    assert grouped_quantiles(frame.limit(0), ["k"], "v", qs).collect() == []


# gate


def test_status_of_flags(spark):
    full = {"rera_registration_number": "R", "project_name": "P", "district": "D", "project_status": "S", "promoter_name": "O", "approved_date": date(2024, 1, 1), "proposed_end_date": date(2025, 1, 1), "extended_end_date": date(2026, 1, 1), "min_price_per_sqft": 1000.0, "locality_price": 1000.0, "min_price_total": 100_000.0}
    cases = [({}, "passed", []), ({"extended_end_date": date(2024, 6, 1)}, "pending", ["info"]), ({"proposed_end_date": date(2023, 1, 1)}, "warning", ["warning"]), ({"district": " "}, "failed", ["error"]), ({"min_price_total": 99_999.0}, "warning", ["warning"]),
             ({"min_price_total": 0.0}, "warning", ["warning"]), ({"locality_price": 0.0}, "passed", []), ({"locality_price": 700.0}, "warning", ["warning"]), ({"locality_price": 600.0}, "failed", ["error"]), ({"min_price_per_sqft": 499.0, "locality_price": None}, "warning", ["warning"]), ({"approved_date": None}, "warning", ["warning"])]
    frame = spark.createDataFrame([(i, *(full | change).values(), "clash") for i, (change, _, _) in enumerate(cases)], "i int, rera_registration_number string, project_name string, district string, project_status string, promoter_name string, approved_date date, proposed_end_date date, extended_end_date date, min_price_per_sqft double, locality_price double, min_price_total double, flags string")
    rows = {r.i: r for r in gate.gated(frame).collect()}
    for i, (_, status, severities) in enumerate(cases):
        assert (rows[i].status, [f.severity for f in rows[i].flags], rows[i].flag_count) == (status, severities, len(severities)), cases[i]
    assert rows[7].flags[0].message == "Price deviates 42.9% from locality average (threshold: 30%)" and rows[7].flags[0].expected == "700 ± 30%" and rows[5].flags[0].actual is None
    # columns that are not there
    assert gate.gated(spark.createDataFrame([(1,)], "i int")).first().status == "failed"


# matches


@pytest.mark.parametrize("text", ["", None, "no", "12", "a12b345", "12 and 7, 99" * 30, "é1é22€" * 40, "1" * 500, "x" * 1000 + "5" + "y" * 1000])
def test_matches_with_their_surroundings(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(matches.matches(F.col("t"), r"(\d)\d*", 1, 5, 4)).first()[0]
    assert got is None if text is None else [tuple(m) for m in got] == [(m[0], m[1], m.start(), text[max(0, m.start() - 5) : m.start()], text[m.end() : m.end() + 4]) for m in re.finditer(r"(\d)\d*", text)]


@pytest.mark.parametrize("text", ["Rs. 1,000 lakh and crores ₹5", "₹ 12.50 crore, INR7 lakhs Rs9", "Rs , nothing 3 rupees", "1,2.34 lakhs 5crore", "", "x" * 50 + "rs 5" + "y" * 19 + "lakh" + "INR 6"])
def test_amounts(spark, text):
    expected = []
    for pattern in matches.AMOUNTS:
        for m in re.finditer(pattern, text, re.I):
            try:
                value = float(m[1].replace(",", ""))
            except ValueError:
                continue
            around = text[max(0, m.start() - 20) : m.end() + 20].lower()
            expected.append((value * (1e7 if "crore" in around else 1e5 if "lakh" in around else 1), m[0], m.start()))
    assert [tuple(a) for a in spark.createDataFrame([(text,)], "t string").select(matches.amounts(F.col("t"))).first()[0]] == expected


# salvage


@pytest.mark.parametrize(("text", "result"), [('{"a": 1}', {"a": 1}), ("[1]", [1]), ("5", 5), ('so {"a": {"b": 2}} it is', {"a": {"b": 2}}), ("```json\n[1, 2]\n```", [1, 2]), ("```\n3\n```", 3), ("none", {}), ("", {}), (None, {}), ("{a}", {}), ("x" * 100_000 + '{"a": 1}', {"a": 1})])
def test_salvage(spark, text, result):
    assert json.loads(spark.createDataFrame([(text,)], "t string").select(F.to_json(salvage.salvaged(F.col("t")))).first()[0]) == result


# samples


@pytest.mark.parametrize("n", [0, 1, 3, 10, 29, 30, 100])
def test_samples_have_n_rows_whatever_the_strata(spark, n):
    rows = [(i, None if i % 10 == 0 else f"s{min(i % 7, 3)}", None if i % 4 == 0 else date(2024, 1, 1 + i % 5), "clash") for i in range(30)]
    frame = spark.createDataFrame(rows, "id int, s string, d date, rank string")
    got = sampling.stratified_sample(frame, "s", "d", "id", n).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r[1], []).append(r)
    left, taken = n, []
    for s, members in sorted(sizes.items(), key=lambda kv: (-len(kv[1]), kv[0] is None, kv[0] or "")):
        share = min(max(1, int(len(members) / 30 * n)), left, len(members))
        left -= share
        taken += sorted(members, key=lambda r: (r[2] is None, -(r[2] or date.min).toordinal(), -r[0]))[:share]
    rest = sorted((r for r in rows if r not in taken), key=lambda r: -r[0])[: n - len(taken)]
    assert sorted((r.id, r.backfill) for r in got) == sorted([(r[0], False) for r in taken] + [(r[0], True) for r in rest])
    assert len(got) == min(n, 30)


def test_explanations_of_projects_without_amenities(spark):
    scores = spark.createDataFrame([(1, 80.0, 20.0, "ok", None), (2, None, None, "insufficient_data", '["a", "b"]'), (3, None, None, None, None), (4, None, None, "insufficient_data", "plain")], "project_id int, location_score double, amenity_score double, score_status string, score_status_reason string")
    stats = spark.createDataFrame([], "project_id int, place int, amenity_type string, radius_km double, onsite_available boolean, onsite_details string, nearby_count int, nearby_nearest_km double")
    rows = {r.project_id: r for r in explanations.explanations(scores, stats).collect()}
    assert rows[1].summary == "Excellent location, limited onsite infrastructure" and rows[1].positives == []
    assert rows[2].negatives == ["a, b"] and rows[3].negatives == ["Missing amenity or location context data"] and rows[4].negatives == ["plain"]
