"""Row rules, changing tables and file readers: SQL written apart, rules said in plain Python, replays and failures."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import date, datetime, timedelta

import duckdb
import pytest
from compare import database, same
from pyspark.sql import functions as F

from cadastra.functions import cleaning
from cadastra.functions.geo import within_radius
from cadastra.operators import arrivals, checks, lookups, portal, search, states, text_rules
from cadastra.runtime import Workspace
from cadastra.streaming import state

QUERIES = {k: (m.QUERIES[k], m.ORACLE_SQL[k]) for m in (checks, states, arrivals, text_rules, portal, lookups, search) for k in m.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, name):
    query, sql = QUERIES[name]
    assert same(query(spark, sf_dir), database(sf_dir), sql) > 0


# addresses


def plain_address(p):
    clean = lambda v: " ".join((v or "").replace(",", " ").split()) or None

    def led(value, heads, word):
        value = clean(value)
        for head in heads if value else ():
            if value.lower().startswith(head):
                rest = value[len(head) :].lstrip(" .-")
                return f"{word} {rest}" if rest else word
        return value

    parts = {
        "address_line": clean(p.get("address_line")), "village_or_locality": clean(p.get("village_or_locality")), "tehsil": led(p.get("tehsil"), ("tahsildar", "tahsil", "tehsil", "tah.", "tah"), "Tehsil"),
        "district": led(p.get("district"), ("district", "dist.", "dist ", "dist"), "District"), "state": clean(p.get("state")) or {"CG": "Chhattisgarh"}.get((p.get("state_code") or "").upper()), "pincode": clean(p.get("pincode")), "country": clean(p.get("country")),
    }
    return ", ".join(v for v in parts.values() if v), [k for k, v in parts.items() if v], [k for k, v in parts.items() if not v]


def test_addresses(spark):
    rng = random.Random(1)
    words = [None, "", " , ", "Raipur", "Dist. Durg", "dist", "District - X", "DISTANT  place,", "Tah.Arang", "tahsildar", "Tehsil.. Y", "tahr", "cg", "CG", "12, a\tb "]
    names = [*checks.PARTS, "state_code"]
    rows = [tuple(rng.choice(words) for _ in names) for _ in range(400)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))
    columns = {n: F.col(n) for n in names}
    for r in frame.select("k", checks.address(columns).alias("a"), checks.geocoding_candidates(columns).alias("c")).collect():
        parts = dict(zip(names, rows[r.k], strict=True))
        assert (r.a.normalized, r.a.used, r.a.missing) == plain_address(parts)
        seen = []
        for gone in ((), ("address_line",), ("address_line", "village_or_locality"), ("address_line", "village_or_locality", "tehsil")):
            text = plain_address({k: v for k, v in parts.items() if k not in gone})[0]
            if text and text not in seen:
                seen.append(text)
        assert r.c == seen


# classes


def test_document_classes(spark):
    rows = [("RERA cert.pdf", "", "registration_certificate", 0.9, "filename"), ("x", "fire NOC", "noc_document", 2 / 8 * 0.8 + 0.1, "keywords"), ("", "noc sale deed", "noc_document", 1 / 8 * 0.8 + 0.05, "keywords"), (None, None, "unknown", 0.0, "keywords"), ("x", " ".join(checks.KEYWORDS[5][1]), "completion_certificate", 1.0, "keywords")]
    for name, text, kind, confidence, method in rows:
        c = spark.createDataFrame([(name, text)], "n string, t string").select(checks.document_class(F.col("n"), F.col("t")).alias("c")).first().c
        assert (c.kind, c.method) == (kind, method) and abs(c.confidence - confidence) < 1e-12


# periods


def walked(start, end, unit):
    out, day = [], start
    while day <= end:
        if unit in ("daily", "weekly"):
            first = day - timedelta(days=day.weekday() if unit == "weekly" else 0)
            last, nxt = first + timedelta(days=6 if unit == "weekly" else 0), day + timedelta(days=7 if unit == "weekly" else 1)
        else:
            size = {"monthly": 1, "quarterly": 3, "yearly": 12}[unit]
            month = (day.month - 1) // size * size + 1
            first, after = date(day.year, month, 1), date(day.year + (month + size > 12), (month + size - 1) % 12 + 1, 1)
            last = after - timedelta(days=1)
            nxt = date(day.year + 1, 1, 1) if unit == "yearly" else date(day.year + (day.month + size > 12), (day.month + size - 1) % 12 + 1, 1)
        label = {"daily": first.isoformat(), "weekly": f"W{first.isocalendar()[1]}-{first.year}", "monthly": first.strftime("%b %Y"), "quarterly": f"Q{(first.month - 1) // 3 + 1}-{first.year}", "yearly": str(first.year)}[unit]
        out.append((first, last, label))
        day = nxt
    return out


@pytest.mark.parametrize("unit", checks.UNITS)
def test_walks_over_periods(spark, unit):
    spans = [(date(2023, 12, 31), date(2024, 3, 1)), (date(2024, 2, 29), date(2025, 1, 2)), (date(2024, 11, 30), date(2024, 11, 30)), (date(2024, 1, 31), date(2026, 1, 30)), (date(2024, 5, 2), date(2024, 5, 1))]
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "k int, a date, b date").select("k", checks.period_walk(F.col("a"), F.col("b"), unit).alias("p")).collect()
    assert {r.k: [tuple(p) for p in r.p] for r in rows} == {i: walked(*s, unit) for i, s in enumerate(spans)}


# tables that change


def test_a_failed_write_leaves_the_old_slice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).selectExpr("id AS k", "0 AS version")
    state.reload_children(path, rows, "k")
    bad = rows.where("k < 9").selectExpr("k", "IF(k = 8, raise_error('broken'), 1) AS version").withColumn("version", F.col("version").cast("int"))
    with pytest.raises(Exception, match="broken"):
        state.reload_children(path, bad, "k")
    table = spark.read.parquet(path).drop("bucket")
    assert sorted(tuple(r) for r in table.select("k", "version").collect()) == [(i, 0) for i in range(40)]
    again = state.reload_children(path, rows.where("k < 9").withColumn("version", F.lit(1)), "k")
    assert sorted(tuple(r) for r in again.select("k", "version").collect()) == [(i, int(i < 9)) for i in range(40)]


def test_null_keys_and_repeated_rows_of_children(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    state.reload_children(path, make([(None, "a"), (1, "b"), (1, "b"), (2, None)]), "k")
    got = state.reload_children(path, make([(None, "c"), (None, "c")]), "k")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, "c"), (None, "c"), (1, "b"), (1, "b"), (2, None)], key=str)
    assert state.reload_children(path, make([]), "k").count() == 5


def test_a_replayed_stream_asks_the_provider_once(spark, tmp_path):
    asked = []
    schema = spark.createDataFrame([], "address string, lat double").schema

    def provider(misses):
        keys = sorted(r.address for r in misses.collect())
        asked.append(keys)
        return spark.createDataFrame([(k, float(len(k))) for k in keys if k != "lost"], schema)

    for number, addresses in enumerate((["a", "bb", "a"], ["bb", "ccc", "lost", None], ["a", "lost"])):
        spark.createDataFrame([(x,) for x in addresses], "address string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{number}"))
    path, log = str(tmp_path / "cache"), str(tmp_path / "log")
    fold = state.fold_cache(path, provider, "address", schema, log)

    def run(checkpoint):
        stream = spark.readStream.schema("address string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        stream.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run("first")
    assert sorted(map(tuple, state.latest(spark, path, schema).collect())) == [("a", 1.0), ("bb", 2.0), ("ccc", 3.0)]
    # all batches again: the same versions
    run("second")
    assert sorted(map(tuple, state.latest(spark, path, schema).collect())) == [("a", 1.0), ("bb", 2.0), ("ccc", 3.0)]
    assert state.versions(spark, path) == [0, 1, 2]
    answers, fetched = state.read_through(spark.createDataFrame([("a", 1), ("new", 2), (None, 3)], "address string, n int"), state.latest(spark, path, schema), provider, "address")
    assert sorted(((r.n, r.lat, r.hit) for r in answers.collect())) == [(1, 1.0, True), (2, 3.0, False), (3, None, None)]


def test_verifications_of_keys_that_did_not_arrive_stay(spark):
    history = spark.createDataFrame([(1, 1, "old", True), (2, 1, "old", True), (2, 0, "older", False), (None, 1, "none", True)], "k int, n int, s string, is_current boolean")
    new = spark.createDataFrame([(2, 5, "x"), (2, 9, "y"), (3, 1, "z"), (None, 0, "late")], "k int, n int, s string")
    got = {(r.k, r.n, r.is_current) for r in state.record_verifications(history, new, "k", ["n"]).collect()}
    assert got == {(1, 1, True), (2, 1, False), (2, 0, False), (None, 1, False), (2, 5, False), (2, 9, True), (3, 1, True), (None, 0, True)}


def test_one_of_equal_verifications_is_current(spark):
    history = spark.createDataFrame([], "k int, n int, s string, is_current boolean")
    new = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, 5, "x"), (1, 4, "y"), (1, 4, "y"), (2, None, None), (2, None, None), (None, 3, "z"), (None, 3, "z")], "k int, n int, s string")
    got = Counter((r.k, r.n, r.s, r.is_current) for r in state.record_verifications(history, new, "k", ["n"]).collect())
    assert got == {(1, 5, "x", True): 1, (1, 5, "x", False): 2, (1, 4, "y", False): 2, (2, None, None, True): 1, (2, None, None, False): 1, (None, 3, "z", True): 1, (None, 3, "z", False): 1}


def test_shipments_with_copies_and_nulls_as_verifications(spark, tmp_path):
    """Against the query's SQL: copies, equal days and nulls in every column, on either side of the day when the history ends."""
    rng = random.Random(4)
    pick = lambda *values: rng.choice([None, *values])
    rows = [(pick(*range(40)), pick(1, 2), pick("A", "N", "R"), pick(*(datetime(1995 + n // 3, 12, 29 + n % 3, 5) for n in range(6)))) for _ in range(1500)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    lineitem = duckdb.connect()
    lineitem.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert same(states.dml04_verifications(spark, str(tmp_path)), lineitem, states.ORACLE_SQL["dml04_verifications"]) == len(rows)


def test_audits_of_failed_runs(spark, tmp_path):
    path = str(tmp_path / "audit")
    state.audited(spark, path, "a", lambda: (3, 2, 1))
    with pytest.raises(ZeroDivisionError):
        state.audited(spark, path, "b", lambda: 1 // 0)
    state.audited(spark, path, "a", lambda: (4, 4, 0))
    rows = {r.run_id: (r.status, r.attempted, r.error) for r in state.audit_states(spark, path).collect()}
    assert rows["a"] == ("completed", 4, None) and rows["b"][0] == "failed" and "ZeroDivisionError" in rows["b"][2]


# texts


def noise(rng, n):
    return "".join(rng.choice(["a", "Bc", "12", " ", "  ", "\n", ".", "..", "!", "~", "^^", ":", "-", "é", "(", "₹", "x:y", "\t", "Key One: v1", "Key  Two - "]) for _ in range(n))


def test_artifacts_cuts_and_pairs_of_random_texts(spark):
    rng = random.Random(9)
    texts = [noise(rng, rng.randint(0, 40)) for _ in range(400)]

    def plain(text):
        text = re.sub(r"(?<!\S)[^\w\s,.\-/:;()₹$%@#&*]+(?!\S)", "", text)
        text = re.sub(r"([.,;:!?])\1+", r"\1", text)
        out = []
        for line in text.split("\n"):
            if len(line.strip()) > 2 or line.strip().isalnum():
                out.append(line)
            elif not line.strip():
                out.append("")
        return "\n".join(out)

    def cut(text, most=20):
        if len(text) <= most:
            return text
        head = text[:most]
        at = max(head.rfind("."), head.rfind("\n"))
        return (head[: at + 1] if at > most * 0.7 else head) + "\n\n[Text truncated...]"

    def pairs(text):
        out = {}
        for m in re.finditer(r"^([A-Za-z][A-Za-z\s]{2,30})\s*[:|-]\s*(.+)$", text, re.M):
            if len(m[2].strip()) > 1:
                out[re.sub(r"\s+", "_", m[1].strip().lower())] = m[2].strip()
        return out

    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in frame.select("k", cleaning.without_artifacts(F.col("t")).alias("a"), cleaning.truncated(F.col("t"), 20).alias("c"), cleaning.key_values(F.col("t")).alias("p")).collect():
        assert (r.a, r.c, r.p) == (plain(texts[r.k]), cut(texts[r.k]), pairs(texts[r.k])), texts[r.k]


def test_dates_of_random_texts(spark):
    rng = random.Random(10)
    number = lambda *sizes: "".join(str(rng.randint(0, 9)) for _ in range(rng.choice(sizes)))
    texts = [rng.choice(["", "on ", " "]) + rng.choice([f"{number(1, 2)}{x}{number(1, 2)}{x}{number(4)}" for x in "/-."] + [f"{number(4)}{x}{number(1, 2)}{x}{number(1, 2)}" for x in "/-"] + [f"{number(1, 2)} {rng.choice(['Jan', 'mar', 'SEPTEMBER', 'May', 'Jum'])} {number(4)}"]) + rng.choice(["", " end", "\n"]) for _ in range(600)]

    def plain(value):
        value = value.strip()
        found = re.search(r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})|(\d{4}-\d{2}-\d{2})", value)
        value = found[0] if found else value
        for form in ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%Y/%m/%d", "%m/%d/%Y"):
            try:
                day = datetime.strptime(value, form)
            except ValueError:
                continue
            return day.date() if day.year >= 100 else None
        return None

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", cleaning.any_date(F.col("t")).alias("d")).collect()
    wrong = [(texts[r.k], r.d, plain(texts[r.k])) for r in rows if r.d != plain(texts[r.k]) and not (r.d and r.d.year < 100)]
    assert not wrong


# parents


def test_slugs_of_new_parents(spark):
    parents = spark.createDataFrame([(1, "Sun", "a", "X", "sun"), (2, "Sun 1", "a", "X", "sun-1"), (3, "Old", "a", "UNKNOWN", "old")], "parent_id long, name string, address string, promoter string, slug string")
    projects = [(10, "Sun", "b", "X"), (11, "SUN ", "B", "x"), (12, "Sun", "c", "X"), (13, "Sun 2", "z", "X"), (14, " old", "A ", None), (15, None, "q", ""), (16, "सूर्य", "q", "X"), (17, "Moon", "q", "X"), (18, "moon!", "q", "X"), (19, "Moon 1", "q", "X"), (20, "Sun", "a", "x")]
    found, made = portal.with_parents(parents, spark.createDataFrame(projects, "project_id long, name string, address string, promoter string"), Workspace(spark, "t"))
    of = {r.project_id: r.parent_id for r in found.collect()}
    slugs = {r.parent_id: r.slug for r in made.collect()}
    assert of[10] == of[11] != of[12] and of[14] == 3 and of[20] == 1 and len(set(slugs.values())) == len(slugs)
    named = {p: slugs[of[p]] for p in of}
    assert named[10] == "sun-2" and named[12] == "sun-3" and named[13] == "sun-2-1" and named[17] == "moon" and named[18] == "moon-1" and named[19] == "moon-1-1"
    assert named[15].startswith("project-") and named[16].startswith("project-") and named[15] != named[16]
    again, same_ = portal.with_parents(made, spark.createDataFrame(projects, "project_id long, name string, address string, promoter string"), Workspace(spark, "t"))
    assert {r.project_id: r.parent_id for r in again.collect()} == of and same_.count() == made.count()


def test_score_reasons_of_any_kind(spark):
    texts = ['["a", null, "b"]', '{"x": 1}', '"one"', "5", "odd", "", "null", None, "[]", "[broken"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", cleaning.reasons(F.col("t")).alias("r")).collect()
    assert {r.k: r.r for r in rows} == {0: ["a", "b"], 1: ["x"], 2: ["one"], 3: ["5"], 4: ["odd"], 5: [], 6: [], 7: [], 8: [], 9: []}


@pytest.mark.parametrize("radius", [0.5, 50.0, 3000.0, 15000.0, 21000.0])
def test_pairs_within_a_radius_anywhere(spark, radius):
    import math

    rng = random.Random(12)
    spot = lambda: (rng.choice([90.0, -90.0, 89.999, 0.0, rng.uniform(-90, 90), rng.uniform(60, 61)]), rng.choice([180.0, -180.0, 179.999, 0.0, rng.uniform(-180, 180), rng.uniform(10, 11)]))
    a, b = [spot() for _ in range(120)], [spot() for _ in range(120)]

    def km(p, q):
        y, v = math.radians(p[0]), math.radians(q[0])
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))

    left = spark.createDataFrame([(i, *p, "clash") for i, p in enumerate(a)] + [(999, None, 1.0, "x")], "i int, lat double, lon double, band string")
    right = spark.createDataFrame([(j, *p) for j, p in enumerate(b)], "j int, lat double, lon double")
    got = [(r.i, r.j) for r in within_radius(left, right, radius).collect()]
    near = {(i, j): km(p, q) for i, p in enumerate(a) for j, q in enumerate(b)}
    assert len(got) == len(set(got))
    sure = 1e-9 * radius + 1e-6
    assert {k for k, d in near.items() if d <= radius - sure} <= set(got) <= {k for k, d in near.items() if d <= radius + sure}
