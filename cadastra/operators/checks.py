"""Rules on registry rows: addresses, document classes, messages, badges, comparisons, audits and periods, each with its own checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.records import Rule

# States by their codes, and spellings at the head of a district's and a tehsil's name, the first that fits.
STATES = {"CG": "Chhattisgarh"}
DISTRICT, TEHSIL = r"(?i)^(?:district|dist\.|dist |dist)[ .\-]*(.*)$", r"(?i)^(?:tahsildar|tahsil|tehsil|tah\.|tah)[ .\-]*(.*)$"
PARTS = ("address_line", "village_or_locality", "tehsil", "district", "state", "pincode", "country")


def cleaned(value: Column) -> Column:
    """Commas and white space as single spaces; nothing if nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(value, r"(?U)[,\s]+", " ")), F.lit(""))


def _led(value: Column, pattern: str, word: str) -> Column:
    value = cleaned(value)
    rest = F.regexp_extract(value, pattern, 1)
    return F.when(value.rlike(pattern), F.concat(F.lit(word), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))).otherwise(value)


def address(columns: dict[str, Column]) -> Column:
    """struct of normalized, used, missing, weak of an address's parts: those of ``PARTS`` and state_code; a part may be missing."""
    none = F.lit(None).cast("string")
    given = {p: columns.get(p, none) for p in (*PARTS, "state_code")}
    state = F.coalesce(cleaned(given["state"]), F.element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), F.coalesce(F.upper(given["state_code"]), F.lit(""))))
    values = {p: cleaned(given[p]) for p in PARTS} | {"tehsil": _led(given["tehsil"], TEHSIL, "Tehsil"), "district": _led(given["district"], DISTRICT, "District"), "state": state}
    used = F.array_compact(F.array(*(F.when(values[p].isNotNull(), p) for p in PARTS)))
    missing = F.array_compact(F.array(*(F.when(values[p].isNull(), p) for p in PARTS)))
    local = F.arrays_overlap(used, F.array(*map(F.lit, ("address_line", "village_or_locality", "tehsil"))))
    weak = (F.size(used) < 3) | ~(F.coalesce(local, F.lit(False)) & F.array_contains(used, "district"))
    return F.struct(F.concat_ws(", ", *(values[p] for p in PARTS)).alias("normalized"), used.alias("used"), missing.alias("missing"), weak.alias("weak"))


def geocoding_candidates(columns: dict[str, Column]) -> Column:
    """Addresses from the whole one down to the district's, each without one part more, those that differ, in order."""
    steps = [set(), {"address_line"}, {"address_line", "village_or_locality"}, {"address_line", "village_or_locality", "tehsil"}]
    texts = [address({p: c for p, c in columns.items() if p not in gone})["normalized"] for gone in steps]
    return F.filter(F.array_distinct(F.array(*texts)), lambda x: x != "")


# Patterns of file names and keywords of texts, by class of document in order.
NAME_PATTERNS = [
    ("registration_certificate", [r"reg.*cert", r"registration", r"rera.*cert"]),
    ("layout_plan", [r"layout", r"site.*plan", r"plot.*plan", r"master.*plan"]),
    ("sanctioned_plan", [r"sanction", r"approved.*plan", r"approval"]),
    ("bank_passbook", [r"passbook", r"bank.*account", r"account.*statement"]),
    ("encumbrance_certificate", [r"encumbrance", r"enc.*cert", r"enum", r"non.*enc"]),
    ("completion_certificate", [r"completion", r"occupancy", r"cc\d*", r"oc\d*"]),
    ("building_plan", [r"building.*plan", r"floor.*plan", r"elevation"]),
    ("noc_document", [r"noc", r"no.*objection", r"clearance"]),
    ("financial_statement", [r"financial", r"balance.*sheet", r"audit", r"accounts"]),
    ("land_document", [r"land.*doc", r"khasra", r"khatauni", r"registry", r"sale.*deed"]),
    ("fee_sheet", [r"fee.*sheet", r"feesheet", r"fee.*calc", r"payment"]),
]
KEYWORDS = [
    ("registration_certificate", ["registration certificate", "rera registration", "registered under", "registration number", "pcgrera", "certificate of registration", "validity period", "real estate regulatory authority", "hereby certifies"]),
    ("layout_plan", ["layout plan", "plot numbers", "road width", "open space", "green belt", "plot area", "total plots", "site plan", "proposed layout", "land use plan"]),
    ("sanctioned_plan", ["sanctioned plan", "approved plan", "sanction number", "development authority", "town planning", "nagar palika", "municipal corporation", "approved layout", "permission granted"]),
    ("bank_passbook", ["account number", "ifsc code", "bank name", "branch", "passbook", "current account", "savings account", "opening balance", "escrow account"]),
    ("encumbrance_certificate", ["encumbrance certificate", "non encumbrance", "free from encumbrance", "search report", "title clear", "no mortgage", "registrar office", "sub registrar"]),
    ("completion_certificate", ["completion certificate", "occupancy certificate", "building complete", "construction completed", "ready for occupation", "partial completion", "final completion"]),
    ("building_plan", ["building plan", "floor plan", "elevation", "section", "ground floor", "first floor", "staircase", "parking", "setback", "plinth level"]),
    ("noc_document", ["no objection certificate", "noc", "clearance certificate", "fire noc", "environment clearance", "pollution control", "airport authority", "highway authority"]),
    ("financial_statement", ["balance sheet", "profit and loss", "auditor report", "chartered accountant", "financial year", "assets and liabilities", "income statement", "audit report"]),
    ("land_document", ["sale deed", "registry", "khasra", "khatauni", "land record", "mutation", "diversion order", "land conversion", "revenue record"]),
    ("fee_sheet", ["fee calculation", "fee sheet", "registration fee", "processing fee", "application fee", "total fee", "payment details"]),
]


def document_class(name: Column, text: Column) -> Column:
    """struct of kind, confidence, method, keywords. A name that fits a pattern decides (0.9); else the class with the largest share of its keywords in the text, and a bonus for many; unknown without any."""
    named = F.coalesce(*(F.when(F.lower(name).rlike("|".join(patterns)), kind) for kind, patterns in NAME_PATTERNS))
    low = F.lower(text)
    scores = []
    for order, (kind, words) in enumerate(KEYWORDS):
        found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        n = F.size(found)
        score = F.when(n > 0, n / F.lit(float(len(words))) * 0.8 + F.least(n * F.lit(0.05), F.lit(0.2)))
        scores.append(F.when(n > 0, F.struct(score.alias("score"), F.lit(-order).alias("minus"), F.lit(kind).alias("kind"), found.alias("found"))))
    best = F.array_max(F.array(*scores))
    none = F.array().cast("array<string>")
    by_name = F.struct(named.alias("kind"), F.lit(0.9).alias("confidence"), F.lit("filename").alias("method"), none.alias("keywords"))
    by_text = F.struct(F.coalesce(best["kind"], F.lit("unknown")).alias("kind"), F.least(F.coalesce(best["score"], F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.lit("keywords").alias("method"), F.coalesce(best["found"], none).alias("keywords"))
    return F.when(named.isNotNull(), by_name).otherwise(by_text)


def project_messages(district: Column, status: Column, pincode: Column, land_areas: Column, total_area: Column) -> Column:
    """Messages on a project's document: what is missing, a pincode of digits that aren't six, areas that aren't positive."""
    digits = F.regexp_replace(F.coalesce(pincode, F.lit("")), r"\D", "")
    lands = F.filter(F.transform(F.coalesce(land_areas, F.array().cast("array<double>")), lambda a, i: F.when(a <= 0, F.concat(F.lit("Land detail "), (i + 1).cast("string"), F.lit(": land_area_sq_m should be a positive number.")))), lambda m: m.isNotNull())
    own = lambda when, text: F.array_compact(F.array(F.when(when, text)))
    missing = lambda c: c.isNull() | (c == "")
    return F.concat(
        own(missing(district), "Missing district in project details."), own(missing(status), "Missing project status in project details."),
        own((digits != "") & (F.length(digits) != 6), "Invalid pincode format (expected 6 digits)."), lands, own(total_area <= 0, "Project total_area_sq_m should be a positive number."),
    )


def provenance(texts: list[Column], lists: list[Column]) -> Column:
    """struct of filled, expected and confidence: filled texts and lists among all that are expected."""
    filled = sum((F.coalesce((t != "").cast("int"), F.lit(0)) for t in texts), F.lit(0)) + sum((F.coalesce((F.size(x) > 0).cast("int"), F.lit(0)) for x in lists), F.lit(0))
    expected = len(texts) + len(lists)
    return F.struct(filled.alias("filled"), F.lit(expected).alias("expected"), (filled / F.lit(float(expected))).alias("confidence"))


def _plain(value: Column) -> Column:
    return F.regexp_replace(value.cast("decimal(20,3)").cast("string"), r"\.?0+$", "")


def _grouped(value: Column) -> Column:
    return F.regexp_replace(F.format_number(value.cast("double"), 3), r"\.?0+$", "")


def anomalies(rate: Column, area: Column, unit: Column, total: Column) -> Column:
    """array<struct<field, severity, message>> of prices and areas that are out of the ordinary. The bounds."""
    low = F.lower(unit)
    said = unit.isNotNull() & (unit != "")
    one = lambda when, field, severity, message: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), message.alias("message")))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.array_compact(F.array(
        one(rate < 500, "price_per_sqft", "error", text("Unusually low price: ₹", _plain(rate), "/sqft")),
        one(rate > 50000, "price_per_sqft", "warning", text("Premium pricing: ₹", _grouped(rate), "/sqft")),
        one(said & F.contains(low, F.lit("1bhk")) & (area > 1500), "carpet_area", "warning", text("Large 1BHK: ", _plain(area), " sqft")),
        one(said & F.contains(low, F.lit("bhk")) & (area < 200), "carpet_area", "error", text("Unusually small: ", _plain(area), " sqft")),
        one(said & F.contains(low, F.lit("2bhk")) & (area > 3000), "carpet_area", "warning", text("Large 2BHK: ", _plain(area), " sqft")),
        one(total < 100000, "total_price", "error", text("Unusually low total: ₹", _grouped(total))),
    ))


# How a verification is shown, and the days before expiry that are warned of.
BADGES = {"verified": ("Verified", "#10B981", True), "pending": ("Pending", "#F59E0B", False), "revoked": ("Revoked", "#EF4444", False), "expired": ("Expired", "#EF4444", False), "not_found": ("Not Found", "#EF4444", False), "unknown": ("Not Verified", "#9CA3AF", False)}
SOON = 90


def trust_badge(status: Column, expiry: Column, discrepancies: Column, now: Column) -> Column:
    """struct of label, color, verified, days_left, has_warnings, warning; a null status is no verification at all."""
    shown = lambda i, other: F.coalesce(*(F.when(status == s, F.lit(v[i])) for s, v in BADGES.items()), F.when(status.isNull(), F.lit(BADGES["unknown"][i])), F.lit(other))
    there = status.isNotNull()
    left = F.when(there, F.floor((F.unix_micros(expiry.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(86_400_000_000.0)))
    warning = F.concat_ws("; ", F.when(left < 0, "RERA registration has expired").when(left < SOON, F.concat(F.lit("RERA registration expires in "), left.cast("string"), F.lit(" days"))), F.when(there & discrepancies, "Data discrepancies detected"))
    return F.struct(shown(0, "Unknown").alias("label"), shown(1, "#9CA3AF").alias("color"), shown(2, False).alias("verified"), left.cast("long").alias("days_left"), (warning != "").alias("has_warnings"), F.nullif(warning, F.lit("")).alias("warning"))


# Fields of the document that are held against the page.
COMPARED = ("registration_number", "project_name", "project_type", "project_status", "district", "tehsil", "project_address", "launch_date", "expected_completion_date")


def compared(rows: DataFrame, key: str, document: str, page: str, fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """key, field, json_value, html_value, status for each field: ``document`` and ``page`` are maps of fields to texts; white space and case don't count."""
    one = F.explode(F.array(*map(F.lit, fields)))
    pairs = rows.select(key, document, page, one.alias("field")).select(key, "field", F.element_at(document, F.col("field")).alias("j"), F.element_at(page, F.col("field")).alias("h"))
    flat = lambda c: F.btrim(F.regexp_replace(F.col(c), r"(?U)\s+", " "))
    j, h = flat("j"), flat("h")
    status = F.when(F.col("j").isNull(), "missing_in_json").when(F.col("h").isNull(), "missing_in_html").when((F.lower(j) == "preview") | (F.lower(h) == "preview"), "preview_unchecked").when(F.lower(j) != F.lower(h), "mismatch").otherwise("match")
    return pairs.select(key, "field", F.nullif(j, F.lit("")).alias("json_value"), F.nullif(h, F.lit("")).alias("html_value"), status.alias("status"))


# The states that a project may have.
STATUSES = ("Ongoing", "Completed", "Lapsed", "Revoked", "New", "Under Review")


def title(text: Column) -> Column:
    """Every run of letters with its first letter large and the others small."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")


def audit_issues(rows: DataFrame, key: str, today: Column) -> DataFrame:
    """key, kind, value, told: a row for each thing that is out of range, out of its list, out of date or badly written.

    ``rows``: latitude, longitude, status, proposed_end_date, district, state_code, pincode, full_address. Empty texts are as good as none.
    """
    c = {n: F.col(n) for n in ("latitude", "longitude", "status", "proposed_end_date", "district", "state_code", "pincode", "full_address")}
    text = lambda n: F.nullif(c[n], F.lit(""))
    issue = lambda when, kind, value, told: F.when(when, F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (F.lit(told) if isinstance(told, str) else told).alias("told")))
    trimmed = F.regexp_replace(text("pincode"), r"(?U)^\s+|\s+$", "")
    issues = F.array_compact(F.array(
        issue(~c["latitude"].between(-90, 90), "latitude", c["latitude"], "out_of_range"),
        issue(~c["longitude"].between(-180, 180), "longitude", c["longitude"], "out_of_range"),
        issue(~text("status").isin(*STATUSES) & ~title(text("status")).isin(*STATUSES), "status", c["status"], "invalid_enum"),
        issue(F.contains(F.lower(text("status")), F.lit("ongoing")) & (c["proposed_end_date"] < today), "proposed_end_date", c["proposed_end_date"], "ongoing_project_past_due"),
        issue(text("district") != title(text("district")), "district_case", c["district"], title(text("district"))),
        issue(text("state_code") != F.upper(text("state_code")), "state_code_case", c["state_code"], F.upper(text("state_code"))),
        issue(F.length(text("state_code")) != 2, "state_code_length", c["state_code"], F.concat(F.lit("length="), F.length(c["state_code"]).cast("string"), F.lit(", expected=2"))),
        issue(~trimmed.rlike(r"^\d{6}$"), "pincode_format", c["pincode"], "invalid_format"),
        issue(F.length(F.regexp_replace(text("full_address"), r"(?U)^\s+|\s+$", "")) < 10, "address_too_short", c["full_address"], "suspiciously_short"),
    ))
    return rows.select(key, F.explode(issues).alias("i")).select(key, "i.*")


def report_gate(nulls: DataFrame, low_confidence: float | Column, empty: float | Column, threshold: float) -> DataFrame:
    """failing (fields with their severity), action_required, reasons. ``nulls``: field, null_percent; rates in percent; a field fails above the threshold, and badly above 50."""
    failing = nulls.where(F.col("null_percent") > threshold * 100).select("field", "null_percent", F.when(F.col("null_percent") > 50, "high").otherwise("medium").alias("severity"))
    # one row a checked column
    all_ = failing.agg(F.array_sort(F.collect_list(F.struct("field", "null_percent", "severity"))).alias("failing"))
    rate = lambda x: F.lit(x) if isinstance(x, (int, float)) else x
    told = lambda what, x: F.when(rate(x) > 20, F.format_string(f"{what} rate (%.1f%%) exceeds 20%% threshold", rate(x).cast("double")))
    fields = F.when(F.size("failing") > 0, F.concat(F.size("failing").cast("string"), F.lit(" required fields exceed null threshold: "), F.array_join(F.transform("failing", lambda f: f["field"]), ", ")))
    reasons = F.array_compact(F.array(told("Low confidence", low_confidence), told("Empty explanation", empty), fields))
    return all_.withColumn("reasons", reasons).withColumn("action_required", F.size("reasons") > 0)


UNITS = ("daily", "weekly", "monthly", "quarterly", "yearly")
# Days of the time frames.
FRAMES = {"1M": 30, "3M": 90, "6M": 180, "1Y": 365, "2Y": 730, "5Y": 1825, "ALL": 3650}


def frame_start(frame: Column, today: Column) -> Column:
    days = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FRAMES.items() for x in kv)), frame), F.lit(FRAMES["1Y"]))
    return F.date_sub(today, days)


def period(day: Column, unit: str) -> Column:
    """struct of start, end, label of the day's period; weeks begin on Monday and carry the year of their first day."""
    part = {"weekly": "WEEK", "monthly": "MM", "quarterly": "QUARTER", "yearly": "YEAR"}.get(unit)
    start = F.trunc(day, part) if part else day
    months = {"monthly": 1, "quarterly": 3, "yearly": 12}.get(unit)
    end = F.date_sub(F.add_months(start, months), 1) if months else F.date_add(start, 6 if unit == "weekly" else 0)
    year = F.year(start).cast("string")
    label = {"daily": F.date_format(start, "yyyy-MM-dd"), "weekly": F.concat(F.lit("W"), F.weekofyear(start).cast("string"), F.lit("-"), year), "monthly": F.date_format(start, "MMM yyyy"), "quarterly": F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit("-"), year), "yearly": year}[unit]
    return F.struct(start.alias("start"), end.alias("end"), label.alias("label"))


def period_walk(start: Column, end: Column, unit: str) -> Column:
    """The periods that a walk from ``start`` meets up to ``end``; months and longer go on from the first of a month, so that the walk may end before the last period does."""
    if unit in ("daily", "weekly"):
        days = F.when(start <= end, F.sequence(start, end, F.expr(f"INTERVAL {1 if unit == 'daily' else 7} DAY")))
    else:
        step = {"monthly": 1, "quarterly": 3, "yearly": 12}[unit]
        second = F.add_months(F.trunc(start, "YEAR" if unit == "yearly" else "MM"), step)
        rest = F.when(second <= end, F.sequence(second, end, F.expr(f"INTERVAL {step} MONTH"))).otherwise(F.array().cast("array<date>"))
        days = F.when(start <= end, F.concat(F.array(start), rest))
    return F.transform(F.coalesce(days, F.array().cast("array<date>")), lambda d: period(d, unit))


def period_series(rows: DataFrame, day: str, start: Column, end: Column, unit: str) -> DataFrame:
    """label, start, end, n: rows in each period of the walk that has any."""
    walk = rows.sparkSession.range(1).select(F.explode(period_walk(start, end, unit)).alias("p")).select("p.*")
    counted = rows.groupBy(period(F.col(day), unit)["start"].alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return walk.join(counted, "start").select("label", "start", "end", "n")


# queries

PLACES = """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' , ' ELSE 'Plot ' || c_custkey || ',,  near  ' || c_mktsegment END AS address_line, CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_name END AS village_or_locality,
    CASE c_custkey % 6 WHEN 0 THEN 'Tah. Arang' WHEN 1 THEN 'TEHSIL - Durg' WHEN 2 THEN 'tahsil' WHEN 3 THEN NULL WHEN 4 THEN 'Abhanpur' ELSE 'Tahsildar Dhamtari' END AS tehsil,
    CASE c_custkey % 7 WHEN 0 THEN 'Dist. Raipur' WHEN 1 THEN 'district Durg' WHEN 2 THEN 'DIST-Bastar' WHEN 3 THEN NULL WHEN 4 THEN 'Korba' WHEN 5 THEN 'dist' ELSE 'Distant Town' END AS district,
    CASE c_custkey % 5 WHEN 0 THEN 'cg' WHEN 1 THEN 'MH' WHEN 2 THEN NULL ELSE 'CG' END AS state_code, CASE WHEN c_custkey % 8 = 0 THEN ' Goa ' END AS state, CASE WHEN c_custkey % 9 = 0 THEN '492 001' END AS pincode FROM {customer}"""


def _places(x: DataFrame) -> DataFrame:
    columns = {c: F.col(c) for c in x.columns if c != "k"}
    a = address(columns)
    return x.select("k", a["normalized"].alias("normalized"), F.array_join(a["used"], ",").alias("used"), F.array_join(a["missing"], ",").alias("missing"), a["weak"].alias("weak"), F.array_join(geocoding_candidates(columns), "|").alias("candidates"))


PLACES_CHECK = r"""
, p AS (SELECT k, CASE WHEN k % 4 > 1 THEN regexp_replace(replace(address_line, ',', ' '), '\s+', ' ', 'g') END AS a, nullif(village_or_locality, '') AS v,
          CASE k % 6 WHEN 0 THEN 'Tehsil Arang' WHEN 1 THEN 'Tehsil Durg' WHEN 2 THEN 'Tehsil' WHEN 4 THEN 'Abhanpur' WHEN 5 THEN 'Tehsil Dhamtari' END AS t,
          CASE k % 7 WHEN 0 THEN 'District Raipur' WHEN 1 THEN 'District Durg' WHEN 2 THEN 'District Bastar' WHEN 4 THEN 'Korba' WHEN 5 THEN 'District' WHEN 6 THEN 'District ant Town' END AS d,
          CASE WHEN k % 8 = 0 THEN 'Goa' WHEN k % 5 IN (0, 3, 4) THEN 'Chhattisgarh' END AS s, pincode AS n FROM x),
c AS (SELECT *, concat_ws(', ', a, v, t, d, s, n) AS c1, concat_ws(', ', v, t, d, s, n) AS c2, concat_ws(', ', t, d, s, n) AS c3, concat_ws(', ', d, s, n) AS c4,
        concat_ws(',', CASE WHEN a IS NOT NULL THEN 'address_line' END, CASE WHEN v IS NOT NULL THEN 'village_or_locality' END, CASE WHEN t IS NOT NULL THEN 'tehsil' END, CASE WHEN d IS NOT NULL THEN 'district' END, CASE WHEN s IS NOT NULL THEN 'state' END, CASE WHEN n IS NOT NULL THEN 'pincode' END) AS used FROM p)
SELECT k, c1 AS normalized, used, concat_ws(',', CASE WHEN a IS NULL THEN 'address_line' END, CASE WHEN v IS NULL THEN 'village_or_locality' END, CASE WHEN t IS NULL THEN 'tehsil' END, CASE WHEN d IS NULL THEN 'district' END, CASE WHEN s IS NULL THEN 'state' END, CASE WHEN n IS NULL THEN 'pincode' END, 'country') AS missing,
       len(string_split(used, ',')) < 3 OR d IS NULL OR (a IS NULL AND v IS NULL AND t IS NULL) AS weak,
       concat_ws('|', nullif(c1, ''), CASE WHEN c2 <> c1 THEN nullif(c2, '') END, CASE WHEN c3 <> c2 THEN nullif(c3, '') END, CASE WHEN c4 <> c3 THEN nullif(c4, '') END) AS candidates FROM c"""

#: Texts of documents with the class and the numbers of matched and of all keywords; names with their class.
TEXTS = [("This is a Registration Certificate issued by the Real Estate Regulatory Authority, registered under the act", "registration_certificate", 3, 9), ("Floor plan: ground floor, first floor, parking", "building_plan", 4, 10), ("NOC", "noc_document", 1, 8), ("sale deed and mutation", "land_document", 2, 9),
         ("balance sheet; layout plan", "financial_statement", 1, 8), ("nothing of note", "unknown", 0, 1), ("", "unknown", 0, 1), ("total fee, processing fee, application fee, fee sheet, registration fee", "fee_sheet", 5, 7), ("Passbook of branch X", "bank_passbook", 2, 9)]
FILES = [("RERA_certificate.pdf", "registration_certificate"), ("scan.pdf", None), ("approved plan.pdf", "sanctioned_plan"), ("oc12.pdf", "completion_certificate"), ("page.pdf", None), ("site-plan.pdf", "layout_plan"), ("fee calc.pdf", "fee_sheet")]
_PICK = lambda at, values: f"CASE ({at}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
CLASSES = f"SELECT o_orderkey AS k, {_PICK('o_orderkey', [n for n, _ in FILES])} AS name, {_PICK('o_orderkey * 5 + 2', [t[0] for t in TEXTS])} AS text FROM {{orders}}"
CLASSES_CHECK = f"""
, t AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{kind}', {n}, {of})" for i, (_, kind, n, of) in enumerate(TEXTS))}) v(i, kind, n, many)), f AS (SELECT * FROM (VALUES {', '.join(f"({i}, {'NULL' if kind is None else repr(kind)})" for i, (_, kind) in enumerate(FILES))}) v(i, kind))
SELECT k, coalesce(f.kind, t.kind) AS kind, CASE WHEN f.kind IS NOT NULL THEN 0.9e0 ELSE t.n / t.many * 0.8e0 + least(t.n * 0.05e0, 0.2e0) END AS confidence, CASE WHEN f.kind IS NULL THEN 'keywords' ELSE 'filename' END AS method, CASE WHEN f.kind IS NULL THEN CAST(t.n AS INTEGER) ELSE 0 END AS n
FROM x JOIN t ON t.i = (k * 5 + 2) % {len(TEXTS)} JOIN f ON f.i = k % {len(FILES)}"""

V1 = """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'D' END AS district, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE o_orderkey % 6 WHEN 0 THEN '49-2001' WHEN 1 THEN '4920' WHEN 2 THEN 'none' WHEN 3 THEN NULL ELSE '1234567' END AS pincode,
    CASE o_orderkey % 4 WHEN 0 THEN 0 ELSE 5 END AS l1, CASE o_orderkey % 3 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE 2 END AS l2, o_orderkey % 8 = 0 AS no_land, CASE o_orderkey % 9 WHEN 0 THEN -2 WHEN 1 THEN NULL ELSE 10 END AS total FROM {orders}"""


def _v1(x: DataFrame) -> DataFrame:
    lands = F.when(~F.col("no_land"), F.array(F.col("l1").cast("double"), F.col("l2").cast("double")))
    p = provenance([F.col("district"), F.col("status"), F.col("pincode")], [lands])
    return x.select("k", F.array_join(project_messages(F.col("district"), F.col("status"), F.col("pincode"), lands, F.col("total")), "|").alias("messages"), p["filled"].alias("filled"), p["confidence"].alias("confidence"))


V1_CHECK = """
SELECT k, concat_ws('|', CASE WHEN k % 5 < 2 THEN 'Missing district in project details.' END, CASE WHEN k % 7 = 0 THEN 'Missing project status in project details.' END, CASE WHEN k % 6 IN (1, 4, 5) THEN 'Invalid pincode format (expected 6 digits).' END,
         CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'Land detail 1: land_area_sq_m should be a positive number.' END, CASE WHEN k % 3 = 0 AND k % 8 <> 0 THEN 'Land detail 2: land_area_sq_m should be a positive number.' END, CASE WHEN k % 9 = 0 THEN 'Project total_area_sq_m should be a positive number.' END) AS messages,
       CAST((k % 5 >= 2)::INT + (k % 7 <> 0)::INT + (k % 6 <> 3)::INT + (k % 8 <> 0)::INT AS INTEGER) AS filled, ((k % 5 >= 2)::INT + (k % 7 <> 0)::INT + (k % 6 <> 3)::INT + (k % 8 <> 0)::INT) / 4.0e0 AS confidence FROM x"""

FLATS = """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 499.5 WHEN 1 THEN 1250000 WHEN 2 THEN NULL WHEN 3 THEN 500 WHEN 4 THEN 50000 ELSE 50001.25 END AS rate, CASE o_orderkey % 5 WHEN 0 THEN 150 WHEN 1 THEN 1600 WHEN 2 THEN 3500 WHEN 3 THEN NULL ELSE 200 END AS area,
    CASE o_orderkey % 7 WHEN 0 THEN '1BHK' WHEN 1 THEN 'Flat 2bhk' WHEN 2 THEN 'Shop' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE '21bhk' END AS unit, CASE o_orderkey % 4 WHEN 0 THEN 99999 WHEN 1 THEN 100000 WHEN 2 THEN NULL ELSE 1500 END AS total FROM {orders}"""
FLATS_CHECK = """
SELECT k, concat_ws('|', CASE k % 6 WHEN 0 THEN 'error Unusually low price: ₹499.5/sqft' WHEN 1 THEN 'warning Premium pricing: ₹1,250,000/sqft' WHEN 5 THEN 'warning Premium pricing: ₹50,001.25/sqft' END,
  CASE WHEN k % 7 IN (0, 5, 6) AND k % 5 IN (1, 2) THEN 'warning Large 1BHK: ' || CASE k % 5 WHEN 1 THEN '1600' ELSE '3500' END || ' sqft' END, CASE WHEN k % 7 IN (0, 1, 5, 6) AND k % 5 = 0 THEN 'error Unusually small: 150 sqft' END,
  CASE WHEN k % 7 = 1 AND k % 5 = 2 THEN 'warning Large 2BHK: 3500 sqft' END, CASE k % 4 WHEN 0 THEN 'error Unusually low total: ₹99,999' WHEN 3 THEN 'error Unusually low total: ₹1,500' END) AS told FROM x"""

BADGED = """SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'verified' WHEN 2 THEN 'pending' WHEN 3 THEN 'revoked' WHEN 4 THEN 'expired' WHEN 5 THEN 'not_found' WHEN 6 THEN 'unknown' ELSE 'other' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS expiry, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS off FROM {orders}"""
BADGED_CHECK = """
, d AS (SELECT *, CASE WHEN status IS NOT NULL THEN date_diff('day', DATE '1998-01-01', expiry) - 1 END AS days FROM x), w AS (SELECT *, nullif(concat_ws('; ', CASE WHEN days < 0 THEN 'RERA registration has expired' WHEN days < 90 THEN 'RERA registration expires in ' || days || ' days' END, CASE WHEN off AND status IS NOT NULL THEN 'Data discrepancies detected' END), '') AS warning FROM d)
SELECT k, CASE k % 8 WHEN 0 THEN 'Not Verified' WHEN 1 THEN 'Verified' WHEN 2 THEN 'Pending' WHEN 3 THEN 'Revoked' WHEN 4 THEN 'Expired' WHEN 5 THEN 'Not Found' WHEN 6 THEN 'Not Verified' ELSE 'Unknown' END AS label,
       CASE WHEN k % 8 = 1 THEN '#10B981' WHEN k % 8 = 2 THEN '#F59E0B' WHEN k % 8 IN (3, 4, 5) THEN '#EF4444' ELSE '#9CA3AF' END AS color, k % 8 = 1 AS verified, CAST(days AS BIGINT) AS days_left, warning IS NOT NULL AS has_warnings, warning FROM w"""

SIDES = """SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM {customer}"""


def _sides(x: DataFrame) -> DataFrame:
    none, k = F.lit(None).cast("string"), F.col("k")
    left = {"registration_number": F.when(k % 4 > 0, F.concat(F.lit("R "), k.cast("string"))), "project_name": F.col("name"), "district": F.when(k % 3 == 0, "Preview").otherwise(F.col("segment")), "tehsil": F.lit("  ")}
    right = {"registration_number": F.when(k % 5 > 0, F.concat(F.lit(" r\t "), k.cast("string"))), "project_name": F.when(k % 2 == 0, F.upper("name")).otherwise(F.lit("Other")), "district": F.col("segment"), "tehsil": F.lit("")}
    both = [F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("k"), side.get(f, none).alias("v")) for f in COMPARED)), lambda e: e["v"].isNotNull())) for side in (left, right)]
    return compared(x.select("k", both[0].alias("document"), both[1].alias("page")), "k", "document", "page")


SIDES_CHECK = """
, f AS (SELECT k, unnest(['registration_number', 'project_name', 'project_type', 'project_status', 'district', 'tehsil', 'project_address', 'launch_date', 'expected_completion_date']) AS field, name, segment FROM x)
SELECT k, field, CASE field WHEN 'registration_number' THEN CASE WHEN k % 4 > 0 THEN 'R ' || k END WHEN 'project_name' THEN name WHEN 'district' THEN CASE WHEN k % 3 = 0 THEN 'Preview' ELSE segment END END AS json_value,
       CASE field WHEN 'registration_number' THEN CASE WHEN k % 5 > 0 THEN 'r ' || k END WHEN 'project_name' THEN CASE WHEN k % 2 = 0 THEN upper(name) ELSE 'Other' END WHEN 'district' THEN segment END AS html_value,
       CASE field WHEN 'registration_number' THEN CASE WHEN k % 4 = 0 THEN 'missing_in_json' WHEN k % 5 = 0 THEN 'missing_in_html' ELSE 'match' END WHEN 'project_name' THEN CASE WHEN k % 2 = 0 THEN 'match' ELSE 'mismatch' END
         WHEN 'district' THEN CASE WHEN k % 3 = 0 THEN 'preview_unchecked' ELSE 'match' END WHEN 'tehsil' THEN 'match' ELSE 'missing_in_json' END AS status FROM f"""

AUDITED = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 90.5 WHEN 1 THEN -90.0 WHEN 2 THEN NULL ELSE 21 END AS latitude, CASE o_orderkey % 5 WHEN 0 THEN -180.25 ELSE 81.5 END AS longitude,
    CASE o_orderkey % 6 WHEN 0 THEN 'ONGOING' WHEN 1 THEN 'Ongoing' WHEN 2 THEN 'Halted' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'under review' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS proposed_end_date,
    CASE o_orderkey % 4 WHEN 0 THEN 'NAVA RAIPUR' WHEN 1 THEN 'Raipur' WHEN 2 THEN '' ELSE 'janjgir-champa' END AS district, CASE o_orderkey % 3 WHEN 0 THEN 'CG' WHEN 1 THEN 'cgh' ELSE NULL END AS state_code,
    CASE o_orderkey % 8 WHEN 0 THEN ' 492001 ' WHEN 1 THEN '49200' WHEN 2 THEN '' WHEN 3 THEN '49200a' ELSE '492001' END AS pincode, CASE o_orderkey % 9 WHEN 0 THEN '  short   ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'long enough to be one' END AS full_address FROM {orders}"""
AUDITED_CHECK = """
SELECT k, 'latitude' AS kind, '90.5' AS value, 'out_of_range' AS told FROM x WHERE k % 4 = 0 UNION ALL SELECT k, 'longitude', '-180.25', 'out_of_range' FROM x WHERE k % 5 = 0 UNION ALL SELECT k, 'status', 'Halted', 'invalid_enum' FROM x WHERE k % 6 = 2
UNION ALL SELECT k, 'proposed_end_date', CAST(proposed_end_date AS VARCHAR), 'ongoing_project_past_due' FROM x WHERE k % 6 < 2 AND proposed_end_date < DATE '1997-01-01'
UNION ALL SELECT k, 'district_case', district, CASE k % 4 WHEN 0 THEN 'Nava Raipur' ELSE 'Janjgir-Champa' END FROM x WHERE k % 4 IN (0, 3) UNION ALL SELECT k, 'state_code_case', 'cgh', 'CGH' FROM x WHERE k % 3 = 1 UNION ALL SELECT k, 'state_code_length', 'cgh', 'length=3, expected=2' FROM x WHERE k % 3 = 1
UNION ALL SELECT k, 'pincode_format', pincode, 'invalid_format' FROM x WHERE k % 8 IN (1, 3) UNION ALL SELECT k, 'address_too_short', full_address, 'suspiciously_short' FROM x WHERE k % 9 = 0"""

GATED = "SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS a, o_orderkey % 5 = 0 AS b, o_orderkey % 20 = 0 AS c, o_orderkey % 3 <> 0 AS d, o_orderkey % 4 = 0 AS low FROM {orders}"


def _gate(x: DataFrame) -> DataFrame:
    share = lambda c: F.round(100 * F.count_if(c) / F.count(F.lit(1)), 2)
    totals = x.agg(*(share(F.col(c)).alias(c) for c in ("a", "b", "c", "d")))
    nulls = totals.select(F.explode(F.array(*(F.struct(F.lit(f"field_{c}").alias("field"), F.col(c).alias("null_percent")) for c in ("a", "b", "c", "d")))).alias("n")).select("n.*")
    low = float(x.agg(share(F.col("low"))).first()[0])
    out = report_gate(nulls, low, 20.0, 0.10)
    return out.select(F.array_join(F.transform("failing", lambda f: F.concat_ws(":", f["field"], f["severity"])), ",").alias("failing"), "action_required", F.array_join("reasons", "; ").alias("reasons"))


GATED_CHECK = """
, s AS (SELECT round(100.0e0 * count(*) FILTER (WHERE a) / count(*), 2) AS a, round(100.0e0 * count(*) FILTER (WHERE b) / count(*), 2) AS b, round(100.0e0 * count(*) FILTER (WHERE c) / count(*), 2) AS c, round(100.0e0 * count(*) FILTER (WHERE d) / count(*), 2) AS d, round(100.0e0 * count(*) FILTER (WHERE low) / count(*), 2) AS low FROM x),
f AS (SELECT unnest(['field_a', 'field_b', 'field_c', 'field_d']) AS field, unnest([a, b, c, d]) AS pct FROM s), g AS (SELECT string_agg(field || ':' || CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END, ',' ORDER BY field) AS failing, string_agg(field, ', ' ORDER BY field) AS names, count(*) AS n FROM f WHERE pct > 10)
SELECT coalesce(failing, '') AS failing, n > 0 OR low > 20 AS action_required, concat_ws('; ', CASE WHEN low > 20 THEN printf('Low confidence rate (%.1f%%) exceeds 20%% threshold', low) END, CASE WHEN n > 0 THEN n || ' required fields exceed null threshold: ' || names END) AS reasons FROM g, s"""


def _periods(x: DataFrame) -> DataFrame:
    out: DataFrame | None = None
    for unit in UNITS:
        one = period_series(x, "day", F.lit("1995-02-10").cast("date"), F.lit("1998-07-02").cast("date"), unit).select(F.lit(unit).alias("unit"), "label", "start", "end", "n")
        out = one if out is None else out.unionByName(one)
    return out


PERIODS_CHECK = """
, s AS (SELECT 'daily' AS unit, CAST(unnest(generate_series(DATE '1995-02-10', DATE '1998-07-02', INTERVAL 1 DAY)) AS DATE) AS d UNION ALL SELECT 'weekly', CAST(unnest(generate_series(DATE '1995-02-10', DATE '1998-07-02', INTERVAL 7 DAY)) AS DATE)
  UNION ALL SELECT 'monthly', CAST(unnest(generate_series(DATE '1995-02-01', DATE '1998-07-02', INTERVAL 1 MONTH)) AS DATE) UNION ALL SELECT 'quarterly', CAST(unnest(generate_series(DATE '1995-02-01', DATE '1998-07-02', INTERVAL 3 MONTH)) AS DATE) UNION ALL SELECT 'yearly', CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-07-02', INTERVAL 1 YEAR)) AS DATE)),
b AS (SELECT unit, CASE unit WHEN 'daily' THEN d WHEN 'weekly' THEN CAST(date_trunc('week', d) AS DATE) WHEN 'monthly' THEN CAST(date_trunc('month', d) AS DATE) WHEN 'quarterly' THEN CAST(date_trunc('quarter', d) AS DATE) ELSE CAST(date_trunc('year', d) AS DATE) END AS "start" FROM s),
e AS (SELECT *, CASE unit WHEN 'daily' THEN "start" WHEN 'weekly' THEN "start" + 6 WHEN 'monthly' THEN CAST("start" + INTERVAL 1 MONTH AS DATE) - 1 WHEN 'quarterly' THEN CAST("start" + INTERVAL 3 MONTH AS DATE) - 1 ELSE CAST("start" + INTERVAL 1 YEAR AS DATE) - 1 END AS "end" FROM b)
SELECT unit, CASE unit WHEN 'daily' THEN strftime("start", '%Y-%m-%d') WHEN 'weekly' THEN 'W' || weekofyear("start") || '-' || year("start") WHEN 'monthly' THEN strftime("start", '%b %Y') WHEN 'quarterly' THEN 'Q' || quarter("start") || '-' || year("start") ELSE CAST(year("start") AS VARCHAR) END AS label, "start", "end", count(*) AS n
FROM e JOIN x ON x.day BETWEEN "start" AND "end" GROUP BY ALL"""

FRAMED = "SELECT CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 8 WHEN 0 THEN '1M' WHEN 1 THEN '3M' WHEN 2 THEN '6M' WHEN 3 THEN '1Y' WHEN 4 THEN '2Y' WHEN 5 THEN '5Y' WHEN 6 THEN 'ALL' ELSE 'none' END AS frame FROM {orders}"


def _frames(x: DataFrame) -> DataFrame:
    return x.where(F.col("day") >= frame_start(F.col("frame"), F.lit("1998-08-01").cast("date"))).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


def _last_requests(x: DataFrame, keep: int = 10_000, parts: int = 64) -> DataFrame:
    """The last requests of all, ranked in parts first: ``parts * keep`` rows meet in the last step."""
    latest = [F.desc("ts"), F.desc("event_id")]
    part = Window.partitionBy(F.pmod(F.xxhash64("event_id"), F.lit(parts))).orderBy(*latest)
    return x.withColumn("r", F.row_number().over(part)).where(F.col("r") <= keep).drop("r").orderBy(*latest).limit(keep)


RULES = [
    Rule("str14_address_parts", ("STR14", "STR15", "STR16"), PLACES, _places, PLACES_CHECK),
    Rule("scr14_document_class", ("SCR14",), CLASSES, lambda x: x.withColumn("c", document_class(F.col("name"), F.col("text"))).select("k", "c.kind", "c.confidence", "c.method", F.size("c.keywords").alias("n")), CLASSES_CHECK),
    Rule("scr08_project_messages", ("SCR08", "SCR09", "STR13"), V1, _v1, V1_CHECK),
    Rule("scr10_anomalies", ("SCR10",), FLATS, lambda x: x.select("k", F.array_join(F.transform(anomalies(*(F.col(c) for c in ("rate", "area", "unit", "total"))), lambda a: F.concat_ws(" ", a["severity"], a["message"])), "|").alias("told")), FLATS_CHECK),
    Rule("scr11_badges", ("SCR11", "DT07"), BADGED, lambda x: x.select("k", trust_badge(F.col("status"), F.col("expiry"), F.col("off"), F.lit("1998-01-01 06:00:00").cast("timestamp")).alias("b")).select("k", "b.*"), BADGED_CHECK),
    Rule("scr18_compared_fields", ("SCR18",), SIDES, _sides, SIDES_CHECK),
    Rule("scr19_20_audit_issues", ("SCR19", "SCR20", "DT09"), AUDITED, lambda x: audit_issues(x.withColumns({"latitude": F.col("latitude").cast("double"), "longitude": F.col("longitude").cast("double")}), "k", F.lit("1997-01-01").cast("date")), AUDITED_CHECK),
    Rule("scr21_action_required", ("SCR21",), GATED, _gate, GATED_CHECK),
    Rule("dt06_period_series", ("DT04", "DT05", "DT06", "STM09"), "SELECT CAST(o_orderdate AS DATE) AS day FROM {orders}", _periods, PERIODS_CHECK),
    Rule("dt03_frames", ("DT03",), FRAMED, _frames, "SELECT frame, count(*) AS n FROM x WHERE day >= DATE '1998-08-01' - CASE frame WHEN '1M' THEN 30 WHEN '3M' THEN 90 WHEN '6M' THEN 180 WHEN '2Y' THEN 730 WHEN '5Y' THEN 1825 WHEN 'ALL' THEN 3650 ELSE 365 END GROUP BY frame"),
    Rule("stm03_usage_log", ("STM03",), "SELECT event_id, client, endpoint, ts FROM {usage}", lambda x: _last_requests(x).select("event_id", "client", "endpoint"), "SELECT event_id, client, endpoint FROM x ORDER BY ts DESC, event_id DESC LIMIT 10000"),
]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
