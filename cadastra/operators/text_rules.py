"""Queries of the text rules: every rule meets a list of spellings with results worked out by hand, each as often as there are orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import cleaning as c
from cadastra.functions.conflict import object_of
from cadastra.operators import records
from cadastra.operators.records import Rule


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def spelled(name: str, ids: tuple[str, ...], rule: Callable[[DataFrame], Column], cases: list[tuple[str | None, ...]]) -> Rule:
    """A rule over one to three texts; the last of a case is its result."""
    n, width = len(cases), len(cases[0]) - 1
    pick = lambda i: "CASE " + " ".join(f"WHEN o_orderkey % {n} = {at} THEN {_literal(case[i])}" for at, case in enumerate(cases)) + " END"
    names = ["text", "second", "third"][:width]
    source = "SELECT o_orderkey AS k, " + ", ".join(f"CAST({pick(i)} AS VARCHAR(4000)) AS {column}" for i, column in enumerate(names)) + " FROM {orders}"
    check = f"SELECT k, CASE {' '.join(f'WHEN k % {n} = {at} THEN {_literal(case[-1])}' for at, case in enumerate(cases))} END AS result FROM x"
    return Rule(name, ids, source, lambda x: x.select("k", rule(x).cast("string").alias("result")), check)


def scan_fixed(text: Column) -> Column:
    """Misread words put right, and registration numbers in capitals."""
    text = records.corrected(text)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(c.RERA), F.lit(0)))
    return F.aggregate(found, text, lambda t, m: F.replace(t, m, F.upper(m)))


def cleaned_scan(text: Column) -> Column:
    """The whole chain: artifacts, misread words, spacing, punctuation, and every line's ends."""
    text = records.punctuated(records.spaced(scan_fixed(c.without_artifacts(text))))
    bare = F.regexp_replace(F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), "\n"), r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", F.concat(bare, F.lit("\n"))).otherwise(bare)


_joined = lambda column: F.array_join(column, "|")


def _entities(x: DataFrame) -> Column:
    e = c.entities(F.col("text"))
    return F.concat_ws("; ", *(F.array_join(e[f], "|") for f in ("rera_numbers", "dates", "amounts", "phones", "emails")))


def _validity(x: DataFrame) -> Column:
    return _joined(F.concat(c.registration_errors(F.col("text"), [F.col("second")], F.col("third"), F.lit(None).cast("string")), c.bank_errors(F.col("third"), F.col("text"), F.col("second"))))


LONG = "First. " + "x" * 60 + ". end of it all"
RULES = [
    spelled("str17_districts", ("STR17",), lambda x: c.canonical(F.col("text"), c.DISTRICTS), [("raipur", "Raipur"), ("  RAIPUR ", "Raipur"), ("janjgir-champa", "Janjgir-Champa"), ("new   delhi", "New Delhi"), ("", ""), (None, ""), ("o'brien", "O'Brien"), ("Korba", "Korba"), ("  ", ""), ("x1y", "X1Y")]),
    spelled("str17_statuses", ("STR17",), lambda x: c.canonical(F.col("text"), c.LABELS), [("on-going", "Ongoing"), ("On  Going", "Ongoing"), ("registration", "Registered"), ("COMPLETED", "Completed"), ("under review", "Under Review"), (None, ""), ("lapsed", "Lapsed")]),
    spelled("str17_types", ("STR17",), lambda x: c.canonical(F.col("text"), c.TYPES), [("mixed-use", "Mixed Use"), ("Residential & Commercial", "Residential and Commercial"), ("plotted", "Plotted"), ("commercial", "Commercial"), ("", ""), ("GROUP housing", "Group Housing")]),
    spelled("str18_types", ("STR18",), lambda x: c.listed(F.col("text"), c.PLAIN_TYPES), [(" Flats ", "residential"), ("Group Housing", "residential"), ("shop", "commercial"), ("Mixed Use", "mixed"), ("Villas", "villa"), ("integrated township", "township"), ("Other Kind", "Other Kind"), (" Odd ", " Odd "), ("", None), (None, None), ("plotted development", "plotted"), ("OFFICE", "commercial")]),
    spelled("str19_artifacts", ("STR19",), lambda x: c.keyword_class(F.col("text"), c.ARTIFACTS, "unknown"), [("registration_certificate", "legal"), ("platform", "legal"), ("fire_noc", "approvals"), ("layout approval", "approvals"), ("Building_Plan", "technical"), ("site photo", "media"), ("overview", "media"), ("x", "unknown"), ("sale DEED", "legal"), ("floor", "technical"), ("", "unknown")]),
    spelled("str19_media", ("STR19",), lambda x: c.keyword_class(F.col("text"), c.MEDIA, "other"), [("floor photo", "floor_plan"), ("video tour", "video"), ("pdf brochure", "brochure"), ("Gallery", "gallery"), ("deed", "other"), ("youtube", "video"), ("elevation", "gallery")]),
    spelled("str19_documents", ("STR19",), lambda x: c.keyword_class(F.col("text"), c.DOCUMENTS, "unknown"), [("building_completion", "building_plan"), ("completion", "completion_certificate"), ("Fire layout", "layout_plan"), ("land title", "land_title_deed"), ("photo", "site_photo"), ("brochure photo", "project_brochure"), ("airport", "airport_noc"), ("revenue", "revenue_document"), ("other", "unknown")]),
    spelled("str19_media_types", ("STR19",), lambda x: c.media_type(F.col("text"), F.col("second"), F.col("third")), [(None, None, "mp4", "gallery"), ("", "", "pdf", "gallery"), ("Floor", None, "pdf", "floorplan"), ("site map", "x", None, "masterplan"), ("x", None, "PDF", "brochure"), ("x", None, "MP4", "video"), ("360 view", None, None, "virtual_tour"), ("facade", None, None, "elevation"), ("x", "Amenities", None, "amenity"), ("x", "y", "z", "gallery"), (None, "amenities", None, "amenity"), ("x", None, "mp41", "gallery")]),
    spelled("str22_lakhs", ("STR22",), lambda x: c.lakhs(F.col("text").try_cast("decimal(20,2)")), [("5050000", "50.50 L"), ("10000000", "1.00 Cr"), ("9999000", "99.99 L"), ("0", "0.00 L"), (None, None), ("123456789", "12.35 Cr"), ("123400", "1.23 L")]),
    spelled("str22_ranges", ("STR22",), lambda x: c.price_range(F.col("text").try_cast("double"), F.col("second").try_cast("double")), [("2500000", "12500000", "₹25.00L - ₹1.25Cr"), ("99999", None, "From ₹99,999"), (None, "100000", "Up to ₹1.00L"), ("0", "0", None), (None, None, None), ("1500", "2000", "₹1,500 - ₹2,000"), ("0", "7500000", "Up to ₹75.00L"), ("10000000", "0", "From ₹1.00Cr")]),
    spelled("str24_cuts", ("STR24",), lambda x: c.truncated(F.col("text"), 70), [("short", "short"), (LONG, LONG[:68] + "\n\n[Text truncated...]"), ("a" * 71, "a" * 70 + "\n\n[Text truncated...]"), ("a." + "b" * 80, "a." + "b" * 68 + "\n\n[Text truncated...]"), ("x" * 60 + "\n" + "y" * 30, "x" * 60 + "\n" + "\n\n[Text truncated...]"), ("a" * 70, "a" * 70), (None, None), ("z" * 49 + "." + "q" * 40, "z" * 49 + "." + "q" * 20 + "\n\n[Text truncated...]"), ("z" * 50 + "." + "q" * 40, "z" * 50 + "." + "\n\n[Text truncated...]")]),
    spelled("str25_artifacts", ("STR25",), lambda x: c.without_artifacts(F.col("text")), [("good ~~ text", "good  text"), ("Wait....", "Wait."), ("a!!b??", "a!b?"), ("line one\n~\nab\n-.\nend of it", "line one\n\nab\nend of it"), ("ok\n\n\nfine text", "ok\n\n\nfine text"), ("x^y ^ z", "x^y  z"), ("12\n:;\nabc", "12\nabc"), ("", ""), (None, None), ("keep $ % @ these", "keep $ % @ these")]),
    spelled("str26_scans", ("STR26",), lambda x: scan_fixed(F.col("text")), [("Registratjon of pcgrera250601000001", "Registration of PCGRERA250601000001"), ("Rs, 100 Sq,ft", "Rs. 100 Sq.ft"), ("Ralpur Distrlct", "Raipur District"), ("PcGrera123456 and pcgrera123456", "PCGRERA123456 and PCGRERA123456"), ("pcgrera12345", "pcgrera12345"), ("plain", "plain"), (None, None), ("Promotor Promotor", "Promoter Promoter")]),
    spelled("str29_all_entities", ("STR29",), _entities, [("PCGRERA250601 on 01-02-2024, Rs. 5,000 and INR 7; call +91 9876543210 or a.b@c.co", "PCGRERA250601; 01-02-2024; Rs. 5,000|INR 7; +91 9876543210; a.b@c.co"), ("2024/05/06 and 5 March 2024 and 2024/05/06", "; 2024/05/06|5 March 2024; ; ; "), ("none", "; ; ; ; "), ("9876543210 9876543210 5876543210", "; ; ; 9876543210; "), ("₹ 12.50 x@y.z q@w.in", "; ; ₹ 12.50; ; q@w.in"), ("1 jan 2020 31 DECEMBER 1999", "; 1 jan 2020|31 DECEMBER 1999; ; ; ")]),
    spelled("str30_pairs", ("STR30",), lambda x: object_of(F.transform_values(c.key_values(F.col("text")), lambda _, v: F.concat(F.lit('"'), v, F.lit('"')))), [("Project Name: Sun Villa\nPlot No - 12\nX: y", '{"project_name":"Sun Villa","plot_no":"12"}'), ("Name: a1\nNAME : b2", '{"name":"b2"}'), ("Bank Name  |  SBI ", '{"bank_name":"SBI"}'), ("12: no\nno key", "{}"), ("", "{}"), ("Area: 5", "{}"), ("Total  Units: 55\nx", '{"total_units":"55"}')]),
    spelled("str32_chain", ("STR32",), lambda x: cleaned_scan(F.col("text")), [("Registratjon   No:12 ,see ( this ) ....", "Registration No: 12, see (this).\n"), ("  ~~ \n\n\n\n\nName:x y", "\n".join(["Name: x y"]) + "\n"), ("", ""), ("a b\n\n\n\n\nc d e", "a b\n\n\nc d e\n"), ("line .Next\n\tindented  text", "line. Next\nindented text\n"), ("pcgrera250601000001 .", "PCGRERA250601000001.\n")]),
    spelled("str36_registrations", ("STR36", "STR07"), lambda x: c.registration_number(F.col("text")), [("pcg rera-250601", "PCGRERA250601"), ("No. CGRERA1234567 dated", "CGRERA1234567"), ("CRERA123456", "CRERA123456"), ("xyz 1", "XYZ1"), ("", ""), (None, None), ("RERA12345", "RERA12345"), ("PCGRERA1234567890123", "PCGRERA123456789012")]),
    spelled("str36_ifsc", ("STR36",), lambda x: c.ifsc(F.col("text")), [("sbin 0001234", "SBIN0001234"), ("IFSC: HDFC0ABC123 ok", "HDFC0ABC123"), ("bad", "BAD"), ("", ""), (None, None), ("SBIN-000-1234", "SBIN0001234"), ("SBIN00012345", "SBIN0001234")]),
    spelled("str36_accounts", ("STR36",), lambda x: F.concat_ws("/", c.account_number(F.col("text")), c.account_type(F.col("second"))), [("12 34-56", "CURRENT a/c", "123456/Current Account"), ("1", "savings", "1/Savings Account"), ("1", "Escrow current", "1/Current Account"), ("1", "FD", "1/Fixed Deposit"), ("1", "Loan", "1/Loan"), (None, "escrow", "Escrow Account"), ("1 ", None, "1")]),
    spelled("dt01_dates_in_texts", ("DT01",), lambda x: c.any_date(F.col("text")), [("Dated 05/06/2024 here", "2024-06-05"), ("5-6-2024", "2024-06-05"), ("on 2024-06-05", "2024-06-05"), ("05.06.2024", "2024-06-05"), ("5 Jun 2024", "2024-06-05"), ("5 june 2024", "2024-06-05"), ("2024/06/05", None), ("12/25/2024", "2024-12-25"), ("31/02/2024", None), ("05/06/24", None), ("soon", None), ("", None), (None, None), (" 29-02-2024 ", "2024-02-29"), ("30-02-2023", None), ("5 Foo 2024", None)]),
    spelled("scr17_missing_fields", ("SCR17",), _validity, [("PCGRERA1", "2024", "Sun", ""), ("", "2024", "Sun", "Missing registration number|Missing bank name"), ("R", None, "Sun", "No dates found|Missing IFSC code"), ("R", "2024", None, "Missing both project and promoter name|Missing account number"), (None, "", "", "Missing registration number|No dates found|Missing both project and promoter name|Missing account number|Missing bank name|Missing IFSC code")]),
]

REASONED = """SELECT project_id AS k, score_status AS status, CASE project_id % 7 WHEN 0 THEN '["no map", "no onsite"]' WHEN 1 THEN '{"no map": 1, "few": 2}' WHEN 2 THEN '"plain"' WHEN 3 THEN NULL WHEN 4 THEN '[]' WHEN 5 THEN '["no onsite"]' ELSE 'odd' END AS reason FROM {scores}"""
RULES += [
    Rule("agg22_score_reasons", ("AGG22", "AGG31"), REASONED, lambda x: x.select(F.explode(c.reasons(F.col("reason"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(10),
         """, r AS (SELECT unnest(CASE k % 7 WHEN 0 THEN ['no map', 'no onsite'] WHEN 1 THEN ['no map', 'few'] WHEN 2 THEN ['plain'] WHEN 5 THEN ['no onsite'] WHEN 6 THEN ['odd'] ELSE [] END) AS reason FROM x) SELECT reason, count(*) AS n FROM r GROUP BY reason"""),
]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
