"""Rules on texts and records as DataFrame expressions; the checking SQL is written apart from them, not rendered from one statement.

A rule has a source, rows that both engines make from the tables, ``apply`` over any DataFrame with the source's columns,
and ``check``, SQL over a relation ``x`` of the source's rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.plans.operator import Operator


@dataclass(frozen=True)
class Rule:
    name: str
    ids: tuple[str, ...]
    source: str
    apply: Callable[[DataFrame], DataFrame]
    check: str

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.apply(Operator(self.name, self.ids, lambda d: self.source).query(spark, sf_dir))

    def oracle(self) -> str:
        return f"WITH x AS ({Operator(self.name, self.ids, lambda d: self.source).oracle()}) {self.check}"


# Words that scans misread, in the order in which they are put right.
CORRECTIONS = [
    ("Registratjon", "Registration"), ("Certiticate", "Certificate"), ("Certlficate", "Certificate"), ("Promotor", "Promoter"),
    ("Develeper", "Developer"), ("Distrlct", "District"), ("Ralpur", "Raipur"), ("Tehsll", "Tehsil"), ("Appllcation", "Application"),
    ("Proiect", "Project"), ("Valldity", "Validity"), ("Complction", "Completion"), ("Completlon", "Completion"), ("Sanctloned", "Sanctioned"),
    ("Bulldlng", "Building"), ("Resldential", "Residential"), ("Commerclal", "Commercial"), ("Rs,", "Rs."), ("Sq,Ft", "Sq.Ft"), ("Sq,ft", "Sq.ft"),
]
# Spellings of a status.
STATUSES = {
    "ongoing": "ongoing", "under construction": "ongoing", "in progress": "ongoing", "launched": "ongoing", "new launch": "ongoing",
    "completed": "completed", "ready to move": "completed", "possession": "completed", "delivered": "completed", "ready": "completed",
    "approved": "approved", "registered": "approved", "expired": "expired", "lapsed": "expired", "revoked": "revoked", "cancelled": "cancelled",
}
# Headers that begin a section.
HEADERS = r"REGISTRATION\s+CERTIFICATE|PROJECT\s+DETAILS?|PROMOTER\s+DETAILS?|LAND\s+DETAILS?|BUILDING\s+DETAILS?|BANK\s+DETAILS?|VALIDITY|TERMS?\s+AND\s+CONDITIONS?"
# Patterns of the kinds of document, in order.
KINDS = [
    ("registration_certificate", [r"registration\s*certificate", r"rera\s*certificate", r"project\s*registration"]),
    ("building_permission", [r"building\s*permission", r"construction\s*permit", r"sanctioned\s*(building\s*)?plan", r"building\s*approval"]),
    ("layout_plan", [r"layout\s*plan", r"site\s*plan", r"master\s*plan", r"sanctioned\s*layout"]),
    ("noc_fire", [r"fire\s*(safety\s*)?(no[c\-]?\s*objection|noc|clearance)", r"noc.*fire"]),
    ("noc_environment", [r"environment(al)?\s*(no[c\-]?\s*objection|noc|clearance)", r"noc.*environment"]),
    ("noc_pollution", [r"pollution\s*(control\s*)?(no[c\-]?\s*objection|noc|clearance)", r"noc.*pollution"]),
    ("noc_water", [r"water\s*(supply\s*)?(no[c\-]?\s*objection|noc|clearance)", r"noc.*water"]),
    ("cost_description", [r"cost\s*(description|estimate|sheet)", r"project\s*cost", r"financial\s*(plan|estimate)"]),
    ("agreement", [r"agreement", r"deed", r"mou", r"contract"]),
    ("affidavit", [r"affidavit", r"declaration", r"undertaking"]),
    ("ca_certificate", [r"ca\s*certificate", r"chartered\s*accountant", r"auditor.*certificate"]),
    ("engineer_certificate", [r"engineer\s*certificate", r"structural.*certificate"]),
    ("quarterly_report", [r"quarterly\s*(progress\s*)?report", r"qpr", r"progress\s*report"]),
    ("bank_passbook", [r"bank\s*(account\s*)?passbook", r"account\s*statement"]),
    ("search_report", [r"search\s*report", r"title\s*search"]),
    ("encumbrance_certificate", [r"encumbrance", r"non[-\s]?encumbrance"]),
    ("development_plan", [r"development\s*(work\s*)?plan", r"development\s*permission"]),
    ("project_specification", [r"project\s*specification", r"technical\s*specification"]),
]
# Dates in texts.
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATES = [r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", rf"\b\d{{1,2}}\s+{MONTHS}\s+\d{{4}}\b", rf"\b{MONTHS}\s+\d{{1,2}},?\s+\d{{4}}\b"]
# Areas in texts, with their units.
AREAS = [
    (r"([\d,]+\.?\d*)\s*(?:sq\.?\s*(?:ft|feet))", "sq_ft"), (r"([\d,]+\.?\d*)\s*(?:square\s+feet)", "sq_ft"), (r"([\d,]+\.?\d*)\s*(?:sq\.?\s*(?:m|meter|metre))", "sq_m"),
    (r"([\d,]+\.?\d*)\s*(?:square\s+meter)", "sq_m"), (r"([\d,]+\.?\d*)\s*(?:acres?)", "acres"), (r"([\d,]+\.?\d*)\s*(?:hectares?)", "hectares"),
]


def corrected(text: Column) -> Column:
    for wrong, right in CORRECTIONS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def corrections_made(text: Column) -> Column:
    """The misread words that were put right, in the list's order. One correction can make way for none of the others."""
    return F.filter(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(f"{w}>{r}")) for w, r in CORRECTIONS)), lambda c: c.isNotNull())


def repaired(text: Column, pattern: str, wrong: str, right: str) -> Column:
    """Letters that stand for digits, put right inside what ``pattern`` matches."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.aggregate(found, text, lambda t, m: F.replace(t, m, F.translate(m, wrong, right)))


#: What counts as white space at a line's ends.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def spaced(text: Column) -> Column:
    """Runs of spaces become one, indents two spaces, lines of white space empty; of empty lines together the first two stay."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(f"^{WHITE}*$"), "").otherwise(F.regexp_replace(F.regexp_replace(x, " {2,}", " "), f"^{WHITE}+", "  ")))
    third = lambda x, i: (i > 1) & (x == "") & (F.get(lines, i - 1) == "") & (F.get(lines, i - 2) == "")
    return F.array_join(F.filter(lines, lambda x, i: ~third(x, i)), "\n")


def punctuated(text: Column) -> Column:
    for pattern, by in ((r"([.,;:!?])([A-Za-z])", "$1 $2"), (r"\s+([.,;:!?])", "$1"), (r":\s*(?=\S)", ": "), (r"\(\s+", "("), (r"\s+\)", ")")):
        text = F.regexp_replace(text, pattern, by)
    return text


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, no, title, content of every section; what stands before the first header is HEADER. Empty sections are left out."""
    parts = F.split(F.regexp_replace(F.col(text), rf"(?im)^({HEADERS})", "\u0001$1\u0002"), "\u0001")
    rows = docs.select(key, F.posexplode(parts).alias("no", "part"))
    headed = F.contains("part", F.lit("\u0002"))
    title = F.when(headed, F.upper(F.trim(F.split_part("part", F.lit("\u0002"), F.lit(1))))).otherwise("HEADER")
    content = F.when(headed, F.split_part("part", F.lit("\u0002"), F.lit(2))).otherwise(F.col("part"))
    return rows.select(key, F.col("no").cast("long").alias("no"), title.alias("title"), F.regexp_replace(content, r"^\s+|\s+$", "").alias("content")).where("content <> ''")


def all_dates(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in DATES)))))


def all_areas(text: Column) -> Column:
    """(value, unit) of every area, by pattern and then by place."""

    def of(pattern: str, unit: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1)), lambda v: F.concat(F.replace(v, F.lit(","), F.lit("")), F.lit(f" {unit}")))

    return F.flatten(F.array(*(of(p, u) for p, u in AREAS)))


def document_kind(name: Column, text: Column) -> Column:
    """struct(score, kind): 0.4 for each pattern in the file's name, 0.1 for each match in the text, 1 at most; the first of the best."""
    scores = []
    for order, (kind, patterns) in enumerate(KINDS):
        tenths = sum((F.when(F.lower(name).rlike(p), 4).otherwise(0) + F.regexp_count(F.lower(text), F.lit(p)) for p in patterns), F.lit(0))
        scores.append(F.struct(F.least(tenths, F.lit(10)).alias("tenths"), F.lit(-order).alias("minus"), F.lit(kind).alias("kind")))
    best = F.greatest(*scores)
    return F.when(best["tenths"] > 0, best)


def joined_url(base: Column, link: Column) -> Column:
    """A link that begins with ``..`` against its page; any other link, and one without a page, as it stands.

    The page's query and fragment don't count, the link's stay; dot segments anywhere in the path are resolved, and those beyond
    the root are dropped.
    """
    page = F.regexp_replace(F.coalesce(base, F.lit("")), "[?#].*$", "")
    site = F.regexp_extract(page, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", 0)
    folders = F.split(F.regexp_replace(F.substring(page, F.length(site) + 1, F.length(page)), "[^/]*$", ""), "/", -1)
    path = F.regexp_extract(link, "^[^?#]*", 0)
    steps = F.split(path, "/", -1)
    inner = F.filter(F.concat(F.slice(folders, F.lit(1), F.size(folders) - 1), steps), lambda x, i: (x != "") | (i == 0))
    # an empty last step is the slash at the end
    walked = F.aggregate(inner, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.array_append(done, x)))
    closing = F.element_at(steps, -1).isin("", ".", "..")
    joined = F.concat(F.array_join(walked, "/"), F.when(closing & (F.size(walked) > 0), "/").otherwise(""))
    rooted = F.when((site != "") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    whole = F.concat(site, rooted, F.substring(link, F.length(path) + 1, F.length(link)))
    return F.when(link.startswith("..") & (page != ""), whole).otherwise(link)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def any_day(text: Column) -> Column:
    return F.coalesce(*(F.try_to_date(text, f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")))


OCR = """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Certiticate of Proiect ' WHEN 1 THEN 'Promotor, Ralpur Distrlct ' WHEN 2 THEN 'Sq,ft and Rs, ' ELSE 'plain ' END
    || p_name || ' PCGRERA2506' || CAST(10 + p_partkey % 80 AS VARCHAR(3)) || 'OO1 Rs. 1O,OOO' AS text FROM {part}"""
LINES = """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'Intro  for' || chr(10) ELSE '' END || 'Project Details' || chr(10) || '     name:' || c_name || ' ,paid ( in full )' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10)
    || 'VALIDITY' || chr(10) || 'until  1' || CAST(c_custkey % 10 AS VARCHAR(2)) || '-03-2024 .See' || chr(10) || 'Bank detail' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' ' || c_mktsegment END AS text FROM {customer}"""
GAPS = """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN chr(10) || chr(10) || chr(10) WHEN 1 THEN '  ' || chr(9) || chr(10) WHEN 2 THEN chr(9) || 'tab' || chr(10) ELSE '' END || p_name || '   ' || p_type
    || CASE p_partkey % 7 WHEN 0 THEN chr(10) || chr(10) || chr(10) || chr(10) || chr(10) WHEN 1 THEN chr(10) || chr(9) || chr(10) || ' ' || chr(10) || chr(9) || chr(10) || chr(10) WHEN 2 THEN chr(10) || chr(10) ELSE chr(10) END || '      ' || p_brand
    || CASE p_partkey % 11 WHEN 0 THEN chr(10) || chr(10) || chr(10) || chr(10) WHEN 1 THEN '  ' || chr(10) || '  ' WHEN 2 THEN chr(10) ELSE '' END AS text FROM {part}"""
LINKS = """SELECT page_id AS k, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://example.org/a/b/' || CAST(page_id AS VARCHAR(12)) || '/view?x=/y/z' WHEN 2 THEN 'https://example.org' WHEN 3 THEN 'https://example.org/a/b/#f/g' ELSE 'https://example.org/a//b/c' END AS base,
    CASE page_id % 9 WHEN 0 THEN '../../docs/x.pdf' WHEN 1 THEN 'y.pdf' WHEN 2 THEN '../z.pdf?p=../q' WHEN 3 THEN 'https://other/z.pdf' WHEN 4 THEN '/root.pdf' WHEN 5 THEN './z.pdf' WHEN 6 THEN 'a/../z.pdf' WHEN 7 THEN '../w/./v/../u/' ELSE '../../../../..' END AS rel FROM {pages}"""
PDFS = """SELECT o_orderkey AS k, 'Dated ' || CAST(1 + o_orderkey % 28 AS VARCHAR(2)) || '/06/2024 and 12 March ' || CAST(2000 + o_orderkey % 25 AS VARCHAR(4)) || '. Plot of ' || CAST(o_orderkey % 90 AS VARCHAR(3)) || ',' || CAST(100 + o_orderkey % 900 AS VARCHAR(3))
    || ' sq. ft, ' || CAST(o_orderkey % 7 AS VARCHAR(2)) || '.5 acres. Rs. ' || CAST(10 + o_orderkey % 80 AS VARCHAR(3)) || CASE o_orderkey % 3 WHEN 0 THEN ' lakh' WHEN 1 THEN ' crore' ELSE ' only' END || ' paid in the year that follows. Approval No: CG-' || CAST(o_orderkey AS VARCHAR(12)) AS text FROM {orders}"""
#: Phrases of documents, and the number of the kind that each stands for.
PHRASES = [
    ("Registration  Certificate", 0), ("sanctioned building plan", 1), ("Construction Permit", 1), ("Site Plan", 2), ("fire safety clearance", 3), ("NOC from the fire brigade", 3), ("Environmental NOC", 4), ("pollution control clearance", 5),
    ("water supply noc", 6), ("Cost Sheet", 7), ("lease deed", 8), ("undertaking", 9), ("Chartered Accountant", 10), ("structural safety certificate", 11), ("QPR", 12), ("Bank Account Passbook", 13), ("title search", 14),
    ("development work plan", 16), ("technical specification", 17), ("scan 0001", None), ("nothing of note", None), ("", None), ("appendix", None),
]
_PHRASE = lambda at: f"CASE ({at}) % {len(PHRASES)} " + " ".join(f"WHEN {i} THEN '{phrase}'" for i, (phrase, _) in enumerate(PHRASES)) + " END"
SCANS = f"""SELECT o_orderkey AS k, {_PHRASE('o_orderkey')} || '.pdf' AS name, {_PHRASE('o_orderkey * 7 + 3')} || chr(10) || {_PHRASE('o_orderkey * 5 + 1')} || ', ' || chr(10) || {_PHRASE('o_orderkey * 5 + 1')} AS text FROM {{orders}}"""
DAYS = """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '2024-02-' || CAST(10 + o_orderkey % 20 AS VARCHAR(2)) WHEN 1 THEN CAST(10 + o_orderkey % 20 AS VARCHAR(2)) || '-02-2024' WHEN 2 THEN CAST(10 + o_orderkey % 20 AS VARCHAR(2)) || '/02/2024' WHEN 3 THEN 'soon' ELSE NULL END AS a,
    CASE o_orderkey % 7 WHEN 0 THEN '2024/02/20' WHEN 1 THEN '20-02-2024' ELSE '2024-02-15' END AS b FROM {orders}"""


def _dml04(x: DataFrame) -> DataFrame:
    # the old current record is closed, the latest verification becomes the current one
    latest = Window.partitionBy("k").orderBy(F.desc("day"), F.desc("id"))
    return x.withColumn("now", F.row_number().over(latest) == 1).groupBy("k").agg(F.count_if("now").alias("current"), F.count_if(F.col("was") & ~F.col("now")).alias("closed"), F.max(F.when(F.col("now"), F.col("id"))).alias("current_id"))


def _nst14(x: DataFrame) -> DataFrame:
    per = x.groupBy("k").agg(
        F.array_sort(F.collect_set(F.when(F.col("onsite"), F.col("kind")))).alias("onsite"),
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.struct(F.col("kind").alias("type"), F.col("n").alias("count"))))).alias("nearby"),
    )
    return per.select("k", F.to_json(F.struct(F.struct("onsite", "nearby").alias("amenities"), F.struct((F.size("nearby") > 0).alias("has_nearby")).alias("signals"))).alias("features"))


def _series(x: DataFrame) -> DataFrame:
    """Quarters in steps of three months from the first of ``start``'s month on: a last period that the walk doesn't reach is skipped."""
    ends = x.agg(F.add_months(F.min("day"), 0).alias("start"), F.max("day").alias("end"))
    walk = ends.select(F.explode(F.expr("sequence(start, start, interval 1 day) || filter(sequence(trunc(add_months(start, 3), 'MM'), date_add(end, 31), interval 3 month), d -> d <= end)")).alias("at"))
    periods = walk.select(F.trunc("at", "quarter").alias("period")).distinct()
    return x.withColumn("period", F.trunc("day", "quarter")).join(periods, "period").groupBy("period").agg(F.count(F.lit(1)).alias("n"))


RULES = [
    Rule("str26_ocr_corrections", ("STR26",), OCR,
         lambda x: x.select("k", repaired(repaired(corrected(F.col("text")), r"PCGRERA[0-9OlI]+", "OlI", "011"), r"Rs\. [0-9][0-9Oo,]*", "Oo", "00").alias("text"), F.array_join(corrections_made(F.col("text")), "|").alias("made")),
         "SELECT k, " + "".join("replace(" for _ in CORRECTIONS) + "head || translate(tail, 'O', '0')" + "".join(f", '{w}', '{r}')" for w, r in CORRECTIONS) + " AS text, concat_ws('|', "
         + ", ".join(f"CASE WHEN contains(head, '{w}') THEN '{w}>{r}' END" for w, r in CORRECTIONS) + ") AS made FROM (SELECT k, split_part(text, 'PCGRERA', 1) AS head, 'PCGRERA' || split_part(text, 'PCGRERA', 2) AS tail FROM x)"),
    Rule("str27_structure_spacing", ("STR27",), GAPS, lambda x: x.select("k", spaced(F.col("text")).alias("text")),
         # each line apart, and the count of blank lines since the last other one
         r""", l AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM x),
            b AS (SELECT *, trim(line, ' ' || chr(9)) = '' AS blank, max(CASE WHEN trim(line, ' ' || chr(9)) <> '' THEN i ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS last FROM l)
            SELECT k, string_agg(CASE WHEN blank THEN '' ELSE CASE WHEN ltrim(line, ' ' || chr(9)) <> line THEN '  ' ELSE '' END || regexp_replace(ltrim(line, ' ' || chr(9)), ' +', ' ', 'g') END, chr(10) ORDER BY i) AS text
            FROM b WHERE NOT blank OR i - last <= 2 GROUP BY k"""),
    Rule("str28_punctuation", ("STR28",), LINES, lambda x: x.select("k", punctuated(F.col("text")).alias("text")),
         r"SELECT k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([.,;:!?])([A-Za-z])', '\1 \2', 'g'), '\s+([.,;:!?])', '\1', 'g'), ':\s*(\S)', ': \1', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g') AS text FROM x"),
    Rule("str31_sections", ("STR31",), LINES, lambda x: sections(x, "k", "text").select("k", "title", F.length("content").cast("long").alias("n")),
         """SELECT k, 'HEADER' AS title, CAST(10 AS BIGINT) AS n FROM x WHERE k % 3 = 0
            UNION ALL SELECT k, 'PROJECT DETAILS', length(trim(split_part(split_part(text, 'Project Details' || chr(10), 2), chr(10) || chr(10), 1))) FROM x
            UNION ALL SELECT k, 'VALIDITY', length(split_part(split_part(text, 'VALIDITY' || chr(10), 2), chr(10) || 'Bank', 1)) FROM x
            UNION ALL SELECT k, 'BANK DETAIL', length(split_part(text, 'Bank detail ', 2)) FROM x WHERE k % 5 <> 0"""),
    Rule("str32_cleaned_words", ("STR32",), LINES, lambda x: x.select("k", words(F.col("text")).alias("before"), words(punctuated(spaced(corrected(F.col("text"))))).alias("after")),
         r"""SELECT k, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS before, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
            '([.,;:!?])([A-Za-z])', '\1 \2', 'g'), '\s+([.,;:!?])', '\1', 'g'), ':\s*(\S)', ': \1', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\S+')) AS BIGINT) AS after FROM x"""),
    Rule("str33_dates_and_areas", ("STR33",), PDFS,
         lambda x: x.select("k", F.array_join(all_dates(F.col("text")), "|").alias("dates"), F.array_join(all_areas(F.col("text")), "|").alias("areas"), F.regexp_extract("text", r"(?i)(?:approval|license|permission|registration)\s*(?:no\.?|number)\s*:?\s*([A-Z0-9\-/]+)", 1).alias("reference")),
         """SELECT k, array_to_string(list_sort([CAST(1 + k % 28 AS VARCHAR) || '/06/2024', '12 March ' || CAST(2000 + k % 25 AS VARCHAR)]), '|') AS dates,
            CAST(k % 90 AS VARCHAR) || CAST(100 + k % 900 AS VARCHAR) || ' sq_ft|' || CAST(k % 7 AS VARCHAR) || '.5 acres' AS areas, 'CG-' || CAST(k AS VARCHAR) AS reference FROM x"""),
    Rule("str33_amounts", ("STR33",), PDFS,
         # the 20 characters to either side say whether it is lakh or crore
         lambda x: x.select("k", F.regexp_extract("text", r"(?i)Rs\.?\s*([\d,]+(?:\.\d{2})?)", 1).alias("raw"), F.lower(F.regexp_extract("text", r"(?i)(.{0,20}Rs\.?\s*[\d,]+(?:\.\d{2})?.{0,20})", 1)).alias("around"))
         .select("k", (F.replace("raw", F.lit(","), F.lit("")).cast("double") * F.when(F.contains("around", F.lit("crore")), 1e7).when(F.contains("around", F.lit("lakh")), 1e5).otherwise(1.0)).alias("amount")),
         "SELECT k, CAST((10 + k % 80) * CASE k % 3 WHEN 0 THEN 100000 WHEN 1 THEN 10000000 ELSE 1 END AS DOUBLE) AS amount FROM x"),
    Rule("str39_floor_plan_lines", ("STR39",), "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '10x1' || CAST(p_size AS VARCHAR(3)) WHEN 1 THEN 'Master Bedroom' WHEN 2 THEN 'Kitchen box' ELSE p_name END AS line FROM {part}",
         lambda x: x.select("k", F.when(F.lower("line").rlike("x") & F.col("line").rlike("[0-9]"), "potential_dim").when(F.lower("line").rlike("bedroom|kitchen|living"), "potential_room_name").alias("label")),
         "SELECT k, CASE WHEN instr(lower(line), 'x') > 0 AND len(regexp_extract_all(line, '[0-9]')) > 0 THEN 'potential_dim' WHEN lower(line) LIKE '%bedroom%' OR lower(line) LIKE '%kitchen%' OR lower(line) LIKE '%living%' THEN 'potential_room_name' END AS label FROM x"),
    Rule("str15_low_confidence", ("STR15",), "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS locality, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS district, CASE WHEN c_custkey % 5 = 0 THEN ',' ELSE 'CG' END AS state, 'India' AS country FROM {customer}",
         lambda x: x.select("k", *(F.when(F.trim(F.replace(c, F.lit(","), F.lit(" "))) != "", 1).otherwise(0).alias(c) for c in ("locality", "district", "state", "country")))
         .select("k", ((F.col("locality") + F.col("district") + F.col("state") + F.col("country") < 3) | (F.col("locality") * F.col("district") == 0)).alias("low_confidence")),
         "SELECT k, k % 3 = 0 OR k % 4 = 0 AS low_confidence FROM x"),
    Rule("str18_lower_status", ("STR18",), "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN ' Ready to Move' WHEN 1 THEN 'LAPSED' WHEN 2 THEN 'Mystery' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'registered ' END AS s FROM {orders}",
         lambda x: x.select("k", F.when(F.col("s") != "", F.coalesce(F.create_map(*(F.lit(v) for kv in STATUSES.items() for v in kv))[F.lower(F.trim("s"))], "s")).alias("status")),
         "SELECT k, CASE k % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'expired' WHEN 2 THEN 'Mystery' WHEN 5 THEN 'approved' END AS status FROM x"),
    Rule("str23_artifact_urls", ("STR23",), LINKS, lambda x: x.select("k", joined_url(F.col("base"), F.col("rel")).alias("url")),
         # where each page's folder and each link lead, by hand: folders a, b and the page's own
         """, f AS (SELECT k, base, rel, CASE k % 5 WHEN 1 THEN ['a', 'b', CAST(k AS VARCHAR)] WHEN 2 THEN [] WHEN 3 THEN ['a', 'b'] ELSE ['a', 'b'] END AS d FROM x),
            u AS (SELECT *, CASE k % 9 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 7 THEN 1 WHEN 8 THEN 5 END AS up, CASE k % 9 WHEN 0 THEN 'docs/x.pdf' WHEN 2 THEN 'z.pdf?p=../q' WHEN 7 THEN 'w/u/' WHEN 8 THEN '' END AS rest FROM f)
            SELECT k, CASE WHEN up IS NULL OR base IS NULL THEN rel ELSE 'https://example.org/' || array_to_string(list_concat(d[1:greatest(len(d) - up, 0)], [rest]), '/') END AS url FROM u"""),
    Rule("str42_first_filled", ("STR42",), """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE c_mktsegment END AS district, '{"project_details": {"district": "' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END || '"}}' AS raw FROM {customer}""",
         lambda x: x.select("k", first_filled(F.col("district"), F.get_json_object("raw", "$.project_details.district")).alias("district")),
         "SELECT k, CASE WHEN k % 3 = 2 THEN district WHEN k % 2 = 1 THEN json_extract_string(raw, '$.project_details.district') END AS district FROM x"),
    Rule("dt02_strict_iso", ("DT02",), DAYS, lambda x: x.select("k", F.when(F.col("a").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("a", "yyyy-MM-dd")).alias("day")),
         "SELECT k, CASE WHEN k % 5 = 0 THEN make_date(2024, 2, CAST(10 + k % 20 AS INTEGER)) END AS day FROM x"),
    Rule("dt10_schema_dates", ("DT10",), DAYS, lambda x: x.select("k", F.coalesce(F.date_format(F.when(F.col("a").rlike(r"^\d{2}[-/]\d{2}[-/]\d{4}$"), F.try_to_date(F.replace("a", F.lit("/"), F.lit("-")), "dd-MM-yyyy")), "yyyy-MM-dd"), "a").alias("day")),
         "SELECT k, CASE k % 5 WHEN 3 THEN 'soon' WHEN 4 THEN NULL ELSE '2024-02-' || CAST(10 + k % 20 AS VARCHAR) END AS day FROM x"),
    Rule("dt11_newer_date", ("DT11",), DAYS, lambda x: x.select("k", F.when(any_day(F.col("a")).isNull() | any_day(F.col("b")).isNull(), "unknown").when(any_day(F.col("b")) > any_day(F.col("a")), "b").otherwise("a").alias("newer")),
         "SELECT k, CASE WHEN k % 5 >= 3 THEN 'unknown' WHEN CASE WHEN k % 7 <= 1 THEN 20 ELSE 15 END > 10 + k % 20 THEN 'b' ELSE 'a' END AS newer FROM x"),
    Rule("dt08_date_consistency", ("DT08",), "SELECT l_orderkey AS k, CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate ELSE o_orderdate END AS DATE) AS approved, CAST(CASE WHEN l_linenumber % 3 = 0 THEN o_orderdate ELSE l_shipdate END AS DATE) AS proposed, CASE WHEN l_linenumber % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS extended FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey",
         lambda x: x.select(F.explode(F.filter(F.array(F.when(F.col("proposed") < F.col("approved"), "warning:proposed_end_date"), F.when(F.col("extended") < F.col("proposed"), "info:extended_end_date")), lambda f: f.isNotNull())).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")),
         "SELECT 'warning:proposed_end_date' AS flag, count(*) AS n FROM x WHERE proposed < approved HAVING count(*) > 0 UNION ALL SELECT 'info:extended_end_date', count(*) FROM x WHERE extended < proposed HAVING count(*) > 0"),
    Rule("dt06_period_walk", ("DT06",), "SELECT CAST(o_orderdate AS DATE) AS day FROM {orders}", _series,
         """, e AS (SELECT min(day) AS s, max(day) AS t FROM x),
            w AS (SELECT s AS p FROM e UNION ALL SELECT CAST(unnest(generate_series(date_trunc('month', s + INTERVAL 3 MONTH), CAST(t AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) FROM e)
            SELECT CAST(date_trunc('quarter', day) AS DATE) AS period, count(*) AS n FROM x WHERE CAST(date_trunc('quarter', day) AS DATE) IN (SELECT CAST(date_trunc('quarter', p) AS DATE) FROM w) GROUP BY 1"""),
    Rule("nst06_grid_legend", ("NST06",), "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'bg_llg' WHEN 1 THEN 'bg_lly' WHEN 2 THEN 'red' ELSE 'grey' END AS class, CASE WHEN l_orderkey % 2 = 0 THEN 'Unit SOLD out' END AS red_text FROM {lineitem}",
         lambda x: x.withColumn("legend", F.map_filter(F.map_concat(F.create_map(F.lit("bg_llg"), F.lit("Available"), F.lit("bg_lly"), F.lit("Booked")), F.create_map(F.lit("red"), F.when(F.lower("red_text").rlike("available"), "Available").when(F.lower("red_text").rlike("booked|sold"), "Booked"))), lambda _, v: v.isNotNull()))
         .select("k", "n", F.coalesce(F.col("legend")[F.col("class")], F.lit("Unknown")).alias("status")),
         "SELECT k, n, CASE WHEN n % 4 = 0 THEN 'Available' WHEN n % 4 = 1 OR (n % 4 = 2 AND k % 2 = 0) THEN 'Booked' ELSE 'Unknown' END AS status FROM x"),
    Rule("nst07_merged_fields", ("NST07",), "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS field_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR(5)) END AS field_phone, c_mktsegment AS row_name FROM {customer}",
         # scraped fields go first, unless none of them says anything
         lambda x: x.withColumn("rows", F.array(F.col("row_name"))).withColumn("rows", F.when((F.coalesce("field_name", F.lit("")) != "") | (F.coalesce("field_phone", F.lit("")) != ""), F.concat(F.array(F.coalesce("field_name", F.lit(""))), "rows")).otherwise(F.col("rows")))
         .select("k", F.size("rows").cast("long").alias("n"), F.col("rows")[0].alias("first")),
         "SELECT k, CAST(CASE WHEN k % 6 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n, CASE WHEN k % 6 = 0 THEN row_name WHEN k % 3 = 0 THEN '' ELSE field_name END AS first FROM x"),
    Rule("nst10_reasons", ("NST10",), """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '["no data","no price"]' WHEN 1 THEN '{"a":"missing","b":"old"}' WHEN 2 THEN '"plain"' ELSE NULL END AS reason FROM {orders}""",
         lambda x: x.select("k", F.coalesce(F.array_join(F.from_json("reason", "array<string>"), ", "), F.array_join(F.map_values(F.from_json("reason", "map<string,string>")), ", "), F.regexp_replace("reason", '^"|"$', ""), F.lit("Missing amenity or location context data")).alias("reason")),
         "SELECT k, CASE k % 4 WHEN 0 THEN 'no data, no price' WHEN 1 THEN 'missing, old' WHEN 2 THEN 'plain' ELSE 'Missing amenity or location context data' END AS reason FROM x"),
    Rule("nst14_feature_pack", ("NST14",), "SELECT project_id AS k, amenity_type AS kind, coalesce(onsite_available, FALSE) AS onsite, CAST(max(nearby_count) AS BIGINT) AS n FROM {amenity_stats} GROUP BY project_id, amenity_type, coalesce(onsite_available, FALSE)", _nst14,
         """, o AS (SELECT k, coalesce(string_agg(DISTINCT '"' || kind || '"', ',' ORDER BY '"' || kind || '"') FILTER (WHERE onsite), '') AS s FROM x GROUP BY k),
            y AS (SELECT k, coalesce(string_agg('{"type":"' || kind || '","count":' || n || '}', ',' ORDER BY kind, n) FILTER (WHERE n > 0), '') AS s FROM (SELECT DISTINCT k, kind, n FROM x) GROUP BY k)
            SELECT k, '{"amenities":{"onsite":[' || o.s || '],"nearby":[' || y.s || ']},"signals":{"has_nearby":' || CASE WHEN y.s = '' THEN 'false' ELSE 'true' END || '}}' AS features FROM o JOIN y USING (k)"""),
    Rule("nst18_media_lists", ("NST18",), "SELECT l_orderkey AS k, l_partkey * 100 + l_suppkey AS id, CASE l_linenumber % 5 WHEN 0 THEN 'gallery' WHEN 1 THEN 'floorplan' WHEN 2 THEN 'masterplan' WHEN 3 THEN 'brochure' ELSE 'video' END AS kind, l_returnflag = 'A' AS is_primary, l_linenumber AS sort_order FROM {lineitem}",
         lambda x: x.groupBy("k").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == t, F.struct((~F.col("is_primary")).alias("p"), "sort_order", "id")))), lambda m: m["id"].cast("string")), ",").alias(f"{t}s") for t in ("gallery", "floorplan", "masterplan", "brochure", "video")), F.count(F.lit(1)).alias("total_count")),
         "SELECT k, " + ", ".join(f"coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY NOT is_primary, sort_order, id) FILTER (WHERE kind = '{t}'), '') AS {t}s" for t in ("gallery", "floorplan", "masterplan", "brochure", "video")) + ", count(*) AS total_count FROM x GROUP BY k"),
    Rule("nst19_vector_round_trip", ("NST19",), "SELECT vec_id AS k, embedding AS e FROM {embeddings}",
         lambda x: x.withColumn("back", F.from_json(F.to_json("e"), "array<float>")).select("k", F.size("back").cast("long").alias("n"), F.col("back").eqNullSafe(F.col("e").cast("array<float>")).alias("same")),
         "SELECT k, CAST(len(e) AS BIGINT) AS n, TRUE AS same FROM x"),
    Rule("scr15_document_kind", ("SCR15",), SCANS,
         lambda x: x.withColumn("best", document_kind(F.col("name"), F.col("text"))).select("k", F.coalesce("best.kind", F.lit("unknown")).alias("kind"), F.coalesce(F.col("best.tenths") / 10, F.lit(0.0)).alias("score")),
         # phrases (0 to 21) and the kind each stands for; a name's phrase counts 4, each of a text's 1
         f""", w AS (SELECT * FROM (VALUES {', '.join(f"({i}, {order})" for i, (_, order) in enumerate(PHRASES) if order is not None)}) t(phrase, kind)),
            p AS (SELECT k, k % {len(PHRASES)} AS phrase, 4 AS points FROM x UNION ALL SELECT k, (k * 7 + 3) % {len(PHRASES)}, 1 FROM x UNION ALL SELECT k, (k * 5 + 1) % {len(PHRASES)}, 1 FROM x UNION ALL SELECT k, (k * 5 + 1) % {len(PHRASES)}, 1 FROM x),
            s AS (SELECT k, w.kind, sum(points) AS n FROM p JOIN w ON w.phrase = p.phrase GROUP BY ALL),
            b AS (SELECT k, kind, n FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, kind) = 1)
            SELECT x.k, coalesce(CASE b.kind {' '.join(f"WHEN {i} THEN '{kind}'" for i, (kind, _) in enumerate(KINDS))} END, 'unknown') AS kind, coalesce(b.n / 10.0e0, 0) AS score FROM x LEFT JOIN b ON b.k = x.k"""),
    Rule("scr25_latest_audit", ("SCR25",), "SELECT project_id AS k, CASE WHEN project_id % 7 = 0 THEN NULL ELSE project_name END AS project_name, CASE WHEN project_id % 5 = 0 THEN NULL ELSE district END AS district, status FROM {projects}",
         lambda x: x.orderBy(F.desc("k")).limit(100).select("k", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).isNull().alias("missing")) for c in ("project_name", "district", "status")))).alias("f"))
         .groupBy("f.field").agg((100.0 * F.count_if("f.missing") / F.count(F.lit(1))).alias("null_pct"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("f.missing"), F.col("k")))).cast("array<string>"), ",").alias("failing")),
         """, y AS (SELECT * FROM x ORDER BY k DESC LIMIT 100), z AS (SELECT 'project_name' AS field, k, project_name IS NULL AS m FROM y UNION ALL SELECT 'district', k, district IS NULL FROM y UNION ALL SELECT 'status', k, status IS NULL FROM y)
            SELECT field, 100.0e0 * count(*) FILTER (WHERE m) / count(*) AS null_pct, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE m), '') AS failing FROM z GROUP BY field"""),
    Rule("dml04_current_flip", ("DML04",), "SELECT verification_id AS id, project_id AS k, verified_at AS day, is_current AS was FROM {verifications}", _dml04,
         """SELECT k, CAST(1 AS BIGINT) AS current, CAST(count(*) FILTER (WHERE was) - max(CAST(was AS INTEGER)) FILTER (WHERE id = c) AS BIGINT) AS closed, max(c) AS current_id
            FROM (SELECT *, first_value(id) OVER (PARTITION BY k ORDER BY day DESC, id DESC) AS c FROM x) GROUP BY k"""),
    Rule("dml07_slice_recompute", ("DML07",), "SELECT project_id AS k, amenity_type AS kind, coalesce(nearby_count, 0) AS n FROM {amenity_stats}",
         # projects of the slice get their fresh rows (here: one more each), the others keep theirs
         lambda x: x.join(x.where("k % 4 = 0").select("k").distinct(), "k", "left_anti").unionByName(x.where("k % 4 = 0").withColumn("n", F.col("n") + 1)).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("total")),
         "SELECT kind, count(*) AS rows, CAST(sum(n + CAST(k % 4 = 0 AS INTEGER)) AS BIGINT) AS total FROM x GROUP BY kind"),
    Rule("src11_map_elements", ("SRC11",), """SELECT s_suppkey AS k, '{"elements":[{"type":"node","id":' || CAST(s_suppkey AS VARCHAR(12)) || ',"lat":17.5,"lon":80.25,"tags":{"name":"A","addr:street":"S","addr:city":"C"}},'
            || '{"type":"way","id":7,"center":{"lat":1.5,"lon":2.5},"tags":{"operator":"' || s_name || '"}},{"type":"way","id":7,"lat":9,"lon":9},{"type":"node","id":8,"tags":{"name":"nowhere"}}]}' AS payload FROM {supplier}""",
         lambda x: x.select("k", F.posexplode(F.from_json("payload", "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>")["elements"]).alias("at", "e"))
         .select("k", "at", F.concat_ws("/", "e.type", "e.id").alias("place"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce(F.col("e.tags")["name"], F.col("e.tags")["operator"]).alias("name"),
                 F.when(F.col("e.tags").isNotNull(), F.concat_ws(", ", *(F.col("e.tags")[f"addr:{t}"] for t in ("housenumber", "street", "city", "state", "postcode")))).alias("address"))
         .where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("no", F.row_number().over(Window.partitionBy("k", "place").orderBy("at"))).where("no = 1").select("k", "place", "lat", "lon", "name", F.when(F.col("address") != "", F.col("address")).alias("address")),
         """SELECT k, 'node/' || CAST(k AS VARCHAR) AS place, 17.5e0 AS lat, 80.25e0 AS lon, 'A' AS name, 'S, C' AS address FROM x
            UNION ALL SELECT k, 'way/7', 1.5e0, 2.5e0, regexp_extract(payload, '"operator":"([^"]*)"', 1), NULL FROM x"""),
]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
