"""Lookups with fallbacks, numbers in texts, price snapshots, loads of document results, and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.geo import KM_PER_DEGREE
from cadastra.operators.records import Rule
from cadastra.operators.text_rules import spelled
from cadastra.plans.operator import Operator

#: Days that a cached place stays fresh, square feet of a square metre, the type of document that gives a project its date.
FRESH_DAYS, SQUARE_FEET, DATED_BY = 60, 10.764, "registration_certificate"


def fresh_places(places: DataFrame, kind: str, provider: str, at: tuple[float, float], radius_km: float, now: Column, days: int = FRESH_DAYS) -> DataFrame:
    """Cached places of a kind and provider that were seen in the last ``days``, come from a search at least as wide, and lie in the box around ``at``."""
    margin = radius_km / KM_PER_DEGREE
    seen = F.col("last_seen").cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    box = F.col("lat").between(at[0] - margin, at[0] + margin) & F.col("lon").between(at[1] - margin, at[1] + margin)
    return places.where((F.col("kind") == kind) & (F.col("provider") == provider) & (F.col("radius_km") >= radius_km) & seen & box)


def brochures(requests: DataFrame, documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``requests`` (request, project_id, document_id or null) with what is shown: source, id, path.

    The document asked for, else the artifact with its id, both of the project; else the project's first brochure among its documents, else among its
    artifacts; else nothing. ``documents``: id, project_id, kind, url; ``artifacts``: id, project_id, kind, file_path, source_url. Equal ids leave it to the path.
    """
    docs = documents.select(F.lit("document").alias("source"), "id", "project_id", "kind", F.col("url").alias("path"))
    arts = artifacts.select(F.lit("artifact").alias("source"), "id", "project_id", "kind", F.coalesce(F.nullif("file_path", F.lit("")), "source_url").alias("path"))
    both = docs.unionByName(arts)
    asked = requests.where("document_id <> 0").join(both.withColumnRenamed("id", "document_id"), ["project_id", "document_id"]).withColumn("id", F.col("document_id")).withColumn("rank", F.when(F.col("source") == "document", 1).otherwise(2))
    any_ = both.where(F.col("kind").ilike("%brochure%")).groupBy("project_id", "source").agg(F.min(F.struct("id", "path")).alias("b"))
    found = requests.join(any_, "project_id").select(*requests.columns, "source", F.col("b.id").alias("id"), F.col("b.path").alias("path"), F.when(F.col("source") == "document", 3).otherwise(4).alias("rank"))
    best = asked.select(*requests.columns, "source", "id", "path", "rank").unionByName(found).groupBy("request").agg(F.min(F.struct("rank", "id", "path", "source")).alias("f"))
    return requests.join(best, "request", "left").select(*requests.columns, "f.source", "f.id", "f.path")


def looked_up(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """``requests`` (request, identifier) with project_id: digits are an id; else the project with that registration number, else with it in any case (the smallest id).

    ``projects``: project_id, reg_no. Percent signs and underscores stand for themselves.
    """
    digits = F.col("identifier").rlike("^[0-9]+$")
    by_id = requests.where(digits).join(projects.select("project_id"), F.col("identifier").try_cast("long") == F.col("project_id")).select("request", "project_id", F.lit(1).alias("rank"))
    folded = requests.where(~digits).withColumn("low", F.lower("identifier")).join(projects.withColumn("low", F.lower("reg_no")), "low").select("request", "project_id", F.when(F.col("identifier") == F.col("reg_no"), 2).otherwise(3).alias("rank"))
    best = by_id.unionByName(folded).groupBy("request").agg(F.min(F.struct("rank", "project_id")).alias("f"))
    return requests.join(best, "request", "left").select(*requests.columns, F.col("f.project_id").alias("project_id"))


def whole_number(text: Column) -> Column:
    """All digits of a text as one number; its sign and its point are lost."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("long")


def number(text: Column) -> Column:
    """A number without its commas, else the first number in the text."""
    clean = F.replace(F.nullif(text, F.lit("")), F.lit(","), F.lit(""))
    return F.coalesce(clean.try_cast("double"), F.nullif(F.regexp_extract(clean, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double"))


def price_snapshots(units: DataFrame) -> DataFrame:
    """project_id, label, price, rate of the kinds of unit with a price: rupees a square foot of the best area there is, carpet before built-up before super built-up; 0 is none."""
    filled = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    area = F.coalesce(*map(filled, ("carpet_area", "built_up_area", "super_built_up_area")))
    return units.where(filled("price").isNotNull()).select("project_id", F.col("name").alias("label"), F.col("price").cast("double").alias("price"), (filled("price") / (area * SQUARE_FEET)).alias("rate"))


def load_results(projects: DataFrame, known: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extractions after a load (those of ``known`` stay as they are), and ``projects`` with the dates that certificates gave them.

    ``projects``: project_id, reg_no, approved_date; ``known``: project_id, filename, document_type, confidence, approval_date; ``results``: reg_no (in any case; exact first), seq, filename and the fields,
    with fallbacks type for document_type. A project's date is set only where it has none, by its first certificate whose date has ten characters and is one.
    """
    fields = F.struct("seq", "filename", F.coalesce(F.nullif("document_type", F.lit("")), F.col("type"), F.lit("unknown")).alias("document_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "approval_date")
    asked = results.where("filename <> ''").select(F.struct("reg_no", "seq", "filename").alias("request"), F.col("reg_no").alias("identifier"), fields.alias("f"))
    of = looked_up(asked.select("request", "identifier").distinct().where(~F.col("identifier").rlike("^[0-9]+$")), projects.select("project_id", "reg_no")).where("project_id IS NOT NULL").select("request", "project_id")
    rows = asked.join(of, "request").select("project_id", "f.*")
    fresh = rows.groupBy("project_id", "filename").agg(F.min(F.struct("seq", "document_type", "confidence", "approval_date")).alias("r")).select("project_id", "filename", "r.document_type", "r.confidence", "r.approval_date")
    added = fresh.join(known.select("project_id", "filename"), ["project_id", "filename"], "left_anti")
    day = F.when(F.length("approval_date") == 10, F.try_to_timestamp("approval_date", F.lit("yyyy-MM-dd")).cast("date"))
    dated = rows.where(F.col("document_type") == DATED_BY).withColumn("day", day).where("day IS NOT NULL").groupBy("project_id").agg(F.min_by("day", F.struct("seq", "filename")).alias("day"))
    updated = projects.join(dated, "project_id", "left").withColumn("approved_date", F.coalesce("approved_date", "day")).select(*projects.columns)
    return known.select("project_id", "filename", "document_type", "confidence", "approval_date").unionByName(added), updated


def batch_report(results: DataFrame, shown: int = 10, width: int = 50) -> DataFrame:
    """One row with the text of a report: totals, kinds of document by count (equals by name), and the first errors, cut short. ``results``: seq, filename, success, document_type, error."""
    totals = results.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("good"), F.count("error").alias("n_errors"))
    kinds = results.where("success AND document_type IS NOT NULL").groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))
    # one row a kind; and the first errors only
    kinds = kinds.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("document_type").alias("kind")))), lambda k: F.concat(F.lit("  "), k["kind"], F.lit(": "), (-k["less"]).cast("string"))).alias("kinds"))
    errors = results.where("error IS NOT NULL").orderBy("seq", "filename").limit(shown)
    errors = errors.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "filename", "error"))), lambda e: F.concat(F.lit("  "), e["filename"], F.lit(": "), F.left(e["error"], F.lit(width)))).alias("errors"))
    row = totals.withColumns({"kinds": kinds.scalar(), "errors": errors.scalar()})
    rate = F.when(F.col("total") > 0, F.format_string("%.1f%%", 100 * F.col("good") / F.col("total"))).otherwise("0.0%")
    more = F.when(F.col("n_errors") > shown, F.array(F.concat(F.lit("  ... and "), (F.col("n_errors") - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(head)), lines)).otherwise(F.array().cast("array<string>"))
    summary = F.array(F.lit("SUMMARY"), *(F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in (("Total", F.col("total")), ("Successful", F.col("good")), ("Failed", F.col("total") - F.col("good")), ("Success Rate", rate))))
    return row.select(F.array_join(F.concat(summary, part("DOCUMENT TYPES", F.col("kinds")), part("ERRORS", F.concat(F.col("errors"), F.when(F.size("errors") > 0, more).otherwise(F.array().cast("array<string>"))))), "\n").alias("report"))


# queries

PLACES = """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'bank' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'map' END AS provider, CASE c_custkey % 5 WHEN 0 THEN 1.0e0 WHEN 1 THEN NULL ELSE 5.0e0 END AS radius_km, 21 + c_custkey % 40 / 200.0e0 AS lat, 81 + c_custkey % 30 / 200.0e0 AS lon,
    CAST(CASE c_custkey % 7 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-04-02' WHEN 2 THEN '2024-04-01' ELSE '2024-05-20' END AS DATE) AS last_seen FROM {customer}"""
UNITS = """SELECT o_orderkey AS project_id, o_orderpriority AS name, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE o_totalprice END AS price, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 50 END AS carpet_area, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 60 END AS built_up_area, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE 75.5 END AS super_built_up_area FROM {orders}"""
BATCH = """SELECT o_orderkey AS seq, 'f' || o_orderkey || '.pdf' AS filename, o_orderkey % 5 <> 0 AS success, CASE o_orderkey % 4 WHEN 0 THEN 'plan' WHEN 1 THEN 'deed' WHEN 2 THEN NULL ELSE 'deed' END AS document_type, CASE WHEN o_orderkey % 5 = 0 THEN 'could not read ' || o_orderkey || ' because of ' || o_orderpriority || ' and so on and so on' END AS error FROM {orders}"""


def _frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Operator("lookup", (), lambda d: text).query(spark, sf_dir)


DOCS = "SELECT s_suppkey * 10 AS id, s_suppkey % 40 AS project_id, CASE s_suppkey % 4 WHEN 0 THEN 'Project BROCHURE' WHEN 1 THEN NULL ELSE 'deed' END AS kind, 'd' || s_suppkey AS url FROM {supplier}"
ARTS = "SELECT s_suppkey * 10 + 1 AS id, s_suppkey % 40 AS project_id, CASE WHEN s_suppkey % 3 = 0 THEN 'brochure_pdf' ELSE 'photo' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'a' || s_suppkey END AS file_path, 'u' || s_suppkey AS source_url FROM {supplier}"
ASKED = "SELECT c_custkey AS request, c_custkey % 45 AS project_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN (c_custkey % 45) * 10 WHEN 2 THEN (c_custkey % 45) * 10 + 1 ELSE 7 END AS document_id FROM {customer}"


def flt16_brochures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brochures(*(_frame(spark, sf_dir, t) for t in (ASKED, DOCS, ARTS)))


NAMES = "SELECT c_custkey AS request, CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR(12)) WHEN 1 THEN 'RG' || c_custkey WHEN 2 THEN 'rg' || c_custkey WHEN 3 THEN 'none' WHEN 4 THEN '' ELSE 'Rg' || c_custkey || '%' END AS identifier FROM {customer}"


def flt18_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looked_up(_frame(spark, sf_dir, NAMES), _frame(spark, sf_dir, "SELECT project_id, reg_no FROM {projects}"))


def dml14_loaded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every third order, some for numbers in small letters, some known already: extractions and dates of each project."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    number_ = k.cast("string")
    projects = orders.select(k.alias("project_id"), F.concat(F.lit("RG"), number_).alias("reg_no"), F.when(k % 2 == 0, F.lit("2001-01-01").cast("date")).alias("approved_date"))
    known = orders.where("o_orderkey % 9 = 0").select(k.alias("project_id"), F.lit("a.pdf").alias("filename"), F.lit("old").alias("document_type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("approval_date"))
    result = lambda seq, name, kind, other, day: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("filename"), kind.cast("string").alias("document_type"), other.cast("string").alias("type"), F.lit(None).cast("double").alias("confidence"), day.cast("string").alias("approval_date"))
    none = F.lit(None)
    results = orders.where("o_orderkey % 3 = 0").select(F.concat(F.when(k % 4 == 0, "rg").otherwise("RG"), number_).alias("reg_no"), F.explode(F.array(result(1, "a.pdf", F.lit(""), F.when(k % 5 > 0, "deed"), none), result(2, "b.pdf", F.lit(DATED_BY), none, F.when(k % 7 == 0, "2024-1-5").otherwise("2024-02-03")), result(3, "", F.lit("x"), none, none), result(4, "b.pdf", F.lit("again"), none, none))).alias("r")).select("reg_no", "r.*")
    extractions, dated = load_results(projects, known, results)
    per = extractions.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "filename", "document_type"))), ",").alias("files"))
    return dated.join(per, "project_id", "left").select("project_id", "approved_date", "files")


RULES = [
    Rule("flt11_cached_places", ("FLT11", "STM06"), PLACES, lambda x: fresh_places(x, "school", "map", (21.1, 81.07), 3.0, F.lit("2024-06-01").cast("timestamp")).select("k"),
         "SELECT k FROM x WHERE kind = 'school' AND provider = 'map' AND radius_km >= 3 AND last_seen >= DATE '2024-06-01' - 60 AND abs(lat - 21.1) <= 3 / 111.0e0 AND abs(lon - 81.07) <= 3 / 111.0e0"),
    spelled("mth07_whole_numbers", ("MTH07",), lambda x: whole_number(F.col("text")), [("12 units", "12"), ("-5", "5"), ("1,234.50", "123450"), ("none", None), ("", None), (None, None), ("3 of 4", "34"), ("007", "7"), ("99999999999999999999", None)]),
    spelled("mth07_numbers", ("MTH07",), lambda x: number(F.col("text")).cast("decimal(20,4)"), [("1,234.50", "1234.5000"), ("-5", "-5.0000"), ("area 12.5 sq", "12.5000"), ("none", None), ("", None), (None, None), ("1e3", "1000.0000"), ("a -7", "7.0000"), (" 8 ", "8.0000"), ("3..4", "3.0000")]),
    Rule("scr23_unit_prices", ("SCR23",), UNITS, lambda x: price_snapshots(x).select("project_id", "label", "price", F.round("rate", 6).alias("rate")),
         "SELECT project_id, name AS label, CAST(price AS DOUBLE) AS price, round(price / (coalesce(nullif(CAST(carpet_area AS DOUBLE), 0), nullif(CAST(built_up_area AS DOUBLE), 0), nullif(CAST(super_built_up_area AS DOUBLE), 0)) * 10.764e0), 6) AS rate FROM x WHERE price <> 0"),
    Rule("snk03_text_report", ("SNK03",), BATCH, batch_report,
         """, k AS (SELECT document_type AS d, count(*) AS n FROM x WHERE success AND document_type IS NOT NULL GROUP BY 1), e AS (SELECT * FROM x WHERE error IS NOT NULL ORDER BY seq LIMIT 10), s AS (SELECT count(*) AS t, count(*) FILTER (WHERE success) AS g, count(error) AS m FROM x)
            SELECT 'SUMMARY' || chr(10) || 'Total: ' || t || chr(10) || 'Successful: ' || g || chr(10) || 'Failed: ' || (t - g) || chr(10) || 'Success Rate: ' || printf('%.1f', 100.0e0 * g / t) || '%' || chr(10) || 'DOCUMENT TYPES' || chr(10) || (SELECT string_agg('  ' || d || ': ' || n, chr(10) ORDER BY n DESC, d) FROM k)
                   || chr(10) || 'ERRORS' || chr(10) || (SELECT string_agg('  ' || filename || ': ' || substr(error, 1, 50), chr(10) ORDER BY seq) FROM e) || CASE WHEN m > 10 THEN chr(10) || '  ... and ' || (m - 10) || ' more' ELSE '' END AS report FROM s"""),
]
QUERIES = {r.name: r.query for r in RULES} | {f.__name__: f for f in (flt16_brochures, flt18_lookups, dml14_loaded_results)}
_named = lambda **parts: "WITH " + ", ".join(f"{n} AS ({Operator(n, (), lambda d, t=t: t).oracle()})" for n, t in parts.items())
ORACLE_SQL = {r.name: r.oracle() for r in RULES} | {
    "flt16_brochures": _named(q=ASKED, d=DOCS, a=ARTS) + """,
        f AS (SELECT request, 1 AS r, 'document' AS source, d.id, url AS path FROM q JOIN d ON d.id = q.document_id AND d.project_id = q.project_id UNION ALL SELECT request, 2, 'artifact', a.id, CASE WHEN file_path = '' THEN source_url ELSE file_path END FROM q JOIN a ON a.id = q.document_id AND a.project_id = q.project_id
              UNION ALL SELECT request, 3, 'document', d.id, url FROM q JOIN d ON d.project_id = q.project_id AND d.kind ILIKE '%brochure%' UNION ALL SELECT request, 4, 'artifact', a.id, CASE WHEN file_path = '' THEN source_url ELSE file_path END FROM q JOIN a ON a.project_id = q.project_id AND a.kind ILIKE '%brochure%')
        SELECT q.request, q.project_id, q.document_id, f.source, f.id, f.path FROM q LEFT JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request ORDER BY r, id) = 1) f ON f.request = q.request""",
    "flt18_lookups": _named(q=NAMES) + """ SELECT request, identifier, CASE WHEN request % 6 < 3 THEN o_orderkey END AS project_id FROM q LEFT JOIN orders ON o_orderkey = request AND request % 6 < 3""",
    "dml14_loaded_results": """
        SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2001-01-01' WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN DATE '2024-02-03' END AS approved_date,
               CASE WHEN o_orderkey % 9 = 0 THEN 'a.pdf:old,b.pdf:registration_certificate' WHEN o_orderkey % 3 = 0 THEN 'a.pdf:' || CASE WHEN o_orderkey % 5 > 0 THEN 'deed' ELSE 'unknown' END || ',b.pdf:registration_certificate' END AS files FROM orders""",
}
