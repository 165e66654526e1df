"""Queries of what is found in texts: amounts, areas and dates with their surroundings, JSON in answers, units in tables, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import matches, salvage
from cadastra.operators.records import Rule

# Words of a table of units, and the words that name its columns, the first that fits a header counts.
LIST_WORDS, UNIT_WORDS = "brief detail", ("apartment", "flat", "plot", "unit")
COLUMNS = (("block", ("block",)), ("floor", ("floor",)), ("unit_no", ("flat", "unit", "shop", "plot")), ("type", ("type",)), ("carpet", ("carpet",)))


def units(docs: DataFrame, key: str = "project_id", tables: str = "tables") -> DataFrame:
    """key, unit_key, unit_no, block_name, floor_no, unit_type, carpet_area_sqm, table_key of every unit in the tables of units.

    ``tables``: array<struct<name, headers: array<string>, rows: array<array<string>>>>. A column is found by its header, the last
    that fits; a table without a unit column, and rows without a unit number, give nothing. Of units with one key, block and number
    or number alone, the last row stands, wherever it is; an area that is no number, and 0, is null.
    """
    t = docs.select(key, F.posexplode(tables).alias("t_no", "t"))
    name = F.lower("t.name")
    t = t.where(F.contains(name, F.lit(LIST_WORDS)) & name.rlike("|".join(UNIT_WORDS)))

    def kind(header: Column) -> Column:
        out = F.lit(None).cast("string")
        for column, words in reversed(COLUMNS):
            out = F.when(F.lower(header).rlike("|".join(words)), column).otherwise(out)
        return out

    kinds = F.transform("t.headers", kind)
    place = lambda column: F.size("kinds") - F.array_position(F.reverse("kinds"), column)
    has = lambda column: F.array_contains("kinds", column)
    rows = t.withColumn("kinds", kinds).where(has("unit_no")).select(key, "t_no", "kinds", F.col("t.name").alias("table_key"), F.posexplode("t.rows").alias("r_no", "row"))
    cell = lambda column: F.when(has(column), F.get("row", place(column).cast("int")))
    rows = rows.select(key, "t_no", "r_no", "table_key", *(cell(c).alias(c) for c, _ in COLUMNS)).where("unit_no <> ''")
    area = F.nullif(F.btrim("carpet").try_cast("double"), F.lit(0.0))
    unit = F.struct("unit_no", F.col("block").alias("block_name"), F.col("floor").alias("floor_no"), F.col("type").alias("unit_type"), area.alias("carpet_area_sqm"), "table_key")
    unit_key = F.concat(F.coalesce(F.concat(F.nullif("block", F.lit("")), F.lit("_")), F.lit("")), "unit_no")
    last = rows.groupBy(key, unit_key.alias("unit_key")).agg(F.max_by(unit, F.struct("t_no", "r_no")).alias("u"))
    return last.select(key, "unit_key", "u.*")


def merged_previews(old: Column, new: Column) -> Column:
    """Previews (map of key to struct<artifact_type, files, notes>) of two runs: a new type or new files override if they aren't empty, old notes stay if there are any; keys of either side stay."""
    filled = lambda a, b: F.when(a != "", a).otherwise(b)

    def one(_: Column, o: Column, n: Column) -> Column:
        both = F.struct(filled(n["artifact_type"], o["artifact_type"]).alias("artifact_type"), F.when(F.size(n["files"]) > 0, n["files"]).otherwise(o["files"]).alias("files"), filled(o["notes"], n["notes"]).alias("notes"))
        return F.when(o.isNull(), n).when(n.isNull(), o).otherwise(both)

    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_zip_with(old, new, one))


_PRICE = "CASE o_orderkey % 9 WHEN 0 THEN 'Rs. 1,2' || CAST(10 + o_orderkey % 80 AS VARCHAR(3)) || '.50' WHEN 1 THEN '₹ ' || CAST(o_orderkey % 50 AS VARCHAR(3)) WHEN 2 THEN 'INR 4,000' WHEN 3 THEN CAST(o_orderkey % 30 AS VARCHAR(3)) || ' crores' WHEN 4 THEN '12.25 Lakhs' WHEN 5 THEN 'rs7' WHEN 6 THEN '900 rupees' WHEN 7 THEN 'Rs ,' ELSE 'free' END"
SUMS = f"""SELECT o_orderkey AS k, 'Order of ' || o_orderpriority || ' total project cost is ' || {_PRICE} || CASE o_orderkey % 4 WHEN 0 THEN ' lakh' WHEN 1 THEN ', less some 20 letters, crore' WHEN 2 THEN ' crore' ELSE ' only' END || ' and then INR ' || CAST(o_orderkey % 70 AS VARCHAR(3)) || ' at last' AS text,
    {_PRICE} AS price, o_orderkey AS n FROM {{orders}}"""


def _sums(x: DataFrame) -> DataFrame:
    found = F.transform(matches.amounts(F.col("text")), lambda a: F.concat_ws(":", a["place"].cast("string"), a["raw"], a["amount"].cast("decimal(20,2)").cast("string")))
    return x.select("k", F.array_join(found, "|").alias("amounts"))


# the text ahead of the price, the price, what follows: where each pattern stands, and what is within 20 characters
SUMS_CHECK = r"""
, t AS (SELECT *, length(text) AS len, strpos(text, price) AS p0 FROM x),
w AS (SELECT k, text, price, unnest(generate_series(1, len)) AS i FROM t),
c AS (
  SELECT k, text, i, p, regexp_extract(substr(text, i), '(?i)^(?:' || e || ')', 0) AS raw, regexp_extract(substr(text, i), '(?i)^(?:' || e || ')', 1) AS num
  FROM w, (VALUES (1, '₹\s*([\d,]+(?:\.\d{2})?)'), (2, 'Rs\.?\s*([\d,]+(?:\.\d{2})?)'), (3, 'INR\s*([\d,]+(?:\.\d{2})?)'), (4, '([\d,]+(?:\.\d{2})?)\s*(?:rupees|lakhs?|crores?)')) v(p, e)),
d AS (SELECT * FROM c WHERE raw <> '' AND NOT (p = 4 AND regexp_matches(substr(text, i - 1, 1), '[\d,.]') AND i > 1) AND NOT (p = 4 AND i > 3 AND regexp_matches(substr(text, i - 3, 3), '[\d,]\.\d'))),
e AS (SELECT *, TRY_CAST(replace(num, ',', '') AS DOUBLE) AS v, lower(substr(text, greatest(i - 20, 1), i - greatest(i - 20, 1)) || raw || substr(text, i + length(raw), 20)) AS around FROM d)
SELECT x.k, coalesce(string_agg((i - 1) || ':' || raw || ':' || CAST(CAST(v * CASE WHEN contains(around, 'crore') THEN 10000000 WHEN contains(around, 'lakh') THEN 100000 ELSE 1 END AS DECIMAL(20, 2)) AS VARCHAR), '|' ORDER BY p, i), '') AS amounts
FROM x LEFT JOIN e ON e.k = x.k AND v IS NOT NULL GROUP BY x.k"""

PAPERS = """SELECT o_orderkey AS k, o_orderkey % 8 AS w, CASE o_orderkey % 8 WHEN 0 THEN 'Approval granted on 12/03/2024' WHEN 1 THEN '12/03/2024 was the day. Sanctioned 05-06-2023, valid till 5 June 2026' WHEN 2 THEN 'Seen 2024-01-02' WHEN 3 THEN 'Issued March 4, 2024 and expires 2030/01/01'
      WHEN 4 THEN 'valid until ' || '01/01/2031' ELSE 'No day' END || CASE o_orderkey % 3 WHEN 0 THEN '. The estimated cost is Rs. ' || CAST(10 + o_orderkey % 89 AS VARCHAR(3)) || ' lakh.' WHEN 1 THEN '. Fee Rs. 55.' ELSE '. total Rs 7,000.' END
    || ' Notes on the place and what stands around it, long enough that no word is near any more, so it goes on and on for a while. ' || CASE o_orderkey % 5 WHEN 0 THEN 'The plot area is 2.5 acres' WHEN 1 THEN 'land area 100 sq. m' WHEN 2 THEN 'a shed of 300 sq ft' WHEN 3 THEN 'Project area: 1,200 Sq.Ft.' ELSE 'Total 2 hectares' END
    || '. Approval No: CG-' || CAST(o_orderkey AS VARCHAR(12)) || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'Issued by: Town Council' || chr(10) || 'x' WHEN 1 THEN 'AUTHORITY : ' || o_orderstatus || ' Board' WHEN 2 THEN 'certified by The Clerk ' ELSE 'unsigned 5' END AS text FROM {orders}"""
PAPERS_CHECK = r"""
SELECT k, CASE w WHEN 0 THEN '12/03/2024' WHEN 1 THEN '05-06-2023' WHEN 3 THEN '2030/01/01' END AS approval_date,
       CASE w WHEN 1 THEN '5 June 2026' WHEN 3 THEN '2030/01/01' WHEN 4 THEN '01/01/2031' END AS validity_date,
       CASE k % 3 WHEN 0 THEN (10 + k % 89) * 100000.0e0 WHEN 2 THEN 7000.0e0 END AS total_cost,
       CASE k % 5 WHEN 0 THEN 2.5e0 * 43560 WHEN 1 THEN 100 * 10.764e0 WHEN 3 THEN 1200.0e0 WHEN 4 THEN 2 * 107639.0e0 END AS total_area_sqft, 'CG-' || k AS approval_number,
       CASE k % 4 WHEN 0 THEN 'Town Council' WHEN 1 THEN substr(split_part(text, 'AUTHORITY : ', 2), 1, 7) WHEN 2 THEN 'The Clerk' END AS authority FROM x"""

ANSWERS = """SELECT event_id AS k, event_id % 9 AS w, CASE event_id % 9 WHEN 0 THEN '{"score": ' || CAST(event_id % 100 AS VARCHAR(4)) || '}' WHEN 1 THEN 'Sure! {"score": ' || CAST(event_id % 100 AS VARCHAR(4)) || ', "a": {"b": [1, 2]}} Hope it helps' WHEN 2 THEN 'Here:' || chr(10) || '```json' || chr(10) || '[{"score": 5}, {}]' || chr(10) || '```'
    WHEN 3 THEN 'nothing' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN '{"score": 1} and {"score": 2}' WHEN 7 THEN '{broken' ELSE '```' || chr(10) || '{"score": "7", "risks": ["x", "y"]}' || chr(10) || '```' END AS text FROM {events}"""


def _answers(x: DataFrame) -> DataFrame:
    v = salvage.salvaged(F.col("text"))
    a = salvage.answer(F.col("text"))
    return x.select("k", F.to_json(v).alias("json"), F.try_variant_get(v, "$.score", "int").alias("score"), a["score"].alias("given"), a["explanation"].alias("explanation"), F.array_join(a["risks"], ",").alias("risks"))


ANSWERS_CHECK = """
SELECT k, CASE w WHEN 0 THEN '{"score":' || k % 100 || '}' WHEN 1 THEN '{"a":{"b":[1,2]},"score":' || k % 100 || '}' WHEN 2 THEN '[{"score":5},{}]' WHEN 8 THEN '{"risks":["x","y"],"score":"7"}' ELSE '{}' END AS json,
       CAST(CASE WHEN w IN (0, 1) THEN k % 100 WHEN w = 8 THEN 7 END AS INTEGER) AS score, CAST(CASE WHEN w = 0 THEN k % 100 WHEN w = 8 THEN 7 ELSE 0 END AS DOUBLE) AS given,
       CASE WHEN w IN (0, 8) THEN 'No explanation provided.' ELSE 'Failed to parse AI response.' END AS explanation, CASE WHEN w = 8 THEN 'x,y' ELSE '' END AS risks FROM x"""

TYPED = """SELECT project_id, project_type, CASE project_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"project_type": null}' WHEN 2 THEN '{"details": {"project_type": "' || project_type || '"}}' WHEN 3 THEN 'no json' ELSE '{"project_type": "' || project_type || '", "n": 1}' END AS raw FROM {projects}"""

CELLS = "SELECT l_orderkey AS project_id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INTEGER) AS q FROM {lineitem}"


def _tables(x: DataFrame) -> DataFrame:
    """A table for each project and rest of the part's number by 4, whose columns stand in another order each."""
    text = lambda c: F.col(c).cast("string")
    unit, block = F.concat(F.lit("U"), (F.col("p") % 5).cast("string")), F.when(F.col("s") % 3 == 0, F.lit("")).when(F.col("s") % 3 == 1, F.lit("A"))
    carpet = F.when(F.col("q") % 5 == 0, F.lit("n/a")).when(F.col("q") % 7 == 0, F.lit("0")).otherwise(text("q"))
    w = F.col("p") % 4
    row = F.when(w == 0, F.array(unit, block, text("n"), carpet)).when(w == 1, F.array(carpet, F.lit("x"), unit)).when(w == 2, F.array(F.lit("2BHK"), unit, F.lit("old"))).otherwise(F.array(unit))
    named = x.select("project_id", "n", w.cast("int").alias("w"), row.alias("row"))
    t = named.groupBy("project_id", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda r: r["row"]).alias("rows"))
    heads = F.when(F.col("w") == 0, F.array(F.lit("Flat No"), F.lit("Block Name"), F.lit("Floor"), F.lit("Carpet Area"))).when(F.col("w") == 1, F.array(F.lit("Carpet"), F.lit("Flat old"), F.lit("Shop/Unit type"))).when(F.col("w") == 2, F.array(F.lit("Type"), F.lit("Plot no"), F.lit("Note"))).otherwise(F.array(F.lit("Number")))
    name = F.when(F.col("w") == 2, "Brief Details of PLOTs").otherwise("brief detail of apartments")
    return t.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", name.alias("name"), heads.alias("headers"), "rows"))), lambda t: F.struct(t["name"].alias("name"), t["headers"].alias("headers"), t["rows"].alias("rows"))).alias("tables"))


def _units(x: DataFrame) -> DataFrame:
    return units(_tables(x)).drop("table_key")


UNITS_CHECK = """
, u AS (SELECT project_id, p % 4 AS w, n, 'U' || p % 5 AS unit_no, CASE WHEN p % 4 = 0 THEN CASE s % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' END END AS block_name, CASE WHEN p % 4 = 0 THEN CAST(n AS VARCHAR) END AS floor_no,
          CASE WHEN p % 4 = 2 THEN '2BHK' END AS unit_type, CASE WHEN p % 4 < 2 AND q % 5 <> 0 AND q % 7 <> 0 THEN CAST(q AS DOUBLE) END AS carpet_area_sqm FROM x WHERE p % 4 < 3)
SELECT project_id, CASE WHEN block_name <> '' THEN block_name || '_' ELSE '' END || unit_no AS unit_key, unit_no, block_name, floor_no, unit_type, carpet_area_sqm
FROM u QUALIFY row_number() OVER (PARTITION BY project_id, CASE WHEN block_name <> '' THEN block_name || '_' ELSE '' END || unit_no ORDER BY w DESC, n DESC) = 1"""

SHOTS = """SELECT s_suppkey AS k, s_suppkey % 4 AS a, s_suppkey % 3 AS b, s_suppkey % 5 AS c, s_name AS name FROM {supplier}"""


def _previews(x: DataFrame) -> DataFrame:
    kind = "map<string,struct<artifact_type:string,files:array<string>,notes:string>>"
    one = lambda t, files, notes: F.struct(t.alias("artifact_type"), files.alias("files"), notes.alias("notes"))
    none = F.array().cast("array<string>")
    old = F.when(F.col("a") > 0, F.create_map(F.lit("deed"), one(F.lit("pdf"), F.array("name"), F.when(F.col("b") == 0, F.lit("old")).otherwise(F.lit(""))), F.lit("gone"), one(F.lit("x"), none, F.lit(None).cast("string")))).cast(kind)
    new = F.when(F.col("c") > 0, F.create_map(F.lit("deed"), one(F.when(F.col("a") == 1, F.lit("html")), F.when(F.col("c") == 1, F.array(F.lit("n"))).otherwise(none), F.lit("new")), F.lit("plan"), one(F.lit("img"), none, F.lit("")))).cast(kind)
    rows = x.select("k", F.explode(merged_previews(old, new)).alias("key", "p"))
    return rows.select("k", "key", F.col("p.artifact_type").alias("artifact_type"), F.array_join("p.files", ",").alias("files"), F.col("p.notes").alias("notes"))


PREVIEWS_CHECK = """
SELECT k, 'deed' AS key, CASE WHEN a = 0 THEN NULL WHEN c > 0 AND a = 1 THEN 'html' ELSE 'pdf' END AS artifact_type, CASE WHEN c = 1 THEN 'n' WHEN a > 0 THEN name ELSE '' END AS files,
       CASE WHEN a > 0 AND b = 0 THEN 'old' WHEN c > 0 THEN 'new' ELSE '' END AS notes FROM x WHERE a > 0 OR c > 0
UNION ALL SELECT k, 'gone', 'x', '', NULL FROM x WHERE a > 0 UNION ALL SELECT k, 'plan', 'img', '', '' FROM x WHERE c > 0"""

RULES = [
    Rule("str33_amounts_around", ("STR33",), SUMS, _sums, SUMS_CHECK),
    Rule("str34_metadata", ("STR34",), PAPERS, lambda x: x.withColumn("m", matches.metadata(F.col("text"))).select("k", "m.*"), PAPERS_CHECK),
    Rule("str35_salvaged_json", ("STR35",), ANSWERS, _answers, ANSWERS_CHECK),
    Rule("flt05_type_at_path", ("FLT05", "NST01"), TYPED, lambda x: x.where(salvage.at_path(F.col("raw"), "$.project_type").isin("1-URGENT", "5-LOW")).select("project_id", "project_type"),
         "SELECT project_id, project_type FROM x WHERE project_id % 6 IN (4, 5) AND project_type IN ('1-URGENT', '5-LOW')"),
    Rule("nst05_units_in_tables", ("NST05",), CELLS, _units, UNITS_CHECK),
    Rule("nst12_merged_previews", ("NST12",), SHOTS, _previews, PREVIEWS_CHECK),
]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
