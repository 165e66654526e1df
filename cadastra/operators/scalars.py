"""Queries that apply the scalar rules to columns of the tables."""

from __future__ import annotations

from cadastra.functions import text as t
from cadastra.plans.operator import Operator

MEDIA = [("image", ("ring", "small")), ("plan", ("widget",)), ("video", ("large", "blue")), ("document", ("gear", "red"))]
#: Texts made of the tables' numbers, in the spellings that the rules must read.
AREAS = "(SELECT p_partkey AS k, CAST(p_size AS VARCHAR(9)) || CASE p_partkey % 7 WHEN 0 THEN ' sq.ft' WHEN 1 THEN ' Sq. Yd' WHEN 2 THEN ' acre' WHEN 3 THEN ' hectare' WHEN 4 THEN ' bigha' WHEN 5 THEN ',000 sqft' ELSE '' END AS x FROM {part}) a"
PRICES = "(SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'Rs. ' || CAST(p_size AS VARCHAR(9)) || ' lakh' WHEN 1 THEN CAST(p_size AS VARCHAR(9)) || '.5 Cr' WHEN 2 THEN CAST(p_size AS VARCHAR(9)) || ',000' WHEN 3 THEN CAST(p_size AS VARCHAR(9)) || 'k' WHEN 4 THEN 'on request' ELSE NULL END AS x FROM {part}) a"


def days(d: object) -> str:
    """Dates in six spellings."""
    o = "CAST(o_orderdate AS DATE)"
    forms = [d.day_text(o, s, k) for s, k in t.DAY_FORMATS]
    cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    return f"(SELECT o_orderkey AS k, {o} AS truth, CASE o_orderkey % 8 {cases} WHEN 6 THEN 'soon' ELSE NULL END AS x FROM {{orders}}) a"


OPERATORS = [
    Operator("str01_collapse_space", ("STR01", "STR27"), lambda d: f"SELECT doc_id, length({t.collapse_space('text', d)}) AS n FROM {{documents}}"),
    Operator("str03_keep_allowed", ("STR03", "STR04"), lambda d: f"SELECT p_partkey, {t.only('p_name', 'a-z', d)} AS letters, {t.only('p_brand', '0-9', d)} AS digits FROM {{part}}"),
    Operator("str05_slugs", ("STR05", "STR11"), lambda d: f"SELECT p_partkey, {t.slug('p_name', d)} AS slug, {t.slug('p_name', d, '_')} AS file_name FROM {{part}}"),
    Operator("str06_unique_slugs", ("STR06",), lambda d: f"""
        SELECT p_partkey, slug || CASE WHEN no = 1 THEN '' ELSE '-' || CAST(no - 1 AS VARCHAR(9)) END AS slug FROM (
          SELECT p_partkey, {t.slug('p_name', d)} AS slug, row_number() OVER (PARTITION BY {t.slug('p_name', d)} ORDER BY p_partkey) AS no FROM {{part}}) s"""),
    Operator("str07_registration_numbers", ("STR07", "STR36"), lambda d: f"SELECT o_orderkey, {t.registration_number("'/ p-cg--rera ' || CAST(o_orderkey AS VARCHAR(20)) || '-.'", d)} AS reg_no, {d.matches("'PCGRERA' || CAST(100000 + o_orderkey AS VARCHAR(20))", '^P?CGRERA[0-9]+$')} AS valid FROM {{orders}}"),
    Operator("str08_label_keys", ("STR08", "STR09", "STR10"), lambda d: f"SELECT p_partkey, {t.label_key("p_name || ' (No. 1) / Area'", d)} AS k, trim({d.replace_all("lower(p_name || ' / Area')", '[^a-z0-9]+', ' ')}) AS header, {t.slug("p_name || ' / Area'", d, '_')} AS qa_key FROM {{part}}"),
    Operator("str12_pincodes", ("STR12", "STR13"), lambda d: f"SELECT o_orderkey, {t.pincode("'Road ' || CAST(o_orderkey % 9000 AS VARCHAR(9)) || ', Raipur ' || CAST(490000 + o_orderkey % 99999 * CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 1 END AS VARCHAR(12)) || '.'", d)} AS pincode FROM {{orders}}"),
    Operator("str14_address", ("STR14", "STR15", "STR16", "STR42"), lambda d: """
        SELECT c_custkey, concat_ws(', ', nullif(trim(replace(c_name, ',', ' ')), ''), CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Dist. ' || n_name END, r_name, 'India') AS address,
               c_custkey % 3 = 0 AS low_confidence, concat_ws(', ', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name END, r_name, 'India') AS coarser
        FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey"""),
    Operator("str17_canonical_status", ("STR17", "STR18", "Q21"), lambda d: f"SELECT s, {t.canonical_status('s')} AS status, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'ONGOING' WHEN 1 THEN ' under construction' WHEN 2 THEN 'complete' WHEN 3 THEN 'New' ELSE o_orderstatus END AS s FROM {{orders}}) x GROUP BY s, {t.canonical_status('s')}"),
    Operator("str19_media_classes", ("STR19", "STR39"), lambda d: f"SELECT {t.keyword_class('p_name', MEDIA, 'other')} AS media, count(*) AS n FROM {{part}} GROUP BY {t.keyword_class('p_name', MEDIA, 'other')}"),
    Operator("str20_mime_types", ("STR20", "STR23"), lambda d: f"SELECT page_id, CASE lower(coalesce({d.extract('url', '[.]([A-Za-z0-9]+)$', 1)}, '')) WHEN 'pdf' THEN 'application/pdf' WHEN 'jpg' THEN 'image/jpeg' WHEN 'html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM {{pages}}"),
    Operator("str21_value_types", ("STR21",), lambda d: f"SELECT kind, count(*) AS n FROM (SELECT {t.value_type('x', d)} AS kind FROM {days(d)} UNION ALL SELECT {t.value_type('x', d)} FROM {PRICES}) u GROUP BY kind"),
    Operator("str22_price_text", ("STR22",), lambda d: f"SELECT o_orderkey, {t.price_text('CAST(o_totalprice AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 10 ELSE 1 END', d)} AS price FROM {{orders}}"),
    Operator("str24_truncate_at_sentence", ("STR24",), lambda d: "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN 500 - instr(reverse(substring(text, 1, 500)), '.') + 1 > 350 AND instr(reverse(substring(text, 1, 500)), '.') > 0 THEN substring(text, 1, 500 - instr(reverse(substring(text, 1, 500)), '.') + 1) ELSE substring(text, 1, 500) END AS cut FROM {documents}"),
    Operator("str25_ocr_clean", ("STR25", "STR26", "STR28", "STR32"), lambda d: f"SELECT doc_id, length(text) AS before, length({d.replace_all(d.replace_all(d.replace_all('text', '[|~^_]', ' '), '[.][.]+', '.'), '  +', ' ')}) AS after FROM {{documents}}"),
    Operator("str29_entities", ("STR29", "STR33"), lambda d: f"SELECT doc_id, {d.distinct_sorted(d.find_all('text', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+'))} AS emails, {d.distinct_sorted(d.find_all('text', '[+]?[0-9][0-9 -]+[0-9]'))} AS numbers FROM {{documents}}"),
    Operator("str30_key_values", ("STR30", "STR31"), lambda d: f"SELECT doc_id, {d.distinct_sorted(d.find_all('text', '[A-Za-z]+ ?: ?[A-Za-z0-9]+'))} AS pairs FROM {{documents}}"),
    Operator("str34_context", ("STR34",), lambda d: f"SELECT doc_id, substring(text, greatest(1, {d.position("'icensed'", 'text')} - 20), 60) AS context FROM {{documents}} WHERE {d.position("'icensed'", 'text')} > 0"),
    Operator("str35_json_salvage", ("STR35", "ML05"), lambda d: f"SELECT event_id, coalesce({d.json_int('props', 'k')}, {d.json_int(d.extract("'answer: ' || props || ' end'", '([{][^}]*[}])', 1), 'k')}) AS k FROM {{events}}"),
    Operator("str37_search_text", ("STR37", "NST14"), lambda d: f"SELECT p.project_id, concat_ws('. ', p.project_name, p.district, u.labels) AS search_text FROM {{projects}} p LEFT JOIN (SELECT project_id, {d.listagg('unit_type', 'unit_type')} AS labels FROM (SELECT DISTINCT project_id, unit_type FROM {{units}}) x GROUP BY project_id) u ON u.project_id = p.project_id"),
    Operator("str40_iframe_coordinates", ("STR40",), lambda d: f"SELECT k, try_cast({d.extract('src', '!3d([0-9.]+)', 1)} AS DOUBLE) AS lat, try_cast({d.extract('src', '!2d([0-9.]+)', 1)} AS DOUBLE) AS lon FROM (SELECT project_id AS k, '!2d' || CAST(CAST(lon AS DECIMAL(9, 3)) AS VARCHAR(20)) || '!3d' || CAST(CAST(lat AS DECIMAL(9, 3)) AS VARCHAR(20)) AS src FROM {{projects}}) f"),
    Operator("str41_log_counters", ("STR41",), lambda d: f"SELECT k, try_cast({d.extract('line', 'done: ([0-9]+)', 1)} AS BIGINT) AS done FROM (SELECT event_id AS k, event_type || ' done: ' || CAST(event_id % 50 AS VARCHAR(9)) || ' (3 min)' AS line FROM {{events}}) l"),
    Operator("dt01_any_date", ("DT01", "DT02", "DT10", "DT11"), lambda d: f"SELECT k, {t.any_day('x', d)} AS day, {t.any_day('x', d)} = truth AS same FROM {days(d)}"),
    Operator("dt03_timeframes", ("DT03",), lambda d: f"SELECT days, count(*) AS n FROM (SELECT 30 AS days UNION ALL SELECT 90 UNION ALL SELECT 365 UNION ALL SELECT 1825) w JOIN {{snapshots}} s ON {d.days("DATE '2001-11-30'", 's.snapshot_date')} <= w.days GROUP BY days"),
    Operator("dt05_period_labels", ("DT05", "DT06", "Q10"), lambda d: f"""
        SELECT DISTINCT 'W' || CAST({d.week('snapshot_date')} AS VARCHAR(3)) || '-' || CAST(year(snapshot_date) AS VARCHAR(5)) AS week_label, {d.day_text('snapshot_date', 'MMM yyyy', '%b %Y')} AS month_label,
               'Q' || CAST(quarter(snapshot_date) AS VARCHAR(2)) || '-' || CAST(year(snapshot_date) AS VARCHAR(5)) AS quarter_label, {d.trunc('quarter', 'snapshot_date')} AS quarter_start, {d.minus_days(d.plus_months(d.trunc('quarter', 'snapshot_date'), 3), 1)} AS quarter_end FROM {{snapshots}}"""),
    Operator("dt07_expiry", ("DT07",), lambda d: f"SELECT project_id, {d.days('approved_date', "DATE '1999-01-01'")} AS days_left FROM {{projects}}"),
    Operator("mth03_areas", ("MTH03", "MTH04", "Q07"), lambda d: f"SELECT k, round({t.area_sqm('x', d)}, 6) AS sqm, round({t.area_sqm('x', d)} * 10.7639e0, 4) AS sqft FROM {AREAS}"),
    Operator("mth05_prices", ("MTH05", "MTH07"), lambda d: f"SELECT k, {t.price_inr('x', d)} AS inr FROM {PRICES}"),
    Operator("mth06_rate", ("MTH06",), lambda d: "SELECT project_id, unit_no, block, round(1000000.0e0 / nullif(area, 0), 6) AS rate FROM {units}"),
    Operator("nst01_json_path", ("NST01", "NST09", "NST11"), lambda d: f"SELECT event_id, coalesce({d.json_int('props', 'missing')}, {d.json_int('props', 'k')}) AS v, CASE WHEN {d.json_int('props', 'k')} > 1 THEN {d.json_int('props', 'k')} / 100.0e0 ELSE {d.json_int('props', 'k')} * 1.0e0 END AS progress FROM {{events}}"),
    Operator("nst15_tower_units", ("NST15", "NST03"), lambda d: f"SELECT project_id, block, count(*) AS units, {d.listagg('CAST(unit_no AS VARCHAR(5))', 'unit_no, unit_type, area')} AS unit_list FROM {{units}} GROUP BY project_id, block"),
    Operator("nst05_last_key_wins", ("NST05", "NST06", "NST07", "NST12"), lambda d: "SELECT project_id, unit_no, max_by(block, area * 1000 + unit_no) AS block, count(*) AS rows_in FROM (SELECT DISTINCT project_id, unit_no, block, area FROM {units}) u GROUP BY project_id, unit_no HAVING count(DISTINCT area) = count(*)"),
]
