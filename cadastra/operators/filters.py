"""Row filters and projections of the registry's reads."""

from __future__ import annotations

from cadastra.functions.geo import haversine
from cadastra.plans.operator import Operator

BUDGET = """
    WITH latest AS (
      SELECT project_id, min(min_price) AS min_price, max(max_price) AS max_price
      FROM (SELECT *, max(snapshot_date) OVER (PARTITION BY project_id) AS last_date FROM {snapshots} WHERE is_active) s
      WHERE snapshot_date = last_date GROUP BY project_id)"""

OPERATORS = [
    Operator("flt01_ilike_pattern", ("FLT01",), lambda d: "SELECT project_id, district FROM {projects} WHERE district ILIKE 'N%_1'"),
    Operator("flt02_name_contains", ("FLT02",), lambda d: "SELECT project_id, project_name FROM {projects} WHERE project_name ILIKE '%' || '0001' || '%'"),
    Operator("flt03_name_or_regno", ("FLT03",), lambda d: "SELECT project_id, project_name, reg_no FROM {projects} WHERE project_name ILIKE '%77%' OR reg_no ILIKE '%rg77%'"),
    Operator("flt04_status_in", ("FLT04",), lambda d: "SELECT project_id, status FROM {projects} WHERE status IN ('F', 'P')"),
    Operator("flt05_type_in", ("FLT05",), lambda d: "SELECT project_id, project_type FROM {projects} WHERE project_type IN ('1-URGENT', '5-LOW')"),
    Operator("flt06_bounding_box", ("FLT06",), lambda d: "SELECT project_id, lat, lon FROM {projects} WHERE lat BETWEEN 18.5e0 AND 20.25e0 AND lon BETWEEN 80.5e0 AND 82.0e0"),
    Operator("flt07_radius", ("FLT07", "MTH01", "MTH02"), lambda d: f"""
        SELECT project_id, round(km, 6) AS km FROM (
          SELECT project_id, {haversine('lat', 'lon', '20.0e0', '81.5e0')} AS km FROM {{projects}}
          WHERE lat BETWEEN 20.0e0 - 25 / 110.0e0 AND 20.0e0 + 25 / 110.0e0 AND lon IS NOT NULL) t
        WHERE km <= 25"""),
    Operator("flt08_required_onsite", ("FLT08", "SET01"), lambda d: """
        SELECT project_id, count(DISTINCT amenity_type) AS found FROM {amenity_stats}
        WHERE radius_km IS NULL AND onsite_available AND amenity_type IN ('school', 'bank')
        GROUP BY project_id HAVING count(DISTINCT amenity_type) = 2"""),
    Operator("flt09_min_scores", ("FLT09",), lambda d: """
        SELECT p.project_id, s.overall_score, s.location_score, s.amenity_score FROM {projects} p LEFT JOIN {scores} s ON s.project_id = p.project_id
        WHERE s.overall_score >= 60 AND s.location_score >= 40 AND s.amenity_score >= 20"""),
    Operator("flt10_budget_overlap", ("FLT10", "AGG07"), lambda d: BUDGET + """
        SELECT p.project_id, l.min_price, l.max_price FROM {projects} p JOIN latest l ON l.project_id = p.project_id
        WHERE l.max_price >= 20000 AND l.min_price <= 40000"""),
    Operator("flt11_freshness", ("FLT11", "STM06"), lambda d: f"""
        SELECT location_id, project_id, updated_at FROM {{locations}}
        WHERE updated_at >= {d.minus_days("DATE '2001-11-30'", 60)} AND source_type = 'manual' AND confidence >= 0.2"""),
    Operator("flt12_null_safe_label", ("FLT12",), lambda d: "SELECT snapshot_id, label FROM {snapshots} WHERE label IS NOT DISTINCT FROM CAST(NULL AS VARCHAR(5))"),
    Operator("flt13_active_in_range", ("FLT13",), lambda d: """
        SELECT snapshot_id, project_id, snapshot_date FROM {snapshots}
        WHERE is_active AND snapshot_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' AND project_id IN (SELECT project_id FROM {projects} WHERE status = 'O')"""),
    Operator("flt14_optional_district", ("FLT14",), lambda d: "SELECT project_id FROM {projects} WHERE (CAST(NULL AS VARCHAR(20)) IS NULL OR district = CAST(NULL AS VARCHAR(20))) AND (status IS NULL OR status = 'O')"),
    Operator("flt15_out_of_bounds", ("FLT15",), lambda d: "SELECT project_id, lat * 2 - 4 AS lat2, lon FROM {projects} WHERE lat * 2 - 4 < 6 OR lat * 2 - 4 > 38 OR lon < 68 OR lon > 98"),
    Operator("flt16_brochure_lookup", ("FLT16",), lambda d: """
        SELECT project_id, file_id, origin FROM (
          SELECT u.*, row_number() OVER (PARTITION BY project_id ORDER BY rank, file_id) AS rn FROM (
            SELECT project_id, file_id, 'document' AS origin, 1 AS rank FROM {downloads} WHERE document_type ILIKE '%purch%'
            UNION ALL SELECT project_id, file_id, 'artifact', 2 FROM {downloads} WHERE document_type ILIKE '%sign%') u) v
        WHERE rn = 1"""),
    Operator("flt17_floor_plans", ("FLT17",), lambda d: "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%s%ring%' ORDER BY p_partkey LIMIT 50"),
    Operator("flt18_unified_lookup", ("FLT18",), lambda d: f"""
        SELECT q, project_id FROM (
          SELECT q, project_id, row_number() OVER (PARTITION BY q ORDER BY rank, project_id) AS rn FROM (
            SELECT i.q, p.project_id, 1 AS rank FROM (SELECT CAST(o_orderkey AS VARCHAR(20)) AS q FROM {{orders}} ) i JOIN {{projects}} p ON {d.matches('i.q', '^[0-9]+$')} AND p.project_id = try_cast(i.q AS BIGINT)
            UNION ALL SELECT i.q, p.project_id, 2 FROM (SELECT 'RG' || CAST(o_orderkey AS VARCHAR(20)) AS q FROM {{orders}} ) i JOIN {{projects}} p ON p.reg_no = i.q) u) v
        WHERE rn = 1"""),
    Operator("prj01_search_item", ("PRJ01",), lambda d: """
        SELECT p.project_id, p.project_name, p.reg_no, p.status, p.district, CAST(NULL AS VARCHAR(5)) AS cover_image, coalesce(s.overall_score, 0) AS overall_score,
               p.total_price IS NOT NULL AS has_price FROM {projects} p LEFT JOIN {scores} s ON s.project_id = p.project_id"""),
    Operator("prj02_geo_fallback", ("PRJ02",), lambda d: """
        SELECT p.project_id, coalesce(l.lat, p.lat) AS lat, coalesce(l.lon, p.lon) AS lon, coalesce(l.source_type, 'project') AS origin
        FROM {projects} p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY location_id) AS rn FROM {locations} WHERE is_active) l
          ON l.project_id = p.project_id AND l.rn = 1"""),
    Operator("prj03_date_fallback", ("PRJ03",), lambda d: """
        SELECT project_id, coalesce(CASE WHEN project_id % 3 = 0 THEN approved_date END, CASE WHEN project_id % 3 = 1 THEN approved_date END, DATE '0001-01-01') AS sort_date FROM {projects}"""),
    Operator("prj04_list_page", ("PRJ04", "SRT02"), lambda d: "SELECT project_id, project_name FROM {projects} ORDER BY project_name, project_id LIMIT 25 OFFSET 50"),
]
