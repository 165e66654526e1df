"""Latest-per-entity and ranking operators; ``row_number() = 1`` plans a WindowGroupLimit before the shuffle."""

from __future__ import annotations

from cadastra.plans.operator import Operator


def first_row(source: str, key: str, order: str, columns: str, keep: int = 1) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) ranked WHERE rn <= {keep}"


SAMPLE = """
    WITH strata AS (SELECT district, count(*) AS n FROM {projects} GROUP BY district),
    total AS (SELECT sum(n) AS all_n FROM strata),
    shares AS (SELECT s.district, s.n, least(s.n, greatest(1, CAST(floor(s.n * 200.0e0 / t.all_n) AS BIGINT))) AS want FROM strata s CROSS JOIN total t),
    budget AS (SELECT *, coalesce(sum(want) OVER (ORDER BY n DESC, district ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM shares),
    quota AS (SELECT district, greatest(0, least(want, 200 - used)) AS take FROM budget)
    SELECT r.project_id, r.district FROM (
      SELECT p.*, row_number() OVER (PARTITION BY district ORDER BY approved_date DESC NULLS LAST, project_id DESC) AS rn FROM {projects} p) r
    JOIN quota q ON q.district = r.district WHERE r.rn <= q.take"""

OPERATORS = [
    Operator("win01_best_location", ("WIN01", "Q02"), lambda d: first_row("(SELECT * FROM {locations} WHERE is_active) l", "project_id", "coalesce(confidence, 0) DESC, updated_at DESC NULLS LAST, location_id DESC", "project_id, location_id, source_type, confidence")),
    Operator("win02_latest_onsite", ("WIN02",), lambda d: first_row("(SELECT * FROM {amenity_stats} WHERE radius_km IS NULL) s", "project_id", "stat_id DESC", "project_id, stat_id, amenity_type, onsite_available")),
    Operator("win03_latest_price", ("WIN03",), lambda d: first_row("(SELECT * FROM {snapshots} WHERE is_active) s", "project_id", "snapshot_date DESC, snapshot_id DESC", "project_id, snapshot_id, min_price, max_price")),
    Operator("win04_current_verification", ("WIN04", "DML04"), lambda d: first_row("(SELECT * FROM {verifications} WHERE is_current) v", "project_id", "verified_at DESC, verification_id DESC", "project_id, verification_id, status")),
    Operator("win05_location_priority", ("WIN05",), lambda d: first_row("""(
        SELECT *, CASE source_type WHEN 'manual' THEN 0 WHEN 'source_page' THEN 10 WHEN 'geocode_normalized' THEN 20 + CASE precision_level WHEN 'rooftop' THEN 0 WHEN 'street' THEN 1 ELSE 2 END ELSE 40 END AS priority
        FROM {locations} WHERE is_active) l""", "project_id", "priority, coalesce(confidence, 0) DESC, updated_at DESC, location_id DESC", "project_id, location_id, source_type, precision_level, priority")),
    Operator("win06_period_change", ("WIN06",), lambda d: f"""
        SELECT project_id, period, round(rate, 9) AS rate, round(nullif(rate - prev, 0), 9) AS change_abs, round((rate - prev) / nullif(prev, 0) * 100, 9) AS change_pct
        FROM (SELECT *, lag(rate) OVER (PARTITION BY project_id ORDER BY period) AS prev FROM (
          SELECT project_id, {d.trunc('year', 'snapshot_date')} AS period, avg(max_rate) AS rate FROM {{snapshots}} GROUP BY project_id, {d.trunc('year', 'snapshot_date')}) p) t"""),
    Operator("win07_group_by_parent", ("WIN07",), lambda d: first_row("{projects}", "coalesce(parent_id, -project_id)", "coalesce(total_price, 0) DESC, project_id", "project_id, parent_id")),
    Operator("win08_smallest_radius", ("WIN08", "NST17", "Q05"), lambda d: first_row("(SELECT * FROM {amenity_stats} WHERE radius_km IS NOT NULL) s", "project_id, amenity_type", "radius_km, stat_id", "project_id, amenity_type, radius_km, nearby_count")),
    Operator("win09_resolve_radius", ("WIN09", "Q19"), lambda d: """
        SELECT project_id, amenity_type, coalesce(max(CASE WHEN radius_km <= 3 THEN radius_km END), min(radius_km)) AS radius_km
        FROM {amenity_stats} WHERE radius_km IS NOT NULL GROUP BY project_id, amenity_type"""),
    Operator("win10_last_three", ("WIN10",), lambda d: first_row("{verifications}", "project_id", "verified_at DESC, verification_id DESC", "project_id, verification_id, status, verified_at, CAST(rn AS BIGINT) AS rn", 3)),
    Operator("win11_stratified_sample", ("WIN11", "SET04"), lambda d: SAMPLE),
    Operator("win12_anomaly_ranks", ("WIN12",), lambda d: "SELECT snapshot_id, round(max_rate, 4) AS rate FROM (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY max_rate, snapshot_id) AS pr FROM {snapshots} WHERE label IS NOT NULL) t WHERE pr > 0.99"),
    Operator("srt01_search_order", ("SRT01", "Q04", "Q06"), lambda d: """
        SELECT p.project_id, coalesce(s.overall_score, 0) AS sort_score, lower(p.project_name) AS sort_name FROM {projects} p LEFT JOIN {scores} s ON s.project_id = p.project_id
        ORDER BY coalesce(s.overall_score, 0) DESC, lower(p.project_name), p.project_id LIMIT 60"""),
    Operator("srt01_price_order", ("SRT01", "SRT04"), lambda d: "SELECT project_id, total_price FROM {projects} ORDER BY total_price ASC NULLS LAST, project_id LIMIT 60"),
    Operator("srt02_page_with_total", ("SRT02",), lambda d: "WITH hits AS (SELECT project_id, total_price FROM {projects} WHERE status = 'O' AND total_price IS NOT NULL) SELECT project_id, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY total_price DESC, project_id LIMIT 20 OFFSET 20"),
    Operator("srt05_queue_order", ("SRT05", "STM08"), lambda d: "SELECT file_id, status, retry_count FROM {downloads} WHERE status IN ('pending', 'failed') ORDER BY retry_count, created_at, file_id LIMIT 100"),
    Operator("srt06_landmarks_by_importance", ("SRT06",), lambda d: "SELECT landmark_id, name, importance FROM {landmarks} WHERE is_active ORDER BY importance DESC, name LIMIT 30"),
    Operator("srt09_media_order", ("SRT09", "SET03", "NST18"), lambda d: """
        SELECT project_id, file_id, kind, CAST(row_number() OVER (PARTITION BY project_id ORDER BY primary_first, file_id, kind) AS BIGINT) AS sort_order FROM (
          SELECT project_id, file_id, 'document' AS kind, 1 AS primary_first FROM {downloads} WHERE status = 'done'
          UNION ALL SELECT project_id, file_id, 'artifact', 0 FROM {downloads} WHERE status = 'failed') m"""),
    Operator("srt10_first_three", ("SRT10",), lambda d: first_row("""(
        SELECT project_id, 'onsite ' || amenity_type AS factor, 0 AS list_no, stat_id FROM {amenity_stats} WHERE onsite_available
        UNION ALL SELECT project_id, 'nearby ' || amenity_type, 1, stat_id FROM {amenity_stats} WHERE nearby_count >= 5) f""", "project_id", "list_no, stat_id", "project_id, factor, CAST(rn AS BIGINT) AS place", 3)),
    Operator("set05_key_union", ("SET05", "SET06"), lambda d: "SELECT project_id, slug FROM {project_tags} UNION SELECT project_id, label FROM {snapshots} WHERE label IS NOT NULL"),
    Operator("set07_symmetric_difference", ("SET07", "NST13"), lambda d: """
        WITH old AS (SELECT DISTINCT p.parent_id, t.slug FROM {projects} p JOIN {project_tags} t ON t.project_id = p.project_id WHERE p.status = 'F'),
        new AS (SELECT DISTINCT p.parent_id, t.slug FROM {projects} p JOIN {project_tags} t ON t.project_id = p.project_id WHERE p.status = 'O')
        SELECT parent_id, slug, 'left' AS side FROM (SELECT * FROM old EXCEPT SELECT * FROM new) a UNION ALL SELECT parent_id, slug, 'right' FROM (SELECT * FROM new EXCEPT SELECT * FROM old) b"""),
    Operator("set08_delta_ids", ("SET08", "STM05", "STM11"), lambda d: "SELECT DISTINCT client FROM {usage} u WHERE NOT EXISTS (SELECT 1 FROM {usage} s WHERE s.client = u.client AND s.ts < TIMESTAMP '2024-01-02 00:00:00')"),
    Operator("set09_search_pairs", ("SET09", "STM10"), lambda d: "SELECT dd.district, s.status FROM (SELECT DISTINCT district FROM {projects}) dd CROSS JOIN (SELECT DISTINCT status FROM {projects}) s ORDER BY dd.district, s.status LIMIT 30"),
    Operator("set_intersect_tags", ("SET02",), lambda d: "SELECT project_id FROM {project_tags} WHERE slug = 'Brand#5' INTERSECT SELECT project_id FROM {project_tags} WHERE slug = 'Brand#6'"),
]
