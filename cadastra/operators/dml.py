"""Upserts without MERGE: union of old and new rows, ranked, the winner kept; and the read model."""

from __future__ import annotations

from cadastra.operators.windows import first_row
from cadastra.plans.operator import Operator

READ_MODEL = """
    WITH place AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(confidence, 0) DESC, updated_at DESC NULLS LAST, location_id DESC) AS rn FROM {locations} WHERE is_active) a WHERE rn = 1),
    onsite AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY stat_id DESC) AS rn FROM {amenity_stats} WHERE radius_km IS NULL) a WHERE rn = 1),
    nearby AS (SELECT project_id, CAST(sum(coalesce(nearby_count, 0)) AS BIGINT) AS nearby_total, min(nearest_km) AS nearest_km FROM {amenity_stats} WHERE radius_km IS NOT NULL GROUP BY project_id),
    price AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY snapshot_date DESC, snapshot_id DESC) AS rn FROM {snapshots} WHERE is_active) a WHERE rn = 1),
    verified AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY verified_at DESC, verification_id DESC) AS rn FROM {verifications} WHERE is_current) a WHERE rn = 1),
    tagged AS (SELECT pt.project_id, count(*) AS n_tags FROM {project_tags} pt JOIN {tags} t ON t.slug = pt.slug GROUP BY pt.project_id)
    SELECT p.project_id, p.project_name, p.district, coalesce(l.lat, p.lat) AS lat, coalesce(l.lon, p.lon) AS lon, l.source_type, s.overall_score, s.score_status,
           coalesce(o.onsite_available, FALSE) AS onsite, coalesce(n.nearby_total, 0) AS nearby_total, n.nearest_km, pr.min_price, pr.max_price, pr.snapshot_date, v.status AS rera_status, coalesce(t.n_tags, 0) AS n_tags
    FROM {projects} p LEFT JOIN place l ON l.project_id = p.project_id LEFT JOIN {scores} s ON s.project_id = p.project_id LEFT JOIN onsite o ON o.project_id = p.project_id
    LEFT JOIN nearby n ON n.project_id = p.project_id LEFT JOIN price pr ON pr.project_id = p.project_id LEFT JOIN verified v ON v.project_id = p.project_id LEFT JOIN tagged t ON t.project_id = p.project_id"""

SEARCH = """
    WITH latest AS (SELECT project_id, min(min_price) AS min_price, max(max_price) AS max_price FROM (
        SELECT *, max(snapshot_date) OVER (PARTITION BY project_id) AS last_date FROM {snapshots} WHERE is_active) s WHERE snapshot_date = last_date GROUP BY project_id),
    hits AS (SELECT p.project_id, p.project_name, p.district, l.min_price, l.max_price
      FROM {projects} p JOIN latest l ON l.project_id = p.project_id LEFT JOIN {scores} s ON s.project_id = p.project_id
      WHERE p.status IN ('O', 'F') AND l.max_price >= 15000 AND l.min_price <= 60000 AND s.overall_score >= 20)
    SELECT project_id, project_name, district, min_price, max_price, (SELECT count(*) FROM hits) AS total FROM hits
    ORDER BY min_price, project_id LIMIT 20"""

OPERATORS = [
    Operator("jn01_read_model", ("JN01", "WIN01", "WIN02", "WIN03", "WIN04", "AGG05", "AGG06"), lambda d: READ_MODEL),
    Operator("search_budget_topk", ("P0", "AGG07", "SRT01", "SRT02", "FLT04", "FLT10"), lambda d: SEARCH),
    Operator("dml01_upsert_replace", ("DML01", "SNK05"), lambda d: first_row("(SELECT project_id, project_name AS name, 0 AS version FROM {projects} UNION ALL SELECT project_id, upper(project_name), 1 FROM {projects} WHERE status = 'F') u", "project_id", "version DESC", "project_id, name")),
    Operator("dml02_insert_ignore", ("DML02",), lambda d: "SELECT client, endpoint FROM (SELECT DISTINCT client, endpoint FROM {usage} WHERE tier <> 'internal') a UNION ALL SELECT n.client, n.endpoint FROM (SELECT DISTINCT client, endpoint FROM {usage} WHERE tier = 'internal') n WHERE NOT EXISTS (SELECT 1 FROM {usage} o WHERE o.tier <> 'internal' AND o.client = n.client AND o.endpoint = n.endpoint)"),
    Operator("dml05_poi_upsert", ("DML05", "SRC10", "SRC11"), lambda d: "SELECT coalesce(o.poi_id, n.poi_id) AS poi_id, greatest(o.radius, n.radius) AS radius, CASE WHEN n.poi_id IS NULL THEN 'kept' WHEN o.poi_id IS NULL THEN 'new' ELSE 'touched' END AS outcome FROM (SELECT poi_id, 3 AS radius FROM {poi} WHERE lat < 21) o FULL OUTER JOIN (SELECT poi_id, poi_id % 7 AS radius FROM {poi} WHERE lon < 82) n ON n.poi_id = o.poi_id"),
    Operator("dml06_skip_scored", ("DML06", "DML07"), lambda d: "SELECT p.project_id FROM {projects} p WHERE NOT EXISTS (SELECT 1 FROM {scores} s WHERE s.project_id = p.project_id)"),
    Operator("dml08_geocode_states", ("DML08",), lambda d: "SELECT CASE WHEN lat IS NULL AND parent_id IS NULL THEN 'FAILED' WHEN lat IS NULL THEN 'PENDING' ELSE 'SUCCESS' END AS geo_status, count(*) AS n FROM {projects} GROUP BY 1"),
    Operator("dml09_changed_locations", ("DML09",), lambda d: "SELECT p.project_id, l.lat, l.lon FROM {projects} p JOIN (SELECT project_id, max_by(lat, location_id) AS lat, max_by(lon, location_id) AS lon FROM {locations} WHERE is_active GROUP BY project_id) l ON l.project_id = p.project_id WHERE p.lat IS DISTINCT FROM l.lat OR p.lon IS DISTINCT FROM l.lon"),
    Operator("dml10_run_audit", ("DML10", "Q14"), lambda d: "SELECT run_id, CASE max(step) WHEN 0 THEN 'started' WHEN 1 THEN 'finished' ELSE 'failed' END AS state, count(*) AS entries FROM (SELECT client AS run_id, 0 AS step FROM {usage} WHERE endpoint = 'signup' UNION ALL SELECT client, CASE WHEN status_code >= 500 THEN 2 ELSE 1 END FROM {usage} WHERE endpoint IN ('purchase', 'error')) a GROUP BY run_id"),
    Operator("dml11_retry_counts", ("DML11",), lambda d: "SELECT project_id, CAST(sum(CASE WHEN status = 'failed' THEN retry_count + 1 ELSE retry_count END) AS BIGINT) AS retries, count(CASE WHEN status = 'done' THEN 1 END) AS done FROM {downloads} GROUP BY project_id"),
    Operator("dml12_price_csv_upsert", ("DML12", "SRC05"), lambda d: first_row("(SELECT project_id, snapshot_date, label, max_price, 0 AS version, snapshot_id FROM {snapshots} WHERE is_active UNION ALL SELECT project_id, snapshot_date, label, max_price * 2, 1, snapshot_id FROM {snapshots} WHERE is_active AND label = 'A') u", "project_id, snapshot_date, label", "version DESC, snapshot_id DESC", "project_id, snapshot_date, label, max_price")),
    Operator("dml14_exact_else_ilike", ("DML14",), lambda d: "SELECT f.filing_id, coalesce(e.project_id, p.project_id) AS project_id FROM {filings} f LEFT JOIN {projects} e ON e.project_id = f.project_id AND f.completion_text <> 'n/a' LEFT JOIN {projects} p ON p.reg_no = 'RG' || CAST(f.project_id AS VARCHAR(20)) AND e.project_id IS NULL"),
    Operator("dml15_coalesce_upsert", ("DML15",), lambda d: "SELECT p.project_id, coalesce(CASE WHEN p.project_id % 2 = 0 THEN NULL ELSE upper(p.district) || '!' END, p.district) AS district FROM {projects} p"),
    Operator("stm03_last_requests", ("STM03",), lambda d: first_row("{usage}", "client", "ts DESC, event_id DESC", "client, event_id, CAST(rn AS BIGINT) AS rn", 10)),
    Operator("stm11_resume_batch", ("STM11", "STM13"), lambda d: first_row("(SELECT * FROM {downloads} w WHERE NOT EXISTS (SELECT 1 FROM {downloads} x WHERE x.project_id = w.project_id AND x.document_type = w.document_type AND x.status = 'done' AND x.file_id < w.file_id)) w", "project_id", "file_id", "project_id, file_id", 3)),
    Operator("vec01_cosine_topk", ("VEC01", "SRT08", "NST19", "Q12"), lambda d: f"""
        SELECT vec_id, round(similarity, 4) AS similarity FROM (
          SELECT e.vec_id, {d.dot('e.embedding', 'q.embedding')} / (sqrt({d.dot('e.embedding', 'e.embedding')}) * sqrt({d.dot('q.embedding', 'q.embedding')})) AS similarity
          FROM {{embeddings}} e CROSS JOIN (SELECT embedding FROM {{embeddings}} WHERE vec_id = 7) q WHERE e.embedding IS NOT NULL) s
        ORDER BY similarity DESC, vec_id LIMIT 20"""),
    Operator("vec03_chat_retrieval", ("VEC03",), lambda d: f"""
        WITH hits AS (SELECT vec_id, similarity FROM (SELECT e.vec_id, {d.dot('e.embedding', 'q.embedding')} AS similarity FROM {{embeddings}} e CROSS JOIN (SELECT embedding FROM {{embeddings}} WHERE vec_id = 3) q) s ORDER BY similarity DESC, vec_id LIMIT 5)
        SELECT h.vec_id, p.project_name, coalesce(p.district, p.state_code) AS place FROM hits h JOIN {{projects}} p ON p.project_id = h.vec_id"""),
    Operator("ml01_outlier_features", ("ML01",), lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS rate FROM {lineitem} WHERE l_quantity > 0 AND l_extendedprice > 0"),
    Operator("ml04_first_child", ("ML04",), lambda d: "SELECT project_id, min_by(area, unit_no * 1000 + area) AS first_area, count(*) AS n FROM {units} GROUP BY project_id"),
    Operator("map_pins", ("FLT06", "AGG08", "Q09"), lambda d: "SELECT p.project_id, p.lat, p.lon, p.project_type, s.low FROM {projects} p LEFT JOIN (SELECT project_id, min(min_price) AS low FROM {snapshots} WHERE is_active GROUP BY project_id) s ON s.project_id = p.project_id WHERE p.lat BETWEEN 18 AND 22 AND p.lon BETWEEN 80 AND 83 AND p.project_type IN ('1-URGENT', '2-HIGH')"),
]
