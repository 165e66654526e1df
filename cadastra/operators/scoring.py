"""Rule engines: amenity and location scores, value score, quality gate, audits, badges, conflict resolution."""

from __future__ import annotations

from cadastra.plans.operator import Operator, Picked

#: Largest count of each bucket and its score; what is beyond gets the last score. Fixed values of the score rules.
DAILY = ((0, 20), (2, 60), (4, 80), (None, 100))
SOCIAL = ((0, 20), (2, 60), (5, 80), (None, 100))
TRANSIT_NEAR = ((0, 20), (2, 60), (5, 80), (None, 100))


def bucket(count: str, steps: tuple[tuple[int | None, int], ...]) -> str:
    cases = " ".join(f"WHEN {count} <= {most} THEN {score}.0e0" for most, score in steps if most is not None)
    return f"CASE {cases} ELSE {steps[-1][1]}.0e0 END"


def nearby(kind: str, target: float) -> str:
    """The largest radius up to the target, else the smallest that a type has."""
    return f"coalesce(max(CASE WHEN amenity_type = '{kind}' AND radius_km <= {target} THEN radius_km END), min(CASE WHEN amenity_type = '{kind}' THEN radius_km END))"


def counts(kinds: dict[str, float]) -> str:
    radii = ", ".join(f"{nearby(k, t)} AS r_{k}" for k, t in kinds.items())
    values = ", ".join(f"coalesce(max(CASE WHEN s.amenity_type = '{k}' AND s.radius_km = r.r_{k} THEN s.nearby_count END), 0) AS {k}" for k in kinds)
    return f"""SELECT s.project_id, {values}, min(CASE WHEN s.amenity_type = 'bank' THEN s.nearest_km END) AS bank_km
        FROM {{amenity_stats}} s JOIN (SELECT project_id, {radii} FROM {{amenity_stats}} WHERE radius_km IS NOT NULL GROUP BY project_id) r ON r.project_id = s.project_id
        WHERE s.radius_km IS NOT NULL GROUP BY s.project_id"""


def location_score(d: object) -> str:
    daily = f"({bucket('grocery', DAILY)} + {bucket('pharmacy', DAILY)}) / 2"
    social = f"CASE WHEN hospital = 0 AND school = 0 THEN least(70.0e0, ({bucket('hospital', SOCIAL)} + {bucket('school', SOCIAL)}) / 2) ELSE ({bucket('hospital', SOCIAL)} + {bucket('school', SOCIAL)}) / 2 END"
    connect = f"0.7e0 * {bucket('transit', TRANSIT_NEAR)} + 0.3e0 * CASE WHEN bank_km <= 1 THEN 90.0e0 WHEN bank_km <= 2 THEN 70.0e0 ELSE 30.0e0 END"
    return f"""
        WITH c AS ({counts({'grocery': 1, 'pharmacy': 1, 'hospital': 10, 'school': 3, 'transit': 3, 'bank': 3})}),
        parts AS (SELECT project_id, {daily} AS daily, {social} AS social, {connect} AS connectivity FROM c)
        SELECT project_id, {d.even('daily', 0)} AS daily, {d.even('social', 0)} AS social, {d.even('connectivity', 0)} AS connectivity,
               {d.even('least(100.0e0, greatest(0.0e0, 0.40e0 * daily + 0.35e0 * social + 0.25e0 * connectivity))', 0)} AS location_score FROM parts"""


QA = """
    SELECT project_id, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning' WHEN infos > 0 THEN 'pending' ELSE 'passed' END AS qa_status, errors, warnings
    FROM (SELECT project_id,
        CASE WHEN project_name IS NULL OR trim(project_name) = '' THEN 1 ELSE 0 END + CASE WHEN total_price > 400000 THEN 1 ELSE 0 END + CASE WHEN district IS NULL THEN 1 ELSE 0 END AS errors,
        CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END + CASE WHEN total_price < 20000 THEN 1 ELSE 0 END + CASE WHEN approved_date IS NULL THEN 1 ELSE 0 END AS warnings,
        CASE WHEN total_price IS NULL THEN 1 ELSE 0 END AS infos FROM {projects}) f"""

OPERATORS = [
    Operator("scr01_04_location_score", ("SCR01", "SCR02", "SCR03", "SCR04", "MTH11", "MTH12", "Q16", "Q18"), location_score),
    Operator("scr04_overall", ("SCR04",), lambda d: f"""
        SELECT project_id, {d.even('CASE WHEN location_score IS NOT NULL AND amenity_score IS NOT NULL THEN (location_score + amenity_score) / 2 ELSE coalesce(location_score, amenity_score) END', 0)} AS overall,
               CASE WHEN location_score IS NULL AND amenity_score IS NULL THEN 'insufficient_data' WHEN location_score IS NULL OR amenity_score IS NULL THEN 'partial' ELSE 'ok' END AS status FROM {{scores}}"""),
    Operator("scr05_value_score", ("SCR05",), lambda d: f"""
        WITH m AS (SELECT (SELECT mid FROM {{mids}}) AS mid),
        price AS (SELECT project_id, min(min_price) AS price FROM {{snapshots}} WHERE is_active GROUP BY project_id),
        v AS (SELECT s.project_id, (0.60e0 * least(greatest(s.overall_score, 0), 100) / 100 + 0.40e0 * (1 - least(greatest(p.price / CASE WHEN m.mid > 0 THEN m.mid ELSE 5000000 END, 0.0e0), 2.0e0) / 2)) * 100 AS score
              FROM {{scores}} s JOIN price p ON p.project_id = s.project_id CROSS JOIN m WHERE s.overall_score IS NOT NULL AND p.price IS NOT NULL)
        SELECT project_id, {d.even('score', 2)} AS value_score, CASE WHEN score >= 70 THEN 'excellent' WHEN score >= 55 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS value_bucket FROM v""", {"mids": Picked(lambda d: "SELECT min_price FROM {snapshots} WHERE is_active", "min_price")}),
    Operator("scr06_explanation", ("SCR06",), lambda d: f"""
        SELECT project_id, coalesce({d.listagg("CASE WHEN nearby_count >= 6 THEN amenity_type END", 'amenity_type, radius_km, stat_id', '; ')}, '') AS strong,
               coalesce({d.listagg("CASE WHEN nearby_count = 0 THEN amenity_type END", 'amenity_type, radius_km, stat_id', '; ')}, '') AS weak FROM {{amenity_stats}} WHERE radius_km IS NOT NULL GROUP BY project_id"""),
    Operator("scr07_quality_gate", ("SCR07", "Q20", "DT08"), lambda d: QA),
    Operator("scr08_messages", ("SCR08", "STR13"), lambda d: """
        SELECT project_id, concat_ws('; ', CASE WHEN district IS NULL OR trim(district) = '' THEN 'district missing' END, CASE WHEN status NOT IN ('O', 'F') THEN 'status unknown' END,
               CASE WHEN total_price <= 0 OR total_price IS NULL THEN 'price missing' END) AS messages FROM {projects}"""),
    Operator("scr09_provenance", ("SCR09",), lambda d: """
        SELECT project_id, (CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END + CASE WHEN project_name IS NULL THEN 0 ELSE 1 END + CASE WHEN lat IS NULL THEN 0 ELSE 1 END + CASE WHEN total_price IS NULL THEN 0 ELSE 1 END + CASE WHEN approved_date IS NULL THEN 0 ELSE 1 END) / 5.0e0 AS confidence FROM {projects}"""),
    Operator("scr10_anomaly_badges", ("SCR10",), lambda d: """
        SELECT snapshot_id, concat_ws(',', CASE WHEN max_rate < 500 THEN 'rate_low' END, CASE WHEN max_rate > 2500 THEN 'rate_high' END, CASE WHEN min_price < 5000 THEN 'total_low' END) AS badges
        FROM {snapshots} WHERE max_rate < 500 OR max_rate > 2500 OR min_price < 5000"""),
    Operator("scr11_trust_badge", ("SCR11", "DT07"), lambda d: f"""
        SELECT verification_id, CASE status WHEN 'VERIFIED' THEN 'Verified' WHEN 'REVOKED' THEN 'Revoked' ELSE 'Unverified' END AS label, status = 'VERIFIED' AS is_verified,
               CASE WHEN {d.days("verified_at", "DATE '2001-06-30'")} < 0 THEN 'expired' WHEN {d.days("verified_at", "DATE '2001-06-30'")} < 90 THEN 'expires in ' || CAST({d.days("verified_at", "DATE '2001-06-30'")} AS VARCHAR(10)) || ' days' END AS warning
        FROM {{verifications}} WHERE is_current"""),
    Operator("scr12_conflict_resolution", ("SCR12", "SCR13", "STR38"), lambda d: """
        SELECT project_id, CASE WHEN scraped IS NULL THEN filed WHEN filed IS NULL THEN scraped WHEN lower(trim(scraped)) = lower(trim(filed)) THEN scraped WHEN length(filed) > length(scraped) THEN filed ELSE scraped END AS resolved,
               CASE WHEN scraped IS NULL OR filed IS NULL OR lower(trim(scraped)) = lower(trim(filed)) THEN 1.0e0 WHEN length(filed) <> length(scraped) THEN 0.8e0 ELSE 0.7e0 END AS confidence
        FROM (SELECT p.project_id, CASE WHEN p.project_id % 6 = 0 THEN NULL ELSE p.project_name END AS scraped, CASE WHEN p.project_id % 4 = 0 THEN NULL WHEN p.project_id % 4 = 1 THEN upper(p.project_name) ELSE p.project_name || ' Phase 2' END AS filed FROM {projects} p) x"""),
    Operator("scr14_document_classes", ("SCR14", "SCR15"), lambda d: """
        SELECT doc_id, CASE WHEN a >= b AND a >= c AND a > 0 THEN 'license' WHEN b >= c AND b > 0 THEN 'contact' WHEN c > 0 THEN 'legal' ELSE 'unknown' END AS document_type, least(1.0e0, greatest(a, b, c) * 0.1e0 + 0.4e0) AS confidence
        FROM (SELECT doc_id, CASE WHEN lower(text) LIKE '%licensed%' THEN 1 ELSE 0 END + CASE WHEN lower(text) LIKE '%cc by%' THEN 1 ELSE 0 END AS a,
                CASE WHEN text LIKE '%@%' THEN 1 ELSE 0 END + CASE WHEN lower(text) LIKE '%http%' THEN 1 ELSE 0 END AS b,
                CASE WHEN lower(text) LIKE '%rights reserved%' THEN 1 ELSE 0 END + CASE WHEN lower(text) LIKE '%copyright%' THEN 1 ELSE 0 END AS c FROM {documents}) t"""),
    Operator("scr16_route", ("SCR16",), lambda d: "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'ocr' WHEN n_chars > 20000 THEN 'llm' WHEN lang <> 'en' THEN 'hybrid' ELSE 'text' END AS route FROM {documents}"),
    Operator("scr17_record_validity", ("SCR17",), lambda d: f"SELECT project_id, concat_ws(',', CASE WHEN NOT {d.matches('reg_no', '^RG[0-9]+$')} THEN 'reg_no' END, CASE WHEN approved_date > DATE '2001-01-01' THEN 'late' END, CASE WHEN total_price IS NULL THEN 'price' END) AS errors FROM {{projects}}"),
    Operator("scr18_field_compare", ("SCR18",), lambda d: """
        SELECT a.project_id, f.field, CASE WHEN f.a IS NULL AND f.b IS NULL THEN 'missing' WHEN f.a IS NULL THEN 'missing_in_json' WHEN f.b IS NULL THEN 'missing_in_html' WHEN f.a = f.b THEN 'match' ELSE 'mismatch' END AS outcome
        FROM {projects} a JOIN (
          SELECT project_id, 'district' AS field, district AS a, CASE WHEN project_id % 3 = 0 THEN NULL ELSE district END AS b FROM {projects}
          UNION ALL SELECT project_id, 'status', status, CASE WHEN project_id % 3 = 1 THEN 'X' ELSE status END FROM {projects}
          UNION ALL SELECT project_id, 'price', CAST(CAST(total_price AS BIGINT) AS VARCHAR(20)), CAST(CAST(total_price AS BIGINT) AS VARCHAR(20)) FROM {projects}) f ON f.project_id = a.project_id"""),
    Operator("scr19_normalization_issues", ("SCR19",), lambda d: f"SELECT project_id, CASE WHEN district <> upper(district) THEN 'case' WHEN length(state_code) <> 2 THEN 'state_code' WHEN NOT {d.matches('reg_no', '^RG[0-9][0-9][0-9]+$')} THEN 'reg_no' ELSE 'ok' END AS issue FROM {{projects}}"),
    Operator("scr20_type_mismatches", ("SCR20", "DT09"), lambda d: """
        SELECT project_id, 'ongoing_past_end' AS issue FROM {projects} WHERE status = 'O' AND approved_date < DATE '1996-01-01'
        UNION ALL SELECT project_id, 'bad_status' FROM {projects} WHERE status NOT IN ('O', 'F') UNION ALL SELECT project_id, 'lat' FROM {projects} WHERE lat < 17.5e0"""),
    Operator("scr21_report_gate", ("SCR21", "SCR25"), lambda d: """
        SELECT field, null_pct, CASE WHEN null_pct > 50 THEN 'high' WHEN null_pct > 0 THEN 'medium' ELSE 'none' END AS severity FROM (
          SELECT 'overall' AS field, round(100.0e0 * count(CASE WHEN overall_score IS NULL THEN 1 END) / count(*), 2) AS null_pct FROM {scores}
          UNION ALL SELECT 'amenity', round(100.0e0 * count(CASE WHEN amenity_score IS NULL THEN 1 END) / count(*), 2) FROM {scores}) t"""),
    Operator("scr22_suspicious_counts", ("SCR22",), lambda d: "SELECT stat_id, project_id, amenity_type, nearby_count FROM {amenity_stats} WHERE radius_km <= 1 AND nearby_count > 9"),
    Operator("scr24_spot_check", ("SCR24",), lambda d: "SELECT doc_id, CASE WHEN lower(text) NOT LIKE '%unavailable%' AND length(text) > 50 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {documents} ORDER BY doc_id LIMIT 10"),
    Operator("mth08_rating", ("MTH08",), lambda d: f"SELECT project_id, nullif({d.even('overall_score / 100 * 5', 1)}, 0) AS rating FROM {{scores}}"),
    Operator("mth09_price_bands", ("MTH09",), lambda d: """
        SELECT project_id, CASE WHEN pct <= -10 THEN 'below' WHEN pct <= 10 THEN 'average' WHEN pct <= 25 THEN 'above' ELSE 'far_above' END AS band
        FROM (SELECT project_id, (total_price - avg(total_price) OVER (PARTITION BY district)) / nullif(avg(total_price) OVER (PARTITION BY district), 0) * 100 AS pct FROM {projects} WHERE total_price IS NOT NULL) t"""),
    Operator("mth10_completeness", ("MTH10",), lambda d: """
        SELECT project_id, pct, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' ELSE 'low' END AS band FROM (
          SELECT project_id, (CASE WHEN lat IS NULL THEN 0 ELSE 25 END + CASE WHEN total_price IS NULL THEN 0 ELSE 25 END + CASE WHEN parent_id IS NULL THEN 0 ELSE 25 END + 25) AS pct FROM {projects}) t"""),
]
