"""Aggregations of the registry: facets, rollups, price envelopes and trends, audits and statistics."""

from __future__ import annotations

from cadastra.plans.operator import Operator, Picked


def pooled(unit: str, d: object) -> str:
    start = d.trunc(unit, "snapshot_date")
    return f"SELECT {start} AS period, min_rate AS rate, 1 AS own FROM {{snapshots}} WHERE is_active UNION ALL SELECT {start}, max_rate, 0 FROM {{snapshots}} WHERE is_active"


def trend(unit: str, d: object) -> str:
    """Per period: average, least, most and exact median of the pooled minimum and maximum rates, and the change."""
    # a day may hold two rates only, whose mean has more digits
    digits = 9 if unit == "day" else 6
    return f"""
        WITH pooled AS ({pooled(unit, d)}),
        averages AS (SELECT period, avg(rate) AS avg_rate, min(rate) AS min_rate, max(rate) AS max_rate, sum(own) AS sample_size FROM pooled GROUP BY period),
        periods AS (SELECT a.*, m.mid AS median_rate FROM averages a LEFT JOIN {{mids}} m ON m.period IS NOT DISTINCT FROM a.period),
        moved AS (SELECT *, lag(avg_rate) OVER (ORDER BY period) AS prev FROM periods)
        SELECT period, round(avg_rate, {digits}) AS avg_rate, round(min_rate, {digits}) AS min_rate, round(max_rate, {digits}) AS max_rate, round(median_rate, {digits}) AS median_rate,
               CAST(sample_size AS BIGINT) AS sample_size, round(nullif(avg_rate - prev, 0), {digits}) AS change_abs, round((avg_rate - prev) / nullif(prev, 0) * 100, {digits}) AS change_pct
        FROM moved"""


def distribution(column: str, source: str, group: str) -> str:
    return f"SELECT {group}, count({column}) AS n, min({column}) AS least, round(avg({column}), 4) AS mean, max({column}) AS most FROM {source} GROUP BY {group}"


def null_share(columns: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS field, round(100.0e0 * count(CASE WHEN {test} THEN 1 END) / count(*), 2) AS null_pct FROM {source}" for name, test in columns.items())


OPERATORS = [
    Operator("agg01_facet_counts", ("AGG01", "JN03"), lambda d: """
        SELECT t.slug, t.category, t.sort_order, count(DISTINCT coalesce(p.parent_id, p.project_id)) AS projects
        FROM {tags} t LEFT JOIN {project_tags} pt ON pt.slug = t.slug LEFT JOIN {projects} p ON p.project_id = pt.project_id
        WHERE t.is_active GROUP BY t.slug, t.category, t.sort_order"""),
    Operator("agg02_facets_by_category", ("AGG02",), lambda d: f"SELECT category, count(*) AS n, {d.listagg('slug', 'sort_order, slug')} AS slugs, {d.listagg('CASE WHEN is_featured THEN slug END', 'sort_order, slug')} AS featured FROM {{tags}} GROUP BY category"),
    Operator("agg03_has_all_tags", ("AGG03",), lambda d: "SELECT project_id FROM {project_tags} WHERE slug IN ('Brand#1', 'Brand#2') GROUP BY project_id HAVING count(slug) = 2"),
    Operator("agg04_has_any_tag", ("AGG04",), lambda d: "SELECT DISTINCT project_id FROM {project_tags} WHERE slug IN ('Brand#3', 'Brand#4')"),
    Operator("agg05_nearby_rollup", ("AGG05",), lambda d: "SELECT project_id, CAST(sum(coalesce(nearby_count, 0)) AS BIGINT) AS nearby_total, min(nearest_km) AS nearest_km FROM {amenity_stats} WHERE radius_km IS NOT NULL GROUP BY project_id"),
    Operator("agg06_tag_rollup", ("AGG06",), lambda d: f"SELECT pt.project_id, count(*) AS n_tags, {d.listagg('t.slug', 't.sort_order, t.slug')} AS slugs FROM {{project_tags}} pt JOIN {{tags}} t ON t.slug = pt.slug WHERE t.is_active GROUP BY pt.project_id"),
    Operator("agg07_latest_price_envelope", ("AGG07", "Q01"), lambda d: """
        SELECT project_id, max(snapshot_date) AS as_of, min(min_price) AS min_price, max(max_price) AS max_price, min(min_rate) AS min_rate, max(max_rate) AS max_rate
        FROM (SELECT *, max(snapshot_date) OVER (PARTITION BY project_id) AS last_date FROM {snapshots} WHERE is_active) s WHERE snapshot_date = last_date GROUP BY project_id"""),
    Operator("agg08_any_date_min_price", ("AGG08",), lambda d: "SELECT project_id, min(min_price) AS min_price FROM {snapshots} WHERE is_active GROUP BY project_id"),
    Operator("agg09_any_date_range", ("AGG09",), lambda d: "SELECT project_id, min(nullif(min_price, 0)) AS low, max(nullif(max_price, 0)) AS high FROM {snapshots} WHERE is_active GROUP BY project_id"),
    *(Operator(f"agg10_trend_{unit}", ("AGG10", "WIN06", "DT04", "STM09"), lambda d, unit=unit: trend(unit, d), {"mids": Picked(lambda d, unit=unit: pooled(unit, d), "rate", ("period",))}) for unit in ("day", "week", "month", "quarter", "year")),
    Operator("agg11_trend_summary", ("AGG11",), lambda d: f"""
        WITH periods AS (SELECT {d.trunc('quarter', 'snapshot_date')} AS period, avg(max_rate) AS rate FROM {{snapshots}} WHERE is_active GROUP BY 1)
        SELECT round(max_by(rate, period), 4) AS current_avg, round(max(rate), 4) AS most, round(min(rate), 4) AS least,
               round((max_by(rate, period) - min_by(rate, period)) / nullif(min_by(rate, period), 0) * 100, 2) AS change_pct, min(period) AS earliest, max(period) AS latest FROM periods"""),
    Operator("agg10_trend_by_district", ("Q22", "AGG10"), lambda d: f"SELECT p.district, {d.trunc('year', 's.snapshot_date')} AS period, round(avg(s.max_rate), 6) AS avg_rate, count(*) AS sample_size FROM {{snapshots}} s JOIN {{projects}} p ON p.project_id = s.project_id WHERE s.is_active GROUP BY p.district, {d.trunc('year', 's.snapshot_date')}"),
    Operator("agg12_median_price", ("AGG12",), lambda d: "SELECT round((SELECT mid FROM {mids}), 4) AS median_price, count(min_price) AS n FROM {snapshots} WHERE is_active", {"mids": Picked(lambda d: "SELECT min_price FROM {snapshots} WHERE is_active", "min_price")}),
    Operator("agg14_centroid", ("AGG14",), lambda d: "SELECT district, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM {projects} GROUP BY district"),
    Operator("agg15_inventory", ("AGG15",), lambda d: """
        SELECT project_id, count(*) AS total, count(CASE WHEN lower(status) = 'available' THEN 1 END) AS available, count(CASE WHEN lower(status) IN ('booked', 'sold') THEN 1 END) AS booked,
               count(CASE WHEN status IS NULL OR lower(status) NOT IN ('available', 'booked', 'sold') THEN 1 END) AS unknown FROM {units} GROUP BY project_id"""),
    Operator("agg16_unit_types", ("AGG16",), lambda d: """
        SELECT project_id, unit_type, count(*) AS total, count(CASE WHEN lower(status) = 'available' THEN 1 END) AS available, count(CASE WHEN lower(status) = 'sold' THEN 1 END) AS sold,
               min(nullif(area, 0)) AS min_area, max(nullif(area, 0)) AS max_area FROM {units} GROUP BY project_id, unit_type"""),
    Operator("agg17_size_bands", ("AGG17",), lambda d: f"""
        WITH q AS (SELECT (SELECT q1 FROM {{thirds}}) AS q1, (SELECT q2 FROM {{thirds}}) AS q2, min(area) AS lo, max(area) AS hi FROM {{units}} WHERE area > 0),
        bands AS (SELECT 'compact' AS band, lo AS a, q1 AS b FROM q UNION ALL SELECT 'medium', q1, q2 FROM q UNION ALL SELECT 'large', q2, hi FROM q)
        SELECT b.band, round(b.a, 6) AS low, round(b.b, 6) AS high, count(*) AS units FROM bands b JOIN {{units}} u ON u.area > 0 AND u.area >= b.a AND u.area <= b.b GROUP BY b.band, b.a, b.b""", {"thirds": Picked(lambda d: "SELECT area FROM {units} WHERE area > 0", "area", (), {"q1": 0.33, "q2": 0.67})}),
    Operator("agg18_location_groups", ("AGG18",), lambda d: "SELECT source_type, precision_level, count(*) AS n FROM {locations} GROUP BY source_type, precision_level"),
    Operator("agg19_geo_completeness", ("AGG19",), lambda d: """
        SELECT coalesce(status, 'UNSET') AS status, count(*) AS total, count(lat) AS with_lat, count(CASE WHEN lat IS NULL OR lon IS NULL THEN 1 END) AS missing,
               count(CASE WHEN lat < 6 OR lat > 38 OR lon < 68 OR lon > 98 THEN 1 END) AS out_of_bounds, round(100.0e0 * count(lat) / count(*), 2) AS coverage_pct FROM {projects} GROUP BY coalesce(status, 'UNSET')"""),
    Operator("agg20_coverage", ("AGG20",), lambda d: "SELECT count(*) AS stats, count(DISTINCT project_id) AS projects, count(DISTINCT CASE WHEN radius_km IS NULL THEN project_id END) AS onsite_projects FROM {amenity_stats}"),
    Operator("agg21_distributions", ("AGG21",), lambda d: distribution("nearby_count", "{amenity_stats}", "amenity_type")),
    Operator("agg21_score_distribution", ("AGG21",), lambda d: distribution("overall_score", "{scores}", "score_status")),
    Operator("agg22_status_reasons", ("AGG22", "NST10"), lambda d: """
        SELECT reason, count(*) AS n FROM (
          SELECT 'status:' || score_status AS reason FROM {scores} UNION ALL SELECT 'missing_overall' FROM {scores} WHERE overall_score IS NULL
          UNION ALL SELECT 'missing_amenity' FROM {scores} WHERE amenity_score IS NULL) t GROUP BY reason ORDER BY n DESC, reason LIMIT 10"""),
    Operator("agg23_null_percentages", ("AGG23",), lambda d: null_share({"lat": "lat IS NULL", "total_price": "total_price IS NULL", "parent_id": "parent_id IS NULL", "project_name": "project_name IS NULL OR trim(project_name) = ''"}, "{projects}")),
    Operator("agg24_score_histogram", ("AGG24",), lambda d: """
        SELECT round(avg(overall_score), 4) AS mean, round(stddev_samp(overall_score), 4) AS sd, min(overall_score) AS least, max(overall_score) AS most, (SELECT mid FROM {mids}) AS mid,
               count(CASE WHEN overall_score < 20 THEN 1 END) AS b0, count(CASE WHEN overall_score >= 20 AND overall_score < 40 THEN 1 END) AS b20, count(CASE WHEN overall_score >= 40 AND overall_score < 60 THEN 1 END) AS b40,
               count(CASE WHEN overall_score >= 60 AND overall_score < 80 THEN 1 END) AS b60, count(CASE WHEN overall_score >= 80 THEN 1 END) AS b80 FROM {scores}""", {"mids": Picked(lambda d: "SELECT overall_score FROM {scores}", "overall_score")}),
    Operator("agg25_filing_rollup", ("AGG25",), lambda d: """
        SELECT p.project_id, CASE WHEN bool_or(f.status = 'REVOKED') THEN 'REVOKED' ELSE 'ACTIVE' END AS rera_status,
               greatest(0.0e0, coalesce(max(try_cast(f.completion_text AS DOUBLE)), 0.0e0)) AS completion, max(f.processed_at) AS last_filed
        FROM {projects} p JOIN {filings} f ON f.project_id = p.project_id GROUP BY p.project_id"""),
    Operator("agg26_unit_price_rollup", ("AGG26", "SCR23"), lambda d: """
        SELECT l_orderkey AS project_id, min(nullif(l_extendedprice, 0)) AS min_total, max(nullif(l_extendedprice, 0)) AS max_total,
               round(min(l_extendedprice / nullif(l_quantity * 10.764e0, 0)), 6) AS min_rate, round(max(l_extendedprice / nullif(l_quantity * 10.764e0, 0)), 6) AS max_rate
        FROM {lineitem} GROUP BY l_orderkey"""),
    Operator("agg27_extraction_stats", ("AGG27",), lambda d: "SELECT document_type, count(*) AS total, count(CASE WHEN status = 'done' THEN 1 END) AS success, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, round(sum(cost), 4) AS cost FROM {downloads} WHERE document_type IS NOT NULL GROUP BY document_type"),
    Operator("agg28_usage_summary", ("AGG28", "STM04"), lambda d: f"""
        SELECT tier, endpoint, {d.hour('ts')} AS hour, count(*) AS requests, round(avg(ms), 6) AS avg_ms, count(CASE WHEN status_code >= 400 THEN 1 END) AS errors,
               round(count(CASE WHEN status_code >= 400 THEN 1 END) * 1.0e0 / count(*), 4) AS error_rate FROM {{usage}} GROUP BY tier, endpoint, {d.hour('ts')}"""),
    Operator("agg29_merge_report", ("AGG29",), lambda d: f"SELECT count(*) AS merged, count(CASE WHEN score_status <> 'ok' THEN 1 END) AS for_review, count(CASE WHEN overall_score IS NULL THEN 1 END) AS failed, min(CASE WHEN overall_score IS NULL THEN project_id END) AS first_failed FROM {{scores}}"),
    Operator("agg30_run_counters", ("AGG30", "Q15"), lambda d: f"SELECT {d.trunc('month', 'snapshot_date')} AS run_id, count(*) AS snapshots, count(DISTINCT project_id) AS projects, count(min_price) AS priced FROM {{snapshots}} GROUP BY {d.trunc('month', 'snapshot_date')}"),
    Operator("agg31_missing_inputs", ("AGG31",), lambda d: """
        SELECT missing, count(*) AS n FROM (SELECT 'amenity' AS missing FROM {scores} WHERE amenity_score IS NULL UNION ALL SELECT 'overall' FROM {scores} WHERE overall_score IS NULL) t GROUP BY missing"""),
    Operator("agg32_table_counts", ("AGG32",), lambda d: " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {{{t}}}" for t in ("projects", "scores", "snapshots", "locations", "tags", "units", "filings"))),
    Operator("agg33_district_counts", ("AGG33",), lambda d: "SELECT district, status, count(*) AS n FROM {projects} GROUP BY district, status ORDER BY n DESC, district, status"),
    Operator("agg34_transaction_outliers", ("AGG34",), lambda d: """
        SELECT snapshot_id, label, round(max_rate, 9) AS rate, round((max_rate - mid) / nullif(mid, 0) * 100, 4) AS deviation_pct
        FROM (SELECT s.*, m.mid FROM {snapshots} s JOIN {mids} m ON m.label IS NOT DISTINCT FROM s.label) t
        WHERE abs((max_rate - mid) / nullif(mid, 0) * 100) > 20""", {"mids": Picked(lambda d: "SELECT label, max_rate FROM {snapshots}", "max_rate", ("label",))}),
    Operator("agg35_phase_counts", ("AGG35", "WIN07"), lambda d: """
        SELECT project_id, parent_id, phases FROM (
          SELECT project_id, parent_id, count(*) OVER (PARTITION BY coalesce(parent_id, -project_id)) AS phases,
                 row_number() OVER (PARTITION BY coalesce(parent_id, -project_id) ORDER BY coalesce(total_price, 0) DESC, project_id) AS rn FROM {projects} WHERE status <> 'P') t WHERE rn = 1"""),
    Operator("agg36_backfill_counters", ("AGG36",), lambda d: "SELECT CASE WHEN lat IS NULL THEN 'no_location' WHEN total_price IS NULL THEN 'weak' ELSE 'updated' END AS outcome, count(*) AS n FROM {projects} GROUP BY 1"),
    Operator("snk03_batch_report", ("SNK03", "AGG27"), lambda d: """
        SELECT coalesce(document_type, 'unknown') AS document_type, status, count(*) AS files, round(sum(cost), 4) AS cost, max(retry_count) AS most_retries, min(file_id) AS first_file
        FROM {downloads} GROUP BY coalesce(document_type, 'unknown'), status ORDER BY files DESC, document_type, status"""),
    Operator("ext_rollup_sales", ("EXT",), lambda d: "SELECT district, status, count(*) AS n, round(sum(total_price), 2) AS total FROM {projects} GROUP BY GROUPING SETS ((district, status), (district), ())"),
]
