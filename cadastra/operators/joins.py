"""Joins: outer chains, semi and anti joins, self joins, and grid-cell joins in place of spatial nested loops.

A radius join puts both sides on a grid whose cells are at least one radius wide (in longitude at the highest latitude
that occurs), gives the smaller side's rows to the nine cells around them, joins on the cell, and tests the distance.
"""

from __future__ import annotations

import math

from cadastra.functions.geo import KM_PER_DEGREE, haversine
from cadastra.plans.operator import Operator


def grid(radius_km: float, max_lat: float) -> tuple[float, float]:
    """Cell height and width in degrees. A margin covers the difference between the degree's length and the sphere's."""
    height = radius_km / KM_PER_DEGREE * 1.01
    return height, height / math.cos(math.radians(max_lat))


def radius_join(left: str, right: str, left_cols: str, right_cols: str, radius_km: float, max_lat: float = 40.0, where: str = "TRUE") -> str:
    """SELECT of ``left_cols`` (of l), ``right_cols`` (of r) and km for all pairs within the radius."""
    h, w = grid(radius_km, max_lat)
    cell = lambda x, size: f"CAST(floor({x} / {size!r}e0) AS BIGINT)"
    around = " UNION ALL ".join(f"SELECT {i} AS di, {j} AS dj" for i in (-1, 0, 1) for j in (-1, 0, 1))
    return f"""
        SELECT * FROM (
          SELECT {left_cols}, {right_cols}, {haversine('l.lat', 'l.lon', 'r.lat', 'r.lon')} AS km
          FROM (SELECT *, {cell('lat', h)} AS ci, {cell('lon', w)} AS cj FROM {left} WHERE lat IS NOT NULL AND lon IS NOT NULL) l
          JOIN (SELECT x.*, {cell('x.lat', h)} + n.di AS ci, {cell('x.lon', w)} + n.dj AS cj FROM {right} x CROSS JOIN ({around}) n
                WHERE x.lat IS NOT NULL AND x.lon IS NOT NULL) r ON l.ci = r.ci AND l.cj = r.cj
          WHERE {where}) pairs
        WHERE km <= {radius_km}"""


def landmark_links(radius_km: float, parts: int = 16) -> str:
    """Spark's statement of the nearest distance of every project and landmark within the radius: no pair is shuffled but those of repeated ids.

    Projects of one place are compared together, in ``parts`` lists, and named last. Where project and landmark have one place each, a pair is a row.
    """
    pairs = lambda where: radius_join("homes", "places", "l.ids", "r.landmark_id, r.importance", radius_km, where=where)
    return f"""
        WITH homes AS (
          SELECT lat, lon, single, collect_list(named_struct('project_id', project_id)) AS ids FROM (
            SELECT project_id, lat, lon, count(*) OVER (PARTITION BY project_id) = 1 AS single
            FROM (SELECT DISTINCT project_id, lat, lon FROM (SELECT /*+ REPARTITION(project_id) */ project_id, lat, lon FROM {{projects}} WHERE lat IS NOT NULL AND lon IS NOT NULL) a) b) c
          GROUP BY lat, lon, single, pmod(xxhash64(project_id), {parts})),
        places AS (
          SELECT landmark_id, lat, lon, importance, count(*) OVER (PARTITION BY landmark_id) = 1 AS single
          FROM (SELECT DISTINCT landmark_id, lat, lon, importance FROM {{landmarks}} WHERE is_active AND lat IS NOT NULL AND lon IS NOT NULL) d)
        SELECT project_id, landmark_id, distance_km, is_highlighted
        FROM (SELECT ids, landmark_id, round(km, 2) AS distance_km, importance >= 90 AS is_highlighted FROM ({pairs('l.single AND r.single')}) t) u LATERAL VIEW inline(ids) v AS project_id
        UNION ALL
        SELECT project_id, landmark_id, round(min(km), 2) AS distance_km, max(importance) >= 90 AS is_highlighted
        FROM ({pairs('NOT l.single')} UNION ALL {pairs('l.single AND NOT r.single')}) t LATERAL VIEW inline(ids) v AS project_id
        GROUP BY project_id, landmark_id"""


OPERATORS = [
    Operator("jn02_projects_with_scores", ("JN02", "SRT03"), lambda d: "SELECT p.project_id, p.project_name, s.overall_score FROM {projects} p JOIN {scores} s ON s.project_id = p.project_id WHERE s.overall_score IS NOT NULL ORDER BY s.overall_score DESC, p.project_name, p.project_id LIMIT 40"),
    Operator("jn04_active_tags", ("JN04",), lambda d: "SELECT pt.project_id, t.slug, t.category FROM {project_tags} pt JOIN {tags} t ON t.slug = pt.slug WHERE t.is_active"),
    Operator("jn05_project_landmarks", ("JN05", "SRT07"), lambda d: f"""
        SELECT landmark_id, project_id, distance_km, CAST(place AS BIGINT) AS place FROM (
          SELECT landmark_id, project_id, round(km, 4) AS distance_km, row_number() OVER (PARTITION BY landmark_id ORDER BY km, project_id) AS place
          FROM ({radius_join('{projects}', '(SELECT * FROM {landmarks} WHERE is_active)', 'l.project_id', 'r.landmark_id', 10)}) t) ranked WHERE place <= 5"""),
    Operator("jn06_developer_siblings", ("JN06",), lambda d: "SELECT DISTINCT a.project_id, b.project_id AS sibling_id FROM {developers} a JOIN {developers} b ON b.developer_id = a.developer_id AND b.project_id <> a.project_id"),
    Operator("jn07_parent_siblings", ("JN07",), lambda d: "SELECT a.project_id, b.project_id AS sibling_id FROM {projects} a JOIN {projects} b ON b.parent_id = a.parent_id AND b.project_id <> a.project_id"),
    Operator("jn08_without_stats", ("JN08",), lambda d: "SELECT p.project_id FROM {projects} p WHERE p.lat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {amenity_stats} s WHERE s.project_id = p.project_id)"),
    Operator("jn09_stats_without_scores", ("JN09",), lambda d: "SELECT project_id FROM {amenity_stats} s WHERE NOT EXISTS (SELECT 1 FROM {scores} c WHERE c.project_id = s.project_id) GROUP BY project_id"),
    Operator("jn10_without_embedding", ("JN10",), lambda d: "SELECT p.project_id FROM {projects} p LEFT JOIN {embeddings} e ON e.vec_id = p.project_id WHERE e.vec_id IS NULL"),
    Operator("jn11_without_geocode", ("JN11",), lambda d: "SELECT p.project_id FROM {projects} p LEFT JOIN {locations} l ON l.project_id = p.project_id AND l.source_type = 'geocode_normalized' WHERE l.location_id IS NULL"),
    Operator("jn12_tag_and_verified", ("JN12", "SET02"), lambda d: """
        SELECT p.project_id FROM {projects} p
        WHERE p.project_id IN (SELECT project_id FROM {project_tags} WHERE slug IN ('Brand#1', 'Brand#2'))
          AND p.project_id IN (SELECT project_id FROM {verifications} WHERE is_current AND status = 'VERIFIED')"""),
    Operator("jn13_landmark_links", ("JN13",), lambda d: landmark_links(10) if d.name == "spark" else f"""
        SELECT project_id, landmark_id, round(min(km), 2) AS distance_km, max(importance) >= 90 AS is_highlighted
        FROM ({radius_join('{projects}', '(SELECT * FROM {landmarks} WHERE is_active)', 'l.project_id', 'r.landmark_id, r.importance', 10)}) t
        GROUP BY project_id, landmark_id"""),
    Operator("jn14_poi_in_radius", ("JN14", "AGG13", "R1", "R2"), lambda d: f"""
        SELECT project_id, amenity_type, count(CASE WHEN km <= 1 THEN 1 END) AS within_1, count(CASE WHEN km <= 3 THEN 1 END) AS within_3,
               count(CASE WHEN km <= 10 THEN 1 END) AS within_10, round(min(km), 3) AS nearest_km
        FROM ({radius_join('{projects}', '{poi}', 'l.project_id', 'r.poi_id, r.amenity_type', 10)}) t
        GROUP BY project_id, amenity_type"""),
    # zero rows too: every located project with each kind and radius (the cross join is with twelve literals)
    Operator("agg13_poi_counts_dense", ("AGG13", "JN14"), lambda d: f"""
        SELECT p.project_id, t.amenity_type, t.radius_km, coalesce(c.n, 0) AS nearby_count, c.nearest_km
        FROM {{projects}} p CROSS JOIN ({' UNION ALL '.join(f"SELECT '{k}' AS amenity_type, {r} AS radius_km" for k in ('grocery', 'school', 'hospital', 'bank') for r in (1, 3, 10))}) t
        LEFT JOIN (SELECT project_id, amenity_type, radius_km, count(*) AS n, round(min(km), 3) AS nearest_km
                   FROM ({radius_join('{projects}', '{poi}', 'l.project_id', 'r.poi_id, r.amenity_type', 10)}) x JOIN (SELECT 1 AS radius_km UNION ALL SELECT 3 UNION ALL SELECT 10) r ON x.km <= r.radius_km
                   GROUP BY project_id, amenity_type, radius_km) c ON c.project_id = p.project_id AND c.amenity_type = t.amenity_type AND c.radius_km = t.radius_km
        WHERE p.lat IS NOT NULL AND p.lon IS NOT NULL"""),
    Operator("jn15_children_preaggregated", ("JN15",), lambda d: """
        SELECT p.project_id, coalesce(u.units, 0) AS units, coalesce(v.checks, 0) AS checks FROM {projects} p
        LEFT JOIN (SELECT project_id, count(*) AS units FROM {units} GROUP BY project_id) u ON u.project_id = p.project_id
        LEFT JOIN (SELECT project_id, count(*) AS checks FROM {verifications} GROUP BY project_id) v ON v.project_id = p.project_id"""),
    Operator("jn16_case_folded_lookup", ("JN16", "DML03"), lambda d: "SELECT upper(trim(name)) AS k, upper(segment) AS s, min(parent_id) AS parent_id, count(*) AS n FROM {parents} GROUP BY upper(trim(name)), upper(segment)"),
    Operator("jn17_natural_key", ("JN17",), lambda d: "SELECT o.project_id AS old_id, n.project_id AS new_id, coalesce(o.reg_no, n.reg_no) AS reg_no FROM (SELECT * FROM {projects} WHERE status <> 'P') o FULL OUTER JOIN (SELECT * FROM {projects} WHERE total_price IS NOT NULL) n ON n.state_code = o.state_code AND n.reg_no = o.reg_no"),
    Operator("jn18_inventory_merge", ("JN18",), lambda d: """
        SELECT coalesce(t.project_id, g.project_id) AS project_id, coalesce(t.unit_no, g.unit_no) AS unit_no, t.block, coalesce(g.status, t.status) AS status,
               CASE WHEN t.project_id IS NULL THEN 'new' WHEN g.project_id IS NULL THEN 'table' ELSE 'both' END AS origin
        FROM (SELECT project_id, unit_no, block, max(status) AS status FROM {units} WHERE block <> 'R' GROUP BY project_id, unit_no, block) t
        FULL OUTER JOIN (SELECT project_id, unit_no, max(lower(status)) AS status FROM {units} WHERE block = 'R' GROUP BY project_id, unit_no) g
          ON g.project_id = t.project_id AND g.unit_no = t.unit_no"""),
    Operator("jn19_metadata_lookup", ("JN19",), lambda d: "SELECT s.project_id, p.project_name, coalesce(p.district, p.state_code) AS place FROM {scores} s JOIN {projects} p ON p.project_id = s.project_id WHERE s.overall_score >= 95"),
    Operator("jn20_header_dictionary", ("JN20", "NST08"), lambda d: """
        SELECT e.event_id, coalesce(m.canonical, 'unmapped') AS section FROM {events} e
        LEFT JOIN (SELECT 'click' AS k, 'project_details' AS canonical UNION ALL SELECT 'view', 'promoter_details' UNION ALL SELECT 'signup', 'land_details') m ON m.k = e.event_type"""),
]
