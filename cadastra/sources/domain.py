"""The registry's relations as projections of the order, part, event and document tables.

Each is one SELECT that both dialects understand; missing values are put in by rules on the keys, so that the rules for
nulls have rows to act on.
"""

from __future__ import annotations

from collections.abc import Callable

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def _fixed(text: str) -> Callable[[object], str]:
    return lambda d: text


RELATIONS: dict[str, Callable[[object], str]] = {
    "parents": _fixed("SELECT c_custkey AS parent_id, c_name AS name, c_mktsegment AS segment FROM {customer}"),
    "projects": _fixed("""
        SELECT o.o_orderkey AS project_id, CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_custkey END AS parent_id,
               c.c_name || ' ' || CAST(o.o_orderkey % 97 AS VARCHAR(10)) AS project_name, 'RG' || CAST(o.o_orderkey AS VARCHAR(20)) AS reg_no,
               o.o_orderstatus AS status, n.n_name AS district, r.r_name AS state_code, o.o_orderpriority AS project_type,
               CAST(o.o_orderdate AS DATE) AS approved_date, CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(o.o_totalprice AS DOUBLE) END AS total_price,
               CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 17 + (o.o_orderkey * 37 % 7000) / 1000.0e0 END AS lat,
               CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 80 + (o.o_orderkey * 91 % 4000) / 1000.0e0 END AS lon
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
        JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey"""),
    "scores": _fixed("""
        SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey * 31 % 101 AS DOUBLE) END AS overall_score,
               CAST(o_orderkey * 17 % 101 AS DOUBLE) AS location_score, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey * 13 % 101 AS DOUBLE) END AS amenity_score,
               CASE WHEN o_orderkey % 9 = 0 THEN 'insufficient_data' WHEN o_orderkey % 4 = 0 THEN 'partial' ELSE 'ok' END AS score_status
        FROM {orders} WHERE o_orderpriority <> '4-NOT SPECIFIED'"""),
    "snapshots": _fixed("""
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS snapshot_id, l_orderkey AS project_id, CAST(l_shipdate AS DATE) AS snapshot_date,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS label, l_linestatus = 'O' AS is_active,
               CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS min_price, l_extendedprice AS max_price,
               CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) / l_quantity END AS min_rate,
               CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS max_rate
        FROM {lineitem}"""),
    "locations": _fixed("""
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS location_id, l_orderkey AS project_id,
               CASE l_linenumber % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'geocode_normalized' WHEN 2 THEN 'source_page' ELSE 'centroid' END AS source_type,
               CASE l_suppkey % 3 WHEN 0 THEN 'rooftop' WHEN 1 THEN 'street' ELSE 'locality' END AS precision_level,
               17 + (l_partkey % 7000) / 1000.0e0 AS lat, 80 + (l_suppkey * 7 % 4000) / 1000.0e0 AS lon,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount * 10 END AS confidence, CAST(l_shipdate AS DATE) AS updated_at, l_returnflag <> 'R' AS is_active
        FROM {lineitem}"""),
    "tags": _fixed("""
        SELECT p_brand AS slug, min(p_type) AS category, min(p_partkey) AS sort_order, min(p_size) <= 3 AS is_featured, min(p_partkey) % 9 <> 0 AS is_active
        FROM {part} GROUP BY p_brand"""),
    "project_tags": _fixed("SELECT DISTINCT l.l_orderkey AS project_id, p.p_brand AS slug FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey"),
    "landmarks": _fixed("""
        SELECT s_suppkey AS landmark_id, s_name AS name, 17 + (s_suppkey * 613 % 7000) / 1000.0e0 AS lat, 80 + (s_suppkey * 257 % 4000) / 1000.0e0 AS lon,
               s_suppkey * 29 % 101 AS importance, s_suppkey % 6 <> 0 AS is_active
        FROM {supplier}"""),
    "poi": _fixed("""
        SELECT s_suppkey AS poi_id, CASE s_suppkey % 4 WHEN 0 THEN 'grocery' WHEN 1 THEN 'school' WHEN 2 THEN 'hospital' ELSE 'bank' END AS amenity_type,
               17 + (s_suppkey * 411 % 7000) / 1000.0e0 AS lat, 80 + (s_suppkey * 359 % 4000) / 1000.0e0 AS lon
        FROM {supplier}"""),
    "amenity_stats": _fixed("""
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS stat_id, l_orderkey AS project_id,
               CASE l_suppkey % 6 WHEN 0 THEN 'grocery' WHEN 1 THEN 'school' WHEN 2 THEN 'hospital' WHEN 3 THEN 'bank' WHEN 4 THEN 'transit' ELSE 'pharmacy' END AS amenity_type,
               CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.0e0 WHEN 2 THEN 3.0e0 ELSE 10.0e0 END AS radius_km,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 12 END AS nearby_count,
               CASE WHEN l_linenumber % 4 = 0 OR CAST(l_quantity AS BIGINT) % 12 = 0 THEN NULL ELSE l_discount * 30 END AS nearest_km,
               CASE WHEN l_linenumber % 4 = 0 THEN l_linestatus = 'O' ELSE FALSE END AS onsite_available
        FROM {lineitem}"""),
    "verifications": _fixed("""
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS verification_id, l_orderkey AS project_id,
               CASE l_returnflag WHEN 'A' THEN 'VERIFIED' WHEN 'R' THEN 'REVOKED' ELSE 'PENDING' END AS status,
               CAST(l_shipdate AS DATE) AS verified_at, l_linestatus = 'O' AS is_current
        FROM {lineitem}"""),
    "units": _fixed("""
        SELECT l_orderkey AS project_id, l_returnflag AS block, l_linenumber AS unit_no, 'T' || CAST(l_partkey % 4 AS VARCHAR(5)) AS unit_type,
               CASE WHEN l_linestatus = 'O' THEN 'Available' WHEN l_linenumber % 3 = 0 THEN 'SOLD' WHEN l_linenumber % 3 = 1 THEN 'booked' ELSE NULL END AS status,
               CASE WHEN l_linenumber = 5 THEN 0.0e0 ELSE l_quantity * 10 END AS area
        FROM {lineitem}"""),
    "usage": _fixed("""
        SELECT event_id, user_id AS client, event_type AS endpoint, CASE user_id % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'premium' ELSE 'standard' END AS tier,
               value AS ms, CASE WHEN event_id % 9 = 0 THEN 500 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status_code, ts
        FROM {events}"""),
    "filings": lambda d: f"""
        SELECT event_id AS filing_id, user_id AS project_id, CASE WHEN event_id % 97 = 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
               CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE CAST({d.json_int('props', 'k')} AS VARCHAR(20)) END AS completion_text, CAST(ts AS DATE) AS processed_at
        FROM {{events}}""",
    "downloads": _fixed("""
        SELECT event_id AS file_id, user_id AS project_id, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'done' ELSE 'pending' END AS status,
               event_id % 4 AS retry_count, ts AS created_at, event_type AS document_type, value AS cost
        FROM {events}"""),
    "developers": _fixed("SELECT DISTINCT l_suppkey * 1000 + l_partkey % 997 AS developer_id, l_orderkey AS project_id FROM {lineitem}"),
}
