"""Explanations of a project's scores: sentences and factor lists from its amenities, in their order, and a summary.

Every amenity becomes a sentence or none by a rule; a project's sentences are gathered in order and the first three shown.
A project's rows are as many as its kinds of amenity and radii.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators.records import Rule

# Shares of completion, good counts and distances (km), names, amenities whose absence is told, and the words for scores.
STRONG, WEAK, SHOWN = 0.70, 0.30, 3
GOOD_COUNT = {"school": 3, "hospital": 2, "grocery_convenience": 2, "supermarket": 1, "pharmacy": 2, "transit_stop": 3, "bank_atm": 1, "park_playground": 1, "restaurant_cafe": 2}
GOOD_KM = {"school": 3.0, "hospital": 5.0, "grocery_convenience": 1.5, "supermarket": 3.0, "pharmacy": 2.0, "transit_stop": 2.0, "bank_atm": 2.0, "park_playground": 2.0}
OTHER_COUNT, OTHER_KM = 2, 3.0
NAMES = {
    "school": "Schools", "hospital": "Hospitals", "grocery_convenience": "Grocery stores", "supermarket": "Supermarkets", "pharmacy": "Pharmacies", "transit_stop": "Transit stops", "bank_atm": "Banks/ATMs",
    "park_playground": "Parks", "restaurant_cafe": "Restaurants/Cafés", "college_university": "Colleges", "mall": "Malls", "internal_roads": "Internal roads", "water_supply": "Water supply", "sewerage": "Sewerage",
    "electricity": "Electricity", "clubhouse": "Clubhouse", "park": "Park", "swimming_pool": "Swimming pool", "gymnasium": "Gymnasium", "parking": "Parking",
}
KEY_ONSITE = ("internal_roads", "water_supply", "sewerage", "electricity", "parking")
LOCATION_WORDS, AMENITY_WORDS = ((75, "excellent"), (50, "good"), (30, "moderate"), (None, "limited")), ((75, "strong"), (50, "moderate"), (30, "basic"), (None, "limited"))


def _of(values: dict, key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), otherwise)


def _fixed(value: Column, digits: int) -> Column:
    """A number with so many digits; halves go up."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def _word(score: Column, words: tuple) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, word in words:
        out = out.when(score >= least, word) if least is not None else out.otherwise(word)
    return out


def onsite_verdicts(stats: DataFrame) -> DataFrame:
    """project_id, place, kind, good, text of the amenities on site (no radius); ``onsite_details`` is JSON, ``place`` their order."""
    name = _of(NAMES, F.col("amenity_type"), F.initcap(F.replace(F.col("amenity_type"), F.lit("_"), F.lit(" "))))
    at = lambda key: F.get_json_object("onsite_details", f"$.{key}").try_cast("double")
    given = F.coalesce(at("progress"), at("completion_percentage"))
    share = F.when(given > 1, given / 100).otherwise(given)
    percent = (share * 100).cast("int").cast("string")
    here = F.coalesce("onsite_available", F.lit(False))
    good = F.when(here & (share.isNull() | (share >= STRONG)), True).when(here & (share < WEAK), False).when(~here & F.col("amenity_type").isin(*KEY_ONSITE), False)
    text = (
        F.when(~here, F.concat(name, F.lit(" not available")))
        .when(share.isNull(), F.concat(name, F.lit(" available")))
        .when(share >= STRONG, F.concat(name, F.lit(" available ("), percent, F.lit("% complete)")))
        .otherwise(F.concat(name, F.lit(" reported but only "), percent, F.lit("% complete")))
    )
    return stats.where("radius_km IS NULL").select("project_id", "place", F.col("amenity_type").alias("kind"), good.alias("good"), text.alias("text")).where("good IS NOT NULL")


def nearby_verdicts(stats: DataFrame) -> DataFrame:
    """project_id, place, kind, good, text of each kind of amenity nearby, by its smallest radius; a radius of 0 that comes first stands."""
    row = F.struct("radius_km", "nearby_count", "nearby_nearest_km")
    kinds = stats.where("radius_km IS NOT NULL").groupBy("project_id", F.col("amenity_type").alias("kind")).agg(
        F.min("place").alias("place"), F.min_by(row, "place").alias("first"), F.min_by(row, F.when(F.col("radius_km") != 0, F.struct("radius_km", "place"))).alias("least")
    )
    best = F.when(F.col("first.radius_km") == 0, F.col("first")).otherwise(F.col("least"))
    kinds = kinds.select("project_id", "place", "kind", best.alias("b"))
    name = F.lower(_of(NAMES, F.col("kind"), F.initcap(F.replace(F.col("kind"), F.lit("_"), F.lit(" ")))))
    count, nearest, radius = F.coalesce("b.nearby_count", F.lit(0)), F.col("b.nearby_nearest_km"), F.col("b.radius_km")
    many = count >= _of(GOOD_COUNT, F.col("kind"), F.lit(OTHER_COUNT))
    far = (count == 1) & (nearest.cast("double") > _of(GOOD_KM, F.col("kind"), F.lit(OTHER_KM)))
    good = F.when(many, True).when((count == 0) | far, False)
    n = count.cast("string")
    text = (
        F.when(many & nearest.isNotNull(), F.concat(n, F.lit(" "), name, F.lit(" within "), _fixed(radius, 0), F.lit("km; nearest "), _fixed(nearest, 1), F.lit("km")))
        .when(many, F.concat(n, F.lit(" "), name, F.lit(" nearby")))
        .when(count == 0, F.concat(F.lit("No "), name, F.lit(" within "), _fixed(radius, 0), F.lit("km")))
        .otherwise(F.concat(F.lit("Only 1 "), name, F.lit(" (~"), _fixed(nearest, 1), F.lit("km away)")))
    )
    return kinds.select("project_id", "place", "kind", good.alias("good"), text.alias("text")).where("good IS NOT NULL")


def explanations(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """project_id, summary, positives, negatives, onsite_strong, onsite_weak, location_strong, location_weak.

    ``scores``: a row for each project with location_score, amenity_score, score_status and score_status_reason (JSON); rows whose
    scores are missing or ``insufficient_data`` say why. ``stats``: project_id, place, amenity_type, radius_km, onsite_available,
    onsite_details, nearby_count, nearby_nearest_km. What is nearby comes before what is on site.
    """
    verdicts = nearby_verdicts(stats).withColumn("side", F.lit(0)).unionByName(onsite_verdicts(stats).withColumn("side", F.lit(1)))
    told = verdicts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("side", "place", "kind", "good", "text"))).alias("told"))
    rows = scores.join(told, "project_id", "left").withColumn("told", F.coalesce("told", F.filter(F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast(stats.schema["place"].dataType).alias("place"), F.lit("").alias("kind"), F.lit(True).alias("good"), F.lit("").alias("text"))), lambda _: F.lit(False))))
    known = F.coalesce(F.col("score_status") != "insufficient_data", F.lit(True)) & (F.col("location_score").isNotNull() | F.col("amenity_score").isNotNull() | F.col("score_status").isNotNull())
    location, amenity = _word(F.col("location_score"), LOCATION_WORDS), _word(F.col("amenity_score"), AMENITY_WORDS)
    summary = F.nullif(F.concat_ws(", ", F.concat(F.initcap(location), F.lit(" location")), F.concat(amenity, F.lit(" onsite infrastructure"))), F.lit(""))
    reason = F.col("score_status_reason")
    listed = F.coalesce(F.from_json(reason, "array<string>"), F.map_values(F.from_json(reason, "map<string,string>")))
    why = F.coalesce(F.when(reason.rlike(r"^\s*[\[{]"), F.nullif(F.array_join(listed, ", "), F.lit(""))), F.nullif(reason, F.lit("")), F.lit("Missing amenity or location context data"))
    none = F.array().cast("array<string>")
    texts = lambda good: F.slice(F.transform(F.filter("told", lambda t: t["good"] == good), lambda t: t["text"]), 1, SHOWN)
    kinds = lambda side, good: F.when(known, F.transform(F.filter("told", lambda t: (t["side"] == side) & (t["good"] == good)), lambda t: t["kind"])).otherwise(none)
    return rows.select(
        "project_id",
        F.when(known, F.coalesce(summary, F.lit("Score calculated with available data"))).otherwise("Not enough data to explain score").alias("summary"),
        F.when(known, texts(True)).otherwise(none).alias("positives"),
        F.when(known, texts(False)).otherwise(F.array(why)).alias("negatives"),
        kinds(1, True).alias("onsite_strong"), kinds(1, False).alias("onsite_weak"), kinds(0, True).alias("location_strong"), kinds(0, False).alias("location_weak"),
    )


AMENITIES = """SELECT l_orderkey AS project_id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS place, CASE l_partkey % 11 WHEN 0 THEN 'school' WHEN 1 THEN 'hospital' WHEN 2 THEN 'bank_atm' WHEN 3 THEN 'water_supply' WHEN 4 THEN 'parking' WHEN 5 THEN 'clubhouse' WHEN 6 THEN 'pharmacy'
        WHEN 7 THEN 'rain_water' WHEN 8 THEN 'sewerage' WHEN 9 THEN 'park' ELSE 'mall' END AS amenity_type,
    CASE l_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 10 END AS radius_km, CASE l_suppkey % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS onsite_available,
    CASE l_suppkey % 9 WHEN 2 THEN '{"progress": 0.57}' WHEN 3 THEN '{"progress": 85}' WHEN 4 THEN '{"progress": 0.29}' WHEN 5 THEN '{"completion_percentage": 12}' WHEN 6 THEN '{"progress": null, "completion_percentage": 70}' WHEN 7 THEN '{"note": 1}' END AS onsite_details,
    CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE l_suppkey % 5 - 1 END AS nearby_count, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 60 / 10.0e0 + 0.02e0 END AS nearby_nearest_km FROM {lineitem}"""
SCORES = """SELECT o_orderkey AS project_id, CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE o_orderkey * 7 % 101 END AS location_score, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE o_orderkey * 11 % 101 END AS amenity_score,
    CASE o_orderkey % 8 WHEN 0 THEN 'insufficient_data' ELSE 'ok' END AS score_status, CASE o_orderkey % 3 WHEN 0 THEN '["no onsite", "no map"]' WHEN 1 THEN NULL ELSE '{"a": "nothing"}' END AS score_status_reason FROM {orders}"""
BOTH = f"""SELECT s.project_id, s.location_score, s.amenity_score, s.score_status, s.score_status_reason, a.place, a.amenity_type, a.radius_km, a.onsite_available, a.onsite_details, a.nearby_count, a.nearby_nearest_km
    FROM ({SCORES}) s LEFT JOIN ({AMENITIES}) a ON a.project_id = s.project_id"""


def _explained(x: DataFrame) -> DataFrame:
    scores = x.select("project_id", "location_score", "amenity_score", "score_status", "score_status_reason").distinct()
    out = explanations(scores, x.where("place IS NOT NULL"))
    return out.select("project_id", "summary", *(F.array_join(c, "|").alias(c) for c in ("positives", "negatives", "onsite_strong", "onsite_weak", "location_strong", "location_weak")))


EXPLAINED_CHECK = r"""
, n AS (SELECT * FROM (VALUES ('school', 'Schools', 3, 3.0), ('hospital', 'Hospitals', 2, 5.0), ('bank_atm', 'Banks/ATMs', 1, 2.0), ('pharmacy', 'Pharmacies', 2, 2.0), ('water_supply', 'Water supply', 2, 3.0), ('parking', 'Parking', 2, 3.0),
    ('clubhouse', 'Clubhouse', 2, 3.0), ('rain_water', 'Rain Water', 2, 3.0), ('sewerage', 'Sewerage', 2, 3.0), ('park', 'Park', 2, 3.0), ('mall', 'Malls', 2, 3.0)) t(kind, name, many, far)),
d AS (SELECT x.*, n.*, coalesce(onsite_available, false) AS here, CAST(json_extract_string(onsite_details, '$.progress') AS DOUBLE) AS p1, CAST(json_extract_string(onsite_details, '$.completion_percentage') AS DOUBLE) AS p2
      FROM x JOIN n ON n.kind = x.amenity_type),
o AS (SELECT *, coalesce(CASE WHEN p1 > 1 THEN p1 / 100 ELSE p1 END, CASE WHEN p2 > 1 THEN p2 / 100 ELSE p2 END) AS p FROM d WHERE radius_km IS NULL),
onsite AS (
  SELECT project_id, 1 AS side, place, kind, CASE WHEN here THEN p IS NULL OR p >= 0.7e0 ELSE false END AS good,
         CASE WHEN NOT here THEN name || ' not available' WHEN p IS NULL THEN name || ' available' WHEN p >= 0.7e0 THEN name || ' available (' || CAST(CAST(trunc(p * 100) AS INTEGER) AS VARCHAR) || '% complete)'
              ELSE name || ' reported but only ' || CAST(CAST(trunc(p * 100) AS INTEGER) AS VARCHAR) || '% complete' END AS text
  FROM o WHERE CASE WHEN here THEN p IS NULL OR p >= 0.7e0 OR p < 0.3e0 ELSE kind IN ('internal_roads', 'water_supply', 'sewerage', 'electricity', 'parking') END),
b AS (SELECT *, min(place) OVER (PARTITION BY project_id, kind) AS began, coalesce(nearby_count, 0) AS c FROM d WHERE radius_km IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY radius_km, place) = 1),
nearby AS (
  SELECT project_id, 0 AS side, began AS place, kind, c >= many AS good,
         CASE WHEN c >= many AND nearby_nearest_km IS NOT NULL THEN c || ' ' || lower(name) || ' within ' || radius_km || 'km; nearest ' || printf('%.1f', nearby_nearest_km) || 'km' WHEN c >= many THEN c || ' ' || lower(name) || ' nearby'
              WHEN c = 0 THEN 'No ' || lower(name) || ' within ' || radius_km || 'km' ELSE 'Only 1 ' || lower(name) || ' (~' || printf('%.1f', nearby_nearest_km) || 'km away)' END AS text
  FROM b WHERE c >= many OR c = 0 OR (c = 1 AND nearby_nearest_km > far)),
v AS (SELECT *, row_number() OVER (PARTITION BY project_id, good ORDER BY side, place) AS r FROM (SELECT * FROM onsite UNION ALL SELECT * FROM nearby)),
g AS (
  SELECT project_id, string_agg(text, '|' ORDER BY r) FILTER (WHERE good AND r <= 3) AS positives, string_agg(text, '|' ORDER BY r) FILTER (WHERE NOT good AND r <= 3) AS negatives,
         string_agg(kind, '|' ORDER BY r) FILTER (WHERE good AND side = 1) AS os, string_agg(kind, '|' ORDER BY r) FILTER (WHERE NOT good AND side = 1) AS ow,
         string_agg(kind, '|' ORDER BY r) FILTER (WHERE good AND side = 0) AS ls, string_agg(kind, '|' ORDER BY r) FILTER (WHERE NOT good AND side = 0) AS lw FROM v GROUP BY project_id),
s AS (SELECT DISTINCT project_id, location_score AS l, amenity_score AS a, score_status = 'insufficient_data' AS poor FROM x)
SELECT s.project_id,
       CASE WHEN poor THEN 'Not enough data to explain score' WHEN l IS NULL AND a IS NULL THEN 'Score calculated with available data' ELSE concat_ws(', ',
         CASE WHEN l >= 75 THEN 'Excellent location' WHEN l >= 50 THEN 'Good location' WHEN l >= 30 THEN 'Moderate location' WHEN l IS NOT NULL THEN 'Limited location' END,
         CASE WHEN a >= 75 THEN 'strong onsite infrastructure' WHEN a >= 50 THEN 'moderate onsite infrastructure' WHEN a >= 30 THEN 'basic onsite infrastructure' WHEN a IS NOT NULL THEN 'limited onsite infrastructure' END) END AS summary,
       CASE WHEN poor THEN '' ELSE coalesce(positives, '') END AS positives,
       CASE WHEN poor THEN CASE s.project_id % 3 WHEN 0 THEN 'no onsite, no map' WHEN 1 THEN 'Missing amenity or location context data' ELSE 'nothing' END ELSE coalesce(negatives, '') END AS negatives,
       CASE WHEN poor THEN '' ELSE coalesce(os, '') END AS onsite_strong, CASE WHEN poor THEN '' ELSE coalesce(ow, '') END AS onsite_weak,
       CASE WHEN poor THEN '' ELSE coalesce(ls, '') END AS location_strong, CASE WHEN poor THEN '' ELSE coalesce(lw, '') END AS location_weak
FROM s LEFT JOIN g ON g.project_id = s.project_id"""

RULES = [Rule("scr06_explanations", ("SCR06",), BOTH, _explained, EXPLAINED_CHECK)]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
