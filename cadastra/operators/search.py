"""The project search with its parameters, and the amenity scores with theirs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.salvage import at_path
from cadastra.operators.records import Rule
from cadastra.plans.operator import Operator

FAR = float("inf")


def value_score(overall: Column, price: Column, usual: float = 5_000_000.0) -> Column:
    """0 to 100: 60 parts of score, 40 of how far the price is below twice the usual one."""
    value = 60 * F.greatest(F.lit(0.0), F.least(overall, F.lit(100.0))) / 100 + 40 * (1 - F.greatest(F.lit(0.0), F.least(price / usual, F.lit(2.0))) / 2)
    return F.when(overall.isNotNull() & price.isNotNull(), value)  # greatest() and least() pass over nulls


def sort_key(by: str) -> Column:
    """What a hit is ordered by; a missing distance or price counts as infinite, a missing score as 0."""
    score = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    price = F.when(F.col("min_price") != 0, F.col("min_price").cast("double"))
    return {
        "distance": F.coalesce(F.col("distance_km"), F.lit(FAR)),
        "location_score": score("location_score"),
        "amenity_score": score("amenity_score"),
        "registration_date": F.coalesce("approved_date", F.lit("0001-01-01").cast("date")),
        "price": F.coalesce(price, F.lit(FAR)),
        "value_score": F.coalesce(value_score(F.col("overall_score").cast("double"), price), F.lit(0.0)),
        "name": F.lower("project_name"),
    }.get(by, score("overall_score"))


def distance_km(lat: Column, lon: Column, at: tuple[float, float]) -> Column:
    a = F.pow(F.sin(F.radians(lat - at[0]) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(at[0]))) * F.pow(F.sin(F.radians(lon - at[1]) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def search(
    projects: DataFrame,
    statuses: Iterable[str] | None = None,
    districts: Iterable[str] | None = None,
    name: str | None = None,
    box: tuple[float, float, float, float] | None = None,
    near: tuple[float, float] | None = None,
    radius_km: float | None = None,
    price: tuple[float | None, float | None] = (None, None),
    least: dict[str, float] | None = None,
    sort_by: str = "overall_score",
    descending: bool = True,
    page: int = 1,
    size: int = 20,
    tehsil: str | None = None,
    project_types: Iterable[str] | None = None,
    amenities: Iterable[str] | None = None,
    tags: Iterable[str] | None = None,
    match_all: bool = False,
    verified_only: bool = False,
    stats: DataFrame | None = None,
    links: DataFrame | None = None,
    verifications: DataFrame | None = None,
) -> DataFrame:
    """One page of hits, each with its ``total``. ``projects``: the read model's rows (project_id, project_name, status, district, lat,
    lon, approved_date, min_price, max_price and the scores; tehsil and raw, a JSON text, where these are asked for).

    ``tehsil`` is a pattern without regard to case; ``project_types`` are held against project_type in ``raw``; all of ``amenities`` must be on site (``stats``: project_id, kind,
    radius_km, onsite_available); of ``tags`` one, or all with ``match_all``, must be linked (``links``: project_id, slug); ``verified_only`` wants a current
    verification (``verifications``: project_id, status, is_current). Such filters are semi-joins. An empty list asks for nothing.

    The page is a top-k of (sort key, project_id), the total a scalar subquery: no window holds all hits.
    """
    hits = projects.withColumn("distance_km", distance_km(F.col("lat"), F.col("lon"), near) if near else F.lit(None).cast("double"))
    for column, values in (("status", statuses), ("district", districts)):
        if values is not None:
            hits = hits.where(F.col(column).isin(list(values)))
    if name:
        hits = hits.where(F.contains(F.lower("project_name"), F.lit(name.lower())))
    if box:
        hits = hits.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    if near and radius_km is not None:
        hits = hits.where(F.col("distance_km") <= radius_km)
    if price[0] is not None:
        hits = hits.where(F.col("max_price") >= price[0])
    if price[1] is not None:
        hits = hits.where(F.col("min_price") <= price[1])
    for column, value in (least or {}).items():
        hits = hits.where(F.col(column) >= value)
    if tehsil:
        hits = hits.where(F.col("tehsil").ilike(tehsil))
    if types := list(project_types or ()):
        hits = hits.where(at_path(F.col("raw"), "$.project_type").isin(types))
    if wanted := set(amenities or ()):
        onsite = stats.where(F.col("radius_km").isNull() & F.col("onsite_available") & F.col("kind").isin(*wanted))
        hits = hits.join(_holders(onsite, "kind", len(wanted)), "project_id", "left_semi")
    if wanted := set(tags or ()):
        hits = hits.join(_holders(links.where(F.col("slug").isin(*wanted)), "slug", len(wanted) if match_all else 1), "project_id", "left_semi")
    if verified_only:
        hits = hits.join(verifications.where("is_current AND status = 'verified'").select("project_id"), "project_id", "left_semi")
    key = sort_key(sort_by)
    total = hits.agg(F.count(F.lit(1))).scalar()
    ordered = hits.orderBy(key.desc() if descending else key.asc(), "project_id").offset((page - 1) * size).limit(size)
    return ordered.withColumn("total", total)


def _holders(rows: DataFrame, what: str, least: int) -> DataFrame:
    """Projects with at least so many different values."""
    return rows.select("project_id", what).distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("project_id")


@dataclass(frozen=True)
class ScoreConfig:
    """Kinds with the radius that counts, buckets as (count up to, score), and weights."""

    daily: tuple[tuple[str, float], ...] = (("grocery_convenience", 1.0), ("supermarket", 3.0), ("pharmacy", 1.0))
    social: tuple[tuple[str, float], ...] = (("school", 3.0), ("college_university", 5.0), ("hospital", 5.0), ("park_playground", 3.0), ("restaurant_cafe", 3.0), ("mall", 5.0))
    transit: tuple[float, ...] = (3.0, 10.0)
    weights: tuple[float, float, float] = (0.40, 0.35, 0.25)
    transit_weight: float = 0.7


# Scores of counts (up to, score) and of distances.
DAILY = ((0, 20), (2, 60), (4, 80), (5, 100))
SOCIAL = ((0, 20), (2, 60), (5, 80), (6, 100))
TRANSIT = (((0, 20), (2, 60), (5, 80), (6, 100)), ((0, 20), (3, 60), (8, 80), (9, 100)))
BANK = ((1.0, 90), (2.0, 70))


def bucketed(count: Column, buckets: tuple[tuple[int, int], ...]) -> Column:
    count, out = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)), F.lit(float(buckets[-1][1]))
    for upper, score in reversed(buckets):
        out = F.when(count <= upper, float(score)).otherwise(out)
    return out


def amenity_scores(stats: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Scores of every project in ``stats`` (project_id, kind, radius_km, n, km; a null radius is an amenity on site), with status and reasons.

    A kind's count is that of its largest radius up to the target, else of its smallest. One aggregation, whatever the kinds.
    """
    near = lambda kind: (F.col("kind") == kind) & F.col("radius_km").isNotNull()

    def count(kind: str, target: float) -> Column:
        within = F.max_by(F.when(near(kind) & (F.col("radius_km") <= target), F.coalesce("n", F.lit(0))), F.when(near(kind) & (F.col("radius_km") <= target), F.col("radius_km")))
        return F.coalesce(within, F.min_by(F.when(near(kind), F.coalesce("n", F.lit(0))), F.when(near(kind), F.col("radius_km"))))

    wanted = [*config.daily, *config.social, *(("transit_stop", r) for r in config.transit)]
    counts = [count(kind, target).alias(f"c{i}") for i, (kind, target) in enumerate(wanted)]
    bank = F.min_by(F.when(near("bank_atm"), F.col("km")), F.when(near("bank_atm"), F.col("radius_km")))
    rows = stats.groupBy("project_id").agg(*counts, bank.alias("bank_km"), F.count("radius_km").alias("nearby"), F.count_if(F.col("radius_km").isNull()).alias("onsite"))
    at = iter(range(len(wanted)))
    mean = lambda kinds, buckets: sum((bucketed(F.col(f"c{next(at)}"), b) for _, b in zip(kinds, buckets, strict=True)), F.lit(0.0)) / len(kinds)
    daily = mean(config.daily, [DAILY] * len(config.daily))
    social = mean(config.social, [SOCIAL] * len(config.social))
    transit = mean(config.transit, TRANSIT)
    kinds = [k for k, _ in wanted]
    none = lambda kind: F.coalesce(F.col(f"c{kinds.index(kind)}"), F.lit(0)) == 0
    social = F.when(none("hospital") & none("school"), F.least(social, F.lit(70.0))).otherwise(social)
    bank_score = F.lit(30.0)
    for upper, score in reversed(BANK):
        bank_score = F.when(F.col("bank_km") <= upper, float(score)).otherwise(bank_score)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(x.cast("decimal(20,8)"), 0).cast("double")))
    known = F.col("nearby") > 0
    rows = rows.select("project_id", "nearby", "onsite", F.when(known, clamp(daily)).alias("daily"), F.when(known, clamp(social)).alias("social"),
                       F.when(known, clamp(config.transit_weight * transit + (1 - config.transit_weight) * bank_score)).alias("connectivity"))
    a, b, c = config.weights
    rows = rows.withColumn("location_score", F.when(known, clamp(a * F.col("daily") + b * F.col("social") + c * F.col("connectivity"))))
    rows = rows.withColumn("amenity_score", F.when(F.col("onsite") > 0, F.lit(0.0)))
    both = F.col("location_score").isNotNull() & F.col("amenity_score").isNotNull()
    overall = F.when(both, clamp((F.col("location_score") + F.col("amenity_score")) / 2)).otherwise(F.coalesce("location_score", "amenity_score"))
    reason = F.when(both, "").when(F.col("location_score").isNotNull(), "missing_onsite_data").when(F.col("amenity_score").isNotNull(), "missing_nearby_data").otherwise("missing_all_data")
    status = F.when(both, "ok").when(overall.isNull(), "insufficient_data").otherwise("partial")
    return rows.select("project_id", "daily", "social", "connectivity", "location_score", overall.alias("overall_score"), status.alias("score_status"), reason.alias("reason"))


STATS = """SELECT l_orderkey AS project_id, CASE l_partkey % 11 WHEN 0 THEN 'grocery_convenience' WHEN 1 THEN 'supermarket' WHEN 2 THEN 'pharmacy' WHEN 3 THEN 'school' WHEN 4 THEN 'college_university' WHEN 5 THEN 'hospital'
        WHEN 6 THEN 'park_playground' WHEN 7 THEN 'restaurant_cafe' WHEN 8 THEN 'mall' WHEN 9 THEN 'transit_stop' ELSE 'bank_atm' END AS kind,
    CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN 1.0e0 WHEN 2 THEN 3.0e0 WHEN 3 THEN 5.0e0 ELSE 10.0e0 END AS radius_km, max(CAST(l_quantity AS BIGINT) % 12) AS n, min(CAST(l_discount AS DOUBLE) * 30) AS km
    FROM {lineitem} GROUP BY 1, 2, 3"""
HITS = """SELECT p.project_id, p.project_name, p.status, p.district, p.lat, p.lon, p.approved_date, p.total_price AS min_price, p.total_price * 2 AS max_price, s.overall_score, s.location_score, s.amenity_score
    FROM {projects} p LEFT JOIN {scores} s ON s.project_id = p.project_id"""
ORDERS = ("overall_score", "location_score", "amenity_score", "distance", "registration_date", "price", "value_score", "name")


def _all_orders(rows: DataFrame) -> DataFrame:
    """The second page of ten by each sort key, in both directions by turns."""
    out = None
    for i, by in enumerate(ORDERS):
        hits = search(rows, statuses=["O", "F"], near=(20.0, 82.0), radius_km=300.0, least={"overall_score": 20}, sort_by=by, descending=i % 2 == 0, page=2, size=10)
        hits = hits.select(F.lit(by).alias("sort_by"), "project_id", "total")
        out = hits if out is None else out.unionByName(hits)
    return out


def _bucket(x: str, steps: str) -> str:
    pairs = [s.split(":") for s in steps.split()]
    return "CASE " + " ".join(f"WHEN {x} <= {n} THEN {s}" for n, s in pairs[:-1]) + f" ELSE {pairs[-1][1]} END"


def _picked(kind: str, target: float) -> str:
    return f"coalesce((SELECT n FROM x y WHERE y.project_id = p.project_id AND kind = '{kind}' AND radius_km <= {target} ORDER BY radius_km DESC LIMIT 1), (SELECT n FROM x y WHERE y.project_id = p.project_id AND kind = '{kind}' AND radius_km IS NOT NULL ORDER BY radius_km LIMIT 1), 0)"


_D, _S = "0:20 2:60 4:80 5:100", "0:20 2:60 5:80 6:100"
_SOCIAL = [("school", 3), ("college_university", 5), ("hospital", 5), ("park_playground", 3), ("restaurant_cafe", 3), ("mall", 5)]
SCORES_CHECK = f""", p AS (SELECT project_id, count(radius_km) AS near, count(*) - count(radius_km) AS onsite FROM x GROUP BY project_id),
    i AS (SELECT project_id, near, onsite, {_picked('grocery_convenience', 1)} AS g, {_picked('supermarket', 3)} AS m, {_picked('pharmacy', 1)} AS ph, {', '.join(f"{_picked(k, r)} AS {k}" for k, r in _SOCIAL)},
      {_picked('transit_stop', 3)} AS t3, {_picked('transit_stop', 10)} AS t10, (SELECT km FROM x y WHERE y.project_id = p.project_id AND kind = 'bank_atm' AND radius_km IS NOT NULL ORDER BY radius_km LIMIT 1) AS bank FROM p),
    d AS (SELECT project_id, near, onsite, CAST(round_even(CAST(({_bucket('g', _D)} + {_bucket('m', _D)} + {_bucket('ph', _D)}) AS DECIMAL(20, 8)) / 3, 0) AS DOUBLE) AS daily,
      ({' + '.join(_bucket(k, _S) for k, _ in _SOCIAL)}) / 6.0e0 AS social, hospital = 0 AND school = 0 AS bare,
      0.7e0 * ({_bucket('t3', _S)} + {_bucket('t10', '0:20 3:60 8:80 9:100')}) / 2 + 0.3e0 * CASE WHEN bank <= 1 THEN 90 WHEN bank <= 2 THEN 70 ELSE 30 END AS conn FROM i),
    r AS (SELECT project_id, near, onsite, daily, CAST(round_even(CAST(CASE WHEN bare THEN least(social, 70) ELSE social END AS DECIMAL(20, 8)), 0) AS DOUBLE) AS social, CAST(round_even(CAST(conn AS DECIMAL(20, 8)), 0) AS DOUBLE) AS connectivity FROM d),
    f AS (SELECT *, CAST(round_even(CAST(0.40e0 * daily + 0.35e0 * social + 0.25e0 * connectivity AS DECIMAL(20, 8)), 0) AS DOUBLE) AS loc FROM r)
    SELECT project_id, CASE WHEN near > 0 THEN daily END AS daily, CASE WHEN near > 0 THEN social END AS social, CASE WHEN near > 0 THEN connectivity END AS connectivity, CASE WHEN near > 0 THEN loc END AS location_score,
      CASE WHEN near = 0 THEN 0.0e0 WHEN onsite > 0 THEN CAST(round_even(CAST(loc / 2 AS DECIMAL(20, 8)), 0) AS DOUBLE) ELSE loc END AS overall_score,
      CASE WHEN near > 0 AND onsite > 0 THEN 'ok' ELSE 'partial' END AS score_status, CASE WHEN near > 0 AND onsite > 0 THEN '' WHEN near > 0 THEN 'missing_onsite_data' ELSE 'missing_nearby_data' END AS reason FROM f"""
_KM = "2 * 6371.0e0 * asin(sqrt(pow(sin(radians(lat - 20) / 2), 2) + cos(radians(lat)) * cos(radians(20)) * pow(sin(radians(lon - 82) / 2), 2)))"
_BY = {
    "overall_score": "overall_score DESC", "location_score": "coalesce(location_score, 0)", "amenity_score": "coalesce(amenity_score, 0) DESC", "distance": "km", "registration_date": "approved_date DESC",
    "price": "coalesce(min_price, 1e300)", "value_score": "CASE WHEN min_price > 0 THEN 0.6e0 * overall_score + 40 - 20 * least(min_price / 5000000, 2) ELSE 0 END DESC", "name": "lower(project_name)",
}
ORDER_CHECK = f", h AS (SELECT * FROM (SELECT *, {_KM} AS km FROM x WHERE status <> 'P' AND overall_score >= 20) WHERE km <= 300) " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{by}' AS sort_by, project_id, (SELECT count(*) FROM h) AS total FROM h ORDER BY {order}, project_id LIMIT 10 OFFSET 10)" for by, order in _BY.items()
)

RULES = [
    Rule("scr01_amenity_scores", ("SCR01", "SCR02", "SCR03", "SCR04"), STATS, amenity_scores, SCORES_CHECK),
    Rule("srt01_search_sort_keys", ("SRT01", "SRT02", "FLT11", "STM06"), HITS, _all_orders, ORDER_CHECK),
]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}


# Searches by every predicate that needs another relation; the relations are made from the tables.
_PROJECTS = """SELECT project_id, project_name, status, district, lat, lon, approved_date, total_price AS min_price, total_price AS max_price, CASE WHEN project_id % 7 = 0 THEN NULL ELSE CAST(project_id * 31 % 101 AS DOUBLE) END AS overall_score,
    CASE project_id % 4 WHEN 0 THEN 'Arang' WHEN 1 THEN 'ABHANPUR' WHEN 2 THEN NULL ELSE 'Durg' END AS tehsil, CASE project_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"project_type": "' || project_type || '"}' ELSE '{"project_type": null}' END AS raw FROM {projects}"""
_STATS = "SELECT l_orderkey AS project_id, CASE l_partkey % 4 WHEN 0 THEN 'park' WHEN 1 THEN 'gym' WHEN 2 THEN 'pool' ELSE 'school' END AS kind, CASE WHEN l_suppkey % 5 = 0 THEN 3 END AS radius_km, l_linenumber <> 2 AS onsite_available FROM {lineitem}"
_LINKS = "SELECT project_id, slug FROM {project_tags}"
_VERIFIED = "SELECT l_orderkey AS project_id, CASE WHEN l_returnflag = 'N' THEN 'verified' ELSE 'pending' END AS status, l_linenumber = 1 AS is_current FROM {lineitem}"
SEARCHES = {
    "tehsil": {"tehsil": "a%"}, "types": {"project_types": ["1-URGENT", "5-LOW"]}, "amenities": {"amenities": ["park", "gym", "park"]}, "any_tag": {"tags": ["Brand#11", "Brand#23"]},
    "all_tags": {"tags": ["Brand#11", "Brand#23"], "match_all": True}, "verified": {"verified_only": True}, "together": {"tehsil": "%N%", "amenities": ["park"], "verified_only": True, "statuses": ["O", "F"], "sort_by": "price", "descending": False},
}


def search_by_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each search, with its total."""
    frames = [Operator("search", (), lambda d, text=text: text).query(spark, sf_dir) for text in (_PROJECTS, _STATS, _LINKS, _VERIFIED)]
    out: DataFrame | None = None
    for label, asked in SEARCHES.items():
        page = search(frames[0], page=2, size=15, stats=frames[1], links=frames[2], verifications=frames[3], **asked)
        page = page.select(F.lit(label).alias("search"), "project_id", "total")
        out = page if out is None else out.unionByName(page)
    return out


def _search_check() -> str:
    named = {n: Operator(n, (), lambda d, text=text: text).oracle() for n, text in (("x", _PROJECTS), ("st", _STATS), ("li", _LINKS), ("ve", _VERIFIED))}
    where = {
        "tehsil": "tehsil ILIKE 'a%'", "types": "project_id % 3 = 1 AND json_extract_string(raw, '$.project_type') IN ('1-URGENT', '5-LOW')",
        "amenities": "project_id IN (SELECT project_id FROM st WHERE kind = 'park' AND radius_km IS NULL AND onsite_available) AND project_id IN (SELECT project_id FROM st WHERE kind = 'gym' AND radius_km IS NULL AND onsite_available)",
        "any_tag": "project_id IN (SELECT project_id FROM li WHERE slug IN ('Brand#11', 'Brand#23'))", "all_tags": "project_id IN (SELECT project_id FROM li WHERE slug = 'Brand#11') AND project_id IN (SELECT project_id FROM li WHERE slug = 'Brand#23')",
        "verified": "project_id IN (SELECT project_id FROM ve WHERE is_current AND status = 'verified')",
        "together": "tehsil ILIKE '%n%' AND status IN ('O', 'F') AND project_id IN (SELECT project_id FROM st WHERE kind = 'park' AND radius_km IS NULL AND onsite_available) AND project_id IN (SELECT project_id FROM ve WHERE is_current AND status = 'verified')",
    }
    order = lambda label: "CASE WHEN min_price <> 0 THEN CAST(min_price AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END, project_id" if label == "together" else "coalesce(overall_score, 0) DESC, project_id"
    pages = " UNION ALL ".join(f"SELECT * FROM (SELECT '{label}' AS search, project_id, count(*) OVER () AS total FROM x WHERE {test} ORDER BY {order(label)} LIMIT 15 OFFSET 15) p_{label}" for label, test in where.items())
    return f"WITH {', '.join(f'{n} AS ({text})' for n, text in named.items())} {pages}"


QUERIES["search_by_relations"] = search_by_relations
ORACLE_SQL["search_by_relations"] = _search_check()
