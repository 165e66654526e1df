"""What the portal shows and keeps: faceted tags, completeness, features, search texts, map frames, routes of documents, parents with slugs, points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.functions.geo import within_radius
from cadastra.operators.records import Rule
from cadastra.runtime import Workspace

# Categories of tags in their order, with their labels.
CATEGORIES = {"proximity": "Location & Proximity", "infrastructure": "Infrastructure", "investment": "Investment Highlights", "lifestyle": "Lifestyle", "certification": "Certifications"}


def faceted_tags(tags: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each category of active tags: category, label, place, tags (slug and count, in their order), featured (slugs) and total, the number of all tags.

    ``tags``: slug, category, sort_order, is_featured, is_active; ``links``: project_id, slug. Categories that are not listed come last under their own name.
    """
    counts = links.dropDuplicates(["project_id", "slug"]).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    active = tags.where("is_active").join(counts, "slug", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.coalesce(*(F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(CATEGORIES)), F.lit(99))
    label = F.coalesce(*(F.when(F.col("category") == c, F.lit(name)) for c, name in CATEGORIES.items()), F.col("category"))
    groups = active.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("sort_order", "slug", "n", "is_featured"))).alias("all"))
    # one row a category
    total = F.sum(F.size("all")).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shown = F.transform("all", lambda t: F.struct(t["slug"].alias("slug"), t["n"].alias("n")))
    featured = F.transform(F.filter("all", lambda t: t["is_featured"]), lambda t: t["slug"])
    return groups.select("category", label.alias("label"), place.alias("place"), shown.alias("tags"), featured.alias("featured"), total.alias("total"))


def geo_completeness(projects: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """One row of counters and shares. ``projects``: lat, lon, status, normalized_address, raw (JSON), full_address; ``bounds``: least and most latitude, least and most longitude."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    here = lat.isNotNull() & lon.isNotNull()
    outside = here & ~(lat.between(bounds[0], bounds[1]) & lon.between(bounds[2], bounds[3]))
    filled = lambda c: F.nullif(c, F.lit(""))
    address = F.coalesce(filled(F.col("normalized_address")), *(filled(F.get_json_object("raw", f"$.{k}")) for k in ("normalized_address", "normalizedAddress")), filled(F.col("full_address")))
    sums = projects.agg(F.count(F.lit(1)).alias("total"), F.count_if(here).alias("with_coordinates"), F.count_if(lat.isNull()).alias("missing_latitude"), F.count_if(lon.isNull()).alias("missing_longitude"), F.count_if(outside).alias("out_of_bounds"), F.count_if(address.isNull()).alias("missing_address"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(100 * F.col(a) / F.col(b), 2)).otherwise(0.0)
    return sums.withColumns({"missing_coordinates": F.col("total") - F.col("with_coordinates"), "coverage_pct": share("with_coordinates", "total"), "out_of_bounds_pct": share("out_of_bounds", "with_coordinates"), "missing_address_pct": share("missing_address", "total")})


def extraction_stats(rows: DataFrame) -> DataFrame:
    """kind (total, successful, failed, type, processor), name, n. Extractions without a type are in no type."""
    by = lambda kind, column: rows.groupBy(F.lit(kind).alias("kind"), F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful")).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("name"), n.alias("n")) for k, n in (("total", F.col("total")), ("successful", F.col("successful")), ("failed", F.col("total") - F.col("successful")))))).alias("t")).select("t.*")
    return totals.unionByName(by("type", "document_type").where("name <> ''")).unionByName(by("processor", "processor"))


def completeness(filled: list[Column]) -> Column:
    """struct of percent (halves go up) and band: good from 80, fair from 50, poor below. The bands."""
    percent = F.floor(100 * sum((F.coalesce(c.cast("int"), F.lit(0)) for c in filled), F.lit(0)) / len(filled) + 0.5).cast("int")
    return F.struct(percent.alias("percent"), F.when(percent >= 80, "good").when(percent >= 50, "fair").otherwise("poor").alias("band"))


def search_text(name: Column, places: list[Column], units: Column, amenities: Column, promoters: Column, prices: Column) -> Column:
    """One text of a project: name, places, its kinds of unit in order, up to ten amenities, up to two developers, the last prices (array of structs of least and most)."""
    filled = lambda c: F.nullif(c, F.lit(""))
    said = lambda head, text: F.when(text != "", F.concat(F.lit(head), text))
    some = lambda xs: F.filter(xs, lambda x: x != "")
    last = F.when(F.size(prices) > 0, F.element_at(prices, -1))
    price = F.when((last["least"] != 0) & (last["most"] != 0), F.concat(F.lit("Price: "), last["least"].cast("string"), F.lit(" - "), last["most"].cast("string")))
    return F.concat_ws(". ", filled(name), said("Location: ", F.concat_ws(", ", *map(filled, places))), said("Units: ", F.array_join(F.array_sort(F.array_distinct(some(units))), ", ")), said("Amenities: ", F.array_join(F.slice(amenities, 1, 10), ", ")), said("Developer: ", F.array_join(F.slice(some(promoters), 1, 2), ", ")), price)


#: Map frames in a page, either order of their coordinates, and India's bounds.
FRAME, LON_LAT, LAT_LON = r'(?is)<iframe\b[^>]*?\ssrc\s*=\s*["\']([^"\']*google\.com/maps[^"\']*)["\']', r"(?i)google\.com/maps/embed\?pb=.*?!2d([\d.]+)!3d([\d.]+)", r"(?i)google\.com/maps/embed\?pb=.*?!3d([\d.]+).*?!2d([\d.]+)"
INDIA = (6.0, 38.0, 68.0, 98.0)


def map_frame(html: Column, bounds: tuple[float, float, float, float] = INDIA) -> Column:
    """struct of lat and lon of the first map frame that says where it is, within the bounds; zero is nowhere."""

    def at(src: Column, pattern: str, lat: int, lon: int) -> Column:
        y, x = (F.regexp_extract(src, pattern, g).try_cast("double") for g in (lat, lon))
        return F.when((y != 0) & (x != 0) & y.between(bounds[0], bounds[1]) & x.between(bounds[2], bounds[3]), F.struct(y.alias("lat"), x.alias("lon")))

    frames = F.transform(F.regexp_extract_all(html, F.lit(FRAME), F.lit(1)), lambda s: F.replace(s, F.lit("&amp;"), F.lit("&")))
    return F.get(F.filter(F.transform(frames, lambda s: F.coalesce(at(s, LON_LAT, 2, 1), at(s, LAT_LON, 1, 2))), lambda p: p.isNotNull()), F.lit(0))


# Words in the names of documents whose text is tried first, and the bounds of a route.
KNOWN = ("registration", "certificate", "agreement", "approval", "permission", "noc", "sanction")


def route(name: Column, size: Column, success: Column, kind: Column, confidence: Column, length: Column, model_success: Column) -> Column:
    """Which result stands, text or model: small files and known names with enough text take the text; else the model where the text is unsure and the model succeeds."""
    unsure = ~F.coalesce(success, F.lit(False)) | (F.coalesce(kind, F.lit("unknown")) == "unknown") | (F.coalesce(confidence, F.lit(0.0)) < 0.5) | (F.coalesce(length, F.lit(0)) < 100)
    known = F.lower(name).rlike("|".join(KNOWN)) & F.coalesce(success, F.lit(False)) & (F.coalesce(length, F.lit(0)) > 200)
    return F.when(size < 100_000, "text").when(known, "text").when(unsure & F.coalesce(model_success, F.lit(False)), "model").otherwise("text")


def features(projects: DataFrame, promoters: DataFrame, stats: DataFrame) -> DataFrame:
    """project_id and its features as JSON: fields, promoters, amenities on site and nearby, signals.

    ``promoters``: project_id, place, name, type; ``stats``: project_id, place, amenity_type, onsite_available, nearby_count, nearby_nearest_km; a project's rows of either are few.
    """
    own = promoters.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "type"))), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"))).alias("promoters"))
    row = F.struct("place", "amenity_type", "onsite_available", "nearby_count", "nearby_nearest_km")
    kinds = stats.groupBy("project_id").agg(F.array_sort(F.collect_list(row)).alias("stats"))
    onsite = F.transform(F.filter("stats", lambda s: F.coalesce(s["onsite_available"], F.lit(False))), lambda s: s["amenity_type"])
    nearby = F.transform(F.filter("stats", lambda s: F.coalesce(s["nearby_count"], F.lit(0)) > 0), lambda s: F.struct(s["amenity_type"].alias("type"), s["nearby_count"].alias("count"), F.nullif(s["nearby_nearest_km"], F.lit(0.0)).alias("nearest_km")))
    rows = projects.join(own, "project_id", "left").join(kinds, "project_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    pack = F.struct(
        F.col("project_id").alias("id"), "name", "state", "city", F.col("approved_date").cast("string").alias("approved_date"), F.col("proposed_end_date").cast("string").alias("proposed_end_date"), F.nullif(F.col("area"), F.lit(0.0)).alias("area"), F.lit("Residential").alias("type"),
        empty(F.col("promoters"), "array<struct<name:string,type:string>>").alias("promoters"),
        F.struct(empty(onsite, "array<string>").alias("onsite"), empty(nearby, "array<struct<type:string,count:int,nearest_km:double>>").alias("nearby")).alias("amenities"),
        F.struct((F.coalesce("lat", F.lit(0.0)) != 0).__and__(F.coalesce("lon", F.lit(0.0)) != 0).alias("has_lat_lon"), (F.coalesce("documents", F.lit(0)) > 0).alias("has_documents"), (F.coalesce("updates", F.lit(0)) > 0).alias("has_quarterly_updates")).alias("signals"),
    )
    return rows.select("project_id", F.to_json(pack).alias("features"))


def with_parents(parents: DataFrame, projects: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """``projects`` with parent_id, and ``parents`` with those that had to be made.

    A parent is known by its name, address and promoter in capitals, without white space at the ends. ``parents``: parent_id, name, address,
    promoter, slug; ``projects``: project_id, name, address, promoter. New parents are numbered and named by their smallest project; a slug that is
    taken gets the least number that isn't. Slugs that two names would both come to are settled round by round, the smallest parent first.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    promoter = F.coalesce(F.nullif(bare("promoter"), F.lit("")), F.lit("UNKNOWN"))
    keyed = lambda rows: rows.withColumn("key", F.struct(F.upper(bare("name")).alias("a"), F.upper(bare("address")).alias("b"), F.upper(promoter).alias("c")))
    known = keyed(parents).groupBy("key").agg(F.min("parent_id").alias("parent_id"))
    asked = keyed(projects)
    fresh = asked.join(known, "key", "left_anti").groupBy("key").agg(F.min_by(F.struct("project_id", bare("name").alias("name"), bare("address").alias("address"), promoter.alias("promoter")), "project_id").alias("p"))
    base = F.regexp_replace(F.regexp_replace(F.lower("p.name"), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    base = F.when(base != "", base).otherwise(F.concat(F.lit("project-"), F.substring(F.sha2(F.concat_ws("|", "key.a", "key.b", "key.c"), 256), 1, 8)))
    # numbers follow the largest id: parents differ in their smallest projects
    highest = parents.agg(F.coalesce(F.max("parent_id"), F.lit(0)).alias("m")).first()[0]
    open_ = workspace.save(fresh.select("key", (F.lit(highest) + F.col("p.project_id")).alias("parent_id"), "p.name", "p.address", "p.promoter", base.alias("base")), "fresh")
    made = parents.select("parent_id", "name", "address", "promoter", "slug")
    number = 0
    while not open_.isEmpty():
        # the numbers that a base's taken slugs have
        taken = made.select(F.explode(F.array(F.struct(F.col("slug").alias("base"), F.lit(0).alias("n")), F.struct(F.regexp_extract("slug", r"^(.*)-([1-9][0-9]{0,8})$", 1).alias("base"), F.regexp_extract("slug", r"^(.*)-([1-9][0-9]{0,8})$", 2).try_cast("int").alias("n")))).alias("t")).select("t.*").where("n IS NOT NULL")
        used = taken.join(open_.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("n").alias("used"))
        ranked = open_.withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy("parent_id"))).join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
        free = F.element_at(F.array_except(F.sequence(F.lit(0), F.size("used") + F.col("r")), "used"), F.col("r"))
        named = ranked.withColumn("n", free).withColumn("slug", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))))
        named = workspace.save(named.withColumn("first", F.row_number().over(Window.partitionBy("slug").orderBy("parent_id")) == 1), f"named{number}")
        made = workspace.save(made.unionByName(named.where("first").select("parent_id", "name", "address", "promoter", "slug")), f"parents{number}")
        open_ = named.where("NOT first").select("key", "parent_id", "name", "address", "promoter", "base")
        number += 1
    everyone = keyed(made).groupBy("key").agg(F.min("parent_id").alias("parent_id"))
    return asked.join(everyone, "key", "left").drop("key"), made


def upserted_places(old: DataFrame, found: DataFrame, radius_km: float, now: Column) -> DataFrame:
    """Points of interest after a search of ``radius_km``: those found are entered or renewed, their radius is the larger one, and they were last seen ``now``; all others stay.

    ``old``: place_id, kind, name, lat, lon, radius_km, last_seen, created; ``found``: place_id (may be missing), kind, name, lat, lon, seq. A place without an id is known by its kind
    and position; of places with one id the last by seq counts.
    """
    own = F.format_string("%s:%.6f,%.6f", "kind", F.col("lat").cast("double"), F.col("lon").cast("double"))
    named = found.withColumn("place_id", F.coalesce(F.nullif(F.col("place_id"), F.lit("")), own))
    last = named.groupBy("place_id").agg(F.max_by(F.struct("kind", "name", "lat", "lon"), F.struct("seq", "kind", "name")).alias("f"))
    rows = old.join(last, "place_id", "full_outer")
    here = F.col("f").isNotNull()
    put = {c: F.when(here, F.col(f"f.{c}")).otherwise(F.col(c)) for c in ("kind", "name", "lat", "lon")}
    put["radius_km"] = F.when(here, F.greatest(F.coalesce("radius_km", F.lit(0.0)), F.lit(float(radius_km)))).otherwise(F.col("radius_km"))
    put["created"] = F.coalesce("created", F.when(here, now))
    put["last_seen"] = F.when(here, now).otherwise(F.col("last_seen"))
    return rows.withColumns(put).select(*old.columns)


# queries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agg02_faceted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["lifestyle", "proximity", "other", "certification", "investment", "infrastructure"]
    number = F.substring("p_brand", 7, 2).cast("int")
    tags = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("slug"), number.alias("n")).distinct()
    tags = tags.select("slug", F.element_at(F.array(*map(F.lit, kinds)), F.col("n") % 6 + 1).alias("category"), (F.col("n") % 7).alias("sort_order"), (F.col("n") % 4 == 0).alias("is_featured"), (F.col("n") % 9 != 0).alias("is_active"))
    links = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_linenumber < 3").select(F.col("l_orderkey").alias("project_id"), F.col("p_brand").alias("slug"))
    rows = faceted_tags(tags, links)
    shown = F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["slug"], t["n"].cast("string"))), ",")
    return rows.select("category", "label", "place", shown.alias("tags"), F.array_join("featured", ",").alias("featured"), "total")


def dml03_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' projects: every third parent exists; names come in several spellings, and differ from others' only by address."""
    people = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), (F.col("c_custkey") % 60).alias("g"))
    name = F.concat(F.lit("Villa "), (F.col("g") % 7).cast("string"))
    parents = people.select("g").distinct().where("g % 3 = 0").select((F.col("g") + 1).cast("long").alias("parent_id"), name.alias("name"), F.concat(F.lit("Road "), F.col("g").cast("string")).alias("address"), F.lit("UNKNOWN").alias("promoter"), F.concat(F.lit("villa-"), F.col("g").cast("string")).alias("slug"))
    projects = people.select(F.col("k").alias("project_id"), F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), F.upper(name))).otherwise(name).alias("name"), F.concat(F.lit("road "), F.col("g").cast("string")).alias("address"), F.lit(None).cast("string").alias("promoter"))
    found, made = with_parents(parents, projects, Workspace(spark, "parents"))
    slugs = made.groupBy("slug").agg(F.count(F.lit(1)).alias("holders"), F.min("parent_id").alias("parent_id")).where(F.col("slug").startswith("villa-"))
    return found.join(slugs, "parent_id").groupBy("parent_id", "holders").agg(F.count(F.lit(1)).alias("projects"), F.min("project_id").alias("first"))


GEO = """SELECT project_id AS k, lat, lon, status, CASE project_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN '' END AS normalized_address, CASE project_id % 5 WHEN 0 THEN '{"normalized_address": "y"}' WHEN 1 THEN '{"normalizedAddress": "z"}' WHEN 2 THEN '{"normalized_address": ""}' WHEN 3 THEN '[1]' END AS raw, CASE WHEN project_id % 4 = 0 THEN 'full' END AS full_address FROM {projects}"""
FILED = """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'plan' ELSE 'deed' END AS document_type, CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'model' END AS processor, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS success,
    'f' || CASE o_orderkey % 4 WHEN 0 THEN ' NOC' WHEN 1 THEN 'Registration' ELSE 'scan' END || '.pdf' AS name, o_orderkey * 7919 % 200000 AS size, CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE o_orderkey * 31 % 100 / 100.0e0 END AS confidence, o_orderkey * 13 % 400 AS length, o_orderkey % 3 <> 1 AS model_success FROM {orders}"""
PARTS = """SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS district, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'CG' END AS state, c_custkey % 4 AS u, c_custkey % 14 AS a, c_custkey % 4 AS p, c_custkey % 3 AS s FROM {customer}"""


def _texts(x: DataFrame) -> DataFrame:
    seq = lambda n, head: F.transform(F.filter(F.sequence(F.lit(0), F.col(n).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit(head), F.lpad(i.cast("string"), 2, "0")))
    units = F.concat(F.reverse(seq("u", "BHK")), seq("u", "BHK"), F.array(F.lit("")))
    prices = F.when(F.col("s") > 0, F.array(F.struct(F.lit(9).alias("least"), F.lit(9).alias("most")), F.struct((F.col("s") - 1).cast("int").alias("least"), F.lit(7).alias("most"))))
    return x.select("k", search_text(F.col("name"), [F.col("district"), F.col("state")], units, seq("a", "A"), F.concat(F.array(F.lit("")), seq("p", "P")), prices).alias("text"))


FRAMES = """SELECT o_orderkey AS k, o_orderkey % 10 AS w, '<p>x</p>' || CASE o_orderkey % 10 WHEN 0 THEN '<iframe width="5" src="https://www.google.com/maps/embed?pb=!1m14!1d1!2d81.5!3d21.' || CAST(o_orderkey % 90 + 10 AS VARCHAR(4)) || '!4f"></iframe>' WHEN 1 THEN '<iframe src="https://www.google.com/maps/embed?pb=!3d22.5!5e0!2d80.25"></iframe>' WHEN 2 THEN '<iframe src="https://other/maps/embed?pb=!2d81!3d21"></iframe>'
    WHEN 3 THEN '<iframe src="https://www.google.com/maps/embed?pb=!2d0!3d21.5"></iframe>' WHEN 4 THEN '<iframe src="https://www.google.com/maps/embed?pb=!2d10.5!3d51.5"></iframe>' WHEN 5 THEN '<a href="https://www.google.com/maps/embed?pb=!2d81!3d21">' WHEN 6 THEN '<iframe src="https://www.google.com/maps/embed?pb=!2d1.2.3!3d21"></iframe><IFRAME class=x SRC="https://www.google.com/maps/embed?pb=!2d82.5!3d20.5">'
    WHEN 7 THEN '' WHEN 8 THEN '<iframe src="https://www.google.com/maps?q=1"></iframe>' ELSE '<iframe data-src="https://www.google.com/maps/embed?pb=!2d81!3d21"></iframe>' END AS html FROM {orders}"""

HOMES = """SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 5 > 0 END AS b, o_orderkey % 2 = 0 AS c, o_orderkey % 7 > 1 AS d FROM {orders}"""

RULES = [
    Rule("agg19_geo_counters", ("AGG19",), GEO, lambda x: geo_completeness(x, (18.0, 22.0, 80.0, 83.0)),
         """, y AS (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AS here, k % 6 = 0 OR k % 5 < 2 OR k % 4 = 0 AS said FROM x),
            s AS (SELECT count(*) AS total, count(*) FILTER (WHERE here) AS with_coordinates, count(*) FILTER (WHERE lat IS NULL) AS missing_latitude, count(*) FILTER (WHERE lon IS NULL) AS missing_longitude, count(*) FILTER (WHERE here AND (lat < 18 OR lat > 22 OR lon < 80 OR lon > 83)) AS out_of_bounds, count(*) FILTER (WHERE NOT said) AS missing_address FROM y)
            SELECT *, total - with_coordinates AS missing_coordinates, round(100.0e0 * with_coordinates / total, 2) AS coverage_pct, round(100.0e0 * out_of_bounds / with_coordinates, 2) AS out_of_bounds_pct, round(100.0e0 * missing_address / total, 2) AS missing_address_pct FROM s"""),
    Rule("agg27_extractions", ("AGG27",), FILED, extraction_stats,
         """SELECT 'total' AS kind, NULL AS name, count(*) AS n FROM x UNION ALL SELECT 'successful', NULL, count(*) FILTER (WHERE success) FROM x UNION ALL SELECT 'failed', NULL, count(*) - count(*) FILTER (WHERE success) FROM x
            UNION ALL SELECT 'type', document_type, count(*) FROM x WHERE document_type <> '' GROUP BY document_type UNION ALL SELECT 'processor', processor, count(*) FROM x GROUP BY processor"""),
    Rule("scr16_routes", ("SCR16",), FILED, lambda x: x.select("k", route(F.col("name"), F.col("size"), F.col("success"), F.nullif(F.col("document_type"), F.lit("")), F.col("confidence"), F.col("length"), F.col("model_success")).alias("route")),
         """SELECT k, CASE WHEN size < 100000 THEN 'text' WHEN k % 4 < 2 AND k % 7 > 1 AND length > 200 THEN 'text' WHEN (k % 7 < 2 OR k % 5 < 2 OR k % 6 = 0 OR confidence < 0.5e0 OR length < 100) AND k % 3 <> 1 THEN 'model' ELSE 'text' END AS route FROM x"""),
    Rule("mth10_ten_checks", ("MTH10",), HOMES, lambda x: x.select("k", completeness([F.col(c) for c in "abcd"] + [F.lit(True)] * 3 + [F.col("a")] * 3).alias("c")).select("k", "c.percent", "c.band"),
         """, n AS (SELECT k, 3 + 4 * a::INT + coalesce(b::INT, 0) + c::INT + d::INT AS n FROM x) SELECT k, CAST(n * 10 AS INTEGER) AS percent, CASE WHEN n >= 8 THEN 'good' WHEN n >= 5 THEN 'fair' ELSE 'poor' END AS band FROM n"""),
    Rule("str37_search_texts", ("STR37",), PARTS, _texts,
         """SELECT k, concat_ws('. ', nullif(name, ''), CASE WHEN district IS NOT NULL OR state <> '' THEN 'Location: ' || concat_ws(', ', district, nullif(state, '')) END, CASE WHEN u > 0 THEN 'Units: ' || array_to_string(['BHK01', 'BHK02', 'BHK03'][1:u], ', ') END,
              CASE WHEN a > 0 THEN 'Amenities: ' || array_to_string(['A01', 'A02', 'A03', 'A04', 'A05', 'A06', 'A07', 'A08', 'A09', 'A10'][1:a], ', ') END, CASE WHEN p > 0 THEN 'Developer: ' || array_to_string(['P01', 'P02'][1:p], ', ') END, CASE WHEN s = 2 THEN 'Price: 1 - 7' END) AS text FROM x"""),
    Rule("str40_map_frames", ("STR40",), FRAMES, lambda x: x.withColumn("p", map_frame(F.col("html"))).select("k", "p.lat", "p.lon"),
         "SELECT k, CASE w WHEN 0 THEN CAST('21.' || (k % 90 + 10) AS DOUBLE) WHEN 1 THEN 22.5 WHEN 6 THEN 20.5 END AS lat, CASE w WHEN 0 THEN 81.5 WHEN 1 THEN 80.25 WHEN 6 THEN 82.5 END AS lon FROM x"),
]


def nst14_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    projects = orders.select(k.alias("project_id"), F.concat(F.lit("P"), k.cast("string")).alias("name"), F.lit("CG").alias("state"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("city"), F.when(k % 4 > 0, F.col("o_orderdate").cast("date")).alias("approved_date"), F.lit(None).cast("date").alias("proposed_end_date"),
                             F.when(k % 5 > 0, (k % 7).cast("double")).alias("area"), F.when(k % 6 > 0, F.lit(21.5)).alias("lat"), (k % 2).cast("double").alias("lon"), (k % 3).alias("documents"), F.lit(None).cast("int").alias("updates"))
    lines = _table(spark, sf_dir, "lineitem")
    place = ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("place")
    promoters = lines.where("l_linenumber < 3").select(F.col("l_orderkey").alias("project_id"), place, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.when(F.col("l_suppkey") % 2 == 0, "firm").alias("type"))
    stats = lines.where("l_linenumber < 4").select(F.col("l_orderkey").alias("project_id"), place, F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("amenity_type"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 3 == 1).alias("onsite_available"), (F.col("l_suppkey") % 3).cast("int").alias("nearby_count"), (F.col("l_partkey") % 4 / 2).alias("nearby_nearest_km"))
    rows = features(projects, promoters, stats)
    at = lambda p: F.get_json_object("features", p)
    return rows.select("project_id", at("$.city").alias("city"), at("$.approved_date").alias("approved_date"), at("$.area").cast("double").alias("area"), F.regexp_count("features", F.lit('"S[0-9]+"')).alias("promoters"), F.coalesce(F.size(F.from_json(at("$.amenities.onsite"), "array<string>")), F.lit(0)).alias("onsite"),
                       F.size(F.from_json(at("$.amenities.nearby"), "array<struct<type:string,count:int,nearest_km:double>>")).alias("nearby"), at("$.signals.has_lat_lon").alias("placed"), at("$.signals.has_documents").alias("documented"), at("$.signals.has_quarterly_updates").alias("updated"))


def jn14_places_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers spread over the globe, poles and the 180th meridian included: pairs within 400 km."""
    left = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7919 % 1801 / 10 - 90).alias("lat"), (F.col("c_custkey") * 104729 % 3601 / 10 - 180).alias("lon"))
    right = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 6007 % 181 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 3571 % 361 - 180).cast("double").alias("lon"))
    return within_radius(left, right, 400.0).select("c_custkey", "s_suppkey", (F.floor(F.col("km") * 1e6 + 0.5) / 1e6).alias("km"))


def dml05_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points of interest: some known from a wider search, some found twice, some without an id."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "school").otherwise("bank").alias("kind"), (17 + F.col("s_suppkey") % 700 / 100).alias("lat"), (80 + F.col("s_suppkey") % 300 / 100).alias("lon"))
    then, now = (F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00", "2024-06-01 00:00:00"))
    old = rows.where("k % 3 = 0").select(F.concat(F.lit("id"), F.col("k").cast("string")).alias("place_id"), "kind", F.lit("old").alias("name"), "lat", "lon", F.when(F.col("k") % 6 > 0, F.lit(10.0)).alias("radius_km"), then.alias("last_seen"), then.alias("created"))
    seen = rows.where("k % 4 < 3").select(F.when(F.col("k") % 5 > 0, F.concat(F.lit("id"), F.col("k").cast("string"))).alias("place_id"), "kind", "lat", "lon", "k")
    found = seen.select("place_id", "kind", F.lit("first").alias("name"), "lat", "lon", F.lit(1).alias("seq")).unionByName(seen.where("k % 7 = 0").select("place_id", "kind", F.lit("again").alias("name"), "lat", "lon", F.lit(2).alias("seq")))
    out = upserted_places(old, found, 5.0, now)
    return out.select("place_id", "kind", "name", "radius_km", (F.col("last_seen") == now).alias("seen"), (F.col("created") == now).alias("fresh"))


QUERIES = {r.name: r.query for r in RULES} | {f.__name__: f for f in (agg02_faceted_tags, dml03_parents, nst14_features, dml05_places, jn14_places_anywhere)}
ORACLE_SQL = {r.name: r.oracle() for r in RULES} | {
    "agg02_faceted_tags": """
        WITH t AS (SELECT DISTINCT p_brand AS slug, CAST(substr(p_brand, 7, 2) AS INTEGER) AS n FROM part), a AS (SELECT slug, ['lifestyle', 'proximity', 'other', 'certification', 'investment', 'infrastructure'][n % 6 + 1] AS category, n % 7 AS o, n % 4 = 0 AS f FROM t WHERE n % 9 <> 0),
        c AS (SELECT p_brand AS slug, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber < 3 GROUP BY p_brand)
        SELECT category, CASE category WHEN 'proximity' THEN 'Location & Proximity' WHEN 'infrastructure' THEN 'Infrastructure' WHEN 'investment' THEN 'Investment Highlights' WHEN 'lifestyle' THEN 'Lifestyle' WHEN 'certification' THEN 'Certifications' ELSE category END AS label,
               CAST(CASE category WHEN 'proximity' THEN 0 WHEN 'infrastructure' THEN 1 WHEN 'investment' THEN 2 WHEN 'lifestyle' THEN 3 WHEN 'certification' THEN 4 ELSE 99 END AS INTEGER) AS place,
               string_agg(a.slug || ':' || coalesce(c.n, 0), ',' ORDER BY o, a.slug) AS tags, coalesce(string_agg(a.slug, ',' ORDER BY o, a.slug) FILTER (WHERE f), '') AS featured, (SELECT count(*) FROM a) AS total FROM a LEFT JOIN c ON c.slug = a.slug GROUP BY category""",
    "nst14_features": """
        WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_linenumber < 3) AS p, count(*) FILTER (WHERE l_linenumber < 4 AND l_partkey % 3 = 1) AS o, count(*) FILTER (WHERE l_linenumber < 4 AND l_suppkey % 3 > 0) AS n FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS city, CASE WHEN o_orderkey % 4 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS approved_date, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS area,
               CAST(coalesce(p, 0) AS INTEGER) AS promoters, CAST(coalesce(o, 0) AS INTEGER) AS onsite, CAST(coalesce(n, 0) AS INTEGER) AS nearby, CASE WHEN o_orderkey % 6 > 0 AND o_orderkey % 2 = 1 THEN 'true' ELSE 'false' END AS placed, CASE WHEN o_orderkey % 3 > 0 THEN 'true' ELSE 'false' END AS documented, 'false' AS updated
        FROM orders LEFT JOIN l ON l.k = o_orderkey""",
    "dml03_parents": """
        WITH p AS (SELECT c_custkey % 60 AS g, min(c_custkey) AS first, count(*) AS projects FROM customer GROUP BY 1), m AS (SELECT max(g) + 1 AS highest FROM p WHERE g % 3 = 0)
        SELECT CAST(CASE WHEN g % 3 = 0 THEN g + 1 ELSE highest + first END AS BIGINT) AS parent_id, CAST(1 AS BIGINT) AS holders, projects, CAST(first AS BIGINT) AS first FROM p, m""",
    "jn14_places_anywhere": """
        WITH c AS (SELECT c_custkey, c_custkey * 7919 % 1801 / 10.0e0 - 90 AS lat, c_custkey * 104729 % 3601 / 10.0e0 - 180 AS lon FROM customer), s AS (SELECT s_suppkey, s_suppkey * 6007 % 181 - 90.0e0 AS lat, s_suppkey * 3571 % 361 - 180.0e0 AS lon FROM supplier),
        p AS (SELECT c_custkey, s_suppkey, 2 * 6371 * asin(sqrt(least(1.0e0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) AS km FROM c, s)
        SELECT c_custkey, s_suppkey, round(km, 6) AS km FROM p WHERE km <= 400""",
    "dml05_places": """
        WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'school' ELSE 'bank' END AS kind, 17 + s_suppkey % 700 / 100.0e0 AS lat, 80 + s_suppkey % 300 / 100.0e0 AS lon FROM supplier),
        f AS (SELECT CASE WHEN k % 5 > 0 THEN 'id' || k ELSE printf('%s:%.6f,%.6f', kind, lat, lon) END AS id, any_value(kind) AS kind, CASE WHEN max(k % 7 = 0) THEN 'again' ELSE 'first' END AS name FROM r WHERE k % 4 < 3 GROUP BY 1),
        o AS (SELECT 'id' || k AS id, kind, CASE WHEN k % 6 > 0 THEN 10.0e0 END AS radius FROM r WHERE k % 3 = 0)
        SELECT coalesce(o.id, f.id) AS place_id, coalesce(f.kind, o.kind) AS kind, coalesce(f.name, 'old') AS name, CASE WHEN f.id IS NULL THEN o.radius ELSE greatest(coalesce(o.radius, 0), 5.0e0) END AS radius_km, f.id IS NOT NULL AS seen, o.id IS NULL AS fresh FROM o FULL OUTER JOIN f ON f.id = o.id""",
}
