"""A project's scraped document merged with the fields found in its N documents.

Documents are taken apart into (field, path, value) rows; each value meets the scraped value of its path, and the rule of
``functions.conflict`` settles the two; the last extraction of a field stands. Then the document is built again with the values at
their paths: sections that it lacks are made, lists grow, and all it held besides stays.

An aggregation with maxima settles a field, so that a project with very many extractions is combined before the shuffle; what
is collected for a project is bounded by the number of paths and of document kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.conflict import items, list_of, members, object_of, quoted, resolution, same, strategy_of
from cadastra.functions.salvage import strict
from cadastra.operators.records import Rule

# Fields of a document and their places in the project.
FIELD_PATHS = {
    "registration_number": "project_details.registration_number",
    "registration_date": "project_details.registration_date",
    "valid_till": "project_details.expected_completion_date",
    "project_name": "project_details.project_name",
    "project_type": "project_details.project_type",
    "project_address": "project_details.project_address",
    "project_district": "project_details.district",
    "project_tehsil": "project_details.tehsil",
    "total_land_area": "project_details.total_land_area",
    "total_units": "project_details.total_units",
    "bank_name": "bank_details.0.bank_name",
    "branch_name": "bank_details.0.branch_name",
    "account_number": "bank_details.0.account_number",
    "ifsc_code": "bank_details.0.ifsc_code",
    "promoter_name": "promoter_details.0.name",
    "promoter_type": "promoter_details.0.organisation_type",
    "promoter_address": "promoter_details.0.address",
    "total_plots": "land_details.total_plots",
    "open_space_percentage": "land_details.open_space_percentage",
    "survey_numbers": "land_details.survey_numbers",
}
ADDED, UPDATED = "pdf_extracted", "pdf_extracted (updated)"


def value_at(document: Column, path: str) -> Column:
    """JSON of the value at a dotted path of a variant, where numbers are places in a list; null where the document has none."""
    dotted = "$" + "".join(f"[{part}]" if part.isdigit() else f".{part}" for part in path.split("."))
    json = F.to_json(F.try_variant_get(document, dotted, "variant"))
    return F.nullif(json, F.lit("null"))


def _fields(json: Column, paths: dict[str, str], at: str) -> Column:
    """The values that a variant holds, as an array of structs."""
    found = F.array(*(F.struct(F.lit(field).alias("field"), F.lit(path).alias("path"), value_at(json, path if at == "path" else field).alias("value")) for field, path in paths.items()))
    return F.filter(found, lambda f: f["value"].isNotNull())


def merged_fields(projects: DataFrame, extractions: DataFrame, paths: dict[str, str] = FIELD_PATHS, strategy: Column | None = None) -> DataFrame:
    """A row for each project and field that an extraction fills.

    ``projects``: project_id, document; ``extractions``: project_id, seq, document_type, fields; documents and fields are JSON.
    Extractions of a project come in the order of seq, then of document_type and fields. Extractions without a project,
    without fields or with fields that are no JSON give no rows; a project's document that is no JSON holds no values.
    """
    found = extractions.select("project_id", F.struct("seq", "document_type", "fields").alias("order"), strict(F.col("fields")).alias("parsed"))
    found = found.select("project_id", "order", F.explode(_fields(F.col("parsed"), paths, "field")).alias("f"))
    found = found.select("project_id", "order", F.col("f.field").alias("field"), F.col("f.path").alias("path"), F.col("f.value").alias("pdf"))
    held = projects.select("project_id", strict(F.col("document")).alias("parsed")).select("project_id", F.map_from_entries(F.transform(_fields(F.col("parsed"), paths, "path"), lambda f: F.struct(f["field"], f["value"]))).alias("held"))
    rows = found.join(held, "project_id").withColumn("scraped", F.element_at("held", F.col("field"))).drop("held")
    conflict = F.col("scraped").isNotNull() & ~same(F.col("scraped"), F.col("pdf"))
    rows = rows.withColumn("settled", F.when(conflict, resolution(F.col("scraped"), F.col("pdf"), strategy_of(F.col("field")) if strategy is None else strategy)))
    rows = rows.withColumn("final", F.when(conflict, F.col("settled.value")).otherwise(F.col("pdf")))
    updated = conflict & ~same(F.col("settled.value"), F.col("scraped"))
    return rows.groupBy("project_id", "field").agg(
        F.first("path").alias("path"),
        F.first("scraped").alias("scraped"),
        F.max_by("final", "order").alias("final"),
        F.count_if(F.col("scraped").isNull()).alias("n_added"),
        F.count_if(updated).alias("n_updated"),
        # of conflicts, the last
        F.max_by("settled", F.when(conflict, F.col("order"))).alias("settled"),
    )


def _changed(section: Column, values: Column) -> Column:
    """An object (or nothing) with some members replaced or added."""
    return object_of(with_members(F.coalesce(members(section), nothing()), values))


def nothing() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def put_values(top: Column, values: Column, paths: dict[str, str] = FIELD_PATHS) -> tuple[Column, Column]:
    """The sections of a document that change when ``values`` (a map of fields to JSON) are put at their paths, as a map, and the fields whose paths it can't take.

    ``top``: the document's members. Paths are ``section.member`` or ``section.place.member``. A section of another kind stays as it is
    and its fields are reported; missing sections are made and lists grow by empty objects.
    """
    sections: dict[str, dict[int | None, dict[str, str]]] = {}
    for field, path in paths.items():
        section, *place, member = path.split(".")
        sections.setdefault(section, {}).setdefault(int(place[0]) if place else None, {})[field] = member
    changed, failed = [], []
    for section, places in sections.items():
        mine = F.filter(F.map_keys(values), _one_of([f for fields in places.values() for f in fields]))
        old = F.element_at(top, F.lit(section))
        is_list = None not in places
        fits = old.isNull() | old.startswith("[" if is_list else "{")
        given = {place: F.map_from_entries(_entries(values, fields)) for place, fields in places.items()}
        new = _changed_list(old, given) if is_list else _changed(old, given[None])
        changed.append(F.struct(F.lit(section).alias("key"), F.when(fits & (F.size(mine) > 0), new).alias("value")))
        failed.append(F.when(~fits, mine).otherwise(F.array().cast("array<string>")))
    return F.map_from_entries(F.filter(F.array(*changed), lambda e: e["value"].isNotNull())), F.array_sort(F.flatten(F.array(*failed)))


def with_members(top: Column, changed: Column) -> Column:
    return F.map_concat(F.map_filter(top, lambda k, _: ~F.map_contains_key(changed, k)), changed)


def _one_of(names: list[str]) -> Callable[[Column], Column]:
    return lambda k: k.isin(*names)


def _changed_list(section: Column, given: dict[int, Column]) -> Column:
    """A list (or nothing) whose items at some places have members replaced or added; it grows by empty objects as far as it must."""
    held = F.coalesce(items(section), F.array().cast("array<string>"))
    size = F.greatest(F.size(held), *(F.when(F.size(v) > 0, place + 1).otherwise(0) for place, v in given.items()))
    slots = F.filter(F.sequence(F.lit(0), size), lambda i: i < size)

    def item(i: Column) -> Column:
        old = F.coalesce(F.get(held, i), F.lit("{}"))
        out = old
        for place, changes in given.items():
            out = F.when((i == place) & (F.size(changes) > 0), _changed(old, changes)).otherwise(out)
        return out

    return list_of(F.transform(slots, item))


def _entries(values: Column, fields: dict[str, str]) -> Column:
    """Those of ``values`` that ``fields`` names, under their members' names."""
    all_ = F.array(*(F.struct(F.lit(member).alias("key"), F.element_at(values, F.lit(field)).alias("value"), F.map_contains_key(values, F.lit(field)).alias("given")) for field, member in fields.items()))
    return F.transform(F.filter(all_, lambda e: e["given"]), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("null")).alias("value")))


def merged_projects(projects: DataFrame, extractions: DataFrame, paths: dict[str, str] = FIELD_PATHS, strategy: Column | None = None) -> DataFrame:
    """project_id, document, success, n_added, n_updated, n_conflicts, needs_review, errors; other columns of ``projects`` are dropped.

    The document's metadata say which sources and fields it comes from; ``extracted_documents`` holds the last extraction of each kind.
    Projects without extractions come through with their sources marked.
    """
    fields = merged_fields(projects, extractions, paths, strategy)
    source = F.when(F.col("n_updated") > 0, UPDATED).when(F.col("n_added") > 0, ADDED)
    entry = lambda v: F.struct("field", v)
    found = fields.groupBy("project_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry(F.coalesce("final", F.lit("null")))))).alias("values"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(source.isNotNull(), entry(quoted(source)))))).alias("sources"),
        F.sum("n_added").alias("n_added"),
        F.sum("n_updated").alias("n_updated"),
        F.count_if(F.coalesce("settled.review", F.lit(False))).alias("n_conflicts"),
    )
    kind = F.coalesce("document_type", F.lit("unknown"))
    last = extractions.groupBy("project_id", kind.alias("kind")).agg(F.max_by("fields", F.struct("seq", "fields")).alias("fields"))
    kinds = last.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.coalesce(F.to_json(strict(F.col("fields"))), F.lit("null")))))).alias("kinds"))
    rows = projects.select("project_id", strict(F.col("document")).alias("document")).join(found, "project_id", "left").join(kinds, "project_id", "left")
    # a document that is no JSON is an empty one; each step is a projection of its own, so that none is computed twice
    rows = rows.withColumns({"values": F.coalesce("values", nothing()), "sources": F.coalesce("sources", nothing()), "top": F.coalesce(members(F.to_json("document")), nothing())})
    changed, failed = put_values(F.col("top"), F.col("values"), paths)
    rows = rows.withColumns({"changed": changed, "errors": failed}).withColumn("built", with_members(F.col("top"), F.col("changed")))
    metadata = F.element_at("built", F.lit("metadata"))
    sources = F.when(F.col("kinds").isNull(), F.lit('["scraped"]')).otherwise(F.lit('["scraped","pdf_extracted"]'))
    marks = F.create_map(F.lit("schema_version"), F.lit('"2.0"'), F.lit("data_sources"), sources, F.lit("field_sources"), _changed(F.element_at(members(metadata), F.lit("field_sources")), F.col("sources")))
    extracted = F.when(F.col("kinds").isNull(), F.coalesce(F.element_at("built", F.lit("extracted_documents")), F.lit("{}"))).otherwise(_changed(F.element_at("built", F.lit("extracted_documents")), F.col("kinds")))
    own = F.create_map(F.lit("metadata"), _changed(metadata, marks), F.lit("extracted_documents"), extracted)
    document = object_of(F.map_concat(F.map_filter("built", lambda k, _: ~k.isin("metadata", "extracted_documents")), own))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("project_id", document.alias("document"), (F.size("errors") == 0).alias("success"), zero("n_added"), zero("n_updated"), zero("n_conflicts"), (zero("n_conflicts") > 0).alias("needs_review"), "errors")


def merge_report(merged: DataFrame) -> DataFrame:
    """One row of totals over merged projects."""
    return merged.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.count_if("needs_review").alias("needs_review"),
        F.coalesce(F.sum("n_added"), F.lit(0)).alias("total_fields_added"), F.coalesce(F.sum("n_updated"), F.lit(0)).alias("total_fields_updated"), F.coalesce(F.sum("n_conflicts"), F.lit(0)).alias("total_conflicts"),
    )


# Projects with a scraped document each, and the documents found for them; both engines make them from the tables.
FOUND = """SELECT c_custkey AS project_id, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'layout_plan' WHEN 1 THEN 'bank_passbook' ELSE NULL END AS document_type,
    CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN c_name || ' Heights' ELSE 'The "' || c_mktsegment || '" villas' END AS s_name,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN upper(c_name) WHEN 2 THEN c_name || ' Phase ' || o_orderpriority WHEN 3 THEN 'Villa ' || c_mktsegment WHEN 4 THEN '   ' WHEN 5 THEN c_name ELSE '  ' || c_name || '   heights' END AS p_name,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 9 END AS s_units,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 9 END AS p_units,
    CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment || ' BANK' END AS s_bank,
    CASE o_orderkey % 3 WHEN 0 THEN 'Bank of ' || o_orderpriority WHEN 1 THEN c_mktsegment ELSE NULL END AS p_bank,
    CASE WHEN o_orderkey % 11 < 3 THEN 'Promoter ' || o_orderpriority END AS p_promoter
    FROM {orders} JOIN {customer} ON c_custkey = o_custkey"""


def _parts(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    details = F.struct(F.col("s_name").alias("project_name"), F.col("s_units").alias("total_units"), F.lit("Raipur").alias("state"))
    banks = F.when(F.col("s_bank").isNotNull(), F.array(F.struct(F.col("s_bank").alias("bank_name"), F.lit("kept").alias("note"))))
    projects = x.groupBy("project_id").agg(*(F.max(c).alias(c) for c in ("s_name", "s_units", "s_bank")))
    projects = projects.select("project_id", F.to_json(F.struct(details.alias("project_details"), banks.alias("bank_details"), F.struct(F.lit(1).alias("run")).alias("metadata"))).alias("document"))
    fields = F.struct(F.col("p_name").alias("project_name"), F.col("p_units").alias("total_units"), F.col("p_bank").alias("bank_name"), F.col("p_promoter").alias("promoter_name"), F.lit("x").alias("other"))
    return projects, x.select("project_id", "seq", "document_type", F.to_json(fields).alias("fields"))


def _field_rows(x: DataFrame) -> DataFrame:
    from cadastra.functions.conflict import text_of

    rows = merged_fields(*_parts(x))
    settled = [F.col(f"settled.{c}").alias(c) for c in ("strategy", "confidence", "review", "note")]
    return rows.select("project_id", "field", "path", text_of(F.col("scraped")).alias("scraped"), text_of(F.col("final")).alias("final"), "n_added", "n_updated", *settled)


def _documents(x: DataFrame) -> DataFrame:
    at = lambda p: F.get_json_object("document", p)
    return merged_projects(*_parts(x)).select(
        "project_id", at("$.project_details.project_name").alias("name"), at("$.project_details.total_units").alias("units"), at("$.project_details.state").alias("state"),
        at("$.bank_details[0].bank_name").alias("bank"), at("$.bank_details[0].note").alias("bank_note"), at("$.promoter_details[0].name").alias("promoter"), at("$.metadata.run").alias("run"),
        at("$.metadata.schema_version").alias("version"), at("$.metadata.field_sources.project_name").alias("name_source"), at("$.metadata.field_sources.promoter_name").alias("promoter_source"),
        F.size(F.split(F.coalesce(at("$.extracted_documents.unknown"), F.lit("")), "other")).alias("n_unknown"), "success", "n_added", "n_updated", "n_conflicts", "needs_review",
    )


# The same rules said apart, over columns instead of documents.
SETTLED = r"""
v AS (
  SELECT project_id, seq, 'project_name' AS field, 'project_details.project_name' AS path, s_name AS s, p_name AS p, true AS text, true AS longer FROM x
  UNION ALL SELECT project_id, seq, 'total_units', 'project_details.total_units', CAST(s_units AS VARCHAR), CAST(p_units AS VARCHAR), false, false FROM x
  UNION ALL SELECT project_id, seq, 'bank_name', 'bank_details.0.bank_name', s_bank, p_bank, true, false FROM x
  UNION ALL SELECT project_id, seq, 'promoter_name', 'promoter_details.0.name', NULL, p_promoter, true, true FROM x),
n AS (
  SELECT *, s IS NOT NULL AND s <> p AS conflict, text AND trim(s) = '' AS no_s, text AND trim(p) = '' AS no_p,
         regexp_replace(lower(trim(s)), '\s+', ' ', 'g') AS fs, regexp_replace(lower(trim(p)), '\s+', ' ', 'g') AS fp FROM v WHERE p IS NOT NULL),
o AS (
  SELECT *, CASE WHEN no_s AND no_p THEN 1 WHEN no_s THEN 2 WHEN no_p THEN 3 WHEN text AND (contains(fs, fp) OR contains(fp, fs)) THEN 4 WHEN NOT longer THEN 5
                 WHEN length(p) > length(s) THEN 6 WHEN length(s) > length(p) THEN 7 ELSE 8 END AS way FROM n),
t AS (
  SELECT *, CASE WHEN NOT conflict THEN p WHEN way = 1 THEN NULL WHEN way IN (3, 7) THEN s ELSE p END AS final,
         CASE WHEN way = 3 THEN 'prefer_scraped' WHEN way >= 6 THEN 'prefer_longer' ELSE 'prefer_pdf' END AS strategy,
         CASE WHEN way <= 4 THEN 1.0 WHEN way = 5 THEN 0.9 WHEN way = 8 THEN 0.7 ELSE 0.8 END AS confidence,
         CASE way WHEN 1 THEN 'Both values empty' WHEN 2 THEN 'Scraped value empty, using PDF' WHEN 3 THEN 'PDF value empty, using scraped' WHEN 4 THEN 'Values match' WHEN 5 THEN 'Preferred PDF value'
           WHEN 6 THEN 'PDF value longer (' || length(p) || ' vs ' || length(s) || ' chars)' WHEN 7 THEN 'Scraped value longer (' || length(s) || ' vs ' || length(p) || ' chars)'
           ELSE 'Same length, defaulting to PDF' END AS note FROM o),
g AS (
  SELECT project_id, field, path, max(s) AS scraped, arg_max_null(final, seq) AS final, count(*) FILTER (WHERE s IS NULL) AS n_added,
         count(*) FILTER (WHERE conflict AND final IS DISTINCT FROM s) AS n_updated,
         arg_max(strategy, seq) FILTER (WHERE conflict) AS strategy, arg_max(CAST(confidence AS DOUBLE), seq) FILTER (WHERE conflict) AS confidence,
         CASE WHEN count(*) FILTER (WHERE conflict) > 0 THEN false END AS review, arg_max(note, seq) FILTER (WHERE conflict) AS note
  FROM t GROUP BY project_id, field, path)"""
PER_PROJECT = """
SELECT p.project_id,
       CASE WHEN count(*) FILTER (WHERE field = 'project_name') > 0 THEN max(final) FILTER (WHERE field = 'project_name') ELSE max(p.s_name) END AS name,
       CASE WHEN count(*) FILTER (WHERE field = 'total_units') > 0 THEN max(final) FILTER (WHERE field = 'total_units') ELSE CAST(max(p.s_units) AS VARCHAR) END AS units, 'Raipur' AS state,
       CASE WHEN count(*) FILTER (WHERE field = 'bank_name') > 0 THEN max(final) FILTER (WHERE field = 'bank_name') ELSE max(p.s_bank) END AS bank,
       CASE WHEN max(p.s_bank) IS NOT NULL THEN 'kept' END AS bank_note, max(final) FILTER (WHERE field = 'promoter_name') AS promoter, '1' AS run, '2.0' AS version,
       max(CASE WHEN n_updated > 0 THEN 'pdf_extracted (updated)' WHEN n_added > 0 THEN 'pdf_extracted' END) FILTER (WHERE field = 'project_name') AS name_source,
       max(CASE WHEN n_added > 0 THEN 'pdf_extracted' END) FILTER (WHERE field = 'promoter_name') AS promoter_source,
       CAST(1 + max(p.unknown) AS INTEGER) AS n_unknown, true AS success, CAST(coalesce(sum(n_added), 0) AS BIGINT) AS n_added, CAST(coalesce(sum(n_updated), 0) AS BIGINT) AS n_updated,
       CAST(0 AS BIGINT) AS n_conflicts, false AS needs_review
FROM (SELECT project_id, max(s_name) AS s_name, max(s_units) AS s_units, max(s_bank) AS s_bank, max(CASE WHEN document_type IS NULL THEN 1 ELSE 0 END) AS unknown FROM x GROUP BY project_id) p
LEFT JOIN g ON g.project_id = p.project_id GROUP BY p.project_id"""

RULES = [
    Rule("scr12_conflicts", ("SCR12",), FOUND, _field_rows, f", {SETTLED} SELECT * FROM g"),
    Rule("scr13_merged_projects", ("SCR13", "NST02"), FOUND, _documents, f", {SETTLED} {PER_PROJECT}"),
]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
