"""Nested documents: paths, flattening and differences, header matching, mapping of extracted pages, structured output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.html import LATITUDES, LONGITUDES, listing_rows, parse_page
from cadastra.runtime import ship_package

#: Canonical fields and words of the labels that mean them, looked for in this order.
FIELDS = {
    "registration_number": ("registration no", "registration number", "reg no"),
    "project_name": ("project name", "name of project"),
    "project_type": ("project type", "type of project"),
    "project_status": ("project status", "status"),
    "district": ("district",),
    "tehsil": ("tehsil", "taluka"),
    "project_address": ("project address", "address"),
    "launch_date": ("commencement", "launch date", "start date"),
    "expected_completion_date": ("completion date", "end date"),
}
FLOATS, INTEGERS, DAYS = ("area", "price", "percent", "amount"), ("number", "units", "floors", "year"), ("date",)


def title_case(x: Column) -> Column:
    """First letter of every run of letters upper, the others lower, also after signs and digits."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def get_path(document: object, path: str) -> object:
    """Value at ``a.0.b`` or ``a[0].b``; None where a step is missing."""
    for step in re.findall(r"[^.\[\]]+", path):
        if isinstance(document, list) and step.isdigit() and int(step) < len(document):
            document = document[int(step)]
        elif isinstance(document, dict):
            document = document.get(step)
        else:
            return None
    return document


def set_path(document: dict, path: str, value: object) -> dict:
    """``document`` with the value put at the path; steps that are missing are made, lists grow."""
    at: object = document
    steps = re.findall(r"[^.\[\]]+", path)
    for here, step in enumerate(steps):
        last = here + 1 == len(steps)
        fresh: object = value if last else ([] if steps[here + 1].isdigit() else {})
        if isinstance(at, list):
            at.extend([None] * (int(step) + 1 - len(at)))
            if last or at[int(step)] is None:
                at[int(step)] = fresh
            at = at[int(step)]
        elif isinstance(at, dict):
            if last or at.get(step) is None:
                at[step] = fresh
            at = at[step]
    return document


def flatten(document: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, JSON of the value) of every leaf."""
    if isinstance(document, dict) and document:
        for key, value in sorted(document.items()):
            yield from flatten(value, f"{path}.{key}" if path else key)
    elif isinstance(document, list) and document:
        for i, value in enumerate(document):
            yield from flatten(value, f"{path}[{i}]")
    else:
        yield path, json.dumps(document, ensure_ascii=False)


def leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value of the JSON in ``text``; text that isn't JSON has one leaf with an empty path."""
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, paths, values = [], [], []
            for i, raw in enumerate(batch.column("text").to_pylist()):
                try:
                    found = list(flatten(json.loads(raw)))
                except (TypeError, ValueError):
                    found = [("", json.dumps(raw))]
                for path, value in found:
                    owner.append(i)
                    paths.append(path)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[key, "path", "value"])

    return df.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, path string, value string")


def differences(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, left, right of every leaf that differs or that one side lacks."""
    a = leaves(left, key, text).withColumnRenamed("value", "left")
    b = leaves(right, key, text).withColumnRenamed("value", "right")
    return a.join(b, [key, "path"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def typed(name: str, value: str) -> object:
    """A cell by the words in its field's name; None if it can't be read so."""
    text = value.replace(",", "").strip()
    if any(w in name for w in DAYS):
        for pattern in (r"(\d{2})[-/.](\d{2})[-/.](\d{4})$", r"(\d{4})-(\d{2})-(\d{2})$"):
            if found := re.match(pattern, text):
                parts = found.groups()
                return "-".join(parts if len(parts[0]) == 4 else parts[::-1])
        return None
    if any(w in name for w in FLOATS):
        found = re.search(r"-?\d+(?:\.\d+)?", text)
        return float(found[0]) if found else None
    if any(w in name for w in INTEGERS):
        digits = re.sub(r"\D", "", text)
        return int(digits) if digits else None
    return value.strip() or None


def table_records(headers: list[str], rows: list[list[str]], names: dict[str, tuple[str, ...]]) -> list[dict]:
    """Rows as records: a header belongs to the first name one of whose words it contains. Rows without any value are dropped."""
    heads = [re.sub(r"[^a-z0-9]+", " ", h.lower()).strip() for h in headers]
    places = {name: i for i, h in reversed(list(enumerate(heads))) for name, words in names.items() if any(w in h for w in words)}
    out = []
    for row in rows:
        record = {name: typed(name, row[i]) for name, i in places.items() if i < len(row)}
        if any(v is not None for v in record.values()):
            out.append(record)
    return out


def project_document(html: str, registration_number: str | None = None) -> dict:
    """The canonical document of a detail page; labels that mean nothing known are kept by section."""
    page = parse_page(html)
    details: dict[str, object] = {}
    unknown: dict[str, dict[str, str]] = {}
    for section, label, value in page.fields:
        plain = re.sub(r"[^a-z0-9]+", " ", label.lower()).strip()
        name = next((n for n, words in FIELDS.items() if any(w in plain for w in words)), None)
        if name and name not in details:
            details[name] = typed(name, value)
        elif not name:
            unknown.setdefault(section, {})[label] = value
    if registration_number:
        details.setdefault("registration_number", registration_number)
    units = [r for t in page.tables for r in table_records(t["headers"], t["rows"], {"name": ("unit type", "flat type"), "carpet_area_sq_m": ("carpet",), "price_in_inr": ("price", "amount")}) if r.get("name")]
    return {"project_details": details, "unit_types": units, "raw_data": {"unmapped_sections": unknown}}


def map_pages(pages: DataFrame, key: str, html: str, registration: str | None = None) -> DataFrame:
    """key, document (JSON) of every page."""
    ship_package(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(project_document(h or "", r), ensure_ascii=False) for h, r in zip(batch.column("html").to_pylist(), batch.column("reg").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "document"])

    reg = F.col(registration) if registration else F.lit(None).cast("string")
    return pages.select(key, F.col(html).alias("html"), reg.alias("reg")).mapInArrow(run, f"{key} {kind}, document string")


def amenity_rows(html: str) -> list[dict]:
    """Amenities of the table whose headers name one, with coordinates inside the bounds; others are dropped."""
    names = {"amenity": ("amenity", "facility"), "area": ("area",), "latitude": ("latitude", "lat"), "longitude": ("longitude", "long", "lng")}
    page = parse_page(html)
    out = []
    for record in listing_rows(page, names):
        try:
            lat, lon = float(record.get("latitude", "")), float(record.get("longitude", ""))
        except ValueError:
            continue
        if record.get("amenity") and LATITUDES[0] <= lat <= LATITUDES[1] and LONGITUDES[0] <= lon <= LONGITUDES[1]:
            out.append({"amenity": record["amenity"], "area": typed("area", record.get("area", "")), "latitude": lat, "longitude": lon})
    return out


def linked_data(projects: DataFrame) -> DataFrame:
    """project_id, json_ld: a schema.org description; what is null is left out."""
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.lit("GeoCoordinates").alias("@type"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))
    offer = F.when(F.col("total_price").isNotNull(), F.struct(F.lit("Offer").alias("@type"), F.col("total_price").alias("price"), F.lit("INR").alias("priceCurrency")))
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ApartmentComplex").alias("@type"), F.col("project_name").alias("name"), F.col("reg_no").alias("identifier"), place.alias("geo"), offer.alias("offers"))
    return projects.select("project_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("json_ld"))
