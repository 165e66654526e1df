"""The quality gate: every rule gives a flag or none, the flags of a row are an array of structs, and the status follows from them.

The price of a locality is the exact median of its rows, taken by distributed selection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators.records import Rule
from cadastra.operators.selection import grouped_quantiles


@dataclass(frozen=True)
class Bounds:
    """Bounds of sums and of rates (rupees), of areas (square feet), and the deviation from a locality that is flagged; twice that is an error."""

    total: tuple[float, float] = (100_000, 10_000_000_000)
    rate: tuple[float, float] = (500, 100_000)
    area: tuple[float, float] = (100, 100_000)
    deviation: float = 0.30


# Fields that must be filled, those that should be, and fields with bounds, in the order of the checks.
CRITICAL = ("rera_registration_number", "project_name", "district")
IMPORTANT = ("project_status", "promoter_name", "approved_date")
TOTALS, RATES = ("min_price_total", "max_price_total"), ("min_price_per_sqft", "max_price_per_sqft")
AREAS = ("carpet_area_sqft", "builtup_area_sqft", "super_builtup_area_sqft")
FLAG = "struct<type:string,severity:string,message:string,field:string,expected:string,actual:string>"


def figure(value: Column | float) -> Column:
    """A number as text without needless zeros; none for zero, which counts as nothing to show."""
    value = F.lit(value) if isinstance(value, (int, float)) else value
    text = F.regexp_replace(value.cast("decimal(30,6)").cast("string"), r"\.?0+$", "")
    return F.when(value != 0, text)


def flag(when: Column, kind: str, severity: str | Column, message: str | Column, field: str, expected: Column | str | None, actual: Column | None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    whole = F.struct(lit(kind).alias("type"), lit(severity).alias("severity"), lit(message).alias("message"), F.lit(field).alias("field"), lit(expected).cast("string").alias("expected"), lit(actual).cast("string").alias("actual"))
    return F.when(when, whole).cast(FLAG)


def _bounded(field: str, least: float, most: float, kinds: tuple[str, str], over: str) -> list[Column]:
    value, plain = F.col(field), lambda x: F.lit(f"{x:g}" if x < 1e6 else str(int(x)))
    return [
        flag(value < least, kinds[0], "warning", f"{field} below minimum threshold", field, F.concat(F.lit(">= "), plain(least)), figure(value)),
        flag(value > most, kinds[1], over, f"{field} exceeds maximum threshold", field, F.concat(F.lit("<= "), plain(most)), figure(value)),
    ]


def quality_flags(columns: list[str], bounds: Bounds = Bounds()) -> Column:
    """array of flags of a row, in the order of the checks; a column that is not there is null (missing, or nothing to check)."""
    col = lambda c: F.col(c) if c in columns else F.lit(None)
    rules: list[Column] = []
    for names, severity, kind in ((CRITICAL, "error", "critical"), (IMPORTANT, "warning", "important")):
        for name in names:
            text = col(name).cast("string")
            rules.append(flag(text.isNull() | text.rlike(r"(?U)^\s*$"), "missing_critical", severity, f"Missing {kind} field: {name}", name, "non-empty value", F.when(text != "", text)))
    for names, (least, most) in ((TOTALS, bounds.total), (RATES, bounds.rate)):
        for name in names:
            if name in columns:
                rules += _bounded(name, least, most, ("price_below_min", "price_above_max"), "error")
    # zero counts as no price
    rate = F.coalesce(*(F.when(col(c) != 0, col(c)) for c in ("price_per_sqft", "min_price_per_sqft"))).cast("double")
    around = col("locality_price").cast("double")
    deviation = F.when(around > 0, F.abs(rate - around) / around)
    severity = F.when(deviation > 2 * bounds.deviation, "error").otherwise("warning")
    percent = f"{bounds.deviation:.0%}"
    message = F.format_string(f"Price deviates %.1f%% from locality average (threshold: {percent}%)", deviation * 100)
    rules.append(flag(deviation > bounds.deviation, "price_locality_mismatch", severity, message, "price_per_sqft", F.concat(figure(around), F.lit(f" ± {percent}")), figure(rate)))
    for name in AREAS:
        if name in columns:
            rules += _bounded(name, *bounds.area, ("bounds_exceeded", "bounds_exceeded"), "warning")
    approved, proposed, extended = (col(c) for c in ("approved_date", "proposed_end_date", "extended_end_date"))
    for when, severity, message, field, after, actual in (
        (proposed < approved, "warning", "Proposed end date is before approved date", "proposed_end_date", approved, proposed),
        (extended < proposed, "info", "Extended end date is before proposed end date", "extended_end_date", proposed, extended),
    ):
        rules.append(flag(when, "data_inconsistency", severity, message, field, F.concat(F.lit(">= "), after.cast("string")), actual))
    return F.filter(F.array(*rules), lambda f: f.isNotNull())


def gated(projects: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """``projects`` with flags, status, flag_count, error_count and warning_count (columns so named before are replaced).

    failed where a flag is an error, else warning where one is a warning; passed without any flag; information alone leaves the
    row pending.
    """
    out = projects.withColumn("flags", quality_flags(projects.columns, bounds))
    has = lambda severity: F.exists("flags", lambda f: f["severity"] == severity)
    status = F.when(has("error"), "failed").when(has("warning"), "warning").when(F.size("flags") == 0, "passed").otherwise("pending")
    count = lambda severity: F.size(F.filter("flags", lambda f: f["severity"] == severity)).cast("long")
    return out.withColumns({"status": status, "flag_count": F.size("flags").cast("long"), "error_count": count("error"), "warning_count": count("warning")})


def with_locality_price(projects: DataFrame, keys: list[str], rate: str = "min_price_per_sqft") -> DataFrame:
    """``projects`` with locality_price, the median ``rate`` of the rows with the same ``keys``; rows with a null key have none."""
    # few localities beside the projects: one row each
    return projects.drop("locality_price").join(grouped_quantiles(projects.dropna(subset=keys), keys, rate, {"locality_price": 0.5}), keys, "left")


PROJECTS = """SELECT project_id, CASE project_id % 23 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE reg_no END AS rera_registration_number, CASE WHEN project_id % 29 = 0 THEN '' ELSE project_name END AS project_name,
    CASE WHEN project_id % 31 = 0 THEN NULL ELSE district END AS district, CASE WHEN project_id % 19 = 0 THEN NULL ELSE status END AS project_status,
    CASE project_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE project_type END AS promoter_name, CASE WHEN project_id % 17 = 0 THEN NULL ELSE approved_date END AS approved_date,
    CASE project_id % 6 WHEN 0 THEN CAST('1994-01-01' AS DATE) WHEN 1 THEN NULL ELSE CAST('2001-01-01' AS DATE) END AS proposed_end_date,
    CASE project_id % 7 WHEN 0 THEN CAST('1993-01-01' AS DATE) WHEN 1 THEN NULL ELSE CAST('2002-01-01' AS DATE) END AS extended_end_date,
    CASE project_id % 9 WHEN 0 THEN NULL WHEN 1 THEN total_price / 10 WHEN 2 THEN 0 ELSE total_price * 10 END AS min_price_total, CASE WHEN project_id % 13 = 0 THEN total_price * 100000 ELSE total_price * 20 END AS max_price_total,
    CASE project_id % 8 WHEN 0 THEN NULL WHEN 1 THEN total_price / 1000 WHEN 2 THEN total_price * 10 ELSE 30000 + total_price / 100 END AS min_price_per_sqft, CASE WHEN project_id % 10 < 3 THEN total_price ELSE 40000 END AS max_price_per_sqft,
    CASE project_id % 12 WHEN 0 THEN 40 WHEN 1 THEN 99.5 WHEN 2 THEN 200000 ELSE 900 END AS carpet_area_sqft, CASE WHEN project_id % 14 = 0 THEN 100001 ELSE 100000 END AS builtup_area_sqft
    FROM {projects}"""


def _gate_rows(x: DataFrame) -> DataFrame:
    rows = gated(with_locality_price(x, ["district"]))
    kinds = F.array_join(F.transform("flags", lambda f: F.concat_ws(":", f["severity"], f["type"], f["field"])), ";")
    shown = F.array_join(F.transform(F.filter("flags", lambda f: f["type"].isin("bounds_exceeded", "data_inconsistency")), lambda f: F.concat_ws(" ", f["message"], f["expected"], f["actual"])), ";")
    return rows.select("project_id", "status", "flag_count", "error_count", "warning_count", kinds.alias("kinds"), shown.alias("shown"))


GATE_CHECK = r"""
, l AS (SELECT district, median(min_price_per_sqft) AS mid FROM x WHERE district IS NOT NULL GROUP BY district),
y AS (SELECT x.*, abs(nullif(min_price_per_sqft, 0) - mid) / nullif(greatest(mid, 0), 0) AS off FROM x LEFT JOIN l ON l.district = x.district),
f AS (
  SELECT project_id, unnest([
    CASE WHEN rera_registration_number IS NULL OR trim(rera_registration_number) = '' THEN 'error:missing_critical:rera_registration_number|' END,
    CASE WHEN project_name IS NULL OR trim(project_name) = '' THEN 'error:missing_critical:project_name|' END,
    CASE WHEN district IS NULL OR trim(district) = '' THEN 'error:missing_critical:district|' END,
    CASE WHEN project_status IS NULL OR trim(project_status) = '' THEN 'warning:missing_critical:project_status|' END,
    CASE WHEN promoter_name IS NULL OR trim(promoter_name) = '' THEN 'warning:missing_critical:promoter_name|' END,
    CASE WHEN approved_date IS NULL THEN 'warning:missing_critical:approved_date|' END,
    CASE WHEN min_price_total < 100000 THEN 'warning:price_below_min:min_price_total|' END, CASE WHEN min_price_total > 10000000000 THEN 'error:price_above_max:min_price_total|' END,
    CASE WHEN max_price_total < 100000 THEN 'warning:price_below_min:max_price_total|' END, CASE WHEN max_price_total > 10000000000 THEN 'error:price_above_max:max_price_total|' END,
    CASE WHEN min_price_per_sqft < 500 THEN 'warning:price_below_min:min_price_per_sqft|' END, CASE WHEN min_price_per_sqft > 100000 THEN 'error:price_above_max:min_price_per_sqft|' END,
    CASE WHEN max_price_per_sqft < 500 THEN 'warning:price_below_min:max_price_per_sqft|' END, CASE WHEN max_price_per_sqft > 100000 THEN 'error:price_above_max:max_price_per_sqft|' END,
    CASE WHEN off > 0.6e0 THEN 'error:price_locality_mismatch:price_per_sqft|' WHEN off > 0.3e0 THEN 'warning:price_locality_mismatch:price_per_sqft|' END,
    CASE WHEN carpet_area_sqft < 100 THEN 'warning:bounds_exceeded:carpet_area_sqft|carpet_area_sqft below minimum threshold >= 100 ' || CASE WHEN carpet_area_sqft = 40 THEN '40' ELSE '99.5' END END,
    CASE WHEN carpet_area_sqft > 100000 THEN 'warning:bounds_exceeded:carpet_area_sqft|carpet_area_sqft exceeds maximum threshold <= 100000 200000' END,
    CASE WHEN builtup_area_sqft > 100000 THEN 'warning:bounds_exceeded:builtup_area_sqft|builtup_area_sqft exceeds maximum threshold <= 100000 100001' END,
    CASE WHEN proposed_end_date < approved_date THEN 'warning:data_inconsistency:proposed_end_date|Proposed end date is before approved date >= ' || CAST(approved_date AS VARCHAR) || ' ' || CAST(proposed_end_date AS VARCHAR) END,
    CASE WHEN extended_end_date < proposed_end_date THEN 'info:data_inconsistency:extended_end_date|Extended end date is before proposed end date >= ' || CAST(proposed_end_date AS VARCHAR) || ' ' || CAST(extended_end_date AS VARCHAR) END]) AS f,
    unnest(range(20)) AS i FROM y)
SELECT project_id, CASE WHEN count(*) FILTER (WHERE starts_with(f, 'error')) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE starts_with(f, 'warning')) > 0 THEN 'warning' WHEN count(f) = 0 THEN 'passed' ELSE 'pending' END AS status,
       count(f) AS flag_count, count(*) FILTER (WHERE starts_with(f, 'error')) AS error_count, count(*) FILTER (WHERE starts_with(f, 'warning')) AS warning_count,
       coalesce(string_agg(split_part(f, '|', 1), ';' ORDER BY i), '') AS kinds,
       coalesce(string_agg(nullif(split_part(f, '|', 2), ''), ';' ORDER BY i), '') AS shown
FROM f GROUP BY project_id"""

RULES = [Rule("scr07_quality_flags", ("SCR07", "Q20"), PROJECTS, _gate_rows, GATE_CHECK)]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
