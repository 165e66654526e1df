"""Two values of one field from two sources: which of them stands, how sure that is, and whether somebody must look.

Values are JSON texts, so that strings, numbers, lists and objects keep their kind in one column; null and ``null`` are no value.
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Strategy(StrEnum):
    PREFER_PDF = "prefer_pdf"
    PREFER_SCRAPED = "prefer_scraped"
    PREFER_LONGER = "prefer_longer"
    PREFER_NEWER = "prefer_newer"
    MERGE = "merge"
    MANUAL = "manual"


# The fields that don't prefer the document's value, and the confidence below which a field is reviewed.
LONGER_FIELDS = ("project_name", "project_address", "promoter_name", "promoter_address")
REVIEW_BELOW = 0.7
# Forms of a date that can be compared, tried in this order.
DATE_FORMS = (("\\d{4}-\\d{1,2}-\\d{1,2}", "yyyy-M-d"), ("\\d{1,2}-\\d{1,2}-\\d{4}", "d-M-yyyy"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "d/M/yyyy"), ("\\d{4}/\\d{1,2}/\\d{1,2}", "yyyy/M/d"))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.to_json(text.cast("variant"))


def members(json: Column) -> Column:
    """Keys of an object and the JSON of their values; null for what is no object."""
    return F.when(json.startswith("{"), F.transform_values(F.try_parse_json(json).cast("map<string,variant>"), lambda _, v: F.to_json(v)))


def items(json: Column) -> Column:
    """JSON of a list's items; null for what is no list."""
    return F.when(json.startswith("["), F.transform(F.try_parse_json(json).cast("array<variant>"), lambda v: F.to_json(v)))


def object_of(values: Column) -> Column:
    """The object with these keys and JSON values."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def list_of(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def is_text(json: Column) -> Column:
    return json.startswith('"')


def text_of(json: Column) -> Column:
    """A string's characters; any other value as its JSON."""
    return F.when(is_text(json), F.try_variant_get(F.try_parse_json(json), "$", "string")).otherwise(json)


def is_empty(json: Column) -> Column:
    blank = is_text(json) & text_of(json).rlike(r"(?U)^\s*$")
    return json.isNull() | json.isin("null", "[]", "{}") | blank


def same(a: Column, b: Column) -> Column:
    """Equal values; numbers by their size."""
    number = lambda v: F.when(v.rlike("^[-0-9]"), v.try_cast("decimal(38,9)"))
    return a.eqNullSafe(b) | F.coalesce(number(a) == number(b), F.lit(False))


def matches(a: Column, b: Column) -> Column:
    """Equal, or strings of which one holds the other when case and white space are left aside."""
    folded = lambda v: F.lower(F.btrim(F.regexp_replace(text_of(v), r"(?U)\s+", " ")))
    x, y = folded(a), folded(b)
    return same(a, b) | (is_text(a) & is_text(b) & (F.contains(x, y) | F.contains(y, x)))


def date_of(json: Column) -> Column:
    text = F.when(is_text(json), text_of(json))
    return F.coalesce(*(F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(form))) for shape, form in DATE_FORMS))


def strategy_of(field: Column, default: str = Strategy.PREFER_PDF) -> Column:
    return F.when(field.isin(*LONGER_FIELDS), F.lit(str(Strategy.PREFER_LONGER))).otherwise(F.lit(str(default)))


def resolution(scraped: Column, pdf: Column, strategy: Column) -> Column:
    """value, strategy, confidence, review, note. An empty side gives way; a match takes the document's spelling; then the strategy decides."""

    def outcome(value: Column, confidence: float, note: Column | str, used: str | None = None) -> Column:
        note = F.lit(note) if isinstance(note, str) else note
        return F.struct(value.alias("value"), (strategy if used is None else F.lit(str(used))).alias("strategy"), F.lit(confidence).alias("confidence"), F.lit(used is None and confidence < REVIEW_BELOW).alias("review"), note.alias("note"))

    nothing = F.lit(None).cast("string")
    s_size, p_size = F.char_length(text_of(scraped)), F.char_length(text_of(pdf))
    sizes = lambda who, x, y: F.format_string(f"{who} value longer (%d vs %d chars)", x, y)
    s_date, p_date = date_of(scraped), date_of(pdf)
    both = quoted(F.concat(text_of(scraped), F.lit(" | "), text_of(pdf)))
    lists = F.array_distinct(F.concat(items(scraped), items(pdf)))
    is_ = lambda s: strategy == F.lit(str(s))
    return (
        F.when(is_empty(scraped) & is_empty(pdf), outcome(nothing, 1.0, "Both values empty", Strategy.PREFER_PDF))
        .when(is_empty(scraped), outcome(pdf, 1.0, "Scraped value empty, using PDF", Strategy.PREFER_PDF))
        .when(is_empty(pdf), outcome(scraped, 1.0, "PDF value empty, using scraped", Strategy.PREFER_SCRAPED))
        .when(matches(scraped, pdf), outcome(pdf, 1.0, "Values match", Strategy.PREFER_PDF))
        .when(is_(Strategy.PREFER_PDF), outcome(pdf, 0.9, "Preferred PDF value"))
        .when(is_(Strategy.PREFER_SCRAPED), outcome(scraped, 0.9, "Preferred scraped value"))
        .when(is_(Strategy.PREFER_LONGER) & (p_size > s_size), outcome(pdf, 0.8, sizes("PDF", p_size, s_size)))
        .when(is_(Strategy.PREFER_LONGER) & (s_size > p_size), outcome(scraped, 0.8, sizes("Scraped", s_size, p_size)))
        .when(is_(Strategy.PREFER_LONGER), outcome(pdf, 0.7, "Same length, defaulting to PDF"))
        .when(is_(Strategy.PREFER_NEWER) & (p_date > s_date), outcome(pdf, 0.8, "PDF date is newer"))
        .when(is_(Strategy.PREFER_NEWER) & (p_date <= s_date), outcome(scraped, 0.8, "Scraped date is newer"))
        .when(is_(Strategy.PREFER_NEWER), outcome(pdf, 0.6, "Could not compare dates"))
        .when(is_(Strategy.MERGE) & lists.isNotNull(), outcome(list_of(lists), 0.8, "Merged lists"))
        .when(is_(Strategy.MERGE) & is_text(scraped) & is_text(pdf), outcome(both, 0.5, "Concatenated values (needs review)"))
        .when(is_(Strategy.MERGE), outcome(pdf, 0.6, "Could not merge, using PDF"))
        .when(is_(Strategy.MANUAL), outcome(pdf, 0.3, "Flagged for manual review"))
        .otherwise(outcome(pdf, 0.7, "Default resolution"))
    )
