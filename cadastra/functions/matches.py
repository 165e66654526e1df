"""Every match of a pattern with its place and what stands around it, as arrays; no Python runs.

The parts between matches come from ``split``; a match and the part before it make a piece of one character at least, so
that ``n`` characters around a match lie within ``n`` pieces, however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0, before: int = 0, after: int = 0) -> Column:
    """array<struct<raw, value, place, before, after>>, in order: the match, its ``group``, its first character's place from 0, and what stands ``before`` and ``after`` it.

    Null for a null text. ``pattern`` must not match the empty string.
    """
    raws = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else raws
    parts = F.split(text, pattern, -1)
    led = F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.get(raws, i - 1)).otherwise(F.lit("")), p))
    trailed = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(raws, i), F.lit(""))))
    sizes = F.transform(led, lambda p: F.char_length(p).cast("long"))
    # where each piece ends, summed up over the pieces
    ends = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda done, n: F.array_append(done, F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1), F.lit(0)) + n))
    prior = lambda i: F.right(F.array_join(F.slice(led, F.greatest(i + 2 - F.lit(before + 1), F.lit(1)), F.least(i + 1, F.lit(before + 1))), ""), F.lit(before)) if before else F.lit("")
    later = lambda i: F.left(F.array_join(F.slice(trailed, i + 2, F.lit(after + 1)), ""), F.lit(after)) if after else F.lit("")
    return F.transform(raws, lambda raw, i: F.struct(raw.alias("raw"), F.get(values, i).alias("value"), F.get(ends, i).alias("place"), prior(i).alias("before"), later(i).alias("after")))


# Amounts of money, the words that multiply them, and areas with their units and square feet.
AMOUNTS = (r"₹\s*([\d,]+(?:\.\d{2})?)", r"Rs\.?\s*([\d,]+(?:\.\d{2})?)", r"INR\s*([\d,]+(?:\.\d{2})?)", r"([\d,]+(?:\.\d{2})?)\s*(?:rupees|lakhs?|crores?)")
TIMES = (("crore", 10_000_000), ("lakh", 100_000))
AREAS = (
    (r"([\d,]+\.?\d*)\s*(?:sq\.?\s*(?:ft|feet))", "sq_ft"), (r"([\d,]+\.?\d*)\s*(?:square\s+feet)", "sq_ft"), (r"([\d,]+\.?\d*)\s*(?:sq\.?\s*(?:m|meter|metre))", "sq_m"),
    (r"([\d,]+\.?\d*)\s*(?:square\s+meter)", "sq_m"), (r"([\d,]+\.?\d*)\s*(?:acres?)", "acres"), (r"([\d,]+\.?\d*)\s*(?:hectares?)", "hectares"),
)
SQUARE_FEET = {"sq_ft": 1.0, "sq_m": 10.764, "acres": 43560.0, "hectares": 107639.0}
# Dates and reference numbers in documents.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATES = (r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b", rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b")
REFERENCES = (
    (r"(?:approval|license|permission|registration)\s*(?:no\.?|number)\s*:?\s*([A-Z0-9\-/]+)", 1), (r"(?:ref\.?|reference)\s*(?:no\.?|number)\s*:?\s*([A-Z0-9\-/]+)", 1),
    (r"RERA[A-Z]*\d+", 0), (r"[A-Z]{2,}[-/]\d{2,}[-/]\d+", 0),
)
# Words before a date, a cost, an area and a number that say what it is, and how far before; lines that name an authority.
APPROVED, VALID, COST, AREA, NUMBER = ("approval|sanctioned|granted|issued", 50), ("valid|expir|till|until", 50), ("total|project cost|estimated cost", 100), ("total|plot area|land area|project area", 100), ("approval|permission|license|registration", 50)
AUTHORITIES = (r"issued\s+by\s*:?\s*([A-Za-z\s]+?)(?:\n|$)", r"authority\s*:?\s*([A-Za-z\s]+?)(?:\n|$)", r"(?:signed|certified)\s+by\s*:?\s*([A-Za-z\s]+?)(?:\n|$)")


def number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def _any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def amounts(text: Column) -> Column:
    """array<struct<amount, raw, place>> of every pattern's matches; crore or lakh within 20 characters on either side multiplies."""

    def of(pattern: str) -> Column:
        def amount(m: Column) -> Column:
            around = F.lower(F.concat(m["before"], m["raw"], m["after"]))
            times = F.lit(1.0)
            for word, by in reversed(TIMES):
                times = F.when(F.contains(around, F.lit(word)), F.lit(float(by))).otherwise(times)
            return F.struct((number(m["value"]) * times).alias("amount"), m["raw"].alias("raw"), m["place"].alias("place"))

        return F.transform(matches(text, _any_case(pattern), 1, 20, 20), amount)

    return F.filter(F.flatten(F.array(*(of(p) for p in AMOUNTS))), lambda a: a["amount"].isNotNull())


def areas(text: Column) -> Column:
    """array<struct<value, unit, raw, place>> of every pattern's matches."""
    of = lambda p, unit: F.transform(matches(text, _any_case(p), 1), lambda m: F.struct(number(m["value"]).alias("value"), F.lit(unit).alias("unit"), m["raw"].alias("raw"), m["place"].alias("place")))
    return F.filter(F.flatten(F.array(*(of(p, unit) for p, unit in AREAS))), lambda a: a["value"].isNotNull())


def dates(text: Column) -> Column:
    """Distinct dates, by pattern and then by place."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(_any_case(p)), F.lit(0)) for p in DATES))))


def references(text: Column) -> Column:
    """Distinct reference numbers, by pattern and then by place."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(_any_case(p)), F.lit(g)) for p, g in REFERENCES))))


def _said_before(text: Column, found: Column, raw, words: tuple[str, int]) -> Column:
    """The first of ``found`` whose first occurrence in ``text``, not at its very beginning, has one of the words before it."""
    pattern, far = words
    low = F.lower(text)

    def fits(x: Column) -> Column:
        at = F.call_function("locate", F.lower(raw(x)), low)
        start = F.greatest(at - far, F.lit(1))
        return (at > 1) & F.substring(low, start, at - start).rlike(pattern)

    return F.get(F.filter(found, fits), F.lit(0))


def metadata(text: Column) -> Column:
    """struct of approval_date, validity_date, total_cost, total_area_sqft, approval_number, authority."""
    by_self = lambda x: x
    area = _said_before(text, areas(text), lambda a: a["raw"], AREA)
    factor = F.lit(None).cast("double")
    for unit, feet in SQUARE_FEET.items():
        factor = F.when(area["unit"] == unit, F.lit(feet)).otherwise(factor)
    authority = F.coalesce(*(F.nullif(F.regexp_replace(F.regexp_extract(text, _any_case(p), 1), r"^\s+|\s+$", ""), F.lit("")) for p in AUTHORITIES))
    return F.struct(
        _said_before(text, dates(text), by_self, APPROVED).alias("approval_date"),
        _said_before(text, dates(text), by_self, VALID).alias("validity_date"),
        _said_before(text, amounts(text), lambda a: a["raw"], COST)["amount"].alias("total_cost"),
        (area["value"] * factor).alias("total_area_sqft"),
        _said_before(text, references(text), by_self, NUMBER).alias("approval_number"),
        authority.alias("authority"),
    )
