"""Text rules as columns: canonical names, keyword classes, money, cut texts, scans, entities, key-value lines, identifiers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical spellings; what is not listed becomes title case (first three) or stays (last two).
DISTRICTS = {"raipur": "Raipur", "bilaspur": "Bilaspur", "durg": "Durg", "korba": "Korba", "dhamtari": "Dhamtari", "rajnandgaon": "Rajnandgaon"}
LABELS = {"ongoing": "Ongoing", "on-going": "Ongoing", "on going": "Ongoing", "registered": "Registered", "registration": "Registered", "completed": "Completed"}
TYPES = {"residential": "Residential", "commercial": "Commercial", "mixed use": "Mixed Use", "mixed-use": "Mixed Use", "residential and commercial": "Residential and Commercial", "residential & commercial": "Residential and Commercial"}
PLAIN_TYPES = {
    "residential": "residential", "residential project": "residential", "group housing": "residential", "apartment": "residential", "flats": "residential", "commercial": "commercial", "commercial project": "commercial", "shop": "commercial",
    "office": "commercial", "mixed": "mixed", "mixed use": "mixed", "plotted": "plotted", "plotted development": "plotted", "villa": "villa", "villas": "villa", "township": "township", "integrated township": "township",
}
# Keywords of classes, the first class with a keyword in the text counts.
ARTIFACTS = (
    ("legal", ("registration", "encumbrance", "title", "revenue", "deed", "agreement", "allotment", "form")),
    ("approvals", ("noc", "approval", "permission", "certificate", "commencement", "occupancy", "completion", "fire", "environment", "airport", "sanction")),
    ("technical", ("building", "layout", "structure", "floor", "plan", "drawing", "design", "specification")),
    ("media", ("photo", "image", "brochure", "video", "render", "amenity", "elevation", "view")),
)
MEDIA = (("floor_plan", ("floor", "plan", "layout")), ("video", ("video", "tour", "youtube", "vimeo")), ("brochure", ("brochure", "pdf", "catalog")), ("gallery", ("photo", "image", "render", "elevation", "view", "gallery")))
DOCUMENTS = (
    ("registration_certificate", ("registration",)), ("building_plan", ("building",)), ("layout_plan", ("layout",)), ("fire_noc", ("fire",)), ("environment_noc", ("environment",)), ("airport_noc", ("airport",)),
    ("encumbrance_certificate", ("encumbrance",)), ("commencement_certificate", ("commencement",)), ("occupancy_certificate", ("occupancy",)), ("completion_certificate", ("completion",)), ("revenue_document", ("revenue",)),
    ("land_title_deed", ("title",)), ("project_brochure", ("brochure",)), ("site_photo", ("photo",)),
)
# Patterns of entities in scans.
RERA, AMOUNT = r"(?i)P[CG]{1,2}[GRERA]{4,5}\d{6,12}", r"(?i)(?:Rs\.?|₹|INR)\s*[\d,]+(?:\.\d{2})?"
DATES = (r"\d{2}[-/]\d{2}[-/]\d{4}", r"\d{4}[-/]\d{2}[-/]\d{2}", r"(?i)\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}")
PHONE, EMAIL = r"(?:\+91[-\s]?)?[6-9]\d{9}", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PAIR = r"(?m)^([A-Za-z][A-Za-z\s]{2,30})\s*[:|-]\s*(.+)$"
# Identifiers, and kinds of account by a word in their name.
REGISTRATION, IFSC = r"(?i)P?CG?RERA\d{6,12}", r"[A-Z]{4}0[A-Z0-9]{6}"
ACCOUNTS = (("Current Account", ("current",)), ("Savings Account", ("saving",)), ("Escrow Account", ("escrow",)), ("Fixed Deposit", ("fixed", "fd")))
# What looks like a date, and the forms that are tried in order.
DATE_LIKE = r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})|(\d{4}-\d{2}-\d{2})"
DATE_FORMS = (
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"), (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"), (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"), (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2} [A-Za-z]+ \d{4}", "d MMMM yyyy"), (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
)


def _map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def title(text: Column) -> Column:
    """Every run of letters with its first letter large and the others small."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")


def canonical(text: Column, values: dict[str, str]) -> Column:
    """A listed spelling, else title case; white space is single; nothing is the empty text."""
    clean = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.coalesce(_map(values, F.lower(clean)), title(clean))


def listed(text: Column, values: dict[str, str]) -> Column:
    """A listed spelling, else the text as it stands; nothing is null."""
    return F.when(text != "", F.coalesce(_map(values, F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))), text))


def keyword_class(text: Column, classes: tuple, other: str) -> Column:
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike("|".join(words)), name) for name, words in classes), F.lit(other))


def media_type(kind: Column, category: Column, form: Column) -> Column:
    """Class of an artifact by its type, its category and its file format. The words."""
    has = lambda c, *words: F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(words))
    out = F.when((F.coalesce(kind, F.lit("")) == "") & (F.coalesce(category, F.lit("")) == ""), "gallery")
    for name, test in (
        ("floorplan", has(kind, "floor", "layout")), ("masterplan", has(kind, "master", "site")), ("brochure", has(kind, "brochure") | has(form, "pdf")), ("video", has(kind, "video") | F.lower(F.coalesce(form, F.lit(""))).isin("mp4", "webm", "avi")),
        ("virtual_tour", has(kind, "tour", "360")), ("elevation", has(kind, "elevation", "facade")), ("amenity", has(kind, "amenity") | has(category, "amenities")),
    ):
        out = out.when(test, name)
    return out.otherwise("gallery")


def lakhs(price: Column) -> Column:
    """A price in lakh, or in crore from a hundred lakh on."""
    return F.when(price / 100_000 >= 100, F.format_string("%.2f Cr", (price / 10_000_000).cast("double"))).when(price.isNotNull(), F.format_string("%.2f L", (price / 100_000).cast("double")))


def price_range(least: Column, most: Column) -> Column:
    """A range of prices as text; 0 is no price."""
    least, most = (F.nullif(c.cast("double"), F.lit(0.0)) for c in (least, most))
    one = lambda x: F.when(x >= 1e7, F.format_string("₹%.2fCr", x / 1e7)).when(x >= 1e5, F.format_string("₹%.2fL", x / 1e5)).otherwise(F.concat(F.lit("₹"), F.format_number(x, 0)))
    return F.when(least.isNotNull() & most.isNotNull(), F.concat(one(least), F.lit(" - "), one(most))).when(least.isNotNull(), F.concat(F.lit("From "), one(least))).when(most.isNotNull(), F.concat(F.lit("Up to "), one(most)))


def truncated(text: Column, most: int) -> Column:
    """``most`` characters of a longer text, cut after the last full stop or line end if that keeps more than 70 %, and a note."""
    head = F.left(text, F.lit(most))
    kept = F.regexp_extract(head, r"^([\s\S]*[.\n])", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(F.length(kept) - 1 > most * 0.7, kept).otherwise(head), F.lit("\n\n[Text truncated...]")))


def without_artifacts(text: Column) -> Column:
    """Signs that stand alone, repeated punctuation and lines of noise removed; empty lines stay."""
    text = F.regexp_replace(text, r"(?U)(?<!\S)[^\w\s,.\-/:;()₹$%@#&*]+(?!\S)", "")
    text = F.regexp_replace(text, r"([.,;:!?])\1+", "$1")
    lines = F.split(text, "\n", -1)
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    kept = F.filter(lines, lambda x: (F.length(bare(x)) > 2) | bare(x).rlike(r"^[\p{L}\p{N}]+$") | (bare(x) == ""))
    return F.array_join(F.transform(kept, lambda x: F.when(bare(x) == "", "").otherwise(x)), "\n")


def entities(text: Column) -> Column:
    """struct of rera_numbers, dates, amounts, phones, emails: the distinct ones, by pattern and then by place."""
    all_ = lambda *patterns: F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns))))
    return F.struct(all_(RERA).alias("rera_numbers"), all_(*DATES).alias("dates"), all_(AMOUNT).alias("amounts"), all_(PHONE).alias("phones"), all_(EMAIL).alias("emails"))


def key_values(text: Column) -> Column:
    """Map of the ``Key: value`` lines; keys in snake case, the last of a key stays, values of one character are left out."""
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    keys, values = (F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(g)), bare) for g in (1, 2))
    pairs = F.filter(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(F.regexp_replace(F.lower(p["k"]), r"\s+", "_").alias("k"), p["v"].alias("v"))), lambda p: F.length(p["v"]) > 1)
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def _bare(text: Column) -> Column:
    return F.upper(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("-"), F.lit("")))


def registration_number(text: Column) -> Column:
    """Without spaces and dashes, in capitals; the number in it, if it is not one as it stands."""
    bare = _bare(text)
    found = F.nullif(F.regexp_extract(bare, REGISTRATION, 0), F.lit(""))
    return F.when(text == "", text).otherwise(F.when(bare.rlike(f"^(?:{REGISTRATION})$"), bare).otherwise(F.coalesce(found, bare)))


def ifsc(text: Column) -> Column:
    bare = _bare(text)
    return F.when(text == "", text).otherwise(F.coalesce(F.nullif(F.regexp_extract(bare, IFSC, 0), F.lit("")), bare))


def account_number(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))


def account_type(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike("|".join(words)), name) for name, words in ACCOUNTS), text)


def any_date(text: Column) -> Column:
    """The first date in a text by any of eight forms, else null; years have four digits."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    value = F.coalesce(F.nullif(F.regexp_extract(bare, DATE_LIKE, 0), F.lit("")), bare)
    value = F.when(value.rlike("[A-Za-z]"), F.initcap(value)).otherwise(value)
    return F.coalesce(*(F.when(value.rlike(f"^{shape}$"), F.try_to_timestamp(value, F.lit(form)).cast("date")) for shape, form in DATE_FORMS))


def registration_errors(number: Column, dates: list[Column], project: Column, promoter: Column) -> Column:
    """What a registration certificate's fields lack."""
    none = lambda c: c.isNull() | (c == "")
    no_date = none(F.coalesce(*(F.nullif(d, F.lit("")) for d in dates)))
    return F.array_compact(F.array(F.when(none(number), "Missing registration number"), F.when(no_date, "No dates found"), F.when(none(project) & none(promoter), "Missing both project and promoter name")))


def bank_errors(account: Column, bank: Column, code: Column) -> Column:
    none = lambda c: c.isNull() | (c == "")
    return F.array_compact(F.array(F.when(none(account), "Missing account number"), F.when(none(bank), "Missing bank name"), F.when(none(code), "Missing IFSC code")))


def reasons(json: Column) -> Column:
    """Reasons in JSON: a list's items, an object's keys, or the value itself."""
    bare = F.btrim(json)
    one = F.array(F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", "string"), json))
    found = F.when(bare.startswith("["), F.from_json(json, "array<string>")).when(bare.startswith("{"), F.map_keys(F.from_json(json, "map<string,string>"))).when(~F.coalesce(bare, F.lit("")).isin("", "null", '""'), one)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda r: r.isNotNull())
