"""Text, date, money and area rules as SQL expressions of a dialect; ``column`` makes a Spark Column of one.

Patterns stay within what both engines' regular expressions share (no look-around).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastra.plans.dialect import SPARK

#: Spellings of statuses and their canonical names.
STATUS_NAMES = {"ongoing": "Ongoing", "under construction": "Ongoing", "completed": "Completed", "complete": "Completed", "new": "New Launch", "new launch": "New Launch", "lapsed": "Lapsed"}
#: Square metres of one unit of area.
SQUARE_METRES = {"sqm": 1.0, "sqft": 0.092903, "sqyd": 0.836127, "acre": 4046.8564224, "hectare": 10000.0, "bigha": 2529.28}
#: Rupees of one unit, in the order in which they are looked for.
RUPEES = {"cr": 10_000_000, "l": 100_000, "k": 1000}


def column(expression: str) -> Column:
    return F.expr(expression)


def collapse_space(x: str, d: object = SPARK) -> str:
    return f"nullif(trim({d.replace_all(x, '[ \\t\\r\\n]+', ' ')}), '')"


def only(x: str, keep: str, d: object = SPARK) -> str:
    return d.replace_all(x, f"[^{keep}]", "")


def slug(x: str, d: object = SPARK, sep: str = "-") -> str:
    return f"trim(BOTH '{sep}' FROM {d.replace_all(f'lower({x})', '[^a-z0-9]+', sep)})" if d.name == "spark" else f"trim({d.replace_all(f'lower({x})', '[^a-z0-9]+', sep)}, '{sep}')"


def registration_number(x: str, d: object = SPARK) -> str:
    """No spaces, single dashes, upper case, no dash, stop or slash at the ends."""
    body = f"upper({d.replace_all(d.replace_all(x, '[ ]+', ''), '-+', '-')})"
    return f"trim(BOTH '-./' FROM {body})" if d.name == "spark" else f"trim({body}, '-./')"


def label_key(x: str, d: object = SPARK) -> str:
    """Brackets and what they hold go, then all but letters and digits."""
    return only(f"lower({d.replace_all(x, '[(][^)]*[)]', '')})", "a-z0-9", d)


def pincode(x: str, d: object = SPARK) -> str:
    return d.extract(x, "(?:^|[^0-9])([0-9]{6})(?:$|[^0-9])", 1)


def canonical_status(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_NAMES.items())
    return f"CASE lower(trim({x})) {cases} ELSE {x} END"


def number_in(x: str, d: object = SPARK) -> str:
    return f"try_cast({d.extract(f"replace({x}, ',', '')", '([0-9]+[.]?[0-9]*)', 1)} AS DOUBLE)"


def area_sqm(x: str, d: object = SPARK) -> str:
    """Area text in square metres; dots and spaces in the unit don't matter; no unit means square metres."""
    unit = d.replace_all(f"lower({x})", "[^a-z]", "")
    factor = f"CASE WHEN {unit} LIKE '%bigha%' THEN {SQUARE_METRES['bigha']} WHEN {unit} LIKE '%sqft%' OR {unit} LIKE '%squarefeet%' THEN {SQUARE_METRES['sqft']} WHEN {unit} LIKE '%sqyd%' OR {unit} LIKE '%yard%' THEN {SQUARE_METRES['sqyd']} WHEN {unit} LIKE '%acre%' THEN {SQUARE_METRES['acre']} WHEN {unit} LIKE '%hectare%' OR {unit} = 'ha' THEN {SQUARE_METRES['hectare']} ELSE 1.0 END"
    return f"{number_in(x, d)} * CAST({factor} AS DOUBLE)"


def price_inr(x: str, d: object = SPARK) -> str:
    """Price text in rupees: signs and commas go; crore, then lakh, then thousand."""
    unit = d.replace_all(f"lower(replace({x}, 'Rs.', ''))", "[^a-z]", "")
    return f"{number_in(x, d)} * CASE WHEN {unit} LIKE 'cr%' THEN {RUPEES['cr']} WHEN {unit} LIKE 'l%' THEN {RUPEES['l']} WHEN {unit} LIKE 'k%' THEN {RUPEES['k']} ELSE 1 END"


def price_text(x: str, d: object = SPARK) -> str:
    """Crore from 10^7, lakh from 10^5, else rupees; whole hundredths."""
    part = lambda by: f"CAST(CAST({d.hundredths(f'{x} / {by}')} AS DECIMAL(18, 2)) AS VARCHAR(30))"
    return f"CASE WHEN {x} >= 10000000 THEN {part('10000000')} || ' Cr' WHEN {x} >= 100000 THEN {part('100000')} || ' L' ELSE {part('1')} END"


DAY_FORMATS = (("dd-MM-yyyy", "%d-%m-%Y"), ("dd/MM/yyyy", "%d/%m/%Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("dd MMM yyyy", "%d %b %Y"), ("dd MMMM yyyy", "%d %B %Y"))


def any_day(x: str, d: object = SPARK) -> str:
    """First format that reads the text; NULL if none does."""
    return f"coalesce({', '.join(d.parse_day(x, s, k) for s, k in DAY_FORMATS)})"


def keyword_class(x: str, rules: list[tuple[str, tuple[str, ...]]], other: str) -> str:
    """First rule, in order, one of whose words the text contains."""
    cases = " ".join("WHEN " + " OR ".join(f"lower({x}) LIKE '%{w}%'" for w in words) + f" THEN '{name}'" for name, words in rules)
    return f"CASE {cases} ELSE '{other}' END"


def value_type(x: str, d: object = SPARK) -> str:
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 'UNKNOWN' WHEN {d.matches(f'lower({x})', '^https?://')} THEN 'URL' WHEN {d.matches(f'trim({x})', '^-?[0-9][0-9,]*([.][0-9]+)?$')} THEN 'NUMBER' WHEN {any_day(f'trim({x})', d)} IS NOT NULL THEN 'DATE' ELSE 'TEXT' END"
