"""The few spots where Spark SQL and DuckDB differ, so that an operator is stated once.

An operator's statement is a function of a dialect. Spark's is what runs; DuckDB's is the independent check.
"""

from __future__ import annotations


class SparkDialect:
    name = "spark"

    @staticmethod
    def days(later: str, earlier: str) -> str:
        return f"CAST(datediff({later}, {earlier}) AS BIGINT)"

    @staticmethod
    def minus_days(day: str, n: int | str) -> str:
        return f"date_sub({day}, {n})"

    @staticmethod
    def plus_months(day: str, n: int) -> str:
        return f"add_months({day}, {n})"

    @staticmethod
    def trunc(unit: str, day: str) -> str:
        return f"CAST(date_trunc('{unit}', {day}) AS DATE)"

    @staticmethod
    def listagg(x: str, order: str, sep: str = ",") -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    @staticmethod
    def replace_all(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    @staticmethod
    def extract(x: str, pattern: str, group: int = 1) -> str:
        return f"nullif(regexp_extract({x}, r'{pattern}', {group}), '')"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    @staticmethod
    def even(x: str, digits: int) -> str:
        return f"CAST(bround(CAST({x} AS DECIMAL(30, 10)), {digits}) AS DOUBLE)"

    @staticmethod
    def hundredths(x: str) -> str:
        # round(x, 2) rounds a double's shortest decimal, the checking engine what a hundred times the double is
        return f"(round({x} * 100e0) / 100e0)"

    @staticmethod
    def quantile(x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    @staticmethod
    def json_int(x: str, key: str) -> str:
        return f"try_cast(get_json_object({x}, '$.{key}') AS BIGINT)"

    @staticmethod
    def find_all(x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', {group})"

    @staticmethod
    def distinct_sorted(array: str) -> str:
        return f"array_join(array_sort(array_distinct({array})), '|')"

    @staticmethod
    def day_text(day: str, spark: str, duck: str) -> str:
        return f"date_format({day}, '{spark}')"

    @staticmethod
    def week(day: str) -> str:
        return f"CAST(weekofyear({day}) AS BIGINT)"

    @staticmethod
    def parse_day(x: str, spark: str, duck: str) -> str:
        return f"try_to_date({x}, '{spark}')"

    @staticmethod
    def dot(a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"

    @staticmethod
    def position(needle: str, x: str) -> str:
        return f"locate({needle}, {x})"

    @staticmethod
    def hour(ts: str) -> str:
        return f"date_format(date_trunc('hour', {ts}), 'yyyy-MM-dd HH')"


class DuckDialect:
    name = "duck"

    @staticmethod
    def days(later: str, earlier: str) -> str:
        return f"CAST(date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE)) AS BIGINT)"

    @staticmethod
    def minus_days(day: str, n: int | str) -> str:
        return f"CAST({day} - to_days(CAST({n} AS INTEGER)) AS DATE)"

    @staticmethod
    def plus_months(day: str, n: int) -> str:
        return f"CAST({day} + INTERVAL {n} MONTH AS DATE)"

    @staticmethod
    def trunc(unit: str, day: str) -> str:
        return f"CAST(date_trunc('{unit}', {day}) AS DATE)"

    @staticmethod
    def listagg(x: str, order: str, sep: str = ",") -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    @staticmethod
    def replace_all(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    @staticmethod
    def extract(x: str, pattern: str, group: int = 1) -> str:
        return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    @staticmethod
    def even(x: str, digits: int) -> str:
        return f"CAST(round_even(CAST({x} AS DECIMAL(30, 10)), {digits}) AS DOUBLE)"

    @staticmethod
    def hundredths(x: str) -> str:
        return f"round({x}, 2)"

    @staticmethod
    def quantile(x: str, q: float) -> str:
        return f"quantile_cont(CAST({x} AS DOUBLE), {q})"

    @staticmethod
    def json_int(x: str, key: str) -> str:
        return f"try_cast(json_extract_string({x}, '$.{key}') AS BIGINT)"

    @staticmethod
    def find_all(x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    @staticmethod
    def distinct_sorted(array: str) -> str:
        return f"array_to_string(list_sort(list_distinct({array})), '|')"

    @staticmethod
    def day_text(day: str, spark: str, duck: str) -> str:
        return f"strftime({day}, '{duck}')"

    @staticmethod
    def week(day: str) -> str:
        return f"CAST(weekofyear({day}) AS BIGINT)"

    @staticmethod
    def parse_day(x: str, spark: str, duck: str) -> str:
        return f"CAST(try_strptime({x}, '{duck}') AS DATE)"

    @staticmethod
    def dot(a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    @staticmethod
    def position(needle: str, x: str) -> str:
        return f"instr({x}, {needle})"

    @staticmethod
    def hour(ts: str) -> str:
        return f"strftime(date_trunc('hour', {ts}), '%Y-%m-%d %H')"


SPARK, DUCK = SparkDialect(), DuckDialect()
