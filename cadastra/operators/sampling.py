"""A sample of n rows spread over strata in proportion, and filled up with the latest rows.

A stratum's share is at least one row and at most its size. Strata are served by size until n is spent, which is a
running sum over one row a stratum; rows are ranked in parts of a stratum first, so that no task sorts a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.records import Rule
from cadastra.runtime import one_of

#: Parts that a stratum's rows are ranked in before they are ranked together.
PARTS = 32


def allocations(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """``stratum``, n_rows, share: rows to take of each stratum, larger strata first, equals by name; a null is a stratum."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_rows"))
    # one row a stratum
    total = F.sum("n_rows").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    asked = F.least(F.greatest(F.lit(1), ((F.col("n_rows") / total) * n).cast("long")), F.col("n_rows"))
    before = Window.orderBy(F.desc("n_rows"), F.asc_nulls_last(stratum)).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("asked").over(before), F.lit(0))
    return sizes.withColumn("asked", asked).select(stratum, "n_rows", F.greatest(F.least(F.col("asked"), n - spent), F.lit(0)).alias("share"))


def stratified_sample(df: DataFrame, stratum: str, recent: str, key: str, n: int) -> DataFrame:
    """``n`` rows of ``df`` (all, if fewer) and ``backfill``, which says whether a row came for its stratum or to fill up.

    Of a stratum the rows with the latest ``recent`` come first (nulls last), then the largest ``key``, which must be unique; the
    sample is filled up with the largest keys of what is left.
    """
    rank, part, size, share, fill = (one_of(df.columns, c) for c in ("rank", "part", "n_rows", "share", "backfill"))
    latest = [F.desc_nulls_last(recent), F.desc(key)]
    shares = allocations(df, stratum, n).select(F.col(stratum).alias(size), F.col("share").alias(share))
    first = df.withColumn(part, F.pmod(F.xxhash64(key), F.lit(PARTS)))
    first = first.withColumn(rank, F.row_number().over(Window.partitionBy(stratum, part).orderBy(*latest))).where(F.col(rank) <= n)
    ranked = first.withColumn(rank, F.row_number().over(Window.partitionBy(stratum).orderBy(*latest)))
    taken = ranked.join(shares, ranked[stratum].eqNullSafe(shares[size])).where(F.col(rank) <= F.col(share)).select(*df.columns, F.lit(False).alias(fill))
    missing = n - int(shares.agg(F.coalesce(F.sum(share), F.lit(0))).first()[0])
    if missing <= 0:
        return taken
    rest = df.join(taken.select(key), key, "left_anti").orderBy(F.desc(key)).limit(missing)
    return taken.unionByName(rest.select(*df.columns, F.lit(True).alias(fill)))


STRATA = "SELECT project_id, CASE WHEN project_id % 41 = 0 THEN NULL WHEN project_id % 3 = 0 THEN 'FRANCE' ELSE district END AS district, CASE WHEN project_id % 7 = 0 THEN NULL ELSE approved_date END AS approved_date FROM {projects}"


def _check(n: int) -> str:
    return f"""
, z AS (SELECT district, count(*) AS c FROM x GROUP BY district),
a AS (SELECT district, c, least(greatest(1, CAST(trunc(c / (SELECT count(*) FROM x) * {n}) AS BIGINT)), c) AS asked FROM z),
s AS (SELECT *, greatest(least(asked, {n} - coalesce(sum(asked) OVER (ORDER BY c DESC, district NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS share FROM a),
t AS (SELECT x.*, row_number() OVER (PARTITION BY x.district ORDER BY approved_date DESC NULLS LAST, project_id DESC) AS r FROM x),
k AS (SELECT project_id, t.district FROM t JOIN s ON s.district IS NOT DISTINCT FROM t.district WHERE r <= share),
f AS (SELECT project_id, district, row_number() OVER (ORDER BY project_id DESC) AS r FROM x WHERE project_id NOT IN (SELECT project_id FROM k))
SELECT project_id, district, false AS backfill FROM k UNION ALL SELECT project_id, district, true FROM f WHERE r <= {n} - (SELECT count(*) FROM k)"""


RULES = [
    Rule(f"win11_stratified_sample_{n}", ("WIN11", "SET04"), STRATA, lambda x, n=n: stratified_sample(x, "district", "approved_date", "project_id", n).select("project_id", "district", "backfill"), _check(n)) for n in (12, 300)
]
QUERIES = {r.name: r.query for r in RULES}
ORACLE_SQL = {r.name: r.oracle() for r in RULES}
