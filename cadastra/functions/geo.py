"""Distances as SQL expressions, and pairs within a radius: whole-stage code, no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.runtime import one_of

EARTH_KM = 6371
#: Kilometres in a degree of latitude.
KM_PER_DEGREE = 111


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in km."""
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"({EARTH_KM} * 2 * atan2(sqrt({a}), sqrt(greatest(0.0e0, 1 - {a}))))"


def _cells_around(band: Column, height: float, radius_km: float) -> Column:
    """Number of cells of a band of latitude, each wide enough for the radius at the band's highest latitude; one where the radius reaches round a pole."""
    low, high = band * height - 90, (band + 1) * height - 90
    reach = math.sin(radius_km / EARTH_KM) / F.cos(F.radians(F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))))
    wide = reach.between(0, 0.999)
    return F.when(wide, F.greatest(F.floor(360 / (F.degrees(F.asin(F.when(wide, reach))) * 1.01)), F.lit(1))).otherwise(1).cast("long")


#: Rows of either side that are compared at once; a cell with more pairs than its square goes to several tasks.
SIDE = 4096


def within_radius(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """All pairs of rows within the radius, and ``km``. Both sides have lat and lon in degrees; the right side's columns must not clash with the left's but for these, and its lat and lon are left out.

    An equi-join on cells: bands of latitude a radius high, and in each band cells a radius wide at its highest latitude, closed into a
    circle, so that neither latitude nor the 180th meridian loses a pair. A row of the right side stands in at most nine cells. Crowded cells, as at the
    poles, are dealt in blocks of ``SIDE`` rows to a side. The chord tells what is near; the distance decides where rounding could matter. Rows without a
    place have no pair.
    """
    height = math.degrees(radius_km / EARTH_KM) * 1.01
    taken = [*left.columns, *right.columns]
    band, cell, other, block, count = (one_of(taken, c) for c in ("band", "cell", "other", "block", "count"))
    at = lambda lat: F.floor((lat + 90) / height)
    place = lambda lon, n: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / (360.0 / n)), n - 1)
    hashed = lambda df: F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))

    def prepared(df: DataFrame, name: str) -> DataFrame:
        """With the place in radians, the cosine of the latitude, the point on the sphere, and a hash to deal the row by."""
        y, x = F.radians("lat"), F.radians("lon")
        names = {"y": y, "x": x, "cos": F.cos(y), "px": F.cos(y) * F.cos(x), "py": F.cos(y) * F.sin(x), "pz": F.sin(y), "hash": hashed(df)}
        return df.where("lat IS NOT NULL AND lon IS NOT NULL").withColumns({f"{name}_{k}": v for k, v in names.items()})

    l, r = prepared(left, f"{other}_l"), prepared(right, f"{other}_r")  # noqa: E741
    l = l.withColumn(band, at(F.col("lat")))  # noqa: E741
    l = l.withColumn(cell, place(F.col("lon"), _cells_around(F.col(band), height, radius_km)))  # noqa: E741
    r = r.withColumn(band, F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: at(F.col("lat")) + i)))
    n = _cells_around(F.col(band), height, radius_km)
    r = r.withColumn(cell, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.pmod(place(F.col("lon"), n) + i, n))))).drop("lat", "lon")
    counts = [df.groupBy(band, cell).agg(F.count(F.lit(1)).alias(f"{count}_{i}")) for i, df in enumerate((l, r))]
    # never more than the pairs over the square of SIDE
    crowded = F.broadcast(counts[0].join(counts[1], [band, cell]).where(F.col(f"{count}_0").cast("double") * F.col(f"{count}_1") > float(SIDE * SIDE)))
    dealt = lambda df, name: df.join(crowded, [band, cell], "left").withColumns({f"{block}_{i}": F.coalesce(F.ceil(F.col(f"{count}_{i}") / SIDE), F.lit(1)) for i in (0, 1)}).withColumns({f"{block}_{i}": F.pmod(F.col(f"{name}_hash"), F.col(f"{block}_{i}")) if i == (name == f"{other}_r") else F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{block}_{i}") - 1)) for i in (0, 1)}).drop(f"{count}_0", f"{count}_1")
    l, r = dealt(l, f"{other}_l"), dealt(r, f"{other}_r")  # noqa: E741
    # few bytes of rows are many pairs: neither the files' splits nor the sizes of shuffles say how many tasks they are worth
    spark = left.sparkSession
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    l = l.repartition(parts, band, cell, f"{block}_0", f"{block}_1")  # noqa: E741
    of = lambda side, k: F.col(f"{other}_{side}_{k}")
    chord = sum((of("l", k) - of("r", k)) * (of("l", k) - of("r", k)) for k in ("px", "py", "pz"))
    half = F.pow(F.sin((of("r", "y") - of("l", "y")) / 2), 2) + of("l", "cos") * of("r", "cos") * F.pow(F.sin((of("r", "x") - of("l", "x")) / 2), 2)
    km = 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
    reach = 2 * math.sin(min(radius_km / EARTH_KM / 2, math.pi / 2))
    sure, never = (reach - 1e-12) ** 2 if reach > 1e-12 else -1.0, (reach + 1e-12) ** 2
    pairs = l.join(r, [band, cell, f"{block}_0", f"{block}_1"]).where((chord <= sure) | ((chord <= never) & (km <= radius_km)))
    return pairs.select(*left.columns, *(c for c in right.columns if c not in ("lat", "lon")), km.alias("km"))
