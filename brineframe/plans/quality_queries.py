"""Missing-data reports, valid days, suspect profiles, selected days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours, quality as Q
from . import proxies as P
from .grid_queries import metrics
from .registry import query

COUNTS = P.CUBE_METRICS + ", " + P.MASK + ", " + P.DAYS + """, ocean AS (SELECT count(*) AS n FROM mask WHERE ocean),
counts AS (SELECT days.date, (SELECT n FROM ocean) AS ocean,
 (SELECT n FROM ocean) - count(CASE WHEN (c.lat_idx * 10 + c.lon_idx) % 7 <> 0 THEN c.chla_peak END) AS missing_chla_peak,
 (SELECT n FROM ocean) - count(CASE WHEN (c.lat_idx * 10 + c.lon_idx) % 7 <> 0 AND c.chla_peak_depth < 40 THEN 1 END) AS missing_shallow
 FROM days LEFT JOIN cube_metrics AS c ON c.date = days.date GROUP BY 1)"""


def counts(spark, d):
    facts = metrics(spark, d).withColumn("shallow", F.when(F.col("chla_peak_depth") < 40, F.col("chla_peak_depth")))
    return Q.missing_counts(facts, ["chla_peak", "shallow"], P.is_ocean(), P.ocean_pixels(spark, d), P.days(spark, d))


@query("ocean_missing_counts", "A12 P25", f"WITH {COUNTS} SELECT * FROM counts", texts="date")
def ocean_missing_counts(spark, d):
    return counts(spark, d)


@query("pct_missing_by_day", "A13", f"""
WITH {COUNTS} SELECT date, missing_chla_peak * 100.0 / nullif(ocean, 0) AS pct_missing_chla_peak FROM counts
""", doubles="pct_missing_chla_peak", texts="date")
def pct_missing_by_day(spark, d):
    return Q.pct_missing(counts(spark, d), "chla_peak")


@query("valid_days_by_month", "A14 U5", f"""
WITH {COUNTS}, ok AS (SELECT month(date) AS month, count(*) AS n FROM counts
 WHERE year(date) = 2024 AND missing_chla_peak <= 0.12 * ocean AND missing_shallow <= 0.12 * 2.5 * ocean GROUP BY 1)
SELECT m.month, coalesce(ok.n, 0) AS valid_days FROM (SELECT CAST(unnest(range(1, 13)) AS INT) AS month) AS m LEFT JOIN ok ON ok.month = m.month
""")
def valid_days_by_month(spark, d):
    both = counts(spark, d).withColumn("missing_shallow", F.col("missing_shallow") / 2.5)
    return Q.valid_days_by_month(both, ["chla_peak", "shallow"], 2024, 0.12)


@query("usable_training_days", "A15", f"""
WITH {COUNTS} SELECT date FROM counts WHERE missing_chla_peak < 0.12 * ocean AND missing_shallow < 0.3 * ocean
""", texts="date")
def usable_training_days(spark, d):
    return Q.usable_days(counts(spark, d), "shallow", ["chla_peak"], 0.3, 0.12)


@query("days_kept_by_month", "A16", f"""
WITH {P.SHIP_CUBE} SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, count(DISTINCT date) AS days FROM ship_cube GROUP BY 1, 2
""")
def days_kept_by_month(spark, d):
    return Q.days_per_month(P.ship_cube(spark, d).select("date").distinct())


SUSPECT = """SELECT profile_id, count(chla) AS n_deep, min(chla) AS deep_min, max(chla) AS deep_max FROM profiles WHERE z BETWEEN 25 AND 65 GROUP BY 1
 HAVING count(chla) >= 3 AND min(chla) > 1 AND max(chla) - min(chla) < 2"""
RULE = {"deep": (25.0, 65.0), "min_valid": 3, "min_value": 1.0, "max_spread": 2.0}


@query("suspect_profiles", "A19", f"WITH {P.PROFILES} {SUSPECT}", doubles="deep_min deep_max")
def suspect_profiles(spark, d):
    return Q.suspect_profiles(P.profiles_long(spark, d), **RULE)


@query("profiles_without_suspects", "A19 P16 J10", f"""
WITH {P.PROFILES}, bad AS ({SUSPECT})
SELECT z_idx, count(*) AS n, avg(chla) AS chla FROM profiles WHERE profile_id NOT IN (SELECT profile_id FROM bad) GROUP BY 1
""", doubles="chla")
def profiles_without_suspects(spark, d):
    kept = Q.drop_suspect_profiles(P.profiles_long(spark, d), **RULE)
    return kept.groupBy("z_idx").agg(F.count("*").alias("n"), F.avg("chla").alias("chla"))


_SHIP_DAYS = "d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"


def _ship_days(spark, d):
    return P.ship_cube(spark, d).select("date").distinct()


@query("first_day_of_each_month", "A25", f"""
WITH {_SHIP_DAYS} SELECT min(date) AS date FROM d GROUP BY year(date), month(date)
""", texts="date")
def first_day_of_each_month(spark, d):
    return Q.selected_days(_ship_days(spark, d), "first")


@query("mid_day_of_each_month", "A25", f"""
WITH {_SHIP_DAYS} SELECT coalesce(min(CASE WHEN day(date) >= 29 THEN date END), max(date)) AS date FROM d GROUP BY year(date), month(date)
""", texts="date")
def mid_day_of_each_month(spark, d):
    return Q.selected_days(_ship_days(spark, d), "from", 29)


@query("fixed_days_of_each_month", "A25", f"""
WITH {_SHIP_DAYS} SELECT date FROM d WHERE day(date) IN (1, 7, 14, 28)
""", texts="date")
def fixed_days_of_each_month(spark, d):
    return Q.selected_days(_ship_days(spark, d), "fixed")


@query("distance_to_coast", "W4", f"""
WITH {P.MASK}, g AS (SELECT max(lat_idx) AS last FROM mask),
k AS (SELECT 111.0 AS dy, 36 * 111.0 * greatest(cos(radians(70.0 - last / 2.0)), 1e-6) AS dx FROM g)
SELECT a.lat_idx, a.lon_idx, sqrt(min(power((a.lat_idx - b.lat_idx) * dy, 2) + power((a.lon_idx - b.lon_idx) * dx, 2))) AS dist2coast_km
FROM mask AS a, mask AS b, k WHERE NOT b.ocean GROUP BY 1, 2
""", doubles="dist2coast_km", digits=4)
def distance_to_coast(spark, d):
    return neighbours.distance_to_coast(P.mask(spark, d), P.cube_lat(spark, d), P.CUBE_LON)
