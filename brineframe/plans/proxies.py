"""Domain tables derived from the driver's Parquet tables, in Spark and in SQL.

The same definitions exist twice on purpose: the SQL text feeds the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.axes import DepthAxis, RegularAxis
from ..operators.columns import depth_arrays
from ..sources.tables import dealt, read_parquet

CUBE_BINS = 5
PROFILE_BINS = 7
CUBE_AXIS = DepthAxis.uniform(CUBE_BINS)
PROFILE_AXIS = DepthAxis.uniform(PROFILE_BINS)
CUBE_LON = RegularAxis(-180.0, 36.0, 10)
SHIP_LAT = RegularAxis(70.0, -5.0, 20)
SHIP_LON = RegularAxis(-180.0, 10.0, 36)
EVENT_BINS = ("click", "error", "purchase", "signup")
BANDS = [400.0 + 5 * i for i in range(CUBE_BINS)]


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_parquet(spark, f"{d}/events.parquet", columns=list(columns) or None)


def locate(rows: DataFrame) -> DataFrame:
    """Samples located in (date, lat, lon, depth bin)."""
    z = F.lit(len(EVENT_BINS))
    for i, kind in reversed(list(enumerate(EVENT_BINS))):
        z = F.when(F.col("event_type") == kind, F.lit(i)).otherwise(z)
    return rows.select(
        F.col("ts").cast("date").alias("date"),
        F.floor(F.col("user_id") / 10).cast("int").alias("lat_idx"),
        (F.col("user_id") % 10).cast("int").alias("lon_idx"),
        z.alias("z_idx"),
        F.col("value").alias("chla"),
    )


def cube_samples(spark: SparkSession, d: str) -> DataFrame:
    return locate(events(spark, d, "ts", "user_id", "event_type", "value"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    """Row per (date, lat, lon) with a depth-ordered array."""
    return depth_arrays(cube_samples(spark, d), ["date", "lat_idx", "lon_idx"], CUBE_BINS)


def cube_long(spark: SparkSession, d: str) -> DataFrame:
    """Row per (date, lat, lon, bin), missing bins not stored."""
    i = F.col("z_idx")
    return (
        cube_samples(spark, d).groupBy("date", "lat_idx", "lon_idx", "z_idx").agg(F.avg("chla").alias("chla"))
        .withColumns({
            "z_start": i * 10.0, "z_end": i * 10.0 + 10.0, "z": i * 10.0 + 5.0, "z_thickness": F.lit(10.0),
        })
    )


def lat_count(spark: SparkSession, d: str) -> Column:
    """Number of latitude rows, known from the data only."""
    return events(spark, d, "user_id").select((F.floor(F.max("user_id") / 10) + 1).cast("int")).scalar()


def cube_lat(spark: SparkSession, d: str) -> RegularAxis:
    return RegularAxis(70.0, -1.0, lat_count(spark, d))


def is_ocean() -> Column:
    return (F.col("lat_idx") * 10 + F.col("lon_idx")) % 7 != 0


def mask(spark: SparkSession, d: str) -> DataFrame:
    """Static ocean mask over the whole grid."""
    rows = cube_lat_rows(spark, d)
    cells = rows.select("lat_idx", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("lon_idx"))
    return cells.withColumn("ocean", is_ocean())


def cube_lat_rows(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "user_id").select(F.floor(F.col("user_id") / 10).cast("int").alias("lat_idx")).distinct()


def days(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "ts").select(F.col("ts").cast("date").alias("date")).distinct()


def ocean_pixels(spark: SparkSession, d: str) -> Column:
    return mask(spark, d).select(F.count(F.when(F.col("ocean"), 1))).scalar()


def ship_cube(spark: SparkSession, d: str) -> DataFrame:
    """A seven-year, one-layer cube (gaps in space and time)."""
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_discount"])
    return li.groupBy(
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_suppkey") % 20).cast("int").alias("lat_idx"),
        (F.col("l_partkey") % 36).cast("int").alias("lon_idx"),
    ).agg((F.avg("l_quantity") / 10.0).alias("chla"), F.avg("l_discount").alias("aux"))


def profile_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of all profiles (a few of each), dealt by profile."""
    return dealt(read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_quantity"]).select(
        F.col("l_orderkey").alias("profile_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("z_idx"),
        (F.col("l_quantity") / 8.0).alias("chla"),
    ), ["profile_id"])


def profiles_long(spark: SparkSession, d: str) -> DataFrame:
    long = profile_samples(spark, d).groupBy("profile_id", "z_idx").agg(F.avg("chla").alias("chla"))
    return long.withColumn("z", F.col("z_idx") * 10.0 + 5.0)


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Row per profile with a depth-ordered array."""
    return depth_arrays(profile_samples(spark, d), ["profile_id"], PROFILE_BINS)


PROFILE_LABELS = [f"CHLA_{10 * i}_{10 * i + 10}" for i in range(PROFILE_BINS)]


def profiles_wide(spark: SparkSession, d: str) -> DataFrame:
    """Row per profile with one nullable column per depth bin."""
    return profiles(spark, d).select(
        "profile_id", *[F.get("chla", F.lit(i)).alias(c) for i, c in enumerate(PROFILE_LABELS)]
    )


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """One granule per day: 24-hour window from seven past midnight, coverage of twelve hours."""
    start = (F.col("date").cast("timestamp_ntz") + F.expr("interval 7 minutes"))
    return days(spark, d).select(
        "date",
        F.concat(F.lit("PACE_"), F.date_format("date", "yyyyMMdd"), F.lit(".nc")).alias("granule"),
        start.alias("t_start"),
        (start + F.expr("interval 12 hours")).alias("t_end"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    """In-situ points, a little off the cell centres."""
    u = F.col("user_id")
    return events(spark, d, "event_id", "ts", "user_id").select(
        "event_id", F.col("ts").alias("time"),
        (F.lit(70.0) - F.floor(u / 10) + F.lit(0.3)).alias("lat"),
        (F.lit(-180.0) + F.lit(36.0) * (u % 10) + F.lit(5.0)).alias("lon"),
    )


def granule_pixels(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("PACE_"), F.date_format("date", "yyyyMMdd"), F.lit(".nc"))
    return cube(spark, d).select(name.alias("granule"), "lat_idx", "lon_idx", F.col("chla").alias("rrs"))


def truth_pred(spark: SparkSession, d: str) -> DataFrame:
    """Daily map of the depth mean, and a fixed prediction of it."""
    cells = cube_samples(spark, d).groupBy("date", "lat_idx", "lon_idx").agg(F.avg("chla").alias("truth"))
    pred = F.col("truth") * 0.8 + F.lit(0.05) * (F.col("lat_idx") + 1)
    return cells.withColumns({"pred": pred, "ocean": is_ocean()})


# --- the same tables for the oracle -------------------------------------------------

CUBE_LONG = """cube_long AS (
 SELECT CAST(ts AS DATE) AS date, CAST(floor(user_id / 10.0) AS INT) AS lat_idx, CAST(user_id % 10 AS INT) AS lon_idx,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS z_idx,
  avg(value) AS chla
 FROM events GROUP BY 1, 2, 3, 4)"""

CUBE_METRICS = CUBE_LONG + """, cube_metrics AS (
 SELECT date, lat_idx, lon_idx, sum(chla) * 10 AS chla_int, max(chla) AS chla_peak,
  min(CASE WHEN chla = top THEN 10.0 * z_idx + 5 END) AS chla_peak_depth,
  sum(chla * (10.0 * z_idx + 5)) / nullif(sum(chla), 0) AS chla_com
 FROM (SELECT *, max(chla) OVER (PARTITION BY date, lat_idx, lon_idx) AS top FROM cube_long) AS t
 GROUP BY 1, 2, 3 HAVING sum(chla) > 0)"""

MASK = """mask AS (
 SELECT r.lat_idx, CAST(c.lon_idx AS INT) AS lon_idx, (r.lat_idx * 10 + c.lon_idx) % 7 <> 0 AS ocean
 FROM (SELECT DISTINCT CAST(floor(user_id / 10.0) AS INT) AS lat_idx FROM events) AS r,
      (SELECT unnest(range(0, 10)) AS lon_idx) AS c)"""

DAYS = "days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)"

SHIP_CUBE = """ship_cube AS (
 SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 20 AS INT) AS lat_idx, CAST(l_partkey % 36 AS INT) AS lon_idx,
  avg(l_quantity) / 10.0 AS chla, avg(l_discount) AS aux
 FROM lineitem GROUP BY 1, 2, 3)"""

PROFILES = """profiles AS (
 SELECT l_orderkey AS profile_id, CAST(l_linenumber - 1 AS INT) AS z_idx, avg(l_quantity / 8.0) AS chla,
  CAST(l_linenumber - 1 AS DOUBLE) * 10 + 5 AS z
 FROM lineitem GROUP BY 1, 2, 4)"""

PROFILES_WIDE = PROFILES + """, wide AS (
 SELECT profile_id, """ + ", ".join(
    f"max(CASE WHEN z_idx = {i} THEN chla END) AS {c}" for i, c in enumerate(PROFILE_LABELS)
) + " FROM profiles GROUP BY 1)"

MANIFEST = DAYS + """, manifest AS (
 SELECT date, 'PACE_' || strftime(date, '%Y%m%d') || '.nc' AS granule,
  CAST(date AS TIMESTAMP) + INTERVAL 7 MINUTE AS t_start,
  CAST(date AS TIMESTAMP) + INTERVAL 7 MINUTE + INTERVAL 12 HOUR AS t_end
 FROM days)"""

POINTS = """points AS (
 SELECT event_id, ts AS time, 70.0 - floor(user_id / 10.0) + 0.3 AS lat, -180.0 + 36.0 * (user_id % 10) + 5.0 AS lon,
  CAST(floor(user_id / 10.0) AS INT) AS lat_idx, CAST(user_id % 10 AS INT) AS lon_idx
 FROM events)"""

TRUTH_PRED = """truth_pred AS (
 SELECT date, lat_idx, lon_idx, truth, truth * 0.8 + 0.05 * (lat_idx + 1) AS pred, (lat_idx * 10 + lon_idx) % 7 <> 0 AS ocean
 FROM (SELECT CAST(ts AS DATE) AS date, CAST(floor(user_id / 10.0) AS INT) AS lat_idx, CAST(user_id % 10 AS INT) AS lon_idx,
        avg(value) AS truth FROM events GROUP BY 1, 2, 3) AS t)"""


def hash_sql(key: str, seed: int | str = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
