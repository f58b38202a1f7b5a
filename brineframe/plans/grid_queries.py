"""Column metrics and means over the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns, gridagg, selection
from ..sources.tables import read_parquet
from . import proxies as P
from .registry import query

METRICS = ["chla_int_0_200", "chla_peak", "chla_peak_depth", "chla_depth_center_of_mass"]
METRIC_SQL = (
    "chla_int AS chla_int_0_200, chla_peak, chla_peak_depth, chla_com AS chla_depth_center_of_mass"
)


def metrics(spark, d):
    return columns.column_metrics(P.cube(spark, d), P.CUBE_AXIS)


@query("column_metrics", "A1 A2 A3 A4 A5 A6 S4", f"""
WITH {P.CUBE_METRICS}
SELECT date, lat_idx, lon_idx, {METRIC_SQL} FROM cube_metrics
""", doubles=" ".join(METRICS), texts="date")
def column_metrics(spark, d):
    return metrics(spark, d).select("date", "lat_idx", "lon_idx", *METRICS)


@query("column_metrics_long_form", "A1 A2 A3 A4 A5", f"""
WITH {P.CUBE_METRICS}
SELECT date, lat_idx, lon_idx, {METRIC_SQL} FROM cube_metrics
""", doubles=" ".join(METRICS), texts="date")
def column_metrics_long_form(spark, d):
    return columns.column_metrics_long(P.cube_long(spark, d), ["date", "lat_idx", "lon_idx"])


@query("peak_depth_box_monthly_mean", "A6 P9 A7 A8 A9 S2", f"""
WITH {P.CUBE_METRICS}, daily AS (
 SELECT date, avg(chla_peak_depth) AS chla_peak_depth FROM cube_metrics
 WHERE 70 - lat_idx BETWEEN 60 AND 70 AND -180 + 36 * lon_idx BETWEEN -110 AND 72 GROUP BY 1)
SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(chla_peak_depth) AS chla_peak_depth FROM daily GROUP BY 1
""", doubles="chla_peak_depth", texts="month")
def peak_depth_box_monthly_mean(spark, d):
    roi = selection.box(metrics(spark, d), P.cube_lat(spark, d), P.CUBE_LON, (60, 70), (-110, 72))
    return gridagg.mean_of_daily_means(roi, ["chla_peak_depth"])


@query("box_daily_mean", "A7 P9", f"""
WITH {P.CUBE_METRICS}
SELECT date, avg(chla_peak) AS chla_peak, avg(chla_int) AS chla_int_0_200 FROM cube_metrics
WHERE 70 - lat_idx BETWEEN 60 AND 70 AND -180 + 36 * lon_idx BETWEEN -110 AND 72 GROUP BY 1
""", doubles="chla_peak chla_int_0_200", texts="date")
def box_daily_mean(spark, d):
    roi = selection.box(metrics(spark, d), P.cube_lat(spark, d), P.CUBE_LON, (60, 70), (-110, 72))
    return gridagg.daily_mean(roi, ["chla_peak", "chla_int_0_200"])


@query("monthly_mean_map", "A8", f"""
WITH {P.SHIP_CUBE}, span AS (
 SELECT date_trunc('month', min(date)) AS lo, date_trunc('month', max(date)) AS hi FROM ship_cube),
months AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM span),
cells AS (SELECT DISTINCT lat_idx, lon_idx FROM ship_cube),
agg AS (SELECT lat_idx, lon_idx, CAST(date_trunc('month', date) AS DATE) AS month, avg(chla) AS chla FROM ship_cube GROUP BY 1, 2, 3)
SELECT c.lat_idx, c.lon_idx, m.month, a.chla FROM cells AS c CROSS JOIN months AS m
LEFT JOIN agg AS a ON a.lat_idx = c.lat_idx AND a.lon_idx = c.lon_idx AND a.month = m.month
""", doubles="chla", texts="month")
def monthly_mean_map(spark, d):
    # the ends of the time axis come from one column, so that the cube is evaluated once
    ends = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_shipdate"]).agg(*[f(F.col("l_shipdate").cast("date")) for f in (F.min, F.max)])
    return gridagg.monthly_mean(P.ship_cube(spark, d), ["chla"], ["lat_idx", "lon_idx"], span=tuple(ends.first()))


@query("monthly_mean_of_daily_means", "A9", f"""
WITH {P.SHIP_CUBE}, daily AS (SELECT date, avg(chla) AS chla, avg(aux) AS aux FROM ship_cube GROUP BY 1)
SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(chla) AS chla, avg(aux) AS aux FROM daily GROUP BY 1
""", doubles="chla aux", texts="month")
def monthly_mean_of_daily_means(spark, d):
    return gridagg.mean_of_daily_means(P.ship_cube(spark, d), ["chla", "aux"])


@query("zonal_band_profile", "A10", f"""
WITH {P.SHIP_CUBE}, monthly AS (
 SELECT CAST(date_trunc('month', date) AS DATE) AS month, lat_idx, lon_idx, avg(chla) AS chla FROM ship_cube
 WHERE -180 + 10 * lon_idx BETWEEN -60 AND 40 GROUP BY 1, 2, 3)
SELECT month, lat_idx, avg(chla) AS chla FROM monthly GROUP BY 1, 2
""", doubles="chla", texts="month")
def zonal_band_profile(spark, d):
    return gridagg.zonal_profile(P.ship_cube(spark, d), "chla", P.SHIP_LON, (-60, 40))


@query("block_mean_4x4", "A11", f"""
WITH {P.CUBE_METRICS}, n AS (SELECT max(floor(user_id / 10.0)) + 1 AS n_lat FROM events)
SELECT date, CAST(floor(lat_idx / 4.0) AS INT) AS lat_block, CAST(floor(lon_idx / 4.0) AS INT) AS lon_block,
 avg(chla_peak) AS chla_peak,
 70 - (floor(lat_idx / 4.0) * 4 + 1.5) AS lat, -180 + 36 * (floor(lon_idx / 4.0) * 4 + 1.5) AS lon
FROM cube_metrics, n WHERE lat_idx < floor(n_lat / 4) * 4 AND lon_idx < 8 GROUP BY 1, 2, 3, 5, 6
""", doubles="chla_peak lat lon", texts="date")
def block_mean_4x4(spark, d):
    return gridagg.block_mean(metrics(spark, d), ["chla_peak"], 4, P.cube_lat(spark, d), P.CUBE_LON, ["date"])


@query("map_percentile_limits", "A20 A21", f"""
WITH {P.TRUTH_PRED}
SELECT quantile_cont(truth, 0.02) AS low, quantile_cont(truth, 0.98) AS high FROM truth_pred
""", doubles="low high")
def map_percentile_limits(spark, d):
    return gridagg.map_limits(P.truth_pred(spark, d), "truth")


@query("joint_map_limits", "A20", f"""
WITH {P.TRUTH_PRED}, both_maps AS (SELECT truth AS v FROM truth_pred UNION ALL SELECT pred FROM truth_pred)
SELECT (SELECT quantile_cont(v, 0.02) FROM both_maps) AS low, (SELECT quantile_cont(v, 0.98) FROM both_maps) AS high,
 (SELECT quantile_cont(abs(truth - pred), 0.98) FROM truth_pred) AS diff_high
""", doubles="low high diff_high")
def joint_map_limits(spark, d):
    return gridagg.joint_map_limits(P.truth_pred(spark, d), "truth", "pred")


@query("depth_percentiles", "A20", f"""
WITH {P.PROFILES}
SELECT z_idx, quantile_cont(chla, 0.1) AS p10, quantile_cont(chla, 0.5) AS p50, quantile_cont(chla, 0.9) AS p90
FROM profiles GROUP BY 1
""", doubles="p10 p50 p90")
def depth_percentiles(spark, d):
    return gridagg.percentile_columns(
        P.profiles_long(spark, d), "chla", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["z_idx"],
        max_groups=P.PROFILE_BINS,
    )


@query("residual_range", "A21 P29", f"""
WITH {P.TRUTH_PRED}
SELECT date, min(truth - pred) AS lo, max(truth - pred) AS hi, max(abs(truth - pred)) AS abs_max FROM truth_pred GROUP BY 1
""", doubles="lo hi abs_max", texts="date")
def residual_range(spark, d):
    rows = P.truth_pred(spark, d).withColumn("residual", F.col("truth") - F.col("pred"))
    return gridagg.value_range(rows, "residual", ["date"])


PEAK_EDGES = [0, 20, 40, 50]
PEAK_LABELS = ["0-20", "20-40", "40-50"]


@query("peak_depth_bins", "A22", f"""
WITH {P.CUBE_METRICS}
SELECT CASE WHEN chla_peak_depth >= 0 AND chla_peak_depth < 20 THEN '0-20' WHEN chla_peak_depth >= 20 AND chla_peak_depth < 40 THEN '20-40'
 WHEN chla_peak_depth >= 40 AND chla_peak_depth < 50 THEN '40-50' END AS depth_bin, count(*) AS n, avg(chla_peak) AS chla_peak
FROM cube_metrics GROUP BY 1
""", doubles="chla_peak")
def peak_depth_bins(spark, d):
    label = gridagg.cut("chla_peak_depth", PEAK_EDGES, PEAK_LABELS).alias("depth_bin")
    return metrics(spark, d).groupBy(label).agg(F.count("*").alias("n"), F.avg("chla_peak").alias("chla_peak"))


@query("peak_value_box_summary", "A23", f"""
WITH {P.CUBE_METRICS}, q AS (
 SELECT chla_peak_depth, quantile_cont(chla_peak, 0.25) AS q1, quantile_cont(chla_peak, 0.5) AS median, quantile_cont(chla_peak, 0.75) AS q3
 FROM cube_metrics GROUP BY 1)
SELECT chla_peak_depth, q1, median, q3, count(*) AS n,
 min(CASE WHEN chla_peak BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN chla_peak END) AS whisker_low,
 max(CASE WHEN chla_peak BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN chla_peak END) AS whisker_high,
 CAST(sum(CASE WHEN chla_peak BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM cube_metrics JOIN q USING (chla_peak_depth) GROUP BY 1, 2, 3, 4
""", doubles="chla_peak_depth q1 median q3 whisker_low whisker_high")
def peak_value_box_summary(spark, d):
    return gridagg.box_summary(metrics(spark, d), "chla_peak", ["chla_peak_depth"], max_groups=P.CUBE_BINS)


BIN_LABELS = [f"{10 * i}-{10 * i + 10}" for i in range(7)]
_PEAKS_SQL = P.PROFILES + """, scored AS (SELECT *, chla * 0.75 + 0.0625 * (z_idx + 1) * (profile_id % 5) AS pred FROM profiles),
peaks AS (SELECT profile_id, min(CASE WHEN chla = top THEN z END) AS obs_z, min(CASE WHEN pred = ptop THEN z END) AS pred_z
 FROM (SELECT *, max(chla) OVER (PARTITION BY profile_id) AS top, max(pred) OVER (PARTITION BY profile_id) AS ptop FROM scored) AS t GROUP BY 1),
binned AS (SELECT CAST(floor(obs_z / 10) * 10 AS INT) AS o, CAST(floor(pred_z / 10) * 10 AS INT) AS p FROM peaks),
bins AS (SELECT CAST(b * 10 AS INT) AS o FROM (SELECT unnest(range(0, 7)) AS b) AS x)"""


def _peak_pairs(spark, d):
    scored = P.profiles_long(spark, d).withColumn(
        "pred", F.col("chla") * 0.75 + F.lit(0.0625) * (F.col("z_idx") + 1) * (F.col("profile_id") % 5)
    )
    best = lambda v: (-F.max(F.struct(F.col(v).alias("v"), (-F.col("z")).alias("up")))["up"])
    return scored.groupBy("profile_id").agg(best("chla").alias("obs"), best("pred").alias("pred"))


@query("peak_confusion_counts", "A24", f"""
WITH {_PEAKS_SQL}
SELECT bins.o || '-' || (bins.o + 10) AS obs_bin, {', '.join(f'count(CASE WHEN p = {10 * i} THEN 1 END) AS "{10 * i}-{10 * i + 10}"' for i in range(7))}
FROM bins LEFT JOIN binned ON binned.o = bins.o GROUP BY bins.o
""")
def peak_confusion_counts(spark, d):
    return gridagg.confusion_matrix(_peak_pairs(spark, d), "obs", "pred", [10 * i for i in range(8)], BIN_LABELS)


@query("peak_confusion_fractions", "A24", f"""
WITH {_PEAKS_SQL}
SELECT bins.o || '-' || (bins.o + 10) AS obs_bin, {', '.join(f'round(count(CASE WHEN p = {10 * i} THEN 1 END) * 1.0 / nullif(count(p), 0) + 3e-10, 6) + 0.0 AS "{10 * i}-{10 * i + 10}"' for i in range(7))}
FROM bins LEFT JOIN binned ON binned.o = bins.o GROUP BY bins.o
""")
def peak_confusion_fractions(spark, d):
    return gridagg.confusion_matrix(
        _peak_pairs(spark, d), "obs", "pred", [10 * i for i in range(8)], BIN_LABELS, normalise=True
    )


@query("distinct_counts", "A27 U3", f"""
WITH {P.CUBE_LONG}
SELECT count(DISTINCT date) AS days, count(DISTINCT lat_idx * 10 + lon_idx) AS cells, count(*) AS samples FROM cube_long
""")
def distinct_counts(spark, d):
    return P.cube_long(spark, d).agg(
        F.countDistinct("date").alias("days"), F.countDistinct(F.col("lat_idx") * 10 + F.col("lon_idx")).alias("cells"),
        F.count("*").alias("samples"),
    )
