"""Projection, filter, selection and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.column import total
from ..functions.features import log10_positive, pow10
from ..functions.missing import count_present, fill_missing
from ..operators import columns, neighbours, selection as S
from ..sources.tables import read_parquet
from . import proxies as P
from .grid_queries import metrics
from .registry import query

L = P.PROFILE_LABELS
L_SQL = ", ".join(L)
ALL_NULL = " AND ".join(f"{c} IS NULL" for c in L)
ANY_NULL = " OR ".join(f"{c} IS NULL" for c in L)
GAP = 3  # smaller values count as missing where a rule would else meet no gap
N_PRESENT = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in L)


@query("stacked_sources", "P1 P2 P3 P4 U1 U2", """
SELECT type, orderpriority, count(*) AS n, sum(CAST(value AS DOUBLE)) AS value FROM (
 SELECT o_orderkey AS id, o_orderpriority AS orderpriority, CAST(o_totalprice AS FLOAT) AS value, 0 AS type FROM orders
 UNION ALL SELECT l_orderkey, l_returnflag, CAST(l_extendedprice AS FLOAT), 1 FROM lineitem) AS t GROUP BY 1, 2
""", doubles="value", digits=2)
def stacked_sources(spark, d):
    first = S.conform(
        read_parquet(spark, f"{d}/orders.parquet"),
        {"o_orderkey": "id", "o_orderpriority": "orderpriority", "o_totalprice": "value"},
        ["id", "orderpriority", "value"], consts={"type": 0},
    )
    second = S.conform(
        read_parquet(spark, f"{d}/lineitem.parquet"),
        {"l_orderkey": "id", "l_returnflag": "orderpriority", "l_extendedprice": "value"},
        ["id", "orderpriority", "value"], consts={"type": 1},
    )
    both = S.cast_columns(S.stack_sources(first, second), ["value"])
    return both.groupBy("type", "orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("value"))


@query("numbered_columns", "P2 L1 W5", f"""
WITH {P.PROFILES_WIDE}
SELECT profile_id, {L_SQL} FROM wide WHERE NOT ({ANY_NULL})
""", doubles=" ".join(L))
def numbered_columns(spark, d):
    wide = P.profiles_wide(spark, d)
    cols = N.sort_by_depth(N.numbered_columns(wide.columns, "CHLA_"))
    return S.complete_cases(wide.select("profile_id", *cols), cols)


@query("drop_all_missing", "P5", f"""
WITH {P.PROFILES_WIDE}, gaps AS (SELECT profile_id, {', '.join(f'CASE WHEN {c} >= {GAP} THEN {c} END AS {c}' for c in L)} FROM wide)
SELECT profile_id, {L_SQL} FROM gaps WHERE NOT ({ALL_NULL})
""", doubles=" ".join(L))
def drop_all_missing(spark, d):
    wide = P.profiles_wide(spark, d)
    gaps = wide.select("profile_id", *[F.when(F.col(c) >= GAP, F.col(c)).alias(c) for c in L])
    return S.drop_all_missing(gaps, L)


@query("complete_cases", "P6", f"""
WITH {P.PROFILES_WIDE} SELECT profile_id, {L_SQL} FROM wide WHERE NOT ({ANY_NULL})
""", doubles=" ".join(L))
def complete_cases(spark, d):
    return S.complete_cases(P.profiles_wide(spark, d), L)


@query("positive_log_response", "P7 F6", f"""
WITH {P.PROFILES_WIDE}, y AS (SELECT profile_id, {L[2]} - 2 AS y FROM wide)
SELECT profile_id, log10(y) AS y, power(10, log10(y)) AS back FROM y WHERE y > 0
""", doubles="y back")
def positive_log_response(spark, d):
    y = P.profiles_wide(spark, d).select("profile_id", (F.col(L[2]) - 2).alias("y"))
    return S.positive_log10(y, "y").withColumn("back", pow10("y"))


@query("finite_pairs", "P8", f"""
WITH {P.PROFILES_WIDE}
SELECT count(*) AS n, sum({L[0]}) AS a, sum({L[3]}) AS b FROM wide WHERE {L[0]} IS NOT NULL AND {L[3]} IS NOT NULL
""", doubles="a b")
def finite_pairs(spark, d):
    pairs = S.complete_cases(P.profiles_wide(spark, d), [L[0], L[3]])
    return pairs.agg(F.count("*").alias("n"), F.sum(L[0]).alias("a"), F.sum(L[3]).alias("b"))


@query("box_slice", "P9", f"""
WITH {P.CUBE_METRICS}
SELECT date, lat_idx, lon_idx, chla_peak FROM cube_metrics
WHERE 70 - lat_idx BETWEEN 60 AND 66 AND -180 + 36 * lon_idx BETWEEN -108 AND 0 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
""", doubles="chla_peak", texts="date")
def box_slice(spark, d):
    roi = S.box(metrics(spark, d), P.cube_lat(spark, d), P.CUBE_LON, (60, 66), (-108, 0))
    return S.days_between(roi, "2024-01-05", "2024-01-20").select("date", "lat_idx", "lon_idx", "chla_peak")


@query("nearest_point_series", "P10", f"""
WITH {P.CUBE_METRICS}
SELECT date, chla_peak, chla_peak_depth FROM cube_metrics WHERE lat_idx = 1 AND lon_idx = 4
""", doubles="chla_peak chla_peak_depth", texts="date")
def nearest_point_series(spark, d):
    point = S.nearest_point(metrics(spark, d), P.cube_lat(spark, d), P.CUBE_LON, 69.2, -30.0)
    return point.select("date", "chla_peak", "chla_peak_depth")


@query("positional_stride", "P11", f"""
WITH {P.CUBE_LONG}
SELECT date, lat_idx, lon_idx, z_idx, chla FROM cube_long WHERE z_idx >= 1 AND z_idx < 5 AND (z_idx - 1) % 2 = 0 AND lat_idx % 3 = 0
""", doubles="chla", texts="date")
def positional_stride(spark, d):
    rows = S.stride(S.stride(P.cube_long(spark, d), "z_idx", 1, 5, 2), "lat_idx", 0, None, 3)
    return rows.select("date", "lat_idx", "lon_idx", "z_idx", "chla")


@query("nearest_depth_layer", "P12 S4", f"""
WITH {P.CUBE_LONG}, cells AS (SELECT DISTINCT date, lat_idx, lon_idx FROM cube_long)
SELECT c.date, c.lat_idx, c.lon_idx, l.chla FROM cells AS c
LEFT JOIN cube_long AS l ON l.date = c.date AND l.lat_idx = c.lat_idx AND l.lon_idx = c.lon_idx AND l.z_idx = 1
""", doubles="chla", texts="date")
def nearest_depth_layer(spark, d):
    return S.depth_layer(P.cube(spark, d), P.CUBE_AXIS, 15.0).select("date", "lat_idx", "lon_idx", "chla")


@query("year_filter", "P13", f"""
WITH {P.SHIP_CUBE} SELECT date, count(*) AS n, avg(chla) AS chla FROM ship_cube WHERE year(date) IN (1996, 1999) GROUP BY 1
""", doubles="chla", texts="date")
def year_filter(spark, d):
    rows = S.require_rows(S.in_years(P.ship_cube(spark, d), [1996, 1999]), "no data in these years")
    return rows.groupBy("date").agg(F.count("*").alias("n"), F.avg("chla").alias("chla"))


@query("land_mask", "P14 P25", f"""
WITH {P.CUBE_METRICS}, {P.MASK}
SELECT date, lat_idx, lon_idx, CASE WHEN ocean THEN chla_peak END AS chla_peak FROM cube_metrics JOIN mask USING (lat_idx, lon_idx)
""", doubles="chla_peak", texts="date")
def land_mask(spark, d):
    rows = metrics(spark, d).join(P.mask(spark, d), ["lat_idx", "lon_idx"])
    return S.mask_where(rows, F.col("ocean"), ["chla_peak"]).select("date", "lat_idx", "lon_idx", "chla_peak")


@query("threshold_mask", "P15", f"""
WITH {P.CUBE_METRICS}
SELECT date, avg(CASE WHEN chla_peak > 50 THEN chla_peak END) AS high_peak, avg(CASE WHEN chla_peak > 50 THEN log10(chla_peak) END) AS log_peak
FROM cube_metrics GROUP BY 1
""", doubles="high_peak log_peak", texts="date")
def threshold_mask(spark, d):
    rows = S.mask_where(metrics(spark, d), F.col("chla_peak") > 50, ["chla_peak"])
    return rows.groupBy("date").agg(
        F.avg("chla_peak").alias("high_peak"), F.avg(log10_positive("chla_peak")).alias("log_peak")
    )


@query("exclude_listed_ids", "P16 J10", """
SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS balance FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1
""", doubles="balance", digits=4)
def exclude_listed_ids(spark, d):
    customer = read_parquet(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_nationkey", "c_acctbal"])
    bad = read_parquet(spark, f"{d}/orders.parquet", columns=["o_custkey"], where="o_totalprice > 400000")
    kept = S.exclude_ids(customer, bad.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return kept.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))


@query("fill_missing", "P17", f"""
WITH {P.PROFILES_WIDE}, m AS (SELECT avg({L[4]}) AS mean FROM wide)
SELECT profile_id, coalesce({L[4]}, 0) AS zero_fill, coalesce({L[4]}, mean) AS mean_fill FROM wide, m
""", doubles="zero_fill mean_fill")
def fill(spark, d):
    wide = P.profiles_wide(spark, d)
    mean = wide.select(F.avg(L[4])).scalar()
    return wide.select("profile_id", fill_missing(L[4]).alias("zero_fill"), fill_missing(L[4], mean).alias("mean_fill"))


@query("platform_token_filter", "P18", """
SELECT split_part(c_name, '#', 1) AS kind, substr(o_orderpriority, 1, 1) AS platform, count(*) AS n FROM orders
JOIN customer ON o_custkey = c_custkey WHERE split_part(o_orderpriority, '-', 1) IN ('1', '2', '5') GROUP BY 1, 2
""")
def platform_token_filter(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_custkey", "o_orderpriority"])
    customer = read_parquet(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name"])
    # profile ids are "<platform>_<cycle>"; priorities are "<n>-<text>"
    platform = S.platform_token(F.translate("o_orderpriority", "-", "_"))
    rows = orders.withColumn("platform", platform).where(F.col("platform").isin("1", "2", "5"))
    named = rows.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return named.groupBy(F.substring_index("c_name", "#", 1).alias("kind"), "platform").agg(F.count("*").alias("n"))


@query("min_observed_bins", "P19", f"""
WITH {P.PROFILES_WIDE} SELECT profile_id, {N_PRESENT} AS present FROM wide WHERE {N_PRESENT} >= 3
""")
def min_observed_bins(spark, d):
    wide = P.profiles_wide(spark, d).withColumn("present", count_present(L))
    return wide.where("present >= 3").select("profile_id", "present")


@query("quality_flagged_samples", "P20 P21", """
SELECT l_returnflag AS qc, count(*) AS n, sum(greatest(l_linenumber - 3, 1)) AS depth_sum, avg(l_quantity) AS chla FROM lineitem
WHERE l_returnflag IN ('A', 'B') GROUP BY 1
""", doubles="depth_sum chla")
def quality_flagged_samples(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_returnflag", "l_linenumber", "l_quantity"])
    text = S.good_quality(li, "l_returnflag")
    depth = F.greatest(F.col("l_linenumber") - 3, F.lit(1))
    return text.groupBy(F.col("l_returnflag").alias("qc")).agg(
        F.count("*").alias("n"), F.sum(depth).cast("double").alias("depth_sum"), F.avg("l_quantity").alias("chla")
    )


@query("numeric_quality_flags", "P20", """
SELECT l_linenumber AS qc, count(*) AS n, avg(l_quantity) AS chla FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1
""", doubles="chla")
def numeric_quality_flags(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_linenumber", "l_quantity"])
    good = S.good_quality(li, "l_linenumber")
    return good.groupBy(F.col("l_linenumber").alias("qc")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("chla"))


@query("first_profile_per_cast", "P22 L2", """
SELECT c_custkey, o_orderdate, o_orderkey, o_totalprice FROM (
 SELECT o_custkey AS c_custkey, o_orderdate, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) AS t WHERE rn = 1
""", doubles="o_totalprice", texts="o_orderdate", digits=2)
def first_profile_per_cast(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"])
    return S.first_per_key(orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["o_orderdate", "o_orderkey"])


@query("bands_to_long", "P23", """
SELECT label, band, count(*) AS n, avg(v) AS mean_rrs FROM (
 SELECT label, 400 + 5 * (i - 1) AS band, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) AS x) AS t
GROUP BY 1, 2
""", doubles="mean_rrs band")
def bands_to_long(spark, d):
    spectra = read_parquet(spark, f"{d}/embeddings.parquet", columns=["label", "embedding"])
    long = spectra.select("label", F.posexplode("embedding").alias("i", "v"))
    return long.groupBy("label", (F.lit(400.0) + F.col("i") * 5).alias("band")).agg(
        F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("mean_rrs")
    )


@query("bands_as_columns", "P23", """
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS pace_Rrs_400, CAST(embedding[2] AS DOUBLE) AS pace_Rrs_405, CAST(embedding[64] AS DOUBLE) AS pace_Rrs_715
FROM embeddings
""", doubles="pace_Rrs_400 pace_Rrs_405 pace_Rrs_715")
def bands_as_columns(spark, d):
    spectra = read_parquet(spark, f"{d}/embeddings.parquet", columns=["vec_id", "embedding"])
    wide = S.bands_to_columns(spectra, "embedding", [400.0 + 5 * i for i in range(64)], "pace_Rrs_")
    return wide.select("vec_id", "pace_Rrs_400", "pace_Rrs_405", "pace_Rrs_715")


@query("wide_long_round_trip", "P24", f"""
WITH {P.PROFILES} SELECT profile_id, 10.0 * z_idx AS z_start, 10.0 * z_idx + 10 AS z_end, z, chla FROM profiles
""", doubles="z_start z_end z chla")
def wide_long_round_trip(spark, d):
    long = S.wide_to_long(P.profiles_wide(spark, d), ["profile_id"])
    wide = S.long_to_wide(long, ["profile_id"], L)
    back = S.wide_to_long(wide, ["profile_id"]).where(F.col("chla").isNotNull())
    return back.select("profile_id", "z_start", "z_end", "z", "chla")


@query("cube_to_long", "P24 P28", f"""
WITH {P.CUBE_LONG}
SELECT z_idx, 10.0 * z_idx AS z_start, 10.0 * z_idx + 10 AS z_end, 10.0 * z_idx + 5 AS z, 10.0 AS z_thickness, count(*) AS n, sum(chla) AS chla
FROM cube_long GROUP BY 1
""", doubles="z_start z_end z z_thickness chla", digits=4)
def cube_to_long(spark, d):
    long = columns.to_long(P.cube(spark, d), P.CUBE_AXIS).where(F.col("chla").isNotNull())
    return long.groupBy("z_idx", "z_start", "z_end", "z", "z_thickness").agg(F.count("*").alias("n"), F.sum("chla").alias("chla"))


@query("static_variable_broadcast", "P25 F5", f"""
WITH {P.CUBE_METRICS}, {P.MASK}
SELECT date, count(*) AS cells, CAST(sum(CASE WHEN ocean THEN 1 ELSE 0 END) AS BIGINT) AS ocean_cells, avg(70.0 - lat_idx) AS lat, avg(-180.0 + 36 * lon_idx) AS lon
FROM cube_metrics JOIN mask USING (lat_idx, lon_idx) GROUP BY 1
""", doubles="lat lon", texts="date")
def static_variable_broadcast(spark, d):
    rows = metrics(spark, d).join(P.mask(spark, d), ["lat_idx", "lon_idx"])
    lat = P.cube_lat(spark, d)
    rows = rows.withColumns({"lat": lat.label("lat_idx"), "lon": P.CUBE_LON.label("lon_idx")})
    return rows.groupBy("date").agg(
        F.count("*").alias("cells"), F.sum(F.col("ocean").cast("int")).alias("ocean_cells"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
    )


@query("time_axis_added", "P26", f"""
WITH {P.CUBE_METRICS} SELECT DATE '2024-07-15' AS time, lat_idx, lon_idx, max(chla_peak) AS chla_peak FROM cube_metrics GROUP BY 2, 3
""", doubles="chla_peak", texts="time")
def time_axis_added(spark, d):
    layer = metrics(spark, d).groupBy("lat_idx", "lon_idx").agg(F.max("chla_peak").alias("chla_peak"))
    return layer.withColumn("time", F.lit("2024-07-15").cast("date"))


@query("densified_grid", "P27", f"""
WITH {P.CUBE_METRICS}, {P.MASK}, {P.DAYS}
SELECT days.date, mask.lat_idx, mask.lon_idx, chla_peak FROM days CROSS JOIN mask
LEFT JOIN cube_metrics AS c ON c.date = days.date AND c.lat_idx = mask.lat_idx AND c.lon_idx = mask.lon_idx
""", doubles="chla_peak", texts="date")
def densified_grid(spark, d):
    facts = metrics(spark, d).select("date", "lat_idx", "lon_idx", "chla_peak")
    return S.densify(facts, P.days(spark, d), P.lat_count(spark, d), 10)


@query("residuals", "P29 J8", f"""
WITH {P.TRUTH_PRED} SELECT date, lat_idx, lon_idx, truth - pred AS residual FROM truth_pred
""", doubles="residual", texts="date")
def residuals(spark, d):
    return P.truth_pred(spark, d).select("date", "lat_idx", "lon_idx", (F.col("truth") - F.col("pred")).alias("residual"))


_SMOOTH = P.PROFILES + """, smoothed AS (
 SELECT profile_id, z_idx, z, chla, (coalesce(lag(chla) OVER w, chla) + chla + coalesce(lead(chla) OVER w, chla)) / 3 AS smoothed
 FROM profiles WINDOW w AS (PARTITION BY profile_id ORDER BY z_idx))"""


@query("smoothed_profiles", "W1 W5", f"""
WITH {_SMOOTH} SELECT profile_id, z_idx, smoothed FROM smoothed
""", doubles="smoothed")
def smoothed_profiles(spark, d):
    return neighbours.smooth_profiles(P.profiles_long(spark, d), ["profile_id"]).select("profile_id", "z_idx", "smoothed")


@query("smoothed_array_peak", "W1 W2", f"""
WITH {_SMOOTH}, r AS (SELECT profile_id, z, round(smoothed, 9) AS smoothed FROM smoothed)
SELECT profile_id, max(smoothed) AS peak_value FROM r GROUP BY 1
""", doubles="peak_value")
def smoothed_array_peak(spark, d):
    arrays = neighbours.smooth_array(P.profiles(spark, d), "chla", "smoothed")
    return arrays.select("profile_id", F.array_max("smoothed").alias("peak_value"))


@query("first_peak_depth", "W2 A4 I2", f"""
WITH {P.PROFILES}
SELECT profile_id, min(CASE WHEN chla = top THEN z END) AS peak_depth, max(top) AS peak_value
FROM (SELECT *, max(chla) OVER (PARTITION BY profile_id) AS top FROM profiles) AS t GROUP BY 1
""", doubles="peak_depth peak_value")
def first_peak_depth(spark, d):
    return neighbours.first_peak(P.profiles_long(spark, d), ["profile_id"], "chla")


@query("column_total", "A1 F14", f"""
WITH {P.PROFILES} SELECT profile_id, coalesce(sum(chla), 0) AS total, count(*) AS bins FROM profiles GROUP BY 1
""", doubles="total")
def column_total(spark, d):
    rows = P.profiles(spark, d)
    present = F.size(F.filter("chla", lambda v: v.isNotNull())).cast("bigint")
    return rows.select("profile_id", total("chla", P.PROFILE_BINS).alias("total"), present.alias("bins"))
