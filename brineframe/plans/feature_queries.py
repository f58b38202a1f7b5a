"""Derived predictors, dates, names, arrays, links."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import names as N, text as X
from ..functions.axes import fold_lon, tile_id
from ..functions.features import (
    month_floor, standardise, with_seasonal_time, with_sin_coords, with_solar_time, with_unit_sphere,
)
from ..operators.quantiles import percentile_columns
from ..operators.splitting import train_stats
from ..sources.tables import read_parquet
from . import proxies as P
from .registry import query

HOUR = "(hour(time) + minute(time) / 60.0 + floor(second(time)) / 3600.0 + lon / 15.0)"
SOLAR = f"({HOUR} - 24 * floor({HOUR} / 24))"


@query("solar_time", "F1", f"""
WITH {P.POINTS}, s AS (SELECT event_id, lon, {SOLAR} AS h FROM points)
SELECT event_id, lon, CAST(h AS REAL) AS solar_hour, CAST(sin(2 * pi() * h / 24) AS REAL) AS solar_sin_time, CAST(cos(2 * pi() * h / 24) AS REAL) AS solar_cos_time FROM s
""", doubles="lon solar_hour solar_sin_time solar_cos_time", digits=4)
def solar_time(spark, d):
    out = with_solar_time(P.points(spark, d))
    return out.select("event_id", "lon", "solar_hour", "solar_sin_time", "solar_cos_time")


@query("solar_time_folded", "F1", f"""
WITH {P.POINTS}, f AS (SELECT event_id, time, lon + 360 AS raw FROM points),
g AS (SELECT event_id, time, (raw + 180) - 360 * floor((raw + 180) / 360) - 180 AS lon FROM f)
SELECT date_trunc('day', time) AS date, count(*) AS n, avg(lon) AS lon, avg(CAST(CAST({SOLAR} AS REAL) AS DOUBLE)) AS solar_hour FROM g GROUP BY 1
""", doubles="lon solar_hour", texts="date", digits=3)
def solar_time_folded(spark, d):
    pts = P.points(spark, d).withColumn("lon", F.col("lon") + 360)
    out = with_solar_time(pts)
    day = F.date_trunc("day", "time").cast("timestamp_ntz").alias("date")
    return out.groupBy(day).agg(
        F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg(F.col("solar_hour").cast("double")).alias("solar_hour")
    )


@query("seasonal_time", "F2", """
SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n, max(CAST(sin(2 * pi() * dayofyear(l_shipdate) / 365.25) AS REAL)) AS sin_time,
 max(CAST(cos(2 * pi() * dayofyear(l_shipdate) / 365.25) AS REAL)) AS cos_time FROM lineitem GROUP BY 1
""", doubles="sin_time cos_time", texts="date", digits=5)
def seasonal_time(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_shipdate"])
    per_day = li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    return with_seasonal_time(per_day, "date")


@query("unit_sphere", "F3", f"""
WITH {P.POINTS}
SELECT event_id, CAST(cos(radians(lat)) * cos(radians(lon)) AS REAL) AS x_geo, CAST(cos(radians(lat)) * sin(radians(lon)) AS REAL) AS y_geo,
 CAST(sin(radians(lat)) AS REAL) AS z_geo FROM points
""", doubles="x_geo y_geo z_geo", digits=5)
def unit_sphere(spark, d):
    return with_unit_sphere(P.points(spark, d)).select("event_id", "x_geo", "y_geo", "z_geo")


@query("sin_coords", "F4 F5", f"""
WITH {P.MASK}
SELECT lat_idx, lon_idx, 70.0 - lat_idx AS lat, -180.0 + 36 * lon_idx AS lon, sin(radians(-180.0 + 36 * lon_idx)) AS lon_sin,
 cos(radians(-180.0 + 36 * lon_idx)) AS lon_cos, sin(radians(70.0 - lat_idx)) AS lat_sin FROM mask
""", doubles="lat lon lon_sin lon_cos lat_sin")
def sin_coords(spark, d):
    grid = P.mask(spark, d).select("lat_idx", "lon_idx")
    lat = P.cube_lat(spark, d)
    return with_sin_coords(grid.withColumns({"lat": lat.label("lat_idx"), "lon": P.CUBE_LON.label("lon_idx")}))


@query("depth_labels", "F7", """
WITH labels AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'CHLA_' || (p_size * 10) || '_' || (p_size * 10 + 10) END AS label, p_size, p_partkey % 3 <> 0 AS ok FROM part)
SELECT p_partkey, CASE WHEN ok THEN p_size * 10.0 END AS z_start, CASE WHEN ok THEN p_size * 10.0 + 10 END AS z_end,
 CASE WHEN ok THEN p_size * 10.0 + 5 END AS z_center FROM labels
""", doubles="z_start z_end z_center")
def depth_labels(spark, d):
    part = read_parquet(spark, f"{d}/part.parquet", columns=["p_partkey", "p_name", "p_size"])
    made = F.concat(F.lit("CHLA_"), F.col("p_size") * 10, F.lit("_"), F.col("p_size") * 10 + 10)
    label = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(made)
    return part.select("p_partkey", label.alias("label")).withColumns(N.depth_bounds("label")).drop("label")


@query("checked_wavelengths", "F8 P2", """
SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS rrs_400, avg(CAST(embedding[64] AS DOUBLE)) AS rrs_715 FROM embeddings GROUP BY 1
""", doubles="rrs_400 rrs_715")
def checked_wavelengths(spark, d):
    bands = [400.0 + 5 * i for i in range(64)]
    cols = [f"pace_Rrs_{int(b)}" for b in bands]
    checked = N.check_wavelengths(cols + ["type"], bands, {"type": 1})
    spectra = read_parquet(spark, f"{d}/embeddings.parquet", columns=["label", "embedding"])
    ends = {"rrs_400": checked.index("pace_Rrs_400"), "rrs_715": checked.index("pace_Rrs_715")}
    return spectra.groupBy("label").agg(*[
        F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(name) for name, i in ends.items()
    ])


@query("standardised_columns", "F9 A17", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
SELECT l_linenumber, count(*) AS n, avg((l_quantity - mq) / sq) AS quantity, max((l_discount - md) / sd) AS discount, max((l_linenumber * 0 - 0) / 1) AS constant
FROM lineitem, s GROUP BY 1
""", doubles="quantity discount constant")
def standardised_columns(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_linenumber", "l_quantity", "l_discount"])
    li = li.withColumn("flat", F.lit(0.0))
    stats = train_stats(li, ["l_quantity", "l_discount", "flat"], F.lit(True))
    s = stats.select(F.struct(*stats.columns)).scalar()
    z = {v: standardise(v, s[f"mean_{v}"], s[f"std_{v}"]) for v in ("l_quantity", "l_discount", "flat")}
    return li.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.avg(z["l_quantity"]).alias("quantity"), F.max(z["l_discount"]).alias("discount"),
        F.max(z["flat"]).alias("constant"),
    )


@query("imputed_with_flag", "F10", f"""
WITH {P.PROFILES_WIDE}, m AS (SELECT profile_id % 50 AS cell, quantile_cont(CHLA_20_30, 0.5) AS med FROM wide GROUP BY 1)
SELECT profile_id, coalesce(CHLA_20_30, med) AS filled, CHLA_20_30 IS NULL AS missing FROM wide JOIN m ON m.cell = profile_id % 50
""", doubles="filled", flags="missing")
def imputed_with_flag(spark, d):
    wide = P.profiles_wide(spark, d).select("profile_id", (F.col("profile_id") % 50).alias("cell"), "CHLA_20_30")
    med = percentile_columns(wide, "CHLA_20_30", {"med": 0.5}, ["cell"])
    filled = F.coalesce("CHLA_20_30", "med")
    return wide.join(med, "cell", "left").select(
        "profile_id", filled.alias("filled"), F.col("CHLA_20_30").isNull().alias("missing")
    )


@query("calendar_parts", "F11", """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, strftime(o_orderdate, '%Y-%m') AS label,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS n, CAST(max(day(o_orderdate)) AS INT) AS last_day FROM orders GROUP BY 1, 2, 3, 4
""", texts="month_start")
def calendar_parts(spark, d):
    t = F.col("o_orderdate")
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_orderdate"])
    return orders.groupBy(
        F.year(t).alias("year"), F.month(t).alias("month"), F.date_format(t, "yyyy-MM").alias("label"),
        month_floor("o_orderdate").alias("month_start"),
    ).agg(F.count("*").alias("n"), F.max(F.dayofmonth(t)).alias("last_day"))


@query("parsed_dates", "F12 S5", """
SELECT strftime(o_orderdate, '%Y%m%d') AS token, CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, count(*) AS n
FROM orders GROUP BY 1, 2, 3
""", texts="date")
def parsed_dates(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_orderdate"])
    token = F.date_format("o_orderdate", "yyyyMMdd")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = orders.select(token.alias("token"), F.concat(F.lit("chla_z_"), token, F.lit("_v2.parquet")).alias("name"), iso.alias("iso"))
    return named.groupBy("token", X.date_token("name").alias("date"), "iso").agg(F.count("*").alias("n"))


@query("axis_spacing", "F13 L1", f"""
WITH {P.MASK}, a AS (SELECT DISTINCT 70.0 - lat_idx AS lat FROM mask), g AS (SELECT lat, abs(lat - lag(lat) OVER (ORDER BY lat)) AS gap FROM a)
SELECT count(*) AS n, min(lat) AS lo, max(lat) AS hi, avg(gap) AS mean_gap, max(gap) AS max_gap FROM g
""", doubles="lo hi mean_gap max_gap")
def axis_spacing(spark, d):
    lat = P.cube_lat(spark, d)
    axis = P.cube_lat_rows(spark, d).select(lat.label("lat_idx").alias("lat"))
    gap = F.abs(F.col("lat") - F.lag("lat").over(W.partitionBy(F.lit(0)).orderBy("lat")))
    return axis.withColumn("gap", gap).agg(
        F.count("*").alias("n"), F.min("lat").alias("lo"), F.max("lat").alias("hi"),
        F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"),
    )


@query("array_operations", "F14", f"""
WITH {P.PROFILES}
SELECT profile_id, count(*) AS present, sum(chla * 10) AS scaled, min(abs(chla - 2.5)) AS nearest_gap FROM profiles GROUP BY 1
""", doubles="scaled nearest_gap")
def array_operations(spark, d):
    rows = P.profiles(spark, d)
    valid = F.filter("chla", lambda v: v.isNotNull())
    scaled = F.aggregate(F.transform(valid, lambda v: v * 10), F.lit(0.0), lambda a, b: a + b)
    gap = F.array_min(F.transform(valid, lambda v: F.abs(v - 2.5)))
    return rows.select(
        "profile_id", F.size(valid).cast("bigint").alias("present"), scaled.alias("scaled"), gap.alias("nearest_gap")
    )


@query("json_attributes", "F15", """
SELECT event_type, count(*) AS n, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS k, max(event_type || ':' || CAST(json_extract(props, '$.k') AS VARCHAR)) AS tag
FROM events GROUP BY 1
""", doubles="k")
def json_attributes(spark, d):
    rows = P.events(spark, d, "event_type", "props")
    attrs = F.from_json("props", "map<string,string>")
    k = F.element_at(attrs, "k")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg(k.cast("double")).alias("k"), F.max(F.concat("event_type", F.lit(":"), k)).alias("tag")
    )


@query("asset_links", "F16", """
SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS is_link, url AS href,
 'https://store.example.org/base/' || ltrim(regexp_replace(url, '^https?://[^/]*', ''), '/') AS public_url FROM pages
""", flags="is_link")
def asset_links(spark, d):
    pages = read_parquet(spark, f"{d}/pages.parquet", columns=["page_id", "url"])
    relative = F.regexp_replace("url", "^https?://[^/]*", "")
    base = F.lit("https://store.example.org/base/")
    return pages.select(
        "page_id", X.is_url("url").alias("is_link"), X.join_url(base, F.col("url")).alias("href"),
        X.join_url(base, relative).alias("public_url"),
    )


@query("axis_index_and_tile", "F17 J6", f"""
WITH {P.POINTS}, n AS (SELECT max(lat_idx) AS last FROM points)
SELECT event_id, CAST(least(greatest(ceil(70 - lat - 0.5), 0), last) AS INT) AS i,
 CAST(least(greatest(floor((lon + 180) / 36 + 0.5), 0), 9) AS INT) AS j,
 CAST(floor(least(greatest(ceil(70 - lat - 0.5), 0), last) / 4) * 3 + floor(least(greatest(floor((lon + 180) / 36 + 0.5), 0), 9) / 4) AS INT) AS tile
FROM points, n
""")
def axis_index_and_tile(spark, d):
    lat = P.cube_lat(spark, d)
    pts = P.points(spark, d).withColumns({"i": lat.nearest("lat"), "j": P.CUBE_LON.nearest("lon")})
    return pts.select("event_id", "i", "j", tile_id("i", "j", 4, 10).alias("tile"))


@query("folded_longitudes", "F1 F13", """
SELECT c_custkey, (c_acctbal + 180) - 360 * floor((c_acctbal + 180) / 360) - 180 AS lon FROM customer
""", doubles="lon")
def folded_longitudes(spark, d):
    customer = read_parquet(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_acctbal"])
    return customer.select("c_custkey", fold_lon("c_acctbal").alias("lon"))
