"""Matchup, nearest cells, sampling, membership, regridding."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.axes import RegularAxis
from ..operators import matchup as M
from ..operators.asof import nearest_on_axis
from ..sources.tables import read_parquet
from . import proxies as P
from .grid_queries import metrics
from .registry import query


def _matchup_sql(end: str, columns: str) -> str:
    return f"""
WITH {P.POINTS}, {P.MANIFEST}, {P.CUBE_LONG}, hit AS (
 SELECT p.*, m.granule, m.t_start, m.t_end, m.date FROM points AS p JOIN manifest AS m ON p.time >= m.t_start AND p.time < {end}),
pix AS (SELECT date, lat_idx, lon_idx, {', '.join(f'max(CASE WHEN z_idx = {i} THEN chla END) AS b{i}' for i in range(5))} FROM cube_long GROUP BY 1, 2, 3)
SELECT h.event_id, h.granule AS pace_Rrs_file, h.t_start AS pace_Rrs_t_start, h.t_end AS pace_Rrs_t_end,
 70.0 - h.lat_idx AS pace_Rrs_lat, -180.0 + 36 * h.lon_idx AS pace_Rrs_lon, {columns}
FROM hit AS h LEFT JOIN pix AS x ON x.date = h.date AND x.lat_idx = h.lat_idx AND x.lon_idx = h.lon_idx"""


ALL_BANDS = ", ".join(f"b{i} AS pace_Rrs_{400 + 5 * i}" for i in range(5))
BAND_NAMES = [f"pace_Rrs_{400 + 5 * i}" for i in range(5)]
TIMES = "pace_Rrs_t_start pace_Rrs_t_end"


def _match(spark, d, **kw):
    out = M.match_points(
        P.points(spark, d), P.manifest(spark, d).drop("date"), P.granule_pixels(spark, d),
        P.cube_lat(spark, d), P.CUBE_LON, bands=P.BANDS, **kw,
    )
    return out.drop("time", "lat", "lon")


@query("matchup_24h_window", "J1 J3", _matchup_sql("m.t_start + INTERVAL 24 HOUR", ALL_BANDS),
       doubles="pace_Rrs_lat pace_Rrs_lon " + " ".join(BAND_NAMES), texts=TIMES)
def matchup_24h_window(spark, d):
    return _match(spark, d)


@query("matchup_coverage_window", "J2", _matchup_sql("m.t_end", ALL_BANDS),
       doubles="pace_Rrs_lat pace_Rrs_lon " + " ".join(BAND_NAMES), texts=TIMES)
def matchup_coverage_window(spark, d):
    return _match(spark, d, window="coverage")


@query("matchup_single_band", "J1", _matchup_sql("m.t_start + INTERVAL 24 HOUR", "b2 AS pace_Rrs_410"),
       doubles="pace_Rrs_lat pace_Rrs_lon pace_Rrs_410", texts=TIMES)
def matchup_single_band(spark, d):
    return _match(spark, d, select=410.0)


@query("matchup_scalar_product", "J1", f"""
WITH {P.POINTS}, {P.MANIFEST}, {P.CUBE_METRICS}
SELECT p.event_id, m.granule AS pace_chlor_a_file, c.chla_peak AS pace_chlor_a
FROM points AS p JOIN manifest AS m ON p.time >= m.t_start AND p.time < m.t_start + INTERVAL 24 HOUR
LEFT JOIN cube_metrics AS c ON c.date = m.date AND c.lat_idx = p.lat_idx AND c.lon_idx = p.lon_idx
""", doubles="pace_chlor_a")
def matchup_scalar_product(spark, d):
    name = F.concat(F.lit("PACE_"), F.date_format("date", "yyyyMMdd"), F.lit(".nc")).alias("granule")
    pixels = metrics(spark, d).select(name, "lat_idx", "lon_idx", "chla_peak")
    out = M.match_points(
        P.points(spark, d), P.manifest(spark, d).drop("date"), pixels, P.cube_lat(spark, d), P.CUBE_LON,
        variable="chlor_a", value="chla_peak",
    )
    return out.select("event_id", "pace_chlor_a_file", "pace_chlor_a")


def _sample_sql() -> str:
    u = lambda salt: f"({P.hash_sql('event_id', '42' + salt)} / 4294967296.0)"
    return f"""
WITH {P.CUBE_METRICS}, {P.DAYS}, axis AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM days),
g AS (SELECT max(floor(user_id / 10.0)) AS last FROM events),
drawn AS (SELECT event_id, CAST(floor({u('t')} * (SELECT max(n) FROM axis)) AS BIGINT) AS t,
 CAST(70 - last AS DOUBLE) + {u('y')} * last AS lat, -180.0 + {u('x')} * 324.0 AS lon, last FROM events, g)
SELECT s.event_id, axis.date, s.lat, s.lon, c.chla_peak FROM drawn AS s JOIN axis ON axis.t = s.t
JOIN cube_metrics AS c ON c.date = axis.date AND c.lat_idx = least(greatest(ceil(70 - s.lat - 0.5), 0), s.last)
 AND c.lon_idx = least(greatest(ceil((s.lon + 180) / 36 - 0.5), 0), 9)
WHERE (c.lat_idx * 10 + c.lon_idx) % 7 <> 0"""


def _calendar(spark, d):
    """Positions 0..T-1 of the days on the time axis."""
    idx = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1
    return P.days(spark, d).withColumn("time_idx", idx.cast("int"))


@query("random_point_samples", "J4", _sample_sql(), doubles="lat lon chla_peak", texts="date")
def random_point_samples(spark, d):
    lat = P.cube_lat(spark, d)
    low = F.lit(70.0) - (lat.size - F.lit(1)).cast("double")
    samples = M.random_samples(P.events(spark, d, "event_id"), "event_id", _calendar(spark, d), (low, 70.0), (-180.0, 144.0))
    cube = metrics(spark, d)
    return M.lookup_samples(samples, cube, "chla_peak", lat, P.CUBE_LON, P.is_ocean()).select(
        "event_id", "date", "lat", "lon", "chla_peak"
    )


@query("sample_value_lookup", "J5", f"""
WITH {P.POINTS}, {P.CUBE_METRICS}
SELECT p.event_id, c.chla_peak FROM points AS p JOIN cube_metrics AS c
 ON c.date = CAST(p.time AS DATE) AND c.lat_idx = p.lat_idx AND c.lon_idx = p.lon_idx WHERE (c.lat_idx * 10 + c.lon_idx) % 7 <> 0
""", doubles="chla_peak")
def sample_value_lookup(spark, d):
    samples = P.points(spark, d).select("event_id", F.col("time").cast("date").alias("date"), "lat", "lon")
    found = M.lookup_samples(samples, metrics(spark, d), "chla_peak", P.cube_lat(spark, d), P.CUBE_LON, P.is_ocean())
    return found.select("event_id", "chla_peak")


NEAREST_LABELS = [0.0, 1.5, 4.0, 9.0, 11.0, 20.0, 33.0, 50.0]


def _nearest_sql(labels, out):
    cases = []
    for i, (a, b) in enumerate(zip(labels, labels[1:])):
        ascending = labels[0] < labels[-1]
        cases.append(f"WHEN q {'<=' if ascending else '>='} {(a + b) / 2} THEN {i}")
    return f"CASE {' '.join(cases)} ELSE {len(labels) - 1} END AS {out}"


@query("nearest_axis_index", "J6", f"""
SELECT q, count(*) AS n, {_nearest_sql(NEAREST_LABELS, 'up')}, {_nearest_sql(NEAREST_LABELS[::-1], 'down')} FROM (
 SELECT l_quantity / 4 AS q FROM lineitem) AS t GROUP BY 1
""", doubles="q")
def nearest_axis_index(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_quantity"])
    q = li.groupBy((F.col("l_quantity") / 4).alias("q")).agg(F.count("*").alias("n"))
    return M.nearest_index(M.nearest_index(q, "q", NEAREST_LABELS, "up"), "q", NEAREST_LABELS[::-1], "down")


_AXIS_ROWS = """axis AS (SELECT p_partkey - 1 AS up_pos, (SELECT max(p_partkey) FROM part) - p_partkey AS down_pos, p_partkey * (p_partkey + 3) / 8.0 AS label FROM part)"""


@query("nearest_axis_table", "J6", f"""
WITH {_AXIS_ROWS}, asked AS (SELECT floor(l_extendedprice * 4) / 8.0 AS q, count(*) AS n FROM lineitem GROUP BY 1),
lo AS (SELECT a.q, a.n, x.label AS below, x.up_pos AS lo_up, x.down_pos AS lo_down FROM asked AS a ASOF LEFT JOIN axis AS x ON a.q >= x.label),
both_ AS (SELECT l.*, x.label AS above, x.up_pos AS hi_up, x.down_pos AS hi_down FROM lo AS l ASOF LEFT JOIN axis AS x ON l.q <= x.label),
side AS (SELECT *, CASE WHEN below IS NULL THEN 1 WHEN above IS NULL THEN -1 WHEN q - below < above - q THEN -1 WHEN q - below > above - q THEN 1 ELSE 0 END AS s FROM both_)
SELECT q, n, CASE WHEN s <= 0 THEN lo_up ELSE hi_up END AS up_left, CASE WHEN s < 0 THEN lo_up ELSE hi_up END AS up_larger,
 CASE WHEN s < 0 THEN lo_down ELSE hi_down END AS down_left FROM side
""", doubles="q")
def nearest_axis_table(spark, d):
    """Prices on an irregular axis of all parts, in both directions and with both tie rules."""
    part = read_parquet(spark, f"{d}/part.parquet", columns=["p_partkey"])
    key = F.col("p_partkey")
    axis = part.select(
        (key - 1).alias("up"), (part.agg(F.max("p_partkey")).scalar() - key).alias("down"), (key * (key + 3) / 8.0).alias("label"),
    )
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_extendedprice"])
    asked = li.groupBy((F.floor(F.col("l_extendedprice") * 4) / 8.0).alias("q")).agg(F.count("*").alias("n"))
    out = nearest_on_axis(asked, "q", axis, "up_left", position="up")
    out = nearest_on_axis(out, "q", axis, "up_larger", tie="larger", position="up")
    return nearest_on_axis(out, "q", axis, "down_left", position="down")


@query("exact_day_position", "J7", f"""
WITH {P.DAYS}, axis AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS time_idx FROM days) SELECT date, time_idx FROM axis
""", texts="date")
def exact_day_position(spark, d):
    return M.exact_day(P.days(spark, d), _calendar(spark, d))


@query("truth_prediction_pairs", "J8 P8", f"""
WITH {P.TRUTH_PRED}, {P.CUBE_METRICS}
SELECT t.date, count(*) AS n, avg(t.truth) AS truth, avg(c.chla_peak) AS pred FROM truth_pred AS t
JOIN cube_metrics AS c ON c.date = t.date AND c.lat_idx = t.lat_idx AND c.lon_idx = t.lon_idx GROUP BY 1
""", doubles="truth pred", texts="date")
def truth_prediction_pairs(spark, d):
    pred = metrics(spark, d).withColumnRenamed("chla_peak", "pred")
    pairs = M.pair_truth(P.truth_pred(spark, d).drop("pred"), pred, ["date", "lat_idx", "lon_idx"])
    return pairs.groupBy("date").agg(F.count("*").alias("n"), F.avg("truth").alias("truth"), F.avg("pred").alias("pred"))


@query("membership_semi_anti", "J10", """
SELECT c_mktsegment, CAST(sum(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END) AS BIGINT) AS with_orders,
 CAST(sum(CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END) AS BIGINT) AS without_orders FROM customer GROUP BY 1
""")
def membership_semi_anti(spark, d):
    customer = read_parquet(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_mktsegment"])
    ids = read_parquet(spark, f"{d}/orders.parquet", columns=["o_custkey"]).select(F.col("o_custkey").alias("c_custkey"))
    inside = customer.join(ids, "c_custkey", "left_semi").withColumn("hit", F.lit(1))
    outside = customer.join(ids, "c_custkey", "left_anti").withColumn("hit", F.lit(0))
    return inside.unionByName(outside).groupBy("c_mktsegment").agg(
        F.sum("hit").alias("with_orders"), F.sum(1 - F.col("hit")).alias("without_orders")
    )


COARSE_LAT, COARSE_LON = RegularAxis(70.0, -5.0, 20), RegularAxis(-180.0, 10.0, 36)
_FIELD_SQL = """field AS (SELECT CAST(l_suppkey % 20 AS INT) AS i, CAST(l_partkey % 36 AS INT) AS j, avg(l_quantity) AS mld FROM lineitem GROUP BY 1, 2)"""


def _field(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_suppkey", "l_partkey", "l_quantity"])
    return li.groupBy(
        (F.col("l_suppkey") % 20).cast("int").alias("lat_idx"), (F.col("l_partkey") % 36).cast("int").alias("lon_idx")
    ).agg(F.avg("l_quantity").alias("mld"))


def _targets(spark, d):
    lat = P.cube_lat(spark, d)
    grid = P.mask(spark, d).select("lat_idx", "lon_idx")
    return grid.withColumns({"lat": lat.label("lat_idx"), "lon": P.CUBE_LON.label("lon_idx")})


@query("regrid_nearest", "I13", f"""
WITH {P.MASK}, {_FIELD_SQL}
SELECT m.lat_idx, m.lon_idx, f.mld FROM mask AS m LEFT JOIN field AS f
 ON f.i = least(greatest(ceil(m.lat_idx / 5.0 - 0.5), 0), 19) AND f.j = least(greatest(floor(3.6 * m.lon_idx + 0.5), 0), 35)
""", doubles="mld")
def regrid_nearest(spark, d):
    out = M.regrid_nearest(_field(spark, d), _targets(spark, d), COARSE_LAT, COARSE_LON, "mld")
    return out.select("lat_idx", "lon_idx", "mld")


@query("regrid_bilinear", "I13", f"""
WITH {P.MASK}, {_FIELD_SQL}, pos AS (SELECT lat_idx, lon_idx, least(greatest(lat_idx / 5.0, 0), 19) AS y, least(greatest(3.6 * lon_idx, 0), 35) AS x FROM mask),
cell AS (SELECT *, CAST(least(floor(y), 18) AS INT) AS i0, CAST(least(floor(x), 34) AS INT) AS j0 FROM pos),
corner AS (SELECT lat_idx, lon_idx, i0 + a AS i, j0 + b AS j,
 (CASE WHEN a = 1 THEN y - i0 ELSE 1 - (y - i0) END) * (CASE WHEN b = 1 THEN x - j0 ELSE 1 - (x - j0) END) AS w
 FROM cell, (SELECT 0 AS a UNION ALL SELECT 1) AS p, (SELECT 0 AS b UNION ALL SELECT 1) AS q)
SELECT c.lat_idx, c.lon_idx, CASE WHEN count(f.mld) = count(*) THEN sum(c.w * f.mld) END AS mld
FROM corner AS c LEFT JOIN field AS f ON f.i = c.i AND f.j = c.j WHERE c.w > 0 GROUP BY 1, 2
""", doubles="mld")
def regrid_bilinear(spark, d):
    return M.regrid_bilinear(_field(spark, d), _targets(spark, d), COARSE_LAT, COARSE_LON, "mld")
