"""Samples, splits, training statistics and the normalised training table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks, splitting as T
from ..operators.quantiles import sample_exact
from ..session import shared_dir
from ..sources.tables import read_parquet
from . import proxies as P
from .registry import query

U = f"({P.hash_sql('o_orderkey')} / 4294967296.0)"


@query("ordered_head", "L1 L2", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""", doubles="o_totalprice", digits=2)
def ordered_head(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"])
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("sample_without_replacement", "L3", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {P.hash_sql('o_orderkey')}, o_orderkey LIMIT 1000
""", doubles="o_totalprice", digits=2)
def sample_without_replacement(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"])
    return sample_exact(orders, 1000, "o_orderkey")


@query("row_split", "L4", f"""
SELECT CASE WHEN {U} < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n, avg(o_totalprice) AS price FROM orders GROUP BY 1
""", doubles="price", digits=4)
def row_split(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"])
    return T.row_split(orders, "o_orderkey").groupBy("split").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"))


@query("split_row_lookup", "J11", f"""
SELECT o_orderkey, o_totalprice FROM orders WHERE {U} < 0.2
""", doubles="o_totalprice", digits=2)
def split_row_lookup(spark, d):
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"])
    return T.split_rows(T.row_split(orders, "o_orderkey"), "test").drop("split")


def _split_sql(order: str) -> str:
    return f"""ranked AS (SELECT date, row_number() OVER (ORDER BY {order}) - 1 AS r, count(*) OVER () AS n FROM kept),
splits AS (SELECT date, CASE WHEN r < floor(CAST(0.7 AS DOUBLE) * n) THEN 'train' WHEN r < floor((CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE)) * n) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


SHUFFLED = _split_sql(f"{P.hash_sql('date')}, date")


@query("time_split", "L5", f"""
WITH kept AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), {SHUFFLED} SELECT date, split FROM splits
""", texts="date")
def time_split(spark, d):
    return T.time_split(P.ship_cube(spark, d).select("date").distinct())


@query("contiguous_time_split", "L5", f"""
WITH kept AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), {_split_sql('date')} SELECT date, split FROM splits
""", texts="date")
def contiguous_time_split(spark, d):
    return T.time_split(P.ship_cube(spark, d).select("date").distinct(), contiguous=True)


_TRAIN = P.SHIP_CUBE + ", kept AS (SELECT DISTINCT date FROM ship_cube), " + SHUFFLED + """,
rows_ AS (SELECT c.*, s.split, (c.lat_idx * 10 + c.lon_idx) % 7 <> 0 AS ocean FROM ship_cube AS c JOIN splits AS s USING (date))"""


def _rows(spark, d):
    cube = P.ship_cube(spark, d)
    return cube.join(F.broadcast(T.time_split(cube.select("date").distinct())), "date").withColumn("ocean", P.is_ocean())


@query("train_mean_std", "A17", f"""
WITH {_TRAIN}
SELECT avg(chla) AS mean_chla, stddev_pop(chla) AS std_chla, avg(aux) AS mean_aux, stddev_pop(aux) AS std_aux FROM rows_ WHERE split = 'train'
""", doubles="mean_chla std_chla mean_aux std_aux")
def train_mean_std(spark, d):
    return T.train_stats(_rows(spark, d), ["chla", "aux"])


@query("train_cell_medians", "A18", f"""
WITH {_TRAIN}, g AS (SELECT quantile_cont(chla, 0.5) AS gc, quantile_cont(aux, 0.5) AS ga FROM rows_ WHERE split = 'train' AND ocean),
cells AS (SELECT lat_idx, lon_idx, quantile_cont(CASE WHEN split = 'train' AND ocean THEN chla END, 0.5) AS mc,
 quantile_cont(CASE WHEN split = 'train' AND ocean THEN aux END, 0.5) AS ma FROM rows_ GROUP BY 1, 2)
SELECT lat_idx, lon_idx, coalesce(mc, gc, 0) AS median_chla, coalesce(ma, ga, 0) AS median_aux FROM cells, g
""", doubles="median_chla median_aux")
def train_cell_medians(spark, d):
    usable = (F.col("split") == "train") & F.col("ocean")
    return T.pixel_medians(_rows(spark, d), ["chla", "aux"], usable)


# a mask that changes by day, with its ocean cells on the 20 x 36 grid by day of year modulo 7
OCEAN_CELLS = [sum((i * 10 + j + r) % 7 != 0 for i in range(20) for j in range(36)) for r in range(7)]
_OCEAN = "(lat_idx * 10 + lon_idx + dayofyear(date)) % 7 <> 0"
_CELLS = f"CASE dayofyear(date) % 7 {' '.join(f'WHEN {r} THEN {n}' for r, n in enumerate(OCEAN_CELLS))} END"

# gappy inputs: aux counts as missing where it is small, the categorical row_no on some whole days
GAPPY = "CASE WHEN aux >= 0.01 THEN aux END"
_TABLE = P.SHIP_CUBE + f""", facts AS (SELECT date, lat_idx, lon_idx, chla AS y, {GAPPY} AS aux,
 CASE WHEN dayofyear(date) % 11 <> 0 THEN CAST(lat_idx AS DOUBLE) END AS row_no, {_OCEAN} AS ocean_mask FROM ship_cube),
seen AS (SELECT date, {_CELLS} AS o, count(CASE WHEN ocean_mask THEN y END) AS y, count(CASE WHEN ocean_mask THEN aux END) AS a,
 count(CASE WHEN ocean_mask THEN row_no END) AS r, count(CASE WHEN ocean_mask THEN 1 END) AS k FROM facts GROUP BY 1),
kept AS (SELECT date FROM seen WHERE o - least(y, a, r, k) < CAST(0.999 AS DOUBLE) * o), {SHUFFLED},
rows_ AS (SELECT f.*, s.split FROM facts AS f JOIN splits AS s USING (date)),
st AS (SELECT avg(aux) AS m, CASE WHEN stddev_pop(aux) = 0 THEN 1 ELSE stddev_pop(aux) END AS s FROM rows_ WHERE split = 'train'),
g AS (SELECT quantile_cont(aux, 0.5) AS ga FROM rows_ WHERE split = 'train' AND ocean_mask),
cells AS (SELECT lat_idx, lon_idx, coalesce(quantile_cont(CASE WHEN split = 'train' AND ocean_mask THEN aux END, 0.5), (SELECT ga FROM g), 0) AS med
 FROM rows_ GROUP BY 1, 2),
table_ AS (SELECT r.date, r.lat_idx, r.lon_idx, r.split, r.ocean_mask, r.y,
 CASE WHEN ocean_mask THEN (coalesce(aux, med) - m) / s ELSE 0 END AS f0, CAST(aux IS NULL AND ocean_mask AS INT) AS f1, coalesce(row_no, 0) AS f2, CAST(ocean_mask AS INT) AS f3
 FROM rows_ AS r JOIN cells USING (lat_idx, lon_idx), st)"""


def training_rows(spark, d):
    cube, day = P.ship_cube(spark, d), F.dayofyear("date")
    ocean = (F.col("lat_idx") * 10 + F.col("lon_idx") + day) % 7 != 0
    facts = cube.select(
        "date", "lat_idx", "lon_idx", F.col("chla").alias("y"), F.when(F.col("aux") >= 0.01, F.col("aux")).alias("aux"),
        F.when(day % 11 != 0, F.col("lat_idx").cast("double")).alias("row_no"), ocean.cast("double").alias("ocean_mask"),
    )
    pixels = cube.select("date").distinct().select("date", F.get(F.array(*[F.lit(n) for n in OCEAN_CELLS]), day % 7).alias("ocean"))
    return T.training_table(
        facts, ["aux"], ["row_no", "ocean_mask"], "y", "ocean_mask", pixels, missing_flags=True,
        max_frac_response=0.999, max_frac_inputs=0.999, stage=shared_dir(spark),
    )


@query("normalised_training_table", "L7 A15 A17 A18 F9 F10", f"""
WITH {_TABLE}
SELECT split, lat_idx, count(*) AS n, avg(f0) AS f0, avg(f1) AS f1, avg(f2) AS f2, avg(f3) AS f3, avg(CAST(CAST(y AS REAL) AS DOUBLE)) AS y FROM table_ GROUP BY 1, 2
""", doubles="f0 f1 f2 f3 y", digits=4)
def normalised_training_table(spark, d):
    table, names = training_rows(spark, d)
    means = [F.avg(F.get("features", F.lit(i)).cast("double")).alias(f"f{i}") for i in range(len(names))]
    return table.groupBy("split", "lat_idx").agg(F.count("*").alias("n"), *means, F.avg(F.col("y").cast("double")).alias("y"))


@query("valid_training_rows", "L8", f"""
WITH {_TABLE} SELECT split, count(*) AS n, avg(y) AS y FROM table_ WHERE ocean_mask GROUP BY 1
""", doubles="y", digits=4)
def valid_training_rows(spark, d):
    table, names = training_rows(spark, d)
    rows = T.valid_training_rows(table, names)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("y"))


# the same table with a static mask and a row for every ocean cell of the kept days
_STATIC = "(lat_idx * 10 + lon_idx) % 7 <> 0"
_GRID = P.SHIP_CUBE + f""", grid AS (SELECT CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx FROM range(20) AS a(i), range(36) AS b(j)),
wet AS (SELECT * FROM grid WHERE {_STATIC}),
facts AS (SELECT date, lat_idx, lon_idx, chla AS y, {GAPPY} AS aux, {_STATIC} AS ocean_mask FROM ship_cube),
seen AS (SELECT date, (SELECT count(*) FROM wet) AS o, count(CASE WHEN ocean_mask THEN y END) AS y, count(CASE WHEN ocean_mask THEN aux END) AS a FROM facts GROUP BY 1),
kept AS (SELECT date FROM seen WHERE o - least(y, a) < CAST(0.999 AS DOUBLE) * o), {SHUFFLED},
stored AS (SELECT f.*, s.split FROM facts AS f JOIN splits AS s USING (date)),
st AS (SELECT avg(aux) AS m, CASE WHEN stddev_pop(aux) = 0 THEN 1 ELSE stddev_pop(aux) END AS s FROM stored WHERE split = 'train'),
g AS (SELECT quantile_cont(aux, 0.5) AS ga FROM stored WHERE split = 'train' AND ocean_mask),
med AS (SELECT lat_idx, lon_idx, quantile_cont(CASE WHEN split = 'train' AND ocean_mask THEN aux END, 0.5) AS m1 FROM stored GROUP BY 1, 2),
wanted AS (SELECT s.date, s.split, w.lat_idx, w.lon_idx FROM splits AS s, wet AS w),
rows_ AS (SELECT coalesce(r.date, w.date) AS date, coalesce(r.lat_idx, w.lat_idx) AS lat_idx, coalesce(r.lon_idx, w.lon_idx) AS lon_idx,
 coalesce(r.split, w.split) AS split, coalesce(r.ocean_mask, true) AS ocean_mask, r.aux, r.y
 FROM wanted AS w FULL JOIN stored AS r ON r.date = w.date AND r.lat_idx = w.lat_idx AND r.lon_idx = w.lon_idx),
table_ AS (SELECT r.split, r.lat_idx, r.y, CAST(ocean_mask AS INT) AS f2, CAST(aux IS NULL AND ocean_mask AS INT) AS f1,
 CASE WHEN ocean_mask THEN (coalesce(aux, m1, (SELECT ga FROM g), 0) - st.m) / st.s ELSE 0 END AS f0
 FROM rows_ AS r LEFT JOIN med ON med.lat_idx = r.lat_idx AND med.lon_idx = r.lon_idx, st)"""


@query("ocean_training_table", "L7 P27 A18 F10", f"""
WITH {_GRID}
SELECT split, lat_idx, count(*) AS n, count(y) AS with_y, avg(f0) AS f0, avg(f1) AS f1, avg(f2) AS f2, avg(CAST(CAST(y AS REAL) AS DOUBLE)) AS y FROM table_ GROUP BY 1, 2
""", doubles="f0 f1 f2 y", digits=4)
def ocean_training_table(spark, d):
    ocean = P.is_ocean()
    facts = P.ship_cube(spark, d).select(
        "date", "lat_idx", "lon_idx", F.col("chla").alias("y"), F.when(F.col("aux") >= 0.01, F.col("aux")).alias("aux"),
        ocean.cast("double").alias("ocean_mask"),
    )
    grid = spark.range(P.SHIP_LAT.size * P.SHIP_LON.size).select(
        F.floor(F.col("id") / P.SHIP_LON.size).cast("int").alias("lat_idx"), (F.col("id") % P.SHIP_LON.size).cast("int").alias("lon_idx"),
    )
    table, names = T.training_table(
        facts, ["aux"], ["ocean_mask"], "y", "ocean_mask", missing_flags=True, max_frac_response=0.999, max_frac_inputs=0.999,
        stage=shared_dir(spark), runs=masks.encode_runs(grid.withColumn("ocean", ocean)),
    )
    means = [F.avg(F.get("features", F.lit(i)).cast("double")).alias(f"f{i}") for i in range(len(names))]
    return table.groupBy("split", "lat_idx").agg(
        F.count("*").alias("n"), F.count("y").alias("with_y"), *means, F.avg(F.col("y").cast("double")).alias("y")
    )


@query("capped_training_rows", "L6 L3", f"""
WITH {P.SHIP_CUBE}, keyed AS (SELECT *, CAST(date AS VARCHAR) || '/' || lat_idx || '/' || lon_idx AS k FROM ship_cube),
top AS (SELECT * FROM keyed ORDER BY {P.hash_sql('k')}, k LIMIT 5000)
SELECT lat_idx, count(*) AS n, avg(chla) AS chla FROM top GROUP BY 1
""", doubles="chla")
def capped_training_rows(spark, d):
    key = F.concat_ws("/", F.col("date").cast("string"), "lat_idx", "lon_idx")
    rows = T.capped_rows(P.ship_cube(spark, d).withColumn("k", key), "k", 5000)
    return rows.groupBy("lat_idx").agg(F.count("*").alias("n"), F.avg("chla").alias("chla"))
