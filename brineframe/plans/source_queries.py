"""Scans, manifests, bookkeeping, the published cube and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.axes import RegularAxis
from ..operators import columns, matchup, selection
from ..session import shared_dir
from ..sources import aggregates, attributes, catalog, cube as store, manifest as M, versions
from ..sources.tables import read_aligned, read_parquet, staged
from ..streaming.ingest import ingest
from . import proxies as P
from .grid_queries import METRICS, metrics
from .registry import query


@query("pruned_profile_scan", "S1", """
SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS chla FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1
""", doubles="chla")
def pruned_profile_scan(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_returnflag", "l_quantity", "l_shipdate"])
    recent = li.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return recent.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("chla"))


@query("single_day_grid", "S2", f"""
WITH {P.CUBE_LONG} SELECT lat_idx, lon_idx, z_idx, chla FROM cube_long WHERE date = DATE '2024-01-15'
""", doubles="chla")
def single_day_grid(spark, d):
    day = selection.days_between(P.cube_long(spark, d), "2024-01-15", "2024-01-15")
    return day.select("lat_idx", "lon_idx", "z_idx", "chla")


@query("aligned_daily_sets", "S3 U1 U2", f"""
WITH {P.CUBE_METRICS}
SELECT date, count(*) AS cells, count(CASE WHEN day(date) % 2 = 1 THEN chla_int END) AS with_integral, avg(chla_peak) AS chla_peak FROM cube_metrics GROUP BY 1
""", doubles="chla_peak", texts="date")
def aligned_daily_sets(spark, d):
    cells = metrics(spark, d)
    odd = cells.where(F.dayofmonth("date") % 2 == 1).select("date", "lat_idx", "lon_idx", "chla_peak", "chla_int_0_200")
    even = cells.where(F.dayofmonth("date") % 2 == 0).select("date", "lat_idx", "lon_idx", "chla_peak")
    both = selection.stack_sources(odd, even, allow_missing=True)
    return both.groupBy("date").agg(
        F.count("*").alias("cells"), F.count("chla_int_0_200").alias("with_integral"), F.avg("chla_peak").alias("chla_peak")
    )


@query("aligned_product_files", "S3 U1 U2", f"""
WITH {P.CUBE_METRICS}
SELECT date, count(*) AS cells, count(CASE WHEN day(date) % 2 = 1 THEN chla_int END) AS with_integral, avg(chla_peak) AS chla_peak FROM cube_metrics GROUP BY 1
""", doubles="chla_peak", texts="date", digits=5)
def aligned_product_files(spark, d):
    """Files of two products with different variables, written by day and read as one checked dataset."""
    root = shared_dir(spark)
    cells = staged(metrics(spark, d).select("date", "lat_idx", "lon_idx", "chla_peak", "chla_int_0_200"), f"{root}/cells")
    odd = F.dayofmonth("date") % 2 == 1
    for name, part in (("full", cells.where(odd)), ("peak", cells.where(~odd).drop("chla_int_0_200"))):
        part.repartition("date").write.partitionBy("date").parquet(f"{root}/{name}")
    both = read_aligned(spark, [f"{root}/full"], [f"{root}/peak"])
    return both.groupBy("date").agg(
        F.count("*").alias("cells"), F.count("chla_int_0_200").alias("with_integral"), F.avg("chla_peak").alias("chla_peak")
    )


def _files(spark, d):
    """Product file names, one or two versions per day of the table."""
    day = F.date_format("date", "yyyyMMdd")
    name = F.concat(F.lit("s3/prefix/chla_z_"), day, F.when(F.dayofmonth("date") % 3 == 0, "_v2.parquet").otherwise(".parquet"))
    return P.days(spark, d).select(name.alias("path"))


@query("granule_manifest", "S5 F12", f"""
WITH {P.DAYS}
SELECT 's3/prefix/' || n AS path, n AS name, date, CASE WHEN day(date) % 3 = 0 THEN 'v2' ELSE 'v1' END AS version FROM (
 SELECT date, 'chla_z_' || strftime(date, '%Y%m%d') || CASE WHEN day(date) % 3 = 0 THEN '_v2.parquet' ELSE '.parquet' END AS n FROM days) AS t
""", texts="date")
def granule_manifest(spark, d):
    return M.parse_names(_files(spark, d))


def _product_manifest(spark, d):
    """Granule windows as a searchable manifest with two products."""
    granules = P.manifest(spark, d).withColumns({
        "t_start": F.col("t_start").cast("timestamp"), "t_end": F.col("t_end").cast("timestamp"),
    })
    product = F.when(F.dayofmonth("date") % 2 == 0, "RRS").otherwise("CHL")
    return granules.select(product.alias("product"), F.col("granule").alias("name"), "t_start", "t_end")


@query("granule_search", "S6", f"""
WITH {P.MANIFEST}
SELECT 'RRS' AS product, granule AS name, CAST(t_start AS DATE) AS date FROM manifest
WHERE day(date) % 2 = 0 AND granule LIKE 'PACE\\_2024010%.nc' ESCAPE '\\'
 AND t_end >= TIMESTAMP '2024-01-03 06:00:00' AND t_start < TIMESTAMP '2024-01-08 00:00:00'
""", texts="date")
def granule_search(spark, d):
    found = M.search(_product_manifest(spark, d), "RRS", "PACE_2024010?.nc", "2024-01-03 06:00:00", "2024-01-07")
    return found.select("product", "name", F.col("t_start").cast("date").alias("date"))


@query("open_ended_search", "S6", f"""
WITH {P.MANIFEST} SELECT granule AS name FROM manifest WHERE day(date) % 2 = 1 AND t_end >= TIMESTAMP '2024-01-20 00:00:00'
""")
def open_ended_search(spark, d):
    return M.search(_product_manifest(spark, d), product="CHL", begin="2024-01-20").select("name")


@query("granules_in_point_span", "S16", f"""
WITH {P.MANIFEST}, span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'signup')
SELECT granule FROM manifest, span WHERE t_start <= hi AND t_end >= lo
""")
def granules_in_point_span(spark, d):
    pts = P.events(spark, d, "ts", "event_type").where("event_type = 'signup'").withColumnRenamed("ts", "time")
    return matchup.granules_in_span(P.manifest(spark, d), pts).select("granule")


_DONE = "done AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE value > 300)"


def _done(spark, d):
    high = P.cube_samples(spark, d).where(F.col("chla") > 300)
    return M.days_with_data(high, "chla")


@query("pending_days", "S10 J10", f"""
WITH {P.DAYS}, {_DONE} SELECT date FROM days WHERE date NOT IN (SELECT date FROM done)
""", texts="date")
def pending_days(spark, d):
    return M.pending(P.days(spark, d), _done(spark, d))


@query("missing_days", "S11 U3 U4", f"""
WITH {P.DAYS}, {_DONE} SELECT date FROM days EXCEPT SELECT date FROM done
""", texts="date")
def missing_days(spark, d):
    return M.missing_days(P.days(spark, d), _done(spark, d))


@query("day_status", "S15", f"""
WITH {P.DAYS}, {_DONE}, failed AS (SELECT CAST(ts AS DATE) AS date, max('error at ' || user_id) AS message FROM events WHERE event_type = 'error' AND value > 180 GROUP BY 1)
SELECT days.date, CASE WHEN done.date IS NOT NULL THEN 'done' WHEN message IS NOT NULL THEN 'failed' ELSE 'pending' END AS status,
 CASE WHEN done.date IS NULL THEN message END AS message
FROM days LEFT JOIN done ON done.date = days.date LEFT JOIN failed ON failed.date = days.date
""", texts="date")
def day_status(spark, d):
    errors = read_parquet(spark, f"{d}/events.parquet", columns=["ts", "event_type", "value", "user_id"], where="event_type = 'error' AND value > 180")
    failed = errors.select(F.col("ts").cast("date").alias("date"), F.concat(F.lit("error at "), "user_id").alias("message"))
    return M.day_status(P.days(spark, d), _done(spark, d), failed)


@query("catalog_upsert", "S14", """
WITH new AS (SELECT o_custkey * 2 AS item_id, max(o_totalprice) AS value FROM orders GROUP BY 1),
old AS (SELECT c_custkey AS item_id, c_acctbal AS value, CAST(c_custkey % 3 AS INT) AS generation FROM customer)
SELECT old.item_id, old.value, old.generation FROM old WHERE old.item_id NOT IN (SELECT item_id FROM new)
UNION ALL SELECT new.item_id, new.value, coalesce(old.generation, 3) FROM new LEFT JOIN old ON old.item_id = new.item_id
""", doubles="value", digits=2)
def catalog_upsert(spark, d):
    customer = read_parquet(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_acctbal"])
    old = customer.select(
        F.col("c_custkey").alias("item_id"), F.col("c_acctbal").alias("value"), (F.col("c_custkey") % 3).cast("int").alias("generation")
    )
    orders = read_parquet(spark, f"{d}/orders.parquet", columns=["o_custkey", "o_totalprice"])
    new = orders.groupBy((F.col("o_custkey") * 2).alias("item_id")).agg(F.max("o_totalprice").alias("value"))
    return catalog.upsert(old, new, "item_id")


@query("attribute_defaults", "S12 F15", """
WITH attrs AS (SELECT 'v' || p_partkey AS var, 'type' AS key, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END AS value FROM part
 UNION ALL SELECT 'v' || p_partkey, 'brand', p_brand FROM part),
defaults AS (SELECT 'v' || p_partkey AS var, 'type' AS key, 'STANDARD' AS value FROM part)
SELECT coalesce(a.var, b.var) AS var, coalesce(a.key, b.key) AS key, coalesce(CASE WHEN trim(a.value) <> '' THEN a.value END, b.value) AS value
FROM attrs AS a FULL JOIN defaults AS b ON a.var = b.var AND a.key = b.key WHERE coalesce(a.key, b.key) <> 'brand'
""")
def attribute_defaults(spark, d):
    part = read_parquet(spark, f"{d}/part.parquet", columns=["p_partkey", "p_size", "p_type", "p_brand"])
    var = F.concat(F.lit("v"), "p_partkey").alias("var")
    blank = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type"))
    types = part.select(var, F.lit("type").alias("key"), blank.alias("value"))
    brands = part.select(var, F.lit("brand").alias("key"), F.col("p_brand").alias("value"))
    defaults = part.select(var, F.lit("type").alias("key"), F.lit("STANDARD").alias("value"))
    return attributes.drop_keys(attributes.fill_defaults(types.unionByName(brands), defaults), ["brand"])


_REAL = ", ".join(f"CAST({m} AS REAL) AS {m}" for m in METRICS)
_PUBLISHED = f"""
WITH {P.CUBE_METRICS}, m AS (SELECT date, lat_idx, lon_idx, chla_int AS chla_int_0_200, chla_peak, chla_peak_depth, chla_com AS chla_depth_center_of_mass FROM cube_metrics)
SELECT date, lat_idx, lon_idx, {_REAL} FROM m"""


@query("published_cube_round_trip", "S4 S7 S8 S9 J7", _PUBLISHED, doubles=" ".join(METRICS), texts="date", digits=3)
def published_cube_round_trip(spark, d):
    root = shared_dir(spark)
    # the axis tables need a plain size: one value from one column
    n_lat = P.events(spark, d, "user_id").agg(F.floor(F.max("user_id") / 10) + 1).first()[0]
    store.create_cube(spark, root, RegularAxis(70.0, -1.0, int(n_lat)), P.CUBE_LON, P.CUBE_AXIS, P.days(spark, d))
    store.write_region(spark, metrics(spark, d), root, n_lon=10)
    return store.read_cube(spark, root).select("date", "lat_idx", "lon_idx", *METRICS)


_COVERAGE = """
WITH c AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b, floor(max(user_id) / 10) AS bottom, floor(min(user_id) / 10) AS top,
 min(user_id % 10) AS west, max(user_id % 10) AS east FROM events)
SELECT '' AS var, 'title' AS key, 'Depth profiles' AS value
UNION ALL SELECT '', 'time_coverage_start', CAST(a AS VARCHAR) FROM c
UNION ALL SELECT '', 'time_coverage_end', CAST(b AS VARCHAR) FROM c
UNION ALL SELECT '', 'geospatial_lat_min', CAST(CAST(70.0 - bottom AS DOUBLE) AS VARCHAR) FROM c
UNION ALL SELECT '', 'geospatial_lat_max', CAST(CAST(70.0 - top AS DOUBLE) AS VARCHAR) FROM c
UNION ALL SELECT '', 'geospatial_lon_min', CAST(CAST(-180.0 + 36.0 * west AS DOUBLE) AS VARCHAR) FROM c
UNION ALL SELECT '', 'geospatial_lon_max', CAST(CAST(-180.0 + 36.0 * east AS DOUBLE) AS VARCHAR) FROM c
UNION ALL SELECT var, key, value FROM (VALUES
 {fixed}) AS t(var, key, value)
"""


def _fixed_rows():
    kept = {v: e for v, e in attributes.VARIABLE_ATTRIBUTES.items() if v != "z_thickness"}
    rows = [(v, k, "mg/m3" if (v, k) == ("chla_peak", "units") else x) for v, e in kept.items() for k, x in e.items()]
    return ", ".join("('" + "', '".join(r) + "')" for r in rows)


@query("published_attributes", "S12 S8", _COVERAGE.format(fixed=_fixed_rows()))
def published_attributes(spark, d):
    """Given, default and derived attributes stored with the cube, put on its columns, written and read back with a table."""
    root = shared_dir(spark)
    given = attributes.attribute_table(spark, {
        "": {"title": "Depth profiles", "history": "draft", "time_coverage_end": " "},
        "chla_peak": {"units": "mg/m3", "long_name": " "},
    })
    known = {v: e for v, e in attributes.VARIABLE_ATTRIBUTES.items() if v in store.CELL_SCHEMA.names}
    full = attributes.fill_defaults(given, attributes.attribute_table(spark, known))
    cells = P.cube_samples(spark, d).select("date", "lat_idx", "lon_idx")
    full = attributes.override(full, attributes.coverage(cells, P.cube_lat(spark, d), P.CUBE_LON))
    store.write_attributes(attributes.drop_keys(full, ["history"]), root)
    back = store.read_attributes(spark, root)
    named = attributes.attach(metrics(spark, d), attributes.as_dict(back))
    named.select("date", *known).write.parquet(f"{root}/named")
    return back.where("var = ''").unionByName(attributes.attached(spark.read.parquet(f"{root}/named")))


_BOX = (0, 6), (2, 6)


@query("morton_box_and_point", "S4 S7 P9 P10", f"""
WITH {P.CUBE_METRICS}
SELECT date, count(*) AS cells, avg(CAST(CAST(chla_peak AS REAL) AS DOUBLE)) AS chla_peak,
 max(CASE WHEN lat_idx = 1 AND lon_idx = 3 THEN CAST(chla_peak AS REAL) END) AS at_point
FROM cube_metrics WHERE lat_idx BETWEEN 0 AND 6 AND lon_idx BETWEEN 2 AND 6 GROUP BY 1
""", doubles="chla_peak at_point", texts="date", digits=4)
def morton_box_and_point(spark, d):
    """A box of all days with a point series in it, from a cube in Morton order."""
    root = shared_dir(spark)
    store.write_days(metrics(spark, d), root, n_lon=10, order="morton")
    (a, b), (w, e) = _BOX
    box = store.read_cube(spark, root).where(F.col("lat_idx").between(a, b) & F.col("lon_idx").between(w, e))
    point = (F.col("lat_idx") == 1) & (F.col("lon_idx") == 3)
    return box.groupBy("date").agg(
        F.count("*").alias("cells"), F.avg(F.col("chla_peak").cast("double")).alias("chla_peak"), F.max(F.when(point, F.col("chla_peak"))).alias("at_point")
    )


def _cells(rows):
    arrays = columns.depth_arrays(P.locate(rows), ["date", "lat_idx", "lon_idx"], P.CUBE_BINS)
    return columns.column_metrics(arrays, P.CUBE_AXIS)


def _stream(spark, landing, root, schema, progress="progress", **kw):
    """One run of the ingest over a landing folder of events."""
    ingest(
        spark, landing, schema, _cells, f"{root}/store", f"{root}/{progress}", n_lon=10,
        prepare=lambda rows: rows.withColumn("date", F.col("ts").cast("date")), **kw,
    )
    return versions.read_current(spark, f"{root}/store").select("date", "lat_idx", "lon_idx", *METRICS)


@query("streamed_cube_round_trip", "T1 S9 S10", _PUBLISHED, doubles=" ".join(METRICS), texts="date", digits=3)
def streamed_cube_round_trip(spark, d):
    """The events table as landed granules, ingested as a stream into a new cube."""
    source = f"{d}/events.parquet"
    return _stream(spark, source, shared_dir(spark), spark.read.parquet(source).schema)


@query("streamed_many_part_files", "T1 S9 S15", _PUBLISHED, doubles=" ".join(METRICS), texts="date", digits=3)
def streamed_many_part_files(spark, d):
    """One delivery in eight files that all span all days, landing over several batches."""
    root = shared_dir(spark)
    events = read_parquet(spark, f"{d}/events.parquet")
    events.repartition(8, "event_id").write.parquet(f"{root}/landing")
    return _stream(spark, f"{root}/landing", root, events.schema, files_per_batch=3)


_REDELIVERED = _PUBLISHED.replace("FROM events", "FROM (SELECT * REPLACE (CASE WHEN day(ts) % 3 = 0 THEN value * 2 ELSE value END AS value) FROM events)")


@query("streamed_redelivery", "T2 S9 S10", _REDELIVERED, doubles=" ".join(METRICS), texts="date", digits=3)
def streamed_redelivery(spark, d):
    """A second delivery of some days replaces those days and no others; without force it would be skipped."""
    root = shared_dir(spark)
    events = read_parquet(spark, f"{d}/events.parquet")
    named = {"delivery": F.element_at(F.split("_file", "/"), -2)}
    events.repartition(3, "event_id").write.parquet(f"{root}/landing/first")
    _stream(spark, f"{root}/landing", root, events.schema, **named)
    again = events.where(F.dayofmonth("ts") % 3 == 0).withColumn("value", F.col("value") * 2)
    again.repartition(2, "event_id").write.parquet(f"{root}/landing/second")
    return _stream(spark, f"{root}/landing", root, events.schema, force=True, **named)


@query("streamed_late_part_of_old_delivery", "T1 T2 S9 S10", _REDELIVERED, doubles=" ".join(METRICS), texts="date", digits=3)
def streamed_late_part_of_old_delivery(spark, d):
    """A late file of a delivery that a newer one has replaced changes nothing, by force neither; a late file of the current one counts."""
    root = shared_dir(spark)
    events = read_parquet(spark, f"{d}/events.parquet")
    named = {"delivery": F.element_at(F.split("_file", "/"), -2)}
    late = F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0
    events.where(~late).repartition(2, "event_id").write.parquet(f"{root}/landing/first")
    _stream(spark, f"{root}/landing", root, events.schema, **named)
    again = events.where(F.dayofmonth("ts") % 3 == 0).withColumn("value", F.col("value") * 2)
    again.where(~late).write.parquet(f"{root}/landing/second")
    _stream(spark, f"{root}/landing", root, events.schema, force=True, **named)
    events.where(late).coalesce(1).write.mode("append").parquet(f"{root}/landing/first")
    _stream(spark, f"{root}/landing", root, events.schema, force=True, **named)
    again.where(late).coalesce(1).write.mode("append").parquet(f"{root}/landing/second")
    return _stream(spark, f"{root}/landing", root, events.schema, **named)


@query("streamed_new_checkpoint", "T1 S10 S11", f"""
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)
SELECT date, 'done' AS status, CAST(1 AS BIGINT) AS commits FROM days
""", texts="date")
def streamed_new_checkpoint(spark, d):
    """Commits of each day after two runs with checkpoints of their own: finished days are skipped."""
    root, source = shared_dir(spark), f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    _stream(spark, source, root, schema)
    _stream(spark, source, root, schema, progress="another")
    ledger = versions.read_ledger(spark, f"{root}/store")
    return ledger.groupBy("date", "status").agg(F.count("*").alias("commits"))


BLOCK = 4  # longitudes
_DAYS = "WITH cells AS (" + _REDELIVERED.strip() + "), "
_DAILY = ", ".join(f"avg(CAST({m} AS DOUBLE)) AS {m}" for m in METRICS)


def _kept(spark, d):
    """Ingest, sums, a second delivery of some days, sums again: where the store lies."""
    root = shared_dir(spark)
    events = read_parquet(spark, f"{d}/events.parquet")
    named = {"delivery": F.element_at(F.split("_file", "/"), -2)}
    events.repartition(3, "event_id").write.parquet(f"{root}/landing/first")
    _stream(spark, f"{root}/landing", root, events.schema, **named)
    aggregates.refresh(spark, f"{root}/store", METRICS, BLOCK)
    again = events.where(F.dayofmonth("ts") % 3 == 0).withColumn("value", F.col("value") * 2)
    again.repartition(2, "event_id").write.parquet(f"{root}/landing/second")
    _stream(spark, f"{root}/landing", root, events.schema, force=True, **named)
    aggregates.refresh(spark, f"{root}/store", METRICS, BLOCK)
    return f"{root}/store"


@query("kept_daily_means", "A7 A26 T2 S9", _DAYS + f"d AS (SELECT date, {_DAILY} FROM cells GROUP BY 1) SELECT * FROM d", doubles=" ".join(METRICS), texts="date", digits=3)
def kept_daily_means(spark, d):
    """Daily means from sums that followed a redelivery; the cube is not read."""
    return aggregates.daily_means(aggregates.read_day_rows(spark, _kept(spark, d), METRICS, BLOCK), METRICS)


@query("kept_mean_of_daily_means", "A9 A26 T2 S9", _DAYS + f"""d AS (SELECT date, {_DAILY} FROM cells GROUP BY 1),
m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM d GROUP BY 1) SELECT * FROM m
""", doubles=" ".join(METRICS), texts="month", digits=3)
def kept_mean_of_daily_means(spark, d):
    return aggregates.mean_of_daily_means(aggregates.read_day_rows(spark, _kept(spark, d), METRICS, BLOCK), METRICS)


@query("kept_monthly_map", "A8 T2 S9", _DAYS + f"""m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, lat_idx, lon_idx, {_DAILY} FROM cells GROUP BY 1, 2, 3) SELECT * FROM m
""", doubles=" ".join(METRICS), texts="month", digits=3)
def kept_monthly_map(spark, d):
    return aggregates.monthly_map(aggregates.read_month_cells(spark, _kept(spark, d), METRICS), METRICS)


@query("kept_zonal_profile", "A10 T2 S9", _DAYS + """m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, lat_idx, lon_idx, avg(CAST(chla_int_0_200 AS DOUBLE)) AS v
 FROM cells WHERE lon_idx BETWEEN 2 AND 6 GROUP BY 1, 2, 3)
SELECT month, lat_idx, avg(v) AS chla_int_0_200 FROM m GROUP BY 1, 2
""", doubles="chla_int_0_200", texts="month", digits=3)
def kept_zonal_profile(spark, d):
    cells = aggregates.read_month_cells(spark, _kept(spark, d), METRICS)
    return aggregates.zonal_profile(cells, "chla_int_0_200", P.CUBE_LON, (-108, 36))
