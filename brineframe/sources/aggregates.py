"""Aggregates of a versioned cube that follow its slices, so that maps and means do not scan the cube again.

Two tables beside the slices, of sums and counts (missing skipped) per value column:

* ``day_rows``: per (date, version), latitude row and block of ``width`` longitudes. A slice
  version never changes, so neither do its sums.
* ``month_cells``: per (month, signature) and cell. The signature is a hash of the month's
  current (date, version) pairs, so a replaced day makes its month new and no other.

``refresh`` computes what the current commits lack: the new slices, and the months they fall in,
from that month's slices alone. Its writes replace whole (date, version) and (month,
signature) folders and are marked when complete, so running it again after a failure gives the same tables. Readers join with the
commit table and see only sums of current slices; where some are not computed yet they raise
an error instead of leaving days out. Each choice of value columns (and width) has tables of its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.axes import RegularAxis
from ..functions.features import month_floor
from ..operators.gridagg import monthly_mean
from .versions import SLICES, current_versions, read_ledger

WIDTH = 480


def _schema(values: list[str], keys: list[tuple[str, T.DataType]]) -> T.StructType:
    sums = [(f"{k}_{v}", t) for v in values for k, t in (("n", T.LongType()), ("sum", T.DoubleType()))]
    return T.StructType([T.StructField(n, t) for n, t in [*keys, *sums]])


def day_schema(values: list[str]) -> T.StructType:
    return _schema(values, [("date", T.DateType()), ("version", T.StringType()), ("lat_idx", T.IntegerType()), ("lon_block", T.IntegerType())])


def month_schema(values: list[str]) -> T.StructType:
    return _schema(values, [("month", T.DateType()), ("signature", T.StringType()), ("lat_idx", T.IntegerType()), ("lon_idx", T.IntegerType())])


def _sums(values: list[str]) -> list:
    return [c for v in values for c in (F.count(v).alias(f"n_{v}"), F.sum(F.col(v).cast("double")).alias(f"sum_{v}"))]


def current_months(current: DataFrame) -> DataFrame:
    """(month, signature) of the current days; a month has at most 31."""
    days = F.sort_array(F.collect_list(F.concat_ws("/", F.col("date").cast("string"), "version")))
    return current.groupBy(month_floor("date").alias("month")).agg(F.md5(F.concat_ws(",", days)).alias("signature"))


def _write(df: DataFrame, path: str, schema: T.StructType, *by: str) -> None:
    named = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    named.repartition(*by, "lat_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _place(root: str, table: str, values: list[str], width: int | None) -> str:
    return f"{root}/sums/{table}-" + hashlib.md5(f"{sorted(values)} {width}".encode()).hexdigest()[:12]


def _missing(wanted: DataFrame, place: str) -> DataFrame:
    """The wanted (day or month, state) pairs that are not marked as complete; marks also stand for slices without a cell."""
    spark = wanted.sparkSession
    spark.createDataFrame([], wanted.schema).write.mode("append").parquet(f"{place}-done")
    return wanted.join(spark.read.schema(wanted.schema).parquet(f"{place}-done"), wanted.columns, "left_anti")


def refresh(spark: SparkSession, root: str, values: list[str], width: int = WIDTH) -> tuple[int, int]:
    """Compute the sums that current slices lack; how many days and months that were."""
    current = current_versions(read_ledger(spark, root)).select("date", "version")
    # the calendar: one short row per day; what is open is fixed before anything is written
    days = [tuple(r) for r in current.collect()]
    if not days:
        return 0, 0
    current = spark.createDataFrame(days, "date date, version string")
    months = current_months(current)
    slices = spark.read.schema(SLICES).parquet(f"{root}/slices").select("date", "version", "lat_idx", "lon_idx", *values)
    counts = []
    for table, wanted, schema, size in (("day_rows", current, day_schema(values), width), ("month_cells", months, month_schema(values), None)):
        (key, by), place = wanted.columns, _place(root, table, values, size)
        todo = [tuple(r) for r in _missing(wanted, place).collect()]
        counts.append(len(todo))
        if not todo:
            continue
        open_ = spark.createDataFrame(todo, f"{key} date, {by} string")
        if table == "day_rows":
            mine = slices.join(F.broadcast(open_), ["date", "version"], "left_semi")
            sums = mine.groupBy("date", "version", "lat_idx", F.floor(F.col("lon_idx") / F.lit(width)).cast("int").alias("lon_block")).agg(*_sums(values))
        else:
            days_ = current.withColumn("month", month_floor("date")).join(open_, "month")
            mine = slices.join(F.broadcast(days_), ["date", "version"])
            sums = mine.groupBy("month", "signature", "lat_idx", "lon_idx").agg(*_sums(values))
        _write(sums, place, schema, key, by)
        open_.coalesce(1).write.mode("append").parquet(f"{place}-done")
    return counts[0], counts[1]


def _read(wanted: DataFrame, place: str, schema: T.StructType) -> DataFrame:
    open_ = _missing(wanted, place).count()
    if open_:
        raise ValueError(f"{open_} days or months are not computed yet: refresh first")
    spark = wanted.sparkSession
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*wanted.columns).parquet(place)
    return spark.read.schema(schema).parquet(place).join(F.broadcast(wanted), wanted.columns, "left_semi")  # one row per day or month


def read_day_rows(spark: SparkSession, root: str, values: list[str], width: int = WIDTH) -> DataFrame:
    """Sums and counts of the current slices by (date, lat_idx, lon_block)."""
    current = current_versions(read_ledger(spark, root)).select("date", "version")
    return _read(current, _place(root, "day_rows", values, width), day_schema(values)).drop("version")


def read_month_cells(spark: SparkSession, root: str, values: list[str]) -> DataFrame:
    """Sums and counts of the current slices by (month, lat_idx, lon_idx)."""
    months = current_months(current_versions(read_ledger(spark, root)).select("date", "version"))
    return _read(months, _place(root, "month_cells", values, None), month_schema(values)).drop("signature")


def pooled(df: DataFrame, values: list[str], *keys: str) -> DataFrame:
    """Means by the keys from sums and counts; missing where nothing was counted."""
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(f"sum_{v}"), F.sum(f"n_{v}")).alias(v) for v in values])


def daily_means(rows: DataFrame, values: list[str]) -> DataFrame:
    """Unweighted mean of the cells of every day; restrict ``rows`` to latitude rows and blocks first for a box."""
    return pooled(rows, values, "date")


def mean_of_daily_means(rows: DataFrame, values: list[str]) -> DataFrame:
    """Spatial mean per day, then the mean of the days per month."""
    return monthly_mean(daily_means(rows, values), values)


def monthly_map(cells: DataFrame, values: list[str]) -> DataFrame:
    """Mean of every cell and month that has a slice; one row of sums per cell, nothing to shuffle."""
    return cells.select("month", "lat_idx", "lon_idx", *[F.try_divide(f"sum_{v}", f"n_{v}").alias(v) for v in values])


def zonal_profile(cells: DataFrame, value: str, lon: RegularAxis, lon_range: tuple) -> DataFrame:
    """Monthly map per cell, then the mean over the longitudes of a band, by latitude."""
    band = monthly_map(cells.where(lon.within("lon_idx", *lon_range)), [value])
    return band.groupBy("month", "lat_idx").agg(F.avg(value).alias(value))
