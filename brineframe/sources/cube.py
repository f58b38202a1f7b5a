"""The product cube: one row per (date, lat_idx, lon_idx), partitioned by date.

Layout: ``<root>/cells/date=YYYY-MM-DD/*.parquet`` clustered by tile and sorted
by cell, plus small axis tables ``dim_time``, ``dim_z``, ``dim_lat``, ``dim_lon`` and an
attribute table. A reader gets partition pruning on the date and row-group pruning on
the cell indices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.axes import DepthAxis, RegularAxis, morton_key, tile_id
from ..operators.matchup import exact_day

CELL_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("lat_idx", T.IntegerType()),
    T.StructField("lon_idx", T.IntegerType()),
    T.StructField("chla", T.ArrayType(T.FloatType())),
    T.StructField("chla_surface", T.FloatType()),
    T.StructField("chla_int_0_200", T.FloatType()),
    T.StructField("chla_peak", T.FloatType()),
    T.StructField("chla_peak_depth", T.FloatType()),
    T.StructField("chla_depth_center_of_mass", T.FloatType()),
])


def create_cube(spark: SparkSession, root: str, lat: RegularAxis, lon: RegularAxis, axis: DepthAxis, days: DataFrame) -> None:
    """Write the axis tables and an empty, typed cell table. Cells that were never
    written are missing by definition, so no fill values are stored."""
    def write(df, name):
        df.write.mode("overwrite").parquet(f"{root}/{name}")

    for name, grid in (("lat", lat), ("lon", lon)):
        idx = spark.range(grid.size).select(F.col("id").cast("int").alias(f"{name}_idx"))
        write(idx.withColumn(name, grid.label(f"{name}_idx").cast("float")), f"dim_{name}")
    bins = list(zip(range(len(axis)), axis.centers, axis.starts, axis.ends, axis.thickness))
    write(spark.createDataFrame(bins, "z_idx int, z double, z_start double, z_end double, z_thickness double"), "dim_z")
    ordered = days.select("date").distinct().select(
        "date", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1).cast("int").alias("time_idx")
    )
    write(ordered, "dim_time")
    spark.createDataFrame([], CELL_SCHEMA).write.mode("overwrite").partitionBy("date").parquet(f"{root}/cells")


def read_cube(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(CELL_SCHEMA).parquet(f"{root}/cells")


def read_axis(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/dim_{name}")


ORDERS = ("rows", "morton")
MORTON_PAGE_ROWS = 1024


def arrange(df: DataFrame, n_lon: int, order: str = "rows") -> DataFrame:
    """Cluster by (date, tile) and sort by cell inside each task, by grid row or by Morton key.

    A tile holds at most 480 x 480 cells, so the unit is bounded and a large day is
    spread over many tasks. Hashing, unlike range partitioning, needs no sampling job,
    which would evaluate the (scored) input a second time.
    """
    tiled = df.withColumn("_tile", tile_id("lat_idx", "lon_idx", n_lon=n_lon))
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}")
    within = ["lat_idx", "lon_idx"] if order == "rows" else [morton_key("lat_idx", "lon_idx")]
    return tiled.repartition("date", "_tile").sortWithinPartitions("date", "_tile", *within).drop("_tile")


def write_days(df: DataFrame, root: str, n_lon: int, codec: str = "zstd", order: str = "rows") -> None:
    """Replace exactly the days present in ``df``; all other days stay as they are.

    ``order="morton"`` writes pages of 1,024 cells that are about 32 x 32 squares. Page indexes then
    let a point read one page of a day, and a small box the few pages it meets, where pages of grid rows
    hold two rows of a whole tile.
    """
    layered = df.withColumn("chla_surface", F.get("chla", F.lit(0)))
    ready = layered.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CELL_SCHEMA.fields])
    out = arrange(ready, n_lon, order).write.mode("overwrite")
    if order == "morton":
        out = out.option("parquet.page.row.count.limit", str(MORTON_PAGE_ROWS))
    (
        out.option("partitionOverwriteMode", "dynamic").option("compression", codec)
        .partitionBy("date").parquet(f"{root}/cells")
    )


def _partition(spark: SparkSession, root: str, day):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/cells/date={day}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def day_files(spark: SparkSession, root: str, days: list) -> dict:
    """Names of the stored files of each day: a listing of one partition per day."""
    out = {}
    for day in days:
        path, fs = _partition(spark, root, day)
        out[day] = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
    return out


def clear_days(spark: SparkSession, root: str, days: list) -> None:
    """Remove all cells of the days; dynamic overwrite leaves a day without new rows as it was."""
    for day in days:
        path, fs = _partition(spark, root, day)
        fs.delete(path, True)


def write_region(spark: SparkSession, df: DataFrame, root: str, n_lon: int, order: str = "rows") -> None:
    """Checked day replacement: every day must match exactly one entry of the time axis."""
    exact_day(df.select("date").distinct(), read_axis(spark, root, "time"))
    write_days(df, root, n_lon, order=order)


def write_attributes(attrs: DataFrame, root: str) -> None:
    """Store the attribute table (var, key, value) with the cube; "" stands for the cube itself."""
    attrs.select("var", "key", "value").coalesce(1).write.mode("overwrite").parquet(f"{root}/attributes")


def read_attributes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/attributes")


def pages_touched(spark: SparkSession, root: str, day, lat: tuple[int, int], lon: tuple[int, int]) -> tuple[int, int]:
    """(pages that may hold a cell of the box, all pages) of one day, from the page indexes of its files."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, fs = _partition(spark, root, day)
    little = jvm.java.nio.ByteOrder.LITTLE_ENDIAN

    def bounds(reader, chunk):
        index = reader.readColumnIndex(chunk)
        return [(a.order(little).getInt(0), b.order(little).getInt(0)) for a, b in zip(index.getMinValues(), index.getMaxValues())]

    hit = total = 0
    for status in fs.listStatus(path) if fs.exists(path) else []:
        if not status.getPath().getName().endswith(".parquet"):
            continue
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(status.getPath(), hadoop)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            for block in reader.getFooter().getBlocks():
                chunks = {c.getPath().toDotString(): c for c in block.getColumns()}
                pages = list(zip(bounds(reader, chunks["lat_idx"]), bounds(reader, chunks["lon_idx"])))
                total += len(pages)
                hit += sum(a <= lat[1] and b >= lat[0] and c <= lon[1] and d >= lon[0] for (a, b), (c, d) in pages)
        finally:
            reader.close()
    return hit, total
