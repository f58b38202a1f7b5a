"""Versioned day slices: every replacement of a day is written beside the old one and switched by one commit row.

Layout: ``<root>/slices/date=.../version=.../*.parquet`` and the append-only commit table ``<root>/ledger``.
A day's current slice is the version of its newest row with status "done". The row is
appended after the slice is complete, so a reader sees the old slice or the new one, never parts
of both, and a reader that began before goes on with the files it knows. ``vacuum`` deletes slices
that are no longer current, when nobody reads them any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .cube import CELL_SCHEMA, arrange

LEDGER = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("delivery", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("version", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
])
SLICES = T.StructType([*CELL_SCHEMA.fields, T.StructField("version", T.StringType())])


def prepare_store(spark: SparkSession, root: str) -> None:
    """An empty slice table and commit table, where there are none yet."""
    spark.createDataFrame([], SLICES).write.mode("append").partitionBy("date", "version").parquet(f"{root}/slices")
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(f"{root}/ledger")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def current_versions(ledger: DataFrame) -> DataFrame:
    """(date, version, delivery, sequence) of the newest finished commit of every day."""
    done = ledger.where(F.col("status") == "done")
    newest = F.max_by(F.struct("version", "delivery", "sequence"), "sequence").alias("c")
    return done.groupBy("date").agg(newest).select("date", "c.version", "c.delivery", "c.sequence")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The current slice of every day, as cells."""
    current = current_versions(read_ledger(spark, root)).select("date", "version")
    slices = spark.read.schema(SLICES).parquet(f"{root}/slices")
    return slices.join(F.broadcast(current), ["date", "version"], "left_semi").select(*CELL_SCHEMA.names)  # one row per calendar day


def write_slices(df: DataFrame, root: str, n_lon: int, codec: str = "zstd") -> str:
    """Write the days of ``df`` as slices of a new version, which no reader sees before it is committed."""
    version = uuid.uuid4().hex
    layered = df.withColumn("chla_surface", F.get("chla", F.lit(0)))
    ready = layered.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CELL_SCHEMA.fields])
    arranged = arrange(ready, n_lon).withColumn("version", F.lit(version))
    arranged.write.mode("append").option("compression", codec).partitionBy("date", "version").parquet(f"{root}/slices")
    return version


def commit(rows: DataFrame, root: str) -> None:
    """Append commit rows, columns by name."""
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER.fields]).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the slices that are not current; how many were deleted. One listing per day."""
    current = {(str(r["date"]), r["version"]) for r in current_versions(read_ledger(spark, root)).select("date", "version").toLocalIterator()}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/slices")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for day in fs.listStatus(path):
        name = day.getPath().getName()
        for slice_ in fs.listStatus(day.getPath()) if name.startswith("date=") else ():
            if (name.removeprefix("date="), slice_.getPath().getName().removeprefix("version=")) not in current:
                gone += bool(fs.delete(slice_.getPath(), True))
    return gone
