"""Granule manifests: file listings as tables, search, bookkeeping of finished days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import date_token, like_glob, version_token


def parse_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds file name, date and version parsed from the path."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return files.withColumn("name", name).withColumns({"date": date_token("name"), "version": version_token("name")})


def list_files(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """Manifest of a folder tree; reads file metadata only, never contents."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    )
    return parse_names(files.select("path", "modificationTime", "length"))


def search(manifest: DataFrame, product: str | None = None, name: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Granules of a product whose name matches a glob and whose coverage overlaps the
    time range; an open end is None. A date as end means that whole day."""
    out = manifest
    if product is not None:
        out = out.where(F.col("product") == product)
    if name is not None:
        out = out.where(like_glob("name", name))
    if begin is not None:
        out = out.where(F.col("t_end") >= F.lit(begin).cast("timestamp"))
    if end is not None:
        limit = F.lit(end).cast("timestamp")
        if len(end) == 10:
            out = out.where(F.col("t_start") < limit + F.expr("interval 1 day"))
        else:
            out = out.where(F.col("t_start") <= limit)
    return out


def pending(manifest: DataFrame, done: DataFrame, key: str = "date", force: bool = False) -> DataFrame:
    """Work left: everything when forced, else what the done table lacks."""
    return manifest if force else manifest.join(done.select(key).distinct(), key, "left_anti")


def days_with_data(cube: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Days holding at least one non-missing value."""
    return cube.where(F.col(value).isNotNull()).select(date).distinct()


def missing_days(expected: DataFrame, actual: DataFrame, date: str = "date") -> DataFrame:
    return expected.select(date).distinct().join(actual.select(date).distinct(), date, "left_anti")


def day_status(expected: DataFrame, done: DataFrame, failed: DataFrame, date: str = "date") -> DataFrame:
    """One row per expected day: done, failed (with its message) or pending."""
    fails = failed.groupBy(date).agg(F.max("message").alias("message"))
    finished = done.select(date).distinct().withColumn("_done", F.lit(True))
    out = expected.select(date).distinct().join(finished, date, "left").join(fails, date, "left")
    status = F.when(F.col("_done"), "done").when(F.col("message").isNotNull(), "failed").otherwise("pending")
    return out.select(date, status.alias("status"), F.when(~F.coalesce("_done", F.lit(False)), F.col("message")).alias("message"))
