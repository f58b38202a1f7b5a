"""Table scans with the missing-value rule applied at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.missing import clean_floats
from ..operators.quality import assert_cells_unique, assert_unique


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """Column-pruned Parquet scan; NaN becomes NULL.

    ``where`` is applied to the stored columns, so that it reaches the scan and skips row
    groups, and again after the clean-up, because a NaN passes a comparison that NULL does not.
    """
    df = spark.read.parquet(*paths)
    if where is not None:
        df = clean_floats(df.where(where)).where(where)
        return df.select(*columns) if columns else df
    return clean_floats(df.select(*columns) if columns else df)


def read_aligned(spark: SparkSession, *groups: list[str], keys: tuple[str, ...] = ("date", "lat_idx", "lon_idx"), check: bool = True) -> DataFrame:
    """Many daily files as one dataset, aligned by name; absent variables are missing.

    With ``check`` a (date, cell) stored twice is an error. For the usual keys that takes one bit
    per cell in the shuffle, for others the keys themselves.
    """
    out = None
    for paths in groups:
        part = read_parquet(spark, *paths)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if not check:
        return out
    return assert_cells_unique(out) if keys == ("date", "lat_idx", "lon_idx") else assert_unique(out, list(keys))


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate that several passes read, and continue from the files.

    The path lies in the cluster's shared folder, so a lost executor costs nothing.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 1 << 20  # of a grouping whose groups grow with the input


def dealt(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt by key into as many tasks as their number asks for; unchanged where the session's
    shuffle partitions suffice.

    Groupings by the keys (or more columns) then need no shuffle of their own, and the memory of one of their tasks
    does not grow with the input. All rows of a key meet in one task: meant for keys with few rows.
    """
    parts = -(-df.count() // rows_per_task)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
