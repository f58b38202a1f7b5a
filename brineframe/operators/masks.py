"""Ocean masks as runs of cells, and the grid that they stand for.

A run is ``lat_idx, first_lon, last_lon``, with ``date`` where the mask changes by day. A coast
line cuts a grid row into few runs, so a mask of millions of cells is a table of some thousand
rows, and the cells of a day come from exploding its runs beside the data, not from a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELL = ["lat_idx", "lon_idx"]


def encode_runs(mask: DataFrame, ocean: str = "ocean", date: str = "date") -> DataFrame:
    """Runs of neighbouring ocean cells of each grid row (and day, if the mask has days).

    A window holds one grid row of one day, bounded by the axis. A missing flag is land; a
    cell that is given twice counts once.
    """
    row = ([date] if date in mask.columns else []) + ["lat_idx"]
    wet = mask.where(F.col(ocean).cast("boolean")).select(*row, "lon_idx").distinct()
    island = F.col("lon_idx") - F.row_number().over(W.partitionBy(*row).orderBy("lon_idx"))
    runs = wet.withColumn("_island", island).groupBy(*row, "_island")
    return runs.agg(F.min("lon_idx").alias("first_lon"), F.max("lon_idx").alias("last_lon")).drop("_island")


def ocean_cells(runs: DataFrame) -> DataFrame:
    """The cells of the runs (per day, if the runs have days)."""
    cells = F.explode(F.sequence("first_lon", "last_lon")).alias("lon_idx")
    return runs.select(*[c for c in runs.columns if c not in ("first_lon", "last_lon")], cells)


def ocean_pixels(runs: DataFrame, date: str = "date") -> Column | DataFrame:
    """Ocean cells from the lengths of the runs: one number, or ``date, ocean`` for runs with days.

    Either form is what ``quality.missing_counts`` takes.
    """
    n = F.sum(F.col("last_lon") - F.col("first_lon") + 1).cast("bigint").alias("ocean")
    return runs.groupBy(date).agg(n) if date in runs.columns else F.coalesce(runs.agg(n).scalar(), F.lit(0))


def ocean_grid(runs: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """Every ocean cell of every given day, with the columns of ``days``.

    Days meet runs by grid row (an equi-join after exploding the row numbers of each
    day), so a day spreads over as many tasks as it has rows. ``days`` has one row per day.
    """
    if date in runs.columns:
        return ocean_cells(days.join(runs, date))
    top = runs.agg(F.sort_array(F.collect_set("lat_idx"))).scalar()  # one number per grid row
    rows = days.withColumn("lat_idx", F.explode(top)).repartition(date, "lat_idx")
    return ocean_cells(rows.join(runs, "lat_idx"))
