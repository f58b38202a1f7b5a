"""Sums that follow the versioned slices: what a refresh computes, and that readers see current slices only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brineframe.functions.axes import RegularAxis
from brineframe.functions.features import month_floor
from brineframe.operators import gridagg
from brineframe.sources import aggregates as A, versions as V

VALUES = ["chla_int_0_200", "chla_peak"]
LON = RegularAxis(0.0, 1.0, 6)


def deliver(spark, root, sequence, dates, factor=1.0):
    """A new version of the days; cells are (lat 0-1) x (lon 0-5), one value missing."""
    rows = [(d, i, j, None if (i, j) == (1, 1) else factor * (d.day + 10 * i + j)) for d in dates for i in range(2) for j in range(6)] if factor else []
    df = spark.createDataFrame(rows, "date date, lat_idx int, lon_idx int, v double")
    cells = df.withColumns({n.name: F.col("v").cast("float") for n in V.CELL_SCHEMA.fields if n.name.startswith("chla_")}).withColumn("chla", F.array(F.col("v").cast("float")))
    version = V.write_slices(cells, root, 6)
    marks = [(d, f"d{sequence}", "run", sequence, sequence, version, "done", None) for d in dates]
    V.commit(spark.createDataFrame(marks, V.LEDGER), root)


@pytest.fixture
def root(spark, tmp_path):
    root = str(tmp_path / "store")
    V.prepare_store(spark, root)
    deliver(spark, root, 1, [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1)])
    return root


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def check(spark, root):
    """Every kept aggregate equals the one computed from the current cells."""
    cells = V.read_current(spark, root)
    days, months = A.read_day_rows(spark, root, VALUES, 3), A.read_month_cells(spark, root, VALUES)
    assert rows(A.daily_means(days, VALUES)) == rows(gridagg.daily_mean(cells, VALUES))
    assert rows(A.mean_of_daily_means(days, VALUES)) == rows(gridagg.mean_of_daily_means(cells, VALUES))
    assert rows(A.monthly_map(months, VALUES)) == rows(cells.groupBy(month_floor("date").alias("month"), "lat_idx", "lon_idx").agg(*[F.avg(v).alias(v) for v in VALUES]))
    assert rows(A.zonal_profile(months, VALUES[0], LON, (1, 4))) == rows(gridagg.zonal_profile(cells, VALUES[0], LON, (1, 4)))
    box = days.where("lon_block = 1 AND lat_idx = 0")
    assert rows(A.daily_means(box, VALUES)) == rows(gridagg.daily_mean(cells.where("lon_idx >= 3 AND lat_idx = 0"), VALUES))


def test_only_replaced_days_and_their_months_are_computed(spark, root):
    assert A.refresh(spark, root, VALUES, 3) == (3, 2)
    check(spark, root)
    assert A.refresh(spark, root, VALUES, 3) == (0, 0)
    deliver(spark, root, 2, [dt.date(2024, 1, 31)], 3.0)
    assert A.refresh(spark, root, VALUES, 3) == (1, 1)
    check(spark, root)


def test_sums_that_lag_behind_are_an_error(spark, root):
    A.refresh(spark, root, VALUES, 3)
    deliver(spark, root, 2, [dt.date(2024, 2, 2)])
    with pytest.raises(ValueError, match="refresh first"):
        A.read_day_rows(spark, root, VALUES, 3)
    with pytest.raises(ValueError, match="refresh first"):
        A.read_month_cells(spark, root, VALUES)


def test_a_day_left_without_cells_disappears_and_is_not_tried_again(spark, root):
    A.refresh(spark, root, VALUES, 3)
    deliver(spark, root, 2, [dt.date(2024, 2, 1)], 0)
    assert A.refresh(spark, root, VALUES, 3) == (1, 1)
    assert A.refresh(spark, root, VALUES, 3) == (0, 0)
    assert [r["date"].day for r in A.daily_means(A.read_day_rows(spark, root, VALUES, 3), VALUES).orderBy("date").collect()] == [30, 31]
    assert A.read_month_cells(spark, root, VALUES).select("month").distinct().count() == 1


def test_sums_written_but_not_marked_are_written_again(spark, root, monkeypatch):
    write = A._write

    def fails(df, place, schema, *by):
        write(df, place, schema, *by)
        raise RuntimeError("lost")

    monkeypatch.setattr(A, "_write", fails)
    with pytest.raises(RuntimeError):
        A.refresh(spark, root, VALUES, 3)
    monkeypatch.setattr(A, "_write", write)
    assert A.refresh(spark, root, VALUES, 3) == (3, 2)
    check(spark, root)


def test_empty_store_and_other_widths(spark, tmp_path, root):
    empty = str(tmp_path / "empty")
    V.prepare_store(spark, empty)
    assert A.refresh(spark, empty, VALUES) == (0, 0)
    assert A.read_day_rows(spark, empty, VALUES).count() == 0 and A.read_month_cells(spark, empty, VALUES).count() == 0
    A.refresh(spark, root, VALUES, 3)
    assert A.refresh(spark, root, VALUES, 2) == (3, 0)
    assert A.read_day_rows(spark, root, VALUES, 2).agg(F.max("lon_block")).first()[0] == 2
