"""Means over boxes, months, latitude bands and blocks; distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.axes import RegularAxis
from ..functions.features import month_floor
from ..functions.missing import as_col
from .quantiles import percentile_columns


def daily_mean(df: DataFrame, values: list[str], date: str = "date") -> DataFrame:
    """Unweighted mean of the selected cells per day, missing skipped."""
    return df.groupBy(date).agg(*[F.avg(v).alias(v) for v in values])


def monthly_mean(df: DataFrame, values: list[str], keys: list[str] | None = None, date: str = "date", fill: bool = True, span: tuple | None = None) -> DataFrame:
    """Mean per calendar month, labelled by its first day.

    With ``fill`` every month between the first and the last one of the data appears;
    months without data are missing. They are generated from the means themselves. With
    keys, all of them get the same months: ``span`` (first and last date, as the time axis
    has them) saves the second pass that finds these.
    """
    keys = list(keys or [])
    agg = df.groupBy(*keys, month_floor(date).alias("month")).agg(*[F.avg(v).alias(v) for v in values])
    if not fill:
        return agg
    step = F.expr("interval 1 month")
    if not keys:
        # a row per month of the calendar, each followed by the empty months up to the next one
        after = F.lead("month").over(W.partitionBy(F.lit(0)).orderBy("month"))
        rows = agg.withColumn("_until", F.coalesce(F.add_months(after, -1), F.col("month")))
        rows = rows.withColumn("_at", F.explode(F.sequence(F.col("month"), F.col("_until"), step)))
        return rows.select(F.col("_at").alias("month"), *[F.when(F.col("_at") == F.col("month"), F.col(v)).alias(v) for v in values])
    if span is None:
        one = df.select(F.struct(month_floor(F.min(date)).alias("lo"), month_floor(F.max(date)).alias("hi"))).scalar()
        lo, hi = one["lo"], one["hi"]
    else:
        lo, hi = (month_floor(F.lit(x).cast("date")) for x in span)
    # the months of one key are bounded by the calendar
    packed = agg.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct(*values)))).alias("_by"))
    rows = packed.withColumn("month", F.explode(F.sequence(lo, hi, step)))
    return rows.select(*keys, "month", *[F.try_element_at("_by", F.col("month"))[v].alias(v) for v in values])


def mean_of_daily_means(df: DataFrame, values: list[str], date: str = "date", fill: bool = True) -> DataFrame:
    """Spatial mean per day first, then the mean of days per month (two staged means)."""
    return monthly_mean(daily_mean(df, values, date), values, date=date, fill=fill)


def zonal_profile(df: DataFrame, value: str, lon: RegularAxis, lon_range: tuple, date: str = "date") -> DataFrame:
    """Monthly map per cell, then the mean over the longitudes of a band, by latitude."""
    band = df.where(lon.within("lon_idx", *lon_range))
    monthly = monthly_mean(band, [value], ["lat_idx", "lon_idx"], date, fill=False)
    return monthly.groupBy("month", "lat_idx").agg(F.avg(value).alias(value))


def block_mean(df: DataFrame, values: list[str], k: int, lat: RegularAxis, lon: RegularAxis, keys: list[str] | None = None) -> DataFrame:
    """k x k block means; an incomplete last block is trimmed, missing cells skipped.

    Block coordinates are the means of the k labels of the axis.
    """
    def trim(axis, idx):
        size = axis.size if isinstance(axis.size, Column) else F.lit(axis.size)
        return F.col(idx) < F.floor(size / F.lit(k)) * F.lit(k)

    block_lat = F.floor(F.col("lat_idx") / F.lit(k)).cast("int").alias("lat_block")
    block_lon = F.floor(F.col("lon_idx") / F.lit(k)).cast("int").alias("lon_block")
    means = df.where(trim(lat, "lat_idx") & trim(lon, "lon_idx")).groupBy(*(keys or []), block_lat, block_lon).agg(
        *[F.avg(v).alias(v) for v in values]
    )
    half = (k - 1) / 2
    return means.withColumns({
        "lat": lat.label(F.col("lat_block") * F.lit(k) + F.lit(half)),
        "lon": lon.label(F.col("lon_block") * F.lit(k) + F.lit(half)),
    })


def map_limits(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Low and high percentile of all values of a map."""
    return percentile_columns(df, value, {"low": low, "high": high})


def joint_map_limits(df: DataFrame, first: str, second: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Shared limits of two maps taken together, and the 98th percentile of their abs difference."""
    pair = F.array(
        F.struct(F.lit("map").alias("what"), F.col(first).alias("x")),
        F.struct(F.lit("map").alias("what"), F.col(second).alias("x")),
        F.struct(F.lit("diff").alias("what"), F.abs(F.col(first) - F.col(second)).alias("x")),
    )
    long = df.select(F.inline(pair))
    both = percentile_columns(long, "x", {"low": low, "high": high}, ["what"], max_groups=2)
    return both.agg(
        F.max(F.when(F.col("what") == "map", F.col("low"))).alias("low"),
        F.max(F.when(F.col("what") == "map", F.col("high"))).alias("high"),
        F.max(F.when(F.col("what") == "diff", F.col("high"))).alias("diff_high"),
    )


def value_range(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.max(F.abs(value)).alias("abs_max")
    )


def cut(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label of the left-closed interval holding the value, NULL outside all of them."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    c = as_col(c)
    out = F
    for a, b, label in zip(edges, edges[1:], labels):
        out = out.when((c >= F.lit(a)) & (c < F.lit(b)), F.lit(label))
    return out


def box_summary(df: DataFrame, value: str, keys: list[str], max_groups: int | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per group."""
    q = percentile_columns(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys, max_groups)
    v, reach = F.col(value), F.lit(1.5) * (F.col("q3") - F.col("q1"))
    within = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    if max_groups is not None:  # checked where the percentiles are located
        q = F.broadcast(q)
    rows = df.where(v.isNotNull()).join(q, keys)
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(within, v)).alias("whisker_low"),
        F.max(F.when(within, v)).alias("whisker_high"),
        F.sum(F.when(within, 0).otherwise(1)).alias("outliers"),
    )


def confusion_matrix(df: DataFrame, observed: str, predicted: str, edges: list[float], labels: list[str], normalise: bool = False) -> DataFrame:
    """Observed bin x predicted bin over the full grid of bins, zero-filled.

    Pairs with either value outside the bins are dropped. With ``normalise`` rows
    hold fractions of their sum (missing for an empty row).
    """
    spark = df.sparkSession
    pairs = df.select(cut(observed, edges, labels).alias("obs_bin"), cut(predicted, edges, labels).alias("pred_bin"))
    pairs = pairs.where(F.col("obs_bin").isNotNull() & F.col("pred_bin").isNotNull())
    counts = pairs.groupBy("obs_bin").pivot("pred_bin", labels).count()
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("obs_bin"))
    out = grid.join(counts, "obs_bin", "left").na.fill(0, labels)
    if not normalise:
        return out
    row = sum((F.col(f"`{x}`") for x in labels[1:]), F.col(f"`{labels[0]}`"))
    return out.select("obs_bin", *[F.try_divide(F.col(f"`{x}`").cast("double"), row).alias(x) for x in labels])
