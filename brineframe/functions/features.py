"""Predictors derived from time and position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .axes import fold_lon
from .missing import as_col

TWO_PI = 2.0 * math.pi


def _timestamp(df: DataFrame, time: str) -> Column:
    """Timestamps pass through; text is parsed, and what does not parse is missing."""
    kind = df.schema[time].dataType
    return F.try_to_timestamp(F.col(time)) if isinstance(kind, T.StringType) else F.col(time)


def with_solar_time(df: DataFrame, time: str = "time", lon: str = "lon", prefix: str = "solar", lon_range: str = "auto") -> DataFrame:
    """Local solar hour ``(utc_hour + lon/15) mod 24`` with its sine and cosine.

    ``lon_range``: "180" leaves longitudes, "360" folds them, "auto" folds the whole
    column if any value exceeds 180 (one aggregate over the longitude column only).
    The longitude column is replaced by the folded one.
    """
    value = F.col(lon).cast("double")
    if lon_range == "360":
        value = fold_lon(value)
    elif lon_range == "auto":
        over = df.select((F.max(F.col(lon).cast("double")) > 180).alias("over")).scalar()
        value = F.when(over, fold_lon(value)).otherwise(value)
    elif lon_range != "180":
        raise ValueError(f"unknown longitude range {lon_range!r}")
    t = _timestamp(df, time)
    utc = F.hour(t) + F.minute(t) / F.lit(60.0) + F.floor(F.second(t)) / F.lit(3600.0)
    out = df.withColumn(lon, value)
    hour = F.pmod(utc + F.col(lon) / F.lit(15.0), F.lit(24.0))
    angle = hour * F.lit(TWO_PI / 24.0)
    return out.withColumns({
        f"{prefix}_hour": hour.cast("float"),
        f"{prefix}_sin_time": F.sin(angle).cast("float"),
        f"{prefix}_cos_time": F.cos(angle).cast("float"),
    })


def with_seasonal_time(df: DataFrame, time: str = "time") -> DataFrame:
    angle = F.dayofyear(_timestamp(df, time)) * F.lit(TWO_PI / 365.25)
    return df.withColumns({"sin_time": F.sin(angle).cast("float"), "cos_time": F.cos(angle).cast("float")})


def with_unit_sphere(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    return df.withColumns({
        "x_geo": (F.cos(phi) * F.cos(lam)).cast("float"),
        "y_geo": (F.cos(phi) * F.sin(lam)).cast("float"),
        "z_geo": F.sin(phi).cast("float"),
    })


def with_sin_coords(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumns({
        "lon_sin": F.sin(F.radians(F.col(lon))),
        "lon_cos": F.cos(F.radians(F.col(lon))),
        "lat_sin": F.sin(F.radians(F.col(lat))),
    })


def log10_positive(c: Column | str) -> Column:
    """log10 where positive, missing elsewhere."""
    c = as_col(c)
    return F.when(c > 0, F.log10(c))


def pow10(c: Column | str) -> Column:
    return F.pow(F.lit(10.0), as_col(c))


def standardise(c: Column | str, mean: Column | float, std: Column | float) -> Column:
    """(x - mean) / std, where a zero std counts as one."""
    spread = std if isinstance(std, Column) else F.lit(float(std))
    centre = mean if isinstance(mean, Column) else F.lit(float(mean))
    return (as_col(c) - centre) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def month_floor(c: Column | str) -> Column:
    return F.trunc(as_col(c), "MM")
