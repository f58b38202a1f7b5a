"""Operators that look at neighbouring bins or cells: smoothing, structural
similarity, distance to coast."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.axes import RegularAxis
from ..functions.column import smooth
from .selection import densify


def smooth_profiles(long: DataFrame, keys: list[str], order: str = "z_idx", value: str = "chla", out: str = "smoothed", size: int = 3) -> DataFrame:
    """Centred moving average over the valid bins of each profile in depth order, the
    edge value repeated. A window holds one profile, i.e. at most the depth axis."""
    if size < 1 or size % 2 == 0:
        raise ValueError("the window size must be odd")
    w = W.partitionBy(*keys).orderBy(order)
    v = F.col(value)
    first = F.first(v).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last(v).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    terms = [v]
    for k in range(1, size // 2 + 1):
        terms.append(F.coalesce(F.lag(v, k).over(w), first))
        terms.append(F.coalesce(F.lead(v, k).over(w), last))
    mean = reduce(lambda a, b: a + b, terms) / F.lit(float(size))
    return long.where(v.isNotNull()).withColumn(out, mean)


def first_peak(long: DataFrame, keys: list[str], value: str, depth: str = "z") -> DataFrame:
    """Depth and value of the first maximum per key (a mergeable maximum, no sort)."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col(depth)).alias("up"))))
    agg = long.groupBy(*keys).agg(best.alias("_p"))
    return agg.select(*keys, (-F.col("_p.up")).alias("peak_depth"), F.col("_p.v").alias("peak_value"))


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(3.5 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def structural_similarity(df: DataFrame, days: DataFrame, n_lat, n_lon, truth: str = "truth", pred: str = "pred", win_size: int = 7, sigma: float | None = None, date: str = "date") -> DataFrame:
    """Mean structural similarity of two maps per day (Wang et al. 2004).

    Missing cells take the mean of their own image; the data range is that of the
    truth (1 where that is degenerate). Local moments are
    separable: a frame along longitude, then one along latitude, so each window
    partition is one grid row or column of one day. Uniform weights with sample
    covariance, or Gaussian weights truncated at 3.5 sigma.
    """
    weights = None if sigma is None else gaussian_weights(sigma)
    size = win_size if weights is None else len(weights)
    if size % 2 == 0:
        raise ValueError("the window size must be odd")
    half, count = size // 2, size * size
    spread = count / (count - 1)

    stats = df.groupBy(date).agg(
        F.coalesce(F.avg(truth), F.lit(0.0)).alias("_mt"),
        F.coalesce(F.avg(pred), F.lit(0.0)).alias("_mp"),
        F.coalesce(F.max(truth) - F.min(truth), F.lit(0.0)).alias("_r"),
    )
    stats = stats.withColumn("_range", F.when(F.col("_r") != 0, F.col("_r")).otherwise(F.lit(1.0)))
    grid = densify(df.select(date, "lat_idx", "lon_idx", truth, pred), days, n_lat, n_lon, date)
    # one row per day: broadcast, or the whole grid would be shuffled by day alone
    grid = grid.join(F.broadcast(stats.drop("_r")), date)
    x, y = F.coalesce(F.col(truth), F.col("_mt")), F.coalesce(F.col(pred), F.col("_mp"))
    moments = {"_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y}
    grid = grid.select(date, "lat_idx", "lon_idx", "_range", *[m.alias(n) for n, m in moments.items()])

    def along(frame: DataFrame, part: str, order: str) -> DataFrame:
        w = W.partitionBy(date, part).orderBy(order)
        if weights is None:
            near = w.rowsBetween(-half, half)
            return frame.withColumns({n: F.sum(n).over(near) / F.lit(float(size)) for n in moments})
        out = {}
        for n in moments:
            terms = []
            for k, g in zip(range(-half, half + 1), weights):
                near = F.lag(n, -k).over(w) if k < 0 else F.lead(n, k).over(w)
                terms.append((near if k else F.col(n)) * F.lit(g))
            out[n] = reduce(lambda a, b: a + b, terms)
        return frame.withColumns(out)

    local = along(along(grid, "lat_idx", "lon_idx"), "lon_idx", "lat_idx")
    top = n_lat if isinstance(n_lat, Column) else F.lit(n_lat)
    right = n_lon if isinstance(n_lon, Column) else F.lit(n_lon)
    inner = local.where(
        (F.col("lat_idx") >= half) & (F.col("lat_idx") < top - F.lit(half))
        & (F.col("lon_idx") >= half) & (F.col("lon_idx") < right - F.lit(half))
    )
    ux, uy = F.col("_x"), F.col("_y")
    vx = F.lit(spread) * (F.col("_xx") - ux * ux)
    vy = F.lit(spread) * (F.col("_yy") - uy * uy)
    vxy = F.lit(spread) * (F.col("_xy") - ux * uy)
    c1, c2 = F.pow(F.lit(0.01) * F.col("_range"), 2), F.pow(F.lit(0.03) * F.col("_range"), 2)
    score = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
    means = inner.groupBy(date).agg(F.avg(score).alias("ssim"))
    return days.select(date).distinct().join(means, date, "left")


def lower_envelope(xs: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """min over j of (xs[i] - xs[j])**2 + heights[j] for every i, in linear time.

    ``xs`` ascends; NaN heights take no part, and without any height all results are NaN.
    The parabolas that are lowest somewhere form a stack whose crossing points ascend.
    """
    known = np.flatnonzero(~np.isnan(heights))
    if not len(known):
        return np.full(len(xs), np.nan)
    x, h = xs[known].tolist(), heights[known].tolist()
    stack, begins = [0], [-np.inf]
    for q in range(1, len(x)):
        while True:
            p = stack[-1]
            cross = ((h[q] + x[q] * x[q]) - (h[p] + x[p] * x[p])) / (2 * (x[q] - x[p]))
            if cross > begins[-1]:
                break
            stack.pop()
            begins.pop()
        stack.append(q)
        begins.append(cross)
    lowest = np.array(stack)[np.searchsorted(np.array(begins), xs, side="right") - 1]
    gap = xs - np.array(x)[lowest]
    return gap * gap + np.array(h)[lowest]


def distance_to_coast(mask: DataFrame, lat: RegularAxis, lon: RegularAxis, ocean: str = "ocean") -> DataFrame:
    """Distance (km) of every cell of a static mask to the nearest land cell, 0 on land.

    Exact and separable: (1) per longitude, the nearest land along latitude with two
    window frames; (2) per latitude row, the lower envelope over longitudes of the combined
    distance, one grid row per group, in linear time. Missing where the mask has no land at all.
    """
    km = 111.0
    # mean label of a regular axis from its first and last entry
    mean_lat = F.lit(lat.origin) + (_size(lat) - F.lit(1)) * F.lit(lat.step / 2)
    dy = abs(lat.step) * km
    dx = F.lit(abs(lon.step) * km) * F.greatest(F.cos(F.radians(mean_lat)), F.lit(1e-6))

    down = W.partitionBy("lon_idx").orderBy("lat_idx")
    land_at = F.when(~F.col(ocean).cast("boolean"), F.col("lat_idx"))
    above = F.last(land_at, ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0))
    below = F.first(land_at, ignorenulls=True).over(down.rowsBetween(0, W.unboundedFollowing))
    steps = F.least(F.col("lat_idx") - above, below - F.col("lat_idx"))
    columns = mask.select("lat_idx", "lon_idx", ocean, (steps * F.lit(dy)).alias("_g"), dx.alias("_dx"))

    def row_minimum(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lon_idx")
        xs = pdf["lon_idx"].to_numpy(dtype=float) * pdf["_dx"].iloc[0]
        nearest = np.sqrt(lower_envelope(xs, pdf["_g"].to_numpy(dtype=float) ** 2))
        return pd.DataFrame({"lat_idx": pdf["lat_idx"], "lon_idx": pdf["lon_idx"], "dist2coast_km": nearest})

    out = columns.groupBy("lat_idx").applyInPandas(row_minimum, "lat_idx int, lon_idx int, dist2coast_km double")
    return out.withColumn("dist2coast_km", F.when(~F.isnan("dist2coast_km"), F.col("dist2coast_km")))


def _size(axis: RegularAxis) -> Column:
    return axis.size if isinstance(axis.size, Column) else F.lit(axis.size)


def smooth_array(df: DataFrame, column: str, out: str, size: int = 3) -> DataFrame:
    return df.withColumn(out, smooth(F.filter(F.col(column), lambda v: v.isNotNull()), size))
