"""Point-to-grid matching in time (interval) and space (nearest cell)."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.axes import RegularAxis
from ..functions.hashing import uniform01


def with_window(manifest: DataFrame, window: str = "24h") -> DataFrame:
    """Match window of every granule: 24 hours from its start, or its stated coverage."""
    if window == "24h":
        end = F.col("t_start") + F.expr("interval 24 hours")
    elif window == "coverage":
        end = F.col("t_end")
    else:
        raise ValueError(f"unknown window {window!r}")
    return manifest.withColumn("_end", end)


def match_in_time(points: DataFrame, manifest: DataFrame, time: str = "time", window: str = "24h") -> DataFrame:
    """Points with ``t_start <= time < end`` of a granule (half-open).

    Every window is expanded to the calendar dates it touches, which turns the range
    condition into an equi-join on the date with the exact predicate as a filter: no
    nested loop, and a date holding much of the points is split by AQE. The side to
    broadcast is left to Spark's size check.
    """
    windows = with_window(manifest, window).where(F.col("_end") > F.col("t_start"))
    last = (F.col("_end") - F.expr("interval 1 microsecond")).cast("date")
    dated = windows.withColumn("_on", F.explode(F.sequence(F.col("t_start").cast("date"), last, F.expr("interval 1 day"))))
    inside = (F.col(time) >= F.col("t_start")) & (F.col(time) < F.col("_end"))
    return points.withColumn("_on", F.col(time).cast("date")).join(dated, "_on").where(inside).drop("_on", "_end")


def match_points(
    points: DataFrame,
    manifest: DataFrame,
    pixels: DataFrame,
    lat_axis: RegularAxis,
    lon_axis: RegularAxis,
    bands: list[float] | None = None,
    select: float | None = None,
    window: str = "24h",
    variable: str = "Rrs",
    value: str = "rrs",
    time: str = "time",
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Match points to all granules of a manifest at once.

    manifest: ``granule, t_start, t_end``; pixels: ``granule, lat_idx, lon_idx`` and
    the value (an array over ``bands``, or a scalar when ``bands`` is None). Adds file,
    window, cell coordinates and one column per band; ``select`` keeps one band. A cell
    that was not stored gives missing values.

    The cells that were hit are few beside the pixels, so they select the pixels first (an
    inner join whose small side Spark may broadcast, with dynamic pruning where the
    pixels are partitioned by ``date`` and the manifest names it), and only what they
    selected is joined to the points.
    """
    prefix = f"pace_{variable}_"
    hit = match_in_time(points, manifest, time, window).withColumns({
        "lat_idx": lat_axis.nearest(lat), "lon_idx": lon_axis.nearest(lon),
    })
    cell = ["granule", "lat_idx", "lon_idx"]
    found = cell + (["date"] if "date" in manifest.columns and "date" in pixels.columns else [])
    wanted = pixels.select(*found, value).join(hit.select(*found).distinct(), found).select(*cell, value)
    joined = hit.join(wanted, cell, "left")
    if bands is None:
        values = [F.col(value).cast("double").alias(f"pace_{variable}")]
    else:
        chosen = [(i, b) for i, b in enumerate(bands) if select is None or b == select]
        if not chosen:
            raise ValueError(f"no band {select}")
        values = [F.get(F.col(value), F.lit(i)).cast("double").alias(f"{prefix}{int(b)}") for i, b in chosen]
    return joined.select(
        *points.columns,
        F.col("granule").alias(f"{prefix}file"),
        F.col("t_start").alias(f"{prefix}t_start"),
        F.col("t_end").alias(f"{prefix}t_end"),
        lat_axis.label("lat_idx").alias(f"{prefix}lat"),
        lon_axis.label("lon_idx").alias(f"{prefix}lon"),
        *values,
    )


def granules_in_span(manifest: DataFrame, points: DataFrame, time: str = "time") -> DataFrame:
    """Granules whose coverage overlaps the time span of the points."""
    span = points.select(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    return manifest.where((F.col("t_start") <= span["hi"]) & (F.col("t_end") >= span["lo"]))


def nearest_index(df: DataFrame, q: str, labels: list[float], out: str = "idx", tie: str = "left") -> DataFrame:
    """Nearest position on any sorted axis, ascending or descending, by binary search
    over the midpoints. tie="left" gives the earlier position, "larger" the larger label.
    """
    n = len(labels)
    if n == 1:
        return df.withColumn(out, F.when(F.col(q).isNotNull(), F.lit(0)))
    ascending = labels[0] <= labels[-1]
    # buckets are [a, b): the midpoint goes to the upper side of the searched axis
    take_upper = tie == "larger" or not ascending
    flip = -1.0 if not take_upper else 1.0
    axis = sorted(flip * v for v in labels)
    middles = [(a + b) / 2 for a, b in zip(axis, axis[1:])]
    finder = Bucketizer(
        splits=[-float("inf"), *middles, float("inf")], inputCol="_q", outputCol="_b", handleInvalid="keep"
    )
    found = finder.transform(df.withColumn("_q", F.col(q).cast("double") * F.lit(flip)))
    bucket = F.when(F.col("_q").isNotNull(), F.col("_b").cast("int"))
    same_order = ascending == (flip > 0)
    return found.withColumn(out, bucket if same_order else F.lit(n - 1) - bucket).drop("_q", "_b")


def exact_day(days: DataFrame, axis: DataFrame, date: str = "date") -> DataFrame:
    """Axis position of every day; a day must match exactly one axis entry."""
    counted = days.join(axis, date, "left").groupBy(date).agg(
        F.count("time_idx").alias("matches"), F.min("time_idx").alias("time_idx")
    )
    wrong = counted.where(F.col("matches") != 1).limit(1).collect()
    if wrong:
        raise ValueError(f"day {wrong[0][date]} matches {wrong[0]['matches']} entries of the time axis")
    return counted.drop("matches")


def pair_truth(truth: DataFrame, pred: DataFrame, keys: list[str], t: str = "truth", p: str = "pred") -> DataFrame:
    """Truth and prediction on the same cells, both present."""
    joined = truth.select(*keys, t).join(pred.select(*keys, p), keys)
    return joined.where(F.col(t).isNotNull() & F.col(p).isNotNull())


def random_samples(ids: DataFrame, key: str, days: DataFrame, lat_range: tuple, lon_range: tuple, seed: int = 42) -> DataFrame:
    """A random day and a random continuous position per id.

    ``days``: ``date, time_idx`` with positions 0..T-1.
    """
    size = days.select(F.count("*")).scalar()

    def span(lo, hi, salt):
        lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
        return lo + uniform01(key, f"{seed}{salt}") * (hi - lo)

    drawn = ids.select(
        key,
        F.floor(uniform01(key, f"{seed}t") * size).cast("int").alias("time_idx"),
        span(*lat_range, "y").alias("lat"),
        span(*lon_range, "x").alias("lon"),
    )
    return drawn.join(F.broadcast(days.select("date", "time_idx")), "time_idx").drop("time_idx")


def lookup_samples(samples: DataFrame, cube: DataFrame, value: str, lat_axis: RegularAxis, lon_axis: RegularAxis, ocean: Column | None = None) -> DataFrame:
    """Value of the nearest cell for given (date, lat, lon) samples; only finite ocean
    values are returned, with the sample's own coordinates."""
    # between two labels the earlier position wins here, on either axis
    snapped = samples.withColumns({"lat_idx": lat_axis.nearest("lat", "left"), "lon_idx": lon_axis.nearest("lon", "left")})
    cells = cube if ocean is None else cube.where(ocean)
    cells = cells.where(F.col(value).isNotNull()).select("date", "lat_idx", "lon_idx", value)
    return snapped.join(cells, ["date", "lat_idx", "lon_idx"]).drop("lat_idx", "lon_idx")


def regrid_nearest(field: DataFrame, target: DataFrame, src_lat: RegularAxis, src_lon: RegularAxis, value: str, lat: str = "lat", lon: str = "lon", keys: list[str] | None = None) -> DataFrame:
    """External field on the target cells, nearest source cell."""
    keys = list(keys or [])
    near = target.withColumns({"_i": src_lat.nearest(lat), "_j": src_lon.nearest(lon)})
    src = field.select(*keys, F.col("lat_idx").alias("_i"), F.col("lon_idx").alias("_j"), value)
    return near.join(src, keys + ["_i", "_j"], "left").drop("_i", "_j")


def regrid_bilinear(field: DataFrame, target: DataFrame, src_lat: RegularAxis, src_lon: RegularAxis, value: str, lat: str = "lat", lon: str = "lon", cell_key: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """External field on the target cells, bilinear over the four surrounding source cells.

    Each target cell becomes four weighted corner rows, one equi-join fetches the
    values and a partial aggregation sums them; missing where a corner is missing.
    """
    keys, cell_key = list(keys or []), list(cell_key or ["lat_idx", "lon_idx"])

    def split(axis, c):
        last = (axis.size if isinstance(axis.size, Column) else F.lit(axis.size)) - F.lit(1)
        pos = (F.col(c) - F.lit(axis.origin)) / F.lit(axis.step)
        pos = F.greatest(F.lit(0.0), F.least(last.cast("double"), pos))
        low = F.least(F.floor(pos), F.greatest(last - F.lit(1), F.lit(0))).cast("int")
        return low, pos - low, last.cast("int")

    (i, u, top), (j, v, right) = split(src_lat, lat), split(src_lon, lon)
    corners = F.array(*[
        F.struct(
            F.least(i + F.lit(a), top).alias("_i"), F.least(j + F.lit(b), right).alias("_j"),
            ((u if a else 1 - u) * (v if b else 1 - v)).alias("_w"),
        )
        for a in (0, 1) for b in (0, 1)
    ])
    rows = target.select(*keys, *cell_key, F.inline(corners)).where(F.col("_w") > 0)
    src = field.select(*keys, F.col("lat_idx").alias("_i"), F.col("lon_idx").alias("_j"), value)
    found = rows.join(src, keys + ["_i", "_j"], "left")
    full = F.count(value) == F.count("*")
    return found.groupBy(*keys, *cell_key).agg(F.when(full, F.sum(F.col("_w") * F.col(value))).alias(value))
