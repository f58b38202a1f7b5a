"""Ecological indicators of the vertical structure, with and without a mixed-layer depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import column as C
from ..functions.axes import DepthAxis
from ..functions.missing import as_col
from ..session import shared_dir
from ..sources.tables import staged


def bin_samples(samples: DataFrame, keys: list[str], depth: str = "depth", value: str = "chla", width: float = 10.0, max_depth: float = 200.0) -> DataFrame:
    """Irregular samples -> mean per depth bin; partial profiles are kept."""
    z = F.floor(F.col(depth) / F.lit(width)).cast("int")
    inside = (F.col(depth) >= 0) & (F.col(depth) < max_depth)
    return samples.where(inside).groupBy(*keys, z.alias("z_idx")).agg(
        F.avg(value).alias(value), F.count(value).alias("n_samples")
    )


def integral_to(chla: str, axis: DepthAxis, limit: str | float) -> Column:
    """Vertical integral from the surface to ``limit`` (a column name or metres), partial
    bins in part."""
    valid = C.total(chla, len(axis)) > 0
    return F.when(valid, C.weighted_total(chla, C.overlap(axis, limit)))


def productive_thickness(chla: str, axis: DepthAxis, fraction: float = 0.5) -> Column:
    """Total thickness of the bins holding at least a fraction of the maximum."""
    terms = " + ".join(
        f"CASE WHEN get(`{chla}`, {i}) >= {fraction}D * array_max(`{chla}`) THEN {float(t)}D ELSE 0D END"
        for i, t in enumerate(axis.thickness)
    )
    return F.when(C.total(chla, len(axis)) > 0, F.expr(terms))


def local_maxima(chla: str, n: int) -> Column:
    """Number of bins above both neighbours; outside the profile and where a bin is
    missing the neighbour counts as 0."""
    v = ["0D", *(f"coalesce(double(get(`{chla}`, {i})), 0D)" for i in range(n)), "0D"]
    return F.expr(" + ".join(
        f"CASE WHEN {v[i]} > {v[i - 1]} AND {v[i]} > {v[i + 1]} THEN 1 ELSE 0 END" for i in range(1, n + 1)
    ))


def structure_class(chla: str, axis: DepthAxis, surface_depth: float = 20.0, flat_ratio: float = 0.8) -> Column:
    """"uniform", "double-peak", "surface" or "deep", by rules on the profile shape."""
    valid = C.total(chla, len(axis)) > 0
    kind = (
        F.when(F.array_min(chla) >= F.lit(flat_ratio) * F.array_max(chla), "uniform")
        .when(local_maxima(chla, len(axis)) >= 2, "double-peak")
        .when(C.peak_depth(chla, axis) <= surface_depth, "surface")
        .otherwise("deep")
    )
    return F.when(valid, kind)


def with_profile_indicators(df: DataFrame, axis: DepthAxis, chla: str = "chla", deep_threshold: float = 50.0) -> DataFrame:
    valid = C.total(chla, len(axis)) > 0
    peak = F.when(valid, C.peak_depth(chla, axis))
    return df.withColumns({
        "dcm_depth": peak,
        "dcm_value": F.when(valid, F.array_max(chla).cast("double")),
        "int_0_100": integral_to(chla, axis, 100.0),
        "int_0_200": integral_to(chla, axis, 200.0),
        "mean_depth": F.when(valid, C.centre_of_mass(chla, axis)),
        "layer_thickness": productive_thickness(chla, axis),
        "structure": structure_class(chla, axis),
        "deep_regime": peak > F.lit(deep_threshold),
    })


def with_mixed_layer_indicators(df: DataFrame, axis: DepthAxis, mld: str, chla: str = "chla") -> DataFrame:
    """Mixed-layer mean, fractions above and below, separation and normalised depth."""
    depth = F.col(mld).cast("double")
    above = integral_to(chla, axis, mld)
    whole = integral_to(chla, axis, max(e for e in axis.ends if e is not None))
    valid = C.total(chla, len(axis)) > 0
    peak = F.when(valid, C.peak_depth(chla, axis))
    return df.withColumns({
        "ml_chl": F.try_divide(above, depth),
        "fraction_above": F.try_divide(above, whole),
        "fraction_below": F.lit(1.0) - F.try_divide(above, whole),
        "dcm_minus_mld": peak - depth,
        "mean_depth_over_mld": F.try_divide(F.when(valid, C.centre_of_mass(chla, axis)), depth),
    })


def climatology(long: DataFrame, group: list[str], value: str = "chla", z: str = "z_idx") -> DataFrame:
    """Mean profile per group (a region, a month, a mixed-layer regime)."""
    return long.groupBy(*group, z).agg(F.avg(value).alias("climatology"))


def vertical_anomalies(long: DataFrame, group: list[str], value: str = "chla", z: str = "z_idx", climate: DataFrame | None = None) -> DataFrame:
    """Anomaly of every value against the mean profile of its group.

    Without a stored ``climate`` table the mean profiles are written to the shared folder
    first: one row per group and depth bin. Their size is then known when the join is planned, and
    the long table is not shuffled where Spark finds them small.
    """
    if climate is None:
        climate = staged(climatology(long, group, value, z), shared_dir(long.sparkSession, "climatology"))
    return long.join(climate, group + [z]).withColumn("anomaly", F.col(value) - F.col("climatology"))


def mld_regime(mld: Column | str, edges: list[float]) -> Column:
    """Regime number: how many edges the mixed layer reaches."""
    d = as_col(mld)
    return reduce(lambda a, b: a + b, [F.when(d >= e, 1).otherwise(0) for e in edges])
