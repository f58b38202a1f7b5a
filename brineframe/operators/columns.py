"""Water-column metrics: integral, peak, peak depth, centre of mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import column as C
from ..functions.axes import DepthAxis


def depth_arrays(long: DataFrame, keys: list[str], n: int, z: str = "z_idx", value: str = "chla", out: str = "chla", kind: str = "double") -> DataFrame:
    """Long rows -> one row per key with an array ordered by depth.

    One partially aggregated groupBy with bounded state (n averages), so a hot key
    is reduced before the shuffle; repeated samples of a bin are averaged.
    """
    bins = (f"cast(avg(CASE WHEN `{z}` = {i} THEN `{value}` END) AS {kind})" for i in range(n))
    return long.groupBy(*keys).agg(F.expr(f"array({', '.join(bins)})").alias(out))


def column_metrics(df: DataFrame, axis: DepthAxis, chla: str = "chla", kind: str = "double") -> DataFrame:
    """Adds the four column metrics; all missing where the column total is not positive."""
    valid = C.total(chla, len(axis)) > 0
    return df.withColumns({
        "chla_int_0_200": F.when(valid, C.integral(chla, axis)).cast(kind),
        "chla_peak": F.when(valid, F.array_max(chla)).cast(kind),
        "chla_peak_depth": F.when(valid, C.peak_depth(chla, axis)).cast(kind),
        "chla_depth_center_of_mass": F.when(valid, C.centre_of_mass(chla, axis)).cast(kind),
    })


def column_metrics_long(long: DataFrame, keys: list[str], chla: str = "chla", z: str = "z", thickness: str = "z_thickness") -> DataFrame:
    """The same metrics from one row per depth, in one aggregation."""
    v = F.col(chla)
    agg = long.groupBy(*keys).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("_total"),
        F.sum(v * F.col(thickness)).alias("_int"),
        F.sum(v * F.col(z)).alias("_moment"),
        F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col(z)).alias("up")))).alias("_peak"),
    )
    valid = F.col("_total") > 0
    return agg.select(
        *keys,
        F.when(valid, F.col("_int")).alias("chla_int_0_200"),
        F.when(valid, F.col("_peak.v")).alias("chla_peak"),
        F.when(valid, -F.col("_peak.up")).alias("chla_peak_depth"),
        F.when(valid, F.try_divide(F.col("_moment"), F.col("_total"))).alias("chla_depth_center_of_mass"),
    )


def to_long(df: DataFrame, axis: DepthAxis, chla: str = "chla") -> DataFrame:
    """One row per depth with bin bounds; a narrow operation (no shuffle)."""
    keep = [c for c in df.columns if c != chla]
    exploded = df.select(*keep, F.posexplode(chla).alias("z_idx", chla))
    i = F.col("z_idx")
    return exploded.withColumns({
        "z": F.get(axis.literal(), i),
        "z_start": F.get(axis.literal(axis.starts), i),
        "z_end": F.get(axis.literal(axis.ends), i),
        "z_thickness": F.get(axis.literal(axis.thickness), i),
    })
