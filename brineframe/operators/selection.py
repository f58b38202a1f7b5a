"""Filters, masks and reshaping of profile tables and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.axes import DepthAxis, RegularAxis
from ..functions.missing import all_present, as_col, count_present
from ..functions.names import numbered_columns, parse_depth_label


def conform(df: DataFrame, renames: dict[str, str], keep: list[str], prefixes: tuple[str, ...] = (), consts: dict | None = None) -> DataFrame:
    """Rename, keep listed columns plus the numbered ones of every prefix, add constants."""
    out = df.withColumnsRenamed(renames)
    names = list(keep) + [c for p in prefixes for c in numbered_columns(out.columns, p) if c not in keep]
    return out.select(*names, *[F.lit(v).alias(k) for k, v in (consts or {}).items()])


def stack_sources(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def cast_columns(df: DataFrame, columns: list[str], kind: str = "float") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def drop_all_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(count_present(columns) > 0)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(all_present(columns))


def positive_log10(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0).withColumn(column, F.log10(column))


def box(df: DataFrame, lat: RegularAxis, lon: RegularAxis, lat_range: tuple, lon_range: tuple) -> DataFrame:
    """Inclusive label box, stated on the index columns so that it is pushed to the scan."""
    return df.where(lat.within("lat_idx", *lat_range) & lon.within("lon_idx", *lon_range))


def days_between(df: DataFrame, first: str, last: str, date: str = "date") -> DataFrame:
    """Whole days, both ends included."""
    return df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def nearest_point(df: DataFrame, lat: RegularAxis, lon: RegularAxis, at_lat: float, at_lon: float) -> DataFrame:
    return df.where(
        (F.col("lat_idx") == lat.nearest(F.lit(at_lat))) & (F.col("lon_idx") == lon.nearest(F.lit(at_lon)))
    )


def stride(df: DataFrame, idx: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    i = F.col(idx)
    cond = (i >= start) & (F.pmod(i - F.lit(start), F.lit(step)) == 0)
    return df.where(cond if stop is None else cond & (i < stop))


def depth_layer(df: DataFrame, axis: DepthAxis, z_start: float, chla: str = "chla") -> DataFrame:
    """The bin whose lower bound is nearest to ``z_start``."""
    pos = axis.nearest_start(z_start)
    return df.withColumns({
        "z_idx": F.lit(pos),
        chla: F.get(F.col(chla), F.lit(pos)),
    })


def in_years(df: DataFrame, years: int | list[int], time: str = "date") -> DataFrame:
    wanted = [years] if isinstance(years, int) else list(years)
    lo, hi = min(wanted), max(wanted)
    # the range on the bare column prunes files; isin removes the years between
    cond = (F.col(time) >= F.lit(f"{lo}-01-01").cast("date")) & (F.col(time) < F.lit(f"{hi + 1}-01-01").cast("date"))
    return df.where(cond & F.year(time).isin(wanted))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Explicit emptiness check; reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def mask_where(df: DataFrame, cond: Column, columns: list[str]) -> DataFrame:
    """Keep values where ``cond`` holds, missing elsewhere."""
    return df.withColumns({c: F.when(cond, F.col(c)) for c in columns})


def exclude_ids(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad.select(key).distinct(), key, "left_anti")


def platform_token(profile_id: Column | str) -> Column:
    return F.get(F.split(as_col(profile_id), "_"), F.lit(0))


def good_quality(df: DataFrame, qc: str) -> DataFrame:
    """QC flags 1/2 when numeric, A/B when text."""
    text = isinstance(df.schema[qc].dataType, T.StringType)
    return df.where(F.col(qc).isin(["A", "B"] if text else [1, 2]))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as a partially aggregated minimum."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest])


def wide_to_long(df: DataFrame, ids: list[str], prefix: str = "CHLA_", value: str = "chla") -> DataFrame:
    """``PREFIX_a_b`` columns -> (z_start, z_end, z, value) rows, missing values kept."""
    cols = [c for c in numbered_columns(df.columns, prefix) if parse_depth_label(c)]
    bins = F.array(*[
        F.struct(
            F.lit(c).alias("var"),
            F.lit(parse_depth_label(c)[0]).alias("z_start"),
            F.lit(parse_depth_label(c)[1]).alias("z_end"),
            F.col(c).cast("double").alias(value),
        )
        for c in cols
    ])
    return df.select(*ids, F.inline(bins)).withColumn("z", (F.col("z_start") + F.col("z_end")) / 2)


def long_to_wide(long: DataFrame, ids: list[str], labels: list[str], var: str = "var", value: str = "chla") -> DataFrame:
    """Back to one column per label; an explicit label list keeps this a single job.

    One grouping by the ids; a pivot would first group by (ids, label), as many groups as long rows.
    """
    return long.groupBy(*ids).agg(*[F.first(F.when(F.col(var) == c, F.col(value)), ignorenulls=True).alias(c) for c in labels])


def bands_to_columns(df: DataFrame, array: str, bands: list[float], prefix: str) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != array],
        *[F.get(F.col(array), F.lit(i)).alias(f"{prefix}{int(b)}") for i, b in enumerate(bands)],
    )


def columns_to_bands(df: DataFrame, columns: list[str], array: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], F.array(*columns).alias(array))


def densify(df: DataFrame, days: DataFrame, n_lat, n_lon, date: str = "date") -> DataFrame:
    """Every (day, lat, lon) cell, facts attached where present.

    Cells are generated by exploding index ranges (no cross join), latitude first
    and redistributed before longitude, so one day is spread over many tasks.
    """
    top = (n_lat if hasattr(n_lat, "cast") else F.lit(n_lat)) - F.lit(1)
    right = (n_lon if hasattr(n_lon, "cast") else F.lit(n_lon)) - F.lit(1)
    rows = days.select(date).distinct().select(date, F.explode(F.sequence(F.lit(0), top.cast("int"))).alias("lat_idx"))
    cells = rows.repartition(date, "lat_idx").select(
        date, "lat_idx", F.explode(F.sequence(F.lit(0), right.cast("int"))).alias("lon_idx")
    )
    return cells.join(df, [date, "lat_idx", "lon_idx"], "left")
