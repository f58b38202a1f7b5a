"""Data-quality counts: missing cells, valid days, suspect profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def missing_counts(facts: DataFrame, values: list[str], ocean: Column, ocean_pixels: Column | int | DataFrame, days: DataFrame | None = None, date: str = "date") -> DataFrame:
    """Ocean cells and missing ocean cells per day and variable.

    Works on sparse facts: a cell that was never stored counts as missing, because
    missing = ocean cells - observed ocean cells. Nothing is densified. ``days`` adds
    days on which nothing was observed. ``ocean_pixels`` is one number, or for a mask that
    changes by day a table (date, ocean); a day it lacks has no ocean cell.
    """
    seen = facts.groupBy(date).agg(*[
        F.count(F.when(ocean, F.col(v))).alias(f"_seen_{v}") for v in values
    ])
    if days is not None:
        seen = days.select(date).distinct().join(seen, date, "left")
    if isinstance(ocean_pixels, DataFrame):
        seen = seen.join(ocean_pixels.select(date, F.col("ocean").alias("_ocean")), date, "left")
        pixels = F.coalesce("_ocean", F.lit(0))
    else:
        pixels = ocean_pixels if isinstance(ocean_pixels, Column) else F.lit(ocean_pixels)
    out = seen.withColumn("ocean", pixels.cast("bigint"))
    return out.select(
        date, "ocean",
        *[(F.col("ocean") - F.coalesce(F.col(f"_seen_{v}"), F.lit(0))).alias(f"missing_{v}") for v in values],
    )


def ocean_by_day(mask: DataFrame, ocean: str = "ocean", date: str = "date") -> DataFrame:
    """Ocean cells per day of a mask that changes by day, for ``missing_counts``."""
    return mask.groupBy(date).agg(F.sum(F.col(ocean).cast("int")).cast("bigint").alias("ocean"))


def pct_missing(counts: DataFrame, value: str, date: str = "date", year: int | None = None) -> DataFrame:
    """100 * missing / ocean per day, of one year if given; missing where the day has no ocean cell."""
    if year is not None:
        counts = counts.where(F.year(date) == year)
    share = F.try_divide(F.col(f"missing_{value}").cast("double"), F.col("ocean"))
    return counts.select(date, (share * 100).alias(f"pct_missing_{value}"))


def _passes(values: list[str], fractions: dict[str, float], strict: bool) -> Column:
    out = F.lit(True)
    for v in values:
        bound = F.lit(float(fractions[v])) * F.col("ocean")
        miss = F.col(f"missing_{v}")
        out = out & ((miss < bound) if strict else (miss <= bound))
    return out


def valid_days_by_month(counts: DataFrame, values: list[str], year: int, max_frac: float = 0.05, date: str = "date") -> DataFrame:
    """Days per month on which every variable has at most ``max_frac`` of the ocean missing.

    All twelve months are returned.
    """
    ok = _passes(values, {v: max_frac for v in values}, strict=False)
    per_month = (
        counts.where(F.year(date) == year)
        .groupBy(F.month(date).alias("month"))
        .agg(F.sum(ok.cast("int")).alias("valid_days"))
    )
    months = counts.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(per_month, "month", "left").na.fill(0, ["valid_days"])


def usable_days(counts: DataFrame, response: str, inputs: list[str], max_frac_response: float = 0.5, max_frac_inputs: float = 0.05, date: str = "date") -> DataFrame:
    """Days kept for training: strictly fewer missing than the allowed share, so a day
    without any ocean cell is rejected."""
    fractions = {v: max_frac_inputs for v in inputs} | {response: max_frac_response}
    return counts.where(_passes(inputs + [response], fractions, strict=True)).select(date)


def days_per_month(days: DataFrame, date: str = "date") -> DataFrame:
    return days.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.count("*").alias("days"))


def suspect_profiles(long: DataFrame, profile: str = "profile_id", value: str = "chla", z: str = "z", deep: tuple[float, float] = (100.0, 200.0), min_valid: int = 5, min_value: float = 1.0, max_spread: float = 1.0) -> DataFrame:
    """Profiles whose deep values are uniformly high (a fouled sensor)."""
    lo, hi = F.min(value), F.max(value)
    return (
        long.where(F.col(z).between(*deep))
        .groupBy(profile)
        .agg(F.count(value).alias("n_deep"), lo.alias("deep_min"), hi.alias("deep_max"))
        .where(
            (F.col("n_deep") >= min_valid)
            & (F.col("deep_min") > min_value)
            & (F.col("deep_max") - F.col("deep_min") < max_spread)
        )
    )


def drop_suspect_profiles(long: DataFrame, profile: str = "profile_id", **rule) -> DataFrame:
    return long.join(suspect_profiles(long, profile, **rule).select(profile), profile, "left_anti")


def selected_days(days: DataFrame, how: str = "first", day_of_month: int = 15, date: str = "date") -> DataFrame:
    """One or several days per month.

    "first": the earliest; "from": the earliest with day >= ``day_of_month``, else the
    last of the month; "fixed": days 1, 7, 14 and 28.
    """
    dom = F.dayofmonth(date)
    if how == "fixed":
        return days.select(date).distinct().where(dom.isin([1, 7, 14, 28]))
    if how == "first":
        pick = F.min(date)
    elif how == "from":
        pick = F.coalesce(F.min(F.when(dom >= day_of_month, F.col(date))), F.max(date))
    else:
        raise ValueError(f"unknown selection {how!r}")
    by_month = days.groupBy(F.year(date).alias("_y"), F.month(date).alias("_m")).agg(pick.alias(date))
    return by_month.select(date)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a key occurs twice (distributed count, one row fetched)."""
    twice = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    return df


def _block() -> list[Column]:
    return [F.floor(F.col("lat_idx") / 128).alias("_row"), F.floor(F.col("lon_idx") / 256).alias("_column")]


def cell_bitmaps(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows and a bitmap of the cells per (day, block of 128 x 256 cells).

    A bitmap takes 4 KB and is built before the shuffle, so one bit per cell moves instead of its key.
    """
    place = F.pmod(F.col("lat_idx"), F.lit(128)) * 256 + F.pmod(F.col("lon_idx"), F.lit(256))
    known = F.col(date).isNotNull() & F.col("lat_idx").isNotNull() & F.col("lon_idx").isNotNull()
    rows = df.select(date, *_block(), F.when(known, place).cast("long").alias("_place"))
    return rows.groupBy(date, "_row", "_column").agg(F.count("*").alias("_n"), F.bitmap_construct_agg("_place").alias("_map"))


def assert_cells_unique(df: DataFrame, date: str = "date") -> DataFrame:
    """Raise if a (date, cell) occurs twice; a row without a date or a cell is an error too.

    A block with more rows than bits set holds a duplicate. Only the rows of one such block are
    compared cell by cell, to name it.
    """
    crowded = cell_bitmaps(df, date).where(F.col("_n") != F.bitmap_count("_map")).limit(1).collect()
    if not crowded:
        return df
    at, block = crowded[0], _block()
    if at[date] is None or at["_row"] is None or at["_column"] is None:
        raise ValueError("a row has no date or no cell")
    inside = (F.col(date) == F.lit(at[date])) & (block[0] == at["_row"]) & (block[1] == at["_column"])
    return assert_unique(df.where(inside), [date, "lat_idx", "lon_idx"])
