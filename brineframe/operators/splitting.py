"""Train/validation/test splits and the normalised training table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.features import standardise
from ..functions.hashing import hash32, uniform01
from ..functions.missing import all_present
from ..session import shared_dir
from ..sources.tables import staged
from .masks import CELL, ocean_cells, ocean_grid, ocean_pixels as pixels_of
from .quality import missing_counts, usable_days
from .quantiles import exact_percentiles, sample_exact
from .selection import require_rows


def row_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` column by hash of the row key: the same under any partitioning."""
    return df.withColumn("split", F.when(uniform01(key, seed) < test_fraction, "test").otherwise("train"))


def time_split(days: DataFrame, ratio: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 42, contiguous: bool = False, date: str = "date") -> DataFrame:
    """Days with a split of exact sizes, cut at int(r0*T) and int((r0+r1)*T).

    The days form a calendar axis (a few hundred rows a year), so ranking them in one
    window is bounded. ``contiguous`` keeps the days in order instead of shuffling.
    """
    if abs(sum(ratio) - 1.0) > 1e-6:
        raise ValueError("the split ratio must sum to 1")
    order = [F.col(date)] if contiguous else [hash32(date, seed), F.col(date)]
    axis = W.partitionBy(F.lit(0))
    n = F.count("*").over(axis)
    rank = F.row_number().over(axis.orderBy(*order)) - 1
    train_end = F.floor(F.lit(ratio[0]) * n)
    val_end = F.floor(F.lit(ratio[0] + ratio[1]) * n)
    ranked = days.select(date).distinct().select(date, rank.alias("_r"), train_end.alias("_a"), val_end.alias("_b"))
    split = F.when(F.col("_r") < F.col("_a"), "train").when(F.col("_r") < F.col("_b"), "val").otherwise("test")
    return ranked.select(date, split.alias("split"))


def train_stats(df: DataFrame, values: list[str], train: Column | None = None) -> DataFrame:
    """One row: mean and population std of every variable over the training rows."""
    train = F.col("split") == "train" if train is None else train
    aggs = []
    for v in values:
        aggs += [
            F.avg(F.when(train, F.col(v))).alias(f"mean_{v}"),
            F.stddev_pop(F.when(train, F.col(v))).alias(f"std_{v}"),
        ]
    return df.agg(*aggs)


def pixel_medians(df: DataFrame, values: list[str], usable: Column, cells: DataFrame | None = None) -> DataFrame:
    """Median per cell over the usable days, else the global median, else 0.

    A cell holds at most one value per day, so its buffer is bounded by the calendar;
    the global median is located by counting (no group is gathered). ``cells`` adds cells
    that no row has; they get the global median.
    """
    per_cell = df.groupBy("lat_idx", "lon_idx").agg(
        *[F.median(F.when(usable, F.col(v))).alias(f"median_{v}") for v in values]
    )
    if cells is not None:
        per_cell = per_cell.join(cells.select(*CELL).distinct(), CELL, "full")
    pairs = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("x")) for v in values])
    long = df.where(usable).select(F.inline(pairs))
    overall = exact_percentiles(long, "x", [0.5], ["var"], max_groups=len(values))
    fallback = overall.agg(*[F.max(F.when(F.col("var") == v, F.col("x"))).alias(v) for v in values])
    row = fallback.select(F.struct(*values)).scalar()
    return per_cell.withColumns({
        f"median_{v}": F.coalesce(F.col(f"median_{v}"), row[v], F.lit(0.0)) for v in values
    })


def training_table(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    response: str,
    ocean: str,
    ocean_pixels: Column | int | DataFrame | None = None,
    ratio: tuple[float, float, float] = (0.7, 0.2, 0.1),
    seed: int = 42,
    years: list[int] | None = None,
    contiguous: bool = False,
    max_frac_response: float = 0.5,
    max_frac_inputs: float = 0.05,
    missing_flags: bool = False,
    mean_std: dict[str, tuple[float, float]] | None = None,
    stage: str | None = None,
    runs: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Filter days, split them, impute and normalise; one row per (day, stored cell).

    With ``runs`` (``masks.encode_runs``) the table also has a row for every ocean cell of a kept
    day that was not stored: its inputs are imputed, its flags say so, its response is
    missing. Ocean pixels then follow from the runs. The mask decides what is ocean on these rows only;
    a stored row keeps its own flag.

    A day is kept if every input, numeric or categorical, and the response pass their
    share of missing ocean cells; ``ocean_pixels`` may be a table by day. An empty selection of
    years and a filter that leaves no day are errors.

    Adds ``split``, ``features`` (ARRAY<FLOAT>) and ``y``; the response keeps its
    missing values. Numeric inputs: per-cell training median where missing over the
    ocean, standardised with training statistics, 0 on land; optional missing flag
    after each. Categorical inputs: 0 where missing. Returns the table and the feature
    names.

    Statistics, medians and the table itself each read the kept rows, which are therefore
    written once to ``stage``, a new shared folder if none is named.
    """
    if years is not None:
        df = require_rows(df.where(F.year("date").isin(list(years))), f"no data in the years {sorted(years)}")
    is_ocean = F.col(ocean).cast("boolean")
    inputs = [*numeric, *categorical]
    if ocean_pixels is None:
        if runs is None:
            raise ValueError("name the ocean pixels or the runs of the mask")
        ocean_pixels = pixels_of(runs)
    counts = missing_counts(df, [*inputs, response], is_ocean, ocean_pixels)
    stage = stage or shared_dir(df.sparkSession, "training")
    kept = staged(usable_days(counts, response, inputs, max_frac_response, max_frac_inputs), f"{stage}-days")
    kept = require_rows(kept, "no day is left after the day filter")
    # one row per calendar day, so the split table is small whatever the size of the cube
    days = time_split(kept, ratio, seed, contiguous)
    rows = df.join(F.broadcast(days), "date")
    rows = staged(rows, stage)
    train = F.col("split") == "train"
    if mean_std is None:
        stats = train_stats(rows, numeric)
        packed = stats.select(F.struct(*stats.columns)).scalar()
        centre = {v: (packed[f"mean_{v}"], packed[f"std_{v}"]) for v in numeric}
    else:
        centre = {v: (F.lit(float(m)), F.lit(float(s))) for v, (m, s) in mean_std.items()}
    medians = pixel_medians(rows, numeric, train & is_ocean, None if runs is None else ocean_cells(runs))
    if runs is not None:
        # statistics skip missing values, so only the table itself needs the cells without a row
        grid = ocean_grid(runs, days).withColumnRenamed("split", "_split")
        rows = grid.join(rows, ["date", *CELL], "full").withColumns({
            "split": F.coalesce("split", "_split"),
            ocean: F.when(F.col("split").isNull(), F.lit(True).cast(rows.schema[ocean].dataType)).otherwise(F.col(ocean)),
        }).drop("_split")
    rows = rows.join(medians, CELL)
    features, names = [], []
    for v in numeric:
        x = standardise(F.coalesce(F.col(v), F.col(f"median_{v}")), *centre[v])
        features.append(F.when(is_ocean, x).otherwise(F.lit(0.0)).cast("float"))
        names.append(v)
        if missing_flags:
            features.append((F.col(v).isNull() & is_ocean).cast("float"))
            names.append(f"{v}_missing")
    for v in categorical:
        features.append(F.coalesce(F.col(v), F.lit(0.0)).cast("float"))
        names.append(v)
    if not features:
        raise ValueError("no input variables")
    table = rows.select(
        "date", "lat_idx", "lon_idx", "split", F.array(*features).alias("features"),
        F.col(response).cast("float").alias("y"), F.col(ocean),
    )
    return table, names


def valid_training_rows(table: DataFrame, names: list[str], ocean_feature: str = "ocean_mask") -> DataFrame:
    """Rows on the ocean channel with a response and complete features."""
    at = names.index(ocean_feature)
    complete = ~F.exists("features", lambda x: x.isNull() | F.isnan(x))
    return table.where((F.get("features", F.lit(at)) > 0.5) & F.col("y").isNotNull() & complete)


def capped_rows(df: DataFrame, key: str, max_rows: int = 300_000, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` training rows, drawn without replacement."""
    return sample_exact(df, max_rows, key, seed)


def split_rows(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def finite_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(all_present([a, b]))
