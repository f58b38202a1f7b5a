"""Global and per-variable attributes as a (var, key, value) table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.axes import RegularAxis

GLOBAL = ""

# Fixed attribute values of the published product.
VARIABLE_ATTRIBUTES = {
    "chla": {
        "units": "mg m-3",
        "long_name": "Chlorophyll-a concentration",
        "standard_name": "mass_concentration_of_chlorophyll_a_in_sea_water",
    },
    "chla_int_0_200": {"units": "mg m-2", "long_name": "Depth-integrated chlorophyll-a"},
    "chla_peak": {
        "units": "mg m-3",
        "long_name": "Peak chlorophyll-a concentration in the water column",
        "standard_name": "mass_concentration_of_chlorophyll_a_in_sea_water",
    },
    "chla_peak_depth": {"units": "m", "long_name": "Depth of peak chlorophyll-a", "positive": "down"},
    "chla_depth_center_of_mass": {
        "units": "m", "long_name": "Chlorophyll-a depth center of mass", "positive": "down",
    },
    "z_thickness": {"units": "m", "long_name": "Layer thickness"},
}


def attribute_table(spark: SparkSession, attributes: dict[str, dict]) -> DataFrame:
    """Attributes as rows; values become text, anything structured becomes JSON."""
    rows = [
        (var, key, value if isinstance(value, str) else json.dumps(value, default=str))
        for var, entries in attributes.items() for key, value in entries.items()
    ]
    return spark.createDataFrame(rows, "var string, key string, value string")


def coverage(cells: DataFrame, lat: RegularAxis, lon: RegularAxis, date: str = "date") -> DataFrame:
    """Global attributes that state what a table of cells covers: first and last day, outermost labels.

    A table without cells states no coverage.
    """
    rows, columns = lat.label("lat_idx"), lon.label("lon_idx")
    facts = cells.agg(
        F.min(date).cast("string").alias("time_coverage_start"), F.max(date).cast("string").alias("time_coverage_end"),
        F.min(rows).cast("string").alias("geospatial_lat_min"), F.max(rows).cast("string").alias("geospatial_lat_max"),
        F.min(columns).cast("string").alias("geospatial_lon_min"), F.max(columns).cast("string").alias("geospatial_lon_max"),
    )
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in facts.columns])
    return facts.select(F.lit(GLOBAL).alias("var"), F.inline(entries)).where("value IS NOT NULL")


def fill_defaults(attrs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Existing non-empty values win; empty or absent ones take the default."""
    own = attrs.withColumn("value", F.when(F.trim("value") != "", F.col("value")))
    base = defaults.withColumnRenamed("value", "default")
    both = own.join(base, ["var", "key"], "full")
    return both.select("var", "key", F.coalesce("value", "default").alias("value"))


def override(attrs: DataFrame, updates: DataFrame) -> DataFrame:
    """New values replace old ones."""
    kept = attrs.join(updates, ["var", "key"], "left_anti")
    return kept.unionByName(updates)


def drop_keys(attrs: DataFrame, keys: list[str]) -> DataFrame:
    return attrs.where(~F.col("key").isin(list(keys)))


def attach(df: DataFrame, attributes: dict[str, dict]) -> DataFrame:
    """Column metadata, which Parquet keeps with the table."""
    for name, entries in attributes.items():
        if name in df.columns:
            df = df.withMetadata(name, df.schema[name].metadata | entries)
    return df


def as_dict(attrs: DataFrame) -> dict[str, dict[str, str]]:
    """The attributes by variable. The table has a few rows per variable, whatever the size of the cube."""
    out: dict[str, dict[str, str]] = {}
    for var, key, value in attrs.select("var", "key", "value").collect():
        out.setdefault(var, {})[key] = value
    return out


def attached(df: DataFrame) -> DataFrame:
    """(var, key, value) of the metadata that the columns of a table carry."""
    rows = [(f.name, key, str(value)) for f in df.schema.fields for key, value in f.metadata.items()]
    return df.sparkSession.createDataFrame(rows, "var string, key string, value string")
