"""Nearest position on an axis that is a table: a two-sided as-of join without a list or a broadcast axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import shared_dir
from ..sources.tables import staged


def bracketed(values: DataFrame, axis: DataFrame, label: str = "label", position: str = "idx", parts: int | None = None, stage: str | None = None) -> DataFrame:
    """``value, below, below_pos, above, above_pos``: the labels around each distinct value.

    ``values`` has one column. Its distinct values and the distinct labels are dealt into
    ``parts`` ranges (``spark.sql.shuffle.partitions`` by default) and written once. Inside a
    range the last label is carried forward and the next one backward; the outermost labels of
    each range, one row per range, are carried over the ranges and fill what a range lacks at its
    edges. A value that is a label has itself on both sides. Missing values and labels
    take no part; of equal labels the smallest position counts.
    """
    spark = axis.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def known(df, column):
        x = F.col(column).cast("double")
        return df.withColumn("v", x).where(x.isNotNull() & ~F.isnan(x))

    labels = known(axis, label).groupBy("v").agg(F.min(position).alias("pos")).select("v", "pos", F.lit(0).alias("asked"))
    asked = known(values, values.columns[0]).select("v").distinct()
    both = labels.unionByName(asked.withColumn("asked", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, stage or shared_dir(spark, "asof"))
    mark = F.when(F.col("asked") == 0, F.struct("v", "pos"))

    def carried(order, name):
        # labels before values in either direction; rows of one range only
        rows = W.partitionBy("part").orderBy(order, "asked").rowsBetween(W.unboundedPreceding, W.currentRow)
        return F.last(mark, ignorenulls=True).over(rows).alias(name)

    inside = dealt.select("v", "asked", "part", carried(F.asc("v"), "lo"), carried(F.desc("v"), "hi")).where("asked = 1")
    # one row per range: ``parts`` rows at most
    edges = dealt.groupBy("part").agg(F.min(mark).alias("first"), F.max(mark).alias("last"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    later = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(
        "part", F.last("last", ignorenulls=True).over(earlier).alias("before"),
        F.last("first", ignorenulls=True).over(later).alias("after"),
    )
    found = inside.join(F.broadcast(edges), "part")
    lo, hi = F.coalesce("lo", "before"), F.coalesce("hi", "after")
    return found.select(
        F.col("v").alias("value"), lo["v"].alias("below"), lo["pos"].alias("below_pos"),
        hi["v"].alias("above"), hi["pos"].alias("above_pos"),
    )


def nearest_on_axis(df: DataFrame, q: str, axis: DataFrame, out: str = "idx", tie: str = "left", label: str = "label", position: str = "idx", parts: int | None = None, stage: str | None = None) -> DataFrame:
    """``df`` with the position of the nearest label of an axis table, ascending or descending.

    ``tie``: "left" takes the smaller position, "larger" the larger label. Missing for a
    missing value and for an axis without labels. Values outside the axis get its end.
    """
    if tie not in ("left", "larger"):
        raise ValueError(f"unknown tie rule {tie!r}")
    found = bracketed(df.select(q), axis, label, position, parts, stage)
    left, right = F.col("value") - F.col("below"), F.col("above") - F.col("value")
    at_tie = F.col("above_pos") if tie == "larger" else F.least("below_pos", "above_pos")
    near = (
        F.when(F.col("below").isNull(), F.col("above_pos")).when(F.col("above").isNull(), F.col("below_pos"))
        .when(left < right, F.col("below_pos")).when(left > right, F.col("above_pos")).otherwise(at_tie)
    )
    chosen = found.select(F.col("value").alias("_value"), near.alias("_near"))
    kept = [c for c in df.columns if c != out]
    joined = df.withColumn("_key", F.col(q).cast("double")).join(chosen, F.col("_key") == F.col("_value"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col("_near").alias(out))
