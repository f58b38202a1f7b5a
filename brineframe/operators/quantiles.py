"""Exact percentiles and exact-size samples without gathering a group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Depth bins and whole maps are groups that grow with the data,
so ranks are located by successively finer histograms instead, each a partially
aggregated count with a bounded number of buckets per group.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import hash32

COARSE = 4096  # buckets per e-fold: a relative width of about 2**-12
SHIFT = COARSE * 746  # keeps the bucket of the smallest positive double above zero
FINE = 65536
SAMPLE_BUCKET = 4096  # 2**32 hashes in 2**20 buckets

COARSE_SQL = f"""bigint(CASE WHEN _v = 0 THEN 0 WHEN _v > 0 THEN floor(ln(_v) * {COARSE}) + {SHIFT}
 ELSE -(floor(ln(-_v) * {COARSE}) + {SHIFT}) END)"""
FINE_SQL = f"bigint(coalesce(floor(try_divide(_v - _lo, _hi - _lo) * {FINE - 1}), 0))"
RANKS_SQL = "filter(_ranks, r -> r.rank >= _base AND r.rank < _base + _n)"


def _before(count: str, part: list[str], order: str) -> str:
    """SQL for the number of items ahead of a bucket in its group."""
    over = f"PARTITION BY {', '.join(f'`{c}`' for c in part) or '0'} ORDER BY {order}"
    return f"coalesce(sum({count}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


def _at_most(df: DataFrame, rows: int, message: str) -> DataFrame:
    """``df`` unchanged, or an error if it has more rows."""
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    return df.withColumn("_rows", F.when(n > rows, F.raise_error(F.lit(message))).otherwise(n)).where("_rows > 0").drop("_rows")


def exact_percentiles(df: DataFrame, value: str, ps: list[float], keys: list[str] | None = None, max_groups: int | None = None, interpolate: bool = True) -> DataFrame:
    """Rows (keys, p, value): percentiles with linear interpolation; NULL values and
    rows with a NULL key are left out. Without ``interpolate`` the value of rank ceil(p * n), a
    value of the data; p is then read as a fraction of integers.

    A logarithmic histogram finds the bucket of each rank (2**-12 wide), a linear one
    narrows it by 2**16, and what is left of it is put in order: one value where the data
    came from 32-bit floats, at most 2**24 distinct doubles in theory. All bucketings are
    monotone, so the result is exact.

    Without keys, or when the caller states how many groups there are (``max_groups``, such
    as the depth bins), the histograms come straight from the rows: only bucket counts are
    shuffled, and the located ranges, two per group and percentile, are broadcast. The
    statement is checked: more groups are an error. Otherwise the input is read once and reduced
    to distinct (keys, value) counts, a shuffle that stays even when one group holds most rows
    because the value is part of its key, and Spark chooses the joins.
    """
    keys = list(keys or [])
    groups = max_groups if keys else 1
    x = df.select(*keys, F.col(value).cast("double").alias("_v"))
    if groups is None:
        x = x.groupBy(*keys, "_v").agg(F.expr("count(1) AS _n"))
    else:
        x = x.withColumn("_n", F.lit(1).cast("bigint"))
    x = x.withColumn("_b", F.expr(COARSE_SQL))
    # stated here, above the shared exchange, so that the joins below add no filter of
    # their own and every branch plans the same exchange
    x = x.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "_v", "_b"]))
    spot = [*keys, "_b", "_lo", "_hi"]

    def holding(h: DataFrame) -> DataFrame:
        """Ranges that hold a wanted rank, each with just those ranks."""
        return h.withColumn("_ranks", F.expr(RANKS_SQL)).where("size(_ranks) > 0").select(*spot, "_base", "_ranks")

    def members(ranges: DataFrame) -> DataFrame:
        if groups is not None:
            ranges = F.broadcast(_at_most(ranges, 2 * len(ps) * groups, f"more than the {groups} groups stated"))
        return x.join(ranges, [*keys, "_b"]).where("_v >= _lo AND _v <= _hi")

    h1 = x.groupBy(*keys, "_b").agg(F.expr("sum(_n) AS _n"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi"))
    group = ", ".join(f"`{c}`" for c in keys) or "0"
    h1 = h1.select("*", F.expr(f"sum(_n) OVER (PARTITION BY {group}) AS _all"), F.expr(_before("_n", keys, "_b")).alias("_base"))

    def ranked(p: float, fn: str) -> str:
        if interpolate:
            return f"'rank', {fn}({p!r}D * (_all - 1)), 'frac', {p!r}D * (_all - 1) - floor({p!r}D * (_all - 1))"
        share = Fraction(p).limit_denominator(1_000_000)
        return f"'rank', greatest(ceil(_all * {share.numerator}D / {share.denominator}D) - 1, 0L), 'frac', 0D"

    wanted = ", ".join(
        f"named_struct('p', {float(p)!r}D, 'side', '{side}', {ranked(float(p), fn)})"
        for p in ps for side, fn in (("lo", "floor"), ("hi", "ceil"))
    )
    coarse = holding(h1.withColumn("_ranks", F.expr(f"array({wanted})")))

    parts = members(coarse).withColumn("_f", F.expr(FINE_SQL)).groupBy(*spot, "_f").agg(
        F.expr("sum(_n) AS _n"), F.expr("min(_v) AS _lo2"), F.expr("max(_v) AS _hi2"),
        F.expr("first(_base) AS _base"), F.expr("first(_ranks) AS _ranks"),
    )
    parts = parts.withColumn("_base", F.expr(f"_base + {_before('_n', spot, '_f')}"))
    fine = holding(parts.drop("_lo", "_hi").withColumnsRenamed({"_lo2": "_lo", "_hi2": "_hi"}))

    # a range with a single value is settled; in the others the values are ordered
    settled = fine.where("_lo = _hi").select(*keys, F.expr("inline(_ranks)"), F.expr("_lo AS _v"))
    counted = members(fine.where("_lo < _hi")).groupBy(*spot, "_v").agg(
        F.expr("sum(_n) AS _n"), F.expr("first(_base) AS _base"), F.expr("first(_ranks) AS _ranks"))
    ordered = counted.withColumn("_base", F.expr(f"_base + {_before('_n', spot, '_v')}"))
    ordered = ordered.select(*keys, F.expr(f"inline({RANKS_SQL})"), "_v")
    return settled.unionByName(ordered).groupBy(*keys, "p").agg(F.expr(
        "max(CASE WHEN side = 'lo' THEN _v END) * (1 - max(frac)) + max(CASE WHEN side = 'hi' THEN _v END) * max(frac)"
    ).alias(value))


def percentile_columns(df: DataFrame, value: str, named: dict[str, float], keys: list[str] | None = None, max_groups: int | None = None) -> DataFrame:
    """One row per key with one column per named percentile."""
    keys = list(keys or [])
    rows = exact_percentiles(df, value, sorted(set(named.values())), keys, max_groups)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col(value))).alias(name) for name, p in named.items()]
    )


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all rows if fewer), the same under any partitioning.

    Rows are ordered by (hash of key, key), so ``key`` must identify the row: rows with a
    NULL key are never drawn, and rows that share the key of the last place come all or not
    at all where the hash decides, so a repeated key can only shift the size by its own copies.
    Only the key column is counted, to find the last pair that belongs to the sample: a
    histogram of 2**20 hash buckets, a second one over the hashes of the bucket that is cut,
    then the order of the keys of that one hash. The rows themselves pass a plain filter and are
    never shuffled.
    """
    if n <= 0:
        return df.limit(0)
    h, named = hash32(key, seed), F.col(key).isNotNull()
    bucket = F.floor(h / F.lit(SAMPLE_BUCKET)).cast("int")

    def held(counts: DataFrame, by: str, before: Column) -> DataFrame:
        """The bucket in which place ``n`` falls, and the rows ahead of it."""
        running = W.partitionBy(F.lit(0)).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("base", before + F.coalesce(F.sum("_n").over(running), F.lit(0)))
        return counts.where((F.col("base") < n) & (F.col("base") + F.col("_n") >= n))

    whole = df.where(named).select(F.count("*").alias("rows")).scalar()
    cut = held(df.where(named).groupBy(bucket.alias("b")).agg(F.count("*").alias("_n")), "b", F.lit(0)).select(F.struct("b", "base")).scalar()
    inside = df.where(named & (bucket == cut["b"])).groupBy(h.alias("h")).agg(F.count("*").alias("_n"))
    fine = held(inside, "h", cut["base"]).select(F.struct("h", "base")).scalar()
    order = W.partitionBy(F.lit(0)).orderBy("k")
    last = df.where(named & (h == fine["h"])).select(h.alias("h"), F.col(key).alias("k"))
    last = last.withColumn("r", F.row_number().over(order)).where(F.col("r") == F.lit(n) - fine["base"])
    last = last.select(F.struct("h", "k")).scalar()
    # with n rows or fewer all stay; else there is a last pair
    return df.where(named & ((whole <= n) | (F.struct(h.alias("h"), F.col(key).alias("k")) <= last)))
