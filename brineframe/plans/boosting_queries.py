"""Boosting over shared bins on the spectra of ``model_queries``.

The histograms and the best split of the first level are SQL; ``binned_stump_profiles`` predicts group means.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators import boosting as H, splitting as T
from . import model_queries as Q, proxies as P
from .registry import query

BINS = 16


def gappy_training(spark, d) -> DataFrame:
    """Training rows with every fifth (row, band) missing."""
    rows = T.split_rows(Q.profiles(spark, d), "train")
    return rows.withColumns({c: F.when((F.col("vec_id") + i) % 5 != 0, F.col(c)) for i, c in enumerate(Q.FEATURES)})


_BINNED = f"""px AS (SELECT * FROM (SELECT vec_id, embedding, {P.hash_sql('vec_id')} / 4294967296.0 < 0.2 AS test,
 {', '.join(f'{e} AS y{i}' for i, e in enumerate(Q._LEVELS.values()))} FROM embeddings) WHERE NOT test),
cells AS (SELECT vec_id, i AS feature, CASE WHEN (vec_id + i) % 5 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS v FROM px, range({len(Q.FEATURES)}) AS r(i)),
ranked AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS rn, count(*) OVER (PARTITION BY feature) AS n FROM cells WHERE v IS NOT NULL),
edges AS (SELECT DISTINCT feature, v AS e FROM ranked, range(1, {BINS}) AS k(k) WHERE rn = ceil(n * k / {BINS}.0)),
codes AS (SELECT c.vec_id, c.feature, CASE WHEN any_value(c.v) IS NULL THEN 0 ELSE 1 + count(e.e) END AS bin
 FROM cells c LEFT JOIN edges e ON c.feature = e.feature AND e.e < c.v GROUP BY 1, 2),
ys AS (SELECT vec_id, label, log10(y) AS y FROM (SELECT vec_id, unnest([0, 1, 2]) AS label, unnest([y0, y1, y2]) AS y FROM px) WHERE y > 0),
rest AS (SELECT vec_id, label, y - round(avg(y) OVER (PARTITION BY label), 6) AS r FROM ys),
hist AS (SELECT label, feature, bin, count(*) AS n, sum(r) AS s FROM codes JOIN rest USING (vec_id) GROUP BY 1, 2, 3)"""


@query("binned_first_histograms", "M1 M2", f"""
WITH {_BINNED} SELECT label, feature, bin, n, s FROM hist
""", doubles="s", digits=4)
def binned_first_histograms(spark, d):
    """Rows and sum of residuals by (response, predictor, bin) before the first tree: the partial histograms, summed."""
    rows, edges, base, scale = H.training_blocks(gappy_training(spark, d), Q.LABELS, Q.FEATURES, "vec_id", validation=0.0, bins=BINS)
    growing = {i: H.Tree.empty(1) for i in range(len(Q.LABELS))}
    parts = H.histograms(rows, len(Q.FEATURES), [[] for _ in Q.LABELS], growing, 0, BINS + 1, scale, 1).where("node >= 0")

    def run(batches):
        for batch in batches:
            for label, at, hist in zip(*(batch.column(k).to_pylist() for k in ("label", "slice", "hist"))):
                s, n = np.frombuffer(hist, np.int64).reshape(2, -1, BINS + 1)
                f, b = np.nonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(f), label, np.int32)), pa.array((f + at).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[f, b]), pa.array(s[f, b] / scale[label])],
                    names=["label", "feature", "bin", "n", "s"])

    cells = parts.mapInArrow(run, "label int, feature int, bin int, n long, s double")
    return cells.groupBy("label", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@query("binned_first_split", "M1 M2", f"""
WITH {_BINNED}, total AS (SELECT label, feature, sum(n) AS c, sum(s) AS t, sum(n) FILTER (bin = 0) AS c0, sum(s) FILTER (bin = 0) AS s0 FROM hist GROUP BY 1, 2),
cuts AS (SELECT label, feature, bin AS cut, sum(n) OVER w AS cl, sum(s) OVER w AS sl FROM hist WHERE bin > 0 WINDOW w AS (PARTITION BY label, feature ORDER BY bin)),
sides AS (SELECT label, feature, cut, m AS missing_left, cl + m * coalesce(c0, 0) AS cl, sl + m * coalesce(s0, 0) AS sl, c, t
 FROM cuts JOIN total USING (label, feature), range(2) AS g(m)),
gains AS (SELECT label, feature, cut, missing_left, cl AS rows_left, sl * sl / cl + (t - sl) * (t - sl) / (c - cl) - t * t / c AS gain FROM sides WHERE cl > 0 AND cl < c)
SELECT label, feature, cut, CAST(missing_left AS INTEGER) AS missing_left, rows_left, gain FROM gains
QUALIFY row_number() OVER (PARTITION BY label ORDER BY gain DESC, feature, cut, missing_left) = 1
""", doubles="gain", digits=4)
def binned_first_split(spark, d):
    """Predictor, cut and side of missing values of the first split of every response."""
    rows, edges, base, scale = H.training_blocks(gappy_training(spark, d), Q.LABELS, Q.FEATURES, "vec_id", validation=0.0, bins=BINS)
    growing = {i: H.Tree.empty(1) for i in range(len(Q.LABELS))}
    parts = H.histograms(rows, len(Q.FEATURES), [[] for _ in Q.LABELS], growing, 0, BINS + 1, scale, 1).where("node >= 0")
    best = H.splits(parts, BINS + 1, 1).groupBy("label").agg(F.max_by(F.struct("feature", "cut", "missing_left", "cl", "gain"), F.struct("gain", -F.col("slice"))).alias("b"))
    unit = F.element_at(F.array(*[F.lit(s) for s in scale]), F.col("label") + 1)
    return best.select("label", "b.feature", "b.cut", "b.missing_left", F.col("b.cl").alias("rows_left"), (F.col("b.gain") / unit / unit).alias("gain"))


@query("binned_stump_profiles", "M2 M3 J9", f"""
WITH {Q._STUMP} SELECT vec_id, {Q._PROFILE} FROM px JOIN means USING (flag) WHERE test
""", doubles="chla_0 chla_1 chla_2", digits=3)
def binned_stump_profiles(spark, d):
    rows = Q.stump_rows(spark, d)
    forest = H.fit_forest(T.split_rows(rows, "train"), Q.LABELS, Q.STUMP_FEATURES, "vec_id", validation=0.0, max_iter=1, max_depth=1, learning_rate=1.0)
    scored = H.score_forest(T.split_rows(rows, "test"), forest, linear=True)
    return scored.select("vec_id", *[F.get("chla", F.lit(i)).alias(f"chla_{i}") for i in range(len(Q.LABELS))])


@query("binned_product_settings_days", "M2 M3 J9 F8", Q._FULL_SQL, texts="date")
def binned_product_settings_days(spark, d):
    """All depth bins with the product's settings, stopped when the validation error does; keys and gaps by day."""
    forest = H.fit_forest(T.split_rows(Q.profiles(spark, d), "train"), Q.LABELS, Q.FEATURES, "vec_id")
    pixels = Q.spectra(spark, d).withColumn("rrs", F.when(F.col("vec_id") % 7 != 0, F.col("rrs")))
    wide = pixels.select("date", "vec_id", *[F.get("rrs", F.lit(i)).alias(c) for i, c in enumerate(Q.FEATURES)])
    scored = H.score_forest(wide, forest, linear=True, incomplete="blank").select("date", "vec_id", "chla")
    there = [F.get("chla", F.lit(i)).isNotNull() for i in range(len(Q.LABELS))]
    counts = [c for i, has in enumerate(there) for c in (
        F.count(F.when(has, 1)).alias(f"n_{i}"), F.coalesce(F.sum(F.when(has, F.col("vec_id"))), F.lit(0)).alias(f"keys_{i}"))]
    return scored.groupBy("date").agg(F.count("*").alias("n_rows"), F.countDistinct("vec_id").alias("n_keys"), F.sum("vec_id").alias("key_sum"), *counts)
