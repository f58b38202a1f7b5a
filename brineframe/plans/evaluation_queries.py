"""Agreement metrics, peaks, daily and monthly evaluation, bias regression.

Predictions are a fixed expression of the observation here, so the metric half of the
evaluation has an oracle; scoring with trained models is in ``model_queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.neighbours import gaussian_weights, structural_similarity
from ..sources.tables import read_parquet
from . import proxies as P
from .registry import query

SCORED = P.PROFILES + """, scored AS (
 SELECT profile_id, z_idx, z, chla, log10(chla) AS t, log10(chla * 0.75 + 0.0625 * (z_idx + 1)) AS p,
  power(10, log10(chla)) AS tl, power(10, log10(chla * 0.75 + 0.0625 * (z_idx + 1))) AS pl FROM profiles WHERE chla > 0)"""
METRICS = """count(*) AS "N", 1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)) AS r2_log, sqrt(avg((t - p) * (t - p))) AS rmse_log,
 avg(t - p) AS bias_log, sqrt(avg((tl - pl) * (tl - pl))) AS rmse_lin, avg(tl - pl) AS bias_lin,
 sqrt(avg((tl - pl) * (tl - pl))) / avg(tl) AS rmse_rel, avg(tl - pl) / avg(tl) AS bias_rel,
 quantile_cont(abs(tl - pl), 0.9) AS p90_abs_err, quantile_cont(abs(tl - pl), 0.5) AS median_abs_err"""
NAMES = "r2_log rmse_log bias_log rmse_lin bias_lin rmse_rel bias_rel p90_abs_err median_abs_err"


def scored(spark, d):
    pred = F.col("chla") * 0.75 + F.lit(0.0625) * (F.col("z_idx") + 1)
    return P.profiles_long(spark, d).withColumns({
        "pred": pred, "pred_log": F.log10(pred),
        "var": F.concat(F.lit("CHLA_"), F.col("z_idx") * 10, F.lit("_"), F.col("z_idx") * 10 + 10),
    })


@query("fit_metrics", "M8 E1 E2 E4 E5 E6", f"WITH {SCORED} SELECT {METRICS} FROM scored", doubles=NAMES)
def fit_metrics(spark, d):
    rows = scored(spark, d).where(F.col("chla") > 0)
    return E.fit_metrics(rows.withColumn("t", F.log10("chla")), "t", "pred_log")


@query("depth_metrics_table", "M9 E1 E2 E4 E5 E6 E7", f"""
WITH {SCORED}, bins AS (SELECT CAST(b AS INT) AS b FROM (SELECT unnest(range(0, 8)) AS b) AS x), m AS (SELECT z_idx, {METRICS} FROM scored GROUP BY 1)
SELECT 'CHLA_' || (b * 10) || '_' || (b * 10 + 10) AS var, b * 10.0 AS z_start, b * 10.0 + 10 AS z_end, b * 10.0 + 5 AS z_center,
 coalesce(m."N", 0) AS "N", {', '.join(NAMES.split())} FROM bins LEFT JOIN m ON m.z_idx = b
""", doubles="z_start z_end z_center " + NAMES)
def depth_metrics_table(spark, d):
    # one bin more than the data has: it must come back with N = 0
    labels = P.PROFILE_LABELS + ["CHLA_70_80"]
    axis = P.DepthAxis.from_labels(labels)
    return E.depth_metrics_table(scored(spark, d), axis, labels)


_PEAK = P.PROFILES + """, scored AS (SELECT *, chla * 0.75 + 0.0625 * (z_idx + 1) AS pred, count(*) OVER (PARTITION BY profile_id) AS bins FROM profiles),
s AS (SELECT *, (coalesce(lag(chla) OVER w, chla) + chla + coalesce(lead(chla) OVER w, chla)) / 3 AS so,
 (coalesce(lag(pred) OVER w, pred) + pred + coalesce(lead(pred) OVER w, pred)) / 3 AS sp FROM scored WINDOW w AS (PARTITION BY profile_id ORDER BY z_idx)),
top AS (SELECT *, max(so) OVER (PARTITION BY profile_id) AS mo, max(sp) OVER (PARTITION BY profile_id) AS mp FROM s),
peaks AS (SELECT profile_id, max(bins) AS bins, min(CASE WHEN so = mo THEN z END) AS oz, min(CASE WHEN sp = mp THEN z END) AS pz,
 max(mo) AS ov, max(mp) AS pv, sum(chla * 10) AS oi, sum(pred * 10) AS pi_ FROM top GROUP BY 1)"""


@query("peak_comparison", "M10 W1 W2", f"""
WITH {_PEAK}
SELECT bins, count(*) AS n, count(CASE WHEN bins >= 5 THEN 1 END) AS compared,
 avg(CASE WHEN bins >= 5 THEN ov END) AS peak_obs_val, avg(CASE WHEN bins >= 5 THEN pv END) AS peak_pred_val, avg(CASE WHEN bins >= 5 THEN pv - ov END) AS peak_error_val,
 avg(CASE WHEN bins >= 5 THEN oi END) AS int_obs_0_200, avg(CASE WHEN bins >= 5 THEN pi_ END) AS int_pred_0_200, avg(CASE WHEN bins >= 5 THEN pi_ - oi END) AS int_error_0_200
FROM peaks GROUP BY 1
""", doubles="peak_obs_val peak_pred_val peak_error_val int_obs_0_200 int_pred_0_200 int_error_0_200")
def peak_comparison(spark, d):
    out = _peaks(spark, d)
    cols = ["peak_obs_val", "peak_pred_val", "peak_error_val", "int_obs_0_200", "int_pred_0_200", "int_error_0_200"]
    bins = F.size(F.filter("obs", lambda v: v.isNotNull())).cast("bigint").alias("bins")
    return out.groupBy(bins).agg(
        F.count("*").alias("n"), F.count("peak_obs_m").alias("compared"), *[F.avg(c).alias(c) for c in cols]
    )


def _peaks(spark, d):
    rows = scored(spark, d)
    bins = range(P.PROFILE_BINS)
    pick = lambda c: F.array(*[F.avg(F.when(F.col("z_idx") == i, F.col(c))) for i in bins])
    arrays = rows.groupBy("profile_id").agg(pick("chla").alias("obs"), pick("pred").alias("pred"))
    return E.peak_comparison(arrays, P.PROFILE_AXIS, min_bins=5)


@query("peak_depths_per_profile", "M10", f"""
WITH {_PEAK} SELECT profile_id, CASE WHEN bins >= 5 THEN oz END AS peak_obs_m, CASE WHEN bins >= 5 THEN ov END AS peak_obs_val,
 CASE WHEN bins >= 5 THEN pz END AS peak_pred_m, CASE WHEN bins >= 5 THEN pz - oz END AS peak_error_m FROM peaks
""", doubles="peak_obs_m peak_obs_val peak_pred_m peak_error_m")
def peak_depths_per_profile(spark, d):
    return _peaks(spark, d).select("profile_id", "peak_obs_m", "peak_obs_val", "peak_pred_m", "peak_error_m")


@query("factor_bands", "E9", f"""
WITH {SCORED}
SELECT z_idx, {', '.join(f"avg(CASE WHEN abs(t - p) <= log10({k}) THEN 1.0 ELSE 0.0 END) AS within_x{str(float(k)).replace('.', '_')}" for k in (1.25, 1.5, 2, 3))}
FROM scored GROUP BY 1
""", doubles="within_x1_25 within_x1_5 within_x2_0 within_x3_0")
def factor_bands(spark, d):
    rows = scored(spark, d).withColumn("t", F.log10("chla"))
    return E.factor_bands(rows, "t", "pred_log", keys=["z_idx"])


def _ssim_sql(weights: list[float] | None = None, size: int = 7) -> str:
    half = size // 2
    # uniform weights when none are given
    weights = weights or [1.0 / size] * size
    table = ", ".join(f"({k - half}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(weights))
    moments = ("x", "y", "xx", "yy", "xy")
    spread = size * size / (size * size - 1)
    return f"""
{P.TRUTH_PRED}, {P.MASK}, {P.DAYS}, n AS (SELECT max(lat_idx) AS last FROM mask),
st AS (SELECT date, coalesce(avg(CASE WHEN ocean THEN truth END), 0) AS mt, coalesce(avg(CASE WHEN ocean THEN pred END), 0) AS mp,
 coalesce(max(CASE WHEN ocean THEN truth END) - min(CASE WHEN ocean THEN truth END), 0) AS r FROM truth_pred GROUP BY 1),
filled AS (SELECT d.date, m.lat_idx AS i, m.lon_idx AS j, CASE WHEN st.r <> 0 THEN st.r ELSE 1.0 END AS rng,
 coalesce(CASE WHEN t.ocean THEN t.truth END, st.mt) AS x, coalesce(CASE WHEN t.ocean THEN t.pred END, st.mp) AS y
 FROM days AS d CROSS JOIN mask AS m JOIN st ON st.date = d.date
 LEFT JOIN truth_pred AS t ON t.date = d.date AND t.lat_idx = m.lat_idx AND t.lon_idx = m.lon_idx),
w AS (SELECT * FROM (VALUES {table}) AS v(k, g)),
local AS (SELECT a.date, a.i, a.j, max(a.rng) AS rng, {', '.join(f"sum(u.g * v.g * {m}) AS {n}" for n, m in zip(moments, ("b.x", "b.y", "b.x * b.x", "b.y * b.y", "b.x * b.y")))}
 FROM filled AS a, n, w AS u, w AS v, filled AS b
 WHERE a.i BETWEEN {half} AND n.last - {half} AND a.j BETWEEN {half} AND 9 - {half} AND b.date = a.date AND b.i = a.i + u.k AND b.j = a.j + v.k GROUP BY 1, 2, 3),
scores AS (SELECT date, ((2 * x * y + power(0.01 * rng, 2)) * (2 * {spread!r} * (xy - x * y) + power(0.03 * rng, 2)))
 / ((x * x + y * y + power(0.01 * rng, 2)) * ({spread!r} * (xx - x * x) + {spread!r} * (yy - y * y) + power(0.03 * rng, 2))) AS s FROM local),
ssim AS (SELECT days.date, avg(s) AS ssim FROM days LEFT JOIN scores ON scores.date = days.date GROUP BY 1)"""


_DAILY = _ssim_sql() + """, point AS (SELECT date, 1 - sum((truth - pred) * (truth - pred)) / nullif(var_pop(truth) * count(*), 0) AS r2,
 avg(abs(truth - pred)) AS mae, avg(pred - truth) AS bias, sqrt(avg((truth - pred) * (truth - pred))) AS rmse FROM truth_pred WHERE ocean GROUP BY 1),
daily AS (SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, r2, mae, bias, rmse, ssim FROM ssim LEFT JOIN point USING (date))"""


@query("daily_evaluation", "M12 E1 E2 E3 E4 E8 W3", f"WITH {_DAILY} SELECT * FROM daily", doubles="r2 mae bias rmse ssim", texts="date")
def daily_evaluation(spark, d):
    return E.daily_evaluation(P.truth_pred(spark, d), "ocean", P.lat_count(spark, d), 10)


@query("monthly_evaluation", "A26 M12", f"""
WITH {_DAILY} SELECT year, month, avg(r2) AS r2, avg(mae) AS mae, avg(bias) AS bias, avg(rmse) AS rmse, avg(ssim) AS ssim FROM daily GROUP BY 1, 2
""", doubles="r2 mae bias rmse ssim")
def monthly_evaluation(spark, d):
    return E.monthly_evaluation(E.daily_evaluation(P.truth_pred(spark, d), "ocean", P.lat_count(spark, d), 10))


@query("first_day_evaluation", "M11 A25", f"""
WITH {_DAILY} SELECT * FROM daily WHERE date IN (SELECT min(date) FROM days GROUP BY year(date), month(date))
""", doubles="r2 mae bias rmse ssim", texts="date")
def first_day_evaluation(spark, d):
    return E.selected_day_evaluation(P.truth_pred(spark, d), "ocean", P.lat_count(spark, d), 10)


@query("gaussian_structural_similarity", "W3 E8", f"""
WITH {_ssim_sql(gaussian_weights(0.6), 5)} SELECT date, ssim FROM ssim
""", doubles="ssim", texts="date")
def gaussian_structural_similarity(spark, d):
    rows = P.truth_pred(spark, d)
    sea = rows.withColumns({c: F.when(F.col("ocean"), F.col(c)) for c in ("truth", "pred")})
    return structural_similarity(sea, P.days(spark, d), P.lat_count(spark, d), 10, sigma=0.6)


_REG = P.TRUTH_PRED + """, obs AS (
 SELECT log10(l_quantity + 1e-6) AS y, log10(l_extendedprice / 1000 + 1e-6) AS x, CAST(l_linenumber AS DOUBLE) AS h FROM lineitem),
m AS (SELECT count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(h) AS mh, var_samp(x) AS vx, var_samp(h) AS vh, covar_samp(x, h) AS cxh, covar_samp(x, y) AS cxy, covar_samp(h, y) AS chy FROM obs),
fit AS (SELECT (cxy * vh - chy * cxh) / (vx * vh - cxh * cxh) AS alpha, (chy * vx - cxy * cxh) / (vx * vh - cxh * cxh) AS beta, n, mx, my, mh FROM m),
coef AS (SELECT alpha, beta, my - alpha * mx - beta * mh AS gamma, n FROM fit)"""


def _regression_rows(spark, d):
    li = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_quantity", "l_extendedprice", "l_linenumber"])
    return li.select(
        F.col("l_quantity").alias("reference"), (F.col("l_extendedprice") / 1000).alias("predicted"),
        F.col("l_linenumber").alias("solar_hour"),
    )


@query("bias_regression", "M7", f"WITH {_REG} SELECT * FROM coef", doubles="alpha beta gamma")
def bias_regression(spark, d):
    return E.bias_regression(_regression_rows(spark, d), "reference", "predicted", "solar_hour")


@query("expected_bias", "M7", f"""
WITH {_REG} SELECT CAST(h AS INT) AS solar_hour, count(*) AS n, avg(alpha * x + gamma) AS expected_log_reference, avg(alpha * x + gamma - x) AS expected_bias
FROM obs, coef GROUP BY 1
""", doubles="expected_log_reference expected_bias")
def expected_bias(spark, d):
    rows = _regression_rows(spark, d)
    out = E.expected_bias(rows, E.bias_regression(rows, "reference", "predicted", "solar_hour"), "predicted")
    return out.groupBy("solar_hour").agg(
        F.count("*").alias("n"), F.avg("expected_log_reference").alias("expected_log_reference"),
        F.avg("expected_bias").alias("expected_bias"),
    )
