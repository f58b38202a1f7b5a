"""Evaluation tables: per depth, per day, per month, per profile peak."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metrics as E
from ..functions.axes import DepthAxis
from ..functions.column import smooth
from ..functions.features import log10_positive, pow10
from .neighbours import structural_similarity
from .quality import selected_days
from .quantiles import percentile_columns


def fit_metrics(df: DataFrame, truth_log: str, pred_log: str, keys: list[str] | None = None, max_groups: int | None = None) -> DataFrame:
    """Agreement on log10 and linear scale for every key, all keys in one pass.

    Exact percentiles of the absolute error come from counted histograms, so a depth
    bin of any size stays distributed.
    """
    keys = list(keys or [])
    pairs = df.where(F.col(truth_log).isNotNull() & F.col(pred_log).isNotNull())
    pairs = pairs.select(
        *keys, F.col(truth_log).cast("double").alias("t"), F.col(pred_log).cast("double").alias("p")
    ).withColumns({"tl": pow10("t"), "pl": pow10("p")})
    mean_true = F.avg("tl")
    rel = F.when(mean_true > 0, mean_true)
    moments = pairs.groupBy(*keys).agg(
        F.count("*").alias("N"),
        E.r2("t", "p").alias("r2_log"),
        E.rmse("t", "p").alias("rmse_log"),
        E.bias_obs_minus_pred("t", "p").alias("bias_log"),
        E.rmse("tl", "pl").alias("rmse_lin"),
        E.bias_obs_minus_pred("tl", "pl").alias("bias_lin"),
        F.try_divide(E.rmse("tl", "pl"), rel).alias("rmse_rel"),
        F.try_divide(E.bias_obs_minus_pred("tl", "pl"), rel).alias("bias_rel"),
    )
    errors = pairs.select(*keys, F.abs(F.col("tl") - F.col("pl")).alias("err"))
    tails = percentile_columns(errors, "err", {"p90_abs_err": 0.9, "median_abs_err": 0.5}, keys, max_groups)
    if keys:
        return moments.join(tails, keys, "left")
    packed = tails.select(F.struct("p90_abs_err", "median_abs_err")).scalar()
    return moments.withColumns({c: packed[c] for c in ("p90_abs_err", "median_abs_err")})


def depth_metrics_table(long: DataFrame, axis: DepthAxis, labels: list[str], truth: str = "chla", pred_log: str = "pred_log", var: str = "var") -> DataFrame:
    """Metrics for every depth bin; a bin without pairs appears with N = 0."""
    scored = long.where(F.col(truth) > 0).withColumn("_t", log10_positive(truth))
    per_bin = fit_metrics(scored.where(F.col(var).isin(labels)), "_t", pred_log, [var], max_groups=len(labels))
    bins = long.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(x).alias(var), F.lit(a).alias("z_start"), F.lit(b).alias("z_end"), F.lit(c).alias("z_center"))
        for x, a, b, c in zip(labels, axis.starts, axis.ends, axis.centers)
    ])))
    return bins.join(per_bin, var, "left").na.fill(0, ["N"])


def peak_comparison(df: DataFrame, axis: DepthAxis, obs: str = "obs", pred: str = "pred", min_bins: int = 10, size: int = 3, smooth_first: bool = True, dz: float = 10.0) -> DataFrame:
    """Observed against predicted peak depth, peak value and column integral.

    ``obs`` and ``pred`` are depth-ordered arrays; only bins with an observation count,
    and profiles with fewer than ``min_bins`` of them get missing results. Everything is
    row-local: no shuffle.
    """
    bins = F.arrays_zip(F.col(obs).alias("o"), F.col(pred).alias("p"), axis.literal().alias("z"))
    valid = df.withColumn("_b", F.filter(bins, lambda b: b["o"].isNotNull()))
    enough = F.size("_b") >= min_bins
    valid = valid.withColumns({
        "_o": F.when(enough, F.transform("_b", lambda b: b["o"].cast("double"))),
        "_p": F.when(enough, F.transform("_b", lambda b: b["p"].cast("double"))),
        "_z": F.when(enough, F.transform("_b", lambda b: b["z"])),
    })
    if smooth_first:
        shaped = valid.withColumns({"_os": smooth("_o", size), "_ps": smooth("_p", size)})
    else:
        shaped = valid.withColumns({"_os": F.col("_o"), "_ps": F.col("_p")})

    def peak_at(a):
        return F.get("_z", (F.array_position(F.col(a), F.array_max(a)) - 1).cast("int"))

    def column_sum(a):
        return F.aggregate(F.col(a), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)) * F.lit(dz))

    out = shaped.withColumns({
        "peak_obs_m": peak_at("_os"), "peak_pred_m": peak_at("_ps"),
        "peak_obs_val": F.array_max("_os"), "peak_pred_val": F.array_max("_ps"),
        "int_obs_0_200": column_sum("_o"), "int_pred_0_200": column_sum("_p"),
    })
    out = out.withColumns({
        "peak_error_m": F.col("peak_pred_m") - F.col("peak_obs_m"),
        "peak_error_val": F.col("peak_pred_val") - F.col("peak_obs_val"),
        "int_error_0_200": F.col("int_pred_0_200") - F.col("int_obs_0_200"),
    })
    return out.drop("_b", "_o", "_p", "_z", "_os", "_ps")


def daily_evaluation(df: DataFrame, ocean: str, n_lat, n_lon, truth: str = "truth", pred: str = "pred", date: str = "date", days: DataFrame | None = None, **ssim) -> DataFrame:
    """r2, mae, bias and structural similarity of predicted maps, one row per day."""
    sea = F.col(ocean).cast("boolean")
    cells = df.withColumns({truth: F.when(sea, F.col(truth)), pred: F.when(sea, F.col(pred))})
    days = df.select(date).distinct() if days is None else days
    point = cells.groupBy(date).agg(
        E.r2(truth, pred).alias("r2"), E.mae(truth, pred).alias("mae"), E.bias(truth, pred).alias("bias"),
        E.rmse(truth, pred).alias("rmse"),
    )
    similar = structural_similarity(cells, days, n_lat, n_lon, truth, pred, date=date, **ssim)
    return similar.join(point, date, "left").select(
        date, F.year(date).alias("year"), F.month(date).alias("month"), "r2", "mae", "bias", "rmse", "ssim"
    )


def monthly_evaluation(daily: DataFrame) -> DataFrame:
    return daily.groupBy("year", "month").agg(*[F.avg(m).alias(m) for m in ("r2", "mae", "bias", "rmse", "ssim")])


def selected_day_evaluation(df: DataFrame, ocean: str, n_lat, n_lon, how: str = "first", **kw) -> DataFrame:
    """Daily evaluation on the selected days of every month only."""
    days = selected_days(df.select("date").distinct(), how)
    return daily_evaluation(df.join(F.broadcast(days), "date", "left_semi"), ocean, n_lat, n_lon, days=days, **kw)


def factor_bands(df: DataFrame, truth_log: str, pred_log: str, factors: tuple[float, ...] = (1.25, 1.5, 2.0, 3.0), keys: list[str] | None = None) -> DataFrame:
    """Share of predictions within each multiplicative band (1.5 is the +-50 % line)."""
    return df.groupBy(*(keys or [])).agg(*[
        E.share_within_factor(truth_log, pred_log, k).alias(f"within_x{str(k).replace('.', '_')}") for k in factors
    ])


def bias_regression(df: DataFrame, reference: str, predicted: str, hour: str, eps: float = 1e-6) -> DataFrame:
    """Least squares ``log10 reference ~ const + alpha log10 predicted + beta hour``.

    Two predictors, so the normal equations close over covariances: one aggregation,
    one row (alpha, beta, gamma, n).
    """
    y, x, h = F.log10(F.col(reference) + eps), F.log10(F.col(predicted) + eps), F.col(hour).cast("double")
    rows = df.select(y.alias("y"), x.alias("x"), h.alias("h")).dropna()
    m = rows.agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.avg("h").alias("mh"),
        F.var_samp("x").alias("vx"), F.var_samp("h").alias("vh"), F.covar_samp("x", "h").alias("cxh"),
        F.covar_samp("x", "y").alias("cxy"), F.covar_samp("h", "y").alias("chy"),
    )
    det = F.col("vx") * F.col("vh") - F.col("cxh") * F.col("cxh")
    m = m.withColumns({
        "alpha": F.try_divide(F.col("cxy") * F.col("vh") - F.col("chy") * F.col("cxh"), det),
        "beta": F.try_divide(F.col("chy") * F.col("vx") - F.col("cxy") * F.col("cxh"), det),
    })
    gamma = F.col("my") - F.col("alpha") * F.col("mx") - F.col("beta") * F.col("mh")
    return m.select("alpha", "beta", gamma.alias("gamma"), "n")


def expected_bias(df: DataFrame, fit: DataFrame, predicted: str, eps: float = 1e-6) -> DataFrame:
    """Expected log10 reference value and bias; the hour term is deliberately left out."""
    coef = fit.select(F.struct("alpha", "gamma")).scalar()
    x = F.log10(F.col(predicted) + eps)
    expected = coef["alpha"] * x + coef["gamma"]
    return df.withColumns({"expected_log_reference": expected, "expected_bias": expected - x})
