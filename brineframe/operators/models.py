"""One boosted-tree regressor per depth bin: fitting and scoring with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.axes import DepthAxis
from ..functions.features import log10_positive, pow10, with_seasonal_time, with_solar_time, with_unit_sphere
from ..functions.hashing import uniform01
from ..functions.names import check_wavelengths, sort_by_depth
from .columns import column_metrics

# Fixed hyper-parameters of the published product.
MAX_DEPTH = 6
LEARNING_RATE = 0.05
MAX_ITER = 400
SEED = 42
VALIDATION_SHARE = 0.1


# stands for a missing predictor: below every real value, so one split sets it apart
MISSING = -1e30
PATIENCE = 10
TOLERANCE = 1e-7
ROWS_PER_TASK = 1 << 15  # of a pass over the training rows: boosting makes thousands, each short


def regressor(max_iter: int = MAX_ITER, max_depth: int = MAX_DEPTH, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_features", labelCol="_y", predictionCol="_pred", maxDepth=max_depth,
        stepSize=LEARNING_RATE, maxIter=max_iter, seed=seed,
    )


def pack(values: Column, flagged: bool = True) -> Column:
    """Feature vector of an array: every predictor, MISSING where it has none, then (if ``flagged``) its 0/1 missing flag."""
    filled = F.transform(values, lambda v: F.coalesce(v, F.lit(MISSING)))
    if not flagged:
        return array_to_vector(filled)
    flags = F.transform(values, lambda v: v.isNull().cast("double"))
    return array_to_vector(F.concat(filled, flags))


def assemble(df: DataFrame, features: list[str], key: str, seed: int = SEED, validation: float = VALIDATION_SHARE, flagged: bool = True) -> DataFrame:
    """Features packed once, missing predictors kept, early-stopping rows marked by hash."""
    packed = pack(F.array(*[F.col(c).cast("double") for c in features]), flagged)
    return df.withColumns({"_features": packed, "_validation": uniform01(key, f"{seed}v") < validation})


def best_prefix(errors: list[float], patience: int = PATIENCE, tolerance: float = TOLERANCE) -> int:
    """How many trees to keep: up to the best one before ``patience`` rounds without a gain over ``tolerance``."""
    best, at = float("inf"), 0
    for i, error in enumerate(errors, 1):
        if error < best - tolerance:
            best, at = error, i
        elif i - at >= patience:
            break
    return max(at, 1)


def stages(max_iter: int, patience: int = PATIENCE) -> list[int]:
    """Numbers of trees to fit in turn, each four times the last, up to ``max_iter``."""
    sizes = [max_iter]
    while sizes[0] > 8 * patience:
        sizes.insert(0, -(-sizes[0] // 4))
    return sizes


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` trees."""
    if n >= model.getNumTrees:
        return model
    sc = SparkContext.getOrCreate()
    ml = sc._jvm.org.apache.spark.ml.regression
    trees, weights = sc._gateway.new_array(ml.DecisionTreeRegressionModel, n), sc._gateway.new_array(sc._jvm.double, n)
    all_trees, all_weights = model._java_obj.trees(), model._java_obj.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    return model._copyValues(GBTRegressionModel(ml.GBTRegressionModel(model.uid, trees, weights)))


def fit_bin(assembled: DataFrame, response: str, already_log: bool = False, cache: bool = True, patience: int = PATIENCE, tolerance: float = TOLERANCE, max_iter: int = MAX_ITER, **params) -> GBTRegressionModel:
    """Fit log10 of a positive response on its own non-missing rows.

    The validation share is not fitted on; it tells after which tree the error stops
    falling, and the trees up to there are kept. A tree does not depend on the number of trees after it, so
    few are fitted first (``stages``), and more only while the error has not stopped falling: the model is the one
    of all ``max_iter`` trees cut at the same place. Boosting passes over its rows once per tree, so
    they are cached (memory, then disk) for the duration of the fit unless the caller did
    that already.
    """
    y = F.col(response) if already_log else log10_positive(response)
    rows = assembled.select("_features", "_validation", y.cast("double").alias("_y")).where(F.col("_y").isNotNull())
    if cache:
        rows.persist()
    try:
        fitted_on, held = rows.where(~F.col("_validation")), rows.where(F.col("_validation"))
        if held.isEmpty():
            return regressor(max_iter, **params).fit(fitted_on)
        for n in stages(max_iter, patience):
            model = regressor(n, **params).fit(fitted_on)
            kept = best_prefix(model.evaluateEachIteration(held, "squared"), patience, tolerance)
            if n - kept >= patience:
                break
        return first_trees(model, kept)
    finally:
        if cache:
            rows.unpersist()


def fit_depth_models(df: DataFrame, labels: list[str], features: list[str], key: str, parallel: int = 4, validation: float = VALIDATION_SHARE, rows_per_task: int = ROWS_PER_TASK, **params) -> dict[str, GBTRegressionModel]:
    """One model per depth label. The assembled frame is shared and dealt by key into as many tasks as its rows
    ask for, however few or empty the partitions of the source; fits are independent
    Spark jobs submitted from a few driver threads. Where no predictor is ever missing the flags, which are all 0 and come last,
    are left out of the passes: no tree can split on them."""
    labels = sort_by_depth(labels)
    gap = F.exists(F.array(*[F.col(c).cast("double") for c in features]), lambda v: v.isNull())
    n, gaps = df.agg(F.count("*"), F.max(gap)).first()
    dealt = df.select(*dict.fromkeys([key, *features, *labels])).repartition(max(1, -(-n // rows_per_task)), key)
    shared = assemble(dealt, features, key, validation=validation, flagged=bool(gaps)).select("_features", "_validation", *labels).persist()
    try:
        with ThreadPoolExecutor(parallel) as pool:
            fitted = list(pool.map(lambda label: fit_bin(shared, label, cache=False, **params), labels))
    finally:
        shared.unpersist()
    return dict(zip(labels, fitted))


def training_rows_used(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, rows): rows each depth model learns from or is stopped by: those with a positive response."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), log10_positive(c).alias("y")) for c in labels])
    return df.select(F.inline(pairs)).groupBy("label").agg(F.count("y").alias("rows"))


def _features_with_consts(df: DataFrame, features: list[str], consts: dict) -> Column:
    missing = [c for c in features if c not in df.columns and c not in consts]
    if missing:
        raise KeyError(f"features not in the table or the constants: {missing}")
    return F.array(*[
        F.lit(float(consts[c])) if c in consts else F.col(c).cast("double") for c in features
    ])


def with_derived_features(df: DataFrame, features: list[str], consts: dict | None = None, time: str = "time") -> DataFrame:
    """Add solar, seasonal and spherical predictors where requested and absent."""
    absent = {c for c in features if c not in df.columns and c not in (consts or {})}
    if absent & {"solar_hour", "solar_sin_time", "solar_cos_time"}:
        df = with_solar_time(df, time=time)
    if absent & {"sin_time", "cos_time"}:
        df = with_seasonal_time(df, time=time)
    if absent & {"x_geo", "y_geo", "z_geo"}:
        df = with_unit_sphere(df)
    return df


def score_depths(df: DataFrame, models: dict[str, GBTRegressionModel], features: list[str], consts: dict | None = None, linear: bool = False, out: str = "chla", incomplete: str = "predict", kind: str = "float") -> DataFrame:
    """Predictions of all depth models as one array per row, in one pass over the data.

    Rows with a missing predictor are predicted like all others ("predict"), get a NULL
    array ("blank"), or are left out ("drop"). The models are chained transforms over the
    same rows: no shuffle, one scan.
    """
    if incomplete not in ("predict", "blank", "drop"):
        raise ValueError(f"unknown rule {incomplete!r}")
    columns = df.columns
    labels = sort_by_depth(list(models))
    ready = df.withColumn("_x", _features_with_consts(df, features, consts or {}))
    ready = ready.withColumn("_whole", F.lit(incomplete == "predict") | ~F.exists("_x", lambda v: v.isNull()))
    if incomplete == "drop":
        ready = ready.where("_whole")
    scored = ready.withColumn("_features", pack(F.col("_x")))
    for i, label in enumerate(labels):
        scored = models[label].copy({models[label].predictionCol: f"_p{i}"}).transform(scored)
    values = [F.col(f"_p{i}").cast("float") for i in range(len(labels))]
    if linear:
        values = [pow10(v) for v in values]
    profile = F.array(*[v.cast(kind) for v in values])
    return scored.select(*columns, F.when(F.col("_whole"), profile).alias(out))


def score_spectra(pixels: DataFrame, models: dict[str, GBTRegressionModel], features: list[str], bands: list[float], consts: dict | None = None, rrs: str = "rrs", incomplete: str = "blank", **kw) -> DataFrame:
    """Score a grid whose predictors are one array over the wavelength axis; pixels with a gap are blank."""
    spectral = check_wavelengths(features, bands, consts)
    names = [c for c in pixels.columns if c != rrs]
    wide = pixels.select(*names, rrs, *[F.get(rrs, F.lit(i)).alias(c) for i, c in enumerate(spectral)])
    return score_depths(wide, models, features, consts, incomplete=incomplete, **kw).drop(*spectral, rrs)


def score_one(df: DataFrame, model: GBTRegressionModel, features: list[str], consts: dict | None = None, linear: bool = False, out: str = "y_pred", time: str = "time") -> DataFrame:
    """One depth model, deriving time and position predictors on demand."""
    base = df.columns
    ready = with_derived_features(df, features, consts, time)
    scored = score_depths(ready, {"BIN_0_1": model}, features, consts, linear, "_one", kind="double")
    return scored.select(*base, F.get("_one", F.lit(0)).alias(out))


def daily_product(pixels: DataFrame, models: dict[str, GBTRegressionModel], features: list[str], bands: list[float], consts: dict | None = None) -> DataFrame:
    """Spectra of any number of days -> profiles (linear scale) with column metrics."""
    axis = DepthAxis.from_labels(sort_by_depth(list(models)))
    scored = score_spectra(pixels, models, features, bands, consts, linear=True, incomplete="drop")
    return column_metrics(scored, axis, kind="float")
