"""Fitting and scoring with trained models.

Spectra come from the embeddings table; the response of each depth bin is derived from
the label. Tree counts are small here but in ``product_settings_days``, the operators default to the product's values.
Boosted trees have no SQL equivalent, so those queries are checked by rows only. The ``stump_*``
queries run the same operators with one tree of depth 1 on a two-valued band and without a
validation share: such a model predicts group means, which SQL computes.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.features import log10_positive
from ..functions.hashing import uniform01
from ..operators import evaluate as E, models as M, selection, splitting as T
from ..operators.columns import to_long
from ..session import shared_dir
from ..sources.bundle import load_bundle, save_bundle
from ..sources.tables import read_parquet, staged
from . import proxies as P
from .registry import query
from .training_queries import training_rows

BANDS = [400.0 + 5 * i for i in range(64)]
FEATURES = [f"pace_Rrs_{int(b)}" for b in BANDS]
LABELS = ["CHLA_0_10", "CHLA_10_20", "CHLA_20_30"]
SMALL = {"max_iter": 4, "max_depth": 3}

_FITTED: dict = {}


def spectra(spark, d):
    """Row per pixel: date, cell, spectrum, label; 100 cells a day."""
    v = F.col("vec_id")
    table = read_parquet(spark, f"{d}/embeddings.parquet", columns=["vec_id", "embedding", "label"])
    return table.select(
        "vec_id", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(v / 100).cast("int") * 10).alias("date"),
        (F.floor(v / 10) % 10).cast("int").alias("lat_idx"), (v % 10).cast("int").alias("lon_idx"),
        F.col("embedding").alias("rrs"), (F.col("label") + 1.0).alias("level"),
    )


def profiles(spark, d):
    """Training rows: bands as columns and a nullable response per depth bin."""
    wide = selection.bands_to_columns(spectra(spark, d), "rrs", BANDS, "pace_Rrs_")
    y = F.col("level")
    rows = wide.withColumns({
        LABELS[0]: y, LABELS[1]: y * 0.5 + 1, LABELS[2]: F.when(F.col("vec_id") % 5 != 0, 12 - y),
    })
    return T.row_split(rows, "vec_id")


def depth_models(spark, d):
    """The model set, fitted once per session and data folder."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _FITTED:
        train = T.split_rows(profiles(spark, d), "train")
        _FITTED[at] = M.fit_depth_models(train, LABELS, FEATURES, "vec_id", **SMALL)
    return _FITTED[at]


def forget_models() -> None:
    """Drop the fitted models, so that the next query fits again."""
    _FITTED.clear()


@query("single_bin_model_fit", "M1 M8")
def single_bin_model_fit(spark, d):
    rows = profiles(spark, d)
    model = M.fit_bin(M.assemble(T.split_rows(rows, "train"), FEATURES, "vec_id"), LABELS[0], **SMALL)
    scored = M.score_one(T.split_rows(rows, "test"), model, FEATURES, out="pred_log")
    return E.fit_metrics(scored.withColumn("t", log10_positive(LABELS[0])), "t", "pred_log")


@query("depth_model_metrics", "M2 M3 M9 J9 J11")
def depth_model_metrics(spark, d):
    test = T.split_rows(profiles(spark, d), "test")
    scored = M.score_depths(test, depth_models(spark, d), FEATURES, out="pred", kind="double")
    axis = M.DepthAxis.from_labels(LABELS)
    predicted = to_long(scored.select("vec_id", "pred"), axis, "pred").select("vec_id", "z", F.col("pred").alias("pred_log"))
    observed = selection.wide_to_long(test.select("vec_id", *LABELS), ["vec_id"])
    return E.depth_metrics_table(observed.join(predicted, ["vec_id", "z"]), axis, LABELS)


@query("scored_day_profiles", "M3 J9 F8")
def scored_day_profiles(spark, d):
    gappy = F.when(F.col("vec_id") % 7 != 0, F.col("rrs"))
    pixels = spectra(spark, d).withColumn("rrs", gappy)
    scored = M.score_spectra(pixels, depth_models(spark, d), FEATURES, BANDS, linear=True)
    return scored.select("date", "lat_idx", "lon_idx", *[F.get("chla", F.lit(i)).alias(f"chla_{i}") for i in range(3)])


@query("single_depth_with_derived_features", "M4 F1 F2 F3")
def single_depth_with_derived_features(spark, d):
    names = ["pace_Rrs_400", "pace_Rrs_405", "solar_hour", "sin_time", "cos_time", "x_geo", "y_geo", "z_geo", "type"]
    located = profiles(spark, d).withColumns({
        "time": F.col("date").cast("timestamp_ntz") + F.expr("interval 11 hours"),
        "lat": 70.0 - F.col("lat_idx"), "lon": P.CUBE_LON.label("lon_idx"), "type": F.lit(0.0),
    })
    train = M.with_derived_features(T.split_rows(located, "train"), names)
    model = M.fit_bin(M.assemble(train, names, "vec_id"), LABELS[0], **SMALL)
    scored = M.score_one(T.split_rows(located, "test"), model, names, {"type": 1.0}, linear=True)
    return scored.select("vec_id", "y_pred")


@query("predicted_profile_peaks", "M5 M10")
def predicted_profile_peaks(spark, d):
    test = T.split_rows(profiles(spark, d), "test").withColumn("obs", F.array(*LABELS))
    scored = M.score_depths(test, depth_models(spark, d), FEATURES, linear=True, out="pred", kind="double")
    peaks = E.peak_comparison(scored, M.DepthAxis.from_labels(LABELS), min_bins=3)
    return peaks.select("vec_id", "peak_obs_m", "peak_pred_m", "peak_error_m", "int_error_0_200")


@query("daily_product", "M6 A6")
def daily_product(spark, d):
    out = M.daily_product(spectra(spark, d).drop("level"), depth_models(spark, d), FEATURES, BANDS)
    return out.drop("chla", "vec_id")


def _maps(spark, d):
    model = {LABELS[0]: depth_models(spark, d)[LABELS[0]]}
    scored = M.score_depths(profiles(spark, d), model, FEATURES, linear=True, out="_p", kind="double")
    return scored.select(
        "date", "lat_idx", "lon_idx", F.col("level").alias("truth"), F.get("_p", F.lit(0)).alias("pred"),
        P.is_ocean().alias("ocean"),
    )


@query("model_daily_evaluation", "M12 E8")
def model_daily_evaluation(spark, d):
    return E.daily_evaluation(_maps(spark, d), "ocean", 10, 10)


@query("model_selected_day_evaluation", "M11 A25")
def model_selected_day_evaluation(spark, d):
    return E.selected_day_evaluation(_maps(spark, d), "ocean", 10, 10)


@query("model_from_split_table", "M13 L6 L8")
def model_from_split_table(spark, d):
    table, names = training_rows(spark, d)
    # boosting and its evaluation read the table many times
    table = staged(table, shared_dir(spark))
    train = T.valid_training_rows(T.split_rows(table, "train"), names)
    key = F.concat_ws("/", F.col("date").cast("string"), "lat_idx", "lon_idx")
    capped = T.capped_rows(train.withColumn("key", key), "key").withColumns({
        "_features": array_to_vector(F.col("features").cast("array<double>")),
        "_validation": uniform01("key", "42v") < M.VALIDATION_SHARE,
    })
    model = M.fit_bin(capped, "y", already_log=True, **SMALL)
    test = T.valid_training_rows(T.split_rows(table, "test"), names)
    scored = model.transform(test.withColumn("_features", array_to_vector(F.col("features").cast("array<double>"))))
    return E.fit_metrics(scored, "y", "_pred")


@query("reloaded_model_bundle", "S13 J11 M3")
def reloaded_model_bundle(spark, d):
    path = shared_dir(spark)
    save_bundle(depth_models(spark, d), profiles(spark, d), FEATURES, path, seed=M.SEED)
    bundle = load_bundle(spark, path)
    test = T.split_rows(bundle.dataset, "test")
    scored = M.score_depths(test, bundle.models, bundle.meta["feature_cols"], linear=True)
    return scored.select("vec_id", *[F.get("chla", F.lit(i)).alias(f"chla_{i}") for i in range(3)])


_FULL_SQL = f"""
SELECT DATE '2024-01-01' + CAST(floor(vec_id / 100) * 10 AS INT) AS date, count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys, sum(vec_id) AS key_sum,
 {', '.join(f"count(*) FILTER (vec_id % 7 <> 0) AS n_{i}, coalesce(sum(vec_id) FILTER (vec_id % 7 <> 0), 0) AS keys_{i}" for i in range(len(LABELS)))}
FROM embeddings GROUP BY 1
"""


@query("product_settings_days", "M2 M3 J9 F8", _FULL_SQL, texts="date")
def product_settings_days(spark, d):
    """All depth bins fitted with the product's settings (MAX_ITER, MAX_DEPTH), the whole table scored; keys and gaps by day."""
    train = T.split_rows(profiles(spark, d), "train")
    models = M.fit_depth_models(train, LABELS, FEATURES, "vec_id")
    pixels = spectra(spark, d).withColumn("rrs", F.when(F.col("vec_id") % 7 != 0, F.col("rrs")))
    scored = M.score_spectra(pixels, models, FEATURES, BANDS, linear=True)
    key = F.floor(F.datediff("date", F.lit("2024-01-01")) / 10) * 100 + F.col("lat_idx") * 10 + F.col("lon_idx")
    scored = scored.select("date", key.alias("vec_id"), "chla")
    there = [F.get("chla", F.lit(i)).isNotNull() for i in range(len(LABELS))]
    counts = [c for i, has in enumerate(there) for c in (
        F.count(F.when(has, 1)).alias(f"n_{i}"), F.coalesce(F.sum(F.when(has, F.col("vec_id"))), F.lit(0)).alias(f"keys_{i}"))]
    return scored.groupBy("date").agg(F.count("*").alias("n_rows"), F.countDistinct("vec_id").alias("n_keys"), F.sum("vec_id").alias("key_sum"), *counts)


STUMP = {"max_iter": 1, "max_depth": 1}
STUMP_BANDS = [400.0, 405.0]
STUMP_FEATURES = FEATURES[:2]
_LEVELS = {LABELS[0]: "(label + 1.0)", LABELS[1]: "((label + 1.0) * 0.5 + 1)", LABELS[2]: "CASE WHEN vec_id % 5 <> 0 THEN 11.0 - label END"}
_STUMP = f"""px AS (SELECT *, CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END AS flag, DATE '2024-01-01' + CAST(floor(vec_id / 100) * 10 AS INT) AS date,
 CAST(floor(vec_id / 10) % 10 AS INT) AS lat_idx, CAST(vec_id % 10 AS INT) AS lon_idx,
 {P.hash_sql('vec_id')} / 4294967296.0 < 0.2 AS test, {', '.join(f'{e} AS y{i}' for i, e in enumerate(_LEVELS.values()))} FROM embeddings),
means AS (SELECT flag, {', '.join(f'avg(CASE WHEN y{i} > 0 THEN log10(y{i}) END) AS m{i}' for i in range(3))} FROM px WHERE NOT test GROUP BY 1)"""


def stump_rows(spark, d):
    """Pixels whose spectrum has one two-valued band, with the responses of ``profiles``."""
    band = (F.col("level") % 2 == 0).cast("float")
    pixels = spectra(spark, d).withColumn("rrs", F.array(band, F.lit(0.5).cast("float")))
    wide = pixels.withColumns({c: F.get("rrs", F.lit(i)) for i, c in enumerate(STUMP_FEATURES)})
    y = F.col("level")
    rows = wide.withColumns({LABELS[0]: y, LABELS[1]: y * 0.5 + 1, LABELS[2]: F.when(F.col("vec_id") % 5 != 0, 12 - y)})
    return T.row_split(rows, "vec_id")


def stump_models(rows):
    return M.fit_depth_models(T.split_rows(rows, "train"), LABELS, STUMP_FEATURES, "vec_id", validation=0.0, **STUMP)


@query("training_rows_used", "M1 M2", f"""
WITH {_STUMP} SELECT label, rows FROM (SELECT {', '.join(f"count(CASE WHEN y{i} > 0 THEN 1 END) AS {c}" for i, c in enumerate(LABELS))} FROM px WHERE NOT test)
UNPIVOT (rows FOR label IN ({', '.join(LABELS)}))
""")
def training_rows_used(spark, d):
    """A missing predictor costs no row: only the response counts."""
    rows = profiles(spark, d).withColumn(FEATURES[0], F.when(F.col("vec_id") % 3 != 0, F.col(FEATURES[0])))
    return M.training_rows_used(T.split_rows(rows, "train"), LABELS)


@query("stump_single_depth", "M1 M4", f"""
WITH {_STUMP} SELECT vec_id, m0 AS y_pred FROM px JOIN means USING (flag)
""", doubles="y_pred", digits=4)
def stump_single_depth(spark, d):
    rows = stump_rows(spark, d)
    train = M.assemble(T.split_rows(rows, "train"), STUMP_FEATURES, "vec_id", validation=0.0)
    model = M.fit_bin(train, LABELS[0], **STUMP)
    return M.score_one(rows, model, STUMP_FEATURES).select("vec_id", "y_pred")


_PROFILE = ", ".join(f"pow(10, m{i}) AS chla_{i}" for i in range(3))


@query("stump_row_profiles", "M2 M5 J9", f"""
WITH {_STUMP} SELECT vec_id, {_PROFILE} FROM px JOIN means USING (flag) WHERE test
""", doubles="chla_0 chla_1 chla_2", digits=3)
def stump_row_profiles(spark, d):
    rows = stump_rows(spark, d)
    scored = M.score_depths(T.split_rows(rows, "test"), stump_models(rows), STUMP_FEATURES, linear=True)
    return scored.select("vec_id", *[F.get("chla", F.lit(i)).alias(f"chla_{i}") for i in range(3)])


@query("stump_day_profiles", "M3 J9 F8", f"""
WITH {_STUMP} SELECT date, lat_idx, lon_idx, {', '.join(f"CASE WHEN vec_id % 7 <> 0 THEN pow(10, m{i}) END AS chla_{i}" for i in range(3))} FROM px JOIN means USING (flag)
""", doubles="chla_0 chla_1 chla_2", texts="date", digits=3)
def stump_day_profiles(spark, d):
    rows = stump_rows(spark, d)
    gappy = rows.select("vec_id", "date", "lat_idx", "lon_idx", F.when(F.col("vec_id") % 7 != 0, F.col("rrs")).alias("rrs"))
    scored = M.score_spectra(gappy, stump_models(rows), STUMP_FEATURES, STUMP_BANDS, linear=True)
    return scored.select("date", "lat_idx", "lon_idx", *[F.get("chla", F.lit(i)).alias(f"chla_{i}") for i in range(3)])


@query("stump_daily_product", "M6 A6", f"""
WITH {_STUMP}, p AS (SELECT date, lat_idx, lon_idx, {_PROFILE} FROM px JOIN means USING (flag))
SELECT date, lat_idx, lon_idx, (chla_0 + chla_1 + chla_2) * 10 AS chla_int, greatest(chla_0, chla_1, chla_2) AS chla_peak,
 CASE WHEN chla_0 >= greatest(chla_1, chla_2) THEN 5.0 WHEN chla_1 >= chla_2 THEN 15.0 ELSE 25.0 END AS chla_peak_depth FROM p
""", doubles="chla_int chla_peak chla_peak_depth", texts="date", digits=2)
def stump_daily_product(spark, d):
    rows = stump_rows(spark, d)
    out = M.daily_product(rows.select("date", "lat_idx", "lon_idx", "rrs"), stump_models(rows), STUMP_FEATURES, STUMP_BANDS)
    names = [c for c in out.columns if c in ("chla_int_0_200", "chla_int")]
    return out.select("date", "lat_idx", "lon_idx", F.col(names[0]).alias("chla_int"), "chla_peak", "chla_peak_depth")


@query("stump_reloaded_bundle", "S13 J11 M3", f"""
WITH {_STUMP} SELECT vec_id, {_PROFILE} FROM px JOIN means USING (flag) WHERE test
""", doubles="chla_0 chla_1 chla_2", digits=3)
def stump_reloaded_bundle(spark, d):
    path, rows = shared_dir(spark), stump_rows(spark, d)
    save_bundle(stump_models(rows), rows, STUMP_FEATURES, path, seed=M.SEED)
    bundle = load_bundle(spark, path)
    scored = M.score_depths(T.split_rows(bundle.dataset, "test"), bundle.models, bundle.meta["feature_cols"], linear=True)
    return scored.select("vec_id", *[F.get("chla", F.lit(i)).alias(f"chla_{i}") for i in range(3)])
