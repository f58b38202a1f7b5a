"""Hand-made tables for the traps: ties, empties, edges, thresholds."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineframe.functions import column as C, names as N
from brineframe.functions.axes import DepthAxis, RegularAxis, tile_id
from brineframe.functions.features import standardise, with_seasonal_time, with_solar_time
from brineframe.functions.missing import clean_floats, finite_or_null
from brineframe.functions.text import date_token, like_glob, version_token
from brineframe.operators import columns, evaluate as E, gridagg, indicators as I, matchup as M, neighbours, quality as Q
from brineframe.operators import selection as S, splitting as T
from brineframe.operators.quantiles import exact_percentiles, sample_exact

NAN = float("nan")
AXIS4 = DepthAxis.uniform(4)


def one(df, *cols):
    row = df.select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def profile(spark, values):
    return spark.createDataFrame([(values,)], "chla array<double>")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def day(n, month=1):
    return dt.date(2024, month, n)


# --- missing values ---------------------------------------------------------------

def test_nan_and_inf_become_missing(spark):
    df = spark.createDataFrame([(NAN, [1.0, NAN]), (2.0, None)], "a double, b array<double>")
    assert sorted(clean_floats(df).collect(), key=str) == sorted([(None, [1.0, None]), (2.0, None)], key=str)
    inf = spark.createDataFrame([(math.inf,), (NAN,), (1.0,)], "a double")
    assert [r[0] for r in inf.select(finite_or_null("a")).collect()] == [None, None, 1.0]


# --- column metrics ----------------------------------------------------------------

def test_first_maximum_wins(spark):
    out = columns.column_metrics(profile(spark, [1.0, 5.0, 5.0, 2.0]), AXIS4)
    assert one(out, "chla_peak_depth") == 15.0
    assert one(out, "chla_int_0_200") == 130.0
    assert one(out, "chla_depth_center_of_mass") == pytest.approx((5 + 75 + 125 + 70) / 13)


@pytest.mark.parametrize("values", [[None] * 4, [0.0] * 4, None])
def test_no_positive_total_means_missing(spark, values):
    df = profile(spark, values)
    out = columns.column_metrics(df, AXIS4)
    assert one(out, "chla_int_0_200", "chla_peak", "chla_peak_depth", "chla_depth_center_of_mass") == (None,) * 4
    assert one(df.select(C.total("chla", 4).alias("t")), "t") == 0.0


def test_long_and_array_forms_agree(spark):
    data = [(1, 0, 1.0), (1, 1, 5.0), (1, 2, 5.0), (2, 0, None), (2, 1, 0.0), (3, 3, 2.0)]
    long = spark.createDataFrame(data, "k int, z_idx int, chla double")
    arrays = columns.column_metrics(columns.depth_arrays(long, ["k"], 4), AXIS4)
    axis = long.withColumns({"z": F.col("z_idx") * 10.0 + 5, "z_thickness": F.lit(10.0)})
    names = ["k", "chla_int_0_200", "chla_peak", "chla_peak_depth", "chla_depth_center_of_mass"]
    assert rows(arrays, *names) == rows(columns.column_metrics_long(axis, ["k"]), *names)


def test_scaling_scales_amounts_and_keeps_depths(spark):
    rng = random.Random(1)
    data = [([rng.choice([None, rng.random()]) for _ in range(4)],) for _ in range(50)]
    df = spark.createDataFrame(data, "chla array<double>")
    twice = df.withColumn("chla", F.transform("chla", lambda v: v * 4))
    a = columns.column_metrics(df, AXIS4).collect()
    b = columns.column_metrics(twice, AXIS4).collect()
    for x, y in zip(a, b):
        if x["chla_peak"] is None:
            assert y["chla_peak"] is None
            continue
        assert y["chla_int_0_200"] == pytest.approx(4 * x["chla_int_0_200"])
        assert y["chla_peak_depth"] == x["chla_peak_depth"]
        assert y["chla_depth_center_of_mass"] == pytest.approx(x["chla_depth_center_of_mass"])


def test_thickness_falls_back_to_ten_metres():
    assert DepthAxis.from_labels(["odd", "CHLA_0_5"]).thickness == (10.0, 5.0)
    with pytest.raises(ValueError):
        DepthAxis.from_labels(["CHLA_0_5"], centers=[1.0, 2.0])


def test_partial_bin_integral(spark):
    df = profile(spark, [1.0, 2.0, None, 4.0]).withColumn("mld", F.lit(15.0))
    assert one(df.select(I.integral_to("chla", AXIS4, "mld").alias("x")), "x") == 20.0
    assert one(df.select(I.productive_thickness("chla", AXIS4).alias("x")), "x") == 20.0


@pytest.mark.parametrize("values, kind", [
    ([4.0, 4.0, 4.0, 4.0], "uniform"), ([9.0, 2.0, 1.0, 0.5], "surface"),
    ([1.0, 2.0, 9.0, 1.0], "deep"), ([9.0, 1.0, 8.0, 1.0], "double-peak"), ([None] * 4, None),
])
def test_structure_classes(spark, values, kind):
    assert one(profile(spark, values).select(I.structure_class("chla", AXIS4).alias("k")), "k") == kind


# --- axes and names ------------------------------------------------------------------

def test_nearest_ties(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-9.0,), (99.0,)], "q double")
    up, down = RegularAxis(0.0, 1.0, 3), RegularAxis(2.0, -1.0, 3)

    def idx(axis, tie):
        return [r[0] for r in df.select(axis.nearest("q", tie)).collect()]

    assert idx(up, "larger") == [1, 2, 0, 2] and idx(up, "left") == [0, 1, 0, 2]
    # descending 2, 1, 0: 0.5 lies between positions 1 and 2; the larger label is position 1
    assert idx(down, "larger") == [1, 0, 2, 0] and idx(down, "left") == [1, 0, 2, 0]


@pytest.mark.parametrize("tie, up, down", [("left", [0, 1, 2], [2, 1, 0]), ("larger", [1, 2, 2], [2, 1, 0])])
def test_nearest_index_on_irregular_axis(spark, tie, up, down):
    df = spark.createDataFrame([(1.0,), (4.0,), (100.0,)], "q double")
    labels = [0.0, 2.0, 6.0]
    assert [r["idx"] for r in M.nearest_index(df, "q", labels, tie=tie).collect()] == up
    # descending labels 6, 2, 0: the midpoints 1 and 4 go to the earlier = larger label
    found = [r["idx"] for r in M.nearest_index(df, "q", labels[::-1], tie=tie).collect()]
    assert found == [1, 0, 0]


def test_box_is_inclusive_at_both_ends(spark):
    lat = RegularAxis(70.0, -1.0, 10)
    df = spark.range(10).select(F.col("id").cast("int").alias("lat_idx"))
    kept = df.where(lat.within("lat_idx", 65.0, 68.0)).collect()
    assert sorted(r[0] for r in kept) == [2, 3, 4, 5]


def test_labels_and_wavelengths(spark):
    df = spark.createDataFrame([("CHLA_0_10",), ("CHLA_x_10",), ("CHLA",)], "label string")
    assert [tuple(r) for r in df.select(*N.depth_bounds("label").values()).collect()] == [
        (0.0, 10.0, 5.0), (None, None, None), (None, None, None)]
    assert N.numbered_columns(["CHLA_0_10", "CHLA_QC", "b"], "CHLA_") == ["CHLA_0_10"]
    assert N.check_wavelengths(["r_400", "type"], [400.005], {"type": 1}) == ["r_400"]
    for cols, axis in ((["r_400"], [400.0, 405.0]), (["r_400"], [401.0]), (["bad_x"], [400.0])):
        with pytest.raises(ValueError):
            N.check_wavelengths(cols, axis)


def test_tiles(spark):
    df = spark.createDataFrame([(0, 479), (480, 480), (4319, 8639)], "i int, j int")
    assert [r[0] for r in df.select(tile_id("i", "j")).collect()] == [0, 19, 161]


# --- time features ---------------------------------------------------------------------

def test_solar_time_wraps_and_folds(spark):
    t = dt.datetime(2024, 1, 1, 1, 0)
    df = spark.createDataFrame([(t, -150.0), (t, 210.0)], "time timestamp_ntz, lon double")
    out = with_solar_time(df).select("lon", "solar_hour").collect()
    assert [tuple(r) for r in out] == [(-150.0, 15.0), (-150.0, 15.0)]
    raw = with_solar_time(df, lon_range="180").select("lon").collect()
    assert [r[0] for r in raw] == [-150.0, 210.0]
    text = spark.createDataFrame([("nonsense", 0.0)], "time string, lon double")
    assert one(with_solar_time(text), "solar_hour") is None


def test_leap_day_of_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 31),)], "time date")
    assert one(with_seasonal_time(df), "sin_time") == pytest.approx(math.sin(2 * math.pi * 366 / 365.25), abs=1e-6)


def test_zero_spread_counts_as_one(spark):
    df = spark.createDataFrame([(7.0,)], "x double")
    assert one(df.select(standardise("x", 5.0, 0.0).alias("z")), "z") == 2.0


# --- grid aggregation --------------------------------------------------------------------

def test_empty_month_is_missing(spark):
    df = spark.createDataFrame([(day(5), 1.0), (day(9), 3.0), (day(1, 3), 5.0)], "date date, v double")
    out = gridagg.monthly_mean(df, ["v"])
    assert rows(out, "month", "v") == [(day(1), 2.0), (day(1, 2), None), (day(1, 3), 5.0)]


def test_mean_of_means_is_staged(spark):
    df = spark.createDataFrame([(day(1), 0.0), (day(1), 0.0), (day(1), 0.0), (day(2), 4.0)], "date date, v double")
    assert one(gridagg.mean_of_daily_means(df, ["v"]), "v") == 2.0


def test_block_mean_trims_the_remainder(spark):
    cells = [(i, j, float(i)) for i in range(10) for j in range(9)]
    df = spark.createDataFrame(cells, "lat_idx int, lon_idx int, v double")
    out = gridagg.block_mean(df, ["v"], 4, RegularAxis(0.0, 1.0, 10), RegularAxis(0.0, 1.0, 9))
    assert rows(out, "lat_block", "lon_block", "v", "lat") == [
        (0, 0, 1.5, 1.5), (0, 1, 1.5, 1.5), (1, 0, 5.5, 5.5), (1, 1, 5.5, 5.5)]


def test_cut_is_left_closed(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (19.9,), (20.0,), (None,)], "x double")
    got = [r[0] for r in df.select(gridagg.cut("x", [0, 10, 20], ["a", "b"])).collect()]
    assert got == ["a", "b", "b", None, None]


def test_confusion_matrix_keeps_empty_rows(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, 15.0), (5.0, 99.0)], "o double, p double")
    counts = gridagg.confusion_matrix(df, "o", "p", [0, 10, 20], ["a", "b"])
    assert rows(counts, "obs_bin", "a", "b") == [("a", 1, 1), ("b", 0, 0)]
    shares = gridagg.confusion_matrix(df, "o", "p", [0, 10, 20], ["a", "b"], normalise=True)
    assert rows(shares, "obs_bin", "a", "b") == [("a", 0.5, 0.5), ("b", None, None)]


# --- quantiles and samples -----------------------------------------------------------------

@pytest.mark.parametrize("make", [
    lambda r: r.gauss(0, 1), lambda r: r.gauss(0, 1) * 10 ** r.randint(-200, 200), lambda r: float(r.randint(-2, 2)),
    lambda r: 1.0 + r.random() * 1e-12, lambda r: 0.0 if r.random() < 0.5 else -r.random(),
])
def test_exact_percentiles_match_brute_force(spark, make):
    rng = random.Random(7)
    data = [("hot" if i % 3 else "cold", make(rng)) for i in range(3000)] + [("hot", None), ("single", 4.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    ps = [0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0]
    got = {(r["k"], r["p"]): r["v"] for r in exact_percentiles(df, "v", ps, ["k"]).collect()}
    for k in ("hot", "cold", "single"):
        values = [v for name, v in data if name == k and v is not None]
        for p in ps:
            assert got[k, p] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-300), (k, p)


@pytest.mark.parametrize("n", [0, 1, 37, 500, 2000])
def test_sample_is_exact_and_independent_of_partitioning(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = rows(sample_exact(df.repartition(3), n, "k"), "k")
    b = rows(sample_exact(df.repartition(7), n, "k"), "k")
    assert a == b and len(a) == min(n, 1000)


# --- quality ------------------------------------------------------------------------------

def counts(spark, ocean, missing):
    return spark.createDataFrame([(day(1), ocean, missing)], "date date, ocean bigint, missing_y bigint")


def test_thresholds_inclusive_for_reports_strict_for_training(spark):
    c = counts(spark, 100, 5)
    assert one(Q.valid_days_by_month(c, ["y"], 2024, 0.05).where("month = 1"), "valid_days") == 1
    assert Q.usable_days(c, "y", [], max_frac_response=0.05).count() == 0
    assert Q.valid_days_by_month(c, ["y"], 2024).count() == 12


def test_day_without_ocean(spark):
    c = counts(spark, 0, 0)
    assert one(Q.pct_missing(c, "y"), "pct_missing_y") is None
    assert Q.usable_days(c, "y", []).count() == 0


def test_unstored_cells_count_as_missing(spark):
    facts = spark.createDataFrame([(day(1), 0, 0, 1.0), (day(1), 0, 1, None)], "date date, lat_idx int, lon_idx int, y double")
    days = spark.createDataFrame([(day(1),), (day(2),)], "date date")
    out = Q.missing_counts(facts, ["y"], F.lit(True), 4, days)
    assert rows(out, "date", "ocean", "missing_y") == [(day(1), 4, 3), (day(2), 4, 4)]


def test_flat_deep_profiles_need_enough_values(spark):
    five = [("five", 105.0 + 10 * i, 1.5 + 0.1 * i) for i in range(5)]
    four = [("four", 105.0 + 10 * i, 1.5) for i in range(4)]
    low = [("low", 105.0 + 10 * i, 1.0) for i in range(5)]
    df = spark.createDataFrame(five + four + low, "profile_id string, z double, chla double")
    assert rows(Q.suspect_profiles(df, max_spread=2.0), "profile_id") == [("five",)]
    assert {r[0] for r in rows(Q.drop_suspect_profiles(df), "profile_id")} == {"four", "low"}


def test_selected_days(spark):
    days = spark.createDataFrame([(day(3),), (day(14),), (day(20),), (day(2, 2),)], "date date")
    assert rows(Q.selected_days(days, "first"), "date") == [(day(3),), (day(2, 2),)]
    assert rows(Q.selected_days(days, "from", 15), "date") == [(day(20),), (day(2, 2),)]
    assert rows(Q.selected_days(days, "fixed"), "date") == [(day(14),)]


def test_duplicate_cells_are_reported(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    with pytest.raises(ValueError):
        Q.assert_unique(df, ["a", "b"])


# --- matchup ------------------------------------------------------------------------------

def test_window_is_half_open(spark):
    start = dt.datetime(2024, 1, 1, 12, 0)
    times = [start, start + dt.timedelta(hours=24, seconds=-1), start + dt.timedelta(hours=24), start - dt.timedelta(seconds=1)]
    pts = spark.createDataFrame(list(enumerate(times)), "id int, time timestamp_ntz")
    man = spark.createDataFrame([("g", start, start + dt.timedelta(hours=1))], "granule string, t_start timestamp_ntz, t_end timestamp_ntz")
    assert rows(M.match_in_time(pts, man), "id") == [(0,), (1,)]
    assert rows(M.match_in_time(pts, man, window="coverage"), "id") == [(0,)]


def test_matchup_selects_the_named_band_and_keeps_unstored_cells(spark):
    start = dt.datetime(2024, 1, 1)
    pts = spark.createDataFrame([(1, start, 0.2, 0.9), (2, start, 2.0, 0.0)], "id int, time timestamp_ntz, lat double, lon double")
    man = spark.createDataFrame([("g", start, start)], "granule string, t_start timestamp_ntz, t_end timestamp_ntz")
    pix = spark.createDataFrame([("g", 0, 1, [1.0, 2.0])], "granule string, lat_idx int, lon_idx int, rrs array<double>")
    axis = RegularAxis(0.0, 1.0, 3)
    out = M.match_points(pts, man, pix, axis, axis, bands=[400.0, 405.0], select=405.0)
    assert rows(out, "id", "pace_Rrs_405", "pace_Rrs_lat") == [(1, 2.0, 0.0), (2, None, 2.0)]
    with pytest.raises(ValueError):
        M.match_points(pts, man, pix, axis, axis, bands=[400.0], select=500.0)


def test_day_must_match_the_axis_once(spark):
    axis = spark.createDataFrame([(day(1), 0), (day(2), 1), (day(2), 2)], "date date, time_idx int")
    ok = spark.createDataFrame([(day(1),)], "date date")
    assert rows(M.exact_day(ok, axis), "date", "time_idx") == [(day(1), 0)]
    for bad in (day(2), day(3)):
        with pytest.raises(ValueError):
            M.exact_day(spark.createDataFrame([(bad,)], "date date"), axis)


def test_bilinear_weights(spark):
    field = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(3) for j in range(3)], "lat_idx int, lon_idx int, v double")
    target = spark.createDataFrame([(0, 0, 0.5, 0.25), (0, 1, 2.0, 2.0), (0, 2, 9.0, 1.0)], "lat_idx int, lon_idx int, lat double, lon double")
    axis = RegularAxis(0.0, 1.0, 3)
    out = M.regrid_bilinear(field, target, axis, axis, "v")
    assert rows(out, "lon_idx", "v") == [(0, 5.25), (1, 22.0), (2, 21.0)]


# --- neighbours ----------------------------------------------------------------------------

def test_smoothing_repeats_the_edge(spark):
    long = spark.createDataFrame([("p", 0, 3.0), ("p", 1, 0.0), ("p", 2, 0.0), ("p", 3, None)], "id string, z_idx int, chla double")
    out = neighbours.smooth_profiles(long, ["id"])
    assert [r["smoothed"] for r in out.orderBy("z_idx").collect()] == [2.0, 1.0, 0.0]
    arr = neighbours.smooth_array(profile(spark, [3.0, None, 0.0, 0.0]), "chla", "s")
    assert one(arr, "s") == [2.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        neighbours.smooth_profiles(long, ["id"], size=4)


def test_wide_smoothing_clamps_far_neighbours(spark):
    values = [1.0, 2.0, 3.0, 10.0]
    pad = [values[0]] * 2 + values + [values[-1]] * 2
    want = [sum(pad[i:i + 5]) / 5 for i in range(4)]
    arr = neighbours.smooth_array(profile(spark, values), "chla", "s", size=5)
    assert one(arr, "s") == pytest.approx(want)
    long = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "id string, z_idx int, chla double")
    got = [r["smoothed"] for r in neighbours.smooth_profiles(long, ["id"], size=5).orderBy("z_idx").collect()]
    assert got == pytest.approx(want)


def image(spark, t, p):
    n = len(t)
    cells = [(day(1), i, j, float(t[i][j]), float(p[i][j])) for i in range(n) for j in range(n)]
    return spark.createDataFrame(cells, "date date, lat_idx int, lon_idx int, truth double, pred double")


def test_similarity_of_a_copy_is_one(spark):
    rng = np.random.default_rng(0)
    t = rng.random((9, 9))
    df = image(spark, t, t)
    days = df.select("date").distinct()
    assert one(neighbours.structural_similarity(df, days, 9, 9), "ssim") == pytest.approx(1.0)
    assert one(neighbours.structural_similarity(df, days, 9, 9, win_size=3, sigma=0.5), "ssim") == pytest.approx(1.0)


def test_similarity_matches_a_direct_computation(spark):
    rng = np.random.default_rng(1)
    t, p = rng.random((9, 9)), rng.random((9, 9))
    r, scores = t.max() - t.min(), []
    for i in range(3, 6):
        for j in range(3, 6):
            a, b = t[i - 3:i + 4, j - 3:j + 4].ravel(), p[i - 3:i + 4, j - 3:j + 4].ravel()
            c = np.cov(a, b)
            scores.append((2 * a.mean() * b.mean() + (0.01 * r) ** 2) * (2 * c[0, 1] + (0.03 * r) ** 2)
                          / ((a.mean() ** 2 + b.mean() ** 2 + (0.01 * r) ** 2) * (c[0, 0] + c[1, 1] + (0.03 * r) ** 2)))
    df = image(spark, t, p)
    got = one(neighbours.structural_similarity(df, df.select("date").distinct(), 9, 9), "ssim")
    assert got == pytest.approx(np.mean(scores), rel=1e-9)


@pytest.mark.parametrize("land", [{(2, 2)}, {(0, 0), (4, 3), (1, 4)}, set()])
def test_distance_to_coast_against_brute_force(spark, land):
    cells = [(i, j, (i, j) not in land) for i in range(5) for j in range(5)]
    lat, lon = RegularAxis(42.0, -1.0, 5), RegularAxis(0.0, 2.0, 5)
    out = neighbours.distance_to_coast(spark.createDataFrame(cells, "lat_idx int, lon_idx int, ocean boolean"), lat, lon)
    dy, dx = 111.0, 222.0 * math.cos(math.radians(40.0))
    for r in out.collect():
        i, j = r["lat_idx"], r["lon_idx"]
        want = min((math.hypot((i - a) * dy, (j - b) * dx) for a, b in land), default=None)
        assert r["dist2coast_km"] == (None if want is None else pytest.approx(want))


# --- evaluation ---------------------------------------------------------------------------

def test_empty_depth_bin_has_zero_pairs(spark):
    long = spark.createDataFrame([("CHLA_0_10", 2.0, 0.3), ("CHLA_10_20", -1.0, 0.3)], "var string, chla double, pred_log double")
    labels = ["CHLA_0_10", "CHLA_10_20"]
    out = E.depth_metrics_table(long, DepthAxis.from_labels(labels), labels)
    assert rows(out, "var", "N", "rmse_lin").__repr__().count("None") == 1
    assert {r["var"]: r["N"] for r in out.collect()} == {"CHLA_0_10": 1, "CHLA_10_20": 0}


def test_r2_is_not_squared_correlation_and_guards_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "t double, p double")
    from brineframe.functions import metrics

    assert one(df.agg(metrics.r2("t", "p").alias("x")), "x") == pytest.approx(-0.5)
    assert one(df.agg(metrics.bias("t", "p").alias("x")), "x") == 1.0
    flat = df.withColumn("t", F.lit(1.0))
    assert one(flat.agg(metrics.r2("t", "p").alias("x")), "x") is None


def test_peaks_need_enough_bins(spark):
    axis = DepthAxis.uniform(10)
    full = [float(i == 3) for i in range(10)]
    df = spark.createDataFrame([(full, full[1:] + [0.0]), (full[:9] + [None], full)], "obs array<double>, pred array<double>")
    out = E.peak_comparison(df, axis, smooth_first=False).collect()
    assert (out[0]["peak_obs_m"], out[0]["peak_error_m"], out[0]["int_obs_0_200"]) == (35.0, -10.0, 10.0)
    assert out[1]["peak_obs_m"] is None and out[1]["int_error_0_200"] is None


def test_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    x, h = rng.random(200) + 0.1, rng.integers(0, 24, 200)
    y = 10 ** (0.7 * np.log10(x + 1e-6) + 0.02 * h - 0.3) - 1e-6
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(y, x, h)], "r double, p double, h int")
    alpha, beta, gamma, n = E.bias_regression(df, "r", "p", "h").first()
    assert (alpha, beta, gamma, n) == (pytest.approx(0.7), pytest.approx(0.02), pytest.approx(-0.3), 200)


# --- splits -------------------------------------------------------------------------------

def test_time_split_has_exact_sizes(spark):
    days = spark.range(47).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    for contiguous in (False, True):
        sizes = dict(T.time_split(days, contiguous=contiguous).groupBy("split").count().collect())
        assert sizes == {"train": 32, "val": 10, "test": 5}
    with pytest.raises(ValueError):
        T.time_split(days, (0.5, 0.1, 0.1))


def test_training_table_imputes_and_flags(spark):
    facts = [(day(d), 0, j, float(d) if (d, j) != (2, 1) else None, 1.0, 1.0) for d in range(1, 11) for j in range(3)]
    df = spark.createDataFrame(facts, "date date, lat_idx int, lon_idx int, x double, ocean_mask double, y double")
    df = df.withColumn("ocean_mask", F.when(F.col("lon_idx") == 2, 0.0).otherwise(1.0))
    table, names = T.training_table(df, ["x"], ["ocean_mask"], "y", "ocean_mask", 2, max_frac_inputs=0.9, contiguous=True,
                                    missing_flags=True, mean_std={"x": (1.0, 2.0)})
    assert names == ["x", "x_missing", "ocean_mask"]
    got = {(r["date"].day, r["lon_idx"]): [float(v) for v in r["features"]] for r in table.collect()}
    # training days are 1..7; day 2 is missing in this cell, so the median is 4.5
    assert got[2, 1] == [pytest.approx((4.5 - 1) / 2), 1.0, 1.0]
    assert got[5, 2] == [0.0, 0.0, 0.0]


def test_wide_long_wide(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 3.0)], "id int, CHLA_0_10 double, CHLA_10_20 double")
    long = S.wide_to_long(df, ["id"])
    back = S.long_to_wide(long, ["id"], ["CHLA_0_10", "CHLA_10_20"])
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_quality_flags_follow_the_column_type(spark):
    assert S.good_quality(spark.createDataFrame([(1,), (3,)], "qc int"), "qc").count() == 1
    assert S.good_quality(spark.createDataFrame([("A",), ("1",)], "qc string"), "qc").count() == 1


def test_file_names(spark):
    df = spark.createDataFrame([("chla_z_20240305_v2.nc",), ("chla_z_20240306.nc",), ("junk",)], "n string")
    assert [tuple(r) for r in df.select(date_token("n"), version_token("n")).collect()] == [
        (day(5, 3), "v2"), (day(6, 3), "v1"), (None, "v1")]
    assert [r[0] for r in df.select(like_glob("n", "*_2024*5_v?.nc")).collect()] == [True, False, False]
