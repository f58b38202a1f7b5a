"""Published cube, manifests, catalog, attributes, bundles and incremental ingest."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from brineframe.functions.axes import DepthAxis, RegularAxis
from brineframe.operators import columns
from brineframe.sources import attributes as A, bundle as B, catalog, cube as store, manifest as M
from brineframe.sources.tables import read_aligned, staged
from brineframe.sources.versions import read_current, read_ledger, vacuum
from brineframe.streaming.ingest import ingest

AXIS = DepthAxis.uniform(3)
GRID = RegularAxis(2.0, -1.0, 4)


def day(n):
    return dt.date(2024, 1, n)


def cells(spark, *entries):
    """(day, lat, lon, surface value) -> rows with metrics"""
    rows = [(day(d), i, j, [float(v), float(v) / 2, None]) for d, i, j, v in entries]
    df = spark.createDataFrame(rows, "date date, lat_idx int, lon_idx int, chla array<double>")
    return columns.column_metrics(df, AXIS)


def stored(spark, root):
    rows = store.read_cube(spark, root).select("date", "lat_idx", "lon_idx", "chla_surface").collect()
    return sorted((r[0].day, r[1], r[2], r[3]) for r in rows)


def published(spark, root):
    rows = read_current(spark, root).select("date", "lat_idx", "lon_idx", "chla_surface").collect()
    return sorted((r[0].day, r[1], r[2], r[3]) for r in rows)


@pytest.fixture
def root(spark, tmp_path):
    days = spark.createDataFrame([(day(1),), (day(2),), (day(3),)], "date date")
    path = str(tmp_path / "cube")
    store.create_cube(spark, path, GRID, GRID, AXIS, days)
    return path


def test_new_cube_is_typed_and_empty(spark, root):
    assert store.read_cube(spark, root).count() == 0
    assert store.read_cube(spark, root).schema == store.CELL_SCHEMA
    assert [r["time_idx"] for r in store.read_axis(spark, root, "time").orderBy("date").collect()] == [0, 1, 2]
    assert [r["lat"] for r in store.read_axis(spark, root, "lat").orderBy("lat_idx").collect()] == [2.0, 1.0, 0.0, -1.0]


def test_region_write_replaces_only_its_days(spark, root):
    store.write_region(spark, cells(spark, (1, 0, 0, 1), (1, 0, 1, 2), (2, 0, 0, 3)), root, 4)
    store.write_region(spark, cells(spark, (2, 1, 1, 9)), root, 4)
    want = [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 1, 1, 9.0)]
    assert stored(spark, root) == want
    store.write_region(spark, cells(spark, (2, 1, 1, 9)), root, 4)
    assert stored(spark, root) == want


def test_region_write_refuses_unknown_days(spark, root):
    with pytest.raises(ValueError):
        store.write_region(spark, cells(spark, (1, 0, 0, 1), (9, 0, 0, 1)), root, 4)
    assert stored(spark, root) == []


def test_day_filter_prunes_partitions_and_indices_reach_parquet(spark, root):
    store.write_region(spark, cells(spark, (1, 0, 0, 1), (2, 0, 0, 3)), root, 4)
    df = store.read_cube(spark, root).where((F.col("date") == F.lit("2024-01-02").cast("date")) & (F.col("lat_idx") <= 1))
    plan = df.select("chla_surface")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "LessThanOrEqual(lat_idx,1)" in plan
    assert "chla_peak" not in plan


def test_manifest_from_files(spark, tmp_path):
    for name in ("chla_z_20240101.parquet", "2024/chla_z_20240102_v2.parquet", "notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"only listed, never read")
    files = M.list_files(spark, str(tmp_path))
    assert sorted((r["date"].day, r["version"], r["length"]) for r in files.collect()) == [(1, "v1", 23), (2, "v2", 23)]


def test_pending_and_force(spark):
    todo = spark.createDataFrame([(day(1),), (day(2),)], "date date")
    done = spark.createDataFrame([(day(1),), (day(1),)], "date date")
    assert [r[0] for r in M.pending(todo, done).collect()] == [day(2)]
    assert M.pending(todo, done, force=True).count() == 2


def test_aligned_sets(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(day(1), 0, 0, float("nan"))], "date date, lat_idx int, lon_idx int, x double").write.parquet(a)
    spark.createDataFrame([(day(2), 0, 0, 1.0)], "date date, lat_idx int, lon_idx int, y double").write.parquet(b)
    out = read_aligned(spark, [a], [b]).orderBy("date").collect()
    assert [(r["x"], r["y"]) for r in out] == [(None, None), (None, 1.0)]
    with pytest.raises(ValueError):
        read_aligned(spark, [a], [a])


def test_catalog_keeps_places(spark):
    old = spark.createDataFrame([("b", 1, 0), ("a", 2, 0)], "id string, v int, generation int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    out = catalog.upsert(old, new, "id").orderBy("generation", "id").collect()
    assert [(r["id"], r["v"], r["generation"]) for r in out] == [("a", 2, 0), ("b", 9, 0), ("c", 3, 1)]
    empty = catalog.upsert(old.limit(0), new, "id")
    assert {r["generation"] for r in empty.collect()} == {0}


def test_attributes(spark):
    own = A.attribute_table(spark, {"": {"title": " ", "n": 3}, "chla": {"units": "x", "history": "h"}})
    base = A.attribute_table(spark, {"": {"title": "T"}, "chla": {"units": "mg m-3"}})
    out = A.drop_keys(A.fill_defaults(own, base), ["history"])
    assert sorted(tuple(r) for r in out.collect()) == [("", "n", "3"), ("", "title", "T"), ("chla", "units", "x")]
    over = A.override(own, base).where("key = 'units'").collect()
    assert [r["value"] for r in over] == ["mg m-3"]


def test_column_metadata_survives_parquet(spark, tmp_path):
    df = A.attach(spark.createDataFrame([(1.0,)], "chla_peak double"), A.VARIABLE_ATTRIBUTES)
    path = str(tmp_path / "m")
    df.write.parquet(path)
    assert spark.read.parquet(path).schema["chla_peak"].metadata["units"] == "mg m-3"


def test_staged_frame_reads_from_files(spark, tmp_path):
    out = staged(spark.range(5), str(tmp_path / "s"))
    assert out.count() == 5 and "FileScan" in out._jdf.queryExecution().executedPlan().toString()


def test_bundle_round_trip_and_errors(spark, tmp_path):
    from brineframe.operators import models as ML

    rows = [(i, float(i % 7), float(i % 3), float(i % 7 + 1), "test" if i % 5 == 0 else "train") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, f_400 double, f_405 double, CHLA_0_10 double, split string")
    feats = ["f_400", "f_405"]
    models = ML.fit_depth_models(df.where("split = 'train'"), ["CHLA_0_10"], feats, "k", max_iter=3, max_depth=3)
    path = str(tmp_path / "bundle")
    B.save_bundle(models, df, feats, path, y_col="CHLA_a_b")
    back = B.load_bundle(spark, path)
    assert back.meta["feature_cols"] == feats and back.meta["y_col"] == "CHLA_a_b"
    assert back.xy("CHLA_0_10", "train").count() == 48 and back.xy("CHLA_0_10", "test").count() == 12
    a = ML.score_depths(df, models, feats).collect()
    b = ML.score_depths(df, back.models, feats).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    with pytest.raises(KeyError):
        back.xy("CHLA_10_20", "train")
    with pytest.raises(ValueError):
        B.save_bundle(models, df.drop("split"), feats, path)
    with pytest.raises(KeyError):
        ML.score_depths(df, models, [*feats, "absent"])


def test_models_learn_and_blank_incomplete_rows(spark):
    from brineframe.operators import evaluate as E, models as ML

    rows = [(i, (i * 37 % 100) / 100.0, (i * 61 % 100) / 100.0) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, b_400 double, b_405 double").withColumns({
        "CHLA_0_10": F.col("b_400") * 4 + 0.5, "CHLA_10_20": F.col("b_405") * 4 + 5,
    })
    feats = ["b_400", "b_405"]
    models = ML.fit_depth_models(df, ["CHLA_10_20", "CHLA_0_10"], feats, "k", max_iter=60, max_depth=4)
    assert list(models) == ["CHLA_0_10", "CHLA_10_20"]
    scored = ML.score_depths(df, models, feats).withColumns({"t": F.log10("CHLA_0_10"), "p": F.get("chla", F.lit(0))})
    # the first trees are damped by the learning rate; most of the variance must be explained
    assert E.fit_metrics(scored, "t", "p").first()["r2_log"] > 0.7
    # the deeper bin is larger everywhere, and stays so in the predictions
    assert scored.where(F.get("chla", F.lit(1)) <= F.col("p")).count() < 20
    gappy = df.limit(2).withColumn("b_405", F.when(F.col("k") != df.first()["k"], F.col("b_405")))
    assert sorted(r["chla"] is None for r in ML.score_depths(gappy, models, feats, incomplete="blank").collect()) == [False, True]
    assert ML.score_depths(gappy, models, feats, incomplete="drop").count() == 1
    assert ML.score_depths(gappy, models, feats).where("chla is null").count() == 0


def test_no_more_trees_are_fitted_than_the_stopping_rule_asks_for(spark, monkeypatch):
    """The model of few trees, fitted in stages, is that of all trees cut at the same place."""
    from brineframe.operators import models as ML

    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    rows = spark.range(600).select("id", (F.col("id") * 37 % 101 / 101.0).alias("a"), (noise + 0.5).alias("CHLA_0_10")).coalesce(1)
    ready = ML.assemble(rows, ["a"], "id")
    fitted, regressor = [], ML.regressor
    monkeypatch.setattr(ML, "regressor", lambda max_iter, **kw: fitted.append(max_iter) or regressor(max_iter, **kw))
    model = ML.fit_bin(ready, "CHLA_0_10", patience=1, max_iter=40, max_depth=3)
    assert sum(fitted) < 40
    monkeypatch.setattr(ML, "stages", lambda n, patience: [n])
    whole = ML.fit_bin(ready, "CHLA_0_10", patience=1, max_iter=40, max_depth=3)
    assert fitted[-1] == 40
    without_uid = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.trees]
    assert without_uid(model) == without_uid(whole)


def test_training_rows_are_dealt_by_their_number_and_flags_only_where_needed(spark, monkeypatch):
    from brineframe.operators import models as ML

    seen, fit_bin = [], ML.fit_bin
    monkeypatch.setattr(ML, "fit_bin", lambda rows, *a, **kw: seen.append((rows.rdd.getNumPartitions(), len(rows.first()["_features"]))) or fit_bin(rows, *a, **kw))
    rows = spark.range(200).select("id", (F.col("id") % 7 + 0.0).alias("a"), (F.col("id") % 5 + 0.0).alias("b")).withColumn("CHLA_0_10", F.col("a") + F.col("b") * 2 + 1)
    models = ML.fit_depth_models(rows.repartition(8), ["CHLA_0_10"], ["a", "b"], "id", max_iter=3, max_depth=2)
    assert seen.pop() == (1, 2)
    ML.fit_depth_models(rows.coalesce(1), ["CHLA_0_10"], ["a", "b"], "id", max_iter=3, max_depth=2, rows_per_task=50)
    assert seen.pop() == (4, 2)
    gappy = rows.withColumn("b", F.when(F.col("id") % 3 > 0, F.col("b")))
    other = ML.fit_depth_models(gappy, ["CHLA_0_10"], ["a", "b"], "id", max_iter=3, max_depth=2)
    assert seen.pop() == (1, 4)
    for each in (models, other):
        assert ML.score_depths(gappy, each, ["a", "b"]).where("chla[0] is null").count() == 0


def test_missing_predictors_and_early_stopping(spark):
    """Rows with missing bands teach more than complete cases alone; boosting goes on while the error falls."""
    from brineframe.operators import models as ML

    rows = spark.range(1500).select(
        F.col("id"), F.when(F.col("id") % 5 != 0, (F.col("id") * 37 % 101) / 101.0).alias("a"), F.when(F.col("id") % 5 != 1, (F.col("id") * 53 % 97) / 97.0).alias("b"))
    rows = rows.withColumn("CHLA_0_10", 1 + F.coalesce("a", F.lit(3.0)) * 2 + F.coalesce("b", F.lit(0.1)))
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")

    def error(frame):
        model = ML.fit_bin(ML.assemble(frame, ["a", "b"], "id"), "CHLA_0_10", max_iter=12, max_depth=3)
        scored = ML.score_one(test, model, ["a", "b"], out="p")
        return scored.select(F.avg(F.pow(F.col("p") - F.log10("CHLA_0_10"), 2))).first()[0], model

    (all_rows, model), (complete, _) = error(train), error(train.where("a is not null and b is not null"))
    assert all_rows < complete
    assert model.getNumTrees == 12  # the error still fell
    assert ML.first_trees(model, 5).getNumTrees == 5
    assert ML.best_prefix([5, 4, 3.5, 3.6, 3.4] + [3.5] * 20) == 5
    assert ML.best_prefix([5, 4, 3.5, 3.6, 3.4] + [3.5] * 20, patience=1) == 3


# --- incremental ingest ------------------------------------------------------------------

SCHEMA = "date date, lat_idx int, lon_idx int, chla array<double>"


@pytest.fixture
def landing(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()

    def deliver(name, *entries):
        cells(spark, *entries).select("date", "lat_idx", "lon_idx", "chla").coalesce(1).write.parquet(str(folder / name))
        time.sleep(1.1)  # distinct modification times

    def run(force=False, transform=lambda df: columns.column_metrics(df, AXIS), progress="progress", **kw):
        from pyspark.sql.types import _parse_datatype_string

        ingest(spark, str(folder), _parse_datatype_string(SCHEMA), transform, str(tmp_path / "cube"),
               str(tmp_path / progress), 4, force=force, delivery=F.element_at(F.split("_file", "/"), -2), **kw)

    return deliver, run, str(tmp_path / "cube")


def test_each_day_is_ingested_once(spark, landing):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1), (1, 0, 1, 2))
    deliver("b", (2, 0, 0, 3))
    run()
    assert published(spark, root) == [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 0, 0, 3.0)]
    deliver("c", (1, 3, 3, 7), (3, 0, 0, 4))
    run()  # day 1 is done already and stays as it was
    assert published(spark, root) == [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 0, 0, 3.0), (3, 0, 0, 4.0)]


def test_forced_redelivery_replaces_only_its_day(spark, landing):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1), (2, 0, 0, 3))
    run()
    deliver("b", (1, 3, 3, 7))
    run(force=True)
    assert published(spark, root) == [(1, 3, 3, 7.0), (2, 0, 0, 3.0)]


def test_newest_delivery_of_a_batch_wins(spark, landing):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1))
    deliver("b", (1, 3, 3, 7))
    run()
    assert published(spark, root) == [(1, 3, 3, 7.0)]


def test_other_delivery_of_a_finished_day_is_skipped(spark, landing):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1))
    deliver("b", (1, 3, 3, 7), (1, 3, 2, 8))
    run(files_per_batch=1)
    assert published(spark, root) == [(1, 0, 0, 1.0)]  # b is another delivery of a finished day
    assert {r["delivery"] for r in read_ledger(spark, root).collect()} == {"a"}


def test_late_part_of_a_delivery_is_merged(spark, landing, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    deliver, _, root = landing

    def run():
        ingest(spark, str(tmp_path / "landing"), _parse_datatype_string(SCHEMA), lambda df: columns.column_metrics(df, AXIS), root, str(tmp_path / "progress"), 4)

    deliver("part1", (1, 0, 0, 1), (2, 0, 0, 5))
    run()
    deliver("part2", (1, 3, 3, 7))
    run()  # same version: the day is done again from all its files
    assert published(spark, root) == [(1, 0, 0, 1.0), (1, 3, 3, 7.0), (2, 0, 0, 5.0)]


def test_replacement_without_cells_clears_the_day(spark, landing):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1), (2, 0, 0, 3))
    run()
    deliver("b", (1, 0, 0, 9))
    run(force=True, transform=lambda df: columns.column_metrics(df.where("lat_idx > 5"), AXIS))
    assert published(spark, root) == [(2, 0, 0, 3.0)]


def test_failing_day_does_not_stop_the_others(spark, landing):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1), (2, 0, 0, -1))

    def strict(df):
        checked = F.when(F.get("chla", F.lit(0)) < 0, F.raise_error(F.lit("bad day"))).otherwise(F.col("chla"))
        return columns.column_metrics(df.withColumn("chla", checked), AXIS)

    run(transform=strict)
    assert published(spark, root) == [(1, 0, 0, 1.0)]
    ledger = {r["date"].day: (r["status"], "bad day" in (r["message"] or "")) for r in read_ledger(spark, root).collect()}
    assert ledger[1] == ("done", False) and ledger[2][0] == "failed"


def test_a_replaced_delivery_never_comes_back(spark, landing, tmp_path):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1), (2, 0, 0, 3))
    run()
    deliver("b", (1, 3, 3, 7))
    run(force=True)
    late = cells(spark, (1, 1, 1, 5), (2, 1, 1, 6)).select("date", "lat_idx", "lon_idx", "chla")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "landing" / "a"))
    for force in (False, True):
        run(force=force)
        assert published(spark, root) == [(1, 3, 3, 7.0), (2, 0, 0, 3.0), (2, 1, 1, 6.0)]  # day 2 still has delivery a


def test_new_checkpoint_skips_finished_days(spark, landing):
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1))
    run()
    deliver("b", (1, 3, 3, 7), (2, 0, 0, 2))
    run(progress="another")  # sees both deliveries again, as batch 0
    assert published(spark, root) == [(1, 0, 0, 1.0), (2, 0, 0, 2.0)] or published(spark, root)[0] == (1, 0, 0, 1.0)
    done = read_ledger(spark, root).where("status = 'done'").groupBy("date").count().collect()
    assert {r["date"].day: r["count"] for r in done} == {1: 1, 2: 1}


def test_readers_see_whole_slices(spark, landing):
    """A reader that began before a replacement goes on with the old slice; a failing replacement leaves the old one current."""
    deliver, run, root = landing
    deliver("a", (1, 0, 0, 1), (1, 0, 1, 2))
    run()
    before = read_current(spark, root).select("lat_idx", "lon_idx", "chla_surface")
    deliver("b", (1, 3, 3, 7))

    def halfway(df):
        return columns.column_metrics(df, AXIS).withColumn("lat_idx", F.raise_error(F.lit("no")).cast("int"))

    run(force=True, transform=halfway)
    assert published(spark, root) == [(1, 0, 0, 1.0), (1, 0, 1, 2.0)]
    deliver("c", (1, 2, 2, 8))
    run(force=True)
    assert published(spark, root) == [(1, 2, 2, 8.0)]
    assert sorted(tuple(r) for r in before.collect()) == [(0, 0, 1.0), (0, 1, 2.0)]
    assert vacuum(spark, root) >= 1 and published(spark, root) == [(1, 2, 2, 8.0)]
