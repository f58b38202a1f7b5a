"""Nearest labels of axis tables, run-length masks, alignment bitmaps, Morton order, stored attributes."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from brineframe.functions.axes import RegularAxis, morton_key
from brineframe.operators import asof, masks, quality as Q, splitting as T
from brineframe.sources import attributes as A, cube as store
from brineframe.sources.tables import read_aligned


def nearest(labels, q, tie):
    """Brute force over an axis of (position, label)."""
    labels = [(p, v) for p, v in labels if v is not None and not math.isnan(v)]
    if q is None or math.isnan(q) or not labels:
        return None
    best = min(abs(v - q) for _, v in labels)
    ties = [(p, v) for p, v in labels if abs(v - q) == best]
    if tie == "left":
        return min(p for p, _ in ties)
    top = max(v for _, v in ties)
    return min(p for p, v in ties if v == top)


@pytest.mark.parametrize("tie", ["left", "larger"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_nearest_on_axis_table(spark, tie, descending, parts):
    rng = random.Random(parts)
    values = sorted((rng.randrange(400) / 4 for _ in range(60)), reverse=descending)  # some labels repeat
    labels = list(enumerate(values)) + [(98, None), (99, float("nan"))]
    asked = [rng.randrange(-20, 900) / 8 for _ in range(300)] + [values[0]] * 40 + [None, float("nan"), -0.0]
    axis = spark.createDataFrame(labels, "idx int, label double")
    df = spark.createDataFrame(list(enumerate(asked)), "id int, q double").withColumn("idx", F.lit("replaced"))
    got = {r["id"]: r["idx"] for r in asof.nearest_on_axis(df, "q", axis, tie=tie, parts=parts).collect()}
    assert got == {i: nearest(labels, q, tie) for i, q in enumerate(asked)}


def test_nearest_on_long_axis_with_few_values_per_range(spark):
    """Ranges without a label or without a value: labels are carried over many range edges."""
    axis = spark.range(2).select("id", (F.col("id") * 1e6).alias("label"))
    df = spark.range(1, 2000).select((F.col("id") * 500.0).alias("q"))
    out = asof.nearest_on_axis(df, "q", axis, position="id", parts=16)
    wrong = out.where(F.col("idx") != F.when(F.col("q") <= 500_000, 0).otherwise(1))
    assert out.count() == 1999 and wrong.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_on_empty_axis(spark):
    axis = spark.createDataFrame([], "idx int, label double")
    df = spark.createDataFrame([(1.0,), (None,)], "q double")
    assert [r["idx"] for r in asof.nearest_on_axis(df, "q", axis).collect()] == [None, None]
    assert asof.nearest_on_axis(df.limit(0), "q", axis).count() == 0
    with pytest.raises(ValueError, match="tie"):
        asof.nearest_on_axis(df, "q", axis, tie="nearest")


def days(spark, *numbers):
    return spark.createDataFrame([(dt.date(2024, 1, n),) for n in numbers], "date date")


def test_runs_stand_for_the_mask(spark):
    rng = random.Random(3)
    rows = [(i, j, rng.choice([True, True, False, None])) for i in range(12) for j in range(30)]
    mask = spark.createDataFrame(rows + rows[:40], "lat_idx int, lon_idx int, ocean boolean")
    runs = masks.encode_runs(mask)
    wet = {(i, j) for i, j, o in rows if o}
    assert {tuple(r) for r in masks.ocean_cells(runs).collect()} == wet
    assert masks.ocean_cells(runs).count() == len(wet)
    spans = sorted(tuple(r) for r in runs.collect())
    assert all((a[0], a[2] + 1) != (b[0], b[1]) for a, b in zip(spans, spans[1:])), "neighbouring runs are one"
    grid = masks.ocean_grid(runs, days(spark, 1, 2, 5))
    assert set(grid.columns) == {"date", "lat_idx", "lon_idx"}
    assert grid.count() == 3 * len(wet) == grid.distinct().count()
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spark.range(1).select(masks.ocean_pixels(runs)).first()[0] == len(wet)


def test_mask_that_changes_by_day(spark):
    mask = days(spark, 1, 2).select("date", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("lon_idx")).withColumns({
        "lat_idx": F.lit(4), "ocean": (F.col("lon_idx") + F.dayofmonth("date")) % 3 != 0,
    })
    runs = masks.encode_runs(mask)
    assert masks.ocean_grid(runs, days(spark, 1, 2, 3)).count() == mask.where("ocean").count()
    assert {r[0].day: r[1] for r in masks.ocean_pixels(runs).collect()} == {1: 7, 2: 7}


def test_empty_mask(spark):
    runs = masks.encode_runs(spark.createDataFrame([(1, 1, False)], "lat_idx int, lon_idx int, ocean boolean"))
    assert runs.count() == 0 and masks.ocean_grid(runs, days(spark, 1)).count() == 0
    assert spark.range(1).select(masks.ocean_pixels(runs)).first()[0] == 0


@pytest.mark.parametrize("by_day", [False, True])
def test_training_table_imputes_cells_without_a_row(spark, by_day):
    rng = random.Random(7)
    span, shape = range(1, 11), [(i, j) for i in range(3) for j in range(5)]

    def ocean(n, i, j):
        return (i + j + (n if by_day else 0)) % 4 != 0

    facts = []
    for n in span:
        for i, j in shape:
            if (i, j) != (1, 1) and rng.random() < 0.7:  # one ocean cell is never stored
                facts.append((dt.date(2024, 1, n), i, j, rng.choice([None, 1.5, 2.0, 7.0]), rng.random(), float(ocean(n, i, j))))
    df = spark.createDataFrame(facts, "date date, lat_idx int, lon_idx int, x double, y double, wet double")
    mask = spark.createDataFrame(
        [(dt.date(2024, 1, n), i, j, ocean(n, i, j)) for n in span for i, j in shape],
        "date date, lat_idx int, lon_idx int, ocean boolean",
    )
    mask = mask if by_day else mask.where("date = DATE'2024-01-01'").drop("date")
    table, names = T.training_table(
        df, ["x"], ["wet"], "y", "wet", missing_flags=True, max_frac_response=1.1, max_frac_inputs=1.1,
        runs=masks.encode_runs(mask),
    )
    assert names == ["x", "x_missing", "wet"]
    got = {(r["date"].day, r["lat_idx"], r["lon_idx"]): r for r in table.collect()}
    stored = {(f[0].day, f[1], f[2]): f for f in facts}
    assert table.count() == len(got)
    assert set(got) == set(stored) | {(n, i, j) for n in span for i, j in shape if ocean(n, i, j)}

    split = {k[0]: r["split"] for k, r in got.items()}
    train = {k: f[3] for k, f in stored.items() if split[k[0]] == "train" and f[3] is not None}
    mean, std = statistics.fmean(train.values()), statistics.pstdev(train.values())
    wet = {k: v for k, v in train.items() if ocean(*k)}
    overall = statistics.median(wet.values())
    for k, r in got.items():
        x = stored[k][3] if k in stored else None
        own = [v for c, v in wet.items() if c[1:] == k[1:]]
        fill = statistics.median(own) if own else overall
        is_ocean = ocean(*k)
        want = [((x if x is not None else fill) - mean) / std if is_ocean else 0.0, float(x is None and is_ocean), float(is_ocean)]
        assert r["features"] == pytest.approx(want, abs=1e-5)
        assert r["y"] == (pytest.approx(stored[k][4]) if k in stored else None)


def test_training_table_needs_ocean_pixels_or_runs(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 0, 0, 1.0, 1.0, 1.0)], "date date, lat_idx int, lon_idx int, x double, y double, wet double")
    with pytest.raises(ValueError, match="ocean pixels"):
        T.training_table(df, ["x"], [], "y", "wet")


def test_duplicate_cells_are_found_by_bitmaps(spark, tmp_path):
    grid = spark.range(300 * 600).select(
        F.lit(dt.date(2024, 1, 1)).alias("date"), F.floor(F.col("id") / 600).cast("int").alias("lat_idx"),
        (F.col("id") % 600).cast("int").alias("lon_idx"), F.rand(1).alias("v"),
    )
    assert Q.assert_cells_unique(grid) is grid
    again = grid.where("lat_idx = 299 AND lon_idx = 599")
    with pytest.raises(ValueError, match="'lat_idx': 299, 'lon_idx': 599"):
        Q.assert_cells_unique(grid.unionByName(again))
    Q.assert_cells_unique(grid.unionByName(again.withColumn("date", F.date_add("date", 1))))
    Q.assert_cells_unique(grid.limit(0))
    with pytest.raises(ValueError, match="no date or no cell"):
        Q.assert_cells_unique(grid.unionByName(again.withColumn("lon_idx", F.lit(None).cast("int"))))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    grid.where("lat_idx < 150").write.parquet(a)
    grid.where("lat_idx >= 149").write.parquet(b)
    with pytest.raises(ValueError, match="'lat_idx': 149"):
        read_aligned(spark, [a], [b])
    assert read_aligned(spark, [a], [b], check=False).count() == 301 * 600


def test_bitmaps_not_cells_are_shuffled(spark):
    rows = spark.range(200_000).select(
        F.lit(dt.date(2024, 1, 1)).alias("date"), F.floor(F.col("id") / 1000).cast("int").alias("lat_idx"), (F.col("id") % 1000).cast("int").alias("lon_idx"),
    )
    maps = Q.cell_bitmaps(rows)
    assert [len(r["_map"]) for r in maps.collect()] == [4096] * 8
    assert maps.agg(F.sum("_n"), F.sum(F.bitmap_count("_map"))).first()[:] == (200_000, 200_000)
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.rindex("partial_bitmap_construct_agg")


def test_morton_key_interleaves_bits(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1), (5, 3), (4319, 8639), (65535, 65535), (65535, 0)]
    df = spark.createDataFrame(pairs, "a int, b int").select(morton_key("a", "b"))

    def brute(a, b):
        return sum(((a >> k) & 1) << (2 * k + 1) | ((b >> k) & 1) << (2 * k) for k in range(16))

    assert [r[0] for r in df.collect()] == [brute(a, b) for a, b in pairs]


def test_morton_order_touches_fewer_pages(spark, tmp_path):
    n = 512
    cells = spark.range(n * n).select(
        F.lit(dt.date(2024, 1, 1)).alias("date"), F.floor(F.col("id") / n).cast("int").alias("lat_idx"),
        (F.col("id") % n).cast("int").alias("lon_idx"), F.array(F.rand(5).cast("float")).alias("chla"),
        *[F.col("id").cast("float").alias(f.name) for f in store.CELL_SCHEMA.fields[5:]],
    )
    roots = {order: str(tmp_path / order) for order in store.ORDERS}
    for order, root in roots.items():
        store.write_days(cells, root, n, order=order)
    touched = {o: store.pages_touched(spark, r, "2024-01-01", (100, 131), (200, 231)) for o, r in roots.items()}
    point = store.pages_touched(spark, roots["morton"], "2024-01-01", (77, 77), (301, 301))
    assert point[0] == 1
    assert point[1] >= n * n / store.MORTON_PAGE_ROWS
    assert touched["morton"][0] <= 4
    # cells that must be read, pages times rows a page
    share = {o: hit / total for o, (hit, total) in touched.items()}
    assert share["morton"] < share["rows"] / 3
    for root in roots.values():
        box = store.read_cube(spark, root).where("lat_idx BETWEEN 100 AND 131 AND lon_idx BETWEEN 200 AND 231")
        assert box.count() == 32 * 32
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = box._jdf.queryExecution().explainString(mode)
        assert "GreaterThanOrEqual(lat_idx,100)" in plan and "LessThanOrEqual(lon_idx,231)" in plan
    assert store.pages_touched(spark, roots["rows"], "2023-01-01", (0, 1), (0, 1)) == (0, 0)
    with pytest.raises(ValueError, match="order"):
        store.write_days(cells, roots["rows"], n, order="hilbert")


def test_attributes_survive_a_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(dt.date(2024, 1, 3), 1, 2), (dt.date(2024, 2, 1), 0, 0)], "date date, lat_idx int, lon_idx int")
    grid = RegularAxis(10.0, -1.0, 4)
    cover = {r["key"]: r["value"] for r in A.coverage(cells, grid, grid).collect()}
    assert cover == {
        "time_coverage_start": "2024-01-03", "time_coverage_end": "2024-02-01", "geospatial_lat_min": "9.0",
        "geospatial_lat_max": "10.0", "geospatial_lon_min": "8.0", "geospatial_lon_max": "10.0",
    }
    assert A.coverage(cells.limit(0), grid, grid).count() == 0
    root = str(tmp_path / "cube")
    table = A.override(A.attribute_table(spark, {"": {"title": "t"}, "lat_idx": {"units": "1", "range": [0, 3]}}), A.coverage(cells, grid, grid))
    store.write_attributes(table, root)
    store.write_attributes(table, root)
    back = A.as_dict(store.read_attributes(spark, root))
    assert back == {"": {"title": "t", **cover}, "lat_idx": {"units": "1", "range": "[0, 3]"}}
    A.attach(cells, back).write.parquet(f"{root}/named")
    kept = A.attached(spark.read.parquet(f"{root}/named"))
    assert sorted(tuple(r) for r in kept.collect()) == [("lat_idx", "range", "[0, 3]"), ("lat_idx", "units", "1")]


def test_groupings_by_profile_follow_the_rows(spark):
    """Rows dealt by key into enough tasks; the groupings after it, a wide table too, take no further shuffle."""
    from brineframe.operators import columns, selection
    from brineframe.sources.tables import dealt

    rows = spark.range(4000).selectExpr("id % 900 AS p", "int(id % 5) AS z_idx", "IF(id % 11 = 0, NULL, double(id)) AS chla")
    assert dealt(rows, ["p"], rows_per_task=1 << 20).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) + 12
    many = dealt(rows, ["p"], rows_per_task=-(-4000 // parts))
    assert many.rdd.getNumPartitions() >= parts - 1
    labels = [f"CHLA_{10 * i}_{10 * i + 10}" for i in range(5)]

    def wide(df):
        arrays = columns.depth_arrays(df, ["p"], 5)
        flat = arrays.selectExpr("p", *[f"chla[{i}] AS {c}" for i, c in enumerate(labels)])
        return selection.long_to_wide(selection.wide_to_long(flat, ["p"]), ["p"], labels)

    assert sorted(map(tuple, wide(many).collect()), key=str) == sorted(map(tuple, wide(rows).collect()), key=str)
    assert wide(many).columns == ["p", *labels]
    plan = wide(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "pivotfirst" not in plan
