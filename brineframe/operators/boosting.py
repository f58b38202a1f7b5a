"""Boosted trees for all responses at once, over predictors that are binned once.

Every predictor becomes a byte: 0 where it is missing, else the number of its quantile bin. Training
rows are blocks of such bytes, written once. One pass over the blocks gives the histograms
of one tree level for *all* responses together; Spark sums them by (response, node, slice of predictors) and
finds each group's best split, so the driver sees splits and never rows. A missing predictor
goes to the side that fits better, learned per split.

* Residuals are fixed-point numbers, so sums do not depend on the order or number of partitions.
* The error on the validation share is read in the first pass of the next round: a response stops
  after ``patience`` rounds without a gain, and no further round is fitted for it.
* A pass applies the trees since the blocks were last written, ``REFRESH`` rounds at most.
* Histograms take responses * open nodes * predictors * (bins + 1) * 16 bytes in a task, one
  response at a time on the way out.

Defined cases: a response without a positive value has no trees and is predicted as missing; constant
or all-missing predictors are never split on; ties go to the first predictor, then the lowest
cut; without validation rows all rounds are fitted.
"""

from __future__ import annotations

import json
import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.features import log10_positive, pow10
from ..functions.hashing import uniform01
from ..functions.names import sort_by_depth
from ..session import shared_dir
from ..sources.tables import staged
from .models import LEARNING_RATE, MAX_DEPTH, MAX_ITER, PATIENCE, SEED, TOLERANCE, VALIDATION_SHARE, _features_with_consts, best_prefix
from .quantiles import exact_percentiles

BINS = 64
LARGEST = sys.float_info.max
BLOCK_ROWS = 4096
SLICE = 16  # predictors whose histograms travel together
REFRESH = 16
ONE = float(1 << 30)  # the largest deviation of a response, in fixed point
BLOCK = "codes binary, y binary, held binary, pred binary"
PARTIAL = "label int, node int, slice int, hist binary"
SPLIT = "label int, node int, slice int, feature int, cut int, missing_left boolean, gain double, s long, c long, sl long, cl long"


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2 i + 1 and 2 i + 2); feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n, bool), np.zeros(n))


@dataclass
class Forest:
    """The fitted trees of every response, what binned their predictors, and the course of the errors."""

    features: list[str]
    labels: list[str]
    depth: int
    edges: list[list[float]]
    base: list[float]
    trees: list[list[Tree]]
    rounds: list[int] = field(default_factory=list)
    errors: list[list[float]] = field(default_factory=list)


def bin_edges(df: DataFrame, values: str, n: int, bins: int = BINS) -> list[list[float]]:
    """Distinct inner quantiles (ranks ceil(rows * k / bins)) of each of the n predictors in an array column.

    Exact, whatever the number of rows: ranks are located by histograms. The driver gets n * (bins - 1) values.
    """
    if not n:
        return []
    # infinite predictors rank as the largest doubles
    each = df.select(F.posexplode(values).alias("feature", "v")).where("v IS NOT NULL").withColumn("v", F.greatest(F.lit(-LARGEST), F.least(F.col("v"), F.lit(LARGEST))))
    found: list[set[float]] = [set() for _ in range(n)]
    for r in exact_percentiles(each, "v", [i / bins for i in range(1, bins)], ["feature"], max_groups=n, interpolate=False).collect():
        found[r["feature"]].add(r["v"] if abs(r["v"]) < LARGEST else math.copysign(math.inf, r["v"]))
    return [sorted(e) for e in found]


def coded(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """(rows, predictors) bytes: 0 for missing, else 1 + how many edges lie below the value."""
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(e, x[:, i], side="left"))
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of fixed width; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def places(trees: list[Tree], codes: np.ndarray, depth: int) -> np.ndarray:
    """(rows, trees) nodes that the rows reach."""
    feature, cut, left = (np.stack([getattr(t, k) for t in trees]) for k in ("feature", "cut", "missing_left"))
    tree, row = np.arange(len(trees))[None, :], np.arange(len(codes))[:, None]
    node = np.zeros((len(codes), len(trees)), np.int64)
    for _ in range(depth):
        f = feature[tree, node]
        code = codes[row, np.maximum(f, 0)]
        right = np.where(code == 0, ~left[tree, node], code > cut[tree, node])
        node = np.where(f < 0, node, 2 * node + 1 + right)
    return node


def summed(trees: list[Tree], codes: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the trees' values for every row."""
    if not trees:
        return np.zeros(len(codes))
    value = np.stack([t.value for t in trees])
    return value[np.arange(len(trees))[None, :], places(trees, codes, depth)].sum(axis=1)


def blocks(df: DataFrame, features: int, base: list[float], edges: list[list[float]]) -> DataFrame:
    """Rows (x, y, held) as blocks of codes, responses (NaN: none), validation marks and predictions."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                codes, y = coded(matrix(b.column("x"), features), edges), matrix(b.column("y"), len(base))
                held = b.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)
                pred = np.tile(np.array(base), (len(y), 1))
                yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("codes", codes), ("y", y), ("held", held), ("pred", pred))})

    return df.select("x", "y", "held").mapInArrow(run, BLOCK)


def unpacked(batches, features: int, labels: int):
    """(codes, y, held, pred) of every block."""
    for batch in batches:
        for codes, y, held, pred in zip(*(batch.column(k).to_pylist() for k in ("codes", "y", "held", "pred"))):
            yield (np.frombuffer(codes, np.uint8).reshape(-1, features), np.frombuffer(y).reshape(-1, labels),
                   np.frombuffer(held, np.uint8).astype(bool), np.frombuffer(pred).reshape(-1, labels).copy())


def refreshed(rows: DataFrame, features: int, recent: list[list[Tree]], depth: int) -> DataFrame:
    """The blocks with the recent trees of every response in their predictions."""
    def run(batches):
        for codes, y, held, pred in unpacked(batches, features, len(recent)):
            for i, trees in enumerate(recent):
                pred[:, i] += summed(trees, codes, depth)
            yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("codes", codes), ("y", y), ("held", held.astype(np.uint8)), ("pred", pred))})

    return rows.mapInArrow(run, BLOCK)


def histograms(rows: DataFrame, features: int, recent: list[list[Tree]], growing: dict[int, Tree], level: int, width: int, scale: list[float], depth: int) -> DataFrame:
    """(label, node, slice, hist) of each partition: fixed-point sums and counts of the residuals by bin.

    Nodes count from 0 within the level. On level 0, node -1 has the squared error and count of the validation rows.
    """
    nodes = 2 ** level

    def run(batches):
        sums = {i: np.zeros((2, nodes, features, width), np.int64) for i in growing}
        error = {i: np.zeros(2, np.int64) for i in growing}
        for codes, y, held, pred in unpacked(batches, features, len(recent)):
            for i, tree in growing.items():
                own = np.flatnonzero(~np.isnan(y[:, i]))
                part = codes[own]
                rest = (y[own, i] - pred[own, i] - summed(recent[i], part, depth)) * scale[i]
                if level == 0:
                    error[i] += [int(np.rint(rest[held[own]] ** 2 / ONE).sum()), int(held[own].sum())]
                at = places([tree], part, level)[:, 0] - (nodes - 1)
                use = ~held[own] & (at >= 0)
                at, part, rest = at[use], part[use], np.rint(rest[use])
                slot = (at[:, None] * features + np.arange(features)) * width + part
                shape, n = sums[i].shape[1:], nodes * features * width
                sums[i][0] += np.rint(np.bincount(slot.ravel(), np.repeat(rest, features), n)).astype(np.int64).reshape(shape)
                sums[i][1] += np.bincount(slot.ravel(), minlength=n).reshape(shape)
        for i in growing:
            found = []
            for node in np.flatnonzero(sums[i][1][:, 0].any(axis=1)).tolist():
                for at in range(0, features, SLICE):
                    found.append((i, node, at, sums[i][:, node, at:at + SLICE].tobytes()))
            if level == 0:
                found.append((i, -1, 0, error[i].tobytes()))
            if found:
                label, node, at, hist = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(node, pa.int32()), pa.array(at, pa.int32()), pa.array(hist, pa.binary())], names=["label", "node", "slice", "hist"])

    return rows.mapInArrow(run, PARTIAL)


def best_split(s: np.ndarray, c: np.ndarray, min_rows: int) -> tuple[int, int, bool, float, int, int]:
    """(feature, cut, missing left, gain, sum left, rows left) of (features, bins + 1) sums and counts; feature -1 if there is none."""
    total, rows = s[0].sum(), c[0].sum()
    there_s, there_c = np.cumsum(s[:, 1:], axis=1), np.cumsum(c[:, 1:], axis=1)
    sl = np.stack([there_s, there_s + s[:, :1]], axis=2)  # missing right, missing left
    cl = np.stack([there_c, there_c + c[:, :1]], axis=2)
    cr = rows - cl
    ok = (cl >= min_rows) & (cr >= min_rows)
    left, right = sl.astype(float) ** 2 / np.maximum(cl, 1), (total - sl).astype(float) ** 2 / np.maximum(cr, 1)
    whole = float(total) ** 2 / max(rows, 1)
    gain = np.where(ok, left + right - whole, -1.0)
    # a side for missing values that the node does not have: the one with more rows
    gain[(c[:, 0] == 0)[:, None, None] & np.stack([2 * there_c >= rows, 2 * there_c < rows], axis=2)] = -1.0
    f, k, side = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[f, k, side] <= 1e-9 * whole + 1e-9:
        return -1, 0, False, -1.0, 0, 0
    return int(f), int(k) + 1, bool(side), float(gain[f, k, side]), int(sl[f, k, side]), int(cl[f, k, side])


def splits(partial: DataFrame, width: int, min_rows: int) -> DataFrame:
    """The best split of every (label, node, slice), from the sum of its partial histograms."""
    def run(key, rows):
        label, node, at = (k.as_py() for k in key)
        total = np.sum([np.frombuffer(h, np.int64) for h in rows.column("hist").to_pylist()], axis=0)
        if node < 0:
            found, s, c = (-1, 0, False, -1.0, 0, 0), int(total[0]), int(total[1])
        else:
            sums, counts = total.reshape(2, -1, width)
            found, s, c = best_split(sums, counts, min_rows), int(sums[0].sum()), int(counts[0].sum())
        f, cut, side, gain, sl, cl = found
        row = (label, node, at, f + at if f >= 0 else -1, cut, side, gain, s, c, sl, cl)
        return pa.Table.from_pylist([dict(zip(names, row))], schema=schema)

    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SPLIT.split(", "))])
    names = schema.names
    return partial.groupBy("label", "node", "slice").applyInArrow(run, SPLIT)


def training_blocks(df: DataFrame, labels: list[str], features: list[str], key: str, seed: int = SEED, validation: float = VALIDATION_SHARE, bins: int = BINS):
    """(blocks, edges, base, scale): the written blocks of the rows that have a positive response."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must lie between 2 and 255")
    x = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features])
    y = F.array(*[log10_positive(c).cast("double") for c in labels])
    rows = df.select(x.alias("x"), y.alias("y"), (uniform01(key, f"{seed}v") < validation).alias("held"))
    spark = df.sparkSession
    rows = staged(rows.where(F.exists("y", lambda v: v.isNotNull())), shared_dir(spark, "training"))
    fitted = rows.where(~F.col("held"))
    own = [F.get("y", F.lit(i)) for i in range(len(labels))]
    stats = rows.agg(*[a for v in own for a in (F.avg(F.when(~F.col("held"), v)), F.min(v), F.max(v))]).first()
    base = [float("nan") if m is None else round(m, 6) for m in stats[::3]]
    reach = [0.0 if a is None or b != b else max(b - a, c - b) for b, a, c in zip(base, stats[1::3], stats[2::3])]
    edges = bin_edges(fitted, "x", len(features), bins)
    made = staged(blocks(rows, len(features), base, edges), shared_dir(spark, "blocks"))
    return made, edges, base, [ONE / r if r > 0 else 1.0 for r in reach]


def fit_forest(df: DataFrame, labels: list[str], features: list[str], key: str, seed: int = SEED, validation: float = VALIDATION_SHARE, max_iter: int = MAX_ITER, max_depth: int = MAX_DEPTH,
               learning_rate: float = LEARNING_RATE, bins: int = BINS, patience: int = PATIENCE, tolerance: float = TOLERANCE, min_rows: int = 1) -> Forest:
    """Fit log10 of every positive response on its own rows, all responses in the same passes."""
    labels, spark, n = sort_by_depth(labels), df.sparkSession, len(features)
    rows, edges, base, scale = training_blocks(df, labels, features, key, seed, validation, bins)
    rows.persist()
    trees: list[list[Tree]] = [[] for _ in labels]
    recent: list[list[Tree]] = [[] for _ in labels]
    errors: list[list[float]] = [[] for _ in labels]
    active = [i for i, b in enumerate(base) if b == b]
    try:
        for done in range(max_iter + 1):
            growing = {i: Tree.empty(max_depth) for i in active}
            for level in range(max_depth):
                if not growing:
                    break
                found = splits(histograms(rows, n, recent, growing, level, bins + 1, scale, max_depth), bins + 1, min_rows).collect()  # one row per open node and slice
                if level == 0 and done:
                    for r in (r for r in found if r["node"] < 0 and r["c"]):
                        errors[r["label"]].append(r["s"] * ONE / r["c"] / scale[r["label"]] ** 2)
                if level == 0:
                    stopped = {i for i in growing if errors[i] and len(errors[i]) - best_prefix(errors[i], patience, tolerance) >= patience}
                    active = [] if done == max_iter else [i for i in active if i not in stopped]
                    growing = {i: growing[i] for i in active}
                grown = set()
                for r in sorted((r for r in found if r["node"] >= 0 and r["label"] in growing), key=lambda r: (r["label"], r["node"], -r["gain"], r["slice"])):
                    i, at = r["label"], 2 ** level - 1 + r["node"]
                    tree, lift = growing[i], learning_rate / scale[r["label"]]
                    if level == 0 and tree.feature[0] < 0:
                        tree.value[0] = lift * r["s"] / r["c"]
                    if tree.feature[at] >= 0 or r["feature"] < 0:  # a better slice came first, or nothing to split
                        continue
                    tree.feature[at], tree.cut[at], tree.missing_left[at] = r["feature"], r["cut"], r["missing_left"]
                    tree.value[2 * at + 1] = lift * r["sl"] / r["cl"]
                    tree.value[2 * at + 2] = lift * (r["s"] - r["sl"]) / (r["c"] - r["cl"])
                    grown.add(i)
                for i in [i for i in growing if i not in grown]:
                    trees[i].append(growing.pop(i))
            for i, tree in growing.items():
                trees[i].append(tree)
            if not active:
                break
            for i in active:
                recent[i].append(trees[i][-1])
            if (done + 1) % REFRESH == 0:
                fresh = staged(refreshed(rows, n, recent, max_depth), shared_dir(spark, "blocks"))
                rows.unpersist()
                rows, recent = fresh.persist(), [[] for _ in labels]
    finally:
        rows.unpersist()
    kept = [t[:best_prefix(e, patience, tolerance)] if e else t for t, e in zip(trees, errors)]
    return Forest(list(features), labels, max_depth, edges, base, kept, [len(t) for t in trees], errors)


def score_forest(df: DataFrame, forest: Forest, consts: dict | None = None, linear: bool = False, out: str = "chla", incomplete: str = "predict", kind: str = "float") -> DataFrame:
    """Predictions of all responses as one array per row, in one vectorised pass; no shuffle.

    All columns of ``df`` travel through the pass: select what is needed before.

    Rows with a missing predictor are predicted like all others ("predict"), get a NULL
    array ("blank"), or are left out ("drop").
    """
    if incomplete not in ("predict", "blank", "drop"):
        raise ValueError(f"unknown rule {incomplete!r}")
    columns, width = df.columns, len(forest.features)
    shared = df.sparkSession.sparkContext.broadcast(forest)  # fixed size: nodes of the model

    def run(batches):
        model = shared.value
        for batch in batches:
            values = matrix(batch.column("_x"), width)
            found = np.empty((len(values), len(model.labels)))
            for at in range(0, len(values), BLOCK_ROWS // 4):
                codes = coded(values[at:at + BLOCK_ROWS // 4], model.edges)
                for i, trees in enumerate(model.trees):
                    found[at:at + len(codes), i] = model.base[i] + summed(trees, codes, model.depth)
            ends = pa.array(np.arange(len(values) + 1) * len(model.labels), pa.int32())
            profile = pa.ListArray.from_arrays(ends, pa.array(found.ravel(), from_pandas=True))
            kept = [*columns, "_whole"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], profile], names=[*kept, "_y"])

    whole = F.lit(incomplete == "predict") | ~F.exists("_x", lambda v: v.isNull())
    x = F.transform(_features_with_consts(df, forest.features, consts or {}), lambda v: F.nanvl(v, F.lit(None)))
    ready = df.withColumn("_x", x).withColumn("_whole", whole)
    if incomplete == "drop":
        ready = ready.where("_whole")
    ready = ready.select(*columns, "_whole", "_x")
    form = T.StructType([*[f for f in ready.schema.fields if f.name != "_x"], T.StructField("_y", T.ArrayType(T.DoubleType()))])
    scored = F.transform("_y", lambda v: (pow10(v) if linear else v).cast(kind))
    return ready.mapInArrow(run, form).select(*columns, F.when(F.col("_whole"), scored).alias(out))


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """One JSON line: the model is of fixed size."""
    info = {k: getattr(forest, k) for k in ("features", "labels", "depth", "edges", "base", "rounds", "errors")}
    info["trees"] = [[{k: v.tolist() for k, v in vars(t).items()} for t in trees] for trees in forest.trees]
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_forest(spark: SparkSession, path: str) -> Forest:
    info = json.loads(spark.read.text(path).first()["value"])
    kinds = {"feature": np.int32, "cut": np.uint8, "missing_left": bool, "value": float}
    info["trees"] = [[Tree(**{k: np.array(t[k], d) for k, d in kinds.items()}) for t in trees] for trees in info["trees"]]
    return Forest(**info)
