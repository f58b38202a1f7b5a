"""Hard negatives by angular triangle filtering.

Every vector stores its norm and its angles to ``REFERENCES`` unit directions (chosen far apart from a sample of
at most ``SAMPLE`` rows, the ones of smallest id hash). The angle between two vectors lies between the largest
difference of their angles to a direction and the smallest sum of them, so its cosine
lies in an interval; times both norms, widened for rounding and to whole numbers, this bounds the
integer score. Only vectors whose bounds overlap a window that matters are scored.

1. Vectors are ranged by (label, nearest direction, angle to it, id) and packed to blocks of
   ``BLOCK`` rows of one label, the anchors among them to blocks of ``ANCHORS``. A block of vectors is cut into
   groups of ``GROUP`` neighbours with common angle and norm intervals.
2. *Positives.* Anchor blocks meet the blocks of their label. A group is scored if its upper bound
   reaches the lower bound that enough other vectors have. The first ``POSITIVES`` of each
   pair of blocks are merged by a ranking window.
3. *Negatives.* Each (anchor, positive) has the window LOW * p <= 100 * score <= HIGH * p. Pairs of blocks of different labels
   whose bounds overlap no window are left out before they are sent; then groups as above,
   with the window's lower end raised to what enough vectors are known to reach.

The anchors are a stated query set against all rows, in blocks: a pair of blocks is one group of a cogroup and all
its work is bounded. Scores are exact: float products below 2**53, else 64-bit
integers, else Python integers (a score that does not fit 64 bits is an error).

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no
part; vectors of different lengths are compared as if the shorter went on with zeros; a zero
vector scores 0 with everything; repeated ids are different rows with results of their own, but an
anchor's id is never its positive or negative; equal scores are ranked by id; a positive with a negative score has an
empty window; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from ..sources.tables import staged
from . import text as tx

# fixed values of the query
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
SCALE = 256

REFERENCES = 8
SAMPLE = 2048
BLOCK = 8192
ANCHORS = 512
GROUP = 64
TOGETHER = 8  # anchor blocks that a task holds at a time
ANGLE_SLACK = 1e-5
NO_SCORE = -(1 << 62)
BLOCKS = ("block long, label long, rows int, dim int, ids binary, q binary, angles binary, norms binary, "
          "low array<double>, high array<double>, least double, most double")
SCORED = "ablock long, row long, nth long, anchor_id long, positive_id long, positive_score long, other long, score long"


def relabelled(rows: DataFrame) -> DataFrame:
    """Labels as the query wants them: where vec_id is divisible by 7, the next of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def matrix(vectors: list) -> np.ndarray:
    """Rows of floor(SCALE * x), shorter ones filled with zeros."""
    wide = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.floor(SCALE * out)


def directions(sample: list, count: int = REFERENCES) -> np.ndarray:
    """Unit directions of the sample that are far apart: each has the smallest largest cosine with those before."""
    q = matrix(sample)
    norm = np.sqrt((q * q).sum(axis=1))
    unit = q[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return np.zeros((0, q.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def angles_to(q: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of every row to every direction (a right one for a zero vector), and the norms."""
    wide = max(q.shape[1], refs.shape[1])
    a, r = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, refs))
    norm = np.sqrt((a * a).sum(axis=1))
    cos = (a @ r.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), np.pi / 2).reshape(len(q), len(refs)), norm


def packed(rows: DataFrame, refs: np.ndarray, block: int, parts: int) -> DataFrame:
    """Blocks of rows of one label, in the order of nearest direction, angle and id."""
    def place(batches):
        for batch in batches:
            q = matrix(batch.column("embedding").to_pylist())
            angle, _ = angles_to(q, refs)
            near = angle.argmin(axis=1) if angle.shape[1] else np.zeros(len(q), np.int64)
            least = angle.min(axis=1) if angle.shape[1] else np.zeros(len(q))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(least)], names=[*batch.schema.names, "near", "angle"])

    def pack(batches):
        tx.release_memory()
        have, size = [], 0

        def full(n):
            nonlocal have, size
            table = pa.Table.from_batches(have)
            own, rest = table.slice(0, n), table.slice(n)
            have, size = rest.to_batches(), rest.num_rows
            q = matrix(own.column("embedding").to_pylist())
            angle, norm = angles_to(q, refs)
            ids = own.column("vec_id").to_numpy()
            mark = own.column("part")[0].as_py()
            return mark, own.column("label")[0].as_py(), ids, q, angle, norm

        def row(n, k):
            part, label, ids, q, angle, norm = full(n)
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) | k, "label": label, "rows": len(ids), "dim": q.shape[1], "ids": ids.astype(np.int64).tobytes(), "q": stored(q),
                "angles": angle.astype(np.float32).tobytes(), "norms": norm.tobytes(),
                "low": angle.min(axis=0).tolist(), "high": angle.max(axis=0).tolist(), "least": float(norm.min()), "most": float(norm.max())}], schema=block_schema())

        k = 0
        for batch in batches:
            label = batch.column("label").to_numpy()
            for a, b in zip(*(x.tolist() for x in _stretches(label))):
                if have and have[0].column("label")[0].as_py() != int(label[a]):
                    yield row(size, k)
                    k += 1
                have.append(batch.slice(a, b - a))
                size += b - a
                while size >= block:
                    yield row(block, k)
                    k += 1
        if size:
            yield row(size, k)

    kinds = rows.schema["embedding"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id long, label long, embedding {kinds}, near int, angle double")
    order = ("label", "near", "angle", "vec_id")
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return ranged.mapInArrow(pack, BLOCKS)


def _stretches(label: np.ndarray):
    cut = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else np.zeros(0, np.int64)
    return cut, np.append(cut[1:], len(label)) if len(label) else cut


def block_schema() -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("label", pa.int64()), ("rows", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "q", "angles", "norms")),
                      ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("least", pa.float64()), ("most", pa.float64())])


def stored(q: np.ndarray) -> bytes:
    """16-bit integers where they fit, else floats; the first byte says which."""
    return b"s" + q.astype(np.int16).tobytes() if not q.size or np.abs(q).max() < 1 << 15 else b"d" + q.tobytes()


class Block:
    """A packed block, read back."""

    def __init__(self, row: dict):
        n, self.dim = row["rows"], row["dim"]
        self.label, self.ids, self.norms = row["label"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"])
        raw = row["q"]
        self.q = np.frombuffer(raw[1:], np.int16 if raw[:1] == b"s" else np.float64).reshape(n, self.dim).astype(np.float64)
        self.angles = np.frombuffer(row["angles"], np.float32).reshape(n, -1).astype(np.float64)

    def groups(self, size: int = GROUP):
        """Bounds of the groups of neighbours: least and largest angles and norms."""
        at = np.arange(0, len(self.ids), size)
        return (np.minimum.reduceat(self.angles, at, axis=0), np.maximum.reduceat(self.angles, at, axis=0),
                np.minimum.reduceat(self.norms, at), np.maximum.reduceat(self.norms, at), np.append(at, len(self.ids)))


def score_bounds(angles, norms, low, high, least, most):
    """Whole-number bounds of the scores of every anchor with every group."""
    n, g = len(angles), len(low)
    nearest, widest = np.zeros((n, g)), np.full((n, g), np.pi)
    for j in range(angles.shape[1]):
        a = angles[:, j:j + 1]
        nearest = np.maximum(nearest, np.maximum(low[:, j] - a, a - high[:, j]))
        widest = np.minimum(widest, np.minimum(a + high[:, j], 2 * np.pi - a - low[:, j]))
    top, bottom = np.cos(np.clip(nearest - ANGLE_SLACK, 0, np.pi)), np.cos(np.clip(widest + ANGLE_SLACK, 0, np.pi))
    short, long = norms[:, None] * least, norms[:, None] * most
    slack = 1 + long * 1e-9
    return np.floor(np.where(bottom > 0, short, long) * bottom - slack), np.ceil(np.where(top > 0, long, short) * top + slack)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, wide)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[sum(int(x) * int(y) for x, y in zip(p, r)) for r in b] for p in a]
    if any(abs(s) >= 1 << 62 for p in whole for s in p):
        raise OverflowError("a score does not fit 64 bits")
    return np.array(whole, np.int64)


def first_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, count: int):
    """(anchor, row) places of each anchor's first ``count`` allowed rows by score, then id."""
    masked = np.where(allowed, scores, NO_SCORE)
    if masked.shape[1] > count:
        least = np.partition(masked, masked.shape[1] - count, axis=1)[:, masked.shape[1] - count]
        allowed = allowed & (masked >= least[:, None])
    at, row = np.nonzero(allowed)
    order = np.lexsort((ids[row], -scores[at, row], at))
    at, row = at[order], row[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < count], row[nth < count]


def reached(low: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """Per anchor, a score that at least ``count`` rows of the groups reach; NO_SCORE if there are not as many."""
    order = np.argsort(-low, axis=1)
    enough = np.cumsum(sizes[order], axis=1) >= count
    at = enough.argmax(axis=1)
    best = np.take_along_axis(low, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
    return np.where(enough.any(axis=1), best, NO_SCORE)


def scored_groups(anchors: Block, vectors: Block, needed: np.ndarray, cut: np.ndarray):
    """(anchor places, vector places, scores, mask of needed) where any group is needed."""
    who, groups = np.flatnonzero(needed.any(axis=1)), np.flatnonzero(needed.any(axis=0))
    if not len(who):
        return None
    rows = np.concatenate([np.arange(cut[g], cut[g + 1]) for g in groups])
    mask = np.repeat(needed[np.ix_(who, groups)], np.diff(cut)[groups], axis=1)
    return who, rows, exact_scores(anchors.q[who], vectors.q[rows]), mask


def nearest_of(anchors: Block, vectors: Block, count: int) -> dict:
    """The first vectors of one label for each anchor."""
    low, high, least, most, cut = vectors.groups()
    below, above = score_bounds(anchors.angles, anchors.norms, low, high, least, most)
    # one row more than wanted: the anchor itself may be among them
    found = scored_groups(anchors, vectors, above >= reached(below, np.diff(cut), count + int((vectors.ids[:, None] == anchors.ids).sum(axis=0).max(initial=0)))[:, None], cut)
    if found is None:
        return {}
    who, rows, scores, mask = found
    at, row = first_of(scores, mask & (vectors.ids[rows][None, :] != anchors.ids[who][:, None]), vectors.ids[rows], count)
    return {"anchor_id": anchors.ids[who[at]], "other": vectors.ids[rows[row]], "score": scores[at, row], "row": who[at]}


def within_windows(anchors: Block, vectors: Block, positives: np.ndarray, scores_of: np.ndarray, count: int) -> dict:
    """For each anchor and positive, the first vectors inside the window of the positive's score."""
    low, high, least, most, cut = vectors.groups()
    below, above = score_bounds(anchors.angles, anchors.norms, low, high, least, most)
    out = {"row": [], "nth": [], "anchor_id": [], "positive_id": [], "positive_score": [], "other": [], "score": []}
    windows, needed = [], np.zeros(below.shape, bool)
    for j in range(positives.shape[1]):
        p = scores_of[:, j]
        start, end = -(-LOW * p // 100), HIGH * p // 100
        start, end = np.where(p == NO_SCORE, 1, start), np.where(p == NO_SCORE, 0, end)
        inside = (below >= start[:, None]) & (above <= end[:, None])
        known = reached(np.where(inside, below, NO_SCORE), np.diff(cut), count)
        start = np.maximum(start, known.astype(np.int64))
        windows.append((start, end))
        needed |= (above >= start[:, None]) & (below <= end[:, None]) & (start <= end)[:, None]
    found = scored_groups(anchors, vectors, needed, cut)
    if found is None:
        return {}
    who, rows, scores, mask = found
    mask = mask & (vectors.ids[rows][None, :] != anchors.ids[who][:, None])
    for j, (start, end) in enumerate(windows):
        allowed = mask & (scores >= start[who][:, None]) & (scores <= end[who][:, None])
        at, row = first_of(scores, allowed, vectors.ids[rows], count)
        own = who[at]
        for name, values in (("row", own), ("nth", np.full(len(own), j)), ("anchor_id", anchors.ids[own]), ("positive_id", positives[own, j]), ("positive_score", scores_of[own, j]), ("other", vectors.ids[rows[row]]), ("score", scores[at, row])):
            out[name].append(values)
    return {k: np.concatenate(v) for k, v in out.items()}


def gathered(parts: list[dict], names: list[str]) -> pa.Table:
    parts = [p for p in parts if p]
    return pa.table({n: pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for n in names})


def met_blocks(pairs: DataFrame, anchors: DataFrame, vectors: DataFrame, work, schema: str) -> DataFrame:
    """work(anchor rows, vector block) for the stated pairs (ablock, block, share) of blocks: a bounded number of anchor blocks at a time."""
    left = anchors.join(pairs, "ablock")
    needed = pairs.select(F.col("block").alias("of"), F.col("share").alias("part")).distinct()
    right = vectors.join(needed, vectors["block"] == needed["of"]).drop("block").withColumnRenamed("of", "block")
    return left.groupBy("block", "share").cogroup(right.groupBy("block", "part")).applyInArrow(work, schema)


def block_pairs(anchors: DataFrame, vectors: DataFrame, slots: int) -> DataFrame:
    """Every anchor block with every block, by way of slots: (a, v) structs of their summaries."""
    a = anchors.select(F.struct(*[c for c in anchors.columns if c not in ("ids", "q", "angles", "norms", "positives", "scores")]).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    v = vectors.select(F.struct("block", "label", "rows", "low", "high", "least", "most").alias("v"), F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"))
    return a.join(v, "slot")


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, anchors_per_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)"""
    spark = rows.sparkSession
    own = usable(rows)
    sample = [r[0] for r in own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()]  # bounded
    refs = directions(sample)
    count, queries = own.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = staged(packed(own, refs, block, max(1, min(least_parts, -(-count // block)), -(-count // (16 * block)))), shared_dir(spark, "vectors"))
    anchor_rows = own.where(F.col("vec_id") % every == 0)
    anchors = staged(packed(anchor_rows, refs, anchors_per_block, max(1, -(-queries // (16 * anchors_per_block)))).withColumnRenamed("block", "ablock"), shared_dir(spark, "anchors"))
    slots = max(1, -(-count // block))
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-queries // (anchors_per_block * TOGETHER))))).alias("share")

    same = block_pairs(anchors, vectors, slots).where("a.label = v.label").select("a.ablock", "v.block", share("a.ablock"))

    def near(left, right):
        if not right.num_rows:
            return gathered([], ["ablock", "row", "anchor_id", "other", "score"])
        tx.release_memory()
        v, parts = Block(right.to_pylist()[0]), []
        for r in left.to_pylist():
            found = nearest_of(Block(r), v, positives)
            parts.append(found | {"ablock": np.full(len(found["row"]), r["ablock"])} if found else {})
        return gathered(parts, ["ablock", "row", "anchor_id", "other", "score"])

    close = met_blocks(same, anchors, vectors, near, "ablock long, row long, anchor_id long, other long, score long")
    by = Window.partitionBy("ablock", "row").orderBy(F.desc("score"), "other")
    chosen = staged(close.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= positives), shared_dir(spark, "positives"))

    def attach(left, right):
        """The anchors' positives, as matrices beside the vectors."""
        if not left.num_rows:
            return left.append_column("positives", pa.nulls(0, pa.binary())).append_column("scores", pa.nulls(0, pa.binary())).append_column("start", pa.nulls(0, pa.int64())).append_column("end", pa.nulls(0, pa.int64()))
        n = left.column("rows")[0].as_py()
        ids, scores = np.zeros((n, positives), np.int64), np.full((n, positives), NO_SCORE, np.int64)
        at, nth = right.column("row").to_numpy(), right.column("nth").to_numpy() - 1
        ids[at, nth], scores[at, nth] = right.column("other").to_numpy(), right.column("score").to_numpy()
        real = scores[scores >= 0]
        for name, value in (("positives", ids.tobytes()), ("scores", scores.tobytes())):
            left = left.append_column(name, pa.array([value], pa.binary()))
        left = left.append_column("start", pa.array([int(real.min()) * LOW // 100 if len(real) else None], pa.int64()))
        return left.append_column("end", pa.array([int(real.max()) * HIGH // 100 if len(real) else None], pa.int64()))

    schema = BLOCKS.replace("block long", "ablock long", 1) + ", positives binary, scores binary, start long, end long"
    armed = staged(anchors.groupBy("ablock").cogroup(chosen.groupBy("ablock")).applyInArrow(attach, schema), shared_dir(spark, "windows"))

    # bounds of whole blocks, as in score_bounds
    nearest = F.expr("""aggregate(zip_with(arrays_zip(a.low, a.high), arrays_zip(v.low, v.high), (x, y) -> greatest(y.low - x.high, x.low - y.high)), 0D, (m, x) -> greatest(m, x))""")
    top = F.cos(F.greatest(F.col("nearest") - F.lit(ANGLE_SLACK), F.lit(0.0)))
    upper = top * F.when(top > 0, F.col("a.most") * F.col("v.most")).otherwise(F.col("a.least") * F.col("v.least"))
    slack = 1 + F.col("a.most") * F.col("v.most") * F.lit(1e-9)
    pairs = block_pairs(armed, vectors, slots).where("a.label != v.label AND a.start IS NOT NULL").withColumn("nearest", nearest)
    pairs = pairs.where(upper + slack >= F.col("a.start")).select("a.ablock", "v.block", share("a.ablock"))

    def windowed(left, right):
        names = [c.split(" ")[0] for c in SCORED.split(", ")]
        if not right.num_rows:
            return gathered([], names)
        tx.release_memory()
        v, parts = Block(right.to_pylist()[0]), []
        for r in left.to_pylist():
            ids, scores = (np.frombuffer(r[c], np.int64).reshape(r["rows"], positives) for c in ("positives", "scores"))
            own = within_windows(Block(r), v, ids, scores, negatives)
            parts.append(own | {"ablock": np.full(len(own["row"]), r["ablock"])} if own else {})
        return gathered(parts, names)

    found = met_blocks(pairs, armed, vectors, windowed, SCORED)
    by = Window.partitionBy("ablock", "row", "nth").orderBy(F.desc("score"), "other")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
