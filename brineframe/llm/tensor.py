"""Near duplicates by MinHash with tensored banding, verified exactly, and the groups that links connect.

A table key of 2 k minhashes is a pair: one of ``t`` subkeys of the first collection and one of ``t`` of the
second, each of k minhashes. So t * t tables need 2 t k minhashes instead of 2 t t k. Two
sets of similarity s share a table unless all subkeys of one collection differ, which has a probability of
at most 2 (1 - s**k)**t; ``collections`` chooses t so that this is at most ``MISSED`` at the
threshold. Sets that share no table are never compared, sets below the threshold are
never linked.

1. Each document becomes its set of shingles (64-bit hashes, known by 128 bits), its size and
   its subkeys. Equal sets become one node.
2. Chunks of nodes ask key buckets which of their table keys occur elsewhere (4 bytes a key,
   one bit back). Only those become rows (key, node).
3. *Leaders.* Every table cell whose nodes are not in one component yet has leaders: the nodes that share most
   cells. A node outside its cell's largest component is compared with ``PICKS`` of the leaders it meets, the ones it
   meets most often. So a round compares at most ``PICKS`` pairs a node, however large a cell is.
4. *Rest.* Nodes of cells that stay open are compared with all nodes of other components that they share a
   cell with, in tiles of ``TILE_BYTES`` (``across``). Only links leave a tile. No candidate pair between
   components is left out; a crowd whose members are too far apart to link costs its pairs as comparisons
   inside tiles, not as rows.

Compared pairs must be near enough in size, their sets are made from the texts of the nodes that share
a cell, and 100 * intersection >= percent * union is decided on full sets.

Defined cases: null, empty and word-free texts have no shingle and stay alone; a text of
fewer than ``n`` words is one shingle; equal rows belong together; the smallest non-null
doc_id (of any type) names a component, null if there is none; a row is kept if its doc_id
is that name, so rows of one id are kept together, and null ids only where there is no other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from ..sources.tables import staged
from . import text as tx
from .bpe import text_slices
from .chunks import CHUNK, asked, bucket_order, consult, replies
from .components import components
from .similar import chunk_sets, verified

N = 2
PERCENT = 80
K = 3  # minhashes of a subkey: 2 K per table keep a million unrelated sets apart
MISSED = 1e-4
ROUNDS = 3
PICKS = 2  # leaders that a node is compared with in a round
SEED = 77
NODES = 12  # bits: nodes of a chunk
TILE_BYTES = 16 << 20
PAIR = "a long, b long"


def collections(percent: int = PERCENT, k: int = K, missed: float = MISSED) -> int:
    """Subkeys of each collection, so that a pair at the threshold is missed with that probability at most."""
    return ceil(log(missed / 2) / log(1 - (percent / 100) ** k))


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * tx.U(2) + tx.U(1)


def subkeys(numbers: np.ndarray, distinct: np.ndarray, first: np.ndarray, k: int, t: int) -> np.ndarray:
    """(sets, 2 t) subkeys: each combines the minima of k hashes over the set's shingles."""
    out = np.zeros((len(first), 2 * t), np.uint64)
    for i, a in enumerate(multipliers(2 * t * k).tolist()):
        least = np.minimum.reduceat((distinct * tx.U(a))[numbers], first)
        out[:, i // k] = tx.mix(out[:, i // k] * tx.U(tx.BASES[0]) + least)
    return out


def table_keys(sub: np.ndarray, t: int) -> np.ndarray:
    """(sets, t * t) table keys: every subkey of the first collection with every one of the second."""
    one, two = sub[:, :t] * tx.U(tx.BASES[1]), tx.mix(sub[:, t:], 1)
    place = tx.mix(np.arange(1, t * t + 1, dtype=np.uint64)).reshape(t, t)
    return tx.mix((one[:, :, None] + two[:, None, :]) ^ place).reshape(len(sub), t * t)


def sketches(docs: DataFrame, n: int, k: int, t: int) -> DataFrame:
    """(doc_id, mark of the text, n, set, sub): one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tx.release_memory()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                docs_, numbers, distinct, _, _ = chunk_sets(texts, n)
                own, first, size = np.unique(docs_, return_index=True, return_counts=True)
                sub = subkeys(numbers, distinct, first, k, t) if len(own) else np.zeros((0, 2 * t), np.uint64)
                sizes, names, subs = np.zeros(len(texts), np.int64), [None] * len(texts), [None] * len(texts)
                sizes[own] = size
                for i, (d, a, m) in enumerate(zip(own.tolist(), first.tolist(), size.tolist())):
                    names[d] = hashlib.blake2b(distinct[numbers[a:a + m]].tobytes(), digest_size=16).digest()
                    subs[d] = sub[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("mark"), pa.array(sizes), pa.array(names, pa.binary()), pa.array(subs, pa.binary())], names=["doc_id", "mark", "n", "set", "sub"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"doc_id {kind}, mark long, n long, set binary, sub binary")


def seen_elsewhere(table: pa.Table) -> pa.Table:
    """For each key of each chunk: does it occur more than once in all?"""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("extra").to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    more = (np.bincount(inverse, counts) > 1)[inverse]
    cut = np.cumsum([len(x) for x in keys])[:-1]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "reply": pa.array([np.packbits(x).tobytes() for x in np.split(more, cut)], pa.binary())})


def posted(nodes: DataFrame, t: int) -> DataFrame:
    """(key, id, n, cells): the table cells of every node that another node has, too, and how many they are."""
    spark = nodes.sparkSession
    buckets = max(1, -(-nodes.count() * t * t // 1_000_000))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select(F.shiftright("id", NODES).alias(CHUNK), "id", "n", "sub").repartition(parts, CHUNK)

    def cells(rows):
        sub = np.frombuffer(b"".join(rows.column("sub").to_pylist()), np.uint64).reshape(rows.num_rows, 2 * t)
        keys = table_keys(sub, t)
        distinct, number, count = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
        return keys, distinct, number.reshape(keys.shape), count

    def ask(chunk, rows):
        _, distinct, _, count = cells(rows)
        return asked(chunk, distinct.astype(np.uint32), distinct, buckets, np.minimum(count, 255).astype(np.uint8))

    def decide(chunk, rows, answers):
        keys, distinct, number, _ = cells(rows)
        order, _, cut = bucket_order(distinct, buckets)
        more = np.zeros(len(distinct), bool)
        sizes = np.diff([*cut.tolist(), len(distinct)])
        bits = [np.unpackbits(np.frombuffer(r, np.uint8), count=m) for r, m in zip(replies(answers), sizes.tolist())]
        more[order] = np.concatenate(bits).astype(bool)
        node, cell = np.nonzero(more[number])
        own = pa.array(node)
        return pa.table({"key": pa.array(keys[node, cell].view(np.int64)), "id": rows.column("id").combine_chunks().take(own), "n": rows.column("n").combine_chunks().take(own),
                         "cells": pa.array(more[number].sum(axis=1)[node])})

    return consult(dealt, ask, seen_elsewhere, decide, "key long, id long, n long, cells long")


def bodies(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, body): the shingle sets of the wanted nodes, made from one text of each."""
    mine = nodes.join(wanted, "id", "left_semi").select("id", F.col("doc_id").alias("doc"), F.col("mark").alias("own"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    some = rows.join(mine, (F.col("mark") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("id", "text").dropDuplicates(["id"])

    def run(batches):
        tx.release_memory()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                own, numbers, distinct, _, _ = chunk_sets(texts, n)
                at = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
                found = [distinct[numbers[a:b]].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "body"])

    return some.mapInArrow(run, "id long, body binary")


def leaders_met(cells: DataFrame, outside: DataFrame, r: int, near) -> DataFrame:
    """(id, a, c): the leaders a that an outside node meets in c cells. Leaders are the nodes that share most cells:
    the centre of a crowd is near most of it. Their number in a cell grows fourfold from round to round."""
    place = F.col("cells") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1 << 32))
    slot = F.pmod(F.xxhash64("id", F.lit(-r)), F.lit(4 ** r)).alias("slot")
    lead = cells.groupBy("key", slot).agg(F.max_by("id", place).alias("a"), F.max_by("n", place).alias("m"), F.max_by("comp", place).alias("c"))
    met = outside.select("key", "id", "n", "comp").join(lead, "key").where((F.col("comp") != F.col("c")) & near(F.col("n"), F.col("m")))
    return met.groupBy("id", "a").agg(F.count("*").alias("c"))


def linked(posts: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, rounds: int = ROUNDS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(node, component) of the nodes that links connect; ``posts`` are (key, id, n, cells)."""
    spark = posts.sparkSession
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    cells = outside = posts.withColumn("comp", F.col("id"))
    links = tried = None
    for r in range(rounds):
        often = leaders_met(cells, outside, r, near)
        often = often if tried is None else often.join(tried, ["id", "a"], "left_anti")
        first = Window.partitionBy("id").orderBy(F.desc("c"), F.xxhash64("a", F.lit(r)))
        chosen = staged(often.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PICKS).select("id", "a"), shared_dir(spark, "tried"))
        tried = chosen if tried is None else tried.union(chosen)
        pairs = chosen.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        more = staged(verified(pairs, sets, percent), shared_dir(spark, "verified"))
        links = more if links is None else links.union(more)
        label = staged(components(links), shared_dir(spark, "labels"))
        # cells whose nodes are not in one component yet, and their nodes outside the largest one
        known = posts.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        known = staged(known, shared_dir(spark, "cells"))
        sizes = known.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1")
        cells = staged(known.join(sizes.select("key", "main"), "key"), shared_dir(spark, "open"))
        outside = cells.where("comp != main")
    rest = staged(across(cells.select("id", "n", "comp").distinct(), nodes, sets, percent, tile_bytes), shared_dir(spark, "verified"))
    return components(links.union(rest))


def across(some: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, tile_bytes: int) -> DataFrame:
    """Links between nodes of different components that share a table cell.

    Nodes that share a subkey of the first collection form a group; a group that takes more than
    ``tile_bytes`` is cut into slots, and every pair of slots is a tile. A tile finds the pairs that share a subkey of the
    second collection, too, and share no earlier one of the first (another group has those), and
    compares their sets.
    """
    spark = some.sparkSession
    full = staged(some.join(nodes.select("id", "sub"), "id").join(sets, "id"), shared_dir(spark, "rest"))
    half = F.octet_length("sub") / 16
    keyed = full.select("id", "comp", (F.octet_length("body") + F.octet_length("sub")).alias("size"), F.explode(F.sequence(F.lit(0), (half - 1).cast("int"))).alias("i"), "sub")
    keyed = keyed.select("id", "comp", "size", "i", F.expr("substring(sub, i * 8 + 1, 8)").alias("one"))
    groups = keyed.groupBy("i", "one", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("size")).groupBy("i", "one").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.sum("size").alias("size")).where("k > 1")
    slots = F.ceil(F.col("size") / tile_bytes).cast("int")
    placed = keyed.drop("size", "comp").join(groups.select("i", "one", "main", slots.alias("slots")), ["i", "one"])
    own = F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")
    placed = placed.select("id", "i", "one", "main", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other"))
    tiles = placed.select("id", "i", "one", "main", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).join(full, "id")

    def run(rows):
        tx.release_memory()
        i, main = rows.column("i")[0].as_py(), rows.column("main")[0].as_py()
        crossing = rows.column("x")[0].as_py() != rows.column("y")[0].as_py()
        ids, comp, size, slot = (rows.column(c).to_numpy() for c in ("id", "comp", "n", "own"))
        sub = np.frombuffer(b"".join(rows.column("sub").to_pylist()), np.uint64).reshape(len(ids), -1)
        one, two = np.split(sub, 2, axis=1)
        flat = np.frombuffer(b"".join(rows.column("body").to_pylist()), np.uint64)
        at = np.concatenate([[0], np.cumsum(size)])
        a, b = [], []
        for r in np.flatnonzero(comp != main).tolist():
            other = (comp != comp[r]) & (100 * np.minimum(size, size[r]) >= percent * np.maximum(size, size[r]))
            other &= (comp == main) | (ids > ids[r])  # two outside nodes meet once
            if crossing:
                other &= slot != slot[r]
            met = np.flatnonzero(other)
            met = met[(two[met] == two[r]).any(axis=1) & ~(one[met, :i] == one[r, :i]).any(axis=1)]
            if not len(met):
                continue
            own = flat[at[r]:at[r + 1]]
            part = np.concatenate([flat[at[m]:at[m + 1]] for m in met.tolist()])
            place = np.minimum(np.searchsorted(own, part), len(own) - 1)
            both = np.add.reduceat((own[place] == part).astype(np.int64), np.concatenate([[0], np.cumsum(size[met])[:-1]]))
            hit = met[100 * both >= percent * (size[r] + size[met] - both)]
            a += [ids[r]] * len(hit)
            b += ids[hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.select("i", "one", "x", "y", "main", "own", "id", "n", "comp", "sub", "body").groupBy("i", "one", "x", "y").applyInArrow(run, PAIR)


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, k: int = K, missed: float = MISSED, rounds: int = ROUNDS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)"""
    spark, t = docs.sparkSession, collections(percent, k, missed)
    docs = docs.select("doc_id", "text")
    rows = staged(sketches(docs, n, k, t), shared_dir(spark, "sketches"))
    distinct = rows.where("n > 0").groupBy("set").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("one"), F.first("n").alias("n"), F.first("sub").alias("sub"))
    nodes = staged(distinct.select(F.monotonically_increasing_id().alias("id"), "set", "one.doc_id", "one.mark", "n", "sub"), shared_dir(spark, "nodes"))
    posts = staged(posted(nodes, t), shared_dir(spark, "posts"))
    sets = staged(bodies(docs, nodes, posts.select("id").distinct(), n), shared_dir(spark, "bodies"))
    label = linked(posts, nodes, sets, percent, rounds, tile_bytes)
    own = nodes.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "set", "doc_id", F.coalesce("component", "id").alias("component"))
    own = staged(own, shared_dir(spark, "components"))
    names = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = own.join(names, "component").select("set", "component_id")
    full = rows.select("doc_id", F.col("n").alias("n_shingles"), "set").join(named, "set", "left")
    name = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", "n_shingles", name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))
