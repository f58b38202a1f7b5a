"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a tree of contexts, the last 0 to ``DEPTH``
bytes. A node keeps how often the decision was 0 and 1 after its context in the training texts
(Krichevsky-Trofimov estimate), and its weighted probability mixes its own estimate with the
product of its children's, one half each, at every depth. Scoring walks from the root to
the deepest context seen in training with the posterior weights of that mixture; a decision
never seen in a context falls back to the next shorter one. A text ends with an end symbol
(byte 0xFF, which UTF-8 never has; it also fills the context before a text's start). The
model is frozen: training texts are scored by the counts they are part of.

Plan: (1) every task counts the n-grams and words of its training texts; the counts are dealt
by hash and added up. N-grams with the same last two context bytes share a bucket, so the trees
below depth two are built inside buckets; what is above (at most 65,536 nodes per level, whatever
the input) is finished on the driver and broadcast. (2) Chunks of documents ask for the
probabilities and counts of their distinct n-grams and words and score their texts
(``chunks``). Nothing else of the corpus is broadcast or collected.

Defined cases: a null text scores as the empty one (its end only); a null id has crc32 0
and is a training row; without training rows every decision has probability 1/2 and no token
is known; words are known by 64 hash bits and the independent bits of their bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import staged
from . import text as tx
from .chunks import ANSWERED, ASKED, CHUNK, Layout, bucket_order, lean, ordered, texts_of
from ..session import shared_dir

DEPTH = 5
CHUNK_BYTES = 8 << 20
END = 0xFF
END_WORD = np.uint64(0x5EED0FE0D0F7E875)  # key of the end token among the words
FLUSH = 600_000
RAW = 1 << 20  # keys that are counted at once
PART_BYTES = 2 << 20  # of a chunk's texts, whose n-grams are sorted at once
U = np.uint64
HALF = np.log(0.5)


def is_held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of the lower-cased texts and per end: context and byte in one number (byte lowest, nearest context next), and the text."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    joined = b"".join([b"\xff" * 8, *(x for t in texts for x in (t, b"\xff"))]).lower()
    key = np.ndarray(int(size.sum()), ">u8", joined, 1, (1,)).astype(np.uint64)  # the eight bytes up to each place
    key &= U((1 << 8 * (depth + 1)) - 1)
    start = np.cumsum(size) - size
    for p in range(depth):  # the context does not reach into the text before
        key[(start + p)[size > p]] |= U(((1 << 8 * (depth - p)) - 1) << 8 * (p + 1))
    return key, np.repeat(np.arange(len(texts)), size)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key begins in an ascending array."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs, or the sum of its weights."""
    if weights is None:
        keys = np.sort(keys)
        first = runs(keys)
        return keys[first], np.diff(first, append=len(keys))
    order = np.argsort(keys)
    keys = keys[order]
    first = runs(keys)
    return keys[first], (np.add.reduceat(weights[order], first) if len(first) else weights).astype(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys of an ascending array."""
    return keys[runs(keys)]


def together(parts: list[np.ndarray]) -> np.ndarray:
    keys = np.concatenate([np.zeros(0, np.uint64), *parts])
    keys.sort()
    return distinct(keys)


def distinct_grams(texts: list[bytes], depth: int) -> np.ndarray:
    return together([together([grams(texts[a:b], depth)[0]]) for a, b in tx.blocks(texts)])


def parts_of(texts: list[bytes], depth: int) -> list[list[bytes]]:
    """Runs of texts that can be numbered in the bits that an n-gram leaves free, at most 16."""
    most = 1 << min(16, 56 - 8 * depth)
    return [texts[i:min(i + most, b)] for a, b in tx.blocks(texts, PART_BYTES) for i in range(a, b, most)]


def owned_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a part, ascending, how often each occurs, and the texts of all occurrences in that order."""
    out, at, bits = np.empty(sum(len(t) + 1 for t in texts), np.uint64), 0, min(16, 56 - 8 * depth)
    for a, b in tx.blocks(texts):
        key, owner = grams(texts[a:b], depth)
        owner += a
        key <<= U(bits)
        np.bitwise_or(key, owner.view(np.uint64), out=out[at:at + len(key)])
        at += len(key)
    out.sort()
    owner = (out & U((1 << bits) - 1)).astype(np.uint16)
    out >>= U(bits)
    first = runs(out)
    return out[first], np.diff(first, append=len(out)), owner


def owned_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of words and ends."""
    hashes, owner = words_and_marks(texts)
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = runs(hashes)
    return hashes[first], np.diff(first, append=len(hashes)), owner[order].astype(np.uint16)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by Stirling's series after a shift of 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + i) for i in range(8))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives a zeros and b ones."""
    return np.where(a + b > 0, lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi), 0.0)


class Level:
    """Nodes of one depth over some decisions: counts, estimates and weighted probabilities."""

    def __init__(self, node: np.ndarray, zero: np.ndarray, one: np.ndarray, inner: np.ndarray | None):
        order = np.argsort(node)
        first = runs(node[order])
        self.first = order[first]  # one entry of every node
        self.ids = node[self.first]
        self.at = np.empty(len(node), np.int64)
        self.at[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(node)))
        self.a = np.bincount(self.at, zero, len(self.ids))
        self.b = np.bincount(self.at, one, len(self.ids))
        self.n = self.a + self.b
        self.own = log_kt(self.a, self.b)
        if inner is None:
            self.total, self.weight = self.own, np.ones(len(self.ids))
        else:
            below = np.bincount(self.at, inner, len(self.ids))
            self.total = HALF + np.logaddexp(self.own, below)
            self.weight = np.exp(HALF + self.own - self.total)
        self.kt = (self.b + 0.5) / (self.n + 1.0)


class Forest:
    """Trees from ``top`` down to the full depth, over n-grams with their training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2):
        step = np.arange(8)
        byte = (keys & U(255)).astype(np.int64)[:, None]
        self.bit = ((byte >> (7 - step)) & 1).astype(bool)
        prefix = ((1 << step) | (byte >> (8 - step))).ravel()
        context = (keys >> U(8)).astype(np.int64)
        self.shape, self.levels = self.bit.shape, {}
        one = np.where(self.bit, counts[:, None], 0).ravel()
        zero = np.where(self.bit, 0, counts[:, None]).ravel()
        ids = lambda d: np.repeat(context & ((1 << 8 * d) - 1), 8) * 256 + prefix
        level = Level(ids(depth), zero, one, None)
        self.levels[depth], self.chain, parent_of = level, {depth: level.at}, level.first
        for d in range(depth - 1, top - 1, -1):
            up = ids(d)[parent_of]  # one entry per node below
            level = Level(up, level.a, level.b, level.total)
            self.levels[d] = level
            self.chain[d] = level.at[self.chain[d + 1]]
            parent_of = parent_of[level.first]

    def log_probability(self, depth: int, above: list[tuple[np.ndarray, np.ndarray]], context: np.ndarray) -> np.ndarray:
        """Natural log of every n-gram's probability, given the levels above: (chance of one, weight, count) tables."""
        levels = [(lv.kt[at], lv.weight[at], lv.n[at]) for lv, at in ((self.levels[d], self.chain[d]) for d in sorted(self.levels))]
        return path_probability([*above, *levels], self.bit)


def path_probability(levels: list, bit: np.ndarray) -> np.ndarray:
    """Mix the estimates along each path, deepest first; a level without counts yields to the one above it."""
    chance, seen = levels[-1][0], levels[-1][2] > 0
    for kt, weight, n in reversed(levels[:-1]):
        chance = weight * kt + (1 - weight) * np.where(seen, chance, kt)
        seen = n > 0
    chance = chance.reshape(bit.shape)
    return np.log(np.where(bit, chance, 1 - chance)).sum(axis=1)


def hash_context(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket marks of n-grams: all with the same last two context bytes have one."""
    return tx.mix((keys >> U(8)) & U(0xFFFF))


class Counter:
    """Counts keys, many at once, and now and then folds the counts."""

    def __init__(self):
        self.raw, self.waiting = [], 0
        self.parts, self.size, self.limit = [], 0, FLUSH

    def add(self, keys):
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting > RAW:
            self.count()

    def count(self):
        keys = np.concatenate([np.zeros(0, np.uint64), *self.raw])
        self.raw, self.waiting = [], 0
        self.parts.append(counted(keys))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            self.fold()
            self.limit = FLUSH + 2 * self.size  # so that folding stays in proportion

    def fold(self):
        self.parts = [counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
        self.size = len(self.parts[0][0])

    def result(self):
        self.count()
        self.fold()
        return self.parts[0]


def words_and_marks(texts: list[bytes]):
    """Hashes of all words with one end token per text (last), the text of each."""
    hashes, counts = tx.word_hashes(texts, lower=True)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), counts), np.arange(len(texts))])
    return np.concatenate([hashes, np.full(len(texts), END_WORD)]), owner


class Plan:
    """How words and n-grams are dealt: buckets 0.. for words, then those of n-grams."""

    def __init__(self, layout: Layout):
        self.words = layout.buckets(layout.bytes / 24)
        self.grams = int(min(4096, max(16, layout.bytes >> 26)))

    def rows(self, chunk: int, words: np.ndarray, grams: np.ndarray, values: tuple | None = None) -> pa.Table:
        out = []
        for offset, keys, marks, buckets, v in ((0, words, tx.mix(words, 1), self.words, 0), (self.words, grams, hash_context(grams, self.grams), self.grams, 1)):
            order, which, first = bucket_order(marks, buckets)
            last = [*first[1:].tolist(), len(keys)]
            for w, a, b in zip(which.tolist(), first.tolist(), last):
                out.append((offset + w, chunk, keys[order[a:b]].tobytes(), values[v][order[a:b]].tobytes() if values else None))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()), "keys": pa.array(cols[2], pa.binary()), "extra": pa.array(cols[3], pa.binary())})


def trained_counts(docs: DataFrame, plan: Plan, depth: int) -> DataFrame:
    """(bucket, keys, counts, v, n): counts of the training texts' words and n-grams, one row per bucket."""
    def count(batches):
        words, bytes_ = Counter(), Counter()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                train = ~is_held_out(batch.column("doc_id").to_pylist())
                texts = [t for t, k in zip(texts_of(batch), train) if k]
                for a, b in tx.blocks(texts):
                    words.add(words_and_marks(texts[a:b])[0])
                    bytes_.add(grams(texts[a:b], depth)[0])
        (w, wc), (g, gc) = words.result(), bytes_.result()
        return plan.rows(0, w, g, (wc, gc))

    def add(table):
        keys, counts = counted(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]),
                               np.concatenate([np.frombuffer(x, np.int64) for x in table.column("extra").to_pylist()]))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
                         "v": pa.array([len(keys)], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64())})

    counts = docs.select("doc_id", "text").mapInArrow(lambda batches: iter(lean(count, batches).to_batches()), ASKED)
    return counts.groupBy("bucket").applyInArrow(lambda t: lean(add, t), "bucket int, keys binary, counts binary, v long, n long")


def upper_levels(totals: DataFrame, plan: Plan, depth: int) -> tuple:
    """The root and the 256 contexts of depth one: chance of a one, weight and count per decision."""
    def top(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                lv = Forest(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64), depth).levels[2]
                near, prefix = (lv.ids >> 8) & 255, lv.ids & 255
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (near, prefix, lv.a, lv.b, lv.total)], names=["near", "prefix", "a", "b", "total"])

    def first(table):
        near, prefix, a, b, total = (table.column(c).to_numpy() for c in ("near", "prefix", "a", "b", "total"))
        lv = Level(near * 256 + prefix, a, b, total)
        return pa.table({"node": lv.ids, "a": lv.a, "b": lv.b, "total": lv.total, "weight": lv.weight})

    below = totals.where(F.col("bucket") >= plan.words).mapInArrow(top, "near long, prefix long, a double, b double, total double")
    rows = below.groupBy("near").applyInArrow(first, "node long, a double, b double, total double, weight double").collect()  # at most 256 * 255
    one = {k: np.full(65536, v) for k, v in (("kt", 0.5), ("weight", 1.0), ("n", 0.0))}
    root = {k: np.full(256, v) for k, v in (("kt", 0.5), ("weight", 1.0), ("n", 0.0))}
    if rows:
        node, a, b, total, weight = (np.array(c) for c in zip(*rows))
        one["kt"][node], one["weight"][node], one["n"][node] = (b + 0.5) / (a + b + 1), weight, a + b
        lv = Level(node & 255, a, b, total)
        root["kt"][lv.ids], root["weight"][lv.ids], root["n"][lv.ids] = lv.kt, lv.weight, lv.n
    return tuple((t["kt"], t["weight"], t["n"]) for t in (root, one))


def scored(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)"""
    spark = docs.sparkSession
    layout = Layout(docs, chunk_bytes=chunk_bytes)
    plan = Plan(layout)
    totals = staged(trained_counts(docs, plan, depth), shared_dir(spark, "counts"))
    row = totals.where(F.col("bucket") < plan.words).agg(F.sum("v"), F.sum("n")).first()
    vocabulary, tokens = row[0] or 0, row[1] or 0
    above = spark.sparkContext.broadcast(upper_levels(totals, plan, depth))
    dealt = layout.deal(docs, "doc_id", "text")

    def ask(key, rows):
        texts = texts_of(rows)
        words = together([together([words_and_marks(t)[0]]) for t in parts_of(texts, depth)])
        return plan.rows(key[0].as_py(), words, distinct_grams(texts, depth))

    def answer(key, questions, known):
        keys = np.frombuffer(known.column("keys")[0].as_py(), np.uint64) if known.num_rows else np.zeros(0, np.uint64)
        counts = np.frombuffer(known.column("counts")[0].as_py(), np.int64) if known.num_rows else np.zeros(0, np.int64)
        asked = [np.frombuffer(x, np.uint64) for x in questions.column("keys").to_pylist()]
        bucket = key[0].as_py()
        if not asked:
            values = []
        elif bucket < plan.words:
            values = [lookup(keys, counts, q) for q in asked]
        else:
            full, weights = counted(np.concatenate([keys, *asked]), np.concatenate([counts, np.zeros(sum(map(len, asked)), np.int64)]))
            forest = Forest(full, weights, depth)
            prefix = ((1 << np.arange(8)) | ((full & U(255)).astype(np.int64)[:, None] >> (8 - np.arange(8)))).ravel()
            near = np.repeat(((full >> U(8)) & U(255)).astype(np.int64), 8) * 256 + prefix
            root, one = above.value
            tops = [tuple(x[prefix] for x in root), tuple(x[near] for x in one)]
            logs = forest.log_probability(depth, tops, full) / np.log(10)
            values = [logs[np.searchsorted(full, q)] for q in asked]
        return pa.table({"chunk": questions.column("chunk"), "bucket": questions.column("bucket"), "reply": pa.array([v.tobytes() for v in values], pa.binary())})

    def decide(key, rows, answers):
        rows = ordered(rows)
        texts, ids = texts_of(rows), rows.column("doc_id").cast(pa.int64())
        cut = parts_of(texts, depth)
        own_words, own_grams = [owned_words(t) for t in cut], [owned_grams(t, depth) for t in cut]
        words, bytes_ = together([x[0] for x in own_words]), together([x[0] for x in own_grams])
        got = answers.sort_by("bucket")
        which, reply = got.column("bucket").to_numpy(), got.column("reply").to_pylist()
        seen = np.empty(len(words), np.int64)
        seen[bucket_order(tx.mix(words, 1), plan.words)[0]] = np.frombuffer(b"".join(r for r, w in zip(reply, which) if w < plan.words), np.int64)
        logs = np.empty(len(bytes_))
        logs[bucket_order(hash_context(bytes_, plan.grams), plan.grams)[0]] = np.frombuffer(b"".join(r for r, w in zip(reply, which) if w >= plan.words), np.float64)
        worth = np.log10((seen + 1) / (tokens + vocabulary + 1))
        n_tokens, n_known, base, score, size = ([] for _ in range(5))
        for part, (w, many, owner), (g, often, writer) in zip(cut, own_words, own_grams):
            at = np.searchsorted(words, w)
            n_tokens.append(np.bincount(owner, minlength=len(part)))
            n_known.append(np.bincount(owner, np.repeat(seen[at] > 0, many), len(part)).astype(np.int64))
            base.append(np.bincount(owner, np.repeat(worth[at], many), len(part)))
            score.append(np.bincount(writer, np.repeat(logs[np.searchsorted(bytes_, g)], often), len(part)))
            size.append(np.bincount(writer, minlength=len(part)) - 1)
        n_tokens, n_known, base, score, size = (np.concatenate(x) for x in (n_tokens, n_known, base, score, size))
        return pa.table({"doc_id": ids, "held_out": pa.array(is_held_out(ids.to_pylist())), "n_tokens": n_tokens, "n_known": n_known,
                         "train_tokens": np.full(len(texts), tokens, np.int64), "base_score": base, "score": score, "n_bytes": size,
                         "bits_per_byte": -score / np.log10(2) / np.maximum(size, 1)})

    questions = dealt.groupBy(CHUNK).applyInArrow(lambda k, t: lean(ask, k, t), ASKED)
    answers = questions.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(lambda k, left, right: lean(answer, k, left, right), ANSWERED).withColumnRenamed("chunk", CHUNK)
    return dealt.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(
        lambda k, left, right: lean(decide, k, left, right), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys in an ascending table; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)
