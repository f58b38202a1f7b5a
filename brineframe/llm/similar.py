"""N-gram Jaccard self-join by grouped prefixes, and the groups that its links connect.

1. *Order.* Every chunk of documents asks for the document counts of its distinct shingles
   (``chunks.consult``; 4 bytes of key inside a bucket, one byte of logarithmic count back).
   Rare first, ties by hash, is the join's global order; shingles of one document only can
   link nothing and are not posted.
2. *Collapse.* Documents with equal sets become one set; sets with the same size and the
   same prefix become one group, posted once per prefix shingle.
3. *Group pairs.* A prefix of n - ceil(t n) + 1 shingles loses no link. Pairs are filtered
   by size and by the position of the common shingle before they expand to sets, and each
   remaining pair of sets is verified by exact intersection.
4. *Links to groups.* First every posting list links its groups to one leader only (the one
   whose shared shingle stands first: it has the fewest shingles of its own), and
   components are formed. Then all remaining pairs are taken in which the sets lie in
   different components: a list that is one component already asks for none, and in the
   others each pair has a side outside the list's main component. So no link between
   components is lost, and a large group of near copies is never expanded into its pairs.

Set members are 64-bit hashes of shingles; a set is known by 128 bits.

Defined cases: null, empty and word-free texts have no shingle and stay alone; a text of
fewer than ``n`` words is one shingle; equal rows belong together; the smallest non-null
doc_id names a component, null if there is none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import staged
from . import text as tx
from .chunks import CHUNK, Layout, asked, bucket_order, consult, ordered, replies, texts_of
from ..session import shared_dir
from .components import components

N = 4
PERCENT = 85
DOCS = "key long, doc_id long, n long, set binary, prefix array<struct<token:long,pos:int>>, grp binary, body binary"


def shingles(texts: list[bytes], n: int):
    """All shingle hashes of the texts end to end, with the independent hash, and the text of each."""
    hashes, counts = tx.word_hashes(texts, lower=True)
    at, owner = tx.inner_windows(counts, n)
    keys, marks = tx.windows(hashes, n)[at], tx.windows(hashes, n, 1)[at]
    place = np.concatenate([[0], np.cumsum(counts)])
    few = np.flatnonzero((counts > 0) & (counts < n))
    short, short_marks = [], []
    for d in few.tolist():
        own = hashes[place[d]:place[d + 1]]
        short.append(tx.windows(own, len(own))[0] ^ np.uint64(len(own)))
        short_marks.append(tx.windows(own, len(own), 1)[0])
    return (np.concatenate([keys, np.array(short, np.uint64)]), np.concatenate([marks, np.array(short_marks, np.uint64)]),
            np.concatenate([owner, few]))


def chunk_sets(texts: list[bytes], n: int):
    """Distinct (text, shingle) pairs by text: texts, numbers of the chunk's distinct shingles; those shingles, marks and counts."""
    keys, marks, owner = shingles(texts, n)
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    pair = np.unique(owner.astype(np.int64) * max(1, len(distinct)) + number)
    docs, numbers = np.divmod(pair, max(1, len(distinct)))
    return docs, numbers, distinct, marks[first], np.bincount(numbers, minlength=len(distinct))


def count_class(table: pa.Table) -> pa.Table:
    """Per key of each chunk: 0 for one document in all, else about 8 steps per doubling of the count."""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(x, np.uint16) for x in table.column("extra").to_pylist()]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts))
    step = np.minimum(255, np.ceil(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[inverse]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "reply": pa.array([x.tobytes() for x in np.split(step, cut)], pa.binary())})


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def sets_of(docs: DataFrame, n: int, percent: int, layout: Layout) -> DataFrame:
    """One row per document; prefix, group and body only where the prefix has a shared shingle, once per chunk and set."""
    buckets = layout.buckets(layout.bytes / 6)
    dealt = layout.deal(docs, "doc_id", "text")

    def ask(chunk, rows):
        _, _, distinct, marks, counts = chunk_sets(texts_of(ordered(rows)), n)
        short = (distinct >> np.uint64(32)).astype(np.uint32)
        return asked(chunk, short, marks, buckets, np.minimum(counts, 65535).astype(np.uint16))

    def decide(chunk, rows, answers):
        rows = ordered(rows)
        texts = texts_of(rows)
        doc, number, distinct, marks, _ = chunk_sets(texts, n)
        order, _, _ = bucket_order(marks, buckets)
        step = np.zeros(len(distinct), np.uint8)
        got = replies(answers)
        if got:
            step[order] = np.frombuffer(b"".join(got), np.uint8)
        place = np.searchsorted(doc, np.arange(len(texts) + 1))
        sizes, names, groups, sets, seen = np.diff(place), [], [], [], set()
        tokens, places, length = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for d in range(len(texts)):
            own = number[place[d]:place[d + 1]]
            size, keys = len(own), distinct[own]
            names.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest())
            groups.append(None)
            sets.append(None)
            if size and names[-1] not in seen:
                seen.add(names[-1])
                rank = np.lexsort((keys, step[own]))[:prefix_length(size, percent)]
                head, common = keys[rank], np.flatnonzero(step[own][rank])
                if len(common):
                    tokens.append(head[common])
                    places.append(common)
                    length[d] = len(common)
                    groups[-1] = hashlib.blake2b(size.to_bytes(8, "little") + head.tobytes(), digest_size=16).digest()
                    sets[-1] = keys.tobytes()
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["token", "pos"])
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pairs, mask=pa.array(length == 0))
        return pa.table({
            "key": pa.array((chunk << 32) | np.arange(len(texts))), "doc_id": rows.column("doc_id").cast(pa.int64()), "n": pa.array(sizes.astype(np.int64)),
            "set": pa.array(names, pa.binary()), "prefix": prefix, "grp": pa.array(groups, pa.binary()), "body": pa.array(sets, pa.binary())})

    return consult(dealt, ask, count_class, decide, DOCS)


def verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of sets, those with 100 * |intersection| >= percent * |union|."""
    full = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(
        bodies.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (p, q) if len(p) < len(q) else (q, p)  # both ascending and distinct
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                hit.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fits(a: str, b: str, percent: int):
    """Size and position filters on the group sides a and b of a shared shingle."""
    na, nb, pa_, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    need = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))
    rest = 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (rest >= need)


def similar_groups(docs: DataFrame, n: int = N, percent: int = PERCENT, layout: Layout | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, key, first): key numbers the rows in the order of
    doc_id, ``first`` marks the smallest row of each component."""
    spark = docs.sparkSession
    rows = staged(sets_of(docs, n, percent, layout or Layout(docs)), shared_dir(spark, "sets"))
    # one node per distinct set, numbered by its smallest row
    nodes = rows.where("n > 0").groupBy("set").agg(F.min("key").alias("id"), F.min_by("doc_id", "key").alias("doc"))
    posted = rows.where(F.col("body").isNotNull())
    once = posted.groupBy("set").agg(F.max_by(F.struct("n", "prefix", "grp", "body"), "key").alias("s")).select("set", "s.*")
    sets = staged(once.join(nodes.select("set", "id"), "set").select("id", "n", "prefix", "grp", "body"), shared_dir(spark, "distinct"))
    groups = sets.groupBy("grp").agg(F.min("id").alias("lead"), F.max("n").alias("n"), F.max_by("prefix", "id").alias("prefix"))
    posts = groups.select("grp", "lead", "n", F.explode("prefix").alias("p")).select("grp", "lead", "n", F.col("p.token").alias("token"), F.col("p.pos").alias("pos"))
    shared = posts.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("pos", "n", "grp", "lead")).alias("top")).where("c > 1")
    posts = staged(posts.join(shared.select("token", "top"), "token"), shared_dir(spark, "posts"))
    member = sets.select("grp", "id")

    # star: each list's groups against its leader, each group's sets against their first
    star = posts.where(F.col("grp") != F.col("top.grp")).select(
        F.struct("n", "pos").alias("l"), F.col("top").alias("r"), "grp", F.col("top.lead").alias("a"))
    star = star.where(_fits("l", "r", percent)).select("grp", "a").distinct().join(member, "grp").select("a", F.col("id").alias("b"))
    inner = sets.join(groups.select("grp", "lead"), "grp").where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    pairs = star.union(inner).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = staged(verified(pairs, sets, percent), shared_dir(spark, "verified"))
    label = staged(components(links), shared_dir(spark, "labels"))

    # rest: pairs across components
    member = staged(member.join(label.withColumnRenamed("node", "id"), "id", "left").select("grp", "id", F.coalesce("component", "id").alias("comp")), shared_dir(spark, "members"))
    in_group = member.groupBy("grp", "comp").agg(F.count("*").alias("c"))
    main = in_group.groupBy("grp").agg(F.max_by("comp", F.struct("c", "comp")).alias("comp"), F.count("*").alias("comps"), F.min("comp").alias("low"))
    tagged = posts.join(main.select("grp", "comp", "comps"), "grp")
    by_list = tagged.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("comps").alias("comps"))
    open_lists = by_list.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.max("comps").alias("comps"))
    open_lists = open_lists.where((F.col("k") > 1) | (F.col("comps") > 1))
    left_open = staged(tagged.join(open_lists.select("token", "main"), "token"), shared_dir(spark, "open"))
    outside = left_open.where((F.col("comp") != F.col("main")) | (F.col("comps") > 1)).select("token", F.struct("n", "pos").alias("l"), F.col("grp").alias("g"), F.col("comp").alias("c"), F.col("comps").alias("k"))
    other = left_open.select("token", F.struct("n", "pos").alias("r"), F.col("grp").alias("h"), F.col("comp").alias("d"), F.col("comps").alias("m"))
    crossing = (F.col("c") != F.col("d")) | (F.col("k") > 1) | (F.col("m") > 1)
    met = outside.join(other, "token").where(crossing & (F.col("g") != F.col("h")) & _fits("l", "r", percent))
    met = met.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    within = main.where("comps > 1").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    side = lambda g, i, c: member.select(F.col("grp").alias(g), F.col("id").alias(i), F.col("comp").alias(c))
    rest = met.union(within).join(side("g", "a", "ca"), "g").join(side("h", "b", "cb"), "h").where("ca != cb")
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = staged(verified(rest, sets, percent), shared_dir(spark, "verified"))
    label = components(links.union(more))

    # keys follow doc_ids, so the smallest row of a component names it
    label = label.join(nodes.select(F.col("id").alias("component"), F.col("doc").alias("name")), "component")
    named = nodes.join(label.withColumnRenamed("node", "id"), "id", "left").select(
        "set", F.coalesce("component", "id").alias("component"), F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("name")).alias("component_id"))
    full = rows.select("key", "doc_id", "n", "set").join(named, "set", "left")
    alone = F.col("component").isNull()  # no shingle
    return full.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component", "key").alias("component"), "key", (F.col("key") == F.coalesce("component", "key")).alias("first"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT, chunk_bytes: int | None = None) -> DataFrame:
    """The first document (in the order of doc_id) of every group, columns unchanged."""
    layout = Layout(docs, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}))
    found = similar_groups(docs, n, percent, layout=layout)
    keep = found.where("first").select(F.shiftright("key", 32).alias(CHUNK), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("row"))

    def pick(key, rows, kept):
        return ordered(rows).take(kept.column("row").combine_chunks().sort()).drop_columns([CHUNK])

    return layout.deal(docs).groupBy(CHUNK).cogroup(keep.groupBy(CHUNK)).applyInArrow(pick, docs.schema)
