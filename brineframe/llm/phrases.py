"""Phrase collocations by set-oriented mining: occurrence relations that grow by one word a pass.

A relation holds (piece, position, group) for every occurrence of the phrases of one length,
sorted by piece and position. Each pass

1. *merge-joins* the relation with itself on the piece and the adjacent position: two phrases
   of k words that overlap in k - 1 make one of k + 1;
2. *group-counts* the longer phrases over the corpus (counts per chunk of texts first, then sums in
   key buckets);
3. *semi-joins* the occurrences with the groups that are frequent: the next relation.

Every part of a frequent phrase is frequent as well, so no phrase is lost. Relations never
leave their chunk of texts and are not stored: what is kept of a pass is the answer of the key buckets, one bit per
distinct group of a chunk (and the counts of frequent ones, which only the end reads). A pass grows the relations of its chunk
again from the words and these bits. The words are written and shuffled once and stay on the executors' disks for all passes; else only
distinct groups with their counts are shuffled, once per chunk. A position is the word's number in the chunk plus one for every
piece before it, so that the last word of a piece and the first of the next are not adjacent.

At the end each frequent phrase is written out by the first chunk that has it. There, at one
occurrence, the counts of all its parts are known (its cuts), and so are the two phrases that are
longer by one word. A phrase that lies in a longer one with the same count always lies in it at
the same place, so one occurrence decides whether it is dropped; and if it lies in one that is longer by more
words, so it does in one between.

Phrases are known by 64 bits of hash in buckets that further, independent bits choose, words by
64 bits. Languages are told apart by the hash of every word.

Defined cases: a null text is empty; a null language is ``und`` (and joins a language of that
name); rows of equal text count as often as they occur; other columns are ignored; an empty
table gives no phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from ..sources.tables import staged
from . import text as tx
from .chunks import ASKED, CHUNK, asked, bucket_order, lean

# fixed values of the query
LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
IN_WORD = ~BREAKS
IN_WORD[[0x20, 0x09]] = False

CHUNK_BYTES = 4 << 20
TEXTS = f"{CHUNK} long, langs array<string>, counts array<long>, words binary, of_lang binary, at binary, grp binary, size long"
ANSWERED = f"{CHUNK} long, level int, bucket int, n long, flags binary, counts binary, mine binary"
EMITTED = "lang string, phrase string, a long, cuts array<struct<l:long,r:long>>"


def squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes each, all first bytes, then all second ones, compressed; the first byte has the width, the next eight the size."""
    most = int(values.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    width = np.dtype(kind).itemsize
    raw = values.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def numbers(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(raw[0], -1).T).reshape(-1).view(f"<u{raw[0]}")


def packed_places(at: np.ndarray) -> bytes:
    """Ascending positions as steps, which compress well."""
    return squeezed(np.diff(at, prepend=0))


def places(raw: bytes) -> np.ndarray:
    return np.cumsum(numbers(raw), dtype=np.int64)


def language_hash(name: str) -> np.uint64:
    return tx.span_hashes(np.frombuffer(name.encode() + b"\n", np.uint8), np.array([0]), np.array([len(name.encode()) + 1]))[0]


def occurrences(texts: list[bytes], langs: list[str]) -> dict:
    """The words of a chunk: positions, numbers of the distinct (language, word) and what those are."""
    names, of_text = np.unique(np.array(langs, object), return_inverse=True)
    salt = np.array([language_hash(x) for x in names], np.uint64)
    hashes, at, owner, cut, last = [], [], [], [], 0
    for a, b in tx.blocks(texts):
        joined, starts = tx.join(texts[a:b])
        joined = joined.lower()
        buf = np.frombuffer(joined, np.uint8)
        start, end = tx.spans(buf, IN_WORD)
        piece = np.cumsum(BREAKS[buf])[start]
        at.append(last + 1 + np.arange(len(start)) + piece)  # a gap wherever a piece ends
        last = last + 1 + len(start) + int(BREAKS[buf].sum())
        of = of_text[np.repeat(np.arange(a, b), np.diff(np.searchsorted(start, starts)))]
        hashes.append(tx.mix(tx.span_hashes(buf, start, end) ^ salt[of], 1))  # as word_keys
        owner.append(of)
        cut.append((joined, start, end))
    none = [np.zeros(0, np.int64)]
    flat, of = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owner or none)
    keys, first, grp, often = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(-often, kind="stable")  # small numbers for frequent words
    first, grp = first[rank], np.argsort(rank)[grp]
    size = np.cumsum([0, *(len(x[1]) for x in cut)])
    block = np.searchsorted(size, first, side="right") - 1
    words = []
    for k, i in zip(block.tolist(), first.tolist()):
        joined, start, end = cut[k]
        words.append(joined[start[i - size[k]]:end[i - size[k]]])
    return {
        "langs": names.tolist(), "counts": np.bincount(of, minlength=len(names)).tolist(), "words": squeezed(np.frombuffer(b" ".join(words), np.uint8)),
        "of_lang": squeezed(of[first]), "at": packed_places(np.concatenate(at or none)), "grp": squeezed(grp), "size": len(keys),
    }


def word_keys(words: np.ndarray, of_lang: np.ndarray, langs: list[str]) -> np.ndarray:
    """Hash of every distinct word of a chunk in its language."""
    salt = np.array([language_hash(x) for x in langs], np.uint64)
    return tx.mix(tx.span_hashes(words, *tx.spans(words, IN_WORD)) ^ salt[of_lang], 1)


def text_chunks(docs: DataFrame, text: str, lang: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk of texts: its words, and the relation of single words."""
    names = TEXTS.replace(" long", "").split(", ")

    def run(batches):
        tx.release_memory()
        base, n, texts, langs, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def row():
            found = {CHUNK: base + n} | occurrences(texts, langs)
            return pa.RecordBatch.from_arrays(
                [pa.array([found[c.split(" ")[0]]], kind) for c, kind in zip(names, kinds)], names=[c.split(" ")[0] for c in names])

        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()]
        for batch in batches:
            for t, name in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()):
                texts.append(t or b"")
                langs.append(UNKNOWN if name is None else name)
                size += len(texts[-1]) + 1
                if size >= chunk_bytes:
                    yield row()
                    n, texts, langs, size = n + 1, [], [], 0
        if texts:
            yield row()

    return docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(run, TEXTS)


def longer(at: np.ndarray, grp: np.ndarray, keys: np.ndarray, marks: np.ndarray):
    """Merge join of a relation with itself on adjacent positions: the relation of phrases longer by one word."""
    here = np.flatnonzero(at[1:] == at[:-1] + 1)
    pair, number = np.unique(grp[here].astype(np.int64) * max(1, len(keys)) + grp[here + 1], return_inverse=True)
    left, right = np.divmod(pair, max(1, len(keys)))
    one, two = tx.U(tx.BASES[0]), tx.U(tx.BASES[1])
    return at[here], number, tx.mix(keys[left] * one + tx.mix(keys[right] * two)), tx.mix(marks[left] * two + tx.mix(marks[right] * one, 1), 1)


def summed(table: pa.Table, level: int, least: int) -> pa.Table:
    """Group count: for the keys of each chunk which are frequent, their counts, and which of these the chunk writes out.

    ``n`` adds up to all occurrences of frequent phrases."""
    table = table.sort_by("chunk")
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([numbers(x) for x in table.column("extra").to_pylist()])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")  # equal keys in the order of their chunks
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    run = np.cumsum(new) - 1
    total = np.empty(len(keys), np.int64)
    total[order] = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))[run]
    first = np.empty(len(keys), bool)
    first[order] = new
    out, at = {"n": [], "flags": [], "counts": [], "mine": []}, 0
    for p in parts:
        own, mine = total[at:at + len(p)], first[at:at + len(p)]
        frequent = own >= least
        out["n"].append(int(own[frequent & mine].sum()))
        out["flags"].append(squeezed(np.packbits(frequent)))
        out["counts"].append(squeezed(own[frequent]))
        out["mine"].append(squeezed(np.packbits(mine[frequent])))
        at += len(p)
    kinds = {"n": pa.int64(), "flags": pa.binary(), "counts": pa.binary(), "mine": pa.binary()}
    return pa.table({CHUNK: table.column("chunk"), "level": pa.array([level] * len(parts), pa.int32()), "bucket": table.column("bucket")} | {
        c: pa.array(out[c], kind) for c, kind in kinds.items()})


def frequent_only(found: tuple, buckets: int, got: list[dict]) -> tuple:
    """Semi-join of a chunk's occurrences with the frequent groups; the counts of these and whether to write them out, where asked for."""
    at, grp, keys, marks = found
    order, _, cut = bucket_order(marks, buckets)
    ends = [*cut[1:].tolist(), len(keys)] if len(keys) else []
    frequent, count, mine = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for a, b, reply in zip(cut.tolist(), ends, got, strict=True):
        own = order[a:b][np.unpackbits(numbers(reply["flags"]), count=b - a).astype(bool)]
        frequent[own] = True
        if "counts" in reply:
            count[own] = numbers(reply["counts"])
            mine[own] = np.unpackbits(numbers(reply["mine"]), count=len(own)).astype(bool)
    number = np.cumsum(frequent) - 1
    stays = frequent[grp]
    return (at[stays], number[grp[stays]], keys[frequent], marks[frequent]), count[frequent], mine[frequent]


def single_words(words: pa.Table) -> tuple:
    """The relation of all words of a chunk."""
    first = {c: words.column(c)[0].as_py() for c in words.column_names}
    keys = word_keys(numbers(first["words"]), numbers(first["of_lang"]), first["langs"])
    return places(first["at"]), numbers(first["grp"]), keys, tx.mix(tx.mix(keys) * tx.U(tx.BASES[2]), 1)


def candidates(words: pa.Table, level: int, smaller: tuple | None) -> tuple:
    """All occurrences of ``level`` words whose parts are frequent."""
    return single_words(words) if level == 1 else longer(*smaller)


def relations(words: pa.Table, answers: pa.Table, buckets: list[int]):
    """The relations of frequent phrases of 1, 2, ... words of a chunk with their counts, grown from its words by the answers so far."""
    got = {}
    for reply in answers.sort_by([("level", "ascending"), ("bucket", "ascending")]).to_pylist() if buckets else []:
        got.setdefault(reply["level"], []).append(reply)
    found = None
    for level, n in enumerate(buckets, 1):
        found, count, mine = frequent_only(candidates(words, level, found), n, got.get(level, []))
        yield found, count, mine


def counted(dealt: DataFrame, answers: DataFrame | None, buckets: list[int], keys: int, least: int) -> tuple[DataFrame, int]:
    """The answers for the phrases longer by one word than those of ``answers`` (none: for single words), and the number of key buckets."""
    level, parts = len(buckets) + 1, max(1, -(-keys // 500_000))

    def ask(chunk, words, answers):
        smaller = None
        for smaller, _, _ in relations(words, answers, buckets):
            pass
        _, grp, distinct, marks = candidates(words, level, smaller)
        return asked(chunk, distinct, marks, parts, np.bincount(grp, minlength=len(distinct)), squeezed)

    rows = dealt.select(CHUNK, "langs", "words", "of_lang", "at", "grp").groupBy(CHUNK)
    if answers is None:
        questions = rows.applyInArrow(lambda k, words: lean(ask, k[0].as_py(), words, None), ASKED)
    else:
        flags = answers.select(CHUNK, "level", "bucket", "flags").groupBy(CHUNK)
        questions = rows.cogroup(flags).applyInArrow(lambda k, words, flags: lean(ask, k[0].as_py(), words, flags), ASKED)
    return questions.groupBy("bucket").applyInArrow(lambda table: lean(summed, table, level, least), ANSWERED), parts


def written_out(words: pa.Table, answers: pa.Table, buckets: list[int]) -> pa.Table:
    """The phrases that a chunk writes out, with their counts and cuts, without those inside an equally frequent longer one."""
    longest = len(buckets)
    levels = {k: (*found[:2], count, mine) for k, (found, count, mine) in enumerate(relations(words, answers, buckets), 1)}
    out = {"lang": [], "phrase": [], "a": [], "cuts": []}
    if levels:
        w = {c: words.column(c)[0].as_py() for c in ("langs", "words", "of_lang", "at", "grp")}
        spelled, of_lang, at, grp = numbers(w["words"]).tobytes().split(b" "), numbers(w["of_lang"]), places(w["at"]), numbers(w["grp"])

        def count(level, place):
            """Count of the phrase of that many words at each place, 0 if it is not frequent."""
            if level not in levels or not len(levels[level][0]):
                return np.zeros(len(place), np.int64)
            have, group, counts, _ = levels[level]
            i = np.minimum(np.searchsorted(have, place), len(have) - 1)
            return np.where(have[i] == place, counts[group[i]], 0)

        for k in range(2, longest + 1):
            have, group, counts, mine = levels[k]
            distinct, example = np.unique(group, return_index=True)
            distinct, example = distinct[mine[distinct]], example[mine[distinct]]
            place, a = have[example], counts[distinct]
            inside = (count(k + 1, place) >= a) | (count(k + 1, place - 1) >= a) if k < longest else np.zeros(len(a), bool)
            place, a = place[~inside], a[~inside]
            left, right = [count(i, place) for i in range(1, k)], [count(k - i, place + i) for i in range(1, k)]
            first = np.searchsorted(at, place)
            for j, i in enumerate(first.tolist()):
                codes = grp[i:i + k]
                out["lang"].append(w["langs"][of_lang[codes[0]]])
                out["phrase"].append(b" ".join(spelled[c] for c in codes).decode())
                out["a"].append(int(a[j]))
                out["cuts"].append([{"l": int(x[j]), "r": int(y[j])} for x, y in zip(left, right)])
    kind = pa.list_(pa.struct([("l", pa.int64()), ("r", pa.int64())]))
    return pa.table({"lang": pa.array(out["lang"], pa.string()), "phrase": pa.array(out["phrase"], pa.string()), "a": pa.array(out["a"], pa.int64()), "cuts": pa.array(out["cuts"], kind)})


def best_cut():
    """The cut of smallest score, then smallest first part. Products of three counts pass 64 bits."""
    return F.expr("""array_min(transform(cuts, (c, i) -> struct(
        (cast(1000 AS decimal(4,0)) * cast(a AS decimal(19,0)) * cast(n AS decimal(19,0))) div (cast(c.l AS decimal(19,0)) * cast(c.r AS decimal(19,0))) AS score,
        i, c.l AS l, c.r AS r)))""")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all frequent phrases of 2 to ``longest`` words that no equally frequent longer one contains."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written first: chunks of a source whose rows change their order would not fit their answers if they were computed again
    dealt = staged(text_chunks(docs, text, lang, chunk_bytes), shared_dir(spark, "words")).repartition(parts, CHUNK).persist(StorageLevel.DISK_ONLY)
    try:
        keys = dealt.agg(F.sum("size")).first()[0] or 0
        answers, buckets = None, []
        for level in range(1, longest + 1):
            replies, used = counted(dealt, answers, buckets, keys, least)
            replies = staged(replies, shared_dir(spark, f"answers-{level}"))
            answers, buckets = replies if answers is None else answers.union(replies), [*buckets, used]
            keys = replies.agg(F.sum("n")).first()[0] or 0  # a chunk has no more phrases than occurrences
        words = dealt.select(CHUNK, "langs", "words", "of_lang", "at", "grp").groupBy(CHUNK)
        found = staged(words.cogroup(answers.drop("n").groupBy(CHUNK)).applyInArrow(
            lambda words, answers: lean(written_out, words, answers, buckets), EMITTED), shared_dir(spark, "phrases"))
        totals = dealt.select(F.explode(F.arrays_zip("langs", "counts")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.counts").alias("n"))
        totals = staged(totals, shared_dir(spark, "totals"))
    finally:
        dealt.unpersist()
    best = found.join(totals, "lang").withColumn("cut", best_cut())
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def collocations(docs: DataFrame, top: int = TOP, **settings) -> DataFrame:
    """The first ``top`` phrases of every language by score, then count, then phrase, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))  # cut to ``top`` rows before the shuffle
    ranked = phrases(docs, **settings).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
